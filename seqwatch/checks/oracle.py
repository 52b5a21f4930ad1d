"""DuckDB SQL for the registered queries, written from the tables, not from the library."""

from __future__ import annotations



def _filled_years() -> str:
    low, high = "min(casos) over (partition by year)", "max(casos) over (partition by year)"
    return f"""select name, year, casos, case when casos is null then null when {high} = {low} then 0.5
  else cast(casos - {low} as double) / cast({high} - {low} as double) end as fill from year_table"""


# Views over the given tables; see FIXTURES.md. The phrases in ``rules`` and ``matches``.
VIEWS = {
    "cases": """
select o.o_orderkey as case_id,
  case when o.o_orderkey % 997 = 0 then null else cast(year(o.o_orderdate) as int) end as ano,
  cast(o.o_orderdate as date) as fec_not,
  case o.o_orderkey % 5
    when 0 then substr(cast(o.o_orderdate as string), 1, 10)
    when 1 then concat(substr(cast(o.o_orderdate as string), 1, 10), ' 00:00:00')
    when 2 then concat(cast(year(o.o_orderdate) as string), '-', cast(month(o.o_orderdate) as string), '-', cast(day(o.o_orderdate) as string))
    when 3 then '' else '31/12/1999' end as fec_txt,
  case when o.o_orderkey % 11 = 0 then null when o.o_orderkey % 3 = 0 then 'F' when o.o_orderkey % 13 = 0 then '' else 'M' end as sexo,
  case when o.o_orderkey % 17 = 0 then null else cast((o.o_custkey * 7 + o.o_orderkey) % 95 as double) end as edad,
  case when o.o_orderkey % 101 = 0 then 'UNKNOWN' when o.o_orderkey % 103 = 0 then null
    when o.o_orderkey % 4 = 0 then concat(chr(9), ' ', lower(n.n_name), ' ') else n.n_name end as dept
from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey
where n.n_nationkey <> 3""",
    "named": "select *, upper(trim(dept, chr(32) || chr(9) || chr(10) || chr(13))) as region from cases",
    "dated": """
select *, try_cast(regexp_extract(fec_txt, '^ *([0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2})', 1) as date) as parsed from cases""",
    "areas": "select upper(trim(n_name)) as name from nation",
    "parcels": """
select c_custkey, c_nationkey, c_custkey % 4 as system, c_custkey % 5 as shape,
  case c_custkey % 4 when 0 then 0.015625::double else 32::double end as u,
  case c_custkey % 4 when 0 then -75 + (c_custkey % 1024)::double / 1024
    when 3 then (400000 + 64 * (c_custkey % 3000))::double else (900000 + 64 * (c_custkey % 3000))::double end as x,
  case c_custkey % 4 when 0 then 4 + (c_custkey % 512)::double / 1024
    when 3 then (450000 + 64 * (c_custkey % 2000))::double else (950000 + 64 * (c_custkey % 2000))::double end as y,
  case c_custkey % 4 when 0 then 4326 when 1 then 3116 when 2 then 21897 else 32618 end as epsg
from customer""",
    # polygon, ring, place and units of every corner; shape 4 has none, and every 97th customer no geometry.
    "corners": """
select p.c_custkey, p.c_nationkey, p.system, s.polygon, s.ring, s.place, p.x + s.dx * p.u as x, p.y + s.dy * p.u as y
from parcels p join (values
 (0,1,1,1,0,0),(0,1,1,2,4,0),(0,1,1,3,4,4),(0,1,1,4,0,4),(0,1,1,5,0,0),(0,1,2,1,1,1),(0,1,2,2,1,2),(0,1,2,3,2,2),(0,1,2,4,2,1),(0,1,2,5,1,1),
 (1,1,1,1,0,0),(1,1,1,2,2,0),(1,1,1,3,2,2),(1,1,1,4,0,2),(1,1,1,5,0,0),(1,2,1,1,3,0),(1,2,1,2,5,0),(1,2,1,3,3,3),(1,2,1,4,3,0),
 (2,1,1,1,0,0),(2,1,1,2,3,0),(2,1,1,3,0,2),(2,1,1,4,0,0),
 (3,1,1,1,0,0),(3,1,1,2,1,0),(3,1,1,3,1,1),(3,1,1,4,0,1),(3,1,1,5,0,0)) as s(shape, polygon, ring, place, dx, dy)
on s.shape = p.shape where p.c_custkey % 97 <> 0""",
    # The systems' parameters, then each step of the way to WGS 84.
    "zones": """
select *, a / (1 + n) * (1 + n * n / 4 + n ** 4 / 64) * k as radius from (
  select *, f / (2 - f) as n, f * (2 - f) as e2 from (
    select system, a, 1 / fi as f, radians(lat0) as lat0, radians(lon0) as lon0, k, fe, fn, dx, dy, dz from (values
     (1, 6378137.0::double, 298.257222101::double, 4.596200416666666::double, -74.07750791666666::double, 1::double, 1e6, 1e6, 0::double, 0::double, 0::double),
     (2, 6378388.0, 297.0, 4.599047222222222, -74.08091666666667, 1, 1e6, 1e6, 307, 304, -318),
     (3, 6378137.0, 298.257223563, 0.0, -75.0, 0.9996, 5e5, 0.0, 0, 0, 0)) as t(system, a, fi, lat0, lon0, k, fe, fn, dx, dy, dz)))""",
    "origins": """
select *, fn - radius * (chi + (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180) * sin(2 * chi)
    + (13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440) * sin(4 * chi)
    + (61 * n ** 3 / 240 - 103 * n ** 4 / 140) * sin(6 * chi) + 49561 * n ** 4 / 161280 * sin(8 * chi)) as north
from (select *, atan(sinh(asinh(tan(lat0)) - sqrt(e2) * atanh(sqrt(e2) * sin(lat0)))) as chi from zones)""",
    "spheres": """
select c_custkey, c_nationkey, polygon, ring, place, z.* exclude (system),
  xi - (n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 - n ** 4 / 360) * sin(2 * xi) * cosh(2 * eta)
    - (n ** 2 / 48 + n ** 3 / 15 - 437 * n ** 4 / 1440) * sin(4 * xi) * cosh(4 * eta)
    - (17 * n ** 3 / 480 - 37 * n ** 4 / 840) * sin(6 * xi) * cosh(6 * eta) - 4397 * n ** 4 / 161280 * sin(8 * xi) * cosh(8 * eta) as xs,
  eta - (n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 - n ** 4 / 360) * cos(2 * xi) * sinh(2 * eta)
    - (n ** 2 / 48 + n ** 3 / 15 - 437 * n ** 4 / 1440) * cos(4 * xi) * sinh(4 * eta)
    - (17 * n ** 3 / 480 - 37 * n ** 4 / 840) * cos(6 * xi) * sinh(6 * eta) - 4397 * n ** 4 / 161280 * cos(8 * xi) * sinh(8 * eta) as es
from (select c.* exclude (system), o.*, (c.y - o.north) / o.radius as xi, (c.x - o.fe) / o.radius as eta
      from corners c join origins o on o.system = c.system) z""",
    "datums": """
select *, lon0 + atan2(sinh(es), cos(xs)) as lon, chis + (2 * n - 2 * n ** 2 / 3 - 2 * n ** 3 + 116 * n ** 4 / 45) * sin(2 * chis)
    + (7 * n ** 2 / 3 - 8 * n ** 3 / 5 - 227 * n ** 4 / 45) * sin(4 * chis) + (56 * n ** 3 / 15 - 136 * n ** 4 / 35) * sin(6 * chis)
    + 4279 * n ** 4 / 630 * sin(8 * chis) as lat
from (select *, asin(sin(xs) / cosh(es)) as chis from spheres)""",
    "geocentric": """
select *, v * cos(lat) * cos(lon) + dx as gx, v * cos(lat) * sin(lon) + dy as gy, v * (1 - e2) * sin(lat) + dz as gz
from (select *, a / sqrt(1 - e2 * sin(lat) ** 2) as v from datums)""",
    "degrees": """
select c_custkey, c_nationkey, polygon, ring, place, x as lon, y as lat from corners where system = 0
union all
select c_custkey, c_nationkey, polygon, ring, place, degrees(atan2(gy, gx)),
  degrees(atan2(gz + 0.0067394967422764341 * b * sin(t) ** 3, sqrt(gx ** 2 + gy ** 2) - 0.0066943799901413165 * 6378137 * cos(t) ** 3))
from (select *, atan2(gz * 6378137, sqrt(gx ** 2 + gy ** 2) * b) as t from (select *, 6378137 * (1 - 1 / 298.257223563::double) as b from geocentric))""",
    "lengthened": """
select *, radians(lon) * 6378137 as px, 6378137 * (1 - e * e) / 2 * (s / (1 - e * e * s * s) + atanh(e * s) / e) as py
from (select *, sin(radians(lat)) as s, sqrt(0.0066943799901413165::double) as e from degrees)""",
    "sized": """
select c_custkey, polygon, ring, abs(sum(px * ny - nx * py)) / 2 as area from (
  select *, lead(px) over w as nx, lead(py) over w as ny from (
    select c_custkey, polygon, ring, place, px - first_value(px) over w as px, py - first_value(py) over w as py from lengthened
    window w as (partition by c_custkey, polygon, ring order by place))
  window w as (partition by c_custkey, polygon, ring order by place))
group by all""",
    "stops": """
select i, 116 * y - 16 as l, 500 * (x - y) as a, 200 * (y - z) as b from (
  select i, case when x > 0.008856451679035631 then cbrt(x) else x / 0.12841854934601665 + 4 / 29::double end as x, case when y > 0.008856451679035631 then cbrt(y) else y / 0.12841854934601665 + 4 / 29::double end as y,
    case when z > 0.008856451679035631 then cbrt(z) else z / 0.12841854934601665 + 4 / 29::double end as z from (
    select i, (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047 as x, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b as y,
      (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883 as z from (
      select i, case when r <= 0.04045 then r / 12.92 else ((r + 0.055) / 1.055) ** 2.4 end as r,
        case when g <= 0.04045 then g / 12.92 else ((g + 0.055) / 1.055) ** 2.4 end as g,
        case when b <= 0.04045 then b / 12.92 else ((b + 0.055) / 1.055) ** 2.4 end as b
      from (select i, r / 255::double as r, g / 255::double as g, b / 255::double as b from (values
        (0, 252, 218, 202), (1, 244, 148, 137), (2, 234, 51, 47), (3, 230, 13, 12), (4, 124, 0, 12)) as t(i, r, g, b)))))""",
    "mixed": """
select f.name, f.year, f.casos, lo.l + (f.place - f.i) * (hi.l - lo.l) as l, lo.a + (f.place - f.i) * (hi.a - lo.a) as a,
  lo.b + (f.place - f.i) * (hi.b - lo.b) as b
from (select *, least(floor(place), 3)::int as i from (select *, fill * 4 as place from (FILLED))) f
left join stops lo on lo.i = f.i left join stops hi on hi.i = f.i + 1""".replace("FILLED", _filled_years()),
    "linear": """
select name, year, casos, 3.2404542 * x - 1.5371385 * y - 0.4985314 * z as r, -0.9692660 * x + 1.8760108 * y + 0.0415560 * z as g,
  0.0556434 * x - 0.2040259 * y + 1.0572252 * z as b from (
  select name, year, casos, 0.95047 * case when x > 6 / 29::double then x ** 3 else 0.12841854934601665 * (x - 4 / 29::double) end as x,
    case when y > 6 / 29::double then y ** 3 else 0.12841854934601665 * (y - 4 / 29::double) end as y,
    1.08883 * case when z > 6 / 29::double then z ** 3 else 0.12841854934601665 * (z - 4 / 29::double) end as z
  from (select name, year, casos, (l + 16) / 116 + a / 500 as x, (l + 16) / 116 as y, (l + 16) / 116 - b / 200 as z from mixed))""",
    "coloured": """
select name, year, casos, case when casos is null then '#CCCCCC' else '#' || upper(lpad(to_hex(r), 2, '0') || lpad(to_hex(g), 2, '0') || lpad(to_hex(b), 2, '0')) end as colour
from (select name, year, casos, floor(r * 255 + 0.5)::bigint as r, floor(g * 255 + 0.5)::bigint as g, floor(b * 255 + 0.5)::bigint as b from (
  select name, year, casos, case when r <= 0.0031308 then 12.92 * r else 1.055 * r ** (1 / 2.4) - 0.055 end as r,
    case when g <= 0.0031308 then 12.92 * g else 1.055 * g ** (1 / 2.4) - 0.055 end as g,
    case when b <= 0.0031308 then 12.92 * b else 1.055 * b ** (1 / 2.4) - 0.055 end as b
  from (select name, year, casos, least(greatest(r, 0), 1) as r, least(greatest(g, 0), 1) as g, least(greatest(b, 0), 1) as b from linear)))""",
    # The whole map is ten degrees wide and high, with half a degree on each side.
    "outlines": """
select upper(trim(n_name)) as name, string_agg(px || ' ' || py, 'L' order by place) as points from (
  select n_name, place, round(8000 + (-79 + 2 * (n_nationkey % 5) + dx + 79.5) * cos(radians(1)) * unit)::bigint::varchar as px,
    round(6000 + (6.5 - (-4 + 2 * (n_nationkey // 5) + dy)) * unit)::bigint::varchar as py
  from nation cross join (values (1, 0, 0), (2, 2, 0), (3, 2, 2), (4, 0, 2), (5, 0, 0)) as c(place, dx, dy)
  cross join (select least(74000 / (11 * cos(radians(1))), 68000 / 11::double) as unit) where n_nationkey not in (7, 20)) group by 1""",
    "seqs": """
select doc_id,
  concat('D', cast(doc_id as string), ' ',
    case doc_id % 7 when 0 then 'Dengue virus 1 isolate' when 1 then 'Dengue virus type 2' when 2 then 'DENV-3' when 3 then 'DENV4'
      when 4 then 'Orthoflavivirus denguei' when 5 then 'Zika virus' else 'DENV1' end,
    case doc_id % 5 when 0 then ', complete genome' when 1 then ', complete cds' when 2 then ', partial cds'
      when 3 then ', partial genome and complete cds' else ', genomic RNA' end) as description,
  case when doc_id % 50 = 0 then '' when doc_id % 9 = 0 then lower(s) else s end as sequence,
  letters
from (select doc_id, letters, translate(letters, 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTNACGTACGR-') as s
      from (select doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') as letters from documents))""",
    "docs": "select doc_id, concat('>', description, chr(10), sequence) as body from seqs",
    "rules": """
select * from (values
 ('DENV1', 'Dengue virus type 1|Dengue virus 1|DENV-1|Orthoflavivirus denguei'),
 ('DENV2', 'Dengue virus type 2|Dengue virus 2|DENV-2|DENV2|Orthoflavivirus denguei'),
 ('DENV3', 'Dengue virus type 3|Dengue virus 3|DENV-3|DENV3|Orthoflavivirus denguei'),
 ('DENV4', 'Dengue virus type 4|Dengue virus 4|DENV-4|DENV4|Orthoflavivirus denguei')) as t(serotype, pattern)""",
    "matches": """
select d.doc_id, d.body, r.serotype from docs d join rules r on regexp_matches(d.body, r.pattern)
where regexp_matches(d.body, 'complete genome|complete cds') and not regexp_matches(d.body, 'partial')""",
    "fetch_log": """
select cast(e.id as varchar) as id, e.attempt, e.status, case when e.status = 200 then d.body end as body
from (select user_id as id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as attempt,
        case event_type when 'signup' then 200 when 'error' then null else 503 end as status from events) e
join docs d on d.doc_id = e.id""",
    "fetched": """
select ids.id, f.attempt, f.body
from (select distinct id from fetch_log) ids left join (
  select id, attempt, body from fetch_log where status = 200 and attempt <= 5
  qualify row_number() over (partition by id order by attempt) = 1) f on f.id = ids.id""",
    "judged": """
select f.id, r.serotype, f.body,
  case when f.body is null then 'errors'
    when regexp_matches(f.body, r.pattern) and regexp_matches(f.body, 'complete genome|complete cds')
      and not regexp_matches(f.body, 'partial') then 'included' else 'excluded' end as outcome
from fetched f cross join rules r""",
    "search_pages": """
select cast(floor(event_id / 3) as bigint) * 100 as retstart,
  cast(sum(case when event_type <> 'error' then 1 else 0 end) as int) as n_ids
from events group by 1""",
    "used_pages": """
select retstart, n_ids from search_pages
where retstart < coalesce((select min(retstart) from search_pages where n_ids = 0), 9223372036854775807)""",
    "listed": """
select cast(floor(event_id / 3) as bigint) * 100 as retstart,
  cast(row_number() over (partition by floor(event_id / 3) order by event_id) - 1 as int) as rank, cast(user_id as varchar) as id
from events where event_type <> 'error'""",
    "sought": """
select l.id, count(*) as n_listed from listed l join used_pages p on l.retstart = p.retstart group by l.id""",
    "region_counts": "select region, count(*) as casos from named group by region",
    "region_table": "select a.name, c.casos from areas a left join region_counts c on c.region = a.name",
    "year_table": """
select a.name, cast(y.year as int) as year, c.casos
from areas a cross join (select unnest(range(1994, 2003)) as year) y
left join (select region, year(fec_not) as year, count(*) as casos from named group by 1, 2) c
  on c.region = a.name and c.year = y.year""",
    "text_year_table": """
select a.name, cast(y.year as int) as year, c.casos
from areas a cross join (select unnest(range(1994, 2003)) as year) y
left join (select upper(trim(dept, chr(32) || chr(9) || chr(10) || chr(13))) as region, year(parsed) as year, count(*) as casos
           from dated group by 1, 2) c
  on c.region = a.name and c.year = y.year""",
}

_USES = {
    "named": ["cases"],
    "dated": ["cases"],
    "docs": ["seqs"],
    "matches": ["docs", "rules"],
    "fetch_log": ["docs"],
    "fetched": ["fetch_log"],
    "judged": ["fetched", "rules"],
    "used_pages": ["search_pages"],
    "sought": ["listed", "used_pages"],
    "region_counts": ["named"],
    "region_table": ["areas", "region_counts"],
    "year_table": ["areas", "named"],
    "corners": ["parcels"],
    "origins": ["zones"],
    "spheres": ["corners", "origins"],
    "datums": ["spheres"],
    "geocentric": ["datums"],
    "degrees": ["geocentric"],
    "lengthened": ["degrees"],
    "sized": ["lengthened"],
    "mixed": ["year_table", "stops"],
    "linear": ["mixed"],
    "coloured": ["linear"],
    "text_year_table": ["areas", "dated"],
}


def _with(sql: str, *views: str) -> str:
    """The SQL after the views it needs, each behind the views it uses itself."""
    needed: list[str] = []

    def add(view: str) -> None:
        for used in _USES.get(view, []):
            add(used)
        if view not in needed:
            needed.append(view)

    for view in views:
        add(view)
    return "with " + ",\n".join(f"{view} as ({VIEWS[view].strip()})" for view in needed) + "\n" + sql


def _fill(table: str, keys: str, window: str) -> str:
    low, high = f"min(casos) over ({window})", f"max(casos) over ({window})"
    return f"""
select {keys}, casos,
  case when casos is null then null when {high} = {low} then 0.5
    else cast(casos - {low} as double) / cast({high} - {low} as double) end as fill
from {table}"""


_NUMBERS = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
}
_TEXTS = {"l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


def _profile() -> str:
    rows = [
        f"""select '{c}' as "column", '{kind}' as type, count(*) as n, count(*) - count({c}) as missing, cast(min({c}) as double) as min,
  quantile_cont(cast({c} as double), 0.25) as q1, quantile_cont(cast({c} as double), 0.5) as median, round(avg({c}), 6) as mean,
  quantile_cont(cast({c} as double), 0.75) as q3, cast(max({c}) as double) as max from lineitem"""
        for c, kind in _NUMBERS.items()
    ]
    rows += [
        f"""select '{c}', '{kind}', count(*), count(*) - count({c}), null, null, null, null, null, null from lineitem"""
        for c, kind in _TEXTS.items()
    ]
    return "\nunion all ".join(rows)


_ORDERS = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string",
}


def _structure() -> str:
    first = "(select * from orders order by o_orderkey limit 6)"
    return "\nunion all ".join(
        f"""select '{c}' as "column", '{kind}' as type,
  string_agg(coalesce(cast({c} as varchar), 'NA'), ' ' order by o_orderkey) as first_values from {first}"""
        for c, kind in _ORDERS.items()
    )


_STATS = """
select serotype, cast(sum(case when outcome = 'included' then {weight} else 0 end) as bigint) as included,
  cast(sum(case when outcome = 'excluded' then {weight} else 0 end) as bigint) as excluded,
  cast(sum(case when outcome = 'errors' then {weight} else 0 end) as bigint) as errors
from {source} group by serotype"""

# The age bands and the sex labels.
_AGE = """case when edad <= 5 then '0-5 years' when edad <= 17 then '6-17 years' when edad <= 60 then '18-60 years'
  else '60+ years' end"""

_SEX = "case sexo when 'M' then 'Male' else 'Female' end"

_AMBIGUOUS = "length(regexp_replace(sequence, '[ACGTacgt]', '', 'g'))"


def _entry(sequence: str, width: int) -> str:
    wrapped = f"rtrim(regexp_replace({sequence}, '(.{{{width}}})', '\\1' || chr(10), 'g'), chr(10))"
    return f"concat('>', description, case when {sequence} = '' then '' else chr(10) || {wrapped} end)"


_KEPT = "select id, serotype, body from judged where outcome = 'included'"

_AMBIGUITY_STATS = _with(
    f"""select count(*) as total, count(*) filter (share <= 0.05) as kept,
  count(*) filter (share is null or share > 0.05) as dropped, count(*) filter (sequence = '') as n_empty
from (select sequence, cast({_AMBIGUOUS} as double) / nullif(length(sequence), 0) as share from seqs)""",
    "seqs",
)

_PURGE_STATS = _with(
    """select count(*) as total, count(*) filter (not regexp_matches(upper(sequence), '[-N]')) as valid,
  count(*) filter (regexp_matches(upper(sequence), '[-N]')) as removed from seqs""",
    "seqs",
)

_LAYOUTS = _with(
    """select regexp_extract(header, '^[ ]*([^ ]*)', 1) as id, header as description, sequence
from (select concat(case when doc_id % 3 = 0 then '>' else '' end, description) as header, sequence from seqs
  union all select '' as header, '' as sequence from seqs)""",
    "seqs",
)

_REGION_GEOMETRY = """(select upper(trim(n_name)) as name,
  concat('{"type":"Point","coordinates":[', cast(n_nationkey as varchar), ',', cast(n_regionkey as varchar), ']}') as geometry from nation)"""

ORACLE: dict[str, str] = {
    "region_year_map": _with(_fill("year_table", "name, year", "partition by year"), "year_table"),
    "region_year_map_from_text": _with(_fill("text_year_table", "name, year", "partition by year"), "text_year_table"),
    "region_geometry": _with(
        """select c_custkey, epsg, case when drawn then [1, 2, 1, 1, 0][shape + 1] end::integer as n_polygons,
  case when drawn then [2, 2, 1, 1, 0][shape + 1] end::integer as n_rings, case when drawn then [10, 9, 4, 5, 0][shape + 1] end::integer as n_points,
  case when drawn then [15, 7, 3, 1, 0][shape + 1] * u * u end as area,
  case when drawn and shape < 4 then x end as xmin, case when drawn and shape < 4 then y end as ymin,
  case when drawn and shape < 4 then x + [4, 5, 3, 1, 0][shape + 1] * u end as xmax,
  case when drawn and shape < 4 then y + [4, 3, 2, 1, 0][shape + 1] * u end as ymax
from (select *, c_custkey % 97 <> 0 as drawn from parcels)""",
        "parcels",
    ),
    "region_wgs84": _with(
        """select p.c_custkey, case when p.c_custkey % 97 = 0 then p.epsg else 4326 end::integer as epsg, xmin, ymin, xmax, ymax,
  case when p.c_custkey % 97 <> 0 then coalesce(round(area, 2), 0) end as area
from parcels p left join (select c_custkey, round(min(lon), 7) as xmin, round(min(lat), 7) as ymin, round(max(lon), 7) as xmax, round(max(lat), 7) as ymax
  from degrees group by 1) d on d.c_custkey = p.c_custkey
left join (select c_custkey, sum(case when ring = 1 then area else -area end) as area from sized group by 1) s on s.c_custkey = p.c_custkey""",
        "sized",
    ),
    "map_extents": _with(
        """select p.c_nationkey::integer as c_nationkey, round(min(lon), 7) as xmin, round(min(lat), 7) as ymin, round(max(lon), 7) as xmax, round(max(lat), 7) as ymax
from parcels p left join degrees d on d.c_custkey = p.c_custkey group by 1""",
        "degrees",
    ),
    "map_files": _with(
        """select 'Dengue_Map_' || c.year || '.svg' as file, c.name, coalesce(c.casos::varchar, 'no cases') as casos, c.colour, 'M' || o.points || 'Z' as data
from coloured c join outlines o on o.name = c.name""",
        "coloured", "outlines",
    ),
    "annual_cases": _with("select ano, count(*) as casos from cases group by ano", "cases"),
    "cases_by_sex": _with(
        f"select ano, sexo, {_SEX} as label, count(*) as casos from cases where sexo in ('M', 'F') group by ano, sexo", "cases"
    ),
    "cases_by_age_group": _with(
        f"select ano, {_AGE} as age_group, count(*) as casos, cast(count(*) as double) as casos_plotted from cases group by 1, 2",
        "cases",
    ),
    "case_tables": _with(
        f"""select 'annual' as kind, ano, cast(null as varchar) as key, count(*) as casos from cases group by ano
union all select 'sex', ano, sexo, count(*) from cases where sexo in ('M', 'F') group by ano, sexo
union all select 'age_group', ano, {_AGE}, count(*) from cases group by 2, 3""",
        "cases",
    ),
    "cases_by_region": _with("select region as dept, casos from region_counts", "region_counts"),
    "cases_by_region_as_written": _with("select any_value(region) as dept, count(*) as casos from named group by dept", "named"),
    "region_map": _with("select name, casos from region_table", "region_table"),
    "region_map_as_written": _with(
        """select a.name, c.casos from areas a
left join (select dept, any_value(region) as region, count(*) as casos from named group by dept) c on c.region = a.name""",
        "areas",
        "named",
    ),
    "map_fill": _with(_fill("region_table", "name", ""), "region_table"),
    "one_year_map": _with(
        _fill(
            """(select a.name, c.casos from areas a
  left join (select region, count(*) as casos from named where year(fec_not) = 1996 group by region) c on c.region = a.name) t""",
            "name",
            "",
        ),
        "areas",
        "named",
    ),
    "region_reconcile": _with(
        """select distinct region as name, 'cases' as side from named where region is null or region not in (select name from areas)
union all select distinct name, 'regions' from areas where name not in (select region from named where region is not null)""",
        "areas",
        "named",
    ),
    "year_levels": _with(
        """select ano, cast(dense_rank() over (order by ano) as int) as level
from (select distinct ano from cases where ano is not null)""",
        "cases",
    ),
    "distinct_regions": _with("select distinct dept from cases", "cases"),
    "blank_to_null": _with(
        """select case_id, ano, fec_not, nullif(fec_txt, '') as fec_txt, nullif(sexo, '') as sexo, edad, nullif(dept, '') as dept
from cases""",
        "cases",
    ),
    "parsed_dates": _with(
        """select case_id, fec_txt, strftime(parsed, '%Y-%m-%d') as parsed, cast(year(parsed) as int) as year from dated""", "dated"
    ),
    "column_profile": _profile(),
    "preview": _with("select case_id, ano, sexo, edad, dept from cases order by case_id limit 6", "cases"),
    "structure": _structure(),
    "ambiguity": _with(
        f"""select doc_id, cast({_AMBIGUOUS} as int) as n_ambiguous,
  cast({_AMBIGUOUS} as double) / nullif(length(sequence), 0) as ambiguous_fraction from seqs""",
        "seqs",
    ),
    "filter_ambiguous_0": _with(
        f"select doc_id, description, sequence from seqs where sequence <> '' and {_AMBIGUOUS} = 0", "seqs"
    ),
    "filter_ambiguous_5pct": _with(
        f"""select doc_id, description, sequence from seqs
where cast({_AMBIGUOUS} as double) / nullif(length(sequence), 0) <= 0.05""",
        "seqs",
    ),
    "ambiguity_stats": _AMBIGUITY_STATS,
    "dna_letters": _with(
        """select doc_id, regexp_replace(upper(letters), '[^ACGTMRWSYKVHDBN]', '', 'g') as letters,
  cast(length(regexp_replace(upper(letters), '[ACGTMRWSYKVHDBN]', '', 'g')) as int) as n_non_dna from seqs""",
        "seqs",
    ),
    "purge": _with(
        "select doc_id, description, sequence from seqs where not regexp_matches(upper(sequence), '[-N]')", "seqs"
    ),
    "purge_stats": _PURGE_STATS,
    "fasta_text": _with(f"select doc_id, {_entry('sequence', 60)} as entry from seqs", "seqs"),
    "purged_fasta": _with(
        f"select doc_id, {_entry('upper(sequence)', 80)} as entry from seqs where not regexp_matches(upper(sequence), '[-N]')",
        "seqs",
    ),
    "fasta_round_trip": _with("select concat('D', cast(doc_id as varchar)) as id, description, sequence from seqs", "seqs"),
    "combined_fasta": _with(
        """select concat('D', cast(s.doc_id as varchar)) as id, s.description, s.sequence
from seqs s join matches m on m.doc_id = s.doc_id""",
        "matches",
    ),
    "serotype_matches": _with(
        "select doc_id, serotype, cast(count(*) over (partition by doc_id) as int) as n_serotypes from matches", "matches"
    ),
    "all_serotypes_union": _with("select doc_id, serotype, body from matches", "matches"),
    "one_serotype": _with("select doc_id, serotype, body from matches where serotype = 'DENV2'", "matches"),
    "document_records": _with(
        """select doc_id, cast(1 as int) as number, concat('D', cast(doc_id as varchar)) as id, description, sequence from seqs""",
        "seqs",
    ),
    "purge_by_serotype": _with(
        """select m.serotype, concat('D', cast(s.doc_id as varchar)) as id, s.description, upper(s.sequence) as sequence
from seqs s join matches m on m.doc_id = s.doc_id where not regexp_matches(upper(s.sequence), '[-N]')""",
        "matches",
    ),
    "purge_stats_by_serotype": _with(
        """select r.serotype, count(s.doc_id) as total,
  count(s.doc_id) filter (not regexp_matches(upper(s.sequence), '[-N]')) as valid,
  count(s.doc_id) filter (regexp_matches(upper(s.sequence), '[-N]')) as removed
from rules r left join matches m on m.serotype = r.serotype left join seqs s on s.doc_id = m.doc_id group by r.serotype""",
        "matches",
    ),
    "search_ids": _with("select retstart, rank, id from listed", "listed"),
    "pages_before_cutoff": _with("select retstart, n_ids from used_pages", "used_pages"),
    "search_cutoff": _with(
        "select coalesce(min(retstart) filter (n_ids = 0), max(retstart) + 100) as cut from search_pages", "search_pages"
    ),
    "fetch_log": _with("select id, attempt, status, body from fetch_log", "fetch_log"),
    "numbered_attempts": """
select * from (select user_id as id, event_id,
    cast(row_number() over (partition by user_id order by ts, event_id) as int) as attempt,
    case event_type when 'signup' then 200 when 'error' then null else 503 end as status from events) where attempt <= 5""",
    "first_success": _with("select id, attempt, body from fetched", "fetched"),
    "first_success_two_tries": _with(
        """select ids.id, f.attempt, f.body
from (select distinct id from fetch_log) ids left join (
  select id, attempt, body from fetch_log where status = 200 and attempt <= 2
  qualify row_number() over (partition by id order by attempt) = 1) f on f.id = ids.id""",
        "fetch_log",
    ),
    "fetch_outcomes": _with("select id, outcome from judged where serotype = 'DENV1'", "judged"),
    "curate": _with(_STATS.format(weight="1", source="judged"), "judged"),
    "curate_kept": _with(_KEPT, "judged"),
    "curate_search": _with(
        _STATS.format(
            weight="n_listed",
            source="""(select r.serotype, s.n_listed, coalesce(j.outcome, 'errors') as outcome
  from sought s cross join rules r left join judged j on j.id = s.id and j.serotype = r.serotype)""",
        ),
        "sought",
        "judged",
    ),
    "curate_search_kept": _with(_KEPT + " and id in (select id from sought)", "sought", "judged"),
    "curate_search_to_folder_kept": _with(_KEPT + " and id in (select id from sought)", "sought", "judged"),
    "csv_cases": _with("select case_id, ano, fec_txt, sexo, edad, dept from cases", "cases"),
    "geojson_regions": """select n_name as "DPTO_CNMBR",
  concat('{"type":"Point","coordinates":[', cast(n_nationkey as varchar), ',', cast(n_regionkey as varchar), ']}') as geometry
from nation""",
    "region_map_from_files": _with(
        f"""select t.name as "DPTO_CNMBR", g.geometry, t.casos, t.fill
from ({_fill("region_table", "name", "")}) t join {_REGION_GEOMETRY} g on g.name = t.name""",
        "region_table",
    ),
    "region_year_map_from_files": _with(
        f"""select t.name as "DPTO_CNMBR", g.geometry, t.year, t.casos, t.fill
from ({_fill("text_year_table", "name, year", "partition by year")}) t join {_REGION_GEOMETRY} g on g.name = t.name""",
        "text_year_table",
    ),
    "fasta_layouts": _LAYOUTS,
    "fasta_layouts_whole": _LAYOUTS,
    "folder_children": _with("select concat('D', cast(doc_id as varchar)) as id, description, sequence from seqs", "seqs"),
    "kept_partitions": _with(_KEPT, "judged"),
    "curate_to_folder": _with(_STATS.format(weight="1", source="judged"), "judged"),
    "purge_folder": _with(
        """select concat('D', cast(doc_id as varchar)) as id, description, upper(sequence) as sequence from seqs
where not regexp_matches(upper(sequence), '[-N]')""",
        "seqs",
    ),
    "purge_folder_stats": _PURGE_STATS,
    "filter_fasta": _with(
        f"""select concat('D', cast(doc_id as varchar)) as id, description, sequence from seqs
where cast({_AMBIGUOUS} as double) / nullif(length(sequence), 0) <= 0.05""",
        "seqs",
    ),
    "filter_fasta_stats": _AMBIGUITY_STATS,
    "map_partitions": _with(_fill("year_table", "name, year", "partition by year"), "year_table"),
}
# The same tables by way of files, and the same counts on the way to them.
ORACLE["case_tables_from_files"] = ORACLE["case_tables"]
ORACLE["curate_search_to_folder"] = ORACLE["curate_search"]
ORACLE["search_progress"] = _with(
    """select 'search ' || (p.retstart // 4000) as search, count(*) filter (p.n_ids > 0 and p.retstart < coalesce(c.cut, p.retstart + 1)) as pages,
  coalesce(sum(listed) filter (p.retstart < coalesce(c.cut, p.retstart + 1)), 0)::bigint as listed,
  coalesce(sum(listed - bodies) filter (p.retstart < coalesce(c.cut, p.retstart + 1)), 0)::bigint as errors,
  coalesce(sum(bodies) filter (p.retstart < coalesce(c.cut, p.retstart + 1)), 0)::bigint as bodies,
  coalesce(sum(n1) filter (p.retstart < coalesce(c.cut, p.retstart + 1)), 0)::bigint as "n_DENV1",
  coalesce(sum(n2) filter (p.retstart < coalesce(c.cut, p.retstart + 1)), 0)::bigint as "n_DENV2",
  coalesce(sum(n3) filter (p.retstart < coalesce(c.cut, p.retstart + 1)), 0)::bigint as "n_DENV3",
  coalesce(sum(n4) filter (p.retstart < coalesce(c.cut, p.retstart + 1)), 0)::bigint as "n_DENV4",
  any_value(c.cut) is not null as closed
from search_pages p left join (
  select l.retstart, count(*) as listed, count(f.body) as bodies, count(*) filter (n1) as n1, count(*) filter (n2) as n2,
    count(*) filter (n3) as n3, count(*) filter (n4) as n4
  from listed l left join (
    select id, any_value(body) as body, bool_or(outcome = 'included' and serotype = 'DENV1') as n1, bool_or(outcome = 'included' and serotype = 'DENV2') as n2,
      bool_or(outcome = 'included' and serotype = 'DENV3') as n3, bool_or(outcome = 'included' and serotype = 'DENV4') as n4 from judged group by id
  ) f on f.id = l.id group by l.retstart) d on d.retstart = p.retstart
left join (select retstart // 4000 as search, min(retstart) as cut from search_pages where n_ids = 0 group by 1) c on c.search = p.retstart // 4000
group by p.retstart // 4000""",
    "search_pages", "listed", "judged",
)
ORACLE["fetched_documents"] = ORACLE["first_success_repeated"] = ORACLE["first_success"]
ORACLE["fetch_and_curate"] = ORACLE["curate_search"]
ORACLE["fasta_bare_returns"] = ORACLE["folder_children"]
ORACLE["rules_table"] = ORACLE["serotype_matches"]
ORACLE["many_rules"] = _with(
    """select t.doc_id, 'rule ' || r.doc_id as rule from (select doc_id, concat(description, ' ', letters) as body from seqs) t
join (select doc_id, substr(letters, 1 + doc_id % 50, 14) as one, substr(letters, 120, 16) as other from seqs where length(letters) >= 200) r on contains(t.body, r.one) or contains(t.body, r.other)
where regexp_matches(t.body, 'complete genome|complete cds') and not contains(t.body, 'partial')""",
    "seqs",
)
ORACLE["row_numbers"] = _with("select case_id, row_number() over (order by case_id) - 1 as row from cases", "cases")
ORACLE["first_appearance"] = _with(
    """select dept, min(row) as first_row from (select nullif(dept, 'NA') as dept, row_number() over (order by case_id) - 1 as row from cases) group by dept""", "cases"
)
ORACLE["file_head"] = _with(
    """select case_id, ano, nullif(sexo, '') as sexo, edad, dept, row_number() over (order by case_id) - 1 as row from cases order by case_id limit 6""", "cases"
)
ORACLE["sketched_profile"] = "\nunion all ".join(
    f"""select '{c}' as "column", count(*) as n, count(*) - count({c}) as missing, min({c})::double as min, round(avg({c}), 4) as mean, max({c})::double as max,
  true as q1_near, true as median_near, true as q3_near from lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_orderkey")
)
ORACLE["nearest_names"] = """
with words as (select doc_id, regexp_extract(text, '^([A-Za-zéèêàçôûîùñäöü]+ [A-Za-zéèêàçôûîùñäöü]+)', 1) as name from documents),
texts as (select * from words where length(name) > 5),
known as (select distinct name as nearest, strip_accents(upper(trim(name))) as folded from texts where doc_id % 2 = 0),
spelled as (
  select name from texts where doc_id % 2 = 1
  union select case doc_id % 8 when 0 then substr(name, 1, 3) || substr(name, 5) when 2 then substr(name, 1, 2) || 'x' || substr(name, 4)
    when 4 then ' ' || translate(name, 'éèê', 'eee') || '  ' end from texts where doc_id % 8 in (0, 2, 4)
),
wanted as (select name, strip_accents(upper(trim(name))) as folded from spelled where name not in (select nearest from known)),
near as (
  select w.name, k.nearest, levenshtein(w.folded, k.folded)::int as distance from wanted w join known k on levenshtein(w.folded, k.folded) <= 2
)
select w.name, n.nearest, n.distance from wanted w
left join (select * from near qualify row_number() over (partition by name order by distance, encode(nearest)) = 1) n on n.name = w.name"""
_AGED = "case when case_id % 31 = 7 then null else edad end"
ORACLE["case_files_by_header"] = _with(
    f"""select case_id, case when case_id % 4 = 2 then null else ano end as ano, {_AGED} as edad, dept,
  case when case_id % 4 = 2 then null else nullif(sexo, '') end as sexo from cases""",
    "cases",
)
ORACLE["case_files_rejected"] = _with(
    """select 'value of edad' as cause, count(*) as n from cases where case_id % 31 = 7
union all select 'number of fields', count(*) from cases where case_id % 50 = 0""",
    "cases",
)
