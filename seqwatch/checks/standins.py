"""Inputs of the registered queries, derived by Spark from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqwatch.operators.derived import computed_once
from seqwatch.operators.fetches import first_success, number_attempts
from seqwatch.session import scratch_path
from seqwatch.sources.regions import read_regions
from seqwatch.sources.remote import land_replies
from seqwatch.sources.search import explode_ids

CASES = """
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
from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey
where n.n_nationkey <> 3
"""

SEQS = """
select doc_id,
  concat('D', cast(doc_id as string), ' ',
    case doc_id % 7 when 0 then 'Dengue virus 1 isolate' when 1 then 'Dengue virus type 2' when 2 then 'DENV-3' when 3 then 'DENV4'
      when 4 then 'Orthoflavivirus denguei' when 5 then 'Zika virus' else 'DENV1' end,
    case doc_id % 5 when 0 then ', complete genome' when 1 then ', complete cds' when 2 then ', partial cds'
      when 3 then ', partial genome and complete cds' else ', genomic RNA' end) as description,
  case when doc_id % 50 = 0 then '' when doc_id % 9 = 0 then lower(s) else s end as sequence,
  letters
from (select doc_id, letters, translate(letters, 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTNACGTACGR-') as s
      from (select doc_id, regexp_replace(lower(text), '[^a-z]', '') as letters from {documents}))
"""

# A parcel per customer, in one of four reference systems, of one of five shapes; see the SQL's views ``parcels`` and ``corners``.
PARCELS = """
select c_custkey, c_nationkey, c_custkey % 4 as system, c_custkey % 5 as shape,
  case c_custkey % 4 when 0 then cast(0.015625 as double) else cast(32 as double) end as u,
  case c_custkey % 4 when 0 then cast(-75 + c_custkey % 1024 / 1024 as double)
    when 3 then cast(400000 + 64 * (c_custkey % 3000) as double) else cast(900000 + 64 * (c_custkey % 3000) as double) end as x,
  case c_custkey % 4 when 0 then cast(4 + c_custkey % 512 / 1024 as double)
    when 3 then cast(450000 + 64 * (c_custkey % 2000) as double) else cast(950000 + 64 * (c_custkey % 2000) as double) end as y
from {customer}
"""
# How the systems are named, and the rings of the shapes in units.
SYSTEM_NAMES = (None, "EPSG:3116", "urn:ogc:def:crs:EPSG::21897", "urn:ogc:def:crs:EPSG:9.1:32618")
SHAPES = (
    ("Polygon", [[((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ((1, 1), (1, 2), (2, 2), (2, 1), (1, 1))]]),
    ("MultiPolygon", [[((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))], [((3, 0), (5, 0), (3, 3), (3, 0))]]),
    ("Polygon", [[((0, 0), (3, 0), (0, 2), (0, 0))]]),
    ("GeometryCollection", [[((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]]),
    ("Point", []),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders play case reports; the customer's nation plays the region."""
    return spark.sql(CASES, **{name: table(spark, sf_dir, name) for name in ("orders", "customer", "nation")})


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document letters mapped onto nucleotides, with made headers."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return computed_once(spark.sql(SEQS, documents=texts), "description", "sequence", "letters")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sequence as the document a fetch returns: header line and body."""
    body = F.concat(F.lit(">"), "description", F.lit("\n"), "sequence").alias("body")
    return computed_once(seqs(spark, sf_dir).select("doc_id", body), "body")


def tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events play fetch tries: a user is an id, a signup a success, an error has no status."""
    status = F.when(F.col("event_type") == "signup", 200).when(F.col("event_type") != "error", 503)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", "event_id", status.alias("status"))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every try, numbered, with the document where it succeeded."""
    numbered = number_attempts(tries(spark, sf_dir), ["ts", "event_id"], keep=None)
    fetched = numbered.join(documents(spark, sf_dir), F.col("id") == F.col("doc_id"))
    return fetched.select(
        F.col("id").cast("string").alias("id"),
        "attempt",
        "status",
        F.when(F.col("status") == 200, F.col("body")).alias("body"),
    )


def search_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events per page; errors are not listed, so a page of three errors is empty."""
    page = (F.floor(F.col("event_id") / 3) * 100).cast("long").alias("retstart")
    listed = F.when(F.col("event_type") != "error", F.struct("event_id", F.col("user_id").cast("string").alias("id")))
    pages = table(spark, sf_dir, "events").groupBy(page).agg(F.sort_array(F.collect_list(listed)).alias("listed"))
    result = F.struct(F.struct(F.col("listed.id").alias("idlist")).alias("esearchresult"))
    return pages.select("retstart", F.to_json(result).alias("body"))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of customers as lines of GeoJSON, written and read again."""
    rows = spark.sql(PARCELS, customer=table(spark, sf_dir, "customer"))

    def text(*parts) -> Column:
        return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])

    def listed(items) -> Column:
        return text("[", F.concat_ws(",", *items), "]")

    def ring(corners, height: str) -> Column:
        return listed([text("[", F.col("x") + dx * F.col("u"), ",", F.col("y") + dy * F.col("u"), f"{height}]") for dx, dy in corners])

    written = F.lit(None).cast("string")
    for number, (kind, polygons) in enumerate(SHAPES):
        # The triangles have heights, which are not kept.
        drawn = [listed([ring(corners, ",12.5" if number == 2 else "") for corners in polygon]) for polygon in polygons]
        if kind == "Point":
            shape = text('{"type":"Point","coordinates":[', F.col("x"), ",", F.col("y"), "]}")
        elif kind == "GeometryCollection":
            shape = text('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"Polygon","coordinates":', drawn[0], "}]}")
        else:
            shape = text(f'{{"type":"{kind}","coordinates":', listed(drawn) if kind == "MultiPolygon" else drawn[0], "}")
        written = F.when(F.col("shape") == number, shape).otherwise(written)
    written = F.when(F.col("c_custkey") % 97 == 0, "null").otherwise(written)
    named = F.lit("")
    for number, name in enumerate(SYSTEM_NAMES):
        if name:
            named = F.when(F.col("system") == number, f',"crs":{{"type":"name","properties":{{"name":"{name}"}}}}').otherwise(named)
    feature = text('{"type":"Feature","properties":{"c_custkey":', F.col("c_custkey"), ',"c_nationkey":', F.col("c_nationkey"), '},"geometry":', written, named, "}")
    path = scratch_path(spark, "parcels")
    rows.select(feature).write.text(path)
    return read_regions(spark, path, {"c_custkey": "bigint", "c_nationkey": "int"}, multi_line=False, with_epsg=True)


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature per nation: a square of two degrees, on a grid of five by five; two of the nations have none."""
    key, corners = F.col("n_nationkey"), ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))
    points = F.array(*[F.array((-79 + 2 * (key % 5) + dx).cast("double"), (-4 + 2 * F.floor(key / 5) + dy).cast("double")) for dx, dy in corners])
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates")))
    geometry = F.when(~key.isin(7, 20), shape).alias("geometry")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), geometry, F.lit(4326).alias("epsg"))


def spelled_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names from the first words of documents: as odd ones spell them, and the known ones from even ones.

    Some of the first are those of their neighbour with a letter left out, changed, or written without its accent and with blanks around.
    """
    words = F.regexp_extract("text", "^([A-Za-zéèêàçôûîùñäöü]+ [A-Za-zéèêàçôûîùñäöü]+)", 1)
    texts = table(spark, sf_dir, "documents").select("doc_id", words.alias("name")).where("length(name) > 5")
    odd = F.col("doc_id") % 2 == 1
    changed = (
        F.when(F.col("doc_id") % 8 == 0, F.concat(F.substr("name", F.lit(1), F.lit(3)), F.substr("name", F.lit(5))))
        .when(F.col("doc_id") % 8 == 2, F.concat(F.substr("name", F.lit(1), F.lit(2)), F.lit("x"), F.substr("name", F.lit(4))))
        .when(F.col("doc_id") % 8 == 4, F.concat(F.lit(" "), F.translate("name", "éèê", "eee"), F.lit("  ")))
    )
    known = texts.where(~odd)
    return texts.where(odd).select("name").unionByName(known.select(changed.alias("name")).where("name is not null")), known.select("name")


def letter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule per document of some length: one of two pieces of its letters, a completeness phrase, and nothing partial."""
    found = seqs(spark, sf_dir).where("length(letters) >= 200").select("doc_id", "letters")
    label = F.concat(F.lit("rule "), F.col("doc_id").cast("string"))
    pieces = F.concat(F.substr("letters", (1 + F.col("doc_id") % 50).cast("int"), F.lit(14)), F.lit("|"), F.substr("letters", F.lit(120), F.lit(16)))
    clauses = F.array(
        F.struct(pieces.alias("pattern"), F.lit(False).alias("negated")), F.struct(F.lit("complete genome|complete cds").alias("pattern"), F.lit(False).alias("negated")),
        F.struct(F.lit("partial").alias("pattern"), F.lit(True).alias("negated")),
    )
    return found.select(label.alias("label"), F.inline(clauses))


def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their fetched documents, 40 to a search."""
    pages = search_responses(spark, sf_dir)
    fetched = first_success(fetch_log(spark, sf_dir))
    listed = explode_ids(pages).join(fetched, "id", "left").groupBy("retstart").agg(F.collect_list(F.struct("id", "body")).alias("documents"))
    all_pages = pages.select("retstart").join(listed, "retstart", "left")
    documents = F.coalesce("documents", F.array().cast(listed.schema["documents"].dataType))
    number = F.floor(F.col("retstart") / 4000)
    return all_pages.select(F.concat(F.lit("search "), number.cast("string")).alias("search"), (F.col("retstart") % 4000).alias("retstart"), documents.alias("documents"))


def landed_replies(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The tries of the fetch log and the search's pages, landed in a folder; returns what the transport has to know.

    Every seventh page is answered at the third try only.
    """
    pages = search_responses(spark, sf_dir).select(F.lit("search").alias("kind"), F.col("retstart").cast("string").alias("key"), "retstart", "body")
    third = F.col("retstart") / 100 % 7 == 3
    refused = pages.where(third).select("kind", "key", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"), F.lit(503).alias("status"), F.lit(None).cast("string").alias("body"))
    answered = pages.select("kind", "key", F.when(third, 3).otherwise(1).alias("attempt"), F.lit(200).alias("status"), "body")
    log = fetch_log(spark, sf_dir).select(F.lit("fetch").alias("kind"), F.col("id").alias("key"), "attempt", "status", "body")
    replies = log.unionByName(answered).unionByName(refused)
    # About as many replies per file, whatever the size of the tables.
    buckets = 1 + table(spark, sf_dir, "events").count() // 1000
    path = scratch_path(spark, "replies")
    land_replies(replies, path, buckets)
    return {"transport": "folder", "replies": path, "buckets": str(buckets), "pause": "0"}
