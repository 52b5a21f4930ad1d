"""Maps as files: one drawing per year from the regions' boundaries and their places on the colour scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqwatch.functions import drawing, geometry as geo
from seqwatch.operators.geometry import map_extent, to_wgs84, with_polygons
from seqwatch.operators.regions import FIRST_YEAR, LAST_YEAR
from seqwatch.plans.surveillance import region_year_map
from seqwatch.sinks.line_files import write_line_files

# A drawing's size in inches, its texts, its file's name.
WIDTH, HEIGHT = 10, 8
TITLE, LEGEND, CAPTION = "DENV cases by department in Colombia", "Number of cases", "Datum: WGS84. SIVIGILA - 2024."
FILE_NAME = "Dengue_Map"
# How much wider than its regions a map is, on each side, and how much of its width the scale bar may take.
MARGIN, BAR = 0.05, 0.5

#: Units of a drawing per inch, and where the map is in it.
UNITS = 10_000
LEFT, TOP, RIGHT, BOTTOM = 8_000, 6_000, 82_000, 74_000


def draw_region_years(
    cases: DataFrame,
    regions: DataFrame,
    path: str,
    first: int = FIRST_YEAR,
    last: int = LAST_YEAR,
    region: str = "Departamento_ocurrencia",
    name: str = "DPTO_CNMBR",
    date: str = "FEC_NOT",
    mode: str = "error",
) -> None:
    """A file per year, in one job: ``regions`` has name, geometry (text) and epsg, as ``read_regions`` gives them ``with_epsg``.

    Either all files are there afterwards or none of this run.
    """
    placed = to_wgs84(with_polygons(regions)).drop("geometry")
    table = region_year_map(cases, placed, first, last, region, name, date, carry=[c for c in placed.columns if c != name])
    write_maps(table, path, name, mode)


def write_maps(table: DataFrame, path: str, name: str = "name", mode: str = "error", by: str = "year") -> None:
    lines = map_lines(table, name, by)
    file = F.concat(F.lit(f"{FILE_NAME}_"), F.col(by).cast("string"), F.lit(".svg"))
    write_line_files(lines.select(file.alias("file"), "place", "name", "line"), path, ["place", "name"], mode)


def map_lines(table: DataFrame, name: str = "name", by: str = "year", value: str = "casos", polygons: str = "polygons") -> DataFrame:
    """by, place, name, line: every map as the lines of an SVG drawing, in the order of place and name.

    ``table`` has a row per map and region, with polygons of longitudes and latitudes, the count and its ``fill``. A map has
    as many lines as regions, and some for its frame. A map none of whose regions has a boundary has no lines.
    """
    limits = table.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    maps = map_extent(table, [by], polygons).join(limits, by).where("xmin is not null")
    frame = _framed(maps)
    shapes = table.select(by, F.col(name).alias("name"), F.col(value).alias("value"), "fill", F.col(polygons).alias("polygons"))
    # A row per map: few, as the caller asks for them.
    drawn = shapes.where("polygons is not null").join(F.broadcast(frame), by)
    label = F.concat_ws(": ", F.coalesce("name", F.lit("")), F.coalesce(F.col("value").cast("string"), F.lit("no cases")))
    data = drawing.path(F.col("polygons"), _x_of, _y_of)
    region = _joined(
        '<path fill-rule="evenodd" stroke="black" stroke-width="40" fill="', drawing.ramp_colour(F.col("fill")), '" d="', data, '"><title>',
        drawing.escaped(label), "</title></path>",
    )
    regions = drawn.select(by, F.lit(1).alias("place"), "name", region.alias("line"))
    return regions.unionByName(_frame_lines(frame, by))


def _framed(maps: DataFrame) -> DataFrame:
    """The maps with the frame that is shown, the units of a degree and the middle latitude."""
    x, y = (F.greatest(F.col(f"{c}max") - F.col(f"{c}min"), F.lit(1e-9)) * MARGIN for c in "xy")
    wide = maps.withColumns({"west": F.col("xmin") - x, "east": F.col("xmax") + x, "south": F.col("ymin") - y, "north": F.col("ymax") + y})
    wide = wide.withColumn("middle", (F.col("south") + F.col("north")) / 2).withColumn("shrink", F.cos(F.radians("middle")))
    unit = F.least((RIGHT - LEFT) / ((F.col("east") - F.col("west")) * F.col("shrink")), (BOTTOM - TOP) / (F.col("north") - F.col("south")))
    return wide.withColumn("unit", unit).drop("xmin", "xmax", "ymin", "ymax")


def _x_of(longitude: Column) -> Column:
    return LEFT + (longitude - F.col("west")) * F.col("shrink") * F.col("unit")


def _y_of(latitude: Column) -> Column:
    return TOP + (F.col("north") - latitude) * F.col("unit")


def _joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])


def _text(x: Column | int, y: Column | int, size: int, words: Column, style: str = "") -> Column:
    return _joined("<text x=\"", _whole(x), '" y="', _whole(y), f'" font-size="{size}"{style}>', words, "</text>")


def _whole(value: Column | int) -> Column:
    return F.lit(str(value)) if isinstance(value, int) else F.round(value).cast("long").cast("string")


def _number(value: Column) -> Column:
    """Without a fraction where there is none."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.round(value, 6).cast("string"))


def _frame_lines(frame: DataFrame, by: str) -> DataFrame:
    """What is drawn before (place 0) and after (2) the regions."""
    middle, bold = ' text-anchor="middle"', ' font-weight="bold"'
    width, height = drawing.inches(WIDTH, UNITS), drawing.inches(HEIGHT, UNITS)
    opening = F.lit(
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}in" height="{HEIGHT}in" viewBox="0 0 {width} {height}" font-family="sans-serif">'
    )
    title = _text(width // 2, 3_500, 2_200, _joined(f"{TITLE} (", F.col(by).cast("string"), ")"), middle + bold)
    before = [opening, title, _graticule("west", "east", _x_of, True), _graticule("south", "north", _y_of, False)]

    stops = "".join(f'<stop offset="{i / (len(drawing.RAMP) - 1)}" stop-color="{c}"/>' for i, c in enumerate(drawing.RAMP))
    ramp = F.lit(f'<defs><linearGradient id="ramp" x1="0" y1="1" x2="0" y2="0">{stops}</linearGradient></defs>')
    legend = [
        _text(85_000, 25_000, 1_700, F.lit(LEGEND)), F.lit('<rect x="85000" y="27000" width="3000" height="20000" fill="url(#ramp)"/>'),
        _text(89_000, 28_500, 1_400, F.coalesce(F.col("high").cast("string"), F.lit(""))),
        _text(89_000, 47_000, 1_400, F.coalesce(F.col("low").cast("string"), F.lit(""))),
        F.lit(f'<rect x="85000" y="49000" width="3000" height="2000" fill="{drawing.NO_VALUE}"/>'), _text(89_000, 50_600, 1_400, F.lit("NA")),
    ]
    degree = geo.degree_of_longitude(F.col("middle"))
    length = drawing.round_step((F.col("east") - F.col("west")) * degree / 1000 * BAR)
    bar = _joined(
        f'<rect x="{LEFT + 1000}" y="{BOTTOM - 2000}" height="600" width="', _whole(length * 1000 / degree * F.col("shrink") * F.col("unit")), '" fill="black"/>',
    )
    after = [ramp, *legend, bar, _text(LEFT + 1_000, BOTTOM - 2_500, 1_400, _joined(_number(length), " km"))]
    after.append(F.lit(f'<path d="M{RIGHT - 2000} {TOP + 5000}L{RIGHT - 1000} {TOP + 1000}L{RIGHT} {TOP + 5000}L{RIGHT - 1000} {TOP + 4000}Z" fill="black"/>'))
    after.append(_text(RIGHT - 1_000, TOP + 7_000, 1_700, F.lit("N"), middle))
    after.append(_text(width // 2, height - 2_000, 1_400, F.lit(CAPTION), middle + ' font-style="italic"'))
    after.append(F.lit("</svg>"))

    def rows(place: int, lines: Sequence[Column]) -> Column:
        return F.transform(F.array(*lines), lambda line, i: F.struct(F.lit(place).alias("place"), F.lpad(i.cast("string"), 3, "0").alias("name"), line.alias("line")))

    both = F.concat(rows(0, before), rows(2, after))
    return frame.select(by, F.inline(both))


def _graticule(low: str, high: str, place_of, upright: bool) -> Column:
    """Dashed lines at round degrees, with their labels, as one group."""
    step = drawing.round_step((F.col(high) - F.col(low)) / 4)
    # How many steps from 0: few, whatever the map.
    numbers = F.sequence(F.ceil(F.col(low) / step).cast("int"), F.floor(F.col(high) / step).cast("int"))

    def line(i: Column) -> Column:
        degree = i * step
        at, label = _whole(place_of(degree)), _number(F.abs(degree))
        if upright:
            side = F.when(degree < 0, "W").when(degree > 0, "E").otherwise("")
            drawn = _joined("M", at, f" {TOP}V{BOTTOM}")
            word = _text(place_of(degree), BOTTOM + 1_800, 1_400, _joined(label, "°", side), ' text-anchor="middle"')
        else:
            side = F.when(degree < 0, "S").when(degree > 0, "N").otherwise("")
            drawn = _joined(f"M{LEFT} ", at, f"H{RIGHT}")
            word = _text(LEFT - 500, place_of(degree), 1_400, _joined(label, "°", side), ' text-anchor="end"')
        return _joined('<path stroke="#CCCCCC" stroke-width="60" stroke-dasharray="400 400" d="', drawn, '"/>', word)

    lines = F.when(F.ceil(F.col(low) / step) <= F.floor(F.col(high) / step), F.transform(numbers, line)).otherwise(F.array().cast("array<string>"))
    return _joined("<g>", F.array_join(lines, ""), "</g>")
