import xml.etree.ElementTree as ElementTree

import pytest
from pyspark.sql import functions as F

from seqwatch.functions import drawing, geometry as geo
from seqwatch.plans import maps
from seqwatch.sinks.line_files import write_line_files

SQUARE = [[[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]]]
FAR = [[[(5.0, 5.0), (6.0, 5.0), (6.0, 7.0), (5.0, 5.0)]]]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(y, n, c, f, p) for y in (2007, 2008) for n, c, f, p in (("A & <B>", 3, 0.0, SQUARE), ("C", 9, 1.0, FAR), ("D", None, None, SQUARE), ("E", 5, 0.3, None))]
    return spark.createDataFrame(rows, f"year int, name string, casos bigint, fill double, polygons {geo.POLYGONS}")


def names(folder):
    return sorted(p.name for p in folder.iterdir() if not p.name.startswith("."))


def test_a_file_per_map(spark, table, tmp_path):
    maps.write_maps(table, str(tmp_path / "maps"))
    assert names(tmp_path / "maps") == ["Dengue_Map_2007.svg", "Dengue_Map_2008.svg", "_SUCCESS"]
    for year in (2007, 2008):
        root = ElementTree.parse(tmp_path / "maps" / f"Dengue_Map_{year}.svg").getroot()
        tag = lambda name: "{http://www.w3.org/2000/svg}" + name
        regions = [p for p in root.iter(tag("path")) if p.find(tag("title")) is not None]
        assert [p.find(tag("title")).text for p in regions] == ["A & <B>: 3", "C: 9", "D: no cases"]
        assert [p.get("fill") for p in regions] == ["#FCDACA", "#7C000C", "#CCCCCC"]
        texts = [t.text for t in root.iter(tag("text"))]
        assert f"DENV cases by department in Colombia ({year})" in texts and "9" in texts and "3" in texts and "200 km" in texts
        assert "2°E" in texts and "4°N" in texts and "0°" in texts
        # Everything is drawn inside of the frame.
        for p in regions:
            numbers = [int(v) for part in p.get("d").strip("MZ").replace("ZM", "L").split("L") for v in part.split(" ")]
            assert all(maps.LEFT <= x <= maps.RIGHT for x in numbers[::2]) and all(maps.TOP <= y <= maps.BOTTOM for y in numbers[1::2])


def test_maps_without_boundaries_have_no_file(spark, table):
    none = table.withColumn("polygons", F.when(F.col("year") == 2007, F.col("polygons")))
    assert {r.year for r in maps.map_lines(none).select("year").distinct().collect()} == {2007}
    assert maps.map_lines(table.limit(0)).collect() == []


def test_colours(values):
    found = values([None, 0.0, 0.25, 0.5, 0.75, 1.0, -1.0, 2.0], "double", drawing.ramp_colour)
    assert found == ["#CCCCCC", *drawing.RAMP, "#FCDACA", "#7C000C"]
    # Halfway in Lab between black and white is a middle grey, not half of 255.
    assert values([0.5], "double", lambda v: drawing.ramp_colour(v, ("#000000", "#FFFFFF"))) == ["#777777"]


def test_round_steps(values):
    assert values([0.9, 1.0, 1.9, 2.0, 4.9, 5.0, 370.0, 1000.0], "double", drawing.round_step) == [0.5, 1, 1, 2, 2, 5, 200, 1000]


def lines(spark, rows):
    return spark.createDataFrame(rows, "file string, at int, line string")


def test_lines_keep_their_order(spark, tmp_path):
    rows = [(f"f{i % 3}", -i, f"line {i}") for i in range(3000)]
    write_line_files(lines(spark, rows).repartition(7), str(tmp_path / "out"), ["at"])
    for k in range(3):
        expected = [line for name, at, line in sorted(rows, key=lambda r: r[1]) if name == f"f{k}"]
        assert (tmp_path / "out" / f"f{k}").read_text().splitlines() == expected


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    folder = tmp_path / "out"
    write_line_files(lines(spark, [("old", 1, "x")]), str(folder))
    failing = lines(spark, [(f"f{i}", i, "x") for i in range(40)]).withColumn(
        "line", F.when(F.col("file") == "f7", F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("line"))
    )
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken row"):
            write_line_files(failing, str(folder), mode=mode)
        assert names(folder) == ["_SUCCESS", "old"]


def test_modes(spark, tmp_path):
    folder = tmp_path / "out"
    write_line_files(lines(spark, [("a", 1, "1"), ("b", 1, None)]), str(folder))
    assert (folder / "b").read_text() == "\n"
    with pytest.raises(Exception, match="has files already"):
        write_line_files(lines(spark, [("c", 1, "1")]), str(folder))
    with pytest.raises(Exception, match="has files already"):
        write_line_files(lines(spark, [("c", 1, "1"), ("a", 1, "2")]), str(folder), mode="append")
    assert names(folder) == ["_SUCCESS", "a", "b"] and (folder / "a").read_text() == "1\n"
    write_line_files(lines(spark, [("c", 1, "3")]), str(folder), mode="append")
    assert names(folder) == ["_SUCCESS", "a", "b", "c"]
    write_line_files(lines(spark, [("d", 1, "4")]), f"file:{folder}", mode="overwrite")
    assert names(folder) == ["_SUCCESS", "d"]
    for name in ("../x", "_hidden", "", None):
        with pytest.raises(Exception, match="not a name for a file"):
            write_line_files(lines(spark, [(name, 1, "4")]), str(folder), mode="append")
    with pytest.raises(ValueError):
        write_line_files(lines(spark, []), str(folder), mode="ignore")
