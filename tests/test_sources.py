import json

import pytest
from pyspark.sql import functions as F

from seqwatch.operators.cases import blanks_to_null
from seqwatch.operators.regions import join_counts, normalise_column
from seqwatch.sources.cases import read_cases
from seqwatch.sources.regions import read_regions
from seqwatch.sources.search import count_ids, explode_ids, listed_ids

CSV = """id,Departamento_ocurrencia,ANO,SEXO,EDAD,FEC_NOT,remark
1,ANTIOQUIA,2010,M,5,2010-01-02,x
2," antioquia ",2010.0,F,5.5,2010-01-02 00:00:00,"a, b"
3,,NA,,,,
4,"",2011,"",NA,"",
5,NA,junk,"NA",old,junk,"say ""hi"", twice"
"""


def test_case_list(spark, tmp_path):
    (tmp_path / "cases.csv").write_text(CSV)
    cases = read_cases(spark, str(tmp_path))
    assert cases.dtypes == [
        ("ANO", "int"), ("SEXO", "string"), ("EDAD", "double"), ("FEC_NOT", "string"), ("Departamento_ocurrencia", "string"),
    ]
    rows = [tuple(row) for row in blanks_to_null(cases).collect()]
    assert rows == [
        (2010, "M", 5.0, "2010-01-02", "ANTIOQUIA"),
        (2010, "F", 5.5, "2010-01-02 00:00:00", " antioquia "),
        (None, None, None, None, None),
        (2011, None, None, None, None),
        (None, None, None, "junk", None),
    ]


def test_quoted_commas_and_quotes_do_not_shift_columns(spark, tmp_path):
    (tmp_path / "cases.csv").write_text(CSV)
    remarks = read_cases(spark, str(tmp_path), {"remark": "string", "id": "int"}).collect()
    assert [(row.remark, row.id) for row in remarks][1::3] == [("a, b", 2), ('say "hi", twice', 5)]


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "cases.csv").write_text('ANO,SEXO\n2010,"M\nx"\n2011,F\n')
    rows = read_cases(spark, str(tmp_path), {"ANO": "int", "SEXO": "string"}, multi_line=True).collect()
    assert [tuple(row) for row in rows] == [(2010, "M\nx"), (2011, "F")]


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ANO,SEXO\n2010,M\n" * 1)
    (tmp_path / "b.csv").write_text("SEXO,ANO\nM,2010\n")
    with pytest.raises(Exception, match="header"):
        read_cases(spark, str(tmp_path), {"ANO": "int", "SEXO": "string"}).collect()


POLYGON = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0.5], [1, 1], [0, 0]]]}
MULTI = {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}
FEATURES = [
    {"type": "Feature", "properties": {"DPTO_CNMBR": " Antioquia ", "other": 1}, "geometry": POLYGON},
    {"type": "Feature", "properties": {"DPTO_CNMBR": "Bogotá"}, "geometry": MULTI},
    {"type": "Feature", "properties": {"other": 2}, "geometry": None},
]


def test_feature_collection(spark, tmp_path):
    path = tmp_path / "regions.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=1, ensure_ascii=False))
    rows = read_regions(spark, str(path)).collect()
    assert [row.DPTO_CNMBR for row in rows] == [" Antioquia ", "Bogotá", None]
    assert [row.geometry and json.loads(row.geometry) for row in rows] == [POLYGON, MULTI, None]


def test_one_feature_per_line(spark, tmp_path):
    path = tmp_path / "regions.geojsonl"
    path.write_text("\n".join(json.dumps(feature) for feature in FEATURES))
    rows = read_regions(spark, str(path), {"DPTO_CNMBR": "string", "other": "int"}, multi_line=False).collect()
    assert [(row.DPTO_CNMBR, row.other) for row in rows] == [(" Antioquia ", 1), ("Bogotá", None), (None, 2)]


def test_region_join_carries_the_geometry(spark, tmp_path):
    path = tmp_path / "regions.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}))
    counts = spark.createDataFrame([("ANTIOQUIA", 3), (None, 9)], "Departamento_ocurrencia string, casos bigint")
    regions = normalise_column(read_regions(spark, str(path)), "DPTO_CNMBR")
    rows = {row.DPTO_CNMBR: (row.casos, row.geometry is not None) for row in join_counts(regions, counts).collect()}
    assert rows == {"ANTIOQUIA": (3, True), "BOGOTÁ": (None, True), None: (None, False)}
    safe = {row.DPTO_CNMBR: row.casos for row in join_counts(regions, counts, null_safe=True).collect()}
    assert safe == {"ANTIOQUIA": 3, "BOGOTÁ": None, None: 9}


RESPONSES = [
    '{"esearchresult":{"count":"2","idlist":["1","2"]}}',
    '{"esearchresult":{"idlist":[]}}',
    '{"header":{}}',
    "<html>",
    "",
    None,
]


def test_search_responses(values, spark):
    assert values(RESPONSES, "string", listed_ids) == [["1", "2"], [], None, None, None, None]
    assert values(RESPONSES, "string", count_ids) == [2, 0, 0, 0, 0, 0]
    frame = spark.createDataFrame(list(enumerate(RESPONSES)), "retstart int, body string")
    assert [tuple(row) for row in explode_ids(frame).collect()] == [(0, 0, "1"), (0, 1, "2")]


def test_blanks_only_change_text_columns(spark):
    frame = spark.createDataFrame([("", 0, " "), ("a", None, "")], "a string, b int, `c d` string")
    assert [tuple(row) for row in blanks_to_null(frame).collect()] == [(None, 0, " "), ("a", None, None)]
    assert blanks_to_null(frame).columns == ["a", "b", "c d"]
    assert frame.select(F.lit(1)).count() == 2


def test_headers_that_differ_by_file(spark, tmp_path):
    from seqwatch.sources.cases import read_cases_by_header

    (tmp_path / "2007.csv").write_text("ANO,SEXO,EDAD,FEC_NOT,Departamento_ocurrencia\n2007,M,5,2007-01-02,\"x, y\"\n2007,F,old,,NA\n2007,M\n")
    (tmp_path / "2008.csv").write_text("﻿Departamento_ocurrencia,EXTRA,ANO,SEXO\r\nCauca,1,2008.0,F\r\n,2,2008.5,M\r\n")
    (tmp_path / "2009.csv").write_text("ANO,ANO,SEXO\n2009,1,M\n2009,1,M,4\n")
    (tmp_path / "2010.csv").write_text("")
    (tmp_path / "2011.csv").write_text("ANO,SEXO\n")
    found = read_cases_by_header(spark, str(tmp_path))
    rows = sorted(map(tuple, found.rows.collect()), key=repr)
    assert rows == sorted([
        (2007, "M", 5.0, "2007-01-02", "x, y"), (2007, "F", None, None, None), (2008, "F", None, None, "Cauca"), (None, "M", None, None, None), (2009, "M", None, None, None),
    ], key=repr)
    rejected = sorted((r.file.rsplit("/", 1)[-1], r.cause, r.n) for r in found.rejected.collect())
    assert rejected == [
        ("2007.csv", "number of fields", 1), ("2007.csv", "value of EDAD", 1), ("2008.csv", "value of ANO", 1), ("2009.csv", "number of fields", 1),
    ]
    headers = {r.file.rsplit("/", 1)[-1]: r.header for r in found.headers.collect()}
    assert headers["2010.csv"] is None and headers["2011.csv"] == "ANO,SEXO" and len(headers) == 5
    assert found.rows.columns == ["ANO", "SEXO", "EDAD", "FEC_NOT", "Departamento_ocurrencia"]


def test_only_empty_files(spark, tmp_path):
    from seqwatch.sources.cases import read_cases_by_header

    (tmp_path / "a.csv").write_text("")
    found = read_cases_by_header(spark, str(tmp_path))
    assert found.rows.collect() == [] and found.rejected.collect() == [] and [n for n, _ in found.rows.dtypes][:2] == ["ANO", "SEXO"]
