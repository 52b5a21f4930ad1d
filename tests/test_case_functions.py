import datetime

from pyspark.sql import functions as F

from seqwatch.functions import cases



def test_blank_to_null(values):
    assert values(["", " ", "x", None], "string", lambda v: cases.blank_to_null(v)) == [None, " ", "x", None]


def test_age_groups_take_the_first_match(values):
    ages = [None, -1.0, 5.0, 5.5, 17.0, 60.0, 60.5, float("nan")]
    assert values(ages, "double", lambda v: cases.age_group(v)) == [
        "60+ years", "0-5 years", "0-5 years", "6-17 years", "6-17 years", "18-60 years", "60+ years", "60+ years",
    ]


def test_missing_age_can_have_its_own_group(values):
    assert values([None, 61.0], "double", lambda v: cases.age_group(v, "unknown")) == ["unknown", "60+ years"]


def test_names_are_trimmed_of_all_blanks_and_upper_cased(values):
    names = ["\t Antioquia \r\n", "antioquia", "bogotá", "norte  de santander", "", None]
    assert values(names, "string", lambda v: cases.normalise_name(v)) == [
        "ANTIOQUIA", "ANTIOQUIA", "BOGOTÁ", "NORTE  DE SANTANDER", "", None,
    ]


def test_dates(values):
    day = datetime.date(2010, 1, 2)
    texts = {
        "2010-01-02": day,
        "2010-01-02 00:00:00": day,
        "2010-01-02T10:00": day,
        "2010-1-2": day,
        " 2010- 1- 2": day,
        "2010-1-021": day,
        "2010-02-30": None,
        "2010-13-01": None,
        "2010-25-01": None,
        "2010-03-32": None,
        "2010-3-45": datetime.date(2010, 3, 4),
        "2010-00-01": None,
        "02/01/2010": None,
        "x2010-01-02": None,
        "20100-01-02": None,
        "987-1-2": datetime.date(987, 1, 2),
        "10-01-02": datetime.date(10, 1, 2),
        "2010-01": None,
        "": None,
        None: None,
    }
    assert values(list(texts), "string", lambda v: cases.parse_date(v)) == list(texts.values())


def test_year(values):
    assert values(["2010-01-02", "junk"], "string", lambda v: cases.year_of(cases.parse_date(v))) == [2010, None]


def test_sex_labels(values):
    assert values(["M", "F", "I", "", None], "string", lambda v: cases.sex_label(v)) == ["Male", "Female", "I", "", None]


def test_rescale(values):
    assert values([2, 6, 10, None], "bigint", lambda v: cases.rescale(v, F.lit(2), F.lit(10))) == [0.0, 0.5, 1.0, None]
    assert values([4, None], "bigint", lambda v: cases.rescale(v, F.lit(4), F.lit(4))) == [0.5, None]
