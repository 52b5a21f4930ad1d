import random

import pytest

from seqwatch.operators.fetches import first_success, number_attempts, pages_before_cutoff, search_cutoff
from seqwatch.plans.curation import curate, curate_search, curate_to_folder

LOG = [
    ("first", 1, 200, "a"),
    ("first", 2, 200, "later"),
    ("fifth", 1, 503, None),
    ("fifth", 2, None, None),
    ("fifth", 5, 200, "b"),
    ("sixth", 5, 500, None),
    ("sixth", 6, 200, "too late"),
    ("never", 1, None, None),
]


def log(spark, rows=LOG):
    return spark.createDataFrame(rows, "id string, attempt int, status int, body string")


def test_first_success(spark):
    rows = {row.id: (row.attempt, row.body) for row in first_success(log(spark)).collect()}
    assert rows == {"first": (1, "a"), "fifth": (5, "b"), "sixth": (None, None), "never": (None, None)}


def test_a_try_that_is_logged_again_counts_once(spark):
    rows = LOG + [("first", 1, 200, "a"), ("first", 1, 200, "a"), ("fifth", 5, 200, "other"), ("fifth", 5, 503, None), ("never", 1, None, None), ("none", 1, 200, None)]
    rows += [("none", 1, 200, None), ("odd", None, 200, "x"), ("odd", -1, 200, "y"), (None, 1, 200, "z")]
    found = first_success(log(spark, rows)).collect()
    by_id = {row.id: (row.attempt, row.body) for row in found}
    assert len(found) == len(by_id) == 6
    assert by_id["first"] == (1, "a") and by_id["fifth"][0] == 5 and by_id["fifth"][1] in ("b", "other") and by_id["none"] == (1, None)
    assert by_id["never"] == by_id["odd"] == (None, None)
    again = {row.id: row.body for row in first_success(log(spark, rows[::-1]).repartition(3)).collect()}
    assert again == {key: body for key, (_, body) in by_id.items()}
    stats = {row.serotype: (row.included, row.excluded, row.errors) for row in curate(log(spark, rows)).stats.collect()}
    # Two of the six ids have a document, which no rule accepts.
    assert stats["DENV1"] == (0, 2, 4)


def test_attempt_numbers_have_a_limit(spark):
    with pytest.raises(ValueError):
        first_success(log(spark), max_attempts=20_000)


def test_attempt_limit(spark):
    rows = {row.id: row.body for row in first_success(log(spark), max_attempts=6).collect()}
    assert rows["sixth"] == "too late"


def test_attempts_are_numbered_in_time_order(spark):
    rows = [(key, second, second) for key in ("a", "b") for second in random.Random(1).sample(range(100), 20)]
    frame = spark.createDataFrame(rows, "id string, ts int, tag int")
    kept = number_attempts(frame, ["ts"]).collect()
    for key in ("a", "b"):
        times = sorted(ts for k, ts, _ in rows if k == key)[:5]
        assert sorted((row.attempt, row.ts) for row in kept if row.id == key) == list(enumerate(times, 1))


@pytest.mark.parametrize(
    ("pages", "used"),
    [
        ([(0, 2), (100, 1), (200, 0), (300, 5)], [0, 100]),
        ([(0, 2), (100, None), (200, 3)], [0]),
        ([(0, 0), (100, 5)], []),
        ([(0, 2), (100, 1)], [0, 100]),
        ([(0, 2), (200, 1)], [0]),
        ([(100, 2), (200, 1)], []),
        ([(0, 0), (0, 3), (100, 2)], [0, 0, 100]),
        ([], []),
    ],
    ids=["empty page", "failed page", "first empty", "none empty", "page never landed", "first never landed", "tried again", "no pages"],
)
def test_pages_up_to_the_first_empty_one(spark, pages, used):
    frame = spark.createDataFrame(pages, "retstart int, n_ids int")
    assert sorted(row.retstart for row in pages_before_cutoff(frame).collect()) == used


def test_searches_are_cut_separately(spark):
    rows = [("x", 0, 2), ("x", 100, 0), ("x", 200, 1), ("y", 0, 1), ("y", 100, 4), ("z", 0, 0)]
    frame = spark.createDataFrame(rows, "term string, retstart int, n_ids int")
    assert sorted(map(tuple, search_cutoff(frame, by=["term"]).collect())) == [("x", 100), ("y", 200), ("z", 0)]
    kept = pages_before_cutoff(frame, by=["term"])
    assert kept.columns == ["term", "retstart", "n_ids"]
    assert sorted(map(tuple, kept.collect())) == [("x", 0, 2), ("y", 0, 1), ("y", 100, 4)]


DOCS = [
    ("1", 1, 200, ">1 DENV2, complete genome\nACGT"),
    ("2", 1, 200, ">2 Orthoflavivirus denguei, complete cds\nACGT"),
    ("3", 1, 200, ">3 Zika virus, complete genome\nACGT"),
    ("4", 1, 503, None),
    ("5", 1, 503, None),
    ("5", 2, 200, ">5 Zika virus\nACGT"),
    ("5", 3, 200, ">5 DENV2, complete genome\nACGT"),
]


def test_curation(spark):
    kept, stats = curate(log(spark, DOCS))
    assert sorted((row.id, row.serotype) for row in kept.collect()) == [
        ("1", "DENV2"), ("2", "DENV1"), ("2", "DENV2"), ("2", "DENV3"), ("2", "DENV4"),
    ]
    assert {row.serotype: (row.included, row.excluded, row.errors) for row in stats.collect()} == {
        "DENV1": (1, 3, 1), "DENV2": (2, 2, 1), "DENV3": (1, 3, 1), "DENV4": (1, 3, 1),
    }


def test_curation_of_a_search_counts_every_listing(spark):
    pages = [
        (0, '{"esearchresult":{"idlist":["1","2","missing"]}}'),
        (100, '{"esearchresult":{"idlist":["1","4"]}}'),
        (200, '{"esearchresult":{"idlist":[]}}'),
        (300, '{"esearchresult":{"idlist":["3"]}}'),
    ]
    responses = spark.createDataFrame(pages, "retstart int, body string")
    kept, stats = curate_search(responses, log(spark, DOCS), {"DENV2": ("DENV2",)})
    assert [tuple(row) for row in kept.collect()] == [("1", "DENV2", DOCS[0][3])]
    assert [tuple(row) for row in stats.collect()] == [("DENV2", 2, 1, 2)]


def test_curation_of_nothing(spark):
    kept, stats = curate(log(spark, []))
    assert kept.count() == 0
    assert {(row.included, row.excluded, row.errors) for row in stats.collect()} == {(0, 0, 0)}


def test_curation_against_a_loop(spark):
    rng = random.Random(7)
    phrases = ["Dengue virus 1", "DENV2", "DENV-3", "Orthoflavivirus denguei", "Zika", ", complete genome", ", partial cds"]
    rows = []
    for number in range(120):
        for attempt in range(1, rng.randint(2, 8)):
            ok = rng.random() < 0.3
            body = f">{number} " + " ".join(rng.sample(phrases, rng.randint(1, 5))) + "\nACGT" if ok else None
            rows.append((str(number), attempt, 200 if ok else rng.choice([None, 503]), body))
    rng.shuffle(rows)
    accepted, errors = set(), 0
    for key in {row[0] for row in rows}:
        tries = sorted((row for row in rows if row[0] == key and row[2] == 200 and row[1] <= 5), key=lambda row: row[1])
        if not tries:
            errors += 1
            continue
        text = tries[0][3]
        if "complete genome" in text and "partial" not in text:
            accepted |= {(key, "DENV1")} if "Dengue virus 1" in text or "Ortho" in text else set()
            accepted |= {(key, "DENV2")} if "DENV2" in text or "Ortho" in text else set()
            accepted |= {(key, "DENV3")} if "DENV-3" in text or "Ortho" in text else set()
            accepted |= {(key, "DENV4")} if "Ortho" in text else set()
    kept, stats = curate(log(spark, rows).repartition(5))
    assert {(row.id, row.serotype) for row in kept.collect()} == accepted
    for row in stats.collect():
        assert row.included == sum(label == row.serotype for _, label in accepted)
        assert row.errors == errors
        assert row.included + row.excluded + row.errors == len({row[0] for row in rows})


def test_writing_counts_what_it_sees(spark, tmp_path):
    stats = curate_to_folder(log(spark, DOCS), str(tmp_path / "kept"))
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, curate(log(spark, DOCS)).stats.collect()))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    assert sorted((row.id, row.serotype) for row in kept.collect()) == [
        ("1", "DENV2"), ("2", "DENV1"), ("2", "DENV2"), ("2", "DENV3"), ("2", "DENV4"),
    ]


def test_writing_for_listings(spark, tmp_path):
    listings = spark.createDataFrame([("1",), ("1",), ("missing",), ("3",)], "id string")
    stats = curate_to_folder(log(spark, DOCS), str(tmp_path / "kept"), {"DENV2": ("DENV2",)}, listings)
    assert [tuple(row) for row in stats.collect()] == [("DENV2", 2, 1, 1)]
    assert [row.id for row in spark.read.parquet(str(tmp_path / "kept")).collect()] == ["1"]


@pytest.mark.parametrize("rows", [[], [("a", 1, 503, None)]], ids=["empty log", "failures only"])
def test_writing_nothing(spark, tmp_path, rows):
    stats = curate_to_folder(log(spark, rows), str(tmp_path / "kept"))
    assert {tuple(row)[1:] for row in stats.collect()} == {(0, 0, len(rows))}
