import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from seqwatch.operators.fetches import first_success, pages_before_cutoff
from seqwatch.plans.curation import curate_search, fetch_and_curate
from seqwatch.sources import transport as transports
from seqwatch.sources.remote import fetch_documents, land_documents, land_replies, land_search, read_search_pages
from seqwatch.sources.search import count_ids
from seqwatch.sources.transport import HttpTransport, Reply, request, transport_of

ACCEPTED = ">x DENV2, complete genome\nACGT"


def page(*ids):
    return json.dumps({"esearchresult": {"idlist": list(ids)}})


#: kind, key, attempt, status, body
REPLIES = [
    ("search", "0", 1, 200, page("a", "b")),
    ("search", "100", 1, 503, None),
    ("search", "100", 2, None, None),
    ("search", "100", 3, 200, page("b", "c", "é\n")),
    ("search", "200", 1, 200, page()),
    ("search", "300", 1, 200, page("never")),
    ("fetch", "a", 1, 200, ACCEPTED),
    ("fetch", "b", 4, 200, ">y Zika\nAC"),
    ("fetch", "b", 2, 500, "a page about the error"),
    ("fetch", "c", 6, 200, "too late"),
    ("fetch", "é\n", 1, 200, ""),
]


@pytest.fixture(scope="module")
def replies(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("replies") / "landed")
    land_replies(spark.createDataFrame(REPLIES, "kind string, key string, attempt int, status int, body string"), path, 4)
    return {"transport": "folder", "replies": path, "buckets": "4", "pause": "0"}


class Flaky:
    def __init__(self, *replies):
        self.replies, self.asked = list(replies), []

    def get(self, kind, key, attempt):
        self.asked.append((kind, key, attempt))
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply


def test_tries_and_pauses():
    waits = []
    flaky = Flaky(Reply(503, "busy"), OSError("secret address"), Reply(200, "text"))
    assert request(flaky, "fetch", "7", 5, 3.0, waits.append) == (3, 200, "text", None)
    assert flaky.asked == [("fetch", "7", n) for n in (1, 2, 3)] and waits == [3.0, 6.0]
    waits.clear()
    answer = request(Flaky(*[OSError("secret address")] * 5), "fetch", "7", 5, 3.0, waits.append)
    assert answer == (5, None, None, "OSError") and waits == [3.0, 6.0, 9.0, 12.0]
    assert request(Flaky(*[Reply(404, "no such thing")] * 2), "fetch", "7", 2, 0.0) == (2, 404, None, "no success")


def test_addresses(monkeypatch):
    asked = []

    class Answer(io.BytesIO):
        status = 200

    def urlopen(address, timeout):
        asked.append((address, timeout))
        if "missing" in address:
            raise urllib.error.HTTPError(address, 404, "not found", None, None)
        return Answer("dé".encode())

    monkeypatch.setattr(transports.urllib.request, "urlopen", urlopen)
    http = HttpTransport({"fetch_url": "https://example.org/fetch?id={key}&k=1", "timeout": "5"})
    assert http.get("fetch", "a b&c", 1) == Reply(200, "dé")
    assert asked == [("https://example.org/fetch?id=a%20b%26c&k=1", 5.0)]
    assert http.get("fetch", "missing", 1) == Reply(404, None, "HTTPError")
    with pytest.raises(ValueError):
        http.get("search", "0", 1)


def test_transports_by_name():
    assert isinstance(transport_of({"transport": "seqwatch.sources.transport:HttpTransport"}), HttpTransport)
    with pytest.raises(ValueError):
        transport_of({"transport": "pigeon"})


def test_pages(spark, replies):
    frame = read_search_pages(spark, 5, **replies)
    assert frame.rdd.getNumPartitions() == 5
    rows = {r.retstart: (r.attempt, r.status, r.body is not None, r.error) for r in frame.collect()}
    assert rows == {0: (1, 200, True, None), 100: (3, 200, True, None), 200: (1, 200, True, None), 300: (1, 200, True, None), 400: (5, None, False, "no reply")}
    assert read_search_pages(spark, 5, pages_per_task=2, **replies).rdd.getNumPartitions() == 3
    assert [r.retstart for r in read_search_pages(spark, 2, first=200, **replies).orderBy("retstart").collect()] == [200, 300]


@pytest.mark.parametrize("first_pages", [1, 2, 3, 64])
def test_search_until_an_empty_page(spark, replies, tmp_path, first_pages):
    landed = land_search(spark, str(tmp_path / "pages"), first_pages, **replies)
    pages = landed.select("retstart", count_ids(F.col("body")).alias("n_ids"))
    assert {r.retstart: r.n_ids for r in pages_before_cutoff(pages).collect()} == {0: 2, 100: 3}
    # What has landed isn't asked for again.
    broken = {**replies, "replies": str(tmp_path / "nowhere")}
    assert land_search(spark, str(tmp_path / "pages"), first_pages, **broken).count() == landed.count()


def test_documents(spark, replies):
    ids = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("é\n",), (None,), ("unknown",)], "id string")
    rows = {r.id: (r.attempt, r.status, r.body, r.error) for r in fetch_documents(ids, 3, **replies).collect()}
    assert rows == {
        "a": (1, 200, ACCEPTED, None), "b": (4, 200, ">y Zika\nAC", None), "c": (5, None, None, "no reply"), "é\n": (1, 200, "", None),
        "unknown": (5, None, None, "no reply"),
    }
    assert fetch_documents(ids.limit(0), **replies).collect() == []
    log = spark.createDataFrame([r[1:] for r in REPLIES if r[0] == "fetch"], "id string, attempt int, status int, body string")
    logged = {r.id: (r.attempt, r.body) for r in first_success(log).collect()}
    fetched = {r.id: (r.attempt, r.body) for r in first_success(fetch_documents(ids, **replies)).collect()}
    assert {key: value for key, value in fetched.items() if key != "unknown"} == logged and fetched["unknown"] == (None, None)


def test_landed_documents_are_not_asked_for_again(spark, replies, tmp_path):
    path = str(tmp_path / "documents")
    ids = spark.createDataFrame([("a",), ("c",)], "id string")
    assert {r.id for r in land_documents(ids, path, **replies).collect()} == {"a", "c"}
    more = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert sorted(r.id for r in land_documents(more, path, **replies).collect()) == ["a", "b", "c"]
    patient = {**replies, "max_attempts": "6"}
    assert sorted(r.id for r in land_documents(more, path, again=True, **patient).collect()) == ["a", "b", "c", "c"]
    assert {r.id: r.body for r in first_success(spark.read.parquet(path), max_attempts=6).collect()}["c"] == "too late"


def test_the_whole_job(spark, replies, tmp_path):
    responses = spark.createDataFrame([(int(key), body) for kind, key, _, status, body in REPLIES if kind == "search" and status == 200], "retstart bigint, body string")
    log = spark.createDataFrame([r[1:] for r in REPLIES if r[0] == "fetch"], "id string, attempt int, status int, body string")
    expected, found = curate_search(responses, log), fetch_and_curate(spark, str(tmp_path / "job"), **replies)
    assert sorted(found.stats.collect()) == sorted(expected.stats.collect())
    assert sorted(found.kept.collect()) == sorted(expected.kept.collect()) and {r.serotype for r in found.kept.collect()} == {"DENV2"}


def test_ids_of_one_place_are_asked_for_together(spark, tmp_path):
    """Short ids are still dealt over the tasks, and none of them reads a file of replies twice."""
    keys = [str(i) for i in range(400)]
    land_replies(spark.createDataFrame([("fetch", key, 1, 200, f"body {key}") for key in keys], "kind string, key string, attempt int, status int, body string"), str(tmp_path / "r"), 16)
    options = {"transport": "folder", "replies": str(tmp_path / "r"), "buckets": "16", "pause": "0"}
    rows = fetch_documents(spark.createDataFrame([(key,) for key in keys * 2], "id string"), **options).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((row.id, row.body) for row in rows) == sorted((key, f"body {key}") for key in keys)
    met = [(row.task, transports.bucket_of("fetch", row.id, 16)) for row in rows]
    assert len({task for task, _ in met}) > 1
    changes = [pair for i, pair in enumerate(met) if i == 0 or pair != met[i - 1]]
    assert len(changes) == len({bucket for _, bucket in met}) == 16
