"""Archive pages as WARC records, read the archives back, and merge their indexes.

Every archive yields a run: its captures sorted by URL key and timestamp. Runs are cut at the same keys, and
each range is merged from the runs' slices by a loser tree, so that the ranges in turn hold all captures
in one order.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from seqwatch.llm.common import carried, store
from seqwatch.session import scratch_path

#: Payloads of fewer bytes are always kept in full.
LEAST_SHARED = 1000
#: Records of an archive file.
PER_FILE = 2000
#: Captures of a range that is merged at once.
PER_RANGE = 100_000
#: Pages without a time of their own are dated by their id, from here on.
EPOCH = 1_704_067_200

# The record layout of WARC 1.1.
VERSION = "WARC/1.1"
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

CAPTURE = (
    "url_key string, captured string, page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, archive string, offset bigint"
)
ORDER = ["url_key", "captured", "page_id", "archive", "offset"]


def capture_histories(pages: DataFrame) -> DataFrame:
    """Archive the pages (page_id, url, html) in the shared folder and return the merged index of the archives.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured,
    position (0 onwards in order of URL key, timestamp and page, without gaps). A null html is an empty
    payload, a null url has an empty key, a null page_id the smallest. Rows that are repeated in id and payload are each
    archived; the index lists the first as the response and the others as its revisits. An empty table
    gives an empty index. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_archives(pages, folder)
    return merge_indexes(read_archives(spark, folder))


def url_key(url: Column) -> Column:
    """Host labels from the top down, then path and query: ``com,example)/a?b``. Scheme, www, port and fragment go."""
    plain = F.lower(F.coalesce(url, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(plain, r"#.*$", ""), r"^[a-z][a-z0-9+.-]*://(www\d*\.)?", "")
    host = F.regexp_extract(plain, r"^([^/?:]*)", 1)
    rest = F.regexp_replace(plain, r"^[^/?:]*(:\d*)?", "")
    return F.when(plain == "", "").otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    )


def write_archives(pages: DataFrame, folder: str, per_file: int = PER_FILE) -> None:
    """Write one record per page. Of equal payloads of ``LEAST_SHARED`` bytes or more only that of the largest page_id is kept."""
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumns(
        {"payload_digest": F.sha1(F.col("payload").cast("binary")), "payload_bytes": F.octet_length("payload").cast("long")}
    )
    # Only payloads met more than once need their response looked up; stored, so that a join can split a digest that many pages share.
    shared = keyed.where(F.col("payload_bytes") >= LEAST_SHARED).groupBy("payload_digest")
    shared = shared.agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    typed = keyed.join(store(shared, "warc-shared"), "payload_digest", "left")
    revisits = (F.col("payload_bytes") >= LEAST_SHARED) & ~F.col("page_id").eqNullSafe(F.col("response")) & F.col("response").isNotNull()
    typed = typed.withColumn("revisits", revisits)

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    def when_revisit(value: Column) -> Column:
        return F.when(F.col("revisits"), value)

    block = F.when(F.col("revisits"), F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), "payload"))
    record = F.concat(
        F.lit(VERSION + CRLF),
        header("WARC-Type", F.when(F.col("revisits"), "revisit").otherwise("response")),
        header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        header("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        header("WARC-Date", _captured(F.col("page_id"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        header("WARC-Profile", when_revisit(F.lit(REVISIT_PROFILE))),
        header("WARC-Refers-To", when_revisit(F.concat(F.lit("<urn:page:"), F.col("response").cast("string"), F.lit(">")))),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )
    # A record ends with two line ends, which is what the writer sets between values.
    typed.select(record.alias("value")).write.option("maxRecordsPerFile", per_file).text(
        folder, compression="gzip", lineSep=CRLF + CRLF
    )


def _captured(page_id: Column) -> Column:
    seconds = F.lit(EPOCH) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(10**9))
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of every archive, sorted within it: run, place and the columns of CAPTURE. Payloads are held against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(folder)
    captures = files.select("path", "content").mapInPandas(_parse_files, CAPTURE)
    keyed = captures.withColumn("url_key", url_key(F.col("url")))
    runs = store(keyed, "warc-captures")
    order = Window.partitionBy("archive").orderBy(*ORDER)
    return runs.withColumn("place", F.row_number().over(order) - 1)


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows = list(records(gzip.decompress(content)))
            for row in rows:
                row["archive"] = path.rsplit("/", 1)[-1]
            names = [column.split()[0] for column in CAPTURE.split(", ")]
            kinds = {"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64", "offset": "Int64"}
            # Long numbers with nulls among them must not become doubles on the way.
            yield pd.DataFrame({name: pd.array([row[name] for row in rows], dtype=kinds.get(name, "object")) for name in names})


def records(archive: bytes) -> Iterator[dict]:
    """The captures in an archive."""
    at, end = 0, len(archive)
    line_end = CRLF.encode()
    while at < end:
        stop = archive.index(line_end * 2, at)
        lines = archive[at:stop].decode().split(CRLF)
        if lines[0] != VERSION:
            raise ValueError(f"no WARC record at {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        begin = stop + 4
        block = archive[begin : begin + int(fields["Content-Length"])]
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response":
            payload = block[block.index(line_end * 2) + 4 :]
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"damaged payload at {at}")
        yield {
            "url_key": None, "captured": fields["WARC-Date"], "page_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"),
            "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": _page(fields.get("WARC-Refers-To", "<urn:page:>")), "offset": at,
        }
        at = begin + len(block) + 4


def _page(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def merge_indexes(runs: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """All captures of the runs in one order, numbered by ``position``."""
    runs = store(runs, "warc-runs")
    n_ranges = max(1, -(-runs.count() // per_range))
    dealt = runs.repartitionByRange(n_ranges, *ORDER).sortWithinPartitions("archive", "place")
    ids = ("page_id", "refers_to")
    dealt = dealt.withColumns({name: F.coalesce(carried(F.col(name)), F.lit("")) for name in ids})
    merged = dealt.mapInPandas(_merge_range, f"{CAPTURE}, place bigint".replace("page_id bigint", "page_id string").replace("refers_to bigint", "refers_to string"))
    merged = merged.withColumns({name: F.when(F.col(name) != "", F.col(name)).cast("long") for name in ids})
    merged = store(merged.withColumn("range", F.spark_partition_id()), "warc-merged")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # one row per range
    starts = starts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = merged.join(F.broadcast(starts), "range").withColumn("position", F.col("start") + F.col("place"))

    # Rows repeated in id and payload: the first response stays one, the others revisit it.
    again = Window.partitionBy("payload_digest", "page_id", "record_type").orderBy("position")
    repeated = (F.col("record_type") == "response") & (F.col("payload_bytes") >= LEAST_SHARED) & (F.row_number().over(again) > 1)
    placed = placed.withColumn("repeated", repeated)
    return placed.select(
        "page_id", "payload_bytes", "payload_digest",
        F.when(F.col("repeated"), "revisit").otherwise(F.col("record_type")).alias("record_type"),
        F.when(F.col("repeated"), F.col("page_id")).otherwise(F.col("refers_to")).alias("refers_to"),
        "url_key", "captured", "position",
    )


def _merge_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge the slices of the runs, which come one after another, and number the captures."""
    rows = pd.concat(list(batches), ignore_index=True)
    if rows.empty:
        return
    sortable = rows[ORDER].assign(page_id=[int(x) if x else -1 for x in rows["page_id"].fillna("")], known=rows["page_id"] != "")
    sortable = sortable[["url_key", "captured", "known", "page_id", "archive", "offset"]]
    keys = list(sortable.itertuples(index=False, name=None))
    begins = [0, *[i for i in range(1, len(rows)) if rows["archive"].iat[i] != rows["archive"].iat[i - 1]], len(rows)]
    order = list(loser_tree([range(a, b) for a, b in zip(begins, begins[1:], strict=False)], keys))
    merged = rows.iloc[order].reset_index(drop=True)
    merged["place"] = range(len(merged))
    yield merged


def loser_tree(runs: list[range], keys: list[tuple]) -> Iterator[int]:
    """The indexes of the runs in order of their keys.

    Each inner node holds the run that lost there; a run's next key climbs from its leaf to the root and
    changes places with every loser that beats it.
    """
    k = len(runs)
    heads = [iter(run) for run in runs]
    current: list[int | None] = [next(head, None) for head in heads]

    def beats(one: int, other: int) -> bool:
        if current[one] is None or current[other] is None:
            return current[one] is not None
        return keys[current[one]] < keys[current[other]]

    winner_of = [0] * k + list(range(k))
    losers = [0] * k
    for node in range(k - 1, 0, -1):
        one, other = winner_of[2 * node], winner_of[2 * node + 1]
        winner_of[node], losers[node] = (one, other) if beats(one, other) else (other, one)
    winner = winner_of[1] if k > 1 else 0
    while current[winner] is not None:
        yield current[winner]
        current[winner] = next(heads[winner], None)
        node = (winner + k) // 2
        while node >= 1:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
