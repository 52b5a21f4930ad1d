import random

import pytest

from seqwatch.operators import order
from seqwatch.sinks.fasta import write_combined
from seqwatch.sources.cases import read_cases
from seqwatch.sources.fasta import read_fasta, read_fasta_entries, read_folder_entries

COLUMNS = {"n": "int", "dept": "string"}


@pytest.fixture
def files(tmp_path):
    """Files of different lengths, one of them without rows, whose names are not in the order of their sizes."""
    rng, rows = random.Random(1), []
    for name, n in (("a", 40), ("b", 700), ("c", 0), ("d", 3), ("e", 300)):
        mine = [(len(rows) + i, rng.choice(["ANTIOQUIA", "bogotá", "", "NA", "x, y", "Cauca"])) for i in range(n)]
        rows += mine
        lines = [f'{i},"{d}"' if "," in d else f"{i},{d}" for i, d in mine]
        (tmp_path / f"{name}.csv").write_text("\n".join(["n,dept", *lines]) + "\n")
    return str(tmp_path), rows


@pytest.mark.parametrize("split", ["64", "1000", "100m"])
def test_rows_have_their_numbers_whatever_the_split(spark, files, split):
    path, rows = files
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        numbered = order.with_row_numbers(read_cases(spark, path, COLUMNS)).collect()
        assert [r.n for r in sorted(numbered, key=lambda r: r.row)] == [i for i, _ in rows]
        assert sorted(r.row for r in numbered) == list(range(len(rows)))
        first = order.distinct_in_order(read_cases(spark, path, COLUMNS), "dept", True).collect()
        seen = dict.fromkeys(None if d in ("", "NA") else d for _, d in rows)
        assert [r.dept for r in first] == list(seen)
        listed = spark.read.text(path).inputFiles()
        for n in (0, 1, 6, 45, 800, 5000):
            head = order.first_rows(lambda some: read_cases(spark, list(some), COLUMNS), listed, n).collect()
            assert [(r.row, r.n) for r in head] == [(i, i) for i in range(min(n, len(rows)))]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_the_head_looks_at_few_files(spark, files):
    path, _ = files
    listed, asked = spark.read.text(path).inputFiles(), []
    order.first_rows(lambda some: asked.append(len(some)) or read_cases(spark, list(some), COLUMNS), listed, 6).collect()
    assert asked == [1]


def test_more_blocks_than_are_broadcast(spark, files, monkeypatch):
    monkeypatch.setattr(order, "MOST_BROADCAST", 0)
    path, rows = files
    numbered = order.with_row_numbers(read_cases(spark, path, COLUMNS)).collect()
    assert [r.n for r in sorted(numbered, key=lambda r: r.row)] == [i for i, _ in rows]


@pytest.mark.parametrize("split", ["100", "5000", "100m"])
@pytest.mark.parametrize("whole", [False, True])
def test_merged_text_is_in_the_order_of_the_files(spark, tmp_path, split, whole):
    source = tmp_path / "in"
    source.mkdir()
    expected = []
    for name, n in (("z", 5), ("b", 300), ("a", 60), ("empty", 0)):
        entries = [f">{name}{i}\n{'ACGT' * (i % 30)}" for i in range(n)]
        (source / f"{name}.fasta").write_text("\n".join(entries) + "\n")
    for name, n in (("a", 60), ("b", 300), ("z", 5)):
        expected += [f"{name}{i}" for i in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        out = str(tmp_path / "out")
        for _ in range(2):
            write_combined(read_folder_entries(spark, str(source), whole_files=whole), out)
        parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
        text = "".join(p.read_text() for p in parts)
        assert [line[1:] for line in text.splitlines() if line.startswith(">")] == expected
        assert {r.id for r in read_fasta(spark, out).collect()} == set(expected)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_merging_moves_no_text(spark, tmp_path, monkeypatch):
    """Above the text there is no exchange but of the counts; the order by sorting has one."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(">a\nAC\n>b\nGT\n")
    plans = []
    from seqwatch.sinks import fasta as sink

    monkeypatch.setattr(sink, "write_line_files", lambda lines, *a, **k: plans.append(lines._jdf.queryExecution().executedPlan().toString()))
    write_combined(read_fasta_entries(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    kept = plans[0]
    # Every exchange of rows is below an aggregate's final step or a window of the counts.
    assert "rangepartitioning" not in kept
    exchanges = [line for line in kept.splitlines() if "Exchange hashpartitioning" in line or "Exchange SinglePartition" in line]
    assert exchanges and all("source_file" in line or "SinglePartition" in line for line in exchanges)
    assert not any("entry" in line for line in exchanges)


def test_filtered_entries_keep_their_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.fasta").write_text("".join(f">{name}{i}\nAC\n" for i in range(50)))
    entries = read_fasta_entries(spark, str(tmp_path / "in")).where("entry like '%5%'")
    write_combined(entries, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [line[1:] for line in text.splitlines() if line.startswith(">")] == [f"{name}{i}" for name in "ab" for i in range(50) if "5" in str(i)]
