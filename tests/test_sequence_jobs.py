import pytest
from pyspark.sql import functions as F

from seqwatch.functions.sequences import SEROTYPE_PHRASES
from seqwatch.operators import sequences as ops
from seqwatch.plans.curation import curate, filter_fasta, purge_by_serotype, purge_folder, purge_records
from seqwatch.sinks.tables import write_kept
from seqwatch.sources.fasta import read_fasta, records_of_documents

TEXTS = ["ACGTacgt", "ACGN", "AC-R", "acgn", "", "ACGR", "AC-G", "acu"]


@pytest.fixture
def records(spark):
    rows = [(f"r{i}", f"r{i} x", text) for i, text in enumerate(TEXTS)] + [("none", "none", None)]
    return spark.createDataFrame(rows, "id string, description string, sequence string").repartition(3)


def ids(frame):
    return sorted(row.id for row in frame.collect())


def test_threshold_is_inclusive(records):
    assert ids(ops.filter_ambiguous(records)) == ["r0"]
    assert ids(ops.filter_ambiguous(records, 0.25)) == ["r0", "r1", "r3", "r5", "r6"]
    assert ids(ops.filter_ambiguous(records, 1.0)) == [f"r{i}" for i in range(8) if TEXTS[i]]


def test_kept_sets_grow_with_the_threshold(records):
    kept = [set(ids(ops.filter_ambiguous(records, share / 10))) for share in range(11)]
    assert all(small <= large for small, large in zip(kept, kept[1:]))


def test_counts_add_up(records):
    row = ops.ambiguity_stats(records, 0.25).first()
    assert tuple(row) == (9, 5, 4, 1)
    row = ops.purge_stats(records).first()
    assert tuple(row) == (9, 4, 5)


def test_purge_keeps_other_ambiguity_codes(records):
    assert ids(ops.purge(records)) == ["r0", "r4", "r5", "r7"]


def test_purged_records_are_dna(records):
    kept, stats = purge_records(records)
    assert {row.id: (row.sequence, row.n_non_dna) for row in kept.collect()} == {
        "r0": ("ACGTACGT", 0), "r4": ("", 0), "r5": ("ACGR", 0), "r7": ("AC", 1),
    }
    assert tuple(stats.first()) == (9, 4, 5)


def fasta(folder, name, pairs):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(f">{header}\n{text}\n" for header, text in pairs))


@pytest.mark.parametrize("whole_files", [False, True])
def test_purge_folder(spark, tmp_path, whole_files):
    fasta(tmp_path / "in", "a.fasta", [("A one", "acgt" * 30), ("B", "ACNT")])
    fasta(tmp_path / "in", "b.fasta", [("C", "AC-T"), ("D", "ACRT")])
    stats = purge_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), whole_files=whole_files)
    assert tuple(stats.first()) == (4, 2, 2)
    text = "".join(part.read_text() for part in sorted((tmp_path / "out").glob("part-*")))
    assert sorted(text.split(">")) == ["", "A one\n" + "ACGT" * 20 + "\n" + "ACGT" * 10 + "\n", "D\nACRT\n"]


def test_filter_fasta(spark, tmp_path):
    fasta(tmp_path / "in", "a.FASTA", [("A one", "acgt" * 20), ("B", "ACNT"), ("C", ""), ("D", "A" * 19 + "R")])
    stats = filter_fasta(spark, str(tmp_path / "in"), str(tmp_path / "out"), 0.05)
    assert tuple(stats.first()) == (4, 2, 2, 1)
    text = "".join(part.read_text() for part in sorted((tmp_path / "out").glob("part-*")))
    assert text == ">A one\n" + "acgt" * 15 + "\n" + "acgt" * 5 + "\n>D\n" + "A" * 19 + "R\n"


@pytest.mark.parametrize("whole_files", [False, True])
def test_notes_in_front_are_not_counted(spark, tmp_path, whole_files):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text("; comment\n>a\nACGT\n>\n>b\nAN\n")
    assert tuple(purge_folder(spark, str(tmp_path / "in"), str(tmp_path / "p"), whole_files=whole_files).first()) == (3, 2, 1)
    stats = filter_fasta(spark, str(tmp_path / "in"), str(tmp_path / "f"), whole_files=whole_files)
    assert tuple(stats.first()) == (3, 1, 2, 1)


def test_empty_input_is_the_same_for_both_jobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text("")
    assert tuple(purge_folder(spark, str(tmp_path / "in"), str(tmp_path / "p")).first()) == (0, 0, 0)
    assert tuple(filter_fasta(spark, str(tmp_path / "in"), str(tmp_path / "f")).first()) == (0, 0, 0, 0)


def test_the_output_of_a_purge_can_be_purged(spark, tmp_path):
    fasta(tmp_path / "in", "a.fasta", [("A one", "acgt"), ("B", "ACNT")])
    purge_folder(spark, str(tmp_path / "in"), str(tmp_path / "one"))
    assert tuple(purge_folder(spark, str(tmp_path / "one"), str(tmp_path / "two")).first()) == (1, 1, 0)


def test_purge_by_serotype(spark, tmp_path):
    kept = spark.createDataFrame(
        [("1", "DENV1", ">1 a\nACGT\n>1b\nANN\n"), ("2", "DENV2", "note\n>2\nAC\nGT"), ("3", "DENV2", ">3\nA-"), ("4", "DENV2", None)],
        "id string, serotype string, body string",
    )
    stats = purge_by_serotype(kept, str(tmp_path / "out"))
    assert sorted(map(tuple, stats.collect())) == [("DENV1", 2, 1, 1), ("DENV2", 2, 1, 1), ("DENV3", 0, 0, 0), ("DENV4", 0, 0, 0)]
    back = read_fasta(spark, [str(tmp_path / "out" / f"serotype={s}") for s in ("DENV1", "DENV2")])
    assert sorted((row.description, row.sequence) for row in back.collect()) == [("1 a", "ACGT"), ("2", "ACGT")]


def test_one_pass_over_the_rules_equals_one_set_per_serotype(spark):
    docs = spark.createDataFrame(
        [(1, "DENV2 complete genome"), (2, "Orthoflavivirus denguei complete cds"), (3, "DENV4 partial"), (4, None)],
        "n int, body string",
    )
    together = ops.match_serotypes(docs)
    apart = ops.union_collections(*[ops.keep_serotype(docs, label) for label in SEROTYPE_PHRASES])
    pairs = sorted((row.n, row.serotype) for row in together.collect())
    assert pairs == sorted((row.n, row.serotype) for row in apart.collect())
    assert pairs == [(1, "DENV2"), (2, "DENV1"), (2, "DENV2"), (2, "DENV3"), (2, "DENV4")]
    assert {row.n: row.n_serotypes for row in together.collect()} == {1: 1, 2: 4}


def test_classify(spark):
    docs = spark.createDataFrame([(1, "DENV2 complete genome"), (2, "Zika"), (3, None)], "n int, body string")
    assert {row.n: row.outcome for row in ops.classify(docs, "DENV2").collect()} == {1: "included", 2: "excluded", 3: "errors"}


def test_kept_documents_by_serotype_can_be_purged_in_turn(spark, tmp_path):
    log = [("1", 1, 200, ">1 DENV2, complete genome\nACGT\nAC\n"), ("2", 1, 200, ">2 DENV2, complete cds\nACNT\n")]
    kept = curate(spark.createDataFrame(log, "id string, attempt int, status int, body string")).kept
    write_kept(kept, str(tmp_path / "kept"))
    back = spark.read.parquet(str(tmp_path / "kept")).where("serotype = 'DENV2'")
    assert sorted(row.id for row in back.collect()) == ["1", "2"]
    kept, stats = purge_records(records_of_documents(back))
    assert [row.sequence for row in kept.collect()] == ["ACGTAC"]
    assert tuple(stats.first()) == (2, 1, 1)
    assert back.agg(F.count_if(F.col("body").isNull())).first()[0] == 0
