import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from seqwatch.plans.curation import purge_records
from seqwatch.sinks.fasta import write_combined, write_fasta
from seqwatch.sources.fasta import FILE_ORDER, read_fasta, read_fasta_entries, read_fasta_folder, read_folder_entries, records_of_documents

BOTH = pytest.mark.parametrize("whole_files", [False, True], ids=["split", "whole"])


def put(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    return str(folder)


def records(frame):
    ordered = frame.orderBy(*FILE_ORDER).select("id", "description", "sequence").collect()
    return [tuple(row) for row in ordered]


@BOTH
@pytest.mark.parametrize(
    ("text", "expected"),
    {
        "plain": (">A one\nACGT\nAC\n>B\nGG\n", [("A", "A one", "ACGTAC"), ("B", "B", "GG")]),
        "crlf": (">A one\r\nACGT\r\nAC\r\n>B\r\nGG\r\n", [("A", "A one", "ACGTAC"), ("B", "B", "GG")]),
        "marker in header": (">A x>y > z\nAC\n", [("A", "A x>y > z", "AC")]),
        "header only": (">A\n>B two\n>C\nAC\n", [("A", "A", ""), ("B", "B two", ""), ("C", "C", "AC")]),
        "blank lines": (">A\nAC\n\nGT\n\n\n>B\nGG\n\n\n", [("A", "A", "ACGT"), ("B", "B", "GG")]),
        "blanks in sequence": (">A\nAC GT\t\n A\n", [("A", "A", "ACGTA")]),
        "no final newline": (">A\nAC\n>B\nGG", [("A", "A", "AC"), ("B", "B", "GG")]),
        "no final newline, header only": (">A\nAC\n>B", [("A", "A", "AC"), ("B", "B", "")]),
        "leading blank lines": ("\n\n>A\nAC\n", [("A", "A", "AC")]),
        "blank before the id": ("> A b\nAC\n", [("A", " A b", "AC")]),
        "accents": (">ñ á\nACGT\n", [("ñ", "ñ á", "ACGT")]),
        "lower case": (">A\nacgn\n", [("A", "A", "acgn")]),
        "preamble": ("; a comment\nx > y\n>A\nAC\n", [("A", "A", "AC")]),
        "preamble and doubled marker": ("a comment\n>C\nCC\n>>D\nTT\n", [("C", "C", "CC"), (">D", ">D", "TT")]),
        "doubled marker first": (">>A\nAC\n>B\nGG\n", [(">A", ">A", "AC"), ("B", "B", "GG")]),
        "empty record in the middle": (">a\nAC\n>\n>b\nGG\n", [("a", "a", "AC"), ("", "", ""), ("b", "b", "GG")]),
        "preamble only": ("nothing here\n", []),
        "empty": ("", []),
    }.values(),
)
def test_layouts(spark, tmp_path, whole_files, text, expected):
    assert records(read_fasta(spark, put(tmp_path, a__fasta=text), whole_files=whole_files)) == expected


@BOTH
def test_many_files_of_all_layouts(spark, tmp_path, whole_files):
    """Several files share a task; each one's first piece is its own."""
    texts = ["a comment\n>A\nAC\n", ">B\nGG\n", ">C\nCC\n>>D\nTT\n", "", "\n\n>E\nAA\n", "note\nmore\n>>F\n"]
    folder = put(tmp_path, **{f"f{i:02d}__fasta": texts[i % 6] for i in range(24)})
    one_round = [("A", "A", "AC"), ("B", "B", "GG"), ("C", "C", "CC"), (">D", ">D", "TT"), ("E", "E", "AA"), (">F", ">F", "")]
    assert records(read_fasta(spark, folder, whole_files=whole_files)) == one_round * 4


def test_preamble_survives_splits(spark, tmp_path):
    """A long text before the first header spans blocks and is no record in any of them."""
    text = "".join(f"note {i}\n" for i in range(200)) + "".join(f">r{i}\nACGT\n" for i in range(100))
    folder = put(tmp_path, a__fasta=text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert records(read_fasta(spark, folder)) == [(f"r{i}", f"r{i}", "ACGT") for i in range(100)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_records_of_documents(spark):
    rows = [(1, ">A one\nAC\nGT\n>B\n"), (2, "no header"), (3, None), (4, "x\n>C\nA"), (5, "")]
    found = records_of_documents(spark.createDataFrame(rows, "doc int, body string"))
    assert found.columns == ["doc", "number", "id", "description", "sequence"]
    assert sorted(map(tuple, found.collect())) == [(1, 1, "A", "A one", "ACGT"), (1, 2, "B", "B", ""), (4, 1, "C", "C", "A")]


@pytest.mark.parametrize("split_bytes", [64, 97, 1000])
def test_records_survive_splits(spark, tmp_path, split_bytes):
    lines = [f">r{i} number {i}\n{'ACGT' * (i % 40)}\n{'GGA' * (i % 7)}\n" for i in range(600)]
    folder = put(tmp_path, a__fasta="".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        frame = read_fasta(spark, folder)
        assert frame.rdd.getNumPartitions() > 20
        expected = [(f"r{i}", f"r{i} number {i}", "ACGT" * (i % 40) + "GGA" * (i % 7)) for i in range(600)]
        assert records(frame) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


@BOTH
def test_folder_takes_fasta_files_of_this_level_in_name_order(spark, tmp_path, whole_files):
    put(tmp_path / "sub", c__fasta=">C\nCC\n")
    folder = put(tmp_path, b__fasta=">B\nGG\n", a__fasta=">A\nAC\n", x__FASTA=">X\nTT\n", notes__txt=">N\nAA\n")
    assert records(read_fasta_folder(spark, folder, whole_files=whole_files)) == [("A", "A", "AC"), ("B", "B", "GG")]


@BOTH
def test_folders_like_partitions_are_left_alone(spark, tmp_path, whole_files):
    put(tmp_path / "k=v", x__fasta=">X\nTT\n")
    folder = put(tmp_path, a__fasta=">A\nAC\n")
    assert records(read_fasta_folder(spark, folder, whole_files=whole_files)) == [("A", "A", "AC")]
    with pytest.raises(FileNotFoundError):
        read_fasta_folder(spark, put(tmp_path / "other" / "k=v", x__fasta=">X\nTT\n").removesuffix("/k=v"), whole_files=whole_files)


@BOTH
def test_folder_without_fasta_files_is_an_error(spark, tmp_path, whole_files):
    with pytest.raises(FileNotFoundError):
        read_fasta_folder(spark, put(tmp_path, x__FASTA=">X\nTT\n"), whole_files=whole_files)


@BOTH
def test_folder_with_an_empty_file_is_none(spark, tmp_path, whole_files):
    assert records(read_fasta_folder(spark, put(tmp_path, a__fasta=""), whole_files=whole_files)) == []


def joined_text(folder):
    return "".join(part.read_text() for part in sorted(folder.glob("part-*")))


@BOTH
def test_combined_text_keeps_lines_and_order(spark, tmp_path, whole_files):
    source = put(tmp_path / "in", b__fasta=">B two\r\nGG\r\nA\r\n>C\r\n", a__fasta=">A\nAC\nGGT\n")
    output = tmp_path / "out"
    write_combined(read_folder_entries(spark, source, whole_files=whole_files), str(output), [source])
    assert joined_text(output) == ">A\nAC\nGGT\n>B two\nGG\nA\n>C\n"
    write_combined(read_folder_entries(spark, source, whole_files=whole_files), str(output), [source])
    assert joined_text(output) == ">A\nAC\nGGT\n>B two\nGG\nA\n>C\n"


@pytest.mark.parametrize("output", ["in", "in/out", "in/../in/x", "."])
def test_combined_text_must_not_overlap_its_input(spark, tmp_path, output):
    source = put(tmp_path / "in", a__fasta=">A\nAC\n")
    with pytest.raises(ValueError, match="overlaps"):
        write_combined(read_folder_entries(spark, source), f"{tmp_path}/{output}", [f"file:{source}"])


@pytest.mark.parametrize("named", [True, False])
def test_paths_are_compared_as_their_file_system_sees_them(spark, tmp_path, monkeypatch, named):
    """Relative paths are below the folder that the session works in."""
    import os

    inside = os.path.relpath(put(tmp_path / "in", a__fasta=">A\nAC\n"))
    for output in (os.path.dirname(inside), inside, f"{inside}/out", f"{inside}/../in"):
        entries = read_folder_entries(spark, inside)
        with pytest.raises(ValueError, match="overlaps"):
            write_combined(entries, output, [inside] if named else [])
    assert (tmp_path / "in" / "a.fasta").read_text() == ">A\nAC\n"


def test_a_sibling_with_the_same_prefix_is_no_overlap(spark, tmp_path):
    source = put(tmp_path / "in", a__fasta=">A\nAC\n")
    write_combined(read_folder_entries(spark, source), str(tmp_path / "in2"), [source])
    assert joined_text(tmp_path / "in2") == ">A\nAC\n"


def test_ordered_write(spark, tmp_path):
    frame = spark.createDataFrame([(3, "C", "A"), (1, "A", "ACGTA"), (2, "B", "")], "n int, description string, sequence string")
    write_fasta(frame, str(tmp_path / "out"), 2, ["n"])
    assert joined_text(tmp_path / "out") == ">A\nAC\nGT\nA\n>B\n>C\nA\n"


def test_one_folder_per_value(spark, tmp_path):
    frame = spark.createDataFrame([("x", "A", "AC"), ("y", "B", "")], "kind string, description string, sequence string")
    write_fasta(frame, str(tmp_path / "out"), partition_by=["kind"])
    assert joined_text(tmp_path / "out" / "kind=x") == ">A\nAC\n"
    assert joined_text(tmp_path / "out" / "kind=y") == ">B\n"


words = st.text("abcXYZ019|.,;>é", min_size=1, max_size=8)
fasta_records = st.lists(
    st.tuples(st.lists(words, min_size=1, max_size=3).map(" ".join).filter(lambda d: not d.startswith(">")), st.text("ACGTNacgtn-R", max_size=200)),
    min_size=1,
    max_size=12,
)


@BOTH
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(fasta_records)
def test_what_is_written_is_read(spark, tmp_path_factory, whole_files, entries):
    frame = spark.createDataFrame(entries, "description string, sequence string")
    path = str(tmp_path_factory.mktemp("round") / "out")
    write_fasta(frame, path)
    back = read_fasta(spark, path, whole_files=whole_files).select("description", "sequence").collect()
    assert sorted(map(tuple, back)) == sorted(entries)


def test_purged_records_in_file_order(spark, tmp_path):
    source = put(tmp_path / "in", b__fasta=">C\nac\n>D\nAN\n", a__fasta=">A\nAC\n>B\nGG\n")
    write_fasta(purge_records(read_fasta_folder(spark, source)).kept, str(tmp_path / "out"), 80, FILE_ORDER)
    assert joined_text(tmp_path / "out") == ">A\nAC\n>B\nGG\n>C\nAC\n"


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_line_ends(spark, tmp_path, end, whole):
    text = end.join(["a note", ">a first", "ACGT", "AC", ">b", ">c", "GG", ""])
    (tmp_path / "x.fasta").write_bytes(text.encode())
    rows = read_fasta(spark, str(tmp_path / "x.fasta"), whole_files=whole)
    ordered = [tuple(r) for r in rows.orderBy(*FILE_ORDER).select("id", "description", "sequence").collect()]
    assert ordered == [("a", "a first", "ACGTAC"), ("b", "b", ""), ("c", "c", "GG")]
    entries = read_fasta_entries(spark, str(tmp_path / "x.fasta"), whole_files=whole).orderBy(*FILE_ORDER).select("entry").collect()
    assert [r.entry for r in entries] == [">a first\nACGT\nAC", ">b", ">c\nGG"]
    documents = spark.createDataFrame([(1, text)], "i int, body string")
    assert [r.id for r in records_of_documents(documents).orderBy("number").collect()] == ["a", "b", "c"]


@pytest.mark.parametrize("whole", [False, True])
def test_mixed_line_ends(spark, tmp_path, whole):
    (tmp_path / "x.fasta").write_bytes(b">a\rAC\r>b\nGT\n>c\r\nTT\r>d\rA")
    rows = read_fasta(spark, str(tmp_path), whole_files=whole).orderBy(*FILE_ORDER).select("id", "sequence").collect()
    assert [tuple(r) for r in rows] == [("a", "AC"), ("b", "GT"), ("c", "TT"), ("d", "A")]


@pytest.mark.parametrize("name", ["run-[x]", "a{b,c}", "q?*", "back\\slash"])
def test_names_are_no_patterns(spark, tmp_path, name):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "c[1].fasta").write_text(">one\nAC\n")
    (folder / "d.fasta").write_text(">two\nGT\n")
    assert {r.id for r in read_fasta_folder(spark, str(folder)).collect()} == {"one", "two"}
    assert {r.id for r in read_fasta(spark, str(folder / "c[1].fasta")).collect()} == {"one"}
    assert {r.id for r in read_fasta(spark, [str(folder / "c[1].fasta"), str(folder / "d.fasta")], whole_files=True).collect()} == {"one", "two"}
    assert {r.id for r in read_fasta(spark, str(tmp_path) + "/*/*.fasta").collect()} == {"one", "two"}


def test_more_files_than_are_broadcast(spark, tmp_path, monkeypatch):
    for i in range(5):
        (tmp_path / f"{i}.fasta").write_text(f"note\n>r{i}\nAC\n>s{i}\nGT\n")
    expected = sorted(map(tuple, read_fasta(spark, str(tmp_path)).select("id", "sequence").collect()))
    monkeypatch.setattr("seqwatch.sources.fasta.MOST_BROADCAST", 2)
    assert sorted(map(tuple, read_fasta(spark, str(tmp_path)).select("id", "sequence").collect())) == expected and len(expected) == 10
