import random
import time

import pytest

from seqwatch.operators import rules
from seqwatch.operators.sequences import match_serotypes

HEADERS = ["partial cds, complete cds DENV2", "dengue virus 1 complete genome", "DENV1 complete genome", "Orthoflavivirus denguei complete cds", None, "",
           "DENV-3 and DENV4, complete genome", "Zika complete genome"]


def table(spark, rows):
    return spark.createDataFrame(rows, rules.RULES)


def met(spark, texts, rows, **more):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, body string")
    out = {}
    for r in rules.match_rules(frame, table(spark, rows) if isinstance(rows, list) else rows, **more).collect():
        out.setdefault(r.i, []).append(r.serotype)
    return {i: sorted(labels) for i, labels in out.items()}


def test_serotypes_as_a_table(spark):
    frame = spark.createDataFrame(list(enumerate(HEADERS)), "i int, body string")
    expected = sorted(map(tuple, match_serotypes(frame).select("i", "body", "n_serotypes", "serotype").collect()))
    found = rules.match_rules(frame, rules.rules_table(spark))
    assert found.columns == ["i", "body", "n_serotypes", "serotype"] and sorted(map(tuple, found.collect())) == expected


def test_clauses(spark):
    rows = [("both", "one|uno", False), ("both", "two", None), ("not", "one", False), ("not", "two|three", True), ("inner", "ne tw", False), ("twice", "one", False), ("twice", "one", False)]
    texts = ["one two", "one", "uno and two", "three one", "none", "two", "ONE", None, "one tw"]
    assert met(spark, texts, rows) == {
        0: ["both", "inner", "twice"], 1: ["not", "twice"], 2: ["both"], 3: ["twice"], 4: ["not", "twice"], 8: ["inner", "not", "twice"],
    }


def test_odd_tables(spark):
    assert met(spark, ["x", None], []) == {}
    assert met(spark, ["x", "y"], [(None, "x", False), ("a", None, False), ("a", "", False), ("b", "|x||", False)]) == {0: ["b"]}
    for pattern in ("a.b", "a*", "(a|b)", "[ab]", "a\\d"):
        with pytest.raises(ValueError, match="is not supported"):
            met(spark, ["x"], [("a", pattern, False)])
    with pytest.raises(ValueError, match="nothing that must be"):
        met(spark, ["x"], [("a", "x", True)])
    without = spark.createDataFrame([("a", "x")], "label string, pattern string")
    assert met(spark, ["x"], without) == {0: ["a"]}


@pytest.mark.parametrize("most_letters", [2_000_000, 50])
def test_many_rules_against_a_loop(spark, monkeypatch, most_letters):
    """Also dealt over many automata."""
    monkeypatch.setattr(rules.compile_rules, "__defaults__", (most_letters,))
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    rows = []
    for i in range(60):
        rows += [(f"r{i}", "|".join(word(rng.randrange(2, 7)) for _ in range(3)), False), (f"r{i}", word(3), False)]
        if i % 3 == 0:
            rows.append((f"r{i}", word(5), True))
    texts = [word(rng.randrange(0, 40)) for _ in range(120)]
    expected = {}
    for i, text in enumerate(texts):
        labels = sorted({r[0] for r in rows})
        kept = [la for la in labels if all(any(p in text for p in pattern.split("|")) != negated for label, pattern, negated in rows if label == la)]
        if kept:
            expected[i] = sorted(kept)
    assert met(spark, texts, rows) == expected
    if most_letters == 50:
        assert len(rules.compile_rules(table(spark, rows))) > 5


def test_the_number_of_rules_costs_little():
    """A hundred times as many rules don't take a hundred times as long per text, but a small multiple."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(n))
    texts = [word(20_000) for _ in range(60)]
    seconds = {}
    for n in (100, 10_000):
        clauses = rules._compiled([(f"r{i}", word(12) + "|" + word(14), False) for i in range(n)])
        clauses.met("warm")
        start = time.perf_counter()
        for text in texts:
            clauses.met(text)
        seconds[n] = time.perf_counter() - start
    assert seconds[10_000] < 10 * seconds[100] + 0.2


def test_common_clauses_cost_little():
    """A text that meets a clause of all rules is not held against each of them."""
    rows = []
    for i in range(10_000):
        rows += [(f"r{i}", f"only {i} here", False), (f"r{i}", "complete genome|complete cds", False), (f"r{i}", "partial", True)]
    clauses = rules._compiled(rows)
    clauses.met("warm")
    start = time.perf_counter()
    for i in range(1_000):
        assert clauses.met(f"only {i} here, complete cds") == [f"r{i}"]
        assert clauses.met(f"only {i} here, complete cds, partial") == []
    assert time.perf_counter() - start < 1


@pytest.mark.parametrize("bits", [20, 15])
def test_large_tables_are_joined(spark, monkeypatch, bits):
    """Equal texts, texts without rules and null ones; a bitmap that takes much for a phrase changes nothing."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abé𝛼 ") for _ in range(n))
    rows = []
    for i in range(80):
        rows += [(f"r{i}", "|".join(word(rng.randrange(1, 9)) for _ in range(3)), False), (f"r{i}", "a|b", False)]
        if i % 3 == 0:
            rows += [(f"r{i}", word(rng.randrange(3, 6)), True), (f"r{i}", "a|b", None)]
    rows += [("", "ab", False), ("never", "zz", False), ("never", "a|b", False), ("none", "|", False), (None, "a", False), ("null", None, False)]
    texts = [word(rng.randrange(0, 40)) for _ in range(150)]
    texts += [None, "", *texts[:20], word(3000)]
    small = met(spark, texts, rows)
    compiled = []
    monkeypatch.setattr(rules, "compile_rules", lambda *a: compiled.append(a))
    monkeypatch.setattr(rules, "MOST_LETTERS", 50)
    monkeypatch.setattr(rules, "FEWEST_BITS", bits)
    monkeypatch.setattr(rules, "MOST_BITS", bits)
    monkeypatch.setattr(rules, "AT_ONCE", 500)
    assert met(spark, texts, rows) == small and len(small) > 100 and not compiled
    with pytest.raises(ValueError, match="is not supported"):
        met(spark, ["x"], [*rows, ("a", "a.b", False)])
    with pytest.raises(ValueError, match="nothing that must be"):
        met(spark, ["x"], [*rows, ("a", "x", True), ("a", "|", False)])


def all_met(spark, monkeypatch, n, part_bytes):
    """Texts that all meet as many rules, by a phrase that these share; the paths that are written."""
    paths = []
    path = rules.scratch_path
    monkeypatch.setattr(rules, "scratch_path", lambda *a: paths.append(path(*a)) or paths[-1])
    monkeypatch.setattr(rules, "MOST_LETTERS", 50)
    monkeypatch.setattr(rules, "PART_BYTES", part_bytes)
    monkeypatch.setattr(rules, "PIECE", 37)
    monkeypatch.setattr(rules, "BATCH", 100)
    rows = [row for i in range(n) for row in ((f"r{i}", f"own {i} piece|shared", False), (f"r{i}", "complete", False), (f"r{i}", "partial", True))]
    texts = spark.createDataFrame([(i, f"{i} shared and complete" + " partial" * (i % 10 == 0)) for i in range(n)], "i int, body string")
    return rules.match_rules(texts, table(spark, rows)), paths


@pytest.mark.parametrize("part_bytes", [1 << 26, 10_000])
def test_what_meets_is_neither_stored_nor_moved(spark, monkeypatch, part_bytes):
    """Texts and rules that meet are many more than either."""
    n = 300
    found, paths = all_met(spark, monkeypatch, n, part_bytes)
    pairs = found.select("i", "serotype")
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in pairs.collect()} == {(i, f"r{k}") for i in range(n) if i % 10 for k in range(n)} and pairs.count() == n * 9 // 10 * n
    assert sum(spark.read.parquet(path).count() for path in paths) < 20 * n
    assert any("rules-hits" in path for path in paths) == (part_bytes == 10_000)
    assert {(r.i, r.n_serotypes) for r in found.collect()} == {(i, n) for i in range(n) if i % 10}


def test_parts_give_what_one_automaton_gives(spark, monkeypatch):
    """Also with a text column named in other letters, and columns that only ride along."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    rows = []
    for i in range(60):
        rows += [(f"r{i}", "|".join(word(rng.randrange(1, 9)) for _ in range(3)), False), (f"r{i}", "a|b", i % 4 == 0), (f"r{i}", word(3), False)]
    texts = [(word(rng.randrange(0, 40)), [i, None], None) for i in range(100)] + [(None, None, None)]
    frame = spark.createDataFrame(texts, "Body string, more array<int>, nothing date")
    small = sorted(rules.match_rules(frame, table(spark, rows), "body").collect(), key=str)
    monkeypatch.setattr(rules, "MOST_LETTERS", 50)
    monkeypatch.setattr(rules, "FEWEST_BITS", 15)
    for part_bytes in (1 << 26, 1_000):
        monkeypatch.setattr(rules, "PART_BYTES", part_bytes)
        assert sorted(rules.match_rules(frame, table(spark, rows), "body").collect(), key=str) == small and len(small) > 100


@pytest.mark.parametrize("few", [0, 256])
@pytest.mark.parametrize("alike", [1 << 40, 3])
def test_a_part_against_a_loop(monkeypatch, few, alike):
    """Also with phrases of one hash."""
    monkeypatch.setattr(rules, "FEW_KINDS", few)
    own = rules._hashes
    monkeypatch.setattr(rules, "_hashes", lambda phrases, bits=None: own(phrases, bits) % rules.np.uint64(alike))
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    rows = {(f"r{i % 50}", "|".join(word(rng.randrange(0, 5)) for _ in range(2)), i >= 110) for i in range(150)}
    rows = sorted(r for r in rows if r[1] != "|")
    part, lengths, gate = rules._part(rules.pa.table(dict(zip(("label", "pattern", "negated"), map(list, zip(*rows, strict=True)), strict=True))), rules.np.zeros(1 << 12, dtype="uint8"))
    marks = rules.np.zeros(part.n_patterns, dtype=bool)
    clauses = rules._compiled(rows)
    lets = gate.opened()
    assert (lets is None) == (few == 0)
    some = 0
    for _ in range(200):
        text = word(rng.randrange(0, 9))
        parts = list({text[i : i + n] for n in lengths for i in range(len(text) - n + 1)})
        places, numbers = part.looked_up([*parts, "zz"])
        assert [part.phrases[k].as_py() for k in numbers.tolist()] == [parts[k] for k in places.tolist()]
        assert part.labels.take(rules.pa.array(part.met(numbers, marks))).to_pylist() == clauses.met(text) and not marks.any()
        some += len(clauses.met(text))
        assert lets is None or lets(text) or not clauses.met(text)
    assert some > 100


def test_texts_that_fail_what_all_rules_have_are_not_gone_through():
    rows = [row for i in range(9) for row in ((f"r{i}", f"own {i}", False), (f"r{i}", "genome|cds", False), (f"r{i}", "partial", True))]
    made = lambda rows: rules._part(rules.pa.table(dict(zip(("label", "pattern", "negated"), map(list, zip(*rows, strict=True)), strict=True))), rules.np.zeros(1 << 12, dtype="uint8"))[2]
    lets = made(rows).opened()
    assert [lets(text) for text in ("own 1", "a cds", "own 1 genome", "partial genome", "")] == [False, True, True, False, False]
    assert made([*rows, ("alone", "x", False)]).opened() is None
    wider = made(rows).wider(made([("r", "x", False), ("r", "y", False), ("s", "y", False), ("s", "z", False)])).opened()
    assert wider("own 1 genome") and not wider("partial genome") and (wider("x") or wider("y"))
