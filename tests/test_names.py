import random

import pytest

from seqwatch.operators.names import candidates, nearest_names, without_accents


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def names_of(spark, items):
    return spark.createDataFrame([(n,) for n in items], "name string")


def test_accents(values):
    assert values(["Bogotá", "Nariño", "ÇÉÈÊÀÔÛÎÙÑÄÖÜ", "café", "ß", None], "string", without_accents) == ["Bogota", "Narino", "CEEEAOUIUNAOU", "cafe", "ß", None]


def test_nearest(spark):
    known = names_of(spark, ["ANTIOQUIA", "BOGOTÁ, D.C.", "NARIÑO", "VALLE DEL CAUCA", "CAUCA", "HUILA", None])
    wanted = names_of(spark, ["antioquia ", "ANTIOQIA", "BOGOTA D.C.", "Narino", "CAUCA", "VALE DEL CAUCA", "VICHADA", "", None, "ANTIOQIA"])
    rows = {r.name: (r.nearest, r.distance) for r in nearest_names(wanted, known).collect()}
    assert rows == {
        "antioquia ": ("ANTIOQUIA", 0), "ANTIOQIA": ("ANTIOQUIA", 1), "BOGOTA D.C.": ("BOGOTÁ, D.C.", 1), "Narino": ("NARIÑO", 0),
        "VALE DEL CAUCA": ("VALLE DEL CAUCA", 1), "VICHADA": (None, None), "": (None, None),
    }
    assert nearest_names(wanted, known.limit(0)).where("nearest is not null").collect() == []
    assert nearest_names(wanted.limit(0), known).collect() == []
    with pytest.raises(ValueError):
        nearest_names(wanted, known, -1)


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_no_pair_is_missed(spark, most):
    rng = random.Random(most)
    words = sorted({"".join(rng.choice("ABC") for _ in range(rng.randrange(0, 9))) for _ in range(130)})
    others = sorted({"".join(rng.choice("ABC") for _ in range(rng.randrange(0, 9))) for _ in range(130)} - set(words))
    known, wanted = names_of(spark, words), names_of(spark, others)
    found = {r.name: (r.distance, r.nearest) if r.nearest is not None else None for r in nearest_names(wanted, known, most).collect()}
    expected = {}
    for o in others:
        best = min((distance(o, w), w) for w in words)
        expected[o] = best if best[0] <= most else None
    assert found == expected


def test_candidates_share_a_piece(spark):
    """Texts with nothing in common are never compared."""
    left = spark.createDataFrame([("A" * 12,), ("B" * 12,)], "folded string")
    right = spark.createDataFrame([("A" * 11,), ("C" * 12,)], "folded_known string")
    assert [tuple(r) for r in candidates(left, right, 2).collect()] == [("A" * 12, "A" * 11)]
    plan = candidates(left, right, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
