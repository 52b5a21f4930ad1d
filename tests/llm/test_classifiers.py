import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwatch.llm import licences, toxicity
from seqwatch.llm.linear import Rows, fit, softmax
from seqwatch.llm.queries import op1_licences, op2_toxicity

from .conftest import prose

SF_DIR = "/root/testdata/sf0.1"
LABELS = "doc_id bigint, quality int, toxic int, row int, fold int"


def test_held_out_accuracy(spark):
    """A chain that has seen half of the labels, on the other half; some toxic texts there have no word that marks others."""
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(2)) == 0)
    out = toxicity.toxicity(docs, learn).select("doc_id", F.col("toxic").cast("int").alias("told"))
    judged = out.join(labels.join(learn, "doc_id", "left_anti").select("doc_id", F.col("toxic").alias("is")), "doc_id").toPandas()
    told, toxic = judged["told"], judged["is"]
    assert toxic.sum() > 100
    assert told[toxic == 1].mean() >= 0.9
    assert told[toxic == 0].mean() <= 0.005


def test_every_document_is_judged(spark):
    out = op2_toxicity(spark, "/root/testdata/sf0.01")
    assert out.columns == ["doc_id", "p_low_quality", "p_toxic", "p_severe", "toxic"]
    rows = out.collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 1000
    assert all(0 <= p <= 1 for r in rows for p in (r.p_low_quality, r.p_toxic, r.p_severe))


def toxic_rows():
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = prose(i, rng.randrange(20, 60)) + (" vilest words" if toxic else "")
        rows.append((i, text, "a"))
        labels.append((i, 1, int(toxic), 1, 1))
    return rows, labels


def test_odd_rows(spark, make_docs, odd_rows):
    rows, labels = toxic_rows()
    rows += [(1000 + (i or 0), t, s) for i, t, s in odd_rows] + [(None, "vilest words", None), (2000, "Vilest... Words!", "a")]
    labels = [*labels, (None, 1, 1, 1, 1), (1, None, 0, 1, 1), (5, 0, 0, 1, 1), (5, 1, 0, 1, 1), (99_999, 1, 1, 1, 1)]
    out = toxicity.toxicity(make_docs(rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(rows)
    assert all(r.toxic == (r.doc_id is None or r.doc_id == 2000 or r.doc_id < 400 and r.doc_id % 4 == 0) for r in out)
    kept = toxicity.drop_toxic(make_docs(rows), spark.createDataFrame(labels, LABELS))
    assert kept.columns == make_docs(rows).columns
    assert kept.count() == sum(not r.toxic for r in out)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0, 1, 1)], [(1, 1, 1, 1, 1)], [(1, 0, 1, 1, 1), (2, 1, 1, 1, 1)]])
def test_too_few_labels_reject_nothing(spark, make_docs, odd_rows, labels):
    out = toxicity.toxicity(make_docs(odd_rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(odd_rows) and not any(r.toxic for r in out)
    assert toxicity.toxicity(make_docs([]), spark.createDataFrame(labels, LABELS)).collect() == []


def test_later_models_see_earlier_probabilities_out_of_fold(spark, make_docs):
    rows, labels = toxic_rows()
    chain = toxicity.train(make_docs(rows), spark.createDataFrame(labels, LABELS))
    width = len(chain.features)
    assert [len(w) for w in chain.weights] == [width + 1, width + 2, width + 3]
    assert chain.categories == ("low_quality", "toxic", "severe")


def test_logistic_regression_finds_what_separates():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 500)
    found = [[0] * int(label) + [1 + int(rng.integers(5))] for label in y]
    rows = Rows(found, 6)
    w = fit(rows, np.column_stack([1 - y, y]).astype(float), np.ones(500))
    assert ((softmax(rows.dot(w[:-1]) + w[-1])[:, 1] > 0.5) == y).all()


# Licences


def planted(seed):
    """Documents and the families in them: templates as they are, among prose, slightly damaged; and near misses."""
    rng = random.Random(seed)
    rows, wanted = [], {}
    families = list(licences.TEMPLATES)
    for i in range(300):
        lines, there = [prose(seed * 1000 + i + j, 15) for j in range(rng.randrange(1, 4))], set()
        for _ in range(rng.choice([0, 0, 1, 2])):
            family = rng.choice(families)
            words = rng.choice(licences.TEMPLATES[family]).split()
            if len(words) > 12:
                words[rng.randrange(len(words))] = "oops"
            lines.insert(rng.randrange(len(lines) + 1), f"{prose(i, 3)} {' '.join(words)} {prose(i, 2)}")
            there.add(family)
        if i % 10 == 0:
            lines.append("the license of version 2.0 is not free, see apache public work")
        rows.append((i, "\n".join(lines), "a"))
        wanted[i] = ",".join(sorted(there))
    return rows, wanted


def test_planted_licences_are_found_and_nothing_else(make_docs):
    rows, wanted = planted(3)
    out = {r.doc_id: r.licences for r in licences.scan_licences(make_docs(rows)).collect()}
    right = sum(out[i] == wanted[i] for i in wanted)
    assert right >= 0.98 * len(wanted)
    assert not any(out[i] for i in wanted if not wanted[i])


def test_whole_table(spark):
    """The notices in the table are told by their words; the scan finds exactly the documents that have one."""
    rows = op1_licences(spark, "/root/testdata/sf0.01").collect()
    docs = {d.doc_id: d.text for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    named = {"apache": "Apache License, Version 2.0", "mit": "MIT License.", "gpl": "GNU General Public License, version 3", "cc-by-nc": "CC BY-NC 4.0"}
    assert len(rows) == len(docs)
    assert {r.doc_id: r.licences for r in rows} == {i: ",".join(sorted(f for f, words in named.items() if words in t)) for i, t in docs.items()}


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:",
    "lgpl": "you can redistribute it and/or modify\nit under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation",
    "gpl": "you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation",
    "mpl": " * This Source Code Form is subject to the terms of the Mozilla\n * Public License, v. 2.0.",
}
WORDINGS = {
    "Licensed under the MIT License.": "mit", "Licensed under CC BY-SA 3.0.": "cc-by-sa", "Distributed under the terms of the BSD license": "bsd",
    "SPDX-License-Identifier: MIT": "mit", "released under the GNU GPL, version 2": "gpl", "licensed under GPLv3": "gpl", "under the LGPL 2.1": "lgpl",
    "Licensed under the MIT License or the Apache License, Version 2.0": "apache,mit", "available under Apache 2.0": "apache",
    "a Creative Commons Attribution-ShareAlike 3.0 licence": "cc-by-sa", "CC BY-NC-SA 4.0": "", "Apache 2.0 serves the pages": "", "er kam mit und blieb": "",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "",
}


def test_wrapped_licences_and_other_wordings(make_docs):
    texts = [(f"{prose(i, 20)}\n{t}\n{prose(i + 50, 20)}", family) for i, (family, t) in enumerate(WRAPPED.items())]
    texts += [(f"{prose(i, 20)}\n{t}\n{prose(i + 50, 20)}", families) for i, (t, families) in enumerate(WORDINGS.items(), 10)]
    texts.append((WRAPPED["mit"] + "\n" + WRAPPED["bsd"], "bsd,mit"))
    out = {r.doc_id: r for r in licences.scan_licences(make_docs([(i, t, "a") for i, (t, _) in enumerate(texts)])).collect()}
    assert {i: out[i].licences for i in out} == {i: families for i, (_, families) in enumerate(texts)}
    assert [out[i].n_licensed for i in range(len(WRAPPED))] == [2, 2, 2, 3, 2]


#: Wordings and mentions that the classifier isn't trained or calibrated with, and that no pattern has.
GRANTS = (
    "All of it is free under the {}, see below", "You can copy this under the {} if you like", "we publish our work under the terms of the {} as of today",
    "this file is licensed under the {} and so is the rest", "code: {}, text: other terms",
)
SPOKEN = (
    "the {} was drafted in 2004 by a committee", "a book on the history of the {}", "in the article the {} is discussed at length", "what is the {} anyway",
    "the {} has been translated by volunteers", "the talk compared the {} with older ones", "who wrote the {} and when",
)
FULL = {"apache": "Apache License", "mit": "MIT License", "gpl": "GNU General Public License", "mpl": "Mozilla Public License", "bsd": "BSD License"}


def scanned(make_docs, texts):
    rows = [(i, f"{prose(i, 25)}\n{t}\n{prose(i + 500, 25)}", "a") for i, t in enumerate(texts)]
    # Other texts, for the classifier to learn from.
    rows += [(10_000 + i, prose(2000 + i, 40), "a") for i in range(100)]
    return {r.doc_id: r.licences for r in licences.scan_licences(make_docs(rows, clashing=False)).collect()}


def test_unseen_wordings_and_mentions(make_docs):
    """A licence that is granted is told from one that is only spoken of."""
    granted = [(g.format(name), family) for g in GRANTS for family, name in FULL.items()]
    spoken = [(m.format(name), "") for m in SPOKEN for name in FULL.values()]
    cases = granted + spoken
    out = scanned(make_docs, [t for t, _ in cases])
    found = sum(out[i] == family for i, (_, family) in enumerate(granted))
    alarms = sum(out[len(granted) + i] != "" for i in range(len(spoken)))
    print("recall", found / len(granted), "false alarms", alarms / len(spoken))
    assert found >= 0.7 * len(granted) and alarms <= 0.1 * len(spoken)
    # Precision: hardly any is taken for another family.
    assert sum(out[i] not in ("", family) for i, (_, family) in enumerate(granted)) <= 0.05 * len(granted)


def test_the_classifier_decides(make_docs, monkeypatch):
    """With a classifier that says the same of everything the result is another."""
    texts = ["Released under the MIT License.", "the MIT License was drafted in 1988", "Licensed under the Apache License, Version 2.0."]
    assert [scanned(make_docs, texts)[i] for i in range(3)] == ["mit", "", "apache"]
    constant = licences.Classifier({}, np.zeros((1, len(licences.FAMILIES))), 1.0, 0.5)
    monkeypatch.setattr(licences, "train", lambda docs, sample: constant)
    assert [scanned(make_docs, texts)[i] for i in range(3)] != ["mit", "", "apache"]


def test_licences_of_odd_rows(make_docs, odd_rows):
    rows = odd_rows + [(50, "\n\n \nReleased under the MIT License.\r\n", "a")] * 2
    out = licences.scan_licences(make_docs(rows)).collect()
    assert len(out) == len(rows)
    assert [(r.n_paragraphs, r.n_licensed, r.licences) for r in out if r.doc_id == 50] == [(1, 1, "mit")] * 2
    assert {(r.n_paragraphs, r.licences, r.probability) for r in out if r.doc_id in (4, 5, 6) and r.n_paragraphs == 0} == {(0, "", None)}
    assert licences.scan_licences(make_docs([])).collect() == []


def test_anchors_are_in_all_that_can_be_confirmed():
    for family, templates in licences._LONG.items():
        for grams in templates:
            without = {g for g in grams if not licences.anchors().intersection(g.split())}
            assert len(without) < licences.CONFIRM * len(grams), family


def test_words_of_names_are_in_all_names():
    """So that no window with a name is passed over."""
    for family, each in licences.NAMED.items():
        for name in each:
            assert licences._NAME_WORDS & set(licences.words(name)), (family, name)
    assert all(licences._NAME_WORDS & set(licences.words(t)) for t in WORDINGS)


def test_windows_cover_all_anchors():
    text = " ".join("mit" if i % 37 in (0, 3) else f"w{i}" for i in range(500))
    found = licences.Scanned(text)
    windows = list(found.windows(frozenset({"mit"})))
    for i, word in enumerate(found.found):
        assert word != "mit" or any(a <= i < b for a, b in windows)
    assert all(b - a <= 4 + 2 * licences.MARGIN for a, b in windows)
