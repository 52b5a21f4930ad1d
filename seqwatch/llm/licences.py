"""Licence scans: a trained classifier names the family of a window of words, and templates confirm it.

Windows are cut around words that licences have, from the words of the whole text, whatever its lines. A softmax regression over word n-grams, with
an unknown class, says which family a window is of; only then is it compared with that family's templates and names. What
they confirm is a passage; the words that are left are judged again, so a window may have several.

The regression is trained on templates, in damaged copies among words of the corpus, on names in wordings that grant a licence, and,
as unknown, on windows of the corpus, on mixed words, and on names in wordings that only speak of a licence. A temperature and a
least probability are set on a part held out, with wordings of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seqwatch.llm.common import carried, in_slices
from seqwatch.llm.linear import Rows, fit, softmax

# How licences are named and begun, by family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD License.",
        "Released under the 3-Clause BSD License.",
    ],
    "cc0": ["CC0 1.0 Universal. The work is dedicated to the public domain."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "lgpl": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Names of licences, of which some notices have no more: patterns over lower case, in which a blank is whatever is between two words.
FULL_NAMES = {
    "apache": ["apache (?:software )?licen[cs]ed?"],
    "bsd": ["bsd (?:(?:[234]|two|three|four) clause )?licen[cs]ed?", "(?:[234]|two|three|four) clause bsd", "bsd (?:[234]|two|three|four) clause"],
    "cc0": ["cc0 1(?: 0)?", "creative commons zero"],
    "gpl": ["gnu general public licen[cs]e", "gnu gpl"],
    "lgpl": ["(?:gnu )?(?:lesser|library) general public licen[cs]e", "gnu lgpl"],
    "mit": ["(?:mit|expat) licen[cs]ed?"],
    "mpl": ["mozilla public licen[cs]e"],
    "cc": ["creative commons attribution(?: (?:non(?: )?commercial|share(?: )?alike|no(?: )?deriv(?:ative)?s?))*"],
}
#: Short names count where a version follows them or a licence is spoken of before them; those of ``LED_NAMES`` only in the second case.
SHORT_NAMES = {"gpl": ["gpl"], "lgpl": ["lgpl"], "mpl": ["mpl"], "cc": ["cc by(?: (?:nc|sa|nd))*"]}
LED_NAMES = {"apache": ["apache 2(?: 0)?"], "bsd": ["bsd"], "cc0": ["cc0"], "mit": ["mit"]}
VERSION = "(?:(?: version| v)? v?[0-9]|v[0-9])(?: [0-9](?![0-9]))?"
LEAD = (
    "(?:(?:licen[cs]ed|released|distributed|available|published|provided) under (?:(?:the|a|an|either|terms|of) )*"
    r"|licen[cs]e(?: identifier)?[^a-z0-9\n]{0,4}[:=][^a-z0-9]{0,20})"
)
#: How names are worded where a licence is granted, and where it is only spoken of. Every fourth of each is held out from training.
WORDINGS = (
    "", "Licensed under", "Released under the", "License:", "Distributed under the terms of the", "SPDX-License-Identifier:", "under the",
    "available under the", "The code is published under the", "provided under the terms of the", "a", "This work is licensed under a", "available under",
    "you may use it under the terms of the", "under the terms of the", "made available under a", "distributed under", "All files here are licensed under the",
    "free under the", "is covered by the",
)
MENTIONS = (
    "the history of the {}", "the {} was drafted in", "a lawyer wrote about the {} in her book", "the authors of the {} met in", "what is the {} and who wrote it",
    "unlike the {} this text grants nothing", "she compared the {} with other licences", "the {} does not apply here", "not licensed under the {}",
    "an article about the {} was read", "people often ask whether the {} is popular", "the {} has been translated into", "the first version of the {} appeared in",
    "a talk on the {} will be given", "he criticised the {} in a review", "a server called {} serves the pages", "the {} is not used", "{} is discussed in this text",
    "{} was written by", "some prefer {} to others", "they were talking about the {} for hours", "I have read the {} twice", "he knows the {} by heart",
    "in a paper on the {} they show that", "the debate about the {} has been long", "who is behind the {}", "when the {} was new", "there are many books about the {}",
    "critics of the {} say that", "she wrote to the makers of the {}", "our committee discussed the {} at a meeting", "the name {} is older than",
    "does the {} allow that", "you should not confuse the {} with", "a history and an analysis of the {} and its authors", "students learn what the {} means",
    "it is said that the {} will change", "we do not use the {} any more", "the {} and its history are described in a chapter", "volunteers translated the {} into french",
)
#: What may follow a name where a licence is granted.
ENDINGS = (
    "", "", "", "see below", "and nothing else", "as stated in this file", "if you want to", "unless it is said otherwise", "which is in the file named so", "and all of its terms",
    "this is what you have to keep", "as it was published by its makers", "so you may use it", "or any later one", "for what it is worth",
)
VERSIONS = ("", "1.0", "version 2.0", "3.0", "4.0", "v2", "v3")
NAMED = {
    "apache": ["Apache License", "Apache Software License", "Apache 2.0"], "bsd": ["BSD License", "BSD 3-Clause License", "3-Clause BSD"],
    "cc0": ["CC0", "CC0 1.0", "Creative Commons Zero"], "cc-by": ["CC BY", "Creative Commons Attribution"],
    "cc-by-nc": ["CC BY-NC", "Creative Commons Attribution-NonCommercial", "Creative Commons Attribution Non-Commercial"],
    "cc-by-sa": ["CC BY-SA", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution Share-Alike"],
    "gpl": ["GNU General Public License", "GNU GPL", "GPL", "GPLv2", "GPLv3"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL", "LGPL", "LGPLv2", "LGPLv3"],
    "mit": ["MIT License", "MIT-licensed", "MIT"], "mpl": ["Mozilla Public License", "MPL", "MPLv2"],
}
UNKNOWN = "unknown"
FAMILIES = [*TEMPLATES, UNKNOWN]
#: Windows of the corpus that teach the unknown class, at most: one from each of the texts of the smallest hashes, at a place that its hash tells.
SAMPLE = 4000
#: Words of a window on either side of the words it is cut around, and how many others may be between these.
MARGIN, GAP = 10, 12
#: Code points of a window of the corpus, about.
PIECE = 8 * (2 * MARGIN + GAP)
#: What a false alarm weighs against a licence that is missed, both as shares of what is held out. Alarms held out are mostly names in wordings never seen.
ALARM_WEIGHT = 0.5
#: Families of a window that are compared with their templates, the likeliest first.
TRIED = 3
#: Damaged copies of each template.
COPIES = 60
N_GRAMS = 3
#: Share of a template's n-grams that confirms it.
CONFIRM = 0.7
WORD = re.compile(r"[a-z0-9]+")
SEED = 20_011


@dataclass
class Classifier:
    features: dict[str, int]
    weights: np.ndarray
    temperature: float
    least: float

    def probabilities(self, grams: set[str]) -> np.ndarray:
        """Of each family, against the unknown class: how likely it is if it is one of the two."""
        scores = (self.weights[[self.features[g] for g in grams if g in self.features]].sum(axis=0) + self.weights[-1]) / self.temperature
        return 1 / (1 + np.exp(np.clip(scores[-1] - scores[:-1], -500, 500)))

    def judge(self, grams: set[str]) -> list[tuple[str, float]]:
        """The families that are likely enough, the likeliest first."""
        p = self.probabilities(grams)
        return [(FAMILIES[k], float(p[k])) for k in np.argsort(-p, kind="stable")[:TRIED] if p[k] >= self.least]

    @cached_property
    def anchors(self) -> frozenset:
        return anchors() | _NAME_WORDS


def words(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def n_grams(found: list[str | None]) -> set[str]:
    """The n-grams of words; none goes over a place whose word is taken away."""
    runs: list[list[str]] = [[]]
    for word in found:
        if word is None:
            runs.append([])
        else:
            runs[-1].append(word)
    return {" ".join(run[i : i + n]) for run in runs for n in range(1, N_GRAMS + 1) for i in range(len(run) - n + 1)}


def long_grams(found: list[str]) -> set[str]:
    return {" ".join(found[i : i + N_GRAMS]) for i in range(len(found) - N_GRAMS + 1)}


_LONG = {family: [long_grams(words(t)) for t in templates] for family, templates in TEMPLATES.items()}


def anchors() -> frozenset:
    """Words of which every confirmed paragraph has one: without their n-grams no template reaches the share it needs.

    For each template the words of most n-grams are taken until that holds, longer words first among equals.
    """
    out: set[str] = set()
    for grams in (g for family in _LONG.values() for g in family):
        left = {g for g in grams if not out.intersection(g.split())}
        while len(left) >= CONFIRM * len(grams):
            each = sorted({w for g in left for w in g.split()})
            best = max(each, key=lambda w: (len(w) >= 5, sum(w in g.split() for g in left), len(w), w))
            out.add(best)
            left = {g for g in left if best not in g.split()}
    return frozenset(out)


def _pattern(name: str) -> re.Pattern:
    return re.compile(f"(?<![a-z0-9])(?:{name})(?![a-z0-9])".replace(" ", "[^a-z0-9]{1,20}"))


_PATTERNS = [
    (family, _pattern(name + ending))
    for names, endings in ((FULL_NAMES, [f"(?:{VERSION})?"]), (SHORT_NAMES, [VERSION]))
    for family, each in names.items() for name in each for ending in endings
] + [
    (family, _pattern(f"{LEAD}{name}(?:{VERSION})?")) for names in (SHORT_NAMES, LED_NAMES) for family, each in names.items() for name in each
]
_CC_PARTS = {"": "cc-by", "nc": "cc-by-nc", "sa": "cc-by-sa"}


def _cc_family(name: str) -> str | None:
    """The family of a Creative Commons name by its conditions; None for those without one here."""
    conditions = {"nc": r"(?<![a-z])nc(?![a-z])|commercial", "sa": r"(?<![a-z])sa(?![a-z])|alike", "nd": r"(?<![a-z])nd(?![a-z])|deriv"}
    return _CC_PARTS.get("".join(short for short, pattern in conditions.items() if re.search(pattern, name)))


_GRAM_OF: dict[tuple[str, ...], list[tuple[int, str]]] = defaultdict(list)
_ALL = [(family, grams) for family, templates in _LONG.items() for grams in templates]
for _i, (_, _grams) in enumerate(_ALL):
    for _gram in _grams:
        _GRAM_OF[tuple(_gram.split())].append((_i, _gram))
_FIRST = {gram[0] for gram in _GRAM_OF}


def _of_templates(found: list[str], line: list[int]) -> list[tuple[float, int, str, int, int]]:
    """share, matched n-grams, family, first and last word: where enough of a template is within twice its length, or within a line."""
    hits: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for i in range(len(found) - N_GRAMS + 1):
        if found[i] in _FIRST:
            for template, gram in _GRAM_OF.get(tuple(found[i : i + N_GRAMS]), ()):
                hits[template].append((i, gram))
    out = []
    for template, placed in hits.items():
        family, wanted = _ALL[template]
        if len({gram for _, gram in placed}) < CONFIRM * len(wanted):
            continue
        for fits in (lambda a, b, most=2 * (len(wanted) + N_GRAMS - 1): b + N_GRAMS - a <= most, lambda a, b: line[a] == line[b + N_GRAMS - 1]):
            have: Counter = Counter()
            first = 0
            for place, gram in placed:
                have[gram] += 1
                while first < len(placed) and placed[first][0] < place and (not fits(placed[first][0], place) or have[placed[first][1]] > 1):
                    have[placed[first][1]] -= 1
                    have += Counter()  # without zeros
                    first += 1
                if len(have) >= CONFIRM * len(wanted):
                    out.append((len(have) / len(wanted), len(have), family, placed[first][0], place + N_GRAMS - 1))
    return out


#: Words of names: a window without any of these, and without any anchor of a template, has nothing that could be confirmed.
_NAME_WORDS = frozenset({
    "apache", "bsd", "cc0", "cc", "creative", "gpl", "gplv2", "gplv3", "lgpl", "lgplv2", "lgplv3", "mpl", "mplv2", "mit", "expat", "mozilla", "gnu",
    "license", "licence", "licensed", "licenced",
})


@dataclass
class Scanned:
    """The words of a text in lower case, and what templates and names find in it."""

    lowered: str

    def __post_init__(self):
        placed = [(m.start(), m[0]) for m in WORD.finditer(self.lowered)]
        self.starts, self.found = [at for at, _ in placed], [word for _, word in placed]
        ends = [m.start() for m in re.finditer("\n", self.lowered)]
        self.line = [bisect_left(ends, at) for at in self.starts]

    def windows(self, anchored: frozenset) -> Iterator[tuple[int, int]]:
        """First word and the one behind the last: around anchors that are near each other."""
        places = [i for i, word in enumerate(self.found) if word in anchored]
        for k, at in enumerate(places):
            if k == 0 or at - places[k - 1] > GAP:
                first = at
            if k + 1 == len(places) or places[k + 1] - at > GAP:
                yield max(0, first - MARGIN), min(len(self.found), at + 1 + MARGIN)

    @cached_property
    def confirmed(self) -> list[tuple[str, int, int]]:
        """family, first and last word of whatever a template or a name confirms, the best first.

        Names come first, longer ones before shorter. Words of one family's name or template are not another's.
        """
        names = []
        for family, pattern in _PATTERNS:
            for m in pattern.finditer(self.lowered):
                first, last = bisect_left(self.starts, m.start()), bisect_right(self.starts, m.end() - 1) - 1
                names.append((first, last, _cc_family(m[0]) or UNKNOWN if family == "cc" else family))
        owner: list[str | None] = [None] * len(self.found)
        out = []
        for first, last, family in sorted(names, key=lambda n: (n[0] - n[1], n)):
            if not any(owner[first : last + 1]):
                owner[first : last + 1] = [family] * (last + 1 - first)
                out.append((family, first, last))
        taken = [False] * len(self.found)
        for _, _, family, first, last in sorted(_of_templates(self.found, self.line), key=lambda t: (-t[0], -t[1], t[4] - t[3], t)):
            if not any(taken[first : last + 1]) and set(owner[first : last + 1]) <= {None, family}:
                owner[first : last + 1], taken[first : last + 1] = [family] * (last + 1 - first), [True] * (last + 1 - first)
                out.append((family, first, last))
        return [(family, first, last) for family, first, last in out if family != UNKNOWN]

    def passages(self, model: Classifier) -> list[tuple[str, int, int, float]]:
        """family, first and last word, probability: what the classifier names and the family's templates confirm."""
        out: dict[tuple[str, int, int], float] = {}
        for begin, end in self.windows(model.anchors):
            left: list[str | None] = self.found[begin:end]
            while any(word in model.anchors for word in left if word):
                for family, p in model.judge(n_grams(left)):
                    # A template may be longer than the window that it was recognised by.
                    spans = [
                        (first, last) for named, first, last in self.confirmed
                        if named == family and first < end and last >= begin and None not in left[max(0, first - begin) : last + 1 - begin]
                    ]
                    if spans:
                        break
                else:
                    break
                for first, last in spans:
                    out.setdefault((family, first, last), p)
                    first, last = max(first, begin), min(last, end - 1)
                    left[first - begin : last + 1 - begin] = [None] * (last + 1 - first)
        return [(*span, p) for span, p in out.items()]


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, n_licensed, licences, probability.

    Paragraphs are the lines that are not blank. ``n_licensed`` counts those with words of a licence's passage, which may go over several;
    ``licences`` names all families in order, comma-joined, empty without any; ``probability`` is the least of the passages' probabilities
    (null without any): how likely the family is against none. Words that only speak of a licence are none as far as the classifier tells. A null or empty text has no paragraphs. Null and
    repeated ids are rows of their own. An empty table gives an empty result. Other columns are ignored.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    model = train(narrow, sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_document(model, text) for text in batch["text"]]
            out = pd.DataFrame(rows, columns=["n_paragraphs", "n_licensed", "licences", "probability"])
            out.insert(0, "doc_id", batch["doc_id"].reset_index(drop=True))
            yield out

    told = narrow.withColumn("doc_id", carried(F.col("doc_id"))).mapInPandas(
        in_slices(run), "doc_id string, n_paragraphs bigint, n_licensed bigint, licences string, probability double"
    )
    return told.withColumn("doc_id", F.col("doc_id").cast(kind))


def _document(model: Classifier, text: str | None) -> tuple:
    n_lines = sum(1 for line in (text or "").split("\n") if line and not line.isspace())
    lowered = (text or "").lower()
    scanned = Scanned(lowered) if any(word in lowered for word in model.anchors) else None
    found = scanned.passages(model) if scanned else []
    licensed = set().union(*[set(scanned.line[first : last + 1]) for _, first, last, _ in found])
    return n_lines, len(licensed), ",".join(sorted({family for family, *_ in found})), min((p for *_, p in found), default=None)


def train(docs: DataFrame, sample: int = SAMPLE) -> Classifier:
    """A classifier from the templates, the wordings and a bounded sample of the corpus's texts."""
    texts = docs.where("text is not null").withColumn("h", F.xxhash64("text"))
    # About twice the sample by a bound on the hash, so that no task has to order more than that.
    known = max(1, texts.agg(F.approx_count_distinct("h")).first()[0])
    bound = min(2**63 - 1, int(2**64 * min(1.0, 2 * sample / known)) - 2**63)
    # Of each text three windows' lengths, from a place that the hash tells, of which the middle is used; equal texts count once.
    length = 3 * PIECE
    start = F.pmod(F.xxhash64("h", F.lit(1)), F.greatest(F.length("text") - length, F.lit(0)) + 1) + 1
    pieces = texts.where(F.col("h") <= bound).select("h", F.substring("text", start.cast("int"), F.lit(length)).alias("piece"))
    taken = pieces.groupBy("h").agg(F.min("piece").alias("piece")).orderBy("h").limit(sample)
    # One bounded group: the sample. Its model is as small.
    model = taken.groupBy(F.lit(0).alias("one")).applyInPandas(_fit, "features array<string>, weights array<double>, temperature double, least double")
    row = model.first()
    if row is None:
        made = _fit(pd.DataFrame({"h": [], "piece": []}))
        row = made.iloc[0]
    features = {term: i for i, term in enumerate(row["features"])}
    weights = np.array(row["weights"]).reshape(len(features) + 1, len(FAMILIES))
    return Classifier(features, weights, float(row["temperature"]), float(row["least"]))


def _examples(others: list[list[str]], rng: np.random.Generator) -> Iterator[tuple[list[str], int, bool]]:
    """words, label and whether held out."""
    pool = [w for x in others for w in x] or ["word"]
    unknown = len(FAMILIES) - 1

    def among(whole: list[str]) -> list[str]:
        """The words among some of the corpus, as in a window."""
        before, after = ([pool[i] for i in rng.integers(0, len(pool), rng.integers(0, MARGIN + 1))] for _ in range(2))
        return before + whole + after

    for label, family in enumerate(TEMPLATES):
        for template in TEMPLATES[family]:
            whole = words(template)
            for i in range(COPIES):
                held = i % 4 == 0
                yield among([w for w in whole if rng.random() > 0.08]), label, held
                # Some of the same words in no order are no licence.
                mixed = [whole[k] for k in rng.permutation(len(whole))][: rng.integers(1, len(whole) + 1)]
                if not Scanned(" ".join(mixed)).confirmed:
                    yield among(mixed), unknown, held
        for name in NAMED[family]:
            for i, wording in enumerate(WORDINGS):
                for version in VERSIONS:
                    ending = ENDINGS[rng.integers(len(ENDINGS))]
                    yield among(words(f"{wording} {name} {version} {ending}")), label, i % 4 == 3
            for i, mention in enumerate(MENTIONS):
                for version in VERSIONS:
                    yield among(words(mention.format(f"{name} {version}"))), unknown, i % 4 == 3
    for i, x in enumerate(others):
        yield x, unknown, i % 4 == 0


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    rng = np.random.default_rng(SEED)
    others = []
    for piece in sorted(frame["piece"]):
        # What is near a licence, or may be the half of one that the piece's end cuts, is no example of none.
        if not Scanned(piece.lower()).confirmed:
            found = words(piece)
            others.append(found[len(found) // 3 : -(-2 * len(found) // 3)] if len(piece) >= 3 * PIECE else found)
    others = [x for x in others if x]
    examples = list(_examples(others, rng))
    of_licences = [words(t) for templates in TEMPLATES.values() for t in templates]
    of_licences += [words(f"{w} {n} {v}") for names in NAMED.values() for n in names for i, w in enumerate(WORDINGS) for v in VERSIONS if i % 4 != 3]
    of_licences += [words(f"{n} {e}") for names in NAMED.values() for n in names for e in ENDINGS]
    of_licences += [words(m.format(n)) for names in NAMED.values() for n in names for i, m in enumerate(MENTIONS) if i % 4 != 3]
    features = {term: i for i, term in enumerate(sorted(set().union(*map(n_grams, of_licences))))}
    rows = Rows([[features[g] for g in n_grams(x) if g in features] for x, _, _ in examples], len(features))
    labels = np.array([label for _, label, _ in examples])
    held = np.array([out for _, _, out in examples])
    target = np.eye(len(FAMILIES))[labels]
    per_class = np.bincount(labels[~held], minlength=len(FAMILIES))
    weight = np.where(held, 0.0, 1 / np.maximum(per_class, 1)[labels])
    # The unknown class is as heavy as all families together.
    weight[labels == len(FAMILIES) - 1] *= len(TEMPLATES)
    weights = fit(rows, target, weight, rounds=200)
    scores, truth = (rows.dot(weights[:-1]) + weights[-1])[held], labels[held]
    temperatures = np.geomspace(0.05, 5, 60)
    # The temperature that makes the held-out labels likeliest.
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(loss))])
    likely = 1 / (1 + np.exp(np.clip((scores[:, -1:] - scores[:, :-1]) / temperature, -500, 500)))
    # From the least probability on, the share of licences found exceeds that of false alarms, as they weigh, by the most.
    alarms = likely[truth == len(FAMILIES) - 1].max(axis=1)
    right = likely[truth < len(FAMILIES) - 1, truth[truth < len(FAMILIES) - 1]]
    steps = np.linspace(0.5, 0.99, 50)
    least = float(steps[np.argmax([(right >= t).mean() - ALARM_WEIGHT * (alarms >= t).mean() for t in steps])])
    return pd.DataFrame(
        {"features": [list(features)], "weights": [weights.reshape(-1).tolist()], "temperature": [temperature], "least": [least]}
    )
