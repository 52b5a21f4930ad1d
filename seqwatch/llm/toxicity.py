"""Toxicity by a chain of linear classifiers.

The chain takes its categories in turn. Each has a logistic regression over a document's words and word
beginnings and over the probabilities of the categories before it; those, in training, come from models that
have not seen the document (out of fold), so that later models learn from what they will meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seqwatch.llm.common import ROWS, carried, hand_back, in_slices, store
from seqwatch.llm.linear import Rows, fit, softmax

#: Labelled documents that the chain is fitted on, at most: those of the smallest id hashes.
SAMPLE = 12_000
FOLDS = 3
#: Lengths of the beginnings of longer words, which inflected forms share.
BEGINNINGS = (4, 5, 6, 7)
#: A term is a feature if it was in so many labelled documents and its counts are so unlikely by chance (as standard errors).
LEAST_DOCUMENTS, LEAST_SCORE = 3, 4.0
#: A toxic document with so many different marker words is severe; a marker word is this much likelier in toxic documents.
SEVERE_MARKERS, MARKER_RATIO = 3, 20.0
#: A clean document told wrong weighs as much as so many toxic ones.
CLEAN_WEIGHT = 5
CHAIN = ("low_quality", "toxic", "severe")
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Chain:
    """A fitted chain: features, and for each category its weights for the features, the earlier categories and the bias."""

    categories: tuple[str, ...]
    features: dict[str, int]
    weights: list[np.ndarray]
    threshold: float = 0.5
    words: set = field(init=False)
    beginnings: dict = field(init=False)

    def __post_init__(self):
        self.words = {term for term in self.features if not term.endswith("*")}
        ends = [term for term in self.features if term.endswith("*")]
        self.beginnings = {n: {term[:-1] for term in ends if len(term) == n + 1} for n in BEGINNINGS}

    def found(self, text: str) -> list[int]:
        words = set(WORD.findall(text.lower()))
        hits = [self.features[word] for word in self.words & words]
        for n, known in self.beginnings.items():
            if known:
                hits += [self.features[start + "*"] for start in known & {word[:n] for word in words if len(word) > n}]
        return hits

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """A row per text, a column per category."""
        parts = [self._probabilities(texts[i : i + ROWS]) for i in range(0, len(texts), ROWS)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.weights)))

    def _probabilities(self, texts: list[str | None]) -> np.ndarray:
        found = [self.found(text) if text else [] for text in texts]
        earlier = np.zeros((len(texts), 0))
        for weights in self.weights:
            rows = Rows(found, len(self.features), earlier)
            earlier = np.column_stack([earlier, softmax(rows.dot(weights[:-1]) + weights[-1])[:, 1]])
        return earlier


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, p_low_quality, p_toxic, p_severe, toxic.

    ``labels`` (doc_id, quality, toxic) teaches the chain low_quality (quality 0), toxic, severe. The last is not in
    the labels: it is a toxic document with several of the words that mark toxic ones. Rows with a null id or
    label teach nothing; of an id labelled twice the worst label holds. A null or empty text has no features. Without labelled
    documents of both kinds a category's probability is the share of its positives, and nothing is toxic.
    Repeated ids are rows of their own. Empty tables give an empty result. Other columns are ignored.
    """
    chain = train(docs, labels, sample, doc_id, text)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = chain.probabilities(batch["text"].tolist())
            out = pd.DataFrame(p, columns=[f"p_{c}" for c in chain.categories])
            out.insert(0, "doc_id", batch["doc_id"].reset_index(drop=True))
            yield out.assign(toxic=p[:, chain.categories.index("toxic")] >= chain.threshold)

    schema = ", ".join(["doc_id string", *[f"p_{c} double" for c in chain.categories], "toxic boolean"])
    texts = docs.select(carried(F.col(doc_id)).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return texts.mapInPandas(in_slices(run), schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the chain doesn't find toxic, with all their columns."""
    chain = train(docs, labels, sample, doc_id, text)
    at = chain.categories.index("toxic")

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        p = chain.probabilities(texts.tolist())[:, at]
        hand_back()
        return pd.Series(p >= chain.threshold)

    return docs.where(~toxic(F.col(text).cast("string")))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Chain:
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id")
    known = known.agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # As many rows as the sample is allowed: small enough to broadcast.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = chosen.select("doc_id", (1 - F.col("quality")).cast("int").alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    kind = docs.schema[doc_id].dataType.simpleString()
    taught = texts.join(F.broadcast(chosen), "doc_id").mapInPandas(
        in_slices(_terms), f"doc_id {kind}, low_quality int, toxic int, terms array<string>"
    )
    taught = taught.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int"))
    taught = store(taught.withColumn("row", F.monotonically_increasing_id()), "toxicity-taught")

    features, markers = choose_features(taught)
    given = ("low_quality", "toxic")
    names = list(features)
    index = pd.Series(np.arange(len(names)), index=names, dtype="int64")
    marker_ids = {features[term] for term in markers}

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = index.to_dict()
        for batch in batches:
            ids = [[lookup[term] for term in terms if term in lookup] for terms in batch["terms"]]
            severe = [int(t and len(marker_ids.intersection(x)) >= SEVERE_MARKERS) for t, x in zip(batch["toxic"], ids, strict=True)]
            out = batch[["row", "fold", *given]].assign(severe=severe, found=ids)
            yield out.assign(earlier=[[] for _ in ids])

    schema = "row bigint, fold int, low_quality int, toxic int, severe int, found array<int>, earlier array<double>"
    rows = store(taught.mapInPandas(in_slices(number), schema), "toxicity-rows")
    weights, threshold = [], 2.0
    for category in CHAIN:
        fitted = store(_fit_category(rows, category, features), "toxicity-fitted")
        whole = fitted.where("weights is not null").first()
        width = len(names) + CHAIN.index(category) + 1
        weights.append(np.array(whole.weights).reshape(width, 2) if whole else np.concatenate([np.zeros((width - 1, 2)), [[0.0, -50.0]]]))
        p = fitted.where("weights is null").select("row", "p")
        if category == "toxic":  # as many rows as the sample
            threshold = best_threshold(rows.select("row", "toxic").join(p, "row").toPandas())
        rows = store(rows.join(p, "row").withColumn("earlier", F.concat("earlier", F.array("p"))).drop("p"), "toxicity-rows")
    return Chain(CHAIN, features, weights, threshold)


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        terms = []
        for text in batch["text"]:
            words = set(WORD.findall(text.lower()))
            terms.append(sorted(words | {word[:n] + "*" for n in BEGINNINGS for word in words if len(word) > n}))
        yield batch.drop(columns="text").assign(terms=terms)


def choose_features(taught: DataFrame) -> tuple[dict[str, int], list[str]]:
    """Terms whose odds differ between documents with and without a category, and marker words. Bounded by the sample."""
    totals = taught.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("low_quality", "toxic")]).first()
    if not totals.n:
        return {}, []
    counted = taught.select("low_quality", "toxic", F.explode("terms").alias("term")).groupBy("term")
    counted = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("low_quality").alias("low_quality"), F.sum("toxic").alias("toxic"))
    counted = counted.where(F.col("n") >= LEAST_DOCUMENTS)

    def score(category: str) -> Column:
        """The root of the likelihood ratio of the term's counts with and without the category."""
        yes, n, all_yes, all_n = F.col(category), F.col("n"), float(totals[category]), float(totals.n)
        cells = (
            (yes, n * all_yes / all_n),
            (n - yes, n * (all_n - all_yes) / all_n),
            (all_yes - yes, (all_n - n) * all_yes / all_n),
            (all_n - n - all_yes + yes, (all_n - n) * (all_n - all_yes) / all_n),
        )
        return F.sqrt(F.greatest(2 * reduce(add, [F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0) for seen, due in cells]), F.lit(0.0)))

    chosen = [c for c in ("low_quality", "toxic") if 0 < totals[c] < totals.n]
    if not chosen:
        return {}, []
    best = F.greatest(*[score(c) for c in chosen], F.lit(0.0))
    likelier = (F.col("toxic") + 0.5) / (float(totals.toxic) + 1) / ((F.col("n") - F.col("toxic") + 0.5) / (float(totals.n - totals.toxic) + 1))
    found = counted.where(best >= LEAST_SCORE).select("term", (likelier >= MARKER_RATIO).alias("marker")).orderBy("term").collect()
    return {row.term: i for i, row in enumerate(found)}, [row.term for row in found if row.marker and not row.term.endswith("*")]


def _fit_category(rows: DataFrame, category: str, features: dict[str, int]) -> DataFrame:
    """row, p: out of fold; and one row with the weights of the model of all folds."""
    n_features = len(features)

    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        fold = key[0]
        y = frame[category].to_numpy()
        data = Rows(frame["found"].tolist(), n_features, np.array(frame["earlier"].tolist(), dtype=float).reshape(len(frame), -1))
        learn = frame["fold"].to_numpy() != fold
        n_yes = int(y[learn].sum())
        if 0 < n_yes < int(learn.sum()):
            weight = np.where(y == 1, min(10.0, (learn.sum() - n_yes) / n_yes), 1.0) * learn
            weights = fit(data, np.column_stack([1 - y, y]).astype(float), weight)
        else:
            share = y[learn].mean() if learn.any() else 0.0
            bias = np.log(max(share, 1e-12)) - np.log(max(1 - share, 1e-12))
            weights = np.zeros((n_features + data.dense.shape[1] + 1, 2))
            weights[-1, 1] = bias
        if fold == FOLDS:
            return pd.DataFrame({"row": [-1], "p": [0.0], "weights": [weights.reshape(-1)]})
        p = softmax(data.dot(weights[:-1]) + weights[-1])[:, 1]
        del data
        hand_back()
        return pd.DataFrame({"row": frame["row"][~learn], "p": p[~learn], "weights": None})

    models = rows.withColumn("model", F.explode(F.array(*[F.lit(i) for i in range(FOLDS + 1)])))
    return models.groupBy("model").applyInPandas(work, "row bigint, p double, weights array<double>")


def best_threshold(judged: pd.DataFrame) -> float:
    """The probability from which most out-of-fold documents are told right, in the middle of its gap; over 1 if there is nothing to tell."""
    if judged.empty or judged["toxic"].nunique() < 2:
        return 2.0
    judged = judged.sort_values("p")
    p, y = judged["p"].to_numpy(), judged["toxic"].to_numpy()
    # Everything from i on is called toxic.
    right = CLEAN_WEIGHT * np.concatenate([[0], np.cumsum(y == 0)]) + y.sum() - np.concatenate([[0], np.cumsum(y == 1)])
    cuts = np.concatenate([[0.0], (p[1:] + p[:-1]) / 2, [1.0]])
    distinct = np.concatenate([[True], p[1:] > p[:-1], [True]])
    best = np.flatnonzero(distinct & (right == right[distinct].max()))
    return float(cuts[best[np.abs(cuts[best] - 0.5).argmin()]])
