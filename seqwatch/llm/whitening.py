"""Embedding whitening: a covariance weighted by multiplicity, fitted on distinct vectors.

Vectors are rounded to whole numbers, so equal ones are found exactly. Each distinct vector is kept once with
the number of its copies; the covariance is a weighted product of centred matrices over the distinct
ones, task by task, and each is whitened once. Rows then get their vector's values back by its digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqwatch.llm.common import store

SCALE, SHIFT = 64, 1_000_000
#: Components that are returned, at most.
COMPONENTS = 32
#: Entries beyond this, scaled, are taken for it.
LARGEST = 1 << 52
#: Eigenvalues up to this share of the largest are no variance, but rounding.
NEGLIGIBLE = 1e-11
_WHOLE = pa.decimal128(38, 0)


@dataclass
class Whitener:
    """What a fit list of vectors of one length gives: size, sums, and for each component its direction and eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return whole_deviations(x, self.n, self.sums).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions / np.sqrt(self.values)


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    weights: str = "counts",
    scale: int = SCALE,
    shift: int = SHIFT,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out. An entry c becomes ``floor(scale * c) + shift``, a whole number;
    beyond 2^52 before the shift it is taken as that. With ``weights="counts"`` the fit list has every vector, with
    ``"one"`` each distinct one once; all are whitened either way. n is the list's size and S its sums; ``deviation`` is the sum of
    (n x - S)^2, exact, null where it doesn't fit a long. Components have falling eigenvalues and the sign that makes
    their largest entry positive. A component without variance is none: if all vectors are equal, or there is but one, there are no rows.
    ``identity_error`` is over the whitened values as returned.

    Vectors of different lengths are different lists, each fitted by itself; empty ones have no component. Repeated and null ids are rows
    of their own. An empty table gives an empty result. Other columns are ignored.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights are 'counts' or 'one'")
    usable = F.col(embedding).isNotNull() & F.forall(
        embedding, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    )
    whole = F.transform(embedding, lambda c: _whole(c.cast("double"), scale, shift))
    rows = vectors.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("x"))
    rows = rows.where(F.size("x") > 0).withColumn("key", _digest(F.col("x")))

    distinct = store(rows.groupBy("key").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("copies")), "whitening-distinct")
    weight = F.col("copies") if weights == "counts" else F.lit(1).cast("long")
    fitted = fit(distinct.select("x", weight.alias("weight")), components)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, at in _matrices(batch.column("x")):
                model = fitted[x.shape[1]]
                values = model.whitened(x)
                found = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(at) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.reshape(-1))
                )
                taken = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(taken), batch.column("weight").take(taken), pa.array(np.full(len(at), x.shape[1], np.int32)),
                        pa.array(exact_deviations(x, model.n, model.sums), pa.int64()), found,
                    ],
                    names=["key", "weight", "dim", "deviation", "whitened"],
                )

    schema = "key binary, weight bigint, dim int, deviation bigint, whitened array<double>"
    done = store(distinct.select("key", "x", weight.alias("weight")).mapInArrow(apply, schema), "whitening-done")
    errors = identity_errors(done, fitted)

    # As many rows as there are lengths of vectors, each with as many numbers as components.
    models = done.sparkSession.createDataFrame(
        [(dim, model.n, model.explained.tolist(), errors[dim]) for dim, model in fitted.items()],
        "dim int, n bigint, explained array<double>, identity_error double",
    )
    back = rows.select("vec_id", "key").join(done.drop("weight"), "key").join(models, "dim")
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "one")
    return back.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("one.whitened"), F.col("one.explained"), "identity_error"
    )


def _whole(entry: Column, scale: int, shift: int) -> Column:
    largest = float(LARGEST)
    return F.floor(F.least(F.greatest(entry * F.lit(float(scale)), F.lit(-largest)), F.lit(largest))) + F.lit(shift).cast("long")


def _digest(x: Column) -> Column:
    """Equal for equal vectors of whole numbers, and for no others."""
    return F.unhex(F.sha2(F.array_join(x.cast("array<string>"), ","), 256))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """A whitener for each length among the vectors ``x`` of whole numbers, of which each counts ``weight`` times."""
    sums = distinct.mapInArrow(_add_sums, "dim int, at int, weight bigint, total decimal(38,0)").groupBy("dim", "at")
    found: dict[int, tuple[int, list[int]]] = {}
    # As many rows as one vector of each length has entries.
    for row in sums.agg(F.sum("weight").alias("weight"), F.sum("total").alias("total")).orderBy("dim", "at").collect():
        found.setdefault(row.dim, (row.weight, []))[1].append(int(row.total))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products: dict[int, np.ndarray] = {}
        for batch in batches:
            for x, at in _matrices(batch.column("x")):
                n, total = found[x.shape[1]]
                y = whole_deviations(x, n, total).astype(np.float64) / n
                weight = batch.column("weight").take(pa.array(at)).to_numpy()
                product = y.T @ (y * weight[:, None])
                products[x.shape[1]] = products.get(x.shape[1], 0.0) + product
        yield from _upper_halves(products)

    halves = distinct.mapInArrow(multiply, _HALVES).groupBy("dim", "i", "j").agg(F.sum("product").alias("product"))
    matrices = {dim: np.zeros((dim, dim)) for dim in found}
    for row in halves.toLocalIterator():  # a square of one vector's entries for each length, whatever the number of vectors
        matrices[row.dim][row.i, row.j] = matrices[row.dim][row.j, row.i] = row.product
    return {dim: _solve(n, total, matrices[dim] / n, components) for dim, (n, total) in found.items()}


def _solve(n: int, sums: list[int], covariance: np.ndarray, components: int) -> Whitener:
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1], directions[:, ::-1]
    kept = min(components, int((values > max(values[0], 0.0) * NEGLIGIBLE).sum()))
    values, directions = values[:kept], directions[:, :kept]
    if kept:
        largest = directions[np.abs(directions).argmax(axis=0), np.arange(kept)]
        directions = directions * np.where(largest < 0, -1.0, 1.0)
    return Whitener(n, sums, values, directions, values / np.trace(covariance) if kept else values)


def identity_errors(done: DataFrame, fitted: dict[int, Whitener]) -> dict[int, float | None]:
    """For each length the largest entry, without sign, of the whitened values' covariance less the identity."""
    kept = {dim: len(model.values) for dim, model in fitted.items()}
    sizes = {dim: model.n for dim, model in fitted.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if kept[dim]:
                    mine = pa.array(np.flatnonzero(dims == dim))
                    values = batch.column("whitened").take(mine).flatten().to_numpy().reshape(-1, kept[dim])
                    weight = batch.column("weight").take(mine).to_numpy()
                    totals[dim] = totals.get(dim, 0.0) + weight @ values
        for dim, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(total), dim, np.int32)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["dim", "at", "total"]
            )

    means = {dim: np.zeros(k) for dim, k in kept.items()}
    for row in done.mapInArrow(add, "dim int, at int, total double").groupBy("dim", "at").agg(F.sum("total").alias("total")).collect():
        means[row.dim][row.at] = row.total / sizes[row.dim]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if kept[dim]:
                    mine = pa.array(np.flatnonzero(dims == dim))
                    y = batch.column("whitened").take(mine).flatten().to_numpy().reshape(-1, kept[dim]) - means[dim]
                    products[dim] = products.get(dim, 0.0) + y.T @ (y * batch.column("weight").take(mine).to_numpy()[:, None])
        yield from _upper_halves(products)

    matrices = {dim: np.zeros((k, k)) for dim, k in kept.items()}
    halves = done.mapInArrow(multiply, _HALVES).groupBy("dim", "i", "j").agg(F.sum("product").alias("product"))
    for row in halves.collect():  # a square of the components for each length
        matrices[row.dim][row.i, row.j] = matrices[row.dim][row.j, row.i] = row.product
    return {dim: float(np.abs(m / sizes[dim] - np.eye(len(m))).max()) if len(m) else None for dim, m in matrices.items()}


# Numbers of a task


_HALVES = "dim int, i int, j int, product double"


def _upper_halves(products: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for dim, product in products.items():
        i, j = np.triu_indices(len(product))
        columns = [np.full(len(i), dim, np.int32), i.astype(np.int32), j.astype(np.int32), product[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "i", "j", "product"])


def _matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of each length as a matrix, with their places in the batch."""
    lengths = np.diff(lists.offsets.to_numpy())
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        mine = lists if len(at) == len(lists) else lists.take(pa.array(at))
        yield mine.flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim), at


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, list] = {}
    for batch in batches:
        for x, at in _matrices(batch.column("x")):
            weight = batch.column("weight").take(pa.array(at)).to_numpy()
            # The product of two longs may not be one.
            small = int(np.abs(x).max()) * int(weight.sum()) < 1 << 62
            added = (weight @ x).tolist() if small else (weight.astype(object) @ x.astype(object)).tolist()
            held = totals.setdefault(x.shape[1], [0, [0] * x.shape[1]])
            held[0] += int(weight.sum())
            held[1] = [a + b for a, b in zip(held[1], added, strict=True)]
    for dim, (weight, total) in totals.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, weight)),
                pa.array([Decimal(t) for t in total], _WHOLE),
            ],
            names=["dim", "at", "weight", "total"],
        )


def whole_deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as longs where these hold it, else as Python's numbers."""
    largest = int(np.abs(x).max()) if x.size else 0
    if n * largest + max(map(abs, sums)) < 1 << 62:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def exact_deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """For each row the sum of (n x - S)^2; none where a long can't hold it."""
    y = whole_deviations(x, n, sums)
    largest = int(np.abs(y).max()) if y.size else 0
    if largest * largest * x.shape[1] < 1 << 62:
        return (y * y).sum(axis=1).tolist()
    totals = (y.astype(object) ** 2).sum(axis=1).tolist()
    return [int(t) if t < 1 << 63 else None for t in totals]
