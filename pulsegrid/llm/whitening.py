"""Embedding whitening: covariance by one aggregation of upper-triangle products, eigenvectors by LAPACK.

Entries become whole numbers, so counts, sums and products are exact and do not
depend on the order of summing: products are centred at the whole number next
to each mean, and what is left of the means is taken off exactly afterwards.
Only sums reach the driver: D * (D + 1) / 2 of them for D dimensions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import materialise

#: x = floor(SCALE * entry) + SHIFT, held within +-LARGEST.
SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 40
COMPONENTS = 8
#: A component whose share of the largest eigenvalue is not above this (times D) is rounding, not spread.
ROUNDING = float(np.finfo(float).eps)
_LONG = 1 << 63
_PART = 2048


@dataclass
class Fit:
    """n vectors, their exact sums, covariance, and components by falling eigenvalue (columns of unit vectors)."""

    n: int
    sums: list[int]
    spread: int  # largest |n * x - sum| of any entry
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def usable(self) -> int:
        d = len(self.values)
        return int(np.count_nonzero(self.values > d * ROUNDING * max(self.values[0], 0.0))) if d else 0


def whole_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x, the vector as whole numbers.

    Rows whose vector is null, empty or holds a null, NaN or infinite entry are
    dropped.  Of vectors of several lengths, those of the most common length
    stay (of two as common, the longer).  Entries beyond +-LARGEST are held there.
    """
    entries = F.col(vector).cast("array<double>")
    good = vectors.select("vec_id", entries.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < F.lit(math.inf))))
    lengths = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    # a double takes every value that floor() can give exactly once it is held within LARGEST
    whole = F.transform("v", lambda c: (F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c * SCALE))) + SHIFT).cast("long"))
    return good.where(F.size("v") == F.lit(lengths[0]["d"] if lengths else 0)).select("vec_id", whole.alias("x"))


def _dimension(whole: DataFrame) -> int:
    found = whole.select(F.size("x").alias("d")).limit(1).collect()
    return found[0]["d"] if found else 0


def fit(whole: DataFrame) -> Fit:
    """Two aggregations without keys: counts, sums and bounds, then all upper-triangle products."""
    d = _dimension(whole)
    if not d:
        return Fit(0, [], 0, np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    each = [f(i) for f in ("sum(cast(x[{}] as decimal(28,0)))".format, "min(x[{}])".format, "max(x[{}])".format) for i in range(d)]
    first = list(whole.selectExpr("count(*)", *each).head())
    n, sums, low, high = first[0], [int(s) for s in first[1 : d + 1]], first[d + 1 : 2 * d + 1], first[2 * d + 1 :]
    centres = [(2 * s + n) // (2 * n) for s in sums]
    reach = max(max(h - c, c - b) for b, h, c in zip(low, high, centres))
    # whole numbers whose sums stay below 2**53 are exact as doubles; others are summed as decimals
    kind = "double" if n * reach * reach < 1 << 53 else "decimal(19,0)"
    centred = whole.selectExpr(*[f"cast(coalesce(x[{i}] - {c}L, 0L) as {kind}) as y{i}" for i, c in enumerate(centres)])
    found = list(centred.selectExpr(*[f"sum(y{i} * y{j})" for i in range(d) for j in range(i, d)]).head())
    rest = [s - n * c for s, c in zip(sums, centres)]
    covariance, at = np.zeros((d, d)), 0
    for i in range(d):
        for j in range(i, d):
            covariance[i, j] = covariance[j, i] = (n * int(found[at]) - rest[i] * rest[j]) / (n * n)
            at += 1
    values, vectors = np.linalg.eigh(covariance)
    spread = max(max(n * h - s, s - n * b) for b, h, s in zip(low, high, sums))
    return Fit(n, sums, spread, covariance, values[::-1], vectors[:, ::-1])


def _projected(fitted: Fit, k: int):
    n, d = fitted.n, len(fitted.sums)
    centres = np.array([(2 * s + n) // (2 * n) for s in fitted.sums], np.int64)
    rest = np.array([(s - n * int(c)) / n for s, c in zip(fitted.sums, centres)])
    onto = fitted.vectors[:, :k] / np.sqrt(fitted.values[:k])
    exact = d * fitted.spread * fitted.spread < _LONG
    sums = np.array(fitted.sums, np.int64 if exact else object)
    schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _PART):
                part = whole.slice(at, _PART)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                off = (n * x if exact else n * x.astype(object)) - sums
                deviation = (off * off).sum(axis=1).tolist()
                white = ((x - centres) - rest) @ onto
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1, dtype=np.int32) * k), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([v if v < _LONG else None for v in deviation], pa.int64()), rows], schema=schema)

    return run


def _identity_error(white: DataFrame, k: int) -> float:
    """The largest entry of the covariance of the whitened rows less the identity, measured on them."""
    means = list(white.agg(*[F.avg(F.col("whitened")[i]) for i in range(k)]).head())
    centred = white.select(*[(F.col("whitened")[i] - F.lit(m)).alias(f"w{i}") for i, m in enumerate(means)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = centred.agg(*[F.avg(F.col(f"w{i}") * F.col(f"w{j}")) for i, j in pairs]).head()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found))


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """One row for each remaining vector and component up to `components`, as columns:

    vec_id, component (int, from 1 by falling eigenvalue), n (vectors the fit is
    over), deviation (sum over dimensions of (n * x - sum)^2, exact; null where no
    long holds it), whitened (the centred vector on the component over the root
    of its eigenvalue), explained (eigenvalue over trace), identity_error.

    Rows with a null, empty or not finite vector are dropped (whole_vectors).
    There are no more components than dimensions in which the vectors differ:
    none, and no rows, for an empty table or equal vectors.  Repeated rows count
    as often as they occur and null ids are kept; other columns are ignored.
    No shuffle but of partial sums.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, vector)
    fitted = fit(whole)
    k = min(components, fitted.usable)
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return spark.createDataFrame([], kinds)
    white = materialise(whole.select(F.col("vec_id").cast("long"), "x").mapInArrow(_projected(fitted, k), "vec_id long, deviation long, whitened array<double>"), "whitened")
    trace = float(np.trace(fitted.covariance))
    shares: Column = F.array(*[F.lit(float(v) / trace) for v in fitted.values[:k]])
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("place")].alias("explained"), F.lit(_identity_error(white, k)).alias("identity_error"),
    )
