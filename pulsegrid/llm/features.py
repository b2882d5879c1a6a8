"""Sparse text features and bounded training samples for the small classifiers of this subpackage."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import bounded, hash_kinds, materialise, text_blocks

#: Labelled documents of each class that a fit uses at most, and features it selects.
PER_CLASS, FEATURES = 3000, 4096
#: A feature must occur in so many documents of the sample, and tell classes apart with so much chi square: chance gives it to none of a million features.
LEAST_DOCS, LEAST_CHI = 5, 40.0

#: Plain words, the first five bytes of longer ones and runs of punctuation, each with a salt; and words, for counts.
_KINDS = [("plain", 0), ("plain", 5), ("punctuation", 0), ("word", 0)]
_SALTS = [np.uint64(0x51), np.uint64(0xA7), np.uint64(0xF3)]


def feature_lists(texts):
    """For each text (the features it has, its number of words): plain words, their first five bytes, runs of punctuation, all lower-cased, with repeats."""
    for _, block, first in text_blocks(texts):
        found = hash_kinds(block, first, True, _KINDS)
        cuts = [np.searchsorted(start, first) for _, start in found]
        for i in range(len(first) - 1):
            parts = [h[cut[i] : cut[i + 1]] ^ salt for (h, _), cut, salt in zip(found, cuts, _SALTS)]
            yield np.concatenate(parts).view(np.int64), int(cuts[-1][i + 1] - cuts[-1][i])


class Selected:
    """Places of the selected features, found by a bit table before a search."""

    def __init__(self, hashes):
        self.hashes = np.sort(np.asarray(hashes, np.int64))
        self.table = np.zeros(1 << 20, bool)
        self.table[self.hashes & 0xFFFFF] = True

    def places(self, found: np.ndarray) -> np.ndarray:
        """Place of each occurrence of a selected feature, in order, with repeats."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        found = found[self.table[found & 0xFFFFF]]
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        return at[self.hashes[at] == found]


def labelled_sample(docs: DataFrame, labels: DataFrame, classes: list[str], per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, class, text) of at most per_class documents of each class, those first in the order of a hash of the id.

    labels: (doc_id, class), one row an id; ids are picked before texts are read, and number at most
    per_class times the classes, so the pick is broadcast.  Of several texts of an id the smallest counts.
    """
    picked = [labels.where(F.col("class") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in classes]
    picked = materialise(reduce(DataFrame.unionByName, picked).select("doc_id", "class"), "sample-ids")
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return materialise(texts.groupBy("doc_id", "class").agg(F.min("text").alias("text")), "sample")


def select_features(sample: DataFrame, classes: list[str], most: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, documents of each class that have them) of the features that tell the classes apart best, by chi square."""

    def distinct(batches):
        schema = pa.schema([("class", pa.string()), ("f", pa.list_(pa.int64()))])
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([b.column("class"), pa.array([np.unique(f) for f, _ in feature_lists(b.column("text"))], schema.types[1])], schema=schema)

    each = sample.select("class", "text").mapInArrow(distinct, "class string, f array<long>").select("class", F.explode("f").alias("f"))
    sizes = {r["class"]: r["n"] for r in sample.groupBy("class").agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(sizes.values()))
    has = [F.sum((F.col("class") == c).cast("long")).alias(f"n{i}") for i, c in enumerate(classes)]
    n = F.col("n")
    # (observed - expected)^2 / expected, over the classes
    chi = sum((F.col(f"n{i}") - n * (sizes.get(c, 0) / total)) ** 2 / (n * max(sizes.get(c, 0), 0.5) / total) for i, c in enumerate(classes))
    best = each.groupBy("f").agg(F.count("*").alias("n"), *has).where(n >= LEAST_DOCS).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "f").limit(most).collect()
    best.sort(key=lambda r: r["f"])
    return np.array([r["f"] for r in best], np.int64), np.array([[r[f"n{i}"] for i in range(len(classes))] for r in best]).reshape(len(best), len(classes))


def sparse_rows(sample: DataFrame, selected: np.ndarray):
    """(classes, ids, row starts, places, repeats) of the bounded sample's selected features, on the driver."""

    def run(batches):
        known = Selected(selected)
        schema = pa.schema([("doc_id", pa.int64()), ("class", pa.string()), ("p", pa.list_(pa.int32())), ("n", pa.int64())])
        for b in bounded(batches):
            rows = [known.places(f) for f, _ in feature_lists(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("class"), pa.array([np.unique(r).astype(np.int32) for r in rows], schema.types[2]), pa.array([len(r) for r in rows], pa.int64())], schema=schema)

    rows = sample.select(F.col("doc_id").cast("long"), "class", "text").mapInArrow(run, "doc_id long, class string, p array<int>, n long").collect()
    rows.sort(key=lambda r: r["doc_id"])
    starts = np.concatenate(([0], np.cumsum([len(r["p"]) for r in rows]))).astype(np.int64)
    places = np.array([p for r in rows for p in r["p"]], np.int64)
    return [r["class"] for r in rows], [r["doc_id"] for r in rows], starts, places


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of values (rows of zero length give zero)."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)))
    return total[starts[1:]] - total[starts[:-1]]


class Adam:
    """Plain Adam on a list of arrays."""

    def __init__(self, shapes, rate=0.1):
        self.m, self.v, self.t, self.rate = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0, rate

    def step(self, params, grads):
        self.t += 1
        for p, g, m, v in zip(params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
