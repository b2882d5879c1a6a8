"""Toxicity severity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import bounded
from pulsegrid.llm.features import FEATURES, PER_CLASS, Adam, Selected, feature_lists, labelled_sample, row_sums, select_features, sparse_rows

ROUNDS, PENALTY = 250, 2e-4


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(z / 2))


@dataclass
class OrdinalModel:
    """P(grade > k | x) = sigmoid(w.x - cuts[k]): one weight vector for all ordered cuts."""

    hashes: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        return _sigmoid(np.asarray(scores)[:, None] - self.cuts[None, :])


def fit_ordinal(grades: np.ndarray, starts: np.ndarray, places: np.ndarray, n_features: int, n_grades: int, rounds: int = ROUNDS, penalty: float = PENALTY):
    """(weights, ascending cuts) of a cumulative logit model, by full-batch likelihood ascent; rows are weighted so that grades count alike."""
    n, k = len(grades), n_grades - 1
    share = np.bincount(grades, minlength=n_grades).astype(float)
    weight = (1 / np.maximum(share, 1))[grades]
    weight /= weight.sum()
    w, first, gaps = np.zeros(n_features), np.array([0.5]), np.zeros(max(0, k - 1))
    row = np.repeat(np.arange(n), np.diff(starts))
    adam = Adam([w.shape, first.shape, gaps.shape], 0.08)
    for _ in range(rounds):
        cuts = np.concatenate((first, first + np.cumsum(np.exp(gaps))))
        p = _sigmoid(row_sums(w[places], starts)[:, None] - cuts[None, :])
        # probability of the own grade: P(> y-1) - P(> y)
        full = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), axis=1)
        own = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-9)
        d = p * (1 - p) / own[:, None] * weight[:, None]
        lower = (np.arange(k)[None, :] == grades[:, None] - 1) * d
        upper = (np.arange(k)[None, :] == grades[:, None]) * d
        gain = lower - upper  # of the likelihood, by the score less each cut
        by_row = gain.sum(axis=1)
        gw = -np.bincount(places, by_row[row], n_features) + penalty * w
        gc = gain.sum(axis=0)
        gf = np.array([gc.sum()])
        gg = np.array([gc[j + 1 :].sum() * np.exp(gaps[j]) for j in range(k - 1)])
        adam.step([w, first, gaps], [gw, gf, gg])
    return w, np.concatenate((first, first + np.cumsum(np.exp(gaps))))


def doses(counts: np.ndarray, starts: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Distinct features of each row that are at least 20 times as frequent among the toxic (last column of counts)."""
    rate = (counts + 0.1) / np.maximum(sizes, 1)
    strong = rate[:, -1] >= 20 * rate[:, :-1].max(axis=1)
    return row_sums(strong[places].astype(float), starts).astype(int)


def fit(docs: DataFrame, labels: DataFrame, levels: int = 3, per_class: int = PER_CLASS, features: int = FEATURES) -> OrdinalModel:
    """A severity model with grades 0 to `levels` from labels (doc_id, toxic [, severity]).

    A severity column is taken as the grades.  Without one, grade 0 is toxic 0,
    and toxic documents are graded by dose: the quantile, among the toxic of
    the sample, of the number of their features that are far more frequent in
    toxic documents.  Of each class at most per_class documents are used.  Of
    several labels of a document the worst holds.  Without both classes the model scores 0.
    """
    graded = "severity" in labels.columns
    clean = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("severity" if graded else "toxic").alias("y"))
    clean = clean.withColumn("class", F.least(F.col("y").cast("int"), F.lit(levels if graded else 1)).cast("string"))
    classes = [str(i) for i in range(levels + 1 if graded else 2)]
    sample = labelled_sample(docs, clean, classes, per_class)
    hashes, counts = select_features(sample, classes, features)
    y, _, starts, places = sparse_rows(sample, hashes)
    y = np.array(y, int)
    if len(set(y.tolist())) < 2:
        return OrdinalModel(hashes, np.zeros(len(hashes)), np.arange(1.0, levels + 1))
    if not graded:
        dose = doses(counts, starts, places, np.bincount(y, minlength=2))
        edges = np.quantile(dose[y == 1], np.arange(1, levels) / levels)
        y = np.where(y == 1, 1 + np.searchsorted(edges, dose, side="left"), 0)
    weights, cuts = fit_ordinal(y, starts, places, len(hashes), levels + 1)
    return OrdinalModel(hashes, weights, cuts)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """One row for each row of docs: doc_id, score, p_toxic, expected_severity, severity (most likely grade), toxic.

    Whole texts; a feature counts once however often it occurs.  A null or
    empty text has no feature.  No shuffle.  toxic: p_toxic >= 0.5.  Where the
    labels had no severity, grades are doses (see fit): a high expected severity
    says that many words typical of toxic texts are there, not how grave they are.
    Of equally likely grades the lowest is taken; null and repeated ids are rows like others.
    """

    def run(batches):
        known = Selected(model.hashes)
        for b in bounded(batches):
            scores = np.array([model.weights[np.unique(known.places(f))].sum() for f, _ in feature_lists(b.column("text"))], float)
            above = model.above(scores)
            full = np.concatenate((np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))), axis=1)
            grade = (full[:, :-1] - full[:, 1:]).argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(scores), pa.array(above[:, 0]), pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int64)), pa.array(above[:, 0] >= 0.5)],
                names=["doc_id", "score", "p_toxic", "expected_severity", "severity", "toxic"],
            )

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(run, "doc_id long, score double, p_toxic double, expected_severity double, severity long, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, levels: int = 3) -> DataFrame:
    """score() of docs by a model fitted to labels."""
    return score(docs, fit(docs, labels, levels))
