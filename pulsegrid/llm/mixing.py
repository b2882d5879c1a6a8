"""Mixing to target weights: soft domain memberships and nonnegative document rates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import materialise
from pulsegrid.llm.features import FEATURES, PER_CLASS, Adam, Selected, feature_lists, labelled_sample, row_sums, select_features, sparse_rows

#: Pull of all rates towards 1, most iterations, and the largest miss of a target share at which they stop.
PULL, ROUNDS, MISS = 1e-3, 60, 1e-5


@dataclass
class DomainModel:
    domains: list[str]
    hashes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, scores: np.ndarray) -> np.ndarray:
        z = scores + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit_domains(docs: DataFrame, labels: DataFrame, domains: list[str], per_class: int = PER_CLASS, features: int = FEATURES, rounds: int = 150) -> DomainModel:
    """Multinomial logistic regression of labels (doc_id, domain) on sparse text features.

    Labels of documents that docs lacks don't count.  At most per_class
    documents of each domain are used; the bias is then set to the shares that
    all labelled documents have.  Of several labels of a document the smallest
    name holds.  A domain without labelled documents has no share to be set
    to: its bias stays where the fit, which never sees it, puts it.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("class"))
    own = materialise(own.join(docs.select("doc_id"), "doc_id", "left_semi"), "domains")
    shares = {r["class"]: r["n"] for r in own.groupBy("class").agg(F.count("*").alias("n")).collect()}
    sample = labelled_sample(docs, own, domains, per_class)
    hashes, _ = select_features(sample, domains, features)
    y, _, starts, places = sparse_rows(sample, hashes)
    k, n = len(domains), len(y)
    w, bias = np.zeros((len(hashes), k)), np.zeros(k)
    prior = np.log(np.array([shares.get(d, 0) + 1e-3 for d in domains]))
    if n and len(hashes):
        y = np.array([domains.index(c) for c in y])
        truth = np.eye(k)[y]
        row = np.repeat(np.arange(n), np.diff(starts))
        adam = Adam([w.shape, bias.shape], 0.05)
        model = DomainModel(domains, hashes, w, bias)
        for _ in range(rounds):
            off = (model.posteriors(row_sums(w[places], starts)) - truth) / n
            grad = np.stack([np.bincount(places, off[row, j], len(hashes)) for j in range(k)], axis=1)
            adam.step([w, bias], [grad + 1e-4 * w, off.sum(axis=0)])
        sampled = np.log(np.bincount(y, minlength=k) + 1e-3)
        bias = bias + prior - sampled - (prior - sampled).mean()
    return DomainModel(domains, hashes, w, bias)


def memberships(docs: DataFrame, model: DomainModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of each row of docs, with n_tokens (words) and posteriors (array, in the order of the model's domains).

    One pass over the text gives both; the other columns don't leave the JVM.
    """
    kind = pa.struct([("n_tokens", pa.int64()), ("posteriors", pa.list_(pa.float64()))])

    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Selected(model.hashes)
        for column in texts:
            scores, sizes = np.zeros((len(column), len(model.domains))), np.zeros(len(column), np.int64)
            for i, (f, n) in enumerate(feature_lists(column)):
                scores[i], sizes[i] = model.weights[np.unique(known.places(f))].sum(axis=0), n
            flat = pa.array(model.posteriors(scores).ravel())
            starts = pa.array(np.arange(len(column) + 1, dtype=np.int32) * len(model.domains))
            yield pa.StructArray.from_arrays([pa.array(sizes), pa.ListArray.from_arrays(starts, flat)], fields=list(kind))

    judge = F.arrow_udf(judged, "n_tokens long, posteriors array<double>")
    kept = [F.col(f"`{c}`") for c in keep if c not in ("n_tokens", "posteriors")]
    return docs.select(*kept, judge(F.col("text").cast("string")).alias("_m")).select(*kept, "_m.n_tokens", "_m.posteriors")


def _rates(p: np.ndarray, misses: list[np.ndarray], pull: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the iterations of which the misses are known, and the point at which the next gradient is taken."""
    r = np.ones(len(p))
    y, t = r, 1.0
    for u in misses:
        following = np.maximum(0, y - (p @ u + pull * (y - 1)) / (1 + pull))
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = np.maximum(0, following + (t - 1) / t1 * (following - r))
        r, t = following, t1
    return r, y


def fit_rates(members: DataFrame, targets: list[float], pull: float = PULL, rounds: int = ROUNDS, miss: float = MISS) -> list[np.ndarray]:
    """The misses of each iteration of projected gradient descent, from which any document's rate follows.

    Minimises, over rates r >= 0, half the squared misses of the domains'
    expected token shares, sum_i r_i w_i p_ik - target_k, each over the share
    the domain has at rate 1, plus half the pull times the token-weighted
    squares of r_i - 1.  Scaled so, the largest curvature is at most 1 plus the
    pull, which sets the step; steps are accelerated.  An iteration is one
    aggregate of as many sums as there are domains: the rates aren't stored,
    each task replays them from the misses so far.
    """
    k = len(targets)
    goal = np.array(targets, float) / sum(targets)

    def sums(misses):
        def run(batches):
            total = np.zeros(2 * k + 1)
            for b in batches:
                p = b.column("posteriors").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                w = b.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
                r, y = _rates(p, misses, pull)
                total += np.concatenate(((y * w) @ p, (r * w) @ p, [w.sum()]))
            yield pa.RecordBatch.from_arrays([pa.array([list(total)])], names=["s"])

        parts = members.select("n_tokens", "posteriors").mapInArrow(run, "s array<double>")
        return np.array(parts.agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(2 * k + 1)]).first(), dtype=float)

    misses: list[np.ndarray] = []
    first = sums(misses)
    if not first[-1] > 0:
        return misses
    scale = np.maximum(first[:k] / first[-1], 1e-6)
    now = first
    for _ in range(rounds):
        misses.append((now[:k] / first[-1] - goal) / scale)
        now = sums(misses)
        if np.abs(now[k : 2 * k] / first[-1] - goal).max() < miss:
            break
    return misses


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], pull: float = PULL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of docs: columns `keep` of it, n_tokens, posteriors, domain (the most likely), rate (double, >= 0).

    labels: (doc_id, domain); targets: share of expected tokens of each domain
    (at most a few dozen; scaled to sum 1).  Rates times expected tokens meet
    the targets as nearly as nonnegative rates can.  Null and empty texts have
    no tokens and the prior as posteriors; documents with the same posteriors
    have the same rate, rows with a null doc_id too.  Kept columns with a name
    of a new one are replaced; columns not kept are ignored.  Texts are read
    once for the scores: what is kept is written beside them, and no join
    brings it back.
    """
    domains = sorted(targets)
    model = fit_domains(docs, labels, domains)
    members = materialise(memberships(docs, model, keep), "memberships")
    misses = fit_rates(members, [targets[d] for d in domains], pull)

    def rated(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = pa.array(domains)
        for column in columns:
            p = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(domains))
            yield pa.StructArray.from_arrays([names.take(pa.array(p.argmax(axis=1))), pa.array(_rates(p, misses, pull)[0])], names=["domain", "rate"])

    rate = F.arrow_udf(rated, "domain string, rate double")
    kept = [F.col(f"`{c}`") for c in members.columns if c not in ("domain", "rate")]
    return members.select(*kept, rate("posteriors").alias("_r")).select(*kept, "_r.domain", "_r.rate")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of quality and toxic marks: junk, toxic or clean."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")
