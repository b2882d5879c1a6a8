"""Quality rules with cutoffs whose false rejections are bounded by labelled holdouts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import bounded, hashed_texts, materialise, shingles

#: Base rule: fewest words, and most words (in hundredths) inside repeated windows of so many words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Of good documents, each stratum may lose this share to all rules together, but for this chance over all strata.
RISK, CHANCE = 0.05, 0.05
#: A rule rejects where its measure is above the cutoff; the cutoffs tried are fixed beforehand.
RULES = {
    "symbols": ("n_symbols / greatest(1, word_chars)", [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2]),
    "punctuation": ("n_punct / greatest(1, word_chars)", [0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4]),
    "capitals": ("n_upper / greatest(1, word_chars)", [0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7]),
    "dup_lines": ("n_dup_lines / greatest(1, n_lines)", [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7]),
    "repeats": ("n_repeat_words / greatest(1, n_words)", [0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3]),
}
#: A good document lost counts as so many bad ones let through when a cutoff is chosen among the safe ones.
COST = 5

_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punct", "n_upper"]
_SCHEMA = pa.schema([(m, pa.int64()) for m in _MEASURES])
_BLANKS = bytes([32, *range(9, 14)])
_NOT_A_CHAR = _BLANKS + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_UPPER = bytes(range(65, 91))


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that are found twice or more in the text, the first included."""
    h = shingles(words, window)
    if len(h) < 2:
        return 0
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(h, twice))
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return int(np.count_nonzero(np.cumsum(step[:-1])))


def _measure(raw: bytes, words: np.ndarray) -> tuple:
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANKS)]
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    return (
        len(words),
        len(raw) - without(_NOT_A_CHAR),
        without(_SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        without(_PUNCT),
        without(_UPPER),
    )


def _measured(batches):
    for batch in bounded(batches):
        columns = list(zip(*(_measure(raw.tobytes(), words) for words, raw in hashed_texts(batch.column("text"))))) or [[] for _ in _MEASURES]
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in rest), *(pa.array(c, pa.int64()) for c in columns)],
            schema=pa.schema([*(batch.schema.field(c) for c in rest), *_SCHEMA]),
        )


def measures(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys of docs with the measures of each whole text; a null text measures 0 throughout."""
    given = docs.select(*keys, F.col("text").cast("string"))
    schema = T.StructType([*given.drop("text").schema, *(T.StructField(m, T.LongType()) for m in _MEASURES)])
    return given.mapInArrow(_measured, schema)


# --------------------------------------------------------------- exact bounds


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(tiny, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 200_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            c = 1 + t / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def at_most(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    a, b, x = float(n - k), float(k + 1), 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(p))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, p) / b


def _choose(risk: float, level: float):
    """For each stratum's counts the cutoff of each rule, null where none is safe and useful."""

    def pick(good: int, lost, caught, cutoffs):
        best, chosen = 0, None
        for cut, k, bad in zip(cutoffs, lost, caught):
            if bad - COST * k > best and at_most(int(k), int(good), risk) <= level:
                best, chosen = bad - COST * k, cut
        return chosen

    def run(frames):
        for f in frames:
            out = f[["stratum"]].copy()
            for r, (_, cutoffs) in RULES.items():
                out[f"cut_{r}"] = [pick(g, k, b, cutoffs) for g, k, b in zip(f["good"], f[f"lost_{r}"], f[f"caught_{r}"])]
                out[f"cut_{r}"] = out[f"cut_{r}"].astype("float64")
            yield out

    return run


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, chance: float = CHANCE) -> DataFrame:
    """(stratum, cut_<rule> ...) from the measures (doc_id, stratum, ...) of labelled documents.

    All labelled rows are the holdout: the cutoffs tried don't depend on it.  A
    cutoff is safe in a stratum if, were its true share of rejected good
    documents above its part of the risk, so few rejections had a chance of at
    most its part of `chance` (a one-sided Clopper-Pearson bound).  The risk is
    split over the rules, the chance over all cutoffs of all rules and strata
    (Bonferroni), so all choices hold together.  Of the safe cutoffs of a rule
    the one that catches most bad documents, less COST for each good one, is
    taken; without a safe one that gains, the rule rejects nothing there.
    Rows of an id that occurs several times count as that many documents.
    """
    worst = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = measured.where(~F.col("base_failed")).join(worst, "doc_id")
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    columns = [count(good).alias("good")]
    for r, (expression, cutoffs) in RULES.items():
        above = [F.expr(expression) > c for c in cutoffs]
        columns += [F.array(*[count(good & x) for x in above]).alias(f"lost_{r}"), F.array(*[count(bad & x) for x in above]).alias(f"caught_{r}")]
    counts = materialise(held.groupBy("stratum").agg(*columns), "quality-counts")
    tests = max(1, counts.count()) * sum(len(c) for _, c in RULES.values())
    schema = T.StructType([counts.schema["stratum"], *(T.StructField(f"cut_{r}", T.DoubleType()) for r in RULES)])
    return counts.mapInPandas(_choose(risk / len(RULES), chance / tests), schema)


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, chance: float = CHANCE) -> DataFrame:
    """One row for each row of docs: doc_id, stratum, the measures, base_failed, failed (rules), kept.

    A document fails the base rule with fewer than LEAST_WORDS words or over
    MOST_REPEATED percent of its words in repeated windows; else it is kept
    unless a rule's measure is above the cutoff of its stratum.  A null text
    has no words; a null stratum is a stratum; a stratum without labels keeps
    all that pass the base rule.  Labels are joined by doc_id (the worst of
    several); a null doc_id has none.  Without labels nothing but the base rule acts.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col(stratum).cast("string").alias("stratum"), "text")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = materialise(measures(own, ["doc_id", "stratum"]).withColumn("base_failed", base), "quality")
    cuts = thresholds(measured, labels, risk, chance).withColumnRenamed("stratum", "of_stratum")
    judged = measured.join(cuts, F.col("stratum").eqNullSafe(F.col("of_stratum")), "left")
    failed = F.array_compact(F.array(*[F.when(F.expr(e) > F.col(f"cut_{r}"), F.lit(r)) for r, (e, _) in RULES.items()]))
    return judged.select("doc_id", "stratum", *_MEASURES, "base_failed", failed.alias("failed"), (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"))
