"""Closed-form twelve-lead test signals as rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Five waves of a beat (phase, height, width) and the gain of each lead.
WAVES = [(0.18, 0.12, 0.022), (0.30, -0.10, 0.010), (0.33, 1.10, 0.009), (0.37, -0.28, 0.010), (0.55, 0.32, 0.030)]
GAINS = {"I": 0.9, "II": 1.0, "III": 0.5, "aVR": -0.8, "aVL": 0.4, "aVF": 0.7, "V1": -0.6, "V2": 1.2, "V3": 1.5, "V4": 1.6, "V5": 1.1, "V6": 0.8}


#: Rows, about, that one partition of generated tables has.
PART_ROWS = 1_000_000


def placed(rows: DataFrame, key: str, made: int, count: int | None = None) -> DataFrame:
    """rows by hash of the key, over as many partitions as the `made` rows that are made from each need; count: number of rows, if known.

    By key alone, so that windows, aggregates and joins of what is made find it
    in place.  A small table that much is made from would else be one partition.
    """
    n = rows.count() if count is None else count
    return rows.repartition(max(1, math.ceil(n * made / PART_ROWS)), key)


def crossed(rows: DataFrame, place: str, n: int) -> DataFrame:
    """rows with each whole number below n: as explode(sequence()), but the planner knows how much this makes, and does not send it to everyone."""
    return rows.crossJoin(F.broadcast(rows.sparkSession.range(n).select(F.col("id").cast("int").alias(place))))


def beat(phase: Column, without=()) -> Column:
    """The waveform at a phase of the beat; waves can be left out by place."""
    waves = [F.lit(a) * F.exp(-((phase - c) * (phase - c)) / F.lit(2 * w * w)) for k, (c, a, w) in enumerate(WAVES) if k not in without]
    total = waves[0]
    for w in waves[1:]:
        total = total + w
    return total


def signals(records: DataFrame, fs: int = 250, n: int = 600, leads=None, without=(), times: int = 1) -> DataFrame:
    """(record_id, lead, i, mv) for each record_id (long) of records.

    Heart rate, phase and amplitude follow from record_id by whole-number
    arithmetic, so that other engines give the same values.  If each sample is
    made into several rows where it lies, `times` is their number.
    """
    leads = leads or list(GAINS)
    dim = F.array(*[F.struct(F.lit(x).alias("lead"), F.lit(GAINS[x]).alias("gain")) for x in leads])
    rows = crossed(placed(records.select("record_id").distinct(), "record_id", n * len(leads) * times), "k", n * len(leads))
    rows = rows.select("record_id", dim[F.floor(F.col("k") / n).cast("int")].alias("l"), (F.col("k") % n).alias("i"))
    period = F.lit(fs * 4 // 5) + 10 * (F.col("record_id") % 5)
    phase = ((F.col("i") + F.col("record_id") % 37) % period) / period
    mv = F.col("l.gain") * (1 + (F.col("record_id") % 7) / F.lit(20.0)) * beat(phase, without)
    return rows.select("record_id", F.col("l.lead").alias("lead"), "i", mv.alias("mv"))


#: Widths (ms) of the probe's triangles, one after the other, and seconds from one to the next.
PROBE_MS, PROBE_SECONDS = (20, 40, 80, 160), 0.4


def probe(records: DataFrame, fs: int = 500, n: int = 5000, leads=None) -> DataFrame:
    """(record_id, lead, i, mv): triangles of known width and a height of 1 mV, up and down in turn, to measure what a chain makes of them.

    Only periods that end before n have one.
    """
    period, leads = int(PROBE_SECONDS * fs), leads or list(GAINS)
    rows = crossed(placed(records.select("record_id").distinct(), "record_id", n * len(leads)), "k", n * len(leads))
    rows = rows.select("record_id", F.array(*map(F.lit, leads))[F.floor(F.col("k") / n).cast("int")].alias("lead"), (F.col("k") % n).alias("i"))
    k = F.floor(F.col("i") / period).cast("int")
    half = F.element_at(F.array(*[F.lit(max(1, w * fs // 2000)) for w in PROBE_MS]), k % len(PROBE_MS) + 1)
    off = F.abs(F.col("i") - k * period - period // 2)
    mv = F.when((off <= half) & ((k + 1) * period < n), F.when(k % 2 == 0, 1.0).otherwise(-1.0) * (1 - off / (half + 1))).otherwise(0.0)
    return rows.withColumn("mv", mv)
