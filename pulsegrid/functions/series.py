"""Window operators over ordered series: keys, an order column and a value column.

Every function partitions by the keys only, so chained calls share one shuffle.
Missing samples are nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys, order):
    return Window.partitionBy(*keys).orderBy(order)


def longest_run(df: DataFrame, keys, order: str, ok: Column) -> DataFrame:
    """keys, start, length of the longest stretch of rows for which ok holds; of equally long ones the earliest."""
    rows = df.select(*keys, F.col(order).alias("o"), F.coalesce(ok, F.lit(False)).alias("ok"))
    rows = rows.withColumn("rn", F.row_number().over(_w(keys, "o"))).where("ok")
    rows = rows.withColumn("island", F.col("rn") - F.row_number().over(_w(keys, "o")))
    runs = rows.groupBy(*keys, "island").agg(F.min("o").alias("start"), F.count("*").alias("length"))
    best = runs.groupBy(*keys).agg(F.min(F.struct((-F.col("length")).alias("n"), "start")).alias("b"))
    return best.select(*keys, "b.start", (-F.col("b.n")).alias("length"))


def first_difference(x: str, keys, order: str) -> Column:
    """x less the value before; 0 at the first."""
    return F.coalesce(F.col(x) - F.lag(x, 1).over(_w(keys, order)), F.lit(0.0))


def moving_average(x: str, keys, order: str, n: int) -> Column:
    """Centred window of n (made odd), zero outside the series: always divided by n."""
    n |= 1
    return F.sum(x).over(_w(keys, order).rowsBetween(-(n // 2), n // 2)) / F.lit(float(n))


def energy_window(x: str, keys, order: str, n: int) -> Column:
    """As moving_average, but n may be even: n // 2 rows before and (n - 1) // 2 after."""
    return F.sum(x).over(_w(keys, order).rowsBetween(-(n // 2), (n - 1) // 2)) / F.lit(float(n))


def high_pass(x: str, keys, order: str, n: int) -> Column:
    """x less its centred mean over n (odd) rows, of those that have a value."""
    n |= 1
    return F.col(x) - F.avg(x).over(_w(keys, order).rowsBetween(-(n // 2), n // 2))


def despike(x: str, keys, order: str, n: int) -> Column:
    """Centred running median over n (odd, small) rows; the end values repeat beyond the ends."""
    n |= 1
    w = _w(keys, order)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(x).over(everything), F.last(x).over(everything)
    here = [F.coalesce(F.lag(x, k).over(w), first) for k in range(n // 2, 0, -1)]
    here += [F.col(x)] + [F.coalesce(F.lead(x, k).over(w), last) for k in range(1, n // 2 + 1)]
    return F.array_sort(F.array(*here))[n // 2]


def quietest_range(df: DataFrame, keys, order: str, x: str, n: int) -> DataFrame:
    """keys, quiet: the smallest max - min of n consecutive rows; of a shorter series the range of all."""
    w = _w(keys, order).rowsBetween(-(n - 1), 0)
    rows = df.select(*keys, (F.max(x).over(w) - F.min(x).over(w)).alias("r"), F.count("*").over(w).alias("n"), F.col(x).alias("x"))
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("n") == n, F.col("r"))), F.max("x") - F.min("x")).alias("quiet"))


def sustained_below(df: DataFrame, keys, order: str, x: str, start: Column, threshold: Column, hold: int, step: int = 1) -> DataFrame:
    """keys, at: first place from start, going by step, at which x is below the threshold and stays so for hold rows.

    The stretch is the row and the hold - 1 after it (forward), or the hold
    rows before it and it (backward), cut off at the ends of the series.  No
    such place: the last order value, or the first.
    """
    w = _w(keys, order).rowsBetween(0, hold - 1) if step > 0 else _w(keys, order).rowsBetween(-hold, 0)
    ahead = (F.col(order) >= start) if step > 0 else (F.col(order) <= start)
    hit = ahead & (F.max(x).over(w) < threshold)
    rows = df.select(*keys, F.col(order).alias("o"), hit.alias("hit"))
    end = F.max("o") if step > 0 else F.min("o")
    near = F.min(F.when(F.col("hit"), F.col("o"))) if step > 0 else F.max(F.when(F.col("hit"), F.col("o")))
    return rows.groupBy(*keys).agg(F.coalesce(near, end).alias("at"))


def filled(x: str, keys, order: str) -> Column:
    """Gaps filled: linear inside, the nearest value at the ends, null if there is none."""
    w = _w(keys, order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(x).isNotNull(), F.col(order))
    x0, x1 = F.last(x, ignorenulls=True).over(before), F.first(x, ignorenulls=True).over(after)
    o0, o1 = F.last(at, ignorenulls=True).over(before), F.first(at, ignorenulls=True).over(after)
    inside = x0 + (x1 - x0) * (F.col(order) - o0) / (o1 - o0)
    return F.coalesce(F.col(x), inside, x0, x1)


def grouped_by_gap(df: DataFrame, keys, y: str, gap: float, share: float | None = None) -> DataFrame:
    """df with part: a new part begins where y, sorted, rises by more than the gap.

    With a share the gap is the larger of the given one and share times the median rise.
    """
    rows = df.withColumn("_rise", F.col(y) - F.lag(y).over(_w(keys, y)))
    limit = F.lit(float(gap))
    if share is not None:
        limit = F.greatest(limit, F.lit(share) * F.coalesce(F.percentile("_rise", F.lit(0.5)).over(Window.partitionBy(*keys)), F.lit(0.0)))
    rows = rows.withColumn("_new", F.when(F.col("_rise") > limit, 1).otherwise(0))
    return rows.withColumn("part", F.sum("_new").over(_w(keys, y).rangeBetween(Window.unboundedPreceding, 0))).drop("_rise", "_new")


def detrended(df: DataFrame, keys, order: str, x: str, k: int) -> DataFrame:
    """df with flat: x less the line from the median of its first k values to that of its last k."""
    w = _w(keys, order)
    place = F.row_number().over(w)
    size = F.count("*").over(Window.partitionBy(*keys))
    rows = df.withColumn("_p", place - 1).withColumn("_n", size)
    whole = Window.partitionBy(*keys)
    y0 = F.percentile(F.when(F.col("_p") < k, F.col(x)), F.lit(0.5)).over(whole)
    y1 = F.percentile(F.when(F.col("_p") >= F.col("_n") - k, F.col(x)), F.lit(0.5)).over(whole)
    rows = rows.withColumn("_y0", y0).withColumn("_y1", y1)
    line = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * F.col("_p") / F.greatest(F.col("_n") - 1, F.lit(1))
    return rows.withColumn("flat", F.when(F.col("_n") < 2 * k, F.col(x)).otherwise(F.col(x) - line)).drop("_p", "_n", "_y0", "_y1")


def regular(df: DataFrame, keys, order: str, share: float = 0.15) -> DataFrame:
    """The events (keys, order) whose interval to the one before is within a share of the median.

    The first event stays; with fewer than four events, or fewer than three left, all stay.
    """
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_rr", F.col(order) - F.lag(order).over(_w(keys, order)))
    rows = rows.withColumn("_med", F.percentile("_rr", F.lit(0.5)).over(w)).withColumn("_n", F.count("*").over(w))
    rows = rows.withColumn("_ok", F.col("_rr").isNull() | F.col("_rr").between((1 - share) * F.col("_med"), (1 + share) * F.col("_med")))
    rows = rows.withColumn("_kept", F.sum(F.col("_ok").cast("int")).over(w))
    return rows.where((F.col("_n") < 4) | (F.col("_kept") < 3) | F.col("_ok")).drop("_rr", "_med", "_n", "_ok", "_kept")


def resampled(df: DataFrame, keys, order: str, x: str, step: float) -> DataFrame:
    """keys, j, y: values at every `step` of an order that counts from 0 by 1; a gap stays one where it fills more than half."""
    last = df.groupBy(*keys).agg(F.max(order).alias("_n"))
    grid = last.select(*keys, F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / step).cast("int"))).alias("j"))
    grid = grid.withColumn("_at", F.col("j") * step).withColumn("_lo", F.floor("_at"))
    both = df.select(*keys, F.col(order).cast("long").alias("_lo"), F.col(x).alias("_x0"), F.lead(x).over(_w(keys, order)).alias("_x1"))
    part = F.col("_at") - F.col("_lo")
    nulls = F.col("_x0").isNull().cast("double") * (1 - part) + F.when(part > 0, F.col("_x1").isNull().cast("double") * part).otherwise(0.0)
    x0, x1 = F.coalesce("_x0", "_x1"), F.coalesce("_x1", "_x0")
    y = F.when(nulls <= 0.5, x0 * (1 - part) + x1 * part)
    return grid.join(both, [*keys, "_lo"], "left").select(*keys, "j", y.alias("y"))
