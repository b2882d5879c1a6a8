"""Comparison with references: joins, tolerances, groups, ratios, sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import arc_difference
from pulsegrid.schema import TOLERANCE


def _median(c) -> Column:
    return F.percentile(c, F.lit(0.5))


def differences(measured: DataFrame, truth: DataFrame, key: str = "ecg_id") -> DataFrame:
    """measured less truth for each metric both have, axes on the shortest arc, with p_want and p_got; QT only where not flagged."""
    m, t = measured.alias("m"), truth.alias("t")
    cols = [F.col(f"m.{key}").alias(key)]
    for name in TOLERANCE:
        a, b = F.col(f"m.{name}"), F.col(f"t.{name}")
        d = arc_difference(a, b) if name.startswith("axis") else a - b
        if name == "qt_ms" and "flags" in measured.columns:
            d = F.when(~F.array_contains("m.flags", "qt"), d)
        cols.append(d.alias(name))
    cols += [F.col("t.p_ms").isNotNull().alias("p_want"), F.col("m.p_ms").isNotNull().alias("p_got")]
    return m.join(t, F.col(f"m.{key}") == F.col(f"t.{key}")).select(*cols)


def long_differences(diff: DataFrame, keys, metrics) -> DataFrame:
    """keys, metric, err of the comparable pairs."""
    return diff.unpivot([*keys], metrics, "metric", "err").where("err is not null")


def tolerance_report(long: DataFrame, keys=("metric",), err: str = "err", tolerance: Column | None = None) -> DataFrame:
    """keys, n, bias (median), med_abs, p90_abs, within (share)."""
    tolerance = tolerance if tolerance is not None else F.element_at(F.create_map(*[F.lit(x) for k, v in TOLERANCE.items() for x in (k, v)]), F.col("metric"))
    rows = long.withColumn("_a", F.abs(err)).withColumn("_ok", (F.abs(err) <= tolerance).cast("double"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), _median(err).alias("bias"), _median("_a").alias("med_abs"), F.percentile("_a", F.lit(0.9)).alias("p90_abs"), F.avg("_ok").alias("within"))


def group_report(rows: DataFrame, group: str, err: str, failed: Column, want: Column, got: Column) -> DataFrame:
    """group, n, failed, found, extra, med_abs: losses are reported beside the accuracy of the rest."""
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(failed).alias("failed"), F.count_if(want & got).alias("found"), F.count_if(~want & got).alias("extra"), _median(F.when(~failed, F.abs(err))).alias("med_abs")
    )


def ratio_report(pairs: DataFrame, least: int = 5) -> DataFrame:
    """bucket, lead, n, ratio of pairs (lead, truth, ours): overall, by amplitude bucket and by lead; groups of `least` rows or more."""
    edges = [0.2, 0.5, 1.0, 1.5, 2.5, 10.0]
    a = F.abs("truth")
    bucket = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:]):
        bucket = F.when((a >= lo) & (a < hi), F.lit(f"{lo}-{hi}")).otherwise(bucket)
    rows = pairs.where(a >= edges[0]).withColumn("bucket", bucket).withColumn("ratio", F.col("ours") / F.col("truth"))
    sets = rows.groupingSets([[], [F.col("bucket")], [F.col("lead")]], "bucket", "lead")
    return sets.agg(F.count("*").alias("n"), _median("ratio").alias("ratio")).where(F.col("n") >= least)


def lead_report(rows: DataFrame, metrics, lead: str = "lead", ratio: str = "r_amp", coverage: str = "coverage", near: float = 0.05) -> DataFrame:
    """lead, n, coverage (mean), medians of the metrics and of the height ratio, and the share of ratios within `near` of 1; lead is null in the row over all.

    rows: one for each record and lead; a lead without a comparison has nulls.
    """
    sets = rows.groupingSets([[F.col(lead)], []], lead)
    within = F.avg((F.abs(F.col(ratio) - 1) < near).cast("double"))
    return sets.agg(F.count(metrics[0]).alias("n"), F.avg(coverage).alias("coverage"), *[_median(m).alias(m) for m in metrics], _median(ratio).alias(ratio), within.alias("within"))


def specificity(before: DataFrame, after: DataFrame, key: str, found: str) -> DataFrame:
    """total, false, share: of records in which something is found, measured again with it erased, those in which it is found again.

    Records that the second run could not measure do not count.
    """
    had = before.where(F.col(found).isNotNull()).select(key)
    both = after.join(had, key, "left_semi")
    return both.agg(F.count("*").alias("total"), F.count(found).alias("false")).withColumn("share", F.col("false") / F.greatest(F.col("total"), F.lit(1)))


def parameter_grid(measure, values: list[float], truth: DataFrame, key: str, metric: str) -> DataFrame:
    """value, n, bias, med_abs, p90_abs: a parameter's values by the error of what measure(value), a table of (key, metric), gives.

    One value serves all records: fitted to each record, it would show an
    accuracy that new data do not have.
    """
    runs = stages({str(v): measure(v).select(key, F.col(metric).alias("_m")) for v in values})
    rows = runs.join(truth.select(key, F.col(metric).alias("_t")), key).withColumn("_e", F.col("_m") - F.col("_t")).where("_e is not null")
    return rows.groupBy(F.col("stage").cast("double").alias("value")).agg(F.count("*").alias("n"), _median("_e").alias("bias"), _median(F.abs("_e")).alias("med_abs"), F.percentile(F.abs("_e"), F.lit(0.9)).alias("p90_abs"))


def analyser_spread(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """n, med_abs, p90_abs between two analysers' values of a metric."""
    d = F.abs(F.col("x") - F.col("y"))
    both = a.select(key, F.col(metric).alias("x")).join(b.select(key, F.col(metric).alias("y")), key).where("x is not null and y is not null")
    return both.agg(F.count("*").alias("n"), _median(d).alias("med_abs"), F.percentile(d, F.lit(0.9)).alias("p90_abs"))


def pending(records: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Records without a result yet."""
    return records.join(done.select(key).distinct(), key, "left_anti")


def one_group_each(members: DataFrame, key: str, group: str, confidence: str, ordinary: str) -> DataFrame:
    """Each key in the group of its highest confidence; on a tie not the ordinary one, then by name."""
    best = members.groupBy(key).agg(F.min(F.struct((-F.col(confidence)).alias("c"), (F.col(group) == ordinary).alias("o"), F.col(group).alias("g"))).alias("b"))
    return best.select(key, F.col("b.g").alias(group))


def sample_per_group(rows: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    """k rows of each group, by a seeded hash order that any engine reproduces; place counts from 1."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    w = Window.partitionBy(group).orderBy(order, key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def shortfalls(rows: DataFrame, group: str, wanted: int) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n")).withColumn("missing", F.greatest(F.lit(wanted) - F.col("n"), F.lit(0)))


def nearest(values: DataFrame, x: str, nominal: list[float]) -> DataFrame:
    """values with the nearest of a few nominal values, the first of equally near ones."""
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(x) - v).alias("d"), F.lit(k).alias("k"), F.lit(float(v)).alias("v")) for k, v in enumerate(nominal)]))
    return values.withColumn("nominal", best["v"])


def sweep(rows: DataFrame, score: str, err: str, thresholds: list[float]) -> DataFrame:
    """threshold, n, med_abs, p90_abs of the rows whose score reaches each of a few thresholds."""
    t = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where(F.col(score) >= F.col("threshold"))
    return t.groupBy("threshold").agg(F.count("*").alias("n"), _median(F.abs(err)).alias("med_abs"), F.percentile(F.abs(err), F.lit(0.9)).alias("p90_abs"))


def signal_agreement(pairs: DataFrame, keys, ours: str, truth: str) -> DataFrame:
    """keys, n, corr, gain (least squares), snr, snr_gain_fixed (dB), rms_uv of aligned samples; null where a side is flat."""
    x, y = F.col(truth), F.col(ours)
    g = F.covar_pop(ours, truth) / F.nullif(F.var_pop(truth), F.lit(0.0))
    s = pairs.where(x.isNotNull() & y.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.corr(ours, truth).alias("corr"), g.alias("gain"), F.var_pop(truth).alias("vx"), F.var_pop(ours).alias("vy"), F.var_pop(y - x).alias("vd"), F.sqrt(F.avg((y - x) * (y - x))).alias("rms")
    )
    left = F.col("vy") - F.col("gain") * F.col("gain") * F.col("vx")
    db = lambda num, den: 10.0 * F.log10(num / F.nullif(den, F.lit(0.0)))
    return s.select(*keys, "n", "corr", "gain", db(F.col("vx"), F.col("vd")).alias("snr"), db(F.col("vx"), F.greatest(left / F.nullif(F.col("gain") * F.col("gain"), F.lit(0.0)), F.lit(1e-12))).alias("snr_gain_fixed"), (F.col("rms") * 1000.0).alias("rms_uv"))


def best_lag(a: DataFrame, b: DataFrame, keys, most: int, normalised: bool = True) -> DataFrame:
    """keys, lag of highest correlation of a (keys, i, mv) with b shifted by up to `most`; smallest lag of equal ones.

    Not normalised, the sum of products decides.  Samples meet in a window over
    their places, so nothing is shuffled but them, by keys.
    """
    score = F.coalesce(F.round(F.corr("mv", "y"), 12), F.lit(-2.0)) if normalised else F.round(F.sum(F.col("mv") * F.col("y")), 9)
    placed = [F.col(k).isNotNull() for k in (*keys, "i")]
    rows = a.select(*keys, F.col("i").cast("long").alias("i"), "mv", F.lit(None).cast("double").alias("y"), F.lit(True).alias("ours"))
    rows = rows.unionByName(b.select(*keys, F.col("i").cast("long").alias("i"), F.lit(None).cast("double").alias("mv"), F.col("mv").alias("y"), F.lit(False).alias("ours")))
    near = Window.partitionBy(*keys).orderBy("i").rangeBetween(-most, most)
    rows = rows.where(reduce(lambda x, y: x & y, placed)).withColumn("near", F.collect_list(F.when(~F.col("ours"), F.struct("i", "y"))).over(near)).where("ours")
    pairs = rows.select(*keys, F.col("i").alias("_i"), "mv", F.inline("near")).withColumn("lag", (F.col("_i") - F.col("i")).cast("int"))
    c = pairs.groupBy(*keys, "lag").agg(score.alias("c"))
    return c.groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("c"), "lag"))["lag"].alias("lag"))


def height_pairs(ours: DataFrame, truth: DataFrame, peaks: DataFrame, most: int, half: int, reach: int, least_mv: float = 0.2) -> DataFrame:
    """record_id, lead, peak, truth, ours: heights of the reference's complexes in both signals (record_id, lead, i, mv).

    Both are taken less their medians, and the reference is moved by the lag of
    the largest sum of products; peak (given in its samples) is in ours.  The
    apex is the largest deviation from half before to half - 1 after, all of
    which both must have; ours is the extreme of the same sign within reach of
    it there.  Lower apexes than least_mv are left out.
    """
    keys = ["record_id", "lead"]
    level = lambda s: s.withColumn("mv", F.col("mv") - F.percentile("mv", F.lit(0.5)).over(Window.partitionBy(*keys)))
    ours, truth = level(ours), level(truth)
    lag = best_lag(ours, truth, keys, most, normalised=False)
    near = peaks.join(lag, "record_id" if "lead" not in peaks.columns else keys).withColumn("peak", F.col("peak") + F.col("lag"))
    near = near.select(*keys, "peak", "lag", F.explode(F.sequence(F.col("peak") - half, F.col("peak") + (half - 1))).alias("i")).hint("merge")
    both = near.join(ours.withColumnRenamed("mv", "o"), [*keys, "i"]).withColumn("at", F.col("i") - F.col("lag")).join(truth.toDF(*["at" if c == "i" else "t" if c == "mv" else c for c in truth.columns]), [*keys, "at"])
    w = Window.partitionBy(*keys, "peak")
    both = both.withColumn("n", F.count(F.col("o") + F.col("t")).over(w)).withColumn("top", F.min(F.struct((-F.round(F.abs("t"), 9)).alias("size"), "i", "t")).over(w))
    both = both.where((F.col("n") == 2 * half) & (F.abs("top.t") >= least_mv) & (F.abs(F.col("i") - F.col("top.i")) <= reach))
    ups, downs = F.max("o"), F.min("o")
    return both.groupBy(*keys, "peak", F.col("top.t").alias("t")).agg(ups.alias("up"), downs.alias("down")).select(*keys, "peak", F.abs("t").alias("truth"), F.abs(F.when(F.col("t") > 0, F.col("up")).otherwise(F.col("down"))).alias("ours"))


def by_folder(records: DataFrame, files: DataFrame, key: str = "record_id") -> DataFrame:
    """records with the rows of files (path, ...) that lie in a folder of the record's name; records without one are left out."""
    return records.join(files.withColumn("_folder", F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)), F.col(key).cast("string") == F.col("_folder")).drop("_folder")


def first_by_name(rows: DataFrame, name: str, n: int) -> DataFrame:
    """The n first rows by name: a trial run over some of the records."""
    return rows.orderBy(name).limit(n)


def largest(rows: DataFrame, group: str, size: str, tie: str, k: int = 5) -> DataFrame:
    """The k largest rows of each group, the smaller `tie` first of equal ones; place counts from 1."""
    w = Window.partitionBy(group).orderBy(F.desc(size), tie)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def peak_height_ratio(signals: DataFrame, ours: DataFrame, peaks: DataFrame, half: int, least_mv: float = 0.15) -> DataFrame:
    """record_id, lead, n, ratio: median ratio of heights at the reference's peaks; two peaks of some height at least."""
    near = peaks.withColumn("i", F.explode(F.sequence(F.col("peak") - half, F.col("peak") + half))).hint("merge")
    top = lambda s, name: s.join(near, ["record_id", "i"]).groupBy("record_id", "lead", "peak").agg(F.max("mv").alias(name))
    both = top(signals, "t").join(top(ours, "o"), ["record_id", "lead", "peak"]).where(F.abs("t") >= least_mv)
    return both.groupBy("record_id", "lead").agg(F.count("*").alias("n"), _median(F.col("o") / F.col("t")).alias("ratio")).where("n >= 2")


def erase(signals: DataFrame, spans: DataFrame) -> DataFrame:
    """signals with each span (record_id, a, b) of samples replaced by the line between its ends."""
    at = lambda end: signals.join(spans.select("record_id", "a", "b", F.col(end).alias("i")), ["record_id", "i"]).select("record_id", "lead", "a", "b", F.col("mv").alias(f"y_{end}"))
    ends = at("a").join(at("b"), ["record_id", "lead", "a", "b"])
    hit = ends.withColumn("i", F.explode(F.sequence("a", "b"))).select("record_id", "lead", "i", (F.col("y_a") + (F.col("y_b") - F.col("y_a")) * (F.col("i") - F.col("a")) / (F.col("b") - F.col("a"))).alias("flat")).hint("merge")
    return signals.join(hit, ["record_id", "lead", "i"], "left").withColumn("mv", F.coalesce("flat", "mv")).drop("flat")


def stages(named: dict[str, DataFrame]) -> DataFrame:
    """Rows of several runs under one another, with the run's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("stage", F.lit(k)) for k, d in named.items()])
