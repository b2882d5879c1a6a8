"""The engine's operators as queries over the driver's tables, each with its SQL twin where SQL has one.

`events` serves as an irregular series per user_id; synthetic twelve-lead
signals are keyed by its users, so that all queries scale with the tables.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.functions import series as N
from pulsegrid.operators import beats as B
from pulsegrid.operators import compare as C
from pulsegrid.operators import delineate as D
from pulsegrid.operators import layout as Y
from pulsegrid.operators import leads as L
from pulsegrid.plans import report as R
from pulsegrid.schema import INDEPENDENT, LIMB
from pulsegrid.sources import readers, synthetic

QUERIES: dict = {}
SQL: dict[str, str] = {}
FS, SAMPLES = 250, 600


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# ------------------------------------------------------------------ inputs

E_SQL = "e AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS i, value AS x, event_type FROM events)"


def events(spark, d, made=0):
    """Series of events; if `made` rows are to be made from each of them, by hash of the user over partitions for so many."""
    e = spark.read.parquet(f"{d}/events.parquet")
    e = synthetic.placed(e, "user_id", made) if made else e
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", F.row_number().over(w).alias("i"), F.col("value").alias("x"), "event_type")


def users(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("record_id")).distinct()


def signals(spark, d, leads=INDEPENDENT, n=SAMPLES, without=(), times=1):
    return synthetic.signals(users(spark, d), FS, n, leads, without, times)


def _wave_sql(without=()):
    return " + ".join(f"({a}) * exp(-((p - {c}) * (p - {c})) / {2 * w * w!r})" for k, (c, a, w) in enumerate(synthetic.WAVES) if k not in without)


def s_sql(leads=INDEPENDENT, n=SAMPLES, without=()):
    gains = ", ".join(f"('{x}', CAST({synthetic.GAINS[x]} AS DOUBLE))" for x in leads)
    return (
        f"ph AS (SELECT record_id, CAST(i AS INTEGER) AS i, CAST((i + record_id % 37) % ({FS * 4 // 5} + 10 * (record_id % 5)) AS DOUBLE) / ({FS * 4 // 5} + 10 * (record_id % 5)) AS p "
        f"FROM (SELECT DISTINCT user_id AS record_id FROM events), (SELECT unnest(range({n})) AS i)), "
        f"s AS (SELECT record_id, lead, i, gain * (1 + CAST(record_id % 7 AS DOUBLE) / 20.0) * ({_wave_sql(without)}) AS mv FROM ph, (VALUES {gains}) g(lead, gain))"
    )


def wide_sql(leads):
    return ", ".join(f"max(CASE WHEN lead = '{x}' THEN mv END) AS v_{x}" for x in leads)


# ------------------------------------------------------------------ series


@query("n1_longest_run", f"WITH {E_SQL}, o AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM e WHERE x >= 30), r AS (SELECT user_id, min(i) AS start, count(*) AS n FROM o GROUP BY user_id, g) SELECT user_id, start, n AS length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, start) AS k FROM r) WHERE k = 1")
def n1(spark, d):
    return N.longest_run(events(spark, d), ["user_id"], "i", F.col("x") >= 30)


@query("n2_first_difference", f"WITH {E_SQL} SELECT user_id, i, round(coalesce(x - lag(x) OVER (PARTITION BY user_id ORDER BY i), 0.0), 6) AS d FROM e")
def n2(spark, d):
    return events(spark, d).select("user_id", "i", F.round(N.first_difference("x", ["user_id"], "i"), 6).alias("d"))


@query("n3_moving_average_zero", f"WITH {E_SQL} SELECT user_id, i, round(sum(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0, 6) AS y FROM e")
def n3(spark, d):
    return events(spark, d).select("user_id", "i", F.round(N.moving_average("x", ["user_id"], "i", 5), 6).alias("y"))


@query("n4_energy_window", f"WITH {E_SQL} SELECT user_id, i, round(sum(x * x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6.0, 6) AS y FROM e")
def n4(spark, d):
    e = events(spark, d).withColumn("xx", F.col("x") * F.col("x"))
    return e.select("user_id", "i", F.round(N.energy_window("xx", ["user_id"], "i", 6), 6).alias("y"))


@query("n5_high_pass", f"WITH {E_SQL} SELECT user_id, i, round(x - avg(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS y FROM e")
def n5(spark, d):
    return events(spark, d).select("user_id", "i", F.round(N.high_pass("x", ["user_id"], "i", 7), 6).alias("y"))


_W = "OVER (PARTITION BY user_id ORDER BY i)"
_ALL = "OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query("n6_despike", f"WITH {E_SQL}, l AS (SELECT user_id, i, [coalesce(lag(x, 2) {_W}, first_value(x) {_ALL}), coalesce(lag(x) {_W}, first_value(x) {_ALL}), x, coalesce(lead(x) {_W}, last_value(x) {_ALL}), coalesce(lead(x, 2) {_W}, last_value(x) {_ALL})] AS v FROM e) SELECT user_id, i, list_sort(v)[3] AS y FROM l")
def n6(spark, d):
    return events(spark, d).select("user_id", "i", N.despike("x", ["user_id"], "i", 5).alias("y"))


@query("n8_quietest_range", f"WITH {E_SQL}, r AS (SELECT user_id, max(x) OVER w - min(x) OVER w AS r, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT user_id, round(min(r), 6) AS quiet FROM r WHERE n = 5 GROUP BY user_id")
def n8(spark, d):
    return N.quietest_range(events(spark, d), ["user_id"], "i", "x", 5).withColumn("quiet", F.round("quiet", 6))


_PEAK_SQL = "p AS (SELECT user_id, min(struct_pack(v := -x, i := i)).i AS p FROM e GROUP BY 1)"


def _from_peak(spark, d):
    """Each series with the place of its largest value, the first of equal ones."""
    return events(spark, d).withColumn("peak", F.min(F.struct((-F.col("x")).alias("v"), "i")).over(Window.partitionBy("user_id"))["i"])


@query("n9_sustained_below", f"WITH {E_SQL}, {_PEAK_SQL}, h AS (SELECT user_id, i, max(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) < 60 AND i >= p AS ok FROM e JOIN p USING (user_id)) SELECT user_id, coalesce(min(CASE WHEN ok THEN i END), max(i)) AS \"at\" FROM h GROUP BY user_id")
def n9(spark, d):
    return N.sustained_below(_from_peak(spark, d), ["user_id"], "i", "x", F.col("peak"), F.lit(60.0), 4)


@query("n9_sustained_below_backward", f"WITH {E_SQL}, {_PEAK_SQL}, h AS (SELECT user_id, i, max(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) < 60 AND i <= p AS ok FROM e JOIN p USING (user_id)) SELECT user_id, coalesce(max(CASE WHEN ok THEN i END), min(i)) AS \"at\" FROM h GROUP BY user_id")
def n9b(spark, d):
    return N.sustained_below(_from_peak(spark, d), ["user_id"], "i", "x", F.col("peak"), F.lit(60.0), 3, -1)


@query("n11_longest_plateau", f"WITH {E_SQL}, c AS (SELECT user_id, i, CAST(floor(x / 30) AS BIGINT) AS b FROM e), g AS (SELECT user_id, i, b, sum(CASE WHEN b = lb THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS g FROM (SELECT *, lag(b) {_W} AS lb FROM c)) SELECT user_id, max(n) AS plateau FROM (SELECT user_id, g, count(*) AS n FROM g GROUP BY user_id, g) GROUP BY user_id")
def n11(spark, d):
    e = events(spark, d).withColumn("b", F.floor(F.col("x") / 30))
    w = Window.partitionBy("user_id").orderBy("i")
    e = e.withColumn("new", F.when(F.col("b") == F.lag("b").over(w), 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    return e.groupBy("user_id", "g").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("plateau"))


_P_SQL = f"{E_SQL}, p AS (SELECT user_id, i FROM e WHERE x > 60), rr AS (SELECT user_id, i, i - lag(i) OVER (PARTITION BY user_id ORDER BY i) AS d FROM p)"


def peaks(spark, d):
    return events(spark, d).where("x > 60").select(F.col("user_id").alias("record_id"), F.col("i").alias("peak"))


@query("n12_intervals", f"WITH {_P_SQL} SELECT user_id AS record_id, i AS peak, round(d / 5.0, 6) AS rr FROM rr")
def n12(spark, d):
    return B.intervals(peaks(spark, d), 5).withColumn("rr", F.round("rr", 6))


@query("b2_heart_rate", f"WITH {_P_SQL}, k AS (SELECT user_id, CASE WHEN d / 5.0 > 0.3 AND d / 5.0 < 2.0 THEN d / 5.0 END AS rr FROM rr), m AS (SELECT user_id, count(*) AS beats, count(rr) AS n, quantile_cont(rr, 0.5) AS med FROM k GROUP BY user_id), v AS (SELECT k.user_id, quantile_cont(abs(rr - med), 0.5) AS dev FROM k JOIN m USING (user_id) GROUP BY k.user_id) SELECT user_id AS record_id, CAST(round_even(60.0 / med, 0) AS INTEGER) AS bpm, beats, CAST(round_even(100.0 * (dev / med), 0) AS INTEGER) AS spread, dev / med < 0.12 AS regular FROM m JOIN v USING (user_id) WHERE beats >= 3 AND n >= 2")
def b2(spark, d):
    return B.heart_rate(peaks(spark, d), 5)


@query("b4_beat_windows", f"WITH {_P_SQL}, m AS (SELECT user_id, quantile_cont(d / 5.0, 0.5) * 1000.0 AS rr_ms FROM rr GROUP BY user_id HAVING count(d) > 0) SELECT user_id AS record_id, round(rr_ms, 6) AS rr_ms, CAST(trunc(least(400.0, greatest(250.0, rr_ms - 150.0))) AS INTEGER) AS pre, CAST(trunc(least(550.0, 0.7 * rr_ms)) AS INTEGER) AS post FROM m")
def b4(spark, d):
    return B.rates(peaks(spark, d), 5).withColumn("rr_ms", F.round("rr_ms", 6))


@query("p7_regular_beats", f"WITH {_P_SQL}, m AS (SELECT user_id, quantile_cont(d, 0.5) AS med, count(*) AS n FROM rr GROUP BY user_id), k AS (SELECT rr.*, n, d IS NULL OR d BETWEEN 0.85 * med AND 1.15 * med AS ok FROM rr JOIN m USING (user_id)), t AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY user_id) AS kept FROM k) SELECT user_id AS record_id, i AS peak FROM t WHERE n < 4 OR kept < 3 OR ok")
def p7(spark, d):
    return N.regular(peaks(spark, d), ["record_id"], "peak")


@query("p8_edge_filter", f"WITH {_P_SQL}, k AS (SELECT p.user_id, p.i, p.i BETWEEN 5 AND m.n - 5 AS ok FROM p JOIN (SELECT user_id, max(i) AS n FROM e GROUP BY user_id) m USING (user_id)), t AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY user_id) AS inner_n FROM k) SELECT user_id AS record_id, i AS peak FROM t WHERE inner_n < 2 OR ok")
def p8(spark, d):
    n = events(spark, d).groupBy(F.col("user_id").alias("record_id")).agg(F.max("i").alias("n"))
    rows = peaks(spark, d).join(n, "record_id").withColumn("ok", F.col("peak").between(5, F.col("n") - 5))
    return rows.withColumn("inner_n", F.sum(F.col("ok").cast("int")).over(Window.partitionBy("record_id"))).where("inner_n < 2 or ok").select("record_id", "peak")


@query("n13_fill_gaps", f"WITH {E_SQL}, g AS (SELECT user_id, i, CASE WHEN x >= 25 THEN x END AS x FROM e), w AS (SELECT *, last_value(x IGNORE NULLS) OVER a AS x0, first_value(x IGNORE NULLS) OVER b AS x1, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER a AS o0, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS o1 FROM g WINDOW a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT user_id, i, round(coalesce(x, x0 + (x1 - x0) * (i - o0) / nullif(o1 - o0, 0), x0, x1), 6) AS y FROM w")
def n13(spark, d):
    e = events(spark, d).withColumn("x", F.when(F.col("x") >= 25, F.col("x")))
    return e.withColumn("y", F.round(N.filled("x", ["user_id"], "i"), 6)).select("user_id", "i", "y")


@query("n14_resample_gaps", f"WITH {E_SQL}, z AS (SELECT user_id, i - 1 AS i, CASE WHEN x >= 25 THEN x END AS x FROM e), b AS (SELECT user_id, i, x AS x0, lead(x) OVER (PARTITION BY user_id ORDER BY i) AS x1 FROM z), g AS (SELECT user_id, unnest(range(CAST(floor(max(i) / 1.5) AS BIGINT) + 1)) AS j FROM z GROUP BY user_id), r AS (SELECT g.user_id, CAST(j AS INTEGER) AS j, j * 1.5 - floor(j * 1.5) AS f, x0, x1 FROM g JOIN b ON b.user_id = g.user_id AND b.i = floor(g.j * 1.5)) SELECT user_id, j, round(CASE WHEN CASE WHEN x0 IS NULL THEN 1 - f ELSE 0 END + CASE WHEN f > 0 AND x1 IS NULL THEN f ELSE 0 END <= 0.5 THEN coalesce(x0, x1) * (1 - f) + coalesce(x1, x0) * f END, 6) AS y FROM r")
def n14(spark, d):
    e = events(spark, d).select("user_id", (F.col("i") - 1).alias("i"), F.when(F.col("x") >= 25, F.col("x")).alias("x"))
    return N.resampled(e, ["user_id"], "i", "x", 1.5).withColumn("y", F.round("y", 6))


@query("n15_row_groups", f"WITH {E_SQL}, r AS (SELECT user_id, x, x - lag(x) OVER (PARTITION BY user_id ORDER BY x) AS rise FROM e), m AS (SELECT *, greatest(3.0, 0.4 * quantile_cont(rise, 0.5) OVER (PARTITION BY user_id)) AS tol FROM r) SELECT user_id, x, CAST(sum(CASE WHEN rise > tol THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS part FROM m")
def n15(spark, d):
    return N.grouped_by_gap(events(spark, d).select("user_id", "x"), ["user_id"], "x", 3.0, 0.4)


@query("n16_pixel_clusters", f"WITH {E_SQL}, c AS (SELECT user_id, i % 4 AS x, CAST(floor(x) AS INTEGER) AS y FROM e), r AS (SELECT *, y - lag(y) OVER (PARTITION BY user_id, x ORDER BY y) AS rise FROM c), g AS (SELECT *, sum(CASE WHEN rise > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, x ORDER BY y) AS g FROM r) SELECT user_id, x, round(avg(y), 6) AS centre, max(y) - min(y) + 1 AS thickness FROM g GROUP BY user_id, x, g")
def n16(spark, d):
    e = events(spark, d).select("user_id", (F.col("i") % 4).alias("x"), F.floor("x").cast("int").alias("y"))
    return Y.column_clusters(e, ["user_id"]).withColumn("centre", F.round("centre", 6))


@query("n17_detrend", f"WITH {E_SQL}, z AS (SELECT *, i - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM e), m AS (SELECT *, quantile_cont(CASE WHEN p < 4 THEN x END, 0.5) OVER (PARTITION BY user_id) AS y0, quantile_cont(CASE WHEN p >= n - 4 THEN x END, 0.5) OVER (PARTITION BY user_id) AS y1 FROM z) SELECT user_id, i, round(CASE WHEN n < 8 THEN x ELSE x - (y0 + (y1 - y0) * p / greatest(n - 1, 1)) END, 6) AS flat FROM m")
def n17(spark, d):
    return N.detrended(events(spark, d), ["user_id"], "i", "x", 4).select("user_id", "i", F.round("flat", 6).alias("flat"))


# ------------------------------------------------------------------ aggregates


@query("a5_peak_to_peak", f"WITH {E_SQL} SELECT user_id, round(CASE WHEN count(x) < 10 THEN 0.0 ELSE quantile_cont(x, 0.99) - quantile_cont(x, 0.01) END, 6) AS ptp FROM e GROUP BY user_id")
def a5(spark, d):
    return L.peak_to_peak(events(spark, d), ["user_id"], "x").withColumn("ptp", F.round("ptp", 6))


@query("a10_histogram_mode", f"WITH {E_SQL}, h AS (SELECT user_id, floor(x / 20.0) AS b, count(*) AS c FROM e GROUP BY 1, 2) SELECT user_id, (b + 0.5) * 20.0 AS base FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, b) AS k FROM h) WHERE k = 1")
def a10(spark, d):
    return Y.histogram_mode(events(spark, d), ["user_id"], "x", 20.0)


@query("a12_common_value", f"WITH {E_SQL}, v AS (SELECT user_id, floor(x) AS a FROM e), p AS (SELECT u.user_id, u.a, v.a AS b FROM (SELECT DISTINCT * FROM v) u JOIN v ON u.user_id = v.user_id AND abs(u.a - v.a) <= greatest(2.0, 0.12 * u.a)), n AS (SELECT user_id, a, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, a) AS k FROM p GROUP BY user_id, a), q AS (SELECT p.user_id, p.b, quantile_cont(p.b, 0.5) OVER (PARTITION BY p.user_id) AS med FROM p JOIN n ON p.user_id = n.user_id AND p.a = n.a AND k = 1) SELECT user_id, round(max(med), 6) AS value, round(quantile_cont(abs(b - med), 0.5), 6) AS spread, count(*) AS n FROM q GROUP BY user_id HAVING count(*) >= 3")
def a12(spark, d):
    v = Y.common_value(events(spark, d).withColumn("x", F.floor("x")), "user_id", "x")
    return v.select("user_id", F.round("value", 6).alias("value"), F.round("spread", 6).alias("spread"), "n")


@query("a13_spread", f"WITH {E_SQL}, m AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY user_id) AS med FROM e) SELECT user_id, round(quantile_cont(abs(x - med), 0.5) / max(med), 6) AS spread FROM m GROUP BY user_id")
def a13(spark, d):
    e = events(spark, d).withColumn("med", F.percentile("x", F.lit(0.5)).over(Window.partitionBy("user_id")))
    return e.groupBy("user_id").agg(F.round(F.percentile(F.abs(F.col("x") - F.col("med")), F.lit(0.5)) / F.max("med"), 6).alias("spread"))


_TYPES = "e0 AS (SELECT user_id, event_type, value, CASE event_type WHEN 'click' THEN 5.0 ELSE 20.0 END AS tol, value - avg(value) OVER (PARTITION BY user_id) AS err FROM events)"


def errors(spark, d):
    """Each value less its user's mean, summed by event_id: a value equal to the mean is above, at or below it by the order of the sum alone."""
    e = spark.read.parquet(f"{d}/events.parquet")
    own = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return e.select("user_id", "event_type", "value", (F.col("value") - F.avg("value").over(own)).alias("err"))


@query("a1_tolerance_report", f"WITH {_TYPES} SELECT event_type, count(*) AS n, round(quantile_cont(err, 0.5), 4) AS bias, round(quantile_cont(abs(err), 0.5), 4) AS med_abs, round(quantile_cont(abs(err), 0.9), 4) AS p90_abs, round(avg(CASE WHEN abs(err) <= tol THEN 1.0 ELSE 0.0 END), 6) AS within FROM e0 GROUP BY event_type")
def a1(spark, d):
    r = C.tolerance_report(errors(spark, d), ["event_type"], "err", F.when(F.col("event_type") == "click", 5.0).otherwise(20.0))
    return r.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("bias", "med_abs", "p90_abs")], F.round("within", 6).alias("within"))


@query("a2_group_report", f"WITH {_TYPES} SELECT event_type, count(*) AS n, count(*) FILTER (value < 10) AS failed, count(*) FILTER (value > 40 AND err > 0) AS found, count(*) FILTER (NOT value > 40 AND err > -20) AS extra, round(quantile_cont(CASE WHEN NOT value < 10 THEN abs(err) END, 0.5), 4) AS med_abs FROM e0 GROUP BY event_type")
def a2(spark, d):
    got = F.when(F.col("value") > 40, F.col("err") > 0).otherwise(F.col("err") > -20)
    return C.group_report(errors(spark, d), "event_type", "err", F.col("value") < 10, F.col("value") > 40, got).withColumn("med_abs", F.round("med_abs", 4))


@query("a4_ratio_report", "WITH p AS (SELECT event_type AS lead, value / 60.0 AS truth, value / 60.0 + CAST(event_id % 7 AS DOUBLE) / 10.0 AS ours FROM events), b AS (SELECT *, ours / truth AS ratio, CASE WHEN truth < 0.5 THEN '0.2-0.5' WHEN truth < 1.0 THEN '0.5-1.0' WHEN truth < 1.5 THEN '1.0-1.5' WHEN truth < 2.5 THEN '1.5-2.5' WHEN truth < 10.0 THEN '2.5-10.0' END AS bucket FROM p WHERE truth >= 0.2) SELECT bucket, lead, count(*) AS n, round(quantile_cont(ratio, 0.5), 6) AS ratio FROM b GROUP BY GROUPING SETS ((), (bucket), (lead)) HAVING count(*) >= 5")
def a4(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    p = e.select(F.col("event_type").alias("lead"), (F.col("value") / 60.0).alias("truth"), (F.col("value") / 60.0 + (F.col("event_id") % 7) / F.lit(10.0)).alias("ours"))
    return C.ratio_report(p).withColumn("ratio", F.round("ratio", 6))


@query("a7_known_patterns", f"WITH {s_sql(['I', 'II', 'V1'], 40)}, k AS (SELECT record_id, i, max(CASE WHEN lead = 'I' AND NOT (record_id + i) % 3 = 0 THEN 1 ELSE 0 END) + max(CASE WHEN lead = 'II' AND NOT (record_id + i) % 5 = 0 THEN 2 ELSE 0 END) AS pattern FROM s GROUP BY record_id, i) SELECT record_id, CAST(pattern AS INTEGER) AS pattern, count(*) AS n FROM k GROUP BY record_id, pattern")
def a7(spark, d):
    s = signals(spark, d, ["I", "II", "V1"], 40)
    gone = F.when(F.col("lead") == "I", (F.col("record_id") + F.col("i")) % 3 == 0).when(F.col("lead") == "II", (F.col("record_id") + F.col("i")) % 5 == 0).otherwise(F.lit(False))
    return L.known_patterns(s.withColumn("mv", F.when(~gone, F.col("mv"))))


@query("a14_row_coverage", f"WITH {E_SQL}, g AS (SELECT user_id, i % 3 AS part, i % 20 AS x, bool_or(x > 70) AS seen FROM e GROUP BY 1, 2, 3) SELECT user_id AS record_id, part, round(avg(CAST(seen AS INTEGER)), 6) AS cover FROM g GROUP BY 1, 2")
def a14(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("record_id"), (F.col("i") % 3).alias("part"), (F.col("i") % 20).alias("x"), (F.col("x") > 70).alias("seen"))
    return Y.row_coverage(e).withColumn("cover", F.round("cover", 6))


@query("a15_best_lead", f"WITH {s_sql(['I', 'II', 'V1', 'V2'], 60)}, c AS (SELECT record_id, lead, avg(CASE WHEN (i * 7 + record_id + CASE lead WHEN 'I' THEN 0 WHEN 'II' THEN 3 WHEN 'V1' THEN 3 ELSE 8 END) % 10 >= 4 THEN 1.0 ELSE 0.0 END) AS cv FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY cv DESC, CASE lead WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'V1' THEN 3 ELSE 4 END) AS k FROM c) SELECT record_id, lead FROM r WHERE k = 1")
def a15(spark, d):
    off = F.when(F.col("lead") == "I", 0).when(F.col("lead").isin("II", "V1"), 3).otherwise(8)
    s = signals(spark, d, ["I", "II", "V1", "V2"], 60)
    s = s.withColumn("mv", F.when((F.col("i") * 7 + F.col("record_id") + off) % 10 >= 4, F.col("mv")))
    return L.best_lead(L.coverage(s))


@query("a16_threshold_sweep", f"WITH {_TYPES} SELECT threshold, count(*) AS n, round(quantile_cont(abs(err), 0.5), 4) AS med_abs, round(quantile_cont(abs(err), 0.9), 4) AS p90_abs FROM e0, (VALUES (CAST(10.0 AS DOUBLE)), (40.0), (90.0)) t(threshold) WHERE value >= threshold GROUP BY threshold")
def a16(spark, d):
    return C.sweep(errors(spark, d), "value", "err", [10.0, 40.0, 90.0]).withColumn("med_abs", F.round("med_abs", 4)).withColumn("p90_abs", F.round("p90_abs", 4))


@query("a17_zone_means", f"WITH {E_SQL} SELECT user_id AS record_id, CAST(floor(CAST(i % 40 AS DOUBLE) * 4 / 40) AS BIGINT) AS r, CAST(floor(CAST(i % 30 AS DOUBLE) * 3 / 30) AS BIGINT) AS c, round(avg(x), 6) AS mean, max(x) AS most FROM e GROUP BY 1, 2, 3")
def a17(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("record_id"), (F.col("i") % 40).alias("y"), (F.col("i") % 30).alias("xx"), F.col("x").alias("p")).withColumnRenamed("xx", "x")
    return Y.zone_means(e, 40, 30, 4, 3).withColumn("mean", F.round("mean", 6))


@query("a20_shortfalls", "SELECT c_mktsegment, count(*) AS n, greatest(400 - count(*), 0) AS missing FROM customer GROUP BY 1")
def a20(spark, d):
    return C.shortfalls(spark.read.parquet(f"{d}/customer.parquet"), "c_mktsegment", 400)


# ------------------------------------------------------------------ joins, order, sets


@query("j2_analyser_spread", "WITH a AS (SELECT o_orderkey AS k, o_totalprice AS x FROM orders), b AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1) SELECT count(*) AS n, round(quantile_cont(abs(x - y), 0.5), 4) AS med_abs, round(quantile_cont(abs(x - y), 0.9), 4) AS p90_abs FROM a JOIN b USING (k)")
def j2(spark, d):
    a = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    return C.analyser_spread(a, b, "k", "v").withColumn("med_abs", F.round("med_abs", 4)).withColumn("p90_abs", F.round("p90_abs", 4))


@query("j4_pending", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def j4(spark, d):
    done = spark.read.parquet(f"{d}/orders.parquet").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return C.pending(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey"), done, "c_custkey")


@query("j9_nearest_width", f"WITH {E_SQL} SELECT user_id, i, CAST((SELECT v FROM (VALUES (20.0, 0), (40.0, 1), (80.0, 2), (160.0, 3)) t(v, k) ORDER BY abs(e.x - v), k LIMIT 1) AS DOUBLE) AS nominal FROM e")
def j9(spark, d):
    return C.nearest(events(spark, d), "x", [20.0, 40.0, 80.0, 160.0]).select("user_id", "i", "nominal")


@query("j10_beat_windows_join", f"WITH {E_SQL}, p AS (SELECT user_id, i AS peak, row_number() OVER (PARTITION BY user_id ORDER BY i) AS beat FROM e WHERE x > 60) SELECT p.user_id AS record_id, 'II' AS lead, CAST(beat AS INTEGER) AS beat, CAST(e.i - peak + 3 AS INTEGER) AS i, x AS mv FROM p JOIN e ON e.user_id = p.user_id AND e.i BETWEEN peak - 3 AND peak + 3")
def j10(spark, d):
    s = events(spark, d).select(F.col("user_id").alias("record_id"), F.lit("II").alias("lead"), "i", F.col("x").alias("mv"))
    return B.cut(s, peaks(spark, d), 3, 4)


@query("a8_mean_beat", f"WITH {E_SQL}, p AS (SELECT user_id, i AS peak FROM e WHERE x > 60) SELECT p.user_id AS record_id, 'II' AS lead, CAST(e.i - peak + 3 AS INTEGER) AS i, round(avg(x), 6) AS mv FROM p JOIN e ON e.user_id = p.user_id AND e.i BETWEEN peak - 3 AND peak + 3 GROUP BY 1, 2, 3")
def a8(spark, d):
    return B.mean_beat(j10(spark, d)).withColumn("mv", F.round("mv", 6))


@query("j12_next_event_bound", f"WITH {_P_SQL} SELECT user_id AS record_id, i AS peak, least(i + 12, coalesce(greatest(i + 2, lead(i) OVER (PARTITION BY user_id ORDER BY i)), i + 12)) AS hi FROM p")
def j12(spark, d):
    w = Window.partitionBy("record_id").orderBy("peak")
    following = F.lead("peak").over(w)
    return peaks(spark, d).select("record_id", "peak", F.least(F.col("peak") + 12, F.coalesce(F.greatest(F.col("peak") + 2, following), F.col("peak") + 12)).alias("hi"))


@query("j14_best_lag", f"WITH {s_sql(['I', 'V1'], 80)}, a AS (SELECT record_id, i, mv FROM s WHERE lead = 'I'), b AS (SELECT record_id, i + 3 + record_id % 4 AS i, mv AS y FROM s WHERE lead = 'V1' AND i % 11 <> 0), m AS (SELECT b.record_id, l.lag, b.i + l.lag AS i, y FROM b, (SELECT CAST(unnest(range(-8, 9)) AS INTEGER) AS lag) l), c AS (SELECT a.record_id, lag, coalesce(round(corr(mv, y), 12), -2.0) AS c FROM a JOIN m USING (record_id, i) GROUP BY 1, 2) SELECT record_id, lag FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY c DESC, lag) AS k FROM c) WHERE k = 1")
def j14(spark, d):
    s = signals(spark, d, ["I", "V1"], 80)
    a = s.where("lead = 'I'").select("record_id", "i", "mv")
    b = s.where("lead = 'V1' and i % 11 <> 0").select("record_id", (F.col("i") + 3 + F.col("record_id") % 4).alias("i"), "mv")
    return C.best_lag(a, b, ["record_id"], 8)


@query("o1_sample_per_group", "SELECT c_mktsegment, c_custkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || CAST(c_custkey AS VARCHAR)), c_custkey) AS place FROM customer) WHERE place <= 6")
def o1(spark, d):
    return C.sample_per_group(spark.read.parquet(f"{d}/customer.parquet").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 6, 7)


@query("o1_one_group_each", "WITH m AS (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END, l_returnflag) AS k FROM m) WHERE k = 1")
def o1b(spark, d):
    m = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return C.one_group_each(m, "l_orderkey", "l_returnflag", "q", "N")


@query("o3_lines_by_height", f"WITH {E_SQL}, m AS (SELECT user_id, i % 5 AS line, quantile_cont(CASE WHEN i % 5 <> 4 OR user_id % 2 = 0 THEN x END, 0.5) AS med FROM e GROUP BY 1, 2) SELECT user_id, line, CAST(row_number() OVER (PARTITION BY user_id ORDER BY med NULLS LAST, line) AS INTEGER) AS place FROM m")
def o3(spark, d):
    seen = F.when((F.col("i") % 5 != 4) | (F.col("user_id") % 2 == 0), F.col("x"))
    m = events(spark, d).groupBy("user_id", (F.col("i") % 5).alias("line")).agg(F.percentile(seen, F.lit(0.5)).alias("med"))
    return m.select("user_id", "line", F.row_number().over(Window.partitionBy("user_id").orderBy(F.asc_nulls_last("med"), "line")).alias("place"))


@query("o5_neighbour_limits", f"WITH {E_SQL}, b AS (SELECT user_id AS record_id, i % 3 AS col, CAST(floor(x) AS INTEGER) * 100 + i AS y0, CAST(floor(x) AS INTEGER) * 100 + i + 30 AS y1, 60000 AS height FROM e) SELECT *, coalesce(lag(y1) OVER w, 0) AS above, coalesce(lead(y0) OVER w, height) AS below FROM b WINDOW w AS (PARTITION BY record_id, col ORDER BY y0)")
def o5(spark, d):
    y0 = F.floor("x").cast("int") * 100 + F.col("i")
    return Y.neighbour_limits(events(spark, d).select(F.col("user_id").alias("record_id"), (F.col("i") % 3).alias("col"), y0.alias("y0"), (y0 + 30).alias("y1"), F.lit(60000).alias("height")))


@query("o6_systematic_sample", f"WITH {E_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT user_id, i, x FROM n WHERE (i - 1) % greatest(1, CAST(floor(n / 20) AS BIGINT)) = 0")
def o6(spark, d):
    e = events(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    return e.where((F.col("i") - 1) % F.greatest(F.lit(1), F.floor(F.col("n") / 20)) == 0).select("user_id", "i", "x")


@query("o7_best_of_candidates", f"WITH {E_SQL}, c AS (SELECT user_id, i % 4 AS k, count(*) FILTER (x > 40) AS n, round(stddev_pop(x), 6) AS sp FROM e GROUP BY 1, 2) SELECT user_id, k, n, sp FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, sp, k) AS r FROM c) WHERE r = 1")
def o7(spark, d):
    c = events(spark, d).groupBy("user_id", (F.col("i") % 4).alias("k")).agg(F.count_if(F.col("x") > 40).alias("n"), F.round(F.stddev_pop("x"), 6).alias("sp"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "sp", "k")
    return c.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


@query("u1_union_stages", "SELECT 'A' AS stage, o_orderstatus, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'B', o_orderstatus, count(*) FROM orders WHERE o_totalprice > 150000 GROUP BY 2")
def u1(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    n = lambda x: x.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return C.stages({"A": n(o), "B": n(o.where("o_totalprice > 150000"))})


@query("u2_distinct_centres", f"WITH {E_SQL}, c AS (SELECT user_id, list_sort(list_distinct(list(CAST(floor(x / 10) AS BIGINT)))) AS c, count(*) AS n FROM e GROUP BY 1) SELECT user_id, array_to_string(c, ' ') AS centres, len(c) < n AS collapsed FROM c")
def u2(spark, d):
    c = events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_set(F.floor(F.col("x") / 10))).alias("c"), F.count("*").alias("n"))
    return c.select("user_id", F.array_join("c", " ").alias("centres"), (F.size("c") < F.col("n")).alias("collapsed"))


@query("u6_leads_less_bad", f"WITH {E_SQL} SELECT user_id, i FROM e WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.user_id = e.user_id AND b.i = e.i AND b.x < 60)")
def u6(spark, d):
    e = events(spark, d)
    return e.select("user_id", "i").join(e.where("x < 60").select("user_id", "i"), ["user_id", "i"], "left_anti")


# ------------------------------------------------------------------ leads


@query("s18_synthetic", f"WITH {s_sql()} SELECT record_id, lead, count(*) AS n, round(sum(mv), 6) AS total, round(max(mv), 6) AS top FROM s GROUP BY 1, 2")
def s18(spark, d):
    return signals(spark, d).groupBy("record_id", "lead").agg(F.count("*").alias("n"), F.round(F.sum("mv"), 6).alias("total"), F.round(F.max("mv"), 6).alias("top"))


_DERIVED = {k: v for k, v in LIMB.items() if k not in ("I", "II")}
_COMPLETE_SQL = ", w AS (SELECT record_id, i, max(CASE WHEN lead = 'I' THEN mv END) AS x, max(CASE WHEN lead = 'II' THEN mv END) AS y FROM s GROUP BY 1, 2), c AS (SELECT record_id, lead, i, mv FROM s " + " ".join(
    f"UNION ALL SELECT record_id, '{k}', i, {a} * x + {b} * y FROM w" for k, (a, b) in _DERIVED.items()
) + ")"


@query("l2_complete_leads", f"WITH {s_sql(['I', 'II', 'V1'])}{_COMPLETE_SQL} SELECT record_id, lead, count(*) AS n, round(sum(mv), 6) AS total, round(min(mv), 6) AS low FROM c GROUP BY 1, 2")
def l2(spark, d):
    return L.complete(signals(spark, d, ["I", "II", "V1"])).groupBy("record_id", "lead").agg(F.count("*").alias("n"), F.round(F.sum("mv"), 6).alias("total"), F.round(F.min("mv"), 6).alias("low"))


_GAPPED = f"""{s_sql(['I', 'II'], 200)}{_COMPLETE_SQL}, q AS (SELECT record_id, c.lead, i, CASE WHEN (i * 3 + k * 7 + record_id) % 5 < 3 THEN mv END AS mv, a, b FROM c JOIN (VALUES {", ".join(f"('{k}', {j}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for j, (k, (a, b)) in enumerate(LIMB.items()))}) g(lead, k, a, b) USING (lead))"""


def gapped(spark, d):
    k = F.array_position(F.array(*map(F.lit, LIMB)), F.col("lead")) - 1
    return L.complete(signals(spark, d, ["I", "II"], 200, times=len(LIMB) // 2)).withColumn("mv", F.when((F.col("i") * 3 + k * 7 + F.col("record_id")) % 5 < 3, F.col("mv") + F.col("i") % 2 * F.lit(0.0)))


@query("l3_lead_fill", f"WITH {_GAPPED}, n AS (SELECT record_id, i, count(mv) AS n, sum(CASE WHEN mv IS NOT NULL THEN a * a END) AS aa, sum(CASE WHEN mv IS NOT NULL THEN a * b END) AS ab, sum(CASE WHEN mv IS NOT NULL THEN b * b END) AS bb, sum(a * mv) AS ay, sum(b * mv) AS yb FROM q GROUP BY 1, 2) SELECT q.record_id, q.lead, count(q.mv) AS seen, count(coalesce(q.mv, CASE WHEN n >= 2 THEN q.a * (ay * bb - yb * ab) / (aa * bb - ab * ab) + q.b * (yb * aa - ay * ab) / (aa * bb - ab * ab) END)) AS known, round(sum(coalesce(q.mv, CASE WHEN n >= 2 THEN q.a * (ay * bb - yb * ab) / (aa * bb - ab * ab) + q.b * (yb * aa - ay * ab) / (aa * bb - ab * ab) END)), 6) AS total FROM q JOIN n USING (record_id, i) GROUP BY 1, 2")
def l3(spark, d):
    return L.fill(gapped(spark, d)).groupBy("record_id", "lead").agg(F.count("mv").alias("seen"), F.count("filled").alias("known"), F.round(F.sum("filled"), 6).alias("total"))


@query("l4_consistency")
def l4(spark, d):
    """Shares of misfit of the closed-form leads, whose gains break the limb relations on purpose."""
    c = L.consistency(signals(spark, d, list(LIMB)))
    return c.select("record_id", "n", *[F.round(k, 6).alias(k) for k in ("residual", "einthoven", "goldberger")])


SQL["l4_consistency"] = f"""WITH {s_sql(list(LIMB))}, w AS (SELECT record_id, {wide_sql(LIMB)} FROM s GROUP BY record_id, i),
z AS (SELECT *, ({" + ".join(f'({a}) * v_{k}' for k, (a, _) in LIMB.items())}) AS ay, ({" + ".join(f'({b}) * v_{k}' for k, (_, b) in LIMB.items())}) AS yb FROM w),
o AS (SELECT *, (ay * 3.5 - yb * -1.75) / (3.5 * 3.5 - 1.75 * 1.75) AS x, (yb * 3.5 - ay * -1.75) / (3.5 * 3.5 - 1.75 * 1.75) AS y FROM z),
r AS (SELECT record_id, unnest([{", ".join(f'v_{k} - (({a}) * x + ({b}) * y)' for k, (a, b) in LIMB.items())}]) AS off FROM o),
p AS (SELECT record_id, avg(ptp) AS scale FROM (SELECT record_id, lead, quantile_cont(mv, 0.99) - quantile_cont(mv, 0.01) AS ptp FROM s GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT record_id, count(*) AS n, stddev_pop(v_II - v_I - v_III) AS e, stddev_pop(v_aVR + v_aVL + v_aVF) AS g FROM w GROUP BY 1)
SELECT record_id, n, round((SELECT stddev_pop(off) FROM r WHERE r.record_id = e.record_id) / scale, 6) AS residual, round(e / scale, 6) AS einthoven, round(g / scale, 6) AS goldberger FROM e JOIN p USING (record_id)"""


@query("p15_coverage", f"WITH {_GAPPED} SELECT record_id, lead, round(avg(CASE WHEN mv IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM q GROUP BY 1, 2")
def p15(spark, d):
    return L.coverage(gapped(spark, d)).withColumn("coverage", F.round("coverage", 6))


# ------------------------------------------------------------------ delineation

_KEYED = "PARTITION BY record_id, lead ORDER BY i"
_SV_SQL = f"dd AS (SELECT record_id, lead, i, coalesce(mv - lag(mv) OVER ({_KEYED}), 0.0) AS d FROM s), vv AS (SELECT record_id, i, sqrt(sum(d * d)) AS v FROM dd GROUP BY 1, 2), sv AS (SELECT record_id, i, sum(v) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0 AS sv FROM vv)"


@query("d1_spatial_velocity", f"WITH {s_sql(n=260)}, {_SV_SQL} SELECT record_id, i, round(sv, 9) AS sv FROM sv")
def d1(spark, d):
    return D.spatial_velocity(signals(spark, d, n=260), FS, spikes=False).withColumn("sv", F.round("sv", 9))


#: Spans used as known marks of the closed-form beat, in samples.
_MARKS = "b AS (SELECT DISTINCT record_id, CAST(60 + record_id % 5 AS INTEGER) AS qrs_on, CAST(95 + record_id % 5 AS INTEGER) AS qrs_off, CAST(100 + record_id % 3 AS INTEGER) AS t_peak FROM s)"
_BASE = "base AS (SELECT record_id, lead, quantile_cont(mv, 0.5) AS base FROM s JOIN b USING (record_id) WHERE i >= qrs_on - 8 AND i < qrs_on GROUP BY 1, 2)"
_FULL = ["I", "II", "aVF", "V1", "V2", "V5", "V6"]


def marked(spark, d):
    s = signals(spark, d, _FULL, 260)
    b = users(spark, d).select("record_id", (60 + F.col("record_id") % 5).cast("int").alias("qrs_on"), (95 + F.col("record_id") % 5).cast("int").alias("qrs_off"))
    t = users(spark, d).select("record_id", (100 + F.col("record_id") % 3).cast("int").alias("t_peak"))
    return s, b, t, D.baselines(s, b, FS)


@query("d9_baseline", f"WITH {s_sql(_FULL, 260)}, {_MARKS}, {_BASE} SELECT record_id, lead, round(base, 9) AS base FROM base")
def d9(spark, d):
    return marked(spark, d)[3].withColumn("base", F.round("base", 9))


@query("d4_p_magnitude", f"WITH {s_sql(_FULL, 260)}, {_MARKS}, {_BASE}, m AS (SELECT record_id, i, sqrt(sum((mv - base) * (mv - base))) AS m FROM s JOIN base USING (record_id, lead) WHERE lead <> 'aVF' GROUP BY 1, 2) SELECT record_id, i, round(sum(m) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0, 9) AS mag FROM m")
def d4(spark, d):
    s, _, _, base = marked(spark, d)
    return D.p_magnitude(s, base, FS).withColumn("mag", F.round("mag", 9))


@query("d13_net_deflection", f"WITH {s_sql(_FULL, 260)}, {_MARKS}, {_BASE} SELECT record_id, lead, 'qrs' AS tag, round(max(mv - base) + min(mv - base), 9) AS net FROM s JOIN b USING (record_id) JOIN base USING (record_id, lead) WHERE i >= qrs_on AND i < qrs_off GROUP BY 1, 2")
def d13(spark, d):
    s, b, _, base = marked(spark, d)
    return D.net_deflection(s, base, b.select("record_id", F.col("qrs_on").alias("a"), F.col("qrs_off").alias("b")), "qrs").withColumn("net", F.round("net", 9))


@query("d14_axis", f"WITH {s_sql(_FULL, 260)}, {_MARKS}, {_BASE}, n AS (SELECT record_id, lead, max(mv - base) + min(mv - base) AS net FROM s JOIN b USING (record_id) JOIN base USING (record_id, lead) WHERE i >= qrs_on AND i < qrs_off GROUP BY 1, 2), p AS (SELECT record_id, max(CASE WHEN lead = 'I' THEN net END) AS x, max(CASE WHEN lead = 'aVF' THEN net END) / (sqrt(3.0) / 2) AS y FROM n GROUP BY 1) SELECT record_id, 'qrs' AS tag, round(degrees(atan2(y, x)), 6) AS axis FROM p")
def d14(spark, d):
    s, b, _, base = marked(spark, d)
    net = D.net_deflection(s, base, b.select("record_id", F.col("qrs_on").alias("a"), F.col("qrs_off").alias("b")), "qrs")
    return D.axes(net).withColumn("axis", F.round("axis", 6))


@query("d15_qtc", f"WITH {E_SQL}, q AS (SELECT user_id, i, 300.0 + x / 5 AS qt, 500.0 + x * 2 AS rr FROM e) SELECT user_id, i, round(qt / sqrt(rr / 1000.0), 6) AS bazett, round(qt / pow(rr / 1000.0, 1.0 / 3), 6) AS fridericia, round(qt + 154.0 * (1 - rr / 1000.0), 6) AS framingham, round(qt + 1.75 * (60.0 / (rr / 1000.0) - 60.0), 6) AS hodges FROM q")
def d15(spark, d):
    e = events(spark, d).withColumn("q", S.corrected_qt(300.0 + F.col("x") / 5, 500.0 + F.col("x") * 2))
    return e.select("user_id", "i", *[F.round(f"q.{k}", 6).alias(k) for k in ("bazett", "fridericia", "framingham", "hodges")])


@query("d12_t_shift", f"WITH {E_SQL} SELECT user_id, i, round(16.0 - least(26.0, greatest(0.0, 0.12 * (825.0 - (400.0 + x)))), 6) AS shift FROM e")
def d12(spark, d):
    return events(spark, d).select("user_id", "i", F.round(S.t_end_shift_ms(400.0 + F.col("x")), 6).alias("shift"))


@query("d16_st_levels", f"WITH {s_sql(_FULL, 260)}, {_MARKS}, {_BASE} SELECT record_id, lead, round(max(CASE WHEN i = qrs_off THEN mv - base END), 9) AS j, round(max(CASE WHEN i = qrs_off + 15 THEN mv - base END), 9) AS j60, round(max(CASE WHEN i = qrs_off + 20 THEN mv - base END), 9) AS j80 FROM s JOIN b USING (record_id) JOIN base USING (record_id, lead) GROUP BY 1, 2")
def d16(spark, d):
    s, b, _, base = marked(spark, d)
    return D.st_levels(s, base, b, FS).select("record_id", "lead", *[F.round(k, 9).alias(k) for k in ("j", "j60", "j80")])


_AMP = "amp AS (SELECT record_id, lead, max(CASE WHEN i >= qrs_on AND i < qrs_off THEN mv - base END) AS r, min(CASE WHEN i >= qrs_on AND i < qrs_off THEN mv - base END) AS s, max(CASE WHEN i = t_peak THEN mv - base END) AS t FROM s JOIN b USING (record_id) JOIN base USING (record_id, lead) GROUP BY 1, 2)"


@query("d16_amplitudes", f"WITH {s_sql(_FULL, 260)}, {_MARKS}, {_BASE}, {_AMP} SELECT record_id, lead, round(r, 9) AS r, round(s, 9) AS s, round(t, 9) AS t FROM amp")
def d16b(spark, d):
    s, b, t, base = marked(spark, d)
    return D.amplitudes(s, base, b, t).select("record_id", "lead", *[F.round(k, 9).alias(k) for k in "rst"])


@query("d17_sokolow", f"WITH {s_sql(_FULL, 260)}, {_MARKS}, {_BASE}, {_AMP}, w AS (SELECT record_id, abs(max(CASE WHEN lead = 'V1' THEN s END)) AS s1, max(CASE WHEN lead = 'V5' THEN r END) AS r5, max(CASE WHEN lead = 'V6' THEN r END) AS r6 FROM amp GROUP BY 1) SELECT record_id, round((s1 + greatest(r5, r6, 0.0)) * 10.0, 6) AS mm, CASE WHEN r6 >= r5 THEN 'V6' ELSE 'V5' END AS lead, (s1 + greatest(r5, r6, 0.0)) * 10.0 >= 35.0 AS over FROM w")
def d17(spark, d):
    s, b, t, base = marked(spark, d)
    a = D.amplitudes(s, base, b, t).groupBy("record_id").agg(*[F.max(F.when(F.col("lead") == k, F.col(c))).alias(n) for k, c, n in (("V1", "s", "s1"), ("V5", "r", "r5"), ("V6", "r", "r6"))])
    x = a.select("record_id", S.sokolow(F.col("s1"), F.col("r5"), F.col("r6")).alias("x"))
    return x.select("record_id", F.round("x.mm", 6).alias("mm"), "x.lead", "x.over")


@query("b1_anchor_peaks")
def b1(spark, d):
    """Peaks of the lead seen longest, by a filter kernel a record."""
    return B.anchor_peaks(signals(spark, d), FS)


@query("d18_measurements")
def d18(spark, d):
    """The whole chain: peaks, beats, bounds, waves, intervals, axes, flags."""
    beats, stacks, rates, r = B.representative(L.complete(signals(spark, d)), FS)
    m = D.measurements(beats, stacks, rates, r, FS)
    return m.select("record_id", "hr", "p_ms", "pr_ms", "qrs_ms", "qt_ms", "axis_qrs", "n_beats", F.array_join("flags", " ").alias("flags"))


@query("v6_erase_p", f"WITH {s_sql(['I', 'II'], 120)}, sp AS (SELECT DISTINCT record_id, 20 AS a, CAST(40 + record_id % 6 AS INTEGER) AS z FROM s), en AS (SELECT s.record_id, lead, a, z, max(CASE WHEN i = a THEN mv END) AS y0, max(CASE WHEN i = z THEN mv END) AS y1 FROM s JOIN sp USING (record_id) GROUP BY 1, 2, 3, 4) SELECT s.record_id, s.lead, i, round(CASE WHEN i BETWEEN a AND z THEN y0 + (y1 - y0) * (i - a) / (z - a) ELSE mv END, 9) AS mv FROM s JOIN en USING (record_id, lead)")
def v6(spark, d):
    spans = users(spark, d).select("record_id", F.lit(20).alias("a"), (40 + F.col("record_id") % 6).cast("int").alias("b"))
    return C.erase(signals(spark, d, ["I", "II"], 120), spans).select("record_id", "lead", "i", F.round("mv", 9).alias("mv"))


@query("v1_signal_agreement", f"WITH {s_sql(['I', 'II'], 300)}, p AS (SELECT record_id, lead, mv AS truth, 0.97 * mv + CAST(i % 5 AS DOUBLE) / 200.0 AS ours FROM s) SELECT record_id, lead, count(*) AS n, round(corr(ours, truth), 6) AS corr, round(covar_pop(ours, truth) / var_pop(truth), 6) AS gain, round(10 * log10(var_pop(truth) / var_pop(ours - truth)), 4) AS snr, round(sqrt(avg((ours - truth) * (ours - truth))) * 1000.0, 6) AS rms_uv FROM p GROUP BY 1, 2")
def v1(spark, d):
    p = signals(spark, d, ["I", "II"], 300).select("record_id", "lead", F.col("mv").alias("truth"), (0.97 * F.col("mv") + (F.col("i") % 5) / F.lit(200.0)).alias("ours"))
    a = C.signal_agreement(p, ["record_id", "lead"], "ours", "truth")
    return a.select("record_id", "lead", "n", F.round("corr", 6).alias("corr"), F.round("gain", 6).alias("gain"), F.round("snr", 4).alias("snr"), F.round("rms_uv", 6).alias("rms_uv"))


@query("v2_peak_height_ratio", f"WITH {s_sql(['I', 'II'], 400)}, p AS (SELECT DISTINCT record_id, CAST(unnest([66, 266]) AS INTEGER) AS peak FROM s), t AS (SELECT s.record_id, lead, peak, max(mv) AS t, max(mv * 0.9 + 0.01) AS o FROM s JOIN p ON s.record_id = p.record_id AND i BETWEEN peak - 12 AND peak + 12 GROUP BY 1, 2, 3) SELECT record_id, lead, count(*) AS n, round(quantile_cont(o / t, 0.5), 6) AS ratio FROM t WHERE abs(t) >= 0.15 GROUP BY 1, 2 HAVING count(*) >= 2")
def v2(spark, d):
    s = signals(spark, d, ["I", "II"], 400)
    p = users(spark, d).withColumn("peak", F.explode(F.array(F.lit(66), F.lit(266))))
    return C.peak_height_ratio(s, s.withColumn("mv", F.col("mv") * 0.9 + 0.01), p, 12).withColumn("ratio", F.round("ratio", 6))


@query("v4_differences", "WITH m AS (SELECT o_orderkey AS k, o_totalprice / 1000.0 AS v, CAST(o_orderkey % 360 - 180 AS DOUBLE) AS ax FROM orders), t AS (SELECT o_orderkey AS k, o_totalprice / 1010.0 AS v, CAST((o_orderkey * 7) % 360 - 180 AS DOUBLE) AS ax FROM orders WHERE o_orderstatus = 'O') SELECT k AS ecg_id, round(m.v - t.v, 6) AS qrs_ms, round(((m.ax - t.ax + 180.0) % 360.0 + 360.0) % 360.0 - 180.0, 6) AS axis_qrs FROM m JOIN t USING (k)")
def v4(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    none = [F.lit(None).cast("double").alias(c) for c in ("p_ms", "pr_ms", "qt_ms", "axis_p", "axis_t")]
    row = lambda df, per, k: df.select(F.col("o_orderkey").alias("ecg_id"), (F.col("o_totalprice") / per).alias("qrs_ms"), ((F.col("o_orderkey") * k) % 360 - 180).cast("double").alias("axis_qrs"), *none)
    diff = C.differences(row(o, 1000.0, 1), row(o.where("o_orderstatus = 'O'"), 1010.0, 7))
    return diff.select("ecg_id", F.round("qrs_ms", 6).alias("qrs_ms"), F.round("axis_qrs", 6).alias("axis_qrs"))


# ------------------------------------------------------------------ predicates, reports


@query("p10_problem_list", f"WITH {E_SQL} SELECT user_id, i, trim(concat(CASE WHEN x / 40 < 6 THEN 'red:resolution ' WHEN x / 40 < 8 THEN 'warn:resolution ' ELSE '' END, CASE WHEN x / 500 < 0.85 THEN 'warn:row coverage ' ELSE '' END, CASE WHEN x / 300 > 1 THEN 'red:layout ' WHEN x / 300 > 0.3 THEN 'warn:layout ' ELSE '' END, CASE WHEN i % 4 = 0 THEN 'warn:scale corrected ' WHEN i % 3 = 0 THEN 'red:scale disagrees ' ELSE '' END, CASE WHEN i % 5 = 0 THEN 'red:leads unverified ' WHEN x / 1000 > 0.15 THEN 'red:leads inconsistent ' ELSE '' END)) AS problems FROM e")
def p10(spark, d):
    x, i = F.col("x"), F.col("i")
    p = S.problems(x / 40, x / 500, x / 300, i % 4 == 0, i % 3 != 0, F.when(i % 5 != 0, x / 1000))
    return events(spark, d).select("user_id", "i", F.array_join(F.transform(p, lambda y: F.concat(y["level"], F.lit(":"), y["what"])), " ").alias("problems"))


@query("p11_tiles", f"WITH {E_SQL} SELECT user_id, i, CASE WHEN x < 20 THEN 'low' WHEN x > 60 THEN 'high' ELSE 'ok' END AS state, round(least(1.0, greatest(0.0, (x - 10.0) / 100.0)), 6) AS place FROM e")
def p11(spark, d):
    t = S.tile(F.col("x"), F.lit(20.0), F.lit(60.0), F.lit(10.0), F.lit(110.0))
    return events(spark, d).select("user_id", "i", t["state"].alias("state"), F.round(t["place"], 6).alias("place"))


@query("p12_axis_word", f"WITH {E_SQL}, a AS (SELECT user_id, i, x * 0.7 - 170 AS a FROM e) SELECT user_id, i, CASE WHEN a BETWEEN -30 AND 90 THEN 'normal' WHEN a >= -90 AND a < -30 THEN 'left deviation' WHEN a > 90 AND a <= 180 THEN 'right deviation' ELSE 'extreme' END AS word FROM a")
def p12(spark, d):
    return events(spark, d).select("user_id", "i", S.axis_word(F.col("x") * 0.7 - 170).alias("word"))


@query("p13_st_state", f"WITH {E_SQL} SELECT user_id, i, CASE WHEN x / 100 - 2 >= CASE WHEN i % 3 = 0 THEN 2.0 ELSE 1.0 END THEN 'up' WHEN x / 100 - 2 <= -1.0 THEN 'down' ELSE 'ok' END AS state FROM e")
def p13(spark, d):
    lead = F.when(F.col("i") % 3 == 0, "V2").otherwise("I")
    return events(spark, d).select("user_id", "i", S.st_state(lead, F.col("x") / 100 - 2).alias("state"))


@query("p14_flags", f"WITH {E_SQL} SELECT user_id, i, trim(concat(CASE WHEN i % 7 = 0 THEN 't ' WHEN x + 200 < 300 OR x + 200 > 600 THEN 'qt ' ELSE '' END, CASE WHEN i % 5 = 0 THEN 'p ' ELSE '' END, CASE WHEN i % 6 < 3 THEN 'beats ' ELSE '' END, CASE WHEN i % 12 < 6 THEN 'leads ' ELSE '' END)) AS flags FROM e")
def p14(spark, d):
    x, i = F.col("x"), F.col("i")
    f = S.flags(F.when(i % 7 != 0, x), x + 200, F.when(i % 5 != 0, x), i % 6, i % 12)
    return events(spark, d).select("user_id", "i", F.array_join(f, " ").alias("flags"))


@query("p16_arc_difference", f"WITH {E_SQL} SELECT user_id, i, round(((x - 400.0 + 180.0) % 360.0 + 360.0) % 360.0 - 180.0, 6) AS arc FROM e")
def p16(spark, d):
    return events(spark, d).select("user_id", "i", F.round(S.arc_difference(F.col("x"), F.lit(400.0)), 6).alias("arc"))


@query("p1_milliseconds_to_samples", f"WITH {E_SQL} SELECT user_id, i, CAST(round_even(floor(x) * 250 / 1000.0, 0) AS INTEGER) AS n FROM e")
def p1(spark, d):
    return events(spark, d).select("user_id", "i", S.samples_of(F.floor("x"), 250).alias("n"))


_GRIDS = [("3x4", 12, 0), ("3x4_1R", 13, 1), ("3x4_3R", 15, 3), ("6x2", 12, 0), ("6x2_1R", 13, 1), ("12x1", 12, 0)]


@query(
    "s6_layout_cells",
    f"WITH {E_SQL}, p AS (SELECT user_id, i, CAST(floor(x) AS BIGINT) % {len(_GRIDS)} AS k FROM e) SELECT user_id, layout, CAST(count(*) AS INTEGER) AS pages, CAST(sum(cells) AS INTEGER) AS cells, CAST(sum(strips) AS INTEGER) AS strips "
    f"FROM p JOIN (VALUES {', '.join(str((k, *g)) for k, g in enumerate(_GRIDS))}) t(k, layout, cells, strips) ON p.k = t.k GROUP BY 1, 2",
)
def s6(spark, d):
    """Each event is a page in one of the layouts; its cells are those of the catalogue."""
    name = F.array(*[F.lit(g[0]) for g in _GRIDS])[(F.floor("x") % len(_GRIDS)).cast("int")]
    pages = events(spark, d).select("user_id", "i", name.alias("layout")).join(F.broadcast(readers.layout_cells(spark)), "layout")
    return pages.groupBy("user_id", "layout").agg(F.count_distinct("i").cast("int").alias("pages"), F.count("*").cast("int").alias("cells"), F.count_if("is_rhythm").cast("int").alias("strips"))


@query("i1_otsu_threshold", f"WITH {E_SQL}, h AS (SELECT user_id AS record_id, CAST(floor(x / 2) AS INTEGER) AS v, count(*) AS c FROM e GROUP BY 1, 2), r AS (SELECT record_id, v, sum(c) OVER w AS n0, sum(c * v) OVER w AS s0, sum(c) OVER (PARTITION BY record_id) AS n, sum(c * v) OVER (PARTITION BY record_id) AS s FROM h WINDOW w AS (PARTITION BY record_id ORDER BY v)), b AS (SELECT record_id, v, round(n0 * (n - n0) * (s0 / n0 - (s - s0) / (n - n0)) * (s0 / n0 - (s - s0) / (n - n0)) / (n * n), 9) AS b FROM r WHERE n0 < n) SELECT record_id, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY b DESC, v) AS k FROM b) WHERE k = 1")
def i1(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("record_id"), F.floor(F.col("x") / 2).cast("int").alias("gray"))
    return Y.histogram_threshold(e, "record_id", "gray")


def page(spark, d):
    """A page of ink rows for each user: four wavy lines on 240 x 320 pixels."""
    u = synthetic.placed(users(spark, d), "record_id", 4 * 320)
    xs = synthetic.crossed(u, "at", 4 * 320).select("record_id", F.floor(F.col("at") / 4).cast("int").alias("x"), (F.col("at") % 4).alias("k"))
    y = 30 + 60 * F.col("k") + (F.col("x") * (F.col("k") + 3) + F.col("record_id")) % 17
    sizes = u.select("record_id", F.lit(320).alias("width"), F.lit(240).alias("height"))
    return xs.select("record_id", "x", y.cast("int").alias("y")), sizes


_PROFILE_SQL = "ink AS (SELECT record_id, CAST(30 + 60 * k + (x * (k + 3) + record_id) % 17 AS INTEGER) AS y FROM (SELECT DISTINCT user_id AS record_id FROM events), (SELECT unnest(range(320)) AS x), (SELECT unnest(range(4)) AS k)), m AS (SELECT r.record_id, g.y, coalesce(c, 0) / 320.0 AS m FROM (SELECT DISTINCT record_id FROM ink) r CROSS JOIN (SELECT unnest(range(240)) AS y) g LEFT JOIN (SELECT record_id, y, count(*) AS c FROM ink GROUP BY 1, 2) c ON c.record_id = r.record_id AND c.y = g.y), b AS (SELECT m.record_id, m.y, sum(n.m) / 7 AS b FROM m, (SELECT unnest(range(-3, 4)) AS o) o, m n WHERE n.record_id = m.record_id AND n.y = CASE WHEN m.y + o < 0 THEN -(m.y + o) WHEN m.y + o > 239 THEN 478 - (m.y + o) ELSE m.y + o END GROUP BY 1, 2)"


@query("t1_row_profile", f"WITH {_PROFILE_SQL} SELECT record_id, CAST(y AS INTEGER) AS y, round(b / max(b) OVER (PARTITION BY record_id), 6) AS cover FROM b")
def t1(spark, d):
    ink_rows, sizes = page(spark, d)
    return Y.row_profile(ink_rows, sizes).withColumn("cover", F.round("cover", 6))


_T6_SQL = f"""WITH {_PROFILE_SQL}, c AS (SELECT record_id, CAST(y AS INTEGER) AS y, b / max(b) OVER (PARTITION BY record_id) AS cover FROM b),
z AS (SELECT record_id, min(y) AS y0, max(y) AS y1 FROM c WHERE cover > 0.15 GROUP BY 1), s AS (SELECT record_id, n, k, (y1 - y0) / CAST(n AS DOUBLE) AS pitch, y0 + (k + 0.5) * ((y1 - y0) / CAST(n AS DOUBLE)) AS mid FROM z, (VALUES (4), (7), (12)) t(n), (SELECT unnest(range(12)) AS k) WHERE k < n),
r AS (SELECT s.record_id, n, k, min(struct_pack(v := -round(cover, 9), y := c.y)).y AS centre FROM s JOIN c ON c.record_id = s.record_id AND c.y BETWEEN ceil(mid - 0.4 * pitch) AND floor(mid + 0.4 * pitch) GROUP BY 1, 2, 3),
l AS (SELECT *, lead(centre) OVER (PARTITION BY record_id, n ORDER BY centre) AS after FROM r),
o AS (SELECT l.record_id, n, avg(cover) AS o, count(DISTINCT centre) AS m, stddev_pop(after - centre) AS sd, avg(after - centre) AS gap FROM l JOIN c ON c.record_id = l.record_id AND c.y = centre GROUP BY 1, 2),
f AS (SELECT l.record_id, n, avg(cover) AS f FROM l JOIN c ON c.record_id = l.record_id AND after - centre >= 2 AND c.y BETWEEN ceil(centre + (after - centre) / 4.0) AND floor(after - (after - centre) / 4.0) GROUP BY 1, 2),
g AS (SELECT o.record_id, o.n, CASE WHEN m < o.n THEN -1.0 ELSE o - coalesce(f, 0) - 0.6 * coalesce(sd / nullif(gap, 0), 0) END AS score FROM o LEFT JOIN f ON f.record_id = o.record_id AND f.n = o.n)
SELECT record_id, n_rows, CASE n_rows WHEN 4 THEN '3x4_1R' WHEN 7 THEN '6x2_1R' ELSE '12x1' END AS layout FROM (SELECT record_id, min(struct_pack(v := -round(score, 9), n := n)).n AS n_rows FROM g GROUP BY 1)"""


@query("t6_layout_choice", _T6_SQL)
def t6(spark, d):
    """Rows counted by the fit of even splits of the covered stretch."""
    ink_rows, sizes = page(spark, d)
    profile = Y.row_profile(ink_rows, sizes)
    return Y.choose_layout(Y.layout_scores(profile, Y.row_centres(profile, [4, 7, 12])))


@query(
    "t11_traces",
    """WITH RECURSIVE ink AS (SELECT record_id, CAST(x AS INTEGER) AS x, k, CAST(30 + 60 * k + (x * (k + 3) + record_id) % 17 AS INTEGER) AS y FROM (SELECT DISTINCT user_id AS record_id FROM events), (SELECT unnest(range(320)) AS x), (SELECT unnest(range(4)) AS k)),
l AS (SELECT record_id, CAST(y // 60 AS INTEGER) AS line, x, CAST(y AS DOUBLE) AS centre FROM ink),
b AS (SELECT record_id, line, (min(struct_pack(c := -c, bin := bin)).bin + 0.5) * 2 AS base FROM (SELECT record_id, line, floor(centre / 2) AS bin, count(*) AS c FROM l GROUP BY 1, 2, 3) GROUP BY 1, 2),
w AS (SELECT record_id, line, -1 AS x, base AS at, CAST(NULL AS DOUBLE) AS y FROM b
  UNION ALL SELECT w.record_id, w.line, w.x + 1, CASE WHEN abs(l.centre - w.at) <= 70 THEN l.centre ELSE w.at END, CASE WHEN abs(l.centre - w.at) <= 70 THEN l.centre END FROM w LEFT JOIN l ON l.record_id = w.record_id AND l.line = w.line AND l.x = w.x + 1 WHERE w.x < 319)
SELECT record_id, line, count(y) AS n, round(avg(y), 6) AS mean, count(y) / 320.0 AS coverage FROM w WHERE x >= 0 GROUP BY 1, 2""",
)
def t11(spark, d):
    """All lines of each page, 60 rows apart, followed column by column."""
    ink_rows, _ = page(spark, d)
    keys = ["record_id", "line"]
    clusters = Y.column_clusters(ink_rows.withColumn("line", F.floor(F.col("y") / 60).cast("int")), keys)
    t = Y.traces(clusters, keys, clusters.select(*keys).distinct().withColumn("width", F.lit(320)))
    return t.groupBy(*keys).agg(F.count("y").alias("n"), F.round(F.avg("y"), 6).alias("mean"), F.max("coverage").alias("coverage"))


@query("t18_pulse_window", f"WITH {E_SQL}, w AS (SELECT user_id, i - 1 AS x, CASE WHEN i % 3 = 0 THEN 0 ELSE x END AS c, max(i) OVER (PARTITION BY user_id) AS width FROM e), m AS (SELECT *, quantile_cont(CASE WHEN x >= floor(0.35 * width) AND x < floor(0.9 * width) AND c > 0 THEN c END, 0.5) OVER (PARTITION BY user_id) AS med FROM w), h AS (SELECT user_id, x, x - row_number() OVER (PARTITION BY user_id ORDER BY x) AS g FROM m WHERE x < floor(0.3 * width) AND c > 1.5 * med), r AS (SELECT user_id, min(x) AS a, count(*) AS n FROM h GROUP BY user_id, g) SELECT user_id AS record_id, a, n AS length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, a) AS k FROM r) WHERE k = 1")
def t18(spark, d):
    c = F.when(F.col("i") % 3 == 0, 0.0).otherwise(F.col("x"))
    return Y.pulse_window(events(spark, d).select(F.col("user_id").alias("record_id"), (F.col("i") - 1).alias("x"), c.alias("c")))


def _rounded(x, places):
    """x as the twins round it, by multiplying: F.round() goes by the decimal digits, which differ where a product ends in a half."""
    scaled = F.col(x) * 10.0**places
    return F.when(F.abs(scaled) < 2.0**52, F.round(scaled) / 10.0**places).otherwise(F.col(x))


@query("t22_reconcile_scale", f"WITH {E_SQL}, p AS (SELECT user_id, i, x, (8.0 / (x / 50)) AS ratio FROM e), c AS (SELECT *, abs(ratio - 1) <= 0.15 AS agrees FROM p) SELECT user_id, i, round(ratio, 6) AS ratio, agrees, (i % 9 >= 5 AND x / 5000 <= 0.08 AND NOT agrees) AS applied, round(CASE WHEN i % 9 >= 5 AND x / 5000 <= 0.08 AND NOT agrees THEN ratio ELSE 1.0 END, 6) AS gain FROM c")
def t22(spark, d):
    # as the twin divides: x / 5 / 10 is not x / 50 in the last place
    e = events(spark, d).withColumn("s", Y.agreement(F.col("x") / 50, F.lit(8.0)))
    e = e.withColumn("c", Y.correction(F.col("x") / 5, F.col("s.ratio"), F.col("s.agrees"), F.col("i") % 9, F.col("x") / 5000, F.lit(2000.0)))
    return e.select("user_id", "i", _rounded("s.ratio", 6).alias("ratio"), "s.agrees", "c.applied", _rounded("c.gain", 6).alias("gain"))


@query("t34_seconds_per_pixel", f"WITH {E_SQL}, m AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY user_id) AS med FROM e) SELECT user_id, round(2.5 / avg(x), 9) AS sec_px FROM m WHERE x < 2 * med GROUP BY user_id")
def t34(spark, d):
    return Y.seconds_per_pixel(events(spark, d), "user_id", "x").withColumn("sec_px", F.round("sec_px", 9))


@query("k10_measurement_json")
def k10(spark, d):
    """Measurements as the JSON a page hands over."""
    beats, stacks, rates, r = B.representative(L.complete(signals(spark, d)), FS)
    return R.clipboard_json(D.measurements(beats, stacks, rates, r, FS))


@query("k2_canonical_rows", f"WITH {s_sql(n=60)} SELECT record_id, i AS sample, {', '.join(f'''round(max(CASE WHEN lead = '{x}' THEN mv END) * 1000.0, 3) + 0.0 AS \"{x}\"''' for x in INDEPENDENT)} FROM s GROUP BY 1, 2")
def k2(spark, d):
    return R.canonical_rows(signals(spark, d, n=60), INDEPENDENT)


@query("k13_grid_lines", "WITH w AS (SELECT user_id AS record_id, 100 + CAST(user_id % 9 AS INTEGER) AS width, 4.0 + (user_id % 3) AS mm FROM (SELECT DISTINCT user_id FROM events)) SELECT record_id, CAST(k AS INTEGER) AS k, round(k * mm, 6) AS x, k % 5 = 0 AS major FROM (SELECT *, unnest(range(CAST(floor(width / mm) AS BIGINT) + 1)) AS k FROM w)")
def k13(spark, d):
    u = users(spark, d).select("record_id", (100 + F.col("record_id") % 9).cast("int").alias("width"), (F.lit(4.0) + F.col("record_id") % 3).alias("mm"))
    return R.grid_lines(u).withColumn("x", F.round("x", 6))


@query("s14_engine_metadata", "SELECT user_id AS path, 'page' || user_id AS file, round(user_id / 100.0, 6) AS matching_cost, user_id % 2 = 0 AS is_flipped, CASE WHEN user_id % 3 > 0 THEN '3x4' END AS layout FROM (SELECT DISTINCT user_id FROM events)")
def s14(spark, d):
    u = users(spark, d)
    line = F.concat(F.lit("file_path,matching_cost,is_flipped,lead_layout\npage"), F.col("record_id"), F.lit(","), (F.col("record_id") / 100.0).cast("string"), F.lit(","), F.when(F.col("record_id") % 2 == 0, "True").otherwise("False"), F.lit(","), F.when(F.col("record_id") % 3 > 0, "3x4").otherwise("Unknown layout"), F.lit("\n"))
    return readers.engine_metadata(u.select(F.col("record_id").alias("path"), line.alias("text"))).withColumn("matching_cost", F.round("matching_cost", 6))


@query("s11_diagnosis_codes", "SELECT CAST(c_custkey AS INTEGER) AS ecg_id, c AS code, CAST(v AS DOUBLE) AS confidence FROM customer, (VALUES ('NORM', 80.0), ('SR', 0.0)) t(c, v)")
def s11(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return readers.diagnosis_codes(c.select(F.col("c_custkey").alias("ecg_id"), F.lit("{'NORM': 80.0, 'SR': 0.0}").alias("scp_codes")))


@query("hash_content_key", "SELECT c_custkey, substr(sha1(c_name || '|m1'), 1, 16) AS key FROM customer")
def content_key(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", S.content_key(F.col("c_name").cast("binary"), "m1").alias("key"))


# ------------------------------------------------------------------ page geometry


@query("p20_content_box", f"WITH {E_SQL} SELECT user_id AS record_id, CAST(trunc(min(i) - 16 * 2.5) AS INTEGER) AS x0, CAST(trunc(max(i) + 8 * 2.5) AS INTEGER) AS x1, CAST(trunc(min(floor(x)) - 10 * 2.5) AS INTEGER) AS y0, CAST(trunc(max(floor(x)) + 8 * 2.5) AS INTEGER) AS y1 FROM e GROUP BY 1")
def p20(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("record_id"), F.col("i").alias("col"), F.floor("x").alias("y")).withColumnRenamed("col", "x")
    return Y.content_box(e, 2.5)


@query("t33_rescale_unknown_scale", f"WITH {E_SQL}, r AS (SELECT user_id, i, x, min(x) OVER (PARTITION BY user_id) AS lo, max(x) OVER (PARTITION BY user_id) AS hi FROM e) SELECT user_id, i, round(CASE WHEN greatest(abs(lo), abs(hi)) > 200 AND hi > lo THEN (x - lo) / (hi - lo) * 2 - 1 ELSE x END, 6) AS mv FROM r")
def t33(spark, d):
    return Y.rescaled(events(spark, d).select("user_id", "i", F.col("x").alias("mv")), ["user_id"], 200.0).withColumn("mv", F.round("mv", 6))


@query("t24_column_offset", f"WITH {E_SQL}, l AS (SELECT user_id, i AS x, i % 7 AS y FROM e), q AS (SELECT user_id, i + user_id % 4 AS x, i % 7 AS y, x AS p FROM e), s AS (SELECT l.user_id, dx, round(sum(p), 9) AS s FROM l, (SELECT CAST(unnest(range(-5, 6)) AS INTEGER) AS dx) d, q WHERE q.user_id = l.user_id AND q.x = l.x + dx AND q.y = l.y GROUP BY 1, 2) SELECT user_id AS record_id, dx FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, dx) AS k FROM s) WHERE k = 1")
def t24(spark, d):
    e = events(spark, d).withColumnRenamed("user_id", "record_id").withColumnRenamed("x", "p")
    lines = e.select("record_id", F.col("i").alias("x"), (F.col("i") % 7).alias("y"))
    return Y.column_offset(lines, e.select("record_id", (F.col("i") + F.col("record_id") % 4).alias("x"), (F.col("i") % 7).alias("y"), "p"), 5)


@query("a18_union_of_maps", f"WITH {E_SQL} SELECT a.user_id AS record_id, a.i AS x, a.i % 5 AS y, greatest(a.x, b.x) AS p FROM e a JOIN e b ON a.user_id = b.user_id AND b.i = a.i + 1")
def a18(spark, d):
    e = events(spark, d).withColumnRenamed("user_id", "record_id").withColumnRenamed("x", "p")
    a = e.select("record_id", F.col("i").alias("x"), (F.col("i") % 5).alias("y"), "p")
    return Y.union_maps(a, e.select("record_id", (F.col("i") - 1).alias("x"), ((F.col("i") - 1) % 5).alias("y"), "p"))


@query("t16_assemble_cells", f"WITH {E_SQL}, c AS (SELECT user_id, CAST(i % 3 AS VARCHAR) AS lead, CAST(i / 3 AS INTEGER) % 9 AS j, i % 2 = 0 AS r, x FROM e WHERE x < 90) SELECT user_id AS record_id, lead, j AS i, coalesce(max(CASE WHEN r THEN x END), max(CASE WHEN NOT r THEN x END)) AS mv FROM c GROUP BY 1, 2, 3")
def t16(spark, d):
    c = events(spark, d).where("x < 90").select(F.col("user_id").alias("record_id"), (F.col("i") % 3).cast("string").alias("lead"), (F.bround(F.col("i") / 3).cast("int") % 9).alias("i"), (F.col("i") % 2 == 0).alias("is_rhythm"), F.col("x").alias("mv"))
    return Y.assemble(c)


@query("v7_probe_peaks", f"WITH {s_sql(['I', 'II'], 300)}, o AS (SELECT *, i - row_number() OVER (PARTITION BY record_id, lead ORDER BY i) AS g FROM s WHERE mv > 0.2), t AS (SELECT *, max(mv) OVER (PARTITION BY record_id, lead, g) AS top FROM o) SELECT record_id, lead, min(i) AS a, count(*) FILTER (mv >= top / 2) AS width, round(max(top), 6) AS top FROM t GROUP BY record_id, lead, g")
def v7(spark, d):
    return Y.probe_peaks(signals(spark, d, ["I", "II"], 300), 0.2).withColumn("top", F.round("top", 6))


from pulsegrid.plans import beat_queries, ink_queries, pair_queries  # noqa: E402, F401 - add their queries
