"""Queries on pairs of signals, traces of two methods, probes and lists of files, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import compare as C
from pulsegrid.operators import layout as Y
from pulsegrid.operators import leads as L
from pulsegrid.plans import report as R
from pulsegrid.plans.queries import E_SQL, events, query, s_sql, signals, users
from pulsegrid.schema import LIMB
from pulsegrid.sources import synthetic

_LEVEL = "quantile_cont({0}, 0.5) OVER (PARTITION BY record_id, lead)"
_V3 = f"""WITH {s_sql(["I", "II"], 300)}, t AS (SELECT record_id, lead, i, mv - {_LEVEL.format("mv")} AS t FROM s),
o AS (SELECT record_id, lead, i + 3 + record_id % 4 AS i, u - {_LEVEL.format("u")} AS o FROM (SELECT *, mv * 0.9 + 0.01 AS u FROM s)),
m AS (SELECT record_id, lead, lag, i + lag AS i, t FROM t, (SELECT unnest(range(-8, 9)) AS lag)),
c AS (SELECT record_id, lead, lag, round(sum(o * t), 9) AS c FROM o JOIN m USING (record_id, lead, i) GROUP BY 1, 2, 3),
b AS (SELECT record_id, lead, lag FROM (SELECT *, row_number() OVER (PARTITION BY record_id, lead ORDER BY c DESC, lag) AS k FROM c) WHERE k = 1),
p AS (SELECT record_id, lead, lag, p0 + lag AS peak FROM b, (SELECT unnest([8, 66, 230]) AS p0)),
w AS (SELECT p.*, o.i, o, t FROM p JOIN o ON o.record_id = p.record_id AND o.lead = p.lead AND o.i >= peak - 12 AND o.i < peak + 12 JOIN t ON t.record_id = p.record_id AND t.lead = p.lead AND t.i = o.i - p.lag),
k AS (SELECT *, count(*) OVER (PARTITION BY record_id, lead, peak) AS n, first_value(i) OVER z AS ti, first_value(t) OVER z AS tt FROM w WINDOW z AS (PARTITION BY record_id, lead, peak ORDER BY round(abs(t), 9) DESC, i))
SELECT record_id, lead, peak, round(abs(tt), 9) AS truth, round(abs(CASE WHEN tt > 0 THEN max(o) ELSE min(o) END), 9) AS ours FROM k WHERE n = 24 AND abs(tt) >= 0.2 AND abs(i - ti) <= 4 GROUP BY record_id, lead, peak, tt"""


@query("v3_height_pairs", _V3)
def v3(spark, d):
    s = signals(spark, d, ["I", "II"], 300)
    ours = s.select("record_id", "lead", (F.col("i") + 3 + F.col("record_id") % 4).alias("i"), (F.col("mv") * 0.9 + 0.01).alias("mv"))
    p = users(spark, d).withColumn("peak", F.explode(F.array(F.lit(8), F.lit(66), F.lit(230))))
    pairs = C.height_pairs(ours, s, p, 8, 12, 4)
    return pairs.select("record_id", "lead", F.col("peak").cast("long").alias("peak"), F.round("truth", 9).alias("truth"), F.round("ours", 9).alias("ours"))


_HALVES = ", ".join(f"({k}, {w * 500 // 2000})" for k, w in enumerate(synthetic.PROBE_MS))


@query("s20_probe_signal", f"WITH r AS (SELECT DISTINCT user_id AS record_id FROM events), g AS (SELECT i, i // 200 AS k FROM (SELECT unnest(range(1001)) AS i)), p AS (SELECT i, CASE WHEN abs(i - k * 200 - 100) <= h AND k < 5 THEN (CASE WHEN k % 2 = 0 THEN 1.0 ELSE -1.0 END) * (1 - abs(i - k * 200 - 100) / CAST(h + 1 AS DOUBLE)) ELSE 0.0 END AS mv FROM g JOIN (VALUES {_HALVES}) t(j, h) ON g.k % 4 = j) SELECT record_id, CAST(i AS INTEGER) AS i, round(mv, 9) AS mv FROM r, p WHERE mv <> 0")
def s20(spark, d):
    return synthetic.probe(users(spark, d), 500, 1001, ["I"]).where("mv <> 0").select("record_id", "i", F.round("mv", 9).alias("mv"))


#: Scores as whole numbers, which no order of summing changes.
_SCORE = "CAST(coalesce(floor(sum(CASE WHEN {0} THEN CAST(round(x * 100) AS BIGINT) END) / count(CASE WHEN {0} THEN 1 END)), {1}) AS BIGINT)"


@query("t14_keep_best", f"WITH {E_SQL}, b AS (SELECT user_id, i % 4 AS cell, {_SCORE.format('i % 2 = 0', 3000)} AS q, {_SCORE.format('i % 8 < 6', 0)} AS q2 FROM e GROUP BY 1, 2), c AS (SELECT *, q < 5580 AND q2 > q AS better FROM b) SELECT user_id, cell, CASE WHEN better THEN 'second' ELSE 'first' END AS method, CASE WHEN better THEN q2 ELSE q END AS q FROM c")
def t14(spark, d):
    e = events(spark, d).withColumn("cell", F.col("i") % 4).withColumn("hundredths", F.round(F.col("x") * 100).cast("long"))
    mean = lambda seen: F.floor(F.sum(F.when(seen, F.col("hundredths"))) / F.nullif(F.count_if(seen), F.lit(0)))
    scored = lambda seen, name, none: e.groupBy("user_id", "cell").agg(F.coalesce(mean(seen), F.lit(none)).cast("long").alias("q")).withColumn("method", F.lit(name))
    return Y.keep_best(scored(F.col("i") % 2 == 0, "first", 3000), scored(F.col("i") % 8 < 6, "second", 0), ["user_id", "cell"], good=5580)


_NAMES = ["V1", "aVF", "I", "V6", "III", "aVR"]


@query("p21_limb_columns", f"WITH c AS (SELECT DISTINCT user_id AS record_id, unnest([{', '.join(map(repr, _NAMES))}]) AS lead, unnest(range({len(_NAMES)})) AS position FROM events) SELECT record_id, c.lead, CAST(position AS INTEGER) AS position, a, b FROM c JOIN (VALUES {', '.join(f'({k!r}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))' for k, (a, b) in LIMB.items())}) g(lead, a, b) ON c.lead = g.lead WHERE (record_id + position) % 3 <> 0")
def p21(spark, d):
    c = users(spark, d).select("record_id", F.posexplode(F.array(*map(F.lit, _NAMES))).alias("position", "lead"))
    return L.limb_columns(c.where("(record_id + position) % 3 <> 0"))


@query("j3_files_of_records", "SELECT c_custkey, o_orderkey, path FROM customer JOIN (SELECT o_orderkey, 'out/' || o_custkey || '/' || o_orderkey || '_canonical.csv' AS path, o_custkey FROM orders) ON c_custkey = o_custkey WHERE c_acctbal > 0")
def j3(spark, d):
    records = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 0").select("c_custkey")
    files = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.concat(F.lit("out/"), F.col("o_custkey"), F.lit("/"), F.col("o_orderkey"), F.lit("_canonical.csv")).alias("path"))
    return C.by_folder(records, files, "c_custkey")


@query("o2_first_by_name", "SELECT c_name, c_custkey FROM customer ORDER BY c_name LIMIT 40")
def o2(spark, d):
    return C.first_by_name(spark.read.parquet(f"{d}/customer.parquet").select("c_name", "c_custkey"), "c_name", 40)


@query("o4_largest_of_group", "SELECT c_mktsegment, c_custkey, c_acctbal, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 5")
def o4(spark, d):
    return C.largest(spark.read.parquet(f"{d}/customer.parquet").select("c_mktsegment", "c_custkey", "c_acctbal"), "c_mktsegment", "c_acctbal", "c_custkey")


@query("t29_from_start", f"WITH {E_SQL}, f AS (SELECT user_id, min(i) FILTER (x >= 40) AS i0 FROM e GROUP BY 1) SELECT user_id AS record_id, CAST(i - i0 AS INTEGER) AS i, CASE WHEN x >= 40 THEN x END AS mv FROM e JOIN f USING (user_id) WHERE i >= i0")
def t29(spark, d):
    s = events(spark, d).select(F.col("user_id").alias("record_id"), F.lit("II").alias("lead"), "i", F.when(F.col("x") >= 40, F.col("x")).alias("mv"))
    return R.from_start(s).drop("lead")
