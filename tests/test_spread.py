"""Generated tables are spread over partitions and known to be large; zero pulses, filled traces."""

import math
import re

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import beats as B
from pulsegrid.operators import delineate as D
from pulsegrid.operators import layout as Y
from pulsegrid.operators import pixels as P
from pulsegrid.plans.queries import QUERIES, SQL, errors, page, signals, users
from pulsegrid.sources import synthetic
from pulsegrid.tables import materialise

MB = 1 << 20


def size(frame):
    """Bytes the planner takes a table for."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_generated_rows_are_spread_by_record(spark, data, monkeypatch):
    monkeypatch.setattr(synthetic, "PART_ROWS", 10_000)
    s = signals(spark, data)
    records = s.select("record_id").distinct().count()
    assert s.rdd.getNumPartitions() == math.ceil(records * 4800 / 10_000)
    parts = s.select("record_id", F.spark_partition_id().alias("p")).distinct().groupBy("record_id").count()
    assert parts.where("count > 1").isEmpty()
    shuffles = [line for line in QUERIES["l4_consistency"](spark, data)._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and not any(" i#" in line or "lead#" in line for line in shuffles)


@pytest.mark.parametrize("made", [lambda s, d: signals(s, d), lambda s, d: page(s, d)[0]])
def test_planner_knows_that_generated_tables_are_large(spark, data, made):
    assert size(made(spark, data)) > 20 * MB  # as exploded rows: a few kB


@pytest.mark.parametrize("name", ["b6_best_shift", "b9_energy_shift", "d4_p_magnitude", "d3_misaligned_leads", "b5_whole_beats"])
def test_no_samples_are_sent_to_everyone(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert not any("lead#" in line or " i#" in line or " at#" in line for line in sent)


@pytest.mark.parametrize("name", ["d4_p_magnitude", "d7_p_confirmed", "d11_t_ends", "d12_t_consensus", "d14_axis", "d16_amplitudes", "d16_st_levels", "d17_sokolow"])
def test_samples_stay_where_they_lie_when_baselines_are_joined(spark, data, monkeypatch, name):
    """More partitions of samples than of joins, as in large tables: the marks move to the samples, which are never dealt by lead."""
    monkeypatch.setattr(synthetic, "PART_ROWS", 10_000)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert "lead#" in plan
    assert not any("Exchange hashpartitioning" in line and "lead#" in line for line in plan.splitlines())


def test_a_lead_without_baseline_gives_no_rows(spark):
    beats = spark.createDataFrame([(1, "I", 0, 1.0), (1, "II", 0, 2.0), (1, None, 0, 3.0), (2, "I", 0, 4.0)], "record_id long, lead string, i int, mv double")
    base = spark.createDataFrame([(1, "I", 0.5), (1, None, 0.25), (2, "II", 0.5)], "record_id long, lead string, base double")
    assert [tuple(r) for r in D._based(beats, base).collect()] == [(1, "I", 0, 1.0, 0.5)]


def test_row_profiles_are_not_sent(spark, data):
    ink_rows, sizes = page(spark, data)
    profile = Y.row_profile(ink_rows, sizes)
    profile.count()
    assert "BroadcastHashJoin" not in profile._jdf.queryExecution().executedPlan().toString()


def test_long_tables_are_not_sent(spark):
    few = spark.range(5)
    joined = few.join(materialise(spark.range(5), "long", long=True), "id")
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 5


def test_pulse_without_height(spark):
    rows = spark.createDataFrame([(0.0, 8.0), (0.0, 0.0), (40.0, 8.0), (None, 8.0)], "px double, grid double")
    s = rows.withColumn("s", Y.reconcile(F.col("px"), F.col("grid")))
    s = s.withColumn("c", Y.correction(F.col("px"), F.col("s.ratio"), F.col("s.agrees"), F.lit(5), F.lit(0.0), F.lit(100.0)))
    got = [(r.s.ratio, r.s.agrees, r.c.applied, r.c.seconds) for r in s.collect()]
    assert got[0] == (math.inf, False, True, None) and math.isnan(got[1][0]) and got[2][:2] == (2.0, False) and got[3][0] is None


def test_means_do_not_depend_on_the_order_of_rows(spark, duck, tmp_path):
    """Each user has a value that equals the mean: only the order of the sum says whether it is found above it."""
    rows = []
    for user in range(200):
        least, middle = 3000 + 7 * user % 1000, 4100 + 13 * user
        for cents in (least, middle, 2 * middle - least):
            rows.append((len(rows), user, "click", cents / 100))
    for name, part in (("ahead", rows), ("back", rows[::-1])):
        spark.createDataFrame(part, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
    got = {n: sorted(tuple(r) for r in errors(spark, f"{tmp_path}/{n}").collect()) for n in ("ahead", "back")}
    assert got["ahead"] == got["back"]
    want = duck.sql(SQL["a2_group_report"].replace("FROM events", f"FROM '{tmp_path}/ahead/events.parquet/*.parquet'")).fetchall()
    assert [tuple(r) for r in QUERIES["a2_group_report"](spark, f"{tmp_path}/back").collect()] == want


def test_reconcile_of_zero_values_is_that_of_the_twin(spark, duck, tmp_path):
    path = str(tmp_path)
    duck.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value END AS value) FROM events) TO '{path}/events.parquet'")
    want = duck.sql(SQL["t22_reconcile_scale"].replace("FROM events", f"FROM '{path}/events.parquet'")).df()
    got = QUERIES["t22_reconcile_scale"](spark, path).toPandas()
    key = ["user_id", "i"]
    got, want = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    assert want["ratio"].map(math.isinf).any()
    for c in want.columns:
        assert got[c].tolist() == want[c].tolist()


def test_reconcile_of_uneven_values_is_that_of_the_twin(spark, duck, tmp_path):
    """Zeros of both signs, and values whose ratio lies near the half of a last place."""
    path = str(tmp_path)
    near = "40000 / (4.0 + (event_id * 7919 % 2000000) / 2000000.0)"
    value = f"CASE event_id % 4 WHEN 0 THEN CAST('-0.0' AS DOUBLE) WHEN 1 THEN 1 / (1.0 + event_id) WHEN 2 THEN {near} ELSE value END"
    duck.sql(f"COPY (SELECT user_id, ts, event_type, event_id + 10000 * k AS event_id, {value.replace('event_id', '(event_id + 10000 * k)')} AS value FROM events, (SELECT unnest(range(50)) AS k)) TO '{path}/events.parquet'")
    want = duck.sql(SQL["t22_reconcile_scale"].replace("FROM events", f"FROM '{path}/events.parquet'")).df()
    got = QUERIES["t22_reconcile_scale"](spark, path).toPandas()
    key = ["user_id", "i"]
    got, want = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    assert want["ratio"].min() == -math.inf
    for c in want.columns:
        assert got[c].tolist() == want[c].tolist()


def test_traces_are_filled_without_a_join(spark):
    rows = [("a", x, y, 1) for x, y in [(2, 10.0), (3, 12.0), (7, 20.0)]]
    clusters = spark.createDataFrame(rows, "record_id string, x int, centre double, thickness int")
    got = Y.traces(clusters, ["record_id"], spark.createDataFrame([("a", 9)], "record_id string, width int"), least=3)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.x, r.y) for r in got.orderBy("x").collect()] == list(enumerate([10, 10, 10, 12, 14, 16, 18, 20, 20]))


def dealt(frame):
    """What each shuffle of a plan takes in, as the planner writes it."""
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = frame._jdf.queryExecution().explainString(mode)
    return [block for block in text.split("\n\n") if re.match(r"\(\d+\) Exchange", block)]


@pytest.mark.parametrize("name", ["d5_p_bounds", "j14_best_lag", "l3_lead_fill"])
def test_samples_are_not_shuffled(spark, data, monkeypatch, name):
    """More partitions of samples than of joins and nothing small enough to be sent, as in large tables: only records and their marks are dealt."""
    monkeypatch.setattr(synthetic, "PART_ROWS", 1_000)
    held = {"spark.sql.shuffle.partitions": "2", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = dealt(QUERIES[name](spark, data))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found and not [block for block in found if re.search(r"\b(mag|mv|i)#", block)]


@pytest.mark.parametrize("name, made", [("d1_spatial_velocity", 8 * 260), ("v7_probe_peaks", 2 * 300), ("d10_t_window", 8 * 520), ("d2_qrs_bounds", 8 * 520)])
def test_tasks_are_as_many_as_samples_need(spark, data, monkeypatch, name, made):
    """However few partitions a shuffle has: a larger table makes more tasks of the last step, not larger ones."""
    monkeypatch.setattr(synthetic, "PART_ROWS", 1_000, raising=False)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        parts = QUERIES[name](spark, data).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert parts == math.ceil(users(spark, data).count() * made / 1_000) > 2


def test_pages_of_a_grid_are_not_shuffled(spark, data, monkeypatch):
    """However large: only users are dealt, and no table is written between the steps."""
    monkeypatch.setattr(synthetic, "PART_ROWS", 20_000)
    found = dealt(QUERIES["i11_grid_presence"](spark, data))
    assert found and not [block for block in found if re.search(r"\b(gray|v|u|re|im|power)#", block)]


def test_taps_of_pages_are_those_of_the_target_places(spark):
    """Sizes up, down and equal, one column and one row: each target place takes its own taps."""
    for kind, reach in (("linear", (0, 1)), ("cubic", (-1, 0, 1, 2))):
        for (w, h), (tw, th) in (((5, 3), (11, 7)), ((11, 7), (4, 3)), ((6, 6), (6, 6)), ((1, 4), (3, 1)), ((9, 1), (2, 5))):
            value = {(x, y): (x * 7 + y * 13 + x * y) % 17 for x in range(w) for y in range(h)}
            pixels = spark.createDataFrame([(1, x, y, v) for (x, y), v in value.items()], "record_id long, x int, y int, gray int")
            sizes = spark.createDataFrame([(1, w, h, tw, th)], "record_id long, width int, height int, to_width int, to_height int")

            def taps(t, n, to):
                c = (t + 0.5) * (n / to) - 0.5
                cubic = lambda d: ((1.25 * d - 2.25) * d) * d + 1 if d <= 1 else ((-0.75 * d + 3.75) * d - 6) * d + 3 if d < 2 else 0.0
                for k in reach:
                    d = abs(c - (math.floor(c) + k))
                    yield max(0, min(n - 1, math.floor(c) + k)), 1 - d if kind == "linear" else cubic(d)

            want = {(x, y): sum(value[s, r] * a * b for s, a in taps(x, w, tw) for r, b in taps(y, h, th)) for x in range(tw) for y in range(th)}
            got = {(r.x, r.y): r.gray for r in P.sampled(pixels, sizes, "gray", kind).collect()}
            assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("name", ["b6_best_shift", "b7_family"])
def test_beats_are_not_shuffled(spark, data, monkeypatch, name):
    """As samples: beats are brought into line where they lie."""
    test_samples_are_not_shuffled(spark, data, monkeypatch, name)


def test_leads_are_not_shuffled_to_the_strongest(spark, data, monkeypatch):
    test_samples_are_not_shuffled(spark, data, monkeypatch, "b9_energy_shift")


def test_signals_stay_where_they_lie_until_the_anchor_is_cut(spark, data, monkeypatch):
    """Of eight leads none is shuffled before the anchor's stretch is written."""
    plans = []
    monkeypatch.setattr(synthetic, "PART_ROWS", 1_000)
    monkeypatch.setattr(B, "materialise", lambda df, *_, **__: plans.append(dealt(df)) or df)
    monkeypatch.setattr(B, "refined", lambda lead, *_: lead)
    monkeypatch.setattr(B, "complexes", lambda lead, *_: lead)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        B.anchor_peaks(signals(spark, data), 250)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(plans) == 1 and plans[0] and not [block for block in plans[0] if re.search(r"\b(mv|i)#", block)]
