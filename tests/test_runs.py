"""Ink as vertical runs gives what its pixels give; lines that leave no choice are not folded."""

import random

from pyspark.sql import functions as F

from pulsegrid.operators import layout as Y
from pulsegrid.plans import roundtrip
from pulsegrid.schema import LEADS
from pulsegrid.sources import synthetic


def test_runs_are_the_pixels_of_their_lines(spark):
    rng = random.Random(3)
    lines = [(k % 2, "a" if k % 3 else "b", rng.randint(0, 5), lo := rng.randint(-4, 30), lo + rng.randint(0, 6)) for k in range(200)]
    frame = spark.createDataFrame([(r, n, f"{r}/{n}", x, a, b) for r, n, x, a, b in lines], "record_id int, layout string, page string, x int, lo int, hi int")
    runs = [tuple(r) for r in roundtrip.inked(frame).select("record_id", "x", "lo", "hi").collect()]
    pixels = [(p, x, y) for p, x, a, b in runs for y in range(a, b + 1)]
    assert len(pixels) == len(set(pixels)) and set(pixels) == {(f"{r}/{n}", x, y) for r, n, x, a, b in lines for y in range(max(0, a), b + 1)}


def test_clusters_of_runs_are_those_of_their_pixels(spark):
    rng, runs = random.Random(4), []
    for x in range(30):
        y = 0
        for _ in range(6):
            lo = y + rng.randint(2, 6)
            y = lo + rng.randint(0, 4)
            runs.append(("p", x, lo, y))
    frame = spark.createDataFrame(runs, "record_id string, x int, lo int, hi int")
    ink = frame.select("record_id", "x", F.explode(F.sequence("lo", "hi")).alias("y"))
    got, want = ({tuple(r) for r in f.select("x", "centre", "thickness").collect()} for f in (Y.run_clusters(frame, ["record_id"]), Y.column_clusters(ink, ["record_id"])))
    assert got == want


def test_a_line_without_choice_is_the_folded_one(spark):
    """Page a has one cluster a column, b the same and a far one beside each, c a jump over the slew."""
    rng = random.Random(5)
    line = [50.0 + rng.randint(-20, 20) for _ in range(40)]
    rows = [(p, x, y, 1) for p in "ab" for x, y in enumerate(line)] + [("b", x, 900.0, 1) for x in range(40)]
    rows += [("c", x, y + (400.0 if x == 20 else 0.0), 1) for x, y in enumerate(line)]
    widths = spark.createDataFrame([(p, 40, 50.0) for p in "abc"], "record_id string, width int, base double")
    got = Y.traces(spark.createDataFrame(rows, "record_id string, x int, centre double, thickness int"), ["record_id"], widths).collect()
    of = lambda p: sorted((r.x, r.y, r.coverage) for r in got if r.record_id == p)
    assert of("a") == of("b") == [(x, y, 1.0) for x, y in enumerate(line)]
    assert [v for v in of("c") if v[0] != 20] == [(x, y, 39 / 40) for x, y in enumerate(line) if x != 20] and of("c")[20][1] == (line[19] + line[21]) / 2


def test_drawn_lines_stay_where_signals_lie(spark, monkeypatch):
    monkeypatch.setattr(synthetic, "PART_ROWS", 5_000)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        made = roundtrip.drawn(synthetic.signals(spark.range(20).withColumnRenamed("id", "record_id"), 24, 240, LEADS), roundtrip.readers.layout_cells(spark), 240, 40)
        plan = roundtrip.inked(made)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("page#" in line or "layout#" in line or "x#" in line for line in dealt)
