"""From pages to signals: ink, profiles, layouts, scale and traces on long ink rows (record_id, x, y)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.segments import less_running_median
from pulsegrid.schema import AUTO_LAYOUTS, LAYOUTS, MM_PER_MV, MM_PER_S
from pulsegrid.tables import materialise


def gray_pixels(images: DataFrame) -> DataFrame:
    """record_id, x, y, gray of an image table (record_id, height, width, nChannels, data: BGR or gray bytes); transparency is dropped."""

    def run(frames):
        for f in frames:
            for rec, h, w, c, data in zip(f["record_id"], f["height"], f["width"], f["nChannels"], f["data"]):
                a = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(float)
                g = a[:, :, 0] if c < 3 else 0.114 * a[:, :, 0] + 0.587 * a[:, :, 1] + 0.299 * a[:, :, 2]
                y, x = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({"record_id": rec, "x": x.astype(np.int32), "y": y.astype(np.int32), "gray": np.rint(g).astype(np.int32).ravel()})

    return images.select("record_id", "height", "width", "nChannels", "data").mapInPandas(run, f"record_id {images.schema['record_id'].dataType.simpleString()}, x int, y int, gray int")


def histogram_threshold(values: DataFrame, key: str, x: str) -> DataFrame:
    """key, threshold: Otsu's, the level (0-255) of largest between-class variance, the first of equal ones."""
    h = values.groupBy(key, F.col(x).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key)
    run = w.orderBy("v")
    rows = h.select(key, "v", F.sum("c").over(run).alias("n0"), F.sum(F.col("c") * F.col("v")).over(run).alias("s0"), F.sum("c").over(w).alias("n"), F.sum(F.col("c") * F.col("v")).over(w).alias("s"))
    n1 = F.col("n") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / n1
    rows = rows.where("n0 < n").withColumn("between", F.round(F.col("n0") * n1 * gap * gap / (F.col("n") * F.col("n")), 9))
    return rows.groupBy(key).agg(F.min(F.struct((-F.col("between")).alias("b"), "v"))["v"].alias("threshold"))


def ink(pixels: DataFrame) -> DataFrame:
    """record_id, x, y of ink: darker than Otsu's level, and again within the dark ones if there are over 100."""
    first = pixels.join(histogram_threshold(pixels, "record_id", "gray"), "record_id").where("gray <= threshold").drop("threshold")
    many = first.groupBy("record_id").agg(F.count("*").alias("n"))
    second = histogram_threshold(first, "record_id", "gray")
    rows = first.join(many, "record_id").join(second, "record_id", "left")
    return rows.where("n <= 100 or threshold is null or gray <= threshold").select("record_id", "x", "y")


def row_profile(ink_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """record_id, y, cover: mean ink of each row, box-blurred over a ninetieth of the height (7 at least), largest 1.

    sizes: record_id, width, height.  Rows beyond the edges mirror those inside.
    """
    counts = ink_rows.groupBy("record_id", "y").agg(F.count("*").alias("c"))
    grid = sizes.withColumn("k", F.greatest(F.lit(7), F.floor(F.col("height") / 90).cast("int"))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    rows = grid.join(counts, ["record_id", "y"], "left").withColumn("m", F.coalesce("c", F.lit(0)) / F.col("width"))
    # mirrored edges as extra rows, then one running sum and a difference of it
    half = F.floor(F.col("k") / 2).cast("int")
    r = rows.select("record_id", "y", "m", "k", "height", half.alias("h"))
    top = r.where("y > 0 and y <= h").select("record_id", (-F.col("y")).alias("y"), "m", "k", "height", "h")
    low = r.where("y < height - 1 and y >= height - 1 - h").select("record_id", (2 * (F.col("height") - 1) - F.col("y")).alias("y"), "m", "k", "height", "h")
    w = Window.partitionBy("record_id").orderBy("y")
    wide = r.unionByName(top).unionByName(low).withColumn("run", F.sum("m").over(w))
    wide = wide.select("record_id", "y", "run", "height", "h", "k").hint("merge")  # exploded rows count as one a page
    ahead = wide.select("record_id", (F.col("y") - F.col("k") + 1 + F.col("h")).alias("y"), F.col("run").alias("r1"))
    behind = wide.select("record_id", (F.col("y") + F.col("h") + 1).alias("y"), F.col("run").alias("r0"))
    out = wide.where("y >= 0 and y < height").join(ahead, ["record_id", "y"]).join(behind, ["record_id", "y"], "left")
    out = out.withColumn("b", (F.col("r1") - F.coalesce("r0", F.lit(0.0))) / F.col("k"))
    return out.select("record_id", "y", (F.col("b") / F.nullif(F.max("b").over(Window.partitionBy("record_id")), F.lit(0.0))).alias("cover"))


def row_centres(profile: DataFrame, counts: list[int], edge: float = 0.15) -> DataFrame:
    """record_id, n_rows, k, centre: for each number of rows, the covered stretch split evenly and each place moved to the best cover within 0.4 of the pitch."""
    ends = profile.where(F.col("cover") > edge).groupBy("record_id").agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    slots = ends.withColumn("n_rows", F.explode(F.array(*map(F.lit, counts)))).withColumn("k", F.explode(F.expr("sequence(0, n_rows - 1)")))
    slots = slots.withColumn("pitch", (F.col("y1") - F.col("y0")) / F.col("n_rows")).withColumn("at", F.col("y0") + (F.col("k") + 0.5) * F.col("pitch"))
    slots = slots.withColumn("y", F.explode(F.sequence(F.ceil(F.col("at") - 0.4 * F.col("pitch")).cast("int"), F.floor(F.col("at") + 0.4 * F.col("pitch")).cast("int"))))
    # what explode() makes counts as one row each, so the planner is told not to send it to every executor; below as well
    near = slots.hint("merge").join(profile, ["record_id", "y"])
    return near.groupBy("record_id", "n_rows", "k").agg(F.min(F.struct((-F.round("cover", 9)).alias("c"), "y"))["y"].alias("centre"))


def layout_scores(profile: DataFrame, centres: DataFrame) -> DataFrame:
    """record_id, n_rows, score: cover on the rows less cover between them, less 0.6 of the spacing's relative spread; -1 if rows collapse."""
    w = Window.partitionBy("record_id", "n_rows").orderBy("centre")
    rows = centres.withColumn("next", F.lead("centre").over(w))
    on = rows.join(profile.withColumnRenamed("y", "centre"), ["record_id", "centre"]).groupBy("record_id", "n_rows").agg(
        F.avg("cover").alias("on"), F.count_distinct("centre").alias("n"), F.stddev_pop(F.col("next") - F.col("centre")).alias("sd"), F.avg(F.col("next") - F.col("centre")).alias("gap")
    )
    gaps = rows.where("next is not null").withColumn("q", (F.col("next") - F.col("centre")) / 4.0)
    gaps = gaps.where("next - centre >= 2").withColumn("y", F.explode(F.expr("sequence(cast(ceil(centre + q) as int), cast(floor(next - q) as int))")))
    off = gaps.hint("merge").join(profile, ["record_id", "y"]).groupBy("record_id", "n_rows").agg(F.avg("cover").alias("off"))
    score = F.when(F.col("n") < F.col("n_rows"), -1.0).otherwise(F.col("on") - F.coalesce("off", F.lit(0.0)) - 0.6 * F.coalesce(F.col("sd") / F.col("gap"), F.lit(0.0)))
    return on.join(off, ["record_id", "n_rows"], "left").select("record_id", "n_rows", score.alias("score"))


def choose_layout(scores: DataFrame) -> DataFrame:
    """record_id, layout of the best score among the layouts told apart by their rows; the first of equal ones."""
    best = scores.groupBy("record_id").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "n_rows"))["n_rows"].alias("n_rows"))
    name = F.element_at(F.create_map(*[F.lit(v) for kv in AUTO_LAYOUTS.items() for v in kv]), F.col("n_rows"))
    return best.select("record_id", "n_rows", name.alias("layout"))


def bands(profile: DataFrame, centres: DataFrame, edge: float = 0.1, pad: int = 5) -> DataFrame:
    """record_id, n_rows, k, lo, hi: rows divided at the least cover between centres; outer bounds where cover ends, with a pad."""
    w = Window.partitionBy("record_id", "n_rows").orderBy("k")
    rows = centres.withColumn("next", F.lead("centre").over(w))
    between = rows.where("next > centre").withColumn("y", F.explode(F.sequence("centre", "next"))).hint("merge").join(profile, ["record_id", "y"])
    cut = between.groupBy("record_id", "n_rows", "k").agg(F.min(F.struct(F.round("cover", 9).alias("c"), "y"))["y"].alias("cut"))
    ends = profile.where(F.col("cover") > edge).groupBy("record_id").agg((F.min("y") - pad).alias("y0"), (F.max("y") + pad).alias("y1"))
    height = profile.groupBy("record_id").agg(F.max("y").alias("last"))
    rows = rows.join(cut, ["record_id", "n_rows", "k"], "left").join(ends, "record_id").join(height, "record_id")
    lo, hi = F.coalesce(F.lag("cut").over(w), F.greatest(F.lit(0), F.col("y0"))), F.coalesce(F.col("cut"), F.least(F.col("last"), F.col("y1")))
    return rows.select("record_id", "n_rows", "k", lo.alias("lo"), hi.alias("hi"))


def histogram_mode(values: DataFrame, keys, x: str, width: float = 2.0) -> DataFrame:
    """keys, base: middle of the fullest bin, the lowest of equal ones."""
    h = values.groupBy(*keys, F.floor(F.col(x) / width).alias("bin")).agg(F.count("*").alias("c"))
    return h.groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("c"), "bin"))["bin"].alias("bin")).select(*keys, ((F.col("bin") + 0.5) * width).alias("base"))


def cells(chosen: DataFrame, layout_dim: DataFrame, boxes: DataFrame, cal_mm: float = 14.0, label_mm: float = 6.0) -> DataFrame:
    """One row a cell: record_id, lead, row, col, x0, x1, y0, y1, seconds, t0, mm_px.

    boxes: record_id, x0, x1 of the content.  Column 0 loses the calibration
    mark, others the label; a rhythm strip spans all columns.
    """
    mm = (F.col("x1") - F.col("x0")) / (F.lit(10.0) * MM_PER_S)
    rows = chosen.join(boxes, "record_id").withColumn("mm_px", mm).join(F.broadcast(layout_dim), "layout")
    w = (F.col("x1") - F.col("x0")) / F.col("n_cols")
    left = F.col("x0") + F.col("col") * w + F.when(F.col("col") == 0, cal_mm).otherwise(label_mm) * F.col("mm_px")
    right = F.when(F.col("is_rhythm"), F.col("x1")).otherwise(F.col("x0") + (F.col("col") + 1) * w)
    return rows.select("record_id", "layout", "lead", "row", "col", "is_rhythm", left.cast("int").alias("cx0"), right.cast("int").alias("cx1"), "seconds", "t0", "mm_px")


def neighbour_limits(boxes: DataFrame) -> DataFrame:
    """boxes (record_id, col, y0, y1) with the limits the cells above and below set within a column; 0 and height at the ends."""
    w = Window.partitionBy("record_id", "col").orderBy("y0")
    return boxes.withColumn("above", F.coalesce(F.lag("y1").over(w), F.lit(0))).withColumn("below", F.coalesce(F.lead("y0").over(w), F.col("height")))


def column_clusters(ink_rows: DataFrame, keys, gap: int = 3) -> DataFrame:
    """keys, x, centre, thickness of the vertical clusters of each column; a step over the gap begins a new one."""
    w = Window.partitionBy(*keys, "x").orderBy("y")
    rows = ink_rows.withColumn("new", F.when(F.col("y") - F.lag("y").over(w) > gap, 1).otherwise(0)).withColumn("part", F.sum("new").over(w))
    return rows.groupBy(*keys, "x", "part").agg(F.avg("y").alias("centre"), (F.max("y") - F.min("y") + 1).alias("thickness")).drop("part")


def run_clusters(runs: DataFrame, keys, gap: int = 3) -> DataFrame:
    """As column_clusters(), of unbroken vertical runs (keys, x, lo, hi) that do not overlap, for whose pixels no rows are made."""
    w = Window.partitionBy(*keys, "x").orderBy("lo")
    rows = runs.withColumn("new", F.when(F.col("lo") - F.lag("hi").over(w) > gap, 1).otherwise(0)).withColumn("part", F.sum("new").over(w))
    n = (F.col("hi") - F.col("lo") + 1).cast("long")
    centre = F.sum((F.col("lo") + F.col("hi")) * n) / (2.0 * F.sum(n))
    return rows.groupBy(*keys, "x", "part").agg(centre.alias("centre"), (F.max("hi") - F.min("lo") + 1).alias("thickness")).drop("part")


def traces(clusters: DataFrame, keys, widths: DataFrame, slew: float | None = 70.0, least: int = 5, part: int = 16) -> DataFrame:
    """keys, x, y, coverage of the line followed through the clusters of a cell.

    widths: keys, width (columns of the cell) and, if given, base, the height at
    which to begin; without it that is the fullest bin of the cluster heights.
    Column by column the cluster nearest to the height reached is taken, the
    thinner of two as near; a column of which all clusters are more than `slew`
    away (None: any distance will do) is left out.  Columns between and at the ends are
    filled; coverage is the share of columns not filled.  Cells with fewer than
    `least` columns taken give no rows.  One cell's columns are folded in one
    row: their number is the width of an image.
    """
    if "base" not in widths.columns:
        widths = widths.join(histogram_mode(clusters, keys, "centre"), [*keys], "left")
    columns = clusters.groupBy(*keys, "x").agg(F.collect_list(F.struct("thickness", F.col("centre").cast("double").alias("centre"))).alias("found"))
    cell = columns.join(widths, [*keys]).where("x >= 0 and x < width").groupBy(*keys, "width", "base").agg(F.sort_array(F.collect_list(F.struct("x", "found"))).alias("columns"))
    start = F.struct(F.col("base").cast("double").alias("at"), F.array().cast("array<struct<x:int,y:double>>").alias("taken"))

    def step(state, column):
        near = F.array_min(F.transform(column["found"], lambda f: F.struct(F.abs(f["centre"] - state["at"]).alias("off"), f["thickness"], f["centre"])))

        def take(n):
            point = F.struct(column["x"].cast("int").alias("x"), n["centre"].alias("y"))
            moved = F.struct(n["centre"].alias("at"), F.concat(state["taken"], F.array(point)).alias("taken"))
            return moved if slew is None else F.when(n["off"] <= slew, moved).otherwise(state)

        return F.transform(F.array(near), take)[0]

    # parts of some columns each are folded on their own, so that what has been taken is copied once a part and not once a column
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("columns") - 1) / part).cast("int")), lambda k: F.slice("columns", k * part + 1, part))
    none = F.array().cast("array<struct<x:int,y:double>>")

    def fold(state, columns):
        within = F.aggregate(columns, F.struct(state["at"].alias("at"), none.alias("taken")), step)
        return F.transform(F.array(within), lambda w: F.struct(w["at"].alias("at"), F.concat(state["taken"], w["taken"]).alias("taken")))[0]

    # where every column has one cluster and none is too far from the one before, all are taken: there is nothing to fold
    cell = cell.select(*keys, "width", "base", "columns", F.transform("columns", lambda c: F.struct(c["x"].cast("int").alias("x"), c["found"][0]["centre"].alias("y"))).alias("each"))
    single = F.forall("columns", lambda c: F.size(c["found"]) == 1)
    if slew is not None:
        before = lambda k: F.when(k == 0, F.col("base").cast("double")).otherwise(F.col("each")[F.greatest(k - 1, F.lit(0))]["y"])
        single = single & F.forall(F.sequence(F.lit(0), F.size("each") - 1), lambda k: F.abs(F.col("each")[k]["y"] - before(k)) <= slew)
    taken = F.when(F.coalesce(single, F.lit(False)), F.col("each")).otherwise(F.aggregate(parts, start, fold)["taken"])
    cell = materialise(cell.select(*keys, "width", taken.alias("taken")), "traces").where(F.size("taken") >= least)
    # each column taken makes those up to the next one; the first and the last make the ends
    points = cell.select(*keys, "width", "taken", (F.size("taken") / F.col("width")).alias("coverage"), F.posexplode("taken").alias("p", "t"))
    points = points.select(*keys, "width", "coverage", "p", "t", F.try_element_at("taken", F.col("p") + 2).alias("next"))
    first, last = F.when(F.col("p") == 0, 0).otherwise(F.col("t.x")), F.coalesce(F.col("next.x"), F.col("width")) - 1
    rows = points.select(*keys, "coverage", "t", "next", F.explode(F.sequence(first, last)).alias("x"))
    between = F.col("t.y") + (F.col("next.y") - F.col("t.y")) * (F.col("x") - F.col("t.x")) / (F.col("next.x") - F.col("t.x"))
    return rows.select(*keys, "x", F.when((F.col("x") <= F.col("t.x")) | F.col("next").isNull(), F.col("t.y")).otherwise(between).alias("y"), "coverage")


def millivolts(y: Column, middle: Column, mm_px: Column, limit: float = 5.0) -> Column:
    """Trace height as mV off the middle, clipped."""
    return F.least(F.lit(limit), F.greatest(F.lit(-limit), -(y - middle) / (MM_PER_MV * mm_px)))


def trace_quality(trace: DataFrame, keys, y: str, height: str) -> DataFrame:
    """keys, q: 1 less weighted shares of gaps, clipping at the cell's edges, the longest plateau, distance from the middle and jumps."""
    w = Window.partitionBy(*keys).orderBy("x")
    whole = Window.partitionBy(*keys)
    rows = trace.withColumn("d", F.col(y) - F.lag(y).over(w))
    rows = rows.withColumn("same", F.when(F.abs("d") < 0.5, 0).otherwise(1)).withColumn("island", F.sum("same").over(w)).withColumn("run", F.count("*").over(Window.partitionBy(*keys, "island")))
    rows = rows.withColumn("med", F.percentile(y, F.lit(0.5)).over(whole))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    got = rows.groupBy(*keys).agg(
        share(F.col(y).isNull()).alias("gap"), share((F.col(y) <= 1) | (F.col(y) >= F.col(height) - 2)).alias("clip"), (F.max("run") / F.count("*")).alias("plateau"),
        F.max(F.abs(F.col("med") / F.col(height) - 0.5)).alias("base"), share(F.abs("d") > F.col(height) / 4.0).alias("jump"),
    )
    return got.select(*keys, (1 - (0.30 * F.col("gap") + 0.25 * F.col("clip") + 0.15 * F.col("plateau") + 0.15 * F.coalesce("base", F.lit(0.0)) + 0.15 * F.col("jump"))).alias("q"))


def keep_best(first: DataFrame, second: DataFrame, keys, good: float = 0.93) -> DataFrame:
    """The traces (keys, q, ...) of a first method; those of a second one where the first is below `good` and the second is better.

    The second need only hold cells of which first.q is below good.
    """
    q = lambda d, name: d.groupBy(*keys).agg(F.max("q").alias(name))
    better = q(first, "q0").where(F.col("q0") < good).join(q(second, "q1"), keys).where("q1 > q0").select(*keys)
    return first.join(better, keys, "left_anti").unionByName(second.join(better, keys, "left_semi"))


def assemble(cell_signals: DataFrame) -> DataFrame:
    """record_id, lead, i, mv from cells (record_id, lead, is_rhythm, i, mv): the rhythm strip where a lead has one, else its cell."""
    best = cell_signals.groupBy("record_id", "lead", "i").agg(F.max(F.when(F.col("is_rhythm"), F.col("mv"))).alias("r"), F.max(F.when(~F.col("is_rhythm"), F.col("mv"))).alias("c"), F.max(F.col("is_rhythm").cast("int")).alias("_"))
    return best.select("record_id", "lead", "i", F.coalesce("r", "c").alias("mv"))


def pulse_window(profile: DataFrame, keys="record_id") -> DataFrame:
    """keys, a, length: widest stretch of the first 30 % of columns with over 1.5 times the trace's ink, the first of equal ones.

    profile: keys, x, c (ink of a column) and, if given, width; without it the
    last column is the largest x.  The trace's ink is the median over the
    columns from 35 to 90 % of the width that have any; a page without such
    columns has no window.
    """
    keys = [keys] if isinstance(keys, str) else [*keys]
    w = Window.partitionBy(*keys)
    rows = profile if "width" in profile.columns else profile.withColumn("width", F.max("x").over(w) + 1)
    place = lambda share: F.floor(F.lit(share) * F.col("width"))
    middle = rows.where((F.col("x") >= place(0.35)) & (F.col("x") < place(0.9)) & (F.col("c") > 0)).groupBy(*keys).agg(F.percentile("c", F.lit(0.5)).alias("trace"))
    hot = rows.where(F.col("x") < place(0.3)).join(middle, keys).where(F.col("c") > 1.5 * F.col("trace"))
    hot = hot.withColumn("island", F.col("x") - F.row_number().over(w.orderBy("x")))
    runs = hot.groupBy(*keys, "island").agg(F.min("x").alias("a"), F.count("*").alias("n"))
    best = runs.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "a")).alias("b"))
    return best.select(*keys, "b.a", (-F.col("b.n")).alias("length"))


def common_value(values: DataFrame, keys, x: str) -> DataFrame:
    """keys, value, spread, n: the value most others are near to (2 or 12 %), from three on, the least of equal ones: median and median deviation of its neighbours."""
    keys = [keys] if isinstance(keys, str) else [*keys]
    v = values.select(*keys, F.col(x).cast("double").alias("a"))
    pairs = v.distinct().join(v.withColumnRenamed("a", "b"), keys).where(F.abs(F.col("a") - F.col("b")) <= F.greatest(F.lit(2.0), 0.12 * F.col("a")))
    best = pairs.groupBy(*keys, "a").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "a"))["a"].alias("a"))
    near = pairs.join(best, [*keys, "a"]).withColumn("med", F.percentile("b", F.lit(0.5)).over(Window.partitionBy(*keys)))
    got = near.groupBy(*keys).agg(F.first("med").alias("value"), F.percentile(F.abs(F.col("b") - F.col("med")), F.lit(0.5)).alias("spread"), F.count("*").alias("n"))
    return got.where("n >= 3")


def agreement(px_per_mm: Column, grid_px_per_mm: Column) -> Column:
    """A scale against the grid's: px_per_mm, ratio (by a scale of 0 as IEEE numbers divide, with its sign), agrees (15 %)."""
    # a pulse of no height is infinitely far from the grid's scale
    sign = F.when(px_per_mm.cast("string").startswith("-"), -1.0).otherwise(1.0)
    at_zero = F.when(grid_px_per_mm == 0, F.lit(float("nan"))).otherwise(F.signum(grid_px_per_mm) * sign * F.lit(float("inf")))
    ratio = F.coalesce(F.try_divide(grid_px_per_mm, px_per_mm), F.when(px_per_mm == 0, at_zero))
    return F.struct(px_per_mm.alias("px_per_mm"), ratio.alias("ratio"), (F.abs(ratio - 1) <= 0.15).alias("agrees"))


def reconcile(pulse_px: Column, grid_px_per_mm: Column) -> Column:
    """Scale from the calibration pulse (10 mm) against the grid's, as agreement() gives it."""
    return agreement(pulse_px / 10.0, grid_px_per_mm)


def correction(pulse_px: Column, ratio: Column, agrees: Column, rows: Column, spread: Column, width: Column) -> Column:
    """Gain and seconds to apply: only with five rows or more, a spread of 8 % at most, and disagreement."""
    apply = (rows >= 5) & (spread <= 0.08) & ~agrees
    return F.struct(apply.alias("applied"), F.when(apply, ratio).otherwise(1.0).alias("gain"), F.when(apply, F.try_divide(width, pulse_px / 10.0) / MM_PER_S).alias("seconds"))


def seconds_per_pixel(widths: DataFrame, key: str, w: str) -> DataFrame:
    """key, sec_px: 2.5 s by the mean width of the cells narrower than twice the median."""
    rows = widths.withColumn("_m", F.percentile(w, F.lit(0.5)).over(Window.partitionBy(key))).where(F.col(w) < 2 * F.col("_m"))
    return rows.groupBy(key).agg((2.5 / F.avg(w)).alias("sec_px"))


def column_offset(lines: DataFrame, prob: DataFrame, most: int) -> DataFrame:
    """record_id, dx of highest summed probability (record_id, x, y, p) under lines (record_id, x, y) moved by dx; smallest of equal ones."""
    moved = lines.withColumn("dx", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("x", F.col("x") + F.col("dx"))
    s = moved.join(prob, ["record_id", "x", "y"]).groupBy("record_id", "dx").agg(F.sum("p").alias("s"))
    return s.groupBy("record_id").agg(F.min(F.struct((-F.round("s", 9)).alias("s"), "dx"))["dx"].alias("dx"))


def zone_means(prob: DataFrame, height: int, width: int, rows: int, cols: int) -> DataFrame:
    """record_id, r, c, mean, most of a map cut into rows by cols zones."""
    return prob.groupBy("record_id", F.floor(F.col("y") * rows / height).alias("r"), F.floor(F.col("x") * cols / width).alias("c")).agg(F.avg("p").alias("mean"), F.max("p").alias("most"))


def union_maps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Point-wise larger of two maps where both have the point."""
    return a.join(b.withColumnRenamed("p", "q"), ["record_id", "x", "y"]).select("record_id", "x", "y", F.greatest("p", "q").alias("p"))


def row_coverage(fragments: DataFrame) -> DataFrame:
    """record_id, part, cover: share of columns any fragment of a row (record_id, part, x, seen) has."""
    return fragments.groupBy("record_id", "part", "x").agg(F.bool_or("seen").alias("seen")).groupBy("record_id", "part").agg(F.avg(F.col("seen").cast("double")).alias("cover"))


def apexes(trace: DataFrame, edges: DataFrame, keys) -> DataFrame:
    """trace (keys, x, y) moved outward at turns of the slope to the ink edge (keys, x, top, bottom) by half the line's thickness.

    The thickness is the median height of the ink where the slope is under 0.3.
    """
    w = Window.partitionBy(*keys).orderBy("x")
    rows = trace.withColumn("d0", F.col("y") - F.lag("y").over(w)).withColumn("d1", F.lead("y").over(w) - F.col("y")).join(edges, [*keys, "x"], "left")
    rows = rows.withColumn("half", F.percentile(F.when(F.abs("d0") < 0.3, (F.col("bottom") - F.col("top") + 1) / 2.0), F.lit(0.5)).over(Window.partitionBy(*keys)))
    up, down = F.col("top") + F.col("half") - 0.5, F.col("bottom") - F.col("half") + 0.5
    y = F.when((F.col("d0") < 0) & (F.col("d1") >= 0), F.least(F.col("y"), up)).when((F.col("d0") > 0) & (F.col("d1") <= 0), F.greatest(F.col("y"), down))
    return rows.select(*keys, "x", F.coalesce(y, F.col("y")).alias("y"))


def layout_names() -> list[str]:
    return list(LAYOUTS)


def content_box(points: DataFrame, mm_px: float, left: float = 16, right: float = 8, above: float = 10, below: float = 8) -> DataFrame:
    """record_id, x0, x1, y0, y1 of what is drawn, with margins in millimetres; may leave the page."""
    b = points.groupBy("record_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cast = lambda c: c.cast("int")
    return b.select("record_id", cast(F.col("x0") - left * mm_px).alias("x0"), cast(F.col("x1") + right * mm_px).alias("x1"), cast(F.col("y0") - above * mm_px).alias("y0"), cast(F.col("y1") + below * mm_px).alias("y1"))


def rescaled(signals: DataFrame, keys, limit: float = 10.0) -> DataFrame:
    """signals with mv brought to [-1, 1] in the series that exceed the limit: their scale is not known."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min("mv").over(w), F.max("mv").over(w)
    rows = signals.withColumn("lo", lo).withColumn("hi", hi)
    over = (F.greatest(F.abs("lo"), F.abs("hi")) > limit) & (F.col("hi") > F.col("lo"))
    return rows.withColumn("mv", F.when(over, (F.col("mv") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 2 - 1).otherwise(F.col("mv"))).drop("lo", "hi")


def safe_angle(angle: Column) -> Column:
    """An angle, 0 where it is missing or not a number."""
    return F.coalesce(F.nanvl(angle, F.lit(0.0)), F.lit(0.0))


def probe_peaks(signals: DataFrame, threshold: float) -> DataFrame:
    """record_id, lead, a, width, top of each stretch over the threshold (width in samples at half its top)."""
    key = ["record_id", "lead"]
    w = Window.partitionBy(*key).orderBy("i")
    rows = signals.withColumn("rn", F.row_number().over(w)).where(F.col("mv") > threshold)
    rows = rows.withColumn("island", F.col("rn") - F.row_number().over(w))
    rows = rows.withColumn("top", F.max("mv").over(Window.partitionBy(*key, "island")))
    return rows.groupBy(*key, "island").agg(F.min("i").alias("a"), F.count_if(F.col("mv") >= F.col("top") / 2).alias("width"), F.first("top").alias("top")).drop("island")


def drift_removed(signals: DataFrame, fs: int, seconds: float = 0.6) -> DataFrame:
    """signals (record_id, lead, i, mv) less their running median, segment by segment."""
    return less_running_median(signals, ["record_id", "lead"], int(seconds * fs) | 1)


def digitised(trace: DataFrame, keys, fs: int, seconds: str, mm_px: str, limit: float = 3.0, drift_seconds: float = 0.6) -> DataFrame:
    """keys, j, mv: traces (keys, x, y without gaps, and columns `seconds` and `mm_px`) as fs * seconds samples from the first column to the last.

    Heights become mV off the median height, lose their running median over
    drift_seconds (of samples; never over more columns than there are), are held
    within the limit, and are read off straight lines between columns.
    """
    keys = [*keys]
    whole = Window.partitionBy(*keys)
    level = trace.groupBy(*keys).agg(F.percentile("y", F.lit(0.5)).alias("_m"))
    mv = trace.join(level, keys).select(*keys, F.col("x").alias("i"), (-(F.col("y") - F.col("_m")) / (MM_PER_MV * F.col(mm_px))).alias("mv"))
    flat = less_running_median(mv, keys, int(drift_seconds * fs) | 1, within=True)
    w = whole.orderBy("i")
    held = F.least(F.lit(limit), F.greatest(F.lit(-limit), F.col("mv")))
    points = flat.select(*keys, "i", held.alias("a")).withColumn("p", F.row_number().over(w) - 1).withColumn("b", F.coalesce(F.lead("a").over(w), F.col("a")))
    sizes = trace.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(seconds).alias("_s")).withColumn("_to", F.floor(F.col("_s") * fs).cast("int")).where("_to > 0")
    grid = sizes.select(*keys, "_n", "_to", F.explode(F.sequence(F.lit(0), F.col("_to") - 1)).alias("j"))
    grid = grid.withColumn("_at", F.col("j") * (F.col("_n") - 1) / F.greatest(F.lit(1), F.col("_to") - 1)).withColumn("p", F.floor("_at").cast("int"))
    return grid.hint("merge").join(points.select(*keys, "p", "a", "b"), [*keys, "p"]).select(*keys, "j", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("_at") - F.col("p"))).alias("mv"))
