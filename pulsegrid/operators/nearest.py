"""Nearest rows of another growing table by time, and what maps show where a trace is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.series import filled
from pulsegrid.tables import materialise


def nearest(left: DataFrame, right: DataFrame, keys, order: str, value: str, tolerance: float | None = None) -> DataFrame:
    """left with other_<order> and <value> of the row of right with the same keys whose order is nearest; the earlier of two as near.

    Rows further away than the tolerance count as none, and a left row without
    one stays with nulls.  Of right rows at one place the least value counts;
    right rows without an order or value, and null keys, match nothing.  Both sides are
    sorted together over all partitions, and each partition gets the last and
    next right row of its keys from the partitions around it, so one key may
    hold any share of the rows.  No inequality join.
    """
    keys = [*keys]
    spark = left.sparkSession
    own = [c for c in left.columns if c not in (*keys, order)]
    spot = F.col(order).cast("double")
    points = right.dropna(subset=[*keys, order, value]).groupBy(*keys, order).agg(F.min(value).alias("v")).select(*keys, spot.alias("o"), F.lit(0).alias("side"), F.struct(spot.alias("o"), F.col(order).alias("other"), "v").alias("p"))
    rows = left.select(*keys, spot.alias("o"), F.lit(1).alias("side"), F.struct(F.col(order).alias("_order"), *own).alias("row"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = points.unionByName(rows, allowMissingColumns=True).repartitionByRange(n, *keys, "o", "side")
    both = materialise(both.withColumn("part", F.spark_partition_id()), "nearest")
    # what each partition holds of a key, and what lies before and after it: one row for each key and partition at most
    ends = both.where("side = 0").groupBy(*keys, "part").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    held = both.select(*keys, "part").distinct().join(ends, [*keys, "part"], "left")
    by_part = Window.partitionBy(*keys).orderBy("part")
    held = held.select(
        *keys, "part", F.last("last", ignorenulls=True).over(by_part.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", ignorenulls=True).over(by_part.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    w = Window.partitionBy(*keys, "part").orderBy("o", "side")
    near = both.select(
        *keys, "part", "o", "side", "row", F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("p0"), F.first("p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("p1"),
    ).where("side = 1")
    near = near.join(held, [*keys, "part"], "left").select(*keys, "o", "row", F.coalesce("p0", "before").alias("p0"), F.coalesce("p1", "after").alias("p1"))
    earlier = F.col("p1").isNull() | (F.col("o") - F.col("p0.o") <= F.col("p1.o") - F.col("o"))
    near = near.select(*keys, "o", "row", F.when(F.col("o").isNotNull(), F.when(F.col("p0").isNotNull() & earlier, F.col("p0")).otherwise(F.col("p1"))).alias("p"))
    if tolerance is not None:
        near = near.withColumn("p", F.when(F.abs(F.col("p.o") - F.col("o")) <= tolerance, F.col("p")))
    return near.select(*keys, F.col("row._order").alias(order), *[F.col(f"row.{c}").alias(c) for c in own], F.col("p.other").alias(f"other_{order}"), F.col("p.v").alias(value))


#: Columns with a trace below which a band counts as empty, and rows looked at to both sides of the expected height.
LEAST_SEEN, REACH = 10, 3


def gap_diagnostics(maps: DataFrame, keys, threshold: float) -> DataFrame:
    """keys, gap, signal, grid, text: share of columns of a band in which no signal passes the threshold, and the mean over them of each map's largest value where the line is expected.

    maps: keys (record and band), x, y (from 0), signal, grid, text; dense.
    The expected height is the centre of mass of the columns that have a line,
    carried on straight between them and level at the ends.  Bands with fewer
    than LEAST_SEEN such columns give no row, those without gaps nulls.
    """
    keys = [*keys]
    mass = F.sum(F.col("signal") * F.col("y")) / F.greatest(F.sum("signal"), F.lit(1e-6))
    columns = maps.groupBy(*keys, "x").agg(F.when(F.max("signal") > threshold, mass).alias("seen"))
    columns = columns.withColumn("n", F.count("seen").over(Window.partitionBy(*keys))).where(F.col("n") >= LEAST_SEEN)
    columns = columns.withColumn("at", F.floor(filled("seen", keys, "x")).cast("int"))
    gaps = columns.where("seen is null").select(*keys, "x", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - REACH), F.col("at") + REACH)).alias("y"))
    best = gaps.join(maps, [*keys, "x", "y"]).groupBy(*keys, "x").agg(*[F.max(c).alias(c) for c in ("signal", "grid", "text")])
    means = best.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("signal", "grid", "text")])
    shares = columns.groupBy(*keys).agg(F.avg(F.col("seen").isNull().cast("double")).alias("gap"))
    return shares.join(means, keys, "left")
