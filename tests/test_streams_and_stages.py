import pytest
from pyspark.sql import functions as F

from pulsegrid.plans import stages
from pulsegrid.streaming import sessions


def arriving(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{s:02d}", float(s)) for s in (0, 1, 2, 8, 9, 21)]
    spark.createDataFrame(rows, "record_id string, ts string, mv double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("record_id string, ts timestamp, mv double").parquet(str(tmp_path / "in"))


def test_windows_and_fragments(spark, tmp_path):
    s = arriving(spark, tmp_path)
    for k, (df, want) in enumerate(((sessions.page_windows(s), [5, 1]), (sessions.fragments(s, "3 seconds"), [3, 2, 1]))):
        q = df.writeStream.format("memory").queryName(f"m{k}").outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert [r["n"] for r in spark.sql(f"select n from m{k} order by start").collect()] == want


def test_each_batch(spark, tmp_path):
    q = sessions.each_batch(arriving(spark, tmp_path), lambda b: b.groupBy("record_id").count(), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first()["count"] == 6


def test_stages(spark):
    stages.register("double", lambda df, by=2: df.withColumn("id", F.col("id") * by))
    steps = [stages.Step("double", params={"by": 3}), stages.Step("absent", enabled=False), stages.Step("reconstruct")]
    assert [r["id"] for r in stages.run(spark.range(3), steps).orderBy("id").collect()] == [0, 3, 6]
    with pytest.raises(KeyError):
        stages.run(spark.range(1), [stages.Step("absent")])


def test_cache_computes_new_contents_once(spark):
    images = spark.createDataFrame([(b"x",), (b"x",), (b"y",)], "content binary")
    seen = stages.cached(images, spark.createDataFrame([], "key string, n int"), "m", lambda d: d.withColumn("n", F.length("content")))
    rows = seen.collect()
    assert len(rows) == 2
    again = stages.cached(images, spark.createDataFrame(rows), "m", lambda d: d.withColumn("n", F.lit(-1)))
    assert sorted(r["n"] for r in again.collect()) == [1, 1]
