"""Traces followed from batch to batch, and records read in stretches."""

import random

import numpy as np

from pulsegrid.operators.layout import traces
from pulsegrid.plans.report import wfdb_files
from pulsegrid.sources import readers, wfdb
from pulsegrid.streaming.trajectory import followed

CLUSTERS = "record_id long, lead string, x int, centre double, thickness int, base double"


def test_points_do_not_depend_on_batches(spark, tmp_path, slew=9.0):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(5)
    rows = []
    for rec, lead in ((1, "I"), (1, "II"), (2, "I")):
        for x in range(60):
            if rng.random() < 0.85:
                rows += [(rec, lead, x, 20 + 8 * np.sin(x / 6 + rec) + rng.choice([0, 0, 30, -25]) + 0.5 * k, rng.randint(1, 3), 20.0) for k in range(rng.randint(1, 3))]
    frame = spark.createDataFrame([(a, b, c, float(d), e, f) for a, b, c, d, e, f in rows], CLUSTERS)
    widths = frame.select("record_id", "lead", "base").distinct().selectExpr("record_id", "lead", "base", "60 as width")
    want = {(r.record_id, r.lead, r.x): r.y for r in traces(frame, ["record_id", "lead"], widths, slew).collect()}
    for cuts in ([13, 40, 60],):
        folder = str(tmp_path / f"in{len(cuts)}")
        for a, b in zip([0, *cuts], cuts):
            frame.where(f"x >= {a} and x < {b}").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(CLUSTERS).option("maxFilesPerTrigger", 1).parquet(folder)
        name = f"points{len(cuts)}"
        q = followed(stream, slew).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = spark.table(name).collect()
        assert len({(r.record_id, r.lead, r.x) for r in got}) == len(got) > 60
        assert all(want[r.record_id, r.lead, r.x] == r.y for r in got)
        last = {}
        for r in sorted(got, key=lambda r: (r.record_id, r.lead, r.x)):
            before = last.get((r.record_id, r.lead))
            assert before is None or r.gap == r.x - before - 1
            last[r.record_id, r.lead] = r.x
        # what lies between two points of the whole trace is filled, so the points are all it took
        for key in last:
            points = {r.x: r.y for r in got if (r.record_id, r.lead) == key}
            filled = np.interp(range(60), sorted(points), [points[x] for x in sorted(points)])
            assert np.allclose(filled, [want[(*key, x)] for x in range(60)])


def test_stretches_of_a_file_make_the_record(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"r{k}", lead, i, round(float(v), 3)) for k in range(3) for lead in ("I", "aVR", "V1") for i, v in enumerate(rng.normal(size=700 + k))]
    for r in wfdb_files(spark.createDataFrame(rows, "record_id string, lead string, i int, mv double"), 250).collect():
        (tmp_path / f"{r.record_id}.hea").write_text(r.header)
        (tmp_path / f"{r.record_id}.dat").write_bytes(r.data)
    wfdb.register(spark)
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        got = spark.read.format("wfdb16").option("stretch", 600).load(folder)
        assert got.rdd.getNumPartitions() == 7 + 8 + 8
        found = {(r.record_id, r.lead, r.i): r.mv for r in got.collect()}
        assert len(found) == len(rows) and all(abs(found[k, lead, i] - v) < 1e-9 for k, lead, i, v in rows)
        assert [r.fs for r in got.select("fs").distinct().collect()] == [250]
    whole = {(r.record_id, r.lead): r.samples for r in readers.wfdb_signals(spark, f"{tmp_path}/*.hea", f"{tmp_path}/*.dat").collect()}
    assert all(whole[k, lead][i] == v for (k, lead, i), v in found.items())
    one = spark.read.format("wfdb16").option("stretch", 600).load(str(tmp_path)).where("record_id = 'r1'")
    assert one.rdd.getNumPartitions() == 8 and one.count() == 3 * 701
