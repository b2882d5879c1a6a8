"""Measurements on closed-form signals, sources and sinks."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators import beats as B
from pulsegrid.operators import compare as C
from pulsegrid.operators import delineate as D
from pulsegrid.operators import layout as Y
from pulsegrid.operators import leads as L
from pulsegrid.plans import report as R
from pulsegrid.schema import INDEPENDENT, LIMB
from pulsegrid.sources import readers, synthetic

FS = 250


def measured(spark, records=2, without=(), scale=1.0):
    ids = spark.range(records).withColumnRenamed("id", "record_id")
    s = synthetic.signals(ids, FS, 1250, INDEPENDENT, without).withColumn("mv", F.col("mv") * scale)
    beats, stacks, rates, r = B.representative(L.complete(s), FS)
    return {row["record_id"]: row for row in D.measurements(beats, stacks, rates, r, FS).collect()}


def test_chain_on_known_signal(spark):
    m = measured(spark)[0]
    assert abs(m["hr"] - 75) < 1 and 40 <= m["qrs_ms"] <= 120 and m["flags"] == []
    assert 60 <= m["p_ms"] <= 130 and m["pr_ms"] is not None and m["qt_ms"] > m["qrs_ms"]
    half = measured(spark, 1, scale=0.5)[0]
    assert half["qrs_ms"] == m["qrs_ms"] and abs(half["axis_qrs"] - m["axis_qrs"]) < 1e-6
    assert abs(half["amp"]["II"]["r"] / m["amp"]["II"]["r"] - 0.5) < 1e-6


def test_no_p_wave_is_flagged(spark):
    m = measured(spark, 1, without=(0,))[0]
    assert m["p_ms"] is None and "p" in m["flags"]


def test_fill_is_exact_and_keeps_observed(spark):
    ids = spark.range(1).withColumnRenamed("id", "record_id")
    s = L.complete(synthetic.signals(ids, FS, 50, ["I", "II"]))
    truth = {(r["lead"], r["i"]): r["mv"] for r in s.collect()}
    holed = s.withColumn("mv", F.when(F.xxhash64("lead", "i") % 3 != 0, F.col("mv")))
    rows = L.fill(holed).collect()
    known = {}
    for r in rows:
        known.setdefault(r["i"], []).append(r["mv"] is not None)
    for r in rows:
        if r["mv"] is not None:
            assert r["filled"] == r["mv"]
        elif sum(known[r["i"]]) >= 2:
            assert abs(r["filled"] - truth[r["lead"], r["i"]]) < 1e-9
        else:
            assert r["filled"] is None


def test_consistency_is_zero_for_derived_leads(spark):
    ids = spark.range(1).withColumnRenamed("id", "record_id")
    row = L.consistency(L.complete(synthetic.signals(ids, FS, 200, ["I", "II"]))).first()
    assert row["n"] == 200 and max(row["residual"], row["einthoven"], row["goldberger"]) < 1e-9


def test_energy_shift_recovers_a_lag(spark):
    ids = spark.range(1).withColumnRenamed("id", "record_id")
    s = synthetic.signals(ids, FS, 200, ["I", "II"])
    moved = s.where("lead = 'II'").unionByName(s.where("lead = 'I'").withColumn("i", F.col("i") + 3))
    shifts = {r["lead"]: r["shift"] for r in B.energy_shift(moved, 66, FS).collect()}
    assert shifts == {"II": 0, "I": -3}


def test_wfdb_round_trip(spark, tmp_path):
    ids = spark.range(2).withColumnRenamed("id", "record_id")
    s = synthetic.signals(ids, FS, 100, list(LIMB)).withColumn("record_id", F.concat(F.lit("r"), F.col("record_id").cast("string")))
    for row in R.wfdb_files(s, FS).collect():
        (tmp_path / f"{row['record_id']}.hea").write_text(row["header"])
        (tmp_path / f"{row['record_id']}.dat").write_bytes(row["data"])
    back = readers.wfdb_signals(spark, f"{tmp_path}/*.hea", f"{tmp_path}/*.dat")
    truth = {(r["record_id"], r["lead"], r["i"]): r["mv"] for r in s.collect()}
    rows = back.collect()
    assert len(rows) == 12
    for r in rows:
        assert r["checksum_ok"] and r["fs"] == FS and len(r["samples"]) == 100
        assert all(abs(v - truth[r["record_id"], r["lead"], i]) <= 0.00051 for i, v in enumerate(r["samples"]))


def test_engine_csv(spark, tmp_path):
    d = tmp_path / "rec1"
    d.mkdir()
    (d / "a.csv").write_text("I,ii,aVR,foo\n1000,nan,-5,1\n,2000,,2\n")
    rows = {(r["lead"], r["i"]): r["mv"] for r in readers.engine_csv(spark, f"{d}/*.csv").collect()}
    assert len(rows) == 24 and rows["I", 0] == 1.0 and rows["II", 0] is None and rows["I", 1] is None and rows["II", 1] == 2.0 and rows["aVR", 0] == -0.005
    assert readers.engine_csv(spark, f"{d}/*.csv", all_leads=False).count() == 0


def png(path, rows):
    """Writes rows of (r, g, b) pixels as a PNG."""
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_to_ink(spark, tmp_path):
    dark = {(x, 10 + x % 3) for x in range(30)}
    png(tmp_path / "p.png", [[(20, 20, 20) if (x, y) in dark else (250, 240, 240) for x in range(30)] for y in range(24)])
    (tmp_path / "bad.png").write_bytes(b"no image")
    images = readers.page_images(spark, str(tmp_path)).withColumn("record_id", F.lit("p"))
    found = {(r["x"], r["y"]) for r in Y.ink(Y.gray_pixels(images)).collect()}
    assert found == dark
    kinds = {r["path"].split("/")[-1]: r["kind"] for r in readers.image_bytes(spark, str(tmp_path)).collect()}
    assert kinds == {"p.png": "png", "bad.png": "other"}


@pytest.mark.parametrize("rows,name", [(4, "3x4_1R"), (7, "6x2_1R"), (12, "12x1")])
def test_layout_is_told_by_rows(spark, rows, name):
    points = [("p", x, int(20 + 30 * k + (x % 7))) for k in range(rows) for x in range(200)]
    height = 40 + 30 * rows
    ink = spark.createDataFrame(points, "record_id string, x int, y int")
    profile = Y.row_profile(ink, spark.createDataFrame([("p", 200, height)], "record_id string, width int, height int"))
    centres = Y.row_centres(profile, [4, 7, 12])
    assert Y.choose_layout(Y.layout_scores(profile, centres)).first()["layout"] == name
    b = Y.bands(profile, centres.where(F.col("n_rows") == rows)).orderBy("k").collect()
    assert len(b) == rows and all(x["hi"] == y["lo"] for x, y in zip(b, b[1:]))


def test_annotations_and_metadata(spark):
    raw = spark.createDataFrame([(1, "100", "160", "", "400", "55", "1"), (2, "None", "150", "90", "380", "10", "0")], "ecg_id int, P_Dur_Global string, PR_Int_Global string, QRS_Dur_Global string, QT_Int_Global string, QRS_AxisFront_Global string, QRS_AxisIndet_Global string")
    a = {r["ecg_id"]: r for r in readers.annotations(raw, "a").collect()}
    assert a[1]["axis_qrs"] is None and a[1]["p_found"] and a[1]["qrs_ms"] is None and a[2]["axis_qrs"] == 10.0 and not a[2]["p_found"]
    m = readers.manifests(spark.createDataFrame([("a", '{"fs": 1000, "layout": "3x4"}'), ("b", "no json")], "path string, text string")).orderBy("path").collect()
    assert (m[0]["fs"], m[0]["layout"], m[1]["fs"]) == (1000, "3x4", 500)


def test_scalars(spark):
    row = spark.range(1).select(
        S.samples_of(F.lit(5.0), 500).alias("half"), S.arc_difference(F.lit(170.0), F.lit(-170.0)).alias("arc"), S.axis_degrees(F.lit(0.0), F.lit(0.0)).alias("none"),
        S.corrected_qt(F.lit(400.0), F.lit(1000.0)).alias("q"), S.sokolow(F.lit(-1.5), F.lit(2.0), F.lit(2.0)).alias("s"), S.sokolow(F.lit(-1.5), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("n"), S.lead_name(F.lit("avr")).alias("lead"),
    ).first()
    assert row["half"] == 2 and row["arc"] == -20.0 and row["none"] is None and row["lead"] == "aVR" and row["n"] is None
    assert set(row["q"].asDict().values()) == {400.0} and row["s"]["lead"] == "V6" and row["s"]["mm"] == 35.0 and row["s"]["over"]


def test_clipboard_json(spark):
    import json

    ids = spark.range(1).withColumnRenamed("id", "record_id")
    beats, stacks, rates, r = B.representative(L.complete(synthetic.signals(ids, FS, 1250, INDEPENDENT)), FS)
    m = D.measurements(beats, stacks, rates, r, FS)
    body = json.loads(R.clipboard_json(m).first()["json"])
    assert "not a medical device" in body["disclaimer"] and body["rhythm"]["bpm"] == 75 and "V1" in body["amplitudes"]
    assert R.qt_caption(m).first()["caption"].startswith(f"{body['intervals']['qt_ms']}")
    assert R.beat_svg(beats).where("lead = 'I'").first()["svg"].startswith("<path")


def test_groups_and_samples(spark):
    m = spark.createDataFrame([(1, "NORM", 100.0), (1, "AFIB", 100.0), (2, "NORM", 80.0), (3, "X", 1.0)], "id int, g string, c double")
    got = {r["id"]: r["g"] for r in C.one_group_each(m, "id", "g", "c", "NORM").collect()}
    assert got == {1: "AFIB", 2: "NORM", 3: "X"}
    assert C.sample_per_group(m, "g", "id", 1, 3).count() == 3
    assert {r["id"] for r in C.pending(m.select("id").distinct(), m.where("id = 1"), "id").collect()} == {2, 3}


def test_drift_removal(spark):
    import numpy as np

    from pulsegrid.functions import kernels

    x = np.random.default_rng(1).normal(size=40)
    wide = [*x[4::-1], *x, *x[:-6:-1]]
    assert np.allclose(kernels.running_median(x, 11), [np.median(wide[i : i + 11]) for i in range(40)])
    rows = [("r", "I", i, 0.01 * i + (1.0 if i % 50 == 25 else 0.0)) for i in range(200)]
    out = {r["i"]: r["mv"] for r in Y.drift_removed(spark.createDataFrame(rows, "record_id string, lead string, i int, mv double"), 100).collect()}
    assert len(out) == 200 and abs(out[100]) < 0.02 and abs(out[75] - 1.0) < 0.02


def test_trace_quality_and_apexes(spark):
    good = [("g", x, 50.0 + 10 * ((x % 8) - 4), 100) for x in range(64)]
    flat = [("f", x, 0.0 if x % 4 else None, 100) for x in range(64)]
    q = {r["k"]: r["q"] for r in Y.trace_quality(spark.createDataFrame(good + flat, "k string, x int, y double, h int"), ["k"], "y", "h").collect()}
    assert q["g"] > 0.85 > q["f"]
    trace = spark.createDataFrame([("a", x, float(y)) for x, y in enumerate([20, 20, 15, 11, 15, 20, 20])], "k string, x int, y double")
    edges = spark.createDataFrame([("a", x, y - 1, y + 1) for x, y in enumerate([20, 20, 15, 9, 15, 20, 20])], "k string, x int, top int, bottom int")
    moved = {r["x"]: r["y"] for r in Y.apexes(trace, edges, ["k"]).collect()}
    assert moved[3] == 9.0 and moved[2] == 15.0 and moved[0] == 20.0


def test_page_to_signal(spark):
    """Lines drawn at known heights come back as millivolts of a known scale."""
    mm = 4.0
    truth = {x: (0.5 if 40 <= x < 60 else 0.0) for x in range(120)}
    ink = spark.createDataFrame([("p", x, int(100 - truth[x] * 10 * mm) + t) for x in truth for t in (-1, 0, 1)], "record_id string, x int, y int")
    line = Y.traces(Y.column_clusters(ink, ["record_id"]), ["record_id"], spark.createDataFrame([("p", 120)], "record_id string, width int"))
    base = Y.histogram_mode(line, ["record_id"], "y").first()["base"]
    got = {r["x"]: r["mv"] for r in line.withColumn("mv", Y.millivolts(F.col("y"), F.lit(base), F.lit(mm))).collect()}
    assert all(abs(got[x] - truth[x]) < 0.05 for x in truth)
