"""Sinks, the probe signal and pairs of heights on small inputs."""

from pulsegrid.operators.compare import height_pairs
from pulsegrid.operators.layout import keep_best
from pulsegrid.plans.report import from_start, wfdb_blocks, wfdb_files, wfdb_heads, write_matrix, write_table_csv
from pulsegrid.sources.synthetic import probe

SIGNAL = "record_id long, lead string, i int, mv double"


def test_probe_has_whole_periods_only(spark):
    got = probe(spark.createDataFrame([(1,)], "record_id long"), leads=["I"]).toPandas()
    tops = got[got.mv.abs() == 1.0]
    assert len(got) == 5000 and len(tops) == 24
    assert tops.i.tolist() == list(range(100, 4800, 200)) and tops.mv.tolist() == [1.0, -1.0] * 12


def test_heights_of_a_moved_signal(spark):
    shape = {50: 1.0, 51: 0.6, 120: -0.9, 121: -0.4}
    truth = spark.createDataFrame([(1, "I", i, shape.get(i, 0.0)) for i in range(200)], SIGNAL)
    ours = spark.createDataFrame([(1, "I", i, 0.5 * shape.get(i - 5, 0.0)) for i in range(200)], SIGNAL)
    peaks = spark.createDataFrame([(1, 50), (1, 120), (1, 2)], "record_id long, peak int")
    got = sorted((r.peak, r.truth, r.ours) for r in height_pairs(ours, truth, peaks, 10, 10, 3).collect())
    assert got == [(55, 1.0, 0.5), (125, 0.9, 0.45)]
    assert height_pairs(ours.limit(0), truth, peaks, 10, 10, 3).isEmpty()


def test_second_method_only_where_weak_and_better(spark):
    first = spark.createDataFrame([("a", 0.95, 1), ("b", 0.5, 1), ("c", 0.5, 1)], "cell string, q double, y int")
    second = spark.createDataFrame([("a", 0.99, 2), ("b", 0.6, 2), ("c", 0.5, 2)], "cell string, q double, y int")
    assert sorted(map(tuple, keep_best(first, second, ["cell"]).collect())) == [("a", 0.95, 1), ("b", 0.6, 2), ("c", 0.5, 1)]


def test_start_and_sinks(spark, tmp_path):
    s = spark.createDataFrame([(1, "I", 0, None), (1, "I", 1, 0.5), (1, "I", 2, None), (1, "II", 0, 0.25), (2, "I", 0, None)], SIGNAL)
    assert sorted(map(tuple, from_start(s).collect())) == [(1, "I", 0, 0.5), (1, "I", 1, None), (1, "II", 0, 0.25)]
    write_matrix(s, f"{tmp_path}/matrix", ["I", "II"])
    back = {(r.record_id, r.sample): (r.I, r.II) for r in spark.read.parquet(f"{tmp_path}/matrix").collect()}
    assert back == {(1, 0): (None, 250.0), (1, 1): (500.0, None), (1, 2): (None, None), (2, 0): (None, None)}
    write_table_csv(spark.createDataFrame([(7, "x", "why, so")], "ecg_id long, `group` string, why string"), f"{tmp_path}/cases")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/cases").collect()] == [("7", "x", "why, so")]


def test_parts_of_a_record_are_its_file(spark):
    rows = [(k, lead, i, (i * 7 % 23 - 11) / 10 * (1 + k) + j if i % 5 else None) for k in (1, 2) for j, lead in enumerate(("V1", "I")) for i in range(50 + k + j)] + [(1, "I", 51, 99.0)]
    s = spark.createDataFrame(rows, SIGNAL)
    whole = {r.record_id: r for r in wfdb_files(s, 250).collect()}
    parts = {}
    for r in wfdb_blocks(s, block=16).collect():
        parts.setdefault(r.record_id, {})[r.block] = bytes(r.data)
    for k in (1, 2):
        n = 50 + k
        want = {lead: [round(max(-32768, min(32767, (v or 0) * 1000))) for r, x, _, v in sorted(rows, key=lambda r: r[2]) if r == k and x == lead][:n] for lead in ("I", "V1")}
        data = b"".join(v.to_bytes(2, "little", signed=True) for pair in zip(want["I"], want["V1"]) for v in pair)
        assert bytes(whole[k].data) == data == b"".join(parts[k][b] for b in sorted(parts[k])) and len(parts[k]) == 4
        sums = {lead: sum(v) & 0xFFFF for lead, v in want.items()}
        assert whole[k].header == f"{k} 2 250 {n}\n" + "".join(f"{k}.dat 16 1000.0(0)/mV 16 0 {want[x][0]} {sums[x] - 65536 if sums[x] > 32767 else sums[x]} 0 {x}\n" for x in ("I", "V1"))
    assert {r.record_id: r.samples for r in wfdb_heads(s, 250).collect()} == {1: 51, 2: 52}
