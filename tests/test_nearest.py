"""Nearest rows, gap diagnostics and long files against direct loops."""

import random

import numpy as np

from pulsegrid.operators.nearest import gap_diagnostics, nearest
from pulsegrid.sources.readers import engine_csv


def loop(left, right, tolerance):
    out = []
    for k, t, name in left:
        best = None
        for k2, t2, v in right:
            if k is not None and k == k2 and t is not None and t2 is not None and v is not None:
                rank = (abs(t2 - t), t2, v)
                best = rank if best is None or rank < best else best
        out.append((k, t, name, *((best[1], best[2]) if best and (tolerance is None or best[0] <= tolerance) else (None, None))))
    return sorted(out, key=str)


def test_nearest_rows_of_a_hot_key(spark):
    rng = random.Random(6)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(key(), rng.choice([None, *range(-50, 400)]), f"n{i}") for i in range(400)]
    right = [(key(), rng.choice([None, *range(0, 350, 7)]), rng.randint(0, 9)) for _ in range(150)] + [("only right", 3, 1)]
    left.append(("only left", 3, "x"))
    a, b = spark.createDataFrame(left, "k string, t int, name string"), spark.createDataFrame(right, "k string, t int, v int")
    for tolerance in (None, 2):
        got = nearest(a, b, ["k"], "t", "v", tolerance)
        assert got.columns == ["k", "t", "name", "other_t", "v"]
        assert sorted(map(tuple, got.collect()), key=str) == loop(left, right, tolerance)
    assert nearest(a.limit(0), b, ["k"], "t", "v").collect() == []
    assert all(r.v is None for r in nearest(a, b.limit(0), ["k"], "t", "v").collect())


def test_gaps_of_a_map(spark):
    rng = np.random.default_rng(8)
    maps = {k: rng.random((3, 14, 60)) ** 3 for k in range(3)}
    for m in maps.values():
        m[0, :, rng.random(60) < 0.4] *= 0.2
    maps[2][0, :, 5:] = 0.1
    rows = [(k, x, y, *map(float, m[:, y, x])) for k, m in maps.items() for y in range(14) for x in range(60)]
    got = {r.record_id: r for r in gap_diagnostics(spark.createDataFrame(rows, "record_id int, x int, y int, signal double, grid double, text double"), ["record_id"], 0.6).collect()}
    assert set(got) == {0, 1}
    for k in (0, 1):
        signal = maps[k][0]
        seen = np.flatnonzero((signal > 0.6).any(axis=0))
        gaps = np.setdiff1d(np.arange(60), seen)
        centre = [(signal[:, x] * np.arange(14)).sum() / signal[:, x].sum() for x in seen]
        at = np.interp(gaps, seen, centre).astype(int)
        want = [np.mean([m[max(0, y - 3) : y + 4, x].max() for x, y in zip(gaps, at)]) for m in maps[k]]
        assert abs(got[k].gap - len(gaps) / 60) < 1e-12 and np.allclose([got[k].signal, got[k].grid, got[k].text], want)


def test_lines_of_a_file_are_not_counted_out(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "x.csv").write_text("I,II\n1000,2000\nnan,\n500,3000")
    (tmp_path / "r2").mkdir()
    (tmp_path / "r2" / "x.csv").write_text("I")
    got = {(r.record_id, r.lead, r.i): r.mv for r in engine_csv(spark, f"{tmp_path}/*/x.csv").where("lead in ('I', 'II')").collect()}
    assert got == {("r1", "I", 0): 1.0, ("r1", "II", 0): 2.0, ("r1", "I", 1): None, ("r1", "II", 1): None, ("r1", "I", 2): 0.5, ("r1", "II", 2): 3.0}
