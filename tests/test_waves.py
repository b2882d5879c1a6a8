"""P bounds, refined peaks and followed traces against brute force on random series."""

import numpy as np
import pytest

from pulsegrid.operators import beats as B
from pulsegrid.operators import delineate as D
from pulsegrid.operators import layout as Y
from pulsegrid.schema import P_WAVE as P

FS = 500


def _ms(v):
    return int(round(v * FS / 1000))


def brute_p(mag, on, rr):
    """The definition in D.p_waves, by sets of sample numbers."""
    lo, hi = max(0, on - _ms(min(340.0, 0.5 * rr))), on - _ms(25)
    if hi - lo < _ms(80):
        return None
    part = {i: mag[i] for i in range(lo, hi)}
    n = _ms(40)
    spans = [mag[i : i + n] for i in range(lo, hi - n + 1)] or [mag[lo:hi]]
    stand = max(P["least_mv"], P["snr"] * min(max(s) - min(s) for s in spans))
    tops = []
    for i in part:
        same = [j for j in part if mag[j] == mag[i] and all(mag[k] == mag[i] for k in range(min(i, j), max(i, j) + 1))]
        a, b = min(same), max(same)
        if i != (a + b) // 2 or a == lo or b == hi - 1 or not (mag[a - 1] < mag[i] > mag[b + 1]):
            continue
        left, right = [j for j in part if j < i], [j for j in part if j > i]
        walls = max([j for j in left if mag[j] > mag[i]], default=lo - 1), min([j for j in right if mag[j] > mag[i]], default=hi)
        if mag[i] - max(min(mag[walls[0] + 1 : i + 1]), min(mag[i : walls[1]])) >= stand:
            tops.append(i)
    if mag[hi - 1] - min(part.values()) >= stand and hi - 1 - _ms(20) >= lo and mag[hi - 1] > mag[hi - 1 - _ms(20)]:
        tops.append(hi - 1)
    if not tops:
        return None
    top = tops[-1]

    def side(s):
        end = min(_ms(P["foot_ms"]), top - lo if s < 0 else hi - 1 - top)
        at = lambda d: mag[top + s * d]
        lows = [d for d in range(end + 1) if all(at(d) <= at(e) for e in range(d))]
        ends = []
        for k, d in enumerate(lows):
            following = lows[k + 1] if k + 1 < len(lows) else 10**9
            beyond = range(d + 1, d + 1 + _ms(P["join_ms"])) if s < 0 else range(d, d + _ms(P["join_ms"]))
            ahead = [at(e) for e in beyond if 0 <= top + s * e < len(mag)]
            if following > d + _ms(20) and d + _ms(20) <= end and not (ahead and max(ahead) >= at(d) + 0.5 * (at(0) - at(d))):
                ends.append(d)
        foot = ends[0] if ends else lows[-1]
        limit = at(foot) + P["k"] * (at(0) - at(foot))
        return min([d for d in range(foot) if at(d) < limit], default=foot)

    on_, off = top - side(-1), top + side(1)
    return (on_, off) if on_ > lo and _ms(P["least_ms"]) <= off - on_ <= _ms(P["most_ms"]) else None


@pytest.fixture(scope="module")
def magnitudes():
    rng = np.random.default_rng(8)
    out = []
    for k in range(120):
        on, rr = int(rng.integers(150, 260)), float(rng.choice([400, 600, 800, 1000]))
        t = np.arange(400)
        x = np.abs(rng.normal(0, [0, 0.003, 0.02][k % 3], 400))
        for _ in range(rng.integers(0, 4)):
            x = x + rng.uniform(0.02, 0.4) * np.exp(-((t - rng.integers(on - 180, on + 5)) ** 2) / (2 * rng.uniform(5, 25) ** 2))
        x = np.convolve(x, np.ones(9) / 9, mode="same")
        out.append((k, np.round(x, 2 if k % 5 == 0 else 6).tolist(), on, rr))  # every fifth one has flat tops
    return out


def p_rows(spark, magnitudes):
    m = spark.createDataFrame([(k, i, v) for k, x, _, _ in magnitudes for i, v in enumerate(x)], "record_id long, i int, mag double")
    b = spark.createDataFrame([(k, on, on + 50) for k, _, on, _ in magnitudes], "record_id long, qrs_on int, qrs_off int")
    r = spark.createDataFrame([(k, rr) for k, _, _, rr in magnitudes], "record_id long, rr_ms double")
    return {r["record_id"]: (r["p_on"], r["p_off"]) for r in D.p_waves(m, b, r, FS).collect()}


def test_p_waves_are_those_of_brute_force(spark, magnitudes):
    want = {k: found for k, x, on, rr in magnitudes if (found := brute_p(x, on, rr))}
    got = p_rows(spark, magnitudes)
    assert got == want and 20 < len(want) < len(magnitudes)


def test_two_humps_of_one_wave_and_flat_lines(spark):
    t = np.arange(400)
    two = 0.2 * np.exp(-((t - 150) ** 2) / 72) + 0.2 * np.exp(-((t - 178) ** 2) / 72)
    cases = [(1, two.tolist(), 240, 800.0), (2, [0.0] * 400, 240, 800.0), (3, (0.2 * np.exp(-((t - 150) ** 2) / 450)).tolist(), 240, 800.0)]
    got = p_rows(spark, cases)
    assert set(got) == {1, 3} and got[1][0] < 140 and got[1][1] > 185
    assert got[3][0] < 150 < got[3][1]


def test_refined_peaks(spark):
    rng = np.random.default_rng(3)
    rows, peaks, want = [], [], {}
    n = int(0.12 * FS) | 1
    for k in range(6):
        x = rng.normal(0, 0.1, 500).cumsum() * 0.2 + np.where(np.arange(500) % 170 == 60 + k, 3.0, 0)
        mean = [x[max(0, i - n // 2) : i + n // 2 + 1].mean() for i in range(500)]
        level, found = np.median(x), [3, 66, 225, 231, 398, 499]
        apex = set()
        for p in found:
            near = [i for i in range(p - 25, p + 26) if 0 <= i < 500]
            j = max(near, key=lambda i: (abs(x[i] - mean[i]), -i))
            apex.add(max([i for i in range(j - 12, j + 13) if 0 <= i < 500], key=lambda i: (abs(x[i] - level), -i)))
        want[k] = sorted(apex)
        rows += [(k, i, float(v)) for i, v in enumerate(x)]
        peaks += [(k, p) for p in found]
    got = B.refined(spark.createDataFrame(rows, "record_id long, i int, mv double"), spark.createDataFrame(peaks, "record_id long, peak int"), FS)
    assert {k: sorted(r["peak"] for r in got.where(f"record_id = {k}").collect()) for k in want} == want


def test_traces_take_the_near_then_the_thin(spark):
    columns = [[(10, 3)], [(40, 1), (11, 2)], [], [(12, 3), (12, 1)], [(13, 1)], [(200, 1)]]
    rows = [("a", x, float(c), h) for x, found in enumerate(columns) for c, h in found] + [("b", 0, 1.0, 1)]
    clusters = spark.createDataFrame(rows, "record_id string, x int, centre double, thickness int")
    widths = spark.createDataFrame([("a", 6, 9.0), ("b", 6, 1.0), ("c", 6, 1.0)], "record_id string, width int, base double")
    got = Y.traces(clusters, ["record_id"], widths, slew=70, least=4).orderBy("x").collect()
    assert [(r["record_id"], r["x"], r["y"]) for r in got] == [("a", x, y) for x, y in enumerate([10, 11, 11.5, 12, 13, 13])]
    assert all(abs(r["coverage"] - 4 / 6) < 1e-9 for r in got)
    free = Y.traces(clusters, ["record_id"], widths, slew=None, least=4).orderBy("x").collect()
    assert [r["y"] for r in free] == [10, 11, 11.5, 12, 13, 200]
    assert Y.traces(clusters, ["record_id"], widths.drop("base"), least=9).count() == 0
