"""Queries on connected ink, whole pages as pixels, nearest rows and gaps of maps, with their SQL twins.

Each user's events draw the ink and the pages: event i is column i.
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.operators import compare as C
from pulsegrid.operators import layout as Y
from pulsegrid.operators import nearest as J
from pulsegrid.operators import pixels as P
from pulsegrid.operators import shapes as S
from pulsegrid.plans.queries import _GRIDS, E_SQL, events, query, users
from pulsegrid.plans.roundtrip import round_trip
from pulsegrid.schema import LEADS
from pulsegrid.sources import synthetic

KEYS = ["record_id"]
_V_SQL = "v AS (SELECT user_id AS record_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS x, event_id, event_type, CAST(floor(value) AS INTEGER) % 40 AS a, CAST(floor(value * 7) AS INTEGER) % 40 AS b FROM events)"
_INK_SQL = f"{_V_SQL}, ink AS (SELECT DISTINCT record_id, x, CAST(unnest(range(a, a + 1 + event_id % 11)) AS INTEGER) AS y FROM v UNION SELECT record_id, x, CAST(unnest(range(b, b + 1 + event_id % 5)) AS INTEGER) FROM v)"
_NEAR_SQL = "(SELECT unnest([-1, 0, 1]) AS dx) dx, (SELECT unnest([-1, 0, 1]) AS dy) dy"


def _columns(spark, d):
    e = synthetic.placed(spark.read.parquet(f"{d}/events.parquet"), "user_id", 16)
    x = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    place = lambda v: (F.floor(v).cast("int") % 40).cast("int")
    return e.select(F.col("user_id").alias("record_id"), x.alias("x"), "event_id", "event_type", place(F.col("value")).alias("a"), place(F.col("value") * 7).alias("b"))


def inked(spark, d):
    """Two vertical runs of ink for each event."""
    v = _columns(spark, d)
    run = lambda at, n: v.select("record_id", "x", F.explode(F.sequence(at, (F.col(at) + F.col("event_id") % n).cast("int"))).alias("y"))
    return run("a", 11).unionByName(run("b", 5)).distinct()


# ------------------------------------------------------------------ connected ink

_TIED_SQL = f"""WITH RECURSIVE {_INK_SQL}, k AS (SELECT record_id, x, a AS y FROM v WHERE event_type = 'signup' AND x % 9 = 0
UNION SELECT ink.record_id, ink.x, ink.y FROM k, {_NEAR_SQL}, ink WHERE ink.record_id = k.record_id AND ink.x = k.x + dx AND ink.y = k.y + dy) SELECT record_id, x, y FROM k"""


@query("j15_tied_ink", _TIED_SQL)
def j15(spark, d):
    """Ink connected with the tops of some columns, in eight directions."""
    seeds = _columns(spark, d).where("event_type = 'signup' and x % 9 = 0").select("record_id", "x", F.col("a").alias("y"))
    return S.tied_ink(inked(spark, d), seeds, KEYS)


_SHAPES_SQL = f"""WITH RECURSIVE {_INK_SQL}, c AS (SELECT * FROM ink WHERE x >= 12 + record_id % 5 AND x < 24), k AS (SELECT record_id, x, y, x AS sx, y AS sy FROM c
UNION SELECT c.record_id, c.x, c.y, sx, sy FROM k, {_NEAR_SQL}, c WHERE c.record_id = k.record_id AND c.x = k.x + dx AND c.y = k.y + dy),
n AS (SELECT record_id, x, y, min(struct_pack(x := sx, y := sy)) AS part FROM k GROUP BY 1, 2, 3)
SELECT record_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS area FROM n GROUP BY record_id, part HAVING count(*) >= 12"""


@query("t20_shapes", _SHAPES_SQL)
def t20(spark, d):
    """Boxes and areas of the components between two columns of each record."""
    window = users(spark, d).select("record_id", (12 + F.col("record_id") % 5).cast("int").alias("lo"), F.lit(24).alias("hi"))
    return S.shapes(inked(spark, d), window, KEYS, 12).drop("part")


_WEIGHTS = [math.exp(-o * o / 8.0) for o in range(-8, 9)]
_W_SQL = ", ".join(f"({o}, CAST({w / sum(_WEIGHTS)!r} AS DOUBLE))" for o, w in enumerate(_WEIGHTS, -8))
_PROFILE_SQL = f"""ce AS (SELECT DISTINCT user_id AS record_id, 10 AS x0, 40 AS x1, 4 AS top, 44 AS bottom FROM events), inside AS (SELECT ink.* FROM ink JOIN ce USING (record_id) WHERE x >= x0 AND x < x1 AND y >= top AND y < bottom),
rows_ AS (SELECT record_id, y, count(*) / 30.0 AS c FROM inside GROUP BY 1, 2),
profile AS (SELECT g.record_id, g.y, sum(w * coalesce(c, 0)) AS cover FROM (SELECT record_id, CAST(unnest(range(4, 44)) AS INTEGER) AS y FROM ce) g, (VALUES {_W_SQL}) t(o, w)
  LEFT JOIN rows_ r ON r.record_id = g.record_id AND r.y = CASE WHEN g.y + o < 4 THEN 7 - (g.y + o) WHEN g.y + o > 43 THEN 87 - (g.y + o) ELSE g.y + o END GROUP BY 1, 2)"""


def _cells(spark, d):
    return users(spark, d).select("record_id", F.lit(10).alias("x0"), F.lit(40).alias("x1"), F.lit(4).alias("top"), F.lit(44).alias("bottom"))


@query("t13_weighted_profile", f"WITH {_INK_SQL}, {_PROFILE_SQL} SELECT record_id, y, round(cover, 9) AS cover FROM profile WHERE cover > 0")
def t13_profile(spark, d):
    return S.weighted_profile(inked(spark, d), _cells(spark, d), KEYS).withColumn("cover", F.round("cover", 9))


_EXTENT_SQL = f"""WITH RECURSIVE {_INK_SQL}, {_PROFILE_SQL}, base AS (SELECT record_id, min(struct_pack(c := -round(cover, 9), y := y)).y AS base FROM profile GROUP BY 1),
k AS (SELECT inside.record_id, x, y FROM inside JOIN base USING (record_id) WHERE y = base UNION SELECT i.record_id, i.x, i.y FROM k, {_NEAR_SQL}, inside i WHERE i.record_id = k.record_id AND i.x = k.x + dx AND i.y = k.y + dy),
h AS (SELECT record_id, y, count(*) AS h FROM k GROUP BY 1, 2),
walk AS (SELECT record_id, base, step, base AS y, 0 AS empty, 0 AS last FROM base, (SELECT unnest([-1, 1]) AS step)
  UNION ALL SELECT w.record_id, w.base, step, w.y + step, CASE WHEN coalesce(h, 0) <= 1 THEN empty + 1 ELSE 0 END, CASE WHEN coalesce(h, 0) <= 1 THEN last ELSE abs(w.y + step - base) END FROM walk w LEFT JOIN h ON h.record_id = w.record_id AND h.y = w.y + step WHERE empty < 3 AND w.y + step BETWEEN 0 AND 60),
f AS (SELECT record_id, base, max(CASE WHEN step < 0 THEN last END) AS up, max(CASE WHEN step > 0 THEN last END) AS down FROM walk GROUP BY 1, 2)
SELECT record_id, base, CAST(greatest(4, base - up - greatest(6, floor(0.06 * (up + down)))) AS INTEGER) AS lo, CAST(least(44, base + down + greatest(6, floor(0.06 * (up + down)))) AS INTEGER) AS hi, n FROM f JOIN (SELECT record_id, count(*) AS n FROM k GROUP BY 1) USING (record_id)"""


@query("t13_cell_extents", _EXTENT_SQL)
def t13_extents(spark, d):
    """Level line of each record's cell, the ink connected with it, and how far that reaches."""
    ink_rows = inked(spark, d)
    extents, own = S.cell_extents(ink_rows, _cells(spark, d), ink_rows.limit(0), KEYS)
    return extents.select("record_id", "base", "lo", "hi").join(own.groupBy("record_id").agg(F.count("*").alias("n")), "record_id")


@query("t13_recut")
def t13_recut(spark, d):
    """Cells traced again within their own component; no twin, as the twins of extents and of traces hold its parts."""
    ink_rows = inked(spark, d)
    t = S.recut(ink_rows, _cells(spark, d), ink_rows.limit(0), KEYS)
    return t.groupBy("record_id", "base", "lo", "hi").agg(F.count("y").alias("n"), F.round(F.avg("y"), 6).alias("mean"), F.round(F.max("coverage"), 6).alias("coverage"))


_T19_SQL = f"""WITH {_INK_SQL}, r AS (SELECT record_id, y, count(*) AS c FROM ink WHERE x >= 5 AND x < 85 GROUP BY 1, 2), h AS (SELECT record_id, y, y - row_number() OVER (PARTITION BY record_id ORDER BY y) AS g FROM r WHERE c > 0.15 * 80)
SELECT record_id, CAST((min(y) + max(y) + 1) // 2 AS INTEGER) AS y FROM h GROUP BY record_id, g HAVING count(*) > 1"""


@query("t19_trace_rows", _T19_SQL)
def t19(spark, d):
    """Runs of rows with much ink right of column 5."""
    return S.trace_rows(inked(spark, d), users(spark, d).select("record_id", F.lit(5).alias("hi"), F.lit(120).alias("width")), KEYS, 0.15)


def pulse_pages(spark, d):
    """A page of 96 x 88 pixels for each user: three rows of a pulse and the level line after it, on paper with a pale grid."""
    u = synthetic.placed(users(spark, d), "record_id", 96 * 88)
    xs = synthetic.crossed(u, "at", 96 * 88).select("record_id", (F.col("at") % 96).alias("x"), F.floor(F.col("at") / 96).cast("int").alias("y"))
    up = F.lit(27) - F.col("y") % 28
    high = 10 + F.col("record_id") % 9
    side = (F.col("x").between(8, 9) | F.col("x").between(17, 18)) & (up < high)
    top = F.col("x").between(8, 18) & (up < high) & (up >= high - 4)
    dark = (F.col("y") < 84) & (side | top | ((F.col("x") > 18) & (up < 2)))
    gray = F.when(dark, 30).when((F.col("x") % 6 == 0) | (F.col("y") % 6 == 0), 238).otherwise(250)
    sizes = u.select("record_id", F.lit(96).alias("width"))
    return xs.select("record_id", "x", "y", gray.alias("gray")), sizes


@query("t21_pulse_height", "SELECT DISTINCT user_id AS record_id, CAST(10 + user_id % 9 AS DOUBLE) AS px, CAST(3 AS BIGINT) AS n_rows, 0.0 AS spread_px, 28.0 AS row_pitch_px FROM events")
def t21(spark, d):
    """Heights of the pulses drawn; the twin is what was drawn."""
    return S.find_pulse(*pulse_pages(spark, d)).select("record_id", "px", "n_rows", "spread_px", "row_pitch_px")


# ------------------------------------------------------------------ pages as pixels

_PAGE_SQL = f"{E_SQL}, page AS (SELECT user_id AS record_id, i - 1 AS x, y, (CAST(floor(x) AS INTEGER) + y * 37) % 256 AS gray, max(i) OVER (PARTITION BY user_id) AS width FROM e, (SELECT CAST(unnest(range(12)) AS INTEGER) AS y))"


def pages(spark, d):
    """Pages of 12 rows, a column for each event."""
    columns = events(spark, d, 12)
    rows = synthetic.crossed(columns, "y", 12).select(F.col("user_id").alias("record_id"), (F.col("i") - 1).alias("x"), "y", ((F.floor("x").cast("int") + F.col("y") * 37) % 256).alias("gray"))
    sizes = columns.groupBy(F.col("user_id").alias("record_id")).agg(F.max("i").alias("width")).withColumn("height", F.lit(12))
    return rows, sizes


_OFFSETS = ", ".join(f"({dx}, {dy})" for dy, h in zip(range(-7, 8), P.ellipse_widths(15)) for dx in range(-h, h + 1))
_I14_SQL = f"""WITH {_PAGE_SQL}, o(dx, dy) AS (VALUES {_OFFSETS}), wide AS (SELECT p.record_id, p.x, p.y, max(q.gray) AS g FROM page p, o, page q WHERE q.record_id = p.record_id AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY 1, 2, 3),
paper AS (SELECT p.record_id, p.x, p.y, min(q.g) AS g FROM wide p, o, wide q WHERE q.record_id = p.record_id AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY 1, 2, 3),
c AS (SELECT record_id, page.x, page.y, g - gray AS diff FROM page JOIN paper USING (record_id, x, y)), l AS (SELECT record_id, quantile_cont(diff, 0.995) AS level FROM c GROUP BY 1)
SELECT record_id, k, x, y FROM c JOIN l USING (record_id), (VALUES (CAST(0.45 AS DOUBLE)), (0.6)) t(k) WHERE diff > greatest(10.0, k * level)"""


@query("i14_local_ink", _I14_SQL)
def i14(spark, d):
    """Pixels much darker than the paper around them, for two thresholds."""
    return P.contrast_ink(P.local_contrast(pages(spark, d)[0]), (0.45, 0.6))


_TO = 64
_AREA_SQL = "greatest(0.0, least(({t} + 1) * {n} / CAST({m} AS DOUBLE), {s} + 1.0) - greatest({t} * {n} / CAST({m} AS DOUBLE), CAST({s} AS DOUBLE))) / ({n} / CAST({m} AS DOUBLE))"
_CUBIC_SQL = "CASE WHEN d <= 1 THEN ((1.25 * d - 2.25) * d) * d + 1 WHEN d < 2 THEN ((-0.75 * d + 3.75) * d - 6.0) * d + 3.0 ELSE 0.0 END"


def _taps_sql(name, n, m):
    return f"""{name} AS (SELECT record_id, t, greatest(0, least({n} - 1, b + k)) AS s, {_CUBIC_SQL} AS w FROM (SELECT record_id, {n}, t, k, CAST(floor(c) AS INTEGER) AS b, abs(c - (floor(c) + k)) AS d FROM (SELECT record_id, {n}, t, (t + 0.5) * {n} / CAST({m} AS DOUBLE) - 0.5 AS c FROM (SELECT *, CAST(unnest(range({m})) AS INTEGER) AS t FROM large)), (SELECT unnest([-1, 0, 1, 2]) AS k)))"""


_I8_SQL = f"""WITH {_PAGE_SQL}, z AS (SELECT record_id, CAST(max(width) AS INTEGER) AS width, 12 AS height, CASE WHEN abs(max(width) - {_TO}) > 2 THEN CAST({_TO} AS DOUBLE) / max(width) ELSE 1.0 END AS stretch FROM page GROUP BY 1),
s AS (SELECT record_id, width, height, CASE WHEN stretch = 1 THEN width ELSE {_TO} END AS tw, CAST(round_even(height * stretch, 0) AS INTEGER) AS th FROM z), large AS (SELECT * FROM s WHERE tw > width),
{_taps_sql("tx", "width", "tw")}, {_taps_sql("ty", "height", "th")},
small AS (SELECT s.*, ux.tx, uy.ty FROM s, (SELECT CAST(unnest(range({_TO})) AS INTEGER) AS tx) ux, (SELECT CAST(unnest(range(24)) AS INTEGER) AS ty) uy WHERE tw < width AND uy.ty < th),
r AS (SELECT record_id, x, y, CAST(gray AS DOUBLE) AS g FROM page JOIN s USING (record_id) WHERE tw = s.width
UNION ALL SELECT p.record_id, tx.t, ty.t, sum(gray * tx.w * ty.w) FROM page p JOIN tx ON tx.record_id = p.record_id AND tx.s = p.x JOIN ty ON ty.record_id = p.record_id AND ty.s = p.y GROUP BY 1, 2, 3
UNION ALL SELECT a.record_id, tx, ty, sum(gray * {_AREA_SQL.format(t="tx", s="p.x", n="a.width", m="tw")} * {_AREA_SQL.format(t="ty", s="p.y", n="height", m="th")}) FROM small a JOIN page p ON p.record_id = a.record_id AND p.x + 1 > tx * a.width / CAST(tw AS DOUBLE) AND p.x < (tx + 1) * a.width / CAST(tw AS DOUBLE) GROUP BY 1, 2, 3)
SELECT record_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(g, 4) AS gray FROM r"""


@query("i8_resize", _I8_SQL)
def i8(spark, d):
    """Pages brought to one width: some made narrower by means, some wider by cubic taps, some left."""
    rows, sizes = pages(spark, d)
    return P.resized(rows, P.stretched(sizes, _TO)).withColumn("gray", F.round("gray", 4))


@query("s2_eight_bit", f"WITH {E_SQL}, m AS (SELECT user_id AS record_id, i, x, min(x) OVER (PARTITION BY user_id) AS lo, max(x) OVER (PARTITION BY user_id) AS hi FROM e) SELECT record_id, i, CAST(CASE WHEN hi > lo THEN floor((x - lo) * 255.0 / (hi - lo)) ELSE 0 END AS INTEGER) AS stretched, CAST(floor(floor(x * 100) / 257) AS INTEGER) AS sixteen FROM m")
def s2(spark, d):
    """Values as a page of unknown depth, and as one of 16 bits."""
    rows = events(spark, d).select(F.col("user_id").alias("record_id"), "i", F.col("x").alias("stretched"), F.floor(F.col("x") * 100).alias("sixteen"))
    return P.eight_bit(P.eight_bit(rows, "float", "stretched"), "uint16", "sixteen")


_N = 64
_SOFT = P._gaussian(4.0)
_SOFT_SQL = ", ".join(f"({o}, CAST({w!r} AS DOUBLE))" for o, w in enumerate(_SOFT, -(len(_SOFT) // 2)))
_MIRROR_SQL = f"least(abs({{0}}) % {2 * _N - 2}, {2 * _N - 2} - abs({{0}}) % {2 * _N - 2})"
_I11_SQL = f"""WITH u AS (SELECT DISTINCT user_id AS record_id FROM events), page AS (SELECT record_id, x, y, CAST(240 - CASE WHEN record_id % 2 = 0 AND (x % 6 = 0 OR y % 6 = 0) THEN 60 ELSE 0 END - (x * 7 + y * 13 + x * y % 5 + record_id) % 11 AS DOUBLE) AS gray FROM u, (SELECT CAST(unnest(range(48)) AS INTEGER) AS x), (SELECT CAST(unnest(range(48)) AS INTEGER) AS y)),
t AS (SELECT t, greatest(0, least(47, CAST(floor(c) AS INTEGER) + k)) AS s, 1 - abs(c - (floor(c) + k)) AS w FROM (SELECT CAST(unnest(range({_N})) AS INTEGER) AS t, (t + 0.5) * 0.75 - 0.5 AS c), (SELECT unnest([0, 1]) AS k)),
q AS (SELECT record_id, a.t AS x, b.t AS y, round_even(sum(gray * a.w * b.w), 0) AS g FROM page, t a, t b WHERE a.s = x AND b.s = y GROUP BY 1, 2, 3),
w(o, w) AS (VALUES {_SOFT_SQL}), m AS (SELECT i, {_MIRROR_SQL.format("i + o")} AS j, sum(w) AS w FROM (SELECT CAST(unnest(range({_N})) AS INTEGER) AS i), w GROUP BY 1, 2),
sx AS (SELECT record_id, m.i AS x, y, sum(g * w) AS s FROM q, m WHERE j = x GROUP BY 1, 2, 3), sxy AS (SELECT record_id, x, m.i AS y, sum(s * w) AS s FROM sx, m WHERE j = y GROUP BY 1, 2, 3),
d AS (SELECT record_id, x, y, g - s AS g FROM q JOIN sxy USING (record_id, x, y)), p AS (SELECT record_id, 'x' AS axis, x AS i, avg(g) AS v FROM d GROUP BY 1, 2, 3 UNION ALL SELECT record_id, 'y', y, avg(g) FROM d GROUP BY 1, 2, 3),
f AS (SELECT record_id, axis, f, sqrt(pow(sum(v * h * cos(f * i * 2 * pi() / {_N})), 2) + pow(sum(v * h * sin(f * i * 2 * pi() / {_N})), 2)) AS a FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * i / {_N - 1}) AS h FROM p), (SELECT unnest(range({_N // 2 + 1})) AS f) GROUP BY 1, 2, 3),
r AS (SELECT record_id, axis, max(CASE WHEN f < 6 THEN 0 ELSE a END) / (quantile_cont(CASE WHEN f < 6 THEN 0 ELSE a END, 0.5) + 1e-9) AS ratio FROM f GROUP BY 1, 2)
SELECT record_id, round(min(ratio), 3) AS ratio, min(ratio) > 12 AS grid FROM r GROUP BY 1"""


@query("i11_grid_presence", _I11_SQL)
def i11(spark, d):
    """Pages with noise, every other one with a grid of six pixels."""
    u = synthetic.placed(users(spark, d), "record_id", 2 * _N * _N)
    xs = synthetic.crossed(u, "at", 48 * 48).select("record_id", (F.col("at") % 48).alias("x"), F.floor(F.col("at") / 48).cast("int").alias("y"))
    line = (F.col("record_id") % 2 == 0) & ((F.col("x") % 6 == 0) | (F.col("y") % 6 == 0))
    gray = 240 - F.when(line, 60).otherwise(0) - (F.col("x") * 7 + F.col("y") * 13 + F.col("x") * F.col("y") % 5 + F.col("record_id")) % 11
    got = P.grid_presence(xs.select("record_id", "x", "y", gray.cast("double").alias("gray")), u.select("record_id", F.lit(48).alias("width"), F.lit(48).alias("height")), _N, 4.0)
    return got.withColumn("ratio", F.round("ratio", 3))


# ------------------------------------------------------------------ nearest rows, gaps of maps

_J8_SQL = """WITH l AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'), r AS (SELECT user_id, epoch_us(ts) AS t, min(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
c AS (SELECT l.*, r.t AS other, value, row_number() OVER (PARTITION BY event_id ORDER BY abs(r.t - l.t), r.t) AS k FROM l LEFT JOIN r ON r.user_id = l.user_id)
SELECT user_id, event_id, t, CAST(CASE WHEN abs(other - t) <= 40000000000 THEN other END AS DOUBLE) AS other_t, CASE WHEN abs(other - t) <= 40000000000 THEN value END AS value FROM c WHERE k = 1"""


@query("j8_nearest_rows", _J8_SQL)
def j8(spark, d):
    """Each error with the purchase of its user that is nearest in time."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    found = J.nearest(e.where("event_type = 'error'").select("user_id", "event_id", "t"), e.where("event_type = 'purchase'").select("user_id", "t", "value"), ["user_id"], "t", "value", 40_000_000_000)
    return found.withColumn("other_t", F.col("other_t").cast("double"))


_MAPS_SQL = f"{E_SQL}, m AS (SELECT user_id AS record_id, i % 2 AS band, i // 2 AS x, y, (CAST(floor(x * 3) AS INTEGER) + y * 11) % 97 / 97.0 AS signal, (CAST(floor(x * 5) AS INTEGER) + y * 7) % 89 / 89.0 AS grid, (CAST(floor(x) AS INTEGER) + y * 5) % 83 / 83.0 AS text FROM e, (SELECT CAST(unnest(range(9)) AS INTEGER) AS y))"
_T35_SQL = f"""WITH {_MAPS_SQL}, c AS (SELECT record_id, band, x, CASE WHEN max(signal) > 0.9 THEN sum(signal * y) / greatest(sum(signal), 1e-6) END AS seen FROM m GROUP BY 1, 2, 3),
n AS (SELECT *, count(seen) OVER (PARTITION BY record_id, band) AS n, last_value(seen IGNORE NULLS) OVER b AS y0, first_value(seen IGNORE NULLS) OVER a AS y1, max(CASE WHEN seen IS NOT NULL THEN x END) OVER b AS x0, min(CASE WHEN seen IS NOT NULL THEN x END) OVER a AS x1 FROM c
  WINDOW b AS (PARTITION BY record_id, band ORDER BY x ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY record_id, band ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT record_id, band, x, CAST(floor(coalesce(y0 + (y1 - y0) * (x - x0) / CAST(x1 - x0 AS DOUBLE), y0, y1)) AS INTEGER) AS mid FROM n WHERE n >= 10 AND seen IS NULL),
b AS (SELECT g.record_id, g.band, g.x, max(signal) AS s, max(grid) AS g, max(text) AS t FROM g JOIN m ON m.record_id = g.record_id AND m.band = g.band AND m.x = g.x AND m.y BETWEEN mid - 3 AND mid + 3 GROUP BY 1, 2, 3)
SELECT k.record_id, k.band, round(k.gap, 9) AS gap, round(avg(s), 9) AS signal, round(avg(g), 9) AS grid, round(avg(t), 9) AS text FROM (SELECT record_id, band, avg(CASE WHEN seen IS NULL THEN 1.0 ELSE 0.0 END) AS gap FROM n WHERE n >= 10 GROUP BY 1, 2) k LEFT JOIN b ON b.record_id = k.record_id AND b.band = k.band GROUP BY 1, 2, 3"""


@query("t35_gap_diagnostics", _T35_SQL)
def t35(spark, d):
    """Two bands of nine rows for each user, a column for each event."""
    e = synthetic.crossed(events(spark, d, 9), "y", 9)
    level = lambda a, b, n: (F.floor(F.col("x") * a).cast("int") + F.col("y") * b) % n / float(n)
    maps = e.select(F.col("user_id").alias("record_id"), (F.col("i") % 2).alias("band"), F.floor(F.col("i") / 2).cast("int").alias("at"), "y", level(3, 11, 97).alias("signal"), level(5, 7, 89).alias("grid"), level(1, 5, 83).alias("text"))
    got = J.gap_diagnostics(maps.withColumnRenamed("at", "x"), ["record_id", "band"], 0.9)
    return got.select("record_id", "band", *[F.round(c, 9).alias(c) for c in ("gap", "signal", "grid", "text")])


@query("v9_round_trip", f"SELECT record_id, layout, CAST(cells AS INTEGER) AS cells, CAST(strips AS INTEGER) AS strips, TRUE AS covered, TRUE AS near FROM (SELECT DISTINCT user_id AS record_id FROM events), (VALUES {', '.join(map(str, _GRIDS))}) t(layout, cells, strips)")
def v9(spark, d):
    """Each user's signal drawn in every layout and traced again; the twin is what was drawn."""
    got = round_trip(synthetic.signals(users(spark, d), 24, 240, LEADS, times=8))
    return got.select("record_id", "layout", "cells", "strips", (F.col("coverage") > 0.9).alias("covered"), (F.col("near") > 0.9).alias("near"))


# ------------------------------------------------------------------ crops, masks, reports


@query("p19_crop_and_fill", f"WITH {_PAGE_SQL}, b AS (SELECT record_id, CAST(record_id % 7 AS INTEGER) - 4 AS x0, CAST(record_id % 5 AS INTEGER) - 2 AS y0, CAST(max(width) AS INTEGER) - 10 AS x1 FROM page GROUP BY 1), g AS (SELECT *, CAST(unnest(range(x0, x1)) AS INTEGER) AS x FROM b), h AS (SELECT *, CAST(unnest(range(y0, 14)) AS INTEGER) AS y FROM g) SELECT h.record_id, h.x - x0 AS x, h.y - y0 AS y, coalesce(gray, 250) AS gray FROM h LEFT JOIN page p ON p.record_id = h.record_id AND p.x = h.x AND p.y = h.y")
def p19(spark, d):
    """Boxes that leave the page on two or three sides."""
    rows, sizes = pages(spark, d)
    box = sizes.select("record_id", ((F.col("record_id") % 7).cast("int") - 4).alias("x0"), (F.col("width") - 10).alias("x1"), ((F.col("record_id") % 5).cast("int") - 2).alias("y0"), F.lit(14).alias("y1"))
    return P.cropped(rows, box, 250)


@query("s15_ink_of_masks", f"WITH {_PAGE_SQL} SELECT record_id, x, y FROM page WHERE CASE WHEN record_id % 3 = 0 THEN (gray * 3) % 256 > 127 ELSE gray < 90 END")
def s15(spark, d):
    """Every third page comes with a mask; the ink of the others is what is darker than a level."""
    rows, _ = pages(spark, d)
    masks = rows.where("record_id % 3 = 0").select("record_id", "x", "y", ((F.col("gray") * 3) % 256).alias("mask"))
    return P.ink_of(masks, rows, lambda p: p.where("gray < 90"))


_METRICS = ["corr", "gain", "snr", "rms_uv"]
_A3_SQL = f"""WITH {E_SQL}, m AS (SELECT event_type AS lead, (i % 10) / 10.0 AS coverage, CASE WHEN i % 4 > 0 THEN x / 600 END AS corr, CASE WHEN i % 4 > 0 THEN x / 50 END AS gain, CASE WHEN i % 4 > 0 THEN x / 9 END AS snr, CASE WHEN i % 4 > 0 THEN x * 3 END AS rms_uv, CASE WHEN i % 6 > 0 THEN 0.9 + x / 500 END AS r_amp FROM e)
SELECT lead, count(corr) AS n, round(avg(coverage), 6) AS coverage, round(quantile_cont(corr, 0.5), 6) AS corr, round(quantile_cont(gain, 0.5), 6) AS gain, round(quantile_cont(snr, 0.5), 6) AS snr, round(quantile_cont(rms_uv, 0.5), 6) AS rms_uv, round(quantile_cont(r_amp, 0.5), 6) AS r_amp, round(avg(CASE WHEN abs(r_amp - 1) < 0.05 THEN 1.0 WHEN r_amp IS NOT NULL THEN 0.0 END), 6) AS within FROM m GROUP BY GROUPING SETS ((lead), ())"""


@query("a3_lead_report", _A3_SQL)
def a3(spark, d):
    """Agreement by lead, and over all leads beside it; event types stand for leads."""
    compared = F.when(F.col("i") % 4 > 0, F.col("x"))
    rows = events(spark, d).select(
        F.col("event_type").alias("lead"), ((F.col("i") % 10) / F.lit(10.0)).alias("coverage"), (compared / 600).alias("corr"), (compared / 50).alias("gain"), (compared / 9).alias("snr"), (compared * 3).alias("rms_uv"),
        F.when(F.col("i") % 6 > 0, 0.9 + F.col("x") / 500).alias("r_amp"),
    )
    got = C.lead_report(rows, _METRICS)
    return got.select("lead", "n", *[F.round(c, 6).alias(c) for c in ("coverage", *_METRICS, "r_amp", "within")])


@query("a19_specificity", f"WITH {E_SQL}, r AS (SELECT user_id, i, x > 40 AS had, i % 7 > 0 AS measured, x > 90 AS again FROM e) SELECT count(*) AS total, count(*) FILTER (again) AS false, round(count(*) FILTER (again) / CAST(greatest(count(*), 1) AS DOUBLE), 9) AS share FROM r WHERE had AND measured")
def a19(spark, d):
    """Events stand for records: what was found over 40, is erased, and found again over 90; every seventh cannot be measured again."""
    e = events(spark, d).withColumn("key", F.concat_ws("/", "user_id", "i"))
    before, after = e.select("key", F.when(F.col("x") > 40, F.col("x")).alias("p")), e.where("i % 7 > 0").select("key", F.when(F.col("x") > 90, F.col("x")).alias("p"))
    return C.specificity(before, after, "key", "p").withColumn("share", F.round("share", 9))


_A21_SQL = f"""WITH {E_SQL}, t AS (SELECT user_id, count(*) FILTER (x > 75) AS n FROM e GROUP BY 1), g AS (SELECT v, user_id, i, i - row_number() OVER (PARTITION BY v, user_id ORDER BY i) AS g FROM e, (VALUES (CAST(50.0 AS DOUBLE)), (75.0), (120.0)) t(v) WHERE x > v),
m AS (SELECT v, user_id, count(DISTINCT g) AS n FROM g GROUP BY 1, 2), d AS (SELECT v, m.n - t.n AS e FROM m JOIN t USING (user_id))
SELECT v AS value, count(*) AS n, round(quantile_cont(e, 0.5), 6) AS bias, round(quantile_cont(abs(e), 0.5), 6) AS med_abs, round(quantile_cont(abs(e), 0.9), 6) AS p90_abs FROM d GROUP BY 1"""


@query("a21_parameter_grid", _A21_SQL)
def a21(spark, d):
    """A threshold's values by how far the number of stretches over it is from the number of values over 75."""
    e = events(spark, d)

    def stretches(value):
        over = e.where(F.col("x") > value)
        island = F.col("i") - F.row_number().over(Window.partitionBy("user_id").orderBy("i"))
        return over.withColumn("g", island).groupBy("user_id").agg(F.count_distinct("g").alias("n"))

    got = C.parameter_grid(stretches, [50.0, 75.0, 120.0], e.groupBy("user_id").agg(F.count_if(F.col("x") > 75).alias("n")), "user_id", "n")
    return got.select("value", "n", *[F.round(c, 6).alias(c) for c in ("bias", "med_abs", "p90_abs")])


_T15_SQL = f"""WITH {E_SQL}, m AS (SELECT user_id AS record_id, i - 1 AS p, -(x - quantile_cont(x, 0.5) OVER (PARTITION BY user_id)) / (10.0 * (3 + user_id % 3)) AS mv, count(*) OVER (PARTITION BY user_id) AS n FROM e),
wide AS (SELECT record_id, p, mv FROM m UNION ALL SELECT record_id, -1 - p, mv FROM m WHERE p < 12 UNION ALL SELECT record_id, 2 * n - 1 - p, mv FROM m WHERE p >= n - 12),
r AS (SELECT record_id, p, mv, quantile_cont(mv, 0.5) OVER (PARTITION BY record_id ORDER BY p ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS med FROM wide),
h AS (SELECT r.record_id, r.p, least(3.0, greatest(-3.0, r.mv - med)) AS a, n FROM r JOIN m ON m.record_id = r.record_id AND m.p = r.p),
g AS (SELECT DISTINCT record_id, n, CAST(unnest(range(100 + 40 * (record_id % 2))) AS INTEGER) AS j FROM m), t AS (SELECT *, j * (n - 1) / CAST(99 + 40 * (record_id % 2) AS DOUBLE) AS mid FROM g)
SELECT t.record_id, j, round(a.a + (coalesce(b.a, a.a) - a.a) * (mid - floor(mid)), 9) AS mv FROM t JOIN h a ON a.record_id = t.record_id AND a.p = floor(mid) LEFT JOIN h b ON b.record_id = t.record_id AND b.p = floor(mid) + 1"""


@query("t15_digitised", _T15_SQL)
def t15(spark, d):
    """Values as heights of a trace, a column for each event, at 40 samples a second."""
    trace = events(spark, d).select(F.col("user_id").alias("record_id"), (F.col("i") - 1).alias("at"), F.col("x").alias("y"), (2.5 + F.col("user_id") % 2).alias("seconds"), (3.0 + F.col("user_id") % 3).alias("mm_px"))
    return Y.digitised(trace.withColumnRenamed("at", "x"), ["record_id"], 40, "seconds", "mm_px").withColumn("mv", F.round("mv", 9))
