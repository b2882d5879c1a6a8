"""Measurements on representative beats: long rows (record_id, lead, i, mv), i counted from the beat's start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import axis_degrees, corrected_qt, flags, sokolow, t_end_shift_ms
from pulsegrid.functions.series import despike, moving_average
from pulsegrid.schema import INDEPENDENT, P_WAVE, QRS, QRS_SHARE, T_WAVE
from pulsegrid.tables import materialise


def _ms(v: float, fs: int) -> int:
    return int(round(v * fs / 1000.0))


def spatial_velocity(beats: DataFrame, fs: int, smooth_ms: float = 12, spikes: bool = True) -> DataFrame:
    """record_id, i, sv: length of the slope vector over the independent leads, smoothed; all leads if fewer than two of those."""
    counts = beats.groupBy("record_id").agg(F.size(F.collect_set(F.when(F.col("lead").isin(INDEPENDENT), F.col("lead")))).alias("_n"))
    rows = beats.join(counts, "record_id").where((F.col("_n") < 2) | F.col("lead").isin(INDEPENDENT))
    key = ["record_id", "lead"]
    if spikes:
        rows = rows.withColumn("mv", despike("mv", key, "i", _ms(10, fs)))
    w = Window.partitionBy(*key).orderBy("i")
    rows = rows.withColumn("_d", F.coalesce(F.col("mv") - F.lag("mv").over(w), F.lit(0.0)))
    total = rows.groupBy("record_id", "i").agg(F.sqrt(F.sum(F.col("_d") * F.col("_d"))).alias("v"))
    return total.select("record_id", "i", moving_average("v", ["record_id"], "i", max(1, _ms(smooth_ms, fs))).alias("sv"))


def qrs_bounds(sv: DataFrame, r: int, fs: int) -> DataFrame:
    """record_id, qrs_on, qrs_off: where the velocity falls below a share of its peak and stays there, within limits."""
    w = Window.partitionBy("record_id")
    core, hold = _ms(QRS["core_ms"], fs), _ms(QRS["hold_ms"], fs)
    rows = sv.withColumn("n", F.max("i").over(w) + 1)
    inside = F.col("i").between(max(0, r - core), r + core - 1)
    rows = rows.withColumn("p", F.min(F.when(inside, F.struct((-F.col("sv")).alias("v"), "i"))).over(w))
    rows = rows.withColumn("peak_i", F.col("p.i")).withColumn("peak", -F.col("p.v")).drop("p")
    rows = rows.withColumn("noise", F.coalesce(F.percentile(F.when(F.col("i") >= F.col("n") - _ms(60, fs), F.col("sv")), F.lit(0.5)).over(w), F.lit(0.0)))
    order = w.orderBy("i")
    cap = F.col("peak") * 0.5

    def level(k: float) -> Column:
        return F.least(cap, F.greatest(F.lit(k) * F.col("peak"), 1.5 * F.col("noise")))

    before = (F.col("i") <= F.col("peak_i")) & (F.col("sv") < level(QRS["k_on"])) & (F.coalesce(F.max("sv").over(order.rowsBetween(-hold, -1)), F.lit(-1.0)) < level(QRS["k_on"]))
    after = (F.col("i") >= F.col("peak_i")) & (F.max("sv").over(order.rowsBetween(0, hold - 1)) < level(QRS["k_off"]))
    rows = rows.withColumn("before", before).withColumn("after", after)
    far_on, far_off = F.greatest(F.lit(0), F.col("peak_i") - _ms(QRS["before_ms"], fs)), F.least(F.col("n"), F.col("peak_i") + _ms(QRS["after_ms"], fs))
    quiet = lambda where: F.min(F.when(where, F.struct("sv", "i")))["i"]
    found = rows.groupBy("record_id").agg(
        F.first("peak_i").alias("peak_i"),
        F.coalesce(F.max(F.when(F.col("before"), F.col("i"))), F.lit(0)).alias("on"),
        F.coalesce(F.min(F.when(F.col("after"), F.col("i"))), F.first("n") - 1).alias("off"),
        quiet((F.col("i") >= far_on) & (F.col("i") < F.col("peak_i"))).alias("quiet_on"),
        quiet((F.col("i") >= F.col("peak_i")) & (F.col("i") < far_off)).alias("quiet_off"),
    )
    on = F.when(F.col("on") < F.col("peak_i") - _ms(QRS["before_ms"], fs), F.coalesce("quiet_on", "on")).otherwise(F.col("on"))
    off = F.when(F.col("off") > F.col("peak_i") + _ms(QRS["after_ms"], fs), F.coalesce("quiet_off", "off")).otherwise(F.col("off"))
    return found.select("record_id", on.cast("int").alias("qrs_on"), off.cast("int").alias("qrs_off"))


def misaligned(beats: DataFrame, bounds: DataFrame, fs: int) -> DataFrame:
    """record_id, lead of the leads in which the complex isn't among the fastest movements; none if fewer than four good ones are left."""
    key = ["record_id", "lead"]
    w = Window.partitionBy(*key).orderBy("i")
    rows = beats.withColumn("_d", F.abs(F.coalesce(F.col("mv") - F.lag("mv").over(w), F.lit(0.0))))
    rows = rows.withColumn("env", moving_average("_d", key, "i", _ms(16, fs))).withColumn("n", F.count("*").over(Window.partitionBy(*key)))
    rows = rows.join(bounds, "record_id").where((F.col("i") >= _ms(50, fs)) & (F.col("i") < F.col("n") - _ms(50, fs)))
    share = rows.groupBy(*key).agg(F.max("env").alias("all"), F.max(F.when((F.col("i") >= F.col("qrs_on")) & (F.col("i") < F.col("qrs_off")), F.col("env"))).alias("here"))
    share = share.withColumn("bad", (F.col("all") > 1e-12) & (F.coalesce("here", F.lit(0.0)) < QRS_SHARE * F.col("all")))
    good = F.sum((~F.col("bad")).cast("int")).over(Window.partitionBy("record_id"))
    return share.withColumn("good", good).where("bad and good >= 4").select(*key)


def baselines(beats: DataFrame, bounds: DataFrame, fs: int) -> DataFrame:
    """record_id, lead, base: median of the 30 ms before the complex."""
    rows = beats.join(bounds.select("record_id", "qrs_on"), "record_id")
    at = (F.col("i") >= F.greatest(F.lit(0), F.col("qrs_on") - _ms(30, fs))) & (F.col("i") < F.greatest(F.col("qrs_on"), F.lit(1)))
    return rows.where(at).groupBy("record_id", "lead").agg(F.percentile("mv", F.lit(0.5)).alias("base"))


def _based(beats: DataFrame, base: DataFrame) -> DataFrame:
    """beats with base, of the leads that have one.

    A record's baselines, one for each lead, are joined by the record alone:
    samples that lie by record are neither moved nor sorted by lead for it.
    """
    level = F.map_from_entries(F.collect_list(F.struct("lead", "base"))).alias("_base")
    levels = base.where("lead is not null").groupBy("record_id").agg(level).hint("shuffle_hash")
    rows = beats.join(levels, "record_id").where(F.map_contains_key("_base", F.col("lead")))
    return rows.withColumn("base", F.col("_base")[F.col("lead")]).drop("_base")


def p_magnitude(beats: DataFrame, base: DataFrame, fs: int) -> DataFrame:
    """record_id, i, mag: length of the deviation from the baselines over the independent leads, smoothed over 20 ms."""
    rows = _based(beats.where(F.col("lead").isin(INDEPENDENT)), base)
    d = F.col("mv") - F.col("base")
    total = rows.groupBy("record_id", "i").agg(F.sqrt(F.sum(d * d)).alias("m"))
    return total.select("record_id", "i", moving_average("m", ["record_id"], "i", _ms(20, fs)).alias("mag"))


def _stands(hump: Column) -> Column:
    """Whether a hump (top, mag) stands out of its record's rows `part` (i, mag): on each side the magnitude falls by `stand` before it exceeds the top."""
    deep, high = lambda x: hump["mag"] - x["mag"] >= F.col("stand"), lambda x: x["mag"] > hump["mag"]
    left, right = lambda x: x["i"] < hump["top"], lambda x: x["i"] > hump["top"]
    at = lambda side, ok: F.transform(F.filter("part", lambda x: side(x) & ok(x)), lambda x: x["i"])
    held_left = F.array_max(at(left, deep)) > F.coalesce(F.array_max(at(left, high)), F.lit(-1))
    return held_left & (F.array_min(at(right, deep)) < F.coalesce(F.array_min(at(right, high)), F.lit(2**31 - 1)))


def _tops(rows: DataFrame, fs: int) -> DataFrame:
    """record_id, lo, hi, top, near (all rows' i, mag) of rows (record_id, i, mag, lo, hi) around the windows lo to hi - 1 before the complex.

    top is the last hump that stands out, or the last row where the window cuts
    off a rise.  A hump is a flat top (its middle counts) between lower rows.
    A record's rows, of which there are as many as one beat's P can have, become
    one row: nothing is joined to itself.
    """
    whole = Window.partitionBy("record_id", "inside")
    w = whole.orderBy("i")
    n, hold = _ms(40, fs), _ms(20, fs)
    here = w.rowsBetween(-(n - 1), 0)
    rows = rows.withColumn("inside", (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi")))
    rows = rows.withColumn("r", F.max("mag").over(here) - F.min("mag").over(here)).withColumn("rn", F.row_number().over(w))
    rows = rows.withColumn("before", F.lag("mag").over(w)).withColumn("after", F.lead("mag").over(w))
    new = F.coalesce(F.col("mag") != F.col("before"), F.lit(True))
    rows = rows.withColumn("run", F.last(F.when(new, F.struct(F.col("i").alias("a"), F.col("before").alias("l"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hump = F.col("inside") & (F.col("mag") > F.col("run.l")) & (F.col("mag") > F.col("after"))
    at = lambda place: F.max(F.when(F.col("inside") & (F.col("i") == place), F.col("mag")))
    low, top = F.min(F.when(F.col("inside"), F.col("mag"))), F.max(F.when(F.col("inside"), F.col("mag")))
    found = rows.groupBy("record_id", "lo", "hi").agg(
        low.alias("least"), at(F.col("hi") - 1).alias("last"), at(F.col("hi") - 1 - hold).alias("before"),
        F.coalesce(F.min(F.when(F.col("inside") & (F.col("rn") >= n), F.col("r"))), top - low).alias("quiet"),
        F.collect_list(F.when(F.col("inside"), F.struct("i", "mag"))).alias("part"), F.collect_list(F.struct("i", "mag")).alias("near"),
        F.collect_list(F.when(hump, F.struct(F.floor((F.col("run.a") + F.col("i")) / 2).cast("int").alias("top"), "mag"))).alias("humps"),
    ).withColumn("stand", F.greatest(F.lit(P_WAVE["least_mv"]), P_WAVE["snr"] * F.col("quiet")))
    cut_off = F.when((F.col("last") - F.col("least") >= F.col("stand")) & (F.col("last") > F.col("before")), F.col("hi") - 1)
    last = F.array_max(F.transform(F.filter("humps", _stands), lambda h: h["top"]))
    return found.select("record_id", "lo", "hi", F.coalesce(cut_off, last).alias("top"), "near").where("top is not null")


def p_waves(magnitude: DataFrame, bounds: DataFrame, rates: DataFrame, fs: int) -> DataFrame:
    """record_id, p_on, p_off of the records that show a P wave: the last hump of the magnitude before the complex that stands out.

    Its bounds lie where, going outwards, the magnitude first falls below a
    share of the way from the hump's foot on that side to its top.  Going
    outwards, a low is a row not above any row passed.  The foot is the first
    low that is held (no other low within 20 ms) and after which the magnitude
    doesn't rise to half the hump's height within join_ms, which would be a
    second hump of the same wave; without such a low, the last low in reach.
    Windows by record and side only; their rows are those of one beat.  Magnitudes that lie by record stay where they are.
    """
    reach, joined, hold = _ms(P_WAVE["foot_ms"], fs), _ms(P_WAVE["join_ms"], fs), _ms(20, fs)
    ahead_ms = F.bround(F.least(F.lit(340.0), 0.5 * F.col("rr_ms")) * fs / 1000.0).cast("int")
    spans = bounds.join(rates.select("record_id", "rr_ms"), "record_id")
    spans = spans.select("record_id", F.greatest(F.lit(0), F.col("qrs_on") - ahead_ms).alias("lo"), (F.col("qrs_on") - _ms(25, fs)).alias("hi")).where(F.col("hi") - F.col("lo") >= _ms(80, fs))
    around = magnitude.join(spans.hint("shuffle_hash"), "record_id").where((F.col("i") >= F.col("lo") - reach - joined) & (F.col("i") < F.col("hi") + reach + joined))
    rows = _tops(around, fs).select("record_id", "lo", "hi", "top", F.inline("near")).where(F.abs(F.col("i") - F.col("top")) <= reach + joined)
    rows = rows.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("d", (F.col("i") - F.col("top")) * F.col("side")).where("d >= 0")
    key = Window.partitionBy("record_id", "side")
    out = key.orderBy("d")
    end = F.when(F.col("side") < 0, F.least(F.col("top") - F.col("lo"), F.lit(reach))).otherwise(F.least(F.col("hi") - 1 - F.col("top"), F.lit(reach)))
    rows = rows.withColumn("end", end).withColumn("peak", F.max(F.when(F.col("d") == 0, F.col("mag"))).over(key))
    rises = F.when(F.col("side") < 0, F.max("mag").over(out.rowsBetween(1, joined))).otherwise(F.max("mag").over(out.rowsBetween(0, joined - 1)))
    rows = rows.withColumn("rises", F.coalesce(rises >= F.col("mag") + 0.5 * (F.col("peak") - F.col("mag")), F.lit(False)))
    rows = rows.withColumn("low", (F.col("mag") == F.min("mag").over(out)) & (F.col("d") <= F.col("end")))
    # the next low beyond this row
    rows = rows.withColumn("next", F.min(F.when(F.col("low"), F.col("d"))).over(out.rowsBetween(1, Window.unboundedFollowing)))
    held = F.col("low") & (F.coalesce("next", F.lit(2**31 - 1)) > F.col("d") + hold) & (F.col("d") + hold <= F.col("end"))
    rows = rows.withColumn("foot", F.coalesce(F.min(F.when(held & ~F.col("rises"), F.col("d"))).over(key), F.max(F.when(F.col("low"), F.col("d"))).over(key)))
    rows = rows.withColumn("floor", F.max(F.when(F.col("d") == F.col("foot"), F.col("mag"))).over(key))
    under = (F.col("d") < F.col("foot")) & (F.col("mag") < F.col("floor") + P_WAVE["k"] * (F.col("peak") - F.col("floor")))
    sides = rows.groupBy("record_id", "top", "lo", "side").agg(F.coalesce(F.min(F.when(under, F.col("d"))), F.first("foot")).alias("d"))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("top") + s * F.col("d"))).cast("int")
    found = sides.groupBy("record_id", "lo").agg(side(-1).alias("p_on"), side(1).alias("p_off"))
    return found.where((F.col("p_on") > F.col("lo")) & (F.col("p_off") - F.col("p_on")).between(_ms(P_WAVE["least_ms"], fs), _ms(P_WAVE["most_ms"], fs))).select("record_id", "p_on", "p_off")


def p_seen(beats: DataFrame, base: DataFrame, p: DataFrame) -> DataFrame:
    """record_id of the P waves that deviate by 0.04 mV or more in two leads."""
    rows = _based(beats, base).join(p, "record_id").where("i >= p_on and i < p_off")
    seen = rows.groupBy("record_id", "lead").agg(F.max(F.abs(F.col("mv") - F.col("base"))).alias("d")).where(F.col("d") >= P_WAVE["least_mv"])
    return seen.groupBy("record_id").agg(F.count("*").alias("n")).where(F.col("n") >= P_WAVE["leads"]).select("record_id")


def p_coupling(stacks: DataFrame, bounds: DataFrame, p: DataFrame, fs: int) -> DataFrame:
    """record_id, coupling: size of P in the mean beat by its mean size in single beats (record_id, lead, beat, i, mv); median over leads with three beats."""
    rows = stacks.join(bounds.select("record_id", "qrs_on"), "record_id").join(p, "record_id")
    key = ["record_id", "lead", "beat"]
    level = rows.where((F.col("i") >= F.col("qrs_on") - _ms(30, fs)) & (F.col("i") < F.col("qrs_on"))).groupBy(*key).agg(F.percentile("mv", F.lit(0.5)).alias("z"))
    d = rows.where("i >= p_on and i < p_off and mv is not null").join(level, key).withColumn("d", F.col("mv") - F.col("z"))
    single = d.groupBy(*key).agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms")).groupBy("record_id", "lead").agg(F.avg("rms").alias("single"), F.count("*").alias("n"))
    mean = d.groupBy("record_id", "lead", "i").agg(F.avg("d").alias("d")).groupBy("record_id", "lead").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("mean"))
    both = single.join(mean, ["record_id", "lead"]).where("n >= 3 and single >= 1e-9")
    return both.groupBy("record_id").agg(F.percentile(F.col("mean") / F.col("single"), F.lit(0.5)).alias("coupling"))


def t_windows(sv: DataFrame, bounds: DataFrame, rates: DataFrame, p: DataFrame, fs: int) -> DataFrame:
    """record_id, t_lo, t_hi: where to look for T, from the velocity after the complex and before the next P."""
    w = Window.partitionBy("record_id")
    rows = sv.join(bounds, "record_id").join(rates.select("record_id", "rr_ms"), "record_id").join(p, "record_id", "left")
    rows = rows.withColumn("n", F.max("i").over(w) + 1).withColumn("sp", moving_average("sv", ["record_id"], "i", _ms(30, fs)))
    lo = F.col("qrs_off") + _ms(50, fs)
    hi = F.least(F.col("n"), F.col("qrs_off") + F.bround(F.least(F.lit(600.0), 0.68 * F.col("rr_ms")) * fs / 1000.0).cast("int"))
    # a record without P has no next P that could cap the window (greatest() would pass over the null)
    next_p = F.when(F.col("p_on").isNotNull(), F.greatest(lo + _ms(100, fs), F.col("p_on") + F.bround(F.col("rr_ms") * fs / 1000.0).cast("int")))
    hi = F.least(hi, next_p)
    rows = rows.withColumn("lo", lo).withColumn("hi", hi).where(F.col("hi") - F.col("lo") >= _ms(100, fs)).where("i >= lo and i < hi")
    rows = rows.withColumn("floor", F.percentile("sp", F.lit(0.2)).over(w)).withColumn("top", F.min(F.struct((-F.col("sp")).alias("v"), "i")).over(w))
    rows = rows.withColumn("thr", F.col("floor") + 0.25 * (-F.col("top.v") - F.col("floor")))
    below = (F.col("i") >= F.col("top.i")) & (F.max("sp").over(w.orderBy("i").rowsBetween(0, _ms(60, fs) - 1)) < F.col("thr"))
    rows = rows.withColumn("below", below)
    got = rows.groupBy("record_id").agg(F.first("lo").alias("t_lo"), F.first("hi").alias("hi"), F.first("floor").alias("floor"), F.first("top").alias("top"), F.min(F.when(F.col("below"), F.col("i"))).alias("end"))
    got = got.where(-F.col("top.v") >= 1.5 * F.greatest(F.col("floor"), F.lit(1e-12)))
    end = F.coalesce(F.col("end"), F.col("hi") - 1)
    return got.select("record_id", "t_lo", F.least(F.col("hi"), F.greatest(end, F.col("top.i") + _ms(40, fs))).cast("int").alias("t_hi"))


def t_ends(beats: DataFrame, base: DataFrame, windows: DataFrame, fs: int) -> DataFrame:
    """record_id, lead, t_peak, t_end, amp: apex of T and where the tangent at its steepest descent meets the baseline."""
    key = ["record_id", "lead"]
    rows = beats.where(F.col("lead").isin(INDEPENDENT)).withColumn("sm", moving_average("mv", key, "i", _ms(30, fs)))
    w = Window.partitionBy(*key)
    rows = rows.withColumn("slope", F.col("sm") - F.lag("sm").over(w.orderBy("i"))).withColumn("n", F.max("i").over(w) + 1)
    rows = _based(rows, base).join(windows, "record_id")
    apex = F.min(F.when((F.col("i") >= F.col("t_lo")) & (F.col("i") < F.col("t_hi")), F.struct((-F.abs(F.col("mv") - F.col("base"))).alias("v"), "i", (F.col("mv") - F.col("base")).alias("amp")))).over(w)
    rows = rows.withColumn("apex", apex).where(F.col("t_hi") - F.col("t_lo") >= _ms(60, fs))
    tail = (F.col("i") >= F.col("apex.i") + _ms(10, fs)) & (F.col("i") < F.least(F.col("n"), F.col("t_hi") + _ms(40, fs)))
    steep = rows.where(tail).groupBy(*key).agg(
        F.first("apex").alias("apex"), F.first("base").alias("base"), F.first("n").alias("n"), F.count("*").alias("m"),
        F.min(F.struct((F.signum("apex.amp") * F.col("slope")).alias("v"), "i", "slope", "mv")).alias("k"),
    )
    end = F.col("k.i") + (F.col("base") - F.col("k.mv")) / F.col("k.slope")
    steep = steep.where(F.col("m") >= _ms(20, fs)).where(F.abs("k.slope") >= 1e-9).withColumn("end", end)
    steep = steep.where((F.col("end") > F.col("apex.i")) & (F.col("end") < F.col("k.i") + _ms(160, fs)) & (F.col("end") < F.col("n")))
    return steep.select(*key, F.col("apex.i").alias("t_peak"), F.bround("end").cast("int").alias("t_end"), F.col("apex.amp").alias("amp"))


def t_consensus(ends: DataFrame, rates: DataFrame, last: int, fs: int) -> DataFrame:
    """record_id, t_peak, t_off: medians over two or more leads with a T of some size, shifted by rate."""
    big = F.max(F.abs("amp")).over(Window.partitionBy("record_id"))
    kept = ends.withColumn("big", big).where(F.abs("amp") >= F.greatest(F.lit(T_WAVE["least_mv"]), T_WAVE["share"] * F.col("big")))
    med = kept.groupBy("record_id").agg(F.count("*").alias("n"), F.percentile("t_peak", F.lit(0.5)).cast("int").alias("t_peak"), F.percentile("t_end", F.lit(0.5)).cast("int").alias("t_end")).where("n >= 2")
    shift = F.bround(t_end_shift_ms(F.col("rr_ms")) * fs / 1000.0).cast("int")
    return med.join(rates.select("record_id", "rr_ms"), "record_id").select("record_id", "t_peak", F.least(F.col("t_end") + shift, F.lit(last)).alias("t_off"))


def net_deflection(beats: DataFrame, base: DataFrame, spans: DataFrame, tag: str) -> DataFrame:
    """record_id, lead, tag, net: highest plus lowest deviation within spans (record_id, a, b)."""
    rows = _based(beats, base).join(spans, "record_id").where("i >= a and i < b")
    d = F.col("mv") - F.col("base")
    return rows.groupBy("record_id", "lead").agg((F.max(d) + F.min(d)).alias("net")).select("record_id", "lead", F.lit(tag).alias("tag"), "net")


def axes(net: DataFrame) -> DataFrame:
    """record_id, tag, axis from the nets of I and aVF."""
    pair = net.groupBy("record_id", "tag").agg(F.max(F.when(F.col("lead") == "I", F.col("net"))).alias("x"), F.max(F.when(F.col("lead") == "aVF", F.col("net"))).alias("y"))
    return pair.where("x is not null and y is not null").select("record_id", "tag", axis_degrees(F.col("x"), F.col("y")).alias("axis"))


def st_levels(beats: DataFrame, base: DataFrame, bounds: DataFrame, fs: int) -> DataFrame:
    """record_id, lead, j, j60, j80: deviation at the end of the complex and 60 and 80 ms later."""
    rows = _based(beats, base).join(bounds, "record_id")
    at = lambda ms: F.max(F.when(F.col("i") == F.col("qrs_off") + _ms(ms, fs), F.col("mv") - F.col("base")))
    return rows.groupBy("record_id", "lead").agg(at(0).alias("j"), at(60).alias("j60"), at(80).alias("j80"))


def amplitudes(beats: DataFrame, base: DataFrame, bounds: DataFrame, t: DataFrame) -> DataFrame:
    """record_id, lead, r, s, t: extremes within the complex, and the value at the peak of T."""
    rows = _based(beats, base).join(bounds, "record_id").join(t.select("record_id", "t_peak"), "record_id", "left")
    d = F.col("mv") - F.col("base")
    inside = (F.col("i") >= F.col("qrs_on")) & (F.col("i") < F.col("qrs_off"))
    return rows.groupBy("record_id", "lead").agg(F.max(F.when(inside, d)).alias("r"), F.min(F.when(inside, d)).alias("s"), F.max(F.when(F.col("i") == F.col("t_peak"), d)).alias("t"))


def measurements(beats: DataFrame, stacks: DataFrame, rates: DataFrame, r: int, fs: int) -> DataFrame:
    """One row a record: intervals, QTc, axes, ST, amplitudes, voltage index, marks and flags.

    beats: mean beats; stacks: single beats; rates: record_id, rr_ms, n_beats.
    Records whose complex has no plausible width give no row.
    """
    plausible = (F.col("qrs_off") - F.col("qrs_on")).between(_ms(QRS["least_ms"], fs), _ms(QRS["most_ms"], fs))
    bounds = qrs_bounds(spatial_velocity(beats, fs), r, fs).where(plausible)
    bad = materialise(misaligned(beats, bounds, fs), "misaligned")
    good = beats.join(bad, ["record_id", "lead"], "left_anti")
    sv = materialise(spatial_velocity(good, fs), "velocity", long=True)
    bounds = materialise(qrs_bounds(sv, r, fs).where(plausible), "bounds")
    base = materialise(baselines(beats, bounds, fs), "baselines", long=True)
    p = p_waves(p_magnitude(good, base, fs), bounds, rates, fs)
    p = materialise(p, "p-waves")
    p = p.join(p_seen(good, base, p), "record_id", "left_semi")
    loose = p_coupling(stacks.join(bad, ["record_id", "lead"], "left_anti"), bounds, p, fs).where(F.col("coupling") < P_WAVE["coupling"])
    p = materialise(p.join(loose, "record_id", "left_anti"), "p-waves")
    last = beats.agg(F.max("i")).first()[0] or 0
    t = materialise(t_consensus(t_ends(good, base, t_windows(sv, bounds, rates, p, fs), fs), rates, last, fs), "t-waves")
    span = lambda df, a, b: df.select("record_id", F.expr(a).alias("a"), F.expr(b).alias("b"))
    nets = net_deflection(beats, base, span(bounds, "qrs_on", "qrs_off"), "qrs").unionByName(net_deflection(beats, base, span(p, "p_on", "p_off"), "p"))
    nets = nets.unionByName(net_deflection(beats, base, span(bounds.join(t, "record_id"), f"qrs_off + {_ms(60, fs)}", "t_off"), "t"))
    axis = axes(nets).groupBy("record_id").agg(*[F.max(F.when(F.col("tag") == k, F.col("axis"))).alias(f"axis_{k}") for k in ("qrs", "p", "t")])
    st = st_levels(good, base, bounds, fs).groupBy("record_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lead", F.struct("j", "j60", "j80"))))).alias("st"))
    amp = amplitudes(good, base, bounds, t).groupBy("record_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lead", F.struct("r", "s", "t"))))).alias("amp"), F.count("*").alias("n_leads"))
    rows = bounds.join(rates, "record_id").join(p, "record_id", "left").join(t, "record_id", "left").join(axis, "record_id", "left").join(st, "record_id", "left").join(amp, "record_id", "left")
    ms = lambda c: c * 1000.0 / fs
    rows = rows.select(
        "record_id", "rr_ms", (60000.0 / F.col("rr_ms")).alias("hr"), ms(F.col("p_off") - F.col("p_on")).alias("p_ms"), ms(F.col("qrs_on") - F.col("p_on")).alias("pr_ms"),
        ms(F.col("qrs_off") - F.col("qrs_on")).alias("qrs_ms"), ms(F.col("t_off") - F.col("qrs_on")).alias("qt_ms"), "axis_qrs", "axis_p", "axis_t", "st", "amp", "n_beats", "n_leads",
        F.struct("p_on", "p_off", "qrs_on", "qrs_off", "t_peak", "t_off", F.lit(r).alias("r")).alias("marks"),
    )
    qtc = F.when(F.col("qt_ms").isNotNull(), corrected_qt(F.col("qt_ms"), F.col("rr_ms")))
    rows = rows.withColumn("qtc", qtc).withColumn("sokolow", sokolow(F.col("amp")["V1"]["s"], F.col("amp")["V5"]["r"], F.col("amp")["V6"]["r"]))
    return rows.withColumn("flags", flags(F.col("qt_ms"), F.col("qtc.bazett"), F.col("pr_ms"), F.col("n_beats"), F.col("n_leads")))
