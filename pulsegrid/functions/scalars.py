"""Column expressions of measurement and reporting."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.schema import QTC_RANGE, SOKOLOW_MM, T_WAVE


def samples_of(ms, fs) -> Column:
    """Milliseconds as samples, halves to even."""
    return F.bround(F.lit(ms) * F.lit(fs) / 1000.0 if not isinstance(ms, Column) else ms * fs / 1000.0).cast("int")


def axis_degrees(i: Column, avf: Column) -> Column:
    """Frontal axis of net deflections in I and aVF; null without a deflection."""
    y = avf / F.lit(math.sqrt(3) / 2)
    return F.when((F.abs(i) < 1e-9) & (F.abs(y) < 1e-9), F.lit(None)).otherwise(F.degrees(F.atan2(y, i)))


def axis_word(a: Column) -> Column:
    return (
        F.when(a.isNull(), F.lit(None).cast("string"))
        .when(a.between(-30, 90), "normal")
        .when((a >= -90) & (a < -30), "left deviation")
        .when((a > 90) & (a <= 180), "right deviation")
        .otherwise("extreme")
    )


def arc_difference(u: Column, v: Column) -> Column:
    """u - v on the shortest arc, in [-180, 180)."""
    return F.pmod(u - v + 180.0, F.lit(360.0)) - 180.0


def corrected_qt(qt: Column, rr_ms: Column) -> Column:
    """QT corrected for rate by four formulas."""
    rr = rr_ms / 1000.0
    return F.struct(
        (qt / F.sqrt(rr)).alias("bazett"),
        (qt / F.pow(rr, F.lit(1 / 3))).alias("fridericia"),
        (qt + 154.0 * (1 - rr)).alias("framingham"),
        (qt + 1.75 * (60.0 / rr - 60.0)).alias("hodges"),
    )


def t_end_shift_ms(rr_ms: Column) -> Column:
    """What is added to the tangent's end of T, at this rate."""
    extra = F.least(F.lit(T_WAVE["tachy_most"]), F.greatest(F.lit(0.0), T_WAVE["tachy_k"] * (T_WAVE["tachy_rr"] - rr_ms)))
    return F.lit(T_WAVE["end_ms"]) - extra


def sokolow(s_v1: Column, r_v5: Column, r_v6: Column) -> Column:
    """Voltage index in mm: depth of S in V1 plus the higher of R in V5 and V6 (V6 on a tie)."""
    lateral = F.greatest(F.struct(r_v5.alias("v"), F.lit("V5").alias("lead")), F.struct(r_v6.alias("v"), F.lit("V6").alias("lead")))
    chosen = F.when(r_v5.isNull(), F.struct(r_v6.alias("v"), F.lit("V6").alias("lead"))).when(r_v6.isNull(), F.struct(r_v5.alias("v"), F.lit("V5").alias("lead"))).otherwise(lateral)
    r = F.greatest(chosen["v"], F.lit(0.0))
    mm = (F.abs(s_v1) + r) * 10.0
    return F.when(
        s_v1.isNotNull() & chosen["v"].isNotNull(),
        F.struct(mm.alias("mm"), chosen["lead"].alias("lead"), (mm >= SOKOLOW_MM).alias("over"), (F.abs(s_v1) * 10.0).alias("s_v1_mm"), (r * 10.0).alias("r_mm")),
    )


def st_state(lead: Column, mm: Column) -> Column:
    """Shift of the ST level of a lead, at J+60."""
    up = F.when(lead.isin("V2", "V3"), 2.0).otherwise(1.0)
    return F.when(mm.isNull(), "na").when(mm >= up, "up").when(mm <= -1.0, "down").otherwise("ok")


def tile(value: Column, low: Column, high: Column, floor: Column, ceiling: Column) -> Column:
    """State against a norm band, and place on its scale, clamped to [0, 1]."""
    place = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - floor) / (ceiling - floor)))
    state = F.when(value.isNull(), "na").when(value < low, "low").when(value > high, "high").otherwise("ok")
    return F.struct(state.alias("state"), place.alias("place"))


def flags(qt_ms: Column, bazett: Column, pr_ms: Column, n_beats: Column, n_leads: Column) -> Column:
    """Which measurements are not to be trusted."""
    return F.array_compact(
        F.array(
            F.when(qt_ms.isNull(), "t").when(~bazett.between(*QTC_RANGE), "qt"),
            F.when(pr_ms.isNull(), "p"),
            F.when(n_beats < 3, "beats"),
            F.when(n_leads < 6, "leads"),
        )
    )


def problems(px_per_mm: Column, row_coverage: Column, layout_cost: Column, pulse_applied: Column, pulse_agrees: Column, residual: Column) -> Column:
    """Quality problems of a digitised page, as (level, what)."""
    one = lambda level, what: F.struct(F.lit(level).alias("level"), F.lit(what).alias("what"))
    return F.array_compact(
        F.array(
            F.when(px_per_mm < 6, one("red", "resolution")).when(px_per_mm < 8, one("warn", "resolution")),
            F.when(row_coverage < 0.85, one("warn", "row coverage")),
            F.when(layout_cost > 1, one("red", "layout")).when(layout_cost > 0.3, one("warn", "layout")),
            F.when(pulse_applied, one("warn", "scale corrected")).when(~pulse_agrees, one("red", "scale disagrees")),
            F.when(residual.isNull(), one("red", "leads unverified")).when(residual > 0.15, one("red", "leads inconsistent")),
        )
    )


def shown(value: Column, digits: int = 0) -> Column:
    """A number as text, a dash for null."""
    return F.coalesce(F.format_number(value, digits), F.lit("—"))


def lead_name(raw: Column) -> Column:
    """Upper case but for the augmented leads."""
    up = F.upper(F.trim(raw))
    return F.when(up.isin("AVR", "AVL", "AVF"), F.concat(F.lit("aV"), F.substring(up, 3, 1))).otherwise(up)


def content_key(content: Column, model: str) -> Column:
    """Cache key of an image under a model: 16 hex digits of a SHA-1."""
    return F.substring(F.sha1(F.concat(content, F.lit(f"|{model}").cast("binary"))), 1, 16)
