"""Constants and row types of the engine, in one place."""

from __future__ import annotations

from pyspark.sql import types as T

# Lead names and order, limb leads as combinations of I and II.
LEADS = ["I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6"]
INDEPENDENT = ["I", "II", "V1", "V2", "V3", "V4", "V5", "V6"]
LIMB = {"I": (1.0, 0.0), "II": (0.0, 1.0), "III": (-1.0, 1.0), "aVR": (-0.5, -0.5), "aVL": (1.0, -0.5), "aVF": (-0.5, 1.0)}

# Paper scale and measurement thresholds (milliseconds, millivolts, shares).
MM_PER_S, MM_PER_MV = 25.0, 10.0
RR_SECONDS = (0.3, 2.0)
REGULAR_SPREAD = 0.12
QRS = {"k_on": 0.045, "k_off": 0.12, "hold_ms": 25.0, "core_ms": 70, "before_ms": 120, "after_ms": 160, "least_ms": 40, "most_ms": 260}
P_WAVE = {"k": 0.12, "least_mv": 0.04, "snr": 2.0, "leads": 2, "coupling": 0.55, "join_ms": 100, "foot_ms": 150, "least_ms": 40, "most_ms": 220}
T_WAVE = {"end_ms": 16.0, "tachy_rr": 825.0, "tachy_k": 0.12, "tachy_most": 26.0, "least_mv": 0.10, "share": 0.35}
QTC_RANGE = (300.0, 600.0)
SOKOLOW_MM = 35.0
QRS_SHARE = 0.35

#: Tolerances (ms, degrees) of comparisons with reference annotations.
TOLERANCE = {"p_ms": 20.0, "pr_ms": 20.0, "qrs_ms": 12.0, "qt_ms": 25.0, "axis_qrs": 15.0, "axis_p": 25.0, "axis_t": 25.0}

#: Page layouts; a row of equal leads in several columns is a rhythm strip.
_TWELVE = [["I", "aVR", "V1", "V4"], ["II", "aVL", "V2", "V5"], ["III", "aVF", "V3", "V6"]]
_SIX = [["I", "V1"], ["II", "V2"], ["III", "V3"], ["aVR", "V4"], ["aVL", "V5"], ["aVF", "V6"]]
LAYOUTS = {
    "3x4": _TWELVE,
    "3x4_1R": [*_TWELVE, ["II"] * 4],
    "3x4_3R": [*_TWELVE, ["V1"] * 4, ["II"] * 4, ["V5"] * 4],
    "6x2": _SIX,
    "6x2_1R": [*_SIX, ["II"] * 2],
    "12x1": [[lead] for lead in LEADS],
}
PAPER_SECONDS = 10.0
#: Layouts told apart by their number of rows.
AUTO_LAYOUTS = {4: "3x4_1R", 7: "6x2_1R", 12: "12x1"}

SIGNAL = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("lead", T.StringType()),
        T.StructField("fs", T.IntegerType()),
        T.StructField("samples", T.ArrayType(T.DoubleType())),
    ]
)
DISCLAIMER = "Demonstration and research tool, not a medical device."
