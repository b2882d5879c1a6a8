"""A trace followed through columns that arrive in batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STATE = "x long, height double, gap long"


class _Follow(StatefulProcessor):
    """Carries, for one line, the last column seen, the height reached and the columns left out since a point was taken."""

    def __init__(self, slew: float | None, idle_ms: int):
        self.slew, self.idle_ms = slew, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("reached", _STATE, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        clusters = pd.concat(list(rows)).sort_values(["x", "thickness", "centre"])
        if self.state.exists():
            last, height, gap = self.state.get()
        else:
            last, height, gap = None, float(clusters["base"].iloc[0]), 0
        out = []
        for x, column in clusters.groupby("x", sort=True):
            if last is not None and x <= last:
                continue
            gap += 0 if last is None else int(x) - last - 1
            off, _, centre = min((abs(c - height), t, c) for c, t in zip(column["centre"], column["thickness"]))
            if self.slew is None or off <= self.slew:
                out.append((int(x), float(centre), int(gap)))
                height, gap = float(centre), 0
            else:
                gap += 1
            last = int(x)
        if last is not None:
            self.state.update((last, height, gap))
        yield pd.DataFrame([(*key, *o) for o in out], columns=["record_id", "lead", "x", "y", "gap"])

    def close(self) -> None:
        pass


def followed(clusters: DataFrame, slew: float | None = 70.0, idle_ms: int = 3_600_000) -> DataFrame:
    """record_id, lead, x, y, gap: the points that traces() takes, from a stream of column clusters (record_id, lead, x, centre, thickness, base).

    However the columns are cut into batches, the points are the same, as long
    as a column's clusters come together and columns in order; what comes at or
    before the last column seen is left out.  gap counts the columns without a
    point before each point.  A line begins at the base of its first column; its state goes
    when nothing has come for idle_ms.  A batch of one line is sorted in one
    task.  Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    kind = clusters.schema["record_id"].dataType.simpleString()
    columns = clusters.select("record_id", "lead", "x", "centre", "thickness", "base")
    return columns.groupBy("record_id", "lead").transformWithStateInPandas(
        statefulProcessor=_Follow(slew, idle_ms), outputStructType=f"record_id {kind}, lead string, x int, y double, gap long", outputMode="Append", timeMode="ProcessingTime"
    )
