"""Goals that run out by a timer in state, without a new row of their key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Ticks that a goal is kept for, and that a row may be late.
KEPT, LATE = 50, 10
OUTPUT = "robot_id int, goal string, since long, until long"


class Expiry(StatefulProcessor):
    """Keeps a robot's goal and one timer for it; a new goal replaces both, a repeated one neither."""

    def __init__(self, kept: int):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.goal = handle.getValueState("goal", "goal string, since long, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        now = sorted((t, g) for frame in rows for t, g in zip(frame["tick"].tolist(), frame["goal"].tolist()) if g is not None)
        held = before = self.goal.get() if self.goal.exists() else None  # every call to the state is a message to the JVM
        for tick, goal in now:
            if held and not held[2] and tick > held[1] + self.kept:  # it ran out between rows of one batch
                out.append((key[0], held[0], held[1], held[1] + self.kept))
                held = (held[0], held[1], True)
            if held is None or held[0] != goal:
                held = (goal, tick, False)
        if held != before:
            self.goal.update(held)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if held and not held[2]:
            self.handle.registerTimer((held[1] + self.kept + 1) * 1000)
        yield pd.DataFrame(out, columns=["robot_id", "goal", "since", "until"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        goal, since, told = self.goal.get()
        rows = [] if told else [(key[0], goal, since, since + self.kept)]
        self.goal.update((goal, since, True))
        yield pd.DataFrame(rows, columns=["robot_id", "goal", "since", "until"])

    def close(self) -> None:
        pass


def expiries(goals: DataFrame, kept: int = KEPT, late: int = LATE) -> DataFrame:
    """robot_id, goal, since, until of a stream of goals (robot_id, tick, goal): each goal that is still the robot's when `kept`
    ticks are over, once, when the clock has passed that tick.

    The clock is the newest tick of any robot, less `late`: a silent robot's goal runs out too. A tick is a second of event
    time, from 1 on, as nothing may come at the first watermark. State is one goal and one timer a robot; rows later than the clock are dropped.
    """
    timed = goals.withColumn("at", F.timestamp_seconds(F.col("tick") + 1)).withWatermark("at", f"{late} seconds")
    spark = goals.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return timed.groupBy("robot_id").transformWithStateInPandas(statefulProcessor=Expiry(kept), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
