"""How a stuck robot recovers: a state machine over its ticks, kept as one state a robot of a stream or a table.

A robot that is told to move and does not is more stuck each tick. It first looks for another way (nudge), then backs up if
there is room behind it, else spins; a goal that keeps it stuck is skipped; and without net progress it is placed anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed values, in ticks unless said otherwise: when a robot is nudged, when it recovers, and how long each phase takes.
NUDGE_AT, RECOVER_AT = 6, 14
NUDGE, BACK_UP, SPIN_BLOCKED, SPIN_AFTER = 8, 14, 16, 15
#: Recoveries after which a goal is skipped; ticks without net progress at which recovery begins at once, and a respawn.
PATIENCE, STALLED, RESPAWN_AT = 3, 30, 100
#: Share of the speed below which a tick is no move; metres, and cells, of net progress.
SLOW, PROGRESS_M, PROGRESS_CELLS = 0.15, 0.20, 1.5

INPUT = "robot_id int, tick long, x double, y double, commanded boolean, rotating boolean, has_goal boolean, rear_m double"
OUTPUT = "robot_id int, tick long, stuck int, phase string, phase_left int, skipped boolean, respawned boolean"
STATE = "x double, y double, ref_x double, ref_y double, stuck int, still int, phase string, phase_left int, tries int"


@dataclass
class Robot:
    """What is kept of a robot from tick to tick."""

    x: float
    y: float
    ref_x: float
    ref_y: float
    stuck: int = 0
    still: int = 0
    phase: str = "none"
    phase_left: int = 0
    tries: int = 0

    def _run_down(self) -> None:
        """One tick of the phase that it is in."""
        if self.phase == "none":
            return
        self.phase_left -= 1
        if self.phase_left <= 0:
            self.phase, self.phase_left = ("spin", SPIN_AFTER) if self.phase == "back up" else ("none", 0)

    def step(self, x: float, y: float, commanded: bool, rotating: bool, has_goal: bool, rear_m: float, *, cell_m: float, step_m: float) -> tuple[bool, bool]:
        """Advance to a position; step_m: the way of one tick at full speed. Returns whether the goal is skipped and the robot placed anew."""
        skipped = False
        self._run_down()
        if has_goal and self.stuck >= NUDGE_AT and self.phase == "none":
            self.phase, self.phase_left = "nudge", NUDGE
        moved = math.hypot(x - self.x, y - self.y)
        if (commanded or has_goal and not rotating) and moved < SLOW * step_m:
            self.stuck += 1
            if self.stuck >= RECOVER_AT and self.phase not in ("back up", "spin"):
                self.phase, self.phase_left = ("back up", BACK_UP) if rear_m > cell_m else ("spin", SPIN_BLOCKED)
                self.tries += 1
                if self.tries > PATIENCE and has_goal:
                    skipped, self.tries = True, 0
        else:
            self.stuck = max(0, self.stuck - 1)
            if moved >= SLOW * step_m and self.phase == "nudge":
                self.phase, self.phase_left = "none", 0
        if math.hypot(x - self.ref_x, y - self.ref_y) < max(PROGRESS_M, PROGRESS_CELLS * cell_m):
            self.still += 1
            if self.still >= STALLED and has_goal and self.phase == "none":
                self.stuck = RECOVER_AT
        else:
            self.ref_x, self.ref_y, self.still = x, y, 0
        self.x, self.y = x, y
        respawned = self.still >= RESPAWN_AT
        if respawned:
            self.__init__(x, y, x, y)
        return skipped, respawned


def recovery(ticks: DataFrame, *, cell_m: float = 0.1, step_m: float = 0.1) -> DataFrame:
    """OUTPUT for each row of INPUT, a stream or a table; ticks of a robot are taken in order within a batch.

    A null x, y or rear_m is an error; a null flag is false. A stream keeps one state a robot.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        robot = Robot(*held.get) if held.exists else None
        yield _advance(key[0], pd.concat(list(frames)), robot, lambda r: held.update(tuple(asdict(r).values())), cell_m, step_m)

    if ticks.isStreaming:
        return ticks.groupBy("robot_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    return ticks.groupBy("robot_id").applyInPandas(lambda key, pdf: _advance(key[0], pdf, None, lambda r: None, cell_m, step_m), OUTPUT)


def _advance(robot_id: int, pdf: pd.DataFrame, robot: Robot | None, keep, cell_m: float, step_m: float) -> pd.DataFrame:
    rows = []
    for t in pdf.sort_values("tick").itertuples():
        robot = robot or Robot(t.x, t.y, t.x, t.y)
        flags = [bool(v) if v is not None and v == v else False for v in (t.commanded, t.rotating, t.has_goal)]
        skipped, respawned = robot.step(t.x, t.y, *flags, t.rear_m, cell_m=cell_m, step_m=step_m)
        rows.append((robot_id, t.tick, robot.stuck, robot.phase, robot.phase_left, skipped, respawned))
    if robot:
        keep(robot)
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])
