"""Order-dependent series by key: recursive averages, change-points, alarms. Frames where a frame says it, folds else.

A fold sees its key's rows in order and carries a state of bounded size, over a sorted partition in batches; a key's rows
are never gathered. The streaming twins keep the same states.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phmspark.functions.scalars import clip


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable, value: str, new: str) -> DataFrame:
    """``df`` with the columns of the DDL ``new``: ``step(state, value)`` gives their values and changes the state."""
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)
    names = [c.split()[0] for c in new.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            rows = []
            for key, x in zip(batch[keys].itertuples(index=False, name=None), batch[value], strict=True):
                if key != now:
                    now, state = key, start()
                rows.append(step(state, x))
            yield batch.assign(**{n: [r[k] for r in rows] for k, n in enumerate(names)})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{kinds}, {new}")


class TrendState(NamedTuple):
    """What a trend knows after a row: rows so far, rows at arming, smoothed share, drift sum, the alarm's kind, and
    which of the last values lay in the middle band (bits, the latest lowest, in hexadecimal digits)."""

    rows: int = 0
    armed: int = 0
    ewma: float = 0.0
    cusum: float = 0.0
    kind: str | None = None
    middle: str = "0"


@dataclass(frozen=True)
class TrendRule:
    """Share of scores above 1, smoothed from 0, its alarm, and the drift sum with floor 0.

    The alarm is the first row, later than ``warmup`` rows after arming, at which the smoothed share is ``alarm`` or
    more; it is sudden if at most ``sudden`` of the ``window`` values before it lay between ``onset`` and ``alarm``.
    """

    alpha: float = 0.08
    onset: float = 0.2
    alarm: float = 0.5
    sudden: int = 12
    window: int = 120
    warmup: int = 10

    def after(self, was: TrendState, score: float) -> tuple[TrendState, tuple]:
        """The state after a score, and the row's columns."""
        share = was.ewma + self.alpha * (float(score > 1) - was.ewma)
        drift = max(0.0, was.cusum + score - 1)
        fires = was.kind is None and was.rows + 1 - was.armed > self.warmup and share >= self.alarm
        dwell = int(was.middle, 16).bit_count() if fires else None
        kind = was.kind if not fires else "sudden" if dwell <= self.sudden else "gradual"
        middle = (int(was.middle, 16) << 1 | (self.onset <= share < self.alarm)) & ((1 << self.window) - 1)
        return TrendState(was.rows + 1, was.armed, share, drift, kind, f"{middle:x}"), (share, drift, fires, kind, dwell)

    @staticmethod
    def rearmed(was: TrendState) -> TrendState:
        """Waits for the next alarm from nothing; rows go on being counted."""
        return TrendState(rows=was.rows, armed=was.rows)


class Trend:
    """A trend's rule and its state, row by row."""

    NEW = "ewma double, cusum double, alarm_now boolean, verdict string, dwell int"
    STATE = "rows long, armed long, ewma double, cusum double, kind string, middle string"

    def __init__(self, state: tuple = (), **rule):
        self.rule, self.state = TrendRule(**rule), TrendState(*state)

    def step(self, score: float) -> tuple:
        self.state, out = self.rule.after(self.state, score)
        return out

    def rearm(self) -> None:
        self.state = self.rule.rearmed(self.state)

    def held(self) -> tuple:
        return tuple(self.state)


LEVELS = ("normal", "warning", "critical")


class Hysteresis:
    """Alarm level with persistence: a level changes after ``persist`` rows in a row that pull the same way.

    Up: below ``critical`` to critical, below ``warning`` to warning. Down: from warning at ``clear`` or above; from
    critical at ``ease`` or above, to normal if also at ``clear`` or above, else to warning."""

    NEW = "alarm_state string"

    def __init__(self, warning=0.5, clear=0.6, critical=0.2, ease=0.3, persist=3):
        self.warning, self.clear, self.critical, self.ease, self.persist = warning, clear, critical, ease, persist
        self.level, self.way, self.streak = 0, 0, 0

    def _pull(self, h: float) -> int:
        worst = 2 if h < self.critical else 1 if h < self.warning else 0
        if worst > self.level and (self.level == 0 or worst == 2):
            return worst
        if self.level == 1 and h >= self.clear:
            return 0
        if self.level == 2 and h >= self.ease:
            return 0 if h >= self.clear else 1
        return self.level

    def step(self, h: float) -> tuple:
        to = self._pull(h)
        way = (to > self.level) - (to < self.level)
        self.streak = self.streak + 1 if way and way == self.way else abs(way)
        self.way = way
        if way and self.streak >= self.persist:
            self.level, self.way, self.streak = to, 0, 0
        return (LEVELS[self.level],)


class Trajectory:
    """Health of a session: median of three, smoothed from its first value, change-point streak and alarm level."""

    NEW = "robust double, smoothed double, change string, alarm_state string"
    STATE = "last array<double>, smoothed double, streak int, level int, way int, pulled int"

    def __init__(self, state: tuple = ((), None, 0, 0, 0, 0), alpha=0.2, delta=0.15, persist=2):
        self.alpha, self.delta, self.persist = alpha, delta, persist
        last, self.smoothed, self.streak, *alarm = state
        self.last, self.alarm = deque(last, maxlen=3), Hysteresis()
        self.alarm.level, self.alarm.way, self.alarm.streak = alarm

    def held(self) -> tuple:
        return [float(x) for x in self.last], self.smoothed, self.streak, self.alarm.level, self.alarm.way, self.alarm.streak

    def step(self, health: float) -> tuple:
        self.last.append(health)
        three = sorted(self.last)
        robust = three[1] if len(three) == 3 else sum(three) / len(three)
        fell = self.smoothed is not None and self.smoothed - robust >= self.delta
        self.streak = self.streak + 1 if fell else 0
        self.smoothed = robust if self.smoothed is None else self.alpha * robust + (1 - self.alpha) * self.smoothed
        change = "confirmed" if self.streak >= self.persist else "candidate" if self.streak else "none"
        return robust, self.smoothed, change, *self.alarm.step(self.smoothed)


class LiveTrajectory(Trajectory):
    """A trajectory that also keeps its last smoothed values, and tells how fast they fall: the stream's twin of
    ``trajectory``."""

    NEW = Trajectory.NEW + ", rate double, trend string"
    STATE = Trajectory.STATE + ", history array<double>"

    def __init__(self, state: tuple = ((), None, 0, 0, 0, 0, ()), history=120, least=5, stable=0.005, **rule):
        *own, before = state
        super().__init__(tuple(own), **rule)
        self.history, self.least, self.stable = deque(before, maxlen=history), least, stable

    def step(self, health: float) -> tuple:
        out = super().step(health)
        self.history.append(self.smoothed)
        n = len(self.history)
        if n < self.least:
            return *out, None, "insufficient_history"
        middle = (n - 1) / 2
        rate = -sum((k - middle) * y for k, y in enumerate(self.history)) / sum((k - middle) ** 2 for k in range(n))
        return *out, rate, "worsening" if rate > self.stable else "recovering" if rate < -self.stable else "stable"

    def held(self) -> tuple:
        return *super().held(), [float(x) for x in self.history]


def trend(df: DataFrame, keys: list[str], order: list[str], score: str, **params) -> DataFrame:
    return fold(df, keys, order, lambda: Trend(**params), Trend.step, score, Trend.NEW)


def scenario_verdicts(ticks: DataFrame, onsets: DataFrame, keys: list[str], scenario: str, order: str, score: str, **params) -> DataFrame:
    """keys, verdict, alarm_t, latency, transition, correct of trials: the trend of each trial's ticks (keys, ``order`` from
    1, score) up to its first alarm, against ``onsets`` (scenario, onset, expected). Without an alarm all but correct,
    which is then false, is null."""
    met = trend(ticks, keys, [order], score, **params)
    alarm = F.min(F.when(F.col("alarm_now"), F.struct(order, F.col("verdict"), F.col("dwell"))))
    found = met.groupBy(*keys).agg(alarm.alias("_a")).join(F.broadcast(onsets), scenario)  # a row for each scenario
    at = F.col(f"_a.{order}")
    return found.select(*keys, F.col("_a.verdict").alias("verdict"), at.alias("alarm_t"), (at - F.col("onset")).alias("latency"), F.col("_a.dwell").alias("transition"), F.coalesce(F.col("_a.verdict") == F.col("expected"), F.lit(False)).alias("correct"))


def trajectory(df: DataFrame, keys: list[str], order: list[str], health: str, history: int = 120, least: int = 5, stable: float = 0.005) -> DataFrame:
    """``df`` with robust, smoothed, change, alarm_state, rate (falling per row over the last ``history`` smoothed values;
    null before ``least``) and trend. Rows with a null key part or value have no state and are left out: select them
    before as ``insufficient``."""
    there = df.dropna(subset=[*keys, health])
    rows = fold(there, keys, order, Trajectory, Trajectory.step, health, Trajectory.NEW)
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumn("_n", F.row_number().over(w))
    last = w.rowsBetween(1 - history, 0)
    slope = F.regr_slope("smoothed", F.col("_n").cast("double")).over(last)
    rate = F.when(F.col("_n") >= least, -slope)
    said = F.when(rate.isNull(), "insufficient_history").when(rate > stable, "worsening").when(rate < -stable, "recovering").otherwise("stable")
    return numbered.withColumn("rate", rate).withColumn("trend", said).drop("_n")


def health_index(score: Column, low: Column, warning: Column, multiple: float = 2.0, at_warning: float = 0.5) -> Column:
    """1 at the low anchor, ``at_warning`` at the warning anchor, 0 at ``multiple`` times that; straight between, clipped."""
    top = F.when(warning > low, warning).otherwise(low + F.greatest(F.lit(2.220446049250313e-16), F.abs(low) * 1e-12))
    inside = 1 - (1 - at_warning) * (score - low) / (top - low)
    beyond = at_warning - at_warning * (score - top) / (top * (multiple - 1))
    return clip(F.when(score <= top, inside).otherwise(beyond), 0, 1)


def severity(health: Column) -> Column:
    return F.when(health >= 0.5, "healthy").when(health >= 0.35, "early_warning").when(health >= 0.2, "degraded").otherwise("critical")


def confidence(score: Column) -> Column:
    d = F.abs(score - 1)
    return d / (1 + d)
