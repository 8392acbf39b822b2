"""Alarms on streams that need no event to come: event-time timers fire when a segment outlasts its state's limit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from seqwatch.operators import surprise as S

#: What a stream with these alarms needs: state in RocksDB, by keys of their own.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SCHEMA = "trial_id long, started timestamp, state int, alarm timestamp"


def stall_limits(tails: DataFrame, d_max: int, alpha: float) -> dict[int, int]:
    """The ticks that a segment of each state may last: the most whose share of durations as long is alpha or more.

    States whose every tail within `d_max` is likelier have no limit. Tails are of the size of the model.
    """
    spans = tails.groupBy("state").agg(F.max("d").alias("top"))
    one = spans.select(F.col("state").alias("trial_id"), F.lit(0).alias("seg_idx"), "state", F.lit(0).alias("tick_start"), F.least("top", F.lit(d_max)).alias("tick_end"))
    flagged = S.live_stall(one, tails, d_max).filter(F.round("s_temporal", S.PLACES) > F.round(-F.log(F.lit(alpha)), S.PLACES))
    return {r["state"]: r["limit"] for r in flagged.groupBy("state").agg((F.min("elapsed") - 1).alias("limit")).collect()}


class _Stalls(StatefulProcessor):
    """Holds a trial's events until no earlier one may come, then its open segment; both are all its state."""

    def __init__(self, limits: dict[int, int]):
        self.limits = limits  # milliseconds by state

    def init(self, handle):
        self.handle = handle
        self.open = handle.getValueState("open", "start long, state int, told boolean")
        self.waiting = handle.getMapState("waiting", "ts long", "state int")

    def handleInputRows(self, key, rows, timerValues):
        sure = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            for ts, state in zip(part["ts"], part["state"]):
                ms = pd.Timestamp(ts).value // 1_000_000
                if ms >= sure:
                    held = self.waiting.getValue((ms,))[0] if self.waiting.containsKey((ms,)) else int(state)
                    self.waiting.updateValue((ms,), (min(held, int(state)),))
                    self.handle.registerTimer(ms)
        yield self._settled(key, sure)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._settled(key, timerValues.getCurrentWatermarkInMs())

    def _settled(self, key, sure):
        """Takes the events up to the watermark in their order, and tells alarms due by then; nothing that was told again."""
        start, state, told = self.open.get() if self.open.exists() else (None, None, False)
        out = []

        def tell(until):
            nonlocal told
            limit = self.limits.get(state)
            if start is not None and not told and limit is not None and start + limit < until:
                out.append((key[0], pd.Timestamp(start, unit="ms"), state, pd.Timestamp(start + limit, unit="ms")))
                told = True

        due = sorted((ts[0], value[0]) for ts, value in self.waiting.iterator() if ts[0] <= sure)
        for ts, value in due:
            tell(ts)
            if value != state:
                start, state, told = ts, value, False
                if value in self.limits:
                    self.handle.registerTimer(ts + self.limits[value] + 1)
            self.waiting.removeKey((ts,))
        tell(sure)
        if start is not None:
            self.open.update((int(start), int(state), bool(told)))
        return pd.DataFrame(out, columns=["trial_id", "started", "state", "alarm"])

    def close(self):
        pass


def stall_alarms(events: DataFrame, limits: dict[int, int], late: str = "1 minute") -> DataFrame:
    """trial_id, started, state, alarm: when a segment of a stream (trial_id, ts, state) has outlasted its state's limit in
    milliseconds, whether or not another event of the trial ever comes.

    A segment is a run of events of one state; it lasts until the next event of another state, and is told once, when the
    watermark passes its limit. Events may come out of order by `late`; what is later still is left out. Of events of one
    trial at one time the smallest state counts. The session must keep state as `STORE` says.
    """
    keyed = events.select("trial_id", "ts", F.col("state").cast("int").alias("state")).withWatermark("ts", late).groupBy("trial_id")
    return keyed.transformWithStateInPandas(_Stalls(limits), SCHEMA, "Append", "EventTime")


def stalls(events: DataFrame, limits: dict[int, int], until) -> DataFrame:
    """The same alarms of a table, for everything up to the time `until`."""
    w = Window.partitionBy("trial_id").orderBy("ts")
    one = events.groupBy("trial_id", "ts").agg(F.min("state").cast("int").alias("state"))
    starts = one.withColumn("before", F.lag("state").over(w)).filter("before IS NULL OR before <> state")
    ends = starts.withColumn("end", F.coalesce(F.lead("ts").over(w), F.lit(until).cast("timestamp")))
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))]) if limits else F.lit(None).cast("map<int,int>")
    alarm = F.timestamp_micros(F.unix_micros("ts") + 1000 * F.get(F.array(limit[F.col("state")]), F.lit(0)).cast("long"))
    return ends.withColumn("alarm", alarm).filter("alarm < end").select("trial_id", F.col("ts").alias("started"), "state", "alarm")
