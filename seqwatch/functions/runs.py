"""Ticks and runs: expansion of intervals, run-length encoding, absorption, positions of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_numbers(ticks: DataFrame, values: list[str], key: str | list[str] = "trial_id", order: str = "tick") -> DataFrame:
    """Adds `seg_idx`: the number of the maximal run of equal values that a row is in."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)
    before = F.lag(F.struct(*values)).over(w)
    new = F.when(before.eqNullSafe(F.struct(*values)), 0).otherwise(1)
    return ticks.withColumn("__new", new).withColumn("seg_idx", (F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("__new")


def runs(ticks: DataFrame, values: list[str], keep: list[str] = (), key: str = "trial_id") -> DataFrame:
    """trial_id, `keep`, seg_idx, values, tick_start, tick_end (exclusive), duration, is_last of maximal runs."""
    out = run_numbers(ticks, values, key).groupBy(key, *keep, "seg_idx", *values).agg(F.min("tick").alias("tick_start"), (F.max("tick") + 1).cast("int").alias("tick_end"), F.count("*").cast("int").alias("duration"))
    return out.withColumn("is_last", F.lead("seg_idx").over(Window.partitionBy(key).orderBy("seg_idx")).isNull())


def expand_runs(segments: DataFrame, value: str, key: str = "trial_id") -> DataFrame:
    """One row per tick of each segment."""
    return segments.select(key, F.explode(F.sequence("tick_start", F.col("tick_end") - 1)).alias("tick"), value)


def absorb(ticks: DataFrame, value: str, kept: DataFrame, key: str = "trial_id") -> DataFrame:
    """Replaces values that aren't in `kept` by the kept value before them, else by the next one, else by 0."""
    w = Window.partitionBy(key).orderBy("tick")
    known = F.col("__kept")
    rows = ticks.join(kept.select(F.col(value), F.lit(True).alias("__is")), value, "left").withColumn("__kept", F.when(F.col("__is"), F.col(value)))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(value, F.coalesce(before, after, F.lit(0))).drop("__is", "__kept")


def trim_idle(ticks: DataFrame, is_idle, key: str = "trial_id") -> DataFrame:
    """Drops each trial's closing run of idle ticks; adds n_trimmed. A trial of idle ticks only vanishes."""
    whole = Window.partitionBy(key)
    last = F.max(F.when(~is_idle, F.col("tick"))).over(whole)
    rows = ticks.withColumn("__last", last).withColumn("n_trimmed", (F.max("tick").over(whole) - F.coalesce(F.col("__last"), F.lit(-1))).cast("int"))
    return rows.filter(F.col("tick") <= F.col("__last")).drop("__last")


def expand_to_ticks(segments: DataFrame, value: str, per_tick: float, key: str = "trial_id") -> DataFrame:
    """trial_id, tick and the value that holds most frames of the tick.

    Segments have 1-based inclusive frames. Tick i has the frames from floor(i * per_tick) + 1 to
    floor((i + 1) * per_tick), ending with the last segment. Of values with equally many frames, that wins which the
    tick meets first. Each segment is exploded to the ticks that it touches, so no frame is ever a row.
    """
    last = segments.groupBy(key).agg(F.max("end_frame").alias("last_frame"))
    first_tick = F.floor((F.col("start_frame") - 1) / per_tick).cast("int")
    last_tick = F.floor((F.col("end_frame") - 1) / per_tick).cast("int")
    rows = segments.join(last, key).withColumn("tick", F.explode(F.sequence(first_tick, last_tick)))
    low = F.greatest(F.col("start_frame"), F.floor(F.col("tick") * per_tick) + 1)
    high = F.least(F.col("end_frame"), F.floor((F.col("tick") + 1) * per_tick), F.col("last_frame"))
    votes = rows.withColumn("low", low).withColumn("frames", high - low + 1).filter("frames > 0").groupBy(key, "tick", value).agg(F.sum("frames").alias("frames"), F.min("low").alias("low"))
    best = Window.partitionBy(key, "tick").orderBy(F.desc("frames"), "low")
    return votes.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select(key, "tick", value)
