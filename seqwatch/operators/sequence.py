"""Order of segments: skipped steps, swapped neighbours, over-long repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqwatch.operators.surprise import PLACES


def bridges(logp: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each pair of different states with the best state between them: `by`, from_state, to_state, bridge, gain.

    The gain is that of going through the bridge over going directly; the smaller state of equals wins. A join of a
    model's transition table with itself, K cubed rows for K states.
    """
    one = logp.select(*by, "from_state", F.col("to_state").alias("bridge"), F.col("logp").alias("l1"))
    two = logp.select(*by, F.col("from_state").alias("bridge"), "to_state", F.col("logp").alias("l2"))
    paths = one.join(two, [*by, "bridge"]).filter("from_state != to_state").withColumn("two_hop", F.col("l1") + F.col("l2"))
    best = Window.partitionBy(*by, "from_state", "to_state").orderBy(F.desc(F.round("two_hop", PLACES)), "bridge")
    top = paths.withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    return top.join(logp, [*by, "from_state", "to_state"]).select(*by, "from_state", "to_state", "bridge", (F.col("two_hop") - F.col("logp")).alias("gain"))


def lookup_table(logp: DataFrame) -> DataFrame:
    """One row: `t`, an array by from_state of arrays by to_state, null where there is no transition; a model's table."""
    rows = logp.groupBy("from_state").agg(F.map_from_entries(F.collect_list(F.struct("to_state", "logp"))).alias("m"), F.max(F.greatest("from_state", "to_state")).alias("top"))
    one = rows.agg(F.map_from_entries(F.collect_list(F.struct("from_state", "m"))).alias("m"), F.max("top").alias("top"))
    states = F.sequence(F.lit(0), "top")
    return one.select(F.transform(states, lambda x: F.transform(states, lambda y: F.col("m")[x][y])).alias("t"))


def swap_gains(segments: DataFrame, logp: DataFrame) -> DataFrame:
    """Each junction's gain in log probability if its two segments changed places.

    Only the transitions around the junction change: into it, across it and out of it; missing flanks don't count.
    """
    w = Window.partitionBy("trial_id").orderBy("seg_idx")
    rows = segments.select("trial_id", "seg_idx", F.col("state").alias("a"), F.lead("state", 1).over(w).alias("b"), F.lag("state", 1).over(w).alias("before"), F.lead("state", 2).over(w).alias("after")).filter("b is not null")
    rows = rows.join(F.broadcast(lookup_table(logp)), F.lit(True))  # one row
    at = lambda x, y: F.get(F.get("t", F.col(x)), F.col(y))
    pairs = {"old": ("a", "b"), "new": ("b", "a"), "old_in": ("before", "a"), "new_in": ("before", "b"), "old_out": ("b", "after"), "new_out": ("a", "after")}
    rows = rows.withColumns({name: at(*pair) for name, pair in pairs.items()}).drop("t")
    same = lambda x, y, c: F.when(F.col(x) == F.col(y), F.lit(float("-inf"))).otherwise(F.coalesce(c, F.lit(0.0)))
    into = F.when(F.col("before").isNull(), 0.0).otherwise(same("before", "b", F.col("new_in")) - same("before", "a", F.col("old_in")))
    out = F.when(F.col("after").isNull(), 0.0).otherwise(same("a", "after", F.col("new_out")) - same("b", "after", F.col("old_out")))
    return rows.select("trial_id", "seg_idx", "a", "b", (F.col("new") - F.col("old") + into + out).alias("gain"))


def repetition_ratios(segments: DataFrame, expected: DataFrame) -> DataFrame:
    """Each segment's duration over its state's expected one."""
    ratio = F.when(F.col("mean_duration") > 0, F.col("duration") / F.col("mean_duration")).otherwise(0.0)
    return segments.join(expected.select("state", "mean_duration"), "state").select("trial_id", "seg_idx", "state", ratio.alias("ratio"))


def verdicts(segments: DataFrame, logp: DataFrame, expected: DataFrame, swap_above: float, ratio_above: float, least_gain: float = 2.0) -> DataFrame:
    """One row per finding: trial_id, seg_idx, error_type, value, bridge.

    At a junction a swap goes before a skipped step; repeats are judged segment by segment.
    """
    swaps = swap_gains(segments, logp)
    over = bridges(logp).withColumnsRenamed({"from_state": "a", "to_state": "b", "gain": "bridge_gain"})
    junctions = swaps.join(over, ["a", "b"], "left")
    kind = F.when(F.col("gain") > swap_above, "transposition").when(F.col("bridge_gain") >= least_gain, "omission")
    found = junctions.withColumn("error_type", kind).filter("error_type is not null")
    found = found.select("trial_id", "seg_idx", "error_type", F.when(F.col("error_type") == "omission", F.col("bridge_gain")).otherwise(F.col("gain")).alias("value"), F.when(F.col("error_type") == "omission", F.col("bridge")).alias("bridge"))
    repeats = repetition_ratios(segments, expected).filter(F.col("ratio") > ratio_above)
    return found.unionByName(repeats.select("trial_id", "seg_idx", F.lit("repetition").alias("error_type"), F.col("ratio").alias("value"), F.lit(None).cast("int").alias("bridge")))


def step_verdicts(found: DataFrame, segments: DataFrame, numbered: DataFrame) -> DataFrame:
    """trial_id, step, error_type of steps that share a tick with what a verdict speaks of.

    That is the segment of a repetition, else both segments at the junction. Of several verdicts the first counts, of
    those at one segment the first by name. `numbered` are ticks with the number of their step (`step`), so spans meet
    steps by ticks and no interval is joined.
    """
    following = F.lead("tick_end").over(Window.partitionBy("trial_id").orderBy("seg_idx"))
    spans = segments.select("trial_id", "seg_idx", "tick_start", "tick_end", following.alias("next_end"))
    end = F.when(F.col("error_type") == "repetition", F.col("tick_end")).otherwise(F.coalesce("next_end", "tick_end"))
    at = found.join(spans, ["trial_id", "seg_idx"]).select("trial_id", "seg_idx", "error_type", F.explode(F.sequence("tick_start", end - 1)).alias("tick"))
    at = at.groupBy("trial_id", "tick").agg(F.min(F.struct("seg_idx", "error_type")).alias("v"))
    return at.join(numbered.select("trial_id", "tick", "step"), ["trial_id", "tick"]).groupBy("trial_id", "step").agg(F.min("v").alias("v")).select("trial_id", "step", "v.error_type")


def relabelled(step_verdicts: DataFrame, sequence_verdicts: DataFrame) -> DataFrame:
    """Omissions become transpositions in trials in which the order of segments speaks for a swap."""
    swapped = sequence_verdicts.filter("error_type = 'transposition'").select("trial_id", F.lit(True).alias("swapped")).distinct()
    kind = F.when((F.col("error_type") == "omission") & F.col("swapped"), "transposition").otherwise(F.col("error_type"))
    return step_verdicts.join(swapped, "trial_id", "left").withColumn("error_type", kind).drop("swapped")
