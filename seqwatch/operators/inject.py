"""Errors injected into tick sequences, with the provenance of every tick.

All types of error are made in one pass over the ticks, which meet the segments chosen for each type. The results have
(trial_id, error_type, tick, verb_id, noun_id, src_tick, edited); `windows` has the ticks of each injected error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The five types of error.
ERROR_TYPES = ["substitution", "abandonment", "omission", "transposition", "repetition"]
MIN_SEGMENTS, KEEP_FRAC = 4, 0.05


def usable(segments: DataFrame) -> DataFrame:
    """Segments of trials with enough of them."""
    n = F.count("*").over(Window.partitionBy("trial_id"))
    return segments.withColumn("n_segments", n).filter(F.col("n_segments") >= MIN_SEGMENTS)


def choices(segments: DataFrame, kinds: list[str], seed: int | None = None) -> DataFrame:
    """trial_id, error_type, at (the segment), state, a, z, d, z2 (its first tick, end, length, its successor's end).

    A legal segment is an interior one, of 2 ticks at least for abandonment, and with an interior successor for
    transposition. Without a seed the trial's id decides among them, else a hash of seed and id; both don't depend on
    the order of trials.
    """
    rows = usable(segments).withColumn("z2", F.lead("tick_end").over(Window.partitionBy("trial_id").orderBy("seg_idx")))
    rows = rows.withColumn("error_type", F.explode(F.array(*map(F.lit, kinds))))
    last = F.when(F.col("error_type") == "transposition", 2).otherwise(1)
    rows = rows.filter((F.col("seg_idx") >= 1) & (F.col("seg_idx") < F.col("n_segments") - last) & ((F.col("error_type") != "abandonment") | (F.col("duration") >= 2)))
    whole = Window.partitionBy("trial_id", "error_type")
    legal = rows.withColumn("nth", F.row_number().over(whole.orderBy("seg_idx")) - 1).withColumn("legal", F.count("*").over(whole))
    draw = F.col("trial_id") if seed is None else F.xxhash64(F.lit(seed), "trial_id")
    chosen = legal.filter(F.col("nth") == F.pmod(draw, F.col("legal")))
    return chosen.select("trial_id", "error_type", F.col("seg_idx").alias("at"), "state", F.col("tick_start").alias("a"), F.col("tick_end").alias("z"), F.col("duration").alias("d"), "z2")


def kept(frac: float):
    """Ticks that an abandoned segment keeps: a share of them, one at least and all but one at most."""
    return F.greatest(F.least(F.round(F.col("d") * frac), F.col("d") - 1), F.lit(1)).cast("int")


def unseen_nouns(ticks: DataFrame, segments: DataFrame, chosen: DataFrame, n_nouns: int, band: int = 0) -> DataFrame:
    """(trial_id, new_noun): of the items other than the segment's own, the least seen in its state, the smaller of equals.

    With `band` k > 0, items seen at most k times more often than the least seen are candidates too, and the trial's id
    draws one of them.
    """
    spans = segments.select("trial_id", "state", F.explode(F.sequence("tick_start", F.col("tick_end") - 1)).alias("tick"))
    seen = ticks.select("trial_id", "tick", "noun_id").join(spans, ["trial_id", "tick"]).groupBy("state", "noun_id").agg(F.count("*").alias("n"))
    states = segments.select("state").distinct().withColumn("noun_id", F.explode(F.sequence(F.lit(0), F.lit(n_nouns - 1))))
    counts = states.join(seen, ["state", "noun_id"], "left").fillna(0, ["n"]).groupBy("state").agg(F.sort_array(F.collect_list(F.struct("n", "noun_id"))).alias("options"))  # one row a state
    own = chosen.join(ticks.select("trial_id", F.col("tick").alias("a"), F.col("noun_id").alias("own")), ["trial_id", "a"]).join(counts, "state")
    options = F.filter("options", lambda x: x["noun_id"] != F.col("own"))
    rows = own.select("trial_id", options.alias("options")).filter(F.size("options") > 0)
    near = F.filter("options", lambda x: x["n"] <= F.col("options")[0]["n"] + band)
    pick = F.get(near, F.pmod("trial_id", F.size(near)).cast("int")) if band else F.col("options")[0]
    return rows.select("trial_id", pick["noun_id"].alias("new_noun"))


def injected(ticks: DataFrame, chosen: DataFrame, new_nouns: DataFrame, keep_frac: float = KEEP_FRAC) -> DataFrame:
    """The degraded trials of all chosen (trial, type of error): one join, one renumbering window.

    Substitution retags the segment's items; abandonment cuts it short; omission drops it; transposition swaps it with
    its successor; repetition puts a copy of it behind it, whose ticks come from the same source ticks.
    """
    kind, tick = F.col("error_type"), F.col("tick")
    with_noun = chosen.join(new_nouns.withColumn("error_type", F.lit("substitution")), ["trial_id", "error_type"], "left").filter("error_type != 'substitution' or new_noun is not null")
    rows = ticks.select("trial_id", "tick", "verb_id", "noun_id").join(with_noun.drop("state", "at"), "trial_id").withColumn("inside", (tick >= F.col("a")) & (tick < F.col("z")))
    rows = rows.filter(~F.col("inside") | (kind.isin("substitution", "transposition", "repetition")) | ((kind == "abandonment") & (tick < F.col("a") + kept(keep_frac))))
    swapped = F.when(F.col("inside"), 2).when((tick >= F.col("z")) & (tick < F.col("z2")), 1).when(tick < F.col("a"), 0).otherwise(3)
    places = F.when((kind == "repetition") & F.col("inside"), F.array(F.lit(0), F.lit(1))).when(kind == "repetition", F.array(F.when(tick < F.col("z"), 0).otherwise(2))).when(kind == "transposition", F.array(swapped)).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("place", F.explode(places)).withColumn("edited", (kind == "substitution") & F.col("inside"))
    new = (F.row_number().over(Window.partitionBy("trial_id", "error_type").orderBy("place", "tick")) - 1).cast("int")
    noun = F.when(F.col("edited"), F.col("new_noun")).otherwise(F.col("noun_id"))
    return rows.select("trial_id", "error_type", new.alias("new"), "verb_id", noun.alias("noun_id"), tick.alias("src_tick"), "edited").withColumnRenamed("new", "tick").select("trial_id", "error_type", "tick", "verb_id", "noun_id", "src_tick", "edited")


def stall(ticks: DataFrame, chosen: DataFrame, least: int = 20, times: int = 3) -> DataFrame:
    """Repeats the segment's last tick, three times its length or 20 ticks, whichever is more."""
    rows = ticks.join(chosen.select("trial_id", "z", "d"), "trial_id")
    extra = F.when(F.col("tick") == F.col("z") - 1, F.greatest(F.col("d") * times, F.lit(least))).otherwise(0)
    rows = rows.withColumn("place", F.explode(F.sequence(F.lit(0), extra)))
    tick = (F.row_number().over(Window.partitionBy("trial_id").orderBy("tick", "place")) - 1).cast("int")
    return rows.select("trial_id", F.lit("stall").alias("error_type"), tick.alias("new"), "verb_id", "noun_id", F.col("tick").alias("src_tick"), F.lit(False).alias("edited")).withColumnRenamed("new", "tick")


def windows(chosen: DataFrame, keep_frac: float = KEEP_FRAC) -> DataFrame:
    """(trial_id, error_type, t0, t1) of the injected errors, in ticks of the degraded trial, both included."""
    a, z, d, kind = F.col("a"), F.col("z"), F.col("d"), F.col("error_type")
    cut = a + kept(keep_frac) - 1
    t0 = F.when(kind == "abandonment", cut).when(kind == "repetition", z).otherwise(a)
    t1 = F.when(kind == "abandonment", cut).when(kind == "repetition", z + d - 1).when(kind == "omission", a).when(kind == "transposition", F.col("z2") - 1).otherwise(z - 1)
    return chosen.select("trial_id", "error_type", t0.cast("int").alias("t0"), t1.cast("int").alias("t1"))


def inject(ticks: DataFrame, segments: DataFrame, kinds: str | list[str], n_nouns: int, seed: int | None = None, band: int = 0) -> tuple[DataFrame, DataFrame]:
    """(degraded ticks, windows) of these types of error, each in every trial that allows it."""
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if unknown := {*kinds} - {*ERROR_TYPES}:
        raise ValueError(f"unknown error type {min(unknown)!r}")
    chosen = choices(segments, kinds, seed)
    nouns = unseen_nouns(ticks, segments, chosen.filter("error_type = 'substitution'"), n_nouns, band)
    return injected(ticks, chosen, nouns), windows(chosen)
