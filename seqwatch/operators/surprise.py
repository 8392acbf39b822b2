"""Surprise channels of segments, exact tail thresholds, flags, their severity and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are compared after rounding to so many places: equal scores are one level of the tail.
PLACES = 9


def transition_surprise(segments: DataFrame, logp: DataFrame) -> DataFrame:
    """Each segment but the first: tick_start, from_state, state and -log P(state | from_state)."""
    before = F.lag("state").over(Window.partitionBy("trial_id").orderBy("seg_idx"))
    rows = segments.withColumn("from_state", before).filter("from_state is not null")
    return rows.join(logp.withColumnRenamed("to_state", "state"), ["from_state", "state"]).withColumn("s_transition", -F.col("logp")).drop("logp")


def expected_next(logp: DataFrame) -> DataFrame:
    """The likeliest next state of each state, the smaller of equals."""
    best = Window.partitionBy("from_state").orderBy(F.desc(F.round("logp", PLACES)), "to_state")
    return logp.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("from_state", F.col("to_state").alias("expected_state"), "logp")


def tail_threshold(support: DataFrame, key: list[str], score: str, mass: str, alpha: float | list[float]) -> DataFrame:
    """Each key's threshold: the score t with the largest mass of greater scores that is still at most alpha.

    Equal scores pass or fail together; values without mass don't count. With `value > threshold` as the rule, at
    most alpha of the mass is flagged. Never above the last level: the threshold is a score of the support. For a list
    of alphas there is a row for each, with a column `alpha`; the support is read once.
    """
    several = isinstance(alpha, list)
    levels = support.filter(F.col(mass) > 0).groupBy(*key, F.round(score, PLACES).alias("threshold")).agg(F.sum(mass).alias("mass"))
    falling = Window.partitionBy(*key).orderBy(F.desc("threshold"))
    ranked = levels.withColumn("upto", F.sum("mass").over(falling.rowsBetween(Window.unboundedPreceding, 0))).withColumn("level", F.row_number().over(falling))
    ranked = ranked.withColumn("alpha", F.explode(F.array(*map(F.lit, alpha if several else [alpha]))))
    whole = Window.partitionBy(*key, "alpha")
    pick = F.least(F.sum((F.col("upto") <= F.col("alpha") + 1e-12).cast("int")).over(whole) + 1, F.count("*").over(whole))
    return ranked.withColumn("pick", pick).filter("level = pick").select(*key, *(["alpha"] if several else []), "threshold")


def transition_thresholds(logp: DataFrame, alpha: float | list[float]) -> DataFrame:
    support = logp.select("from_state", (-F.col("logp")).alias("score"), F.exp("logp").alias("mass"))
    return tail_threshold(support, ["from_state"], "score", "mass", alpha)


def excess_thresholds(logp: DataFrame, marginal: DataFrame, alpha: float | list[float]) -> DataFrame:
    """By recipe and from_state: of log P(marginal) - log P(recipe), with the recipe's mass; may be negative."""
    both = logp.join(marginal.withColumnRenamed("logp", "logm"), ["from_state", "to_state"])
    support = both.select("recipe", "from_state", (F.col("logm") - F.col("logp")).alias("score"), F.exp("logp").alias("mass"))
    return tail_threshold(support, ["recipe", "from_state"], "score", "mass", alpha)


def token_thresholds(log_emission: DataFrame, token: str, alpha: float | list[float]) -> DataFrame:
    support = log_emission.select("state", (-F.col("logp")).alias("score"), F.exp("logp").alias("mass"))
    return tail_threshold(support, ["state"], "score", "mass", alpha)


def pair_thresholds(log_verbs: DataFrame, log_nouns: DataFrame, alpha: float | list[float]) -> DataFrame:
    """Of -log P(verb, noun | state), the two being independent given the state."""
    both = log_verbs.select("state", F.col("logp").alias("lv")).join(log_nouns.select("state", F.col("logp").alias("ln")), "state")
    support = both.select("state", (-F.col("lv") - F.col("ln")).alias("score"), F.exp(F.col("lv") + F.col("ln")).alias("mass"))
    return tail_threshold(support, ["state"], "score", "mass", alpha)


def sample_threshold(values: DataFrame, key: list[str], score: str, alpha: float) -> DataFrame:
    """Of an observed sample, each value with equal mass."""
    n = F.count("*").over(Window.partitionBy(*key))
    return tail_threshold(values.withColumn("mass", 1 / n), key, score, "mass", alpha)


def pooled_threshold(values: DataFrame, score: str, alpha: float) -> float | None:
    """The tail threshold of a whole sample, each value with equal mass; None for an empty one.

    Values are counted by level first, so only distinct levels are ordered in one task.
    """
    levels = values.groupBy(F.round(score, PLACES).alias("score")).agg(F.count("*").alias("n"))
    total = levels.agg(F.sum("n").alias("total"))
    support = levels.join(F.broadcast(total), F.lit(True)).select(F.lit(0).alias("all"), "score", (F.col("n") / F.col("total")).alias("mass"))
    row = tail_threshold(support, ["all"], "score", "mass", alpha).first()
    return row["threshold"] if row else None


def duration_tails(histogram: DataFrame) -> DataFrame:
    """state, d, and the shares at least d, at most d, below d and at d, of observed durations."""
    up = Window.partitionBy("state").orderBy("d")
    whole = Window.partitionBy("state")
    total, upto = F.sum("n").over(whole), F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, 0))
    return histogram.select("state", "d", ((total - upto + F.col("n")) / total).alias("p_ge"), (upto / total).alias("p_le"), ((upto - F.col("n")) / total).alias("p_lt"), (F.col("n") / total).alias("p_eq"))


def completed_durations(segments: DataFrame, tails: DataFrame, d_max: int, keys: list[str] | None = None) -> DataFrame:
    """Two-sided surprise of each closed segment's duration; the last segment is still open and scores 0."""
    rows = segments.withColumn("d", F.least("duration", F.lit(d_max))).join(tails, ["state", "d"])
    longer, shorter = -F.log("p_ge"), -F.log("p_le")
    two = F.greatest(F.lit(0.0), -(F.log(F.lit(2.0)) + F.least(F.log("p_ge"), F.log("p_le"))))
    closed = lambda c: F.when(F.col("is_last"), 0.0).otherwise(c)
    cause = F.when(F.col("is_last"), "none").when(F.col("p_ge") < F.col("p_le"), "stuck").otherwise("left_early")
    pit = F.col("p_lt") + 0.5 * F.col("p_eq")
    named = ["trial_id"] if keys is None else [*keys, "tick_end"]
    return rows.select(*named, "seg_idx", "state", "duration", closed(longer).alias("s_long"), closed(shorter).alias("s_short"), closed(two).alias("s_dur_two"), cause.alias("cause"), pit.alias("pit"))


def whole_tails(histogram: DataFrame, d_max: int) -> DataFrame:
    """Like `duration_tails`, for every duration from 1 to `d_max` of each state, seen or not."""
    spine = histogram.select("state").distinct().withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(d_max))))
    return duration_tails(spine.join(histogram, ["state", "d"], "left").fillna(0, ["n"]))


def duration_power(segments: DataFrame, d_max: int, alphas: list[float]) -> DataFrame:
    """By alpha: closed segments, and how many have a two-sided duration surprise above -log alpha as they are, twice as
    long, and cut to one tick: what the channel raises on healthy segments, on repetitions and on abandonments.

    Durations are counted by state first, so all but that count is of the size of the model. The last segment of a trial
    is still open and not judged.
    """
    closed = segments.filter("not is_last").groupBy("state", "duration").agg(F.count("*").alias("n"))
    kinds = {"as_is": F.col("duration"), "doubled": 2 * F.col("duration"), "cut": F.lit(1)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.least(c, F.lit(d_max)).cast("int").alias("d")) for k, c in kinds.items()]))
    rows = closed.select("state", "n", each.alias("x")).select("state", "n", "x.kind", "x.d").join(whole_tails(segments_histogram(segments, d_max), d_max), ["state", "d"])
    rows = rows.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    above = F.round(2 * F.least("p_ge", "p_le"), PLACES) < F.col("alpha")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return rows.groupBy("alpha").agg(n(F.col("kind") == "as_is").alias("segments"), *[n((F.col("kind") == k) & above).alias(k) for k in kinds])


def segments_histogram(segments: DataFrame, d_max: int) -> DataFrame:
    return segments.groupBy("state", F.least("duration", F.lit(d_max)).alias("d")).agg(F.count("*").alias("n"))


def pit_deciles(completed: DataFrame) -> DataFrame:
    """decile (0 to 9), n, share of the mid-PIT values of closed segments; even shares speak for the model of durations."""
    decile = F.least(F.floor(F.round("pit", PLACES) * 10), F.lit(9)).cast("int")
    n = completed.filter("cause != 'none'").groupBy(decile.alias("decile")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # ten rows


def survival(tails: DataFrame) -> DataFrame:
    """state, top (the longest duration seen), e from 1 to top, and the share p of durations at least e: that at the next
    duration seen from e on."""
    spine = tails.groupBy("state").agg(F.max("d").alias("top")).select("state", "top", F.explode(F.sequence(F.lit(1), F.col("top"))).alias("e"))
    seen = spine.join(tails.select("state", F.col("d").alias("e"), "p_ge"), ["state", "e"], "left")
    onward = Window.partitionBy("state").orderBy("e").rowsBetween(0, Window.unboundedFollowing)
    return seen.select("state", "top", "e", F.first("p_ge", ignorenulls=True).over(onward).alias("p"))


def live_stall(segments: DataFrame, tails: DataFrame, d_max: int, keys: list[str] | None = None) -> DataFrame:
    """trial_id, tick, elapsed and -log P(duration >= elapsed | state): grows within a segment, starts anew with the next.

    Beyond the longest duration seen, the least observed share holds.
    """
    keys = keys or ["trial_id"]
    rows = segments.select(*keys, "state", "tick_start", F.explode(F.sequence("tick_start", F.col("tick_end") - 1)).alias("tick")).withColumn("elapsed", F.col("tick") - F.col("tick_start") + 1)
    shares = survival(tails)
    tops = shares.select("state", "top").distinct()
    rows = rows.join(tops, "state").withColumn("e", F.least("elapsed", F.lit(d_max), "top")).join(shares.drop("top"), ["state", "e"])
    return rows.select(*keys, "tick", "state", "elapsed", (-F.log("p")).alias("s_temporal"))


def transition_flags(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds the threshold of the state left and whether the surprise exceeds it."""
    return scored.join(thresholds, "from_state").withColumn("flagged", F.round("s_transition", PLACES) > F.col("threshold"))


def severity(value: Column, threshold: Column) -> Column:
    ratio = value / F.nullif(threshold, F.lit(0.0))
    return F.when(threshold.isNull() | F.isnan(threshold) | (threshold <= 0) | (F.abs(threshold) == float("inf")), "high").when(ratio < 1.5, "low").when(ratio < 3.0, "medium").otherwise("high")


def attribution(s_verb: Column, s_noun: Column, margin: float = 2.0) -> Column:
    return F.when(s_noun - s_verb > margin, "item").when(s_verb - s_noun > margin, "action").otherwise("none")


def mixture_surprise(log_verbs: DataFrame, log_nouns: DataFrame, belief: DataFrame, ticks: DataFrame) -> DataFrame:
    """s_verb, s_noun and s_emit of each tick under a belief over states: -log of the mixture of emissions."""
    rows = ticks.join(belief, ["trial_id", "tick"]).join(log_verbs.withColumnRenamed("logp", "lv"), ["state", "verb_id"]).join(log_nouns.withColumnRenamed("logp", "ln"), ["state", "noun_id"])
    mix = lambda c: -F.log(F.sum(F.col("belief") * F.exp(c)))
    return rows.groupBy("trial_id", "tick").agg(mix(F.col("lv")).alias("s_verb"), mix(F.col("ln")).alias("s_noun"), mix(F.col("lv") + F.col("ln")).alias("s_emit"))
