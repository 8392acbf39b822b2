"""All operating points of a detector at once: the least alpha that flags each score, then running counts over alpha.

A score is flagged at alpha if it exceeds the exact tail threshold, that is, if the mass of scores as great is at most
alpha. So each score has one least alpha, its tail mass, and what a sweep counts at any alpha are running sums over the
least alphas of steps or trials, in one sort. Nothing is computed again for an alpha.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqwatch.operators import channels
from seqwatch.operators.evaluate import rates
from seqwatch.operators.surprise import PLACES
from seqwatch.sources.durable import data, written

#: The name of the union of all channels.
ALL = "all"
COUNTS = ["tp", "fp", "fn", "tn"]


def tail_masses(t: channels.Tables) -> DataFrame:
    """(channel, place, recipe, levels): each level of the scores that a place allows, with the mass of scores as great or
    greater, in ascending order. No alpha flags the lowest level, so its mass is null."""
    none = F.lit(None).cast("int")
    pairs = t.verbs.select("state", F.col("logp").alias("lv")).join(t.nouns.select("state", F.col("logp").alias("ln")), "state")
    own = t.recipe_logp.join(t.marginal.withColumnRenamed("logp", "logm"), ["from_state", "to_state"])
    emitted = F.col("lv") + F.col("ln")
    support = {
        "s_verb": t.verbs.select(F.col("state").alias("place"), none.alias("recipe"), (-F.col("logp")).alias("score"), F.exp("logp").alias("mass")),
        "s_noun": t.nouns.select(F.col("state").alias("place"), none.alias("recipe"), (-F.col("logp")).alias("score"), F.exp("logp").alias("mass")),
        "s_emit": pairs.select(F.col("state").alias("place"), none.alias("recipe"), (-F.col("lv") - F.col("ln")).alias("score"), F.exp(emitted).alias("mass")),
        "s_transition": t.logp.select(F.col("from_state").alias("place"), none.alias("recipe"), (-F.col("logp")).alias("score"), F.exp("logp").alias("mass")),
        "s_recipe_transition": own.select(F.col("from_state").alias("place"), "recipe", (F.col("logm") - F.col("logp")).alias("score"), F.exp("logp").alias("mass")),
    }
    rows = reduce(DataFrame.unionByName, [s.select(F.lit(c).alias("channel"), "*") for c, s in support.items()])
    levels = rows.filter("mass > 0").groupBy("channel", "place", "recipe", F.round("score", PLACES).alias("level")).agg(F.sum("mass").alias("mass"))
    falling = Window.partitionBy("channel", "place", "recipe").orderBy(F.desc("level"))
    tail = F.sum("mass").over(falling.rowsBetween(Window.unboundedPreceding, 0))
    told = levels.withColumn("tail", F.when(F.lead("level").over(falling).isNotNull(), tail))
    return told.groupBy("channel", "place", "recipe").agg(F.sort_array(F.collect_list(F.struct("level", "tail"))).alias("levels"))  # the size of a model


def least_alphas(scores: DataFrame, tails: DataFrame) -> DataFrame:
    """The scores that some alpha below 1 flags, with the least one. Duration scores are tail masses themselves; they are
    flagged at every alpha above theirs."""
    durations = F.col("channel").isin(*channels.DURATION_CHANNELS)
    by_place = scores.filter(~durations).join(F.broadcast(tails.withColumnsRenamed({"channel": "c", "place": "p", "recipe": "r"})), F.expr("channel = c and place = p and recipe <=> r"))
    tail = F.get(F.filter("levels", lambda x: x["level"] >= F.round("value", PLACES)), F.lit(0))["tail"]
    both = by_place.withColumn("alpha", tail).select(*scores.columns, "alpha").unionByName(scores.filter(durations).withColumn("alpha", F.exp(-F.col("value"))))
    return both.withColumn("alpha", F.round("alpha", PLACES)).filter("alpha < 1")


def running_sums(rows: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """`rows` with each value replaced by its sum over the rows of the same `by` up to this one in `order`, which is unique.

    Few keys may hold all rows, so rows are dealt by ranges of (by, order): sums within ranges, and those of the ranges
    before, of which there is one row a key and range.
    """
    ranged = written(rows.repartitionByRange(*by, order).withColumn("range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(*by, "range").agg(*[F.sum(v).alias(f"{v}_before") for v in values])
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "range", *[F.coalesce(F.sum(f"{v}_before").over(earlier), F.lit(0)).alias(f"{v}_before") for v in values])
    within = Window.partitionBy(*by, "range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(offsets), [*by, "range"]).select(*[(F.sum(c).over(within) + F.col(f"{c}_before")).alias(c) if c in values else F.col(c) for c in rows.columns])


def operating_points(ticks: DataFrame, alphas: DataFrame, parts: DataFrame) -> DataFrame:
    """level (step, trial_loc), channel, part, alpha, tp, fp, fn, tn at alpha 0 and every alpha where one of these changes.

    `ticks` has (key, tick, seg_idx, is_error, is_positive) of all sequences, `alphas` (key, tick, channel, alpha), `parts`
    (key, part). A step is positive if a tick of it is. On the level of location an error that is found is tp, a flag
    elsewhere fp as well; of healthy sequences flagged ones are fp, the others tn. The union of channels is one more. What
    durations tell at an alpha holds just above it.
    """
    rows = written(ticks.join(data(parts), "key"), "parted")
    n = lambda c: F.sum(c.cast("long"))
    by_step = rows.groupBy("key", "part", "seg_idx").agg(F.bool_or("is_positive").alias("p"))
    by_key = rows.select("key", "part", "is_error").distinct()
    totals = by_step.groupBy("part").agg(n(F.col("p")).alias("positives"), n(~F.col("p")).alias("negatives")).withColumn("level", F.lit("step"))
    totals = totals.unionByName(by_key.groupBy("part").agg(n(F.col("is_error")).alias("positives"), n(~F.col("is_error")).alias("negatives")).withColumn("level", F.lit("trial_loc")))
    heard = written(rows.join(data(alphas), ["key", "tick"]), "heard").withColumn("channel", F.explode(F.array("channel", F.lit(ALL))))
    steps = heard.groupBy("key", "part", "seg_idx", "channel").agg(F.min("alpha").alias("alpha")).join(data(by_step), ["key", "part", "seg_idx"])
    step = steps.select(F.lit("step").alias("level"), "part", "channel", "alpha", F.col("p").cast("long").alias("tp"), (~F.col("p")).cast("long").alias("fp"), (~F.col("p")).cast("long").alias("tn"))
    kinds = heard.groupBy("key", "part", "is_error", "channel", "is_positive").agg(F.min("alpha").alias("alpha"))
    hit = F.col("is_error") & F.col("is_positive")
    trial = kinds.select(F.lit("trial_loc").alias("level"), "part", "channel", "alpha", hit.cast("long").alias("tp"), (~hit).cast("long").alias("fp"), (~F.col("is_error")).cast("long").alias("tn"))
    return counted(step.unionByName(trial), totals)


def points_of_steps(steps: DataFrame, keys: list[str]) -> DataFrame:
    """What `operating_points` tells, of steps (*keys, part, is_error, is_positive) with the least alpha of each channel at
    which a tick of theirs is flagged, or null. No tick and no score is a row, and steps are not joined.
    """
    n = lambda c: F.sum(c.cast("long"))
    of = lambda name: F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{name}{c}").alias("alpha")) for c in [*channels.CHANNELS, ALL]])
    steps = steps.withColumn(ALL, F.least(*channels.CHANNELS))
    p, e = F.col("is_positive"), F.col("is_error")
    mins = [F.min(F.when(cond, F.col(c))).alias(f"{name}_{c}") for c in [*channels.CHANNELS, ALL] for name, cond in (("hit", p), ("stray", ~p))]
    trials = written(steps.groupBy(*keys, "part", "is_error").agg(*mins), "located")
    by_step = steps.select("part", p.alias("p"), F.explode(of("")).alias("x")).select("part", "p", "x.*").filter("alpha is not null").groupBy("part", "p", "channel", "alpha").agg(F.count("*").alias("n"))
    totals = steps.groupBy("part").agg(n(p).alias("positives"), n(~p).alias("negatives")).withColumn("level", F.lit("step"))
    totals = totals.unionByName(trials.groupBy("part").agg(n(e).alias("positives"), n(~e).alias("negatives")).withColumn("level", F.lit("trial_loc")))
    none = F.lit(0).cast("long")
    step = by_step.select(F.lit("step").alias("level"), "part", "channel", "alpha", F.when(F.col("p"), F.col("n")).otherwise(none).alias("tp"), *[F.when(F.col("p"), none).otherwise(F.col("n")).alias(c) for c in ("fp", "tn")])
    both = [trials.select("part", "is_error", F.lit(name == "hit").alias("p"), F.explode(of(f"{name}_")).alias("x")) for name in ("hit", "stray")]
    told = both[0].unionByName(both[1]).select("part", "is_error", "p", "x.*").filter("alpha is not null").groupBy("part", "is_error", "p", "channel", "alpha").agg(F.count("*").alias("n"))
    hit = F.col("is_error") & F.col("p")
    trial = told.select(F.lit("trial_loc").alias("level"), "part", "channel", "alpha", F.when(hit, F.col("n")).otherwise(none).alias("tp"), F.when(hit, none).otherwise(F.col("n")).alias("fp"), F.when(F.col("is_error"), none).otherwise(F.col("n")).alias("tn"))
    return counted(step.unionByName(trial), totals)


def counted(flagged: DataFrame, totals: DataFrame) -> DataFrame:
    """The counts at alpha 0 and at each alpha of `flagged` (level, part, channel, alpha, tp, fp, tn), which has what that
    alpha flags first, `tn` no longer counted. `totals` has (level, part, positives, negatives).
    """
    start = totals.select("level", "part", F.explode(F.array(*map(F.lit, [*channels.CHANNELS, ALL]))).alias("channel"), F.lit(0.0).alias("alpha"), *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "tn")])
    changes = written(flagged.unionByName(start).groupBy("level", "channel", "part", "alpha").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn")]), "changes")  # ranges are told by a pass of its own
    sums = running_sums(changes, ["level", "channel", "part"], "alpha", ["tp", "fp", "tn"]).join(F.broadcast(totals), ["level", "part"])
    return sums.select("level", "channel", "part", "alpha", "tp", "fp", (F.col("positives") - F.col("tp")).alias("fn"), (F.col("negatives") - F.col("tn")).alias("tn"))


def tuned(points: DataFrame) -> DataFrame:
    """level, channel, alpha, and by part the counts and rates at that alpha.

    It is chosen on the part `train` by accuracy, the lowest of equals (0: no flag is best), and read on `test` unchanged:
    the counts of the last change there up to it.
    """
    accuracy = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    train = points.filter("part = 'train'").groupBy("level", "channel").agg(F.max(F.struct(F.round(accuracy, PLACES).alias("a"), (-F.col("alpha")).alias("b"), *COUNTS)).alias("x"))
    train = train.select("level", "channel", (-F.col("x.b")).alias("alpha"), *[F.col(f"x.{c}").alias(f"train_{c}") for c in COUNTS])
    read = points.filter("part = 'test'").join(F.broadcast(train.select("level", "channel", F.col("alpha").alias("chosen"))), ["level", "channel"]).filter(F.col("alpha") <= F.col("chosen"))
    last = read.groupBy("level", "channel").agg(F.max(F.struct("alpha", *COUNTS)).alias("z")).select("level", "channel", *[F.col(f"z.{c}").alias(f"test_{c}") for c in COUNTS])
    names = ["accuracy", "precision", "recall", "f1", "fpr"]
    shown = [c.alias(f"{part}_{name}") for part in ("train", "test") for name, c in zip(names, rates(*[F.col(f"{part}_{c}") for c in COUNTS]))]
    return train.join(last, ["level", "channel"], "left").select("level", "channel", "alpha", *[f"{p}_{c}" for p in ("train", "test") for c in COUNTS], *shown)
