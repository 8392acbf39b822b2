"""Counts over segments and their normalisation: transitions, durations, labels against clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-12


def initial_counts(segments: DataFrame, by: list[str] = ()) -> DataFrame:
    return segments.filter("seg_idx = 0").groupBy(*by, "state").agg(F.count("*").alias("n"))


def transitions(segments: DataFrame, by: list[str] = ()) -> DataFrame:
    """Each pair of successive segments: trial_id, seg_idx of the first, from_state, to_state."""
    following = F.lead("state").over(Window.partitionBy("trial_id").orderBy("seg_idx"))
    return segments.withColumn("to_state", following).filter("to_state is not null").select("trial_id", *by, "seg_idx", F.col("state").alias("from_state"), "to_state", "tick_end")


def transition_counts(segments: DataFrame, by: list[str] = ()) -> DataFrame:
    return transitions(segments, by).groupBy(*by, "from_state", "to_state").agg(F.count("*").alias("n"))


def duration_counts(segments: DataFrame, d_max: int, by: list[str] = ()) -> DataFrame:
    """n by state and duration; longer durations count as d_max."""
    return segments.groupBy(*by, "state", F.least("duration", F.lit(d_max)).alias("d")).agg(F.count("*").alias("n"))


def observed_pairs(ticks: DataFrame, min_ticks: int) -> DataFrame:
    """Ticks by (verb_id, noun_id), of pairs with enough of them."""
    return ticks.groupBy("verb_id", "noun_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_ticks)


def pair_bags(ticks: DataFrame) -> DataFrame:
    """Each trial's shares of pairs, scaled to unit length."""
    n = ticks.groupBy("trial_id", "verb_id", "noun_id").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("trial_id")
    share = F.col("n") / F.sum("n").over(whole)
    return n.withColumn("share", share).select("trial_id", "verb_id", "noun_id", (F.col("share") / F.sqrt(F.sum(F.col("share") * F.col("share")).over(whole))).alias("weight"))


def map_rows(spine: DataFrame, counts: DataFrame, row: list[str], column: str, no_self: bool = False, floor: float = FLOOR) -> DataFrame:
    """Log probabilities of each row of counts at the mode of its Dirichlet posterior; absent cells count 0.

    A cell's mass is its count less 1, at least `floor`. With `no_self`, cells of a state with itself have no mass
    and no row here.
    """
    cells = spine.join(counts.select(*row, column, "n"), [*row, column], "left")
    if no_self:
        cells = cells.filter(F.col(row[-1]) != F.col(column))
    mass = F.greatest(F.coalesce("n", F.lit(0)) - F.lit(1.0), F.lit(floor))
    whole = Window.partitionBy(*row)
    return cells.withColumn("mass", mass).withColumn("logp", F.log("mass") - F.log(F.greatest(F.sum("mass").over(whole), F.lit(floor)))).drop("mass", "n")


def state_spine(states: DataFrame) -> DataFrame:
    """All (from_state, to_state) of a small table of states."""
    ids = states.select("state").distinct()
    return ids.withColumnRenamed("state", "from_state").join(ids.withColumnRenamed("state", "to_state"), F.lit(True))


def log_transitions(segments: DataFrame) -> DataFrame:
    """from_state, to_state, logp over all states that occur."""
    return map_rows(state_spine(segments), transition_counts(segments), ["from_state"], "to_state", no_self=True)


def backoff(counts: DataFrame, tau: float) -> DataFrame:
    """Adds tau times the pooled row of all recipes, off the diagonal, to each recipe's transition counts."""
    pooled = counts.filter("from_state != to_state").groupBy("from_state", "to_state").agg(F.sum("n").alias("pool"))
    share = F.col("pool") / F.sum("pool").over(Window.partitionBy("from_state"))
    pooled = pooled.select("from_state", "to_state", share.alias("share"))
    cells = counts.select("recipe").distinct().join(pooled, F.lit(True))  # recipes times cells of one small table
    joined = cells.join(counts, ["recipe", "from_state", "to_state"], "left")
    return joined.select("recipe", "from_state", "to_state", (F.coalesce("n", F.lit(0)) + tau * F.col("share")).alias("n"))


def mode_shift(counts: DataFrame, strength: float) -> DataFrame:
    return counts.withColumn("n", F.col("n") + F.when(F.col("from_state") != F.col("to_state"), strength).otherwise(0.0))


def recipe_shares(trials: DataFrame) -> DataFrame:
    n = trials.groupBy("recipe").agg(F.count("*").alias("n"))
    return n.select("recipe", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))


def collapse(counts: DataFrame, shares: DataFrame) -> DataFrame:
    """Counts of one model in place of one for each recipe: the mean weighted by the recipes' shares."""
    return counts.join(shares, "recipe").groupBy("from_state", "to_state").agg(F.sum(F.col("share") * F.col("n")).alias("n"))


def marginal_transitions(logp: DataFrame, shares: DataFrame) -> DataFrame:
    """Log of the shares' mixture of the recipes' transition probabilities."""
    mixed = logp.join(shares, "recipe").groupBy("from_state", "to_state").agg(F.sum(F.col("share") * F.exp("logp")).alias("p"))
    return mixed.select("from_state", "to_state", F.log(F.greatest("p", F.lit(FLOOR))).alias("logp"))


def duration_moments(histogram: DataFrame, r_max: float = 1e4, fallback: float = 5.0) -> DataFrame:
    """By state: n, s (sum of d - 1), the moment estimate of r, p given r, and the mean duration of the fit."""
    sums = histogram.groupBy("state").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("d") - 1)).alias("s"), F.sum(F.col("n") * (F.col("d") - 1) * (F.col("d") - 1)).alias("q"))
    mean = F.col("s") / F.col("n")
    var = F.col("q") / F.col("n") - mean * mean
    r = F.when((var > mean) & (mean > 0), F.least(mean * mean / F.nullif(var - mean, F.lit(0.0)), F.lit(r_max))).otherwise(fallback)
    out = sums.withColumn("r", r).withColumn("p", F.greatest(F.least(F.col("r") * F.col("n") / (F.col("r") * F.col("n") + F.col("s") + 1e-8), F.lit(1 - 1e-8)), F.lit(1e-8)))
    return out.select("state", "n", "s", "r", "p", (1 + F.col("r") * (1 - F.col("p")) / F.col("p")).alias("mean_duration"))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings; 1 where it isn't defined."""
    cells = contingency(rows, a, b)
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    side = lambda k: cells.groupBy(k).agg(F.sum("n").alias("m")).agg(F.sum(pairs("m")).alias(f"in_{k}"))
    one = cells.agg(F.sum(pairs("n")).alias("both"), F.sum("n").alias("m")).withColumn("all", pairs("m"))
    joined = one.join(side("a"), F.lit(True)).join(side("b"), F.lit(True))  # one row each
    expected = F.col("in_a") * F.col("in_b") / F.nullif("all", F.lit(0.0))
    most = (F.col("in_a") + F.col("in_b")) / 2
    return joined.select(F.coalesce((F.col("both") - expected) / F.nullif(most - expected, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def effective_clusters(rows: DataFrame, cluster: str, min_frac: float = 0.02) -> DataFrame:
    n = rows.groupBy(cluster).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return n.join(total, F.lit(True)).filter(F.col("n") >= min_frac * F.col("total")).agg(F.count("*").alias("effective_k"))


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's most frequent value, the smaller of equals."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    best = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return n.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select(key, value, "n")


def divergence(p: DataFrame, q: DataFrame, row: str, column: str) -> DataFrame:
    """Kullback-Leibler divergence of each row of two tables of log probabilities."""
    joined = p.select(row, column, F.col("logp").alias("lp")).join(q.select(row, column, F.col("logp").alias("lq")), [row, column])
    return joined.groupBy(row).agg(F.sum(F.when(F.col("lp") > -700, F.exp("lp") * (F.col("lp") - F.col("lq"))).otherwise(0.0)).alias("kl"))
