"""A start of the joint model without a fit: each frequent pair of verb and noun is a state, anchored to its own tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqwatch.functions import runs as R
from seqwatch.operators import counts as C
from seqwatch.sources.durable import written

#: The mass of a state's own token, the mass shared by all tokens, the ticks that make a pair a state.
ANCHOR, BACKGROUND, MIN_TICKS = 50.0, 1.0, 5


def pair_states(ticks: DataFrame, min_ticks: int = MIN_TICKS) -> DataFrame:
    """verb_id, noun_id, n, state: pairs with enough ticks, numbered from the most frequent; of equals the smaller ids first."""
    order = Window.orderBy(F.desc("n"), "verb_id", "noun_id")  # one row a pair of the vocabularies
    return C.observed_pairs(ticks, min_ticks).withColumn("state", (F.row_number().over(order) - 1).cast("int"))


def pair_segments(ticks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Runs of states by trial; ticks of other pairs count to the state before them, at the start to the next, else to 0."""
    known = F.broadcast(pairs.select("verb_id", "noun_id", "state"))  # a vocabulary
    rows = ticks.select("trial_id", "recipe", "tick", "verb_id", "noun_id").join(known, ["verb_id", "noun_id"], "left")
    return R.runs(R.absorb(rows, "state", pairs.select("state")), ["state"], keep=["recipe"])


def anchored(pairs: DataFrame, tokens: DataFrame, token: str, anchor: float = ANCHOR, background: float = BACKGROUND) -> DataFrame:
    """state, token, logp: the background spread over all tokens, and the anchor on the state's own."""
    width = tokens.agg(F.count("*").alias("width"))
    cells = pairs.select("state", F.col(token).alias("own")).join(F.broadcast(tokens.select(token)), F.lit(True)).join(F.broadcast(width), F.lit(True))  # states times tokens, one width
    mass = background / F.col("width") + F.when(F.col("own") == F.col(token), anchor).otherwise(0.0)
    return cells.select("state", token, F.log(mass / (anchor + background)).alias("logp"))


def lexical_start(ticks: DataFrame, min_ticks: int = MIN_TICKS, tau: float = 5.0, init_scale: float = 5.0, d_max: int = 50) -> DataFrame:
    """The parameters in long form (family, recipe, i, j, value), counted in one cut of the ticks into segments.

    `recipe`: log shares of trials, one added to each. `init` and `trans`: log probabilities by recipe, shrunk to the
    pooled ones with weights `init_scale` and `tau`. `verb`, `noun`: anchored emissions. `dur_r`, `dur_p`: moments by
    state. Only the segments grow with the input; all else is of the size of the vocabularies.
    """
    pairs = written(pair_states(ticks, min_ticks).coalesce(1), "pairs")
    segments = written(pair_segments(ticks, pairs), "pair-segments")
    whole = Window.partitionBy()
    first = C.initial_counts(segments, ["recipe"])
    trials = first.groupBy("recipe").agg(F.sum("n").alias("trials"))
    share = (F.col("trials") + 1.0) / F.sum(F.col("trials") + 1.0).over(whole)
    pooled = first.groupBy("state").agg(F.sum("n").alias("pool")).withColumn("share", F.col("pool") / F.sum("pool").over(whole))
    init = trials.join(F.broadcast(pooled), F.lit(True)).join(first, ["recipe", "state"], "left")  # recipes times states
    init_value = F.log((F.coalesce("n", F.lit(0)) + init_scale * F.col("share")) / (F.col("trials") + init_scale))
    trans = C.backoff(C.transition_counts(segments, ["recipe"]), tau).filter("from_state != to_state")
    moved = F.log(F.col("n") / F.sum("n").over(Window.partitionBy("recipe", "from_state")))
    moments = C.duration_moments(C.duration_counts(segments, d_max))
    none = F.lit(None).cast("int")

    def family(rows: DataFrame, name: str, value: Column, recipe: Column = none, i: Column = none, j: Column = none) -> DataFrame:
        return rows.select(F.lit(name).alias("family"), recipe.alias("recipe"), i.alias("i"), j.alias("j"), value.alias("value"))

    r, s = F.col("recipe"), F.col("state")
    return reduce(
        DataFrame.unionByName,
        [
            family(trials, "recipe", F.log(share), r),
            family(init, "init", init_value, r, s),
            family(trans, "trans", moved, r, F.col("from_state"), F.col("to_state")),
            *[family(anchored(pairs, ticks.select(t).distinct(), t), name, F.col("logp"), i=s, j=F.col(t)) for name, t in (("verb", "verb_id"), ("noun", "noun_id"))],
            *[family(moments, f"dur_{x}", F.col(x), i=s) for x in ("r", "p")],
        ],
    )
