"""All surprise channels of trials in one long form: scores, threshold bundle, flags, and what they say of steps.

Sequences are named by `keys`: trial_id for healthy ones, trial_id and error_type for degraded ones. The scores have
(*keys, tick, channel, place, recipe, value): `place` is the state whose threshold applies (the state before a
transition, the believed state of an emission), `recipe` is set where the threshold depends on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqwatch.operators import surprise as S

#: The channels in the order in which they name a step's type of error, and the types that they speak for.
CHANNELS = ["s_transition", "s_dur_two", "s_temporal", "s_noun", "s_verb", "s_recipe_transition", "s_emit"]
TYPE_OF = {"s_transition": "omission", "s_recipe_transition": "omission", "s_dur_two": "abandonment", "s_temporal": "repetition", "s_noun": "substitution", "s_verb": "substitution"}
DURATION_CHANNELS = ["s_temporal", "s_dur_two"]


@dataclass
class Tables:
    """What the scores are looked up in: small tables of states."""

    verbs: DataFrame
    nouns: DataFrame
    logp: DataFrame
    recipe_logp: DataFrame
    marginal: DataFrame
    tails: DataFrame
    d_max: int


def own_excess(t: Tables) -> DataFrame:
    """(recipe, from_state, state, value): how much less likely a transition is in the recipe than in all."""
    own = t.recipe_logp.select("recipe", "from_state", "to_state", "logp").join(t.marginal.select("from_state", "to_state", F.col("logp").alias("logm")), ["from_state", "to_state"])
    return own.select("recipe", "from_state", F.col("to_state").alias("state"), (F.col("logm") - F.col("logp")).alias("value"))


def scores(ticks: DataFrame, steps: DataFrame, keys: list[str], t: Tables) -> DataFrame:
    """Of ticks (*keys, tick, verb_id, noun_id) and steps (*keys, recipe, seg_idx, state, from_state, tick_start, tick_end,
    duration, is_last).

    The believed state of a tick is the verb of the tick before, so a sequence's first tick has no emission scores.
    """
    w = Window.partitionBy(*keys).orderBy("tick")
    seen = ticks.select(*keys, "tick", "verb_id", "noun_id", F.lag("verb_id").over(w).alias("place")).filter("place is not null")
    seen = seen.join(F.broadcast(t.verbs.select(F.col("state").alias("place"), "verb_id", F.col("logp").alias("lv"))), ["place", "verb_id"])
    seen = seen.join(F.broadcast(t.nouns.select(F.col("state").alias("place"), "noun_id", F.col("logp").alias("ln"))), ["place", "noun_id"])
    no_recipe = F.lit(None).cast("int").alias("recipe")
    each = F.array(*[F.struct(F.lit(c).alias("channel"), v.alias("value")) for c, v in (("s_verb", -F.col("lv")), ("s_noun", -F.col("ln")), ("s_emit", -F.col("lv") - F.col("ln")))])
    emitted = seen.select(*keys, "tick", F.explode(each).alias("e"), "place").select(*keys, "tick", "e.channel", "place", no_recipe, "e.value")
    stalled = S.live_stall(steps, t.tails, t.d_max, keys).select(*keys, "tick", F.lit("s_temporal").alias("channel"), F.col("state").alias("place"), no_recipe, F.col("s_temporal").alias("value"))
    closed = S.completed_durations(steps, t.tails, t.d_max, keys).filter("cause != 'none'").select(*keys, (F.col("tick_end") - 1).alias("tick"), F.lit("s_dur_two").alias("channel"), F.col("state").alias("place"), no_recipe, F.col("s_dur_two").alias("value"))
    moved = steps.filter("from_state is not null").join(F.broadcast(t.logp.select("from_state", F.col("to_state").alias("state"), "logp")), ["from_state", "state"])
    order = moved.select(*keys, F.col("tick_start").alias("tick"), F.lit("s_transition").alias("channel"), F.col("from_state").alias("place"), no_recipe, (-F.col("logp")).alias("value"))
    excess = steps.filter("from_state is not null").join(F.broadcast(own_excess(t)), ["recipe", "from_state", "state"])
    excess = excess.select(*keys, F.col("tick_start").alias("tick"), F.lit("s_recipe_transition").alias("channel"), F.col("from_state").alias("place"), "recipe", "value")
    return reduce(DataFrame.unionByName, [emitted, stalled, closed, order, excess])


def bundle(t: Tables, alphas: list[float], overrides: dict[str, float] | None = None) -> DataFrame:
    """(channel, place, recipe, alpha, threshold) of all channels; each is computed once for all alphas.

    Duration channels have one threshold, -log alpha, for all states (place null). `overrides` may set that of a duration
    channel; the other channels are calibrated by state, and to override one is an error.
    """
    if unknown := {*(overrides or {})} - {*DURATION_CHANNELS}:
        raise KeyError(f"only {', '.join(DURATION_CHANNELS)} can be overridden, not {min(unknown)}")
    none = F.lit(None).cast("int")
    found = {
        "s_verb": S.token_thresholds(t.verbs, "verb_id", alphas).select(F.col("state").alias("place"), none.alias("recipe"), "alpha", "threshold"),
        "s_noun": S.token_thresholds(t.nouns, "noun_id", alphas).select(F.col("state").alias("place"), none.alias("recipe"), "alpha", "threshold"),
        "s_emit": S.pair_thresholds(t.verbs, t.nouns, alphas).select(F.col("state").alias("place"), none.alias("recipe"), "alpha", "threshold"),
        "s_transition": S.transition_thresholds(t.logp, alphas).select(F.col("from_state").alias("place"), none.alias("recipe"), "alpha", "threshold"),
        "s_recipe_transition": S.excess_thresholds(t.recipe_logp, t.marginal, alphas).select(F.col("from_state").alias("place"), "recipe", "alpha", "threshold"),
    }
    one = t.logp.sparkSession.range(1)
    for c in DURATION_CHANNELS:
        levels = [F.struct(F.lit(a).alias("alpha"), (F.lit(overrides[c]) if c in (overrides or {}) else F.round(-F.log(F.lit(a)), S.PLACES)).alias("threshold")) for a in alphas]
        found[c] = one.select(F.explode(F.array(*levels)).alias("x")).select(none.alias("place"), none.alias("recipe"), "x.alpha", "x.threshold")
    return reduce(DataFrame.unionByName, [rows.select(F.lit(c).alias("channel"), "place", "recipe", "alpha", "threshold") for c, rows in found.items()])


def flagged(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The scores above their thresholds, with `alpha` and `threshold`; the bundle is a small table."""
    by_state = rows.join(F.broadcast(thresholds.filter("place is not null").withColumnsRenamed({"place": "p", "channel": "c", "recipe": "r"})), F.expr("channel = c and place = p and recipe <=> r")).drop("p", "c", "r")
    overall = rows.join(F.broadcast(thresholds.filter("place is null").drop("place", "recipe")), "channel")
    both = by_state.unionByName(overall.select(*by_state.columns))
    return both.filter(F.round("value", S.PLACES) > F.col("threshold"))


def wide(flags: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each tick with a flag: a boolean for each channel."""
    return flags.groupBy(*keys, "tick").agg(*[F.bool_or(F.col("channel") == c).alias(c) for c in sorted(CHANNELS)])


def least_cells(t: Tables, judged: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """Of all scores that the tables allow, the least alpha that flags them, null for none: a column a channel. `judged`
    gives of scores those that some alpha flags, with such alphas.

    A score depends on few values: the believed state, verb and item of a tick (`emitted`), the state and length of a
    step (`lengths`, up to `d_max`; with `stuck`), the states of a transition (`moves`), and the recipe too (`excess`). As
    thresholds fall with alpha, all greater alphas flag it as well.
    """
    no_recipe = F.lit(None).cast("int").alias("recipe")

    def least(values: DataFrame, cell: list[str], names: list[str]) -> DataFrame:
        found = judged(values).groupBy(*cell).agg(*[F.min(F.when(F.col("channel") == c, F.col("alpha"))).alias(c) for c in names])
        return found.coalesce(1)  # as few as the tables' cells

    both = t.verbs.select(F.col("state").alias("place"), "verb_id", F.col("logp").alias("lv")).join(t.nouns.select(F.col("state").alias("place"), "noun_id", F.col("logp").alias("ln")), "place")
    each = F.array(*[F.struct(F.lit(c).alias("channel"), v.alias("value")) for c, v in (("s_verb", -F.col("lv")), ("s_noun", -F.col("ln")), ("s_emit", -F.col("lv") - F.col("ln")))])
    emitted = both.select("place", "verb_id", "noun_id", no_recipe, F.explode(each).alias("e")).select("place", "verb_id", "noun_id", "recipe", "e.*")
    shares = S.survival(t.tails)
    spine = shares.select("state", "top").distinct().withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(t.d_max)))).withColumn("e", F.least("d", "top"))
    stalled = spine.join(shares.drop("top"), ["state", "e"]).select("state", "d", F.lit("s_temporal").alias("channel"), (-F.log("p")).alias("value"))
    lasting = t.tails.select("state", F.col("d").alias("duration"), F.lit(False).alias("is_last"), F.lit(0).alias("seg_idx"), F.lit(0).alias("tick_end"))
    closed = S.completed_durations(lasting, t.tails, t.d_max, []).select("state", F.col("duration").alias("d"), F.lit("s_dur_two").alias("channel"), F.col("s_dur_two").alias("value"))
    lengths = least(stalled.unionByName(closed).select("state", "d", F.col("state").alias("place"), no_recipe, "channel", "value"), ["state", "d"], DURATION_CHANNELS)
    moves = t.logp.select("from_state", F.col("to_state").alias("state"), F.col("from_state").alias("place"), no_recipe, F.lit("s_transition").alias("channel"), (-F.col("logp")).alias("value"))
    excess = own_excess(t).select("*", F.col("from_state").alias("place"), F.lit("s_recipe_transition").alias("channel"))
    return {
        "emitted": least(emitted, ["place", "verb_id", "noun_id"], ["s_verb", "s_noun", "s_emit"]),
        "lengths": lengths.join(t.tails.select("state", "d", (F.col("p_ge") < F.col("p_le")).alias("stuck")), ["state", "d"], "left"),
        "moves": least(moves, ["from_state", "state"], ["s_transition"]),
        "excess": least(excess, ["recipe", "from_state", "state"], ["s_recipe_transition"]),
    }


def least_by_step(ticks: DataFrame, sequences: DataFrame, keys: list[str], cells: dict[str, DataFrame], d_max: int) -> DataFrame:
    """(*keys, other columns of `sequences`, seg_idx, state, tick_start, tick_end, touched, stuck) of each step, and for each
    channel the least alpha at which one of the step's ticks is flagged, or null.

    Ticks (*keys, tick, verb_id, noun_id, seg_idx, touched) meet the cells of `least_cells` where they are; they are
    sorted once, by sequence, and no score is a row. `sequences` has (*keys, recipe) and more. A stall grows within a
    step, so that its last tick has the least alpha.
    """
    w = Window.partitionBy(*keys).orderBy("tick")
    rows = ticks.withColumn("place", F.lag("verb_id").over(w)).withColumn("ends", F.lead("tick").over(w).isNull())
    rows = rows.join(F.broadcast(cells["emitted"]), ["place", "verb_id", "noun_id"], "left")
    steps = rows.groupBy(*keys, "seg_idx", F.col("verb_id").alias("state")).agg(
        F.min("tick").alias("tick_start"),
        (F.max("tick") + 1).cast("int").alias("tick_end"),
        F.min_by("place", "tick").alias("from_state"),
        F.bool_or("ends").alias("is_last"),
        F.bool_or("touched").alias("touched"),
        *[F.min(c).alias(c) for c in ("s_verb", "s_noun", "s_emit")],
    )
    steps = steps.withColumn("d", F.least(F.col("tick_end") - F.col("tick_start"), F.lit(d_max)))
    steps = steps.join(sequences.hint("merge"), keys, "left").join(F.broadcast(cells["lengths"]), ["state", "d"], "left")
    steps = steps.join(F.broadcast(cells["moves"]), ["from_state", "state"], "left").join(F.broadcast(cells["excess"]), ["recipe", "from_state", "state"], "left")
    return steps.withColumn("s_dur_two", F.when(~F.col("is_last"), F.col("s_dur_two"))).drop("d", "is_last", "from_state")


def predicted_type() -> Column:
    """Of steps with a column a channel, null if it isn't flagged: the type of error that the first flagged channel speaks
    for, or null. A duration flag speaks for repetition where the segment was long (`stuck`), else for abandonment."""
    kinds = {c: F.lit(k) for c, k in TYPE_OF.items()} | {"s_dur_two": F.when(F.col("stuck"), "repetition").otherwise(TYPE_OF["s_dur_two"])}
    return F.coalesce(*[F.when(F.col(c).isNotNull(), kinds[c]) for c in CHANNELS if c in kinds])


def level_counts(ticks: DataFrame, by: Iterable[str], keys: list[str]) -> DataFrame:
    """Confusion counts of ticks (*keys, seg_idx, is_error, is_positive, is_flagged) by level: tick, step, trial, trial_loc.

    On the level of location a found error is tp, a missed one fn, and a flag outside the positive ticks fp as well; of
    healthy sequences, flagged ones are fp on both trial levels.
    """
    steps = ticks.groupBy(*by, *keys, "seg_idx", "is_error").agg(F.bool_or("is_positive").alias("p"), F.bool_or("is_flagged").alias("f"))
    trials = ticks.groupBy(*by, *keys, "is_error").agg(F.bool_or("is_flagged").alias("f"), F.bool_or(F.col("is_flagged") & F.col("is_positive")).alias("hit"), F.bool_or(F.col("is_flagged") & ~F.col("is_positive")).alias("stray"))
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")

    def cells(rows: DataFrame, level: str, p: Column, f: Column, fp: Column | None = None) -> DataFrame:
        return rows.groupBy(*by).agg(n(p & f).alias("tp"), n(~p & f if fp is None else fp).alias("fp"), n(p & ~f).alias("fn"), n(~p & ~f).alias("tn")).select(*by, F.lit(level).alias("level"), "tp", "fp", "fn", "tn")

    e, f = F.col("is_error"), F.col("f")
    return reduce(
        DataFrame.unionByName,
        [
            cells(ticks, "tick", F.col("is_positive"), F.col("is_flagged")),
            cells(steps, "step", F.col("p"), f),
            cells(trials, "trial", e, f),
            cells(trials.withColumn("f", F.when(e, F.col("hit")).otherwise(f)), "trial_loc", e, f, F.when(e, F.col("stray")).otherwise(f)),
        ],
    )


def located(steps: DataFrame, by: list, positive: Column) -> DataFrame:
    """By sequence and channel, the least alpha that flags a positive step (hit_*) and another one (stray_*)."""
    return steps.groupBy(*by).agg(*[F.min(F.when(p, F.col(c))).alias(f"{name}_{c}") for c in CHANNELS for name, p in (("hit", positive), ("stray", ~positive))])


def found_by(name: str, channel: str, alpha: float | Column) -> Column:
    """Whether a hit or stray flag of a sequence is told at an alpha."""
    return F.coalesce(F.col(f"{name}_{channel}") <= alpha, F.lit(False))


def coordinate_sweep(trials: DataFrame, channels: list[str], alphas: list[float], start: float, rounds: int = 2) -> list[tuple[str, float, float]]:
    """(channel, alpha, F1 of the union after it was chosen), one channel after another, in `rounds` passes.

    `trials` has is_error and the columns of `located`. A channel's alpha is the one by which the union of all channels
    locates errors best, the others staying; the lowest of equals. All alphas of a channel are counted in one pass
    over the trials, without a join. Without trials every F1 is 0.
    """
    chosen, out = {c: start for c in channels}, []
    n = lambda x: F.coalesce(F.sum(x.cast("int")), F.lit(0))
    e = F.col("is_error")
    for _ in range(rounds):
        for c in channels:
            sums = []
            for k, a in enumerate(alphas):
                at = chosen | {c: a}
                h, s = (reduce(lambda x, y: x | y, [found_by(name, o, at[o]) for o in channels]) for name in ("hit", "stray"))
                sums += [n(e & h).alias(f"tp{k}"), n(F.when(e, s).otherwise(h | s)).alias(f"fp{k}"), n(e & ~h).alias(f"fn{k}")]
            r = trials.agg(*sums).first()
            f1 = {a: 2 * r[f"tp{k}"] / max(1, 2 * r[f"tp{k}"] + r[f"fp{k}"] + r[f"fn{k}"]) for k, a in enumerate(alphas)}
            best = min(f1, key=lambda a: (-round(f1[a], 9), a))
            chosen[c] = best
            out.append((c, best, f1[best]))
    return out


def created_junctions(degraded: DataFrame, segments: DataFrame) -> DataFrame:
    """(trial_id, error_type, from_state, to_state) of junctions between source segments that the healthy trial lacks."""
    spans = segments.select("trial_id", "state", F.explode(F.sequence("tick_start", F.col("tick_end") - 1)).alias("src_tick"))
    w = Window.partitionBy("trial_id", "error_type").orderBy("tick")
    mapped = degraded.select("trial_id", "error_type", "tick", "src_tick").join(spans, ["trial_id", "src_tick"]).withColumn("from_state", F.lag("state").over(w)).filter("from_state != state")
    pairs = segments.select("trial_id", F.lag("state").over(Window.partitionBy("trial_id").orderBy("seg_idx")).alias("from_state"), "state").filter("from_state is not null").distinct()
    return mapped.join(pairs, ["trial_id", "from_state", "state"], "left_anti").select("trial_id", "error_type", "from_state", F.col("state").alias("to_state"))
