"""Traces: what a fitted model makes of each trial, tick by tick, from passes of recursions over batches of trials.

A trial is first given its likeliest recipe, then goes to a task that holds that recipe's tables, where it is filtered,
decoded and scored. Sequences are named by `keys`, as in `operators.channels`, whose flags the scores feed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from seqwatch.functions import kernels
from seqwatch.functions.special import nb_log_cdf, nb_log_pmf, nb_log_survival
from seqwatch.operators import channels, narrate, sequence
from seqwatch.operators import surprise as S
from seqwatch.plans.decode import Model, dealt, looks, segments_by_trial
from seqwatch.plans.joint import JointModel
from seqwatch.plans.recipes import RecipeModel
from seqwatch.sources.durable import written

#: Trials of one recipe in one group of a task.
TRIALS_OF_PART = 1000
#: A state's share of a belief that is told; what all others have is told as one number.
LEAST_BELIEF = 1e-3
#: Emission scores are mixtures over a belief and thresholds those of one state: equal numbers by two ways differ by noise.
NOISE = 1e-6

TRACE = (
    "tick int, seg_idx int, z_star int, from_state int, from_recipe int, recipe int, s_verb double, s_noun double, s_emit double, s_temporal double, "
    "s_dur_long double, s_dur_short double, s_dur_two double, cause string, pit double, s_transition double, s_recipe_transition double, "
    "expected_verb int, expected_noun int, expected_state int, pi_max double, pi_z double, belief array<struct<state: int, p: double>>, dropped double"
)
SEGMENTS = "seg_idx int, state int, tick_start int, tick_end int, duration int, is_last boolean, recipe int"


def _typed(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)


def packed(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, verb_ids, noun_ids in order of ticks, dealt evenly: recursions cost much more than the bytes of a trial tell,
    so small partitions aren't merged."""
    t = F.array_sort(F.collect_list(F.struct("tick", "verb_id", "noun_id")))
    return dealt(ticks, keys).groupBy(*keys).agg(t.alias("t")).select(*keys, F.col("t.verb_id").alias("verb_ids"), F.col("t.noun_id").alias("noun_ids"))


def recipes_of(trials: DataFrame, model: JointModel, keys: list[str]) -> DataFrame:
    """Packed trials with `recipe`, the likeliest one (the first of equals), and rho, the posterior of each recipe.

    Every trial meets every recipe's tables here, so the model is broadcast.
    """
    shared = trials.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        tables = [m.recipe(r).durations() for r in range(len(m.pi))]
        for b in batches:
            weights = np.empty((len(b), len(m.pi)))
            for some, v, n, size in kernels.columns(b["verb_ids"], b["noun_ids"], states=m.init.shape[1]):
                look = looks(m.verbs, m.nouns, v, n)
                weights[some] = np.stack([m.pi[r] + kernels.likelihoods(look, size, m.init[r], m.trans[r], *t) for r, t in enumerate(tables)], 1)
            b["recipe"] = weights.argmax(1)
            b["rho"] = list(np.exp(weights - kernels.lse(weights, 1)[:, None]))
            yield b

    return trials.mapInPandas(run, f"{_typed(trials, keys)}verb_ids array<int>, noun_ids array<int>, recipe int, rho array<double>")


def slices(spark: SparkSession, model: JointModel) -> DataFrame:
    """One row for each recipe: its own tables, flat."""
    rows = [(r, model.init[r].tolist(), model.trans[r].reshape(-1).tolist(), model.r[r].tolist(), model.p[r].tolist()) for r in range(len(model.pi))]
    return spark.createDataFrame(rows, "recipe int, init array<double>, trans array<double>, r array<double>, p array<double>")


def conditioned(trials: DataFrame, model: JointModel, keys: list[str], kernel: Callable, schema: str) -> DataFrame:
    """`kernel(verb_ids, noun_ids, lengths, model, pmf, survival, recipe)` of batches of packed trials of one recipe, under
    the tables of this recipe. It returns the place in the batch of each of its rows, and their columns.

    Trials go to their recipe's slice by a join of groups: a task reads the slices of its own recipes only. A recipe
    with many trials is dealt to several groups, so that none holds more than a bounded number.
    """
    spark = trials.sparkSession
    trials = written(trials.select(*keys, "verb_ids", "noun_ids", "recipe"), "trials")
    n_parts = trials.groupBy("recipe").agg(F.ceil(F.count("*") / TRIALS_OF_PART).cast("int").alias("parts"))  # one row a recipe
    left = trials.join(F.broadcast(n_parts), "recipe").withColumn("part", F.pmod(F.xxhash64(*keys), "parts").cast("int")).select(*keys, "verb_ids", "noun_ids", "recipe", "part")
    right = slices(spark, model).join(F.broadcast(n_parts), "recipe").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    shared = spark.sparkContext.broadcast((model.verbs, model.nouns, model.d_max))  # of all recipes alike
    out = to_arrow_schema(StructType([*(trials.schema[k] for k in keys), *_parse_datatype_string(schema)]))

    def run(some: pa.Table, tables: pa.Table) -> pa.Table:
        verbs, nouns, d_max = shared.value
        init, trans, r, p = (np.array(tables[c][0].as_py()) for c in ("init", "trans", "r", "p"))
        own = Model(init, trans.reshape(len(init), -1), verbs, nouns, r, p, d_max)
        found = []
        sequences = [[np.asarray(x) for x in some[c].to_pylist()] for c in ("verb_ids", "noun_ids")]
        for at, v, n, size in kernels.columns(*sequences, states=len(init)):
            owner, rows = kernel(v, n, size, own, *own.durations(), tables["recipe"][0].as_py())
            found.append(pa.table([*(some[k].take(pa.array(at[owner])) for k in keys), *(rows[c] for c in out.names[len(keys) :])], names=out.names).cast(out))
        return pa.concat_tables(found) if found else out.empty_table()

    by = ["recipe", "part"]
    return dealt(left, by).groupBy(*by).cogroup(dealt(right, by).groupBy(*by)).applyInArrow(run, _typed(trials, keys) + schema)


def decode_conditioned(trials: DataFrame, model: JointModel, keys: list[str]) -> DataFrame:
    """The likeliest segments of each packed trial under its own recipe."""

    def kernel(v, n, size, own, pmf, survival, recipe):
        counts, states, d, _ = kernels.viterbi_all(looks(own.verbs, own.nouns, v, n), size, own.init, own.trans, pmf, survival)
        owner, seg, start = segments_by_trial(counts, d)
        rows = {"seg_idx": seg, "state": states, "tick_start": start, "tick_end": start + d, "duration": d, "is_last": seg == counts[owner] - 1, "recipe": np.full(len(d), recipe)}
        return owner, {c: pa.array(x) for c, x in rows.items()}

    return conditioned(trials, model, keys, kernel, SEGMENTS)


def traces_of(v: np.ndarray, n: np.ndarray, size: np.ndarray, own: Model, pmf: np.ndarray, survival: np.ndarray, recipe: int, marginal: np.ndarray | None = None, hmm: RecipeModel | None = None) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(owner of each tick, its columns): the traces of sequences (T, B): decoded segments, belief before each tick, and all
    surprises.

    With `marginal`, log transitions of all recipes together, s_recipe_transition is what the recipe's own ones add to
    the surprise. With `hmm`, each segment has the likeliest recipe of an HMM over the decoded segments, and the channel
    is the surprise of its moves. Scores of segments stand at their first tick (moves) or last one (durations of closed
    segments), and are null elsewhere.
    """
    look = looks(own.verbs, own.nouns, v, n)
    log_belief, *_ = kernels.forward_all(look, size, own.init, own.trans, pmf, survival)
    counts, states, d, _ = kernels.viterbi_all(look, size, own.init, own.trans, pmf, survival)
    seg_owner, seg_idx, start = segments_by_trial(counts, d)
    at = np.repeat(np.arange(len(d)), d)  # the segment of each tick; ticks are in order of sequences
    owner, z = seg_owner[at], states[at]
    t = np.arange(len(at)) - (np.cumsum(size) - size)[owner]
    log_belief, look, v, n = log_belief[t, :, owner], look[t, :, owner], v[t, owner], n[t, owner]
    belief = np.exp(log_belief)
    told = belief >= LEAST_BELIEF
    rows = {"tick": t, "seg_idx": seg_idx[at], "z_star": z, "recipe": np.full(len(t), recipe)}
    rows |= {"s_verb": -kernels.lse(log_belief + own.verbs[:, v].T, 1), "s_noun": -kernels.lse(log_belief + own.nouns[:, n].T, 1), "s_emit": -kernels.lse(log_belief + look, 1)}
    rows |= {"s_temporal": -survival[z, np.minimum(t - start[at], own.d_max - 1)], "expected_verb": own.verbs.argmax(1)[z], "expected_noun": own.nouns.argmax(1)[z]}
    rows |= {"pi_max": belief.max(1), "pi_z": belief[np.arange(len(t)), z], "dropped": np.where(told, 0.0, belief).sum(1)}
    path = None
    if hmm is not None:
        path = np.empty(len(d), int)
        first = np.cumsum(counts) - counts
        for some, symbols, many in kernels.columns([states[f : f + c] for f, c in zip(first, counts)], states=len(hmm.init)):
            likeliest = kernels.hmm_expectations_all(symbols, many, hmm.init, hmm.trans, hmm.emit)[0].argmax(1)
            for k, b in enumerate(some):
                path[first[b] : first[b] + counts[b]] = likeliest[: many[k], k]
        rows["recipe"] = path[at]
    closed = np.flatnonzero(seg_idx < counts[seg_owner] - 1)  # a segment follows
    a, b, ended = states[closed], states[closed + 1], d[closed]
    lengths = np.arange(1, own.d_max + 1)[None]
    r, p = own.r[:, None], own.p[:, None]
    longer, cdf, mass = (x[a, ended - 1] for x in (nb_log_survival(lengths, r, p), nb_log_cdf(lengths, r, p), np.exp(nb_log_pmf(lengths, r, p))))
    below = np.where(ended <= 1, 0.0, np.exp(nb_log_cdf(np.maximum(lengths - 1, 1), r, p))[a, ended - 1])
    end = np.cumsum(d)
    last, begun = end[closed] - 1, end[closed]  # ticks of all sequences

    def only(where, values, kind=float):
        out, missing = np.zeros(len(t), kind), np.ones(len(t), bool)
        out[where], missing[where] = values, False
        return pa.array(out, mask=missing)

    found = {c: pa.array(x) for c, x in rows.items()}
    found["s_dur_long"], found["s_dur_short"] = only(last, -longer), only(last, -cdf)
    found["s_dur_two"] = only(last, np.maximum(0.0, -(np.log(2.0) + np.minimum(longer, cdf))))
    found["cause"] = only(last, np.where(longer < cdf, "stuck", "left_early"), object)
    found["pit"] = only(last, below + 0.5 * mass)
    found["s_transition"], found["from_state"], found["expected_state"] = only(begun, -own.trans[a, b]), only(begun, a, int), only(begun, own.trans.argmax(1)[a], int)
    found["s_recipe_transition"], found["from_recipe"] = only([], []), only([], [], int)
    if marginal is not None:
        found["s_recipe_transition"] = only(begun, marginal[a, b] - own.trans[a, b])
    if path is not None:
        found["s_recipe_transition"], found["from_recipe"] = only(begun, -hmm.trans[path[closed], path[closed + 1]]), only(begun, path[closed], int)
    tick, state = np.nonzero(told)
    shares = pa.StructArray.from_arrays([pa.array(state.astype(np.int32)), pa.array(belief[tick, state])], names=["state", "p"])
    found["belief"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(told.sum(1))]).astype(np.int32)), shares)
    return owner, found


def trace_of(v: np.ndarray, n: np.ndarray, own: Model, pmf: np.ndarray, survival: np.ndarray, recipe: int, marginal: np.ndarray | None = None, hmm: RecipeModel | None = None) -> pd.DataFrame:
    """The trace of one sequence."""
    return pa.table(traces_of(v[:, None], n[:, None], np.array([len(v)]), own, pmf, survival, recipe, marginal, hmm)[1]).to_pandas()


def trace_joint(ticks: DataFrame, model: JointModel, keys: list[str]) -> DataFrame:
    """The traces of all sequences, each under its likeliest recipe."""
    marginal = model.marginal_transitions()
    return conditioned(recipes_of(packed(ticks, keys), model, keys), model, keys, lambda *x: traces_of(*x, marginal=marginal), TRACE)


def single(model: Model) -> JointModel:
    """A joint model of one recipe."""
    return JointModel(np.zeros(1), model.init[None], model.trans[None], model.verbs, model.nouns, model.r[None], model.p[None], model.d_max)


def trace_cascade(ticks: DataFrame, model: Model, hmm: RecipeModel, keys: list[str]) -> DataFrame:
    """The traces of all sequences under one model, with the recipe of each segment by an HMM over the segments."""
    trials = packed(ticks, keys).withColumn("recipe", F.lit(0))
    return conditioned(trials, single(model), keys, lambda *x: traces_of(*x, hmm=hmm), TRACE)


def segments_of(trace: DataFrame, keys: list[str]) -> DataFrame:
    """The decoded segments of traces, as `decode_conditioned` tells them."""
    rows = trace.groupBy(*keys, "seg_idx", F.col("z_star").alias("state"), "recipe").agg(F.min("tick").alias("tick_start"), (F.max("tick") + 1).cast("int").alias("tick_end"), F.count("*").cast("int").alias("duration"))
    last = trace.groupBy(*keys).agg(F.max("seg_idx").alias("last"))
    return rows.join(last, keys).select(*keys, "seg_idx", "state", "tick_start", "tick_end", "duration", (F.col("seg_idx") == F.col("last")).alias("is_last"), "recipe")


def scores(trace: DataFrame, keys: list[str], by_recipe_path: bool = False) -> DataFrame:
    """(*keys, tick, channel, place, recipe, value) of traces, as `channels.scores` tells them.

    An emission's threshold is that of the decoded state plus the surprise of that state itself, since a mixture over an
    unsure belief is surprised by any token; the latter is taken off the score here. Moves are held against their recipe.
    """
    none = F.lit(None).cast("int")
    sure = F.log("pi_z") - NOISE
    place = {"s_transition": F.col("from_state"), "s_recipe_transition": F.col("from_recipe") if by_recipe_path else F.col("from_state")}
    each = []
    for c in sorted(channels.CHANNELS):
        moved = c in place
        of = F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("channel"), place.get(c, F.col("z_star")).alias("place"), (F.col("recipe") if moved and not by_recipe_path else none).alias("recipe"), (F.col(c) + sure if c in ("s_verb", "s_noun", "s_emit") else F.col(c)).alias("value")))
        each.append(of)
    rows = trace.select(*keys, "tick", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x"))
    return rows.select(*keys, "tick", "x.channel", "x.place", "x.recipe", "x.value")


def bundle(spark: SparkSession, model: JointModel, alphas: list[float], overrides: dict[str, float] | None = None, hmm: RecipeModel | None = None) -> DataFrame:
    """(channel, place, recipe, alpha, threshold) of a model: exact tail thresholds of its own tables.

    With `hmm`, for traces of one model with paths of recipes, moves depend on no recipe and recipes' moves on theirs.
    """
    rows = model.long(spark)
    logs = lambda family, i, j, *more: rows.filter(F.col("family") == family).select(*more, F.col("i").alias(i), F.col("j").alias(j), F.col("value").alias("logp"))
    verbs, nouns, own = logs("verbs", "state", "verb_id"), logs("nouns", "state", "noun_id"), logs("trans", "from_state", "to_state", F.col("r").alias("recipe"))
    mixed = model.marginal_transitions()
    marginal = spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(mixed)], "from_state int, to_state int, logp double")
    tables = channels.Tables(verbs, nouns, marginal, own, marginal, marginal, model.d_max)
    kept = channels.bundle(tables, alphas, overrides)
    moves = F.col("channel").isin("s_transition", "s_recipe_transition") if hmm is not None else F.col("channel") == "s_transition"
    out = [kept.filter(~moves)]
    support = own.select("recipe", "from_state", (-F.col("logp")).alias("score"), F.exp("logp").alias("mass"))
    by_recipe = S.tail_threshold(support, ["recipe", "from_state"], "score", "mass", alphas)
    recipe = F.lit(None).cast("int") if hmm is not None else F.col("recipe")
    out.append(by_recipe.select(F.lit("s_transition").alias("channel"), F.col("from_state").alias("place"), recipe.alias("recipe"), "alpha", "threshold"))
    if hmm is not None:
        paths = spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(hmm.trans)], "from_state int, to_state int, logp double")
        out.append(S.transition_thresholds(paths, alphas).select(F.lit("s_recipe_transition").alias("channel"), F.col("from_state").alias("place"), F.lit(None).cast("int").alias("recipe"), "alpha", "threshold"))
    return reduce(DataFrame.unionByName, out)


def flags(trace: DataFrame, thresholds: DataFrame, keys: list[str], by_recipe_path: bool = False) -> DataFrame:
    """The scores of traces above their thresholds."""
    return channels.flagged(scores(trace, keys, by_recipe_path), thresholds)


def belief_diagnostic(trace: DataFrame, keys: list[str], cutoff: float = 0.8) -> DataFrame:
    """One row: ticks, the share of them whose largest belief is below `cutoff`, and the mean of that share over sequences.

    Thresholds go by the decoded state; where the belief is spread over several states, that is an approximation.
    """
    below = (F.col("pi_max") < cutoff).cast("int")
    each = trace.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(below).alias("below"))
    return each.agg(F.sum("n").alias("ticks"), (F.sum("below") / F.sum("n")).alias("pooled"), F.avg(F.col("below") / F.col("n")).alias("by_sequence"))


def junction_fates(trace: DataFrame, flagged: DataFrame, degraded: DataFrame, segments: DataFrame, recipes: DataFrame) -> DataFrame:
    """What becomes of moves that an injected error makes and no healthy trial has, by type of error: sequences (n), those
    with such a move (novel), where it is still decoded (decoded), where a move's channel flags it there (flagged), and
    those whose recipe changed (flipped).

    `trace` and `flagged` are of degraded sequences, `degraded` their ticks with src_tick, `segments` the healthy trials'
    segments, `recipes` their (trial_id, recipe). Degraded ticks take the state of the healthy segment that their source
    tick lies in; where a run of these meets the next, a move is made. Decoded moves and flags stand at the first ticks
    of decoded segments, so both sides are runs of ticks in one order, and no pair of intervals is enumerated.
    """
    keys = ["trial_id", "error_type"]
    spans = segments.select("trial_id", "state", F.explode(F.sequence("tick_start", F.col("tick_end") - 1)).alias("src_tick"))
    w = Window.partitionBy(*keys).orderBy("tick")
    mapped = degraded.select(*keys, "tick", "src_tick").join(spans, ["trial_id", "src_tick"])
    made = mapped.withColumn("from_state", F.lag("state").over(w)).filter("from_state != state").select(*keys, "from_state", F.col("state").alias("to_state")).distinct()
    healthy = segments.select(F.lag("state").over(Window.partitionBy("trial_id").orderBy("seg_idx")).alias("from_state"), F.col("state").alias("to_state")).filter("from_state is not null").distinct()  # states squared at most
    novel = made.join(F.broadcast(healthy), ["from_state", "to_state"], "left_anti")
    moves = trace.filter("from_state is not null").select(*keys, "tick", "from_state", F.col("z_star").alias("to_state"))
    heard = flagged.filter(F.col("channel").isin("s_transition", "s_recipe_transition")).select(*keys, "tick").distinct().withColumn("heard", F.lit(True))
    decoded = moves.join(heard, [*keys, "tick"], "left").groupBy(*keys, "from_state", "to_state").agg(F.coalesce(F.bool_or("heard"), F.lit(False)).alias("heard"))
    fates = novel.join(decoded, [*keys, "from_state", "to_state"], "left").groupBy(*keys).agg(F.bool_or(F.col("heard").isNotNull()).alias("decoded"), F.bool_or(F.coalesce("heard", F.lit(False))).alias("flagged"))
    each = trace.groupBy(*keys).agg(F.first("recipe").alias("recipe")).join(recipes.select("trial_id", F.col("recipe").alias("was")), "trial_id").join(fates, keys, "left")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return each.groupBy("error_type").agg(F.count("*").alias("n"), n(F.col("decoded").isNotNull()).alias("novel"), n(F.col("decoded")).alias("decoded"), n(F.col("flagged")).alias("flagged"), n(F.col("recipe") != F.col("was")).alias("flipped"))


def narrated(trace: DataFrame, flagged: DataFrame, ticks: DataFrame, model: JointModel, names: DataFrame, items: DataFrame, alpha: float) -> DataFrame:
    """Questions on flags of the traces of trials: what is expected is what each trial's own recipe expects.

    `names` has (state, name), `items` (noun_id, item). Recipes' moves have no question of their own.
    """
    spark, keys, by = trace.sparkSession, ["trial_id"], ["recipe"]
    rows = model.long(spark)
    own = rows.filter("family = 'trans' AND i <> j").select(F.col("r").alias("recipe"), F.col("i").alias("from_state"), F.col("j").alias("to_state"), F.col("value").alias("logp"))
    logs = lambda family, token: rows.filter(F.col("family") == family).select(F.col("i").alias("state"), F.col("j").alias(token), F.col("value").alias("logp"))
    means = spark.createDataFrame([(int(r), int(k), float(m)) for (r, k), m in np.ndenumerate(1 + model.r * (1 - model.p) / model.p)], "recipe int, state int, mean_duration double")
    best = Window.partitionBy("recipe", "from_state").orderBy(F.desc(F.round("logp", S.PLACES)), "to_state")
    expected = own.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("recipe", "from_state", F.col("to_state").alias("expected_state"))
    spans = segments_of(trace, keys)
    at = flagged.join(trace.select("trial_id", "tick", "seg_idx"), ["trial_id", "tick"])
    moves = flagged.filter("channel = 's_transition'").select("trial_id", F.col("tick").alias("tick_start"), "recipe", F.col("place").alias("from_state"), F.col("value").alias("s_transition"), "threshold", F.lit(True).alias("flagged"))
    moves = moves.join(spans.select("trial_id", "tick_start", "state"), ["trial_id", "tick_start"])
    closed = trace.filter("cause IS NOT NULL").select("trial_id", "seg_idx", "s_dur_two", "cause").join(spans.select("trial_id", "seg_idx", "recipe", "state", "duration"), ["trial_id", "seg_idx"])
    return narrate.narrated(
        narrate.order_questions(moves, expected, sequence.bridges(own, by), names, by=by),
        narrate.duration_questions(closed, spans, names, means, alpha, by=by),
        narrate.emission_questions(at, ticks, logs("nouns", "noun_id"), logs("verbs", "verb_id"), names, items),
        narrate.stall_questions(at, names, means, spans, by=by),
    )
