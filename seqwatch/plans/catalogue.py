"""Every query of the library by name, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqwatch.functions import runs as R
from seqwatch.operators import channels
from seqwatch.operators import counts as C
from seqwatch.operators import evaluate as E
from seqwatch.operators import explore, inject, lifecycle, narrate, operating, prompts, replies, sequence
from seqwatch.operators import surprise as S
from seqwatch.plans import decode, durations, fit, joint, lexical, recipes, traces, warm
from seqwatch.sources import annotations, events
from seqwatch.sources.durable import data, written
from seqwatch.sources.events import table
from seqwatch.streaming import alarms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ALPHA, D_MAX, NOUNS = 0.3, 6, 10
ALPHAS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that equal results are equal rows."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return events.event_ticks(spark, d)


def segments(spark: SparkSession, d: str) -> DataFrame:
    return R.runs(ticks(spark, d).withColumn("state", F.col("verb_id")), ["state"], keep=["recipe"])


def logp(spark: SparkSession, d: str) -> DataFrame:
    return C.log_transitions(segments(spark, d))


def recipe_logp(spark: SparkSession, d: str) -> DataFrame:
    """Log transition probabilities of each recipe, backed off to the pooled rows so that no cell is empty."""
    smooth = C.backoff(C.transition_counts(segments(spark, d), ["recipe"]), 5.0).filter("from_state != to_state")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("recipe", "from_state"))
    return smooth.select("recipe", "from_state", "to_state", F.log(share).alias("logp"))


def shares(spark: SparkSession, d: str) -> DataFrame:
    return C.recipe_shares(ticks(spark, d).select("trial_id", "recipe").distinct())


def emissions(spark: SparkSession, d: str, token: str) -> DataFrame:
    """state, token, logp of tokens in each state, with one added to every count."""
    rows = ticks(spark, d).withColumn("state", F.col("verb_id")).groupBy("state", token).agg(F.count("*").alias("n"))
    spine = rows.select("state").distinct().join(rows.select(token).distinct(), F.lit(True))  # states times tokens
    n = F.coalesce("n", F.lit(0)) + 1.0
    return spine.join(rows, ["state", token], "left").select("state", token, F.log(n / F.sum(n).over(Window.partitionBy("state"))).alias("logp"))


@query
def flags_long(spark, d):
    """The flagship: transitions whose surprise exceeds the exact tail threshold of the state that they leave."""
    w = world(spark, d)
    rows = S.transition_flags(S.transition_surprise(w.segments, w.logp), S.transition_thresholds(w.logp, ALPHA)).filter("flagged")
    return rounded(rows.select("trial_id", F.col("tick_start").alias("tick"), "from_state", "state", "s_transition", "threshold", S.severity(F.col("s_transition"), F.col("threshold")).alias("severity")))


@query
def events_ticks(spark, d):
    return ticks(spark, d).select("trial_id", "tick", "verb", "verb_id", "noun_id", "recipe")


@query
def vocab_ids(spark, d):
    return events.vocabulary(table(spark, d, "events"), "event_type")


@query
def canonical_view(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    best = Window.partitionBy("l_orderkey", "l_returnflag").orderBy(*order)
    return table(spark, d, "lineitem").withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("l_orderkey", "l_returnflag", *order)


@query
def view_disagreement(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count_distinct("l_partkey").alias("n_contents")).filter("n_contents > 1")


def camera_files(spark, d):
    """Line items as views of trials: the five first of an order are what five cameras saw, and so on."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1
    cameras = [*annotations.CAMERA_PRIORITY[1:], annotations.CAMERA_PRIORITY[0]]
    rows = table(spark, d, "lineitem").withColumn("k", k)
    camera = F.get(F.array(*map(F.lit, cameras)), F.col("k") % len(cameras))
    path = F.format_string("x/P%d_%s_P%d_trial%d.txt", "l_orderkey", camera, "l_orderkey", F.floor(F.col("k") / len(cameras)))
    return rows.select(path.alias("path"), F.concat_ws("/", F.col("l_returnflag"), F.col("l_linestatus")).alias("content"))


@query
def canonical_cameras(spark, d):
    return annotations.canonical_views(annotations.named_views(camera_files(spark, d))).select("trial_id", "camera", "recipe", "content")


@query
def camera_disagreements(spark, d):
    return annotations.view_disagreements(annotations.named_views(camera_files(spark, d)))


@query
def segment_parse(spark, d):
    line = F.concat((F.col("tick") * 10 + 1).cast("string"), F.lit("-"), (F.col("tick") * 10 + 10).cast("string"), F.lit(" "), F.col("verb"), F.lit("_item_"), F.col("noun_id").cast("string"))
    lines = ticks(spark, d).select("trial_id", "tick", F.when(F.col("tick") % 7 == 3, "no segment").otherwise(line).alias("value"))
    return annotations.parse_lines(lines, "value", ["trial_id", "tick"])


@query
def verb_noun_split(spark, d):
    label = F.when(F.col("tick") == 0, "SIL").otherwise(F.concat(F.col("verb"), F.lit("_item_"), F.col("noun_id").cast("string")))
    rows = ticks(spark, d).select("trial_id", "tick", label.alias("label"))
    return rows.select("trial_id", "tick", annotations.verb_of(F.col("label")).alias("verb"), annotations.noun_of(F.col("label")).alias("noun"))


def frames(spark, d):
    n = F.col("noun_id") * 3 + 2
    upto = F.sum(n).over(Window.partitionBy("trial_id").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0))
    return ticks(spark, d).select("trial_id", "verb_id", "noun_id", (upto - n + 1).cast("int").alias("start_frame"), upto.cast("int").alias("end_frame"))


@query
def tick_expand_plurality(spark, d):
    return R.expand_to_ticks(frames(spark, d), "verb_id", 15.0)


@query
def tick_expand_pairs(spark, d):
    pairs = frames(spark, d).withColumn("pair", F.col("verb_id") * 100 + F.col("noun_id"))
    return R.expand_to_ticks(pairs, "pair", 15.0)


@query
def terminal_trim(spark, d):
    return R.trim_idle(ticks(spark, d), F.col("verb_id") == 0).select("trial_id", "tick", "verb_id", "n_trimmed")


@query
def split_semi(spark, d):
    rows = ticks(spark, d)
    return events.keep_part(rows, events.split_parts(rows), "test").select("trial_id", "tick", "verb_id")


@query
def split_anti(spark, d):
    rows = ticks(spark, d)
    return rows.join(events.split_parts(rows).filter("part = 'test'"), "trial_id", "left_anti").select("trial_id", "tick", "verb_id")


@query
def rle_steps(spark, d):
    return segments(spark, d)


@query
def rle_pairs(spark, d):
    return R.runs(ticks(spark, d), ["verb_id", "noun_id"]).drop("is_last")


@query
def steps_text(spark, d):
    rows = R.runs(ticks(spark, d).withColumn("noun", F.concat(F.lit("item"), F.col("noun_id").cast("string"))), ["verb", "noun"])
    return rows.select("trial_id", "seg_idx", replies.step_text(F.col("verb"), F.col("noun"), F.col("duration")).alias("text"), replies.phrase(F.col("verb"), F.col("noun"), "view", "item0").alias("phrase"))


@query
def run_expansion(spark, d):
    return R.expand_runs(segments(spark, d), "state")


@query
def segment_absorb(spark, d):
    rows = ticks(spark, d).withColumn("state", F.col("verb_id"))
    kept = rows.select("state").distinct().filter("state in (1, 2)")
    return R.runs(R.absorb(rows, "state", kept), ["state"])


@query
def observed_pairs(spark, d):
    return C.observed_pairs(ticks(spark, d), 200)


@query
def bag_of_pairs(spark, d):
    return rounded(C.pair_bags(ticks(spark, d)))


@query
def init_counts(spark, d):
    return C.initial_counts(segments(spark, d), ["recipe"])


@query
def trans_counts(spark, d):
    return C.transition_counts(segments(spark, d), ["recipe"])


@query
def dur_hist(spark, d):
    return C.duration_counts(segments(spark, d), D_MAX)


@query
def dur_hist_censored(spark, d):
    return C.duration_counts(segments(spark, d), D_MAX, ["is_last"])


@query
def map_normalise(spark, d):
    return rounded(logp(spark, d))


@query
def backoff(spark, d):
    return rounded(C.backoff(C.transition_counts(segments(spark, d), ["recipe"]), 2.0))


@query
def mode_shift(spark, d):
    return rounded(C.mode_shift(C.transition_counts(segments(spark, d), ["recipe"]), 0.5))


@query
def collapse_marginal(spark, d):
    return rounded(C.collapse(C.transition_counts(segments(spark, d), ["recipe"]), shares(spark, d)))


@query
def marginal_trans(spark, d):
    return rounded(C.marginal_transitions(recipe_logp(spark, d), shares(spark, d)))


@query
def nb_moments(spark, d):
    return rounded(C.duration_moments(C.duration_counts(segments(spark, d), 50)))


def tails(spark, d):
    return S.duration_tails(C.duration_counts(segments(spark, d), D_MAX))


@query
def empirical_survival(spark, d):
    return rounded(tails(spark, d))


@query
def two_sided_duration(spark, d):
    return rounded(S.completed_durations(segments(spark, d), tails(spark, d), D_MAX))


@query
def live_stall(spark, d):
    return rounded(S.live_stall(segments(spark, d), tails(spark, d), D_MAX))


@query
def transition_surprise(spark, d):
    return rounded(S.transition_surprise(segments(spark, d), logp(spark, d)).select("trial_id", "tick_start", "from_state", "state", "s_transition"))


@query
def expected_next(spark, d):
    return rounded(S.expected_next(logp(spark, d)))


@query
def tail_threshold_transition(spark, d):
    return rounded(S.transition_thresholds(logp(spark, d), ALPHA))


@query
def tail_threshold_categorical(spark, d):
    return rounded(S.token_thresholds(emissions(spark, d, "noun_id"), "noun_id", ALPHA))


@query
def tail_threshold_joint(spark, d):
    return rounded(S.pair_thresholds(emissions(spark, d, "verb_id"), emissions(spark, d, "noun_id"), ALPHA))


@query
def tail_threshold_excess(spark, d):
    lr = recipe_logp(spark, d)
    return rounded(S.excess_thresholds(lr, C.marginal_transitions(lr, shares(spark, d)), ALPHA))


@query
def tail_threshold_empirical(spark, d):
    values = segments(spark, d).select("state", F.col("duration").cast("double").alias("score"))
    return rounded(S.sample_threshold(values, ["state"], "score", 0.1))


@query
def emission_attribution(spark, d):
    """Ticks under the belief that the state is the verb of the tick before."""
    rows = ticks(spark, d)
    before = F.lag("verb_id").over(Window.partitionBy("trial_id").orderBy("tick"))
    belief = rows.select("trial_id", "tick", before.alias("state"), F.lit(1.0).alias("belief")).filter("state is not null")
    found = S.mixture_surprise(emissions_after(spark, d, "verb_id"), emissions_after(spark, d, "noun_id"), belief, rows)
    return rounded(found.withColumn("attribution", S.attribution(F.col("s_verb"), F.col("s_noun"), 0.2)))


def emissions_after(spark, d, token):
    rows = ticks(spark, d).withColumn("state", F.lag("verb_id").over(Window.partitionBy("trial_id").orderBy("tick"))).filter("state is not null").groupBy("state", token).agg(F.count("*").alias("n"))
    spine = rows.select("state").distinct().join(rows.select(token).distinct(), F.lit(True))
    n = F.coalesce("n", F.lit(0)) + 1.0
    return spine.join(rows, ["state", token], "left").select("state", token, F.log(n / F.sum(n).over(Window.partitionBy("state"))).alias("logp"))


@query
def missing_step(spark, d):
    return rounded(sequence.bridges(logp(spark, d)))


@query
def swap_gain(spark, d):
    w = world(spark, d)
    rows = sequence.swap_gains(w.segments, w.logp)  # without a gain where a state would follow itself
    return rounded(rows.withColumn("gain", F.when(F.col("gain") > -1e300, F.col("gain"))))


@query
def repetition_ratio(spark, d):
    return rounded(sequence.repetition_ratios(segments(spark, d), C.duration_moments(C.duration_counts(segments(spark, d), 50))))


@query
def sequence_verdicts(spark, d):
    w = world(spark, d)
    return rounded(sequence.verdicts(w.segments, w.logp, C.duration_moments(C.duration_counts(w.segments, 50)), 0.05, 2.5, -1.35))


@dataclass
class World:
    """Tables that an evaluation shares, each written once."""

    ticks: DataFrame
    segments: DataFrame
    logp: DataFrame


@dataclass
class Degraded(World):
    rows: DataFrame  # degraded ticks with the number of their step
    windows: DataFrame
    steps: DataFrame | None  # those that `degraded` was asked for


def world(spark, d) -> World:
    t = written(ticks(spark, d), "ticks")
    s = written(R.runs(t.withColumn("state", F.col("verb_id")), ["state"], keep=["recipe"]), "segments")
    return World(t, s, written(C.log_transitions(s), "logp"))


def degraded(spark, d, with_steps: bool = True) -> Degraded:
    w = world(spark, d)
    rows, windows = inject.inject(w.ticks, w.segments, inject.ERROR_TYPES, NOUNS)
    rows = written(R.run_numbers(rows, ["verb_id"], key=["trial_id", "error_type"]), "degraded")
    windows = written(windows, "windows")
    if not with_steps:
        return Degraded(w.ticks, w.segments, w.logp, rows, windows, None)
    whole = Window.partitionBy("trial_id", "error_type").orderBy("seg_idx")
    steps = rows.groupBy("trial_id", "error_type", "seg_idx", F.col("verb_id").alias("state")).agg(F.min("tick").alias("tick_start"), (F.max("tick") + 1).cast("int").alias("tick_end"), F.count("*").cast("int").alias("duration"))
    steps = steps.withColumn("from_state", F.lag("state").over(whole)).withColumn("is_last", F.lead("state").over(whole).isNull())
    return Degraded(w.ticks, w.segments, w.logp, rows, windows, written(steps, "steps"))


for _kind in inject.ERROR_TYPES:

    def _inject(spark, d, kind=_kind):
        w = world(spark, d)
        return inject.inject(w.ticks, w.segments, kind, NOUNS)[0]

    _inject.__name__ = f"inject_{_kind}"
    query(_inject)


@query
def stall_alarms(spark, d):
    """Segments that outlast their state's limit in time, up to the last event: what timers on a stream would tell."""
    t = ticks(spark, d).select("trial_id", F.col("ts").cast("timestamp").alias("ts"), F.col("verb_id").alias("state"))
    until = t.agg(F.max("ts").cast("string")).first()[0]
    found = alarms.stalls(t, {k: (k + 1) * 6 * 3_600_000 for k in range(5)}, until)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "alarm")})


@query
def inject_stall(spark, d):
    s = segments(spark, d)
    return inject.stall(ticks(spark, d), inject.choices(s, ["stall"]))


@query
def inject_windows(spark, d):
    return inject.windows(inject.choices(segments(spark, d), inject.ERROR_TYPES))


def transition_step_flags(w: Degraded, alpha: float | list[float] = ALPHA) -> DataFrame:
    """Steps whose first transition is flagged under the healthy model: key columns, seg_idx, tick_start (and alpha)."""
    rows = w.steps.filter("from_state is not null").join(w.logp.withColumnRenamed("to_state", "state"), ["from_state", "state"]).withColumn("s_transition", -F.col("logp"))
    found = S.transition_flags(rows, S.transition_thresholds(w.logp, alpha)).filter("flagged")
    return found.select(*(["alpha"] if isinstance(alpha, list) else []), "trial_id", "error_type", "seg_idx", "tick_start")


def healthy_flags(w: World, alpha: float = ALPHA) -> DataFrame:
    starts = S.transition_flags(S.transition_surprise(w.segments, w.logp), S.transition_thresholds(w.logp, alpha)).filter("flagged").select("trial_id", F.col("tick_start").alias("tick"), F.lit(True).alias("flagged"))
    return w.ticks.select("trial_id", "tick").join(starts, ["trial_id", "tick"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))


def degraded_flags(w: Degraded, alpha: float = ALPHA) -> DataFrame:
    found = transition_step_flags(w, alpha).select("trial_id", "error_type", F.col("tick_start").alias("tick"), F.lit(True).alias("flagged"))
    return w.rows.join(found, ["trial_id", "error_type", "tick"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))


def outcomes(w: Degraded, alpha: float = ALPHA) -> DataFrame:
    return E.tick_outcomes(w.windows, transition_step_flags(w, alpha).select("trial_id", "error_type", F.col("tick_start").alias("tick"), F.lit(True).alias("flagged")))


@query
def gt_steps(spark, d):
    w = degraded(spark, d)
    return E.truth_steps(w.steps, w.windows).select("trial_id", "error_type", "seg_idx", "state", "duration")


@query
def debris_steps(spark, d):
    w = degraded(spark, d)
    return E.debris_steps(w.rows, E.truth_steps(w.steps, w.windows))


@query
def step_cover_tick(spark, d):
    points = ticks(spark, d).groupBy("trial_id").agg((F.max("tick") - 5).alias("at"))
    return E.covering_step(segments(spark, d), points)


@query
def project_flags(spark, d):
    w = degraded(spark, d)
    return E.projected_flags(w.rows, healthy_flags(w)).filter("projected").select("trial_id", "error_type", "tick", "src_tick")


@query
def attributable(spark, d):
    w = degraded(spark, d)
    rows = E.projected_flags(degraded_flags(w), healthy_flags(w))
    return rows.filter("flagged and not projected").select("trial_id", "error_type", "tick")


@query
def tick_outcomes(spark, d):
    return outcomes(degraded(spark, d))


@query
def tick_metrics(spark, d):
    w = degraded(spark, d)
    return rounded(E.tick_report(outcomes(w), healthy_flags(w)))


@query
def trial_location(spark, d):
    w = degraded(spark, d)
    return E.trial_location(outcomes(w), healthy_flags(w))


@query
def counterfactual(spark, d):
    w = degraded(spark, d)
    rows = E.projected_flags(degraded_flags(w), healthy_flags(w))
    return rounded(E.counterfactual_report(E.counterfactual_outcomes(rows, w.windows)))


@query
def mcnemar(spark, d):
    w = degraded(spark, d)
    flags = transition_step_flags(w, [0.2, 0.4]).withColumnRenamed("tick_start", "tick").withColumn("flagged", F.lit(True))
    hit = lambda a: F.coalesce(F.max((F.col("hit") & (F.col("alpha") == a)).cast("int")), F.lit(0))
    rows = w.windows.join(flags, ["trial_id", "error_type"], "left").withColumn("hit", F.coalesce(F.col("tick").between(F.col("t0"), F.col("t1") + E.TICK_TOLERANCE), F.lit(False)))
    return rounded(E.mcnemar(rows.groupBy("trial_id", "error_type").agg(hit(0.2).alias("before"), hit(0.4).alias("after"))))


@query
def step_metrics(spark, d):
    w = degraded(spark, d)
    truth = written(E.truth_steps(w.steps, w.windows).select("trial_id", "error_type", "seg_idx"), "truth")
    rows = E.step_outcomes(transition_step_flags(w), truth, E.debris_steps(w.rows, truth))
    return rounded(rows.groupBy("error_type").agg(F.count("*").alias("n"), F.sum("detected").alias("tp"), F.sum("false_steps").alias("false_steps"), F.avg("detected").alias("recall")))


def emission_table(w: World, token: str) -> DataFrame:
    """state, token, logp: tokens that follow a tick of each state, with one added to every count."""
    before = F.lag("verb_id").over(Window.partitionBy("trial_id").orderBy("tick"))
    rows = w.ticks.withColumn("state", before).filter("state is not null").groupBy("state", token).agg(F.count("*").alias("n"))
    spine = rows.select("state").distinct().join(rows.select(token).distinct(), F.lit(True))  # states times tokens
    n = F.coalesce("n", F.lit(0)) + 1.0
    return spine.join(rows, ["state", token], "left").select("state", token, F.log(n / F.sum(n).over(Window.partitionBy("state"))).alias("logp"))


def channel_tables(w: World) -> channels.Tables:
    smooth = C.backoff(C.transition_counts(w.segments, ["recipe"]), 5.0).filter("from_state != to_state")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("recipe", "from_state"))
    own = written(smooth.select("recipe", "from_state", "to_state", F.log(share).alias("logp")), "recipe-logp")
    marginal = written(C.marginal_transitions(own, C.recipe_shares(w.ticks.select("trial_id", "recipe").distinct())), "marginal")
    verbs, nouns = (written(emission_table(w, token), "emissions") for token in ("verb_id", "noun_id"))
    return channels.Tables(verbs, nouns, w.logp, own, marginal, written(S.duration_tails(C.duration_counts(w.segments, D_MAX)), "tails"), D_MAX)


def healthy_steps(w: World) -> DataFrame:
    return w.segments.withColumn("from_state", F.lag("state").over(Window.partitionBy("trial_id").orderBy("seg_idx")))


def recipe_steps(w: Degraded) -> DataFrame:
    return w.steps.join(data(w.ticks.select("trial_id", "recipe").distinct()), "trial_id")


HEALTHY, DEGRADED = ["trial_id"], ["trial_id", "error_type"]
#: Of the duration channels and the others alike; flags of all channels.
CHANNEL_ALPHA = 0.2


def written_bundle(t: channels.Tables, alphas: list[float]) -> DataFrame:
    return written(channels.bundle(t, alphas).coalesce(1), "bundle")  # a few rows a state


def healthy_channel_flags(w: World, t: channels.Tables, alphas: list[float]) -> DataFrame:
    return channels.flagged(channels.scores(w.ticks, healthy_steps(w), HEALTHY, t), written_bundle(t, alphas))


def degraded_channel_flags(w: Degraded, t: channels.Tables, alphas: list[float]) -> DataFrame:
    return channels.flagged(channels.scores(w.rows, recipe_steps(w), DEGRADED, t), written_bundle(t, alphas))


@query
def threshold_bundle(spark, d):
    return rounded(channels.bundle(channel_tables(world(spark, d)), [0.1, CHANNEL_ALPHA]))


@query
def flags_channels(spark, d):
    w = world(spark, d)
    found = healthy_channel_flags(w, channel_tables(w), [CHANNEL_ALPHA])
    return rounded(found.select("trial_id", "tick", "channel", "value", "threshold", S.severity(F.col("value"), F.col("threshold")).alias("severity")))


@query
def flags_wide(spark, d):
    w = world(spark, d)
    return channels.wide(healthy_channel_flags(w, channel_tables(w), [CHANNEL_ALPHA]), HEALTHY)


@query
def attribution_matrix(spark, d):
    """By type of error and channel: trials in which the channel is flagged in the error's window, or a little after."""
    w = degraded(spark, d)
    rows = degraded_channel_flags(w, channel_tables(w), [CHANNEL_ALPHA]).join(w.windows, DEGRADED)
    inside = rows.filter(F.col("tick").between(F.col("t0"), F.col("t1") + E.TICK_TOLERANCE))
    return inside.groupBy("error_type", "channel").agg(F.count_distinct("trial_id").alias("trials"))


def degraded_least(w: Degraded, t: channels.Tables, cells: dict[str, DataFrame]) -> DataFrame:
    """Steps of degraded trials with the least alpha of each channel, and whether they overlap the error's window (is_true)."""
    sequences = w.windows.join(w.ticks.select("trial_id", "recipe").distinct().hint("merge"), "trial_id")
    rows = w.rows.withColumn("touched", E.is_touched())
    return channels.least_by_step(rows, sequences, DEGRADED, cells, t.d_max).withColumn("is_true", (F.col("tick_start") <= F.col("t1")) & (F.col("tick_end") > F.col("t0")))


def healthy_least(w: World, t: channels.Tables, cells: dict[str, DataFrame]) -> DataFrame:
    rows = R.run_numbers(w.ticks.drop("recipe"), ["verb_id"]).withColumn("touched", F.lit(False))
    return channels.least_by_step(rows, w.ticks.select("trial_id", "recipe").distinct(), HEALTHY, cells, t.d_max)


def written_cells(t: channels.Tables, alphas: list[float] | None = None) -> dict[str, DataFrame]:
    """The least of `alphas` by cell; without them the least alpha of all."""
    judged = partial(channels.flagged, thresholds=written_bundle(t, alphas)) if alphas else partial(operating.least_alphas, tails=written(operating.tail_masses(t).coalesce(1), "tails"))
    return {name: written(cells, name) for name, cells in channels.least_cells(t, judged).items()}


@query
def type_confusion(spark, d):
    """True against predicted type of error, over the flagged steps of the errors."""
    w = degraded(spark, d, with_steps=False)
    t = channel_tables(w)
    steps = degraded_least(w, t, written_cells(t, [CHANNEL_ALPHA])).filter("is_true").filter(F.coalesce(*channels.CHANNELS).isNotNull())
    return steps.groupBy("error_type", channels.predicted_type().alias("predicted")).agg(F.count("*").alias("steps"))


def true_ticks(w: Degraded) -> DataFrame:
    """Ticks of healthy and degraded trials: key, tick, seg_idx, is_error, is_positive."""
    truth = written(E.truth_steps(w.steps, w.windows).select(*DEGRADED, "seg_idx"), "truth")
    positive = truth.unionByName(E.debris_steps(w.rows, truth)).withColumn("is_positive", F.lit(True))
    key = F.concat_ws("/", F.col("trial_id").cast("string"), "error_type")
    bad = w.rows.select(*DEGRADED, "tick", "seg_idx").join(data(positive), [*DEGRADED, "seg_idx"], "left").select(key.alias("key"), "tick", "seg_idx", F.lit(True).alias("is_error"), F.coalesce("is_positive", F.lit(False)).alias("is_positive"))
    good = R.run_numbers(w.ticks.select("trial_id", "tick", "verb_id"), ["verb_id"]).select(F.col("trial_id").cast("string").alias("key"), "tick", "seg_idx", F.lit(False).alias("is_error"), F.lit(False).alias("is_positive"))
    return bad.unionByName(good)


def judged_ticks(w: Degraded, t: channels.Tables, alphas: list[float]) -> DataFrame:
    """Ticks of healthy and degraded trials: key, seg_idx, is_error, is_positive, and the alphas at which they are flagged."""
    key = F.concat_ws("/", F.col("trial_id").cast("string"), "error_type")
    flags = degraded_channel_flags(w, t, alphas).select(key.alias("key"), "tick", "channel", "alpha").unionByName(healthy_channel_flags(w, t, alphas).select(F.col("trial_id").cast("string").alias("key"), "tick", "channel", "alpha"))
    flags = flags.groupBy("key", "tick").agg(F.collect_set("alpha").alias("alphas"))  # a few alphas
    return true_ticks(w).join(data(flags), ["key", "tick"], "left")


@query
def level_counts(spark, d):
    """Confusion counts of the union of all channels on four levels, with their rates."""
    w = degraded(spark, d)
    rows = written(judged_ticks(w, channel_tables(w), [CHANNEL_ALPHA]).withColumn("is_flagged", F.col("alphas").isNotNull()), "judged")
    cells = channels.level_counts(rows, [], ["key"])
    return rounded(cells.select("level", "tp", "fp", "fn", "tn", *E.rates(*map(F.col, ("tp", "fp", "fn", "tn")))))


SWEPT = [0.05, 0.1, 0.2]


def located_trials(spark, d) -> DataFrame:
    """is_error of each trial and, by channel, the least alphas of SWEPT that flag the error's steps and other steps.

    Rows without a trial count as one healthy trial without flags, as no flag can be told to be theirs.
    """
    w = degraded(spark, d, with_steps=False)
    t = channel_tables(w)
    cells = written_cells(t, SWEPT)
    bad = channels.located(degraded_least(w, t, cells), DEGRADED, F.col("is_true") | F.col("touched")).withColumn("is_error", F.lit(True))
    good = healthy_least(w, t, cells).withColumns({c: F.when(F.col("trial_id").isNotNull(), F.col(c)) for c in channels.CHANNELS})
    good = channels.located(good, HEALTHY, F.lit(False)).withColumn("is_error", F.lit(False))
    return written(bad.drop(*DEGRADED).unionByName(good.drop(*HEALTHY)), "located")


@query
def channel_sweep(spark, d):
    """By channel and alpha: confusion counts on the level of location of that channel alone, with their rates."""
    each = [F.struct(F.lit(c).alias("channel"), F.lit(a).alias("alpha"), *[channels.found_by(name, c, a).alias(name) for name in ("hit", "stray")]) for c in channels.CHANNELS for a in SWEPT]
    rows = located_trials(spark, d).select("is_error", F.explode(F.array(*each)).alias("x")).select("is_error", "x.*")
    n = lambda c: F.sum(c.cast("int"))
    e, h, s = F.col("is_error"), F.col("hit"), F.col("stray")
    cells = rows.groupBy("channel", "alpha").agg(n(e & h).alias("tp"), n(F.when(e, s).otherwise(h | s)).alias("fp"), n(e & ~h).alias("fn"), n(~e & ~(h | s)).alias("tn"))
    return rounded(cells.select("channel", "alpha", "tp", "fp", "fn", "tn", *E.rates(*map(F.col, ("tp", "fp", "fn", "tn")))))


def all_points(spark, d) -> DataFrame:
    w = degraded(spark, d, with_steps=False)
    t = channel_tables(w)
    cells = written_cells(t)
    bad = degraded_least(w, t, cells).select(*DEGRADED, F.lit(True).alias("is_error"), (F.col("is_true") | F.col("touched")).alias("is_positive"), *channels.CHANNELS)
    good = healthy_least(w, t, cells).select("trial_id", F.lit("").alias("error_type"), F.lit(False).alias("is_error"), F.lit(False).alias("is_positive"), *channels.CHANNELS)
    steps = bad.unionByName(good).filter("trial_id is not null").withColumn("part", events.part_of())
    return operating.points_of_steps(written(steps, "steps"), DEGRADED)


@query
def operating_points(spark, d):
    """Confusion counts of steps and of trials with location, by channel and part, at every alpha where they change."""
    return all_points(spark, d)


@query
def tuned_points(spark, d):
    """The alpha of each channel that is best on training trials, and what it does on test trials."""
    return rounded(operating.tuned(written(all_points(spark, d), "points")))


@query
def coordinate_sweep(spark, d):
    """The alphas that a sweep of one channel after another chooses; iterative, so without SQL."""
    found = channels.coordinate_sweep(located_trials(spark, d), channels.CHANNELS, SWEPT, SWEPT[0])
    return spark.createDataFrame([(k, c, a, f) for k, (c, a, f) in enumerate(found)], "step int, channel string, alpha double, f1 double")


@query
def transition_ceiling(spark, d):
    """Junctions that omission and transposition make: seen in the trial's recipe, elsewhere only, or never."""
    w = degraded(spark, d)
    made = channels.created_junctions(w.rows.filter("error_type in ('omission', 'transposition')"), w.segments).join(w.ticks.select("trial_id", "recipe").distinct(), "trial_id")
    own = C.transition_counts(w.segments, ["recipe"]).select("recipe", "from_state", "to_state", F.lit(True).alias("in_recipe"))
    rows = made.join(own, ["recipe", "from_state", "to_state"], "left").join(own.select("from_state", "to_state").distinct().withColumn("anywhere", F.lit(True)), ["from_state", "to_state"], "left")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy("error_type").agg(F.count("*").alias("junctions"), n(F.col("in_recipe")).alias("seen_in_recipe"), n(F.col("anywhere") & F.col("in_recipe").isNull()).alias("seen_elsewhere"), n(F.col("anywhere").isNull()).alias("novel"))


@query
def positive_ticks(spark, d):
    """Ticks of each degraded trial in steps of the error or its debris."""
    w = degraded(spark, d)
    truth = written(E.truth_steps(w.steps, w.windows).select(*DEGRADED, "seg_idx"), "truth")
    positive = truth.unionByName(E.debris_steps(w.rows, truth))
    return w.rows.join(positive, [*DEGRADED, "seg_idx"]).groupBy(*DEGRADED).agg(F.count("*").alias("positive_ticks"), F.count_distinct("seg_idx").alias("positive_steps"))


def sweep(spark, d):
    """Precision, recall and F1 of flagged transitions against a change of item at the same tick, for all alphas at once."""
    w = world(spark, d)
    thresholds = S.transition_thresholds(w.logp, ALPHAS)
    scored = S.transition_surprise(w.segments, w.logp).withColumnRenamed("tick_start", "tick")
    rows = scored.join(thresholds, "from_state").withColumn("flagged", F.round("s_transition", S.PLACES) > F.col("threshold"))
    changed = w.ticks.withColumn("true", F.col("noun_id") % 3 == 0).select("trial_id", "tick", "true")
    rows = rows.join(changed, ["trial_id", "tick"])
    n = lambda c: F.sum(c.cast("int"))
    f, t = F.col("flagged"), F.col("true")
    cells = rows.groupBy("alpha").agg(n(f & t).alias("tp"), n(f & ~t).alias("fp"), n(~f & t).alias("fn"), n(~f & ~t).alias("tn"))
    return cells.select("alpha", "tp", "fp", "fn", "tn", *E.rates(*map(F.col, ("tp", "fp", "fn", "tn"))))


@query
def alpha_sweep(spark, d):
    return rounded(sweep(spark, d))


@query
def pr_auc(spark, d):
    return rounded(E.pr_auc(sweep(spark, d)))


@query
def best_alpha(spark, d):
    return rounded(E.best_alpha(sweep(spark, d)))


@query
def alarm_runs(spark, d):
    return E.alarm_runs(healthy_flags(world(spark, d)), ["trial_id"])


@query
def boundary_f1(spark, d):
    found = segments(spark, d).select("trial_id", F.col("tick_start").alias("tick"))
    true = R.runs(ticks(spark, d), ["noun_id"]).select("trial_id", F.col("tick_start").alias("tick"))
    return rounded(E.boundary_scores(found, true))


@query
def state_purity(spark, d):
    return rounded(E.purity(ticks(spark, d).withColumn("state", F.col("verb_id")), "state", "noun_id"))


@query
def kl_families(spark, d):
    halves = [segments(spark, d).filter(F.col("trial_id") % 2 == k) for k in (0, 1)]
    return rounded(C.divergence(C.log_transitions(halves[0]), C.log_transitions(halves[1]), "from_state", "to_state"))


def dual_model(spark, d):
    rows = ticks(spark, d).select(F.col("verb_id").alias("state"), F.col("noun_id").alias("token"), F.date_format("ts", "dd").cast("int").alias("day"), "event_id")
    frozen = rows.filter("day <= 15").groupBy("state", "token").agg(F.count("*").cast("double").alias("frozen")).withColumn("live", F.col("frozen"))
    told = rows.filter("day > 15").select("state", "token", F.when(F.col("event_id") % 3 == 0, "preference").otherwise("breakdown").alias("outcome"))
    return frozen, told


@query
def bounded_bump(spark, d):
    return lifecycle.confirmed(*dual_model(spark, d))


@query
def consolidate_all(spark, d):
    return lifecycle.consolidated(lifecycle.confirmed(*dual_model(spark, d)))


@query
def consolidate_selected(spark, d):
    model = lifecycle.confirmed(*dual_model(spark, d))
    return lifecycle.consolidated(model, model.filter("token < 3").select("state", "token"))


def modal_verbs(spark, d):
    rows = ticks(spark, d)
    return C.majority(rows, "trial_id", "verb_id").join(rows.select("trial_id", "recipe").distinct(), "trial_id")


@query
def majority_vote(spark, d):
    return C.majority(ticks(spark, d), "trial_id", "verb_id")


@query
def contingency(spark, d):
    return C.contingency(modal_verbs(spark, d), "verb_id", "recipe")


@query
def ari(spark, d):
    return rounded(C.adjusted_rand(modal_verbs(spark, d), "verb_id", "recipe"))


@query
def effective_k(spark, d):
    return C.effective_clusters(modal_verbs(spark, d), "verb_id")


REPLIES = [
    "No Anomaly", "Substitution Anomaly. Correct move would have been view item3 for 12 seconds", "omission anomaly", "I think this is a repetition, maybe click item2 for 4 seconds.",
    "Abandonment Anomaly. Correct move would have been fly item1 for 3 seconds", "who knows", "", "\n  no anomaly here", "Omission.", "Transposition anomaly. It was odd, really.",
    "substitution: correct move would have been view_item3 for 1 second.", "No anomaly? Substitution anomaly, rather.",
]


def synthetic_replies(spark, d):
    pick = reduce(lambda c, k: c.when(F.col("doc_id") % len(REPLIES) == k[0], k[1]), list(enumerate(REPLIES))[1:], F.when(F.col("doc_id") % len(REPLIES) == 0, REPLIES[0]))
    return table(spark, d, "documents").select("doc_id", pick.alias("reply"))


@query
def reply_grammar(spark, d):
    verbs = events.vocabulary(table(spark, d, "events"), "event_type")
    nouns = ticks(spark, d).select(F.concat(F.lit("item"), F.col("noun_id").cast("string")).alias("token")).distinct()
    return replies.parsed_replies(synthetic_replies(spark, d), verbs, nouns).drop("reply")


@query
def batch_reply_split(spark, d):
    steps = segments(spark, d)
    line = F.concat((F.col("seg_idx") + 1).cast("string"), F.lit(". "), F.when(F.col("state") % 2 == 0, "No Anomaly").otherwise("Omission Anomaly"))
    told = steps.filter("seg_idx != 2").groupBy("trial_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("reply"))
    return replies.split_batch(told, steps)


@query
def prefix_prompt(spark, d):
    steps = R.runs(ticks(spark, d).withColumn("noun", F.concat(F.lit("item"), F.col("noun_id").cast("string"))), ["verb", "noun"])
    return replies.prefix_prompts(steps.withColumn("text", replies.step_text(F.col("verb"), F.col("noun"), F.col("duration"))))


def step_lines(spark, d) -> DataFrame:
    steps = R.runs(ticks(spark, d).withColumn("noun", F.concat(F.lit("item"), F.col("noun_id").cast("string"))), ["verb", "noun"])
    return steps.select("trial_id", "seg_idx", replies.step_text(F.col("verb"), F.col("noun"), F.col("duration")).alias("text"))


@query
def system_prompts(spark, d):
    verbs = events.vocabulary(table(spark, d, "events"), "event_type")
    nouns = ticks(spark, d).select(F.concat(F.lit("item"), F.col("noun_id").cast("string")).alias("token"), F.col("noun_id").alias("id")).distinct()
    recipe = prompts.recipe_block(replies.canonical_orders(segments(spark, d)), verbs.select(F.col("id").alias("state"), F.col("token").alias("name")))
    return prompts.system_prompts(prompts.vocabulary_block(verbs, nouns), recipe)


@query
def trial_texts(spark, d):
    return prompts.trial_texts(step_lines(spark, d))


@query
def conversation_turns(spark, d):
    """The messages of a conversation before each step's answer, as one text; every third step has got none."""
    lines = step_lines(spark, d)
    told = lines.filter("seg_idx % 3 <> 2").select("trial_id", "seg_idx", F.lit("No Anomaly").alias("reply"))
    rows = prompts.conversations(lines, told)
    return rows.select("trial_id", "seg_idx", F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n").alias("messages"))


@query
def prefix_requests(spark, d):
    """By variant: requests, and the characters that they send."""
    asked = replies.prefix_prompts(step_lines(spark, d))
    rows = prompts.prefix_requests(asked, system_prompts(spark, d))
    chars = F.aggregate("messages", F.lit(0), lambda a, m: a + F.length(m["content"]))
    return rows.groupBy("variant").agg(F.count("*").alias("requests"), F.sum(chars).alias("chars"))


@query
def canonical_recipe(spark, d):
    return replies.canonical_orders(segments(spark, d))


@query
def edit_distance_pairs(spark, d):
    return explore.edit_distances(segments(spark, d))


@query
def participant_features(spark, d):
    return rounded(explore.participant_features(ticks(spark, d), 0))


@query
def speed_consistency(spark, d):
    gaps = ticks(spark, d).groupBy("trial_id", F.floor(F.col("tick") / 10).cast("int").alias("block")).agg(F.avg("noun_id").alias("value"))
    halves = explore.half_means(gaps).filter("even is not null")
    return rounded(halves.agg(F.corr("odd", "even").alias("r"), F.count("*").alias("n")))


@query
def gaussian_ll(spark, d):
    values = segments(spark, d).select("state", F.col("duration").cast("double").alias("x"))
    return rounded(explore.gaussian_fit(values, "state"))


@query
def bh_fdr(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 7919) % 1009 / 1009.0 * F.when(F.col("c_custkey") % 5 == 0, 0.01).otherwise(1.0)).alias("p"))
    return rounded(explore.false_discoveries(rows))


@query
def ingredient_tests(spark, d):
    """Whether a trial's blocks of ten ticks hold an item oftener or less often than those of all trials do."""
    uses = ticks(spark, d).select(F.col("trial_id").alias("participant"), F.floor(F.col("tick") / 10).alias("trial"), F.col("noun_id").alias("item"))
    return rounded(explore.ingredient_tests(uses))


@query
def order_structure(spark, d):
    return rounded(explore.order_structure(segments(spark, d), least_n=3))


@query
def duration_power(spark, d):
    return S.duration_power(segments(spark, d), D_MAX, [0.02, 0.05, 0.1, 0.3, 0.5])


@query
def pit_deciles(spark, d):
    return rounded(S.pit_deciles(S.completed_durations(segments(spark, d), tails(spark, d), D_MAX)))


@query
def representative_trials(spark, d):
    return explore.representatives(segments(spark, d))


@query
def verdict_steps(spark, d):
    w = world(spark, d)
    found = sequence.verdicts(w.segments, w.logp, C.duration_moments(C.duration_counts(w.segments, 50)), 0.05, 2.5, -1.35)
    numbered = R.run_numbers(w.ticks.select("trial_id", "tick", "verb_id", "noun_id"), ["verb_id", "noun_id"]).withColumnRenamed("seg_idx", "step")
    return sequence.step_verdicts(found, w.segments, numbered)


@query
def sequence_evaluation(spark, d):
    """What verdicts on order and lengths of segments find of injected errors; limits are tails of all healthy trials."""
    w = degraded(spark, d)
    means = written(C.duration_moments(C.duration_counts(w.segments, 50)).coalesce(1), "moments")
    swap = S.pooled_threshold(sequence.swap_gains(w.segments, w.logp).filter(F.col("gain") > -1e300), "gain", 0.05)
    ratio = S.pooled_threshold(sequence.repetition_ratios(w.segments, means), "ratio", 0.05)
    judge = lambda s: sequence.verdicts(s, w.logp, means, swap + 1e-9, ratio + 1e-9, -1.35)  # noqa: E731  equal scores are at the limit
    key = F.concat_ws("/", F.col("trial_id").cast("string"), "error_type")
    bad = judge(w.steps.select(key.alias("trial_id"), "seg_idx", "state", "duration")).select(
        F.split_part("trial_id", F.lit("/"), F.lit(1)).cast("long").alias("trial_id"), F.split_part("trial_id", F.lit("/"), F.lit(2)).alias("error_type"), "seg_idx", F.col("error_type").alias("verdict")
    )
    return E.sequence_report(judge(w.segments), w.segments, bad, E.truth_steps(w.steps, w.windows))


@query
def correction_accuracy(spark, d):
    """By error type: windows, those with a proposal, and the shares whose state and whose duration are those before the
    injection. The model proposes the likeliest state after the one before, and its mean duration."""
    w = degraded(spark, d)
    starts = w.rows.join(w.windows.select(*DEGRADED, F.col("t0").alias("tick")), [*DEGRADED, "tick"]).select(*DEGRADED, "seg_idx", F.col("src_tick").alias("tick"))
    source = R.run_numbers(w.ticks.select("trial_id", "tick", "verb_id"), ["verb_id"]).withColumnRenamed("seg_idx", "true_idx").join(w.segments.select("trial_id", F.col("seg_idx").alias("true_idx"), "duration"), ["trial_id", "true_idx"])
    rows = starts.join(source.select("trial_id", "tick", F.col("verb_id").alias("true_move"), F.col("duration").alias("true_seconds")), ["trial_id", "tick"])
    means = C.duration_moments(C.duration_counts(w.segments, 50)).select(F.col("state").alias("move"), F.floor(F.round("mean_duration", 6) + 0.5).alias("seconds"))
    proposed = S.expected_next(w.logp).select("from_state", F.col("expected_state").alias("move")).join(means, "move")  # one row a state
    rows = rows.join(w.steps.select(*DEGRADED, "seg_idx", "from_state"), [*DEGRADED, "seg_idx"]).join(F.broadcast(proposed), "from_state", "left")
    ok = lambda c: F.avg(F.col(c).cast("int"))
    return rounded(E.matched_corrections(rows).groupBy("error_type").agg(F.count("*").alias("n"), F.count("move").alias("proposed"), ok("move_ok").alias("move_ok"), ok("duration_ok").alias("duration_ok")))


@query
def lexical_start(spark, d):
    return rounded(lexical.lexical_start(ticks(spark, d)))


# Without SQL: sequential recursions, iterative fits and tests; the tests hold them against brute force.


def event_model(spark, d, states: int = 5, d_max: int = 8) -> decode.Model:
    """A model whose states lean to one verb each, so that decoding is well defined without a fit."""
    rows = emissions(spark, d, "noun_id").toPandas()
    nouns = np.full((states, NOUNS), -np.log(NOUNS))
    nouns[rows["state"] % states, rows["noun_id"]] = rows["logp"]
    verbs = np.log(np.full((states, states), 0.1 / (states - 1)) + np.eye(states) * (0.9 - 0.1 / (states - 1)))
    with np.errstate(divide="ignore"):
        trans = np.log((1 - np.eye(states)) / (states - 1))
    return decode.Model(np.full(states, -np.log(states)), trans, verbs, nouns, np.full(states, 2.0), np.full(states, 0.6), d_max)


@query
def viterbi_decode(spark, d):
    return decode.decode(ticks(spark, d), event_model(spark, d))


@query
def predictive_belief(spark, d):
    rows = decode.beliefs(ticks(spark, d), event_model(spark, d))
    return rows.select("trial_id", "tick", F.array_max("belief").alias("belief"), "s_emit")


@query
def recipe_posterior(spark, d):
    m = event_model(spark, d)
    other = decode.Model(m.init, m.trans, np.roll(m.verbs, 1, 1), m.nouns, m.r, m.p, m.d_max)
    return decode.recipe_posteriors(ticks(spark, d), [m, other], [float(np.log(0.5))] * 2)


@query
def hard_em_iter(spark, d):
    return fit.hard_em(ticks(spark, d), event_model(spark, d), 1).long(spark)


@query
def soft_em_iter(spark, d):
    return fit.soft_em(ticks(spark, d), event_model(spark, d), 1, anneal=1.0)[0].long(spark)


@query
def duration_refit(spark, d):
    """Durations of each recipe and state, the last segments and the longest ones taken as cut off."""
    return rounded(durations.refit(segments(spark, d), 50).drop("hazard"))


@query
def joint_em_iter(spark, d):
    """One step of the joint model of two recipes, in its stored form."""
    return joint.joint_em(ticks(spark, d), joint.start(event_model(spark, d), 2, 1), 1)[0].long(spark)


def event_joint_model(spark, d) -> joint.JointModel:
    """The model of `event_model` with each recipe's own transitions and, for the odd ones, longer durations."""
    m = event_model(spark, d)
    rows = recipe_logp(spark, d).toPandas()  # recipes times states squared
    n = int(rows["recipe"].max()) + 1
    trans = np.full((n, *m.trans.shape), -np.inf)
    trans[rows["recipe"], rows["from_state"], rows["to_state"]] = rows["logp"]
    share = shares(spark, d).toPandas()
    pi = np.full(n, -np.inf)
    pi[share["recipe"]] = np.log(share["share"])
    r = np.tile(m.r, (n, 1)) + (np.arange(n) % 2)[:, None]
    return joint.JointModel(pi, np.tile(m.init, (n, 1)), trans, m.verbs, m.nouns, r, np.tile(m.p, (n, 1)), m.d_max)


@query
def decode_by_recipe(spark, d):
    """Two stages: each trial's likeliest recipe, then its segments under that recipe's own tables."""
    m = event_joint_model(spark, d)
    return traces.decode_conditioned(traces.recipes_of(traces.packed(ticks(spark, d), HEALTHY), m, HEALTHY), m, HEALTHY)


def healthy_trace(spark, d) -> tuple[joint.JointModel, World, DataFrame]:
    m, w = event_joint_model(spark, d), world(spark, d)
    return m, w, written(traces.trace_joint(w.ticks, m, HEALTHY), "trace")


def degraded_trace(w: World, m: joint.JointModel, trace: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Errors injected into decoded trials: their ticks, the windows, the healthy segments, and the traces of the ticks."""
    decoded = written(traces.segments_of(trace, HEALTHY), "decoded")
    rows, windows = inject.inject(w.ticks, decoded, inject.ERROR_TYPES, NOUNS)
    rows = written(rows, "degraded")
    return rows, written(windows, "windows"), decoded, written(traces.trace_joint(rows, m, DEGRADED), "degraded-trace")


@query
def trace_joint(spark, d):
    """Everything that the joint model says of each tick, by its belief, its decoded segments and its recipe."""
    return rounded(healthy_trace(spark, d)[2].drop("belief"))


@query
def trace_flags(spark, d):
    """Flags of the traces of the joint model, with their severity: fit, decode, score, flag."""
    m, _, trace = healthy_trace(spark, d)
    found = traces.flags(trace, written(traces.bundle(spark, m, [CHANNEL_ALPHA]).coalesce(1), "bundle"), HEALTHY)
    return rounded(found.select("trial_id", "tick", "channel", "place", "recipe", "value", "threshold", S.severity(F.col("value"), F.col("threshold")).alias("severity")))


@query
def trace_cascade(spark, d):
    """Flags by channel under one model of all trials, with the recipes of segments by an HMM over decoded segments."""
    m, t = event_model(spark, d), ticks(spark, d)
    hmm = recipes.recipe_em(segments(spark, d), 3, 5, 3, [0])[0]
    trace = traces.trace_cascade(t, m, hmm, HEALTHY)
    found = traces.flags(trace, traces.bundle(spark, traces.single(m), [CHANNEL_ALPHA], hmm=hmm), HEALTHY, by_recipe_path=True)
    return found.groupBy("trial_id", "channel").agg(F.count("*").alias("flags"))


@query
def narrated_traces(spark, d):
    """Questions on the flags of traces, with what each trial's own recipe expects."""
    m, w, trace = healthy_trace(spark, d)
    found = written(traces.flags(trace, written(traces.bundle(spark, m, [CHANNEL_ALPHA]).coalesce(1), "bundle"), HEALTHY), "trace-flags")
    names = events.vocabulary(table(spark, d, "events"), "event_type").select(F.col("id").alias("state"), F.col("token").alias("name"))
    items = w.ticks.select("noun_id", F.concat(F.lit("item"), F.col("noun_id").cast("string")).alias("item")).distinct()
    return traces.narrated(trace, found, w.ticks, m, names, items, CHANNEL_ALPHA)


@query
def belief_diagnostic(spark, d):
    return rounded(traces.belief_diagnostic(healthy_trace(spark, d)[2], HEALTHY))


@query
def evaluate_decoded(spark, d):
    """By type of error: what the union of all channels finds in errors injected into decoded trials, ticks of traces."""
    m, w, trace = healthy_trace(spark, d)
    rows, windows, _, bad = degraded_trace(w, m, trace)
    thresholds = written(traces.bundle(spark, m, [CHANNEL_ALPHA / 10]).coalesce(1), "bundle")
    any_flag = lambda found, keys: found.select(*keys, "tick").distinct().withColumn("flagged", F.lit(True))
    good = w.ticks.select("trial_id", "tick").join(any_flag(traces.flags(trace, thresholds, HEALTHY), HEALTHY), ["trial_id", "tick"], "left").fillna(False, ["flagged"])
    return rounded(E.tick_report(E.tick_outcomes(windows, any_flag(traces.flags(bad, thresholds, DEGRADED), DEGRADED)), good))


@query
def junction_fates(spark, d):
    """What becomes of never-seen moves that injected errors make: decoded away, decoded, flagged; and flipped recipes."""
    m, w, trace = healthy_trace(spark, d)
    rows, _, decoded, bad = degraded_trace(w, m, trace)
    found = traces.flags(bad, written(traces.bundle(spark, m, [CHANNEL_ALPHA]).coalesce(1), "bundle"), DEGRADED)
    return traces.junction_fates(bad, found, rows, decoded, decoded.select("trial_id", "recipe").distinct())


@query
def warm_counts(spark, d):
    """Counts of a start of the joint model: each segment three parts its trial's recipe, one part the next one."""
    s = segments(spark, d)
    parts = F.array(F.struct("recipe", F.lit(0.75).alias("w")), F.struct(((F.col("recipe") + 1) % 5).cast("int").alias("recipe"), F.lit(0.25).alias("w")))
    labels = s.select("trial_id", "seg_idx", F.explode(parts).alias("x")).select("trial_id", "seg_idx", "x.recipe", "x.w")
    return rounded(warm.weighted_counts(s, labels, D_MAX))


@query
def warm_start(spark, d):
    """The joint model started from one model and an HMM over its segments, in stored form."""
    s, m = segments(spark, d), event_model(spark, d)
    hmm = recipes.recipe_em(s, 3, 5, 3, [0])[0]
    return rounded(warm.warm_start(s, warm.segment_labels(s, hmm), m, 3).long(spark))


@query
def recipe_hmm(spark, d):
    """The recipe of each trial by an HMM over its segments, after three iterations."""
    s = segments(spark, d)
    return recipes.decoded_recipes(s, recipes.recipe_em(s, 3, 5, 3, [0])[0])


@query
def kmeans_spherical(spark, d):
    bags = C.pair_bags(ticks(spark, d)).select("trial_id", F.concat_ws("-", F.col("verb_id").cast("string"), F.col("noun_id").cast("string")).alias("item"), "weight")
    return explore.spherical_kmeans(bags, 5, 5)


@query
def ancestral_sample(spark, d):
    return fit.sampled(spark, event_model(spark, d), 100, 80, 7)


@query
def gmm_bic(spark, d):
    values = ticks(spark, d).select("recipe", (F.col("noun_id") + F.when(F.col("verb_id") == 0, 30.0).otherwise(0.0)).alias("x"))
    return explore.bimodality(values, "recipe")


@query
def mannwhitney_drift(spark, d):
    s = segments(spark, d)
    return lifecycle.duration_drift(s.filter(F.col("trial_id") % 2 == 0).withColumn("duration", F.col("duration") + 2), s.filter(F.col("trial_id") % 2 == 1))


@query
def narrated_flags(spark, d):
    w = world(spark, d)
    t = channel_tables(w)
    names = events.vocabulary(table(spark, d, "events"), "event_type").select(F.col("id").alias("state"), F.col("token").alias("name"))
    items = w.ticks.select("noun_id", F.concat(F.lit("item"), F.col("noun_id").cast("string")).alias("item")).distinct()
    numbered = R.run_numbers(w.ticks.select("trial_id", "tick", "verb_id"), ["verb_id"]).select("trial_id", "tick", "seg_idx")
    flags = written(healthy_channel_flags(w, t, [CHANNEL_ALPHA]).join(data(numbered), ["trial_id", "tick"]), "flags")
    flagged = S.transition_flags(S.transition_surprise(w.segments, w.logp), S.transition_thresholds(w.logp, ALPHA))
    means = C.duration_moments(C.duration_counts(w.segments, 50))
    order = narrate.order_questions(flagged, S.expected_next(w.logp).drop("logp"), sequence.bridges(w.logp), names)
    durations = narrate.duration_questions(S.completed_durations(w.segments, t.tails, D_MAX), w.segments, names, means, CHANNEL_ALPHA)
    emitted, stalled = narrate.emission_questions(flags, w.ticks, t.nouns, t.verbs, names, items), narrate.stall_questions(flags, names, means, w.segments)
    return narrate.narrated(*(written(q, "questions") for q in (order, durations, emitted, stalled)))  # their order is told by a pass of its own


def queries() -> dict[str, Query]:
    return dict(QUERIES)
