"""Scores of detectors on injected errors: ticks, steps, trials, counterfactuals, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TICK_TOLERANCE, STEP_TOLERANCE = 5, 1


def truth_steps(steps: DataFrame, windows: DataFrame) -> DataFrame:
    """Steps that overlap the window of their trial's error."""
    return steps.join(windows, ["trial_id", "error_type"]).filter((F.col("tick_start") <= F.col("t1")) & (F.col("tick_end") > F.col("t0")))


def covering_step(steps: DataFrame, points: DataFrame) -> DataFrame:
    """Each point (trial_id, at) with the index of the step that it lies in, or null."""
    spans = steps.select("trial_id", "seg_idx", "tick_start", "tick_end")
    inside = (points["trial_id"] == spans["trial_id"]) & (F.col("at") >= F.col("tick_start")) & (F.col("at") < F.col("tick_end"))
    return points.join(spans, inside, "left").select(points["trial_id"], "at", "seg_idx")


def matched_corrections(rows: DataFrame, least_seconds: float = 2.0, part: float = 0.5) -> DataFrame:
    """Adds move_ok and duration_ok to rows with (move, seconds) proposed and (true_move, true_seconds).

    The duration may be off by `part` of the true one, or by `least_seconds`; it is judged apart from the move, since an
    abandoned step keeps its move. Without a proposal or a truth both are null.
    """
    both = F.col("move").isNotNull() & F.col("true_move").isNotNull()
    near = F.abs(F.col("seconds") - F.col("true_seconds")) <= F.greatest(F.lit(least_seconds), part * F.col("true_seconds"))
    return rows.withColumn("move_ok", F.when(both, F.col("move") == F.col("true_move"))).withColumn("duration_ok", F.when(both, near))


def is_touched() -> Column:
    """Whether a degraded tick holds or borders an edited one, or is the last before a splice within its step."""
    w = Window.partitionBy("trial_id", "error_type").orderBy("tick")
    by_edit = F.col("edited") | F.coalesce(F.lag("edited").over(w), F.lit(False)) | F.coalesce(F.lead("edited").over(w), F.lit(False))
    splice = (F.lead("seg_idx").over(w) == F.col("seg_idx")) & (F.lead("src_tick").over(w) != F.col("src_tick") + 1)
    return by_edit | F.coalesce(splice, F.lit(False))


def debris_steps(degraded: DataFrame, truth: DataFrame) -> DataFrame:
    """Steps that the injection made or stretched without being the error: they hold or border an edited tick, or
    span a place where successive ticks don't come from successive source ticks.

    The ticks carry the number of their step (seg_idx), so no interval is joined.
    """
    keys = ["trial_id", "error_type"]
    near = degraded.select(*keys, "seg_idx", is_touched().alias("touched"))
    touched = near.groupBy(*keys, "seg_idx").agg(F.bool_or("touched").alias("touched")).filter("touched").drop("touched")
    return touched.join(truth.select(*keys, "seg_idx"), [*keys, "seg_idx"], "left_anti")


def projected_flags(degraded: DataFrame, healthy: DataFrame) -> DataFrame:
    """For each degraded tick, whether the healthy trial is flagged at the tick that it comes from."""
    source = healthy.select("trial_id", F.col("tick").alias("src_tick"), F.col("flagged").alias("projected"))
    return degraded.join(source, ["trial_id", "src_tick"], "left").withColumn("projected", F.coalesce("projected", F.lit(False)))


def tick_outcomes(windows: DataFrame, flags: DataFrame, tolerance: int = TICK_TOLERANCE) -> DataFrame:
    """Each degraded trial: detected (a flag in the window or up to `tolerance` ticks after), latency, stray (a flag elsewhere)."""
    keys = ["trial_id", "error_type"]
    hit = F.col("flagged") & (F.col("tick") >= F.col("t0")) & (F.col("tick") <= F.col("t1") + tolerance)
    rows = windows.join(flags.filter("flagged"), keys, "left")
    return rows.groupBy(*keys, "t0", "t1").agg(
        F.coalesce(F.max(hit.cast("int")), F.lit(0)).alias("detected"),
        F.min(F.when(hit, F.col("tick") - F.col("t0"))).alias("latency"),
        F.coalesce(F.max((F.col("flagged") & ~hit).cast("int")), F.lit(0)).alias("stray"),
    )


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def tick_report(outcomes: DataFrame, healthy: DataFrame) -> DataFrame:
    """By error type: recall, precision with and without the healthy trials' false alarms, mean latency.

    A stray flag counts as a false alarm only in trials that aren't detected.
    """
    alarms = healthy.groupBy("trial_id").agg(F.max(F.col("flagged").cast("int")).alias("any")).agg(F.sum("any").alias("healthy_fp"))
    by = outcomes.groupBy("error_type").agg(
        F.count("*").alias("n"), F.sum("detected").alias("tp"), F.sum(((F.col("detected") == 0) & (F.col("stray") == 1)).cast("int")).alias("fp_out"), F.avg("latency").alias("mean_latency")
    )
    rows = by.join(alarms, F.lit(True))  # one row
    return rows.select(
        "error_type", "n", "tp", "fp_out", ratio(F.col("tp"), F.col("n")).alias("recall"), ratio(F.col("tp"), F.col("tp") + F.col("fp_out") + F.col("healthy_fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp_out")).alias("precision_excl_healthy"), "mean_latency",
    )


def counterfactual_outcomes(projected: DataFrame, windows: DataFrame, tolerance: int = TICK_TOLERANCE) -> DataFrame:
    """Each degraded trial: detected (a flag that its healthy run doesn't have), localized (the first one is in the window), latency."""
    keys = ["trial_id", "error_type"]
    first = projected.filter(F.col("flagged") & ~F.col("projected")).groupBy(*keys).agg(F.min("tick").alias("first"))
    within = (F.col("first") >= F.col("t0")) & (F.col("first") <= F.col("t1") + tolerance)
    rows = windows.join(first, keys, "left").withColumn("localized", F.coalesce(within, F.lit(False)).cast("int"))
    return rows.select(*keys, F.col("first").isNotNull().cast("int").alias("detected"), "localized", F.when(F.col("localized") == 1, F.col("first") - F.col("t0")).alias("latency"))


def counterfactual_report(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("error_type").agg(F.count("*").alias("n"), F.avg("detected").alias("detection_rate"), F.avg("localized").alias("localisation_rate"), F.avg("latency").alias("mean_latency"))


def trial_location(outcomes: DataFrame, healthy: DataFrame) -> DataFrame:
    """Counts of trials on the level of location: an error found in its window is tp, else fn, and fp too if something else
    was flagged; a healthy trial is fp if anything was flagged, else tn."""
    said = healthy.groupBy("trial_id").agg(F.bool_or("flagged").alias("any"))
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    found, stray = F.col("detected") == 1, F.col("stray") == 1
    errors = outcomes.agg(n(found).alias("tp"), n(~found & stray).alias("fp_out"), n(~found).alias("fn"))
    well = said.agg(n(F.col("any")).alias("fp_healthy"), n(~F.col("any")).alias("tn"))
    return errors.join(well, F.lit(True))  # one row each


def mcnemar(pairs: DataFrame) -> DataFrame:
    """By error type, from (before, after) of each trial: discordant counts and the corrected chi-square."""
    b = F.sum(((F.col("after") == 1) & (F.col("before") == 0)).cast("int"))
    c = F.sum(((F.col("after") == 0) & (F.col("before") == 1)).cast("int"))
    rows = pairs.groupBy("error_type").agg(b.alias("gained"), c.alias("lost"))
    gap = F.abs(F.col("gained") - F.col("lost")) - 1
    chi2 = F.coalesce(gap * gap / F.nullif(F.col("gained") + F.col("lost"), F.lit(0)), F.lit(0.0))
    return rows.withColumn("chi2", chi2).withColumn("significant", F.col("chi2") > 3.84)


def step_outcomes(flagged_steps: DataFrame, truth: DataFrame, debris: DataFrame, tolerance: int = STEP_TOLERANCE) -> DataFrame:
    """Each degraded trial: detected (a flagged step from its first true step to `tolerance` after its last), and its
    flagged steps elsewhere, debris left out."""
    keys = ["trial_id", "error_type"]
    span = truth.groupBy(*keys).agg(F.min("seg_idx").alias("g0"), F.max("seg_idx").alias("g1"))
    rows = span.join(flagged_steps, keys, "left").join(debris.withColumn("is_debris", F.lit(True)), [*keys, "seg_idx"], "left")
    hit = (F.col("seg_idx") >= F.col("g0")) & (F.col("seg_idx") <= F.col("g1") + tolerance)
    return rows.groupBy(*keys).agg(
        F.coalesce(F.max(hit.cast("int")), F.lit(0)).alias("detected"), F.coalesce(F.sum((~hit & F.col("is_debris").isNull()).cast("int")), F.lit(0)).alias("false_steps")
    )


def sequence_report(healthy: DataFrame, trials: DataFrame, found: DataFrame, truth: DataFrame) -> DataFrame:
    """By type of error: trials (n), those with a verdict at the error (detected) and one that names its type (named), and of
    healthy trials how many there are and how many have a verdict at all.

    `healthy` are verdicts on healthy `trials`; `found` (trial_id, error_type, seg_idx, verdict) those on degraded ones. A
    verdict is at the error if its segment is one of the true ones, the one before or the one after.
    """
    keys = ["trial_id", "error_type"]
    alarms = trials.select("trial_id").distinct().join(healthy.select("trial_id", F.lit(True).alias("said")).distinct(), "trial_id", "left")
    alarms = alarms.agg(F.count("*").alias("healthy"), F.count("said").alias("healthy_flagged"))
    span = truth.groupBy(*keys).agg(F.min("seg_idx").alias("g0"), F.max("seg_idx").alias("g1"))
    rows = span.join(found, keys, "left").withColumn("at", F.coalesce(F.col("seg_idx").between(F.col("g0") - 1, F.col("g1") + 1), F.lit(False)))
    each = rows.groupBy(*keys).agg(F.max(F.col("at").cast("int")).alias("hit"), F.max((F.col("at") & (F.col("verdict") == F.col("error_type"))).cast("int")).alias("right"))
    by = each.groupBy("error_type").agg(F.count("*").alias("n"), F.sum("hit").alias("detected"), F.sum(F.coalesce("right", F.lit(0))).alias("named"))
    return by.join(F.broadcast(alarms), F.lit(True))  # one row


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr")]


def alarm_runs(flags: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of flagged ticks of each trial."""
    before = F.coalesce(F.lag("flagged").over(Window.partitionBy(*keys).orderBy("tick")), F.lit(False))
    return flags.withColumn("starts", (F.col("flagged") & ~before).cast("int")).groupBy(*keys).agg(F.sum("starts").alias("alarms"), F.sum(F.col("flagged").cast("int")).alias("flagged_ticks"))


def pr_auc(curve: DataFrame) -> DataFrame:
    """Area under precision over recall by the trapezoid rule; equal recalls are ordered by precision."""
    w = Window.partitionBy(F.lit(1)).orderBy("recall", "precision")  # one row for each alpha
    rows = curve.withColumn("r0", F.lag("recall").over(w)).withColumn("p0", F.lag("precision").over(w))
    return rows.agg(F.sum((F.col("recall") - F.col("r0")) * (F.col("precision") + F.col("p0")) / 2).alias("pr_auc"))


def best_alpha(curve: DataFrame) -> DataFrame:
    best = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("f1", 9)), "alpha")
    return curve.withColumn("rank", F.row_number().over(best)).filter("rank = 1").drop("rank")


def boundary_scores(found: DataFrame, true: DataFrame) -> DataFrame:
    """Precision, recall and F1 of segment starts against true starts (trial_id, tick)."""
    both = found.withColumn("f", F.lit(1)).join(true.withColumn("t", F.lit(1)), ["trial_id", "tick"], "full")
    sums = both.agg(F.sum(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0)).alias("hit"), F.count("f").alias("nf"), F.count("t").alias("nt"))
    return sums.select("hit", ratio(F.col("hit"), F.col("nf")).alias("precision"), ratio(F.col("hit"), F.col("nt")).alias("recall"), ratio(2 * F.col("hit"), F.col("nf") + F.col("nt")).alias("f1"))


def purity(rows: DataFrame, state: str, label: str) -> DataFrame:
    """Each state's most frequent label's share, and the number of its ticks."""
    n = rows.groupBy(state, label).agg(F.count("*").alias("n"))
    return n.groupBy(state).agg(F.sum("n").alias("ticks"), (F.max("n") / F.sum("n")).alias("purity"))
