"""Flags as questions: what was unexpected, where, and what was expected instead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqwatch.operators.surprise import PLACES, severity
from seqwatch.sources.durable import data


def order_questions(flagged: DataFrame, expected: DataFrame, bridges: DataFrame, names: DataFrame, least_gain: float = 2.0, by: Sequence[str] = ()) -> DataFrame:
    """Of flagged transitions: a skipped step if a bridge explains it, else a step out of order.

    With `by`, what is expected and what bridges depends on these columns of the transitions.
    """
    over = bridges.filter(F.col("gain") >= least_gain).select(*by, "from_state", F.col("to_state").alias("state"), "bridge")
    name = lambda of, alias: names.select(F.col("state").alias(of), F.col("name").alias(alias))
    rows = flagged.filter("flagged").join(over, [*by, "from_state", "state"], "left").join(expected, [*by, "from_state"])
    for of, alias in (("from_state", "n_from"), ("state", "n_state"), ("expected_state", "n_expected"), ("bridge", "n_bridge")):
        rows = rows.join(name(of, alias), of, "left")
    skipped = F.format_string("Did you skip '%s' between '%s' and '%s'?", "n_bridge", "n_from", "n_state")
    odd = F.format_string("'%s' came after '%s'; usually '%s' does. Is that right?", "n_state", "n_from", "n_expected")
    return rows.select(
        "trial_id", F.col("tick_start").alias("tick"), F.lit("s_transition").alias("channel"), F.when(F.col("bridge").isNotNull(), "missing_step").otherwise("out_of_order").alias("kind"),
        severity(F.col("s_transition"), F.col("threshold")).alias("severity"), F.when(F.col("bridge").isNotNull(), skipped).otherwise(odd).alias("text"),
    )


def duration_questions(completed: DataFrame, segments: DataFrame, names: DataFrame, expected: DataFrame, alpha: float, by: Sequence[str] = ()) -> DataFrame:
    """Of closed segments with durations in the tails: left early, or stuck; expected durations may depend on `by`."""
    limit = -F.log(F.lit(alpha))
    rows = completed.filter(F.round("s_dur_two", PLACES) > F.round(limit, PLACES)).join(data(segments.select("trial_id", "seg_idx", "tick_end")), ["trial_id", "seg_idx"]).join(names, "state").join(expected.select(*by, "state", "mean_duration"), [*by, "state"])
    early = F.format_string("'%s' ended after %d ticks; usually it takes about %d. Was it left early?", "name", "duration", F.round("mean_duration").cast("int"))
    late = F.format_string("'%s' took %d ticks; usually about %d. Was something wrong?", "name", "duration", F.round("mean_duration").cast("int"))
    return rows.select(
        "trial_id", (F.col("tick_end") - 1).cast("int").alias("tick"), F.lit("s_dur_two").alias("channel"), F.when(F.col("cause") == "left_early", "left_early").otherwise("retro_stall").alias("kind"),
        severity(F.col("s_dur_two"), limit).alias("severity"), F.when(F.col("cause") == "left_early", early).otherwise(late).alias("text"),
    )


def emission_questions(flags: DataFrame, ticks: DataFrame, log_nouns: DataFrame, log_verbs: DataFrame, names: DataFrame, items: DataFrame) -> DataFrame:
    """Of flagged items and actions, the most surprising tick of each segment and channel (the first of equals): what was
    seen, and what is likeliest in the believed state.

    `flags` has (trial_id, tick, seg_idx, channel, place, value, threshold); a tick's item is asked for only if it is more
    surprising than its action, and the other way round. `names` has (state, name) of actions, `items` (noun_id, item).
    """
    sums = flags.groupBy("trial_id", "tick").pivot("channel", ["s_noun", "s_verb"]).agg(F.first("value")).withColumnsRenamed({"s_noun": "vn", "s_verb": "vv"})
    rows = flags.filter("channel in ('s_noun', 's_verb')").join(data(sums), ["trial_id", "tick"])
    other = F.when(F.col("channel") == "s_noun", F.coalesce("vv", F.lit(float("-inf")))).otherwise(F.coalesce("vn", F.lit(float("-inf"))))
    best = Window.partitionBy("trial_id", "seg_idx", "channel").orderBy(F.desc(F.round("value", PLACES)), "tick")
    rows = rows.filter(F.round("value", PLACES) > F.round(other, PLACES)).withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    top = lambda t, token: t.groupBy("state").agg(F.min_by(token, F.struct(-F.round("logp", PLACES), F.col(token))).alias("likeliest")).withColumnRenamed("state", "place")
    rows = rows.join(data(ticks.select("trial_id", "tick", "verb_id", "noun_id")), ["trial_id", "tick"])
    item = rows.filter("channel = 's_noun'").join(top(log_nouns, "noun_id"), "place")
    for of, alias in (("noun_id", "n_seen"), ("likeliest", "n_likeliest")):
        item = item.join(items.select(F.col("noun_id").alias(of), F.col("item").alias(alias)), of)
    item = item.withColumn("text", F.format_string("Was '%s' meant here? '%s' was expected.", "n_seen", "n_likeliest")).withColumn("kind", F.lit("item_substitution"))
    verb = rows.filter("channel = 's_verb'").join(top(log_verbs, "verb_id"), "place")
    for of, alias in (("verb_id", "n_seen"), ("likeliest", "n_likeliest")):
        verb = verb.join(names.select(F.col("state").alias(of), F.col("name").alias(alias)), of)
    verb = verb.withColumn("text", F.format_string("Was '%s' meant here? '%s' was expected.", "n_seen", "n_likeliest")).withColumn("kind", F.lit("wrong_action"))
    columns = ["trial_id", "tick", "channel", "kind", severity(F.col("value"), F.col("threshold")).alias("severity"), "text"]
    return item.select(*columns).unionByName(verb.select(*columns))


def stall_questions(flags: DataFrame, names: DataFrame, expected: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The first tick of each segment that lasts too long so far; expected durations may depend on `by` of the segments."""
    first = flags.filter("channel = 's_temporal'").groupBy("trial_id", "seg_idx").agg(F.min_by(F.struct("tick", "value", "threshold"), "tick").alias("x")).select("trial_id", "seg_idx", "x.*")
    rows = first.join(data(segments.select("trial_id", "seg_idx", *by, "state", "tick_start")), ["trial_id", "seg_idx"]).join(names, "state").join(expected.select(*by, "state", "mean_duration"), [*by, "state"])
    text = F.format_string("Still at '%s' after %d ticks? Usually it takes about %d.", "name", (F.col("tick") - F.col("tick_start") + 1).cast("int"), F.round("mean_duration").cast("int"))
    return rows.select("trial_id", "tick", F.lit("s_temporal").alias("channel"), F.lit("stall").alias("kind"), severity(F.col("value"), F.col("threshold")).alias("severity"), text.alias("text"))


def narrated(*questions: DataFrame) -> DataFrame:
    """All questions; their order is (trial_id, tick, channel)."""
    out = questions[0]
    for q in questions[1:]:
        out = out.unionByName(q)
    return out.orderBy("trial_id", "tick", "channel")
