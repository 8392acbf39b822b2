"""Steps as text, and free-text verdicts on them read by a grammar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqwatch.operators.inject import ERROR_TYPES

#: The phrases of a reply.
NONE_FOUND = r"(?i)^\s*no\s+anomaly\s*[.!]?\s*$"
CORRECT_MOVE = r"(?i)\bcorrect\s+move\s+would\s+have\s+been\b"


def phrase(verb: Column, noun: Column, idle_verb: str = "stall", idle_noun: str = "kitchen") -> Column:
    return F.when((verb == idle_verb) & (noun == idle_noun), "idle").when(verb == idle_verb, noun).otherwise(F.concat_ws(" ", verb, noun))


def step_text(verb: Column, noun: Column, seconds: Column) -> Column:
    return F.concat(verb, F.lit(" "), noun, F.lit(" for "), seconds.cast("string"), F.when(seconds == 1, " second").otherwise(" seconds"))


def prefix_prompts(steps: DataFrame, text: str = "text") -> DataFrame:
    """For each step, the numbered lines of all steps up to it: what a judge who can't look ahead is shown."""
    upto = Window.partitionBy("trial_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0)
    line = F.concat((F.col("seg_idx") + 1).cast("string"), F.lit(". "), F.col(text))
    return steps.select("trial_id", "seg_idx", F.array_join(F.collect_list(line).over(upto), "\n").alias("prompt"))


def words_in(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def named_move(words: Column, at: Column) -> Column:
    """(verb, noun) of the words before `at`: two words, or the parts of one around its last underscore."""
    one, two = F.get(words, at - 1), F.get(words, at - 2)
    apart = F.regexp_extract(one, r"^(.*[^_])_+([^_]+)$", 1)
    both = F.when(two.rlike(r"^\w+$"), F.struct(two.alias("verb"), one.alias("noun")))
    return F.coalesce(both, F.when(apart != "", F.struct(apart.alias("verb"), F.regexp_extract(one, r"^(.*[^_])_+([^_]+)$", 2).alias("noun"))))


def timed(words: Column, at: Column) -> Column:
    """Whether `for N seconds` stands at the place."""
    return (F.lower(F.get(words, at)) == "for") & F.get(words, at + 1).rlike(r"^\d+$") & F.lower(F.get(words, at + 2)).isin("second", "seconds")


def strict_reading(text: Column) -> Column:
    """error_type and correction of a text that is a type, `anomaly` or not, and the correct move or nothing; else null.

    The type may end in one of `.:!`, the move in one of `.!`.
    """
    parts = F.split(text, CORRECT_MOVE)
    head = words_in(F.regexp_replace(parts[0], r"\s*[.:!]?\s*$", ""))
    kind = F.when((F.size(head) == 1) | ((F.size(head) == 2) & (F.lower(F.get(head, F.lit(1))) == "anomaly")), F.lower(F.get(head, F.lit(0))))
    tail = words_in(F.regexp_replace(F.get(parts, F.lit(1)), r"\s*[.!]?\s*$", ""))
    at = F.size(tail) - 3
    move = F.when(F.size(tail).isin(4, 5) & timed(tail, at) & F.get(tail, F.lit(0)).rlike(r"^\w+$") & F.get(tail, at - 1).rlike(r"^\w+$"), named_move(tail, at))
    read = F.struct(kind.alias("error_type"), move["verb"].alias("verb"), move["noun"].alias("noun"), F.when(move.isNotNull(), F.get(tail, at + 1)).cast("int").alias("seconds"))
    return F.when(kind.isin(*ERROR_TYPES) & ((F.size(parts) == 1) | ((F.size(parts) == 2) & move.isNotNull())), read)


def loose_reading(text: Column) -> Column:
    """The first type that a text names, and the first move that it times, if any; null without a type."""
    words = words_in(F.regexp_replace(text, r"[^\w\s]", " \u0001 "))
    kind = F.get(F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(*ERROR_TYPES)), F.lit(0))
    places = F.when(F.size(words) > 3, F.filter(F.sequence(F.lit(1), F.size(words) - 3), lambda i: timed(words, i) & named_move(words, i).isNotNull()))
    at = F.get(places, F.lit(0))
    move = named_move(words, at)
    return F.when(kind.isNotNull(), F.struct(kind.alias("error_type"), move["verb"].alias("verb"), move["noun"].alias("noun"), F.get(words, at + 1).cast("int").alias("seconds")))


def parsed_replies(replies: DataFrame, verbs: DataFrame, nouns: DataFrame) -> DataFrame:
    """is_anomaly, error_type, verb, noun, seconds and parse_ok of each `reply`.

    The first line with text is judged before the whole: `no anomaly` first, then the strict grammar; what only the
    loose one reads has parse_ok false, and so has what none reads, which is no anomaly. A correction counts only if
    both of its words are in the vocabulary, as written.
    """
    raw = F.trim(F.regexp_replace(F.coalesce("reply", F.lit("")), r"^\s+|\s+$", ""))
    first = F.coalesce(F.get(F.filter(F.split(F.col("raw"), "\n"), lambda x: F.trim(x) != ""), 0), F.lit(""))
    rows = replies.withColumn("raw", raw).withColumn("line", first)
    rows = rows.withColumn("none", F.col("line").rlike(NONE_FOUND) | F.col("raw").rlike(NONE_FOUND))
    rows = rows.withColumn("strict", F.when(~F.col("none"), F.coalesce(strict_reading(F.col("line")), strict_reading(F.col("raw")))))
    rows = rows.withColumn("found", F.coalesce("strict", F.when(~F.col("none"), loose_reading(F.col("raw")))))
    rows = rows.withColumns({"error_type": F.col("found.error_type"), "v": F.col("found.verb"), "n": F.col("found.noun"), "d": F.col("found.seconds")})
    known = lambda t, c: F.broadcast(t.select(F.col("token").alias(c), F.lit(True).alias(f"{c}_known")).distinct())  # noqa: E731  # vocabularies
    rows = rows.join(known(verbs, "v"), "v", "left").join(known(nouns, "n"), "n", "left")
    ok = F.col("v_known") & F.col("n_known") & F.col("d").isNotNull()
    keep = lambda c: F.when(F.coalesce(ok, F.lit(False)), F.col(c))
    return rows.select(*replies.columns, F.col("error_type").isNotNull().alias("is_anomaly"), "error_type", keep("v").alias("verb"), keep("n").alias("noun"), keep("d").alias("seconds"), (F.col("none") | F.col("strict").isNotNull()).alias("parse_ok"))


def split_batch(replies: DataFrame, steps: DataFrame) -> DataFrame:
    """Each step's line of a numbered reply (trial_id, reply); the first line of a number counts, missing ones are null."""
    lines = replies.select("trial_id", F.posexplode(F.split("reply", "\n")).alias("line_no", "line"))
    numbered = lines.select("trial_id", "line_no", (F.regexp_extract("line", r"^\s*(\d+)[.):]\s*(.*)$", 1)).alias("number"), F.regexp_extract("line", r"^\s*(\d+)[.):]\s*(.*)$", 2).alias("reply")).filter("number != ''")
    first = Window.partitionBy("trial_id", "seg_idx").orderBy("line_no")
    kept = numbered.withColumn("seg_idx", F.col("number").cast("int") - 1).withColumn("rank", F.row_number().over(first)).filter("rank = 1").select("trial_id", "seg_idx", "reply")
    return steps.select("trial_id", "seg_idx").join(kept, ["trial_id", "seg_idx"], "left")


def canonical_orders(steps: DataFrame) -> DataFrame:
    """By recipe: its most frequent order of states (the smaller text of equals), how many trials have it, how many orders
    there are, and for each step of that order the median duration of its state in all trials of the recipe, cut to whole numbers."""
    orders = steps.groupBy("trial_id", "recipe").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "state"))).alias("s")).select("recipe", F.array_join(F.transform("s.state", lambda x: x.cast("string")), "-").alias("states"))
    n = orders.groupBy("recipe", "states").agg(F.count("*").alias("n_trials"))
    best = Window.partitionBy("recipe").orderBy(F.desc("n_trials"), "states")
    ranked = n.withColumn("rank", F.row_number().over(best)).withColumn("n_orders", F.count("*").over(Window.partitionBy("recipe")))
    modes = ranked.filter("rank = 1").select("recipe", "states", "n_trials", "n_orders")
    medians = steps.groupBy("recipe", F.col("state").cast("string").alias("state")).agg(F.percentile("duration", F.lit(0.5)).cast("int").cast("string").alias("d"))
    each = modes.select("recipe", F.posexplode(F.split("states", "-")).alias("step", "state")).join(medians, ["recipe", "state"])
    durations = each.groupBy("recipe").agg(F.array_join(F.array_sort(F.collect_list(F.struct("step", "d")))["d"], "-").alias("durations"))
    return modes.join(durations, "recipe")
