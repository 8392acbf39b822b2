"""What a judge of steps is told: vocabularies, typical recipes, the task; requests by prefix and as conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqwatch.operators.inject import ERROR_TYPES

VARIANTS = ["plain", "with recipes"]
TASK = (
    "You watch a person do a task, step by step, and judge the last step shown.\n"
    "Answer in one line: `No Anomaly`, or `TYPE Anomaly. Correct move would have been ACTION ITEM for N seconds`,\n"
    f"where TYPE is one of {', '.join(ERROR_TYPES)}, and action and item are from the lists below. Most steps are fine."
)


def listed(tokens: DataFrame, title: str) -> DataFrame:
    """One row: `title (n): tokens in the order of their ids`, of a vocabulary (token, id)."""
    ordered = F.array_sort(F.collect_list(F.struct("id", "token")))["token"]
    return tokens.agg(F.concat(F.lit(f"{title} ("), F.count("*").cast("string"), F.lit("): "), F.array_join(ordered, ", ")).alias("text"))


def vocabulary_block(verbs: DataFrame, nouns: DataFrame) -> DataFrame:
    """One row: the actions and the items that an answer may name, verbatim, so that it can be scored exactly."""
    a, b = listed(verbs, "Actions").withColumnRenamed("text", "a"), listed(nouns, "Items").withColumnRenamed("text", "b")
    return a.join(F.broadcast(b), F.lit(True)).select(F.concat_ws("\n", "a", "b").alias("text"))  # one row each


def recipe_block(orders: DataFrame, names: DataFrame) -> DataFrame:
    """One row: each recipe's commonest order with typical durations, and how common it is, so that no order is a rule.

    `orders` is what `replies.canonical_orders` gives, `names` (state, name).
    """
    steps = orders.select("recipe", F.posexplode(F.arrays_zip(F.split("states", "-").alias("s"), F.split("durations", "-").alias("d"))).alias("step", "x"))
    steps = steps.join(F.broadcast(names.select(F.col("state").cast("string").alias("s"), "name")), F.col("x.s") == F.col("s"))
    shown = F.concat("name", F.lit(" (~"), F.col("x.d"), F.lit(" s)"))
    lines = steps.groupBy("recipe").agg(F.array_join(F.array_sort(F.collect_list(F.struct("step", shown.alias("t"))))["t"], ", ").alias("steps")).join(orders.select("recipe", "n_trials", "n_orders"), "recipe")
    line = F.format_string("recipe %s: %s [in %d trials; %d orders seen]", F.col("recipe").cast("string"), "steps", "n_trials", "n_orders")
    return lines.agg(F.array_join(F.array_sort(F.collect_list(F.struct("recipe", line.alias("t"))))["t"], "\n").alias("text"))  # a row a recipe


def system_prompts(vocabulary: DataFrame, recipes: DataFrame, task: str = TASK) -> DataFrame:
    """(variant, text): the task and the vocabulary, without and with the recipes."""
    both = vocabulary.withColumnRenamed("text", "v").join(F.broadcast(recipes.withColumnRenamed("text", "r")), F.lit(True))  # one row each
    plain, full = F.concat_ws("\n\n", F.lit(task), "v"), F.concat_ws("\n\n", F.lit(task), "v", "r")
    each = F.array(*[F.struct(F.lit(name).alias("variant"), text.alias("text")) for name, text in zip(VARIANTS, (plain, full))])
    return both.select(F.explode(each).alias("x")).select("x.*")


def prefix_requests(prompts: DataFrame, systems: DataFrame) -> DataFrame:
    """(variant, trial_id, seg_idx, messages) of each step: the system's text and what a judge may see of the trial.

    Requests don't depend on each other's answers, so they can be sent in any order.
    """
    rows = prompts.join(F.broadcast(systems), F.lit(True))  # a few variants
    return rows.select("variant", "trial_id", "seg_idx", F.array(message("system", "text"), message("user", "prompt")).alias("messages"))


def conversations(steps: DataFrame, replies: DataFrame, text: str = "text") -> DataFrame:
    """(trial_id, seg_idx, messages): the steps up to this one, each but the last with the answer that it got.

    `steps` has (trial_id, seg_idx, text), `replies` (trial_id, seg_idx, reply); a step without an answer has none.
    """
    rows = steps.select("trial_id", "seg_idx", text).join(replies.select("trial_id", "seg_idx", "reply"), ["trial_id", "seg_idx"], "left")
    before = Window.partitionBy("trial_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    answered = F.when(F.col("reply").isNull(), F.array(message("user", text))).otherwise(F.array(message("user", text), message("assistant", "reply")))
    return rows.withColumn("turn", answered).select("trial_id", "seg_idx", F.concat(F.flatten(F.collect_list("turn").over(before)), F.array(message("user", text))).alias("messages"))


def message(role: str, content: str):
    return F.struct(F.lit(role).alias("role"), F.col(content).alias("content"))


def trial_texts(steps: DataFrame, text: str = "text") -> DataFrame:
    """(trial_id, text): all steps of each trial as numbered lines."""
    line = F.concat((F.col("seg_idx") + 1).cast("string"), F.lit(". "), F.col(text))
    return steps.groupBy("trial_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seg_idx", line.alias("t"))))["t"], "\n").alias("text"))
