"""Event logs as tick sequences: one trial per user, one tick per event, verb and item from the event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECIPES = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(tokens: DataFrame, column: str) -> DataFrame:
    """(token, id): the sorted distinct tokens numbered from 0. A vocabulary is small by nature."""
    distinct = tokens.select(F.col(column).alias("token")).filter("token is not null").distinct()
    return distinct.withColumn("id", (F.row_number().over(Window.orderBy("token")) - 1).cast("int"))


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial_id, tick, verb, verb_id, noun_id, recipe, ts, event_id of the events table."""
    events = table(spark, sf_dir, "events")
    in_trial = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select(
        F.col("user_id").alias("trial_id"),
        (F.row_number().over(in_trial) - 1).cast("int").alias("tick"),
        F.col("event_type").alias("verb"),
        F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("int").alias("noun_id"),
        (F.col("user_id") % RECIPES).cast("int").alias("recipe"),
        "ts",
        "event_id",
    )
    verbs = vocabulary(events, "event_type").select(F.col("token").alias("verb"), F.col("id").alias("verb_id"))
    return rows.join(verbs, "verb")


def part_of(test_of: int = 5) -> Column:
    """The part of a row's trial_id: every `test_of`-th is for testing."""
    return F.when(F.col("trial_id") % test_of == 0, "test").otherwise("train")


def split_parts(trials: DataFrame, test_of: int = 5) -> DataFrame:
    """(trial_id, part): every `test_of`-th trial id is for testing; a scalable, stateless split."""
    return trials.select("trial_id").distinct().withColumn("part", part_of(test_of))


def keep_part(rows: DataFrame, split: DataFrame, part: str) -> DataFrame:
    """Rows of the trials in one part."""
    if part not in ("train", "test"):
        raise ValueError(f"unknown part {part!r}")
    return rows.join(split.filter(F.col("part") == part), "trial_id", "left_semi")
