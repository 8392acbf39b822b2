"""Interval annotations in text files: canonical view of each trial, segments, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cameras in order of preference.
CAMERA_PRIORITY = ["cam01", "cam02", "stereo01", "webcam01", "webcam02"]
#: The names of the files and the grammar of their lines.
FILE_NAME = r"(?:^|/)(P\d+)_([a-zA-Z0-9]+)_P\d+_([a-zA-Z0-9]+)\.txt$"
LINE = r"^(\d+)-(\d+)\s+(\S+)"


def read_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all text files below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").option("wholetext", "true").text(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def named_views(files: DataFrame) -> DataFrame:
    """Adds participant, camera, recipe and trial_id; files of other names are left out."""
    part = lambda k: F.regexp_extract("path", FILE_NAME, k)
    views = files.select("*", part(1).alias("participant"), part(2).alias("camera"), part(3).alias("recipe")).filter("participant != ''")
    return views.withColumn("trial_id", F.concat_ws("_", "participant", "recipe"))


def canonical_views(views: DataFrame) -> DataFrame:
    """One view of each trial: the camera that comes first in the order of preference.

    A trial that only unknown cameras saw is an error when it is read.
    """
    place = F.array_position(F.array(*map(F.lit, CAMERA_PRIORITY)), F.col("camera"))
    best = Window.partitionBy("trial_id").orderBy(F.when(place > 0, place).otherwise(len(CAMERA_PRIORITY) + 1), "camera")
    ranked = views.withColumn("place", place).withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    known = F.when(F.col("place") > 0, F.col("camera")).otherwise(F.raise_error(F.concat(F.lit("no known camera for "), F.col("trial_id"))))
    return ranked.withColumn("camera", known).drop("place", "rank")


def view_disagreements(views: DataFrame) -> DataFrame:
    """Trials whose views differ in content, with the number of different contents."""
    return views.groupBy("trial_id").agg(F.count_distinct(F.sha2("content", 256)).cast("int").alias("n_contents")).filter("n_contents > 1")


def parse_lines(rows: DataFrame, line: str, keys: list[str]) -> DataFrame:
    """label, start_frame and end_frame of lines `a-b label`; other lines are left out."""
    text = F.trim(F.col(line))
    part = lambda k: F.regexp_extract(text, LINE, k)
    return rows.filter(text.rlike(LINE)).select(*keys, part(3).alias("label"), part(1).cast("int").alias("start_frame"), part(2).cast("int").alias("end_frame"))


def verb_of(label: Column, idle_verb: str = "stall") -> Column:
    """The part of a label before its first underscore; SIL is the idle verb."""
    return F.when(label == "SIL", idle_verb).otherwise(F.split(label, "_", 2)[0])


def noun_of(label: Column, idle_noun: str = "kitchen") -> Column:
    """The part of a label behind its first underscore; a label without one is an error."""
    parts = F.split(label, "_", 2)
    return F.when(label == "SIL", idle_noun).when(F.size(parts) == 2, F.get(parts, 1)).otherwise(F.raise_error(F.concat(F.lit("label without underscore: "), label)))


def segments(views: DataFrame, idle: tuple[str, str] = ("stall", "kitchen")) -> DataFrame:
    """trial_id, recipe, seg_idx, label, verb, noun, start_frame, end_frame of canonical views."""
    lines = views.select("trial_id", "recipe", F.posexplode(F.split("content", "\n")).alias("line_no", "value"))
    parsed = parse_lines(lines, "value", ["trial_id", "recipe", "line_no"])
    order = Window.partitionBy("trial_id").orderBy("line_no")
    label = F.col("label")
    return parsed.select(
        "trial_id", "recipe", (F.row_number().over(order) - 1).cast("int").alias("seg_idx"), "label", verb_of(label, idle[0]).alias("verb"), noun_of(label, idle[1]).alias("noun"), "start_frame", "end_frame"
    )


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(trial_id, part) of a split file {seed, test_frac, train_trial_ids, test_trial_ids}."""
    held = spark.read.schema("seed long, test_frac double, train_trial_ids array<string>, test_trial_ids array<string>").json(path, multiLine=True)
    of = lambda part: held.select(F.explode(f"{part}_trial_ids").alias("trial_id"), F.lit(part).alias("part"))
    return of("train").unionByName(of("test"))


def random_split(trials: DataFrame, test_frac: float, seed: int) -> DataFrame:
    """(trial_id, part): round(n * test_frac) trials, those of the smallest seeded hashes, are for testing.

    The hashes are counted by their first 16 bits; only the trials of the class in which the split falls are sorted.
    """
    ids = trials.select("trial_id").distinct().withColumn("draw", F.xxhash64(F.lit(seed), "trial_id")).withColumn("first_bits", F.shiftright("draw", 48))
    counts = sorted(ids.groupBy("first_bits").count().collect())  # 65,536 rows at most
    left, within = round(sum(r["count"] for r in counts) * test_frac), None
    for r in counts:
        if left < r["count"]:
            within = r["first_bits"]
            break
        left -= r["count"]
    if within is None:
        return ids.select("trial_id", F.lit("test").alias("part"))
    last = ids.filter(F.col("first_bits") == within).orderBy("draw").limit(left).agg(F.max("draw")).first()[0]
    before = F.col("first_bits") < within
    chosen = before if last is None else before | ((F.col("first_bits") == within) & (F.col("draw") <= last))
    return ids.select("trial_id", F.when(chosen, "test").otherwise("train").alias("part"))


def nested_split(split: DataFrame, dev_frac: float, seed: int) -> DataFrame:
    """(trial_id, part) of the training trials of a split only: `dev_frac` of these become `test`, the others stay `train`."""
    return random_split(split.filter("part = 'train'"), dev_frac, seed)


def of_recipes(rows: DataFrame, trials: DataFrame, recipes: list[str]) -> DataFrame:
    """Rows of the trials (trial_id, recipe) of these recipes: a smaller data set with the ids of the whole."""
    return rows.join(trials.filter(F.col("recipe").isin(recipes)).select("trial_id").distinct(), "trial_id", "left_semi")


def write_sequences(ticks: DataFrame, path: str) -> None:
    """One JSON row per trial: trial_id, verb_ids, noun_ids."""
    packed = ticks.groupBy("trial_id").agg(F.array_sort(F.collect_list(F.struct("tick", "verb_id", "noun_id"))).alias("t"))
    packed.select("trial_id", F.col("t.verb_id").alias("verb_ids"), F.col("t.noun_id").alias("noun_ids")).write.mode("overwrite").json(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """trial_id, tick, verb_id, noun_id of such rows."""
    rows = spark.read.schema("trial_id string, verb_ids array<int>, noun_ids array<int>").json(path)
    return rows.select("trial_id", F.posexplode(F.arrays_zip("verb_ids", "noun_ids")).alias("tick", "t")).select("trial_id", "tick", F.col("t.verb_ids").alias("verb_id"), F.col("t.noun_ids").alias("noun_id"))
