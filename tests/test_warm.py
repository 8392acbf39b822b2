"""Starts of the joint model, nested splits, narrated drift."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwatch.operators import counts as C
from seqwatch.operators import lifecycle
from seqwatch.plans import decode, joint, recipes, warm
from seqwatch.sources import annotations


@pytest.fixture(scope="module")
def segments(spark):
    draw, rows = np.random.default_rng(2), []
    for t in range(12):
        state, at = int(draw.integers(0, 3)), 0
        for k in range(n := int(draw.integers(2, 9))):
            d = int(draw.integers(1, 9))
            rows.append((t, t % 2, k, state, at, at + d, d, k == n - 1))
            state, at = (state + int(draw.integers(1, 3))) % 3, at + d
    return spark.createDataFrame(rows, "trial_id long, recipe int, seg_idx int, state int, tick_start int, tick_end int, duration int, is_last boolean").cache()


def test_hard_labels_give_plain_counts(segments):
    labels = segments.select("trial_id", "seg_idx", "recipe", F.lit(1.0).alias("w"))
    found = {(r["family"], r["recipe"], r["i"], r["j"]): r["n"] for r in warm.weighted_counts(segments, labels, 6).collect()}
    expected = {("pi", r["recipe"], 0, 0): r["n"] for r in segments.select("trial_id", "recipe").distinct().groupBy("recipe").agg(F.count("*").alias("n")).collect()}
    expected |= {("init", r["recipe"], r["state"], 0): r["n"] for r in C.initial_counts(segments, ["recipe"]).collect() if r["n"]}
    expected |= {("trans", r["recipe"], r["from_state"], r["to_state"]): r["n"] for r in C.transition_counts(segments, ["recipe"]).collect() if r["n"]}
    expected |= {("dur", r["recipe"], r["state"], r["d"]): r["n"] for r in segments.groupBy("recipe", "state", F.least("duration", F.lit(6)).alias("d")).agg(F.count("*").alias("n")).collect()}
    assert found == pytest.approx(expected)


def model():
    k = 3
    with np.errstate(divide="ignore"):
        trans = np.log((1 - np.eye(k)) / (k - 1))
    return decode.Model(np.log(np.full(k, 1 / k)), trans, np.log(np.full((k, 4), 0.25)), np.log(np.full((k, 4), 0.25)), np.full(k, 2.0), np.full(k, 0.4), 12)


def test_a_start_keeps_rare_recipes_at_the_common_order(spark, segments):
    hmm = recipes.start(2, 3, 4)
    labels = warm.segment_labels(segments, hmm)
    sums = labels.groupBy("trial_id", "seg_idx").agg(F.sum("w").alias("s")).collect()
    assert len(sums) == segments.count() and all(r["s"] == pytest.approx(1) for r in sums)
    hard = segments.select("trial_id", "seg_idx", "recipe", F.lit(1.0).alias("w"))
    found = warm.warm_start(segments, hard, model(), 3)
    assert isinstance(found, joint.JointModel) and found.trans.shape == (3, 3, 3)
    np.testing.assert_allclose(np.exp(found.trans).sum(-1), 1, atol=1e-9)
    np.testing.assert_array_equal(found.trans[2], model().trans)
    assert not np.allclose(found.trans[0], found.trans[1]) and found.pi[2] < found.pi[0]
    mean = 1 + found.r * (1 - found.p) / found.p
    np.testing.assert_allclose(mean[2], 1 + 2 * 0.6 / 0.4, rtol=0.05)


def test_nested_split_and_recipes(spark):
    split = spark.createDataFrame([(str(t), "train" if t < 20 else "test") for t in range(25)], "trial_id string, part string")
    rows = annotations.nested_split(split, 0.3, 5).collect()
    assert sorted(int(r["trial_id"]) for r in rows) == list(range(20)) and sum(r["part"] == "test" for r in rows) == 6
    trials = split.select("trial_id", F.when(F.col("trial_id") < "15", "tea").otherwise("milk").alias("recipe"))
    assert {r["trial_id"] for r in annotations.of_recipes(split, trials, ["milk"]).collect()} == {r["trial_id"] for r in trials.collect() if r["recipe"] == "milk"}


def test_narrated_drift(spark):
    drift = spark.createDataFrame([(0, 9.0, 5.0, 4.0, 0.01, True), (1, 2.0, 9.0, -7.0, 0.002, True), (2, 1.0, 1.0, 0.0, 0.9, False)], "state int, mean_recent double, mean_frozen double, delta double, p double, reportable boolean")
    names = spark.createDataFrame([(k, f"s{k}") for k in range(3)], "state int, name string")
    assert [tuple(r) for r in lifecycle.narrated_drift(drift, names).orderBy("rank").collect()] == [
        (1, 1, "'s1' goes faster this week: about 2 ticks, usually 9 (p = 0.002)."),
        (0, 2, "'s0' goes slower this week: about 9 ticks, usually 5 (p = 0.010)."),
    ]
