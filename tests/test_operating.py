"""Operating points against a sweep of alphas, running sums against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from seqwatch.operators import channels, operating
from seqwatch.operators import surprise as S
from seqwatch.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def test_points_equal_a_sweep_of_alphas(spark):
    points = {}
    for r in catalogue.QUERIES["operating_points"](spark, SMALL).collect():
        points.setdefault((r["level"], r["channel"], r["part"]), []).append((r["alpha"], r["tp"], r["fp"], r["fn"], r["tn"]))
    assert all(min(rows)[:3] == (0.0, 0, 0) for rows in points.values())
    for r in catalogue.QUERIES["channel_sweep"](spark, SMALL).collect():
        upto = r["alpha"] + (-1e-9 if r["channel"] in channels.DURATION_CHANNELS else 1e-9)  # durations are flagged above their alpha only
        last = [max(x for x in points["trial_loc", r["channel"], part] if x[0] <= upto) for part in ("train", "test")]
        assert tuple(sum(x[k] for x in last) for k in range(1, 5)) == (r["tp"], r["fp"], r["fn"], r["tn"]), r


def test_points_of_steps_equal_those_of_scores(spark, monkeypatch):
    """The query against the points of all scores of all ticks as rows; it makes no such rows itself."""
    d = "/root/testdata/sf0.001"
    w = catalogue.degraded(spark, d)
    t = catalogue.channel_tables(w)
    key = F.concat_ws("/", F.col("trial_id").cast("string"), "error_type")
    tails = operating.tail_masses(t)
    bad = operating.least_alphas(channels.scores(w.rows, catalogue.recipe_steps(w), catalogue.DEGRADED, t), tails).select(key.alias("key"), "tick", "channel", "alpha")
    good = operating.least_alphas(channels.scores(w.ticks, catalogue.healthy_steps(w), catalogue.HEALTHY, t), tails).select(F.col("trial_id").cast("string").alias("key"), "tick", "channel", "alpha")
    ticks = catalogue.true_ticks(w)
    parts = ticks.select("key").distinct().withColumn("part", F.when(F.split_part("key", F.lit("/"), F.lit(1)).cast("long") % 5 == 0, "test").otherwise("train"))
    expected = operating.operating_points(ticks, bad.unionByName(good), parts).collect()
    monkeypatch.setattr(channels, "scores", None)
    found = catalogue.QUERIES["operating_points"](spark, d)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected)) and found.columns == list(expected[0].asDict()) and len(expected) > 100
    assert catalogue.QUERIES["tuned_points"](spark, d).count() == 16


def test_running_sums_equal_a_loop(spark):
    draw = random.Random(1)
    rows = [(k, x, draw.randint(0, 9), draw.randint(-3, 3)) for k in ("a", "b", "hot") for x in draw.sample(range(10_000), 2000 if k == "hot" else 7)]
    df = spark.createDataFrame(rows, "k string, x int, u long, v long").repartition(5)
    found = {(r["k"], r["x"]): (r["u"], r["v"]) for r in operating.running_sums(df, ["k"], "x", ["u", "v"]).collect()}
    for k in ("a", "b", "hot"):
        u = v = 0
        for _, x, du, dv in sorted(r for r in rows if r[0] == k):
            u, v = u + du, v + dv
            assert found[k, x] == (u, v)


def test_pooled_threshold_is_the_exact_tail(spark):
    values = [1.0, 1.0, 2.0, 3.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for alpha in (0.05, 0.1, 0.25, 0.5, 0.9):
        expected = next(t for t in sorted(set(values)) if sum(v > t for v in values) <= alpha * len(values) + 1e-9)
        assert S.pooled_threshold(df, "x", alpha) == pytest.approx(expected)
    assert S.pooled_threshold(df.limit(0), "x", 0.1) is None


def test_least_alphas_of_steps_are_those_of_their_scores(spark):
    """Steps with the least alpha of each channel against the flags of all scores, tick by tick; no score may be a row."""
    w = catalogue.degraded(spark, SMALL)
    t = catalogue.channel_tables(w)
    cells = catalogue.written_cells(t, catalogue.SWEPT)
    for steps, flags, keys in (
        (catalogue.degraded_least(w, t, cells), catalogue.degraded_channel_flags(w, t, catalogue.SWEPT), catalogue.DEGRADED),
        (catalogue.healthy_least(w, t, cells), catalogue.healthy_channel_flags(w, t, catalogue.SWEPT), catalogue.HEALTHY),
    ):
        expected = {}
        by_tick = {}
        for r in flags.collect():
            at = (*(r[k] for k in keys), r["tick"])
            by_tick.setdefault(at, {}).setdefault(r["channel"], []).append(r["alpha"])
        found = steps.collect()
        for r in found:
            own = expected.setdefault((*(r[k] for k in keys), r["seg_idx"]), {})
            for tick in range(r["tick_start"], r["tick_end"]):
                for c, alphas in by_tick.pop((*(r[k] for k in keys), tick), {}).items():
                    own[c] = min([own.get(c, 9.0), *alphas])
        assert not by_tick and len(expected) == len(found) > 100
        for r in found:
            assert {c: r[c] for c in channels.CHANNELS if r[c] is not None} == expected[(*(r[k] for k in keys), r["seg_idx"])]


def test_coordinate_sweep_of_no_trials_and_of_one(spark):
    names = [f"{side}_{c}" for side in ("hit", "stray") for c in ("x", "y")]
    schema = "is_error boolean, " + ", ".join(f"{n} double" for n in names)
    assert channels.coordinate_sweep(spark.createDataFrame([], schema), ["x", "y"], [0.1, 0.2], 0.1, 1) == [("x", 0.1, 0.0), ("y", 0.1, 0.0)]
    rows = [(True, 0.2, None, None, None), (False, None, None, None, 0.2)]
    assert channels.coordinate_sweep(spark.createDataFrame(rows, schema), ["x", "y"], [0.1, 0.2], 0.1, 1) == [("x", 0.2, 1.0), ("y", 0.1, 1.0)]
