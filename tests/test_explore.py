"""Order clusters and ingredient tests against plain loops."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwatch.operators import explore


def linked(d, clusters):
    """Average linkage by its definition: means over all pairs of elements, recomputed for each merge."""
    groups, merges = [[i] for i in range(len(d))], []
    while len(groups) > clusters:
        mean = lambda x, y: np.mean([d[i, j] for i in x for j in y])
        _, a, b = min((round(mean(x, y), 9), min(x), min(y)) for x, y in itertools.combinations(sorted(groups), 2))
        x, y = (next(g for g in groups if min(g) == k) for k in (a, b))
        merges.append((a, b, mean(x, y)))
        groups = [g for g in groups if g is not x and g is not y] + [x + y]
    return sorted(map(sorted, groups)), merges


@pytest.mark.parametrize("seed", range(8))
def test_average_linkage_equals_its_definition(seed):
    draw = np.random.default_rng(seed)
    n = int(draw.integers(3, 14))
    d = draw.random((n, n)) if seed % 2 else draw.integers(1, 5, (n, n)).astype(float)
    d = np.triu(d, 1) + np.triu(d, 1).T
    member, merges = explore.average_linkage(d, 2)
    groups, expected = linked(d, 2)
    if seed % 2:  # free of ties
        assert [m[:2] for m in merges] == [m[:2] for m in expected] and [m[2] for m in merges] == pytest.approx([m[2] for m in expected])
        assert sorted(sorted(np.flatnonzero(member == c).tolist()) for c in set(member)) == groups
    assert len(set(member)) == 2 and member[0] == 0


@pytest.mark.parametrize("seed", range(6))
def test_linkage_of_ties_in_files_equals_its_definition(seed, monkeypatch):
    monkeypatch.setattr(explore, "MOST_IN_MEMORY", 0)
    draw = np.random.default_rng(seed)
    n, clusters = int(draw.integers(2, 30)), int(draw.integers(1, 4))
    d = np.triu(draw.integers(0, 5, (n, n)), 1).astype((np.uint8, np.int32)[seed % 2])
    d[:, : n // 3] = 0  # some equal each other
    d = np.triu(d, 1) + np.triu(d, 1).T
    member, merges = explore.average_linkage(d, clusters)
    groups, expected = linked(d, clusters)
    assert [m[:2] for m in merges] == [m[:2] for m in expected] and [m[2] for m in merges] == pytest.approx([m[2] for m in expected])
    assert sorted(sorted(np.flatnonzero(member == c).tolist()) for c in set(member)) == groups


def steps_of(spark, orders):
    rows = [(r, t, k, s) for t, (r, states) in orders.items() for k, s in enumerate(states)]
    return spark.createDataFrame(rows, "recipe int, trial_id long, seg_idx int, state int")


def test_two_orders_part_and_one_doesnt(spark):
    draw = np.random.default_rng(1)

    def noisy(base):
        out = list(base)
        out[draw.integers(0, len(out))] = int(draw.integers(300, 310))
        return out

    orders = {t: (0, noisy(range(8) if t % 2 else range(8)[::-1])) for t in range(12)}
    orders |= {100 + t: (1, draw.permutation(8).tolist()) for t in range(12)}
    orders |= {200 + t: (2, [1, 2, 3]) for t in range(4)}
    found = {r["recipe"]: r for r in explore.order_structure(steps_of(spark, orders), draws=60).collect()}
    assert set(found) == {0, 1}
    assert found[0]["looser"] == 1 and found[0]["least"] == 6 and found[0]["observed"] < found[0]["null_mean"]
    gap = {k: (r["null_mean"] - r["observed"]) / r["null_mean"] for k, r in found.items()}
    assert gap[0] > 2 * gap[1]  # the best split of unordered trials is a little tighter, too
    members = explore.order_clusters(explore.edit_distances(steps_of(spark, orders)))
    sides = {r["trial_id"]: r["cluster"] for r in members.filter("recipe = 0").collect()}
    assert len({(t % 2, c) for t, c in sides.items()}) == 2


@pytest.mark.parametrize("longest, clusters", [(9, 2), (300, 3)])
def test_order_structure_by_blocks_equals_that_of_pairs(spark, monkeypatch, longest, clusters):
    """Blocks of trials instead of pairs: the same clusters and means, and no pair of trials is a row."""
    draw = np.random.default_rng(3)
    orders = {7 * t: (t % 2, draw.integers(0, 4, 1 + t % 9 if t else longest).tolist()) for t in range(27)} | {1000: (2, [1]), 1001: (2, [2])}
    steps = steps_of(spark, orders)
    pairs = explore.edit_distances(steps).persist()
    members = explore.order_clusters(pairs, clusters=clusters).persist()
    observed = {r["recipe"]: r["within"] for r in explore.within_distance(members, pairs, ["recipe"]).collect()}
    null = {}
    for r in explore.within_distance(explore.permuted(members, 20, 0), pairs, ["recipe", "draw"]).collect():
        null.setdefault(r["recipe"], []).append(r["within"])
    monkeypatch.setattr(explore, "TRIALS_OF_BLOCK", 4)
    monkeypatch.setattr(explore, "edit_distances", None)
    found = {r["recipe"]: r for r in explore.order_structure(steps, clusters=clusters, draws=20).collect()}
    assert set(found) == set(observed) == set(null) == {0, 1}
    for k, r in found.items():
        sizes = [x["count"] for x in members.filter(F.col("recipe") == k).groupBy("cluster").count().collect()]
        assert (r["trials"], r["least"]) == (sum(sizes), min(sizes)) and r["observed"] == pytest.approx(observed[k])
        assert r["null_mean"] == pytest.approx(np.mean(null[k])) and r["null_sd"] == pytest.approx(np.std(null[k]), abs=1e-9)
        assert r["looser"] == pytest.approx(np.mean([round(x, 9) > round(observed[k], 9) for x in null[k]]))


def test_permutations_keep_sizes_and_are_even(spark):
    members = spark.createDataFrame([(0, t, int(t >= 3)) for t in range(8)], "recipe int, trial_id long, cluster int")
    rows = explore.permuted(members, 400, 7).collect()
    by = {}
    for r in rows:
        by.setdefault(r["draw"], {})[r["trial_id"]] = r["cluster"]
    assert len(by) == 400 and all(sorted(x.values()) == [0] * 3 + [1] * 5 for x in by.values())
    for t in range(8):
        assert abs(np.mean([x[t] == 0 for x in by.values()]) - 3 / 8) < 0.1
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, explore.permuted(members, 400, 7).collect()))


def test_p_is_even_where_there_is_no_order(spark):
    """Random splits of structureless trials are looser than a random split half of the time."""
    draw = np.random.default_rng(5)
    d = draw.random((9, 9))
    pairs = spark.createDataFrame([(0, i, j, float(d[i, j])) for i, j in itertools.combinations(range(9), 2)], "recipe int, a long, b long, distance double")
    members = spark.createDataFrame([(0, t, int(t >= 4)) for t in range(9)], "recipe int, trial_id long, cluster int")
    null = [r["within"] for r in explore.within_distance(explore.permuted(members, 300, 1), pairs, ["recipe", "draw"]).collect()]
    every = []
    for side in itertools.combinations(range(9), 4):
        other = [t for t in range(9) if t not in side]
        every.append(np.mean([np.mean([d[i, j] for i, j in itertools.combinations(sorted(g), 2)]) for g in (side, other)]))
    assert np.mean(null) == pytest.approx(np.mean(every), abs=0.02) and {round(x, 9) for x in null} <= {round(x, 9) for x in every}


def test_binomial_p_equals_enumeration(spark):
    cases = [(k, n, rate) for n in (1, 2, 7, 30, 400) for rate in (0.001, 0.2, 0.5, 0.93) for k in {0, 1, n // 3, n - 1, n}]
    df = spark.createDataFrame(cases, "k int, n int, rate double")
    for r in df.withColumn("p", explore.binomial_p(F.col("k"), F.col("n"), F.col("rate"))).collect():
        log = [math.lgamma(r["n"] + 1) - math.lgamma(i + 1) - math.lgamma(r["n"] - i + 1) + i * math.log(r["rate"]) + (r["n"] - i) * math.log(1 - r["rate"]) for i in range(r["n"] + 1)]
        assert r["p"] == pytest.approx(min(1.0, sum(math.exp(x) for x in log if x <= log[r["k"]] + 1e-7)), rel=1e-6)


def test_ingredients(spark):
    rows = [(p, t, i) for p in range(6) for t in range(10) for i in ("salt", "milk") if i == "milk" or (p == 0) != (t % 5 == 0)]
    rows += [(9, 0, "milk"), (9, 1, None)] + [(0, 0, "milk")] * 3
    found = {(r["participant"], r["item"]): r for r in explore.ingredient_tests(spark.createDataFrame(rows, "participant int, trial int, item string")).collect()}
    assert {p for p, _ in found} == set(range(6)) and {i for _, i in found} == {"salt", "milk"}
    salt = found[0, "salt"]
    assert (salt["k"], salt["n"]) == (8, 10) and salt["rejected"] and salt["rate"] == pytest.approx((8 + 5 * 2) / 62)
    assert not any(r["rejected"] for (p, _), r in found.items() if p != 0)
