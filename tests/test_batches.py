"""Recursions on many sequences at once, and how trials are dealt to them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwatch.functions import kernels
from seqwatch.functions.special import duration_tables
from seqwatch.operators import explore, narrate, operating
from seqwatch.plans import decode


def test_many_sequences_at_once_equal_one_at_a_time():
    draw = np.random.default_rng(5)
    k, d_max, letters = 4, 6, 5
    rows = lambda *shape: np.log(draw.dirichlet(np.ones(shape[-1]), shape[:-1]))
    trans = draw.dirichlet(np.ones(k), k) * (1 - np.eye(k))
    with np.errstate(divide="ignore"):
        trans = np.log(trans / trans.sum(1, keepdims=True))
    init, emit, (pmf, survival) = rows(1, k)[0], rows(k, letters), duration_tables(draw.uniform(1, 3, k), draw.uniform(0.3, 0.7, k), d_max)
    sequences = [draw.integers(0, letters, n) for n in (1, 9, 2, 30, 30, 6, 1, 17)]
    cells, kernels.BATCH_CELLS = kernels.BATCH_CELLS, 40 * k
    try:
        parts = list(kernels.columns(sequences, states=k))
    finally:
        kernels.BATCH_CELLS = cells
    assert len(parts) > 2 and sorted(b for some, *_ in parts for b in some) == list(range(len(sequences)))
    for some, symbols, n in parts:
        look = np.ascontiguousarray(emit[:, symbols].swapaxes(0, 1))
        model = (init, trans, pmf, survival)
        beliefs, _, _, totals = kernels.forward_all(look, n, *model)
        stats = kernels.expectations_all(look, n, *model)
        counts, states, durations, best = kernels.viterbi_all(look, n, *model)
        gamma, xi, log_z = kernels.hmm_expectations_all(symbols, n, init, rows(k, k), emit)
        for j, b in enumerate(some):
            t = (emit[:, sequences[b]].T, *model)
            one, of, upto = kernels.expectations(*t), kernels.forward(*t), counts[:j].sum()
            np.testing.assert_allclose(beliefs[: n[j], :, j], of[0])
            assert totals[j] == pytest.approx(of[3]) == kernels.likelihoods(look, n, *model)[j] and stats[4][j] == pytest.approx(one[4])
            for whole, own in zip((*(x[..., j] for x in stats[:3]), stats[3][: n[j], :, j]), one):
                np.testing.assert_allclose(whole, own, atol=1e-12)
            path = list(zip(states[upto : upto + counts[j]].tolist(), durations[upto : upto + counts[j]].tolist()))
            assert (path, best[j]) == kernels.viterbi(*t) and sum(d for _, d in path) == n[j]
            np.testing.assert_allclose(gamma[: n[j], :, j].sum(1), 1.0)
            assert not gamma[n[j] :, :, j].any() and xi[..., j].sum() == pytest.approx(n[j] - 1) and np.isfinite(log_z[j])


def test_packed_trials_keep_their_partitions(spark):
    """Recursions cost more than their few bytes tell: packed trials aren't merged into one task."""
    ticks = spark.range(200).selectExpr("id % 40 as trial_id", "cast(id / 40 as int) as tick", "0 as verb_id", "0 as noun_id")
    n = decode.packed_trials(ticks).select(F.spark_partition_id().alias("p")).distinct().count()
    assert n == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_joins_of_sequences_are_not_broadcast(spark, monkeypatch):
    """Tables of all ticks and flags look small by their files; gathered on the driver they are not."""
    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return df

    monkeypatch.setattr(operating, "written", kept)
    ticks = spark.createDataFrame([("1", t, t // 2, False, False) for t in range(6)] + [("1/omission", t, t // 2, True, t > 3) for t in range(6)], "key string, tick int, seg_idx int, is_error boolean, is_positive boolean")
    alphas = spark.createDataFrame([("1", 0, "s_verb", 0.1), ("1/omission", 4, "s_verb", 0.05)], "key string, tick int, channel string, alpha double")
    parts = spark.createDataFrame([("1", "train"), ("1/omission", "train")], "key string, part string")
    rows = operating.operating_points(ticks, alphas, parts).filter("level = 'trial_loc' and channel = 's_verb'").orderBy("alpha").collect()
    assert [(r["alpha"], r["tp"], r["fp"]) for r in rows] == [(0.0, 0, 0), (0.05, 1, 0), (0.1, 1, 1)]
    assert all("BroadcastHashJoin" not in plans[name] and "SortMergeJoin" in plans[name] for name in ("parted", "heard"))


def test_questions_join_segments_by_sorting(spark):
    flags = spark.createDataFrame([(1, 3, 0, "s_temporal", 2.0, 1.0)], "trial_id long, tick int, seg_idx int, channel string, value double, threshold double")
    names, means = spark.createDataFrame([(0, "walk")], "state int, name string"), spark.createDataFrame([(0, 2.0)], "state int, mean_duration double")
    rows = narrate.stall_questions(flags, names, means, spark.createDataFrame([(1, 0, 0, 1)], "trial_id long, seg_idx int, state int, tick_start int"))
    assert "SortMergeJoin" in rows._jdf.queryExecution().executedPlan().toString()
    assert [r["text"] for r in rows.collect()] == ["Still at 'walk' after 3 ticks? Usually it takes about 2."]


def test_edit_distances_are_dealt_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(explore, "TRIALS_OF_BLOCK", 3)
    draw = np.random.default_rng(2)
    rows = [(t, t % 2, k, int(s)) for t in range(21) for k, s in enumerate(draw.integers(0, 3, draw.integers(1, 6)))]
    found = explore.edit_distances(spark.createDataFrame(rows, "trial_id long, recipe int, seg_idx int, state int"))
    told = {(r["recipe"], r["a"], r["b"]): r["distance"] for r in found.collect()}
    words = {t: [s for u, _, _, s in rows if u == t] for t in range(21)}

    def distance(x, y):
        line = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            line = [i] + [0] * len(y) if (last := line) else line
            for j, q in enumerate(y, 1):
                line[j] = min(last[j] + 1, line[j - 1] + 1, last[j - 1] + (p != q))
        return line[-1]

    assert found.count() == len(told) and told == {(a % 2, a, b): distance(words[a], words[b]) for a in words for b in words if a < b and a % 2 == b % 2}


def test_edit_matrix_equals_a_loop():
    draw = np.random.default_rng(4)
    sequences = [[draw.integers(0, 3 + side, n) for n in lengths] for side, lengths in enumerate(((0, 1, 63, 64, 65, 127, 128, 129, 200), (0, 3, 64, 65, 30, 150)))]
    sequences[1].append(sequences[0][-1])

    def distance(x, y):
        line = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            last, line = line, [i] + [0] * len(y)
            for j, q in enumerate(y, 1):
                line[j] = min(last[j] + 1, line[j - 1] + 1, last[j - 1] + (p != q))
        return line[-1]

    expected = [[distance(x, y) for y in sequences[0]] for x in sequences[1]]
    sizes = kernels.PAIR_CELLS, kernels.PLACE_CELLS
    try:
        for kernels.PAIR_CELLS, kernels.PLACE_CELLS in (sizes, (1, 1), (20, 30)):
            assert kernels.edit_matrix(*kernels.stacked(sequences[1]), *kernels.stacked(sequences[0])).tolist() == expected
    finally:
        kernels.PAIR_CELLS, kernels.PLACE_CELLS = sizes


def test_edit_distances_are_told_by_blocks_at_once(spark):
    """A pair of trials is no row before its distance is known: rows that are shuffled hold blocks of trials."""
    rows = spark.range(1200).selectExpr("id as trial_id", "0 as recipe", "0 as seg_idx", "cast(id % 7 as int) as state")
    found = explore.edit_distances(rows)
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert "levenshtein" not in plan and "join" not in plan
    told = found.groupBy("distance").count().collect()
    assert {r["distance"]: r["count"] for r in told} == {0: sum(n * (n - 1) // 2 for n in (172, 172, 172, 171, 171, 171, 171)), 1: 1200 * 1199 // 2 - sum(n * (n - 1) // 2 for n in (172, 172, 172, 171, 171, 171, 171))}
