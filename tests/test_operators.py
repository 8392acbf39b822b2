"""Operators on small fixed tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwatch.functions import runs as R
from seqwatch.operators import counts, evaluate, explore, inject, lifecycle, replies, sequence
from seqwatch.operators import surprise as S
from seqwatch.sources import annotations


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def files(spark):
    lines = "1-30 SIL\n31-150 take_bowl\n151-428 pour_cereals\n429-560 pour_milk\nnonsense\n561-575 stir_cereals\n576-590 SIL"
    return spark.createDataFrame(
        [("/d/P03_cam01_P03_cereals.txt", lines), ("/d/P03_stereo01_P03_cereals.txt", lines + " "), ("/d/P04_webcam02_P04_milk.txt", "1-9 SIL"), ("/d/readme.txt", "")], "path string, content string"
    )


def test_annotations(spark, files):
    views = annotations.named_views(files)
    assert rows(annotations.canonical_views(views).select("trial_id", "camera"), "trial_id") == [("P03_cereals", "cam01"), ("P04_milk", "webcam02")]
    assert rows(annotations.view_disagreements(views), "trial_id") == [("P03_cereals", 2)]
    seg = annotations.segments(annotations.canonical_views(views)).filter("trial_id = 'P03_cereals'")
    assert rows(seg.select("seg_idx", "verb", "noun", "end_frame"), "seg_idx")[:3] == [(0, "stall", "kitchen", 30), (1, "take", "bowl", 150), (2, "pour", "cereals", 428)]
    pairs = dict(rows(R.expand_to_ticks(seg.withColumn("pair", F.concat_ws(",", "verb", "noun")), "pair", 15.0).select("tick", "pair"), "tick"))
    assert (pairs[0], pairs[2], pairs[28], pairs[29]) == ("stall,kitchen", "take,bowl", "pour,cereals", "pour,milk") and len(pairs) == 40


def test_unknown_camera_and_bad_label_fail(spark):
    bad = spark.createDataFrame([("/d/P03_cam99_P03_tea.txt", "1-9 SIL")], "path string, content string")
    with pytest.raises(Exception, match="no known camera"):
        annotations.canonical_views(annotations.named_views(bad)).collect()
    label = spark.createDataFrame([("x", "r", "1-9 nolabel")], "trial_id string, recipe string, content string")
    with pytest.raises(Exception, match="without underscore"):
        annotations.segments(label).collect()


def test_short_last_segment(spark):
    seg = spark.createDataFrame([("t", 0, 1, 20), ("t", 1, 21, 22)], "trial_id string, v int, start_frame int, end_frame int")
    assert rows(R.expand_to_ticks(seg, "v", 15.0), "tick") == [("t", 0, 0), ("t", 1, 0)]


def test_trim(spark):
    cases = {"a": [(1, 1), (2, 2), (11, 18), (3, 3), (11, 18), (11, 18)], "b": [(11, 18)] * 3, "c": [(1, 1), (11, 5)]}
    data = [(k, i, v, n) for k, x in cases.items() for i, (v, n) in enumerate(x)]
    ticks = spark.createDataFrame(data, "trial_id string, tick int, verb_id int, noun_id int")
    found = R.trim_idle(ticks, (F.col("verb_id") == 11) & (F.col("noun_id") == 18)).groupBy("trial_id").agg(F.count("*"), F.max("n_trimmed"))
    assert rows(found, "trial_id") == [("a", 4, 2), ("c", 2, 0)]


def test_runs_and_absorption(spark):
    ticks = spark.createDataFrame([("t", i, v) for i, v in enumerate([0] * 10 + [7] + [0] * 10 + [3])], "trial_id string, tick int, v int")
    assert [r[1:5] for r in rows(R.runs(ticks, ["v"]), "seg_idx")] == [(0, 0, 0, 10), (1, 7, 10, 11), (2, 0, 11, 21), (3, 3, 21, 22)]
    kept = spark.createDataFrame([(0,), (3,)], "v int")
    assert [r[2:5] for r in rows(R.runs(R.absorb(ticks, "v", kept), ["v"]), "seg_idx")] == [(0, 0, 21), (3, 21, 22)]


def brute_threshold(scores, masses, alpha):
    """The support's score with the most mass strictly above it that stays within alpha."""
    fits = [t for t, m in zip(scores, masses) if m > 0 and sum(b for a, b in zip(scores, masses) if a > t) <= alpha + 1e-12]
    return min(fits)


def test_tail_thresholds(spark):
    draw = np.random.default_rng(0)
    cases = [([0.5, 0.3, 0.15, 0.05], 0.1), ([0.5] + [0.1] * 5, 0.25), ([1 / 8] * 8, 0.05)] + [(draw.dirichlet(np.ones(7)).tolist(), a) for a in (0.01, 0.2, 0.6)]
    for p, alpha in cases:
        scores = [round(-float(np.log(x)), 9) for x in p]
        df = spark.createDataFrame([(0, s, x) for s, x in zip(scores, p)], "k int, score double, mass double")
        assert S.tail_threshold(df, ["k"], "score", "mass", alpha).first()["threshold"] == pytest.approx(brute_threshold(scores, p, alpha))


def test_severity_and_attribution(spark):
    df = spark.createDataFrame([(1.4, 1.0), (2.0, 1.0), (3.0, 1.0), (1.0, -1.0), (1.0, 0.0)], "v double, t double")
    assert [r[0] for r in df.select(S.severity(F.col("v"), F.col("t"))).collect()] == ["low", "medium", "high", "high", "high"]
    df = spark.createDataFrame([(1.0, 3.1), (3.1, 1.0), (1.0, 3.0)], "v double, n double")
    assert [r[0] for r in df.select(S.attribution(F.col("v"), F.col("n"))).collect()] == ["item", "action", "none"]


def chain(spark, states):
    at, out = 0, []
    for i, (s, d) in enumerate(states):
        out.append((1, i, s, at, at + d, d, i == len(states) - 1))
        at += d
    return spark.createDataFrame(out, "trial_id long, seg_idx int, state int, tick_start int, tick_end int, duration int, is_last boolean")


def chain_logp(spark, flat, step, k=5):
    cells = [(a, b, step if b == a + 1 else flat) for a, b in itertools.permutations(range(k), 2)]
    return spark.createDataFrame(cells, "from_state int, to_state int, logp double")


def test_swapped_segments(spark):
    expected = spark.createDataFrame([(k, 5.0) for k in range(5)], "state int, mean_duration double")
    found = sequence.verdicts(chain(spark, [(0, 5), (1, 5), (3, 5), (2, 5), (4, 5)]), chain_logp(spark, -1.897, -0.916), expected, 1.5, 1.8)
    assert [(r["seg_idx"], r["error_type"]) for r in found.collect()] == [(2, "transposition")]


def test_skipped_and_repeated_segments(spark):
    expected = spark.createDataFrame([(k, 5.0) for k in range(5)], "state int, mean_duration double")
    found = sequence.verdicts(chain(spark, [(0, 5), (1, 11), (3, 5), (4, 5)]), chain_logp(spark, -5.298, -0.0513), expected, 1.5, 1.8)
    assert sorted((r["seg_idx"], r["error_type"], r["bridge"]) for r in found.collect()) == [(1, "omission", 2), (1, "repetition", None)]


def test_bridge(spark):
    table = {(a, b): np.log(0.01) for a, b in itertools.permutations(range(4), 2)} | {(0, 1): np.log(0.9), (1, 2): np.log(0.9)}
    lp = lambda t: spark.createDataFrame([(a, b, float(v)) for (a, b), v in t.items()], "from_state int, to_state int, logp double")
    best = sequence.bridges(lp(table)).filter("from_state = 0 and to_state = 2").first()
    assert best["bridge"] == 1 and best["gain"] > 2
    assert sequence.bridges(lp(table | {(0, 2): np.log(0.5)})).filter("from_state = 0 and to_state = 2").first()["gain"] < 2


def trial(spark):
    segs = [(0, 3), (1, 4), (2, 5), (3, 2), (0, 3)]
    ticks, t = [], 0
    for s, d in segs:
        for _ in range(d):
            ticks.append((8, t, s, (s * 2 + t) % 4))
            t += 1
    df = spark.createDataFrame(ticks, "trial_id long, tick int, verb_id int, noun_id int")
    return df, R.runs(df.withColumn("state", F.col("verb_id")), ["state"]), ticks


@pytest.mark.parametrize("kind", inject.ERROR_TYPES)
def test_injection_provenance(spark, kind):
    ticks, segs, healthy = trial(spark)
    found, windows = inject.inject(ticks, segs, kind, 4)
    source = {t: (v, n) for _, t, v, n in healthy}
    got = rows(found, "tick")
    assert [r[2] for r in got] == list(range(len(got)))
    for _, _, _, v, n, src, edited in got:
        assert edited or (v, n) == source[src]
    w = windows.first()
    t0, t1 = w["t0"], w["t1"]
    order = [r[5] for r in got]
    if kind == "substitution":
        assert order == list(range(17)) and {r[2] for r in got if r[6]} == set(range(t0, t1 + 1))
    if kind == "omission":
        assert len(order) < 17 and order == sorted(order) and t0 == t1
    if kind == "abandonment":
        assert order == sorted(order) and order[t0 + 1] > order[t0] + 1
    if kind == "transposition":
        assert sorted(order) == list(range(17)) and order != sorted(order)
    if kind == "repetition":
        assert len(order) > 17 and set(order) == set(range(17))


def test_unknown_error_type(spark):
    ticks, segs, _ = trial(spark)
    with pytest.raises(ValueError):
        inject.inject(ticks, segs, "other", 4)


def test_outcomes(spark):
    windows = spark.createDataFrame([(k, "x", 10, 10) for k in range(3)], "trial_id long, error_type string, t0 int, t1 int")
    flags = spark.createDataFrame([(0, "x", 12, True), (1, "x", 30, True), (2, "x", 3, False)], "trial_id long, error_type string, tick int, flagged boolean")
    found = evaluate.tick_outcomes(windows, flags)
    assert [tuple(r)[4:] for r in found.orderBy("trial_id").collect()] == [(1, 2, 0), (0, None, 1), (0, None, 0)]
    healthy = spark.createDataFrame([(9, 3, True)], "trial_id long, tick int, flagged boolean")
    r = evaluate.tick_report(found, healthy).first()
    assert (r["recall"], r["precision"], r["precision_excl_healthy"]) == (pytest.approx(1 / 3), pytest.approx(1 / 3), 0.5)


def test_confirmations(spark):
    model = spark.createDataFrame([(1, 2, 200.0, 200.0), (1, 3, 4.0, 4.0)], "state int, token int, frozen double, live double")
    told = spark.createDataFrame([(1, 2, "preference")] * 10 + [(1, 3, "breakdown")], "state int, token int, outcome string")
    live = lifecycle.confirmed(model, told, 2.0, 5.0)
    assert rows(live, "token") == [(1, 2, 200.0, 205.0), (1, 3, 4.0, 4.0)]
    assert rows(lifecycle.consolidated(live), "token")[0] == (1, 2, 205.0, 205.0)
    assert rows(lifecycle.consolidated(live, live.filter("token = 3")), "token")[0] == (1, 2, 200.0, 200.0)
    with pytest.raises(Exception, match="unknown outcome"):
        lifecycle.confirmed(model, told.withColumn("outcome", F.lit("other"))).collect()


def test_drift(spark):
    assert lifecycle.rank_sum_p([8, 9, 10], [4, 5, 6]) == pytest.approx(0.05)
    table = lambda xs: spark.createDataFrame([(0, d, False) for d in xs] + [(1, 1, True)], "state int, duration int, is_last boolean")
    few = lifecycle.duration_drift(table([8, 9, 10]), table([4, 5, 6]), least_n=3).filter("state = 0").first()
    assert few["p"] == pytest.approx(0.05) and not few["reportable"]
    many = lifecycle.duration_drift(table([8, 9, 10] * 4), table([4, 5, 6] * 4), least_n=3).first()
    assert many["reportable"] and many["delta"] == 4


def test_rank_sum_equals_enumeration():
    x, y = [3.0, 8.0, 11.0, 2.5], [1.0, 2.0, 9.0, 4.0, 7.0]
    u = lambda a, b: sum(p > q for p in a for q in b)
    pool = x + y
    splits = [(c, [v for v in pool if v not in c]) for c in itertools.combinations(pool, 4)]
    assert lifecycle.rank_sum_p(x, y) == pytest.approx(sum(u(a, b) >= u(x, y) for a, b in splits) / len(splits))


def test_replies(spark):
    texts = [
        "No Anomaly", "Substitution Anomaly. Correct move would have been pour milk for 12 seconds", "Omission Anomaly", "I believe it is a repetition here, stir dough for 3 seconds", "Substitution Anomaly. Correct move would have been fly milk for 2 seconds",
        "Teleport Anomaly", "", None, "No anomaly? Substitution anomaly, rather.", "no anomaly here", " No anomaly!\nfine", "Substitution Anomaly. Correct move would have been stir_dough for 4 seconds",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, reply string")
    token = lambda xs: spark.createDataFrame([(x,) for x in xs], "token string")
    found = replies.parsed_replies(df, token(["pour", "stir"]), token(["milk", "dough"])).orderBy("i").drop("i", "reply")
    assert [tuple(r) for r in found.collect()] == [
        (False, None, None, None, None, True), (True, "substitution", "pour", "milk", 12, True), (True, "omission", None, None, None, True), (True, "repetition", "stir", "dough", 3, False), (True, "substitution", None, None, None, True),
        (False, None, None, None, None, False), (False, None, None, None, None, False), (False, None, None, None, None, False),
        (True, "substitution", None, None, None, False), (False, None, None, None, None, False), (False, None, None, None, None, True), (True, "substitution", "stir", "dough", 4, True),
    ]


def test_ari_and_clusters(spark):
    def ari(a, b):
        return counts.adjusted_rand(spark.createDataFrame(list(zip(a, b)), "a int, b int"), "a", "b").first()[0]

    assert ari([0, 0, 1, 1, 2, 2], [5, 5, 3, 3, 4, 4]) == pytest.approx(1)
    assert ari([0] * 6, [0] * 6) == 1
    assert ari([0, 0, 0, 1, 1, 1, 2, 2, 2], [0, 1, 2, 0, 1, 2, 0, 1, 2]) == pytest.approx(-1 / 3)  # (0 - 81 / 36) / (9 - 81 / 36)


def test_edit_distance_and_fdr(spark):
    steps = spark.createDataFrame([(1, 0, i, s) for i, s in enumerate([0, 1, 2, 3])] + [(2, 0, i, s) for i, s in enumerate([0, 2, 3])], "trial_id long, recipe int, seg_idx int, state int")
    assert explore.edit_distances(steps).first()["distance"] == 1
    far = spark.createDataFrame([(t, 0, i, s) for t, xs in enumerate([[5, 300, 7], [261, 300, 7], [5, 44, 7, 55_039]]) for i, s in enumerate(xs)], "trial_id long, recipe int, seg_idx int, state int")
    assert {(r["a"], r["b"]): r["distance"] for r in explore.edit_distances(far).collect()} == {(0, 1): 1, (0, 2): 2, (1, 2): 3}
    tests = spark.createDataFrame([(0, 0.01), (1, 0.02), (2, 0.2), (3, 0.9)], "id int, p double")
    assert [r["rejected"] for r in explore.false_discoveries(tests).orderBy("id").collect()] == [True, True, False, False]


def test_two_components():
    draw = np.random.default_rng(1)
    far = np.concatenate([draw.normal(0, 1, 40), draw.normal(12, 1, 40)])
    one = (-np.log(far.std()) - 0.5 * np.log(2 * np.pi) - 0.5 * ((far - far.mean()) / far.std()) ** 2).sum()
    assert explore.two_components(far) > one + 20
