"""Traces against enumeration of segmentations, and of one trial at a time."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwatch.functions import kernels
from seqwatch.functions.special import duration_tables
from seqwatch.operators import channels
from seqwatch.plans import decode, joint, recipes, traces


def random_model(seed, n_recipes=3, states=3, verbs=4, nouns=3, d_max=4):
    draw = np.random.default_rng(seed)
    rows = lambda *shape: np.log(draw.dirichlet(np.ones(shape[-1]), shape[:-1]))
    trans = draw.dirichlet(np.ones(states), (n_recipes, states)) * (1 - np.eye(states))
    with np.errstate(divide="ignore"):
        trans = np.log(trans / trans.sum(-1, keepdims=True))
    return joint.JointModel(np.log(np.full(n_recipes, 1 / n_recipes)), rows(n_recipes, states), trans, rows(states, verbs), rows(states, nouns), draw.uniform(1, 4, (n_recipes, states)), draw.uniform(0.3, 0.7, (n_recipes, states)), d_max)


def sequences(seed, n=6, verbs=4, nouns=3):
    draw = np.random.default_rng(seed)
    return {k: (draw.integers(0, verbs, m), draw.integers(0, nouns, m)) for k in range(n) for m in [int(draw.integers(1, 8))]}


def as_ticks(spark, trials):
    rows = [(k, t, int(v), int(n)) for k, (vs, ns) in trials.items() for t, (v, n) in enumerate(zip(vs, ns))]
    return spark.createDataFrame(rows, "trial_id long, tick int, verb_id int, noun_id int")


def enumerated_beliefs(own, v, n):
    """Belief before each tick: every way to tile the ticks up to it, the last segment being open."""
    pmf, survival = duration_tables(own.r, own.p, own.d_max)
    k, out = len(own.init), []
    for t in range(len(v)):
        weight = np.zeros(k)
        for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, t + 1), m) for m in range(t + 1)):
            starts = [0, *cuts]
            lengths = np.diff([*starts, t + 1])
            if (lengths > own.d_max).any():
                continue
            for states in itertools.product(range(k), repeat=len(starts)):
                w = own.init[states[0]] + sum(own.trans[a, b] for a, b in zip(states, states[1:]))
                w += sum(pmf[s, d - 1] for s, d in zip(states[:-1], lengths[:-1])) + survival[states[-1], lengths[-1] - 1]
                where = np.repeat(states, lengths)[:t]
                w += sum(own.verbs[s, v[i]] + own.nouns[s, n[i]] for i, s in enumerate(where))
                weight[states[-1]] += np.exp(w)
        out.append(weight / weight.sum())
    return np.array(out)


@pytest.mark.parametrize("seed", range(3))
def test_mixture_surprises_equal_enumeration(seed):
    model, trials = random_model(seed), sequences(seed + 10)
    for v, n in trials.values():
        own = model.recipe(seed)
        found = traces.trace_of(v, n, own, *own.durations(), seed, marginal=model.marginal_transitions())
        belief = enumerated_beliefs(own, v, n)
        pv, pn = np.exp(own.verbs[:, v].T), np.exp(own.nouns[:, n].T)
        for name, p in (("s_verb", pv), ("s_noun", pn), ("s_emit", pv * pn)):
            assert found[name].tolist() == pytest.approx((-np.log((belief * p).sum(1))).tolist())
        assert found["pi_max"].tolist() == pytest.approx(belief.max(1).tolist())
        assert found["pi_z"].tolist() == pytest.approx(belief[np.arange(len(v)), found["z_star"]].tolist())
        told = found["belief"].map(lambda b: sum(x["p"] for x in b)) + found["dropped"]
        assert told.tolist() == pytest.approx([1.0] * len(v))


def test_segment_scores_by_hand():
    model = random_model(7, d_max=6)
    own = model.recipe(1)
    v, n = np.array([0, 0, 0, 1, 1, 2, 2, 2, 3]), np.zeros(9, int)
    pmf, survival = own.durations()
    marginal = model.marginal_transitions()
    found = traces.trace_of(v, n, own, pmf, survival, 1, marginal=marginal)
    segs, _ = kernels.viterbi(own.look(v, n), own.init, own.trans, pmf, survival)
    p = lambda s, d: math.exp(traces.nb_log_pmf(np.array([float(d)]), own.r[s], own.p[s])[0])
    at = 0
    for k, (s, d) in enumerate(segs):
        rows = found.iloc[at : at + d]
        assert rows["z_star"].tolist() == [s] * d and rows["seg_idx"].tolist() == [k] * d
        assert rows["s_temporal"].tolist() == pytest.approx([-survival[s, e] for e in range(d)])
        if k:
            before = segs[k - 1][0]
            assert rows.iloc[0]["s_transition"] == pytest.approx(-own.trans[before, s])
            assert rows.iloc[0]["s_recipe_transition"] == pytest.approx(marginal[before, s] - own.trans[before, s])
            assert rows.iloc[0]["from_state"] == before and rows.iloc[0]["expected_state"] == own.trans[before].argmax()
        else:
            assert rows.iloc[0][["s_transition", "from_state"]].isna().all()
        last = rows.iloc[-1]
        if k < len(segs) - 1:
            upto, below = sum(p(s, e) for e in range(1, d + 1)), sum(p(s, e) for e in range(1, d))
            assert last["s_dur_short"] == pytest.approx(-math.log(upto)) and last["s_dur_long"] == pytest.approx(-math.log(1 - below))
            assert last["s_dur_two"] == pytest.approx(max(0.0, -math.log(2 * min(upto, 1 - below))))
            assert last["pit"] == pytest.approx((upto + below) / 2)
            assert last["cause"] == ("stuck" if 1 - below < upto else "left_early")
        else:
            assert last[["s_dur_two", "pit", "cause"]].isna().all()
        at += d


def test_conditioned_decoding_equals_one_trial_at_a_time(spark, monkeypatch):
    model, trials = random_model(3), sequences(4, n=40)
    monkeypatch.setattr(traces, "TRIALS_OF_PART", 3)
    packed = traces.recipes_of(traces.packed(as_ticks(spark, trials), ["trial_id"]), model, ["trial_id"])
    told = {r["trial_id"]: (r["recipe"], r["rho"]) for r in packed.collect()}
    found = {}
    for r in traces.decode_conditioned(packed, model, ["trial_id"]).collect():
        found.setdefault(r["trial_id"], []).append((r["seg_idx"], r["state"], r["duration"], r["tick_start"], r["is_last"], r["recipe"]))
    assert len({r for r, _ in told.values()}) > 1 and set(found) == set(trials)
    for k, (v, n) in trials.items():
        weights = []
        for q in range(3):
            own = model.recipe(q)
            weights.append(model.pi[q] + kernels.forward(own.look(v, n), own.init, own.trans, *own.durations())[3])
        best = int(np.argmax(weights))
        tables = [np.stack(x) for x in zip(*(model.recipe(q).durations() for q in range(3)))]
        assert kernels.stacked_likelihoods(own.look(v, n), model.init, model.trans, *tables) + model.pi == pytest.approx(weights)
        assert told[k][0] == best and told[k][1] == pytest.approx(np.exp(weights - kernels.lse(np.array(weights), 0)).tolist())
        own = model.recipe(best)
        segs, _ = kernels.viterbi(own.look(v, n), own.init, own.trans, *own.durations())
        at, expected = 0, []
        for i, (s, d) in enumerate(segs):
            expected.append((i, s, d, at, i == len(segs) - 1, best))
            at += d
        assert sorted(found[k]) == expected


def least_flagged(levels, alpha):
    """The exact threshold: the greatest score with at most alpha of the mass above it, from (score, mass)."""
    scores = sorted({round(s, 9) for s, m in levels if m > 0})
    return next(t for t in scores if sum(m for s, m in levels if round(s, 9) > t) <= alpha + 1e-12)


def test_flags_of_traces_equal_a_plain_loop(spark):
    model, trials, keys, alpha = random_model(5, states=4, verbs=6, nouns=6), sequences(6, n=80, verbs=6, nouns=6), ["trial_id"], 0.3
    trace = traces.trace_joint(as_ticks(spark, trials), model, keys).cache()
    found = {(r["trial_id"], r["tick"], r["channel"]) for r in traces.flags(trace, traces.bundle(spark, model, [alpha]), keys).collect()}
    marginal, expected = model.marginal_transitions(), set()
    pv, pn = np.exp(model.verbs), np.exp(model.nouns)
    for r in trace.collect():
        z, q, f, sure = r["z_star"], r["recipe"], r["from_state"], -math.log(r["pi_z"])
        limits = {
            "s_verb": least_flagged([(-math.log(x), x) for x in pv[z]], alpha) + sure + 1e-6,
            "s_noun": least_flagged([(-math.log(x), x) for x in pn[z]], alpha) + sure + 1e-6,
            "s_emit": least_flagged([(-math.log(x * y), x * y) for x in pv[z] for y in pn[z]], alpha) + sure + 1e-6,
            "s_temporal": -math.log(alpha),
            "s_dur_two": -math.log(alpha),
        }
        if f is not None:
            others = [k for k in range(4) if k != f]
            limits["s_transition"] = least_flagged([(-model.trans[q, f, k], math.exp(model.trans[q, f, k])) for k in others], alpha)
            limits["s_recipe_transition"] = least_flagged([(marginal[f, k] - model.trans[q, f, k], math.exp(model.trans[q, f, k])) for k in others], alpha)
        expected |= {(r["trial_id"], r["tick"], c) for c, limit in limits.items() if r[c] is not None and round(r[c] - limit, 8) > 0}
    assert found == expected and len({c for *_, c in found}) >= len(channels.CHANNELS) - 1
    segs = {(r["trial_id"], r["seg_idx"]): r for r in traces.segments_of(trace, keys).collect()}
    again = traces.decode_conditioned(traces.recipes_of(traces.packed(as_ticks(spark, trials), keys), model, keys), model, keys).collect()
    assert len(segs) == len(again) and all(segs[r["trial_id"], r["seg_idx"]].asDict() == r.asDict() for r in again)
    row = traces.belief_diagnostic(trace, keys, 0.5).first()
    below = [(r["trial_id"], r["pi_max"] < 0.5) for r in trace.collect()]
    shares = [np.mean([b for t, b in below if t == k]) for k in trials]
    assert (row["ticks"], row["pooled"], row["by_sequence"]) == (len(below), pytest.approx(np.mean([b for _, b in below])), pytest.approx(np.mean(shares)))


def test_recipe_path_of_segments(spark):
    model, trials = random_model(8, n_recipes=1), sequences(9, n=12)
    hmm = recipes.start(2, 3, 1)
    rows = traces.trace_cascade(as_ticks(spark, trials), model.recipe(0), hmm, ["trial_id"])
    thresholds = traces.bundle(spark, model, [0.5], hmm=hmm)
    assert {tuple(r) for r in thresholds.groupBy("channel").count().collect()} >= {("s_recipe_transition", 2), ("s_transition", 3)}
    assert traces.flags(rows, thresholds, ["trial_id"], by_recipe_path=True).count() > 0
    for k, (v, n) in trials.items():
        own = model.recipe(0)
        segs, _ = kernels.viterbi(own.look(v, n), own.init, own.trans, *own.durations())
        path = kernels.hmm_expectations(np.array([s for s, _ in segs]), hmm.init, hmm.trans, hmm.emit)[0].argmax(1)
        mine = rows.filter(F.col("trial_id") == k).orderBy("tick").collect()
        assert [r["recipe"] for r in mine] == [int(q) for q, (_, d) in zip(path, segs) for _ in range(d)]
        moved = [r for r in mine if r["from_recipe"] is not None]
        assert [(r["from_recipe"], r["s_recipe_transition"]) for r in moved] == [(int(a), pytest.approx(-hmm.trans[a, b])) for a, b in zip(path, path[1:])]


def test_fates_of_junctions(spark):
    keys = "trial_id long, error_type string, "
    segments = spark.createDataFrame([(1, 0, 0, 0, 2), (1, 1, 1, 2, 4), (1, 2, 2, 4, 6), (2, 0, 0, 0, 2), (2, 1, 1, 2, 4), (2, 2, 0, 4, 6), (3, 0, 1, 0, 3), (3, 1, 2, 3, 6)], "trial_id long, seg_idx int, state int, tick_start int, tick_end int")
    # trial 1 and 2 lose their middle segment: 0 then 2 is new, 0 then 0 no move; trial 3 is untouched
    degraded = spark.createDataFrame([(t, "omission", k, s) for t, src in ((1, [0, 1, 4, 5]), (2, [0, 1, 4, 5]), (3, list(range(6)))) for k, s in enumerate(src)], keys + "tick int, src_tick int")
    recipes_ = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "trial_id long, recipe int")

    def fates(decoded, heard, recipe=0):
        z = {1: decoded, 2: [0, 0, 0, 0], 3: [1, 1, 1, 2, 2, 2]}
        rows = [(t, "omission", k, x, xs[k - 1] if k and xs[k - 1] != x else None, recipe if t == 1 else 0) for t, xs in z.items() for k, x in enumerate(xs)]
        trace = spark.createDataFrame(rows, keys + "tick int, z_star int, from_state int, recipe int")
        flagged = spark.createDataFrame([(1, "omission", t, c) for t, c in heard], keys + "tick int, channel string")
        return tuple(traces.junction_fates(trace, flagged, degraded, segments, recipes_).first())

    assert fates([0, 0, 2, 2], [(2, "s_transition")]) == ("omission", 3, 1, 1, 1, 1)
    assert fates([0, 0, 2, 2], [(1, "s_transition"), (2, "s_emit")], recipe=2) == ("omission", 3, 1, 1, 0, 2)
    assert fates([0, 1, 2, 2], [(2, "s_recipe_transition")]) == ("omission", 3, 1, 0, 0, 1)


def test_one_tick_and_single_models(spark):
    one = as_ticks(spark, {5: (np.array([1]), np.array([0]))})
    model = random_model(2, n_recipes=1)
    (row,) = traces.trace_joint(one, model, ["trial_id"]).collect()
    assert (row["tick"], row["from_state"], row["s_transition"], row["s_dur_two"]) == (0, None, None, None)
    own = traces.single(model.recipe(0))
    assert decode.decode(one, model.recipe(0)).select("state").first() == traces.segments_of(traces.trace_joint(one, own, ["trial_id"]), ["trial_id"]).select("state").first()


def test_questions_speak_for_the_trials_own_recipe(spark):
    model, trials, keys, alpha = random_model(5, states=4, verbs=6, nouns=6), sequences(6, n=60, verbs=6, nouns=6), ["trial_id"], 0.3
    ticks = as_ticks(spark, trials).cache()
    trace = traces.trace_joint(ticks, model, keys).cache()
    flagged = traces.flags(trace, traces.bundle(spark, model, [alpha]), keys).cache()
    names = spark.createDataFrame([(k, f"s{k}") for k in range(6)], "state int, name string")
    items = spark.createDataFrame([(k, f"i{k}") for k in range(6)], "noun_id int, item string")
    found = {(r["trial_id"], r["tick"], r["channel"]): r for r in traces.narrated(trace, flagged, ticks, model, names, items, alpha).collect()}
    rows = {(r["trial_id"], r["tick"]): r for r in trace.collect()}
    marks = {(r["trial_id"], r["tick"], r["channel"]) for r in flagged.collect()}
    assert {k for k in marks if k[2] in ("s_transition", "s_dur_two")} == {k for k in found if k[2] in ("s_transition", "s_dur_two")}
    assert set(found) <= marks and {c for *_, c in found} >= {"s_dur_two", "s_transition", "s_verb"}
    for (trial, tick, channel), r in found.items():
        row = rows[trial, tick]
        q, z, f = row["recipe"], row["z_star"], row["from_state"]
        if channel == "s_transition":
            hops = {b: model.trans[q, f, b] + model.trans[q, b, z] for b in range(4) if b not in (f, z)}
            best = max(hops, key=lambda b: (round(hops[b], 9), -b))
            if hops[best] - model.trans[q, f, z] >= 2:
                assert r["text"] == f"Did you skip 's{best}' between 's{f}' and 's{z}'?"
            else:
                assert r["text"] == f"'s{z}' came after 's{f}'; usually 's{model.trans[q, f].argmax()}' does. Is that right?"
        if channel in ("s_dur_two", "s_temporal"):
            mean = 1 + model.r[q, z] * (1 - model.p[q, z]) / model.p[q, z]
            assert f"'s{z}'" in r["text"] and f"about {math.floor(mean + 0.5)}." in r["text"]
        if channel in ("s_verb", "s_noun"):
            table, name, seen = (model.verbs, "s", trials[trial][0]) if channel == "s_verb" else (model.nouns, "i", trials[trial][1])
            assert r["text"] == f"Was '{name}{seen[tick]}' meant here? '{name}{table[z].argmax()}' was expected."
