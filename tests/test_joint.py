"""The joint model and the recipe HMM: against the single model, against enumeration, and on what they generated."""

from itertools import permutations

import numpy as np
import pytest

from seqwatch.functions import kernels
from seqwatch.functions.special import duration_tables, fit_nb
from seqwatch.operators import counts
from seqwatch.plans import decode, fit, joint, recipes
from tests.test_plans import peaked


def twofold(model):
    two = lambda x: np.stack([x, x])
    return joint.JointModel(np.log([0.5, 0.5]), two(model.init), two(model.trans), model.verbs, model.nouns, two(model.r), two(model.p), model.d_max)


def test_equal_recipes_are_one_model(spark):
    model = peaked()
    trials = decode.packed_trials(fit.sampled(spark, model, 6, 40, 1)).cache()
    one, two = fit.expected_statistics(trials, model), joint.expected_statistics(trials, twofold(model))
    for family in ("verbs", "nouns", "log_z"):
        a, b = (x[x["family"] == family].sort_values(["i", "j"])["value"].to_numpy() for x in (one, two))
        np.testing.assert_allclose(a, b, rtol=1e-9)
    for family in ("init", "trans", "closed", "open"):
        a, b = (x[x["family"] == family].groupby(["i", "j"])["value"].sum().to_numpy() for x in (one, two))
        np.testing.assert_allclose(a, b, rtol=1e-9)
    assert two[two["family"] == "pi"]["value"].tolist() == pytest.approx([3.0, 3.0])


def test_posteriors_equal_enumeration(spark):
    """The likelihood of a short trial is the sum over recipes of that over all segmentations."""
    model = twofold(peaked())
    model.trans[1] = np.log(np.where(np.eye(3) > 0, 0, 0.5) + 1e-300)
    model.trans[1][np.eye(3) > 0] = -np.inf
    v, n = [0, 0, 1, 2], [0, 0, 1, 2]
    ticks = spark.createDataFrame([(1, t, a, b) for t, (a, b) in enumerate(zip(v, n))], "trial_id long, tick int, verb_id int, noun_id int")
    stats = joint.expected_statistics(decode.packed_trials(ticks), model)

    def total(r):
        pmf, survival = duration_tables(model.r[r], model.p[r], model.d_max)
        look = model.verbs[:, v].T + model.nouns[:, n].T

        def rest(at, state, weight):
            found = []
            for d in range(1, len(v) - at + 1):
                w = weight + look[at : at + d, state].sum()
                if at + d == len(v):
                    found.append(w + survival[state, d - 1])
                else:
                    found += [x for s in range(3) if s != state for x in rest(at + d, s, w + pmf[state, d - 1] + model.trans[r][state, s])]
            return found

        return kernels.lse(np.array([x for s in range(3) for x in rest(0, s, model.init[r][s])]), 0)

    each = np.log(0.5) + np.array([total(0), total(1)])
    assert stats[stats["family"] == "log_z"]["value"].item() == pytest.approx(kernels.lse(each, 0))
    rho = stats[stats["family"] == "pi"].sort_values("r")["value"].to_numpy()
    np.testing.assert_allclose(rho, np.exp(each - kernels.lse(each, 0)), rtol=1e-9)


def test_joint_em_parts_recipes_and_resumes(spark, tmp_path):
    forward, backward = peaked(), peaked()
    backward.trans = np.log(np.where(np.eye(3) > 0, 0, (np.roll(np.eye(3), -1, 1) * 0.9 + 0.05)) + 1e-300)
    backward.trans[np.eye(3) > 0] = -np.inf
    a, b = fit.sampled(spark, forward, 12, 80, 3), fit.sampled(spark, backward, 12, 80, 4)
    ticks = a.unionByName(b.withColumn("trial_id", b["trial_id"] + 100)).cache()
    path = str(tmp_path / "model")
    model, history = joint.joint_em(ticks, joint.start(forward, 2, 5), 8, checkpoint=path)
    assert history[-1] > history[0]
    loaded = joint.JointModel.load(spark, path)
    for family in ("pi", "init", "trans", "verbs", "nouns", "r", "p"):
        np.testing.assert_array_equal(getattr(loaded, family), getattr(model, family))
    state = joint.Checkpoint.load(spark, path)
    assert (state.iteration, state.temperature) == (len(history), 1.0) and state.history == history
    part = str(tmp_path / "part")
    assert joint.Checkpoint.find(spark, part) is None
    joint.joint_em(ticks, joint.start(forward, 2, 5), 3, anneal=1.5, checkpoint=part, resume=True)
    assert not joint.Checkpoint.load(spark, part).converged
    (tmp_path / "part" / "iteration=99" / "_temporary").mkdir(parents=True)  # what a killed driver leaves
    resumed, told = joint.joint_em(ticks, joint.start(forward, 2, 6), 6, anneal=1.5, checkpoint=part, resume=True)
    straight, whole = joint.joint_em(ticks, joint.start(forward, 2, 5), 6, anneal=1.5)
    np.testing.assert_allclose(told, whole)
    np.testing.assert_allclose(resumed.trans, straight.trans, atol=1e-6)
    resumed.save(spark, part, 6, told, 1.0, True)
    assert joint.joint_em(ticks, model, 50, checkpoint=part, resume=True)[1] == told
    rows = decode.recipe_posteriors(ticks, [model.recipe(0), model.recipe(1)], model.pi.tolist()).collect()
    first = {r["r_hat"] for r in rows if r["trial_id"] < 100}
    assert len(first) == 1 and {r["r_hat"] for r in rows if r["trial_id"] >= 100} == {1 - first.pop()}
    np.testing.assert_allclose(np.exp(model.collapsed().trans).sum(1), 1, atol=1e-6)


def test_shrinkage(spark):
    draw = np.random.default_rng(0)
    hist = draw.poisson(5, (2, 3, 20)).astype(float)
    r = np.full((2, 3), 2.0)
    got_r, got_p = joint.shrunk_durations(hist, r, 0.0)
    for q in range(2):
        for s in range(3):
            assert (got_r[q, s], got_p[q, s]) == pytest.approx(fit_nb(hist[q, s], 2.0))
    hist[1] = 0
    far_r, far_p = joint.shrunk_durations(hist, r, 50.0)
    mean = lambda r, p: 1 + r * (1 - p) / p
    np.testing.assert_allclose(mean(far_r[1], far_p[1]), mean(far_r[0], far_p[0]), rtol=0.2)


def test_recipe_hmm(spark):
    draw = np.random.default_rng(2)
    rows = [(t, k, int(draw.choice([0, 1, 2] if t % 2 else [3, 4, 5]))) for t in range(30) for k in range(8)]
    segments = spark.createDataFrame(rows, "trial_id long, seg_idx int, state int")
    model, histories = recipes.recipe_em(segments, 2, 6, 15, [0, 1])
    assert all(h[-1] > h[0] for h in histories)
    found = recipes.decoded_recipes(segments, model).withColumn("true", (counts.F.col("trial_id") % 2).cast("int"))
    assert found.count() == 30 and recipes.matched_accuracy(found, "recipe_id", "true") == 1.0


def test_assignment_equals_enumeration():
    draw = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 3), (5, 5)):
        for _ in range(10):
            gain = draw.integers(0, 20, (n, m))
            small = gain if n <= m else gain.T
            best = max(sum(small[i, c] for i, c in enumerate(p)) for p in permutations(range(small.shape[1]), small.shape[0]))
            found = recipes.assignment(gain)
            assert sum(gain[r, c] for r, c in found) == best
            assert len({r for r, _ in found}) == len({c for _, c in found}) == min(n, m)
