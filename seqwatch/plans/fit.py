"""Fitting models: each iteration is one Spark job over the trials, its sums small enough for the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwatch.functions import kernels
from seqwatch.functions.special import duration_tables, fit_nb
from seqwatch.plans.decode import Model, decode, normalised, packed_trials, random_counts


def expected_statistics(trials: DataFrame, model: Model, temperature: float = 1.0) -> pd.DataFrame:
    """(family, i, j, value) sums of all trials' expected statistics; tasks add up their trials before the shuffle."""
    shared = trials.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        pmf, survival = (x / temperature for x in m.durations())
        k = len(m.init)
        sums = {"init": np.zeros((k, 1)), "trans": np.zeros((k, k)), "verbs": np.zeros_like(m.verbs), "nouns": np.zeros_like(m.nouns), "closed": np.zeros_like(pmf), "open": np.zeros_like(pmf), "log_z": np.zeros((1, 1))}
        for b in batches:
            for _, v, n, size in kernels.columns(b["verb_ids"], b["noun_ids"], states=k):
                xi, closed, open_, gamma, total = kernels.expectations_all(m.look(v, n) / temperature, size, m.init, m.trans, pmf, survival)
                tick, owner = np.nonzero(np.arange(len(v))[:, None] < size)
                seen = gamma[tick, :, owner]
                sums["init"] += gamma[0].sum(1)[:, None]
                sums["trans"] += xi.sum(2)
                np.add.at(sums["verbs"].T, v[tick, owner], seen)
                np.add.at(sums["nouns"].T, n[tick, owner], seen)
                sums["closed"] += closed.sum(2)
                sums["open"] += open_.sum(2)
                sums["log_z"] += total.sum()
        for family, table in sums.items():
            i, j = np.nonzero(table)
            yield pd.DataFrame({"family": family, "i": i, "j": j, "value": table[i, j]})

    return trials.mapInPandas(run, "family string, i int, j int, value double").groupBy("family", "i", "j").agg(F.sum("value").alias("value")).toPandas()


def imputed(closed: np.ndarray, open_: np.ndarray, pmf: np.ndarray, survival: np.ndarray) -> np.ndarray:
    """Durations with those cut off at c spread over all longer ones in proportion to their probability."""
    share = open_ / np.exp(survival)
    return closed + np.exp(pmf) * np.cumsum(share, 1)


def maximised(stats: pd.DataFrame, model: Model, alpha: float = 0.5) -> tuple[Model, float]:
    """The next model and the log likelihood of the last one."""
    k, v, n, d = len(model.init), model.verbs.shape[1], model.nouns.shape[1], model.d_max

    def get(family, shape):
        out, t = np.zeros(shape), stats[stats["family"] == family]
        out[t["i"], t["j"]] = t["value"]
        return out

    pmf, survival = duration_tables(model.r, model.p, d)
    hist = imputed(get("closed", (k, d)), get("open", (k, d)), pmf, survival)
    fits = [fit_nb(h, r) if h.sum() > 1e-6 else (r, p) for h, r, p in zip(hist, model.r, model.p)]
    new = Model(
        normalised(alpha / k + get("init", (k, 1))[:, 0]), normalised(alpha / k + get("trans", (k, k)), no_self=True), normalised(1.0 + get("verbs", (k, v))), normalised(1.0 + get("nouns", (k, n))),
        np.array([f[0] for f in fits]), np.array([f[1] for f in fits]), d,
    )
    return new, float(get("log_z", (1, 1))[0, 0])


def start(states: int, n_verbs: int, n_nouns: int, d_max: int, seed: int) -> Model:
    init, trans, verbs, nouns, r, p = random_counts(states, n_verbs, n_nouns, seed)
    return Model(normalised(init), normalised(trans, no_self=True), normalised(1 + verbs), normalised(1 + nouns), r, p, d_max)


def soft_em(ticks: DataFrame, model: Model, iterations: int, tol: float = 1e-3, anneal: float = 2.0) -> tuple[Model, list[float]]:
    """Expectation maximisation with a temperature that falls to 1; the trials are packed and cached once."""
    trials = packed_trials(ticks).cache()
    history: list[float] = []
    for i in range(iterations):
        temperature = max(1.0, anneal * 0.9**i)
        model, total = maximised(expected_statistics(trials, model, temperature), model)
        history.append(total)
        if temperature == 1.0 and len(history) > 1 and abs(history[-1] - history[-2]) < tol:
            break
    trials.unpersist()
    return model, history


def hard_counts(ticks: DataFrame, segments: DataFrame, d_max: int) -> DataFrame:
    """(family, i, j, value) counts of decoded segments; the last segment of a trial counts as cut off. All grouping."""
    d = F.least("duration", F.lit(d_max)) - 1
    one = lambda rows, family, i, j: rows.groupBy(i.alias("i"), j.alias("j")).agg(F.count("*").cast("double").alias("value")).select(F.lit(family).alias("family"), "i", "j", "value")
    from seqwatch.operators.counts import transitions

    spans = segments.select("trial_id", "state", F.explode(F.sequence("tick_start", F.col("tick_end") - 1)).alias("tick"))
    seen = ticks.select("trial_id", "tick", "verb_id", "noun_id").join(spans, ["trial_id", "tick"])
    zero = F.lit(0)
    return (
        one(segments.filter("seg_idx = 0"), "init", F.col("state"), zero)
        .unionByName(one(transitions(segments), "trans", F.col("from_state"), F.col("to_state")))
        .unionByName(one(segments.filter("not is_last"), "closed", F.col("state"), d))
        .unionByName(one(segments.filter("is_last"), "open", F.col("state"), d))
        .unionByName(one(seen, "verbs", F.col("state"), F.col("verb_id")))
        .unionByName(one(seen, "nouns", F.col("state"), F.col("noun_id")))
    )


def hard_em(ticks: DataFrame, model: Model, iterations: int) -> Model:
    """Decode, count, normalise; the counts are grouped sums in Spark."""
    ticks = ticks.cache()
    for _ in range(iterations):
        model, _ = maximised(hard_counts(ticks, decode(ticks, model), model.d_max).toPandas(), model)
    ticks.unpersist()
    return model


def sampled(spark, model: Model, n: int, max_ticks: int, seed: int) -> DataFrame:
    """n trials drawn from a model: trial_id, tick, verb_id, noun_id, state. Each trial has a generator of its own."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        tables = [np.exp(x) for x in (m.init, m.trans, m.verbs, m.nouns)]
        for b in batches:
            for trial in b["id"]:
                draw = np.random.default_rng([seed, int(trial)])
                pick = lambda w: int(draw.choice(len(w), p=w / w.sum()))  # noqa: E731, B023
                rows, state = [], pick(tables[0])
                while len(rows) < max_ticks:
                    d = min(1 + int(draw.negative_binomial(m.r[state], m.p[state])), m.d_max, max_ticks - len(rows))
                    rows += [(pick(tables[2][state]), pick(tables[3][state]), state) for _ in range(d)]
                    state = pick(tables[1][state])
                yield pd.DataFrame({"trial_id": trial, "tick": range(len(rows)), "verb_id": [r[0] for r in rows], "noun_id": [r[1] for r in rows], "state": [r[2] for r in rows]})

    return spark.range(n).mapInPandas(run, "trial_id long, tick int, verb_id int, noun_id int, state int")
