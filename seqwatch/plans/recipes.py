"""Recipes as the hidden states of a plain HMM over the states of a trial's segments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwatch.functions import kernels
from seqwatch.operators.counts import contingency, majority
from seqwatch.plans.decode import dealt, normalised


@dataclass
class RecipeModel:
    """Log tables of recipes; a trial may change its recipe, so the diagonal of `trans` counts."""

    init: np.ndarray
    trans: np.ndarray
    emit: np.ndarray


def start(recipes: int, states: int, seed: int, alpha: float = 0.5) -> RecipeModel:
    draw = np.random.default_rng(seed)
    rows = lambda a, n, width: normalised(1 + a * draw.dirichlet(np.full(width, max(a / width, 0.05)), n))
    return RecipeModel(rows(alpha, 1, recipes)[0], rows(alpha, recipes, recipes), rows(float(states), recipes, states))


def packed_segments(segments: DataFrame) -> DataFrame:
    s = F.array_sort(F.collect_list(F.struct("seg_idx", "state")))
    return dealt(segments, ["trial_id"]).groupBy("trial_id").agg(s.alias("s")).select("trial_id", F.col("s.state").alias("states"))


def expected_statistics(trials: DataFrame, model: RecipeModel) -> pd.DataFrame:
    """(family, i, j, value) sums over all trials, added up in tasks first."""
    shared = trials.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        sums = {"init": np.zeros((len(m.init), 1)), "trans": np.zeros_like(m.trans), "emit": np.zeros_like(m.emit), "log_z": np.zeros((1, 1))}
        for b in batches:
            for _, states, size in kernels.columns(b["states"], states=len(m.init)):
                gamma, xi, total = kernels.hmm_expectations_all(states, size, m.init, m.trans, m.emit)
                tick, owner = np.nonzero(np.arange(len(states))[:, None] < size)
                sums["init"] += gamma[0].sum(1)[:, None]
                sums["trans"] += xi.sum(2)
                np.add.at(sums["emit"].T, states[tick, owner], gamma[tick, :, owner])
                sums["log_z"] += total.sum()
        for family, table in sums.items():
            i, j = np.nonzero(table)
            yield pd.DataFrame({"family": family, "i": i, "j": j, "value": table[i, j]})

    return trials.mapInPandas(run, "family string, i int, j int, value double").groupBy("family", "i", "j").agg(F.sum("value").alias("value")).toPandas()


def recipe_em(segments: DataFrame, recipes: int, states: int, iterations: int, seeds: list[int], tol: float = 1e-4, alpha: float = 0.5) -> tuple[RecipeModel, list[list[float]]]:
    """The best of several starts by log likelihood, and the histories of all."""
    trials = packed_segments(segments).cache()
    best, top, histories = None, -np.inf, []
    for seed in seeds:
        model, history = start(recipes, states, seed, alpha), []
        for _ in range(iterations):
            stats = expected_statistics(trials, model)

            def get(family, shape, stats=stats):
                out, t = np.zeros(shape), stats[stats["family"] == family]
                out[t["i"], t["j"]] = t["value"]
                return out

            history.append(float(get("log_z", (1, 1))[0, 0]))
            # A weight of 1 is added where the mode of the posterior takes it off again, as no cell may vanish.
            model = RecipeModel(normalised(1 + alpha / recipes + get("init", (recipes, 1))[:, 0]), normalised(1 + alpha / recipes + get("trans", (recipes, recipes))), normalised(1 + 1.0 / states + get("emit", (recipes, states))))
            if len(history) > 1 and abs(history[-1] - history[-2]) < tol:
                break
        histories.append(history)
        if history[-1] > top:
            best, top = model, history[-1]
    trials.unpersist()
    return best, histories


def decoded_recipes(segments: DataFrame, model: RecipeModel) -> DataFrame:
    """(trial_id, recipe_id): the likeliest recipe of most segments, the smaller of equals."""
    shared = segments.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            trials = b["trial_id"].to_numpy()
            for some, states, size in kernels.columns(b["states"], states=len(m.init)):
                found = kernels.hmm_expectations_all(states, size, m.init, m.trans, m.emit)[0].argmax(1)
                tick, owner = np.nonzero(np.arange(len(states))[:, None] < size)
                yield pd.DataFrame({"trial_id": trials[some][owner], "recipe_id": found[tick, owner]})

    each = packed_segments(segments).mapInPandas(run, "trial_id long, recipe_id int")
    return majority(each, "trial_id", "recipe_id").select("trial_id", "recipe_id")


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of the one-to-one assignment with the largest sum, by shortest augmenting paths."""
    if gain.shape[0] > gain.shape[1]:
        return sorted((r, c) for c, r in assignment(gain.T))
    cost = gain.max() - gain.astype(float)
    n, m = cost.shape
    row_price, col_price, row_of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for new in range(n):
        reach, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, at, paid = new, -1, 0.0
        while True:
            step = paid + cost[row] - row_price[row] - col_price
            better = ~done & (step < reach)
            reach[better], came[better] = step[better], at
            at = int(np.where(done, np.inf, reach).argmin())
            paid, done[at] = reach[at], True
            if row_of[at] < 0:
                break
            row = int(row_of[at])
        for c in np.flatnonzero(done):
            if c != at:
                row_price[row_of[c]] += paid - reach[c]
                col_price[c] -= paid - reach[c]
        row_price[new] += paid
        while at >= 0:
            before = int(came[at])
            row_of[at] = row_of[before] if before >= 0 else new
            at = before
    return sorted((int(r), c) for c, r in enumerate(row_of) if r >= 0)


def matched_accuracy(rows: DataFrame, predicted: str, true: str) -> float:
    """The share of rows that are right under the best one-to-one naming of the predicted classes."""
    table = contingency(rows, predicted, true).toPandas().pivot_table(index="a", columns="b", values="n", fill_value=0).to_numpy()  # classes times classes
    return float(sum(table[r, c] for r, c in assignment(table)) / table.sum())
