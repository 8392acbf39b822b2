"""From a model of all trials and soft recipe labels of their segments to a start of the joint model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqwatch.functions import kernels
from seqwatch.functions.special import duration_tables, fit_nb
from seqwatch.plans.decode import Model, dealt, normalised
from seqwatch.plans.joint import JointModel
from seqwatch.plans.recipes import RecipeModel

#: Trials that a recipe must weigh as much as, to be told by its own counts.
LEAST_TRIALS = 2.0


def segment_labels(segments: DataFrame, model: RecipeModel) -> DataFrame:
    """(trial_id, seg_idx, recipe, w): the posterior of each recipe at each segment, by an HMM over the segments' states."""
    s = F.array_sort(F.collect_list(F.struct("seg_idx", "state")))
    trials = dealt(segments, ["trial_id"]).groupBy("trial_id").agg(s.alias("s")).select("trial_id", F.col("s.seg_idx").alias("at"), F.col("s.state").alias("states"))
    shared = segments.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            trial, at = b["trial_id"].to_numpy(), b["at"].to_numpy()
            for some, states, size in kernels.columns(b["states"], states=len(m.init)):
                gamma = kernels.hmm_expectations_all(states, size, m.init, m.trans, m.emit)[0]
                owner, tick = np.nonzero(np.arange(len(states)) < size[:, None])  # by sequence
                k = gamma.shape[1]
                segs = np.concatenate([at[q] for q in some])
                yield pd.DataFrame({"trial_id": np.repeat(trial[some][owner], k), "seg_idx": np.repeat(segs, k), "recipe": np.tile(np.arange(k), len(owner)), "w": gamma[tick, :, owner].reshape(-1)})

    return trials.mapInPandas(run, "trial_id long, seg_idx int, recipe int, w double")


def weighted_counts(segments: DataFrame, labels: DataFrame, d_max: int) -> DataFrame:
    """(family, recipe, i, j, n): all counts of a start in one weighted aggregate.

    `pi`: trials, each divided among recipes as its segments are; `init`: first states; `trans`: moves, by the label of the
    segment moved to; `dur`: durations, those of `d_max` or more as that, last segments included.
    """
    w = Window.partitionBy("trial_id")
    rows = segments.select("trial_id", "seg_idx", "state", F.least("duration", F.lit(d_max)).alias("d"), F.lag("state").over(w.orderBy("seg_idx")).alias("before"), F.count("*").over(w).alias("of"))
    cell = lambda family, i, j, part=F.lit(1.0): F.struct(F.lit(family).alias("family"), i.alias("i"), j.alias("j"), part.alias("part"))
    none, state, before = F.lit(0), F.col("state"), F.col("before")
    moved = F.when(before.isNull(), cell("init", state, none)).otherwise(cell("trans", before, state))
    each = F.array(cell("pi", none, none, 1 / F.col("of")), moved, cell("dur", state, F.col("d")))
    return rows.join(labels, ["trial_id", "seg_idx"]).select("recipe", "w", F.explode(each).alias("x")).groupBy("x.family", "recipe", "x.i", "x.j").agg(F.sum(F.col("w") * F.col("x.part")).alias("n"))


def warm_start(segments: DataFrame, labels: DataFrame, model: Model, recipes: int, kappa: float = 2.0, alpha: float = 0.5) -> JointModel:
    """The joint model that these counts tell: emissions of `model`, each recipe's own order and durations.

    A recipe that weighs less than `LEAST_TRIALS` trials has the order of `model`; durations are drawn to those of `model`
    by `kappa` expected segments.
    """
    table = weighted_counts(segments, labels, model.d_max).toPandas()  # recipes times states times states or durations
    k, d = len(model.init), model.d_max

    def get(family, shape, below=0):
        out, t = np.zeros(shape), table[table["family"] == family]
        np.add.at(out, (t["recipe"], t["i"], t["j"] - below), t["n"])
        return out

    pi = get("pi", (recipes, 1, 1))[:, 0, 0]
    init, trans = normalised(1 + alpha / k + get("init", (recipes, k, 1))[:, :, 0]), np.stack([normalised(1 + alpha / k + x, no_self=True) for x in get("trans", (recipes, k, k))])
    few = pi < LEAST_TRIALS
    init[few], trans[few] = model.init, model.trans
    common = np.exp(duration_tables(model.r, model.p, d)[0])
    fits = np.array([[fit_nb(h + kappa * c, r) for h, c, r in zip(own, common, model.r)] for own in get("dur", (recipes, k, d), 1)])
    return JointModel(normalised(1 + alpha / recipes + pi), init, trans, model.verbs, model.nouns, fits[:, :, 0], fits[:, :, 1], d)
