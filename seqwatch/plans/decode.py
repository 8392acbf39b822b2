"""Decoding trials with a fitted model: maps over batches of packed trials, tables broadcast."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwatch.functions import kernels
from seqwatch.functions.special import duration_tables


def looks(verbs: np.ndarray, nouns: np.ndarray, verb_ids: np.ndarray, noun_ids: np.ndarray) -> np.ndarray:
    """Log likelihoods (T, K) of the ticks of a sequence, or (T, K, B) of sequences (T, B)."""
    return np.ascontiguousarray((verbs[:, verb_ids] + nouns[:, noun_ids]).swapaxes(0, 1))


@dataclass
class Model:
    """Log tables of one explicit-duration model over verbs and nouns."""

    init: np.ndarray
    trans: np.ndarray
    verbs: np.ndarray
    nouns: np.ndarray
    r: np.ndarray
    p: np.ndarray
    d_max: int

    def durations(self):
        return duration_tables(self.r, self.p, self.d_max)

    def look(self, verb_ids: np.ndarray, noun_ids: np.ndarray) -> np.ndarray:
        return looks(self.verbs, self.nouns, verb_ids, noun_ids)

    def long(self, spark: SparkSession) -> DataFrame:
        """(family, i, j, value) rows, the stored form."""
        rows = [(name, int(i), int(j), float(v)) for name in ("trans", "verbs", "nouns") for (i, j), v in np.ndenumerate(getattr(self, name))]
        rows += [(name, int(i), 0, float(v)) for name in ("init", "r", "p") for i, v in enumerate(getattr(self, name))] + [("d_max", 0, 0, float(self.d_max))]
        return spark.createDataFrame(rows, "family string, i int, j int, value double")

    @staticmethod
    def read(rows: DataFrame) -> Model:
        table = rows.toPandas()  # a model: K times the vocabulary
        def get(name):
            t = table[table["family"] == name]
            out = np.zeros((t["i"].max() + 1, t["j"].max() + 1))
            out[t["i"], t["j"]] = t["value"]
            return out

        return Model(get("init")[:, 0], get("trans"), get("verbs"), get("nouns"), get("r")[:, 0], get("p")[:, 0], int(get("d_max")[0, 0]))


def normalised(counts: np.ndarray, no_self: bool = False) -> np.ndarray:
    """Log probabilities of rows of counts at the mode of the posterior: a cell has its count less 1, never below a floor."""
    mass = np.maximum(counts - 1.0, 1e-12)
    if no_self:
        mass = mass * (1 - np.eye(len(mass)))
    with np.errstate(divide="ignore"):
        return np.log(mass) - np.log(np.maximum(mass.sum(-1, keepdims=True), 1e-12))


def random_counts(states: int, n_verbs: int, n_nouns: int, seed: int, alpha: float = 0.5):
    """Dirichlet draws that break the symmetry of a start: (init, trans, verbs, nouns, r, p)."""
    draw = np.random.default_rng(seed)
    rows = lambda a, width: a * draw.dirichlet(np.full(width, a / width), states)
    init = alpha * draw.dirichlet(np.full(states, alpha / states))
    mean, r = draw.uniform(3, 40, states), draw.uniform(1, 20, states)
    return init, rows(alpha, states) * (1 - np.eye(states)), rows(float(n_verbs), n_verbs), rows(float(n_nouns), n_nouns), r, r / (r + mean)


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` by `keys` into a fixed number of partitions, which are not merged for having few bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def packed_trials(ticks: DataFrame) -> DataFrame:
    """trial_id, verb_ids, noun_ids in order of ticks, dealt evenly."""
    t = F.array_sort(F.collect_list(F.struct("tick", "verb_id", "noun_id")))
    return dealt(ticks, ["trial_id"]).groupBy("trial_id").agg(t.alias("t")).select("trial_id", F.col("t.verb_id").alias("verb_ids"), F.col("t.noun_id").alias("noun_ids"))


def _map_trials(ticks: DataFrame, model: Model, kernel, schema: str) -> DataFrame:
    """`kernel(model, look, lengths, pmf, survival)` of batches of trials: places of its rows' trials and their columns."""
    shared = ticks.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        pmf, survival = m.durations()
        for b in batches:
            trials = b["trial_id"].to_numpy()
            for some, v, n, size in kernels.columns(b["verb_ids"], b["noun_ids"], states=len(m.init)):
                owner, rows = kernel(m, m.look(v, n), size, pmf, survival)
                yield pd.DataFrame({"trial_id": trials[some][owner], **rows})

    return packed_trials(ticks).mapInPandas(run, schema)


def segments_by_trial(counts: np.ndarray, durations: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, number within the sequence, first tick) of segments, sequence by sequence."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = (np.cumsum(counts) - counts)[owner]
    start = np.cumsum(durations) - durations
    return owner, np.arange(len(owner)) - first, start - start[first]


def decode(ticks: DataFrame, model: Model) -> DataFrame:
    """The likeliest segments of each trial: trial_id, seg_idx, state, tick_start, tick_end, duration, is_last."""

    def kernel(m, look, size, pmf, survival):
        counts, states, d, _ = kernels.viterbi_all(look, size, m.init, m.trans, pmf, survival)
        owner, seg, start = segments_by_trial(counts, d)
        return owner, {"seg_idx": seg, "state": states, "tick_start": start, "tick_end": start + d, "duration": d, "is_last": seg == counts[owner] - 1}

    return _map_trials(ticks, model, kernel, "trial_id long, seg_idx int, state int, tick_start int, tick_end int, duration int, is_last boolean")


def beliefs(ticks: DataFrame, model: Model) -> DataFrame:
    """Causal beliefs and emission surprises of each tick: trial_id, tick, belief (array by state), s_verb, s_noun, s_emit."""

    def kernel(m, look, size, pmf, survival):
        log_belief, *_ = kernels.forward_all(look, size, m.init, m.trans, pmf, survival)
        tick, owner = np.nonzero(np.arange(len(look))[:, None] < size)
        log_belief, look = log_belief[tick, :, owner], look[tick, :, owner]
        return owner, {"tick": tick, "belief": list(np.exp(log_belief)), "s_emit": -kernels.lse(log_belief + look, 1)}

    return _map_trials(ticks, model, kernel, "trial_id long, tick int, belief array<double>, s_emit double")


def log_likelihoods(ticks: DataFrame, models: list[Model]) -> DataFrame:
    """trial_id and the log likelihood under each of several models (one for each recipe)."""
    shared = ticks.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        tables = [(m, *m.durations()) for m in shared.value]
        for b in batches:
            out = np.empty((len(b), len(tables)))
            for some, v, n, size in kernels.columns(b["verb_ids"], b["noun_ids"], states=max(len(m.init) for m, *_ in tables)):
                out[some] = np.stack([kernels.likelihoods(m.look(v, n), size, m.init, m.trans, pmf, survival) for m, pmf, survival in tables], 1)
            yield pd.DataFrame({"trial_id": b["trial_id"], "log_z": list(out)})

    return packed_trials(ticks).mapInPandas(run, "trial_id long, log_z array<double>")


def recipe_posteriors(ticks: DataFrame, models: list[Model], log_pi: list[float]) -> DataFrame:
    """trial_id, r_hat, rho (posterior of each recipe) and the trial's log likelihood under the mixture."""
    weighted = F.zip_with("log_z", F.array(*map(F.lit, log_pi)), lambda z, w: z + w)
    rows = log_likelihoods(ticks, models).withColumn("w", weighted).withColumn("top", F.array_max("w"))
    total = F.col("top") + F.log(F.aggregate(F.transform("w", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, b: a + b))
    rows = rows.withColumn("log_likelihood", total)
    return rows.select("trial_id", (F.array_position("w", F.col("top")) - 1).cast("int").alias("r_hat"), F.transform("w", lambda x: F.exp(x - F.col("log_likelihood"))).alias("rho"), "log_likelihood")
