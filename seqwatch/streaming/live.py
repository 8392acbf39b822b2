"""Causal operators on streams: session windows of events, and the filter's belief kept as state of each trial."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwatch.functions import kernels
from seqwatch.plans.decode import Model


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session start and end, number of events: a gap ends a trial. Works on streams and on tables."""
    w = F.session_window("ts", gap)
    rows = events.withWatermark("ts", late).groupBy("user_id", w.alias("s")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def live_beliefs(ticks: DataFrame, model: Model, timeout_ms: int | None = 3_600_000) -> DataFrame:
    """trial_id, tick, state (the likeliest before the tick is seen), belief in it, s_emit: on a stream of ticks.

    The state of a trial is the filter's window (durations by states) and its last tick; it goes after the timeout, or never without one.
    Within a micro-batch a trial's ticks are taken in order; a tick that comes after its successors were seen is
    left out, as the filter can't go back.
    """
    shared = ticks.sparkSession.sparkContext.broadcast((model, *model.durations()))
    schema = "trial_id long, tick int, state int, belief double, s_emit double"

    def step(key, batches, state):
        m, pmf, survival = shared.value
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            after, packed = state.get
            window = np.frombuffer(packed).reshape(m.d_max, -1).copy()
        else:
            after, window = -1, kernels.first_window(m.init, m.d_max)
        rows = pd.concat(list(batches)).sort_values("tick")
        out = []
        for tick, v, n in zip(rows["tick"], rows["verb_id"], rows["noun_id"]):
            if tick <= after:
                continue
            look = m.verbs[:, v] + m.nouns[:, n]
            belief, _, _, window = kernels.filter_step(window, look, m.trans, pmf, survival)
            best = int(belief.argmax())
            out.append((key[0], int(tick), best, float(np.exp(belief[best])), float(-kernels.lse(belief + look, 0))))
            after = int(tick)
        state.update((after, window.tobytes()))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["trial_id", "tick", "state", "belief", "s_emit"])

    return ticks.select("trial_id", "tick", "verb_id", "noun_id").groupBy("trial_id").applyInPandasWithState(step, schema, "after int, window binary", "append", "ProcessingTimeTimeout" if timeout_ms else "NoTimeout")
