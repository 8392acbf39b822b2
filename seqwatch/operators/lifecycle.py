"""A frozen model and its live copy: bounded updates by confirmations, consolidation, drift of durations."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DELTA, MOST = 1.0, 5.0


def confirmed(model: DataFrame, events: DataFrame, delta: float = DELTA, most: float = MOST) -> DataFrame:
    """(state, token, frozen, live) after all events (state, token, outcome).

    Each preference raises its live count by `delta`, up to `most` above the frozen one; the order of events doesn't
    matter, so one grouped count does. Breakdowns are recorded elsewhere and change nothing; other outcomes fail.
    """
    known = F.when(F.col("outcome").isin("preference", "breakdown"), F.col("outcome")).otherwise(F.raise_error(F.concat(F.lit("unknown outcome "), F.coalesce("outcome", F.lit("null")))))
    bumps = events.withColumn("outcome", known).filter("outcome = 'preference'").groupBy("state", "token").agg(F.count("*").alias("bumps"))
    rows = model.join(bumps, ["state", "token"], "left")
    raised = F.greatest(F.col("live"), F.least(F.col("live") + delta * F.col("bumps"), F.col("frozen") + most))
    return rows.select("state", "token", "frozen", F.when(F.col("bumps").isNull(), F.col("live")).otherwise(raised).alias("live"))


def consolidated(model: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """The live counts become the frozen ones, all or those of approved cells; live starts anew from them."""
    if approved is None:
        frozen = model.withColumn("frozen", F.col("live"))
    else:
        rows = model.join(approved.select("state", "token", F.lit(True).alias("ok")).distinct(), ["state", "token"], "left")
        frozen = rows.withColumn("frozen", F.when(F.col("ok"), F.col("live")).otherwise(F.col("frozen"))).drop("ok")
    return frozen.select("state", "token", "frozen", F.col("frozen").alias("live"))


def rank_sum_tail(u: float, n: int, m: int, tie_sum: float, tied: bool) -> float:
    """One-sided p of a rank sum statistic u of n against m values; `tie_sum` adds t**3 - t of all groups of t equals.

    Exact for small samples without ties, else normal with corrections for ties and continuity.
    """
    if not n or not m:
        return 1.0
    if min(n, m) <= 8 and not tied:
        ways = {0: {0: 1}}  # by number of x placed: count of arrangements by u
        for k in range(1, n + m + 1):
            ways = {i: _added(ways.get(i, {}), ways.get(i - 1, {}), k - i) for i in range(0, min(n, k) + 1)}
        total = math.comb(n + m, n)
        return sum(c for v, c in ways[n].items() if v >= u) / total
    size = n + m
    var = n * m / 12 * ((size + 1) - tie_sum / (size * (size - 1)))
    if var <= 0:
        return 1.0
    return 0.5 * math.erfc((u - n * m / 2 - 0.5) / math.sqrt(2 * var))


def rank_sum_p(x: list[float], y: list[float]) -> float:
    """One-sided p of x being greater than y."""
    at, u, ties = 0, -len(x) * (len(x) + 1) / 2, 0
    a, b = Counter(x), Counter(y)
    for v in sorted({*a, *b}):
        t = a[v] + b[v]
        u += a[v] * (at + (t + 1) / 2)
        at, ties = at + t, ties + t**3 - t
    return rank_sum_tail(u, len(x), len(y), ties, ties > 0)


def _added(without: dict[int, int], with_one: dict[int, int], below: int) -> dict[int, int]:
    out = dict(without)
    for v, c in with_one.items():
        out[v + below] = out.get(v + below, 0) + c
    return out


def duration_drift(recent: DataFrame, frozen: DataFrame, least_n: int = 5, least_delta: float = 2.0, alpha: float = 0.05) -> DataFrame:
    """By state: counts, means, their difference, p of the rank sum test in its direction, and whether to report it.

    Last segments are still open and don't count. Durations are counted first; ranks, rank sums and ties come from
    cumulative counts over the distinct durations of a state, so only one row a state reaches Python.
    """
    rows = recent.filter("not is_last").select("state", "duration", F.lit(1).alias("new")).unionByName(frozen.filter("not is_last").select("state", "duration", F.lit(0).alias("new")))
    counted = rows.groupBy("state", F.col("duration").cast("double").alias("d")).agg(F.sum("new").cast("double").alias("x"), F.sum(1 - F.col("new")).cast("double").alias("y"))
    t = F.col("x") + F.col("y")
    before = F.coalesce(F.sum(t).over(Window.partitionBy("state").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranks = counted.withColumn("rank", before + (t + 1) / 2)
    sums = ranks.groupBy("state").agg(
        F.sum("x").cast("int").alias("n_recent"), F.sum("y").cast("int").alias("n_frozen"), (F.sum(F.col("x") * F.col("d")) / F.nullif(F.sum("x"), F.lit(0.0))).alias("mean_recent"),
        (F.sum(F.col("y") * F.col("d")) / F.nullif(F.sum("y"), F.lit(0.0))).alias("mean_frozen"), F.sum(F.col("x") * F.col("rank")).alias("rx"), F.sum(F.col("y") * F.col("rank")).alias("ry"), F.sum(t * t * t - t).alias("ties"),
    )
    sums = sums.withColumn("delta", F.col("mean_recent") - F.col("mean_frozen"))

    @F.udf("double")
    def p_of(delta, n, m, rx, ry, ties):
        up = delta is None or delta >= 0
        a, b, r = (n, m, rx) if up else (m, n, ry)
        return rank_sum_tail(r - a * (a + 1) / 2, a, b, ties, ties > 0)

    out = sums.withColumn("p", p_of("delta", "n_recent", "n_frozen", "rx", "ry", "ties"))
    report = (F.col("n_recent") >= least_n) & (F.col("n_frozen") >= least_n) & (F.abs("delta") >= least_delta) & (F.col("p") < alpha)
    return out.select("state", "n_recent", "n_frozen", "mean_recent", "mean_frozen", "delta", "p", F.coalesce(report, F.lit(False)).alias("reportable"))


def narrated_drift(drift: DataFrame, names: DataFrame, window: str = "this week") -> DataFrame:
    """state, rank, text of the changes to report, the largest first, of equals the smallest state; a row a state at most."""
    order = Window.orderBy(F.desc(F.round(F.abs("delta"), 9)), "state")
    rows = drift.filter("reportable").join(names, "state").withColumn("rank", F.row_number().over(order))
    way = F.when(F.col("delta") > 0, "slower").otherwise("faster")
    text = F.format_string("'%s' goes %s %s: about %d ticks, usually %d (p = %s).", "name", way, F.lit(window), F.round("mean_recent").cast("int"), F.round("mean_frozen").cast("int"), F.format_number("p", 3))
    return rows.select("state", "rank", text.alias("text"))
