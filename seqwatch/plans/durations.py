"""Durations fitted anew on given segments, closed and cut off ones, and their hazards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwatch.functions.special import fit_censored, nb_log_hazard


def refit(segments: DataFrame, d_max: int, by: list[str] = ("recipe", "state")) -> DataFrame:
    """`by`, n_closed, n_open, r, p, mean, log_likelihood (a segment's mean) and hazard, an array by duration from 1 to
    `d_max`: the durations that are likeliest for the segments (`by`, duration, is_last) of each cell.

    A sequence's last segment is open: it lasted its duration at least. So are durations of `d_max` or more. Segments are
    counted by duration before they are shuffled, so a cell is one small histogram whatever its segments, and each is
    fitted by itself. Cells without a closed segment have no fit and no row.
    """
    by = list(by)
    open_ = F.col("is_last") | (F.col("duration") >= d_max)
    counts = segments.groupBy(*by, F.least("duration", F.lit(d_max)).alias("d"), open_.alias("open")).agg(F.count("*").alias("n"))
    closed = counts.filter("NOT open").select(*by).distinct()
    kinds = dict(segments.dtypes)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        tables = np.zeros((2, d_max))
        np.add.at(tables, (rows["open"].astype(int), rows["d"] - 1), rows["n"])
        r, p, value = fit_censored(*tables)
        hazard = np.exp(nb_log_hazard(np.arange(1, d_max + 1), r, p)).tolist()
        return rows[by].head(1).assign(n_closed=int(tables[0].sum()), n_open=int(tables[1].sum()), r=r, p=p, mean=1 + r * (1 - p) / p, log_likelihood=value, hazard=[hazard])

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", n_closed long, n_open long, r double, p double, mean double, log_likelihood double, hazard array<double>"
    return counts.join(closed, by, "left_semi").groupBy(*by).applyInPandas(fit, schema)
