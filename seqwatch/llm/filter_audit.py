"""How five filters interact: every order of them, from counts of failure masks times fixed integer matrices.

A document's failures are five bits. Whatever the order, what becomes of it follows from its mask, so a part of the
corpus is three rows of 32 counts (all documents, good ones, toxic ones). Each of the 120 orders has five steps: a
matrix of 32 masks by 600 steps tells which masks a step keeps, removes, finds removed already, or fails alone.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwatch.llm.shared import words_of

#: The filters, in the order of their bits.
LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITAL_PERCENT = 2
ODD_SIGNS = "#$%&*|"

AUDIT_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


@cache
def step_matrices() -> tuple[list[tuple[str, int, int]], dict[str, np.ndarray]]:
    """The 600 (order, step, bit) and, for each outcome, the matrix of masks by steps that holds 1 where it is the mask's."""
    steps = [("".join(LETTERS[b] for b in order), k + 1, order[k], sum(1 << b for b in order[:k])) for order in permutations(range(len(LETTERS))) for k in range(len(LETTERS))]
    masks = np.arange(MASKS)[:, None]
    own = np.array([1 << bit for _, _, bit, _ in steps])
    earlier = np.array([was for *_, was in steps])
    gone, fails = (masks & earlier) != 0, (masks & own) != 0
    outcomes = {"kept": ~gone & ~fails, "removed": ~gone & fails, "redundant": gone & fails, "unique_fails": masks == own}
    return [(order, step, bit) for order, step, bit, _ in steps], {name: m.astype(np.int64) for name, m in outcomes.items()}


def text_failures(text: Column) -> Column:
    """The bits of the filters that a text alone decides, A to D; a null text is empty."""
    body = F.coalesce(text, F.lit(""))
    words = words_of(body)
    n = F.size(words)
    capitals = F.length(body) - F.length(F.regexp_replace(body, "[A-Z]+", ""))
    failed = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n,
        100 * capitals > MOST_CAPITAL_PERCENT * F.length(body),
        body.rlike(f"[{ODD_SIGNS}]"),
    ]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each source with each failure mask.

    Equal texts share one least doc_id; only rows with a greater id fail E, so rows with a null id neither fail it nor
    make others fail. A document is good or toxic if any of its labels says so.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(F.col("text")).alias("alone"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "is_good"), ("toxic", "is_toxic"))))
    repeats = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 1 << 4).otherwise(0)
    return (
        rows.join(first, ["digest", "doc_id"], "left")
        .join(marks, "doc_id", "left")
        .groupBy("part", (F.col("alone") + repeats).alias("mask"))
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("is_good"), F.lit(0)).alias("good"), F.coalesce(F.sum("is_toxic"), F.lit(0)).alias("toxic"))
    )


def _multiplied(batches):
    """The 600 steps of each part, from its three rows of counts by mask."""
    import pyarrow as pa

    steps, outcomes = step_matrices()
    orders, numbers, bits = zip(*steps, strict=True)
    bits = np.array(bits)
    own = (bits[:, None] == np.arange(len(LETTERS))).astype(np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.zeros((3, MASKS), np.int64)
            for cell in row["cells"]:
                counts[:, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
            told = {name: counts[0] @ m for name, m in outcomes.items()}
            lost = counts[1:] @ outcomes["removed"]
            shapley = (told["removed"] @ own)[bits]
            columns = [[row["part"]] * len(steps), list(orders), pa.array(numbers, pa.int32()), told["kept"], told["removed"], told["redundant"], told["unique_fails"], *lost, shapley]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[f.split()[0] for f in AUDIT_SCHEMA.split(", ")])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, with the counts of what the step does.

    Null sources are the empty part, and null texts empty; repeated rows count each; documents without labels, or with
    null ones, are neither good nor toxic; other columns are ignored; no documents give no rows.
    """
    cells = failure_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(_multiplied, AUDIT_SCHEMA)
