"""A corpus pipeline: language, quality, near copies, benchmark passages, tokens; each stage reads the table before it.

All stages: an empty table gives an empty one; very long texts are read whole; columns beside those of `documents` stay
(not in the last), whatever their names; repeated rows share one fate but for near copies, where one of them stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwatch.llm import bpe, classifier, decontaminate, jaccard, langid
from seqwatch.llm.shared import table, written

#: A document whose letters lie in spans of its main language to a smaller part goes.
LEAST_LANGUAGE_SHARE = 0.4


def with_free_names(docs: DataFrame, names: list[str]) -> tuple[DataFrame, list]:
    """`docs` with those columns renamed that an operator would replace, and what restores them; no new name is in use."""
    end = "__kept"
    while any(c.endswith(end) for c in docs.columns):
        end += "_"
    away = {c: f"{c}{end}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(away), [F.col(away.get(c, c)).alias(c) for c in docs.columns]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters, mostly in one language learned from the labelled documents.

    Null, empty and letterless texts go; so does everything if no document has a language.
    """
    model = langid.fit(langid.training_rows(table(spark, sf_dir, "documents")))
    free, columns = with_free_names(docs, ["lang_pred", "score", "lang_spans"])
    found = langid.identify(free, model)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier predicts to have label 1.

    Null and empty texts go or stay by the score of the bias; without labels every document stays.
    """
    model = classifier.fit(classifier.training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    free, columns = with_free_names(docs, ["score"])
    return classifier.score(free, model).filter(F.col("score") >= classifier.THRESHOLD).select(*columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the smallest doc_id.

    Null and blank texts are in no group and stay.
    """
    return jaccard.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a benchmark passage; null and empty texts, and all if there is no benchmark, stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with checksums of the ids and of the bytes that they decode to; null texts have none."""
    import public_tokenizers

    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n_tokens.alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("jaccard_join", near_copy_stage),
    ("decontamination", benchmark_stage),
    ("byte_bpe", token_stage),
]

#: SQL expresses none of the learned stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
