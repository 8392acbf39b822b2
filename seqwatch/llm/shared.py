"""Helpers that the operators of this package share: intermediate tables and word splitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwatch.sources.durable import durable_root, written  # noqa: F401

#: White space between words: the space and the control characters 9 to 13.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def appended(df: DataFrame, path: str) -> DataFrame:
    """The table at `path` with the rows of `df` added, read back."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; an empty array for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def id_bucket(column: str, buckets: int) -> Column:
    """crc32 of the id written as text, modulo `buckets`; the fixed folds of the classifiers."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % buckets


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS = np.ones(1, dtype=np.uint64)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1024) * 2, _BASE, np.uint64))])
    return _POWERS[:n]


#: Bytes that end a word where only letters, digits and bytes above ASCII count.
IS_MARK = np.array([not (chr(b).isalnum() or b > 127) for b in range(256)])


def word_hashes(text: str | None, ends: np.ndarray = _IS_SPACE) -> np.ndarray:
    """A 64-bit hash of each A-Z-lower-cased word of one text, in order; words end at the bytes in `ends`."""
    if not text:
        return np.empty(0, np.uint64)
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    solid = ~ends[raw]
    edges = np.diff(np.concatenate([[False], solid, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    letters = _BYTE_CODES[raw[solid]]
    first = np.cumsum(lengths) - lengths
    letters *= _powers(int(lengths.max()))[np.arange(len(letters)) - np.repeat(first, lengths)]
    return mix64(np.add.reduceat(letters, first) + lengths.astype(np.uint64))


_PLACE = mix64(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)


def window_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A 64-bit hash of each window of `size` words; with fewer words, one hash of the whole sequence."""
    if not len(words):
        return np.empty(0, np.uint64)
    size_here = min(size, len(words))
    out = np.zeros(len(words) - size_here + 1, np.uint64)
    for k in range(size_here):
        out += words[k : k + len(out)] * _PLACE[k]
    return mix64(out + np.uint64(size_here))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    return np.unique(window_hashes(word_hashes(text), size))


def slices(batches):
    """Arrow batches in slices of few rows, so that a task's decoded rows stay few however large its batches are."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def map_columns(df: DataFrame, function, schema: str, columns: list[str]) -> DataFrame:
    """Applies `function(dict of lists) -> dict of lists` to slices of `columns`, in Arrow batches within tasks."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in slices(batches):
            out = function(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in out_schema], schema=out_schema)

    return df.select(*columns).mapInArrow(run, schema)


#: Rows that a Python task holds in decoded form at a time.
SLICE_ROWS = 1000
