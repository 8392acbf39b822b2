"""Token-id files: frequency-ranked ids in one to four bytes each, with the lengths in separate control bytes."""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqwatch.llm.shared import durable_root, map_columns, written

END_ID = 2
#: Ids that a block holds at least, unless the file ends; a block holds whole documents.
BLOCK_IDS = 1 << 16
#: Words that a worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 1 << 20, 64
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)
_BYTES = np.arange(4)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (four 2-bit lengths each, lowest bits first) and data bytes of unsigned 32-bit integers."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    quads[: len(ranks)] = extra
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[_BYTES <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse: lengths by lookup of each control byte, then one gather for each byte of a rank."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        here = lengths > k
        out[here] |= raw[starts[here] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def byte_letters() -> list[str]:
    """The character by which a byte-level vocabulary spells each byte: itself if it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class Words(dict):
    """Packed ids of words between white space, by the tokenizers library; what was met before is remembered.

    Such a vocabulary never joins what white space separates, nor letters and the ASCII marks behind them. Words of
    the Latin letters below U+0250 need no normalisation but lower case and go to the library's model at once; all
    other words go through its whole pipeline.
    """

    MARKS = r"""!"#$%&()*+,-./:;<=>?@[]^_`{|}~\\"""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model.tokenize
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = {t.content[0] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.letters = byte_letters()

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        stem = word.rstrip(self.MARKS)
        low = word.lower()
        if len(stem) < len(word) and stem[-1:].lower()[-1:].isalnum() and not self.special & {*word}:
            found = self[stem] + self[word[len(stem) :]]
        elif word.isalpha() and low.isalpha() and max(low) < "\u0250":
            if low == word:
                found = self.packed([t.id for t in self.model(low if low.isascii() else "".join([self.letters[b] for b in low.encode()]))])
            else:
                found = self[low]
        else:
            found = self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= REMEMBERED_CHARS:
            self[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids of one text."""
        return b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def encoder(path: str) -> Words:
    return Words(path)


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, `width` (bytes of an id) and `ids` of every text, the end id last."""

    def encode(rows):
        e = encoder(path)
        end = e.packed([END_ID])
        return {"doc_id": rows["doc_id"], "width": [e.dtype.itemsize] * len(rows["text"]), "ids": [e.encode(t) + end for t in rows["text"]]}

    return map_columns(docs, encode, "doc_id long, width int, ids binary", ["doc_id", "text"])


def rank_table(encoded: DataFrame) -> np.ndarray:
    """The ids in order of falling frequency over all documents, ties by id; as many as the vocabulary has in use."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for b in batches:
            for width in set(b.column("width").to_pylist()):  # one for all rows of a vocabulary
                joined = b"".join(x for w, x in zip(b.column("width").to_pylist(), b.column("ids").to_pylist()) if w == width)
                found = np.bincount(np.frombuffer(joined, f"<u{width}"))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    counts = encoded.select("width", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.collect()  # at most one row for each id of the vocabulary
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def write_token_files(docs: DataFrame, path: str, to: str) -> None:
    """Writes the ids of all documents in ascending doc_id order under the folder `to`.

    `to`/ids holds the table of ids by rank. `to`/blocks holds the files: file f+1 continues file f. Each row is a
    block of whole documents: its place in the file, the ids of the file before it, the documents' ids and lengths,
    control bytes and data bytes. Spark's writer commits them, so a lost executor leaves no partial file.
    """
    spark = docs.sparkSession
    encoded = written(encode_ids(docs, path), "token-ids")
    by_rank = rank_table(encoded)
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(by_rank)], "rank int, id long").write.parquet(f"{to}/ids")
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)  # four bytes for each id of the vocabulary

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        file, block, before = TaskContext.get().partitionId(), 0, 0
        ids, lens, parts, held = [], [], [], 0

        def full():
            control, data = pack(shared.value[np.concatenate(parts)])
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((file, pa.int32()), (block, pa.int32()), (before, pa.int64()), (ids, pa.list_(pa.int64())), (lens, pa.list_(pa.int32())), (control, pa.binary()), (data, pa.binary()))],
                names=["file", "block", "ids_before", "doc_ids", "lengths", "control", "data"],
            )

        for b in batches:
            for doc, width, packed in zip(b.column("doc_id").to_pylist(), b.column("width").to_pylist(), b.column("ids")):
                parts.append(np.frombuffer(packed.as_buffer(), f"<u{width}"))
                ids.append(doc)
                lens.append(len(parts[-1]))
                held += lens[-1]
                if held >= BLOCK_IDS:
                    yield full()
                    block, before = block + 1, before + held
                    ids, lens, parts, held = [], [], [], 0
        if ids:
            yield full()

    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids").asc()]
    ranged = encoded.repartitionByRange(files, *order).sortWithinPartitions(*order)
    ranged.mapInArrow(blocks, "file int, block int, ids_before long, doc_ids array<long>, lengths array<int>, control binary, data binary").write.parquet(f"{to}/blocks")


def read_token_files(spark: SparkSession, of: str) -> DataFrame:
    """One row per document of the files under `of`: doc_id, start (ids of all documents before), n_tokens, ids (uint32)."""
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{of}/ids").orderBy("rank").collect()], np.uint32)
    shared = spark.sparkContext.broadcast(by_rank)
    blocks = spark.read.parquet(f"{of}/blocks")
    in_file = blocks.groupBy("file").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offsets = in_file.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("file_start"))

    def decode(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                ids = shared.value[unpack(row["control"], row["data"], sum(row["lengths"]))]
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["file"]] * len(ends), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["ids_before"], pa.int64()),
                        pa.array(row["lengths"], pa.int64()),
                        pa.array([ids[a:z].astype("<u4").tobytes() for a, z in zip(starts, ends)], pa.binary()),
                    ],
                    names=["file", "doc_id", "start", "n_tokens", "ids"],
                )

    rows = blocks.mapInArrow(decode, "file int, doc_id long, start long, n_tokens long, ids binary")
    return rows.join(F.broadcast(offsets), "file").select("doc_id", (F.col("start") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """Writes the documents' ids to files in the shared folder and reads them back.

    Null and blank texts have the end id only. Documents with equal ids follow each other in the order of a hash of
    their contents; null ids come first. Repeated rows are repeated in the files. A very long text lies whole in one block,
    so in one task. An empty table gives files without blocks and no rows. Other columns of the input are ignored.
    """
    to = f"{durable_root(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, to)
    return read_token_files(docs.sparkSession, to)

