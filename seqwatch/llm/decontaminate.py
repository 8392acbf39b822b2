"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of Hamming blocks, exact weighted similarity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwatch.llm.shared import IS_MARK, mix64, slices, window_hashes, word_hashes, written

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints have 16 blocks of 16 bits. Two within 47 bits agree in some block but for 2 bits; the index holds each
#: block of an item and its neighbours of 1 bit, and is asked for each block of a window and its neighbours of 1 bit.
BITS, BLOCKS, RADIUS = 256, 16, 47
#: Hashed counters of the items' shingles, over the whole benchmark.
DF_BUCKETS = 1 << 20
#: The benchmark is taken in blocks of about so many items, one after another.
BLOCK_ITEMS = 20_000
#: Shingles of items around which a document's windows are made at a time.
ANCHORS = 256
_FLIPS = np.concatenate([[0], 1 << np.arange(16)]).astype(np.int64)
_SEEDS = np.arange(BITS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the lower-case runs of letters and digits: case and marks don't hide a passage."""
    return word_hashes(text.lower() if text else text, IS_MARK)


def bit_sums(words: np.ndarray) -> np.ndarray:
    """Running sums over the words of +1 or -1 for each bit of their hashes; row i has the sums of the first i words."""
    bits = np.unpackbits(mix64(words[:, None] + _SEEDS).view(np.uint8), axis=1).astype(np.int32) * 2 - 1
    return np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def fingerprints(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """One row of 64-bit integers for each window."""
    return np.packbits(sums[starts + size] - sums[starts] > 0, axis=1).view(np.uint64)


def block_places(prints: np.ndarray) -> np.ndarray:
    """(fingerprint, place) of each block of each fingerprint and of its neighbours of 1 bit, in the table of all blocks."""
    values = prints.view(np.uint16).astype(np.int64)
    return ((np.arange(BLOCKS)[:, None] << 16) + (values[:, :, None] ^ _FLIPS)).reshape(len(prints), -1)


def expanded(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of many ranges in turn."""
    return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


@dataclass
class Weights:
    """Weights of shingles by how many items of the whole benchmark have them, in hashed counters of fixed number."""

    items: int
    df: np.ndarray

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return np.log1p(self.items / np.maximum(1, self.df[(hashes % np.uint64(DF_BUCKETS)).astype(np.int64)]))


@dataclass
class Index:
    """A block of benchmark items: ids, sizes in words, fingerprints with their multi-index, and weighted shingles."""

    ids: list
    sizes: np.ndarray
    prints: np.ndarray
    first: np.ndarray  # where the items of each place of `block_places` begin
    members: np.ndarray
    shingles: list[tuple[np.ndarray, np.ndarray]]  # sorted hashes and counts of each item
    known: dict[int, np.ndarray]  # length of a shingle -> sorted hashes of the items' shingles
    owner_sizes: dict[int, tuple[np.ndarray, np.ndarray]]  # of each known shingle: where its items' sizes begin, and the sizes
    weight: Weights

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of the shingles, with their counts; rarer shingles of the benchmark weigh more."""
        mine, n = self.shingles[item]
        theirs, m = np.unique(window, return_counts=True)
        both = np.union1d(mine, theirs)
        a, b = np.zeros(len(both)), np.zeros(len(both))
        a[np.searchsorted(both, mine)] = n
        b[np.searchsorted(both, theirs)] = m
        w = self.weight(both)
        return float((np.minimum(a, b) * w).sum() / (np.maximum(a, b) * w).sum())

    def near(self, prints: np.ndarray, sizes: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items of these sizes within the radius, by the multi-index."""
        places = block_places(prints)
        begin = self.first[places]
        n = self.first[places + 1] - begin
        window = np.repeat(np.arange(len(prints)), n.sum(1))
        item = self.members[expanded(begin.ravel(), n.ravel())]
        ok = np.isin(self.sizes[item], [*sizes])
        pairs = np.unique(window[ok] * len(self.ids) + item[ok])
        window, item = pairs // len(self.ids), pairs % len(self.ids)
        ok = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1) <= RADIUS
        return window[ok], item[ok]


def item_weights(items: DataFrame) -> Weights:
    """Counts of the items' shingles over the whole benchmark; at most DF_BUCKETS sums reach the driver."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            sets = [x for x in (np.unique(window_hashes(words_of(t), SHINGLE)) for t in b.column("text").to_pylist()) if len(x)]
            at, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]) % np.uint64(DF_BUCKETS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at.astype(np.int64)], pa.int64()), pa.array([len(sets), *n], pa.int64())], names=["place", "n"])

    rows = items.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DF_BUCKETS, np.int32)
    counted = rows[rows["place"] >= 0]
    df[counted["place"].to_numpy(np.int64)] = counted["n"].to_numpy()
    return Weights(int(rows.loc[rows["place"] < 0, "n"].sum()), df)


def build_index(items: list[tuple], weight: Weights | None = None) -> Index | None:
    rows = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if len(w)]
    if not rows:
        return None
    sizes = np.array([len(w) for _, w in rows])
    prints = np.concatenate([fingerprints(bit_sums(w), np.zeros(1, np.int64), len(w)) for _, w in rows])
    places = block_places(prints)
    members = np.argsort(places.ravel(), kind="stable") // places.shape[1]
    first = np.concatenate([[0], np.cumsum(np.bincount(places.ravel(), minlength=BLOCKS << 16))])
    shingles = [np.unique(window_hashes(w, SHINGLE), return_counts=True) for _, w in rows]
    if weight is None:
        df = np.zeros(DF_BUCKETS, np.int32)
        for x, _ in shingles:
            df[(x % np.uint64(DF_BUCKETS)).astype(np.int64)] += 1
        weight = Weights(len(rows), df)
    known, owner_sizes = {}, {}
    for length in sorted({min(SHINGLE, int(n)) for n in sizes}):
        own = np.flatnonzero(np.minimum(sizes, SHINGLE) == length)
        every, of = np.concatenate([shingles[i][0] for i in own]), np.repeat(own, [len(shingles[i][0]) for i in own])
        known[length], df = np.unique(every, return_counts=True)
        owner_sizes[length] = np.concatenate([[0], np.cumsum(df)]), sizes[of[np.argsort(every, kind="stable")]]
    return Index([i for i, _ in rows], sizes, prints, first.astype(np.int32), members.astype(np.int32), shingles, known, owner_sizes, weight)


def leaks(text: str | None, index: Index, similarity: float = SIMILARITY) -> list[tuple]:
    """(item id, first word, words, similarity, windows) of each item that a text contains; the best window of each.

    A window without any shingle of the benchmark has similarity 0, so only windows around such shingles, of the sizes
    of the items that have them, are made. A text shorter than an item is one window for it.
    """
    words = words_of(text)
    best: dict[int, list] = {}
    for length, known in index.known.items():
        if len(words) < length:
            continue
        hashes = window_hashes(words, length)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        anchors = np.flatnonzero(known[at] == hashes)
        first, of_size = index.owner_sizes[length]
        for part in np.split(anchors, np.arange(ANCHORS, len(anchors), ANCHORS)) if len(anchors) else ():
            reach = int(of_size.max())
            for near in np.split(part, np.flatnonzero(np.diff(part) > 2 * reach) + 1):
                low = max(0, int(near[0]) + length - reach)
                high = min(len(words), int(near[-1]) + reach)
                sums = bit_sums(words[low:high])
                held = np.unique(at[near])
                sizes = np.unique(of_size[expanded(first[held], first[held + 1] - first[held])])
                fits = np.minimum(sizes, len(words))
                for size in np.unique(fits).tolist():
                    mark = np.zeros(high - low + 2, np.int32)  # starts whose window holds one of these shingles whole
                    np.add.at(mark, np.maximum(0, near - low + length - size), 1)
                    np.add.at(mark, near - low + 1, -1)
                    starts = np.flatnonzero(np.cumsum(mark) > 0)
                    starts = starts[starts + size <= high - low]
                    if not len(starts):
                        continue
                    for s, item in zip(*index.near(fingerprints(sums, starts, size), {*sizes[fits == size].tolist()})):
                        start = int(starts[s]) + low
                        value = index.similarity(int(item), hashes[start : start + size - length + 1])
                        if value >= similarity:
                            b = best.setdefault(int(item), [start, size, value, set()])
                            b[3].add(start)
                            if (value, -start) > (b[2], -b[0]):
                                b[:3] = [start, size, value]
    return [(index.ids[i], *b[:3], len(b[3])) for i, b in sorted(best.items())]


def item_blocks(items: DataFrame) -> Iterator[tuple[Index, bool]]:
    """Indexes of blocks of the benchmark, and whether there are others; the blocks are parted by a hash of the item.

    One index at a time is built and held; weights come from the whole benchmark, so that no result depends on blocks.
    """
    n = max(1, -(-items.count() // BLOCK_ITEMS))
    weight = item_weights(items)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "text").orderBy("item_id", "text").collect()
        index = build_index([(r["item_id"], r["text"]) for r in rows], weight)
        if index:
            yield index, n > 1


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, start_word, n_words, similarity, windows.

    The best window of each pair is told, the first of equal ones. A map over rows for each block of items; nothing is
    shuffled. Null and empty texts contain nothing; items without words match nothing; repeated items and repeated rows
    are each reported; an empty table on either side gives no rows. Other columns, whatever their names, are ignored.
    The windows of a very long text are made around its shared shingles, a bounded number at a time.
    """
    spark, names = docs.sparkSession, ("item_id", "start_word", "n_words", "similarity", "windows")
    schema = "doc_id long, item_id long, start_word int, n_words int, similarity double, windows int"
    out = spark.createDataFrame([], schema)
    for index, several in item_blocks(items):
        shared = spark.sparkContext.broadcast(index)  # BLOCK_ITEMS items at most, about

        def run(batches, shared=shared):
            import pyarrow as pa

            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
            for b in slices(batches):
                found = [(d, *x) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for x in leaks(t, shared.value, similarity)]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=["doc_id", *names])

        rows = docs.select("doc_id", "text").mapInArrow(run, schema)
        if not several:
            return rows
        out = out.unionByName(written(rows, "leaks"))
        shared.destroy()
    return out


def decontaminate(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents in which no benchmark item was found, with their columns, whatever their names.

    The same odd input as in `find_leaks`: null and empty texts and repeated rows stay unless they hold an item.
    """
    for index, several in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # BLOCK_ITEMS items at most, about

        def run(batches, shared=shared):
            import pyarrow as pa

            for b in slices(batches):
                yield b.filter(pa.array([not leaks(t, shared.value, similarity) for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if several:
            docs = written(docs, "clean")
            shared.destroy()
    return docs
