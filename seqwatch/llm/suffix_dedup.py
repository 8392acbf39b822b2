"""Removal of long byte strings that occur again anywhere in a corpus, by suffix arrays over shared pieces of texts.

Each window of `SIZE` bytes has the least hash of its byte 16-grams as key; windows that follow each other with one key
are a piece. Equal windows have equal keys, so only pieces whose key occurs again can hold a repeat, and all pieces of a
key meet in one task. There they become one string of phrases, cut where a hash of the next 8 bytes says so. Its suffix
array is built by linear grouping; a window is the bytes up to its first cut and the suffix there, so windows are equal
when those bytes are and no neighbour between their suffixes has a shorter common prefix than the rest of the window.

A key with too many pieces for one task is told anew: its windows get the least hash of their byte 128-grams as key, so
its pieces fall into few shorter ones that agree in 128 bytes, of which those that don't occur again go. Only where even
such a key has too many different pieces do windows go one by one, each under a hash of its own.
"""

from __future__ import annotations

import hashlib
from itertools import groupby
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwatch.llm.shared import _BYTE_CODES, mix64, slices, written
from seqwatch.llm.suffix_array import suffix_array

#: Bytes of a string that is removed where it occurs again.
SIZE = 200
#: Bytes that a key is a hash of, first and where that key has too many pieces, bytes that a cut depends on, and one of how
#: many places is a cut.
KEY_BYTES, LONG_KEY_BYTES, CUT_BYTES, CUT_EVERY = 16, 128, 8, 32
#: Windows of one piece at most; longer pieces are told in several.
MOST_WINDOWS = 4096
#: A key with more occurrences, or more bytes of them, is dealt by longer keys; one of those with more different pieces, or
#: more bytes of them, has its windows dealt one by one, each under a hash of its own.
MOST_OF_KEY, MOST_BYTES_OF_KEY = 65_536, 1 << 22
#: Bytes of pieces in one suffix array, unless one key has more.
BATCH_BYTES = 1 << 20
#: Bytes of pieces and number of places that a task tells at a time, and bytes that it hashes at a time.
TOLD_BYTES, TOLD_PLACES, HASHED_BYTES = 1 << 22, 1 << 16, 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_STEP_INVERSE = np.uint64(pow(int(_STEP), -1, 2**64))


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` bytes in a row, `size` a power of two."""
    x, have = _BYTE_CODES[raw], 1
    while have < size:
        x = x[: len(x) - have] * (_ODD + np.uint64(2 * have)) + x[have:]
        have *= 2
    return mix64(x)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def pieces_of(raw: np.ndarray, size: int = SIZE, key_bytes: int = KEY_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows, 2 if the key may occur again within the text and 1 if not) of a text's pieces."""
    if len(raw) < size:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    grams = gram_hashes(raw, key_bytes)
    width = size - key_bytes + 1
    keys = sliding_least(grams, width)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(starts, len(keys)))
    values = keys[starts]
    # a key that occurs at two places of a text may hold equal windows alone; few keys lie above the bound
    bound = np.uint64(min(2**64 - 1, 2**64 // width * 8))
    low = np.sort(grams[grams < bound])
    again = low[1:][low[1:] == low[:-1]]
    times = np.where((values >= bound) | np.isin(values, again), 2, 1)
    if (counts > MOST_WINDOWS).any():
        parts = -(-counts // MOST_WINDOWS)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + nth * MOST_WINDOWS
        counts = np.minimum(np.repeat(counts, parts) - nth * MOST_WINDOWS, MOST_WINDOWS)
        values, times = np.repeat(values, parts), np.repeat(times, parts)
    return values, starts, counts, times


def repeated_windows(pieces: list[bytes], weights: list[int], size: int = SIZE) -> list[np.ndarray]:
    """For each piece, which of its windows of `size` bytes start at two places or more of all pieces.

    A piece of weight w counts as w copies of itself.
    """
    lengths = np.array([len(p) for p in pieces])
    whole = b"".join(pieces)
    raw = np.frombuffer(whole, np.uint8)
    n = len(raw)
    ends_at = np.cumsum(lengths)
    # arrays over all bytes have four bytes each and live until the cuts are known
    places = np.arange(n, dtype=np.int32)
    left_over = np.repeat(ends_at.astype(np.int32), lengths) - places
    # cuts: where the hash of the next bytes of the piece is a multiple, and where no such place lies in the window
    padded = np.concatenate([raw, np.zeros(CUT_BYTES, np.uint8)])
    marked = left_over >= CUT_BYTES
    for at in range(0, n, HASHED_BYTES):
        marked[at : at + HASHED_BYTES] &= gram_hashes(padded[at : at + HASHED_BYTES + CUT_BYTES - 1], CUT_BYTES)[: n - at] % np.uint64(CUT_EVERY) == 0
    far = np.int32(n + size)
    next_mark = np.where(marked, places, far)
    np.minimum.accumulate(next_mark[::-1], out=next_mark[::-1])
    next_mark[next_mark - places + CUT_BYTES > left_over] = far
    is_window = left_over >= size
    cuts = np.flatnonzero(marked | is_window & (next_mark - places + CUT_BYTES > size))
    owner = np.searchsorted(ends_at, cuts, side="right")
    end = ends_at[owner]
    after = np.append(next_mark, far)[cuts + 1].astype(np.int64)
    after = np.where(after < end, after, n + size)
    phrase_ends = np.minimum(np.minimum(after + CUT_BYTES, cuts + size), end)
    windows = np.flatnonzero(is_window).astype(np.int32)
    del places, left_over, padded, marked, next_mark, is_window, after
    phrases = [whole[a:b] for a, b in zip(cuts.tolist(), phrase_ends.tolist(), strict=True)]
    # letters: an end of its own for each piece, then the phrases in byte order
    ranks = {p: k for k, p in enumerate(sorted(set(phrases)), start=len(pieces))}
    slots = np.arange(len(cuts)) + owner
    letters = np.empty(len(cuts) + len(pieces), np.int64)
    letters[np.searchsorted(cuts, ends_at) + np.arange(len(pieces))] = np.arange(len(pieces))
    letters[slots] = [ranks[p] for p in phrases]
    del phrases, ranks
    cut_of = np.full(len(letters), -1)
    cut_of[slots] = np.arange(len(cuts))
    sorted_cuts = cut_of[suffix_array(letters)]
    sorted_cuts = sorted_cuts[sorted_cuts >= 0]
    rank_of = np.empty(len(cuts), np.int64)
    rank_of[sorted_cuts] = np.arange(len(cuts))
    shared = _common_prefixes(raw, cuts[sorted_cuts], end[sorted_cuts], size)
    # windows by the distance to their first cut: equal when the bytes before it are and the suffixes share the rest
    cut = np.searchsorted(cuts, windows).astype(np.int32)
    distance = (cuts[cut] - windows).astype(np.uint16)
    left = _left_hashes(raw, windows, distance, size)
    heavy = np.array(weights, np.int64)
    of_window = np.searchsorted(ends_at, windows, side="right").astype(np.int32)
    by_distance = np.argsort(distance, kind="stable").astype(np.int32)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(distance, minlength=size))])
    again = np.zeros(len(windows), bool)
    for j in np.flatnonzero(np.diff(bounds)):
        here = by_distance[bounds[j] : bounds[j + 1]]
        classes = np.cumsum(shared < size - j)[rank_of[cut[here]]].astype(np.uint64)
        keys = mix64(left[here] + classes * _ODD)
        order = np.argsort(keys)
        first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
        total = np.add.reduceat(heavy[of_window[here]][order], first)
        again[here[order]] = np.repeat(total, np.diff(np.append(first, len(here)))) > 1
    return np.split(again, np.searchsorted(windows, ends_at[:-1]))


def _left_hashes(raw: np.ndarray, windows: np.ndarray, distance: np.ndarray, size: int) -> np.ndarray:
    """For each window, in ascending order, a hash of its first `distance` bytes."""
    out = np.empty(len(windows), np.uint64)
    span = HASHED_BYTES + size
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(span - 1, _STEP)]))
    inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(span - 1, _STEP_INVERSE)]))
    for at in range(0, len(raw), HASHED_BYTES):
        a, b = np.searchsorted(windows, [at, at + HASHED_BYTES])
        codes = _BYTE_CODES[raw[at : at + span]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[: len(codes)])])
        first = windows[a:b] - at
        out[a:b] = mix64((sums[first + distance[a:b]] - sums[first]) * inverse[first])
    return out


def _common_prefixes(raw: np.ndarray, at: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """For each place but the first, how many bytes it shares with the place before, `size` at most; 0 for the first."""
    out = np.zeros(len(at), np.int64)
    padded = np.concatenate([raw, np.zeros(size, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, size)
    for k in range(1, len(at), 8192):
        a, b = at[k - 1 : k + 8191], at[k : k + 8192]
        a = a[: len(b)]
        differ = rows[a] != rows[b]
        found = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
        out[k : k + 8192] = np.minimum(found, np.minimum(end[k - 1 : k + 8191][: len(b)] - a, end[k : k + 8192] - b))
    return out


def _pieces(batches):
    """(text, key, first window, windows, times) of each piece, from Arrow batches of (text key, text)."""
    import pyarrow as pa

    for batch in slices(batches):
        of, found = [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            got = pieces_of(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
            of.append(np.full(len(got[0]), k))
            found.append(got)
        if not found:
            continue
        keys, starts, counts, times = (np.concatenate(x) for x in zip(*found, strict=True))
        columns = [batch.column(0).take(pa.array(np.concatenate(of))), pa.array(keys.view(np.int64)), pa.array(starts.astype(np.int64)), pa.array(counts.astype(np.int32)), pa.array(times.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["tid", "key", "start", "windows", "times"])


def _long_keys(batches):
    """(text, longer key, digest, first window, windows, times) of the pieces that each of a text's pieces falls into."""
    import pyarrow as pa

    types = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]

    def told(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["tid", "key", "digest", "start", "windows", "times"])

    for batch in slices(batches):
        out: list[tuple] = []
        for tid, text, copies, found in zip(*(batch.column(c) for c in ("tid", "text", "copies", "found")), strict=True):
            raw, tid, copies = text.as_py().encode("utf-8", "surrogatepass"), tid.as_py(), copies.as_py()
            for at in found.as_py():
                piece = raw[at["start"] : at["start"] + at["windows"] + SIZE - 1]
                keys, starts, counts, times = pieces_of(np.frombuffer(piece, np.uint8), key_bytes=LONG_KEY_BYTES)
                for key, start, count, n in zip(keys.view(np.int64).tolist(), starts.tolist(), counts.tolist(), times.tolist(), strict=True):
                    out.append((tid, key, _digest(piece[start : start + count + SIZE - 1]), at["start"] + start, count, n * copies))
                if len(out) >= TOLD_PLACES:
                    yield told(out)
                    out = []
        yield told(out)


def _spans(found: list[dict], raw: bytes):
    """(first window, key or None where it is the digest's, bytes) of what a text tells; of hot keys each window alone."""
    for at in found:
        if not at["hot"]:
            yield at["start"], at["key"], raw[at["start"] : at["start"] + at["windows"] + SIZE - 1]
            continue
        for begin in range(at["start"], at["start"] + at["windows"]):
            yield begin, None, raw[begin : begin + SIZE]


def _digest(piece: bytes) -> bytes:
    return hashlib.md5(piece, usedforsecurity=False).digest()


def _cut(batches):
    """(key, digest, bytes, weight) of the pieces of some texts, equal ones combined."""
    import pyarrow as pa

    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64()]

    def told(found):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found.values()], t) for k, t in enumerate(types)], names=["key", "digest", "piece", "weight"])

    for batch in slices(batches):
        found: dict[bytes, list] = {}
        size = 0
        for text, copies, spans in zip(*(batch.column(c) for c in ("text", "copies", "found")), strict=True):
            for _, key, piece in _spans(spans.as_py(), text.as_py().encode("utf-8", "surrogatepass")):
                digest = _digest(piece)
                held = found.get(digest)
                if held:
                    held[3] += copies.as_py()
                    continue
                found[digest] = [int.from_bytes(digest[:8], "little", signed=True) if key is None else key, digest, piece, copies.as_py()]
                size += len(piece)
                if size > TOLD_BYTES:
                    yield told(found)
                    found, size = {}, 0
        yield told(found)


def _places(batches):
    """(text, first window, digest) of each piece."""
    import pyarrow as pa

    types = [pa.binary(), pa.int64(), pa.binary()]

    def told(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["tid", "start", "digest"])

    for batch in slices(batches):
        out: list[tuple] = []
        for tid, text, spans in zip(*(batch.column(c) for c in ("tid", "text", "found")), strict=True):
            for start, _, piece in _spans(spans.as_py(), text.as_py().encode("utf-8", "surrogatepass")):
                out.append((tid.as_py(), start, _digest(piece)))
                if len(out) >= TOLD_PLACES:
                    yield told(out)
                    out = []
        yield told(out)


def _marks(batches):
    """(digest, packed marks of the repeated windows) of pieces that come by their keys; others have none."""
    import pyarrow as pa

    def solved(rows):
        marks = repeated_windows([r[1] for r in rows], [r[3] for r in rows])
        kept = [(r[2], np.packbits(m, bitorder="little").tobytes()) for r, m in zip(rows, marks, strict=True) if m.any()]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], pa.binary()) for k in (0, 1)], names=["digest", "marks"])

    for rows in piece_batches(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "digest", "weight")), strict=True)):
        yield solved(rows)


def piece_batches(rows, most: int | None = None):
    """Rows (key, piece, ...) that come by their keys, in lists of whole keys: of up to `most` bytes, or of one key."""
    most = BATCH_BYTES if most is None else most
    held, size = [], 0
    for _, group in groupby(rows, key=itemgetter(0)):
        own = list(group)
        own_size = sum(len(r[1]) for r in own)
        if held and size + own_size > most:
            yield held
            held, size = [], 0
        held += own
        size += own_size
    if held:
        yield held


def _kept(batches):
    """(text, removed bytes, runs, digest of what is left) of texts with marked windows."""
    import pyarrow as pa

    for batch in slices(batches):
        out = []
        for row in batch.to_pylist():
            raw = np.frombuffer(row["text"].encode("utf-8", "surrogatepass"), np.uint8)
            starts = np.zeros(len(raw) + 1, np.int32)
            for at in row["found"]:
                bits = np.unpackbits(np.frombuffer(at["marks"], np.uint8), bitorder="little")
                starts[at["start"] + np.flatnonzero(bits)] = 1
            marked = np.cumsum(starts)
            gone = marked[:-1] - np.concatenate([np.zeros(min(SIZE, len(raw)), np.int32), marked[: max(len(raw) - SIZE, 0)]]) > 0
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            left = raw[~gone].tobytes()
            out.append((row["tid"], int(gone.sum()), runs, left, hashlib.sha256(left).hexdigest()))
        types = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["tid", "n_removed", "n_spans", "left", "left_sha"])


def without_repeats(docs: DataFrame, most_of_key: int = MOST_OF_KEY, most_bytes: int = MOST_BYTES_OF_KEY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) of each row; `kept` holds the bytes that are left.

    A byte goes if a string of `SIZE` bytes that covers it starts anywhere else: in another row, equal rows included, or
    elsewhere in its own text. Null texts are empty; texts below `SIZE` bytes lose nothing; every row, repeated ones and
    those with null ids too, gives one row; other columns are ignored; no rows give no rows. Equality of windows rests
    on 64-bit hashes within a task, that of texts and pieces on digests of 128 bits.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = rows.withColumn("tid", F.substring(F.unhex("sha"), 1, 16))
    long = rows.filter(F.col("n_bytes") >= SIZE).select("tid", "text")
    texts = long.groupBy("tid").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    pieces = written(long.mapInArrow(_pieces, "tid binary, key long, start long, windows int, times int"), "pieces")
    hot = (F.count("*") > most_of_key) | (F.sum(F.col("windows") + SIZE - 1) > most_bytes)
    again = pieces.groupBy("key").agg(F.sum("times").alias("times"), hot.alias("hot")).filter("times > 1").select("key", "hot")
    met = pieces.join(again, "key").select("tid", "key", "start", "windows", "hot")
    crowded = met.filter("hot").groupBy("tid").agg(F.collect_set(F.struct("key", "start", "windows", "hot")).alias("found"))
    # here as below all columns of `texts` are taken, so that one shuffle of it serves all
    longer = texts.join(crowded, "tid").select("tid", "text", "copies", "found").mapInArrow(_long_keys, "tid binary, key long, digest binary, start long, windows int, times long")
    distinct = longer.groupBy("key", "digest").agg(F.sum("times").alias("times"), F.first("windows").alias("windows"))
    again = distinct.groupBy("key").agg(F.sum("times").alias("times"), hot.alias("hot")).filter("times > 1").select("key", "hot")
    met = met.filter("not hot").unionByName(longer.join(again, "key").select("tid", "key", "start", "windows", "hot"))
    shared = met.groupBy("tid").agg(F.collect_set(F.struct("key", "start", "windows", "hot")).alias("found"))
    told = texts.join(shared, "tid").select("tid", "text", "copies", "found")
    cut = told.mapInArrow(_cut, "key long, digest binary, piece binary, weight long").repartition("key")
    distinct = cut.groupBy("key", "digest", "piece").agg(F.sum("weight").alias("weight")).sortWithinPartitions("key")
    marks = distinct.mapInArrow(_marks, "digest binary, marks binary")
    places = told.mapInArrow(_places, "tid binary, start long, digest binary")
    found = places.join(marks, "digest").groupBy("tid").agg(F.collect_list(F.struct("start", "marks")).alias("found"))
    kept = texts.join(found, "tid").select("tid", "text", "copies", "found").mapInArrow(_kept, "tid binary, n_removed long, n_spans long, left binary, left_sha string")
    none = F.lit(0).cast("long")
    return rows.join(kept, "tid", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("left", F.encode("text", "UTF-8")).alias("kept"),
        F.coalesce("left_sha", "sha").alias("kept_sha256"),
    )
