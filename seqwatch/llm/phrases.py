"""Collocations by suffix sorting: f of every phrase of up to four words, from one shuffle of truncated suffixes.

Every word of a piece of text starts a suffix of at most four words. Suffixes go to tasks by language and first word,
equal ones of a batch as one line with a count; in a task they are sorted in descending order, and one stack counts all
their prefixes. A first word that would outweigh a task is dealt by its first two words, such a pair by three: its
own count is told beside them, summed over a batch first. Scores and tests of phrases inside longer ones are joins of these counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqwatch.llm.shared import slices, written

MAX_WORDS = 4
LEAST_COUNT = 30
TOP = 2000
#: A candidate goes if a longer one around it has this percentage of its count.
REDUNDANT_PERCENT = 80
SCALE = 2_000_000
UNKNOWN = "und"
#: Words that a task combines at a time, and bytes of text for one task after the shuffle.
BATCH_WORDS = 500_000
TASK_BYTES = 1 << 24
#: A prefix is hot if it has more than this part of a task's even share of words.
KEYS_OF_TASK = 4
#: Partial tops of a language, so that no task sees all its candidates.
TOP_PARTS = 64

#: Marks that can't occur in UTF-8: between pieces, and before a count.
_END, _COUNT = b"\xff", b"\xfe"
_TABLE = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Ids(dict):
    """Numbers of words in the order in which they are met; the mark between pieces is 0."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word):
        self[word] = len(self)
        return self[word]


def _word_batches(batches, most: int):
    """(language, words in byte order, ranks from 1 with 0 between pieces) of up to about `most` words at a time."""
    held: dict[str, tuple[_Ids, list]] = {}
    size = 0

    def flush():
        for lang, (ids, parts) in held.items():
            words = sorted(ids)
            words.remove(_END)
            rank = np.zeros(len(ids), np.int64)
            rank[[ids[w] for w in words]] = np.arange(1, len(words) + 1)
            yield lang, words, rank[np.concatenate(parts)]
        held.clear()

    for batch in slices(batches):
        texts: dict[str, list] = {}
        for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True):
            texts.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
        for lang, some in texts.items():
            tokens = (_END.join(some) + _END).translate(_TABLE).replace(_END, b" \xff ").split()
            ids, parts = held.setdefault(lang, (_Ids(), []))
            parts.append(np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens)))
            size += len(tokens)
        if size >= most:
            yield from flush()
            size = 0
    yield from flush()


def _suffixes(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes of up to four words as rows of ranks (0: none) in ascending order, and their counts."""
    padded = np.concatenate([ranks, np.zeros(MAX_WORDS, np.int64)])
    rows = [ranks]
    for k in range(1, MAX_WORDS):
        rows.append(np.where(rows[-1] > 0, padded[k : k + len(ranks)], 0))
    solid = ranks > 0
    high, low = ((rows[a][solid] << 32) | rows[a + 1][solid] for a in (0, 2))
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(high) else np.empty(0, np.int64)
    counts = np.diff(np.append(first, len(high)))
    high, low = high[first], low[first]
    return np.stack([high >> 32, high & 0xFFFFFFFF, low >> 32, low & 0xFFFFFFFF], axis=1), counts


def _heavy(batches, share: float):
    """(language, phrase, n) of the prefixes of up to three words with at least half of `share` of a batch's words.

    The empty phrase has the words of the language in this batch.
    """
    import pyarrow as pa

    out: list[tuple] = []
    for lang, words, ranks in _word_batches(batches, 2 * BATCH_WORDS):
        n = int((ranks > 0).sum())
        out.append((lang, b"", n))
        least = max(1, share * n / 2)
        padded = np.concatenate([ranks, np.zeros(MAX_WORDS, np.int64)])
        at = np.flatnonzero(ranks > 0)
        prefix, names = np.zeros(len(at), np.int64), [b""]
        for k in range(MAX_WORDS - 1):
            keys, inverse, times = np.unique((prefix << 32) | padded[at + k], return_inverse=True, return_counts=True)
            heavy = (times >= least) & ((keys & 0xFFFFFFFF) > 0)
            names = [b" ".join(filter(None, (names[key >> 32], words[(key & 0xFFFFFFFF) - 1]))) for key in keys[heavy].tolist()]
            out += [(lang, name, t) for name, t in zip(names, times[heavy].tolist(), strict=True)]
            number = np.cumsum(heavy) - 1
            stays = heavy[inverse]
            at, prefix = at[stays], number[inverse[stays]]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["lang", "phrase", "n"])


def _lines(batches, hot: dict[str, set[bytes]]):
    """(language, key, n, lines) of suffixes: key is the shortest prefix that isn't hot, lines have the other words.

    Hot prefixes are told too, with their counts and without lines, as their suffixes have longer keys.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for lang, words, ranks in _word_batches(batches, BATCH_WORDS):
        rows, counts = _suffixes(ranks)
        if not len(rows):
            continue
        depth = np.ones(len(rows), np.int64)
        heard = []
        number = {w: k for k, w in enumerate(words, start=1)}
        for phrase in hot.get(lang, ()):
            parts = [number.get(w) for w in phrase.split(b" ")]
            if None not in parts:
                # rows are sorted by their first words: the phrase's are one slice of each slice
                low, high = 0, len(rows)
                for k, part in enumerate(parts):
                    low, high = low + np.searchsorted(rows[low:high, k], part), low + np.searchsorted(rows[low:high, k], part, "right")
                depth[low:high] = np.maximum(depth[low:high], len(parts) + 1)
                if low < high:
                    heard.append((lang, phrase, int(counts[low:high].sum()), None))
        if heard:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in heard], t) for k, t in enumerate((pa.string(), pa.binary(), pa.int64(), pa.binary()))], names=["lang", "key", "n", "lines"])
            longer = rows[np.arange(len(rows)), depth - 1] > 0  # what is a hot prefix alone has been told
            rows, counts, depth = rows[longer], counts[longer], depth[longer]
            if not len(rows):
                continue
        texts = pa.array([None, *words], pa.binary())
        columns = [texts.take(pa.array(rows[:, k])) for k in range(MAX_WORDS)]
        nothing = pa.nulls(len(rows), pa.binary())
        head = [pc.if_else(pa.array(depth > k), c, nothing) for k, c in enumerate(columns)]
        rest = [pc.if_else(pa.array(depth > k), nothing, c) for k, c in enumerate(columns)]
        # a line without words needs some text: joins of nothing but nulls are not told
        bare = (rows > 0).sum(axis=1) <= depth
        times = pa.array([_COUNT + str(c).encode() if c > 1 else b"" if b else None for c, b in zip(counts.tolist(), bare.tolist(), strict=True)], pa.binary())
        lines = pc.binary_join_element_wise(*rest, times, b" ", null_handling="skip")
        masked = np.where(np.arange(MAX_WORDS) < depth[:, None], rows, 0)
        first = np.flatnonzero(np.concatenate([[True], (masked[1:] != masked[:-1]).any(axis=1) | (depth[1:] != depth[:-1])]))
        keys = pc.binary_join_element_wise(*(h.take(pa.array(first)) for h in head), b" ", null_handling="skip")
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)), pa.int32()), lines), b"\n")
        n = pa.array(np.add.reduceat(counts, first))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), keys, n, joined], names=["lang", "key", "n", "lines"])


def _prefix_counts(rows: list[tuple], emit) -> None:
    """Counts every prefix of the suffixes of some keys, (number of the key, lines), by one stack.

    Calls `emit(number, words after the key, count)` for each prefix with `LEAST_COUNT` or more, the keys themselves not
    among them.
    """
    ids = _Ids()
    text = b" \xff ".join(lines.replace(b"\n", b" \xff ") for _, lines in rows) + b" \xff"
    tokens = text.split()
    x = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
    names = list(ids)
    amount = np.array([int(w[1:]) if w[:1] == _COUNT else 0 for w in names])
    line_of = np.cumsum(x == 0) - (x == 0)
    n_lines = int((x == 0).sum())
    counts = np.ones(n_lines, np.int64)
    counted = amount[x] > 0
    counts[line_of[counted]] = amount[x[counted]]
    ordered = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[ordered] = np.arange(len(names))
    solid = (x > 0) & ~counted
    starts = np.concatenate([[0], np.flatnonzero(x == 0)[:-1] + 1])
    column = np.arange(len(x)) - starts[line_of]
    table = np.full((n_lines, MAX_WORDS), -1, np.int64)
    table[:, 0] = np.repeat([r[0] for r in rows], [r[1].count(b"\n") + 1 for r in rows])
    table[line_of[solid], column[solid] + 1] = rank[x[solid]]
    order = np.lexsort(table.T[::-1])[::-1]
    table, counts = table[order], counts[order]
    same = np.cumprod(table[1:] == table[:-1], axis=1).sum(axis=1)
    depths = (table >= 0).sum(axis=1)
    # words of equal depth are shared only as far as both have them
    shared = np.concatenate([[0], np.minimum(same, np.minimum(depths[1:], depths[:-1]))])
    stack: list[int] = []
    at = 0
    for k, (keep, deep, c) in enumerate(zip(shared.tolist(), depths.tolist(), counts.tolist(), strict=True)):
        while len(stack) > keep:
            total = stack.pop()
            if stack:
                stack[-1] += total
                if total >= LEAST_COUNT:
                    emit(int(table[at, 0]), [names[ordered[r]] for r in table[at, 1 : len(stack) + 1].tolist()], total)
        while len(stack) < deep:
            stack.append(0)
        stack[-1] += c
        at = k
    while stack:
        total = stack.pop()
        if stack:
            stack[-1] += total
            if total >= LEAST_COUNT:
                emit(int(table[at, 0]), [names[ordered[r]] for r in table[at, 1 : len(stack) + 1].tolist()], total)


def _counted(batches):
    """(language, phrase, words, f) of frequent phrases, from lines in the order of their keys."""
    import pyarrow as pa
    import pyarrow.compute as pc

    out: list[tuple] = []
    keys: list[tuple] = []
    rows: list[tuple] = []

    def ended(lang, key, total, lines):
        """Tells a whole key; its lines wait, as they may hold longer phrases."""
        if total < LEAST_COUNT:
            return 0
        out.append((lang, key, total))
        rows.extend((len(keys), x) for x in lines if x is not None)
        keys.append((lang, key))
        return total

    def told():
        def emit(number, words, total):
            lang, key = keys[number]
            out.append((lang, b" ".join([key, *words]), total))

        if rows:
            _prefix_counts(rows, emit)
        made = pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.string()), pa.array([x[1].decode("utf-8", "surrogatepass") for x in out], pa.string()), pa.array([x[1].count(b" ") + 1 for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64())],
            names=["lang", "phrase", "words", "f"],
        )
        for waiting in (out, keys, rows):
            waiting.clear()
        return made

    held, size = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, key, lines = (batch.column(c) for c in ("lang", "key", "lines"))
        n = batch.column("n").to_numpy()
        same = pc.and_(pc.equal(key[1:], key[:-1]), pc.equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False).astype(bool)
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
        stops = np.append(starts[1:], batch.num_rows)
        totals = np.add.reduceat(n, starts)
        first = 0
        if held and held[:2] == (lang[0].as_py(), key[0].as_py()):
            held = (*held[:2], held[2] + int(totals[0]), held[3] + lines[: stops[0]].to_pylist())
            first = 1
        if first < len(starts):
            if held:
                size += ended(*held)
            for k in (first + np.flatnonzero(totals[first:-1] >= LEAST_COUNT)).tolist():
                size += ended(lang[starts[k]].as_py(), key[starts[k]].as_py(), int(totals[k]), lines[starts[k] : stops[k]].to_pylist())
            held = (lang[starts[-1]].as_py(), key[starts[-1]].as_py(), int(totals[-1]), lines[starts[-1] :].to_pylist())
        if size >= BATCH_WORDS:
            yield told()
            size = 0
    if held:
        ended(*held)
    yield told()


def phrase_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of one to four words with f of `LEAST_COUNT` or more; (lang, n) of words."""
    spark = docs.sparkSession
    texts = docs.filter("text IS NOT NULL").select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    share = 1 / (KEYS_OF_TASK * tasks)
    heavy = written(texts.mapInArrow(lambda b: _heavy(b, share), "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "heavy")
    lengths = heavy.filter(F.octet_length("phrase") == 0).select("lang", "n")
    all_words = lengths.agg(F.sum("n")).first()[0] or 0
    hot: dict[str, set[bytes]] = {}
    # each has share / 2 of all words or more, so of each length there are 2 / share at most, whatever the input
    for row in heavy.filter((F.octet_length("phrase") > 0) & (F.col("n") >= share * all_words / 2)).collect():
        hot.setdefault(row["lang"], set()).add(bytes(row["phrase"]))
    lines = texts.mapInArrow(lambda b: _lines(b, hot), "lang string, key binary, n long, lines binary")
    dealt = lines.repartition(tasks, "lang", "key").sortWithinPartitions("lang", "key")
    return dealt.mapInArrow(_counted, "lang string, phrase string, words int, f long"), lengths


def collocations(docs: DataFrame) -> DataFrame:
    """The first `TOP` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A null lang is `und`, null texts are empty; languages without candidates have no rows; repeated rows count each, other
    columns are ignored, and no documents give no rows. Ties in score and count go by the bytes of the phrase.
    """
    counts, lengths = phrase_counts(docs)
    counts = written(counts, "phrases")
    split = F.split("phrase", " ")
    candidates = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), split.alias("w"))

    def part(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    k = F.col("k")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select("lang", "phrase", "words", "a", "k", part(F.lit(1), k).alias("left"), part(k + 1, F.col("words") - k).alias("right"))
    lefts = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    score = F.expr(f"CAST(CAST({SCALE} AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + r) AS BIGINT)")
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.*")
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> array_join(slice(w, s, m), ' '))))")
    around = candidates.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {REDUNDANT_PERCENT} * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)))
    parts = parts.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= TOP)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= TOP)
    return ranked.join(lengths, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
