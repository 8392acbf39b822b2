"""N-gram Jaccard join: documents as points of hashed counts, an R-tree with overlap bounds, exact verification.

Words are lower-cased (A-Z) runs `[^\\x20\\x09-\\x0D]+`; a document's set holds its distinct 5-word shingles as 64-bit
hashes. Two documents link when 100 * intersection >= 80 * union. Documents with equal sets are one point.

Cells bring together the points that can link at all: two sets that similar share one of their first few shingles in
any common order of all shingles (here the rarest first), so the cell of each such shingle misses no link. In the cell
of the first shingle that two sets share they can share no more than what each has from its place on; so of two points
that link, at least one has the shingle within its first ninth (a strong point), and weak points are never paired.

Within the cells of a task, one R-tree over the points' counts by group of hashes finds the pairs: the overlap of a
point and a box is at most the sum of the minima of the counts, and boxes that can't reach the similarity by that, by
their sizes or by their cells are skipped. What passes is held against the parities of counts in many more groups (each
odd difference is a shingle that only one of the two has), and what passes that is verified on the sets.

First each point meets a pivot of one of its cells only, and the pivots of a cell its first one, which finds most links
in large groups of near copies with one pair a point. Cells with points of different components so far are searched,
only for pairs between components: a large cell's points outside its largest component are dealt to chunks that meet
the others. A first search verifies a spanning forest only, at most one pair a point; cells of which pairs were left
out are searched once more, for all pairs between the components that are left. So no link between components is
missed, and yet the pairs that leave a task don't grow with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from seqwatch.llm.components import components
from seqwatch.llm.shared import mix64, shingle_set, slices, written
from seqwatch.sources.durable import data

SHINGLE, PERCENT = 5, 80
#: A shingle that this share of the documents has is common and comes late in the order; those of less than a sixth of
#: it never are. Tasks count in rounds of so many rows, forgetting what can't reach the share.
COMMON_SHARE, MOST_COMMON, COUNTED_ROWS = 0.003, 1 << 16, 2000
#: Groups of the coarse counts, and the fewest of the parities (a power of two from the set's size).
COARSE, FINE = 32, 64
#: Times the set's size: groups of the parities for the last search, of few cells but all their pairs.
FINER = 4
#: Points of a cell that meet one pivot.
PIVOT_ROWS = 1000
#: Cells with more points are dealt to pairs of chunks of about half as many.
CHUNK = 1024
LEAF = 16
#: Pairs of points and boxes that a task holds at a time; while a forest is made, fewer, as each step spares the next.
HELD, HELD_THIN = 1 << 18, 1 << 17
#: Pairs whose counts a task holds at a time, and numbers of parities.
HELD_COUNTS, HELD_PARITIES = 1 << 15, 1 << 19
#: Tasks that the members of one component are dealt to.
SALTS = 16
#: Bits of a rare shingle's key that are left out. Two shingles of one key only make more candidates.
KEY_BITS_OFF = 24
FILTER_BITS = 1 << 23


def counts(tokens: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((tokens >> np.uint64(7)).astype(np.int64) & (groups - 1), minlength=groups)


def parities(tokens: np.ndarray, times: int = 1) -> bytes:
    """One bit for each of many groups of hashes: whether its count is odd. A power of two of groups, from `times` the set's size."""
    groups = max(FINE, 1 << max(0, times * len(tokens) - 1).bit_length())
    return np.packbits(counts(tokens, groups) & 1, bitorder="little").tobytes()


class Parities:
    """The parities of many points, by the length of their grids."""

    def __init__(self, blobs: list[bytes]):
        length = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8
        self.length, self.place, self.tables = length, np.zeros(len(blobs), np.int64), {}
        for size in np.unique(length):
            at = np.flatnonzero(length == size)
            self.place[at] = np.arange(len(at))
            self.tables[int(size)] = np.frombuffer(b"".join([blobs[k] for k in at]), np.uint64).reshape(len(at), size)

    def odd(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Odd differences of pairs; the finer grid of two is folded to the other's."""
        out = np.zeros(len(i), np.int64)
        kinds = self.length[i] << 32 | self.length[j]
        for kind in np.unique(kinds):
            n, m = int(kind) >> 32, int(kind) & 0xFFFFFFFF
            same = np.flatnonzero(kinds == kind)
            for part in np.array_split(same, min(len(same), 1 + len(same) * max(n, m) // HELD_PARITIES)):
                x, y = self.tables[n][self.place[i[part]]], self.tables[m][self.place[j[part]]]
                g = min(n, m)
                x, y = (np.bitwise_xor.reduce(v.reshape(len(v), -1, g), 1) for v in (x, y))
                out[part] = np.bitwise_count(x ^ y).sum(1)
        return out

    def passes(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs may link: at most half of what is left of both sets after the odd differences is shared."""
        return may_link((n + m - self.odd(i, j)) / 2, n, m, percent)


def packed(c: np.ndarray) -> bytes:
    return c.astype(np.uint8 if c.max(initial=0) < 256 else "<u2").tobytes()


def coarse_rows(blobs: list[bytes]) -> np.ndarray:
    """Coarse counts of many points as one array."""
    out = np.empty((len(blobs), COARSE), np.int32)
    wide = np.fromiter((len(b) > COARSE for b in blobs), bool, len(blobs))
    if (~wide).any():
        out[~wide] = np.frombuffer(b"".join(b for b in blobs if len(b) == COARSE), np.uint8).reshape(-1, COARSE)
    if wide.any():
        out[wide] = np.frombuffer(b"".join(b for b in blobs if len(b) > COARSE), "<u2").reshape(-1, COARSE)
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many first shingles of a set of n meet those of every set that is similar enough."""
    return n + 1 - -(-percent * n // 100)


def may_link(overlap, n, m, percent: int = PERCENT):
    """Whether sets of n and m with so large an overlap, or one bounded by it, reach the similarity."""
    return overlap * (100 + percent) >= percent * (n + m)


def strong(place, n, percent: int = PERCENT):
    """Whether a point whose set of n has a cell's shingle at `place` may link with a set as large in that cell."""
    return may_link(n - place, n, n, percent)


class CountTree:
    """A packed R-tree over the points of many cells: boxes of up to 16 points or boxes.

    A box has its largest counts, its range of sizes, the largest overlap that one of its points can have in its cell,
    and its range of cells. Points lie in the order of cells, then sizes, so that boxes are small in all of these.
    """

    def __init__(self, cell: np.ndarray, points: np.ndarray, sizes: np.ndarray, reach: np.ndarray):
        half = points[:, : COARSE // 2].sum(1) - points[:, COARSE // 2 :].sum(1)
        self.order = np.lexsort((points.argmax(1), half, sizes, cell))
        self.cell, self.points, self.sizes, self.reach = (x[self.order] for x in (cell, points, sizes, reach))
        level = (self.points, self.sizes, self.sizes, self.reach, self.cell, self.cell)
        self.levels = [level]
        while len(level[0]) > 1:
            cut = np.arange(0, len(level[0]), LEAF)
            level = tuple(f.reduceat(x, cut) for f, x in zip((np.maximum, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum), level))
            self.levels.append(level)

    def pairs(self, ask: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(asking place, later place in the same cell) of all points whose bounded overlap may reach the similarity."""
        q, at = ask, np.zeros(len(ask), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, most, reach, first, last = self.levels[depth]
            if depth < len(self.levels) - 1:
                q, at = np.repeat(q, LEAF), (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                ok = at < len(high)
                q, at = q[ok], at[ok]
            n, cell = self.sizes[q], self.cell[q]
            ok = ((at + 1) * LEAF**depth - 1 > q) & (first[at] <= cell) & (last[at] >= cell)
            ok &= (most[at] * 100 >= percent * n) & (least[at] * percent <= 100 * n) & may_link(np.minimum(reach[at], self.reach[q]), least[at], n, percent)
            q, at = q[ok], at[ok]
            ok = np.concatenate([np.empty(0, bool), *(may_link(np.minimum(high[at[k]], self.points[q[k]]).sum(1), least[at[k]], self.sizes[q[k]], percent) for k in np.array_split(np.arange(len(q)), 1 + len(q) // HELD_COUNTS))])
            q, at = q[ok], at[ok]
        return q, at


class Labels:
    """Components of the points of many cells while they merge."""

    def __init__(self, cell: np.ndarray, comps: np.ndarray):
        both = np.stack([cell, comps], 1)
        self.of = np.unique(both, axis=0, return_inverse=True)[1].ravel()
        self.parent = np.arange(int(self.of.max(initial=-1)) + 1)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return int(x)

    def joined(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places of the pairs that join what earlier pairs didn't: a spanning forest."""
        pairs, first = np.unique(np.stack([self.of[i], self.of[j]], 1), axis=0, return_index=True)
        keep = []
        for (a, b), k in zip(pairs[np.argsort(first)].tolist(), np.sort(first).tolist()):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                keep.append(k)
        if keep:
            while (self.parent[self.parent] != self.parent).any():
                self.parent = self.parent[self.parent]
            self.of = self.parent[self.of]
        return np.array(keep, np.int64)


def cell_pairs(cell, points, sizes, reach, comps, fine: list[bytes], percent: int, thin: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places in equal cells, of different components, that pass both bounds; with `thin`, a spanning forest
    of them, and the cells of which pairs were left out."""
    tree = CountTree(cell, points, sizes, reach)
    comps, bits = comps[tree.order], Parities([fine[k] for k in tree.order])
    labels = Labels(tree.cell, comps)
    left, right, less = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    rows = np.bincount(tree.cell)[tree.cell]
    for ask in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(np.cumsum(rows) // (HELD_THIN if thin else HELD))) + 1):
        i, j = tree.pairs(ask, percent)
        ok = comps[i] != comps[j]
        i, j = i[ok], j[ok]
        ok = may_link(np.minimum(tree.reach[i], tree.reach[j]), tree.sizes[i], tree.sizes[j], percent)
        if thin:
            known = labels.of[i] == labels.of[j]
            less.append(tree.cell[i[ok & known]])
            ok &= ~known
        i, j = i[ok], j[ok]
        ok = bits.passes(i, j, tree.sizes[i], tree.sizes[j], percent)
        i, j = i[ok], j[ok]
        if thin and len(i):
            keep = labels.joined(i, j)
            less.append(np.delete(tree.cell[i], keep))
            i, j = i[keep], j[keep]
        left.append(tree.order[i])
        right.append(tree.order[j])
    return np.concatenate(left), np.concatenate(right), np.unique(np.concatenate(less))


def first_shared(keys: list, i: np.ndarray, j: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which pairs of places have no earlier cell in common than `key` of the first: both bounds are widest in that cell."""
    held: dict[int, frozenset] = {}
    out = np.empty(len(i), bool)
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        if b not in held:
            held[b] = frozenset(keys[b])
        out[k] = next(x for x in keys[a] if x in held[b]) == key[a]
    return out


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles, sorted, and their counts; they only decide the order of shingles, never a link.

    Each task counts by rounds and after each forgets what has at most one occurrence a round since it came up, so that
    a count falls short by less than a row in COUNTED_ROWS; tasks send what at least as many rows have. A shingle with
    COMMON_SHARE of all documents is thus found however the rows are dealt.
    """
    share = 1 / COUNTED_ROWS

    def heavy(batches):
        import pyarrow as pa

        tokens, n, late = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        seen, rounds, sets = 0, 0, []

        def round_over():
            nonlocal tokens, n, late, sets
            new, m = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
            both, at = np.unique(np.concatenate([tokens, new]), return_inverse=True)
            total, since = np.zeros(len(both), np.int64), np.full(len(both), rounds)
            np.add.at(total, at[len(tokens) :], m)
            total[at[: len(tokens)]] += n
            since[at[: len(tokens)]] = late
            ok = total + since > rounds + 1
            tokens, n, late, sets = both[ok], total[ok], since[ok], []

        for b in slices(batches):
            sets += [shingle_set(t, shingle) for t in b.column("text").to_pylist()]
            seen += b.num_rows
            if len(sets) >= COUNTED_ROWS:
                round_over()
                rounds += 1
        if sets:
            rounds = max(rounds - 1, 0)  # a part of a round forgets no more than the one before
            round_over()
        ok = n >= max(2, share * seen)
        yield pa.RecordBatch.from_arrays([pa.array(tokens[ok].view(np.int64)), pa.array(n[ok])], names=["token", "n"])

    least = max(10, int(share * docs.count()))
    found = docs.select("text").mapInArrow(heavy, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = found.orderBy(F.desc("n"), "token").limit(MOST_COMMON).toPandas()
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows["n"].to_numpy(np.int64)[order]


def point_id(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    parts = np.array([mix64(tokens).sum(), mix64(~tokens).max(initial=0), len(tokens)], np.uint64)
    return int(mix64(parts.sum(keepdims=True)).view(np.int64)[0])


def document_points(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, print (hash of the text), rid (task and place of the row), sid (hash of the set; null without words), n, the
    first shingles (rare, then common ones) and the counts."""
    common, often = common_shingles(docs, shingle)
    shared = docs.sparkSession.sparkContext.broadcast((common, often))  # MOST_COMMON entries at most

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        common, often = shared.value
        row = TaskContext.get().partitionId() << 32
        for b in slices(batches):
            rids = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            sids, ns, rare, late, coarse, fine, finer = [], [], [], [], [], [], []
            for text in b.column("text").to_pylist():
                tokens = shingle_set(text, shingle)
                n = len(tokens)
                ns.append(n)
                if not n:
                    for column in (sids, rare, late, coarse, fine, finer):
                        column.append(None)
                    continue
                sids.append(point_id(tokens))
                first = prefix_length(n, percent)
                at = np.minimum(np.searchsorted(common, tokens), max(0, len(common) - 1))
                is_common = common[at] == tokens if len(common) else np.zeros(n, bool)
                own = tokens[~is_common][:first]
                rest = tokens[is_common]
                rest = rest[np.lexsort((rest, often[at[is_common]]))][: first - len(own)] if len(own) < first else rest[:0]
                rare.append(own.view(np.int64))
                late.append(rest.view(np.int64))
                coarse.append(packed(counts(tokens, COARSE)))
                fine.append(parities(tokens))
                finer.append(parities(tokens, FINER))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("print"), rids, pa.array(sids, pa.int64()), pa.array(ns, pa.int64()), pa.array(rare, longs), pa.array(late, longs), pa.array(coarse, pa.binary()), pa.array(fine, pa.binary()), pa.array(finer, pa.binary())],
                names=["doc_id", "print", "rid", "sid", "n", "rare", "common", "coarse", "fine", "finer"],
            )

    schema = "doc_id long, print long, rid long, sid long, n long, rare array<long>, common array<long>, coarse binary, fine binary, finer binary"
    return written(docs.select("doc_id", "text", F.xxhash64("text").alias("print")).mapInArrow(run, schema), "jaccard-documents")


def cells(points: DataFrame, percent: int) -> DataFrame:
    """(key, rid, sid, n, reach, size, pivot, first) of all points that share one of their first shingles with another point.

    `reach` is the largest overlap that the point can have with those that share no earlier shingle; `pivot` is the rid of
    one of the cell's strong points, dealt to each thousand points, and `first` that of the least one. Most shingles are
    one point's alone: what is gathered of them is small, a key without its last bits, a row number (of which neighbours
    differ little) and the place; sets and sizes join the rest. Cells without a strong
    point have no links. The common shingles are known to be shared and need no gathering: their aggregates are combined
    before the shuffle. Each of the others belongs to a bounded share of the documents.
    """
    rare = points.select("rid", "n", F.posexplode("rare").alias("place", "key"))
    late = points.select("rid", "sid", "n", F.size("rare").alias("before"), F.posexplode("common").alias("at", "key")).select("rid", "sid", "n", (F.col("before") + F.col("at")).alias("place"), "key")
    columns = ["key", "rid", "sid", F.col("n").cast("int").alias("n"), (F.col("n") - F.col("place")).cast("int").alias("reach")]
    head = F.when(strong(F.col("n") - F.col("reach"), F.col("n"), percent), F.col("rid"))
    whole = Window.partitionBy("key")
    kind = F.when(strong(F.col("place"), F.col("n"), percent), F.col("place")).otherwise(-1 - F.col("place")).alias("kind")
    rare = rare.select(F.expr(f"shiftleft(shiftright(key, {KEY_BITS_OFF}), {KEY_BITS_OFF})").alias("key"), "rid", kind)
    rare = rare.select("*", F.count("*").over(whole).alias("size"), F.min(F.when(F.col("kind") >= 0, F.col("rid"))).over(whole).alias("first")).filter("size > 1 and first is not null")
    rare = rare.withColumn("place", F.when(F.col("kind") >= 0, F.col("kind")).otherwise(-1 - F.col("kind"))).join(data(points.select("rid", "sid", "n")), "rid")
    rare = rare.select(*columns, "size", "first")
    late = late.select(*columns)
    sizes = late.groupBy("key").agg(F.count("*").alias("size"), F.min(head).alias("first")).filter("size > 1 and first is not null")
    late = late.join(F.broadcast(sizes), "key")  # MOST_COMMON rows at most
    rows = written(rare.unionByName(late.select(*rare.columns)), "jaccard-cells")
    part = F.pmod(F.xxhash64("sid"), F.ceil(F.col("size") / PIVOT_ROWS))
    large = rows.filter(F.col("size") > PIVOT_ROWS).withColumn("part", part)
    pivots = large.groupBy("key", "part").agg(F.min(head).alias("pivot"))
    far = large.join(pivots, ["key", "part"]).withColumn("pivot", F.coalesce("pivot", "first"))
    near = rows.filter(F.col("size") <= PIVOT_ROWS).withColumn("pivot", F.col("first"))
    kept = ["key", "rid", "sid", "n", "reach", "size", "pivot", "first"]
    return near.select(*kept).unionByName(far.select(*kept))


def passing(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the bound on the parities."""
    side = lambda x: data(points).select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}"))

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            n, m = (b.column(c).to_numpy() for c in ("na", "nb"))
            bits = Parities([*b.column("fa").to_pylist(), *b.column("fb").to_pylist()])
            at = np.arange(b.num_rows)
            yield b.select(["a", "b"]).filter(pa.array(bits.passes(at, at + len(at), n, m, percent), pa.bool_()))

    near = pairs.join(side("a"), "a").join(side("b"), "b").filter((F.least("na", "nb") * 100) >= percent * F.greatest("na", "nb"))
    return written(near.select("a", "b", "na", "nb", "fa", "fb").mapInArrow(run, "a long, b long"), "jaccard-candidates")


def id_filter(ids: DataFrame, *columns: str) -> DataFrame:
    """A hashed bit set of the ids as (word, bits): of fixed size, whatever the number of ids."""
    place = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    return ids.select(place.alias("place")).groupBy(F.expr("place div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(place % 64))")).alias("bits"))


def maybe_in(rows: DataFrame, columns: list[str], bits: DataFrame) -> DataFrame:
    """All rows, and a column `maybe`: whether their ids may be among those of the bit set."""
    place = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    hit = F.expr("(bits & shiftleft(1L, int(filter_place % 64))) != 0")
    joined = rows.withColumn("filter_place", place).withColumn("word", F.expr("filter_place div 64")).join(F.broadcast(bits), "word", "left")
    return joined.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("filter_place", "word", "bits")


def verified(pairs: DataFrame, points: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Only texts of points in pairs are read into sets again."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            sets = [shingle_set(t, shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([point_id(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["sid", "tokens"])

    needed = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    bits = written(id_filter(points.join(needed, "sid").select("doc_id"), "doc_id"), "jaccard-filter")
    texts = maybe_in(docs.select("doc_id", "text"), ["doc_id"], bits).filter("maybe").select("text")
    sets = written(texts.mapInArrow(run, "sid long, tokens array<long>"), "jaccard-sets")
    side = lambda x: data(sets).select(F.col("sid").alias(x), F.col("tokens").alias(f"t{x}"))
    both = F.size(F.array_intersect("ta", "tb"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", both)
    return written(met.filter(may_link(F.col("both"), F.size("ta"), F.size("tb"), percent)).select("a", "b").distinct(), "jaccard-links")


def dealt(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of cells with several components, a copy for each `tile` that they are searched in.

    A cell of up to CHUNK points is one tile. In a larger one the points outside the largest component, strong and weak
    apart, are dealt to chunks, and so are the points of the largest; a tile is a pair of chunks that may have links:
    none of two weak ones, and none within the largest component. A point of that has a copy for each chunk of the
    others only. A point of a small cell without another one of a size to link with is left out.
    """
    by_comp = rows.groupBy("key", "comp").agg(F.count("*").alias("size"), F.count_if("strong").alias("heads"), F.bit_xor(F.xxhash64("sid")).alias("print"), F.sum("reach").alias("reach"))
    by_key = by_comp.groupBy("key").agg(
        F.max(F.struct("size", "heads", "comp")).alias("big"), F.sum("size").alias("size"), F.sum("heads").alias("heads"), F.bit_xor("print").alias("print"), F.sum("reach").alias("reach"), F.count("*").alias("comps")
    )
    strong_rest = F.col("heads") - F.col("big.heads")
    by_key = by_key.filter("comps > 1").select(
        "key", "size", "print", "reach", F.col("big.comp").alias("big"), strong_rest.alias("c0"), (F.col("size") - F.col("big.size") - strong_rest).alias("c1"), F.col("big.heads").alias("c2"), (F.col("big.size") - F.col("big.heads")).alias("c3")
    )
    by_key = by_key.filter("c0 > 0 or c1 > 0 and c2 > 0")
    # Of cells with equal points, the one whose shingle comes first: there every point reaches furthest.
    by_key = by_key.groupBy("print", "size").agg(F.max_by(F.struct("key", "big", "c0", "c1", "c2", "c3"), F.struct("reach", "key")).alias("cell")).select("size", "cell.*")
    chunks = lambda c: F.ceil(F.col(f"c{c}") * 2 / CHUNK).cast("int")
    units = lambda c: F.when(F.col(f"c{c}") > 0, F.transform(F.sequence(F.lit(0), chunks(c) - 1), lambda x: x + F.lit(c << 28))).otherwise(F.array().cast("array<int>"))
    met = rows.join(by_key, "key").withColumn("kind", F.when(F.col("comp") != F.col("big"), F.lit(0)).otherwise(F.lit(2)) + (~F.col("strong")).cast("int"))
    others = F.when(F.col("kind") == 0, F.concat(*map(units, range(4)))).when(F.col("kind") == 1, F.concat(units(0), units(2))).when(F.col("kind") == 2, F.concat(units(0), units(1))).otherwise(units(0))
    mine = F.coalesce(*[F.when(F.col("kind") == c, F.pmod(F.xxhash64("sid"), chunks(c)).cast("int") + F.lit(c << 28)) for c in range(4)])
    tiles = F.transform(others, lambda x: F.struct(F.least(x, mine).alias("low"), F.greatest(x, mine).alias("high")))
    columns = ["key", "low", "high", "sid", "comp", "n", "reach"]
    large = met.filter(F.col("size") > CHUNK).withColumn("tile", F.explode(tiles)).select("*", "tile.*").select(*columns)
    small = met.filter(F.col("size") <= CHUNK).withColumns({"low": F.lit(-1), "high": F.lit(-1)})
    return sized(small, percent).select(*columns).unionByName(large)


def sized(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of small cells that have one of another component in their cell, not too small or large for a link: a
    strong one, or any if they are strong. Sizes are compared on a scale of logarithms, a little too freely."""
    scale = 1 << 20
    far = int(np.ceil(np.log(100 / percent) * scale)) + 2
    near = Window.partitionBy("key").orderBy(F.floor(F.log("n") * scale)).rangeBetween(-far, far)
    head = F.when(F.col("strong"), F.col("comp"))
    low, high = (F.when(F.col("strong"), f("comp").over(near)).otherwise(f(head).over(near)) for f in (F.min, F.max))
    return rows.withColumns({"least": low, "most": high}).filter("least != comp or most != comp")


def searched(cell_rows: DataFrame, comps: DataFrame, points: DataFrame, percent: int, thin: bool) -> DataFrame:
    """Pairs of points of different components that share a cell and pass both bounds, as (a, b).

    With `thin`, forests of them; the rows (again) then hold the keys of cells of which pairs were left out. Else a pair
    is told once, in the cell of the first shingle that both points are searched by.
    """
    rows = cell_rows.join(comps.withColumnRenamed("node", "sid"), "sid", "left")
    rows = rows.select("key", "sid", "n", "reach", strong(F.col("n") - F.col("reach"), F.col("n"), percent).alias("strong"), F.coalesce("comp", "sid").alias("comp"))
    rows = written(dealt(written(rows, "jaccard-cells"), percent), "jaccard-tiles")
    met = maybe_in(points, ["sid"], written(id_filter(rows, "sid"), "jaccard-filter")).filter("maybe")
    met = data(met).select("sid", "coarse", F.col("fine" if thin else "finer").alias("fine"))
    if not thin:  # a point's cells in the order of its shingles, so that a pair is told by its first one alone
        own = rows.groupBy("sid").agg(F.sort_array(F.collect_set(F.struct((-F.col("reach")).alias("far"), "key"))).getField("key").alias("keys"))
        met = met.join(data(own), "sid")
    rows = rows.join(met, "sid")
    group = ["key", "low", "high"]
    parts_all = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts_all, *group).sortWithinPartitions(*group)

    def run(batches) -> Iterator:
        import pandas as pd
        import pyarrow as pa

        def pairs(t):
            key = t[group].to_numpy()
            cell = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).any(1)]))
            points, sizes, reach, comps, sid = coarse_rows(t["coarse"].tolist()), *(t[c].to_numpy() for c in ("n", "reach", "comp", "sid"))
            i, j, less = cell_pairs(cell, points, sizes, reach, comps, t["fine"].tolist(), percent, thin)
            if not thin and len(i):
                ok = first_shared(t["keys"].tolist(), i, j, key[:, 0])
                i, j = i[ok], j[ok]
            again = np.unique(key[np.searchsorted(cell, less), 0]).tolist()
            out = np.unique(np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])], 1), axis=0)
            none = [None] * len(out)
            return pa.RecordBatch.from_arrays(
                [pa.array([*out[:, 0], *[None] * len(again)], pa.int64()), pa.array([*out[:, 1], *[None] * len(again)], pa.int64()), pa.array([*none, *again], pa.int64())], names=["a", "b", "again"]
            )

        held = None
        for b in batches:
            t = b.to_pandas()
            held = t if held is None else pd.concat([held, t], ignore_index=True)
            last = (held[group] == held[group].iloc[-1]).all(axis=1).to_numpy()
            cut = int(np.argmax(last))  # the rows of the last tile may go on
            if cut:
                yield pairs(held.iloc[:cut].reset_index(drop=True))
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield pairs(held)

    return written(rows.mapInArrow(run, "a long, b long, again long").distinct(), "jaccard-candidates")


def by_component(rows: DataFrame, of_comp: DataFrame) -> DataFrame:
    """The rows joined with what is known of their `comp`; large components are dealt to SALTS tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(of_comp.select("*", salts), ["comp", "salt"]).drop("salt")


def point_rows(found: DataFrame) -> DataFrame:
    """One row of each set, with the least doc_id. Only rows whose set may be that of several, by a bit set of fixed
    size, are shuffled with their counts and written again."""
    own = found.filter("sid is not null").drop("print")
    several = own.groupBy("sid").agg(F.count("*").alias("rows")).filter("rows > 1")
    marked = maybe_in(own, ["sid"], written(id_filter(several, "sid"), "jaccard-filter"))
    first = [F.first(c).alias(c) for c in ("rare", "common", "coarse", "fine", "finer")]
    shared = written(marked.filter("maybe").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("rid").alias("rid"), F.max("n").alias("n"), *first), "jaccard-points")
    return marked.filter(~F.col("maybe")).select(*shared.columns).unionByName(shared)


def grouped(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, print, n, sid, comp and component_id of every row; rows of linked documents share the last two, empty
    sets have none."""
    found = document_points(docs, shingle, percent)
    points = point_rows(found)
    cell_rows = cells(points, percent)
    met = cell_rows.filter("rid != pivot").groupBy("sid").agg(F.min_by("pivot", "key").alias("rid")).select("rid", F.col("sid").alias("b"))
    heads = cell_rows.filter("rid = pivot and rid != first").select(F.col("first").alias("rid"), F.col("sid").alias("b"))
    first = met.union(heads).distinct().join(points.select("rid", F.col("sid").alias("a")), "rid").select("a", "b")
    links = verified(passing(first, points, percent), points, docs, shingle, percent)
    comps = components(links)
    crowded = cell_rows.filter(F.col("size") > CHUNK)
    if not crowded.isEmpty():
        # a forest of each point's largest cell alone, so that not every cell of a large group makes one
        one = crowded.groupBy("sid").agg(F.max_by(F.struct("key", "n", "reach"), F.struct("size", "key")).alias("cell")).select("cell.key", "sid", "cell.n", "cell.reach")
        pairs = searched(one, comps, points, percent, True).filter("a is not null").select("a", "b")
        if not pairs.isEmpty():
            links = links.union(verified(pairs, points, docs, shingle, percent))
            comps = components(links)
    for thin in (True, False):
        rest = searched(cell_rows, comps, points, percent, thin)
        pairs = rest.filter("a is not null").select("a", "b")
        if not pairs.isEmpty():
            links = links.union(verified(pairs, points, docs, shingle, percent))
            comps = components(links)
        again = rest.filter("again is not null").select(F.col("again").alias("key")).distinct()
        if not thin or again.isEmpty():
            break
        cell_rows = cell_rows.join(again, "key", "left_semi")
    own = points.select("sid", "doc_id")
    joined = comps.withColumnRenamed("node", "sid").join(own, "sid")
    named = by_component(joined.select("sid", "comp"), joined.groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    of_point = own.join(named, "sid", "left").select("sid", F.coalesce("comp", "sid").alias("comp"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return written(found.select("doc_id", "print", "n", "sid").join(of_point, "sid", "left").select("doc_id", "print", "n", "sid", "comp", "component_id"), "jaccard-grouped")


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of `docs`.

    Null texts and texts without words have the empty set and are linked with nothing; texts with fewer words than a
    shingle have one shingle of all their words. Repeated rows link by their equal sets. Null ids count as no id: such
    rows take their group's smallest id, or null. A very long text is one set of 64-bit hashes, held by one task at a
    time. A pair at exactly the similarity links. An empty table gives no rows. Other columns, whatever their names, are
    ignored.
    """
    rows = grouped(docs.select("doc_id", "text"), shingle, percent)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` without near copies: of each group of linked documents one row stays.

    That is the row with the smallest id (null ids last), of equal ids the one with the smallest hash of its text, and
    one of rows that are alike in both. Rows are told apart by id and text, so other rows that repeat an id stay or go
    with their own groups. Null, blank and unlinked texts stay. Only rows that may belong to a group of several, by a
    bit set of fixed size, are shuffled with their texts. An empty table gives no rows; all columns stay.
    """
    rows = grouped(docs.select("doc_id", "text"), shingle, percent).filter("comp is not null").select("doc_id", "print", "comp")
    who = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "print")
    several = rows.groupBy("comp").agg(F.count("*").alias("members"), F.min(who).alias("stays")).filter("members > 1")
    flags = by_component(rows, several).groupBy("doc_id", "print").agg(F.bool_or(who == F.col("stays")).alias("stays"))
    flags = written(flags, "jaccard-several")
    bits = written(id_filter(flags, "doc_id", "print"), "jaccard-filter")
    packed_rows = docs.select("doc_id", F.xxhash64("text").alias("print"), F.struct("*").alias("row"))
    marked = maybe_in(packed_rows, ["doc_id", "print"], bits)
    flags = flags.select(F.col("doc_id").alias("flag_id"), F.col("print").alias("flag_print"), "stays")
    rows = marked.filter("maybe").join(flags, F.expr("doc_id <=> flag_id and print = flag_print"), "left")
    sole = rows.filter("stays").dropDuplicates(["doc_id", "print"])
    return marked.filter(~F.col("maybe")).select("row.*").unionByName(rows.filter("stays is null").select("row.*")).unionByName(sole.select("row.*"))
