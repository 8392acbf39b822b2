"""Statistics over trials: edit distances, participant features, consistency of speed, mixtures, false discoveries."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqwatch.functions import kernels
from seqwatch.sources.durable import written

#: Letters of two bytes from 256 on, below the surrogates.
MOST_STATES = 0xD800 - 256
#: Trials of a recipe in one block.
TRIALS_OF_BLOCK = 500


def trial_blocks(steps: DataFrame, key: str) -> DataFrame:
    """(key, block, total, longest, trials): the trials of each key in the order of their ids, `TRIALS_OF_BLOCK` in a block,
    with the number of all of them and the most steps of one. Each is (nth, trial_id, w), numbered from 0 within its key, its
    states as letters.
    """
    letter = F.when(F.col("state").between(0, MOST_STATES - 1), F.decode(F.unhex(F.lpad(F.hex(F.col("state") + 256), 4, "0")), "UTF-16BE")).otherwise(F.raise_error(F.lit("a state beyond those that letters stand for")))
    words = steps.filter(F.col("trial_id").isNotNull() & F.col(key).isNotNull()).groupBy("trial_id", key).agg(F.array_sort(F.collect_list(F.struct("seg_idx", letter.alias("c")))).alias("s")).select("trial_id", key, F.array_join("s.c", "").alias("w"))
    rows = ranked(words, key, "trial_id")
    first = rows.groupBy(key).agg(F.min("rank").alias("first"), F.count("*").cast("int").alias("total"), F.max(F.length("w")).alias("longest"))  # one row a recipe
    rows = rows.join(F.broadcast(first), key).withColumn("nth", F.col("rank") - F.col("first")).withColumn("block", F.floor(F.col("nth") / TRIALS_OF_BLOCK).cast("int"))
    return rows.groupBy(key, "block", "total", "longest").agg(F.sort_array(F.collect_list(F.struct("nth", "trial_id", "w"))).alias("trials"))


def pairs_of_blocks(blocks: DataFrame, key: str, what: str) -> DataFrame:
    """(key, low, high, total, longest, sides): each pair of blocks of one key, a block and itself too, with (block, `what`) of both.

    They are dealt to a fixed number of partitions, as few bytes make many pairs.
    """
    last = F.ceil(F.col("total") / TRIALS_OF_BLOCK).cast("int") - 1
    cells = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.select(key, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "total", "longest", "block", what).repartition(parts, key, "low", "high")
    return cells.groupBy(key, "low", "high", "total", "longest").agg(F.sort_array(F.collect_list(F.struct("block", what))).alias("sides"))


def _sides(rows: pa.RecordBatch, what: str) -> Iterator[tuple[int, dict[str, pa.Array], dict[str, pa.Array]]]:
    """The number of each row, and the fields of its lower and its higher block."""
    for k, sides in enumerate(rows["sides"]):
        fields = [s for s in sides.values.field(what)]
        low, high = fields[0].values, fields[-1].values
        yield k, *({f.name: x.field(f.name) for f in x.type} for x in (low, high))


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = words.to_pylist()
    n = np.array([len(w) for w in words])
    out = np.zeros((n.max(initial=0), len(n)), np.int64)
    out.T[np.arange(len(out)) < n[:, None]] = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)
    return out, n


def edit_distances(steps: DataFrame, key: str = "recipe") -> DataFrame:
    """a, b, distance of all pairs of trials of one recipe: edits between their sequences of states.

    States from 0 to `MOST_STATES` have a letter. Pairs grow with the square of a recipe's trials, which is what is asked
    for. They are dealt by pairs of blocks of a recipe's trials, so that no task has all pairs of a recipe; the distances
    of two blocks are told together.
    """
    schema = f"{key} {dict(steps.dtypes)[key]}, a {dict(steps.dtypes)['trial_id']}, b {dict(steps.dtypes)['trial_id']}, distance int"

    def run(batches):
        for rows in batches:
            for k, low, high in _sides(rows, "trials"):
                d = kernels.edit_matrix(*_letters(low["w"]), *_letters(high["w"]))
                i, j = np.nonzero(low["nth"].to_numpy()[:, None] < high["nth"].to_numpy())
                key_of = pa.repeat(rows[key][k], len(i))
                yield pa.RecordBatch.from_arrays([key_of, low["trial_id"].take(pa.array(i)), high["trial_id"].take(pa.array(j)), pa.array(d[i, j])], names=[key, "a", "b", "distance"])

    blocks = written(trial_blocks(steps, key), "blocks")
    return pairs_of_blocks(blocks, key, "trials").mapInArrow(run, schema)


def participant_features(ticks: DataFrame, idle_verb: int) -> DataFrame:
    """trial_id, recipe, total ticks, share of idle ticks, number of items, total over the recipe's median."""
    rows = ticks.groupBy("trial_id", "recipe").agg(F.count("*").alias("total"), F.avg((F.col("verb_id") == idle_verb).cast("double")).alias("idle_share"), F.count_distinct("noun_id").alias("n_items"))
    medians = rows.groupBy("recipe").agg(F.percentile("total", F.lit(0.5)).alias("median"))
    return rows.join(F.broadcast(medians), "recipe").withColumn("relative", F.col("total") / F.col("median")).drop("median")  # one row a recipe


def representatives(steps: DataFrame, key: str = "recipe") -> DataFrame:
    """By recipe, the trial to show: length nearest to the upper median, then fewest segments, then the smallest trial_id.

    The median is read off the counts by length, so no recipe's trials are gathered in one task.
    """
    trials = steps.groupBy(key, "trial_id").agg(F.sum("duration").alias("total"), F.count("*").alias("n_segments"))
    up = Window.partitionBy(key).orderBy("total").rowsBetween(Window.unboundedPreceding, 0)
    lengths = trials.groupBy(key, "total").agg(F.count("*").alias("n"))
    reached = F.sum("n").over(up) > F.floor(F.sum("n").over(Window.partitionBy(key)) / 2)
    medians = lengths.withColumn("reached", reached).filter("reached").groupBy(key).agg(F.min("total").alias("median"))
    near = trials.join(F.broadcast(medians), key)  # one row a recipe
    best = F.min(F.struct(F.abs(F.col("total") - F.col("median")).alias("off"), "n_segments", "trial_id", "total"))
    return near.groupBy(key, "median").agg(best.alias("b")).select(key, "median", "b.trial_id", "b.total", "b.n_segments")


def half_means(values: DataFrame) -> DataFrame:
    """Each trial's means over its odd and even blocks of (trial_id, block, value)."""
    nth = F.row_number().over(Window.partitionBy("trial_id").orderBy("block"))
    rows = values.withColumn("nth", nth)
    return rows.groupBy("trial_id").agg(F.avg(F.when(F.col("nth") % 2 == 1, F.col("value"))).alias("odd"), F.avg(F.when(F.col("nth") % 2 == 0, F.col("value"))).alias("even"))


def gaussian_fit(values: DataFrame, key: str) -> DataFrame:
    """Log likelihood of one Gaussian by key."""
    sd = F.stddev_pop("x") + 1e-6
    rows = values.groupBy(key).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), sd.alias("sd"), F.var_pop("x").alias("var"))
    ll = -F.col("n") * (F.log(F.col("sd")) + 0.5 * F.log(F.lit(2 * np.pi))) - F.col("n") * F.col("var") / (2 * F.col("sd") * F.col("sd"))
    return rows.select(key, "n", "mean", "sd", ll.alias("log_likelihood"))


def two_components(x: np.ndarray, times: np.ndarray | None = None, restarts: int = 5, steps: int = 200, seed: int = 0) -> float:
    """Best log likelihood of a mixture of two Gaussians over values that occur so many times."""
    times = np.ones(len(x)) if times is None else times.astype(float)
    draw, best, size = np.random.default_rng(seed), -np.inf, times.sum()
    spread = np.sqrt((times * (x - (times * x).sum() / size) ** 2).sum() / size)
    for _ in range(restarts):
        mean, sd, w = draw.choice(x, 2, replace=len(x) < 2, p=times / size).astype(float), np.full(2, spread + 1e-6), np.full(2, 0.5)
        for _ in range(steps):
            logs = np.log(w) - np.log(sd) - 0.5 * np.log(2 * np.pi) - 0.5 * ((x[:, None] - mean) / sd) ** 2
            top = logs.max(1, keepdims=True)
            total = top + np.log(np.exp(logs - top).sum(1, keepdims=True))
            part = np.exp(logs - total) * times[:, None]
            n = part.sum(0) + 1e-12
            w, mean = n / size, (part * x[:, None]).sum(0) / n
            sd = np.sqrt((part * (x[:, None] - mean) ** 2).sum(0) / n) + 1e-3
        best = max(best, float((total[:, 0] * times).sum()))
    return best


def bimodality(values: DataFrame, key: str, least_n: int = 15, margin: float = 6.0) -> DataFrame:
    """By key of (key, x): BIC of one and two Gaussians, and whether two are better by the margin.

    Equal values are counted before they meet, so a key's group has its distinct values only.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x, times = group["x"].to_numpy(float), group["n"].to_numpy(float)
        size = times.sum()
        mean = (times * x).sum() / size
        sd = np.sqrt((times * (x - mean) ** 2).sum() / size) + 1e-6
        one = float((times * (-np.log(sd) - 0.5 * np.log(2 * np.pi) - 0.5 * ((x - mean) / sd) ** 2)).sum())
        bic1, bic2 = 2 * np.log(size) - 2 * one, 5 * np.log(size) - 2 * two_components(x, times)
        return pd.DataFrame({key: [group[key].iloc[0]], "n": [int(size)], "bic1": [bic1], "bic2": [bic2], "bimodal": [bic1 - bic2 > margin]})

    counted = values.groupBy(key, "x").agg(F.count("*").alias("n"))
    enough = counted.groupBy(key).agg(F.sum("n").alias("all")).filter(F.col("all") >= least_n).select(key)
    kind = dict(values.dtypes)[key]
    return counted.join(F.broadcast(enough), key).groupBy(key).applyInPandas(fit, f"{key} {kind}, n long, bic1 double, bic2 double, bimodal boolean")


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Adds `rank`, from 1, in the order of these columns: range partitions, and the counts of those before."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ranked")
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    offsets = counts.select("range", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.withColumn("within", within).join(F.broadcast(offsets), "range").withColumn("rank", (F.col("within") + F.col("before")).cast("int")).drop("range", "within", "before")


def false_discoveries(tests: DataFrame, q: float = 0.10) -> DataFrame:
    """Adds `rank` and `rejected` to (id, p): the step-up rule that bounds the share of false discoveries by q."""
    rows = ranked(tests, "p", "id")
    m = tests.count()
    last = rows.agg(F.coalesce(F.max(F.when(F.col("p") <= F.col("rank") / F.lit(m) * q, F.col("rank"))), F.lit(0)).alias("last"))
    return rows.join(F.broadcast(last), F.lit(True)).withColumn("rejected", F.col("rank") <= F.col("last")).drop("last")  # one row


def binomial_p(k: Column, n: Column, rate: Column) -> Column:
    """Two-sided exact p of k of n at a rate strictly between 0 and 1: the mass of counts that are no likelier than k.

    One pass over the counts from 0 to n, each log mass from the one before.
    """
    odds = F.log(rate) - F.log(1 - rate)
    step = lambda i: F.log((n - i + 1) / i) + odds  # noqa: E731  from i - 1 to i
    none = n * F.log(1 - rate)
    upto = lambda m: F.when(m >= 1, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    own = F.aggregate(upto(k), none, lambda a, i: a + step(i)) + NEAR
    seen = lambda log_mass: F.when(log_mass <= own, F.exp(log_mass)).otherwise(0.0)
    start = F.struct(none.alias("m"), seen(none).alias("p"))
    return F.least(F.aggregate(upto(n), start, lambda a, i: F.struct((a["m"] + step(i)).alias("m"), (a["p"] + seen(a["m"] + step(i))).alias("p")), lambda a: a["p"]), F.lit(1.0))


#: Masses that differ by less are equal.
NEAR = 1e-7


def ingredient_tests(uses: DataFrame, least_trials: int = 3, least_uses: int = 5, q: float = 0.10) -> DataFrame:
    """participant, item, k, n, rate, p, rank, rejected: whether a participant uses an item oftener or less often than all do.

    `uses` has (participant, trial, item), an item in a trial once or more; a trial without items has one row with a null
    item. Items in fewer than `least_uses` trials, those in all trials and participants with fewer than `least_trials` are
    left out. The share of false discoveries among the rejected is bounded by q.
    """
    once = uses.distinct()
    trials = once.groupBy("participant").agg(F.count_distinct("trial").cast("int").alias("n"))
    total = trials.agg(F.sum("n").alias("total"))
    items = once.filter("item IS NOT NULL").groupBy("item").agg(F.count("*").alias("used")).filter(F.col("used") >= least_uses)
    rates = items.join(F.broadcast(total), F.lit(True)).filter("used < total").select("item", (F.col("used") / F.col("total")).alias("rate"))  # one row each, of a vocabulary
    counts = once.groupBy("participant", "item").agg(F.count("*").cast("int").alias("k"))
    cells = trials.filter(F.col("n") >= least_trials).join(F.broadcast(rates), F.lit(True)).join(counts, ["participant", "item"], "left").fillna(0, ["k"])
    tests = written(cells.withColumn("p", F.round(binomial_p(F.col("k"), F.col("n"), F.col("rate")), 9)).withColumn("id", F.struct("participant", "item")), "tests")
    found = false_discoveries(tests.select("id", "p"), q).select("id.*", "rank", "rejected")
    return tests.drop("id").join(found, ["participant", "item"]).select("participant", "item", "k", "n", "rate", "p", "rank", "rejected")


#: Bytes of a table of distances above which it is kept in a file of the task.
MOST_IN_MEMORY = 1 << 26


def scratch(shape: tuple[int, int], kind: type) -> np.ndarray:
    """A table to be filled; a large one lies in a file that goes with it, so that the system holds what of it is in use."""
    if shape[0] * shape[1] * np.dtype(kind).itemsize <= MOST_IN_MEMORY:
        return np.empty(shape, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, shape=shape)


def average_linkage(distances: np.ndarray, clusters: int) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """(cluster of each element, numbered by first element; merges as (smallest elements of both, distance)): the pair of
    clusters with the least mean distance merges first, of equals that with the smallest elements.

    When a quarter of the clusters is left, their rows become a smaller table of sums.
    """
    exact = np.issubdtype(distances.dtype, np.integer)
    member, first, sizes, sums, merges = np.arange(len(distances)), np.arange(len(distances)), np.ones(len(distances)), distances, []
    while len(first) > clusters:
        of, row, found = merged(sums, sizes, max(clusters, len(first) // 4), exact)
        merges += [(int(first[a]), int(first[b]), d) for a, b, d in found]
        left = np.unique(of)
        smaller = scratch((len(left), len(left)), np.float64)
        for k, i in enumerate(left):
            smaller[k] = np.bincount(of, row(i), minlength=len(of))[left]
        sums, sizes = smaller, np.bincount(of, sizes, minlength=len(of))[left]
        first, member = first[left], np.searchsorted(left, of)[member]
    return member, merges


def merged(sums: np.ndarray, sizes: np.ndarray, stop: int, exact: bool) -> tuple[np.ndarray, Callable[[int], np.ndarray], list[tuple[int, int, float]]]:
    """Merges until `stop` clusters are left: (the first row of each row's cluster, its sums with all rows, merges).

    A cluster's row is the sum of its elements' rows, so a merge writes one row. Each cluster knows its nearest among those
    after it. A merge moves no mean below both it comes from, so what is known of a cluster that has changed is a lower
    bound, and it is looked for anew only when no other is less.
    """
    n = len(sums)
    of, size, rows, merges, left = np.arange(n), sizes.copy(), {}, [], n
    small = exact and sums.dtype.itemsize < 4 and n * np.iinfo(sums.dtype).max < 1 << 31
    store = scratch((n // 2 + 1, n), np.int32 if small else np.float64)
    free = list(range(len(store)))[::-1]
    nearest, partner, stale = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
    row = lambda i: store[rows[i]] if i in rows else sums[i]

    def look(i: int) -> None:
        later, nearest[i], stale[i] = slice(i + 1, None), np.inf, False
        if i + 1 < n:
            total = np.bincount(of[later], row(i)[later], minlength=n)[later]
            mean = np.full(n - i - 1, np.inf)
            np.divide(total, size[later] * size[i], out=mean, where=size[later] > 0)
            mean = mean if exact else np.round(mean, 9)
            partner[i] = i + 1 + int(mean.argmin())
            nearest[i] = mean[partner[i] - i - 1]

    for i in range(n):
        look(i)
    while left > stop:
        i = int(nearest.argmin())
        if stale[i]:
            look(i)
            continue
        j = int(partner[i])
        merges.append((i, j, float(nearest[i])))
        both = np.add(row(i), row(j), dtype=store.dtype)
        if i not in rows:
            rows[i] = free.pop()
        store[rows[i]] = both
        if j in rows:
            free.append(rows.pop(j))
        of[of == j] = i
        size[i], size[j], nearest[j], left = size[i] + size[j], 0, np.inf, left - 1
        stale |= ((partner == i) | (partner == j)) & (size > 0)
        look(i)
    return of, row, merges


def order_clusters(pairs: DataFrame, key: str = "recipe", clusters: int = 2, least_n: int = 6) -> DataFrame:
    """`key`, trial_id, cluster, from the distances (key, a, b, distance) of all pairs of trials of each key.

    A key's distances are one matrix in one task; give it those of a study, and blocks of distances to `clusters_of_blocks`.
    Keys with fewer than `least_n` trials are left out.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([rows["a"], rows["b"]]))
        if len(ids) < least_n:
            return pd.DataFrame({key: [], "trial_id": [], "cluster": []})
        d = np.zeros((len(ids), len(ids)))
        a, b = np.searchsorted(ids, rows["a"]), np.searchsorted(ids, rows["b"])
        d[a, b] = d[b, a] = rows["distance"]
        return pd.DataFrame({key: rows[key].iloc[0], "trial_id": ids, "cluster": average_linkage(d, clusters)[0]})

    kind = dict(pairs.dtypes)[key]
    return pairs.groupBy(key).applyInPandas(fit, f"{key} {kind}, trial_id long, cluster int")


def within_distance(members: DataFrame, pairs: DataFrame, by: list[str], key: str = "recipe") -> DataFrame:
    """`by` and the mean over clusters of the mean distance within each, clusters of one trial left out.

    `members` has (*by, trial_id, cluster), `by` with `key` among them.
    """
    of = lambda name: members.select(*by, F.col("trial_id").alias(name), "cluster")
    same = pairs.join(of("a"), [key, "a"]).join(of("b"), [*by, "b", "cluster"])
    return same.groupBy(*by, "cluster").agg(F.avg("distance").alias("mean")).groupBy(*by).agg(F.avg("mean").alias("within"))


def permuted(members: DataFrame, draws: int, seed: int, key: str = "recipe") -> DataFrame:
    """(key, draw, trial_id, cluster): the trials of each key dealt anew to clusters of the same sizes, `draws` times.

    The order of a draw is that of a hash of seed, draw and trial, so it is the same in every run. Other columns of
    `members` stay with their trial.
    """
    of = [c for c in members.columns if c not in (key, "cluster")]
    rows = members.select(key, *of, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    nth = F.row_number().over(Window.partitionBy(key, "draw").orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), "draw", "trial_id")), "trial_id"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy("cluster"))
    places = members.groupBy(key, "cluster").agg(F.count("*").alias("n")).select(key, "cluster", (upto - F.col("n")).alias("after"), upto.alias("upto"))  # one row a cluster
    dealt = rows.withColumn("nth_drawn", nth).join(F.broadcast(places), key).filter("nth_drawn > after and nth_drawn <= upto")
    return dealt.select(key, "draw", *of, "cluster")


def distances_of_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """(key, low, high, total, longest, distances): of each pair of blocks the distances of their trials, row by row as bytes,
    one for each if no sequence of the key has more than 255 steps, else four."""
    schema = f"{key} {dict(blocks.dtypes)[key]}, low int, high int, total int, longest int, distances binary"

    def run(batches):
        for rows in batches:
            for k, low, high in _sides(rows, "trials"):
                d = kernels.edit_matrix(*_letters(low["w"]), *_letters(high["w"])).astype(_kind(rows["longest"][k].as_py()))
                yield pa.RecordBatch.from_arrays([*[rows[c].slice(k, 1) for c in (key, "low", "high", "total", "longest")], pa.array([d.tobytes()], pa.binary())], names=[key, "low", "high", "total", "longest", "distances"])

    return pairs_of_blocks(blocks, key, "trials").mapInArrow(run, schema)


def _kind(longest: int) -> type:
    return np.uint8 if longest < 256 else np.int32


def clusters_of_blocks(distances: DataFrame, key: str, clusters: int, least_n: int) -> DataFrame:
    """(key, nth, cluster) of the trials of keys with `least_n` or more, two at least.

    Merging goes from one pair to the next, so that a key's distances meet in one task; its table of them and those of
    its sums are files, and what it holds in memory grows with the number of trials.
    """
    size = TRIALS_OF_BLOCK
    schema = f"{key} {dict(distances.dtypes)[key]}, nth int, cluster int"

    def told(of, table):
        found = average_linkage(table, clusters)[0]
        return pa.RecordBatch.from_arrays([pa.repeat(of, len(found)), pa.array(np.arange(len(found)), pa.int32()), pa.array(found, pa.int32())], names=[key, "nth", "cluster"])

    def run(batches):
        of = table = None
        for rows in batches:
            for k, (low, high, total, longest) in enumerate(zip(*[rows[c].to_pylist() for c in ("low", "high", "total", "longest")])):
                if of is None or rows[key][k] != of:
                    if of is not None:
                        yield told(of, table)
                    of, table = rows[key][k], scratch((total, total), _kind(longest))
                a, b = slice(low * size, min(total, low * size + size)), slice(high * size, min(total, high * size + size))
                d = np.frombuffer(rows["distances"][k].as_buffer(), table.dtype).reshape(a.stop - a.start, -1)
                table[a, b], table[b, a] = d, d.T
        if of is not None:
            yield told(of, table)

    parts = int(distances.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distances.filter(F.col("total") >= max(2, least_n)).repartition(parts, key).sortWithinPartitions(key).mapInArrow(run, schema)


def sums_within(distances: DataFrame, drawn: DataFrame, key: str, clusters: int) -> DataFrame:
    """(key, draw, cluster, total): the sums of the distances within each cluster of each draw.

    `drawn` has (key, total, longest, nth, draw, cluster), each trial of a key once a draw, draws numbered from 0. Two blocks
    of trials meet their distances, and the sums of all draws are products of these with the trials of each cluster.
    """
    labels = drawn.groupBy(key, "total", "longest", "nth").agg(F.transform(F.sort_array(F.collect_list(F.struct("draw", "cluster"))), lambda x: x["cluster"]).alias("of"))
    labels = labels.groupBy(key, F.floor(F.col("nth") / TRIALS_OF_BLOCK).cast("int").alias("block"), "total", "longest").agg(F.sort_array(F.collect_list(F.struct("nth", "of"))).alias("labels"))
    schema = f"{key} {dict(distances.dtypes)[key]}, draw int, cluster int, total long"

    def run(batches):
        found = {}
        for rows in batches:
            for k, low, high in _sides(rows, "labels"):
                a, b = (x["of"].flatten().to_numpy().reshape(len(x["nth"]), -1) for x in (low, high))
                d = np.frombuffer(rows["distances"][k].as_buffer(), _kind(rows["longest"][k].as_py())).reshape(len(a), len(b)).astype(float)
                sums = np.stack([((d @ (b == c)) * (a == c)).sum(0) for c in range(clusters)])  # whole numbers
                times = 2 if rows["low"][k] == rows["high"][k] else 1
                of = rows[key][k]
                found[of] = found.get(of, 0) + (sums / times).astype(np.int64)
        for of, sums in found.items():
            draw, cluster = np.meshgrid(np.arange(sums.shape[1]), np.arange(clusters))
            yield pa.RecordBatch.from_arrays([pa.repeat(of, sums.size), pa.array(draw.ravel(), pa.int32()), pa.array(cluster.ravel(), pa.int32()), pa.array(sums.ravel())], names=[key, "draw", "cluster", "total"])

    sides = pairs_of_blocks(labels, key, "labels").drop("total", "longest")
    both = distances.join(sides.hint("merge"), [key, "low", "high"]).select(key, "low", "high", "longest", "distances", "sides")
    return both.mapInArrow(run, schema).groupBy(key, "draw", "cluster").agg(F.sum("total").alias("total"))


def order_structure(steps: DataFrame, key: str = "recipe", clusters: int = 2, draws: int = 100, seed: int = 0, least_n: int = 6) -> DataFrame:
    """By key: trials, size of the smallest cluster, mean distance within clusters, the mean and deviation of the same over
    random splits into clusters of these sizes, and the share of those that are looser: near 1 if the orders really part.

    The distances of all pairs are told once, by blocks; no pair of trials is ever a row.
    """
    blocks = written(trial_blocks(steps, key), "blocks")
    distances = written(distances_of_blocks(blocks, key), "distances")
    found = written(clusters_of_blocks(distances, key, clusters, least_n), "clusters")
    trials = blocks.select(key, "total", "longest", F.explode("trials").alias("t")).select(key, "total", "longest", "t.nth", "t.trial_id")
    members = written(trials.join(found.hint("merge"), [key, "nth"]), "members")
    drawn = permuted(members, draws, seed, key).unionByName(members.withColumn("draw", F.lit(0)))
    sizes = members.groupBy(key, "cluster").agg(F.count("*").alias("n"))
    n_pairs = sizes.withColumn("pairs", F.col("n") * (F.col("n") - 1) / 2).filter("pairs > 0")  # one row a cluster
    means = sums_within(distances, drawn, key, clusters).join(F.broadcast(n_pairs), [key, "cluster"])
    within = written(means.groupBy(key, "draw").agg(F.avg(F.col("total") / F.col("pairs")).alias("within")), "within")
    null, observed = within.filter("draw > 0"), within.filter("draw = 0").select(key, F.col("within").alias("observed"))
    whole = sizes.groupBy(key).agg(F.sum("n").alias("trials"), F.min("n").alias("least"))
    looser = F.avg((F.round("within", 9) > F.round("observed", 9)).cast("int"))
    return whole.join(observed, key).join(null, key).groupBy(key, "trials", "least", "observed").agg(F.avg("within").alias("null_mean"), F.stddev_pop("within").alias("null_sd"), looser.alias("looser"))


def spherical_kmeans(bags: DataFrame, k: int, iterations: int = 20) -> DataFrame:
    """trial_id, cluster of unit-length bags (trial_id, item, weight): assignment by cosine, centres by grouped sums.

    The first centres are the k trials of the smallest hashes. Centres are a small table (k times the items).
    """
    ids = bags.select("trial_id").distinct()
    first = ids.orderBy(F.xxhash64("trial_id"), "trial_id").limit(k).withColumn("cluster", (F.row_number().over(Window.orderBy(F.xxhash64("trial_id"), "trial_id")) - 1).cast("int"))
    centres = bags.join(first, "trial_id").select("cluster", "item", "weight").toPandas()
    spark, assigned = bags.sparkSession, None
    for _ in range(iterations):
        table = spark.createDataFrame(centres, "cluster int, item string, weight double").withColumnRenamed("weight", "c")
        near = bags.join(table, "item").groupBy("trial_id", "cluster").agg(F.sum(F.col("weight") * F.col("c")).alias("cosine"))
        best = Window.partitionBy("trial_id").orderBy(F.desc(F.round("cosine", 9)), "cluster")
        assigned = near.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("trial_id", "cluster")
        sums = bags.join(assigned, "trial_id").groupBy("cluster", "item").agg(F.sum("weight").alias("w"))
        unit = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("cluster")))
        new = sums.select("cluster", "item", (F.col("w") / unit).alias("weight")).toPandas()
        merged = centres.merge(new, on=["cluster", "item"], how="outer", suffixes=("_a", "_b")).fillna(0.0)
        moved = float(np.abs(merged["weight_a"] - merged["weight_b"]).max()) if len(merged) else 0.0
        centres = new
        if moved < 1e-6:
            break
    return assigned
