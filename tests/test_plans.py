"""Queries against their SQL, models fitted to what they generated, and streams against tables."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwatch.plans import catalogue, decode, fit, oracle
from seqwatch.streaming import live

SMALL = "/root/testdata/sf0.001"
TABLES = "customer documents events lineitem".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) if isinstance(v, float) else v.item() if hasattr(v, "item") else v


def table_of(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    result = duck.execute(oracle.SQL[name])
    expected = table_of([c[0] for c in result.description], result.fetchall())
    found = table_of(df.columns, [tuple(r) for r in df.collect()])
    assert found[0] == expected[0] and len(found[1]) == len(expected[1])
    for a, b in zip(found[1], expected[1]):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(v, (int, float, type(None))) for v in a) and None not in a else a == b


@pytest.mark.parametrize("name", sorted({*catalogue.QUERIES} - {*oracle.SQL}))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def peaked(states=3, verbs=4, nouns=4):
    v = np.full((states, verbs), 0.02)
    n = np.full((states, nouns), 0.02)
    for k in range(states):
        v[k, k] = n[k, k] = 1
    trans = (np.roll(np.eye(states), 1, 1) * 0.9 + 0.1) * (1 - np.eye(states))
    with np.errstate(divide="ignore"):
        log = lambda x: np.log(x / x.sum(-1, keepdims=True))
        return decode.Model(np.log(np.full(states, 1 / states)), log(trans), log(v), log(n), np.full(states, 8.0), np.full(states, 0.5), 40)


def test_decoding_and_fitting(spark):
    model = peaked()
    ticks = fit.sampled(spark, model, 12, 80, 3).cache()
    found = decode.decode(ticks, model)
    assert found.agg(F.sum("duration")).first()[0] == ticks.count()
    spans = found.select("trial_id", F.col("state").alias("z"), F.explode(F.sequence("tick_start", F.col("tick_end") - 1)).alias("tick"))
    assert ticks.join(spans, ["trial_id", "tick"]).agg(F.avg((F.col("z") == F.col("state")).cast("int"))).first()[0] > 0.95
    _, history = fit.soft_em(ticks, model, 4, anneal=1.0)
    assert history[-1] >= history[0] - 1e-6
    hard = fit.hard_em(ticks, model, 1)
    np.testing.assert_allclose(np.exp(hard.verbs).sum(1), 1)
    back = decode.Model.read(model.long(spark))
    np.testing.assert_allclose(back.verbs, model.verbs)
    rho = decode.recipe_posteriors(ticks, [model, peaked(3)], [np.log(0.5)] * 2).first()["rho"]
    assert sum(rho) == pytest.approx(1)


def test_stream_equals_batch(spark, tmp_path):
    model = peaked()
    ticks = fit.sampled(spark, model, 4, 30, 5).select("trial_id", "tick", "verb_id", "noun_id").cache()
    for k, part in enumerate(((0, 10), (10, 30))):
        ticks.filter(F.col("tick").between(part[0], part[1] - 1)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = live.live_beliefs(stream, model, timeout_ms=None).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    batch = {(r[0], r[1]): (max(r[2]), r[3]) for r in decode.beliefs(ticks, model).collect()}
    got = {(r["trial_id"], r["tick"]): (r["belief"], r["s_emit"]) for r in spark.table("live").collect()}
    assert got.keys() == batch.keys()
    for key in batch:
        assert got[key] == pytest.approx(batch[key], abs=1e-9)


def test_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:05:00")]
    df = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r["user_id"], r["n"]) for r in live.sessions(df).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_replies_cover_all_steps(spark):
    """Whole trials against brute force; the SQL of these queries ends at the first steps of a trial."""
    steps, pairs = {}, {}
    for r in catalogue.segments(spark, SMALL).collect():
        steps.setdefault((r["recipe"], r["trial_id"]), []).append((r["seg_idx"], r["state"], r["duration"]))
    for r in catalogue.QUERIES["steps_text"](spark, SMALL).collect():
        pairs.setdefault(r["trial_id"], []).append((r["seg_idx"], r["text"]))
    prompts = {(t, k): "\n".join(f"{i + 1}. {x}" for i, x in sorted(rows)[: k + 1]) for t, rows in pairs.items() for k in range(len(rows))}
    assert {(r["trial_id"], r["seg_idx"]): r["prompt"] for r in catalogue.QUERIES["prefix_prompt"](spark, SMALL).collect()} == prompts
    told = {(t, k): None if k == 2 else "Omission Anomaly" if s % 2 else "No Anomaly" for (_, t), rows in steps.items() for k, s, _ in rows}
    assert {(r["trial_id"], r["seg_idx"]): r["reply"] for r in catalogue.QUERIES["batch_reply_split"](spark, SMALL).collect()} == told
    orders, lasted = {}, {}
    for (recipe, _), rows in steps.items():
        orders.setdefault(recipe, []).append("-".join(str(s) for _, s, _ in sorted(rows)))
        for _, s, d in rows:
            lasted.setdefault((recipe, str(s)), []).append(d)
    expected = set()
    for recipe, found in orders.items():
        states = min(found, key=lambda x: (-found.count(x), x))
        expected.add((recipe, states, found.count(states), len({*found}), "-".join(str(int(np.median(lasted[recipe, s]))) for s in states.split("-"))))
    assert {tuple(r) for r in catalogue.QUERIES["canonical_recipe"](spark, SMALL).collect()} == expected
