"""Rows that share a key are settled once: no operator here makes pairs of them."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import joins as J
from tessera.operators import places as P
from tessera.plans import registry
from tessera.streaming import votes as V


@pytest.fixture(scope="module")
def most_rows():
    """Rows of a result, and the most rows that any step of its plan gave."""

    def steps(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            yield from steps(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            yield from steps(node.plan())
        else:
            n = node.metrics().get("numOutputRows")
            if n.isDefined():
                yield n.get().value()
            for i in range(node.children().size()):
                yield from steps(node.children().apply(i))

    def run(df):
        rows = df.collect()
        return rows, max(steps(df._jdf.queryExecution().executedPlan()))

    return run


def test_first_containing(spark, most_rows):
    products = spark.range(900).select(F.col("id"), F.lit("Pack One").alias("name"))
    releases = spark.range(800).select(F.col("id").alias("rid"), F.lit("One").alias("rname"), (-F.col("id")).alias("place"))
    rows, most = most_rows(J.first_containing(products, releases, "name", "rname", "id", "place"))
    assert len(rows) == 900 and {r.rid for r in rows} == {799} and most <= 2000


def test_match_products(spark, most_rows):
    a = spark.range(900).select(F.col("id").alias("a_id"), F.when(F.col("id") < 890, "k").alias("a_k"))
    b = spark.range(800).select(F.col("id").alias("b_id"), F.when(F.col("id") < 700, "k").when(F.col("id") < 790, "other").alias("b_k"), F.when(F.col("id") > 5, F.col("id") < 300).alias("p"))
    rows, most = most_rows(J.match_products(a, b, F.col("a_k"), F.col("b_k"), F.col("p"), "a_id", "b_id"))
    assert sorted((r.a_id is None, r.a_id, r.b_id) for r in rows if r.a_id is not None) == [(False, i, 299 if i < 890 else None) for i in range(900)]
    assert sorted(r.b_id for r in rows if r.a_id is None) == list(range(700, 800)) and most <= 2000


def _parts_of(df):
    """Numbers of rows of the parts that a task each reads."""
    return [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]


def test_rows_of_tasks_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_ROWS", 100)
    df = spark.range(20000).select("id", F.lit("x").alias("v"))
    assert max(_parts_of(P.spread(df, ["id"], 20000))) < 200


def test_votes_sort_once_and_tokens_never(spark):
    matches = spark.range(600).select((F.col("id") % 5).alias("session"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 3).alias("candidate"), F.lit(1).alias("distance"))
    plan = V.vote_counts(matches, 3, 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    tokens = spark.createDataFrame([("g", "en", "f", 0, "a", None), ("g", "ja", "f", 0, "b", "timing")], "group string, language string, field string, index int, text string, kind string")
    seeds = spark.createDataFrame([("The", "timing")], "text string, kind string")
    rows = A.learn_translations(tokens, spark.createDataFrame([("g", "0")], "group string, rank string"), seeds)
    assert {r.text: r.learned for r in rows.collect()} == {"a": "timing", "b": None}
    assert "ShuffledHashJoin" in rows._jdf.queryExecution().executedPlan().toString()


def test_nearest_hashes_are_not_sorted_pair_by_pair(spark, most_rows):
    b = spark.range(400).select("id", (F.col("id") % 256).alias("hash"), F.lit(1).alias("block"))
    rows = J.nearest_hash(b, b, ["block"], 11, own=False)
    assert sum(r.distance for r in rows.collect()) == 112  # 256 to 399 copy 0 to 143; the others are 1 bit away
    # after the join that makes pairs, hash aggregation is the first step
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "ShuffledHashJoin" in rows._jdf.queryExecution().executedPlan().toString()


def test_a_row_passes_over_its_id_under_another_hash(spark):
    a = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "id long, hash long, block int")
    b = spark.createDataFrame([(1, 1, 1), (5, 1, 1), (7, 3, 1)], "id long, hash long, block int")
    for most in (11, 14):
        assert sorted(map(tuple, J.nearest_hash(a, b, ["block"], most, own=False).collect())) == [(1, 5, 1), (2, 1, 1)]


def test_frames_of_one_hash_meet_the_index_once(spark, most_rows):
    r = random.Random(3)
    index = [(i, r.getrandbits(63)) for i in range(60)]
    frames = spark.createDataFrame([(index[k][1],) for k in range(4)], "hash long").crossJoin(spark.range(500)).select(F.col("id").alias("session"), F.timestamp_seconds("id").alias("ts"), F.col("hash").bitwiseXOR(F.lit(35)).alias("hash"))
    rows, most = most_rows(V.match_stream(frames, spark.createDataFrame(index, "candidate long, hash long")))
    assert len(rows) == 2000 and {x.candidate for x in rows} == {0, 1, 2, 3} and {x.distance for x in rows} == {3}
    # a row for each frame at most, where 8 bytes of each would make 16,000
    assert most <= 2000


def test_every_row_asks_for_its_nearest(spark, sf):
    rows = registry.queries()["j11_nearest_within_11"](spark, sf).collect()
    assert sorted(x.id for x in rows) == sorted(x.vec_id for x in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    assert "% 100" not in registry.oracle_sql()["j11_nearest_within_11"]


def test_hashes_with_a_near_partner_are_not_probed_farther(spark, monkeypatch):
    steps, write = [], J.written
    monkeypatch.setattr(J, "written", lambda df, name: steps.append(write(df, name)) or steps[-1])
    # partners 3, 2, 0, 8 and 6 bits away (one bit at least in each part of the latter), and one without any
    hashes = [0, 7, 0x0F0F0F0F, 0x0F0F0F3F, 0xFF << 40, 0xFF << 40, 0x7F << 56, (0x7F << 56) ^ 0x0003000300030003, 0xAAAA << 16, (0xAAAA << 16) ^ 0x0001000100030003, (1 << 62) - 1]
    b = spark.createDataFrame([(i, h, i // 2) for i, h in enumerate(hashes)], "id long, hash long, block int")
    got = sorted(map(tuple, J.nearest_hash(b, b, ["block"], 11, own=False).collect()))
    assert got == sorted((i, i ^ 1, (h ^ hashes[i ^ 1]).bit_count()) for i, h in enumerate(hashes[:10]))
    found = [{x.hash for x in step.where("distance > 0").collect()} for step in steps]
    assert found == [set(hashes[:4]), set(hashes[8:10]), set(hashes[6:8])]
    assert {x.hash for x in steps[2].collect()} == {*hashes[6:8], hashes[10]}  # the last one only finds itself
