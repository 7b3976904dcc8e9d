"""Order-dependent operators against plain sequential restatements, on random input."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.plans import q_tables, registry


def test_number_variants_is_the_sequential_rule(spark):
    r = random.Random(7)
    rows = [(g, i, r.choice([None, 0, 1, 2, 3]), r.random() < 0.4) for g in range(60) for i in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "g int, i int, own int, again boolean")
    got = {(x.g, x.i): x.variant for x in A.number_variants(df, ["g"], ["i"], "own", F.col("again")).collect()}
    for g in range(60):
        last, given = None, []
        for _, i, own, again in sorted(x for x in rows if x[0] == g):
            if own is None:
                new = 0 if last is None else last + 1
            elif last is not None and own == last or again and own in given:
                new = last + 1
            else:
                new = own
            assert got[g, i] == new
            last = new
            given.append(new)


def test_learned_kinds_are_the_sequential_rule(spark):
    r = random.Random(3)
    tokens = []
    for g in range(25):
        for language in ("ja", "en"):
            for index in range(r.randint(0, 4)):
                tokens.append((g, language, "effect", index, f"t{r.randint(0, 9)}", r.choice(["timing", "precondition", "mention", None]) if language == "ja" else r.choice([None, None, "timing"])))
    ranks = list(range(25))
    r.shuffle(ranks)
    df = spark.createDataFrame(tokens, "group int, language string, field string, index int, text string, kind string")
    groups = spark.createDataFrame(list(enumerate(ranks)), "group int, rank int")
    seeds = spark.createDataFrame([("t0", "timing")], "text string, kind string")
    got = {(x["group"], x["language"], x["index"]): x["learned"] for x in A.learn_translations(df, groups, seeds).collect()}
    known = {"t0": "timing"}
    for g in sorted(range(25), key=lambda g: ranks[g]):
        ja = {i: kind for gg, language, _, i, _, kind in tokens if gg == g and language == "ja"}
        for gg, language, _, i, text, kind in sorted((t for t in tokens if t[0] == g), key=lambda t: t[3]):
            if language == "en" and kind is None and text not in known and ja.get(i) in ("timing", "precondition"):
                known[text] = ja[i]
        for gg, language, _, i, text, kind in tokens:
            if gg == g:
                assert got[g, language, i] == (known.get(text) if language == "en" and kind is None else None)


def test_merge_duplicates_keeps_contained_notes_once(spark):
    df = spark.createDataFrame([("a", 1, "one", ["x"]), ("a", 2, "one two", ["y", "x"]), ("a", 3, "two", []), ("b", 1, None, None)], "k string, o int, n string, m array<string>")
    got = {r.k: (r.o, r.n, r.m) for r in A.merge_duplicates(df, "k", "o", "n", "m").collect()}
    assert got["a"] == (1, "one\none two", ["x", "y"])
    assert got["b"][:2] == (1, "")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, o int, v string")
    assert A.last_per_key(none, ["k"], ["o"]).count() == 0
    assert A.most_common(none, ["k"], "v").count() == 0
    assert A.number_variants(none.withColumn("own", F.lit(None).cast("int")), ["k"], ["o"], "own").count() == 0


def test_orders_are_those_of_the_rows(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey").repartition(5)
    rows = orders.collect()
    assert [tuple(r) for r in A.order_desc(orders, "o_custkey", "o_orderkey").collect()] == sorted(map(tuple, rows), key=lambda r: (-r[1], r[0]))
    assert [r.o_orderkey for r in A.order_by_id(orders, "o_orderkey").collect()] == sorted(r.o_orderkey for r in rows)
    latest = A.latest_per_language(orders.selectExpr("o_custkey % 7 as language", "o_custkey as date", "o_orderkey as release_id")).collect()
    assert [r.latest for r in latest] == sorted((r.latest for r in latest), reverse=True)


@pytest.mark.parametrize("most", [1, 3])
def test_learned_kinds_are_the_same_by_sending_and_by_moving(spark, most):
    r = random.Random(most)
    tokens = [(g, language, "effect", index, r.choice([None, "t0", "often", "often", *map(str, range(30))]), r.choice(["timing", "mention", None]) if language == "ja" else r.choice([None, None, "timing"]), g % 7) for g in range(40) for language in ("ja", "en", None) for index in range(6)]
    df = spark.createDataFrame(tokens, "group int, language string, field string, index int, text string, kind string, rank int")
    groups, seeds = df.select("group", "rank").distinct(), spark.createDataFrame([("t0", "timing"), ("x", "mention")], "text string, kind string")
    plain = sorted(map(str, A.learn_translations(df.drop("rank"), groups, seeds).collect()))
    dealt = df.repartition(5, "group")
    assert len(plain) == len(tokens) and sum("learned='timing'" in x for x in plain) > 30
    assert sorted(map(str, A.learn_translations(df.drop("rank"), groups, seeds, most=most).collect())) == plain
    assert sorted(map(str, A.learn_translations(df, None, seeds, dealt=dealt, most=most).drop("rank").collect())) == plain


def test_learning_writes_texts_and_moves_few_tokens(spark, sf, monkeypatch):
    held, write = [], q_tables.written
    monkeypatch.setattr(q_tables, "written", lambda df, name: held.append(write(df, name)) or held[-1])
    rows = registry.queries()["n6_learn_translations"](spark, sf)
    n = rows.count()
    # one row a text, not one a token
    assert held[0].count() < n / 4 and held[0].groupBy("text").count().where("count > 1").isEmpty()
    # tokens are moved only to the texts that weren't sent to them
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and plan.count("strategy=broadcast") >= 2
