"""Places and neighbours inside a key that holds most rows: the results of a plain window, without one task a key."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import aggregates as A
from tessera.operators import places as P
from tessera.operators.audit import audit_errata


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    made = [(r.choice(["hot", "hot", "hot", "a", None, "b"]), i, r.choice([None, None, 1, 2]), r.choice("xy")) for i in range(3000)]
    r.shuffle(made)
    return spark.createDataFrame(made, "k string, o int, v int, t string").repartition(5).cache()


def _all(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_place(rows):
    w = Window.partitionBy("k").orderBy("o")
    plain = rows.withColumn("n", F.row_number().over(w).cast("long"))
    assert _all(P.place(rows, ["k"], ["o"], "n", 100)) == _all(plain) == _all(P.place(rows, ["k"], ["o"], "n"))


def test_previous(rows):
    plain = rows.withColumn("p", F.lag(F.struct("v", "t")).over(Window.partitionBy("k").orderBy("o")))
    assert _all(P.previous(rows, ["k"], ["o"], ["v", "t"], "p", 100)) == _all(plain)


def test_last_known(rows):
    rare = rows.withColumn("v", F.when(F.col("o") % 700 == 3, F.col("o")))  # whole parts without a value
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    plain = rare.withColumn("v", F.last("v", ignorenulls=True).over(w))
    assert _all(A.fill_forward(rare, "v", ["o"], ["k"], 100)) == _all(plain)


def test_a_hot_key_is_spread(rows):
    cut = P.parted(rows, ["k"], ["o"], 200)
    sizes = [x["count"] for x in cut.groupBy("k", P.PART).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 600
    borders = P._borders(cut, ["k"], {"__n": F.count("*")}, {"__before": F.sum("__n")})
    assert borders.count() <= 2 * cut.select(P.PART).distinct().count()


def test_operators_on_it(rows):
    exempt = rows.where("k = 'a'").select("k")
    given = rows.withColumn("index", F.col("o"))
    assert _all(A.reindex(given, ["k"], ["o"], exempt, rows=100)) == _all(A.reindex(given, ["k"], ["o"], exempt))
    assert _all(A.adjacent_diff(rows, ["k"], ["o"], ["v", "t"], 100)) == _all(A.adjacent_diff(rows, ["k"], ["o"], ["v", "t"]))
    first = {x.k: x.o for x in rows.groupBy("k").agg(F.min("o").alias("o")).collect()}
    blank = {x.o: x.k for x in A.blank_repeats(rows, "k", ["o"]).collect()}
    assert len(blank) == 3000 and {k: o for o, k in blank.items() if k} == {k: o for k, o in first.items() if k}


def test_empty(spark, rows):
    none = rows.limit(0)
    assert P.place(none, ["k"], ["o"], "n", 1).count() == P.previous(none, ["k"], ["o"], ["v"], "p", 1).count() == 0


def test_merged_notes_are_bounded_by_different_ones(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("o"), F.concat(F.lit("n"), (F.col("id") % 3).cast("string")).alias("n"), F.array((F.col("id") % 5).cast("string")).alias("m"))
    out = A.merge_duplicates(df, "k", "o", "n", "m").collect()
    assert [(x.o, x.n, x.m) for x in out] == [(0, "n0\nn1\nn2", ["0", "1", "2", "3", "4"])]
    plan = A.merge_duplicates(df, "k", "o", "n", "m")._jdf.queryExecution().optimizedPlan().toString()
    # what is gathered has been reduced to different notes and values before
    assert plan.count("Aggregate [") == 3 and plan.index("collect_list") < plan.index("Union")


def test_errata_move_no_text(spark):
    docs = spark.createDataFrame([(i, "s" if i % 3 else None, f"word {i} of  Text") for i in range(50)], "id int, k string, text string")
    errata = spark.createDataFrame([("s", "WORD 4\nnothing"), ("s", "nothing\n"), ("s", "of text"), ("t", "word"), ("s", None)], "k string, correction string")
    expected = {"nothing\n", None}
    for most in (1 << 20, 40):  # one pass, and several
        out = audit_errata(docs, errata, ["k"], ["text"], most)
        assert {x.correction for x in out.collect()} == expected
    plan = audit_errata(docs, errata, ["k"], ["text"])._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert not ("Exchange" in line and "text" in line)
