"""The steps of the staged build at size: what is audited once, set apart first, or met by key; each is compared with the plain way."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import aggregates as A
from tessera.operators import audit as Q
from tessera.operators import curate as C
from tessera.plans import staged as S
from tessera.sources import pages as W
from tessera.sources.shared import exists, new_path


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_a_stopped_gate_computes_the_audits_once(spark, monkeypatch):
    ran, audits = [], S.audits
    monkeypatch.setattr(S, "audits", lambda tables: ran.append(1) or audits(tables))
    made = [("a", "N1", "ja", 1, 1, 1), ("b", "N1", "en", 2, 1, 1)]
    card = S.ingest({"payload_card": spark.createDataFrame(made, "card_id string, number string, language string, level long, dp long, play_cost long")})["raw"]
    sources = {
        "payload_card": card, "release": spark.createDataFrame([("r", "R", dt.date(2024, 1, 1), "set")], "release_id string, name string, date date, genre string"),
        "card_release": spark.createDataFrame([("a", "r")], "card_id string, release_id string"),
    }
    folder = new_path(spark, "build")
    with pytest.raises(S.BuildStopped) as stop:
        S.build_staged(spark, sources, folder)
    assert exists(spark, f"{folder}/audit/found/_SUCCESS") and not exists(spark, f"{folder}/gate/accepted/_SUCCESS")
    plan = stop.value.findings._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # findings are read, not computed
    allowed = spark.createDataFrame([("values", "N1")], "audit string, finding string")
    out = S.build_staged(spark, sources | {"allowed": allowed}, folder)
    assert [tuple(r) for r in out["accepted"].collect()] == [("values", "N1")] and len(ran) == 1


def test_only_asked_elements_are_gathered():
    html = "<html><head><title>a &lt; b</title></head><body><article><p>one <b>two</b><p>three</article><p>four<br>five<script>no</script><title>six</title>"
    every = W.elements(html)
    for ends in (["head/title"], ["p"], ["article/p", "b"], ["html"], ["p/b", "title"], ["body/article/p"], ["nothing/p"], ["x/html"], []):
        asked = [(path, text) for path, text in every if any(path == e or path.endswith("/" + e) for e in ends)]
        assert W.elements(html, ends) == asked
    tree = W._Tree(["head/title"])
    tree.feed(html)
    assert [path for path, _ in tree.found] == ["html/head/title"] and not tree.open


def test_single_variants_are_set_apart(spark):
    r = random.Random(5)
    made = [(i, r.choice([None, "a", "b", *(f"k{x}" for x in range(60))]), r.choice([None, 0, 1, 2])) for i in range(150)]
    df = spark.createDataFrame(made, "i int, g string, own int")
    plain = A.number_variants(df, ["g"], ["i"], "own", F.col("i") % 2 == 0)
    apart = A.number_variants(df, ["g"], ["i"], "own", F.col("i") % 2 == 0, mostly_single=True)
    assert apart.columns == plain.columns and apart.schema["variant"].dataType == plain.schema["variant"].dataType and _rows(apart) == _rows(plain)
    assert sum(1 for x in df.groupBy("g").count().collect() if x["count"] == 1) > 3


def test_suffixes_need_no_window(spark):
    made = [(1, "g", "x ACE"), (2, "g", "y"), (3, "g", None), (4, None, "z ACE"), (5, None, "w"), (6, "h", "v"), (7, "h", None), (8, "i", None)]
    df = spark.createDataFrame(made, "id int, g string, name string")
    flag = F.max(F.col("name").endswith("ACE")).over(Window.partitionBy("g"))
    plain = df.withColumn("name", F.when(flag & ~F.col("name").endswith("ACE"), F.concat("name", F.lit(" ACE"))).otherwise(F.col("name")))
    out = A.group_suffix(df, "g", "name", "ACE")
    assert _rows(out) == _rows(plain) and "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_audits_of_whole_numbers_and_of_lonely_rows(spark):
    made = [(1, "a", "ja", 1, None), (2, "a", "en", 1, None), (3, "b", "ja", 1, 2), (4, "b", "en", 2, 2), (5, "c", "en", None, 3), (6, "c", "ja", 7, 3), (7, None, "en", 1, 1), (8, "d", "ja", 1, 1), (9, "e", "ko", 1, 1), (10, "f", None, 1, 1), (11, "g", "en", 1, 1), (12, "g", "en", 1, 1)]
    df = spark.createDataFrame(made, "id int, number string, language string, x long, y int")
    plain = Q.audit_values(df.select("number", *[F.col(c).cast("string").alias(c) for c in ("x", "y")]), ["x", "y"])
    assert _rows(Q.audit_values(df, ["x", "y"])) == _rows(plain) and len(_rows(plain)) == 2
    assert sorted(map(tuple, Q.audit_lonely(df).collect()), key=str) == [("e", "ko"), (None, "en")]


def test_many_errata_meet_texts_by_key(spark):
    df = spark.range(400).select(F.concat(F.lit("n"), (F.col("id") % 100).cast("string")).alias("k"), F.concat(F.lit("Word "), F.col("id").cast("string"), F.lit("  END")).alias("text"))
    errata = spark.range(120).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("x\nword "), (F.col("id") + 200).cast("string"), F.lit(" end"))).otherwise("missing").alias("correction"))
    one = Q.audit_errata(df, errata, ["k"], ["text"])
    keyed, passes = Q.audit_errata(df, errata, ["k"], ["text"], 500), Q.audit_errata(df, errata, ["k"], ["text"], 500, most_rows=1)
    assert _rows(one) == _rows(keyed) == _rows(passes) and len(_rows(one)) == 34
    scans = lambda out: out._jdf.queryExecution().optimizedPlan().toString().count("Word ")
    assert scans(keyed) <= scans(one) < scans(passes)  # texts are read once, whatever there is to correct


def test_tokens_and_rules_of_few_texts(spark):
    made = [("a", "N", "en", "[Your Turn] One. {X}", None), ("b", "N", "ja", "【自分のターン】", "《進化》 [B]"), ("c", "N", "en", "none", None), ("d", "M", "ko", None, None), ("e", "M", "xx", "[Q]", None), ("f", "M", "en", "⟨Rule⟩ Trait: [T]", "“z”")]
    card = spark.createDataFrame(made, "card_id string, number string, language string, effect string, more string")
    ranks = spark.createDataFrame([("N", "1"), ("M", "2")], "group string, rank string")
    seeds = spark.createDataFrame([("Your Turn", "timing")], "text string, kind string")
    icons = C.extract_icons(card, ["effect", "more"], "card_id", "number", ranks, seeds)
    assert {(r.card_id, r.field, r["index"], r.text) for r in icons.collect()} == {
        ("a", "effect", 0, "[Your Turn]"), ("a", "effect", 1, "{X}"), ("b", "effect", 0, "【自分のターン】"), ("b", "more", 0, "《進化》"), ("b", "more", 1, "[B]"),
        ("f", "effect", 0, "⟨Rule⟩"), ("f", "effect", 1, "[T]"), ("f", "more", 0, "“z”"),
    }
    rules = C.extract_rules(card, {"Trait:": "trait"}, spark.createDataFrame([("T", "form")], "token string, type string"))
    assert [tuple(r) for r in rules.collect()] == [("f", 0, "form", "T", None)]
