"""The staged build: gates stop it, and it goes on from what is written; corrections of dual records; the slugs of names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import curate as C
from tessera.plans import staged as S
from tessera.sources import io as IO
from tessera.sources.shared import exists, new_path, qualified, shared_folder


def _cards(spark, rows):
    schema = IO.empty(spark, "card").schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


@pytest.fixture
def sources(spark):
    pages = spark.createDataFrame([(1, "<html><head><title>Page &amp; card</title></head><body><article><p>[Your Turn] One.</p><p>Two.</p></article></body></html>"), (2, None)], "page_id long, html string")
    pages = pages.withColumns({"card_id": F.concat(F.lit("p"), F.col("page_id").cast("string")), "number": F.concat(F.lit("P-"), F.col("page_id").cast("string")), "language": F.lit("ja")})
    image = lambda x: ("ja", x, None)
    made = [
        {"card_id": "a1", "number": "N1", "language": "ja", "level": 4, "use_cost": 2, "effect": "One … text", "image": image("i1"), "notes": "n1", "dual": ("D", None, 1, "Dual One text", ["red"])},
        {"card_id": "a2", "number": "N1", "language": "ja", "level": 4, "effect": "One text", "image": image("i1"), "notes": "n2"},
        {"card_id": "b1", "number": "N1", "language": "en", "level": 5, "effect": "Two text", "dual": ("D", None, 1, "One text", ["blue", "green"])},
        {"card_id": "c1", "number": "N1", "language": "ko", "use_cost": 9, "effect": "x"},
    ]
    return {
        "page_card": S.cards_from_pages(pages, {"name": "head/title", "effect": "article/p"}), "payload_card": _cards(spark, made),
        "requirement": spark.createDataFrame([("a1", 0, 7), ("b1", 0, 8), ("p1", 0, 9)], "card_id string, index long, cost int"),
        "errata": spark.createDataFrame([("N1", "en", dt.date(2024, 1, 1), "One…\nTwo", "Uno\nDue")], "number string, language string, date date, error string, correction string"),
        "release": spark.createDataFrame([("r", "R", dt.date(2024, 1, 1), "set")], "release_id string, name string, date date, genre string"),
        "card_release": spark.createDataFrame([("a1", "r")], "card_id string, release_id string"),
        "saved": spark.createDataFrame([("b1", "old", "kept"), ("z", "gone", None)], "card_id string, name string, notes string"),
    }


def test_a_gate_stops_the_build_and_it_goes_on_from_there(spark, sources, monkeypatch):
    folder = new_path(spark, "build")
    with pytest.raises(S.BuildStopped) as stop:
        S.build_staged(spark, sources, folder)
    assert stop.value.counts == {"values": 1} and [tuple(r) for r in stop.value.findings.collect()] == [("values", "N1")]
    assert exists(spark, f"{folder}/correct/corrected/_SUCCESS") and not exists(spark, f"{folder}/derive/icon/_SUCCESS")
    ran = []
    monkeypatch.setattr(S, "ingest", lambda tables: ran.append("ingest"))
    allowed = spark.createDataFrame([("values", "N1")], "audit string, finding string")
    out = S.build_staged(spark, sources | {"allowed": allowed}, folder)
    assert not ran
    card = {r.card_id: r for r in out["card"].collect()}
    assert set(card) == {"a1", "b1", "c1", "p1", "p2", "z"}
    assert card["a1"].notes == "n1\nn2" and (card["c1"].level, card["c1"].use_cost, card["b1"].level) == (4, 2, 5)
    assert card["b1"].dual.colors == ["red"] and card["b1"].dual.effect == "Uno text" and card["b1"].effect == "Two text"
    assert card["b1"].notes == "kept" and card["b1"].name == "old" and card["z"].name == "gone"
    assert card["p1"].name == "Page & card" and card["p1"].effect == "[Your Turn] One." and card["p2"].name is None
    assert sorted((r.card_id, r.cost) for r in out["requirements"].collect()) == [("a1", 7), ("b1", 7), ("c1", 7), ("p1", 9)]
    assert [tuple(r) for r in out["accepted"].collect()] == [("values", "N1")]


def test_a_stage_half_written_is_run_again(spark):
    folder, ran = new_path(spark, "build"), []

    def make(tables):
        ran.append(1)
        return {"a": spark.range(2), "b": spark.range(3)}

    spark.range(1).write.parquet(f"{folder}/s/a")
    out = S.run_stages(spark, [S.Stage("s", ["a", "b"], make)], {}, folder)
    assert (out["a"].count(), out["b"].count(), len(ran)) == (2, 3, 1)
    assert S.run_stages(spark, [S.Stage("s", ["a", "b"], make)], {}, folder)["b"].count() == 3 and len(ran) == 1


def test_errata_of_dual_records(spark):
    made = [
        (1, "old words here", ("D", "other old words")), (2, "nothing", ("D", "new words, old words")), (3, "nothing", ("D", "old words")), (4, None, ("D", "old words")),
        (5, "second line", ("D", "old words and second line")), (6, "old words", None), (7, "second line", None),
    ]
    df = spark.createDataFrame(made, "id int, effect string, dual struct<name:string,effect:string>")
    errata = df.select("id", F.lit("…old words…\n second line ").alias("error"), F.lit("new words\nSECOND…").alias("correction"))
    got = {r.id: (r.effect, r.dual and r.dual.effect) for r in C.apply_errata(df, errata, ["id"], ["effect"], part="dual").collect()}
    # the first line that either text holds is the one; what is there already isn't put in again
    assert got == {
        1: ("new words here", "other new words"), 2: ("nothing", "new words, old words"), 3: ("nothing", "new words"), 4: (None, "old words"),
        5: ("second line", "new words and second line"), 6: ("new words", None), 7: ("SECOND", None),
    }
    titles = {"[Effect]": "effect", "[Name]": "name"}
    titled = df.select("id", F.lit("[Name]\nold words\n[Effect]\nsecond line").alias("error"), F.lit("[Name]\nX\n[Effect]\nY").alias("correction"))
    got = {r.id: (r.effect, r.dual and r.dual.effect) for r in C.apply_errata(df.withColumn("name", F.lit("n")), titled, ["id"], ["name", "effect"], titles, "dual").collect()}
    assert got[1] == ("old words here", "other old words") and got[5] == ("Y", "old words and Y")


def test_shared_folder(spark):
    assert qualified(spark, "/tmp/x/") == "file:///tmp/x" and qualified(spark, "hdfs://h/a/") == "hdfs://h/a"
    assert shared_folder(spark).startswith("file:///")


def test_upsert_rewrites_only_the_buckets_it_touches(spark):
    import os

    path = new_path(spark, "table")
    base = spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.array((F.col("id") % 3).cast("int")).alias("m"))
    IO.write_buckets(base, path, "k", 64)
    files = lambda: {f"{d}/{f}" for d, _, names in os.walk(path.removeprefix("file://")) for f in names if f.endswith(".parquet")}
    before = files()
    delta = spark.createDataFrame([(5, None, [9], "x"), (77, 100, None, "y"), (123_456, 1, [2], None)], "k long, v long, m array<int>, extra string")
    touched = IO.upsert_buckets(spark, path, delta, "k", 64, ["m"])
    assert 1 <= len(touched) <= 3
    assert len(before & files()) == 64 - len(touched)
    kept = {f for f in before & files()}
    assert not any(f"__bucket={b}/" in f for f in kept for b in touched)
    plain = IO.upsert(base, delta, "k", ["m"])
    rows = lambda df: sorted(map(repr, df.select("k", "v", "m", "extra").collect()))
    assert rows(IO.read_buckets(spark, path)) == rows(plain)
    assert IO.upsert_buckets(spark, path, delta.where("false"), "k", 64) == []
    assert IO.upsert_buckets(spark, path, delta, "k", 64, ["m"]) == touched  # again: nothing new
    assert rows(IO.read_buckets(spark, path)) == rows(plain)


def test_slugs_of_other_scripts(spark):
    from tessera.functions.text import slugify, transliterate

    names = {
        "デジモン": "dejimon", "ブースターパック【BT-1】": "busutapakku-bt-1", "シャッチー": "shatchi", "ティラノモン": "tiranomon", "ヴァルキリモン": "varukirimon", "とっきゅう きょうと": "tokkyuu-kyouto", "あんい": "ani",
        "디지몬 카드": "dijimon-kadeu", "한글 값": "hangeul-gabs", "Name É [BT-5] Ver.1.0": "bt-5-v1.0", "Plain Name": "plain-name", "宣传卡P": "p", "a~^b": "a-b", "ッ": "", "": "",
    }
    df = spark.createDataFrame([(k,) for k in [*names, None]], "s string")
    assert {r.s: r.slug for r in df.select("s", slugify(F.col("s")).alias("slug")).collect()} == names | {None: ""}
    assert df.select(transliterate(F.lit("ッ ~ー")).alias("x")).first().x.strip() == "-"


def test_the_catalog_normalises_texts_once(spark, monkeypatch):
    from tessera.plans import build as B

    made = [{"card_id": f"a{i}", "number": f"N{i // 2}", "language": ("ja", "en")[i % 2], "parallel_id": 0, "level": 1, "effect": "Ｘ １ [Your Turn] one．．"} for i in range(6)]
    card = _cards(spark, made)
    sources = {"card": card, "release": spark.createDataFrame([("r", dt.date(2024, 1, 1))], "release_id string, date date"), "card_release": spark.createDataFrame([("a1", "r")], "card_id string, release_id string")}
    out = B.build_catalog(sources)
    lazy = B.build_catalog(sources, lambda df, name: df)
    for name in ("card", "icon", "rule"):
        assert sorted(map(repr, out[name].collect())) == sorted(map(repr, lazy[name].collect()))
    for name in ("card", "icon"):
        plan = out[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "translate(" not in plan and "regexp_extract_all" not in plan
    assert out["card"].first().effect == "X 1 [Your Turn] one．．"
