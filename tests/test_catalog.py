"""The catalog build end to end on a small set of cards, and cases that tables of the driver don't have."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import search as S
from tessera.operators.search import Predicate as P
from tessera.plans.build import build_catalog
from tessera.sources import io as IO


def _rows(spark, name, rows):
    schema = IO.empty(spark, name).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


CARDS = [
    {"card_id": "c1", "number": "BT1-001", "language": "ja", "parallel_id": None, "name": "アグ", "rarity": "C", "level": 3, "dp": 2000, "play_cost": 3, "effect": "【登場時】１枚引く。", "form": "F1", "type": "T1/T2"},
    {"card_id": "c2", "number": "BT1-001", "language": "en", "parallel_id": None, "name": "Agu", "effect": "[On Play] Draw 1. ", "form": "F1"},
    {"card_id": "c3", "number": "BT1-001", "language": "en", "parallel_id": None, "name": "Agu ACE", "effect": "[On Play] Drew 1."},
    {"card_id": "c4", "number": "BT1-002", "language": "en", "parallel_id": 2, "name": "-", "effect": "⟨Rule⟩ You can include up to 50 copies Name: [X] Trait: [T1]", "play_cost": 9},
    {"card_id": "c5", "number": "BT1-003", "language": "ko", "parallel_id": 1, "name": "K"},
    {"card_id": "c6", "number": "BT1-003", "language": "ko", "parallel_id": 1, "name": "K"},
]


def test_build_catalog(spark):
    sources = {
        "card": _rows(spark, "card", CARDS),
        "patch": _rows(spark, "patch", [{"number": "BT1-002", "language": "en", "field": "name", "op": "set", "new": "Bel"}]),
        "errata": _rows(spark, "errata", [{"number": "BT1-001", "language": "en", "date": dt.date(2024, 1, 1), "error": "Drew 1", "correction": "Draw 1"}]),
        "release": _rows(spark, "release", [{"release_id": "r1", "name": "R", "date": dt.date(2023, 5, 1)}]),
        "card_release": _rows(spark, "card_release", [{"card_id": "c2", "release_id": "r1"}]),
        "rule_revision": _rows(spark, "rule_revision", [{"number": "BT1-003", "language": "ko", "before": "x", "after": "y"}]),
    }
    out = build_catalog(sources)
    card = {r.card_id: r for r in out["card"].collect()}
    assert (card["c2"].parallel_id, card["c3"].parallel_id, card["c4"].parallel_id, card["c6"].parallel_id) == (0, 1, 2, 2)
    assert card["c2"].level == 3 and card["c2"].play_cost == 3  # from the canonical row
    assert card["c4"].name == "Bel"  # a placeholder, then a patch
    assert card["c2"].name == "Agu ACE"  # the group's suffix
    assert card["c3"].effect == "[On Play] Draw 1." and "1枚" in card["c1"].effect
    rules = sorted((r.type, r.value, r.allowance) for r in out["rule"].where("card_id = 'c4'").collect() if r.type != "limit")
    assert rules == [("name", "X", None), ("type", "T1", None)]
    assert out["rule"].where("type = 'limit'").first().allowance == 50
    icons = {r.card_id: r.kind for r in out["icon"].where("index = 0").collect()}
    assert icons["c1"] == "timing" and icons["c2"] == "timing"  # learned from the Japanese card


def test_negation_is_universal_or_existential(spark):
    df = spark.createDataFrame([(1, "ab", "x"), (2, "a", "a"), (3, "x", "y"), (4, None, None)], "id int, name string, number string")
    ids = lambda *p: sorted(r.id for r in S.search(df, p, None)[0].collect())
    assert ids(P("name", ":", "a", negate=True)) == [3, 4]
    assert ids(P("word", ":", "a", negate=True)) == [1, 3]
    assert ids(P("word", ":", "a", negate=True, mode="none")) == [3, 4]


def test_null_text_never_matches(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "d")], "id int, effect string")
    hits, errors = S.search(df, [P("effect", ":", "b", negate=True), P("nothing", ":", 1), P("effect", "~", "x")], None)
    assert [r.id for r in hits.collect()] == [3]
    assert sorted(r.attribute for r in errors.collect()) == ["effect", "nothing"]


def test_unsigned_hashes(spark):
    from tessera.functions.hashing import from_unsigned, hash_bands, unsigned

    df = spark.createDataFrame([("18446744073709551615",), ("9223372036854775808",), ("5",)], "d string")
    row = df.select("d", unsigned(from_unsigned(F.col("d"))).alias("u"), hash_bands(from_unsigned(F.col("d"))).alias("b")).collect()
    assert all(r.d == r.u for r in row)
    assert row[0].b == [255] * 8 and row[1].b == [128] + [0] * 7


def test_bulk_export_and_inventory(spark, tmp_path):
    df = spark.createDataFrame([(1, "en"), (2, "ja")], "id int, language string")
    IO.bulk_export(df, f"{tmp_path}/bulk", "language")
    assert spark.read.json(f"{tmp_path}/bulk/by").count() == 2
    assert IO.list_exports(spark, f"{tmp_path}/bulk/all").where("size > 0").count() >= 1


def test_dates(spark):
    from tessera.functions.text import iso_date, parse_date

    df = spark.createDataFrame([("August 1st, 2024", "2024年8月1日"), ("Aug 2, 2024", "2024.8.2"), ("August 2024", "2024年8月"), ("soon", "")], "en string, ja string")
    got = df.select(iso_date(parse_date(F.col("en"), "en")).alias("en"), iso_date(parse_date(F.col("ja"), "ja")).alias("ja")).collect()
    assert [(r.en, r.ja) for r in got] == [("2024-08-01", "2024-08-01"), ("2024-08-02", "2024-08-02"), ("2024-08-01", "2024-08-01"), (None, None)]


def test_releases_named_in_notes(spark):
    from tessera.operators.joins import refs_to_release

    release = spark.createDataFrame(
        [("BT1", "Booster One", "2024-02-01", True), ("BT1", "Booster one again", "2024-01-01", False), ("Ver.1.5BT2", "Booster Two", None, True), (None, "", "2020-01-01", True), ("X", "Limited Card Pack 3", "2024-01-01", True)],
        "code string, name string, date string, listed boolean",
    )
    notes = ["see [BT-01]", "Ver.1.5 [BT-2]", "[BT-2]", "BOOSTER", "booster two", "b", "Limited card pack", "", None, "Booster Three", "[BT-01] and [BT1]"]
    rows = spark.createDataFrame([(i, n, "own") for i, n in enumerate(notes)], "card_id long, notes string, release string")
    got = {r.card_id: r.releases for r in refs_to_release(rows, release).collect()}
    both = ["Booster one again", "Booster One"]
    assert got == {0: both, 1: ["Booster Two"], 2: ["own"], 3: ["Booster One", "Booster Two"], 4: ["Booster Two"], 5: ["Booster One", "Booster Two"], 6: ["own"], 7: ["own"], 8: ["own"], 9: ["own"], 10: both}
    assert refs_to_release(rows.limit(0), release).count() == 0
    assert all(r.releases == ["own"] for r in refs_to_release(rows, release.limit(0)).collect())


def test_members_that_others_have(spark):
    from tessera.operators.aggregates import missing_members

    rows = [("g", "ja", "x"), ("g", "ja", "x"), ("g", "en", "x"), ("g", "ja", "y"), ("g", "ko", "z"), ("g", "ko", "x"), ("h", "ja", "x"), (None, "ja", "x")]
    got = {tuple(r) for r in missing_members(spark.createDataFrame(rows, "number string, language string, member string"), "number", "language", "member").collect()}
    assert got == {("g", "en", "y"), ("g", "ko", "y"), ("g", "ja", "z"), ("g", "en", "z")}


def test_numbers_of_a_deck(spark):
    from tessera.operators.decks import validate_decks

    numbers = ["BT1-001", "ST10-02", "P-001", "ABCDE-01", "BT1-1", "BT1-0001", "bt1-01", "", None]
    cards = spark.createDataFrame([(i, "deck", n, 1, None) for i, n in enumerate(numbers)], "deck_id long, section string, number string, count int, parallel_id int")
    assert {r.deck_id for r in validate_decks(cards).where("problem = 'number'").collect()} == {3, 4, 5, 6, 7, 8}
