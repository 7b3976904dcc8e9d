"""Golden codes of each version, bad codes, and generated decks."""

import random

from tessera.operators import decks as D

#: Codes of versions 1 to 5 (fixed values).
CODES = (
    "DCGETsdnJ0BQQMBnJ0BTwMCAwEDAQMBAwEBAQMBAwEBAQEBAwEDAQMBAQEBAVN0YXJ0ZXIgRGVjaywgR2FpYSBSZWQgW1NULTFd",
    "DCGIkA_B4udAoEDAZydAUEAAYudAYQACQMKAQEBMQSLnQKBAxABi50DhQMIAwUCAwECAwGLnQOBAhgEnJ0BRgMCAwECAwABAiABCV9fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fXw",
    "DCGOkA_B4udAoEDAZydAUEAAYudAYQACQMKAQEBMQSLnQKBAxABi50DhQMIAwUCAwECAwGLnQOBAhgEnJ0BRgMCAwECAwABAiABCV9fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fXw",
    "DCGQsA_h4udAoEDAZydAUEAAYudAYQACQMKAQEBMQSLnQKBAxABi50DhQMIAwUCAwECAwGLnQOBAhgEnJ0BRgMCAwECAwABAiABCUJBQ0stMDAxX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fXw",
    "DCGUsD_h4udAoEDAZydAUEAAYudAYQACQMKAQEBMQSLnQKBAxABi50DhQMIAwUCAwECAwGLnQOBAhgEnJ0BRgMCAwECAwABAiABCUJBQ0stMDAxX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fX19fXw",
)
CARDS = "array<struct<number:string,count:int,parallel_id:int>>"


def test_golden_codes_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(CODES)), "i int, code string")
    rows = {r.i: r for r in D.parse_decks(df, "code").collect()}
    assert [rows[i].version for i in range(5)] == [1, 2, 3, 4, 5]
    assert all(r.error is None for r in rows.values())
    assert [tuple(c) for c in rows[0].digi_eggs] == [("ST1-01", 4, 0)] and len(rows[0].deck) == 15
    assert (rows[3].icon, rows[4].language, len(rows[4].sideboard)) == ("BACK-001", "ko", 7)
    schema = f"i int, name string, icon string, language string, digi_eggs {CARDS}, deck {CARDS}, sideboard {CARDS}"
    for i, code in enumerate(CODES):
        r = rows[i]
        one = spark.createDataFrame([(i, r.name, r.icon, r.language, r.digi_eggs, r.deck, r.sideboard)], schema)
        assert D.encode_decks(one, i + 1).first().code == code


def test_bad_codes_have_an_error(spark):
    df = spark.createDataFrame([("XX",), ("DCG!!",), (CODES[4][:19],), (None,), ("DCG8wAA",)], "code string")
    assert [r.error for r in D.parse_decks(df, "code").collect()] == ["prefix", "base64", "checksum", "prefix", "version"]


def test_generated_decks_round_trip(spark):
    r = random.Random(11)
    decks = []
    for i in range(40):
        cards = {(f"{r.choice(['BT', 'EX', 'P'])}{r.randint(1, 20)}-{r.randint(1, 999):03d}", r.randint(0, 7)): r.randint(1, 50) for _ in range(r.randint(1, 70))}
        rows = [(n, c, v) for (n, v), c in cards.items()]
        decks.append((i, f"é deck {i}", "ja", rows[:3], rows[3:]))
    df = spark.createDataFrame(decks, f"i int, name string, language string, digi_eggs {CARDS}, deck {CARDS}")
    codes = [(x.i, x.code) for x in D.encode_decks(df).select("i", "code").collect()]
    back = {x.i: x for x in D.parse_decks(spark.createDataFrame(codes, "i int, code string"), "code").collect()}
    key = lambda rows: sorted((a, v or 0, n) for a, n, v in (tuple(x) for x in rows))
    for i, name, language, eggs, deck in decks:
        assert (back[i].name, back[i].language, back[i].error) == (name, language, None)
        assert key(back[i].digi_eggs) == key(eggs) and key(back[i].deck) == key(deck)


def test_decks_are_neither_folded_nor_written_wrongly(spark):
    df = spark.createDataFrame([(1, [("BT1-001", 4, None)]), (2, [("BT1-00001", 4, 0)]), (3, [("BT1-001", 300, 0)]), (4, [("bt1-001", 1, 0), ("BT1-001", 1, 0)]), (5, None), (6, [("A-B-01", 1, 0)])], f"i int, deck {CARDS}")
    codes = D.encode_decks(df)
    assert {r.i for r in codes.collect() if r.code is not None} == {1, 5}  # no code rather than another deck's
    # a byte's step isn't an expression: it took several microseconds, and all bytes were decoded anew for each
    plan = D.decode_decks(codes, "code")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "aggregate(" not in plan
    long = [("ST1-01", 1 + i % 4, i % 8) for i in range(8)] + [(f"BT{i % 30}-{i % 999:03d}", 1, i % 7) for i in range(20_000)]
    back = D.parse_decks(D.encode_decks(spark.createDataFrame([(1, long)], f"i int, deck {CARDS}")), "code").first()
    assert back.error is None and sorted(tuple(x) for x in back.deck) == sorted(long)
