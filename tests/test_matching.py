"""Matching operators against brute force, and what their plans and sizes must not be."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.streaming import votes as V

SIGN = 1 << 63


def _signed(h):
    return h - (1 << 64) if h >= SIGN else h


def _bits(a, b):
    return bin((a ^ b) & ((1 << 64) - 1)).count("1")


def _hashes(r, n, bases=12, most=14):
    """Hashes near one of a few, copies among them."""
    near = [r.getrandbits(64) for _ in range(bases)]
    out = []
    for _ in range(n):
        h = r.choice(near)
        for b in r.sample(range(64), r.choice([0, 0, 1, 3, 6, 9, 11, 12, most])):
            h ^= 1 << b
        out.append(_signed(h))
    return out


@pytest.mark.parametrize(("most", "own"), [(11, True), (11, False), (5, False), (0, True), (14, False)])
def test_nearest_hash_is_brute_force(spark, most, own):
    r = random.Random(most)
    index = [(i, h, i % 3) for i, h in enumerate(_hashes(r, 240))] + [(1000, None, 1), (1001, 5, None)]
    asked = [t for t in index if t[0] % 4 == 0] + [(2000, None, 1)]
    df = lambda rows: spark.createDataFrame(rows, "id long, hash long, block int")
    got = {(x.id, x.match, x.distance) for x in J.nearest_hash(df(asked), df(index), ["block"], most, own).collect()}
    expected = set()
    for i, h, block in asked:
        found = [(_bits(h, k), m) for m, k, b in index if None not in (h, k, block, b) and b == block and (own or m != i)]
        if found and min(found)[0] <= most:
            expected.add((i, min(found)[1], min(found)[0]))
    assert got == expected


def test_probing_meets_few_pairs_of_far_hashes(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(_signed(r.getrandbits(64)), 0) for _ in range(3000)], "hash long, block int")
    left, right = df.limit(400), df.withColumnRenamed("hash", "__h")
    # what the join makes before the distance is looked at
    probes = left.select(F.explode(F.flatten(F.transform(F.arrays_zip(F.sequence(F.lit(0), F.lit(3)).alias("k"), J._parts(F.col("hash")).alias("v")), lambda p: F.transform(F.array(*[F.lit(m) for m in J._neighbours(16, 2)]), lambda m: F.struct(p["k"].alias("k"), p["v"].bitwiseXOR(m).alias("v")))))).alias("p"))
    held = right.select(F.posexplode(J._parts(F.col("__h"))).alias("k", "v")).select(F.struct("k", "v").alias("p"))
    assert len(J._neighbours(16, 2)) == 137
    assert probes.join(held, "p").count() < 0.02 * 400 * 3000


def test_copies_of_a_hash_make_no_pairs(spark):
    df = spark.range(3000).select("id", F.lit(7).cast("long").alias("hash"), F.lit(1).alias("block"))
    got = J.nearest_hash(df, df, ["block"], 11, own=False)
    assert got.count() == 3000 and got.where("match = case when id = 0 then 1 else 0 end and distance = 0").count() == 3000


@pytest.mark.parametrize("tile", [3, 1 << 14])
def test_band_join_in_tiles(spark, tile):
    r = random.Random(5)
    index, asked = list(enumerate(_hashes(r, 90))), list(enumerate(_hashes(r, 50, most=20)))
    index += [(100 + i, index[0][1]) for i in range(20)]
    df = lambda rows: spark.createDataFrame(rows, "id long, hash long")
    got = [(x.id, x.match, x.distance) for x in J.band_join(df(asked), df(index), 16, tile).collect()]
    byte = lambda a, b: any(((a ^ b) >> k) & 255 == 0 for k in range(0, 64, 8))
    every = {(a, b, _bits(x, y)) for a, x in asked for b, y in index if byte(x, y) and _bits(x, y) <= 16}
    assert len(got) == len(set(got)) and set(got) == every


def test_a_tile_bounds_what_meets_at_one_byte(spark):
    banded = spark.range(4000).select("id", F.lit(0).alias("place"), F.lit(9).alias("byte"))
    left, right = J._tiled(banded.withColumnRenamed("id", "q"), banded.withColumnRenamed("id", "i"), ["place", "byte"], 500)
    keys = ["place", "byte", "__i", "__j"]
    sizes = left.groupBy(*keys).count().join(right.groupBy(*keys).agg(F.count("*").alias("n")), keys).select("count", "n").collect()
    assert len(sizes) == 64 and max(max(x) for x in sizes) < 1000
    assert left.join(right, keys).count() == 4000 * 4000


def test_frames_meet_a_tiled_index(spark):
    r = random.Random(8)
    index = list(enumerate(_hashes(r, 60))) + [(100 + i, 77) for i in range(30)]
    asked = [(i, h) for i, (_, h) in enumerate(index[:75:3])]
    frames = spark.createDataFrame(asked, "session long, hash long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    candidates = spark.createDataFrame(index, "candidate long, hash long")
    plain = {(x.session, x.candidate, x.distance) for x in V.match_stream(frames, candidates).collect()}
    tiled = [(x.session, x.candidate, x.distance) for x in V.match_stream(frames, candidates, tile=4).collect()]
    assert len(tiled) == len(set(tiled)) and set(tiled) == plain and len(plain) > 30


@pytest.mark.parametrize("piece", [1, 3, 5])
def test_containment_is_brute_force(spark, piece):
    r = random.Random(piece)
    word = lambda n: "".join(r.choice("abあ") for _ in range(n))
    a = [word(r.randint(1, 9)) for _ in range(60)] + ["", None]
    b = [word(r.randint(1, 5)) for _ in range(60)] + ["", None, a[0]]
    df = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    got = sorted((x.a, x.b) for x in J.match_by_containment(df(a, "a"), df(b, "b"), "a", "b", piece).collect())
    assert got == sorted((x, y) for x in a for y in b if x and y and (x in y or y in x))


def test_containment_has_no_nested_loop(spark):
    df = spark.range(50).select(F.concat(F.lit("name "), F.col("id").cast("string")).alias("a"))
    plan = J.match_by_containment(df, df.withColumnRenamed("a", "b"), "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_first_containing_keeps_products_alone(spark):
    products = spark.createDataFrame([(1, "Pack One【BT1】"), (2, "Deck"), (3, None)], "id int, name string")
    releases = spark.createDataFrame([(9, "Pack One", 2), (8, "One", 1), (7, "Great Deck", 3)], "rid int, rname string, place int")
    got = sorted((x.id, x.rid) for x in J.first_containing(products, releases, "name", "rname", "id", "place").collect())
    assert got == [(1, 8), (2, 7), (3, None)]


def test_sibling_groups_hold_each_row_once(spark):
    df = spark.createDataFrame([(i, "a" if i < 900 else None if i == 900 else f"b{i}", 1) for i in range(1000)], "id long, k string, n int")
    groups, members = J.sibling_groups(df, ["k", "n"], "id")
    assert members.count() == 999 and groups.count() == 100
    assert [(x.group, x.n_members) for x in groups.where("k = 'a'").collect()] == [(0, 900)]
    named = J.siblings(df, ["k", "n"], "id", spark.createDataFrame([(5,), (900,), (950,)], "id long")).collect()
    sizes = {x.id: len(x.siblings) for x in named}
    assert sizes == {5: 899, 900: 0, 950: 0}
