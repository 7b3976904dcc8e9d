"""Joins between records and the tables around them. Physical strategies are left to Spark; small literal tables are hinted."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.hashing import distance, hash_bands
from tessera.sources.shared import written


def cards_of_release(card: DataFrame, bridge: DataFrame, release: DataFrame, key: str = "card_id", release_key: str = "release_id") -> DataFrame:
    """Records and releases, many to many."""
    return card.join(bridge, key).join(release, release_key)


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], fallback: tuple[str, object] | None = None) -> DataFrame:
    """Df with the columns of table's row under `on`; with fallback (column, value), else those of the row under the value.

    table has one row per key.
    """
    values = [c for c in table.columns if c not in on]
    if fallback is None:
        return df.join(table, list(on), "left")
    column, value = fallback
    rest = [c for c in on if c != column]
    default = table.where(F.col(column) == value).select(*rest, F.struct(*values).alias("__default"))
    found = df.join(table.select(*on, F.struct(*values).alias("__found")), list(on), "left").join(default, rest, "left")
    chosen = F.coalesce("__found", "__default")
    return found.select(*df.columns, *[chosen[c].alias(c) for c in values])


def fill_from_canonical(df: DataFrame, key: str, is_canonical: Column, order: Sequence[Column], fill: Sequence[str], force: Sequence[str] = ()) -> DataFrame:
    """Each key's canonical row (the last in order, if several) supplies missing values of `fill` and all of `force`."""
    last = F.max_by(F.struct(*fill, *force), F.struct(*order)).alias("__last")
    canonical = df.where(is_canonical).groupBy(key).agg(last).select(key, *[F.col(f"__last.{c}").alias(f"__{c}") for c in (*fill, *force)])
    joined = df.join(canonical, key, "left")
    new = {c: F.coalesce(c, f"__{c}") for c in fill} | {c: F.coalesce(f"__{c}", c) for c in force}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def sibling_groups(df: DataFrame, same: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """groups(same..., group, n_members) and members(group, key) of the rows that agree in `same`, null with nothing: each row is one
    member once, whatever the group's size. group is the group's smallest key."""
    known = df.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in same])).select(*same, key)
    groups = known.groupBy(*same).agg(F.min(key).alias("group"), F.count("*").alias("n_members"))
    return groups, known.join(groups, list(same)).select("group", key)


def siblings(df: DataFrame, same: Sequence[str], key: str, named: DataFrame | None = None, differ: Column | None = None) -> DataFrame:
    """(key, siblings) of the rows of df whose key is in named(key), or of all: sorted keys of the other rows that agree in
    `same`; rows without any have an empty array. For all rows of large groups use `sibling_groups`.

    differ, over columns "a.x" and "b.x", narrows the pairs.
    """
    asked = df if named is None else df.join(named.select(key).distinct(), key, "left_semi")
    other = F.col(f"a.{key}") != F.col(f"b.{key}")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in same] + [other if differ is None else other & differ]
    pairs = asked.alias("a").join(df.alias("b"), on).groupBy(F.col(f"a.{key}").alias(key)).agg(F.array_sort(F.collect_list(f"b.{key}")).alias("siblings"))
    empty = F.array().cast(f"array<{df.schema[key].dataType.simpleString()}>")
    return asked.join(pairs, key, "left").withColumn("siblings", F.coalesce("siblings", empty))


def apply_patches(df: DataFrame, patches: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """patches(keys..., field, op, old, new): "set" gives a field's value, "replace" replaces a part of it.

    Patches are written by hand, so that one row per key and field stays small; Spark broadcasts it by its size.
    """
    wide = patches.groupBy(*keys).pivot("field", list(fields)).agg(F.first(F.struct("op", "old", "new")))
    wide = wide.select(*keys, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = df.join(wide, list(keys), "left")

    def patched(field: str) -> Column:
        p, c = F.col(f"__{field}"), F.col(field)
        kind = df.schema[field].dataType
        new = F.when(p["op"] == "set", p["new"].cast(kind)).when(p["op"] == "replace", F.replace(c.cast("string"), p["old"], p["new"]).cast(kind))
        return F.coalesce(new, c)

    return joined.select(*[patched(c).alias(c) if c in fields else F.col(c) for c in df.columns])


def type_tokens(tokens: DataFrame, dictionary: DataFrame, priority: Sequence[str], default: str) -> DataFrame:
    """tokens(token, ...) with `type`: the first of `priority` that dictionary(token, type) lists for it."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("type"))
    best = dictionary.where(rank > 0).groupBy("token").agg(F.min(F.struct(rank.alias("r"), "type")).alias("t"))
    return tokens.join(best, "token", "left").select(*tokens.columns, F.coalesce(F.col("t.type"), F.lit(default)).alias("type"))


def match_products(a: DataFrame, b: DataFrame, a_key: Column, b_key: Column, prefer: Column, a_id: str, b_id: str) -> DataFrame:
    """Each row of a with its best partner of equal key (preferred rows first, then the last), else without; unmatched rows of b follow."""
    left, right = a.withColumn("__k", a_key), b.withColumn("__k", b_key).withColumn("__p", prefer)
    # the best partner is the key's, whatever row asks: rows of one key make no pairs
    rank = F.struct(F.coalesce(F.col("__p").cast("int"), F.lit(-1)), b_id)
    best = right.where("__k is not null").groupBy("__k").agg(F.max_by(F.struct(*b.columns, "__p"), rank).alias("__b"))
    order = Window.partitionBy(a_id).orderBy(F.col("__b.__p").desc_nulls_last(), F.col(f"__b.{b_id}").desc())
    both = left.join(best, "__k", "left").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    both = both.select(*a.columns, *[F.col(f"__b.{c}").alias(c) for c in b.columns])
    alone = right.join(left.select("__k").distinct(), "__k", "left_anti").select(*b.columns)
    return both.unionByName(alone, allowMissingColumns=True)


def match_by_suffix(a: DataFrame, b: DataFrame, a_name: str, b_name: str, tail: int) -> DataFrame:
    """Pairs where one name ends with the other, met by the last `tail` characters of both (names have at least so many)."""
    suffix = lambda c: F.substring(c, -tail, tail)
    left, right = a.where(F.length(a_name) >= tail), b.where(F.length(b_name) >= tail)
    return left.join(right, (suffix(F.col(a_name)) == suffix(F.col(b_name))) & (F.col(a_name).endswith(F.col(b_name)) | F.col(b_name).endswith(F.col(a_name))))


#: Characters of the pieces by which names that contain each other meet.
PIECE = 3


def contained_names(short: DataFrame, long: DataFrame, name: str, other: str, piece: int = PIECE) -> DataFrame:
    """(name, other): different names of short(name) that stand anywhere in long's other, equal ones too.

    Each name is looked for by the one of its pieces of `piece` characters that the fewest others have (a shorter name is its only
    piece), and then compared. Null and empty names match nothing.
    """
    names, others = (df.select(c).where(F.length(c) > 0).distinct() for df, c in ((short, name), (long, other)))

    def pieces(c: str, sizes: Column) -> Column:
        places = lambda n: F.sequence(F.lit(1), F.length(c) - n + 1)
        return F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(places(n), lambda i: F.substring(F.col(c), i, n)))))

    own = names.select(name, F.explode(pieces(name, F.array(F.least(F.length(name), F.lit(piece))))).alias("__piece"))
    theirs = others.select(other, F.explode(pieces(other, F.sequence(F.lit(1), F.least(F.length(other), F.lit(piece))))).alias("__piece"))
    theirs = theirs.join(own.select("__piece").distinct(), "__piece", "left_semi")
    counts = theirs.groupBy("__piece").agg(F.count("*").alias("__n"))
    # a piece that no other name has settles that nothing holds the name
    rarest = own.join(counts, "__piece", "left").groupBy(name).agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__piece")).alias("r"))
    rarest = rarest.where("r.n > 0").select(name, F.col("r.__piece").alias("__piece"))
    return rarest.join(theirs, "__piece").where(F.col(other).contains(F.col(name))).select(name, other)


def match_by_containment(a: DataFrame, b: DataFrame, a_name: str, b_name: str, piece: int = PIECE) -> DataFrame:
    """Rows of a and b one of whose names contains the other."""
    names = contained_names(a, b, a_name, b_name, piece).union(contained_names(b, a, b_name, a_name, piece).select(a_name, b_name)).distinct()
    return a.join(names, a_name).join(b, b_name)


def first_containing(products: DataFrame, releases: DataFrame, name: str, release_name: str, key: str, order: str) -> DataFrame:
    """Products with the first release, by `order`, whose name contains theirs or is contained in it; without one they stay
    alone. key is unique among products; the columns of releases must have other names.

    A release's name is settled by its first release before names meet, so that rows which share a name make no pairs."""
    firsts = releases.where(F.length(release_name) > 0).groupBy(F.col(release_name).alias("__other")).agg(F.min_by(F.struct(*releases.columns), order).alias("__r"), F.min(order).alias("__o"))
    asked, held = products.select(F.col(name).alias("__name")), releases.select(F.col(release_name).alias("__other"))
    names = contained_names(asked, held, "__name", "__other").union(contained_names(held, asked, "__other", "__name").select("__name", "__other")).distinct()
    first = names.join(firsts, "__other").groupBy("__name").agg(F.min_by("__r", "__o").alias("__r"))
    joined = products.join(first, F.col(name) == F.col("__name"), "left")
    return joined.select(*products.columns, *[F.col(f"__r.{c}").alias(c) for c in releases.columns])


def refs_to_release(df: DataFrame, release: DataFrame, key: str = "card_id", notes: str = "notes", own: str = "release") -> DataFrame:
    """Df with `releases`, names in order of date: those of the codes in square brackets in its notes, else those whose name
    starts with the notes in any case, else its own. A code is compared without hyphens and leading zeros, behind a version that
    the notes name.

    release(code, name, date, listed): only listed ones are found by name. Names meet notes as prefixes, by an equi-join. Notes that
    are null, empty or of a limited pack name no release. key is unique.
    """
    # fixed values of the rule: the version's pattern, the zeros left out of codes, the name of a limited pack
    version = F.regexp_extract(notes, r"(?i)Ver\.?[0-9]\.[0-9]", 0)
    codes = F.transform(F.regexp_extract_all(notes, F.lit(r"\[([^\]]+)\]"), 1), lambda s: F.concat(version, F.regexp_replace(F.replace(s, F.lit("-"), F.lit("")), "0([0-9]+)", "$1")))
    by_code = df.select(key, F.explode(F.array_distinct(codes)).alias("code")).join(release.select("code", "name", "date"), "code")
    starts = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substr(F.lower("name"), F.lit(1), i))
    starts = release.where(F.col("listed") & (F.length("name") > 0)).select(F.explode(starts).alias("__start"), "name", "date")
    asked = df.where(~F.lower(notes).contains("limited card pack")).select(key, F.lower(notes).alias("__start"))
    ordered = F.array_sort(F.collect_set(F.struct(F.coalesce(F.col("date").cast("date"), F.to_date(F.lit("9999-12-31"))).alias("d"), "name")))
    names = lambda found, c: found.groupBy(key).agg(F.transform(ordered, lambda r: r["name"]).alias(c))
    joined = df.join(names(by_code, "__code"), key, "left").join(names(asked.join(starts, "__start"), "__name"), key, "left")
    return joined.select(*df.columns, F.coalesce("__code", "__name", F.array(own)).alias("releases"))


#: A 64-bit hash is cut in so many parts to be probed; the most bits in which a part may differ (2: 137 neighbours).
PARTS, MOST_PROBED = 4, 2


def _neighbours(bits: int, most: int) -> list[int]:
    """Masks of `bits` bits with at most so many set, those with fewer first."""
    return [sum(1 << k for k in places) for n in range(most + 1) for places in combinations(range(bits), n)]


def _part(h: Column, k: int) -> Column:
    width = 64 // PARTS
    return F.shiftrightunsigned(h, width * k).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _parts(h: Column) -> Column:
    return F.array(*[_part(h, k) for k in range(PARTS)])


def _near_by_probing(a: DataFrame, b: DataFrame, block: Sequence[str], max_distance: int) -> DataFrame:
    """Pairs of a(hash, block..., more) and b(__h, block..., more), rows of different hashes each, within the distance.

    Two hashes within it differ by at most max_distance / PARTS bits in some part; so each part of a's is probed with all its
    neighbours of so many bits. A pair is met once, at its first such part.
    """
    most = max_distance // PARTS
    probes = F.transform(_parts(F.col("hash")), lambda v: F.transform(F.array(*[F.lit(m) for m in _neighbours(64 // PARTS, most)]), lambda m: v.bitwiseXOR(m)))
    left = a.select("*", F.posexplode(probes).alias("__part", "__values")).select(*a.columns, "__part", F.explode("__values").alias("__value"))
    right = b.select("*", F.posexplode(_parts(F.col("__h"))).alias("__part", "__value"))
    met = left.join(right.hint("shuffle_hash"), [*block, "__part", "__value"])
    differ = F.col("hash").bitwiseXOR(F.col("__h"))
    # the first such part, without an array: most pairs are looked at here, and fail the distance
    first = reduce(lambda x, k: F.when(F.bit_count(_part(differ, k)) <= most, k).otherwise(x), range(PARTS - 1, -1, -1), F.lit(PARTS))
    return met.where((F.bit_count(differ) <= max_distance) & (first == F.col("__part"))).drop("__part", "__value")


def nearest_hash(a: DataFrame, b: DataFrame, block: Sequence[str], max_distance: int = 11, own: bool = True) -> DataFrame:
    """For each row of a(id, hash, block...) the nearest row of b in its block, by (distance, id), within the distance.

    Where own is false, a row doesn't match its own id. Equal hashes of a block are searched once, and found as the two smallest
    ids that have them, so that copies make no pairs. Within 11 bits hashes meet by multi-index probing, first within 3 bits, then
    those that found nothing within 7 and 11; what each step found is written. A greater distance, of which no part tells enough,
    compares a block's different hashes. Rows without a hash or a block value match nothing.
    """
    by = ["hash", *block]
    rows, hashes = a.select("id", *by).withColumn("__skip", F.lit(None).cast(a.schema["id"].dataType)), b.groupBy(*by).agg(F.min("id").alias("match"))
    if not own:
        # the next id of each hash, and the rows whose id has another hash in b, which must pass it over there
        rest = b.select("id", *by).join(hashes, by).where("id <> match").groupBy(*by).agg(F.min("id").alias("__next"))
        hashes = hashes.join(rest, by, "left")
        twice = a.select("id", *by).join(b.select("id", *block, F.col("hash").alias("__h")), ["id", *block]).where("hash <> __h").select("id", *by).distinct()
        rows = a.select("id", *by).join(twice.withColumn("__skip", F.col("id")), ["id", *by], "left")
    asked = rows.select(*by, "__skip").distinct()
    if max_distance // PARTS <= MOST_PROBED:
        near = _near_by_steps(asked, hashes, block, max_distance, own)
    else:
        held = hashes.withColumnRenamed("hash", "__h")
        near = _by_distance(asked.join(held, list(block)).where(distance(F.col("hash"), F.col("__h")) <= max_distance), asked, hashes, block, own)
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in by] + [F.col("x.__skip").eqNullSafe(F.col("y.__skip"))]
    found = rows.alias("x").join(near.alias("y").hint("shuffle_hash"), same).select("x.id", "y.distance", "y.match")
    found = found if own else found.where("id <> match")
    return found.groupBy("id").agg(F.min(F.struct("distance", "match")).alias("m")).select("id", "m.match", "m.distance")


def _by_distance(near: DataFrame, asked: DataFrame, hashes: DataFrame, block: Sequence[str], own: bool) -> DataFrame:
    """(hash, block..., __skip, distance, match) of the pairs in near: the smallest id at each distance, and where own is false, at 0
    the next one, too."""
    by = ["hash", *block]
    if not own:
        near = near.withColumn("match", F.when(F.col("match") == F.col("__skip"), F.col("__next")).otherwise(F.col("match")))
    # pairs become one row a distance while they are made, and are neither shuffled nor sorted
    near = near.groupBy(*by, "__skip", distance(F.col("hash"), F.col("__h")).alias("distance")).agg(F.min("match").alias("match")).where("match is not null")
    if own:
        return near
    return near.unionByName(asked.join(hashes.where("__next is not null"), by).select(*by, "__skip", F.lit(0).alias("distance"), F.col("__next").alias("match")))


def _near_by_steps(asked: DataFrame, hashes: DataFrame, block: Sequence[str], max_distance: int, own: bool) -> DataFrame:
    """As _by_distance, of all that may be nearest: PARTS - 1 bits are looked at first, which takes one probe a part, and PARTS more at
    each step, for the hashes that have nothing nearer. Of those whose rows may have found only themselves, the next step is taken."""
    by, held, steps = ["hash", *block], hashes.withColumnRenamed("hash", "__h"), []
    for most in range(max_distance // PARTS + 1):
        within = min(PARTS * most + PARTS - 1, max_distance)
        steps.append(written(_by_distance(_near_by_probing(asked, held, block, within), asked, hashes, block, own), "near"))
        settled = steps[-1]
        if not own:
            alone = settled.groupBy(*by, "__skip").agg(F.max("distance").alias("__far"), F.min("match").alias("__a"), F.max("match").alias("__z"))
            settled = alone.where("__far > 0 or __a < __z")
        settled = settled.select(*by, F.col("__skip").alias("__other")).distinct()
        same = [asked[c] == settled[c] for c in by] + [asked["__skip"].eqNullSafe(settled["__other"])]
        asked = asked.join(settled, same, "left_anti")
    return reduce(DataFrame.unionByName, steps)


#: Rows of a byte at a place that a tile holds of either side.
TILE = 1 << 14


def _tiled(q: DataFrame, index: DataFrame, keys: Sequence[str], tile: int) -> tuple[DataFrame, DataFrame]:
    """q and index with columns __i, __j to be joined on beside the keys, so that a task meets about tile x tile rows at most.

    Keys with more rows are cut in tiles: a row of q is in one row of tiles and goes to all its columns, a row of index the
    other way. Keys have few values (J12: 2,048), so their counts are broadcast.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    cuts = count(q, "__a").join(count(index, "__b"), list(keys))
    cuts = F.broadcast(cuts.select(*keys, F.ceil(F.col("__a") / tile).cast("int").alias("__a"), F.ceil(F.col("__b") / tile).cast("int").alias("__b")))
    one = lambda df, n: F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(cuts, list(keys)).withColumn("__i", one(q, "__a")).withColumn("__j", every("__b")).drop("__a", "__b")
    right = index.join(cuts, list(keys)).withColumn("__j", one(index, "__b")).withColumn("__i", every("__a")).drop("__a", "__b")
    return left, right


def band_join(q: DataFrame, index: DataFrame, max_distance: int = 16, tile: int = TILE) -> DataFrame:
    """Pairs of q(id, hash) and index(id, hash) with an equal byte at one of the 8 places, within the distance.

    Each pair is met once, at its first equal byte; within 7 bits no pair can be missed. Bytes that many rows share at a place are
    cut in tiles, so that no task has more than a tile of each side to compare; the distance is part of the join's condition.
    """
    banded = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.col("hash").alias(f"{p}_hash"), F.posexplode(hash_bands(F.col("hash"))).alias("place", "byte"))
    left, right = _tiled(banded(q, "q"), banded(index, "i"), ["place", "byte"], tile)
    keys = ("place", "byte", "__i", "__j")
    right = right.withColumnsRenamed({k: f"i_{k}" for k in keys})
    differ = F.col("q_hash").bitwiseXOR(F.col("i_hash"))
    first = F.array_position(hash_bands(differ), F.lit(0)) == F.col("place") + 1
    met = left.join(right, [*[F.col(k) == F.col(f"i_{k}") for k in keys], F.bit_count(differ) <= max_distance, first])
    return met.select(F.col("q_id").alias("id"), F.col("i_id").alias("match"), F.bit_count(differ).cast("int").alias("distance"))


def by_language(keys: DataFrame, card: DataFrame, on: Sequence[str], languages: Sequence[str], value: str) -> DataFrame:
    """A map of language to value for each key."""
    rows = card.where(F.col("language").isin(*languages)).groupBy(*on, "language").agg(F.min(value).alias(value))
    maps = rows.groupBy(*on).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", value)))).alias("by_language"))
    return keys.join(maps, list(on), "left")
