"""Decks as compact strings, decoded and encoded as columns: the cards of an Arrow batch are read and written side by side.

Format (fixed values): prefix DCG, then URL-safe base64 of
  version << 4 | eggs, checksum, name length, [side cards from version 2], card sets, name.
Versions 3 and 4 keep the language in bit 3 of the first byte, version 5 in the two top bits of the name length. From version 4
the top bit of the side byte tells that the name's first 8 bytes are an icon. A set is its characters (4 bytes in version 0, else
base 36 with a continue bit), a byte of padding << 6 | count, and cards; a card is count - 1, variant and the distance to the
number before. Counts and distances go on in 7-bit groups where their first bits end with a carry. The checksum is the low byte
of the sum of the bytes between header and name.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, VERSION = "DCG", 5
LANGUAGES = ("ja", "en", "zh-Hans", "ko")
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_CARDS = "array<struct<number:string,count:int,parallel_id:int>>"
_SET, _PAD, _SET_COUNT, _CARD, _OFFSET, _REST = range(6)
#: Bits that the groups of a number may reach; beyond, a code isn't whole.
_MOST_BITS = 56


def _bytes(code: Column) -> Column:
    """The bytes after the prefix; null where it isn't base64."""
    body = F.translate(F.substring(code, len(PREFIX) + 1, 1 << 20), "-_", "+/")
    padded = F.concat(body, F.repeat(F.lit("="), (F.lit(4) - F.length(body) % 4) % 4))
    data = F.call_function("try_to_binary", padded, F.lit("base64"))
    return F.when(F.length(data) > 0, data)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column from a generator: the optimiser then can't write a long expression into each of its uses."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins and ends in them; a null value is empty."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    end = np.cumsum(size)
    return np.frombuffer(b"".join(v for v in column.to_pylist() if v), np.uint8), end - size, end


def _numbers(sets: list[str], owner: np.ndarray, padding: np.ndarray, last: np.ndarray) -> pa.Array:
    """SET-012 for each card: its set by place, and its number in `padding` digits at least."""
    digits = pa.array(last).cast(pa.string())
    for width in (2, 3, 4):
        digits = pc.if_else(pa.array(padding == width), pc.utf8_lpad(digits, width, "0"), digits)
    return pc.binary_join_element_wise(pc.take(pa.array(sets, pa.string()), pa.array(owner)), digits, "-")


def _read_cards(body: pa.Array, version: pa.Array) -> pa.Array:
    """Sum of a body's bytes, whether its sets and cards end with it, and the cards. Bodies are read side by side, a byte at a time."""
    data, begin, end = _spans(body)
    version = np.asarray(pc.fill_null(version, -1)).astype(np.int64)
    n = len(begin)
    upto = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
    total = upto[end] - upto[begin] & 255
    at = np.minimum(begin + (version >= 2), end)
    mode, left, count, variant, value, shift, last, padding, first, chars = (np.zeros(n, np.int64) for _ in range(10))
    broken = np.zeros(n, bool)
    cards, sets = [], []  # rows (body, set, padding, number, count, variant); (body, first byte, byte behind) of sets
    current, n_sets = np.zeros(n, np.int64), 0
    live = np.flatnonzero(at < end)
    while len(live):
        b, m, old = data[at[live]].astype(np.int64), mode[live], version[live] == 0
        low, more = b & 127, b >= 128
        ready, go_on = np.zeros(len(live), bool), np.full(len(live), -1, np.int64)  # a card is complete; cards of a set are counted

        s = m == _SET
        if s.any():
            i = live[s]
            starts = chars[i] == 0
            first[i[starts]] = at[i[starts]]
            chars[i] += 1
            ends = np.where(old[s], chars[i] == 4, ~more[s])
            i = i[ends]
            mode[i] = _PAD
            current[i] = n_sets + np.arange(len(i))
            n_sets += len(i)
            sets.append(np.stack([i, first[i], at[i] + 1], 1))
        s = m == _PAD
        if s.any():
            i, early = live[s], version[live[s]] < 2
            padding[i] = (b[s] >> 6) + 1
            carried = ~early & (b[s] & 32 != 0)
            mode[i[carried]], value[i[carried]], shift[i[carried]] = _SET_COUNT, b[s][carried] & 31, 5
            go_on[s] = np.where(carried, -1, np.where(early, b[s] & 63, b[s] & 31))
        s = (m == _SET_COUNT) | (m == _REST)
        if s.any():
            i = live[s]
            broken[i[shift[i] >= _MOST_BITS]] = True
            value[i] += low[s] << np.minimum(shift[i], _MOST_BITS - 1)
            shift[i] += 7
            done = s & ~more
            ready |= done & (m == _REST)
            go_on = np.where(done & (m == _SET_COUNT), value[live], go_on)
        s = (m == _CARD) & old
        if s.any():
            i, carried = live[s], b[s] & 4 != 0
            count[i], variant[i], value[i], shift[i] = (b[s] >> 6) + 1, b[s] >> 3 & 7, b[s] & 3, 2
            mode[i[carried]] = _REST
            ready[s] = ~carried
        s = (m == _CARD) & ~old
        count[live[s]], mode[live[s]] = b[s] + 1, _OFFSET
        s = m == _OFFSET
        if s.any():
            i, carried = live[s], b[s] & 16 != 0
            variant[i], value[i], shift[i] = b[s] >> 5, b[s] & 15, 4
            mode[i[carried]] = _REST
            ready[s] = ~carried

        i = live[go_on >= 0]
        left[i], last[i], value[i] = go_on[go_on >= 0], 0, 0
        mode[i] = np.where(left[i] > 0, _CARD, _SET)
        chars[i] = 0
        i = live[ready]
        last[i] += value[i]
        cards.append(np.stack([i, current[i], padding[i], last[i], count[i], variant[i]], 1))
        left[i] -= 1
        mode[i] = np.where(left[i] > 0, _CARD, _SET)
        at[live] += 1
        live = live[(at[live] < end[live]) & ~broken[live]]
    rows = np.concatenate([np.zeros((0, 6), np.int64), *cards])
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    names, seen, raw = [], {}, data.tobytes()
    for i, lo, hi in np.concatenate([np.zeros((0, 3), np.int64), *sets]).tolist():
        key = raw[lo:hi], version[i] == 0
        if key not in seen:
            seen[key] = key[0].decode("latin-1").strip(" ") if key[1] else "".join(BASE36[x & 63 : (x & 63) + 1] for x in key[0])
        names.append(seen[key])
    card = pa.StructArray.from_arrays([_numbers(names, rows[:, 1], rows[:, 2], rows[:, 3]), pa.array(rows[:, 4], pa.int32()), pa.array(rows[:, 5], pa.int32())], ["number", "count", "parallel_id"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows[:, 0], minlength=n))])
    whole = (mode == _SET) & (chars == 0) & ~broken
    return pa.StructArray.from_arrays([pa.array(total, pa.int32()), pa.array(whole), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), card)], ["sum", "whole", "cards"])


def _parsed(df: DataFrame, column: str) -> DataFrame:
    """df with version, __cards, __eggs, __main, __side (how many cards are in each section), __icon, __text, __language and error."""
    out = _once(df, "__b", F.when(F.col(column).startswith(PREFIX), _bytes(F.col(column))))
    b, size = F.col("__b"), F.length("__b")
    at = lambda i: F.conv(F.nullif(F.hex(F.substring(b, i + 1, 1)), F.lit("")), 16, 10).cast("int")
    out = _once(out, "__h", F.struct(*[at(i).alias(f"b{i}") for i in range(4)]))
    at = lambda i: F.col(f"__h.b{i}")
    out = out.withColumn("version", F.shiftright(at(0), 4))
    version = F.col("version")
    eggs = at(0).bitwiseAND(F.when(version.between(3, 4), 7).otherwise(15))
    length = F.when(version >= 5, at(2).bitwiseAND(63)).otherwise(at(2))
    number = F.when(version >= 5, F.shiftright(at(2), 6)).when(version >= 3, F.shiftright(at(0), 3).bitwiseAND(1))
    side = F.when(version >= 2, at(3)).otherwise(F.lit(0))
    out = out.withColumns({"__eggs": eggs, "__name": length, "__language": number, "__side": F.when(version >= 4, side.bitwiseAND(127)).otherwise(side), "__icon": (version >= 4) & (F.shiftright(side, 7) > 0)})
    body = F.substring(b, F.lit(4), F.greatest(size - 3 - F.col("__name"), F.lit(0)))
    out = out.withColumn("__s", F.arrow_udf(_read_cards, f"struct<sum:int,whole:boolean,cards:{_CARDS}>")(body, version))
    n = F.size("__s.cards")
    whole = F.col("__s.whole") & (n >= F.col("__eggs") + F.col("__side"))
    error = (
        F.when(~F.col(column).startswith(PREFIX) | F.col(column).isNull(), "prefix").when(b.isNull() | (size < 3), "base64").when(version > VERSION, "version")
        .when(~F.coalesce(F.col("__s.sum") == at(1), F.lit(False)), "checksum").when(~F.coalesce(whole, F.lit(False)), "cards")
    )
    start = size - F.col("__name") + 1
    name = F.when((F.col("__name") > 0) & (start != 0) & (start >= -size), F.decode(F.substring(b, start, F.col("__name")), "UTF-8")).otherwise(F.lit(""))
    main = F.greatest(n - F.col("__eggs") - F.col("__side"), F.lit(0))
    return _once(out, "error", error).withColumns({"__text": name, "__main": main, "__cards": F.col("__s.cards")})


def parse_decks(df: DataFrame, column: str) -> DataFrame:
    """df with version, name, icon, language, digi_eggs, deck, sideboard (arrays of number, count, parallel_id), and error.

    error is "prefix", "base64", "version", "checksum" or "cards"; null where all is well.
    """
    out, ok, cards = _parsed(df, column), F.col("error").isNull(), F.col("__cards")
    return out.select(
        *df.columns, F.when(ok, F.col("version")).alias("version"), F.when(ok, F.trim(F.when(F.col("__icon"), F.substring("__text", 9, 1 << 20)).otherwise(F.col("__text")))).alias("name"),
        F.when(ok & F.col("__icon"), F.trim(F.substring("__text", 1, 8))).alias("icon"), F.when(ok, F.try_element_at(F.array(*[F.lit(x) for x in LANGUAGES]), F.col("__language") + 1)).alias("language"),
        F.when(ok, F.slice(cards, F.lit(1), F.col("__eggs"))).alias("digi_eggs"), F.when(ok, F.slice(cards, F.col("__eggs") + 1, F.col("__main"))).alias("deck"),
        F.when(ok, F.slice(cards, F.col("__eggs") + F.col("__main") + 1, F.col("__side"))).alias("sideboard"), "error",
    )


def decode_decks(df: DataFrame, column: str) -> DataFrame:
    """A row per card: df's columns, section, position, number, parallel_id, count; bad codes give one row with their error."""
    cards = _parsed(df, column).select(*df.columns, "error", "__eggs", "__main", F.posexplode_outer(F.when(F.col("error").isNull(), F.col("__cards"))).alias("__at", "c"))
    at, main = F.col("__at") - F.col("__eggs"), F.col("__main")
    section = F.when(at < 0, "digi_eggs").when(at < main, "deck").when(at >= main, "sideboard")
    position = F.when(at < 0, F.col("__at")).when(at < main, at).otherwise(at - main)
    return cards.select(*df.columns, "error", section.alias("section"), position.alias("position"), "c.number", "c.parallel_id", "c.count")


def _hex(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("long")), 2, "0")


def _groups(value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first bits of each number, with their carry, and how many groups of 7 bits follow."""
    rest, n = value >> bits - 1, np.zeros(len(value), np.int64)
    first = (value & (1 << bits - 1) - 1) | np.where(rest > 0, 1 << bits - 1, 0)
    while (rest > 0).any():
        n += rest > 0
        rest = rest >> 7
    return first, n


def _put_groups(out: np.ndarray, at: np.ndarray, value: np.ndarray, bits: int, n: np.ndarray) -> None:
    """Write the groups that follow the first bits, from `at` on."""
    for k in range(int(n.max(initial=0))):
        on = n > k
        out[at[on] + k] = value[on] >> bits - 1 + 7 * k & 127 | np.where(n[on] > k + 1, 128, 0)


def _split_number(number: str | None, version: int) -> tuple[bytes | None, int, int]:
    """A number's set in bytes, its digits and its value; no set where the format can't hold it."""
    name, _, digits = (number or "").partition("-")
    fits = digits.isascii() and digits.isdigit() and len(digits) <= 4
    if version == 0:
        own = name.encode().ljust(4) if name.isascii() and len(name) <= 4 else None
    else:
        own = bytes(BASE36.index(x) | (128 if i < len(name) - 1 else 0) for i, x in enumerate(name)) if name and set(name) <= set(BASE36) else None
    return (own, len(digits), int(digits)) if fits and own else (None, 1, 0)


def _write_cards(decks: pa.Array, version: pa.Array) -> pa.Array:
    """Bytes of a section and their sum: cards in order of number, variant and count, runs of one set and padding together, and
    distances inside a run. null where the format can't hold a card."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(decks), 0)).astype(np.int64)
    v = version[0].as_py() if len(version) else VERSION
    cards = decks.flatten()
    owner = np.repeat(np.arange(len(decks)), sizes)
    number = pc.struct_field(cards, "number").dictionary_encode()
    known = [_split_number(x, v) for x in number.dictionary.to_pylist()]
    order = np.empty(len(known) + 1, np.int64)  # codes of numbers, null first, by their bytes
    order[1 + np.array(sorted(range(len(known)), key=lambda i: number.dictionary[i].as_py().encode()), np.int64)] = np.arange(len(known))
    which = np.asarray(pc.fill_null(number.indices, -1)).astype(np.int64) + 1
    known = [(None, 1, 0), *known]
    place = {own: i for i, own in enumerate(dict.fromkeys(x[0] for x in known))}
    group, padding, value = (np.array(x, np.int64) for x in zip(*((place[own], p, n) for own, p, n in known), strict=True))
    variant, count = (np.asarray(pc.fill_null(pc.struct_field(cards, f), missing)).astype(np.int64) for f, missing in (("parallel_id", 0), ("count", 0)))
    bad = (group[which] == place[None]) | (variant < 0) | (variant > 7) | (count < 1) | (count > (256 if v else 4))
    order[0] = -1
    rank = np.lexsort((count, variant, order[which], owner))
    owner, which, variant, count, bad = (x[rank] for x in (owner, which, variant, count, bad))
    group, padding, value = group[which], padding[which], value[which]
    starts = np.ones(len(owner), bool)
    starts[1:] = (owner[1:] != owner[:-1]) | (group[1:] != group[:-1]) | (padding[1:] != padding[:-1])
    far = value - np.where(starts, 0, np.concatenate([[0], value[:-1]])[: len(value)])
    bits = 5 if v else 3
    low, groups = _groups(np.maximum(far, 0), bits)
    run = np.flatnonzero(starts)
    length = np.diff(np.append(run, len(owner)))
    names = list(place)
    heads = [names[i] or b"" for i in group[run].tolist()]
    head = np.array([len(x) for x in heads], np.int64)
    first, more = _groups(length, 6) if v >= 2 else (length, np.zeros(len(run), np.int64))
    if v < 2:
        bad[run[length > 63]] = True
    take = (2 if v else 1) + groups
    take[run] += head + 1 + more
    stop = np.cumsum(take)
    out = np.zeros(int(take.sum()), np.uint8)
    at = stop - take
    spread = np.repeat(at[run] - (np.cumsum(head) - head), head) + np.arange(int(head.sum()))
    out[spread] = np.frombuffer(b"".join(heads), np.uint8)
    out[at[run] + head] = (padding[run] - 1) * 64 + first & 255
    _put_groups(out, at[run] + head + 1, length, 6, more)
    at = stop - groups
    if v:
        out[at - 2], out[at - 1] = (count - 1) & 255, (variant * 32 + low) & 255
    else:
        out[at - 1] = (count - 1) * 64 + variant * 8 + low & 255
    _put_groups(out, at, np.maximum(far, 0), bits, groups)
    per = np.bincount(owner, take, len(decks)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(per)])
    upto = np.concatenate([[0], np.cumsum(out, dtype=np.int64)])
    null = np.bincount(owner, bad, len(decks)) > 0
    data = pa.BinaryArray.from_buffers(pa.binary(), len(decks), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
    return pa.StructArray.from_arrays([pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int32()), pc.if_else(pa.array(null), None, data)], ["sum", "data"])


def encode_decks(decks: DataFrame, version: int = VERSION) -> DataFrame:
    """Decks with `code`, from name, language, icon, digi_eggs, deck and sideboard (missing columns are empty).

    The name is cut to 63 bytes, and its length is counted in bytes. A deck with a card that the format can't hold has no code.
    """
    have = lambda name, kind: F.col(name) if name in decks.columns else F.lit(None).cast(kind)
    sections = [s for s in ("digi_eggs", "deck", "sideboard") if s in decks.columns]
    size = lambda name: F.coalesce(F.size(name), F.lit(0)) if name in decks.columns else F.lit(0)
    language = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LANGUAGES]), have("language", "string")) - 1, F.lit(1))
    icon = have("icon", "string")
    name = F.coalesce(have("name", "string"), F.lit(""))
    if version >= 4:
        name = F.when(icon.isNotNull(), F.concat(F.rpad(icon, 8, " "), name)).otherwise(name)
    name_hex = F.substring(F.hex(name.cast("binary")), 1, 126)
    first = version * 16 + size("digi_eggs") + (language * 8 if 3 <= version <= 4 else F.lit(0))
    side = size("sideboard") + (F.when(icon.isNotNull(), 128).otherwise(0) if version >= 4 else F.lit(0))
    write = F.arrow_udf(_write_cards, "struct<sum:int,data:binary>")
    out = decks.withColumns({f"__{s}": write(s, F.lit(version)) for s in sections})
    out = _once(out.withColumn("__name", name_hex), "__side", side)
    length = F.length("__name") / 2 + (language * 64 if version >= 5 else F.lit(0))
    total = reduce(lambda a, b: a + b, [F.col(f"__{s}.sum") for s in sections], F.conv(_hex(F.col("__side")), 16, 10).cast("int") if version >= 2 else F.lit(0))
    head = F.concat(_hex(first), _hex(total.bitwiseAND(255)), _hex(length), _hex(F.col("__side")) if version >= 2 else F.lit(""))
    whole = F.concat(F.unhex(head), *[F.col(f"__{s}.data") for s in sections], F.unhex("__name"))
    code = F.concat(F.lit(PREFIX), F.rtrim(F.translate(F.base64(whole), "+/=\r\n", "-_ ")))
    return _once(out, "code", code).select(*decks.columns, "code")


def validate_decks(cards: DataFrame, decks: DataFrame | None = None, deck: str = "deck_id") -> DataFrame:
    """D3: (deck, problem) of cards(deck, section, number, parallel_id, count) and decks(deck, name).

    A card stands once per section, with a count of 1 to 255 and a variant of 0 to 7; there are at most 7 egg and 127 side
    entries, and a name has 63 bytes at most.
    """
    bad = lambda test, problem: cards.where(test).select(deck, F.lit(problem).alias("problem"))
    variant = F.coalesce("parallel_id", F.lit(0))
    rows = [
        cards.groupBy(deck, "section", "number", variant).count().where("count > 1").select(deck, F.lit("repeated").alias("problem")),
        bad(~F.coalesce(F.col("count").between(1, 255), F.lit(False)), "count"), bad(~variant.between(0, 7), "variant"),
        bad(~F.coalesce(F.col("number").rlike(r"^[A-Z|0-9]{1,4}-[0-9]{2,3}$"), F.lit(False)), "number"),
        cards.where("section = 'digi_eggs'").groupBy(deck).count().where("count > 7").select(deck, F.lit("eggs").alias("problem")),
        cards.where("section = 'sideboard'").groupBy(deck).count().where("count > 127").select(deck, F.lit("sideboard").alias("problem")),
    ]
    if decks is not None:
        rows.append(decks.where(F.octet_length("name") > 63).select(deck, F.lit("name").alias("problem")))
    out = rows[0]
    for row in rows[1:]:
        out = out.union(row)
    return out.distinct()


def expand_copies(cards: DataFrame, count: str = "count") -> DataFrame:
    """One row per copy, numbered from 1; rows with a count below 1 give none."""
    return cards.where(F.col(count) >= 1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))


def decks_from_pages(rows: DataFrame, deck: str = "page_id") -> DataFrame:
    """rows(deck, seq, section, number, count) as read from pages: the first number is the key card, and cards that are in
    no section are side cards, four of each."""
    first = rows.groupBy(deck).agg(F.min_by("number", "seq").alias("icon"))
    listed = rows.where("section is not null").groupBy(deck, "section", "number").agg(F.sum("count").cast("int").alias("count"))
    extra = rows.where("section is null").select(deck, "number").distinct().join(listed, [deck, "number"], "left_anti")
    side = extra.select(deck, F.lit("sideboard").alias("section"), "number", F.lit(4).alias("count"))
    return listed.unionByName(side).join(first, deck)


def check_allowance(cards: DataFrame, limits: DataFrame, deck: str = "deck_id", standard: int = 4) -> DataFrame:
    """(deck, number, copies, allowed) where a deck has more copies of a number, in all sections, than limits(number, allowance) allow."""
    copies = cards.groupBy(deck, "number").agg(F.sum("count").cast("long").alias("copies"))
    allowed = limits.groupBy("number").agg(F.min("allowance").cast("long").alias("allowed"))
    out = copies.join(allowed, "number", "left").withColumn("allowed", F.coalesce("allowed", F.lit(standard).cast("long")))
    return out.where("copies > allowed").select(deck, "number", "copies", "allowed")
