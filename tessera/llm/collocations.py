"""Phrase collocations: Misra-Gries summaries find the phrases that may be frequent, a second pass counts these exactly.

Texts are lower-cased in A-Z and cut into pieces at `.,;:!?` and line ends; a phrase is 1 to `longest` words that follow each
other in a piece. A phrase's key is a hash of its language, length and words. Keys are dealt over partitions by their upper bits.

1. Tasks count keys in buffers; each buffer leaves as one summary per partition: keys and counts. A partition's summaries are
   merged one after the other (Misra-Gries): counts of equal keys add up, and where more keys remain than the capacity, the
   count of the first one beyond it is taken from all. Each count that is taken is taken from more keys than the capacity, so
   that a key loses at most mass / (capacity + 1). With a capacity of ROOM times mass / least, that is less than least / ROOM:
   no key seen `least` times is lost, and a key is let go where its count and all that was taken are less than `least`.
   Partitions grow in number with the text, not in size.
2. The texts are read again. Phrases whose key was left are counted exactly, by language and words; those seen less often go.
   The keys thin out phrases by a bitmap in proportion to them; where there are too many for its size, it lets more of the others
   through to the count, which settles them.

Keys that meet by chance only let a phrase through to the exact count; there, phrases of a task meet by 128 bits, those of
different tasks by their words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bitmap, in_bitmap, joined, kept, lists, mapped, materialize, mix, pieces, scratch, shared, utf8
from .ranks import first_of

#: Bytes that end a piece, and those between words.
ENDS, SPACES = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
UNDETERMINED = "und"
#: Bytes of text for each partition of keys; phrases that a task counts at one time; capacity as a multiple of mass / least.
PARTITION_BYTES, BUFFER, ROOM = 8 << 20, 1 << 22, 4
#: Entries, and bytes of text, that a task holds while it counts exactly.
SEEN, MOST_TEXT = 1 << 20, 16 << 20
#: Bits of the bitmap for each key that is left, and most bits of it in all (2^27: 16 MB).
BITS_A_KEY, MOST_BITS = 8, 27

_ENDS = np.zeros(256, bool)
_ENDS[list(ENDS)] = True
_BETWEEN = _ENDS.copy()
_BETWEEN[list(SPACES)] = True


class Phrases:
    """Phrases of consecutive rows of text: key, and the first word's place and the number of words of each; with `twice`, a second
    key `check`, which has nothing to do with the first."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lang: np.ndarray, longest: int, twice: bool = False):
        self.words = w = Words(data, at, fold=True, spaces=_BETWEEN, twice=twice)
        row = np.repeat(np.arange(len(at) - 1), np.diff(w.first))
        ends = np.zeros(len(w.data) + 1, np.int32)
        np.cumsum(_ENDS[w.data], out=ends[1:])
        piece = ends[w.start]
        h, c, keys, checks, places, sizes = w.hash, w.check, [], [], [], []
        for size in range(1, longest + 1):
            n = len(w.hash) - size + 1
            if n <= 0:
                break
            if size > 1:
                h = joined(h[:n], w.hash[size - 1 :])
                c = joined(c[:n], w.check[size - 1 :]) if twice else c
            inside = np.flatnonzero((row[:n] == row[size - 1 :]) & (piece[:n] == piece[size - 1 :]))
            keys.append(mix(joined(h[inside], lang[row[inside]] + np.uint64(size))))
            if twice:
                checks.append(mix(joined(c[inside], lang[row[inside]] + np.uint64(size))))
            places.append(inside)
            sizes.append(np.full(len(inside), size, np.int8))
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.key, self.check, self.place, self.size = flat(keys, np.uint64), flat(checks, np.uint64), flat(places, np.int64), flat(sizes, np.int8)


def _each(batches: Iterator[pa.RecordBatch], longest: int, twice: bool = False) -> Iterator[tuple[Phrases, np.ndarray, pa.RecordBatch]]:
    """Phrases of some rows at a time, the rows' places in the batch, and the batch."""
    for batch in batches:
        data, at = utf8(batch.column("text"))
        lang = batch.column("lang_key").to_numpy().view(np.uint64)
        for i, j in pieces(at):
            lo = int(at[i])
            yield Phrases(data[lo : int(at[j])], at[i : j + 1] - lo, lang[i:j], longest, twice), np.arange(i, j), batch


class _Counted:
    """Different phrases of some pieces of text with their counts: found by key and check, told by where one of them stands."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.texts: list[np.ndarray] = []
        self.size = self.base = 0
        self.words: Counter[str] = Counter()

    def add(self, phrases: Phrases, at: np.ndarray, lang: np.ndarray) -> None:
        """Phrases at these places of the arrays; lang has the number of each row's language."""
        w = phrases.words
        place, size = phrases.place[at], phrases.size[at].astype(np.int64)
        row = np.searchsorted(w.first, place, "right") - 1
        rows = (phrases.key[at], phrases.check[at], np.ones(len(at), np.int64), w.start[place] + self.base, w.end[place + size - 1] + self.base, size, lang[row])
        self.parts.append(self._merged(rows))
        self.size += len(self.parts[-1][0])
        self.texts.append(w.data)
        self.base += len(w.data)

    @staticmethod
    def _merged(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        key, check = rows[0], rows[1]
        order = np.argsort(key)
        key, check = key[order], check[order]
        same = key[1:] == key[:-1]
        if (check[1:][same] != check[:-1][same]).any():  # keys that meet by chance
            order = np.lexsort((rows[1], rows[0]))
            key, check = rows[0][order], rows[1][order]
            same = (key[1:] == key[:-1]) & (check[1:] == check[:-1])
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), ~same]))
        pick = order[first]
        counts = np.add.reduceat(rows[2][order], first) if len(first) else rows[2]
        return (rows[0][pick], rows[1][pick], counts, *[x[pick] for x in rows[3:]])

    def leave(self, names: list[str], parts: int) -> Iterator[pa.RecordBatch]:
        """All of it as rows, and anew."""
        for lang, n in self.words.items():
            yield _rows([lang], [""], [0], [0], [n])
        if self.parts:
            key, _, n, start, end, size, lang = self._merged(tuple(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            data = np.concatenate(self.texts)
            data = np.where((data >= 65) & (data <= 90), data | 32, data)
            for lo in range(0, len(key), 1 << 14):
                some = slice(lo, lo + (1 << 14))
                phrases = _phrases(data, start[some], end[some], size[some])
                langs = pa.array(names, pa.string()).take(pa.array(lang[some]))
                yield _rows(langs, phrases, size[some].astype(np.int32), _short(key[some], parts).view(np.int64), n[some])
        self.__init__()


def _rows(lang, phrase, size, key, f) -> pa.RecordBatch:
    kinds = {"lang": pa.string(), "phrase": pa.string(), "size": pa.int32(), "key": pa.int64(), "f": pa.int64()}
    values = zip((lang, phrase, size, key, f), kinds.values(), strict=True)
    return pa.record_batch(dict(zip(kinds, [v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in values], strict=True)))


def _phrases(data: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray) -> pa.Array:
    """The words from start to end, joined by one space each."""
    length = end - start
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=at[1:])
    own = data[np.repeat(start - at[:-1], length) + np.arange(at[-1])]
    # nearly all stand in the text as they are to be; spaces in excess, and tabs, are cut out of the others
    tabs = np.concatenate([[0], np.cumsum(own == 9)])
    blanks = np.concatenate([[0], np.cumsum(own == 32)]) + tabs
    within = lambda sums: sums[at[1:]] - sums[at[:-1]]
    odd = np.flatnonzero((within(blanks) != size - 1) | (within(tabs) > 0))
    out = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(own)).cast(pa.string())
    if not len(odd):
        return out
    texts = out.to_pylist()
    for i in odd.tolist():
        texts[i] = " ".join(x for x in texts[i].replace("\t", " ").split(" ") if x)
    return pa.array(texts, pa.string())


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _short(key: np.ndarray, parts: int) -> np.ndarray:
    """Partition and lower half of a key: what summaries know of it."""
    return (_part(key, parts) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))


def _slot(short: np.ndarray, bits: int) -> np.ndarray:
    return (mix(short.copy()) >> np.uint64(64 - bits)).astype(np.int64)


def merged(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries summary of keys with counts, of which at most `capacity` remain; and what was taken from each count."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
    if len(keys) <= capacity:
        return keys, counts, 0
    taken = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    stay = counts > taken
    return keys[stay], counts[stay] - taken, taken


def summarize(docs: DataFrame, parts: int, least: int, longest: int) -> DataFrame:
    """(part, keys): the short keys left in each partition of the phrases of docs(text, lang_key). Every key that the texts hold
    `least` times is there."""

    def count(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for phrases, _, _ in _each(batches, longest):
            held.append(phrases.key)
            size += len(phrases.key)
            if size >= BUFFER:
                yield from leave(held)
                held, size = [], 0
        yield from leave(held)

    def leave(held: list[np.ndarray]):
        keys, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        if not len(keys):
            return
        part = _part(keys, parts).astype(np.int64)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        sizes = np.diff(first, append=len(keys))
        for lo in range(0, len(first), 1 << 12):
            rows = slice(int(first[lo]), int(first[lo] + sizes[lo : lo + (1 << 12)].sum()))
            yield pa.record_batch({
                "part": pa.array(part[first[lo : lo + (1 << 12)]]), "keys": lists((keys[rows] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), sizes[lo : lo + (1 << 12)], pa.int32()),
                "counts": lists(counts[rows].astype(np.int32), sizes[lo : lo + (1 << 12)], pa.int32()),
            })

    def merge(table: pa.Table) -> pa.Table:
        part = int(table.column("part")[0].as_py())
        summaries = [(k.values.to_numpy().view(np.uint32), c.values.to_numpy()) for k, c in zip(table.column("keys"), table.column("counts"), strict=True)]
        capacity = ROOM * (sum(int(c.sum(dtype=np.int64)) for _, c in summaries) // least + 1)
        keys, counts, lost, waiting, size = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0, [], 0
        for k, (more, n) in enumerate(summaries):
            waiting.append((more, n))
            size += len(more)
            if size >= max(capacity, 1 << 16) or k + 1 == len(summaries):
                keys, counts, taken = merged(np.concatenate([keys, *(x for x, _ in waiting)]), np.concatenate([counts, *(n for _, n in waiting)]), capacity)
                lost, waiting, size = lost + taken, [], 0
        short = (np.uint64(part) << np.uint64(32)) | keys[counts + lost >= least].astype(np.uint64)
        return pa.table({"part": pa.array([part]), "keys": lists(short.view(np.int64), np.array([len(short)]), pa.int64())})

    counted = mapped(docs.select("text", "lang_key"), count, "part long, keys array<int>, counts array<int>")
    return counted.groupBy("part").applyInArrow(merge, "part long, keys array<long>")


def count_exactly(docs: DataFrame, left: DataFrame, parts: int, least: int, longest: int) -> DataFrame:
    """(lang, phrase, size, f) of the phrases of docs(text, lang, lang_key) that are seen `least` times; left(keys) has their
    short keys and any others. The rows of size 0 are the languages' numbers of words."""
    n = left.agg(F.sum(F.size("keys"))).first()[0] or 0
    bits = max(10, min(MOST_BITS, math.ceil(math.log2(BITS_A_KEY * n + 1))))
    slots = lambda batches: (pa.record_batch({"slot": pa.array(_slot(b.column("key").to_numpy().view(np.uint64), bits))}) for b in batches)
    sent = shared(docs.sparkSession, bitmap(mapped(left.select(F.explode("keys").alias("key")), slots, "slot long"), "slot", bits))

    def count(batches: Iterator[pa.RecordBatch]):
        held, numbers = _Counted(), {}
        for phrases, rows, batch in _each(batches, longest, twice=True):
            langs = batch.column("lang").take(pa.array(rows)).to_pylist()
            for lang, k in zip(langs, np.diff(phrases.words.first).tolist(), strict=True):
                held.words[lang] += k
            at = np.flatnonzero(in_bitmap(sent.value, _slot(_short(phrases.key, parts), bits)))
            held.add(phrases, at, np.array([numbers.setdefault(lang, len(numbers)) for lang in langs], np.int64))
            if held.size >= SEEN or held.base >= MOST_TEXT:
                yield from held.leave(list(numbers), parts)
        yield from held.leave(list(numbers), parts)

    found = mapped(docs.select("text", "lang", "lang_key"), count, "lang string, phrase string, size int, key long, f long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def score_cuts(counts: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, size, a, l, r, score): counts(lang, phrase, size, f) of two words or more with the cut of the lowest score,
    of equal ones the first; score is floor(1000000 a a / (l r)). The parts of a phrase are at least as frequent, so they are there."""
    parts = counts.where("size > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("n"))
    whole = counts.where("size > 1").withColumn("words", F.split("phrase", " "))
    join = lambda lo, n: F.array_join(F.slice("words", lo, n), " ")
    cuts = F.array(*[F.struct(F.lit(k).alias("k"), join(F.lit(1), F.lit(k)).alias("left"), join(F.lit(k + 1), F.greatest(F.col("size") - k, F.lit(0))).alias("right")) for k in range(1, longest)])
    cut = whole.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.filter(cuts, lambda x: x["k"] < F.col("size"))).alias("c")).select("lang", "phrase", "size", "a", "c.*")
    cut = cut.join(parts.withColumnsRenamed({"part": "left", "n": "l"}), ["lang", "left"]).join(parts.withColumnsRenamed({"part": "right", "n": "r"}), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumns({"__a": wide("a") * wide("a") * F.lit(1000000), "__lr": wide("l") * wide("r")}).withColumn("score", F.expr("__a div __lr"))
    best = cut.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "size", "a", "b.l", "b.r", "b.score")


def inside_longer(counts: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase): phrases that stand inside a longer one of counts with at least so many percent of their own count."""
    longer = counts.where("size > 2").withColumn("words", F.split("phrase", " "))
    places = F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)
    parts = longer.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).select("lang", "n", "words", F.col("f").alias("most"), F.explode(places).alias("at"))
    parts = parts.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("n")), " ").alias("phrase"), "most").groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    return counts.where("size > 1").join(parts, ["lang", "phrase"]).where(F.col("most") * 100 >= F.col("f") * percent).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, percent: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of docs(text, lang) by score descending, a
    descending, phrase ascending in its bytes.

    A phrase has 2 to `longest` words of one piece and is seen a >= least times in its language; it goes where a longer one that
    it is part of is seen at least percent/100 as often. n is the number of words of the language. A null text has no words, a
    null lang is `und`; texts are read whole, whatever their length; repeated rows count as often as they are there; other
    columns are ignored. A table without such phrases gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNDETERMINED)).alias("lang"))
    docs = docs.where("text is not null").withColumn("lang_key", F.xxhash64("lang"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(n_bytes / PARTITION_BYTES))
    with scratch(spark):
        left = materialize(summarize(docs, parts, least, longest), "left")
        counts = materialize(count_exactly(docs, left, parts, least, longest), "counts")
        words = counts.where("size = 0").select("lang", F.col("f").alias("n"))
        scored = score_cuts(counts, longest).join(inside_longer(counts, percent), ["lang", "phrase"], "left_anti")
        order = [F.desc("score"), F.desc("a"), F.col("phrase")]
        ranked = first_of(scored.select("lang", "phrase", "a", "l", "r", "score"), ["lang"], order, top)
        out = ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
        return kept(out, "collocations")
