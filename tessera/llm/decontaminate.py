"""Benchmark decontamination: pairs of near words find passages that may copy a test item, Smith-Waterman alignment judges them.

Words are runs of letters, digits and non-ASCII characters, lower-cased in A-Z, so that other punctuation doesn't hide a copy.

A pair is two words of a text in order, next to each other or with one between. Say an alignment of an item of m words has M
matches and E errors (substitutions, gaps) and scores 2 M - E >= s. At most E / 2 of its M - 1 steps from match to match have two
errors or more, and each other step is a pair of the item and a pair of the passage; these are M - 1 - floor(E / 2) >=
ceil(s / 2) - 1 =: t. Diagonals (place in the document less place in the item) of one alignment differ by E <= 2 m - s at most.

A copy has LEAST_WORDS matches at least, or all words of a shorter item: with the score that so many matches have, an item of
fewer than 2 LEAST_WORDS words asks for more than half of the best score.

1. One pass over all texts counts the pairs that are also in a test item.
2. The pairs from m - 1 - t + k of an item's m - 1 places are its seeds, rarest first; as t places have a hit, k seeds do. Counts
   only order the places: with any other order the results would be the same.
3. k seeds in a band of diagonals (bands overlap, so that every alignment is whole in one) make a candidate passage.
4. Item and passage are aligned by words; the score is a share of the best possible one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, bitmap, bitmap_slot, bounded, in_bitmap, joined, kept, lists, mapped, materialize, mix, pieces, rolling, scratch, shared, utf8

#: Least words of an item that is looked for inside texts; matched words of a copy at least.
SEED, LEAST_WORDS = 3, 8
#: Least and most bits of the bitmaps of pairs and of candidate documents; bits for each of these.
LEAST_BITS, MOST_BITS, BITS_EACH = 22, 27, 16
#: Seeds that a candidate has (k), where alignments are sure to hold as many.
LEAST_SEEDS = 4
#: Alignment scores, and the share of the best possible score from which a passage is a copy.
MATCH, MISMATCH, GAP, THRESHOLD = 2, -1, -1, 0.5
#: Cells of the alignment matrix that are worked on at one time.
CELLS = 1 << 20


def _fold(data: np.ndarray) -> np.ndarray:
    """ASCII punctuation and controls become spaces, A-Z lower case; offsets stay."""
    table = np.full(256, 32, np.uint8)
    keep = [c for c in range(256) if c >= 128 or chr(c).isalnum()]
    table[keep] = keep
    table[65:91] += 32
    return table[data]


def _pairs(w: Words, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each pair (of those in the bitmap) inside a row, and the place of its first word among all words."""
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    grams, places = [], []
    for gap in (1, 2):
        place = np.flatnonzero(row[:-gap] == row[gap:])
        gram = mix(joined(w.hash[place], w.hash[place + gap]))
        if bits is not None:
            size = (32 * len(bits)).bit_length() - 1
            keep = in_bitmap(bits, (gram >> np.uint64(64 - size)).astype(np.int64))
            gram, place = gram[keep], place[keep]
        grams.append(gram)
        places.append(place)
    return np.concatenate(grams), np.concatenate(places)


def _pair_rows(df: DataFrame, key: str, bits=None) -> DataFrame:
    """(key, text_key, size in words, gram, place in its row) of each pair of df(key, text_key, text), or of those in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in pieces(at):
                lo = int(at[i])
                w = Words(_fold(data[lo : int(at[j])]), at[i : j + 1] - lo, fold=False)
                gram, place = _pairs(w, bits and bits.value)
                row = np.searchsorted(w.first, place, "right") - 1
                own = pa.array(row + i)
                yield pa.record_batch({
                    key: batch.column(key).take(own), "text_key": batch.column("text_key").take(own), "size": pa.array(np.diff(w.first)[row]),
                    "gram": pa.array(gram.view(np.int64)), "place": pa.array(place - w.first[row]),
                })

    return mapped(df.select(key, "text_key", "text"), run, f"{key} long, text_key long, size long, gram long, place long")


def _whole_rows(df: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, text_key, whole): a hash of all words of each text of 1 to seed - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in pieces(at):
                lo = int(at[i])
                w = Words(_fold(data[lo : int(at[j])]), at[i : j + 1] - lo, fold=False)
                size = np.diff(w.first)
                rows = np.flatnonzero((size > 0) & (size < seed))
                if len(rows):
                    whole = np.array([rolling(w.hash[w.row(r)], int(size[r]))[0] for r in rows.tolist()], np.uint64)
                    own = pa.array(rows + i)
                    yield pa.record_batch({key: batch.column(key).take(own), "text_key": batch.column("text_key").take(own), "whole": pa.array(whole.view(np.int64))})

    return mapped(df.select(key, "text_key", "text"), run, f"{key} long, text_key long, whole long").distinct()


def _pair_counts(docs: DataFrame, bits) -> DataFrame:
    """(gram, n): how often docs(text) have each pair of the bitmap; summed up in each piece first."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in pieces(at):
                lo = int(at[i])
                gram, n = np.unique(_pairs(Words(_fold(data[lo : int(at[j])]), at[i : j + 1] - lo, fold=False), bits.value)[0], return_counts=True)
                yield pa.record_batch({"gram": pa.array(gram.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return mapped(docs.select("text"), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def smith_waterman(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair of word hash sequences; all pairs advance together, a row of a at a time."""
    if not a:
        return np.zeros(0, np.int64)
    long, wide = max(map(len, a)), max(map(len, b))
    left, right = np.zeros((len(a), long), np.uint64), np.ones((len(a), wide), np.uint64)
    real_a, real_b = np.zeros((len(a), long), bool), np.zeros((len(a), wide), bool)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        left[k, : len(x)], real_a[k, : len(x)] = x, True
        right[k, : len(y)], real_b[k, : len(y)] = y, True
    step = np.arange(wide) * GAP
    above, best = np.zeros((len(a), wide + 1), np.int64), np.zeros(len(a), np.int64)
    for i in range(long):
        hit = (left[:, i : i + 1] == right) & real_b & real_a[:, i : i + 1]
        cell = np.maximum(np.maximum(above[:, :-1] + np.where(hit, MATCH, MISMATCH), above[:, 1:] + GAP), 0)
        cell = np.maximum.accumulate(cell - step, axis=1) + step  # gaps along the passage
        above[:, 1:] = cell
        best = np.maximum(best, (cell * real_b).max(axis=1))
    return best


def _seeds(pairs: DataFrame, counts: DataFrame, threshold: float, seed: int) -> DataFrame:
    """(gram, item_id, item_key, size, item_place, least, width): the pairs of each item that alignments are looked for by."""
    pairs = pairs.where(F.col("size") >= seed).join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    score = F.greatest(F.ceil(F.col("size") * F.lit(MATCH * threshold) - F.lit(1e-9)), F.least(F.col("size"), F.lit(LEAST_WORDS)) * MATCH)
    sure = F.ceil(score / MATCH) - 1
    least = F.least(F.lit(LEAST_SEEDS), sure)
    mine = Window.partitionBy("item_id", "item_key").orderBy("cost", "place")
    places = pairs.groupBy("item_id", "item_key", "size", "place").agg(F.sum("n").alias("cost")).withColumn("rank", F.row_number().over(mine))
    places = places.where(F.col("rank") <= F.col("size") - 1 - sure + least).select("item_id", "item_key", "place")
    # a pair that no document has can't be hit
    found = pairs.where("n > 0").join(places, ["item_id", "item_key", "place"])
    width = F.greatest(F.col("size") * MATCH - score + 1, F.lit(8))
    return found.select("gram", "item_id", "item_key", "size", F.col("place").alias("item_place"), least.alias("least"), width.alias("width"))


def _candidates(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, item_key, from, to, seeds): passages with enough seeds of an item on near diagonals."""
    joined = hits.drop("size").join(bounded(seeds), "gram")
    start = F.floor((F.col("place") - F.col("item_place")) / F.col("width"))
    # bands of two widths that overlap by half: diagonals up to a width apart are in one of them
    rows = joined.withColumn("band", F.explode(F.array(start, start - 1)))
    found = rows.groupBy("doc_id", "text_key", "item_id", "item_key", "size", "width", "least", "band").agg(F.countDistinct("item_place").alias("seeds"))
    at = F.col("band") * F.col("width")
    return found.where(F.col("seeds") >= F.col("least")).select(
        "doc_id", "text_key", "item_id", "item_key", F.greatest(at, F.lit(0)).alias("from"), (at + 2 * F.col("width") + F.col("size")).alias("to"), "seeds",
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """(doc_id, item_id, n_seeds, score) of each document of docs(doc_id, text) with a copy of an item of benchmark(item_id, text).

    score is the best alignment of any passage over the best possible one (0 to 1), at least `threshold` (0.5 or more), and at least
    that of LEAST_WORDS matches, or of the whole item where it is shorter; n_seeds are the seeds of that passage. Inside a text, items of fewer than `seed` words can't be told from chance: they match (with 0 seeds)
    the texts that have just their words. Null and empty texts match nothing; rows without an id are left out. Repeated rows give one result. Very long texts are searched whole.
    """
    if threshold < THRESHOLD or seed < SEED:
        raise ValueError(f"below a score of {THRESHOLD} or {SEED} words an alignment may hold no seed")
    with scratch(docs.sparkSession):
        found = _leaks(docs, benchmark, threshold, seed).groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "n_seeds")).alias("b"))
        return kept(found.select("doc_id", "item_id", F.col("b.n_seeds").alias("n_seeds"), F.col("b.score").alias("score")), "leaks")


def _bits(n: int) -> int:
    """Bits of a bitmap of n entries."""
    return min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n).bit_length()))


def _leaks(docs: DataFrame, benchmark: DataFrame, threshold: float, seed: int) -> DataFrame:
    """(doc_id, text_key, item_id, n_seeds, score), one row for each passage that is a copy."""
    key = F.xxhash64("text").alias("text_key")
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("*", key)
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).select("*", key).distinct()
    spark = docs.sparkSession
    pairs = materialize(_pair_rows(items, "item_id").withColumnRenamed("text_key", "item_key"), "item-pairs")

    def slots_of(df: DataFrame):
        bits = _bits(df.count())
        return shared(spark, bitmap(df.select(F.shiftrightunsigned("gram", 64 - bits).alias("slot")), "slot", bits))

    counts = _pair_counts(docs, slots_of(pairs)).join(bounded(pairs.select("gram").distinct()), "gram", "left_semi")
    seeds = materialize(_seeds(pairs, materialize(counts, "pair-counts"), threshold, seed), "seeds")
    found = materialize(_candidates(_pair_rows(docs, "doc_id", slots_of(seeds)), seeds), "candidates")

    bits = _bits(found.count())
    slots = shared(spark, bitmap(found.select(bitmap_slot(F.col("doc_id"), bits).alias("slot")), "slot", bits))

    def some(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = in_bitmap(slots.value, batch.column("slot").to_numpy(zero_copy_only=False))
            if keep.any():
                yield batch.filter(pa.array(keep)).select(["doc_id", "text_key", "text"])

    texts = mapped(docs.withColumn("slot", bitmap_slot(F.col("doc_id"), bits)), some, "doc_id long, text_key long, text string").distinct()
    spans = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item_id", "item_key", "from", "to", "seeds")).alias("spans"))
    passages = texts.join(spans, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "spans")
    passages = mapped(passages, _passages, "doc_id long, text_key long, item_id long, item_key long, seeds long, passage array<long>")
    rows = passages.join(bounded(items.select("item_id", F.col("text_key").alias("item_key"), "text"), 1 << 16), ["item_id", "item_key"])
    scored = mapped(rows.select("doc_id", "text_key", "item_id", "seeds", "passage", "text"), _scores, "doc_id long, text_key long, item_id long, n_seeds long, score double")
    short = _whole_rows(items, "item_id", seed).drop("text_key").join(_whole_rows(docs, "doc_id", seed), "whole")
    short = short.select("doc_id", "text_key", "item_id", F.lit(0).cast("long").alias("n_seeds"), F.lit(1.0).alias("score"))
    return scored.where(F.col("score") >= threshold).unionByName(short)


def _passages(batches: Iterator[pa.RecordBatch]):
    """Word hashes of each candidate passage."""
    for batch in batches:
        data, at = utf8(batch.column("text"))
        spans = batch.column("spans")
        for i, j in pieces(at):
            lo = int(at[i])
            w = Words(_fold(data[lo : int(at[j])]), at[i : j + 1] - lo, fold=False)
            out = {"doc_id": [], "text_key": [], "item_id": [], "item_key": [], "seeds": []}
            parts = []
            for r in range(i, j):
                h = w.hash[w.row(r - i)]
                for span in spans[r].as_py():
                    parts.append(h[span["from"] : span["to"]])
                    for c in ("doc_id", "text_key"):
                        out[c].append(batch.column(c)[r].as_py())
                    for c in ("item_id", "item_key", "seeds"):
                        out[c].append(span[c])
            if parts:
                yield pa.record_batch({**{k: pa.array(v, pa.int64()) for k, v in out.items()}, "passage": lists(np.concatenate(parts).view(np.int64), np.array([len(p) for p in parts]), pa.int64())})


def _scores(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        data, at = utf8(batch.column("text"))
        w = Words(_fold(data[int(at[0]) : int(at[-1])]), at - at[0], fold=False)
        items = [w.hash[w.row(i)] for i in range(len(batch))]
        passages = batch.column("passage")
        found = [p.values.to_numpy().view(np.uint64) for p in passages]
        best = np.zeros(len(batch), np.int64)
        i = 0
        while i < len(batch):
            j, wide = i + 1, len(found[i])
            while j < len(batch) and max(wide, len(found[j])) * (j + 1 - i) <= CELLS:
                wide, j = max(wide, len(found[j])), j + 1
            best[i:j] = smith_waterman(items[i:j], found[i:j])
            i = j
        size = np.array([max(1, len(x)) for x in items])
        own = {c: batch.column(c) for c in ("doc_id", "text_key", "item_id")}
        found = pa.record_batch({**own, "n_seeds": batch.column("seeds"), "score": pa.array(best / (MATCH * size))})
        yield found.filter(pa.array(best >= MATCH * np.minimum(size, LEAST_WORDS)))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that copy a benchmark item, whatever their doc_id; all columns stay, and repeated rows.

    Rows are judged by two hashes of their text, 128 bits, so that null and repeated ids neither hide nor condemn a text.
    """
    text = F.col("text").cast("string")
    number, text_key = F.xxhash64(F.lit(1), text), F.xxhash64(text)
    with scratch(docs.sparkSession):
        leaks = _leaks(docs.select(number.alias("doc_id"), "text"), benchmark, threshold, SEED)
        leaks = kept(leaks.select(F.col("doc_id").alias("__leak"), F.col("text_key").alias("__leak_key")).distinct(), "leaks")
    return docs.join(bounded(leaks), (number == F.col("__leak")) & (text_key == F.col("__leak_key")), "left_anti")
