"""Removal of repeated passages with a log-structured fingerprint index.

A window is `window` consecutive words. Of the shorter grams inside a window the one with the smallest hash marks it, so equal
windows have equal marks, and consecutive windows with one mark are a block. The index keeps sorted, immutable runs of
(mark, smallest and largest doc_id) under a manifest. Each new batch of documents becomes a run: it is merge-joined with the runs
before it, marks that a second document has are noted, and runs are compacted when there are many. An index is opened again by
its path, so that a later batch is held against all earlier ones.

Only windows under such marks are looked at further: hashes of whole blocks and, where a block as a whole is not repeated, of each
whole window find an earlier document with the same words. These windows are joined to passages, and a passage is only removed
after its words were verified against those of the earlier document.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, bitmap, bitmap_slot, drop, in_bitmap, joined, kept, lists, mapped, materialize, mix, new_path, pieces, rolling, scratch, shared, utf8

#: Bits of the bitmaps of repeated marks and of documents with passages, which thin out rows before they are shuffled.
MARK_BITS, DOC_BITS = 24, 22
RUN_SCHEMA = "mark long, lo long, hi long"


class FingerprintIndex:
    """Sorted runs of marks; a run is written once and only read or merged afterwards. The manifest with the highest number holds."""

    def __init__(self, spark: SparkSession, path: str | None = None, most_runs: int = 3):
        self.spark, self.path, self.most_runs = spark, path or new_path(spark, "fingerprints"), most_runs
        self.runs: list[str] = []
        self.written = 0
        self.store, self.root = fs.FileSystem.from_uri(self.path)
        found = self.store.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        if names := sorted(x.path for x in found if x.base_name.startswith("manifest-")):
            with self.store.open_input_file(names[-1]) as f:
                state = json.loads(f.read())
            self.runs, self.written = state["runs"], state["written"]

    def _write(self, rows: DataFrame) -> str:
        run = f"run-{self.written:06d}"
        self.written += 1
        rows.sortWithinPartitions("mark").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{run}")
        return run

    def _commit(self, runs: list[str]) -> None:
        """Runs that no manifest names, as after a failure, are written over or stay unread."""
        self.runs = runs
        with self.store.open_output_stream(f"{self.root}/manifest-{self.written:06d}.json") as f:
            f.write(json.dumps({"runs": runs, "written": self.written}).encode())

    def read(self, run: str) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.path}/{run}")

    def append(self, marks: DataFrame) -> DataFrame:
        """Add a batch's (mark, doc_id) as a run; returns the marks of the batch that two documents have by now."""
        run = self._write(marks.groupBy("mark").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")))
        new = self.read(run)
        found = new.where("lo < hi").select("mark")
        for old in self.runs:
            past = self.read(old).select("mark", F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"))
            found = found.union(new.join(past.hint("merge"), "mark").where("old_lo <> lo or old_hi <> hi").select("mark"))
        found = materialize(found, "found")
        self._commit([*self.runs, run])
        if len(self.runs) > self.most_runs:
            self.compact()
        return found

    def compact(self) -> None:
        """Merge all runs into one; the old ones go when the manifest doesn't name them any more."""
        rows, old = self.read(self.runs[0]), self.runs
        for run in old[1:]:
            rows = rows.union(self.read(run))
        self._commit([self._write(rows.groupBy("mark").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))])
        for run in old:
            drop(f"{self.path}/{run}")


class _Windows:
    """Windows of the rows of one piece: mark and document of each, and where blocks begin."""

    def __init__(self, w: Words, window: int, gram: int):
        self.w, h = w, w.hash
        n = len(h) - window + 1
        self.row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))  # of each word
        if n <= 0:
            self.at = self.place = np.zeros(0, np.int64)
            return
        grams = rolling(h, gram)
        low = np.uint64((1 << 22) - 1)
        key = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
        span, have = window - gram + 1, 1
        while have < span:  # smallest key of ever wider spans; of equal hashes, the leftmost
            step = min(have, span - have)
            key = np.minimum(key[:-step], key[step:])
            have += step
        self.at = np.flatnonzero(self.row[:n] == self.row[window - 1 :])  # windows inside one row
        whole = np.arange(n)
        place = whole + ((key & low).astype(np.int64) - whole) % (1 << 22)
        self.place = place[self.at]
        self.grams = grams


def _blocks(w: Words, window: int, gram: int):
    """Row, first window's word, number of windows and mark of each block, in order."""
    x = _Windows(w, window, gram)
    if not len(x.at):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    head = np.ones(len(x.at), bool)
    head[1:] = (x.place[1:] != x.place[:-1]) | (x.at[1:] != x.at[:-1] + 1)
    begin = np.flatnonzero(head)
    count = np.diff(np.append(begin, len(x.at)))
    return x.row[x.at[begin]], x.at[begin], count, x.grams[x.place[begin]]


def _marks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in pieces(at):
                row, _, _, mark = _blocks(Words(data, at[i : j + 1], fold=False), window, gram)
                if len(row):
                    yield pa.record_batch({"mark": pa.array(mark.view(np.int64)), "doc_id": batch.column("doc_id").take(pa.array(row + i))})

    return mapped(docs.select("doc_id", "text"), run, "mark long, doc_id long")


def _repeated_blocks(docs: DataFrame, window: int, gram: int, marks: DataFrame) -> DataFrame:
    """Blocks under repeated marks: doc_id, text_key, place (first word), n (windows), block (hash of all its words), windows (hash of each)."""
    bits = shared(docs.sparkSession, bitmap(marks.select((F.shiftrightunsigned("mark", 64 - MARK_BITS)).alias("slot")), "slot", MARK_BITS))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in pieces(at):
                w = Words(data, at[i : j + 1], fold=False)
                row, begin, count, mark = _blocks(w, window, gram)
                keep = np.flatnonzero(in_bitmap(bits.value, (mark >> np.uint64(64 - MARK_BITS)).astype(np.int64)))
                if not len(keep):
                    continue
                row, begin, count, mark = row[keep], begin[keep], count[keep], mark[keep]
                windows = rolling(w.hash, window)
                # the first and the last window have all words of the block, as it has fewer windows than a window has words
                block = mix(joined(windows[begin], windows[begin + count - 1]) + count.astype(np.uint64))
                inside = np.repeat(begin - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
                own = pa.array(row + i)
                yield pa.record_batch({
                    "mark": pa.array(mark.view(np.int64)), "doc_id": batch.column("doc_id").take(own), "text_key": batch.column("text_key").take(own),
                    "place": pa.array((begin - w.first[row]).astype(np.int32)), "n": pa.array(count.astype(np.int32)), "block": pa.array(block.view(np.int64)),
                    "windows": lists(windows[inside].view(np.int64), count, pa.int64()),
                })

    schema = "mark long, doc_id long, text_key long, place int, n int, block long, windows array<long>"
    return mapped(docs.select("doc_id", "text", "text_key"), run, schema).join(marks, "mark", "left_semi").drop("mark")


def _earlier(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one document has, with where the smallest doc_id has them; written, so that a join with it can split a
    frequent key."""
    first = F.min(F.struct("doc_id", "text_key", "place")).alias("first")
    return materialize(rows.groupBy(key).agg(first, F.max("doc_id").alias("hi")).where("first.doc_id < hi").select(key, "first"), "earlier")


def _candidates(blocks: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, from, to, first_id, first_key, first_from): passages whose windows' hashes an earlier document has."""
    found = lambda df, n: df.select("doc_id", "text_key", F.col("place").alias("from"), (F.col("place") + n + (window - 1)).alias("to"), "first")
    judged = blocks.join(_earlier(blocks, "block"), "block", "left")
    later = F.coalesce(F.col("doc_id") > F.col("first.doc_id"), F.lit(False))
    single = materialize(
        judged.where(~later).select("doc_id", "text_key", "place", F.posexplode("windows").alias("i", "hash"))
        .select("doc_id", "text_key", (F.col("place") + F.col("i")).alias("place"), "hash"), "windows",
    )
    claims = found(judged.where(later), F.col("n")).union(found(single.join(_earlier(single, "hash"), "hash").where("doc_id > first.doc_id"), F.lit(1)))
    by = ["doc_id", "text_key", "first_id", "first_key", "shift"]
    claims = claims.select("from", "to", "doc_id", "text_key", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"), (F.col("first.place") - F.col("from")).alias("shift"))
    order = Window.partitionBy(*by).orderBy("from", "to")
    reached = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # a passage begins where none before it reaches
    claims = claims.withColumn("begins", F.coalesce(F.col("from") > reached, F.lit(True)).cast("int"))
    claims = claims.withColumn("passage", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = claims.groupBy(*by, "passage").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return spans.select("doc_id", "text_key", "from", "to", "first_id", "first_key", (F.col("from") + F.col("shift")).alias("first_from"))


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text_key, text) of documents that ids may name; other texts stay where they are."""
    bits = shared(docs.sparkSession, bitmap(ids.select(bitmap_slot(F.col("doc_id"), DOC_BITS).alias("slot")), "slot", DOC_BITS))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = in_bitmap(bits.value, batch.column("slot").to_numpy(zero_copy_only=False))
            if keep.any():
                yield batch.filter(pa.array(keep)).select(["doc_id", "text_key", "text"])

    docs = docs.select("doc_id", "text_key", "text", bitmap_slot(F.col("doc_id"), DOC_BITS).alias("slot"))
    return mapped(docs, run, "doc_id long, text_key long, text string")


def _digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text_key, from, to, words): a digest of the words of each of spans(doc_id, text_key, from, to)."""
    asked = materialize(spans.distinct().groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("from", "to")).alias("spans")), "asked")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in pieces(at):
                w = Words(data, at[i : j + 1], fold=False)
                raw = w.data.tobytes()
                out = {"doc_id": [], "text_key": [], "from": [], "to": [], "words": []}
                for r in range(i, j):
                    start, end = w.start[w.row(r - i)].tolist(), w.end[w.row(r - i)].tolist()
                    for span in batch.column("spans")[r].as_py():
                        a, b = span["from"], span["to"]
                        words = b" ".join([raw[s:e] for s, e in zip(start[a:b], end[a:b], strict=True)])
                        row = (batch.column("doc_id")[r].as_py(), batch.column("text_key")[r].as_py(), a, b, hashlib.blake2b(words, digest_size=16).digest())
                        for k, v in zip(out, row, strict=True):
                            out[k].append(v)
                kinds = {"from": pa.int32(), "to": pa.int32(), "words": pa.binary()}
                yield pa.record_batch({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    rows = _texts_of(docs, asked).join(asked, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "spans")
    return materialize(mapped(rows, run, "doc_id long, text_key long, from int, to int, words binary").distinct(), "digests")


def repeated_passages(docs: DataFrame, window: int = 50, batches: int = 1, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_key, spans): words [from, to) of windows that a document with a smaller doc_id also has.

    docs go into the index in `batches` parts by doc_id, one after the other. An index that has marks already needs `history`:
    the documents that these are of.
    """
    gram = (window + 1) // 2
    docs = docs.where("doc_id is not null")
    index = index or FingerprintIndex(docs.sparkSession)
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or [])) if batches > 1 else []
    batch = sum([(F.col("doc_id") > cut).cast("int") for cut in cuts], F.lit(0))
    marks = _marks(docs, window, gram)
    if cuts:
        marks = materialize(marks.withColumn("batch", batch), "marks")
    new = [index.append(marks.where(F.col("batch") == k).select("mark", "doc_id") if cuts else marks) for k in range(len(cuts) + 1)]
    found = new[0]
    for more in new[1:]:
        found = found.union(more)
    whole = docs if history is None else docs.unionByName(_keyed(history).where("doc_id is not null"))
    blocks = materialize(_repeated_blocks(whole, window, gram, materialize(found.distinct(), "repeated")), "blocks")
    passages = materialize(_candidates(blocks, window), "passages")
    first = passages.select(F.col("first_id").alias("doc_id"), F.col("first_key").alias("text_key"), F.col("first_from").alias("from"), (F.col("first_from") + F.col("to") - F.col("from")).alias("to"))
    spans = ["doc_id", "text_key", "from", "to"]
    words = _digests(whole, passages.select(*spans).union(first))
    other = words.select(F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key"), F.col("from").alias("first_from"), (F.col("to") - F.col("from")).alias("size"), F.col("words").alias("first_words"))
    passages = passages.withColumn("size", F.col("to") - F.col("from")).join(words, spans).join(other, ["first_id", "first_key", "first_from", "size"])
    return passages.where("words = first_words").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("text_key", F.xxhash64("text"))


def remove_repeats(docs: DataFrame, window: int = 50, batches: int = 1, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept_sha256) of each row of docs(doc_id, text).

    Words are runs of bytes other than 0x09-0x0D and 0x20, unchanged. A word goes if a window of `window` words that covers it
    also begins in a document with a smaller doc_id; windows are judged on the input. text is the kept words joined by one
    space (kept_sha256: its digest); null and wordless texts keep none, and shorter texts keep all. Texts of any length are
    judged whole. A row without doc_id loses nothing and takes nothing from others; rows with one doc_id never take from each
    other. Repeated rows stay repeated, other columns are ignored. index and history: see repeated_passages; without an index,
    one is made for the call.
    """
    docs, own = _keyed(docs), None if index else FingerprintIndex(docs.sparkSession)
    with scratch(docs.sparkSession):
        spans = materialize(repeated_passages(docs, window, batches, index or own, history), "spans")
        if own:
            drop(own.path)
        bits = shared(docs.sparkSession, bitmap(spans.select(bitmap_slot(F.col("doc_id"), DOC_BITS).alias("slot")), "slot", DOC_BITS))

        def others(rows: Iterator[pa.RecordBatch]):
            for batch in rows:
                slot = batch.column("slot")
                keep = pa.array(~in_bitmap(bits.value, slot.fill_null(0).to_numpy(zero_copy_only=False)) | slot.is_null().to_numpy(zero_copy_only=False))
                batch = batch.filter(keep)
                none = pa.nulls(len(batch), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))
                yield from _without_spans(iter([pa.record_batch({"doc_id": batch.column("doc_id"), "text": batch.column("text"), "spans": none})]))

        named = docs.where("doc_id is not null")
        hit = _texts_of(named, spans).join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
        rest = docs.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), bitmap_slot(F.col("doc_id"), DOC_BITS)).alias("slot"))
        schema = "doc_id long, text string, n_words long, n_removed long, kept_sha256 string"
        return kept(mapped(hit, _without_spans, schema).union(mapped(rest, others, schema)), "kept-texts")


def _without_spans(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) with the words of the spans gone."""
    for batch in rows:
        data, at = utf8(batch.column("text"))
        spans = batch.column("spans")
        for i, j in pieces(at):
            w = Words(data, at[i : j + 1], fold=False)
            out = {"text": [], "n_words": [], "n_removed": [], "kept_sha256": []}
            raw = w.data.tobytes()
            for r in range(j - i):
                own = w.row(r)
                start, end = w.start[own], w.end[own]
                keep = np.ones(len(start), bool)
                if (covers := spans[i + r]).is_valid:
                    cover = np.zeros(len(start) + 1, np.int64)
                    ends = covers.values.flatten()
                    np.add.at(cover, ends[0].to_numpy(), 1)
                    np.add.at(cover, ends[1].to_numpy(), -1)
                    keep = np.cumsum(cover[:-1]) == 0
                words = b" ".join([raw[s:e] for s, e in zip(start[keep].tolist(), end[keep].tolist(), strict=True)])
                out["text"].append(words)
                out["n_words"].append(len(start))
                out["n_removed"].append(int(len(start) - keep.sum()))
                out["kept_sha256"].append(hashlib.sha256(words).hexdigest())
            text = pa.array(out.pop("text"), pa.binary()).cast(pa.string())
            yield pa.record_batch({"doc_id": batch.column("doc_id").slice(i, j - i), "text": text, **{k: pa.array(v) for k, v in out.items()}})
