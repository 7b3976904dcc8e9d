"""Ranked lexical search of many queries at once, with shared parts of queries evaluated once.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, lower-cased in A-Z. Queries are sets of terms.

1. Queries are dealt by hash into blocks with a bounded number of terms; each block is one pass over the documents.
2. A pass notes of each document its length and the block's terms in it (a written table), and sums up what weights need.
3. Term sets that queries share are mined: terms of exactly the same queries are one node; then, again and again, two
   neighbouring nodes that two queries or more have become a new one (`SharingPlan`). Each query is a union of nodes.
4. Documents are scored some at a time: an accumulator for each node and document, the terms' partial scores at the bottom,
   each shared node added up once and read by all that hold it. A task keeps the best documents of each query; these meet in the
   end.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, lists, mapped, materialize, scratch, shared
from .ranks import first_of

#: Terms as bytes of UTF-8, after lower-casing, and as a Spark pattern before it.
TERM, PATTERN = re.compile(rb"[0-9a-z\x80-\xff]+"), r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of the queries of a block, on average; accumulators (nodes times documents) and candidates that a task holds at one time.
BLOCK_TERMS, CELLS, POOL = 1 << 16, 1 << 21, 1 << 18


class SharingPlan:
    """How the queries of a block share term sets. leaf_of[t] is term t's node. Nodes from `leaves` on are the sums of nodes
    left[k] and right[k], level by level (`levels`: ranges of these). roots are the queries' nodes, query after query from `first`."""

    def __init__(self, queries: list[list[int]], n_terms: int):
        held: list[list[int]] = [[] for _ in range(n_terms)]
        for q, terms in enumerate(queries):
            for t in terms:
                held[t].append(q)
        classes: dict[tuple[int, ...], int] = {}
        self.leaf_of = np.array([classes.setdefault(tuple(qs), len(classes)) for qs in held], np.int64)
        self.leaves, self.left, self.right, self.levels = len(classes), [], [], []
        uses = np.array([len(qs) for qs in classes], np.int64)
        # nodes of many queries first, so that what is shared stands together
        rows = [sorted(set(self.leaf_of[terms].tolist()), key=lambda k: (-uses[k], k)) for terms in queries]
        while True:
            pairs = Counter(pair for row in rows for pair in zip(row, row[1:]))
            shared_pairs = sorted((p for p, n in pairs.items() if n > 1), key=lambda p: (-pairs[p], p))
            # a node enters one pair of a round, so that no query's pairs overlap
            taken: set[int] = set()
            new: dict[tuple[int, int], int] = {}
            for a, b in shared_pairs:
                if a not in taken and b not in taken:
                    taken |= {a, b}
                    new[a, b] = self.leaves + len(self.left)
                    self.left.append(a)
                    self.right.append(b)
            if not new:
                break
            self.levels.append((len(self.left) - len(new), len(self.left)))
            rows = [self._replaced(row, new) for row in rows]
        self.roots = np.array([k for row in rows for k in row], np.int64)
        self.first = np.cumsum([0, *map(len, rows)])[:-1]
        self.left, self.right = np.array(self.left, np.int64), np.array(self.right, np.int64)

    @staticmethod
    def _replaced(row: list[int], new: dict[tuple[int, int], int]) -> list[int]:
        out, i = [], 0
        while i < len(row):
            pair = new.get((row[i], row[i + 1])) if i + 1 < len(row) else None
            out.append(row[i] if pair is None else pair)
            i += 1 if pair is None else 2
        return out

    @property
    def nodes(self) -> int:
        return self.leaves + len(self.left)

    def combine(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """Scores (queries x docs) from the value of each term in each document."""
        acc = np.zeros((self.nodes, docs), np.int64)
        np.add.at(acc.reshape(-1), self.leaf_of[term] * docs + doc, value)
        for lo, hi in self.levels:
            acc[self.leaves + lo : self.leaves + hi] = acc[self.left[lo:hi]] + acc[self.right[lo:hi]]
        return np.add.reduceat(acc[self.roots], self.first, axis=0)


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), once each; rows of one item_id, null among them, are one query."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select("item_id", F.explode(F.regexp_extract_all(low, F.lit(PATTERN), 0)).alias("term")).distinct()


def term_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, ids, tfs) of docs(doc_id, text) with a term: the number of its terms, and which of the vocabulary it has how often."""

    def run(batches: Iterator[pa.RecordBatch]):
        known = vocabulary.value
        for batch in batches:
            n, ids, tfs, sizes = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                terms = TERM.findall(text.lower()) if text else []
                n.append(len(terms))
                found = [(known[t], k) for t, k in Counter(terms).items() if t in known]
                ids += [i for i, _ in found]
                tfs += [k for _, k in found]
                sizes.append(len(found))
            at = np.array(sizes, np.int64)
            columns = {"doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()), "ids": lists(np.array(ids, np.int32), at, pa.int32()), "tfs": lists(np.array(tfs, np.int32), at, pa.int32())}
            yield pa.record_batch(columns).filter(pa.array(np.array(n, np.int64) > 0))

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n long, ids array<int>, tfs array<int>")


class _Best:
    """The best documents of each query so far, and what a document must reach to be among them."""

    def __init__(self, queries: int, top: int):
        self.top, self.held, self.size, self.most = top, [], 0, max(POOL, 2 * queries * top)
        self.least = np.ones(queries, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        q, d = np.nonzero(scores >= self.least[:, None])
        if len(q):
            self.held.append((q, scores[q, d], ids[d]))
            self.size += len(q)
            if self.size >= self.most:
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, score, ids = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        stay = place < self.top
        full = place == self.top - 1
        self.least[q[full]] = score[full]
        self.held = [(q[stay], score[stay], ids[stay])]
        self.size = int(stay.sum())
        return self.held[0]


#: Stands for a null doc_id, after all others.
_NULL = np.iinfo(np.int64).max


def best_documents(counts: DataFrame, plan, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(query, doc_id, score): each task's best documents of counts(doc_id, n, ids, tfs) for each query of the plan."""
    sent = shared(counts.sparkSession, weights)

    def run(batches: Iterator[pa.RecordBatch]):
        p, w = plan.value, sent.value
        best = _Best(len(p.first), top)
        step = max(1, CELLS // max(1, p.nodes))
        for whole in batches:
            for batch in (whole.slice(lo, step) for lo in range(0, len(whole), step)):
                ids, tfs = batch.column("ids"), batch.column("tfs").flatten().to_numpy()
                sizes = np.diff(ids.offsets.to_numpy())
                doc = np.repeat(np.arange(len(batch)), sizes)
                m = 10 + (90 * batch.column("n").to_numpy() * n_docs) // n_terms
                term, tf = ids.flatten().to_numpy(), tfs.astype(np.int64)
                value = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                best.add(p.combine(term, doc, value, len(batch)), batch.column("doc_id").fill_null(_NULL).to_numpy())
        q, score, ids = best.settle()
        yield pa.record_batch({"query": pa.array(q, pa.int32()), "doc_id": pa.array(ids, pa.int64(), mask=ids == _NULL), "score": pa.array(score, pa.int64())})

    return mapped(counts, run, "query int, doc_id long, score long")


def _block(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """(query, doc_id, score, item_id) for the queries of rows(item_id, term), a bounded number."""
    spark = docs.sparkSession
    items = {item: k for k, item in enumerate(dict.fromkeys(r.item_id for r in rows))}
    terms = {term: k for k, term in enumerate(dict.fromkeys(r.term for r in rows))}
    queries: list[list[int]] = [[] for _ in items]
    for r in rows:
        queries[items[r.item_id]].append(terms[r.term])
    plan = shared(spark, SharingPlan(queries, len(terms)))
    counts = materialize(term_counts(docs, shared(spark, {t.encode(): k for t, k in terms.items()})), "term-counts")
    n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(terms), np.int64)
    for r in counts.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # a row for each term of the block at most
        df[r["id"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    names = spark.createDataFrame([(k, item) for item, k in items.items()], "query int, item_id long")
    return best_documents(counts, plan, weights, n_docs, n_terms or 1, top).join(F.broadcast(names), "query")


def search_ranked(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of docs(doc_id, text) with the highest score above 0 for each of
    items(item_id, text), equal scores by doc_id, null last.

    A term's weight w is floor(1000 ln((2 N + 2) / (2 df + 1))), of N documents with a term; a document of n terms scores
    w * ((1000000000 tf) div (1000 tf + 8 m)) for each term of the item that it has tf times, m = 10 + (90 n N) div L, of L terms
    in all documents.

    Null texts and those without terms are found by nothing and aren't counted; texts of any length are read whole. Each row is a
    document of its own, also where a doc_id or a whole row is repeated. Rows of one item_id are one item; an item without terms
    has no rows, and with empty tables there are none. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(spark):
        terms = materialize(query_terms(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))), "query-terms")
        blocks = math.ceil(terms.count() / BLOCK_TERMS)
        dealt = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))))
        found = None
        for k in range(blocks):
            rows = dealt.where(F.col("block") == k).orderBy("item_id", "term").collect()
            if rows:
                best = materialize(_block(docs, rows, top), "best")
                found = best if found is None else found.union(best)
        if found is None:
            found = spark.createDataFrame([], "query int, doc_id long, score long, item_id long")
        ranked = first_of(found.select("item_id", "doc_id", "score"), ["item_id"], [F.desc("score"), F.col("doc_id").asc_nulls_last()], top)
        return kept(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
