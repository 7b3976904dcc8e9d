"""Exact Jaccard join of documents on word shingles, by a token-group matrix.

1. Every document's shingles are ordered by (count in a fixed-size sketch of all shingles, hash), rarest first; a prefix of
   n - ceil(t n) + l of them is kept, so only prefixes are shuffled. Copies of one set are one node. If the prefix of x ends no
   later in the order than that of y, every prefix shingle of x that y has is in y's prefix: with c of p in common, the whole
   overlap is at most n - p + c. That is the bound used below; a pair is looked at from the side whose prefix ends first.
2. Similar documents are partitioned into groups: each node is verified against a pivot of the prefix shingles it has (the
   node with the fewest shingles of its own), and verified links make components. A group of near copies costs rows in
   proportion to its size, not to its square.
3. The matrix (token, group, set size) holds the union of each group's prefix shingles. A query node's overlap with a group is
   bounded by its count of matching rows; groups that can't reach the similarity stay closed. A node with many shingles that
   nobody else has can only link to sets of few sizes; under frequent tokens rows meet by size, so that it doesn't meet others.
4. Open groups are searched for members that reach the bound, and these pairs are verified on whole sets.

Links inside a group are implied, so every link between different groups is found: the components are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, bitmap, bitmap_slot, in_bitmap, kept, lists, mapped, materialize, mix, pieces, scratch, shared, utf8
from .components import components

#: Bytes of text for each counter of the sketch that orders shingles, and least and most bits of its size. With counters in
#: proportion to the text, prefixes stay as rare as the input grows; at most 2^23 bytes go to each task.
SKETCH_TEXT, SKETCH_BITS = 768, (18, 23)
#: Pivots that a node is held against before groups are built.
PIVOTS = 2
#: Bits of the bitmap of shared tokens.
TOKEN_BITS = 25
#: Groups under a token from which on they meet by size.
FREQUENT = 64
#: Bits of the bitmap that thins out documents without candidates before their sets are shuffled.
NODE_BITS = 22


def _shingles(w: Words, i: int, k: int) -> np.ndarray:
    h = w.hash[w.row(i)]
    if not len(h):
        return h
    if len(h) < k:
        parts, size = [h[j : j + 1] for j in range(len(h))], len(h)
    else:
        parts, size = [h[j : len(h) - k + 1 + j] for j in range(k)], k
    total = np.full(len(parts[0]), size, np.uint64)
    for part in parts:
        total = total * np.uint64(0xD6E8FEB86659FD93) + part
    return np.unique(mix(total))


def _mark(s: np.ndarray) -> bytes:
    """A 128-bit fingerprint of a set."""
    return np.array([len(s) + (mix(s).sum()), mix(s ^ np.uint64(0xA0761D6478BD642F)).sum()], np.uint64).tobytes()


def _sets(batch: pa.RecordBatch, k: int, keep: np.ndarray | None = None) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, at = utf8(batch.column("text"))
    for i, j in pieces(at):
        if keep is not None and not keep[i:j].any():
            continue
        w = Words(data, at[i : j + 1], fold=True)
        yield i, [_shingles(w, r, k) if keep is None or keep[i + r] else w.hash[:0] for r in range(j - i)]


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How many documents have a shingle, in steps of logarithms, in counters for its first bits summed over all documents.

    Tasks sum up what they read, other tasks the parts of these sums, a slice of the counters each.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    bits = min(max(int(np.log2(size / SKETCH_TEXT)), SKETCH_BITS[0]), SKETCH_BITS[1])
    step = 1 << 14

    def count(batches):
        total, held, waiting = np.zeros(1 << bits, np.int32), [], 0
        for batch in batches:
            for _, sets in _sets(batch, k):
                held += [(s >> np.uint64(64 - bits)).astype(np.int32) for s in sets]
                waiting += sum(map(len, sets))
                if waiting >= 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.int32)
                    held, waiting = [], 0
        if waiting:
            total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.int32)
        at = range(0, len(total), step)
        yield pa.record_batch({"at": pa.array(at, pa.int32()), "n": pa.array([zlib.compress(total[i : i + step].tobytes(), 1) for i in at], pa.binary())})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, n in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist(), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(zlib.decompress(n), np.int32).astype(np.int64)
        for at, n in total.items():
            yield pa.record_batch({"at": pa.array([at], pa.int32()), "n": pa.array([np.rint(16 * np.log2(1 + np.minimum(n, 1 << 14))).astype(np.uint8).tobytes()], pa.binary())})

    parts = materialize(mapped(docs.select("text"), count, "at int, n binary"), "sketch")
    rows = mapped(parts.repartition(min(1 << bits >> 14, 64), "at"), add, "at int, n binary").collect()
    return np.frombuffer(b"".join(r["n"] for r in sorted(rows, key=lambda r: r["at"])), np.uint8)


def least_overlap(size, percent: int):
    """Shingles that a set of this size shares with any set it links to."""
    return -(-size * percent // 100)


def _prefix_size(size: int, percent: int) -> int:
    """What a linked set must leave out at most, and some more: each makes the bound sharper."""
    return size - least_overlap(size, percent) + 4 + size // 40


def _prefixes(docs: DataFrame, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """doc_id, n (set size), fp (128-bit fingerprint of the set), prefix (its first shingles) and last (the last one's place)."""
    order = shared(docs.sparkSession, counts)

    def run(batches):
        table = order.value
        shift = np.uint64(65 - len(table).bit_length())
        for batch in batches:
            n, last = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            marks: list[bytes | None] = [None] * len(batch)
            first: list[np.ndarray] = []
            for at, sets in _sets(batch, k):
                for r, s in enumerate(sets, at):
                    n[r] = size = len(s)
                    if size:
                        marks[r] = _mark(s)
                    if size * 100 < percent * (size + 1):  # links to equal sets only
                        first.append(s[:0])
                        continue
                    count = table[s >> shift]
                    own = np.argsort(count, kind="stable")[: _prefix_size(size, percent)]
                    first.append(s[own])
                    last[r] = int(count[own[-1]]) << 38 | int(s[own[-1]] >> np.uint64(26))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n": pa.array(n), "fp": pa.array(marks, pa.binary()), "last": pa.array(last),
                "prefix": lists(np.concatenate(first).view(np.int64), np.array([len(x) for x in first], np.int64), pa.int64()),
            })

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n long, fp binary, last long, prefix array<long>")


def _sets_of(docs: DataFrame, k: int, pairs: DataFrame) -> DataFrame:
    """(node, shingles) of the documents that pairs (a, b) name, once where rows repeat; their texts stay where they are."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    slot = bitmap_slot(F.col("doc_id"), NODE_BITS)
    bits = shared(docs.sparkSession, bitmap(wanted.select(bitmap_slot(F.col("node"), NODE_BITS).alias("slot")), "slot", NODE_BITS))

    def full(batches):
        seen: set[tuple[int, bytes]] = set()  # a task passes a repeated row on once
        for batch in batches:
            node = batch.column("doc_id").to_numpy()
            keep = in_bitmap(bits.value, batch.column("slot").to_numpy(zero_copy_only=False))
            for at, sets in _sets(batch, k, keep):
                new = {}
                for r in range(len(sets)):
                    if keep[at + r] and len(sets[r]) and (key := (int(node[at + r]), _mark(sets[r]))) not in seen:
                        seen.add(key)
                        new[r] = key
                if rows := list(new):
                    yield pa.record_batch({
                        "node": pa.array([new[r][0] for r in rows], pa.int64()), "fp": pa.array([new[r][1] for r in rows], pa.binary()),
                        "shingles": lists(np.concatenate([sets[r] for r in rows]).view(np.int64), np.array([len(sets[r]) for r in rows], np.int64), pa.int64()),
                    })

    sets = mapped(docs.where("doc_id is not null").select("doc_id", "text", slot.alias("slot")), full, "node long, fp binary, shingles array<long>")
    sets = sets.join(wanted, "node", "left_semi").groupBy("node", "fp").agg(F.first("shingles").alias("shingles"))
    return materialize(sets.drop("fp"), "sets")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets reach the similarity."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - F.col("both")
    return pairs.join(left, "a").join(right, "b").withColumn("both", both).where(F.col("both") * 100 >= percent * union).select("a", "b")


def _least(n, m, percent: int) -> Column:
    """Overlap of linked sets of sizes n and m."""
    return F.ceil((n + m) * percent / (100 + percent))


def _shared_posts(nodes: DataFrame) -> DataFrame:
    """(token, node) of the prefix shingles that two nodes or more have."""
    tokens = nodes.select(F.explode("prefix").alias("token"), "node")
    common = materialize(tokens.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("token"), "shared")
    bits = shared(nodes.sparkSession, bitmap(common.select(F.shiftrightunsigned("token", 64 - TOKEN_BITS).alias("slot")), "slot", TOKEN_BITS))

    def some(batches):
        for batch in batches:
            prefix = batch.column("prefix")
            token = prefix.flatten().to_numpy(zero_copy_only=False)
            keep = in_bitmap(bits.value, (token.view(np.uint64) >> np.uint64(64 - TOKEN_BITS)).astype(np.int64))
            node = np.repeat(batch.column("node").to_numpy(), prefix.value_lengths().to_numpy())
            yield pa.record_batch({"token": pa.array(token[keep]), "node": pa.array(node[keep])})

    return materialize(mapped(nodes.select("node", "prefix"), some, "token long, node long").join(common, "token"), "shared-posts")


def _step(n: Column) -> Column:
    """Set sizes in steps of less than a hundredth."""
    width = F.greatest(F.lit(1), F.shiftright(F.pow(F.lit(2), F.floor(F.log2(n))).cast("long"), 7))
    return n - n % width


def _across(nodes: DataFrame, posts: DataFrame, group: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different groups that may reach the similarity, by the matrix of tokens and groups."""
    posts = posts.join(group.select("node", F.col("component").alias("g")), "node", "left").withColumn("g", F.coalesce("g", "node"))
    posts = materialize(posts, "grouped")
    matrix = posts.groupBy("token", "g", "n").agg(F.max("last").alias("last"), F.count("*").alias("members"))
    split = matrix.groupBy("token").agg(F.min("g").alias("x"), F.max("g").alias("y"), F.count("*").alias("rows")).where("x < y")
    split = materialize(split.select("token", (F.col("rows") >= FREQUENT).alias("frequent")), "split")
    by_size = lambda c: F.when(F.col("frequent"), _step(c)).otherwise(F.lit(-1))
    matrix = matrix.join(split, "token").select("token", by_size(F.col("n")).alias("step"), F.col("g").alias("m_g"), F.col("n").alias("m_n"), F.col("last").alias("m_last"), "members")
    least = F.ceil(F.col("n") * percent / 100)
    sizes = F.array_distinct(F.transform(F.sequence(least, F.col("most"), F.greatest(F.lit(1), F.floor(least / 256)).cast("long")), _step))
    sizes = F.array_distinct(F.concat(sizes, F.array(_step(F.col("most")))))
    asked = posts.where(F.col("most") >= least).join(split, "token").withColumn("step", F.explode(F.when(F.col("frequent"), sizes).otherwise(F.array(F.lit(-1).cast("long")))))
    met = asked.join(matrix, ["token", "step"]).where((F.col("m_g") != F.col("g")) & (F.col("m_last") >= F.col("last")) & F.col("m_n").between(least, F.col("most")))
    bound = met.groupBy("node", "n", "p", "last", "m_g", "m_n").agg(F.collect_list(F.struct("members", "token")).alias("tokens")).withColumn("c", F.size("tokens"))
    need = _least(F.col("n"), F.col("m_n"), percent) - F.col("n") + F.col("p")
    reaches = F.col("c") >= need
    # a member with `need` of the c tokens has one of any c - need + 1 of them: the ones that fewest members have are looked up
    rare = F.slice(F.sort_array("tokens"), F.lit(1), F.least(F.col("c"), F.col("c") - need + 1).cast("int"))
    opened = materialize(bound.where(reaches).select("node", "n", "p", "last", "m_g", "m_n", rare.alias("tokens")), "opened")
    # members of the open groups
    mine = posts.select(F.col("node").alias("b"), F.col("g").alias("m_g"), F.col("n").alias("m_n"), "token", F.col("last").alias("b_last"))
    asked = opened.select("node", "n", "p", "last", "m_g", "m_n", F.explode("tokens.token").alias("token"))
    pairs = asked.join(mine, ["m_g", "m_n", "token"]).where("b_last >= last").select("node", "n", "p", "b", "m_n").distinct()
    prefix = lambda c: nodes.select(F.col("node").alias(c), F.col("prefix").alias(f"prefix_{c}"))
    pairs = pairs.join(prefix("node"), "node").join(prefix("b"), "b").withColumn("c", F.size(F.array_intersect("prefix_node", "prefix_b")))
    return pairs.where(reaches).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text).

    Words are lower-cased in A-Z only. component_id: smallest doc_id reachable by links of Jaccard >= percent / 100, its own
    where it has none. A null or wordless text has 0 shingles and no links; a null doc_id gets its shingle count and, where
    the set also belongs to a named document, that one's component (else null). Repeated rows stay repeated. Other columns
    are ignored. A text of any length is one set, whole; a task needs memory for the longest. An empty table gives no rows.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is from 50 to 100")
    with scratch(docs.sparkSession):
        return kept(_components(docs, k, percent), "jaccard")


def _components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = materialize(_prefixes(docs, k, percent, _sketch(docs, k)), "prefixes")
    nodes = known.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n", "last", "prefix")])
    nodes = materialize(nodes, "nodes")
    posts = _shared_posts(nodes)
    met = posts.groupBy("node").agg(F.count("*").alias("s"))
    # own: prefix shingles that no other node has; most: the largest set that can still link, from the side that ends first
    facts = nodes.select("node", "n", "last", F.size("prefix").alias("p")).join(met, "node").withColumn("own", F.col("p") - F.col("s")).drop("s")
    facts = facts.withColumn("most", F.least(F.floor(F.col("n") * 100 / percent), F.floor(((F.col("n") - F.col("own")) * 100 - F.col("own") * percent) / percent)))
    posts = materialize(posts.join(facts, "node"), "posts")

    pivot = F.struct((F.col("own") / F.col("p")).alias("o"), F.xxhash64("node").alias("h"), "node", "n", "last", "p", "most")
    pivots = posts.groupBy("token").agg(F.min(pivot).alias("v")).select("token", *[F.col(f"v.{c}").alias(f"v_{c}") for c in ("node", "n", "last", "p", "most")])
    size = F.when(F.col("last") <= F.col("v_last"), F.col("v_n") <= F.col("most")).otherwise(F.col("n") <= F.col("v_most"))
    fits = (F.col("n") * 100 >= F.col("v_n") * percent) & (F.col("v_n") * 100 >= F.col("n") * percent)
    tried = posts.join(pivots, "token").where((F.col("node") != F.col("v_node")) & fits & size)
    tried = tried.groupBy("node", "n", "p", "last", "v_node", "v_n", "v_p", "v_last").agg(F.count("*").alias("c"))
    reach = F.when(F.col("last") <= F.col("v_last"), F.col("n") - F.col("p")).otherwise(F.col("v_n") - F.col("v_p")) + F.col("c")
    tried = tried.where(reach >= _least(F.col("n"), F.col("v_n"), percent))
    best = Window.partitionBy("node").orderBy(F.desc("c"), "v_node")
    tried = tried.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PIVOTS)
    # one of (a, b) and (b, a) is enough
    tried = materialize(tried.select(F.least("node", "v_node").alias("a"), F.greatest("node", "v_node").alias("b")).distinct(), "tried")
    links = materialize(_verify(tried, _sets_of(docs, k, tried), percent), "links")

    pairs = materialize(_across(nodes, posts, components(links), percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        links = links.union(_verify(pairs, _sets_of(docs, k, pairs), percent))
    label = components(links)

    named = nodes.select(F.col("fp").alias("nfp"), "node")
    return (
        known.select("doc_id", "n", "fp").join(named, F.col("fp") == F.col("nfp"), "left").join(label, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))
    )
