"""Mixing sources to target weights by pivotal dependent rounding.

A source with target t and size s gives each of its documents t / s expected copies: a whole part that all get, and a
fraction that is rounded. Rounding pairs two fractional documents and moves mass (words times probability) between them at
random until one of them is 0 or 1; what all of them have together stays the same, so a source ends within one document of
its target. Documents of similar size (powers of two) are paired within hash buckets first; each bucket leaves at most one
fractional document, and a tree of further buckets combines these until one for each source and size class is left. Last,
the classes of a source are settled from large to small: a large document is rounded against all the smaller ones together,
so that only a small one stays fractional, and that one goes to its nearer end.

The random numbers are hashes of ids, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, kept, materialize, scratch
from .ranks import running

#: Rows of one bucket, on average, at each level of the tree.
FAN_IN = 512
#: Buckets of one task, on average; rows that agree in all that counts and are numbered at one time.
TASK_BUCKETS, EQUAL = 16, 1 << 16
#: Size classes: a size below 2^CLASSES words has its own power of two.
CLASSES = 48


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from sized(source, size): a row per source, however many there are.

    Sources by code point, null last, take the weights in turn and share `share` times all sizes. A target stops at `most`
    times its source's size; the rest is shared again by weight until none is above. That is min(weight * level, most * size)
    with one level for all, found from running sums by cap per weight.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    ranked = running(totals, ["last", "source"], {"rank": None})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = materialize(running(rows, ["ratio", "last", "source"], {"capped": F.col("cap"), "before": F.col("weight")}), "capped")
    total, weight = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        return rows.select("source", "source_size", F.col("cap").alias("target"))
    level = (F.lit(total * float(share)) - F.col("capped")) / (F.lit(weight) - F.col("before"))
    # the first source, in this order, that stays below its cap sets the level; later ones give smaller values
    top = rows.where(level * F.col("weight") <= F.col("cap")).agg(F.max(level)).first()[0]
    target = F.col("cap") if top is None else F.least(F.lit(top) * F.col("weight"), F.col("cap"))
    return rows.select("source", "source_size", target.alias("target"))


def _pair(size: np.ndarray, p: np.ndarray, luck: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding of documents in order; the last one in hand may stay fractional, its place is returned (or -1)."""
    p = p.copy()
    hand = -1
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if hand < 0:
            hand = i
            continue
        a, b = size[hand], size[i]
        up = min((1 - p[hand]) * a, p[i] * b)
        down = min(p[hand] * a, (1 - p[i]) * b)
        move = up if luck[i] * (up + down) < down else -down
        p[hand], p[i] = p[hand] + move / a, p[i] - move / b
        for j in (hand, i):
            p[j] = round(p[j]) if abs(p[j] - round(p[j])) < 1e-9 else p[j]
        hand = next((j for j in (hand, i) if 0.0 < p[j] < 1.0), -1)
    return p, hand


def _settle(size: np.ndarray, p: np.ndarray, luck: np.ndarray) -> np.ndarray:
    """Round a source's last fractional documents, largest first, each against all the smaller ones together."""
    p = p.copy()
    order = np.argsort(-size, kind="stable")
    for k, i in enumerate(order):
        rest = order[k + 1 :]
        give = (p[rest] * size[rest]).sum()
        take = ((1 - p[rest]) * size[rest]).sum()
        up, down = min((1 - p[i]) * size[i], give), min(p[i] * size[i], take)
        if up + down <= 0:
            continue
        move = up if luck[i] * (up + down) < down else -down
        p[i] += move / size[i]
        p[rest] = np.clip(p[rest] - (p[rest] * (move / give) if move > 0 else (1 - p[rest]) * (move / take)), 0.0, 1.0)
    return np.rint(p)


def _rounds(rows: DataFrame, schema: str, settle: bool) -> DataFrame:
    """Round the rows of each bucket, which stand together and in order in one partition."""

    def run(batches: Iterator[pd.DataFrame]):
        held: list[pd.DataFrame] = []
        held_key = None

        def done() -> pd.DataFrame:
            g = pd.concat(held) if len(held) > 1 else held[0]
            size, p, luck = (g[c].to_numpy() for c in ("size", "p", "luck"))
            p = _settle(size, p, luck) if settle else _pair(size, p, luck)[0]
            return g.assign(p=p)

        for pdf in batches:
            if not len(pdf):
                continue
            code = pdf["bucket"].to_numpy()
            for part in np.split(np.arange(len(pdf)), np.flatnonzero(code[1:] != code[:-1]) + 1):
                rows = pdf.iloc[part]
                if held and code[part[0]] != held_key:
                    yield done()
                    held = []
                held_key = code[part[0]]
                held.append(rows)
        if held:
            yield done()

    return rows.mapInPandas(run, schema)


def mix_sources(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs(doc_id, text, source).

    size: words of the text, 0 for a null one. taken: copies of the document times its size, with at most `most` copies when
    that is a whole number. A null source is a source of its own; documents of size 0 are taken 0 words. Rows that agree in
    doc_id, source and size are interchangeable; they are numbered, and each is rounded on its own. Sources of equal ratio of cap and weight are settled in
    order of code points, null last. A text of any length is counted whole and copied whole. Other columns are ignored. An empty
    table gives no rows.
    """
    with scratch(docs.sparkSession):
        return kept(_mix(docs, weights, share, most), "mixed")


def _mix(docs: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    # equal rows are numbered, so that they have luck and buckets of their own
    equal = materialize(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "sized")
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / EQUAL))).alias("part")
    equal = equal.select("*", parts)
    if not equal.where("part > 0").isEmpty():
        equal = equal.repartition("doc_id", "source", "size", "part")
    most_part = F.least(F.lit(EQUAL), F.col("rows") - F.col("part") * EQUAL)
    sized = equal.select("doc_id", "source", "size", "part", F.explode(F.sequence(F.lit(1), most_part)).alias("number")).withColumn("number", F.col("part") * EQUAL + F.col("number")).drop("part")
    targets = materialize(source_targets(sized, list(weights), share, most), "targets")
    join = targets.withColumnRenamed("source", "s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)  # so that a full cap is whole
    rows = (
        sized.join(join, sized.source.eqNullSafe(join.s)).drop("s")
        .withColumn("whole", F.floor(near).cast("double")).withColumn("p", near - F.floor(near))
    )
    key = [F.coalesce(F.col("doc_id"), F.lit(-1)), F.coalesce("source", F.lit("\x00")), F.col("size"), F.col("number")]
    rows = rows.withColumn("luck", F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    rows = rows.withColumn("class", F.least(F.floor(F.log2(F.greatest("size", F.lit(1)))), F.lit(CLASSES)).cast("int"))
    columns = ["doc_id", "source", "size", "number", "source_size", "target", "whole", "p", "luck", "class"]
    settled = rows.where("size = 0 or p = 0").select(*columns)
    schema = "doc_id long, source string, size long, number long, source_size long, target double, whole double, p double, luck double, class int, bucket long"
    live = rows.where("size > 0 and p > 0").select(*columns)
    parts = [settled]
    left, level = live.count(), 0
    buckets = -(-left // FAN_IN)
    while left:
        last = buckets <= 1
        slot = F.pmod(F.xxhash64("doc_id", "size", "number", F.lit(level)), F.lit(max(buckets, 1)))
        group = F.xxhash64("source", "class", slot)
        ready = live.select(*columns, group.alias("bucket")).repartition(max(1, buckets // TASK_BUCKETS), "bucket").sortWithinPartitions("bucket", "luck", "doc_id", "size", "number")
        turned = materialize(_rounds(ready, schema, settle=False), "rounded")
        done = turned.where("p <= 0 or p >= 1").select(*columns)
        live = turned.where("p > 0 and p < 1").select(*columns)
        parts.append(done)
        level += 1
        if last:
            break
        buckets = buckets // FAN_IN
    if left:  # one document of each class is left to a source: CLASSES + 1 rows at most
        ready = live.select(*columns, F.xxhash64("source").alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "luck", "doc_id", "size", "number")
        parts.append(_rounds(ready, schema, settle=True).select(*columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    taken = (F.col("whole") + F.col("p")).cast("long") * F.col("size")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
