"""Aggregates, windows over ordered rows, and set operations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .places import MOST_ROWS, MOST_SENT, bounded, last_known, place, previous, spread


def count_per(df: DataFrame, by: Sequence[str], distinct: str) -> DataFrame:
    """A1: distinct values per group."""
    return df.groupBy(*by).agg(F.countDistinct(distinct).alias("n"))


def latest_per_language(df: DataFrame, language: str = "language", date: str = "date", release: str = "release_id") -> DataFrame:
    """A2: latest date and number of releases of each language, over distinct (language, date, release); latest first (K5)."""
    rows = df.select(language, date, release).distinct()
    return order_desc(rows.groupBy(language).agg(F.max(date).alias("latest"), F.count("*").alias("releases")), "latest", language)


def group_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A3, K3: rows of each group as an array, in order."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("rows"))


def merge_duplicates(df: DataFrame, key: str, order: str, notes: str, many: str) -> DataFrame:
    """A4: one row per key: the first one's order value, notes joined by newlines where not contained yet, and the sorted union of an array column.

    Rows are reduced to their different notes, each with its first order, and different values before anything is gathered: what
    stands in one cell is bounded by these, whatever the number of rows of a key.
    """
    first = df.groupBy(key, notes).agg(F.min(order).alias("__o"))
    values = df.select(key, F.explode(many).alias("__v")).distinct()
    rows = first.select(key, "__o", F.when(F.col(notes).isNotNull(), F.struct(F.col("__o").alias("o"), F.col(notes).alias("n"))).alias("__note"), F.lit(None).cast(values.schema["__v"].dataType).alias("__v"), F.lit(False).alias("__value"))
    rows = rows.union(values.select(key, F.lit(None).cast(df.schema[order].dataType), F.lit(None).cast(rows.schema["__note"].dataType), "__v", F.lit(True)))
    texts = F.transform(F.array_sort(F.collect_list("__note")), lambda r: r["n"])
    fold = F.aggregate(texts, F.lit(""), lambda a, n: F.when(a == "", n).when(F.call_function("instr", a, n) > 0, a).otherwise(F.concat(a, F.lit("\n"), n)))
    listed = F.transform(F.collect_list(F.when(F.col("__value"), F.struct("__v"))), lambda r: r["__v"])
    return rows.groupBy(key).agg(F.min("__o").alias(order), fold.alias(notes), F.array_sort(listed).alias(many))


def most_common(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """A5: each group's most frequent value and its count; of equal counts, the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), value)).alias("b")).select(*by, F.col(f"b.{value}").alias(value), (-F.col("b.m")).alias("n"))


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key wins."""
    rest = [c for c in df.columns if c not in key]
    row = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(row.alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def vote(matches: DataFrame, by: Sequence[str], candidate: str, distance: str) -> DataFrame:
    """Mean distance over count for each candidate; the lowest score wins, of equal ones the smallest candidate."""
    scores = matches.groupBy(*by, candidate).agg((F.avg(distance) / F.count("*")).alias("score"), F.count("*").alias("votes"))
    return scores.groupBy(*by).agg(F.min(F.struct("score", candidate, "votes")).alias("w")).select(*by, "w.*")


def vocabulary(df: DataFrame, column: str, split: str) -> DataFrame:
    """The different parts of a column's values."""
    parts = df.select(F.explode(F.split(column, split)).alias("word")).select(F.trim("word").alias("word"))
    return parts.where("word <> ''").distinct()


def number_variants(df: DataFrame, by: Sequence[str], order: Sequence[str], own: str, repeat_last: Column | None = None, mostly_single: bool = False) -> DataFrame:
    """Number the variants of each group in order. A row keeps its own id, except: without one it takes the number after the
    previous row's (0 at the start), and one equal to the previous takes the next. Where repeat_last holds, an id that was
    given before takes the number after the last. The state is the number given before, so it is a fold over a group's rows
    (variants of one record: few).

    mostly_single: rows alone in their group are set apart by a count first, and need neither be gathered nor moved; without it, all
    groups are gathered.
    """
    if mostly_single:
        mine = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
        several = df.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.count("*").alias("__n")).where("__n > 1")
        alone = df.join(several, mine, "left_anti").withColumn("variant", F.coalesce(F.col(own).cast("long"), F.lit(0).cast("long")))
        return alone.unionByName(number_variants(df.join(several, mine, "left_semi"), by, order, own, repeat_last))
    repeat = F.lit(False) if repeat_last is None else repeat_last
    row = F.struct(*order, F.col(own).cast("long").alias("__own"), repeat.alias("__repeat"), F.struct(*df.columns).alias("__row"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.expr("cast(array() as array<long>)").alias("ids"))

    def step(acc: Column, r: Column) -> Column:
        following = F.coalesce(acc["last"] + 1, F.lit(0).cast("long"))
        again = (r["__own"] == acc["last"]) | (r["__repeat"] & F.array_contains(acc["ids"], r["__own"]))
        new = F.when(r["__own"].isNull(), following).when(F.coalesce(again, F.lit(False)), acc["last"] + 1).otherwise(r["__own"])
        return F.struct(new.alias("last"), F.concat(acc["ids"], F.array(new)).alias("ids"))

    # sort_array compares without a lambda; most records have one variant, which needs no fold
    groups = df.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    single = F.array(F.coalesce(F.col("rows")[0]["__own"], F.lit(0).cast("long")))
    ids = F.when(F.size("rows") == 1, single).otherwise(F.aggregate("rows", start, step)["ids"])
    # outer, as Spark else computes the array once more to leave out empty ones, of which there are none
    out = groups.select(F.explode_outer(F.arrays_zip(F.col("rows"), ids.alias("ids"))).alias("z"))
    return out.select("z.rows.__row.*", F.col("z.ids").alias("variant"))


def reindex(df: DataFrame, by: Sequence[str], order: Sequence[str], exempt: DataFrame | None = None, column: str = "index", rows: int = MOST_ROWS) -> DataFrame:
    """Places from 0 in each group; groups of `exempt` keep the column's value. Groups of more than `rows` rows are spread."""
    placed = place(df, by, order, "__place", rows)
    new = F.col("__place") - 1
    if exempt is None:
        return placed.withColumn(column, new).drop("__place")
    marked = placed.join(exempt.select(*by).distinct().withColumn("__keep", F.lit(True)), list(by), "left")
    return marked.withColumn(column, F.when(F.col("__keep"), F.col(column).cast("long")).otherwise(new)).drop("__keep", "__place")


with_index = reindex


def group_suffix(df: DataFrame, by: str, column: str, suffix: str) -> DataFrame:
    """Where any name of a group ends with the suffix, all do. Groups with such a name are looked for first, so that rows are
    neither sorted nor moved where these are few. A null group is a group."""
    ends = df.where(F.col(column).endswith(suffix)).select(F.col(by).alias("__by"), F.lit(True).alias("__ends")).distinct()
    named = F.when(F.col("__ends") & ~F.col(column).endswith(suffix), F.concat(column, F.lit(f" {suffix}"))).otherwise(F.col(column))
    return df.join(ends, F.col(by).eqNullSafe(F.col("__by")), "left").select(*[named.alias(c) if c == column else F.col(c) for c in df.columns])


def fill_forward(df: DataFrame, column: str, order: Sequence[str], by: Sequence[str], rows: int = MOST_ROWS) -> DataFrame:
    """A null takes the last value before it in its group. Groups of more than `rows` rows are spread."""
    return last_known(df, by, order, column, rows)


def first_per_date(df: DataFrame, by: Sequence[str], date: str, order: Sequence[str]) -> DataFrame:
    """The first row per group and date, with its index by date in the group."""
    first = Window.partitionBy(*by, date).orderBy(*order)
    kept = df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return kept.withColumn("index", (F.row_number().over(Window.partitionBy(*by).orderBy(date)) - 1).cast("long"))


def default_rows(df: DataFrame, language: str = "en") -> DataFrame:
    """Rows of a language once more as language "default", without notes."""
    copy = df.where(F.col("language") == language).withColumn("language", F.lit("default")).withColumn("note", F.lit(None).cast("string"))
    return df.unionByName(copy)


def learn_translations(tokens: DataFrame, groups: DataFrame | None, seeds: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df, dealt: DataFrame | None = None, most: int = MOST_SENT) -> DataFrame:
    """Kinds of English tokens, learned from the Japanese token at the same place.

    tokens(group, language, field, index, text, kind), groups(group, rank) with a rank of first appearance from 0 (None: tokens have
    their rank), and seeds(text, kind) known from the start. An English token without a kind takes that of the Japanese token at the same
    (field, index) if it is a timing or precondition. The first group that teaches a text wins, and a text is known from that
    group on. Returns tokens with `learned`.

    A known text is never learned again, so that the first teaching, by (rank, place), is all that counts. keep may write the
    known texts, which are read three times, and return them as read. Tokens are moved by place once, unless `dealt` has them
    already so that those of a (group, field) are in one task: they can be cut there from whole texts, which take less to move.
    Known texts that were taught often, `most` at most, are sent to the tokens; only tokens of other texts are moved to theirs.
    """
    at, joined = ["group", "field", "index"], None if groups is None else bounded(groups, most)
    ranked = lambda df: df if joined is None else df.join(joined, "group")
    asked = (F.col("language") == "en") & F.col("kind").isNull()
    if dealt is None:
        dealt = spread(tokens, at, tokens.count())
    japanese = F.max_by("kind", F.when(F.col("language") == "ja", F.col("text"))).over(Window.partitionBy(*at))
    placed = ranked(dealt).select(*at, "rank", "language", "text", "kind").where((F.col("language") == "ja") | asked).withColumn("ja_kind", japanese)
    taught = placed.where(asked & F.col("ja_kind").isin("timing", "precondition")).dropna(subset=[*at, "text"])
    lesson = F.min(F.struct("rank", "field", "index", F.col("ja_kind").alias("learned")))
    first = taught.groupBy("text").agg(lesson.alias("l"), F.count("*").alias("n")).select("text", F.col("l.rank").alias("from_rank"), "l.learned", "n")
    start = F.lit("-1").cast(first.schema["from_rank"].dataType).alias("from_rank")
    few = seeds.limit(most + 1).count() <= most
    known = keep(first.join(seeds.select("text"), "text", "left_anti").union(seeds.select("text", start, F.col("kind").alias("learned"), F.lit(None if few else 0).cast("long"))))
    # at most `most` texts can have been taught so often, beside the seeds if they are few
    often = F.coalesce(F.col("n") >= (known.agg(F.sum("n")).first()[0] or 0) / most, F.lit(True))
    asked = F.coalesce(asked, F.lit(False))
    sent = F.broadcast(known.where(often).select(F.col("text").alias("__text"), "from_rank", "learned"))
    met = ranked(tokens).join(sent, asked & (F.col("text") == F.col("__text")), "left")
    learned = F.when(F.col("from_rank") <= F.col("rank"), F.col("learned")).alias("learned")
    moved = asked & F.col("__text").isNull() & F.col("text").isNotNull()
    others = met.where(moved).drop("from_rank", "learned").join(known.where(~often).drop("n").hint("shuffle_hash"), "text", "left")
    return met.where(~moved).select(*tokens.columns, learned).unionByName(others.select(*tokens.columns, learned))


def sections(df: DataFrame, is_head: Column, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Number of the section a row is in: it begins anew at each head, rows before the first are in 0."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("section", F.sum(F.when(is_head, 1).otherwise(0)).over(w))


def pair_lists(df: DataFrame, by: Sequence[str], order: str, question: Column, answer: Column, text: str) -> DataFrame:
    """The n-th question with the n-th answer of a group; a missing side is null."""
    side = lambda test, name: reindex(df.where(test), by, [order], column="index").select(*by, "index", F.col(text).alias(name))
    return side(question, "question").join(side(answer, "answer"), [*by, "index"], "full")


def blank_repeats(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Later rows with the same key stay but lose it. order is total; only a key's first row is looked for, with partial minima,
    so that a frequent key makes no large task."""
    row = F.struct(*order)
    first = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(row).alias("__first"))
    return df.join(first, F.col(key) == F.col("__key"), "left").withColumn(key, F.when(row == F.col("__first"), F.col(key))).drop("__key", "__first")


def adjacent_diff(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], rows: int = MOST_ROWS) -> DataFrame:
    """Names of the columns in which a row differs from the one before it in its group; the first has none. Groups of more than
    `rows` rows are spread."""
    names = [F.when(F.col("__before").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"__before.{c}")), F.lit(c)) for c in columns]
    return previous(df, by, order, columns, "__before", rows).withColumn("differs", F.array_compact(F.array(*names))).drop("__before")


def top1(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """K4: the first row of each group."""
    rest = [c for c in df.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*by).agg(best.alias("__r")).select(*by, *[F.col(f"__r.{c}").alias(c) for c in rest])


def order_desc(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """K5: the greatest first, ties in order of other columns."""
    return df.orderBy(F.desc(column), *ties)


def order_by_id(df: DataFrame, key: str) -> DataFrame:
    """K6."""
    return df.orderBy(key)


def union_merge(dfs: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of all origins; of one key, the last origin's wins."""
    numbered = [df.withColumn("__origin", F.lit(i)) for i, df in enumerate(dfs)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    return last_per_key(rows, [key], ["__origin"]).drop("__origin")


def new_findings(current: DataFrame, saved: DataFrame, key: Sequence[str], values: str | None = None) -> DataFrame:
    """Findings that aren't saved; with an array column, those whose values aren't all in the saved row's."""
    if values is None:
        return current.join(saved, list(key), "left_anti")
    known = saved.select(*key, F.col(values).alias("__saved"))
    joined = current.join(known, list(key), "left")
    return joined.where(F.size(F.array_except(values, F.coalesce("__saved", F.slice(values, 1, 0)))) > 0).drop("__saved")


def union_arrays(a: Column, b: Column) -> Column:
    """A null counts as empty."""
    return F.array_sort(F.when(a.isNull(), F.array_distinct(b)).when(b.isNull(), F.array_distinct(a)).otherwise(F.array_union(a, b)))


def append_unmatched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """U4: left, then the rows of right without a partner."""
    return left.unionByName(right.join(left.select(*on), list(on), "left_anti"), allowMissingColumns=True)


def distinct_flat(c: Column) -> Column:
    """U5."""
    return F.array_distinct(F.flatten(c))


def missing_members(df: DataFrame, group: str, by: str, member: str) -> DataFrame:
    """(group, by, member): members that another `by` of the group has and this one hasn't. Only members that some `by` lacks
    meet the group's others, so that rows made are in proportion to what such members lack and have."""
    rows = df.select(group, by, member).distinct()
    bys = rows.select(group, by).distinct()
    all_ = bys.groupBy(group).agg(F.count("*").alias("__all"))
    short = rows.groupBy(group, member).agg(F.count("*").alias("__n")).join(all_, group).where("__n < __all").select(group, member)
    return bys.join(short, group).join(rows, [group, by, member], "left_anti")
