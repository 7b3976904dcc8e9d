"""Curation: corrections, revisions, rules, tokens, merged duplicates, limits, external ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import OPENING, extract_tokens, first_int, split_markers
from tessera.sources.shared import written

from . import aggregates as A
from . import joins as J


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.replace(c, F.lit("…"), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def apply_errata(df: DataFrame, errata: DataFrame, keys: Sequence[str], columns: Sequence[str], titles: Mapping[str, str] | None = None, part: str | None = None) -> DataFrame:
    """errata(keys..., error, correction) applied to text columns.

    Both are split into trimmed lines, without their ellipses. In each column the first error line that it contains is replaced
    by the correction's line at the same place, unless that is there already. Lines that are a title ("[Title]" by column, in
    titles) don't count as text; where an erratum has titles, a line only applies to the column of the title before it. errata
    has one row per key.

    part names a struct column, the other half of a dual record. Its fields of the columns' names are texts of the same columns:
    the line is the first that either text contains, and it is replaced in both. A field whose own column is null stays.
    """
    titles = dict(titles or {})
    names = F.create_map(*[F.lit(x) for pair in titles.items() for x in pair]) if titles else None
    joined = df.join(errata.select(*keys, _lines(F.col("error")).alias("__e"), _lines(F.col("correction")).alias("__c")), list(keys), "left")

    def labelled(rows: Column) -> Column:
        """(title or null, line) of the lines that are text."""
        if names is None:
            return F.transform(rows, lambda x: F.struct(F.lit(None).cast("string").alias("t"), x.alias("x")))
        start = F.struct(F.lit(None).cast("string").alias("t"), F.expr("cast(array() as array<struct<t:string,x:string>>)").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            title = names[x]
            return F.struct(F.coalesce(title, acc["t"]).alias("t"), F.when(title.isNotNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["t"].alias("t"), x.alias("x"))))).alias("out"))

        return F.aggregate(rows, start, step)["out"]

    joined = joined.withColumn("__p", F.zip_with(labelled(F.col("__e")), labelled(F.col("__c")), lambda e, c: F.struct(e["t"].alias("t"), e["x"].alias("e"), c["x"].alias("c"))))

    fields = [f.name for f in df.schema[part].dataType.fields if f.name in columns] if part else []
    holds = lambda text, line: F.coalesce(F.call_function("instr", text, line) > 0, F.lit(False))

    def corrected(text: Column, column: str) -> Column:
        texts = [F.col(column), *([F.col(part)[column]] if column in fields else [])]
        usable = lambda p: p["e"].isNotNull() & p["c"].isNotNull() & (p["t"].isNull() | (p["t"] == F.lit(column))) & reduce(lambda x, y: x | y, [holds(t, p["e"]) for t in texts])
        first = F.try_element_at(F.filter("__p", usable), F.lit(1))
        return F.when(first.isNotNull() & holds(text, first["e"]) & ~holds(text, first["c"]), F.replace(text, first["e"], first["c"])).otherwise(text)

    def other_half() -> Column:
        own = F.col(part)
        texts = {f: F.when(F.col(f).isNull(), own[f]).otherwise(corrected(own[f], f)) for f in fields}
        return F.when(own.isNotNull(), F.struct(*[texts.get(f.name, own[f.name]).alias(f.name) for f in df.schema[part].dataType.fields]))

    new = {c: corrected(F.col(c), c) for c in columns} | ({part: other_half()} if fields else {})
    # under other names first: inside a lambda, a column's name would else mean what it has just been given
    found = joined.select("*", *[v.alias(f"__new_{c}") for c, v in new.items()])
    return found.select(*[F.col(f"__new_{c}").alias(c) if c in new else F.col(c) for c in df.columns])


def apply_revisions(df: DataFrame, revisions: DataFrame, keys: Sequence[str], column: str, marker: str) -> DataFrame:
    """revisions(keys..., before, after): without `before`, `after` is appended if it brings a marker that the text hasn't;
    else `before` becomes `after`, unless that is there already."""
    text, before, after = F.col(column), F.col("before"), F.col("after")
    new = F.when(after.isNull(), text)
    new = new.when(before.isNull(), F.when(after.contains(marker) & ~text.contains(marker), F.concat(text, F.lit("\n"), after)).otherwise(text))
    new = new.when(~text.contains(after), F.replace(text, before, after)).otherwise(text)
    joined = df.join(revisions.select(*keys, "before", "after"), list(keys), "left")
    return joined.select(*[F.when(text.isNull(), text).otherwise(new).alias(c) if c == column else F.col(c) for c in df.columns])


#: What stands in front of the rules of a text, by language (fixed values); the first that a text has counts.
RULE_MARKS = {"ja": ("〈ルール〉",), "en": ("⟨Rule⟩",), "zh-Hans": ("〈规则〉",), "ko": ("〈룰〉", "〈규칙〉")}


def extract_rules(df: DataFrame, markers: Mapping[str, str], dictionary: DataFrame, key: str = "card_id", text: str = "effect", quoted: str = r"[「\[]([^」\]]+)[」\]]", language: str = "language") -> DataFrame:
    """(key, index, type, value, allowance) of a text's rules, which stand behind its language's rule mark, in the mark's line.

    markers: marker to "trait", "name", "number" or "limit", looked for in this order, each in what stands before the one found
    last. Traits are typed by dictionary(token, type): form, attribute, else type. A limit's allowance is the first number of
    what was left when its marker was looked for. A text without a rule mark, or of another language, has no rules.
    """
    kinds = F.create_map(*[F.lit(x) for pair in markers.items() for x in pair])
    line = lambda mark: F.regexp_extract(text, f"{mark}.*", 0)
    rule = F.coalesce(*[F.when((F.col(language) == name) & F.contains(F.col(text), F.lit(mark)), line(mark)) for name, marks in RULE_MARKS.items() for mark in marks])
    # texts without a rule go first, as the cuts are long to compute; outer, as Spark else computes them once more to leave out empty ones
    cuts = df.select(key, rule.alias("__rule")).where("__rule is not null").select(key, F.posexplode_outer(split_markers(F.col("__rule"), list(markers), quoted)).alias("place", "r"))
    rows = cuts.where("r is not null").withColumn("kind", kinds[F.col("r.marker")])
    values = rows.where("kind <> 'limit'").select(key, "place", "kind", F.posexplode("r.values").alias("sub", "token"))
    typed = J.type_tokens(values.where("kind = 'trait'"), dictionary, ["form", "attribute", "type"], "type")
    named = values.where("kind <> 'trait'").withColumn("type", F.col("kind"))
    found = typed.unionByName(named).select(key, "place", "sub", "type", F.col("token").alias("value"), F.lit(None).cast("long").alias("allowance"))
    limits = rows.where("kind = 'limit'").select(key, "place", F.lit(0).alias("sub"), F.lit("limit").alias("type"), F.lit(None).cast("string").alias("value"), first_int(F.col("r.before")).alias("allowance"))
    return A.with_index(found.unionByName(limits), [key], ["place", "sub"]).select(key, "index", "type", "value", "allowance")


def extract_icons(df: DataFrame, fields: Sequence[str], key: str, group: str, ranks: DataFrame, seeds: DataFrame, language: str = "language") -> DataFrame:
    """(key, field, index, text, kind) of all tokens of some text columns; unknown English ones take a learned kind. Tokens are
    written to the shared folder, as they are read several times."""
    # fields without an opening bracket go first, and are read in one pass; outer, as Spark else computes the tokens once more
    texts = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]), lambda x: x["text"].rlike(OPENING))
    bracketed = reduce(lambda a, b: a | b, [F.coalesce(F.col(f).rlike(OPENING), F.lit(False)) for f in fields])
    held = df.where(bracketed).select(key, F.col(group).alias("group"), F.col(language).alias("language"), F.explode_outer(texts).alias("x"))
    rows = held.select(key, "group", "language", "x.field", F.explode_outer(extract_tokens(F.col("x.text"), F.col("language"))).alias("t")).where("t is not null")
    bare = F.expr("substring(t.text, 2, length(t.text) - 2)")
    tokens = rows.select(key, "group", "language", "field", F.col("t.index").alias("index"), bare.alias("text"), F.col("t.text").alias("shown"), F.col("t.kind").alias("kind"))
    learned = A.learn_translations(written(tokens.join(ranks, "group"), "tokens"), None, seeds, lambda df: written(df, "known"))
    return learned.select(key, "field", "index", F.col("shown").alias("text"), F.coalesce("kind", "learned").alias("kind"))


def consolidate(df: DataFrame, image: str, by: Sequence[str], key: str, notes: str, many: str) -> DataFrame:
    """E5: rows of one image become one (A4), and variants are numbered anew from 0 (N2) in each group of `by`."""
    merged = A.merge_duplicates(df, image, key, notes, many)
    rest = [c for c in df.columns if c not in (image, notes, many, "parallel_id")]
    rows = df.select(*rest).join(merged, key, "left_semi").join(merged, key)
    return A.reindex(rows, by, [key, image], column="parallel_id")


def map_external(df: DataFrame, ext: DataFrame, block: Sequence[str], max_distance: int = 11, own: bool = True) -> DataFrame:
    """df(id, hash, block...) with external_id: the nearest of ext(id, hash, block...) in its block; where own is false, of another id."""
    near = J.nearest_hash(df, ext, block, max_distance, own)
    return df.join(near.select("id", F.col("match").alias("external_id")), "id", "left")


def limitation_table(elements: DataFrame, kinds: Mapping[str, str], language: str = "en") -> DataFrame:
    """Limits from the flat elements of pages: elements(page, seq, is_head, text, date, number, language, allowance).

    A heading's words give its section's kind; a ban and a banned pair allow 0, a restriction what the row says. A missing date
    is that of the row before. One limit per number, language and date; rows of `language` are repeated as "default".
    """
    rows = A.sections(elements, F.col("is_head"), ["seq"], ["page"])
    head = rows.where("is_head").groupBy("page", "section").agg(F.first("text").alias("title"))
    kind = F.lit(None).cast("string")
    for word, value in reversed(list(kinds.items())):
        kind = F.when(F.lower("title").contains(word.lower()), value).otherwise(kind)
    rows = rows.where("not is_head").join(head, ["page", "section"], "left").withColumn("type", kind)
    rows = A.fill_forward(rows, "date", ["seq"], ["page"])
    allowance = F.when(F.col("type").isin("ban", "banned-pair"), F.lit(0).cast("long")).when(F.col("type") == "restrict", F.coalesce(F.col("allowance"), F.lit(1)).cast("long"))
    rows = rows.where("type is not null").select("number", "language", "date", "seq", "type", allowance.alias("allowance"), F.col("text").alias("note"))
    return A.default_rows(A.first_per_date(rows, ["number", "language"], "date", ["seq"]), language)


def conflicting_names(df: DataFrame, keys: Sequence[str] = ("language", "number"), variant: str = "parallel_id", name: str = "name", order: str = "card_id") -> DataFrame:
    """(keys, name, replacement): names of a record's unnumbered variants that differ in more than case take the first one's."""
    rows = df.where(F.col(variant) == 0)
    groups = rows.groupBy(*keys).agg(F.min_by(name, order).alias("replacement"), F.countDistinct(F.lower(name)).alias("n")).where("n > 1")
    return rows.select(*keys, name).distinct().join(groups.drop("n"), list(keys)).where(F.lower(name) != F.lower("replacement"))


def append_ace(df: DataFrame) -> DataFrame:
    return A.group_suffix(df, "number", "name", "ACE")


def latest_limits(limits: DataFrame) -> DataFrame:
    """The limit in force: of each number and language, the latest."""
    w = Window.partitionBy("number", "language").orderBy(F.desc("date"), F.desc("index"))
    return limits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
