"""Audits across languages: each returns the rows that violate it. A record is known by `number` in several languages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .aggregates import adjacent_diff, missing_members, most_common, new_findings
from .places import TASK_ROWS, largest


def audit_counts(df: DataFrame, child: DataFrame, types: str = "type", number: str = "number", key: str = "card_id", exclude: Sequence[str] = ()) -> DataFrame:
    """Q1, Q7: numbers whose rows differ in how many children of each type they have; returns (number, variants)."""
    kept = child.where(~F.coalesce(F.col(types).isin(*exclude), F.lit(False))) if exclude else child
    counts = kept.groupBy(key, types).agg(F.count("*").alias("n")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(types, "n"))).alias("counts"))
    rows = df.select(number, key).join(counts, key, "left").withColumn("counts", F.coalesce(F.to_json("counts"), F.lit("[]")))
    return rows.groupBy(number).agg(F.countDistinct("counts").alias("variants")).where("variants > 1")


def audit_values(df: DataFrame, columns: Sequence[str], number: str = "number") -> DataFrame:
    """Q2, Q14: numbers whose rows disagree in any of the columns, null apart from values; returns (number, column, values)."""
    if all(isinstance(df.schema[c].dataType, IntegralType) for c in columns):  # whole numbers differ where their extremes do
        differs = lambda c: (F.min(c) < F.max(c)) | (F.max(F.col(c).isNull()) & (F.count(c) > 0))
        some = df.groupBy(F.col(number).alias("__number")).agg(reduce(lambda a, b: a | b, [F.coalesce(differs(c), F.lit(False)) for c in columns]).alias("__differs"))
        df = df.join(some.where("__differs"), F.col(number).eqNullSafe(F.col("__number")), "left_semi")
    rows = df.select(number, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select(number, "x.*")
    found = rows.groupBy(number, "column").agg((F.countDistinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("values"))
    return found.where("values > 1")


def audit_translation(df: DataFrame, field: str, language: str = "language", base: str = "ja", number: str = "number", variant: str = "parallel_id", key: str = "card_id", order: str = "number") -> DataFrame:
    """Q3: rows whose field, in the base language, differs from the most of their number; returns (number, key, language, value,
    found, expected).

    Per number and language the highest variant speaks. A text of another language stands for the base text of the first number,
    by `order`, that has both; a base text stands for itself. The most common base text of a number's rows is expected of all of
    them; of equally common ones the smallest, null last.
    """
    spoken = df.groupBy(number, language).agg(F.max_by(field, variant).alias("value"), F.min(order).alias("order"))
    own = spoken.where(F.col(language) == base).select(number, F.col("value").alias("base")).where("base is not null")
    first = spoken.where(F.col(language) != base).join(own, number).groupBy(language, "value").agg(F.min_by("base", F.struct("order", "base")).alias("base"))
    first = first.select(F.col(language).alias("__l"), F.col("value").alias("__v"), F.col("base").alias("__base"))
    # a text that no number speaks in the base language stands for none
    itself = F.col(language) == base
    rows = df.select(number, key, language, F.col(field).alias("value"))
    rows = rows.join(first, (F.col(language) == F.col("__l")) & F.col("value").eqNullSafe(F.col("__v")), "left")
    heard = own.select(F.col("base").alias("__own")).distinct()
    rows = rows.join(heard, itself & (F.col("value") == F.col("__own")), "left").withColumn("found", F.when(itself, F.col("__own")).otherwise(F.col("__base")))
    counts = rows.groupBy(number, "found").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("found").isNull().alias("none"), "found")).alias("best")
    usual = counts.groupBy(number).agg(best, F.count("*").alias("texts")).where("texts > 1").select(number, F.col("best.found").alias("expected"))
    return rows.join(usual, number).where(~F.col("found").eqNullSafe(F.col("expected"))).select(number, key, language, "value", "found", "expected")


def audit_missing_in_language(df: DataFrame, value: str, number: str = "number", language: str = "language") -> DataFrame:
    """Q4: values that some language of a number has and another hasn't; returns (number, language, value)."""
    return missing_members(df, number, language, value)


def audit_learned(tokens: DataFrame, dictionary: DataFrame, base: str = "ja") -> DataFrame:
    """Q5: tokens(number, language, text) of other languages whose base text, by dictionary(text, base), isn't among the number's."""
    own = tokens.where(F.col("language") == base).select("number", F.col("text").alias("base")).distinct()
    return tokens.where(F.col("language") != base).join(dictionary, "text").join(own, ["number", "base"], "left_anti").select("number", "language", "text", "base").distinct()


def audit_first(child: DataFrame, never_first: Sequence[str], key: str = "card_id") -> DataFrame:
    """Q6: rows that begin with a kind that never is first."""
    return child.where((F.col("index") == 0) & F.col("type").isin(*never_first)).select(key, "type").distinct()


def audit_presence(df: DataFrame, columns: Sequence[str], number: str = "number", key: str = "card_id", ignore: str = "※") -> DataFrame:
    """Q8: text columns that a row lacks but the fullest row of its number has; returns (key, missing).

    Values that begin with `ignore` don't count when the fullest row is chosen; of equal ones the first key is it.
    """
    there = lambda test: F.filter(F.array(*[F.when(test(F.col(c)), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    rows = df.select(number, key, there(lambda c: c.isNotNull()).alias("has"), there(lambda c: c.isNotNull() & ~c.startswith(ignore)).alias("counts"))
    full = rows.groupBy(number).agg(F.min_by("has", F.struct(-F.size("counts"), key)).alias("full"))
    return rows.join(full, number).select(key, F.array_except("full", "has").alias("missing")).where(F.size("missing") > 0)


def audit_majority(df: DataFrame, column: str, number: str = "number", key: str = "card_id") -> DataFrame:
    """Q9: rows that differ from their number's most common value; returns (number, key, value, majority)."""
    usual = most_common(df, [number], column).select(number, F.col(column).alias("majority"))
    return df.join(usual, number).where(~F.col(column).eqNullSafe(F.col("majority"))).select(number, key, F.col(column).alias("value"), "majority")


#: Q10: bytes of corrections that go to all tasks at one time.
ERRATA_BYTES = 16 << 20


def audit_errata(df: DataFrame, errata: DataFrame, keys: Sequence[str], columns: Sequence[str], most_bytes: int = ERRATA_BYTES, most_rows: int = TASK_ROWS) -> DataFrame:
    """Q10: errata no line of whose correction stands in any of the columns, lower-cased and with blanks folded.

    Corrections of up to about most_bytes (their size is counted first) go to where the texts are, so that no text is moved. More of
    them meet the texts by their keys, so that these are read once whatever there is to correct; but where one key has more than
    most_rows texts, corrections go to the texts in several passes. Only the different (keys, correction) that stand come back.
    """
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    lines = F.filter(F.transform(F.split("correction", "\n"), lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))), lambda x: x != "")
    asked = errata.select(*keys, "correction").distinct()
    passes = (asked.agg(F.sum(F.octet_length("correction") + 64)).first()[0] or 0) // most_bytes + 1
    texts = df.select(*[F.col(k).alias(f"__{k}") for k in keys], fold(F.concat_ws(" ", *columns)).alias("__text"))
    stands = F.exists("__lines", lambda line: F.contains(F.col("__text"), line))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]

    def met() -> DataFrame:
        return texts.join(asked.withColumn("__lines", lines), [*same, stands]).select(*keys, "correction").distinct()

    def found(k: int) -> DataFrame:
        some = asked.where(F.pmod(F.xxhash64(*keys, "correction"), F.lit(passes)) == k).withColumn("__lines", lines)
        return texts.join(F.broadcast(some), [*same, stands]).select(*keys, "correction").distinct()

    standing = met() if passes > 1 and largest(df, keys) <= most_rows else reduce(DataFrame.union, [found(k) for k in range(passes)])
    known = errata.join(df.select(*keys).distinct(), list(keys), "left_semi")
    return known.join(standing, [*keys, "correction"], "left_anti").select(*errata.columns)


def audit_requirements(df: DataFrame, key: str = "card_id") -> DataFrame:
    """Q11: rows with a requirement without cost, or of a creature without form."""
    bad = F.exists("requirements", lambda r: r["cost"].isNull() | (F.coalesce(r["category"] == "creature", F.lit(False)) & r["form"].isNull()))
    return df.where(F.coalesce(bad, F.lit(False))).select(key)


def audit_expectations(df: DataFrame, expected: DataFrame, prefix: Column, value: str, key: str, saved: DataFrame | None = None) -> DataFrame:
    """Q12: rows below or above what expected(prefix, least, most) says of their set, less the saved findings."""
    rows = df.withColumn("prefix", prefix).join(expected, "prefix").where(~F.col(value).between(F.col("least"), F.col("most")))
    found = rows.select(key, "prefix", value)
    return found if saved is None else new_findings(found, saved, [key])


def audit_lonely(df: DataFrame, number: str = "number", language: str = "language", base: str = "ja") -> DataFrame:
    """Q13: numbers with a single row that isn't in the base language. Rows are counted without their languages: a text among the
    aggregates makes Spark sort all rows."""
    others = F.count(F.when(F.col(language) != base, 1))
    lonely = df.groupBy(F.col(number).alias("__number")).agg(F.count("*").alias("n"), others.alias("others")).where("n = 1 and others = 1")
    return df.join(lonely, F.col(number).eqNullSafe(F.col("__number")), "left_semi").select(number, language)


def audit_limits(df: DataFrame, limits: DataFrame, key: str = "card_id", number: str = "number", variant: str = "parallel_id") -> DataFrame:
    """Q14: numbers whose unnumbered variants differ in their number of limits."""
    n = limits.groupBy(key).agg(F.count("*").alias("n"))
    rows = df.where(F.col(variant) == 0).join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.groupBy(number).agg(F.countDistinct("n").alias("variants")).where("variants > 1")


def audit_releases(release: DataFrame, required: Sequence[str], exempt: Sequence[str]) -> DataFrame:
    """Q15: releases that lack something they should have, unless their genre is exempt."""
    lacks = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    return release.where(lacks & ~F.coalesce(F.col("genre").isin(*exempt), F.lit(False)))


def audit_duplicates(df: DataFrame, content: str, by: Sequence[str], key: str = "card_id") -> DataFrame:
    """Q16: equal contents within a group; returns (by, hash, keys)."""
    rows = df.withColumn("hash", F.sha2(F.col(content).cast("binary"), 256)).groupBy(*by, "hash").agg(F.array_sort(F.collect_list(key)).alias("keys"))
    return rows.where(F.size("keys") > 1)


def audit_files(rows: DataFrame, files: DataFrame, by: Sequence[str]) -> DataFrame:
    """Q17: groups with another number of rows than of files."""
    a, b = rows.groupBy(*by).agg(F.count("*").alias("rows")), files.groupBy(*by).agg(F.count("*").alias("files"))
    both = a.join(b, list(by), "full").select(*by, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("files", F.lit(0)).alias("files"))
    return both.where("rows <> files")


def audit_grids(df: DataFrame, group: str, language: str, member: str) -> DataFrame:
    """Q18: members missing from a grid in a language."""
    return missing_members(df, group, language, member)


def audit_inputs(df: DataFrame, origin: str, origins: DataFrame) -> DataFrame:
    """Q19: origins without any row."""
    return origins.join(df.select(origin), origin, "left_anti")


def audit_neighbours(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Q9: rows that differ from the one before them."""
    return adjacent_diff(df, by, order, columns).where(F.size("differs") > 0)


def run_audits(found: Mapping[str, tuple[DataFrame, str]], allowed: DataFrame | None = None) -> DataFrame:
    """(audit, finding) of all audits {name: (violations, key)}, without those in allowed(audit, finding), if given."""
    rows = [df.select(F.lit(name).alias("audit"), F.col(key).cast("string").alias("finding")).distinct() for name, (df, key) in found.items()]
    both = reduce(lambda a, b: a.unionByName(b), rows)
    return both if allowed is None else both.join(allowed, ["audit", "finding"], "left_anti")
