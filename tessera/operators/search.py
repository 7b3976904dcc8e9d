"""Search: predicates are data, hits are ordered as a catalog and paged.

Records are rows with nested parts (a `dual` struct with the same fields, arrays `colors`, `requirements`, `rules`, ...), so
that multi-valued predicates are `exists` over arrays and need no join. Where only child tables are there, semi and anti joins
do the same (with_release, has, none_match).
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import code_parts, rank_of

OPS = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
#: Ordered enums, lowest first (fixed values).
RARITIES = ("P", "C", "U", "R", "SR", "UR", "SEC")
FORMS = ("standard", "super", "ultimate", "god")
#: Languages in result order (fixed values).
LANGUAGES = ("ja", "en", "zh-Hans", "ko")
PER_PAGE = 60


@dataclass(frozen=True)
class Predicate:
    """attribute op value, or attribute matching regex; op ":" is contains. mode: of negated bare words, "any" or "none"."""

    attribute: str
    op: str | None = ":"
    value: object = None
    regex: str | None = None
    negate: bool = False
    mode: str = "any"


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _any(values: Sequence[Column], test) -> Column:
    return reduce(lambda a, b: a | b, [_false(test(v)) for v in values])


def text_test(p: Predicate):
    """Case-insensitive contains or equals, or a case-sensitive regex that is found anywhere."""
    if p.regex is not None:
        return lambda v: v.rlike(p.regex)
    wanted = str(p.value).lower()
    return (lambda v: F.lower(v) == wanted) if p.op == "=" else (lambda v: F.lower(v).contains(wanted))


def number_test(p: Predicate):
    if p.regex is not None:
        return lambda v: v.cast("string").rlike(p.regex)
    return lambda v: OPS["=" if p.op in (":", None) else p.op](v, F.lit(int(p.value)))


def text_predicate(column: Column, p: Predicate) -> Column:
    """one text column of the record itself; a null never matches, negated or not."""
    test = text_test(p)(column)
    return _false(~test if p.negate else test)


def some_fails(values: Sequence[Column], p: Predicate) -> Column:
    """any of several numbers; negated, some value that is there fails."""
    test = number_test(p)
    return _any(values, (lambda v: ~test(v)) if p.negate else test)


def none_matches(values: Sequence[Column], p: Predicate, numbers: bool = False) -> Column:
    """Any of several columns; negated, none of them."""
    found = _any(values, number_test(p) if numbers else text_test(p))
    return ~found if p.negate else found


def in_array(array: Column, test, negate: bool = False) -> Column:
    """Any element of an array; negated, no element (true for a null or empty array)."""
    found = _false(F.exists(array, lambda x: _false(test(x))))
    return ~found if negate else found


def ranked(column: Column, levels: Sequence[str], p: Predicate) -> Column:
    """compare by rank; values outside the levels never match."""
    rank = levels.index(str(p.value))
    test = OPS["=" if p.op in (":", None) else p.op](rank_of(column, levels), F.lit(rank))
    return _false(~test if p.negate else test)


def ranked_any(array: Column, levels: Sequence[str], p: Predicate) -> Column:
    """any requirement's form by rank; negated, no requirement matches but there is one."""
    positive = Predicate(p.attribute, p.op, p.value)
    found = in_array(array, lambda x: ranked(x["form"], levels, positive))
    return (~found & (F.size(F.coalesce(array, F.array())) > 0)) if p.negate else found


def word(values: Sequence[Column], p: Predicate) -> Column:
    """F16: a bare word over name, number and the like. Negated, by default, some value there doesn't match; mode "none": no value does."""
    test = text_test(p)
    if p.negate and p.mode == "any":
        return _any(values, lambda v: ~test(v))
    found = _any(values, test)
    return ~found if p.negate else found


class Catalog:
    """Attributes of a record and how each is tested; columns that a table lacks make their attributes unknown."""

    texts = ("form", "attribute", "type", "effect", "inherited_effect", "security_effect", "notes")
    numbers = ("dp", "parallel_id", "block_icon", "play_cost", "use_cost", "level")
    all_texts = ("name", "number", "form", "attribute", "type", "effect", "inherited_effect", "security_effect")

    def __init__(self, df: DataFrame):
        self.df, self.columns = df, set(df.columns)
        self.dual = set(df.schema["dual"].dataType.fieldNames()) if "dual" in self.columns else set()

    def own(self, *names: str, dual: bool = True) -> list[Column]:
        found = [F.col(n) for n in names if n in self.columns]
        return found + ([F.col("dual")[n] for n in names if n in self.dual] if dual else [])

    def rules(self, p: Predicate, *types: str) -> Column:
        if "rules" not in self.columns:
            return F.lit(False)
        test = text_test(p)
        return in_array(F.col("rules"), lambda r: r["type"].isin(*types) & test(r["value"]))

    def pred(self, p: Predicate) -> Column | str:
        """The predicate as a column, or what is wrong with it."""
        a, has = p.attribute, self.columns
        if p.op not in (None, ":", *OPS):
            return f"unknown operator {p.op}"
        if a in self.numbers and a in has:
            return none_matches(self.own(a), p, numbers=True)
        if a == "cost":
            found = self.own("play_cost", "use_cost")
            return some_fails(found, p) if found else "unknown attribute cost"
        if a in ("name", "number") and a in has:
            positive = Predicate(a, p.op, p.value, p.regex)
            found = none_matches(self.own(a), positive) | self.rules(positive, a)
            return ~found if p.negate else found
        if a in ("word", "!word") and "name" in has:
            return word(self.own("name", "number"), Predicate(a, "=" if a == "!word" else ":", p.value, p.regex, p.negate, p.mode))
        if a == "category" and a in has:
            return none_matches(self.own(a), Predicate(a, "=", p.value, p.regex, p.negate))
        if a == "color" and "colors" in has:
            test = text_test(Predicate(a, "=", p.value, p.regex))
            found = in_array(F.col("colors"), test) | (in_array(F.col("dual")["colors"], test) if "colors" in self.dual else F.lit(False))
            return ~found if p.negate else found
        if a in ("requirement_category", "requirement_cost", "requirement_level", "requirement_color", "requirement_form") and "requirements" in has:
            part = a.removeprefix("requirement_")
            if part == "form":
                return ranked_any(F.col("requirements"), FORMS, p) if p.value in FORMS else f"unknown form {p.value}"
            if part == "color":
                test = text_test(Predicate(a, "=", p.value, p.regex))
                return in_array(F.col("requirements"), lambda r: F.exists(r["colors"], test), p.negate)
            test = number_test(p) if part in ("cost", "level") else text_test(Predicate(a, "=", p.value, p.regex))
            return in_array(F.col("requirements"), lambda r: test(r[part]), p.negate)
        if a == "rarity" and a in has:
            return ranked(F.col(a), RARITIES, p) if p.value in RARITIES else f"unknown rarity {p.value}"
        if a == "rarity_stamp" and a in has:
            return none_matches([F.col(a)], Predicate(a, "=", str(p.value).upper(), None, p.negate)) if str(p.value).upper() == "SP" else f"unknown stamp {p.value}"
        if a == "language" and a in has:
            if p.regex is None and p.value != "any" and p.value not in LANGUAGES and not p.negate:
                return f"unknown language {p.value}"
            return F.lit(True) if p.value == "any" else text_predicate(F.col(a), Predicate(a, "=", p.value, p.regex, p.negate))
        if a == "traits" and {"form", "attribute", "type"} & has:
            positive = Predicate(a, p.op, p.value, p.regex)
            found = none_matches(self.own("form", "attribute", "type", dual=False), positive) | self.rules(positive, "form", "attribute", "type")
            return ~found if p.negate else found
        if a == "text":
            found = self.own(*self.all_texts, "text")
            positive = Predicate(a, p.op, p.value, p.regex)
            if not found:
                return "unknown attribute text"
            hit = none_matches(found, positive) | self.rules(positive, "name", "number", "form", "attribute", "type")
            return ~hit if p.negate else hit
        if a.startswith("has:"):
            what = {"parallel": "parallel_id"}.get(a[4:], a[4:])
            if what not in has and what not in self.dual:
                return f"unknown attribute {a}"
            there = self._present(what)
            return ~there if p.negate else there
        if a in self.texts and a in has:
            return text_predicate(F.col(a), p)
        return f"unknown attribute {a}"

    def _present(self, name: str) -> Column:
        def test(c: Column, kind: str) -> Column:
            return F.size(F.coalesce(c, F.array())) > 0 if kind == "array" else (c > 0 if name == "parallel_id" else c.isNotNull())

        parts = []
        if name in self.columns:
            parts.append(test(F.col(name), self.df.schema[name].dataType.typeName()))
        if name in self.dual:
            parts.append(test(F.col("dual")[name], self.df.schema["dual"].dataType[name].dataType.typeName()))
        return reduce(lambda a, b: a | b, [_false(x) for x in parts])


def search(df: DataFrame, predicates: Sequence[Predicate], default_language: str | None = "en") -> tuple[DataFrame, DataFrame]:
    """rows that meet all valid predicates, and the others with what is wrong with them.

    Equal predicates count once. Without a language predicate the default language is asked for (F9).
    """
    catalog, conditions, errors = Catalog(df), [], []
    wanted = list(dict.fromkeys(predicates))
    if default_language and "language" in df.columns and not any(p.attribute == "language" for p in wanted):
        wanted.append(Predicate("language", "=", default_language))
    for p in wanted:
        found = catalog.pred(p)
        if isinstance(found, str):
            errors.append((p.attribute, found))
        else:
            conditions.append(found)
    hits = df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df
    return hits, df.sparkSession.createDataFrame(errors, "attribute string, error string")


def with_release(df: DataFrame, bridge: DataFrame, release: DataFrame, p: Predicate, key: str = "card_id", release_key: str = "release_id", name: str = "name") -> DataFrame:
    """rows with a release of a matching name; negated, rows without one."""
    found = bridge.join(release.where(text_predicate(F.col(name), Predicate(p.attribute, ":", p.value, p.regex))).select(release_key), release_key, "left_semi")
    return df.join(found.select(key), key, "left_anti" if p.negate else "left_semi")


def has(df: DataFrame, children: DataFrame, on: str | list[str], where: Column | None = None, negate: bool = False) -> DataFrame:
    """rows with a child row (that meets a condition); negated, rows without."""
    children = children.where(where) if where is not None else children
    return df.join(children.select(on), on, "left_anti" if negate else "left_semi")


def restricted(df: DataFrame, limits: DataFrame, on: str | list[str]) -> DataFrame:
    """rows with a restriction and no lifting of it."""
    return has(has(df, limits, on, F.col("type") == "restrict"), limits, on, F.col("type") == "unrestrict", negate=True)


def image_in_language(df: DataFrame) -> DataFrame:
    """rows whose image is in their own language."""
    return df.where(_false(F.col("image")["language"] == F.col("language")))


def exists_in(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    """rows with a partner."""
    return df.join(other.select(on), on, "left_semi")


def none_match(df: DataFrame, other: DataFrame, on: str | list[str], condition: Column | None = None) -> DataFrame:
    """Rows without a partner that meets the condition."""
    return has(df, other, on, condition, negate=True)


def override_where(df: DataFrame, column: str, code: str, prefixes: Sequence[str], value) -> DataFrame:
    """a constant for codes with these prefixes."""
    test = reduce(lambda a, b: a | b, [F.col(code).startswith(p) for p in prefixes])
    return df.withColumn(column, F.when(_false(test), F.lit(value)).otherwise(F.col(column)))


def catalog_order(language: str = "language", number: str = "number", variant: str = "parallel_id", tie: Sequence[str] = (), languages: Sequence[str] = LANGUAGES) -> list[Column]:
    """K1: language, set prefix, set number, card number, variant (null first), then the tie columns."""
    parts = code_parts(F.col(number))
    rank = F.coalesce(rank_of(F.col(language), languages), F.lit(len(languages)))
    return [rank, parts["prefix"], parts["set_number"], parts["card_number"], F.col(variant).asc_nulls_first(), *[F.col(t) for t in tie]]


def page(df: DataFrame, order: Sequence[Column], n: int, per_page: int = PER_PAGE) -> DataFrame:
    """K2: page n, from 1, of the ordered rows; empty beyond the last."""
    return df.orderBy(*order).offset((n - 1) * per_page).limit(per_page)


def page_info(df: DataFrame, n: int, per_page: int = PER_PAGE) -> DataFrame:
    """Total, pages, previous and next page, and the range shown."""
    total = F.col("total")
    pages = F.ceil(total / per_page).cast("long")
    shown = (F.lit(n) >= 1) & (F.lit(n) <= pages)
    return df.agg(F.count("*").alias("total")).select(
        "total", pages.alias("pages"), F.when((F.lit(n) > 1) & (F.lit(n) <= pages), F.lit(n - 1)).alias("previous"), F.when(F.lit(n) < pages, F.lit(n + 1)).alias("next"),
        F.when(shown, F.lit((n - 1) * per_page + 1).cast("long")).alias("first"), F.when(shown, F.least(F.lit(n * per_page), total)).alias("last"),
    )
