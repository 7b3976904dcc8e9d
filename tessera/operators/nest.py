"""Nested documents: parents with ordered arrays of children, as rows or as JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nest(parent: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """Parent with an array column per child table: {name: (child with the key, order, fields)}.

    Each child is grouped once by the parent's key; fields may be nested arrays themselves, so levels compose from below.
    Parents without children have empty arrays.
    """
    out = parent
    for name, (child, order, fields) in children.items():
        row = F.struct(*order, *[f for f in fields if f not in order])
        rows = child.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias(name))
        rows = rows.withColumn(name, _fields(F.col(name), fields))
        empty = F.array().cast(rows.schema[name].dataType)
        out = out.join(rows, key, "left").withColumn(name, F.coalesce(name, empty))
    return out


def _fields(rows: Column, fields: Sequence[str]) -> Column:
    return F.transform(rows, lambda r: F.struct(*[r[f].alias(f) for f in fields]))


def to_documents(tables: Mapping[str, DataFrame], key: str = "card_id") -> DataFrame:
    """Records ("card") with all other tables as arrays of their columns, in the order of the columns."""
    children = {}
    for name, table in tables.items():
        if name != "card":
            fields = [c for c in table.columns if c != key]
            children[name] = (table, fields, fields)
    card = tables["card"]
    for name, (child, order, fields) in children.items():
        children[name] = (child, [f for f in order if _sortable(child, f)], fields)
    return nest(card, key, children)


def _sortable(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() not in ("map", "variant")


def empty_as_null(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def card_document(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(card_id, document): attributes and relationships as JSON, with siblings, releases and the list of what is included.

    tables: card(card_id, number, language, parallel_id, ...), color(card_id, index, color), release(release_id, name, date)
    and card_release(card_id, release_id). Arrays stand in order of index, (date, id) and id; nulls are left out.
    """
    card = tables["card"]
    releases = tables["card_release"].join(tables["release"], "release_id")
    out = nest(card, "card_id", {"colors": (tables["color"], ["index"], ["index", "color"]), "releases": (releases, ["date", "release_id"], ["release_id", "name"])})
    # members of a language, and of a variant, of a number: no more than what documents list
    same = card.groupBy("number", "language").agg(F.array_sort(F.collect_list(F.struct("parallel_id", "card_id"))).alias("__same"))
    other = card.groupBy("number", F.col("parallel_id").alias("__p")).agg(F.array_sort(F.collect_list(F.struct("language", "parallel_id", "card_id"))).alias("__other"))
    out = out.join(same, ["number", "language"]).join(other.withColumnRenamed("number", "__n"), (F.col("number") == F.col("__n")) & F.col("parallel_id").eqNullSafe(F.col("__p")))
    ids = lambda rows, test: F.transform(F.filter(rows, test), lambda x: x["card_id"])
    variants = ids("__same", lambda x: x["card_id"] != F.col("card_id"))
    translations = ids("__other", lambda x: x["language"] != F.col("language"))
    release_ids = F.transform("releases", lambda r: r["release_id"])
    included = F.array_distinct(F.concat(F.transform(release_ids, lambda x: F.concat(F.lit("release/"), x.cast("string"))), F.transform(F.concat(variants, translations), lambda x: F.concat(F.lit("card/"), x.cast("string")))))
    plain = [c for c in card.columns if c != "card_id"]
    document = F.struct(
        F.col("card_id").alias("id"), F.struct(*plain, F.transform("colors", lambda x: x["color"]).alias("colors")).alias("attributes"),
        F.struct(release_ids.alias("releases"), variants.alias("variants"), translations.alias("translations")).alias("relationships"), included.alias("included"),
    )
    return out.select("card_id", F.to_json(document).alias("document"))


def release_document(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(release_id, document): a release with its number of different records and their sorted ids."""
    cards = tables["card_release"].groupBy("release_id").agg(F.array_sort(F.collect_set("card_id")).alias("cards"))
    out = tables["release"].join(cards, "release_id", "left").withColumn("cards", F.coalesce("cards", F.array().cast(cards.schema["cards"].dataType)))
    attributes = F.struct(*[c for c in tables["release"].columns if c != "release_id"], F.size("cards").alias("n_cards"))
    return out.select("release_id", F.to_json(F.struct(F.col("release_id").alias("id"), attributes.alias("attributes"), "cards")).alias("document"))


def language_document(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(language, document): latest date and releases of each language, newest first."""
    from .aggregates import latest_per_language

    rows = latest_per_language(tables["release"])
    return rows.select("language", F.to_json(F.struct("language", F.date_format("latest", "yyyy-MM-dd").alias("latest"), "releases")).alias("document"))
