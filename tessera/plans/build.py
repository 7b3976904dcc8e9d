"""The catalog from its sources, one DataFrame after the other; written tables cut the lineage where a step is read twice."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import apply_fixes, normalize_text
from tessera.operators import aggregates as A
from tessera.operators import curate as C
from tessera.operators import joins as J
from tessera.sources.io import upsert
from tessera.sources.shared import written

TEXTS = ("name", "effect", "inherited_effect", "security_effect")
FIXES = (("literal", "﻿", ""), ("regex", r"\.{2,}", "."))
FILL = ("rarity", "level", "dp", "play_cost", "use_cost")


def rules(card: DataFrame) -> DataFrame:
    """E3 with a dictionary of the cards' own traits."""
    traits = [card.select(F.explode(F.split(c, "[/,]")).alias("token"), F.lit(c).alias("type")) for c in ("form", "attribute", "type")]
    dictionary = traits[0].union(traits[1]).union(traits[2]).where("token is not null").distinct()
    markers = {"特徴:": "trait", "Trait:": "trait", "名称:": "name", "Name:": "name", "You can include up to": "limit", "枚まで入れられる": "limit"}
    return C.extract_rules(card, markers, dictionary)


def icons(card: DataFrame, release: DataFrame, card_release: DataFrame) -> DataFrame:
    """E4 with numbers ranked by the date of their first release."""
    first = card_release.join(release, "release_id").join(card.select("card_id", "number"), "card_id").groupBy("number").agg(F.min("date").alias("date"))
    order = card.select("number").distinct().join(first, "number", "left").select("number", F.coalesce("date", F.to_date(F.lit("9999-12-31"))).alias("date"))
    # ranks by (date, number), as text: the order is all that counts, so that no task has to number all of them
    ranks = order.select(F.col("number").alias("group"), F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), "number").alias("rank"))
    seeds = card.sparkSession.createDataFrame([("Your Turn", "timing"), ("Once Per Turn", "precondition")], "text string, kind string")
    return C.extract_icons(card, ["effect", "inherited_effect", "security_effect"], "card_id", "number", ranks, seeds)


def build_catalog(sources: Mapping[str, DataFrame], keep: Callable[[DataFrame, str], DataFrame] = written) -> dict[str, DataFrame]:
    """Tables card, icon and rule from card, patch, errata, rule_revision, release, card_release and saved (cards of before).

    keep(df, name) writes a table that is read more than once, to the shared folder, and returns it as read; a function that returns
    df leaves one lazy plan, which normalises all texts for each of its uses. Steps: texts normalised and fixed,
    patches, variants numbered, canonical values filled, errata, revisions, rules, icons, upsert into the saved cards.
    """
    card = sources["card"]
    card = card.select(*[apply_fixes(normalize_text(F.col(c)), FIXES).alias(c) if c in TEXTS else F.col(c) for c in card.columns])
    if "patch" in sources:
        card = J.apply_patches(card, sources["patch"], ["number", "language"], [*TEXTS, "rarity"])
    numbered = A.number_variants(card, ["language", "number"], ["card_id"], "parallel_id", ~F.col("language").isin("en", "ja"), mostly_single=True)
    card = keep(numbered.withColumn("parallel_id", F.col("variant").cast("int")).drop("variant"), "numbered")
    canonical = (F.col("language") == "ja") & (F.col("parallel_id") == 0)
    card = J.fill_from_canonical(card, "number", canonical, [F.col("card_id")], FILL)
    card = C.append_ace(card)
    if "errata" in sources:
        card = C.apply_errata(card, A.last_per_key(sources["errata"], ["number", "language"], ["date"]), ["number", "language"], TEXTS)
    if "rule_revision" in sources:
        card = C.apply_revisions(card, sources["rule_revision"], ["number", "language"], "effect", "〈ルール〉")
    card = keep(card, "corrected")
    rule, icon = rules(card), icons(card, sources["release"], sources["card_release"])
    if "saved" in sources:
        card = upsert(sources["saved"], card, "card_id")
    return {"card": card, "rule": rule, "icon": keep(icon, "icon")}
