"""E11 as a staged build: pages and payloads become cards, audits are gates, each stage is written and can be restarted from.

A stage takes the tables made so far and returns new ones, which are written under folder/<stage>/<table>. A stage that has all
its tables there is read and not run again, so that a build that was stopped by a gate, or lost its driver, goes on behind the
last whole stage. Give a new folder for new sources.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import apply_fixes, normalize_text
from tessera.operators import aggregates as A
from tessera.operators import audit as Q
from tessera.operators import curate as C
from tessera.operators import joins as J
from tessera.sources import io as IO
from tessera.sources import pages as W
from tessera.sources.shared import exists

from .build import FILL, FIXES, TEXTS, icons, rules

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """makes names the tables that run returns."""

    name: str
    makes: Sequence[str]
    run: Callable[[Tables], Tables]


class BuildStopped(Exception):
    """A gate found violations. findings(audit, finding) is their table, counts has their number by audit."""

    def __init__(self, stage: str, findings: DataFrame, counts: dict[str, int]):
        super().__init__(f"{stage}: " + ", ".join(f"{n} of {name}" for name, n in sorted(counts.items())))
        self.findings, self.counts = findings, counts


def run_stages(spark: SparkSession, stages: Sequence[Stage], tables: Mapping[str, DataFrame], folder: str) -> Tables:
    """The given tables and all that the stages make, read from where they were written."""
    out = dict(tables)
    for stage in stages:
        paths = {name: f"{folder}/{stage.name}/{name}" for name in stage.makes}
        if not all(exists(spark, f"{path}/_SUCCESS") for path in paths.values()):
            made = stage.run(out)
            for name, path in paths.items():
                made[name].write.mode("overwrite").parquet(path)
        out |= {name: spark.read.parquet(path) for name, path in paths.items()}
    return out


def cards_from_pages(pages: DataFrame, spec: Mapping[str, str], key: str = "page_id", html: str = "html") -> DataFrame:
    """A row per page with a column for each field of spec: the text of the first element at the end of a path, null without
    one. The other columns of pages stay."""
    found = W.extract_records(pages, spec, key, html).where("index = 0").groupBy(key).pivot("field", list(spec)).agg(F.first("text"))
    return pages.drop(html).join(found, key, "left")


def _as_cards(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df with exactly the columns of cards and their releases; missing ones are null."""
    fields = [*IO.empty(spark, "card").schema, *IO.empty(spark, "card").withColumn("releases", F.array().cast("array<string>")).schema[-1:]]
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def ingest(tables: Tables) -> Tables:
    """Cards from page_card and payload_card, whatever columns of cards these have."""
    parts = [tables[name] for name in ("page_card", "payload_card") if name in tables]
    cards = [_as_cards(df.sparkSession, df) for df in parts]
    out = cards[0]
    for more in cards[1:]:
        out = out.unionByName(more)
    return {"raw": out}


def merge_images(tables: Tables) -> Tables:
    """E5: cards of one image become the first of them, with all notes and releases; cards without an image stay."""
    raw = tables["raw"].withColumn("__image", F.col("image.source"))
    merged = C.consolidate(raw.where("__image is not null"), "__image", ["language", "number"], "card_id", "notes", "releases")
    return {"merged": raw.where("__image is null").unionByName(merged).drop("__image")}


def normalize(tables: Tables) -> Tables:
    """Texts folded and fixed, patches, variants numbered."""
    card = tables["merged"]
    card = card.select(*[apply_fixes(normalize_text(F.col(c)), FIXES).alias(c) if c in TEXTS else F.col(c) for c in card.columns])
    if "patch" in tables:
        card = J.apply_patches(card, tables["patch"], ["number", "language"], [*TEXTS, "rarity"])
    numbered = A.number_variants(card, ["language", "number"], ["card_id"], "parallel_id", ~F.col("language").isin("en", "ja"), mostly_single=True)
    return {"numbered": numbered.withColumn("parallel_id", F.col("variant").cast("int")).drop("variant")}


def fill(tables: Tables) -> Tables:
    """Missing values from the number's canonical row; Korean use costs, the colours of a dual record's other half and all
    requirements are the canonical row's, where it has them."""
    card = tables["numbered"]
    canonical = (F.col("language") == "ja") & (F.col("parallel_id") == 0)
    more = card.withColumns({"__cost": F.col("use_cost"), "__colors": F.col("dual.colors")})
    more = J.fill_from_canonical(more, "number", canonical, [F.col("card_id")], FILL, ["__cost", "__colors"])
    cost = F.when(F.col("language") == "ko", F.coalesce("__cost", "use_cost")).otherwise(F.col("use_cost"))
    dual = F.when(F.col("dual").isNotNull(), F.col("dual").withField("colors", F.coalesce("__colors", F.col("dual.colors"))))
    out = {"filled": more.withColumns({"use_cost": cost, "dual": dual}).select(*card.columns)}
    if "requirement" in tables:
        rows = tables["requirement"]
        spoken = card.where(canonical).groupBy("number").agg(F.max("card_id").alias("__canonical"))
        heard = spoken.join(rows.select(F.col("card_id").alias("__canonical")).distinct(), "__canonical", "left_semi")
        source = card.select("card_id", "number").join(heard, "number", "left").select("card_id", F.coalesce("__canonical", "card_id").alias("__from"))
        out["requirements"] = source.join(rows.withColumnRenamed("card_id", "__from"), "__from").drop("__from")
    return out


def correct(tables: Tables) -> Tables:
    """E10's suffix, E1 with the dual part, E2."""
    card = C.append_ace(tables["filled"])
    if "errata" in tables:
        latest = A.last_per_key(tables["errata"], ["number", "language"], ["date"])
        card = C.apply_errata(card, latest, ["number", "language"], TEXTS, part="dual")
    if "rule_revision" in tables:
        card = C.apply_revisions(card, tables["rule_revision"], ["number", "language"], "effect", "〈ルール〉")
    return {"corrected": card}


def audits(tables: Tables) -> dict[str, tuple[DataFrame, str]]:
    """The audits that a build must pass, each with the column that names its findings."""
    card = tables["corrected"]
    found = {"values": (Q.audit_values(card, ["level", "dp", "play_cost"]), "number"), "lonely": (Q.audit_lonely(card), "number")}
    if "errata" in tables:
        both = card.withColumn("dual_texts", F.concat_ws(" ", "dual.name", "dual.effect"))
        found["errata"] = (Q.audit_errata(both, tables["errata"], ["number", "language"], [*TEXTS, "dual_texts"]), "number")
    if "release" in tables:
        found["releases"] = (Q.audit_releases(tables["release"], ["name", "date"], ["promo"]), "release_id")
    return found


def audit(tables: Tables) -> Tables:
    """The findings of all audits. They are written, so that neither a gate that stops nor the next run computes them again."""
    return {"found": Q.run_audits(audits(tables))}


def gate(tables: Tables) -> Tables:
    """Stops the build unless all findings are in allowed(audit, finding); those that are become a table."""
    found = tables["found"]
    left = found.join(tables["allowed"], ["audit", "finding"], "left_anti") if "allowed" in tables else found
    counts = {r["audit"]: r["count"] for r in left.groupBy("audit").count().collect()}  # a row for each audit
    if counts:
        raise BuildStopped("gate", left, counts)
    return {"accepted": found}


def derive(tables: Tables) -> Tables:
    """Rules and icons of the corrected texts."""
    card = tables["corrected"]
    return {"rule": rules(card), "icon": icons(card, tables["release"], tables["card_release"])}


def publish(tables: Tables) -> Tables:
    """The cards, upserted into those of before."""
    card = tables["corrected"]
    return {"card": IO.upsert(tables["saved"], card, "card_id") if "saved" in tables else card}


def stages(tables: Mapping[str, DataFrame]) -> list[Stage]:
    """The stages of a build of the given sources."""
    return [
        Stage("ingest", ["raw"], ingest), Stage("consolidate", ["merged"], merge_images), Stage("normalize", ["numbered"], normalize),
        Stage("fill", ["filled", *(["requirements"] if "requirement" in tables else [])], fill), Stage("correct", ["corrected"], correct),
        Stage("audit", ["found"], audit), Stage("gate", ["accepted"], gate), Stage("derive", ["rule", "icon"], derive), Stage("publish", ["card"], publish),
    ]


def build_staged(spark: SparkSession, sources: Mapping[str, DataFrame], folder: str) -> Tables:
    """All tables of a build. sources: page_card and payload_card (one at least), release, card_release, and as they are there
    patch, requirement, errata, rule_revision, saved and allowed(audit, finding). Raises BuildStopped where an audit finds what
    isn't allowed; called again with the folder and more allowed, it goes on from there."""
    return run_stages(spark, stages(sources), sources, folder)
