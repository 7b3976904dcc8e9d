"""Queries: search predicates, order and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import code_parts, rank_of
from tessera.operators import search as S
from tessera.operators.places import place
from tessera.operators.search import Predicate as P

from .registry import register


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark, d):
    """Documents as records: the source is the number, the text the effect."""
    return _t(spark, d, "documents").select("doc_id", F.col("source").alias("number"), F.col("source").alias("name"), F.col("lang").alias("language"), F.col("text").alias("effect"), (F.col("doc_id") % 5).alias("parallel_id"))


def parts(spark, d):
    """Parts as records with costs; every third has a dual part."""
    c = F.col
    dual = F.when(c("p_partkey") % 3 == 0, F.struct((c("p_size") + 7).cast("long").alias("play_cost"), (c("p_size") % 9).cast("long").alias("use_cost"), F.lit("option").alias("category"), F.array(c("p_type")).alias("colors"), F.when(c("p_size") % 5 == 0, c("p_name")).alias("effect")))
    return _t(spark, d, "part").select(
        c("p_partkey").alias("card_id"), c("p_name").alias("name"), c("p_brand").alias("number"), F.lit("en").alias("language"), c("p_size").cast("long").alias("dp"), F.when(c("p_size") % 4 != 0, c("p_size").cast("long")).alias("play_cost"),
        F.when(c("p_size") % 5 == 0, (c("p_size") % 11).cast("long")).alias("use_cost"), F.element_at(F.array(*[F.lit(x) for x in S.RARITIES]), (c("p_size") % 7 + 1).cast("int")).alias("rarity"), F.when(c("p_size") > 25, F.lit("creature")).otherwise(F.lit("tamer")).alias("category"),
        F.array(c("p_type")).alias("colors"), dual.alias("dual"),
        F.when(c("p_size") % 6 != 0, F.array(F.struct((c("p_size") % 8).cast("long").alias("cost"), (c("p_size") % 7).cast("long").alias("level"), F.element_at(F.array(*[F.lit(x) for x in S.FORMS]), (c("p_size") % 4 + 1).cast("int")).alias("form"), F.lit("creature").alias("category"), F.array(c("p_type")).alias("colors")))).alias("requirements"),
        F.when(c("p_size") % 3 == 0, "SP").alias("rarity_stamp"), F.when(c("p_size") % 2 == 0, c("p_type")).alias("form"), F.when(c("p_size") % 3 == 0, c("p_brand")).alias("attribute"), c("p_name").alias("type"), F.when(c("p_size") % 7 == 0, c("p_name")).alias("effect"), (c("p_partkey") % 3).alias("parallel_id"),
        F.when(c("p_partkey") % 4 == 0, F.array(F.struct(F.lit("type").alias("type"), F.lit("Economist").alias("value")))).when(c("p_partkey") % 4 == 1, F.array(F.struct(F.lit("name").alias("type"), F.lit("Economy").alias("value")))).alias("rules"),
    )


_PART = """WITH c AS (SELECT p_partkey AS card_id, p_name AS name, p_brand AS number, p_type, p_size AS dp,
  CASE WHEN p_size % 4 <> 0 THEN p_size END AS play_cost, CASE WHEN p_size % 5 = 0 THEN p_size % 11 END AS use_cost,
  ['P','C','U','R','SR','UR','SEC'][p_size % 7 + 1] AS rarity, p_size % 7 AS rarity_rank, CASE WHEN p_size > 25 THEN 'creature' ELSE 'tamer' END AS category,
  CASE WHEN p_partkey % 3 = 0 THEN p_size + 7 END AS d_play, CASE WHEN p_partkey % 3 = 0 THEN p_size % 9 END AS d_use, p_partkey % 3 = 0 AS dual,
  p_size % 6 <> 0 AS req, CASE WHEN p_size % 6 <> 0 THEN p_size % 8 END AS r_cost, CASE WHEN p_size % 6 <> 0 THEN p_size % 7 END AS r_level, CASE WHEN p_size % 6 <> 0 THEN p_size % 4 END AS r_form
  FROM part) SELECT card_id, dp FROM c WHERE """
_DOC = """WITH c AS (SELECT doc_id, source AS number, source AS name, lang AS language, text AS effect, doc_id % 5 AS parallel_id FROM documents)
SELECT doc_id FROM c WHERE """


def _doc_hits(name, condition, *predicates, default="en"):
    register(name, _DOC + condition)(lambda spark, d: S.search(documents(spark, d), predicates, default)[0].select("doc_id"))


def _part_hits(name, condition, *predicates):
    register(name, _PART + condition)(lambda spark, d: S.search(parts(spark, d), predicates)[0].select("card_id", F.col("dp").cast("int").alias("dp")))


_doc_hits("f1_text_contains", "language = 'en' AND contains(lower(effect), 'the that')", P("effect", ":", "The that"))
_doc_hits("f1_text_negated", "language = 'en' AND NOT contains(lower(effect), 'the')", P("effect", ":", "the", negate=True))
_doc_hits("f1_text_regex_negated", r"language = 'en' AND NOT regexp_matches(effect, '\bof [a-z]+tion\b')", P("effect", regex=r"\bof [a-z]+tion\b", negate=True))
_doc_hits("f3_name_number", "language = 'en' AND contains(lower(name), 'c1') AND NOT (lower(number) = 'src11')", P("name", ":", "C1"), P("number", "=", "SRC11", negate=True))
_doc_hits("f9_language_any", "contains(lower(effect), 'tion')", P("language", "=", "any"), P("effect", ":", "tion"))
_doc_hits("f9_language_regex", "regexp_matches(language, '^(de|fr)$')", P("language", regex="^(de|fr)$"))
_doc_hits("f14_traits_f15_text", "language = 'en' AND (contains(lower(effect), 'erin') OR contains(lower(name), 'erin') OR contains(lower(number), 'erin'))", P("text", ":", "erin"))
_doc_hits("f16_bare_word", "language = 'en' AND (contains(lower(name), '7') OR contains(lower(number), '7'))", P("word", ":", "7"))
_doc_hits("f16_negated_any", "language = 'en' AND (NOT contains(lower(name), '7') OR NOT contains(lower(number), '7'))", P("word", ":", "7", negate=True))
_doc_hits("f16_negated_none", "language = 'en' AND NOT (contains(lower(name), '7') OR contains(lower(number), '7'))", P("word", ":", "7", negate=True, mode="none"))
_doc_hits("f17_conjunction", "language = 'en' AND contains(lower(effect), 'the') AND parallel_id <> 2", P("effect", ":", "the"), P("effect", ":", "the"), P("parallel_id", "=", 2, negate=True), P("no_such", ":", "x"))
_part_hits("f2_cost", "play_cost >= 40 OR use_cost >= 40 OR d_play >= 40 OR d_use >= 40", P("cost", ">=", 40))
_part_hits("f2_cost_negated", "NOT play_cost < 20 OR NOT use_cost < 20 OR NOT d_play < 20 OR NOT d_use < 20", P("cost", "<", 20, negate=True))
_part_hits("f4_f5_category", "category = 'tamer' OR dual AND 'option' = 'tamer'", P("category", "=", "Tamer"))
_part_hits("f5_requirement_category", "NOT req", P("requirement_category", "=", "creature", negate=True))
_part_hits("f6_color", "lower(p_type) = 'economy'", P("color", ":", "ECONOMY"))
_part_hits("f6_requirement_color", "NOT (req AND lower(p_type) = 'economy')", P("requirement_color", ":", "economy", negate=True))
_part_hits("f7_numbers", "dp > 20 AND NOT coalesce(play_cost = 33, false) AND NOT coalesce(d_play = 33, false)", P("dp", ">", 20), P("play_cost", "=", 33, negate=True))
_part_hits("f7_number_regex", "regexp_matches(dp::VARCHAR, '^[13]')", P("dp", regex="^[13]"))
_part_hits("f8_requirements", "r_cost <= 3 AND NOT coalesce(r_level = 2, false)", P("requirement_cost", "<=", 3), P("requirement_level", "=", 2, negate=True))
_part_hits("f10_rarity", "rarity_rank >= 4", P("rarity", ">=", "SR"))
_part_hits("f11_requirement_form", "r_form >= 2", P("requirement_form", ">=", "ultimate"))
_part_hits("f11_requirement_form_negated", "req AND NOT r_form >= 2", P("requirement_form", ">=", "ultimate", negate=True))
_TRAITS = "(dp % 2 = 0 AND contains(lower(p_type), 'econ') OR dp % 3 = 0 AND contains(lower(number), 'econ') OR contains(lower(name), 'econ') OR card_id % 4 = 0)"
_part_hits("f4_rarity_stamp", "dp % 3 = 0", P("rarity_stamp", "=", "sp"))
_part_hits("f4_rarity_stamp_negated", "dp % 3 <> 0", P("rarity_stamp", "=", "SP", negate=True))
_part_hits("f14_traits", _TRAITS, P("traits", ":", "Econ"))
_part_hits("f14_traits_negated", f"NOT {_TRAITS}", P("traits", ":", "Econ", negate=True))
_part_hits("f13_has_dual_part", "dual", P("has:dual"))
_part_hits("f13_has_no_dual", "NOT dual", P("has:dual", negate=True))
_part_hits("f13_has_effect", "dp % 7 = 0 OR dual AND dp % 5 = 0", P("has:effect"))
_part_hits("f13_has_no_effect", "NOT (dp % 7 = 0 OR dual AND dp % 5 = 0)", P("has:effect", negate=True))
_part_hits("f13_has_parallel", "card_id % 3 > 0", P("has:parallel"))
_part_hits("f13_has_no_parallel", "card_id % 3 = 0", P("has:parallel", negate=True))
_part_hits("f13_has_form_attribute", "dp % 2 = 0 AND dp % 3 <> 0", P("has:form"), P("has:attribute", negate=True))
_part_hits("f13_has_use_cost", "use_cost IS NOT NULL OR d_use IS NOT NULL", P("has:use_cost"))
_part_hits("f13_has_dp_type", "true", P("has:dp"), P("has:type"))
_part_hits("f13_has_dual", "dual AND play_cost IS NULL AND d_play IS NULL OR NOT dual AND play_cost IS NULL", P("has:play_cost", negate=True))


@register("f12_release", """SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE contains(lower(o_orderpriority), 'urgent'))""")
def _(spark, d):
    bridge = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("o_orderkey"))
    return S.with_release(_t(spark, d, "part"), bridge, _t(spark, d, "orders"), P("release", ":", "Urgent"), "p_partkey", "o_orderkey", "o_orderpriority").select("p_partkey")


@register("f13_restricted", """SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def _(spark, d):
    limits = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "O", "restrict").when(F.col("o_orderstatus") == "P", "unrestrict").alias("type"))
    return S.restricted(_t(spark, d, "customer"), limits, "c_custkey").select("c_custkey")


@register("f13_banned", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('P', 'F'))""")
def _(spark, d):
    limits = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "P", "ban").when(F.col("o_orderstatus") == "F", "banned-pair").otherwise("restrict").alias("type"))
    return S.has(_t(spark, d, "customer"), limits, "c_custkey", F.col("type").isin("ban", "banned-pair"), negate=True).select("c_custkey")


@register("f18_image_language", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 OR lang = 'en'")
def _(spark, d):
    image = F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.lit("en")).alias("language"))
    return S.image_in_language(_t(spark, d, "documents").select("doc_id", F.col("lang").alias("language"), image.alias("image"))).select("doc_id")


@register("f19_exists_in", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return S.exists_in(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id").select("doc_id")


@register("f20_override", "SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#2') THEN 6 ELSE p_size END AS p_size FROM part")
def _(spark, d):
    return S.override_where(_t(spark, d, "part"), "p_size", "p_brand", ["Brand#1", "Brand#2"], 6).select("p_partkey", "p_size")


@register("j14_none_match", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def _(spark, d):
    orders = _t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return S.none_match(_t(spark, d, "customer"), orders, "c_custkey", F.col("o_totalprice") > 200000).select("c_custkey")


_RANK = "CASE language WHEN 'ja' THEN 0 WHEN 'en' THEN 1 WHEN 'zh-Hans' THEN 2 WHEN 'ko' THEN 3 ELSE 4 END"
_KEY = f"{_RANK}, coalesce(nullif(regexp_extract(number, '^([A-Za-z]+)', 1), ''), 'XXX'), coalesce(try_cast(regexp_extract(number, '^[A-Za-z]+([0-9]+)', 1) AS BIGINT), 9223372036854775807), coalesce(try_cast(regexp_extract(number, '([0-9]+)$', 1) AS BIGINT), 9223372036854775807), parallel_id NULLS FIRST, doc_id"
_ALL = "SELECT doc_id, source AS number, lang AS language, text AS effect, doc_id % 5 AS parallel_id FROM documents"


@register("search_page", f"WITH c AS ({_ALL}) SELECT doc_id, number, parallel_id FROM c WHERE language = 'en' AND contains(lower(effect), 'the') ORDER BY {_KEY} LIMIT 60")
def _(spark, d):
    hits, _ = S.search(documents(spark, d), [P("effect", ":", "the")])
    return S.page(hits, S.catalog_order(tie=["doc_id"]), 1).select("doc_id", "number", "parallel_id")


@register("k1_catalog_order", f"WITH c AS ({_ALL}) SELECT doc_id, row_number() OVER (PARTITION BY number ORDER BY {_KEY}) AS place FROM c")
def _(spark, d):
    return place(documents(spark, d), ["number"], S.catalog_order(tie=["doc_id"]), "place").select("doc_id", "place")


@register("k2_page_3", f"WITH c AS ({_ALL}) SELECT doc_id FROM c ORDER BY {_KEY} LIMIT 60 OFFSET 120")
def _(spark, d):
    return S.page(documents(spark, d), S.catalog_order(tie=["doc_id"]), 3).select("doc_id")


@register("a8_page_info", "SELECT n AS total, ceil(n / 60.0)::BIGINT AS pages, 2::INTEGER AS previous, CASE WHEN 3 < ceil(n / 60.0) THEN 4 END::INTEGER AS next, 121::BIGINT AS first, least(180, n) AS last FROM (SELECT count(*) AS n FROM documents WHERE lang = 'en')")
def _(spark, d):
    return S.page_info(S.search(documents(spark, d), [])[0], 3)


@register("p5_code_parts", "SELECT c_custkey, coalesce(nullif(regexp_extract(c_name, '^([A-Za-z]+)', 1), ''), 'XXX') AS prefix, coalesce(try_cast(regexp_extract(c_name, '^[A-Za-z]+([0-9]+)', 1) AS BIGINT), 9223372036854775807) AS set_number, coalesce(try_cast(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT), 9223372036854775807) AS card_number FROM customer")
def _(spark, d):
    return _t(spark, d, "customer").select("c_custkey", code_parts(F.col("c_name")).alias("p")).select("c_custkey", "p.*")


@register("r1_rank", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 END::INTEGER AS rank FROM part")
def _(spark, d):
    return _t(spark, d, "part").select("p_partkey", rank_of(F.col("p_type"), ["ECONOMY", "SMALL", "MEDIUM"]).alias("rank"))
