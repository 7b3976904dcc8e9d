"""Queries: text, parsing, dates, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T

from .registry import register

c = F.col


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


_BLANK = "[ \\t\\x{00a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]+"


@register("p1_normalize_text", rf"""WITH s AS (SELECT doc_id, source, regexp_replace(translate(text, '１Ｘ＋：＆！’，　', '1X+:&!'', '), '{_BLANK}', ' ', 'g') AS t, text FROM documents)
SELECT doc_id, CASE WHEN text NOT IN ('', '  ', '、', 'ー', '－', '―', '-') THEN regexp_replace(regexp_replace(CASE WHEN contains(t, '（') OR contains(t, '）') THEN translate(t, '()', '（）') ELSE t END, '\s+([」】\]］”])', '\1', 'g'), '\s+\.', '.', 'g') END AS text FROM s""")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.normalize_text(c("text")).alias("text"))


@register("p2_apply_fixes", r"SELECT doc_id, regexp_replace(replace(regexp_replace(text, '(?i)once per turn', 'Once Per Turn', 'g'), 'the', 'The'), '\.+', '.', 'g') AS text FROM documents")
def _(spark, d):
    rules = [("regex", "(?i)once per turn", "Once Per Turn"), ("literal", "the", "The"), ("regex", r"\.+", ".")]
    return _t(spark, d, "documents").select("doc_id", T.apply_fixes(c("text"), rules).alias("text"))


@register("p3_repair_markup", r"SELECT page_id, regexp_replace(html, '<((?:article|footer)[^<>＞]*)[>＞]', '&lt;\1&gt;', 'g') AS html FROM pages")
def _(spark, d):
    return _t(spark, d, "pages").select("page_id", T.repair_markup(c("html"), ["article", "footer"]).alias("html"))


@register("p4_codes", r"SELECT p_partkey, regexp_replace(regexp_replace(trim('BT' || p_size || '-' || p_partkey || '_P' || (p_size % 3) || ' x y'), '\s.*$', ''), '_P[0-9]+$', '') AS clean, nullif(regexp_extract(p_name || ' BT' || p_size || '-07 z', '[A-Z|0-9]+-[0-9]+'), '') AS found FROM part")
def _(spark, d):
    s = lambda *x: F.concat(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    n = lambda name: c(name).cast("string")
    code = s("BT", n("p_size"), "-", n("p_partkey"), "_P", (c("p_size") % 3).cast("string"), " x y")
    return _t(spark, d, "part").select("p_partkey", T.clean_code(code).alias("clean"), T.find_code(s(c("p_name"), " BT", n("p_size"), "-07 z")).alias("found"))


@register("p6_map_label", "SELECT event_id, CASE event_type WHEN 'click' THEN 'tamer' WHEN 'view' THEN 'option' END AS main, CASE WHEN event_id % 2 = 0 THEN CASE event_type WHEN 'click' THEN 'tamer' WHEN 'view' THEN 'option' END END AS dual FROM events")
def _(spark, d):
    labels = {"click": "tamer", "view": "option"}
    label = F.when(c("event_id") % 2 == 0, F.concat_ws("/", "event_type", "event_type")).otherwise(c("event_type"))
    return _t(spark, d, "events").select("event_id", T.map_label(label, labels).alias("main"), T.map_label(label, labels, "dual").alias("dual"))


@register("p7_numbers", "SELECT o_orderkey, try_cast(regexp_extract(o_orderpriority, '([0-9]+)', 1) AS BIGINT) AS first, o_orderkey % 7 AS level, o_custkey AS cost FROM orders")
def _(spark, d):
    text = F.concat(F.lit("Lv."), (c("o_orderkey") % 7).cast("string"), F.lit(" from "), c("o_custkey").cast("string"))
    return _t(spark, d, "orders").select("o_orderkey", T.first_int(c("o_orderpriority")).alias("first"), T.level_cost(text).alias("x")).select("o_orderkey", "first", "x.*")


@register("p8_p9_columns", """SELECT p_partkey, CASE WHEN p_type <> 'PROMO' THEN v END AS play_cost, CASE WHEN p_type = 'PROMO' THEN v END AS use_cost, CASE WHEN p_brand = 'Brand#1' THEN p_brand ELSE p_type END AS a, CASE WHEN p_brand = 'Brand#1' THEN p_type ELSE p_brand END AS b
FROM (SELECT *, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, CASE WHEN p_size < 20 THEN 0 END)::BIGINT AS v FROM part)""")
def _(spark, d):
    cost = F.when(c("p_size") % 2 == 0, c("p_size").cast("long"))
    part = _t(spark, d, "part")
    return part.select("p_partkey", T.cost_columns(c("p_type"), cost, ["PROMO"], c("p_size") < 20).alias("x"), T.swapped(c("p_type"), c("p_brand"), ["Brand#1"]).alias("y")).select("p_partkey", "x.*", "y.*")


@register("p10_route_text", """WITH s AS (SELECT *, coalesce(starts_with(text, CASE lang WHEN 'en' THEN 'Th' WHEN 'de' THEN 'E' WHEN 'fr' THEN 'L' END), false) AS s FROM documents) SELECT doc_id, CASE WHEN s THEN text END AS security_effect, CASE WHEN NOT s THEN text END AS inherited_effect FROM s""")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.route_text(c("text"), c("lang"), {"en": "Th", "de": "E", "fr": "L"}).alias("x")).select("doc_id", "x.*")


@register("p11_expand_colors", "SELECT p_partkey, i - 1 AS index, color FROM (SELECT p_partkey, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS color FROM (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN ['RED', 'BLUE', 'GREEN', 'SMALL'] ELSE [p_type, 'SMALL'] END AS l FROM part))")
def _(spark, d):
    colors = F.array(F.when(c("p_type") == "PROMO", " all ").otherwise(c("p_type")), F.lit("SM ALL"))
    return _t(spark, d, "part").select("p_partkey", F.posexplode(T.expand_colors(colors, ["RED", "BLUE", "GREEN"])).alias("index", "color"))


@register("p12_parse_requirement", """SELECT p_partkey, p_size % 9 AS cost, CASE WHEN p_size % 2 = 0 THEN p_size % 7 END AS level, CASE WHEN p_size > 30 THEN 'Super' END AS form, CASE WHEN p_size % 3 = 0 THEN 'Red,Blue' ELSE 'Blue' END AS colors FROM part""")
def _(spark, d):
    s = F.concat(F.when(c("p_size") % 3 == 0, "Red or Blue ").otherwise("Blue "), F.when(c("p_size") % 2 == 0, F.concat(F.lit("Lv."), (c("p_size") % 7).cast("string"))).otherwise(""), F.when(c("p_size") > 30, " Super").otherwise(""), F.lit(": Cost "), (c("p_size") % 9).cast("string"))
    x = T.parse_requirement(s, ["Super", "Ultimate"], ["Red", "Blue", "Green"])
    return _t(spark, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", "x.cost", "x.level", "x.form", F.array_join("x.colors", ",").alias("colors"))


@register("p13_variant_id", "SELECT page_id, CASE WHEN page_id % 4 = 3 THEN NULL WHEN page_id % 4 = 2 THEN 0 ELSE page_id % 10 END AS variant FROM pages")
def _(spark, d):
    name = F.concat(F.lit("/img/BT1-001"), F.when(c("page_id") % 4 < 2, F.concat(F.lit("_P"), (c("page_id") % 10).cast("string"))).otherwise(""), F.lit(".png"))
    return _t(spark, d, "pages").select("page_id", T.variant_id(name, c("page_id") % 4 == 3).alias("variant"))


@register("p14_normalize_release", "SELECT p_partkey, upper(p_name) || ' [BT-' || CASE WHEN p_size < 10 THEN '0' ELSE '' END || p_size || ']' AS name FROM part")
def _(spark, d):
    raw = F.concat(F.lit("  "), F.regexp_replace(F.upper("p_name"), " ", "   "), F.lit(" [BT"), F.when(c("p_size") % 2 == 0, "-").otherwise(""), c("p_size").cast("string"), F.lit("] "))
    return _t(spark, d, "part").select("p_partkey", T.normalize_release(raw).alias("name"))


@register("p15_bracket_refs", r"SELECT p_partkey, unnest(['BT-' || p_size, 'EX' || (p_size % 9)]) AS ref FROM part")
def _(spark, d):
    raw = F.concat(F.lit("see [BT-"), c("p_size").cast("string"), F.lit("] and [EX"), (c("p_size") % 9).cast("string"), F.lit("], not [x1]"))
    return _t(spark, d, "part").select("p_partkey", F.explode(T.bracket_refs(raw)).alias("ref"))


@register("p16_p17_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS en, strftime(o_orderdate, '%Y-%m-%d') AS ja, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month FROM orders")
def _(spark, d):
    day = F.dayofmonth("o_orderdate").cast("string")
    en = F.concat(F.date_format("o_orderdate", "MMMM "), day, F.lit("th, "), F.date_format("o_orderdate", "yyyy"))
    parse = lambda x, lang: T.iso_date(T.parse_date(x, lang))
    return _t(spark, d, "orders").select("o_orderkey", parse(en, "en").alias("en"), parse(F.date_format("o_orderdate", "yyyy年M月d日"), "ja").alias("ja"), parse(F.date_format("o_orderdate", "MMMM yyyy"), "en").alias("month"))


@register("p18_rewrite_uri", r"""SELECT page_id, CASE WHEN starts_with(u, 'http://') THEN 'https://' || substr(u, 8) ELSE u END AS uri FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)""")
def _(spark, d):
    return _t(spark, d, "pages").select("page_id", T.rewrite_uri(c("url"), "https://example.com", {"http://": "https://"}).alias("uri"))


@register("p19_slugify", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'bt-' || p_size || '-v1.' || (p_size % 5) ELSE replace(p_name, ' ', '-') || '-e' END AS slug FROM part")
def _(spark, d):
    name = F.when(c("p_size") % 2 == 0, F.concat(c("p_name"), F.lit(" [BT-"), c("p_size").cast("string"), F.lit("] Ver.1."), (c("p_size") % 5).cast("string"))).otherwise(F.concat(c("p_name"), F.lit(" É!")))
    return _t(spark, d, "part").select("p_partkey", T.slugify(name).alias("slug"))


@register("p19_transliterate", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'dejimon-' WHEN 1 THEN 'busutapakku-' WHEN 2 THEN 'dijimon-' ELSE 'shatchi-' END || p_size AS slug FROM part""")
def _(spark, d):
    name = F.when(c("p_size") % 4 == 0, "デジモン ").when(c("p_size") % 4 == 1, "ブースターパック ").when(c("p_size") % 4 == 2, "디지몬 ").otherwise("シャッチー ")
    return _t(spark, d, "part").select("p_partkey", T.slugify(F.concat(name, c("p_size").cast("string"))).alias("slug"))


@register("p20_p24_json", """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS document, sha1('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}') AS fingerprint FROM customer""")
def _(spark, d):
    row = F.struct("c_custkey", "c_mktsegment", F.lit(None).cast("string").alias("none"))
    return _t(spark, d, "customer").select("c_custkey", T.compact_json(row).alias("document"), T.fingerprint(c("c_custkey"), c("c_mktsegment")).alias("fingerprint"))


@register("p23_clean_notes", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(translate(x, '[]', '［］'), '^\s*[▼※■]\s*', ''))), lambda x: x <> ''), chr(10)) AS notes FROM documents")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.clean_notes(F.split("text", "\n")).alias("notes"))


@register("p25_split_markers", """WITH a AS (SELECT doc_id, text AS t1, instr(text, 'with ') AS i1 FROM documents), b AS (SELECT *, CASE WHEN i1 > 0 THEN substr(t1, 1, i1 - 1) ELSE t1 END AS t2 FROM a), c AS (SELECT *, instr(t2, 'than ') AS i2 FROM b),
d AS (SELECT *, CASE WHEN i2 > 0 THEN substr(t2, 1, i2 - 1) ELSE t2 END AS t3 FROM c), e AS (SELECT *, instr(t3, 'this ') AS i3 FROM d),
m AS (SELECT doc_id, 3 AS k, 'this ' AS marker, substr(t3, i3) AS tail FROM e WHERE i3 > 0 UNION ALL SELECT doc_id, 2, 'than ', substr(t2, i2) FROM e WHERE i2 > 0 UNION ALL SELECT doc_id, 1, 'with ', substr(t1, i1) FROM e WHERE i1 > 0),
w AS (SELECT *, regexp_extract_all(tail, '([a-z]+tion)(?:[^a-zA-Z0-9_]|$)', 1) AS l FROM m)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) - 1 AS index, marker, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS values FROM w""")
def _(spark, d):
    rows = T.split_markers(c("text"), ["with ", "than ", "this "], rf"([a-z]+tion){T.WORD_END}")
    return _t(spark, d, "documents").select("doc_id", F.posexplode(rows).alias("index", "x")).select("doc_id", "index", "x.marker", F.array_join("x.values", ",").alias("values"))


@register("p26_extract_tokens", """SELECT page_id, i - 1 AS index, t AS text, kind FROM (SELECT page_id, unnest(range(1, 5)) AS i, unnest(['<Draw ' || page_id || '>', '[Your Turn]', '{Hand}', '[When ' || page_id || ']']) AS t, unnest(['keyword-effect', 'timing', 'precondition', NULL]) AS kind FROM pages WHERE page_id % 2 = 0)
UNION ALL SELECT page_id, i - 1, t, kind FROM (SELECT page_id, unnest(range(1, 4)) AS i, unnest(['【登場時】', '≪ドロー' || page_id || '≫', '〈ルール〉']) AS t, unnest(['timing', 'keyword-effect', 'rule']) AS kind FROM pages WHERE page_id % 2 = 1)""")
def _(spark, d):
    n = c("page_id").cast("string")
    text = F.when(c("page_id") % 2 == 0, F.concat(F.lit("<Draw "), n, F.lit("> [Your Turn] x {Hand} “Whole.” [When "), n, F.lit("]"))).otherwise(F.concat(F.lit("【登場時】≪ドロー"), n, F.lit("≫〈ルール〉「文。」")))
    language = F.when(c("page_id") % 2 == 0, "en").otherwise("ja")
    rows = T.extract_tokens(text, language)
    return _t(spark, d, "pages").select("page_id", F.explode(rows).alias("x")).select("page_id", c("x.index").cast("long").alias("index"), "x.text", "x.kind")
