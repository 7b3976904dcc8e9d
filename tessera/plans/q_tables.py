"""Queries: joins, aggregates, windows, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.hashing import hash_bands, vector_signature
from tessera.operators import aggregates as A
from tessera.operators import joins as J
from tessera.operators import search as S
from tessera.operators.places import spread
from tessera.sources.shared import written

from .registry import register

c = F.col


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d, *more):
    return _t(spark, d, "documents").select("doc_id", c("source").alias("number"), c("lang").alias("language"), *more)


@register("j1_cards_of_release", "SELECT p_partkey, o_orderkey, l_linenumber FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def _(spark, d):
    bridge = _t(spark, d, "lineitem").select(c("l_partkey").alias("p_partkey"), c("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return J.cards_of_release(_t(spark, d, "part"), bridge, _t(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), "p_partkey", "o_orderkey").select("p_partkey", "o_orderkey", "l_linenumber")


@register("j2_lookup_fallback", """WITH t AS (SELECT source AS number, lang AS language, max(n_chars) AS v FROM documents GROUP BY ALL)
SELECT d.doc_id, coalesce(a.v, b.v) AS v FROM documents d LEFT JOIN (SELECT * FROM t WHERE language <> 'fr') a ON a.number = d.source AND a.language = d.lang LEFT JOIN t b ON b.number = d.source AND b.language = 'en'""")
def _(spark, d):
    table = docs(spark, d, "n_chars").groupBy("number", "language").agg(F.max("n_chars").alias("v")).where("language <> 'fr'")
    return J.lookup(docs(spark, d), table, ["number", "language"], ("language", "en")).select("doc_id", "v")


@register("j3_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    nation = _t(spark, d, "nation").select(c("n_nationkey").alias("c_nationkey"), "n_name")
    return J.lookup(_t(spark, d, "customer"), nation, ["c_nationkey"]).select("c_custkey", "n_name")


@register("j4_fill_canonical", """WITH r AS (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN n_chars END AS n FROM documents), k AS (SELECT source, n AS kn, length(text) AS kl FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM r WHERE lang = 'en') WHERE r = 1)
SELECT doc_id, coalesce(n, kn) AS n_chars, coalesce(kl, length(text)) AS n_text FROM r LEFT JOIN k USING (source)""")
def _(spark, d):
    rows = docs(spark, d, F.when(c("doc_id") % 3 != 0, c("n_chars")).alias("n_chars"), F.length("text").cast("long").alias("n_text"))
    return J.fill_from_canonical(rows, "number", c("language") == "en", [c("doc_id")], ["n_chars"], ["n_text"]).select("doc_id", "n_chars", "n_text")


@register("j5_siblings", """SELECT a.doc_id, coalesce(list(b.doc_id ORDER BY b.doc_id) FILTER (b.doc_id IS NOT NULL), []) AS siblings
FROM documents a LEFT JOIN documents b ON a.source = b.source AND a.lang = b.lang AND a.doc_id <> b.doc_id AND a.n_chars = b.n_chars GROUP BY a.doc_id""")
def _(spark, d):
    return J.siblings(docs(spark, d, "n_chars"), ["number", "language", "n_chars"], "doc_id").select("doc_id", "siblings")


@register("j5_sibling_groups", """WITH g AS (SELECT source, lang, n_chars, min(doc_id) AS "group", count(*) AS n_members FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL GROUP BY ALL)
SELECT doc_id, "group", n_members FROM documents JOIN g USING (source, lang, n_chars)""")
def _(spark, d):
    groups, members = J.sibling_groups(docs(spark, d, "n_chars"), ["number", "language", "n_chars"], "doc_id")
    return members.join(groups.select("group", "n_members"), "group").select("doc_id", "group", "n_members")


@register("j6_apply_patches", """SELECT p_partkey, CASE WHEN p_size % 10 = 1 THEN 'patched' WHEN p_size % 10 = 2 THEN replace(p_name, 'e', 'E') ELSE p_name END AS p_name, CASE WHEN p_size % 10 = 3 THEN 99 ELSE p_size END AS p_size FROM part""")
def _(spark, d):
    part = _t(spark, d, "part")
    keys = part.select("p_partkey", (c("p_size") % 10).alias("m"))
    row = lambda m, field, op, old, new: keys.where(c("m") == m).select("p_partkey", F.lit(field).alias("field"), F.lit(op).alias("op"), F.lit(old).cast("string").alias("old"), F.lit(new).alias("new"))
    patches = row(1, "p_name", "set", None, "patched").union(row(2, "p_name", "replace", "e", "E")).union(row(3, "p_size", "set", None, "99"))
    return J.apply_patches(part, patches, ["p_partkey"], ["p_name", "p_size"]).select("p_partkey", "p_name", "p_size")


@register("j7_type_tokens", """WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part),
t AS (SELECT token, min(CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 2 END) AS r FROM w JOIN part USING (p_partkey) WHERE p_size < 30 GROUP BY token)
SELECT p_partkey, token, CASE r WHEN 1 THEN 'form' WHEN 2 THEN 'attribute' ELSE 'type' END AS type FROM w LEFT JOIN t USING (token)""")
def _(spark, d):
    words = _t(spark, d, "part").select("p_partkey", "p_size", F.explode(F.split("p_name", " ")).alias("token"))
    table = words.select("token", F.when(c("p_size") < 10, "form").when(c("p_size") < 30, "attribute").alias("type"))
    return J.type_tokens(words.select("p_partkey", "token").distinct(), table, ["form", "attribute"], "type")


_PAGE = "SELECT page_id, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS q, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages"


@register("j9_match_products", f"""WITH p AS ({_PAGE}), a AS (SELECT page_id AS a_id, q FROM p WHERE page_id % 2 = 0), b AS (SELECT page_id AS b_id, q, host FROM p WHERE page_id % 2 = 1),
m AS (SELECT a_id, b_id, row_number() OVER (PARTITION BY a_id ORDER BY starts_with(host, 'm.') DESC NULLS LAST, b_id DESC) AS n FROM a LEFT JOIN b ON a.q = b.q)
SELECT a_id, b_id FROM m WHERE n = 1 UNION ALL SELECT NULL, b_id FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.q = b.q)""")
def _(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("")).alias("q"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))
    a = p.where("page_id % 2 = 0").select(c("page_id").alias("a_id"), c("q").alias("a_q"))
    b = p.where("page_id % 2 = 1").select(c("page_id").alias("b_id"), c("q").alias("b_q"), "host")
    return J.match_products(a, b, c("a_q"), c("b_q"), c("host").startswith("m."), "a_id", "b_id").select("a_id", "b_id")


@register("j9_match_by_suffix", """SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM part a JOIN (SELECT DISTINCT regexp_extract(p_name, '[a-z]+$') AS p_name FROM part) b ON length(b.p_name) >= 4 AND length(a.p_name) >= 4 AND (ends_with(a.p_name, b.p_name) OR ends_with(b.p_name, a.p_name))""")
def _(spark, d):
    part = _t(spark, d, "part")
    a, b = part.select(c("p_name").alias("a")).distinct(), part.select(F.regexp_extract("p_name", "[a-z]+$", 0).alias("b")).distinct()
    return J.match_by_suffix(a, b, "a", "b", 4).select("a", "b").distinct()


@register("j9_match_by_containment", """WITH a AS (SELECT DISTINCT p_name AS a FROM part), b AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS b FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT p_name || ' ' || p_size FROM part)
SELECT a, b FROM a, b WHERE a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a))""")
def _(spark, d):
    part = _t(spark, d, "part")
    a = part.select(c("p_name").alias("a")).distinct()
    b = part.select(F.explode(F.split("p_name", " ")).alias("b")).union(part.select("p_type")).union(part.select(F.concat_ws(" ", "p_name", c("p_size").cast("string")))).distinct()
    return J.match_by_containment(a, b, "a", "b").select("a", "b")


@register("j9_first_containing", """WITH r AS (SELECT o_orderkey AS release_id, o_orderpriority || ' ' || o_orderstatus AS release_name, o_orderdate AS date FROM orders WHERE o_orderkey % 100 = 0),
p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'none' WHEN p_size % 3 = 1 THEN p_size % 5 + 1 || '-' ELSE 'Pack 1-URGENT O ' || p_size END AS name FROM part)
SELECT p_partkey, name, arg_min(release_id, (date, release_id)) AS release_id FROM p LEFT JOIN r ON contains(name, release_name) OR contains(release_name, name) GROUP BY ALL""")
def _(spark, d):
    # every hundredth order stands for a release: an order that begins one
    releases = _t(spark, d, "orders").where("o_orderkey % 100 = 0").select(c("o_orderkey").alias("release_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("release_name"), c("o_orderdate").alias("date"))
    name = F.when(c("p_size") % 3 == 0, "none").when(c("p_size") % 3 == 1, F.concat((c("p_size") % 5 + 1).cast("string"), F.lit("-"))).otherwise(F.concat(F.lit("Pack 1-URGENT O "), c("p_size").cast("string")))
    products = _t(spark, d, "part").select("p_partkey", name.alias("name"))
    first = releases.withColumn("place", F.struct("date", "release_id"))
    return J.first_containing(products, first, "name", "release_name", "p_partkey", "place").select("p_partkey", "name", "release_id")


@register("p22_vector_signature", """WITH v AS (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64 AS m FROM embeddings)
SELECT vec_id, list_transform(range(0, 64, 8), lambda k: list_sum(list_transform(range(1, 9), lambda i: CASE WHEN embedding[k + i]::DOUBLE > m THEN (1 << (8 - i)) ELSE 0 END))::INTEGER) AS bands FROM v""")
def _(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", hash_bands(vector_signature(c("embedding"))).alias("bands"))


def hashes(spark, d, bits=None):
    """Embeddings as hashes; `bits` masks some, so that near ones are there."""
    h = vector_signature(c("embedding"))
    return _t(spark, d, "embeddings").select(c("vec_id").alias("id"), h.alias("hash"), "label")


_H = """h AS (SELECT vec_id AS id, label, list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE > list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64) AS b FROM embeddings),
p AS (SELECT q.id AS id, r.id AS match, q.label AS ql, r.label AS rl, list_sum(list_transform(range(1, 65), lambda i: (q.b[i] <> r.b[i])::INTEGER))::INTEGER AS distance,
  list_bool_or(list_transform(range(0, 64, 8), lambda k: q.b[k+1:k+8] = r.b[k+1:k+8])) AS band FROM h q, h r WHERE q.id % 100 = 0 AND r.id <> q.id)"""


@register("j10_refs_to_release", """WITH r AS (SELECT p_name AS name, 'BT' || min(p_partkey) % 50 AS code, DATE '2024-01-01' + (min(p_partkey) % 30)::INTEGER AS date, min(p_partkey) % 5 <> 0 AS listed FROM part GROUP BY p_name),
a AS (SELECT p_partkey, string_agg(name, ';' ORDER BY date, name) AS names FROM part JOIN r ON p_size % 4 = 0 AND code = 'BT' || p_size GROUP BY 1),
b AS (SELECT p_partkey, string_agg(name, ';' ORDER BY date, name) AS names FROM part JOIN r ON p_size % 4 = 1 AND listed AND starts_with(name, string_split(p_name, ' ')[1]) GROUP BY 1)
SELECT p_partkey, coalesce(a.names, b.names, p_brand) AS releases FROM part LEFT JOIN a USING (p_partkey) LEFT JOIN b USING (p_partkey)""")
def _(spark, d):
    part = _t(spark, d, "part")
    first = part.groupBy(c("p_name").alias("name")).agg(F.min("p_partkey").alias("k"))
    release = first.select(F.concat(F.lit("BT"), (c("k") % 50).cast("string")).alias("code"), "name", F.date_add(F.to_date(F.lit("2024-01-01")), (c("k") % 30).cast("int")).alias("date"), (c("k") % 5 != 0).alias("listed"))
    word = F.upper(F.element_at(F.split("p_name", " "), 1))
    notes = F.when(c("p_size") % 4 == 0, F.concat(F.lit("Pack [BT-0"), c("p_size").cast("string"), F.lit("], [x]"))).when(c("p_size") % 4 == 1, word).when(c("p_size") % 4 == 2, "Limited Card Pack")
    out = J.refs_to_release(part.select("p_partkey", c("p_brand").alias("release"), notes.alias("notes")), release, "p_partkey")
    return out.select("p_partkey", F.array_join("releases", ";").alias("releases"))


@register("j11_nearest_hash", f"WITH {_H} SELECT id, arg_min(match, distance * 1000000 + match) AS match, min(distance) AS distance FROM p WHERE ql = rl AND distance <= 24 GROUP BY id")
def _(spark, d):
    h = hashes(spark, d)
    return J.nearest_hash(h.where("id % 100 = 0"), h, ["label"], 24, own=False)


#: The bits of a hash that the query below keeps, so that near ones are there: every fourth.
_KEPT = 0x1111111111111111


@register("j11_nearest_within_11", """WITH h AS (SELECT vec_id AS id, label, list_transform(range(1, 65), lambda i: i % 4 = 0 AND embedding[i]::DOUBLE > list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64) AS b FROM embeddings),
p AS (SELECT q.id AS id, r.id AS match, list_sum(list_transform(range(1, 65), lambda i: (q.b[i] <> r.b[i])::INTEGER))::INTEGER AS distance FROM h q, h r WHERE r.id <> q.id AND q.label = r.label)
SELECT id, arg_min(match, distance * 1000000 + match) AS match, min(distance) AS distance FROM p WHERE distance <= 11 GROUP BY id""")
def _(spark, d):
    # written, as each step of the search reads them
    h = written(hashes(spark, d).withColumn("hash", c("hash").bitwiseAND(F.lit(_KEPT))), "hashes")
    return J.nearest_hash(h, h, ["label"], 11, own=False)


@register("j12_band_join", f"WITH {_H} SELECT id, match, distance FROM p WHERE band AND distance <= 20")
def _(spark, d):
    h = hashes(spark, d)
    return J.band_join(h.where("id % 100 = 0"), h, 20).where("id <> match")


@register("a7_vote", f"""WITH {_H}, m AS (SELECT ql AS session, rl AS candidate, distance FROM p WHERE band AND distance <= 22),
s AS (SELECT session, candidate, avg(distance) / count(*) AS score, count(*) AS votes FROM m GROUP BY ALL)
SELECT session, score, candidate, votes FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score, candidate) AS n FROM s) WHERE n = 1""")
def _(spark, d):
    h = hashes(spark, d)
    near = J.band_join(h.where("id % 100 = 0"), h, 22).where("id <> match")
    near = near.join(h.select("id", c("label").alias("session")), "id").join(h.select(c("id").alias("match"), c("label").alias("candidate")), "match")
    return A.vote(near, ["session"], "candidate", "distance")


@register("j13_by_language", """WITH m AS (SELECT source AS number, lang, min(doc_id) AS v FROM documents GROUP BY ALL)
SELECT number, max(v) FILTER (lang = 'en') AS en, max(v) FILTER (lang = 'de') AS de FROM m GROUP BY number""")
def _(spark, d):
    rows = docs(spark, d)
    out = J.by_language(rows.select("number").distinct(), rows, ["number"], ["en", "de"], "doc_id")
    return out.select("number", F.try_element_at("by_language", F.lit("en")).alias("en"), F.try_element_at("by_language", F.lit("de")).alias("de"))


@register("a1_count_per", "SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    return A.count_per(_t(spark, d, "lineitem"), ["l_orderkey"], "l_partkey")


@register("a2_k5_latest_per_language", "SELECT o_orderstatus, max(o_orderdate) AS latest, count(*) AS releases FROM (SELECT DISTINCT o_orderstatus, o_orderdate, o_custkey FROM orders) GROUP BY o_orderstatus")
def _(spark, d):
    return A.latest_per_language(_t(spark, d, "orders"), "o_orderstatus", "o_orderdate", "o_custkey")


@register("a3_k3_group_rows", "SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS items FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    rows = A.group_rows(_t(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], ["l_partkey"])
    return rows.select("l_orderkey", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["l_linenumber"].cast("string"), r["l_partkey"].cast("string"))), ",").alias("items"))


@register("a4_u3_merge_duplicates", """WITH g AS (SELECT p_brand, list(DISTINCT p_name ORDER BY p_name) AS names, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand) SELECT p_brand, p_partkey, array_to_string(names, ',') AS names FROM g""")
def _(spark, d):
    rows = _t(spark, d, "part").select("p_brand", "p_partkey", c("p_type").alias("note"), F.array("p_name").alias("names"))
    return A.merge_duplicates(rows, "p_brand", "p_partkey", "note", "names").select("p_brand", "p_partkey", F.array_join("names", ",").alias("names"))


@register("a4_merge_notes", """WITH t AS (SELECT p_brand, p_type, min(p_partkey) AS first FROM part GROUP BY ALL) SELECT p_brand, string_agg(p_type, chr(10) ORDER BY first) AS note FROM t GROUP BY p_brand""")
def _(spark, d):
    rows = _t(spark, d, "part").select("p_brand", "p_partkey", c("p_type").alias("note"), F.array("p_name").alias("names"))
    return A.merge_duplicates(rows, "p_brand", "p_partkey", "note", "names").select("p_brand", "note")


@register("a5_most_common", "SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY p_brand, p_type) WHERE r = 1")
def _(spark, d):
    return A.most_common(_t(spark, d, "part"), ["p_brand"], "p_type")


@register("a6_last_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def _(spark, d):
    return A.last_per_key(_t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@register("a9_vocabulary", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part")
def _(spark, d):
    return A.vocabulary(_t(spark, d, "part"), "p_name", " ")


@register("n1_number_variants", """WITH RECURSIVE r AS (SELECT event_id, user_id, event_type, date_trunc('day', ts) AS day, CASE WHEN event_id % 3 = 0 THEN trunc(value)::BIGINT % 4 END AS own, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY event_id) AS n FROM events),
f AS (SELECT *, coalesce(own, 0)::BIGINT AS variant, [coalesce(own, 0)::BIGINT] AS ids FROM r WHERE n = 1
  UNION ALL SELECT event_id, user_id, event_type, day, own, n, variant, list_append(ids, variant) FROM (SELECT r.*, CASE WHEN r.own IS NULL OR r.own = f.variant OR r.event_type = 'view' AND list_contains(f.ids, r.own) THEN f.variant + 1 ELSE r.own END AS variant, f.ids FROM f JOIN r ON r.user_id = f.user_id AND r.event_type = f.event_type AND r.day = f.day AND r.n = f.n + 1))
SELECT event_id, variant FROM f""")
def _(spark, d):
    events = _t(spark, d, "events").select("user_id", "event_id", "event_type", F.when(c("event_id") % 3 == 0, (c("value").cast("long") % 4)).alias("own"))
    # variants of one (user, type, hour) as of one record
    hour = _t(spark, d, "events").select("event_id", F.date_trunc("day", "ts").alias("day"))
    return A.number_variants(events.join(hour, "event_id"), ["user_id", "event_type", "day"], ["event_id"], "own", c("event_type") == "view").select("event_id", "variant")


@register("n2_reindex", "SELECT doc_id, CASE WHEN source = 'src3' THEN doc_id ELSE row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 END AS index FROM documents")
def _(spark, d):
    rows = docs(spark, d, c("doc_id").alias("index"))
    return A.reindex(rows, ["number", "language"], ["doc_id"], rows.where("number = 'src3'").select("number", "language")).select("doc_id", "index")


@register("n3_group_suffix", "SELECT p_partkey, CASE WHEN bool_or(ends_with(p_name, 'ring')) OVER (PARTITION BY p_brand) AND NOT ends_with(p_name, 'ring') THEN p_name || ' ring' ELSE p_name END AS p_name FROM part")
def _(spark, d):
    return A.group_suffix(_t(spark, d, "part"), "p_brand", "p_name", "ring").select("p_partkey", "p_name")


@register("n4_fill_forward", "SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events")
def _(spark, d):
    rows = _t(spark, d, "events").withColumn("value", F.when(c("event_id") % 3 == 0, c("value")))
    return A.fill_forward(rows, "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value")


@register("n5_first_per_date", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) - 1 AS index FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def _(spark, d):
    return A.first_per_date(_t(spark, d, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"]).select("o_orderkey", "index")


@register("n6_learn_translations", """WITH w AS (SELECT doc_id, source AS grp, CASE WHEN doc_id % 2 = 0 THEN 'ja' ELSE 'en' END AS language, regexp_extract_all(text, '[^ \\n]+') AS ws FROM documents),
t AS (SELECT doc_id, grp, language, (doc_id // 40)::VARCHAR AS field, i - 1 AS index, ws[i] AS text, CASE WHEN language = 'ja' THEN CASE length(ws[i]) % 3 WHEN 0 THEN 'timing' WHEN 1 THEN 'precondition' ELSE 'mention' END END AS kind FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)),
g AS (SELECT DISTINCT grp, grp AS rank FROM t),
j AS (SELECT grp, field, index, arg_max(kind, text) AS ja FROM t WHERE language = 'ja' GROUP BY ALL),
l AS (SELECT t.text, g.rank, t.field, t.index, j.ja FROM t JOIN g USING (grp) JOIN j ON j.grp = t.grp AND j.field = t.field AND j.index = t.index WHERE t.language = 'en' AND j.ja IN ('timing', 'precondition')),
f AS (SELECT text, rank, ja FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rank, field, index, ja) AS n FROM l) WHERE n = 1)
SELECT t.doc_id, t.index, CASE WHEN t.language = 'en' THEN CASE WHEN t.text = 'The' THEN 'timing' WHEN f.rank <= g.rank THEN f.ja END END AS learned FROM t JOIN g USING (grp) LEFT JOIN f ON f.text = t.text""")
def _(spark, d):
    words = F.regexp_extract_all("text", F.lit(r"[^ \n]+"), 0)
    texts = _t(spark, d, "documents").select("doc_id", c("source").alias("group"), F.when(c("doc_id") % 2 == 0, "ja").otherwise("en").alias("language"), F.floor(c("doc_id") / 40).cast("string").alias("field"), "text")
    kind = F.element_at(F.array(F.lit("timing"), F.lit("precondition"), F.lit("mention")), F.length("text") % 3 + 1)
    cut = lambda df: df.select("doc_id", "group", "language", "field", F.posexplode(words).alias("index", "text")).withColumn("kind", F.when(c("language") == "ja", kind))
    rank = _t(spark, d, "documents").select(c("source").alias("group")).distinct().withColumn("rank", c("group"))
    seeds = spark.createDataFrame([("The", "timing")], "text string, kind string")
    dealt = cut(spread(texts, ["group", "field"], texts.agg(F.sum(F.size(words))).first()[0] or 0))
    return A.learn_translations(cut(texts), rank, seeds, lambda df: written(df, "known"), dealt).select("doc_id", "index", "learned")


@register("n7_sections", "SELECT conv_id, turn, sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS section FROM conversations")
def _(spark, d):
    return A.sections(_t(spark, d, "conversations"), c("role") == "user", ["turn"], ["conv_id"]).select("conv_id", "turn", "section")


@register("n8_pair_lists", """WITH q AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS index, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS index, text FROM conversations WHERE role = 'assistant')
SELECT coalesce(q.conv_id, a.conv_id) AS conv_id, coalesce(q.index, a.index) AS index, q.text AS question, a.text AS answer FROM q FULL JOIN a ON q.conv_id = a.conv_id AND q.index = a.index""")
def _(spark, d):
    return A.pair_lists(_t(spark, d, "conversations"), ["conv_id"], "turn", c("role") == "user", c("role") == "assistant", "text")


@register("n9_blank_repeats", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 THEN source END AS source FROM documents")
def _(spark, d):
    return A.blank_repeats(_t(spark, d, "documents"), "source", ["doc_id"]).select("doc_id", "source")


@register("n10_with_index", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS index FROM lineitem")
def _(spark, d):
    return A.with_index(_t(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "index")


@register("n11_adjacent_diff", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN n > 1 AND s IS DISTINCT FROM ps THEN 'o_orderstatus' END, CASE WHEN n > 1 AND p IS DISTINCT FROM pp THEN 'o_orderpriority' END], lambda x: x IS NOT NULL), ',') AS differs
FROM (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, lag(o_orderstatus) OVER w AS ps, lag(o_orderpriority) OVER w AS pp, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""")
def _(spark, d):
    return A.adjacent_diff(_t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", F.array_join("differs", ",").alias("differs"))


@register("k4_top1", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def _(spark, d):
    return A.top1(_t(spark, d, "lineitem"), ["l_orderkey"], ["l_extendedprice", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@register("k6_order_by_id", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey")
def _(spark, d):
    return A.order_by_id(_t(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")


@register("u1_union_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return A.union_merge([orders, orders.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X"))], "o_orderkey")


@register("u2_new_findings", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_linenumber > 3) > 0")
def _(spark, d):
    found = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("lines"))
    saved = found.withColumn("lines", F.filter("lines", lambda x: x <= 3))
    return A.new_findings(found, saved, ["l_orderkey"], "lines").select("l_orderkey")


@register("u3_union_arrays", """WITH w AS (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN string_split(p_name, ' ') END AS a, CASE WHEN p_size % 4 <> 0 THEN [p_type, string_split(p_name, ' ')[1], p_type] END AS b FROM part)
SELECT p_partkey, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') END AS members FROM w""")
def _(spark, d):
    words = F.split("p_name", " ")
    a, b = F.when(c("p_size") % 3 != 0, words), F.when(c("p_size") % 4 != 0, F.array("p_type", F.element_at(words, 1), "p_type"))
    return _t(spark, d, "part").select("p_partkey", F.array_join(A.union_arrays(a, b), ",").alias("members"))


@register("u4_append_unmatched", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 2 <> 0")
def _(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return A.append_unmatched(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("new")), ["o_orderkey"])


@register("u5_distinct_flat", "SELECT p_brand, array_to_string(list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))), ',') AS words FROM part GROUP BY p_brand")
def _(spark, d):
    rows = _t(spark, d, "part").groupBy("p_brand").agg(F.collect_set(F.split("p_name", " ")).alias("w"))
    return rows.select("p_brand", F.array_join(F.array_sort(A.distinct_flat(c("w"))), ",").alias("words"))


@register("u6_missing_members", """WITH r AS (SELECT DISTINCT p_brand, p_type, p_name FROM part) SELECT a.p_brand, a.p_type, b.p_name FROM (SELECT DISTINCT p_brand, p_type FROM r) a JOIN (SELECT DISTINCT p_brand, p_name FROM r) b USING (p_brand) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.p_brand = a.p_brand AND r.p_type = a.p_type AND r.p_name = b.p_name)""")
def _(spark, d):
    return A.missing_members(_t(spark, d, "part"), "p_brand", "p_type", "p_name")


@register("f13_has_any", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, d):
    return S.has(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id", c("toxic") == 1, negate=True).select("doc_id")
