"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from .collocations import collocations
from .common import new_path, table
from .decontaminate import find_leaks
from .flac import archive_media
from .language_id import identify
from .lexical import PATTERN, search_ranked
from .mixing import mix_sources
from .ngram_jaccard import jaccard_components
from .preference import format_preferences, neighbour_pairs
from .rule_ensemble import score_quality
from .substring_dedup import remove_repeats
from .token_count import count_tokens
from .token_store import read_store, write_store
from .warc import archive_pages


def op1_ngram_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op2_warc(spark, sf_dir):
    return archive_pages(table(spark, sf_dir, "pages"))


def op3_flac(spark, sf_dir):
    return archive_media(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), window=50, batches=5).drop("text")


def op5_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_token_store(spark, sf_dir):
    path = new_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_store(spark, path)


def op8_chat_preference(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return format_preferences(turns, neighbour_pairs(turns))


def op9_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"), weights=[3, 1, 2], share=1.5, most=2.0)


def op10_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ranked_search(spark, sf_dir):
    return search_ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+2], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 90 * (p.n + q.n - i)
), r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

OP4_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
x AS (
  SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS lo FROM x) WHERE lo < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM r),
k AS (
  SELECT t.doc_id, count(*) AS n_words, count(c.i) AS n_removed, coalesce(string_agg(t.word, ' ' ORDER BY t.i) FILTER (c.i IS NULL), '') AS kept
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) t LEFT JOIN c ON c.doc_id = t.doc_id AND c.i = t.i
  GROUP BY t.doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

OP8_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS i, role, text FROM conversations
  WHERE conv_id IS NOT NULL
), h AS (SELECT conv_id, row_number() OVER (ORDER BY role NULLS FIRST, text NULLS FIRST, conv_id) - 1 AS rank FROM t WHERE i = 1),
p AS (
  SELECT rank // 2 AS pair, max(conv_id) FILTER (rank % 2 = 0) AS chosen_id, max(conv_id) FILTER (rank % 2 = 1) AS rejected_id FROM h GROUP BY 1
), c AS (SELECT pair, i, role, text FROM p JOIN t ON conv_id = chosen_id), r AS (SELECT pair, i, role, text FROM p JOIN t ON conv_id = rejected_id),
m AS (
  SELECT pair, min(i) AS differ FROM (
    SELECT coalesce(c.pair, r.pair) AS pair, coalesce(c.i, r.i) AS i FROM c FULL JOIN r ON c.pair = r.pair AND c.i = r.i
    WHERE c.i IS NULL OR r.i IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text
  ) GROUP BY pair
), n AS (SELECT p.pair, p.chosen_id, p.rejected_id, coalesce(m.differ - 1, (SELECT count(*) FROM c WHERE c.pair = p.pair)) AS n_common FROM p LEFT JOIN m USING (pair)),
u AS (
  SELECT s.*, s.i > n.n_common AS later, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS shown,
    13 + length(coalesce(role, '')) AS lead
  FROM (SELECT 'chosen' AS side, * FROM c UNION ALL SELECT 'rejected', * FROM r) s JOIN n USING (pair)
), v AS (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair, side, later ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM u),
o AS (
  SELECT pair, coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'chosen' AND NOT later), '') AS prompt,
    coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'chosen' AND later), '') AS chosen,
    coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'rejected' AND later), '') AS rejected,
    coalesce(string_agg((pos + lead)::BIGINT || '-' || (pos + length(shown))::BIGINT, ',' ORDER BY i) FILTER (side = 'chosen' AND later AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg((pos + lead)::BIGINT || '-' || (pos + length(shown))::BIGINT, ',' ORDER BY i) FILTER (side = 'rejected' AND later AND role = 'assistant'), '') AS rejected_mask
  FROM v GROUP BY pair
)
SELECT chosen_id, rejected_id, n_common::INTEGER AS n_common, prompt, chosen, rejected, chosen_mask, rejected_mask FROM n JOIN o USING (pair)
"""

OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{PATTERN}') AS ts FROM documents
), n AS (SELECT id, doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
s AS (SELECT count(*) AS dn, sum(n)::BIGINT AS dl FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{PATTERN}')) AS term FROM benchmark),
t AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * dn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, dn),
m AS (SELECT id, doc_id, 10 + (90 * n * dn) // dl AS m FROM n, s),
r AS (
  SELECT item_id, id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (id) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10
"""

OP12_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), q AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
s AS (SELECT id, lang, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM q),
m AS (SELECT lang, x, lead(x) OVER z AS y, lead(x, 2) OVER z AS v FROM s WINDOW z AS (PARTITION BY id ORDER BY i)),
g AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, 1 AS size, x AS phrase FROM m UNION ALL SELECT lang, 2, x || ' ' || y FROM m WHERE y IS NOT NULL
    UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || v FROM m WHERE v IS NOT NULL
  ) GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE size > 1 AND f >= 10),
t AS (SELECT c.*, k, array_to_string(ws[:k], ' ') AS lp, array_to_string(ws[k+1:], ' ') AS rp FROM c, (VALUES (1), (2)) AS z(k) WHERE k < size),
u AS (
  SELECT t.lang, t.size, t.phrase, t.a, t.k, l.f AS l, r.f AS r, ((1000000::HUGEINT * t.a * t.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM t JOIN g l ON l.lang = t.lang AND l.phrase = t.lp JOIN g r ON r.lang = t.lang AND r.phrase = t.rp
), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE size = 3),
d AS (SELECT lang, phrase, max(a) AS most FROM x GROUP BY ALL),
o AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM b LEFT JOIN d ON d.lang = b.lang AND d.phrase = b.phrase WHERE coalesce(100 * d.most < 50 * a, true)
)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_warc": op2_warc,
    "op3_flac": op3_flac,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_token_store": op7_token_store,
    "op8_chat_preference": op8_chat_preference,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_ranked_search": op11_ranked_search,
    "op12_collocations": op12_collocations,
    "op13_quality_rules": op13_quality_rules,
}
ORACLE_SQL = {
    "op1_ngram_jaccard": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op8_chat_preference": OP8_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_collocations": OP12_SQL,
}
