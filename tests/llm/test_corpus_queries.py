"""Corpus queries against DuckDB or a brute-force restatement over whole tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from tessera.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_flac_reads_back_what_was_stored(spark, sf, documents):
    rows = queries.op3_flac(spark, sf).collect()
    assert len(rows) == len(documents)
    for r in rows:
        text = documents[r.doc_id].text.encode()
        payload = text + bytes(-len(text) % 64 or (0 if text else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])


def test_languages_of_held_out_documents(spark, sf, documents):
    rows = queries.op5_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in documents if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_token_counts_are_the_library_s(spark, sf, documents):
    import public_tokenizers
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram
    from tokenizers.pre_tokenizers import Metaspace

    from tessera.llm.token_count import pieces_of

    library = Tokenizer(Unigram(pieces_of(public_tokenizers.path("piece_bpe_32k.model")), 0, True))
    library.pre_tokenizer = Metaspace(replacement="▁", prepend_scheme="always", split=True)
    for r in queries.op6_token_counts(spark, sf).collect():
        assert r.n_tokens == len(library.encode(documents[r.doc_id].text, add_special_tokens=False).ids)


def test_token_store_holds_the_library_s_ids(spark, sf, documents):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows, start = {r.doc_id: r for r in queries.op7_token_store(spark, sf).collect()}, 0
    for d in sorted(documents):
        ids = library.encode(documents[d].text, add_special_tokens=False).ids + [1]
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_mix_comes_near_its_targets(spark, sf, documents):
    rows = queries.op9_mixing(spark, sf).collect()
    sources = defaultdict(list)
    for r in rows:
        assert r["size"] == len(WORD.findall(documents[r.doc_id].text)) and 0 <= r.taken <= 2 * r["size"]
        sources[documents[r.doc_id].source].append(r)
    sizes = {s: sum(r["size"] for r in own) for s, own in sources.items()}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sources))}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:  # the excess over a cap is shared again until none is above
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in sources if s not in capped)
        above = {s for s in sources if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not above:
            break
        capped |= above
    for s, own in sources.items():
        target = 2 * sizes[s] if s in capped else level * weight[s]
        assert own[0].target == pytest.approx(target) and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - target) <= max(r["size"] for r in own)
    again = queries.op9_mixing(spark, sf).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_leaks_are_the_documents_with_an_item(spark, sf, documents):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    exact = {(d, i) for d, r in documents.items() for i, text in items.items() if text in r.text}
    found = {(r.doc_id, r.item_id) for r in queries.op10_decontamination(spark, sf).collect()}
    assert exact <= found and len(found) <= len(exact) + 2


def test_pipeline_runs_and_drops_what_it_should(spark, sf, documents):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        seen.append((name, docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(c == columns for _, c, _ in seen[:-1])
    assert seen[0][2] == set(documents)  # every text has letters
    assert seen[1][2] < seen[0][2] and seen[4][2] == seen[3][2]
