"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and exactness on random input."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import decontaminate, flac, language_id, mixing, preference, queries, substring_dedup, token_count, token_store, warc
from tessera.llm.components import components
from tessera.llm.ngram_jaccard import _sets_of, jaccard_components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, token string, n long, size long, hash long"


def _docs(spark, rows):
    """Documents with columns whose names operators might use themselves."""
    return spark.createDataFrame([(d, t, l, s, "x", 1, 2, 3) for d, t, l, s in rows], SCHEMA)


@pytest.fixture
def odd(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return _docs(spark, [(1, None, "en", None), (2, "", None, "a"), (3, " \n\t", "en", "a"), (None, "one two three four", "de", "a"), (4, "Ünï 日本 😀", None, "b"), (5, long, "en", "b"), (6, long, "en", "b"), (6, long, "en", "b"), (7, "x", "de", "")])


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _random_texts(seed, words=400):
    r = random.Random(seed)
    vocabulary, out = [f"w{i}" for i in range(words)], []
    for _ in range(40):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 8, 9, 10, 11, 13, 20, 30, 60, 120]))]
        for _ in range(r.randint(1, 9)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                i, kind = r.randrange(len(t)), r.random()
                if kind < 0.5:
                    t[i] = r.choice(vocabulary)
                elif kind < 0.75:
                    t.insert(i, r.choice(vocabulary))
                elif len(t) > 1:
                    t.pop(i)
            out.append("\t\n ".join(t) if r.random() < 0.9 else " ".join(t).upper())
    return [*out, None, "", " \n"]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components_are_exact(spark, k, percent):
    texts = _random_texts(5)
    sets = []
    for t in texts:
        w = (t or "").translate(FOLD).split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    rows = jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_jaccard_rows_repeated(spark):
    texts = [t for t in _random_texts(8) if t]
    once = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    several = once.union(once.where("doc_id % 3 = 0")).union(once.where("doc_id % 3 = 0")).repartition(7)
    pairs = spark.createDataFrame([(0, 3), (3, 6)], "a long, b long")
    assert sorted(r.node for r in _sets_of(several, 5, pairs).collect()) == [0, 3, 6]  # or each link is made once per pair of copies
    alone = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(once, 5, 80).collect()}
    rows = jaccard_components(several, 5, 80).collect()
    assert len(rows) == several.count() and all(alone[r.doc_id] == (r.n_shingles, r.component_id) for r in rows)


def test_jaccard_odd_rows(spark, odd, none):
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_components(odd).collect())
    assert rows[:4] == [(0, 2, None), (1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert [r[2] for r in rows if r[0] in (5, 6)] == [5, 5, 5]
    assert jaccard_components(none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_substring_dedup_random(spark):
    r = random.Random(9)
    passages = [[f"p{r.randint(0, 99)}" for _ in range(r.randint(20, 130))] for _ in range(12)]
    docs = {}
    for d in range(70):
        words = []
        for _ in range(r.randint(0, 5)):
            words += r.choice(passages) if r.random() < 0.6 else [f"q{r.randint(0, 10**6)}" for _ in range(r.randint(1, 80))]
        docs[d] = words
    first = {}
    for d in sorted(docs):
        for i in range(len(docs[d]) - 49):
            first.setdefault(tuple(docs[d][i : i + 50]), d)
    rows = substring_dedup.remove_repeats(spark.createDataFrame([(d, "  ".join(w)) for d, w in docs.items()], "doc_id long, text string"), batches=3).collect()
    for row in rows:
        words = docs[row.doc_id]
        keep = [True] * len(words)
        for i in range(len(words) - 49):
            if first[tuple(words[i : i + 50])] < row.doc_id:
                keep[i : i + 50] = [False] * 50
        kept = " ".join(w for w, k in zip(words, keep) if k)
        assert (row.text, row.n_words, row.n_removed, row.kept_sha256) == (kept, len(words), keep.count(False), hashlib.sha256(kept.encode()).hexdigest())
    assert len(rows) == 70


def test_substring_dedup_odd_rows(spark, odd, none):
    rows = sorted(((r.doc_id or 0), r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(odd).collect())
    assert rows == [(0, 4, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 3, 0), (5, 60_000, 0), (6, 60_000, 60_000), (6, 60_000, 60_000), (7, 1, 0)]
    assert substring_dedup.remove_repeats(none).count() == 0


def test_index_runs_are_merged(spark):
    index = substring_dedup.FingerprintIndex(spark, most_runs=2)
    batch = lambda rows: spark.createDataFrame(rows, "mark long, doc_id long")
    assert index.append(batch([(1, 1), (2, 1), (3, 1)])).count() == 0
    assert [r.mark for r in index.append(batch([(2, 2), (4, 2)])).collect()] == [2]
    assert sorted({r.mark for r in index.append(batch([(4, 3), (5, 3), (5, 4)])).collect()}) == [4, 5]
    assert len(index.runs) == 1 and index.read(index.runs[0]).count() == 5


def test_flac_round_trip_and_damage():
    r = random.Random(4)
    payloads = [bytes(64), b"a" * 64, r.randbytes(64 * 150), bytes(range(256)) * 40, b"plain words " * 2000, bytes([0, 255] * 5000)]
    payloads = [flac.payload_of(p) for p in payloads]
    streams = flac.encode(payloads)
    for payload, (read, blocks) in zip(payloads, flac.decode(streams)):
        assert read == payload and [b[0] for b in blocks] == list(range(0, len(payload), flac.BLOCK))
    for at in (len(streams[4]) // 2, len(streams[4]) - 1):
        broken = bytearray(streams[4])
        broken[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])


def test_flac_streams_tell_their_own_bytes(monkeypatch):
    payloads = [flac.payload_of(p) for p in (b"plain words " * 1000, bytes(range(256)) * 30)]
    before = flac.encode(payloads)
    monkeypatch.setattr(flac, "FREQUENT", b"zyx wv")
    monkeypatch.setattr(flac, "_SAMPLE", flac._tables(b"zyx wv")[0])
    after = flac.encode(payloads)
    assert before != after and [read for read, _ in flac.decode(before + after)] == payloads * 2
    assert flac.read_samples(before[0], 5000, 300) == flac.read_samples(after[0], 5000, 300) == payloads[0][5000:5300]


def test_flac_odd_rows(spark, odd, none):
    rows = flac.media_features(flac.encode_column(odd)).collect()
    assert len(rows) == 9 and {r.payload_bytes for r in rows if r.doc_id in (1, 2)} == {64}
    blocks = flac.pcm_blocks(flac.encode_column(odd.where("doc_id = 5"))).orderBy("first_sample").collect()
    assert b"".join(b.pcm for b in blocks).rstrip(b"\0").decode() == odd.where("doc_id = 5").first().text
    assert flac.media_features(flac.encode_column(none)).count() == 0


def test_flac_query_stores_streams_and_blocks(spark, odd, sf, tmp_path, monkeypatch):
    monkeypatch.setattr("tessera.sources.shared.shared_folder", lambda spark: f"file://{tmp_path}")
    rows = queries.op3_flac(spark, sf).collect()
    (streams,) = tmp_path.glob("flac-streams-*")
    media = {r.doc_id: r.media for r in spark.read.parquet(str(streams)).collect()}
    assert {r.doc_id: r.media_sha256 for r in rows} == {d: hashlib.sha256(m).hexdigest() for d, m in media.items()}
    for r in rows:
        payload = b"".join(b.pcm for b in r.blocks)
        assert hashlib.sha256(payload).hexdigest() == r.payload_sha256
        assert [b.first_sample for b in r.blocks] == list(range(0, r.payload_bytes, flac.BLOCK))
        for first, n in ((0, 10), (4090, 20), (r.payload_bytes - 5, 50)):
            assert flac.read_samples(media[r.doc_id], first, n) == payload[first : first + n]
    stored, direct = flac.archive_media(odd).drop("blocks"), flac.media_features(flac.encode_column(odd))
    assert sorted(map(str, stored.collect())) == sorted(map(str, direct.collect()))


def test_warc_odd_rows(spark):
    page = "<p>é</p>" * 20
    schema = "page_id long, url string, html string, offset long, payload string"
    rows = [(3, "u\n1", page, 1, "x"), (1, None, page, 1, "x"), (1, "u", page, 1, "x"), (2, "u", None, 1, "x"), (4, "u", "", 1, "x"), (5, "u", "short", 1, "x"), (6, "u", "short", 1, "x"), (None, "u", page, 1, "x")]
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.archive_pages(spark.createDataFrame(rows, schema)).collect())
    digest = hashlib.sha256(page.encode()).hexdigest()
    assert got[:3] == [(0, "response", None, len(page.encode()), digest), (1, "response", None, len(page.encode()), digest), (1, "response", None, len(page.encode()), digest)]
    assert [g[:4] for g in got[3:]] == [(2, "response", None, 0), (3, "revisit", 1, len(page.encode())), (4, "response", None, 0), (5, "response", None, 5), (6, "response", None, 5)]
    assert warc.archive_pages(spark.createDataFrame([], schema)).count() == 0


def test_warc_revisits_of_two_payloads_under_one_page_id(spark):
    a, b = "<p>a</p>" * 20, "<p>b</p>" * 30
    rows = [(1, "u", a), (1, "u", b), (2, "u", a), (3, "u", b), (1, "u", a)]
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    of = lambda page, kind, first, text: (page, kind, first, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert got[3:] == [of(2, "revisit", 1, a), of(3, "revisit", 1, b)]
    assert sorted(map(str, got[:3])) == sorted(map(str, [of(1, "response", None, a), of(1, "response", None, a), of(1, "response", None, b)]))


def test_language_odd_rows(spark, odd, none):
    rows = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[1].score == 0
    assert language_id.identify(none).count() == 0
    unlabelled = odd.withColumn("lang", odd.token.substr(5, 1)).where("doc_id = 4")
    assert language_id.identify(unlabelled.selectExpr("doc_id", "text", "cast(null as string) as lang")).first().lang_pred == "und"


def test_language_scores_are_brute_force_kernels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit_languages(docs)
    texts = [r.text for r in docs.orderBy("doc_id").limit(25).collect()] + ["Ünder  den Linden, 1 2!", "a", None, "..."]

    def present(text):
        out = set()
        letters = [(ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 0 for c in text]
        folded = [c for k, c in enumerate(letters) if c or not k or letters[k - 1]]
        for n in range(1, language_id.LONGEST + 1):
            for i in range(len(folded) - n + 1):
                h = 0
                for k in range(n):  # the hash takes one more letter at each length
                    h = (h + folded[i + k] + k + 1) * 0x9E3779B1 & 0xFFFFFFFF
                g = (h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF
                out.add(g >> 32 - language_id.FEATURES.bit_length() + 1)
        return out

    marks = [set(np.flatnonzero(m).tolist()) for m in model.landmarks]
    names, scores, _ = model.predict(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        if not text or not any(c.isalpha() for c in text):
            assert (name, score) == (language_id.UNDETERMINED, 0)
            continue
        own = present(text)
        kernel = np.array([len(own & m) / (max(1, len(own)) ** 0.5 * max(1, len(m)) ** 0.5) for m in marks])
        out = kernel @ model.weights
        assert name == model.languages[int(out.argmax())] and score == pytest.approx(min(1, max(0, (out.max() + 1) / 2)), abs=1e-4)


def test_language_stage_drops_foreign_scripts_and_junk(spark, sf):
    import corpus_pipeline

    r = random.Random(3)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = [x.text for x in docs.where("length(text) > 400").orderBy("doc_id").limit(40).collect()]
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(3, 8)))
    strange, clean = [], []
    for n in (1, 3, 10, 100, 3000):
        for letters in ("абвгдежзиклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω", [chr(c) for c in range(0x4E00, 0x9000)], "אבגדהוזחטיכלמנסעפצקרשת"):
            strange.append(" ".join(word(letters) for _ in range(n)))
        if n > 3:
            strange.append(" ".join(word("bcdfghjklmnpqrstvwxz") for _ in range(n)))
        clean += [" ".join(t.split()[:n]) for t in some]
    clean += [" ".join(some[k:] + some[:k]) * 4 for k in range(3)]
    added = spark.createDataFrame([(10**6 + k, t, None, "s", len(t)) for k, t in enumerate([*strange, *clean])], docs.schema)
    kept = {x.doc_id - 10**6 for x in corpus_pipeline.language_id(spark, docs.union(added), sf).where("doc_id >= 1000000").select("doc_id").collect()}
    assert kept == set(range(len(strange), len(strange) + len(clean)))


def test_token_count_odd_rows(spark, odd, none):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = {r.doc_id: r.n_tokens for r in token_count.count_tokens(odd, path).collect()}
    assert rows[1] == rows[2] == 0 and rows[4] > 5 and rows[5] > 60_000
    assert token_count.count_tokens(none, path).count() == 0


def test_store_odd_rows(spark, odd, none, tmp_path):
    import public_tokenizers

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    token_store.write_store(odd, f"{tmp_path}/a", tokenizer)
    rows = token_store.read_store(spark, f"{tmp_path}/a").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 7]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    chunks = spark.read.parquet(f"{tmp_path}/a/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    ids = {r.start: r.ids for r in token_store.read_tokens(spark, f"{tmp_path}/a").collect()}
    assert all(len(ids[r.start]) == r.n_tokens and ids[r.start][-1] == 1 for r in rows)
    token_store.write_store(none, f"{tmp_path}/b", tokenizer)
    assert token_store.read_store(spark, f"{tmp_path}/b").count() == 0


def test_crcs_are_joined():
    import zlib

    r = random.Random(2)
    parts = [[r.randbytes(r.randint(1, 3000)) for _ in range(r.randint(1, 6))] for _ in range(20)]
    crc = np.array([zlib.crc32(p) for own in parts for p in own])
    size = np.array([len(p) for own in parts for p in own])
    first = np.cumsum([0] + [len(own) for own in parts])[:-1]
    assert token_store.join_crcs(crc, size, first).tolist() == [zlib.crc32(b"".join(own)) for own in parts]


def test_preferences(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (3, 0, None, None), (4, 0, None, None), (4, 1, "assistant", ""), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*t, "p", 1) for t in turns], "conv_id long, turn long, role string, text string, prompt string, n_common long")
    rows = {r.chosen_id: r for r in preference.format_preferences(df, preference.neighbour_pairs(df)).collect()}
    assert (rows[3].rejected_id, rows[3].n_common, rows[3].chosen) == (4, 1, "")
    assert rows[1].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert (rows[1].chosen, rows[1].chosen_mask) == ("<|im_start|>assistant\nyes<|im_end|>\n", "22-36")
    alone = preference.format_preferences(df, spark.createDataFrame([(1, None), (9, 1)], "chosen_id long, rejected_id long")).collect()
    assert sorted((r.chosen_id, r.n_common, r.prompt) for r in alone) == [(1, 0, ""), (9, 0, "")]
    assert preference.neighbour_pairs(df.where("false")).count() == 0


def test_mixing_odd_rows(spark, odd, none):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == 9 and all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    assert sum({r.source_size: r.target for r in rows}.values()) > 0
    assert mixing.mix_sources(none).count() == 0
    assert [r.taken for r in mixing.mix_sources(odd.where("doc_id = 2")).collect()] == [0]


def test_edited_copies_are_found_and_clean_texts_left(spark):
    r = random.Random(6)
    words = lambda n: [f"{r.choice('abcdefgh')}{r.choice('aeiou')}{r.randint(0, 60)}" for _ in range(n)]
    items = {i: words(36) for i in range(8)} | {8: ["two", "words"], 9: []}
    docs = {}
    for i in range(8):
        edited = [w if r.random() > 0.15 else f"z{r.randint(0, 999)}" for w in items[i]]
        docs[i] = " ".join(words(300) + edited + words(200)).title()
        docs[100 + i] = ", ".join(words(500))
    docs |= {200: None, 201: "", 202: "two words"}
    make = lambda rows, key: spark.createDataFrame([(k, v, 1) for k, v in rows], f"{key} long, text string, seeds long")
    found = decontaminate.find_leaks(make(docs.items(), "doc_id"), make([(k, " ".join(v) or None) for k, v in items.items()], "item_id")).collect()
    assert {(x.doc_id, x.item_id) for x in found} == {(i, i) for i in range(8)} | {(202, 8)}
    empty = make(docs.items(), "doc_id").where("false")
    assert decontaminate.find_leaks(empty, empty.withColumnRenamed("doc_id", "item_id")).count() == 0


def _best_score(item, doc):
    above, best = [0] * (len(doc) + 1), 0
    for x in item:
        row = [0]
        for j, y in enumerate(doc):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        above, best = row, max(best, *row)
    return best / (2 * len(item))


def test_leaks_are_those_of_brute_force_alignment(spark):
    r = random.Random(11)
    words = lambda n: [f"{r.choice('abcdefgh')}{r.choice('aeiou')}{r.randint(0, 40)}" for _ in range(n)]
    items = {i: words(n) for i, n in enumerate([36, 36, 36, 36, 20, 7, 5, 4, 3])} | {9: ["a", "b"] * 10}
    docs, around = [], lambda w: words(r.randint(0, 90)) + w + words(r.randint(0, 90))
    for _ in range(150):  # a large group of part copies, and one whole one: what is copied often isn't lost
        docs.append(around(items[0][:20]))
    docs.append(around(items[0]))
    for i in items:
        for step in (2, 3, 4, 5):
            docs.append(around([f"z{k}" if k % step == step - 1 else w for k, w in enumerate(items[i])]))
            docs.append(around([x for k, w in enumerate(items[i]) for x in ([w, f"y{k}"] if k % step == 0 else [w])]))
            docs.append(around([w for k, w in enumerate(items[i]) if k % step]))
        docs.append(around([x for w in items[i] for x in (w, "y")]))
        for _ in range(12):
            edited = []
            for w in items[i]:
                kind = r.random()
                edited += [w] if kind < 0.6 else [] if kind < 0.75 else ["q"] if kind < 0.9 else [w, "q"]
            docs.append(around(edited))
    want = {}
    for d, doc in enumerate(docs):
        for i, item in items.items():
            if (score := _best_score(item, doc)) >= 0.5 and score * len(item) >= min(len(item), 8):
                want[d, i] = score
    make = lambda rows, key: spark.createDataFrame([(k, " ".join(v)) for k, v in rows], f"{key} long, text string")
    found = decontaminate.find_leaks(make(list(enumerate(docs)), "doc_id"), make(items.items(), "item_id")).collect()
    assert {(x.doc_id, x.item_id): x.score for x in found} == want
    assert all((d, 0) in want for d in range(151)) and len(want) > 250


def test_alignment_scores():
    a = [np.arange(1, 9, dtype=np.uint64)] * 3
    b = [np.array(x, np.uint64) for x in ([90, *range(1, 9), 91], [1, 2, 3, 77, 5, 6, 7, 8], [1, 2, 3, 4, 55, 5, 6, 7, 8])]
    assert decontaminate.smith_waterman(a, b).tolist() == [16, 13, 15]
