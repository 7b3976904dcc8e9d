"""Words made to have equal hashes, an index opened again, rows that share ids, and names that clash."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, mixing, preference, substring_dedup, warc
from tessera.llm.decontaminate import drop_leaks, find_leaks
from tessera.llm.ngram_jaccard import jaccard_components


def _thue_morse(levels, a="a", b="b"):
    x, y = [a], [b]
    for _ in range(levels):
        x, y = x + y, y + x
    return x, y


def test_words_and_runs_of_thue_and_morse_stay_apart(spark):
    x, y = ("".join(w) for w in _thue_morse(11))
    rows = jaccard_components(spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 2}
    tail = [f"w{i}" for i in range(59)]
    docs = [(1, " ".join([x, *tail])), (2, " ".join([y, *tail])), (3, " ".join(_thue_morse(7)[0])), (4, " ".join(_thue_morse(7)[1]))]
    rows = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[2].n_removed == 59 and rows[2].text == y
    sets = {d: {tuple(t.split()[i : i + 50]) for i in range(len(t.split()) - 49)} for d, t in docs}
    words = docs[3][1].split()
    keep = [True] * len(words)
    for i in range(len(words) - 49):
        if tuple(words[i : i + 50]) in sets[3]:
            keep[i : i + 50] = [False] * 50
    assert rows[4].n_removed == keep.count(False)


def test_a_later_batch_meets_an_index_opened_again(spark, tmp_path):
    r = random.Random(1)
    passage = [f"p{r.randint(0, 999)}" for _ in range(70)]
    make = lambda rows: spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    old = make([(d, [f"o{d}x{i}" for i in range(60)] + (passage if d == 2 else [])) for d in range(4)])
    new = make([(10, ["new"] + passage + ["end"]), (11, [f"n{i}" for i in range(80)])])
    path = f"file://{tmp_path}/index"
    substring_dedup.remove_repeats(old, batches=4, index=substring_dedup.FingerprintIndex(spark, path, most_runs=2))
    index = substring_dedup.FingerprintIndex(spark, path, most_runs=2)
    assert 1 <= len(index.runs) <= 2 and index.written > 4  # compacted
    rows = {x.doc_id: x for x in substring_dedup.remove_repeats(new, index=index, history=old).collect()}
    assert rows[10].text == "new end" and rows[11].n_removed == 0 and set(rows) == {10, 11}


def test_a_revisit_without_its_response_is_an_error(spark):
    rows = [(2, "revisit", 1, "d", None), (3, "response", None, "e", 200)]
    read = spark.createDataFrame(rows, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long")
    assert warc.with_sizes(read.where("page_id = 3")).count() == 1
    with pytest.raises(Exception, match="no response"):
        warc.with_sizes(read).collect()


def test_selected_records_and_long_payloads(spark, tmp_path):
    import hashlib

    pages = [(i, f"u{i}", f"<p>{i}</p>" * (100 if i % 5 else 700_000)) for i in range(12)]
    df = spark.createDataFrame([(i, u, h, hashlib.sha256(h.encode()).hexdigest(), None, None) for i, u, h in pages], "page_id long, url string, payload string, payload_digest string, refers_to long, first_url string")
    index = warc.write_warc(df, f"file://{tmp_path}/warc")
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_warc(index.where("page_id in (0, 3, 7)"), f"file://{tmp_path}/warc").collect()}
    assert got == {i: h for i, _, h in pages if i in (0, 3, 7)}


def test_equal_rows_are_mixed_apart(spark):
    docs = spark.createDataFrame([(1, "one two three", "a")] * 3000 + [(None, "x y", "b")] * 2000 + [(2, "z", "c")], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert len(rows) == 5001 and all(abs(taken[s] - target[s]) <= 3 for s in target)


def test_leaks_without_ids_and_short_items(spark):
    item = " ".join(f"item{i}" for i in range(20))
    docs = spark.createDataFrame([(None, f"before {item} after"), (1, "two, words"), (1, "other text"), (2, "these two words more"), (None, None), (3, item), (3, item)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item), (2, "two words"), (3, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, benchmark).collect()) == [(1, 2), (3, 1)]
    assert sorted((r.doc_id or 0, r.text or "") for r in drop_leaks(docs, benchmark).collect()) == [(0, ""), (1, "other text"), (2, "these two words more")]


def test_preferences_of_equal_turns_and_repeated_pairs(spark):
    long = "word " * 50_000
    turns = [(1, 0, "user", long), (1, 0, "user", long), (1, 1, "assistant", "a"), (2, 0, "user", long), (2, 0, "user", long), (2, 1, "assistant", "b")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = preference.format_preferences(df, spark.createDataFrame([(1, 2), (1, 2)], "chosen_id long, rejected_id long")).collect()
    assert len(rows) == 2 and all(r.n_common == 2 and len(r.prompt) > 500_000 for r in rows)


def test_pipeline_stages_on_odd_rows(spark, sf):
    import corpus_pipeline

    some = spark.read.parquet(f"{sf}/documents.parquet")
    names = ["score", "strange", "times", "copy", "size", "lang_pred", "slot", "band"]
    docs = some.selectExpr("*", *[f"-7.0 as {c}" for c in names])
    text = docs.where("length(text) > 500").orderBy("doc_id").first().text
    rows = [(None, text, "en", "s", 1), (None, text, "en", "s", 1), (900_001, None, None, None, None), (900_002, "", "en", None, 0), (900_003, text, None, "s", 1), (900_003, text, None, "s", 1)]
    docs = docs.union(spark.createDataFrame(rows, some.schema).selectExpr("*", *[f"-7.0 as {c}" for c in names]))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
        assert kept.where(" or ".join(f"{c} <> -7.0" for c in names)).isEmpty(), name
        if name == "ngram_jaccard":
            assert kept.where("doc_id is null or doc_id >= 900000").isEmpty()  # copies, and texts without letters
            assert kept.count() == kept.select("doc_id").distinct().count()
        if name == "mixing":
            assert kept.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, none, sf)
        assert none.count() == 0


def test_mixing_tells_nulls_from_values(spark, sf):
    import corpus_pipeline

    text = "some words that stand here for a document of the corpus"
    rows = [(None, text, "en", "1", 1), (1, text, "en", None, 1), (1, text, "en", "", 1), (11, text, "en", "a", 1), (1, text, "en", "1a", 1), (2, None, "en", "1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline._numbered(docs, "doc_id", "source", "text").select(corpus_pipeline.NUMBER).distinct().count() == 6
    counts = Counter((r.doc_id, r.source, r.text) for r in corpus_pipeline.mixing(spark, docs, sf).collect())
    assert max(counts.values()) <= 2 and counts[2, "1", None] == 1 and 6 <= sum(counts.values()) <= 10


def test_short_items_leave_their_neighbours(spark):
    texts = ["I wonder what is going on in this quiet town ...", "you know what the weather does", "And what is the matter?", "what is, the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ten = "one two three four five six seven eight nine ten".split()
    more = spark.createDataFrame([(10, "so " + " ".join(ten[:8]) + " so"), (11, " ".join(ten[:7]) + " and so on"), (12, " ".join(ten))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "What is the?"), (2, " ".join(ten))], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(docs.union(more), benchmark).collect()}
    assert found == {(2, 1), (3, 1), (10, 2), (12, 2)}
    assert {r.doc_id for r in drop_leaks(docs.union(more), benchmark).collect()} == {0, 1, 11}


def test_token_output_on_odd_rows_and_a_long_text_through_all_stages(spark, sf):
    import corpus_pipeline

    some = spark.read.parquet(f"{sf}/documents.parquet")
    long = " ".join(r.text for r in some.where("lang = 'en' and length(text) > 3000").orderBy("doc_id").limit(12).collect()) * 3
    rows = [(None, "no id", "en", None, 1), (5_000_000, None, None, None, None), (5_000_001, "", "en", "s", 0), (5_000_001, "", "en", "s", 0), (5_000_002, long, "en", "src0", len(long))]
    docs = some.union(spark.createDataFrame(rows, some.schema))
    out = corpus_pipeline.token_output(spark, docs, sf).collect()
    assert len(out) == docs.count()
    assert sorted(r.n_tokens for r in out if r.doc_id in (5_000_000, 5_000_001)) == [1, 1, 1]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        if name == "language_id":
            assert kept.where("doc_id = 5000002").count() == 1
    assert kept.where(f"length(text) = {len(long)}").count() <= 2


def test_what_a_run_of_the_pipeline_leaves(spark, sf):
    import os

    import corpus_pipeline
    from tessera.sources.shared import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before)
    assert left == ["stage-token_output", "token-store"]


def test_pivotal_rounding_is_exact_and_fair():
    import itertools

    import numpy as np

    size, p = np.array([3.0, 5.0, 2.0]), np.array([0.3, 0.6, 0.55])
    grid = (np.arange(24) + 0.5) / 24
    ends = []
    for luck in itertools.product(grid, repeat=2):
        out, hand = mixing._pair(size, p, np.array([0.5, *luck]))
        assert abs((out * size).sum() - (p * size).sum()) < 1e-9  # every pair only moves mass
        assert sum(0 < x < 1 for x in out) <= 1 and (hand < 0 or 0 < out[hand] < 1)
        assert ((out >= 0) & (out <= 1)).all()
        ends.append(out)
    assert np.abs(np.mean(ends, axis=0) - p).max() < 0.03  # over all luck a document keeps its probability
    settled = [mixing._settle(size, p, np.array(luck)) for luck in itertools.product(grid, repeat=3)]
    assert all(set(out.tolist()) <= {0.0, 1.0} for out in settled)
    assert max(abs((out * size).sum() - (p * size).sum()) for out in settled) <= size.max()
    assert np.abs(np.mean(settled, axis=0)[1] - p[1]) < 0.03  # the largest is rounded by its own probability


def test_every_frame_is_tried_with_every_predictor():
    import random

    from tessera.llm import flac

    r = random.Random(3)
    steps = b"".join(bytes([c]) * r.randint(30, 90) for c in r.choices(b" eniarstodlhucmgp", k=200))  # under 6 bits a sample as it is
    noise = bytes(r.randrange(256) for _ in range(9000))
    short = [steps[: 4096 + n] for n in range(1, 12)]  # last frames with fewer samples than a predictor asks for
    payloads = [steps, noise, bytes(range(256)) * 40, *short]
    streams = flac.encode(payloads)
    assert [p for p, _ in flac.decode(streams)] == payloads
    assert len(streams[0]) < len(steps) / 4  # samples without a predictor took more than half of it
    assert flac.read_samples(streams[0], 4000, 300) == steps[4000:4300]


def test_a_bitmap_reaches_the_driver_without_an_object_for_each_word(spark):
    bits = 21
    df = spark.range(1 << 18).select(F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("slot"))
    expected = np.unique(df.toArrow().column("slot").to_numpy())
    tracemalloc.start()
    try:
        got = common.bitmap(df, "slot", bits)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(np.flatnonzero(common.in_bitmap(got, np.arange(1 << bits))), expected)
    assert most < 8 * (1 << bits >> 3)
