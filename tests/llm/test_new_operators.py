"""Ranked search, collocations and the rule ensemble: brute force, odd rows, and the parts their methods rest on."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations as C
from tessera.llm import lexical as L
from tessera.llm import rule_ensemble as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(UPPER))


def _ranked(docs, items, top=10):
    own = [(i, _terms(text)) for i, text in docs]
    n_docs, n_terms = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    queries = {}
    for i, text in items:
        queries.setdefault(i, set()).update(_terms(text))
    df = Counter(t for _, terms in own for t in set(terms))
    out = []
    for item, terms in queries.items():
        found = []
        for i, doc in own:
            if not doc:
                continue
            tf, m = Counter(doc), 10 + (90 * len(doc) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    words = ["the", "of", "And", "and", "été", "Été", "x1", "日本", "a-b", "un_der", "I'm"] + [f"w{i}" for i in range(60)]
    text = lambda n: r.choice([" ", ", ", "\t"]).join(r.choice(words[: r.choice([8, 71])]) for _ in range(n))
    docs = [(i, text(r.choice([1, 5, 30, 200]))) for i in range(150)]
    docs += [(200 + i, docs[7][1]) for i in range(40)] + [(300, None), (301, ""), (302, " .,!"), (None, "the w1"), (None, "the w1"), (5, "w2 w3"), (5, "w2 w3"), (400, "w5 " * 30_000)]
    items = [(i, text(r.choice([2, 12, 40]))) for i in range(25)] + [(30, None), (31, "..."), (32, "unknownterm"), (33, "the w1"), (33, "w5"), (None, "w2 w4"), (35, "the of and w1 w2")]
    return docs, items


@pytest.mark.parametrize("block", [1 << 16, 40])
def test_ranked_search_is_brute_force(spark, corpus, monkeypatch, block):
    docs, items = corpus
    monkeypatch.setattr(L, "BLOCK_TERMS", block)
    d = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, score int, rank int, n int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, query int")
    got = sorted(((x.item_id, x["rank"], x.doc_id, x.score) for x in L.search_ranked(d.repartition(5), b).collect()), key=repr)
    assert got == _ranked(docs, items)


def test_ranked_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert L.search_ranked(docs.where("false"), items).count() == 0
    assert L.search_ranked(docs, items.where("false")).count() == 0
    assert L.search_ranked(docs, items.withColumn("text", F.lit("?"))).count() == 0


def test_shared_sets_are_added_once():
    r = random.Random(9)
    base = [r.sample(range(80), 6) for _ in range(5)]
    queries = [sorted({*r.choice(base), *r.choice(base), *r.sample(range(80), 4)}) for _ in range(40)]
    plan = L.SharingPlan(queries, 80)
    assert plan.levels and len(plan.left) > 10
    def below(k):
        return {k} if k < plan.leaves else {k} | below(plan.left[k - plan.leaves]) | below(plan.right[k - plan.leaves])

    ends = [*plan.first[1:].tolist(), len(plan.roots)]
    reached = Counter(k for lo, hi in zip(plan.first.tolist(), ends, strict=True) for k in set().union(*(below(k) for k in plan.roots[lo:hi].tolist())))
    assert all(reached[plan.leaves + k] > 1 for k in range(len(plan.left)))  # a node is there because queries share it
    assert len(plan.left) + len(plan.roots) - len(queries) < sum(map(len, queries)) - len(queries)  # fewer additions than without
    term, doc = np.repeat(np.arange(80), 7), np.tile(np.arange(7), 80)
    value = np.array([r.randint(0, 1 << 40) for _ in term])
    dense = value.reshape(80, 7)
    assert (plan.combine(term, doc, value, 7) == np.array([dense[q].sum(axis=0) for q in queries])).all()


def _collocations(rows, least, longest, percent, top):
    counts, words = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for k in range(1, longest + 1):
                counts.update((lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    frequent = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    inside = {(p[0], *p[i:j]) for p, f in frequent.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if (i, j) != (1, len(p)) and 100 * f >= percent * counts[(p[0], *p[i:j])]}
    out = []
    for lang in words:
        found = []
        for p, a in frequent.items():
            if p[0] == lang and p not in inside:
                score, k = min((10**6 * a * a // (counts[(lang, *p[1 : 1 + k])] * counts[(lang, *p[1 + k :])]), k) for k in range(1, len(p) - 1))
                found.append((-score, -a, " ".join(p[1:]).encode(), counts[(lang, *p[1 : 1 + k])], counts[(lang, *p[1 + k :])]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], words[lang], -x[0]) for i, x in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(12)
    words = ["New", "york", "new", "YORK", "city", "é", "É", "of", "the", "日本", "x\x00y"] + [f"v{i}" for i in range(25)]
    sep = [" "] * 12 + ["  ", "\t", ", ", ".", "\n", " \r\n", "\x0b", ";"]
    text = lambda n: "".join(r.choice(words[: r.choice([6, 36])]) + r.choice(sep) for _ in range(n))
    rows = [(text(r.choice([1, 3, 40, 300])), r.choice(["en", "en", "en", "fr", None, "und"])) for _ in range(120)]
    return rows + [(rows[3][0], "en")] * 30 + [(None, "en"), ("", "de"), (" ,. ", None), ("new york " * 20_000, "en"), ("Rare one", "it")]


@pytest.mark.parametrize(("longest", "least", "join", "parts"), [(3, 10, False, 1 << 12), (3, 2, True, 8 << 20), (4, 5, False, 1 << 14)])
def test_collocations_are_brute_force(spark, texts, monkeypatch, longest, least, join, parts):
    monkeypatch.setattr(C, "PARTITION_BYTES", parts)
    if join:
        monkeypatch.setattr(C, "MOST_BITS", 1)
    df = spark.createDataFrame([(t, lang, 1, 2, "k") for t, lang in texts], "text string, lang string, size int, f int, key string").repartition(4)
    got = sorted(tuple(x) for x in C.collocations(df, least, longest, 50, 60).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == _collocations(texts, least, longest, 50, 60) and len(got) > 30


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([(None, None), ("only once here", "en")], "text string, lang string")
    assert C.collocations(df).count() == 0 and C.collocations(df.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_summaries_keep_every_frequent_key(seed):
    r = random.Random(seed)
    least = r.choice([3, 10])
    keys = [r.randint(0, 60) if r.random() < 0.4 else r.randint(100, 10_000) for _ in range(20_000)]
    true, capacity = Counter(keys), len(keys) // least + 1
    held, counts, lost = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
    for lo in range(0, len(keys), 1000):
        some, n = np.unique(np.array(keys[lo : lo + 1000], np.uint32), return_counts=True)
        held, counts, taken = C.merged(np.concatenate([held, some]), np.concatenate([counts, n]), capacity)
        lost += taken
        assert len(held) <= capacity
    assert lost < least
    left = dict(zip(held.tolist(), counts.tolist(), strict=True))
    assert all(left.get(k, 0) <= n <= left.get(k, 0) + lost for k, n in true.items())
    assert {k for k, n in true.items() if n >= least} <= {k for k, n in left.items() if n + lost >= least}


def test_phrases_that_share_a_key_are_counted_apart():
    rows = (np.array([5, 5, 5, 7], np.uint64), np.array([1, 2, 1, 1], np.uint64), np.array([1, 1, 1, 1]), np.arange(4), np.arange(4), np.ones(4, np.int64), np.zeros(4, np.int64))
    key, check, n, *_ = C._Counted._merged(rows)
    assert list(zip(key.tolist(), check.tolist(), n.tolist(), strict=True)) == [(5, 1, 2), (5, 2, 1), (7, 1, 1)]


def test_rules_are_the_paths_of_the_trees():
    described = "\n".join([
        "RandomForestClassificationModel: uid=x, numTrees=2", "  Tree 0 (weight 1.0):", "    If (feature 0 <= 0.5)", "     If (feature 1 <= 2.0)", "      Predict: 0.0", "     Else (feature 1 > 2.0)", "      Predict: 1.0",
        "    Else (feature 0 > 0.5)", "     If (feature 0 <= 1.5)", "      Predict: 1.0", "     Else (feature 0 > 1.5)", "      Predict: 0.0", "  Tree 1 (weight 1.0):", "    If (feature 0 <= 0.5)", "     Predict: 0.0", "    Else (feature 0 > 0.5)", "     Predict: 1.0E-5",
    ])
    rules = R.tree_rules(described, ("a", "b"))
    assert rules == [
        R.Rule((), (("a", 0.5),)), R.Rule((), (("a", 0.5), ("b", 2.0))), R.Rule((("b", 2.0),), (("a", 0.5),)), R.Rule((("a", 0.5),), ()), R.Rule((("a", 0.5),), (("a", 1.5),)), R.Rule((("a", 1.5),), ()),
    ]


def test_rules_as_columns_are_the_rules(spark):
    r = random.Random(1)
    made = [tuple(r.choice([0.0, 0.5, 1.0, 2.0]) for _ in range(3)) for _ in range(40)]
    df = spark.createDataFrame(made, "a double, b double, c double")
    rules = [R.rule([(r.choice("abc"), r.choice(["<=", ">"]), r.choice([0.0, 0.5, 1.0])) for _ in range(r.randint(1, 4))]) for _ in range(12)]
    model = R.RuleEnsemble(-0.5, tuple((x, r.uniform(-2, 2)) for x in rules))
    for row in df.withColumn("score", model.score()).collect():
        total = -0.5 + sum(w for x, w in model.weights if x.holds(row.asDict()))
        assert row.score == pytest.approx(1 / (1 + math.exp(-total)))


def test_statistics_of_texts(spark):
    text = "The cat! The DOG.\n\nthe cat | 12\n"
    rows = {r.doc_id: r for r in R.with_statistics(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "é" * 70_000)], "doc_id long, text string")).collect()}
    words = text.lower().split()
    x = rows[1]
    assert x.log_words == pytest.approx(math.log1p(len(words))) and x.word_chars == pytest.approx(sum(map(len, words)) / len(words))
    assert x.distinct_words == pytest.approx(len(set(words)) / len(words)) and x.upper == pytest.approx(5 / len(text)) and x.digits == pytest.approx(2 / len(text))
    assert x.marks == pytest.approx(3 / len(text)) and x.rare_marks == pytest.approx(1 / len(text)) and x.ends == pytest.approx(2 / len(words)) and x.lines == pytest.approx(2 / len(words))
    assert rows[2].asDict() | {"doc_id": 0} == rows[3].asDict() | {"doc_id": 0} and rows[4].word_chars == 70_000
    assert not any(v is None or math.isnan(v) for r in rows.values() for v in r.asDict().values())


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(None, "no id", None, None, 1), (9_000_000, None, None, None, None), (9_000_001, "", None, None, 0), (0, docs.where("doc_id = 0").first().text, "en", "s", 1)], docs.schema)
    given = docs.union(odd).withColumns({"score": F.lit(7), "label": F.lit(7), "chars": F.lit(7), "predicted": F.lit(7)})
    out = R.score_quality(given, labels.union(labels.where("doc_id % 9 = 0"))).collect()
    assert len(out) == docs.count() + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    scores = {r.doc_id: (r.score, r.predicted) for r in out}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(truth[r.doc_id], r.score, r.predicted) for r in out if r.held_out and r.doc_id in truth]
    good, bad = [s for y, s, _ in held if y == 1], [s for y, s, _ in held if y == 0]
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(y == p for y, _, p in held) / len(held) > 0.95
    assert scores[9_000_000] == scores[9_000_001]
    # labels of held-out rows are never learned from
    is_held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(is_held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: (r.score, r.predicted) for r in R.score_quality(docs, turned).collect()}
    plain = {r.doc_id: (r.score, r.predicted) for r in R.score_quality(docs, labels).collect()}
    assert all(again[k][0] == pytest.approx(plain[k][0], abs=1e-6) for k in plain)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(1, None, 0), (2, 5, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in R.score_quality(docs, labels.where("false")).collect()} == {0.5}
    assert all(r.score > 0.8 and r.predicted == 1 for r in R.score_quality(docs, labels).collect())
    assert R.score_quality(docs.where("false"), labels).count() == 0
