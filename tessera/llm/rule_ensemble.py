"""Quality of documents by a sparse rule ensemble.

1. Statistics of each text are Spark columns: shares of kinds of characters, lengths, repeats (`STATISTICS`).
2. A random forest is grown on the labelled rows' statistics. Each path from a root to a node is a rule: bounds on statistics,
   joined by and.
3. A logistic regression with the lasso gives each rule a weight, most of them 0.
4. The rules with a weight become one Spark column, which scores all rows without Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, materialize, scratch

#: Labelled rows that the fit takes, about; of more, those of the lowest hashes. Every row is scored.
MOST_LABELLED = 100_000
TREES, DEPTH, LEAST_ROWS, SEED = 30, 4, 5, 13
#: Weight of the lasso, and most steps of its fit.
LASSO, STEPS = 2e-3, 60
#: Score from which a document is predicted good.
THRESHOLD = 0.3


def _count(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern)).cast("double")


def _share(n: Column, of: Column) -> Column:
    return n / F.greatest(of, F.lit(1.0))


def _statistics() -> dict[str, Column]:
    chars, words = F.col("chars"), F.col("words")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    distinct = F.size(F.array_distinct("parts")).cast("double")
    ends = F.filter("parts", lambda w: w.rlike(r"[.!?]$"))
    return {
        "log_chars": F.log1p(chars),
        "log_words": F.log1p(words),
        "word_chars": _share(F.col("solid"), words),
        "upper": _share(_count("[A-Z]"), chars),
        "digits": _share(_count("[0-9]"), chars),
        "marks": _share(_count(r"[!-/:-@\[-`{-~]"), chars),
        "rare_marks": _share(_count(r"[#$%&*|<>{}=_~^@\\\[\]]"), chars),
        "cries": _share(_count("!"), words),
        "distinct_words": _share(distinct, words),
        "words_a_kind": F.log1p(_share(words, distinct)),
        "ends": _share(F.size(ends).cast("double"), words),
        "lines": _share(F.size(lines).cast("double"), words),
        "distinct_lines": _share(F.size(F.array_distinct(lines)).cast("double"), F.size(lines).cast("double")),
    }


#: Names of the statistics, in order.
STATISTICS = tuple(
    "log_chars log_words word_chars upper digits marks rare_marks cries distinct_words words_a_kind ends lines distinct_lines".split()
)


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with the statistics in place of the text. A null text counts as an empty one."""
    stay = [c for c in docs.columns if c != "text"]
    rows = docs.select(*stay, F.coalesce("text", F.lit("")).alias("text"))
    parts = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.select(*stay, "text", F.length("text").cast("double").alias("chars"), parts.alias("parts"))
    solid = F.aggregate("parts", F.lit(0), lambda n, w: n + F.length(w)).cast("double")
    rows = rows.select("*", F.size("parts").cast("double").alias("words"), solid.alias("solid"))
    found = _statistics()
    return rows.select(*stay, *[found[c].alias(c) for c in STATISTICS])


@dataclass(frozen=True)
class Rule:
    """Bounds on statistics by name: above (more than) and most (at most)."""

    above: tuple[tuple[str, float], ...]
    most: tuple[tuple[str, float], ...]

    def column(self) -> Column:
        tests = [F.col(c) > x for c, x in self.above] + [F.col(c) <= x for c, x in self.most]
        return reduce(lambda a, b: a & b, tests)

    def holds(self, row: dict[str, float]) -> bool:
        return all(row[c] > x for c, x in self.above) and all(row[c] <= x for c, x in self.most)


def rule(tests: list[tuple[str, str, float]]) -> Rule:
    """A rule of tests (statistic, "<=" or ">", value): of several on one side of a statistic the closest counts."""
    above, most = {}, {}
    for c, sign, x in tests:
        if sign == ">":
            above[c] = max(x, above.get(c, x))
        else:
            most[c] = min(x, most.get(c, x))
    return Rule(tuple(sorted(above.items())), tuple(sorted(most.items())))


_TEST = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_rules(described: str, names: tuple[str, ...]) -> list[Rule]:
    """The paths from the roots of trees to their nodes, as a fitted forest describes itself; each once, in order."""
    rules: dict[Rule, None] = {}
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in described.splitlines():
        if line.strip().startswith("Tree "):
            path = []
        if found := _TEST.match(line):
            depth = len(found[1])
            path = [p for p in path if p[0] < depth] + [(depth, (names[int(found[2])], found[3], float(found[4])))]
            rules[rule([test for _, test in path])] = None
    return list(rules)


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules with weights on the logit of label 1."""

    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The share of rows like this one that have label 1, as an expression over the statistics."""
        total = reduce(lambda a, b: a + b, [F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.weights], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows(doc_id, held_out, ...) that may be learned from, with label 0.0 or 1.0: about MOST_LABELLED of them, picked by a hash of
    doc_id. A doc_id with several labels counts with each; labels other than 0 and 1 don't."""
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("double").alias("label"))
    known = rows.where(~F.col("held_out")).join(known, "doc_id")
    slots = 1 << 20
    share = min(slots, math.ceil(slots * MOST_LABELLED / max(1, known.count())))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < share)


def fit_rules(train: DataFrame) -> RuleEnsemble:
    """A rule ensemble from train(label, statistics...). With labels of one kind only, or none, there are no rules."""
    ones, n = train.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    base = math.log((ones + 1) / (n - ones + 1))
    if not 0 < ones < n:
        return RuleEnsemble(base, ())
    rows = materialize(train.select("label", array_to_vector(F.array(*STATISTICS)).alias("x"), *STATISTICS), "train")
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_ROWS, featureSubsetStrategy="onethird", seed=SEED)
    rules = tree_rules(forest.fit(rows).toDebugString, STATISTICS)
    if not rules:
        return RuleEnsemble(base, ())
    marked = materialize(rows.select("label", F.array(*[r.column().cast("double") for r in rules]).alias("marks")), "marked")
    lasso = LogisticRegression(featuresCol="marks", labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=STEPS, standardization=False)
    fitted = lasso.fit(marked.select("label", array_to_vector("marks").alias("marks")))
    weights = fitted.coefficients.toArray().tolist()
    return RuleEnsemble(float(fitted.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs(doc_id, text), learned from labels(doc_id, quality) of rows whose
    crc32(doc_id as text) mod 5 is not 0; only the text is looked at.

    Whole texts are scored, of any length, empty and null ones as texts without characters. Rows without an id have no label and
    aren't held out; repeated rows are scored alike. Other columns are ignored. Without labels every score is 0.5, with one kind of
    label all have the score of its share. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    with scratch(docs.sparkSession):
        rows = materialize(with_statistics(docs), "statistics")
        model = fit_rules(labelled(rows, labels))
        scored = rows.select("doc_id", "held_out", model.score().alias("score"))
        return kept(scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")), "quality")
