"""A corpus pipeline over documents: language, near copies, benchmark leaks, mixing, token files.

Each stage takes what its predecessor kept, written as Parquet in the shared folder. Stages before the last return the columns
of documents; the last returns what the token store's files hold.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import bounded, drop, kept, materialize, new_path, scratch, table
from tessera.llm.decontaminate import drop_leaks
from tessera.llm.language_id import UNDETERMINED, fit_languages, predict_languages
from tessera.llm.mixing import mix_sources
from tessera.llm.ngram_jaccard import jaccard_components
from tessera.llm.token_store import read_store, write_store

#: Words of a shingle and percent of similarity of near copies.
SHINGLE, PERCENT = 5, 80
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0


#: What stages add to rows while they work; documents must not have columns of these names.
NUMBER, ADDED = "__number", "__"


def _numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with a number that only rows with equal values in the columns share, null apart from every value, whether they have a
    doc_id or not. Where rows that differ have one number by chance, all but one kind of them take a second one, so that rows are
    told apart by 128 bits."""
    parts = [x for c in columns for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull())]
    rows = docs.withColumns({NUMBER: F.xxhash64(*parts), "__second": F.xxhash64(F.lit(1), *parts)})
    twice = rows.groupBy(NUMBER).agg(F.min("__second").alias("__lo"), F.max("__second").alias("__hi")).where("__lo <> __hi")
    # of n different rows n^2 / 2^65 pairs meet, 270 of 10^11
    twice = materialize(twice.select(F.col(NUMBER).alias("__twice"), "__lo"), "twice")
    rows = rows.join(bounded(twice), F.col(NUMBER) == F.col("__twice"), "left")
    number = F.when(F.col("__second") > F.col("__lo"), F.col("__second")).otherwise(F.col(NUMBER))
    return rows.withColumn(NUMBER, number).select(*docs.columns, NUMBER)


def _one_each(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows of docs, but of those with a number that is in repeated only the first by doc_id. Each task finds its own first rows
    before rows of a number meet."""
    repeated = bounded(repeated.select(F.col(NUMBER).alias("__repeated")))
    once = docs.join(repeated, F.col(NUMBER) == F.col("__repeated"), "left_anti")
    several = docs.join(repeated, F.col(NUMBER) == F.col("__repeated"), "left_semi")
    order = Window.partitionBy(NUMBER).orderBy(F.col("doc_id").asc_nulls_last())
    return once.union(several.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones; those without a letter, or strange to all, go."""
    found = predict_languages(docs, fit_languages(docs), added=ADDED)
    return found.where((F.col("__lang_pred") != UNDETERMINED) & ~F.col("__strange")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, one without an id only where none has one.
    Of repeated rows of that document one stays. Documents without words stay."""
    rows = _numbered(docs, "text")
    texts = rows.groupBy(NUMBER).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best"), F.count("*").alias("rows"))
    with scratch(spark):
        found = jaccard_components(rows.select(F.col(NUMBER).alias("doc_id"), "text"), k=SHINGLE, percent=PERCENT)
        groups = found.where("n_shingles > 0").select(F.col("doc_id").alias(NUMBER), "component_id").distinct()
        texts = materialize(texts.join(groups, NUMBER), "texts")
        stay = texts.groupBy("component_id").agg(F.min(F.struct("best", NUMBER)).alias("stay"))
        texts = kept(texts.join(stay, "component_id").select(NUMBER, "rows", (F.col(NUMBER) == F.col(f"stay.{NUMBER}")).alias("stays")), "near-copies")
    gone = bounded(texts.where("not stays").select(F.col(NUMBER).alias("__gone")))
    rows = rows.join(gone, F.col(NUMBER) == F.col("__gone"), "left_anti")
    return _one_each(rows, texts.where("stays and rows > 1")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times). Documents without words stay once. Rows that agree in doc_id,
    source and text become as many as the mix takes of them all."""
    rows = _numbered(docs, "doc_id", "source", "text")
    with scratch(spark):
        mixed = mix_sources(rows.select(F.col(NUMBER).alias("doc_id"), "text", "source"), WEIGHTS, SHARE, MOST).where("size > 0")
        times = mixed.groupBy(F.col("doc_id").alias(NUMBER)).agg(F.sum((F.col("taken") / F.col("size")).cast("int")).cast("int").alias("__times"), F.count("*").alias("__rows"))
        times = kept(times.where("__times <> 1 or __rows > 1"), "times")
    rows = _one_each(rows, times.where("__rows > 1")).join(bounded(times.drop("__rows")), NUMBER, "left").where("coalesce(__times, 1) > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.coalesce("__times", F.lit(1))))).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in a content-addressed store; returns doc_id, start, n_tokens and ids_crc32 as read back."""
    path = new_path(spark, "token-store")
    write_store(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_store(spark, path)


STAGES = [
    ("language_id", language_id), ("ngram_jaccard", near_copies), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output),
]

#: SQL can express neither the classifier nor the mix's random rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes when the next one's is written, and all else that a stage wrote with it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark), scratch(spark):  # what a stage keeps, too, is only needed until its rows are written
            made = stage(spark, docs, sf_dir)
            made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            drop(before)
        before = path
    return docs
