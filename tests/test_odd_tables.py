"""Queries on tables that the driver's copies don't show at their smallest size, against their SQL."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture
def equal(tmp_path):
    """Writes tables, runs a query on them and compares its rows with those of its SQL."""
    import duckdb

    def check(spark, name, **tables):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for table, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        ours = [tuple(r) for r in df.collect()]
        theirs = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall()
        assert sorted(map(repr, ours)) == sorted(map(repr, theirs))
        return ours

    return check


def test_icons_of_an_odd_number_of_documents(spark, equal):
    docs = spark.range(25).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert len(equal(spark, "e4_extract_icons", documents=docs)) == 24


def test_markers_before_letters_of_other_alphabets(spark, equal):
    docs = spark.createDataFrame([(0, "with nationä and station, with ration_x notion"), (1, "than motion語this lotion9 potion"), (2, None)], "doc_id long, text string")
    rows = {(r[0], r[2]): r[3] for r in equal(spark, "p25_split_markers", documents=docs)}
    assert rows == {(0, "with "): "nation,station,notion", (1, "than "): "motion,potion"}


def test_records_with_cut_references_and_other_blanks(spark, equal):
    html = lambda title, link: f'<html><head><title>{title}</title></head><body><nav><ul><li><a href="/?a&lt=1">{link}</a></li></ul></nav><article><h1>x y</h1></article></body></html>'
    pages = [(0, html("a &amp; b&amp", "&lt;&amp;lt; &am")), (1, html("a　b  c\n d", "AT&T & &notit; &quotx;")), (2, html("&#39;q&#39 &quot", "1 &lt 2 &gt; 1")), (3, "")]
    df = spark.createDataFrame(pages, "page_id long, html string").withColumn("url", F.lit(""))
    rows = {(r[0], r[1]): r[3] for r in equal(spark, "w8_extract_records", pages=df)}
    assert rows[0, "title"] == "a & b&amp" and rows[1, "link"] == "AT&T & &notit; &quotx;" and rows[2, "link"] == "1 &lt 2 > 1"


def test_odd_texts_are_normalised_as_sql_does(spark, equal):
    texts = ["a 　b", "a\tb \t c  d", "x 」 . y\n ］ z \n.", "（a) 　（b (", "[a] [b", " . 」", "１Ｘ＋：＆！’，　", "-", "  ", "", "、 ", "a .", None, "plain words. Here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    assert len(equal(spark, "p1_normalize_text", documents=docs)) == len(texts)
