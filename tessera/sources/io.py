"""Sources and sinks: declared schemas, upserts, document and bulk exports, archives, grids, patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import written

_CARD = (
    "card_id string, number string, language string, parallel_id int, name string, category string, level long, dp long, play_cost long, use_cost long, form string, attribute string, "
    "type string, rarity string, block_icon long, effect string, inherited_effect string, security_effect string, notes string, pack_type string, image struct<language:string,source:string,path:string>, "
    "dual struct<name:string,category:string,use_cost:long,effect:string,colors:array<string>>"
)
#: Declared schemas of the working tables.
SCHEMAS = {
    "card": _CARD, "color": "card_id string, index long, color string", "requirement": "card_id string, index long, cost long, level long, category string, form string, colors array<string>",
    "icon": "card_id string, index long, field string, type string, text string", "rule": "card_id string, index long, type string, value string, allowance long",
    "errata": "number string, language string, date date, error string, correction string, notes string", "limitation": "number string, language string, type string, date date, allowance long, paired_numbers array<string>, note string",
    "faq": "number string, language string, date date, question string, answer string", "release": "release_id string, name string, genre string, language string, product_uri string, cardlist_uri string, date date",
    "card_release": "card_id string, release_id string", "panorama": "panorama_id string, columns int, order int, cards array<string>", "image_hash": "card_id string, hash long",
    "patch": "number string, language string, field string, op string, old string, new string", "rule_revision": "number string, language string, before string, after string",
}


def read_catalog(spark: SparkSession, path: str, name: str | None = None, format: str = "parquet") -> DataFrame:
    """A table of the catalog with its declared schema; name is the last part of the path unless given."""
    name = name or path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
    reader = spark.read.format(format)
    return (reader.schema(SCHEMAS[name]) if name in SCHEMAS else reader).load(path)


def upsert(base: DataFrame, delta: DataFrame, key: str, many: Sequence[str] = ()) -> DataFrame:
    """Per attribute, delta's value wins where it is not null; columns in `many` are united. Keys are unique on both sides."""
    joined = base.alias("b").join(delta.alias("d"), key, "full")

    def value(name: str):
        old = F.col(f"b.{name}")
        if name not in delta.columns:
            return old
        new = F.col(f"d.{name}")
        return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.array_union(old, new)) if name in many else F.coalesce(new, old)

    added = [F.col(f"d.{c}") for c in delta.columns if c not in base.columns]
    return joined.select(key, *[value(c).alias(c) for c in base.columns if c != key], *added)


BUCKET = "__bucket"


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """A table in folders by a hash of its key, so that an upsert can rewrite some of them. Choose as many that one fits a task."""
    _bucketed(df, key, buckets).repartition(buckets, BUCKET).write.partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The table under path, with the columns of all its buckets."""
    return spark.read.option("mergeSchema", "true").parquet(path).drop(BUCKET)


def upsert_buckets(spark: SparkSession, path: str, delta: DataFrame, key: str, buckets: int, many: Sequence[str] = ()) -> list[int]:
    """Upsert delta into the table that write_buckets made under path. Only the buckets that delta's keys are in are read, joined
    and overwritten; returns these, at most `buckets` numbers. What they will hold is written beside first, so that a job that is
    lost leaves the table as it was, or some buckets done, and can be run again."""
    delta = written(_bucketed(delta, key, buckets), "delta")
    touched = sorted(r[0] for r in delta.select(BUCKET).distinct().collect())
    if not touched:
        return []
    base = spark.read.option("mergeSchema", "true").parquet(path).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    new = written(_bucketed(upsert(base, delta.drop(BUCKET), key, many), key, buckets), "upsert")
    new.repartition(len(touched), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return touched


def bulk_export(df: DataFrame, path: str, by: str, format: str = "json", rows: int = 1_000_000) -> None:
    """All rows under path/all and, one folder per value, under path/by. Rows of one value go to as many tasks as the table has
    multiples of `rows`, by a hash of their columns, so that a frequent value isn't written by one task."""
    df.write.format(format).save(f"{path}/all")
    slices = df.count() // rows + 1
    slot = F.pmod(F.xxhash64(*df.columns), F.lit(slices))
    df.repartition(by, slot).write.format(format).partitionBy(by).save(f"{path}/by")


def list_exports(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size, time) of the files under a path; time is that in a name like all-20240131-120000.json, else null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    name = F.element_at(F.split("path", "/"), -1)
    stamp = F.regexp_extract(name, r"([0-9]{8}-[0-9]{6})", 1)
    return files.select("path", name.alias("name"), "size", F.try_to_timestamp(stamp, F.lit("yyyyMMdd-HHmmss")).alias("time"))


def hash_index(card: DataFrame, image: DataFrame) -> DataFrame:
    """(hash as unsigned digits, language, number, parallel_id)."""
    rows = card.join(image, "card_id")
    return rows.select(F.conv(F.hex("hash"), 16, 10).alias("hash"), "language", "number", "parallel_id")


def explode_payload(df: DataFrame, column: str, schema: str, path: str) -> DataFrame:
    """Rows of a list in JSON payloads: schema is the payload's, path the list's place in it. Broken payloads give no rows."""
    parsed = df.withColumn("__p", F.from_json(column, schema))
    value = F.col("__p")
    for part in path.split(".") if path else []:
        value = value[part]
    return parsed.select(*[c for c in df.columns if c != column], F.explode(value).alias("__r")).select(*[c for c in df.columns if c != column], "__r.*")


def refresh_archive(new: DataFrame, old: DataFrame, key: str, order: str, path: str | None = None) -> DataFrame:
    """Union of new and old rows; of one key the new row stays, of several new ones the first. Written to a new path, if given."""
    rows = new.withColumn("__age", F.lit(0)).unionByName(old.withColumn("__age", F.lit(1)), allowMissingColumns=True)
    first = Window.partitionBy(key).orderBy("__age", order)
    out = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__age")
    if path is None:
        return out
    out.write.parquet(path)
    return new.sparkSession.read.parquet(path)


def import_grid(df: DataFrame, name: str, grid: str) -> DataFrame:
    """Grids (array of rows of ids) to (panorama_id, name, columns, order, member): a row per member, with a name-based UUID."""
    h = F.md5(F.col(name).cast("binary"))
    variant = F.element_at(F.split(F.lit("8,9,a,b"), ","), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return df.select(uuid.alias("panorama_id"), F.col(name).alias("name"), F.size(F.try_element_at(grid, F.lit(1))).alias("columns"), F.posexplode(F.flatten(grid)).alias("order", "member"))


def read_patches(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Patches are data of a fixed schema, never code."""
    return spark.read.format(format).schema(SCHEMAS["patch"]).load(path).where(F.col("op").isin("set", "replace"))


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMAS[name]))
