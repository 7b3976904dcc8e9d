"""A content-addressed store of token ids.

A rolling hash over 16 ids cuts each document's ids into chunks, so that equal passages give equal chunks wherever they stand.
Files under the store's path:

- chunks: (digest, n, ids): each different chunk once, ids packed little-endian.
- recipes: (doc_id, start, n_tokens, root, digests) in ascending doc_id order; start counts the ids of all documents before.
- manifest: (level, node, hash): a Merkle tree over the recipes. A leaf covers the documents that start in the same 2^16 ids.
- format: (width): bytes of an id.

A reader verifies chunks by digest, documents by the Merkle root of their digests, and all documents by the top of the manifest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, lists, mapped, materialize, pieces, scratch, utf8
from .encoding import word_encoder
from .ranks import running

SPAN, AVERAGE, LEAST, MOST = 16, 256, 64, 4096
#: Text that is encoded at one time.
ENCODED_BYTES = 2 << 20
#: A random number per id: the rolling hash is the sum of the last SPAN ones, spread by a multiplication.
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 1 << 16, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_ODD, _BELOW = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 64) // AVERAGE)


def cut(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of a document: after runs of SPAN ids whose hash says so, LEAST to MOST ids apart."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    total = np.cumsum(_GEAR[ids & 0xFFFF])  # modulo 2^64
    h = (total[SPAN - 1 :] - np.append(np.uint64(0), total[:-SPAN])) * _ODD
    places = (np.flatnonzero(h < _BELOW) + SPAN).tolist()
    ends, last = [], 0
    for p in [*places, n]:
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST or p == n:
            last = p
            ends.append(p)
    return ends if ends[-1] == n else [*ends, n]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; a lone node goes up unchanged, and inner nodes are marked so that they can't pass for leaves."""
    while len(leaves) > 1:
        leaves = [digest(b"\1" + b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def encode_chunks(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, root, digests, chunks) of each document; null texts have the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]):
        encoder = word_encoder(tokenizer)
        end, width = np.array([end_id], encoder.kind), encoder.kind.itemsize
        for batch in batches:
            for i, j in pieces(utf8(batch.column("text"))[1], ENCODED_BYTES):
                all_ids, first = encoder.encode(batch.column("text").slice(i, j - i))
                n, roots, sizes, digests, chunks = [], [], [], [], []
                for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
                    ids = np.concatenate([all_ids[a:b], end])
                    ends, raw = cut(ids), ids.tobytes()
                    own = [raw[a * width : b * width] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                    names = [digest(c) for c in own]
                    n.append(len(ids))
                    roots.append(merkle(names))
                    sizes.append(len(own))
                    digests += names
                    chunks += own
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(i, j - i), "n_tokens": pa.array(n, pa.int64()), "root": pa.array(roots, pa.binary()),
                    "digests": lists(digests, np.array(sizes), pa.binary()), "chunks": lists(chunks, np.array(sizes), pa.binary()),
                })

    schema = "doc_id long, n_tokens long, root binary, digests array<binary>, chunks array<binary>"
    return mapped(docs.select("doc_id", "text"), run, schema)


def manifest(docs: DataFrame) -> DataFrame:
    """(level, node, hash) over (doc_id, start, root): each level covers 2^10 nodes of the one below; the last has one node."""
    leaf = F.struct("start", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(b":"), F.col("root")).alias("root"))
    hashed = lambda rows: F.sha2(F.array_join(F.transform(F.sort_array(rows), lambda x: F.hex(x["root"])), ","), 256)
    level = docs.groupBy(F.shiftright("start", 16).alias("node")).agg(hashed(F.collect_list(leaf)).alias("hash"))
    top = docs.agg(F.max("start")).first()[0]
    out, number = level.select(F.lit(0).alias("level"), "node", "hash"), 0
    span = (top or 0) >> 16
    while span:
        number, span = number + 1, span >> 10
        row = F.struct("node", F.col("hash").cast("binary").alias("root"))
        level = level.groupBy(F.shiftright("node", 10).alias("up")).agg(hashed(F.collect_list(row)).alias("hash")).withColumnRenamed("up", "node")
        out = out.union(level.select(F.lit(number).alias("level"), "node", "hash"))
    return out


def top_hash(tree: DataFrame) -> str | None:
    row = tree.orderBy(F.desc("level")).first()
    return row["hash"] if row else None


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode docs(doc_id, text) into a store under path. Ties in doc_id stand in order of their contents; null ids come first.

    A null or empty text is the end id alone. Texts of any length are encoded whole, a bounded piece at a time. Repeated rows are
    documents of their own, which share chunks. Other columns are ignored; an empty table gives a store without documents.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession):
        _write(docs, path, tokenizer, end_id)


def _write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    encoded = materialize(encode_chunks(docs, tokenizer, end_id), "encoded")
    chunks = encoded.select(F.explode(F.arrays_zip("digests", "chunks")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.chunks").alias("ids"))
    unique = chunks.groupBy("digest").agg(F.first("ids").alias("ids"))
    zipped = lambda df, name: df.write.option("compression", "zstd").parquet(f"{path}/{name}")
    zipped(unique, "chunks")
    recipes = running(encoded.select("doc_id", "n_tokens", "root", "digests"), ["doc_id", "root"], {"start": F.col("n_tokens")})
    recipes = recipes.repartitionByRange("start").sortWithinPartitions("start")
    zipped(recipes.select("doc_id", "start", "n_tokens", "root", "digests"), "recipes")
    spark = docs.sparkSession
    zipped(manifest(spark.read.parquet(f"{path}/recipes")), "manifest")
    zipped(spark.range(1).select(F.lit(word_encoder(tokenizer).kind.itemsize).alias("width")), "format")


def _width(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/format").first()["width"]


@lru_cache(maxsize=1)
def _zero_bytes() -> np.ndarray:
    """For each power of two, tables that move a CRC-32 past so many zero bytes: [power][byte of the CRC][its value]."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns = table[basis & 255] ^ (basis >> 8)  # where each bit goes past one byte
    out = np.zeros((48, 4, 256), np.uint32)
    for power in range(48):
        for byte in range(4):
            for bit in range(8):
                out[power, byte] ^= np.where(np.arange(256) >> bit & 1, columns[8 * byte + bit], 0).astype(np.uint32)
        columns = _moved(columns, out[power])
    return out


def _moved(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def join_crcs(crc: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of each document from those of its parts in order; first: where each document's parts begin (all have some)."""
    total = np.cumsum(size)
    ends = np.append(first[1:], len(size)) - 1
    after = np.repeat(total[ends], np.diff(np.append(first, len(size)))) - total
    crc = crc.astype(np.uint32).copy()
    for power in range(int(after.max()).bit_length() if len(after) else 0):
        on = np.flatnonzero(after >> power & 1)
        crc[on] = _moved(crc[on], _zero_bytes()[power])
    return np.bitwise_xor.reduceat(crc, first)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the store's files; raises where they don't verify.

    ids_crc32: CRC-32 of the ids as little-endian unsigned 32-bit integers. Chunks are read once each; documents join what
    was computed of them, not their bytes.
    """
    width = _width(spark, path)

    def chunk(batches: Iterator[pa.RecordBatch]):
        kind = np.dtype(f"<u{width}")
        for batch in batches:
            names, n, crc = batch.column("digest").to_pylist(), [], []
            for name, ids in zip(names, batch.column("ids").to_pylist(), strict=True):
                if digest(ids) != name:
                    raise ValueError(f"chunk {name.hex()} doesn't have its digest")
                n.append(len(ids) // width)
                crc.append(zlib.crc32(np.frombuffer(ids, kind).astype("<u4")))
            yield pa.record_batch({"digest": batch.column("digest"), "n": pa.array(n, pa.int64()), "crc": pa.array(crc, pa.int64())})

    def whole(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            parts = batch.column("parts")
            sizes = parts.value_lengths().to_numpy()
            flat = parts.flatten()
            n, crc = (flat.field(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            names = flat.field(3).to_pylist()
            first = np.cumsum(sizes) - sizes
            roots = [merkle(names[a : a + s]) for a, s in zip(first.tolist(), sizes.tolist(), strict=True)]
            total = np.add.reduceat(n, first) if len(first) else n
            if roots != batch.column("root").to_pylist() or total.tolist() != batch.column("n_tokens").to_pylist():
                raise ValueError("a document's chunks don't have its Merkle root or length")
            crcs = join_crcs(crc, n * 4, first) if len(first) else crc
            yield pa.record_batch({**{c: batch.column(c) for c in ("doc_id", "start")}, "n_tokens": pa.array(total), "root": pa.array(roots, pa.binary()), "ids_crc32": pa.array(crcs.astype(np.int64))})

    read = mapped(spark.read.parquet(f"{path}/chunks").select("digest", "ids"), chunk, "digest binary, n long, crc long")
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("pos", "digest")).join(read, "digest")
    docs = parts.groupBy("start", "doc_id", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "crc", "digest"))).alias("parts"))
    docs = kept(mapped(docs, whole, "doc_id long, start long, n_tokens long, root binary, ids_crc32 long"), "documents")
    if top_hash(manifest(docs)) != top_hash(spark.read.parquet(f"{path}/manifest")):
        raise ValueError("the documents read don't have the manifest's Merkle root")
    return docs.drop("root")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) with the ids themselves, put together from recipes and chunks."""
    width = _width(spark, path)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = [np.frombuffer(b"".join(c["ids"] for c in parts), f"<u{width}").astype(np.int32) for parts in batch.column("parts").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    parts = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("digests").alias("pos", "digest"))
    parts = parts.join(spark.read.parquet(f"{path}/chunks"), "digest").groupBy("start", "doc_id")
    return mapped(parts.agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("parts")), run, "doc_id long, start long, ids array<int>")
