"""Content-addressed token store.

Each document's id stream is cut where a rolling hash of the last ids says so, so equal
passages become equal chunks wherever they stand.  A chunk is named by the hash of its bytes
and stored once; a document is a recipe, the ordered list of its chunks, with the Merkle root
over them; recipes are written in ascending doc_id order with each document's place in the
whole stream, and a manifest holds the roots over the recipes with their ids and places.

Format (Parquet): ``chunks`` digest, ids (little-endian unsigned 16-bit); ``recipes`` doc_id, start,
n_tokens, digests, root; ``manifest`` documents, tokens, root of each range, and the root over all ranges.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import long_array, materialize, range_bucket, range_splitters, scratch_path
from .tokens import crc32_joined, encoder

END_ID = 2
#: A cut follows an id where the low bits of the rolling hash of the last ROLL ids are all zero.
ROLL, MASK = 16, np.uint64(255)
MIN_CHUNK, MAX_CHUNK = 64, 2048
_GEAR = np.random.default_rng(8).integers(1, 1 << 63, 1 << 16, dtype=np.uint64)


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream, by content; chunks have MIN_CHUNK..MAX_CHUNK ids but the last."""
    n = len(ids)
    h, span = _GEAR[ids], 1
    while span < min(ROLL, n):  # sums over the last 1, 2, 4, .. ids
        h[span:] += h[:-span] << np.uint64(span)
        span *= 2
    marks = np.flatnonzero((h >> np.uint64(ROLL - 1)) & MASK == 0) + 1
    ends, at = [], 0
    while n - at > MIN_CHUNK:
        k = np.searchsorted(marks, at + MIN_CHUNK)
        end = min(int(marks[k]) if k < len(marks) else n, at + MAX_CHUNK, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over the leaves, pair by pair; an odd one moves up alone."""
    level = list(leaves) or [digest(b"")]
    while len(level) > 1:
        level = [digest(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def write_store(
    docs: DataFrame, tokenizer_path: str, store: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 4_000
) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write the store to ``store``.

    Rows with the same id are separate documents, in the order of their recipes' roots; null ids come first.  An
    empty table makes an empty store.  Other columns are ignored.
    """

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, end, seen = encoder(tokenizer_path).encode_all, end_id.to_bytes(2, "little"), set()
        for batch in batches:
            encoded = encode_all(batch.column(1))
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                sizes, recipes, roots, fresh = [], [], [], []
                for data in islice(encoded, part.num_rows):
                    data += end
                    names, new, at = [], [], 0
                    for stop in cut_points(np.frombuffer(data, "<u2")):
                        chunk = data[2 * at : 2 * stop]
                        name, at = digest(chunk), stop
                        names.append(name)
                        if name not in seen:
                            new.append({"digest": name, "ids": chunk})
                            if len(seen) < 500_000:  # only saves writing again what the exchange merges anyway
                                seen.add(name)
                    sizes.append(len(data) // 2)
                    recipes.append(names)
                    roots.append(merkle_root(names))
                    fresh.append(new)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(recipes, pa.list_(pa.binary())), pa.array(roots, pa.binary()),
                     pa.array(fresh, pa.list_(pa.struct([("digest", pa.binary()), ("ids", pa.binary())])))],
                    names=["doc_id", "n_tokens", "digests", "root", "fresh"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        chunked, "doc_id long, n_tokens long, digests array<binary>, root binary, fresh array<struct<digest: binary, ids: binary>>"
    )
    rows = materialize(rows, "store-staged")
    chunks = rows.select(F.explode("fresh").alias("c")).select("c.digest", "c.ids")
    chunks.dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{store}/chunks")

    # Where each document starts: totals of id ranges on the driver, running sums inside them.
    heads = rows.select("doc_id", "n_tokens", "digests", "root").withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    splitters = range_splitters(heads, "_key", rows_per_bucket)
    heads = heads.withColumn("_bucket", range_bucket(F.col("_key"), splitters))
    totals = {r["_bucket"]: r["n"] for r in heads.groupBy("_bucket").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, total = [], 0
    for b in range(max(totals, default=-1) + 1):
        starts.append(total)
        total += totals.get(b, 0)
    inside = Window.partitionBy("_bucket").orderBy("_key", "root").rowsBetween(Window.unboundedPreceding, -1)
    start = F.get(long_array(starts), F.col("_bucket")) + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    ordered = heads.withColumn("start", start).select("doc_id", "start", "n_tokens", "digests", "root")
    ordered = ordered.repartitionByRange(F.col("start")).sortWithinPartitions("start")
    ordered.write.option("compression", "zstd").parquet(f"{store}/recipes")

    # Merkle manifest: a root for each range of the stream, then one over those.
    ranges = materialize(_ranges(docs.sparkSession, store), "store-ranges")
    top = _top(ranges)
    ranges.withColumn("top", F.lit(top)).write.parquet(f"{store}/manifest")


def _ranges(spark: SparkSession, store: str) -> DataFrame:
    """Documents, tokens and root of each range of the stream, from the recipes."""
    recipes = spark.read.parquet(f"{store}/recipes").withColumn("_range", F.floor(F.col("start") / 5_000_000))

    def range_root(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start")
        rows = zip(group["start"].tolist(), group["doc"].tolist(), group["n_tokens"].tolist(), group["root"].tolist())
        leaves = [digest(f"{start} {doc} {n} ".encode() + bytes(root)) for start, doc, n, root in rows]
        return pd.DataFrame({"_range": [int(key[0])], "documents": [len(group)], "tokens": [int(group["n_tokens"].sum())], "root": [merkle_root(leaves)]})

    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc")
    return recipes.select("_range", "start", doc, "n_tokens", "root").groupBy("_range").applyInPandas(range_root, "_range long, documents long, tokens long, root binary")


def _top(ranges: DataFrame) -> bytes:
    """Root over the ranges' roots (one for each 5,000,000 tokens), numbers and counts: over runs of
    1,024 ranges first, so that the driver gets one row for each 5 billion tokens."""

    def run_root(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("_range")[["_range", "documents", "tokens", "root"]].itertuples(index=False)
        leaves = [digest(repr((int(n), int(d), int(t), bytes(root))).encode()) for n, d, t, root in rows]
        return pd.DataFrame({"_run": [int(key[0])], "root": [merkle_root(leaves)]})

    runs = ranges.select(F.floor(F.col("_range") / 1024).alias("_run"), "_range", "documents", "tokens", "root").groupBy("_run").applyInPandas(run_root, "_run long, root binary")
    return merkle_root([digest(repr((r["_run"], bytes(r["root"]))).encode()) for r in sorted(runs.collect(), key=lambda r: r["_run"])])


def verify_manifest(spark: SparkSession, store: str) -> None:
    """Compare the manifest with the recipes; ValueError if a recipe is gone, added or altered."""
    manifest = spark.read.parquet(f"{store}/manifest")
    wanted = {bytes(r["top"]) for r in manifest.select("top").distinct().collect()} or {merkle_root([])}
    if not wanted == {_top(manifest)} == {_top(_ranges(spark, store))}:
        raise ValueError(f"the recipes of {store} are not those of its manifest")


def read_store(spark: SparkSession, store: str, strict: bool = True) -> DataFrame:
    """Read a store back and verify it: doc_id, start, n_tokens, ids_crc32, verified.

    Recipes that do not agree with the manifest fail the reading, and so does, if ``strict``, a document
    whose chunks are gone or altered (else it is ``verified`` = false).

    Each chunk is read once: its name is checked against its ids, and the checksum of its ids (as
    little-endian unsigned 32-bit integers) is taken; a document's checksum is combined from its
    chunks' in the order of its recipe, and its root checked against the recipe's.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, datas = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            crcs = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in datas]
            good = [digest(x) == n for n, x in zip(names, datas)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 2 for x in datas], pa.int64()), pa.array(crcs, pa.int64()), pa.array(good)], names=["digest", "n", "crc", "good"])

    verify_manifest(spark, store)
    chunks = spark.read.parquet(f"{store}/chunks").mapInArrow(summed, "digest binary, n long, crc long, good boolean")
    recipes = spark.read.parquet(f"{store}/recipes")
    parts = recipes.select("start", F.posexplode("digests").alias("i", "digest")).join(chunks, "digest")
    whole = parts.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("i", "digest", "n", "crc", "good"))).alias("parts"))

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, roots, wanted = batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_numpy(zero_copy_only=False)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, parts, some = np.cumsum(counts), lists.flatten(), counts > 0
            first = (ends - counts)[some]
            crcs, sizes, good = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64), np.zeros(len(counts), bool)
            if len(first):
                n, crc, sound = (parts.field(c).to_numpy(zero_copy_only=False) for c in ("n", "crc", "good"))
                crcs[some] = crc32_joined(crc, 4 * n, first)
                sizes[some] = np.add.reduceat(n, first)
                good[some] = np.logical_and.reduceat(sound, first)
                names = parts.field("digest").to_pylist()
                good &= [merkle_root(names[e - c : e]) == root for e, c, root in zip(ends.tolist(), counts.tolist(), roots)]
            good &= sizes == wanted
            if strict and not good.all():
                raise ValueError(f"{(~good).sum()} documents of {store} do not have the chunks of their recipes")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(good)], names=["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    rows = recipes.select("doc_id", "start", "root", "n_tokens").join(whole, "start", "left").select("doc_id", "start", "parts", "root", "n_tokens")
    return rows.mapInArrow(combined, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write ``docs`` to a store in the shared folder and read it back."""
    spark = docs.sparkSession
    store = scratch_path(spark, "token-store")
    write_store(docs, tokenizer_path, store)
    return read_store(spark, store)
