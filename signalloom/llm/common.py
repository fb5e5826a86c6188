"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most buckets for which per-bucket metadata (a few longs each) is held on the driver.
MAX_BUCKETS = 65_536
#: Rows of the sample that sets the bounds of ranges, for each range.
BOUND_ROWS = 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only in a local session that sets none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "signalloom-shared")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/signalloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there,
    and a lost executor costs a reread instead of a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Spark's own file system layer."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def long_array(values) -> Column:
    """A constant array<bigint>; one literal after constant folding, however long."""
    values = list(values)
    if not values:
        return F.expr("cast(array() as array<bigint>)")
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def inline_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A driver-side table of bounded size as a DataFrame, without an RDD."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df`` (rows of a few numbers) with a broadcast hint if it has at most ``most_rows`` rows; a
    larger one is left to an exchange."""
    rows = df.limit(most_rows + 1).count()
    return F.broadcast(df) if rows <= most_rows else df


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def salted_join(many: DataFrame, lookup: DataFrame, keys: list[str], spread: int = 16) -> DataFrame:
    """Inner join with a lookup of one row a key: broadcast if it is small, else every key is dealt."""
    rows = lookup.limit(100_001).count()
    if rows <= 100_000:
        return many.join(F.broadcast(lookup), keys)
    dealt = many.withColumn("_deal", F.pmod(F.xxhash64(*(F.col(c) for c in many.columns)), F.lit(spread)).cast("int"))
    return dealt.join(lookup.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))), [*keys, "_deal"]).drop("_deal")


def hot_keys(df: DataFrame, key: str, few: int = 100_000) -> list:
    """Keys that hold more than a thousandth of the rows of ``df``: fewer than a thousand.  A table of up
    to ``few`` rows has none that matter."""
    n = df.count()
    return [] if n <= few else [r[0] for r in df.groupBy(key).count().where(F.col("count") * 1000 > n).select(key).where(F.col(key).isNotNull()).collect()]


def hot_join(many: DataFrame, lookup: DataFrame, key: str, hot: list, how: str = "inner", spread: int = 64) -> DataFrame:
    """``many`` joined with ``lookup`` by ``key``; rows of the keys in ``hot`` are dealt over ``spread``
    groups, for which the few rows of ``lookup`` that they need are repeated."""
    if not hot:
        return many.join(lookup, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = many.where(~is_hot).join(lookup, key, how)
    dealt = many.where(is_hot).withColumn("_deal", F.pmod(F.xxhash64(*(F.col(c) for c in many.columns)), F.lit(spread)).cast("int"))
    repeated = lookup.where(is_hot).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return cold.unionByName(dealt.join(repeated, [key, "_deal"], how).drop("_deal"))


def count_below(values: Column, size: Column, x: Column, strict: bool = False) -> Column:
    """How many leading entries of the ascending array ``values`` are <= x (< x if strict)."""
    steps = F.transform(
        F.sequence(F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)),
        lambda e: F.call_function("shiftleft", F.lit(1), e),
    )

    def probe(p, s):
        at = F.get(values, p + s - 1)
        return F.when((p + s <= size) & ((at < x) if strict else (at <= x)), p + s).otherwise(p)

    return F.aggregate(steps, F.lit(0), probe)


def range_splitters(df: DataFrame, col: str, rows_per_bucket: int) -> list[int]:
    """Ascending bounds that cut ``df`` by ``col`` into ranges of about ``rows_per_bucket`` rows.

    They are quantiles of a sample by hash, of about BOUND_ROWS rows a range, which sets the ranges'
    evenness and nothing else.  At most MAX_BUCKETS bounds come to the driver; beyond that the
    ranges grow, no row is lost.
    """
    n = df.count()
    buckets = min(MAX_BUCKETS, max(1, n // rows_per_bucket))
    if buckets < 2:
        return []
    share = BOUND_ROWS * buckets / n
    chosen = F.pmod(F.xxhash64(F.lit(1), F.col(col)), F.lit(1 << 40)) < F.lit(int(min(1.0, share) * (1 << 40)))
    some = sorted(r[0] for r in df.where(chosen).groupBy(col).count().select(col).collect())
    return sorted({some[len(some) * i // buckets] for i in range(1, buckets)}) if some else []


def range_bucket(col: Column, splitters: list[int]) -> Column:
    """Bucket number of a long in the ranges of ``splitters``; null goes to bucket 0."""
    if not splitters:
        return F.lit(0)
    return F.coalesce(count_below(long_array(splitters), F.lit(len(splitters)), col), F.lit(0))


def bucket_count(n_rows: int, rows_per_bucket: int) -> int:
    """Number of hash buckets for ``n_rows``."""
    return min(MAX_BUCKETS, max(1, -(-n_rows // rows_per_bucket)))
