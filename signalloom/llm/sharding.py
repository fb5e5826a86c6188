"""Uniform shuffle into exactly sized shards through a hypergeometric communication matrix.

Rows lie in blocks (the partitions of the exchange).  How many rows of each block go to each
shard is drawn exactly, as a uniform permutation of all rows would deal them; each block is
permuted on its own, cut by those counts, exchanged, and each shard is permuted again.  Only
counts per block and shard reach the driver.  Places are drawn for digests of the rows; then the
texts themselves are exchanged, once to their digests' places and once into their shards, where they lie by slot.
DataFrame functions only.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, count_below, inline_table, materialize

#: Copies of a row that are numbered at once.
COPIES = 1_000_000


def _stirling_error(n: int) -> float:
    """log(n!) less Stirling's formula, to full precision for any n."""
    if n < 16:
        return math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) if n else 0.0
    r = 1.0 / n
    return r * (1 / 12 - r * r * (1 / 360 - r * r * (1 / 1260 - r * r / 1680)))


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation near the mean."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, term, k = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        k += 2
        more = total + term / k
        if more == total:
            return total
        total = more


def _binomial_log(x: int, n: int, p: float, q: float) -> float:
    """Log probability of x successes in n trials, by its saddle point."""
    if n == 0:
        return 0.0
    if x == 0:
        return n * (math.log1p(-p) if p < 0.5 else math.log(q))
    if x == n:
        return n * (math.log1p(-q) if q < 0.5 else math.log(p))
    core = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return core - 0.5 * (math.log(2 * math.pi) + math.log(x) + math.log1p(-x / n))


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` taken from good+bad without replacement.

    Inversion that starts at the mode and moves outwards, so it costs about a standard deviation of
    steps.  The mode's probability comes from three binomial ones by saddle points, which keep double
    precision at any size (measured: the probabilities add up to 1 within 1e-9 at 4e10 rows).
    """
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    p, q = draws / (good + bad), (good + bad - draws) / (good + bad)
    at_mode = math.exp(_binomial_log(mode, good, p, q) + _binomial_log(draws - mode, bad, p, q) - _binomial_log(draws, good + bad, p, q))
    u = rng.random() - at_mode
    if u <= 0:
        return mode
    left, pl, right, pr = mode, at_mode, mode, at_mode
    while (left > lo and pl > 0) or (right < hi and pr > 0):
        if right < hi:
            pr *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= pr
            if u <= 0:
                return right
        if left > lo:
            pl *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= pl
            if u <= 0:
                return left
    return mode  # only what rounding left over


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Counts (block x shard) with these margins, distributed as under a uniform permutation."""
    rng, left, out = random.Random(seed), list(shard_rows), []
    for n in block_rows:
        row, pool = [], sum(left)
        for k, room in enumerate(left):
            take = hypergeometric(rng, room, pool - room, n)
            row.append(take)
            n -= take
            pool -= room
            left[k] -= take
        out.append(row)
    return out


def shuffle_into_shards(
    docs: DataFrame, n_shards: int = 40, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", rows_per_block: int = 4_000
) -> DataFrame:
    """Deal all rows of ``docs`` to ``n_shards`` shards under the law ``rows``.

    Returns one row per input row: the id, its text, size (UTF-8 bytes of the text plus 16) and text_crc32
    of the text as it arrived, law, shard (0-based), slot (gapless from 0 in its shard), grown_shard (null).
    A shard's rows lie by slot, in as many partitions as it takes.  Shard sizes
    differ by at most one.  A null text stays null and counts as empty (16 bytes); null ids and repeated rows
    are rows like any other; an empty input gives no rows; other columns are ignored, whatever
    their names.  The same input and seed give the same result for any partitioning.
    """
    digest = lambda c: F.coalesce(F.sha2(c.cast("binary"), 256), F.lit("-"))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.select("doc_id", "text", F.unhex(F.sha2(F.concat_ws(" ", digest(F.col("doc_id").cast("string")), digest(F.col("text"))).cast("binary"), 256)).alias("_row"))
    placed = _places(docs.select("_row"), n_shards, seed, rows_per_block)
    # One text for all rows that are equal.
    texts = docs.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    dealt = texts.join(placed, "_row").select("doc_id", "text", "shard", "slot", "_sub").repartition("shard", "_sub").sortWithinPartitions("shard", "slot")
    text = F.coalesce("text", F.lit(""))
    return dealt.select(
        "doc_id", "text", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def _places(rows: DataFrame, n_shards: int, seed: int, rows_per_block: int) -> DataFrame:
    """(_row, shard, slot, _sub) of every row; a digest that stands for equal rows gets a place for each."""
    spark = rows.sparkSession
    # Equal rows are counted and numbered, so that they get keys of their own and no task holds them all.
    rows = rows.groupBy("_row").agg(F.count("*").alias("_n"))
    rows = rows.withColumn("_hi", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(COPIES))))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.col("_hi"), F.least(F.col("_hi") + COPIES, F.col("_n")) - 1)))
    rows = materialize(rows.select("_row", F.xxhash64(F.lit(seed), "_row", "_copy").alias("_k")), "shard-rows")
    n = rows.count()
    blocks = bucket_count(n, rows_per_block)
    rows = rows.withColumn("_block", F.pmod(F.col("_k"), F.lit(blocks)).cast("int"))
    counts = {r["_block"]: r["n"] for r in rows.groupBy("_block").agg(F.count("*").alias("n")).collect()}
    order = sorted(counts)
    base, extra = divmod(n, n_shards)
    matrix = communication_matrix([counts[b] for b in order], [base + (k < extra) for k in range(n_shards)], seed)
    cuts = []
    for b, row in zip(order, matrix):
        total, cum = 0, []
        for x in row:
            total += x
            cum.append(total)
        cuts.append({"_block": b, "_cuts": cum})
    cuts = inline_table(spark, cuts, "_block:int,_cuts:array<bigint>")

    local = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed + 1), "_k"), "_row")
    dealt = (
        rows.withColumn("_rank", F.row_number().over(local))
        .join(cuts, "_block")
        .withColumn("shard", count_below(F.col("_cuts"), F.lit(n_shards), F.col("_rank").cast("long"), strict=True))
    )
    subs = bucket_count(n // n_shards, rows_per_block)
    dealt = dealt.withColumn("_key", F.xxhash64(F.lit(seed + 2), "_k", "_rank", "_block")).select(
        "_row", "shard", "_key", F.pmod(F.shiftright("_key", 20), F.lit(subs)).cast("int").alias("_sub")
    )
    dealt = materialize(dealt, "shard-dealt")
    before, starts = {}, []
    for r in sorted(dealt.groupBy("shard", "_sub").agg(F.count("*").alias("n")).collect(), key=lambda r: (r["shard"], r["_sub"])):
        starts.append({"shard": r["shard"], "_sub": r["_sub"], "_start": before.get(r["shard"], 0)})
        before[r["shard"]] = before.get(r["shard"], 0) + r["n"]
    starts = inline_table(spark, starts, "shard:int,_sub:int,_start:bigint")
    inner = Window.partitionBy("shard", "_sub").orderBy("_key", "_row")
    numbered = dealt.withColumn("_n", F.row_number().over(inner)).join(starts, ["shard", "_sub"])
    return numbered.select("_row", "shard", (F.col("_start") + F.col("_n") - 1).alias("slot"), "_sub")
