"""Approximate nearest neighbours along shifted Hilbert curves.

Each of several curves projects the unit vectors to random directions of its own, shifts them and
orders them by Hilbert index; Spark range-partitions that order, and consecutive rows form
blocks.  A query is compared with the blocks around its own on every curve, in 8-bit precision, and
the best of all windows are reranked on the original vectors.

How many blocks a window reaches is measured, not guessed: for a sample of the queries the true
neighbours are found by a scan, and the windows get the least width that holds the wanted share of
them.  Vectors without structure need wide windows, clustered ones narrow ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import materialize, small

DIMS, BITS = 12, 5
#: Bytes of the curves' order in one range partition, about.
PARTITION_BYTES = 32 << 20
SALTS = 16
#: Blocks of a curve that one task walks in order.
ZONE = 64


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows of ``cells``, each 0..2**bits-1).

    Gray-code form: undo the excess work from the top bit down, then interleave the bits.
    """
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    for shift in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << shift), np.uint64((1 << shift) - 1)
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    for shift in range(bits - 1, 0, -1):
        bit = np.uint64(1 << shift)
        t ^= np.where((x[-1] & bit) != 0, bit - np.uint64(1), np.uint64(0))
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for shift in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(shift)) & np.uint64(1))
    return out.astype(np.int64)


def curve_keys(unit: np.ndarray, centre: np.ndarray, spread: float, curve: int, seed: int) -> np.ndarray:
    """Key of each unit vector on one curve: its own random directions and its own shift."""
    rng = np.random.default_rng([seed, curve, unit.shape[1]])
    axes = np.linalg.qr(rng.standard_normal((unit.shape[1], min(DIMS, unit.shape[1]))))[0]
    at = ((unit - centre) @ axes / (3 * spread) + 1) / 2 * 0.75 + rng.uniform(0, 0.25, axes.shape[1])
    return hilbert_index(np.clip((at * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each row pair in double precision; equal vectors give equal values."""
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def encode(unit: np.ndarray) -> np.ndarray:
    """8-bit codes of unit vectors, each followed by its scale (a 32-bit float); bytes by rows."""
    scale = np.abs(unit).max(axis=1, keepdims=True).astype("<f4") / np.float32(127)
    return np.concatenate([np.rint(unit / scale).astype(np.int8).view(np.uint8), scale.view(np.uint8)], axis=1)


def decode(data: bytes, dim: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, dim + 4)
    return raw[:, :dim].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, dim:]).view("<f4")


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _by_dim(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a batch (columns dim and v) by length: the length, their places, their vectors."""
    dims, data = np.array(_column(batch, "dim"), np.int64), _column(batch, "v")
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, np.frombuffer(b"".join([data[i] for i in at]), kind).reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of large components
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _top(rough: np.ndarray, ids: np.ndarray, own: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the ``m`` best columns of each row, its own id left out."""
    rough = np.where(own[:, None] == ids[None, :], -9.0, rough)
    m = min(m, rough.shape[1])
    at = np.argpartition(-rough, m - 1, axis=1)[:, :m]
    row, col = np.repeat(np.arange(len(own)), m), at.ravel()
    good = rough[row, col] > -8
    return row[good], ids[col[good]], rough[row, col][good].astype(np.float64)


def _points(rows: DataFrame, k: int, modulus: int) -> DataFrame:
    """The distinct vectors with the k+1 smallest ids that have each, and whether one is a query.

    Copies of one vector are ranked before they are exchanged, so that a hot one sends k+1 rows a task.
    """
    rows = rows.distinct().withColumn("q", F.pmod("id", F.lit(modulus)) == 0)
    place = F.row_number().over(Window.partitionBy("dim", "v", "q").orderBy("id"))
    few = rows.withColumn("n", place).where(F.col("n") <= k + 1).groupBy("dim", "v")
    few = few.agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"), F.max("q").alias("q"))
    return few.select(F.monotonically_increasing_id().alias("pid"), "dim", "q", "ids", "v")


def _centres(points: DataFrame, kind: str) -> dict[int, tuple[np.ndarray, float]]:
    """Mean and spread of the unit vectors of each length, over all of them; two sums a task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for dim, _, x in _by_dim(batch, kind):
                unit, own = _unit(x), sums.setdefault(dim, [0, np.zeros(dim)])
                own[0] += len(unit)
                own[1] += unit.sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([n for n, _ in sums.values()]), pa.array([s.tolist() for _, s in sums.values()])], names=["dim", "n", "s"])

    got = points.select("dim", "v").mapInArrow(run, "dim long, n long, s array<double>")
    got = got.select("dim", "n", F.posexplode("s").alias("i", "s")).groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    means: dict[int, np.ndarray] = {}
    for r in got:
        means.setdefault(r["dim"], np.zeros(r["dim"]))[r["i"]] = r["s"] / r["n"]
    # Unit vectors: what is left of 1 after the mean is their variance.
    return {d: (m, float(np.sqrt(max(1 - m @ m, 1e-12) / d))) for d, m in means.items()}


def _blocks(points: DataFrame, kind: str, centres: dict, curves: int, block: int, seed: int) -> DataFrame:
    """Rows (curve, dim, place, pids, codes, asks): ``block`` neighbouring vectors of a curve each, and
    which of them are queries; ``place`` counts the blocks of a curve from 0."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pids, asks = batch.column(0), batch.column(2)
            for dim, at, x in _by_dim(batch, kind):
                unit = _unit(x)
                codes = pa.array([c.tobytes() for c in encode(unit)], pa.binary())
                own = [pids.take(pa.array(at)), asks.take(pa.array(at)), codes]
                for c in range(curves):
                    key = curve_keys(unit, *centres[dim], c, seed)
                    flat = [pa.array(np.full(len(at), v, np.int64)) for v in (c, dim)]
                    yield pa.RecordBatch.from_arrays([*flat, pa.array(key), *own], names=["curve", "dim", "key", "pid", "q", "code"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["curve", "dim", "part", "number", "pids", "codes", "asks"]
        group, held, number = None, [], 0

        def close() -> pa.RecordBatch:
            pids, asks, codes = zip(*held)
            row = [*group, number, np.array(pids, "<i8").tobytes(), b"".join(codes), np.flatnonzero(asks).astype("<u4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=names)

        for batch in batches:
            for curve, dim, pid, q, code, part in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (group != (curve, dim, part) or len(held) == block):
                    yield close()
                    held, number = [], number + 1 if group == (curve, dim, part) else 0
                group = (curve, dim, part)
                held.append((pid, q, code))
        if held:
            yield close()

    keys = points.select("pid", "dim", "q", "v").mapInArrow(keyed, "curve long, dim long, key long, pid long, q boolean, code binary")
    size = points.agg(F.sum((F.col("dim") + 40) * curves)).first()[0] or 0
    order = ["curve", "dim", "key", "pid"]
    keys = keys.repartitionByRange(max(1, -(-size // PARTITION_BYTES)), *order).sortWithinPartitions(*order)
    keys = keys.select("curve", "dim", "pid", "q", "code", F.spark_partition_id().cast("long").alias("part"))
    found = materialize(keys.mapInArrow(cut, "curve long, dim long, part long, number long, pids binary, codes binary, asks binary"), "ann-blocks")
    parts = found.groupBy("curve", "dim", "part").agg((F.max("number") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("curve", "dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    found = found.join(small(parts), ["curve", "dim", "part"])
    return found.select("curve", "dim", (F.col("before") + F.col("number")).alias("place"), "pids", "codes", "asks")


def _truth(points: DataFrame, kind: str, k: int, sample: int) -> list[tuple[int, int]]:
    """(query, neighbour) pairs of the k nearest vectors of ``sample`` queries (those with the smallest
    hashes), by a scan of all vectors."""
    asked = points.where("q").orderBy(F.xxhash64("pid"), "pid").limit(sample).select("pid", "dim", "v").collect()
    queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in asked}:
        own = [r for r in asked if r["dim"] == dim]
        queries[dim] = np.array([r["pid"] for r in own]), _unit(np.frombuffer(b"".join(bytes(r["v"]) for r in own), kind).reshape(-1, dim).astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pids = batch.column(0).to_numpy()
            for dim, at, x in _by_dim(batch, kind):
                if dim in queries:
                    own, q = queries[dim]
                    row, near, score = _top(q @ _unit(x).T, pids[at], own, k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(near), pa.array(score)], names=["query", "near", "score"])

    found = points.select("pid", "dim", "v").mapInArrow(run, "query long, near long, score double")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "near"))
    return [(r["query"], r["near"]) for r in found.withColumn("n", best).where(F.col("n") <= k).collect()]


def reach_for(blocks: DataFrame, truth: list[tuple[int, int]], recall: float) -> int:
    """The least number of blocks on either side with which windows hold ``recall`` of the pairs."""
    if not truth:
        return 0
    wanted = np.unique(np.array(truth).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(2).to_pylist()
            pids = np.frombuffer(b"".join(data), "<i8")
            row = np.repeat(np.arange(len(data)), [len(x) // 8 for x in data])
            hit = np.isin(pids, wanted)
            rows = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pids[hit])], names=["curve", "place", "pid"])

    at: dict[int, dict[int, int]] = {}
    for r in blocks.select("curve", "place", "pids").mapInArrow(run, "curve long, place long, pid long").collect():
        at.setdefault(r["pid"], {})[r["curve"]] = r["place"]
    apart = sorted(min(abs(place - at[b][c]) for c, place in at[a].items()) for a, b in truth)
    return apart[min(len(apart) - 1, int(np.ceil(recall * len(apart))) - 1)]


class _Window:
    """The best that some queries have met in the blocks of one stretch of a curve."""

    def __init__(self, own: np.ndarray, codes: np.ndarray, m: int):
        self.own, self.codes, self.m = own, codes, m
        self.near, self.rough = np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0), np.float32)

    def meet(self, pids: np.ndarray, vectors: np.ndarray) -> None:
        rough = np.where(self.own[:, None] == pids[None, :], np.float32(-9), self.codes @ vectors.T)
        near = np.concatenate([self.near, np.broadcast_to(pids, rough.shape)], axis=1)
        rough = np.concatenate([self.rough, rough], axis=1)
        if rough.shape[1] > self.m:
            at = np.argpartition(-rough, self.m - 1, axis=1)[:, : self.m]
            near, rough = np.take_along_axis(near, at, axis=1), np.take_along_axis(rough, at, axis=1)
        self.near, self.rough = near, rough

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, col = np.nonzero(self.rough > -8)
        return self.own[row], self.near[row, col], self.rough[row, col].astype(np.float64)


def _window_search(blocks: DataFrame, reach: int, m: int) -> DataFrame:
    """(query, near, rough): the ``m`` best of each query's window on each curve.

    Blocks and the queries that have to meet them are dealt by stretches of ZONE blocks, and a
    stretch is walked in the curve's order; a window that lies in two stretches brings its best of each.
    """

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for curve, dim, place, pids, codes, asks in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(asks, "<u4")
                if len(own):
                    ids = np.frombuffer(pids, "<i8")[own].tobytes()
                    raw = np.frombuffer(codes, np.uint8).reshape(-1, dim + 4)[own].tobytes()
                    # Each stretch that the window touches is told once, at its first block there.
                    first = max(0, place - reach)
                    starts = [first, *range((first // ZONE + 1) * ZONE, place + reach + 1, ZONE)]
                    out += [(curve, dim, p // ZONE, p, place, ids, raw) for p in starts]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["curve", "dim", "zone", "place", "home", "pids", "codes"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, open_ = None, {}

        def close(until: int | None) -> Iterator[pa.RecordBatch]:
            done = [h for h in open_ if until is None or h + reach < until]
            found = [open_.pop(h).rows() for h in done]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["query", "near", "rough"])

        for batch in batches:
            for curve, dim, zone, place, home, pids, codes in zip(*(c.to_pylist() for c in batch.columns)):
                if group != (curve, dim, zone):
                    yield from close(None)
                    group = (curve, dim, zone)
                ids, vectors = np.frombuffer(pids, "<i8"), decode(codes, dim)
                if home >= 0:
                    open_[home] = _Window(ids, vectors, m)
                    continue
                yield from close(place)
                for window in open_.values():
                    window.meet(ids, vectors)
        yield from close(None)

    names = ["curve", "dim", "zone", "place", "home", "pids", "codes"]
    asked = blocks.mapInArrow(packets, "curve long, dim long, zone long, place long, home long, pids binary, codes binary")
    # A block comes after the queries that are told at its place.
    bodies = blocks.select("curve", "dim", F.floor(F.col("place") / ZONE).alias("zone"), "place", F.lit(-1).cast("long").alias("home"), "pids", "codes")
    met = bodies.union(asked).withColumn("last", F.col("home") < 0).repartition("curve", "dim", "zone")
    met = met.sortWithinPartitions("curve", "dim", "zone", "place", "last", "home").select(*names)
    return met.mapInArrow(search, "query long, near long, rough double")


def nearest(
    vectors: DataFrame, k: int = 5, query_modulus: int = 50, curves: int = 64, block: int = 128, recall: float = 0.96, sample: int = 128, seed: int = 2,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """The k nearest other rows (largest cosine, ties to the smaller id) of each row whose id is
    divisible by ``query_modulus``, with a share of about ``recall`` of them found.

    Returns query_id, rank (from 1), vec_id, score.  Vectors that are null, zero or hold null or
    non-finite components, and rows without an id, take no part; vectors are compared with those
    of their own length only; fewer than k candidates give fewer rows; one id with several rows
    is compared by each of them, its best counts.  Equal vectors are one point of the index, which
    names the k+1 smallest ids that have it.  ``sample``: queries whose neighbours are found by a
    scan to set the windows.  Empty table: no rows.
    """
    kind = "<f4" if isinstance(vectors.schema[vec_col].dataType.elementType, FloatType) else "<f8"
    schema = "query_id long, rank int, vec_id long, score double"
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vec_col) if kind == "<f4" else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    ).select("id", F.size("v").cast("long").alias("dim"), "v")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.asarray(x, kind).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["id", "dim", "v"])

    rows = materialize(rows.mapInArrow(packed, "id long, dim long, v binary"), "ann-vectors")
    points = materialize(_points(rows, k, query_modulus), "ann-points")
    blocks = _blocks(points, kind, _centres(points, kind), curves, block, seed)
    reach = reach_for(blocks, _truth(points, kind, k, sample), recall)

    rough = _window_search(blocks, reach, k + 3).groupBy("query", "near").agg(F.max("rough").alias("rough"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rough"), "near"))
    pairs = rough.withColumn("n", best).where(F.col("n") <= 4 * k).select("query", "near")
    pairs = pairs.union(points.where("q").select(F.col("pid").alias("query"), F.col("pid").alias("near")))  # its own copies
    pairs = pairs.join(points.select(F.col("pid").alias("query"), "dim", F.col("v").alias("qv")), "query")
    pairs = pairs.join(points.select(F.col("pid").alias("near"), "ids", "v"), "near").select("query", "dim", "ids", "qv", "v")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, asked = np.zeros(batch.num_rows), _column(batch, "qv")
            for dim, at, x in _by_dim(batch, kind):
                score[at] = cosines(np.frombuffer(b"".join([asked[i] for i in at]), kind).reshape(-1, dim).astype(np.float64), x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score)], names=["query", "ids", "score"])

    near = pairs.mapInArrow(rerank, "query long, ids array<long>, score double").select("query", F.explode("ids").alias("id"), "score")
    near = near.groupBy("query", "id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    near = near.withColumn("n", place).where(F.col("n") <= k + 1).groupBy("query").agg(F.collect_list(F.struct("id", "score")).alias("near"))

    # Every id of a point asks; a hot point's ids are dealt over salts.
    salted = points.where("q").select("pid", "dim", F.md5("v").alias("name"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asking = rows.where(F.pmod("id", F.lit(query_modulus)) == 0).select("id", "dim", F.md5("v").alias("name"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    near = near.join(salted, near["query"] == salted["pid"]).select("dim", "name", "salt", "near")
    found = asking.distinct().join(near, ["dim", "name", "salt"]).select(F.col("id").alias("query_id"), F.explode("near").alias("x")).where("x.id <> query_id")
    found = found.groupBy("query_id", F.col("x.id").alias("vec_id")).agg(F.max("x.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(*(c.split()[0] for c in schema.split(", ")))
