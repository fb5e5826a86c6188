"""Signed edge tables: (source, target, weight), one row per unordered pair once canonical."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Persons of a ballot that meet in one task.
BALLOT_BLOCK = 1_000
#: Most rows of a table of vertices (a few numbers each) that is sent to every task instead of dealing the edges.
VERTEX_ROWS = 1_000_000
#: Persons, and votes, of a block; every two blocks are compared in one task, so many persons at a time.
PERSON_BLOCK, VOTE_BLOCK, TILE = 4_096, 1_000_000, 1_024
#: A column of votes is multiplied as a dense one if it marks at least this share of a tile's pairs.
DENSE_SHARE, DENSE_COLUMNS, SPARSE_PAIRS = 1 / 1_200, 2_048, 1 << 22
#: Most labels for which edges are summed where two blocks are compared; of more, from the edges' rows.
SUMMED_LABELS = 256


def checkpoint(df: DataFrame) -> DataFrame:
    """Write to the folder all executors share, so that iterations keep a short lineage.  Only a local
    session may leave the folder unset."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "signalloom-shared")
    path = f"{base.rstrip('/')}/signalloom/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df`` (rows of a few values) with a broadcast hint if it has at most ``most_rows`` rows."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def by_vertex(df: DataFrame) -> DataFrame:
    """A table of vertices, to be joined to edges: most often there are far more edges."""
    return small(df, VERTEX_ROWS)


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``name``: 0.. in the given order.  Rows are range-partitioned and numbered inside each
    partition; only the partitions' counts meet in one task."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpoint(placed.withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_place", 33)))
    parts = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", before.alias("_before"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(small(parts), "_part").withColumn(name, F.col("_before") + inside).select(*df.columns, name)


def canonical(edges: DataFrame) -> DataFrame:
    """Order endpoints, sum parallel edges, drop self loops and zero weights."""
    pair = edges.where("source <> target").groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"))
    return pair.agg(F.sum("weight").alias("weight")).where("weight <> 0")


def negative_wins(edges: DataFrame) -> DataFrame:
    """One sign per unordered pair; zero counts as positive, a conflict as negative."""
    sign = F.when(F.col("weight") < 0, -1).otherwise(1)
    pair = edges.where("source <> target").groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"))
    return pair.agg(F.min(sign).cast("double").alias("weight"))


def signed(edges: DataFrame) -> DataFrame:
    return edges.where("weight <> 0").withColumn("weight", F.signum("weight"))


def closure(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, as (v, u, weight), without repeats."""
    a = edges.select(F.col("source").alias("v"), F.col("target").alias("u"), "weight")
    b = edges.select(F.col("target").alias("v"), F.col("source").alias("u"), "weight")
    return a.union(b).distinct()


def directed(edges: DataFrame) -> DataFrame:
    """Both directions of a canonical table; no exchange."""
    ends = F.array(F.struct(F.col("source").alias("v"), F.col("target").alias("u")), F.struct(F.col("target").alias("v"), F.col("source").alias("u")))
    return edges.select(F.explode(ends).alias("e"), "weight").select("e.v", "e.u", "weight")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("v")).distinct()


def dense_ids(edges: DataFrame) -> DataFrame:
    """(node, vid) with vid 0.. in node order."""
    return numbered(checkpoint(vertices(edges).withColumnRenamed("v", "node")), ["node"], "vid")


def remap(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends replaced by their ids (node, vid)."""
    one, two = ids.select(F.col("node").alias("source"), F.col("vid").alias("_a")), ids.select(F.col("node").alias("target"), F.col("vid").alias("_b"))
    return edges.join(one, "source").join(two, "target").select(F.col("_a").alias("source"), F.col("_b").alias("target"), "weight")


def restore(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """Labels (v, label) of ids as labels of the nodes that they stand for."""
    return labels.join(ids.withColumnRenamed("vid", "v"), "v").select(F.col("node").alias("v"), "label")


def vertex_edge_counts(edges: DataFrame) -> DataFrame:
    """(n_vertices, n_edges) of a table with one row per edge, which is read once."""
    ends = directed(edges).groupBy("v").agg(F.count("*").alias("n"))
    return ends.agg(F.count("*").alias("n_vertices"), F.coalesce(F.call_function("shiftright", F.sum("n"), F.lit(1)), F.lit(0)).alias("n_edges"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(v, dp, dm): positive and negative degree; vertices of ``nodes`` without edges have zeros."""
    got = directed(edges).groupBy("v").agg(F.count_if(F.col("weight") > 0).alias("dp"), F.count_if(F.col("weight") < 0).alias("dm"))
    return got if nodes is None else nodes.select("v").join(got, "v", "left").fillna(0, ["dp", "dm"])


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = by_vertex(nodes.select("v"))
    return edges.join(ids.withColumnRenamed("v", "source"), "source", "left_semi").join(ids.withColumnRenamed("v", "target"), "target", "left_semi").select("source", "target", "weight")


def without_vertices(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = by_vertex(nodes.select("v"))
    return edges.join(ids.withColumnRenamed("v", "source"), "source", "left_anti").join(ids.withColumnRenamed("v", "target"), "target", "left_anti").select("source", "target", "weight")


def without_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    gone = pairs.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"))
    return edges.join(gone, ["source", "target"], "left_anti")


def covote_edges(votes: DataFrame, threshold: float = 0.75, min_support: int = 3) -> DataFrame:
    """Signed edges between persons (person, ballot, x): agreement on common ballots strictly
    above the threshold or below its complement.  Several votes on a ballot are averaged; an
    average of 0 is absence."""
    x, ballots, blocks = _cast(votes)
    if not blocks:
        return _edges_by_ballot(x, threshold, min_support)
    return _edges_by_block(x, ballots, blocks, threshold, min_support)


def covote_directed(votes: DataFrame, threshold: float = 0.75, min_support: int = 3) -> DataFrame:
    """``directed`` of ``covote_edges``, both directions made where two blocks are compared.  A vertex's edges of
    one sign come together there, so that v and weight are written as runs."""
    x, ballots, blocks = _cast(votes)
    if not blocks:
        return directed(_edges_by_ballot(x, threshold, min_support))
    person = x.schema["person"].dataType.simpleString()
    return _met_blocks(x, ballots, blocks).groupBy("_one", "_two").applyInArrow(_both_directions(threshold, min_support), f"v {person}, u {person}, weight double")


def covote_sums(votes: DataFrame, labels: DataFrame, threshold: float = 0.75, min_support: int = 3) -> DataFrame | None:
    """(v, near, plus, minus): how many positive and negative edges of ``covote_edges`` join v to persons of
    label ``near``, counted where two blocks are compared, so that an edge makes no row.  ``labels`` (v, label)
    has one row a person at most.  None if edges are to be summed from their rows: few persons meet, or there
    are very many labels."""
    x, ballots, blocks = _cast(votes)
    if not blocks or labels.select("label").distinct().limit(SUMMED_LABELS + 1).count() > SUMMED_LABELS:
        return None
    met = _met_blocks(x, ballots, blocks, labels)
    person, label = x.schema["person"].dataType.simpleString(), labels.schema["label"].dataType.simpleString()
    sums = met.groupBy("_one", "_two").applyInArrow(_sum_blocks(threshold, min_support), f"v {person}, near {label}, plus double, minus double")
    return sums.groupBy("v", "near").agg(F.sum("plus").alias("plus"), F.sum("minus").alias("minus"))


def _cast(votes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Averaged votes (person, ballot, x) and ballots, both written, and the number of blocks in which persons
    are compared (0: so few meet that their votes are joined)."""
    x = votes.where("person is not null and ballot is not null").groupBy("person", "ballot").agg(F.avg("x").alias("x")).where("x <> 0")
    x = checkpoint(x)
    ballots = checkpoint(x.groupBy("ballot").agg(F.count("*").alias("n")))
    votes_cast, meetings = ballots.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2), F.lit(0.0))).first()
    blocks = max(1, -(-x.select("person").distinct().count() // PERSON_BLOCK), -(-votes_cast // VOTE_BLOCK))
    # Blocks of persons are read once for each other block; where few persons meet, that is more than their meetings.
    return x, ballots.select("ballot"), 0 if meetings <= votes_cast * blocks else blocks


def _edges_by_ballot(x: DataFrame, threshold: float, min_support: int) -> DataFrame:
    """Co-voting edges of the votes (person, ballot, x) by a row for each meeting."""
    # Persons of a large ballot are dealt into blocks, and every two blocks meet in a group of their own.
    large = x.groupBy("ballot").count().where(F.col("count") > BALLOT_BLOCK).select("ballot", F.ceil(F.col("count") / BALLOT_BLOCK).cast("int").alias("blocks"))
    x = x.join(small(large), "ballot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    x = x.withColumn("own", F.pmod(F.xxhash64("person"), F.col("blocks")).cast("int"))
    a = x.select("ballot", F.col("own").alias("one"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("two"), F.col("person").alias("pa"), F.col("x").alias("xa"))
    b = x.select("ballot", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("one"), F.col("own").alias("two"), F.col("person").alias("pb"), F.col("x").alias("xb"))
    met = a.join(b, ["ballot", "one", "two"]).where("pa < pb or one < two")
    pairs = met.groupBy(F.least("pa", "pb").alias("source"), F.greatest("pa", "pb").alias("target"))
    pairs = pairs.agg(F.count("*").alias("support"), F.avg(F.when(F.col("xa") == F.col("xb"), F.lit(1.0)).otherwise(F.lit(0.0))).alias("ratio"))
    sign = F.when(F.col("ratio") > threshold, F.lit(1.0)).when(F.col("ratio") < 1 - threshold, F.lit(-1.0))
    return pairs.where(F.col("support") >= min_support).withColumn("weight", sign).where("weight is not null")


def _common(a: np.ndarray, at_a: np.ndarray, n_a: int, b: np.ndarray, at_b: np.ndarray, n_b: int) -> np.ndarray:
    """How many keys rows share: entries (key, row) of two sides, each at most once, as a matrix n_a x n_b."""
    order = np.argsort(a, kind="stable")
    a, at_a = a[order], at_a[order]
    keys, first_a, count_a = np.unique(a, return_index=True, return_counts=True)
    order = np.argsort(b, kind="stable")
    b, at_b = b[order], at_b[order]
    first_b = np.searchsorted(b, keys)
    count_b = np.searchsorted(b, keys, "right") - first_b
    pairs = count_a * count_b
    dense, sparse = np.flatnonzero(pairs >= n_a * n_b * DENSE_SHARE), np.flatnonzero((pairs > 0) & (pairs < n_a * n_b * DENSE_SHARE))
    out = np.zeros((n_a, n_b), np.int32)
    for at in range(0, len(dense), DENSE_COLUMNS):
        own = dense[at : at + DENSE_COLUMNS]
        sides = []
        for rows, n, first, count in ((at_a, n_a, first_a[own], count_a[own]), (at_b, n_b, first_b[own], count_b[own])):
            side = np.zeros((n, len(own)), np.float32)
            column = np.repeat(np.arange(len(own)), count)
            side[rows[np.arange(len(column)) + np.repeat(first - (np.cumsum(count) - count), count)], column] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int32)  # below 2,048, so exact
    ends = np.cumsum(pairs[sparse])
    while len(sparse):
        upto = max(1, int(np.searchsorted(ends, (ends[0] - pairs[sparse[0]]) + SPARSE_PAIRS, "right")))
        own, sparse, ends = sparse[:upto], sparse[upto:], ends[upto:]
        total = np.cumsum(pairs[own])
        key = np.repeat(np.arange(len(own)), pairs[own])
        place = np.arange(len(key)) - (total - pairs[own])[key]
        flat = at_a[first_a[own][key] + place // count_b[own][key]].astype(np.int64) * n_b + at_b[first_b[own][key] + place % count_b[own][key]]
        out += np.bincount(flat, minlength=n_a * n_b).reshape(n_a, n_b).astype(np.int32)
    return out


def _zipped(column: np.ndarray) -> bytes:
    """Byte planes, zipped: the high bytes of small numbers take almost no room."""
    return zlib.compress(np.ascontiguousarray(column).view(np.uint8).reshape(len(column), -1).T.tobytes())


def _unzipped(data: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _pack_block(votes: pa.Table) -> pa.Table:
    """A block's votes (block, person, ballot, x) as one row: its persons, and zipped columns by ballot and
    person, persons as steps from one to the next, values by number (a block is sent to every other, so its size counts)."""
    person = votes.column("person").combine_chunks().dictionary_encode()
    ballot, x = votes.column("ballot").to_numpy(), votes.column("x").to_numpy()
    place = person.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((place, ballot))
    values, code = np.unique(x[order].astype(np.float64), return_inverse=True)
    packed = [_zipped(c) for c in (ballot[order].astype(np.int64), np.diff(place[order], prepend=0).astype(np.int32), code.astype(np.int32), values)]
    persons = pa.ListArray.from_arrays(pa.array([0, len(person.dictionary)], pa.int32()), person.dictionary)
    row = pa.Table.from_arrays([votes.column("block").combine_chunks()[:1], persons, *(pa.array([c], pa.binary()) for c in packed)], names=["block", "persons", "ballots", "places", "xs", "values"])
    if "label" in votes.column_names:
        labels = votes.column("label").combine_chunks().take(pa.array(np.unique(place, return_index=True)[1]))
        row = row.append_column("labels", pa.ListArray.from_arrays(pa.array([0, len(labels)], pa.int32()), labels))
    return row


def _unpack_block(batch: pa.RecordBatch, i: int) -> tuple:
    """(block, persons, ballots, places, xs) of a packed row."""
    ballots, steps, code, values = (_unzipped(batch.column(c)[i].as_py(), t) for c, t in (("ballots", np.int64), ("places", np.int32), ("xs", np.int32), ("values", np.float64)))
    return batch.column("block")[i].as_py(), batch.column("persons")[i].values, ballots, np.cumsum(steps, dtype=np.int32), values[code]


def _tiles(rows: list[tuple], threshold: float, min_support: int) -> Iterator[tuple]:
    """Two blocks' pairs of persons (one row: the block with itself, each pair once), so many persons of the first at
    a time: (low, keep, support, ratio), matrices of persons from ``low`` on by those of the second block."""
    (_, names_a, ballots_a, places_a, xs_a), (_, names_b, ballots_b, places_b, xs_b) = rows[0], rows[-1]
    values, names = np.unique(np.concatenate((xs_a, xs_b))), np.unique(np.concatenate((ballots_a, ballots_b)))
    ballots_a, ballots_b = np.searchsorted(names, ballots_a), np.searchsorted(names, ballots_b)
    votes_a, votes_b = (ballots * len(values) + np.searchsorted(values, xs) for ballots, xs in ((ballots_a, xs_a), (ballots_b, xs_b)))
    for low in range(0, len(names_a), TILE):
        own, n = (places_a >= low) & (places_a < low + TILE), min(TILE, len(names_a) - low)
        place = places_a[own] - low
        support = _common(ballots_a[own], place, n, ballots_b, places_b, len(names_b))
        agreed = _common(votes_a[own], place, n, votes_b, places_b, len(names_b))
        ratio = agreed / np.maximum(support, 1)
        keep = (support >= max(1, min_support)) & ((ratio > threshold) | (ratio < 1 - threshold))
        if len(rows) == 1:
            keep &= (np.arange(n) + low)[:, None] < np.arange(len(names_b))
        yield low, keep, support, ratio


def _compare_blocks(threshold: float, min_support: int):
    """A function of two blocks' rows that yields their edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((_unpack_block(b, i) for b in batches for i in range(b.num_rows)), key=lambda r: r[0])
        names_a, names_b = rows[0][1], rows[-1][1]
        for low, keep, support, ratio in _tiles(rows, threshold, min_support):
            flat = np.flatnonzero(keep)
            ratio = ratio.ravel()[flat]
            columns = [names_a.take(pa.array(flat // len(names_b) + low)), names_b.take(pa.array(flat % len(names_b))), pa.array(support.ravel()[flat].astype(np.int64)), pa.array(ratio), pa.array(np.where(ratio > threshold, 1.0, -1.0))]
            yield pa.RecordBatch.from_arrays(columns, names=["pa", "pb", "support", "ratio", "weight"])

    return run


def _both_directions(threshold: float, min_support: int):
    """A function of two blocks' rows that yields (v, u, weight) of their edges in both directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((_unpack_block(b, i) for b in batches for i in range(b.num_rows)), key=lambda r: r[0])
        names_a, names_b = rows[0][1], rows[-1][1]
        for low, keep, _, ratio in _tiles(rows, threshold, min_support):
            tile = names_a.slice(low, len(keep))
            for weight, hit in ((1.0, keep & (ratio > threshold)), (-1.0, keep & ~(ratio > threshold))):
                for names_v, names_u, pairs in ((tile, names_b, hit), (names_b, tile, np.ascontiguousarray(hit.T))):
                    v, u = np.nonzero(pairs)
                    yield pa.RecordBatch.from_arrays([names_v.take(pa.array(v)), names_u.take(pa.array(u)), pa.array(np.full(len(v), weight))], names=["v", "u", "weight"])

    return run


def _sum_blocks(threshold: float, min_support: int):
    """A function of two blocks' rows with labels that yields (v, near, plus, minus) of their edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((*_unpack_block(b, i), b.column("labels")[i].values) for b in batches for i in range(b.num_rows)), key=lambda r: r[0])
        sides, kinds = (rows[0], rows[-1]), pa.chunked_array([r[5] for r in rows]).unique().drop_null()
        # Which label a person has, as a matrix; counts stay below 2 ** 24, so sums of products are exact.
        marks_a, marks_b = (np.stack([pc.fill_null(pc.equal(side[5], k), False).to_numpy(zero_copy_only=False) for k in kinds] or [np.zeros(len(side[5]))], 1).astype(np.float32) for side in sides)
        sums_a, sums_b = (np.zeros((2, *marks.shape), np.float32) for marks in (marks_a, marks_b))
        for low, keep, _, ratio in _tiles([r[:5] for r in rows], threshold, min_support):
            upto = low + len(keep)
            for sign, hit in enumerate((keep & (ratio > threshold), keep & ~(ratio > threshold))):
                hit = hit.astype(np.float32)
                sums_a[sign, low:upto] = hit @ marks_b
                sums_b[sign] += hit.T @ marks_a[low:upto]
        for side, sums in zip(sides, (sums_a, sums_b)):
            v, kind = np.nonzero(sums.any(axis=0))
            columns = [side[1].take(pa.array(v)), kinds.take(pa.array(kind)), *(pa.array(s[v, kind].astype(np.float64)) for s in sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["v", "near", "plus", "minus"])

    return run


def _met_blocks(x: DataFrame, ballots: DataFrame, blocks: int, labels: DataFrame | None = None) -> DataFrame:
    """The votes (person, ballot, x) as packed blocks of persons, with their labels if given, each dealt to every
    pair of blocks that it is in (_one, _two)."""
    ids = checkpoint(ballots.withColumn("_ballot", F.monotonically_increasing_id()))
    columns = ["block", "person", "ballot", "x"]
    votes = x.join(small(ids), "ballot").select(F.pmod(F.xxhash64("person"), F.lit(blocks)).cast("int").alias("block"), "person", F.col("_ballot").alias("ballot"), "x")
    schema = f"block int, persons array<{x.schema['person'].dataType.simpleString()}>, ballots binary, places binary, xs binary, values binary"
    if labels is not None:
        votes = votes.join(by_vertex(labels.select(F.col("v").alias("person"), "label")), "person", "left")
        columns, schema = [*columns, "label"], f"{schema}, labels array<{labels.schema['label'].dataType.simpleString()}>"
    packed = checkpoint(votes.select(*columns).groupBy("block").applyInArrow(_pack_block, schema))
    met = packed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.withColumns({"_one": F.least("block", "_other"), "_two": F.greatest("block", "_other")}).drop("_other")
    return met.repartition(blocks * (blocks + 1) // 2, "_one", "_two")  # a number given, so that none are merged for being short


def _edges_by_block(x: DataFrame, ballots: DataFrame, blocks: int, threshold: float, min_support: int) -> DataFrame:
    """Co-voting edges of the votes (person, ballot, x): persons are dealt into blocks, and every two blocks
    are compared as matrices, so that meetings are counted without a row for each."""
    person = x.schema["person"].dataType.simpleString()
    edges = _met_blocks(x, ballots, blocks).groupBy("_one", "_two").applyInArrow(_compare_blocks(threshold, min_support), f"pa {person}, pb {person}, support long, ratio double, weight double")
    return edges.select(F.least("pa", "pb").alias("source"), F.greatest("pa", "pb").alias("target"), "support", "ratio", "weight")


def event_votes(events: DataFrame, ballot: str = "hour") -> DataFrame:
    """Votes from events: a person's vote on an hour, or on a day and event type."""
    what = F.date_trunc("hour", "ts") if ballot == "hour" else F.concat_ws(":", F.date_format("ts", "yyyy-MM-dd"), "event_type")
    return events.select(F.col("user_id").alias("person"), what.alias("ballot"), F.when(F.col("value") > 50, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("x"))


#: Legislative periods with their first and last days.
PERIODS = {
    17: ("2009-10-27", "2013-10-21"), 18: ("2013-10-22", "2017-10-22"), 19: ("2017-10-23", "2021-10-25"), 20: ("2021-10-26", "2025-03-24"), 21: ("2025-03-25", "2100-01-01"),
}


def in_periods(votes: DataFrame, selected: list[int], periods: dict[int, tuple[str, str]] = PERIODS, filename: str = "filename") -> DataFrame:
    """Votes whose file's date lies in one of the selected periods (none selected: all votes).

    ValueError for a period that is not known; a file name without a date lies in none.
    """
    unknown = [p for p in selected if p not in periods]
    if unknown:
        raise ValueError(f"periods {unknown} are not among {sorted(periods)}")
    if not selected:
        return votes
    day = F.try_to_date(F.regexp_extract(filename, r"^(\d{8})", 1), "yyyyMMdd")
    hit = F.lit(False)
    for p in selected:
        hit = hit | day.between(F.to_date(F.lit(periods[p][0])), F.to_date(F.lit(periods[p][1])))
    return votes.where(F.coalesce(hit, F.lit(False)))


def anonymise(votes: DataFrame, name: str = "person", drop: tuple[str, ...] = ("Name", "Vorname", "Bezeichnung")) -> DataFrame:
    """Replace the name by an id, 0.. in name order, and drop other naming columns."""
    ids = numbered(votes.select(name).distinct(), [name], "person_id")
    return votes.join(ids, name).drop(name, *drop)


def votes_to_graph(votes: DataFrame, selected: list[int], threshold: float = 0.75, periods: dict[int, tuple[str, str]] = PERIODS) -> tuple[DataFrame, DataFrame]:
    """Anonymised votes of the selected periods, and the signed edges between their persons.

    ``votes``: filename, Bezeichnung (the person's name), janein (ja or nein), further columns.
    """
    anonymous = checkpoint(anonymise(in_periods(votes, selected, periods), "Bezeichnung"))
    x = F.when(F.col("janein") == "ja", F.lit(1.0)).otherwise(F.lit(-1.0))
    return anonymous, covote_edges(anonymous.select(F.col("person_id").alias("person"), F.col("filename").alias("ballot"), x.alias("x")), threshold)
