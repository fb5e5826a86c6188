"""Near-duplicate detection with bottom-k sketches from one hash function.

1. Every document becomes the set of its distinct word 5-shingles, hashed to 64 bits; equal sets
   form a class, represented once.
2. The k smallest hashes of a class are its sketch.  Inverted lists are kept on runs of retained
   values (see RUN), so that a passage shared by many documents makes no long list.
3. Lists never emit all their pairs: members meet their list's leader (the most central member
   first), links are verified, and lists that lie in one component are done.  After these
   rounds only lists that still span components compare members across components, and emit the pairs
   that set sizes and parity bitmaps allow: an exact bound, so no link is lost.  A pair that meets in
   many lists is emitted by the first of them only.
4. A pair is kept if the union sketch's estimate allows it, and is a link if the full sets say so.
"""

from __future__ import annotations

import functools
import hashlib
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, hot_keys, materialize, small
from .graph_cc import components

SHINGLE = 5
K = 64
#: An inverted list's key is a run of so many neighbouring retained values: 4 where the threshold
#: is at least 0.85, else 3.  Of pairs exactly on the threshold, 1.0e-8 share no run of 4 among 64
#: values at 0.85, and 1.3e-10 no run of 3 at 0.8 (below 0.8 more: 4e-7 at 0.7).
RUN, LOW_RUN, LOW = 4, 3, 85
#: Sets up to this size are keyed by runs of 2 as well, which makes the key exact for them.
SMALL, SMALL_RUN = 20, 2
#: Estimates this far below the threshold still go to exact verification; the estimate loses a pair
#: exactly on the threshold with probability 0.8e-8 at 0.85, 2e-8 at 0.8.
SLACK = 0.3
#: Members of a list and band that meet in one task when lists are compared across components.
DEAL = 1000
#: Words of a set's parity bitmap.  Two bitmaps differ in at most as many bits as the sets have
#: elements in which they differ, so their distance bounds the intersection from above.
BITMAP_WORDS = 8
_BITS = [f"w{i}" for i in range(BITMAP_WORDS)]
_SEGMENT = 1 << 20
#: Stands for a null id.
NO_ID = (1 << 63) - 1

_RNG = np.random.default_rng(20240517)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segment_words(b: np.ndarray) -> np.ndarray:
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    power, unpower = _power_tables(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * unpower[start] + (end - start).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words (runs without space or \\t..\\r) of the whole text, A-Z as a-z."""
    b = np.frombuffer(text, np.uint8)
    if len(b) <= _SEGMENT:
        return _segment_words(b)
    space, parts, at = np.flatnonzero((b == 32) | ((b >= 9) & (b <= 13))), [], 0
    while at < len(b):
        k = np.searchsorted(space, at + _SEGMENT)
        end = int(space[k]) if k < len(space) else len(b)
        parts.append(_segment_words(b[at:end]))
        at = end + 1
    return np.concatenate(parts)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the text's 5-word shingles; fewer words make one; none: empty."""
    if not text:
        return np.zeros(0, np.uint64)
    w = word_hashes(text)
    if len(w) == 0:
        return w
    n = min(SHINGLE, len(w))
    h = w[: len(w) - n + 1].copy()
    for j in range(1, n):
        h = mix(h) + w[j : len(w) - n + 1 + j]
    return np.unique(mix(h + np.uint64(n)))


def node_of(shingles: np.ndarray) -> int:
    """Identity of a class: a hash of its whole set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity_bitmap(shingles: np.ndarray) -> np.ndarray:
    """BITMAP_WORDS longs; a bit says whether an odd number of the set's elements fall on it."""
    odd = np.bincount((shingles % np.uint64(64 * BITMAP_WORDS)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def run_keys(sketch: np.ndarray, n: int, run: int) -> np.ndarray:
    """Keys of the inverted lists of a sketch (its retained values, ascending)."""
    out = []
    for r in (SMALL_RUN, run) if n <= SMALL else (run,):
        if len(sketch) >= r:
            h = np.full(len(sketch) - r + 1, r, np.uint64)
            for j in range(r):
                h = mix(h) + sketch[j : len(sketch) - r + 1 + j]
            out.append(mix(h))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def union_estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate: share of common values among the k smallest of both sketches' union."""
    both, count = np.unique(np.concatenate((a, b)), return_counts=True)
    full = len(a) < K and len(b) < K  # both sets are whole
    count = count if full else count[:K]
    return float((count == 2).sum()) / max(1, len(count))


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        for a in range(0, batch.num_rows, 512):
            sizes, nodes, sketches = [], [], []
            for text in texts.slice(a, 512).to_pylist():
                s = shingle_set(text)
                sizes.append(len(s))
                nodes.append(node_of(s))
                sketches.append(s[:K].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, 512), batch.column(2).slice(a, 512), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary())],
                names=["doc_id", "hash", "n", "node", "sketch"],
            )


def _entry_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes, sizes = [], [], []
            for node, n, sketch in zip(_column(batch, "node"), _column(batch, "n"), _column(batch, "sketch")):
                own = run_keys(np.frombuffer(sketch, np.uint64), n, length)
                keys.append(own)
                nodes.append(np.full(len(own), node, np.int64))
                sizes.append(np.full(len(own), n, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes))], names=["key", "node", "n"])

    return run


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            sets = [shingle_set(t) for t in batch.column(1).slice(a, 256).to_pylist()]
            nodes = batch.column(0).slice(a, 256)
            own = pa.array([node_of(s) == x for s, x in zip(sets, nodes.to_pylist())], pa.bool_())  # an id may have several texts
            bits = np.stack([parity_bitmap(s) for s in sets], axis=1) if sets else np.zeros((BITMAP_WORDS, 0), np.int64)
            yield pa.RecordBatch.from_arrays([nodes, pa.array([s.tobytes() for s in sets], pa.binary()), *map(pa.array, bits)], names=["node", "set", *_BITS]).filter(own)


def _estimate_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_column(batch, "sa"), _column(batch, "sb")):
                keep.append(union_estimate(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= percent / 100 - SLACK)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_column(batch, "sa"), _column(batch, "sb")):
                common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(100 * common >= percent * ((len(x) + len(y)) // 8 - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _across(lists: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in ``lists`` (key, node, comp, n), and that sizes and
    bitmaps (node, w0..) allow, each once: in the first of the lists and bands that both are in."""
    before = F.collect_list("key").over(Window.partitionBy("node").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    own = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent))))
    left = materialize(lists.join(bits, "node").withColumns({"before": before, "own": own}), "dup-left")
    left = left.withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    # A long list's members are dealt into blocks, each of which meets all members.
    long = left.groupBy("key", "band").count().where(F.col("count") > DEAL).select("key", "band", F.ceil(F.col("count") / DEAL).cast("int").alias("blocks"))
    left = left.join(small(long), ["key", "band"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    right = left.select("key", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("deal"), *(F.col(c).alias(f"{c}_b") for c in ("node", "comp", "n", "own", "before", *_BITS)))
    left = left.withColumn("deal", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    apart = functools.reduce(operator.add, (F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_b"))) for w in _BITS))
    most_common = F.least(F.col("n"), F.col("n_b"), F.call_function("shiftright", F.col("n") + F.col("n_b") - apart, F.lit(1)))
    return left.join(right, ["key", "band", "deal"]).where(
        (F.col("node") < F.col("node_b")) & (F.col("comp") != F.col("comp_b")) & (F.col("band") == F.greatest("own", "own_b"))
        & (most_common * 100 >= (F.col("n") + F.col("n_b") - most_common) * percent) & ~F.arrays_overlap("before", "before_b")
    ).select(F.col("node").alias("a"), F.col("node_b").alias("b"))


def duplicate_groups(docs: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id (the largest long where it is null), hash (of the text), n
    (shingles), node (its set), first (the smallest doc_id and hash of its component).

    A row is found again by its id and its text's hash, so rows that share an id stay apart.
    """
    data = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).withColumn("hash", F.xxhash64("text"))
    rows = materialize(data.mapInArrow(_sketch_batches, "doc_id long, hash long, n long, node long, sketch binary"), "dup-sketches")
    classes = rows.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "hash", "n", "sketch")).alias("c"), F.count("*").alias("copies"))
    classes = materialize(classes.select("node", "c.doc_id", "c.hash", "c.n", "c.sketch", "copies"), "dup-classes")

    entries = classes.select("node", "n", "sketch").mapInArrow(_entry_batches(RUN if percent >= LOW else LOW_RUN), "key long, node long, n long")
    lists = materialize(entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "dup-keys")
    in_lists = lists.agg(F.sum("c")).first()[0] or 0
    hot_lists = [r["key"] for r in lists.where(F.col("c") > max(in_lists / 1000, 10_000)).collect()]  # fewer than a thousand
    # A node that shares long lists is central: near copies of one text all meet that text.
    entries = hot_join(entries, lists, "key", hot_lists).withColumn("central", F.sum("c").over(Window.partitionBy("node"))).drop("c")
    entries = materialize(entries, "dup-lists")
    # Full sets of the classes that share a list with another, made from their texts again.  Rows
    # that equal each other in id and text are dealt.
    involved = entries.select("node").distinct().join(classes.select("node", "doc_id", "hash"), "node")
    involved = involved.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(15))))
    found = data.withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(16)).cast("int"))
    texts = involved.join(found, ["doc_id", "hash", "deal"]).select("node", "text")
    sets = texts.mapInArrow(_set_batches, "node long, set binary, " + ", ".join(f"{w} long" for w in _BITS))
    sets = materialize(sets.dropDuplicates(["node"]), "dup-sets")
    sketches = classes.select("node", "sketch")

    comps, hot_comps = None, []  # (node, comp) of nodes that are linked with another

    def located(frame: DataFrame) -> DataFrame:
        if comps is None:
            return frame.withColumn("comp", F.col("node"))
        return frame.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def verified(pairs: DataFrame) -> DataFrame:
        def with_both(frame, side, column):
            one = side.select(F.col("node").alias("b"), F.col(column).alias("sb"))
            two = side.select(F.col("node").alias("a"), F.col(column).alias("sa"))
            frame = hot_join(frame, one, "b", hot_keys(frame, "b"))
            return hot_join(frame, two, "a", hot_a).select("a", "b", "sa", "sb")

        pairs = materialize(pairs, "dup-pairs")
        hot_a = hot_keys(pairs, "a")
        near = materialize(with_both(pairs, sketches, "sketch").mapInArrow(_estimate_batches(percent), "a long, b long"), "dup-near")
        hot_a = hot_keys(near, "a")
        return materialize(with_both(near, sets, "set").mapInArrow(_verify_batches(percent), "a long, b long"), "dup-links")

    def absorb(links: DataFrame) -> None:
        nonlocal comps, hot_comps
        if comps is None:
            comps = components(links)
        else:
            a = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
            b = comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
            top = hot_join(hot_join(links, a, "a", hot_keys(links, "a"), "left"), b, "b", hot_keys(links, "b"), "left")
            merged = components(top.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
            seen = comps.unionByName(merged.select(F.col("comp").alias("node"), "comp"))
            seen = hot_join(seen, merged, "comp", hot_comps, "left").select("node", F.coalesce("root", "comp").alias("comp"))
            comps = materialize(seen.groupBy("node").agg(F.min("comp").alias("comp")), "dup-comps")
        hot_comps = hot_keys(comps, "comp")

    def open_lists(placed: DataFrame, leader) -> DataFrame:
        heads = placed.groupBy("key").agg(leader.alias("head"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        return heads.where("lo <> hi").select("key", "head")

    leaders = [F.max(F.struct("central", "node", "comp")), F.max(F.struct("node", "comp"))]
    for leader in leaders:
        placed = located(entries)
        if comps is not None:
            placed = materialize(placed, "dup-placed")
        met = hot_join(placed, open_lists(placed, leader), "key", hot_lists).where("comp <> head.comp")
        met = met.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()
        links = verified(met)
        if links.isEmpty():
            break
        absorb(links)
    placed = materialize(located(entries), "dup-placed")
    unresolved = hot_join(placed, open_lists(placed, F.min("node")).select("key"), "key", hot_lists)
    links = verified(_across(unresolved.select("key", "node", "comp", "n"), sets.select("node", *_BITS), percent))
    if not links.isEmpty():
        absorb(links)

    first = F.struct("doc_id", "hash").alias("first")
    if comps is None:
        own = classes.select("node", first)
    else:
        placed = classes.select("node", "doc_id", "hash").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        own = hot_join(placed, placed.groupBy("comp").agg(F.min(F.struct("doc_id", "hash")).alias("first")), "comp", hot_comps).select("node", "first")
    own = materialize(own, "dup-own")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    hot_nodes = [r["node"] for r in classes.where(F.col("copies") > max(total / 1000, 10_000)).select("node").collect()]  # fewer than a thousand
    filled = rows.where("n > 0").select("doc_id", "hash", "n", "node")
    blank = rows.where("n = 0").select("doc_id", "hash", "n", "node", first)
    return hot_join(filled, own, "node", hot_nodes).select(blank.columns).union(blank)


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose 5-word shingle sets have Jaccard similarity of ``percent``/100 or more.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id reached),
    kept (doc_id = component_id).  Null, empty or blank texts have no shingles and link with
    nothing; with fewer than five words the whole sequence is one shingle.  Repeated rows are
    linked copies; a null id never is a component's id unless all its ids are null, and is not
    kept; one id with several texts stands in each of their components.  Empty table: no rows.
    """
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return duplicate_groups(docs, percent, id_col, text_col).select(
        known("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), known("first.doc_id").alias("component_id"),
        F.coalesce(known("doc_id") == known("first.doc_id"), F.lit(False)).alias("kept"),
    )


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of which no smaller one is a near copy.

    Of each component the row with the smallest id, then text hash, stays; rows that equal it in id
    and text are one.  Rows that only share an id are documents of their own, rows without an id
    come after all others.  Texts without words stay, once for each id and text.
    """
    groups = duplicate_groups(docs, percent, id_col, text_col).where("doc_id = first.doc_id and hash = first.hash")
    kept = materialize(groups.groupBy("doc_id", "hash").agg(F.count("*").alias("copies")), "dup-kept")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.col(text_col).cast("binary")).alias("hash"))
    once = keyed.join(kept.where("copies = 1"), ["doc_id", "hash"], "left_semi")
    repeated = kept.where("copies > 1").select("doc_id", "hash")
    if not repeated.isEmpty():
        # Equal in id and text; one of each is taken before the exchange.
        again = keyed.join(small(repeated), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"])
        once = once.select("row").union(again.select("row"))
    return once.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
