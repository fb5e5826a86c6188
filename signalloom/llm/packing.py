"""Lexical retrieval packing.

Documents are tokenized once and written.  Document frequencies and the mean length are taken over
all documents.  The BM25 index is sharded by topic: every document goes to the one of ``pivots``
sampled documents that scores best for its terms, and within a pivot documents lie in the order of
their heaviest terms, so that neighbours lie together; Spark range-partitions that order, and runs of
``docs_per_shard`` documents are the shards.  In its shard each window's seed document is scored by
all its distinct terms against every unused document, and the best ones fill the window.  A
document cut by a window's end seeds the next one.  Work and memory of a shard are bounded, and the
number of shards grows with the input.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder

END_ID = 1
K1, B = 1.2, 0.75
#: A shard ends at so many tokens too, so that long documents do not make it large.
SHARD_TOKENS = 1 << 23
#: Terms in at least this part of a shard's documents are scored by matrix products (so many terms at
#: a time), the others by their postings (so many pairs at a time).
COMMON, COLUMNS, MEETINGS = 48, 4096, 1 << 20
#: Rows of the sample that sets the bounds of the range partitions: for each partition, and at most.
BOUND_ROWS, MOST_BOUND_ROWS = 100, 1_000_000
PLACED = "doc_id long, ids binary, _id long, _h long, _key long, _part int"
PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def tokenize(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (with the end id), ids (little-endian unsigned 16-bit) of every whole text; and a row
    with n = -1 for each task, whose ids are the document frequencies of its rows (64-bit, by term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, end, df = encoder(path).encode_all, end_id.to_bytes(2, "little"), np.zeros(1 << 16, "<i8")
        names, none = ["doc_id", "n", "ids"], True
        for batch in batches:
            encoded = encode_all(batch.column(1))
            for a in range(0, batch.num_rows, 256):
                ids, none = [x + end for x in islice(encoded, 256)], False
                for x in ids:
                    df[counts_of(np.frombuffer(x, "<u2"))[0]] += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=names)
        if not none:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([df.tobytes()])], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n long, ids binary")


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for own in batch.column(0).to_pylist():
            df += np.frombuffer(own, "<i8")
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(df[at])], names=["term", "df"])


def counts_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, ascending, and how often each occurs (16-bit numbers sort by radix)."""
    ids = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return ids[first], np.diff(np.append(first, len(ids)))


class Bm25:
    """Weights of terms in documents, from statistics of the whole corpus."""

    def __init__(self, df: np.ndarray, n_docs: int, mean: float):
        self.idf, self.mean = np.log1p((n_docs - df + 0.5) / (df + 0.5)), mean

    def weights(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct terms of each document, one after the other, what each adds to the score of a
        query that has it, and how many each document has."""
        terms, counts = zip(*map(counts_of, docs))
        n = np.array([len(t) for t in terms])
        terms, count, length = np.concatenate(terms), np.concatenate(counts), np.repeat([len(d) for d in docs], n)
        return terms, (count / (count + K1 * (1 - B + B * length / self.mean)) * (K1 + 1) * self.idf[terms]).astype(np.float32), n

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """BM25 of each document (columns) for all distinct terms of each document (rows); a term that
        no other document has is left out, as it counts only on the diagonal."""
        terms, weights, n = self.weights(docs)
        owner = np.repeat(np.arange(len(docs)), n)
        df = np.bincount(terms, minlength=1 << 16)
        out = np.zeros((len(docs), len(docs)), np.float32)
        common_from = max(2, len(docs) // COMMON)
        common = np.flatnonzero(df >= common_from)
        for a in range(0, len(common), COLUMNS):
            column = np.full(1 << 16, -1)
            part = common[a : a + COLUMNS]
            column[part] = np.arange(len(part))
            at = column[terms]
            hit = at >= 0
            has, has_weight = np.zeros((2, len(docs), len(part)), np.float32)
            has[owner[hit], at[hit]], has_weight[owner[hit], at[hit]] = 1, weights[hit]
            out += has @ has_weight.T
        rare = (df[terms] < common_from) & (df[terms] > 1)
        order = np.argsort(terms[rare], kind="stable")
        t, d, w = terms[rare][order], owner[rare][order], weights[rare][order]
        first, n = np.searchsorted(t, t), df[t]
        flat, ends = out.reshape(-1), np.cumsum(n)
        at = 0
        while at < len(t):
            # Each posting meets all postings of its term; some at a time.
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + MEETINGS, side="right")))
            k = n[at:to]
            other = np.repeat(first[at:to] - np.cumsum(k) + k, k) + np.arange(k.sum())
            np.add.at(flat, d[other] * len(docs) + np.repeat(d[at:to], k), np.repeat(w[at:to], k))
            at = to
        return out


class Pivots:
    """Places of documents in the index: the pivot that scores best, then the heaviest terms."""

    def __init__(self, bm25: Bm25, pivots: list[tuple[np.ndarray, np.ndarray]]):
        self.bm25 = bm25
        known = np.unique(np.concatenate([t for t, _ in pivots]))
        self.row = np.zeros(1 << 16, np.int32)
        self.row[known] = np.arange(1, len(known) + 1)
        self.matrix = np.zeros((len(known) + 1, len(pivots)), np.float32)
        for j, (t, w) in enumerate(pivots):
            self.matrix[self.row[t], j] = w

    def keys(self, docs: list[np.ndarray]) -> list[int]:
        terms, weights, n = self.bm25.weights(docs)
        first = np.cumsum(n) - n
        has = np.zeros((len(docs), len(self.matrix)), np.float32)
        has[np.repeat(np.arange(len(docs)), n), self.row[terms]] = 1
        pivots = (has @ self.matrix).argmax(axis=1).tolist()
        out = []
        for a, m, pivot in zip(first.tolist(), n.tolist(), pivots):
            own = weights[a : a + m]
            heavy = int(own.argmax())
            own[heavy] = -1
            out.append(pivot << 32 | int(terms[a + heavy]) << 16 | int(terms[a + own.argmax()]))
        return out


class Windows:
    """Fills one window after another; a document that a window's end cuts opens the next."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.open: list[tuple] = []  # pieces of the open window: doc_id, ids, start, length
        self.filled = 0

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        """Rows of the windows that this document fills."""
        rows, start = [], 0
        while start < len(ids):
            take = min(len(ids) - start, self.window - self.filled)
            self.open.append((doc_id, ids, start, take))
            start, self.filled = start + take, self.filled + take
            if self.filled == self.window:
                rows += self.close()
        return rows

    def close(self) -> list[tuple]:
        """Rows of the open window, which ends here."""
        rows, at = [], 0
        for doc_id, ids, start, length in self.open:
            crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
            rows.append((doc_id, start, length, crc, len(ids), self.sequence, at))
            at += length
        self.open, self.filled, self.sequence = [], 0, self.sequence + 1
        return rows


def fill_order(scores: np.ndarray, sizes: list[int], room: int, window: int) -> Iterator[int]:
    """Order in which a shard's documents fill windows: each window's seed brings its best unused
    neighbours (ties to the first); ``room`` tokens are left in the window open before."""
    free = np.zeros(len(sizes), np.float32)
    seed = None
    for _ in range(len(sizes)):
        d = int((free if seed is None else scores[seed] + free).argmax())
        yield d
        free[d] = -np.inf
        # A document that reaches a window's end is, or leaves, the seed of the next.
        if seed is None or sizes[d] >= room:
            seed = d
        room = window - (sizes[d] - room) % window if sizes[d] >= room else room - sizes[d]


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = END_ID, docs_per_shard: int = 4096, pivots: int = 64,
    tokens_per_partition: int = 1 << 24, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Every token, the end id included, lies in exactly one piece.  Only each partition's last window
    is short.  A null or empty text is its end id alone; repeated rows
    and rows with the same id are packed each on its own; null ids are kept; an empty table gives
    no rows; other columns are ignored.  ``pivots``: size of the sample (smallest hashes of the ids)
    that the index is routed by; it bounds what the driver holds, every document is indexed.
    """
    tokens = materialize(tokenize(docs, tokenizer_path, end_id, id_col, text_col).withColumn("_id", F.monotonically_increasing_id()), "pack-tokens")
    counted = tokens.where("n < 0").select("ids")
    tokens = tokens.where("n >= 0")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    stats = tokens.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).first()
    if not stats["docs"]:
        return tokens.select(*(F.col("n" if c != "doc_id" else c).alias(c) for c in PIECES))
    # At most 2**16 rows, one for each token id.
    counts = counted.mapInArrow(_document_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(1 << 16, np.int64)
    for r in counts:
        df[r["term"]] = r["df"]
    bm25 = Bm25(df, stats["docs"], stats["tokens"] / stats["docs"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [bm25.weights([np.frombuffer(x, "<u2")]) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i].tobytes() for x in got], pa.binary()) for i in (0, 1)], names=["terms", "weights"])

    sample = tokens.select("ids", F.xxhash64(F.lit(10), "ids").alias("_h"), "_id").orderBy("_h", "_id").limit(pivots).select("ids")
    sample = sample.mapInArrow(weigh, "terms binary, weights binary").collect()
    router = Pivots(bm25, [(np.frombuffer(r["terms"], "<u2"), np.frombuffer(r["weights"], np.float32)) for r in sample])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                keys = router.keys([np.frombuffer(x, "<u2") for x in part.column(1).to_pylist()])
                ranges = [bisect_right(bounds, k) for k in zip(keys, part.column(3).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.int64()), pa.array(ranges, pa.int32())], names=["doc_id", "ids", "_id", "_h", "_key", "_part"])

    rows = tokens.select("doc_id", "ids", "_id", F.xxhash64("ids").alias("_h"))
    n_parts = max(1, -(-stats["tokens"] // tokens_per_partition))
    # Bounds of the ranges from a sample, which sets their evenness and nothing else.  The row's number in
    # the order lets a hot group of copies spread over partitions.
    order, bounds = ["_key", "_h", "_id"], []
    if n_parts > 1:
        share = min(1.0, BOUND_ROWS * n_parts / stats["docs"], MOST_BOUND_ROWS / stats["docs"])
        some = sorted(tuple(r) for r in rows.sample(share, 10).mapInArrow(place, PLACED).select(*order, F.octet_length("ids")).collect())
        # Quantiles by tokens, as documents differ in length.
        upto = np.cumsum([x[-1] for x in some])
        bounds = [some[k][:-1] for k in np.searchsorted(upto, upto[-1] * np.arange(1, n_parts) / n_parts)] if some else []
    placed = rows.mapInArrow(place, PLACED).repartitionById(len(bounds) + 1, "_part").sortWithinPartitions(*order).select("doc_id", "ids", "_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, held, size = None, [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=PIECES)

        def pack_shard() -> Iterator[pa.RecordBatch]:
            rows, arrays = [], [ids for _, ids in held]
            for d in fill_order(bm25.scores(arrays), [len(x) for x in arrays], window - windows.filled, window):
                rows += windows.add(*held[d])
            if rows:
                yield batch_of(rows)

        for batch in batches:
            for doc_id, ids, part in zip(*(c.to_pylist() for c in batch.columns)):
                if windows is None:
                    windows = Windows(window, part << 40)
                held.append((doc_id, np.frombuffer(ids, "<u2")))
                size += len(ids) // 2
                if len(held) == docs_per_shard or size >= SHARD_TOKENS:
                    yield from pack_shard()
                    held, size = [], 0
        if held:
            yield from pack_shard()
        if windows is not None and windows.open:
            yield batch_of(windows.close())

    return placed.mapInArrow(run, schema)
