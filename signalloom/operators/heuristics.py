"""Labelling heuristics: bulk sweeps over the edge table, and whole sequential runs in parallel."""

from __future__ import annotations

import heapq
import time
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashrand import uniform
from .graph import by_vertex, checkpoint, directed, numbered, vertices
from .labels import affinity_of, gumbel_label, neighbour_sums

TRACE_SCHEMA = "run_id string, epoch int, edge_weight double, current double, best_batch double, best double, current_plus_neg double, epochs_since_restart int, temperature double, runtime_ms long"


def chunks(nodes: DataFrame, n_chunks: int, seed: int, epoch: int) -> DataFrame:
    """(v, chunk): a seeded permutation cut into at most n_chunks chunks of ceil(n / n_chunks)."""
    ordered = numbered(checkpoint(nodes.select("v", uniform(seed, epoch, F.col("v")).alias("_u"))), ["_u", "v"], "_at")
    size = -(-ordered.count() // n_chunks)
    return ordered.select("v", F.floor(F.col("_at") / max(1, size)).cast("int").alias("chunk"))


def sweep_round(edges: DataFrame, labels: DataFrame, matrix: DataFrame, seed: int, epoch: int, temperature: float = 0.0, damping: float = 0.5, gains: bool = False) -> DataFrame:
    """One bulk round: each vertex that gains by moving to its best (or sampled) label moves with
    probability ``damping``, decided by hash.  ``gains`` adds what the best label gains."""
    return swept(neighbour_sums(edges, labels), labels, matrix, seed, epoch, temperature, damping, gains)


def swept(near: DataFrame, labels: DataFrame, matrix: DataFrame, seed: int, epoch: int, temperature: float = 0.0, damping: float = 0.5, gains: bool = False) -> DataFrame:
    """``sweep_round`` from ``neighbour_sums``."""
    aff = affinity_of(near, matrix)
    if temperature > 0:
        best = gumbel_label(aff, temperature, seed, epoch).withColumnRenamed("label", "best").withColumn("gain", F.lit(1.0))
    else:
        both = aff.join(by_vertex(labels.select("v", F.col("label").alias("now"))), "v").groupBy("v")
        top = both.agg(F.max(F.struct("affinity", (-F.col("label")).alias("l"))).alias("m"), F.max(F.when(F.col("label") == F.col("now"), F.col("affinity"))).alias("own"))
        best = top.select("v", (-F.col("m.l")).alias("best"), (F.col("m.affinity") - F.coalesce("own", F.lit(0.0))).alias("gain"))
    moves = (F.col("gain") > 0) & (uniform(seed, epoch, F.col("v"), F.lit("move")) < damping)
    return labels.join(best, "v", "left").select("v", F.when(moves, F.col("best")).otherwise(F.col("label")).cast("int").alias("label"), *(["gain"] if gains else []))


def bulk_sweep(
    edges: DataFrame, matrix: DataFrame, k: int, seed: int = 5, epochs: int = 40, patience: int = 5, initial_temperature: float = 0.0, factor: float = 0.6666, every: int = 5, timeout_s: float = 180.0
) -> tuple[DataFrame, list[dict]]:
    """Damped sweeps from hashed labels until no improvement for ``patience`` rounds; returns the
    best labelling seen and the trace.  At temperature 0 a labelling under which no vertex gains is
    the same in all later rounds, and ends the sweeps."""
    edges = checkpoint(edges.select("source", "target", "weight"))
    labels = checkpoint(vertices(edges).select("v", F.floor(uniform(seed, F.col("v")) * k).cast("int").alias("label")))
    best_labels, best, stale, t, trace, began = labels, None, 0, initial_temperature, [], time.time()
    for epoch in range(epochs):
        # Both ends of an edge count it, so that one pass over the edges serves the objective and the moves.
        near = checkpoint(neighbour_sums(edges, labels))
        own = near.join(by_vertex(labels), "v").join(F.broadcast(matrix), (F.col("label") == F.col("a")) & (F.col("near") == F.col("b")))
        halves = own.agg(*(F.coalesce(F.sum(F.when(F.col("overlap"), F.col(x)).otherwise(F.col(y))) / 2, F.lit(0.0)) for x, y in (("plus", "minus"), ("minus", "plus"))))
        agreed, disagreed = halves.first()
        if best is None or agreed > best:
            best, best_labels, stale = agreed, labels, 0
        trace.append({"epoch": epoch, "disagreement": disagreed, "best_agreement": best, "temperature": t})
        if stale > patience or time.time() - began > timeout_s:
            break
        stale += 1
        moved = checkpoint(swept(near, labels, matrix, seed, epoch, t, 0.5, True))
        if t == 0 and moved.where("gain > 0").isEmpty():
            break
        labels = moved.select("v", "label")
        t = t * factor if (epoch + 1) % every == 0 else t
    return best_labels, trace


def label_weights(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(v, near, w): the weight of v's edges to neighbours of label ``near``; the edges are read once."""
    near = directed(edges).join(by_vertex(labels.select(F.col("v").alias("u"), F.col("label").alias("near"))), "u")
    return checkpoint(near.groupBy("v", "near").agg(F.sum("weight").alias("w")))


def _moves(near: DataFrame, labels: DataFrame) -> DataFrame:
    """(v, label, delta) of all single-vertex moves among present labels, from ``label_weights``."""
    present = labels.select("label").distinct()
    own = labels.select("v", F.col("label").alias("old")).join(near.select("v", F.col("near").alias("old"), F.col("w").alias("w_old")), ["v", "old"], "left")
    moves = own.join(F.broadcast(present), F.col("old") != F.col("label")).join(near.withColumnRenamed("near", "label"), ["v", "label"], "left")
    return moves.withColumn("delta", F.coalesce("w_old", F.lit(0.0)) - F.coalesce("w", F.lit(0.0)))


def best_move(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The single-vertex move among present labels that lowers correlation-clustering violations
    most: (v, label, delta), ties to the smallest vertex and label."""
    return best_of(label_weights(edges, labels), labels)


def best_of(near: DataFrame, labels: DataFrame) -> DataFrame:
    """``best_move`` from ``label_weights``."""
    return _moves(near, labels).agg(F.min(F.struct("delta", "v", "label")).alias("m")).select("m.v", "m.label", "m.delta")


def local_search(edges: DataFrame, labels: DataFrame, rounds: int | None = None) -> DataFrame:
    """Improving moves until none lowers the violations (or for ``rounds`` rounds): in a round each
    vertex whose best move lowers them more than those of its neighbours moves (ties to the smaller
    vertex), so no two neighbours move at once and the deltas add up."""
    labels, done = checkpoint(labels), 0
    while rounds is None or done < rounds:
        best = _moves(label_weights(edges, labels), labels).where("delta < -1e-9").groupBy("v").agg(F.min(F.struct("delta", "label")).alias("m"))
        best = checkpoint(best.select("v", F.col("m.delta").alias("delta"), F.col("m.label").alias("new")))
        if best.isEmpty():
            break
        other = best.select(F.col("v").alias("u"), F.col("delta").alias("other"))
        beaten = directed(edges).select("v", "u").join(best, "v").join(other, "u").where("u <> v and struct(other, u) < struct(delta, v)").select("v").distinct()
        moved = best.join(beaten, "v", "left_anti").select("v", "new")
        labels = checkpoint(labels.join(moved, "v", "left").select("v", F.coalesce("new", "label").cast("int").alias("label")))
        done += 1
    return labels


def contract(edges: list[tuple[int, int, float]], target: int = 0) -> dict[int, int]:
    """Greedy additive edge contraction of one in-memory graph: {vertex: cluster}, the cluster
    named by its smallest vertex.  Heaviest edge (as 32-bit float) first, ties to smaller ends; with a
    target, merging goes on through positive edges and stops at a negative one once at most
    ``target`` clusters are left; without, it stops at weight 0."""
    near: dict[int, dict[int, float]] = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = near.get(x, {}).get(y, 0.0) + w
    heap = [(-np.float32(w), a, b) for a in near for b, w in near[a].items() if a < b]
    heapq.heapify(heap)
    members = {v: [v] for v in near}
    while heap:
        w, a, b = heapq.heappop(heap)
        if a not in near or near[a].get(b) is None or -np.float32(near[a][b]) != w:
            continue  # gone or changed since
        if (-w <= 0) if target == 0 else (len(near) <= target and -w < 0):
            break
        if len(near[a]) < len(near[b]):
            a, b = b, a
        members[a] += members.pop(b)
        for u, x in near.pop(b).items():
            del near[u][b]
            if u != a:
                near[a][u] = near[u][a] = near[a].get(u, 0.0) + x
                heapq.heappush(heap, (-np.float32(near[a][u]), min(a, u), max(a, u)))
    return {v: min(own) for own in members.values() for v in own}


def gaec(graphs: DataFrame, target: int = 0) -> DataFrame:
    """Contract each graph of (graph_id, source, target, weight), graphs in parallel."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        got = contract(list(zip(group["source"].tolist(), group["target"].tolist(), group["weight"].tolist())), target)
        return pd.DataFrame({"graph_id": [group["graph_id"].iloc[0]] * len(got), "v": list(got), "label": list(got.values())})

    return graphs.groupBy("graph_id").applyInPandas(run, "graph_id string, v long, label long")


def gaic_run(edges: np.ndarray, weights: np.ndarray, n: int, overlap: np.ndarray, config: dict, seed: int):
    """One sequential run on a dense-id graph: best labels and the trace rows.

    A label's affinity is what a vertex would agree with among labelled neighbours.  Vertices of
    a chunk are unlabelled, then labelled one by one, most certain first; at positive temperature
    labels are sampled instead of taken greedily.
    """
    if n == 0:
        return np.zeros(0, np.int64), []
    rng, k, began = np.random.default_rng(seed), len(overlap), time.time()
    ends, other = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    order = np.argsort(ends, kind="stable")
    first, near, w = np.searchsorted(ends[order], np.arange(n + 1)), other[order], np.concatenate([weights, weights])[order]
    aff, labels, rank = np.zeros((n, k)), np.full(n, -1), rng.permutation(n)
    ties = rng.random((n, k))
    plus, minus = overlap.astype(float), 1.0 - overlap

    def push(v: int, sign: float) -> np.ndarray:
        at = slice(first[v], first[v + 1])
        add = np.where((w[at] > 0)[:, None], plus[labels[v]], minus[labels[v]]) * np.abs(w[at])[:, None]
        np.add.at(aff, near[at], sign * add)
        return near[at]

    def assign(chunk: np.ndarray, t: float) -> float:
        waiting, won = set(chunk.tolist()), 0.0
        key = lambda v: (-max(0, int(np.floor(aff[v].max()))), -int(rank[v]), int(v))
        heap = [key(v) for v in waiting]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            v = top[2]
            if v not in waiting or top != key(v):
                continue
            waiting.discard(v)
            if t > 0:
                labels[v] = int((aff[v] / max(t, 1e-12) + rng.gumbel(size=k)).argmax())
            else:
                labels[v] = int(np.lexsort((ties[v], aff[v]))[-1])
            won += aff[v, labels[v]]
            for u in {*push(v, 1.0).tolist()} & waiting:
                heapq.heappush(heap, key(u))
        return won

    def reassign(chunk: np.ndarray, t: float) -> float:
        """Take the chunk's labels away and give them anew; what that gains."""
        lost = 0.0
        rank[chunk] = rng.permutation(len(chunk))
        for v in chunk:
            lost += aff[v, labels[v]]
            ties[v] = rng.random(k)
            push(v, -1.0)
            labels[v] = -1
        return assign(chunk, t) - lost

    progress = _Progress(config, float(np.abs(weights).sum()), float(-weights[weights < 0].sum()))
    progress.start(assign(np.arange(n), progress.temperature(0)), labels)
    parts = -(-n // -(-n // config["num_reassignment_chunks"]))
    while progress.goes_on():
        order = rng.permutation(n) if progress.epoch else np.arange(n)
        t = progress.temperature(progress.epoch)
        for part in range(parts):
            size = -(-n // config["num_reassignment_chunks"])
            progress.gain(reassign(order[part * size : (part + 1) * size], t), labels)
        progress.end_epoch(t)
    return progress.best_labels, progress.trace


class _Progress:
    """What a run has reached: the objective now, the best one, and how long ago the batch's best was."""

    def __init__(self, config: dict, total: float, negative: float):
        self.config, self.total, self.negative, self.began = config, total, negative, time.time()
        self.trace: list[tuple] = []
        self.epoch = self.idle = 0

    def temperature(self, epochs_done: int) -> float:
        """It falls after every ``temperature_decay_epochs`` epochs."""
        return self.config["initial_temperature"] * self.config["temperature_decay_factor"] ** (epochs_done // max(1, self.config["temperature_decay_epochs"]))

    def start(self, agreement: float, labels: np.ndarray) -> None:
        self.now = self.best = agreement
        self.best_labels, self.batch_best = labels.copy(), 0.0
        self._log(0, agreement, self.temperature(0))

    def goes_on(self) -> bool:
        """Epochs are left, time is left, and the last improvement is not too long ago."""
        enough = self.epoch + 1 < self.config["num_epochs"] and self.idle <= self.config["early_stopping_epochs"]
        return enough and time.time() - self.began <= self.config["timeout_s"]

    def gain(self, gained: float, labels: np.ndarray) -> None:
        self.now += gained
        if self.now > self.batch_best:
            self.batch_best, self.idle = self.now, 0
        if self.now > self.best:
            self.best, self.best_labels = self.now, labels.copy()

    def end_epoch(self, t: float) -> None:
        self.epoch += 1
        self._log(self.epoch, self.batch_best, t)
        self.idle += 1

    def _log(self, epoch: int, batch_best: float, t: float) -> None:
        passed = int((time.time() - self.began) * 1000)
        missing = [self.total - x for x in (self.now, batch_best, self.best)]
        self.trace.append((epoch, self.total, *missing, self.total - self.negative - self.now, self.idle, t, passed))


#: Edges of a graph that is sent to every run; the benchmark's largest has 2,014,053.
MOST_EDGES = 10_000_000


def gaic_grid(edges: DataFrame, runs: list[dict]) -> DataFrame:
    """Sequential runs of a grid, one task each: the trace of every run.  ``runs`` hold run_id, seed,
    intervals and the solver's parameters.  Each run works on the whole graph, which is broadcast
    once; ValueError above MOST_EDGES edges (``bulk_sweep`` is for larger graphs)."""
    spark = edges.sparkSession
    edges = checkpoint(edges.select("source", "target", "weight"))
    if edges.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        raise ValueError(f"the graph has more than {MOST_EDGES} edges")
    table = edges.orderBy("source", "target").toPandas()
    nodes, dense = np.unique(np.concatenate([table["source"], table["target"]]), return_inverse=True)
    sent = spark.sparkContext.broadcast((dense.reshape(2, -1).T, table["weight"].to_numpy(float), len(nodes), runs))

    def run(batches):
        pairs, weights, n, all_runs = sent.value
        for batch in batches:
            for i in batch["id"]:
                r = all_runs[i]
                s, e = (np.array(x, np.float32) for x in zip(*r["intervals"]))
                overlap = (s[None, :] <= e[:, None]) & (s[:, None] <= e[None, :])
                _, trace = gaic_run(pairs, weights, n, overlap, r, r["seed"])
                yield pd.DataFrame([(r["run_id"], *t) for t in trace], columns=[c.split()[0] for c in TRACE_SCHEMA.split(", ")])

    return spark.range(0, len(runs), 1, max(1, len(runs))).mapInPandas(run, TRACE_SCHEMA)


#: Sizes of the shipped structures, and the configurations with their first temperature and chunks.
CHAINS, CLUSTERS = (4, 6, 8, 10, 12, 14, 16), (2, 4, 6, 8, 10, 12, 14, 16)
CONFIGS = {"gaia_chunks_10": (0.0, 10), "gaia_chunks_100": (0.0, 100), "venus_chunks_10": (100.0, 10), "venus_chunks_100": (100.0, 100)}
LIMITS = {"num_epochs": 10_000, "timeout_s": 180, "early_stopping_epochs": 50, "temperature_decay_factor": 0.6666, "temperature_decay_epochs": 5}


def run_grid(spark: SparkSession, instances: list[str], seeds: int = 50) -> DataFrame:
    """Every run of the benchmark: instance, structure, intervals, configuration, its parameters, seed."""
    structs = spark.createDataFrame([("intervals", k) for k in CHAINS] + [("clusters", k) for k in CLUSTERS], "struct string, k int")
    configs = spark.createDataFrame([(c, t, n) for c, (t, n) in CONFIGS.items()], "config string, initial_temperature double, chunks int")
    names = spark.createDataFrame([(x,) for x in instances], "instance string")
    return names.crossJoin(structs).crossJoin(configs).crossJoin(spark.range(1, seeds + 1).select(F.col("id").cast("int").alias("seed")))


def grid_runs(grid: DataFrame) -> list[dict]:
    """The rows of a grid (thousands) as runs for ``gaic_grid``."""
    from .labels import chain, clusters

    return [
        LIMITS | {
            "run_id": f"{r['instance']}-{r['struct']}{r['k']}-{r['config']}-{r['seed']}", "seed": r["seed"], "initial_temperature": r["initial_temperature"],
            "num_reassignment_chunks": r["chunks"], "intervals": (chain if r["struct"] == "intervals" else clusters)(r["k"]),
        }
        for r in grid.collect()
    ]


def map_clusters(edges: DataFrame, labels: DataFrame, intervals: list[tuple[float, float]]) -> tuple[dict[int, int], float]:
    """The best of all assignments of clusters to intervals (equally many, up to 8) and its
    violations; the first in lexicographic order of those that tie.  Edges are summed per pair of
    clusters first, so a permutation costs k*k."""
    from .labels import labelled

    sums = labelled(edges, labels).groupBy("la", "lb").agg(F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("weight") < 0, -F.col("weight")).otherwise(0.0)).alias("m"))
    return map_pairs(sums, labels, intervals)


def map_pairs(sums: DataFrame, labels: DataFrame, intervals: list[tuple[float, float]]) -> tuple[dict[int, int], float]:
    """``map_clusters`` from the weights (la, lb, p, m) of positive and negative edges between clusters."""
    rows = sums.collect()  # at most k*k
    names = sorted({r["v"] for r in labels.select(F.col("label").alias("v")).distinct().collect()})
    if len(names) != len(intervals):
        raise ValueError(f"{len(names)} clusters and {len(intervals)} intervals")
    if len(names) > 8:
        raise ValueError("all permutations are tried for up to 8 clusters")
    at = {v: i for i, v in enumerate(names)}
    table = [(at[r["la"]], at[r["lb"]], r["p"], r["m"]) for r in rows]
    s, e = zip(*intervals)
    best, best_perm = float("inf"), None
    for perm in permutations(range(len(names))):
        cost = 0.0
        for a, b, p, m in table:
            x, y = perm[a], perm[b]
            cost += m if a == b or (s[y] < e[x] and s[x] < e[y]) else p
        if cost < best:
            best, best_perm = cost, perm
    return {v: best_perm[at[v]] for v in names}, best


def embed_exact(edges: list[tuple[int, int, int]]) -> tuple[int, dict[int, tuple[int, int]]]:
    """Fewest edges that free intervals (pairwise distinct starts) must violate, and intervals that
    reach it: over all start orders each vertex picks its end on its own.  Up to 8 vertices."""
    return embed_within(edges, float("inf"))[:2]


def embed_within(edges: list[tuple[int, int, int]], limit_s: float) -> tuple[int, dict[int, tuple[int, int]], bool]:
    """The best embedding found in ``limit_s`` seconds, and whether it is known to be the best of all."""
    nodes = sorted({v for a, b, _ in edges for v in (a, b)})
    if len(nodes) > 8:
        raise ValueError("all start orders are tried for up to 8 vertices")
    sign = {frozenset((a, b)): s for a, b, s in edges}
    best, found, end = len(edges) + 1, {}, time.time() + limit_s
    for order in permutations(nodes):
        if found and time.time() > end:
            return best, found, False
        cost, ends = 0, {}
        for i, v in enumerate(order):
            run, top, reach, plus = 0, 0, i, 0
            for j in range(i + 1, len(order)):
                s = sign.get(frozenset((v, order[j])), 0)
                run, plus = run + s, plus + (s > 0)
                if run > top:
                    top, reach = run, j
            cost += plus - top
            ends[v] = (2 * i, 2 * reach + 1)
        if cost < best:
            best, found = cost, ends
    return best, found, True


def synthetic_graph(spark: SparkSession, intervals: list[tuple[float, float]], n_per_interval: int, m_frac: float, p: float, seed: int) -> DataFrame:
    """Planted signed graph: pairs kept with probability m_frac, signed by their intervals' strict
    overlap with probability p and against it otherwise.  A vertex's block is v // n_per_interval."""
    pairs = planted_pairs(spark, intervals, n_per_interval, seed).where(F.col("keep") < m_frac)
    return pairs.select("source", "target", F.when(F.col("meets") == (F.col("right") < p), F.lit(1.0)).otherwise(F.lit(-1.0)).alias("weight"))


def planted_pairs(spark: SparkSession, intervals: list[tuple[float, float]], n_per_interval: int, seed: int) -> DataFrame:
    """All pairs with the two uniform numbers (``keep``, ``right``) that a planted graph is drawn by, and
    whether their blocks' intervals overlap."""
    n = len(intervals) * n_per_interval
    s, e = zip(*intervals)
    arr = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    pairs = spark.range(n).select(F.col("id").alias("source")).select("source", F.explode(F.sequence(F.col("source") + 1, F.lit(n))).alias("target")).where(F.col("target") < n)
    block = lambda c: F.floor(F.col(c) / n_per_interval).cast("int")
    meets = (F.get(arr(s), block("source")) < F.get(arr(e), block("target"))) & (F.get(arr(s), block("target")) < F.get(arr(e), block("source")))
    draw = lambda name: uniform(seed, F.lit(name), F.col("source"), F.col("target"))
    return pairs.select("source", "target", meets.alias("meets"), draw("keep").alias("keep"), draw("sign").alias("right"))


#: The generator's sweep.
SWEEP_P, SWEEP_M, SWEEP_N = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0), (0.2, 0.4, 0.6, 0.8, 1.0), 100


def synthetic_sweep(spark: SparkSession, intervals: list[tuple[float, float]], n_per_interval: int = SWEEP_N, seed: int = 5) -> DataFrame:
    """Planted graphs of every p and m_frac: n_per_interval, m_frac, p, source, target, weight, and
    ``planted`` (whether the planted labelling agrees).  The grid has 30 rows."""
    pairs = planted_pairs(spark, intervals, n_per_interval, seed)
    grid = spark.createDataFrame([(n_per_interval, m, p) for m in SWEEP_M for p in SWEEP_P], "n_per_interval int, m_frac double, p double")
    drawn = pairs.join(F.broadcast(grid), F.col("keep") < F.col("m_frac")).withColumn("planted", F.col("right") < F.col("p"))
    return drawn.select("n_per_interval", "m_frac", "p", "source", "target", F.when(F.col("meets") == F.col("planted"), F.lit(1.0)).otherwise(F.lit(-1.0)).alias("weight"), "planted")


def leaf_order(distances: dict[tuple[str, str], float]) -> list[str]:
    """Order of up to 8 columns with the shortest path through them; of orders that tie the first by name."""
    names = sorted({x for pair in distances for x in pair})
    if len(names) > 8:
        raise ValueError("all orders are tried for up to 8 columns")
    apart = {**distances, **{(b, a): d for (a, b), d in distances.items()}}
    return list(min(permutations(names), key=lambda order: (round(sum(apart[p] for p in zip(order, order[1:])), 9), order)))
