"""Components, kernels and greedy deletion on signed graphs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _unzipped, _zipped, by_vertex, checkpoint, degrees, directed, induced, numbered, vertices, without_vertices

#: Edges that are thinned out at a time where only cuts matter.
CERTIFY = 1 << 21
#: Edges that are packed at a time, and vertices (a power of two) whose packed neighbours make a row.
PACKED, ROW_BITS = 1 << 20, 10


def plus_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(v, comp): smallest vertex reached over positive edges; min-label with pointer jumping."""
    edges = checkpoint(edges.select("source", "target", "weight"))
    nodes = vertices(edges) if nodes is None else nodes.select("v")
    plus = checkpoint(directed(edges.where("weight > 0")).select("v", "u"))
    labels = checkpoint(nodes.withColumn("comp", F.col("v")))
    while True:
        near = plus.join(by_vertex(labels.select(F.col("v").alias("u"), "comp")), "u").groupBy("v").agg(F.min("comp").alias("near"))
        step = labels.join(near, "v", "left").select("v", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        root = labels.select(F.col("v").alias("comp"), F.col("comp").alias("root"))
        step = checkpoint(step.join(root, "comp").select("v", "old", F.least("comp", "root").alias("comp")))
        labels = step.select("v", "comp")
        if step.where("comp < old").isEmpty():
            return labels


def drop_positive(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vertices that stay when those without negative edges go."""
    return degrees(edges, nodes).where("dm > 0").select("v")


def drop_two_mix(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return degrees(edges, nodes).where("not (dp = 1 and dm = 1)").select("v")


def kernelize(edges: DataFrame, unsafe: bool = False) -> DataFrame:
    """(v, kernel) of the exact kernels: drop vertices without negative edges, split by positive
    components, drop negative edges between components, until nothing changes.  ``unsafe`` also
    drops vertices with one edge of each sign, and splits at bridges, in the first round; if that
    leaves fewer than two parts, they are the result as they are."""
    return _kernelize(checkpoint(edges.select("source", "target", "weight")), unsafe)


def _kernelize(edges: DataFrame, first: bool = False) -> DataFrame:
    """``kernelize`` of edges that are written already."""
    nodes = checkpoint(vertices(edges))
    while True:
        kept = drop_positive(edges, nodes)
        if first:
            kept = drop_two_mix(induced(edges, kept), kept)
        kept = checkpoint(kept)
        whole = kept.count() == nodes.count()
        inner = edges if whole else induced(edges, kept)
        comps = plus_components(_thinned(inner.where("weight > 0")), kept)
        if first:
            comps = checkpoint(two_edge_components(inner, comps))
            kept = comps.select("v")
        alone = comps.select("comp").distinct().limit(2).count() < 2
        if alone and (first or whole):
            return comps.withColumnRenamed("comp", "kernel")
        a, b = comps.select(F.col("v").alias("source"), F.col("comp").alias("ca")), comps.select(F.col("v").alias("target"), F.col("comp").alias("cb"))
        if not alone:
            inner = inner.join(by_vertex(a), "source").join(by_vertex(b), "target").where("ca = cb").select("source", "target", "weight")
        smaller = checkpoint(inner)
        if not first and whole and smaller.count() == edges.count():
            return comps.withColumnRenamed("comp", "kernel")
        nodes, edges, first = kept, smaller, False


def leaf_peel(edges: DataFrame) -> DataFrame:
    """Vertices left after repeatedly dropping all with one positive and no negative edge."""
    edges = checkpoint(edges.select("source", "target", "weight"))
    nodes = checkpoint(vertices(edges))
    while True:
        gone = checkpoint(degrees(edges, nodes).where("dp = 1 and dm = 0").select("v"))
        if gone.isEmpty():
            return nodes
        nodes, edges = checkpoint(nodes.join(gone, "v", "left_anti")), checkpoint(without_vertices(edges, gone))


def max_ratio_vertex(edges: DataFrame, sign: int = 0) -> DataFrame:
    """The vertex of greatest sign imbalance (v, ratio, violated), ties to the smallest; ``sign``
    1 or -1 looks at positive or negative dominance only."""
    d = degrees(edges).withColumn("share", F.col("dp") / (F.col("dp") + F.col("dm")))
    ratio = {0: F.greatest("share", 1 - F.col("share")), 1: F.col("share"), -1: 1 - F.col("share")}[sign]
    violated = {0: F.least("dp", "dm"), 1: F.col("dm"), -1: F.col("dp")}[sign]
    best = d.withColumns({"ratio": ratio, "violated": violated}).agg(F.max(F.struct("ratio", (-F.col("v")).alias("m"), "violated")).alias("b"))
    return best.where("b is not null").select((-F.col("b.m")).alias("v"), F.col("b.ratio").alias("ratio"), F.col("b.violated").alias("violated"))


def _adjacency(group: pd.DataFrame) -> dict[int, dict[int, float]]:
    out: dict[int, dict[int, float]] = {}
    for a, b, w in zip(group["source"], group["target"], group["weight"]):
        out.setdefault(int(a), {})[int(b)] = float(w)
        out.setdefault(int(b), {})[int(a)] = float(w)
    return out


def _low_points(adj: dict[int, dict[int, float]], root: int, seen: dict[int, int]):
    """Depth-first order of a component: (bridges, cut vertices), iteratively."""
    low, bridges, cuts, kids = {root: len(seen)}, [], set(), 0
    seen[root] = len(seen)
    stack = [(root, None, iter(sorted(adj[root])))]
    while stack:
        v, parent, rest = stack[-1]
        for u in rest:
            if u == parent:
                continue
            if u in seen:
                low[v] = min(low[v], seen[u])
            else:
                seen[u] = low[u] = len(seen)
                stack.append((u, v, iter(sorted(adj[u]))))
                break
        else:
            stack.pop()
            if parent is not None:
                low[parent] = min(low[parent], low[v])
                if low[v] > seen[parent]:
                    bridges.append((parent, v))
                if parent == root:
                    kids += 1
                elif low[v] >= seen[parent]:
                    cuts.add(parent)
    return bridges, cuts | ({root} if kids > 1 else set())


def _by_component(edges: DataFrame, comps: DataFrame) -> DataFrame:
    comps = by_vertex(comps)
    a, b = comps.select(F.col("v").alias("source"), F.col("comp").alias("ca")), comps.select(F.col("v").alias("target"), F.col("comp").alias("cb"))
    return edges.join(a, "source").join(b, "target").where("ca = cb").select("source", "target", "weight", F.col("ca").alias("comp"))


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first..first+count-1 of each span, one span after the other."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Ascending, without repeats (faster than np.unique, which hashes)."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _breadth_first(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both directions of a graph's edges, sorted by ``a``: which of them lead up, and which down, an edge
    of a breadth-first forest."""
    if not len(a):
        return np.zeros(0, bool), np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    ids, count = a[first], np.diff(np.append(first, len(a)))
    to, root = np.searchsorted(ids, b), np.arange(len(ids))
    while True:
        low = np.minimum(root, np.minimum.reduceat(root[to], first))
        low = low[low]
        if (low == root).all():
            break
        root = low
    seen, parent = root == np.arange(len(ids)), np.full(len(ids), -1)
    level = np.flatnonzero(seen)
    while len(level):
        x, y = np.repeat(level, count[level]), to[_spans(first[level], count[level])]
        x, y = x[~seen[y]], y[~seen[y]]
        parent[y], seen[y] = x, True
        level = _distinct(y)
    own = np.repeat(np.arange(len(ids)), count)
    return parent[own] == to, parent[to] == own


def _certificate(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most two edges a vertex that leave, whichever vertex is taken out, the same components as all edges
    do: a breadth-first forest and a spanning forest of the other edges (Eppstein and others, Sparsification).
    No other edge of x leads below x in the first forest, so what the second one joins through x is
    joined by the first one's root."""
    ids = _distinct(np.concatenate((source, target)))
    s, t = np.searchsorted(ids, source), np.searchsorted(ids, target)
    s, t = s[s != t], t[s != t]
    a, b = np.divmod(_distinct(np.concatenate((s * len(ids) + t, t * len(ids) + s))), max(1, len(ids)))
    up, down = _breadth_first(a, b)
    a, b, rest = np.concatenate((a[up], a[rest := ~(up | down)])), np.concatenate((b[up], b[rest])), int(up.sum())
    keep = np.concatenate((np.ones(rest, bool), _breadth_first(a[rest:], b[rest:])[0]))
    return ids[a[keep]], ids[b[keep]]


def cut_certificate(edges: DataFrame) -> DataFrame:
    """(source, target): few of the edges of the unsigned graph, with the same components and, whichever vertex
    is taken out, the same components of the rest.  Certificates of any parts of the edges
    make one of all, so edges are read in passing, ``CERTIFY`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new, n, kept = [], 0, 0, 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("source", "target")])
            new += batch.num_rows
            if new >= max(CERTIFY, kept):
                held = [_certificate(*map(np.concatenate, zip(*held)))]
                new, kept = 0, len(held[0][0])
        if new:
            held = [_certificate(*map(np.concatenate, zip(*held)))]
        for s, t in held:
            for n in range(0, len(s), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[n : n + (1 << 16)]) for x in (s, t)], names=["source", "target"])

    found = edges.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"))
    found = checkpoint(found.mapInArrow(run, "source long, target long"))
    n = found.count()
    while n > CERTIFY // 4:
        # Parts hold more and more of a vertex's edges; a graph that has no more than these to lose stays as it is.
        found = checkpoint(found.repartition(-(-n // CERTIFY)).mapInArrow(run, "source long, target long"))
        before, n = n, found.count()
        if 2 * n > before:
            break
    return found


def _thinned(edges: DataFrame) -> DataFrame:
    """Edges with the same components, few if vertices are numbers."""
    if not all(edges.schema[c].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") for c in ("source", "target")):
        return edges
    return cut_certificate(edges).withColumn("weight", F.lit(1.0))


def cut_vertices(edges: DataFrame) -> DataFrame:
    """Vertices whose isolation splits their component of the unsigned graph."""
    edges = cut_certificate(edges).withColumn("weight", F.lit(1.0))
    comps = plus_components(edges)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        adj, seen, cuts = _adjacency(group), {}, set()
        for v in sorted(adj):
            if v not in seen:
                cuts |= _low_points(adj, v, seen)[1]
        return pd.DataFrame({"v": sorted(cuts)}, dtype="int64")

    return _by_component(edges, comps).groupBy("comp").applyInPandas(run, "v long")


def cut_vertex_split(edges: DataFrame) -> DataFrame:
    """(v, part): the parts that isolating one vertex leaves, that vertex alone being one; the part is
    named by its smallest vertex.

    The vertex is the smallest whose isolation leaves at least three components of the unsigned
    graph; on a graph of several components that is the smallest of all.  None such: the whole
    graph is one part.
    """
    edges = checkpoint(edges.select("source", "target", F.abs("weight").alias("weight")))
    nodes = vertices(edges)
    comps = checkpoint(plus_components(edges))
    if comps.select("comp").distinct().limit(2).count() > 1:
        chosen = nodes.agg(F.min("v").alias("v"))
    else:
        chosen = cut_vertices(edges).agg(F.min("v").alias("v"))
    chosen = chosen.where("v is not null")
    if chosen.isEmpty():
        return comps.withColumnRenamed("comp", "part")
    alone = int(chosen.first()["v"])
    return plus_components(edges.where((F.col("source") != alone) & (F.col("target") != alone)), nodes).withColumnRenamed("comp", "part")


def two_edge_components(edges: DataFrame, comps: DataFrame | None = None) -> DataFrame:
    """(v, comp): 2-edge-connected components inside given components (default: the unsigned
    graph's); one vertex alone is a component."""
    comps = plus_components(edges.withColumn("weight", F.abs("weight"))) if comps is None else comps

    def run(group: pd.DataFrame) -> pd.DataFrame:
        adj, seen = _adjacency(group), {}
        for v in sorted(adj):
            if v not in seen:
                for a, b in _low_points(adj, v, seen)[0]:
                    adj[a].pop(b), adj[b].pop(a)
        label: dict[int, int] = {}
        for v in sorted(adj):
            todo = [v] if v not in label else []
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = v
                    todo += [u for u in adj[x] if u not in label]
        return pd.DataFrame({"v": list(label), "comp": list(label.values())}, dtype="int64")

    found = _by_component(edges, comps).groupBy("comp").applyInPandas(run, "v long, comp long")
    alone = comps.join(found, "v", "left_anti").select("v", F.col("v").alias("comp"))
    return found.union(alone)


def _pack_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (comp, i, j, plus) in both directions, by component and block of ROWS vertices, as zipped steps from one
    to the next; ``PACKED`` edges at a time."""
    held, size = [], 0

    def packed() -> Iterator[pa.RecordBatch]:
        comp, i, j, plus = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("comp", "i", "j", "plus"))
        order = np.argsort(comp, kind="stable") if (comp != comp[0]).any() else np.arange(len(comp))
        out: tuple[list, list, list] = ([], [], [])
        for own in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            minus = 1 - plus[own].astype(np.int64)
            key = np.sort(np.concatenate((i[own] << 32 | j[own] << 1 | minus, j[own] << 32 | i[own] << 1 | minus)))
            blocks = key >> 32 >> ROW_BITS
            for part in np.split(key, np.flatnonzero(np.diff(blocks)) + 1):
                for column, x in zip(out, (int(comp[own[0]]), int(part[0] >> 32 >> ROW_BITS), _zipped(np.diff(part, prepend=0)))):
                    column.append(x)
        for at in range(0, len(out[0]), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 1000], t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary()))], names=["comp", "block", "keys"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PACKED:
            yield from packed()
            held, size = [], 0
    if size:
        yield from packed()


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's edges as one row: for positive and negative ones the neighbours of its vertices, as gaps of seven
    bits a byte (the eighth: more follow), where each vertex's bytes end, and degrees."""
    keys = []
    for batch in batches:
        comp, block = batch.column("comp")[0].as_py(), batch.column("block")[0].as_py()
        keys += [np.cumsum(_unzipped(x, np.int64)) for x in batch.column("keys").to_pylist()]
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate(([True], key[1:] >> 1 != key[:-1] >> 1))]
    parts, n = [], int(key[-1] >> 32) - (block << ROW_BITS) + 1
    for sign in (0, 1):
        own = key[key & 1 == sign]
        i, j = (own >> 32) - (block << ROW_BITS), (own & 0xFFFFFFFF) >> 1
        gap = j - np.where(np.diff(i, prepend=-1) != 0, -1, np.concatenate(([-1], j[:-1]))[: len(j)]) - 1
        size = 1 + sum((gap >> bits > 0).astype(np.int64) for bits in (7, 14, 21, 28))
        first, data = np.cumsum(size) - size, np.zeros(size.sum(), np.uint8)
        for b in range(5):
            more = np.flatnonzero(size > b)
            data[first[more] + b] = gap[more] >> 7 * b & 127 | (size[more] > b + 1).astype(np.int64) << 7
        parts += [data.tobytes(), np.cumsum(np.bincount(i, size, n)).astype(np.int64).tobytes(), np.bincount(i, minlength=n).astype(np.int64).tobytes()]
    yield pa.RecordBatch.from_arrays([pa.array([comp]), pa.array([block], pa.int32()), pa.array([parts], pa.list_(pa.binary()))], names=["comp", "block", "parts"])


class _Packed:
    """A kernel whose vertices are 0.., its neighbours by row and sign (0: positive) as ``_pack_rows`` made them."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        rows = {}
        for batch in batches:
            for i in range(batch.num_rows):
                rows[batch.column("block")[i].as_py()] = [np.frombuffer(x.as_buffer(), t) for x, t in zip(batch.column("parts")[i].values, 2 * (np.uint8, np.int64, np.int64))]
        self.rows = [rows[k] for k in sorted(rows)]
        self.plus, self.minus = (np.concatenate([x[k] for x in self.rows]) for k in (2, 5))

    def row(self, sign: int, v: int) -> np.ndarray:
        data, ends = self.rows[v >> ROW_BITS][3 * sign : 3 * sign + 2]
        k = v & (1 << ROW_BITS) - 1
        data = data[ends[k - 1] if k else 0 : ends[k]]
        ends = data < 128
        last = np.flatnonzero(ends)
        value = (data & 127).astype(np.int64)
        if len(last) < len(data):
            first = np.concatenate(([0], last[:-1] + 1))
            value <<= 7 * (np.arange(len(data)) - np.repeat(first, last - first + 1))
        return np.cumsum(value + ends)[last] - 1


def _peck(graph: _Packed) -> int:
    """Edges violated by greedy deletion: the most imbalanced vertex goes (ties to the smaller), and after at most
    1,000 the rest is split into its kernels.  Degrees are those inside a vertex's part."""
    plus, minus = graph.plus.copy(), graph.minus.copy()
    own, seen, place = np.zeros(len(plus), np.int64), np.zeros(len(plus), np.int64), np.zeros(len(plus), np.int64)
    violated, n_parts, look, todo = 0, 1, 0, [np.arange(len(plus))]

    def inside(sign: int, v: int, part: int) -> np.ndarray:
        u = graph.row(sign, v)
        return u[own[u] == part]

    while todo:
        part = todo.pop()
        name = int(own[part[0]])
        gone, part = part[minus[part] == 0], part[minus[part] > 0]
        own[gone] = -1
        if not len(part):
            continue
        for v in gone.tolist():
            plus[inside(0, v, name)] -= 1
        # Positive components.  Where fewer vertices are left than wait, those look whether they touch the component:
        # the ones that do are all that can lead on.
        look, left, comps = look + 1, len(part), []
        for root in part.tolist():
            if not left:
                break
            if seen[root] == look:
                continue
            seen[root], left, wait, comp = look, left - 1, [root], [np.array([root])]
            while wait and left:
                if left < len(wait):
                    rest = part[seen[part] != look]
                    u = rest[[bool((seen[inside(0, v, name)] == look).any()) for v in rest.tolist()]]
                    wait = []
                else:
                    u = inside(0, wait.pop(), name)
                    u = u[seen[u] != look]
                seen[u], left = look, left - len(u)
                wait += u.tolist()
                comp.append(u)
            comps.append(np.sort(np.concatenate(comp)))
        if len(comps) > 1:
            comps.sort(key=len)
            for comp in comps[:-1]:
                own[comp], n_parts = n_parts, n_parts + 1
            for comp in comps[:-1]:
                for v in comp.tolist():
                    u = graph.row(1, v)
                    minus[v] = (own[u] == own[v]).sum()
                    minus[u[own[u] == name]] -= 1
            todo += comps
            continue
        place[part] = np.arange(len(part))
        rank = np.maximum(plus[part], minus[part]) / (plus[part] + minus[part])
        for _ in range(min(1000, len(part) - 1)):
            k = int(rank.argmax())
            if rank[k] < 0:
                break
            v = int(part[k])
            violated += int(min(plus[v], minus[v]))
            own[v], rank[k] = -1, -1
            near = [inside(sign, v, name) for sign in (0, 1)]
            plus[near[0]] -= 1
            minus[near[1]] -= 1
            u = np.concatenate(near)
            p, m = plus[u], minus[u]
            rank[place[u]] = np.where(p + m > 0, np.maximum(p, m) / np.maximum(p + m, 1), -1)
        part = part[own[part] == name]
        if len(part):
            todo.append(part)
    return violated


def chicken(edges: DataFrame) -> DataFrame:
    """(kernel, violated): greedy deletion of the most imbalanced vertex in every kernel, kernels
    in parallel; a kernel's edges lie packed in its task, about a byte for each end."""
    edges = checkpoint(edges.select("source", "target", "weight"))
    kernels = _kernelize(edges)
    ids = checkpoint(kernels.withColumn("_i", F.row_number().over(Window.partitionBy("kernel").orderBy("v")).cast("long") - 1))
    a = by_vertex(ids.select(F.col("v").alias("source"), F.col("kernel").cast("long").alias("comp"), F.col("_i").alias("i")))
    b = by_vertex(ids.select(F.col("v").alias("target"), F.col("kernel").cast("long").alias("_to"), F.col("_i").alias("j")))
    inner = edges.join(a, "source").join(b, "target").where("comp = _to and i <> j").select("comp", "i", "j", (F.col("weight") > 0).alias("plus"))
    packed = inner.mapInArrow(_pack_edges, "comp long, block int, keys binary")
    rows = packed.groupBy("comp", "block").applyInArrow(_pack_rows, "comp long, block int, parts array<binary>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)
        kernel = first.column("comp").slice(0, 1)
        yield pa.RecordBatch.from_arrays([kernel, pa.array([_peck(_Packed(chain([first], batches)))], pa.int64())], names=["kernel", "violated"])

    return rows.groupBy("comp").applyInArrow(run, "kernel long, violated long")


def largest_kernel(kernels: DataFrame) -> DataFrame:
    sizes = kernels.groupBy("kernel").agg(F.count("*").alias("n"))
    return sizes.agg(F.max(F.struct("n", (-F.col("kernel")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("kernel"), F.col("m.n").alias("n"))


def relabel(nodes: DataFrame) -> DataFrame:
    return numbered(nodes.select("v"), ["v"], "new_id").select("v", (F.col("new_id") + 1).alias("new_id"))
