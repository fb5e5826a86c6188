"""Interval structures, objectives and affinities of labellings (v, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashrand import gumbel
from .graph import by_vertex, covote_edges, covote_sums, directed


def chain(k: int) -> list[tuple[float, float]]:
    return [(float(i), i + 1.5) for i in range(k)]


def clusters(k: int) -> list[tuple[float, float]]:
    return [(2.0 * i, 2.0 * i + 1) for i in range(k)]


def structure(spark: SparkSession, intervals: list[tuple[float, float]]) -> DataFrame:
    """(label, start, end) with 32-bit ends; position is the label."""
    rows = [(i, s, e) for i, (s, e) in enumerate(intervals)]
    return spark.createDataFrame(rows, "label int, start float, end float")


def overlap_matrix(intervals: DataFrame, closed: bool = True) -> DataFrame:
    """(a, b, overlap) for every pair of labels; touching intervals overlap if ``closed``.  At
    most a few hundred rows: structures have up to 16 intervals."""
    x, y = intervals.select(F.col("label").alias("a"), F.col("start").alias("sa"), F.col("end").alias("ea")), intervals.select(F.col("label").alias("b"), F.col("start").alias("sb"), F.col("end").alias("eb"))
    if closed:
        hit = (F.col("sb") <= F.col("ea")) & (F.col("sa") <= F.col("eb"))
    else:
        hit = (F.col("sb") < F.col("ea")) & (F.col("sa") < F.col("eb"))
    return x.crossJoin(y).select("a", "b", hit.alias("overlap"))


def labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with both ends' labels, la and lb."""
    labels = by_vertex(labels.select("v", "label"))
    one = labels.select(F.col("v").alias("source"), F.col("label").alias("la"))
    two = labels.select(F.col("v").alias("target"), F.col("label").alias("lb"))
    return edges.join(one, "source").join(two, "target")


def _total(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.abs("weight"))), F.lit(0.0))


def totals(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("n_edges"), F.coalesce(F.sum(F.abs("weight")), F.lit(0.0)).alias("total"), _total(F.col("weight") < 0).alias("negative"))


def cc_violations(edges: DataFrame, labels: DataFrame) -> DataFrame:
    same = F.col("la") == F.col("lb")
    return labelled(edges, labels).agg(_total(((F.col("weight") < 0) & same) | ((F.col("weight") > 0) & ~same)).alias("violations"))


def interval_violations(edges: DataFrame, labels: DataFrame, intervals: DataFrame, mapping: DataFrame) -> DataFrame:
    """Violations if cluster ``label`` sits on interval ``interval`` (0 if unmapped), strict overlap;
    a cluster overlaps itself."""
    placed = labels.join(F.broadcast(mapping), "label", "left").select("v", F.struct("label", F.coalesce("interval", F.lit(0)).alias("interval")).alias("label"))
    rows = labelled(edges, placed).withColumns({"a": F.col("la.interval"), "b": F.col("lb.interval")}).join(F.broadcast(overlap_matrix(intervals, closed=False)), ["a", "b"])
    meets = (F.col("la.label") == F.col("lb.label")) | F.col("overlap")
    return rows.agg(_total(((F.col("weight") > 0) & ~meets) | ((F.col("weight") < 0) & meets)).alias("violations"))


def agreement(edges: DataFrame, labels: DataFrame, matrix: DataFrame) -> DataFrame:
    rows = labelled(edges, labels).join(F.broadcast(matrix), (F.col("la") == F.col("a")) & (F.col("lb") == F.col("b")))
    good = F.col("overlap") == (F.col("weight") > 0)
    return rows.agg(_total(good).alias("agreement"), _total(~good).alias("disagreement"))


def affinity(edges: DataFrame, labels: DataFrame, matrix: DataFrame) -> DataFrame:
    """(v, label, affinity): what v would agree with under each label.  Edges are summed per
    vertex, neighbour label and sign before the small matrix multiplies the rows."""
    return affinity_of(neighbour_sums(edges, labels), matrix)


def neighbour_sums(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(v, near, plus, minus): weights of v's positive and negative edges to neighbours of label ``near``."""
    near = directed(edges).join(by_vertex(labels.select(F.col("v").alias("u"), F.col("label").alias("near"))), "u")
    return near.groupBy("v", "near").agg(F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("weight"))), F.lit(0.0)).alias("plus"), F.coalesce(F.sum(F.when(F.col("weight") < 0, -F.col("weight"))), F.lit(0.0)).alias("minus"))


def covote_neighbour_sums(votes: DataFrame, labels: DataFrame, threshold: float = 0.75, min_support: int = 3) -> DataFrame:
    """``neighbour_sums`` of the co-voting graph of ``votes``; where many persons meet, its edges make no rows."""
    sums = covote_sums(votes, labels, threshold, min_support)
    return neighbour_sums(covote_edges(votes, threshold, min_support), labels) if sums is None else sums


def label_pairs(near: DataFrame, labels: DataFrame) -> DataFrame:
    """(la, lb, plus, minus): weights of positive and negative edges between labels, from ``neighbour_sums``.
    Both ends count an edge, so halves of each pair (la, lb) and (lb, la) add up to it."""
    own = near.join(by_vertex(labels.select("v", F.col("label").alias("la"))), "v").groupBy("la", F.col("near").alias("lb"))
    return own.agg((F.sum("plus") / 2).alias("plus"), (F.sum("minus") / 2).alias("minus"))


def interval_violations_of(near: DataFrame, labels: DataFrame, intervals: DataFrame, mapping: DataFrame) -> DataFrame:
    """``interval_violations`` from ``neighbour_sums``."""
    a, b = (mapping.select(F.col("label").alias(x), F.col("interval").alias(y)) for x, y in (("la", "a"), ("lb", "b")))
    rows = label_pairs(near, labels).join(F.broadcast(a), "la", "left").join(F.broadcast(b), "lb", "left").fillna(0, ["a", "b"])
    rows = rows.join(F.broadcast(overlap_matrix(intervals, closed=False)), ["a", "b"])
    return rows.agg(F.coalesce(F.sum(F.when((F.col("la") == F.col("lb")) | F.col("overlap"), F.col("minus")).otherwise(F.col("plus"))), F.lit(0.0)).alias("violations"))


def agreement_of(near: DataFrame, labels: DataFrame, matrix: DataFrame) -> DataFrame:
    """``agreement`` from ``neighbour_sums``, for a symmetric matrix."""
    rows = label_pairs(near, labels).join(F.broadcast(matrix), (F.col("la") == F.col("a")) & (F.col("lb") == F.col("b")))
    return rows.agg(*(F.coalesce(F.sum(F.when(F.col("overlap"), F.col(x)).otherwise(F.col(y))), F.lit(0.0)).alias(name) for name, x, y in (("agreement", "plus", "minus"), ("disagreement", "minus", "plus"))))


def affinity_of(near: DataFrame, matrix: DataFrame) -> DataFrame:
    """``affinity`` from ``neighbour_sums``."""
    m = matrix.select(F.col("a").alias("label"), F.col("b").alias("near"), "overlap")
    return near.join(F.broadcast(m), "near").groupBy("v", "label").agg(F.sum(F.when(F.col("overlap"), F.col("plus")).otherwise(F.col("minus"))).alias("affinity"))


def favourite(aff: DataFrame) -> DataFrame:
    """(v, label, affinity) of the best label, ties to the smaller label."""
    best = aff.groupBy("v").agg(F.max(F.struct("affinity", (-F.col("label")).alias("l"))).alias("m"))
    return best.select("v", (-F.col("m.l")).alias("label"), F.col("m.affinity").alias("affinity"))


def gumbel_label(aff: DataFrame, temperature: float, seed: int, epoch: int) -> DataFrame:
    """A label sampled by its affinity: argmax of affinity / T plus Gumbel noise."""
    score = F.col("affinity") / max(temperature, 1e-12) + gumbel(seed, epoch, F.col("v"), F.col("label"))
    best = aff.groupBy("v").agg(F.max(F.struct(F.round(score, 6).alias("s"), "label")).alias("m"))
    return best.select("v", F.col("m.label").alias("label"))


def temperature(epoch: Column, initial: float, factor: float, every: int) -> Column:
    return F.lit(initial) * F.pow(F.lit(factor), F.floor((epoch - 1) / every))
