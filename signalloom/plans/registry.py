"""Registered queries and their DuckDB oracles.

Graph operators go through the DataFrame operators; the reporting analytics are SQL, run by
Spark on views and by DuckDB on the same tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashrand import uniform, uniform_sql
from ..operators import graph as g
from ..operators import heuristics as h
from ..operators import labels as lb
from ..operators import reduce as r
from ..sources import io

K = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.covote_edges(g.event_votes(table(spark, d, "events")))


def hour_sums(spark: SparkSession, d: str, labels: DataFrame) -> DataFrame:
    """``neighbour_sums`` of ``hour_edges``: the graph has far more edges than vertices times labels."""
    return lb.covote_neighbour_sums(g.event_votes(table(spark, d, "events")), labels)


def day_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.covote_edges(g.event_votes(table(spark, d, "events"), "day"))


def user_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("v")).distinct().withColumn("label", (F.col("v") % K).cast("int"))


def matrix(spark: SparkSession, closed: bool = True) -> DataFrame:
    return lb.overlap_matrix(lb.structure(spark, lb.chain(K)), closed)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """(vertex, old_label, best_label, affinity, gain) of the co-voting graph."""
    labels = user_labels(spark, d)
    aff = lb.affinity(hour_edges(spark, d), labels, matrix(spark))
    both = aff.join(labels.withColumnRenamed("label", "old_label"), "v").groupBy("v", "old_label").agg(
        F.max(F.struct("affinity", (-F.col("label")).alias("l"))).alias("m"), F.max(F.when(F.col("label") == F.col("old_label"), F.col("affinity"))).alias("own")
    )
    return both.where("own is not null").select(
        F.col("v").alias("vertex"), "old_label", (-F.col("m.l")).alias("best_label"), F.col("m.affinity").alias("affinity"), (F.col("m.affinity") - F.col("own")).alias("gain")
    )


# --- oracle fragments -------------------------------------------------------------------------


def _covote_sql(ballot: str) -> str:
    return f"""votes AS (SELECT user_id AS person, {ballot} AS ballot, avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM events GROUP BY 1, 2),
    pairs AS (SELECT a.person AS source, b.person AS target, count(*) AS support, avg(CASE WHEN a.x = b.x THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ratio
        FROM votes a JOIN votes b ON a.ballot = b.ballot AND a.person < b.person WHERE a.x <> 0 AND b.x <> 0 GROUP BY 1, 2 HAVING count(*) >= 3),
    e AS (SELECT source, target, CASE WHEN ratio > 0.75 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS weight, support, ratio FROM pairs WHERE ratio > 0.75 OR ratio < 0.25)"""


HOUR = _covote_sql("date_trunc('hour', ts)")
DAY = _covote_sql("strftime(ts, '%Y-%m-%d') || ':' || event_type")
LABELS = f"""labels_ AS (SELECT DISTINCT user_id AS v, (user_id % {K})::INT AS label FROM events),
    m AS (SELECT a.i::INT AS a, b.i::INT AS b, abs(a.i - b.i) <= 1 AS overlap FROM range({K}) a(i), range({K}) b(i)),
    both_ AS (SELECT source AS v, target AS u, weight FROM e UNION ALL SELECT target, source, weight FROM e),
    el AS (SELECT e.*, x.label AS la, y.label AS lb FROM e JOIN labels_ x ON x.v = e.source JOIN labels_ y ON y.v = e.target),
    aff AS (SELECT n.v, m.a AS label, sum(CASE WHEN m.overlap = (n.weight > 0) THEN abs(n.weight) ELSE 0 END) AS affinity
        FROM both_ n JOIN labels_ l ON l.v = n.u JOIN m ON m.b = l.label GROUP BY 1, 2)"""
DEG = "deg AS (SELECT v, count(*) FILTER (WHERE weight > 0) AS dp, count(*) FILTER (WHERE weight < 0) AS dm FROM (SELECT source AS v, weight FROM e UNION ALL SELECT target, weight FROM e) GROUP BY 1)"
#: Runs and traces made of events: run = user, config = event type, runtime = ms since the month began.
RUNS = """WITH trace AS (SELECT user_id AS run, event_type AS config, event_id AS id, value AS best,
    CAST({ms} AS BIGINT) AS runtime FROM events) """
#: Milliseconds are cut off, not rounded.
MS = {"spark": "unix_millis(CAST(ts AS TIMESTAMP)) - 1704067200000", "duck": "epoch_us(ts) // 1000 - 1704067200000"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = oracle


def add_sql(name: str, sql: str, *tables: str, duck: str | None = None) -> None:
    """A query in SQL that both engines run; {ms} is the event's millisecond in its month."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        """The tables go to the statement as parameters, so that no view of the caller's is replaced."""
        text = re.sub(r"\b(FROM|JOIN) (" + "|".join(tables) + r")\b", r"\1 {\2}", sql.replace("{ms}", MS["spark"]).replace("::DOUBLE", "D"))
        return spark.sql(text, **{t: table(spark, d, t) for t in tables})

    add(name, run, (duck or sql).replace("{ms}", MS["duck"]))


# --- co-voting, identity, set operations --------------------------------------------------------
add("covote_edges", hour_edges, f"WITH {HOUR} SELECT source, target, support, ratio, weight FROM e")
add("covote_edges_by_day", day_edges, f"WITH {DAY} SELECT source, target, support, ratio, weight FROM e")
add("flagship_affinity_gain", flagship, f"""WITH {HOUR}, {LABELS}, best AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY affinity DESC, label) AS n FROM aff)
    SELECT best.v AS vertex, l.label AS old_label, best.label AS best_label, best.affinity, best.affinity - o.affinity AS gain
    FROM best JOIN labels_ l ON l.v = best.v JOIN aff o ON o.v = best.v AND o.label = l.label WHERE n = 1""")
add("vote_matrix_long", lambda s, d: g.event_votes(table(s, d, "events")).groupBy("person", "ballot").agg(F.avg("x").alias("x")).where("x <> 0"),
    f"WITH {HOUR} SELECT person, ballot, x FROM votes WHERE x <> 0")
PERIODS = [(1, "2024-01-01", "2024-01-06"), (2, "2024-01-07", "2024-01-12"), (3, "2024-01-13", "2024-01-18"), (4, "2024-01-19", "2024-01-24"), (5, "2024-01-25", "2024-01-31")]


def period_range_join(s: SparkSession, d: str) -> DataFrame:
    periods = s.createDataFrame(PERIODS, "period int, lo string, hi string").select("period", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    return table(s, d, "events").join(F.broadcast(periods), F.to_date("ts").between(F.col("lo"), F.col("hi"))).groupBy("period").agg(F.count("*").alias("n"))


add("period_range_join", period_range_join,
    f"SELECT period, count(*) AS n FROM events JOIN (VALUES {', '.join(f'({p}::INT, DATE {a!r}, DATE {b!r})' for p, a, b in PERIODS)}) t(period, lo, hi) ON ts::DATE BETWEEN lo AND hi GROUP BY 1")
VOTE_PERIODS = {p: (a, b) for p, a, b in PERIODS}


def event_vote_frame(s: SparkSession, d: str) -> DataFrame:
    """Votes as files name them: a file for each hour, some without a date, ja and nein."""
    hour = F.date_trunc("hour", "ts")
    name = F.when(F.hour("ts") == 5, F.concat(F.lit("undated_"), F.date_format(hour, "yyyyMMddHH"))).otherwise(F.concat(F.date_format(hour, "yyyyMMdd"), F.lit("_"), F.date_format(hour, "HH")))
    return table(s, d, "events").select(
        F.concat(name, F.lit(".csv")).alias("filename"), F.lit("x").alias("Name"), F.concat(F.lit("P"), F.format_string("%08d", (F.col("user_id") * 7) % 10007)).alias("Bezeichnung"),
        F.when(F.col("value") > 50, "ja").otherwise("nein").alias("janein"),
    )


_frame = """f AS (SELECT ts, 'P' || printf('%08d', (user_id * 7) % 10007) AS person, date_trunc('hour', ts) AS ballot, CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS x FROM events
    WHERE hour(ts) <> 5 AND (ts::DATE BETWEEN DATE '2024-01-01' AND DATE '2024-01-06' OR ts::DATE BETWEEN DATE '2024-01-13' AND DATE '2024-01-18')),
    ids AS (SELECT person, row_number() OVER (ORDER BY person) - 1 AS id FROM (SELECT DISTINCT person FROM f))"""
add("votes_to_graph", lambda s, d: g.votes_to_graph(event_vote_frame(s, d), [1, 3], 0.75, VOTE_PERIODS)[1].select("source", "target", "support", "weight"),
    f"""WITH {_frame}, v AS (SELECT id, ballot, avg(x) AS x FROM f JOIN ids USING (person) GROUP BY 1, 2 HAVING avg(x) <> 0),
    q AS (SELECT a.id AS source, b.id AS target, count(*) AS support, avg(CASE WHEN a.x = b.x THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ratio FROM v a JOIN v b ON a.ballot = b.ballot AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT source, target, support, CASE WHEN ratio > 0.75 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS weight FROM q WHERE ratio > 0.75 OR ratio < 0.25""")
add("anonymised_votes", lambda s, d: g.anonymise(g.in_periods(event_vote_frame(s, d), [1, 3], VOTE_PERIODS), "Bezeichnung").groupBy("person_id", "janein").agg(F.count("*").alias("n")),
    f"WITH {_frame} SELECT id AS person_id, CASE WHEN x > 0 THEN 'ja' ELSE 'nein' END AS janein, count(*) AS n FROM f JOIN ids USING (person) GROUP BY 1, 2")
add("anonymise_ids", lambda s, d: g.anonymise(table(s, d, "customer").select("c_name", "c_mktsegment"), "c_name").select(F.col("person_id").cast("long").alias("person_id"), "c_mktsegment"),
    "SELECT dense_rank() OVER (ORDER BY c_name) - 1 AS person_id, c_mktsegment FROM customer")
LINES = "concat_ws('{s}', CAST(l_suppkey AS STRING), CAST(l_partkey % 97 AS STRING), CAST(CAST(l_quantity AS INT) - 25 AS STRING), l_returnflag)"


def edge_lines(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select(F.expr(LINES.format(s=" ")).alias("value"))
    return rows.union(s.createDataFrame([("# comment",), ("MULTICUT",), ("1 2",), ("5;5;1",), ("7,8#-1\textra",)], "value string"))


RAW = """raw_ AS (SELECT l_suppkey AS a, l_partkey % 97 AS b, l_quantity::INT - 25 AS w FROM lineitem UNION ALL SELECT 7, 8, -1),
    raw AS (SELECT least(a, b) AS source, greatest(a, b) AS target, w FROM raw_ WHERE a <> b)"""
add("parse_signed_edgelist", lambda s, d: io.signed_edges(edge_lines(s, d)), f"WITH {RAW} SELECT source, target, min(CASE WHEN w < 0 THEN -1 ELSE 1 END)::DOUBLE AS weight FROM raw GROUP BY 1, 2")
add("parse_weighted_edgelist", lambda s, d: io.weighted_edges(edge_lines(s, d)), f"WITH {RAW} SELECT source, target, sum(w)::DOUBLE AS weight FROM raw GROUP BY 1, 2")
add("weighted_to_signed", lambda s, d: g.signed(io.weighted_edges(edge_lines(s, d))), f"WITH {RAW} SELECT source, target, sign(sum(w))::DOUBLE AS weight FROM raw GROUP BY 1, 2 HAVING sum(w) <> 0")
add("canonical_edges", lambda s, d: g.canonical(io.parse_edge_lines(edge_lines(s, d))), f"WITH {RAW} SELECT source, target, sum(w)::DOUBLE AS weight FROM raw GROUP BY 1, 2 HAVING sum(w) <> 0")
add("conflict_negative_wins", lambda s, d: g.negative_wins(hour_edges(s, d).select("source", "target", "weight").union(day_edges(s, d).select("target", "source", "weight"))),
    f"WITH {HOUR}, {DAY.replace('votes', 'votes2').replace('pairs', 'pairs2').replace('e AS (', 'e2 AS (')}, u AS (SELECT source, target, weight FROM e UNION ALL SELECT source, target, weight FROM e2) SELECT source, target, min(weight) AS weight FROM u GROUP BY 1, 2")
add("symmetric_closure", lambda s, d: g.covote_directed(g.event_votes(table(s, d, "events"))), f"WITH {HOUR} SELECT source AS v, target AS u, weight FROM e UNION SELECT target, source, weight FROM e")
add("dense_vertex_ids", lambda s, d: g.dense_ids(hour_edges(s, d)).withColumn("vid", F.col("vid").cast("long")), f"WITH {HOUR} SELECT node, row_number() OVER (ORDER BY node) - 1 AS vid FROM (SELECT source AS node FROM e UNION SELECT target FROM e)")
_ids = "ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS vid FROM (SELECT source AS node FROM e UNION SELECT target FROM e))"


def restored_labels(s: SparkSession, d: str) -> DataFrame:
    ids = g.checkpoint(g.dense_ids(day_edges(s, d)))
    return g.restore(ids.select(F.col("vid").alias("v"), (F.col("vid") % K).cast("int").alias("label")), ids)


def remapped_edges(s: SparkSession, d: str) -> DataFrame:
    edges = g.checkpoint(day_edges(s, d))
    return g.remap(edges, g.dense_ids(edges))


add("remap_edges", remapped_edges, f"WITH {DAY}, {_ids} SELECT a.vid AS source, b.vid AS target, weight FROM e JOIN ids a ON a.node = source JOIN ids b ON b.node = target")
add("restore_labels", restored_labels, f"WITH {DAY}, {_ids} SELECT node AS v, (vid % {K})::INT AS label FROM ids")
add("vertex_edge_counts", lambda s, d: g.vertex_edge_counts(hour_edges(s, d)),
    f"WITH {HOUR} SELECT (SELECT count(*) FROM (SELECT source FROM e UNION SELECT target FROM e)) AS n_vertices, (SELECT count(*) FROM e) AS n_edges")
add("signed_degree", lambda s, d: g.degrees(day_edges(s, d), user_labels(s, d).select("v")), f"WITH {DAY}, {DEG} SELECT u.v, coalesce(dp, 0) AS dp, coalesce(dm, 0) AS dm FROM (SELECT DISTINCT user_id AS v FROM events) u LEFT JOIN deg USING (v)")
_few = lambda s, d: user_labels(s, d).where("label < 4").select("v")
add("induced_subgraph", lambda s, d: g.induced(hour_edges(s, d), _few(s, d)), f"WITH {HOUR} SELECT source, target, weight FROM e WHERE source % {K} < 4 AND target % {K} < 4")
add("remove_vertices", lambda s, d: g.without_vertices(hour_edges(s, d), _few(s, d)), f"WITH {HOUR} SELECT source, target, weight FROM e WHERE source % {K} >= 4 AND target % {K} >= 4")
add("remove_edges", lambda s, d: g.without_edges(hour_edges(s, d), day_edges(s, d)), f"WITH {HOUR}, {DAY.replace('votes', 'votes2').replace('pairs', 'pairs2').replace('e AS (', 'e2 AS (')} SELECT e.source, e.target, e.weight, e.support, e.ratio FROM e ANTI JOIN e2 ON e.source = e2.source AND e.target = e2.target")
add("edge_weight_lookup", lambda s, d: user_labels(s, d).select(F.col("v").alias("source"), (F.col("v") + 1).alias("target")).join(hour_edges(s, d), ["source", "target"], "left").select("source", "target", F.coalesce("weight", F.lit(0.0)).alias("weight")),
    f"WITH {HOUR} SELECT u.v AS source, u.v + 1 AS target, coalesce(weight, 0) AS weight FROM (SELECT DISTINCT user_id AS v FROM events) u LEFT JOIN e ON e.source = u.v AND e.target = u.v + 1")

# --- structures, objectives, affinities -----------------------------------------------------------
TOUCH = [(0.0, 1.0), (1.0, 2.0), (2.0, 3.0), (0.5, 2.5)]
_iv = ", ".join(f"({i}::INT, {a}::FLOAT, {b}::FLOAT)" for i, (a, b) in enumerate(TOUCH))
for closed, op in ((True, "<="), (False, "<")):
    add(f"overlap_matrix_{'closed' if closed else 'strict'}", lambda s, d, c=closed: lb.overlap_matrix(lb.structure(s, TOUCH), c),
        f"WITH i(l, s, e) AS (VALUES {_iv}) SELECT a.l AS a, b.l AS b, b.s {op} a.e AND a.s {op} b.e AS overlap FROM i a, i b")
add("graph_totals", lambda s, d: lb.totals(hour_edges(s, d)), f"WITH {HOUR} SELECT count(*) AS n_edges, sum(abs(weight)) AS total, coalesce(sum(-weight) FILTER (WHERE weight < 0), 0) AS negative FROM e")
add("cc_violations", lambda s, d: lb.cc_violations(hour_edges(s, d), user_labels(s, d)), f"WITH {HOUR}, {LABELS} SELECT sum(CASE WHEN (weight < 0) = (la = lb) THEN abs(weight) ELSE 0 END) AS violations FROM el")


def interval_violations(s: SparkSession, d: str) -> DataFrame:
    mapping = s.createDataFrame([(i, (3 * i) % K) for i in range(K - 1)], "label int, interval int")
    labels = user_labels(s, d)
    return lb.interval_violations_of(hour_sums(s, d, labels), labels, lb.structure(s, lb.chain(K)), mapping)


def interval_agreement(s: SparkSession, d: str) -> DataFrame:
    labels = user_labels(s, d)
    return lb.agreement_of(hour_sums(s, d, labels), labels, matrix(s))


_mapped = "CASE WHEN {c} < 7 THEN (3 * {c}) % 8 ELSE 0 END"
add("interval_violations", interval_violations, f"WITH {HOUR}, {LABELS} SELECT sum(CASE WHEN (weight > 0) <> (la = lb OR abs({_mapped.format(c='la')} - {_mapped.format(c='lb')}) <= 1) THEN abs(weight) ELSE 0 END) AS violations FROM el")
add("interval_agreement", interval_agreement,
    f"WITH {HOUR}, {LABELS} SELECT sum(CASE WHEN (abs(la - lb) <= 1) = (weight > 0) THEN abs(weight) ELSE 0 END) AS agreement, sum(CASE WHEN (abs(la - lb) <= 1) <> (weight > 0) THEN abs(weight) ELSE 0 END) AS disagreement FROM el")
add("label_histogram", lambda s, d: user_labels(s, d).groupBy("label").agg(F.count("*").alias("n")), f"SELECT (v % {K})::INT AS label, count(*) AS n FROM (SELECT DISTINCT user_id AS v FROM events) GROUP BY 1")
add("affinity_matrix", lambda s, d: lb.affinity(hour_edges(s, d), user_labels(s, d), matrix(s)), f"WITH {HOUR}, {LABELS} SELECT v, label, affinity FROM aff")
add("favorite_label", lambda s, d: lb.favourite(lb.affinity(hour_edges(s, d), user_labels(s, d), matrix(s))), f"WITH {HOUR}, {LABELS} SELECT v, label, affinity FROM aff QUALIFY row_number() OVER (PARTITION BY v ORDER BY affinity DESC, label) = 1")
add("gumbel_label", lambda s, d: lb.gumbel_label(lb.affinity_of(hour_sums(s, d, user_labels(s, d)), matrix(s)), 2.0, 5, 1),
    f"WITH {HOUR}, {LABELS} SELECT v, label FROM aff QUALIFY row_number() OVER (PARTITION BY v ORDER BY round(affinity / 2.0::DOUBLE - ln(-ln({uniform_sql('5', '1', 'v', 'label')})), 6) DESC, label DESC) = 1")
add("chunk_assignment", lambda s, d: h.chunks(g.vertices(hour_edges(s, d)), 10, 5, 2),
    f"WITH {HOUR}, n AS (SELECT source AS v FROM e UNION SELECT target FROM e) SELECT v, ((row_number() OVER (ORDER BY {uniform_sql('5', '2', 'v')}, v) - 1) // ceil((SELECT count(*) FROM n) / 10)::BIGINT)::INT AS chunk FROM n")
add("temperature_schedule", lambda s, d: s.range(1, 61).select(F.col("id").alias("epoch"), F.round(lb.temperature(F.col("id"), 100.0, 0.6666, 5), 6).alias("temperature")),
    "SELECT epoch, round(100::DOUBLE * pow(0.6666::DOUBLE, floor((epoch - 1) / 5)), 6) AS temperature FROM range(1, 61) t(epoch)")


def sweep_fixed_rounds(s: SparkSession, d: str) -> DataFrame:
    """The edges are counted again in each round: they would take far more room than the votes."""
    labels = g.checkpoint(user_labels(s, d))
    for epoch in range(2):
        labels = g.checkpoint(h.swept(hour_sums(s, d, labels), labels, matrix(s), 5, epoch))
    return labels


def _sweep_sql(n: int, old: str) -> str:
    u = uniform_sql("5", str(n), "l.v", "'move'")
    return f"""a{n} AS (SELECT n.v, m.a AS label, sum(CASE WHEN m.overlap = (n.weight > 0) THEN abs(n.weight) ELSE 0 END) AS affinity FROM both_ n JOIN {old} l ON l.v = n.u JOIN m ON m.b = l.label GROUP BY 1, 2),
    b{n} AS (SELECT v, label, affinity FROM a{n} QUALIFY row_number() OVER (PARTITION BY v ORDER BY affinity DESC, label) = 1),
    l{n} AS (SELECT l.v, CASE WHEN b.affinity - coalesce(o.affinity, 0) > 0 AND {u} < 0.5 THEN b.label ELSE l.label END AS label FROM {old} l LEFT JOIN b{n} b ON b.v = l.v LEFT JOIN a{n} o ON o.v = l.v AND o.label = l.label)"""


add("sweep_fixed_rounds", sweep_fixed_rounds, f"WITH {HOUR}, {LABELS}, {_sweep_sql(0, 'labels_')}, {_sweep_sql(1, 'l0')} SELECT v, label FROM l1")


def local_search_best_move(s: SparkSession, d: str) -> DataFrame:
    """All users are labelled, so those with a neighbour's weight are the graph's vertices."""
    labels = user_labels(s, d)
    near = g.checkpoint(hour_sums(s, d, labels).select("v", "near", (F.col("plus") - F.col("minus")).alias("w")))
    return h.best_of(near, labels.join(near.select("v").distinct(), "v", "left_semi"))


add("local_search_best_move", local_search_best_move,
    f"""WITH {HOUR}, {LABELS}, w AS (SELECT n.v, l.label AS near, sum(weight) AS w FROM both_ n JOIN labels_ l ON l.v = n.u GROUP BY 1, 2),
    own AS (SELECT l.v, l.label AS old FROM labels_ l WHERE l.v IN (SELECT v FROM both_))
    SELECT o.v, k.label, coalesce(a.w, 0) - coalesce(b.w, 0) AS delta FROM own o JOIN (SELECT DISTINCT old AS label FROM own) k ON k.label <> o.old
    LEFT JOIN w a ON a.v = o.v AND a.near = o.old LEFT JOIN w b ON b.v = o.v AND b.near = k.label ORDER BY delta, o.v, k.label LIMIT 1""")


def mapping_bruteforce(s: SparkSession, d: str) -> DataFrame:
    labels = user_labels(s, d).withColumn("label", (F.col("v") % 4).cast("int"))
    pairs = lb.label_pairs(hour_sums(s, d, labels), labels).withColumnsRenamed({"plus": "p", "minus": "m"})
    mapping, cost = h.map_pairs(pairs, labels, lb.chain(4))
    return s.createDataFrame([(k, v, float(cost)) for k, v in sorted(mapping.items())], "label int, interval int, violations double")


add("mapping_bruteforce_k4", mapping_bruteforce, f"""WITH {HOUR}, s AS (SELECT (source % 4)::INT AS a, (target % 4)::INT AS b, sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) AS p, sum(CASE WHEN weight < 0 THEN -weight ELSE 0 END) AS m FROM e GROUP BY 1, 2),
    perm AS (SELECT [w.i, x.i, y.i, z.i] AS q FROM range(4) w(i), range(4) x(i), range(4) y(i), range(4) z(i) WHERE w.i <> x.i AND w.i <> y.i AND w.i <> z.i AND x.i <> y.i AND x.i <> z.i AND y.i <> z.i),
    cost AS (SELECT q, sum(CASE WHEN a = b OR abs(q[a + 1] - q[b + 1]) <= 1 THEN m ELSE p END) AS violations FROM perm, s GROUP BY 1), best AS (SELECT * FROM cost ORDER BY violations, q LIMIT 1)
    SELECT l::INT AS label, q[l + 1]::INT AS interval, violations FROM best, range(4) t(l)""")
HAND = {"T": [(1, 2, 1), (2, 3, 1), (1, 3, -1)], "C4": [(1, 2, 1), (2, 3, 1), (3, 4, 1), (1, 4, 1), (1, 3, -1), (2, 4, -1)], "TAIL": [(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1), (1, 3, -1)],
        "SPLIT": [(1, 2, 1), (2, 3, 1), (4, 5, 1), (5, 6, 1), (1, 3, -1), (4, 6, -1), (3, 4, -1)], "CROSS": [(1, 2, 1), (3, 4, 1), (1, 3, -1), (2, 4, -1)]}
add("exact_embedding_n6", lambda s, d: s.createDataFrame([(k, h.embed_exact(e)[0]) for k, e in HAND.items()], "graph string, violations long"),
    "SELECT * FROM (VALUES ('T', 0::BIGINT), ('C4', 1), ('TAIL', 0), ('SPLIT', 0), ('CROSS', 0)) t(graph, violations)")

# --- components, kernels ------------------------------------------------------------------------
add("plus_components", lambda s, d: r.plus_components(day_edges(s, d)), f"""WITH RECURSIVE {DAY}, n AS (SELECT source AS v FROM e UNION SELECT target FROM e), p AS (SELECT source AS v, target AS u FROM e WHERE weight > 0 UNION SELECT target, source FROM e WHERE weight > 0),
    reach AS (SELECT v, v AS c FROM n UNION SELECT p.u, reach.c FROM reach JOIN p ON p.v = reach.v) SELECT v, min(c) AS comp FROM reach GROUP BY 1""")
add("pos_vertex_deletion", lambda s, d: r.drop_positive(day_edges(s, d), g.vertices(day_edges(s, d))), f"WITH {DAY}, {DEG} SELECT v FROM deg WHERE dm > 0")
add("two_mix_deletion", lambda s, d: r.drop_two_mix(day_edges(s, d), g.vertices(day_edges(s, d))), f"WITH {DAY}, {DEG} SELECT v FROM deg WHERE NOT (dp = 1 AND dm = 1)")


def _reach_sql(name: str, nodes: str, edges: str) -> str:
    """CTEs ``{name}`` (v, c): the smallest vertex c reached from v over ``edges`` (source, target) among ``nodes``."""
    return f"""{name}_b AS (SELECT source AS v, target AS u FROM {edges} UNION SELECT target, source FROM {edges}),
    {name}_r AS (SELECT v, v AS c FROM {nodes} UNION SELECT b.u, r.c FROM {name}_r r JOIN {name}_b b ON b.v = r.v),
    {name} AS (SELECT v, min(c) AS c FROM {name}_r GROUP BY 1)"""


def _kernel_sql(rounds: int) -> str:
    """The safe rules, unrolled: CTEs up to ``k{rounds}`` (v, c)."""
    out = [f"WITH RECURSIVE {DAY}, e0 AS (SELECT source, target, weight FROM e)"]
    for i in range(1, rounds + 1):
        old = f"e{i - 1}"
        out.append(f"""n{i} AS (SELECT source AS v FROM {old} WHERE weight < 0 UNION SELECT target FROM {old} WHERE weight < 0),
    i{i} AS (SELECT * FROM {old} WHERE source IN (SELECT v FROM n{i}) AND target IN (SELECT v FROM n{i})), p{i} AS (SELECT source, target FROM i{i} WHERE weight > 0)""")
        out.append(_reach_sql(f"k{i}", f"n{i}", f"p{i}"))
        out.append(f"e{i} AS (SELECT i.* FROM i{i} i JOIN k{i} a ON a.v = i.source JOIN k{i} b ON b.v = i.target WHERE a.c = b.c)")
    return ", ".join(out)


KERNEL_ROUNDS = 6
add("kernel_fixpoint", lambda s, d: r.kernelize(day_edges(s, d)), f"{_kernel_sql(KERNEL_ROUNDS)} SELECT v, c AS kernel FROM k{KERNEL_ROUNDS}")
#: No oracle: tested against a plain version of the rules.
add("kernel_fixpoint_unsafe", lambda s, d: r.kernelize(day_edges(s, d), unsafe=True))
add("largest_kernel", lambda s, d: r.largest_kernel(r.kernelize(day_edges(s, d))),
    f"{_kernel_sql(KERNEL_ROUNDS)} SELECT c AS kernel, count(*) AS n FROM k{KERNEL_ROUNDS} GROUP BY 1 ORDER BY n DESC, c LIMIT 1")


def _peel_sql(rounds: int) -> str:
    out, nodes = [f"WITH {DAY}, n0 AS (SELECT source AS v FROM e UNION SELECT target FROM e), b AS (SELECT source AS v, target AS u, weight FROM e UNION ALL SELECT target, source, weight FROM e)"], "n0"
    for i in range(1, rounds + 1):
        out.append(f"n{i} AS (SELECT v FROM {nodes} EXCEPT SELECT b.v FROM b WHERE b.v IN (SELECT v FROM {nodes}) AND b.u IN (SELECT v FROM {nodes}) GROUP BY 1 HAVING count(*) FILTER (WHERE weight > 0) = 1 AND count(*) FILTER (WHERE weight < 0) = 0)")
        nodes = f"n{i}"
    return ", ".join(out) + f" SELECT v FROM {nodes}"


add("leaf_peel", lambda s, d: r.leaf_peel(day_edges(s, d)), _peel_sql(8))
add("max_ratio_vertex", lambda s, d: r.max_ratio_vertex(day_edges(s, d)), f"WITH {DAY}, {DEG} SELECT v, greatest(dp, dm) / (dp + dm) AS ratio, least(dp, dm) AS violated FROM deg ORDER BY ratio DESC, v LIMIT 1")
add("chicken_rounds", lambda s, d: r.chicken(day_edges(s, d)))
#: What the smallest neighbour of x reaches without x; x cuts if that is not every neighbour.
_without = """b AS (SELECT source AS v, target AS u FROM e UNION SELECT target, source FROM e), lo AS (SELECT v AS x, min(u) AS v FROM b GROUP BY 1),
    w AS (SELECT x, v FROM lo UNION SELECT w.x, b.u FROM w JOIN b ON b.v = w.v WHERE b.u <> w.x),
    cut AS (SELECT DISTINCT b.v AS v FROM b ANTI JOIN w ON w.x = b.v AND w.v = b.u)"""
add("cut_vertices", lambda s, d: r.cut_vertices(day_edges(s, d)), f"WITH RECURSIVE {DAY}, {_without} SELECT v FROM cut")
_all = "SELECT source AS v FROM e UNION SELECT target FROM e"
add("cut_vertex_split", lambda s, d: r.cut_vertex_split(day_edges(s, d)), f"""WITH RECURSIVE {DAY}, {_without}, n AS ({_all}), {_reach_sql('c', 'n', 'e')},
    x AS (SELECT CASE WHEN (SELECT count(DISTINCT c) FROM c) > 1 THEN (SELECT min(v) FROM n) ELSE (SELECT min(v) FROM cut) END AS v),
    rest AS (SELECT source, target FROM e WHERE NOT coalesce(source = (SELECT v FROM x) OR target = (SELECT v FROM x), false)), {_reach_sql('q', 'n', 'rest')} SELECT v, c AS part FROM q""")
#: An edge is a bridge if its ends do not reach each other without it.
add("two_edge_components", lambda s, d: r.two_edge_components(day_edges(s, d)), f"""WITH RECURSIVE {DAY}, n AS ({_all}), b AS (SELECT source AS v, target AS u FROM e UNION SELECT target, source FROM e),
    w AS (SELECT source AS s, target AS t, source AS v FROM e UNION SELECT w.s, w.t, b.u FROM w JOIN b ON b.v = w.v WHERE NOT (b.v = w.s AND b.u = w.t) AND NOT (b.v = w.t AND b.u = w.s)),
    firm AS (SELECT s AS source, t AS target FROM w WHERE v = t), {_reach_sql('q', 'n', 'firm')} SELECT v, c AS comp FROM q""")
add("relabel_vertices", lambda s, d: r.relabel(g.vertices(day_edges(s, d))).withColumn("new_id", F.col("new_id").cast("long")), f"WITH {DAY} SELECT v, row_number() OVER (ORDER BY v) AS new_id FROM (SELECT source AS v FROM e UNION SELECT target FROM e)")

# --- heuristics, generator ------------------------------------------------------------------------
add("gaec_clusters", lambda s, d: h.gaec(day_edges(s, d).select(F.lit("day").alias("graph_id"), "source", "target", "weight")))
#: Epochs, early stop and timeout of the reference's configurations.
CONFIG = {"num_epochs": 10_000, "timeout_s": 180, "early_stopping_epochs": 50, "num_reassignment_chunks": 10, "temperature_decay_factor": 0.6666, "temperature_decay_epochs": 5}


def gaic_run_grid(s: SparkSession, d: str) -> DataFrame:
    runs = [CONFIG | {"run_id": f"{a}-{n}-{k}", "seed": k, "initial_temperature": t, "intervals": iv} for a, t in (("greedy", 0.0), ("annealed", 100.0)) for n, iv in (("chain8", lb.chain(8)), ("clusters4", lb.clusters(4))) for k in (1, 2)]
    return h.gaic_grid(day_edges(s, d), runs).drop("runtime_ms")


add("gaic_run_grid", gaic_run_grid)
add("bulk_sweep_labels", lambda s, d: h.bulk_sweep(day_edges(s, d), matrix(s), K, epochs=CONFIG["num_epochs"], patience=CONFIG["early_stopping_epochs"], timeout_s=CONFIG["timeout_s"])[0])
add("local_search_labels", lambda s, d: h.local_search(day_edges(s, d), user_labels(s, d).join(g.vertices(day_edges(s, d)), "v", "left_semi")))
N_PER, M_FRAC, P_RIGHT = 12, 0.3, 0.9
add("synthetic_graph", lambda s, d: h.synthetic_graph(s, lb.chain(K), N_PER, M_FRAC, P_RIGHT, 11),
    f"""SELECT x.i AS source, y.i AS target, CASE WHEN (abs(x.i // {N_PER} - y.i // {N_PER}) <= 1) = ({uniform_sql('11', "'sign'", 'x.i', 'y.i')} < {P_RIGHT}) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS weight
    FROM range({K * N_PER}) x(i) JOIN range({K * N_PER}) y(i) ON x.i < y.i WHERE {uniform_sql('11', "'keep'", 'x.i', 'y.i')} < {M_FRAC}""")


def planted(s: SparkSession) -> DataFrame:
    return s.range(K * N_PER).select(F.col("id").alias("v"), F.floor(F.col("id") / N_PER).cast("int").alias("label"))


add("planted_disagreement", lambda s, d: lb.agreement(h.synthetic_graph(s, lb.chain(K), N_PER, M_FRAC, P_RIGHT, 11), planted(s), matrix(s)).select("disagreement"),
    f"SELECT count(*)::DOUBLE AS disagreement FROM range({K * N_PER}) x(i) JOIN range({K * N_PER}) y(i) ON x.i < y.i WHERE {uniform_sql('11', "'keep'", 'x.i', 'y.i')} < {M_FRAC} AND {uniform_sql('11', "'sign'", 'x.i', 'y.i')} >= {P_RIGHT}")


def label_accuracy(s: SparkSession, d: str) -> DataFrame:
    guess = planted(s).withColumn("guess", F.floor(uniform(3, F.col("v")) * K).cast("int"))
    hit = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return guess.agg(F.round(hit(F.col("guess") == F.col("label")), 9).alias("accuracy"), F.round(hit(F.col("guess") == K - 1 - F.col("label")), 9).alias("mirrored"))


add("label_accuracy", label_accuracy, f"""WITH t AS (SELECT (v // {N_PER})::INT AS label, floor({uniform_sql('3', 'v')} * {K})::INT AS guess FROM range({K * N_PER}) r(v))
    SELECT round(avg(CASE WHEN guess = label THEN 1.0 ELSE 0.0 END), 9) AS accuracy, round(avg(CASE WHEN guess = {K - 1} - label THEN 1.0 ELSE 0.0 END), 9) AS mirrored FROM t""")

# --- reporting analytics --------------------------------------------------------------------------
add_sql("run_stats_pivot", RUNS + """, s AS (SELECT run, config, min(best) AS lo, avg(best) AS mid, stddev_samp(best) AS sd FROM trace GROUP BY run, config)
    SELECT run, max(CASE WHEN config = 'click' THEN lo END) AS min_click, round(max(CASE WHEN config = 'click' THEN mid END), 6) AS mean_click, round(max(CASE WHEN config = 'click' THEN sd END), 6) AS sd_click,
    max(CASE WHEN config = 'view' THEN lo END) AS min_view, round(max(CASE WHEN config = 'view' THEN mid END), 6) AS mean_view, round(max(CASE WHEN config = 'view' THEN sd END), 6) AS sd_view,
    max(CASE WHEN config = 'error' THEN lo END) AS min_error, round(max(CASE WHEN config = 'error' THEN mid END), 6) AS mean_error, round(max(CASE WHEN config = 'error' THEN sd END), 6) AS sd_error,
    max(CASE WHEN config = 'purchase' THEN lo END) AS min_purchase, round(max(CASE WHEN config = 'purchase' THEN mid END), 6) AS mean_purchase, round(max(CASE WHEN config = 'purchase' THEN sd END), 6) AS sd_purchase,
    max(CASE WHEN config = 'signup' THEN lo END) AS min_signup, round(max(CASE WHEN config = 'signup' THEN mid END), 6) AS mean_signup, round(max(CASE WHEN config = 'signup' THEN sd END), 6) AS sd_signup FROM s GROUP BY run""", "events")
add_sql("runtime_table", RUNS + """, t AS (SELECT run, config, max(runtime) AS runtime FROM trace GROUP BY run, config)
    SELECT config, round(avg(runtime) / 1000, 3) AS mean_s, round(stddev_samp(runtime) / 1000, 3) AS sd_s, max(runtime) AS max_ms FROM t GROUP BY config""", "events")
GAPFILL = """, b AS (SELECT run, CAST(ceil(runtime / 86400000.0::DOUBLE) AS BIGINT) AS bucket, best, runtime, id FROM trace),
    f AS (SELECT run, bucket, best FROM (SELECT run, bucket, best, row_number() OVER (PARTITION BY run, bucket ORDER BY runtime, id) AS n FROM b) x WHERE n = 1),
    g AS (SELECT r.run, k.bucket FROM (SELECT DISTINCT run FROM b) r CROSS JOIN (SELECT DISTINCT bucket FROM b) k),
    j AS (SELECT g.run, g.bucket, f.best FROM g LEFT JOIN f ON f.run = g.run AND f.bucket = g.bucket),
    p AS (SELECT run, bucket, best, count(best) OVER (PARTITION BY run ORDER BY bucket) AS block, min(CASE WHEN best IS NOT NULL THEN bucket END) OVER (PARTITION BY run) AS start FROM j),
    q AS (SELECT run, bucket, coalesce(max(best) OVER (PARTITION BY run, block), max(CASE WHEN bucket = start THEN best END) OVER (PARTITION BY run)) AS filled FROM p)
    SELECT run, bucket, min(filled) OVER (PARTITION BY run ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM q"""
add_sql("log_bucket_gapfill_all", RUNS + GAPFILL, "events")
add_sql("running_best", RUNS + "SELECT run, id, min(best) OVER (PARTITION BY run ORDER BY runtime, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM trace", "events")
add_sql("epochs_since_improvement", RUNS + """, t AS (SELECT run, id, best, row_number() OVER (PARTITION BY run ORDER BY runtime, id) AS epoch, min(best) OVER (PARTITION BY run ORDER BY runtime, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM trace)
    SELECT run, id, CAST(epoch - max(CASE WHEN before IS NULL OR best < before THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS BIGINT) AS stale FROM t""", "events")
add_sql("first_row_per_run", RUNS + "SELECT run, id, best FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY runtime, id) AS n FROM trace) x WHERE n = 1", "events")
add_sql("final_row_per_run", RUNS + "SELECT run, id, best FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY runtime DESC, id DESC) AS n FROM trace) x WHERE n = 1", "events")
add_sql("mean_sd_band", RUNS + """, t AS (SELECT config, CAST(floor(runtime / 86400000.0::DOUBLE) AS BIGINT) AS day, best FROM trace)
    SELECT config, day, round(avg(best), 6) AS mean, round(avg(best) - stddev_samp(best), 6) AS lo, round(avg(best) + stddev_samp(best), 6) AS hi FROM t GROUP BY config, day""", "events")
_box = """SELECT event_type AS config, {q}(value, 0.25) AS q1, {q}(value, 0.5) AS median, {q}(value, 0.75) AS q3,
    round({q}(value, 0.5) - 1.58 * ({q}(value, 0.75) - {q}(value, 0.25)) / sqrt(count(*)), 6) AS notch_lo, round({q}(value, 0.5) + 1.58 * ({q}(value, 0.75) - {q}(value, 0.25)) / sqrt(count(*)), 6) AS notch_hi FROM events GROUP BY event_type"""
add_sql("boxplot_stats", "SELECT config, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(notch_lo, 4) AS notch_lo, round(notch_hi, 4) AS notch_hi FROM (" + _box.format(q="percentile") + ") x", "events",
        duck="SELECT config, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(notch_lo, 4) AS notch_lo, round(notch_hi, 4) AS notch_hi FROM (" + _box.format(q="quantile_cont") + ") x")
add_sql("runtime_regression", """SELECT o_orderstatus AS status, round(regr_slope(o_totalprice, day), 4) AS slope, round(regr_intercept(o_totalprice, day), 2) AS intercept, round(regr_r2(o_totalprice, day), 6) AS r2
    FROM (SELECT o_orderstatus, o_totalprice, CAST(o_custkey % 1000 AS DOUBLE) AS day FROM orders) x GROUP BY o_orderstatus""", "orders")
add_sql("normalized_objective", RUNS + "SELECT run, config, round((min(best) - avg(best)) / nullif(sum(best), 0) * 100, 6) AS relative, CAST(round((1 - 0.9::DOUBLE) * 10) AS INT) AS flip_tenths FROM trace GROUP BY run, config", "events")
add_sql("best_per_group_ties", "SELECT p_brand, p_partkey, p_size FROM (SELECT *, min(p_size) OVER (PARTITION BY p_brand) AS lo FROM part) x WHERE p_size = lo", "part")
add_sql("first_affiliation", "SELECT user_id, event_type AS party FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) x WHERE n = 1", "events")
_party = "(SELECT user_id, event_type AS party FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) x WHERE n = 1) p"
add_sql("contingency_pivot", "SELECT user_id % 8 AS label, " + ", ".join(f"count(CASE WHEN party = '{p}' THEN 1 END) AS {p}" for p in ("click", "error", "purchase", "signup", "view")) + f" FROM {_party} GROUP BY user_id % 8", "events")
add_sql("party_counts", f"SELECT user_id % 8 AS label, party, count(*) AS n FROM {_party} GROUP BY user_id % 8, party", "events")
add_sql("weighted_center", f"SELECT party, round(CAST(sum(user_id % 8) AS DOUBLE) / count(*), 9) AS center FROM {_party} GROUP BY party", "events")
add_sql("column_distance", f"WITH t AS (SELECT k.label, q.party, count(p.user_id) AS n FROM (SELECT DISTINCT user_id % 8 AS label FROM events) k CROSS JOIN (SELECT DISTINCT event_type AS party FROM events) q LEFT JOIN {_party} ON p.user_id % 8 = k.label AND p.party = q.party GROUP BY k.label, q.party) "
        "SELECT a.party AS a, b.party AS b, round(sqrt(CAST(sum((a.n - b.n) * (a.n - b.n)) AS DOUBLE)), 9) AS distance FROM t a JOIN t b ON a.label = b.label AND a.party < b.party GROUP BY a.party, b.party", "events")
add_sql("grid_cross_product", "SELECT s.r_regionkey AS seed, n.n_name AS instance, p.p_brand AS config FROM region s CROSS JOIN nation n CROSS JOIN (SELECT DISTINCT p_brand FROM part) p", "region", "nation", "part")
add_sql("union_of_frames", "SELECT c_name AS name, c_acctbal AS balance, 'customer' AS filename FROM customer UNION ALL SELECT s_name, s_acctbal, 'supplier' FROM supplier", "customer", "supplier")
add_sql("time_bucket", RUNS + "SELECT id, CAST(ceil(runtime / 100.0::DOUBLE) * 100 AS BIGINT) AS bucket FROM trace", "events")
add_sql("vote_filter", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'ja' ELSE 'nein' END AS vote, CASE WHEN event_type = 'view' THEN 1 ELSE -1 END AS x FROM events WHERE event_type IN ('view', 'click')", "events")


def net_attraction(s: SparkSession, d: str) -> DataFrame:
    labels = user_labels(s, d)
    near = hour_sums(s, d, labels).select("v", F.col("near").alias("c"), (F.col("plus") - F.col("minus")).alias("a"), (F.col("plus") + F.col("minus")).alias("n"))
    pull = F.sum(F.when(F.col("c") != F.col("label"), F.col("a") / (F.col("c") - F.col("label"))).otherwise(0.0)) / F.nullif(F.sum("n"), F.lit(0.0))
    return near.join(labels, "v").groupBy("v", "label").agg(F.round(F.tanh(pull), 6).alias("net"))


add("net_attraction", net_attraction, f"""WITH {HOUR}, {LABELS}, t AS (SELECT n.v, l.label AS c, sum(weight) AS a, sum(abs(weight)) AS n FROM both_ n JOIN labels_ l ON l.v = n.u GROUP BY 1, 2)
    SELECT t.v, l.label, round(tanh(sum(CASE WHEN c <> l.label THEN a / (c - l.label) ELSE 0 END) / nullif(sum(n), 0)), 6) AS net FROM t JOIN labels_ l ON l.v = t.v GROUP BY 1, 2""")
add("neighbour_attraction", lambda s, d: hour_sums(s, d, user_labels(s, d)).select("v", F.col("near").alias("label"), (F.col("plus") - F.col("minus")).alias("attraction"), (F.col("plus") + F.col("minus")).alias("edges")),
    f"WITH {HOUR}, {LABELS} SELECT n.v, l.label, sum(weight) AS attraction, sum(abs(weight)) AS edges FROM both_ n JOIN labels_ l ON l.v = n.u GROUP BY 1, 2")

# --- scalar functions -----------------------------------------------------------------------------
#: Names as voters' lists have them, and what they stand for.
PARTY_NAMES = [
    ("SPD", "SPD"), (" spd. ", "SPD"), ("Sozialdemokratische Partei Deutschlands", "SPD"), ("CDU", "CDU"), ("Christlich-Demokratische Union", "CDU"), ("csu", "CSU"), ("Christlich Soziale Union", "CSU"),
    ("CDU/CSU", "CDU/CSU"), ("Union", "CDU/CSU"), ("BÜNDNIS 90/DIE GRÜNEN", "GRÜNE"), ("Bündnis90/ Die Grüne", "GRÜNE"), ("BÜ90/GR", "GRÜNE"), ("grüne", "GRÜNE"), ("Gruene", "GRÜNE"), ("FDP", "FDP"),
    ("Freie Demokratische Partei", "FDP"), ("DIE LINKE.", "LINKE"), ("Linkspartei.PDS", "LINKE"), ("Linke", "LINKE"), ("AfD", "AFD"), ("Alternative für Deutschland", "AFD"), ("BSW", "BSW"),
    ("Fraktionslos", "fraktionslos"), ("fraktionslose", "fraktionslos"), ("FDP/DVP", "FDP/DVP"), ("View", "View"), ("SPD und FDP", "SPD und FDP"),
]


def party_names(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n, _ in PARTY_NAMES])
    return table(s, d, "events").select("event_id", text.canonical_party(F.get(names, F.pmod("event_id", F.lit(len(PARTY_NAMES))).cast("int"))).alias("party"))


add("party_canonicalise", party_names, f"SELECT event_id, ([{', '.join(repr(p) for _, p in PARTY_NAMES)}])[(event_id % {len(PARTY_NAMES)}) + 1] AS party FROM events")
#: The oracle hides the German letters in the private use area while the engine strips accents.
_hidden = "".join(chr(0xE000 + i) for i in range(len(text.GERMAN)))
add("strip_accents_all", lambda s, d: table(s, d, "documents").select("doc_id", text.strip_accents(F.col("text")).alias("plain")),
    f"SELECT doc_id, translate(strip_accents(translate(text, '{text.GERMAN}', '{_hidden}')), '{_hidden}', '{text.GERMAN}') AS plain FROM documents")
add("extract_links", lambda s, d: io.extract_links(table(s, d, "pages")), "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages")
add("run_name_parse", lambda s, d: table(s, d, "part").select("p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(-1)).alias("number"), F.regexp_replace("p_type", "^[A-Z]+ ", "").alias("rest"), F.upper(F.regexp_extract("p_name", "^([a-z]+)", 1)).alias("first"), text.numbers_in(F.col("p_brand"))[0].alias("value")),
    "SELECT p_partkey, split_part(p_brand, '#', -1) AS number, regexp_replace(p_type, '^[A-Z]+ ', '') AS rest, upper(regexp_extract(p_name, '^([a-z]+)', 1)) AS first, try_cast(regexp_extract(p_brand, '(\\d+)', 1) AS DOUBLE) AS value FROM part")
add("name_parts", lambda s, d: table(s, d, "customer").select("c_custkey", text.drop_last_token(F.concat_ws(" ", F.col("c_mktsegment"), F.col("c_name"), F.lit("x"))).alias("name")),
    "SELECT c_custkey, regexp_replace(concat_ws(' ', c_mktsegment, c_name, 'x'), ' [^ ]*$', '') AS name FROM customer")
add("file_dates", lambda s, d: table(s, d, "orders").select("o_orderkey", text.file_date(F.when(F.col("o_orderkey") % 3 == 0, F.lit("votes.csv")).otherwise(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_votes.csv")))).alias("day")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
add("half_even_rounding", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 2, 0).alias("half")),
    "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half FROM lineitem")
add("orientation_table", lambda s, d: s.createDataFrame([(i, j, int(not (i == j or p.index(i) < p.index(j)))) for p in ([2, 0, 1],) for i in p for j in p], "i int, j int, aux int"),
    "WITH p(i, n) AS (VALUES (2::INT, 0), (0, 1), (1, 2)) SELECT a.i AS i, b.i AS j, CASE WHEN a.i = b.i OR a.n < b.n THEN 0 ELSE 1 END::INT AS aux FROM p a, p b")
add("solution_json", lambda s, d: io.solution_json(user_labels(s, d)),
    f"SELECT '{{{{' || chr(10) || string_agg('  \"' || v || '\" : ' || label, ',' || chr(10) ORDER BY v::VARCHAR) || chr(10) || '}}}}' AS json FROM (SELECT DISTINCT user_id AS v, user_id % {K} AS label FROM events)".replace("{{", "{").replace("}}", "}"))
add("graph_json", lambda s, d: io.graph_json(day_edges(s, d)),
    "WITH " + DAY + """ SELECT '{"edges":[' || string_agg('{"source":' || source || ',"target":' || target || ',"weight":' || CASE WHEN weight > 0 THEN '1.0' ELSE '-1.0' END || '}', ',' ORDER BY weight < 0, source, target) || ']}' AS json FROM e""")

# --- run grid, sweep, reports ---------------------------------------------------------------------
INSTANCES = ["bitcoinotc", "bundestag", "chess", "elec", "epinions", "slashdot", "wikiconflict", "wikisigned-k2"]
_values = lambda rows: ", ".join(str(x) for x in rows)
add("run_grid", lambda s, d: h.run_grid(s, INSTANCES),
    f"""WITH s(struct, k) AS (VALUES {_values([('intervals', k) for k in h.CHAINS] + [('clusters', k) for k in h.CLUSTERS])}), c(config, initial_temperature, chunks) AS (VALUES {_values((c, t, n) for c, (t, n) in h.CONFIGS.items())}),
    i(instance) AS (SELECT unnest({INSTANCES}))
    SELECT instance, struct, k::INT AS k, config, initial_temperature::DOUBLE AS initial_temperature, chunks::INT AS chunks, seed::INT AS seed FROM i, s, c, range(1, 51) r(seed)""")


def sweep_disagreement(s: SparkSession, d: str) -> DataFrame:
    """Edges and the planted labelling's disagreement for each p and m_frac of the generator's sweep."""
    rows = h.synthetic_sweep(s, lb.chain(K)).groupBy("m_frac", "p").agg(F.count("*").alias("edges"), F.count_if(~F.col("planted")).alias("disagreement"))
    return rows


add("synthetic_sweep", sweep_disagreement, f"""WITH u AS (SELECT {uniform_sql('5', "'keep'", 'x.i', 'y.i')} AS keep, {uniform_sql('5', "'sign'", 'x.i', 'y.i')} AS sign_ FROM range({K * h.SWEEP_N}) x(i) JOIN range({K * h.SWEEP_N}) y(i) ON x.i < y.i),
    m AS (SELECT unnest({list(h.SWEEP_M)}::DOUBLE[]) AS m_frac), p AS (SELECT unnest({list(h.SWEEP_P)}::DOUBLE[]) AS p)
    SELECT m_frac, p, count(*) AS edges, count(*) FILTER (WHERE sign_ >= p) AS disagreement FROM u, m, p WHERE keep < m_frac GROUP BY 1, 2""")
#: Vertices, edges and shown names of the benchmark's graphs.
DATASETS = {
    "bitcoinotc": (5881, 21434, "Bitcoin"), "bundestag": (1480, 397497, "Bundestag"), "chess": (7301, 32650, "Chess"), "elec": (7115, 100355, "WikiElec"), "epinions": (131580, 708507, "Epinions"),
    "slashdot": (138587, 498532, "Slashdot"), "wikiconflict": (116836, 2014053, "WikiConflict"), "wikisigned-k2": (138587, 712337, "WikiSigned"),
}
DATASET = "instance string, vertices long, edges long, shown string"


def run_report(s: SparkSession, d: str) -> DataFrame:
    """Runs (from events) with their names taken apart, filtered, joined with their graphs, and summed up."""
    pick = lambda values, n: F.get(F.array(*[F.lit(x) for x in values]), F.pmod(F.col(n), F.lit(len(values))).cast("int"))
    runs = table(s, d, "events").select(
        F.concat(pick(INSTANCES, "event_id"), F.lit("_signed.json")).alias("file"), F.concat_ws(" ", pick(["intervals", "clusters"], "user_id"), pick(["4", "8", "10", "16"], "event_id")).alias("struct"),
        F.concat(F.lit("config_"), pick(list(h.CONFIGS), "user_id"), F.lit(".json")).alias("config"), F.col("value").alias("best"),
    )
    runs = runs.select(
        F.regexp_replace("file", "_.*", "").alias("instance"), F.split_part("struct", F.lit(" "), F.lit(1)).alias("type"), text.numbers_in(F.col("struct"))[0].cast("int").alias("k"),
        text.algorithm_name(F.col("config")).alias("algorithm"), text.numbers_in(F.col("config"))[0].cast("int").alias("chunks"), (F.col("best") * 1000).alias("best"),
    )
    runs = runs.where("type = 'intervals' and k % 4 = 0 and chunks in (10, 100)")
    graphs = s.createDataFrame([(n, v, e, shown) for n, (v, e, shown) in DATASETS.items()], DATASET)
    stats = runs.join(F.broadcast(graphs), "instance").groupBy("shown", "vertices", "edges", "algorithm", "k").agg(F.count("*").alias("runs"), F.avg("best").alias("mean"), F.stddev_samp("best").alias("sd"))
    place = text.level_of(F.col("algorithm"), ["VENUS", "GAIA"])
    return stats.select("shown", "vertices", "edges", "algorithm", place.alias("place"), "k", "runs", text.mean_and_sd(F.col("mean"), F.col("sd"), 0).alias("average"))


def _pick_sql(values: list[str], n: str) -> str:
    return f"({list(values)})[({n} % {len(values)}) + 1]"


add("run_report", run_report, f"""WITH r AS (SELECT {_pick_sql(INSTANCES, 'event_id')} AS instance, {_pick_sql(['intervals', 'clusters'], 'user_id')} AS type, {_pick_sql(['4', '8', '10', '16'], 'event_id')}::INT AS k,
    {_pick_sql(list(h.CONFIGS), 'user_id')} AS config, value * 1000 AS best FROM events), g(instance, vertices, edges, shown) AS (VALUES {_values((n, *x) for n, x in DATASETS.items())}),
    t AS (SELECT shown, vertices::BIGINT AS vertices, edges::BIGINT AS edges, CASE WHEN config LIKE '%gaia%' THEN 'GAIA' ELSE 'VENUS' END AS algorithm, k, count(*) AS runs, avg(best) AS mean, stddev_samp(best) AS sd
        FROM r JOIN g USING (instance) WHERE type = 'intervals' AND k % 4 = 0 GROUP BY 1, 2, 3, 4, 5)
    SELECT shown, vertices, edges, algorithm, CASE algorithm WHEN 'VENUS' THEN 0 ELSE 1 END::INT AS place, k, runs, format('{{:,}}', round(mean)::BIGINT) || ' p ' || coalesce(format('{{:,}}', round(sd)::BIGINT), 'NA') AS average FROM t""")


def column_order(s: SparkSession, d: str) -> DataFrame:
    """Parties in the order that puts like columns of the contingency table side by side (five columns)."""
    rows = QUERIES["column_distance"](s, d).collect()
    order = h.leaf_order({(x["a"], x["b"]): x["distance"] for x in rows})
    return s.createDataFrame([(p, i) for i, p in enumerate(order)], "party string, place int")


add("column_order", column_order, f"""WITH z AS ({ORACLES['column_distance']}), p AS (SELECT a AS n FROM z UNION SELECT b FROM z),
    d AS (SELECT a, b, distance FROM z UNION ALL SELECT b, a, distance FROM z),
    best AS (SELECT a.n AS n1, b.n AS n2, c.n AS n3, x.n AS n4, y.n AS n5, round(d1.distance + d2.distance + d3.distance + d4.distance, 9) AS length FROM p a JOIN p b ON b.n <> a.n JOIN p c ON c.n NOT IN (a.n, b.n) JOIN p x ON x.n NOT IN (a.n, b.n, c.n)
        JOIN p y ON y.n NOT IN (a.n, b.n, c.n, x.n) JOIN d d1 ON d1.a = a.n AND d1.b = b.n JOIN d d2 ON d2.a = b.n AND d2.b = c.n JOIN d d3 ON d3.a = c.n AND d3.b = x.n JOIN d d4 ON d4.a = x.n AND d4.b = y.n ORDER BY length, n1, n2, n3, n4, n5 LIMIT 1)
    SELECT unnest([n1, n2, n3, n4, n5]) AS party, unnest([0, 1, 2, 3, 4])::INT AS place FROM best""")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
