import json
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalloom.functions import text
from signalloom.operators import graph as g
from signalloom.operators import heuristics as h
from signalloom.operators import labels as lb
from signalloom.operators import reduce as r
from signalloom.plans.registry import HAND
from signalloom.sources import io

#: Vertices of the kernels and those left by peeling, by hand.
KERNEL = {"T": set(), "C4": {1, 2, 3, 4}, "TAIL": set(), "SPLIT": set(), "CROSS": set()}
PEEL = {"T": {1, 2, 3}, "C4": {1, 2, 3, 4}, "TAIL": {1, 2, 3}, "SPLIT": {1, 2, 3, 4, 5, 6}, "CROSS": {1, 2, 3, 4}}
CHAIN4 = {"T": 0, "C4": 1, "TAIL": 0, "SPLIT": 0, "CROSS": 0}
CLUSTERS2 = {"T": 1, "C4": 2, "TAIL": 1, "SPLIT": 2, "CROSS": 0}


def edges_of(spark, name):
    return spark.createDataFrame([(a, b, float(s)) for a, b, s in HAND[name]], "source long, target long, weight double")


@pytest.mark.parametrize("name", HAND)
def test_kernel_and_peel(spark, name):
    assert {x["v"] for x in r.kernelize(edges_of(spark, name)).collect()} == KERNEL[name]
    assert {x["v"] for x in r.leaf_peel(edges_of(spark, name)).collect()} == PEEL[name]


def _best(edges, intervals):
    nodes = sorted({v for a, b, _ in edges for v in (a, b)})
    meets = [[x[0] <= y[1] and y[0] <= x[1] for y in intervals] for x in intervals]
    return min(sum(meets[p[nodes.index(a)]][p[nodes.index(b)]] != (s > 0) for a, b, s in edges) for p in product(range(len(intervals)), repeat=len(nodes)))


@pytest.mark.parametrize("name", HAND)
def test_optima_by_hand(name):
    assert h.embed_exact(HAND[name])[0] == (1 if name == "C4" else 0)
    assert _best(HAND[name], lb.chain(4)) == CHAIN4[name]
    assert _best(HAND[name], lb.clusters(2)) == CLUSTERS2[name]


small_graphs = st.dictionaries(st.tuples(st.integers(0, 5), st.integers(0, 5)).filter(lambda p: p[0] < p[1]), st.sampled_from([-1, 1]), min_size=1, max_size=9)


@settings(max_examples=40, deadline=None)
@given(small_graphs)
def test_exact_embedding_bounds_and_reaches(graph):
    edges = [(a, b, s) for (a, b), s in graph.items()]
    cost, ends = h.embed_exact(edges)
    assert cost == sum((ends[a][0] < ends[b][1] and ends[b][0] < ends[a][1]) != (s > 0) for a, b, s in edges)
    assert cost <= _best(edges, lb.chain(3))


@settings(max_examples=30, deadline=None)
@given(small_graphs, st.integers(0, 99), st.sampled_from([0.0, 5.0]))
def test_sequential_run_tracks_its_own_agreement(graph, seed, t):
    nodes = sorted({v for p in graph for v in p})
    pairs = np.array([[nodes.index(a), nodes.index(b)] for a, b in graph])
    weights = np.array(list(graph.values()), float)
    overlap = np.abs(np.subtract.outer(range(4), range(4))) <= 1
    config = {"num_epochs": 6, "timeout_s": 9, "early_stopping_epochs": 5, "num_reassignment_chunks": 3, "initial_temperature": t, "temperature_decay_factor": 0.5, "temperature_decay_epochs": 2}
    labels, trace = h.gaic_run(pairs, weights, len(nodes), overlap, config, seed)
    agreed = sum(abs(w) for (a, b), w in zip(pairs, weights) if overlap[labels[a], labels[b]] == (w > 0))
    assert trace[-1][4] == pytest.approx(abs(weights).sum() - agreed)


def test_contraction_sums_parallel_edges():
    got = h.contract([(1, 2, 3.0), (2, 3, -1.0), (1, 3, 0.5)])
    assert got == {1: 1, 2: 1, 3: 3}
    assert set(h.contract([(1, 2, 1.0), (2, 3, -1.0)], target=2).values()) == {1, 3}


def test_chicken_cuts_and_bridges(spark):
    assert r.chicken(edges_of(spark, "C4")).agg({"violated": "sum"}).first()[0] >= 1
    assert {x["v"] for x in r.cut_vertices(edges_of(spark, "TAIL")).collect()} == {3, 4}
    comps = {x["v"]: x["comp"] for x in r.two_edge_components(edges_of(spark, "TAIL")).collect()}
    assert comps == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_bulk_sweep_and_local_search_improve(spark):
    edges = h.synthetic_graph(spark, lb.chain(4), 8, 0.5, 1.0, 3)
    matrix = lb.overlap_matrix(lb.structure(spark, lb.chain(4)))
    labels, trace = h.bulk_sweep(edges, matrix, 4, epochs=6)
    assert lb.agreement(edges, labels, matrix).first()["agreement"] == trace[-1]["best_agreement"] >= trace[0]["best_agreement"]
    start = g.vertices(edges).selectExpr("v", "cast(v % 3 as int) as label")
    end = h.local_search(edges, start, rounds=3)
    assert lb.cc_violations(edges, end).first()[0] < lb.cc_violations(edges, start).first()[0]


def test_local_search_ends_in_a_local_optimum(spark):
    edges = h.synthetic_graph(spark, lb.chain(4), 60, 0.1, 0.9, 3)
    start = g.vertices(edges).selectExpr("v", "cast(v % 5 as int) as label").localCheckpoint()
    end = h.local_search(edges, start)
    moved = start.join(end.withColumnRenamed("label", "now"), "v").where("label <> now").count()
    assert moved > 100 and h.best_move(edges, end).first()["delta"] >= 0


def test_registered_runs_have_the_references_ends():
    from signalloom.plans.registry import CONFIG

    assert (CONFIG["num_epochs"], CONFIG["early_stopping_epochs"], CONFIG["timeout_s"]) == (10_000, 50, 180)


def test_mapping_wants_equal_numbers(spark):
    labels = g.vertices(edges_of(spark, "C4")).selectExpr("v", "cast(v % 3 as int) as label")
    with pytest.raises(ValueError):
        h.map_clusters(edges_of(spark, "C4"), labels, lb.chain(4))


def test_dirty_edge_lists(spark):
    lines = spark.createDataFrame([("# c",), ("% c",), ("MULTICUT",), ("1 2",), ("3 3 1",), ("1,2;-4 x",), ("2 1 5",), ("4#5\t0",), ("4 6 2",), ("6 4 -2",)], "value string")
    assert {tuple(x) for x in io.signed_edges(lines).collect()} == {(1, 2, -1.0), (4, 5, 1.0), (4, 6, -1.0)}
    assert {tuple(x) for x in io.weighted_edges(lines).collect()} == {(1, 2, 1.0), (4, 5, 0.0), (4, 6, 0.0)}


def test_json_round_trips(spark, tmp_path):
    edges = edges_of(spark, "SPLIT")
    io.write_json(io.graph_json(edges), str(tmp_path / "g"))
    assert {tuple(x) for x in io.read_graph_json(spark, str(tmp_path / "g")).collect()} == {tuple(x) for x in edges.collect()}
    labels = g.vertices(edges).selectExpr("v", "cast(v % 2 as int) as label")
    io.write_json(io.solution_json(labels), str(tmp_path / "s"))
    assert {tuple(x) for x in io.read_labelling_json(spark, str(tmp_path / "s")).collect()} == {tuple(x) for x in labels.collect()}
    io.write_multicut(edges, str(tmp_path / "m"))
    assert {tuple(x) for x in io.read_signed_edge_list(spark, str(tmp_path / "m")).collect()} == {tuple(x) for x in edges.collect()}
    io.write_tsv(edges, str(tmp_path / "t"))
    assert io.read_signed_edge_list(spark, str(tmp_path / "t")).count() == 7
    (tmp_path / "i.json").write_text(json.dumps({"intervals": [{"start": 0, "end": 1}, {"start": 1, "end": 2}]}))
    matrix = lb.overlap_matrix(io.read_structure_json(spark, str(tmp_path / "i.json")), closed=False)
    assert matrix.where("overlap").count() == 2


def test_missing_field_fails(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"edges": [{"source": 1, "target": 2}]}')
    with pytest.raises(Exception, match="missing"):
        io.read_graph_json(spark, str(tmp_path / "g.json")).collect()


def test_names_and_parties(spark):
    rows = spark.createDataFrame([("José",), ("Müller",), ("cdu/csu.",), ("Grüne",), ("other",), (None,)], "x string")
    assert [x[0] for x in rows.select(text.strip_accents(rows.x)).collect()] == ["Jose", "Müller", "cdu/csu.", "Grüne", "other", None]
    assert [x[0] for x in rows.select(text.canonical_party(rows.x)).collect()][2:5] == ["CDU/CSU", "GRÜNE", "other"]


def test_whole_table_queries_leave_no_row_out(spark, tmp_path):
    import __spark_entry__ as e

    duckdb = pytest.importorskip("duckdb")
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    got = {tuple(x) for x in e.queries()["log_bucket_gapfill_all"](spark, d).collect()}
    assert got == set(con.execute(e.oracle_sql()["log_bucket_gapfill_all"]).fetchall())
    assert {x[0] for x in got} == {x[0] for x in con.execute("SELECT DISTINCT user_id FROM events").fetchall()}
    rows = [(1, "José", "es"), (2, "Müller fährt, Große Äpfel", "de"), (3, "Čeština é", None), (4, None, "fr"), (5, "naïve", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    plain = {x["doc_id"]: x["plain"] for x in e.queries()["strip_accents_all"](spark, str(tmp_path)).collect()}
    assert plain == {1: "Jose", 2: "Müller fährt, Große Äpfel", 3: "Cestina e", 4: None, 5: "naive"}


def test_covote_thresholds_are_strict(spark):
    def votes(pairs):
        rows = [(p, str(i), float(x)) for i, (a, b) in enumerate(pairs) for p, x in ((1, a), (2, b))]
        return g.covote_edges(spark.createDataFrame(rows, "person long, ballot string, x double")).collect()

    assert votes([(1, 1)] * 2) == []
    assert votes([(1, 1)] * 3)[0]["weight"] == 1
    assert votes([(1, 1)] * 3 + [(1, -1)]) == []
    assert votes([(1, -1)] * 4)[0]["weight"] == -1
    assert votes([(1, 1)] * 2 + [(0, 1)]) == []


def test_empty_graph(spark):
    empty = spark.createDataFrame([], "source long, target long, weight double")
    assert r.kernelize(empty).count() == r.leaf_peel(empty).count() == r.chicken(empty).count() == 0
    assert lb.totals(empty).first()["total"] == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
