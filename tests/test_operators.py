"""Operators against plain versions, and the command line."""

import json
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalloom import __main__ as cli
from signalloom.functions import text
from signalloom.operators import graph as g
from signalloom.operators import heuristics as h
from signalloom.operators import labels as lb
from signalloom.operators import reduce as r
from signalloom.plans import registry
from signalloom.sources import io

EDGES = "source long, target long, weight double"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_numbered_is_the_place_in_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 50), i) for i in range(3000)]
    got = g.numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"], "n")
    assert got.columns == ["a", "b", "n"] and [x[:2] for x in sorted(map(tuple, got.collect()), key=lambda x: x[2])] == sorted(rows)
    assert sorted(x["n"] for x in got.collect()) == list(range(3000))
    assert g.numbered(spark.createDataFrame([], "a int"), ["a"], "n").count() == 0


def test_large_ballots_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    votes = spark.createDataFrame([(p, b, rng.choice([1.0, -1.0])) for b in range(6) for p in range(40) if rng.random() < 0.8], "person long, ballot int, x double")
    whole = rows_of(g.covote_edges(votes).select("source", "target", "support", "ratio", "weight"))
    monkeypatch.setattr(g, "BALLOT_BLOCK", 3)
    assert rows_of(g.covote_edges(votes).select("source", "target", "support", "ratio", "weight")) == whole and whole


def test_votes_become_a_graph(spark):
    files = ["20091027_a.csv", "20131022_b.csv", "x20131022.csv", "20131023_c.csv", "20140101_d.csv"]
    rows = [(f, "n", "v", name, "ja" if (name, f) != ("C", files[3]) else "nein") for f in files for name in ("C", "A", "B")]
    votes = spark.createDataFrame(rows, "filename string, Name string, Vorname string, Bezeichnung string, janein string")
    anonymous, edges = g.votes_to_graph(votes, [18])
    assert anonymous.columns == ["filename", "janein", "person_id"] and {x["filename"] for x in anonymous.collect()} == {files[1], files[3], files[4]}
    assert sorted((x["source"], x["target"], x["weight"]) for x in edges.collect()) == [(0, 1, 1.0)]  # C agrees on two of three only
    assert g.in_periods(votes, []).count() == len(rows)
    with pytest.raises(ValueError, match="periods"):
        g.in_periods(votes, [16])


def test_ids_go_and_come_back(spark):
    edges = spark.createDataFrame([(70, 5, 1.0), (5, 900, -1.0)], EDGES)
    ids = g.dense_ids(edges)
    small = g.remap(edges, ids)
    assert rows_of(small) == [(0, 2, -1.0), (1, 0, 1.0)]
    labels = spark.createDataFrame([(0, 4), (1, 5), (2, 6)], "v long, label int")
    assert rows_of(g.restore(labels, ids)) == [(5, 4), (70, 5), (900, 6)]


def test_accents_by_character():
    def plain(s):
        out = []
        for c in s:
            out.append(c if c in text.GERMAN else "".join(d for d in unicodedata.normalize("NFKD", c) if unicodedata.category(d) != "Mn"))
        return unicodedata.normalize("NFC", "".join(out))

    rng = random.Random(4)
    for _ in range(500):
        s = "".join(rng.choice("aäöüßÄeéèñçÅøŁ한글½ﬁ日ụ̈́ .") for _ in range(rng.randint(0, 20)))
        assert text._strip(s) == plain(s), repr(s)
    assert text._strip("ü ü") == "u ü" and text._strip(None) is None


def test_party_names(spark):
    rows = spark.createDataFrame([(n, want) for n, want in registry.PARTY_NAMES], "n string, want string")
    assert [x["n"] for x in rows.where(text.canonical_party(F.col("n")) != F.col("want")).collect()] == []
    assert spark.createDataFrame([(None,)], "n string").select(text.canonical_party(F.col("n"))).first()[0] is None


def _components(nodes, pairs):
    label = {v: v for v in nodes}
    for _ in nodes:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def _parts(nodes, edges, safe):
    """The kernel rules by the book, recursively: frozen sets of vertices."""
    kept = {v for a, b, w in edges if w < 0 for v in (a, b)}
    inner = [e for e in edges if e[0] in kept and e[1] in kept]
    if not safe:
        def degree(v, sign):
            return sum(v in e[:2] and e[2] * sign > 0 for e in inner)

        kept = {v for v in kept if not (degree(v, 1) == 1 and degree(v, -1) == 1)}
        inner = [e for e in inner if e[0] in kept and e[1] in kept]
    label = _components(kept, [e[:2] for e in inner if e[2] > 0])
    if not safe:
        same = [e for e in inner if label[e[0]] == label[e[1]]]
        bridges = set()
        for e in same:
            rest = _components(kept, [f[:2] for f in same if f != e])
            if rest[e[0]] != rest[e[1]]:
                bridges.add(e)
        label = _components(kept, [e[:2] for e in same if e not in bridges])
    parts = [{v for v in kept if label[v] == c} for c in set(label.values())]
    if len(parts) < 2:
        return [frozenset(p) for p in parts]
    out = []
    for p in parts:
        out += _parts(p, [e for e in inner if e[0] in p and e[1] in p], True)
    return out


@pytest.mark.parametrize("unsafe", [False, True])
def test_kernels_by_the_book(spark, unsafe):
    rng = random.Random(7)
    for n, m in [(6, 7), (12, 18), (14, 16)]:
        pairs = rng.sample([(a, b) for a in range(n) for b in range(a)], m)
        edges = [(a, b, rng.choice([1.0, 1.0, -1.0])) for a, b in pairs]
        got = {}
        for v, k in r.kernelize(spark.createDataFrame(edges, EDGES), unsafe=unsafe).collect():
            got.setdefault(k, set()).add(v)
        want = _parts({v for e in edges for v in e[:2]}, edges, not unsafe)
        assert {frozenset(x) for x in got.values()} == set(want), edges


def test_greedy_deletion_by_the_book(spark):
    rng, total = random.Random(3), 0
    for n, m in [(8, 14), (14, 40)]:
        edges = [(a, b, rng.choice([1.0, 1.0, -1.0])) for a, b in rng.sample([(a, b) for a in range(n) for b in range(a)], m)]
        want = []
        for part in _parts({v for e in edges for v in e[:2]}, edges, True):
            left, cost = [e for e in edges if e[0] in part and e[1] in part], 0
            while left:
                signs = {}
                for a, b, w in left:
                    for v in (a, b):
                        signs.setdefault(v, []).append(w > 0)
                ratio = {v: max(sum(s), len(s) - sum(s)) / len(s) for v, s in signs.items()}
                v = min(ratio, key=lambda v: (-ratio[v], v))
                cost += min(sum(signs[v]), len(signs[v]) - sum(signs[v]))
                left = [e for e in left if v not in e[:2]]
            want.append((min(part), cost))
        assert rows_of(r.chicken(spark.createDataFrame(edges, EDGES))) == sorted(want)
        total += sum(c for _, c in want)
    assert total > 0


def test_cut_vertex_split(spark):
    def parts(pairs):
        got = {}
        for v, p in r.cut_vertex_split(spark.createDataFrame([(a, b, -1.0) for a, b in pairs], EDGES)).collect():
            got.setdefault(p, set()).add(v)
        return got

    assert parts([(1, 2), (2, 3), (3, 4), (4, 2)]) == {1: {1}, 2: {2}, 3: {3, 4}}
    assert parts([(1, 2), (2, 3), (3, 1)]) == {1: {1, 2, 3}}
    assert parts([(1, 2), (2, 5), (5, 1), (3, 4)]) == {1: {1}, 2: {2, 5}, 3: {3, 4}}


def test_edge_lines_with_blanks_and_bad_fields(spark, tmp_path):
    lines = spark.createDataFrame([("\t1 2 1",), (" # no",), ("  MULTICUT",), ("a b c",), ("3,4;-2\tx\r",), ("5 6",), ("\x0b7\t8  1\x0c",)], "value string")
    assert rows_of(io.parse_edge_lines(lines)) == [(1, 2, 1.0), (3, 4, -2.0), (7, 8, 1.0)]
    io.write_multicut(spark.createDataFrame([(1, 2, -1.0), (2, 3, 1.0), (0, 9, -1.0)], EDGES), str(tmp_path / "m"))
    assert [x["value"] for x in spark.read.text(str(tmp_path / "m")).collect()] == ["MULTICUT", "2 3 1", "0 9 -1", "1 2 -1"]


def test_names_levels_and_formats(spark):
    rows = spark.createDataFrame([("config_gaia_chunks_10.json", 1234.56, 0.04), ("config_venus_chunks_100.json", 2.0, None)], "c string, m double, s double")
    got = rows.select(text.algorithm_name(F.col("c")), text.mean_and_sd(F.col("m"), F.col("s")), text.level_of(text.algorithm_name(F.col("c")), ["VENUS", "GAIA"])).collect()
    assert [tuple(x) for x in got] == [("GAIA", "1,234.6 p 0", 1), ("VENUS", "2 p NA", 0)]


def test_leaf_order_and_limits():
    places = {"a": 0, "b": 10, "c": 3, "d": 7}
    assert h.leaf_order({(x, y): abs(places[x] - places[y]) for x in places for y in places if x < y}) == ["a", "c", "d", "b"]
    edges = [(a, b, 1 if (a + b) % 3 else -1) for a in range(7) for b in range(a)]
    best, found, proven = h.embed_within(edges, 0.0)
    assert not proven and len(found) == 7 and best >= h.embed_exact(edges)[0] and h.embed_within(edges[:3], 60)[2]


def test_run_grid_and_summary(spark):
    grid = h.run_grid(spark, ["a", "b"], seeds=2)
    assert grid.count() == 2 * 15 * 4 * 2
    runs = h.grid_runs(grid.where("instance = 'a' and k <= 4 and seed = 1 and config like '%10'"))
    runs = [x | {"num_epochs": 6} for x in runs]
    edges = spark.createDataFrame([(a, b, 1.0 if b - a < 3 else -1.0) for a in range(12) for b in range(a + 1, 12)], EDGES)
    trace = g.checkpoint(h.gaic_grid(edges, runs))
    last = {x["run_id"]: x for x in io.run_summary(trace).collect()}
    assert len(last) == len(runs) == 6 and all(x["epoch"] == 5 for x in last.values())
    assert all(x["best"] <= x["current"] and 0 <= x["best"] <= x["edge_weight"] for x in trace.collect())
    stats = io.run_statistics(edges, spark.range(12).selectExpr("id as v", "cast(id / 3 as int) as label"), lb.structure(spark, lb.chain(4))).first()
    assert stats["n_edges"] == 66 and stats["n_labels"] == 4 and stats["agreement"] + stats["disagreement"] == 66


def test_command_line(spark, tmp_path):
    struct, config, edges = tmp_path / "s.json", tmp_path / "c.json", tmp_path / "e.txt"
    struct.write_text(json.dumps({"intervals": [{"start": a, "end": b} for a, b in lb.chain(4)]}, indent=1))
    config.write_text(json.dumps({**h.LIMITS, "num_epochs": 4, "num_reassignment_chunks": 2, "initial_temperature": 1.0}, indent=1))
    edges.write_text("# x\n1 2 1\n2 3 1\n3 4 1\n1 4 1\n1 3 -1\n2 4 -1\n")
    cli.main(["synthetic", str(struct), str(tmp_path / "syn"), "--n-per-interval", "3"], spark)
    graphs = spark.read.parquet(str(tmp_path / "syn/graphs"))
    assert graphs.where("p = 1.0 and not planted").count() == 0 and graphs.where("m_frac = 1.0 and p = 0.5").count() == 66
    cli.main(["kernelize", str(edges), str(tmp_path / "k")], spark)
    assert spark.read.csv(str(tmp_path / "k"), header=True).count() == 4
    io.write_json(io.graph_json(io.read_signed_edge_list(spark, str(edges))), str(tmp_path / "g"))
    cli.main(["gaic", str(tmp_path / "g"), str(struct), str(config), str(tmp_path / "run"), "--seed", "3"], spark)
    assert spark.read.csv(str(tmp_path / "run/trace"), header=True).count() == 4 and spark.read.csv(str(tmp_path / "run/summary"), header=True).first()["run_id"] == "seed3"
    votes = tmp_path / "v.csv"
    votes.write_text("filename,Name,Vorname,Fraktion/Gruppe,ja/nein,Wahlperiode,janein,Bezeichnung\n" + "".join(f"2014010{d}_x.csv,a,b,SPD,ja,18,{x},{p}\n" for d in (1, 2, 3) for p, x in (("A", "ja"), ("B", "ja"), ("C", "nein"))))
    cli.main(["graph-from-votes", str(votes), str(tmp_path / "vg"), "--periods", "18"], spark)
    assert sorted(x["value"] for x in spark.read.text(str(tmp_path / "vg/edges")).collect()) == ["# FromNodeId\tToNodeId\tSign", "0\t1\t1", "0\t2\t-1", "1\t2\t-1"]
    with pytest.raises(ValueError, match="periods"):
        cli.main(["graph-from-votes", str(votes), str(tmp_path / "no"), "--periods", "3"], spark)


def test_a_shared_folder_is_required_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://x:7077"}.get(key, default)

    class Session:
        conf = Conf()

    class Frame:
        sparkSession = Session()

    with pytest.raises(ValueError, match="checkpoint"):
        g.checkpoint(Frame())


def test_meetings_make_no_rows(spark, monkeypatch):
    rng = random.Random(3)
    votes = spark.createDataFrame([(f"p{p}", b, rng.choice([1.0, -1.0, 0.0])) for b in range(9) for p in range(50) for _ in range(rng.choice([0, 1, 1, 2, 3]))] + [(None, 1, 1.0), ("p1", None, 1.0)], "person string, ballot int, x double")
    monkeypatch.setattr(g, "BALLOT_BLOCK", 3)
    monkeypatch.setattr(g, "PERSON_BLOCK", 12, raising=False)
    monkeypatch.setattr(g, "TILE", 5, raising=False)
    edges = g.covote_edges(votes)
    assert "Join" not in edges._jdf.queryExecution().toString()  # no row for each two votes on a ballot
    x = votes.where("person is not null and ballot is not null").groupBy("person", "ballot").agg(F.avg("x").alias("x")).where("x <> 0")
    assert rows_of(edges) == rows_of(g._edges_by_ballot(x, 0.75, 3)) and edges.count() > 50
    for share in (0, 2):  # all columns dense, all sparse
        monkeypatch.setattr(g, "DENSE_SHARE", share)
        monkeypatch.setattr(g, "SPARSE_PAIRS", 7)
        a, b = np.array([3, 3, 1, 9, 9]), np.array([9, 3, 9, 4])
        at_a, at_b = np.array([0, 1, 1, 0, 2]), np.array([0, 1, 1, 0])
        assert g._common(a, at_a, 3, b, at_b, 2).tolist() == [[1, 2], [0, 1], [1, 1]]


def test_labelled_sums_make_no_edges(spark, monkeypatch):
    """Sums by neighbours' labels are those of the edges, with persons without a label, in few and many blocks."""
    rng = random.Random(4)
    votes = spark.createDataFrame([(p, b, rng.choice([1.0, -1.0, 1.0])) for b in range(9) for p in range(60) for _ in range(rng.choice([0, 1, 1, 2]))], "person long, ballot int, x double")
    labels = spark.createDataFrame([(p, None if p % 11 == 3 else p % 5) for p in range(50)], "v long, label int")
    named = labels.where("label is not null")
    matrix = lb.overlap_matrix(lb.structure(spark, lb.chain(5)))
    mapping = spark.createDataFrame([(i, (3 * i) % 5) for i in range(4)], "label int, interval int")
    edges = g.checkpoint(g.covote_edges(votes))
    want = rows_of(lb.neighbour_sums(edges, named))
    assert len(want) > 100 and any(w[3] for w in want)
    for block, tile in ((4_096, 1_024), (13, 4)):
        monkeypatch.setattr(g, "PERSON_BLOCK", block)
        monkeypatch.setattr(g, "TILE", tile)
        sums = lb.covote_neighbour_sums(votes, labels)
        plan = sums._jdf.queryExecution().toString()
        assert "Join" not in plan and "explode" not in plan.split("FlatMapGroups")[0]  # neither edges nor their ends make rows
        assert rows_of(sums) == want
        near = g.checkpoint(lb.covote_neighbour_sums(votes, named))
        assert rows_of(lb.agreement_of(near, named, matrix)) == rows_of(lb.agreement(edges, named, matrix))
        assert rows_of(lb.interval_violations_of(near, named, lb.structure(spark, lb.chain(5)), mapping)) == rows_of(lb.interval_violations(edges, named, lb.structure(spark, lb.chain(5)), mapping))
        pairs = lb.label_pairs(near, named).withColumnsRenamed({"plus": "p", "minus": "m"})
        assert h.map_pairs(pairs, named, lb.chain(5)) == h.map_clusters(edges, named, lb.chain(5))
    monkeypatch.setattr(g, "SUMMED_LABELS", 4)
    assert g.covote_sums(votes, named) is None and rows_of(lb.covote_neighbour_sums(votes, named)) == want


def test_both_directions_are_written_as_runs(spark, monkeypatch, tmp_path):
    """The closure has the edges' directions, in few and many blocks, in less than three quarters of the room."""
    rng = random.Random(6)
    rows = [(p * 40 + h, p, h, rng.choice([20.0, 80.0, 80.0])) for p in range(300) for h in rng.sample(range(40), 20)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, h int, value double").selectExpr("event_id", "timestamp_seconds(1704067200 + 3600 * h) as ts", "user_id", "'view' as event_type", "value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    edges = g.checkpoint(registry.hour_edges(spark, str(tmp_path)))
    want, size = rows_of(g.directed(edges)), {}
    assert len(want) > 10_000 and {w[2] for w in want} == {1.0, -1.0}
    closure = registry.QUERIES["symmetric_closure"](spark, str(tmp_path))
    for name, df in (("closure", closure), ("directed", g.directed(edges))):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        size[name] = sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
    assert rows_of(spark.read.parquet(str(tmp_path / "closure"))) == want
    assert 4 * size["closure"] < 3 * size["directed"]
    monkeypatch.setattr(g, "PERSON_BLOCK", 70)
    monkeypatch.setattr(g, "TILE", 9)
    assert rows_of(registry.QUERIES["symmetric_closure"](spark, str(tmp_path))) == want
    few = spark.createDataFrame([(p, b, x) for b, x in ((0, 1.0), (1, 1.0), (2, -1.0)) for p in (1, 2)], "person long, ballot int, x double")
    assert rows_of(g.covote_directed(few)) == [(1, 2, 1.0), (2, 1, 1.0)]


def test_a_block_is_packed_tightly():
    """As many persons, votes and hours as a block of the events has."""
    rng = np.random.default_rng(3)
    votes = pa.table({"block": np.zeros(200_000, np.int32), "person": rng.integers(0, 4_096, 200_000) * 7, "ballot": rng.integers(0, 744, 200_000) + (5 << 33), "x": rng.choice([-1.0, 1.0, 1 / 3], 200_000)})
    packed = g._pack_block(votes)
    assert sum(len(packed.column(c)[0].as_py()) for c in packed.column_names[2:]) < 1.5 * len(votes)
    block, persons, ballots, places, xs = g._unpack_block(packed.to_batches()[0], 0)
    got = sorted(zip(persons.to_numpy()[places].tolist(), ballots.tolist(), xs.tolist()))
    assert block == 0 and got == sorted(zip(*(votes.column(c).to_pylist() for c in ("person", "ballot", "x"))))


def test_edges_are_not_dealt_for_their_vertices(spark):
    """Queries on the co-voting graph read it once, or once a round, and exchange only what was summed."""
    d = "/root/testdata/sf0.01"
    for name in ("symmetric_closure", "remove_vertices", "graph_totals", "cc_violations", "interval_violations", "interval_agreement", "affinity_matrix", "favorite_label", "gumbel_label", "net_attraction", "neighbour_attraction", "vertex_edge_counts", "flagship_affinity_gain"):
        plan = registry.QUERIES[name](spark, d)._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan.split("FlatMapGroups")[0] and plan.count("FlatMapGroups") == 1, name


class _Reads:
    """Counts how often a table's rows are made."""

    def __init__(self, spark, edges):
        self.rows = spark.sparkContext.accumulator(0)
        rows = self.rows

        def count(batches):
            for batch in batches:
                rows.add(batch.num_rows)
                yield batch

        self.edges = edges.mapInArrow(count, edges.schema)


@pytest.mark.parametrize("run", [r.cut_vertices, r.chicken, lambda e: h.bulk_sweep(e, lb.overlap_matrix(lb.structure(e.sparkSession, lb.chain(3))), 3, epochs=4)[0]])
def test_edges_are_made_once(spark, run):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, -1.0), (3, 4, 1.0)], EDGES)
    reads = _Reads(spark, edges)
    got = rows_of(run(reads.edges))
    assert reads.rows.value == 4 and got == rows_of(run(edges))


def test_sweeps_end_where_no_vertex_gains(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, -1.0)], EDGES)
    matrix = lb.overlap_matrix(lb.structure(spark, lb.chain(3)))
    labels, trace = h.bulk_sweep(edges, matrix, 3, epochs=200, patience=100)
    assert len(trace) < 50 and h.sweep_round(edges, labels, matrix, 5, 0, gains=True).where("gain > 0").isEmpty()


def test_cut_certificate_keeps_what_every_vertex_cuts(spark, monkeypatch):
    """Components of the graph and of what is left without any vertex, against all edges; and two edges a vertex at most."""
    def parts(vs, edges):
        out = {v: v for v in vs}
        for _ in vs:
            for a, b in edges:
                if a in out and b in out:
                    out[a] = out[b] = min(out[a], out[b])
        return out

    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(2, 12)
        pairs = [(a, b) for a in range(n) for b in range(a)]
        edges = rng.sample(pairs, rng.randint(1, len(pairs)))
        cuts = [r._certificate(*np.array(x).T) for x in (edges[::2], edges[1::2]) if x]
        got = set(zip(*(x.tolist() for x in r._certificate(*(np.concatenate(x) for x in zip(*cuts))))))
        assert len(got) <= 2 * (n - 1) and all(e in edges or e[::-1] in edges for e in got)
        for x in [None, *range(n)]:
            assert parts(set(range(n)) - {x}, edges) == parts(set(range(n)) - {x}, got), (edges, x)
    monkeypatch.setattr(r, "CERTIFY", 600)
    whole = [(a + k * 50, b + k * 50, 1.0) for k in range(2) for a in range(40) for b in range(a)] + [(39, 50, -1.0)]
    edges = spark.createDataFrame(whole, EDGES).repartition(7)
    assert r.cut_certificate(edges).count() < 2 * 80 * 2 < len(whole)
    assert rows_of(r.cut_vertices(edges)) == [(39,), (50,)]


def test_packed_kernels_by_row(monkeypatch):
    """Neighbours of every vertex, packed in parts and blocks, and the deletions of a graph of several blocks."""
    monkeypatch.setattr(r, "PACKED", 500)
    monkeypatch.setattr(r, "ROW_BITS", 4)
    rng, n = random.Random(9), 300
    edges = {(a, b): rng.random() < 0.6 for b in range(n) for a in range(b) if rng.random() < 0.1}
    columns = {"comp": [7] * len(edges), "i": [a for a, _ in edges], "j": [b for _, b in edges], "plus": list(edges.values())}
    blocks = {}
    for batch in r._pack_edges(iter(pa.table(columns).to_batches(max_chunksize=200))):
        for k in range(batch.num_rows):
            blocks.setdefault(batch.column("block")[k].as_py(), []).append(batch.slice(k, 1))
    packed = r._Packed(x for k in blocks for x in r._pack_rows(iter(blocks[k])))
    near = {v: {b if a == v else a: p for (a, b), p in edges.items() if v in (a, b)} for v in range(n)}
    for v in range(n):
        assert [packed.row(s, v).tolist() for s in (0, 1)] == [sorted(u for u, p in near[v].items() if p == (s == 0)) for s in (0, 1)]
    want, left = 0, {v: dict(near[v]) for v in near}
    while any(not p for x in left.values() for p in x.values()):
        plus = {v: sum(x.values()) for v, x in left.items() if x}
        v = min(plus, key=lambda v: (-max(plus[v], len(left[v]) - plus[v]) / len(left[v]), v))
        want += min(plus[v], len(left[v]) - plus[v])
        for u in left.pop(v):
            del left[u][v]
    assert r._peck(packed) == want
