"""Command line: runs of the heuristics, vote graphs, kernels and planted graphs.

    python -m signalloom gaic GRAPH.json STRUCT.json CONFIG.json OUT [--seed 5]
    python -m signalloom graph-from-votes VOTES.csv OUT [--periods 17 18] [--threshold 0.75]
    python -m signalloom kernelize EDGES.txt OUT [--unsafe]
    python -m signalloom synthetic STRUCT.json OUT [--seed 5] [--n-per-interval 100]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, heuristics, reduce
from .sources import io


def intervals_of(structure: DataFrame) -> list[tuple[float, float]]:
    """Intervals of a structure (at most a few hundred) in label order."""
    return [(r["start"], r["end"]) for r in structure.orderBy("label").collect()]


def gaic(spark: SparkSession, args: argparse.Namespace) -> None:
    config = io.read_config_json(spark, args.config)
    run = config | {"run_id": f"seed{args.seed}", "seed": args.seed, "intervals": intervals_of(io.read_structure_json(spark, args.struct))}
    trace = graph.checkpoint(heuristics.gaic_grid(io.read_graph_json(spark, args.graph), [run]))
    io.write_csv(trace, f"{args.out}/trace")
    io.write_csv(io.run_summary(trace), f"{args.out}/summary")


def graph_from_votes(spark: SparkSession, args: argparse.Namespace) -> None:
    votes, edges = graph.votes_to_graph(io.read_votes_csv(spark, args.votes), args.periods, args.threshold)
    io.write_csv(votes, f"{args.out}/votes")
    io.write_tsv(edges, f"{args.out}/edges")


def kernelize(spark: SparkSession, args: argparse.Namespace) -> None:
    io.write_csv(reduce.kernelize(io.read_signed_edge_list(spark, args.edges), unsafe=args.unsafe), args.out)


def synthetic(spark: SparkSession, args: argparse.Namespace) -> None:
    intervals = intervals_of(io.read_structure_json(spark, args.struct))
    io.write_synthetic(heuristics.synthetic_sweep(spark, intervals, args.n_per_interval, args.seed), f"{args.out}/graphs")
    n = len(intervals) * args.n_per_interval
    labels = spark.range(n).select(F.col("id").alias("v"), F.floor(F.col("id") / args.n_per_interval).cast("int").alias("label"))
    io.write_json(io.solution_json(labels), f"{args.out}/labelling")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="signalloom")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *positional: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name)
        for p in positional:
            own.add_argument(p)
        own.set_defaults(run=run)
        return own

    command("gaic", gaic, "graph", "struct", "config", "out").add_argument("--seed", type=int, default=5)
    votes = command("graph-from-votes", graph_from_votes, "votes", "out")
    votes.add_argument("--periods", type=int, nargs="*", default=[17, 18, 19, 20])
    votes.add_argument("--threshold", type=float, default=0.75)
    command("kernelize", kernelize, "edges", "out").add_argument("--unsafe", action="store_true")
    planted = command("synthetic", synthetic, "struct", "out")
    planted.add_argument("--seed", type=int, default=5)
    planted.add_argument("--n-per-interval", type=int, default=heuristics.SWEEP_N)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName("signalloom").getOrCreate(), args)


if __name__ == "__main__":
    main()
