"""Readers and writers of the graph, structure, config, labelling and edge-list formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import anonymise, canonical, negative_wins  # noqa: F401

GRAPH = "edges array<struct<source:bigint,target:bigint,weight:double>>"
STRUCTURE = "intervals array<struct<start:float,end:float>>"
CONFIG = "num_epochs bigint, timeout_s bigint, early_stopping_epochs bigint, num_reassignment_chunks bigint, initial_temperature double, temperature_decay_factor double, temperature_decay_epochs bigint"


def _complete(df: DataFrame) -> DataFrame:
    """Fail on a missing field, which Spark's JSON reader would turn into null."""
    whole = None
    for c in df.columns:
        whole = F.col(c).isNotNull() if whole is None else whole & F.col(c).isNotNull()
    return df.where(F.assert_true(whole, F.lit("a field is missing")).isNull())


def read_graph_json(spark: SparkSession, path: str) -> DataFrame:
    return _complete(spark.read.schema(GRAPH).option("multiLine", True).json(path).selectExpr("inline(edges)"))


def read_structure_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(STRUCTURE).option("multiLine", True).json(path).select(F.posexplode("intervals").alias("label", "i"))
    return _complete(rows.select("label", "i.start", "i.end"))


def read_config_json(spark: SparkSession, path: str) -> dict:
    return _complete(spark.read.schema(CONFIG).option("multiLine", True).json(path)).first().asDict()


def read_labelling_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("v", "label"))
    return rows.select(F.col("v").cast("long").alias("v"), "label")


def parse_edge_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(source, target, weight) of text lines: comment and MULTICUT lines and lines of fewer than
    three fields are skipped, further fields ignored, self loops dropped.  White space around a line
    does not count; a line whose first three fields are not numbers is skipped."""
    line = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    parts = F.split(line, "[,#;\\t ]+")
    good = lines.where(~line.rlike("^[#%]") & ~line.startswith("MULTICUT")).select(parts.alias("p")).where(F.size("p") >= 3)
    field = lambda i, kind: F.get("p", F.lit(i)).try_cast(kind)
    rows = good.select(field(0, "long").alias("source"), field(1, "long").alias("target"), field(2, "double").alias("weight"))
    return rows.where("source <> target and weight is not null")


def signed_edges(lines: DataFrame, column: str = "value") -> DataFrame:
    return negative_wins(parse_edge_lines(lines, column))


def weighted_edges(lines: DataFrame, column: str = "value") -> DataFrame:
    """Duplicate pairs summed; a pair that sums to zero stays (the writer drops it)."""
    rows = parse_edge_lines(lines, column)
    return rows.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.sum("weight").alias("weight"))


def read_signed_edge_list(spark: SparkSession, path: str) -> DataFrame:
    return signed_edges(spark.read.text(path))


def read_weighted_edge_list(spark: SparkSession, path: str) -> DataFrame:
    return weighted_edges(spark.read.text(path))


def read_votes_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "filename string, Name string, Vorname string, `Fraktion/Gruppe` string, `ja/nein` string, Wahlperiode int, janein string, Bezeichnung string"
    return spark.read.schema(schema).csv(path, header=True)


def read_run_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Run summaries or traces of one or many files, with the file's name."""
    return spark.read.schema(schema).csv(path, header=True, ignoreLeadingWhiteSpace=True).withColumn("filename", F.col("_metadata.file_name"))


def read_workbook_votes(spark: SparkSession, path: str) -> DataFrame:
    """Vote workbooks of a glob.  Needs a library that pandas can read them with."""
    import pandas as pd

    def run(batches):
        import io

        for batch in batches:
            for name, body in zip(batch["path"], batch["content"]):
                sheet = pd.read_excel(io.BytesIO(body))
                sheet = sheet[(sheet["ja"] == 1) | (sheet["nein"] == 1)]
                yield pd.DataFrame({
                    "filename": name.rsplit("/", 1)[-1], "name": sheet["Name"], "vorname": sheet["Vorname"], "party": sheet["Fraktion/Gruppe"],
                    "period": sheet["Wahlperiode"].astype("int32"), "vote": ["ja" if x == 1 else "nein" for x in sheet["ja"]],
                })

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "filename string, name string, vorname string, party string, period int, vote string")


def extract_links(pages: DataFrame, pattern: str = 'href="([^"]+)"', column: str = "html") -> DataFrame:
    return pages.select("page_id", F.explode(F.regexp_extract_all(column, F.lit(pattern), 1)).alias("link"))


def solution_json(labels: DataFrame) -> DataFrame:
    """One row, ``json``: labels by vertex id as string, keys in string order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("v").cast("string").alias("k"), "label")))
    return labels.agg(F.to_json(F.map_from_entries(pairs), {"pretty": "true"}).alias("json"))


def graph_json(edges: DataFrame) -> DataFrame:
    """One row, ``json``: positive edges first, endpoints ordered, zero weights dropped."""
    rows = canonical(edges).select((F.col("weight") < 0).alias("n"), "source", "target", "weight")
    inner = F.transform(F.array_sort(F.collect_list(F.struct("n", "source", "target", "weight"))), lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"), e["weight"].alias("weight")))
    return rows.agg(F.to_json(F.struct(inner.alias("edges"))).alias("json"))


def write_json(row: DataFrame, path: str) -> None:
    row.select("json").coalesce(1).write.text(path)


def _write_lines(edges: DataFrame, path: str, head: str, separator: str) -> None:
    """A first line, then source, target and sign of each edge, positive edges first."""
    top = edges.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit(False).alias("n"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(head).alias("value"))
    body = edges.select(F.lit(1).alias("o"), (F.col("weight") < 0).alias("n"), F.col("source").alias("a"), F.col("target").alias("b"), F.concat_ws(separator, "source", "target", F.signum("weight").cast("int")).alias("value"))
    top.union(body).coalesce(1).sortWithinPartitions("o", "n", "a", "b").select("value").write.text(path)


def write_multicut(edges: DataFrame, path: str) -> None:
    """Text edge list behind a MULTICUT line."""
    _write_lines(edges, path, "MULTICUT", " ")


def write_tsv(edges: DataFrame, path: str) -> None:
    """Tab-separated signs behind a commented header."""
    _write_lines(edges, path, "# FromNodeId\tToNodeId\tSign", "\t")


def read_id_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Names and ids of persons."""
    return spark.read.schema("Person string, ID int").csv(path, header=True)


def write_csv(rows: DataFrame, path: str) -> None:
    """Votes, traces or run summaries as CSV files with a header."""
    rows.write.option("header", True).csv(path)


def run_summary(trace: DataFrame) -> DataFrame:
    """The last row of each run's trace."""
    last = trace.groupBy("run_id").agg(F.max_by(F.struct("*"), "epoch").alias("r"))
    return last.select("r.*")


def run_statistics(edges: DataFrame, labels: DataFrame, intervals: DataFrame) -> DataFrame:
    """One row: edges, their weight, labels in use, and the labelling's violations of both kinds."""
    from ..operators import labels as lb

    one = lb.totals(edges).crossJoin(labels.agg(F.countDistinct("label").alias("n_labels"))).crossJoin(lb.cc_violations(edges, labels).withColumnRenamed("violations", "cc_violations"))
    return one.crossJoin(lb.agreement(edges, labels, lb.overlap_matrix(intervals)).select("agreement", "disagreement"))


def write_synthetic(graphs: DataFrame, path: str) -> None:
    """Planted graphs of a sweep, one folder for each of their parameters."""
    graphs.write.partitionBy("n_per_interval", "m_frac", "p").parquet(path)
