"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, fingerprints, langid, licenses, mixing, neardup, packing, sharding, store, token_counts

#: Weights of domains, languages and sources in the mixing query and the pipeline.
MIX_WEIGHTS = [{"web": 0.5, "news": 0.3, "reference": 0.2}, {"en": 0.4, "*": 0.2}, {"*": 1.0}]


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies; it is never copied."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def source_domain(source: Column) -> Column:
    """Domain of a source by its number: three in four web, the rest news and reference."""
    n = F.pmod(F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("int"), F.lit(0)), F.lit(4))
    return F.when(n == 1, "news").when(n == 2, "reference").otherwise("web")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), token_counts.unigram_vocabulary(tokenizer("piece_bpe_32k.model")))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_fingerprints(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, source_domain(F.col("source")), MIX_WEIGHTS, max_epochs=2)
    return mixed.select("doc_id", F.col("_domain").alias("domain"), "lang", "source", F.col("_epoch").cast("int").alias("epoch"), F.col("_tokens").alias("tokens"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.round_trip(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(_table(spark, sf_dir, "documents")).drop("text")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_counts, op2_nearest_neighbours, op3_fingerprints, op4_language_id, op5_near_duplicates, op6_license_scan, op7_mixing, op8_token_store, op9_sharding, op10_packing]
    return {f.__name__: f for f in own}


#: Every pair that shares a shingle, its exact similarity, and what the links reach.
NEAR_DUPLICATES_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    u AS (SELECT doc_id, len(ws) AS words, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w),
    g AS (SELECT doc_id, words, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    s AS (SELECT DISTINCT doc_id, shingle FROM g WHERE i <= greatest(words - 4, 1)), n AS (SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY 1),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
    e AS (SELECT x AS v, y AS u FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT e.u, r.c FROM r JOIN e ON e.v = r.v)
    SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept FROM n JOIN r ON r.v = n.doc_id GROUP BY n.doc_id, n.n"""


def oracle_sql() -> dict[str, str]:
    """The other nine are not expressible in SQL as the methods named (tokenizers, sketches, seeded
    draws, retrieval, kernels, alignments); tests compare them with brute force."""
    return {"op5_near_duplicates": NEAR_DUPLICATES_SQL}
