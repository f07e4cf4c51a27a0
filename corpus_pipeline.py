"""Corpus pipeline over ``documents``: quality, near duplicates, PII, mixing, packing.

Each stage takes all rows the one before kept; ``run`` writes every stage as
Parquet in the shared folder and gives the reread rows to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obol.llm.common import documents, staged
from obol.llm.near_dedup import near_duplicates
from obol.llm.packing import pack
from obol.llm.pii import pseudonymise
from obol.llm.queries import pii_key, tokenizer_path
from obol.llm.quality import measure
from obol.llm.source_mixing import mix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return measure(docs.select(*COLUMNS), labels).where("kept").select(*COLUMNS)


def row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a digest of id and text that stands for the row: never null, equal for copies of a row only."""
    number = F.col("doc_id").cast("long")
    # the flags tell a null from what hashes like one
    return docs.withColumn("_row", F.xxhash64(number.isNull(), number, F.col("text").isNull(), "text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the smallest id, null last.

    Rows are told apart by ``row_key``: rows without an id are documents like
    others, and texts that share an id are linked only if they are alike.
    Rows equal in id and text are one document.
    """
    keyed = row_key(docs.select(*COLUMNS))
    parts = near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("_row")).agg(F.min("component_id").alias("part"))
    ids = keyed.groupBy("_row").agg(F.min("doc_id").alias("doc_id"))
    kept = parts.join(ids, "_row").groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")).select("first._row")
    return keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers, dates and addresses replaced by pseudonyms; n_chars follows the new text."""
    return pseudonymise(docs.select(*COLUMNS), pii_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows equal in id, text and source are all taken as often."""
    keyed = row_key(docs.select(*COLUMNS)).withColumn("_row", F.xxhash64("_row", F.col("source").isNull(), "source"))
    # one row a key: equal rows share a draw
    copies = mix(keyed.select(F.col("_row").alias("doc_id"), "text", "source")).groupBy(F.col("doc_id").alias("_row")).agg(F.max("copies").alias("copies"))
    return keyed.join(copies.where("copies > 0"), "_row") \
        .select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("pii", pii), ("mix_sources", mix_sources), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
