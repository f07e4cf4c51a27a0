"""Token counts through a digest cache: only texts not counted before are encoded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obol.llm.common import shared_path, ship, staged
from obol.llm.textbytes import slices
from obol.llm.tokens import encoder

LIMIT = 2048
CACHE_SCHEMA = "tokenizer_digest string, content_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the vocabulary file and the library's version."""
    import hashlib
    import tokenizers
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def normalised(text):
    """Content that decides the count: runs of ASCII white space are one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Tokens of every whole text, from the cache table at ``cache_path`` or encoded once and appended.

    The cache holds (tokenizer digest, digest of the normalised content, count);
    a new tokenizer file or library version misses every entry.  Without a path
    the cache lives in a new shared folder.  Null text counts as empty; repeated
    rows and ids each get their row; an empty table gives none; other columns
    are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    version = tokenizer_digest(tokenizer)
    path = cache_path or shared_path(spark, "token-cache")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                        normalised(text).alias("content")) \
        .withColumn("content_digest", F.sha2("content", 256))
    refs = staged(keyed.drop("content"), "digests")
    try:
        known = spark.read.schema(CACHE_SCHEMA).parquet(path)
        known = known.where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens").distinct()
    except Exception as e:  # noqa: BLE001  a cache that does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    wanted = keyed.select("content_digest", "content")
    if known is not None:
        wanted = wanted.join(known, "content_digest", "left_anti")
    misses = wanted.groupBy("content_digest").agg(F.first("content").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part, texts in slices(batches, keep=True):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(c) // 4 for c in enc.encode(texts)], pa.int64())],
                names=["content_digest", "n_tokens"])

    counted = misses.mapInArrow(encode, "content_digest string, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer_digest"), "content_digest", "n_tokens").write.mode("append").parquet(path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer_digest") == version) \
        .groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    return refs.join(counts, "content_digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
