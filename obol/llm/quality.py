"""Quality rules: hashed n-gram log-likelihood ratio of trusted target and raw corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obol.llm.common import ship, sized, staged
from obol.llm.textbytes import SHINGLE, Words, mix64, slices

BUCKETS = 1 << 16
#: A document passes when its ratio is no more than this many trusted standard deviations below the trusted mean.
DEVIATIONS = 5.0
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def ngram_buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word and every pair of neighbouring words of a row."""
    row = np.repeat(np.arange(words.n_rows), words.counts())
    h = words.hashes
    pair = row[1:] == row[:-1]
    two = mix64(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0x9E3779B97F4A7C15))[pair]
    return (np.concatenate([h, two]) >> np.uint64(48)).astype(np.int64), np.concatenate([row, row[:-1][pair]])


def base_measures(texts: list[bytes], words: Words) -> dict[str, np.ndarray]:
    """The base columns of each text."""
    n = words.n_rows
    data = np.frombuffer(words.buf, np.uint8)
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    count = words.counts()

    def per_row(flags: np.ndarray) -> np.ndarray:
        acc = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return acc[bounds[1:]] - acc[bounds[:-1]]

    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    in_words = np.concatenate([[0], np.cumsum(chars[words.ends] - chars[words.starts])])
    dup_lines, repeats = np.zeros(n, np.int64), np.zeros(n, np.int64)
    shingle, row = words.shingles()
    first = np.searchsorted(row, np.arange(n + 1))
    for i, text in enumerate(texts):
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x.strip()]
            dup_lines[i] = len(lines) - len(set(lines))
        if count[i] > SHINGLE:
            own = shingle[first[i]:first[i + 1]]
            order = np.argsort(own, kind="stable")
            same = own[order][1:] == own[order][:-1]
            if same.any():
                hit = np.zeros(len(own), bool)
                hit[order[1:][same]] = True
                hit[order[:-1][same]] = True
                cover = np.zeros(count[i] + 1, np.int64)
                at = np.flatnonzero(hit)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + SHINGLE, -1)
                repeats[i] = int((np.cumsum(cover)[:-1] > 0).sum())
    return {"n_words": count, "word_chars": in_words[words.first[1:]] - in_words[words.first[:-1]],
            "n_symbols": per_row(_SYMBOL[data]), "n_dup_lines": dup_lines, "n_repeat_words": repeats,
            "base_failed": (count < 10) | (100 * repeats > 20 * count)}


def gram_counts(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of every n-gram bucket: row 0 in documents labelled of quality 1, row 1 in all documents.

    Each task adds its documents up into one fixed-size array, so the driver
    receives ``2 * buckets`` numbers whatever the corpus.
    """
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("_label_id")).distinct()
    trusted = sized(trusted)
    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .join(trusted.withColumn("trusted", F.lit(True)), F.col("doc_id") == F.col("_label_id"), "left") \
        .select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for part, texts in slices(batches):
            words = Words(texts, lower=False)
            bucket, row = ngram_buckets(words)
            total[1] += np.bincount(bucket, minlength=buckets)
            good = np.asarray(part.column(1).to_pylist(), bool)
            total[0] += np.bincount(bucket[good[row]], minlength=buckets)
        used = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[0][used]), pa.array(total[1][used])],
                                         names=["bucket", "target", "raw"])

    rows = flagged.mapInArrow(count, "bucket int, target long, raw long").groupBy("bucket") \
        .agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    out = np.zeros((2, buckets), np.int64)
    at = rows["bucket"].to_numpy()
    out[0, at], out[1, at] = rows["target"].to_numpy(), rows["raw"].to_numpy()
    return out


def measure(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of ``docs`` and the base columns, ``llr`` (mean log ratio of a document's n-grams) and ``kept``.

    ``kept`` is false for documents that fail the base rules; of the others
    those whose ratio lies ``DEVIATIONS`` trusted standard deviations or more
    below the trusted mean.  Both come from all trusted documents that pass
    the base rules, so the verdict is the same on every run.  Without trusted
    documents the ratio decides nothing.  Null text has no words and fails the
    base rules; null ids are never trusted; repeated rows get equal verdicts.
    Columns of ``docs`` named like the new ones are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    counts = gram_counts(docs, labels) + 1
    ratio = spark.sparkContext.broadcast(
        (np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())))
    names = [c.split()[0] for c in BASE.split(", ")] + ["llr"]
    keep = [c for c in docs.columns if c not in [*names, "kept"]]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for part, texts in slices(batches, "_text"):
            words = Words(texts, lower=False)
            bucket, row = ngram_buckets(words)
            n = np.bincount(row, minlength=len(texts))
            llr = np.bincount(row, weights=table[bucket], minlength=len(texts)) / np.maximum(n, 1)
            out = base_measures(texts, words) | {"llr": llr}
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(out[k]) for k in names)],
                                             names=[*part.schema.names[:-1], *names])

    fields = docs.select(*keep).schema
    from pyspark.sql.types import StructType
    schema = StructType(fields.fields + StructType.fromDDL(f"{BASE}, llr double").fields)
    scored = staged(docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(score, schema), "quality")
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("_label_id")).distinct()
    stats = scored.select(F.col("doc_id").cast("long").alias("_id"), "llr", "base_failed").where("not base_failed") \
        .join(trusted, F.col("_id") == F.col("_label_id"), "left_semi") \
        .agg(F.avg("llr").alias("m"), F.stddev_pop("llr").alias("s")).first()
    least = float("-inf") if stats.m is None else stats.m - DEVIATIONS * stats.s
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(least)))
