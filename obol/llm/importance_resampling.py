"""Target-distribution importance resampling: hashed n-gram counts over distinct lines, Gumbel top-k draw.

Texts are cut into lines at the separator newline.  A line that many documents
share is one row with its number of occurrences: its words are cut and hashed
once, its bucket counts are multiplied by the occurrences, and its weight is
joined back to the documents that hold it.  N-grams that cross a line end
depend on the document and are added separately, from the few words next to
each line end.  SQL functions only, no Python workers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obol.llm.common import staged
from obol.operators.running import running

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Lines with at least 1 / HOT_LINES of all line occurrences are sent to every executor: at most HOT_LINES rows.
HOT_LINES = 1 << 14
#: Most rows that one task orders by score.
RANK_ROWS = 1 << 16


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def grams(tokens: Column, n: int) -> Column:
    """All runs of 1 to ``n`` neighbouring tokens, joined by one space."""
    out = tokens
    for k in range(2, n + 1):
        out = F.concat(out, F.transform(windows(tokens, k), lambda run: F.array_join(run, " ")))
    return out


def windows(items: Column, k: int) -> Column:
    """All runs of ``k`` neighbouring items."""
    starts = F.when(F.size(items) >= k, F.sequence(F.lit(1), F.size(items) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, F.lit(k)))


def bucket_of(features: Column, buckets: int) -> Column:
    return F.transform(features, lambda g: (F.crc32(g.cast("binary")) % buckets).cast("int"))


def crossing_grams(lines: Column, n: int) -> Column:
    """Runs of 2 to ``n`` words that cross at least one line end.

    Only the first and last n - 1 words of a line can take part; a longer line
    leaves a gap (a null word) between them that no run may include.
    """
    edge = n - 1

    def ends(line: Column, i: Column) -> Column:
        w = words(line)
        head, tail = F.slice(w, 1, edge), F.slice(w, -edge, edge)
        near = F.when(F.size(w) <= 2 * edge, w).otherwise(F.concat(head, F.array(F.lit(None).cast("string")), tail))
        return F.transform(near, lambda x: F.struct(x.alias("w"), i.alias("line")))

    near = F.flatten(F.transform(lines, ends))

    def runs(tokens: Column) -> Column:
        parts = []
        for k in range(2, n + 1):
            own = F.filter(windows(tokens, k), lambda s: (F.element_at(s, 1)["line"] < F.element_at(s, -1)["line"]) & ~F.exists(s, lambda t: t["w"].isNull()))
            parts.append(F.transform(own, lambda s: F.array_join(F.transform(s, lambda t: t["w"]), " ")))
        return F.concat(*parts)

    # bind the array once: an expression used twice in a lambda is evaluated twice
    return F.flatten(F.transform(F.array(near), runs))


def segment(texts: DataFrame, max_n: int, buckets: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Staged rows with their line digests, and the staged distinct lines with occurrences and feature buckets.

    ``texts`` has ``text`` and columns to carry.  Rows: ``_row``, those
    columns, ``lines`` (128-bit digests in order) and ``cross`` (buckets of
    n-grams over line ends).  Lines: digest, ``n``, ``n_words``, ``buckets``.
    """
    low = texts.withColumn("text", F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER))
    cut = F.filter(F.split(F.col("text"), "\n"), lambda x: x != "")
    digest = lambda x: (F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))
    cross = bucket_of(crossing_grams(F.col("_cut"), max_n), buckets) if max_n > 1 else F.array().cast("array<int>")
    rows = low.withColumn("_cut", cut).select(
        F.monotonically_increasing_id().alias("_row"), *[c for c in texts.columns if c != "text"],
        F.transform("_cut", lambda x: F.struct(*digest(x))).alias("lines"), cross.alias("cross"))
    lines = low.select(F.explode(cut).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n")) \
        .select(*digest(F.col("line")), "n", words(F.col("line")).alias("w")) \
        .select("a", "b", "n", F.size("w").alias("n_words"), bucket_of(grams(F.col("w"), max_n), buckets).alias("buckets"))
    return staged(rows, f"{name}-rows"), staged(lines, f"{name}-lines")


def bucket_counts(rows: DataFrame, lines: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket: those of a line times its occurrences, and those over line ends."""
    counts = lines.select(F.explode("buckets").alias("bucket"), "n") \
        .unionByName(rows.select(F.explode("cross").alias("bucket"), F.lit(1).cast("long").alias("n"))) \
        .groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in counts.collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln) of the smoothed target share over the smoothed raw share, per bucket."""
    b = len(raw)
    s, t = float(sum(raw) + b), float(sum(target) + b)
    return [math.floor(1000 * math.log((target[i] + 1.0) * s / ((raw[i] + 1.0) * t))) for i in range(b)]


def weights(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS, hot_lines: int = HOT_LINES) -> DataFrame:
    """``_row``, ``doc_id``, ``n_words``, ``n_features`` and ``weight`` (sum of bucket gains) of every row of ``docs``.

    ``docs`` has doc_id and text, ``target`` has text.
    """
    rows, lines = segment(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), max_n, buckets, "dsir")
    gain = gains(bucket_counts(rows, lines, buckets), bucket_counts(*segment(target.select("text"), max_n, buckets, "dsir-target"), buckets))
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")
    total = lambda bucket: F.aggregate(bucket, F.lit(0).cast("long"), lambda acc, i: acc + F.get(table, i))
    lines = lines.select("a", "b", "n", F.col("n_words").cast("long").alias("n_words"), F.size("buckets").cast("long").alias("n_features"),
                         total(F.col("buckets")).alias("weight"))
    n_lines = lines.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * hot_lines >= n_lines  # holds for at most ``hot_lines`` lines
    held = rows.select("_row", "doc_id", F.explode_outer("lines").alias("line")).select("_row", "doc_id", "line.a", "line.b")
    measures = ["n_words", "n_features", "weight"]
    first = held.join(F.broadcast(lines.where(hot).drop("n")), ["a", "b"], "left")
    # a common line meets its row in the task that holds the document; the others have few occurrences each
    done = first.where(F.col("weight").isNotNull() | F.col("a").isNull()).select("_row", "doc_id", *measures)
    rest = first.where(F.col("weight").isNull() & F.col("a").isNotNull()).select("_row", "doc_id", "a", "b") \
        .join(lines.where(~hot).drop("n"), ["a", "b"]).select("_row", "doc_id", *measures)
    parts = done.unionByName(rest)
    if max_n > 1:
        parts = parts.unionByName(rows.select("_row", "doc_id", F.lit(0).cast("long").alias("n_words"), F.size("cross").cast("long").alias("n_features"),
                                              total(F.col("cross")).alias("weight")))
    return parts.groupBy("_row", "doc_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in measures])


def resample(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS,
             percent: int = PERCENT, hot_lines: int = HOT_LINES, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Weight, Gumbel-perturbed score and draw rank of every document.

    Returns doc_id, n_features, weight, score, rank (1, 2, 3, ... of the drawn
    documents by falling score, ties to the smaller doc_id; null if not drawn)
    and n_words.  Of the N documents with at least ``min_words`` words the
    floor(percent * N / 100) highest scores are drawn: sampling without
    replacement in proportion to exp(weight / 1000).

    Null or wordless text: no features, weight 0.  A null doc_id is hashed as
    the empty string and comes last among equal scores.  Repeated rows are
    documents of their own (equal scores; the order between rows equal in id is
    any).  An empty table gives no rows; an empty target leaves t = 0 in every
    bucket.  Other columns are not read.
    """
    w = weights(docs, target, max_n, buckets, hot_lines)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = staged(w.withColumn("score", F.col("weight") + noise), "dsir-scores")
    able = scored.where(F.col("n_words") >= min_words).select("_row", (-F.col("score")).alias("_down"), F.col("doc_id").isNull().alias("_no_id"), "doc_id")
    drawn = able.count() * percent // 100
    ranks = running(able, [], ["_down", "_no_id", "doc_id", "_row"], max_group_rows=rank_rows) \
        .where(F.col("_rn") <= drawn).select("_row", F.col("_rn").cast("long").alias("rank"))
    return scored.join(ranks, "_row", "left").select("doc_id", "n_features", "weight", "score", "rank", "n_words")
