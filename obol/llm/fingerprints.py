"""Document fingerprints: one-permutation MinHash with optimal densification, in SQL functions only.

Every 5-word shingle is hashed once; its top bits choose one of ``BINS`` bins,
each keeping its smallest hash.  An empty bin probes other bins in the order of
its own pseudo-random sequence and copies the first that was filled by a
shingle (optimal densification).  Eight low-order bits of each bin are packed
as hex; the likeness of two fingerprints is the share of equal bins, corrected
for the 2**-8 chance agreement.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obol.llm.common import staged

BINS_LOG2 = 7
BINS = 1 << BINS_LOG2
BITS = 8
SHINGLE = 5
#: Documents of one window task when the next text is looked up; no more ranges than this, so their bounds stay small.
BUCKET_DOCS = 4096
MOST_RANGES = 1 << 14


def _probes() -> list[list[int]]:
    """For each bin all bins, ordered by a hash of the pair."""
    return [sorted(range(BINS), key=lambda j: hashlib.sha256(b"%d,%d" % (i, j)).digest()) for i in range(BINS)]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often the lambda names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column) -> Column:
    """Hashes of the 5-word windows of a text, A-Z lower-cased; fewer words give one of them all."""
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice(h, 1, F.greatest(F.size(h) - SHINGLE + 1, F.lit(1))),
                    lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, SHINGLE))))))


def fingerprint(hashes: Column) -> Column:
    """Packed bins as hex; a text without words gives the empty string."""
    shift = 64 - BINS_LOG2
    first = _let(F.sort_array(hashes), lambda low: F.filter(low, lambda x, i: (i == 0) | (
        F.shiftright(x, shift) != F.shiftright(F.get(low, F.greatest(i - 1, F.lit(0))), shift))))
    return _let(first, lambda one: F.when(F.size(one) == 0, F.lit("")).otherwise(_let(
        F.transform(one, lambda x: (F.shiftright(x, shift) + BINS // 2).cast("int")), lambda bins: _packed(one, bins))))


def _packed(one: Column, bins: Column) -> Column:
    """Low bits of bin 0, 1, ...: ``one`` holds the smallest hashes of the filled ``bins``."""
    probes = F.from_json(F.lit(json.dumps(_probes())), "array<array<int>>")
    at = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.array_position(bins, i))
    return _let(at, lambda places: F.array_join(F.transform(places, lambda p, i: F.lpad(F.lower(F.hex(F.get(one, (
        F.when(p > 0, p).otherwise(F.element_at(F.filter(F.transform(F.element_at(probes, i + 1), lambda j: F.get(places, j)),
                                                         lambda q: q > 0), 1)) - 1).cast("int"))
        .bitwiseAND(F.lit((1 << BITS) - 1)))), BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1; two empty ones are alike, an empty one and another are not."""
    step = BITS // 4
    at = F.sequence(F.lit(1), F.lit(BINS * step), F.lit(step))
    chance = 2.0 ** -BITS
    equal = F.size(F.filter(at, lambda p: a.substr(p, F.lit(step)) == b.substr(p, F.lit(step)))) / F.lit(float(BINS))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(
        F.greatest(F.lit(0.0), (equal - chance) / (1 - chance)))


def with_next(docs: DataFrame, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """doc_id, text, k (range), ghost and next_text: the text of the next row by ascending doc_id (after the last: the first).

    Rows are dealt into ranges of ids and linked by a window inside each; the
    first row of a range is also sent to the range before it, as its ghost.  Ties (repeated
    ids) follow the text; null ids come first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    n = ids.count()
    parts = min(MOST_RANGES, max(1, -(-n // bucket_docs)))
    cuts = ids.where("doc_id is not null").repartitionByRange(parts, "doc_id") \
        .groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("low"))
    lows = staged(cuts.select("low").distinct(), "cuts")
    # range number of an id: cuts at or below it, by one sorted array (one long a range of bucket_docs rows)
    bounds = lows.agg(F.sort_array(F.collect_list("low")).alias("lows"))
    low_list = [r for r in (bounds.first().lows or [])]
    if not low_list:
        low_list = [0]
    array = F.broadcast(rows.sparkSession.createDataFrame([(low_list,)], "lows array<bigint>"))
    last = len(low_list) - 1
    tagged = rows.crossJoin(array).withColumn("k", _position(F.col("lows"), F.col("doc_id"), len(low_list)))
    first = F.col("doc_id").isNull() | (F.col("doc_id") == F.element_at("lows", F.col("k") + 1))
    sent = tagged.withColumn("first", first).select(
        "doc_id", "text",
        F.explode(F.when(F.col("first"), F.array(
            F.struct(F.col("k").alias("k"), F.lit(False).alias("ghost")),
            F.struct(F.when(F.col("k") == 0, F.lit(last)).otherwise(F.col("k") - 1).alias("k"), F.lit(True).alias("ghost"))))
            .otherwise(F.array(F.struct(F.col("k").alias("k"), F.lit(False).alias("ghost"))))).alias("s")) \
        .select("doc_id", "text", "s.k", "s.ghost")
    order = _order()
    return sent.withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))


def _order():
    return Window.partitionBy("k").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")


def _position(lows: Column, value: Column, n: int) -> Column:
    """Index of the last entry of the sorted array at or below ``value`` (0 if none): a coarse step, then a fine one."""
    stride = max(1, int(n ** 0.5))
    coarse = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // stride)), lambda i: F.element_at(lows, i * stride + 1))
    at = F.greatest(F.size(F.filter(coarse, lambda x: x <= value)) - 1, F.lit(0)) * stride
    fine = F.size(F.filter(F.slice(lows, at + 1, F.lit(stride)), lambda x: x <= value)) - 1
    return at + F.greatest(fine, F.lit(0))


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points (rounded down) replaced by as many first ones of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Null text is empty; an empty text has an empty fingerprint; equal texts
    have equal fingerprints; one row alone is its own next; an empty table
    gives none; other columns are not read.
    """
    pairs = with_next(docs).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    printed = pairs.select(
        "k", "ghost", "doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"),
        F.transform(F.array("text", "edit"), lambda t: fingerprint(shingle_hashes(t))).alias("f"))
    linked = printed.withColumn("g", F.lead("f").over(_order())).where("not ghost")
    prints = F.struct(F.col("f")[0].alias("a"), F.col("f")[1].alias("b"), F.coalesce(F.col("g")[0], F.col("f")[0]).alias("c"))
    return linked.select(
        "doc_id", "n_chars", "edited_sha256", F.col("f")[0].alias("fingerprint"), F.col("f")[1].alias("edited_fingerprint"),
        _let(prints, lambda p: likeness(p["a"], p["b"])).alias("near_edited"), _let(prints, lambda p: likeness(p["a"], p["c"])).alias("near_next"))
