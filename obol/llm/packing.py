"""Packing: first-fit decreasing with a tournament tree, in random document groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obol.llm.common import ship, staged
from obol.llm.textbytes import slices
from obol.llm.tokens import encoder

SEQUENCE = 2048
END_ID = 1
GROUP_DOCS = 8192


class TournamentTree:
    """Bin capacities in a complete binary tree whose inner nodes hold the larger child."""

    def __init__(self, n_bins: int, capacity: int):
        self.size = 1 << max(0, (n_bins - 1).bit_length())
        self.best = [capacity] * (2 * self.size)

    def place(self, need: int) -> tuple[int, int]:
        """First bin with room for ``need``; returns it and its room before."""
        best, at = self.best, 1
        while at < self.size:
            at *= 2
            if best[at] < need:
                at += 1
        room = best[at]
        best[at] = room - need
        slot = at - self.size
        while at > 1:
            at //= 2
            left, right = best[2 * at], best[2 * at + 1]
            best[at] = left if left >= right else right
        return slot, room


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item (longest first, ties in given order); number of bins used."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = TournamentTree(max(1, len(lengths)), capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        slot, room = tree.place(int(lengths[i]))
        bins[i], offsets[i], used = slot, capacity - room, max(used, slot + 1)
    return bins, offsets, used


def document_pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, doc_tokens (ids with the end id), crcs (crc32 of each piece's ids, in order)."""
    ship(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, step = encoder(tokenizer), np.array([END_ID], "<u4").tobytes(), 4 * sequence
        for part, texts in slices(batches, keep=True):
            coded = [c + end for c in enc.encode(texts)]
            yield pa.RecordBatch.from_arrays([
                part.column(0).cast(pa.int64()),
                pa.array([len(c) // 4 for c in coded], pa.int64()),
                pa.array([[zlib.crc32(c[a:a + step]) for a in range(0, len(c), step)] for c in coded],
                         pa.list_(pa.int64())),
            ], names=["doc_id", "doc_tokens", "crcs"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(pieces, "doc_id long, doc_tokens long, crcs array<long>")


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pack every document (``doc_id``, ``text``) into sequences of ``sequence`` tokens.

    A document is cut into full pieces, each a sequence of its own, and one
    remainder; remainders are dealt into random groups of about ``group_docs``
    documents and each group is packed by first-fit decreasing.  A group also
    numbers its documents' full pieces, so a sequence id is ``group * 2**40 + k``.

    Null text is an empty document (its end id only); null ids and repeated rows
    are documents of their own; an empty table gives no piece; other columns are
    not read.
    """
    tokens = staged(document_pieces(docs, tokenizer, sequence), "pieces")
    n_docs = tokens.count()
    groups = max(1, -(-n_docs // group_docs))
    spread = F.xxhash64(F.col("doc_id"), F.col("doc_tokens"), F.element_at("crcs", 1), F.lit(20))

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "doc_tokens", "first_crc"], kind="stable", na_position="last")
        total = group["doc_tokens"].to_numpy()
        rest, full = total % sequence, total // sequence
        some = rest > 0
        base = int(group["grp"].iloc[0]) << 40
        slot, offset, used = first_fit_decreasing(rest[some], sequence)
        rest_seq, rest_off = np.full(len(group), -1, np.int64), np.zeros(len(group), np.int64)
        rest_seq[some], rest_off[some] = base + slot, offset
        return pd.DataFrame({"doc_id": group["doc_id"], "doc_tokens": total, "crcs": group["crcs"],
                             "rest_seq": rest_seq, "rest_off": rest_off,
                             "full_seq": base + used + np.cumsum(full) - full})

    dealt = (
        tokens.withColumn("first_crc", F.element_at("crcs", 1))
        .withColumn("grp", F.pmod(spread, F.lit(groups)))
        .groupBy("grp").applyInPandas(
            deal, "doc_id long, doc_tokens long, crcs array<long>, rest_seq long, rest_off long, full_seq long")
    )
    full = F.col("start") + sequence <= F.col("doc_tokens")
    return (
        dealt.select("*", F.posexplode("crcs").alias("k", "ids_crc32"))
        .withColumn("start", F.col("k").cast("long") * sequence)
        .select("doc_id", "start",
                F.least(F.lit(sequence).cast("long"), F.col("doc_tokens") - F.col("start")).alias("length"),
                "ids_crc32", "doc_tokens",
                F.when(full, F.col("full_seq") + F.col("k")).otherwise(F.col("rest_seq")).alias("sequence_id"),
                F.when(full, F.lit(0).cast("long")).otherwise(F.col("rest_off")).alias("offset"))
    )
