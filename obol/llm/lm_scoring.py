"""LM scoring by online logistic context mixing over hashed-context bit predictors.

A text is the byte string of its words, A-Z lower-cased, single spaces between
them and one end byte.  Each byte is coded as eight binary decisions.  For
each decision, the last 1 to 5 bytes with the bits so far are the slot of that
order, which holds how often the training corpus continued with 0 and with 1.
The slots' log odds are combined by logistic mixing; the weight set is gated by
the longest context with evidence and its amount.  Weights are learned online:
mini-batches of training decisions, each predicted from the counts without
itself, then used for a gradient step; parallel streams average their weights
after every epoch.  An adaptive probability map per gate refines the result.
The base-10 log probabilities of a text's decisions add up to its score.

At scale: the corpus is reduced to its distinct 6-byte strings with counts, a
table that grows with the input.  The strings of each order are that table
summed over their last bytes; a context's slots come from its at most 256 next
bytes, exactly and without hashing, and are joined along the orders.  Each
distinct string is scored once; its score goes to the blocks of documents that
hold it, as vocabulary counts go to the blocks that hold the word.  Only the
mixing weights and the adaptive map (fixed size) are broadcast.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obol.llm.common import release, ship, staged
from obol.llm.textbytes import mix64, slices

ORDERS = 5
BLOCK_DOCS = 1 << 13
EXACT = 24
LEVELS = 64
GATES = 3 * ORDERS + 1
CELLS = 33
REACH = 8.0
EPOCHS = 2
BATCH = 1 << 14
END = 10
#: Bytes of text scored at once, and strings that wait before they are merged or dealt out.
SLICE = 3 << 20
WAITING = 1 << 20
#: Parts that strings are dealt into; more by the root of the number of blocks over BLOCKS_BASE.
PARTS = 256
BLOCKS_BASE = 64
U = np.uint64


def quantised(n: np.ndarray) -> np.ndarray:
    """Count to level: exact up to EXACT, then four levels per doubling."""
    n = np.asarray(n, np.int64)
    big = EXACT + 1 + np.floor(4 * np.log2(np.maximum(n, EXACT + 1) / (EXACT + 1))).astype(np.int64)
    return np.minimum(np.where(n <= EXACT, n, big), LEVELS - 1)


def _level_counts() -> np.ndarray:
    at = np.arange(LEVELS, dtype=float)
    return np.where(at <= EXACT, at, (EXACT + 1) * 2.0 ** ((at - EXACT - 0.5) / 4))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Log odds and evidence class (0 none, 1 one, 2 two or three, 3 more) of a slot code (level0 * LEVELS + level1)."""
    c = _level_counts()
    n0, n1 = np.repeat(c, LEVELS), np.tile(c, LEVELS)
    odds = np.log((n1 + 0.2) / (n0 + 0.2))
    total = n0 + n1
    kind = np.select([total < 0.5, total < 1.5, total < 3.5], [0, 1, 2], 3)
    return odds.astype(np.float32), kind.astype(np.int64)


ODDS, EVIDENCE = _tables()


def byte_stream(words: list[bytes]) -> bytes:
    return b" ".join(words)


def codes(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 6-byte string (context and byte) that ends at every byte and end of each stream, and its stream."""
    pad = bytes([END]) * ORDERS
    data = np.frombuffer(pad + (bytes([END]) + pad).join(streams) + bytes([END]), np.uint8).astype(U)
    n = len(data) - ORDERS
    out = data[ORDERS:].copy()
    for k in range(1, ORDERS + 1):
        out |= data[ORDERS - k:len(data) - k] << U(8 * k)
    lengths = np.fromiter((len(s) + 1 for s in streams), np.int64, len(streams))
    starts = np.cumsum(lengths + ORDERS) - lengths - ORDERS
    keep = np.ones(n, bool)
    gap = (starts[1:, None] - ORDERS + np.arange(ORDERS)).ravel()
    keep[gap[(gap >= 0) & (gap < n)]] = False
    return out[keep], np.repeat(np.arange(len(streams)), lengths)


def bits_of(grams: np.ndarray) -> np.ndarray:
    """Bits (8 x n) of each gram's last byte."""
    return ((grams & U(255)).astype(np.int64) >> (7 - np.arange(8)[:, None])) & 1


def decisions(grams: np.ndarray, slot_bits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed slots (ORDERS x 8 x n) in tables of fixed size, and bits (8 x n), of the decisions of each gram's last byte."""
    byte = (grams & U(255)).astype(np.int64)
    step = np.arange(8)[:, None]
    node = (1 << step) | (byte >> (8 - step))
    spread = node.astype(U) * U(0x9E3779B97F4A7C15)
    slots = np.empty((ORDERS, 8, len(grams)), np.int64)
    for k in range(1, ORDERS + 1):
        ctx = mix64(((grams >> U(8)) & U((1 << 8 * k) - 1)) ^ U(k << 56))
        slots[k - 1] = (mix64(ctx ^ spread) >> U(64 - slot_bits[k - 1])).astype(np.int64)
    return slots, bits_of(grams)


def slot_codes(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Slot codes (n x 8) of the decisions of each gram's last byte after its context.

    ``grams`` ascend and hold all next bytes of each of their contexts.
    """
    if not len(grams):
        return np.zeros((0, 8), "<u2")
    sums = []
    for bits in range(9):
        key = grams >> U(8 - bits)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums.append(np.repeat(np.add.reduceat(n, start), np.diff(np.append(start, len(key)))))
    own = np.stack(sums[1:])
    other = quantised(np.stack(sums[:-1]) - own)
    own = quantised(own)
    return np.where(bits_of(grams) == 1, other * LEVELS + own, own * LEVELS + other).T.astype("<u2")


def features(code: np.ndarray, bit: np.ndarray, without: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretched predictions (ORDERS x m), gate (m) and bit (m) of decisions with these codes; ``without`` takes one own occurrence off."""
    if without:
        own = np.where(bit == 1, code % LEVELS, code // LEVELS)
        code = code - np.where((own > 0) & (own <= EXACT), np.where(bit == 1, 1, LEVELS), 0)
    gate = np.zeros(len(bit), np.int64)
    for k in range(ORDERS):
        e = EVIDENCE[code[k]]
        gate = np.where(e > 0, 3 * k + e, gate)
    return ODDS[code], gate, bit


def unpacked(grams: np.ndarray, codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (ORDERS x 8n) and bits (8n) of strings with these packed codes (order by order, step by step)."""
    code = np.frombuffer(b"".join(codes), "<u2").reshape(len(grams), ORDERS * 8).astype(np.int64).T.reshape(ORDERS, -1)
    return code, bits_of(grams).reshape(-1)


class Model:
    """Mixing weights and adaptive probability map; with tables of hashed slots it scores any string by itself."""

    def __init__(self, slot_bits: tuple[int, ...] = (), table: list[np.ndarray] = (), weights: np.ndarray | None = None, apm: np.ndarray | None = None):
        self.slot_bits, self.table = slot_bits, table
        self.weights = np.full((GATES, ORDERS + 1), 0.35) if weights is None else weights
        if weights is None:
            self.weights[:, ORDERS] = 0.0
        self.apm = apm

    def inputs(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (ORDERS x m) and bits (m) of all decisions, from the tables."""
        slots, bit = decisions(grams, self.slot_bits)
        return np.stack([self.table[k][slots[k].reshape(-1)] for k in range(ORDERS)]).astype(np.int64), bit.reshape(-1)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        w = self.weights
        z = w[gate, ORDERS].copy()
        for k in range(ORDERS):
            z += w[gate, k] * x[k]
        return np.clip(z, -12, 12)

    def refined(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability of a 1: mean of the mix and its map between the two nearest cells."""
        p = 1 / (1 + np.exp(-z))
        if self.apm is None:
            return p
        at = (np.clip(z, -REACH, REACH) + REACH) * ((CELLS - 1) / (2 * REACH))
        lo = np.minimum(at.astype(np.int64), CELLS - 2)
        f = at - lo
        q = self.apm[gate, lo] * (1 - f) + self.apm[gate, lo + 1] * f
        return np.clip((p + q) / 2, 1e-6, 1 - 1e-6)

    def logs(self, code: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Base-10 log probability of each byte whose eight decisions these are."""
        x, gate, bit = features(code, bit)
        p = self.refined(self.mixed(x, gate), gate)
        return np.log10(np.where(bit == 1, p, 1 - p)).reshape(8, -1).sum(axis=0)

    def log10(self, grams: np.ndarray, codes: list[bytes] | None = None) -> np.ndarray:
        """Base-10 log probability of the last byte of each gram after its context."""
        out = np.empty(len(grams))
        for lo in range(0, len(grams), BATCH):
            part = grams[lo:lo + BATCH]
            out[lo:lo + BATCH] = self.logs(*(self.inputs(part) if codes is None else unpacked(part, codes[lo:lo + BATCH])))
        return out


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct grams with their summed counts."""
    g, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
    order = np.argsort(g, kind="stable")
    g = g[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))[:len(g)]
    return g[start], np.add.reduceat(n[order], start) if len(g) else n


def pieces(grams: np.ndarray, values: np.ndarray, parts: int) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Part, strings and values of each piece that these strings are dealt into."""
    part = (mix64(grams) % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0]))[:len(part)]
    ends = np.append(at[1:], len(part))
    g, v = grams[order].astype("<u8"), values[order]
    return part[order[at]], [g[i:j].tobytes() for i, j in zip(at, ends, strict=False)], [v[i:j].tobytes() for i, j in zip(at, ends, strict=False)]


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all 8-byte values, then their second bytes and so on: like bytes lie together and compress."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(packed: bytes, kind: str) -> np.ndarray:
    """The values that ``planes`` laid out."""
    return np.frombuffer(packed, np.uint8).reshape(8, -1).T.copy().view(kind).reshape(-1)


def _block_strings(rows: DataFrame, parts: int) -> DataFrame:
    """part, block, grams, n: the distinct 6-byte strings of each block with their counts in its training texts, packed by part."""
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size, most = None, [], 0, WAITING

        def flush():
            if held:
                part, g, n = pieces(*merged(held), parts)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), block, np.int64)), pa.array(g, pa.binary()), pa.array(n, pa.binary())],
                                                 names=["part", "block", "grams", "n"])

        for part, texts in slices(batches, limit=SLICE):
            at = part.column(0).to_numpy()
            test = part.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if at[lo] != block:
                    yield from flush()
                    block, held, size, most = at[lo], [], 0, WAITING
                for learned in (True, False):
                    own = [texts[i] for i in range(lo, hi) if test[i] != learned]
                    if own:
                        u, n = np.unique(codes([byte_stream(t.lower().split()) for t in own])[0], return_counts=True)
                        held.append((u, n.astype("<i8") * learned))
                        size += len(u)
                if size > most:
                    held = [merged(held)]
                    size = len(held[0][0])
                    most = max(WAITING, 2 * size)
        yield from flush()
    return rows.select("block", "held_out", "text").mapInArrow(strings, "part long, block long, grams binary, n binary")


def _string_counts(strings: DataFrame) -> DataFrame:
    """gram, n: each distinct string once, with its count in all training texts (0 if only held-out texts have it)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, most = None, [], 0, WAITING

        def flush():
            if held:
                g, n = merged(held)
                yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

        for b in batches:
            for p, g, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part:
                    yield from flush()
                    part, held, size, most = p, [], 0, WAITING
                held.append((np.frombuffer(g, "<u8"), np.frombuffer(n, "<i8")))
                size += len(held[-1][0])
                if size > most:
                    held = [merged(held)]
                    size = len(held[0][0])
                    most = max(WAITING, 2 * size)
        yield from flush()
    return strings.select("part", "grams", "n").repartition("part").sortWithinPartitions("part").mapInArrow(count, "gram long, n long")


def _coded(counted: DataFrame) -> DataFrame:
    """gram, n, codes (eight packed slot codes) of the strings of one order; a context has 256 rows at most."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n = np.zeros(0, U), np.zeros(0, np.int64)

        def rows(g, n):
            return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(n), pa.array([x.tobytes() for x in slot_codes(g, n)], pa.binary())],
                                              names=["gram", "n", "codes"])

        for b in batches:
            if b.num_rows:
                g, n = np.concatenate([g, b.column(0).to_numpy().astype(U)]), np.concatenate([n, b.column(1).to_numpy()])
                cut = np.searchsorted(g >> U(8), g[-1] >> U(8))  # the last context may go on in the next batch
                yield rows(g[:cut], n[:cut])
                g, n = g[cut:], n[cut:]
        yield rows(g, n)
    return counted.repartition(F.shiftright("gram", 8)).sortWithinPartitions("gram").mapInArrow(code, "gram long, n long, codes binary")


def coded_strings(strings: DataFrame) -> DataFrame:
    """gram, n, codes: each distinct string (``gram``, ``n``) with the packed slot codes of all its orders."""
    counted = {ORDERS: strings}
    for k in range(ORDERS - 1, 0, -1):
        counted[k] = staged(counted[k + 1].groupBy(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n")), "strings")
    out = _coded(counted[1])
    for k in range(2, ORDERS + 1):
        # the string of the order below: one row a key, under at most 256 rows
        low = out.select(F.col("gram").alias("low"), F.col("codes").alias("before"))
        out = _coded(counted[k]).withColumn("low", F.col("gram").bitwiseAND((1 << 8 * k) - 1)).join(low, "low") \
            .select("gram", "n", F.concat("before", "codes").alias("codes"))
    # in a random order, in which the weights are learned
    done = staged(out.repartition(F.xxhash64("gram")).sortWithinPartitions(F.xxhash64("gram", F.lit(1))), "coded", "zstd")
    release(*(counted[k] for k in range(1, ORDERS)))
    return done


def _learn(coded: DataFrame, model: Model) -> Model:
    """Online epochs in parallel streams; after each the streams' weights are averaged by their decisions."""
    sc = coded.sparkSession.sparkContext
    ordered = coded.where("n > 0")
    for epoch in range(EPOCHS + 1):
        last = epoch == EPOCHS
        shared = sc.broadcast(model.weights)
        rate = 0.02 / (1 + epoch)

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Model(weights=shared.value.copy())  # noqa: B023
            seen = np.zeros(GATES)
            hits = np.zeros((2, GATES * CELLS))
            for b in batches:
                g, n, packed = b.column(0).to_numpy().view(U), b.column(1).to_numpy().astype(float), b.column(2).to_pylist()
                for lo in range(0, len(g), BATCH // 8):
                    x, gate, bit = features(*unpacked(g[lo:lo + BATCH // 8], packed[lo:lo + BATCH // 8]), without=True)
                    w = np.tile(n[lo:lo + BATCH // 8], 8)
                    z = own.mixed(x, gate)
                    total = np.bincount(gate, weights=w, minlength=GATES)
                    seen += total
                    if last:  # noqa: B023
                        at = (np.clip(z, -REACH, REACH) + REACH) * ((CELLS - 1) / (2 * REACH))
                        lo_cell = np.minimum(at.astype(np.int64), CELLS - 2)
                        f = at - lo_cell
                        for cell, share in ((lo_cell, 1 - f), (lo_cell + 1, f)):
                            hits[0] += np.bincount(gate * CELLS + cell, weights=w * share, minlength=GATES * CELLS)
                            hits[1] += np.bincount(gate * CELLS + cell, weights=w * share * bit, minlength=GATES * CELLS)
                        continue
                    error = w * (bit - 1 / (1 + np.exp(-z)))
                    scale = 10 * rate / np.maximum(total, 1e-9)  # noqa: B023
                    for k in range(ORDERS):
                        own.weights[:, k] += scale * np.bincount(gate, weights=error * x[k], minlength=GATES)
                    own.weights[:, ORDERS] += scale * np.bincount(gate, weights=error, minlength=GATES)
            yield pa.RecordBatch.from_arrays([pa.array([(own.weights * seen[:, None]).ravel().tolist()]), pa.array([seen.tolist()]),
                                              pa.array([hits.ravel().tolist()])], names=["w", "n", "hits"])

        sums = _sum_arrays(ordered.mapInArrow(stream, "w array<double>, n array<double>, hits array<double>"))
        if last:
            count, ones = sums["hits"].reshape(2, GATES, CELLS) if len(sums["hits"]) else np.zeros((2, GATES, CELLS))
            centre = 1 / (1 + np.exp(-np.linspace(-REACH, REACH, CELLS)))
            model.apm = (ones + 0.5 * centre) / (count + 0.5)
        elif len(sums["n"]):
            n = sums["n"][:, None]
            model.weights = np.where(n > 0, sums["w"].reshape(GATES, ORDERS + 1) / np.maximum(n, 1e-9), model.weights)
        shared.unpersist()
    return model


def _sum_arrays(parts: DataFrame) -> dict[str, np.ndarray]:
    """Element sums of the array columns over all streams (one fixed-size row reaches the driver).

    Numbers are rounded before adding, so that the order of adding decides nothing.
    """
    flat = parts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("a")) for c in parts.columns))).alias("s")) \
        .select("s.c", F.posexplode("s.a").alias("i", "v")) \
        .groupBy("c", "i").agg(F.sum(F.col("v").cast("decimal(38,9)")).cast("double").alias("v")).toArrow().to_pandas()
    return {c: flat[flat.c == c].sort_values("i").v.to_numpy() for c in parts.columns}


def _string_scores(coded: DataFrame, strings: DataFrame, model: Model, parts: int) -> DataFrame:
    """block, grams, logs: the strings of each block with their log probabilities, packed in byte planes."""
    shared = coded.sparkSession.sparkContext.broadcast((model.weights, model.apm))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weights=shared.value[0], apm=shared.value[1])
        held, size = [], 0

        def flush():
            if held:
                part, g, logs = pieces(*(np.concatenate([x[i] for x in held]) for i in (0, 1)), parts)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(g, pa.binary()), pa.array(logs, pa.binary())], names=["part", "grams", "logs"])

        for b in batches:
            g = b.column(0).to_numpy().astype(U)
            held.append((g, model.log10(g, b.column(1).to_pylist()).astype("<f8")))
            size += len(g)
            if size > WAITING:
                yield from flush()
                held, size = [], 0
        yield from flush()

    scored = coded.select("gram", "codes").mapInArrow(own, "part long, grams binary, logs binary")
    both = scored.select("part", F.lit(-1).cast("long").alias("block"), "grams", "logs") \
        .unionByName(strings.select("part", "block", "grams", F.lit(b"").alias("logs")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, table = None, [], None
        for b in batches:
            blocks, grams, logs = [], [], []
            for p, block, g, v in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if p != part:
                    part, held, table = p, [], None
                g = np.frombuffer(g, "<u8")
                if block < 0:
                    held.append((g, np.frombuffer(v, "<f8")))
                    continue
                table = table or ascending(held)
                blocks.append(block)
                grams.append(planes(g))
                logs.append(planes(table[1][np.searchsorted(table[0], g)]))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(grams, pa.binary()), pa.array(logs, pa.binary())], names=["block", "grams", "logs"])

    return both.repartition("part").sortWithinPartitions("part", "block").mapInArrow(look_up, "block long, grams binary, logs binary")


def ascending(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Strings of all pieces in ascending order, with their values."""
    g, v = (np.concatenate([x[i] for x in held]) for i in (0, 1))
    order = np.argsort(g, kind="stable")
    return g[order], v[order]


def _block_words(rows: DataFrame, parts: int) -> DataFrame:
    """part, block, words, n: the words of each block with their counts in its training texts, packed by part."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known, counts = None, set(), Counter()

        def flush():
            counts.update(dict.fromkeys(known - counts.keys(), 0))
            if counts:
                own = sorted(counts)
                part = np.fromiter(map(zlib.crc32, own), np.int64, len(own)) % parts
                order = np.argsort(part, kind="stable")
                cuts = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(own)]
                n = np.fromiter((counts[own[i]] for i in order), "<i8", len(own))
                yield pa.RecordBatch.from_arrays([
                    pa.array(part[order][cuts[:-1]]), pa.array(np.full(len(cuts) - 1, block, np.int64)),
                    pa.array([b" ".join(own[i] for i in order[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                    pa.array([n[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:], strict=False)], pa.binary())],
                    names=["part", "block", "words", "n"])

        for part, texts in slices(batches):
            for b, held, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                if b != block:
                    yield from flush()
                    block, known, counts = b, set(), Counter()
                own = t.lower().split()
                (known if held else counts).update(own)
        yield from flush()

    return rows.select("block", "held_out", "text").mapInArrow(words, "part long, block long, words binary, n binary")


def _word_counts(pieces: DataFrame) -> DataFrame:
    """block, words, counts (in all training texts), total and known (tokens and words of the training texts, once a part).

    A task holds the pieces of one part at a time; as the parts grow with the
    root of the number of blocks, so does a part.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, counts = None, [], Counter()

        def flush():
            total, known = sum(counts.values()), sum(c > 0 for c in counts.values())
            for lo in range(0, len(held), 64):
                some = [(block, w, np.fromiter(map(counts.__getitem__, w.split(b" ")), "<i8").tobytes()) for block, w in held[lo:lo + 64]]
                once = [int(lo + i == 0) for i in range(len(some))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.binary()), pa.array([x[2] for x in some], pa.binary()),
                    pa.array([total * x for x in once], pa.int64()), pa.array([known * x for x in once], pa.int64())],
                    names=["block", "words", "counts", "total", "known"])

        for b in batches:
            for p, block, w, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if p != part:
                    yield from flush()
                    part, held, counts = p, [], Counter()
                held.append((block, w))
                for word, c in zip(w.split(b" "), np.frombuffer(n, "<i8").tolist(), strict=True):
                    counts[word] += c
        yield from flush()

    return pieces.repartition("part").sortWithinPartitions("part").mapInArrow(
        count, "block long, words binary, counts binary, total long, known long")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every row.

    Rows whose crc32(doc_id as text) mod 7 is 2 are held out, all others are
    learned from (null ids too).  Null text is empty: one token, the end.  With
    no training row nothing is known and the model is untrained; repeated rows
    score alike; an empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    number = F.col("doc_id").cast("long")
    rows = docs.select(number.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.crc32(number.cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held_out"),
                       F.floor(F.monotonically_increasing_id() / BLOCK_DOCS).alias("block"))
    rows = staged(rows, "lm-rows", "zstd")
    held = rows.agg(F.count(F.when(~F.col("held_out"), 1)).alias("train"), F.countDistinct("block").alias("blocks")).first()
    train_docs = held.train
    parts = PARTS * math.ceil(math.sqrt(max(1, held.blocks) / BLOCKS_BASE))
    words = staged(_word_counts(_block_words(rows, parts)), "words")
    total = words.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()
    n_train, vocabulary = total.n + train_docs, total.v + (train_docs > 0)
    floor = math.log10(n_train + vocabulary + 1)
    end = math.log10(train_docs + 1)
    strings = staged(_block_strings(rows, parts), "block-strings")
    counted = staged(_string_counts(strings), "strings")
    coded = coded_strings(counted)
    points_of = staged(_string_scores(coded, strings, _learn(coded, Model()), parts), "points")
    release(counted, strings)

    def laid(df: DataFrame, kind: Column, number: Column, text: Column, packed: Column) -> DataFrame:
        # few columns: words and texts are most of what is shuffled
        return df.select("block", kind.alias("kind"), number.cast("long").alias("number"), text.cast("string").alias("text"), packed.cast("binary").alias("packed"))

    none = F.lit(None)
    both = laid(words, F.lit(0), none, F.col("words"), F.col("counts")).union(laid(points_of, F.lit(1), none, none, F.concat("grams", "logs"))) \
        .union(laid(rows, F.when(F.col("held_out"), 3).otherwise(2), F.col("doc_id"), F.col("text"), none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, logs, held, table = None, {}, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(0).to_numpy() * 4 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                if part.column(0)[0].as_py() != block:
                    block, logs, held, table = part.column(0)[0].as_py(), {}, [], None
                if part.column(1)[0].as_py() == 0:
                    for w, n in zip(part.column(3).cast(pa.binary()).to_pylist(), part.column(4).to_pylist(), strict=True):
                        logs.update(zip(w.split(b" "), np.log10(np.frombuffer(n, "<i8") + 1.0).tolist(), strict=True))
                    continue
                if part.column(1)[0].as_py() == 1:
                    # half of each piece are strings, half their logs
                    held += [(from_planes(x[:len(x) // 2], "<u8"), from_planes(x[len(x) // 2:], "<f8")) for x in part.column(4).to_pylist()]
                    continue
                if table is None:
                    table, held = ascending(held), []
                for piece, texts in slices(iter([part]), limit=SLICE):
                    own = [t.lower().split() for t in texts]
                    values = [np.fromiter(map(logs.__getitem__, w), float, len(w)) for w in own]
                    n = np.array([len(w) + 1 for w in own])
                    known = np.array([int((v > 0).sum()) for v in values]) + (train_docs > 0)
                    base = np.array([v.sum() for v in values]) + end - n * floor
                    streams = [byte_stream(w) for w in own]
                    size = np.array([len(s) + 1 for s in streams])
                    points = _scores(*table, streams)
                    yield pa.RecordBatch.from_arrays([
                        piece.column(2), pa.array(piece.column(1).to_numpy() == 3), pa.array(n), pa.array(known), pa.array(np.full(len(n), n_train, np.int64)),
                        pa.array(base), pa.array(points), pa.array(size), pa.array(-points / math.log10(2) / size)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])

    return both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")


def _scores(grams: np.ndarray, logs: np.ndarray, streams: list[bytes]) -> np.ndarray:
    """Score of each stream from the log probabilities of its strings; each distinct one is looked up once."""
    out = np.zeros(len(streams))
    for lo in range(0, len(streams), 1 << 16):
        code, row = codes(streams[lo:lo + (1 << 16)])
        key = np.sort((code << U(16)) | row.astype(U))
        gram = key >> U(16)
        start = np.concatenate([[True], gram[1:] != gram[:-1]])
        log = logs[np.searchsorted(grams, gram[start])]
        out[lo:lo + (1 << 16)] = np.bincount((key & U(0xFFFF)).astype(np.int64), weights=log[np.cumsum(start) - 1],
                                             minlength=min(len(streams) - lo, 1 << 16))
    return out
