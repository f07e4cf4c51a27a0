"""Exact substring deduplication: every byte of a 100-byte string that also starts earlier goes.

Winnowing picks an anchor (a 32-byte string) inside every 100-byte string by
its content alone, so equal strings have equal anchors at equal places.  Only
anchors that occur more than once are looked at further: the text around them
is brought together by anchor hash and sorted as suffixes (deep-shallow: a
multikey sort by eight bytes a step to a shallow depth, then blind tries for
the groups that still agree).  Common prefixes to the right and to the left
tell which 100-byte strings are equal, and the earliest of each stays.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obol.llm.common import ship, staged
from obol.llm.textbytes import _RAW_VALUE, _powers, mix64, slices

SPAN = 100
GRAM = 32
SIDE = SPAN - GRAM
SHALLOW_STEPS = 6
#: Occurrences of one anchor above which its strings are compared by a grouped minimum instead of in one task.
HOT = 50_000
CHUNK_ROWS = 40_000
SLICE = 1 << 20
U = np.uint64


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and start of the anchors of each text (texts shorter than SPAN have none)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < SPAN:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    pw, inv = _powers(n + 1)
    acc = np.zeros(n + 1, U)
    np.cumsum(_RAW_VALUE[data] * pw[:n], out=acc[1:])
    gram = mix64((acc[GRAM:] - acc[:-GRAM]) * inv[: n - GRAM + 1])
    bits = U(max(1, int(n).bit_length()))
    low = (U(1) << bits) - U(1)
    best = (gram & ~low) | np.arange(len(gram), dtype=U)
    width = 1
    while 2 * width <= SIDE + 1:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    rest = SIDE + 1 - width
    if rest:
        best = np.minimum(best[:-rest], best[rest:])
    at = (best & low).astype(np.int64)  # of the string that starts at each index
    ends = np.cumsum([len(t) for t in texts])
    valid = np.zeros(n + 1, np.int32)
    for lo, hi in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
        if hi - lo >= SPAN:
            valid[lo] += 1
            valid[hi - SPAN + 1] -= 1
    chosen = np.unique(at[np.cumsum(valid)[: len(at)] > 0])
    row = np.searchsorted(ends, chosen, "right")
    start = np.concatenate([[0], ends[:-1]])[row]
    return gram[chosen], row, chosen - start


class BlindTrie:
    """Orders distinct strings by a trie that keeps branching depths only (a Patricia tree walked blindly).

    A string descends by the bytes at branching depths, is compared once with
    the leaf it reaches, and is put in at the depth where the two differ.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: object = 0
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while not isinstance(node, int):
            depth, keys, kids = node
            k = bisect.bisect_left(keys, s[depth])
            node = kids[k] if k < len(keys) and keys[k] == s[depth] else kids[min(k, len(kids) - 1)]
        other = self.strings[node]
        at = next(d for d in range(len(s)) if s[d] != other[d])
        parent, slot, node = None, 0, self.root
        while not isinstance(node, int) and node[0] < at:
            parent, slot = node, bisect.bisect_left(node[1], s[node[0]])
            node = node[2][slot]
        if not isinstance(node, int) and node[0] == at:
            k = bisect.bisect_left(node[1], s[at])
            node[1].insert(k, s[at])
            node[2].insert(k, i)
            return
        pair = sorted([(s[at], 0, i), (other[at], 1, node)], key=lambda x: x[0])
        new = (at, [p[0] for p in pair], [p[2] for p in pair])
        if parent is None:
            self.root = new
        else:
            parent[2][slot] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack.extend(reversed(node[2]))
        return out


def deep_shallow_order(group: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Order of the rows by (group, row bytes); equal rows stay in given order.

    Shallow: groups are split by eight bytes at a time, as long as a group has
    several rows.  Deep: rows that still agree are ordered by a blind trie over
    their distinct strings.
    """
    n, width = text.shape
    pad = -width % 8
    words = np.ascontiguousarray(np.pad(text, ((0, 0), (0, pad)))).view(">u8").astype(U)
    order = np.argsort(group, kind="stable")
    block = np.concatenate([[0], np.cumsum(group[order][1:] != group[order][:-1])]) if n else np.zeros(0, np.int64)
    for step in range(min(SHALLOW_STEPS, words.shape[1])):
        size = np.bincount(block)
        busy = np.flatnonzero(size[block] > 1)
        if not len(busy):
            return order
        key = words[order[busy], step]
        sub = np.lexsort((key, block[busy]))
        order[busy] = order[busy][sub]
        key = key[sub]
        split = np.zeros(n, bool)
        split[1:] = block[1:] != block[:-1]
        inner = np.zeros(len(busy), bool)
        inner[1:] = (key[1:] != key[:-1]) & (busy[1:] == busy[:-1] + 1)
        split[busy[inner]] = True
        block = np.cumsum(split)
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [n]])
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo > 1:
            rows = order[lo:hi]
            same: dict[bytes, list[int]] = {}
            for r in sorted(rows.tolist()):
                same.setdefault(text[r].tobytes(), []).append(r)
            strings = list(same)
            if len(strings) > 1:
                strings = [strings[i] for i in BlindTrie(strings).order()]
            order[lo:hi] = [r for s in strings for r in same[s]]
    return order


def _prefixes(order: np.ndarray, group: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row in order shares with the row before (-1: another group)."""
    a, b = text[order[1:]], text[order[:-1]]
    differ = a != b
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), text.shape[1])
    lcp[group[order[1:]] != group[order[:-1]]] = -1
    return np.concatenate([[-1], lcp])


def covered(group: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest a (-1: none) for which the string from a bytes before the anchor occurs in an earlier row.

    Rows of a group are in text order.  ``left`` holds the SIDE bytes before the
    anchor backwards, ``right`` the SPAN bytes from its start; n_left and n_right
    say how many of them (beyond the anchor) the text has.
    """
    n = len(group)
    least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    r_order, l_order = deep_shallow_order(group, right), deep_shallow_order(group, left)
    r_lcp, l_lcp = _prefixes(r_order, group, right), _prefixes(l_order, group, left)
    r_class, l_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a in range(SIDE + 1):
        ok = np.flatnonzero((n_left >= a) & (n_right >= SIDE - a))
        if len(ok) < 2:
            continue
        r_class[r_order] = np.cumsum(r_lcp < SPAN - a)
        l_class[l_order] = np.cumsum(l_lcp < a)
        key = r_class[ok] * (n + 1) + l_class[ok]
        by = np.argsort(key, kind="stable")
        again = np.zeros(len(ok), bool)
        again[by[1:]] = key[by][1:] == key[by][:-1]
        hit = ok[again]
        least[hit] = np.where(least[hit] < 0, a, least[hit])
        most[hit] = a
    return least, most


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash those whose hash another row has, too, if their texts differ or one text has it twice."""
    names = ["key", "pos"]
    carry: pa.Table | None = None

    def flush(t: pa.Table):
        h = t.column("hash").to_numpy()
        same = np.concatenate([[False], h[1:] == h[:-1], [False]])
        key, pos = t.column("key").to_numpy(), t.column("pos").to_numpy()
        start = np.flatnonzero(~same[:-1])
        k_lo, k_hi = (f.reduceat(key, start) for f in (np.minimum, np.maximum))
        p_lo, p_hi = (f.reduceat(pos, start) for f in (np.minimum, np.maximum))
        good = (k_lo != k_hi) | (p_lo != p_hi)
        size = np.diff(np.concatenate([start, [len(h)]]))
        at = np.flatnonzero(np.repeat(good, size))
        hot = np.repeat(size > HOT, size)[at]
        return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(np.where(hot, -1 - pos[at], pos[at]))], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if carry is None else pa.concat_tables([carry, t])
        h = t.column("hash").to_numpy()
        cut = int(np.searchsorted(h, h[-1]))
        if cut:
            yield flush(t.slice(0, cut))
        carry = t.slice(cut)
    if carry is not None and carry.num_rows:
        yield flush(carry)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (``doc_id``, ``text``).

    Earlier means a smaller doc_id (null first), for equal ids the smaller
    digest of the text, or an earlier start; of repeated rows one is the
    earliest.  Null text is empty and, like texts under 100 bytes, loses
    nothing.  An empty table gives none; other columns are not read.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")) \
        .withColumn("sha", F.sha2("text", 256)).withColumn("key", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"))
    refs = staged(rows.groupBy("doc_id", "sha", "key", F.octet_length("text").cast("long").alias("n_bytes"))
                  .agg(F.count(F.lit(1)).alias("copies")), "refs")
    # the earliest row of each text; null ids sort first in a struct, as they do here
    firsts = staged(refs.groupBy("sha", "key").agg(F.min(F.struct("doc_id")).alias("f"))
                    .select(F.col("sha").alias("fsha"), F.col("key").alias("fkey"), F.col("f.doc_id").alias("fid")), "firsts")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, limit=SLICE):
            h, row, pos = anchors(texts)
            key = part.column(1).to_numpy()[row] if len(row) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key), pa.array(pos)], names=["hash", "key", "pos"])

    spread = rows.select("text", "key").mapInArrow(find, "hash long, key long, pos long") \
        .repartition("hash").sortWithinPartitions("hash")
    places = spread.mapInArrow(_repeated, "key long, pos long").distinct() \
        .groupBy("key").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    places = staged(places.join(firsts, F.col("key") == F.col("fkey")).select("fid", "fsha", "places"), "places")
    long_rows = rows.where(F.length("text") > 0).select(F.col("doc_id"), "sha", "text")
    near = long_rows.join(places, F.col("doc_id").eqNullSafe(F.col("fid")) & (F.col("sha") == F.col("fsha"))) \
        .select("text", "doc_id", "sha", "places")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, limit=SLICE):
            take, pos, hot, around, nl, nr = [], [], [], [], [], []
            for i, t in enumerate(texts):
                for x in part.column(3)[i].as_py():
                    p = x if x >= 0 else -1 - x
                    lo, hi = max(0, p - SIDE), min(len(t), p + SPAN)
                    take.append(i)
                    pos.append(p)
                    hot.append(x < 0)
                    nl.append(p - lo)
                    nr.append(hi - p - GRAM)
                    around.append(b"\0" * (SIDE - (p - lo)) + t[lo:hi] + b"\0" * (SPAN - (hi - p)))
            idx = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array([int.from_bytes(hashlib.blake2b(w[SIDE:SPAN], digest_size=8).digest(), "big", signed=True) for w in around], pa.int64()),
                part.column(1).take(idx), part.column(2).take(idx), pa.array(pos, pa.int64()), pa.array(around, pa.binary()),
                pa.array(nl, pa.int32()), pa.array(nr, pa.int32()), pa.array(hot, pa.bool_())],
                names=["gram", "doc_id", "sha", "pos", "around", "nl", "nr", "hot"])

    schema = "gram long, doc_id long, sha string, pos long, around binary, nl int, nr int, hot boolean"
    seen = staged(near.mapInArrow(windows, schema), "windows")
    hot = seen.where("hot").groupBy("gram").count().where(F.col("count") > HOT).select(F.col("gram").alias("hgram"))
    hot = staged(hot, "hot")
    cool, spans = seen.drop("hot"), None
    if not hot.isEmpty():
        cool = cool.join(hot, F.col("gram") == F.col("hgram"), "left_anti")
        spans = hot_spans(seen.join(hot, F.col("gram") == F.col("hgram"), "left_semi"))
    order = ["gram", F.col("doc_id").asc_nulls_first(), "sha", "pos"]
    found = cool.repartition("gram").sortWithinPartitions(*order) \
        .mapInArrow(_spans, "doc_id long, sha string, lo long, hi long")
    spans = found if spans is None else found.unionByName(spans)
    per_doc = spans.groupBy("doc_id", "sha").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")) \
        .select(F.col("doc_id").alias("sid"), F.col("sha").alias("ssha"), "spans")
    cut = long_rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("sid")) & (F.col("sha") == F.col("ssha"))) \
        .select("text", "doc_id", "sha", "spans")
    cut = staged(cut.mapInArrow(_cut, "cid long, csha string, removed long, runs long, kept string")
                 .dropDuplicates(["cid", "csha"]), "cut")
    tagged = refs.join(firsts, F.col("sha") == F.col("fsha")) \
        .join(cut, F.col("doc_id").eqNullSafe(F.col("cid")) & (F.col("sha") == F.col("csha")), "left")
    is_first = F.col("doc_id").eqNullSafe(F.col("fid"))
    gone = F.col("n_bytes") >= SPAN
    whole = F.struct(F.when(gone, F.col("n_bytes")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
                     F.when(gone, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"),
                     F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"))
    partly = F.struct(F.coalesce("removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("runs", F.lit(0).cast("long")).alias("n_spans"),
                      F.coalesce("kept", "sha").alias("kept_sha256"))
    each = F.when(is_first & (F.col("copies") == 1), F.array(partly)) \
        .when(is_first, F.concat(F.array(partly), F.array_repeat(whole, (F.col("copies") - 1).cast("int")))) \
        .otherwise(F.array_repeat(whole, F.col("copies").cast("int")))
    return tagged.select("doc_id", "n_bytes", F.explode(each).alias("o")).select("doc_id", "n_bytes", "o.*")


def hot_spans(seen: DataFrame) -> DataFrame:
    """Spans at anchors of very many occurrences.

    Places with equal surroundings share all their strings, so all but the
    earliest of them are covered as far as the surroundings reach.  Only the
    earliest place of each different surroundings offers its 100-byte strings,
    of which every place but the earliest is covered; a string travels as 128
    bits of its SHA-256, and the minima are taken before the shuffle.
    """
    place = F.struct("doc_id", "sha", "pos")
    rows = seen.select("doc_id", F.unhex("sha").alias("sha"), "pos", "nl", "nr", "around")
    same = ["around", "nl", "nr"]
    one = rows.groupBy(*same).agg(F.min(place).alias("f"))
    whole = rows.where(F.col("nl") + F.col("nr") >= SIDE).join(one, same).where(~place.eqNullSafe(F.col("f"))) \
        .select("doc_id", "sha", (F.col("pos") - F.col("nl")).alias("lo"), (F.col("pos") + (GRAM + F.col("nr"))).alias("hi"))
    strings = one.select("f.*", *same, F.explode(F.sequence(F.lit(0), F.lit(SIDE))).alias("a")) \
        .where((F.col("nl") >= F.col("a")) & (F.col("nr") >= SIDE - F.col("a"))) \
        .select("doc_id", "sha", (F.col("pos") - F.col("a")).alias("lo"),
                F.unhex(F.substring(F.sha2(F.expr(f"substring(around, {SIDE} - a + 1, {SPAN})"), 256), 1, 32)).alias("string"))
    start = F.struct("doc_id", "sha", "lo")
    first = strings.groupBy("string").agg(F.min(start).alias("f"))
    later = strings.join(first, "string").where(~start.eqNullSafe(F.col("f"))).select("doc_id", "sha", "lo", (F.col("lo") + SPAN).alias("hi"))
    return whole.unionByName(later).withColumn("sha", F.lower(F.hex("sha")))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gram, place): spans of the strings that an earlier row of the gram has."""
    def flush(t: pa.Table):
        gram = t.column("gram").to_numpy()
        around = np.frombuffer(b"".join(t.column("around").to_pylist()), np.uint8).reshape(-1, SIDE + SPAN)
        least, most = covered(gram, np.ascontiguousarray(around[:, SIDE - 1::-1]), np.ascontiguousarray(around[:, SIDE:]),
                              t.column("nl").to_numpy(), t.column("nr").to_numpy())
        at = np.flatnonzero(most >= 0)
        pos, idx = t.column("pos").to_numpy()[at], pa.array(at)
        out = pa.table({"doc_id": t.column("doc_id").take(idx), "sha": t.column("sha").take(idx),
                        "lo": pa.array(pos - most[at]), "hi": pa.array(pos - least[at] + SPAN)})
        yield from out.to_batches()

    carry: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if carry is None else pa.concat_tables([carry, t])
        if t.num_rows < CHUNK_ROWS:
            carry = t
            continue
        gram = t.column("gram").to_numpy()
        cut = int(np.searchsorted(gram, gram[-1]))
        if cut:
            yield from flush(t.slice(0, cut))
        carry = t.slice(cut)
    if carry is not None and carry.num_rows:
        yield from flush(carry)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        removed, runs, kept = [], [], []
        for t, spans in zip(texts, part.column(3).to_pylist(), strict=True):
            digest, end, n, k = hashlib.sha256(), 0, 0, 0
            stop = -1
            for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
                k += lo > stop
                stop = max(stop, hi)
                digest.update(t[end:max(end, lo)])
                n += max(0, hi - max(lo, end))
                end = max(end, hi)
            digest.update(t[end:])
            removed.append(n)
            runs.append(k)
            kept.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept)],
                                         names=["cid", "csha", "removed", "runs", "kept"])
