"""Near-duplicate groups from bottom-k sketches, inverted lists and exact checks.

One hash function; the sketch of a document is the k smallest hashes of its
shingle set.  Values are listed rarest first: two sets with Jaccard >= 0.75
share at least ``MIN_SHARED`` of 64 sketch values except with a chance below
one in a million, so they meet in an inverted list of the 64 - MIN_SHARED + 1
rarest values of each.  Sets that fit the sketch use the exact prefix bound.
Classes with a shared list are listed once more by their full sets: the exact
bound there (any alike pair shares one of the rarest quarter of each set's
values) parts texts that only have a passage in common, and the places of a
common value in both sets rule out pairs before they are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obol.llm.common import release, ship, staged
from obol.llm.textbytes import Words, give_back, mix64, slices, sorted_sets

K = 64
MIN_SHARED = 30
PERCENT = 75
#: The estimate of a pair must lie within this many standard deviations of the threshold to be checked exactly.
SLACK = 5.0
#: Offers that each open list draws in each round before all open pairs are tested; rounds that are always held.
DRAWS = (1, 4, 8, 16)
LEAST_ROUNDS = 2
#: Open pairs per row of the open lists that are tested at once.
FEW_PAIRS = 1
#: Bytes of text whose sets a task makes at once.
SLICE = 2 << 20
U = np.uint64


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (digest of the set), members (sorted 64-bit hashes, little endian)."""
    ship(docs.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, limit=SLICE):
            words = Words(texts)
            values, at = sorted_sets(*words.shingles(), words.n_rows)
            sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix64(values ^ U(c)))]) for c in (0x51ED270B, 0xB492B66F)]
            d1, d2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(np.diff(at)), pa.array(d1), pa.array(d2),
                pa.array([values[a:b].astype("<u8").tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()),
            ], names=["doc_id", "n_shingles", "d1", "d2", "members"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(sets, "doc_id long, n_shingles long, d1 long, d2 long, members binary")


def _sketch_values(classes: DataFrame) -> DataFrame:
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = [x.as_py() for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(b.column(0).to_numpy(), [len(x) // 8 for x in raw])),
                    pa.array(np.frombuffer(b"".join(raw), "<i8"))], names=["cid", "value"])
    return classes.select("cid", "sketch").mapInArrow(explode, "cid long, value long")


def inverted_lists(classes: DataFrame, whole: bool = False) -> DataFrame:
    """value, cid, n, pos: the lists of the rarest values of each class that another class holds, too.

    ``sketch`` holds the values: the K smallest of the set, or, if ``whole``,
    all of it; then the bound is exact for every pair of the given classes.
    ``pos`` is the value's place among the class's ``n`` values, rarest first.
    """
    values = _sketch_values(classes)
    freq = values.groupBy("value").count().where("count > 1")
    shared = values.join(freq, "value")
    held = Window.partitionBy("cid")
    n = F.col("n_shingles") if whole else F.least(F.col("n_shingles"), F.lit(K))
    need = F.ceil(n * PERCENT / 100)
    if not whole:
        need = F.when(F.col("n_shingles") <= K * PERCENT // 100, need).otherwise(F.lit(MIN_SHARED))
    ranked = shared.withColumn("r", F.row_number().over(held.orderBy("count", "value"))) \
        .withColumn("n_shared", F.count(F.lit(1)).over(held)) \
        .join(classes.select("cid", "n_shingles"), "cid")
    return ranked.withColumn("pos", n - F.col("n_shared") + F.col("r")).where(F.col("pos") <= n - need + 1) \
        .select("value", "cid", n.cast("long").alias("n"), F.col("pos").cast("long").alias("pos"))


def may_be_alike(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column) -> Column:
    """Whether sets whose first common value, rarest first, stands at these places can reach the threshold.

    Before that place neither set has a common value, so at most
    1 + min(n - pos) values are common; Jaccard t needs t / (1 + t) of both
    sizes together.  An alike pair passes in the list of its first common value.
    """
    most = 1 + F.least(n_a - pos_a, n_b - pos_b)
    return (100 + PERCENT) * most >= PERCENT * (n_a + n_b)


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold: estimated on the union sketch first."""
    def side(c):
        return sets.select(F.col("cid").alias(c), F.col("members").alias(f"m{c}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                keep.append(min(len(p), len(q)) * 100 >= PERCENT * max(len(p), len(q)) and _estimate(p, q) and _exact(p, q))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb").mapInArrow(check, "a long, b long")


def _estimate(p: np.ndarray, q: np.ndarray) -> bool:
    """Share of the union's K smallest values that both sketches hold, against the threshold less some slack."""
    p, q = p[:K], q[:K]
    both = np.sort(np.concatenate([p, q]))
    same = both[1:][both[1:] == both[:-1]]
    union = np.unique(both)[:K]
    share = np.searchsorted(same, union[-1], "right") / len(union)
    t = PERCENT / 100
    return share >= t - SLACK * (t * (1 - t) / len(union)) ** 0.5


def _exact(p: np.ndarray, q: np.ndarray) -> bool:
    both = np.sort(np.concatenate([p, q]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PERCENT * (len(both) - shared)


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (cid, comp) after joining components over links (a, b): smallest label wins.

    Minimum labels travel along links between components, then every label
    jumps to its own label's label; repeated until nothing changes.
    """
    own = labels.select(F.col("cid").alias("a"), F.col("comp").alias("ca"))
    far = labels.select(F.col("cid").alias("b"), F.col("comp").alias("cb"))
    edges = links.join(own, "a").join(far, "b").where("ca <> cb").select("ca", "cb")
    edges = staged(edges.union(edges.select("cb", "ca")).distinct(), "edges")
    roots = staged(edges.select(F.col("ca").alias("node"), F.col("ca").alias("root")).distinct(), "roots")
    while True:
        near = edges.join(roots.select(F.col("node").alias("cb"), "root"), "cb") \
            .groupBy(F.col("ca").alias("node")).agg(F.min("root").alias("low"))
        step = roots.join(near, "node", "left").select("node", F.least("root", F.coalesce("low", "root")).alias("next"), "root")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = staged(step.join(jump, "next", "left")
                     .select("node", F.least("next", F.coalesce("far", "next")).alias("root"),
                             (F.least("next", F.coalesce("far", "next")) != F.col("root")).alias("changed")), "roots")
        done = new.where("changed").isEmpty()
        release(roots)
        roots = new.select("node", "root")
        if done:
            break
    release(edges)
    return labels.join(roots.withColumnRenamed("node", "comp"), "comp", "left") \
        .select("cid", F.coalesce("root", "comp").alias("comp"))


def components(lists: DataFrame, sets: DataFrame, names: DataFrame) -> DataFrame:
    """cid, comp of every class that shares a list: connected by verified links; ``names`` has a class's own comp.

    Each round, every open list (with members of several components) offers
    some members, others every time, and each class tests one offer of another
    component for each of the round's draws.  When the pairs of different
    components that still share a list are no more than a few times the lists'
    rows, or after the last round, all of them are tested, so no link
    is lost.
    """
    labels = staged(lists.select("cid").distinct().join(names, "cid"), "labels")
    for turn in range(len(DRAWS) + 1):
        tagged = staged(lists.join(labels, "cid"), "tagged")
        held = tagged.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("value").agg(
            F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.count(F.lit(1)).alias("comps"))
        mixed = held.where("comps > 1")
        size = mixed.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                         F.coalesce(F.sum((F.col("rows").cast("double") * F.col("rows") - F.col("squares")) / 2), F.lit(0.0)).alias("pairs")).first()
        if not size.rows:
            release(tagged)
            break
        last = turn == len(DRAWS) or turn >= LEAST_ROUNDS and size.pairs <= FEW_PAIRS * size.rows
        open_ = tagged.join(mixed.select("value"), "value")
        if last:
            def side(c):
                return open_.select("value", F.col("cid").alias(c), *(F.col(x).alias(x + c) for x in ("comp", "n", "pos")))
            pairs = side("a").join(side("b"), "value").where("a < b and compa <> compb") \
                .where(may_be_alike(*(F.col(x) for x in ("na", "posa", "nb", "posb")))).select("a", "b").distinct()
        else:
            draws = range(DRAWS[turn])
            offers = open_.groupBy("value").agg(*(
                F.min(F.struct(F.xxhash64("cid", F.lit(turn), F.lit(i)).alias("h"), F.col("cid").alias("p"), F.col("comp").alias("pc"),
                               F.col("n").alias("pn"), F.col("pos").alias("pp"))).alias(f"o{i}")
                for i in draws))
            best = open_.join(offers, "value").groupBy("cid").agg(*(
                F.min(F.when((F.col("comp") != F.col(f"o{i}.pc")) & may_be_alike(F.col("n"), F.col("pos"), F.col(f"o{i}.pn"), F.col(f"o{i}.pp")),
                             F.struct(f"o{i}.h", f"o{i}.p"))).alias(f"m{i}") for i in draws))
            pairs = best.select("cid", F.explode(F.array(*(F.col(f"m{i}.p") for i in draws))).alias("p")).where("p is not null") \
                .select(F.least("cid", "p").alias("a"), F.greatest("cid", "p").alias("b")).distinct()
        links = staged(_checked(pairs, sets), "links")
        release(tagged)
        if not links.isEmpty():
            old, labels = labels, staged(merge_components(labels, links), "labels")
            release(old)
        release(links)
        if last:
            break
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (``doc_id``, ``text``).

    Texts without words (null, empty) are linked with nothing and keep their
    own id; texts of equal sets form a class named by its smallest doc_id;
    repeated rows are linked like copies, and two texts of one id share its
    component; null ids count as larger than all others (a class of null ids
    only is linked with nothing, its component and ``kept`` are null).
    Other columns are not read; an empty table gives none.
    """
    members = shingle_sets(docs)
    key = ["d1", "d2", "n_shingles"]
    node = F.xxhash64(*key).alias("cid")
    rows = staged(members.select("doc_id", "n_shingles", node), "sets")
    ids = staged(rows.where("n_shingles > 0").groupBy("cid").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "classes")
    named = ids.where("low is not null").select("cid", F.col("low").alias("comp"))
    # the row that stands for its class: its smallest id
    reps = named.select("cid", F.col("comp").alias("doc_id"))
    sketched = members.select("doc_id", "n_shingles", node, F.expr(f"substring(members, 1, {8 * K})").alias("sketch"))
    # one id a class: repeated rows are dropped by the join's keys, so that sets are shuffled once
    classes = staged(sketched.join(reps, ["doc_id", "cid"], "left_semi").dropDuplicates(["doc_id", "cid"]).select("cid", "n_shingles", "sketch"), "sketches")
    met = staged(inverted_lists(classes).select("cid").distinct(), "met")
    release(classes)
    wanted = reps.join(met, "cid")
    sets = staged(members.select("doc_id", "n_shingles", node, "members").join(wanted, ["doc_id", "cid"], "left_semi")
                  .dropDuplicates(["doc_id", "cid"]).select("cid", "n_shingles", "members"), "members")
    # classes that met through sketches meet again through the rarest quarter of their full sets
    lists = staged(inverted_lists(sets.withColumnRenamed("members", "sketch"), whole=True), "lists")
    release(met)
    comps = components(lists, sets, named)
    release(lists, sets)
    whole = ids.join(comps, "cid", "left").select("cid", F.coalesce("comp", "low").alias("component"))
    return rows.join(whole, "cid", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")) \
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
