"""Splits, sampling and class weights.

Randomness is an engine-neutral hash, ``md5(key || '|' || seed)``, so a split
is reproducible, independent of partitioning, and checkable in SQL.  Ranks
inside a label (two groups: each may hold most rows) and the global date
order go through the skew-safe ``running`` helper: a group (or the whole
table) is ordered in one task only while it fits the per-task row budget,
and range-split across tasks beyond it.  Stratified splits need no rank of
every row, only the hash of the last row of a share, and sort nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.tables import attach
from ..session import materialize
from .running import running

#: Hex digits of the hash that a stratified split counts rows by.
PREFIX = 4


def hash_order(key: str = C.KEY, seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("bigint")


def chronological_split(df: DataFrame, date_col: str = C.DATE, key: str = C.KEY,
                        train: float = C.TEMPORAL_TRAIN, val: float = C.TEMPORAL_VAL) -> DataFrame:
    """Global (date, key) order; first int(n*train) rows train, next
    int(n*val) validation, rest test."""
    r = running(df, [], [date_col, key])
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    j = attach(r, n)
    n_train = F.floor(F.col("_n") * F.lit(train))
    n_val = F.floor(F.col("_n") * F.lit(val))
    split = F.when(F.col("_rn") <= n_train, "train").when(F.col("_rn") <= n_train + n_val, "val").otherwise("test")
    return j.withColumn("split", split).drop("_rn", "_n")


def _label_ranks(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    h = df.withColumn("_h", hash_order(key, seed))
    r = running(h, [label], ["_h", key])
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))  # one row per class
    return r.join(F.broadcast(sizes), label)


def _cut(df: DataFrame, label: str, key: str, seed: int, counts: dict[str, Column], last: str) -> DataFrame:
    """``split`` by exact numbers of the lowest hashes of each class: ``counts`` gives, in order, the splits and how many
    rows of a class (``_nc``) lie in them and in those before; the others are ``last``.

    No ranking of all rows: hashes are counted by class and prefix, the prefix that holds a count's last row is looked
    into, and every row is compared with that row's hash.  Only rows with that very hash (a repeated key) are ranked,
    and only where a count ends among them."""
    h = df.where(F.col(label).isNotNull()).withColumn("_h", F.coalesce(hash_order(key, seed), F.lit("")))  # no key comes first
    h = h.withColumn("_pre", F.substring("_h", 1, PREFIX))
    splits = list(counts)
    per = h.groupBy(label, "_pre").agg(F.count(F.lit(1)).alias("_n"))  # at most 16 ** PREFIX + 1 rows a class
    whole = Window.partitionBy(label)
    before = whole.orderBy("_pre").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(label, "_pre", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_nc"))
    held = [(F.col("_before") < n) & (n <= F.col("_before") + F.col("_n")) for n in counts.values()]
    cuts = materialize(per.groupBy(label).agg(
        *[F.max(F.when(c, F.col("_pre"))).alias(f"_pre{i}") for i, c in enumerate(held)],
        *[F.max(F.when(c, n - F.col("_before"))).alias(f"_left{i}") for i, (c, n) in enumerate(zip(held, counts.values()))]))  # one row a class
    inside = F.lit(False)
    for i in range(len(splits)):
        inside = inside | F.col("_pre").eqNullSafe(F.col(f"_pre{i}"))
    near = h.join(F.broadcast(cuts), label).where(inside).groupBy(label, "_pre", "_h").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label, "_pre").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(cuts), label)
    at = [(F.col("_pre") == F.col(f"_pre{i}")) & (F.col("_before") < F.col(f"_left{i}")) & (F.col(f"_left{i}") <= F.col("_before") + F.col("_n"))
          for i in range(len(splits))]
    cuts = materialize(near.groupBy(label).agg(
        *[F.max(F.when(c, F.col("_h"))).alias(f"_at{i}") for i, c in enumerate(at)],
        *[F.max(F.when(c, F.col(f"_left{i}") - F.col("_before"))).alias(f"_take{i}") for i, c in enumerate(at)],
        *[F.max(F.when(c, F.col("_n"))).alias(f"_tied{i}") for i, c in enumerate(at)]))  # one row a class
    among = F.lit(False)
    for i in range(len(splits)):
        among = among | F.coalesce(F.col(f"_take{i}") < F.col(f"_tied{i}"), F.lit(False))
    j = h.drop("_pre").join(F.broadcast(cuts), label, "left")
    rank = F.lit(0)
    if cuts.where(among).limit(1).count():
        tied = F.lit(False)
        for i in range(len(splits)):
            tied = tied | F.col("_h").eqNullSafe(F.col(f"_at{i}"))
        ranked = running(j.where(tied), [label, "_h"], [key])
        j = j.where(~tied).withColumn("_rn", F.lit(0).cast(ranked.schema["_rn"].dataType)).unionByName(ranked)
        rank = F.col("_rn")
    out = F.lit(last)
    for i, name in reversed(list(enumerate(splits))):
        out = F.when((F.col("_h") < F.col(f"_at{i}")) | ((F.col("_h") == F.col(f"_at{i}")) & (rank <= F.col(f"_take{i}"))), name).otherwise(out)
    return j.withColumn("split", out).select(label, *[c for c in df.columns if c not in (label, "split")], "split")


def stratified_split(df: DataFrame, label: str = C.LABEL, key: str = C.KEY, test: float = C.TEST_FRACTION,
                     seed: int = 42) -> DataFrame:
    """Exact per-class test share: the round(test * n_class) lowest hash
    ranks of each class are test, the rest train."""
    return _cut(df, label, key, seed, {"test": round_half_up(F.col("_nc") * F.lit(test))}, "train")


def stratified_three_way(df: DataFrame, label: str = C.LABEL, key: str = C.KEY, test: float = C.TEST_FRACTION,
                         val: float = C.VAL_FRACTION, seed: int = 42) -> DataFrame:
    """Test first, then validation = val/(1-test) of the remainder, per class."""
    n_test = round_half_up(F.col("_nc") * F.lit(test))
    n_val = round_half_up((F.col("_nc") - n_test) * F.lit(val / (1 - test)))
    return _cut(df, label, key, seed, {"test": n_test, "val": n_test + n_val}, "train")


def ranked_three_way(df: DataFrame, label: str = C.LABEL, key: str = C.KEY, test: float = C.TEST_FRACTION,
                     val: float = C.VAL_FRACTION, seed: int = 42) -> DataFrame:
    """X2 by rank: the rows of ``stratified_three_way`` in hash order, which iterative fits have been run on."""
    r = _label_ranks(df, label, key, seed)
    n_test = round_half_up(F.col("_nc") * F.lit(test))
    n_val = round_half_up((F.col("_nc") - n_test) * F.lit(val / (1 - test)))
    split = F.when(F.col("_rn") <= n_test, "test").when(F.col("_rn") <= n_test + n_val, "val").otherwise("train")
    return r.withColumn("split", split).drop("_h", "_rn", "_nc")


def stratified_folds(df: DataFrame, k: int = C.KFOLDS, label: str = C.LABEL, key: str = C.KEY,
                     seed: int = 42) -> DataFrame:
    """fold = (rank - 1) mod k inside each class."""
    r = _label_ranks(df, label, key, seed)
    return r.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_h", "_rn", "_nc")


def undersample(df: DataFrame, label: str = C.LABEL, key: str = C.KEY, seed: int = 42) -> DataFrame:
    """Keep the minority class and the first n_minority rows of every other
    class in hash order."""
    r = _label_ranks(df, label, key, seed)
    n_min = r.select(F.min("_nc").alias("_nmin"))
    return attach(r, n_min).where(F.col("_rn") <= F.col("_nmin")).drop("_h", "_rn", "_nc", "_nmin")


def class_weights(df: DataFrame, label: str = C.LABEL) -> DataFrame:
    """Per class n, balanced weight n / (k * n_c) and scale_pos_weight = neg/pos."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    tot = c.agg(F.sum("n_class").alias("_n"), F.count(F.lit(1)).alias("_k"),
                F.sum(F.when(F.col(label) == 1, F.col("n_class"))).alias("_pos"),
                F.sum(F.when(F.col(label) == 0, F.col("n_class"))).alias("_neg"))
    return attach(c, tot).select(
        label, "n_class", (F.col("_n") / (F.col("_k") * F.col("n_class"))).alias("balanced_weight"),
        (F.col("_neg") / F.col("_pos")).alias("scale_pos_weight"))


def with_weights(df: DataFrame, label: str = C.LABEL, out: str = "weight") -> DataFrame:
    """X6 applied: ``weightCol`` for Spark ML (broadcast of one row per class)."""
    w = class_weights(df, label).select(label, F.col("balanced_weight").alias(out))
    return df.join(F.broadcast(w), label)


def bounded_sample(df: DataFrame, n: int, key: str = C.KEY, seed: int = 42) -> DataFrame:
    """The n rows first in hash order (top-k per task, then merged)."""
    return df.withColumn("_h", hash_order(key, seed)).orderBy("_h", key).limit(n).drop("_h")
