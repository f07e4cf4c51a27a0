"""Skew-safe running aggregates ("two-level rank / cumulative sum", SURVEY §4).

``running(df, keys, order, ...)`` adds, for every row, the number of rows of
its ``keys`` group that come strictly before it in ``order`` (``_rn`` is that
plus one), strictly-earlier running sums of chosen columns, and the values of
chosen columns on the immediately previous row of the group.

A plain ``Window.partitionBy(keys)`` puts a whole group into one task.  When a
group may hold a third of all rows (two labels, one global order, one hot
client) that task is the job.  Here the work is split in two:

* light groups (at most ``max_group_rows`` rows, the per-task budget) use the
  plain window, one hash shuffle on the keys;
* heavy groups are range-partitioned on ``keys + order`` so a hot group spans
  many partitions, cut with a reliable checkpoint so bucket ids are stable,
  summed locally per (bucket, group), and stitched with an offsets table.
  Only the first group of a bucket can continue from earlier buckets, so the
  offsets table has at most one row per bucket: its broadcast is bounded by
  the partition count, not by the data.

One partial-aggregated ``groupBy(keys).count()`` gives the largest group; if
it fits the budget the plain window is used.  Otherwise the heavy keys are
tagged through a broadcast whose size is bounded by ``rows / budget`` (the
budget is raised so there are at most ``MAX_HEAVY_KEYS``).  Without keys (one
global order) the range path is used once the table exceeds the budget.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

MAX_HEAVY_KEYS = 10_000
DEFAULT_MAX_GROUP_ROWS = 2_000_000


def _join_small(big: DataFrame, small: DataFrame, cols: Sequence[str], send: bool = True) -> DataFrame:
    """Left join of a bounded table onto ``big`` by null-safe equality, keeping big's key columns."""
    if not cols:
        raise ValueError("join columns required")
    renamed = small.select(*[F.col(c).alias(f"__k_{c}") for c in cols],
                           *[c for c in small.columns if c not in cols])
    cond = reduce(lambda a, b: a & b, [big[c].eqNullSafe(renamed[f"__k_{c}"]) for c in cols])
    out = big.join(F.broadcast(renamed) if send else renamed, cond, "left")
    return out.drop(*[f"__k_{c}" for c in cols])


def _outputs(sums: Sequence[str], lasts: Sequence[str], maxes: Sequence[str] = ()) -> list[str]:
    return (["_rn"] + [f"_cum_{m}" for m in sums] + [f"_prev_{c}" for c in lasts]
            + [f"_max_{m}" for m in maxes])


def _plain(df: DataFrame, keys, order, sums, lasts, maxes=()) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    wp = w.rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "*",
        (F.count(F.lit(1)).over(wp) + 1).alias("_rn"),
        *[F.sum(m).over(wp).alias(f"_cum_{m}") for m in sums],
        *[F.lag(c).over(w).alias(f"_prev_{c}") for c in lasts],
        *[F.max(m).over(wp).alias(f"_max_{m}") for m in maxes],
    )


def _ranged(df: DataFrame, keys, order, sums, lasts, buckets: int, maxes=()) -> DataFrame:
    ranged = materialize(
        df.repartitionByRange(buckets, *keys, *order).withColumn("_b", F.spark_partition_id())
    )
    w = Window.partitionBy("_b", *keys).orderBy(*order)
    wp = w.rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select(
        "*",
        F.count(F.lit(1)).over(wp).alias("_ln"),
        *[F.sum(m).over(wp).alias(f"_ls_{m}") for m in sums],
        *[F.lag(c).over(w).alias(f"_ll_{c}") for c in lasts],
        *[F.max(m).over(wp).alias(f"_lm_{m}") for m in maxes],
    )
    order_struct = F.struct(*[F.col(c) for c in order])
    tot_aggs = ([F.count(F.lit(1)).alias("_tn")] + [F.sum(m).alias(f"_ts_{m}") for m in sums]
                + [F.max(m).alias(f"_tm_{m}") for m in maxes])
    if lasts:
        tot_aggs.append(F.max_by(F.struct(*[F.col(c).alias(c) for c in lasts]), order_struct).alias("_tl"))
    tot = ranged.groupBy("_b", *keys).agg(*tot_aggs)
    wb = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, -1)
    off_cols = ([F.sum("_tn").over(wb).alias("_on")] + [F.sum(f"_ts_{m}").over(wb).alias(f"_os_{m}") for m in sums]
                + [F.max(f"_tm_{m}").over(wb).alias(f"_om_{m}") for m in maxes])
    if lasts:
        off_cols.append(F.last("_tl", ignorenulls=True).over(wb).alias("_ol"))
    # at most one row per bucket survives: the group that continues from earlier buckets
    off = tot.select("_b", *keys, *off_cols).where(F.col("_on").isNotNull())
    joined = _join_small(local, off, ["_b", *keys])

    def add(a, b):
        return F.when(F.col(a).isNull() & F.col(b).isNull(), F.lit(None)).otherwise(
            F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0)))

    out = joined.select(
        *df.columns,
        (F.col("_ln") + F.coalesce(F.col("_on"), F.lit(0)) + 1).alias("_rn"),
        *[add(f"_ls_{m}", f"_os_{m}").alias(f"_cum_{m}") for m in sums],
        *[F.when(F.col("_ln") > 0, F.col(f"_ll_{c}")).otherwise(F.col(f"_ol.{c}")).alias(f"_prev_{c}")
          for c in lasts],
        *[F.greatest(F.col(f"_lm_{m}"), F.col(f"_om_{m}")).alias(f"_max_{m}") for m in maxes],
    )
    return out


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str] = (),
    lasts: Sequence[str] = (),
    maxes: Sequence[str] = (),
    *,
    strategy: str = "auto",
    max_group_rows: int = DEFAULT_MAX_GROUP_ROWS,
    buckets: int | None = None,
) -> DataFrame:
    """Exact strictly-earlier running count/sums/maxes/previous values per group.

    strategy: ``auto`` (split light/heavy groups), ``ranged`` (all rows through
    the range path) or ``window`` (plain window; only for bounded groups).
    ``order`` must make rows unique inside a group (add the row key).
    """
    keys, order, sums, lasts, maxes = list(keys), list(order), list(sums), list(lasts), list(maxes)
    spark = df.sparkSession
    if buckets is None:
        buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if strategy == "window":
        return _plain(df, keys, order, sums, lasts, maxes)
    if strategy == "ranged":
        return _ranged(df, keys, order, sums, lasts, buckets, maxes)

    # auto: one aggregate decides.  Groups within the per-task row budget use
    # the plain window; larger ones go through the range path, with enough
    # buckets that each holds about one budget of rows.
    def sized(n_rows: int) -> int:
        return max(buckets, -(-n_rows // max_group_rows))

    if keys:
        counts = df.groupBy(*keys).count()
        st = counts.agg(F.sum("count").alias("t"), F.max("count").alias("m")).first()
        total, largest = int(st["t"] or 0), int(st["m"] or 0)
    else:
        counts = None
        total = largest = df.count()
    budget = max_group_rows
    if largest <= budget:
        return _plain(df, keys, order, sums, lasts, maxes)
    if not keys:
        return _ranged(df, keys, order, sums, lasts, sized(total), maxes)
    # at most total / budget rows; up to MAX_HEAVY_KEYS of them are sent to every task, more are joined by shuffle
    heavy = materialize(counts.where(F.col("count") > budget).withColumn("_heavy", F.lit(True)))
    heavy_rows = int(heavy.agg(F.sum("count")).first()[0] or 0)
    tagged = _join_small(df, heavy.drop("count"), keys, total <= budget * MAX_HEAVY_KEYS)
    light_part = tagged.where(F.col("_heavy").isNull()).drop("_heavy")
    heavy_part = tagged.where(F.col("_heavy").isNotNull()).drop("_heavy")
    a = _plain(light_part, keys, order, sums, lasts, maxes)
    b = _ranged(heavy_part, keys, order, sums, lasts, sized(heavy_rows), maxes)
    cols = df.columns + _outputs(sums, lasts, maxes)
    return a.select(*cols).unionByName(b.select(*cols))
