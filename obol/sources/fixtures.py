"""Stand-in inputs built from the driver tables (FIXTURES.md F1-F3).

These only produce rows in the schema the operators expect; they do none of
the operators' work.  The mapping rules are the ones FIXTURES.md fixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a source that has fewer splits than the cluster has cores
    (a single-row-group file is one task).  Large inputs already arrive in
    many splits and are left as they are, so this never adds a shuffle at
    scale."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def _i(x: int):
    return F.lit(x).cast("bigint")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order line counts feeding the overdue columns (one partial-aggregated groupBy)."""
    li = read_table(spark, sf_dir, "lineitem")

    def cnt(cond):
        return F.count(F.when(cond, 1))

    return li.groupBy("l_orderkey").agg(
        *[cnt((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == i + 1)).alias(f"o{i}") for i in range(7)],
        cnt((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 40)).alias("o7"),
        F.count(F.lit(1)).alias("items"),
    )


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1: one row per order, the canonical loan schema."""
    return loans_from(read_table(spark, sf_dir, "orders"), order_lines(spark, sf_dir),
                      read_table(spark, sf_dir, "customer"))


def loans_from(orders: DataFrame, per: DataFrame, cust: DataFrame) -> DataFrame:
    """F1 mapping over given orders (batch or stream), per-order lines and customers."""
    base = (
        orders.join(cust, orders.o_custkey == cust.c_custkey)
        .join(per, per.l_orderkey == orders.o_orderkey, "left")
        .select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
            "c_acctbal", "c_mktsegment", "c_nationkey",
            *[F.coalesce(F.col(c), _i(0)).alias(c) for c in C.OVERDUE_COLS + ["items"]],
        )
        .withColumn("tot", sum(F.col(c) for c in C.OVERDUE_COLS))
        .withColumn("sal", _i(20000) + (F.col("o_custkey") * 37) % 60000)
    )
    k = F.col("o_orderkey")
    status = (
        F.when((F.col("tot") >= 2) & (F.col("o_orderstatus") == "P"), F.concat(F.lit("M"), (1 + k % 3).cast("string")))
        .when((F.col("o_totalprice") > 400000) & (F.col("o_orderstatus") == "F"), F.lit("M1"))
        .when(k % 50 == 0, F.lit("M1-1"))
        .when(F.col("o_orderstatus") == "F", F.lit("M0"))
        .otherwise(F.lit("Current"))
    )
    residence = (
        F.when(k % 5 == 0, "owned").when(k % 5 == 1, "rented").when(k % 5 == 2, "spouse")
        .when(k % 5 == 3, "family").otherwise("dormitory")
    )
    late_gt_early = (F.col("o5") + F.col("o6") + F.col("o7")) > (F.col("o0") + F.col("o1") + F.col("o2") + F.col("o3"))
    sal = F.col("sal")
    return base.select(
        k.alias("serial_number"),
        F.col("o_custkey").alias("id"),
        F.col("o_orderdate").cast("date").alias("application_date"),
        status.alias("overdue_status"),
        (F.col("tot") * 15.0).alias("overdue_days"),
        F.when(k % 97 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("education"),
        F.when(k % 89 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("main_business"),
        residence.alias("residence_status"),
        F.concat(F.lit("P"), (F.col("o_custkey") % 6).cast("string")).alias("product"),
        F.when(F.col("c_acctbal") < 0, F.lit("n/a")).otherwise(sal.cast("string")).alias("salary_raw"),
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast("double")).otherwise(sal * 1.0).alias("month_salary"),
        ((F.col("o_custkey") % 13) / 2.0).alias("job_tenure"),
        (10000 + F.col("c_nationkey") * 300).cast("string").alias("post_perm"),
        (10000 + F.col("c_nationkey") * 300 + (k % 7) * 10).cast("string").alias("post_res"),
        F.when(k % 401 == 0, _i(0)).otherwise(12 + 6 * (k % 5)).cast("bigint").alias("loan_term"),
        (F.col("items") * 3).cast("bigint").alias("paid_installments"),
        (F.col("o_totalprice") / (sal * 12.0)).alias("debt_to_income_ratio"),
        (F.col("o_totalprice") / 48.0 / sal).alias("payment_to_income_ratio"),
        *[F.col(c).cast("bigint").alias(c) for c in C.OVERDUE_COLS],
        F.least(F.lit(0.98), F.lit(0.05) + F.lit(0.12) * F.col("tot") + F.lit(0.10) * late_gt_early.cast("int")).alias("score_p"),
    )


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per customer in the second (synthetic clients) schema."""
    cust = read_table(spark, sf_dir, "customer")
    orders = read_table(spark, sf_dir, "orders")
    stats = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0), 1)).alias("bad"),
        F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("urg"),
    )
    j = cust.join(stats, cust.c_custkey == stats.o_custkey, "left")
    k = F.col("c_custkey")
    bad = F.coalesce(F.col("bad"), _i(0))
    return j.select(
        k.alias("customer_id"),
        (16 + (k * 7) % 65).alias("age"),
        F.col("c_mktsegment").alias("job_category"),
        (1 + F.col("c_nationkey") % 5).cast("int").alias("education_level"),
        (1 + k % 6).cast("int").alias("employment_status"),
        ((12000 + (k * 911) % 120000) * 1.0).alias("annual_income"),
        ((5000 + (k * 3571) % 90000) * 1.0).alias("loan_amount"),
        (12 * (1 + k % 5)).alias("loan_term_months"),
        ((k * 13) % 120).alias("credit_history_months"),
        F.coalesce(F.col("n"), _i(0)).alias("previous_loans_count"),
        ((1000 + (k * 257) % 50000) * 1.0).alias("total_credit_limit"),
        F.coalesce(F.col("urg"), _i(0)).alias("late_payments_count"),
        (bad % 4).alias("missed_payments_count"),
        (1.0 - ((k * 3) % 40) / 100.0).alias("on_time_payment_rate"),
        (((k * 11) % 100) / 100.0).alias("credit_utilization_rate"),
        (((k * 17) % 50) / 100.0).alias("savings_to_income_ratio"),
        (((k * 29) % 80) / 100.0).alias("debt_to_income_ratio"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("avg_monthly_balance"),
        (1 + k % 12).alias("loan_origination_month"),
        F.when(bad >= 3, 1).otherwise(0).cast("int").alias("is_default"),
    ).withColumn("monthly_income", F.col("annual_income") / 12.0)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the event table as is."""
    return read_table(spark, sf_dir, "events")
