"""Structured Streaming re-aims.

ST1: loans arrive as a stream of orders; a stream-static join attaches the
static per-order and per-client attributes, and every micro-batch is scored
with the batch projections (R1-R7).  ST2: error events are counted per user
and fixed 3.75-day period with an event-time watermark and tumbling windows;
the counts feed the overdue-series features (§2.3).

Sinks are ``foreachBatch`` appends into folders under the shared checkpoint
directory, with the query's checkpoint location there too (offsets and
state live on shared storage, not on an executor).  Each run uses a fresh
folder; ``availableNow`` drains what is present and stops.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import cleaning, features, scoring
from ..session import ensure_checkpoint_dir, materialize

PERIOD_HOURS = 90          # 3.75 days
PERIODS = 8
SERIES_START = "2024-01-01 00:00:00"


def _work_dir(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/obol-stream/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int = 256) -> DataFrame:
    """A file stream over one driver table (schema fixed up front)."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", max_files).parquet(sf_dir))


def run_to_table(stream: DataFrame, name: str, mode: str = "append", work: str | None = None) -> str:
    """Run a streaming frame to completion through ``foreachBatch``, a folder per batch;
    returns the output folder.  With a ``work`` folder of an earlier run the
    query goes on from that run's checkpoint.  A stream without any batch
    leaves an empty table."""
    spark = stream.sparkSession
    out, ckpt = (f"{work}/out", f"{work}/checkpoint") if work else (_work_dir(spark, name), _work_dir(spark, f"{name}-ckpt"))
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{out}/_batch_id=-1")

    def sink(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{out}/_batch_id={batch_id}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


# ------------------------------------------------------------------ ST1
def stream_scoring(spark: SparkSession, sf_dir: str, threshold: DataFrame) -> DataFrame:
    """ST1: stream of orders -> stream-static joins -> loan schema -> label ->
    features -> scores; returns the scored rows read back from the sink."""
    from ..sources import fixtures as fx
    orders = stream_table(spark, sf_dir, "orders")
    lines = materialize(fx.order_lines(spark, sf_dir))  # aggregated once, not once a batch
    loans = fx.loans_from(orders, lines, fx.read_table(spark, sf_dir, "customer"))
    l = cleaning.with_label(loans)
    l = features.overdue_features(cleaning.fill_zero(l))
    scored = scoring.score(l, threshold, prob="score_p")
    out = run_to_table(scored, "scored")
    return spark.read.parquet(out).drop("_batch_id")


# ------------------------------------------------------------------ ST2
def overdue_period_counts(events: DataFrame, event_type: str = "error", watermark: str = "4 days") -> DataFrame:
    """ST2 (streaming part): per user and 90-hour tumbling window aligned to
    the series start, the number of ``event_type`` events."""
    # window start offset so that windows begin at SERIES_START: hours since the epoch mod 90
    start = datetime.datetime.fromisoformat(SERIES_START)
    offset = int((start - datetime.datetime(1970, 1, 1)).total_seconds() // 3600) % PERIOD_HOURS
    # event time: the wall-clock ``timestamp_ntz`` read as UTC, independent of the session time zone
    tz = events.sparkSession.conf.get("spark.sql.session.timeZone")
    ev = (events.where(F.col("event_type") == event_type)
          .withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), tz))
          .withWatermark("ts", watermark))
    return ev.groupBy("user_id", F.window("ts", f"{PERIOD_HOURS} hours", f"{PERIOD_HOURS} hours",
                                          f"{offset} hours")).agg(F.count(F.lit(1)).alias("n"))


def event_windows(events: DataFrame, event_type: str) -> DataFrame:
    """Events of one type with their event time in UTC and the start of their 90-hour window from the series start."""
    start = int(datetime.datetime.fromisoformat(SERIES_START).replace(tzinfo=datetime.timezone.utc).timestamp())
    tz = events.sparkSession.conf.get("spark.sql.session.timeZone")
    e = events.where(F.col("event_type") == event_type).withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), tz))
    period = F.floor((F.unix_timestamp("ts") - F.lit(start)) / (PERIOD_HOURS * 3600))
    return e.withColumn("period", period.cast("int")).withColumn("_end", F.lit(start) + (F.col("period") + 1) * (PERIOD_HOURS * 3600))


def overdue_counts_with_late(events: DataFrame, work: str, event_type: str = "error", delay_hours: int = 96) -> tuple[DataFrame, DataFrame]:
    """ST2 with a side output: (user_id, period, n) of events in time, and the late events that no count holds.

    State is a table: every batch writes its own folder with its counts per
    (user, period), its late events and its latest event time.  As in Spark's
    windowed aggregation, an event is late if its window ended at or before the
    watermark, the latest time of earlier batches less the delay.  A batch that
    is replayed reads the same earlier batches and overwrites its own folders;
    a run that broke off goes on from the checkpoint in ``work``.  The counts
    of all batches are added when they are read.
    """
    spark = events.sparkSession
    ready = event_windows(events, event_type)
    plain = ready.drop("_end").schema
    spark.createDataFrame([], "user_id long, period int, n long").write.mode("ignore").parquet(f"{work}/counts/_batch_id=-1")
    spark.createDataFrame([], plain).write.mode("ignore").parquet(f"{work}/late/_batch_id=-1")
    spark.createDataFrame([], "latest double").write.mode("ignore").parquet(f"{work}/times/_batch_id=-1")

    def sink(batch: DataFrame, batch_id: int) -> None:
        times = spark.read.schema("latest double, _batch_id long").parquet(f"{work}/times").where(F.col("_batch_id") < batch_id)
        latest = times.agg(F.max("latest")).first()[0]  # one number
        line = float("-inf") if latest is None else latest - delay_hours * 3600.0
        late = F.col("_end") <= F.lit(line)
        batch.where(~late).groupBy(F.col("user_id").cast("long").alias("user_id"), "period").agg(F.count(F.lit(1)).alias("n")) \
            .write.mode("overwrite").parquet(f"{work}/counts/_batch_id={batch_id}")
        batch.where(late).drop("_end").write.mode("overwrite").parquet(f"{work}/late/_batch_id={batch_id}")
        batch.agg(F.max(F.col("ts").cast("double")).alias("latest")).write.mode("overwrite").parquet(f"{work}/times/_batch_id={batch_id}")

    q = ready.writeStream.foreachBatch(sink).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    counts = spark.read.parquet(f"{work}/counts").groupBy("user_id", "period").agg(F.sum("n").alias("n"))
    return counts, spark.read.schema(plain).parquet(f"{work}/late")


def overdue_series(counts: DataFrame) -> DataFrame:
    """(user_id, period, n) -> o0..o7 wide row per user."""
    wide = counts.where((F.col("period") >= 0) & (F.col("period") < PERIODS)).groupBy("user_id").pivot("period", list(range(PERIODS))).agg(F.sum("n"))
    return wide.select("user_id", *[F.coalesce(F.col(str(i)), F.lit(0)).cast("bigint").alias(f"o{i}") for i in range(PERIODS)])


def overdue_series_from_counts(counts: DataFrame) -> DataFrame:
    """Latest count per (user, window) -> period index -> o0..o7 wide row."""
    latest = counts.groupBy("user_id", "window").agg(F.max("n").alias("n"))  # counts only grow in update mode
    start = datetime.datetime.fromisoformat(SERIES_START).replace(tzinfo=datetime.timezone.utc).timestamp()
    period = F.floor((F.unix_timestamp(F.col("window.start")) - F.lit(int(start))) / (PERIOD_HOURS * 3600)).cast("int")
    return overdue_series(latest.withColumn("period", period))


def stream_overdue_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: event stream -> watermark + tumbling windows -> overdue series ->
    overdue-pattern features per user."""
    ev = stream_table(spark, sf_dir, "events")
    out = run_to_table(overdue_period_counts(ev), "overdue-counts", mode="update")
    series = overdue_series_from_counts(spark.read.parquet(out))
    return features.overdue_features(series)
