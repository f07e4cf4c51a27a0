"""Streams with several files, late and out-of-order events, a replayed batch, a restart and no file at all."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from obol.streaming import jobs

SCHEMA = "event_id long, user_id long, event_type string, ts timestamp_ntz"
START = datetime.datetime(2024, 1, 1)


def _write(spark, folder, name, rows, when):
    """One Parquet file; ``when`` orders the files of the stream."""
    os.makedirs(folder, exist_ok=True)
    tmp = f"{folder}-tmp-{name}"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(tmp)
    part = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
    path = f"{folder}/{name}.parquet"
    os.link(f"{tmp}/{part}", path)
    os.utime(path, (when, when))


def _events(rng, first_hour, last_hour, n, start_id):
    return [(start_id + i, rng.randint(1, 5), rng.choice(["error", "error", "view"]),
             START + datetime.timedelta(hours=rng.uniform(first_hour, last_hour))) for i in range(n)]


def _stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def _batch(rows):
    out = {}
    for _, user, kind, ts in rows:
        if kind == "error":
            at = (user, int((ts - START).total_seconds() // (90 * 3600)))
            out[at] = out.get(at, 0) + 1
    return out


def _counts(counts):
    return {(r["user_id"], r["period"]): r["n"] for r in counts.collect()}


@pytest.fixture()
def files(spark, tmp_path):
    rng = random.Random(3)
    folder = str(tmp_path / "in")
    # the second file is far ahead, the third brings old events again (late), the fourth is out of order within the delay
    parts = [_events(rng, 0, 80, 60, 0), _events(rng, 350, 500, 60, 100), _events(rng, 0, 500, 80, 200), _events(rng, 420, 520, 40, 300)]
    for i, p in enumerate(parts):
        _write(spark, folder, f"f{i}", p, 1_700_000_000 + 60 * i)
    return folder, parts


def _late(parts, delay=96):
    """Events whose window ended before the watermark of the files before."""
    out, latest = [], None
    for p in parts:
        errors = [r for r in p if r[2] == "error"]
        for r in errors:
            end = ((r[3] - START).total_seconds() // (90 * 3600) + 1) * 90
            if latest is not None and end * 3600 <= latest - delay * 3600:
                out.append(r[0])
        latest = max([latest or 0] + [(r[3] - START).total_seconds() for r in errors])
    return sorted(out)


def test_late_events_go_to_the_side_table(spark, files, tmp_path):
    folder, parts = files
    counts, late = jobs.overdue_counts_with_late(_stream(spark, folder), str(tmp_path / "work"))
    gone = sorted(r["event_id"] for r in late.collect())
    assert gone == _late(parts) and len(gone) > 5
    rows = [r for p in parts for r in p]
    assert _counts(counts) == _batch([r for r in rows if r[0] not in set(gone)])
    # counts and side table together are the batch result
    both = counts.unionByName(late.groupBy("user_id", "period").agg(F.count("*").alias("n"))).groupBy("user_id", "period").agg(F.sum("n").alias("n"))
    assert _counts(both) == _batch(rows)
    wide = {r["user_id"]: [r[f"o{i}"] for i in range(8)] for r in jobs.overdue_series(counts).collect()}
    assert sum(map(sum, wide.values())) == sum(n for (_, p), n in _counts(counts).items() if 0 <= p < 8)


def test_restart_takes_new_files_only_and_a_replay_changes_nothing(spark, files, tmp_path):
    folder, parts = files
    work = str(tmp_path / "work")
    counts, late = jobs.overdue_counts_with_late(_stream(spark, folder), work)
    one, lost = _counts(counts), sorted(r["event_id"] for r in late.collect())
    # the last batch is replayed: its commit is taken back, as if the run had broken off before it
    commits = sorted(f for f in os.listdir(f"{work}/checkpoint/commits") if f.isdigit())
    assert len(commits) == 4
    for f in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(f"{work}/checkpoint/commits/{f}"):
            os.rename(f"{work}/checkpoint/commits/{f}", f"{tmp_path}/taken{f}")
    counts, late = jobs.overdue_counts_with_late(_stream(spark, folder), work)
    assert _counts(counts) == one and sorted(r["event_id"] for r in late.collect()) == lost
    more = _events(random.Random(9), 430, 600, 30, 400)
    _write(spark, folder, "f9", more, 1_700_001_000)
    counts, late = jobs.overdue_counts_with_late(_stream(spark, folder), work)
    gone = {r["event_id"] for r in late.collect()}
    assert gone == set(_late([*parts, more]))
    assert _counts(counts) == _batch([r for p in [*parts, more] for r in p if r[0] not in gone])


def test_empty_streams(spark, tmp_path):
    folder = str(tmp_path / "none")
    os.makedirs(folder)
    counts, late = jobs.overdue_counts_with_late(_stream(spark, folder), str(tmp_path / "work"))
    assert counts.count() == 0 and late.count() == 0 and jobs.overdue_series(counts).count() == 0
    out = jobs.run_to_table(jobs.overdue_period_counts(_stream(spark, folder)), "nothing", mode="update")
    assert jobs.overdue_series_from_counts(spark.read.parquet(out)).count() == 0


def test_run_to_table_goes_on_from_its_checkpoint(spark, files, tmp_path):
    folder, parts = files
    work = str(tmp_path / "scored")
    for _ in range(2):  # the second run finds nothing new
        out = jobs.run_to_table(_stream(spark, folder).where("event_type = 'view'"), "views", work=work)
    ids = sorted(r["event_id"] for r in spark.read.parquet(out).collect())
    assert ids == sorted(r[0] for p in parts for r in p if r[2] == "view")
