"""Streams that break and go on, late rows, and order proved from written files."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile
import textwrap

import pytest
from pyspark.sql import functions as F

from capspark.sources import ingest
from capspark.sources.ledger import Ledger
from capspark.streaming import live

TEXT = "video_id long, event_id long, zh string, version long"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.mark.parametrize("when", ["before the commit", "after the commit"])
def test_upserts_count_once_when_the_stream_breaks(spark, monkeypatch, when):
    path = folder()
    batches = [[(1, 1, "old", 1), (2, 1, "x", 1)], [(1, 1, "mid", 2), (1, 1, "new", 3), (3, 1, "y", 1)], [(2, 1, "late", 1), (4, 4, None, 1)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, TEXT).coalesce(1).write.mode("append").parquet(f"{path}/in/{i}")
    source = lambda: spark.readStream.schema(TEXT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    for i in range(3):  # files are taken in the order of their age
        for name in os.listdir(f"{path}/in/{i}"):
            os.utime(f"{path}/in/{i}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    ledger = Ledger(spark, f"{path}/ledger")
    run = lambda: live.stream_upserts(source(), ledger, f"{path}/c").trigger(availableNow=True).start().awaitTermination(120)
    commit = Ledger.commit

    def breaks(self, stage, *more):
        if stage == "batch 1":
            if when == "after the commit":
                commit(self, stage, *more)
            raise RuntimeError("lost")
        commit(self, stage, *more)

    monkeypatch.setattr(Ledger, "commit", breaks)
    with pytest.raises(Exception, match="lost"):
        run()
    upserts = live.Upserts(ledger)
    got = lambda: sorted(tuple(r) for r in upserts.table().collect())
    first = [(1, 1, "old"), (2, 1, "x")]
    assert got() == (first if when == "before the commit" else [(1, 1, "new"), (2, 1, "x"), (3, 1, "y")])
    monkeypatch.setattr(Ledger, "commit", commit)
    run()
    want = [(1, 1, "new"), (2, 1, "late"), (3, 1, "y"), (4, 4, None)]
    assert got() == want
    assert sorted(r["stage"] for r in ledger.manifest().collect()) == ["batch 0", "batch 1", "batch 2"]
    upserts.compact()
    upserts.add(spark.createDataFrame([(1, 1, "again", 9)], TEXT), 2)  # a number from before comes again
    assert got() == want
    upserts.add(spark.createDataFrame([(1, 1, "fourth", 0)], TEXT), 3)
    assert got() == [(1, 1, "fourth"), *want[1:]]
    assert live.Upserts(Ledger(spark, f"{path}/none")).table().count() == 0


def test_order_is_read_back_from_the_files(spark):
    path = folder()
    frames = spark.createDataFrame([(v, f, 1, 1, b"abc") for v in (1, 2) for f in range(500)], "video_id long, frame long, h int, w int, pixels binary").repartition(5)
    ingest.ordered_frames(frames, 5).write.parquet(f"{path}/good")
    got = {r["video_id"]: r for r in ingest.files_audit(ingest.frame_files(spark, f"{path}/good")).collect()}
    assert all((r["n"], r["first_frame"], r["last_frame"], r["gaps"], r["repeats"], r["in_order"]) == (500, 0, 499, 0, 0, True) for r in got.values()) and len(got) == 2
    assert max(r["n_files"] for r in got.values()) > 1
    ingest.ordered_frames(frames.filter("frame not in (7, 250) or video_id = 2")).write.parquet(f"{path}/gaps")
    frames.sortWithinPartitions(F.desc("frame")).write.parquet(f"{path}/back")
    ingest.ordered_frames(frames.unionByName(frames.filter("frame = 300"))).write.parquet(f"{path}/twice")
    audit = lambda name: {r["video_id"]: (r["gaps"], r["repeats"], r["in_order"]) for r in ingest.files_audit(ingest.frame_files(spark, f"{path}/{name}")).collect()}
    assert audit("gaps") == {1: (2, 0, True), 2: (0, 0, True)}
    assert audit("twice") == {1: (0, 1, True), 2: (0, 1, True)}
    assert not any(ok for *_, ok in audit("back").values())


def test_a_retried_task_writes_its_frames_once():
    path = folder()
    script = f"""
    import pandas as pd
    from pyspark import TaskContext
    from pyspark.sql import SparkSession
    from capspark.sources import ingest
    s = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.local.dir", "{path}").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    def broken(batches):
        for pdf in batches:
            for k in range(0, len(pdf), 10):
                if k > 30 and TaskContext.get().attemptNumber() == 0:
                    raise RuntimeError("lost")
                yield pdf.iloc[k : k + 10]
    rows = s.range(300).selectExpr("cast(1 as bigint) as video_id", "id as frame")
    ingest.ordered_frames(rows).mapInPandas(broken, rows.schema).write.parquet("{path}/out")
    print([tuple(r) for r in ingest.files_audit(ingest.frame_files(s, "{path}/out")).drop("n_files").collect()])
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], capture_output=True, text=True, timeout=180, check=False)
    assert "[(1, 300, 0, 299, 0, 0, True)]" in done.stdout and "RuntimeError: lost" in done.stderr, done.stderr[-2000:]


SAMPLE = "video_id long, ts timestamp, frame long, x1 int, y1 int, x2 int, y2 int, pixels binary"


def files_in_order(spark, path, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(v, f, *(b or (None,) * 4), bytes([level] * 16)) for v, f, b, level in rows], "video_id long, frame long, x1 int, y1 int, x2 int, y2 int, pixels binary")
        df = df.select("video_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame") * F.lit(0.1)).alias("ts"), "frame", "x1", "y1", "x2", "y2", "pixels")
        df.coalesce(1).write.mode("append").parquet(f"{path}/in/{i}")
        for name in os.listdir(f"{path}/in/{i}"):
            os.utime(f"{path}/in/{i}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    return lambda: spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")


def test_late_rows_are_counted_by_video_and_a_restart_loses_nothing(spark):
    box, path = (0, 0, 16, 16), folder()
    batches = [
        [(1, 0, box, 50), (1, 6, box, 50), (2, 0, box, 90)],
        [(1, 3, box, 50), (1, 400, None, 0)],  # out of order, but in time
        [(1, 9, box, 50), (2, 3, box, 90), (2, 6, box, 90), (1, 403, box, 70)],  # three are late
        [(1, 406, box, 200), (1, 12, None, 0), (2, 900, box, 10)],  # one more
        [(7, 9000, None, 0)],
        [(7, 9001, None, 0)],
    ]
    source = files_in_order(spark, path, batches)

    def run(limit=None):
        out = live.stream_runs(source(), 3, 0, 4, 4, "20 seconds", idle_ms=5000)
        q = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
        q.awaitTermination(180)

    for name in ("4", "5"):  # the stream ends, and goes on when these files come
        os.rename(f"{path}/in/{name}", f"{path}/{name}")
    run()
    for name in ("4", "5"):
        os.rename(f"{path}/{name}", f"{path}/in/{name}")
    run()
    out = spark.read.parquet(f"{path}/out")
    assert sorted(tuple(r) for r in live.late_rows(out).collect()) == [(1, 2), (2, 2)]
    got = sorted((r["video_id"], r["first_s"], r["last_s"], r["split_from"]) for r in live.closed_runs(out).collect())
    assert got == [(1, 0, 6, None), (1, 403, 403, None), (1, 406, 406, 403), (2, 0, 0, None), (2, 900, 900, None)]
