"""Live forms of the jobs: the same results as the batch operators, from streams.

Rows behind the watermark are dropped; stream_runs counts them by video, for the others Spark's progress
has their number (numRowsDroppedByWatermark).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from capspark.functions import columns as C
from capspark.operators import detect, review
from capspark.operators.segment import _diff, _join, _rect
from capspark.params import DEFAULTS, Params
from capspark.sources.ledger import Ledger


def stream_samples(frames: DataFrame, geo: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Sampled frames with their valid boxes and union box; stateless. geo is a static table."""
    return detect.with_union_box(detect.valid_boxes(detect.sample_frames(frames, geo), p))


def stream_sessions(samples: DataFrame, step_sec: float, late: str = "10 seconds") -> DataFrame:
    """Stretches of text on screen: samples (video_id, ts, frame, bbox) no more than a step apart."""
    gap = f"{int(step_sec * 1500)} milliseconds"
    rows = samples.filter("bbox is not null").withWatermark("ts", late)
    out = rows.groupBy("video_id", F.session_window("ts", gap).alias("w")).agg(F.min("frame").alias("first_s"), F.max("frame").alias("last_s"), C.union_box_agg(F.col("bbox")).alias("bbox"))
    return out.select("video_id", "first_s", "last_s", "bbox")


_RUN = f"video_id long, first_s long, last_s long, split_from long, bbox {C.BOX}, late long"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Runs(StatefulProcessor):
    """The fold of one video's samples. Waiting samples are a map by their time, so that a batch writes
    its own rows alone; each time has a timer, and samples are folded when it expires. The open run
    is one small value."""

    def __init__(self, step: int, crop_y: int, tw: int, th: int, idle_ms: int, p: Params):
        self.step, self.grid, self.tw, self.idle_ms, self.p = step, (crop_y, tw, th, p.thumb_scale), tw, idle_ms, p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "frame array<long>, box array<array<int>>, px array<binary>")
        self.run = handle.getValueState("run", "first_s long, last_s long, split_from long, box array<int>, px binary, ms long")

    @staticmethod
    def _out(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["video_id", "first_s", "last_s", "split_from", "bbox", "late"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        mark, late = timerValues.getCurrentWatermarkInMs(), 0
        new: dict[int, tuple[list, list, list]] = {}
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if r.ms <= mark:
                    late += 1
                    continue
                at = new.setdefault(int(r.ms), ([], [], []))
                at[0].append(int(r.frame))
                at[1].append([] if pd.isna(r.x1) else [int(v) for v in (r.x1, r.y1, r.x2, r.y2)])
                at[2].append(r.pixels)
        for ms, at in new.items():
            if self.waiting.containsKey((ms,)):
                at = tuple([*had, *more] for had, more in zip(self.waiting.getValue((ms,)), at, strict=True))
            self.waiting.updateValue((ms,), at)
            self.handle.registerTimer(ms)
        if late:
            yield self._out([(key[0], None, None, None, None, late)])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        had = self.run.get() if self.run.exists() else None
        run = None if had is None else [*had[:3], tuple(had[3]), had[4], had[5]]

        def close() -> None:
            if run is not None:
                out.append((key[0], run[0], run[1], run[2], dict(zip(("x1", "y1", "x2", "y2"), run[3], strict=True)), None))

        ready = []
        if self.waiting.containsKey((now,)):
            ready = sorted(zip(*self.waiting.getValue((now,)), strict=True), key=lambda x: x[0])
            self.waiting.removeKey((now,))
        elif run is not None and run[5] + self.idle_ms <= now:
            close()
            run = None
        pixels = lambda d: np.frombuffer(d, np.uint8)
        for frame, box, px in ready:
            box = tuple(box)
            if run is not None and (not box or frame - run[1] > self.step):
                close()
                run = None
            if not box:
                continue
            if run is None:
                run = [frame, frame, None, box, px, now]
                continue
            both = _join(run[3], box)
            if _diff(pixels(run[4]), pixels(px), self.tw, _rect(both, *self.grid)) < self.p.same_thresh:
                run[1], run[3:] = frame, [both, px, now]
            else:
                close()
                run = [frame, frame, run[1], box, px, now]
        if run is None:
            self.run.clear()
        else:
            self.run.update((*run[:3], list(run[3]), run[4], run[5]))
            if run[5] == now:
                self.handle.registerTimer(now + self.idle_ms)
        if out:
            yield self._out(out)


def stream_runs(samples: DataFrame, step: int, crop_y: int, tw: int, th: int, late: str = "10 seconds", idle_ms: int = 60_000, p: Params = DEFAULTS) -> DataFrame:
    """Runs of one picture with the batch fold: samples (video_id, ts, frame, x1, y1, x2, y2 or null,
    pixels). Rows wait until the watermark has passed them and are then folded in order of time;
    idle_ms of event time without a row ends the last run. A row behind the watermark is counted in
    its video: it gives a row whose late is the number of such rows of a batch, all else null. See
    closed_runs and late_rows. Needs Spark's RocksDB state store, which this sets for the session."""
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    # Without the event-time column Spark keeps late rows, so that they can be counted.
    rows = samples.withWatermark("ts", late).select("video_id", F.unix_millis("ts").alias("ms"), "frame", "x1", "y1", "x2", "y2", "pixels")
    return rows.groupBy("video_id").transformWithStateInPandas(_Runs(step, crop_y, tw, th, idle_ms, p), _RUN, "append", "EventTime")


def closed_runs(out: DataFrame) -> DataFrame:
    """The runs that stream_runs has given."""
    return out.filter("late is null").drop("late")


def late_rows(out: DataFrame) -> DataFrame:
    """video_id, late: how many rows of each video came behind the watermark."""
    return out.filter("late is not null").groupBy("video_id").agg(F.sum("late").alias("late"))


def stream_dedupe_jobs(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first request (job_key, ts) of each job within the watermark."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_key"])


_TEXT = "video_id long, event_id long, zh string"


class Upserts:
    """Translations that a stream brings (video_id, event_id, zh, version), kept in a ledger.

    A micro-batch is stored first and committed with its number afterwards. A number that is
    committed already, because the stream has died after that, is skipped when it comes again; one
    that was stored only is stored anew, and its older part is never read. So each batch counts
    once, whenever the stream breaks and goes on from its checkpoint.
    """

    def __init__(self, ledger: Ledger):
        self.ledger = ledger

    def _versions(self) -> tuple[int, dict[int, int]]:
        """The batch up to which all is in one part (-1: none such), and the parts to read by batch."""
        rows = self.ledger.manifest().select("stage", "version").collect()  # a row for each batch since the last compaction
        bases = {int(s.split()[1]): v for s, v in rows if s.startswith("upto ")}
        base = max(bases, default=-1)
        parts = {int(s.split()[1]): v for s, v in rows if s.startswith("batch ")}
        return base, {k: v for k, v in parts.items() if k > base} | ({base: bases[base]} if bases else {})

    def table(self) -> DataFrame:
        """video_id, event_id, zh: the newest of each; a later batch goes over an earlier one."""
        _, parts = self._versions()
        order = F.create_map(*[F.lit(x) for k, v in parts.items() for x in (v, k)])[F.col("version")] if parts else F.lit(0)
        rows = self.ledger.parts("upserts", list(parts.values()), _TEXT)
        return rows.groupBy("video_id", "event_id").agg(F.max(F.struct(order.alias("k"), "zh")).alias("m")).select("video_id", "event_id", F.col("m.zh").alias("zh"))

    def _store(self, rows: DataFrame, stage: str) -> None:
        version = self.ledger.new_version()
        self.ledger.put("upserts", rows, version)
        self.ledger.commit(stage, version, rows.sparkSession.createDataFrame([(None,)], "video_id long"))

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        base, parts = self._versions()
        if batch_id <= base or batch_id in parts:
            return
        newest = batch.groupBy("video_id", "event_id").agg(F.max(F.struct("version", "zh")).alias("m"))
        self._store(newest.select("video_id", "event_id", F.col("m.zh").alias("zh")), f"batch {batch_id}")

    def compact(self) -> None:
        """All committed batches as one part; they are read no more."""
        _, parts = self._versions()
        if parts:
            self._store(self.table(), f"upto {max(parts)}")


def stream_upserts(updates: DataFrame, ledger: Ledger, checkpoint: str):
    """A query, not yet started, that keeps updates (video_id, event_id, zh, version) in the ledger."""
    return updates.writeStream.foreachBatch(Upserts(ledger).add).option("checkpointLocation", checkpoint)


def stream_status(status: DataFrame) -> DataFrame:
    """The newest status of each video, with the seconds it may still take where the rows say how
    long it has run (elapsed); for update or complete mode."""
    return review.latest_with_eta(status) if "elapsed" in status.columns else review.latest_status(status)


def stream_throughput(frames: DataFrame, window: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Frames done (video_id, ts) in each window of time."""
    rows = frames.withWatermark("ts", late).groupBy("video_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("frames"))
    return rows.select("video_id", F.col("w.start").alias("since"), "frames")
