"""All stages of many videos as one job that goes on where it has stopped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capspark.operators import detect, frame_index, reads, render, review
from capspark.params import DEFAULTS, STAGES, Params
from capspark.plans import workloads
from capspark.sources import ingest
from capspark.sources.ledger import Ledger


@dataclass(frozen=True)
class Models:
    """What the user brings: each makes its model once for a task, width and draw are plain functions."""

    detector: Callable
    reader: Callable
    translator: Callable
    names: Callable
    width: Callable
    draw: Callable


class Job:
    """The stages in their order, each over the videos whose next stage it is. A stage's tables are
    written first and committed for its videos afterwards (see Ledger): whatever breaks in between
    leaves the older result, and the next run starts at the first stage that is not committed. A
    stage that has run again makes the later ones run again.

    probe_raw: video_id, json; frames: PIXELS, best from ingest.write_frames; root: a shared folder.
    """

    def __init__(self, frames: DataFrame, probe_raw: DataFrame, root: str, models: Models, quality: bool = False, mode: str = "replace", p: Params = DEFAULTS):
        self.frames, self.probe_raw, self.root, self.models = frames, probe_raw, root.rstrip("/"), models
        self.quality, self.mode, self.p = quality, mode, p
        self.spark = frames.sparkSession
        self.ledger = Ledger(self.spark, root, dict(frames.dtypes)["video_id"])

    def next_stages(self) -> DataFrame:
        """video_id, stage: where each video goes on; null where all is done."""
        return review.next_stage(self.probe_raw, self.ledger.valid(STAGES))

    def table(self, name: str, stage: str) -> DataFrame:
        """What is committed of a stage's table, for the videos of which it is up to date."""
        return self.ledger.read(name, self.ledger.valid(STAGES).filter(F.col("stage") == stage))

    def run(self, until: str = STAGES[-1]) -> None:
        for stage in STAGES[: STAGES.index(until) + 1]:
            version = self.ledger.new_version()
            due = self.next_stages().filter(F.col("stage") == stage).select("video_id")
            due = self.ledger.put("due", due, version)  # fixed while the stage runs
            if not due.isEmpty():
                getattr(self, stage)(due, version)
                self.ledger.commit(stage, version, due)

    def _of(self, name: str, stage: str, due: DataFrame) -> DataFrame:
        return self.table(name, stage).join(due, "video_id", "left_semi")

    def probe(self, due: DataFrame, version: int) -> None:
        """A record with an error is kept with it; its video has no frames in the later stages."""
        self.ledger.put("videos", ingest.parse_probe(self.probe_raw.join(due, "video_id", "left_semi")), version)

    def _videos(self, due: DataFrame) -> DataFrame:
        return self._of("videos", "probe", due).filter("error is null")

    def detect(self, due: DataFrame, version: int) -> None:
        """Counts the frames that are there, which go before the probe's number."""
        geo = detect.geometry(self._videos(due).drop("n_frames"), self.p)
        frames = frame_index.frames_of(self.frames, due)
        counted = frames.groupBy("video_id").agg((F.max("frame") + 1).alias("n_frames"))
        geo = self.ledger.put("geo", geo.join(counted, "video_id"), version)
        self.ledger.put("samples", detect.detect_text(detect.sample_frames(frames, geo), self.models.detector, self.p), version)
        self.ledger.put("thumbs", detect.thumbnails(frames, geo), version)

    def events(self, due: DataFrame, version: int) -> None:
        samples, thumbs, geo = (self._of(t, "detect", due) for t in ("samples", "thumbs", "geo"))
        self.ledger.put("events", workloads.samples_to_events(samples.select("video_id", "frame", "boxes"), thumbs, geo, self.p), version)

    def ocr(self, due: DataFrame, version: int) -> None:
        best = self.ledger.put("reads", workloads.best_reads(self._of("events", "events", due), self.frames, self.models.reader, self.p), version)
        styles = self.ledger.put("styles", reads.with_mask_keys(reads.text_style(best, self.frames)), version)
        self.ledger.put("glyph_masks", reads.mask_table(styles), version)
        self.ledger.put("subtitles", workloads.subtitles(best, styles, self.p), version)

    def translate(self, due: DataFrame, version: int) -> None:
        """Its rounds have a ledger of their own, named by the subtitles that they are of, so a run that
        breaks in the middle goes on with them."""
        of = self.ledger.valid(STAGES).filter("stage = 'ocr'").join(due, "video_id", "left_semi").agg(F.hex(F.bit_xor(F.xxhash64("video_id", "version")))).head()[0]
        rounds = Ledger(self.spark, f"{self.root}/rounds-{of}", dict(self.frames.dtypes)["video_id"])
        subs = self._of("subtitles", "ocr", due)
        done = subs.limit(0).select("video_id", "event_id", F.lit("").alias("zh"))
        self.ledger.put("translations", workloads.subtitles_to_translations(subs, done, self.models.translator, self.models.names, rounds, self.p), version)

    def render(self, due: DataFrame, version: int) -> None:
        videos = self._videos(due).select("video_id", "width", "height")
        subs = self._of("subtitles", "ocr", due).join(videos, "video_id")
        over = workloads.overlays(subs, self._of("translations", "translate", due), self.models.width, self.models.draw, self.mode, self.p)
        n = self._of("geo", "detect", due).select("video_id", "n_frames")
        plans = render.overlay_plans(subs, self._of("glyph_masks", "ocr", due), over, self.mode)
        plans = self.ledger.put("plans", plans, version)
        backs = self.ledger.put("backgrounds", render.backgrounds(render.clean_frames(subs, n, self.p), plans, self.frames, self.quality, p=self.p), version)
        frames = frame_index.frames_of(self.frames, due)
        out = render.composite(frames, subs, plans.join(backs, ["video_id", "event_id"], "left"), p=self.p)
        self.ledger.put("output", out, version)

    def review(self) -> DataFrame:
        """The review table of all videos that are translated."""
        return review.review_table(self.table("subtitles", "ocr"), self.table("translations", "translate"), self.table("videos", "probe"))
