"""From frames to samples with text boxes, and thumbnails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capspark.functions import columns as C
from capspark.functions import pixels
from capspark.params import DEFAULTS, Params


def geometry(videos: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """videos (width, height, fps) with crop_h, crop_y, half size, thumbnail size and step."""
    crop_h = (F.floor(F.floor(F.col("height") * p.crop_ratio) / 2) * 2).cast("int")
    half = lambda c: F.floor(c / p.det_scale).cast("int")
    cells = lambda c: F.floor(c / p.thumb_scale).cast("int")
    out = videos.withColumn("crop_h", crop_h).withColumn("crop_y", (F.col("height") - F.col("crop_h")).cast("int"))
    return out.select(
        "*",
        half(F.col("width")).alias("det_w"),
        half(F.col("crop_h")).alias("det_h"),
        F.greatest(F.lit(1), cells(F.col("width"))).alias("thumb_w"),
        F.greatest(F.lit(1), cells(F.col("crop_h"))).alias("thumb_h"),
        F.greatest(F.lit(1), F.rint(F.lit(p.sample_step_sec) * F.col("fps")).cast("int")).alias("step"),
    )


def sample_frames(frames: DataFrame, geo: DataFrame) -> DataFrame:
    """Every step-th frame. geo has a row a video; Spark sends it to the tasks if it is small."""
    return frames.join(geo.select("video_id", "step"), "video_id").filter(F.col("frame") % F.col("step") == 0).drop("step")


def polygons_to_boxes(polys: DataFrame, geo: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """polys (video_id, frame, polygons: array of arrays of points x, y at detector scale) as boxes
    in full-frame pixels."""
    rows = polys.join(geo.select("video_id", "crop_y"), "video_id")
    side = lambda f, g, k: (f(F.transform(g, lambda q: q[k])) * p.det_scale).cast("int")

    def to_box(g):
        return C.box(side(F.array_min, g, "x"), side(F.array_min, g, "y") + F.col("crop_y"), side(F.array_max, g, "x"), side(F.array_max, g, "y") + F.col("crop_y"))

    return rows.select("video_id", "frame", F.transform("polygons", to_box).alias("boxes"))


def detect_text(frames: DataFrame, detector: Callable[[], Callable], p: Params = DEFAULTS) -> DataFrame:
    """video_id, frame, boxes, failed: what a user's detector finds on each frame.

    detector() makes the model once for a task; model(h, w, pixels) gives boxes (x1, y1, x2, y2). A
    frame on which it raises has no boxes and failed is true.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = detector()
        for pdf in batches:
            boxes, failed = [], []
            for h, w, px in zip(pdf["h"], pdf["w"], pdf["pixels"], strict=True):
                try:
                    boxes.append([dict(zip(("x1", "y1", "x2", "y2"), map(int, b), strict=True)) for b in model(h, w, px)])
                    failed.append(False)
                except Exception:  # a frame that cannot be read counts as one without text
                    boxes.append([])
                    failed.append(True)
            yield pd.DataFrame({"video_id": pdf["video_id"], "frame": pdf["frame"], "boxes": boxes, "failed": failed})

    return frames.select("video_id", "frame", "h", "w", "pixels").mapInPandas(run, f"video_id long, frame long, boxes array<{C.BOX}>, failed boolean")


def thumbnails(frames: DataFrame, geo: DataFrame) -> DataFrame:
    """video_id, frame, th, tw, pixels: the gray lower part of every frame at an eighth of its size."""
    rows = frames.join(geo.select("video_id", "crop_y", "crop_h", "thumb_w", "thumb_h"), "video_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            px = [pixels.thumbnail(*x) for x in zip(pdf["pixels"], pdf["h"], pdf["w"], pdf["crop_y"], pdf["crop_h"], pdf["thumb_h"], pdf["thumb_w"], strict=True)]
            yield pd.DataFrame({"video_id": pdf["video_id"], "frame": pdf["frame"], "th": pdf["thumb_h"], "tw": pdf["thumb_w"], "pixels": px})

    return rows.select("video_id", "frame", "h", "w", "pixels", "crop_y", "crop_h", "thumb_w", "thumb_h").mapInPandas(run, "video_id long, frame long, th int, tw int, pixels binary")


def fill_missing_samples(samples: DataFrame, geo: DataFrame) -> DataFrame:
    """A row for every sampled frame of every video (geo: n_frames, step); frames without a row
    have no text."""
    last = F.col("n_frames") - 1
    every = geo.filter("n_frames > 0").select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.col("step").cast("long"))).alias("frame"))
    return every.join(samples.select("video_id", "frame", "boxes"), ["video_id", "frame"], "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(f"array<{C.BOX}>")))


def valid_boxes(samples: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """samples without boxes that are too small for text."""
    keep = F.filter("boxes", lambda b: (b["y2"] - b["y1"] >= p.min_box_h) & (b["x2"] - b["x1"] >= p.min_box_w))
    return samples.withColumn("boxes", keep)


def with_union_box(samples: DataFrame) -> DataFrame:
    return samples.withColumn("bbox", C.union_box(F.col("boxes")))


def with_thumb_rect(rows: DataFrame, geo: DataFrame) -> DataFrame:
    """rows (video_id, bbox) with rect, the box on the video's thumbnail grid."""
    g = geo.select("video_id", F.col("crop_y").alias("__cy"), F.col("thumb_w").alias("__tw"), F.col("thumb_h").alias("__th"))
    return rows.join(g, "video_id").withColumn("rect", C.thumb_rect(F.col("bbox"), F.col("__cy"), F.col("__tw"), F.col("__th"))).drop("__cy", "__tw", "__th")
