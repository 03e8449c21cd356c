"""Requests that go to the frames, so that pixels stay where they are.

A frame table that ingest.write_frames has made is bucketed by video and block of frames. Requests
carry the block of the frame they ask for and are joined by the two bucket columns, with the frame
itself as a condition inside the block: only requests are shuffled, whatever their number, and the
hash table that a task builds holds the requests of its blocks.

Frames without buckets stay as well while the requests are few enough to be sent to every task. With
more, the blocks that are asked for are, and only frames of these blocks are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frames of one block.
BLOCK = 256
#: Requests, or else blocks, up to which they are sent to every task (about 50 bytes each).
BROADCAST_REQUESTS = 200_000
PIXELS = ["video_id", "frame", "h", "w", "pixels"]


def block_of(frame: Column) -> Column:
    return F.floor(frame / BLOCK).cast("long")


def bucketed(frames: DataFrame) -> bool:
    """Whether frames come from a table of write_frames, which alone has a block column."""
    return "block" in frames.columns


def _few(rows: DataFrame, most: int) -> bool:
    return rows.limit(most + 1).count() <= most


def asked_frames(frames: DataFrame, requests: DataFrame) -> DataFrame:
    """The frames that requests (video_id, frame, any more) ask for, with the columns of the requests:
    a row for each request whose frame exists. Requests may repeat."""
    if not bucketed(frames):
        frames = frames.select(*PIXELS)
        if _few(requests, BROADCAST_REQUESTS):
            return frames.join(F.broadcast(requests), ["video_id", "frame"])
        blocks = requests.select("video_id", block_of(F.col("frame")).alias("block")).distinct()
        if _few(blocks, BROADCAST_REQUESTS):
            frames = frames.withColumn("block", block_of(F.col("frame"))).join(F.broadcast(blocks), ["video_id", "block"], "left_semi").drop("block")
        return frames.join(requests, ["video_id", "frame"])
    asks = requests.withColumn("block", block_of(F.col("frame"))).withColumnRenamed("frame", "__frame")
    rows = frames.select(*PIXELS, "block").join(asks.hint("shuffle_hash"), ["video_id", "block"])
    return rows.filter(F.col("frame") - F.col("__frame") == 0).drop("block", "__frame")


def frames_with(frames: DataFrame, stretches: DataFrame, cols: list[str]) -> DataFrame:
    """All frames, with cols of the stretch (video_id, lo, hi inclusive, cols; disjoint in a video) that
    they lie in, or nulls. A stretch goes once to each block that it touches."""
    blocks = F.explode(F.sequence(block_of(F.col("lo")), block_of(F.col("hi"))))
    parts = stretches.filter("hi >= lo").select("video_id", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), *cols, blocks.alias("block"))
    rows = frames.select(*PIXELS, block_of(F.col("frame")).alias("block")) if not bucketed(frames) else frames.select(*PIXELS, "block")
    rows, parts = rows.alias("f"), parts.hint("shuffle_hash").alias("s")
    same = (F.col("f.video_id") == F.col("s.video_id")) & (F.col("f.block") == F.col("s.block"))
    inside = (F.col("f.frame") >= F.col("s.__lo")) & (F.col("f.frame") <= F.col("s.__hi"))
    return rows.join(parts, same & inside, "left").select(*[F.col(f"f.{c}") for c in PIXELS], *[F.col(f"s.{c}") for c in cols])


def frames_of(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """The frames of videos (video_id, once each), which are sent to every task while they are few enough."""
    ids = videos.select("video_id")
    return frames.join(F.broadcast(ids) if _few(ids, BROADCAST_REQUESTS) else ids, "video_id", "left_semi")
