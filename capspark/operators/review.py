"""The review table with its edits, and the state of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capspark.operators.translate import upsert
from capspark.params import SHOWN, STAGES


def review_table(subs: DataFrame, trans: DataFrame, videos: DataFrame) -> DataFrame:
    """Subtitles beside their translations, with the start in seconds to one digit."""
    rows = subs.join(videos.select("video_id", "fps"), "video_id").join(trans.select("video_id", "event_id", "zh"), ["video_id", "event_id"], "left")
    return rows.select("video_id", "event_id", "start", "end", F.bround(F.col("start") / F.col("fps"), 1).alias("time"), "text", "conf", F.coalesce("zh", F.lit("")).alias("trans"))


def apply_edits(trans: DataFrame, edits: DataFrame) -> DataFrame:
    return upsert(trans, edits)


def latest_status(status: DataFrame) -> DataFrame:
    """The newest row of each video (video_id, ts, stage, progress, status); of equal times the one
    further on."""
    rank = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    m = F.max(F.struct("ts", rank.alias("k"), "progress", "status", "stage"))
    return status.groupBy("video_id").agg(m.alias("m")).select("video_id", "m.ts", "m.stage", "m.progress", "m.status")


def latest_with_eta(status: DataFrame) -> DataFrame:
    """latest_status with elapsed and eta of the newest row of each video."""
    rank = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    m = F.max(F.struct("ts", rank.alias("k"), "progress", "status", "stage", "elapsed")).alias("m")
    return eta(status.groupBy("video_id").agg(m).select("video_id", "m.ts", "m.stage", "m.progress", "m.status", "m.elapsed"))


def stage_status(status: DataFrame) -> DataFrame:
    """video_id, shown, fraction: how far each of the shown stages is. Detecting and segmenting share
    the first; probing comes before all."""
    place = {"probe": -1, "detect": 0, "events": 0, "ocr": 1, "translate": 2, "render": 3}
    now = F.create_map(*[x for k, v in place.items() for x in (F.lit(k), F.lit(v))])[F.col("stage")]
    rows = latest_status(status).withColumn("now", now).select("*", F.posexplode(F.array(*map(F.lit, SHOWN))).alias("i", "shown"))
    fraction = F.when(F.col("status") == "done", F.lit(1.0)).when(F.col("i") < F.col("now"), F.lit(1.0)).when(F.col("i") == F.col("now"), F.col("progress")).otherwise(F.lit(0.0))
    return rows.select("video_id", "shown", fraction.alias("fraction"))


def eta(status: DataFrame) -> DataFrame:
    """status (elapsed, progress) with eta in seconds; null until there is enough to go by."""
    return status.withColumn("eta", F.when(F.col("progress") > 0.02, F.col("elapsed") / F.col("progress") * (1 - F.col("progress"))))


def next_stage(videos: DataFrame, manifest: DataFrame) -> DataFrame:
    """video_id, stage: the first stage of each video that manifest (video_id, stage) lacks; null if
    it has all."""
    want = videos.select("video_id").distinct().select("video_id", F.posexplode(F.array(*map(F.lit, STAGES))).alias("i", "stage"))
    left = want.join(manifest.select("video_id", "stage").distinct(), ["video_id", "stage"], "left_anti").groupBy("video_id").agg(F.min("i").alias("i"))
    return videos.select("video_id").distinct().join(left, "video_id", "left").select("video_id", F.get(F.array(*map(F.lit, STAGES)), F.col("i")).alias("stage"))
