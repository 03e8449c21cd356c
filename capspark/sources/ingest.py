"""Sources and sinks: media files, probe records, per-stage tables, translations, ordered frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capspark.params import VIDEO_SUFFIXES


def media_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Video files under root: path, name, size, mtime. File contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.filter(suffix.isin(*VIDEO_SUFFIXES)).select(
        F.regexp_replace("path", "^file:", "").alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")
    )


def job_key(media: DataFrame) -> DataFrame:
    """media (path, size, mtime as seconds or timestamp) with job_key: equal files share their work."""
    mtime = F.floor(F.col("mtime").cast("double")).cast("long")
    return media.withColumn("job_key", F.substring(F.md5(F.concat_ws("|", "path", F.col("size").cast("string"), mtime.cast("string"))), 1, 12))


def relocate(uploads: DataFrame, media: DataFrame, work_dir: str) -> DataFrame:
    """uploads (path, name, size) with original: the path of the same file by name and size, not the
    upload itself nor below work_dir, the first by (root_rank, path), no rank last; else the upload's
    own path. Uploads without a path are looked up too."""
    found = media.filter(~F.col("path").startswith(work_dir)).select("name", "size", F.col("path").alias("o_path"), "root_rank")
    pick = uploads.select("path", "name", "size").distinct().join(found, ["name", "size"]).filter("path is null or o_path <> path")
    first = F.struct(F.col("root_rank").isNull().alias("none"), "root_rank", "o_path")
    best = pick.groupBy("path", "name", "size").agg(F.min(first).alias("m")).select(F.col("path").alias("__path"), F.col("name").alias("__name"), F.col("size").alias("__size"), F.col("m.o_path").alias("original"))
    same = F.col("path").eqNullSafe(F.col("__path")) & (F.col("name") == F.col("__name")) & (F.col("size") == F.col("__size"))
    return uploads.join(best, same, "left").drop("__path", "__name", "__size").withColumn("original", F.coalesce("original", "path"))


def output_path(media: DataFrame, upload_dir: str, out_dir: str) -> DataFrame:
    """media with output: uploads go to out_dir, others beside their source."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    name = F.element_at(F.split(stem, "/"), -1)
    return media.withColumn("output", F.when(F.col("path").startswith(upload_dir), F.concat(F.lit(out_dir), name)).otherwise(stem)).withColumn("output", F.concat("output", F.lit(".zh.mp4")))


_PROBE = (
    "struct<streams:array<struct<codec_type:string,width:int,height:int,r_frame_rate:string,duration:string,nb_frames:string,codec_name:string,bit_rate:string>>,"
    "format:struct<duration:string,bit_rate:string>>"
)


def parse_probe(probe_raw: DataFrame) -> DataFrame:
    """probe_raw (video_id, json) as videos, with error: null, "no video" or "bad frame rate". Rows
    with an error keep null fields; callers split on it."""
    p = F.from_json("json", _PROBE)
    rows = probe_raw.select("video_id", p.alias("p")).withColumn("v", F.get(F.filter("p.streams", lambda s: s["codec_type"] == "video"), F.lit(0)))
    filled = lambda c: F.when(F.length(F.col(c)) > 0, F.col(c))
    rate = F.coalesce(F.col("v.r_frame_rate"), F.lit("30/1"))
    num, den = (F.get(F.split(rate, "/"), F.lit(i)).try_cast("double") for i in (0, 1))
    fps = F.when((den != 0) & den.isNotNull(), num / den)
    error = F.when(F.col("v").isNull(), "no video").when(fps.isNull(), "bad frame rate")
    duration = F.coalesce(filled("v.duration"), filled("p.format.duration"), F.lit("0")).try_cast("double")
    frames = F.when(F.col("v.nb_frames").rlike("^[0-9]+$"), F.col("v.nb_frames").try_cast("long")).when(duration != 0, (duration * fps).cast("long")).otherwise(F.lit(0).cast("long"))
    bitrate = F.coalesce(filled("v.bit_rate"), filled("p.format.bit_rate"), F.lit("0")).try_cast("long")
    ok = error.isNull()
    return rows.select(
        "video_id",
        F.when(ok, F.col("v.width")).alias("width"),
        F.when(ok, F.col("v.height")).alias("height"),
        F.when(ok, rate).alias("fps_str"),
        F.when(ok, fps).alias("fps"),
        F.when(ok, duration).alias("duration"),
        F.when(ok, frames).alias("n_frames"),
        F.when(ok, F.exists("p.streams", lambda s: s["codec_type"] == "audio")).alias("has_audio"),
        F.when(ok, F.col("v.codec_name")).alias("vcodec"),
        F.when(ok, bitrate).alias("bitrate"),
        error.alias("error"),
    )


def write_stage(df: DataFrame, path: str, version: int) -> None:
    """Append one result of a stage; readers take each video's newest version as a whole."""
    df.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest version of each video_id. The versions are summed up by video first, so
    only their small table is joined to the rows."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("video_id").agg(F.max("version").alias("version"))
    return rows.join(newest, ["video_id", "version"], "left_semi").drop("version")


def compact_stage(spark: SparkSession, path: str, to: str) -> None:
    """Rewrite the newest versions to another path."""
    read_stage(spark, path).withColumn("version", F.lit(0).cast("long")).write.mode("overwrite").parquet(to)


def translations_from_json(docs: DataFrame) -> DataFrame:
    """docs (video_id, json: an object of id to text) as rows video_id, event_id, zh."""
    return docs.select("video_id", F.explode(F.from_json("json", "map<string,string>")).alias("k", "zh")).select("video_id", F.col("k").cast("long").alias("event_id"), "zh")


def translations_to_json(rows: DataFrame) -> DataFrame:
    """One JSON object a video, ids ascending. A video's translations are one document by nature."""
    entry = F.struct("event_id", F.col("event_id").cast("string").alias("key"), F.col("zh").alias("value"))
    entries = F.transform(F.sort_array(F.collect_list(entry)), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return rows.groupBy("video_id").agg(F.to_json(F.map_from_entries(entries)).alias("json"))


FRAMES = ("video_id", "frame", "h", "w", "pixels")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Decoded frames from Parquet: video_id, frame, h, w, pixels (bytes, rows of h x w x channels).
    Other columns are not read; a table without one of these is refused."""
    table = spark.read.parquet(path)
    if missing := [c for c in FRAMES if c not in table.columns]:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    return table.select(*FRAMES)


def write_frames(frames: DataFrame, table: str, path: str, buckets: int = 200) -> DataFrame:
    """frames as an external table at path, bucketed by video and block of frames, so that later joins
    by frame leave its pixels where they are. Nothing is shuffled to write it: a task adds a file to
    each bucket that it has frames of, so it is best written as it is decoded, a range of frames a task."""
    from capspark.operators.frame_index import block_of

    rows = frames.select(*FRAMES, block_of(F.col("frame")).alias("block"))
    rows.write.bucketBy(buckets, "video_id", "block").option("path", path).mode("overwrite").format("parquet").saveAsTable(table)
    return frames.sparkSession.table(table)


def open_frames(spark: SparkSession, table: str, path: str, buckets: int = 200) -> DataFrame:
    """The table of write_frames, named anew in a session whose catalog does not know it."""
    if not spark.catalog.tableExists(table):
        cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE {table} ({cols}) USING parquet CLUSTERED BY (video_id, block) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def ordered_frames(frames: DataFrame, files: int | None = None) -> DataFrame:
    """frames dealt by range, into as many files as Spark or the caller thinks right, and sorted, ready
    to be written in frame order of each video."""
    by = ("video_id", "frame")
    return (frames.repartitionByRange(files, *by) if files else frames.repartitionByRange(*by)).sortWithinPartitions(*by)


def frame_audit(frames: DataFrame) -> DataFrame:
    """Per video: n, first, last, gaps (missing frames between neighbours), repeats."""
    after = F.lead("frame").over(Window.partitionBy("video_id").orderBy("frame"))
    rows = frames.select("video_id", "frame", (after - F.col("frame")).alias("step"))
    return rows.groupBy("video_id").agg(
        F.count("*").alias("n"),
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.coalesce(F.sum(F.when(F.col("step") > 1, F.col("step") - 1)), F.lit(0)).cast("long").alias("gaps"),
        F.count(F.when(F.col("step") == 0, 1)).alias("repeats"),
    )


def frame_files(spark: SparkSession, path: str) -> DataFrame:
    """What the files of written frames hold, read back from them by file and row: file, video_id, n,
    first_frame, last_frame, gaps, repeats, and disorder, the rows that do not come after the row
    before them. No pixels are read; a window sees the narrow rows of one file."""
    rows = spark.read.parquet(path).select("video_id", "frame", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    w = Window.partitionBy("file").orderBy("row")
    here, before = F.struct("video_id", "frame"), F.lag(F.struct("video_id", "frame")).over(w)
    step = F.when(F.lag("video_id").over(w) == F.col("video_id"), F.col("frame") - F.lag("frame").over(w))
    rows = rows.select("file", "video_id", "frame", F.coalesce(here < before, F.lit(False)).cast("long").alias("back"), step.alias("step"))
    return rows.groupBy("file", "video_id").agg(
        F.count("*").alias("n"),
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.coalesce(F.sum(F.when(F.col("step") > 1, F.col("step") - 1)), F.lit(0)).cast("long").alias("gaps"),
        F.count(F.when(F.col("step") == 0, 1)).alias("repeats"),
        F.sum("back").alias("disorder"),
    )


def files_audit(files: DataFrame) -> DataFrame:
    """Per video, over its files (frame_files) in the order of their first frames: n_files, n,
    first_frame, last_frame, gaps, repeats, and in_order: no row and no file comes too early."""
    w = Window.partitionBy("video_id").orderBy("first_frame", "last_frame", "file")
    step = F.col("first_frame") - F.lag("last_frame").over(w)
    rows = files.withColumn("step", step)
    return rows.groupBy("video_id").agg(
        F.count("*").alias("n_files"),
        F.sum("n").alias("n"),
        F.min("first_frame").alias("first_frame"),
        F.max("last_frame").alias("last_frame"),
        (F.sum("gaps") + F.coalesce(F.sum(F.when(F.col("step") > 1, F.col("step") - 1)), F.lit(0))).cast("long").alias("gaps"),
        (F.sum("repeats") + F.count(F.when(F.col("step") == 0, 1))).alias("repeats"),
        ((F.sum("disorder") == 0) & (F.count(F.when(F.col("step") < 0, 1)) == 0)).alias("in_order"),
    )
