"""The test tables read as caption tables. Each adapter has the same definition in both engines: a
DataFrame for the queries and a common table expression (flat, without structs) for their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capspark.functions import columns as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """video_id, frame, boxes from events: errors are samples without text, clicks have two boxes."""
    e = F.col("event_id")
    x1, y1 = e * 37 % 800, 400 + e * 53 % 200
    x2, y2 = x1 + e * 29 % 400 + 20, y1 + e * 17 % 40 + 8
    one, two = C.box(x1, y1, x2, y2), C.box(x1 + 13, y1 + 7, x2 + 13, y2 + 7)
    boxes = F.when(F.col("event_type") == "error", F.array().cast(f"array<{C.BOX}>")).when(F.col("event_type") == "click", F.array(one, two)).otherwise(F.array(one))
    frame = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1) * 9
    return table(spark, d, "events").select(F.col("user_id").alias("video_id"), frame.cast("long").alias("frame"), boxes.alias("boxes"))


SAMPLES = """
s0 as (select user_id as video_id, cast((row_number() over (partition by user_id order by ts, event_id) - 1) * 9 as bigint) as frame,
  event_id as e, event_type as k from events),
s1 as (select video_id, frame, k, e * 37 % 800 as x1, 400 + e * 53 % 200 as y1, e * 37 % 800 + e * 29 % 400 + 20 as x2, 400 + e * 53 % 200 + e * 17 % 40 + 8 as y2 from s0),
boxes as (select video_id, frame, 0 as pos, x1, y1, x2, y2 from s1 where k <> 'error'
  union all select video_id, frame, 1, x1 + 13, y1 + 7, x2 + 13, y2 + 7 from s1 where k = 'click'),
valid as (select * from boxes where y2 - y1 >= 16 and x2 - x1 >= 40),
samples as (select s0.video_id, s0.frame, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, count(x1) as n
  from s0 left join valid v on s0.video_id = v.video_id and s0.frame = v.frame group by 1, 2)
"""


def videos(spark: SparkSession, d: str) -> DataFrame:
    rate = F.array(*map(F.lit, ("25/1", "30000/1001", "60/1", "15/1")))[(F.col("video_id") % 4).cast("int")]
    v = table(spark, d, "events").select(F.col("user_id").alias("video_id")).distinct().withColumn("fps_str", rate)
    fps = F.split("fps_str", "/")[0].cast("double") / F.split("fps_str", "/")[1].cast("double")
    return v.select("video_id", F.lit(1280).alias("width"), F.lit(720).alias("height"), "fps_str", fps.alias("fps"))


VIDEOS = """
videos as (select distinct user_id as video_id, 1280 as width, 720 as height,
  case user_id % 4 when 0 then 25.0 when 1 then cast(30000 as double) / 1001 when 2 then 60.0 else 15.0 end::double as fps from events)
"""


def thumbs(spark: SparkSession, d: str) -> DataFrame:
    """video_id, frame, th, tw, px from embeddings, 8 x 8."""
    px = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
    frame = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("video_id"), frame.cast("long").alias("frame"), F.lit(8).alias("th"), F.lit(8).alias("tw"), px.alias("px"))


THUMBS = """
thumbs as (select cast(label as bigint) as video_id, cast(row_number() over (partition by label order by vec_id) - 1 as bigint) as frame,
  list_transform(embedding, lambda x: cast(floor((cast(x as double) + 1) * 127.5) as int)) as px from embeddings),
px as (select video_id, frame, unnest(px) as v, unnest(range(64)) as i from thumbs)
"""


def thumb_geo(spark: SparkSession, d: str, step: int = 3) -> DataFrame:
    n = thumbs(spark, d).groupBy("video_id").agg(F.count("*").alias("n_frames"))
    return n.select("video_id", "n_frames", F.lit(step).alias("step"), F.lit(0).alias("crop_y"), F.lit(8).alias("thumb_w"), F.lit(8).alias("thumb_h"))


def thumb_samples(spark: SparkSession, d: str) -> DataFrame:
    """Every third frame of thumbs, with a box in its 64 x 64 pixels or none."""
    k = (F.col("video_id") * 7 + F.col("frame") * 5) % 11
    b = C.box(k * 2, k * 3, k * 2 + 24, k * 3 + 20)
    return thumbs(spark, d).filter("frame % 3 = 0").select("video_id", "frame", F.when(k > 2, b).alias("bbox"))


THUMB_SAMPLES = """
ts0 as (select video_id, frame, cast((video_id * 7 + frame * 5) % 11 as int) as k from thumbs where frame % 3 = 0),
tsamples as (select video_id, frame, case when k > 2 then k * 2 end as x1, case when k > 2 then k * 3 end as y1,
  case when k > 2 then k * 2 + 24 end as x2, case when k > 2 then k * 3 + 20 end as y2 from ts0)
"""


def _contrast(v):
    return F.greatest(F.lit(0), F.least(F.lit(240), (v - 127) * 16 + 120))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """thumbs as decoded frames of 32 x 32: each value with more contrast, w, 4 x 4 times as w, w + 7, w + 14."""
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    cell = lambda v: F.repeat(F.concat(two(_contrast(v)), two(_contrast(v) + 7), two(_contrast(v) + 14)), F.lit(4))
    line = lambda r: F.repeat(F.array_join(F.transform(F.slice("px", r * 8 + 1, F.lit(8)), cell), ""), F.lit(4))
    pixels = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), line), ""))
    return thumbs(spark, d).select("video_id", "frame", F.lit(32).alias("h"), F.lit(32).alias("w"), pixels.alias("pixels"))


FRAMES = """
fcell as (select video_id, frame, i // 8 as cy, i % 8 as cx, greatest(0, least(240, (v - 127) * 16 + 120)) as w from px),
four as (select unnest(range(4)) as o),
fpx as (select video_id, frame, cast(cy * 4 + a.o as int) as y, cast(cx * 4 + b.o as int) as x, cast(w as int) as w from fcell, four a, four b)
"""


def glyphs(spark: SparkSession, d: str) -> DataFrame:
    """video_id, frame, mask: which pixels of the rectangle 6..25, 6..21 of a frame are above 120."""
    i = F.sequence(F.lit(0), F.lit(319))
    at = lambda k: (F.floor((F.floor(k / 20) + 6) / 4) * 8 + F.floor((k % 20 + 6) / 4) + 1).cast("int")
    bit = lambda k: F.when(_contrast(F.element_at("px", at(k))) > 120, "01").otherwise("00")
    return thumbs(spark, d).select("video_id", "frame", F.unhex(F.array_join(F.transform(i, bit), "")).alias("mask"))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """video_id, event_id, start, end, bbox from lineitem: disjoint events with gaps of 1 to 40."""
    order = Window.partitionBy("video_id").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    n, gap = F.col("l_quantity").cast("int"), (F.col("l_linenumber") * 5 + F.col("l_partkey")) % 40
    to = F.sum(n + gap).over(order.rowsBetween(Window.unboundedPreceding, 0))
    x, y = F.col("l_partkey") % 600, 500 + F.col("l_orderkey") % 100
    return table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "video_id").select(
        "video_id",
        (F.row_number().over(order) - 1).cast("long").alias("event_id"),
        (to - n).cast("long").alias("start"),
        (to - 1).cast("long").alias("end"),
        C.box(x, y, x + 200, y + 40).alias("bbox"),
    )


INTERVALS = """
iv0 as (select l_suppkey as video_id, cast(l_quantity as int) as n, (l_linenumber * 5 + l_partkey) % 40 as gap, l_partkey % 600 as x, 500 + l_orderkey % 100 as y,
  l_shipdate as o1, l_orderkey as o2, l_linenumber as o3, l_partkey as o4, l_extendedprice as o5 from lineitem),
iv1 as (select *, sum(n + gap) over (partition by video_id order by o1, o2, o3, o4, o5 rows unbounded preceding) as upto,
  row_number() over (partition by video_id order by o1, o2, o3, o4, o5) - 1 as id from iv0),
intervals as (select video_id, cast(id as bigint) as event_id, cast(upto - n as bigint) as start, cast(upto - 1 as bigint) as "end",
  cast(x as int) as x1, cast(y as int) as y1, cast(x + 200 as int) as x2, cast(y + 40 as int) as y2 from iv1)
"""


def asof_frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 100).alias("video_id"), (F.col("event_id") * 131 % 20000).alias("frame"))


ASOF = "lookups as (select user_id % 100 as video_id, event_id * 131 % 20000 as frame from events)"


def reads(spark: SparkSession, d: str) -> DataFrame:
    """video_id, event_id, attempt, readable, lines from conversations."""
    line = lambda t, pos: F.struct(t.alias("text"), ((F.col("conv_id") * 31 + F.col("turn") * 17 + pos * 7) % 100 / F.lit(100.0)).alias("conf"), C.box(pos * 10, 600 - pos * 30, pos * 10 + 200, 600 - pos * 30 + 20 + pos % 7).alias("box"))
    lines = F.transform(F.split("text", "\n", -1), line)
    return table(spark, d, "conversations").select(F.col("conv_id").alias("video_id"), F.floor(F.col("turn") / 3).cast("long").alias("event_id"), (F.col("turn") % 3).cast("int").alias("attempt"), ((F.col("conv_id") + F.col("turn")) % 11 != 0).alias("readable"), F.col("turn").alias("frame"), lines.alias("lines"))


READS = """
r0 as (select conv_id as video_id, cast(floor(turn / 3) as bigint) as event_id, cast(turn % 3 as int) as attempt, (conv_id + turn) % 11 <> 0 as readable, turn as frame,
  unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10))))) as pos, conv_id, turn from conversations),
rlines as (select video_id, event_id, attempt, readable, frame, text, pos, ((conv_id * 31 + turn * 17 + pos * 7) % 100) / 100.0::double as conf,
  cast(pos * 10 as int) as x1, cast(600 - pos * 30 as int) as y1, cast(pos * 10 + 200 as int) as x2, cast(600 - pos * 30 + 20 + pos % 7 as int) as y2 from r0)
"""


def subtitles(spark: SparkSession, d: str) -> DataFrame:
    """video_id, event_id, start, end, text, conf from documents, by language and rough length."""
    video = F.concat("lang", F.lit("-"), F.floor(F.col("n_chars") / 64).cast("string"))
    order = Window.partitionBy("video_id").orderBy("n_chars", "text", "doc_id")
    n, gap = F.col("n_chars") % 50 + 5, F.col("doc_id") % 15
    to = F.sum(n + gap).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "documents").withColumn("video_id", video).select("video_id", (F.row_number().over(order) - 1).cast("long").alias("event_id"), (to - n).cast("long").alias("start"), (to - 1).cast("long").alias("end"), "text", (F.col("doc_id") * 13 % 100 / F.lit(100.0)).alias("conf"))


SUBTITLES = """
sb0 as (select lang || '-' || (n_chars // 64) as video_id, n_chars % 50 + 5 as n, doc_id % 15 as gap, n_chars, text, doc_id from documents),
sb1 as (select *, row_number() over (partition by video_id order by n_chars, text, doc_id) - 1 as id,
  sum(n + gap) over (partition by video_id order by n_chars, text, doc_id rows unbounded preceding) as upto from sb0),
subtitles as (select video_id, cast(id as bigint) as event_id, cast(upto - n as bigint) as start, cast(upto - 1 as bigint) as "end", text, (doc_id * 13 % 100) / 100.0::double as conf from sb1)
"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as subtitles: video_id, event_id, text."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("event_id"), F.coalesce("text", F.lit("")).alias("text"))


TURNS = "turns as (select conv_id as video_id, turn as event_id, coalesce(text, '') as text from conversations)"


def speakers(spark: SparkSession, d: str) -> DataFrame:
    """turns whose first word is a speaker's name before a quote; turns of one word stay as they are."""
    at = F.instr("text", " ")
    quoted = F.concat(F.substring("text", F.lit(1), at - 1), F.lit("「"), F.substring("text", at + 1, F.length("text")), F.lit("」"))
    return turns(spark, d).select("video_id", "event_id", F.when(at > 0, quoted).otherwise(F.col("text")).alias("text"))


SPEAKERS = TURNS + """,
speakers as (select video_id, event_id, case when instr(text, ' ') > 0 then substr(text, 1, instr(text, ' ') - 1) || '「' || substr(text, instr(text, ' ') + 1) || '」' else text end as text from turns)
"""


def media(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("url").alias("path"), F.element_at(F.split("url", "/"), -1).alias("name"), F.length("html").cast("long").alias("size"), F.col("page_id").alias("mtime"))


MEDIA = "media as (select url as path, list_last(string_split(url, '/')) as name, cast(length(html) as bigint) as size, page_id as mtime from pages)"


def status(spark: SparkSession, d: str) -> DataFrame:
    stages = F.array(*map(F.lit, ("probe", "detect", "events", "ocr", "translate", "render")))
    return table(spark, d, "events").select(
        F.col("user_id").alias("video_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        stages[(F.col("event_id") % 6).cast("int")].alias("stage"),
        (F.col("event_id") * 7 % 101 / F.lit(100.0)).alias("progress"),
        F.when(F.col("event_id") % 10 == 0, "done").otherwise("running").alias("status"),
        (F.col("event_id") % 1000).cast("double").alias("elapsed"),
        "event_id",
    )


STATUS = """
status as (select user_id as video_id, ts, event_id % 6 as k, list_extract(['probe', 'detect', 'events', 'ocr', 'translate', 'render'], cast(event_id % 6 + 1 as int)) as stage,
  (event_id * 7 % 101) / 100.0::double as progress, case when event_id % 10 = 0 then 'done' else 'running' end as status, cast(event_id % 1000 as double) as elapsed, event_id from events)
"""
