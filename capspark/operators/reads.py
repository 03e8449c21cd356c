"""Reading text: candidate frames, the best read of each event, merging of neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capspark.functions import columns as C
from capspark.functions import pixels, ratio
from capspark.operators.block_fold import blocked_fold
from capspark.operators.frame_index import asked_frames
from capspark.params import DEFAULTS, Params
from capspark.sources.shared import written

LINE = f"struct<text:string,conf:double,box:{C.BOX}>"


def candidate_frames(events: DataFrame) -> DataFrame:
    """events (start, end) as attempts 0..2: the middle, a quarter in, a quarter before the end."""
    n = F.col("end") - F.col("start") + 1
    quarter = F.greatest(F.lit(1).cast("long"), F.floor(n / 4))
    at = F.array(F.floor((F.col("start") + F.col("end")) / 2), F.col("start") + quarter, F.col("end") - quarter)
    return events.select("video_id", "event_id", F.posexplode(at).alias("attempt", "frame"))


def read_text(frames: DataFrame, candidates: DataFrame, reader: Callable[[], Callable]) -> DataFrame:
    """candidates with readable and lines: what a user's reader finds on each frame. reader() makes
    the model once for a task; model(h, w, pixels) gives (text, conf, (x1, y1, x2, y2)) a line, or
    None if the frame cannot be read. The candidates go to the frames (see frame_index); a candidate
    whose frame does not exist is not readable."""
    kind = dict(candidates.dtypes)["video_id"]
    keys = ["video_id", "event_id", "attempt", "frame"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = reader()
        for pdf in batches:
            lines, ok = [], []
            for h, w, px in zip(pdf["h"], pdf["w"], pdf["pixels"], strict=True):
                got = None if px is None else model(int(h), int(w), px)
                ok.append(got is not None)
                lines.append([{"text": t, "conf": float(c), "box": dict(zip(("x1", "y1", "x2", "y2"), map(int, b), strict=True))} for t, c, b in got or ()])
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "readable": ok, "lines": lines})

    found = asked_frames(frames, candidates.select(*keys)).select(*keys, "h", "w", "pixels")
    found = found.mapInPandas(run, f"video_id {kind}, event_id long, attempt int, frame long, readable boolean, lines array<{LINE}>")
    rows = candidates.select(*keys).join(found, keys, "left")
    return rows.select(*keys, F.coalesce("readable", F.lit(False)).alias("readable"), F.coalesce("lines", F.array().cast(f"array<{LINE}>")).alias("lines"))


def keep_lines(reads: DataFrame, events: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """reads with the lines that count: some text, sure enough, near the event's box."""
    rows = reads.join(events.select("video_id", "event_id", "bbox"), ["video_id", "event_id"])
    stripped = F.transform("lines", lambda x: F.struct(C.strip(x["text"]).alias("text"), x["conf"].alias("conf"), x["box"].alias("box")))
    m, e = p.overlap_margin, F.col("bbox")

    def near(b):
        return (b["x2"] >= e["x1"] - m) & (b["x1"] <= e["x2"] + m) & (b["y2"] >= e["y1"] - m) & (b["y1"] <= e["y2"] + m)

    return rows.withColumn("lines", F.filter(stripped, lambda x: (x["text"] != "") & (x["conf"] >= p.min_ocr_conf) & near(x["box"]))).drop("bbox")


def best_read(reads: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The read of each event that counts: of the attempts before a stop the surest, the earliest of
    equals. An attempt stops if it is sure enough, or empty after a good one; unreadable ones are
    skipped. Events without a good read are dropped."""
    mean = F.aggregate("lines", F.lit(0.0), lambda s, x: s + x["conf"]) / F.size("lines")
    rows = reads.filter("readable").withColumn("good", F.size("lines") > 0).withColumn("m", F.when(F.col("good"), mean))
    w = Window.partitionBy("video_id", "event_id").orderBy("attempt")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    had = F.coalesce(F.max("good").over(earlier), F.lit(False))
    stop = (F.col("good") & (F.col("m") >= p.early_stop_conf)) | (~F.col("good") & had)
    rows = rows.withColumn("stop", stop.cast("int")).withColumn("open", F.coalesce(F.sum("stop").over(earlier), F.lit(0)) == 0)
    ranked = rows.filter("open and good").withColumn("rn", F.row_number().over(Window.partitionBy("video_id", "event_id").orderBy(F.desc("m"), "attempt")))
    return ranked.filter("rn = 1").select("video_id", "event_id", "attempt", "frame", "lines")


def assemble(reads: DataFrame) -> DataFrame:
    """reads with text (lines from top to bottom, left to right), conf (the mean, to 3 digits), bbox
    and line_h."""
    keyed = F.transform("lines", lambda x, i: F.struct(x["box"]["y1"].alias("y"), x["box"]["x1"].alias("x"), i.alias("i"), x["text"].alias("text")))
    conf = F.aggregate("lines", F.lit(0.0), lambda s, x: s + x["conf"]) / F.size("lines")
    text = F.array_join(F.transform(F.array_sort(keyed), lambda k: k["text"]), "\n")
    heights = F.array_sort(F.transform("lines", lambda x: x["box"]["y2"] - x["box"]["y1"]))
    n = F.size("lines")
    low, high = F.element_at(heights, F.floor((n + 1) / 2).cast("int")), F.element_at(heights, (F.floor(n / 2) + 1).cast("int"))
    return reads.withColumns({"text": text, "conf": F.bround(conf, 3), "bbox": C.union_box(F.transform("lines", lambda x: x["box"])), "line_h": ((low + high) / 2).cast("int")})


def text_style(subs: DataFrame, frames: DataFrame) -> DataFrame:
    """subs (video_id, event_id, frame, bbox, lines) with style, glyph_rect and mask (one byte a
    pixel; null if the glyphs cannot be told from the picture). Subtitles go to their frames, see
    frame_index; one whose frame does not exist is left out."""
    asks = subs.select("video_id", "frame", "event_id", F.to_json("bbox").alias("b"), F.to_json(F.transform("lines", lambda x: x["box"])).alias("boxes"))
    rows = asked_frames(frames, asks).select("video_id", "event_id", "h", "w", "pixels", "b", "boxes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                b, boxes = json.loads(r.b), json.loads(r.boxes)
                x1, y1, x2, y2 = max(0, b["x1"] - 4), max(0, b["y1"] - 4), min(r.w, b["x2"] + 4), min(r.h, b["y2"] + 4)
                part = pixels.image(r.pixels, r.h, r.w)[y1:y2, x1:x2]
                fill, outline, glyph = pixels.text_style(part, [(q["x1"] - x1, q["y1"] - y1, q["x2"] - x1, q["y2"] - y1) for q in boxes])
                rect = None if glyph is None else {"x1": x1, "y1": y1, "x2": x2, "y2": y2}
                out.append((r.video_id, r.event_id, list(fill), list(outline), rect, None if glyph is None else glyph.astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["video_id", "event_id", "fill", "outline", "glyph_rect", "mask"])

    kind = dict(subs.dtypes)["video_id"]
    return rows.mapInPandas(run, f"video_id {kind}, event_id long, fill array<int>, outline array<int>, glyph_rect {C.BOX}, mask binary")


def with_mask_keys(styles: DataFrame) -> DataFrame:
    """styles of text_style with mask_key, the SHA-256 of the mask and its size; null without a mask."""
    r = F.col("glyph_rect")
    size = F.concat((r["y2"] - r["y1"]).cast("string"), F.lit("x"), (r["x2"] - r["x1"]).cast("string"), F.lit(":"))
    return styles.withColumn("mask_key", F.sha2(F.concat(size.cast("binary"), F.col("mask")), 256))


def mask_table(styles: DataFrame) -> DataFrame:
    """video_id, mask_key, h, w, mask: each mask of a video once, by its content. styles: with_mask_keys()."""
    r = F.col("glyph_rect")
    rows = styles.filter("mask_key is not null").select("video_id", "mask_key", (r["y2"] - r["y1"]).alias("h"), (r["x2"] - r["x1"]).alias("w"), "mask")
    return rows.dropDuplicates(["video_id", "mask_key"])


def with_styles(subs: DataFrame, styles: DataFrame) -> DataFrame:
    """subs with style (fill, outline, line_h), glyph_rect and mask_key; the masks stay in their table."""
    s = styles.select("video_id", "event_id", "fill", "outline", "glyph_rect", "mask_key")
    rows = subs.join(s, ["video_id", "event_id"], "left")
    return rows.withColumn("style", F.struct("fill", "outline", "line_h")).drop("fill", "outline")


def similarity(a: str, b: str) -> float:
    """The Ratcliff-Obershelp ratio; the order of the two matters."""
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def text_similarity(a: Column | str, b: Column | str) -> Column:
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(p, q) for p, q in zip(x, y, strict=True)])

    return ratio(a, b)


def _renumber(subs: DataFrame, video: str = "video_id") -> DataFrame:
    return subs.withColumn("event_id", (F.row_number().over(Window.partitionBy(video).orderBy("start", "end")) - 1).cast("long"))


#: Subtitles that are folded together.
SUBTITLES = 128


def merge_same_text(subs: DataFrame, p: Params = DEFAULTS, block: int = SUBTITLES) -> DataFrame:
    """Neighbours (video_id, start, end, text, conf, and any columns of content) with a gap of
    0..text_gap and texts alike become one: content as a whole from the surer side, the earlier of
    equals; the end is the later one's. Of equal places the surer, then the smaller text's hash is
    first. Chains are cut by gap; those that begin within a block's length are folded as one group, a
    longer chain's rest in blocks of its own (see block_fold). Places are numbered once and written
    with the texts; these then move twice, to their groups and to the merged places."""
    named = {"start": "long", "end": "long", "conf": "double"}
    rows = subs.select("*", *[F.col(c).cast(t).alias(f"__{c}") for c, t in named.items()], F.xxhash64("text").alias("__hash"))
    w = Window.partitionBy("video_id").orderBy("__start", "__end", F.desc("__conf"), "__hash")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce(~(F.col("__start") - F.lag("__end").over(w)).between(0, p.text_gap), F.lit(True))
    rows = rows.withColumns({"__row": F.row_number().over(w).cast("long"), "__new": new})
    rows = rows.withColumns({"__first": F.max(F.when(F.col("__new"), F.col("__row"))).over(so_far), "__alone": F.col("__new") & F.lead("__new", 1, True).over(w)})
    # a video's rows lie in one partition in their order, so this is one number for each, also for no video_id
    rows = rows.withColumn("__video", F.monotonically_increasing_id() - F.col("__row"))
    rows = rows.withColumns({"__group": F.floor((F.col("__first") - 1) / block).cast("long"), "__blk": F.floor((F.col("__row") - F.col("__first")) / block).cast("long")})
    rows = written(rows.drop("__hash"), "subtitles")
    key = ["video", "group"]
    plain = lambda *names: [F.col(f"__{c}").alias(c) for c in names]
    places = rows.select(*plain("video", "group", "blk", "row", "first", "new", "start", "end", "conf"))
    texts = rows.filter("not __alone").select(*plain("video", "group", "blk", "row", "new"), F.coalesce("__conf", F.lit(float("-inf"))).alias("conf"), "text")
    kept_text = rows.select(*plain("video"), F.col("__row").alias("e_kept"), F.col("text").alias("e_text"))

    def add_up(over: Window) -> dict:
        m = F.max(F.struct("best", (-F.col("kept")).alias("r"))).over(over)
        return {"kept": -m["r"], "best": m["best"]}

    def fold(pdf: pd.DataFrame, _) -> list[tuple]:
        out, state, own = [], None, None  # row, text and confidence of the content that is kept
        for r in pdf.itertuples(index=False):
            row, text = int(r.row), r.text or ""
            if state is None and not pd.isna(r.e_kept):
                state = (int(r.e_kept), r.e_text or "", r.e_best)
            cut = state is not None and (r.new or not ratio.above(state[1], text, p.text_ratio))
            new = (row, text, r.conf)
            own = new if cut or own is None or new[2] > own[2] else own
            state = new if cut or state is None or new[2] > state[2] else state
            out.append((row, bool(cut), own[0], own[2]))
        return out

    enter = lambda handed: handed.join(kept_text, ["video", "e_kept"], "left")
    cuts = blocked_fold(texts, places, key, "row", {"kept": "long", "best": "double"}, add_up, fold, enter)
    merged = places.join(cuts, [*key, "row"], "left")
    of_chain = Window.partitionBy("video", "first").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumn("sub", F.sum((F.coalesce("cut", F.lit(False)) & ~F.col("new")).cast("int")).over(of_chain))
    surest = F.max(F.struct(F.coalesce("conf", F.lit(float("-inf"))).alias("c"), (-F.col("row")).alias("r"))).alias("m")
    merged = merged.groupBy("video", "first", "sub").agg(F.min("start").alias("start"), F.max_by("end", "row").alias("end"), surest)
    merged = _renumber(merged, "video").select(F.col("video").alias("__video"), (-F.col("m.r")).alias("__row"), "event_id", "start", "end")
    out = merged.join(rows.drop("event_id", "start", "end"), ["__video", "__row"])
    return out.select(*dict.fromkeys([*subs.columns, "event_id"]))


def merge_equal_text(subs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """merge_same_text for equal texts only, by windows: the surest row's content, the earlier of
    equals."""
    w = Window.partitionBy("video_id").orderBy("start", "end")
    same = (F.col("start") - F.lag("end").over(w)).between(0, p.text_gap) & (F.col("text") == F.lag("text").over(w))
    rows = subs.withColumn("__new", F.coalesce(~same, F.lit(True)).cast("int")).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = Window.partitionBy("video_id", "__g")
    rows = rows.withColumn("__s", F.min("start").over(g)).withColumn("__e", F.max("end").over(g)).withColumn("__r", F.row_number().over(g.orderBy(F.desc("conf"), "start", "end")))
    rows = rows.filter("__r = 1").withColumn("start", F.col("__s")).withColumn("end", F.col("__e"))
    return _renumber(rows.drop("__new", "__g", "__s", "__e", "__r"))


def distinct_lines(subs: DataFrame) -> DataFrame:
    """Each distinct text of a video with its count and first place."""
    return subs.groupBy("video_id", "text").agg(F.count("*").alias("n"), F.min("start").alias("first_start"))
