"""Planning what to erase and where to write, and compositing frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capspark.functions import columns as C
from capspark.functions import pixels
from capspark.operators.frame_index import asked_frames, frames_with
from capspark.params import DEFAULTS, Params

FRAME_BLOCK = 1024


def font_spec(subs: DataFrame, mode: str = "replace", p: Params = DEFAULTS) -> DataFrame:
    """subs (line_h, bbox, width) with size, stroke, gap and max_w."""
    scale, low, high = (p.replace_font_scale, 16, 72) if mode == "replace" else (p.append_font_scale, 14, 58)
    size = F.least(F.lit(high), F.greatest(F.lit(low), F.rint(F.col("line_h") * F.lit(scale)).cast("int")))
    wide = F.least(F.col("width") - 96.0, F.greatest(1.25 * (F.col("bbox.x2") - F.col("bbox.x1")), 0.4 * F.col("width")))
    out = subs.withColumn("size", size)
    return out.withColumn("stroke", F.greatest(F.lit(2), F.floor(F.col("size") / 12).cast("int"))).withColumn("gap", F.rint(F.col("size") * F.lit(1.24)).cast("int")).withColumn("max_w", wide.cast("double"))


def wrap_text(rows: DataFrame, width: Callable[[str, int], float]) -> DataFrame:
    """rows (zh, size, max_w) with lines and text_w, by a user's width(text, size)."""

    @F.pandas_udf("struct<lines:array<string>,text_w:int>")
    def wrapped(zh: pd.Series, size: pd.Series, max_w: pd.Series) -> pd.DataFrame:
        lines = [pixels.wrap(t or "", m, lambda x, s=s: width(x, s)) for t, s, m in zip(zh, size, max_w, strict=True)]
        return pd.DataFrame({"lines": lines, "text_w": [max(int(width(x, s)) for x in g) for g, s in zip(lines, size, strict=True)]})

    return rows.withColumn("__w", wrapped("zh", "size", "max_w")).select(*rows.columns, "__w.lines", "__w.text_w")


def wrap_fixed(rows: DataFrame) -> DataFrame:
    """wrap_text for a font whose characters are all as wide as it is high: lines and text_w by
    built-in functions."""
    per = F.greatest(F.lit(1), F.floor(F.col("max_w") / F.col("size")).cast("int"))
    part = lambda t: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(t) / per).cast("int") - 1)), lambda i: F.substring(t, i * per + 1, per))
    lines = F.flatten(F.transform(F.split(F.coalesce("zh", F.lit("")), "\n", -1), part))
    out = rows.withColumn("lines", lines)
    trimmed = F.when((F.size("lines") > 1) & (F.element_at("lines", -1) == ""), F.slice("lines", F.lit(1), F.size("lines") - 1)).otherwise(F.col("lines"))
    out = out.withColumn("lines", trimmed)
    return out.withColumn("text_w", (F.array_max(F.transform("lines", F.length)) * F.col("size")).cast("int"))


def place_overlay(rows: DataFrame, mode: str = "replace") -> DataFrame:
    """rows (bbox, width, height, size, stroke, gap, text_w, n_lines) with the overlay's canvas,
    clipped to the frame: ox, oy, canvas_x1, canvas_y1, canvas_x2, canvas_y2."""
    w, h, b = F.col("width"), F.col("height"), F.col("bbox")
    out = rows.withColumn("text_h", (F.col("gap") * (F.col("n_lines") - 1) + F.col("size")).cast("int"))
    centred = F.abs((b["x1"] + b["x2"]) / 2 - w / 2) < 0.06 * w
    ox = F.when(centred, ((w - F.col("text_w")) / 2).cast("int")).otherwise(b["x1"])
    out = out.withColumn("ox", F.greatest(F.lit(8), F.least(ox, w - F.col("text_w") - 8)).cast("int"))
    if mode == "replace":
        oy = F.when(b["y1"] + F.col("text_h") > h - 10, F.greatest(F.lit(0), h - 10 - F.col("text_h"))).otherwise(b["y1"])
    else:
        below = b["y2"] + 8
        oy = F.greatest(F.lit(4), F.when(below + F.col("text_h") > h - 8, b["y1"] - F.col("text_h") - 10).otherwise(below))
    out = out.withColumn("oy", oy.cast("int")).withColumn("pad", F.col("stroke") + 4)
    x, y = F.col("ox") - F.col("pad"), F.col("oy") - F.col("pad")
    return out.withColumns(
        {
            "canvas_x1": F.greatest(F.lit(0), x).cast("int"),
            "canvas_y1": F.greatest(F.lit(0), y).cast("int"),
            "canvas_x2": F.least(w, x + F.col("text_w") + 2 * F.col("pad")).cast("int"),
            "canvas_y2": F.least(h, y + F.col("text_h") + 2 * F.col("pad") + F.floor(F.col("size") / 2).cast("int")).cast("int"),
        }
    ).drop("pad")


def erase_roi(subs: DataFrame) -> DataFrame:
    """subs (boxes of their lines, width, height) with roi, the lines' union with a margin."""
    u = C.union_box(F.col("boxes"))
    out = subs.withColumn("__u", u)
    b = F.col("__u")
    roi = C.box(F.greatest(F.lit(0), b["x1"] - 22), F.greatest(F.lit(0), b["y1"] - 19), F.least(F.col("width"), b["x2"] + 22), F.least(F.col("height"), b["y2"] + 19))
    return out.withColumn("roi", F.when(b.isNotNull(), roi)).drop("__u")


def erase_masks(subs: DataFrame, glyph_masks: DataFrame) -> DataFrame:
    """What to erase for each subtitle: video_id, event_id, roi, mask (one byte a pixel of roi; null
    without a roi). subs: roi, boxes of their lines, glyph_rect, mask_key; glyph_masks: video_id,
    mask_key, mask. A subtitle without a mask, or whose mask does not fit its rectangle or its roi,
    has its lines' boxes erased. One equi-join; a mask moves only to subtitles that name it."""
    masks = glyph_masks.select("video_id", "mask_key", F.col("mask").alias("glyph"))
    rows = subs.select("video_id", "event_id", "roi", "boxes", "glyph_rect", "mask_key").join(masks, ["video_id", "mask_key"], "left")
    flat = [F.col(f"{c}.{k}").alias(f"{c[0]}_{k}") for c in ("roi", "glyph_rect") for k in ("x1", "y1", "x2", "y2")]
    rows = rows.select("video_id", "event_id", "roi", *flat, F.flatten(F.transform("boxes", lambda b: F.array(b["x1"], b["y1"], b["x2"], b["y2"]))).alias("lines"), "glyph")

    @F.pandas_udf("binary")
    def erase(roi: pd.DataFrame, rect: pd.DataFrame, lines: pd.Series, glyph: pd.Series) -> pd.Series:
        out = []
        for r, g, boxes, bits in zip(roi.itertuples(index=False), rect.itertuples(index=False), lines, glyph, strict=True):
            if pd.isna(r[0]):
                out.append(None)
                continue
            own = None
            if bits is not None and not pd.isna(g[0]):
                g = tuple(map(int, g))
                size = (g[3] - g[1], g[2] - g[0])
                own = np.frombuffer(bits, np.uint8).reshape(size).astype(bool) if len(bits) == size[0] * size[1] else None
            at = np.asarray([] if boxes is None else boxes, int).reshape(-1, 4).tolist()
            out.append(pixels.erase_mask(tuple(map(int, r)), at, own, g).astype(np.uint8).tobytes())
        return pd.Series(out)

    four = lambda c: F.struct(*[F.col(f"{c}_{k}").alias(k) for k in ("x1", "y1", "x2", "y2")])
    return rows.select("video_id", "event_id", "roi", erase(four("r"), four("g"), "lines", "glyph").alias("mask"))


def overlay_plans(subs: DataFrame, glyph_masks: DataFrame, overlays: DataFrame, mode: str = "replace") -> DataFrame:
    """The plan of each subtitle for composite(): roi and mask of what is erased (nothing in append
    mode), and the rendered overlay (video_id, event_id, overlay, overlay_x, overlay_y, overlay_h,
    overlay_w) where there is one."""
    rows = erase_roi(subs)
    if mode == "append":
        rows = rows.withColumn("roi", F.lit(None).cast(C.BOX))
    return erase_masks(rows, glyph_masks).join(overlays, ["video_id", "event_id"], "left")


def clean_frames(subs: DataFrame, n_frames: DataFrame | None = None, p: Params = DEFAULTS) -> DataFrame:
    """video_id, event_id, frame: up to half of clean_want frames without text on each side of an
    event. From clean_margin frames outside it, a probe that finds text moves one frame on, a hit
    moves clean_stride; clean_steps probes in all; the end of the video ends a side. Without a table
    n_frames subs have that column.

    By built-ins: stretches of frames with text are merged, and each knows the few around it, so that
    one as-of lookup of a side's first probe has all that both its frames depend on. Stretches and
    probes meet in windows by video_id over numbers alone, so subs that are dealt by video_id are not
    shuffled again, nor are the frames in frame_requests.
    """
    subs = subs.filter("video_id is not null")
    ev = subs if n_frames is None else subs.join(n_frames.select("video_id", "n_frames"), "video_id")
    rows = ev.select("video_id", F.col("event_id").alias("owner"), "n_frames", "start", "end", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    base = F.when(F.col("side") < 0, F.col("start") - p.clean_margin).otherwise(F.col("end") + p.clean_margin)
    rows = rows.select("video_id", "owner", "n_frames", "side", base.cast("long").alias("frame"))

    covered = covered_stretches(subs).select("video_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    w = Window.partitionBy("video_id").orderBy("start")
    reach = (p.clean_stride + 1) // 2  # stretches have a frame and one between them, so no more begin within a stride
    far = F.lit(-(1 << 60))  # before all frames, so that the first stretch is seen from before it too
    before = [F.struct(F.lag("start", k).over(w).alias("s"), F.lag("end", k).over(w).alias("e")) for k in range(1, reach + 1)]
    after = [F.struct(F.lead("start", k).over(w).alias("s"), F.lead("end", k).over(w).alias("e")) for k in range(1, reach + 1)]
    own = F.struct(F.col("start").alias("s"), F.col("end").alias("e"))
    none = F.struct(far.alias("s"), (far - 1).alias("e"))
    mark = lambda *near: F.struct(*[c[k].alias(f"{k}{i}") for i, c in enumerate(near) for k in ("s", "e")])
    here, ahead = mark(own, *before, *after), mark(none, *[none] * reach, own, *after[:-1])
    marks = covered.select("video_id", F.lag("start").over(w).isNull().alias("first"), here.alias("here"), ahead.alias("ahead"))
    marks = marks.select("video_id", F.explode(F.when(F.col("first"), F.array("ahead", "here")).otherwise(F.array("here"))).alias("near"))
    mixed = rows.withColumn("kind", F.lit(1)).unionByName(marks.withColumns({"frame": F.col("near.s0"), "kind": F.lit(0)}), allowMissingColumns=True)
    w = Window.partitionBy("video_id").orderBy("frame", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = mixed.withColumn("near", F.last("near", ignorenulls=True).over(w)).filter("kind = 1").drop("kind")

    def probed(rows: DataFrame, probe: str, free: str, near: range) -> DataFrame:
        beyond = F.lit(None).cast("long")
        for i in near:
            s, e = F.col(f"near.s{i}"), F.col(f"near.e{i}")
            beyond = F.when((s <= F.col(probe)) & (e >= F.col(probe)), F.when(F.col("side") < 0, s - 1).otherwise(e + 1)).otherwise(beyond)
        return rows.withColumn(free, F.coalesce(beyond, F.col(probe)))

    rows = probed(rows, "frame", "one", range(1)).withColumn("again", F.col("one") + F.col("side") * p.clean_stride)
    rows = probed(rows, "again", "two", range(2 * reach + 1))
    inside = lambda f: (F.col(f) >= 0) & (F.col(f) < F.col("n_frames"))
    steps = lambda f: F.abs(F.col(f) - F.col("frame"))
    hit = inside("one") & (steps("one") < p.clean_steps)
    # probes: those to the first hit, then one for each frame from the stride on
    both = hit & inside("two") & (steps("two") - p.clean_stride + 2 <= p.clean_steps)
    found = F.when(both, F.array("one", "two")).when(hit, F.array("one"))
    return rows.select("video_id", F.col("owner").alias("event_id"), F.explode(found).alias("frame"))


def covered_stretches(events: DataFrame) -> DataFrame:
    """video_id, event_id (a number), start, end: maximal stretches of frames at which the event of
    the last start has not ended."""
    w = Window.partitionBy("video_id").orderBy("start")
    ev = events.groupBy("video_id", "start").agg(F.max(F.struct("event_id", "end")).alias("m")).select("video_id", "start", F.col("m.end").alias("e"))
    ev = ev.withColumn("end", F.least("e", F.coalesce(F.lead("start").over(w) - 1, F.col("e")))).filter("end >= start")
    new = F.coalesce(F.lag("end").over(w) + 1 < F.col("start"), F.lit(True)).cast("long")
    ev = ev.withColumn("event_id", new).withColumn("event_id", F.sum("event_id").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ev.groupBy("video_id", "event_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def frame_requests(clean: DataFrame) -> DataFrame:
    """video_id, frame, n_plans, first_event, plans: which frames are needed, and by which events of
    two or more. An event is near the frames it asks for, so few ask for one."""
    of_event = Window.partitionBy("video_id", "event_id")
    again = F.coalesce(F.lag("frame").over(of_event.orderBy("frame")) == F.col("frame"), F.lit(False))
    enough = clean.select("video_id", "event_id", "frame", again.alias("again")).withColumn("n", F.count(F.when(~F.col("again"), 1)).over(of_event)).filter("n >= 2 and not again")
    at = Window.partitionBy("video_id", "frame")
    rows = enough.select("video_id", "frame", F.count("*").over(at).alias("n_plans"), F.min("event_id").over(at).alias("first_event"), F.sort_array(F.collect_list("event_id").over(at)).alias("plans"), F.row_number().over(at.orderBy("event_id")).alias("k"))
    return rows.filter("k = 1").drop("k")


def event_at_frame(frames: DataFrame, events: DataFrame) -> DataFrame:
    """frames (video_id, frame, any more) with event_id: the event of the last start at or before the
    frame, if it has not ended; else null."""
    return _last_start(frames, events).withColumn("event_id", F.when(F.col("now.e") >= F.col("frame"), F.col("now.id"))).drop("now")


def _last_start(frames: DataFrame, events: DataFrame) -> DataFrame:
    """frames with now (s, e, id), the event of the last start at or before the frame. Starts are
    carried forward within blocks of frames, so a long video is not one task's: what holds at a
    block's start comes from the blocks' own table."""
    block = lambda c: F.floor(c / FRAME_BLOCK).cast("long")
    ev = events.groupBy("video_id", "start").agg(F.max(F.struct("end", "event_id")).alias("m")).select("video_id", "start", F.struct(F.col("start").alias("s"), F.col("m.end").alias("e"), F.col("m.event_id").alias("id")).alias("ev"))
    last = ev.groupBy("video_id", block(F.col("start")).alias("b")).agg(F.max("ev").alias("last_ev"))
    blocks = frames.select("video_id", block(F.col("frame")).alias("b")).distinct()
    both = blocks.select("video_id", "b", F.lit(True).alias("asked")).join(last, ["video_id", "b"], "full_outer")
    both = both.withColumn("carried", F.last("last_ev", ignorenulls=True).over(Window.partitionBy("video_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
    carried = both.filter("asked").select("video_id", "b", "carried")
    rows = frames.withColumn("b", block(F.col("frame"))).withColumn("kind", F.lit(1))
    marks = ev.select("video_id", F.col("start").alias("frame"), block(F.col("start")).alias("b"), F.lit(0).alias("kind"), "ev")
    mixed = rows.withColumn("ev", F.lit(None).cast(ev.schema["ev"].dataType)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("video_id", "b").orderBy("frame", "kind").rowsBetween(Window.unboundedPreceding, 0)
    mixed = mixed.withColumn("now", F.last("ev", ignorenulls=True).over(w)).filter("kind = 1")
    out = mixed.join(carried, ["video_id", "b"], "left").withColumn("now", F.coalesce("now", "carried"))
    return out.drop("b", "kind", "ev", "carried")


def render_coverage(frames: DataFrame, events: DataFrame) -> DataFrame:
    """video_id, with_event, without_event: frames that show a subtitle and frames that do not."""
    at = event_at_frame(frames.select("video_id", "frame"), events)
    return at.groupBy("video_id").agg(F.count("event_id").alias("with_event"), (F.count("*") - F.count("event_id")).alias("without_event"))


def pixel_median(patches: DataFrame) -> DataFrame:
    """patches (video_id, event_id, px array<int>): per pixel position the median and max - min."""
    px = patches.select("video_id", "event_id", F.posexplode("px").alias("pos", "v"))
    return px.groupBy("video_id", "event_id", "pos").agg(F.expr("percentile(v, 0.5)").alias("med"), (F.max("v") - F.min("v")).alias("spread"))


def alpha_blend(px: DataFrame) -> DataFrame:
    """px (rgb, sub, a) with out, the integer blend."""
    return px.withColumn("out", F.floor((F.col("rgb") * F.col("a") + F.col("sub") * (255 - F.col("a")) + 127) / 255).cast("int"))


def backgrounds(clean: DataFrame, plans: DataFrame, frames: DataFrame, quality: bool = False, has_text: Callable[[np.ndarray], bool] | None = None, p: Params = DEFAULTS) -> DataFrame:
    """video_id, event_id, median, static, ring (bytes) of the events whose clean frames tell enough.
    plans: roi and mask. Regions go to the frames (see frame_index) and only cut patches move, at
    most clean_want for an event; masks meet them there."""
    spread = p.static_spread_quality if quality else p.static_spread_fast
    kind = dict(plans.dtypes)["video_id"]
    ints = ["x1", "y1", "x2", "y2"]
    masked = plans.filter("mask is not null")
    ask = clean.join(masked.select("video_id", "event_id", *[F.col(f"roi.{k}") for k in ints]), ["video_id", "event_id"])

    def crop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["patch"] = [pixels.image(r.pixels, r.h, r.w)[r.y1 : r.y2, r.x1 : r.x2].tobytes() for r in pdf.itertuples(index=False)]
            yield pdf[["video_id", "event_id", "patch"]]

    rows = asked_frames(frames, ask).select("video_id", "event_id", "h", "w", "pixels", *ints)
    patches = rows.mapInPandas(crop, f"video_id {kind}, event_id long, patch binary")

    def make(got: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=["video_id", "event_id", "median", "static", "ring"])
        if plan.empty:
            return none
        r = plan.iloc[0]
        h, w = r.y2 - r.y1, r.x2 - r.x1
        back = pixels.background([pixels.image(x, h, w) for x in got["patch"]], np.frombuffer(r["mask"], np.uint8).reshape(h, w).astype(bool), spread)
        if back is None or has_text is not None and has_text(back[0]):
            return none
        return pd.DataFrame([(r.video_id, r.event_id, back[0].tobytes(), back[1].astype(np.uint8).tobytes(), back[2].astype(np.uint8).tobytes())], columns=none.columns)

    regions = masked.select("video_id", "event_id", "mask", *[F.col(f"roi.{k}") for k in ints])
    of = ("video_id", "event_id")
    return patches.groupBy(*of).cogroup(regions.groupBy(*of)).applyInPandas(make, f"video_id {kind}, event_id long, median binary, static binary, ring binary")


def shown_stretches(events: DataFrame) -> DataFrame:
    """video_id, event_id, lo, hi: the frames at which each event is the one of the last start and has
    not ended; of equal starts the later end counts, then the larger id. They are disjoint."""
    w = Window.partitionBy("video_id").orderBy("lo")
    ev = events.groupBy("video_id", F.col("start").alias("lo")).agg(F.max(F.struct("end", "event_id")).alias("m"))
    hi = F.least("m.end", F.coalesce(F.lead("lo").over(w) - 1, F.col("m.end")))
    return ev.select("video_id", F.col("m.event_id").alias("event_id"), "lo", hi.alias("hi")).filter("hi >= lo")


def composite(frames: DataFrame, events: DataFrame, plans: DataFrame, fill: Callable = pixels.neighbour_fill, p: Params = DEFAULTS) -> DataFrame:
    """frames with new pixels and failed. plans (video_id, event_id): roi, mask, median, static, ring,
    overlay (RGBA in the frame's channel order), overlay_x, overlay_y, overlay_h, overlay_w. A frame
    on which the work fails stays as it was. A plan goes once to each block of frames that shows its
    event; frames of a bucketed table do not move (see frame_index)."""
    kind = dict(frames.dtypes)["video_id"]
    shown = shown_stretches(events).join(plans, ["video_id", "event_id"])
    rows = frames_with(frames, shown, [c for c in plans.columns if c not in ("video_id", "event_id")])
    rows = rows.select("*", F.col("roi.x1"), F.col("roi.y1"), F.col("roi.x2"), F.col("roi.y2")).drop("roi")
    known = lambda v: v is not None and v == v

    def one(r) -> bytes:
        frame = pixels.image(r.pixels, r.h, r.w)
        roi = mask = back = overlay = None
        if known(r.x1) and known(r.mask):
            roi = tuple(int(v) for v in (r.x1, r.y1, r.x2, r.y2))
            h, w = roi[3] - roi[1], roi[2] - roi[0]
            bits = lambda b: np.frombuffer(b, np.uint8).reshape(h, w).astype(bool)
            mask = bits(r.mask)
            if known(r.median):
                back = pixels.image(r.median, h, w), bits(r.static), bits(r.ring)
        if known(r.overlay):
            overlay = np.frombuffer(r.overlay, np.uint8).reshape(int(r.overlay_h), int(r.overlay_w), 4)
        at = (int(r.overlay_x), int(r.overlay_y)) if overlay is not None else None
        return pixels.composite(frame, roi, mask, back, overlay, at, p.ring_diff_max, fill).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, failed = [], []
            for r in pdf.itertuples(index=False):
                try:
                    out.append(one(r))
                    failed.append(False)
                except Exception:  # the frame stays as it was, and is counted
                    out.append(r.pixels)
                    failed.append(True)
            yield pd.DataFrame({"video_id": pdf["video_id"], "frame": pdf["frame"], "h": pdf["h"], "w": pdf["w"], "pixels": out, "failed": failed})

    return rows.mapInPandas(run, f"video_id {kind}, frame long, h int, w int, pixels binary, failed boolean")
