"""From samples to subtitle events: islands of text, cut where the picture changes, with exact ends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capspark.functions import columns as C
from capspark.operators.block_fold import blocked_fold
from capspark.params import DEFAULTS, Params
from capspark.sources.shared import written


def _video(*more: str) -> Window:
    return Window.partitionBy("video_id", *more).orderBy("frame")


def with_islands(samples: DataFrame) -> DataFrame:
    """Samples with text (video_id, frame, bbox not null) with island and prev_empty, the last
    sample before the island that has no text."""
    w = _video()
    has = F.col("bbox").isNotNull()
    starts = (has & ~F.coalesce(F.lag(has).over(w), F.lit(False))).cast("int")
    rows = samples.withColumn("__starts", starts).withColumn("prev_empty", F.last(F.when(~has, F.col("frame")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("island", F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return rows.filter(has).drop("__starts")


def text_islands(samples: DataFrame) -> DataFrame:
    """One row for each maximal run of samples with text: first_s, last_s, prev_empty, bbox."""
    return with_islands(samples).groupBy("video_id", "island").agg(F.min("frame").alias("first_s"), F.max("frame").alias("last_s"), F.min("prev_empty").alias("prev_empty"), C.union_box_agg(F.col("bbox")).alias("bbox"))


def region_diff(pairs: DataFrame, thumbs: DataFrame, out: str = "d") -> DataFrame:
    """pairs (video_id, f, g, rect) with the mean absolute gray difference of the thumbnails of
    frames f and g inside rect. thumbs: px array<int> or pixels binary, tw. Two equi-joins by frame: few
    pairs are sent to the thumbnails, with many the narrow thumbnails are shuffled."""
    px = F.col("px") if "px" in thumbs.columns else F.col("pixels")
    t = thumbs.select("video_id", "frame", "tw", px.alias("px"))
    a = t.select("video_id", F.col("frame").alias("f"), F.col("tw").alias("__tw"), F.col("px").alias("__a"))
    b = t.select("video_id", F.col("frame").alias("g"), F.col("px").alias("__b"))
    rows = pairs.join(a, ["video_id", "f"]).join(b, ["video_id", "g"])
    if dict(t.dtypes)["px"] == "binary":

        @F.pandas_udf("double")
        def diff(x: pd.Series, y: pd.Series, tw: pd.Series, r: pd.DataFrame) -> pd.Series:
            return pd.Series([_diff(np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8), w, s) for p, q, w, s in zip(x, y, tw, r.itertuples(index=False), strict=True)])

        d = diff("__a", "__b", "__tw", "rect")
    else:
        d = C.mean_abs_diff(C.rect_pixels(F.col("__a"), F.col("__tw"), F.col("rect")), C.rect_pixels(F.col("__b"), F.col("__tw"), F.col("rect")))
    return rows.withColumn(out, d).drop("__a", "__b", "__tw")


def _diff(a: np.ndarray, b: np.ndarray, tw: int, r) -> float:
    x1, y1, x2, y2 = r
    cut = lambda v: np.asarray(v, np.int16).reshape(-1, tw)[y1:y2, x1:x2]
    return float(np.abs(cut(a) - cut(b)).mean())


def _rect(b: tuple, crop_y: int, tw: int, th: int, scale: int) -> tuple:
    """The thumbnail rectangle of a box; C.thumb_rect for one row."""
    x1, y1 = max(0, b[0] // scale), max(0, (b[1] - crop_y) // scale)
    x2, y2 = min(tw, (b[2] + scale - 1) // scale), min(th, (b[3] - crop_y + scale - 1) // scale)
    return x1, y1, max(x2, x1 + 1), max(y2, y1 + 1)


def _join(a: tuple, b: tuple) -> tuple:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def _runs_of_cuts(rows: DataFrame) -> DataFrame:
    """rows (video_id, island, frame, f: the frame before in the island, prev_empty, bbox, cut) as runs."""
    w = _video("island")
    rows = rows.withColumn("sub", F.sum(F.col("cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("video_id", "island", "sub").agg(
        F.min("frame").alias("first_s"),
        F.max("frame").alias("last_s"),
        F.min(F.when(F.col("sub") == 0, F.col("prev_empty"))).alias("prev_empty"),
        F.min(F.when(F.col("cut"), F.col("f"))).alias("split_from"),
        C.union_box_agg(F.col("bbox")).alias("bbox"),
    ).drop("island", "sub")


#: Samples of an island, and events of a chain, that are folded together.
SAMPLES, EVENTS = 2048, 64
_BOX = {"x1": "int", "y1": "int", "x2": "int", "y2": "int"}


def _grown(w: Window) -> dict:
    return {k: (F.min if k in ("x1", "y1") else F.max)(k).over(w) for k in _BOX}


def split_runs(samples: DataFrame, thumbs: DataFrame, geo: DataFrame, p: Params = DEFAULTS, block: int = SAMPLES) -> DataFrame:
    """Runs of one picture: inside an island a run ends where the next sample differs, within the
    box of the whole run so far, by same_thresh or more. video_id, first_s, last_s, prev_empty (of
    an island's first run), split_from, bbox. Islands that cannot split, of one sample, do not go
    to Python; others go in blocks of samples, so a video that is one island is folded on many tasks
    (see block_fold). Only narrow rows are put in order by windows."""
    px = "px" if "px" in thumbs.columns else "pixels"
    rows = with_islands(samples.withColumn("bbox", C.union_box(F.col("boxes"))) if "bbox" not in samples.columns else samples)
    w = _video("island")
    rows = rows.select("video_id", F.col("frame").cast("long").alias("frame"), "island", F.col("prev_empty").cast("long").alias("prev_empty"), "bbox")
    rows = rows.withColumn("f", F.lag("frame").over(w)).withColumn("blk", F.floor((F.row_number().over(w) - 1) / block).cast("long"))
    rows = written(rows.withColumn("__n", F.count("*").over(Window.partitionBy("video_id", "island"))), "islands")
    g = geo.select("video_id", "crop_y", "thumb_w", "thumb_h")
    t = thumbs.select("video_id", F.col("frame").cast("long").alias("frame"), F.col(px).alias("px"))
    many = rows.filter("__n > 1")
    starts = many.filter("blk > 0").groupBy("video_id", "island", "blk").agg(F.min("frame").alias("frame"), F.min("f").alias("f"))
    before = starts.join(t.select("video_id", F.col("frame").alias("f"), F.col("px").alias("before")), ["video_id", "f"]).drop("f")
    many = many.join(t, ["video_id", "frame"]).join(g, "video_id").select("video_id", "island", "blk", "frame", "bbox.*", "px", "crop_y", "thumb_w", "thumb_h")
    many = many.join(before, ["video_id", "island", "blk", "frame"], "left")
    pixels = lambda v: np.frombuffer(v, np.uint8) if isinstance(v, bytes) else np.asarray(v)

    def fold(pdf: pd.DataFrame, _) -> list[tuple]:
        out, state, own, last = [], None, None, None
        for r in pdf.itertuples(index=False):
            now, box = pixels(r.px), (int(r.x1), int(r.y1), int(r.x2), int(r.y2))
            if last is None and not pd.isna(r.e_x1):
                state, last = (int(r.e_x1), int(r.e_y1), int(r.e_x2), int(r.e_y2)), pixels(r.before)
            cut = False
            if state is not None:
                both = _join(state, box)
                cut = _diff(last, now, r.thumb_w, _rect(both, r.crop_y, r.thumb_w, r.thumb_h, p.thumb_scale)) >= p.same_thresh
            own = box if cut or own is None else _join(own, box)
            state, last = box if cut or state is None else both, now
            out.append((r.frame, cut, *own))
        return out

    cuts = blocked_fold(many, rows.filter("__n > 1"), ["video_id", "island"], "frame", _BOX, _grown, fold)
    cut = rows.join(cuts, ["video_id", "island", "frame"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    return _runs_of_cuts(cut)


def split_runs_pairwise(samples: DataFrame, thumbs: DataFrame, geo: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Runs cut where two neighbouring samples differ within the union of their own boxes: no state,
    windows only. Columns as split_runs."""
    rows = with_islands(samples).select("video_id", "frame", "island", "prev_empty", "bbox")
    w = _video("island")
    rows = rows.withColumn("f", F.lag("frame").over(w)).withColumn("__pb", F.lag("bbox").over(w))
    g = geo.select("video_id", F.col("crop_y").alias("__cy"), F.col("thumb_w").alias("__w"), F.col("thumb_h").alias("__h"))
    ask = rows.filter("f is not null").join(g, "video_id").select("video_id", "f", F.col("frame").alias("g"), C.thumb_rect(C.join_boxes(F.col("__pb"), F.col("bbox")), F.col("__cy"), F.col("__w"), F.col("__h"), p.thumb_scale).alias("rect"))
    d = region_diff(ask, thumbs).select("video_id", F.col("g").alias("frame"), "d")
    rows = rows.join(d, ["video_id", "frame"], "left")
    cut = F.coalesce(F.col("d") >= p.same_thresh, F.lit(False))
    return _runs_of_cuts(rows.withColumn("cut", cut))


def snap(asks: DataFrame, thumbs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """asks (video_id, ask, lo, hi, rect) as (video_id, ask, at): the frame in (lo, hi] where the
    picture jumps most, the later of equals; hi if it jumps by less than jump_min, or if there is
    no choice. Only the frames between the bounds are joined."""
    free = asks.filter("hi > lo + 1").select("video_id", "ask", "hi", "rect", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))).alias("g")).withColumn("f", F.col("g") - 1)
    best = region_diff(free, thumbs).groupBy("video_id", "ask").agg(F.max(F.struct("d", "g")).alias("m"))
    out = asks.join(best, ["video_id", "ask"], "left")
    return out.select("video_id", "ask", F.when(F.col("m.d") >= p.jump_min, F.col("m.g")).otherwise(F.col("hi")).cast("long").alias("at"))


def event_bounds(runs: DataFrame, thumbs: DataFrame, geo: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Runs as events with exact inclusive ends: video_id, start, end, bbox. geo: step, n_frames. The
    runs, which are read for each of their ends and again at last, are written once."""
    g = geo.select("video_id", "step", "n_frames", F.col("crop_y").alias("__cy"), F.col("thumb_w").alias("__w"), F.col("thumb_h").alias("__h"))
    w = Window.partitionBy("video_id").orderBy("first_s")
    r = runs.join(g, "video_id").withColumn("rect", C.thumb_rect(F.col("bbox"), F.col("__cy"), F.col("__w"), F.col("__h"), p.thumb_scale)).withColumn("run", F.row_number().over(w).cast("long"))
    r = written(r, "runs")
    a, z = F.col("first_s"), F.col("last_s")
    q = F.when(a == 0, F.lit(0)).otherwise(F.greatest(F.lit(0).cast("long"), a - F.col("step") + 1))
    before = F.coalesce(F.col("split_from"), F.col("prev_empty"), F.when(q > 0, q - 1))
    r = r.withColumn("lo_a", before.cast("long")).withColumn("hi_z", F.least(z + F.col("step"), F.col("n_frames") - 1).cast("long"))
    asks = r.filter("lo_a is not null").select("video_id", (F.col("run") * 2).alias("ask"), F.col("lo_a").alias("lo"), a.cast("long").alias("hi"), "rect")
    asks = asks.unionByName(r.select("video_id", (F.col("run") * 2 + 1).alias("ask"), z.cast("long").alias("lo"), F.col("hi_z").alias("hi"), "rect"))
    at = snap(asks, thumbs, p).select("video_id", F.floor(F.col("ask") / 2).alias("run"), (F.col("ask") % 2).alias("is_end"), "at")
    at = at.groupBy("video_id", "run").agg(F.max(F.when(F.col("is_end") == 0, F.col("at"))).alias("s"), F.max(F.when(F.col("is_end") == 1, F.col("at"))).alias("e"))
    r = r.join(at, ["video_id", "run"]).withColumn("start", F.coalesce("s", F.lit(0).cast("long")))
    follows = F.lead("split_from").over(w) == z
    end = F.when(follows, F.lead("start").over(w) - 1).otherwise(F.greatest(z, F.col("e") - 1))
    return r.withColumn("end", end).select("video_id", "start", F.least("end", F.col("n_frames") - 1).cast("long").alias("end"), "bbox")


def with_chains(events: DataFrame, low: int, high: int) -> DataFrame:
    """events with chain: neighbours whose gap lies in low..high share it. The gap needs only the
    direct predecessor, whatever merges, so this cut is exact."""
    w = Window.partitionBy("video_id").orderBy("start", "end")
    gap = F.col("start") - F.lag("end").over(w)
    new = F.coalesce(~gap.between(low, high), F.lit(True)).cast("int")
    return events.withColumn("__new", new).withColumn("chain", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def merge_flicker(events: DataFrame, thumbs: DataFrame, geo: DataFrame, p: Params = DEFAULTS, block: int = EVENTS) -> DataFrame:
    """Neighbours with a gap of 0..merge_gap_frames whose middle frames look alike become one event.
    A merged event's middle moves, so a chain is folded in order, in blocks of events (see
    block_fold). A block asks for the middle frames of its own stretches and of those that begin
    with the event it is handed, block * (block + 3) / 2 at most. Events alone in their chain do not
    go to Python."""
    px = "px" if "px" in thumbs.columns else "pixels"
    t = thumbs.select("video_id", F.col("frame").cast("long").alias("frame"), F.col(px).alias("px"))
    rows = with_chains(events.select("video_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "bbox"), 0, p.merge_gap_frames)
    w = Window.partitionBy("video_id", "chain").orderBy("start", "end", "bbox")
    rows = rows.withColumn("row", F.row_number().over(w).cast("long")).withColumn("before", F.lag("end").over(w))
    rows = rows.withColumn("blk", F.floor((F.col("row") - 1) / block).cast("long")).withColumn("__n", F.count("*").over(Window.partitionBy("video_id", "chain")))
    rows = written(rows, "chains")
    g = geo.select("video_id", "crop_y", "thumb_w", "thumb_h")
    many = rows.filter("__n > 1").join(g, "video_id").select("video_id", "chain", "blk", "row", "start", "end", "before", "bbox.*", "crop_y", "thumb_w", "thumb_h")
    at = ["video_id", "chain", "blk"]
    state = {"start": "long", **_BOX}

    def add_up(over: Window) -> dict:
        return {"start": F.first("start").over(over), **_grown(over)}

    def middles(part: DataFrame) -> DataFrame:
        """The thumbnails that a block may compare."""
        ends = part.select(*at, F.explode(F.array("end", "before")).alias("z")).filter("z is not null")
        begins = part.select(*at, F.explode(F.array("start", "e_start")).alias("a")).filter("a is not null").distinct()
        mids = begins.join(ends.distinct(), at).filter("a <= z").select(*at, F.floor((F.col("a") + F.col("z")) / 2).alias("frame")).distinct()
        return mids.join(t, ["video_id", "frame"]).select(*at, "frame", "px")

    def fold(pdf: pd.DataFrame, side: pd.DataFrame) -> list[tuple]:
        px = {f: np.frombuffer(x, np.uint8) if isinstance(x, bytes) else np.asarray(x) for f, x in zip(side["frame"], side["px"], strict=True)}
        out, event, own = [], None, None  # event: start, end and box so far
        for r in pdf.itertuples(index=False):
            start, end, box = int(r.start), int(r.end), (int(r.x1), int(r.y1), int(r.x2), int(r.y2))
            if event is None and not pd.isna(r.e_start):
                event = (int(r.e_start), int(r.before), (int(r.e_x1), int(r.e_y1), int(r.e_x2), int(r.e_y2)))
            cut = False
            if event is not None:
                both = _join(event[2], box)
                a, b = px.get((event[0] + event[1]) // 2), px.get((start + end) // 2)
                cut = a is None or b is None or _diff(a, b, r.thumb_w, _rect(both, r.crop_y, r.thumb_w, r.thumb_h, p.thumb_scale)) >= p.same_thresh
            own = (start, box) if cut or own is None else (own[0], _join(own[1], box))
            event = (start, end, box) if cut or event is None else (event[0], end, both)
            out.append((r.row, cut, own[0], *own[1]))
        return out

    cuts = blocked_fold(many, rows, ["video_id", "chain"], "row", state, add_up, fold, side=middles)
    merged = rows.join(cuts, ["video_id", "chain", "row"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)).cast("int"))
    merged = merged.withColumn("event", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy("video_id", "chain", "event").agg(F.min("start").alias("start"), F.max_by("end", "row").alias("end"), C.union_box_agg(F.col("bbox")).alias("bbox")).drop("chain", "event")


def merge_by_gap(events: DataFrame, max_gap: int = DEFAULTS.merge_gap_frames) -> DataFrame:
    """Neighbours with a gap of 0..max_gap become one event, whatever they show."""
    return with_chains(events, 0, max_gap).groupBy("video_id", "chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), C.union_box_agg(F.col("bbox")).alias("bbox")).drop("chain")


def drop_short_and_number(events: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Events of at least min_event_frames, numbered 0.. in order in each video."""
    kept = events.filter(F.col("end") - F.col("start") + 1 >= p.min_event_frames)
    return kept.withColumn("event_id", (F.row_number().over(Window.partitionBy("video_id").orderBy("start", "end")) - 1).cast("long"))


def flat_box(df: DataFrame, col: str = "bbox") -> DataFrame:
    """The box as four int columns."""
    return df.select(*[c for c in df.columns if c != col], *[F.col(f"{col}.{k}").cast("int").alias(k) for k in ("x1", "y1", "x2", "y2")])

