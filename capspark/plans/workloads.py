"""The three workloads, stage after stage; each takes and gives DataFrames."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capspark.functions import columns as C
from capspark.operators import detect, reads, render, review, segment, translate
from capspark.params import DEFAULTS, Params
from capspark.sources.ledger import Ledger


def samples_to_events(samples: DataFrame, thumbs: DataFrame, geo: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Numbered subtitle events with exact ends. samples: video_id, frame, boxes. A video without any
    text gives no rows."""
    filled = detect.with_union_box(detect.valid_boxes(detect.fill_missing_samples(samples, geo), p))
    runs = segment.split_runs(filled, thumbs, geo, p)
    events = segment.merge_flicker(segment.event_bounds(runs, thumbs, geo, p), thumbs, geo, p)
    return segment.drop_short_and_number(events, p)


def best_reads(events: DataFrame, frames: DataFrame, reader: Callable, p: Params = DEFAULTS) -> DataFrame:
    """The read of each event that counts, with its text, box and line height, and start and end."""
    asked = reads.read_text(frames, reads.candidate_frames(events), reader)
    best = reads.assemble(reads.best_read(reads.keep_lines(asked, events, p), p))
    return best.join(events.select("video_id", "event_id", "start", "end"), ["video_id", "event_id"])


def subtitles(best: DataFrame, styles: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """best_reads() with their styles as subtitles for all later stages: boxes of the lines, style,
    glyph_rect and mask_key come with the read that is kept. Equal neighbours become one."""
    subs = reads.with_styles(best, styles).withColumn("boxes", F.transform("lines", lambda x: x["box"]))
    return reads.merge_same_text(subs.drop("event_id", "attempt"), p)


def events_to_subtitles(events: DataFrame, frames: DataFrame, reader: Callable, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Subtitles, and the table of their glyph masks. Both are made from the reads and styles, so a
    caller that uses both stores these first, as the job does."""
    best = best_reads(events, frames, reader, p)
    styles = reads.with_mask_keys(reads.text_style(best, frames))
    return subtitles(best, styles, p), reads.mask_table(styles)


def subtitles_to_translations(subs: DataFrame, done: DataFrame, model: Callable, name_model: Callable, ledger: Ledger, p: Params = DEFAULTS) -> DataFrame:
    """done, and the pending subtitles translated."""
    langs = translate.detect_lang(subs, p=p)
    names = translate.speaker_names(subs, p)
    entries = translate.glossary_text(translate.glossary(names, translate.ask_names(names, name_model), p))
    return translate.upsert(done, translate.translate(subs, done, entries, langs, model, ledger, p))


def subtitles_to_review(subs: DataFrame, done: DataFrame, videos: DataFrame, model: Callable, name_model: Callable, ledger: Ledger, p: Params = DEFAULTS) -> DataFrame:
    """The review table, with the pending subtitles translated."""
    return review.review_table(subs, subtitles_to_translations(subs, done, model, name_model, ledger, p), videos)


def overlays(subs: DataFrame, translations: DataFrame, width: Callable[[str, int], float], draw: Callable, mode: str = "replace", p: Params = DEFAULTS) -> DataFrame:
    """video_id, event_id, overlay (RGBA bytes), overlay_x, overlay_y, overlay_h, overlay_w of the
    subtitles (with width, height) whose translation is not blank. draw(lines, size, stroke, gap,
    fill, outline, h, w) gives the picture of a canvas as an array of h x w x 4."""
    rows = subs.select("video_id", "event_id", "bbox", "line_h", "style", "width", "height").join(translations.select("video_id", "event_id", "zh"), ["video_id", "event_id"]).withColumn("zh", C.strip(F.col("zh"))).filter("zh <> ''")
    rows = render.wrap_text(render.font_spec(rows, mode, p), width).withColumn("n_lines", F.size("lines"))
    placed = render.place_overlay(rows.select("video_id", "event_id", "bbox", "width", "height", "size", "stroke", "gap", "text_w", "n_lines", "lines", "style.fill", "style.outline"), mode)

    @F.pandas_udf("binary")
    def drawn(lines: pd.Series, size: pd.Series, stroke: pd.Series, gap: pd.Series, fill: pd.Series, outline: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        white, ink = [255] * 3, [16] * 3
        rows = zip(lines, size, stroke, gap, fill, outline, h, w, strict=True)
        return pd.Series([np.asarray(draw(list(t), s, k, g, white if f is None else list(f), ink if o is None else list(o), y, x), np.uint8).tobytes() for t, s, k, g, f, o, y, x in rows])

    h, w = F.col("canvas_y2") - F.col("canvas_y1"), F.col("canvas_x2") - F.col("canvas_x1")
    placed = placed.withColumns({"overlay_h": h, "overlay_w": w}).filter("overlay_h > 0 and overlay_w > 0")
    return placed.select("video_id", "event_id", drawn("lines", "size", "stroke", "gap", "fill", "outline", "overlay_h", "overlay_w").alias("overlay"), F.col("canvas_x1").alias("overlay_x"), F.col("canvas_y1").alias("overlay_y"), "overlay_h", "overlay_w")


def render_frames(frames: DataFrame, subs: DataFrame, glyph_masks: DataFrame, overlays: DataFrame, n_frames: DataFrame, quality: bool = False, p: Params = DEFAULTS) -> DataFrame:
    """Composited frames. subs (video_id, event_id, start, end): boxes of their lines, glyph_rect,
    mask_key, width, height; overlays: rendered text and its place."""
    plans = render.overlay_plans(subs, glyph_masks, overlays)
    backs = render.backgrounds(render.clean_frames(subs, n_frames, p), plans, frames, quality, p=p)
    return render.composite(frames, subs, plans.join(backs, ["video_id", "event_id"], "left"), p=p)
