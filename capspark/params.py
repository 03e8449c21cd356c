"""Parameters of all stages. The defaults are fixed values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    crop_ratio: float = 0.45
    sample_step_sec: float = 0.3
    thumb_scale: int = 8
    det_scale: int = 2
    min_event_frames: int = 5
    merge_gap_frames: int = 10
    min_ocr_conf: float = 0.60
    batch: int = 8
    history: int = 5
    min_box_h: int = 16
    min_box_w: int = 40
    same_thresh: float = 14.0
    jump_min: float = 2.5
    overlap_margin: int = 24
    early_stop_conf: float = 0.75
    text_gap: int = 12
    text_ratio: float = 0.85
    ascii_share: float = 0.7
    max_names: int = 20
    max_name_len: int = 8
    max_translated_name_len: int = 12
    clean_margin: int = 6
    clean_steps: int = 150
    clean_want: int = 4
    clean_stride: int = 5
    ring_diff_max: float = 11.0
    static_spread_fast: int = 14
    static_spread_quality: int = 10
    append_font_scale: float = 0.50
    replace_font_scale: float = 0.82


DEFAULTS = Params()

#: Stages in the order in which they run, and the four that are shown.
STAGES = ("probe", "detect", "events", "ocr", "translate", "render")
SHOWN = ("detect", "ocr", "translate", "render")
VIDEO_SUFFIXES = ("mp4", "mkv", "avi", "mov", "ts", "webm")
