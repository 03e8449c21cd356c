"""Column functions: boxes, thumbnails, text rules. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
#: What ends a line, and what counts as blank (fixed values, as Java patterns).
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
_BLANK = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(text: Column) -> Column:
    """Without Unicode blanks at the ends."""
    return F.regexp_replace(text, _BLANK, "")


def lines_of(text: Column) -> Column:
    """The stripped lines of a text that are not empty."""
    return F.filter(F.transform(F.split(text, LINE_END, -1), strip), lambda x: x != "")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), x2.cast("int").alias("x2"), y2.cast("int").alias("y2"))


def union_box(boxes: Column) -> Column:
    """The bounding box of an array of boxes; null if there are none."""
    side = lambda f, k: f(F.transform(boxes, lambda b: b[k]))
    return F.when(F.size(boxes) > 0, box(side(F.array_min, "x1"), side(F.array_min, "y1"), side(F.array_max, "x2"), side(F.array_max, "y2")))


def join_boxes(a: Column, b: Column) -> Column:
    return box(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def union_box_agg(b: Column) -> Column:
    """The bounding box over the rows of a group or window frame's aggregate."""
    return box(F.min(b["x1"]), F.min(b["y1"]), F.max(b["x2"]), F.max(b["y2"]))


def thumb_rect(b: Column, crop_y: Column, tw: Column, th: Column, scale: int = 8) -> Column:
    """A box on the thumbnail grid, at least one cell in size."""
    cell = lambda v: F.floor(v / scale).cast("int")
    x1, y1 = F.greatest(F.lit(0), cell(b["x1"])), F.greatest(F.lit(0), cell(b["y1"] - crop_y))
    x2 = F.greatest(F.least(tw, cell(b["x2"] + (scale - 1))), x1 + 1)
    y2 = F.greatest(F.least(th, cell(b["y2"] - crop_y + (scale - 1))), y1 + 1)
    return box(x1, y1, x2, y2)


def rect_pixels(px: Column, tw: Column, r: Column) -> Column:
    """The pixels (array<int>, row by row) of a thumbnail inside a rectangle."""
    rows = F.sequence(r["y1"], r["y2"] - 1)
    return F.flatten(F.transform(rows, lambda y: F.slice(px, y * tw + r["x1"] + 1, r["x2"] - r["x1"])))


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two int arrays of one length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return total / F.size(a)


def fmt_duration(sec: Column) -> Column:
    """Whole seconds as hours, minutes and seconds, without the parts that are zero at the front."""
    s = F.floor(sec).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    part = lambda v, unit: F.when(v > 0, F.concat(v.cast("string"), F.lit(unit))).otherwise("")
    return F.concat(part(h, "小时"), part(m, "分"), F.when((r > 0) | (s < 60), F.concat(r.cast("string"), F.lit("秒"))).otherwise(""))
