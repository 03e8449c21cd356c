"""Folds against plain loops, edge rows, pixel helpers, stored stages and streams."""

from __future__ import annotations

import random
import tempfile
import time
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from capspark.functions import columns as C
from capspark.functions import pixels
from capspark.operators import detect, reads, render, segment, translate
from capspark.plans import workloads
from capspark.sources import ingest
from capspark.sources.ledger import Ledger
from capspark.streaming import live

DIR = "/root/testdata/sf0.001"
GEO = "video_id long, n_frames long, step int, crop_y int, thumb_w int, thumb_h int"
BOXED = f"video_id long, frame long, bbox {C.BOX}"
EVENTS = f"video_id long, start long, end long, bbox {C.BOX}"


def value(v):
    return str(v) if not isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.split("_")[0].rstrip("b0123456789") in ("src", "det", "evt", "w", "ocr", "trn", "rev", "sta", "rnd", "str")))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted(tuple(value(r[c]) for c in cols) for r in df.collect())
    rows = want.fetchall()
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(value(r[i]) for i in at) for r in rows)


def test_relocate_of_repeated_urls_equals_its_sql(spark, tmp_path):
    kind = "page_id long, url string, html string"
    pages = [(1, "https://a/x", "one"), (2, "https://a/x", "three"), (3, "https://b/x", "three"), (4, "http://c/x", "one"), (None, "https://d/x", "one"), (6, "https://e/", ""), (6, "https://e/", ""), (7, None, "one"), (8, "https://f/x", None), (None, "https://g/y", "y")]
    spark.createDataFrame(pages, kind).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    df = entry.queries()["src3_relocate"](spark, str(tmp_path))
    want = con.sql(entry.oracle_sql()["src3_relocate"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())
    assert ("/uploads/1", "x", 5, "https://b/x") in want and (None, "x", 3, "https://a/x") in want


def test_frame_requests_shuffle_once_and_equal_their_sql(spark, tmp_path):
    rng = random.Random(7)
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"
    day = datetime(2000, 1, 1)
    rows = [(i, rng.choice([i, 40 * i, 40 * i + 3]), rng.choice([1, 1, 2, 3, None]), 8, float(rng.randint(0, 60)), 1.0, day + timedelta(days=rng.randint(0, 20))) for i in range(600)]
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("rnd6_clean_frames", "rnd7_frame_requests"):
        df = entry.queries()[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(video_id") == plan.count("Exchange") == 2  # one is reused
        want = con.sql(entry.oracle_sql()[name])
        assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in want.columns)) for r in df.collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def thumbs_of(rng, videos, n, tw=4, th=4):
    rows, level = [], 100
    for v in range(videos):
        for f in range(n):
            if rng.random() < 0.3:
                level = rng.randint(60, 190)
            rows.append((v, f, th, tw, bytes(min(255, max(0, level + rng.randint(-2, 2))) for _ in range(tw * th))))
    return rows


def plain_diff(a, b, rect, tw=4):
    x1, y1, x2, y2 = rect
    cut = lambda p: np.frombuffer(p, np.uint8).astype(int).reshape(-1, tw)[y1:y2, x1:x2]
    return np.abs(cut(a) - cut(b)).mean()


def plain_rect(b, tw=4, th=4):
    x1, y1, x2, y2 = max(0, b[0] // 8), max(0, b[1] // 8), min(tw, (b[2] + 7) // 8), min(th, (b[3] + 7) // 8)
    return x1, y1, max(x2, x1 + 1), max(y2, y1 + 1)


def joined(a, b):
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def plain_runs(samples, thumb):
    out, run, empty = [], None, None
    for f, b in samples:
        if b is None:
            out += [run] if run else []
            run, empty = None, f
        elif run is None:
            run = [f, f, empty, None, b]
        else:
            both = joined(run[4], b)
            if plain_diff(thumb[run[1]], thumb[f], plain_rect(both)) < 14:
                run[1], run[4] = f, both
            else:
                out.append(run)
                run = [f, f, None, run[1], b]
    return [tuple(r) for r in out + ([run] if run else [])]


def scene(spark, seed, videos=3, n=60):
    rng = random.Random(seed)
    rows = thumbs_of(rng, videos, n)
    samples = []
    for v in range(videos):
        for f in range(0, n, 3):
            x, y = rng.randint(0, 20), rng.randint(0, 20)
            samples.append((v, f, None if rng.random() < 0.25 else (x, y, x + rng.randint(4, 12), y + rng.randint(4, 12))))
    thumbs = spark.createDataFrame(rows, "video_id long, frame long, th int, tw int, pixels binary").repartition(3)
    geo = spark.createDataFrame([(v, n, 3, 0, 4, 4) for v in range(videos)], GEO)
    return rows, samples, thumbs, geo


@pytest.mark.parametrize("seed", range(4))
def test_split_and_bounds_equal_a_loop(spark, seed):
    rows, samples, thumbs, geo = scene(spark, seed)
    got = segment.split_runs(spark.createDataFrame(samples, BOXED).repartition(2), thumbs, geo)
    want, n = [], 60
    ends = []
    for v in range(3):
        thumb = {r[1]: r[4] for r in rows if r[0] == v}
        runs = plain_runs([(f, b) for w, f, b in samples if w == v], thumb)
        want += [(v, *r) for r in runs]

        def snap(lo, hi, rect, thumb=thumb):
            if hi <= lo + 1:
                return hi
            d, f = max((plain_diff(thumb[f - 1], thumb[f], rect), f) for f in range(lo + 1, hi + 1))
            return f if d >= 2.5 else hi

        starts = []
        for a, _, e, s, b in runs:
            q = 0 if a == 0 else max(0, a - 2)
            lo = s if s is not None else e if e is not None else q - 1 if q > 0 else None
            starts.append(0 if lo is None else snap(lo, a, plain_rect(b)))
        for i, (_, z, _, _, b) in enumerate(runs):
            if i + 1 < len(runs) and runs[i + 1][3] == z:
                end = starts[i + 1] - 1
            else:
                end = max(z, snap(z, min(z + 3, n - 1), plain_rect(b)) - 1)
            ends.append((v, starts[i], min(end, n - 1), tuple(b)))
    flat = [(r["video_id"], r["first_s"], r["last_s"], r["prev_empty"], r["split_from"], tuple(r["bbox"])) for r in got.collect()]
    assert sorted(flat, key=str) == sorted(want, key=str)
    bounds = segment.event_bounds(got, thumbs, geo)
    assert sorted((r["video_id"], r["start"], r["end"], tuple(r["bbox"])) for r in bounds.collect()) == sorted(ends)


@pytest.mark.parametrize("seed", range(3))
def test_merge_flicker_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    rows, _, thumbs, geo = scene(spark, seed, n=90)
    events = []
    for v in range(3):
        at = 0
        while at < 80:
            end = at + rng.randint(0, 6)
            events.append((v, at, end, (8, 8, 24, 24)))
            at = end + rng.choice([0, 1, 2, 5, 10, 11, 14])
    want = []
    for v in range(3):
        thumb = {r[1]: r[4] for r in rows if r[0] == v}
        kept = []
        for _, s, e, b in (x for x in events if x[0] == v):
            if kept:
                p = kept[-1]
                if 0 <= s - p[1] <= 10 and plain_diff(thumb[(p[0] + p[1]) // 2], thumb[(s + e) // 2], plain_rect(joined(p[2], b))) < 14:
                    p[1], p[2] = e, joined(p[2], b)
                    continue
            kept.append([s, e, b])
        want += [(v, *k) for k in kept]
    got = segment.merge_flicker(spark.createDataFrame(events, EVENTS), thumbs, geo)
    assert sorted((r["video_id"], r["start"], r["end"], tuple(r["bbox"])) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_merge_same_text_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    subs = []
    for v in range(3):
        at = 0
        for _ in range(40):
            n = rng.randint(1, 9)
            text = rng.choice(["hello there friend", "hello there friends", "hello where friend", "bye", ""])
            subs.append((v, at, at + n, text, rng.choice([0.5, 0.7, 0.9])))
            at += n + rng.choice([0, 1, 12, 13, 20])
    want = []
    for v in range(3):
        kept = []
        for _, s, e, t, c in (x for x in subs if x[0] == v):
            if kept and 0 <= s - kept[-1][1] <= 12 and SequenceMatcher(None, kept[-1][2], t).ratio() > 0.85:
                kept[-1][1] = e
                if c > kept[-1][3]:
                    kept[-1][2:] = [t, c]
            else:
                kept.append([s, e, t, c])
        want += [(v, i, *k) for i, k in enumerate(kept)]
    got = reads.merge_same_text(spark.createDataFrame(subs, "video_id long, start long, end long, text string, conf double"))
    assert sorted((r["video_id"], r["event_id"], r["start"], r["end"], r["text"], r["conf"]) for r in got.collect()) == sorted(want)
    pair = spark.createDataFrame([("abcd", "bcde"), ("", "")], "a string, b string").select(reads.text_similarity("a", "b")).collect()
    assert [r[0] for r in pair] == [0.75, 1.0]


def test_clean_frames_equal_a_loop(spark):
    rng = random.Random(3)
    subs, at = [], 0
    for i in range(60):
        n = rng.randint(1, 70)
        subs.append((1, i, at, at + n))
        at += n + rng.choice([0, 1, 3, 8, 30])
    total = at + 5

    def free(f):
        s = [x for x in subs if x[2] <= f]
        return not s or max(s, key=lambda x: (x[2], x[3]))[3] < f

    want = set()
    for _, i, s, e in subs:
        for f, way in ((s - 6, -1), (e + 6, 1)):
            found = steps = 0
            while found < 2 and steps < 150 and 0 <= f < total:
                steps += 1
                if free(f):
                    want.add((i, f))
                    found += 1
                    f += 5 * way
                else:
                    f += way
    got = render.clean_frames(spark.createDataFrame(subs, "video_id long, event_id long, start long, end long"), spark.createDataFrame([(1, total)], "video_id long, n_frames long"))
    assert {(r["event_id"], r["frame"]) for r in got.collect()} == want


def test_text_rules(spark):
    values = [" 　a  ", "x\r\ny\x0bz w", "\x1c q \x1f", "太　郎「x", "太郎「x", "ninechars「x"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(values)], "video_id long, event_id long, text string")
    assert [r[0] for r in df.select(C.strip(F.col("text"))).collect()] == [v.strip() for v in values]
    assert [r[0] for r in df.select(C.lines_of(F.col("text"))).collect()] == [[y.strip() for y in v.splitlines() if y.strip()] for v in values]
    assert [r["name"] for r in translate.speaker_names(df).collect()] == ["太郎"]
    half = spark.createDataFrame([(15.0,), (25.0,)], "fps double").select(F.rint(0.3 * F.col("fps"))).collect()
    assert [r[0] for r in half] == [round(4.5), round(7.5)]


def test_translate_falls_back(spark):
    subs = spark.createDataFrame([(1, i, f"line {i}") for i in range(20)] + [(2, 0, "solo")], "video_id long, event_id long, text string")
    done = spark.createDataFrame([(1, 0, "done")], "video_id long, event_id long, zh string")

    def model():
        def ask(prompt, heat):
            lines = prompt.rpartition("\n\n")[2].split("\n")
            if "line 9" in lines and len(lines) > 1 or lines == ["line 10"]:
                return ""
            if lines == ["solo"]:
                raise ValueError
            return "\n".join(f"[{x}]" for x in lines)

        return ask

    out = translate.translate(subs, done, spark.createDataFrame([], "video_id long, glossary string"), translate.detect_lang(subs), model, Ledger(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp")))
    got = {(r["video_id"], r["event_id"]): r["zh"] for r in out.collect()}
    want = {(1, i): f"[line {i}]" for i in range(1, 20)} | {(1, 10): "line 10", (2, 0): "solo"}
    assert got == want


def test_pixels():
    assert (pixels.blend(np.full((1, 1, 3), 10, np.uint8), np.array([[[200, 100, 0, 127]]], np.uint8)) == [(200 * 127 + 10 * 128 + 127) // 255, (100 * 127 + 10 * 128 + 127) // 255, (10 * 128 + 127) // 255]).all()
    assert pixels.wrap("abcdef\ngh", 3, len) == ["abc", "def", "gh"] and pixels.wrap("", 3, len) == [""] and pixels.wrap("ab", 0, len) == ["a", "b"]
    flat = np.full((40, 60, 3), 50, np.uint8)
    mask = np.zeros((40, 60), bool)
    mask[15:25, 20:40] = True
    dirty = flat.copy()
    dirty[mask] = 255
    assert (pixels.composite(dirty, (0, 0, 60, 40), mask, None, None, None) == flat).all()
    back = pixels.background([flat, flat + 3], mask, 14)
    assert back is not None and back[1].sum() == mask.sum()
    assert (pixels.composite(dirty, (0, 0, 60, 40), mask, back, None, None)[mask] <= 53).all()
    assert pixels.background([flat, flat + 30], mask, 14) is None and pixels.background([flat], mask, 14) is None
    text = np.full((40, 60, 3), 120, np.uint8)
    text[10:30, 10:50] = 10
    text[14:26, 14:46] = 240
    fill, outline, glyph = pixels.text_style(text, [(5, 5, 55, 35)])
    assert fill == (240, 240, 240) and outline == (10, 10, 10) and glyph.sum() == 800
    assert pixels.text_style(flat, [(0, 0, 60, 40)])[2] is None
    assert len(pixels.thumbnail(flat.tobytes(), 40, 60, 20, 20, 2, 7)) == 14


def test_frames_through_models(spark):
    px = np.zeros((32, 48, 3), np.uint8)
    rows = [(1, f, 32, 48, (px + f).tobytes()) for f in range(6)]
    frames = spark.createDataFrame(rows, "video_id long, frame long, h int, w int, pixels binary")

    def detector():
        def find(h, w, data):
            if data[0] == 3:
                raise ValueError
            return [(0, 0, w, h)]

        return find

    found = {r["frame"]: (len(r["boxes"]), r["failed"]) for r in detect.detect_text(frames, detector).collect()}
    assert found[2] == (1, False) and found[3] == (0, True)
    geo = detect.geometry(spark.createDataFrame([(1, 48, 32, 10.0)], "video_id long, width int, height int, fps double"))
    t = detect.thumbnails(frames, geo).collect()
    assert len(t) == 6 and all(len(r["pixels"]) == r["th"] * r["tw"] for r in t)
    events = spark.createDataFrame([(1, 0, 1, 2)], "video_id long, event_id long, start long, end long")
    overlay = np.full((2, 2, 4), 255, np.uint8).tobytes()
    plans = spark.createDataFrame([(1, 0, None, None, None, None, None, overlay, 1, 1, 2, 2)], f"video_id long, event_id long, roi {C.BOX}, mask binary, median binary, static binary, ring binary, overlay binary, overlay_x int, overlay_y int, overlay_h int, overlay_w int")
    out = {r["frame"]: np.frombuffer(r["pixels"], np.uint8).reshape(32, 48, 3) for r in render.composite(frames, events, plans).collect()}
    assert (out[1][1:3, 1:3] == 255).all() and (out[4] == 4).all() and len(out) == 6


def test_read_text_and_style_of_frames(spark):
    px = np.full((40, 80, 3), 120, np.uint8)
    px[12:30, 12:26], px[12:30, 26:42] = 20, 240
    rows = [(1, f, 40, 80, (px if f else px * 0).tobytes()) for f in range(4)]
    frames = spark.createDataFrame(rows, "video_id long, frame long, h int, w int, pixels binary")
    asked = spark.createDataFrame([(1, 0, 0, 2), (1, 0, 1, 0), (1, 0, 2, 9)], "video_id long, event_id long, attempt int, frame long")

    def reader():
        return lambda h, w, data: [("two", 0.9, (12, 12, 68, 30))] if max(data) else None

    got = {r["attempt"]: r for r in reads.read_text(frames, asked, reader).collect()}
    assert [got[k]["readable"] for k in range(3)] == [True, False, False]  # a black frame, and one that is not there
    assert got[0]["lines"][0]["text"] == "two" and tuple(got[0]["lines"][0]["box"]) == (12, 12, 68, 30) and got[1]["lines"] == []
    subs = spark.createDataFrame([(1, 0, 2, (12, 12, 68, 30), [("two", 0.9, (12, 12, 68, 30))])], f"video_id long, event_id long, frame long, bbox {C.BOX}, lines array<{reads.LINE}>")
    r = reads.text_style(subs, frames).collect()[0]
    want = np.zeros((26, 64), np.uint8)
    want[4:22, 4:34] = 1
    assert tuple(r["glyph_rect"]) == (8, 8, 72, 34) and (np.frombuffer(r["mask"], np.uint8).reshape(26, 64) == want).all()
    assert (r["fill"], r["outline"]) == ([240] * 3, [20] * 3)


def test_erase_masks(spark):
    glyph = np.zeros((10, 20), np.uint8)
    glyph[4:6, 5:15] = 1
    box, line = (20, 20, 40, 30), [(20, 20, 40, 30)]
    subs = [(1, 0, line, box, 7), (1, 1, line, box, 8), (1, 2, line, None, None), (1, 3, None, box, 7), (2, 0, line, (20, 20, 41, 30), 7), (3, 0, [], box, 7)]
    frame = spark.createDataFrame(subs, f"video_id long, event_id long, boxes array<{C.BOX}>, glyph_rect {C.BOX}, mask_key long").withColumns({"width": F.lit(96), "height": F.lit(64)})
    masks = spark.createDataFrame([(v, 7, 10, 20, glyph.tobytes()) for v in (1, 2)], "video_id long, mask_key long, h int, w int, mask binary")
    got = {(r["video_id"], r["event_id"]): r for r in render.erase_masks(render.erase_roi(frame), masks).collect()}
    roi = (0, 1, 62, 49)
    assert tuple(got[1, 0]["roi"]) == roi and got[1, 3]["mask"] is None and got[3, 0]["mask"] is None
    bits = lambda k: np.frombuffer(got[k]["mask"], np.uint8).reshape(48, 62)
    wide, boxes = np.zeros((48, 62), np.uint8), np.zeros((48, 62), np.uint8)
    wide[24 - 1 - 2 : 26 - 1 + 2, 25 - 2 : 35 + 2] = 1
    boxes[20 - 7 - 1 : 30 + 7 - 1, 20 - 10 : 40 + 10] = 1
    assert (bits((1, 0)) == wide).all()
    for k in ((1, 1), (1, 2), (2, 0)):  # no such mask, none named, or one of another size
        assert (bits(k) == boxes).all()
    assert render.erase_masks(render.erase_roi(frame.limit(0)), masks).count() == 0


def test_render_frames_restores_what_is_behind_text(spark):
    y, x = np.mgrid[0:64, 0:96]
    base = np.stack([x + 60, y + 80, (x + y) // 2 + 40], axis=2).astype(np.uint8)
    glyph = np.zeros((10, 20), bool)
    glyph[3:7, 2:18] = True
    dirty = base.copy()
    dirty[20:30, 20:40][glyph] = 255
    frames = spark.createDataFrame([(1, f, 64, 96, (dirty if 20 <= f <= 25 else base).tobytes()) for f in range(60)], "video_id long, frame long, h int, w int, pixels binary")
    box = (20, 20, 40, 30)
    subs = spark.createDataFrame([(1, 0, 20, 25, [box], box, 20)], f"video_id long, event_id long, start long, end long, boxes array<{C.BOX}>, glyph_rect {C.BOX}, mask_key long").withColumns({"width": F.lit(96), "height": F.lit(64)})
    masks = spark.createDataFrame([(1, 20, 10, 20, glyph.astype(np.uint8).tobytes())], "video_id long, mask_key long, h int, w int, mask binary")
    overlay = np.zeros((2, 3, 4), np.uint8)
    overlay[..., 0], overlay[..., 3] = 200, 255
    overlays = spark.createDataFrame([(1, 0, overlay.tobytes(), 50, 60, 2, 3)], "video_id long, event_id long, overlay binary, overlay_x int, overlay_y int, overlay_h int, overlay_w int")
    n = spark.createDataFrame([(1, 60)], "video_id long, n_frames long")
    want = base.copy()
    want[60:62, 50:53] = (200, 0, 0)
    got = workloads.render_frames(frames, subs, masks, overlays, n).collect()
    assert len(got) == 60 and not any(r["failed"] for r in got)
    for r in got:
        assert (np.frombuffer(r["pixels"], np.uint8).reshape(64, 96, 3) == (want if 20 <= r["frame"] <= 25 else base)).all()


def test_a_long_chain_of_events_merges_in_bounded_work(spark):
    n = 3000
    events = spark.range(n).select(F.lit(1).cast("long").alias("video_id"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 2).alias("end"), C.box(*map(F.lit, (8, 8, 24, 24))).alias("bbox"))
    thumbs = spark.range(3 * n).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame"), F.lit(4).alias("th"), F.lit(4).alias("tw"), F.when(F.col("id") < 6000, F.lit(bytes([50] * 16))).otherwise(F.lit(bytes([200] * 16))).alias("pixels"))
    geo = spark.createDataFrame([(1, 3 * n, 3, 0, 4, 4)], GEO)
    began = time.time()
    got = segment.merge_flicker(events, thumbs, geo).collect()
    assert time.time() - began < 60
    assert sorted((r["start"], r["end"]) for r in got) == [(0, 5999), (6000, 8999)]


def test_frames_are_read_with_their_types(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/f"
    spark.createDataFrame([(1, 0, 1, 1, b"abc", "x")], "video_id long, frame long, h int, w int, pixels binary, more string").write.parquet(path)
    got = ingest.read_frames(spark, path)
    assert got.columns == ["video_id", "frame", "h", "w", "pixels"] and bytes(got.head()["pixels"]) == b"abc"
    spark.createDataFrame([(1, 0)], "video_id long, frame long").write.parquet(path + "2")
    with pytest.raises(ValueError):
        ingest.read_frames(spark, path + "2")


def test_stages_and_inventory(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "video_id long, x string")
    ingest.write_stage(old, f"{path}/s", 1)
    ingest.write_stage(spark.createDataFrame([(1, "z")], "video_id long, x string"), f"{path}/s", 2)
    assert sorted(tuple(r) for r in ingest.read_stage(spark, f"{path}/s").collect()) == [(1, "z"), (2, "c")]
    ingest.compact_stage(spark, f"{path}/s", f"{path}/t")
    assert ingest.read_stage(spark, f"{path}/t").count() == 2
    for name in ("a.MP4", "b.txt", "c.mkv"):
        with open(f"{path}/{name}", "w") as f:
            f.write("12345")
    got = ingest.job_key(ingest.media_inventory(spark, path)).collect()
    assert sorted((r["name"], r["size"], len(r["job_key"])) for r in got) == [("a.MP4", 5, 12), ("c.mkv", 5, 12)]


def stream(spark, df, run, mode="append", then=None):
    """df in three micro-batches, and `then` in one after them."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df.repartition(3).write.parquet(f"{path}/in")
    if then is not None:
        time.sleep(1.5)  # files are taken in order of their age
        then.coalesce(1).write.mode("append").parquet(f"{path}/in")
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    name = "t" + path.rpartition("-")[2].replace("-", "_")
    q = run(s).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batch(spark):
    ev = spark.read.parquet(f"{DIR}/events.parquet").select((F.col("user_id") % 5).alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("frame"), F.concat(F.lit("j"), (F.col("event_id") % 7).cast("string")).alias("job_key"))
    got = stream(spark, ev, lambda s: live.stream_throughput(s, "1 day", "400 days"), "complete")
    plain = lambda df: sorted((r["video_id"], r["since"], r["frames"]) for r in df.collect())
    assert plain(got) == plain(live.stream_throughput(ev, "1 day", "400 days")) and sum(r["frames"] for r in got.collect()) == ev.count()
    status = ev.withColumns({"stage": F.lit("ocr"), "progress": F.col("frame") / 1e3, "status": F.lit("running"), "elapsed": F.col("frame").cast("double")})
    latest = stream(spark, status, live.stream_status, "complete").collect()
    last = {}
    for r in status.collect():
        last[r["video_id"]] = max(last.get(r["video_id"], (r["ts"], 0)), (r["ts"], r["progress"], r["elapsed"]))
    assert len(latest) == len(last) > 1
    for r in latest:
        ts, progress, elapsed = last[r["video_id"]]
        assert (r["ts"], r["progress"]) == (ts, progress) and (r["eta"] is None if progress <= 0.02 else abs(r["eta"] - elapsed / progress * (1 - progress)) < 1e-9)
    jobs = stream(spark, ev, lambda s: live.stream_dedupe_jobs(s, "400 days"))
    assert sorted(r["job_key"] for r in jobs.collect()) == sorted({f"j{i}" for i in range(7)})
    geo = spark.createDataFrame([(v, 3, 0) for v in range(5)], "video_id long, step int, crop_y int")
    boxed = ev.withColumn("boxes", F.array(C.box(F.lit(0), F.lit(0), F.lit(50), F.lit(20))))
    rows_of = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows_of(stream(spark, boxed, lambda s: live.stream_samples(s, geo))) == rows_of(live.stream_samples(boxed, geo)) != []


def test_stream_sessions_and_runs_equal_batch(spark):
    rows, samples, thumbs, geo = scene(spark, 1)
    at = lambda f: F.timestamp_seconds(F.lit(1_700_000_000) + f * F.lit(0.1))
    flat = spark.createDataFrame([(v, f, *(b or (None,) * 4)) for v, f, b in samples], "video_id long, frame long, x1 int, y1 int, x2 int, y2 int")
    live_rows = flat.join(thumbs.select("video_id", "frame", "pixels"), ["video_id", "frame"]).withColumn("ts", at(F.col("frame")))
    marks = [(0, 2000), (1, 2000), (2, 2000), (7, 10**6)]
    last = live_rows.limit(0).unionByName(spark.createDataFrame(marks, "video_id long, frame long").withColumn("ts", at(F.col("frame"))), allowMissingColumns=True)
    bbox = F.when(F.col("x1").isNotNull(), C.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    boxed = lambda df, b: df.select("video_id", "ts", "frame", b.alias("bbox"))
    sessions = stream(spark, boxed(live_rows, bbox), lambda s: live.stream_sessions(s, 0.3, "20 seconds"), then=boxed(last, C.box(*[F.lit(0)] * 4)))
    batch = segment.text_islands(spark.createDataFrame(samples, BOXED))
    pick = lambda df: sorted((r["video_id"], r["first_s"], r["last_s"], tuple(r["bbox"])) for r in df.collect() if r["first_s"] < 2000)
    assert pick(sessions) == pick(batch)
    runs = stream(spark, live_rows, lambda s: live.stream_runs(s, 3, 0, 4, 4, "20 seconds"), then=last)
    assert live.late_rows(runs).count() == 0
    assert pick(live.closed_runs(runs)) == pick(segment.split_runs(spark.createDataFrame(samples, BOXED), thumbs, geo))
