"""Folds of long groups in blocks against plain loops over the whole group."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from capspark.functions import columns as C
from capspark.functions import ratio
from capspark.operators import block_fold, reads, segment

from .test_captions import BOXED, EVENTS, GEO, joined, plain_diff, plain_rect, plain_runs, thumbs_of

THUMB = "video_id long, frame long, th int, tw int, pixels binary"


def calls(monkeypatch):
    """Counts the tables that rounds write."""
    seen, real = [], block_fold.written
    monkeypatch.setattr(block_fold, "written", lambda df, name: (seen.append(name), real(df, name))[1])
    return seen


@pytest.mark.parametrize(("seed", "size", "spread"), [(0, 7, 40), (1, 16, 6), (2, 5, 0)])
def test_runs_of_long_islands_equal_a_loop(spark, monkeypatch, seed, size, spread):
    rng = random.Random(seed)
    n, seen = 900, calls(monkeypatch)
    rows = thumbs_of(rng, 2, n, 8, 8)
    samples = [(v, f, None if rng.random() < 0.004 else (x := rng.randint(0, spread), y := rng.randint(0, spread), x + rng.randint(4, 12), y + rng.randint(4, 12))) for v in range(2) for f in range(0, n, 3)]
    thumbs = spark.createDataFrame(rows, THUMB).repartition(3)
    geo = spark.createDataFrame([(v, n, 3, 0, 8, 8) for v in range(2)], GEO)
    got = segment.split_runs(spark.createDataFrame(samples, BOXED).repartition(2), thumbs, geo, block=size).collect()
    want = []
    for v in range(2):
        thumb = {r[1]: r[4] for r in rows if r[0] == v}
        monkeypatch.setattr("tests.test_captions.plain_diff", lambda a, b, rect: plain_diff(a, b, rect, 8))
        monkeypatch.setattr("tests.test_captions.plain_rect", lambda b: plain_rect(b, 8, 8))
        want += [(v, *r) for r in plain_runs([(f, b) for w, f, b in samples if w == v], thumb)]
    flat = [(r["video_id"], r["first_s"], r["last_s"], r["prev_empty"], r["split_from"], tuple(r["bbox"])) for r in got]
    assert sorted(flat, key=str) == sorted(want, key=str)
    assert "handed" in seen and len(want) > 20


def test_one_island_of_100000_samples_is_folded_on_several_tasks(spark, monkeypatch):
    n, seen = 100_000, calls(monkeypatch)
    cuts = [9_000, 9_001, 40_000, 77_777]
    level = F.lit(40)
    for k, at in enumerate(cuts):
        level = F.when(F.col("frame") >= at, 40 + 40 * (k + 1)).otherwise(level)
    one = spark.range(n).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame"))
    thumbs = one.select("*", F.lit(4).alias("th"), F.lit(4).alias("tw"), F.unhex(F.repeat(F.lpad(F.hex(level), 2, "0"), F.lit(16))).alias("pixels"))
    box = C.box(F.lit(0), F.lit(0), F.lit(8) + F.col("frame") % 9, F.lit(24))
    geo = spark.createDataFrame([(1, n, 1, 0, 4, 4)], GEO)
    runs = segment.split_runs(one.select("*", box.alias("bbox")), thumbs, geo)
    got = sorted((r["first_s"], r["last_s"], r["split_from"]) for r in runs.collect())
    edges = [0, *cuts, n]
    assert got == [(a, b - 1, a - 1 if a else None) for a, b in zip(edges, edges[1:], strict=False)]
    assert seen.count("folded") == 2  # what blocks hand on is right after the first round
    assert n // segment.SAMPLES > 40


@pytest.mark.parametrize(("seed", "size"), [(0, 4), (1, 7), (2, 64)])
def test_flicker_of_long_chains_equals_a_loop(spark, seed, size):
    rng = random.Random(seed)
    n = 1200
    rows = thumbs_of(rng, 1, n)
    thumbs, geo = spark.createDataFrame(rows, THUMB), spark.createDataFrame([(0, n, 3, 0, 4, 4)], GEO)
    events, at = [], 0
    while at < n - 20:
        end = at + rng.randint(0, 6)
        events.append((0, at, end, (x := rng.randint(0, 20), 8, x + 9, 24)))
        at = end + rng.choice([0, 1, 2, 3, 4])
    thumb, kept = {r[1]: r[4] for r in rows}, []
    for _, s, e, b in sorted(events):
        if kept and 0 <= s - kept[-1][1] <= 10 and plain_diff(thumb[(kept[-1][0] + kept[-1][1]) // 2], thumb[(s + e) // 2], plain_rect(joined(kept[-1][2], b))) < 14:
            kept[-1][1:] = e, joined(kept[-1][2], b)
        else:
            kept.append([s, e, b])
    got = segment.merge_flicker(spark.createDataFrame(events, EVENTS).repartition(3), thumbs, geo, block=size).collect()
    assert sorted((r["start"], r["end"], tuple(r["bbox"])) for r in got) == sorted(map(tuple, kept))
    assert 10 < len(kept) < len(events)


@pytest.mark.parametrize(("seed", "size"), [(0, 3), (1, 5), (2, 128)])
def test_texts_of_long_chains_equal_a_loop(spark, seed, size):
    rng = random.Random(seed)
    letters, subs, at = list("abcdefghijklmnopqrst"), [], 0
    for i in range(400):  # texts drift, so the one that is kept is alike to some later ones only
        e = at + rng.randint(1, 5)
        letters[rng.randrange(20)] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        subs.append((1, at, e, "".join(letters), rng.choice([0.5, 0.6, 0.7, 0.8, 0.9]), i))
        at = e + rng.randint(0, 9)
    kept = []
    for _, s, e, t, c, i in subs:
        if kept and SequenceMatcher(None, kept[-1][2], t).ratio() > 0.85:
            kept[-1][1] = e
            if c > kept[-1][3]:
                kept[-1][2:] = [t, c, i]
        else:
            kept.append([s, e, t, c, i])
    got = reads.merge_same_text(spark.createDataFrame(subs, "video_id long, start long, end long, text string, conf double, tag int").repartition(3), block=size).collect()
    assert sorted((r["event_id"], r["start"], r["end"], r["text"], r["conf"], r["tag"]) for r in got) == [(k, *x) for k, x in enumerate(kept)]
    assert 5 < len(kept) < 300


def test_texts_edges(spark):
    kind = "video_id string, start long, end long, text string, conf double, more array<int>"
    rows = [("a", 0, 5, None, 0.5, None), ("a", 6, 9, "", 0.5, [1]), ("a", 10, 12, "x", None, None), ("a", 10, 12, "x", None, None), ("b", 0, 1, "y", 0.1, [2])]
    got = reads.merge_same_text(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r["video_id"], r["start"], r["end"], r["text"] or "") for r in got) == [("a", 0, 9, ""), ("a", 10, 12, "x"), ("a", 10, 12, "x"), ("b", 0, 1, "y")]
    assert reads.merge_same_text(spark.createDataFrame([], kind)).count() == 0


def test_texts_of_no_video_and_of_many_chains_equal_a_loop(spark):
    rng, subs = random.Random(5), []
    for v in (None, "a", "b"):
        at = 0
        for i in range(150):
            e = at + rng.randint(1, 4)
            subs.append((v, at, e, rng.choice(["hello there friend", "hello there friends", "hello where friend", "bye", None]), rng.choice([None, 0.5, 0.7]), i))
            at = e + rng.choice([0, 1, 12, 13] if i < 100 else [0, 1])
    want = []
    for v in (None, "a", "b"):
        kept = []
        for _, s, e, t, c, i in (x for x in subs if x[0] == v):
            if kept and 0 <= s - kept[-1][1] <= 12 and SequenceMatcher(None, kept[-1][2] or "", t or "").ratio() > 0.85:
                kept[-1][1] = e
                if (c or 0) > (kept[-1][3] or 0):
                    kept[-1][2:] = [t, c, i]
            else:
                kept.append([s, e, t, c, i])
        want += [(v, k, *x) for k, x in enumerate(kept)]
    got = reads.merge_same_text(spark.createDataFrame(subs, "video_id string, start long, end long, text string, conf double, tag int").repartition(3), block=16)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in ("video_id", "event_id", "start", "end", "text", "conf", "tag"))) for r in got.collect())


def test_ratio_above_is_difflibs():
    rng = random.Random(1)
    for n in (0, 1, 30, 199, 260, 700) * 8:
        a = rng.choices("etaoin shrdlu.ABCXYZ\u6f22\U0001f600", weights=range(22, 0, -1), k=n)
        b = list(a)
        for _ in range(rng.randint(0, n // 8 + 1)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 3)] = rng.choices("etaoXY", k=rng.randint(0, 3))
        a, b = "".join(a), "".join(b)
        for x, y in ((a, b), (b, a), (a, "".join(reversed(b)))):
            r = SequenceMatcher(None, x, y).ratio()
            bounds = (0.85, r, r - 1e-9, 0.5)
            assert [ratio.above(x, y, t) for t in bounds] == [r > t for t in bounds]
