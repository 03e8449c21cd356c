"""Frames that stay where they are, and the job from samples to pixels with resume."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from capspark.functions import columns as C
from capspark.operators import frame_index, reads, render
from capspark.sources import ingest

FRAME = "video_id long, frame long, h int, w int, pixels binary"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def clip(spark, videos=2, n=700, h=24, w=32):
    px = lambda v, f: bytes([(v * 40 + f // 3) % 250]) * (h * w * 3)
    return spark.createDataFrame([(v, f, h, w, px(v, f)) for v in range(videos) for f in range(n)], FRAME)


def moved(df):
    """The exchanges of the executed plan whose rows have pixels; also sorts, which would spill them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    at = [(len(re.match(r"[\s:+|*\-()\d]*", x).group()), x) for x in lines]
    out = []
    for i, (depth, x) in enumerate(at):
        if re.search(r"\b(Exchange|Sort)\b", x) and "Broadcast" not in x:
            below = []
            for d, y in at[i + 1 :]:
                if d <= depth:
                    break
                below.append(y)
            read = [y for y in below if "FileScan" in y and "pixels" in y.partition("ReadSchema")[2]]
            cut = [y for y in below if re.search(r"(MapInPandas|FlatMap\w*InPandas)", y)]  # what models and crops give has no frames
            if read and not cut:
                out.append(x)
    return out


@pytest.fixture(scope="module")
def stored(spark):
    path = folder()
    return ingest.write_frames(clip(spark).repartitionByRange(5, "video_id", "frame"), "frames_" + path.rpartition("-")[2], f"{path}/frames", 8), path


def each_with_pixels(frames, spark):
    reader = lambda: lambda h, w, px: [(str(px[0]), 0.9, (2, 2, 20, 20))]
    asked = spark.createDataFrame([(v, e, a, 50 * e + 7 * a) for v in range(2) for e in range(13) for a in range(3)] + [(9, 0, 0, 1), (1, 99, 0, 5000)], "video_id long, event_id long, attempt int, frame long")
    yield "read", reads.read_text(frames, asked, reader)
    subs = spark.createDataFrame([(v, e, 50 * e, (2, 2, 20, 20), [("x", 0.9, (2, 2, 20, 20))]) for v in range(2) for e in range(13)], f"video_id long, event_id long, frame long, bbox {C.BOX}, lines array<{reads.LINE}>")
    yield "style", reads.text_style(subs, frames)
    events = spark.createDataFrame([(v, e, 50 * e + 10, 50 * e + 20) for v in range(2) for e in range(13)], "video_id long, event_id long, start long, end long")
    boxes = events.withColumns({"boxes": F.array(C.box(*map(F.lit, (10, 8, 22, 16)))), "glyph_rect": F.lit(None).cast(C.BOX), "mask_key": F.lit(None).cast("string"), "width": F.lit(32), "height": F.lit(24)})
    masks = spark.createDataFrame([], "video_id long, mask_key string, mask binary")
    plans = render.erase_masks(render.erase_roi(boxes), masks)
    clean = render.clean_frames(events, spark.createDataFrame([(0, 700), (1, 700)], "video_id long, n_frames long"))
    yield "back", render.backgrounds(clean, plans, frames)
    empty = plans.withColumns({c: F.lit(None).cast("binary") for c in ("median", "static", "ring", "overlay")} | {f"overlay_{c}": F.lit(None).cast("int") for c in "xyhw"})
    yield "composite", render.composite(frames, events, empty)


def rows_of(df):
    return sorted(str(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r)) for r in df.select(*sorted(df.columns)).collect())


def test_no_pixels_move_from_a_bucketed_table(spark, stored):
    frames, path = stored
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if requests were many
    try:
        plain = ingest.read_frames(spark, f"{path}/frames")
        for (name, got), (_, want) in zip(each_with_pixels(frames, spark), each_with_pixels(plain, spark), strict=True):
            assert moved(got) == [], name
            if name != "composite":
                assert moved(want) == [], name  # few requests are sent to frames without buckets
            assert rows_of(got) == rows_of(want) != [] if name != "back" else rows_of(got) == rows_of(want)
        shuffled = plain.join(spark.range(5).select(F.col("id").alias("video_id"), F.col("id").alias("frame")), ["video_id", "frame"])
        assert moved(shuffled) != []  # the test can fail
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_many_requests_of_frames_without_buckets(spark, stored, monkeypatch):
    frames, path = stored
    asks = spark.createDataFrame([(v, f, k) for v in (0, 1, 5) for f in range(0, 300, 3) for k in (1, 2)], "video_id long, frame long, k long")
    want = sorted((v, f, k, (v * 40 + f // 3) % 250) for v in (0, 1) for f in range(0, 300, 3) for k in (1, 2))
    pick = lambda df: sorted((r["video_id"], r["frame"], r["k"], r["pixels"][0]) for r in df.collect())
    plain = ingest.read_frames(spark, f"{path}/frames")
    assert pick(frame_index.asked_frames(frames, asks)) == pick(frame_index.asked_frames(plain, asks)) == want
    for most in (50, 0):  # the blocks are sent, and not even they
        monkeypatch.setattr(frame_index, "BROADCAST_REQUESTS", most)
        assert pick(frame_index.asked_frames(plain, asks)) == want


def test_a_bucketed_table_is_opened_again(spark, stored):
    frames, path = stored
    again = ingest.open_frames(spark, "again_" + path.rpartition("-")[2], f"{path}/frames", 8)
    assert again.count() == frames.count() and frame_index.bucketed(again)
    asks = spark.createDataFrame([(k % 2, k) for k in range(40)], "video_id long, frame long")
    got = frame_index.asked_frames(again, asks)
    assert moved(got) == [] and got.count() == 40


def test_a_later_start_hides_an_older_event(spark):
    events = spark.createDataFrame([(1, 0, 0, 600), (1, 1, 100, 120), (1, 2, 100, 110), (1, 3, 700, 690), (2, 0, 5, 5)], "video_id long, event_id long, start long, end long")
    got = sorted((r["video_id"], r["event_id"], r["lo"], r["hi"]) for r in render.shown_stretches(events).collect())
    assert got == [(1, 0, 0, 99), (1, 1, 100, 120), (2, 0, 5, 5)]
    frames = spark.range(720).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame"))
    at = {r["frame"]: r["event_id"] for r in render.event_at_frame(frames, events).collect()}
    shown = {f: e for v, e, a, z in got if v == 1 for f in range(a, z + 1)}
    assert at == {f: shown.get(f) for f in range(720)}


# The job


BOX = (20, 40, 70, 58)
PROBE = '{"streams": [{"codec_type": "video", "width": 200, "height": 64, "r_frame_rate": "10/1", "nb_frames": "9"}], "format": {}}'
SHOWN = {1: {"first": (20, 29), "second": (45, 56)}, 2: {"third": (30, 41)}}


def picture(shift):
    y, x = np.mgrid[0:64, 0:200]
    return np.stack([x // 4 + 90, y + 90, (x + y) // 5 + 100], axis=2).astype(np.uint8) + np.uint8(shift)


def with_text(base, text):
    out = base.copy()
    out[43:55, 24:66] = 10
    out[46:52, 28:62] = 250
    out[46:52, {"first": 30, "second": 40, "third": 50}[text] :][:, :2] = 10
    return out


def shown_at(video, frame):
    return next((t for t, (a, z) in SHOWN[video].items() if a <= frame <= z), None)


def video_frames(spark):
    rows = []
    for v in (1, 2):
        base = picture(v)
        for f in range(80):
            text = shown_at(v, f)
            rows.append((v, f, 64, 200, (with_text(base, text) if text else base).tobytes()))
    return spark.createDataFrame(rows, FRAME).repartition(6)


def has_text(h, w, px):
    img = np.frombuffer(px, np.uint8).reshape(h, w, 3)
    return img if (img[48, 26:64] == 10).any() and (img[44, 26:64] == 10).all() else None


def detector():
    return lambda h, w, px: [BOX] if has_text(h, w, px) is not None else []


def reader():
    def read(h, w, px):
        img = has_text(h, w, px)
        return [] if img is None else [(t, 0.9, BOX) for t, x in (("first", 30), ("second", 40), ("third", 50)) if (img[48, x : x + 2] == 10).all()]

    return read


def translator():
    def ask(prompt, heat):
        past = prompt.split("\n\n")[0] if prompt.startswith("Before:") else ""
        return "\n".join(f"{x[:2]}{len(past) % 10}" for x in prompt.rpartition("\n\n")[2].split("\n"))

    return ask


def broken():
    raise RuntimeError("this model must not be made")


def models(**other):
    from capspark.plans.job import Models

    draw = lambda lines, size, stroke, gap, fill, outline, h, w: np.full((h, w, 4), [*fill[:2], len(lines[0]), 128], np.uint8)
    return Models(**{"detector": detector, "reader": reader, "translator": translator, "names": lambda: lambda n: n, "width": lambda t, s: len(t) * s, "draw": draw} | other)


def test_job_from_frames_to_pixels_goes_on_where_it_has_stopped(spark):
    from capspark.plans.job import Job

    path = folder()
    frames = ingest.write_frames(video_frames(spark), "clip_" + path.rpartition("-")[2], f"{path}/frames", 4)
    probe = spark.createDataFrame([(1, PROBE), (2, PROBE), (3, '{"streams": [], "format": {}}')], "video_id long, json string")
    new = lambda **other: Job(frames, probe, f"{path}/job", models(**other))
    at = lambda job: {r["video_id"]: r["stage"] for r in job.next_stages().collect()}
    with pytest.raises(Exception, match="must not be made"):
        new(reader=broken).run()
    assert at(new()) == {1: "ocr", 2: "ocr", 3: "ocr"}
    got = sorted((r["video_id"], r["start"], r["end"]) for r in new().table("events", "events").collect())
    assert got == sorted((v, *s) for v, of in SHOWN.items() for s in of.values())

    new(detector=broken).run(until="translate")  # nothing before is done again
    subs = {(r["video_id"], r["text"]): r for r in new().table("subtitles", "ocr").collect()}
    assert set(subs) == {(v, t) for v, of in SHOWN.items() for t in of}
    masks = {(r["video_id"], r["mask_key"]): r for r in new().table("glyph_masks", "ocr").collect()}
    for (v, _), r in subs.items():
        m = masks[v, r["mask_key"]]
        want = np.zeros((26, 58), np.uint8)
        want[43 - 36 : 55 - 36, 24 - 16 : 66 - 16] = 1
        assert tuple(r["glyph_rect"]) == (16, 36, 74, 62) and tuple(r["style"]["fill"]) == (250,) * 3 and (np.frombuffer(m["mask"], np.uint8).reshape(26, 58) == want).all()
    assert {(r["event_id"], r["trans"]) for r in new().review().collect() if r["video_id"] == 1} == {(0, "fi0"), (1, "se0")}

    new(detector=broken, reader=broken, translator=broken).run()
    assert at(new()) == {1: None, 2: None, 3: None}
    out = {(r["video_id"], r["frame"]): r for r in new().table("output", "render").collect()}
    assert len(out) == 160 and not any(r["failed"] for r in out.values())
    for (v, f), r in out.items():
        want = picture(v)
        if shown_at(v, f):  # 3 letters of 16 pixels, placed by hand
            part = want[32:64, 14:74].astype(int)
            want[32:64, 14:74] = (np.array([250, 250, 3]) * 128 + part * 127 + 127) // 255
        assert (np.frombuffer(r["pixels"], np.uint8).reshape(64, 200, 3) == want).all(), (v, f)

    job = new()
    version = job.ledger.new_version()
    job.ledger.put("events", job.table("events", "events").limit(0), version)  # a writer that dies before it commits
    assert job.table("events", "events").count() == 3 and at(job)[1] is None
    job.ledger.commit("events", version, spark.createDataFrame([(1,)], "video_id long"))
    assert at(job) == {1: "ocr", 2: None, 3: None} and job.table("events", "events").count() == 1
    append = Job(frames, probe, f"{path}/job", models(), mode="append")
    append.run()
    assert at(append)[1] is None and append.table("subtitles", "ocr").count() == 1


def plain_translation(rows, done, ask, history=5, size=8):
    out = []
    for v in sorted({r[0] for r in rows}):
        past, todo = [], sorted((e, t.replace("\n", "　")) for w, e, t in rows if w == v and (v, e) not in done)
        for k in range(0, len(todo), size):
            lines = [t for _, t in todo[k : k + size]]
            before = "Before:\n" + "\n".join(past[-history:]) + "\n\n" if past else ""
            got = ask(before + "order\n\n" + "\n".join(lines), 0.3).split("\n")
            past += got
            out += [(v, e, x) for (e, _), x in zip(todo[k : k + size], got, strict=True)]
    return sorted(out)


def test_translation_by_rounds_resumes_and_asks_nothing_twice(spark, monkeypatch):
    from capspark.operators import translate
    from capspark.sources.ledger import Ledger

    rows = [(v, e, f"line {e} of\n{v}") for v, n in ((1, 30), (2, 8), (3, 17), (4, 1)) for e in range(n)]
    done = {(1, 3), (3, 0), (4, 0)}
    log = folder()

    def model():
        def ask(prompt, heat):
            import uuid

            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt)
            past = prompt.split("\n\n")[0] if prompt.startswith("Before:") else ""
            return "\n".join(f"{x[:7]}<{sum(map(ord, past)) % 977}>" for x in prompt.rpartition("\n\n")[2].split("\n"))

        return ask

    def asked():
        import os

        return sorted(open(f"{log}/{x}").read() for x in os.listdir(log))

    def run():
        subs = spark.createDataFrame(rows, "video_id long, event_id long, text string").repartition(3)
        had = spark.createDataFrame([(*k, "zh") for k in done], "video_id long, event_id long, zh string")
        none = spark.createDataFrame([], "video_id long, glossary string")
        out = translate.translate(subs, had, none, translate.detect_lang(subs), model, Ledger(spark, ledger), template="order", tasks=3)
        return sorted(map(tuple, out.collect()))

    ledger = folder()
    commit = Ledger.commit
    breaks = lambda self, stage, *more: (_ for _ in ()).throw(RuntimeError("lost")) if stage == "round 2" else commit(self, stage, *more)
    monkeypatch.setattr(Ledger, "commit", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        run()
    monkeypatch.setattr(Ledger, "commit", commit)
    before = asked()
    got = run()
    third = [p for p in before if before.count(p) > 1]
    assert not third and len(asked()) == 7 + 1  # round 2 had been asked for a video, and was not committed
    assert got == plain_translation(rows, done, model()) and len({x.rpartition("<")[2] for _, _, x in got}) > 3
    n = len(asked())
    assert run() == got and len(asked()) == n  # all is there


def test_wrapped_lines_and_asked_names(spark):
    from capspark.functions import pixels
    from capspark.operators import translate

    texts = ["abcdefgh", "ab\ncdefghij\n", "", None, "x", "wide 字字字字字", "\n\n"]
    width = lambda t, size: sum(size * (2 if ord(c) > 255 else 1) for c in t)
    rows = spark.createDataFrame([(i, t, 10 + i % 2, 35.0) for i, t in enumerate(texts)], "k long, zh string, size int, max_w double")
    for r in render.wrap_text(rows, width).collect():
        want = pixels.wrap(r["zh"] or "", 35.0, lambda x, s=r["size"]: width(x, s))
        assert r["lines"] == want and r["text_w"] == max(int(width(x, r["size"])) for x in want)
        assert "".join(r["lines"]) == (r["zh"] or "").replace("\n", "") and all(width(x, r["size"]) <= 35 or len(x) == 1 for x in r["lines"])

    def namer():
        def ask(name):
            if name == "bad":
                raise ValueError
            return f" 「{name}さん」\nand more"

        return ask

    names = spark.createDataFrame([(1, "Tom", 1), (1, "太郎", 2), (2, "bad", 1), (2, "averyveryverylongname", 2)], "video_id long, name string, ord int")
    answers = translate.ask_names(names, namer)
    assert sorted((r["name"], r["answer"]) for r in answers.collect() if r["name"] != "averyveryverylongname") == [("Tom", " 「Tomさん」\nand more"), ("bad", None)]
    assert sorted((r["video_id"], r["name"], r["zh"]) for r in translate.glossary(names, answers).collect()) == [(1, "Tom", "Tomさん"), (1, "太郎", "太郎")]
