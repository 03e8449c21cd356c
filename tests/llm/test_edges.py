"""Null and repeated ids, long texts, and clashing columns, against plain versions."""

from __future__ import annotations

import random
import zlib

import corpus_pipeline
import numpy as np

from capspark.llm import chat, quality_rules, repair, sharding

from .test_operators import JSON, PATTERN, empty, encoding_cached, plain_rules, texts

DIR = "/root/testdata/sf0.001"
IDS = [(None, "one text"), (3, "two"), (None, None), (3, "two"), (3, "other text of the same id"), (1, ""), (None, "one text"), (-2, "é" * 3000)]


def by_id(spark, rows=IDS):
    return spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, shard int, size string")


def test_sharding_of_null_and_repeated_ids(spark):
    rows = sharding.shard_texts(by_id(spark), 3).collect()
    want = sorted((repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in IDS)
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    of = {}
    for r in rows:
        assert of.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]


def test_token_files_of_null_and_repeated_ids(spark):
    got = repair.read_tokens(spark, repair.write_tokens(by_id(spark).repartition(4), JSON, PATTERN, 2, block=50)).collect()
    got.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == [None, None, None, -2, 1, 3, 3, 3]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    want = sorted((repr(i), [*encoding_cached().encode_ordinary(t or ""), 2]) for i, t in IDS)
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in got) == want
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)


def test_perspectives_of_many_blocks_and_a_long_text(spark):
    n = 3 * chat.BLOCK + 7
    rows = [(1, i, ("ann", "bob", "system")[i % 3], "word " * (60_000 if i == 300 else i % 5)) for i in range(n)]
    rows += [(1, None, "ann", "without a turn"), (1, 700, "ann", "again"), (1, 700, "ann", "again")]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    for who in ("ann", "bob"):
        view = sorted((r for r in got if r["perspective"] == who), key=lambda r: r["start"])
        whole = "".join(r["rendered"] for r in view)
        assert [(r["turn"], r["speaker"]) for r in view] == [(r[1], r[2]) for r in order]
        assert [r["start"] for r in view] == np.cumsum([0, *(len(r["rendered"]) for r in view)])[:-1].tolist()
        learned = [whole[r["mask_start"] : r["mask_end"]] for r in view if r["mask_start"] is not None]
        assert learned == [f"{r[3]}{chat.CLOSE}" for r in order if r[2] == who]


def test_quality_rules_of_long_texts(spark):
    rng = random.Random(8)
    fresh = [f"w{i}" for i in range(20_000)]
    values = [
        " ".join(rng.choice("ab") for _ in range(3000)),
        " ".join(fresh),
        " ".join(fresh[:9000] + fresh[500:560] + fresh[9000:]),
        " ".join(fresh[:7000] * 2),
        "\n".join(" ".join(fresh[i : i + 40]) for i in (0, 40, 80, 0, 120)),
        "same " * 4000,
    ]
    for r in quality_rules.repetition(texts(spark, values)).collect():
        x = r["repetition"]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"], x["kept"]) == plain_rules(values[r["doc_id"]]), r["doc_id"]
    assert quality_rules.repetition(empty(spark)).count() == 0


def test_stages_of_nulls_repeated_rows_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    schema = docs.schema
    rows = [tuple(r) for r in docs.limit(30).collect()]
    at = {c: k for k, c in enumerate(docs.columns)}
    put = lambda r, **v: tuple(v.get(c, r[k]) for c, k in at.items())
    for f in schema:
        f.nullable = True
    odd = [put(rows[0], doc_id=None), put(rows[1], text=None), put(rows[2], source=None), put(rows[3], text=""), tuple(None for _ in at), rows[4], rows[4]]
    frame = spark.createDataFrame(rows + odd, schema).selectExpr("*", *(f"{i} as {c}" for i, c in enumerate(("n_lines", "n_dropped", "score", "component_id", "item_id", "label", "quality"))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, DIR)
        assert out.columns == frame.columns, name
        kept = out.collect()
        assert 0 < len(kept) <= frame.count() and all((r["n_lines"], r["n_dropped"], r["score"], r["quality"]) == (0, 1, 2, 6) for r in kept), name
    _, last = corpus_pipeline.STAGES[-1]
    assert last(spark, frame, DIR).count() == frame.count()
