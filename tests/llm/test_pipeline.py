"""run() against the stages' plain versions, on the smallest tables."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import tiktoken

from capspark.llm import classifier, lines

from .test_operators import plain_components

DIR = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_stages(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    frame = spark.read.parquet(f"{DIR}/documents.parquet")
    model = classifier.learn(frame, spark.read.parquet(f"{DIR}/labels.parquet"))
    docs = [d for d in docs if model.score(classifier.features(d["text"])[None].astype(float))[0] >= classifier.THRESHOLD]

    pages, held = Counter(d["source"] for d in docs), defaultdict(set)
    for d in docs:
        for x in d["text"].split("\n"):
            held[d["source"], x.strip(" \t\n\x0b\x0c\r")].add(d["doc_id"])
    ratio = lambda line: lines.MAX_RATIO_LONG if len(line) >= lines.LONG else lines.MAX_RATIO
    hot = {k for k, v in held.items() if k[1] and len(v) >= lines.MIN_PAGES and len(v) > pages[k[0]] * ratio(k[1])}
    for d in docs:
        d["text"] = "\n".join(x for x in d["text"].split("\n") if (d["source"], x.strip(" \t\n\x0b\x0c\r")) not in hot)

    root = plain_components([(d["doc_id"], d["text"]) for d in docs], 80)
    docs = [d for d in docs if root[d["doc_id"]][1] == d["doc_id"]]

    windows = defaultdict(set)
    size = {}
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = r["text"].lower().split()
        size[r["item_id"]] = len(w)
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].add((r["item_id"], k))

    def leaks(text):
        w, found = text.lower().split(), defaultdict(set)
        for k in range(len(w) - 7):
            for item, at in windows.get(tuple(w[k : k + 8]), ()):
                found[item].update(range(at, at + 8))
        return any(len(v) >= 0.5 * size[i] for i, v in found.items())

    docs = [d for d in docs if not leaks(d["text"])]

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d in docs:
        ids = enc.encode_ordinary(d["text"])
        want[d["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, DIR).collect()}
    assert got == want and 0 < len(got) < frame.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == docs.columns
        assert stage(spark, docs.limit(0), DIR).count() == 0
