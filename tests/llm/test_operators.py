"""Each operator against a plain version on small tables, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import heapq
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from capspark.llm import bpe, chat, classifier, decontamination, lines, near, quality_rules, repair, sharding, warc
from capspark.llm.pieces import cut
from capspark.llm.session import new_path

RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
ODD = [None, "", " ", "a  b", " x \n\n y   ", "Café 日本語 🙂🙂 123", "don't  'll", "same text", "same text", "x" * 5000 + "the" * 2000, "a b  c　d"]
DOC = "doc_id long, text string, id string, key string, n long, source string"


def texts(spark, values=ODD):
    rows = [(i, t, "id", "key", 7, "s") for i, t in enumerate(values)]
    return spark.createDataFrame(rows, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


# 1


def plain_lpt(groups, n):
    heap = [(0, i) for i in range(n)]
    out = {}
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        load, i = heapq.heappop(heap)
        out[key] = i
        heapq.heappush(heap, (load + size, i))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lpt_equals_a_plain_heap(spark, seed):
    rng = random.Random(seed)
    groups = [(f"{i:04}", rng.choice([1, 1, 1, 2, 7, 300, rng.randint(1, 5000)])) for i in range(400)] + [("z", 90_000)]
    got = {r["key"]: r["shard"] for r in sharding.assign_groups(spark.createDataFrame(groups, "key string, size long"), 5).collect()}
    assert got == plain_lpt(groups, 5)


def test_deal_many_equal_groups_at_once():
    _, plan, loads = sharding.deal([(3, 1_000_003, 3_000_009)], [("big", 1_500_000)], 4)
    assert sum(x for x, _ in loads) == 4_500_009 and max(loads)[0] - min(loads)[0] <= 375_000 * 2
    assert len(plan[0][1]) < 20


def test_sizes_dealt_by_class_stay_within_the_bound(spark):
    rng = random.Random(4)
    groups = [(f"{i:06}", rng.randint(sharding.EXACT_BELOW, 90_000)) for i in range(11_000)]
    assert sum(s for _, s in groups) // (2 * sharding.BIG_SHARE) > 90_000  # none is placed one by one
    got = {r["key"]: r["shard"] for r in sharding.assign_groups(spark.createDataFrame(groups, "key string, size long"), 2).collect()}
    plain = plain_lpt(groups, 2)
    assert got.keys() == plain.keys()
    for shard in (0, 1):
        load, exact = (sum(s for k, s in groups if of[k] == shard) for of in (got, plain))
        assert abs(load - exact) <= exact / 2048 + 90_000


def test_sharding_edges(spark):
    rows = sharding.shard_texts(texts(spark), 3).collect()
    assert len(rows) == len(ODD)
    shard = {r["doc_id"]: r["shard"] for r in rows}
    assert shard[7] == shard[8] and shard[0] == shard[1]
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["size"] == len((t or "").encode()) + 1 and by[i]["text_crc32"] == zlib.crc32((t or "").encode()) for i, t in enumerate(ODD))
    assert sharding.shard_texts(empty(spark), 3).count() == 0


# 2


def test_warc_round_trip(spark):
    big = "<p>" + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nünï " * 6000
    pages = [(5, "u5", big), (2, "u2", big), (9, None, big), (1, "u1", None), (3, "u\r\n3", ""), (4, "u4", "short"), (6, "u6", "short"), (7, "u7", "x" * 100), (7, "u7", "x" * 100), (8, "u8", "x" * 100 + "\r\n")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, payload string").repartition(2)
    path = warc.archive_pages(df, chunk=1000)
    got = sorted((tuple(r) for r in warc.read_records(spark, path).collect()), key=str)
    first = {}
    for p, _, h in sorted(pages, key=lambda x: x[0]):
        if h and len(h.encode()) >= 100:
            first.setdefault(h, p)
    want = []
    for p, _, h in pages:
        data, f = (h or "").encode(), first.get(h)
        again = f is not None and p > f
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", f if again else None))
    assert got == sorted(want, key=str)
    chunks = warc.read_chunks(spark, path, chunk=1000).filter("page_id = 2").orderBy("chunk_no").collect()
    assert b"".join(bytes(c["chunk"]) for c in chunks) == big.encode() and max(len(c["chunk"]) for c in chunks) <= 1000
    assert [c["last"] for c in chunks] == [False] * (len(chunks) - 1) + [True]
    assert chunks[0]["digest"] == hashlib.sha256(big.encode()[:1000]).hexdigest()


def test_warc_repeated_id_with_two_payloads(spark):
    pages = [(5, "u5", "p" * 200), (7, "u7", "p" * 200), (7, "u7", "q" * 300)]
    path = warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_records(spark, path).collect()}
    assert got == {(5, 200, "response", None), (7, 200, "revisit", 5), (7, 300, "response", None)}


def test_warc_several_archives_in_a_task(spark):
    html = [f"page {i}\r\n" * (i % 40) if i % 3 else f"copy {i % 7} " * 30 for i in range(600)]
    df = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").withColumn("url", F.lit("u"))
    path = warc.archive_pages(df.repartition(24, "page_id"))
    chunks = warc.read_chunks(spark, path)
    assert len(spark.read.text(path).inputFiles()) > 2 * chunks.rdd.getNumPartitions()  # several archives a task
    first = {}
    for i, h in enumerate(html):
        if len(h) >= 100:
            first.setdefault(h, i)
    got = {r["page_id"]: tuple(r)[1:] for r in warc.read_records(spark, path).collect()}
    assert sorted(got) == list(range(600))
    for i, h in enumerate(html):
        f = first.get(h, i)
        assert got[i] == (len(h), hashlib.sha256(h.encode()).hexdigest(), "revisit" if f < i else "response", f if f < i else None)
    whole = {r["page_id"]: bytes(r["chunk"]).decode() for r in chunks.collect()}
    assert whole == {i: "" if first.get(h, i) < i else h for i, h in enumerate(html)}


def test_warc_empty(spark):
    assert warc.read_records(spark, warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


# 3


def test_lines(spark):
    pages = [(i, f"{'boiler' if i < 6 else 'rare'}\n own {i}\n\n  boiler  ", "h", "x", 1, "s") for i in range(10)] + [(10, None, "h", "x", 1, None), (11, "", "h", "x", 1, "s"), (12, "boiler", "h", "x", 1, "t")]
    df = spark.createDataFrame(pages, "doc_id long, text string, host string, keys string, n_lines long, source string")
    got = {r["doc_id"]: r for r in lines.drop_boilerplate(df, "source", "text", max_ratio=0.5, min_pages=3).collect()}
    assert got[0]["text"] == " own 0\n" and got[0]["n_dropped"] == 2 and got[0]["n_lines"] == 4
    assert got[9]["text"] == "rare\n own 9\n" and got[10]["text"] is None and got[11]["text"] == "" and got[12]["text"] == "boiler"
    assert got[12]["host"] == "h"
    assert lines.drop_boilerplate(df.limit(0)).count() == 0
    twice = lines.drop_boilerplate(spark.createDataFrame([(1, "a line"), (1, "a line"), (2, "b")], "doc_id long, text string").withColumn("source", F.lit("s")), "source", "text", max_ratio=0.5, min_pages=2)
    assert sorted(r["text"] for r in twice.collect()) == ["", "", "b"]  # repeated rows are pages of their own
    url = spark.createDataFrame([("HTTP://u@Ex.Com:80/a",)], "u string").select(lines.host_of(F.col("u")))
    assert url.head()[0] == "ex.com"


def test_lines_of_a_length_and_of_a_very_long_page(spark):
    short, long = "see also", "x" * lines.LONG
    rows = [(i, f"own {i}\n" + (f"{short}\n\x0b{long} \r" if i < 6 else f"none {i}")) for i in range(100)]
    rows.append((100, "\n".join(f"line {k} of the page" for k in range(20_000))))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    began = time.time()
    got = {r["doc_id"]: r for r in lines.drop_boilerplate(df).collect()}
    assert time.time() - began < 30
    assert got[0]["text"] == f"own 0\n{short}" and got[0]["n_dropped"] == 1 and got[50]["text"] == "own 50\nnone 50"
    assert got[100]["n_lines"] == 20_000 and got[100]["text"] == rows[100][1]


def test_lines_that_all_go_take_linear_work(spark):
    def run(n):
        text = "\n".join(f"line {k} of every page here" for k in range(n))
        df = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string").withColumn("source", F.lit("s"))
        began = time.time()
        got = lines.drop_boilerplate(df).collect()
        assert all(r["text"] == "" and r["n_dropped"] == r["n_lines"] == n for r in got) and len(got) == 6
        return time.time() - began

    run(100)
    assert run(20_000) < 10
    assert run(80_000) < 20


def test_pages_of_large_hosts_are_dealt_to_parts(spark, monkeypatch):
    rows = [(i, f"own {i}\nthis very line is everywhere\nown {i} too", "big" if i % 3 else f"h{i % 9}", i) for i in range(300)] + [(300, None, None, 0), (301, "", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, parts int").repartition(5)
    want = sorted(map(str, lines.drop_boilerplate(df).collect()))
    monkeypatch.setattr(lines, "HOST_PAGES", 7)
    assert sorted(map(str, lines.drop_boilerplate(df).collect())) == want and "everywhere" not in "".join(want)
    monkeypatch.setattr(lines, "LARGE_HOSTS", 10)  # parts are larger then
    assert sorted(map(str, lines.drop_boilerplate(df).collect())) == want


# 4


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_cut_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("ab .\n\t 　é'1") for _ in range(rng.randint(0, 30)))
        assert "".join(cut(t)) == t
        assert sum((encoding_cached().encode_ordinary(p) for p in cut(t)), []) == encoding_cached().encode_ordinary(t)


_enc = []


def encoding_cached():
    if not _enc:
        _enc.append(encoding())
    return _enc[0]


def test_bpe(spark):
    tokens = bpe.encode(texts(spark).withColumn("ids", F.lit("clash")), RANKS, PATTERN)
    both = bpe.round_trip(texts(spark).withColumn("ids", F.lit("clash")), RANKS, PATTERN)
    for r in bpe.decode(tokens, RANKS).unionByName(both).collect():
        t = ODD[r["doc_id"]] or ""
        assert r["ids"] == encoding_cached().encode_ordinary(t) and r["decoded"] == t and r["key"] == "key"
    assert bpe.encode(empty(spark), RANKS, PATTERN).count() == 0 and bpe.round_trip(empty(spark), RANKS, PATTERN).count() == 0
    nulls = bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), RANKS).collect()
    assert [r["decoded"] for r in nulls] == ["", ""]


@pytest.mark.parametrize("few", [False, True])
def test_bpe_of_random_texts(monkeypatch, few):
    """few: little is remembered, and matches are read one by one or in small groups."""
    if few:
        for name, x in (("MOST_TRANSITIONS", 300), ("SIDE_BY_SIDE", 6), ("GROUP", 5)):
            monkeypatch.setattr(bpe, name, x)
    coder = bpe._coder.__wrapped__(RANKS, PATTERN)[1]
    coder.most = 50 if few else 10_000
    rng = random.Random(9)
    parts = ["the", " the", " therapy", "  ", "\n", " \n ", "é", " 日本", "🙂", "'s", " 1234", "!?", "\t", "　", "zq", " Xx", "-" * 200]
    values = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(400)] + [None]
    got = coder.ids(pa.array(values, pa.string()))
    assert [g.tolist() for g in got] == [encoding_cached().encode_ordinary(t or "") for t in values]


def test_steps_grow():
    steps = bpe._Steps(lambda a, b: 1000 * a + b, bits=3)
    keys = np.arange(5000, dtype=np.int64)
    for _ in range(2):
        assert (steps.many(keys) == 1000 * (keys >> 8) + (keys & 255)).all()
    assert steps.n == 5000


def test_transducer_lookahead_and_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_TRANSITIONS", 50)
    transducer = bpe._coder(RANKS, PATTERN)[0]
    rng = random.Random(2)
    for n in (1, 7, 900, 3000):
        word = "".join(rng.choice("etaoinshr") for _ in range(n))
        assert transducer.encode(word.encode()) == encoding_cached().encode_ordinary(word)


def test_utf8_machine():
    data = "aé日🙂z".encode()
    for size in range(1, 6):
        m = bpe.Utf8Machine()
        assert "".join(m.feed(data[i : i + size]) for i in range(0, len(data), size)) + m.end() == data.decode()
    m = bpe.Utf8Machine()
    assert m.feed(b"\xf0\x9f") == "" and m.end() == "�"


# 5


@pytest.mark.parametrize("kind", ["random", "runs", "copies"])
def test_repair_is_lossless(kind):
    rng = np.random.default_rng(3)
    x = {"random": rng.integers(0, 50, 20_000), "runs": np.repeat(rng.integers(0, 9, 900), 30), "copies": np.tile(rng.integers(0, 5000, 700), 20)}[kind].astype(np.int32)
    seq, left, right, lengths = repair.compress(x, 60_000)
    assert len(seq) < len(x) and (repair.expand(seq, 60_000, left, right) == x).all()
    block = {"base": 60_000, "seq": seq.tobytes(), "rule_left": left.tobytes(), "rule_right": right.tobytes(), "rule_len": lengths.tobytes()}
    for a, b in ((0, 5), (17, 18), (100, 999), (len(x) - 3, len(x))):
        assert (repair.decode_range(block, a, b) == x[a:b]).all()


def test_token_files(spark):
    path = repair.write_tokens(texts(spark).repartition(3), JSON, PATTERN, 2, block=500)
    got = {r["doc_id"]: r for r in repair.read_tokens(spark, path).collect()}
    start = 0
    for i, t in enumerate(ODD):
        ids = [*encoding_cached().encode_ordinary(t or ""), 2]
        r = got[i]
        assert (r["ids"], r["start"], r["n_tokens"], r["ids_crc32"]) == (ids, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert repair.read_tokens(spark, repair.write_tokens(empty(spark), JSON, PATTERN, path=new_path(spark, "none"))).count() == 0


def test_repair_goes_to_the_end_where_asked():
    x = np.tile(np.random.default_rng(5).integers(0, 40, 900), 3).astype(np.int32)
    seq, left, right, lengths = repair.compress(x, 1000, rounds=10_000, least=2, least_gain=0, rules=50)
    assert (repair.expand(seq, 1000, left, right) == x).all() and len(seq) < len(repair.compress(x, 1000)[0])
    seen, k = {}, 0
    for k, pair in enumerate(zip(seq.tolist(), seq[1:].tolist())):  # no pair is left that comes twice without overlap
        assert k - seen.setdefault(pair, k) < 2, pair


def test_slices_of_token_files(spark):
    path = repair.write_tokens(texts(spark).repartition(3), JSON, PATTERN, 2, block=300, least=2, least_gain=0.0)
    whole = {r["doc_id"]: r["ids"] for r in repair.read_tokens(spark, path).collect()}
    asks = [(i, a, b) for i in range(len(ODD)) for a, b in ((0, 3), (1, 10_000), (2, 2), (5000, 6000), (40, 90))] + [(99, 0, 1)]
    got = sorted((r["doc_id"], r["first"], r["ids"]) for r in repair.read_slices(spark, path, spark.createDataFrame(asks, "doc_id long, first long, last long")).collect())
    assert got == sorted((i, a, whole[i][a:b]) for i, a, b in asks if i in whole)
    index = [x for x in repair.read_slices(spark, path, spark.createDataFrame(asks, "doc_id long, first long, last long"))._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in x]
    assert any("seq" not in x and "doc_start" in x for x in index)


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(JSON), random.Random(10)
    parts = ["<|endoftext|>", "<|endoftext|>" * 2, " a", "b<|end", "oftext|>", "  ", "\n", "é日", "it's ", " 12", "x" * 40, "　", " the", "\u0558"]
    values = [None, "", " ", "<|endoftext|>a", "a<|endoftext|>", "wo<|endoftext|>rd"] + ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(500)]
    got = repair.tokens_of(pa.array(values, pa.string()), JSON, PATTERN)
    assert [g.tolist() for g in got] == [library.encode(t or "", add_special_tokens=False).ids for t in values]


def test_byte_letters_are_the_library_s():
    from tokenizers import pre_tokenizers

    for b in range(128):
        assert pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0] == repair._byte_letters()[b]
    assert sorted(repair._byte_letters().values()) == sorted(pre_tokenizers.ByteLevel.alphabet())


# 6


def test_decontamination(spark):
    item = "A train leaves with 12 apples and then Maria buys 30 apples for 4 dollars how many are left now"
    again = "pad words here . A train leaves with 15 apples and then Laura buys 41 apples for 9 dollars how many are left now . the end"
    mixed = again.replace("41 apples", "15 apples").replace("9 dollars", "15 dollars")
    docs = [(1, "intro text " + item + " outro"), (2, again), (3, "nothing to see here at all really nothing at all"), (4, None), (5, ""), (6, "tiny item text"), (1, "intro text " + item + " outro"), (7, mixed)]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, h string, item string")
    bench = spark.createDataFrame([(10, item, 1), (11, "tiny item text", 1), (12, None, 1), (13, "", 1)], "item_id long, text string, n int")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontamination.matches(df, bench).collect()}
    assert got == {(1, 10): True, (2, 10): False, (6, 11): True, (7, 10): False}
    assert sorted(r["doc_id"] for r in decontamination.drop_contaminated(df, bench).collect()) == [3, 4, 5]
    assert decontamination.matches(df.limit(0), bench).count() == 0 and decontamination.matches(df, bench.limit(0)).count() == 0


def test_slots_must_agree(spark):
    item = "first there were 5 birds on the old tree and later 7 birds sat on the old tree"
    same = item.replace("5", "8").replace("7", "9")
    item_b = "first there were 5 birds on the old tree and later 5 birds sat on the old tree"
    df = spark.createDataFrame([(1, same)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item_b)], "item_id long, text string")
    assert [r["item_id"] for r in decontamination.matches(df, bench).collect()] == [1]


def test_decontamination_at_every_offset_and_of_few_plain_words(spark):
    item = "seven grey herons watch over that muddy pond"
    docs = [(k, " ".join(["pad"] * k + [item, "and more"])) for k in range(4)]
    docs += [(10, "please solve 45 + 12 today"), (11, "please solve 45 + 13 today")]
    bench = spark.createDataFrame([(1, item), (2, "Solve 45 + 12")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["exact"]) for r in decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(k, 1, True) for k in range(4)} | {(10, 2, True)}


def plain_matches(docs, items, template, window=8, share=0.5, least_plain=3):
    """op6 by loops: every window of an item against every window of a document."""
    out = set()
    kind = lambda w: w[:2] if w[0] == "\x01" else w
    held = lambda ws: [w for w in ws if w[0] == "\x01"]
    for doc, d in docs:
        for item, t in items:
            words, own = template[d], template[t]
            size = min(window, len(own))
            found = {}  # shift -> [(at, item's slots, document's slots, strict)]
            for i in range(len(own) - size + 1 if own else 0):
                for j in range(len(words) - size + 1):
                    a, b = own[i : i + size], words[j : j + size]
                    if list(map(kind, a)) == list(map(kind, b)):
                        few = size - len(held(a)) < min(least_plain, size)
                        if not few or held(a) == held(b):
                            found.setdefault(j - i, []).append((i, held(a), held(b), few))
            good = []
            for rows in found.values():
                pairs = {p for _, a, b, few in rows if not few for p in zip(a, b, strict=True)}
                agree = len(pairs) == len({a for a, _ in pairs})
                good += [(i, any(x != y for x, y in pairs) and not few) for i, _, _, few in rows if few or agree]
            covered = {k for i, _ in good for k in range(i, i + size)}
            if own and good and len(covered) >= share * len(own):
                out.add((doc, item, len({i for i, _ in good}), round(len(covered) / len(own), 9), not any(other for _, other in good)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_equals_loops(spark, seed):
    rng = random.Random(seed)
    words = ["the", "old", "tree", "has", "birds", "and", "Maria", "Peter", "7", "12", "12", "5", "km", "kg", "sat", "near"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, some(rng.choice([2, 3, 5, 8, 9, 12, 20, 30]))) for i in range(12)] + [(90, None), (91, ""), (92, "12 12 7")]
    docs = []
    for k in range(60):
        ws = (rng.choice(items)[1] or "").split()
        if k % 2:
            ws = [{"7": "71", "12": "33", "5": "9", "Maria": "Laura"}.get(w, w) for w in ws]
        for _ in range(rng.randint(0, 2)):
            if ws:
                ws[rng.randrange(len(ws))] = rng.choice(words)
        docs.append((k, " ".join([some(rng.randint(0, 9)), *ws, some(rng.randint(0, 9))])))
    docs.append((60, " ".join([some(4000), items[3][1]])))
    docs += [(61, None), (62, "")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    every = df.select("text").unionByName(bench.select("text")).distinct()
    template = {r["text"]: r["w"] for r in every.select("text", decontamination.template_words(F.col("text")).alias("w")).collect()}
    got = {(r["doc_id"], r["item_id"], r["n_windows"], round(r["covered"], 9), r["exact"]) for r in decontamination.matches(df, bench, least_words=1).collect()}
    want = plain_matches(docs, items, template)
    assert got == want
    assert len(want) > 20 and {e for *_, e in want} == {True, False}


def test_items_of_a_word_or_two_are_not_searched_for(spark):
    df = spark.createDataFrame([(1, "Yes it is the case"), (2, "no one knows the answer to it"), (3, "the answer is seven")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Yes"), (2, "the"), (3, "the answer"), (4, "the answer is"), (5, None), (6, "")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.matches(df, bench).collect()] == [(3, 4)]
    assert {(r["item_id"], r["n_words"]) for r in decontamination.short_items(bench).collect()} == {(1, 1), (2, 1), (3, 2)}
    assert sorted(r["doc_id"] for r in decontamination.drop_contaminated(df, bench).collect()) == [1, 2]


def test_decontamination_plan_is_native(spark):
    plan = decontamination.matches(texts(spark), spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 7


def words_of(t):
    return (t or "").encode().lower().split()


def plain_components(rows, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_near_duplicates_equal_brute_force(spark, threshold):
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, "A b"), (3, "a  B"), (4, "a b c d e"), (5, " \n")]
    for g in range(12):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([8, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame([(*r, 1, "c", "r") for r in rows], "doc_id long, text string, n int, sig string, rep string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(df, threshold).collect()}
    want = plain_components(rows, round(100 * threshold))
    assert got == want
    kept = near.drop_near_duplicates(df, threshold)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, (_, c) in want.items() if c == i] and kept.columns == df.columns


@pytest.mark.parametrize(("threshold", "own", "of_two"), [(0.8, 33, 7), (0.85, 26, 8)])
def test_near_duplicates_in_a_family_of_one_template(spark, threshold, own, of_two):
    template = [f"t{i}" for i in range(300)]
    rows = []
    for p in range(250):  # partners share words that no other document of the family has
        shared = [f"p{p}x{i}" for i in range(of_two)]
        rows += [(i, " ".join([*template, *shared, *(f"d{i}x{k}" for k in range(own))])) for i in (2 * p, 2 * p + 1)]
    random.Random(8).shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), threshold).collect()}
    want = plain_components(rows, round(100 * threshold))
    assert len({c for _, c in want.values()}) == 250
    assert got == want


def test_near_duplicates_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "other words altogether here now ok")]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (-1, 1, False), (1, 1, True), (1, 1, True)]
    assert near.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 1").count() == 1
    assert near.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_with_more_ids_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near, "BROADCAST_IDS", 0)
    words = [f"w{i}" for i in range(200)]
    rows = [(5, " ".join(words)), (6, " ".join([*words[:-1], "x"])), (6, " ".join(f"v{i}" for i in range(300))), (9, " ".join(words[::-1]))]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(5, 5), (6, 5), (6, 5), (9, 9)]


def test_near_duplicates_compare_each_text_of_an_id(spark):
    def near_of(letter, k):
        return " ".join([*(f"{letter}{i}" for i in range(199)), f"{letter}z{k}"])

    rows = [(20, near_of("a", 0)), (20, near_of("b", 0)), (20, near_of("c", 0)), (20, None), (31, near_of("a", 1)), (32, near_of("b", 1)), (12, near_of("c", 1)), (40, near_of("d", 0)), (12, near_of("e", 0)), (41, near_of("e", 1)), (41, near_of("f", 0)), (42, near_of("f", 0)), (None, near_of("d", 0))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"] or -1, r["component_id"], r["n_shingles"] > 0) for r in near.near_duplicates(docs).collect())
    assert got == sorted([(-1, 40, True), *[(12, 12, True)] * 2, *[(20, 12, True)] * 3, (20, 20, False), (31, 12, True), (32, 12, True), (40, 40, True), *[(41, 12, True)] * 2, (42, 12, True)])
    assert sorted(r["doc_id"] or -1 for r in near.drop_near_duplicates(docs).collect()) == [-1, 12, 40]


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_exact_links_need_no_region(spark, threshold):
    rng = random.Random(11)
    rows = []
    for g in range(25):  # pairs around the threshold; one tree of one great depth sees next to none of them
        base = [f"g{g}w{i}" for i in range(240)]
        for cuts in (0, 3, 4, 5, 6):
            copy = list(base)
            for at in rng.sample(range(2, 230, 6), cuts):
                copy[at] = f"e{rng.randint(0, 10**9)}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_components(rows, round(100 * threshold))
    assert 25 < len({c for _, c in want.values()}) < len(rows)
    found = [{r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(df, threshold, trees=1, depths=(22,), slack=0.0, exact=e).collect()} for e in (True, False)]
    assert found[0] == want != found[1]


def test_of_one_id_the_same_row_stays_whatever_the_order(spark):
    rng = random.Random(4)
    rows = [(i % 7, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30)), f"s{i % 3}") for i in range(40)]
    rows += [(3, rows[3][1], "other"), (3, rows[3][1], "other"), (None, "a b c", "x"), (None, "a b c", "x"), (5, None, "x")]
    kept = []
    for parts in (1, 3, 8):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        kept.append(sorted(map(str, near.drop_near_duplicates(df).collect())))
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 9


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["id"]: r["root"] for r in near.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}


# 8


def test_perspectives(spark):
    rows = [(1, 0, "system", "be <|kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 300, "ann", "bye"), (2, 0, "system", "alone"), (None, 0, None, "x"), (1, 1, "ann", "hi")]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "conv_id long, turn long, role string, text string, p string, name string")
    got = chat.perspectives(df).collect()
    assert {(r["conv_id"], r["perspective"]) for r in got} == {(1, "ann"), (1, "bob"), (None, "unknown")}
    view = sorted((r for r in got if r["conv_id"] == 1 and r["perspective"] == "ann"), key=lambda r: r["start"])
    whole = "".join(r["rendered"] for r in view)
    assert [r["start"] for r in view] == [sum(x["n_chars"] for x in view[:k]) for k in range(len(view))]
    assert [whole[r["mask_start"] : r["mask_end"]] for r in view if r["mask_start"] is not None] == ["hi<|im_end|>", "hi<|im_end|>", "bye<|im_end|>"]
    assert whole.startswith("<|im_start|>system\nbe < |kind<|im_end|>\n") and "<|im_start|>user name=bob\n<|im_end|>\n" in whole
    assert chat.perspectives(df.limit(0)).count() == 0
    assert "Python" not in chat.perspectives(df)._jdf.queryExecution().toString()


# 9


def plain_repeats(w):
    return [max((next((k for k in range(len(w)) if max(i, j) + k >= len(w) or w[i + k] != w[j + k]), 0) for j in range(len(w)) if j != i), default=0) for i in range(len(w))]


def test_longest_repeats_equal_brute_force():
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, k, n).astype(np.uint64) for k, n in ((2, 40), (5, 60), (1, 17), (100, 50), (3, 1), (3, 80))]
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    got = quality_rules.longest_repeats(np.concatenate(parts), starts)
    assert got.tolist() == sum((plain_repeats(p.tolist()) for p in parts), [])
    assert len(quality_rules.longest_repeats(np.zeros(0, np.uint64), np.zeros(0, np.int64))) == 0


def plain_rules(t):
    w = (t or "").encode().split()

    def cover(size):
        seen, hit = {}, set()
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i : i + size]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                hit.update(i + k for i in at for k in range(size))
        return len(hit)

    ls = [x for x in (t or "").split("\n") if x.strip(quality_rules.BLANKS)]
    base = len(w) < 20 or 100 * cover(8) > 30 * len(w)
    kept = not base and 100 * cover(quality_rules.LEAST_REPEAT) <= quality_rules.MAX_COVERED * len(w) and cover(quality_rules.LONGEST + 1) == 0
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), cover(8), base, kept


def test_quality_rules(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 99)}"
    base = [word() for _ in range(130)]
    values = [*ODD, " ".join(base), " ".join(base * 2), " ".join(base[:30] + [f"u{i}" for i in range(200)] + base[:30]), " ".join(base[:105] + [f"u{i}" for i in range(900)] + base[:105]), "a # b\na # b\n$ |\n" * 3]
    out = quality_rules.repetition(texts(spark, values).withColumn("repetition", F.lit(1)))
    for r in out.collect():
        x = r["repetition"]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"], x["kept"]) == plain_rules(values[r["doc_id"]]), values[r["doc_id"]]
        assert sum(x["span_ends"]) - sum(x["span_starts"]) == x["covered_words"]
    assert quality_rules.repetition(empty(spark)).count() == 0


# 10


def test_classifier_finds_junk(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    good = [" ".join(word() for _ in range(80)).capitalize() + "." for _ in range(900)]
    junk = [" ".join(word() + rng.choice(["$$$", "###", "%%%"]) for _ in range(80)) for _ in range(300)]
    rows = [(i, t, int(i < 900)) for i, t in enumerate(good + junk)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    model = classifier.learn(docs, labels)
    assert 0.6 < model.prior < 0.9
    scored = classifier.score(docs, model).withColumn("held", classifier.held_out(F.col("doc_id"))).filter("held").collect()
    right = [(r["score"] >= classifier.THRESHOLD) == (r["doc_id"] < 900) for r in scored]
    assert len(right) > 150 and sum(right) / len(right) > 0.97
    flipped = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(classifier.learn(docs, flipped).weight, model.weight)
    odd = classifier.score(texts(spark).withColumn("score", F.lit("clash")), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert classifier.score(empty(spark), model).count() == 0


def plain_features(t):
    data = (t or "").encode()
    words = data.split()
    if not words:
        return [0.0] * 135 + [1.0] + [0.0] * classifier.WORDS
    classes = [0] * classifier.WORDS
    for w in data.lower().split():
        classes[(xxhash.xxh3_64_intdigest(w) >> 32) % classifier.WORDS] += 1
    share = [sum(b == c for b in data) / len(data) for c in range(128)]
    shares = [x**0.5 for x in [*share, sum(b >= 128 for b in data) / len(data)]]
    again = sum(a == b for a, b in zip(words, words[1:]))
    letters = sum(chr(b).isalpha() for b in data if b < 128) or 1
    marks = sum(33 <= b < 127 and not chr(b).isalnum() for b in data)
    upper = sum(65 <= b < 91 for b in data)
    n = len(words)
    return [*shares, np.log(1 + len(set(words))) / np.log(1 + n), (again / n) ** 0.5, (upper / letters) ** 0.5, marks / n, len(data) / n / 10, data.count(b"\n") / n, 0.0, *((c / n) ** 0.5 for c in classes)]


def test_classifier_features_equal_plain_counts():
    for t in [*ODD, "AB ab AB AB\n#1 $2, x;y [z] {q} ~ `"]:
        assert np.allclose(classifier.features(t), plain_features(t), atol=1e-5)


def test_classifier_minimises_the_non_negative_risk():
    rng = np.random.default_rng(3)
    prior, dim = 0.6, classifier.DIM
    good, bad = (lambda n, m=m: np.concatenate((rng.normal(m, 1, (n, 3)), rng.normal(0, 1, (n, dim - 3))), 1) for m in (0.8, -0.8))
    p, u = good(700), np.concatenate((good(900), bad(600)))
    both = np.concatenate((p, u))
    mean, scale = both.mean(0), both.std(0) + 1e-3
    scale[classifier.SHAPES :] *= classifier.DAMP
    x_p, x_u = ((x - mean) / scale for x in (p, u))

    def risk(w, b):
        """prior * R+(p) + max(0, R-(u) - prior * R-(p)), one row at a time, with the decay."""
        z_p, z_u = ([float(row @ w + b) for row in x] for x in (x_p, x_u))
        loss = lambda z: np.log(1 + np.exp(z))
        negative = sum(map(loss, z_u)) / len(z_u) - prior * sum(map(loss, z_p)) / len(z_p)
        return prior * sum(loss(-z) for z in z_p) / len(z_p) + max(0, negative) + 5e-4 * w @ w

    model = classifier.fit(p, u, prior)
    least = risk(model.weight, model.bias)
    assert least < 0.9 * risk(np.zeros(dim), 0.0)
    for k in range(10):
        step = rng.normal(0, 1, dim + 1)
        step *= 0.3 / np.linalg.norm(step)
        assert risk(model.weight + step[:-1], model.bias + step[-1]) > least - 1e-3, k
    model = classifier.fit(good(2800), np.concatenate((good(3600), bad(2400))))
    assert abs(model.prior - prior) < 0.1
    above = model.score(good(1000))[:, None] > model.score(bad(1000))[None, :]
    assert above.mean() > 0.92  # of pairs; the best possible is 0.975, with 700 and 1,500 rows it was 0.88


def test_learn_takes_the_rows_of_the_least_hashes(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "Delta", "$$", "9"]) for _ in range(rng.randint(1, 30)))
    rows = [(i, text()) for i in range(150)] + [(i, text()) for i in range(0, 150, 7)] + [(None, text()) for _ in range(5)] + [(200, None), (201, "")]
    labels = [(i, int(i % 3 > 0), 0) for i in [*range(0, 150, 2), 200, 300]] + [(4, 0, 0), (3, 1, 0), (None, 1, 0), (8, None, 0)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, quality int").repartition(4)
    got = classifier.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_positives=25, max_unlabelled=40)

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    ids = [i for i, _ in rows if i is not None and not held(i)]  # an id that comes twice counts twice here
    good = {i for i, q, _ in labels if q == 1 and i is not None and not held(i)}

    def least(some, n, kind):
        def place(i):
            h = xxhash.xxh64_intdigest(kind.encode(), xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42))
            return h - (1 << 64) if h >> 63 else h

        return set(sorted(some, key=place)[:n])

    p, u = least([i for i in ids if i in good], 25, "p"), least(ids, 40, "u")
    chosen = sorted(((i, classifier.features(t).astype("<f4").tobytes()) for i, t in rows if i in p | u))
    x = np.array([np.frombuffer(b, "<f4") for _, b in chosen], np.float64)
    want = classifier.fit(x[[i in p for i, _ in chosen]], x[[i in u for i, _ in chosen]])
    assert want.weight.any() and np.allclose(got.weight, want.weight) and (got.bias, got.prior) == pytest.approx((want.bias, want.prior))


def test_classifier_without_labels_loses_nothing(spark):
    docs = texts(spark)
    model = classifier.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r["score"] > 0.9 for r in classifier.score(docs, model).collect())
    assert classifier.learn(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).prior == 0.95
