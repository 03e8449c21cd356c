"""Whitening, SimHash and the prefix trie against plain versions, on the smallest tables and on rows
with nulls, ties, repeats, odd sizes, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from capspark.llm import queries, simhash, trie, whitening

DIR = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a  b", " x \n\n y   ", "Café 日本語 🙂🙂 123", "one two three four", "same text", "same text", "SAME  text", "w " * 70_000 + "end", "a b c　d"]
VEC = "vec_id long, embedding array<double>, id string, n long, __v int"


# 11


def plain_whitening(vectors, most=8):
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    y = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    e, w = np.linalg.eigh(y.T @ y / n)
    e, w = e[::-1], w[:, ::-1]
    return deviation, y @ w[:, :most] / np.sqrt(np.maximum(e[:most], 1e-300)), e / e.sum()


def check_whitening(rows, vectors, most=8):
    got = defaultdict(dict)
    for r in rows:
        got[r["vec_id"]][r["component"]] = r
    deviation, white, share = plain_whitening([v for _, v in vectors], most)
    for k in range(1, len(next(iter(got.values()))) + 1):
        sign = 1
        for i, (v, _) in enumerate(vectors):
            r = got[v][k]
            if i == 0:
                sign = np.sign(r["whitened"] * white[0, k - 1]) or 1
            assert r["deviation"] == deviation[i] and r["n"] == len(vectors)
            assert abs(r["whitened"] - sign * white[i, k - 1]) < 1e-7 and abs(r["explained"] / share[k - 1] - 1) < 1e-9
            assert r["identity_error"] < 1e-9
    assert got.keys() == {v for v, _ in vectors}
    return got


def test_whitening_query_equals_eigenvectors(spark):
    table = spark.read.parquet(f"{DIR}/embeddings.parquet")
    got = check_whitening(queries.op11_cholesky_whitening(spark, DIR).collect(), [(r["vec_id"], r["embedding"]) for r in table.collect()])
    assert all(r.keys() == set(range(1, 9)) for r in got.values())


def test_whitening_of_ill_conditioned_and_dependent_entries(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 4)) * [30, 1, 0.05, 0.002]
    rows = [(i, [*map(float, v), float(v[0]), 7.0], "id", 1, 2) for i, v in enumerate(base)]  # the fifth repeats the first, the sixth is constant
    got = check_whitening(whitening.whiten(spark.createDataFrame(rows, VEC).repartition(5)).collect(), [(r[0], r[1]) for r in rows], 4)
    assert all(r.keys() == {1, 2, 3, 4} for r in got.values())


def test_whitening_edges(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in rng.normal(size=3)], "id", 1, 2) for i in range(20)]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [1.0, float("inf"), 2.0]), (55, [1.0]), (56, [1.0] * 4)]
    frame = spark.createDataFrame(good + [(*b, "id", 1, 2) for b in bad], VEC)
    check_whitening(whitening.whiten(frame).collect(), [(r[0], r[1]) for r in good])
    twice = whitening.whiten(spark.createDataFrame([(None, r[1], "id", 1, 2) for r in good] + good, VEC)).filter("component = 1").collect()
    assert len(twice) == 40 and sum(r["vec_id"] is None for r in twice) == 20 and twice[0]["n"] == 40
    for rows in ([], good[:1], [good[0]] * 9, [(1, None, "id", 1, 2)]):
        assert whitening.whiten(spark.createDataFrame(rows, VEC)).count() == 0
    far = whitening.whiten(spark.createDataFrame([(i, [x, 1.0], "id", 1, 2) for i, x in enumerate((1e300, -1e300, 0.0))], VEC)).collect()
    assert {r["vec_id"]: r["deviation"] for r in far} == {0: None, 1: None, 2: 0} and all(r["component"] == 1 for r in far)


# 12


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c < "\x7f" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, different=4):
    """prints: (id, fingerprint). id -> smallest id reachable, for ids that come once."""
    bits = np.array([f for _, f in prints], np.uint64)
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= different).tolist():
            root[find(i + 1 + j)] = find(i)
    least = {}
    for i, (k, _) in enumerate(prints):
        r = find(i)
        least[r] = min(least.get(r, k), k)
    return {k: least[find(i)] for i, (k, _) in enumerate(prints)}


def test_simhash_query_equals_brute_force(spark):
    docs = [(r["doc_id"], plain_fingerprint(r["text"])) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    want = plain_groups(docs)
    got = queries.op12_simhash_pivots(spark, DIR).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {k: (f"{f:016x}", want[k]) for k, f in docs} and len(got) == len(docs)


@pytest.mark.parametrize("blocks", [None, 5, 8])
def test_simhash_links_connect_what_brute_force_connects(spark, blocks):
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for centre in list(prints)[:6]:  # crowds whose members are up to twelve bits from a centre
        for _ in range(120):
            x = centre
            for b in rng.sample(range(64), rng.randint(1, 12)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    rng.shuffle(prints)
    signed = [(i, f) for i, f in enumerate(prints)]
    as_long = lambda f: f - (1 << 64) if f >> 63 else f
    frame = spark.createDataFrame([(as_long(f),) for f in prints], "fp long").repartition(6)
    pairs = simhash.links(frame, blocks=blocks).collect()
    at = {as_long(f): i for i, f in signed}
    assert all(bin((r["a"] ^ r["b"]) & ((1 << 64) - 1)).count("1") <= 4 for r in pairs)
    near = defaultdict(set)
    for r in pairs:
        near[at[r["a"]]].add(at[r["b"]])
        near[at[r["b"]]].add(at[r["a"]])
    least = {}
    for i in range(len(prints)):
        todo, seen = [i], {i}
        while i not in least and todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        for k in seen:
            least.setdefault(k, i)
    assert least == plain_groups(signed)


def test_every_pair_within_reach_shares_a_key():
    rng = random.Random(2)
    for blocks in (5, 6, 7, 8):
        masks = [m & ((1 << 64) - 1) for m in simhash._keys(blocks, 4)]
        for _ in range(300):
            bits = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not bits & m for m in masks)
    assert [simhash.blocks_for(n) for n in (10, 2_000_000, 100_000_000, 10**9)] == [6, 6, 7, 8]


def test_simhash_edges(spark):
    rows = [(i, t, "id", 3) for i, t in enumerate(ODD)] + [(None, "same text", "id", 3), (None, "all alone here", "id", 3), (6, "quite another text of some words", "id", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id string, fp int")
    got = simhash.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    print_of = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    assert all((i, f"{plain_fingerprint(t):016x}") in print_of for i, t, *_ in rows)
    zero = "0" * 16
    assert print_of[0, zero] == print_of[1, zero] == print_of[2, zero] == 0
    same = f"{plain_fingerprint('same text'):016x}"
    assert print_of[7, same] == print_of[8, same] == print_of[9, same] == print_of[None, same] == 7
    assert print_of[None, f"{plain_fingerprint('all alone here'):016x}"] is None
    assert len({k for k in print_of if k[0] == 6}) == 2
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_simhash_joins_no_group_with_itself(spark):
    prints = spark.range(4000).select(F.shiftleft(F.col("id"), 3).alias("fp"))  # one bucket of thousands by any key of the upper bits
    plan = simhash.links(prints)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


# 13


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, total = [], {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves = 0 if children[p] else 1
        total[p] = (leaves + sum(total[x][0] for x in children[p]), saved + sum(total[x][1] for x in children[p]))
        ends = ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), parent, len(members[p]), len(children[p]), *total[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_query_equals_a_plain_trie(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{DIR}/conversations.parquet").collect()]
    assert sorted(tuple(r[c] for c in COLS) for r in queries.op13_prefix_trie(spark, DIR).collect()) == plain_trie(rows)


@pytest.mark.parametrize("seed", range(2))
def test_trie_of_odd_rows(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 3)  # so that nodes have their ids in several parts
    rng = random.Random(seed)
    rows = []
    for c in [*range(40), 1000, 1003]:
        for k in range(rng.choice([1, 1, 3, 9, 14])):
            rows.append((c, rng.choice([k, k, None, 2]), rng.choice(["user", "user", "assistant", None]), rng.choice(["hi", "hi", "", None, "Café 🙂", "x" * 3000])))
    rows += [(c, 0, "user", "hello") for c in range(2000, 2060)] + [(None, 0, "user", "hi"), (3, 1, "user", "hi"), (3, 1, "user", "hi")]
    frame = spark.createDataFrame([(*r, 7, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, id string")
    assert sorted(tuple(r[c] for c in COLS) for r in trie.rebuilt_trie(frame.repartition(4)).collect()) == plain_trie(rows)
    assert trie.rebuilt_trie(frame.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["chain", "star", "binary", "caterpillar", "forest"])
def test_subtree_sums_equal_a_loop(spark, kind):
    rng, n = random.Random(3), 700
    up = {"chain": lambda i: i - 1, "star": lambda i: 0, "binary": lambda i: (i - 1) // 2, "caterpillar": lambda i: i - 1 if i % 2 else max(0, i - 2), "forest": lambda i: None if i % 50 == 0 else rng.randint(i - i % 50, i - 1)}[kind]
    tree = [(i, None if i == 0 else up(i), rng.randint(0, 9), 1) for i in range(n)]
    a, b = [t[2] for t in tree], [1] * n
    for i, p, *_ in reversed(tree):
        if p is not None:
            a[p] += a[i]
            b[p] += b[i]
    got = trie.subtree_sums(spark.createDataFrame(tree, "id long, parent long, a long, b long"), ["a", "b"]).collect()
    assert {r["id"]: (r["a"], r["b"]) for r in got} == {i: (a[i], b[i]) for i in range(n)} and len(got) == n
    assert trie.subtree_sums(spark.createDataFrame([], "id long, parent long, a long"), ["a"]).count() == 0
