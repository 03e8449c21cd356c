"""The prefix trie of conversations, with sums over subtrees by parallel tree contraction.

A node is a distinct sequence of first turns; its key is its depth and 128 bits of hashes of its
turns' digests and places, so that the keys of all prefixes of a conversation come from one window
and no text moves. Sums over subtrees come from rounds of joins: all leaves are raked, that is
added to their parents, then every chain of nodes with one child is compressed by pointer jumping
into one edge that carries the chain's sums. Each round at least halves the leaves, and a chain of
any length takes logarithmically many joins, so deep and wide trees both end after few rounds.
Compressed nodes are then expanded again, the last rounds first, from the node below their chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capspark.llm.session import bound_batches, written

GROUP = 5
SHARED = 9
#: Ids that share a quotient by this are joined to one text before they are hashed in order.
IDS = 4096
_KEY = ["depth", "k1", "k2"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, by turn, null first, then by digest), digest of role and text, bytes of
    the text. Null roles and texts are empty; rows without a conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "digest", "bytes")


def rebuilt(rows: DataFrame, group: int = GROUP, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their beginnings: the first h turns of the group's first conversation
    (c - c % group; none if it is absent), then the own turns after the first h, where h is the
    CRC-32 of the decimal id % shared. rows: turns(). Returns (conv_id, n: turns) and rows of that."""
    c = F.col("conv_id")
    own = rows.groupBy("conv_id").agg(F.max("pos").alias("own"))
    base = own.select(c.alias("base"), F.col("own").alias("base_n"))
    convs = own.select("conv_id", "own", (c - c % group).alias("base"), (F.crc32(c.cast("string").cast("binary")) % shared).alias("h")).join(base, "base", "left")
    convs = convs.withColumn("first", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    convs = convs.select("conv_id", "base", "h", "first", (F.col("first") + F.greatest(F.lit(0).cast("long"), F.col("own") - F.col("h"))).alias("n"))
    heads = rows.filter(F.col("pos") < shared).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    heads = convs.filter("first > 0").select("conv_id", "base", "first").join(heads, "base").filter("pos <= first").select("conv_id", "pos", "digest", "bytes")
    rest = rows.join(convs.select("conv_id", "h", "first"), "conv_id").filter("pos > h").select("conv_id", (F.col("first") + F.col("pos") - F.col("h")).alias("pos"), "digest", "bytes")
    return convs.select("conv_id", "n"), heads.unionByName(rest)


def _members(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2, p1, p2 (the parent's key), bytes: each prefix of each conversation, but for the root."""
    w = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hashed = rows.select("conv_id", F.col("pos").alias("depth"), "bytes", F.xxhash64("pos", "digest").alias("h1"), F.xxhash64(F.lit("2"), "digest", "pos").alias("h2"), "pos")
    keyed = hashed.select("*", F.bit_xor("h1").over(w).alias("k1"), F.bit_xor("h2").over(w).alias("k2"))
    return keyed.select("conv_id", *_KEY, F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "bytes")


def _digests(ends: DataFrame) -> DataFrame:
    """ends: a node's key, conv_id. The key with the SHA-256 of its ids in ascending order, joined by
    commas. Ids are joined in ranges; a node with several is hashed as a stream of them."""
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))  # at most IDS
    parts = ends.groupBy(*_KEY, F.floor(F.col("conv_id") / IDS).alias("part")).agg(F.array_join(ids, ",").alias("ids"))
    parts = written(parts, "ends")
    several = parts.groupBy(*_KEY).agg(F.count("*").alias("parts")).filter("parts > 1").select(*_KEY)
    one = parts.join(several, _KEY, "left_anti").select(*_KEY, F.sha2("ids", 256).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        row = lambda: pa.RecordBatch.from_pylist([dict(zip((*_KEY, "ends_sha256"), (*key, sha.hexdigest()), strict=True))])
        for b in batches:
            for *at, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != key:
                    if key is not None:
                        yield row()
                    key, sha = at, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if key is not None:
            yield row()

    many = parts.join(several, _KEY, "left_semi").repartition(*_KEY).sortWithinPartitions(*_KEY, "part").select(*_KEY, "ids")
    return one.unionByName(many.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string"))


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """tree: id, parent (null at a root), and values (longs). Returns id and the sums of the values over
    each node's subtree, itself included. Any number of roots; an empty table gives no rows.

    A live node's sum is its value, with what was raked into it, plus for each live child the
    child's sum and what the edge to it carries (up_...).
    """
    up = [f"up_{v}" for v in values]
    child, zero = F.col("parent").isNotNull(), F.lit(0).cast("long")
    live = written(tree.select("id", "parent", *values, *[zero.alias(u) for u in up]), "live")
    done, chains = [], []
    while True:
        inner = live.filter(child).select(F.col("parent").alias("id")).distinct()
        leaves = written(live.join(inner, "id", "left_anti"), "leaves")
        done.append(leaves.select("id", *values))
        raked = leaves.filter(child).groupBy(F.col("parent").alias("id")).agg(*[F.sum(F.col(v) + F.col(u)).alias(f"got_{v}") for v, u in zip(values, up, strict=True)])
        rest = live.join(inner, "id", "left_semi").join(raked, "id", "left")
        live = written(rest.select("id", "parent", *[(F.col(v) + F.coalesce(f"got_{v}", zero)).alias(v) for v in values], *up), "live")
        if live.isEmpty():
            break
        only = live.filter(child).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("c"), F.max("id").alias("next"), *[F.sum(u).alias(f"next_{u}") for u in up])
        chain = live.filter(child).join(only.filter("c = 1"), "id").select("id", "parent", "next", *[(F.col(v) + F.col(f"next_{u}")).alias(v) for v, u in zip(values, up, strict=True)], *up)
        chain = written(chain, "chain")
        if chain.isEmpty():
            continue
        while True:
            jump = chain.select(F.col("id").alias("next"), F.col("next").alias("beyond"), *[F.col(v).alias(f"more_{v}") for v in values])
            sums = [(F.col(v) + F.coalesce(f"more_{v}", zero)).alias(v) for v in values]
            chain = written(chain.join(jump, "next", "left").select("id", "parent", F.coalesce("beyond", "next").alias("next"), *sums, *up, F.col("beyond").isNotNull().alias("moved")), "chain")
            if chain.filter("moved").isEmpty():
                break
        chains.append(chain.select("id", "next", *values))
        tops = chain.join(chain.select(F.col("id").alias("parent")), "parent", "left_anti")
        tops = tops.select(F.col("next").alias("id"), F.col("parent").alias("above"), *[(F.col(v) + F.col(u)).alias(f"new_{u}") for v, u in zip(values, up, strict=True)])
        rest = live.join(chain.select("id"), "id", "left_anti").join(tops, "id", "left")
        live = written(rest.select("id", F.coalesce("above", "parent").alias("parent"), *values, *[F.coalesce(f"new_{u}", u).alias(u) for u in up]), "live")

    totals = reduce(DataFrame.unionByName, done)
    for chain in reversed(chains):
        below = totals.select(F.col("id").alias("next"), *[F.col(v).alias(f"more_{v}") for v in values])
        found = chain.join(below, "next").select("id", *[(F.col(v) + F.col(f"more_{v}")).alias(v) for v in values])
        totals = totals.unionByName(written(found, "expanded"))
    return totals


def prefix_trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """convs: conv_id, n; rows: conv_id, pos (1 to n), digest, bytes, a row for each turn. Returns a row
    for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over its subtree, each node's bytes once for all members but one) and
    ends_sha256. A conversation without turns is at the root; no conversation gives no rows.

    A conversation's turns are put in order by one window over narrow rows; nothing else needs the
    rows of one conversation or node together.
    """
    bound_batches(rows.sparkSession)
    convs = written(convs, "convs")
    members = written(_members(convs, rows), "members")
    zero = F.lit(0).cast("long")
    inner = members.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("bytes").alias("bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    none = F.lit(None).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", none.alias("p1"), none.alias("p2"), zero.alias("bytes"))
    nodes = written(inner.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = written(nodes.join(above, ["depth", "p1", "p2"], "left").drop("p1", "p2"), "nodes")
    children = nodes.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children")).filter("id is not null")
    nodes = written(nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    own = nodes.select("id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    sums = subtree_sums(own, ["n_leaves", "saved_tokens"])

    last = convs.withColumnRenamed("n", "depth")
    ends = members.select("conv_id", *_KEY).join(last.filter("depth > 0"), ["conv_id", "depth"])
    ends = ends.unionByName(last.filter("depth = 0").select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2")))
    out = nodes.join(sums, "id").join(_digests(ends), _KEY, "left")
    digest = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest)


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations. Turns of one place are in order of their digests,
    so repeated rows are repeated turns; null roles and texts are empty, rows without a conv_id are
    left out, texts of any length are hashed where they are. Other columns are left out. An empty
    table gives no rows."""
    rows = written(turns(conversations), "turns")
    return prefix_trie(*rebuilt(rows))
