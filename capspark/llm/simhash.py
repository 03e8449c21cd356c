"""SimHash near-duplicates by tables of distances to pivots.

Every distinct fingerprint has a row with its Hamming distances to PIVOTS reference fingerprints,
packed eight to a long. Two fingerprints that differ in k bits have distances to any pivot that
differ by k at most, so a pair is discarded by its largest difference of coordinates before its bits
are counted. Pairs meet where they can link at all: fingerprints that differ in at most k of their
bits agree on all but k of any number of blocks of bits, so equal values of the other blocks are
their join keys; nothing is missed, and no pair of strangers is formed.

In a crowded bucket all meet the bucket's centre first, the fingerprint with most company in all
its buckets. What is then in different components of one bucket is compared exactly, but for the
bucket's largest component with itself.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capspark.llm.near import components
from capspark.llm.session import bound_batches, written

SHINGLE = 4
SEED = 42
DIFFERENT = 4
PIVOTS = 16
#: Fingerprints from which the pivots are chosen, as far apart as they can be. Any pivots give the same links.
PIVOT_SAMPLE = 1024
_RUN = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Of the shingles of a text, repeats included: a bit is 1 if it is in over half of their hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    n = len(words) - size + 1
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    ends, digest = ends[size - 1 :], xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _RUN):
        spans = zip(starts[k : k + _RUN].tolist(), ends[k : k + _RUN].tolist(), strict=True)
        h = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, min(_RUN, n - k))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprinter():
    """text -> fingerprint, as a long of the same bits."""
    return F.arrow_udf(lambda texts: pa.array(map(fingerprint, texts.to_pylist()), pa.int64()), "long").asNondeterministic()


def blocks_for(n: int, different: int = DIFFERENT) -> int:
    """Into how many blocks of bits n fingerprints are cut: the least whose keys, of all but
    `different` blocks, have about as many values as there are fingerprints. Any number is exact."""
    return next((m for m in range(different + 2, different + 6) if 2 ** (64 * (m - different) / m) >= n), different + 6)


def _keys(blocks: int, different: int) -> list[int]:
    """The masks of all choices of blocks that two fingerprints may agree on, as signed longs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    chosen = (sum(c) for c in combinations(masks, blocks - different))
    return [x - (1 << 64) if x >> 63 else x for x in chosen]


def pivots(prints: DataFrame, count: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> list[int]:
    """count reference fingerprints of prints (fp), each as far from the ones before as the sample has."""
    few = [r["fp"] for r in prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()] or [0]
    bits = np.array(few, np.int64).view(np.uint64)
    chosen, nearest = [0], np.bitwise_count(bits ^ bits[0])
    while len(chosen) < count:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.bitwise_count(bits ^ bits[chosen[-1]]))
    return [few[i] for i in chosen]


def distances(fp: Column, to: list[int]) -> list[Column]:
    """The Hamming distances of fp to the pivots, eight to a long: near_0, near_1, ..."""
    out = []
    for g in range(0, len(to), 8):
        parts = [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p).cast("long"))).cast("long"), 8 * i) for i, p in enumerate(to[g : g + 8])]
        out.append(reduce(lambda a, b: a.bitwiseOR(b), parts).alias(f"near_{g // 8}"))
    return out


def _within(x: str, y: str, count: int, different: int) -> Column:
    """Whether no coordinate differs by more than `different`, and then no more bits than that."""
    at = lambda side, i: F.shiftright(F.col(f"{side}near_{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(255).cast("long"))
    close = reduce(lambda a, b: a & b, [F.abs(at(x, i) - at(y, i)) <= different for i in range(count)])
    return close & (F.bit_count(F.col(f"{x}fp").bitwiseXOR(F.col(f"{y}fp"))) <= different)


def links(prints: DataFrame, different: int = DIFFERENT, count: int = PIVOTS, blocks: int | None = None) -> DataFrame:
    """prints: fp, distinct. Returns pairs a, b of them that differ in at most `different` bits, enough
    to connect all that such pairs connect."""
    to = pivots(prints, count)
    table = prints.select("fp", *distances(F.col("fp"), to))
    near = [c for c in table.columns if c != "fp"]
    masks = _keys(blocks or blocks_for(prints.count(), different), different)
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(masks)]))
    rows = table.select("fp", *near, key.alias("x")).select("x.k", "x.bits", "fp", *near)
    shared = rows.groupBy("k", "bits").agg(F.count("*").alias("c")).filter("c > 1")
    rows = written(rows.join(shared, ["k", "bits"]), "buckets")

    weighed = rows.join(rows.groupBy("fp").agg(F.sum("c").alias("w")), "fp")
    centre = weighed.groupBy("k", "bits").agg(F.max(F.struct("w", "fp", *near)).alias("m"))
    centre = centre.select("k", "bits", *[F.col(f"m.{c}").alias(f"y_{c}") for c in ("fp", *near)])
    x = rows.select("k", "bits", *[F.col(c).alias(f"x_{c}") for c in ("fp", *near)])
    star = x.join(centre, ["k", "bits"]).filter(F.col("x_fp") != F.col("y_fp")).filter(_within("x_", "y_", count, different))
    star = written(star.select(F.col("x_fp").alias("a"), F.col("y_fp").alias("b")).distinct(), "star")

    crowd = rows.filter("c > 2").drop("c").join(components(star).withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sizes = crowd.groupBy("k", "bits", "root").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("k", "bits").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots")).filter("roots > 1")
    apart = written(crowd.join(mixed.select("k", "bits", F.col("m.root").alias("most")), ["k", "bits"]), "apart")
    sides = [apart.select("k", "bits", *[F.col(c).alias(f"{s}{c}") for c in ("fp", "root", "most", *near)]) for s in ("x_", "y_")]
    # one side is outside its bucket's largest component; of two such, the smaller root is x
    once = (F.col("y_root") == F.col("y_most")) | (F.col("x_root") < F.col("y_root"))
    more = sides[0].filter("x_root <> x_most").join(sides[1], ["k", "bits"]).filter((F.col("x_root") != F.col("y_root")) & once & _within("x_", "y_", count, different))
    return star.unionByName(more.select(F.col("x_fp").alias("a"), F.col("y_fp").alias("b")).distinct())


def near_duplicates(docs: DataFrame, different: int = DIFFERENT, id_col: str = "doc_id", text_col: str = "text", count: int = PIVOTS, blocks: int | None = None) -> DataFrame:
    """For every row: id_col, fingerprint (16 hexadecimal digits), component_id (the smallest id
    reachable over fingerprints that differ in at most `different` bits).

    Shingles are SHINGLE words of the lower-cased (A-Z) text, repeats included; fewer words are one
    shingle; a null text and one without words have fingerprint zero and link like any other. A row
    counts by its fingerprint: rows that share an id may be in different components, and a row with a
    null id takes part; a component of such rows alone is null. Other columns are left out, whatever
    their names. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    signed = written(docs.select(F.col(id_col).cast("long").alias("id"), fingerprinter()(F.col(text_col)).alias("fp")), "signed")
    prints = written(signed.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    root = components(links(prints, different, count, blocks))
    member = prints.join(root.withColumnRenamed("id", "fp"), "fp")
    own = member.select("root", "least").unionByName(root.select("root").distinct().join(prints.withColumnRenamed("fp", "root"), "root"))
    label = own.groupBy("root").agg(F.min("least").alias("component"))
    labels = prints.join(root.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")).join(label, "root", "left")
    labels = written(labels.select("fp", F.coalesce("component", "least").alias("component")), "labels")
    return signed.join(labels, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
