"""Sharding by longest-processing-time scheduling.

Groups that must stay together are taken by falling size, each to the least-loaded shard of a
heap. The driver never sees the groups: it gets a histogram of their sizes. Groups of one size are
interchangeable, so the heap deals out a whole size at once and each group finds its shard from
its rank within its size.

Bound of the histogram: sizes below 2**16 count as they are, larger ones in 2,048 classes for each
power of two, and groups of at least 1/4096 of a shard's share (at most 4096 * n_shards of them)
are placed one by one. The heap takes a group of a class by the mean size of its class. Sizes of one
class differ by less than a 2,048th, so a shard's true load is within 0.05 % of what the heap counts;
where no group lies in such a class the shards are those of plain scheduling.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capspark.llm.session import written

EXACT_BELOW = 1 << 16
BIG_SHARE = 4096
RANK_ROWS = 50_000
SLOT_ROWS = 20_000

_PLAN = T.StructType(
    [
        T.StructField("cls", T.LongType()),
        T.StructField("segs", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("cycle", T.ArrayType(T.IntegerType()))]))),
    ]
)


def deal(classes: list[tuple[int, int, int]], big: list[tuple[object, int]], n_shards: int):
    """The heap's work. big: (key, size) by falling size; classes: (class, groups, bytes in all).

    Returns ({key: shard}, [(class, [(first rank, shards in turn)])], loads). While the k least
    loaded shards are the only ones that come up, they come up in the same order again and again;
    such rounds are dealt at once.
    """
    loads = [(0, i) for i in range(n_shards)]
    placed = {}
    for key, size in big:
        load, i = heapq.heappop(loads)
        placed[key] = i
        heapq.heappush(loads, (load + size, i))
    plan = []
    for cls, count, total in sorted(classes, reverse=True):
        unit, rank, segs = total // count if total % count == 0 else total / count, 0, []
        while rank < count:
            loads.sort()
            turn = (loads[0][0] + unit, loads[0][1])
            active = [x for x in loads if x < turn]
            take = count - rank
            if rest := loads[len(active) :]:
                gap, last = rest[0], active[-1]
                rounds = max(1, int((gap[0] - last[0]) / unit))
                take = min(take, rounds * len(active))
            segs.append((rank, [i for _, i in active]))
            each, more = divmod(take, len(active))
            loads = [(x + unit * (each + (k < more)), i) for k, (x, i) in enumerate(active)] + rest
            rank += take
        plan.append((cls, segs))
    return placed, plan, loads


def size_class(size: Column) -> Column:
    bits = F.length(F.bin(size))
    shift = F.when(size < EXACT_BELOW, F.lit(0)).otherwise(bits - 12)
    return F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)


def assign_groups(groups: DataFrame, n_shards: int) -> DataFrame:
    """groups: one row a group with `key` (orderable, unique) and `size` (long, at least 1).

    Returns key, size, shard. An empty table gives an empty one. Ties go to the lower shard, and
    among groups of a size to the lower key.
    """
    spark = groups.sparkSession
    groups = written(groups.select("key", "size"), "groups")
    total = groups.agg(F.sum("size")).head()[0] or 0
    big_from = max(EXACT_BELOW, total // (n_shards * BIG_SHARE) + 1)
    big = groups.filter(F.col("size") >= big_from).orderBy(F.desc("size"), "key").collect()  # at most BIG_SHARE * n_shards
    small = groups.filter(F.col("size") < big_from).withColumn("cls", size_class(F.col("size")))
    classes = small.groupBy("cls").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    placed, plan, _ = deal([tuple(r) for r in classes], [(r["key"], r["size"]) for r in big], n_shards)

    # The rank within a class, in two steps so that a very common size is not one task's work.
    parts = spark.createDataFrame([(int(r["cls"]), int(-(-r["n"] // RANK_ROWS))) for r in classes], "cls long, parts int")
    salted = small.join(F.broadcast(parts), "cls").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("parts")))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("cls", "salt").orderBy("key")) - 1)
    before = salted.groupBy("cls", "salt").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy("cls").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    ranked = ranked.join(before.select("cls", "salt", "before"), ["cls", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    plans = spark.createDataFrame([(int(c), [(int(a), b) for a, b in s]) for c, s in plan], _PLAN)
    seg = F.element_at(F.filter("segs", lambda s: s["first"] <= F.col("rank")), -1)
    shard = seg["cycle"][F.pmod(F.col("rank") - seg["first"], F.size(seg["cycle"])).cast("int")]
    of_small = ranked.join(F.broadcast(plans), "cls").select("key", "size", shard.cast("int").alias("shard"))
    of_big = spark.createDataFrame([(k, int(s)) for k, s in placed.items()], T.StructType([groups.schema["key"], T.StructField("shard", T.IntegerType())]))
    return of_small.unionByName(groups.filter(F.col("size") >= big_from).join(F.broadcast(of_big), "key").select("key", "size", "shard"))


def shard_texts(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard so that the shards' bytes are near equal and equal texts meet.

    Returns id_col, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (gapless from 0 in each
    shard), grown_shard (null: another shard count is another plan). A null text counts as no
    bytes and goes with the empty ones. Repeated rows each get a slot. Other columns are not kept,
    whatever their names. An empty table gives no rows. One group's texts are one shard's by
    definition; a group larger than a shard's share makes that shard the largest.
    """
    data = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(F.col(id_col).alias("id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).cast("long").alias("crc"), F.unhex(F.sha2(data, 256)).alias("key")),
        "rows",
    )
    shards = assign_groups(rows.groupBy("key").agg(F.sum("size").alias("size")), n_shards)
    placed = written(rows.join(shards.select("key", "shard"), "key"), "placed")
    n = placed.agg(F.count("*")).head()[0]
    parts = max(1, -(-n // (n_shards * SLOT_ROWS)))
    placed = placed.withColumn("part", F.pmod(F.coalesce(F.col("id"), F.lit(0)).cast("long"), F.lit(parts)))
    before = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "key")) - 1
    return placed.withColumn("at", slot).join(before.drop("n"), ["shard", "part"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") + F.col("before")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
