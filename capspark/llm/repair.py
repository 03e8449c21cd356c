"""Token ids in Re-Pair grammar blocks with random access.

Documents in ascending id order are tokenised and packed into blocks. In a block, frequent id pairs
are replaced by nonterminals again and again; a block stores its rules, the expansion length of
each rule, the final sequence, and where each document starts. A range of ids is decoded by finding
its symbols in the sums of expansion lengths and expanding only those. Blocks are rows of a Parquet
table, so Spark writes, commits and reads them.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capspark.llm.pieces import Memory
from capspark.llm.session import bound_batches, new_path

BLOCK = 1 << 18
#: Bytes of text whose pieces are looked up together.
LOT = 12 << 20
#: Rounds end when no pair is frequent, or when one has shortened the sequence by less than a share.
ROUNDS = 40
LEAST = 8
LEAST_GAIN = 0.02
RULES_A_ROUND = 4096
_BUCKETS = 17
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _hits(often: np.ndarray, bucket: np.ndarray, own: np.ndarray, buckets: int, rules: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which places are replaced, the rank of each place's pair, which of `often` replace two places)."""
    order = np.full(buckets, rules, np.int32)
    order[often] = np.arange(len(often), dtype=np.int32)
    pad = np.full(len(bucket) + 2, rules, np.int32)
    at = pad[1:-1]
    np.copyto(at, order[bucket], where=own)
    hit = (at < rules) & (at < pad[:-2]) & (at <= pad[2:])  # of a run of one pair the first
    used = np.bincount(at[hit], minlength=len(often)) >= 2
    hit &= np.append(used, np.zeros(rules + 1 - len(used), bool))[at]
    return hit, at, used


def compress(ids: np.ndarray, base: int, rounds: int = ROUNDS, least: int = LEAST, least_gain: float = LEAST_GAIN, rules: int = RULES_A_ROUND):
    """(sequence, left, right, lengths): rule k stands for id base + k. At most `rounds` rounds with
    `rules` new rules each; they end when no pair comes `least` times, or when one has shortened the
    sequence by less than a least_gain share. With least_gain 0 they go on until no pair can be
    replaced, which is seen on exact counts.

    A round counts pairs in a table of hash buckets; of two pairs that meet in a bucket the later
    one counts, the other waits for the next round's hash. The most frequent pairs become rules,
    and of matches that overlap the one with the more frequent pair is replaced.
    """
    seq = ids.astype(np.int64)
    lefts, rights, lengths = [], [], []
    size_of = np.ones(0, np.int64)
    top = base
    for r in range(rounds):
        if len(seq) < 2 * least:
            break
        pair = (seq[:-1] << 32) | seq[1:]
        bucket = ((pair.view(np.uint64) * np.uint64(_ODD[r % 3])) >> np.uint64(64 - _BUCKETS)).view(np.int64)
        owner = np.zeros(1 << _BUCKETS, np.int64)
        owner[bucket] = pair
        own = owner[bucket] == pair
        count = np.bincount(bucket[own], minlength=1 << _BUCKETS)
        often = np.flatnonzero(count >= least)
        often = often[np.argsort(-count[often], kind="stable")][:rules]
        hit, at, used = _hits(often, bucket, own, 1 << _BUCKETS, rules)
        if not hit.any() and least_gain == 0:  # a pair may have hidden behind another of its bucket
            owner, bucket, count = np.unique(pair, return_inverse=True, return_counts=True)
            often = np.flatnonzero(count >= least)
            often = often[np.argsort(-count[often], kind="stable")][:rules]
            hit, at, used = _hits(often, bucket, np.ones(len(bucket), bool), len(owner), rules)
        if not hit.any():
            break
        number = np.cumsum(used) - 1
        rule = owner[often[used]]
        left, right = rule >> 32, rule & 0xFFFFFFFF
        lefts.append(left)
        rights.append(right)
        of = lambda x: np.where(x < base, 1, size_of[np.maximum(x - base, 0)] if len(size_of) else 1)
        lengths.append(of(left) + of(right))
        where = np.flatnonzero(hit)
        before = len(seq)
        seq[where] = top + number[at[where]]
        stay = np.ones(before, bool)
        stay[where + 1] = False
        seq = seq[stay]
        size_of = np.concatenate((size_of, lengths[-1]))
        top += len(left)
        if before - len(seq) < before * least_gain:
            break
    join = lambda x: (np.concatenate(x) if x else np.empty(0)).astype("<u4")
    return seq.astype("<u4"), join(lefts), join(rights), join(lengths)


def _flat_rules(base: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rules one after the other, and where each rule's begin and end: each pass puts
    its two symbols in each nonterminal's place."""
    left, right = left.astype(np.int64), right.astype(np.int64)
    seq, of = np.arange(base, base + len(left)), np.arange(len(left))
    while (non := seq >= base).any():
        at = np.arange(len(seq)) + np.cumsum(non) - non
        out, whose = np.empty(len(seq) + int(non.sum()), np.int64), np.empty(len(seq) + int(non.sum()), np.int64)
        rule = seq[non] - base
        out[at], whose[at] = seq, of
        out[at[non]], out[at[non] + 1] = left[rule], right[rule]
        whose[at[non] + 1] = of[non]
        seq, of = out, whose
    return seq.astype("<u4"), np.searchsorted(of, np.arange(len(left) + 1))


def expand(seq: np.ndarray, base: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All ids of seq: plain ids come from seq itself, nonterminals from the flat rules after it."""
    flat, bounds = _flat_rules(base, left, right)
    non = seq >= base
    rule = seq[non].astype(np.int64) - base
    begin, size = np.arange(len(seq)), np.ones(len(seq), np.int64)
    begin[non], size[non] = len(seq) + bounds[rule], bounds[rule + 1] - bounds[rule]
    ends = np.cumsum(size)
    at = np.repeat(begin - (ends - size), size)
    at += np.arange(len(at))
    return np.concatenate((seq, flat)).astype("<u4", copy=False)[at]


def decode_range(block: dict, start: int, end: int) -> np.ndarray:
    """Ids start..end-1 of a block, expanding only the symbols that hold them."""
    base = block["base"]
    seq, left, right, lengths = (np.frombuffer(block[k], "<u4") for k in ("seq", "rule_left", "rule_right", "rule_len"))
    sizes = np.ones(len(seq), np.int64)
    non = seq >= base
    sizes[non] = lengths[seq[non] - base]
    ends = np.cumsum(sizes)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left")
    skip = start - (int(ends[a - 1]) if a else 0)
    return expand(seq[a : b + 1], base, left, right)[skip : skip + end - start]


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level tokenizer writes for each byte: printable Latin-1 stands for
    itself, the others are counted from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


@cache
def _tokenizer(path: str, pattern: str):
    """(tokenizer, what it knows of matches of its split pattern, the strings of its added tokens)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    letters = _byte_letters()

    def encode(matches: list[str]) -> list[bytes]:
        """The library's model takes one match at a time, in its byte-level alphabet."""
        space, tokenize = letters[32], t.model.tokenize
        own = [space + m[1:] if m.isascii() and m[0] == " " and m[1:].isalpha() else m.encode().decode("latin-1").translate(letters) for m in matches]
        return [array("i", [x.id for x in tokenize(m)]).tobytes() for m in own]

    return t, Memory(regex.compile(pattern).findall, encode, most=450_000), [x.content for x in t.get_added_tokens_decoder().values()]


def tokens_of(texts: pa.Array, path: str, pattern: str) -> list[np.ndarray]:
    """The ids of whole texts, as the library's encode gives them without special tokens. The
    byte-level split lets equal matches share one encoding; a text that holds the string of an added
    token, which is cut out before the split, goes to the library whole."""
    tokenizer, memory, added = _tokenizer(path, pattern)
    special = pa.array(np.zeros(len(texts), bool))
    for x in added:
        special = pc.or_(special, pc.fill_null(pc.match_substring(texts, x), False))
    out = memory.ids(pc.if_else(special, "", texts))
    for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
        out[i] = np.array(tokenizer.encode_batch_fast([texts[i].as_py()], add_special_tokens=False)[0].ids, "<i4")
    return out


_BLOCKS = "part int, block int, before long, n_tokens long, base int, rule_left binary, rule_right binary, rule_len binary, seq binary, doc_id array<long>, doc_start array<long>, doc_tokens array<long>"
_BLOCK_SCHEMA = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("base", pa.int32())]
    + [(k, pa.binary()) for k in ("rule_left", "rule_right", "rule_len", "seq")]
    + [(k, pa.list_(pa.int64())) for k in ("doc_id", "doc_start", "doc_tokens")]
)


def _lots(batches: Iterator[pa.RecordBatch], size: int = LOT) -> Iterator[pa.RecordBatch]:
    """Batches of size bytes or more, so that pieces which come again are looked up less often."""
    lot: list[pa.RecordBatch] = []
    for batch in batches:
        lot.append(batch)
        if sum(b.nbytes for b in lot) >= size:
            yield pa.concat_batches(lot)
            lot = []
    if lot:
        yield pa.concat_batches(lot)


def _pack(batches: Iterator[pa.RecordBatch], path: str, pattern: str, end_id: int, block: int, limits: dict) -> Iterator[pa.RecordBatch]:
    part, number, before = TaskContext.get().partitionId(), 0, 0
    base = max(_tokenizer(path, pattern)[0].get_vocab_size(), end_id + 1)
    docs, runs, n = [], [], 0

    def row() -> pa.RecordBatch:
        seq, left, right, lengths = compress(np.concatenate(runs), base, **limits)
        sizes = [len(x) for x in runs]
        starts = np.cumsum([0, *sizes])[:-1].tolist()
        values = [part, number, before, n, base, left.tobytes(), right.tobytes(), lengths.tobytes(), seq.tobytes(), docs, starts, sizes]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK_SCHEMA, strict=True)], schema=_BLOCK_SCHEMA)

    for batch in _lots(batches):
        for doc, ids in zip(batch.column(0).to_pylist(), tokens_of(batch.column(1), path, pattern), strict=True):
            docs.append(doc)
            runs.append(np.append(ids, end_id))
            n += len(runs[-1])
            if n >= block:
                yield row()
                number, before = number + 1, before + n
                docs, runs, n = [], [], 0
    if docs:
        yield row()


def write_tokens(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, **limits: float) -> str:
    """Write the ids of every text, end_id after each, in ascending id_col order, as grammar blocks;
    returns the table's path. pattern: the tokenizer's own split pattern; limits: those of compress()
    (rounds, least, least_gain, rules), which change the grammar and never the ids.

    One range shuffle of the texts; rows of one id are ordered by their text's hash. A null text
    has end_id only; a null id comes first. Repeated rows are documents of their own. Other columns
    are not stored. An empty table gives no blocks. A text larger than a block has a block to itself.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = path or new_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    rows.mapInArrow(lambda it: _pack(it, tokenizer, pattern, end_id, block, limits), _BLOCKS).write.parquet(path)
    return path


def _unpack(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            b = batch.slice(k, 1).to_pylist()[0]
            rules = [np.frombuffer(b[x], "<u4") for x in ("rule_left", "rule_right")]
            ids = expand(np.frombuffer(b["seq"], "<u4"), b["base"], *rules)
            starts, sizes = b["doc_start"], b["doc_tokens"]
            own = [ids[a : a + s] for a, s in zip(starts, sizes, strict=True)]
            m = len(own)
            cols = [pa.array([b["part"]] * m, pa.int32()), pa.array(b["doc_id"], pa.int64()), pa.array([b["before"] + a for a in starts], pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
            names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array([*starts, len(ids)], pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row a document from the blocks at path: doc_id, start (ids of all documents before it),
    n_tokens with the end id, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), and
    ids if wanted. What precedes a block in its partition is stored with it; what precedes the
    partition is summed over one row a partition."""
    bound_batches(spark)
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = blocks.mapInArrow(lambda it: _unpack(it, with_ids), "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    rows = rows.join(F.broadcast(sums.select("part", earlier.alias("earlier"))), "part")  # a row for each partition
    return rows.select("doc_id", (F.col("start") + F.col("earlier")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_slices(spark: SparkSession, path: str, asks: DataFrame) -> DataFrame:
    """Random access: asks (doc_id, first, last) as doc_id, first, ids: ids first..last-1 of a document,
    fewer at its end, none beyond it. Only the asked symbols of a block are expanded. The index of
    documents is read without the blocks' sequences; an unknown doc_id gives no row, one that comes
    several times a row for each of its documents."""
    bound_batches(spark)
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    index = blocks.select("part", "block", F.explode(F.arrays_zip("doc_id", "doc_start", "doc_tokens")).alias("d")).select("part", "block", "d.*")
    first = F.greatest(F.lit(0).cast("long"), F.col("first").cast("long"))
    found = index.join(asks.select(F.col("doc_id").cast("long").alias("doc_id"), first.alias("first"), F.col("last").cast("long").alias("last")), "doc_id")
    end = F.col("doc_start") + F.least("last", "doc_tokens")
    wanted = F.collect_list(F.struct("doc_id", "first", (F.col("doc_start") + F.col("first")).alias("a"), end.alias("b"))).alias("asks")
    rows = blocks.select("part", "block", "base", "rule_left", "rule_right", "rule_len", "seq").join(found.groupBy("part", "block").agg(wanted), ["part", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.slice(k, 1).to_pylist()[0]
                got = [decode_range(block, x["a"], x["b"]).astype(np.int32) if x["a"] < x["b"] else np.empty(0, np.int32) for x in block["asks"]]
                ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                cols = [pa.array([x[c] for x in block["asks"]], pa.int64()) for c in ("doc_id", "first")]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got)))], names=["doc_id", "first", "ids"])

    return rows.drop("part", "block").mapInArrow(run, "doc_id long, first long, ids array<int>")
