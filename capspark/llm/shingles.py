"""Words, shingle sets and MinHash signatures of whole texts, as Arrow functions over batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from capspark.llm.session import give_back

SHINGLE = 5
VALUES = 64
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_RUN = 1 << 16  # shingles whose signatures are made together


class WordHashes(dict):
    """word -> 64-bit hash; forgotten as a whole when it gets too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """Of the words of a text, A-Z in lower case; bytes.split cuts at \\x20 and \\x09-\\x0D alone."""
    data = (text or "").encode()
    words = (data.lower() if lower else data).split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles; of fewer words the whole is the one shingle."""
    h = word_hashes(text)
    if not len(h):
        return h
    size = min(size, len(h))
    acc = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        acc = acc * _MIX[0] + h[k : len(h) - size + 1 + k]
    return np.unique(mixed(acc))


def _digests(sets: list[np.ndarray]) -> tuple[list, list, list]:
    n, a, b = [], [], []
    for s in sets:
        n.append(len(s))
        a.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
        b.append(int(mixed(s + _MIX[0]).sum(dtype=np.uint64).astype(np.int64)))
    return n, a, b


def signatures(sets: list[np.ndarray], odd: np.ndarray) -> np.ndarray:
    """A row of len(odd) 32-bit minima for each set; the sets are not empty."""
    out = np.empty((len(sets), len(odd)), np.int32)
    i = 0
    while i < len(sets):
        j, total = i, 0
        while j < len(sets) and (j == i or total + len(sets[j]) <= _RUN):
            total += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        starts = np.cumsum([0, *map(len, sets[i : j - 1])])
        for k, a in enumerate(odd):
            out[i:j, k] = (np.minimum.reduceat(flat * a, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        i = j
    return out


def _odd(values: int) -> np.ndarray:
    return mixed(np.arange(1, values + 1, dtype=np.uint64) * _MIX[0]) | np.uint64(1)


def signer(values: int = VALUES):
    """text -> (n_shingles, d1, d2: digests of the set; sig: null for an empty set)."""
    odd = _odd(values)

    def sign(texts: pa.Array) -> pa.Array:
        give_back()
        sets = [shingle_set(t) for t in texts.to_pylist()]
        n, a, b = _digests(sets)
        full = [s for s in sets if len(s)]
        sig = signatures(full, odd).ravel() if full else np.empty(0, np.int32)
        ends = np.cumsum([0, *(values if k else 0 for k in n)]).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(sig))], names=["n", "d1", "d2", "sig"])

    return F.arrow_udf(sign, "n long, d1 long, d2 long, sig array<int>").asNondeterministic()


def set_maker():
    """text -> (n, d1, d2, set: the hashes themselves)."""

    def make(texts: pa.Array) -> pa.Array:
        give_back()
        sets = [shingle_set(t) for t in texts.to_pylist()]
        n, a, b = _digests(sets)
        ends = np.cumsum([0, *n]).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["n", "d1", "d2", "shingles"])

    return F.arrow_udf(make, "n long, d1 long, d2 long, shingles array<long>").asNondeterministic()
