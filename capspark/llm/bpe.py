"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decode.

A prefix of a match has exactly one encoding, and it is that of a shorter prefix plus one token
that stays apart from the token before it. So the transducer's threads are the starts of tokens
that may still be open: (place in the trie of tokens, token before the start). The set of threads
is the deterministic state; reading a byte advances all threads, and gives the token that ends
there if the text does. Tokens on which the paths to all open starts agree are emitted, so the
delay is bounded by the longest token. States and transitions are made when a text first needs
them and kept by number.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capspark.llm.pieces import Memory
from capspark.llm.session import bound_batches, give_back

#: Ids of a text that are decoded together.
RUN = 1 << 16
#: Pairs of tokens whose verdicts are kept.
MOST_PAIRS = 150_000
#: Transitions after which the transducer forgets all its states.
MOST_TRANSITIONS = 400_000
#: Bytes of a match after which what is sure is emitted; longer than two of the longest tokens.
LOOKAHEAD = 1024
#: Bytes up to which matches are read side by side, and how many of them at once.
SIDE_BY_SIDE = 128
GROUP = 1 << 15
_ODD, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1
_NEVER = 1 << 60
_TOKEN = (1 << 20) - 1


class _Steps:
    """state << 8 | byte -> next state << 20 | token that may end here; made when first asked for.
    A hash table with open addressing, asked for one key or for many at once."""

    def __init__(self, advance: Callable[[int, int], int], bits: int = 19):
        self.advance, self.n = advance, 0
        self._size(bits)

    def _size(self, bits: int) -> None:
        self.bits, self.mask = bits, (1 << bits) - 1
        self.keys, self.values = array("q", [-1]) * (1 << bits), array("q", [0]) * (1 << bits)
        self.all_keys, self.all_values = np.frombuffer(self.keys, np.int64), np.frombuffer(self.values, np.int64)

    def _place(self, key: int) -> int:
        """Where key is, or where it goes."""
        keys, i = self.keys, (key * _ODD & _WORD) >> (64 - self.bits)
        while keys[i] != key and keys[i] >= 0:
            i = (i + 1) & self.mask
        return i

    def one(self, key: int) -> int:
        i = self._place(key)
        if self.keys[i] != key:
            if 2 * self.n > self.mask:
                old = [(k, v) for k, v in zip(self.keys, self.values, strict=True) if k >= 0]
                self._size(self.bits + 1)
                for k, v in old:
                    j = self._place(k)
                    self.keys[j], self.values[j] = k, v
                i = self._place(key)
            self.n += 1
            self.values[i] = self.advance(key >> 8, key & 255)
            self.keys[i] = key
        return self.values[i]

    def many(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys.view(np.uint64) * np.uint64(_ODD)) >> np.uint64(64 - self.bits)).view(np.int64)
        out = self.all_values[at]
        left = np.flatnonzero(self.all_keys[at] != keys)
        at = at[left]
        for _ in range(2 if len(left) else 0):  # the neighbours of a place that is taken
            at = at + 1 & self.mask
            out[left] = self.all_values[at]
            still = self.all_keys[at] != keys[left]
            left, at = left[still], at[still]
        if len(left):
            own, which = np.unique(keys[left], return_inverse=True)
            out[left] = np.array([self.one(k) for k in own.tolist()], np.int64)[which]
        return out


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.size_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.size_of[i] = len(t)
        self._child: dict[int, int] = {}  # node << 8 | byte -> node of the trie of all tokens
        self._token: list[int] = [-1]
        self._open: list[bool] = [True]  # whether some token goes on from the node
        self._depth: list[int] = [0]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                self._open[node] = True
                key = node << 8 | byte
                if (to := self._child.get(key)) is None:
                    to = self._child[key] = len(self._token)
                    self._token.append(-1)
                    self._open.append(False)
                    self._depth.append(self._depth[node] + 1)
                node = to
            self._token[node] = i
        self._apart: dict[int, bool] = {}
        self._last: dict[int, tuple[int, int] | None] = {}
        self._made: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.next = _Steps(self._advance)
        self.start = self._state((0,))

    def _state(self, threads: tuple[int, ...]) -> int:
        """threads: node << 20 | token before its start, plus 1 (0 at the start of the match)."""
        n = self.number.get(threads)
        if n is None:
            n = self.number[threads] = len(self.states)
            self.states.append(threads)
        return n

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, or if merges do not make it."""
        if token not in self._last:
            parts = [self.bytes_of[token][i : i + 1] for i in range(len(self.bytes_of[token]))]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank >= token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._last[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
            self._made[token] = len(parts) <= 2
        return self._last[token]

    def _stays(self, before: int, token: int) -> bool:
        """Whether the merges make this token, and leave it apart from the one before.

        Going back in time, the token at the right edge of `before` and the one at the left edge of
        `token` are what the merges saw side by side. They would have been joined if their merge
        comes before the merges that used them up. Of equal merges the one further left is first.
        """
        self._halves(token)
        if not self._made[token] or before < 0:
            return self._made[token]
        if len(self._apart) > MOST_PAIRS:
            self._apart.clear()
        x, y, x_until, y_until = before, token, _NEVER, _NEVER
        ok = True
        while True:
            joined = self.ranks.get(self.bytes_of[x] + self.bytes_of[y], _NEVER)
            if joined < x_until and joined <= y_until and joined != _NEVER:
                ok = False
                break
            x_halves, halves = self._halves(x), self._halves(y)
            if x_halves is not None and (halves is None or x > y):  # the later of the two merges is undone first
                x_until, x = x, x_halves[1]
            elif halves is not None:
                y_until, y = y, halves[0]
            else:
                break
        self._apart[before << 32 | token] = ok
        return ok

    def _advance(self, state: int, byte: int) -> int:
        child, tokens, still, apart = self._child, self._token, self._open, self._apart
        going, done = [], -1
        for thread in self.states[state]:
            before = thread & _TOKEN
            to = child.get(thread >> 20 << 8 | byte)
            if to is None:
                continue
            if done < 0 and (token := tokens[to]) >= 0:
                ok = apart.get((before - 1) << 32 | token)
                if ok is None:
                    ok = self._stays(before - 1, token)
                if ok:
                    done = token
            if still[to]:
                going.append(to << 20 | before)
        going.append(done + 1)
        return self._state(tuple(going)) << 20 | done

    def _sure(self, state: int, ends: list[int]) -> tuple[int, list[int]]:
        """How far the paths to all open starts agree, and the tokens up to there."""
        depth, common = self._depth, None
        for thread in self.states[state]:
            at, path = len(ends) - depth[thread >> 20], []
            while at > 0:
                path.append(at)
                at -= len(self.bytes_of[ends[at - 1]])
            common = set(path) if common is None else common.intersection(path)
        upto = at = max(common, default=0)
        return upto, self._back(ends, at)

    def _back(self, ends: list[int], at: int) -> list[int]:
        out, bytes_of = [], self.bytes_of
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= len(bytes_of[token])
        out.reverse()
        return out

    def encode(self, match: bytes) -> list[int]:
        """The tokens of one match of the split pattern. ends has the token that ends at each byte
        since the last emitted one; what is sure is emitted every LOOKAHEAD bytes."""
        if (whole := self.ranks.get(match)) is not None:
            return [whole]
        if self.next.n > MOST_TRANSITIONS:
            self._reset()
        state, step, out, ends = self.start, self.next, [], []
        for i in range(0, len(match), LOOKAHEAD):
            if i:
                upto, tokens = self._sure(state, ends)
                out += tokens
                del ends[:upto]
                if step.n > MOST_TRANSITIONS:
                    threads = self.states[state]
                    self._reset()
                    step, state = self.next, self._state(threads)
            for byte in match[i : i + LOOKAHEAD]:
                to = step.one(state << 8 | byte)
                state = to >> 20
                ends.append(to & _TOKEN)
        return out + self._back(ends, len(ends))

    def encode_all(self, matches: list[bytes]) -> list[bytes]:
        """The tokens of each match as little-endian 32-bit integers. Matches of at most SIDE_BY_SIDE
        bytes are read side by side, a byte of each at a time; longer ones one after the other."""
        out: list[bytes | None] = [None] * len(matches)
        short = []
        for i, m in enumerate(matches):
            whole = self.ranks.get(m)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(m) > SIDE_BY_SIDE:
                out[i] = array("i", self.encode(m)).tobytes()
            elif m:
                short.append(i)
            else:
                out[i] = b""
        for a in range(0, len(short), GROUP):
            if self.next.n > MOST_TRANSITIONS:
                self._reset()
            group = sorted(short[a : a + GROUP], key=lambda i: -len(matches[i]))
            for i, x in zip(group, self._side_by_side([matches[i] for i in group]), strict=True):
                out[i] = x
        return out

    def _side_by_side(self, matches: list[bytes]) -> Iterator[bytes]:
        """matches: by falling length, none empty."""
        sizes = np.fromiter(map(len, matches), np.int64, len(matches))
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(matches), np.uint8).astype(np.int64)
        ends, state = np.empty(len(data), np.int64), np.full(len(matches), self.start)
        for k in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -k))  # those of more than k bytes
            to = self.next.many(state[:n] << 8 | data[starts[:n] + k])
            state[:n] = to >> 20
            ends[starts[:n] + k] = to & _TOKEN
        last, at = np.zeros(len(data), bool), starts + sizes
        while len(at):  # back from the end of each match, token by token
            last[at - 1] = True
            at = at - self.size_of[ends[at - 1]]
            going = at > starts
            at, starts = at[going], starts[going]
        tokens, counts = ends[last].astype("<i4").tobytes(), np.add.reduceat(last, np.cumsum(sizes) - sizes, dtype=np.int64)
        upto = (4 * np.cumsum(counts)).tolist()
        return (tokens[i:j] for i, j in zip([0, *upto[:-1]], upto, strict=True))


class Utf8Machine:
    """An incremental UTF-8 decoder: state is the bytes of a character that has not ended."""

    def __init__(self) -> None:
        self.pending = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that needs more."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead < 0x80:
                return 0
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                return back if back < need else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.pending + bytes(data)
        keep = self._unfinished(data)
        self.pending = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def end(self) -> str:
        data, self.pending = self.pending, b""
        return data.decode("utf-8", "replace")


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _tokens(path: str) -> pa.Array:
    """The bytes of each id, by id."""
    bytes_of = {i: t for t, i in _ranks(path).items()}
    return pa.array([bytes_of.get(i) for i in range(max(bytes_of) + 1)], pa.binary())


@cache
def _coder(path: str, pattern: str) -> tuple[Transducer, Memory]:
    """One for each worker; the file is on every machine."""
    transducer = Transducer(_ranks(path))
    return transducer, Memory(regex.compile(pattern).findall, lambda matches: transducer.encode_all([m.encode() for m in matches]), most=150_000)


def encode_texts(texts: pa.Array, path: str, pattern: str) -> list[np.ndarray]:
    return _coder(path, pattern)[1].ids(texts)


def decode_stream(ids: np.ndarray, path: str, run: int = RUN) -> Iterator[str]:
    """Text as it becomes certain, run by run of ids."""
    tokens, machine = _tokens(path), Utf8Machine()
    for i in range(0, len(ids), run):
        got = tokens.take(pa.array(ids[i : i + run]))
        size = np.frombuffer(got.buffers()[1], np.int32)[len(got)]
        yield machine.feed(memoryview(got.buffers()[2])[:size])
    yield machine.end()


def decode_ids(ids: np.ndarray, path: str) -> str:
    return "".join(decode_stream(ids, path))


def _lists(arrays: list[np.ndarray], dtype: type) -> pa.Array:
    ends = np.cumsum([0, *(len(a) for a in arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(dtype, copy=False) if arrays else np.empty(0, dtype)))


def encoder(path: str, pattern: str):
    """An Arrow function: text -> ids. A null or empty text has no ids."""

    def encode(texts: pa.Array) -> pa.Array:
        return _lists(encode_texts(texts, path, pattern), np.int32)

    return F.arrow_udf(encode, "array<int>").asNondeterministic()  # so that no rewrite runs it twice


def decoder(path: str):
    """An Arrow function: ids -> text."""

    def decode(ids: pa.Array) -> pa.Array:
        flat, sizes = ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().fill_null(0).to_numpy()
        ends = np.cumsum(sizes)
        return pa.array([decode_ids(flat[a:b], path) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], pa.string())

    return F.arrow_udf(decode, "string").asNondeterministic()


def round_tripper(path: str, pattern: str):
    """An Arrow function: text -> its ids, and the text that these ids decode to. One function, so a
    task has one worker and the ids of a batch are not sent back to it."""

    def both(texts: pa.Array) -> pa.Array:
        give_back()
        ids = encode_texts(texts, path, pattern)
        decoded = pa.array([decode_ids(i, path) for i in ids], pa.string())
        return pa.StructArray.from_arrays([_lists(ids, np.int32), decoded], names=["ids", "decoded"])

    return F.arrow_udf(both, "ids array<int>, decoded string").asNondeterministic()


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col (array<int>; a column of that name is replaced): the tokens of each whole
    text, each match of pattern encoded by the ranks in the file at path, no special tokens. A null
    or empty text has no ids; repeated rows are encoded each; an empty table gives no rows. No
    shuffle: each row stays where it is, and long texts are encoded run by run."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(ids_col, encoder(path, pattern)(text_col))


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """tokens with text_col: the text of each row's ids (null or no ids: the empty text)."""
    bound_batches(tokens.sparkSession)
    return tokens.withColumn(text_col, decoder(path)(ids_col))


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with ids as from encode() and decoded as from decode(); columns of these names are replaced."""
    bound_batches(docs.sparkSession)
    both = docs.withColumn("ids", round_tripper(path, pattern)(text_col))
    return both.withColumn("decoded", F.col("ids.decoded")).withColumn("ids", F.col("ids.ids"))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
