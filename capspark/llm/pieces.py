"""Cutting texts before single spaces, and remembering what pieces encode to.

A space before a character that is no white space always starts a new match of the split pattern,
and no match runs across it. So a text can be cut there, and equal pieces encode alike.
"""

from __future__ import annotations

import contextlib
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of a piece or match that is remembered.
LONGEST = 24
#: Code points of Unicode's White_Space (fixed values).
WHITE = "\x09\x0a\x0b\x0c\x0d\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: A text with a space before white space or at its end.
_WIDE_GAP = " $| [" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE) + "]"
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_MARKS = r"!-&(-/:-@\[-`{-~"  # ASCII marks but for the apostrophe
#: Pieces of letters, after a space or not, are one match. Pieces of letters, marks and single line
#: ends fall into runs; all others are left to the split pattern.
_one_match = re.compile(f" ?[{_LETTERS}]+").fullmatch
_of_runs = re.compile(rf" ?[{_LETTERS}{_MARKS}](?:[{_LETTERS}{_MARKS}]|\n(?!\n))*").fullmatch
_runs = re.compile(rf" ?[{_LETTERS}]+| ?[{_MARKS}]+|\n").findall


@contextlib.contextmanager
def _no_collector() -> Iterator[None]:
    """Pieces and ids are in no cycles, so looking for cycles among millions of them is wasted."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def cut(text: str) -> list[str]:
    """The pieces of text; joined they are the text."""
    first, *rest = text.split(" ")
    out, white = [first], frozenset(WHITE)
    for p in rest:
        if not p or p[0] in white:
            out[-1] += " " + p
        else:
            out.append(" " + p)
    return out if out[0] else out[1:]


class Memory(dict):
    """Pieces and matches of the split pattern, of which pieces are made -> their ids as
    little-endian 32-bit integers. split(piece) gives a piece's matches, encode(matches) the ids of
    each. All is forgotten at `most` entries, and entries of more than LONGEST characters are not
    kept, so a worker's memory is bounded. None of this changes a result."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]], most: int = 300_000):
        super().__init__()
        self.split, self.encode, self.most = split, encode, most

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of whole texts; a null has none. Arrow cuts the texts at their spaces and finds
        the distinct pieces; texts with wider gaps, or with a space at their end, are cut one by one."""
        texts = pc.fill_null(texts, "")
        wide = pc.match_substring_regex(texts, _WIDE_GAP).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(texts.filter(pa.array(~wide)), " ")
        starts = parts.offsets.to_numpy()
        flat = parts.flatten().dictionary_encode()
        keys = [" " + p for p in flat.dictionary.to_numpy(zero_copy_only=False).tolist()]
        at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = parts.flatten().take(pa.array(starts[:-1])).to_numpy(zero_copy_only=False).tolist()  # no space comes before these
        at[starts[:-1]] = len(keys) + np.arange(len(firsts))
        alone = [cut(t) for t in texts.filter(pa.array(wide)).to_pylist()]
        with _no_collector():
            coded = self._coded([*keys, *firsts, *(p for pieces in alone for p in pieces)])

        got = pa.array(coded[: len(keys) + len(firsts)], pa.large_binary()).take(pa.array(at))
        data, ends = got.buffers()[2], np.frombuffer(got.buffers()[1], np.int64)[: len(got) + 1] // 4
        whole, ends = np.frombuffer(data, "<i4") if data and data.size >= 4 else np.empty(0, "<i4"), ends[starts].tolist() if len(got) else [0]
        tame = iter([whole[i:j] for i, j in zip(ends, ends[1:], strict=False)])
        k, rest = len(keys) + len(firsts), []
        for pieces in alone:
            rest.append(np.frombuffer(b"".join(coded[k : k + len(pieces)]), "<i4"))
            k += len(pieces)
        other = iter(rest)
        return [next(other) if w else next(tame) for w in wide]

    def _coded(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.get, pieces))
        new = [p for p, x in zip(pieces, found, strict=True) if x is None]
        parts = {p: _runs(p) if _of_runs(p) else self.split(p) for p in new if not _one_match(p)}
        todo = dict.fromkeys([p for p in new if p not in parts])
        todo.update(dict.fromkeys([m for ms in parts.values() for m in ms if m not in self]))
        if todo:
            self.update(zip(todo, self.encode(list(todo)), strict=True))
        for p, ms in parts.items():
            self[p] = b"".join([self[m] for m in ms])
        out = [self[p] if x is None else x for p, x in zip(pieces, found, strict=True)] if new else found
        if len(self) > self.most:
            self.clear()
        for p in (*todo, *parts):
            if len(p) > LONGEST:
                self.pop(p, None)
        return out
