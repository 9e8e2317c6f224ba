"""Vectorised pre-tokenisation for byte-level BPE, and coding of pre-tokens through a table of distinct ones.

Everything here works on slices of a batch held as numpy arrays; no Python object is made per pre-token.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

_CLASSES = None
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
SLICE_BYTES = 1 << 20


def classes() -> np.ndarray:
    """The class of each code point: white space, letter, number or other."""
    global _CLASSES
    if _CLASSES is None:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        every = np.append(np.arange(0xD800), np.arange(0xE000, 0x110000)).astype("<u4").tobytes().decode("utf-32-le")  # all but surrogates, without an object for each
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
            for m in regex.finditer(pattern, every):
                table[ord(m[0][0]) : ord(m[0][-1]) + 1][: len(m[0])] = kind
        table[0xD800:0xE000] = OTHER
        _CLASSES = table
    return _CLASSES


def boundaries(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a match of public_tokenizers.PATTERN begins. cp: code points of all texts, one after another; first: True at each text's first one."""
    n = len(cp)
    b = np.ones(n, bool)
    if n < 2:
        return b
    c = classes()[cp]
    np.not_equal(c[1:], c[:-1], out=b[1:])
    b |= first
    # A run of white space before something else leaves its last one to it: a blank joins, others stand alone.
    e = np.flatnonzero((c[1:] != SPACE) & (c[:-1] == SPACE) & ~first[1:]) + 1
    b[e - 1] = True
    b[e[cp[e - 1] == 32]] = False
    a = np.flatnonzero(cp == 39)
    a = a[b[a]]
    a = a[a + 1 < n]
    a = a[~first[a + 1]]
    if len(a):
        x = cp[a + 1]
        y = cp[np.minimum(a + 2, n - 1)]
        has2 = (a + 2 < n) & ~first[np.minimum(a + 2, n - 1)]
        one = (x == 115) | (x == 116) | (x == 109) | (x == 100)  # s t m d
        two = has2 & (((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108)))  # re ve ll
        a, k = a[one | two], np.where(two, 2, 1)[one | two]
        b[a + 1] = False
        end = a + 1 + k
        b[end[end < n]] = True
    return b


def special_spans(raw: bytes, special, edge: np.ndarray) -> list[tuple[int, int]]:
    """(first byte, end) of each special string within one of the texts that begin at edge: the leftmost, of several there the longest, none over another."""
    if not any(x in raw for x in special):
        return []
    pattern = re.compile(b"|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)))
    out, at = [], 0
    while (m := pattern.search(raw, at)) is not None:
        end = int(edge[np.searchsorted(edge, m.start(), "right")])  # of the text where it begins
        own = m if m.end() <= end else pattern.match(raw, m.start(), end)
        if own is not None:
            out.append(own.span())
        at = own.end() if own is not None else m.start() + 1
    return out


class Slice:
    """Texts of a slice, cut into pre-tokens. starts: first byte of each pre-token; cuts: index of the first pre-token of each text."""

    def __init__(self, data: np.ndarray, text_starts: np.ndarray, special: list[bytes] | tuple = (), prior: np.ndarray | None = None):
        """data: UTF-8 of all texts; text_starts: their first bytes; special: strings that are one token wherever they stand, the leftmost first, then the longest; prior: known first bytes of pre-tokens."""
        self.data = data
        n = len(data)
        if prior is None:
            lead = None if n == 0 or int(data.max()) < 0x80 else np.flatnonzero((data & 0xC0) != 0x80)
            raw = data.tobytes()
            cp = data.astype(np.uint32) if lead is None else np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
            first = np.zeros(len(cp), bool)
            at = text_starts[text_starts < n]
            first[at if lead is None else np.searchsorted(lead, at)] = True
            inside = special_spans(raw, special, np.append(text_starts, n))
            spans = [(p, q) if lead is None else tuple(np.searchsorted(lead, [p, q])) for p, q in inside]
            for p, q in spans:
                first[p] = True
                if q < len(first):
                    first[q] = True
            b = boundaries(cp, first)
            for p, q in spans:
                b[p + 1 : q] = False
            starts = np.flatnonzero(b)
            self.starts = starts if lead is None else lead[starts]
        else:
            self.starts = prior
        self.cuts = np.searchsorted(self.starts, text_starts)

    def coded(self, distinct) -> tuple[np.ndarray, np.ndarray]:
        """(index of each pre-token among the distinct ones, what distinct() makes of those)."""
        offsets = np.append(self.starts, len(self.data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(self.data)])
        enc = pieces.dictionary_encode()
        return enc.indices.to_numpy(), distinct(enc.dictionary.to_pylist())


class Codec:
    """Ids of distinct pre-tokens, remembered up to a bound. encode: list of bytes -> list of little-endian uint32 bytes."""

    def __init__(self, encode, most: int = 300_000):
        self.encode, self.most, self.known = encode, most, {}

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = list(map(self.known.get, pieces))
        if None in got:
            missing = [i for i, g in enumerate(got) if g is None]
            new = self.encode([pieces[i] for i in missing])
            if len(self.known) + len(new) > self.most:
                self.known.clear()
            for i, g in zip(missing, new, strict=True):
                got[i] = g
            self.known.update((pieces[i], got[i]) for i in missing[: self.most] if len(pieces[i]) <= 64)
        lens = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        return lens, np.frombuffer(b"".join(got), np.uint32)


def gathered(index: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pre-tokens in order, and the number of ids before each pre-token (one more entry than pre-tokens)."""
    begin = np.cumsum(lens) - lens
    own = lens[index]
    before = np.zeros(len(index) + 1, np.int64)
    np.cumsum(own, out=before[1:])
    if len(index) and own.max(initial=0) == 1 and own.min() == 1:
        return flat[begin[index]], before
    at = np.repeat(begin[index] - before[:-1], own)
    at += np.arange(before[-1])
    return flat[at], before


def text_slices(column: pa.Array, most: int = SLICE_BYTES):
    """Cuts a string column (null: empty) into runs of whole texts: (row from, row to, bytes, first byte of each text). A text larger than most is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column = column.cast(pa.string())
        kind = np.int32
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i]
        i = j


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, text_starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(all words of the texts as a binary array, index of each text's first word and, at the end, their number). Words: runs without the white space 9-13 and 32."""
    keep = ~_SPACES[data]
    start = keep.copy()
    start[1:] &= ~keep[:-1]
    at = text_starts[text_starts < len(data)]
    start[at] = keep[at]
    pos = np.flatnonzero(start)
    flat = data[keep]
    if len(flat) == len(data):
        begin = pos
    else:
        begin = (np.cumsum(keep, dtype=np.int32) - 1)[pos]
    offsets = np.append(begin, len(flat)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(pos), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return found, np.append(np.searchsorted(pos, text_starts), len(pos))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z in UTF-8 bytes and nothing else."""
    return _LOWER[data]
