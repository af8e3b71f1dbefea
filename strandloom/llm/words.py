"""Vectorised word splitting and hashing on the raw UTF-8 bytes of Arrow string columns.

All word classes in use are sets of single bytes (every byte of a multi-byte
character counts alike), so words are found with one table lookup per byte.
A word's 64-bit hash is a polynomial over its bytes, taken from prefix sums,
then mixed; a window's hash is the same construction over word hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes or words that are hashed at a time; longer single words grow the tables.
CHUNK = 1 << 20


class _Tables(dict):
    """Made anew wherever it is sent."""

    def __reduce__(self):
        return _Tables, ()


_tables: dict[str, np.ndarray] = _Tables()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i below n at least."""
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(CHUNK + 64, 1 << (n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[key] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply rounds)."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spaces_split() -> np.ndarray:
    """Word bytes of [^\\x20\\x09-\\x0D]+."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alnum_split() -> np.ndarray:
    """Word bytes of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ once A-Z are folded."""
    t = np.zeros(256, bool)
    for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        t[a : b + 1] = True
    return t


def folded() -> np.ndarray:
    """Byte values with A-Z lower-cased."""
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    return t


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words, and each text's first word number (one more entry at the end)."""
    n = len(raw)
    word = np.zeros(n + 2, bool)
    word[1:-1] = is_word[raw]
    edge = np.zeros(n + 1, bool)  # texts do not run into each other
    edge[offsets] = True
    here, before = word[1:], word[:-1]
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        piece = slice(int(starts[a]), int(ends[b - 1]))
        part = raw[piece] if fold is None else fold[raw[piece]]
        out[a:b] = _spans(part, starts[a:b] - piece.start, ends[a:b] - piece.start)
        a = b
    return out


def word_hashes_loose(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """word_hashes() of short spans that may overlap, by ascending start."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + CHUNK // 2)))
        out[a:b] = _spans(raw, starts[a:b], ends[a:b])
        a = b
    return out


def _spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lo, hi = int(starts[0]), int(ends.max())
    up, down = _powers(hi - lo + 1)
    total = np.zeros(hi - lo + 1, np.uint64)
    np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
    s, e = starts - lo, ends - lo
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of `size` words; len(words) - size + 1 of them."""
    n = len(words) - size + 1
    out = np.empty(max(0, n), np.uint64)
    up, down = _powers(CHUNK + size + 1)
    for a in range(0, max(0, n), CHUNK):
        b = min(n, a + CHUNK)
        part = words[a : b + size - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((mix(part, salt) if salt else part) * up[: len(part)], out=total[1:])
        out[a:b] = mix((total[size:] - total[: b - a]) * down[: b - a], salt + size)
    return out


class Runs:
    """Hashes of runs of words of any place and length, from one array of prefix sums."""

    def __init__(self, words: np.ndarray):
        up, self.down = _powers(len(words) + 1)
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=self.total[1:])

    def hashes(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.total[at + size] - self.total[at]) * self.down[at]


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """Word numbers at which a run of `size` words lies within one text, ascending."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    where = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return where + np.arange(count.sum())


def batches(stream, rows: int, size: int):
    """Record batches cut so that each holds about `size` text bytes and `rows` rows at most (one text always fits)."""
    for batch in stream:
        if not batch.num_rows:
            continue
        raw_ends = np.cumsum([0, *(0 if v is None else v for v in pa.compute.binary_length(batch.column("text")).to_pylist())])
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(raw_ends, raw_ends[a] + size, "right")) - 1
            b = min(max(b, a + 1), a + rows, batch.num_rows)
            yield batch.slice(a, b - a)
            a = b


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers by byte planes: small ones leave planes of zeros, which shuffle compression removes."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
