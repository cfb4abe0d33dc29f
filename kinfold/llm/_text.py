"""Vectorised text kernels shared by the operators: UTF-8 bytes of an Arrow column -> tokens, hashes, shingles.

Nothing here loops over rows or words. A token is a run of bytes outside ``[\\x20\\x09-\\x0D]``; these six bytes never
occur inside a multi-byte UTF-8 sequence, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; bounds the memory of a Python worker whatever the size of an Arrow batch.
CHUNK_BYTES = 3_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), so that sums and low bits of hashes behave as if random."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << max(n, 1).bit_length(), 1 << 16)
    if size not in _POWERS:
        _POWERS.clear()
        out = []
        for base in (_BASE, _INV):
            p = np.full(size, base, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


@dataclass
class Bytes:
    """Concatenated UTF-8 texts; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def column_bytes(column: pa.Array) -> Bytes:
    """The texts of an Arrow string column without a copy of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Bytes(raw[at[0] : at[-1]], at - at[0])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about ``limit`` bytes of text and ``rows`` rows at most (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = column_bytes(batch.column(column)).offsets
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


@dataclass
class Tokens:
    """Tokens of several texts: byte ranges, the text each belongs to, their hashes and the count for each text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    count: np.ndarray


class Hasher:
    """Hashes of any byte ranges of ``data`` in O(1) each, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * self.power[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return _LOWER[data]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each run of ``inside`` that doesn't cross a text's border."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside)) & ~edge  # the byte before is inside and in the same text
    after = np.concatenate((inside, [False])) & ~edge
    start = np.flatnonzero(inside & ~before[:n])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def tokens(texts: Bytes, lower: bool = True) -> Tokens:
    data = lowered(texts.data) if lower else texts.data
    start, end, doc = spans(~_SPACE[data], texts.offsets)
    return Tokens(start, end, doc, Hasher(data).ranges(start, end), np.bincount(doc, minlength=len(texts)))


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of hashes in order."""
    out = np.zeros(len(parts[0]), U64)
    for p in parts:
        out = (out ^ p) * U64(0xFF51AFD7ED558CCD)
        out ^= out >> U64(29)
    return mix(out)


def shingles(t: Tokens, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each window of ``width`` tokens; a text with fewer gives its whole sequence as one, none if it has none."""
    n = len(t.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    whole = np.arange(max(n - width + 1, 0))
    whole = whole[t.doc[whole] == t.doc[whole + width - 1]]
    doc, hashed = t.doc[whole], combine([t.hash[whole + k] for k in range(width)]) if len(whole) else np.zeros(0, U64)
    first = np.concatenate(([0], np.cumsum(t.count)[:-1]))
    more_doc, more_hash = [doc], [hashed]
    for length in range(1, width):
        short = np.flatnonzero(t.count == length)
        if len(short):
            more_doc.append(short)
            more_hash.append(combine([t.hash[first[short] + k] for k in range(length)]) + U64(length))
    return np.concatenate(more_doc), np.concatenate(more_hash)


def distinct(doc: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, by text and then by hash."""
    order = np.lexsort((hashed, doc))
    doc, hashed = doc[order], hashed[order]
    if not len(doc):
        return doc, hashed
    keep = np.concatenate(([True], (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])))
    return doc[keep], hashed[keep]


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, so that leading zeros of sorted deltas vanish when compressed."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(raw: np.ndarray, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw[: n * size].reshape(size, n).T).reshape(-1).view(kind)


def squeeze(raw: bytes) -> bytes:
    return np.int64([len(raw)]).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(blob: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], int(np.frombuffer(blob, np.int64, 1)[0]), codec="zstd", asbytes=True), np.uint8)
