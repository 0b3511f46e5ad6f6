"""Word splitting and hashing over Arrow string columns, shared by the text operators.

Everything here works on a slice of rows at a time (about `SLICE_BYTES` of text, or one row if that is longer), so
memory follows the slice and the longest text, never the partition.  Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20

_MIX_1, _MIX_2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_JOIN, _SIZE = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
#: Words of more bytes are hashed one by one.
_LONG = 64

#: Bytes that belong to words: all but the six ASCII white-space characters.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = False
#: Bytes that belong to words: 0-9, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers; one to one."""
    x = x ^ (x >> U64(33))
    x *= _MIX_1
    x ^= x >> U64(33)
    x *= _MIX_2
    x ^= x >> U64(33)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


class Words(NamedTuple):
    """Words of several texts: their bytes, where each starts and ends there, each text's first word (and, last, the
    number of words) and a 64-bit hash of each word; `other` is a second one, independent of it."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def other(self) -> np.ndarray:
        return hashed(self.data, self.start, self.end, 1)


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of stretches of bytes, eight bytes a step; different stretches of one size up to eight bytes have
    different hashes."""
    padded = np.append(data, np.zeros(8, np.uint8))
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = end - start
    h = mix(size.astype(U64) * _SIZE + U64(seed * 0x632BE59BD9B4E019 % (1 << 64)))
    some = np.flatnonzero((size > 0) & (size <= _LONG))
    for k in range(0, _LONG, 8):
        some = some[size[some] > k]
        if not len(some):
            break
        left = np.minimum(size[some] - k, 8).astype(U64)
        h[some] = mix(h[some] * _JOIN + (lanes[start[some] + k] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * left))))
    raw = None
    for i in np.flatnonzero(size > _LONG).tolist():
        raw = memoryview(padded) if raw is None else raw
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8, salt=bytes([seed])).digest(), "little")
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and len(texts) + 1 offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `limit` bytes of text each."""
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(texts: pa.Array, inside: np.ndarray = NON_SPACE, lower: bool = False) -> Words:
    """Splits texts at the bytes that `inside` rules out; `lower` first turns A-Z into a-z."""
    data, offsets = buffers(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    kept = inside[data]
    first, last = kept.copy(), kept.copy()
    first[1:] &= ~kept[:-1]
    last[:-1] &= ~kept[1:]
    filled = offsets[1:] > offsets[:-1]
    at = offsets[:-1][filled]
    first[at] = kept[at]
    at = offsets[1:][filled] - 1
    last[at] = kept[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), hashed(data, start, end))


def grams(h: np.ndarray, size: np.ndarray | int, at: np.ndarray) -> np.ndarray:
    """Hashes of runs of `size` symbols that start at `at`: runs of 1, 2, 4 ... symbols are joined in pairs, and those that
    make up `size` one after another, each time through `mix`."""
    sizes = [int(size)] if np.ndim(size) == 0 else np.unique(size).tolist()
    out = np.zeros(len(at), U64)
    chosen = {s: slice(None) if np.ndim(size) == 0 else np.flatnonzero(size == s) for s in sizes}
    done = dict.fromkeys(sizes, 0)
    level, width, most = h, 1, max(sizes, default=0)
    while width <= most:
        for s, some in chosen.items():
            if s & width:
                part = level[at[some] + done[s]]
                out[some] = part if not done[s] else mix(out[some] * _JOIN + part)
                done[s] += width
        if 2 * width <= most:
            level = mix(level[:-width] * _JOIN + level[width:]) if len(level) > width else level[:0]
        width *= 2
    return mix(out + np.asarray(size).astype(U64) * _SIZE)


def joined(w: Words, stays: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of each text's words that stay, joined by one space, one text after another, and where each starts."""
    start, end, row = w.start[stays], w.end[stays], w.rows()[stays]
    later = np.zeros(len(row), bool)
    later[1:] = row[1:] == row[:-1]
    # A word that isn't its text's first has a separator before it, which becomes the space.
    size = end - start + later
    ends = np.cumsum(size)
    out = w.data[np.repeat(start - later - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
    out[(ends - size)[later]] = 0x20
    return out.tobytes(), np.concatenate([[0], np.cumsum(np.bincount(row, size, len(w.bounds) - 1))]).astype(np.int64)


def digests(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that, together, name each text's sequence of words: 128 bits of a cryptographic digest."""
    raw, at = joined(w, np.ones(len(w.hash), bool))
    both = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist()))
    pairs = np.frombuffer(both, "<i8").reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Where runs of `size` words that stay within one text start."""
    n = int(bounds[-1])
    ends = np.repeat(bounds[1:], np.diff(bounds))
    return np.flatnonzero(np.arange(n) + size <= ends)


def by_row(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by row, then by hash."""
    order = np.argsort(h)
    of = row[order]
    # Numpy sorts numbers of 16 bits by counting.
    return order[np.argsort(of.astype(np.uint16) if int(row.max(initial=0)) < 1 << 16 else of, kind="stable")]


def distinct(row: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, sorted, and n_rows + 1 offsets."""
    if not len(h):
        return h, np.zeros(n_rows + 1, np.int64)
    order = by_row(row, h)
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[new], h[new]
    return h, np.searchsorted(row, np.arange(n_rows + 1))


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
