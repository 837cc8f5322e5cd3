"""Vectorised text primitives: numpy over Arrow buffers, without a Python loop per row.

Texts arrive as Arrow string columns; a column is one byte array and one array of offsets.
Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, which on UTF-8 is the same as the
code-point pattern ``[^\\x20\\x09-\\x0D]+``.  Null texts are empty.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text worked on at a time; bounds the temporary arrays (some 40 bytes a byte of text).
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240229)
#: A random odd 64-bit value for each byte; fixed by the seed, so hashes agree between executors.
BYTE_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges (i, j) of documents of at most `limit` bytes together, or of one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (n + 1 of them)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    black = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = black.copy()
    start[1:] &= ~black[:-1] | edge[1:n]
    end = black.copy()
    end[:-1] &= ~black[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: each bit of the argument moves about half of the bits of the result."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of `kind`, and of its inverse, modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        base, m = _BASES[kind], max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(m, b, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        _powers[kind] = have = (out[0], out[1])
    return have


def prefix(values: np.ndarray, kind: str) -> np.ndarray:
    """Running sums of values times powers; `spans` takes hashes of any ranges from them."""
    n = len(values)
    out = np.zeros(n + 1, U64)
    np.cumsum(values * powers(kind, n + 1)[0][:n], dtype=U64, out=out[1:])
    return out


def spans(p: np.ndarray, a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    """64-bit hashes of the ranges [a, b) of what `prefix` was taken of; equal ranges have equal hashes."""
    h = (p[b] - p[a]) * powers(kind, len(p))[1][a]
    return mix(h + (b - a).astype(U64) * U64(0xA24BAED4963EE407))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    return spans(prefix(BYTE_VALUES[data], "byte"), starts, ends, "byte")


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive items (also those that cross documents; the caller masks them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    a = np.arange(n)
    return spans(prefix(hashes, "word"), a, a + k, "word")


def pack_ints(x: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, as many as the largest needs."""
    x = np.ascontiguousarray(x, "<u8")
    w = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return struct.pack("<IB", len(x), w) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes()


def unpack_ints(blob, at: int = 0) -> tuple[np.ndarray, int]:
    """The integers packed at a place of a blob, and the place behind them."""
    n, w = struct.unpack_from("<IB", blob, at)
    at += 5
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :w] = np.frombuffer(blob, np.uint8, n * w, at).reshape(w, n).T
    return out.reshape(-1).view("<u8"), at + n * w


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned integers by their differences."""
    d = np.diff(np.asarray(x, U64), prepend=U64(0))
    if len(d) > 1:  # the first one alone can be large
        return struct.pack("<Q", int(d[0])) + pack_ints(d[1:])
    return struct.pack("<Q", int(d[0]) if len(d) else 0) + pack_ints(np.zeros(0, U64)) + (b"\1" if len(d) else b"\0")


def unpack_sorted(blob, at: int = 0) -> tuple[np.ndarray, int]:
    first = struct.unpack_from("<Q", blob, at)[0]
    d, at = unpack_ints(blob, at + 8)
    if len(d) == 0:
        return np.full(blob[at], first, U64), at + 1
    return np.cumsum(np.concatenate([np.array([first], U64), d.astype(U64)]), dtype=U64), at


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def take_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of all ranges one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, np.int64) - first, lengths) + np.arange(total)
