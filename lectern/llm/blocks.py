"""Blocks of documents of bounded size, and the exchange of sorted hashes between blocks and key ranges."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_bytes
from .vec import U64, text_buffers

#: Bytes of text a block is planned for, and hashes that a key range is planned for.
BLOCK_BYTES, RANGE_KEYS = 10 << 20, 1 << 20
#: Boundaries of doc_id that are searched for; beyond, the range between two of them is divided evenly.
MOST_CUTS = 256


def plan(docs: DataFrame, bytes_a_key: float, block_bytes: int | None = None) -> tuple[int, int]:
    """(blocks, bits of key ranges) for so many bytes of text a hash."""
    _, size = text_bytes(docs)
    blocks = max(1, -(-size // min(block_bytes or BLOCK_BYTES, BLOCK_BYTES)))
    return blocks, max(0, int(np.ceil(np.log2(max(1.0, size / bytes_a_key / RANGE_KEYS)))))


def by_order(docs: DataFrame, blocks: int) -> Column:
    """Block numbers that ascend with doc_id (not null); rows of one doc_id are in one block."""
    if blocks == 1:
        return F.lit(0)
    coarse = min(blocks, MOST_CUTS)
    low, high, cuts = docs.select(F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / coarse for i in range(1, coarse)], 50 * coarse)).first()
    if low is None:
        return F.lit(0)
    cuts = sorted({int(x) for x in cuts} - {int(low)})
    at = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda x: x <= F.col("doc_id"))) if cuts else F.lit(0)
    fine = -(-blocks // coarse)
    if fine == 1:
        return at
    edges = [int(low), *cuts, int(high) + 1]
    start, end = (F.element_at(F.lit(e).cast("array<bigint>"), at + 1) for e in (edges[:-1], edges[1:]))
    part = F.floor((F.col("doc_id") - start).cast("double") * fine / (end - start).cast("double")).cast("int")
    return at * fine + F.least(part, F.lit(fine - 1))


def by_hash(blocks: int) -> Column:
    """Block numbers by doc_id and text, so that neither a repeated doc_id nor rows without one are a block of their own."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")


def split(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the key ranges (by the leading bits) begin in ascending keys: 2**bits + 1 places."""
    if bits == 0:
        return np.array([0, len(keys)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << U64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


def texts(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return text_buffers(t.column("text"))


def kept_bytes(data: np.ndarray, off: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that aren't gone, and the documents' new offsets."""
    return data[~gone], np.concatenate([[0], np.cumsum(~gone)])[off]


def digests(data: np.ndarray, off: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
