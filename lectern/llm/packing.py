"""Best-fit packing of documents into sequences, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .ranks import ranked
from .shared import small_batches
from .tokens import encoder
from .vec import chunks, text_buffers

PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut(total: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or pieces of `most` after a first one that may be shorter."""
    first = (total - 1) % most + 1 if total else 0
    return [(0, first), *((s, most) for s in range(first, total, most))]


def token_pieces(docs: DataFrame, path: str, end_id: int, most: int, with_ids: bool = False) -> DataFrame:
    """Token pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids (little-endian, 32 bits)."""

    def run(batches):
        enc = encoder(path, True)
        for b in batches:
            data, off = text_buffers(b.column("text"))
            key = b.column("doc_id")
            for i, j in chunks(off):
                ids, at = enc(data[off[i] : off[j]], off[i : j + 1] - off[i])
                out: list[tuple] = []
                raw = []
                for d, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    own = np.append(ids[s:e], end_id).astype("<u4")
                    for p, (start, length) in enumerate(cut(len(own), most)):
                        part = own[start : start + length]
                        out.append((i + d, p, start, length, zlib.crc32(part)))
                        if with_ids:
                            raw.append(part.tobytes())
                if not out:
                    continue
                doc, piece, start, length, crc = (np.array(x) for x in zip(*out))
                cols = [key.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return small_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE + ", ids binary" * with_ids)


def best_fit(counts: Mapping[int, int], most: int) -> np.ndarray:
    """The plan for so many pieces of each length: rows (length, first rank, ranks, pieces a sequence, first sequence, offset).

    Lengths are taken from the longest; each piece goes to the sequence with the least room that holds it, else to a
    new one.  Sequences with equal room are kept as ranges of numbers, so the work grows with the number of lengths
    and not with the number of pieces.  Piece `first rank + i` of a row takes sequence `first sequence + i // k`,
    at `offset + (i % k) * length`, for k pieces a sequence.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    plan, fresh = [], 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        if not 0 < length <= most:
            raise ValueError(f"a piece of {length} tokens can't be in a sequence of {most}")
        left, rank = counts[length], 0
        fits = sorted(r for r in room if r >= length)
        while left:
            while fits and not room.get(fits[0]):
                fits.pop(0)
            if fits:
                r = fits[0]
                first, n = room[r].pop()
            else:
                r, first, n = most, fresh, -(-left // (most // length))
                fresh += n
            k = r // length
            full = min(n, left // k)
            if full:
                plan.append((length, rank, full * k, k, first, most - r))
                room.setdefault(r - k * length, []).append((first, full))
                rank, left = rank + full * k, left - full * k
            if full < n and left:  # the last sequence takes fewer
                plan.append((length, rank, left, left, first + full, most - r))
                room.setdefault(r - left * length, []).append((first + full, 1))
                full, left = full + 1, 0
            if full < n:
                room.setdefault(r, []).append((first + full, n - full))
    return np.array(plan, np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, most: int) -> DataFrame:
    """Pieces (any columns, `length` among them) with sequence_id and offset: places in as few sequences as best fit needs.

    Only the histogram (a count for each of at most `most` lengths) and the plan, which grows with it, are on the
    driver.  Pieces take planned places by their rank among those of their length; any of them may take any.
    """
    rows, counts = ranked(pieces, "length", most + 1)
    plan = best_fit({r["length"]: r["n"] for r in counts.collect()}, most)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    keys = plan[:, 0] << 44 | plan[:, 1]

    def run(batches):
        for b in batches:
            length = b.column("length").to_numpy().astype(np.int64)
            rank = b.column("rank").to_numpy()
            row = plan[np.searchsorted(keys, length << 44 | rank, "right") - 1] if len(length) else plan[:0]
            i = rank - row[:, 1]
            cols = [b.column(c) for c in b.schema.names if c != "rank"]
            names = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(row[:, 4] + i // np.maximum(row[:, 3], 1)), pa.array(row[:, 5] + i % np.maximum(row[:, 3], 1) * length)], names=[*names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "rank"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, most: int = 2048, with_ids: bool = False) -> DataFrame:
    """All documents (doc_id, text) packed: a row for each piece with its sequence and its offset there.

    A null text is empty and has the end id alone; so has an empty one.  A document of more than `most` tokens is
    cut, others stay whole.  Repeated rows are packed each for itself; a null doc_id stays null; other columns are
    left out; an empty table has no pieces.
    """
    return pack(token_pieces(docs, path, end_id, most, with_ids), most)
