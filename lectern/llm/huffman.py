"""Token ids in canonical length-limited Huffman codes, in independently decodable blocks.

The format is a table of blocks, so that any store Spark reaches can hold it, and a second table of code lengths:

* codes: id, bits.  The codes are canonical: ids in order of (bits, id) take consecutive numbers.
* blocks: range, block, doc_ids, counts, places, checkpoints, payload.  A file holds a range of doc_ids, files ascend
  with it, blocks follow one another by (range, block) and documents by doc_id (nulls first).  Each document begins at a byte; `places` has these bytes.
  `checkpoints` has the bit within the document of each STEP-th id but the first, so decoding can begin at any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import removed, shared_dir, written
from .tokens import encoder
from .vec import chunks, text_buffers, take_ranges

#: Longest code in bits (the decoding table has 2**LIMIT entries), ids from checkpoint to checkpoint, ids a block at least, ids a file is planned for.
LIMIT, STEP, BLOCK_IDS, FILE_IDS = 20, 128, 1 << 16, 1 << 22


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each id's code (0: the id doesn't occur), least in sum under the limit, by package-merge."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(ids) <= 1:
        out[ids] = 1
        return out
    if len(ids) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = ids[np.argsort(counts[ids], kind="stable")]
    weight = counts[order].astype(np.float64)
    lists, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        leaf = np.concatenate([np.ones(len(weight), bool), np.zeros(len(packages), bool)])
        by = np.argsort(both, kind="stable")
        both = both[by]
        lists.append(leaf[by])
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    need = 2 * len(order) - 2
    for leaf in reversed(lists):
        leaves = int(leaf[:need].sum())
        out[order[:leaves]] += 1
        need = 2 * (need - leaves)
    return out


def canonical(bits: np.ndarray) -> np.ndarray:
    """The code of each id, as a number of so many bits."""
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    width = bits[order]
    step = (1 << (int(width[-1]) if len(width) else 0) - width).astype(np.int64)
    codes = np.zeros(len(bits), np.int64)
    codes[order] = (np.cumsum(step) - step) >> ((int(width[-1]) if len(width) else 0) - width)
    return codes


def decoding_table(bits: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each `limit` next bits: id * 32 + bits of its code."""
    table = np.zeros(1 << limit, np.int64)
    codes, ids = canonical(bits), np.flatnonzero(bits)
    span = 1 << (limit - bits[ids])
    table[take_ranges(codes[ids] << (limit - bits[ids]), span)] = np.repeat(ids * 32 + bits[ids], span)
    return table


def put_bits(code: np.ndarray, width: np.ndarray, at: np.ndarray, n_bytes: int) -> np.ndarray:
    """A byte array with each code at its (ascending, disjoint) bit place, most significant bit first."""
    out = np.zeros(n_bytes // 8 + 2, np.uint64)
    if len(code):
        word, end = at >> 6, (at & 63) + width
        over = np.maximum(end - 64, 0)
        code = code.astype(np.uint64)
        high = (code >> over.astype(np.uint64)) << np.maximum(64 - end, 0).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(high, first)
        if len(o := np.flatnonzero(over)):
            out[word[o] + 1] |= code[o] << (64 - over[o]).astype(np.uint64)
    return out.byteswap().view(np.uint8)[:n_bytes]


def encode(ids: np.ndarray, at: np.ndarray, codes: np.ndarray, bits: np.ndarray):
    """(payload, bytes where each document begins (n + 1), list of each document's checkpoints) of documents ids[at[i]:at[i+1]]."""
    width = bits[ids]
    total = np.concatenate([[0], np.cumsum(width)])
    n_bytes = (total[at[1:]] - total[at[:-1]] + 7) // 8
    place = np.concatenate([[0], np.cumsum(n_bytes)])
    shift = np.repeat(place[:-1] * 8 - total[at[:-1]], np.diff(at))
    payload = put_bits(codes[ids], width, total[:-1] + shift, int(place[-1]))
    marks = [total[s + STEP : e : STEP] - total[s] for s, e in zip(at[:-1], at[1:])]
    return payload, place, marks


def decode(payload: np.ndarray, place: np.ndarray, counts: np.ndarray, marks: np.ndarray, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The ids of documents one after another: all stretches between checkpoints are decoded side by side."""
    lanes = np.maximum((counts + STEP - 1) // STEP, 1)
    lane_doc = np.repeat(np.arange(len(counts)), lanes)
    lane_no = take_ranges(np.zeros(len(counts), np.int64), lanes)
    bit = place[lane_doc] * 8
    bit[lane_no > 0] += marks
    left = np.minimum(counts[lane_doc] - lane_no * STEP, STEP)
    to = np.cumsum(left) - left
    out = np.zeros(int(left.sum()), np.int64)
    data = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint64)
    wide = data[:-4] << np.uint64(32) | data[1:-3] << np.uint64(24) | data[2:-2] << np.uint64(16) | data[3:-1] << np.uint64(8) | data[4:]
    order = np.argsort(-left, kind="stable")
    bit, to, left = bit[order], to[order], left[order]
    down = np.uint64(40 - limit)
    for i in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -i, "left"))
        b = bit[:n]
        got = table[((wide[b >> 3] >> (down - (b & 7).astype(np.uint64))) & np.uint64((1 << limit) - 1)).astype(np.int64)]
        out[to[:n] + i] = got >> 5
        bit[:n] = b + (got & 31)
    return out


def token_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, tie (the text's digest), row (a number of its own), n and ids (little-endian, 16 bits where the vocabulary allows, else 32), written once."""

    def run(batches):
        from pyspark import TaskContext

        enc, row = encoder(path, False), TaskContext.get().partitionId() << 40
        kind = id_type(enc.tokenizer.get_vocab_size())
        end, width = np.array([end_id], kind).tobytes(), np.dtype(kind).itemsize
        for b in batches:
            data, off = text_buffers(b.column("text"))
            for i, j in chunks(off):
                got, at = enc(data[off[i] : off[j]], off[i : j + 1] - off[i])
                raw, size = got.astype(kind).tobytes(), np.diff(at) + 1
                at = (at * width).tolist()
                ids = pa.array([raw[s:e] + end for s, e in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("tie").slice(i, j - i), pa.array(np.arange(row, row + j - i)), pa.array(size), ids], names=["doc_id", "tie", "row", "n", "ids"])
                row += j - i

    tied = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"))
    return written(tied.mapInArrow(run, "doc_id long, tie string, row long, n long, ids binary"), "ids")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def token_counts(ids: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs; a row for each task and id is shuffled."""

    def run(batches):
        n = np.zeros(1, np.int64)
        for b in batches:
            own = np.bincount(text_buffers(b.column("ids"))[0].view(kind))
            size = max(len(n), len(own))
            n = np.pad(n, (0, size - len(n))) + np.pad(own, (0, size - len(own)))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([0, *(r["id"] for r in rows)]) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """All documents (doc_id, text) tokenized and written below `path`, in ascending doc_id order.

    A null text is empty: its document is the end id alone.  A very long text is coded whole, with checkpoints.  Rows of
    one doc_id stand side by side in the order of their text's digest, those of one text in any order; however many they
    are, they are dealt to several files.  A null doc_id comes first.  Other columns are left out.  An empty table has
    empty tables.
    """
    spark = docs.sparkSession
    coded_ids = token_ids(docs, tokenizer, end_id)
    kind = id_type(encoder(tokenizer, False).tokenizer.get_vocab_size())
    bits = code_lengths(token_counts(coded_ids, kind))
    codes = canonical(bits)
    ids = np.flatnonzero(bits)
    spark.createDataFrame([(int(i), int(bits[i])) for i in ids], "id int, bits int").coalesce(1).write.parquet(f"{path}/codes")
    width = np.dtype(kind).itemsize

    def blocks(batches):
        """Blocks of whole documents; a block ends after BLOCK_IDS ids or with its file."""
        from pyspark import TaskContext

        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            doc, data = pa.concat_arrays([x for x, _ in held]), pa.concat_arrays([x for _, x in held])
            raw, off = text_buffers(data)
            payload, place, marks = encode(raw.view(kind), off // width, codes, bits)
            gaps = np.concatenate([np.zeros(0, np.int64), *[np.diff(m, prepend=0) for m in marks]]).astype("<u2").tobytes()
            values = ([part], [number], [doc.to_pylist()], [(np.diff(off) // width).tolist()], [place.tolist()], [gaps], [payload.tobytes()])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()))], names=["range", "block", "doc_ids", "counts", "places", "checkpoints", "payload"])

        for b in batches:
            end, at = np.cumsum(b.column("n").to_numpy()), 0
            while at < b.num_rows:
                before = int(end[at - 1]) if at else 0
                to = min(b.num_rows, int(np.searchsorted(end, before + BLOCK_IDS - n)) + 1)
                held.append((b.column("doc_id").slice(at, to - at), b.column("ids").slice(at, to - at)))
                n, at = n + int(end[to - 1]) - before, to
                if n >= BLOCK_IDS:
                    yield flush()
                    number, held, n = number + 1, [], 0
        if held:
            yield flush()

    files = max(1, -(-(coded_ids.agg(F.sum("n")).first()[0] or 0) // FILE_IDS))
    by = [F.col(c).asc_nulls_first() for c in ("doc_id", "tie", "row")]
    placed = coded_ids.repartitionByRange(files, *by).sortWithinPartitions(*by).select("doc_id", "n", "ids")
    out = placed.mapInArrow(blocks, "range int, block int, doc_ids array<long>, counts array<long>, places array<long>, checkpoints binary, payload binary")
    out.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    removed(coded_ids)


def read_tokens(spark, path: str) -> DataFrame:
    """Documents of a written folder in order: doc_id, start (ids of all documents before), n_tokens, ids (little-endian, 32 bits)."""
    lengths = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/codes").collect()}  # a row for each id of the vocabulary at most
    bits = np.zeros(max(lengths, default=0) + 1, np.int64)
    bits[list(lengths)] = list(lengths.values())
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("range", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("own"))
    ranges = sizes.groupBy("range").agg(F.sum("own").alias("own"))
    # one row for each file; the window runs over these alone
    before = ranges.select("range", (F.sum("own").over(Window.orderBy("range")) - F.col("own")).alias("before"))
    inside = sizes.select("range", "block", (F.sum("own").over(Window.partitionBy("range").orderBy("block")) - F.col("own")).alias("inside"))
    starts = inside.join(before, "range").select("range", "block", (F.col("inside") + F.col("before")).alias("first"))

    def run(batches):
        table = decoding_table(bits)
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k] for c in b.schema.names}
                counts = np.array(row["counts"].as_py(), np.int64)
                place = np.array(row["places"].as_py(), np.int64)
                gaps = np.frombuffer(row["checkpoints"].as_buffer(), "<u2").astype(np.int64)
                per = np.maximum((counts + STEP - 1) // STEP, 1) - 1
                total = np.cumsum(gaps)
                first = np.cumsum(per) - per
                base = np.where(first > 0, np.append(0, total)[first], 0)
                ids = decode(np.frombuffer(row["payload"].as_buffer(), np.uint8), place, counts, total - np.repeat(base, per), table)
                raw = ids.astype("<u4").tobytes()
                end = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"].as_py(), pa.int64()), pa.array(row["first"].as_py() + end - counts), pa.array(counts), pa.array([raw[4 * (e - c) : 4 * e] for e, c in zip(end.tolist(), counts.tolist())], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.join(starts, ["range", "block"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def tokens_round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all documents, from files written and read back."""
    path = shared_dir(docs.sparkSession)
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
