"""Substring deduplication by relative Lempel-Ziv parsing.

Documents lie in blocks that ascend with doc_id; each block is a reference for those behind it.  The index of all
reference blocks has each window of `window` words once, with its first place (block and word), and is cut into ranges
of hashes: each block sends its distinct windows with their places, and the ranges answer where those that stand in an
earlier block stand first.  Each document is then factored greedily, from left to right: at a word whose window is in the
index, the factor is the longest stretch that goes on in the reference from that window's place on; at another word,
parsing goes one word on.  Factors don't overlap and have `window` words at least.  Windows that begin in the last words
of a factor and go beyond it are looked up as well; factors and those windows are the duplicate spans.

As the index has each window once, a factor's source is always the text that had its windows first: a stretch that
stands whole in one block, but whose parts an earlier block had, is parsed into those parts.

What is exchanged is each block's distinct windows (a 64-bit hash, as differences, and a place) and one answer for each;
no passage, however common, is sent more than once a block, and no key gathers documents.  Blocks and ranges grow with the
corpus; beyond 2 ** MOST_BITS ranges a block's windows are split in two steps, so that a row has hundreds of them still.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import by_order, plan, split, table, texts
from .tokens import lean
from .vec import chunks, pack_ints, pack_sorted, runs, take_ranges, unpack_ints, unpack_sorted, windows, word_hashes, words

#: Leading bits of hashes that a block splits its windows by; with more ranges, blocks are taken together before they are split further.
MOST_BITS = 11
_SENT = pa.schema([("range", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("places", pa.binary())])
_ANSWER = pa.schema([("range", pa.int32()), ("part", pa.int32()), ("old", pa.binary()), ("source", pa.binary())])


class _Parsed:
    """The words and windows of a block's texts, which ascend with doc_id."""

    def __init__(self, data: np.ndarray, off: np.ndarray, window: int):
        starts, ends, first, keys, at, n = [], [], [np.zeros(1, np.int64)], [], [], 0
        for i, j in chunks(off):
            part = data[off[i] : off[j]]
            s, e, f = words(part, off[i : j + 1] - off[i])
            w = windows(word_hashes(part, s, e), window)
            doc = np.repeat(np.arange(j - i, dtype=np.int32), np.diff(f))
            inside = np.flatnonzero(doc[: len(w)] == doc[window - 1 :][: len(w)]) if len(w) else np.zeros(0, np.int64)
            starts.append((s + off[i]).astype(np.int32))
            ends.append((e + off[i]).astype(np.int32))
            first.append(f[1:] + n)
            keys.append(w[inside])
            at.append((inside + n).astype(np.int32))
            n += len(s)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.starts, self.ends, self.first = cat(starts, np.int32), cat(ends, np.int32), np.concatenate(first)
        self.keys, self.at = cat(keys, np.uint64), cat(at, np.int32)  # of each window: its hash, its first word


def _ascending(t: pa.Table) -> pa.Table:
    """Rows by doc_id; those of one doc_id by text, so that places are the same whenever a block is read."""
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _send(bits: int, window: int):
    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        p = _Parsed(*texts(_ascending(t)), window)
        keys, first = np.unique(p.keys, return_index=True)
        place, cut = p.at[first].astype(np.int64) + (block << 32), split(keys, bits)
        return table([(r, block, pack_sorted(keys[a:b]), pack_ints(place[a:b])) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a], _SENT)

    return run


def _gathered(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows by part: the parts, how many windows each has, and all windows' hashes and places (block << 32 | word)."""
    part = t.column("part").to_numpy()
    order = np.argsort(part)
    keys = [unpack_sorted(t.column("keys")[int(i)].as_buffer())[0] for i in order]
    place = np.concatenate([unpack_ints(t.column("places")[int(i)].as_buffer())[0].astype(np.int64) for i in order])
    return part[order], np.array([len(k) for k in keys]), np.concatenate(keys), place


def _by_key(keys: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by hash and place, and where in it each hash begins."""
    by = np.lexsort((place, keys))
    return by, np.flatnonzero(np.append(True, keys[by][1:] != keys[by][:-1])[: len(by)])


def _together(bits: int):
    """The windows of several blocks in one range, split into ranges by `bits` bits, as rows of their common part."""

    def run(t: pa.Table) -> pa.Table:
        _, _, keys, place = _gathered(t)
        by, _ = _by_key(keys, place)
        keys, place = keys[by], place[by]
        r = (keys >> np.uint64(64 - bits)).astype(np.int64)
        cut = np.append(np.flatnonzero(np.append(True, r[1:] != r[:-1])), len(r))
        group = t.column("group")[0].as_py()
        return table([(int(r[a]), group, pack_sorted(keys[a:b]), pack_ints(place[a:b])) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], _SENT)

    return run


def _apart(t: pa.Table, answers: pa.Table) -> pa.Table:
    """The answers to `_together`, given back to its blocks."""
    if not t.num_rows:
        return table([], _ANSWER)
    blocks_, size, keys, place = _gathered(t)
    by, _ = _by_key(keys, place)
    old, source, at = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), 0
    ranges = answers.column("range").to_numpy()
    edge = np.flatnonzero(np.append(True, np.diff(keys[by] >> np.uint64(64 - answers.column("bits")[0].as_py())) != 0)) if len(by) else []
    edge = np.append(edge, len(by)).astype(np.int64)
    for i, a, b in zip(np.argsort(ranges).tolist(), edge[:-1].tolist(), edge[1:].tolist()):
        own = np.unpackbits(np.frombuffer(answers.column("old")[i].as_buffer(), np.uint8), count=b - a).astype(bool)
        old[by[a:b]] = own
        source[by[a:b][own]] = unpack_ints(answers.column("source")[i].as_buffer())[0]
    r, out = t.column("range")[0].as_py(), []
    for block, n in zip(blocks_.tolist(), size.tolist()):
        out.append((r, block, np.packbits(old[at : at + n]).tobytes(), pack_ints(source[at : at + n][old[at : at + n]])))
        at += n
    return table(out, _ANSWER)


def _answer(t: pa.Table) -> pa.Table:
    """For the windows of each part in this range of hashes: whether an earlier block has them, and the first place of those."""
    part, size, keys, place = _gathered(t)
    by, first = _by_key(keys, place)
    source = np.empty(len(keys), np.int64)
    source[by] = np.repeat(place[by][first], np.diff(np.append(first, len(by))))
    old = source >> 32 != place >> 32
    r, out, end = t.column("range")[0].as_py(), [], np.cumsum(size)
    for p, a, e in zip(part.tolist(), (end - size).tolist(), end.tolist()):
        o = old[a:e]
        out.append((r, p, np.packbits(o).tobytes(), pack_ints(source[a:e][o])))
    return table(out, _ANSWER)


def _answered(sent: DataFrame, bits: int) -> DataFrame:
    """range (by MOST_BITS bits at most), part (the block), old and source of all windows sent."""
    ddl, answer = "range int, part int, keys binary, places binary", "range int, part int, old binary, source binary"
    if bits <= MOST_BITS:
        return sent.groupBy("range").applyInArrow(lean(_answer), answer)
    more = bits - MOST_BITS
    grouped = sent.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(1 << more)).cast("int"))
    found = grouped.groupBy("range", "group").applyInArrow(lean(_together(bits)), ddl).groupBy("range").applyInArrow(lean(_answer), answer)
    back = found.withColumn("bits", F.lit(bits)).withColumn("high", F.shiftright("range", more))
    return grouped.groupBy("range", "group").cogroup(back.groupBy("high", "part")).applyInArrow(lean(_apart), answer)


def parse(at: np.ndarray, source: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The greedy parse. at, source: word of each window that is in the index (ascending), and its place there.

    Returns starts, lengths and sources of the factors, and the words at which windows across a factor's end begin.
    """
    begins = np.append(True, (np.diff(at) != 1) | (np.diff(source) != 1))[: len(at)]
    run = np.cumsum(begins) - 1
    last = at[np.append(begins[1:], True)[: len(at)]]  # of each run of windows that go on in the reference, the last one
    after = np.searchsorted(at, last + window).tolist()  # the first window behind the stretch of each run
    of, picked, h = run.tolist(), [], 0
    while h < len(of):
        picked.append(h)
        h = after[of[h]]
    picked = np.array(picked, np.int64)
    start, end = at[picked], last[run[picked]] + window
    low, high = np.searchsorted(at, end - window + 1), np.searchsorted(at, end)
    return start, end - start, source[picked], at[take_ranges(low, high - low)]


def _sources(p: _Parsed, ids: np.ndarray, block: int, bits: int, answers: pa.Table) -> np.ndarray:
    """The first place of each window, if a document with a smaller doc_id has it there, else -1."""
    if not len(p.keys):
        return np.zeros(0, np.int64)
    keys, first, inverse = np.unique(p.keys, return_index=True, return_inverse=True)
    source = np.full(len(keys), -1, np.int64)
    cut = split(keys, bits)
    got = {r: i for i, r in enumerate(answers.column("range").to_pylist())}
    for r, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
        if b > a:
            i = got[r]
            old = np.unpackbits(np.frombuffer(answers.column("old")[i].as_buffer(), np.uint8), count=b - a).astype(bool)
            source[a:b][old] = unpack_ints(answers.column("source")[i].as_buffer())[0]
    # windows that are new in this block stand first at their first place here
    own = ids[np.searchsorted(p.first, p.at, "right").astype(np.int32) - 1]
    here = np.where(source < 0, (block << 32) + p.at[first].astype(np.int64), source)
    out = here[inverse]
    out[(source[inverse] < 0) & (own <= own[first][inverse])] = -1
    return out


def _kept_digests(data: np.ndarray, p: _Parsed, gone: np.ndarray, i: int, j: int) -> list[str]:
    """Digests of the words that are left of documents i to j, joined by one space."""
    low, high = int(p.first[i]), int(p.first[j])
    keep = low + np.flatnonzero(~gone[low:high])
    size = (p.ends[keep] - p.starts[keep] + 1).astype(np.int64)  # each with one space behind it
    end = np.cumsum(size)
    at = take_ranges(p.starts[keep], size)
    out = data[np.minimum(at, len(data) - 1)] if len(at) else np.zeros(0, np.uint8)
    out[end - 1] = 0x20
    edge = np.concatenate([[0], end])[np.searchsorted(keep, p.first[i : j + 1])].tolist()
    raw = out.tobytes()
    return [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(edge[:-1], edge[1:])]


def _finish(bits: int, window: int, with_text: bool, carry: list[str], schema: pa.Schema):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table([], schema)
        t = _ascending(t)
        data, off = texts(t)
        p = _Parsed(data, off, window)
        ids = t.column("doc_id").to_numpy()
        n_docs, n_words = len(off) - 1, len(p.starts)
        source = _sources(p, ids, t.column("block")[0].as_py(), bits, answers)
        hit = source >= 0
        start, length, source, across = parse(p.at[hit].astype(np.int64), source[hit], window)
        p.keys = p.at = None
        gone = np.zeros(n_words + 1, np.int32)
        np.add.at(gone, start, 1)
        np.add.at(gone, start + length, -1)
        np.add.at(gone, across, 1)
        np.add.at(gone, across + window, -1)
        gone = np.cumsum(gone, dtype=np.int32)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = np.diff(total[p.first])
        sha = [x for i, j in chunks(off) for x in _kept_digests(data, p, gone, i, j)]
        f_edge = np.searchsorted(start, p.first)
        begin = start - np.repeat(p.first[:-1], np.diff(f_edge))
        factor = pa.StructArray.from_arrays([pa.array(begin), pa.array(length), pa.array(source >> 32), pa.array(source & 0xFFFFFFFF)], ["start", "length", "block", "place"])
        cols = [pa.array(ids, pa.int64()), pa.array(np.diff(p.first)), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(f_edge, pa.int32()), factor)]
        if with_text:
            drop = np.zeros(len(data) + 1, np.int32)
            for d in np.flatnonzero(removed):
                s, e = p.first[d], p.first[d + 1]
                for x, y in zip(*runs(gone[s:e])):
                    drop[p.starts[s + x]] += 1
                    drop[p.ends[s + y - 1]] -= 1
            left = np.cumsum(drop, dtype=np.int32)[:-1] == 0
            new_off = np.concatenate([[0], np.cumsum(left, dtype=np.int32)])[off]
            cols.append(pa.Array.from_buffers(pa.large_string(), n_docs, [None, pa.py_buffer(new_off.astype(np.int64)), pa.py_buffer(data[left])]).cast(pa.string()))
        return pa.table(cols + [t.column(f"carried_{i}") for i in range(len(carry))], schema=schema)

    return run


def dedup_substrings(docs: DataFrame, window: int = 13, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, factors and, if asked for, the text without removed stretches and the columns to carry.

    Words are runs of bytes other than white space.  A word is removed if a window of `window` words of its document
    that covers it also starts in a document with a smaller doc_id; windows are judged on the input.  kept_sha256 is
    of the kept words with one space between; `text` has the white space around removed stretches as it was.
    factors: the greedy parse, (start, length, block, place) in words; block and place are where the copy begins in the
    references (words from the beginning of the block, whose documents ascend with doc_id).

    A null or empty text has no words.  A very long text is parsed whole, in one block.  Rows of equal doc_id aren't
    smaller than each other; they stand in the order of their texts.  A row of null doc_id loses nothing and is no
    reference.  Columns that aren't carried are left out.  An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)])
    extra = [StructField(c, docs.schema[c].dataType) for c in carry]
    known, unknown = rows.where("doc_id IS NOT NULL"), rows.where("doc_id IS NULL")
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("factors", pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "block", "place")])))]
    schema = pa.schema([*(pa.field(*f) for f in fields), *[pa.field("text", pa.string())] * with_text, *to_arrow_schema(StructType(extra))])
    base = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start: long, length: long, block: long, place: long>>" + ", text string" * with_text
    ddl = StructType([*StructType.fromDDL(base).fields, *extra])
    blocks, bits = plan(known, 6.0, 4 << 20)
    blocked = known.withColumn("block", by_order(known, blocks).cast("int"))
    groups = blocked.groupBy("block")
    sent = groups.applyInArrow(lean(_send(min(bits, MOST_BITS), window)), "range int, part int, keys binary, places binary")
    out = groups.cogroup(_answered(sent, bits).groupBy("part")).applyInArrow(lean(_finish(min(bits, MOST_BITS), window, with_text, list(carry), schema)), ddl)

    def alone(batches):
        finish = _finish(0, 1 << 30, with_text, list(carry), schema)
        for b in batches:
            n = b.num_rows
            if n:
                t = pa.table([pa.array(np.arange(n)), *b.columns[1:], pa.array(np.zeros(n, np.int32))], names=["doc_id", *b.schema.names[1:], "block"])
                done = finish(t, table([], _ANSWER)).set_column(0, "doc_id", pa.nulls(n, pa.int64()))
                yield from done.cast(schema).to_batches()

    return out.unionByName(unknown.mapInArrow(lean(alone), ddl))
