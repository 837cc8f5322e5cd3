"""Suffix-array deduplication of byte strings by bucket-pointer refinement.

Which strings of `size` bytes occur more than once is a question about the buckets of a suffix array refined to that
depth.  Sorting every suffix of a large corpus isn't needed for it; buckets are made in three steps:

1. Initial buckets by a q-gram.  Each string of `size` bytes is put in the bucket of one q-gram inside it, the one
   with the least hash; equal strings choose equal q-grams at equal places, so equal strings share a bucket.
   Neighbouring strings mostly choose the same q-gram, so there is one entry for some 70 strings: the q-gram's hash
   and the hash of the whole stretch that these strings cover (its context).
2. A bucket of one entry is done: its strings occur once.  Entries whose contexts are equal are done as well: all
   their strings occur again.  What is left are entries at the ends of repeated passages.
3. Their contexts are refined as suffixes: buckets of 8-byte prefixes first, then each suffix is sorted by its own
   bucket and that of the suffix 8, 16, 32, ... bytes later, which gives buckets of twice the depth, until `size`;
   suffixes that are alone in their bucket drop out, and the bucket numbers just made serve the next step.

A q-gram with more than `most` different contexts isn't refined in one task.  There, the strings themselves are
compared by 64-bit hashes, spread over all tasks by the hash, each block sending a string once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import by_hash, digests, kept_bytes, plan, split, table, texts
from .vec import BYTE_VALUES, U64, chunks, mix, pack_ints, pack_sorted, prefix, spans, take_ranges, unpack_ints, unpack_sorted

Q = 48
UNIQUE, REPEATED, REFINE, SAMPLE, SPREAD = 0, 1, 2, 3, 4
_SENT = pa.schema([("range", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("contexts", pa.binary()), ("many", pa.binary())])
_STATE = pa.schema([("block", pa.int32()), ("range", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])
_WORK = pa.schema([("range", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])


def anchors(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a byte array: first and last start of their strings, the hash of their q-gram, and of their context."""
    n, w = len(data), size - Q + 1
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none.astype(U64), none.astype(U64)
    p = prefix(BYTE_VALUES[data], "byte")
    a = np.arange(n - Q + 1)
    h = spans(p, a, a + Q, "byte")
    packed = (h & U64(0xFFFFFFFF00000000)) | a.astype(U64)
    # the least of each run of w values: the lesser of what a fixed block has from here on, and what the next has up to there
    m = -(-len(packed) // w) * w
    padded = np.full(m, np.iinfo(U64).max, U64)
    padded[: len(packed)] = packed
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - size + 1
    at = (np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts]) & U64(0xFFFFFFFF)).astype(np.int64)
    end = np.repeat(off[1:], np.diff(off))[:starts]
    inside = np.arange(starts) + size <= end
    new = np.ones(starts, bool)
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    last_of = inside.copy()
    last_of[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
    last = np.flatnonzero(last_of)
    # mixed again: the least hashes of many all begin with zeros, and keys are dealt out by their leading bits
    return first, last, mix(h[at[first]]), spans(p, first, last + size, "byte")


class _Block:
    """The entries of a block: positions, and the distinct (q-gram, context) pairs in ascending order."""

    def __init__(self, data: np.ndarray, off: np.ndarray, size: int):
        parts = []
        for i, j in chunks(off, 1 << 20):
            f, l, g, c = anchors(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
            parts.append((f + off[i], l + off[i], g, c))
        self.first, self.last, gram, context = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U64),) * 2
        order = np.lexsort((context, gram))
        self.first, self.last, gram, context = self.first[order], self.last[order], gram[order], context[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
        self.at = np.flatnonzero(new)  # the first position of each pair
        self.pair = np.cumsum(new) - 1
        self.gram, self.context = gram[self.at], context[self.at]
        self.many = np.diff(np.append(self.at, len(gram))) > 1


def _send(bits: int, size: int):
    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        b = _Block(*texts(t), size)
        cut = split(b.gram, bits)
        return table([(r, block, pack_sorted(b.gram[x:y]), b.context[x:y].tobytes(), np.packbits(b.many[x:y]).tobytes()) for r, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x], _SENT)

    return run


def _state(most: int):
    def run(t: pa.Table) -> pa.Table:
        """For each entry of this range of q-grams, what is known of it."""
        block = t.column("block").to_pylist()
        gram, context, many, size = [], [], [], []
        for i in np.argsort(block):
            k = unpack_sorted(t.column("keys")[int(i)].as_buffer())[0]
            gram.append(k)
            context.append(np.frombuffer(t.column("contexts")[int(i)].as_buffer(), U64))
            many.append(np.unpackbits(np.frombuffer(t.column("many")[int(i)].as_buffer(), np.uint8), count=len(k)).astype(bool))
            size.append(len(k))
        gram, context, many = np.concatenate(gram), np.concatenate(context), np.concatenate(many)
        by = np.lexsort((context, gram))
        g, c = gram[by], context[by]
        new_gram = np.append(True, g[1:] != g[:-1])
        new = new_gram | np.append(True, c[1:] != c[:-1])
        pair, of = np.cumsum(new) - 1, np.cumsum(new_gram) - 1
        n_pair = np.bincount(pair)
        repeated = (n_pair > 1) | (np.bincount(pair, many[by]) > 0)
        first = np.flatnonzero(new)
        contexts = np.bincount(of[first])  # different contexts of each q-gram
        open_ = contexts > 1
        lonely = np.bincount(of[first], ~repeated) > 0  # has an entry to refine
        state = np.where(repeated[pair], REPEATED, np.where(open_[of], np.where(contexts[of] > most, SPREAD, REFINE), UNIQUE))
        sample = first[repeated & open_[of[first]] & lonely[of[first]]]
        # one of the entries of a repeated context stands for all of them; in spread buckets its strings are sent as well
        state[sample] = np.where(contexts[of[sample]] > most, SPREAD + 1, SAMPLE)
        out = np.empty(len(by), np.uint8)
        out[by] = state
        r, end = t.column("range")[0].as_py(), np.cumsum(size)
        return table([(b, r, 0, out[e - n : e].tobytes()) for b, n, e in zip(sorted(block), size, end.tolist())], _STATE)

    return run


def _states(b: _Block, bits: int, states: pa.Table) -> np.ndarray:
    state, cut = np.zeros(len(b.gram), np.uint8), split(b.gram, bits)
    for r, kind, body in zip(*(states.column(c) for c in ("range", "kind", "body"))):
        if kind.as_py() == 0:
            r = r.as_py()
            state[cut[r] : cut[r + 1]] = np.frombuffer(body.as_buffer(), np.uint8)
    return state


def _spread_keys(b: _Block, state: np.ndarray, data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of entries in spread buckets: their places and hashes; the distinct hashes ascending, and whether each is repeated here."""
    at = b.at[state >= SPREAD]
    n = b.last[at] - b.first[at] + 1
    places = take_ranges(b.first[at], n)
    if not len(places):
        return places, places.astype(U64), places.astype(U64), places.astype(bool)
    hashes = np.zeros(len(places), U64)
    order = np.argsort(places)
    done = 0
    for i, j in chunks(off, 1 << 20):
        m = np.searchsorted(places[order], off[j]) - done
        if m:
            own = order[done : done + m]
            s = places[own] - off[i]
            hashes[own] = spans(prefix(BYTE_VALUES[data[off[i] : off[j]]], "byte"), s, s + size, "byte")
        done += m
    keys, count = np.unique(hashes, return_counts=True)
    # a repeated context's strings occur twice even where this block has them once
    twice = np.isin(keys, hashes[np.repeat(state[state >= SPREAD] == SPREAD + 1, n)]) | (count > 1)
    return places, hashes, keys, twice


def _work(bits: int, size: int):
    """The contexts of entries to refine, and the hashes of strings in spread buckets."""

    def run(t: pa.Table, states: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table([], _WORK)
        data, off = texts(t)
        block, b, out = t.column("block")[0].as_py(), _Block(data, off, size), []
        state, cut = _states(b, bits, states), split(b.gram, bits)
        for r, (x, y) in enumerate(zip(cut[:-1], cut[1:])):
            pick = x + np.flatnonzero((state[x:y] == REFINE) | (state[x:y] == SAMPLE))
            if len(pick):
                at = b.at[pick]
                n = b.last[at] - b.first[at] + size
                out.append((r, block, 1, pack_sorted(b.gram[pick]) + pack_ints(n.astype(U64)) + data[take_ranges(b.first[at], n)].tobytes()))
        _, _, keys, twice = _spread_keys(b, state, data, off, size)
        cut = split(keys, bits)
        out += [(r, block, 2, pack_sorted(keys[x:y]) + np.packbits(twice[x:y]).tobytes()) for r, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]
        return table(out, _WORK)

    return run


def refine(text: np.ndarray, group: np.ndarray, left: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Which of the suffixes at `start` share their first `size` bytes (and their group) with another of them.

    group and left: of each byte, the group it belongs to and the bytes from there to the end of its context.
    """
    n = len(text)
    bucket = np.zeros(n, np.int32)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(n, U64)
    for k in range(8):
        word = word << U64(8) | padded[k : k + n]

    def number(first: np.ndarray, second: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts bucket numbers of the pairs at these places in `bucket`; the places not alone in theirs."""
        by = np.lexsort((second, first))
        f, s = first[by], second[by]
        new = np.append(True, (f[1:] != f[:-1]) | (s[1:] != s[:-1]))
        own = np.cumsum(new, dtype=np.int32)
        bucket[:] = 0
        bucket[at[by]] = own
        return at[by][np.bincount(own)[own] > 1]

    wanted = np.zeros(n + 1, np.int32)  # bytes that some suffix at `start` covers
    np.add.at(wanted, start, 1)
    np.add.at(wanted, start + size, -1)
    live = np.flatnonzero((np.cumsum(wanted)[:-1] > 0) & (left >= 8))
    depth, ok = 8, start
    number(word[live], group[live].astype(U64), live)
    while len(ok) and depth < size:
        step = min(depth, size - depth)
        if depth + step < size:  # later offsets are looked up again: all places that have so many bytes
            at = live[left[live] >= depth + step]
            # only those that a suffix still open covers
            cover = np.zeros(n + 1, np.int32)
            np.add.at(cover, ok, 1)
            np.add.at(cover, ok + size - depth - step + 1, -1)
            used = np.cumsum(cover)[:-1] > 0
            at = at[used[at]]
        else:
            at = ok
        first, second = bucket[at], bucket[at + step]
        shared = number(first, second, at)
        mark = np.zeros(n, bool)
        mark[shared] = True
        ok = ok[mark[ok]]
        live, depth = at, depth + step
    out = np.zeros(n, bool)
    out[ok] = True
    return out[start]


def _refine(size: int):
    def run(t: pa.Table) -> pa.Table:
        r, out = t.column("range")[0].as_py(), []
        kinds = np.array(t.column("kind").to_pylist())
        blocks = np.array(t.column("block").to_pylist())
        own = np.flatnonzero(kinds == 1)
        if len(own):
            gram, length, body, count = [], [], [], []
            for i in own.tolist():
                blob = t.column("body")[i].as_buffer()
                k, at = unpack_sorted(blob)
                n, at = unpack_ints(blob, at)
                gram.append(k)
                length.append(n.astype(np.int64))
                body.append(np.frombuffer(blob, np.uint8)[at:])
                count.append(len(k))
            gram, length, text = np.concatenate(gram), np.concatenate(length), np.concatenate(body)
            begin = np.cumsum(length) - length
            group = np.repeat(np.unique(gram, return_inverse=True)[1], length)
            left = np.repeat(begin + length, length) - np.arange(len(text))
            windows = length - size + 1
            shared = refine(text, group, left, take_ranges(begin, windows), size)
            edge = np.concatenate([[0], np.cumsum(windows)])[np.concatenate([[0], np.cumsum(count)])]
            out += [(int(blocks[i]), r, 1, np.packbits(shared[a:b]).tobytes()) for i, a, b in zip(own.tolist(), edge[:-1], edge[1:])]
        own = np.flatnonzero(kinds == 2)
        if len(own):
            keys, twice, count = [], [], []
            for i in own.tolist():
                blob = t.column("body")[i].as_buffer()
                k, at = unpack_sorted(blob)
                keys.append(k)
                twice.append(np.unpackbits(np.frombuffer(blob, np.uint8)[at:], count=len(k)))
                count.append(len(k))
            _, inverse, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            shared = (n > 1)[inverse] | (np.bincount(inverse, np.concatenate(twice)) > 0)[inverse]
            edge = np.concatenate([[0], np.cumsum(count)])
            out += [(int(blocks[i]), r, 2, np.packbits(shared[a:b]).tobytes()) for i, a, b in zip(own.tolist(), edge[:-1], edge[1:])]
        return table(out, _STATE)

    return run


def _finish(bits: int, size: int, with_text: bool, schema: pa.Schema):
    def run(t: pa.Table, states: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table([], schema)
        data, off = texts(t)
        b = _Block(data, off, size)
        state, cut = _states(b, bits, states), split(b.gram, bits)
        cover = np.zeros(len(data) + 1, np.int32)
        # all strings of repeated contexts
        whole = (state == REPEATED) | (state == SAMPLE) | (state == SPREAD + 1)
        hit = whole[b.pair] if len(b.pair) else np.zeros(0, bool)
        np.add.at(cover, b.first[hit], 1)
        np.add.at(cover, b.last[hit] + size, -1)
        bodies = {(k, r): v for k, r, v in zip(states.column("kind").to_pylist(), states.column("range").to_pylist(), states.column("body"))}

        def flags(kind: int, r: int, n: int) -> np.ndarray:
            return np.unpackbits(np.frombuffer(bodies[kind, r].as_buffer(), np.uint8), count=n).astype(bool)

        for r, (x, y) in enumerate(zip(cut[:-1], cut[1:])):
            pick = x + np.flatnonzero((state[x:y] == REFINE) | (state[x:y] == SAMPLE))
            if len(pick):
                at = b.at[pick]
                n = b.last[at] - b.first[at] + 1
                s = take_ranges(b.first[at], n)[flags(1, r, int(n.sum()))]
                np.add.at(cover, s, 1)
                np.add.at(cover, s + size, -1)
        places, hashes, keys, _ = _spread_keys(b, state, data, off, size)
        if len(keys):
            cut = split(keys, bits)
            shared = np.concatenate([flags(2, r, y - x) for r, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x])
            s = places[shared[np.searchsorted(keys, hashes)]]
            np.add.at(cover, s, 1)
            np.add.at(cover, s + size, -1)
        gone = np.cumsum(cover)[:-1] > 0
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        begins = gone & np.append(True, ~gone[:-1])[: len(gone)] | gone & edge[:-1]
        by_doc = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])
        left, new_off = kept_bytes(data, off, gone)
        ids = t.column("doc_id").combine_chunks()
        starts = np.flatnonzero(begins)
        stop = gone & np.append(~gone[1:], True)[: len(gone)] | gone & edge[1:]
        span = pa.StructArray.from_arrays([pa.array(starts - off[np.searchsorted(off, starts, "right") - 1]), pa.array(np.flatnonzero(stop) + 1 - starts)], ["start", "length"])
        cols = [ids, pa.array(np.diff(off)), pa.array(by_doc(gone)), pa.array(by_doc(begins)), pa.array(digests(left, new_off), pa.string()), pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, off), pa.int32()), span)]
        if with_text:
            raw = left.tobytes()
            cols.append(pa.array([raw[x:y] for x, y in zip(new_off[:-1].tolist(), new_off[1:].tolist())], pa.binary()))
        return pa.table(cols, schema=schema)

    return run


def dedup_bytes(docs: DataFrame, size: int = 200, most: int = 4000, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and, if asked for, the remaining bytes of every document.

    A byte is removed if a string of `size` bytes that covers it also starts anywhere else, in the same document
    included, overlaps too; strings don't cross documents and are judged on the input.  spans: (start, length) of
    maximal removed runs.  `most`: contexts of one q-gram that one task refines; the rest goes by hashes, exactly.

    A null text is empty, a very long one is worked on whole, in one block.  Repeated rows are documents of their own, so
    they remove each other.  A null doc_id stays null.  Other columns are left out.  An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), *[("rest", pa.binary())] * with_text])
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, length: long>>" + ", rest binary" * with_text
    # working on a byte of text takes some 100 bytes of memory, and as much for a byte of a context
    blocks, bits = plan(rows, 60.0, 4 << 20)
    bits = max(bits, int(np.ceil(np.log2(blocks))) if blocks > 1 else 0)
    groups = rows.withColumn("block", by_hash(blocks)).groupBy("block")
    sent = groups.applyInArrow(_send(bits, size), "range int, block int, keys binary, contexts binary, many binary")
    states = sent.groupBy("range").applyInArrow(_state(most), "block int, range int, kind int, body binary")
    work = groups.cogroup(states.groupBy("block")).applyInArrow(_work(bits, size), "range int, block int, kind int, body binary")
    refined = work.groupBy("range").applyInArrow(_refine(size), "block int, range int, kind int, body binary")
    return groups.cogroup(states.unionByName(refined).groupBy("block")).applyInArrow(_finish(bits, size, with_text, schema), ddl)
