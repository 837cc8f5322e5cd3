"""Jaccard self-join of shingle sets by universe partition and pigeonhole, verified exactly.

Sets are put in bands of sizes.  In a band, two sets that link differ in at most H shingles.  The universe of
shingles is dealt into m segments by a hash, and each segment is allotted 1 or 2: a pair that differs in less than
the allotment in some segment is found there, by equal subsets (1), or by subsets that are equal after at most one
deletion from either (2).  A set sends its fullest segments only, as many as have allotments of H + 1 together (with
all that are as full as the last of them): of two sets that link, one of the segments that the set with the fuller
last segment sends is found in the other, and is full enough to be sent by that one too, so no pair is missed.  How
many segments there are, and how many of them are allotted 2, is chosen by cost: signatures to send against
signatures that agree by chance.  A set that would need empty segments is dealt again with another hash.

Sets are named by a 64-bit hash, so copies are one set.  Signatures travel as sorted differences, a set once a batch.
Sets with a common signature are candidates, in buckets.  Pairs are read in rounds: first those of each set and its
nearest in small tiles of its buckets, then, of the sets of a bucket that are still in different components, the
nearest two of each, then all.  Pairs go unread only if they are in one component already, or if the counts of their
shingles in cells exclude a link (a lower bound of their difference, so nothing is lost).  A pair is read by
intersecting the two sets, which are made from the text once.  A group of near copies costs a few pairs for each set.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import split, table
from .components import components
from .shared import if_small, removed, small_batches, text_bytes, written
from .tokens import lean
from .vec import U64, chunks, mix, pack_ints, pack_sorted, prefix, spans, take_ranges, text_buffers, unpack_ints, unpack_sorted, windows, word_hashes, words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Least and largest number of cells in which a set's shingles are counted (about one for four shingles of a large set), as powers of 2.
LEAST_CELLS, MOST_CELLS = 7, 11
#: Sets of a bucket that are compared with each other in the first round, and in one task in the others.
SMALL_TILE, TILE = 128, 4096
#: Members of buckets that a task compares, and those that are kept together, bytes of sets that it reads pairs of, signatures that it sorts.
MEMBERS_A_TASK, MEMBERS_A_SPOT, SET_BYTES_A_TASK, RANGE_KEYS = 20_000, 50_000, 16 << 20, 1 << 20
#: Leading bits of signatures that a batch is split by at once; more are split in a second step.
MOST_BITS = 11
#: Deals of a set before it sends empty segments.
DEALS = 4
#: What a signature that agrees by chance costs against one that is sent, and the share of shingles that are common.
_CHANCE, _COMMON = 100.0, 0.3


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles (hashes, ascending in each document) of lower-cased documents, and where each set begins.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    low = _LOWER[data]
    starts, ends, first = words(low, off)
    h = word_hashes(low, starts, ends)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    w = windows(h, k)
    at = np.flatnonzero(doc[: len(w)] == doc[k - 1 :][: len(w)]) if len(w) else np.zeros(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < k))
    value = np.concatenate([w[at], spans(prefix(h, "word"), first[few], first[few + 1], "word")])
    of = np.concatenate([doc[at], few])
    by = np.lexsort((value, of))
    value, of = value[by], of[by]
    new = np.append(True, (of[1:] != of[:-1]) | (value[1:] != value[:-1]))[: len(of)]
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(len(n) + 1))


def set_names(value: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(value ^ U64(0x5851F42D4C957F2D)), dtype=U64)])
    n = np.diff(edge).astype(U64)
    return mix(total[edge[1:]] - total[edge[:-1]] + n * U64(0xD1342543DE82EF95))


def cells(value: np.ndarray, edge: np.ndarray) -> list[bytes]:
    """Shingles of each set in each of its cells, at most 255: a power of 2 of cells, by the leading bits of the shingles."""
    n = np.diff(edge)
    bits = np.clip(np.log2(np.maximum(n, 1) / 4).round().astype(np.int64), LEAST_CELLS, MOST_CELLS)
    size = 1 << bits
    base = np.cumsum(size) - size
    count = np.bincount(np.repeat(base, n) + (value >> np.repeat((64 - bits).astype(U64), n)).astype(np.int64), minlength=int(size.sum()))
    raw = np.minimum(count, 255).astype(np.uint8).tobytes()
    return [raw[a : a + s] for a, s in zip(base.tolist(), size.tolist())]


class Bands:
    """For a threshold num / den: bands of sizes that grow by den / num, and of each its H, segments and how many are allotted 2."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        low = [1]
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, -(-low[-1] * den // num)))
        self.low = np.array(low)
        self.high = np.append(self.low[1:] - 1, 1 << 40)[: len(low)]
        self.most = self.high * (den - num) // num
        self.segments, self.double = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for b, (n, high, h) in enumerate(zip(low, self.high[:-1].tolist(), self.most[:-1].tolist())):
            if h:
                self.segments[b], self.double[b] = min((self.cost((n + high) / 2, h, m, d), m, d) for m, d in self.ways(h))[1:]

    @staticmethod
    def ways(h: int) -> list[tuple[int, int]]:
        """(segments, allotted 2) with allotments of h + 1 together, or with some to spare."""
        out = set()
        for spare in (1, 1.05, 1.1, 1.2, 1.3, 1.45, 1.6, 1.8, 2.2):
            need = int(np.ceil((h + 1) * spare))
            out |= {(need - d, d) for d in (0, 1, 2, need // 8, need // 4, need // 3, need // 2) if d <= need - d}
        return sorted(out)

    @staticmethod
    def cost(n: float, h: int, m: int, d: int) -> float:
        """Signatures of a set of n that are sent, and what those cost that agree by chance; shingles fall in segments as by Poisson's law."""
        own = n / m
        k = np.arange(int(own + 6 * own**0.5 + 8))
        p = np.exp(k * np.log(own) - own - np.cumsum(np.log(np.maximum(k, 1))))
        tail = np.minimum(np.cumsum(p[::-1])[::-1], 1)
        once, twice = (m - d) * tail, 2 * d * tail[np.maximum(k, 2)]
        enough = np.flatnonzero(once + twice - np.sqrt((m + d) * tail * (1 - tail)) >= h + 1)
        c = int(enough[-1]) if len(enough) else 0
        c2 = max(c, 2) - 1 if c else 0
        chance = np.where(k > 0, _COMMON**k, 20.0)  # an empty segment agrees with all others that are empty
        sent = (m - d) * p[c:].sum() + d * (p * (1 + k))[c2:].sum()
        agree = (m - d) * (p * chance)[c:].sum() + d * (p * (chance + k * chance[np.maximum(k - 1, 0)]))[c2:].sum()
        return float(sent + _CHANCE * agree)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1


@lru_cache(8)
def bands_of(num: int, den: int, power: int) -> Bands:
    """The bands for sets of up to 2 ** power shingles; those of smaller sets are the same for any power."""
    return Bands(num, den, 1 << power)


def _dealt(value, edge, docs, own, deal: int, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of some sets in one deal of a band each, the place in `docs` of each, and the sets that would need empty segments."""
    m, d, size = bands.segments[own], bands.double[own], np.diff(edge)[docs]
    tok = value[take_ranges(edge[docs], size)]
    rep = np.repeat(np.arange(len(docs)), size)
    salt = (own.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(deal) * U64(0xC2B2AE3D27D4EB4F)
    h = mix(tok + salt[rep])
    seg = ((h >> U64(32)) * m[rep].astype(U64) >> U64(32)).astype(np.int64)
    base = np.cumsum(m) - m
    slot = base[rep] + seg
    total = np.zeros(int(m.sum()), U64)
    np.add.at(total, slot, h)
    count = np.bincount(slot, minlength=len(total))
    of = np.repeat(np.arange(len(docs)), m)
    at = np.arange(len(total)) - base[of]
    twice = at < d[of]
    # the fullness c of the last segment that is needed; a segment allotted 2 counts only with two shingles or more
    full = np.where(twice & (count < 2), 0, count)
    by = np.lexsort((-full, of))
    given = np.cumsum((1 + twice)[by])
    given -= np.repeat(given[base] - (1 + twice)[by][base], m)
    enough = np.flatnonzero(given >= (bands.most[own] + 1)[of])
    _, first = np.unique(of[enough], return_index=True)
    c = full[by][enough[first]]
    last = deal == DEALS - 1
    least = np.where(c > 0, c, 0 if last else 1)[of]
    send = np.where(twice & (least > 0), count >= np.maximum(least, 2) - 1, count >= least)
    name = mix((own[of].astype(U64) << U64(40)) + (at.astype(U64) << U64(3)) + U64(deal + 1))
    cut = (twice & send & (count > (0 if last else 1)))[slot]
    return np.concatenate([mix(total[send] ^ name[send]), mix((total[slot[cut]] - h[cut]) ^ name[slot[cut]])]), np.concatenate([of[send], rep[cut]]), np.flatnonzero(c == 0)


def signatures(value: np.ndarray, edge: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """All signatures, and the set each is of."""
    n = np.diff(edge)
    least = -(-n * bands.num // bands.den)  # the smallest set that it can link with
    band, sigs, owner, back = bands.of(n), [np.zeros(0, U64)], [np.zeros(0, np.int64)], 0
    while True:
        b = np.maximum(band - back, 0)
        use = (n > 0) & (band >= back) & (bands.high[b] >= least)
        if not use.any():
            break
        docs = np.flatnonzero(use & (bands.segments[b] > 0))
        back += 1
        for deal in range(DEALS):
            if len(docs):
                s, o, again = _dealt(value, edge, docs, b[docs], deal, bands)
                sigs.append(s)
                owner.append(docs[o])
                docs = docs[again]
    return np.concatenate(sigs), np.concatenate(owner)


#: Rows of the first pass: a document's set (doc_id, n, node), or a batch's signatures of one range (range, keys, body).
_PASS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("range", pa.int32()), ("part", pa.int32()), ("keys", pa.int64()), ("body", pa.binary())])
_SENT = pa.schema(list(_PASS)[3:])


def _bodies(sig: np.ndarray, own: np.ndarray, name: np.ndarray, bits: int, low: int, part: int) -> pa.Table:
    """Signatures (ascending) cut into ranges by their leading `bits` bits, those before `low` being the same: only ranges that have some."""
    cut = low + np.flatnonzero(np.diff(sig >> U64(64 - bits), prepend=~U64(0)) if bits else np.arange(len(sig)) == 0) - low
    out = []
    for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(sig)]):
        mine, local = np.unique(own[x:y], return_inverse=True)
        out.append((int(sig[x] >> U64(64 - bits)) if bits else 0, part, y - x, pack_sorted(sig[x:y]) + pack_ints(local.astype(U64)) + name[mine].tobytes()))
    return table(out, _SENT)


def _first_pass(k: int, num: int, den: int, bits: int):
    def run(batches):
        from pyspark import TaskContext

        for number, b in enumerate(batches):
            data, off = text_buffers(b.column("text"))
            names, sigs, owner, have = [], [], [], 0
            for i, j in chunks(off):
                value, edge = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                n, name = np.diff(edge), set_names(value, edge)
                rows = {"doc_id": b.column("doc_id").slice(i, j - i), "n": pa.array(n), "node": pa.array(name.view(np.int64), mask=n == 0)}
                yield pa.RecordBatch.from_arrays([rows[f.name] if f.name in rows else pa.nulls(j - i, f.type) for f in _PASS], schema=_PASS)
                _, first = np.unique(name, return_index=True)  # copies are sent once
                keep = np.sort(first)
                size = n[keep]
                bands = bands_of(num, den, max(12, int(n.max()).bit_length()))
                s, o = signatures(value[take_ranges(edge[keep], size)], np.concatenate([[0], np.cumsum(size)]), bands)
                names.append(name[keep])
                sigs.append(s)
                owner.append(o + have)
                have += len(keep)
            if not sigs:
                continue
            name, sig, own = np.concatenate(names), np.concatenate(sigs), np.concatenate(owner)
            by = np.argsort(sig)
            part = hash((TaskContext.get().partitionId(), number)) & 0x7FFFFFFF
            for x in _bodies(sig[by], own[by], name, min(bits, MOST_BITS), 0, part).to_batches():
                yield pa.RecordBatch.from_arrays([x.column(f.name) if f.name in _SENT.names else pa.nulls(x.num_rows, f.type) for f in _PASS], schema=_PASS)

    return run


def _signed(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct signatures and nodes of some bodies, ascending."""
    sig, node = [], []
    for body in t.column("body"):
        blob = body.as_buffer()
        s, at = unpack_sorted(blob)
        local, at = unpack_ints(blob, at)
        sig.append(s)
        node.append(np.frombuffer(blob, U64, offset=at)[local.astype(np.int64)])
    sig, node = np.concatenate(sig), np.concatenate(node)
    by = np.lexsort((node, sig))
    sig, node = sig[by], node[by]
    new = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
    return sig[new], node[new]


def _resplit(bits: int):
    def run(t: pa.Table) -> pa.Table:
        sig, node = _signed(t)
        name, own = np.unique(node, return_inverse=True)
        return _bodies(sig, own, name, bits, 0, t.column("part")[0].as_py())

    return run


_GROUPS = pa.schema([("bucket", pa.int64()), ("node", pa.int64())])


def _groups(t: pa.Table) -> pa.Table:
    """Sets with a common signature: (bucket, node).

    A bucket is named by its members, so equal buckets are one; in a range that is dealt to several tasks, by its
    signature, and those that have one member here stay, as others may be elsewhere.
    """
    sig, node = _signed(t)
    alone = t.column("parts")[0].as_py() == 1
    begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    size = np.diff(np.append(begin, len(sig)))
    if not alone:
        return pa.table([pa.array(mix(sig).view(np.int64)), pa.array(node.view(np.int64))], schema=_GROUPS)
    begin, size = begin[size > 1], size[size > 1]
    node, of = node[take_ranges(begin, size)], np.repeat(np.arange(len(size)), size)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(node), dtype=U64)])
    edge = np.concatenate([[0], np.cumsum(size)])
    name = mix(total[edge[1:]] - total[edge[:-1]] + size.astype(U64))
    _, first = np.unique(name, return_index=True)
    keep = np.zeros(len(size), bool)
    keep[first] = True
    keep = keep[of]
    return pa.table([pa.array(name[of][keep].view(np.int64)), pa.array(node[keep].view(np.int64))], schema=_GROUPS)


def _buckets(sent: DataFrame, bits: int) -> DataFrame:
    """(bucket, node) of all signatures that two sets have, or more."""
    ddl = "range int, part int, keys long, body binary"
    if bits > MOST_BITS:
        parts = F.pmod("part", F.lit(1 << (bits - MOST_BITS)))
        sent = written(sent.groupBy("range", parts).applyInArrow(lean(_resplit(bits)), ddl), "sent")
    heavy = sent.groupBy("range").agg(F.ceil(F.sum("keys") / F.lit(RANGE_KEYS)).cast("int").alias("parts")).where("parts > 4")
    n = heavy.count()
    if n:
        sent = sent.join(if_small(heavy, n), "range", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        sent = sent.withColumn("parts", F.lit(1))
    found = written(sent.groupBy("range", F.pmod("part", F.col("parts"))).applyInArrow(lean(_groups), "bucket long, node long").distinct(), "buckets")
    if n:
        several = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("size_")).where("size_ > 1").select("bucket")
        found, old = written(found.join(several, "bucket", "left_semi"), "buckets"), found
        removed(old)
    return found


def _candidate_pairs(num: int, den: int, few: int | None, across: bool):
    """Pairs (a, b) of the buckets' sets in different components that may still link: all, or of each set those that differ least."""

    def run(t: pa.Table) -> pa.Table:
        node, label, n, bucket, tile = (t.column(c).to_numpy() for c in ("node", "label", "n", "bucket", "tile"))
        node, at, own = np.unique(node, return_index=True, return_inverse=True)
        n = n[at]
        raw = [t.column("cells")[i].as_buffer() for i in at.tolist()]
        keys = np.lexsort((label, bucket)) if not across else np.lexsort((label, t.column("tj").to_numpy(), t.column("ti").to_numpy(), bucket))
        group = np.append(True, bucket[keys][1:] != bucket[keys][:-1])
        if across:
            for c in ("ti", "tj"):
                x = t.column(c).to_numpy()[keys]
                group[1:] |= x[1:] != x[:-1]
            ti, tj = t.column("ti").to_numpy()[keys], t.column("tj").to_numpy()[keys]
        own, tile, mark = own[keys], tile[keys], label[keys]
        begin = np.flatnonzero(group)
        end = np.append(begin[1:], len(own))
        code = []
        # members of a group stand by label, the commonest label last: pairs within it needn't be made
        for chunk in _stretches(begin, end):
            order, first, last, rest = _commonest_last(mark, begin[chunk], end[chunk])
            left = np.arange(len(order))
            more = np.where(left - first < rest, last - left - 1, 0)
            i, j = order[np.repeat(left, more)], order[take_ranges(left + 1, more)]
            ok = mark[i] != mark[j]
            if across:
                ok &= (ti[i] == tj[i]) | (tile[i] != tile[j])
            i, j = own[i[ok]], own[j[ok]]
            ok = den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])
            code.append(np.unique(np.minimum(i, j)[ok] * len(node) + np.maximum(i, j)[ok]))
        code = np.unique(np.concatenate(code)) if code else np.zeros(0, np.int64)
        i, j = code // len(node), code % len(node)
        i, j, differ = _near(i, j, n, raw, num, den)
        if few is not None:
            who, which = np.concatenate([i, j]), np.concatenate([np.arange(len(i))] * 2)
            by = np.lexsort((differ[which] / (n[i] + n[j])[which], who))
            who = who[by]
            start = np.flatnonzero(np.append(True, who[1:] != who[:-1])[: len(who)])
            place = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who))))
            keep = np.unique(which[by][place < few])
            i, j = i[keep], j[keep]
        return pa.table([pa.array(node[i]), pa.array(node[j]), pa.array(n[j], pa.int64())], names=["a", "b", "n"])

    return run


def _stretches(begin: np.ndarray, end: np.ndarray, most: int = 500_000):
    """Slices of groups with about `most` pairs together."""
    pairs = np.cumsum((end - begin) ** 2 // 2)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(pairs, (pairs[i - 1] if i else 0) + most, "right")))
        yield slice(i, j)
        i = j


def _commonest_last(mark: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Members of some groups (sorted by mark) with each group's commonest mark last; of each its group's first and last place and how many are before that mark."""
    size = end - begin
    order = take_ranges(begin, size)
    of = np.repeat(np.arange(len(size)), size)
    m = mark[order]
    run = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (m[1:] != m[:-1]))[: len(m)])
    length = np.diff(np.append(run, len(m)))
    group = of[run]
    best = np.zeros(len(size), np.int64)
    np.maximum.at(best, group, length)
    is_best = np.flatnonzero(length == best[group])
    _, pick = np.unique(group[is_best], return_index=True)
    chosen = np.zeros(len(run), bool)
    chosen[is_best[pick]] = True
    common = np.repeat(chosen, length)
    by = np.lexsort((common, of))
    first = np.repeat(np.cumsum(size) - size, size)
    return order[by], first, first + np.repeat(size, size), np.repeat(size - best, size)


def _near(i: np.ndarray, j: np.ndarray, n: np.ndarray, raw: list, num: int, den: int):
    """The pairs whose cells don't exclude a link, and in how many shingles they differ at least."""
    size = np.array([len(x) for x in raw], np.int64)
    both = np.minimum(size[i], size[j]) if len(i) else np.zeros(0, np.int64)
    out = [(np.zeros(0, np.int64),) * 3]
    for cells_ in np.unique(both).tolist():
        of = np.flatnonzero(both == cells_)
        used, where = np.unique(np.concatenate([i[of], j[of]]), return_inverse=True)
        folded = np.stack([np.frombuffer(raw[u], np.uint8).reshape(cells_, -1).sum(1, dtype=np.int16) for u in used.tolist()])
        left, right = where[: len(of)], where[len(of) :]
        step = max(1, (2 << 20) // cells_)
        for s in range(0, len(of), step):
            at = of[s : s + step]
            differ = np.abs(folded[left[s : s + step]] - folded[right[s : s + step]]).sum(1, dtype=np.int64)
            ok = (den + num) * differ <= (den - num) * (n[i[at]] + n[j[at]])
            out.append((i[at[ok]], j[at[ok]], differ[ok]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _open_pairs(members: DataFrame, labels: DataFrame | None, tiles_most: int, num: int, den: int, few: int | None) -> DataFrame:
    """Distinct candidate pairs (a, b, n of b) in all buckets with sets of different components; in the first round, of tiles of few sets alone."""
    total = members.count()
    tasks = max(1, -(-total // MEMBERS_A_TASK))
    across = False
    if labels is None:
        rows = members.withColumn("label", F.col("node"))
    else:
        rows = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        still = rows.groupBy("bucket").agg(F.min("label").alias("low_"), F.max("label").alias("high_")).where("low_ != high_").select("bucket")
        rows = rows.join(still, "bucket", "left_semi")
        across = tiles_most > TILE
        tiles = F.ceil(F.col("size") / F.lit(TILE)).cast("int")
        rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), tiles).cast("int"))
        if across:
            rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1))).withColumn("ti", F.least("tile", "other")).withColumn("tj", F.greatest("tile", "other"))
    if labels is None:  # a tile is a bucket of its own
        rows = rows.withColumn("bucket", F.xxhash64("bucket", "tile"))
    elif not across:
        rows = rows.withColumn("tile", F.lit(0))
    by = ["spot", "ti", "tj"] if across else ["spot"]
    slots = rows.select("bucket", "tile", "node", "label", "n", "cells", *by[1:], F.pmod(F.xxhash64(*by), F.lit(tasks)).cast("int").alias("slot"))
    return slots.groupBy("slot").applyInArrow(lean(_candidate_pairs(num, den, few, across)), "a long, b long, n long").distinct()


def _verify(num: int, den: int):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        own = {x: np.frombuffer(s.as_buffer(), U64) for x, s in zip(sets.column("one").to_pylist(), sets.column("own"))}
        a, b = [], []
        for x, y, s in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), pairs.column("set")):
            left, right = own[x], np.frombuffer(s.as_buffer(), U64)
            if len(left) > len(right):
                left, right = right, left
            common = int((right[np.minimum(np.searchsorted(right, left), len(right) - 1)] == left).sum())
            if den * common >= num * (len(left) + len(right) - common):
                a.append(x)
                b.append(y)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, spread: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b, n of b) of sets that link. sets: node and its shingles, one row each.

    A set goes once to each task that has pairs of it; its pairs are dealt to as many as `spread` tasks.
    """
    tasks = max(1, -(-8 * (pairs.agg(F.sum("n")).first()[0] or 0) // SET_BYTES_A_TASK))
    slot = F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(spread))), F.lit(tasks)).cast("int")
    dealt = pairs.select("a", "b", slot.alias("slot"))
    right = dealt.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set")), "b").select("slot", "a", "b", "set")
    one = dealt.select(F.col("slot").alias("of"), F.col("a").alias("one")).distinct()
    left = one.join(sets.select(F.col("node").alias("one"), F.col("set").alias("own")), "one").select("of", "one", "own")
    return right.groupBy("slot").cogroup(left.groupBy("of")).applyInArrow(lean(_verify(num, den)), "a long, b long")


def _packed(k: int):
    def run(batches):
        for b in batches:
            data, off = text_buffers(b.column("text"))
            for i, j in chunks(off):
                value, edge = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                at = np.flatnonzero(np.diff(edge))
                name, count = set_names(value, edge).view(np.int64)[at], cells(value, edge)
                raw = [value[edge[d] : edge[d + 1]].tobytes() for d in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.diff(edge)[at]), pa.array([count[d] for d in at.tolist()], pa.binary()), pa.array(raw, pa.binary())], names=["node", "n", "cells", "set"])

    return run


def _members(buckets: DataFrame, known: DataFrame) -> tuple[DataFrame, int]:
    """bucket, size, spot, tile, node, n, cells of all members of buckets, and the largest size.

    Buckets with the same least set mostly have the same sets.  They have one spot, which brings them to one task, where
    their pairs are made once; the buckets of a set that has too many members are dealt to several spots.  In a large
    bucket's small tiles, sets meet only sets of their tile; so the least sets of its tiles are a bucket too.
    """
    sizes = written(buckets.groupBy("bucket").agg(F.count(F.lit(1)).cast("int").alias("size"), F.min("node").alias("head")), "sizes")
    crowded = sizes.groupBy("head").agg(F.ceil(F.sum("size") / F.lit(MEMBERS_A_SPOT)).cast("int").alias("spots")).where("spots > 1")
    spots = F.pmod(F.xxhash64("bucket"), F.coalesce("spots", F.lit(1)))
    spotted = sizes.join(if_small(crowded), "head", "left").select("bucket", "size", F.xxhash64("head", spots).alias("spot"))
    largest = sizes.agg(F.max("size")).first()[0] or 1
    tile = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / F.lit(SMALL_TILE))).cast("int")
    rows = buckets.join(spotted, "bucket").withColumn("tile", tile)
    size, level = largest, rows.where(F.col("size") > SMALL_TILE)
    while size > SMALL_TILE:
        heads = level.groupBy("bucket", "tile").agg(F.min("node").alias("node")).select(F.xxhash64("bucket").alias("bucket"), "node")
        size = -(-size // SMALL_TILE)
        level = heads.select("bucket", "node", F.lit(1).alias("size"), F.col("bucket").alias("spot"), F.pmod(F.xxhash64("node"), F.lit(-(-size // SMALL_TILE))).cast("int").alias("tile"))
        rows = rows.unionByName(level)
    return written(rows.join(known.select("node", "n", "cells"), "node"), "members"), largest


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every document (doc_id, text).

    Words are lower-cased in A-Z; a document's set is its distinct k-word shingles, with fewer words its whole
    sequence as one.  Documents link when den * |intersection| >= num * |union|.  component_id is the smallest doc_id
    reachable by links, itself included.

    A null text, or one without words, has an empty set and links with nothing: its component is its own doc_id.
    A very long text is one set like any other.  Repeated rows are copies of each other.  A null doc_id is never the
    smallest; where no other is reachable, the component is null.  Ties can't matter: components don't depend on the
    order in which pairs are read.  Other columns are left out.  An empty table gives an empty result.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = max(0, int(np.ceil(np.log2(max(1, text_bytes(rows)[1]) / 12 / RANGE_KEYS))))
    passed = written(rows.mapInArrow(lean(_first_pass(k, num, den, bits)), "doc_id long, n long, node long, range int, part int, keys long, body binary"), "sets")
    sets = passed.where("range IS NULL").select("doc_id", "n", "node")
    buckets = _buckets(passed.where("range IS NOT NULL").select("range", "part", "keys", "body"), bits)
    # of each set in a bucket, one document
    firsts = sets.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = written(buckets.select("node").distinct().join(firsts, "node"), "wanted")
    n_wanted, n_named = wanted.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    texts = rows.join(if_small(wanted.select("doc_id").where("doc_id IS NOT NULL"), n_named), "doc_id", "left_semi")
    if n_named < n_wanted:
        texts = texts.unionByName(rows.where("doc_id IS NULL"))
    known = texts.mapInArrow(lean(_packed(k)), "node long, n long, cells binary, set binary").join(if_small(wanted.select("node"), n_wanted), "node", "left_semi")
    known = written(known.dropDuplicates(["node"]), "known")
    members, largest = _members(buckets, known)
    removed(buckets, wanted)
    shingles = known.select("node", "set")
    spread = -(-largest // TILE)
    links, seen = None, None
    for step, few in enumerate((1, 2, None)):
        labels = components(links) if links is not None else None
        pairs = _open_pairs(members, labels, largest, num, den, few)
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = written(pairs, f"pairs{step}")
        if step and not pairs.count():
            break
        found = written(verified(pairs, shingles, spread, num, den), f"links{step}")
        links = found if links is None else links.unionByName(found)
        seen = pairs.select("a", "b") if seen is None else seen.unionByName(pairs.select("a", "b"))
    labels = written(components(links), "labels")
    removed(known, members, seen, links)
    # copies of one set, and sets that are linked, have another's number; these are few, and no key of theirs is a group
    firsts = sets.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    grouped = written(firsts.join(labels, "node", "left").where("copies > 1 OR label IS NOT NULL").select("node", "first", F.coalesce("label", "node").alias("label")), "grouped")
    least = written(grouped.groupBy("label").agg(F.min("first").alias("component_id")), "least")
    groups = written(grouped.join(least, "label").select("node", "component_id", F.lit(True).alias("in_group")), "groups")
    removed(grouped, least)
    out = sets.join(groups, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("in_group"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs`, all columns, with the smallest doc_id of each component alone; repeated rows of it are one.

    Rows of null doc_id can't be told apart by it; all of them stay.  Only the numbers of rows that go are joined to the texts.
    """
    found = jaccard_components(docs, k, num, den).where("doc_id IS NOT NULL")
    ids = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first_"), F.count(F.lit(1)).alias("n_"))
    odd = written(ids.where("NOT first_ OR n_ > 1").select(F.col("doc_id").alias("id_"), "first_"), "odd")
    removed(found)  # its tables
    n, repeated = odd.agg(F.count(F.lit(1)), F.count(F.when(F.col("first_"), 1))).first()
    if not n:
        return docs
    left = docs.join(if_small(odd, n), F.col("doc_id").cast("long") == F.col("id_"), "left")
    out = left.where("id_ IS NULL").select(*docs.columns)
    return out.unionByName(left.where("first_").select(*docs.columns).dropDuplicates(["doc_id", "text"])) if repeated else out
