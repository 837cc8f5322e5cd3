"""Importance resampling towards a target: n-gram bucket weights, Gumbel scores, and an exact draw merged from sorted runs."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import own_columns, removed, small_batches, written
from .vec import text_buffers

BUCKETS = 10_000
#: Words of a feature at most.
ORDER = 3
#: Bytes of text worked on at a time, and rows that one merge is planned for.
PART_BYTES, RANGE_ROWS = 1 << 20, 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words, in lower case: 0-9, a-z and all of characters beyond ASCII.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True

#: Longest word whose checksum is taken, or shifted by, in step with others.
_SHORT = 64
_STEP = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)  # of the register's low byte


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """What so many zero bytes make of each byte of a checksum's register: for 0 to _SHORT of them, and for powers of two."""
    unit = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    short = [unit]
    for _ in range(_SHORT):
        short.append(_STEP[short[-1] & 255] ^ (short[-1] >> 8))
    power = [short[1]]
    for _ in range(31):
        power.append(np.stack([_apply(power[-1], power[-1][k]) for k in range(4)]))
    return np.stack(short), power


_SHIFT, _POWER = _shifts()


def crc_shift(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums moved ahead of n further bytes; the exclusive or with those bytes' checksum is that of both together."""
    flat, m = _SHIFT.reshape(-1), np.minimum(n, _SHORT) * 1024
    out = flat[m + (c & 255)] ^ flat[m + 256 + ((c >> 8) & 255)] ^ flat[m + 512 + ((c >> 16) & 255)] ^ flat[m + 768 + (c >> 24)]
    for i in np.flatnonzero(n > _SHORT):
        x, left = c[i : i + 1], int(n[i])
        for table in _POWER:
            x, left = _apply(table, x) if left & 1 else x, left >> 1
        out[i] = x[0]
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each word, byte by byte for all words of that length side by side."""
    size = ends - starts
    short = np.flatnonzero(size <= _SHORT)
    order = short[np.argsort(-size[short].astype(np.int8), kind="stable")]
    at, left = starts[order], size[order]
    reg = np.full(len(order), 0xFFFFFFFF, np.uint32)
    active = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right")  # words of at least that length
    for p, n in enumerate(active.tolist()):
        r = reg[:n]
        reg[:n] = _STEP[(r ^ data[at[:n] + p]) & 255] ^ (r >> 8)
    out = np.empty(len(starts), np.uint32)
    out[order] = ~reg
    for i in np.flatnonzero(size > _SHORT):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def parts(data: np.ndarray, off: np.ndarray, limit: int = PART_BYTES) -> Iterator[tuple]:
    """(first document, word starts, word ends, first word of each document, words taken before, lower-cased data).

    Documents go together up to `limit` bytes; a longer one goes alone, in parts that begin with the last two words of the
    part before, which were taken there.
    """

    def found(low: np.ndarray, at: np.ndarray):
        n = len(low)
        inside, edge = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        inside[:n], edge[at] = _INSIDE[low], True
        start = inside[:n] & ~(np.concatenate([[False], inside[: n - 1]])[:n] & ~edge[:n])
        end = inside[:n] & (~inside[1:] | edge[1:])
        s = np.flatnonzero(start)
        return s, np.flatnonzero(end) + 1, np.searchsorted(s, at)

    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        if j > i:
            low = _LOWER[data[off[i] : off[j]]]
            yield i, *found(low, off[i : j + 1] - off[i]), 0, low
            i = j
            continue
        at, stop, carried, want = int(off[i]), int(off[i + 1]), 0, limit
        while True:
            end = min(stop, at + want)
            low = _LOWER[data[at:end]]
            if end < stop:
                outside = np.flatnonzero(~_INSIDE[low])
                end = at + int(outside[-1]) if len(outside) else at
                low = low[: end - at]
            starts, ends, first = found(low, np.array([0, len(low)]))
            if end < stop and len(starts) <= carried:  # nothing new: a very long word
                want *= 2
                continue
            yield i, starts, ends, first, carried, low
            if end == stop:
                break
            carried = min(ORDER - 1, len(starts))
            at, want = at + int(starts[-carried]), limit + int(len(low) - starts[-carried])
        i += 1


def features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, carried: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2 and 3 words: the place of the last word, and the bucket, of each one that ends in a word not carried."""
    crc, size = word_crcs(low, starts, ends), ends - starts
    within = np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first))  # of its document
    out, run = [], crc
    for k in range(ORDER):
        if k:
            before = np.zeros_like(run)
            before[1:] = run[:-1]
            spaced = ~(_STEP[(~before ^ np.uint32(32)) & 255] ^ (~before >> 8))  # the run up to the word before, and a space
            run = crc_shift(spaced, size) ^ crc
        last = np.flatnonzero((within >= k) & (within >= carried))
        out.append((last, (run[last] % np.uint32(BUCKETS)).astype(np.int64)))
    return out


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many features of all texts (a frame with `text`) are in each bucket: BUCKETS numbers, whatever the size."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, starts, ends, first, carried, low in parts(*text_buffers(b.column("text"))):
                for _, bucket in features(low, starts, ends, first, carried):
                    counts += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in small_batches(docs.select("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in the target to its share in the raw texts, rounded down."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (the features' gains) of all documents (doc_id, text)."""

    def run(batches):
        for b in batches:
            data, off = text_buffers(b.column("text"))
            words, count, weight = (np.zeros(len(off) - 1, np.int64) for _ in range(3))
            for i, starts, ends, first, carried, low in parts(data, off):
                at, n = slice(i, i + len(first) - 1), np.diff(first)
                words[at] += n - carried
                for last, bucket in features(low, starts, ends, first, carried):
                    edge = np.searchsorted(last, first)
                    count[at] += np.diff(edge)
                    weight[at] += np.diff(np.concatenate([[0], np.cumsum(gain[bucket])])[edge])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words), pa.array(count), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return small_batches(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number, rounded down, from the first 32 bits of sha256 of `seed:doc_id`; null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


class Tournament:
    """Merges k ascending runs by a tree of losers: each item costs a comparison a level. Runs are read one item at a time."""

    def __init__(self, runs: Iterable[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.head = [next(r, None) for r in self.runs]
        self.tree = [0] * max(1, self.k)  # tree[0]: the winner; tree[i]: the loser of match i
        won = [0] * self.k + list(range(self.k))
        for i in range(self.k - 1, 0, -1):
            a, b = won[2 * i], won[2 * i + 1]
            won[i], self.tree[i] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = won[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and x <= y

    def __iter__(self) -> Iterator:
        while self.k:
            w = self.tree[0]
            if self.head[w] is None:
                return
            yield self.head[w]
            self.head[w] = next(self.runs[w], None)
            i = (w + self.k) // 2
            while i:
                if self._before(self.tree[i], w):
                    w, self.tree[i] = self.tree[i], w
                i //= 2
            self.tree[0] = w


def _merge(t: pa.Table) -> pa.Table:
    """A range's slices of all runs, merged; `quota` of the rows are drawn, with their ranks."""
    if t.num_rows == 0:
        return pa.table([], schema=pa.schema([]))
    col = {c: t.column(c).to_numpy() for c in ("at", "score", "doc_id")}
    order = np.argsort(col["at"])  # at: the run in the high bits, the place in the run in the low ones
    run = col["at"][order] >> 33
    edge = np.flatnonzero(np.diff(run, prepend=-1)).tolist() + [len(order)]
    keys = list(zip((-col["score"][order]).tolist(), col["doc_id"][order].tolist(), col["at"][order].tolist(), order.tolist()))
    quota, before = t.column("quota")[0].as_py(), t.column("before")[0].as_py()
    drawn = [k[-1] for k in islice(Tournament(islice(keys, a, b) for a, b in zip(edge, edge[1:])), quota)]
    out = t.take(pa.array(drawn, pa.int64())).select(["doc_id", "n_features", "weight", "score", "at"])
    return out.append_column("rank", pa.array(np.arange(before + 1, before + 1 + len(drawn)), pa.int64()))


def resample(docs: DataFrame, target: DataFrame, seed: int = 42, least_words: int = 20, share: tuple[int, int] = (5, 100)) -> DataFrame:
    """All documents with doc_id, n_features, weight, score and the rank of those drawn.

    The score is the weight plus Gumbel noise of doc_id, so the highest scores are a draw without replacement by weight.
    Of the N documents of at least `least_words` words, floor(N * share) are drawn, ties going to the smaller doc_id.
    Each task writes a run sorted by score; the score range that surely holds the draw is cut into ranges of at most
    some RANGE_ROWS rows, each of which merges its slices of all runs by a tournament tree, and the range in which the
    draw ends stops at the exact count; lower scores are never read for it.  A null or empty text has weight 0; a null
    doc_id has no noise, so its score is null and it isn't eligible; repeated rows are drawn each for itself, in any
    order among them; very long texts go in parts; other columns are left out; an empty table has no rows.
    """
    spark = docs.sparkSession
    rows = own_columns(docs, "doc_id", "text")
    gain = gains(bucket_counts(rows), bucket_counts(target))
    scored = weighed(rows, gain).withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long"))
    scored = scored.withColumn("eligible", (F.col("n_words") >= least_words) & F.col("score").isNotNull()).drop("n_words")
    runs = written(scored.sortWithinPartitions(F.desc("eligible"), F.desc("score"), "doc_id").withColumn("at", F.monotonically_increasing_id()), "runs")
    eligible = runs.where("eligible")
    n = eligible.count()
    draw = share[0] * n // share[1]
    rest = runs.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if not draw:
        return rest
    bound, more = None, 0.001
    while bound is None:  # a score that at least `draw` rows reach
        p = 1 - draw / n - more
        low = eligible.select(F.percentile_approx("score", p, 10_000) if p > 0 else F.min("score")).first()[0]
        most = eligible.where(F.col("score") >= low).count()
        bound, more = low if most >= draw else None, 4 * more
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // RANGE_ROWS))
    slices = written(eligible.where(F.col("score") >= bound).drop("eligible").repartitionByRange(ranges, F.desc("score"), "doc_id", "at").withColumn("range", F.spark_partition_id()), "slices")
    sizes, before, plan = slices.groupBy("range").count().orderBy("range").collect(), 0, []
    for r in sizes:  # a row for each range
        plan.append((r["range"], min(r["count"], draw - before), before))
        before += r["count"]
        if before >= draw:
            break
    quotas = F.broadcast(spark.createDataFrame(plan, "range int, quota long, before long"))  # one row for RANGE_ROWS of them
    drawn = written(slices.join(quotas, "range").groupBy("range").applyInArrow(_merge, "doc_id long, n_features long, weight long, score long, at long, rank long"), "drawn")
    last = drawn.where(F.col("rank") == draw).first()
    removed(slices)
    after = (F.col("score") < last["score"]) | (F.col("score") == last["score"]) & ((F.col("doc_id") > last["doc_id"]) | (F.col("doc_id") == last["doc_id"]) & (F.col("at") > last["at"]))
    others = rest.where(~runs["eligible"] | after)
    return drawn.select(*others.columns).unionByName(others)
