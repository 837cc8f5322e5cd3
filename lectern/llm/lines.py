"""Lines that many documents share, found by levelled sorted runs of line keys."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import own_columns, removed, shared_dir, small_batches, written
from .vec import BYTE_VALUES, SPACE, U64, prefix, spans, text_buffers

#: Runs of a level that are merged into one of the next level; batches that a whole table is dealt in.
FAN, BATCHES = 2, 4
#: Bytes of text whose lines are found at a time; longer documents go in parts that end at a line.
PART_BYTES = 1 << 20
#: What stands for the id of a row without one: below all others.
NO_ID = -(1 << 63)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends (without the break) of all lines, and each document's first line (n + 1 of them)."""
    breaks, n = np.flatnonzero(data == 10), len(off) - 1
    doc = np.searchsorted(off, breaks, "right") - 1
    first = np.arange(n + 1) + np.searchsorted(breaks, off)
    starts, ends = np.empty(n + len(breaks), np.int64), np.empty(n + len(breaks), np.int64)
    starts[first[:-1]], ends[first[1:] - 1] = off[:-1], off[1:]
    at = np.arange(len(breaks)) + doc
    starts[at + 1], ends[at] = breaks + 1, breaks
    return starts, ends, first


def line_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, 64-bit hash and another 32 bits of each line's key: stripped at both ends, A-Z in lower case."""
    black = np.flatnonzero(~SPACE[data])
    lo, hi = np.searchsorted(black, starts), np.searchsorted(black, ends)
    full = lo < hi
    a, b = starts.copy(), starts.copy()
    a[full], b[full] = black[lo[full]], black[hi[full] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    low = LOWER[data]
    h = spans(prefix(BYTE_VALUES[low], "byte"), a, b, "byte")
    other = spans(prefix(BYTE_VALUES[::-1][low], "word"), a, b, "word") >> U64(32)
    return points[b] - points[a], h.view(np.int64), other.astype(np.uint32).view(np.int32)


def parts(data: np.ndarray, off: np.ndarray, limit: int = PART_BYTES):
    """(first document, data, offsets) of some documents of `limit` bytes together; a longer one comes alone, in parts that end at a line.

    The parts of one document leave out the line break between them.
    """
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        if j > i:
            yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
            continue
        at, stop = int(off[i]), int(off[i + 1])
        while True:
            end, want = stop, limit
            while at + want < stop:
                if len(cut := np.flatnonzero(data[at : at + want] == 10)):
                    end = at + int(cut[-1])
                    break
                want *= 2
            yield i, data[at:end], np.array([0, end - at])
            if end == stop:
                break
            at = end + 1
        i += 1


def document_lines(docs: DataFrame, least_points: int) -> DataFrame:
    """doc_id, row and the key (h, other) of each document's lines of at least so many code points, each key once."""

    def distinct(found: list) -> tuple[np.ndarray, ...]:
        d, k, o = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((o, k, d))
        d, k, o = d[order], k[order], o[order]
        new = np.ones(len(order), bool)
        new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        return d[new], k[new], o[new]

    def run(batches):
        for b in batches:
            data, off = text_buffers(b.column("text"))
            found: list = []  # of the parts of one document, or of one part of several
            last = -1
            for i, part, at in [*parts(data, off), (len(off), data[:0], np.zeros(1, np.int64))]:
                if i != last and found:
                    d, k, o = distinct(found)
                    take, found = pa.array(d), []
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("row").take(take), pa.array(k), pa.array(o)], names=["doc_id", "row", "h", "other"])
                starts, ends, first = line_spans(part, at)
                points, h, other = line_keys(part, starts, ends)
                doc, long, last = np.repeat(np.arange(len(at) - 1), np.diff(first)) + i, points >= least_points, i
                found.append((doc[long], h[long], other[long]))

    return docs.mapInArrow(run, "doc_id long, row long, h long, other int")


class LineRuns:
    """Sorted runs of line keys in levels: each run has (h, other, n documents, largest doc_id) by buckets of the key.

    A batch of lines is merge-anti-joined with the runs: keys that a run has settled (found in `least` documents) go, and
    the rest become a run of their own on the lowest level.  `fan` runs of a level are merged into one of the next, so a
    batch meets only a logarithm of them.  Batches have to come in descending order of doc_id: then the first run with a
    key has its largest doc_id.  Runs are bucketed and sorted tables below spark.checkpoint.dir with as many buckets as
    shuffle partitions, so that the joins exchange neither side again.
    """

    def __init__(self, spark: SparkSession, least: int, fan: int = FAN):
        self.spark, self.least, self.fan = spark, least, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame) -> str:
        name = f"lectern_run_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(self.buckets, "h", "other").sortBy("h", "other").option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            df = self.spark.table(name)
            removed(df)
            self.spark.sql(f"DROP TABLE {name}")

    def _merged(self, names: list[str]) -> DataFrame:
        """One run of several, by merge joins on both sides' buckets. (A union of bucketed tables isn't exchanged before
        an aggregate in this Spark, and then gives a key more than once.)"""
        out = self.spark.table(names[0])
        for name in names[1:]:
            b = self.spark.table(name).select("h", "other", F.col("n").alias("n_"), F.col("top").alias("top_")).hint("merge")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))
            out = out.join(b, ["h", "other"], "full_outer").select("h", "other", n.alias("n"), F.greatest("top", "top_").alias("top"))
        return out

    def add(self, lines: DataFrame) -> None:
        """Adds a batch (doc_id, h, other; one row for each document and key)."""
        new = lines.groupBy("h", "other").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("doc_id", F.lit(NO_ID))).alias("top"))
        for name in [x for level in self.levels for x in level]:
            new = new.join(self.spark.table(name).where(F.col("n") >= self.least).select("h", "other").hint("merge"), ["h", "other"], "left_anti")
        run, level = self._write(new), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(full := self.levels[level]) < self.fan:
                return
            run = self._write(self._merged(full))
            self._drop(full)
            self.levels[level], level = [], level + 1

    def settled(self) -> DataFrame:
        """h, other and the largest doc_id (NO_ID for none) of the keys in at least `least` documents; the runs are gone afterwards."""
        names = [x for level in self.levels for x in level]
        if not names:
            return self.spark.createDataFrame([], "h long, other int, top long")
        out = written(self._merged(names).where(F.col("n") >= self.least).select("h", "other", "top"), "settled")
        self._drop(names)
        self.levels = []
        return out


def _kept(with_text: bool):
    def run(batches):
        for b in batches:
            data, off = text_buffers(b.column("text"))
            n = len(off) - 1
            gone = b.column("gone")
            marked, at = gone.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            lines, dropped, hashes, texts = np.zeros(n, np.int64), np.zeros(n, np.int64), [hashlib.sha256() for _ in range(n)], [[] for _ in range(n)]
            begun = np.zeros(n, bool)  # a kept line of it was hashed
            for i, part, o in parts(data, off):
                starts, ends, first = line_spans(part, o)
                h = line_keys(part, starts, ends)[1] if at[i + len(o) - 1] > at[i] else None
                raw = part.tobytes()
                for d in range(len(o) - 1):
                    k, (p, q) = i + d, first[d : d + 2]
                    lines[k] += q - p
                    body: bytes | None = raw[o[d] : o[d + 1]]
                    if at[k + 1] > at[k]:
                        stays = ~np.isin(h[p:q], marked[at[k] : at[k + 1]])
                        dropped[k] += q - p - stays.sum()
                        own = [raw[s:e] for s, e in zip(starts[p:q][stays].tolist(), ends[p:q][stays].tolist())]
                        body = b"\n".join(own) if own else None
                    if body is not None:
                        body = b"\n" + body if begun[k] else body
                        begun[k] = True
                        hashes[k].update(body)
                        if with_text:
                            texts[k].append(body)
            cols = [b.column("doc_id"), pa.array(lines), pa.array(dropped), pa.array([x.hexdigest() for x in hashes])]
            yield pa.RecordBatch.from_arrays(cols + [pa.array([b"".join(x).decode("utf-8", "replace") for x in texts])] * with_text, names=["doc_id", "n_lines", "n_dropped", "kept_sha256"] + ["text"] * with_text)

    return run


def dedup_lines(docs: DataFrame, least_points: int = 20, least_documents: int = 3, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """Documents without lines that others have: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, the text that is left.

    A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both ends, with A-Z in lower case.  Keys of at least
    `least_points` code points in at least `least_documents` documents lose all of their lines but those in the largest
    doc_id.  The table is dealt into `batches` of descending doc_id, each of which is joined with the runs of those before.
    A null or empty text is one empty line.  Each row counts as a document; rows of one doc_id keep or lose a key alike; a
    null doc_id is below all others.  Very long texts go in parts of lines; one line is held whole.  Other columns are left
    out; an empty table has no rows.  Keys are compared by 96 bits of hash.
    """
    spark = docs.sparkSession
    rows = own_columns(docs, "doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    cuts = rows.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    batch = F.size(F.filter(F.lit(sorted(set(cuts), reverse=True)).cast("array<bigint>"), lambda x: x > F.coalesce("doc_id", F.lit(NO_ID)))) if cuts else F.lit(0)
    path = f"{shared_dir(spark)}/lines"
    found = document_lines(small_batches(rows), least_points)
    found.withColumn("batch", batch).write.option("compression", "zstd").partitionBy("batch").parquet(path)
    lines = spark.read.schema(T.StructType([*found.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(path)
    runs = LineRuns(spark, least_documents)
    for i in range(len(set(cuts or ())) + 1):
        runs.add(lines.where(F.col("batch") == i).select("doc_id", "h", "other"))
    settled = runs.settled()
    gone = written(lines.join(settled, ["h", "other"]).where(F.coalesce("doc_id", F.lit(NO_ID)) < F.col("top")).groupBy("row").agg(F.collect_set("h").alias("gone")), "gone")
    removed(lines, settled)
    out = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text
    return small_batches(rows.join(gone, "row", "left").select("doc_id", "text", "gone")).mapInArrow(_kept(with_text), out)
