"""Quality rules: statistics of whole texts, judged by an isolation forest with a threshold from labelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import if_small, small_batches
from .tokens import lean
from .vec import BYTE_VALUES, SPACE, U64, chunks, mix, prefix, spans, text_buffers, windows, words

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")
_SYMBOL, _UPPER, _MARK = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER[ord("A") : ord("Z") + 1] = True
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


def _again(key: np.ndarray) -> np.ndarray:
    """True where a value occurs twice or more."""
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(key), bool)
    twice = twice[np.append(True, twice[1:] != twice[:-1])]
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    return twice[at] == key


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of COUNTS for each document."""
    n = len(off) - 1
    out = np.zeros((n, len(COUNTS)), np.int64)
    if not len(data):
        return out

    def by_doc(flag: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag)])[off])

    starts, ends, first = words(data, off)
    out[:, 0] = np.diff(first)
    out[:, 1] = by_doc(~SPACE[data] & ((data & 0xC0) != 0x80))
    out[:, 2] = by_doc(_SYMBOL[data])
    p = prefix(BYTE_VALUES[data], "byte")
    # lines: from a document's start or a line feed to the next line feed or the document's end
    edge = np.unique(np.concatenate([off[:-1], np.flatnonzero(data == 0x0A) + 1]))
    edge = edge[edge < len(data)]
    stop = np.append(edge[1:], len(data))
    stop = stop - (data[stop - 1] == 0x0A)
    black = np.concatenate([[0], np.cumsum(~SPACE[data])])
    full = black[stop] > black[edge]
    edge, stop = edge[full], stop[full]
    doc = np.searchsorted(off, edge, "right") - 1
    key = spans(p, edge, stop, "byte")
    order = np.lexsort((key, doc))
    same = (np.diff(doc[order]) == 0) & (key[order][1:] == key[order][:-1])
    out[:, 3], out[:, 7] = np.bincount(doc[order][1:][same], minlength=n), np.bincount(doc, minlength=n)
    out[:, 5], out[:, 6] = by_doc(_UPPER[data]), by_doc(_MARK[data])
    if len(starts) >= WINDOW:
        w = windows(spans(p, starts, ends, "byte"), WINDOW)
        of = np.repeat(np.arange(n), np.diff(first))
        inside = of[: len(w)] == of[WINDOW - 1 :]
        at = np.flatnonzero(inside)
        at = at[_again(mix(w[at] ^ mix(of[at].astype(U64))))]
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        out[:, 4] = np.bincount(of[np.cumsum(cover)[:-1] > 0], minlength=n)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS (long) of every whole text; null is empty."""

    def run(batches):
        for b in batches:
            data, off = text_buffers(b.column("text"))
            rows = [counts(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in chunks(off)]
            all_rows = np.concatenate(rows) if rows else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in all_rows.T)], names=["doc_id", *COUNTS])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features(c: np.ndarray) -> np.ndarray:
    """What the forest splits on: ratios of the counts, none of which follows a text's length."""
    c = c.astype(np.float64)
    words_, chars, lines = np.maximum(1, c[:, 0]), np.maximum(1, c[:, 1]), np.maximum(1, c[:, 7])
    return np.stack([chars / words_, c[:, 2] / words_, c[:, 4] / words_, c[:, 5] / chars, c[:, 6] / words_, c[:, 3] / lines], 1)


def margin(x: np.ndarray) -> np.ndarray:
    """How far cuts reach beyond a node's range: a twentieth of each feature's range, of the share of repeated lines at least of all its range (0 to 1)."""
    return 0.05 * np.maximum(x.max(0) - x.min(0), [0, 0, 0, 0, 0, 1])


def base_failed(c: np.ndarray) -> np.ndarray:
    return (c[:, 0] < 20) | (100 * c[:, 4] > 30 * c[:, 0])


def _path(n: float) -> float:
    """The mean path length of unsuccessful searches in a binary search tree of n keys."""
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


class Forest:
    """An isolation forest in arrays: node i of a tree splits on `feature` below `cut`; its children are 2i+1 and 2i+2.

    Cuts are drawn from a node's range and `margin` (of each feature) beyond, so that what lies outside all rows of the
    sample, or differs in a feature that is constant there, is isolated early.
    """

    def __init__(self, x: np.ndarray, margin: np.ndarray | float = 0.0, trees: int = 100, sample: int = 512, seed: int = 11):
        r = np.random.default_rng(seed)
        self.depth = max(1, int(np.ceil(np.log2(min(sample, max(2, len(x)))))))
        size = 2 ** (self.depth + 1) - 1
        self.feature, self.cut, self.length = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
        self.norm = max(_path(min(sample, len(x))), 1e-9)
        for t in range(trees):
            rows = x[r.choice(len(x), min(sample, len(x)), replace=False)] if len(x) else x
            todo = [(0, 0, rows)]
            while todo:
                i, d, part = todo.pop()
                low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(1), np.zeros(1))
                low, high = low - margin, high + margin
                can = np.flatnonzero(high > low)
                if d == self.depth or len(part) < 2 or not len(can):
                    self.length[t, i] = d + _path(len(part))
                    continue
                f = int(r.choice(can))
                cut = r.uniform(low[f], high[f])
                self.feature[t, i], self.cut[t, i] = f, cut
                todo += [(2 * i + 1, d + 1, part[part[:, f] < cut]), (2 * i + 2, d + 1, part[part[:, f] >= cut])]

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / that of a random tree): near 1 for anomalies, about 0.5 or less for the rest."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, np.maximum(f, 0)] >= self.cut[t, node]))
            total += self.length[t, node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def threshold(score: np.ndarray, good: np.ndarray, keep_good: float = 0.998) -> float:
    """The least score that is rejected: best in the mean of good rows kept and bad ones rejected, with `keep_good` of the good ones kept. Infinite without a good row."""
    if not good.any():
        return float("inf")
    least = float(np.quantile(score[good], keep_good))
    best, at = -1.0, float("inf")
    for cut in np.unique(score[score > least]):
        value = (score[good] < cut).mean() + ((score[~good] >= cut).mean() if (~good).any() else 0)
        if value > best:
            best, at = value, float(cut)
    if keep_good == 1 and not np.isfinite(at):  # no bad row above all good ones: what lies beyond these is rejected
        at = float(np.nextafter(least, np.inf))
    return at


#: Features of each forest, and the share of good rows that its threshold keeps: all together, and the share of repeated lines alone, which one feature of six seldom shows.
SETS = (([0, 1, 2, 3, 4, 5], 0.998), ([5], 1.0))


class Forests:
    """A forest for each of SETS, fitted on good rows, each with a threshold from labelled rows that it hasn't seen."""

    def __init__(self, x: np.ndarray, fitted: np.ndarray, good: np.ndarray):
        wide = margin(x) if len(x) else np.zeros(6)
        self.each = [Forest(x[fitted][:, s], wide[s]) for s, _ in SETS]
        self.cut = [threshold(f.score(x[~fitted][:, s]), good[~fitted], keep) for f, (s, keep) in zip(self.each, SETS)]

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of all features, and whether a score reaches its threshold."""
        scores = [f.score(x[:, s]) if np.isfinite(cut) else np.zeros(len(x)) for f, (s, _), cut in zip(self.each, SETS, self.cut)]
        return scores[0], np.any([v >= cut for v, cut in zip(scores, self.cut)], axis=0)


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = 20000) -> DataFrame:
    """doc_id, COUNTS, base_failed, anomaly and kept of all documents (doc_id, text) by labels (doc_id, quality).

    The forest is fitted on one half of the labelled rows of good quality, and the threshold is set on the other half
    and on those of bad quality, none of which the forest has seen: about `sample_rows` of them, chosen by a hash of
    doc_id, with those that fail the base rules left out.
    A second forest, of the share of repeated lines alone, has a threshold of its own from the same rows; either rejects.
    Without good labelled rows only the base rules count.  A null text has no words and fails them.  Repeated rows
    are judged each for itself, very long texts whole; of several labels of a doc_id the least counts; labels of a null
    doc_id or a null quality aren't used; other columns aren't read.  An empty table gives an empty result.
    """
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    n = marks.count()
    share = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) < F.lit(((1 << 63) - 1) * min(sample_rows, n) // max(1, n))
    chosen = marks.where(share) if n > sample_rows else marks
    few = if_small(chosen, min(n, 2 * sample_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id", "left_semi")
    rows = statistics(texts).join(few, "doc_id").collect()
    rows.sort(key=lambda r: r["doc_id"])
    c = np.array([[r[k] for k in COUNTS] for r in rows], np.int64).reshape(-1, len(COUNTS))
    good = np.array([r["quality"] > 0 for r in rows], bool)
    use = ~base_failed(c)
    c, good = c[use], good[use]
    x = features(c)
    # rows of one text, as they have the same counts, are on the same side
    group = np.unique(c, axis=0, return_inverse=True)[1].reshape(-1) if len(c) else np.zeros(0, np.int64)
    fitted = good & (np.random.default_rng(7).permutation(len(c))[group] % 2 == 0) if len(c) else good
    forests = Forests(x, fitted, good)

    def run(batches):
        for b in batches:
            c = np.stack([b.column(k).to_numpy() for k in COUNTS], 1)
            x = features(c)
            score, odd = forests.judge(x)
            failed = base_failed(c)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(failed), pa.array(score), pa.array(~failed & ~odd)], names=[*b.schema.names, "base_failed", "anomaly", "kept"])

    stats = statistics(docs)
    return stats.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean")
