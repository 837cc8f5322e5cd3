"""Benchmark decontamination: a BM25 index of test items, queried by every passage with block-max WAND, then verified.

The items are indexed, not the corpus: postings by term, in blocks with the largest impact of each.  A document is cut
into passages twice as long as the longest item, each half over the next, so every item that a document holds is whole
in one of them.  Every passage is a query.  Impacts are divided by the item's score against itself, so that one
threshold, a share of the item's BM25 mass, fits all items.  Block-max WAND finds all items above it: cursors skip to the
next block that the largest impacts of a passage's terms allow, and only blocks whose own maxima reach the threshold are
scored.  An item that is retrieved counts if the passage overlaps both its question and its answer.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written
from .tokens import lean
from .vec import U64, chunks, take_ranges, text_buffers, windows, word_hashes, words

K1, B, BLOCK = 1.2, 0.75, 8
#: Passages that are searched side by side.
TOGETHER = 4096
#: Blocks of a stretch, which has largest impacts of its own.
STRETCH = 32
#: Letters and digits as they are, all else in ASCII as a space.
_PLAIN = np.array([c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)], np.uint8)
_ANSWER = re.compile(r"(?is)^(.*?)\banswer\s*:\s*(.*)$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def question_answer(text: str) -> tuple[str, str]:
    """What stands before and after `answer:`; without that mark, all sentences but the last, and the last; a lone sentence is both."""
    if m := _ANSWER.match(text):
        return m[1], m[2]
    parts = [s for s in _SENTENCE.split(text.strip()) if s.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def lowered(col) -> tuple[np.ndarray, np.ndarray]:
    return text_buffers(pc.utf8_lower(col.cast(pa.large_string())))


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of letters and digits of lower-cased texts, and each document's first."""
    plain = _PLAIN[data]
    starts, ends, first = words(plain, off)
    return word_hashes(plain, starts, ends), first


def _terms_of(texts: list[str]) -> list[np.ndarray]:
    data, off = lowered(pa.array(texts, pa.string()))
    h, first = terms(data, off)
    return [h[a:b] for a, b in zip(first[:-1], first[1:])]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct runs of n terms; of fewer terms, the whole run."""
    return np.unique(windows(h, min(n, len(h)))) if len(h) else np.zeros(0, U64)


class Statistics:
    """What BM25 takes from all items, however they are dealt to shards: document frequencies, count and mean length of items, and the longest."""

    def __init__(self, items: Iterable[tuple[int, str]]):
        self.df, self.n, words_, self.longest = Counter(), 0, 0, 1
        for part in _parts(items, 2000):  # few terms are held at once
            for x in _terms_of([t for _, t in part]):
                self.df.update(set(x.tolist()))
                words_ += len(x)
                self.longest = max(self.longest, len(x))
            self.n += len(part)
        self.mean = max(1.0, words_ / self.n) if self.n else 1.0


def _parts(items: Iterable, size: int) -> Iterator[list]:
    items = iter(items)
    while part := list(islice(items, size)):
        yield part


class Index:
    """Postings of items with normalised BM25 impacts, in blocks of BLOCK items, and each item's question and answer n-grams.

    A term's postings are the blocks that have it, ascending, with its largest impact there (`most`) and the row of
    `impact` with its impacts on the block's items; `stretch_top` is its largest impact in each stretch of STRETCH blocks.  Items are sorted by the most
    common terms that they have, which keeps like items (of one language, say) in one block and the maxima low.  `of`
    are the statistics of all items, where these are a part of them: a score doesn't depend on which items share an index.
    """

    def __init__(self, items: list[tuple[int, str]], gram: int = 3, of: Statistics | None = None):
        self.gram = gram
        of = of or Statistics(items)
        df = of.df
        own = _terms_of([t for _, t in items])
        by = sorted(range(len(items)), key=lambda d: sorted(set(own[d].tolist()), key=lambda t: (-df[t], t))[:12])
        items, own = [items[d] for d in by], [own[d] for d in by]
        self.ids = np.array([-1 if i is None else i for i, _ in items], np.int64)
        self.no_id = np.array([i is None for i, _ in items], bool)
        parts = [question_answer(t) for _, t in items]
        self.question = [grams(x, gram) for x in _terms_of([q for q, _ in parts])]
        self.answer = [grams(x, gram) for x in _terms_of([a for _, a in parts])]
        self.longest = of.longest
        self.terms = np.unique(np.concatenate([np.zeros(0, U64), *own]))
        self.blocks = max(1, -(-len(own) // BLOCK))
        self.exact = []  # each item's terms, ascending, with their impacts in 64 bits
        for x in own:
            mine, tf = np.unique(x, return_counts=True)
            n = np.array([df[t] for t in mine.tolist()], np.float64)
            raw = np.log(1 + (of.n - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x) / of.mean))
            self.exact.append((mine, raw / raw.sum() if len(raw) else raw))
        item = np.repeat(np.arange(len(own)), [len(m) for m, _ in self.exact])
        term = np.searchsorted(self.terms, np.concatenate([np.zeros(0, U64), *(m for m, _ in self.exact)]))
        self.key, row = np.unique(term * self.blocks + item // BLOCK, return_inverse=True)  # of each posting: term and block
        self.impact = np.zeros((len(self.key), BLOCK), np.float32)
        self.impact[row, item % BLOCK] = np.concatenate([np.zeros(0), *(v for _, v in self.exact)])
        self.most = self.impact.max(1)
        self.block = self.key % self.blocks
        # the same by stretches of STRETCH blocks: where a term's postings there begin, and its largest impact there
        stretches = -(-self.blocks // STRETCH)
        self.stretch_key, self.stretch_at = np.unique(self.key // self.blocks * stretches + self.block // STRETCH, return_index=True)
        self.stretch = self.stretch_key % stretches
        self.stretch_top = np.maximum.reduceat(self.most, self.stretch_at).astype(np.float64) if len(self.key) else np.zeros(0)
        self.stretch_at = np.append(self.stretch_at, len(self.key))
        self.stretch_first = np.searchsorted(self.stretch_key, np.arange(len(self.terms) + 1) * stretches)

    def search(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all scores of at least the threshold. passage: ascending; term: its distinct terms' numbers.

        Block-max WAND, for many passages side by side, stretch by stretch of the index: a passage whose terms' largest
        impacts in a stretch don't reach the threshold together skips it.  Else each passage has a cursor in the postings of each of its terms, in
        the order of the blocks that they stand at.  In each step, a passage's pivot is the block of the first cursor at
        which the running sum of its terms' largest impacts reaches the threshold; without one the passage is done and
        dropped.  Cursors before the pivot skip to it; if the maxima of the cursors that stand there reach the threshold,
        its items are scored; then these cursors go on.  A step costs a passage its own cursors, however many items there are.
        """
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        low = threshold - 1e-4  # sums of 32-bit floats
        queries, own = np.unique(passage, return_inverse=True)
        for k in range(0, len(queries), TOGETHER):
            x, y = np.searchsorted(own, (k, k + TOGETHER))
            query, number = own[x:y] - k, term[x:y]
            at, end = self.stretch_first[number], self.stretch_first[number + 1]
            for stretch in range(-(-self.blocks // STRETCH)):
                here = np.flatnonzero(at < end)
                here = here[self.stretch[at[here]] == stretch]
                reach = np.bincount(query[here], self.stretch_top[at[here]], TOGETHER) >= low
                go = here[reach[query[here]]]
                p = at[go]
                for q, item, score in self._wand(query[go], number[go], self.stretch_at[p], self.stretch_at[p + 1], self.stretch_top[p], low):
                    out.append((queries[k + q], item, score))
                at[here] += 1
        return tuple(np.concatenate(x) for x in zip(*out))

    def _wand(self, query: np.ndarray, term: np.ndarray, at: np.ndarray, end: np.ndarray, top: np.ndarray, low: float):
        """`search` within a stretch, from the cursors `at`, which end at `end`; passages by number."""
        while len(at):
            block = self.block[at]
            order = np.argsort(query * self.blocks + block, kind="stable")  # nearly in order already
            query, term, at, end, top, block = (v[order] for v in (query, term, at, end, top, block))
            begin = np.flatnonzero(np.diff(query, prepend=-1))  # of each passage's cursors
            size = np.diff(np.append(begin, len(query)))
            total = np.cumsum(top)
            reach = np.flatnonzero(total - np.repeat(total[begin] - top[begin], size) >= low)
            mine, first = np.unique(query[reach], return_index=True)
            if not len(mine):
                return
            live = np.isin(query[begin], mine, assume_unique=True)
            pivot = block[reach[first]]
            here = np.repeat(pivot, size[live])
            keep = np.repeat(live, size)
            if not keep.all():
                query, term, at, end, top, block = (v[keep] for v in (query, term, at, end, top, block))
            row = np.repeat(np.arange(len(mine)), size[live])  # of the passage among those that go on
            behind = np.flatnonzero(block < here)
            at[behind] = np.searchsorted(self.key, term[behind] * self.blocks + here[behind])
            behind = behind[at[behind] < end[behind]]
            block[behind] = self.block[at[behind]]
            stand = np.flatnonzero((block == here) & (at < end))
            bound = np.bincount(row[stand], self.most[at[stand]], len(mine))
            scored = stand[bound[row[stand]] >= low]
            if len(scored):
                edge = np.flatnonzero(np.diff(row[scored], prepend=-1))
                score = np.add.reduceat(self.impact[at[scored]], edge, axis=0)
                q, j = np.nonzero(score >= low)
                of = row[scored][edge][q]
                yield mine[of], pivot[of] * BLOCK + j, score[q, j].astype(np.float64)
            at[stand] += 1
            left = at < end
            query, term, at, end, top = (v[left] for v in (query, term, at, end, top))


def _inside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in the ascending y."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)


def search_documents(index: Index, h: np.ndarray, first: np.ndarray, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float, int]]:
    """(document, item, score, question overlap, answer overlap, first word of the passage), the best passage of each pair."""
    if not len(index.terms) or not len(h):
        return []
    number = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    at = np.flatnonzero(index.terms[number] == h)
    step, n = index.longest, np.diff(first)
    count = np.maximum(1, -(-n // step) - 1)
    base = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(n)), n)[at]
    part = (at - first[doc]) // step  # a word is in the passage that begins with its step, and in the one before
    one = np.where(part < count[doc], base[doc] + part, -1)
    two = np.where(part > 0, base[doc] + part - 1, -1)
    key = np.unique(np.concatenate([one[one >= 0] << 24 | number[at][one >= 0], two[two >= 0] << 24 | number[at][two >= 0]]))
    best: dict[tuple[int, int], tuple] = {}
    have: dict[int, dict[int, np.ndarray]] = {}
    for p, item in zip(*(x.tolist() for x in index.search(key >> 24, key & 0xFFFFFF, threshold)[:2])):
        d = int(np.searchsorted(base, p, "right")) - 1
        s = int(first[d]) + (p - int(base[d])) * step
        if p not in have:
            e = min(s + 2 * step, int(first[d + 1]))
            have[p] = {g: np.unique(windows(h[s:e], g)) for g in range(1, index.gram + 1)} | {0: np.unique(h[s:e])}
        mine, impact = index.exact[item]
        score = float(impact[_inside(mine, have[p][0])].sum())  # the same whatever else the index has
        if score < threshold - 1e-9:
            continue
        # parts of fewer terms than a gram are one gram of that length
        share = [max(np.count_nonzero(_inside(x, y)) / len(x) for g, y in have[p].items() if g) if len(x) else 1.0 for x in (index.question[item], index.answer[item])]
        if min(share) >= overlap and ((d, item) not in best or score > best[d, item][2]):
            best[d, item] = (d, item, score, *share, s - int(first[d]))
    return list(best.values())


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.5, items_a_shard: int = 20_000) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap and passage_start (in words) of all pairs that verify.

    score: the share of the item's BM25 mass in the passage.  Overlaps: shares of the distinct 3-word runs of question
    and answer in the passage.  The index is held by every task, so items are taken `items_a_shard` at a time: a larger
    benchmark takes a pass over the documents for each shard, whose rows are written before the next.  Document
    frequencies, lengths and passages are those of all items, so the rows don't depend on the shards.  Items of null
    text, or without words, are in no passage.

    A null or empty text has no passages, a very long one has as many as it needs.  Repeated rows are searched each for
    itself; of several passages with an item the first of the best counts.  A null doc_id stays null, null item_ids too.
    Other columns are left out.  Empty tables give an empty result.
    """
    items = _items(benchmark)
    out, of = None, Statistics(items)
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for part in _parts(items, items_a_shard) if of.n else [[]]:
        found = rows.mapInArrow(lean(_search(Index(part, of=of), threshold, overlap)), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start long")
        found = written(found, "found") if of.n > items_a_shard else found
        out = found if out is None else out.unionByName(found)
    return out


class _items:
    """The items with words, (item_id, text); they are brought from Spark part by part whenever they are gone through."""

    def __init__(self, benchmark: DataFrame):
        rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(r"text RLIKE '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]'")
        self.rows = written(rows, "items")

    def __iter__(self) -> Iterator[tuple[int, str]]:
        return ((r["item_id"], r["text"]) for r in self.rows.toLocalIterator())


def _search(index: Index, threshold: float, overlap: float):
    def run(batches):
        for b in batches:
            data, off = lowered(b.column("text"))
            ids = b.column("doc_id")
            for i, j in chunks(off):
                h, first = terms(data[off[i] : off[j]], off[i : j + 1] - off[i])
                found = search_documents(index, h, first, threshold, overlap)
                if found:
                    d, item, score, q, a, s = (np.array(x) for x in zip(*found))
                    item_ids = pa.array(index.ids[item], mask=index.no_id[item])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + d)), item_ids, pa.array(score), pa.array(q), pa.array(a), pa.array(s.astype(np.int64))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passage_start"])

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.5, items_a_shard: int = 20_000) -> DataFrame:
    """The rows of `docs`, all columns, without those that hold an item; what `contaminated` says of a row decides, also where doc_id is null."""
    items = _items(benchmark)
    of = Statistics(items)
    for k, part in enumerate(_parts(items, items_a_shard)):
        docs = small_batches(docs).mapInArrow(lean(_keep(Index(part, of=of), threshold, overlap)), docs.schema)
        docs = written(docs, "kept") if (k + 1) * items_a_shard < of.n else docs
    return docs


def _keep(index: Index, threshold: float, overlap: float):
    def run(batches):
        for b in batches:
            data, off = lowered(b.column("text"))
            keep = np.ones(b.num_rows, bool)
            for i, j in chunks(off):
                h, first = terms(data[off[i] : off[j]], off[i : j + 1] - off[i])
                keep[[i + x[0] for x in search_documents(index, h, first, threshold, overlap)]] = False
            yield b.filter(pa.array(keep))

    return run
