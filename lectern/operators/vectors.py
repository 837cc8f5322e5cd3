"""TF-IDF rows over runs of 1 to 3 words with a bounded vocabulary, and their latent vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources import sinks

#: Entries of the rows that one task multiplies by a basis: a task sums up the whole basis, so few entries aren't worth one.
TASK_ENTRIES = 5_000_000
#: Bytes of a column, and rows, that a worker turns into arrays at once; a batch of Spark has 10,000 rows, however long they are.
BATCH_BYTES, BATCH_ROWS = 2_000_000, 1000


def _few(batches, column: str):
    """The batches in slices of BATCH_ROWS rows and BATCH_BYTES of a column at most (a longer row is a slice of its own)."""
    for b in batches:
        c = b.column(column)
        sizes = pc.binary_length(c) if pa.types.is_string(c.type) else pc.multiply(pc.list_value_length(c), 4)
        upto = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            fits = int(np.searchsorted(upto, BATCH_BYTES + (upto[at - 1] if at else 0), side="right"))
            end = min(max(fits, at + 1), at + BATCH_ROWS)
            yield b.slice(at, end - at)
            at = end


def _plain(texts: pa.Array) -> pa.Array:
    """Lower case, without accents."""
    return pc.replace_substring_regex(pc.utf8_normalize(pc.utf8_lower(pc.fill_null(texts, "")), "NFKD"), r"\p{Mn}", "")


def _tokens(texts: pa.Array, stop: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of two or more letters, digits and _ without stop words, one after another; which text each is of."""
    lists = pc.split_pattern_regex(_plain(texts), r"[^\p{L}\p{N}_]+")
    words, of = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    use = pc.and_(pc.greater_equal(pc.utf8_length(words), 2), pc.invert(pc.is_in(words, value_set=stop)))
    return words.filter(use), of[use.to_numpy(zero_copy_only=False)]


def _pairs(code: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, times) of what each text has, ascending; codes aren't negative."""
    size = int(code.max()) + 1 if len(code) else 1
    if len(code) and size * (int(of.max()) + 1) < 1 << 62:  # one number for both sorts faster than two
        both = np.sort(of * size + code)
        o, c = both // size, both % size
    else:
        order = np.lexsort((code, of))
        c, o = code[order], of[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return o[at], c[at], np.diff(np.append(at, len(c)))


def _grams(words: pa.Array, of: np.ndarray, known: pa.Array, pairs: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(code, text) of the runs of 2 known words, or of 3 whose pairs are both known (if pairs, ascending, are given).

    Codes: a * len(known) + b for the pair of words a and b; p * len(known) + c for the pair number p and the word c.
    """
    ids, n = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64), len(known)
    both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (of[:-1] == of[1:])) if len(ids) > 1 else np.zeros(0, np.int64)
    code = ids[both] * n + ids[both + 1]
    if pairs is None:
        return code, of[both]
    number = np.full(len(ids) + 1, -1)
    place = np.minimum(np.searchsorted(pairs, code), max(0, len(pairs) - 1))
    hit = pairs[place] == code if len(pairs) else np.zeros(len(code), bool)
    number[both[hit]] = place[hit]
    three = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0))
    return number[three] * n + ids[three + 2], of[three]


@dataclass
class Vocabulary:
    """The terms of a vectorizer, at most `limit` of them, and how often they are found; n: texts."""

    terms: list[str]
    df: np.ndarray
    n: int
    stop: Sequence[str]

    @property
    def idf(self) -> np.ndarray:
        return np.log((1.0 + self.n) / (1 + self.df)) + 1

    def _rows(self):
        """A function of texts (Arrow) that gives, for each, its terms' numbers and weights of length 1."""
        terms, idf = self.terms, self.idf
        known = pa.array(sorted({w for t in terms for w in t.split(" ")}), pa.string())
        at = {w: i for i, w in enumerate(known.to_pylist())}
        n, split = len(known), [t.split(" ") for t in terms]
        pair = np.unique(np.array([at[a] * n + at[b] for t in split for a, b in zip(t, t[1:])], np.int64))
        number = {tuple(s): i for i, s in enumerate(split)}
        one = np.full(n, -1)
        two, three = np.full(len(pair), -1), {}
        for s, i in number.items():
            if len(s) == 1:
                one[at[s[0]]] = i
            elif len(s) == 2:
                two[np.searchsorted(pair, at[s[0]] * n + at[s[1]])] = i
            else:
                three[int(np.searchsorted(pair, at[s[0]] * n + at[s[1]])) * n + at[s[2]]] = i
        triple = np.array(sorted(three), np.int64)
        triple_i = np.array([three[c] for c in triple.tolist()], np.int64)
        stop = pa.array(list(self.stop), pa.string())

        def lookup(code: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.full(len(code), -1)
            place = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            return np.where(keys[place] == code, values[place], -1)

        def rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            words, of = _tokens(texts, stop)
            ids = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            found = [(np.where(ids >= 0, one[ids], -1) if n else ids, of)]
            code, doc = _grams(words, of, known, None)
            found.append((lookup(code, pair, two), doc))
            code, doc = _grams(words, of, known, pair)
            found.append((lookup(code, triple, triple_i), doc))
            i, doc = (np.concatenate(x) for x in zip(*found))
            doc, i, tf = _pairs(i[i >= 0], doc[i >= 0])
            w = (1 + np.log(tf)) * idf[i]
            first = np.searchsorted(doc, np.arange(len(texts) + 1))
            total = np.concatenate([[0], np.cumsum(w * w)])
            return first, i, w / np.sqrt(np.maximum(total[first[1:]] - total[first[:-1]], 1e-300))[doc]

        return rows

    def vectors(self, texts: DataFrame, key: str, of: Column) -> DataFrame:
        """key, i (numbers of its terms, ascending) and w of every text; both are empty for a text without a term. Nothing is exchanged."""
        make = self._rows()

        def run(batches):
            for b in _few(batches, "text"):
                first, i, w = make(b.column("text"))
                off = pa.array(first, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(off, pa.array(i, pa.int32())), pa.ListArray.from_arrays(off, pa.array(w, pa.float64()))], names=[key, "i", "w"])

        return texts.select(key, of.alias("text")).mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, i array<int>, w array<double>")

    def query(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The row of one string."""
        _, i, w = self._rows()(pa.array([text], pa.string()))
        return i, w


def vocabulary(texts: DataFrame, of: Column, limit: int = 30000, least_df: int = 1, most_df: float = 1.0, stop: Sequence[str] = fixed.SEARCH_STOP) -> Vocabulary:
    """The `limit` most frequent runs of 1 to 3 words that `least_df` texts have, and no more than a share `most_df` of them.

    Words are in lower case, without accents and stop words.  Of equally frequent terms the first in the alphabet stay.  A run
    is at most as frequent as its parts, so three passes suffice: words; pairs of words that are as frequent as the last word
    that could stay; triples of pairs that are as frequent as the last word or pair that could.  Only runs that can stay are
    ever counted or exchanged, and of these each task sends a sum for each.
    """
    spark, n = texts.sparkSession, texts.count()
    t = texts.select(of.alias("text"))
    most, words_to_leave = most_df * n, pa.array(list(stop), pa.string())

    def counted(codes, schema: str, name: str) -> DataFrame:
        def run(batches):
            for b in _few(batches, "text"):
                words, of_ = _tokens(b.column("text"), words_to_leave)
                value, tf, df = codes(words, of_)
                yield pa.RecordBatch.from_arrays([value, pa.array(tf), pa.array(df)], names=[name, "tf", "df"])

        sums = t.mapInArrow(run, f"{name} {schema}, tf long, df long").groupBy(name).agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        return sinks.scratch(sums.where(F.col("df") >= least_df))  # read twice: for the last that could stay, and for all as frequent

    def by_text(code: np.ndarray, of_: np.ndarray):
        own, tf = np.unique(code, return_counts=True)
        return own, tf, np.unique(_pairs(code, of_)[1], return_counts=True)[1]

    def single(words: pa.Array, of_: np.ndarray):
        d = words.dictionary_encode()
        own, tf, df = by_text(d.indices.to_numpy(zero_copy_only=False).astype(np.int64), of_)
        return d.dictionary.take(pa.array(own)), tf, df

    def frequent(sums: DataFrame, name: str, kept: list) -> tuple[list, list]:
        """The rows that are as frequent as the last that could stay, and the terms that could stay so far."""
        allowed = sums.where(F.col("df") <= most).orderBy(F.col("tf").desc(), name).limit(limit).collect()
        together = sorted([*kept, *((-r["tf"], None, r["df"]) for r in allowed)], key=lambda x: x[0])
        floor = -together[limit - 1][0] if len(together) >= limit else 1
        return sums.where(F.col("tf") >= floor).collect(), floor

    one, floor = frequent(counted(single, "string", "term"), "term", [])
    words = sorted(r["term"] for r in one)
    known, size = pa.array(words, pa.string()), max(1, len(words))
    kept = [(-r["tf"], r["term"], r["df"]) for r in one if r["df"] <= most]

    def double(w: pa.Array, of_: np.ndarray):
        own, tf, df = by_text(*_grams(w, of_, known, None))
        return pa.array(own), tf, df

    two, floor = frequent(counted(double, "long", "code"), "code", kept)
    pair = np.array(sorted(r["code"] for r in two), np.int64)
    spelt = lambda code: f"{words[code // size]} {words[code % size]}"
    kept += [(-r["tf"], spelt(r["code"]), r["df"]) for r in two if r["df"] <= most]

    def triple(w: pa.Array, of_: np.ndarray):
        own, tf, df = by_text(*_grams(w, of_, known, pair))
        return pa.array(own), tf, df

    three, _ = frequent(counted(triple, "long", "code"), "code", kept)
    kept += [(-r["tf"], f"{spelt(int(pair[r['code'] // size]))} {words[r['code'] % size]}", r["df"]) for r in three if r["df"] <= most]
    best = sorted(sorted(kept)[:limit], key=lambda x: x[1])
    return Vocabulary([x[1] for x in best], np.array([x[2] for x in best], np.float64), n, stop)


@dataclass
class Latent:
    """A vocabulary and the k first right singular vectors of its rows."""

    vocabulary: Vocabulary
    basis: np.ndarray  # terms x k, in 32 bits: bounded by the vocabulary's limit, whatever the number of texts

    def project(self, rows: DataFrame, key: str) -> DataFrame:
        """key (its fields, if it is a struct) and vector, of length 1, of rows (key, i, w)."""
        sent, kind = rows.sparkSession.sparkContext.broadcast(self.basis), rows.schema[key].dataType.simpleString()

        def run(batches):
            for b in _few(batches, "i"):
                y = _times(b.column("i"), b.column("w"), sent.value)
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
                k = y.shape[1]
                yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), pa.array(y.reshape(-1)))], names=[key, "vector"])

        out = rows.mapInArrow(run, f"{key} {kind}, vector array<double>")
        return out.select(f"{key}.*", "vector") if kind.startswith("struct") else out

    def query(self, text: str) -> list[float]:
        """A query's vector, of length 1; zeros without a known term."""
        i, w = self.vocabulary.query(text)
        v = w @ self.basis[i].astype(np.float64)
        norm = np.linalg.norm(v)
        return (v / norm if norm else v).tolist()


def _times(i: pa.Array, w: pa.Array, basis: np.ndarray) -> np.ndarray:
    """Rows times the basis."""
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(i).to_numpy(zero_copy_only=False))])
    ids, weights = i.flatten().to_numpy(), w.flatten().to_numpy()
    out = np.zeros((len(i), basis.shape[1]))
    for r in range(len(i)):
        out[r] = weights[at[r] : at[r + 1]] @ basis[ids[at[r] : at[r + 1]]]
    return out


def latent(rows: DataFrame, known: Vocabulary, k: int, steps: int = 5, seed: int = 42) -> Latent:
    """The first k right singular vectors of rows (i, w), by subspace iteration on k + 10 directions.

    A step multiplies the directions by the rows and by their transpose: each task sums up its rows' part and sends it in blocks
    of terms, which are added up by block, so no task adds the whole; the sums are made orthonormal by the Gram matrix of the
    blocks.  Rows should be a table: they are read once a step.  Tasks have TASK_ENTRIES entries at least.  As many
    directions as there are terms give the exact result.
    """
    m, part = len(known.terms), 100  # a group of `add` has a part of each task
    context = rows.sparkSession.sparkContext
    k = max(1, min(k, known.n - 1, m - 1))
    width = min(k + 10, m)
    if not m:
        return Latent(known, np.zeros((0, k), np.float32))
    entries = rows.agg(F.sum(F.size("i"))).first()[0] or 0
    few = rows.select("i", "w").coalesce(max(1, min(rows.rdd.getNumPartitions(), -(-entries // TASK_ENTRIES))))

    def times(basis: np.ndarray) -> np.ndarray:
        sent, shape = context.broadcast(basis.astype(np.float32)), basis.shape

        def run(batches):
            total = np.zeros(shape, np.float32)
            for b in _few(batches, "i"):
                y = _times(b.column("i"), b.column("w"), sent.value)
                at = pc.list_value_length(b.column("i")).to_numpy(zero_copy_only=False)
                ids, weights, end = b.column("i").flatten().to_numpy(), b.column("w").flatten().to_numpy(), np.concatenate([[0], np.cumsum(at)])
                for r in range(len(at)):  # a row's terms are distinct
                    own = slice(end[r], end[r + 1])
                    total[ids[own]] += np.outer(weights[own], y[r])
            starts = range(0, m, part)
            yield pa.RecordBatch.from_pydict({"part": list(starts), "z": [total[a : a + part].tobytes() for a in starts]}, schema=pa.schema([("part", pa.int32()), ("z", pa.binary())]))

        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(z.as_buffer(), np.float32).astype(np.float64) for z in t.column("z"))
            return pa.table({"part": t.column("part")[:1], "z": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        out = np.zeros(shape)
        for r in few.mapInArrow(run, "part int, z binary").groupBy("part").applyInArrow(add, "part int, z binary").toLocalIterator():
            out[r["part"] : r["part"] + part] = np.frombuffer(r["z"], np.float32).reshape(-1, shape[1])
        sent.destroy()
        return out

    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(m, width)))[0]
    for _ in range(steps if width < m else 0):
        basis = np.linalg.qr(times(basis))[0]
    values, directions = np.linalg.eigh(basis.T @ times(basis))
    return Latent(known, (basis @ directions[:, np.argsort(-values)[:k]]).astype(np.float32))
