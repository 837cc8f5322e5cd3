import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from lectern.llm import blocks, substrings, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_words(rows, k):
    first = {}
    parsed = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in parsed:
        if d is not None:
            for i in range(len(w) - k + 1):
                key = tuple(w[i : i + k])
                first[key] = min(first.get(key, d), d)
    out = Counter()
    for d, w in parsed:
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - k + 1):
                if first[tuple(w[i : i + k])] < d:
                    gone[i : i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def brute_parse(rows, k):
    """The greedy factors (start, length) of each text, by doc_id and text: as far as the first places of its windows go on."""
    first = {}
    parsed = sorted((d, t or "") for d, t in rows if d is not None)
    for n, (d, t) in enumerate(parsed):
        w = WORD.findall(t)
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), (n, i, d))
    out = Counter()
    for d, t in parsed:
        w, i, factors = WORD.findall(t), 0, []
        at = [first[tuple(w[i : i + k])] for i in range(len(w) - k + 1)]
        while i < len(at):
            if at[i][2] >= d:
                i += 1
                continue
            n = 1
            while i + n < len(at) and at[i + n][:2] == (at[i][0], at[i][1] + n):
                n += 1
            factors.append((i, n + k - 1))
            i += n + k - 1
        out[d, len(w), tuple(factors)] += 1
    return out


def brute_bytes(rows, size):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + size] for _, t in texts for i in range(len(t) - size + 1))
    out = Counter()
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


@pytest.fixture(params=[1 << 30, 4000])
def block_bytes(request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", request.param)
    monkeypatch.setattr(blocks, "RANGE_KEYS", max(300, request.param // 16))
    monkeypatch.setattr(blocks, "MOST_CUTS", 4)


@pytest.mark.parametrize("most_bits", [11, 2])
def test_substrings(docs, rows, block_bytes, most_bits, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_BITS", most_bits)
    got = substrings.dedup_substrings(docs, 13, with_text=True).collect()
    want = brute_words([r[:2] for r in rows], 13)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(r.n_removed for r in got) > 5000
    for r in got:
        kept = " ".join(WORD.findall(r.text))
        assert hashlib.sha256(kept.encode()).hexdigest() == r.kept_sha256
    factors = Counter((r.doc_id, r.n_words, tuple((f.start, f.length) for f in r.factors)) for r in got if r.doc_id is not None)
    assert factors == brute_parse([r[:2] for r in rows], 13)


def test_substring_factors(spark):
    """A passage whose parts other documents had first, and windows across the ends of factors."""
    w = ["w%d" % i for i in range(60)]
    rows = list(enumerate([" ".join(w[:30]), " ".join(["a"] + w[18:45] + ["b"]), " ".join(w), " ".join(["c"] + w + ["d"]), " ".join(w[:14] + ["e"] + w[1:14])]))
    got = {r.doc_id: r for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 13).collect()}
    assert [tuple(f) for f in got[2].factors] == [(0, 30, 0, 0), (30, 15, 0, 30 + 1 + 12)]
    assert [(f.start, f.length) for f in got[3].factors] == [(1, 30), (31, 15), (46, 15)]
    assert got[3].n_removed == 60 and got[2].n_removed == 45 and got[4].n_removed == 27


def test_substrings_empty(no_docs):
    assert substrings.dedup_substrings(no_docs).count() == 0


@pytest.mark.parametrize("most", [4000, 1])
def test_bytes(spark, docs, rows, block_bytes, most):
    got = suffixes.dedup_bytes(docs, 200, most, with_text=True).collect()
    want = brute_bytes([r[:2] for r in rows], 200)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(r.n_removed for r in got) > 50000
    for r in got:
        assert len(r.spans) == r.n_spans and sum(s.length for s in r.spans) == r.n_removed == r.n_bytes - len(r.rest)


def test_bytes_periodic(spark, block_bytes):
    texts = ["a" * 1000, "b" * 200, "b" * 199, "ab" * 150, "x" + "ab" * 101, "abc" * 400 + "d" * 300, "q" * 201]
    rows = list(enumerate(texts))
    got = suffixes.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 200, 3).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows, 200)


def test_bytes_empty(no_docs):
    assert suffixes.dedup_bytes(no_docs).count() == 0
