import random
import re

import pytest

from lectern.llm import components as graph
from lectern.llm import jaccard, shared
from lectern.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def families(seed=4):
    r = random.Random(seed)
    out = []
    for _ in range(60):
        n = r.choice([3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 18, 22, 30, 45, 70, 120, 300])
        base = ["w%d" % r.randint(0, 3000) for _ in range(n)]
        for _ in range(r.randint(1, 7)):
            w = list(base)
            for _ in range(r.randint(0, 2 + n // 60)):
                i = r.randrange(len(w))
                w[i : i + r.randint(0, 1)] = ["x%d" % r.randint(0, 50)] * r.randint(0, 2)
                w = w or ["y"]
            out.append(" ".join(w))
            if r.random() < 0.3:
                base = w
    hub = ["h%d" % i for i in range(60)]
    for i in range(90):  # a chain about a hub: many near copies, few of them links
        w = list(hub)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(60)] = "z%d" % r.randint(0, 9)
        out.append(" ".join(w))
    return out


def copies(seed=9):
    """A large group of near copies of one text, some of them far from it, and short texts with few distinct words."""
    r = random.Random(seed)
    base = ["c%d" % i for i in range(45)]
    out = []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([1, 1, 2, 3])):
            w[r.randrange(45)] = "v%d" % r.randint(0, 400)
        out.append(" ".join(w))
    return out + [" ".join(r.choice("pqrs") for _ in range(r.randint(1, 14))) for _ in range(150)]


@pytest.mark.parametrize("k,num,den,small", [(4, 85, 100, False), (5, 80, 100, False), (1, 9, 10, False), (5, 80, 100, True), (2, 8, 10, True)])
def test_components(spark, docs, rows, k, num, den, small, monkeypatch):
    """small: ranges, tiles and tasks so small that signatures are split twice, hot ranges are dealt out and buckets have several levels of tiles."""
    monkeypatch.setattr(jaccard, "TILE", 16)
    if small:
        for name, value in {"SMALL_TILE": 4, "MEMBERS_A_TASK": 500, "MEMBERS_A_SPOT": 60, "SET_BYTES_A_TASK": 20_000, "RANGE_KEYS": 128, "MOST_BITS": 3}.items():
            monkeypatch.setattr(jaccard, name, value)
        monkeypatch.setattr(graph, "EDGES_A_TASK", 100)
        monkeypatch.setattr(shared, "BROADCAST_ROWS", 10)
    more = [(10_000 + i, t) for i, t in enumerate(families() + copies())]
    every = [r[:2] for r in rows] + more
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string").repartition(2))
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(both, k, num, den).collect()), key=str)
    assert got == brute(every, k, num, den)


def test_empty(no_docs):
    assert jaccard.jaccard_components(no_docs).count() == 0


def test_chain(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 2000), (3000, 1000), (5, 5)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 2000: 1000, 3000: 1000}


def test_bands_cover():
    b = jaccard.Bands(85, 100, 5000)
    for low, high, most, m, d in zip(b.low, b.high[:-1], b.most, b.segments, b.double):
        assert most == high * 15 // 85 and (most == 0 or (m + d >= most + 1 and d <= m))


def test_one_of_each(spark, docs, rows):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {(x.doc_id, x.component_id) for x in jaccard.jaccard_components(docs).collect() if x.doc_id is not None}
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted({d for d, c in want if d == c})
    assert kept.where("doc_id IS NULL").count() == 2
