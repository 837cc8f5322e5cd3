import random

import pytest
from test_decontaminate import make
from test_jaccard import families

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_ int"
SYLLABLES = {"en": "the th er ing and of wh ly", "de": "der sch ung ein keit ich ver"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    items, leaks, want = make()
    top = str(tmp_path_factory.mktemp("in"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    r = random.Random(0)
    rows = [(i, t) for i, t in enumerate(families())] + [(10_000 + i, t) for i, t in leaks]
    for i in range(200):
        rows.append((20_000 + i, " ".join("".join(r.choice(SYLLABLES["en" if i % 2 else "de"].split()) for _ in range(r.randint(1, 4))) for _ in range(60))))
    rows += [(30_000, "12 34 5"), (30_001, None), (30_002, ""), (20_005, rows[-195][1]), (None, rows[3][1])]
    rows.append((30_003, "Москва является столицей страны и крупнейшим по численности населения городом"))

    def lang(d):
        """Families and leaks have words of their own, so they are languages of their own."""
        return None if d is None or d >= 30_000 else ("en" if d % 2 else "de") if d >= 20_000 else "xx" if d < 10_000 else "yy"

    full = [(d, t, lang(d), "s", len(t or ""), 0.5, 1) for d, t in rows]
    spark.createDataFrame(full, SCHEMA).repartition(2).write.parquet(f"{top}/documents.parquet")
    return top, full, want


def leaks_of(docs, items, threshold=0.6, overlap=0.5):
    """doc_ids with an item, by every passage against every item: its share of the item's BM25 mass, and of question and answer runs."""
    import math
    import re

    from lectern.llm.decontaminate import question_answer

    terms = lambda t: "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in (t or "").lower()).split()
    runs = lambda w, n=3: {tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)} if w else set()
    own = [terms(t) for _, t in items]
    df = {}
    for w in own:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    n, mean, step = len(items), sum(map(len, own)) / len(items), max(map(len, own))
    mass = []
    for w in own:
        tf = {t: w.count(t) for t in set(w)}
        raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, k in tf.items()}
        mass.append({t: v / sum(raw.values()) for t, v in raw.items()})
    parts = [[runs(terms(x)) for x in question_answer(t)] for _, t in items]
    out = set()
    for d, t in docs:
        w = terms(t)
        for s in range(0, max(1, len(w) - step), step):
            here = w[s : s + 2 * step]
            have, all_runs = set(here), {k: runs(here, k) for k in (1, 2, 3)}
            for m, qa in zip(mass, parts):
                if sum(v for x, v in m.items() if x in have) >= threshold and all(max(len(p & r) / len(p) for r in all_runs.values()) >= overlap for p in qa):
                    out.add(d)
    return out


def test_stages(spark, folder):
    top, full, want = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    for name, f in cp.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = f(spark, docs, top)
        assert docs.columns == list(cp.COLUMNS)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and after
        if name == "language_id":
            assert not {30_000, 30_001, 30_002, 30_003} & set(after)
            assert all(d in after for d in before if d is not None and 20_000 <= d < 30_000)
        if name == "near_duplicates":
            from test_jaccard import brute

            groups = brute([(d, r.text) for d, r in before.items() if d is not None], 5, 80, 100)
            assert {d for d in after if d is not None} == {d for d, _, c in groups if d == c}
        if name == "decontamination":
            gone = set(before) - set(after)
            assert gone == leaks_of([(d, r.text) for d, r in before.items()], make()[0]) and len(gone) > 20
            assert gone <= {10_000 + d for d, _ in want}
        if name == "substring_dedup":
            from test_dedup import brute_words

            removed = {d: n for (d, _, n, _), _ in brute_words([(d, r.text) for d, r in before.items()], 13).items()}
            assert all(after[d].text == before[d].text for d in after if not removed[d])
        docs = spark.createDataFrame(list(after.values()), docs.schema)


def test_run(spark, folder):
    out = cp.run(spark, folder[0])
    assert out.count() > 100 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_empty(spark, folder, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for _, f in cp.STAGES:
        docs = f(spark, docs, folder[0])
        assert docs.count() == 0
