import random

import numpy as np
import pyarrow as pa

from lectern.llm import decontaminate as dc


def make(seed=7):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefé") for _ in range(r.randint(1, 6))) for _ in range(600)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, f"{prose(r.randint(8, 30))}. {prose(r.randint(4, 12))}. Answer: {prose(r.randint(1, 9))}" if i % 2 else f"{prose(r.randint(8, 40))}. {prose(r.randint(3, 12))}.") for i in range(60)]
    docs, want = [], set()
    for i in range(200):
        text = prose(r.choice([0, 20, 150, 700]))
        if i % 3 == 0:
            item = r.choice(items)
            text = text + " " + item[1].upper().replace(".", " !") + "\n" + prose(r.choice([0, 9, 300]))
            want.add((i, item[0]))
        elif i % 3 == 1:  # the question alone
            text += " " + dc.question_answer(r.choice(items)[1])[0]
        docs.append((i, text))
    return items, docs, want


def test_finds_all_leaks_and_no_more(spark):
    items, docs, want = make()
    docs += [(None, items[0][1]), (900, None), (901, ""), (902, items[1][1]), (902, items[1][1])]
    bench = [*items, (None, "x y z. q r s t."), (61, None), (62, " .. "), (5, items[5][1])]
    d = spark.createDataFrame([(*x, 1, "s") for x in docs], "doc_id long, text string, item_id long, score string")
    b = spark.createDataFrame([(*x, 3) for x in bench], "item_id long, text string, doc_id int")
    got = dc.contaminated(d, b).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want | {(None, 0), (902, 1)}
    assert sum(x.doc_id == 902 for x in got) == 2
    parts = dc.contaminated(d, b, items_a_shard=7)
    assert {(x.doc_id, x.item_id) for x in parts.collect()} == {(x.doc_id, x.item_id) for x in got}
    left = dc.decontaminated(d, b).collect()
    assert sorted(str(x.doc_id) for x in left) == sorted(str(x[0]) for x in docs if x[0] not in {p for p, _ in want} | {None, 902})


def test_shards_give_equal_rows(spark):
    items, docs, _ = make()
    r = random.Random(1)
    docs += [(1000 + i, " ".join(w if r.random() > 0.25 else "zzz" for w in t.split())) for i, (_, t) in enumerate(items)]  # edited copies, near the threshold
    items.append((60, "a the of. Answer: a"))  # alone in its shard
    docs.append((2000, "x a the of y a"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plain = lambda rows: sorted((x.doc_id, x.item_id, x.score, x.question_overlap, x.answer_overlap, x.passage_start) for x in rows.collect())
    one, kept = plain(dc.contaminated(d, b, 0.6, 0.2)), sorted(x.doc_id for x in dc.decontaminated(d, b, 0.6, 0.2).collect())
    assert sum(x[0] >= 1000 for x in one) > 20
    for n in (60, 7, 1):
        assert plain(dc.contaminated(d, b, 0.6, 0.2, n)) == one
    assert sorted(x.doc_id for x in dc.decontaminated(d, b, 0.6, 0.2, 7).collect()) == kept


def test_search_is_exact():
    items, docs, _ = make(3)
    for n in (60, 9, 1):
        index = dc.Index(items[:n])
        data, off = dc.lowered(pa.array([t for _, t in docs]))
        h, first = dc.terms(data, off)
        r = np.random.default_rng(0)
        query = [np.unique(r.integers(0, len(index.terms), r.integers(1, 60))) for _ in range(50)]
        p = np.repeat(np.arange(50), [len(q) for q in query])
        full = np.zeros((len(index.terms), index.blocks, dc.BLOCK), np.float32)
        full[index.key // index.blocks, index.block] = index.impact
        full = full.reshape(len(index.terms), -1)[:, : len(items[:n])]
        for threshold in (0.05, 0.2, 0.5):
            got = {(int(a), int(b)) for a, b, _ in zip(*index.search(p, np.concatenate(query), threshold))}
            scores = np.array([full[q].sum(0) for q in query])
            sure = {tuple(x) for x in np.argwhere(scores >= threshold).tolist()}
            assert sure <= got and all(scores[x] >= threshold - 2e-4 for x in got)
        assert np.allclose(full.sum(0), 1, atol=1e-5)  # each item scores 1 against itself


def test_search_is_near_linear_in_items():
    """20 000 items: the same rows as exhaustive scores, and no more than some six times the time of 5000."""
    import time

    r = random.Random(5)
    common, rare = [f"w{i}" for i in range(150)], [f"r{i}" for i in range(60_000)]
    prose = lambda n: " ".join(r.choice(common) if r.random() < 0.6 else r.choice(rare) for _ in range(n))
    items = [(i, prose(r.randint(5, 60))) for i in range(20_000)]
    docs = [prose(400) for _ in range(60)] + [prose(50) + " " + items[i][1] + " " + prose(50) for i in range(0, 20_000, 500)]
    data, off = dc.lowered(pa.array(docs))
    h, first = dc.terms(data, off)
    took = []
    for n in (5_000, 20_000):
        index = dc.Index(items[:n])
        began = time.process_time()
        got = {(d, int(index.ids[i])) for d, i, *_ in dc.search_documents(index, h, first, 0.6, 0.5)}
        took.append(time.process_time() - began)
        assert {(60 + k, i) for k, i in enumerate(range(0, n, 500))} <= got
        exact = {int(index.ids[j]): x for j, x in enumerate(index.exact)}
        own = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
        assert all(exact[i][1][np.isin(exact[i][0], own[d])].sum() >= 0.6 - 1e-6 for d, i in got)
    assert took[1] < 8 * took[0] + 2 and took[1] < 60, took


def test_empty(spark, no_docs, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three. four five.")], "item_id long, text string")
    assert dc.contaminated(no_docs, some).count() == 0 and dc.contaminated(docs, none).count() == 0
    assert dc.decontaminated(docs, none).count() == docs.count() and dc.decontaminated(docs, some).count() == docs.count()
