import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def buckets(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target):
    raw, aim = Counter(), Counter()
    for _, t in rows:
        raw.update(buckets(t))
    for t in target:
        aim.update(buckets(t))
    s, t = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000)))) for b in raw}
    out, able = [], []
    for i, (d, x) in enumerate(rows):
        b = buckets(x)
        weight = sum(gain[k] for k in b)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words(x)) >= 20:
                able.append((-score, d, i))
        out.append([d, len(b), weight, score, None])
    for rank, (_, _, i) in enumerate(sorted(able)[: 5 * len(able) // 100], 1):
        out[i][4] = rank
    return Counter(map(tuple, out))


def table():
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdeéßXYZ019") for _ in range(r.choice([1, 3, 5, 9]))) for _ in range(200)] + ["w" * 63, "w" * 64, "w" * 65, "é" * 200]
    rows = [(i, " ".join(r.choice(vocabulary) + r.choice(["", ",", "\n"]) for _ in range(r.choice([0, 1, 2, 3, 19, 20, 40, 90])))) for i in range(-20, 700)]
    rows += [(None, None), (None, rows[50][1] + " x" * 30), (9000, None), (9001, ""), (9002, "!?"), (9003, "one"), (9004, "don't STOP\x7fhere\x00now"), (9005, "日本 語" * 30)]
    rows += [rows[40], rows[40], rows[41]] + [(9100, "the very same row " * 9)] * 40
    return rows + [(9006, " ".join(r.choice(vocabulary) for _ in range(9000)))]


TARGET = ["one two three don't stop", None, "", "aé bß c, d e a b"]


@pytest.mark.parametrize("rows_a_range", [1 << 20, 7])
def test_resample(spark, rows_a_range, monkeypatch):
    monkeypatch.setattr(resample, "RANGE_ROWS", rows_a_range)
    rows = table()
    df = spark.createDataFrame([(d, t, 1, 2, 3, 4) for d, t in rows], "doc_id long, text string, score int, at int, rank int, weight int").repartition(6)
    got = resample.resample(df, spark.createDataFrame([(t,) for t in TARGET], "text string")).collect()
    assert Counter((x.doc_id, x.n_features, x.weight, x.score, x["rank"]) for x in got) == brute(rows, TARGET)


def test_conftest_rows(spark, docs, rows, no_docs):
    aim = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resample.resample(docs, aim).collect()
    assert Counter((x.doc_id, x.n_features, x.weight, x.score, x["rank"]) for x in got) == brute([(x[0], x[1]) for x in rows], TARGET)
    assert resample.resample(no_docs, aim).count() == 0
    assert resample.resample(docs, no_docs).count() == len(rows)


@pytest.mark.parametrize("limit", [1, 40, 300, 5000])
def test_parts_have_each_feature_once(limit):
    texts = [t or "" for _, t in table()[-60:]] + ["z" * 700 + " y " + "z" * 900 + " x"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    got = [Counter() for _ in texts]
    for i, starts, ends, first, carried, low in resample.parts(np.frombuffer(b"".join(raw), np.uint8), off, limit):
        for last, bucket in resample.features(low, starts, ends, first, carried):
            for d, b in zip((np.searchsorted(first, last, "right") - 1).tolist(), bucket.tolist()):
                got[i + d][b] += 1
    assert got == [Counter(buckets(t)) for t in texts]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_tournament(k):
    r = random.Random(k)
    runs = [sorted(r.choices(range(50), k=r.randint(0, 30))) for _ in range(k)]
    assert list(resample.Tournament(runs)) == list(heapq.merge(*runs))
    read = [iter(x) for x in runs]
    it = iter(resample.Tournament(read))
    want = list(heapq.merge(*runs))[:5]
    assert [next(it) for _ in want] == want
    assert k < 3 or sum(len(list(x)) for x in read) > 0 or sum(map(len, runs)) < 5 + 2 * k  # the rest isn't read
