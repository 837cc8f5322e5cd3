import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm import lines

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, points=20, least=3):
    holders = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= points:
                holders[k].append(d if d is not None else lines.NO_ID)
    out = Counter()
    for d, t in rows:
        own, me = (t or "").split("\n"), d if d is not None else lines.NO_ID
        kept = [x for x in own if not (len(holders[key(x)]) >= least and me < max(holders[key(x)]))]
        out[d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def table():
    r = random.Random(3)
    shared = ["Home | About | Contact | Imprint", "  ALL rights reserved, of course  ", "exactly twenty chars", "nineteen characters", "ééééééééééééééééééé1", "\tanother line that is repeated\x0b", "x" * 500]
    out = [(None, None), (5, ""), (6, "\n"), (7, "\n\n\n"), (8, shared[0]), (9, shared[0].upper()), (10, f"{shared[0]}\n{shared[0]} \n"), (11, "no break here\x85at all in this line ")]
    for i in range(60):
        own = [r.choice(shared) if r.random() < 0.4 else f"line {r.randint(0, 40)} of document, long enough" for _ in range(r.randint(1, 30))]
        out.append((100 + 7 * i, r.choice(["\n", "\r\n"]).join(own) + r.choice(["", "\n"])))
    out += [out[20], out[20], out[21], (None, out[22][1]), (None, shared[1])]
    out.append((4000, "\n".join(f"long document, line {i % 700} of it all" for i in range(5000))))
    out += [(-5, out[-1][1] + "\n" + shared[0]), (3999, out[-1][1])]
    return out


@pytest.mark.parametrize("batches", [4, 7, 1])
def test_lines(spark, batches):
    rows = table()
    df = spark.createDataFrame([(d, t, 1, 2, 3, 4, 5) for d, t in rows], "doc_id long, text string, row int, h int, batch int, n int, gone int").repartition(5)
    got = lines.dedup_lines(df, batches=batches, with_text=True).collect()
    assert Counter((x.doc_id, x.n_lines, x.n_dropped, x.kept_sha256) for x in got) == brute(rows)
    assert all(hashlib.sha256(x.text.encode()).hexdigest() == x.kept_sha256 for x in got)


def test_conftest_rows(docs, rows):
    got = lines.dedup_lines(docs, 5, 2).collect()
    assert Counter((x.doc_id, x.n_lines, x.n_dropped, x.kept_sha256) for x in got) == brute([(x[0], x[1]) for x in rows], 5, 2)


def test_empty(no_docs):
    assert lines.dedup_lines(no_docs).count() == 0


def test_runs_are_levelled_and_exchange_nothing_twice(spark):
    runs = lines.LineRuns(spark, 3, fan=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(100 - i, k, 0) for k in range(10 * i, 10 * i + 20)] + [(100 - i, -1, 0)], "doc_id long, h long, other int"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    new = spark.range(50).selectExpr("id AS h", "CAST(id % 3 AS INT) AS other").groupBy("h", "other").count()
    plan = new.join(spark.table(runs.levels[2][0]).hint("merge"), ["h", "other"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    got = {(x.h, x.top) for x in runs.settled().collect()}
    assert got == {(-1, 100)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lectern_run_")]


@pytest.mark.parametrize("limit", [1, 8, 100])
def test_parts_are_whole_lines(limit):
    texts = [b"", b"abc", b"a\nbcdefghijk\n", b"\n\n", b"x" * 30, b"1\n2\n" + b"3" * 40 + b"\n4"]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = defaultdict(list)
    for i, part, at in lines.parts(np.frombuffer(b"".join(texts), np.uint8), off, limit):
        starts, ends, first = lines.line_spans(part, at)
        for d in range(len(at) - 1):
            got[i + d] += [part[a:b].tobytes() for a, b in zip(starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]])]
    assert [got[i] for i in range(len(texts))] == [t.split(b"\n") for t in texts]


def test_spans():
    data = np.frombuffer(b"a\nb\n\nc", np.uint8)
    starts, ends, first = lines.line_spans(data, np.array([0, 0, 2, 4, 4, 6]))
    assert first.tolist() == [0, 1, 3, 5, 6, 8]
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [b"", b"a", b"", b"b", b"", b"", b"", b"c"]
