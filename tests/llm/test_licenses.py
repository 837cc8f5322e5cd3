import math
import re
import textwrap
from collections import Counter

from pyspark.sql import functions as F

from lectern.llm import licenses

ROWS = [
    (1, "a/b/one.py", "x = 1\nLicensed under the Apache License, Version 2.0.\n"),
    (2, "a/b/two.py", "y = 2"),
    (3, "a/LICENSE", "Released under the MIT License.\n\nsome more words"),
    (4, "a/c/d/e.py", "no licence here"),
    (5, "b/f.py", "the general public is licensed to print"),
    (6, "COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (7, "a/b/licence.txt", "LICENSED UNDER CC BY-NC 4.0!"),
    (8, None, "Released under the MIT License."),
    (9, "z/empty", None),
    (10, "a/b/long.py", "word " * 5000 + "\nThis library is licensed under the GNU Lesser General Public License, version 3"),
    (11, "q/g.py", ""),
    (11, "q/g.py", ""),
    (None, "q/h.py", "Released under the MIT License."),
]


def scan(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "clash", 1.0, 3) for r in rows], "doc_id long, path string, text string, license string, similarity double, n_lines int")
    return {r.doc_id: r for r in licenses.scan_licenses(docs, F.col("path"), **kw).collect()}


def test_scan_and_inherit(spark):
    got = scan(spark, ROWS)
    assert set(got) == {r[0] for r in ROWS}
    want = {1: ("Apache-2.0", "own", "a/b/one.py"), 2: ("CC-BY-NC-4.0", "inherited", "a/b/licence.txt"), 3: ("MIT", "own", "a/LICENSE"), 4: ("MIT", "inherited", "a/LICENSE"), 5: ("GPL-3.0", "inherited", "COPYING"), 6: ("GPL-3.0", "own", "COPYING"), 7: ("CC-BY-NC-4.0", "own", "a/b/licence.txt"), 8: ("MIT", "own", None), 9: ("GPL-3.0", "inherited", "COPYING"), 10: ("LGPL-3.0", "own", "a/b/long.py"), None: ("MIT", "own", "q/h.py")}
    for d, w in want.items():
        assert (got[d].license, got[d].how, got[d].from_path) == w, (d, got[d])
    assert got[11].license == "MIT" and got[11].from_path == "q/h.py"  # a file that is little else stands for its directory


def test_scores_against_brute_force(spark):
    got = scan(spark, ROWS, threshold=0.3)
    vectors = [(n, licenses.terms(t)) for n, t in licenses.TEMPLATES]
    vocabulary = {t for _, v in vectors for t in v}
    df = Counter(t for _, _, x in ROWS for t in set(licenses.terms(x or "")) & vocabulary)
    n = len(ROWS)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocabulary}
    other = math.log((1 + n) / (1 + n / 10)) + 1

    def vec(c):
        return {t: k * idf.get(t, other) for t, k in c.items()}

    def cos(a, b):
        return sum(w * b.get(t, 0) for t, w in a.items()) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))

    for d, _, text in ROWS:
        scores = [cos(vec(licenses.terms(x)), vec(v)) for x in (text or "").split("\n") if licenses.terms(x) for _, v in vectors]
        best = max(scores, default=0)
        if best >= 0.3:
            assert got[d].how == "own" and abs(got[d].similarity - best) < 1e-6, d
        else:
            assert got[d].how != "own"


def test_wrapped_notices_and_whole_texts(spark):
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met"
    apache = "// Licensed under the Apache License,\n// Version 2.0\n// (the License); you may not use this file\n// except in compliance\n// with the License."
    rows = [(i, f"code/{i}.c", "plain words and nothing else here " * 3) for i in range(40)]
    rows += [(100, "n/bsd.py", "import os\n\n" + bsd + "\n\n" + "x = y + z\n" * 200), (101, "n/apache.c", "int x;\n" + apache + "\nint y;\n" * 50), (102, "g/7", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n" + "other words of it " * 40), (103, "g/8", "no notice")]
    mit = " ".join(t for t, n in licenses.TEXTS["MIT"].items() for _ in range(n))
    rows += [(104, "m/9", textwrap.fill(mit, 60)), (105, "m/10", "no notice")]
    got = scan(spark, rows)
    assert [(got[d].license, got[d].how) for d in range(100, 106)] == [("BSD-3-Clause", "own"), ("Apache-2.0", "own"), ("GPL-3.0", "own"), (None, None), ("MIT", "own"), ("MIT", "inherited")]
    assert got[100].n_lines == 3 and got[105].from_path == "m/9" and all(got[d].how is None for d in range(40))


def test_null_ids_are_apart(spark):
    rows = [(None, "a/x", "Released under the MIT License."), (None, "b/y", "Licensed under the Apache License, Version 2.0."), (None, None, "words"), (None, "c/z", None), (1, "b/w", "words")]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.path: (r.doc_id, r.license, r.how) for r in licenses.scan_licenses(docs, F.col("path")).collect()}
    assert got == {"a/x": (None, "MIT", "own"), "b/y": (None, "Apache-2.0", "own"), None: (None, None, None), "c/z": (None, None, None), "b/w": (1, "Apache-2.0", "inherited")}


def test_empty(spark, no_docs, docs):
    assert licenses.scan_licenses(no_docs, F.col("source")).count() == 0
    assert licenses.scan_licenses(docs, F.concat_ws("/", "source", "doc_id")).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_no_python():
    source = open(licenses.__file__).read()
    assert not re.search(r"pandas|arrow|udf|mapIn|applyIn|\brdd\b", source, re.I)
