"""What grows with the tables is bounded, and has the results of plain loops."""

from collections import Counter

from pyspark.sql import functions as F

from lectern.functions import text


def test_index_keeps_tokens_and_counts_runs_in_their_chunks(spark, tmp_path):
    """A row of postings for each distinct token of a chunk, none for its runs, which are counted where they are asked for."""
    from lectern.operators import index

    bodies = {f"https://own.org/p/{i}": "# One\n\n" + " ".join(f"plate{j % (i + 2)} reader" for j in range(40)) for i in range(5)}
    a = spark.createDataFrame([(i, u, "T", b, u, "full", None) for i, (u, b) in enumerate(bodies.items())], "id long, canonical_url string, title string, body string, content_hash string, content_status string, published_date string")
    path = str(tmp_path / "index")
    assert index.build(a, path)
    made = index.Index(spark, path)
    tokens = {(r.canonical_url, r.chunk): list(r.tokens) for r in made.chunks().collect()}
    bag = lambda df: {(r.term, r.canonical_url, r.chunk): (r.tf, r.dl) for r in df.collect()}
    assert bag(made.served("postings")) == {(t, *k): (n, len(x)) for k, x in tokens.items() for t, n in Counter(x).items()}
    asked = ["plate1 reader", "reader plate0 reader", "plate0", "plate1 plate2"]
    runs = {(t, *k): (n, len(x)) for k, x in tokens.items() for t in asked if (n := sum(x[i : i + len(t.split())] == t.split() for i in range(len(x))))}
    assert bag(made.postings(asked)) == runs and len({t for t, *_ in runs}) == 3


def test_counted_tokens(spark):
    lists = [["b", "a", "b"], [], None, ["x"], ["é", "z", "é", "a", "a", "a"]]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, t array<string>").select("i", text.counted(F.col("t")).alias("c")).orderBy("i").collect()
    assert [[tuple(y) for y in r.c or []] for r in got] == [sorted(Counter(x or []).items()) for x in lists]


def test_concepts_count_only_phrases_that_can_be_one(spark):
    """Phrases of tokens that too few seeds have, of junk alone, or of three tokens without infrastructure or a digit aren't counted."""
    from lectern.functions import fixed
    from lectern.operators import index

    a, b = fixed.INFRASTRUCTURE_TERMS[:2]
    junk = [*fixed.GENERIC_TERMS][:1]
    tokens = ["plain", "words", a, b, "rare", "words", "memo12", "plain", *junk, *junk]
    able = [t for t in tokens if t != "rare"]
    runs = [tokens[i : i + k] for i in range(len(tokens)) for k in (2, 3) if i + k <= len(tokens)]
    want = [" ".join(r) for r in runs if "rare" not in r and not set(r) <= set(junk) and (len(r) == 2 or sum(w in (a, b) for w in r) >= 2 or any(c.isdigit() for c in " ".join(r)))]
    got = spark.createDataFrame([(tokens,), ([],), (["plain"],)], "t array<string>").select(index._concept_runs(F.col("t"), able, junk).alias("r")).collect()
    assert sorted(got[0].r) == sorted(want) and got[1].r == got[2].r == []


def test_terms_are_counted_in_their_texts(spark):
    """Nothing is exchanged for postings; weights exchange a text's terms by term and by text, once each."""
    import math

    from lectern.functions import search

    texts = {1: ["a", "b", "a"], 2: ["b"], 3: [], 4: ["c", "a", "b", "b", "b"]}
    posted = search.postings(spark.createDataFrame(list(texts.items()), "k int, t array<string>"), "k", F.col("t"))
    assert "Exchange" not in posted._jdf.queryExecution().executedPlan().toString()
    df = Counter(t for x in texts.values() for t in set(x))
    w = {(k, t): (1 + math.log(n)) * (math.log(5 / (1 + df[t])) + 1) for k, x in texts.items() for t, n in Counter(x).items()}
    norm = {k: math.sqrt(sum(v * v for (i, _), v in w.items() if i == k)) for k in texts}
    got = {(r.k, r.term): r.weight for r in search.tfidf(posted, "k", 4).collect()}
    assert set(got) == set(w) and all(abs(got[x] - w[x] / norm[x[0]]) < 1e-12 for x in w)


def test_gold_titles_meet_rows_without_exploding_them(spark):
    """Rows pass the gold titles as they are; no row is made for each word of a title."""
    import re

    from lectern.operators import similarity

    key = lambda s: " ".join(re.findall("[a-z0-9]+", re.sub("['’]s", "", (s or "").lower())))
    gold = ["The Record of the Harbor Police", "Tides", "one two three four five six", "a b", "", None, "x y z"]
    rows = [None, "", "harbor police record", "low tides", "tide", "six five four", "six five", "of the harbor", "z  y x", "Police's the record of harbor", "five five five one"]
    found = similarity.gold_titles(spark.createDataFrame(list(enumerate(rows)), "row_id long, title string"), spark.createDataFrame([(g,) for g in gold], "title string"))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    g = {key(x) for x in gold} - {""}
    hit = lambda t: any(x in t or t in x or (n := len(set(x.split()) & set(t.split()))) >= 3 and 2 * n >= len(set(x.split())) for x in g)
    assert {r.row_id: r.gold for r in found.collect()} == {i: hit(key(t)) for i, t in enumerate(rows)}


def test_vectors_take_few_texts_at_once():
    """A batch of Spark, whatever its texts' lengths, is worked on in slices of bounded bytes."""
    import pyarrow as pa

    from lectern.operators import vectors

    texts = ["x" * n for n in (0, 10, vectors.BATCH_BYTES + 5, 3, *[vectors.BATCH_BYTES // 3] * 7)] + [None] * (vectors.BATCH_ROWS + 3)
    lists = [[1] * (len(x or "") // 8) for x in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(lists, pa.list_(pa.int32()))], names=["text", "i"])
    for column, size in (("text", lambda x: len(x or "")), ("i", lambda x: 4 * len(x))):
        parts = [b.column(column).to_pylist() for b in vectors._few([batch], column)]
        assert [x for p in parts for x in p] == batch.column(column).to_pylist() and len(parts) > 2
        assert all(len(p) == 1 or (sum(map(size, p)) <= vectors.BATCH_BYTES and len(p) <= vectors.BATCH_ROWS) for p in parts)


def test_boilerplate_exchanges_hashes_not_texts(spark):
    """Parts are summed by hashes; ids that are null or repeated, and brand phrases, are as a plain count of distinct ids has them."""
    import re

    from lectern.operators import similarity

    line = "the five words of a line"
    rows = [(1, f"{line}. And here is another one indeed. {line}!"), (1, f"{line}. more"), (2, f"{line}. x"), (3, f"{line}."), (None, f"{line}."), (4, None), (5, ""), *[(i, f"n{i} a b c d e f g h. our brand is what it is") for i in range(6, 11)], (6, "z a b c d e f g h")]

    def want(rows):
        found = {}
        for i, c in rows:
            if i is not None and c is not None:
                norm = [" ".join(re.findall("[a-z0-9]+", s.lower())) for s in re.split(r"(?<=[.!?]) ", " ".join(c.split())) if s]
                w = " ".join(re.findall("[a-z0-9]+", c.lower())).split(" ")
                each = [("REPEATED_SENTENCE", x) for x in norm if len(x.split(" ")) > 4] + [("REPEATED_CLOSING", x) for x in norm[-1:] if len(x.split(" ")) > 4] + [("REPEATED_PHRASE", " ".join(w[k : k + 8])) for k in range(len(w) - 7)]
                for x in each:
                    if x[1] != "our brand is what it is":
                        found.setdefault(x, set()).add(i)
        return {(*x, len(n)) for x, n in found.items() if len(n) > {"S": 2, "C": 1, "P": 3}[x[0][9]]}

    for part in (rows, rows[1:-1]):  # with a repeated id, and without
        got = similarity.boilerplate(spark.createDataFrame(part, "content_id long, copy string"), ("our brand is what it is",))
        assert {tuple(r) for r in got.collect()} == want(part) and len(want(part)) > 2
    assert not [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(code" in x or "hashpartitioning(text" in x]


def test_jaccard_makes_each_array_once(spark):
    rows = [("a b b", "b c"), ("", "a"), ("x", "x"), (None, "a"), ("a", None)]
    d = spark.createDataFrame(rows, "a string, b string")
    got = d.select(text.jaccard(text.every(F.col("a"), "[a-z]"), text.every(F.col("b"), "[a-z]")).alias("j"))
    assert got._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 2
    assert [r.j for r in got.collect()][:3] == [1 / 3, 0.0, 1.0]


def test_sections_are_cleaned_once_and_stay_in_place(spark):
    """No filter cleans a section again, and only sections with links are exchanged, even where nothing may be broadcast."""
    from lectern.functions import fixed
    from lectern.operators import index

    a = spark.createDataFrame([("https://own.org/p/1", "T", "# A\n\none two [a memo](https://e.org/1)\n\n## B\n\nno link here"), ("https://own.org/p/2", "N", "Share\n# Other\n\nx\n# N\n\nwords\nJan 3, 2024\n"), ("https://own.org/p/3", "T", "# E\n\nShare\n")], "canonical_url string, title string, body string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = index.chunked(a)
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert plan.count(fixed.DATE_LINE) == 2  # of sections without links, and of those with
        assert {(r.section, r.text, len(r.links)) for r in d.collect()} == {("A", "one two a memo", 1), ("B", "no link here", 0), ("Other", "x", 0), ("N", "words", 0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plain = plan.split("Union")[1].split("SortMergeJoin")[0]
    assert plain.count("Exchange") == 0 and plain.count(fixed.DATE_LINE) == 1


def test_what_is_served_stays_in_place(spark, tmp_path):
    """Where all that was made is served nothing is joined; what isn't served is left out by a broadcast of it, or by a join if there is much."""
    from lectern.operators import index

    schema = "id long, canonical_url string, title string, body string, content_hash string, content_status string, published_date string"
    rows = [(i, f"https://own.org/p/{i}", "T", f"# One\n\nword{i} plate", f"h{i}", "full", None) for i in range(6)]
    path = str(tmp_path / "index")
    assert index.build(spark.createDataFrame(rows, schema), path)
    made = index.Index(spark, path)
    assert all("Join" not in made.served(p)._jdf.queryExecution().executedPlan().toString() for p in ("chunks", "postings"))
    changed = [*rows[:4], (4, rows[4][1], "T", "# One\n\nnew plate", "n4", "full", None), (9, "https://own.org/p/9", "T", rows[0][3], "h0", "full", "2030-01-01")]
    assert index.build(spark.createDataFrame(changed, schema), path)
    want = {("https://own.org/p/9", "word0 plate"), *((f"https://own.org/p/{i}", f"word{i} plate") for i in (1, 2, 3)), ("https://own.org/p/4", "new plate")}
    for few in (index.FEW_DEAD, 0):
        index.FEW_DEAD, kept = few, index.FEW_DEAD
        try:
            made = index.Index(spark, path)
            assert {(r.canonical_url, r.text) for r in made.chunks().collect()} == want
            assert made.postings(["plate"]).count() == 5 and made.postings(["word5"]).count() == 0
        finally:
            index.FEW_DEAD = kept


def test_counts_of_a_slice_of_texts():
    """(text, code, times) by one number and by two are those of a plain loop."""
    import numpy as np

    from lectern.operators import vectors

    r = np.random.default_rng(1)
    of = np.sort(r.integers(0, 40, 3000))
    for code in (r.integers(0, 50, 3000), r.integers(0, 50, 3000) << 56):
        want = sorted((t, c, n) for (t, c), n in Counter(zip(of.tolist(), code.tolist())).items())
        assert list(zip(*(x.tolist() for x in vectors._pairs(code, of)))) == want
    assert [len(x) for x in vectors._pairs(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0, 0]


def test_buckets_of_postings_have_tasks_of_their_own(spark, tmp_path):
    """The number of a task is in its files' names: none has two buckets."""
    import glob
    import re

    from lectern.operators import index

    a = spark.createDataFrame([(1, "https://own.org/p/1", "T", "# One\n\n" + " ".join(f"word{i}" for i in range(900)), "h", "full", None)], "id long, canonical_url string, title string, body string, content_hash string, content_status string, published_date string")
    assert index.build(a, str(tmp_path / "index"))
    files = glob.glob(f"{tmp_path}/index/postings/generation=0/bucket=*/*.parquet")
    tasks = {re.search(r"part-(\d+)", f)[1] for f in files}
    assert len(tasks) == len(files) == len({re.search(r"bucket=(\d+)", f)[1] for f in files}) > index.BUCKETS // 2
