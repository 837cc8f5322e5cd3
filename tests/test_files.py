"""Readers, sinks and the index on files."""

import json

import pytest

from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators import articles, blocks, index, retrieval, store
from lectern.sources import readers, sinks


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one_note.txt").write_text("\ufeffplain words")
    (tmp_path / "sub" / "two.csv").write_text('a,b\n"x, y",2\n')
    (tmp_path / "three.json").write_text('{"b": 1}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "four.html").write_text("<body><article><p>one two</p></article></body>")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    (tmp_path / "skip.bin").write_bytes(b"x")
    good, bad = readers.documents(spark, str(tmp_path))
    assert {r.title: r.text for r in good.collect()} == {"one note": "plain words", "two": "a | b\nx, y | 2", "three": '{\n  "b": 1\n}', "four": "one two"}
    assert sorted(r.path.rsplit("/", 1)[1] for r in bad.collect()) == ["bad.json", "scan.pdf"]
    listed = readers.listing(spark, str(tmp_path)).collect()
    assert len(listed) == 7 and {r.length for r in listed if r.path.endswith(".bin")} == {1}


def test_csv_files(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('number,phrase,link\n1,"a, b",https://e.org/x?utm_source=q&a=1\n2,,https://e.org\n\n3,c,https://e.org/y\n')
    rows, skipped = readers.source_csv(spark, str(p))
    assert [tuple(r) for r in rows.orderBy("number").collect()] == [("1", "a, b", "https://e.org/x?a=1"), ("3", "c", "https://e.org/y")]
    assert [r.number for r in skipped.collect()] == ["2"]
    assert [tuple(r) for r in readers.csv_rows(spark, str(p)).where("number = '3'").collect()] == [("3", "c", "https://e.org/y")]
    df = spark.createDataFrame([(1, ["x", "y"], 'say "so"', 9)], "id int, tags array<string>, t string, extra int")
    sinks.write_csv(df, ["t", "id", "tags"], str(tmp_path / "out"))
    assert [tuple(r) for r in readers.csv_rows(spark, str(tmp_path / "out")).collect()] == [('say "so"', "1", "x|y")]


def test_manifest_files(spark, tmp_path):
    part = {"number": 1, "title": "T", "slug": "t", "status": "planned", "finale": True, "previous": None, "next": None, "published_url": None}
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 1, "title": "S", "slug": "s", "status": "active", "planned_parts": 2, "parts": [part, {**part, "number": 2, "slug": "u"}]}, indent=1))
    assert [(r.series, r.number, r.slug, r.finale) for r in readers.manifests(spark, str(tmp_path / "m.json")).orderBy("number").collect()] == [("s", 1, "t", True), ("s", 2, "u", True)]


def test_packets(spark):
    links = [("a", "https://e.org/1", "external_research"), ("b", "https://e.org/2", "external_research")]
    m = spark.createDataFrame([("A", "Title", 0.5, "An alleged memo likely says so.", links)], "article string, title string, score double, excerpt string, links array<struct<anchor:string,url:string,kind:string>>")
    section = sinks.memory_packet(m, 1).first().section
    assert section.startswith("### Title (0.5000)\nCues: UNCONFIRMED, DOCUMENTED, INFERENCE") and "e.org/1" in section and "e.org/2" not in section
    c = sinks.candidate_packet(m, 1, 10).first()
    assert c.excerpt == "An alleged" and len(c.links) == 1
    u = spark.createDataFrame([(["x", "b"], ["a", "b"]), (["x"], ["a", "b"])], "asked array<string>, real array<string>")
    assert [r.u for r in u.select(sinks.curated_links(F.col("asked"), F.col("real")).alias("u")).collect()] == [["b"], ["a", "b"]]
    v = spark.createDataFrame([("A", 3, "T", "Why did I read the memo?")], "article string, number int, title string, text string")
    assert sinks.voice_packet(v).first().section.startswith("> Why did I read the memo?\n— T, paragraph 3 (fact creates an investigative question; investigator visibly present")


def test_index_is_built_once(spark, tmp_path):
    rows = [(1, "https://own.org/p/1", "First", "nav\n# One\nfirst words [l](https://e.org/1)\n## Two\nmore words", "h1", "full", "2024-01-01"), (2, "https://own.org/p/2", "Copy", "# Copy\nsame", "h1", "full", "2023-01-01"), (3, "https://own.org/p/3", "Three", "# Three\nthird", "h3", "full", None)]
    a = spark.createDataFrame(rows, "id long, canonical_url string, title string, body string, content_hash string, content_status string, published_date string")
    path = str(tmp_path / "index")
    assert index.build(a, path) and not index.build(a, path) and index.build(a, path, force=True)
    got = {(r.canonical_url, r.section): r for r in index.load(spark, path).collect()}
    assert {u for u, _ in got} == {"https://own.org/p/1", "https://own.org/p/3"}  # the newest of equal bodies
    assert got["https://own.org/p/1", "Two"].text == "more words" and got["https://own.org/p/1", "One"].links[0].url == "https://e.org/1"
    assert index.build(a.where("id <> 3"), path)


def test_first_write_stays(spark, tmp_path):
    for x in ("first", "second"):
        store.preserved(spark.createDataFrame([(x,)], "x string"), str(tmp_path / "p"))
    assert [r.x for r in spark.read.parquet(str(tmp_path / "p")).collect()] == ["first"]


def test_order_of_articles(spark):
    a = spark.createDataFrame([(1, "2024-01-01"), (2, None), (3, "2024-01-01"), (4, "2023-05-05")], "id long, published_date string")
    assert [r.id for r in store.listed(a).collect()] == [3, 1, 4, 2]


def test_source_rows_of_an_article(spark):
    rows = spark.createDataFrame([(1, 1, "a phrase", "https://e.org/1"), (1, 2, "gone", "https://e.org/1"), (1, 3, "words", "https://e.org/2?utm_source=x")], "key int, number int, phrase string, link string")
    a = spark.createDataFrame([(1, "a phrase of words")], "key int, prose string")
    assert {(r.number, r.problem) for r in articles.csv_problems(rows, a, "key").collect()} == {(1, "repeated link"), (2, "repeated link"), (2, "phrase not in article"), (3, "unclean link")}


def test_narrative_prose(spark):
    d = spark.createDataFrame([("# T\n\none  two\n\n- item\n\n## FAQs\n\nnot this",)], "m string")
    assert d.select(blocks.narrative(F.col("m")).alias("x")).first().x == ["one two"]


def _articles(spark, rows):
    return spark.createDataFrame([(i, f"https://own.org/p/{u}", t, b, b and str(hash(b)), s, d) for i, u, t, b, s, d in rows], "id long, canonical_url string, title string, body string, content_hash string, content_status string, published_date string")


def _corpus(seed):
    import random

    r = random.Random(seed)
    pool = ["Marlow Security", "license plate", "police", "database", "infrared", "sensor", "roads", "camera network", "the harbor", "tide tables", "memo 12", "overmarlow security", "reader", "a b", "word", "others"]
    return [(i, f"u{i}", r.choice(["Plates", "Marlow Security files", "Tides", "Words"]), "# One\n\n" + " ".join(r.choice(pool) for _ in range(r.choice([4, 30, 900]))) + "\n\n## Two\n\n" + " ".join(r.choice(pool) for _ in range(20)), r.choice(["full", "preview_only"]), f"2024-01-{1 + i % 28:02d}") for i in range(40)]


@pytest.mark.parametrize("query,concepts", [("Marlow Security camera network", ["license plate", "infrared"]), ("harbor tide database", []), ("NSA others word", ["memo 12", "a b"]), ("Marlow Security", ["camera"])])
def test_retrieval_from_postings_is_that_of_all_chunks(spark, tmp_path, query, concepts):
    path = str(tmp_path / "index")
    assert index.build(_articles(spark, _corpus(1)), path)
    made = index.Index(spark, path)
    every = made.chunks().withColumnsRenamed({"canonical_url": "article", "chunk": "start"})
    rows = lambda df: [tuple(x) for x in df.collect()]
    want = rows(retrieval.retrieve(every, query, concepts, 50, 0.0))
    assert rows(retrieval.retrieve_indexed(made, query, concepts, 50, 0.0)) == want
    assert want or "tide" in query


def test_an_incremental_build_equals_a_full_one(spark, tmp_path):
    rows = _corpus(2)
    rows[7] = (7, "u7", "T", "", "full", None)  # no chunk
    rows[8] = (8, "u8", "T", rows[9][3], "full", "2030-01-01")  # newer than its copy
    step, whole = str(tmp_path / "step"), str(tmp_path / "whole")
    changed = [r for r in rows if r[0] != 8]
    changed[3] = (*changed[3][:3], "# One\n\nnew police words", *changed[3][4:])
    changed.append((90, "u90", "New", "# One\n\nnew infrared words", "full", None))
    assert index.build(_articles(spark, rows), step) and index.build(_articles(spark, changed), step) and not index.build(_articles(spark, changed), step)
    assert index.build(_articles(spark, changed), whole)
    a, b = index.Index(spark, step), index.Index(spark, whole)
    assert (a.generation, b.generation) == (1, 0) and a.meta["tokens"] == b.meta["tokens"] and a.meta["chunks"] == b.meta["chunks"]
    bag = lambda df: sorted(map(tuple, df.collect()))
    for part in ("chunks", "postings"):
        cols = sorted(c for c in b.served(part).columns if c not in ("generation", "links"))
        assert bag(a.served(part).select(cols)) == bag(b.served(part).select(cols)), part
    written_ = spark.read.parquet(f"{step}/articles").where("generation = 1")
    assert written_.where("made = 1").count() == 2  # only what is new or changed was made again
    assert {r.canonical_url[-2:] for r in written_.where("NOT served").collect()} == {"u7"} and written_.where("canonical_url LIKE '%u9' AND served").count() == 1


def test_postings_are_pruned(spark, tmp_path):
    path = str(tmp_path / "index")
    index.build(_articles(spark, _corpus(3)), path)
    made = index.Index(spark, path)
    plan = made.postings(["police"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,police)" in plan and "PartitionFilters" in plan and "(bucket#" in plan.split("PartitionFilters")[1]
    assert made.postings(["license plate", "police"]).groupBy("term").count().count() == 2


def _docx(*paragraphs):
    import io
    import zipfile

    body = "".join(f"<w:p>{p}</w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


def test_office_files(spark, tmp_path):
    run = lambda t: f"<w:r><w:rPr><w:b/></w:rPr><w:t>{t}</w:t></w:r>"
    (tmp_path / "a_memo.docx").write_bytes(_docx(run("First ") + run("line") + "<w:hyperlink>" + run(" linked") + "</w:hyperlink>", "", "<w:r><w:t>é</w:t><w:tab/><w:t>x</w:t><w:br/><w:t>y</w:t></w:r>"))
    (tmp_path / "bad.docx").write_bytes(b"PK no archive")
    (tmp_path / "n.rtf").write_bytes(rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\*\generator x;}\f0\b Bold\b0  text\par caf\'e9 \u8364?\uc0\u233 {\i in}\line\{b\}\~z\emdash{\pict 0102}{\info{\title T}}\par}")
    (tmp_path / "bad.rtf").write_bytes(b"plain")
    good, bad = readers.documents(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.title, r.text) for r in good.collect()}
    assert got == {"a_memo.docx": ("a memo", "First line linked\n\né\tx\ny"), "n.rtf": ("n", "Bold text\ncafé €éin\n{b} z—")}
    assert {r.path.rsplit("/", 1)[1] for r in bad.collect()} == {"bad.docx", "bad.rtf"}


def test_sitemaps_are_walked(spark):
    leaf = lambda *us: "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in us) + "</urlset>"
    top = lambda *us: "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in us) + "</sitemapindex>"
    h = "https://own.org"
    pages = [
        (f"{h}/sitemap.xml", top(f"{h}/a", f"{h}/loop", f"{h}/lost", f"{h}/junk")), (f"{h}/a", leaf(f"{h}/p/1/", f"{h}/p/2?x=1", f"{h}/about")), (f"{h}/loop", top(f"{h}/sitemap.xml", f"{h}/b", f"{h}/a")),
        (f"{h}/b", "<urlset><broken><url><loc>https://own.org/p/3&amp;</loc>"), (f"{h}/junk", "not xml"), (f"{h}/other", leaf(f"{h}/p/9")),
    ]
    df = spark.createDataFrame(pages, "url string, xml string")
    found, failed = readers.sitemap_walk(df, f"{h}/sitemap.xml/")
    assert {(r.loc, r.map) for r in found.collect()} == {(f"{h}/p/1", f"{h}/a"), (f"{h}/p/2", f"{h}/a"), (f"{h}/p/3&", f"{h}/b")}
    errors = {r.url: r.error for r in failed.collect()}
    assert set(errors) == {f"{h}/lost", f"{h}/junk"} and errors[f"{h}/lost"] == "not stored" and "parse failed" in errors[f"{h}/junk"]
    few, _ = readers.sitemap_walk(df, f"{h}/sitemap.xml", 2)
    assert {r.map for r in few.collect()} == {f"{h}/a"}
    none, missing = readers.sitemap_walk(df, "https://nowhere.org/sitemap.xml")
    assert none.count() == 0 and missing.count() == 1


def test_project_findings(spark):
    from lectern.operators import projects

    article = "# T\n\nA [memo](https://e.org/1) of [it](https://own.org/p/1) and [more](https://e.org/2?utm_source=a).\n\n[IMAGE: x | ALT: y]\n\n[[SUBSCRIBE]]\n[[SHARE]]\n\n## FAQs\n" + "".join(f"### Q{i}?\nyes\n" for i in range(5)) + "\n## YOU MAY BE INTERESTED IN THESE ARTICLES\n[see](https://elsewhere.org/x)\n"
    good = {f"output/{n}": "text" for n in fixed.PROJECT["deliverables"]} | {n: "own text" for n in fixed.PROJECT["papers"]}
    good |= {"output/article.md": article, "output/sources.csv": "﻿source_number,phrase,link\r\n1,memo,https://e.org/1\r\n", "output/seo.md": "".join(f"## {f}\nx\n" for f in fixed.PROJECT["search fields"])}
    bad = good | {"output/audit.md": " \n", "research/RABBIT_HOLE_QUEUE.md": "| a | b |\n| hole | OPEN |\n", "research/STORY_SPINE.md": "Template\n", "output/seo.md": "## Meta Title\n\n## URL Slug\nx", "output/sources.csv": 'source_number,phrase\n0,memo,https://e.org/1\n1,"memo",https://e.org/1\n1,it,https://own.org/p/2\n2, ,x\n3,no such,https://e.org/a b\n'}
    broken = good | {"output/sources.csv": 'source_number,phrase,link\n1,"memo,https://e.org/1\n'}
    none = good | {"output/sources.csv": "source_number,phrase,link\n"}
    del bad["output/outline.md"]
    sets = {"good": good, "bad": bad, "broken": broken, "none": none}
    files = spark.createDataFrame([(k, n, t) for k, fs in sets.items() for n, t in fs.items()], "key string, name string, text string")
    known = spark.createDataFrame([("https://elsewhere.org/x",)], "canonical_url string")
    found = projects.findings(files, "key", ["own.org"], known, {"research/STORY_SPINE.md": "Template"})
    got = {k: {(r.severity, r.code, r.detail) for r in found.collect() if r.key == k} for k in sets}
    base = {("error", "link without tracking", None), ("warning", "length", None)}
    assert got["good"] == base
    assert got["broken"] - base == {("error", "source row: invalid CSV", "0")} and got["none"] - base == {("error", "source row: no source row", "1")}
    rows = {(c.removeprefix("source row: "), d) for _, c, d in got["bad"] if c.startswith("source row")}
    assert rows == {("header", "1"), ("positive number used once", "2"), ("repeated phrase or URL", "3"), ("positive number used once", "4"), ("phrase not linked to its URL", "4"), ("three filled fields", "5"), ("phrase not in article", "6"), ("phrase not linked to its URL", "6"), ("invalid URL", "6")}
    rest = {(s, c, d) for s, c, d in got["bad"] - base if not c.startswith("source row")}
    assert rest == {("error", "deliverable", "output/outline.md"), ("error", "deliverable", "output/audit.md"), ("warning", "active rabbit holes", None), ("warning", "working paper is a template", "research/STORY_SPINE.md")} | {("error", "search package", f) for f in fixed.PROJECT["search fields"] if f != "URL Slug"}
    res = {r.key: (r.errors, r.result) for r in projects.results(files, found, "key").collect()}
    assert res["good"] == (1, "FAIL") and res["bad"][0] == len([1 for s, _, _ in got["bad"] if s == "error"])
