"""Facts about the operators on small inline tables."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import search, text, urls
from lectern.operators import blocks, evidence, repair, retrieval, rules, similarity, store
from lectern.sources import html, sinks


def one(spark, c, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    "url,kind",
    [("https://own.substack.com/p/a?x=1", "internal_article"), ("https://own.substack.com/s/section", "ignored"), ("https://substack.com/@someone", "ignored"), ("https://lib.example.org/file.pdf", "external_research"), ("mailto:a@b.c", "ignored"), ("https://substackcdn.com/i.png", "ignored")],
)
def test_link_class(spark, url, kind):
    assert one(spark, urls.link_class(F.col("u"), F.lit("https://own.substack.com/p/x")), u=url) == kind


def test_urls(spark):
    u = "HTTPS://Ex.org:443/p/A/?utm_source=x&b=1&fbclid=9#top"
    assert one(spark, urls.canonical(F.col("u")), u=u) == "https://ex.org:443/p/A"
    assert one(spark, urls.without_tracking(F.col("u")), u=u) == "https://ex.org:443/p/A/?b=1#top"
    assert one(spark, urls.host(F.col("u")), u=u) == "ex.org"
    assert [one(spark, urls.is_valid(F.col("u")), u=x) for x in ("https://a.b/c", "ftp://a.b", "https://u@a.b", "https://a.b/%zz", "https://a.b/ c")] == [True, False, False, False, False]


def test_excerpt(spark):
    t = "The  Report was\nsigned in 1962."
    got = [one(spark, text.contains_excerpt(F.col("t"), F.col("p")), t=t, p=p) for p in ("The  Report was\nsigned", "the report WAS signed", "signed in 1963", "")]
    assert got == [True, True, False, False]


@pytest.mark.parametrize(
    "end,label",
    [("Subscribe to continue reading", "subscribe to continue reading"), ("Upgrade to paid to unlock the rest", "upgrade to paid continuation boundary"), ("Subscribe for free to receive new posts", None), ("Subscribe to continue reading" + " word" * 600, None)],
)
def test_preview_boundary(spark, end, label):
    assert one(spark, text.preview_boundary(F.col("t")), t="long text " * 50 + end) == label


def test_copyedit_and_lengths(spark):
    assert one(spark, text.copyedit_issues(F.col("t")), t="It it was , odd!! “quote") == ["DOUBLE_PUNCTUATION", "MALFORMED_QUOTES", "REPEATED_WORD", "SPACING"]
    assert one(spark, text.weighted_length(F.col("t")), t="aé日") == 5
    assert one(spark, text.duration_status("SHORT", F.lit(45)), t="") == "PASS"
    assert one(spark, text.duration_status("LONGSHORT", F.lit(30)), t="") == "FAIL"
    assert one(spark, text.hyphen_slug(F.col("t")), t="Café Été: Über!") == "cafe-ete-uber"
    assert one(spark, text.hyphen_slug(F.col("t")), t="CON") == "article-con"
    assert one(spark, text.ascii_lower(F.col("t")), t="AÉ") == "aÉ"


def test_query_parse():
    assert search.query_entities("Marlow Security surveillance") == ["marlow security"]
    assert search.query_entities("Marlow Security ALPR cameras") == ["marlow security", "alpr"]
    assert search.query_entities("Edda Quill / Harbor Files") == ["edda quill", "harbor files"]
    entities, parts, free = search.query_plan("Marlow Security camera camera network")
    assert (entities, parts, free) == (["marlow security"], ["marlow", "security"], ["camera", "camera", "network"])
    assert "security camera" not in search.query_phrases("Marlow Security camera network", entities)


def test_bm25_and_repeats(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha alpha delta"), (3, "other words here")], "id int, t string")
    s = {r.id: r.score for r in search.bm25(d, "id", ["alpha"], text.search_tokens(F.col("t"))).collect()}
    twice = {r.id: r.score for r in search.bm25(d, "id", ["alpha", "alpha"], text.search_tokens(F.col("t"))).collect()}
    assert set(s) == {1, 2} and s[2] > s[1] and twice[1] == pytest.approx(2 * s[1])


CHUNKS = [
    ("direct", 0, "Marlow Security sells cameras that read a license plate", "Marlow Security", "full"),
    ("preview", 0, "Marlow Security sells cameras that read a license plate", "Marlow Security", "preview_only"),
    ("related", 0, "police database of license plate reader sightings with infrared vehicle tracking", "Plates", "full"),
    ("decoy", 0, "public security is a word in a government report", "Words", "full"),
]
SIGNALS = "article string, start int, text string, title string, status string"


def test_retrieval_gate(spark):
    c = spark.createDataFrame(CHUNKS, SIGNALS)
    got = retrieval.retrieve(c, "Marlow Security surveillance", ["license plate", "infrared", "vehicle tracking"], 10, 0.05).collect()
    by = {r.article: r for r in got}
    assert "decoy" not in by
    assert by["preview"].score < by["direct"].score and by["direct"].tier == "DIRECT" and by["related"].tier == "RELATED INFRASTRUCTURE"


def test_retrieval_signals(spark):
    """Each signal against a plain loop over the chunks."""
    import math
    import re

    from lectern.functions import fixed

    links = [[("camera catalogue", "https://e.org/1", "external_research"), ("plates", "https://own.org/p/1", "internal_article")], [], [("marlow security files", "https://e.org/2", "external_research")], [("nothing", "https://e.org/3", "external_research")]]
    c = spark.createDataFrame([(*r, "", k) for r, k in zip(CHUNKS, links)], SIGNALS + ", section string, links array<struct<anchor:string,url:string,kind:string>>")
    query, concepts = "Marlow Security camera network", ["license plate", "camera"]
    got = {r.article: r for r in retrieval.signals(c, query, concepts).collect()}
    tok = lambda s: [t for t in (x.lower() for x in re.findall(r"[A-Za-z0-9][A-Za-z0-9_.&'-]{1,}", s)) if t not in fixed.SEARCH_STOP]
    hay = {a: f"{title}  {body}".lower() for a, _, body, title, _ in CHUNKS}
    seeds = {t for a, h in hay.items() if "marlow security" in h for t in tok(h)} & set(fixed.INFRASTRUCTURE_TERMS)
    phrases = search.query_phrases(query, ["marlow security"])
    n, raw = len(hay), {}
    for a, h in hay.items():
        dl, mean = len(tok(h)), sum(len(tok(x)) for x in hay.values()) / n
        raw[a] = sum(search.idf(n, sum(t in tok(x) for x in hay.values())) * tok(h).count(t) * 2.5 / (tok(h).count(t) + 1.5 * (0.25 + 0.75 * dl / mean)) for t in ("camera", "network"))
    for (a, _, _, title, _), own in zip(CHUNKS, links):
        g, shared = got[a], set(tok(hay[a])) & seeds
        anchors = " ".join(x for x, _, k in own if k != "internal_article")
        hit = any(p in anchors for p in phrases)
        assert g.direct == ("marlow security" in hay[a]) and g.n_shared == len(shared) and g.seed == min(1, len(shared) / 4)
        assert g.anchor == pytest.approx(min(1, 0.65 * hit + 0.35 * len({"camera", "network"} & set(tok(anchors))) / 2) if anchors else 0)
        assert g.lexical == pytest.approx(raw[a] / max(raw.values()) if max(raw.values()) else 0)
        scores = sorted(((math.log((n + 1) / (sum(p in x for x in hay.values()) + 1)) + 1) * min(2, 0.75 + 0.45 * len(p.split())) * (1.45 if p in title.lower() else 1) for p in phrases if p in hay[a]), reverse=True)
        assert g.phrase == pytest.approx(1 - math.exp(-sum(scores[:3]) / 4))
        assert g.semantic == 0


def test_semantic_contrast(spark):
    """Latent vectors answer for chunks that have a query's vocabulary; what a generic query finds as well counts less."""
    c = spark.createDataFrame([(f"a{i}", 0, f"harbor lantern glass tide number{i % 5} boat{i % 3}", "T", "full") for i in range(20)] + [(f"b{i}", 0, f"soil tomato garden seed number{i % 5} spade{i % 3}", "T", "full") for i in range(20)], SIGNALS)
    model = retrieval.fit_lsa(c.select(F.struct("article", "start").alias("key"), "text"), "key", F.col("text"), 4, 1000)
    got = {r.article: r.semantic for r in retrieval.signals(c, "harbor lantern tide", [], model).collect()}
    assert min(v for k, v in got.items() if k[0] == "a") > 0.3 > max(v for k, v in got.items() if k[0] == "b")
    assert not any(model.query("words that no chunk has")) and sum(x * x for x in model.query("harbor")) == pytest.approx(1)


def test_concepts(spark):
    assert one(spark, search.without_contained(F.col("h")), h=["camera", "camera network", "network", "alpr"]) == ["camera network", "alpr"]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "u1", "h1", "full"), (2, "u2", "h2", "full"), (3, "u3", "h3", "full")], "id long, canonical_url string, content_hash string, content_status string")
    new = spark.createDataFrame([(10, "u2", "h2", "full"), (11, "u3", "H3", "full"), (12, "u5", "h", "full"), (13, "u4", "h", "preview_only")], "seq long, canonical_url string, content_hash string, content_status string")
    got = {r.canonical_url: (r.id, r.state, r.content_hash) for r in store.upsert(old, new).collect()}
    assert got == {"u1": (1, "missing", "h1"), "u2": (2, "unchanged", "h2"), "u3": (3, "updated", "H3"), "u5": (4, "new", "h"), "u4": (5, "new", "h")}


def test_tables_of_the_store(spark):
    """The operators take and give rows of the store's schemas."""
    article = (1, "WR-000001", "T", "t", "https://own.org/p/t", "2024-01-01", "A", "h", "full", "d", 5, "2024-01-02", "2024-01-02")
    old = spark.createDataFrame([article], store.ARTICLES)
    new = spark.createDataFrame([(*article[:7], "h2", *article[8:]), (2, "WR-000002", "U", "u", "https://own.org/p/u", *article[5:])], store.ARTICLES).withColumn("seq", F.col("id"))
    got = store.upsert(old, new)
    assert {(r.id, r.wr_id, r.state) for r in got.collect()} == {(1, "WR-000001", "updated"), (2, "WR-000002", "new")} and set(got.columns) == {*old.columns, "state"}
    links = spark.createDataFrame([(1, 1, "a", "https://e.org/1", "external_research"), (2, 2, "b", "https://e.org/2", "external_research")], store.LINKS)
    assert [tuple(r) for r in store.links_of(links, old, "https://own.org/p/t").collect()] == [(1, "a", "https://e.org/1", "external_research")]
    sources = spark.createDataFrame([(7, "S", "web", None, "f.txt", "high")], store.SOURCES)
    evidence_ = spark.createDataFrame([(1, "EV-0001", 7, "c", "x", True, "direct", "high", ["E"], None, None, None)], store.EVIDENCE)
    assert store.packet(evidence_, sources, 5).first().section.startswith("## EV-0001 [VERIFIED]\nSource: S (f.txt)")
    runs = spark.createDataFrame([(1, "Q", "q", "n", [("T", "https://e.org")])], store.RESEARCH_RUNS)
    assert sinks.appended_run(runs).first().citations_json == '[{"title":"T","url":"https://e.org"}]'


def test_status_checks(spark):
    a = spark.createDataFrame([("u1", "full")], "canonical_url string, content_status string")
    change = lambda k, s: store.with_status(a, spark.createDataFrame([(k, s)], "canonical_url string, status string")).collect()
    assert change("u1", "preview_only")[0].content_status == "preview_only"
    with pytest.raises(Exception, match="unknown status"):
        change("u1", "gone")


def test_precedence(spark):
    rows = [("u", "FULL_PUBLIC", "public_web", 1), ("u", "FULL_AUTHOR_EXPORT", "author_export", 2), ("u", "FULL_PUBLIC", "public_web", 3), ("v", "TITLE_ONLY", "public_web", 4), ("v", "FULL_PUBLIC", "verified_local_author_copy", 5)]
    o = spark.createDataFrame(rows, "url string, access string, origin string, seq int")
    won, lost = store.merged_by_priority(o, "url", store.source_priority(F.col("origin"), F.col("access")), F.col("seq").desc())
    assert {(r.url, r.seq) for r in won.collect()} == {("u", 2), ("v", 5)} and lost.count() == 3


def test_evidence(spark):
    i = spark.createDataFrame([(1, "Claim A", 1), (1, "CLAIM a", 2), (2, "Claim A", 3), (1, "É", 4), (1, "é", 5)], "source_id int, claim string, seq int")
    got = [(r.evidence_id, r.seq) for r in store.evidence_kept(i).orderBy("seq").collect()]
    assert got == [("EV-0001", 1), ("EV-0002", 3), ("EV-0003", 4), ("EV-0004", 5)]
    s = spark.createDataFrame([("u", None, " ", 1), ("u", None, "again", 2), (None, "f.pdf", "F", 3)], "url string, file_path string, title string, seq int")
    assert [(r.id, r.title) for r in store.sources_kept(s).orderBy("id").collect()] == [(1, "Untitled source"), (2, "F")]


def test_packet(spark):
    e = spark.createDataFrame([(1, "EV-0001", 7, "c", "x" * 1000, True, ["a", "b"])], "id int, evidence_id string, source_id int, claim string, excerpt string, excerpt_verified boolean, entities array<string>")
    s = spark.createDataFrame([(7, "T", "http://u", None)], "id int, title string, url string, file_path string")
    section = store.packet(e, s, 5).first().section
    assert "EV-0001 [VERIFIED]" in section and "x" * 900 in section and "x" * 901 not in section


def test_inventory_and_duplicates(spark):
    a = spark.createDataFrame([("u1", "h"), ("u2", "h"), ("u3", "k")], "canonical_url string, digest string")
    assert {r.canonical_url: r.duplicate_of for r in store.duplicate_of(a, "digest", "canonical_url").collect()} == {"u1": None, "u2": "u1", "u3": None}
    f = spark.createDataFrame([("u2", "e"), ("u9", "e")], "canonical_url string, error string")
    m = spark.createDataFrame([("u3",)], "canonical_url string")
    assert {(r.canonical_url, r.error, r.missing) for r in store.inventory(a, f, m).collect()} == {("u1", None, False), ("u2", "e", False), ("u3", None, True), ("u9", "e", False)}


def test_convergence(spark):
    p = spark.createDataFrame([("p1", "g1", ["Bank", "X"]), ("p2", "g1", ["bank"]), ("p3", "g2", ["BANK", "Y", "y"])], "path_id string, dependency_group string, nodes array<string>")
    assert [tuple(r) for r in evidence.convergences(p).collect()] == [("bank", 3, 2)]


def test_source_rows(spark):
    m = spark.createDataFrame([("EV-0001", 1, "the memo was signed in Washington by the director"), ("EV-0002", 2, "same page again"), ("EV-0003", 3, "no url here"), ("EV-0004", 4, "the CIA Directive was read by many people there")], "evidence_id string, pos int, context string")
    a = spark.createDataFrame([("EV-0001", "memo was signed"), ("EV-0004", "not in context")], "evidence_id string, phrase string")
    e = spark.createDataFrame([("EV-0001", "http://a", []), ("EV-0002", "http://a", []), ("EV-0003", None, []), ("EV-0004", "http://b", ["CIA", "CIA Directive"])], "evidence_id string, url string, entities array<string>")
    assert [tuple(r) for r in evidence.source_rows(m, a, e).collect()] == [(1, "memo was signed", "http://a", "EV-0001"), (2, "CIA Directive", "http://b", "EV-0004")]


def test_fallback_phrase(spark):
    rows = [("so the harbor office [[EV-0001]] closed", ["Harbor Office", "office"], "harbor office"), ("a memo of the NSC and CIAX here", [], "CIAX"), ("then Edda Quill met Ann Lee Brook there", None, "Ann Lee Brook"), ("see file B12 now", [], "B12"), ("none of it is said in well-known words", ["x"], "is said in well-known words"), ("", [], "")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, e array<string>, want string")
    assert [r.got for r in d.select("i", evidence.fallback_phrase(F.col("c"), F.col("e")).alias("got")).orderBy("i").collect()] == [r[2] for r in rows]


def test_rerank(spark):
    c = spark.createDataFrame([("W1", "RELATED", [], 0.5), ("W2", "RELATED", [], 0.9), ("W3", "DIRECT", [], 0.1), ("W4", "RELATED", ["x"], 0.2), ("W5", "RELATED", [], 0.3)], "wr_id string, tier string, phrases array<string>, score double")
    j = spark.createDataFrame([("W1", 5, "strong", 1), ("W2", 5, "x", 1), ("W2", 3, "weak", 2), ("W3", 1, "weak", 1)], "wr_id string, score int, relationship string, seq int")
    got = {r.wr_id: (r.included, r.judged) for r in evidence.reranked(c, j).collect()}
    assert got == {"W1": (True, 5), "W2": (False, 3), "W3": (True, 1), "W4": (True, 1), "W5": (False, 1)}


def test_rabbit_holes(spark):
    rows = [(1, "EXHAUSTED", ["a"], ["r"], "done", None), (2, "EXHAUSTED", ["a", "b"], ["r"], "done", None), (3, "BLOCKED", [], [], None, "sealed"), (4, "DEFERRED", [], [], "later", None), (5, "WHAT", [], [], None, None)]
    d = spark.createDataFrame(rows, "id int, disposition string, searches array<string>, records_read array<string>, stopping_reason string, blocker string")
    assert {(r.id, r.rule) for r in rules.violations(d, "id", rules.rabbit_hole_rules()).collect()} == {(1, "exhausted after two searches"), (5, "disposition domain")}
    assert {r.id: r.status for r in rules.verdicts(d, "id", rules.rabbit_hole_rules()).collect()} == {1: "FAIL", 2: "PASS", 3: "PASS", 4: "PASS", 5: "FAIL"}


def test_manifest(spark):
    rows = [("s", 1, "one", None, "two", None, False, "complete"), ("s", 2, "two", "one", "three", None, False, "planned"), ("s", 3, "two", "two", None, None, True, "odd")]
    p = spark.createDataFrame(rows, "series string, number int, slug string, previous string, next string, published_url string, finale boolean, status string")
    broken, rs = rules.manifest_rules(p)
    assert {(r.number, r.rule) for r in rules.violations(broken, "number", rs).collect()} == {(2, "slug unique"), (3, "slug unique"), (2, "next is the neighbour"), (3, "status domain")}


def test_gates(spark):
    d = spark.createDataFrame([("| A. Facts | PASS | ok |\n| B | what | x |\n|C|pass|ok|\n|C|fail|bad|",)], "text string")
    assert {r.gate: r.status for r in rules.gate_report(rules.quality_gates(d)).collect()} == {"A": "PASS", "B": "PENDING", "C": "FAIL", "D": "PENDING", "E": "PENDING", "F": "PENDING", "G": "PENDING"}


def test_similarity(spark):
    a = spark.createDataFrame([("a", 1, "The same copy of words here", None), ("b", 2, "the same copy, of words here!", None), ("c", 3, "something else entirely", None), ("d", 4, "The same copy of words here", "CROSS_PLATFORM_REUSE")], "content_id string, pos int, copy string, reuse_policy string")
    p = similarity.similar_pairs(a)
    assert [tuple(r) for r in p.collect()] == [("a", "b", 1.0)]
    assert tuple(similarity.duplicate_rate(a, p).first()) == (0.5, "FAIL")


def test_identity(spark):
    body = " ".join(f"record{i} bureau office file number{i % 40} witness statement" for i in range(60))
    other = " ".join(f"garden{i} flower tomato soil season{i % 40} water seed" for i in range(60))
    p = spark.createDataFrame([(1, "# The Bureau Files\n\n" + body, "# The Bureau Files Again\n\n" + body[900:]), (2, "# The Bureau Files\n\n" + body, "# Growing Tomatoes\n\n" + other), (3, "# A\n\nshort", "# A\n\nshort")], "id int, b string, a string")
    assert {r.id: r.outcome for r in similarity.identity(p, "id", "b", "a").collect()} == {1: "same_story", 2: "different_story", 3: "insufficient_evidence"}


def test_sections_and_windows(spark):
    md = "intro\n# One\n\ntext [a link](https://x.org/1)\n## Two\nmore\n\n### Empty\n## Three\nlast"
    d = spark.createDataFrame([(1, md, "T")], "id int, m string, title string")
    assert [(r.section, r.body.split("\n")[0]) for r in blocks.sections(d, "id", "m", "title").orderBy("number").collect()] == [("T", "intro"), ("One", "text [a link](https://x.org/1)"), ("Two", "more"), ("Three", "last")]
    w = spark.createDataFrame([(1, " ".join(map(str, range(1300))))], "id int, t string")
    got = [(r.start, len(r.piece.split())) for r in blocks.word_windows(w, "id", F.col("t")).orderBy("start").collect()]
    assert got == [(0, 650), (560, 650), (1120, 180)]


def test_char_chunks(spark):
    d = spark.createDataFrame([(1, "a" * 8000 + "\n\n" + "b" * 9000), (2, "")], "id int, t string")
    got = [(r.id, r["index"], len(r.chunk)) for r in blocks.char_chunks(d, "id", "t").orderBy("id", "index").collect()]
    assert got == [(1, 0, 8000), (1, 1, 10202)]


def test_source_windows(spark):
    d = spark.createDataFrame([(1, "noise " * 3500 + "the relevant term " * 5 + "noise " * 3500), (2, "short")], "id int, t string")
    got = blocks.char_windows(d, "id", "t", ["relevant"], "relevant term").collect()
    assert any("relevant" in r.piece and r.score >= 12 for r in got if r.id == 1) and [r.piece for r in got if r.id == 2] == ["short"]


def test_repair(spark):
    d = spark.createDataFrame([(1, '```json\n{"items": [{"a": 1}, {"a": 2, "b": "cut'), (2, "nothing"), (3, '{"items": [{"a": [1, {"b": 2}]}]}')], "id int, raw string")
    assert {r.id: len(r["items"]) for r in repair.repaired_items(d, "id", "raw").collect()} == {1: 1, 2: 0, 3: 1}


def test_link_insert():
    assert repair.link_first("the memo and The Memo", "memo", "u") == ("the [memo](u) and The Memo", True)
    assert repair.link_first("[the memo](x) `a` memos", "memo", "u") == ("[the memo](x) `a` memos", False)
    assert repair.split_sentences("1/ Mr. J.F. Kennedy spoke. He left!\nNext") == ["Mr.", "J.F. Kennedy spoke.", "He left!", "Next"]


def test_snapshot():
    page = '<html><head><title>t</title><meta property="og:title" content="Real Title"><link rel="canonical" href="https://c.org/p/1"></head><body><nav><a href="/x">menu</a></nav><article><h1>H</h1><p>one two <a href="https://e.org">three</a></p><script>no()</script></article></body></html>'
    canonical, title, _, _, body, words, links, n, level = html.snapshot(page, "https://c.org/p/1?x=1")
    assert (canonical, title, body, words, n, level) == ("https://c.org/p/1", "Real Title", "H\none two three", 4, 1, "TITLE_ONLY")
    assert html.snapshot(None, "u")[5] == 0 and html.snapshot("<p>loose & broken <b", "u")[4] == ""


def test_streaming(spark, tmp_path):
    from lectern.streaming import events as stream

    rows = [(1, "view", "2024-01-01 00:00:00", 1), (1, "view", "2024-01-01 00:10:00", 2), (2, "click", "2024-01-01 05:00:00", 3)]
    e = spark.createDataFrame(rows, "user_id int, event_type string, ts string, event_id int")
    e.write.parquet(str(tmp_path / "in"))
    s = stream.observations(spark, str(tmp_path / "in"), e.schema)
    q = stream.counts(s).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("counted").collect()} == {(1, "view", 2), (2, "click", 1)}
