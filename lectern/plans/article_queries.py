"""Queries of sources, diagnostics, validators and the index on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import articles, blocks, diagnostics, index, rules, store
from ..sources import readers, sinks
from .registry import query
from .scalar_queries import SEARCH, words
from .text_queries import _md

@query("SELECT concat('https://own.org/p/', page_id) AS loc, concat('https://own.org/map/', page_id % 50) AS map FROM pages WHERE page_id % 50 BETWEEN 1 AND 29")
def src20_sitemap_walk(t):
    """Fifty maps that name all pages, and an index of them that names itself as well; it leads to the first 29."""
    k = (F.col("page_id") % 50).cast("string")
    loc = F.concat(F.lit("<url><loc>https://OWN.org/p/"), "page_id", F.lit("/?x=1</loc></url><url><loc>https://own.org/about</loc></url>"))
    body = t.pages.groupBy(F.concat(F.lit("https://own.org/map/"), k).alias("url")).agg(F.array_join(F.collect_list(loc), "").alias("body"))
    maps = body.select("url", F.concat(F.when(F.crc32("url") % 2 == 0, "<urlset>").otherwise("<urlset><broken>"), "body", F.lit("</urlset>")).alias("xml"))
    children = "".join(f"<sitemap><loc>https://own.org/map/{i}</loc></sitemap>" for i in range(1, 50))
    top = t.spark.createDataFrame([("https://own.org/sitemap.xml", f"<sitemapindex><sitemap><loc>https://own.org/sitemap.xml</loc></sitemap>{children}</sitemapindex>")], "url string, xml string")
    return readers.sitemap_walk(maps.unionByName(top), "https://own.org/sitemap.xml")[0].select("loc", "map")


@query("SELECT page_id, unnest([url, 'http://a.org/?x=1&y=2']) AS loc FROM pages")
def src20_src21_sitemap_locs(t):
    xml = F.concat(F.lit("<urlset><url><loc>"), "url", F.lit("</loc></url><url><loc> http://a.org/?x=1&amp;y=2</loc></url>"))
    return t.pages.select("page_id", F.explode(readers.sitemap_urls(xml)).alias("loc"))


@query("SELECT doc_id, doc_id::VARCHAR AS id, CASE WHEN source = 'src1' THEN 'own-slug' ELSE lang END AS slug FROM documents")
def src18_export_identity(t):
    x = readers.export_identity(F.concat_ws(".", F.col("doc_id").cast("string"), "lang"), F.when(F.col("source") == "src1", "own-slug").otherwise(" "))
    return t.documents.select("doc_id", x.alias("x")).select("doc_id", "x.id", "x.slug")


@query("SELECT count(*)::BIGINT AS rows, count(*) FILTER (WHERE lang = 'en' AND doc_id % 3 = 0)::BIGINT AS imported, count(*) FILTER (WHERE lang <> 'en')::BIGINT AS unpublished, count(*) FILTER (WHERE lang = 'en' AND doc_id % 3 <> 0)::BIGINT AS bodiless FROM documents")
def src17_src19_author_export(t):
    posts = t.documents.select(F.concat_ws(".", F.col("doc_id").cast("string"), F.lit("slug")).alias("post_id"), F.when(F.col("lang") == "en", " True ").otherwise("no").alias("is_published"))
    bodies = t.documents.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body"))
    return readers.author_export(posts, bodies)[2]


@query("SELECT doc_id, len(string_split(text, chr(10)))::INT AS pages, list_sum(list_transform(string_split(text, chr(10)), lambda p: length(trim(p))))::INT AS text_chars, len(list_filter(string_split(text, chr(10)), lambda p: length(trim(p)) >= 20))::INT AS nonempty_pages FROM documents")
def src31_src32_agg25_page_metrics(t):
    d = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("p"))
    return readers.page_metrics(d, "doc_id", "p").drop("low_text_pages")


@query()
def tvf21_all_matches(t):
    return readers.all_matches(t.documents, "doc_id", "text", "thing", 20, 20)


@query("SELECT DISTINCT concat('https://', lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', ''), ''), '/')) AS identity FROM pages")
def src15_known_urls(t):
    return readers.known_urls(t.pages, "url")


@query("SELECT doc_id FROM documents WHERE source IN (SELECT concat('src', item_id) FROM benchmark) AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def src14_prj14_gold_entries(t):
    gold = t.documents.join(t.labels, "doc_id").select("doc_id", F.col("source").alias("path"), (F.col("quality") == 1).alias("approved"))
    return readers.gold_articles(gold, t.benchmark.select(F.concat(F.lit("src"), "item_id").alias("path"))).select("doc_id")


@query()
def agg20_tic_report(t):
    d = t.documents.select("doc_id", F.concat(F.lit("It is not this.\nBut not that but the other; however\n"), "text").alias("m"))
    return diagnostics.tics(d, "doc_id", "m").select("doc_id", "phrase", "count", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


def _project(t):
    """Projects of three files each: a document as an article, its source rows and its search package; others are missing."""
    d = t.documents.select("doc_id", F.concat(F.lit("# T\n\n"), F.replace("text", F.lit("["), F.lit("(")), F.lit("\n\nsee [a memo](https://e.org/1)\n\n[[SHARE]]\n")).alias("article"))
    k = F.col("doc_id").cast("string")
    rows = F.concat(F.lit("source_number,phrase,link\n1,a memo,https://e.org/1\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("1,a memo,https://e.org/"), k, F.lit("?utm_source=x\n"))).otherwise(F.lit("x,\"quoted, phrase\",ftp://e.org\n2,only\n")))
    seo = F.concat(F.lit("## Meta Title\nT\n## URL Slug\n"), F.when(F.col("doc_id") % 3 == 0, "slug").otherwise(""), F.lit("\n## Primary Keyword\nk\n"))
    files = F.array(*[F.struct(F.lit(n).alias("name"), x.alias("text")) for n, x in (("output/article.md", F.col("article")), ("output/sources.csv", rows), ("output/seo.md", seo))])
    return d.select("doc_id", F.explode(files).alias("f")).select("doc_id", "f.name", "f.text")


@query(
    "SELECT doc_id, code, detail FROM documents, (SELECT unnest(['source row: positive number used once', 'source row: repeated phrase or URL', 'source row: phrase not linked to its URL', 'source row: unclean URL']) AS code, '3' AS detail) WHERE doc_id % 2 = 0 "
    "UNION ALL SELECT doc_id, code, detail FROM documents, (SELECT unnest(['source row: positive number used once', 'source row: phrase not linked to its URL', 'source row: invalid URL']) AS code, '3' AS detail) WHERE doc_id % 2 = 1 "
    "UNION ALL SELECT doc_id, 'source row: phrase not in article', '3' FROM documents WHERE doc_id % 2 = 1 AND NOT contains(text, 'quoted, phrase') UNION ALL SELECT doc_id, 'source row: three filled fields', '4' FROM documents WHERE doc_id % 2 = 1 "
    "UNION ALL SELECT doc_id, 'search package', f FROM documents, (SELECT unnest(" + words([x for x in fixed.PROJECT["search fields"] if x not in ("Meta Title", "Primary Keyword", "URL Slug")]) + ") AS f) UNION ALL SELECT doc_id, 'search package', 'URL Slug' FROM documents WHERE doc_id % 3 <> 0 "
    "UNION ALL SELECT doc_id, 'deliverable', 'output/' || f FROM documents, (SELECT unnest(['research_dossier.md', 'outline.md', 'audit.md']) AS f)"
)
def prj17_project_findings(t):
    from ..operators import projects

    known = t.spark.createDataFrame([("https://own.org/p/1",)], "canonical_url string")
    found = projects.findings(_project(t), "doc_id", ["own.org"], known).where("severity = 'error'")
    return found.where("code LIKE 'source row%' OR code IN ('search package', 'deliverable')").select("doc_id", "code", "detail")


@query()
def agg21_editorial_style(t):
    """All metrics and warnings of documents as articles, with the rhetoric found in them."""
    return diagnostics.editorial_style(_md(t), "doc_id", "m", within=True)


@query()
def agg21_style_diagnostics(t):
    return rules.judged(diagnostics.style(_md(t), "doc_id", "m"), diagnostics.style_rules())


@query()
def sca36_assertion_types(t):
    s = t.documents.select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("n", "s"))
    return s.groupBy(diagnostics.assertion_type(F.col("s")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN NOT regexp_matches(lower(h), '[$£€]|\\b(budget|funding|funds|cost|financial|allocation|line item)\\b') THEN 'figure or funding mechanism' END AS problem FROM (SELECT doc_id, text AS h FROM documents)")
def prj28_hooks(t):
    return t.documents.select("doc_id", articles.hook_problem(F.lit("MONEY"), F.col("text")).alias("problem"))


@query(r"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[\p{L}\p{N}_]([\p{L}\p{N}_’''-]*[\p{L}\p{N}_])?')) < 100 THEN 'REDDIT_STANDALONE_DEPTH' END AS issue FROM documents")
def prj30_platform_fit(t):
    return t.documents.select("doc_id", rules.platform_issue(F.lit("reddit"), F.lit("POST"), text.copy_word_count(F.col("text")), F.lit(0)).alias("issue"))


@query("SELECT doc_id AS key, CASE WHEN quality IS NULL THEN 'no candidates' WHEN toxic = 1 THEN 'pending review' ELSE 'ready to promote' END AS state FROM documents LEFT JOIN labels USING (doc_id)")
def prj22_snk26_learning_states(t):
    flags = t.documents.select(F.col("doc_id").alias("key"), F.lit(True).alias("has_snapshot"), F.lit(True).alias("has_final"), F.lit(True).alias("has_diff"))
    c = t.labels.select(F.col("doc_id").alias("key"), F.when(F.col("toxic") == 1, "pending").otherwise("approved").alias("status"))
    return articles.learning_state(flags, c)


@query("SELECT doc_id::VARCHAR AS canonical_url FROM documents WHERE doc_id % 4 = 0")
def snk14_access_reconcile(t):
    a = t.documents.select(F.col("doc_id").cast("string").alias("canonical_url"), F.lit("full").alias("content_status"), F.concat("text", F.when(F.col("doc_id") % 4 == 0, " This post is for subscribers").otherwise("")).alias("body"))
    return articles.access_reconciled(a).select("canonical_url")


@query("SELECT l.doc_id, sum(len(string_split_regex(trim(x), '\\s+')))::BIGINT AS words, CASE WHEN sum(len(string_split_regex(trim(x), '\\s+'))) >= 300 THEN 'error' ELSE 'warning' END AS severity FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) l WHERE len(string_split_regex(trim(x), '\\s+')) >= 40 GROUP BY l.doc_id")
def prj18_series_repeats(t):
    from ..operators.similarity import fingerprints

    return articles.repeated_parts(fingerprints(t.documents, "doc_id", F.split("text", "\n")), "doc_id").select("doc_id", "words", "severity")


@query()
def snk15_tvf01_chunks(t):
    a = _md(t).select(F.format_string("https://own.org/p/%s", F.col("doc_id").cast("string")).alias("canonical_url"), F.lit("T").alias("title"), F.col("m").alias("body"))
    return index.chunked(a).select("canonical_url", "section", "start", F.md5("text").alias("digest"), F.size("links").alias("n_links"))


_LIST = {k: words(v) for k, v in (("junk", [*fixed.GENERIC_TERMS, *fixed.CONCEPT_JUNK]), ("hard", fixed.CONCEPT_HARD_JUNK), ("infra", fixed.INFRASTRUCTURE_TERMS))}


@query(
    f"WITH d AS (SELECT doc_id, {SEARCH} AS t, contains(lower(text), 'ention') AS seed FROM documents), n AS (SELECT count(*) AS n, greatest(1, count(*) FILTER (WHERE seed))::DOUBLE AS s FROM d), "
    "g AS (SELECT doc_id, seed, unnest(t) AS term FROM d UNION SELECT doc_id, seed, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM d UNION SELECT doc_id, seed, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM d), "
    "f AS (SELECT term, string_split(term, ' ') AS w, count(*) AS df, count(*) FILTER (WHERE seed) AS k, regexp_matches(term, '[0-9]') AS digit FROM g GROUP BY term), "
    f"r AS (SELECT *, len(list_filter(w, lambda x: list_contains({_LIST['infra']}, x))) AS infra FROM f WHERE k > 0), "
    f"c AS (SELECT term, k / s * least(3.0, ln((n + 1.0) / (df + 1.0)) + 1) * (1.0 + 0.42 * least(2, len(w) - 1)) * (CASE WHEN infra > 0 THEN 1.15 ELSE 1.0 END + CASE WHEN digit THEN 0.15 ELSE 0.0 END) AS score FROM r, n WHERE length(term) >= 3 AND NOT list_has_any(w, ['ention', 'surveillance']) AND "
    f"CASE WHEN len(w) = 1 THEN NOT list_contains({_LIST['junk']}, term) AND (infra > 0 OR digit OR (length(term) <= 6 AND regexp_matches(term, '^[a-z]+$') AND df <= 0.10 * n) OR (length(term) >= 7 AND df <= 0.14 * n)) "
    f"ELSE len(list_filter(w, lambda x: NOT list_contains({_LIST['junk']}, x))) > 0 AND NOT list_has_any(w, {_LIST['hard']}) AND (len(w) = 2 OR infra >= 2 OR digit) END), "
    "b AS (SELECT term, row_number() OVER (ORDER BY score DESC, term DESC) AS pos FROM c QUALIFY pos <= 72), "
    "k AS (SELECT term, pos FROM b WHERE contains(term, ' ') OR NOT EXISTS (SELECT 1 FROM b e WHERE e.pos < b.pos AND contains(e.term, b.term))) "
    "SELECT (row_number() OVER (ORDER BY pos) - 1)::INT AS rank, term AS concept FROM k QUALIFY rank < 18"
)
def txt09_srt11_concepts(t):
    names = index.expanded_concepts(t.documents, "doc_id", "text", ["ention"], "ention surveillance")
    return t.spark.createDataFrame([(i, n) for i, n in enumerate(names)], "rank int, concept string")


