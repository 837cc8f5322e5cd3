"""Queries that apply the store, evidence, diagnostics, similarity and rendering operators to whole test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, search, text
from ..operators import articles, blocks, diagnostics, evidence, repair, retrieval, rules, similarity, store
from ..sources import html, readers, sinks
from .registry import query
from .scalar_queries import ALNUM, SEARCH, squeezed, words
from .text_queries import MARKDOWN, _md

#: Articles made of documents: a date that some lack, a status, a body's hash.
_ARTICLES = "SELECT doc_id AS id, concat('https://own.org/p/', doc_id) AS canonical_url, CASE WHEN doc_id % 10 <> 0 THEN printf('20%02d-%02d-11', 20 + doc_id % 5, 1 + doc_id % 12) END AS published_date, CASE WHEN doc_id % 3 = 0 THEN 'preview_only' ELSE 'full' END AS content_status, sha256(text) AS content_hash, n_chars AS word_count, source, text FROM documents"


def _articles(t):
    k = F.col("doc_id")
    date = F.when(k % 10 != 0, F.format_string("20%02d-%02d-11", 20 + k % 5, 1 + k % 12))
    return t.documents.select(
        k.alias("id"), F.concat(F.lit("https://own.org/p/"), k).alias("canonical_url"), date.alias("published_date"), F.when(k % 3 == 0, "preview_only").otherwise("full").alias("content_status"),
        text.content_hash(F.col("text")).alias("content_hash"), F.col("n_chars").alias("word_count"), "source", "text",
    )


@query(f"SELECT id, published_date FROM ({_ARTICLES}) ORDER BY coalesce(published_date, '') DESC, id DESC")
def src01_src07_listed(t):
    return store.listed(_articles(t)).select("id", "published_date")


@query(f"SELECT id, content_hash FROM ({_ARTICLES}) WHERE canonical_url = 'https://own.org/p/7'")
def src02_looked_up(t):
    return store.looked_up(_articles(t), "https://own.org/p/7").select("id", "content_hash")


@query("SELECT l_linenumber AS id, l_returnflag AS anchor, concat('https://e.org/', l_partkey) AS url, 'external_research' AS type FROM lineitem WHERE l_orderkey = (SELECT o_orderkey FROM orders WHERE concat('https://own.org/p/', o_orderkey) = 'https://own.org/p/1')")
def src03_links_of(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("https://own.org/p/"), "o_orderkey").alias("canonical_url"))
    l = t.lineitem.select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("anchor"), F.concat(F.lit("https://e.org/"), "l_partkey").alias("url"), F.lit("external_research").alias("link_kind"))
    return store.links_of(l, a, "https://own.org/p/1")


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events")
def src13_src06_tolerant_json(t):
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("not "), "props")).otherwise(F.col("props"))
    return t.events.select("event_id", readers.tolerant_json(raw, "k string").alias("x")).select("event_id", "x.k")


@query("SELECT l_orderkey, l_linenumber, s_name AS source_title, CASE WHEN s_suppkey % 2 = 0 THEN concat('https://s.org/', s_suppkey) ELSE concat('file-', s_suppkey) END AS locator FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def jon01_jon02_evidence_with_sources(t):
    k = F.col("s_suppkey")
    s = t.supplier.select(k.alias("id"), F.col("s_name").alias("title"), F.when(k % 2 == 0, F.concat(F.lit("https://s.org/"), k)).alias("url"), F.concat(F.lit("file-"), k).alias("file_path"))
    return store.with_sources(t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("source_id")), s).select("l_orderkey", "l_linenumber", "source_title", "locator")


@query(
    "WITH j AS (SELECT doc_id, coalesce(5 * toxic + quality, 1) AS judged, CASE WHEN quality IS NULL THEN 'unjudged' WHEN quality = 1 THEN 'strong' ELSE 'weak' END AS relationship, doc_id % 7 = 0 AS direct, contains(text, 'thanedble') AS phrase FROM documents LEFT JOIN labels USING (doc_id)) "
    "SELECT doc_id, judged::INT AS judged, relationship, direct OR phrase OR judged >= 4 AS included FROM j"
)
def jon03_jon04_srt03_reranked(t):
    c = t.documents.select(F.col("doc_id").alias("wr_id"), F.when(F.col("doc_id") % 7 == 0, "DIRECT").otherwise("RELATED").alias("tier"), F.when(F.contains("text", F.lit("thanedble")), F.array(F.lit("thanedble"))).otherwise(F.array().cast("array<string>")).alias("phrases"), F.col("n_chars").cast("double").alias("score"))
    j = t.labels.select(F.col("doc_id").alias("wr_id"), (5 * F.col("toxic") + F.col("quality")).alias("score"), F.when(F.col("quality") == 1, "strong").otherwise("weak").alias("relationship"), F.lit(1).alias("seq"))
    # an earlier judgment, which the last one replaces
    first = j.select("wr_id", F.lit(9).cast(j.schema["score"].dataType).alias("score"), F.lit("first").alias("relationship"), F.lit(0).alias("seq"))
    return evidence.reranked(c, j.unionByName(first)).select(F.col("wr_id").alias("doc_id"), F.col("judged").cast("int").alias("judged"), "relationship", "included")


_LAST = "array_to_string(list_slice(w, greatest(1, len(w) - 4), len(w)), ' ')"
_WORD = r"[\p{L}\p{N}_]([\p{L}\p{N}_''-]*[\p{L}\p{N}_])?"


@query(
    rf"WITH m AS (SELECT doc_id, {squeezed('lower(text)')} AS c, CASE WHEN doc_id % 2 = 0 THEN 'the attion' END AS phrase, doc_id % 50 AS u FROM documents WHERE doc_id % 7 <> 0), "
    "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY doc_id) AS rn FROM m) WHERE rn = 1), "
    f"x AS (SELECT doc_id, c, u, phrase, regexp_extract_all(c, '{_WORD}') AS w, CASE WHEN contains(c, 'thanedble the') THEN 'thanedble the' WHEN contains(c, 'ention') THEN 'ention' END AS entity FROM f) "
    f"SELECT row_number() OVER (ORDER BY doc_id) AS number, CASE WHEN contains(c, phrase) THEN phrase ELSE coalesce(entity, {_LAST}) END AS phrase, concat('https://e.org/', u) AS link, printf('EV-%04d', doc_id) AS evidence_id FROM x"
)
def jon05_sca20_source_rows(t):
    k = F.col("doc_id")
    d = t.documents.select(F.format_string("EV-%04d", k).alias("evidence_id"), k.alias("pos"), text.squeezed(F.lower("text")).alias("context"), k.alias("k"))
    url = F.when(F.col("k") % 7 != 0, F.concat(F.lit("https://e.org/"), F.col("k") % 50))
    e = d.select("evidence_id", url.alias("url"), F.array(F.lit("Ention"), F.lit("thanedble THE")).alias("entities"))
    a = d.where("k % 2 = 0").select("evidence_id", F.lit("the attion").alias("phrase"))
    return evidence.source_rows(d.select("evidence_id", "pos", "context"), a, e)


@query("SELECT doc_id, printf('EV-%04d', doc_id % 150) AS evidence_id FROM documents WHERE doc_id % 150 NOT IN (SELECT item_id FROM benchmark)")
def jon10_unknown_marks(t):
    mark = F.format_string("[[EV-%04d]]", F.col("doc_id") % 150)
    d = t.documents.select("doc_id", F.concat("text", F.lit(" "), mark, F.lit(" again "), mark).alias("m"))
    return evidence.unknown_marks(d, "doc_id", "m", t.benchmark.select(F.format_string("EV-%04d", "item_id").alias("evidence_id")))


@query("SELECT canonical_url FROM (" + _ARTICLES + ") WHERE id NOT IN (SELECT doc_id FROM labels)")
def jon09_missing_from_discovery(t):
    return store.missing_from(_articles(t).select("canonical_url"), t.labels.select(F.concat(F.lit("https://own.org/p/"), "doc_id").alias("canonical_url")))


@query(
    "WITH a AS (SELECT c_custkey AS k, 2 * c_nationkey + 60 AS synced FROM customer WHERE c_acctbal > 0) "
    "SELECT event_id, user_id FROM events LEFT JOIN a ON k = user_id WHERE k IS NULL OR CASE WHEN event_id % 4 <> 0 THEN event_id % 100 END > synced"
)
def jon11_jon12_incremental_sync(t):
    a = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("canonical_url"), (2 * F.col("c_nationkey") + 60).alias("last_synced"))
    e = t.events.select("event_id", F.col("user_id").alias("canonical_url"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 100).alias("lastmod"))
    return store.to_sync(e, a).select("event_id", F.col("canonical_url").alias("user_id"))


@query("SELECT d.doc_id AS assertion_id, b.item_id::VARCHAR AS claim_id, md5(b.text) AS claim FROM documents d JOIN benchmark b ON b.item_id IN (d.doc_id % 97, d.doc_id % 13)")
def jon17_claims_of_assertions(t):
    k = F.col("doc_id")
    a = t.documents.select(k.alias("assertion_id"), F.concat_ws("|", (k % 97).cast("string"), F.lit(" "), (k % 13).cast("string")).alias("claim_ids"))
    c = t.benchmark.select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim_text"))
    return evidence.claims_of(a, c).select("assertion_id", "claim_id", F.md5("claim_text").alias("claim"))


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'kept' END, 'new') AS status, coalesce(toxic, -1)::INT AS mark FROM documents LEFT JOIN labels USING (doc_id)")
def jon19_prior_kept(t):
    prior = t.labels.select("doc_id", F.when(F.col("quality") == 1, "kept").alias("status"), F.col("toxic").cast("int").alias("mark"))
    return store.prior_kept(t.documents.select("doc_id", F.lit("new").alias("status"), F.lit(-1).alias("mark")), prior, "doc_id", ("status", "mark"))


@query("WITH o AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents WHERE doc_id % 3 = 0) SELECT n.doc_id, o.doc_id AS kept_id FROM n LEFT JOIN o ON o.text = n.text AND o.k = n.k")
def jon20_stable_ids(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return store.stable_ids(d.where("doc_id % 3 = 0"), d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), "h"), "h", "doc_id").select("doc_id", "kept_id")


@query("SELECT d.doc_id, i::BIGINT AS number FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jon21_gold_paragraphs(t):
    p = t.documents.select(F.col("doc_id").alias("article"), F.posexplode(F.split("text", "\n")).alias("at", "text")).select("article", (F.col("at") + 1).cast("long").alias("number"))
    g = t.labels.where("quality = 1").select(F.col("doc_id").alias("article"))
    return evidence.gold_paragraphs(p, g.unionByName(g)).select(F.col("article").alias("doc_id"), "number")


@query(f"SELECT count(*)::BIGINT AS articles, count(*) FILTER (WHERE content_status = 'full')::BIGINT AS \"full\", count(*) FILTER (WHERE content_status = 'preview_only')::BIGINT AS previews, count(DISTINCT content_hash)::BIGINT AS bodies, sum(word_count)::BIGINT AS words FROM ({_ARTICLES})")
def agg01_registry_counts(t):
    return store.registry_counts(_articles(t)).withColumn("words", F.col("words").cast("long"))


@query(f"SELECT coalesce(substring(published_date, 1, 4), 'undated') AS year, count(*)::BIGINT AS discovered, count(*) FILTER (WHERE content_status = 'full')::BIGINT AS \"full\", count(*) FILTER (WHERE content_status = 'preview_only')::BIGINT AS previews FROM ({_ARTICLES}) GROUP BY 1")
def agg08_snk19_by_year(t):
    return store.by_year(_articles(t))


_FOUND = "SELECT url, list_sort(list(s)) AS found_by FROM (SELECT DISTINCT url, s FROM (SELECT url, 'archive' AS s FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 'feed' FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT url, 'sitemap' FROM pages WHERE page_id % 5 <> 1)) GROUP BY url"


def _found(t):
    p = t.pages
    return store.discovered(archive=p.where("page_id % 2 = 0"), feed=p.where("page_id % 3 = 0"), sitemap=p.where("page_id % 5 <> 1"))


@query(f"SELECT url, array_to_string(found_by, ',') AS found_by FROM ({_FOUND})")
def set01_discovered(t):
    return _found(t).select("url", F.array_join("found_by", ",").alias("found_by"))


@query(f"SELECT s AS source, count(*)::BIGINT AS urls, count(*) FILTER (WHERE n = 1)::BIGINT AS alone FROM (SELECT unnest(found_by) AS s, len(found_by) AS n FROM ({_FOUND})) GROUP BY s")
def agg09_discovery_counts(t):
    return store.discovery_counts(_found(t))


_SENTENCES = rf"list_filter(string_split(regexp_replace({squeezed('{}')}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_NORM = "list_transform({}, lambda s: " + ALNUM.format("s") + ")"


@query(
    f"WITH d AS (SELECT doc_id, {_NORM.format(_SENTENCES.format('text'))} AS s, string_split({ALNUM.format('text')}, ' ') AS w FROM documents), "
    "x AS (SELECT doc_id, 'REPEATED_SENTENCE' AS code, unnest(s) AS t FROM d UNION ALL SELECT doc_id, 'REPEATED_CLOSING', s[-1] FROM d WHERE len(s) > 0), "
    "y AS (SELECT doc_id, code, t FROM x WHERE len(string_split(t, ' ')) >= 5 UNION ALL SELECT doc_id, 'REPEATED_PHRASE', array_to_string(list_slice(w, i, i + 7), ' ') FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)) "
    "SELECT code, md5(t) AS digest, count(DISTINCT doc_id)::BIGINT AS assets FROM y GROUP BY code, t HAVING count(DISTINCT doc_id) > CASE code WHEN 'REPEATED_SENTENCE' THEN 2 WHEN 'REPEATED_CLOSING' THEN 1 ELSE 3 END"
)
def agg12_boilerplate(t):
    return similarity.boilerplate(t.documents.select(F.col("doc_id").alias("content_id"), F.col("text").alias("copy"))).select("code", F.md5("text").alias("digest"), "assets")


@query("WITH x AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM documents), c AS (SELECT source, term, count(*) AS n FROM x GROUP BY ALL) SELECT source, term, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rn FROM c) WHERE rn <= 45")
def agg15_topical_terms(t):
    return similarity.topical_terms(t.documents, "source", text.every(F.lower("text"), "[a-z]{4,}"))


_WORDS = r"list_transform(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> ''), lambda p: len(string_split_regex(trim(p), '\s+'))::DOUBLE)"


@query(f"SELECT doc_id, len(n)::BIGINT AS paragraphs, round(list_avg(n), 6) AS mean, round(list_median(n), 6) AS median, round(CASE WHEN len(n) >= 2 THEN list_stddev_pop(n) / list_avg(n) END, 6) AS variation FROM (SELECT doc_id, {_WORDS} AS n FROM documents) WHERE len(n) > 0")
def agg17_agg18_paragraph_metrics(t):
    m = diagnostics.paragraph_metrics(t.documents, "doc_id", F.split("text", "\n"))
    return m.select("doc_id", "paragraphs", *[F.round(c, 6).alias(c) for c in ("mean", "median", "variation")])


@query("WITH l AS (SELECT regexp_extract_all(lower(l), '[a-z’'']+') AS w FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)) SELECT array_to_string(list_slice(w, 1, 2), ' ') AS opening, count(*)::BIGINT AS n FROM l WHERE len(w) > 0 GROUP BY 1 HAVING count(*) >= 3")
def agg22_openings(t):
    return diagnostics.openings(t.documents, F.split("text", "\n"))


@query(rf"SELECT page_id, phrase, count(*)::BIGINT AS n FROM (SELECT page_id, lower({squeezed('s')}) AS phrase FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(p|a|b)[^>]*>([a-zA-Z]+)', 2)) AS s FROM pages)) WHERE phrase <> '' GROUP BY page_id, phrase HAVING count(*) >= 2")
def agg23_repeated_emphasis(t):
    spans = F.regexp_extract_all("html", F.lit("<(p|a|b)[^>]*>([a-zA-Z]+)"), F.lit(2))
    return diagnostics.repeated_emphasis(t.pages, "page_id", spans)


def _article(t):
    """Documents as articles with links, marks and questions, as many as their numbers say."""
    k = F.col("doc_id")
    body = F.concat(F.lit("# Title\n\n"), "text", F.lit("\n\n[[SHARE]]\n\n[in](https://own.org/p/"), k % 3, F.lit(") [out](https://e.org/"), k, F.lit(")\n\n## FAQs\n\n"), F.repeat(F.lit("### Why?\n\nSo.\n\n"), (k % 7).cast("int")))
    return t.documents.select("doc_id", body.alias("m"))


@query("SELECT doc_id, 2 AS markdown_links, 1 AS internal_links, 1 AS external_links, 1 AS share_markers, 0 AS subscribe_markers, 1 AS faq_sections, (doc_id % 7)::INT AS faq_questions FROM documents")
def agg24_article_metrics(t):
    return articles.metrics(_article(t), "doc_id", "m", ["own.org"]).select("doc_id", "markdown_links", "internal_links", "external_links", "share_markers", "subscribe_markers", "faq_sections", "faq_questions")


@query("SELECT doc_id, unnest(['related section', 'image_markers present', 'subscribe_markers present']) AS rule FROM documents UNION ALL SELECT doc_id, 'one FAQ section of so many questions' FROM documents WHERE doc_id % 7 <> 5")
def prj17_article_violations(t):
    return rules.violations(articles.metrics(_article(t), "doc_id", "m", ["own.org"]), "doc_id", articles.article_rules()).where("severity = 'error'").select("doc_id", "rule")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents GROUP BY sha256(text)")
def win02_first_bodies(t):
    return store.first_by(t.documents.select("doc_id", text.content_hash(F.col("text")).alias("h")), [F.col("h")], F.col("doc_id"))


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 60)) WHERE rn <= 2 ORDER BY n_chars DESC, doc_id LIMIT 8")
def srt02_win03_capped(t):
    return search.capped(t.documents.select("doc_id", "source", "n_chars"), "source", 2, 8, 60, F.col("n_chars").desc(), F.col("doc_id"))


_CLAUSES = r"list_filter(list_transform(string_split_regex(s, '(?i)\s+(?:while|but|yet|whereas)\s+|;\s*'), lambda p: trim(p)), lambda p: p <> '')"


@query(
    rf"WITH p AS (SELECT conv_id, turn, list_concat(flatten(list_transform({_SENTENCES.format('text')}, lambda s: {_CLAUSES})), ['Read on.', 'Share it']) AS a FROM conversations), "
    "x AS (SELECT conv_id, turn, unnest(a) AS t, generate_subscripts(a, 1) AS number, len(a) AS n FROM p) "
    "SELECT printf('%d-%d', conv_id, turn) AS content_id, CASE WHEN number > n - 2 THEN 'CTA' ELSE 'BODY' END AS text_section, printf('AST-%d-%d-%02d', conv_id, turn, number) AS assertion_id, md5(t) AS digest FROM x"
)
def win05_tvf18_tvf19_snk36_assertion_rows(t):
    a = t.conversations.select(F.format_string("%d-%d", "conv_id", "turn").alias("content_id"), F.col("text").alias("body_copy"), F.lit("Read on. Share it").alias("cta_text"))
    return evidence.assertion_rows(a).select("content_id", "text_section", "assertion_id", F.md5("assertion_text").alias("digest"))


@query("SELECT conv_id, turn, lag(concat('part-', turn)) OVER w AS previous, lead(concat('part-', turn)) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def win06_snk37_linked_parts(t):
    return store.linked_parts(t.conversations.select("conv_id", "turn", F.concat(F.lit("part-"), "turn").alias("slug")), "conv_id", "turn", "slug").drop("slug")


_TOLD = "concat(text, CASE turn % 3 WHEN 0 THEN ' a claim of a plot' WHEN 1 THEN ' not enough, it fails' ELSE ' more important: unsupported' END, CASE WHEN conv_id % 4 = 0 THEN ' https://own.org/p/1 not evidence of' ELSE '' END)"


def _has(p: str) -> str:
    return "regexp_matches(text, '" + p.replace("'", "''") + "')::INT"


@query(
    f"WITH b AS (SELECT conv_id, turn, {_TOLD} AS text FROM conversations), f AS (SELECT conv_id, turn, {_has(fixed.TRIGGER)} = 1 AS t, sum({_has(fixed.BOUNDARY)}) OVER a AS nb, sum({_has(fixed.REDIRECT)}) OVER a AS nr, "
    f"sum({_has(fixed.BOUNDARY)}) OVER s AS near, count(*) OVER s AS n, contains(lower(text), 'own.org') AND {_has(fixed.CALLBACK_DENIED)} = 1 AS denied FROM b "
    "WINDOW a AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING), s AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)), "
    "c AS (SELECT conv_id, turn, unnest(['DEFENSIVE SEQUENCE', 'CONTRIVED DIALECTIC', 'PREMATURE ADJUDICATION']) AS category FROM f WHERE t AND nb >= 2 AND nr >= 1 UNION ALL SELECT conv_id, turn, 'NARRATIVE STAGNATION' FROM f WHERE near >= 3 AND n = 6 UNION ALL SELECT conv_id, turn, 'CANON DEFENSIVENESS' FROM f WHERE denied) "
    "SELECT conv_id, category, min(turn) AS line FROM c GROUP BY ALL"
)
def win07_win08_sca53_rhetoric(t):
    b = t.conversations.select("conv_id", F.col("turn").alias("line"), F.expr(_TOLD.replace("'", '"')).alias("text"))
    return diagnostics.rhetoric(b, "conv_id", "own.org")


@query(
    rf"WITH s AS (SELECT doc_id, {_SENTENCES.format('x')} AS s, len(string_split_regex(trim(x), '\s+')) AS n FROM (SELECT doc_id, concat(text, ' I cannot prove it. We should be careful. To be precise, no.') AS x FROM documents)) "
    "SELECT doc_id, c::INT AS caution, len(s) >= 3 AND c >= 2 AND n <= 120 AS dense FROM (SELECT *, len(list_filter(s, lambda x: regexp_matches(x, '" + fixed.CAUTION.replace("'", "''") + "'))) AS c FROM s)"
)
def agg19_caution_density(t):
    p = F.concat("text", F.lit(" I cannot prove it. We should be careful. To be precise, no."))
    return t.documents.select("doc_id", diagnostics.caution_density(p).alias("x")).select("doc_id", "x.caution", "x.dense")


@query("SELECT event_id, concat('[{\"title\":\"', event_type, '\",\"url\":\"https://e.org/', user_id, '\"}]') AS citations_json FROM events")
def snk09_appended_runs(t):
    r = t.events.select("event_id", F.array(F.struct(F.col("event_type").alias("title"), F.concat(F.lit("https://e.org/"), "user_id").alias("url"))).alias("citations"))
    return sinks.appended_run(r).select("event_id", "citations_json")


@query("SELECT doc_id, sha256(text) AS h, concat('WR-', printf('%06d', doc_id)) AS id, round(n_chars / 7.0, 4) AS score FROM documents")
def snk34_audit_rows(t):
    r = t.documents.select(F.format_string("WR-%06d", "doc_id").alias("wr_id"), F.lit(True).alias("included"), F.lit(1).alias("judged"), (F.col("n_chars") / F.lit(7.0)).alias("score"), F.lit("x").alias("relationship"), "doc_id", "text")
    return r.drop("score").join(sinks.audit_rows(r).select("wr_id", "score"), "wr_id").select("doc_id", F.sha2("text", 256).alias("h"), F.col("wr_id").alias("id"), "score")


_STATE = "CASE WHEN quality = 1 AND doc_id % 2 = 0 THEN 'promoted' WHEN quality = 1 THEN 'approved' ELSE 'pending' END"


@query(f"SELECT doc_id, {_STATE} AS status FROM labels")
def snk26_promoted(t):
    c = t.labels.select("doc_id", F.when(F.col("quality") == 1, "approved").otherwise("pending").alias("status"), F.when(F.col("doc_id") % 2 == 0, "global").otherwise("article-specific").alias("scope"))
    every, moved = articles.promoted(c)
    return every.join(moved.select("doc_id", F.lit(True).alias("moved")), "doc_id", "left").select("doc_id", F.when(F.col("moved"), "promoted").otherwise(F.col("status")).alias("status"))


@query("SELECT lang AS linked, count(*)::BIGINT AS n, count(DISTINCT source)::BIGINT AS phrases FROM documents GROUP BY lang")
def snk30_link_report(t):
    return sinks.link_report(t.documents.select(F.col("lang").alias("linked"), F.col("source").alias("phrase")))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS state FROM customer UNION ALL SELECT -1, 'new' UNION ALL SELECT user_id, 'error' FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)")
def snk12_refreshed(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("long").alias("canonical_url"), F.lit("old").alias("content_hash"), F.lit("full").alias("content_status"))
    new = c.where("id % 5 = 0").select(F.col("id").alias("seq"), "canonical_url", F.lit("new").alias("content_hash"), "content_status")
    extra = new.limit(1).select(F.lit(0).cast(new.schema["seq"].dataType).alias("seq"), F.lit(-1).cast("long").alias("canonical_url"), "content_hash", "content_status")
    errors = t.events.select(F.col("user_id").cast("long").alias("canonical_url")).distinct()
    kept, left = store.refreshed(c, errors, new.unionByName(extra))
    return kept.select(F.col("canonical_url").alias("k"), "state").unionByName(left.select(F.col("canonical_url").alias("k"), F.lit("error").alias("state")))


@query(
    "WITH u AS (SELECT doc_id, source, lang, n_chars FROM documents), one AS (SELECT 0 AS step, list_position(['src1', 'src0', 'src9999'], source) AS pos, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM u WHERE source IN ('src1', 'src0', 'src9999')) WHERE rn = 1), "
    "two AS (SELECT 1, list_position(['fr', 'en', 'de'], lang), doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM u WHERE lang IN ('fr', 'en', 'de') AND doc_id NOT IN (SELECT doc_id FROM one)) WHERE rn = 1), "
    "p AS (SELECT * FROM one UNION ALL SELECT * FROM two), e AS (SELECT * FROM p UNION ALL SELECT 2, 0, doc_id FROM u WHERE doc_id NOT IN (SELECT doc_id FROM p)) "
    "SELECT doc_id, source, lang FROM e JOIN u USING (doc_id) ORDER BY step, pos, n_chars DESC, doc_id LIMIT 9"
)
def srt09_examples(t):
    d = t.documents.select("doc_id", "source", "lang", "n_chars")
    return store.examples(d, "doc_id", ("source", ["src1", "src0", "src9999"]), ("lang", ["fr", "en", "de"]), "n_chars", 9).drop("n_chars")


@query("SELECT source, min(doc_id) AS doc_id FROM (SELECT source, doc_id, n_chars, max(n_chars) OVER (PARTITION BY source) AS m FROM documents) WHERE n_chars = m GROUP BY source ORDER BY source LIMIT 6")
def srt09_stratified(t):
    return store.stratified(t.documents.select("source", "doc_id", "n_chars"), "source", [F.col("n_chars").desc(), F.col("doc_id")], 6).select("source", "doc_id")


@query("WITH q AS (SELECT list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_-]{2,}'), lambda x: lower(x)), lambda t: length(t) >= 4)) AS q FROM benchmark WHERE item_id = 0), d AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_-]{2,}'), lambda x: lower(x)), lambda t: length(t) >= 4)) AS d FROM documents) SELECT doc_id, round(len(list_intersect(q, d)) / greatest(1, len(q)), 6) AS score FROM d, q ORDER BY score DESC, doc_id LIMIT 20")
def srt04_local_rank(t):
    q = t.benchmark.where("item_id = 0").select(text.local_terms(F.col("text")).alias("q"))
    return search.local_rank(t.documents, "doc_id", text.local_terms(F.col("text")), q, 20).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, n::BIGINT AS n FROM (SELECT doc_id, len(string_split(lower(text), 'thing')) - 1 + len(string_split(lower(text), 'ention')) - 1 AS n FROM documents) WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 4")
def srt06_gold_rank(t):
    return search.gold_rank(t.documents, "doc_id", F.col("text"), ["thing", "ention"])


@query("SELECT doc_id, contains(lower(text), 'the attion') AS first, contains(lower(text), source) AS second, contains(lower(concat(text, ' of a longer path')), 'longer path') AS third FROM documents")
def tvf04_links_in_piece(t):
    links = F.array(*[F.struct(a.alias("anchor"), F.lit(u).alias("url")) for a, u in ((F.lit("The Attion"), "1"), (F.col("source"), "2"), (F.lit("longer path"), "3"))])
    x = t.documents.select("doc_id", F.transform(blocks.links_in_piece(links, F.col("text"), F.concat("text", F.lit(" of a longer path"))), lambda l: l["url"]).alias("u"))
    return x.select("doc_id", F.array_contains("u", "1").alias("first"), F.array_contains("u", "2").alias("second"), F.array_contains("u", "3").alias("third"))


@query("SELECT doc_id, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS own, concat('end of ', source) AS last, '' AS none FROM documents")
def tvf15_markdown_section(t):
    m = F.concat(F.lit("# T\n\n## The Text\n\n"), F.regexp_replace("text", "(?m)^##", "--"), F.lit("\n\n## LAST (one)\nend of "), "source")
    return t.documents.select("doc_id", F.md5(blocks.markdown_section(m, "the text")).alias("own"), blocks.markdown_section(m, "Last (one)").alias("last"), blocks.markdown_section(m, "gone").alias("none"))


@query(r"SELECT doc_id, concat(trim(source), ',', trim(lang)) AS cells, doc_id % 3 = 0 AS separator FROM documents")
def tvf24_tvf25_tables(t):
    line = F.concat(F.lit("| "), "source", F.lit(" | "), "lang", F.lit(" |"))
    k = F.col("doc_id") % 3
    rule = F.when(k == 0, "|:---|---:|").when(k == 1, "|:--|---|").otherwise(line)
    return t.documents.select("doc_id", F.array_join(blocks.table_cells(line), ",").alias("cells"), blocks.is_table_separator(rule).alias("separator"))


@query("SELECT doc_id, regexp_matches(text, '[.!?][\"”’'']*$') AND length(replace(text, '“', '')) = length(replace(text, '”', '')) AND (length(text) - length(replace(text, '\"', ''))) % 2 = 0 AS whole FROM documents")
def prj31_complete_sentence(t):
    return t.documents.select("doc_id", text.complete_sentence(F.regexp_replace("text", r"\n\z", "\n ")).alias("whole"))


@query(r"SELECT doc_id, md5(concat(regexp_replace(text, '^\s+|\s+$', '', 'g'), CASE WHEN source = 'src0' THEN '' ELSE concat(chr(10), chr(10), source) END)) AS copy FROM documents")
def sca37_rendered(t):
    tail = F.when(F.col("source") == "src0", " \n").otherwise(F.concat(F.lit("\n"), "source", F.lit(" ")))
    return t.documents.select("doc_id", F.md5(text.rendered(F.concat(F.lit("\n "), "text", F.lit("  \n")), tail)).alias("copy"))


@query(
    "SELECT doc_id, md5(array_to_string(list_transform(list_slice(list_filter(" + _SENTENCES.format("text") + r", lambda s: regexp_matches(s, '(?i)\b(does not prove|do not prove|no (primary )?evidence|record does not|records do not|cannot establish|unconfirmed|uncorroborated|according to|told|recalled|alleged|uncertain|unclear|disputed|not established|not documented|at minimum)\b')), 1, 20), lambda s: substring(s, 1, 700)), '|')) AS qualified "
    "FROM (SELECT doc_id, replace(replace(text, ' the ', ' alleged '), ' la ', ' told ') AS text FROM documents)"
)
def tvf27_qualification_sentences(t):
    x = F.replace(F.replace("text", F.lit(" the "), F.lit(" alleged ")), F.lit(" la "), F.lit(" told "))
    return t.documents.select("doc_id", F.md5(F.array_join(blocks.qualification_sentences(x), "|")).alias("qualified"))


@query("SELECT conv_id AS series, CASE WHEN count(*) FILTER (WHERE role <> 'user') = 0 AND max(turn) % 2 = 0 THEN 'complete' WHEN count(*) FILTER (WHERE turn % 3 <> 1 OR role = 'user') > 0 THEN 'active' ELSE 'planned' END AS status FROM conversations GROUP BY conv_id")
def snk24_series_status(t):
    status = F.when(F.col("role") == "user", "complete").when(F.col("turn") % 3 != 1, "drafting").otherwise("planned")
    p = t.conversations.select(F.col("conv_id").alias("series"), F.col("turn").alias("number"), (F.col("turn") % 2 == 0).alias("finale"), status.alias("status"))
    return store.series_status(p)


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN NULL WHEN doc_id % 5 = 2 THEN NULL ELSE concat('/new/', lang, '/', source) END AS resolved_dir FROM documents")
def src05_resolved_dirs(t):
    k = F.col("doc_id") % 5
    old = F.when(k == 1, F.concat(F.lit("../up/"), "lang", F.lit("/"), "source")).when(k == 2, "/old/no/where").when(k == 3, F.concat(F.lit("C:\\old\\"), "lang", F.lit("\\"), "source")).otherwise(F.concat(F.lit("/old/"), "lang", F.lit("/"), "source", F.lit("/")))
    listing = t.documents.select(F.concat_ws("/", F.lit("/new"), "lang", "source").alias("path")).distinct()
    return store.resolved_dirs(t.documents.select("doc_id", old.alias("local_dir")), listing).select("doc_id", "resolved_dir")


@query("SELECT doc_id AS content_id, unnest(list_filter([CASE WHEN n > 1 THEN 'content id unique' END, CASE WHEN doc_id % 3 = 0 THEN 'assertions supported' END, CASE WHEN n_chars > 600 THEN 'duration' END, CASE WHEN doc_id % 4 = 0 THEN 'copy as rendered' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM documents)")
def prj26_prj27_prj32_package_rules(t):
    k = F.col("doc_id")
    a = t.documents.select(k.alias("content_id"), F.lit(1).alias("same_id"), (k % 3 == 0).cast("int").alias("unsupported"), F.when(F.col("n_chars") > 600, "FAIL").otherwise("PASS").alias("duration"), F.when(k % 4 == 0, "x").otherwise("y").alias("rendered"), F.lit("y").alias("copy"))
    return rules.violations(a, "content_id", articles.package_rules()).select("content_id", "rule")


_TERMS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9][a-z0-9''/-]{{2,}}'), lambda t: NOT regexp_matches(t, '^[0-9]+$') AND NOT list_contains(" + words(fixed.WORKFLOW_STOP) + ", t)))"


@query(
    f"WITH x AS (SELECT item_id, doc_id, {_TERMS.format('b.text')} AS a, {_TERMS.format('d.text')} AS c FROM benchmark b JOIN documents d ON d.doc_id = b.item_id) "
    "SELECT item_id, CASE WHEN len(a) >= 5 AND len(c) >= 5 AND len(list_intersect(a, c)) / len(list_distinct(list_concat(a, c))) < 0.16 THEN 'DRIFT' ELSE 'FAITHFUL' END AS status FROM x"
)
def prj34_thesis_fidelity(t):
    x = t.benchmark.select("item_id", F.col("text").alias("a")).join(t.documents.select(F.col("doc_id").alias("item_id"), F.col("text").alias("c")), "item_id")
    return x.select("item_id", rules.thesis_status(text.workflow_terms(F.col("a")), text.workflow_terms(F.col("c"))).alias("status"))


@query("SELECT doc_id, url, doc_id % 3 = 0 AS by_root, array_to_string(list_sort(['https://e.org/a', concat('https://e.org/', doc_id)]), ',') AS added FROM (SELECT doc_id, concat('https://own.org/p/', doc_id % 3) AS url FROM documents)")
def tvf28_link_changes(t):
    k = F.col("doc_id")
    before = F.concat(F.lit("[x](https://own.org/p/"), k % 3, F.lit(") "), "text")
    after = F.concat("text", F.lit(" [a](https://e.org/a) [b](https://e.org/"), k, F.lit(") [a](https://e.org/a)"))
    x = t.documents.select("doc_id", similarity.link_changes(before, after).alias("x"))
    return x.select("doc_id", F.get("x.removed", F.lit(0)).alias("url"), (k % 3 == 0).alias("by_root"), F.array_join("x.added", ",").alias("added"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'B,C' ELSE 'A' END AS moved FROM documents")
def jon16_moved_headings(t):
    k = F.col("doc_id") % 3
    b = F.lit("# A\n\nx\n\n## B\n\n## C")
    a = F.when(k == 0, b).when(k == 1, F.lit("# A\n\n# C\n\n# B")).otherwise(F.lit("# New\n\n# A"))
    return t.documents.select("doc_id", F.array_join(similarity.moved_headings(text.headings(b), text.headings(a)), ",").alias("moved"))


@query()
def jon16_renamed_headings(t):
    p = t.documents.select("doc_id", F.concat(F.lit("# On "), F.element_at(F.split("text", r"\s+"), 1), F.lit(" and the record\n\n## Kept\n\n## Gone")).alias("before"), F.concat(F.lit("## Kept\n\n# Of the record and "), F.element_at(F.split("text", r"\s+"), 1)).alias("after"))
    return similarity.renamed_headings(p, "doc_id", "before", "after")


@query()
def sca35_prepared_posts(t):
    k = F.col("doc_id") % 2
    d = t.documents.select("doc_id", F.when(k == 0, F.concat(F.lit("1/ First words. "), "text", F.lit("\n\n2/ Second. Last one!"))).otherwise(F.concat(F.lit("Begin here. "), "text")).alias("body"), F.lit("Read on").alias("tail"), F.when(k == 0, "THREAD").otherwise("POST").alias("form"))
    return repair.prepared_posts(d, "doc_id", "body", "tail", "form")


@query()
def src30_series_names(t):
    return html.series_names(t.pages.select("page_id", F.concat(F.when(F.col("page_id") % 3 == 0, F.lit('<nav><a href="/s/">  </a><a href="https://x.org/s/files">The <b>Files</b></a></nav>')).otherwise(""), "html").alias("html")), "page_id", "html")


@query(
    r"WITH d AS (SELECT doc_id, regexp_replace(text, '[ \t]+', ' ', 'g') AS c FROM documents) SELECT doc_id, md5(regexp_replace(regexp_replace(c, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS clean FROM d"
)
def sca13_clean_article(t):
    m = F.concat(F.lit("nav\n# Other\nmenu\n# The Title: Now\n"), F.lit("Share\nJan 5, 2024\n[pic](https://substackcdn.com/x.png)\n![i](https://e.org/i.png)"), F.lit("\n"), "text")
    body = F.regexp_replace(text.clean_article(m, F.lit("The Title now")), r"^# The Title: Now\s*", "")
    return t.documents.select("doc_id", F.md5(text.stripped(body)).alias("clean"))


_CONCEPTS = ["ention", "thing", "the attion", "thanedble the", "attion"]
_ORDERED = ["thanedble the", "the attion", "attion", "ention", "thing"]


@query(
    "WITH h AS (SELECT doc_id, list_filter(" + words(_ORDERED) + ", lambda n: contains(lower(text), n)) AS h FROM documents), k AS (SELECT doc_id, list_filter(h, lambda n: NOT (n = 'attion' AND list_contains(h, 'the attion'))) AS h FROM h), "
    "s AS (SELECT doc_id, h, list_sum(list_transform(h, lambda n: 0.75)) AS total FROM k) "
    "SELECT doc_id, array_to_string(h, '|') AS hits, round(CASE WHEN len(h) = 0 THEN 0.0 ELSE least(1.0, total / 4) END, 4)::DOUBLE AS concept, round(CASE WHEN len(h) = 0 THEN 0.0 ELSE least(1.0, (len(h) - 1) * 0.34) END, 4)::DOUBLE AS cooccurrence FROM s"
)
def txt10_txt11_concepts(t):
    hits = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(n)), n) for n in _CONCEPTS]))
    d = t.documents.select("doc_id", search.without_contained(hits).alias("hits"))
    score, near = search.concept_score(F.col("hits"))
    return d.select("doc_id", F.array_join("hits", "|").alias("hits"), F.round(score, 4).alias("concept"), F.round(near, 4).alias("cooccurrence"))


@query("SELECT doc_id, round(CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE 0.65 * contains(lower(source), 'src1')::INT + 0.35 * (source = 'src1')::INT / 2 + CASE WHEN doc_id % 4 = 1 THEN 0.175 ELSE 0 END END, 6)::DOUBLE AS anchor FROM documents")
def txt08_anchor_score(t):
    anchors = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Camera "), "source")).otherwise(F.col("source"))
    return t.documents.select("doc_id", F.round(search.anchor_score(anchors, ["src1", "camera"], ["src1"]), 6).alias("anchor"))


@query(
    "WITH v AS (SELECT doc_id AS article, i::BIGINT AS number, list_distinct(list_filter(regexp_extract_all(lower(p), '[a-z0-9][a-z0-9''-]{2,}'), lambda w: NOT list_contains(" + words(fixed.VOICE_STOP) + ", w))) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)), "
    "s AS (SELECT article, number, len(list_intersect(w, ['ention', 'thing', 'thanedble', 'attion'])) / 4.0 AS score FROM v), f AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, article, number LIMIT 60) "
    "SELECT article, number, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY article ORDER BY score DESC, number) AS rn FROM f) WHERE rn <= 2 ORDER BY score DESC, article, number LIMIT 8"
)
def txt16_voice_passages(t):
    p = t.documents.select(F.col("doc_id").alias("article"), F.posexplode(F.split("text", "\n")).alias("at", "text")).select("article", (F.col("at") + 1).cast("long").alias("number"), "text")
    return retrieval.voice_passages(p, "the Ention thing, thanedble attion")


@query("SELECT kind, rank::INT AS rank, article, score FROM (SELECT kind, article, score::DOUBLE AS score, row_number() OVER (PARTITION BY kind ORDER BY score DESC, article) AS rank FROM (SELECT 'memory' AS kind, doc_id::VARCHAR AS article, n_chars AS score FROM documents WHERE lang = 'en' UNION ALL SELECT 'voice', source, doc_id FROM documents UNION ALL SELECT 'gold', item_id::VARCHAR, 1 FROM benchmark))")
def txt15_bundle(t):
    d = t.documents
    return retrieval.bundle(d.where("lang = 'en'").select(F.col("doc_id").alias("article"), F.col("n_chars").alias("score")), d.select(F.col("source").alias("article"), F.col("doc_id").alias("score")), t.benchmark.select(F.col("item_id").alias("article"), F.lit(1).alias("score")))


@query("SELECT doc_id AS article, 0 AS at, 'to the other' AS anchor, concat('https://own.org/p/', doc_id + 1) AS target FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents)")
def jon06_srt07_internal_links(t):
    k = F.col("doc_id")
    url = lambda n: F.concat(F.lit("https://OWN.org/p/"), n, F.lit("/?utm_source=x"))
    links = F.array(*[F.struct(F.lit(a).alias("anchor"), u.alias("url")) for a, u in (("to the other", url(k + 1)), ("again", url(k + 1)), ("itself", url(k)), ("Share", url(k + 2)), ("outside", F.lit("https://e.org/p/1")))])
    m = t.documents.select(k.alias("article"), F.concat(F.lit("https://own.org/p/"), k).alias("own_url"), links.alias("links"))
    a = t.documents.select(F.concat(F.lit("https://own.org/p/"), k).alias("canonical_url"), F.col("source").alias("title"))
    return retrieval.internal_links(m, a).select("article", "at", "anchor", "target")


@query(f"SELECT sha256(concat_ws('|', '4', n, s1, s2, s3)) AS signature FROM (SELECT count(*)::VARCHAR AS n, sum(('0x' || substring(h, 1, 12))::BIGINT)::VARCHAR AS s1, sum(('0x' || substring(h, 13, 12))::BIGINT)::VARCHAR AS s2, sum(('0x' || substring(h, 25, 12))::BIGINT)::VARCHAR AS s3 FROM (SELECT sha256(concat_ws('|', doc_id, sha256(text), 'full')) AS h FROM documents))")
def snk17_signature(t):
    return store.signature(t.documents.select(F.col("doc_id").cast("string").alias("canonical_url"), F.sha2("text", 256).alias("content_hash"), F.lit("full").alias("content_status")))


@query("SELECT conv_id, array_to_string(list_distinct_ordered, ',') AS roles FROM (SELECT conv_id, list(role ORDER BY first) AS list_distinct_ordered FROM (SELECT conv_id, role, min(turn) AS first FROM (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 3 GROUP BY conv_id, role) GROUP BY conv_id)")
def agg07_ordered_sets(t):
    from ..operators import index

    c = t.conversations.select("conv_id", "turn", F.array("role").alias("v"))
    return index.ordered_sets(c, "conv_id", "v", "turn").select("conv_id", F.array_join("v", ",").alias("roles"))


@query(
    f"WITH g AS (SELECT item_id, list_distinct({SEARCH}) AS g FROM benchmark), x AS (SELECT item_id, len(g) AS n, unnest(g) AS term FROM g), r AS (SELECT doc_id, unnest(list_distinct({SEARCH})) AS term FROM documents), "
    "s AS (SELECT item_id, doc_id, count(*) / max(n) AS score FROM x JOIN r USING (term) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM s) "
    "SELECT benchmark.item_id AS gold_id, b.doc_id AS row_id, round(b.score, 6) AS score FROM benchmark LEFT JOIN b ON b.item_id = benchmark.item_id AND rn = 1 AND b.score >= 0.4"
)
def jon07_best_titles(t):
    best = similarity.best_titles(t.benchmark.select(F.col("item_id").alias("gold_id"), F.col("text").alias("title")), t.documents.select(F.col("doc_id").alias("row_id"), F.col("text").alias("title")))
    return best.select("gold_id", "row_id", F.round("score", 6).alias("score"))


@query(
    f"WITH l AS (SELECT doc_id, unnest(string_split(m, chr(10))) AS l, generate_subscripts(string_split(m, chr(10)), 1) AS i FROM (SELECT doc_id, {MARKDOWN} AS m FROM documents)), "
    "b AS (SELECT *, sum((trim(l) = '')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM l) SELECT doc_id, min(i)::INT AS line, md5(string_agg(trim(l), ' ' ORDER BY i)) AS digest FROM b WHERE trim(l) <> '' GROUP BY doc_id, b"
)
def tvf11_located_blocks(t):
    return blocks.located_blocks(_md(t), "doc_id", "m").select("doc_id", F.col("line").cast("int").alias("line"), F.md5("text").alias("digest"))


@query("SELECT doc_id, CASE WHEN contains(source, 'src1') THEN 'https://e.org/2' ELSE 'https://patents.google.com/x' END AS first, CASE WHEN contains(source, 'src1') THEN 'https://patents.google.com/x' WHEN contains(lang, 'e') THEN 'https://e.org/3' ELSE 'https://e.org/1' END AS second FROM documents")
def srt07_ranked_links(t):
    from ..operators import index

    link = lambda a, u: F.struct(a.alias("anchor"), F.lit(u).alias("url"))
    l = F.array(link(F.lit("see it"), "https://e.org/1"), link(F.col("source"), "https://e.org/2"), link(F.when(F.contains("lang", F.lit("e")), "a memo of harbors").otherwise("none"), "https://e.org/3"), link(F.lit("file"), "https://patents.google.com/x"))
    x = t.documents.select("doc_id", index.rank_links(l, ["src1"], ["see"], ["memo of"]).alias("x"))
    return x.select("doc_id", F.col("x")[0]["url"].alias("first"), F.col("x")[1]["url"].alias("second"))


@query("SELECT doc_id, md5(concat('B ', regexp_replace(text, '[*_`]', '', 'g'), '  l of it', chr(10))) AS plain FROM documents")
def sca17_diagnostic_plain(t):
    m = F.concat(F.lit("**B** "), F.regexp_replace("text", r"\[", "["), F.lit(" [IMAGE: a | ALT: b] [l](https://e.org/x) of _it_\n```py\ncode = 1\n```\n"))
    return t.documents.select("doc_id", F.md5(text.diagnostic_plain(m)).alias("plain"))


@query("SELECT doc_id, page::INT AS page, md5(concat(chr(10), '===== PDF PAGE ', page, ' =====', chr(10), regexp_replace(p, '^\\s+|\\s+$', '', 'g'), chr(10))) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents)")
def src33_marked_pages(t):
    d = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit(" \f ")).alias("p"))
    return blocks.marked_pages(d, "doc_id", "p").select("doc_id", "page", F.md5("marked").alias("digest"))


@query("SELECT 'writer_primary' AS role, source AS path FROM documents WHERE source = 'src1' GROUP BY ALL UNION ALL SELECT 'writer_lookup_only', source FROM documents WHERE source IN ('src2', 'src11') GROUP BY ALL UNION ALL SELECT 'auditor_full_research', source FROM documents WHERE source LIKE 'src1%' GROUP BY ALL")
def prj37_context_roles(t):
    return readers.context_roles(t.documents.select(F.col("source").alias("path")), ["src1"], ["src2", "src11", "none"], "src1")
