"""Queries of row-generating, similarity and retrieval operators on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import search, text
from ..operators import blocks, evidence, similarity
from .registry import query
from .scalar_queries import ALNUM

#: A document as Markdown: its lines as blank-line blocks under a heading each three, with a link and a mark.
MARKDOWN = "concat('# ', substring(text, 1, 25), chr(10), chr(10), replace(text, chr(10), concat(chr(10), chr(10))), chr(10), chr(10), '## More', chr(10), '[see ', source, '](https://e.org/p/', doc_id, ') [[EV-0001]] it', chr(10), '- item')"


def _md(t):
    return t.documents.select("doc_id", "source", F.expr(MARKDOWN.replace("'", '"')).alias("m"))


_BLOCKS = rf"list_transform(list_filter(string_split_regex({MARKDOWN}, '\n\s*\n'), lambda b: trim(b) <> '' AND NOT starts_with(ltrim(b), '[[')), lambda b: trim(regexp_replace(b, '\s+', ' ', 'g')))"


@query(f"WITH b AS (SELECT doc_id, {_BLOCKS} AS b FROM documents) SELECT doc_id, len(b)::BIGINT AS n, len(list_filter(b, lambda x: NOT regexp_matches(x, '^(#|\\[IMAGE:|\\||- )')))::BIGINT AS prose, md5(array_to_string(b, '|')) AS digest FROM b")
def tvf07_tvf08_blocks(t):
    b = blocks.blocks(F.col("m"))
    return _md(t).select("doc_id", F.size(b).cast("long").alias("n"), F.size(blocks.prose_blocks(F.col("m"))).cast("long").alias("prose"), F.md5(F.array_join(b, "|")).alias("digest"))


@query(rf"SELECT doc_id, array_to_string(list_transform(regexp_extract_all({MARKDOWN}, '(?m)^#{{1,6}}\s+(.+?)\s*$', 1), lambda x: trim(x)), '|') AS headings, concat('https://e.org/p/', doc_id) AS url, concat('see ', source) AS label FROM documents")
def tvf12_tvf13_headings_and_links(t):
    m = blocks.link_map(F.col("m"))
    return _md(t).select("doc_id", F.array_join(text.headings(F.col("m")), "|").alias("headings"), F.element_at(F.map_keys(m), -1).alias("url"), F.element_at(F.map_values(m), -1).alias("label"))


@query("SELECT doc_id, 1 AS number, 'More' AS section, concat('[see ', source, '](https://e.org/p/', doc_id, ') [[EV-0001]] it', chr(10), '- item') AS body FROM documents")
def tvf02_tvf14_tvf15_sections(t):
    s = blocks.sections(_md(t).withColumn("title", F.lit("t")), "doc_id", "m", "title").where("section = 'More'")
    return s.select("doc_id", F.lit(1).alias("number"), "section", "body")


@query("SELECT doc_id, 'EV-0001' AS evidence_id, right(translate(substring(m, greatest(1, instr(m, '[[EV-0001]]') - 350), instr(m, '[[EV-0001]]') - greatest(1, instr(m, '[[EV-0001]]') - 350) + 91), chr(10), ' '), 60) AS tail FROM (SELECT doc_id, " + MARKDOWN + " AS m FROM documents)")
def tvf23_marker_contexts(t):
    return blocks.marker_contexts(_md(t), "doc_id", "m").select("doc_id", "evidence_id", F.right("context", F.lit(60)).alias("tail"))


@query("SELECT doc_id, concat('see ', source) AS anchor, concat('https://e.org/p/', doc_id) AS url, 'external_research' AS kind FROM documents")
def tvf03_tvf04_markdown_links(t):
    m = _md(t).withColumn("article", F.lit("https://own.org/p/1"))
    return blocks.markdown_links(m, "doc_id", "m", "article").select("doc_id", "anchor", "url", "kind")


@query()
def tvf05_char_chunks(t):
    return blocks.char_chunks(t.documents, "doc_id", "text", 2000, 200).select("doc_id", "index", F.md5("chunk").alias("digest"))


@query(
    r"WITH d AS (SELECT doc_id, trim(text, ' ' ) AS t FROM documents ), w AS (SELECT doc_id, t, unnest(CASE WHEN length(t) <= 22000 THEN [0] ELSE range(0, length(t), 16800) END) AS start FROM d), "
    "x AS (SELECT doc_id, start, CASE WHEN length(t) <= 22000 THEN t ELSE substring(t, start + 1, 18000) END AS p FROM w WHERE start = 0 OR start - 16800 + 18000 < length(t)), "
    "s AS (SELECT doc_id, start, least(4, (length(p) - length(replace(lower(p), 'thing', ''))) // 5) + least(4, (length(p) - length(replace(lower(p), 'ention', ''))) // 6) + CASE WHEN contains(lower(p), 'the attion') THEN 8 ELSE 0 END + CASE WHEN start = 0 THEN 0.5 ELSE 0 END AS score FROM x) "
    "SELECT doc_id, start::BIGINT AS start, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start) AS rn FROM s) WHERE rn <= 3"
)
def srt05_source_window_select(t):
    return blocks.char_windows(t.documents, "doc_id", "text", ["thing", "ention"], "the attion").select("doc_id", F.col("start").cast("long").alias("start"), "score")


@query(rf"WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents) SELECT doc_id, count(*)::BIGINT AS sentences, count(*) FILTER (WHERE regexp_matches(s, '(?i)(^| )(the|le|der) (of|de|und)'))::BIGINT AS marked FROM s WHERE s <> '' GROUP BY doc_id")
def agg19_tvf16_sentence_marks(t):
    s = text.sentences(F.col("text"))
    marked = F.filter(s, lambda x: x.rlike("(?i)(^| )(the|le|der) (of|de|und)"))
    return t.documents.select("doc_id", F.size(s).cast("long").alias("sentences"), F.size(marked).cast("long").alias("marked")).where("sentences > 0")


@query()
def jon13_sequence_similarity(t):
    b = t.benchmark.select(F.col("item_id").alias("content_id"), F.col("text").alias("copy"))
    edited = b.where("content_id % 3 = 0").select((F.col("content_id") + 1_000_000).alias("content_id"), F.concat(F.regexp_replace("copy", r" (\w+) (\w+)\.", " $2 $1."), F.lit(" Read on.")).alias("copy"))
    a = b.unionByName(edited).select("content_id", F.col("content_id").alias("pos"), "copy", F.lit(None).cast("string").alias("reuse_policy"))
    return similarity.similar_pairs(a)


_KEY = ALNUM.format("regexp_replace(lower({}), '[''’]s', '', 'g')")


@query(
    f"WITH g AS (SELECT DISTINCT {_KEY.format('text')} AS g FROM benchmark), r AS (SELECT doc_id AS row_id, {_KEY.format('text')} AS t FROM documents), w AS (SELECT g, list_distinct(string_split(g, ' ')) AS w FROM g WHERE g <> ''), "
    "o AS (SELECT row_id, t, list_distinct(string_split(t, ' ')) AS own FROM r) "
    "SELECT row_id, bool_or(contains(t, g) OR contains(g, t) OR (len(list_intersect(own, w)) >= 3 AND len(list_intersect(own, w)) / len(w) >= 0.5)) AS gold FROM o, w GROUP BY row_id"
)
def prj13_gold_titles(t):
    return similarity.gold_titles(t.documents.select(F.col("doc_id").alias("row_id"), F.col("text").alias("title")), t.benchmark.select(F.col("text").alias("title")))


@query()
def tvf18_supported(t):
    """Clauses of conversation turns against the other turns of their conversation, as claims of several types."""
    from ..operators import evidence

    c = t.conversations
    a = evidence.assertion_rows(c.select(F.format_string("%d-%d", "conv_id", "turn").alias("content_id"), F.col("text").alias("body_copy"), F.lit("Read on. The four records show it").alias("cta_text")))
    a = a.select("assertion_id", "assertion_text", F.split("content_id", "-")[0].alias("content_id"))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("DATE", "TIMELINE", "MONEY", "QUOTATION")]), (F.col("turn") % 4 + 1).cast("int"))
    claims = c.select(F.col("conv_id").cast("string").alias("content_id"), F.col("turn").alias("seq"), F.format_string("C%d", "turn").alias("claim_id"), F.element_at(F.split("text", "[.!?]"), 1).alias("claim_text"), kinds.alias("claim_type"), F.when(F.col("turn") % 3 == 0, "INFERENTIAL").otherwise("DIRECT").alias("support_type"))
    return evidence.supported(a, claims, r"(?i)\b(?:memo|funding)\b")


@query()
def tvf28_editorial_diff(t):
    """Documents as Markdown against a revision: lines swapped and renamed, the first lines gone, a link added."""
    from ..operators import revisions

    a = F.concat(F.regexp_replace(F.regexp_replace("m", r"\n\n[^\n]*\n\n", "\n\n"), r" (\w+) (\w+)\.", " $2 $1."), F.lit("\n\n## New part\n\n[memo](https://e.org/new) alleged"))
    return revisions.editorial_diff(_md(t).select("doc_id", "m", a.alias("after")), "doc_id", "m", "after").select("doc_id", "section", "part", "rank", F.md5(F.coalesce("old", F.lit(""))).alias("old"), F.md5(F.coalesce("new", F.lit(""))).alias("new"))


@query()
def jon18_assertion_to_claim(t):
    a = t.benchmark.select("item_id", F.explode(text.sentences(F.col("text"))).alias("assertion_text"))
    a = a.select(F.concat_ws("-", "item_id", F.md5("assertion_text")).alias("assertion_id"), "assertion_text", F.col("item_id").alias("content_id"))
    return similarity.best_claims(a, t.benchmark.select(F.col("item_id").alias("content_id"), F.col("item_id").alias("claim_id"), F.col("text").alias("claim_text")))


@query()
def set06_set07_article_identity(t):
    p = t.documents.select("doc_id", F.concat(F.lit("# Report on The Ention Line\n\n"), "text").alias("before"), F.concat(F.lit("# Report on The Ention Line\n\n"), F.right("text", F.length("text") - 200)).alias("after"))
    return similarity.identity(p, "doc_id", "before", "after")


@query()
def jon15_tvf28_aligned_blocks(t):
    p = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("before"), F.replace(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("the"), F.lit("THE")).alias("after"))
    return similarity.aligned_blocks(p, "doc_id", "before", "after").select("doc_id", F.md5("old").alias("old"), "ratio")


@query()
def agg14_agg16_entities(t):
    return t.documents.select("doc_id", F.explode(similarity.entities(F.col("text"))).alias("name")).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, k AS page, CASE WHEN k <= len(string_split(text, chr(10))) THEN trim(split_part(text, chr(10), k)) END AS text FROM documents, (SELECT unnest([1, 2]) AS k)")
def src33_tvf22_pages(t):
    d = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("p"))
    return blocks.pages_of(d, "doc_id", "p", "1-2").select("doc_id", "page", "text")


@query("SELECT doc_id, instr(text, 'thing')::INT AS at, substring(text, greatest(1, instr(text, 'thing') - 50), 100) AS context FROM documents WHERE contains(text, 'thing')")
def tvf20_page_grep(t):
    return blocks.page_matches(t.documents, "doc_id", "text", "thing", 50).select("doc_id", "at", "context")


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(replace(text, ',', ';'), '(?i)\s+(?:while|but|yet|whereas)\s+|;\s*'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM documents")
def tvf17_clauses(t):
    s = F.replace("text", F.lit(","), F.lit(";"))
    return t.documents.select("doc_id", F.array_join(blocks.clauses(s), "|").alias("parts"))


@query()
def tvf06_authored_paragraphs(t):
    d = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("m"))
    return blocks.authored_paragraphs(d, "doc_id", "m").select("doc_id", "number", F.md5("text").alias("digest"))


@query()
def txt14_prj12_hybrid_retrieval(t):
    from ..operators.retrieval import retrieve

    return retrieve(_topical(t), RETRIEVED, ["license plate", "infrared sensor"], 20, 0.0)


RETRIEVED = "Marlow Security ention camera tracking"


def _topical(t):
    """Chunks of all documents; by the number of a document, a sentence follows its text that names a company, or a topic's vocabulary."""
    k = F.col("doc_id") % 10
    more = F.when(F.col("doc_id") % 50 == 3, " Marlow Security sells cameras with an infrared sensor for roads.").when(k == 5, " police database of license plate reader sightings, an infrared sensor.").when(k == 7, " tracking and vehicle movement and location of ention").otherwise("")
    w = blocks.word_windows(t.documents.select("doc_id", F.concat("text", more).alias("text")), "doc_id", F.col("text"))
    return w.select(F.col("doc_id").alias("article"), "start", F.col("piece").alias("text"), F.lit("").alias("title"), F.lit("full").alias("status"))


@query()
def snk15_snk16_txt03_indexed_retrieval(t):
    """The index of all documents as articles, with vectors, and what it answers by its postings."""
    from ..operators import index
    from ..operators.retrieval import retrieve_indexed
    from ..sources.sinks import scratch, scratch_path

    body = _topical(t).groupBy("article").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "\n\n## Next\n\n").alias("body"))
    a = body.select(F.col("article").alias("id"), F.format_string("https://own.org/p/%s", F.col("article").cast("string")).alias("canonical_url"), F.format_string("Title %s", F.col("article").cast("string")).alias("title"), F.concat(F.lit("# Part\n\n"), "body").alias("body"), F.sha2("body", 256).alias("content_hash"), F.lit("full").alias("content_status"), F.lit(None).cast("string").alias("published_date"))
    path = scratch_path(t.spark)
    index.build(scratch(a), path)  # written once: a build reads its articles several times
    made = index.Index(t.spark, path)
    made.fit(64, 20000)
    return retrieve_indexed(made, RETRIEVED, ["license plate", "infrared sensor"], 20, 0.0)


@query()
def txt02_lsa_project(t):
    from ..operators.retrieval import lsa

    return lsa(t.documents, "doc_id", F.col("text"), 128, 30000).select("doc_id", F.size("vector").alias("k"), "vector")


@query()
def src27_src28_src29_html_snapshot(t):
    from ..sources.html import snapshots

    return snapshots(t.pages, "page_id", "url", "html").select("page_id", "title", "word_count", "n_links", "access_level", F.md5("text").alias("digest"))


@query("SELECT event_id, coalesce(json_array_length(concat('[', props, ']'))::INT, 0) AS n FROM events")
def sca49_sca50_sca51_json_repair(t):
    from ..operators.repair import repaired_items

    cut = F.concat(F.lit('{"items": ['), "props", F.lit(', {"k": "cut'))
    return repaired_items(t.events.select("event_id", cut.alias("raw")), "event_id", "raw").select("event_id", F.size("items").alias("n"))


@query()
def sca46_srt08_link_insert(t):
    from ..operators.repair import linked

    d = t.documents.select("doc_id", "text", F.array(F.struct(F.lit("the").alias("phrase"), F.lit("https://e.org/1").alias("link")), F.struct(F.lit("of the").alias("phrase"), F.lit("https://e.org/2").alias("link"))).alias("sources"))
    return linked(d, "doc_id", "text", "sources").select("doc_id", "n_linked", F.md5("linked").alias("digest"))


@query()
def sca34_shorten(t):
    from ..operators.repair import shortened

    return shortened(t.documents, "doc_id", "text", 280, 24)


@query("SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY user_id, event_type")
def stream_counts_batch(t):
    """The batch form of the streaming counts over events (an addition; the stream itself is in lectern.streaming)."""
    from ..streaming.events import counts

    return counts(t.events)
