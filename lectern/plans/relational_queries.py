"""Queries of the store, join, aggregate, window, sort and set operators on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed, search, text
from ..operators import rules, store
from .registry import query
from .scalar_queries import ALNUM, SEARCH, words


_TOP = """WITH d AS (SELECT doc_id, {tok} AS toks FROM documents), q AS (SELECT unnest(['the', 'ention', 'thing', 'enches', 'thing']) AS term),
s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d), x AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d),
p AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k}"""
QUERY = ["ention", "thing", "thanedble", "attion", "thing"]


def _bm25_sql(k: int) -> str:
    return _TOP.format(tok=SEARCH, k=k).replace("['the', 'ention', 'thing', 'enches', 'thing']", str(QUERY))


@query(_bm25_sql(10))
def agg02_agg03_srt01_bm25_topk(t):
    s = search.bm25(t.documents, "doc_id", QUERY, text.search_tokens(F.col("text"))).select("doc_id", F.round("score", 6).alias("score"))
    return search.top(s, 10, F.col("score").desc(), F.col("doc_id"))


@query(f"WITH s AS ({_bm25_sql(1000000000)}) SELECT doc_id, round(score / (SELECT max(score) FROM s), 4) AS score FROM s")
def agg03_bm25_normalized(t):
    s = search.normalized(search.bm25(t.documents, "doc_id", QUERY, text.search_tokens(F.col("text"))))
    return s.select("doc_id", F.round("score", 4).alias("score"))


@query(
    f"WITH d AS (SELECT doc_id, {SEARCH} AS toks FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY ALL), "
    "f AS (SELECT term, count(*) AS df FROM p GROUP BY term), w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM d)) / (1 + df)) + 1) AS w FROM p JOIN f USING (term)), "
    "n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id) SELECT doc_id, count(*)::BIGINT AS n_terms, round(max(w / norm), 5) AS top, round(sum(w / norm), 3) AS total FROM w JOIN n USING (doc_id) GROUP BY doc_id"
)
def txt01_agg05_tfidf_terms(t):
    d = t.documents
    w = search.tfidf(search.postings(d, "doc_id", text.search_tokens(F.col("text"))), "doc_id", d.count())
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.max("weight"), 5).alias("top"), F.round(F.sum("weight"), 3).alias("total"))


_GRAMS = "SELECT doc_id, unnest(t) AS term FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM d"


@query(
    "WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}'), lambda w: NOT list_contains(" + words(fixed.SEARCH_STOP) + f", w)) AS t FROM documents), g AS ({_GRAMS}), "
    "c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), f AS (SELECT term, sum(tf) AS tf, count(*) AS df FROM c GROUP BY term), v AS (SELECT term, df FROM f WHERE df BETWEEN 2 AND 0.98 * (SELECT count(*) FROM d) ORDER BY tf DESC, term LIMIT 30000), "
    "w AS (SELECT doc_id, (1 + ln(c.tf)) * (ln((1.0 + (SELECT count(*) FROM d)) / (1 + df)) + 1) AS w FROM c JOIN v USING (term)), n AS (SELECT doc_id, count(*)::BIGINT AS n_terms, max(w) AS m, sum(w) AS s, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id) "
    "SELECT doc_id, coalesce(n_terms, 0)::BIGINT AS n_terms, round(coalesce(m / norm, 0), 5) AS top, round(coalesce(s / norm, 0), 3) AS total FROM d LEFT JOIN n USING (doc_id)"
)
def txt01_ngram_vectors(t):
    from ..operators import vectors

    known = vectors.vocabulary(t.documents, F.col("text"), 30000, 2, 0.98)
    v = known.vectors(t.documents, "doc_id", F.col("text"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return v.select("doc_id", F.size("i").cast("long").alias("n_terms"), F.round(F.coalesce(F.array_max("w"), F.lit(0.0)), 5).alias("top"), F.round(total, 3).alias("total"))


PHRASES = ["the attion", "thanedble the", "of the", "eriner thanea"]


@query(
    "WITH h AS (SELECT doc_id, source, lower(text) AS hay, count(*) OVER () AS n FROM documents), x AS (SELECT doc_id, n, p, contains(hay, p) AS hit FROM h, (SELECT unnest(" + str(PHRASES) + ") AS p)), "
    "f AS (SELECT p, count(*) AS df FROM x WHERE hit GROUP BY p), s AS (SELECT doc_id, (ln((n + 1.0) / (df + 1.0)) + 1) * least(2.0, 0.75 + 0.45 * len(string_split(p, ' '))) AS s FROM x JOIN f USING (p) WHERE hit), "
    "r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS rn FROM s) SELECT doc_id, round(1 - exp(-sum(s) / 4), 6) AS score FROM r WHERE rn <= 3 GROUP BY doc_id"
)
def agg04_txt07_phrase_score(t):
    return search.phrase_scores(t.documents, "doc_id", F.col("text"), PHRASES).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "WITH v AS (SELECT vec_id, label, embedding FROM embeddings), q AS (SELECT embedding AS e FROM v WHERE vec_id = 0) SELECT vec_id, round(greatest(0, least(1, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]))), 4) AS score FROM v, q"
)
def txt03_semantic_cosine(t):
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("e"))
    return t.embeddings.crossJoin(F.broadcast(q.limit(1))).select("vec_id", F.round(search.cosine(F.col("embedding"), F.col("e")), 4).alias("score"))


@query("SELECT source, round(sum(n_chars::DOUBLE * CASE rn WHEN 1 THEN 0.80 WHEN 2 THEN 0.14 ELSE 0.06 END), 3) AS score FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3 GROUP BY source")
def agg06_top3_rollup(t):
    return search.rollup(t.documents.select("source", "doc_id", F.col("n_chars").cast("double").alias("s")), "source", "s", F.col("doc_id")).select("source", F.round("score", 3).alias("score"))


@query("SELECT doc_id, least(1.0, round(n_chars / 20000.0 + least(0.025, ln(1.0 + doc_id % 9) / 140), 6)) AS score FROM documents WHERE n_chars / 20000.0 + least(0.025, ln(1.0 + doc_id % 9) / 140) >= 0.2")
def prj11_min_score(t):
    s = F.col("n_chars") / F.lit(20000.0) + search.link_bonus(F.col("doc_id") % 9)
    return t.documents.select("doc_id", s.alias("s")).where("s >= 0.2").select("doc_id", F.least(F.lit(1.0), F.round("s", 6)).alias("score"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS owner, CASE WHEN min(doc_id) OVER (PARTITION BY sha256(text)) <> doc_id THEN min(doc_id) OVER (PARTITION BY sha256(text)) END AS duplicate_of FROM documents")
def win01_duplicate_of(t):
    d = store.duplicate_of(t.documents.select("doc_id", text.content_hash(F.col("text")).alias("h")), "h", "doc_id")
    return d.select("doc_id", F.coalesce("duplicate_of", "doc_id").alias("owner"), "duplicate_of")


@query("WITH a AS (SELECT doc_id, least(n_chars, 1000) AS ask FROM documents), b AS (SELECT doc_id, ask, coalesce(sum(ask) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a) SELECT doc_id, greatest(0, least(ask, 140000 - before))::BIGINT AS granted FROM b")
def win04_running_budget(t):
    return store.budgeted(t.documents.select("doc_id", "n_chars"), "doc_id", F.col("n_chars"), 1000, 140000).select("doc_id", F.col("granted").cast("long").alias("granted"))


@query(
    r"WITH w AS (SELECT doc_id, string_split_regex(trim(text), '\s+') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 560)) AS start FROM w) "
    "SELECT doc_id, start::BIGINT AS start, md5(array_to_string(list_slice(w, start + 1, start + 650), ' ')) AS digest FROM s WHERE start = 0 OR start - 560 + 650 < len(w)"
)
def win09_word_windows(t):
    from ..operators.blocks import word_windows

    return word_windows(t.documents, "doc_id", F.col("text")).select("doc_id", F.col("start").cast("long").alias("start"), F.md5("piece").alias("digest"))


@query("SELECT lower(event_type) AS node, count(DISTINCT user_id)::BIGINT AS paths, count(DISTINCT user_id % 7)::BIGINT AS streams FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 2 ORDER BY paths DESC, node")
def agg11_convergence(t):
    from ..operators.evidence import convergences

    paths = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("nodes")).select(F.col("user_id").alias("path_id"), (F.col("user_id") % 7).alias("dependency_group"), "nodes")
    return convergences(paths)


_LINES = r"SELECT doc_id, trim(regexp_replace(lower(l), '\s+', ' ', 'g')) AS line, len(string_split_regex(trim(l), '\s+')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)"


@query(f"SELECT doc_id, md5(line) AS fingerprint, sum(n)::BIGINT AS words FROM ({_LINES}) WHERE n >= 40 GROUP BY doc_id, md5(line)")
def agg13_paragraph_fingerprints(t):
    from ..operators.similarity import fingerprints

    return fingerprints(t.documents, "doc_id", F.split("text", "\n")).select("doc_id", F.md5("paragraph").alias("fingerprint"), "words")


@query(f"WITH f AS (SELECT doc_id, md5(line) AS p, sum(n) AS words FROM ({_LINES}) WHERE n >= 40 GROUP BY ALL) SELECT p, count(*)::BIGINT AS docs, min(doc_id) AS first_doc, (sum(words) - max(CASE WHEN doc_id = m THEN words END))::BIGINT AS repeated_words FROM (SELECT *, min(doc_id) OVER (PARTITION BY p) AS m FROM f) GROUP BY p HAVING count(*) > 1")
def jon14_shared_paragraphs(t):
    from ..operators.similarity import fingerprints

    f = fingerprints(t.documents, "doc_id", F.split("text", "\n")).select("doc_id", F.md5("paragraph").alias("p"), "words")
    g = f.groupBy("p").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"), F.sum("words").alias("w"), F.min_by("words", "doc_id").alias("own"))
    return g.where("docs > 1").select("p", "docs", "first_doc", (F.col("w") - F.col("own")).alias("repeated_words"))


@query("WITH f AS (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)), m AS (SELECT DISTINCT user_id FROM events WHERE value > 90) SELECT c_custkey, f.user_id IS NOT NULL AS failed, m.user_id IS NOT NULL AS missing FROM customer LEFT JOIN f ON f.user_id = c_custkey LEFT JOIN m ON m.user_id = c_custkey UNION ALL SELECT f.user_id, true, false FROM f WHERE f.user_id NOT IN (SELECT c_custkey FROM customer)")
def jon08_srt10_inventory(t):
    kind = t.events.agg(F.min("event_type")).first()[0]
    f = t.events.where(F.col("event_type") == kind).select(F.col("user_id").alias("c_custkey"), F.lit("failed").alias("error"))
    m = t.events.where("value > 90").select(F.col("user_id").alias("c_custkey"))
    return store.inventory(t.customer.select("c_custkey"), f, m, "c_custkey").select("c_custkey", F.col("error").isNotNull().alias("failed"), "missing")


_HALF = "(SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id) FROM events)"


@query(
    f"WITH o AS (SELECT user_id, max(event_id) AS id, arg_max(event_type, event_id) AS s FROM events WHERE event_id <= {_HALF} GROUP BY user_id), n AS (SELECT user_id, arg_max(event_type, event_id) AS s FROM events WHERE event_id > {_HALF} GROUP BY user_id) "
    "SELECT user_id, CASE WHEN n.user_id IS NULL THEN 'missing' WHEN o.user_id IS NULL THEN 'new' WHEN o.s = n.s THEN 'unchanged' ELSE 'updated' END AS state, coalesce(n.s, o.s) AS s FROM o FULL JOIN n USING (user_id)"
)
def snk01_snk13_upsert_classes(t):
    half = t.events.select(F.percentile_disc(F.lit(0.5)).withinGroup("event_id") if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)")).first()[0]
    last = lambda d: d.groupBy("user_id").agg(F.max("event_id").alias("id"), F.max_by("event_type", "event_id").alias("s"))
    old = last(t.events.where(F.col("event_id") <= half))
    new = last(t.events.where(F.col("event_id") > half)).withColumnRenamed("id", "seq")
    return store.upsert(old, new, "user_id", ("s",)).select("user_id", "state", "s")


@query("SELECT c_custkey, greatest(c_nationkey, coalesce(m, c_nationkey))::BIGINT AS last_seen FROM customer LEFT JOIN (SELECT user_id, max(event_id) AS m FROM events GROUP BY user_id) ON user_id = c_custkey")
def snk02_touch_last_seen(t):
    c = t.customer.select("c_custkey", F.col("c_nationkey").cast("long").alias("last_seen"))
    return store.touched(c, t.events.select(F.col("user_id").alias("c_custkey"), F.col("event_id").alias("observed_at")), "c_custkey")


@query("WITH r AS (SELECT *, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS p FROM events) SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_id DESC) AS rn FROM r) WHERE rn = 1")
def snk11_precedence_merge(t):
    p = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    won, _ = store.merged_by_priority(t.events.select("user_id", "event_id", "event_type"), "user_id", p, F.col("event_id").desc())
    return won


@query("SELECT user_id, event_id, event_type, status FROM (SELECT *, CASE WHEN value > 50 THEN 'full' ELSE 'preview_only' END AS status FROM events) WHERE event_type <> 'x'")
def snk03_status_change(t):
    e = t.events.select("user_id", "event_id", "event_type", F.lit("full").alias("content_status"))
    changed = t.events.select("event_id", F.when(F.col("value") > 50, "full").otherwise("preview_only").alias("status"))
    return store.with_status(e, changed, "event_id").where("event_type <> 'x'").select("user_id", "event_id", "event_type", F.col("content_status").alias("status"))


@query("WITH c AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49) SELECT l_orderkey AS article_id, l_linenumber::BIGINT AS id, 'old' AS anchor FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM c) UNION ALL SELECT l_orderkey, l_linenumber, 'new' FROM lineitem WHERE l_quantity > 49")
def snk04_replace_child_links(t):
    l = t.lineitem.select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").cast("long").alias("id"), F.lit("old").alias("anchor"), F.lit("u").alias("url"), "l_quantity")
    new = l.where("l_quantity > 49").withColumn("anchor", F.lit("new"))
    return store.replaced_links(l, new).select("article_id", "id", "anchor")


@query("WITH r AS (SELECT source, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS claim, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2) SELECT doc_id, printf('EV-%04d', row_number() OVER (ORDER BY doc_id)) AS evidence_id FROM r")
def snk08_evidence_insert_ignore(t):
    items = t.documents.select(F.col("source").alias("source_id"), F.col("text").alias("claim"), F.col("doc_id").alias("seq"))
    return store.evidence_kept(items).select(F.col("seq").alias("doc_id"), "evidence_id")


@query("WITH r AS (SELECT url, min(page_id) AS seq FROM pages GROUP BY url) SELECT seq AS page_id, row_number() OVER (ORDER BY seq) AS id, 'Untitled source' AS title FROM r")
def snk07_source_get_or_create(t):
    s = t.pages.select("url", F.lit(None).cast("string").alias("file_path"), F.lit(" ").alias("title"), F.col("page_id").alias("seq"))
    return store.sources_kept(s).select(F.col("seq").alias("page_id"), F.col("id").cast("long").alias("id"), "title")


MOVES = [("click", "purchase"), ("view", "click"), ("click", "view"), ("view", "view")]


@query("WITH m AS (SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS current, event_type AS target FROM events) SELECT event_id, current, target FROM m WHERE current IS NOT NULL AND concat(current, '>', target) NOT IN ('click>purchase', 'view>click', 'click>view', 'view>view')")
def prj23_transition_check(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    m = t.events.select("event_id", F.lag("event_type").over(w).alias("current"), F.col("event_type").alias("target")).where("current IS NOT NULL")
    return store.transitions_broken(m, MOVES).select("event_id", "current", "target")


@query("SELECT event_id, 'value' AS field FROM events WHERE event_id % 50 = 0")
def prj25_analytics_values(t):
    e = t.events.select("event_id", F.when(F.col("event_id") % 50 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("value"), F.lit("").alias("clicks"))
    return rules.analytics_problems(e, "event_id", ["value", "clicks"]).select("event_id", "field")


@query("SELECT event_id, user_id % 5 <= event_id % 5 OR value > 80 AS allowed FROM events")
def prj24_spoiler(t):
    return t.events.select("event_id", rules.spoiler_allowed(F.col("event_id") % 5, F.col("user_id") % 5, F.col("value") > 80).alias("allowed"))


@query("SELECT conv_id, turn, 'numbers run from 1' AS rule FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE turn <> rn")
def prj19_manifest_constraints(t):
    p = t.conversations.select(F.col("conv_id").alias("series"), F.col("turn").alias("number"), F.concat(F.lit("part-"), "turn").alias("slug"), F.lit(None).cast("string").alias("published_url"), F.lit(False).alias("finale"), F.lit("planned").alias("status"))
    w = Window.partitionBy("series").orderBy("number")
    rows, rs = rules.manifest_rules(p.withColumns({"previous": F.lag("slug").over(w), "next": F.lead("slug").over(w)}))
    v = rules.violations(rows.withColumn("k", F.struct("series", "number")), "k", rs)
    return v.select(F.col("k.series").alias("conv_id"), F.col("k.number").alias("turn"), "rule")


@query("WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) SELECT user_id, CASE WHEN a.n IS NULL THEN 'only_final' WHEN b.n IS NULL THEN 'disappeared' WHEN b.n >= greatest(3, 2 * a.n) THEN 'promoted' WHEN a.n >= greatest(3, 2 * b.n) THEN 'diminished' ELSE 'kept' END AS change FROM a FULL JOIN b USING (user_id)")
def set03_count_difference(t):
    from ..operators.similarity import count_changes

    c = lambda k: t.events.where(F.col("event_type") == k).groupBy(F.col("user_id").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return count_changes(c("view"), c("click")).select(F.col("name").alias("user_id"), "change")


@query("SELECT supp.s_nationkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier supp ON l_suppkey = s_suppkey WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY supp.s_nationkey")
def substrate_star_join(t):
    l = t.lineitem.where("l_shipdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return l.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.round(F.sum("r"), 2).alias("revenue"))
