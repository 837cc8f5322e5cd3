"""Evidence plans: convergence of paths, source rows of an article, assertions and their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from .store import numbers


def convergences(paths: DataFrame, least: int = 2) -> DataFrame:
    """node, paths, streams: nodes (case ignored) on `least` paths or more, with their distinct dependency groups (the path itself by default)."""
    each = paths.select("path_id", F.coalesce(F.col("dependency_group").cast("string"), F.col("path_id").cast("string")).alias("g"), F.explode(F.array_distinct(F.transform("nodes", F.lower))).alias("node"))
    out = each.groupBy("node").agg(F.countDistinct("path_id").alias("paths"), F.countDistinct("g").alias("streams"))
    return out.where(F.col("paths") >= least).orderBy(F.col("paths").desc(), "node")


def fallback_phrase(context: Column, entities: Column) -> Column:
    """A phrase of a context to hang a link on: its longest entity (case ignored), else its longest acronym, name or identifier, else its last five words."""
    clean = text.without_markers(context)
    there = F.filter(F.coalesce(entities, F.array().cast("array<string>")), lambda e: (e != "") & F.contains(F.lower(clean), F.lower(e)))
    longest = lambda xs: F.get(F.array_sort(xs, lambda x, y: F.length(y) - F.length(x)), F.lit(0))
    entity = longest(there)
    own = F.when(entity.isNotNull(), F.substr(clean, F.position(F.lower(entity), F.lower(clean)), F.length(entity)))
    named = [F.trim(longest(F.regexp_extract_all(clean, F.lit(p), F.lit(0)))) for p in fixed.ANCHORS]
    words = F.regexp_extract_all(clean, F.lit(r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"), F.lit(0))
    return F.coalesce(own, *named, F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 4), F.lit(5)), " "))


def source_rows(marks: DataFrame, anchors: DataFrame, evidence: DataFrame) -> DataFrame:
    """number, phrase, link, evidence_id of the sources that an article's marks lead to.

    marks: evidence_id, pos, context; anchors: evidence_id, phrase; evidence: evidence_id, url, entities.  Marks
    without a URL go, of marks with one URL the first stays, and a phrase that isn't in the context gives way to `fallback_phrase`.
    """
    j = marks.join(anchors, "evidence_id", "left").join(evidence.where("url IS NOT NULL AND url <> ''"), "evidence_id")
    w = Window.partitionBy("url").orderBy("pos")
    first = j.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    phrase = F.coalesce(F.when(F.contains("context", F.col("phrase")) & (F.trim("phrase") != ""), F.col("phrase")), fallback_phrase(F.col("context"), F.col("entities")))
    return numbers(first.select("pos", phrase.alias("phrase"), F.col("url").alias("link"), "evidence_id"), "pos", "number").select("number", "phrase", "link", "evidence_id")


def unknown_marks(docs: DataFrame, key: str, of: str, evidence: DataFrame) -> DataFrame:
    """key, evidence_id of marks in texts that no evidence has."""
    m = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(of, F.lit(r"\[\[(EV-\d{4})\]\]"), F.lit(1)))).alias("evidence_id"))
    return m.join(evidence.select("evidence_id"), "evidence_id", "left_anti").select(key, "evidence_id")


def reranked(candidates: DataFrame, judgments: DataFrame, least: int = 4) -> DataFrame:
    """Candidates (wr_id, tier, phrases, score) with judged score, relationship and included; of several judgments the last counts."""
    j = judgments.groupBy("wr_id").agg(F.max_by("score", "seq").alias("judged"), F.max_by("relationship", "seq").alias("relationship"))
    x = candidates.join(j, "wr_id", "left").withColumn("judged", F.coalesce("judged", F.lit(1))).withColumn("relationship", F.coalesce("relationship", F.lit("unjudged")))
    keep = (F.col("tier") == "DIRECT") | (F.size("phrases") > 0) | (F.col("judged") >= least)
    return x.withColumn("included", keep).orderBy(F.col("included").desc(), F.col("judged").desc(), F.col("score").desc())


def assertion_rows(assets: DataFrame) -> DataFrame:
    """content_id, text_section, number, assertion_text, assertion_id: clauses of body and call to action, numbered through."""
    from .blocks import clauses

    parts = F.concat(F.transform(F.flatten(F.transform(text.sentences(F.col("body_copy")), clauses)), lambda s: F.struct(F.lit("BODY").alias("text_section"), s.alias("assertion_text"))), F.transform(F.flatten(F.transform(text.sentences(F.col("cta_text")), clauses)), lambda s: F.struct(F.lit("CTA").alias("text_section"), s.alias("assertion_text"))))
    a = assets.select("content_id", F.posexplode(parts).alias("at", "p"))
    return a.select("content_id", "p.text_section", (F.col("at") + 1).alias("number"), "p.assertion_text", F.format_string("AST-%s-%02d", F.col("content_id").cast("string"), F.col("at") + 1).alias("assertion_id"))


#: Types of statements that are drawn from several claims, and claim types that carry a sequence of decisions.
SYNTHETIC = ["SYNTHESIS", "INFERENCE", "CHRONOLOGY", "CAUSAL", "COMPARATIVE", "RELATIONSHIP"]
SEQUENTIAL = ["DATE", "TIMELINE", "EXECUTIVE_DECISION", "COMMITTEE_RECOMMENDATION", "AGENCY_ASSIGNMENT"]


def supported(assertions: DataFrame, claims: DataFrame, topical: str | None = None) -> DataFrame:
    """assertion_id, assertion_type, score, support_status, claim_ids, review_required: what the claims of its content say for each assertion.

    assertions: assertion_id, content_id, assertion_text; claims: content_id, seq, claim_id, claim_text, claim_type, support_type.
    A score is the larger one of the sequence ratio and the share of the assertion's words; up to four claims of `STRONG` or
    more count, the best first and the earlier among equals.  The first rule that fits gives the status: framing states
    nothing; a count of four decisions needs four sequential claims; an equal claim supports as it is supported; a score of
    `SUPPORTS`; a synthetic statement, or one with `topical` vocabulary, over two claims or more is inferred from the first
    four; a score of `PARTLY`; nothing.
    """
    from .diagnostics import assertion_type
    from .similarity import ratio

    t = fixed.SUPPORT
    # what is compared is made once for each text, not for each pair
    c = claims.select("content_id", "seq", F.col("claim_id").cast("string").alias("claim_id"), text.alnum(F.col("claim_text")).alias("claim"), "claim_type", "support_type").withColumn("own", text.coverage_terms(F.col("claim")))
    a = assertions.select("assertion_id", "content_id", "assertion_text", assertion_type(F.col("assertion_text")).alias("assertion_type"))
    stated = a.where("assertion_type <> 'RHETORICAL_NONFACTUAL'").select("assertion_id", "content_id", text.alnum(F.col("assertion_text")).alias("clause")).withColumn("terms", text.coverage_terms(F.col("clause")))
    j = stated.join(c, "content_id")
    scored = j.withColumn("score", F.greatest(ratio("clause", "claim"), text.covered(F.col("terms"), F.col("own")))).withColumn("exact", F.col("clause") == F.col("claim"))
    row = F.struct((-F.col("score")).alias("rank"), "seq", "claim_id", "support_type", "claim_type", "exact")
    per = scored.groupBy("assertion_id").agg(F.array_sort(F.collect_list(row)).alias("best"))  # the claims of one content
    x = a.join(per, "assertion_id", "left").withColumn("best", F.coalesce("best", F.array().cast(per.schema["best"].dataType)))
    by_seq = F.array_sort(F.transform("best", lambda b: F.struct(b["seq"].alias("seq"), b["claim_id"].alias("claim_id"), b["support_type"].alias("support_type"), b["claim_type"].alias("claim_type"), b["exact"].alias("exact"))))
    x = x.withColumn("allowed", by_seq).withColumn("score", F.coalesce(-F.get("best", F.lit(0))["rank"], F.lit(0.0)))
    strong = F.slice(F.filter("best", lambda b: -b["rank"] >= t["strong"]), 1, 4)
    sequential, exact = F.filter("allowed", lambda b: b["claim_type"].isin(SEQUENTIAL)), F.filter("allowed", lambda b: b["exact"])
    four = F.col("assertion_text").rlike(t["four"])
    several = F.size("allowed") >= 2
    synthetic = F.col("assertion_type").isin(SYNTHETIC)
    topic = F.col("assertion_text").rlike(topical) if topical else F.lit(False)
    first_direct = F.get("best", F.lit(0))["support_type"] == "DIRECT"
    inferred = (F.col("score") < t["supports"]) & several & (synthetic | topic)
    status = (
        F.when(F.col("assertion_type") == "RHETORICAL_NONFACTUAL", "NONFACTUAL_FRAMING")
        .when(four & (F.size(sequential) < 4), F.when(F.size(sequential) > 0, "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED"))
        .when(F.size(exact) > 0, F.when(F.get(exact, F.lit(0))["support_type"] == "DIRECT", "SUPPORTED").otherwise("PARTIALLY_SUPPORTED"))
        .when(F.col("score") >= t["supports"], F.when(synthetic, "INFERENCE_SUPPORTED").when(first_direct, "SUPPORTED").otherwise("PARTIALLY_SUPPORTED"))
        .when(inferred, "INFERENCE_SUPPORTED").when(F.col("score") >= t["partly"], "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED")
    )
    ids = lambda xs: F.transform(xs, lambda b: b["claim_id"])
    lone = F.when((F.size(strong) == 0) & (F.col("status") == "PARTIALLY_SUPPORTED"), ids(F.slice("best", 1, 1))).otherwise(ids(strong))
    mapped = F.when(F.col("status") == "NONFACTUAL_FRAMING", F.array().cast("array<string>")).when(four & (F.size(sequential) < 4), ids(sequential)).when(F.size(exact) > 0, ids(exact)).when(inferred, ids(F.slice("allowed", 1, 4))).otherwise(lone)
    kind = F.when(~synthetic & inferred & ~(four & (F.size(sequential) < 4)) & (F.size(exact) == 0), "SYNTHESIS").otherwise(F.col("assertion_type"))
    review = F.when(F.col("status").isin("PARTIALLY_SUPPORTED", "INFERENCE_SUPPORTED", "UNSUPPORTED"), "YES").otherwise("NO")
    return x.withColumn("status", status).select("assertion_id", kind.alias("assertion_type"), F.round("score", 3).alias("score"), F.col("status").alias("support_status"), F.array_join(mapped, "|").alias("claim_ids"), review.alias("review_required"))


def claims_of(assertions: DataFrame, claims: DataFrame) -> DataFrame:
    """assertion_id, claim_id, claim_text: the claims that assertions (assertion_id, claim_ids joined by a pipe) name, each once."""
    named = assertions.select("assertion_id", F.explode(F.array_distinct(F.transform(F.split("claim_ids", r"\|"), lambda x: F.trim(x)))).alias("claim_id")).where("claim_id <> ''")
    return named.join(claims.select(F.col("claim_id").cast("string").alias("claim_id"), "claim_text"), "claim_id").select("assertion_id", "claim_id", "claim_text")


def gold_paragraphs(paragraphs: DataFrame, gold: DataFrame) -> DataFrame:
    """The paragraphs of gold articles (article), however often an article is listed."""
    return paragraphs.join(gold.select("article").distinct(), "article", "left_semi")
