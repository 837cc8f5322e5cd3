"""Article, series and package validators as rule tables, and the lifecycle of learned candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text, urls
from .rules import Rule

LINK = r"\[[^\]\n]+\]\((https?://[^\s()]+)\)"


def metrics(articles: DataFrame, key: str, of: str, hosts: list[str], mark: str = "/p/") -> DataFrame:
    """key, prose and the counts that an article is judged by; fenced code doesn't count."""
    prose = F.regexp_replace(of, r"(?ms)^(`{3,}|~{3,})[^\n]*\n.*?^\1[ \t]*(?:\n|$)", "")
    a = articles.select(key, prose.alias("prose"))
    links = F.regexp_extract_all("prose", F.lit(LINK), F.lit(1))
    a = a.withColumn("links", links).withColumn("internal", F.filter("links", lambda u: urls.host(u).isin(hosts) & F.startswith(urls.path(u), F.lit(mark))))
    faq = F.regexp_extract_all("prose", F.lit(r"(?ims)^## (?:FAQs?|Frequently Asked Questions)\s*\n(.*?)(?=^## |\z)"), F.lit(1))
    a = a.withColumn("faq", faq)
    return a.select(
        key, "prose", "links", "internal", text.memory_word_count(F.col("prose")).alias("word_count"), F.regexp_count("prose", F.lit(r"\[IMAGE: [^\]\n|]+\| ALT: [^\]\n]+\]")).alias("image_markers"),
        F.regexp_count("prose", F.lit(r"\[\[SUBSCRIBE\]\]")).alias("subscribe_markers"), F.regexp_count("prose", F.lit(r"\[\[SHARE\]\]")).alias("share_markers"),
        F.size("links").alias("markdown_links"), F.size("internal").alias("internal_links"), F.size(F.array_distinct(F.transform("internal", urls.identity))).alias("unique_internal"),
        (F.size("links") - F.size("internal")).alias("external_links"), F.size("faq").alias("faq_sections"), F.regexp_count(F.array_join("faq", "\n"), F.lit(r"(?m)^###\s+.+")).alias("faq_questions"),
    )


def article_rules(faq_count: int = 5, words: tuple[int, int] = (2000, 3500), related: str = "YOU MAY BE INTERESTED IN THESE ARTICLES") -> list[Rule]:
    """Rules over `metrics`."""
    residue = F.regexp_replace("prose", LINK, "")
    return [
        Rule("one FAQ section of so many questions", (F.col("faq_sections") != 1) | (F.col("faq_questions") != faq_count)),
        *[Rule(f"{m} present", F.col(m) == 0) for m in ("image_markers", "subscribe_markers", "share_markers")],
        Rule("title", ~F.col("prose").rlike(r"(?m)^#\s+\S")),
        Rule("related section", ~F.col("prose").rlike(rf"(?m)^## {related}\s*$")),
        Rule("link syntax", residue.rlike(r"\]\s*\(|\[[^\]\n]+\]\[[^\]\n]*\]|(?m:^\s*\[[^\]]+\]:)|<a\b|<https?://")),
        Rule("link validity", F.exists("links", lambda u: ~urls.is_valid(u))),
        Rule("link without tracking", F.exists("links", lambda u: urls.is_valid(u) & ~urls.is_clean(u))),
        Rule("length", ~F.col("word_count").between(*words), "warning"),
    ]


def csv_problems(rows: DataFrame, articles: DataFrame, key: str) -> DataFrame:
    """key, number, problem of source rows (key, number, phrase, link) against their article (key, prose)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key, "link")
    j = rows.withColumn("same", F.count(F.lit(1)).over(w)).join(articles.select(key, "prose"), key)
    problems = F.array_compact(F.array(F.when(F.col("same") > 1, "repeated link"), F.when(~urls.is_clean(F.col("link")), "unclean link"), F.when(~F.contains("prose", F.col("phrase")), "phrase not in article")))
    return j.select(key, "number", F.explode(problems).alias("problem"))


def repeated_parts(shared: DataFrame, key: str, words: str = "words") -> DataFrame:
    """key, words, severity of paragraphs shared with earlier parts: a warning, from 300 words on an error."""
    s = shared.groupBy(key).agg(F.sum(words).alias("words"))
    return s.where("words > 0").withColumn("severity", F.when(F.col("words") >= 300, "error").otherwise("warning"))


def hook_problem(family: Column, hook: Column, claim_types: Column | None = None, quotations: Column | None = None, people: tuple[str, ...] = (), programs: tuple[str, ...] = ()) -> Column:
    """What a hook of a family lacks, or null.

    claim_types: the types of the claims behind it (array; without it, money needs none); quotations: excerpts that its
    source approved; people and programs: the names that a hook about a person or a program must have one of.
    """
    p, first, low = fixed.HOOKS, F.coalesce(F.get(text.sentences(hook), F.lit(0)), F.lit("")), F.lower(hook)
    count = lambda name, of: F.regexp_count(of, F.lit(p[name]))
    named = lambda names: first.rlike(r"(?i)\b(?:" + "|".join(names) + r")\b") if names else F.lit(False)
    money = F.lit(True) if claim_types is None else F.arrays_overlap(claim_types, F.lit(["MONEY", "FUNDING_ROLE"]))
    quoted = F.lit(False) if quotations is None else F.exists(quotations, lambda q: F.contains(hook, q))
    return (
        F.when((family == "MONEY") & ~(low.rlike(p["MONEY"]) & money), "figure or funding mechanism")
        .when((family == "TIMELINE") & (count("TIMELINE date", hook) < 2) & (count("TIMELINE step", low) < 2), "two chronological anchors")
        .when((family == "QUOTE") & ~F.coalesce(quoted, F.lit(False)), "source-approved quotation")
        .when((family == "PERSON") & ~named(people), "named person")
        .when((family == "DOCUMENT") & ~first.rlike(p["DOCUMENT"]), "specific record")
        .when((family == "CONTRADICTION") & ~hook.rlike(p["CONTRADICTION"]), "facts in tension")
        .when((family == "CONNECTION") & ~hook.rlike(p["CONNECTION"]), "documented relationship")
        .when((family == "PROGRAM_NAME") & ~named(programs), "program or institution")
        .when((family == "FOLLOW_THE_PAPER_TRAIL") & (count("FOLLOW_THE_PAPER_TRAIL", hook) < 2), "sequence of records")
        .when((family == "QUESTION") & ~F.contains(first, F.lit("?")), "question")
        .when((family == "ORDINARY_EXPLANATION_VS_RECORD") & ~(F.contains(low, F.lit("ordinary explanation")) & low.rlike(p["ORDINARY"])), "explanation and record")
    )


def package_rules() -> list[Rule]:
    """Rules over assets (content_id, same_id, unsupported, duration, rendered, copy)."""
    return [
        Rule("content id unique", F.col("same_id") > 1),
        Rule("assertions supported", F.col("unsupported") > 0),
        Rule("duration", F.col("duration") == "FAIL"),
        Rule("copy as rendered", F.col("rendered") != F.col("copy")),
    ]


def learning_state(flags: DataFrame, candidates: DataFrame, key: str = "key") -> DataFrame:
    """key and state of revisions (key, has_snapshot, has_final, has_diff) by their files and candidates (key, status)."""
    c = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "promoted").alias("promoted"), F.count_if(F.col("status") == "approved").alias("approved"))
    j = flags.join(c, key, "left").na.fill(0, ["n", "pending", "promoted", "approved"])
    state = (
        F.when(~F.col("has_snapshot"), "no snapshot").when(~F.col("has_final"), "awaiting final").when(~F.col("has_diff"), "awaiting comparison").when(F.col("n") == 0, "no candidates")
        .when(F.col("pending") > 0, "pending review").when(F.col("approved") > 0, "ready to promote").when(F.col("promoted") > 0, "promoted").otherwise("closed")
    )
    return j.select(key, state.alias("state"))


def promoted(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with the approved ones of general scope marked promoted, the rows promoted)."""
    go = (F.col("status") == "approved") & (F.col("scope") != "article-specific")
    return candidates.withColumn("status", F.when(go, "promoted").otherwise(F.col("status"))), candidates.where(go)


def access_reconciled(articles: DataFrame, of: str = "body") -> DataFrame:
    """canonical_url, before, after, boundary of full articles whose text ends at a preview boundary."""
    b = text.preview_boundary(F.col(of))
    return articles.where("content_status = 'full'").select("canonical_url", F.col("content_status").alias("before"), F.lit("preview_only").alias("after"), b.alias("boundary")).where("boundary IS NOT NULL")


def domains() -> dict[str, list[str]]:
    return dict(fixed.LEARNING)
