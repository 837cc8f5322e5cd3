"""Declarative rules: each is a name, a severity and a Column that is true where the rule is broken."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Column
    severity: str = "error"


def violations(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """key, rule, severity: one row for each rule that a row breaks (a null condition isn't a breach). One pass, one explode."""
    each = [F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules]
    return df.select(key, F.explode(F.array_compact(F.array(*each))).alias("v")).select(key, "v.rule", "v.severity")


def verdicts(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """key, errors, warnings, status: PASS without errors."""
    return judged(df, rules).select(key, "errors", "warnings", "status")


def judged(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows with their errors, warnings and status: PASS without errors."""
    n = lambda s: sum((F.coalesce(r.broken, F.lit(False)).cast("int") for r in rules if r.severity == s), F.lit(0))
    return df.select("*", n("error").alias("errors"), n("warning").alias("warnings")).withColumn("status", F.when(F.col("errors") == 0, "PASS").otherwise("FAIL"))


def learning_rules() -> list[Rule]:
    return [Rule(f"{name} domain", ~F.coalesce(F.col(name).isin(values), F.lit(False))) for name, values in fixed.LEARNING.items()]


def manifest_rules(parts: DataFrame, series: str = "series") -> tuple[DataFrame, list[Rule]]:
    """The parts of series with their neighbours, and the rules of a manifest over them."""
    w = Window.partitionBy(series).orderBy("number")
    whole = Window.partitionBy(series)
    rows = parts.withColumns({
        "at_": F.row_number().over(w), "before_": F.lag("slug").over(w), "after_": F.lead("slug").over(w), "last_": F.max("number").over(whole),
        "same_slug_": F.count("slug").over(Window.partitionBy(series, "slug")), "same_url_": F.count("published_url").over(Window.partitionBy(series, "published_url")),
    })
    return rows, [
        Rule("numbers run from 1", F.col("number") != F.col("at_")),
        Rule("slug form", ~F.col("slug").rlike("^[a-z0-9]+(-[a-z0-9]+)*$")),
        Rule("slug unique", F.col("same_slug_") > 1),
        Rule("url unique", F.col("published_url").isNotNull() & (F.col("same_url_") > 1)),
        Rule("previous is the neighbour", ~F.col("previous").eqNullSafe(F.col("before_"))),
        Rule("next is the neighbour", ~F.col("next").eqNullSafe(F.col("after_"))),
        Rule("only the last is the finale", F.col("finale") & (F.col("number") != F.col("last_"))),
        Rule("status domain", ~F.col("status").isin("planned", "drafting", "review", "complete", "published")),
    ]


def rabbit_hole_rules() -> list[Rule]:
    """Rows: disposition, searches, records_read, connections (arrays), stopping_reason, contrary_evidence, blocker."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    filled = lambda c: F.size(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    exhausted = F.col("disposition") == "EXHAUSTED"
    return [
        Rule("disposition domain", ~F.coalesce(F.col("disposition").isin("EXHAUSTED", "BLOCKED", "DEFERRED", "OPEN"), F.lit(False))),
        Rule("exhausted after two searches", exhausted & (filled("searches") < 2)),
        Rule("exhausted with records read", exhausted & (filled("records_read") < 1)),
        Rule("exhausted with a stopping reason", exhausted & blank(F.col("stopping_reason"))),
        Rule("blocked by something", (F.col("disposition") == "BLOCKED") & blank(F.col("blocker"))),
        Rule("deferred for a reason", (F.col("disposition") == "DEFERRED") & blank(F.col("stopping_reason"))),
    ]


def analytics_problems(rows: DataFrame, key: str, numeric: list[str]) -> DataFrame:
    """key and field of values that aren't plain numbers; empty ones are none."""
    long = rows.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in numeric])).alias("x"))
    return long.select(key, "x.field", "x.value").where(r"value <> '' AND NOT value RLIKE '^[0-9]+([.][0-9]+)?$'")


def platform_issue(platform: Column, form: Column, words: Column, posts: Column) -> Column:
    return (
        F.when((platform == "facebook") & (form == "LONG") & ~words.between(150, 300), "FACEBOOK_LONG_DEPTH")
        .when((platform == "reddit") & (words < 100), "REDDIT_STANDALONE_DEPTH")
        .when((platform == "x") & (form == "THREAD") & (posts < 3), "THREAD_PROGRESSION")
    )


def spoiler_allowed(asset_part: Column, fact_part: Column, teaser_safe: Column) -> Column:
    return (fact_part <= asset_part) | teaser_safe


def thesis_status(source_terms: Column, story_terms: Column) -> Column:
    """drift where both have five terms or more and overlap by less than 0.16."""
    from ..functions.text import jaccard

    return F.when((F.size(source_terms) >= 5) & (F.size(story_terms) >= 5) & (jaccard(source_terms, story_terms) < 0.16), "DRIFT").otherwise("FAITHFUL")


def quality_gates(rows: DataFrame, text: str = "text") -> DataFrame:
    """gate, status and evidence of Markdown table rows keyed A to G with a known status."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    lines = rows.select(F.explode(F.split(text, "\n")).alias("line")).where("trim(line) LIKE '|%'")
    c = lines.select(cells.alias("c")).where("size(c) >= 3")
    return c.select(F.upper(F.substring(F.col("c")[0], 1, 1)).alias("gate"), F.upper(F.col("c")[1]).alias("status"), F.col("c")[2].alias("evidence")).where(F.col("gate").rlike("^[A-G]$") & F.col("status").isin("PASS", "FAIL", "PENDING", "NOT APPLICABLE"))


def gate_report(found: DataFrame) -> DataFrame:
    """All seven gates: what was found (of several, the first in the alphabet, so that a FAIL shows), else PENDING."""
    default = found.sparkSession.createDataFrame([(g,) for g in "ABCDEFG"], "gate string")
    return default.join(found.groupBy("gate").agg(F.min("status").alias("status")), "gate", "left").select("gate", F.coalesce("status", F.lit("PENDING")).alias("status"))
