"""The validator of article projects: deliverables, article, source rows, search package, working papers, as rows of findings."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text, urls
from . import articles, rules
from .rules import Rule


def _has_text(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(c, r"[\s﻿]+", " ")) != "", F.lit(False))


def csv_lines(files: DataFrame, key: str) -> DataFrame:
    """key, line, cells, error of CSV texts (key, text), the header being line 1; a text that isn't CSV is one row with its error.

    Quoting runs on over lines, so a text is read in order; texts go to Python in batches.
    """

    def run(batches):
        for b in batches:
            out = []
            for k, t in zip(b[key], b["text"]):
                try:
                    out += [(k, i, r, None) for i, r in enumerate(csv.reader(io.StringIO((t or "").removeprefix("﻿"), newline=""), strict=True), 1)] or [(k, 1, [], None)]
                except csv.Error as e:
                    out.append((k, 0, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "line", "cells", "error"])

    return files.select(key, "text").mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, line long, cells array<string>, error string")


def source_problems(lines: DataFrame, article: DataFrame, key: str) -> DataFrame:
    """key, line, problem of source rows (rows of `csv_lines`) against their article (key, prose).

    A row has a number, a phrase and a URL, all filled; of equal numbers, phrases or URLs the first stays.
    """
    links = F.transform(F.regexp_extract_all("prose", F.lit(r"\[([^\]\n]+)\]\((https?://[^\s()]+)\)"), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, r"^\[([^\]\n]+)\]", 1).alias("phrase"), F.regexp_extract(m, r"\((https?://[^\s()]+)\)$", 1).alias("url")))
    head = lines.where("line <= 1").select(key, F.col("line"), F.when(F.col("error").isNotNull(), "invalid CSV").when(F.array_join("cells", "\u0001", "") != "source_number\u0001phrase\u0001link", "header").alias("problem")).where("problem IS NOT NULL")
    full = (F.size("cells") == 3) & F.forall("cells", _has_text)
    rows = lines.where("line > 1")
    bad = rows.where(~full).select(key, "line", F.lit("three filled fields").alias("problem"))
    empty = lines.groupBy(key).agg(F.max("line").alias("last"), F.max("error").alias("error")).where("last <= 1 AND error IS NULL").select(key, F.lit(1).cast("long").alias("line"), F.lit("no source row").alias("problem"))
    r = rows.where(full).select(key, "line", *[F.col("cells")[i].alias(c) for i, c in enumerate(("number", "phrase", "url"))])
    again = lambda c: F.row_number().over(Window.partitionBy(key, c).orderBy("line")) > 1
    whole = F.col("number").rlike(r"^\d+$")
    r = r.withColumns({"value": F.when(whole, F.regexp_replace("number", "^0+(?=.)", "")), "phrase_again": again("phrase"), "url_again": again("url")}).withColumn("number_again", again("value"))
    j = r.join(article.select(key, "prose", links.alias("links")), key)
    found = F.array_compact(F.array(
        F.when(~whole | (F.col("value") == "0") | F.col("number_again"), "positive number used once"),
        F.when(F.col("phrase_again") | F.col("url_again"), "repeated phrase or URL"),
        F.when(~F.contains("prose", F.col("phrase")), "phrase not in article"),
        F.when(~F.exists("links", lambda l: (l["phrase"] == F.col("phrase")) & (l["url"] == F.col("url"))), "phrase not linked to its URL"),
        F.when(~urls.is_valid(F.col("url")), "invalid URL").when(~urls.is_clean(F.col("url")), "unclean URL"),
    ))
    each = j.select(key, "line", F.explode_outer(found).alias("problem")).where("problem IS NOT NULL")
    return head.unionByName(bad).unionByName(empty).unionByName(each)


def findings(files: DataFrame, key: str, hosts: list[str], known: DataFrame, templates: dict[str, str] | None = None, faq_count: int = 5) -> DataFrame:
    """key, severity, code, detail: all that a project's files (key, name, text) break.

    known: canonical_url of the archive's articles, which are internal wherever they are hosted; templates: texts that a
    working paper shouldn't be left at, by name.  Files are put side by side by project once; each check is a rule over that
    row, but for source rows, which are rows of their own.
    """
    p = fixed.PROJECT
    papers = [f"output/{n}" for n in p["deliverables"]] + p["papers"]
    each = {n: f"f{i}" for i, n in enumerate(dict.fromkeys(papers))}
    side = files.groupBy(key).agg(*[F.max(F.when(F.col("name") == n, F.col("text"))).alias(c) for n, c in each.items()])
    text_of = lambda n: F.regexp_replace(F.coalesce(each[n], F.lit("")), "^﻿", "")
    m = articles.metrics(side.select(key, text_of("output/article.md").alias("body")), key, "body", hosts)
    related = F.regexp_extract("prose", r"(?ms)^## YOU MAY BE INTERESTED IN THESE ARTICLES\s*\n(.*?)(?=^## |\z)", 1)
    near = m.select(key, F.explode_outer(F.regexp_extract_all(related, F.lit(articles.LINK), F.lit(1))).alias("url")).where("url IS NOT NULL")
    own = known.select(urls.identity(F.col("canonical_url")).alias("id_")).distinct().withColumn("known_", F.lit(True))
    verified = near.withColumn("id_", urls.identity(F.col("url"))).join(own, "id_", "left").where(urls.is_valid(F.col("url")) & (F.coalesce("known_", F.lit(False)) | (urls.host(F.col("url")).isin(hosts) & F.startswith(urls.path(F.col("url")), F.lit("/p/")))))
    row = m.join(side, key).join(verified.select(key, F.lit(True).alias("verified")).distinct(), key, "left")
    seo = text_of("output/seo.md")
    section = lambda f: F.regexp_extract(seo, r"(?ims)^## " + f.replace("/", r"\/") + r"[ \t]*\n(.*?)(?=^## |\z)", 1)
    checks = [
        *[Rule(f"deliverable\u0001output/{n}", ~_has_text(F.col(each[f"output/{n}"]))) for n in p["deliverables"]],
        *articles.article_rules(faq_count),
        Rule("related link verified", F.col("prose").rlike(r"(?m)^## YOU MAY BE INTERESTED IN THESE ARTICLES\s*$") & F.col("verified").isNull(), "warning"),
        *[Rule(f"search package\u0001{f}", F.col(each["output/seo.md"]).isNotNull() & ~_has_text(section(f))) for f in p["search fields"]],
        *[Rule(f"working paper\u0001{n}", ~_has_text(F.col(each[n])), "warning") for n in p["papers"]],
        *[Rule(f"working paper is a template\u0001{n}", text.stripped(text_of(n)) == t.strip(), "warning") for n, t in (templates or {}).items() if t.strip()],
        Rule("active rabbit holes", text_of("research/RABBIT_HOLE_QUEUE.md").rlike(r"(?im)^\|.*\|\s*(?:OPEN|FOLLOW|ACTIVE)\s*\|\s*$"), "warning"),
    ]
    broken = rules.violations(row, key, checks).select(key, "severity", F.split("rule", "\u0001")[0].alias("code"), F.get(F.split("rule", "\u0001"), F.lit(1)).alias("detail"))
    lines = csv_lines(files.where("name = 'output/sources.csv'"), key)
    rows = source_problems(lines, m, key).select(key, F.lit("error").alias("severity"), F.concat(F.lit("source row: "), "problem").alias("code"), F.col("line").cast("string").alias("detail"))
    return broken.unionByName(rows)


def results(projects: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, errors, warnings and result (FAIL with an error) of all projects."""
    n = found.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    j = projects.select(key).distinct().join(n, key, "left").na.fill(0, ["errors", "warnings"])
    return j.withColumn("result", F.when(F.col("errors") > 0, "FAIL").otherwise("PASS"))
