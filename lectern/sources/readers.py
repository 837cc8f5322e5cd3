"""Sources: files, CSV, JSON, manifests, exports and sitemaps as frames. All reading goes through Spark's file sources."""

from __future__ import annotations

import csv
import io
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls

#: Suffixes that hold readable documents (fixed values).
SUFFIXES = ("txt", "md", "csv", "json", "html", "htm", "pdf", "docx", "rtf")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modificationTime of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_title(path: Column) -> Column:
    return F.replace(F.regexp_extract(path, r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1), F.lit("_"), F.lit(" "))


def _parse(kind: str, raw: bytes) -> str:
    body = raw.decode("utf-8-sig", "replace")
    if kind == "csv":
        return "\n".join(" | ".join(r) for r in csv.reader(io.StringIO(body)))
    if kind == "json":
        return json.dumps(json.loads(body), indent=2, ensure_ascii=False)
    if kind in ("html", "htm"):
        from .html import snapshot

        return snapshot(body, None)[4]
    if kind in ("docx", "rtf"):
        from .office import docx_text, rtf_text

        return docx_text(raw) if kind == "docx" else rtf_text(raw)
    if kind == "pdf":
        raise ValueError("no parser for pdf here")
    return body


def documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(path, title, text of readable files, path and error of those that fail). One bad file stops nothing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(suffix(F.col("path")).isin(*SUFFIXES))

    def run(batches):
        for b in batches:
            out = []
            for path, title, kind, raw in zip(b["path"], b["title"], b["kind"], b["content"]):
                try:
                    out.append((path, title, _parse(kind, bytes(raw)), None))
                except (ValueError, csv.Error) as e:
                    out.append((path, title, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "title", "text", "error"])

    rows = files.select("path", file_title(F.col("path")).alias("title"), suffix(F.col("path")).alias("kind"), "content").mapInPandas(run, "path string, title string, text string, error string")
    return rows.where("error IS NULL").select("path", "title", "text"), rows.where("error IS NOT NULL").select("path", "error")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns text; a missing file is an error."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)


#: Names that make a first row a header (fixed values).
SOURCE_HEADER = ("source_number", "number", "phrase", "anchor", "link", "url")


def source_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(number, phrase, link) of a source list, and the rows skipped for fewer than three filled columns. A header row is known by its names."""
    raw = spark.read.option("header", False).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.select(*raw.columns, *[F.lit(None).cast("string").alias(f"_c{i}") for i in range(len(raw.columns), 3)])
    cells = [F.trim(F.coalesce(F.col(f"_c{i}"), F.lit(""))) for i in range(3)]
    header = F.lower(cells[0]).isin(*SOURCE_HEADER) | F.lower(cells[1]).isin(*SOURCE_HEADER) | F.lower(cells[2]).isin(*SOURCE_HEADER)
    rows = raw.where(~header & (F.concat(*cells) != "")).select(cells[0].alias("number"), cells[1].alias("phrase"), cells[2].alias("link"))
    full = (F.col("phrase") != "") & (F.col("link") != "")
    return rows.where(full).withColumn("link", urls.without_tracking(F.col("link"))), rows.where(~full)


def tolerant_json(raw: Column, schema: str) -> Column:
    """A typed record of JSON text; what can't be read is a record of nulls."""
    return F.coalesce(F.from_json(raw, schema, {"mode": "PERMISSIVE"}), F.from_json(F.lit("{}"), schema))


def gold_articles(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Approved entries (path, title, approved) whose file is in a listing and doesn't climb out of the root."""
    ok = registry.where(F.col("approved") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)"))
    return ok.join(files.select("path").distinct(), "path", "left_semi")


def context_roles(files: DataFrame, primary: list[str], lookup: list[str], research: str = "research/") -> DataFrame:
    """role, path: the files of a project (path) that its writer gets, those the writer may look up, and all below the research folder for its auditor."""
    p = F.col("path")
    roles = F.array_compact(F.array(F.when(p.isin(primary), "writer_primary"), F.when(p.isin(lookup), "writer_lookup_only"), F.when(p.startswith(research), "auditor_full_research")))
    return files.select(F.explode(roles).alias("role"), "path").distinct()


def known_urls(articles: DataFrame, url: str = "canonical_url") -> DataFrame:
    return articles.select(urls.identity(F.col(url)).alias("identity")).where("identity IS NOT NULL").distinct()


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """series and its parts, one row each, of multi-line JSON manifests."""
    part = "array<struct<number:int,title:string,slug:string,status:string,finale:boolean,previous:string,next:string,published_url:string>>"
    m = spark.read.schema(f"schema_version int, title string, slug string, status string, planned_parts int, parts {part}").option("multiLine", True).json(path)
    return m.select(F.col("slug").alias("series"), F.explode("parts").alias("p")).select("series", "p.*")


def export_identity(post_id: Column, slug: Column) -> Column:
    """id and slug of an exported row: `123.some-slug`, a slug of its own wins."""
    return F.struct(F.nullif(F.regexp_extract(post_id, r"^(\d+)\.(.+)$", 1), F.lit("")).alias("id"), F.coalesce(F.nullif(F.trim(slug), F.lit("")), F.nullif(F.regexp_extract(post_id, r"^(\d+)\.(.+)$", 2), F.lit(""))).alias("slug"))


def is_published(posts: DataFrame) -> Column:
    """True without a flag column, else for true, 1, yes and published."""
    flags = [c for c in ("is_published", "published", "status") if c in posts.columns]
    return F.lower(F.trim(F.col(flags[0]).cast("string"))).isin("true", "1", "yes", "published") if flags else F.lit(True)


def author_export(posts: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posts with their bodies, rejected posts with a reason, a summary row). bodies: name, body.

    A post's body is the file named post_id, id.slug, slug or id, the first of these that is there.
    """
    p = posts.withColumn("who", export_identity(F.col("post_id"), F.col("slug") if "slug" in posts.columns else F.lit(None).cast("string"))).withColumn("published_", is_published(posts))
    names = F.array_compact(F.array("post_id", F.concat_ws(".", "who.id", "who.slug"), "who.slug", "who.id"))
    tried = p.select("post_id", F.posexplode(names).alias("rank", "name"))
    found = tried.join(bodies, "name").groupBy("post_id").agg(F.min_by("body", "rank").alias("body"))
    j = p.join(found, "post_id", "left").withColumn("reason", F.when(~F.col("published_"), "unpublished").when(F.col("body").isNull(), "no body"))
    kept = j.where("reason IS NULL").drop("reason", "published_")
    summary = j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("reason").isNull()).alias("imported"), F.count_if(F.col("reason") == "unpublished").alias("unpublished"), F.count_if(F.col("reason") == "no body").alias("bodiless"))
    return kept, j.where("reason IS NOT NULL").select("post_id", "reason"), summary


def sitemap_urls(xml: Column) -> Column:
    """http(s) addresses of all loc elements of a sitemap, well formed or not."""
    locs = F.regexp_extract_all(xml, F.lit(r"(?is)<loc[^>]*>(.*?)</loc>"), F.lit(1))
    plain = F.transform(locs, lambda x: F.trim(F.replace(F.regexp_replace(F.regexp_replace(x, r"<!\[CDATA\[|\]\]>", ""), "<[^>]+>", ""), F.lit("&amp;"), F.lit("&"))))
    return F.filter(plain, lambda u: u.rlike("^https?://"))


def sitemap_parts(pages: DataFrame) -> DataFrame:
    """url, is_index, locs and error of stored sitemaps (url, xml): read as XML, else what can be salvaged; an error where that is nothing."""
    from xml.etree import ElementTree

    def strict(xml: str) -> tuple[bool, list[str]]:
        name = lambda e: e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""
        root = ElementTree.fromstring(xml)
        return name(root) == "sitemapindex", [e.text.strip() for e in root.iter() if name(e) == "loc" and e.text]

    def run(batches):
        for b in batches:
            out = []
            for url, xml, salvaged in zip(b["url"], b["xml"], b["salvaged"]):
                try:
                    out.append((url, *strict(xml or ""), None))
                except (ElementTree.ParseError, ValueError) as e:
                    locs = list(salvaged) if salvaged is not None else []
                    out.append((url, "<sitemapindex" in (xml or "").lower(), locs, None if locs else f"XML parse failed: {e}"))
            yield pd.DataFrame(out, columns=["url", "is_index", "locs", "error"])

    return pages.select("url", "xml", sitemap_urls(F.col("xml")).alias("salvaged")).mapInPandas(run, "url string, is_index boolean, locs array<string>, error string")


def sitemap_walk(pages: DataFrame, start: str, most_maps: int = 30) -> tuple[DataFrame, DataFrame]:
    """(loc and map of the post URLs that sitemaps name, url and error of those that failed), beginning at one URL.

    pages: url, xml, as stored.  An index leads to the maps it names, depth first, each URL once, and no more than
    `most_maps` of them, so cycles end.  Maps are looked up a level at a time; the driver sees the names of at most
    `most_maps` children of an index, and never the posts.
    """
    spark = pages.sparkSession
    stored = pages.select(urls.canonical(F.col("url")).alias("url"), "xml").groupBy("url").agg(F.max("xml").alias("xml"))
    first = spark.createDataFrame([(start,)], "u string").select(urls.canonical(F.col("u"))).first()[0]
    seen: dict[str, tuple[bool, list[str], str | None]] = {}
    level = [first]
    while level:
        found = sitemap_parts(stored.where(F.col("url").isin(level))).select("url", "is_index", "error", F.when(F.col("is_index"), F.slice(F.array_distinct(F.transform("locs", urls.canonical)), 1, most_maps)).alias("next")).collect()
        got = {r["url"]: (bool(r["is_index"]), list(r["next"] or []), r["error"]) for r in found}
        seen |= {u: got.get(u, (False, [], "not stored")) for u in level}
        level = list(dict.fromkeys(c for u in level for c in seen[u][1] if c not in seen))
    visited: dict[str, None] = {}

    def visit(u: str) -> None:
        if u in visited or len(visited) >= most_maps:
            return
        visited[u] = None
        for c in seen[u][1]:
            visit(c)

    visit(first)
    leaves = [u for u in visited if not seen[u][0] and seen[u][2] is None]
    failed = spark.createDataFrame([(u, seen[u][2]) for u in visited if seen[u][2]], "url string, error string")
    posts = sitemap_parts(stored.where(F.col("url").isin(leaves))).select(F.col("url").alias("map"), F.explode_outer("locs").alias("loc")).where(urls.is_post(F.col("loc")))
    return posts.select(urls.canonical(F.col("loc")).alias("loc"), "map").distinct(), failed


def page_metrics(docs: DataFrame, key: str, of: str) -> DataFrame:
    """key, pages, text_chars, nonempty_pages (20 characters or more) and low_text_pages of form-feed texts."""
    p = F.transform(F.split(of, "\f"), text.stripped)
    low = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: F.length(F.element_at("p", i)) < 20)
    return docs.select(key, p.alias("p")).select(key, F.size("p").alias("pages"), F.aggregate("p", F.lit(0), lambda a, x: a + F.length(x)).alias("text_chars"), (F.size("p") - F.size(low)).alias("nonempty_pages"), low.alias("low_text_pages"))


def all_matches(docs: DataFrame, key: str, of: str, pattern: str, before: int = 260, after: int = 520) -> DataFrame:
    """key, page, at, context of every match on squeezed pages; match places have no SQL form, so pages are searched in batches."""

    def run(batches):
        for b in batches:
            out = [(k, n, m.start(), t[max(0, m.start() - before) : m.start() + after]) for k, n, t in zip(b[key], b["page"], b["t"]) for m in re.finditer(pattern, t, re.I)]
            yield pd.DataFrame(out, columns=[key, "page", "at", "context"])

    p = docs.select(key, F.posexplode(F.split(of, "\f")).alias("n", "raw")).select(key, (F.col("n") + 1).alias("page"), text.squeezed(F.col("raw")).alias("t"))
    return p.mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, page int, at int, context string")
