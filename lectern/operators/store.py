"""Registry and evidence tables as frames: ids, upserts, precedence, child rows, inventories and reports.

A store is a snapshot; a write returns the next snapshot.  Orders that ids depend on are columns, never row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import ascii_lower

# Schemas of the tables, as DDL.
ARTICLES = ("id long, wr_id string, title string, slug string, canonical_url string, published_date string, author string, content_hash string, "
    "content_status string, local_dir string, word_count int, last_seen string, last_synced string")
LINKS = "id long, article_id long, anchor string, url string, link_kind string"
SOURCES = "id long, title string, source_kind string, url string, file_path string, reliability string"
EVIDENCE = ("id long, evidence_id string, source_id long, claim string, excerpt string, excerpt_verified boolean, support_type string, reliability string, "
    "entities array<string>, significance string, published_date string, author string")
RESEARCH_RUNS = "id long, question_id string, query string, notes string, citations array<struct<title: string, url: string>>"


def record_id(n: Column, prefix: str = "WR", width: int = 6) -> Column:
    return F.format_string(f"{prefix}-%0{width}d", n.cast("long"))


def content_id(parts: list[Column], n: Column) -> Column:
    return F.concat_ws("-", *[F.upper(F.regexp_replace(p, "[^A-Za-z0-9]", "")) for p in parts], F.format_string("%03d", n.cast("long")))


def article_id(part: Column) -> Column:
    return F.format_string("%02d", part.cast("long"))


def is_iso_date(value: Column) -> Column:
    """An ISO-8601 time with a zone."""
    return F.coalesce(value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$") & F.try_to_timestamp(value).isNotNull(), F.lit(False))


def year_of(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(value, r"^(\d{4})", 1), F.lit("")), F.lit(default))


def access_level(partial: Column, n_words: Column) -> Column:
    return F.when(partial, "PARTIAL_PREVIEW").when(n_words < 20, "TITLE_ONLY").otherwise("FULL_PUBLIC")


def source_priority(origin: Column, access: Column) -> Column:
    out = F.when(access == "FULL_AUTHOR_EXPORT", fixed.ACCESS_PRIORITY["FULL_AUTHOR_EXPORT"]).when(origin == "verified_local_author_copy", fixed.LOCAL_COPY_PRIORITY)
    for k, v in fixed.ACCESS_PRIORITY.items():
        out = out.when(access == k, v)
    return out.otherwise(0)


def listed(articles: DataFrame) -> DataFrame:
    """Newest date first (dates compare as text, null as empty), then the highest id."""
    return articles.orderBy(F.coalesce("published_date", F.lit("")).desc(), F.col("id").desc())


def looked_up(articles: DataFrame, url: str, key: str = "canonical_url") -> DataFrame:
    """The article of a URL; the filter reaches the scan."""
    return articles.where(F.col(key) == url)


def with_sources(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence with source_title and locator (URL, else file path) of its source."""
    s = sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"), F.coalesce("url", "file_path").alias("locator"))
    return evidence.join(s, "source_id")


def missing_from(articles: DataFrame, discovered: DataFrame, key: str = "canonical_url") -> DataFrame:
    """Articles that a discovery run didn't find."""
    return articles.join(discovered.select(key), key, "left_anti")


def to_sync(discovered: DataFrame, articles: DataFrame, key: str = "canonical_url") -> DataFrame:
    """Discovered rows (key, lastmod) that are new, or changed after they were last synced; a row without lastmod is unchanged."""
    j = discovered.join(articles.select(key, F.col("last_synced").alias("synced_")), key, "left")
    return j.where("synced_ IS NULL OR coalesce(lastmod > synced_, false)").drop("synced_")


def prior_kept(rows: DataFrame, prior: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows with the values that an earlier run's rows of the same key have, where these aren't null."""
    old = prior.select(key, *[F.col(c).alias(f"old_{c}") for c in columns])
    j = rows.join(old, key, "left")
    return j.select(*[F.coalesce(F.col(f"old_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def stable_ids(new: DataFrame, old: DataFrame, match: str, order: str) -> DataFrame:
    """New rows with kept_id: the id of the old row with the same `match`; equal ones are paired in their orders."""
    at = lambda by: F.row_number().over(Window.partitionBy(match).orderBy(by))
    o = old.select(match, F.col("id").alias("kept_id"), at("id").alias("at_"))
    return new.withColumn("at_", at(order)).join(o, [match, "at_"], "left").drop("at_")


def linked_parts(parts: DataFrame, series: str, number: str, name: str) -> DataFrame:
    """Parts with previous and next: the names of their neighbours in the series."""
    w = Window.partitionBy(series).orderBy(number)
    return parts.withColumns({"previous": F.lag(name).over(w), "next": F.lead(name).over(w)})


def registry_counts(articles: DataFrame) -> DataFrame:
    """One row: articles, full, previews, distinct bodies and words."""
    full = F.col("content_status") == "full"
    return articles.agg(F.count(F.lit(1)).alias("articles"), F.count_if(full).alias("full"), F.count_if(F.col("content_status") == "preview_only").alias("previews"), F.countDistinct("content_hash").alias("bodies"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))


def by_year(articles: DataFrame, default: str = "undated") -> DataFrame:
    """year, discovered, full, previews of articles by their published year."""
    a = articles.groupBy(year_of(F.col("published_date"), default).alias("year"))
    return a.agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("content_status") == "full").alias("full"), F.count_if(F.col("content_status") == "preview_only").alias("previews"))


def discovered(**sources: DataFrame) -> DataFrame:
    """url, found_by: the distinct URLs of several sources (url), with the names of those that have each, sorted."""
    parts = [d.select("url", F.lit(name).alias("source_")) for name, d in sources.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.where("url IS NOT NULL").groupBy("url").agg(F.array_sort(F.collect_set("source_")).alias("found_by"))


def discovery_counts(found: DataFrame) -> DataFrame:
    """source, urls, alone: how many URLs of `discovered` each source has, and has alone."""
    each = found.select(F.explode("found_by").alias("source"), (F.size("found_by") == 1).alias("alone"))
    return each.groupBy("source").agg(F.count(F.lit(1)).alias("urls"), F.count_if("alone").alias("alone"))


def refreshed(articles: DataFrame, errors: DataFrame, snapshot: DataFrame, key: str = "canonical_url", changed_by: tuple[str, ...] = ("content_hash", "content_status")) -> tuple[DataFrame, DataFrame]:
    """(the merged articles without those missing from the snapshot being marked, errors without those of refreshed keys)."""
    merged = upsert(articles, snapshot, key, changed_by)
    kept = merged.withColumn("state", F.when(F.col("state") == "missing", "unchanged").otherwise(F.col("state")))
    return kept, errors.join(snapshot.select(key), key, "left_anti")


def stratified(df: DataFrame, group: str, order: list[Column], groups: int) -> DataFrame:
    """The first row in an order of each of the first `groups` groups."""
    return first_by(df, [F.col(group)], *order).orderBy(group).limit(groups)


def examples(rows: DataFrame, key: str, first: tuple[str, list[str]], then: tuple[str, list[str]], by: str, limit: int = 6) -> DataFrame:
    """`limit` rows in order: for each value of one column its largest row (by a number; by key among equals), then for each
    value of another its largest row that isn't picked, then the largest of the rest. first, then: (column, values in order).

    Each step is a maximum for each value; what is sorted is the picks and the `limit` largest rows.
    """
    big, row = F.struct(F.col(by), (-F.col(key)).alias("k")), F.struct(*rows.columns)

    def picks(df: DataFrame, column: str, values: list[str], step: int) -> DataFrame:
        best = df.where(F.col(column).isin(values)).groupBy(column).agg(F.max_by(row, big).alias("r"))
        return best.select(F.lit(step).alias("step"), F.array_position(F.lit(values), F.col(column)).alias("at"), "r.*")

    one = picks(rows, *first, 0)
    two = picks(rows.join(F.broadcast(one.select(key)), key, "left_anti").select(rows.columns), *then, 1)  # a row for each value
    picked = one.unionByName(two)
    rest = rows.join(F.broadcast(picked.select(key)), key, "left_anti").select(F.lit(2).alias("step"), F.lit(0).cast("long").alias("at"), *rows.columns).orderBy(F.col(by).desc(), key).limit(limit)
    return picked.unionByName(rest).orderBy("step", "at", F.col(by).desc(), key).limit(limit).drop("step", "at")


def first_by(df: DataFrame, keys: list[Column], *order: Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def upsert(old: DataFrame, new: DataFrame, key: str = "canonical_url", changed_by: tuple[str, ...] = ("content_hash", "content_status"), seq: str = "seq") -> DataFrame:
    """The merged snapshot with `state`: new, updated, unchanged or missing. Ids of new rows go on from the largest in the order of `seq`.

    One full outer join on the key; columns come from the new side where it has the key.
    """
    names = [c for c in old.columns if c not in (key, "id")]
    o = old.select(key, F.col("id"), *[F.col(c).alias(f"old_{c}") for c in names])
    n = new.select(key, F.col(seq).alias("seq_"), *[F.col(c).alias(f"new_{c}") for c in names])
    same = F.lit(True)
    for c in changed_by:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    j = o.join(n, key, "full").withColumn("state", F.when(F.col("seq_").isNull(), "missing").when(F.col("id").isNull(), "new").when(same, "unchanged").otherwise("updated"))
    fresh = j.where("state = 'new'")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top_"))
    numbered = numbers(fresh, "seq_", "no_").crossJoin(F.broadcast(top)).withColumn("id", F.col("top_") + F.col("no_")).drop("top_", "no_")
    both = j.where("state <> 'new'").unionByName(numbered)
    return both.select("id", key, "state", *[F.when(F.col("seq_").isNull(), F.col(f"old_{c}")).otherwise(F.col(f"new_{c}")).alias(c) for c in names])


def running(df: DataFrame, order: str, value: Column, name: str, ranges: int = 200) -> DataFrame:
    """The sum of a value over the rows before each in an order, by sums of ranges of it, so that no task sees all rows."""
    cuts = df.select(F.percentile_approx(F.col(order).cast("double"), [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    bounds = [float(c) for c in sorted(set(cuts))]
    # the order's value beside each bound: what Spark infers of a join's keys can't look into a lambda
    side = F.arrays_zip(F.lit(bounds).cast("array<double>").alias("c"), F.array_repeat(F.col(order).cast("double"), len(bounds)).alias("v"))
    part = F.size(F.filter(side, lambda x: x["c"] < x["v"])) if cuts else F.lit(0)
    parted = df.withColumn("part_", part).withColumn("value_", value)
    counts = parted.groupBy("part_").agg(F.sum("value_").alias("n_"))  # at most `ranges` rows
    before = counts.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    own = F.coalesce(F.sum("value_").over(Window.partitionBy("part_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parted.withColumn("own_", own).join(F.broadcast(before), "part_").withColumn(name, F.col("before_") + F.col("own_")).drop("part_", "value_", "own_", "before_")


def numbers(df: DataFrame, order: str, name: str, ranges: int = 200) -> DataFrame:
    """Rows numbered from 1 in an order."""
    return running(df, order, F.lit(1).cast("long"), name, ranges).withColumn(name, F.col(name) + 1)


def touched(articles: DataFrame, seen: DataFrame, key: str = "canonical_url") -> DataFrame:
    """last_seen moved on to the latest observation of each key."""
    latest = seen.groupBy(key).agg(F.max("observed_at").alias("at_"))
    return articles.join(latest, key, "left").withColumn("last_seen", F.greatest("last_seen", "at_")).drop("at_")


def with_status(articles: DataFrame, changes: DataFrame, key: str = "canonical_url") -> DataFrame:
    """content_status replaced by changes (key, status); a status but full or preview_only, or an unknown key, is an error when read."""
    known = articles.select(key, F.lit(True).alias("known_"))
    checked = changes.join(known, key, "left").select(key, F.when(F.col("known_").isNull(), F.raise_error(F.lit("unknown key"))).when(~F.col("status").isin("full", "preview_only"), F.raise_error(F.lit("unknown status"))).otherwise(F.col("status")).alias("status_"))
    return articles.join(checked, key, "left").withColumn("content_status", F.coalesce("status_", "content_status")).drop("status_")


def replaced_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """All links of the articles in `new` replaced by its links with an anchor and a URL."""
    kept = links.join(new.select("article_id").distinct(), "article_id", "left_anti")
    return kept.unionByName(new.where("trim(anchor) <> '' AND trim(url) <> ''").select(*kept.columns))


def links_of(links: DataFrame, articles: DataFrame, url: str) -> DataFrame:
    one = articles.where(F.col("canonical_url") == url).select(F.col("id").alias("article_id"))
    return links.join(one, "article_id").select("id", "anchor", "url", F.col("link_kind").alias("type")).orderBy("id")


def merged_by_priority(observations: DataFrame, key: str, priority: Column, *order: Column) -> tuple[DataFrame, DataFrame]:
    """(the winner of each key, the observations that lost): the highest priority wins, among equals the last in order."""
    w = Window.partitionBy(key).orderBy(priority.desc(), *order)
    ranked = observations.withColumn("rank_", F.row_number().over(w))
    return ranked.where("rank_ = 1").drop("rank_"), ranked.where("rank_ > 1").drop("rank_")


def evidence_kept(items: DataFrame, seq: str = "seq") -> DataFrame:
    """The first item of each source and claim (claims equal in ASCII case), with evidence_id in the order of `seq`."""
    first = first_by(items.withColumn("claim_key_", ascii_lower(F.col("claim"))), [F.col("source_id"), F.col("claim_key_")], F.col(seq)).drop("claim_key_")
    return numbers(first, seq, "no_").withColumn("evidence_id", record_id(F.col("no_"), "EV", 4)).drop("no_")


def sources_kept(sources: DataFrame, seq: str = "seq") -> DataFrame:
    """One source of each URL, else of each file path; one with neither is an error when read; a blank title becomes `Untitled source`."""
    key = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.nullif(F.col("file_path"), F.lit("")), F.raise_error(F.lit("a source needs a URL or a file path")).cast("string"))
    first = first_by(sources.withColumn("key_", key), [F.col("key_")], F.col(seq)).drop("key_")
    titled = first.withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled source")))
    return numbers(titled, seq, "id")


def packet(evidence: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """id and a rendered section of the first items, each with its source."""
    first = evidence.orderBy("id").limit(limit)
    flag = F.when(F.col("excerpt_verified"), "VERIFIED").otherwise("UNVERIFIED")
    entities = F.array_join(F.slice(F.coalesce("entities", F.array().cast("array<string>")), 1, 15), ", ")
    return with_sources(first, sources).select("id", F.format_string("## %s [%s]\nSource: %s (%s)\nClaim: %s\nExcerpt: %s\nEntities: %s", "evidence_id", flag, "source_title", "locator", "claim", F.substring("excerpt", 1, 900), entities).alias("section"))


def duplicate_of(df: DataFrame, digest: str, owner: str) -> DataFrame:
    """duplicate_of: the first owner with the same digest, null for the first itself."""
    first = df.groupBy(digest).agg(F.min(owner).alias("first_"))
    return df.join(first, digest).withColumn("duplicate_of", F.when(F.col("first_") != F.col(owner), F.col("first_"))).drop("first_")


def inventory(articles: DataFrame, failures: DataFrame, missing: DataFrame, key: str = "canonical_url") -> DataFrame:
    """Articles with failure and missing flag, and failures of unknown keys as rows of their own."""
    f = failures.groupBy(key).agg(F.max("error").alias("error"))
    known = articles.join(f, key, "left").join(missing.select(key).distinct().withColumn("missing_", F.lit(True)), key, "left").withColumn("missing", F.coalesce("missing_", F.lit(False))).drop("missing_")
    rest = f.join(articles.select(key), key, "left_anti").withColumn("missing", F.lit(False))
    return known.unionByName(rest, allowMissingColumns=True)


def signature(articles: DataFrame, version: int = 4) -> DataFrame:
    """One row: a digest over all (url, hash, status), independent of their order and summed by partition."""
    each = F.sha2(F.concat_ws("|", "canonical_url", "content_hash", "content_status"), 256)
    total = articles.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.conv(F.substring(each, at, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{at}") for at in (1, 13, 25)])
    return total.select(F.sha2(F.concat_ws("|", F.lit(str(version)), "n", "s1", "s13", "s25"), 256).alias("signature"))


def transitions_broken(moves: DataFrame, allowed: list[tuple[str, str]], current: str = "current", target: str = "target") -> DataFrame:
    """The moves that aren't allowed (the edges are a constant of the machine)."""
    edges = moves.sparkSession.createDataFrame(allowed, f"{current} string, {target} string")
    return moves.join(F.broadcast(edges), [current, target], "left_anti")


def budgeted(docs: DataFrame, order: str, length: Column, per_document: int, total: int) -> DataFrame:
    """granted: what each document in order gets of a running budget, at most per_document."""
    ask = running(docs.withColumn("ask_", F.least(length, F.lit(per_document))), order, F.col("ask_"), "spent_")
    return ask.withColumn("granted", F.greatest(F.lit(0), F.least(F.col("ask_"), total - F.col("spent_")))).drop("ask_", "spent_")


def series_status(parts: DataFrame) -> DataFrame:
    """complete if the last part is the finale and all are done, active if any is begun, else planned."""
    a = parts.groupBy("series").agg(F.max_by("finale", "number").alias("f"), F.bool_and(F.col("status") == "complete").alias("all"), F.bool_or(F.col("status") != "planned").alias("any"))
    return a.select("series", F.when(F.col("f") & F.col("all"), "complete").when(F.col("any"), "active").otherwise("planned").alias("status"))


def resolved_dirs(articles: DataFrame, listing: DataFrame, suffix_parts: int = 2) -> DataFrame:
    """local_dir rebased on a listing of present folders by its last parts; a path that climbs (..) resolves to nothing."""
    tail = F.regexp_extract(F.translate("local_dir", "\\", "/"), r"((?:[^/]+/){%d}[^/]+)/?$" % (suffix_parts - 1), 1)
    found = listing.select(F.col("path").alias("resolved_dir"), F.regexp_extract("path", r"((?:[^/]+/){%d}[^/]+)/?$" % (suffix_parts - 1), 1).alias("tail_")).groupBy("tail_").agg(F.min("resolved_dir").alias("resolved_dir"))
    return articles.withColumn("tail_", F.when(~F.col("local_dir").rlike(r"(^|[/\\])\.\.([/\\]|$)"), tail)).join(found, "tail_", "left").drop("tail_")


def preserved(df: DataFrame, path: str) -> None:
    """Written once; what is there already stays."""
    df.write.mode("ignore").parquet(path)
