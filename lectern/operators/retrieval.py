"""Retrieval over chunks: lexical, phrase, concept, anchor, seed and semantic signals, a gate of three tiers, a rollup by article, and its links."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, search, text, urls
from ..sources import sinks
from . import vectors


def _any(hay: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(hay, F.lit(w))
    return out


def lexical_terms(query: str) -> dict[str, int]:
    """The terms that a query is searched for by, and how often each counts."""
    _, parts, free = search.query_plan(query)
    terms = list(dict.fromkeys(free or [p for p in parts if p not in fixed.GENERIC_TERMS] or parts))
    return {t: (free or [t]).count(t) or 1 for t in terms}


def term_score(f: Column, dl: Column, idf: float, mean: float) -> Column:
    """BM25 of a term that a text of dl tokens has f times."""
    return idf * f * (fixed.BM25_K1 + 1) / (f + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * F.greatest(dl, F.lit(1)) / mean))


def signals(chunks: DataFrame, query: str, concepts: list[str], lsa: "Lsa | None" = None, corpus: dict | None = None) -> DataFrame:
    """The columns that the gate and the scores of `search.TIERS` read, of each chunk, with article, start, status and links.

    chunks: article, start, title, text, status and, if there are any, section and links (anchor, url, kind).  All signals
    are columns of one projection; what the corpus says of the query (counts of its terms and phrases, the largest score, the
    vocabulary of chunks that name an entity) is one row.  With `lsa`, its rows are the chunks' vectors by (article, start).
    corpus: where the chunks are only those that can have a signal, n, mean (tokens), df (by term) and top (score) of all of them.
    """
    entities, parts, free = search.query_plan(query)
    phrases = search.query_phrases(query, entities)
    times = lexical_terms(query)
    terms = list(times)
    basis = list(dict.fromkeys(free)) or parts
    section = F.col("section") if "section" in chunks.columns else F.lit("")
    links = F.col("links") if "links" in chunks.columns else F.array().cast("array<struct<anchor:string,url:string,kind:string>>")
    hay = F.lower(F.concat_ws(" ", "title", section, "text"))
    c = chunks.select("article", "start", "status", links.alias("links"), F.lower(F.concat_ws(" ", "title", section)).alias("head"), F.lower("title").alias("title_"), hay.alias("hay"), text.lower_search_tokens(hay).alias("all"))
    outside = F.array_join(F.transform(F.filter("links", lambda l: l["kind"] != "internal_article"), lambda l: l["anchor"]), " ")
    hits = search.without_contained(F.array_compact(F.array(*[F.when(F.contains("hay", F.lit(x)), x) for x in concepts])) if concepts else F.array().cast("array<string>"))
    c = c.withColumn("tokens", F.array_distinct("all")).select(
        "article", "start", "status", "links", hits.alias("hits"), F.size("all").cast("long").alias("dl"),
        F.array(*[F.size(F.filter("all", search._same(t))).cast("double") for t in terms]).alias("tf") if terms else F.array().cast("array<double>").alias("tf"),
        F.array(*[F.contains("hay", F.lit(p)) for p in phrases]).alias("has") if phrases else F.array().cast("array<boolean>").alias("has"),
        F.array(*[F.contains("title_", F.lit(p)) for p in phrases]).alias("in_title") if phrases else F.array().cast("array<boolean>").alias("in_title"),
        F.array_intersect("tokens", F.lit(fixed.INFRASTRUCTURE_TERMS)).alias("infra_hits"), _any(F.col("hay"), entities).alias("direct"),
        (F.size(F.array_intersect("tokens", F.lit(free or [""]))) > 0).alias("free"),
        (F.size(F.array_intersect(F.array_distinct(text.search_tokens(F.col("head"))), F.lit(basis or [""]))) / max(1, len(basis))).alias("title"),
        search.anchor_score(outside, basis, phrases).alias("anchor"),
    )
    c = sinks.scratch(c)  # counts, not tokens; read for the corpus' numbers, for the largest score and for the signals
    seed = [F.max(F.col("direct") & F.array_contains("infra_hits", t)).alias(f"s{i}") for i, t in enumerate(fixed.INFRASTRUCTURE_TERMS)]
    counts = [*[F.count_if(F.col("tf")[i] > 0).alias(f"d{i}") for i in range(len(terms))], *[F.count_if(F.col("has")[i]).alias(f"p{i}") for i in range(len(phrases))]]
    row = c.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *counts, *seed).first()
    n, mean, df = row["n"], max(row["avgdl"] or 0.0, 1.0), {t: row[f"d{i}"] for i, t in enumerate(terms)}
    if corpus is not None:
        n, mean, df = corpus["n"], max(corpus["mean"], 1.0), corpus["df"]
    raw = F.lit(0.0)
    for i, t in enumerate(terms):
        raw = raw + times[t] * term_score(F.col("tf")[i], F.col("dl"), search.idf(n, df.get(t, 0)), mean)
    each = [F.when(F.col("has")[i], (math.log((n + 1) / (row[f"p{i}"] + 1)) + 1) * min(2.0, 0.75 + 0.45 * len(p.split())) * F.when(F.col("in_title")[i], 1.45).otherwise(1.0)) for i, p in enumerate(phrases)]
    best = F.slice(F.sort_array(F.array_compact(F.array(*each)), asc=False), 1, 3) if each else F.array().cast("array<double>")
    c = c.withColumn("lexical", raw)
    top = (corpus["top"] if corpus is not None else c.agg(F.max("lexical")).first()[0]) if terms else 0.0
    score, near = search.concept_score(F.col("hits"))
    shared = F.array_intersect("infra_hits", F.lit([t for i, t in enumerate(fixed.INFRASTRUCTURE_TERMS) if row[f"s{i}"]] or [""]))
    out = c.select(
        "article", "start", "status", "links", (F.col("lexical") / top if top else F.lit(0.0)).alias("lexical"), (1 - F.exp(-F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / 4)).alias("phrase"),
        score.alias("concept"), near.alias("cooccurrence"), "direct", F.size("hits").alias("n_concepts"), F.exists("hits", lambda h: F.size(text.search_tokens(h)) >= 2).alias("multi"),
        F.least(F.lit(1.0), F.size("infra_hits") / 4).alias("infra"), F.least(F.lit(1.0), F.size(shared) / 4).alias("seed"), F.size(shared).alias("n_shared"), "anchor", "free", "title",
    )
    if lsa is None:
        return out.withColumn("semantic", F.lit(0.0))
    generic = " ".join([*free, *(p for p in parts if p in fixed.GENERIC_TERMS)])
    asked = [" ".join([query, *concepts[:12]]), " ".join(free) or query, generic if entities else ""]
    similar = [search.cosine(F.col("vector"), F.lit(v)) if any(v) else F.lit(0.0) for v in (lsa.query(q) for q in asked)]
    joined = out.join(lsa.vectors(), ["article", "start"], "left")
    return joined.withColumn("semantic", F.coalesce(search.contrast(*similar, F.col("direct")), F.lit(0.0))).drop("vector")


def retrieve(chunks: DataFrame, query: str, concepts: list[str], limit: int, least: float, lsa: "Lsa | None" = None, corpus: dict | None = None) -> DataFrame:
    """article, score, tier of the best articles for a query, by the `signals` of their chunks."""
    s = sinks.scratch(signals(chunks, query, concepts, lsa, corpus).drop("links"))  # so that filters on tier and score read plain columns
    scored = s.withColumn("tier", search.tier()).where("tier IS NOT NULL").withColumn("score", search.tier_score(F.col("tier"))).where("score > 0")
    capped = scored.orderBy(F.col("score").desc(), "article", "start").limit(max(limit * 10, 50))
    tiers = capped.groupBy("article").agg(F.max_by("tier", "score").alias("tier"), F.max_by("status", "score").alias("status"))
    rolled = search.rollup(capped, "article", "score", F.col("start")).join(tiers, "article")
    penalty = F.when(F.col("status") == "full", 1.0).when(F.col("tier") == "DIRECT", 0.88).otherwise(0.68)
    out = rolled.select("article", F.round(F.col("score") * penalty, 6).alias("score"), "tier")
    return out.where(F.col("score") >= least).orderBy(F.col("score").desc(), "article").limit(limit)


def anchor_word(phrase: str) -> tuple[str, str] | None:
    """(how, word): a token that any text with the phrase has; how it equals, begins with, ends in or contains the word. Nothing if tokens can't tell.

    The words inside a phrase are whole tokens; the first may be the end of one, the last the beginning of one.  A word that a
    stop word matches the same way won't do, since stop words are no tokens.
    """
    import re

    words = phrase.split(" ")
    best: list[tuple[str, str]] = []
    for i, w in enumerate(words):
        how = "contains" if len(words) == 1 else "ends" if i == 0 else "starts" if i == len(words) - 1 else "equals"
        like = {"contains": lambda s, w=w: w in s, "ends": lambda s, w=w: s.endswith(w), "starts": lambda s, w=w: s.startswith(w), "equals": lambda s, w=w: s == w}[how]
        if re.fullmatch(r"[a-z0-9][a-z0-9_.&'-]+", w) and not any(map(like, fixed.SEARCH_STOP)):
            best.append((how, w))
    return max(best, key=lambda x: (x[0] == "equals", len(x[1])), default=None)


def retrieve_indexed(index, query: str, concepts: list[str], limit: int, least: float) -> DataFrame:
    """`retrieve` over the chunks that an `index.Index` serves, by its postings, and by its vectors if it has any.

    No tier is without an entity, a concept or an infrastructure term, so only chunks with one of these, or with a phrase (to
    count it), are read; terms' document counts and the largest lexical score come from the postings of the query's terms.
    Phrases are substrings: their chunks are found by a token that each must have, and read to be sure.
    """
    entities, _, _ = search.query_plan(query)
    times = lexical_terms(query)
    n, mean = index.meta["chunks"], index.meta["tokens"] / max(1, index.meta["chunks"])
    posted = index.postings(list(times))
    df = {r["term"]: r["n"] for r in posted.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each term of the query
    weight = F.lit(0.0)
    for t, k in times.items():
        weight = F.when(F.col("term") == t, k * term_score(F.col("tf").cast("double"), F.col("dl"), search.idf(n, df.get(t, 0)), max(mean, 1.0))).otherwise(weight)
    top = posted.groupBy("canonical_url", "chunk").agg(F.sum(weight).alias("s")).agg(F.max("s")).first()[0] if times else None
    wanted = [anchor_word(p) for p in dict.fromkeys([*search.query_phrases(query, entities), *entities, *concepts])]
    chunks = index.chunks()
    if None not in wanted:
        found = index.with_words([*dict.fromkeys(wanted), *(("equals", t) for t in fixed.INFRASTRUCTURE_TERMS)])
        chunks = chunks.join(found, ["canonical_url", "chunk"], "left_semi")
    c = chunks.select(F.col("canonical_url").alias("article"), F.col("chunk").alias("start"), "title", "section", "text", "status", "links")
    return retrieve(c, query, concepts, limit, least, index.latent(), {"n": n, "mean": mean, "df": df, "top": top or 0.0})


def internal_links(memories: DataFrame, articles: DataFrame, key: str = "article") -> DataFrame:
    """key, at, anchor, target, title: links (anchor, url) of memories (key, own_url, links) to other articles (canonical_url, title), each article once.

    URLs meet in their canonical form; junk anchors and links to the article itself are left out, and of several links to an article the first stays.
    """
    l = memories.select(key, "own_url", F.posexplode("links").alias("at", "l")).where(~urls.is_junk_anchor(F.col("l.anchor")))
    a = articles.select(F.col("canonical_url").alias("target"), F.col("title"), urls.canonical(F.col("canonical_url")).alias("same_"))
    j = l.join(a, urls.canonical(F.col("l.url")) == F.col("same_")).where(F.col("target") != F.col("own_url"))
    first = j.groupBy(key, "target").agg(F.min_by(F.struct("at", "l.anchor", "title"), "at").alias("x"))
    return first.select(key, "x.at", "x.anchor", "target", "x.title")


def bundle(memories: DataFrame, voices: DataFrame, gold: DataFrame) -> DataFrame:
    """kind, rank, article, score of a context: memories, voice passages and gold articles (article, score), each kind from its best."""
    from pyspark.sql import Window

    parts = [x.select(F.lit(kind).alias("kind"), F.col("article").cast("string").alias("article"), F.col("score").cast("double").alias("score")) for kind, x in (("memory", memories), ("voice", voices), ("gold", gold))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("score").desc(), "article")))


def voice_passages(paragraphs: DataFrame, query: str, most_each: int = 2, most: int = 8, of_first: int = 60) -> DataFrame:
    """article, number, score of the paragraphs (article, number, text) that share most of a query's words, at most `most_each` of an article."""
    import re

    words = list(dict.fromkeys(w for w in re.findall(r"[a-z0-9][a-z0-9'-]{2,}", query.lower()) if w not in fixed.VOICE_STOP))
    hits = F.size(F.array_intersect(F.array_distinct(text.voice_tokens(F.col("text"))), F.lit(words or [""])))
    s = paragraphs.select("article", "number", (hits / max(1, len(words))).alias("score")).where("score > 0")
    return search.capped(s, "article", most_each, most, of_first, F.col("score").desc(), F.col("article"), F.col("number"))


class Lsa:
    """Latent vectors of texts, and the projection of a query on them."""

    def __init__(self, model: vectors.Latent, of_texts: DataFrame):
        self.model, self.of_texts = model, of_texts

    def vectors(self) -> DataFrame:
        """The texts' key (its fields, if it is a struct) and vector."""
        return self.of_texts

    def query(self, query: str) -> list[float]:
        return self.model.query(query)


def lsa(texts: DataFrame, key: str, of: Column, k: int, most_terms: int) -> DataFrame:
    """key and vector of `fit_lsa`."""
    return fit_lsa(texts, key, of, k, most_terms).vectors()


def fit_lsa(texts: DataFrame, key: str, of: Column, k: int, most_terms: int, most_df: float = 0.98) -> Lsa:
    """Vectors by the k first singular vectors of TF-IDF rows over the most frequent runs of 1 to 3 words; the rows are written once."""
    known = vectors.vocabulary(texts, of, most_terms, most_df=most_df if texts.count() >= 3 else 1.0)
    rows = sinks.scratch(known.vectors(texts, key, of))
    model = vectors.latent(rows, known, k)
    return Lsa(model, model.project(rows, key))
