"""A search index over articles as Parquet: chunks and postings in generations, reuse of what didn't change; and what is read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, search, text
from ..sources import sinks
from . import blocks, store


def chunked(articles: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """canonical_url, title, section, number, start, text, links of articles (canonical_url, title, body), and other columns of theirs: cleaned sections in word windows with their own links.

    A section is cleaned once; only sections with links are exchanged, to meet these.
    """
    names, mark = ["canonical_url", "title", *also], F.lit("](http")
    a = articles.where("canonical_url IS NOT NULL").select(F.struct(*names).alias("article_"), "title", "body")
    cut = lambda docs: blocks.sections(docs, "article_", "body", "title").select("article_.*", "number", "section", F.col("body").alias("raw"))
    clean = F.explode(F.filter(F.array(text.clean_article(F.col("raw"), F.col("title"))), lambda x: x != "")).alias("clean")  # a row where something is left; a filter would clean twice
    none = F.array().cast("array<struct<anchor:string,url:string,kind:string>>")
    plain = cut(a).where(~F.contains("raw", mark)).select(*names, "section", "number", clean).select(F.struct(*names, "section", "number", none.alias("links"), F.lit(None).cast("string").alias("whole")).alias("s"), "clean")
    linked = cut(a.where(F.contains("body", mark))).where(F.contains("raw", mark)).withColumn("id", F.struct("canonical_url", "number"))
    links = blocks.markdown_links(linked.select("id", "raw", F.col("canonical_url").alias("article")), "id", "raw", "article").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "anchor", "url", "kind"))), lambda l: F.struct(l["anchor"].alias("anchor"), l["url"].alias("url"), l["kind"].alias("kind"))).alias("links"))
    own = linked.select("id", *names, "section", "number", clean).join(links, "id", "left")
    own = own.select(F.struct(*names, "section", "number", F.coalesce("links", none).alias("links"), F.when(F.size(F.coalesce("links", none)) > 0, text.squeezed(F.col("clean"))).alias("whole")).alias("s"), "clean")
    w = blocks.word_windows(plain.unionByName(own), "s", F.col("clean"))
    return w.select("s.canonical_url", "s.title", *[f"s.{c}" for c in also], "s.section", "s.number", "start", F.col("piece").alias("text"), blocks.links_in_piece(F.col("s.links"), F.col("piece"), F.col("s.whole")).alias("links"))


#: Ranges of terms that postings are kept in, and rows of a file of them.
BUCKETS, FILE_ROWS = 64, 4_000_000
#: Articles that a build made and that aren't served: as many are broadcast, so that what is served isn't exchanged to leave them out.
FEW_DEAD = 1 << 20
#: Words of the longest run of tokens that is a concept.
RUN = 3
CHUNK = ["canonical_url", "chunk"]


def _runs(tokens: Column, most: int = RUN) -> Column:
    """All runs of 1 to `most` tokens, each joined by spaces, with repeats; tokens are read once, as slices side by side."""
    n = F.size(tokens)
    each = [tokens]
    for k in range(2, most + 1):
        slices = [F.slice(tokens, F.lit(i + 1), F.greatest(F.lit(0), n - (k - 1))) for i in range(k)]
        each.append(F.transform(F.arrays_zip(*[x.alias(f"t{i}") for i, x in enumerate(slices)]), lambda z: F.concat_ws(" ", *[z[f"t{i}"] for i in range(k)])))
    return F.concat(*each)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Index:
    """What a build has left below a path, as generations: `meta` (a row for each, written last), and the parts of each.

    articles: every article of a build with its digest, the generation that has its chunks, their number and tokens, and
    whether it is served (equal bodies are served once).  chunks: canonical_url, chunk, title, section, text, links, status.
    postings: term, tf and chunk for all search tokens, by buckets of the term, sorted; a run of tokens is looked up by its
    tokens and counted in the chunks that have them all.  terms: the distinct tokens.  A build that breaks off leaves parts
    that no `meta` row names.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = self._read("meta", None)
        self.meta = meta.orderBy(F.col("generation").desc()).first() if meta is not None else None
        self.generation = self.meta["generation"] if self.meta else -1
        self._left: tuple[list[int], DataFrame, int] | None = None

    def _read(self, part: str, upto: int | None) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            df = self.spark.read.parquet(f"{self.path}/{part}")
        except AnalysisException:  # nothing there yet
            return None
        return df if upto is None else df.where(F.col("generation") <= upto)

    def articles(self) -> DataFrame | None:
        """The rows of the last build."""
        rows = self._read("articles", None)
        return rows.where(F.col("generation") == self.generation) if rows is not None and self.meta else None

    def _left_out(self) -> tuple[list[int], DataFrame, int]:
        """The generations that have served articles, what else was made in these (canonical_url, generation), and how much."""
        if self._left is None:
            pair = ["canonical_url", F.col("made").alias("generation")]
            live = self.articles().where("served").select(*pair)
            used = [r["generation"] for r in live.select("generation").distinct().collect()]
            made = self._read("articles", self.generation).where((F.col("chunks") > 0) & F.col("made").isin(used)).select(*pair).distinct()
            dead = sinks.scratch(made.join(live, ["canonical_url", "generation"], "left_anti"))
            self._left = used, dead, dead.count()
        return self._left

    def served(self, part: str) -> DataFrame:
        """Rows of a part that belong to articles as they are now. These stay where they are: the few that don't are looked up."""
        used, dead, n = self._left_out()
        rows = self._read(part, self.generation).where(F.col("generation").isin(used))
        if n > FEW_DEAD:
            live = self.articles().where("served").select("canonical_url", F.col("made").alias("generation"))
            return rows.join(live, ["canonical_url", "generation"])
        return rows.join(F.broadcast(dead), ["canonical_url", "generation"], "left_anti") if n else rows

    def chunks(self) -> DataFrame:
        return self.served("chunks").drop("generation")

    def postings(self, terms: list[str]) -> DataFrame:
        """term, tf and chunk of some tokens or runs of tokens: only their buckets are read, and within these the row groups that can have them."""
        runs = [t for t in dict.fromkeys(terms) if " " in t]
        out = self._posted([t for t in terms if " " not in t])
        for t in runs:
            own = t.split(" ")
            have = self._posted(own).groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(set(own))).drop("n")
            tf = F.size(F.filter(_runs(F.col("tokens"), len(own)), search._same(t))).cast("long")  # shorter runs have fewer spaces
            found = self.served("chunks").join(have, CHUNK, "left_semi").select(F.lit(t).alias("term"), tf.alias("tf"), F.size("tokens").cast("long").alias("dl"), *CHUNK)
            out = out.unionByName(found.where("tf > 0"))
        return out

    def _posted(self, tokens: list[str]) -> DataFrame:
        wanted = F.lit(False)
        for t in tokens:
            wanted = wanted | ((F.col("bucket") == _bucket(F.lit(t))) & (F.col("term") == t))
        return self.served("postings").where(wanted).select("term", "tf", "dl", *CHUNK)

    def with_words(self, words: list[tuple[str, str]]) -> DataFrame:
        """Chunks (their keys) with a token that equals a word, or that begins with it, ends in it or contains it: (how, word)."""
        how = {"equals": lambda c, w: c == w, "starts": F.startswith, "ends": F.endswith, "contains": F.contains}
        match = F.lit(False)
        for kind, w in words:
            match = match | how[kind](F.col("term"), F.lit(w))
        terms = self._read("terms", self.generation).where(match).select("term").distinct().withColumn("bucket", _bucket(F.col("term")))
        return self.served("postings").join(terms, ["bucket", "term"]).select(*CHUNK).distinct()


    def fit(self, k: int = 128, limit: int = 30000) -> None:
        """Latent vectors of the served chunks, for this generation: `vectors` of the chunks and `basis` of the terms."""
        from . import vectors
        from .retrieval import fit_lsa

        c = self.chunks().select(F.struct("canonical_url", "chunk").alias("key"), F.format_string("%s. %s. %s", "title", "section", "text").alias("text"))
        made = fit_lsa(c, "key", F.col("text"), k, limit)
        at = f"generation={self.generation}"
        made.vectors().write.mode("overwrite").parquet(f"{self.path}/vectors/{at}")
        known: vectors.Vocabulary = made.model.vocabulary
        rows = [(t, int(d), v.tolist()) for t, d, v in zip(known.terms, known.df, made.model.basis)]  # a row for each term of a bounded vocabulary
        self.spark.createDataFrame(rows, "term string, df long, vector array<double>").withColumn("n", F.lit(known.n)).write.mode("overwrite").parquet(f"{self.path}/basis/{at}")

    def latent(self):
        """What `fit` left for this generation, as an `Lsa` by (article, start); None if it wasn't run."""
        import numpy as np

        from . import retrieval, vectors

        basis, own = self._read("basis", None), self._read("vectors", None)
        rows = basis.where(F.col("generation") == self.generation).orderBy("term").collect() if basis is not None else []
        if not rows:
            return None
        known = vectors.Vocabulary([r["term"] for r in rows], np.array([r["df"] for r in rows], np.float64), rows[0]["n"], fixed.SEARCH_STOP)
        own = own.where(F.col("generation") == self.generation).select(F.col("canonical_url").alias("article"), F.col("chunk").alias("start"), "vector")
        return retrieval.Lsa(vectors.Latent(known, np.array([r["vector"] for r in rows], np.float32)), own)


def _digest() -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("canonical_url", "title", "content_hash", "content_status")]), 256)


def build(articles: DataFrame, path: str, force: bool = False) -> bool:
    """Brings the index below a path up to date with articles (id, canonical_url, title, body, content_hash, content_status,
    published_date); whether anything was written.

    Only articles that are new or changed are cut into chunks and get postings, in a generation of their own; `force` makes
    all of them anew.  Of articles with equal bodies the newest with any chunk is served.
    """
    spark, index = articles.sparkSession, Index(articles.sparkSession, path)
    signature = store.signature(articles).first().signature
    if not force and index.meta and index.meta["signature"] == signature:
        return False
    g, before = index.generation + 1, index.articles()
    known = before.select("canonical_url", "digest", "made", "chunks", "tokens") if before is not None and not force else None
    a = articles.withColumn("digest", _digest())
    fresh = a if known is None else a.join(known.select("canonical_url", "digest"), ["canonical_url", "digest"], "left_anti")
    at = f"generation={g}"
    made = chunked(fresh.withColumn("status", F.col("content_status")), ("status",))
    made = made.withColumn("chunk", F.col("number").cast("long") * (1 << 32) + F.col("start")).drop("number", "start")
    made.withColumn("tokens", text.lower_search_tokens(_hay())).withColumn("dl", F.size("tokens").cast("long")).write.mode("overwrite").parquet(f"{path}/chunks/{at}")
    chunks = spark.read.parquet(f"{path}/chunks/{at}")
    sizes = chunks.groupBy("canonical_url").agg(F.count(F.lit(1)).alias("chunks"), F.sum("dl").alias("tokens"))
    posted = chunks.select(*CHUNK, "dl", F.explode(text.counted(F.col("tokens"))).alias("x")).select(*CHUNK, "dl", "x.term", "x.tf").withColumn("bucket", _bucket(F.col("term")))
    rows = chunks.agg(F.sum("dl")).first()[0] or 0  # or fewer: repeats are one row
    spread = max(1, -(-rows // (BUCKETS * FILE_ROWS)))  # files of a bucket: a frequent term is in all of them
    place = F.col("bucket") * spread + F.pmod(F.xxhash64(*CHUNK), F.lit(spread)).cast("int")
    posted.repartitionById(BUCKETS * spread, place).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/{at}")
    spark.read.schema("term string").parquet(f"{path}/postings/{at}").select("term").distinct().write.mode("overwrite").parquet(f"{path}/terms/{at}")
    new = fresh.select("canonical_url", "digest").join(sizes, "canonical_url", "left").select("canonical_url", "digest", F.lit(g).alias("made"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    every = a.select("id", "canonical_url", "content_hash", "published_date", "digest").join(new if known is None else new.unionByName(known.join(a.select("canonical_url", "digest"), ["canonical_url", "digest"])), ["canonical_url", "digest"])
    first = store.first_by(every.where("chunks > 0"), [F.col("content_hash")], F.coalesce("published_date", F.lit("")).desc(), F.col("id").desc()).select("canonical_url", F.lit(True).alias("served"))
    rows_ = every.join(first, "canonical_url", "left").withColumn("served", F.coalesce("served", F.lit(False)))
    rows_.write.mode("overwrite").parquet(f"{path}/articles/{at}")
    totals = spark.read.parquet(f"{path}/articles/{at}").where("served").agg(F.coalesce(F.sum("chunks"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    spark.createDataFrame([(signature, int(totals[0]), int(totals[1]))], "signature string, chunks long, tokens long").write.mode("overwrite").parquet(f"{path}/meta/{at}")
    return True


def _hay() -> Column:
    return F.lower(F.concat_ws(" ", "title", "section", "text"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The served chunks."""
    return Index(spark, path).chunks()


def rank_links(links: Column, entities: list[str], free: list[str], concepts: list[str]) -> Column:
    """Links (anchor, url) from the highest score: 4 for an entity, .65 a free term, 1.15 or .65 for four concepts, 1.25 for patents."""

    def score(l: Column) -> Column:
        hay = F.lower(F.concat_ws(" ", l["anchor"], l["url"]))
        own = text.search_tokens(hay)
        entity = F.lit(False)
        for e in entities:
            entity = entity | F.contains(hay, F.lit(e))
        hits = F.slice(F.array_compact(F.array(*[F.when(F.contains(hay, F.lit(c)), 1.15 if " " in c else 0.65) for c in concepts])) if concepts else F.array().cast("array<double>"), 1, 4)
        patent = hay.rlike(r"patents?\.google|uspto|us\d{6,}|wo\d{6,}|ep\d{6,}")
        return F.when(entity, 4.0).otherwise(0.0) + 0.65 * F.size(F.array_intersect(F.array_distinct(own), F.lit(free or [""]))) + F.aggregate(hits, F.lit(0.0), lambda a, x: a + x) + F.when(patent, 1.25).otherwise(0.0)

    at = F.transform(links, lambda l, i: F.struct((-score(l)).alias("s"), i.alias("i"), l["anchor"].alias("anchor"), l["url"].alias("url")))
    return F.transform(F.array_sort(at), lambda x: F.struct(x["anchor"].alias("anchor"), x["url"].alias("url")))


def expanded_concepts(chunks: DataFrame, key: str, of: str, entities: list[str], query: str, limit: int = 18) -> list[str]:
    """Phrases of one to three words that chunks with an entity share: by their share in the seeds, rarity and specificity.

    One pass counts the single tokens of seeds and of all chunks.  A phrase is in no more seeds than each of its tokens, so a
    second pass counts only the phrases of which each token is in as many seeds as the last of the best needs; what can't be a concept by
    its words is not counted at all.  What comes to the driver is `4 * limit` phrases of each pass and the tokens of such phrases.
    """
    if not entities:
        return []
    low = F.lower(of)
    seed = F.lit(False)
    for e in entities:
        seed = seed | F.contains(low, F.lit(e))
    own = {w for e in entities for w in e.split()} | set(search.query_plan(query)[2])
    c = chunks.select(F.coalesce(seed, F.lit(False)).alias("seed"), text.search_tokens(F.col(of)).alias("toks"))
    n = chunks.agg(F.count(F.lit(1)).alias("n"), F.count_if(seed).alias("seeds")).first()
    counted = lambda terms: terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.count_if("seed").alias("in_seeds")).where("in_seeds > 0")
    words = F.split("term", " ")
    junk = [*fixed.GENERIC_TERMS, *fixed.CONCEPT_JUNK]
    infra = lambda w: w.isin(fixed.INFRASTRUCTURE_TERMS)
    digit = F.col("term").rlike("[0-9]")
    short = (F.length("term") <= 6) & F.col("term").rlike("^[a-z]+$") & (F.col("df") <= 0.10 * n.n)
    technical = infra(F.col("term")) | digit | short | ((F.length("term") >= 7) & (F.col("df") <= 0.14 * n.n))
    several = F.exists(words, lambda w: ~w.isin(junk)) & ~F.exists(words, lambda w: w.isin(fixed.CONCEPT_HARD_JUNK)) & ((F.size(words) == 2) | (F.size(F.filter(words, infra)) >= 2) | digit)
    single = F.size(words) == 1
    ok = (F.length("term") >= 3) & ~F.arrays_overlap(words, F.lit(sorted(own) or [""])) & F.when(single, ~F.col("term").isin(junk) & technical).otherwise(several)
    rarity = F.least(F.lit(3.0), F.log((n.n + 1.0) / (F.col("df") + 1.0)) + 1)
    special = F.when(F.exists(words, lambda w: w.isin(fixed.INFRASTRUCTURE_TERMS)), 1.15).otherwise(1.0) + F.when(F.col("term").rlike("[0-9]"), 0.15).otherwise(0.0)
    score = F.col("in_seeds") / F.lit(float(max(1, n.seeds))) * rarity * (1.0 + 0.42 * F.least(F.lit(2), F.size(words) - 1)) * special
    best_of = lambda df: df.where(ok).select("term", score.alias("score")).orderBy(F.col("score").desc(), F.col("term").desc()).limit(4 * limit).collect()
    one = sinks.scratch(counted(c.select("seed", F.explode(F.array_distinct("toks")).alias("term"))))
    best = best_of(one)
    floor = best[-1]["score"] if len(best) == 4 * limit else 0.0
    most = 3.0 * (1.0 + 0.42 * 2) * (1.15 + 0.15)  # of a score, but for the share in the seeds
    no = [*fixed.CONCEPT_HARD_JUNK, *own]
    able = [r["term"] for r in one.where((F.col("in_seeds") >= (floor * max(1, n.seeds) / most) * (1 - 1e-9)) & ~F.col("term").isin(no or [""])).select("term").collect()]
    if able:
        pairs = _concept_runs(F.col("toks"), able, junk)
        best = sorted([*best, *best_of(counted(c.select("seed", F.explode(F.array_distinct(pairs)).alias("term"))))], key=lambda r: (r["score"], r["term"].encode()), reverse=True)[: 4 * limit]
    kept: list[str] = []
    for r in best:
        if " " in r.term or not any(r.term in k for k in kept):
            kept.append(r.term)
    return kept[:limit]


def _concept_runs(tokens: Column, able: list[str], junk: list[str]) -> Column:
    """Runs of two and three of the able tokens that aren't all junk; of three, only with two terms of infrastructure or a digit."""
    flags = lambda t: [t.isin(junk).alias("junk"), t.isin(fixed.INFRASTRUCTURE_TERMS).cast("int").alias("infra"), t.rlike("[0-9]").alias("digit")]
    placed = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].isin(able))
    use = F.transform(placed, lambda x: F.struct(x["t"].alias("t"), x["i"].alias("i"), *flags(x["t"])))

    def runs(u: Column) -> Column:
        near = lambda x, y, by: F.coalesce(y["i"] == x["i"] + by, F.lit(False))

        def from_(x: Column, k: Column) -> Column:
            y, z = F.get(u, k + 1), F.get(u, k + 2)
            two = F.when(near(x, y, 1) & ~(x["junk"] & y["junk"]), F.concat_ws(" ", x["t"], y["t"]))
            three = F.when(near(x, y, 1) & near(x, z, 2) & ~(x["junk"] & y["junk"] & z["junk"]) & ((x["infra"] + y["infra"] + z["infra"] >= 2) | x["digit"] | y["digit"] | z["digit"]), F.concat_ws(" ", x["t"], y["t"], z["t"]))
            return F.array(two, three)

        return F.array_compact(F.flatten(F.transform(u, from_)))

    return text.bound(use, runs)


def ordered_sets(df: DataFrame, key: str, value: str, order: str, best: int = 3) -> DataFrame:
    """key and the distinct elements of its first `best` arrays, in the order that they are first seen."""
    from pyspark.sql import Window

    top = df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("rn") <= best)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(value).alias("v")))), lambda x: x["v"])
    return top.groupBy(key).agg(F.array_distinct(F.flatten(lists)).alias(value))
