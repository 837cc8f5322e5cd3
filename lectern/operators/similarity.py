"""Similarity and change between texts: sequence ratios, paragraphs shared, counts compared, articles identified."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import fixed, text
from .batches import map_frames


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The sequence ratio of two normalised texts; its rule for popular elements has no SQL form."""
    return pd.Series(ratios([x or "" for x in a], [y or "" for y in b]))


#: A second text of so many characters has popular ones, which a match leaves out; such pairs are compared one by one, as are longer first texts than LONGEST.
POPULAR, LONGEST = 200, 1000
#: Pairs of characters that are compared at once.
CELLS = 1 << 20


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """SequenceMatcher(None, x, y).ratio() of many pairs. Pairs of short ASCII texts are compared side by side, in pools of pairs of like lengths."""
    out, size = np.zeros(len(a)), np.array([[len(x), len(y)] for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    short = np.array([0 < len(x) <= LONGEST and 0 < len(y) < POPULAR and x.isascii() and y.isascii() for x, y in zip(a, b)], bool)
    for i in np.flatnonzero(~short):
        out[i] = SequenceMatcher(None, a[i], b[i]).ratio()
    rows = np.flatnonzero(short)
    like = np.ceil(np.log(size[rows]) / np.log(1.4)).astype(np.int64) @ [64, 1]
    order = np.argsort(like, kind="stable")
    rows, like = rows[order], like[order]
    pools = np.cumsum(size[rows].prod(axis=1)) // CELLS
    for own in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(pools)) + 1) if len(rows) else []:
        found, done = [], 0
        for g in np.split(own, np.flatnonzero(np.diff(like[own])) + 1):
            pair, *at = _equal([a[i] for i in rows[g]], [b[i] for i in rows[g]])
            found.append((pair + done, *at))
            done += len(g)
        out[rows[own]] = 2.0 * _matched(len(own), *(np.concatenate(x) for x in zip(*found))) / size[rows[own]].sum(axis=1)
    return out


def _equal(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, i, j, run): equal characters of pairs of texts, and the length of the run of equal ones that ends there. Places of a pair are together."""
    n, h, w = len(a), max(map(len, a)), max(map(len, b))
    if h > w:
        pair, j, i, run = _equal(b, a)
        return pair, i, j, run
    coded = lambda rows: np.frombuffer("".join(rows).encode("latin-1"), np.uint8).reshape(n, -1)
    x, y = coded(t.ljust(h + 1, "\xfe") for t in a), coded("\xff" * h + t.ljust(w + h + 1, "\xff") for t in b)  # what pads them equals nothing
    # a row for each diagonal, so that a run's places follow each other
    at = np.flatnonzero(x[:, None] == np.lib.stride_tricks.sliding_window_view(y, h + 1, axis=1))
    row, i = np.divmod(at, h + 1)
    pair, shift = np.divmod(row, w + h + 1)
    place = np.arange(len(at), dtype=np.int32)
    run = place - np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, place, 0)) + 1
    return pair, i.astype(np.int32), (shift + i - h).astype(np.int32), run


def _matched(n: int, pair: np.ndarray, i: np.ndarray, j: np.ndarray, run: np.ndarray) -> np.ndarray:
    """How many characters of each of n pairs are in matching blocks: the longest block (the first in a, then in b, of several), and those on both sides of it, for all pairs at once."""
    total = np.zeros(n, np.int64)
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    pair, low = pair[starts], np.zeros((2, len(starts)), np.int32)
    while len(starts):
        counts = np.diff(starts, append=len(i))
        each = lambda x: np.repeat(x, counts)
        size = np.minimum(run, np.minimum(i - each(low[0]), j - each(low[1])) + 1)
        best = np.maximum.reduceat((size << 18) | ((1023 - i) << 8) | (255 - j), starts)
        size, end = best >> 18, np.stack([1024 - ((best >> 8) & 1023), 256 - (best & 255)])
        np.add.at(total, pair, size)
        sides = ((i < each(end[0] - size)) & (j < each(end[1] - size)), low), ((i >= each(end[0])) & (j >= each(end[1])), end)
        kept = [(i[s], j[s], run[s], m[m > 0], pair[m > 0], l[:, m > 0]) for s, l in sides for m in (np.add.reduceat(s, starts, dtype=np.int64),)]
        i, j, run, m, pair, low = (np.concatenate(x, axis=-1) for x in zip(*kept))
        starts = np.cumsum(m) - m
    return total


@F.pandas_udf(DoubleType())
def word_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, list(x), list(y)).ratio() if len(x) and len(y) else 0.0 for x, y in zip(a, b)])


def fingerprints(docs: DataFrame, key: str, parts: Column, least: int = 40) -> DataFrame:
    """key, paragraph, words: normalised paragraphs of `least` words or more, with their words summed."""
    p = docs.select(key, F.explode(parts).alias("x")).select(key, F.lower(text.squeezed(F.col("x"))).alias("paragraph"), F.size(F.split(F.trim("x"), text.SPACE)).alias("n"))
    return p.where(F.col("n") >= least).groupBy(key, "paragraph").agg(F.sum("n").alias("words"))


#: The characters of normalised texts.
SYMBOLS = " abcdefghijklmnopqrstuvwxyz0123456789"


def similar_pairs(assets: DataFrame, threshold: float = 0.82, group: str | None = None) -> DataFrame:
    """content_id_a, content_id_b, similarity of assets (content_id, pos, copy, reuse_policy) with a ratio of the threshold or more.

    The ratio is at most 2 min / (sum of lengths), so only pairs in reach by length are compared: both sides are
    joined on length buckets a factor 1 / (2 / threshold - 1) wide, their own and the next.  Nor is the ratio above twice the
    characters that both have, as a multiset, over the sum of lengths; so only pairs within that bound reach Python.  `group` keeps apart what
    is never compared.
    """
    reach = 2 / threshold - 1  # a longer text has at most this many times the shorter's length
    a = assets.where("coalesce(reuse_policy, '') <> 'CROSS_PLATFORM_REUSE'").select("content_id", "pos", text.alnum(F.col("copy")).alias("t"), *([group] if group else []))
    counts = F.array(*[F.length("t") - F.length(F.replace("t", F.lit(c), F.lit(""))) for c in SYMBOLS])
    a = a.withColumn("len", F.length("t")).withColumn("counts", counts).withColumn("bucket", F.floor(F.log(F.greatest(F.lit(1), F.col("len")).cast("double")) / F.log(F.lit(reach))))
    keys = ["bucket"] + ([group] if group else [])
    left = a.select(*[F.col(c).alias(f"{c}_a") for c in ("content_id", "pos", "t", "len", "counts")], F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"), *([group] if group else []))
    j = left.join(a, keys).where((F.col("pos_a") < F.col("pos")) & (2 * F.least("len_a", "len") >= threshold * (F.col("len_a") + F.col("len"))))
    shared = F.aggregate(F.zip_with("counts_a", "counts", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    j = j.where(2 * shared >= threshold * (F.col("len_a") + F.col("len"))).select(*keys, "content_id_a", "content_id", "t_a", "t")
    return j.withColumn("similarity", ratio("t_a", "t")).where(F.col("similarity") >= threshold).select(F.col("content_id_a"), F.col("content_id").alias("content_id_b"), F.round("similarity", 3).alias("similarity"))


#: Kinds of parts that `boilerplate` counts: the letter that a part begins with, and how many assets may have one.
PARTS = {"REPEATED_SENTENCE": ("S", 2), "REPEATED_CLOSING": ("C", 1), "REPEATED_PHRASE": ("P", 3)}
#: Bits of a part's place that are its number in its asset; the others are of its asset's hash.
PLACE_BITS = 28


def boilerplate(assets: DataFrame, brand: tuple[str, ...] = (), size: int = 8) -> DataFrame:
    """code, text and assets (how many) of what assets (content_id, copy) repeat: sentences of five words or more in three, closings in two, runs of `size` words in four.

    Texts are compared as words of ASCII letters and digits; brand phrases don't count.  Sums by a 62-bit hash of the text,
    which carry one place of it; texts of what is repeated are read from their places, so no text is exchanged but the assets' own, once.
    """
    known = assets.where("content_id IS NOT NULL")
    once = known.groupBy("content_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    a = known.select("content_id", F.array("copy").alias("copies")) if once else known.groupBy("content_id").agg(F.sort_array(F.collect_list("copy")).alias("copies"))
    a = a.select(F.shiftleft(F.xxhash64("content_id"), PLACE_BITS).alias("asset"), "copies")
    long = lambda xs: F.filter(xs, lambda x: F.size(F.split(x, " ")) >= 5)
    last = lambda xs: F.slice(xs, F.greatest(F.lit(1), F.size(xs)), F.lit(1))
    each = lambda xs, code: F.transform(F.filter(F.array_distinct(xs), lambda x: ~x.isin(list(brand) or [""])), lambda x: F.concat(F.lit(PARTS[code][0]), x))

    def of(copy: Column) -> Column:
        stated = text.bound(F.transform(text.sentences(copy), text.alnum), lambda s: F.concat(each(long(s), "REPEATED_SENTENCE"), each(long(last(s)), "REPEATED_CLOSING")))
        return F.concat(stated, text.bound(F.split(text.alnum(copy), " "), lambda w: each(shingles(w, size), "REPEATED_PHRASE")))

    def parts(copies: Column) -> Column:
        found = F.flatten(F.transform(F.filter(copies, lambda c: c.isNotNull()), of))
        return found if once else F.array_distinct(found)

    codes = F.array(*[F.lit(c) for c, _ in PARTS.values()])
    coded = lambda x: F.xxhash64(x).bitwiseAND(F.lit(~3)).bitwiseOR(F.array_position(codes, F.left(x, F.lit(1))) - 1)
    rows = a.select("asset", F.posexplode(F.transform(parts(F.col("copies")), coded)).alias("at", "h"))
    sums = rows.groupBy("h").agg(F.count(F.lit(1)).alias("assets"), F.min(F.col("asset").bitwiseOR(F.col("at").cast("long"))).alias("place"))
    most = F.get(F.array(*[F.lit(n) for _, n in PARTS.values()]), F.col("h").bitwiseAND(F.lit(3)).cast("int"))
    at = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    found = sums.where(F.col("assets") > most).select(F.shiftleft(F.shiftright("place", PLACE_BITS), PLACE_BITS).alias("asset"), F.struct(at.alias("at"), "h", "assets").alias("x")).groupBy("asset").agg(F.collect_list("x").alias("xs"))
    there = a.join(found, "asset").select("xs", parts(F.col("copies")).alias("parts"))
    read = there.select(F.explode(F.transform("xs", lambda x: F.struct(x["h"].alias("h"), x["assets"].alias("assets"), F.get("parts", x["at"]).alias("part")))).alias("x")).select("x.*")
    read = read.where(coded(F.col("part")) == F.col("h")).dropDuplicates(["h"])  # assets of one hash
    code = F.get(F.array(*[F.lit(c) for c in PARTS]), F.col("h").bitwiseAND(F.lit(3)).cast("int"))
    return read.select(code.alias("code"), F.substring("part", 2, 1 << 30).alias("text"), "assets")


def renamed_headings(pairs: DataFrame, key: str, before: str, after: str, least: float = 0.45) -> DataFrame:
    """key, old, new, ratio: each heading that a version lost, with the most similar one that the next version gained, if that is similar enough."""

    def run(frame):
        out = [(k, *r) for k, x, y in zip(frame[key], frame["b"], frame["a"]) for r in renamed([] if x is None else list(x), [] if y is None else list(y), least)]
        return pd.DataFrame(out, columns=[key, "old", "new", "ratio"])

    kind = pairs.schema[key].dataType.simpleString()
    return map_frames(pairs.select(key, text.headings(F.col(before)).alias("b"), text.headings(F.col(after)).alias("a")), run, f"{key} {kind}, old string, new string, ratio double")


def renamed(x: list[str], y: list[str], least: float = 0.45) -> Iterator[tuple[str, str, float]]:
    """`renamed_headings` of two lists."""
    own, other = set(x), set(y)
    gained = list(dict.fromkeys(h for h in y if h not in own))
    for old in dict.fromkeys(h for h in x if h not in other):
        score, new = max(((SequenceMatcher(None, old.casefold(), h.casefold()).ratio(), h) for h in gained), default=(0.0, ""))
        if score >= least:
            yield old, new, round(score, 3)


def moved_headings(before: Column, after: Column) -> Column:
    """Headings that both versions have, at other places among their headings."""
    return F.filter(F.array_intersect(before, after), lambda h: F.array_position(before, h) != F.array_position(after, h))


def link_changes(before: Column, after: Column) -> Column:
    """(added, removed): URLs that only one of two versions links to, sorted."""
    urls = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"\[([^\]\n]+)\]\((https?://[^\s)]+)\)"), F.lit(2)))
    return F.struct(F.array_sort(F.array_except(urls(after), urls(before))).alias("added"), F.array_sort(F.array_except(urls(before), urls(after))).alias("removed"))


def excerpts_found(docs: DataFrame, key: str, of: Column, excerpts: DataFrame, part_key: str, part: Column) -> DataFrame:
    """key, part_key of the excerpts that stand in texts, as `text.contains_excerpt` says.

    An excerpt's words but the first and the last are whole words of any text that has it, so its longest one is looked up
    among the texts' words, and only the texts with it are searched.  Excerpts of fewer than three words are searched in all.
    """
    norm = lambda c: F.lower(text.squeezed(c))
    e = excerpts.select(part_key, norm(part).alias("part_")).where("part_ <> ''").withColumn("inner_", F.slice(F.split("part_", " "), 2, F.greatest(F.lit(0), F.size(F.split("part_", " ")) - 2)))
    longest = F.get(F.array_sort("inner_", lambda x, y: F.length(y) - F.length(x)), F.lit(0))
    d = docs.select(key, norm(of).alias("hay_"))
    worded = d.select(key, "hay_", F.explode(F.array_distinct(F.split("hay_", " "))).alias("word_"))
    probed = worded.join(e.where("size(inner_) > 0").select(part_key, "part_", longest.alias("word_")), "word_").where(F.contains("hay_", F.col("part_")))
    short = d.join(e.where("size(inner_) = 0").select(part_key, "part_"), F.contains("hay_", F.col("part_")))
    return probed.select(key, part_key).unionByName(short.select(key, part_key))


def topical_terms(docs: DataFrame, group: str, of: Column, most: int = 45) -> DataFrame:
    """group, term, n: the `most` commonest terms of each group, the earlier in the alphabet among equals."""
    c = docs.select(group, F.explode(of).alias("term")).groupBy(group, "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), "term")
    return c.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def duplicate_rate(assets: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: the share of assets in a pair, and FAIL above a quarter."""
    ids = pairs.select(F.col("content_id_a").alias("content_id")).union(pairs.select("content_id_b")).distinct()
    rate = F.round(F.col("involved") / F.greatest(F.lit(1), F.col("n")), 3)
    return ids.agg(F.count(F.lit(1)).alias("involved")).crossJoin(assets.agg(F.count(F.lit(1)).alias("n"))).select(rate.alias("rate"), F.when(F.col("involved") > 0.25 * F.col("n"), "FAIL").otherwise("PASS").alias("validation"))


def best_claims(assertions: DataFrame, claims: DataFrame, supported: float = 0.58, partial: float = 0.38) -> DataFrame:
    """assertion_id, claim_id, score, support_status: the claim of the same content with the highest ratio."""
    j = assertions.join(claims, "content_id").withColumn("score", ratio(text.alnum(F.col("assertion_text")), text.alnum(F.col("claim_text"))))
    best = j.groupBy("assertion_id").agg(F.max_by("claim_id", F.struct("score", "claim_id")).alias("claim_id"), F.max("score").alias("score"))
    status = F.when(F.col("score") >= supported, "SUPPORTED").when(F.col("score") >= partial, "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED")
    return best.select("assertion_id", F.when(F.col("score") >= partial, F.col("claim_id")).alias("claim_id"), F.round("score", 3).alias("score"), status.alias("support_status"))


#: Gold titles that one automaton is made of; more take a pass for each so many.
GOLD_SHARD = 5000


def gold_titles(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """row_id and gold of rows (row_id, title): whether a title holds a gold title (title), or stands in one, or has three
    of its words and half of them; titles are compared as `text.title_key`.

    Gold titles are dealt to shards of GOLD_SHARD, and rows pass each shard without an exchange.  Containment either way: an
    automaton of the shard's titles, and the sorted ends of these, in which a title that stands in one begins an end.  Shared
    words: rows meet gold titles on the words, rare among them, that any match must have one of, and only these pairs are counted.
    """
    g = gold.select(text.title_key(F.col("title")).alias("g")).where("g <> ''").distinct()
    r = rows.select("row_id", text.title_key(F.coalesce("title", F.lit(""))).alias("t"))
    shards, n = [], g.count()
    for k in range(-(-n // GOLD_SHARD)):
        part = g.where(F.pmod(F.xxhash64("g"), F.lit(-(-n // GOLD_SHARD))) == k)
        held = _held([x.g for x in part.collect()])  # some GOLD_SHARD titles
        shards.append(r.mapInPandas(held, f"row_id {rows.schema['row_id'].dataType.simpleString()}"))
    found = rows.select("row_id").where(F.lit(False))
    for x in shards:
        found = found.unionByName(x)
    return rows.select("row_id").join(found.distinct().withColumn("gold_", F.lit(True)), "row_id", "left").select("row_id", F.coalesce("gold_", F.lit(False)).alias("gold"))


def _held(titles: list[str]):
    def run(batches):
        import bisect

        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in titles:
            automaton.add_word(t, True)
        automaton.make_automaton()
        ends = sorted({t[i:] for t in titles for i in range(len(t))})

        own = [list(dict.fromkeys(t.split(" "))) for t in titles]
        df, probes = Counter(w for ws in own for w in ws), {}
        for ws in own:
            if len(ws) >= 3:
                need = max(3, -(-len(ws) // 2))
                for w in sorted(ws, key=lambda w: (df[w], w))[: len(ws) - need + 1]:
                    probes.setdefault(w, []).append((frozenset(ws), need))

        def match(t: str) -> bool:
            if next(iter(automaton.iter(t)), None):
                return True
            at = bisect.bisect_left(ends, t)
            if at < len(ends) and ends[at].startswith(t):
                return True
            words = set(t.split(" "))
            return any(len(g & words) >= need for w in words & probes.keys() for g, need in probes[w])

        for frame in batches:
            yield frame.loc[[match(t) for t in frame["t"]], ["row_id"]]

    return run


def best_titles(gold: DataFrame, rows: DataFrame, least: float = 0.4) -> DataFrame:
    """Each gold title with the one row whose title has most of its tokens, if that is `least` of them.

    Joined on shared tokens, so rows without one are never paired.
    """
    g = gold.select("gold_id", F.array_distinct(text.search_tokens(F.col("title"))).alias("g"))
    r = rows.select("row_id", F.explode(F.array_distinct(text.search_tokens(F.col("title")))).alias("term"))
    shared = g.select("gold_id", F.size("g").alias("n"), F.explode("g").alias("term")).join(r, "term").groupBy("gold_id", "row_id").agg((F.count(F.lit(1)) / F.max("n")).alias("score"))
    w = Window.partitionBy("gold_id").orderBy(F.col("score").desc(), "row_id")
    best = shared.withColumn("rn", F.row_number().over(w)).where(f"rn = 1 AND score >= {least}").drop("rn")
    return gold.select("gold_id").join(best, "gold_id", "left")


def count_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """name and change between two counts (name, n): only_final, disappeared, promoted (three and twice as many), diminished or kept."""
    j = before.withColumnRenamed("n", "was").join(after.withColumnRenamed("n", "now"), "name", "full")
    change = (
        F.when(F.col("was").isNull(), "only_final").when(F.col("now").isNull(), "disappeared")
        .when(F.col("now") >= F.greatest(F.lit(3), 2 * F.col("was")), "promoted").when(F.col("was") >= F.greatest(F.lit(3), 2 * F.col("now")), "diminished").otherwise("kept")
    )
    return j.select("name", "was", "now", change.alias("change"))


def entities(of: Column, stop: tuple[str, ...] = ("The", "This", "That", "FAQ", "IMAGE", "ALT", "SUBSCRIBE", "SHARE")) -> Column:
    """Capitalised runs (with of, the, and) and acronyms, with repeats."""
    plain = F.regexp_replace(of, r"\[[^\]]+\]\([^)]+\)", "")
    found = text.every(plain, r"\b(?:[A-Z][A-Za-z’'-]+(?:\s+(?:[A-Z][A-Za-z’'-]+|of|the|and)){1,4}|[A-Z]{2,8})\b")
    return F.filter(F.transform(found, text.squeezed), lambda n: ~n.isin(list(stop)) & (F.length(n) >= 3))


def shingles(words: Column, n: int = 5) -> Column:
    """Distinct runs of n words: n slices of the list side by side, so that it is made n times for a text and not once a run."""
    count = F.greatest(F.lit(0), F.size(words) - (n - 1))
    side = F.arrays_zip(*[F.slice(words, i + 1, count).alias(f"w{i}") for i in range(n)])
    return F.array_distinct(F.transform(side, lambda x: F.concat_ws(" ", *[x[f"w{i}"] for i in range(n)])))


def identity(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, six signals, score and outcome (same_story, different_story, ambiguous or insufficient_evidence) of two versions of a text."""
    b, a = F.col(before), F.col(after)
    heads = lambda t: F.array_distinct(text.identity_words(F.array_join(text.headings(t), " ")))
    title = lambda t: F.array_distinct(text.identity_words(text.first_title(t)))
    links = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"\[[^\]\n]+\]\((https?://[^\s)]+)\)"), F.lit(1)))
    domains = lambda t: F.array_distinct(F.transform(links(t), lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, "^https?://([^/]+)", 1)), r"^www\.", "")))
    most = lambda xs, k: _most_common(xs, k)
    principal = lambda t: F.array_distinct(F.flatten(F.transform(most(entities(t), 35), lambda e: F.concat(F.array(F.array_join(text.identity_words(e), " ")), text.identity_words(e)))))
    topical = lambda t: most(text.identity_words(F.regexp_replace(t, r"(?m)^#{1,6}\s+.*$", "")), 45)
    w = pairs.select(key, before, after, text.identity_words(b).alias("wb"), text.identity_words(a).alias("wa"))
    overlap = text_overlap("wb", "wa")
    s = w.select(
        key, before, after, overlap.alias("substantial_text_overlap"), text.jaccard(title(b), title(a)).alias("title"), text.jaccard(heads(b), heads(a)).alias("headings"),
        text.jaccard(principal(b), principal(a)).alias("principal_entities"), text.jaccard(topical(b), topical(a)).alias("topic_keywords"),
        F.greatest(text.jaccard(links(b), links(a)), text.jaccard(domains(b), domains(a))).alias("source_families"),
    )
    score = sum((F.col(k) * v for k, v in fixed.IDENTITY_WEIGHTS.items()), F.lit(0.0))
    least = {"title": 0.34, "principal_entities": 0.12, "topic_keywords": 0.16, "source_families": 0.15, "substantial_text_overlap": 0.12}
    anchors = sum(((F.col(k) >= v).cast("int") for k, v in least.items()), F.lit(0))
    short = F.least(text.memory_word_count(b), text.memory_word_count(a)) < 250
    outcome = (
        F.when(short, "insufficient_evidence")
        .when((score >= 0.25) | (anchors >= 3) | ((F.col("title") >= 0.5) & (anchors >= 2)), "same_story")
        .when((score < 0.14) & (anchors <= 1), "different_story").otherwise("ambiguous")
    )
    return s.select(key, *[F.round(k, 3).alias(k) for k in fixed.IDENTITY_WEIGHTS], F.round(score, 3).alias("score"), outcome.alias("outcome"))


def _most_common(xs: Column, k: int) -> Column:
    """The k most common elements; the earlier in the alphabet among equals."""

    @F.pandas_udf("array<string>")
    def top(lists: pd.Series) -> pd.Series:
        return pd.Series([[w for w, _ in sorted(Counter(x).items(), key=lambda e: (-e[1], e[0]))[:k]] if x is not None else [] for x in lists])

    return top(xs)


@F.pandas_udf(DoubleType())
def text_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """0.55 of the sequence ratio of two word lists and 0.45 of the Jaccard similarity of their runs of five words; 0 where either is empty."""

    def one(x: list, y: list) -> float:
        p, q = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x, y))
        return 0.55 * SequenceMatcher(None, x, y).ratio() + 0.45 * (len(p & q) / len(p | q) if p and q else 0.0)

    return pd.Series([one(list(x), list(y)) if x is not None and y is not None and len(x) and len(y) else 0.0 for x, y in zip(a, b)])


#: Candidates that a row of `pairs_by_ratio` holds at once; more are made when these are used up.
AHEAD = 64


def pairs_by_ratio(x: list[str], y: list[str], least: float, later: bool = False) -> Iterator[tuple[int, int, float]]:
    """i, j, ratio of x[i] and y[j] paired greedily by falling ratio of `least` or more, each once; of equal ones the earlier (or later) first.

    A ratio is never above twice the characters that both have, as a multiset, over the sum of lengths.  So pairs wait in a
    heap under that bound, and only one that comes out while both are free is compared: what comes out compared is the
    best of all that are left.
    """
    codes = np.frombuffer("".join([*x, *y]).encode("utf-32-le", "surrogatepass"), np.uint32)
    known, codes = np.unique(codes, return_inverse=True)
    sizes, k = np.array([len(t) for t in (*x, *y)], np.int64), max(1, len(known))
    counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * k + codes, minlength=len(sizes) * k).reshape(len(sizes), k).astype(np.int32)
    cx, cy, nx, ny = counts[: len(x)], counts[len(x) :], sizes[: len(x)], sizes[len(x) :]
    sign = -1 if later else 1
    free_x, free_y = np.ones(len(x), bool), np.ones(len(y), bool)
    order_y = sign * np.arange(len(y))

    def candidates(i: int) -> Iterator[tuple[float, int]]:
        """(bound, j) by falling bound, for the free ones of y."""
        last = None
        while True:
            js = np.flatnonzero(free_y)
            total = nx[i] + ny[js]
            bound = np.where(total > 0, 2.0 * np.minimum(cx[i], cy[js]).sum(1) / np.maximum(total, 1), 1.0)
            use = bound >= least
            if last is not None:
                use &= (bound < last[0]) | ((bound == last[0]) & (order_y[js] > last[1]))
            js, bound = js[use], bound[use]
            best = np.lexsort((order_y[js], -bound))[:AHEAD]
            for b, j in zip(bound[best].tolist(), js[best].tolist()):
                last = (b, sign * j)
                if free_y[j]:
                    yield b, j
            if len(best) < AHEAD:
                return

    rows, heap, seen = [candidates(i) for i in range(len(x))], [], {}

    def push(i: int) -> None:
        for b, j in rows[i]:
            heapq.heappush(heap, (-b, sign * i, sign * j, False))
            return

    for i in range(len(x)):
        push(i)
    while heap:
        value, i, j, compared = heapq.heappop(heap)
        i, j = sign * i, sign * j
        if not free_x[i]:
            continue
        if compared:
            if free_y[j]:
                free_x[i] = free_y[j] = False
                yield i, j, -value
            continue
        if free_y[j]:
            pair = x[i], y[j]
            if pair not in seen:
                seen[pair] = 1.0 if x[i] == y[j] else SequenceMatcher(None, *pair).ratio()
            if seen[pair] >= least:
                heapq.heappush(heap, (-seen[pair], sign * i, sign * j, True))
        push(i)


def aligned_blocks(pairs: DataFrame, key: str, before: str, after: str, least: float = 0.32) -> DataFrame:
    """key, old, new, ratio: blocks replaced between two versions, paired greedily by falling ratio."""

    def run(frame):
        out = []
        for k, x, y in zip(frame[key], frame["b"], frame["a"]):
            x, y = ([] if z is None else list(z) for z in (x, y))
            for tag, i1, i2, j1, j2 in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
                if tag == "replace":
                    out.extend((k, x[i1 + i], y[j1 + j], round(score, 3)) for i, j, score in pairs_by_ratio(x[i1:i2], y[j1:j2], least))
        return pd.DataFrame(out, columns=[key, "old", "new", "ratio"])

    from .blocks import blocks

    kind = pairs.schema[key].dataType.simpleString()
    return map_frames(pairs.select(key, blocks(F.col(before)).alias("b"), blocks(F.col(after)).alias("a")), run, f"{key} {kind}, old string, new string, ratio double")
