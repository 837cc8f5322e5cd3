"""What an editor changed between two versions of an article: ten ordered, capped sections as rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import blocks, diagnostics, similarity
from .batches import map_frames

#: The sections in their order.
SECTIONS = ["summary", "section changes", "added blocks", "removed blocks", "replaced blocks", "opening", "conclusion", "qualifications", "paragraph rhythm", "entities", "links"]
#: Most added, removed or replaced blocks; most entities that appear or go, and that gain or lose.
MOST, MOST_NEW, MOST_MOVED = 15, 25, 20


def words(of: Column) -> Column:
    """Words outside links."""
    return F.regexp_count(F.regexp_replace(of, r"\[[^\]]+\]\([^)]+\)", ""), F.lit(r"(?U)\b[\w’'-]+\b"))


def block_changes(x: list[str], y: list[str], least: float = 0.32) -> Iterator[tuple[str, str | None, str | None]]:
    """part (added, removed, replaced), old, new of the blocks of two versions.

    Blocks are aligned as sequences; within a replaced stretch the most similar ones are paired, case ignored, the later
    among equals first; what has no partner of `least` is removed or added.
    """
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        left, right = set(range(i1, i2)), set(range(j1, j2))
        if tag == "replace":
            for i, j, _ in similarity.pairs_by_ratio([p.casefold() for p in x[i1:i2]], [q.casefold() for q in y[j1:j2]], least, later=True):
                left.remove(i1 + i)
                right.remove(j1 + j)
                yield "replaced", x[i1 + i], y[j1 + j]
        yield from (("removed", x[i], None) for i in sorted(left))
        yield from (("added", None, y[j]) for j in sorted(right))


def entity_changes(x: list[str], y: list[str]) -> Iterator[tuple[str, int, str | None, str | None]]:
    """part (appeared, gone, gained, lost), rank, old, new of entities: the largest changes first, then the alphabet."""
    was, now, found = Counter(x), Counter(y), {}
    for name in was.keys() | now.keys():
        b, a = was[name], now[name]
        part = "appeared" if not b else "gone" if not a else "gained" if a >= max(3, 2 * b) else "lost" if b >= max(3, 2 * a) else None
        if part:
            found.setdefault(part, []).append((-abs(a - b), name))
    said = lambda n, name: f"{name} ({n[name]})" if n[name] else None
    for part, names in found.items():
        for rank, (_, name) in enumerate(sorted(names)[: MOST_NEW if part in ("appeared", "gone") else MOST_MOVED]):
            yield part, rank, said(was, name), said(now, name)


def _compared(versions: DataFrame, key: str) -> DataFrame:
    """Rows (key, b, a) with hb, ha (headings), changes, renamed and entities: each pair of versions is compared once, in Python, since alignment is sequential."""
    lists = ("xb", "xa", "hb", "ha", "eb", "ea")

    def run(frame):
        out = []
        for k, b, a, *own in zip(*(frame[c] for c in (key, "b", "a", *lists))):
            xb, xa, hb, ha, eb, ea = (list(v) if v is not None else [] for v in own)
            changes = [dict(zip(("part", "old", "new"), c)) for c in block_changes(xb, xa)]
            renamed = [{"old": o, "new": n} for o, n in sorted((o, n) for o, n, _ in similarity.renamed(hb, ha))]
            out.append((k, b, a, hb, ha, changes, renamed, [dict(zip(("part", "rank", "old", "new"), e)) for e in entity_changes(eb, ea)]))
        return pd.DataFrame(out, columns=[key, "b", "a", "hb", "ha", "changes", "renamed", "entities"])

    each = [f(F.col(c)).alias(n + c) for n, f in (("x", blocks.blocks), ("h", text.headings), ("e", similarity.entities)) for c in ("b", "a")]
    kind = versions.schema[key].dataType.simpleString()
    return map_frames(
        versions.select(key, "b", "a", *each), run,
        f"{key} {kind}, b string, a string, hb array<string>, ha array<string>, changes array<struct<part:string,old:string,new:string>>, renamed array<struct<old:string,new:string>>, entities array<struct<part:string,rank:int,old:string,new:string>>",
    )


def editorial_diff(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, section, part, rank, old, new: the sections of SECTIONS of each pair of versions; old and new say what was and is.

    Summary counts words, headings, paragraphs and changed blocks.  The longest MOST blocks stand for each kind of change;
    the first and last three paragraphs are compared; entities are those that appear, go, gain or lose at least twofold.
    Null versions are empty.  All rows of a pair are made from its one row; nothing is exchanged.
    """
    p = _compared(pairs.select(key, F.coalesce(before, F.lit("")).alias("b"), F.coalesce(after, F.lit("")).alias("a")), key)
    none = F.lit(None).cast("string")

    def row(section: str, part: str | Column, rank: Column, old: Column, new: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), (F.lit(part) if isinstance(part, str) else part).alias("part"), rank.cast("int").alias("rank"), old.cast("string").alias("old"), new.cast("string").alias("new"))

    def listed(section: str, part: str, xs: Column, new: bool) -> Column:
        return F.transform(xs, lambda x, i: row(section, part, i, none, x) if new else row(section, part, i, x, none))

    def table(section: str, rows: list[tuple[str, Column, Column]]) -> Column:
        return F.array(*[row(section, n, F.lit(i), o, w) for i, (n, o, w) in enumerate(rows)])

    def changed(part: str) -> Column:
        return F.transform(F.slice(of(part), 1, MOST), lambda c, i: row(f"{part} blocks", part, i, c["old"], c["new"]))

    sized = F.transform("changes", lambda c, i: F.struct((-words(F.coalesce(c["old"], F.lit(""))) - words(F.coalesce(c["new"], F.lit("")))).alias("size"), i.alias("at"), c["part"].alias("part"), c["old"].alias("old"), c["new"].alias("new")))
    lengths = lambda xs: F.transform(xs, lambda x: words(x).cast("double"))
    pb, pa = blocks.prose_blocks(F.col("b")), blocks.prose_blocks(F.col("a"))
    h = p.select("*", F.array_sort(sized).alias("longest"), pb.alias("pb"), pa.alias("pa"), lengths(pb).alias("lb"), lengths(pa).alias("la"), blocks.link_map(F.col("b")).alias("mb"), blocks.link_map(F.col("a")).alias("ma"))
    of = lambda part: F.filter("longest", lambda c: c["part"] == part)
    kinds = ("added", "removed", "replaced")
    summary = [("words", words(F.col("b")), words(F.col("a"))), ("sections", F.size("hb"), F.size("ha")), ("paragraphs", F.size("pb"), F.size("pa")), *[(f"{x} blocks", none, F.size(of(x))) for x in kinds]]
    without = lambda x, y: F.filter(x, lambda v: ~F.array_contains(F.col(y), v))
    shared = F.filter("hb", lambda v: F.array_contains(F.col("ha"), v) & (F.array_position("hb", v) != F.array_position("ha", v)))
    last = lambda xs: F.slice(xs, F.greatest(F.lit(1), F.size(xs) - 2), F.lit(3))
    mean = lambda xs: F.when(F.size(xs) > 0, F.round(F.aggregate(xs, F.lit(0.0), lambda v, x: v + x) / F.size(xs), 2))
    rhythm = [("paragraphs", F.size), ("mean words", mean), ("variation", lambda xs: F.round(diagnostics.variation(xs), 3)), ("shortest", F.array_min), ("longest", F.array_max)]
    only = lambda mine, other: F.transform(F.array_sort(F.array_except(F.map_keys(mine), F.map_keys(other))), lambda u: F.concat(F.lit("["), F.element_at(F.col(mine), u), F.lit("]("), u, F.lit(")")))
    parts = [
        table("summary", summary), F.transform("renamed", lambda r, i: row("section changes", "renamed", i, r["old"], r["new"])),
        *[changed(x) for x in kinds],
        listed("section changes", "before", F.col("hb"), False), listed("section changes", "after", F.col("ha"), True), listed("section changes", "added", without("ha", "hb"), True), listed("section changes", "removed", without("hb", "ha"), False), listed("section changes", "moved", shared, False),
        listed("opening", "before", F.slice("pb", 1, 3), False), listed("opening", "after", F.slice("pa", 1, 3), True), listed("conclusion", "before", text.bound(blocks.narrative(F.col("b")), last), False), listed("conclusion", "after", text.bound(blocks.narrative(F.col("a")), last), True),
        listed("qualifications", "before", blocks.qualification_sentences(F.col("b")), False), listed("qualifications", "after", blocks.qualification_sentences(F.col("a")), True),
        table("paragraph rhythm", [(n, f(F.col("lb")), f(F.col("la"))) for n, f in rhythm]), F.transform("entities", lambda e: row("entities", e["part"], e["rank"], e["old"], e["new"])),
        listed("links", "added", only("ma", "mb"), True), listed("links", "removed", only("mb", "ma"), False),
    ]
    return h.select(key, F.explode(F.concat(*parts)).alias("r")).select(key, "r.section", "r.part", "r.rank", "r.old", "r.new")
