"""Style diagnostics: rhetorical patterns with their lines, paragraph metrics and multi-block heuristics."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from . import blocks
from .rules import Rule

# Rhetorical patterns by name.
TICS = {
    "not X but Y": r"\bnot\b[^.!?\n]{0,100}\bbut\b",
    "this does not prove": r"\bthis does not prove\b",
    "that does not mean": r"\bthat does not mean\b",
    "that distinction matters": r"\bthat distinction matters\b",
    "the stronger conclusion": r"\bthe stronger conclusion\b",
    "the better question": r"\bthe better question\b",
    "the evidence stops short": r"\bthe evidence stops short\b",
    "what this actually shows": r"\bwhat this actually shows\b",
    "the reality is more complicated": r"\bthe reality is more complicated\b",
    "both things can be true": r"\bboth things can be true\b",
    "it is important to note": r"\bit is important to note\b",
    "in other words": r"\bin other words\b",
    "however corrective pivot": r"\bhowever\b",
    "three-part antithesis": r"\bnot\b[^.!?\n]{0,80}[.!?]\s*not\b[^.!?\n]{0,80}[.!?]\s*(?:rather|instead)\b",
}

def tics(docs: DataFrame, key: str, of: str) -> DataFrame:
    """key, phrase, count, lines of each rhetorical pattern; line numbers of matches need their places, so texts are searched in batches."""
    compiled = {k: re.compile(p, re.I | re.S) for k, p in TICS.items()}

    def run(batches):
        for b in batches:
            out = []
            for k, t in zip(b[key], b["t"]):
                for name, p in compiled.items():
                    lines = [t.count("\n", 0, m.start()) + 1 for m in p.finditer(t or "")]
                    if lines:
                        out.append((k, name, len(lines), lines))
            yield pd.DataFrame(out, columns=[key, "phrase", "count", "lines"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text.diagnostic_plain(F.col(of)).alias("t")).mapInPandas(run, f"{key} {kind}, phrase string, count int, lines array<int>")


def variation(values: Column) -> Column:
    """The population deviation over the mean of an array; null for fewer than two values or a sum of 0."""

    def of(xs: Column, total: Column) -> Column:
        n = F.size(xs)
        square = lambda mean: F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        return F.when((n >= 2) & (total > 0), text.bound(total / F.greatest(F.lit(1), n), lambda mean: F.sqrt(square(mean) / n) / mean))

    return text.bound(values, lambda xs: text.bound(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), lambda total: of(xs, total)))


def style(docs: DataFrame, key: str, of: str) -> DataFrame:
    """key and the metrics of a text's paragraphs, sentences and questions. Each paragraph is cut into sentences once."""

    def measured(paragraph: Column, s: Column) -> Column:
        n = lambda c: F.size(F.filter(s, c))
        return F.struct(
            F.size(F.split(paragraph, " ")).alias("words"), F.size(s).alias("n"), F.transform(s, lambda x: F.size(F.split(x, " ")).cast("double")).alias("lengths"), n(lambda x: x.endswith("?")).alias("questions"),
            n(lambda x: x.rlike(r"(^|[^A-Za-z])(I|my|we)($|[^A-Za-z])")).alias("first_person"), n(lambda x: x.rlike(fixed.CAUTION)).alias("caution"),
        )

    p = docs.select(key, F.transform(blocks.paragraphs(F.col(of)), lambda x: text.bound(text.sentences(x), lambda s: measured(x, s))).alias("p"))
    words = F.transform("p", lambda x: x["words"].cast("double"))
    total = lambda name: _sum(F.transform("p", lambda x: x[name]))
    return p.select(
        key, F.size("p").alias("paragraphs"), F.aggregate(words, F.lit(0.0), lambda a, x: a + x).alias("words"), F.round(variation(words), 4).alias("paragraph_variation"),
        F.round(variation(F.flatten(F.transform("p", lambda x: x["lengths"]))), 4).alias("sentence_variation"),
        F.size(F.filter("p", lambda x: x["n"] == 1)).alias("one_sentence_paragraphs"), total("questions").alias("rhetorical_questions"), total("first_person").alias("first_person"), total("caution").alias("caution_sentences"),
        F.size(F.filter("p", lambda x: (x["n"] >= 3) & (x["caution"] >= 2) & (x["words"] <= 120))).alias("dense_passages"),
    )


def _times(hay: Column, phrases: list[str]) -> Column:
    """(phrase, n) of the phrases that a lower-case text has as whole words. A pattern begins with its phrase, so that the search can skip."""
    literal = [(p, re.escape(p).replace(r"\ ", " ")) for p in phrases]
    each = [F.struct(F.lit(p).alias("phrase"), F.regexp_count(hay, F.lit(rf"{x}(?<=\b{x})\b")).alias("n")) for p, x in literal]
    return F.filter(F.array(*each), lambda x: x["n"] > 0)


def _any(low: Column, *literals: str | tuple[str, ...]) -> Column:
    """Whether a lower-case text has one of the literals (of a tuple: all). A pattern that is a literal is searched in skips, as `contains` isn't."""
    each = [reduce(lambda a, b: a & b, [low.rlike(re.escape(w)) for w in ((x,) if isinstance(x, str) else x)]) for x in literals]
    return reduce(lambda a, b: a | b, each)


def _tics(plain: Column, low: Column) -> Column:
    """(phrase, n) of the rhetorical patterns that a text has; one is counted only in texts whose lower case has its words."""

    def needed(name: str, pattern: str) -> Column:
        return _any(low, {"not X but Y": ("but", "not"), "three-part antithesis": "not"}.get(name) or pattern.replace(r"\b", ""))

    each = [F.struct(F.lit(k).alias("phrase"), F.when(needed(k, p), F.regexp_count(plain, F.lit("(?is)" + p))).otherwise(0).alias("n")) for k, p in TICS.items()]
    return F.filter(F.array(*each), lambda x: x["n"] > 0)


def _repeated(xs: Column, least: int) -> Column:
    """The values that an array has `least` times or more, in the order of their first places; the empty one isn't one."""
    often = F.transform(F.filter(text.counted(xs), lambda x: (x["tf"] >= least) & (x["term"] != "")), lambda x: x["term"])
    return F.array_intersect(xs, often)


#: Each match of `fixed.CAUTION` has one of these in lower case.
CAUTIOUS = ["can't", "cannot", "won't", "will", "going", "careful", "irresponsible", "defensible", "prove", "evidence", "record", "establish", "show", "permit", "distinction", "matters", "precise"]


def _measured(paragraph: Column, cautious: Column) -> Column:
    """words, n (sentences), parts (by spaces), caution, dense, abstract and opening of a paragraph whose white space is squeezed; it is cut into sentences once.

    cautious: whether its text has one of CAUTIOUS.
    """
    letters = "A-Za-z’'"
    # as text.sentences: cut at spaces after . ! ?
    sentences = F.filter(F.split(paragraph, "[ \u0001](?<=[.!?] |\u0001)"), lambda s: s != "")
    # all maximal runs with a word character
    words = F.when(F.length(paragraph) == F.octet_length(paragraph), F.regexp_count(paragraph, F.lit(r"\w[\w'-]*"))).otherwise(F.regexp_count(paragraph, F.lit(r"(?U)\w[\w’'-]*")))
    begin = F.regexp_extract(F.lower(paragraph), rf"^[^{letters}]*[{letters}]+(?:[^{letters}]+[{letters}]+)?", 0)
    caution = F.when(cautious & paragraph.rlike(fixed.CAUTION), F.size(F.filter(sentences, lambda s: s.rlike(fixed.CAUTION)))).otherwise(0)
    counts = F.struct(F.size(sentences).alias("n"), (F.length(paragraph) - F.length(F.replace(paragraph, F.lit(" "), F.lit(""))) + 1).alias("parts"), caution.alias("caution"))
    return text.bound(counts, lambda c: F.struct(
        words.cast("double").alias("words"), c["n"].alias("n"), c["parts"].alias("parts"), c["caution"].alias("caution"), ((c["n"] >= 3) & (c["caution"] >= 2) & (c["parts"] <= 120)).alias("dense"),
        ((c["parts"] >= 90) & ~paragraph.rlike(fixed.STYLE["concrete"])).alias("abstract"), F.array_join(text.every(begin, f"[{letters}]+"), " ").alias("opening"),
    ))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x.cast("int"))


def editorial_style(docs: DataFrame, key: str, of: str, found: DataFrame | None = None, within: bool = False) -> DataFrame:
    """key and all style metrics of Markdown articles, with the names of the rules of `editorial_rules` that each breaks.

    found: rows (key, category) of `rhetoric` and `article_rhetoric`; within: both are found in each text's row, and nothing
    is exchanged.  Without either semantic_rhetoric is empty.  A null text has no row.
    """
    s, plain, none = fixed.STYLE, F.col("plain"), F.array().cast("array<string>")
    having = lambda mark, xs: F.when(F.contains(F.col(of), F.lit(mark)), xs).otherwise(none)
    spans = lambda name, mark, group=1: having(mark, F.regexp_extract_all(of, F.lit(s[name]), F.lit(group)))
    count = lambda hay, name: F.regexp_count(hay, F.lit(s[name]))
    chars = lambda xs: _sum(F.transform(xs, lambda x: F.length(text.diagnostic_plain(x))))
    solid = reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), " \t\n\x0b\f\r", plain)
    measured = text.bound(_any(F.col("low"), *CAUTIOUS), lambda cautious: F.transform(blocks.plain_paragraphs(plain), lambda x: _measured(x, cautious)))
    contrasts = F.when(_any(F.col("low"), "mistake", ("but", "not"), ("both", "and")), count("low", "contrast")).otherwise(0)
    d = docs.where(F.col(of).isNotNull()).select(key, F.col(of), text.diagnostic_plain(F.col(of)).alias("plain")).select("*", F.lower("plain").alias("low"))
    d = d.select(
        key, of, "plain", "low", measured.alias("p"), spans("bold", "**").alias("bold"), spans("bold italic", "***").alias("both"), spans("italic", "*").alias("italic"), spans("image", "[IMAGE:").alias("shown"), spans("image", "[IMAGE:", 2).alias("alts"),
        (text_rhetoric(blocks.located(F.col(of))) if within else F.array().cast("array<struct<category:string,line:int>>")).alias("near"),
    )
    field = lambda name: F.transform("p", lambda x: x[name])
    number = lambda c: F.size(F.filter("p", c))
    near = F.transform("near", lambda x: x["category"])
    whole = _article_categories(F.array_contains(near, "DEFENSIVE SEQUENCE"), plain, F.col("low"), F.size("p"), number(lambda x: x["n"] <= 1), number(lambda x: x["parts"] <= 12)) if within else none
    d = d.select(
        key, F.size("p").alias("paragraphs"), field("words").alias("words"), number(lambda x: x["n"] == 1).alias("one_sentence_paragraphs"), _sum(field("caution")).alias("caution_sentences"), number(lambda x: x["dense"]).alias("caution_density_passages"), F.filter(field("opening"), lambda x: x != "").alias("openings"),
        number(lambda x: x["abstract"]).alias("abstract_blocks"), (F.length("plain") - F.length(F.replace("plain", F.lit("?"), F.lit("")))).alias("rhetorical_questions"), count("plain", "first person").alias("first_person_occurrences"), contrasts.alias("symmetric_contrasts"),
        _times(F.col("low"), fixed.REVIEW_STEMS).alias("review_stems"), _times(F.col("low"), fixed.CAUTION_STEMS).alias("performative_caution"), _tics(plain, F.col("low")).alias("ai_tics"),
        F.size("bold").alias("bold_spans"), F.size("italic").alias("italic_spans"), F.size("both").alias("bold_italic_spans"), (chars("bold") + chars("both")).alias("bold_chars"), (chars("italic") + chars("both")).alias("italic_chars"), F.greatest(F.lit(1), F.length(solid)).alias("prose_chars"),
        F.transform("bold", lambda x: F.trim(F.lower(text.diagnostic_plain(x)))).alias("bold_texts"), F.size(having("**", F.filter(F.split(of, blocks.BLANK), lambda x: x.rlike(s["all bold"])))).alias("bold_paragraphs"),
        count(of, "list group").alias("list_groups"), count(of, "list item").alias("list_items"), F.size("shown").alias("image_markers"), F.transform("shown", lambda x: F.lower(text.squeezed(x))).alias("shown"), "alts", F.array_sort(F.array_union(near, whole)).alias("semantic_rhetoric"),
    )
    d = d.select(
        key, "paragraphs", F.round(variation(F.col("words")), 3).alias("paragraph_length_cv"), F.size(F.filter("words", lambda n: (n > 0) & (n <= 10))).alias("short_paragraphs"), "one_sentence_paragraphs",
        "abstract_blocks", "rhetorical_questions", "first_person_occurrences", "symmetric_contrasts", "review_stems", "performative_caution", "caution_sentences", "caution_density_passages",
        "ai_tics", "bold_spans", "italic_spans", "bold_italic_spans", "list_groups", "list_items", "image_markers", "bold_paragraphs", (F.col("bold_chars") / F.col("prose_chars")).alias("bold_share"), (F.col("italic_chars") / F.col("prose_chars")).alias("italic_share"),
        _repeated(F.col("bold_texts"), 3).alias("repeated_bold"), F.filter(_repeated(F.col("openings"), 3), lambda x: F.split(x, " ")[0].isin(fixed.STYLE_OPENINGS)).alias("repeated_openings"), _repeated(F.col("shown"), 2).alias("repeated_images"),
        F.size(F.filter("alts", lambda x: x.rlike(s["argument"]))).alias("arguing_alts"), F.size(F.filter("shown", lambda x: x.rlike(s["generated"]) & x.rlike(s["documentary"]))).alias("generated_documents"), "semantic_rhetoric",
    )
    if found is not None:
        categories = found.groupBy(key).agg(F.collect_set("category").alias("found_"))
        d = d.join(categories, key, "left").withColumn("semantic_rhetoric", F.array_sort(F.array_union("semantic_rhetoric", F.coalesce("found_", none)))).drop("found_")
    return d.withColumn("warnings", F.array_compact(F.array(*[F.when(F.coalesce(r.broken, F.lit(False)), F.lit(r.name)) for r in editorial_rules()])))


def editorial_rules() -> list[Rule]:
    """The rules over the columns of `editorial_style`; all are hints for an editor."""
    c = F.col
    total = lambda name: _sum(F.transform(name, lambda x: x["n"]))
    caveats = total("performative_caution") + c("caution_sentences")
    return [
        Rule(name, broken, "warning")
        for name, broken in (
            ("repeated paragraph openings", F.size("repeated_openings") > 0),
            ("cumulative explanatory scaffold", total("review_stems") >= 3),
            ("performative caution", total("performative_caution") >= 2),
            ("caution density", c("caution_density_passages") > 0),
            ("repeated constructions", F.exists("ai_tics", lambda x: x["n"] >= 2)),
            ("symmetric contrasts", c("symmetric_contrasts") >= 3),
            ("uniform paragraph lengths", (c("paragraphs") >= 8) & (c("paragraph_length_cv") < 0.35)),
            ("bold paragraphs", c("bold_paragraphs") > 0),
            ("much bold", c("bold_share") > 0.22),
            ("much italic", c("italic_share") > 0.14),
            ("repeated bold", F.size("repeated_bold") > 0),
            ("isolated short paragraphs", (c("paragraphs") >= 20) & (c("short_paragraphs") > F.greatest(F.lit(10), F.floor(c("paragraphs") / 4)))),
            ("one-sentence paragraphs", (c("paragraphs") >= 12) & (c("one_sentence_paragraphs") > 0.45 * c("paragraphs"))),
            ("caveat density", (c("paragraphs") >= 10) & (caveats > F.greatest(F.lit(6), F.floor(c("paragraphs") / 3)))),
            ("abstract blocks", c("abstract_blocks") > 0),
            ("many lists", (c("list_groups") >= 3) & (c("list_items") >= 15)),
            ("repeated images", F.size("repeated_images") > 0),
            ("arguing alt text", c("arguing_alts") > 0),
            ("generated documents", c("generated_documents") > 0),
            ("semantic review", F.size("semantic_rhetoric") > 0),
        )
    ]


def style_rules() -> list[Rule]:
    return [
        Rule("even paragraphs", F.col("paragraph_variation") < 0.25, "warning"),
        Rule("even sentences", F.col("sentence_variation") < 0.3, "warning"),
        Rule("many one-sentence paragraphs", F.col("one_sentence_paragraphs") > 0.5 * F.col("paragraphs"), "warning"),
        Rule("stacked caution", F.col("dense_passages") > 0, "warning"),
        Rule("many rhetorical questions", F.col("rhetorical_questions") > 5, "warning"),
    ]


def rhetoric(located: DataFrame, key: str, own_site: str | None = None) -> DataFrame:
    """key, category, line of the first defensive sequence (which is a contrived dialectic and a premature adjudication as well), the first stagnation and the first denied callback of each text, over blocks (key, line, text).

    own_site: what links to the author's own articles have in them; blocks may have `raw`, their text with links.
    """
    order = Window.partitionBy(key).orderBy("line")
    ahead, six = order.rowsBetween(1, 9), order.rowsBetween(0, 5)
    has = lambda p: F.col("text").rlike(p).cast("int")
    raw = F.col("raw") if "raw" in located.columns else F.col("text")
    denied = F.contains(F.lower(raw), F.lit(own_site.lower())) & F.col("text").rlike(fixed.CALLBACK_DENIED) if own_site else F.lit(False)
    flags = located.select(key, "line", (has(fixed.TRIGGER) == 1).alias("trigger"), has(fixed.BOUNDARY).alias("limit"), has(fixed.REDIRECT).alias("turn"), denied.alias("denied"))  # texts aren't exchanged
    f = flags.select(key, "line", "trigger", F.sum("limit").over(ahead).alias("limits"), F.sum("turn").over(ahead).alias("turns"), F.sum("limit").over(six).alias("near"), F.count(F.lit(1)).over(six).alias("n"), "denied")
    sequence = F.col("trigger") & (F.col("limits") >= 2) & (F.col("turns") >= 1)
    named = [*[(sequence, c) for c in ("DEFENSIVE SEQUENCE", "CONTRIVED DIALECTIC", "PREMATURE ADJUDICATION")], ((F.col("near") >= 3) & (F.col("n") == 6), "NARRATIVE STAGNATION"), (F.col("denied"), "CANON DEFENSIVENESS")]
    found = F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in named]))
    return f.select(key, "line", F.explode(found).alias("category")).groupBy(key, "category").agg(F.min("line").alias("line"))


def text_rhetoric(located: Column, own_site: str | None = None) -> Column:
    """(category, line) as `rhetoric` has them, of one text's blocks (line, text), in its row. Triggers and turns are searched only where there are two boundaries."""

    def found(b: Column, limits: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(b) - 1)
        line = lambda places: F.get(b, F.get(places, F.lit(0)))["line"]
        turns = F.transform(b, lambda x: x["text"].rlike(fixed.REDIRECT))
        sequence = text.bound(turns, lambda t: F.filter(at, lambda i: (_sum(F.slice(limits, i + 2, 9)) >= 2) & F.exists(F.slice(t, i + 2, 9), lambda x: x) & F.get(b, i)["text"].rlike(fixed.TRIGGER)))
        stagnant = F.filter(at, lambda i: (i + 6 <= F.size(b)) & (_sum(F.slice(limits, i + 1, 6)) >= 3))
        named = lambda c, l: F.when(l.isNotNull(), F.struct(F.lit(c).alias("category"), l.alias("line")))
        first = lambda l: F.array(*[named(c, l) for c in ("DEFENSIVE SEQUENCE", "CONTRIVED DIALECTIC", "PREMATURE ADJUDICATION")])
        return F.array_compact(F.concat(text.bound(line(sequence), first), F.array(text.bound(line(stagnant), lambda l: named("NARRATIVE STAGNATION", l)))))

    def of(b: Column) -> Column:
        limits = F.transform(b, lambda x: x["text"].rlike(fixed.BOUNDARY).cast("int"))
        out = text.bound(limits, lambda n: F.when(_sum(n) >= 2, found(b, n)).otherwise(F.array().cast("array<struct<category:string,line:int>>")))
        if not own_site:
            return out
        denied = F.slice(F.filter(b, lambda x: F.contains(F.lower(x["text"]), F.lit(own_site.lower())) & x["text"].rlike(fixed.CALLBACK_DENIED)), 1, 1)
        return F.concat(out, F.transform(denied, lambda x: F.struct(F.lit("CANON DEFENSIVENESS").alias("category"), x["line"].alias("line"))))

    return text.bound(located, of)


def _article_categories(sequence: Column, plain: Column, low: Column, n: Column, one: Column, short: Column) -> Column:
    """The categories of a whole text of n paragraphs: `one` of them have a sentence at most, `short` twelve words at most."""
    named = [
        (sequence & _audited(plain), "AUDITOR VOICE"),
        (_any(low, "thesis fail") & plain.rlike(fixed.THESIS_FAILS) & plain.rlike(fixed.REDIRECT), "THESIS SUBSTITUTION"),
        ((n >= 35) & (F.regexp_count(plain, F.lit(fixed.STYLE["first person"])) <= 1), "NARRATOR ABSENCE"),
        ((n >= 20) & (one / F.greatest(F.lit(1), n) > 0.45) & (short / F.greatest(F.lit(1), n) > 0.25), "MECHANICAL REVEAL WRITING"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in named]))


def _audited(plain: Column) -> Column:
    return F.regexp_count(plain, F.lit(fixed.AUDIT)) >= 8


def article_rhetoric(docs: DataFrame, key: str, of: str, found: DataFrame) -> DataFrame:
    """key, category of whole texts: auditor voice, thesis substitution, narrator absence, mechanical reveals. found: rows of `rhetoric`. Texts aren't exchanged."""
    sequence = found.where("category = 'DEFENSIVE SEQUENCE'").select(key, F.lit(True).alias("sequence"))
    d = docs.select(key, text.diagnostic_plain(F.col(of)).alias("plain")).select(key, "plain", blocks.plain_paragraphs(F.col("plain")).alias("p"))
    number = lambda c: F.size(F.filter("p", c))
    others = _article_categories(F.lit(False), F.col("plain"), F.lower("plain"), F.size("p"), number(lambda x: F.size(text.sentences(x)) <= 1), number(lambda x: F.size(F.split(x, " ")) <= 12))
    d = d.select(key, _audited(F.col("plain")).alias("audited"), others.alias("others")).join(sequence, key, "left")
    voice = F.when(F.coalesce("sequence", F.lit(False)) & F.col("audited"), F.array(F.lit("AUDITOR VOICE"))).otherwise(F.array().cast("array<string>"))
    return d.select(key, F.explode(F.concat(voice, "others")).alias("category"))


def caution_density(paragraph: Column) -> Column:
    """caution (sentences with a caution) and dense (three sentences or more, two of them cautions, 120 words at most) of a paragraph."""
    dense = lambda x: F.struct(x["caution"].alias("caution"), ((x["n"] >= 3) & (x["caution"] >= 2) & (F.size(F.split(F.trim(paragraph), text.SPACE)) <= 120)).alias("dense"))
    cautions = lambda s: F.size(F.filter(s, lambda x: x.rlike(fixed.CAUTION)))
    return text.bound(text.sentences(paragraph), lambda s: text.bound(F.struct(F.size(s).alias("n"), cautions(s).alias("caution")), dense))


def paragraph_metrics(docs: DataFrame, key: str, parts: Column) -> DataFrame:
    """key, paragraphs, mean, median, variation of the words of a text's paragraphs."""
    n = F.transform(F.filter(parts, lambda p: F.trim(p) != ""), lambda p: F.size(F.split(F.trim(p), text.SPACE)).cast("double"))
    m = docs.select(key, F.array_sort(n).alias("n")).where("size(n) > 0")
    k = F.size("n")
    middle = (F.element_at("n", F.floor((k + 1) / 2).cast("int")) + F.element_at("n", F.floor((k + 2) / 2).cast("int"))) / 2
    return m.select(key, k.cast("long").alias("paragraphs"), (F.aggregate("n", F.lit(0.0), lambda a, x: a + x) / k).alias("mean"), middle.alias("median"), variation(F.col("n")).alias("variation"))


def openings(docs: DataFrame, parts: Column, least: int = 3, words: int = 2) -> DataFrame:
    """opening and n: first words (letters and apostrophes, case ignored) that `least` paragraphs or more begin with."""
    p = docs.select(F.explode(parts).alias("p")).select(text.every(F.lower("p"), "[a-z’']+").alias("w")).where("size(w) > 0")
    return p.groupBy(F.array_join(F.slice("w", 1, words), " ").alias("opening")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def repeated_emphasis(docs: DataFrame, key: str, spans: Column, least: int = 2) -> DataFrame:
    """key, phrase, n: emphasised spans (white space squeezed, case ignored) that a text has `least` times or more."""
    s = docs.select(key, F.explode(spans).alias("s")).select(key, F.lower(text.squeezed(F.col("s"))).alias("phrase")).where("phrase <> ''")
    return s.groupBy(key, "phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def assertion_type(sentence: Column) -> Column:
    """The kind of statement a clause makes, by an ordered cascade of patterns."""
    p = fixed.ASSERTIONS
    low = F.regexp_replace(F.lower(sentence), p["final slide"], "")
    has = lambda name: low.rlike(p[name])
    quote = sentence.rlike(p["quoted"]) & has("spoken")
    return (
        F.when(low.isin(fixed.FRAMING), "RHETORICAL_NONFACTUAL")
        .when(has("action") & quote, "QUOTE").when(has("action") & sentence.rlike(p["currency"]), "NUMERIC").when(has("action"), "DIRECT_FACT")
        .when(has("synthesis first"), "SYNTHESIS")
        .when((sentence.endswith("?") & ~has("proposition")) | (has("imperative") & ~has("factual follow") & ~has("proposition")), "RHETORICAL_NONFACTUAL")
        .when(has("number"), "NUMERIC").when(quote, "QUOTE").when(has("chronology") | has("year"), "CHRONOLOGY").when(has("causal"), "CAUSAL")
        .when(has("comparative"), "COMPARATIVE").when(has("relationship"), "RELATIONSHIP").when(has("synthesis"), "SYNTHESIS").otherwise("DIRECT_FACT")
    )
