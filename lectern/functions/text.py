"""Column expressions over texts: tokenizers, cleaners, counters, names and hashes. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

SPACE = r"\s+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is made once, however often the expression has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def every(text: Column, pattern: str) -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def without(tokens: Column, stop: Sequence[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(list(stop)))


def counted(tokens: Column) -> Column:
    """(term, tf) of the distinct tokens, ascending; tokens are sorted, and each run of equal ones is as long as they are frequent."""

    def runs(s: Column, first: Column) -> Column:
        return F.transform(first, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(first, k + 1), F.size(s)) - i).cast("long").alias("tf")))

    def places(s: Column) -> Column:
        every_ = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(every_, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

    return bound(F.sort_array(tokens), lambda s: bound(places(s), lambda first: runs(s, first)))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def stripped_where_blank(text: Column) -> Column:
    """`stripped` of what is made already: only texts with white space or an end of a line at one of their ends are searched."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(r"[\s\x85\u2028\u2029]"), stripped(text)).otherwise(text)


def search_tokens(text: Column) -> Column:
    """Lower-case tokens of two or more letters, digits and _.&'- without stop words, with repeats."""
    return without(F.transform(every(text, r"[A-Za-z0-9][A-Za-z0-9_.&'-]{1,}"), F.lower), fixed.SEARCH_STOP)


def lower_search_tokens(low: Column) -> Column:
    """`search_tokens` of a text that is in lower case."""
    return without(every(low, r"[a-z0-9][a-z0-9_.&'-]{1,}"), fixed.SEARCH_STOP)


def voice_tokens(text: Column, stop: Sequence[str] = fixed.VOICE_STOP) -> Column:
    """Lower-case tokens of three or more characters, with repeats (a multiset)."""
    return without(every(F.lower(text), r"[a-z0-9][a-z0-9'-]{2,}"), stop)


def local_terms(text: Column) -> Column:
    """Distinct lower-case terms of four or more characters."""
    return F.array_distinct(F.filter(F.transform(every(text, r"[A-Za-z0-9][A-Za-z0-9_-]{2,}"), F.lower), lambda t: F.length(t) >= 4))


def _no_digits(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.rlike("^[0-9]+$"))


def workflow_terms(text: Column, stop: Sequence[str] = fixed.WORKFLOW_STOP) -> Column:
    return F.array_distinct(_no_digits(without(every(F.lower(text), r"[a-z0-9][a-z0-9'/-]{2,}"), stop)))


def source_terms(text: Column) -> Column:
    return F.array_distinct(_no_digits(without(every(F.lower(text), r"[a-z0-9][a-z0-9_.-]{2,}"), fixed.SOURCE_STOP)))


def identity_words(text: Column) -> Column:
    """Words of three or more characters outside links, without stop words, in order."""
    plain = F.lower(F.regexp_replace(text, r"https?://\S+|\[[^\]]+\]\([^)]+\)|[^a-zA-Z0-9’'-]+", " "))
    words = F.transform(F.split(F.trim(plain), " +"), lambda w: F.regexp_replace(w, "^[’'-]+|[’'-]+$", ""))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(fixed.IDENTITY_STOP))


def alnum(text: Column) -> Column:
    """Lower-case runs of letters and digits, joined by a space."""
    return F.array_join(every(F.lower(text), "[a-z0-9]+"), " ")


def phrase(text: Column) -> Column:
    return F.lower(squeezed(F.regexp_replace(text, r"[^A-Za-z0-9&.'_-]+", " ")))


def title_key(text: Column) -> Column:
    return alnum(F.regexp_replace(F.lower(text), "['’]s", ""))


def slug(text: Column, most: int = 80, default: str = "article") -> Column:
    """Lower-case, everything else to single underscores."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, most), F.lit("")), F.lit(default))


#: Accented letters of European languages and what they fold to.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_FOLDED = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def hyphen_slug(text: Column, most: int = 90, devices: bool = True) -> Column:
    """Accents folded, hyphens between runs of letters and digits; null where nothing is left. devices: file names that Windows keeps for devices get a prefix."""
    s = F.lower(F.translate(text, _ACCENTED, _FOLDED))
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[^\x00-\x7F]", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, most), "-+$", "")
    named = F.when(s.rlike("^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"), F.concat(F.lit("article-"), s)).otherwise(s) if devices else s
    return F.nullif(named, F.lit(""))


def safe_name(path: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(path, "/", "__"), r"[^A-Za-z0-9._-]+", "_"), 1, 220)


def without_images(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\[!\[[^\]]*\]\([^)]*\)\]\([^)]*\)", " "), r"!\[[^\]]*\]\([^)]*\)", " ")


def links_to_anchors(text: Column) -> Column:
    return F.regexp_replace(text, r"\[([^\]]+)\]\((?:https?://|mailto:)[^)]+\)", "$1")


def voice_plain(text: Column) -> Column:
    """Images out, links to their anchors, emphasis out, white space squeezed."""
    t = F.regexp_replace(F.regexp_replace(text, r"!\[[^\]]*\]\([^)]+\)", " "), r"\[([^\]]+)\]\([^)]+\)", "$1")
    return squeezed(F.regexp_replace(t, r"\*\*|__|[*`]", ""))


def diagnostic_plain(text: Column) -> Column:
    """Fenced code, image marks and emphasis out, web links to their anchors."""
    # a pattern is searched only in texts that have its literals
    fenced = lambda t: F.when(F.contains(t, F.lit("```")) | F.contains(t, F.lit("~~~")), F.regexp_replace(t, r"(?ms)^(`{3,}|~{3,})[^\n]*\n.*?^\1[ \t]*(?:\n|$)", "")).otherwise(t)
    images = lambda t: F.when(F.contains(t, F.lit("[IMAGE:")), F.regexp_replace(t, r"\[IMAGE:.*?\]", "")).otherwise(t)
    links = lambda t: F.when(F.contains(t, F.lit("](http")), F.regexp_replace(t, r"\[([^\]]+)\]\((?:https?://)[^\s()]+\)", "$1")).otherwise(t)
    plain = bound(text, lambda a: bound(fenced(a), lambda b: bound(images(b), links)))
    for c in "*_`":
        plain = F.replace(plain, F.lit(c), F.lit(""))
    return plain


def visible_markdown(text: Column) -> Column:
    return F.translate(text, "*_", "")


def without_markers(text: Column) -> Column:
    """Evidence marks such as [[EV-0001]] out."""
    return F.regexp_replace(text, r"\[\[EV-\d{4}\]\]", "")


def _any_of(text: Column, literals: Sequence[str]) -> Column:
    out = F.lit(False)
    for x in literals:
        out = out | F.contains(text, F.lit(x))
    return out


def clean_article(text: Column, title: Column | None = None, boilerplate: Sequence[str] = (), chrome: Sequence[str] = ("share", "subscribe", "comments", "restack"), sections: Sequence[str] = (), cdn: Sequence[str] = ("substackcdn.com", "substack-post-media.s3.amazonaws.com")) -> Column:
    """A search text of a Markdown article: from its H1 on, without images, links to sections or profiles, boilerplate, chrome lines and link targets.

    The H1 is the first that is a part of the title, or has it (words of letters and digits, case ignored), else the first.
    """
    # a pattern is searched only in texts that have its literals, and each step's text is made once
    guarded = lambda t, literals, use: F.when(_any_of(t, literals), use(t)).otherwise(t)
    words = lambda c: F.trim(F.lower(F.regexp_replace(c, r"\W+", " ")))
    has_title = F.lit(False) if title is None else F.coalesce(words(title), F.lit("")) != ""

    def is_title(head: Column) -> Column:
        own = words(F.regexp_extract(head, r"^#\s+(.+?)\s*(?:\n|$)", 1))
        return (own != "") & (F.contains(words(title), own) | F.contains(own, words(title)))

    def from_title(t: Column) -> Column:
        # places of H1 lines: what stands before each
        def chosen(parts: Column) -> Column:
            heads = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
            at = F.lit(0) if title is None else F.coalesce(F.when(has_title, F.array_position(F.transform(heads, is_title), True).cast("int")), F.lit(0))
            return F.when(F.size(parts) > 1, bound(F.greatest(at, F.lit(1)), lambda k: F.array_join(F.slice(heads, k, F.greatest(F.size(heads) - k + 1, F.lit(1))), "\n"))).otherwise(t)

        return bound(F.split(F.concat(F.lit("\n"), t), r"\n(?=#\s+\S)"), chosen)

    hosts = "|".join(h.replace(".", r"\.") for h in cdn)

    def kept_lines(t: Column) -> Column:
        # a text isn't put in lower case for what its length or the letter after a dot excludes (but k and i, no letter of ASCII becomes from others)
        short = lambda x: (F.length(F.trim(x)) <= max(map(len, chrome), default=0)) & F.lower(F.trim(x)).isin(list(chrome))
        after = lambda h: [f".{c}" for c in {h[h.find(".") + 1], h[h.find(".") + 1].upper()}] if "." in h[:-1] and h[h.find(".") + 1] not in "ki" else [""]
        hosted = lambda x: _any_of(x, [a for h in cdn for a in after(h)]) & _any_of(F.lower(x), cdn)
        lines = F.filter(F.split(t, "\n"), lambda x: ~short(x) & ~F.trim(x).rlike(fixed.DATE_LINE) & ~hosted(x))
        return F.array_join(F.transform(lines, lambda x: F.when(F.trim(x) == "", F.lit("")).otherwise(x)), "\n")

    steps = [
        lambda t: guarded(t, ["\r"], lambda x: F.regexp_replace(x, "\r\n?", "\n")), lambda t: guarded(t, ["#"], from_title), lambda t: guarded(t, ["!["], without_images),
        *([lambda t: F.regexp_replace(t, r"(?i)\[(?:" + "|".join(sections) + r")\]\((?:https?://)?[^)]*(?:/s/|/@|/profile/)[^)]*\)", " ")] if sections else []),
        lambda t: guarded(t, ["]("], lambda x: F.regexp_replace(x, r"(?i)\[[^\]]*\]\(https?://(?:" + hosts + r")[^)]+\)", " ")),
        *[(lambda b: lambda t: F.regexp_replace(t, "(?i)" + b, " "))(b) for b in boilerplate],
        kept_lines, lambda t: guarded(t, ["]("], links_to_anchors), lambda t: guarded(t, ["\t", "  "], lambda x: F.regexp_replace(x, "[ \t]+", " ")), lambda t: guarded(t, ["\n\n\n"], lambda x: F.regexp_replace(x, "\n{3,}", "\n\n")),
    ]
    t = text
    for step in steps:
        t = bound(t, step)
    return bound(t, stripped_where_blank)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+"))


def memory_word_count(text: Column) -> Column:
    """Words with apostrophes and hyphens inside, links left out."""
    return F.regexp_count(F.regexp_replace(text, r"\[[^\]]+\]\([^)]+\)", ""), F.lit(r"[\p{L}\p{N}_]([\p{L}\p{N}_’'-]*[\p{L}\p{N}_])?"))


def copy_word_count(text: Column) -> Column:
    return F.regexp_count(F.regexp_replace(text, r"(?m)^\d+/\s*", ""), F.lit(r"[\p{L}\p{N}_]([\p{L}\p{N}_’'-]*[\p{L}\p{N}_])?"))


def weighted_length(text: Column) -> Column:
    """1 for each ASCII character, 2 for each other."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))


def seconds(words: Column) -> Column:
    return F.round(words / F.lit(2.4), 1)


def duration_status(bucket: str, words: Column) -> Column:
    if bucket not in fixed.DURATIONS:
        return F.lit("NOT_APPLICABLE")
    low, high = fixed.DURATIONS[bucket]
    return F.when(seconds(words).between(low * 0.8, high * 1.2), "PASS").otherwise("FAIL")


def first_title(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*$", 1))


def headings(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}\s+(.+?)\s*$"), F.lit(1)), lambda x: F.trim(x))


def excerpt(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def between(text: Column, start: str, end: str) -> Column:
    """The text from one anchor to the end of another; empty without both."""
    at = F.instr(text, start)
    rest = F.substr(text, at)
    stop = F.instr(rest, end)
    return F.when((at > 0) & (stop > 0), F.substr(rest, F.lit(1), stop + len(end) - 1)).otherwise("")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def contains_excerpt(text: Column, part: Column) -> Column:
    """Whether a part stands in a text, white space squeezed and case ignored; a blank part doesn't."""
    p = F.lower(squeezed(part))
    return (p != "") & F.contains(F.lower(squeezed(text)), p)


def complete_sentence(text: Column) -> Column:
    def count(c: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))

    return text.rlike("[.!?][\"”’']*$") & (count("“") == count("”")) & (count('"') % 2 == 0)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of arrays as sets; 0 where either is empty. Each array is made once."""
    of = lambda x, y: F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda s: of(s["a"], s["b"]))


def coverage(a: Column, b: Column) -> Column:
    """The share of a's distinct terms that b has."""
    return covered(coverage_terms(alnum(a)), coverage_terms(alnum(b)))


def coverage_terms(alnum: Column) -> Column:
    """The distinct terms of what `alnum` gives that count for `coverage`."""
    return F.array_distinct(without(F.split(alnum, " "), [*fixed.COVERAGE_STOP, ""]))


def covered(x: Column, y: Column) -> Column:
    """The share of x that y has, of arrays as sets."""
    return F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(x))


def preview_boundary(text: Column) -> Column:
    """The phrase in the last 2500 characters that says that a text goes on elsewhere, or null."""
    tail = F.right(F.lower(squeezed(text)), F.lit(2500))
    rules = [F.when(F.contains(tail, F.lit(p)), p) for p in fixed.PREVIEW_PHRASES]
    rules.append(F.when(F.contains(tail, F.lit("purchase a paid subscription")) & F.contains(tail, F.lit("continue reading")), fixed.PREVIEW_PURCHASE))
    rules.append(F.when(F.contains(tail, F.lit("upgrade to paid")) & tail.rlike("continue|unlock|read the rest"), fixed.PREVIEW_UPGRADE))
    return F.coalesce(*rules)


def traits(text: Column) -> Column:
    """The first three of five traits of a paragraph, or a default."""
    n = F.regexp_count(text, F.lit("[^.!?][.!?]"))  # as many as runs with an end; a run itself would be read again from each of its characters
    rules = [*[(text.rlike(p), name) for p, name in fixed.TRAITS], (n.between(2, 6), fixed.RHYTHM)]
    found = F.slice(F.array_compact(F.array(*[F.when(c, s) for c, s in rules])), 1, 3)
    return bound(found, lambda x: F.when(F.size(x) == 0, F.array(F.lit(fixed.PLAIN_TRAIT))).otherwise(x))


def rendered(body: Column, tail: Column) -> Column:
    """Body and call to action with a blank line between; without the latter, the body alone. White space at the ends goes."""
    b, c = stripped(body), stripped(F.coalesce(tail, F.lit("")))
    return F.when(c == "", b).otherwise(F.concat(b, F.lit("\n\n"), c))


def copyedit_issues(text: Column) -> Column:
    """Codes of typographical faults, sorted."""
    issues = [
        F.when(text.rlike("[!?.,]{2,}"), "DOUBLE_PUNCTUATION"),
        F.when(text.rlike(r"(?iU)\b(\w+)\s+\1\b"), "REPEATED_WORD"),
        F.when(text.rlike(r" {2,}|\s+[,.!?]"), "SPACING"),
        F.when(F.length(F.replace(text, F.lit("“"), F.lit(""))) != F.length(F.replace(text, F.lit("”"), F.lit(""))), "MALFORMED_QUOTES"),
    ]
    return F.array_sort(F.array_compact(F.array(*issues)))


def sentences(text: Column) -> Column:
    """Sentences cut after . ! ? before white space, white space squeezed."""
    return F.filter(F.split(F.regexp_replace(squeezed(text), r"([.!?]) ", "$1\u0001"), "\u0001"), lambda s: s != "")
