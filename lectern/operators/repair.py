"""Sequential text repairs in batches: truncated JSON, first-use links, texts shortened to a budget."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .batches import map_frames


def complete_items(raw: str | None) -> list[str]:
    """The complete objects of the array `items`, as JSON, of an object that may break off."""
    text = re.sub(r"^```\w*\s*|\s*```$", "", (raw or "").strip())
    m = re.search(r'"items"\s*:\s*\[', text)
    if not m:
        return []
    decoder, at, out = json.JSONDecoder(), m.end(), []
    while at < len(text):
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            break
        out.append(json.dumps(value, ensure_ascii=False, sort_keys=True))
    return out


def repaired_items(df: DataFrame, key: str, raw: str) -> DataFrame:
    """key and items: whole JSON objects of each text."""

    def run(b):
        return pd.DataFrame({key: b[key], "items": [complete_items(x) for x in b[raw]]})

    return map_frames(df.select(key, raw), run, f"{key} {df.schema[key].dataType.simpleString()}, items array<string>")


_TAKEN = re.compile(r"```.*?(?:```|\Z)|\[[^\]\n]*\]\([^)\n]*\)", re.S)


def link_first(text: str, phrase: str, url: str) -> tuple[str, bool]:
    """The first whole occurrence of a phrase, case ignored, outside links and fenced code, made a link."""
    taken = [m.span() for m in _TAKEN.finditer(text)]
    for m in re.finditer(rf"(?<!\w){re.escape(phrase)}(?!\w)", text, re.I):
        if not any(a < m.end() and m.start() < b for a, b in taken):
            return f"{text[: m.start()]}[{m[0]}]({url}){text[m.end() :]}", True
    return text, False


def linked(df: DataFrame, key: str, of: str, sources: str) -> DataFrame:
    """key, linked, n_linked: sources (phrase, link) inserted from the longest phrase, each at its first free use."""

    def run(b):
        out = []
        for k, t, s in zip(b[key], b[of], b[sources]):
            n = 0
            for _, x in sorted(enumerate(s if t is not None else []), key=lambda p: (-len(p[1]["phrase"]), p[0])):
                t, hit = link_first(t, x["phrase"], x["link"])
                n += hit
            out.append((k, t, n))
        return pd.DataFrame(out, columns=[key, "linked", "n_linked"])

    return map_frames(df.select(key, of, sources), run, f"{key} {df.schema[key].dataType.simpleString()}, linked string, n_linked int")


def split_sentences(text: str) -> list[str]:
    """Sentences of each line, without thread and slide numbers; initials and dotted abbreviations end none."""
    return list(each_sentence(text))


def each_sentence(text: str) -> Iterator[str]:
    """`split_sentences`, as far as it is read."""
    for line in re.sub(r"(?m)^\s*(?:Slide \d+\s*[—-]|\d+/)\s*", "", text).split("\n"):
        begin = 0
        for m in re.finditer(r"[.!?][\"”’']*(?=\s|$)", line):
            end = m.end()
            if not re.fullmatch(r"\W?[A-Za-z]\.", line[max(0, end - 3) : end]):  # a lone letter before the full stop
                if line[begin:end].strip():
                    yield line[begin:end].strip()
                begin = end
        if line[begin:].strip():
            yield line[begin:].strip()


def fitting(text: str, limit: int, reserve: int, prefix: str = "", tail: str = "") -> list[str]:
    """As many leading whole sentences as fit a weighted length (2 for a character beyond ASCII) with a prefix, a tail after a blank line and a reserve."""
    kept: list[str] = []
    for s in each_sentence(text):
        if not re.search(r"[.!?][\"”’']*$", s):
            continue
        copy = prefix + " ".join([*kept, s]) + (f"\n\n{tail.strip()}" if tail.strip() else "")
        if sum(1 if ord(c) < 128 else 2 for c in copy) + reserve > limit:
            break
        kept.append(s)
    return kept


def shortened(df: DataFrame, key: str, of: str, limit: int, reserve: int) -> DataFrame:
    """key, short, n_sentences: as many leading whole sentences as fit a weighted length; null without any."""

    def run(b):
        kept = [fitting(t or "", limit, reserve) for t in b[of]]
        return pd.DataFrame({key: b[key], "short": [" ".join(k) or None for k in kept], "n_sentences": [len(k) for k in kept]})

    return map_frames(df.select(key, of), run, f"{key} {df.schema[key].dataType.simpleString()}, short string, n_sentences int")


def prepared(body: str, tail: str, form: str, limit: int = 280, reserve: int = 24) -> str | None:
    """A post, or a thread of posts numbered `1/`, each cut to the sentences that fit; the call to action and the room for its link are the last one's.

    Null where a post of a thread has no number, or no whole sentence fits.
    """
    if form != "THREAD":
        return " ".join(fitting(body, limit, reserve, tail=tail)) or None
    posts, out = re.split(r"\n\s*\n(?=\d+/)", body), []
    for n, post in enumerate(posts):
        number = re.match(r"\d+/\s*", post)
        last = n == len(posts) - 1
        kept = fitting(post[number.end() :], limit, reserve if last else 0, number[0], tail if last else "") if number else []
        if not kept:
            return None
        out.append(number[0] + " ".join(kept))
    return "\n\n".join(out)


def prepared_posts(df: DataFrame, key: str, body: str, tail: str, form: str) -> DataFrame:
    """key and prepared: `prepared` of each row's body, call to action and form."""

    def run(b):
        return pd.DataFrame({key: b[key], "prepared": [prepared(x or "", t or "", f or "") for x, t, f in zip(b[body], b[tail], b[form])]})

    return map_frames(df.select(key, body, tail, form), run, f"{key} {df.schema[key].dataType.simpleString()}, prepared string")
