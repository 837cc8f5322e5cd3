"""Column expressions over URLs. Malformed ones give null parts, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, n)


def authority(url: Column) -> Column:
    return F.lower(part(url, 2))


def host(url: Column) -> Column:
    return F.regexp_replace(authority(url), r":\d*$", "")


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(part(url, 3), F.lit("")), F.lit("/"))


def _bare(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(path(url), "/+$", ""), F.lit("")), F.lit("/"))


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no slash at the end, no query and no fragment."""
    return F.concat(F.lower(part(url, 1)), F.lit("://"), authority(url), _bare(url))


def identity(url: Column) -> Column:
    return F.concat(F.lit("https://"), authority(url), _bare(url))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def without_tracking(url: Column) -> Column:
    """Query without utm_* and the tracking keys, all else as it was."""
    keys = F.filter(F.split(part(url, 4), "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(utm_[^=]*|" + "|".join(fixed.TRACKING_KEYS) + ")(=|$)"))
    query, fragment = F.array_join(keys, "&"), part(url, 5)
    return F.concat(
        F.lower(part(url, 1)), F.lit("://"), authority(url), part(url, 3),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def with_utm(url: Column, source: str, medium: str, campaign: str, content: Column) -> Column:
    base = F.regexp_replace(url, r"[?#].*$", "")
    return F.concat(base, F.lit(f"?utm_source={source}&utm_medium={medium}&utm_campaign={campaign}&utm_content="), F.url_encode(content))


def is_web(url: Column) -> Column:
    return F.lower(part(url, 1)).isin("http", "https") & (authority(url) != "")


def is_valid(url: Column) -> Column:
    """http(s) with a host, no user, no white space, control or <>\\ characters, percent escapes well formed."""
    return is_web(url) & ~F.contains(authority(url), F.lit("@")) & ~url.rlike(r"[\s<>\\\x00-\x1F]") & ~url.rlike("%(?![0-9A-Fa-f]{2})")


def is_clean(url: Column) -> Column:
    return is_valid(url) & (url == without_tracking(url)) & ~url.rlike("[()]")


def is_post(url: Column, mark: str = "/p/") -> Column:
    return is_web(url) & F.contains(path(url), F.lit(mark))


def host_has(url: Column, markers: list[str]) -> Column:
    return host(url).rlike("|".join(m.replace(".", r"\.") for m in markers))


def link_class(url: Column, article: Column, mark: str = "/p/", platform: str = "substack.com", cdn: tuple[str, ...] = ("substackcdn.com", "substack-post-media.s3.amazonaws.com")) -> Column:
    """internal_article (the article's host, a post path), ignored (no web link, CDN, platform, other pages of the host) or external_research."""
    h, own = host(url), host(article)
    internal = (h == own) & F.startswith(path(url), F.lit(mark))
    return (
        F.when(~F.coalesce(F.trim(url).rlike("^https?://"), F.lit(False)), "ignored")
        .when(h.isin(*cdn) | F.endswith(h, F.lit(cdn[0])), "ignored")
        .when((h == platform) | F.endswith(h, F.lit("." + platform)) | (h == own), F.when(internal, "internal_article").otherwise("ignored"))
        .otherwise("external_research")
    )


def is_junk_anchor(anchor: Column) -> Column:
    low = F.regexp_replace(F.lower(F.regexp_replace(F.trim(F.coalesce(anchor, F.lit(""))), r"\s+", " ")), "^[#*_: -]+|[#*_: -]+$", "")
    return (low == "") | low.isin(fixed.JUNK_ANCHORS) | low.rlike("^(share|subscribe) ")
