"""Column functions on addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

#: Engine, host suffix (a dot at the end stands for any domain after it), path prefix, query parameter.
ENGINES = (
    ("google", "google.", "/search", "q"),
    ("google_maps", "google.", "/maps/search/", None),
    ("google_scholar", "scholar.google.", "/scholar", "q"),
    ("bing", "bing.com", "/search", "q"),
    ("duckduckgo", "duckduckgo.com", "/", "q"),
    ("brave", "search.brave.com", "/search", "q"),
    ("kagi", "kagi.com", "/search", "q"),
    ("ecosia", "ecosia.org", "/search", "q"),
    ("yahoo", "search.yahoo.com", "/search", "p"),
    ("perplexity", "perplexity.ai", "/search", "q"),
    ("chatgpt", "chatgpt.com", "/", "q"),
    ("claude", "claude.ai", "/new", "q"),
    ("youtube", "youtube.com", "/results", "search_query"),
    ("github", "github.com", "/search", "q"),
    ("stackoverflow", "stackoverflow.com", "/search", "q"),
    ("wikipedia", "wikipedia.org", "/w/index.php", "search"),
    ("wikipedia", "wikipedia.org", "/wiki/Special:Search", "search"),
    ("amazon", "amazon.", "/s", "k"),
    ("reddit", "reddit.com", "/search", "q"),
    ("x", "x.com", "/search", "q"),
    ("x", "twitter.com", "/search", "q"),
    ("linkedin", "linkedin.com", "/search/results/", "keywords"),
    ("arxiv", "arxiv.org", "/search", "query"),
    ("npm", "npmjs.com", "/search", "q"),
    ("crates", "crates.io", "/search", "q"),
    ("apple_developer", "developer.apple.com", "/search", "q"),
    ("mdn", "developer.mozilla.org", "/", "q"),
)

#: How far a kind of source is trusted, by the scheme of its address.
TRUST = (
    (("user://",), 1.00),
    (("github://", "linear://", "slack://", "mail://", "calendar://", "notion://"), 0.95),
    (("file://", "terminal://"), 0.88),
    (("http://", "https://", "browser://"), 0.80),
)
TRUST_NAMED, TRUST_ELSE = 0.68, 0.52


def host(url):
    """Host in lower case, without port and `www.`; empty if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    return F.regexp_replace(found, r"^www\.", "")


def path(url):
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def address(url):
    """Host and path, without query and fragment: what tells two pages apart."""
    return F.concat(host(url), F.regexp_replace(path(url), r"/+$", ""))


def parameter(url, name: str):
    return F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)


def decoded(value):
    """Percent-decoded with plus signs as spaces; undecodable text stays as it is."""
    return F.coalesce(F.try_url_decode(value), value)


def source_quality(url, named):
    """The ranking prior of a source; `named` says whether it has an application or a title."""
    low = F.lower(F.coalesce(url, F.lit("")))
    out = F.when(F.lit(False), 0.0)
    for schemes, score in TRUST:
        out = out.when(reduce(lambda a, b: a | b, (low.startswith(s) for s in schemes)), score)
    return out.when(named, TRUST_NAMED).otherwise(TRUST_ELSE)


def search_query(url, longest: int = 300):
    """A struct (engine, query) of the first rule that an address fits, or null."""
    h, p = host(url), path(url)
    out = F.lit(None).cast("struct<engine:string,query:string>")
    for engine, suffix, prefix, name in reversed(ENGINES):
        if suffix.endswith("."):
            at = h.startswith(suffix) | h.contains("." + suffix)
        else:
            at = (h == suffix) | h.endswith("." + suffix)
        raw = parameter(url, name) if name else F.regexp_extract(p, rf"^{prefix}([^/]*)", 1)
        text = F.left(F.trim(F.regexp_replace(decoded(raw), r"\s+", " ")), F.lit(longest))
        fits = at & p.startswith(prefix) & (text != "")
        out = F.when(fits, F.struct(F.lit(engine).alias("engine"), text.alias("query"))).otherwise(out)
    return out
