"""Addresses as Catalyst expressions: dedupe key, domain, canonical choice.

Parsing is Spark's ``try_parse_url``; what it can't parse counts as no address.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track the visitor.
TRACKING = (
    "fbclid", "gclid", "msclkid", "yclid", "twclid", "igshid", "dclid",
    "mc_cid", "mc_eid", "_hsenc", "_hsmi", "vero_id", "ref_src", "ref_url",
    "spm", "scm", "mkt_tok", "trk", "oly_enc_id", "oly_anon_id",
)


def part(url: Column, what: str) -> Column:
    return F.try_parse_url(url, F.lit(what))


def scheme(url: Column) -> Column:
    return F.lower(part(url, "PROTOCOL"))


def web(url: Column) -> Column:
    return F.coalesce(scheme(url).isin("http", "https"), F.lit(False))


def domain_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(part(url, "HOST")), r"^www\.", "")


def port(url: Column) -> Column:
    """``:port`` unless it is a default one."""
    p = F.regexp_extract(part(url, "AUTHORITY"), r":(\d+)$", 1)
    return F.when(p.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), p))


def path(url: Column) -> Column:
    p = part(url, "PATH")
    return F.when(F.coalesce(p, F.lit("")) == "", "/").otherwise(p)


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def params(query: Column) -> Column:
    """Array of (name, value), decoded, in order."""
    pieces = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("name"), F.when(F.contains(x, F.lit("=")), _decoded(F.regexp_replace(x, "^[^=]*=", ""))).otherwise("").alias("value")))


def encoded(c: Column) -> Column:
    """Percent-encoding with ``!'()*`` and letters, digits, ``-_.~`` left alone."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def tracking(name: Column) -> Column:
    return F.lower(name).startswith("utm_") | F.lower(name).isin(*TRACKING)


def url_key(url: Column) -> Column:
    """The address under which pages are the same page; null unless http(s)."""
    kept = F.array_sort(F.filter(params(part(url, "QUERY")), lambda p: ~tracking(p["name"])))
    query = F.array_join(F.transform(kept, lambda p: F.concat(encoded(p["name"]), F.lit("="), encoded(p["value"]))), "&")
    p = path(url)
    p = F.when((F.length(p) > 1) & p.endswith("/"), F.left(p, F.length(p) - 1)).otherwise(p)
    key = F.concat(scheme(url), F.lit("://"), domain_of(url), port(url), p, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(web(url), key)


def canonical_for(url: Column, canonical: Column) -> Column:
    """The canonical address if it is the same page by host, port, path and parameters, else the page's own."""
    bare = lambda u: F.regexp_replace(path(u), "/+$", "")
    extra = F.array_except(params(part(canonical, "QUERY")), params(part(url, "QUERY")))
    same = web(canonical) & (domain_of(url) == domain_of(canonical)) & (port(url) == port(canonical)) & (bare(url) == bare(canonical)) & (F.size(extra) == 0)
    return F.when(F.coalesce(same, F.lit(False)), canonical).otherwise(url)


def text_directive(phrase: Column) -> Column:
    """What an address ends with to open at a phrase, which may be empty."""
    return F.concat(F.lit("#:~:text="), F.replace(encoded(phrase), F.lit("-"), F.lit("%2D")))


def text_fragment(url: Column, phrase: Column) -> Column:
    """The address that opens at a phrase."""
    return F.when(F.coalesce(phrase, F.lit("")) == "", url).otherwise(F.concat(F.substring_index(url, "#", 1), text_directive(phrase)))
