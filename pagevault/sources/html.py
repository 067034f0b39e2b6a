"""Readable text of raw HTML pages, in built-in string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _plain(c: Column) -> Column:
    for code, char in ENTITIES:
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def title(html: Column) -> Column:
    return F.trim(_plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def text(html: Column) -> Column:
    """Text of the article (else main, else body): tags dropped, blocks on lines, spaces collapsed."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>", "")
    inside = lambda tag: F.nullif(F.regexp_extract(bare, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1), F.lit(""))
    body = F.coalesce(inside("article"), inside("main"), inside("body"), bare)
    lines = F.regexp_replace(body, r"(?i)<br\s*/?>|</?(p|div|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|blockquote|pre)\b[^>]*>", "\n")
    flat = F.regexp_replace(_plain(F.regexp_replace(lines, r"<[^>]*>", "")), r"[ \t]+", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(flat, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))


def canonical(html: Column) -> Column:
    """Address of the first canonical link, or null."""
    tag = F.regexp_extract(html, r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*>", 0)
    return F.nullif(F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit(""))


# Where payment forms come from, and which of their frames are none.
_FRAME = r"https://(?:[a-z0-9-]+\.)*(?:js\.stripe\.com|checkout\.stripe\.com|braintreegateway\.com|braintree-api\.com|adyen\.com|paypal\.com|checkoutshopper-live\.adyen\.com|pay\.google\.com|squareup\.com|squarecdn\.com|recurly\.com|chargebee\.com|klarna\.com|mollie\.com)/"
_HELPER = r"https://(?:[a-z0-9-]+\.)*(?:js\.stripe\.com/v\d+/(?:controller|m-outer|metrics)|paypal\.com/(?:smart/buttons\b|credit-presentment/))"


def payment_frame(html: Column) -> Column:
    """Whether the page embeds a payment form; frames that only help or advertise don't count."""
    frames = F.regexp_extract_all(html, F.lit(r"(?is)<iframe\b[^>]*\bsrc\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    return F.coalesce(F.exists(frames, lambda x: x.rlike("(?i)^" + _FRAME) & ~x.rlike("(?i)^" + _HELPER)), F.lit(False))


def sensitive(html: Column) -> Column:
    """Whether the page asks for a password or a payment card, or embeds a payment form."""
    return payment_frame(html) | F.coalesce(html.rlike(r"(?is)<input\b[^>]*\b(type\s*=\s*[\"']?password|autocomplete\s*=\s*[\"']?(cc-|current-password|new-password)|name\s*=\s*[\"']?(card[-_]?number|cvc|cvv|iban))"), F.lit(False))
