"""Personal data: an Aho-Corasick automaton finds anchors, local parsers expand and validate them.

Anchors are at-signs, plus signs, address schemes, digits and identifier cues.
Each anchor kind has a deterministic parser that looks only at the bytes around
it and settles the span's boundaries:

* ``email``  from ``@`` leftwards over the local part, rightwards over the domain;
* ``ip``, ``card``  from a digit over its run of digits and separators;
* ``phone``  from ``+`` rightwards;
* ``url``  from ``://`` over the scheme and the address (only with user or query data in it);
* ``account``  from a cue such as ``iban`` or ``account``, in any mixture of cases, to
  the identifier after it; and from a digit over each number of 13 to 19 digits,
  valid by its check digit, inside a run that is too long to be one card;
* ``address``  from a street word to the house number before or after it and the
  postal code, by the order that the word's language has.

The first four are the base kinds, and equal a left-to-right scan without
overlaps by their patterns; matches that fail validation are dropped.  The last
three are the method's own.

Defined results: null text counts as empty and gives no spans; rows are handled
one by one, so repeated rows, ties, empty tables and null ids need no special
care; extra columns are never read; an id may have any name (if it is called
``spans``, the spans are called ``_spans``).  Texts are read whole.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.llm import spans as S
from pagevault.llm.store import batched, beside, col, column, table

KINDS = ("email", "ip", "card", "phone", "url", "account", "address")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[A-Za-z0-9./_~%:@!$&'()*+,;=?#-]+")
ACCOUNT = re.compile(r"[\"']?\x20*(?:(?:number|no\.?|id)\b)?\x20*[:=#]?\x20*[\"']?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?|[A-Z0-9][A-Z0-9-]{5,33})", re.ASCII)
NUMBER = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")
CUES = ("iban", "account", "passport", "customer id", "user id", "ssn", "swift")
STREETS = ("street", "avenue", "road", "lane", "drive", "boulevard")  # after a number and capitalised words
ENDINGS = ("straße", "strasse")  # of a capitalised word before a number
LEADING = ("rue", "calle", "avenida")  # before the name, with the number first or last
HOUSE_BEFORE = re.compile(r"(?<![A-Za-z0-9.,])([0-9]{1,5}[A-Za-z]?\x20(?:[A-Z][a-zà-öø-ÿ'-]{1,20}\x20){1,4})$")
UNIT = re.compile(r"(?:,?\x20(?:Apt|Suite|Unit|Floor)\.?\x20[A-Za-z0-9-]{1,6})?(?:,\x20[A-Z][a-zà-öø-ÿ'-]{1,20}){0,2}(?:,?\x20(?:[A-Z]{2}\x20)?[0-9]{4,6}(?:-[0-9]{4})?(?![0-9]))?")
HOUSE_AFTER = re.compile(r"\x20[0-9]{1,4}[a-z]?(?![0-9A-Za-z.])(?:,?\x20[0-9]{5}(?![0-9])(?:\x20[A-ZÀ-Ö][\wà-öø-ÿ'-]{1,20})?)?")
STREET_NAME = re.compile(r"(?:\x20(?:de\x20la|de\x20las|de\x20los|de|du|des|del))?(?:\x20[A-ZÀ-Ö][\wà-öø-ÿ'-]{1,20}){1,4}")
NUMBER_BEFORE = re.compile(r"(?<![A-Za-z0-9.,])([0-9]{1,4},?\x20)$")
NUMBER_AFTER = re.compile(r",?\x20[0-9]{1,4}(?![0-9A-Za-z.])(?:,?\x20[0-9]{5}(?![0-9])(?:\x20[A-ZÀ-Ö][\wà-öø-ÿ'-]{1,20})?)?")
AROUND = 110  # code points before a street word: a house number and four words
DIGITS = "0123456789"
PLACES = frozenset((*STREETS, *ENDINGS, *LEADING))


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word in ("@", "+", "://", *DIGITS):
        a.add_word(word, word)
    for cue in (*CUES, *STREETS, *ENDINGS, *LEADING):  # in every mixture of cases
        for word in map("".join, itertools.product(*({c, c.upper()} if len(c.upper()) == 1 else {c} for c in cue))):
            a.add_word(word, cue)
    a.make_automaton()
    return a


_HELD: list[ahocorasick.Automaton] = []


def anchors() -> ahocorasick.Automaton:
    if not _HELD:
        _HELD.append(_automaton())
    return _HELD[0]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _iban(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and v[:2].isalpha() and v[2:4].isdigit() and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _street(word: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The postal address around a street word, by its house number."""
    if end < len(text) and text[end].isalnum():
        return None
    if word in STREETS:
        before = HOUSE_BEFORE.search(text, max(0, start - AROUND), start)
        return (before.start(1), UNIT.match(text, end).end()) if before and text[start].isupper() else None
    if word in LEADING:
        name = STREET_NAME.match(text, end)
        if not name or start and text[start - 1].isalnum():
            return None
        before, after = NUMBER_BEFORE.search(text, max(0, start - AROUND), start), NUMBER_AFTER.match(text, name.end())
        return (before.start(1) if before else start, after.end() if after else name.end()) if before or after else None
    least = max(0, start - AROUND)
    while start > least and (text[start - 1].isalpha() or text[start - 1] == "-"):  # the first part of the word
        start -= 1
    after = HOUSE_AFTER.match(text, end)
    return (start, after.end()) if after and text[start].isupper() else None


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text (kind, start, end), in code points, by kind as listed and then start."""
    if not text:
        return []
    free = dict.fromkeys(KINDS, 0)  # where the next match of a kind may begin
    out: list[tuple[str, int, int]] = []
    run = 0  # end of the run of digits and dots last looked at
    for last, word in anchors().iter(text):
        at = last - len(word) + 1
        if word in DIGITS:
            if at >= free["card"] and (m := CARD.match(text, at)):
                free["card"] = m.end()
                d = re.sub("[ -]", "", m.group())
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append(("card", at, m.end()))
                elif len(d) > 19:
                    out += [("account", *n.span()) for n in NUMBER.finditer(text, at, m.end()) if luhn(n.group())]
            if at >= run:
                # the longest stretch of digits and dots from here: matches cannot leave it
                run = at + 1
                while run < len(text) and (text[run] == "." or "0" <= text[run] <= "9"):
                    run += 1
                if run - at >= 7:
                    for m in IP.finditer(text, at, run):
                        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
                            out.append(("ip", *m.span()))
        elif word == "@":
            start = at
            while start > free["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                free["email"] = m.end()
                out.append(("email", start, m.end()))
        elif word == "+":
            if at >= free["phone"] and (m := PHONE.match(text, at)):
                free["phone"] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append(("phone", at, m.end()))
        elif word == "://":
            start = at
            while start > free["url"] and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            m = URL.match(text, last + 1)
            if start < at and m:
                free["url"] = m.end()
                if "@" in m.group() or "?" in m.group():
                    out.append(("url", start, m.end()))
        elif word in PLACES:
            if at >= free["address"] and (found := _street(word, text, at, last + 1)):
                free["address"] = found[1]
                out.append(("address", *found))
        elif at >= free["account"] and not (at and text[at - 1].isalnum()) and (m := ACCOUNT.match(text, last + 1)):
            free["account"] = m.end()
            value = m.group(1)
            if sum(c.isdigit() for c in value) >= 6 and (word.lower() != "iban" or _iban(value)):
                out.append(("account", m.start(1), m.end()))
    out.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return out


def personal_spans(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the id and all spans."""
    kind = docs.schema[id].dataType.simpleString()
    (spans,) = beside(id, "spans")
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(x.as_py())] for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, type=arrow)], names=[id, spans])

    return batched(docs).select(col(id).alias("k"), col(text).alias("t")).mapInArrow(run, f"{column(id, kind)}, {spans} array<struct<kind:string,start:bigint,end:bigint>>")


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(said(F.filter("spans", lambda x: x["kind"].isin(*KINDS[:4]))), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"), *[count(k).alias(f"n_{k}") for k in KINDS[4:]], F.size("spans").cast("long").alias("n_total"),
    )


QUERIES = {"op4_pii_anchors": op4_pii_anchors}
SQL: dict[str, str] = {}
