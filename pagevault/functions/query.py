"""The query language: bare words, "phrases", site:, after:, before:, -word."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone, tzinfo

from pagevault.functions.rules import normalise
from pagevault.functions.text import fold_term

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return [fold_term(w) for w in _WORD.findall(text)]


@dataclass(frozen=True)
class Query:
    terms: tuple[str, ...] = ()
    phrases: tuple[tuple[str, ...], ...] = ()
    exclude: tuple[str, ...] = ()
    site: str | None = None
    after: int | None = None
    before: int | None = None

    @property
    def lookup(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.terms, *(w for p in self.phrases for w in p)]))

    @property
    def empty(self) -> bool:
        return not self.lookup


def _ms(d: datetime) -> int:
    return round(d.timestamp() * 1000)


def parse_when(value: str, now: int, tz: tzinfo = timezone.utc) -> int | None:
    """A year from 1970, a day or month at local midnight, days ago (never before 1970), or any ISO date; else None."""
    if re.fullmatch(r"\d{4}", value, re.ASCII) and int(value) >= 1970:
        return _ms(datetime(int(value), 1, 1, tzinfo=tz))
    if re.fullmatch(r"\d+", value, re.ASCII):
        return max(0, now - int(value) * 86_400_000)
    try:
        if m := re.fullmatch(r"(\d{4})-(\d{1,2})(?:-(\d{1,2}))?", value, re.ASCII):
            return _ms(datetime(int(m[1]), int(m[2]), int(m[3] or 1), tzinfo=tz))
        d = datetime.fromisoformat(value)
        return _ms(d if d.tzinfo else d.replace(tzinfo=tz))
    except ValueError:
        return None


def parse(text: str | None, now: int, tz: tzinfo = timezone.utc) -> Query:
    """The last of several site:, after: or before: counts; a minus before a phrase is ignored."""
    phrases = [tuple(words(p)) for p in re.findall(r'"([^"]+)"', text or "")]
    bare: list[str] = []
    out: list[str] = []
    found: dict = {}
    for token in re.sub(r'"[^"]+"', " ", text or "").split():
        name, _, value = token.partition(":")
        if _ and name.lower() == "site":
            found["site"] = normalise(value).split("/")[0] or None
        elif _ and name.lower() in ("after", "before"):
            found[name.lower()] = parse_when(value, now, tz)
        elif token[0] == "-" and len(token) > 1:
            out += words(token)
        else:
            bare += words(token)
    return Query(tuple(bare), tuple(p for p in phrases if p), tuple(dict.fromkeys(out)), **found)
