"""Plain functions: folding, parser, stemmers, passages, rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagevault.functions import passages as P
from pagevault.functions.query import parse, parse_when
from pagevault.functions.rules import normalise
from pagevault.functions.stem import default_languages, stem
from pagevault.functions.text import fold_term, truncate_utf8
from pagevault.operators.retention import clock_hold, clock_problem

NOW = 1_706_745_600_000
DAY = 86_400_000


def test_fold():
    assert [fold_term(x) for x in ("Café", "STRASSE", "Straße", "Ñandú", "Άλφα")] == ["cafe", "strasse", "strasse", "nandu", "αλφα"]


@pytest.mark.parametrize(("lang", "words"), [
    ("en", {"running": "run", "organization": "organiz", "chart": "chart"}), ("de", {"hauser": "haus", "muenchen": "munch", "munchen": "munch"}), ("nl", {"huizen": "huis", "lopen": "loop"}),
])
def test_stems(lang, words):
    assert {w: stem(w, lang) for w in words} == words


@pytest.mark.parametrize(("lang", "family"), [
    ("es", "nacion naciones"), ("es", "corriendo corren correr"), ("es", "hablaban hablando"), ("pt", "informacao informacoes"), ("pt", "mudanca mudancas"), ("fr", "generalite generalites"),
    ("fr", "continuer continue continuee continuerons"), ("it", "parlare parlando parlato parlavano"), ("nl", "moeilijkheid moeilijk"),
])
def test_families(lang, family):
    assert len({stem(w, lang) for w in family.split()}) == 1


def test_stem_edges():
    assert stem("word", "xx") is None and stem("", "en") is None and stem(None, "en") is None
    assert default_languages(["de-AT", "xx", "de", "fr-FR"]) == ["de", "fr"] and default_languages([]) == ["en"]


@given(st.text(alphabet="abcdefghilmnoprstuvyz", min_size=1, max_size=14), st.sampled_from(["en", "de", "es", "pt", "fr", "it", "nl"]))
@settings(max_examples=400, deadline=None)
def test_stems_never_fail(word, lang):
    out = stem(word, lang)
    assert out is None or len(out) <= len(word) + 2


def test_parser():
    q = parse('"postings bucket" Search', NOW)
    assert (q.terms, q.phrases, q.lookup) == (("search",), (("postings", "bucket"),), ("search", "postings", "bucket"))
    assert parse("churn site:https://www.Example.com/page", NOW).site == "example.com"
    assert parse("retro -fatigue", NOW).exclude == ("fatigue",) and parse("retro - fatigue", NOW).terms == ("retro", "fatigue")
    assert parse('-"foo bar"', NOW).phrases == (("foo", "bar"),)
    assert parse("site:x after:30 -foo", NOW).empty and parse(None, NOW).empty
    assert parse("a after:2024", NOW).after == 1_704_067_200_000


def test_dates():
    assert parse_when("30", NOW) == NOW - 30 * DAY and parse_when("99999999999", NOW) == 0
    assert parse_when("2024-02-31", NOW) is None and parse_when("2024-02", NOW) == NOW and parse_when("soon", NOW) is None


@pytest.mark.parametrize(("raw", "rule"), [
    ("https://www.example.com/", "example.com"), ("WWW.Example.com", "example.com"), ("example.com:8080", "example.com"), ("example.com/private/", "example.com/private/*"), ("example.com/*", "example.com"),
    ("https://user@mail.example.com./a?b#c", "mail.example.com/a"), ("webmail.*", "webmail.*"), ("@private-network", "@private-network"), ("", ""), ("*.example.com", "*.example.com"),
])
def test_rules(raw, rule):
    assert normalise(raw) == rule


def test_snippet():
    text = "First sentence here. " + "filler " * 60 + "then the retro fatigue sets in when nothing changes. After that. " + "more " * 80
    shown, ranges = P.snippet(text, ["retro", "fatigue"])
    assert [shown[a:b] for a, b in ranges] == ["retro", "fatigue"] and shown.startswith("…") and len(shown) <= 262
    assert P.snippet("", ["a"]) == ("", []) and P.snippet(None, ["a"]) == ("", [])
    assert P.snippet("x" * 300, ["a"]) == ("x" * 260 + "…", [])
    assert P.marked("a <b>", [(2, 5)]) == "a <mark>&lt;b&gt;</mark>"


@given(st.text(alphabet="ab. \n", max_size=600))
@settings(max_examples=200, deadline=None)
def test_snippet_ranges_hold(text):
    shown, ranges = P.snippet(text, ["ab", "a"])
    assert all(shown[a:b] in ("ab", "a") for a, b in ranges)


def test_quotes():
    page = "One two  three\nfour five six. Seven."
    assert P.locate(page, "four five") == (15, 24, "exact")
    assert P.locate(page, "TWO three Four") == (4, 19, "loose")
    assert P.locate(page, "two three four five eight")[2] == "partial"
    assert P.locate(page, "nothing like this at all") is None and P.locate("", "a") is None


def test_phrases():
    assert P.phrase("…lead in words here now. Next one", [(1, 5)]) == "lead in words here now"
    assert P.phrase("two words") is None and P.phrase(None) is None


def test_truncate():
    assert truncate_utf8("aé", 2) == "a" and truncate_utf8("aé", 3) == "aé" and truncate_utf8(None, 3) is None


def test_clock():
    assert clock_problem(NOW, None) is None and clock_problem(NOW, NOW - 8 * DAY) and clock_problem(NOW, NOW + 2 * 3_600_000)
    problem, until = clock_hold(NOW, NOW - 8 * DAY)
    assert problem and until == NOW + DAY
    assert clock_hold(NOW + 3_600_000, NOW, until, problem)[0] == problem and clock_hold(NOW, NOW, NOW + 5 * DAY) == (None, 0)


def test_fnv_hashes():
    """Many texts at once get the hashes that each has by itself, unit by unit."""
    from pagevault.functions.text import SEEDS, fnv_hashes

    def alone(text):
        units, out = text.encode("utf-16-le", "surrogatepass"), ""
        for h in SEEDS:
            for k in range(0, len(units), 2):
                h = (h ^ int.from_bytes(units[k : k + 2], "little")) * 0x01000193 % 2**32
            out += f"{h:08x}"
        return out

    texts = ["", "a", "soup", "\U0001f600 \u00e9", "", "x" * 1000, "\uffff\U0010ffff", "soup"]
    assert fnv_hashes(texts) == [alone(t) for t in texts] and fnv_hashes([]) == []
