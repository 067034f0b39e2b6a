"""Suffix stemmers for folded words (no accents, lower case), after the published Snowball algorithms.

Each language is data: endings with what replaces them and the region they must
lie in, tried longest first.  Regions: R1 begins after the first consonant that
follows a vowel, R2 is R1 taken again inside R1, RV is the Romance languages'
verb region.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

VOWELS = {"en": "aeiouy", "de": "aeiouy", "es": "aeiou", "pt": "aeiou", "fr": "aeiouy", "it": "aeiou", "nl": "aeiouy"}
LANGUAGES = tuple(VOWELS)


def regions(word: str, vowels: str) -> tuple[int, int]:
    """Starts of R1 and R2."""
    cut = re.compile(f"[{vowels}][^{vowels}]")
    first = cut.search(word)
    r1 = first.end() if first else len(word)
    second = cut.search(word, r1)
    return r1, second.end() if second else len(word)


def romance(word: str, vowels: str) -> int:
    """Start of RV."""
    if len(word) < 3:
        return len(word)
    if word[1] not in vowels:
        at = next((i for i in range(2, len(word)) if word[i] in vowels), len(word))
        return min(len(word), at + 1)
    if word[0] in vowels:
        at = next((i for i in range(2, len(word)) if word[i] not in vowels), len(word))
        return min(len(word), at + 1)
    return 3


def longest(word: str, endings: Iterable[str], start: int = 0) -> str | None:
    """The longest ending of the word that lies from ``start`` on."""
    found = [e for e in endings if word.endswith(e) and len(word) - len(e) >= start]
    return max(found, key=len, default=None)


def swap(word: str, table: dict[str, str], start: int = 0) -> str:
    """The longest ending of the table replaced, if it lies in the region; shorter ones are not tried instead."""
    e = longest(word, table)
    return word[: -len(e)] + table[e] if e and len(word) - len(e) >= start else word


# --- English -------------------------------------------------------------------------------------

_EN_WHOLE = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_EN_KEEP = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_EN_HEADS = ("gener", "commun", "arsen", "past", "univers", "later", "emerg", "organ", "inter")
_EN_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_EN_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_EN_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
_EN_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", w)) or w == "past"


def english(w: str) -> str:
    if len(w) <= 2 or w in _EN_KEEP:
        return w
    if w in _EN_WHOLE:
        return _EN_WHOLE[w]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    head = next((h for h in _EN_HEADS if w.startswith(h)), None)
    r1, r2 = regions(w, "aeiouy")
    if head:
        r1 = len(head)
        m = re.compile("[aeiouy][^aeiouy]").search(w, r1)
        r2 = m.end() if m else len(w)
    vowel = lambda s: re.search("[aeiouy]", s) is not None
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and vowel(w[:-2]):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    # past and progressive
    e = longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and vowel(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_EN_DOUBLE):
            if not (len(w) == 3 and w[0] in "aeo"):
                w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # derivations
    e = longest(w, (*_EN_2, "ogi", "li"))
    if e and len(w) - len(e) >= r1:
        if e == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif e == "li":
            w = w[:-2] if w[-3:-2] in tuple("cdeghkmnrt") else w
        else:
            w = w[: -len(e)] + _EN_2[e]
    e = longest(w, (*_EN_3, "ative"))
    if e and len(w) - len(e) >= r1:
        w = w[:-5] if e == "ative" and len(w) - 5 >= r2 else w if e == "ative" else w[: -len(e)] + _EN_3[e]
    e = longest(w, (*_EN_4, "ion"))
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# --- German --------------------------------------------------------------------------------------


def german(w: str) -> str:
    w = re.sub(r"(?<=[aeiouy])([uy])(?=[aeiouy])", lambda m: m[1].upper(), w)
    w = re.sub(r"(?<!q)ue", "u", w.replace("ae", "a").replace("oe", "o"))
    r1, r2 = regions(w, "aeiouy")
    r1 = max(r1, 3)
    e = longest(w, ("em", "ern", "er", "e", "en", "es", "erinnen", "erin", "ln", "lns", "s"), r1)
    if e in ("em", "ern", "er", "erinnen", "erin"):
        w = w[: -len(e)] + ("er" if e.startswith("erin") else "")
    elif e in ("e", "en", "es"):
        w = w[: -len(e)]
        w = w[:-1] if w.endswith("niss") else w
    elif e in ("ln", "lns"):
        w = w[: -len(e)] + "l"
    elif e == "s" and w[-2] in "bdfghklmnrt":
        w = w[:-1]
    e = longest(w, ("en", "er", "est", "st", "et"), r1)
    if e in ("en", "er", "est") or (e == "st" and len(w) >= 6 and w[-3] in "bdfghklmnt") or (e == "et" and w[-3:-2] in tuple("dfghklmnrstuUz") and not w.endswith(("geordnet", "intern", "tick", "plan", "pr"))):
        w = w[: -len(e)]
    e = longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"), r2)
    if e in ("end", "ung"):
        w = w[: -len(e)]
        if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
            w = w[:-2]
    elif e in ("ig", "ik", "isch"):
        w = w if w[-len(e) - 1] == "e" else w[: -len(e)]
    elif e in ("lich", "heit"):
        w = w[: -len(e)]
        if w.endswith(("er", "en")) and len(w) - 2 >= r1:
            w = w[:-2]
    elif e == "keit":
        w = w[:-4]
        f = longest(w, ("lich", "ig"), r2)
        w = w[: -len(f)] if f else w
    return w.lower()


# --- Spanish, Portuguese, Italian, French ----------------------------------------------------------


def _split(text: str) -> tuple[str, ...]:
    return tuple(text.split())


_ES_ONE = {
    **dict.fromkeys(_split("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"), ""),
    **dict.fromkeys(_split("adora ador acion adoras adores aciones ante antes ancia ancias"), ""), "logia": "log", "logias": "log", "ucion": "u", "uciones": "u", "encia": "ente", "encias": "ente",
    **dict.fromkeys(_split("amente mente idad idades iva ivo ivas ivos"), ""),
}
_ES_Y = _split("ya ye yan yen yeron yendo yo yas yes yais yamos")
_ES_VERB = _split(
    "arian arias aran arais ariais aras eran erais eriais erian erias eras iran irais iriais irian irias iras ara are aria era ere eria ira ire iria aban ado idos ada idas ado ido ida ados adas abas aba "
    "aramos ariamos aremos eremos iremos eriamos iriamos iendo ando ieran ieras iera iese iesen ieses iste ieron aron io ian ias ia abais iais ad ed id aste asteis isteis abamos iamos imos amos ase asen ases aseis asemos iesemos ieseis aramos ieramos ierais arais is as ar er ir an o a i"
)
_ES_EN = _split("en es eis emos")


def _tail(w: str, rv: int, table: dict[str, str], r1: int, r2: int, near: tuple[str, ...] = ()) -> str | None:
    """Standard suffix of a Romance word, or None if there is none in R2."""
    e = longest(w, table)
    if not e:
        return None
    start = r1 if e.endswith("amente") else r2
    if len(w) - len(e) < start:
        return None
    w = w[: -len(e)] + table[e]
    more = longest(w, near, r2) if near and not table[e] else None
    return w[: -len(more)] if more else w


def spanish(w: str) -> str:
    (r1, r2), rv = regions(w, "aeiou"), romance(w, "aeiou")
    p = longest(w, _split("me se sela selo selas selos la le lo las les los nos"))
    if p and (v := longest(w[: -len(p)], _split("iendo ando ar er ir yendo"))) and len(w) - len(p) - len(v) >= rv:
        w = w[: -len(p)]
    new = _tail(w, rv, _ES_ONE, r1, r2, _split("ativ iv ic os ad ante able ible abil at"))
    if new is None:
        e = longest(w, _ES_Y, rv)
        if e and w[: -len(e)].endswith("u"):
            new = w[: -len(e)]
        else:
            e = longest(w, (*_ES_VERB, *_ES_EN), rv)
            if e:
                new = w[: -len(e)]
                if e in _ES_EN and new.endswith("gu"):
                    new = new[:-1]
    w = new if new is not None else w
    e = longest(w, ("os", "a", "o", "i", "e"), rv)
    if e:
        w = w[: -len(e)]
        if e == "e" and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w


_PT_ONE = {
    **dict.fromkeys(_split("eza ezas ico ica icos icas ismo ismos avel ivel ista istas oso osa osos osas amento amentos imento imentos adora ador acao adoras adores acoes ante antes ancia"), ""),
    "logia": "log", "logias": "log", "ucao": "u", "ucoes": "u", "encia": "ente", "encias": "ente", **dict.fromkeys(_split("amente mente idade idades iva ivo ivas ivos"), ""),
}
_PT_VERB = _split(
    "ada ida ia aria eria iria ara era ira ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara era ira ar er ir as adas idas ias "
    "arias erias irias aras eras iras avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis ieis arieis erieis irieis areis ereis ireis asseis esseis isseis aveis ados idos amos iamos ariamos eriamos iriamos aramos eramos iramos avamos emos aremos eremos iremos assemos essemos issemos imos armos ermos irmos eu iu ou"
)


def portuguese(w: str) -> str:
    (r1, r2), rv = regions(w, "aeiou"), romance(w, "aeiou")
    done = _tail(w, rv, _PT_ONE, r1, r2, _split("ativ iv os ic ad ante avel ivel abil"))
    if done is None and (e := longest(w, _PT_VERB, rv)):
        done = w[: -len(e)]
    if done is not None:
        w = done
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    elif e := longest(w, ("os", "a", "i", "o"), rv):
        w = w[: -len(e)]
    # acao and acoes outside R2 still share a stem
    w = re.sub(r"(?<=.{3})c(ao|oes)$", "c", w) if len(w) > 5 else w
    if w.endswith("e") and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith(("gu", "ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    return w


_IT_ONE = {
    **dict.fromkeys(_split("anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti oso osi osa ose mente atrice atrici ante anti azione azioni atore atori"), ""),
    **dict.fromkeys(_split("logia logie"), "log"), **dict.fromkeys(_split("uzione uzioni usione usioni"), "u"), **dict.fromkeys(_split("enza enze"), "ente"),
    **dict.fromkeys(_split("amento amenti imento imenti amente ita ivo ivi iva ive"), ""),
}
_IT_VERB = _split(
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo era erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete ero erono essero ete eva evamo evano evate evi evo "
    "iamo iate immo ira irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete iro irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
)


def italian(w: str) -> str:
    (r1, r2), rv = regions(w, "aeiou"), romance(w, "aeiou")
    p = longest(w, _split("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene"))
    if p:
        v = longest(w[: -len(p)], ("ando", "endo", "ar", "er", "ir"))
        if v and len(w) - len(p) - len(v) >= rv:
            w = w[: -len(p)] + ("" if v in ("ando", "endo") else "e")
    done = _tail(w, rv, _IT_ONE, r1, r2, _split("ativ iv os ic abil at"))
    if done is None and (e := longest(w, _IT_VERB, rv)):
        done = w[: -len(e)]
    w = done if done is not None else w
    if w[-1:] in tuple("aeio") and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith("i") and len(w) - 1 >= rv:
            w = w[:-1]
    return w[:-1] if w.endswith(("ch", "gh")) and len(w) - 1 >= rv else w


_FR_ONE = {
    **dict.fromkeys(_split("ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations"), ""), **dict.fromkeys(_split("logie logies"), "log"),
    **dict.fromkeys(_split("usion ution usions utions"), "u"), **dict.fromkeys(_split("ence ences"), "ent"), **dict.fromkeys(_split("ite ites if ive ifs ives"), ""),
}
_FR_I = _split("imes it ites i ie Ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons")
_FR_VERB = _split("ions e ee ees es erent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez ames at ates a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions")


def french(w: str) -> str:
    v = "aeiouy"
    w = re.sub(f"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), re.sub("qu", "qU", w))
    (r1, r2), rv = regions(w, v), romance(w, v)
    if w.startswith(("par", "col", "tap")):
        rv = 3
    done, verb = None, True
    e = longest(w, (*_FR_ONE, "eaux", "aux", "ement", "ements", "amment", "emment", "ment", "ments", "euse", "euses", "issement", "issements"))
    if e:
        start = len(w) - len(e)
        if e == "eaux":
            done = w[:-1]
        elif e == "aux" and start >= r1:
            done = w[:-2] + "l"
        elif e in ("euse", "euses") and start >= r1:
            done = w[:start] + ("" if start >= r2 else "eux")
        elif e.startswith("issement") and start >= r1 and w[start - 1] not in v:
            done = w[:start]
        elif e in ("ement", "ements") and start >= rv:
            done = w[:start]
            more = longest(done, ("iv", "eus", "abl", "iqU"), r2)
            done = done[: -len(more)] if more else done
        elif e in ("amment", "emment") and start >= rv:
            w, done = w[:start] + ("ant" if e[0] == "a" else "ent"), None
        elif e in ("ment", "ments") and start - 1 >= rv and w[start - 1] in v:
            w = w[:start]
        elif e in _FR_ONE and start >= r2:
            done = w[:start] + _FR_ONE[e]
            more = longest(done, ("abil", "ativ", "iv", "ic", "at"), r2) if not _FR_ONE[e] else None
            done = done[: -len(more)] if more else done
            verb = False
    if done is None:
        e = longest(w, _FR_I, rv)
        if e and w[len(w) - len(e) - 1] not in v and len(w) - len(e) - 1 >= rv:
            done = w[: -len(e)]
        else:
            e = longest(w, _FR_VERB, rv)
            if e and (e != "ions" or len(w) - 4 >= r2):
                done = w[: -len(e)]
                if e[0] == "a" and done.endswith("e") and len(done) - 1 >= rv:
                    done = done[:-1]
            elif e := longest(w, ("eront", "erons"), rv):
                done = w[: -len(e)]
    if done is not None:
        w = done
        w = w[:-1] + "i" if w.endswith("Y") else w
    else:
        if w.endswith("s") and w[-2:-1] not in tuple("aiouès"):
            w = w[:-1]
        e = longest(w, ("ion", "ier", "iere", "Ier", "e"), rv)
        if e == "ion" and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
        elif e in ("ier", "iere", "Ier"):
            w = w[: -len(e)] + "i"
        elif e == "e":
            w = w[:-1]
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    # a folded final accent: continue, continuee and continuerons share a stem
    del verb
    return w.lower()


# --- Dutch ---------------------------------------------------------------------------------------


def _close(w: str) -> str:
    """A stem as it is spelt alone: long vowels doubled, double consonants single, voiced ends hardened."""
    if re.search(r"([bdfgklmnprst])\1$", w):
        return w[:-1]
    if m := re.search(r"(?<![aeiouy])([aeou])([bdfgklmnprstvz])$", w):
        w = w[:-1] + m[1] + m[2]
    return w[:-1] + {"v": "f", "z": "s"}[w[-1]] if w[-1:] in ("v", "z") else w


def dutch(w: str) -> str:
    r1, r2 = regions(w, "aeiouy")
    r1 = max(r1, 3)
    for e in ("heden", "heid", "heids"):
        if w.endswith(e) and len(w) - len(e) >= r1:
            return dutch(w[: -len(e)])
    for e in ("baarheid", "elijk", "lijke", "lijk", "ingen", "ing", "aar", "aars", "isch", "ische"):
        if e.startswith(("ing", "aar")) and w.endswith(e) and len(w) - len(e) >= r1:
            return _close(w[: -len(e)])
        if e in ("lijke", "ische") and w.endswith(e) and len(w) - len(e) >= 3:
            return w[:-1]
    for e in ("ende", "end", "en", "e"):
        if w.endswith(e) and len(w) - len(e) >= 2 and w[-len(e) - 1] not in "aeiouy" and len(w) - len(e) >= min(r1, 3):
            return _close(w[: -len(e)])
    if w.endswith("s") and len(w) - 1 >= r1 and w[-2] not in "aeiouysfjt":
        return w[:-1]
    return w


STEMMERS: dict[str, Callable[[str], str]] = {"en": english, "es": spanish, "pt": portuguese, "de": german, "fr": french, "it": italian, "nl": dutch}


@lru_cache(maxsize=1 << 16)
def stem(word: str | None, language: str | None) -> str | None:
    """The stem of a folded word; null for an unknown language or an empty result."""
    f = STEMMERS.get(language or "")
    return (f(word) or None) if f and word else None


def default_languages(tags: Iterable[str]) -> list[str]:
    """Supported base languages of BCP-47 tags, in order, once each; English if there are none."""
    bases = dict.fromkeys(str(t).split("-")[0].lower() for t in tags)
    return [b for b in bases if b in STEMMERS] or ["en"]
