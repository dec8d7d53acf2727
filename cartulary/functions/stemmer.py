"""English stems by the published Snowball ("Porter 2") rules, and the words that searching passes over."""

from __future__ import annotations

import re
from functools import lru_cache

#: The usual English stop words.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Words with stems of their own, and words that are done after the first step.
OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
DONE = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
#: Endings of the second, third and fourth step and what stands for them.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful",
    "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

VOWEL = "aeiouy"
_REGION = re.compile(f"[{VOWEL}][^{VOWEL}]")
_SHORT = re.compile(f"(?:^|[^{VOWEL}])[{VOWEL}][^{VOWEL}wxY]$")
_SHORT_START = re.compile(f"^[{VOWEL}][^{VOWEL}]$")


def _after(word: str, start: int) -> int:
    """Where the region behind the first consonant that follows a vowel begins."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ending(word: str, endings) -> str:
    """The longest of the endings that a word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _is_short(word: str) -> bool:
    return bool(_SHORT.search(word) or _SHORT_START.search(word))


def _has_vowel(part: str) -> bool:
    return any(c in VOWEL for c in part)


def stem(word: str) -> str:
    """The stem of a word in small letters."""
    if word in OWN:
        return OWN[word]
    if len(word) <= 2:
        return word
    w = ""
    for c in word.removeprefix("'"):
        w += "Y" if c == "y" and (not w or w[-1] in VOWEL) else c  # as a consonant
    start = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    one = _after(w, 0) if start is None else start
    two = _after(w, one)
    w = w.removesuffix(_ending(w, ("'", "'s", "'s'")))

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in DONE:
        return w

    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= one:
            w = w.removesuffix(end) + "ee"
    elif end and _has_vowel(w.removesuffix(end)):
        w = w.removesuffix(end)
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _is_short(w) and one >= len(w):
            w += "e"

    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"

    end = _ending(w, SECOND)
    if end and len(w) - len(end) >= one:
        before = w.removesuffix(end)
        if not (end == "ogi" and not before.endswith("l") or end == "li" and (not before or before[-1] not in "cdeghkmnrt")):
            w = before + SECOND[end]

    end = _ending(w, THIRD)
    if end and len(w) - len(end) >= (two if end == "ative" else one):
        w = w.removesuffix(end) + THIRD[end]

    end = _ending(w, FOURTH)
    if end and len(w) - len(end) >= two and (end != "ion" or w[-4] in "st"):
        w = w.removesuffix(end)

    if w.endswith("e") and (len(w) > two or len(w) > one and not _is_short(w[:-1])) or w.endswith("ll") and len(w) > two:
        w = w[:-1]
    return w.replace("Y", "y")


@lru_cache(maxsize=200_000)
def lexeme(word: str) -> str | None:
    """What a word in small letters is searched by; none for a stop word, itself for one with digits."""
    if any(map(str.isdigit, word)):
        return word
    return None if word in STOP_WORDS else stem(word)
