"""English stems and stop words for full text: the published Porter2 rules as tables, applied to single words."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Words that full text leaves out.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
    its itself they them their theirs themselves what which who whom this that these those am is are was were be been being
    have has had having do does did doing a an the and but if or because as until while of at by for with about against
    between into through during before after above below to from up down in out on off over under again further then once
    here there when where why how all any both each few more most other some such no nor not only own same so than too very
    s t can will just don should now""".split()
)
#: Words with a stem of their own, words that stay, and those that stay after the first step.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
FIXED = frozenset("sky news howe atlas cosmos bias andes".split())
LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Beginnings whose end begins the first region.
HEADS = re.compile("^(gener|commun|arsen)")
#: Endings of the second and third step with what takes their place, and those that the fourth drops.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")
BEFORE = {"ogi": "l", "li": "cdeghkmnrt", "ion": "st"}

VOWEL = "[aeiouy]"
SHORT = re.compile(rf"(?:^{VOWEL}[^aeiouy]|[^aeiouy]{VOWEL}[^aeiouywxY])$")
DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _region(word: str, start: int) -> int:
    """Place after the first consonant that follows a vowel, from start on."""
    m = re.compile(rf"{VOWEL}[^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _ending(word: str, endings: dict[str, str]) -> str | None:
    """The longest of the endings that the word has."""
    return next((word[-n:] for n in range(min(7, len(word)), 0, -1) if word[-n:] in endings), None)


def _replaced(word: str, endings: dict[str, str], region: int) -> str:
    end = _ending(word, endings)
    if end is None or len(word) - len(end) < region:
        return word
    if end in BEFORE and not (len(word) > len(end) and word[-len(end) - 1] in BEFORE[end]):
        return word
    return word[: len(word) - len(end)] + endings[end]


def _without_plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search(VOWEL, w[:-2]):
        return w[:-1]
    return w


def _without_tense(w: str, region: int) -> str:
    m = re.search("(eedly|eed)$", w)
    if m:
        return w[: m.start()] + "ee" if m.start() >= region else w
    m = re.search("(ingly|edly|ing|ed)$", w)
    if not m or not re.search(VOWEL, w[: m.start()]):
        return w
    w = w[: m.start()]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if DOUBLE.search(w):
        return w[:-1]
    return w + "e" if SHORT.search(w) and region >= len(w) else w


@lru_cache(100_000)
def stem(word: str) -> str:
    """Stem of a word in lower case; words of other letters than a-z are their own."""
    if len(word) < 3 or word in FIXED or not word.isascii() or not word.isalpha():
        return word
    if word in OWN:
        return OWN[word]
    w = re.sub(f"(?<={VOWEL})y", "Y", re.sub("^y", "Y", word))
    head = HEADS.match(w)
    one = head.end() if head else _region(w, 0)
    two = _region(w, one)
    w = _without_plural(w)
    if w in LATER:
        return w
    w = _without_tense(w, one)
    w = re.sub("(?<=.[^aeiouy])[yY]$", "i", w)
    w = _replaced(w, SECOND, one)
    end = _ending(w, THIRD)
    w = _replaced(w, THIRD, two if end == "ative" else one)
    w = _replaced(w, FOURTH, two)
    if w.endswith("e") and (len(w) > two or len(w) > one and not SHORT.search(w[:-1])) or w.endswith("ll") and len(w) > two:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(ArrayType(StringType()))
def english(words: pd.Series) -> pd.Series:
    """Stems of arrays of words in place; a stop word is an empty text, so that places stay."""
    return words.map(lambda ws: ["" if w in STOP else stem(w) for w in ws], na_action="ignore")
