"""The published English Snowball stemmer (Porter2)."""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
#: Whole words with a stem of their own (fixed values of the published algorithm).
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
#: Words that stay as they are after step 1a (fixed values of the published algorithm).
INVARIANT_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Beginnings that set the first region (fixed values of the published algorithm).
REGION_PREFIXES = ("gener", "commun", "arsen")
STEP2 = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"),
    ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", ""), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")

_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    first = next((len(p) for p in REGION_PREFIXES if word.startswith(p)), None)
    if first is None:
        m = _REGION.search(word)
        first = m.end() if m else len(word)
    m = _REGION.search(word, first)
    return first, m.end() if m else len(word)


def _short_syllable(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS and word[-1] not in "wxY"


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of at most two bytes stay as they are."""
    if len(word.encode()) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = word.removeprefix("'")
    # A y at the start or behind a vowel is a consonant, written Y.
    letters = list(word)
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or letters[i - 1] in VOWELS):
            letters[i] = "Y"
    word = "".join(letters)
    r1, r2 = _regions(word)

    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in INVARIANT_1A:
        return word

    if word.endswith(("eed", "eedly")):
        cut = 5 if word.endswith("eedly") else 3
        if len(word) - cut >= r1:
            word = word[:-cut] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if word.endswith(e)), None)
        if end and _has_vowel(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(DOUBLES):
                word = word[:-1]
            elif _short_syllable(word) and r1 >= len(word):
                word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    for end, to in STEP2:
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                before = word[: -len(end)]
                if end == "ogi":
                    word = before + to if before.endswith("l") else word
                elif end == "li":
                    word = before if before[-1:] and before[-1] in LI_ENDINGS else word
                else:
                    word = before + to
            break
    for end, to in STEP3:
        if word.endswith(end):
            if len(word) - len(end) >= (r2 if end == "ative" else r1):
                word = word[: -len(end)] + to
            break
    for end in STEP4:
        if word.endswith(end):
            if len(word) - len(end) >= r2 and (end != "ion" or word[:-3].endswith(("s", "t"))):
                word = word[: -len(end)]
            break
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_syllable(word[:-1]))) or word.endswith("l") and len(word) - 1 >= r2 and word[-2:-1] == "l":
        word = word[:-1]
    return word.replace("Y", "y")
