"""Words as search knows them: lower case, without diacritics, stemmed by Porter's published rules (1980).

A small helper for tasks: `terms` cuts a text, `stem` is remembered for each word.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Endings and what takes their place, by step.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: A consonant, a vowel, runs of each (y is a vowel after a consonant), and the measures built of them.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
MEASURE = {"above0": rf"^(?:{_C})?{_V}{_C}", "is1": rf"^(?:{_C})?{_V}{_C}(?:{_V})?$", "above1": rf"^(?:{_C})?{_V}{_C}{_V}{_C}"}
VOWEL = rf"^(?:{_C})?[aeiouy]"
#: Consonants, vowel, consonant other than w, x and y: a stem of one syllable.  A letter beyond ASCII counts as two.
SHORT = rf"^{_C}[aeiouy][^aeiouwxy\x80-\U0010ffff]$"
LONGEST = 64
_TESTS = {k: re.compile(p) for k, p in {**MEASURE, "vowel": VOWEL, "short": SHORT}.items()}


def _ends(word: str, rules, test: str) -> str:
    """The longest ending of the rules decides, whether or not its stem passes."""
    for end, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(end):
            head = word[: -len(end)]
            return head + new if _TESTS[test].search(head) else word
    return word


@lru_cache(1 << 20)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two bytes, or of more than LONGEST, stay."""
    if not 2 < len(word.encode()) <= LONGEST:
        return word
    has = lambda test, w: _TESTS[test].search(w) is not None
    lead = word[0] == "y"  # a consonant there
    w = "Y" + word[1:] if lead else word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) and w not in ("sses", "ies") else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed") and w != "eed":
        w = w[:-1] if has("above0", w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has("vowel", w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif re.search(r"([^aeioulsz])\1$", w.lower()):
                    w = w[:-1]
                elif has("short", w):
                    w += "e"
                break
    if w.endswith("y") and has("vowel", w[:-1]):
        w = w[:-1] + "i"
    w = _ends(_ends(w, STEP2, "above0"), STEP3, "above0")
    ending = next((e for e in sorted((*STEP4, "ion"), key=len, reverse=True) if w.endswith(e)), None)
    if ending and has("above1", w[: -len(ending)]) and (ending != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(ending)]
    if w.endswith("e") and (has("above1", w[:-1]) or has("is1", w[:-1]) and not has("short", w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and has("above1", w):
        w = w[:-1]
    return "y" + w[1:] if lead else w


class _Folds(dict):
    """Letters to what they are without marks: a-z for accented ones, nothing for marks of their own."""

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFD", chr(code))
        plain = parts[0] if len(parts) > 1 and parts[0].isascii() and parts[0].isalpha() else chr(code)
        self[code] = "" if 768 <= code <= 817 else plain
        return self[code]


_FOLDS = _Folds()
_TOKEN = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case, without diacritics."""
    small = text.lower()
    return _TOKEN.findall(small if small.isascii() else small.translate(_FOLDS))


def terms(text: str) -> list[str]:
    return [stem(w) for w in words(text)]


class Numbers(dict):
    """Words to the numbers of their stems, given out as they come; `stems` has the stems by number."""

    def __init__(self):
        self.stems: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        self[word] = self.stems.setdefault(stem(word), len(self.stems))
        return self[word]
