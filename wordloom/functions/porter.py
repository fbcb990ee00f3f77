"""Porter's suffix stripping (Program 14(3), 1980).

A task stems every different word once and puts the stems in place in Arrow, so a whole text is stemmed inside its row: no
explode, no shuffle, and no word that becomes a hot key. Words of one or two letters stay as they are, as in the author's own program.

The extended form adds what a widely used toolkit adds by default: a list of irregular words, ``-ies`` and ``-ied``
in words of four letters, ``-y`` only after a consonant, and a few more suffixes of step 2.

``y`` is a consonant at the start of a word and after a vowel, a vowel after a consonant. The patterns below
follow that rule letter by letter and use neither lookaround nor backreferences, so that other SQL engines can
run them too.
"""

import re
from collections.abc import Callable

from pyspark.sql import Column

from wordloom.functions.batches import text_by_word
from wordloom.functions.text import valid_words

_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"
_HEAD = f"^(?:{_C}{_V}|[aeiou]+)"

# Measure m of a stem: the number of vowel-consonant turns.
M_OVER_0 = f"{_HEAD}[^aeiou]"
M_OVER_1 = f"{_HEAD}{_C}{_V}[^aeiou]"
M_IS_1 = f"{_HEAD}{_C}(?:{_V})?$"
HAS_VOWEL = "[aeiou]|[^aeiou]y"
# Ends consonant-vowel-consonant, the last one not w, x or y.
ENDS_CVC = "(?:[^aeiouy][aeiouy]|^y[aeiouy]|[aeiou]y[aeiouy]|[^aeiouy]yy[aeiouy])[^aeiouwxy]$"

# The suffix tables of steps 2, 3 and 4 of the published algorithm.
STEP_2 = [
    ("ational", "ate"),
    ("tional", "tion"),
    ("enci", "ence"),
    ("anci", "ance"),
    ("izer", "ize"),
    ("abli", "able"),
    ("alli", "al"),
    ("entli", "ent"),
    ("eli", "e"),
    ("ousli", "ous"),
    ("ization", "ize"),
    ("ation", "ate"),
    ("ator", "ate"),
    ("alism", "al"),
    ("iveness", "ive"),
    ("fulness", "ful"),
    ("ousness", "ous"),
    ("aliti", "al"),
    ("iviti", "ive"),
    ("biliti", "ble"),
]
STEP_3 = [
    ("icate", "ic"),
    ("ative", ""),
    ("alize", "al"),
    ("iciti", "ic"),
    ("ical", "ic"),
    ("ful", ""),
    ("ness", ""),
]
STEP_4 = [
    "al",
    "ance",
    "ence",
    "er",
    "ic",
    "able",
    "ible",
    "ant",
    "ement",
    "ment",
    "ent",
    "ion",
    "ou",
    "ism",
    "ate",
    "iti",
    "ous",
    "ive",
    "ize",
]

# What the extended form changes. In step 2, -bli takes the place of -abli.
IRREGULAR = {
    "sky": ["sky", "skies"],
    "die": ["dying"],
    "lie": ["lying"],
    "tie": ["tying"],
    "news": ["news"],
    "inning": ["innings", "inning"],
    "outing": ["outings", "outing"],
    "canning": ["cannings", "canning"],
    "howe": ["howe"],
    "proceed": ["proceed"],
    "exceed": ["exceed"],
    "succeed": ["succeed"],
}
_BASES = {form: base for base, forms in IRREGULAR.items() for form in forms}
EXTENDED_STEP_2 = [rule for rule in STEP_2 if rule[0] != "abli"] + [("bli", "ble"), ("fulli", "ful")]
ENDS_CVC_OR_IS_VC = f"(?:{ENDS_CVC})|^[aeiou][^aeiou]$"
ENDS_CONSONANT = "[^aeiouy]$|[aeiou]y$"


def longest_first(rules: list) -> list:
    return sorted(rules, key=lambda rule: -len(rule[0]))


def _has(pattern: str) -> Callable[[str], object]:
    return re.compile(pattern).search


_more_than_0, _more_than_1, _is_1, _has_vowel = map(_has, (M_OVER_0, M_OVER_1, M_IS_1, HAS_VOWEL))
_cvc, _cvc_or_is_vc, _ends_consonant = map(_has, (ENDS_CVC, ENDS_CVC_OR_IS_VC, ENDS_CONSONANT))
_undoubled = _has("[^aeiouylsz]$")


def _replace_suffix(w: str, rules: list, measure) -> str:
    """The longest suffix that fits decides; it is replaced when the stem before it satisfies ``measure``."""
    for suffix, replacement in longest_first(rules):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + replacement if measure(stem) else w
    return w


def _step_1a(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _extended_1a(w: str) -> str:
    return w[:-1] if w.endswith("ies") and len(w) == 4 else _step_1a(w)


def _tidy(w: str, cvc) -> str:
    """After -ed or -ing went: restore an e, or undo a doubled consonant."""
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if _undoubled(w) and w[-2:] == w[-1] * 2:
        return w[:-1]
    return w + "e" if _is_1(w) and cvc(w) else w


def _step_1b(w: str, cvc=_cvc) -> str:
    if w.endswith("eed"):
        return w[:-1] if _more_than_0(w[:-3]) else w
    if w.endswith("ed") and _has_vowel(w[:-2]):
        return _tidy(w[:-2], cvc)
    if w.endswith("ing") and _has_vowel(w[:-3]):
        return _tidy(w[:-3], cvc)
    return w


def _extended_1b(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    return _step_1b(w, _cvc_or_is_vc)


def _step_1c(w: str) -> str:
    return w[:-1] + "i" if w.endswith("y") and _has_vowel(w[:-1]) else w


def _extended_1c(w: str) -> str:
    return w[:-1] + "i" if w.endswith("y") and len(w) > 2 and _ends_consonant(w[:-1]) else w


def _extended_2_alli(w: str) -> str:
    """-alli becomes -al first, and the rest of step 2 sees the result."""
    return w[:-2] if w.endswith("alli") and _more_than_0(w[:-4]) else w


def _extended_2(w: str) -> str:
    if w.endswith("logi"):
        return w[:-1] if _more_than_0(w[:-3]) else w
    return _replace_suffix(w, EXTENDED_STEP_2, _more_than_0)


def _step_4(w: str) -> str:
    for suffix in sorted(STEP_4, key=lambda s: -len(s)):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem if _more_than_1(stem) and (suffix != "ion" or stem.endswith(("s", "t"))) else w
    return w


def _step_5a(w: str, cvc=_cvc) -> str:
    stem = w[:-1]
    return stem if w.endswith("e") and (_more_than_1(stem) or (_is_1(stem) and not cvc(stem))) else w


def _step_5b(w: str) -> str:
    return w[:-1] if w.endswith("ll") and _more_than_1(w[:-1]) else w


PAPER_STEPS = (
    lambda w: _step_1a(w),
    lambda w: _step_1b(w),
    lambda w: _step_1c(w),
    lambda w: _replace_suffix(w, STEP_2, _more_than_0),
    lambda w: _replace_suffix(w, STEP_3, _more_than_0),
    lambda w: _step_4(w),
    lambda w: _step_5a(w),
    lambda w: _step_5b(w),
)
EXTENDED_STEPS = (
    lambda w: _extended_1a(w),
    lambda w: _extended_1b(w),
    lambda w: _extended_1c(w),
    lambda w: _extended_2_alli(w),
    lambda w: _extended_2(w),
    lambda w: _replace_suffix(w, STEP_3, _more_than_0),
    lambda w: _step_4(w),
    lambda w: _step_5a(w, _cvc_or_is_vc),
    lambda w: _step_5b(w),
)


def stem_word(word: str, extended: bool = False) -> str:
    """The stem of one word, in lowercase."""
    w = word.lower()
    if len(w) <= 2:
        return w
    if extended and w in _BASES:
        return _BASES[w]
    for step in EXTENDED_STEPS if extended else PAPER_STEPS:
        w = step(w)
    return w


def stem_text(c: Column, extended: bool = False) -> Column:
    """Stems of the valid words of a text, joined with single spaces."""
    return text_by_word(valid_words(c), lambda w: stem_word(w, extended))
