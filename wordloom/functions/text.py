"""Scalar text transforms. All of them are built-in expressions and fuse into one projection."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.constants import PUNCTUATION, SPECIAL_CHARS

# Unicode white space, plus the separator controls \x1c-\x1f and \x85.
SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"
# A run of two or more word characters: a vectorizer token.
TOKEN = r"([\p{L}\p{N}_]{2,})"
# Two or more letters between white space or the ends of a text.
_NO_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
VALID_WORD = rf"(?<!{_NO_SPACE})\p{{L}}{{2,}}(?!{_NO_SPACE})"


def without(c: Column, chars: str) -> Column:
    """Delete characters, in one pass that costs nothing for those that stay."""
    return F.regexp_replace(c, "[" + "".join(f"\\x{{{ord(x):x}}}" for x in sorted(set(chars))) + "]+", "")


def remove_punctuation(c: Column) -> Column:
    """Delete the 32 ASCII punctuation characters; ``a-b`` becomes ``ab``."""
    return without(c, PUNCTUATION)


def remove_special_chars(c: Column) -> Column:
    """Delete special characters, the letters æ, é and ß among them."""
    return without(c, SPECIAL_CHARS)


def to_lower(c: Column) -> Column:
    return F.lower(c)


def to_upper(c: Column) -> Column:
    return F.upper(c)


def words(c: Column) -> Column:
    """The words between white space, none of them empty."""
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def join_words(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def remove_stopwords(c: Column, lang: str | Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """Drop words whose lowercase is in the list of the row's language and rejoin with single spaces.

    ``lang`` is a code, or a column of codes. A language without a list loses no word.
    """

    def is_stopword(w: Column) -> Column:
        lowered = F.lower(w)
        if isinstance(lang, str):
            found = lists.get(lang)
            return lowered.isin(*found) if found else F.lit(False)
        rule = None
        for code, found in lists.items():
            if found:
                hit = lowered.isin(*found)
                rule = F.when(lang == code, hit) if rule is None else rule.when(lang == code, hit)
        return F.lit(False) if rule is None else rule.otherwise(F.lit(False))

    return join_words(F.filter(words(c), lambda w: ~is_stopword(w)))


def valid_words(c: Column) -> Column:
    """Words of two or more letters, as an array: numbers, mixed tokens and single letters are dropped."""
    return F.regexp_extract_all(c, F.lit(VALID_WORD), F.lit(0))


def tokens(c: Column) -> Column:
    """Vectorizer tokens: lowercase runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(1))


def is_blank(c: Column) -> Column:
    """True for null and for text of white space only."""
    return F.coalesce(F.regexp_replace(c, SPACES, "") == "", F.lit(True))
