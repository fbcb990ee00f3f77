"""Stop word lists of Spark, kept as data of this package and keyed by language code."""

from functools import cache
from importlib import resources

# Language codes and the names of their lists.
LIST_NAMES = {
    "da": "danish",
    "de": "german",
    "en": "english",
    "es": "spanish",
    "fi": "finnish",
    "fr": "french",
    "hu": "hungarian",
    "it": "italian",
    "nl": "dutch",
    "no": "norwegian",
    "pt": "portuguese",
    "ru": "russian",
    "sv": "swedish",
    "tr": "turkish",
}
STRICT_CODES = ("en", "tr")


@cache
def _bundled(name: str) -> tuple[str, ...]:
    text = resources.files("wordloom.functions").joinpath("stopword_lists", f"{name}.txt").read_text(encoding="utf-8")
    return tuple(text.splitlines())


def stopword_lists(codes=None, strict: bool = False) -> dict[str, tuple[str, ...]]:
    """Lists by code. ``strict`` keeps codes for English and Turkish only, and the list names themselves."""
    if strict:
        by_code = {code: LIST_NAMES[code] for code in STRICT_CODES}
        named = {name: name for name in LIST_NAMES.values()}
        names = {**by_code, **named}
    else:
        names = LIST_NAMES
    return {code: _bundled(name) for code, name in names.items() if codes is None or code in codes}
