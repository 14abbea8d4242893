"""Text rules as Column expressions.

Three normalisers exist side by side because error rates computed after
different ones are not comparable; every scored row carries the profile name.

``nfkc`` leaves the JVM only for rows that hold a character outside a range known
to be stable under NFKC; ``normalize_strict`` is Python's string methods, which go
over a text several times faster than regular expressions do.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes, written for java.util.regex so that they
# select the same characters as Unicode-aware ``\s`` and ``\w`` elsewhere.
# Plain ``\s`` misses the no-break spaces of French typography and plain ``\w``
# misses accented letters.
WS = r"\p{IsWhite_Space}\x1c-\x1f"
WORD = r"\p{L}\p{N}_"

_NOT_BLANK = f"[^{WS}]"
_INSIDE = rf"(?s)\A[{WS}]*+(.*[^{WS}])"

# What most characters are, asked first: Latin letters and spaces need no rule
# below, and a range is compared faster than a class is looked up.
_RARE = "[^a-z ]"


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space (``trim`` only knows U+0020)."""
    return F.regexp_extract(text, _INSIDE, 1)


def not_blank(text: Column) -> Column:
    """True when the text holds a visible character; null counts as blank."""
    return F.coalesce(text.rlike(_NOT_BLANK), F.lit(False))


def squeeze(text: Column) -> Column:
    """Collapse every run of white space to one space and strip the ends."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


@cache
def _is_dropped(character: str) -> bool:
    return not (character == "_" or character.isspace() or unicodedata.category(character)[0] in "LN")


_ASCII_DROPS = {cp: None for cp in range(128) if _is_dropped(chr(cp))}

# Most kinds of characters that are dropped by one pass over the text each.
_PASSES = 16


def strict_text(text: str) -> str:
    """``normalize_strict`` of one text."""
    kept = text.lower()
    if kept.isascii():
        return " ".join(kept.translate(_ASCII_DROPS).split())
    drops = [character for character in set(kept) if _is_dropped(character)]
    if len(drops) > _PASSES:
        kept = kept.translate(dict.fromkeys(map(ord, drops)))
    else:
        for character in drops:
            kept = kept.replace(character, "")
    return " ".join(kept.split())


@F.arrow_udf(StringType())
def _strict_texts(text: pa.Array) -> pa.Array:
    # Bytes that are no UTF-8 become U+FFFD, a symbol, as they do in the JVM.
    found = (strict_text(str(t.as_buffer(), "utf-8", "replace")) if t.is_valid else None for t in text)
    return pa.array(found, pa.string(), size=len(text))


def normalize_strict(text: Column, nfc: bool = False) -> Column:
    """Lower-case, drop everything but letters, digits, ``_`` and spaces, squeeze.

    Null becomes the empty string. Decomposed accents are dropped because a
    combining mark is not a word character; ``nfc=True`` composes them first.
    """
    return F.coalesce(_strict_texts(compose(text) if nfc else text), F.lit(""))


def normalize_eval(text: Column) -> Column:
    """Lower-case, drop category P, shorten runs of two or more spaces, strip.

    Symbols stay, underscores go, and a single line break stays a line break.
    """
    bare = F.regexp_replace(F.lower(text), r"\p{P}", "")
    return strip(F.regexp_replace(bare, f"[{WS}]{{2,}}", " "))


def normalize_basic(text: Column) -> Column:
    """Lower-case, drop bracketed remarks, NFKC, marks/symbols/punctuation to spaces, squeeze."""
    spoken = F.regexp_replace(F.lower(text), r"[<\[][^>\]]*[>\]]", "")
    spoken = F.regexp_replace(spoken, r"\([^)]+\)", "")
    spaced = F.regexp_replace(nfkc(spoken, seen=text), rf"[{_RARE}&&[\p{{M}}\p{{S}}\p{{P}}]]", " ")
    return squeeze(F.lower(spaced))


def strip_markup(text: Column) -> Column:
    """Remove ``<...>`` tags, then squeeze white space."""
    return squeeze(F.regexp_replace(text, r"<[^>]+>", ""))


PROFILES = {
    "strict": normalize_strict,
    "eval": normalize_eval,
    "basic": normalize_basic,
}


def words(text: Column) -> Column:
    """Words of a normalised text: split on U+0020, empty pieces dropped."""
    return F.array_remove(F.split(text, " "), "")


def _stable_class(blocks: tuple[tuple[int, int], ...], form: str) -> str:
    """Regex ranges of the code points in ``blocks`` that the form leaves alone."""
    stable = [
        cp
        for low, high in blocks
        for cp in range(low, high + 1)
        if unicodedata.normalize(form, chr(cp)) == chr(cp)
    ]
    runs = []
    for _, run in groupby(enumerate(stable), key=lambda pair: pair[1] - pair[0]):
        members = [cp for _, cp in run]
        runs.append(rf"\x{{{members[0]:x}}}-\x{{{members[-1]:x}}}")
    return "".join(runs)


# Latin up to Extended-B, general punctuation, currency signs. None of these
# blocks holds a combining mark, so stability per character is stability per text.
_LATIN_BLOCKS = ((0x0000, 0x024F), (0x2010, 0x2027), (0x20A0, 0x20BF))


def _normal_form(form: str):
    unstable = rf"[[^\x00-\x7f]&&[^{_stable_class(_LATIN_BLOCKS, form)}]]"  # ASCII is stable

    @F.pandas_udf(StringType())
    def apply_form(text: pd.Series) -> pd.Series:
        return text.str.normalize(form)

    def column(text: Column, seen: Column | None = None) -> Column:
        """The form of ``text``. ``seen`` is a text that holds an unstable character
        wherever ``text`` does, such as the one it was cut from: the test on it
        keeps a long expression for ``text`` from being evaluated once more.
        """
        needs_it = (text if seen is None else seen).rlike(unstable)
        return F.coalesce(apply_form(F.when(needs_it, text)), text)

    return column


nfkc = _normal_form("NFKC")
compose = _normal_form("NFC")


def file_name(path: Column) -> Column:
    """Last segment of a path."""
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix; names such as ``.hidden`` or ``a.`` stay whole."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+\z", "")


def path_segment(path: Column, from_end: int) -> Column:
    """Path segment counted from the file name (1 = the name, 2 = its folder)."""
    return F.element_at(F.split(path, "/"), -from_end)
