"""Diacritic folding for search labels, from Unicode decompositions.

One table serves both forms: translate() for characters that fold to one
character, and a replacement each for the few that fold to more.  Covered are
the Latin letters up to U+017F and a few beyond, full-width ASCII, kana voicing
and Hangul syllables, which become jamo.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BEYOND = "ǍǎǏǐǑǒǓǔǞǟǺǻ"
_STROKED = {"Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ħ": "H", "ħ": "h", "Ł": "L", "ł": "l", "Ŀ": "L", "ŀ": "l", "Ø": "O", "ø": "o", "Ǿ": "O", "ǿ": "o", "Ŧ": "T", "ŧ": "t", "Ŋ": "N", "ŋ": "n", "ŉ": "n", "ı": "i", "ĸ": "k"}
#: Characters that fold to several.
MANY = {"Æ": "AE", "Ǽ": "AE", "æ": "ae", "ǽ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "…": "..."}


def _table() -> dict[str, str]:
    out = dict(_STROKED)
    for ch in [*map(chr, range(0xC0, 0x180)), *_BEYOND, *map(chr, range(0x304B, 0x3095)), *map(chr, range(0x30AB, 0x30F5))]:
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch:
            out.setdefault(ch, base)
    out |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    out["\u3000"] = " "
    return out


#: Characters that fold to one character.
ONE = _table()
_ALL = str.maketrans(ONE | MANY)


def fold_text(text: str) -> str:
    """The folded text, on the driver."""
    out = text.translate(_ALL)
    return "".join(unicodedata.normalize("NFD", c) if "\uac00" <= c <= "\ud7a3" else c for c in out)


@F.pandas_udf(T.StringType())
def _jamo(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else fold_text(x))


def fold(column: Column, hangul: bool = False) -> Column:
    """Folded text in built-in expressions; with hangul, syllables are split too, which takes an Arrow function.

    Null stays null.
    """
    if hangul:
        return F.when(column.rlike("[\uac00-\ud7a3]"), _jamo(column)).otherwise(fold(column))
    out = F.translate(column, "".join(ONE), "".join(ONE.values()))
    for ch, to in MANY.items():
        out = F.replace(out, F.lit(ch), F.lit(to))
    return out


def norm_label(column: Column) -> Column:
    """The label that search compares: folded, then lower case."""
    return F.lower(fold(column))
