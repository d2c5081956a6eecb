"""Chat-message text rules (C1, C2) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesops.constants import BUSINESS_KEYWORDS, FOLLOW_UP_MAX_CHARS, FOLLOW_UP_PHRASES
from salesops.functions.text import py_strip


def _ranges(pred, limit: int = 0x20000) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in range(limit):
        if pred(chr(cp)):
            if out and out[-1][1] == cp - 1:
                out[-1] = (out[-1][0], cp)
            else:
                out.append((cp, cp))
    return out


# Characters Python's str.isdigit() accepts (decimal digits, superscripts, …),
# derived by rule and written as a regex class for Java and for RE2.
_DIGIT_RANGES = _ranges(str.isdigit)
DIGIT_CLASS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" if a != b else f"\\x{{{a:X}}}" for a, b in _DIGIT_RANGES) + "]"


# The same patterns run in Java and RE2, so white space is spelled out
# (RE2's \s lacks \x0B); other white space becomes a blank in the first step.
NON_WORD = r"[^a-z0-9\t\n\x0B\f\r -]"
SPACE_RUN = r"[\t\n\x0B\f\r ]+"


def normalized(text: Column) -> Column:
    """strip + lower (Python ``str.strip().lower()``)."""
    return F.lower(py_strip(text))


def compact(text: Column) -> Column:
    """Non [a-z0-9 white space -] → blank; white space runs → one blank; trim."""
    x = F.regexp_replace(normalized(text), NON_WORD, " ")
    return F.btrim(F.regexp_replace(x, SPACE_RUN, " "), F.lit(" "))


def has_business_keyword(text: Column, keywords=BUSINESS_KEYWORDS) -> Column:
    """The compacted text contains any keyword as a substring ('border'
    contains 'order'). Null or blank text → false."""
    c = compact(text)
    hit = F.lit(False)
    for k in keywords:
        hit = hit | c.contains(k)
    return F.coalesce(hit & (c != ""), F.lit(False))


def is_short_follow_up(text: Column, phrases=FOLLOW_UP_PHRASES) -> Column:
    """All digits (any script), or a short phrase such as 'yes' / 'go ahead'."""
    n = normalized(text)
    digits = n.rlike("^" + DIGIT_CLASS + "+$")
    phrase = (F.length(n) <= FOLLOW_UP_MAX_CHARS) & n.isin(*phrases)
    return F.coalesce((n != "") & (digits | phrase), F.lit(False))
