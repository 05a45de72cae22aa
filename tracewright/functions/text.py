"""Text clean-up as built-in column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The block of combining diacritical marks.
FIRST_MARK, LAST_MARK = 0x0300, 0x036F

# An activity name loses these characters; the first is replaced instead.
REPLACED, REPLACEMENT = "-", "_"
DELETED = " =>?¿:()."


@cache
def _accent_table() -> tuple[str, str]:
    """Characters to replace and their bare letters, then (with no counterpart) the marks themselves.

    Derived from the canonical decompositions of Unicode: every character that decomposes into one
    base character and marks of the block.
    """
    accented, bare = [], []
    for code in range(sys.maxunicode + 1):
        parts = unicodedata.normalize("NFD", chr(code))
        kept = "".join(c for c in parts if not FIRST_MARK <= ord(c) <= LAST_MARK)
        if len(kept) == 1 and kept != parts:
            accented.append(chr(code))
            bare.append(kept)
    marks = "".join(map(chr, range(FIRST_MARK, LAST_MARK + 1)))
    return "".join(accented) + marks, "".join(bare)


def strip_accents(col: Column | str) -> Column:
    """Letters without their diacritical marks."""
    accented, bare = _accent_table()
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.translate(col, accented, bare)).otherwise(col)


def normalize_activity(col: Column | str) -> Column:
    """An activity name fit for a graph: no accents, blanks or punctuation, `-` as `_`."""
    return F.translate(strip_accents(col), REPLACED + DELETED, REPLACEMENT)


def simplify_name(col: Column | str) -> Column:
    """A node label: no `:complete` life-cycle ending; white space and `-` as `_`, `:` as `__`."""
    bare = F.replace(F.replace(col, F.lit(":complete"), F.lit("")), F.lit(":COMPLETE"), F.lit(""))
    return F.replace(F.regexp_replace(bare, r"[\s-]", "_"), F.lit(":"), F.lit("__"))
