"""Text helpers that agree with Python's notion of white space, as column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: White space as Python's str methods and patterns see it; Java's and RE2's ``\\s`` is smaller.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACES, WORD = f"[{SPACE}]+", f"[^{SPACE}]+"
#: Line ends as ``splitlines`` sees them.
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Typographic variants and what they are folded to.
FOLDED = {"'": "‘’‚‛", '"': "“”„‟", "-": "‐‑‒–—―−", " ": "     "}
DROPPED, ELLIPSIS = "­​﻿", "…"


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(c: Column | str) -> Column:
    """Compatibility form; Spark has no function for it.  ASCII texts pass untouched."""
    return F.pandas_udf(_nfkc, T.StringType())(c)


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACES}|{SPACES}$", "")


def clean(c: Column | str) -> Column:
    return collapse(nfkc(c))


def lines(c: Column) -> Column:
    """``splitlines``: no empty line after the last line end."""
    parts = F.split(c, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def numeric_density(c: Column) -> Column:
    """Digits per word, 0 without words."""
    words = F.regexp_count(c, F.lit(WORD))
    return F.when(words == 0, 0.0).otherwise(F.regexp_count(c, F.lit(r"\p{Nd}")) / F.greatest(words, F.lit(1)))


def bounded(words: list[str]) -> str:
    """A pattern for words that no small letter touches."""
    import re

    return "(?<![a-z])(?:" + "|".join(re.escape(w) for w in words) + ")(?![a-z])"
