"""Text expressions: cleaning, accent folding, word tokens and n-grams. All stay inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"(?U)\b\w\w+\b"


def clean_text(col: Column) -> Column:
    """Lower-case, keep a-z and 0-9, one space between words; null becomes the empty string."""
    kept = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


@lru_cache(maxsize=1)
def _latin_folding() -> tuple[str, str]:
    """Latin letters whose compatibility form is one base letter plus combining marks."""
    src, dst = [], []
    for point in [*range(0x80, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(point):
            src.append(chr(point))
            dst.append(base)
    return "".join(src), "".join(dst)


def _nfkd():
    """Full compatibility folding, for text outside the Latin blocks; a closure, so it ships by value."""

    def fold(s: pd.Series) -> pd.Series:
        import unicodedata as u

        return s.map(lambda t: t and "".join(c for c in u.normalize("NFKD", t) if not u.combining(c)))

    return F.pandas_udf(fold, T.StringType())


def unaccent(col: Column, full: bool = False) -> Column:
    """Drop accents. The default covers the Latin blocks without leaving the JVM."""
    if full:
        return _nfkd()(col)
    src, dst = _latin_folding()
    return F.regexp_replace(F.translate(col, src, dst), r"\p{Mn}", "")


def word_tokens(col: Column, full_unaccent: bool = False) -> Column:
    """Words of two or more characters of the lower-cased, unaccented text."""
    text = unaccent(F.lower(F.coalesce(col, F.lit(""))), full_unaccent)
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def bound(col: Column, use) -> Column:
    """``use(col)`` with the value computed once, also where ``use`` reads it inside a lambda."""
    return F.transform(F.array(col), use)[0]


def _grams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def ngram_terms(tokens: Column, *sizes: int) -> Column:
    """The n-grams of a token array, words joined by one space, for each given size in turn."""
    return bound(tokens, lambda t: F.concat(*[_grams(t, n) for n in sizes or (1, 2)]))


def whitespace_words(col: Column) -> Column:
    """Lower-cased whitespace tokens; blank text gives an empty array."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"\s+", " "))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))
