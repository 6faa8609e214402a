"""Compatibility forms, which no built-in function has: words of a text in NFKC."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


def folded_words(text: str | None) -> set[str]:
    return set(_WORD.findall(unicodedata.normalize("NFKC", text or "").lower()))


def _has_all(texts: pd.Series, queries: pd.Series) -> pd.Series:
    return pd.Series([folded_words(q) <= folded_words(t) for t, q in zip(texts, queries, strict=True)])


def has_all_words(text: Column, query: Column) -> Column:
    """Whether every word of the query is a word of the text; an empty query has none to miss."""
    return F.pandas_udf(_has_all, "boolean")(text, query)
