"""Fuzzy comparison of strings, in Arrow batches (TX18, TX19)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """TX18: Ratcliff and Obershelp's ratio of two strings without regard to case; null for a null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def alike(a: Column, b: Column, threshold: float) -> Column:
    """Whether ``fuzzy_ratio`` is at least ``threshold``; the ratio's bound by letters, whatever their order, comes first."""

    @F.pandas_udf(BooleanType())
    def enough(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> bool:
            if x is None or y is None:
                return False
            both = SequenceMatcher(None, x.lower(), y.lower())
            return both.quick_ratio() >= threshold and both.ratio() >= threshold

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    return enough(a, b)


def title_match(text: Column, title: Column, category: Column, size: Column, median_size: Column) -> Column:
    """TX19: alike (over .85), or one within the other and the text longer than 5; and a title, or not smaller than the page's print."""
    a, b = F.lower(text), F.lower(title)
    alike = (fuzzy_ratio(text, title) > 0.85) | (a.contains(b) | b.contains(a)) & (F.length(text) > 5)
    small = F.coalesce((size != 0) & (median_size > 0) & (size < median_size * 0.95), F.lit(False))
    return alike & ((category == "Title") | ~small)
