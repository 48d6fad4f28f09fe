"""Tokens of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased words between Unicode white space, punctuation kept; empty for null, empty and blank texts."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+")
    return F.filter(words, lambda w: w != "")
