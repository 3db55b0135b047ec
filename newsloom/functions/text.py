"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(c: Column, pattern: str = "[a-z0-9]+") -> Column:
    """Lower-case tokens in order; NULL gives an empty list. The default pattern is ASCII only."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))


def word_count(c: Column) -> Column:
    """Words parted by white space."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))


def article_text(title: Column, abstract: Column) -> Column:
    """Title and abstract, those not empty, parted by a blank."""
    return F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(abstract, F.lit("")))
