"""Reading rules for dirty columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for null.
NULL_TOKENS = ("", "None")


def clean_text(c: Column | str, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Outer spaces removed, then null for any of tokens."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(~t.isin(*tokens), t)


def clean_double(c: Column | str) -> Column:
    """NaN as null."""
    return F.nanvl(F.col(c) if isinstance(c, str) else c, F.lit(None).cast("double"))


def fold(c: Column | str) -> Column:
    """Text for a comparison without case and outer spaces."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
