"""Predicates on the packet record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def syn_letters(flags: Column) -> Column:
    """S and not A among the flag letters; NULL without flags, so that a filter on it reaches the scan."""
    return F.contains(flags, F.lit("S")) & ~F.contains(flags, F.lit("A"))


def is_syn(flags: Column) -> Column:
    """A connection attempt: the flag letters hold S and not A."""
    return F.coalesce(syn_letters(flags), F.lit(False))


def has_text(col: Column) -> Column:
    """Neither NULL nor empty."""
    return F.coalesce(col != "", F.lit(False))
