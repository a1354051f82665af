"""Text rendering of numbers and lists for alert details."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Veltkamp splitting constant for a 53-bit significand.
_SPLIT = 134217729.0


def one_decimal(x: Column) -> Column:
    """A non-negative double with one decimal, rounded on its exact binary value, ties to even.

    ``format_string`` and ``bround`` round the shortest decimal text instead, so
    0.15 (which lies just below the tie in binary) would come out as 0.2. Here
    the product ``x * 20`` is taken with its exact rounding error, which tells
    on which side of a tie the value lies.
    """
    doubled = x * F.lit(20.0)
    high = x * F.lit(_SPLIT) - (x * F.lit(_SPLIT) - x)
    error = (high * F.lit(20.0) - doubled) + (x - high) * F.lit(20.0)
    whole = F.floor(doubled)
    below = F.floor(whole / F.lit(2.0))
    is_tie = (doubled == whole.cast("double")) & (whole % 2 == 1)
    tenths = (
        F.when(~is_tie, F.floor((doubled + F.lit(1.0)) / F.lit(2.0)))
        .when(error > 0, below + 1)
        .when(error < 0, below)
        .otherwise(below + below % 2)
    )
    return F.concat(F.floor(tenths / F.lit(10.0)).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def number_list(items: Column) -> Column:
    """``[1, 2, 3]``"""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def quoted_list(items: Column) -> Column:
    """``['a', 'b']``, with double quotes around texts that hold a single quote."""

    def quote(item: Column) -> Column:
        escaped = F.replace(item, F.lit("\\"), F.lit("\\\\"))
        return (
            F.when(~F.contains(item, F.lit("'")), F.concat(F.lit("'"), escaped, F.lit("'")))
            .when(~F.contains(item, F.lit('"')), F.concat(F.lit('"'), escaped, F.lit('"')))
            .otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
        )

    return number_list(F.transform(items, quote))
