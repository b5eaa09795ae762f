"""Numeric and number-formatting column helpers (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column | str, scale: int) -> Column:
    """Decimal half-up rounding (like ``ROUND`` on a SQL ``NUMBER``).

    The double goes through ``decimal(38,10)`` first so the result does not
    depend on the binary representation of the double (2.675 rounds to 2.68).
    What a decimal cannot hold (NaN, infinity, 29 and more digits) becomes null.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.try_cast("decimal(38,10)"), scale).cast("double")


def percent_text(fraction: Column | str, scale: int = 2) -> Column:
    """0.1234 -> '12.34%'; null stays null (``format_string`` would print 'nu')."""
    fraction = F.col(fraction) if isinstance(fraction, str) else fraction
    pct = F.round((fraction * 100).try_cast("decimal(38,10)"), scale).cast(f"decimal(38,{scale})")
    return F.when(fraction.isNull(), F.lit(None)).otherwise(F.concat(pct.cast("string"), F.lit("%")))


#: Text that is a decimal number: no type suffixes, hexadecimals or names.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_number(c: Column | str) -> Column:
    """Text or number -> double; non-numeric text -> null (never raises)."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def normalise_key(c: Column | str) -> Column:
    """Key text as the reference compares it: trimmed, and a whole number
    written as a float ('6248.0') loses its tail. Text is never read as a
    number, so long ids stay apart."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.trim(c.cast("string")), r"^([+-]?\d+)\.0+$", "$1")
