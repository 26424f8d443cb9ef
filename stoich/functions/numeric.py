"""Numeric helpers shared by operators and their oracles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_bin(x: Column, places: int) -> Column:
    """Half-even rounding of the binary value: scale, round to an integer,
    scale back.  ``bround(x, d)`` rounds the shortest decimal spelling of x
    instead, which differs on values like 0.04375 (binary 0.043749999...);
    this form agrees with Python's ``round`` in all but double-rounding
    cases and with the SQL spelling below bit for bit."""
    s = float(10 ** places)
    return F.bround(x * F.lit(s), 0) / F.lit(s)


def sql_round_bin(expr: str, places: int) -> str:
    s = float(10 ** places)
    return f"(round_even(({expr}) * {s!r}, 0) / {s!r})"
