"""Rounding of binary fractions as exact arithmetic would do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int) -> Column:
    """``value`` (a double) rounded to ``digits`` decimals: the double nearest to the decimal that is nearest to
    the value's exact binary fraction, the even one of two.

    ``F.round`` rounds the shortest decimal that shows the value instead, and up from the middle.  Here the
    product with ten to the ``digits`` is taken without an error, as a rounded product and what that lacks:
    the value is split into two halves whose products are exact (ten to the 11 has few enough bits that they
    are; more digits are refused).  The rounded product decides unless it lies in the middle of two integers;
    there the lacking part does.  Values beyond 2**53 units have no finer decimals to lose and stay, as do
    nulls, infinities and what is not a number.
    """
    if not 0 <= digits <= 11:
        raise ValueError("0 to 11 digits")
    unit = F.lit(float(10**digits))
    product = value * unit
    high = value * float(2**27 + 1) - (value * float(2**27 + 1) - value)
    lacking = (high * unit - product) + (value - high) * unit
    whole = F.rint(product)
    off = product - whole
    exact = F.when((off == 0.5) & (lacking > 0), whole + 1).when((off == -0.5) & (lacking < 0), whole - 1).otherwise(whole)
    return F.when(F.abs(product) < float(2**53), exact / unit).otherwise(value)
