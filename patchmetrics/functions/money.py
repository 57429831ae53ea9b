"""Exact money and rounding expressions.

Costs are ``DECIMAL``: the reference rounds doubles with Python ``round`` (ties at half a micro-dollar land
either way); we compute the exact decimal product and round HALF_UP to 6 places. Rates are
``round_half_even(scale * num / den)`` computed with integer arithmetic only, so both engines agree to the last
digit (pandas ``.round`` is half-even on the binary value, which differs only on exact ties).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COST_TYPE = "decimal(18,6)"
RATE_TYPE = "decimal(9,3)"


def attempt_cost(prompt_tokens: Column, completion_tokens: Column, rate_in: Column, rate_out: Column) -> Column:
    """``round(p/1e6*in + c/1e6*out, 6)`` as ``DECIMAL(18,6)``; nulls count as 0."""
    tokens_x_rate = (F.coalesce(prompt_tokens, F.lit(0)) * F.coalesce(rate_in, F.lit(0))
                     + F.coalesce(completion_tokens, F.lit(0)) * F.coalesce(rate_out, F.lit(0)))
    micro = F.lit(0.000001).cast("decimal(7,6)")
    return F.round(tokens_x_rate.cast("decimal(24,3)") * micro, 6).cast(COST_TYPE)


def half_even_ratio(num: Column, den: Column, digits: int, percent: bool = True) -> Column:
    """``round_half_even(100*num/den, digits)`` (or without the 100) from non-negative integer counts.

    Null when ``den`` is 0 or null. Result type ``DECIMAL(18, digits)``.
    """
    scale = 10 ** (digits + (2 if percent else 0))
    t = num.cast("bigint") * F.lit(scale)
    d = F.when(den.cast("bigint") != 0, den.cast("bigint"))  # null for 0: no division by zero under ANSI
    r = F.pmod(t, d)
    q = ((t - r).cast("decimal(38,0)") / d.cast("decimal(38,0)")).cast("bigint")
    twice = r * 2
    bump = F.when(twice > d, 1).when((twice == d) & (F.pmod(q, F.lit(2)) == 1), 1).otherwise(0)
    unit = F.lit("0." + "0" * (digits - 1) + "1" if digits else "1").cast(f"decimal({digits + 1},{digits})")
    value = ((q + bump).cast("decimal(18,0)") * unit).cast(f"decimal(18,{digits})")
    return value
