"""Rounding as the languages of the result files do it; they differ on ties and on what counts as one.

``python_round`` and ``fixed`` look at the double's exact value and round ties to even; ``go_round`` rounds the scaled
double half away from zero; ``to_fixed`` looks at the exact value and rounds ties up; ``math_round`` rounds to whole
numbers half up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """The number as text with so many decimals, from its exact value."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def python_round(x: Column, digits: int) -> Column:
    return fixed(x, digits).cast("double")


def go_round(x: Column, digits: int) -> Column:
    scale = F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def to_fixed(x: Column, digits: int) -> Column:
    scale = F.lit(10.0**digits)
    tie = F.abs(x * scale * 2) % 2 == 1
    return F.when(tie, F.floor(x * scale + 0.5) / scale).otherwise(python_round(x, digits))


def math_round(x: Column) -> Column:
    return F.floor(x + 0.5)
