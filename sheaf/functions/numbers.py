"""Rounding that every engine repeats bit for bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x, places: int) -> Column:
    """Halves up, in plain double arithmetic; the 1e-7 of a last place makes sums that differ in their last bits agree on ties."""
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10**places)
    return F.floor(x * scale + 0.5000001) / scale
