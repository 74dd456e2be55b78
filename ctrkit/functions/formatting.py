"""Fixed-point text for submissions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_point(col, digits: int = 8) -> Column:
    """``'{:.8f}'``-style text. The value is rounded to ``digits`` first so that
    half-way cases do not depend on the engine's text rounding rule."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", F.round(c.cast("double"), digits)))
