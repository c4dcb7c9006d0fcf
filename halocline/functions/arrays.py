"""Constant arrays as one literal."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def doubles(values) -> Column:
    """An array of doubles, written once as SQL text instead of one call per element."""
    def text(v: float) -> str:
        v = float(v)
        return f"{v!r}D" if math.isfinite(v) else f"double('{'NaN' if v != v else 'Infinity' if v > 0 else '-Infinity'}')"

    return F.expr("array(" + ", ".join(text(v) for v in values) + ")")
