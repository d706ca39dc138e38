"""Evaluating an expression once although several others use it.

The optimizer merges projections and pushes filters below them, and both copy
the expressions they meet.  For regular expressions, vectors and models that
means computing them again for every mention.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.transform(F.array(value), body)[0]


def computed_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns that later filters and projections cannot copy.

    The values leave a generator, through which the optimizer pushes nothing.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))

