"""A helper for long chains of derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with further columns, each computed once.

    They pass through a generator of one row, so filters and expressions further up read them as they are; plain
    projections would be copied into every one of those, regular expressions and all.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
