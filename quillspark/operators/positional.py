"""Positional scans: state carried forward over ordered nodes, per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(nodes: DataFrame, *, page: str = "page_id", pos: str = "pos", date: Column, heading: Column, stop: Column) -> DataFrame:
    """Nodes before the stop, with the latest date above and the latest heading below that date.

    ``date`` and ``heading`` are null at nodes that hold none; ``stop`` is true at sentinels.
    """
    ahead = Window.partitionBy(page).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = nodes.withColumns({"__d": date, "__h": heading, "__s": F.coalesce(stop, F.lit(False)).cast("int")})
    out = out.withColumns({"stopped": F.max("__s").over(ahead), "current_date": F.last("__d", ignorenulls=True).over(ahead), "block": F.count("__d").over(ahead)})
    inside = Window.partitionBy(page, "block").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("current_heading", F.last("__h", ignorenulls=True).over(inside)).filter("stopped = 0").drop("__d", "__h", "__s", "stopped", "block")
