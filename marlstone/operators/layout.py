"""Page layout: blocks that lie in tables are dropped, the rest read from top to bottom and left to right; table rows as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 2


def outside_tables(blocks: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks (keys, x0, y0, x1, y1, ...) that no table (keys, x0, y0, x1, y1) of their page holds, up to a tolerance. The keys are equal, so the
    anti join is an equi join with a range condition."""
    b, t = blocks.alias("b"), tables.alias("t")
    inside = ((F.col("b.x0") >= F.col("t.x0") - TOLERANCE) & (F.col("b.y0") >= F.col("t.y0") - TOLERANCE)
              & (F.col("b.x1") <= F.col("t.x1") + TOLERANCE) & (F.col("b.y1") <= F.col("t.y1") + TOLERANCE))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"b.{k}") == F.col(f"t.{k}"))
    return b.join(t, same & inside, "left_anti")


def reading_order(blocks: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Adds position: by rounded top, then rounded left edge (halves to even)."""
    w = Window.partitionBy(*keys).orderBy(F.bround("y0"), F.bround("x0"), tie)
    return blocks.withColumn("position", F.row_number().over(w))


def row_text(cells: Column, keep: str = "all") -> Column:
    """Cells joined by bars. keep: ``all`` (empty ones too, NULL if all are empty), ``filled`` or ``not_null``."""
    if keep == "filled":
        kept = F.filter(cells, lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    elif keep == "not_null":
        kept = F.filter(cells, lambda c: c.isNotNull())
    else:
        kept = F.transform(cells, lambda c: F.coalesce(c, F.lit("")))
    filled = F.exists(kept, lambda c: F.trim(c) != "") if keep == "all" else F.size(kept) > 0
    return F.when(filled, F.array_join(kept, " | "))
