"""Order statistics of the workload report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def permilles(rows: DataFrame, by: Sequence[str], column: str, at: Mapping[str, int]) -> DataFrame:
    """For each group of ``by``, its values at index (n - 1) * permille div 1000 of the sorted
    ``column``, not interpolated, and ``n``; nulls don't count. Values are counted first and ranked by
    running sums over the distinct ones, which spill: no group is collected. Without ``by`` there is
    one row, of 0 where there are no values."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    ranked = counts.select(*by, "_value", "_n", F.sum("_n").over(whole.orderBy("_value")).alias("_upto"))
    sized = ranked.groupBy(*by).agg(F.sum("_n").alias("n")) if by else ranked.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    both = ranked.join(sized, list(by)) if by else sized.join(ranked, F.lit(True), "left")
    # the value at an index is the least whose running count is beyond it
    found = {name: F.min(F.when(F.col("_upto") > F.expr(f"(n - 1) * {permille} div 1000"), F.col("_value"))) for name, permille in at.items()}
    out = both.groupBy(*by, "n").agg(*((v if by else F.coalesce(v, F.lit(0))).alias(k) for k, v in found.items()))
    return out
