"""Running sums inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Rows of one group that are summed in order by one task.
STRETCH = 1_024


def sums_before(rows: DataFrame, group: str, place: str, tie: str, n: str, out: str = "before") -> DataFrame:
    """Add ``out``: the sum of ``n`` over the rows of a group that come earlier by ``place``, then ``tie``.

    ``place`` counts from 0 with few rows of one place, nulls come first.  A group is cut into
    stretches of places; only their sums, a thousandth of the rows, are ordered over a whole group.
    """
    at = F.coalesce(F.floor(F.col(place) / STRETCH), F.lit(-1)).alias("_stretch")
    rows = rows.select("*", at)
    inside = Window.partitionBy(group, "_stretch").orderBy(place, tie)
    over = Window.partitionBy(group).orderBy("_stretch")
    starts = rows.groupBy(group, "_stretch").agg(F.sum(n).alias("_sum")).select(group, "_stretch", (F.sum("_sum").over(over) - F.col("_sum")).alias("_start"))
    ranked = rows.withColumn("_inside", F.sum(n).over(inside) - F.col(n))
    return ranked.join(starts, [group, "_stretch"]).withColumn(out, F.col("_start") + F.col("_inside")).drop("_stretch", "_start", "_inside")
