"""Places of rows in their group's order, however many rows a group has.

Groups of up to ``HUGE`` rows are numbered by a window. The rows of larger ones are dealt by
ranges of the order, sorted and numbered within their partition, and moved on by what earlier
partitions hold of their group: a table with a row for each partition and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsift.shared import written

HUGE = 100_000
#: Bits of a partition's rows in what monotonically_increasing_id gives.
_ROWS = 33


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "place", huge: int = HUGE) -> DataFrame:
    """rows with name, from 1, in the order of each group; rows of equal order are numbered in any order."""
    sizes = rows.groupBy(*group).count().filter(F.col("count") > huge).drop("count")
    small = lambda part: part.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    if sizes.isEmpty():
        return small(rows)
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"h.{g}")) for g in group]
    rest = rows.alias("r").join(sizes.alias("h"), same, "left_anti")
    large = rows.alias("r").join(sizes.alias("h"), same, "left_semi")
    return small(rest).unionByName(ranged(large, group, order, name))


def ranged(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """The same by ranges alone. What was sorted is written down, as ranges are drawn from samples."""
    at = f"_{name}"
    keys = [F.col(g) for g in group]
    dealt = written(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(at, F.monotonically_increasing_id()), "ranges")
    part = F.shiftright(F.col(at), _ROWS)
    firsts = dealt.groupBy(*group, part.alias("_part")).agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = firsts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = [F.col(f"d.{g}").eqNullSafe(F.col(f"o.{g}")) for g in group]
    found = dealt.withColumn("_part", part).alias("d").join(offsets.alias("o"), [*same, F.col("d._part") == F.col("o._part")])
    place = F.col(f"d.{at}") - F.col("o._first") + F.col("o._before") + 1
    return found.select(*(F.col(f"d.{c}") for c in rows.columns), place.cast("long").alias(name))
