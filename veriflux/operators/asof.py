"""As-of joins in ranges: for each row, the last row of its group at or before its place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Places in one range.
WIDTH = 1 << 16


def as_of(left: DataFrame, right: DataFrame, by: list[str], place: str, take: list[str], strict: bool = False, width: int = WIDTH) -> DataFrame:
    """left, with the columns `take` of the last row of right that has the same `by` and a place at or before its own.

    Places are whole numbers in both tables. strict asks for a smaller place. Of
    rows of right that share a place, the greatest by `take` counts. Where there
    is none, or `by` or the place is null, the new columns are null.

    A group's places are cut into ranges of `width`, and a range is one window's
    work, so a group with a third of all rows is many tasks'. The last row of the
    ranges before comes from a window over one row for each range.
    """
    at = F.floor(F.col(place) / width).alias("range__")
    usable = F.col(place).isNotNull()
    for b in by:
        usable = usable & F.col(b).isNotNull()
    known = right.where(usable).select(*by, F.col(place).alias("place__"), at, F.struct(*take).alias("value__")).groupBy(*by, "range__", "place__").agg(F.max("value__").alias("value__"))
    rows = left.select(*by, at, F.col(place).alias("place__"), F.struct("*").alias("row__"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = rows.select(*by, "range__", "place__", "row__", none(known, "value__"), F.lit(0 if strict else 1).alias("turn__")).unionByName(
        known.select(*by, "range__", "place__", none(rows, "row__"), "value__", F.lit(1 if strict else 0).alias("turn__"))
    )
    within = W.partitionBy(*by, "range__").orderBy("place__", "turn__").rowsBetween(W.unboundedPreceding, W.currentRow)
    here = both.withColumn("here__", F.last("value__", True).over(within)).where("row__ is not null").drop("value__", "turn__", "place__")
    # ranges of the left that need what came before them
    last = known.groupBy(*by, "range__").agg(F.max_by("value__", "place__").alias("value__"))
    asked = rows.where("range__ is not null").select(*by, "range__").distinct()
    ranges = last.unionByName(asked.select(*by, "range__", none(known, "value__"))).groupBy(*by, "range__").agg(F.max("value__").alias("value__"))
    before = W.partitionBy(*by).orderBy("range__").rowsBetween(W.unboundedPreceding, -1)
    carried = ranges.withColumn("before__", F.last("value__", True).over(before)).where("before__ is not null").drop("value__")
    found = here.join(carried, [*by, "range__"], "left").withColumn("found__", F.coalesce("here__", "before__"))
    return found.select("row__.*", *[F.col("found__")[c].alias(c) for c in take])
