"""Rows by their place in an order, without a task that sees them all."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

_ROW = (1 << 33) - 1


def slice_of(rows: DataFrame, order: list[Column], start: int, stop: int | None = None) -> DataFrame:
    """The rows whose place (from 0) in a total order lies from start on and before stop. Rows are dealt by ranges of
    the order and sorted within; the ranges' counts, one number each, tell which ranges hold the places, and only these are
    read again. The result has the order's rows, not their sequence."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # The id holds the number of the range and the row's place in it.
    table = stored(ranged.withColumns({"_part": F.shiftrightunsigned("_id", 33).cast("int"), "_row": F.col("_id").bitwiseAND(F.lit(_ROW))}).drop("_id"), "ranged", "_part")
    sizes = sorted((r["_part"], r["count"]) for r in table.groupBy("_part").count().collect())  # at most `parts` rows
    before = [0, *accumulate(n for _, n in sizes)]
    held = [(p, b, n) for (p, n), b in zip(sizes, before, strict=False) if b + n > start and (stop is None or b < stop)]
    whole = [p for p, b, n in held if b >= start and (stop is None or b + n <= stop)]
    keep = F.col("_part").isin(whole) if whole else F.lit(False)
    for p, b, n in held:  # the first range and the last one
        if p not in whole:
            keep = keep | ((F.col("_part") == p) & F.col("_row").between(start - b, (n if stop is None else stop - b) - 1))
    return table.where(keep).select(*rows.columns)
