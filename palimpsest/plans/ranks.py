"""Dense ranks of all rows of a table, without a window over the whole of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.files import step

_BITS = 33  # of monotonically_increasing_id that number the rows of a partition


def ranked(df: DataFrame, order: list[Column], path: str, name: str, start: int = 0, without: list[str] = ()) -> tuple[DataFrame, int]:
    """The rows with their rank in ``order`` (from ``start`` on), and how many there are; columns that only the order needs are left out (``without``).

    Rows are sorted by ranges and written once; only the number of rows of each
    partition comes to the driver.
    """
    spark = df.sparkSession
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    back = step(out.drop(*without).withColumn("__mid", F.monotonically_increasing_id()), path)
    part = F.shiftright("__mid", _BITS)
    counts = sorted((r["p"], r["n"]) for r in back.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], start
    for p, n in counts:
        offsets.append((p, total))
        total += n
    if not offsets:
        return back.withColumn(name, F.lit(None).cast("bigint")).drop("__mid"), 0
    before = spark.createDataFrame(offsets, "__part long, __before long")  # one row a partition
    placed = back.withColumn("__part", part).join(F.broadcast(before), "__part")
    return placed.withColumn(name, F.col("__before") + F.col("__mid").bitwiseAND(F.lit((1 << _BITS) - 1))).drop("__mid", "__part", "__before"), total - start
