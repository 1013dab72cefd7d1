"""Running values over a whole table without sorting it in one task.

Rows are dealt by ranges of the order and sorted within each range.  Each
range is summed up in one row, the few summaries are scanned, and every row
gets its range's result.  The dealt table is stored: its ranges are sampled, so
they may differ when they are computed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scratch import stored

PART, PLACE = "lamella_part", "lamella_place"


def dealt(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """``df`` with the number of its range and its place within, both ascending with ``order``.

    ``order`` should tell rows apart: equal ones share a range.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return stored(rows.withColumns({PART: F.shiftright(at, 33).cast("int"), PLACE: at.bitwiseAND(F.lit((1 << 33) - 1))}), "dealt")


def _before() -> WindowSpec:
    """Of a summary row, all ranges before: there are as many rows as ranges."""
    return Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def _within() -> WindowSpec:
    return Window.partitionBy(PART).orderBy(PLACE)


def numbered(df: DataFrame, *order: str, name: str = "position", parts: int | None = None) -> DataFrame:
    """``name``: 0, 1, 2, ... by ``order``."""
    rows = dealt(df, *order, parts=parts)
    first = rows.groupBy(PART).agg(F.count("*").alias("n")).select(PART, F.coalesce(F.sum("n").over(_before()), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(first), PART).withColumn(name, F.col("first") + F.col(PLACE)).drop(PART, PLACE, "first")


def filled(df: DataFrame, value: Column, *order: str, name: str, parts: int | None = None) -> DataFrame:
    """``name``: the last value that isn't null, up to each row."""
    rows = dealt(df.withColumn(name, value), *order, parts=parts)
    last = rows.where(F.col(name).isNotNull()).groupBy(PART).agg(F.max_by(name, PLACE).alias("last"))
    all_ = rows.select(PART).distinct().join(last, PART, "left")
    carried = all_.select(PART, F.last("last", True).over(_before()).alias("carried"))
    own = F.last(name, True).over(_within().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, own).join(F.broadcast(carried), PART).withColumn(name, F.coalesce(name, "carried")).drop(PART, PLACE, "carried")


def change_count(df: DataFrame, column: str, *order: str, name: str, parts: int | None = None) -> DataFrame:
    """``name``: 1 for the first row, one more at every row whose ``column`` differs from the row's before."""
    rows = dealt(df, *order, parts=parts)
    step = (~F.col(column).eqNullSafe(F.lag(column).over(_within())) & F.lag(F.lit(1)).over(_within()).isNotNull()).cast("long")
    rows = rows.withColumn("step", step).withColumn("local", F.sum("step").over(_within().rowsBetween(Window.unboundedPreceding, 0))).drop("step")
    ends = rows.groupBy(PART).agg(F.min_by(column, PLACE).alias("head"), F.max_by(column, PLACE).alias("tail"), F.max("local").alias("most"))
    by = Window.orderBy(PART)
    opens = F.when(F.lag(PART).over(by).isNull(), F.lit(1)).otherwise((~F.col("head").eqNullSafe(F.lag("tail").over(by))).cast("long"))
    ends = ends.withColumn("opens", opens).withColumn("first", F.sum(F.col("opens") + F.coalesce(F.lag("most").over(by), F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(F.broadcast(ends.select(PART, "first")), PART).withColumn(name, F.col("first") + F.col("local")).drop(PART, PLACE, "local", "first")
