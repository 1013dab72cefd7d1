"""Histograms, statistics, areas and label numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import numbering
from .pixels import BY, size


def bin_of(v: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin on [low, high], 0-based; the last bin includes its upper end."""
    return F.least(F.width_bucket(v.cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins)).cast("int") - 1


def histogram(px: DataFrame, low: float, high: float, bins: int = 256, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, n): partial counts on the map side, one row a bin shuffled."""
    return px.where(F.col("v").between(low, high)).groupBy(*by, bin_of(F.col("v"), low, high, bins).alias("bin")).agg(F.count("*").alias("n"))


def unit_range(low: float, high: float) -> tuple[float, float]:
    """Histogram range of a float image: [0, 2] if it lies in [0, 1], else up to one above it."""
    return (0.0, 2.0) if low >= 0 and high <= 1 else (low, high + 1)


def zero_filled(hist: DataFrame, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Every bin of every section, empty ones with 0."""
    keys = hist.select(*by).distinct() if by else hist.sparkSession.range(1).select()
    grid = keys.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(hist, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cdf(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running sum over bins: the window holds one histogram."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return hist.withColumn("cum", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))


def section_stats(px: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    v = F.col("v").cast("double")
    return px.groupBy(*by).agg(F.min(v).alias("vmin"), F.max(v).alias("vmax"), F.avg(v).alias("vmean"))


def stack_stats(px: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Minimum, maximum and mean of section means."""
    return section_stats(px, by).agg(F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"), F.avg("vmean").alias("vmean"))


def merge_stats(stats: DataFrame, nz: int, more: DataFrame) -> DataFrame:
    """Header statistics after one more section: the mean weighs sections equally."""
    new = more.select(F.col("vmin").alias("a"), F.col("vmax").alias("b"), F.col("vmean").alias("c"))
    return stats.crossJoin(F.broadcast(new)).select(F.least("vmin", "a").alias("vmin"), F.greatest("vmax", "b").alias("vmax"), ((F.col("vmean") * nz + F.col("c")) / (nz + 1)).alias("vmean"))


def foreground_area(px: DataFrame, ny: int | Column, nx: int | Column, background: int | None = None, by: Sequence[str] = BY) -> DataFrame:
    """(by..., t, l, b, r): the box of pixels that differ from the background.

    The background is ``background``, else the first pixel's value if the top
    row or left column is constant, else the last pixel's if the bottom row or
    right column is; else the box is the whole image.  All background: the last
    pixel.  A pixel without a value differs from it.  Both aggregates are partial sums per section.
    """
    v, y, x = F.col("v"), F.col("y"), F.col("x")
    if background is None:
        flat = lambda c: F.min(F.when(c, v)) == F.max(F.when(c, v))
        edges = px.where((y == 0) | (y == ny - 1) | (x == 0) | (x == nx - 1)).groupBy(*by).agg(
            (flat(y == 0) | flat(x == 0)).alias("head"),
            (flat(y == ny - 1) | flat(x == nx - 1)).alias("tail"),
            F.max(F.when((y == 0) & (x == 0), v)).alias("first"),
            F.max(F.when((y == ny - 1) & (x == nx - 1), v)).alias("last"),
        )
        found = edges.select(*by, F.when(F.col("head"), F.col("first")).when(F.col("tail"), F.col("last")).alias("bg"))
        px = px.join(found, list(by))
    else:
        px = px.withColumn("bg", F.lit(background))
    fg = F.col("bg").isNull() | ~v.eqNullSafe(F.col("bg"))
    box = px.groupBy(*by).agg(*(f(F.when(fg, c)).alias(k) for k, f, c in (("t", F.min, y), ("l", F.min, x), ("b", F.max, y), ("r", F.max, x))))
    return box.select(*by, *(F.coalesce(F.col(k), size(d)).cast("int").alias(k) for k, d in (("t", ny - 1), ("l", nx - 1), ("b", ny - 1), ("r", nx - 1))))


def distinct_values(px: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return px.select(*by, "v").distinct()


def renumber(px: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """0 stays, other values become 1..N in ascending order within each section.

    Structs (R, G, B) order by component and black stays 0.  Ranks are taken
    over distinct values, so the sort never sees the pixels.
    """
    kind = px.schema["v"].dataType
    if kind.typeName() == "struct":
        zero = F.struct(*(F.lit(0).cast(f.dataType).alias(f.name) for f in kind.fields))
    else:
        zero = F.lit(0).cast(kind)
    ranks = px.select(*by, "v").where(F.col("v") != zero).distinct().withColumn("n", F.dense_rank().over(Window.partitionBy(*by).orderBy("v")))
    if kind.typeName() != "struct":
        ranks = ranks.withColumn("n", F.when(F.col("v") < 0, F.raise_error(F.lit("negative values can't be renumbered")).cast("int")).otherwise(F.col("n")))
    return px.join(ranks, [*by, "v"], "left").withColumn("v", F.coalesce("n", F.lit(0)).cast("int")).drop("n").select(*px.columns)


def first_seen_runs(points: DataFrame) -> DataFrame:
    """Contour numbers that grow by one at every change, across files.

    ``points`` has file_ord, line_no, contour and more.  Files are cut into
    ranges of lines, so neither a long file nor many files meet in one task.
    """
    return numbering.change_count(points, "contour", "file_ord", "line_no", name="lamella_run").withColumn("contour", F.col("lamella_run")).drop("lamella_run")


def forward_fill(rects: DataFrame, order: str = "ord") -> DataFrame:
    """The last box given holds for the images after it (one row an image)."""
    box = F.when(F.col("t").isNotNull(), F.struct("t", "l", "b", "r"))
    return numbering.filled(rects, box, order, name="box").select(order, "box.t", "box.l", "box.b", "box.r")


def last_entry(log: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The last row of each key: a partial maximum, no sort."""
    best = F.max(F.struct(order, *values)).alias("best")
    return log.groupBy(key).agg(best).select(key, *(F.col(f"best.{c}") for c in (order, *values)))


def balanced_split(items: DataFrame, groups: int, order: str) -> DataFrame:
    """Contiguous groups whose sizes differ by one at most, the larger ones first (0-based)."""
    rows = numbering.numbered(items, order, name="lamella_at")
    n = rows.agg(F.count("*").alias("n")).first()["n"]
    size, more = divmod(n, groups)
    at = F.col("lamella_at")
    small = F.lit(more) + F.floor((at - more * (size + 1)) / max(size, 1))
    return rows.withColumn("grp", F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(small).cast("int")).drop("lamella_at")


def value_bounds(df: DataFrame, column: str = "z") -> DataFrame:
    """(lowest, highest) of a column, for checks of a selection."""
    return df.agg(F.min(column).alias("lowest"), F.max(column).alias("highest"))
