"""Whole commands: stack to images, images to stack, conversion, histogram, merged points."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, numbering, pixels
from ..sources import metaimage, mrc, sections, text
from . import chain

Options = Sequence[tuple[str, str | None]]


def numbered(paths: DataFrame, column: str = "path") -> DataFrame:
    """``z`` by the order of paths: the number that path sorts at.  Paths are few beside their pixels."""
    names = numbering.numbered(paths.select(column).distinct(), column, name="z").withColumn("z", F.col("z").cast("int"))
    return paths.drop("z").join(names, column)


def listed(spark: SparkSession, inputs: str | Sequence[str]) -> DataFrame:
    """(ord, path) of the files that each input names, inputs in the order given; no file is read."""
    from functools import reduce

    parts = [spark.read.format("binaryFile").load(p).select(F.lit(k).alias("ord"), "path") for k, p in enumerate([inputs] if isinstance(inputs, str) else inputs)]
    if not parts:
        raise ValueError("no input")
    return reduce(DataFrame.unionByName, parts)


def stack_to_images(spark: SparkSession, stack: str, folder: str, *, select: str | None = None, x: tuple[int, int] | None = None, y: tuple[int, int] | None = None, filters: Options = (), dtype: str | None = None, name: str = "%04d.mha") -> int:
    """Sections of an MRC stack as image files; ``select`` like ``3,5-9``, boxes include both ends.

    The z selection reaches the reader.  ``dtype`` is the type written, the
    stack's own if not given.  Returns the number of images.
    """
    head = mrc.read_header(stack)
    nx, ny, nz = (head.fields[k] for k in ("nx", "ny", "nz"))
    mrc.register(spark)
    df = spark.read.format("mrc").load(stack)
    if select:
        df = pixels.select_sections(df, select, nz)
    px = sections.to_pixels(df)
    if x or y:
        x, y = x or (0, nx - 1), y or (0, ny - 1)
        if not (0 <= x[0] <= x[1] < nx and 0 <= y[0] <= y[1] < ny):
            raise ValueError("the box lies outside the stack")
        px = pixels.crop(px, (y[0], x[0], y[1], x[1]))
        nx, ny = x[1] - x[0] + 1, y[1] - y[0] + 1
    px = px.transform(chain.parse(filters, ny, nx, head.dtype))
    return metaimage.write(sections.to_sections(px, dtype or head.dtype), folder, name)


def images_to_stack(spark: SparkSession, images: str | Sequence[str], stack: str, *, filters: Options = (), dtype: str | None = None) -> None:
    """Image files as one MRC stack: inputs in the order given, the files of a pattern by their paths."""
    inputs = [images] if isinstance(images, str) else list(images)
    z = numbering.numbered(listed(spark, inputs), "ord", "path", name="z").select("ord", "path", F.col("z").cast("int").alias("z"))
    head = metaimage.read(spark, inputs[0]).select("ny", "nx", "dtype")
    first = head.first()
    if first is None:
        raise ValueError(f"no image at {images}")
    mrc.register(spark)
    parts = [metaimage.read(spark, p).drop("z").join(z.where(F.col("ord") == k), "path").drop("ord") for k, p in enumerate(inputs)]
    df = parts[0]
    for more in parts[1:]:
        df = df.unionByName(more)
    px = sections.to_pixels(df).transform(chain.parse(filters, first.ny, first.nx, first.dtype))
    sections.to_sections(px, dtype or first.dtype).write.format("mrc").mode("append").option("path", stack).save()


def convert(spark: SparkSession, image: str, folder: str, *, filters: Options = (), dtype: str | None = None, compressed: bool = False, name: str = "%04d.mha") -> int:
    """One image file, of several sections the first, through a filter chain."""
    df = metaimage.read(spark, image).where("z = 0")
    first = df.select("ny", "nx", "dtype").first()
    px = sections.to_pixels(df).transform(chain.parse(filters, first.ny, first.nx, first.dtype))
    return metaimage.write(sections.to_sections(px, dtype or first.dtype), folder, name, compressed=compressed)


def histogram(spark: SparkSession, images: str, bins: int = 256, *, low: float = 0, high: float = 256) -> DataFrame:
    """(bin, n) over all images, every bin present."""
    px = sections.to_pixels(metaimage.read(spark, images))
    return aggregates.zero_filled(aggregates.histogram(px, low, high, bins), bins)


def merge_points(spark: SparkSession, paths: list[str], out: str) -> None:
    """Point files in the order given, contours numbered anew across them."""
    points = text.read_points(spark, paths)
    merged = aggregates.first_seen_runs(points)
    text.write_points(merged, out)


def unlisted(files: DataFrame, allowed: DataFrame, pattern: str = r"(\d+)\.[^.]*$") -> DataFrame:
    """(path): files whose number isn't allowed (n), or that have none; nothing is deleted."""
    number = F.regexp_extract("path", pattern, 1)
    rows = files.select("path", F.when(number != "", number.cast("long")).alias("n"))
    return rows.join(allowed.select(F.col("n").cast("long")), "n", "left_anti").select("path")


def number(value: str, low: float | None = None, high: float | None = None, *, integer: bool = False) -> float | int:
    """An option's number within [low, high]."""
    try:
        got = int(value) if integer else float(value)
    except ValueError:
        raise ValueError(f"not {'an integer' if integer else 'a number'}: {value!r}") from None
    if got != got or low is not None and got < low or high is not None and got > high:
        raise ValueError(f"{value} lies outside {low}..{high}")
    return got


def overlap(value: str) -> tuple[int, int]:
    """``#`` or ``#x#``"""
    m = re.fullmatch(r"(\d+)(?:x(\d+))?", value)
    if not m:
        raise ValueError(f"not a size: {value!r}")
    return int(m[1]), int(m[2] or m[1])
