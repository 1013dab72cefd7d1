"""Line-oriented sources and sinks: points, histograms, boxes, task logs, usage records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import numbering

POINT = r"^\s*(-?\d+)\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)\s*$"
LOG_LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) (.+)$"
#: Field order of a usage record after the task's name.
USAGE = ("utime", "stime", "maxrss", "ixrss", "idrss", "isrss", "minflt", "majflt", "nswap", "inblock", "oublock", "msgsnd", "msgrcv", "nsignals", "nvcsw", "nivcsw")


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_ord, line_no, value) of the files in the order given.

    ``line_no`` ascends with the lines of a file, or of a folder of part files: the
    file's name, the first byte of a split and the place of the line in its split,
    so long files are read in parallel.
    """
    parts = []
    for k, p in enumerate(paths):
        rows = spark.read.text(p).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
        place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        parts.append(rows.select(F.lit(k).alias("file_ord"), F.struct("file", "start", place.alias("place")).alias("line_no"), F.rtrim(F.col("value"), F.lit("\r")).alias("value")))
    return reduce(DataFrame.unionByName, parts)


BOX_LINE = r"^\s*(\d+)[:;,\s]+(\d+)[:;,\s]+(\d+)[:;,\s]+(\d+)\s*$"


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(ord, t, l, b, r) of the lines up to the first that isn't four integers."""
    rows = numbering.numbered(lines(spark, [path]), "line_no", name="ord")
    bad = rows.where(~F.col("value").rlike(BOX_LINE)).agg(F.min("ord").alias("bad"))
    rows = rows.join(F.broadcast(bad)).where("bad is null or ord < bad")
    return rows.select("ord", *(F.regexp_extract("value", BOX_LINE, k).cast("int").alias(c) for k, c in enumerate("tlbr", 1)))


def read_points(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_ord, line_no, contour, x, y, z); blank lines are skipped, other lines need four integers."""
    rows = lines(spark, paths).where(F.trim("value") != "")
    checked = F.when(F.col("value").rlike(POINT), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a point: "), "value")))
    return rows.withColumn("value", checked).select("file_ord", "line_no", *(F.regexp_extract("value", POINT, k).cast("int").alias(c) for k, c in enumerate(("contour", "x", "y", "z"), 1)))


def write_points(points: DataFrame, path: str) -> None:
    """``contour x y z`` lines in file order: a range partition sorts without one task."""
    points.orderBy("file_ord", "line_no").select(F.concat_ws(" ", "contour", "x", "y", "z").alias("value")).write.text(path)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """(bin, n): one integer a line, in order."""
    rows = lines(spark, [path]).where(F.trim("value") != "")
    return numbering.numbered(rows, "line_no", name="bin").select(F.col("bin").cast("int").alias("bin"), F.trim("value").cast("long").alias("n"))


def write_histogram(hist: DataFrame, path: str) -> None:
    """Counts in the order of bins; a range partition sorts, so parts follow one another."""
    hist.orderBy("bin").select(F.col("n").cast("string").alias("value")).write.text(path)


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(task log (line_no, ts, task), settings (line_no, k, v)); later lines win."""
    rows = lines(spark, [path])
    log = rows.where(F.col("value").rlike(LOG_LINE)).select("line_no", F.to_timestamp(F.regexp_extract("value", LOG_LINE, 1)).alias("ts"), F.regexp_extract("value", LOG_LINE, 2).alias("task"))
    kv = r"^\*([^=]+)=(.*)$"
    settings = rows.where(F.col("value").rlike(kv)).select("line_no", F.regexp_extract("value", kv, 1).alias("k"), F.regexp_extract("value", kv, 2).alias("v"))
    return log, settings


def write_log(log: DataFrame, settings: DataFrame, path: str) -> None:
    """Settings first, then completions by time."""
    head = settings.select(F.lit(0).alias("part"), F.col("k").alias("key"), F.concat(F.lit("*"), "k", F.lit("="), "v").alias("value"))
    body = log.select(F.lit(1).alias("part"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("key"), F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "task").alias("value"))
    head.unionByName(body).orderBy("part", "key", "value").select("value").write.text(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """(task, USAGE...): 16 numbers after the name, which may hold spaces."""
    words = F.split(F.trim("value"), r"\s+")
    n = F.size(words)
    numbers = [F.element_at(words, n - 15 + k).cast("double" if k < 2 else "long").alias(c) for k, c in enumerate(USAGE)]
    return spark.read.text(path).where(F.trim("value") != "").select(F.array_join(F.slice(words, 1, n - 16), " ").alias("task"), *numbers)


def write_usage(usage: DataFrame, path: str) -> None:
    """A line for each record: the task's name, then USAGE."""
    usage.select(F.concat_ws(" ", "task", *(F.col(c).cast("string") for c in USAGE)).alias("value")).write.text(path)
