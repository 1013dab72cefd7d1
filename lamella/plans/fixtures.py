"""Views of the driver's tables as image stacks, task graphs, logs and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import stored

NY, NX = 50, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y, x, v double): fifty vectors make a section of 50 by 64."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return e.select(F.floor(F.col("vec_id") / NY).cast("int").alias("z"), (F.col("vec_id") % NY).cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v") + 1) * 127.5))).cast("int")
    return raw(spark, sf_dir).withColumn("v", v)


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y) of the vectors that sections lack: the last section, or any, may have fewer than fifty."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / NY).cast("int").alias("z"), (F.col("vec_id") % NY).cast("int").alias("y"))
    short = e.groupBy("z").agg(F.collect_set("y").alias("ys")).where(F.size("ys") < NY)
    return short.select("z", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(NY - 1)), "ys")).alias("y"))


def whole(px: DataFrame, sf_dir: str, value: int | None = None) -> DataFrame:
    """``px`` and a pixel of ``value`` (or none) for each that its sections lack: files, frames and boxes take whole sections."""
    x = F.explode(F.sequence(F.lit(0), F.lit(NX - 1))).alias("x")
    return px.unionByName(missing(px.sparkSession, sf_dir).select("z", "y", x, F.lit(value).cast(px.schema["v"].dataType).alias("v")))


def held(px: DataFrame, sf_dir: str, y: Column | None = None) -> DataFrame:
    """Pixels of vectors that the table has, of sections that were made whole; ``y`` is where a filter moved row y."""
    gone = missing(px.sparkSession, sf_dir)
    gone = stored(gone if y is None else gone.withColumn("y", y.cast("int")), "missing")  # its size is known: few rows are broadcast
    return px.join(gone, ["z", "y"], "left_anti").select(px.columns)


def short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte(spark, sf_dir).withColumn("v", F.col("v") * 257 - 32768)


def framed(px: DataFrame, value: float = 0) -> DataFrame:
    frame = (F.col("y") < 5) | (F.col("y") > 44) | (F.col("x") < 7) | (F.col("x") > 56)
    return px.withColumn("v", F.when(frame, value).otherwise(F.col("v")))


def bordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framed(byte(spark, sf_dir))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte(spark, sf_dir).withColumn("v", (F.col("v") >= 150).cast("int"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only bright pixels keep their value's sixteenth."""
    return byte(spark, sf_dir).withColumn("v", F.when(F.col("v") >= 145, F.floor(F.col("v") / 4).cast("int") % 3 + 1).otherwise(0))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v with its right neighbours (wrapped) as (R, G, B), from the vector itself."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 1) * 127.5))).cast("smallint")).alias("a"))
    e = e.select("vec_id", "a", F.explode(F.sequence(F.lit(0), F.lit(NX - 1))).alias("x"))
    at = lambda d: F.element_at("a", (F.col("x") + d) % NX + 1)
    return e.select(F.floor(F.col("vec_id") / NY).cast("int").alias("z"), (F.col("vec_id") % NY).cast("int").alias("y"), "x", F.struct(at(0).alias("R"), at(1).alias("G"), at(2).alias("B")).alias("v"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 4).cast("int").alias("file_ord"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_no"),
        F.col("l_linenumber").alias("contour"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), (F.col("l_orderkey") % 4).cast("int").alias("z"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("task"), F.lit("proc").alias("kind"), (1 + F.col("p_size") % 4).cast("int").alias("cpu"), (F.floor("p_retailprice").cast("long") * 1048576).alias("mem"), (F.col("p_partkey") < 8).alias("done"))


def task_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("task"), F.floor(F.col("p_partkey") / 2).alias("file"))


def task_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task"), F.col("p_partkey").alias("file"))


def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), "ts", F.col("event_id").alias("line_no"))


def file_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("file")).agg((F.max("o_orderdate") + F.expr("INTERVAL 23 YEAR")).alias("mtime"))
    return o.withColumn("present", F.lit(True))
