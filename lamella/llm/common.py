"""Shared plumbing of the text operators.

Conventions that all operators of this subpackage follow:

* they select the columns they need first, so extra input columns never clash;
* words are maximal runs of bytes other than space and ``\\t\\n\\v\\f\\r``
  (``bytes.split()`` cuts at exactly these six);
* a null text counts as an empty text;
* a stage that needs a table twice writes it as Parquet below
  ``spark.checkpoint.dir``, which every executor shares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scratch import scratch_dir, scratch_path, stored  # noqa: F401


#: Bytes that end a word.
SPACE = b" \t\n\r\x0b\x0c"
#: UTF-8 continuation bytes; deleting them leaves one byte for each code point.
CONTINUATION = bytes(range(0x80, 0xC0))
#: Rows in an Arrow batch: bounds what a Python worker holds at once.
ROWS_PER_BATCH = 1000
BYTES_PER_BATCH = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Lower the session's Arrow batches to ``rows`` rows and BYTES_PER_BATCH; smaller settings stay."""
    for kind, most in (("Records", rows), ("Bytes", BYTES_PER_BATCH)):
        key = f"spark.sql.execution.arrow.max{kind}PerBatch"
        now = str(spark.conf.get(key)).rstrip("b")
        if not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


def map_arrow(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str | StructType,
) -> DataFrame:
    """``fn`` over each Arrow batch of ``df``; a None result emits nothing."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row, b"" for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(id_remainder(doc_id, modulus) == remainder, F.lit(False))


def training_labels(
    labels: DataFrame, label: str, modulus: int, remainder: int, bound: int, seed: int = 17
) -> DataFrame:
    """(doc_id, y) of labelled rows outside the held-out fold, about ``bound`` at most.

    Ids whose rows disagree take the majority; a tie counts as 1.  Which ids
    stay depends on a hash of the id alone, so the sample is the same on every
    run and no task sorts it.
    """
    rows = (
        labels.select("doc_id", F.col(label).alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
        .where(~held_out(F.col("doc_id"), modulus, remainder))
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    total = labels.where(F.col("doc_id").isNotNull()).count()
    if total > bound:
        share = int(bound / total * (1 << 30))
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < share)
    return rows


def with_labels(docs: DataFrame, train: DataFrame) -> DataFrame:
    """Texts of the sampled ids.  ``train`` is bounded by its sample size, hence broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(train), "doc_id")
