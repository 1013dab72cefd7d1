"""Image files by their ending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metaimage, mrc
from .sections import SECTION

READABLE = (".mha", ".mhd", ".mrc")


def ending(path: str) -> str:
    """The lower-cased ending with its dot; an unknown one raises."""
    found = "." + path.rpartition(".")[2].lower()
    if found not in READABLE:
        raise ValueError(f"can't read or write {found} images; known: {', '.join(READABLE)}")
    return found


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, SECTION) of the file, or the files of one kind, that ``path`` names."""
    if ending(path) == ".mrc":
        return mrc.read(spark, path).withColumn("path", F.lit(path)).select("path", *(f.split()[0] for f in SECTION.split(", ")))
    return metaimage.read(spark, path)


def write(sections: DataFrame, path: str, **options) -> int:  # noqa: ANN003
    """One stack, or a file for each section where the name holds a ``%d`` mark; the number of files."""
    if ending(path) == ".mrc":
        sections.write.format("mrc").mode("append").option("path", path).save()
        return 1
    folder, _, name = path.rpartition("/")
    return metaimage.write(sections, folder, name, **options)
