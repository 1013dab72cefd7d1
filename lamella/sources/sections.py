"""Sections: one row for each image of a stack, pixels as bytes; and back to rows of pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dtypes import image_type

SECTION = "z int, ny int, nx int, dtype string, pixels binary"
STATS = ", vmin double, vmax double, vmean double"


def to_pixels(sections: DataFrame) -> DataFrame:
    """(z, y, x, v) of scalar sections as double; little-endian bytes, x fastest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ny, nx = row["ny"], row["nx"]
                v = np.frombuffer(row["pixels"], "<" + image_type(row["dtype"]).numpy, ny * nx)
                y, x = np.divmod(np.arange(ny * nx, dtype=np.int32), np.int32(nx))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(ny * nx, row["z"], np.int32)), pa.array(y), pa.array(x), pa.array(v.astype(np.float64))], names=["z", "y", "x", "v"])

    return sections.select("z", "ny", "nx", "dtype", "pixels").mapInArrow(run, "z int, y int, x int, v double")


def to_sections(px: DataFrame, dtype: str, *, stats: bool = False) -> DataFrame:
    """Sections of scalar pixels; a group is one image, never a stack.

    A pixel without a value counts for the shape and holds 0.  ``stats`` adds
    vmin, vmax and vmean of the pixels that have one.
    """
    kind = "<" + image_type(dtype).numpy

    def run(table: pa.Table) -> pa.Table:
        z, y, x = (table.column(c).to_numpy() for c in ("z", "y", "x"))
        image = np.zeros((int(y.max()) + 1, int(x.max()) + 1), kind)
        v = table.column("v")
        if v.null_count:
            known = v.is_valid().to_numpy()
            y, x, v = y[known], x[known], v.drop_null()
        image[y, x] = v.to_numpy()
        ny, nx = image.shape
        out = {"z": pa.array([int(z[0])], pa.int32()), "ny": pa.array([ny], pa.int32()), "nx": pa.array([nx], pa.int32()), "dtype": [dtype], "pixels": pa.array([image.tobytes()], pa.binary())}
        if stats:
            known = image[y, x].astype(np.float64) if len(y) else np.zeros(1)
            out |= {k: [float(f(known))] for k, f in (("vmin", np.min), ("vmax", np.max), ("vmean", np.mean))}
        return pa.table(out)

    return px.select("z", "y", "x", F.col("v").cast("double").alias("v")).groupBy("z").applyInArrow(run, SECTION + STATS if stats else SECTION)
