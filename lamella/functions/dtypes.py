"""Element types of images: Spark types, ranges, and codes in the file formats."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class ImageType:
    """``numpy`` is the stored type (None for RGB), ``spark`` holds every value of it.

    ``low`` and ``high`` are an integer type's limits; float types have (0, 1).
    ``mrc`` and ``meta`` are the format's names, None where the format lacks it.
    """

    name: str
    numpy: str
    spark: str
    low: int
    high: int
    integral: bool = True
    mrc: int | None = None
    meta: str | None = None


RGB_STRUCT = "struct<R:smallint,G:smallint,B:smallint>"

# Fixed values of the MRC and MetaImage formats.
TYPES = {
    t.name: t
    for t in (
        ImageType("bit", "?", "boolean", 0, 1),
        ImageType("byte", "u1", "smallint", 0, 2**8 - 1, mrc=0, meta="MET_UCHAR"),
        ImageType("sbyte", "i1", "tinyint", -(2**7), 2**7 - 1, mrc=0, meta="MET_CHAR"),
        ImageType("short", "i2", "smallint", -(2**15), 2**15 - 1, mrc=1, meta="MET_SHORT"),
        ImageType("ushort", "u2", "int", 0, 2**16 - 1, mrc=6, meta="MET_USHORT"),
        ImageType("int", "i4", "int", -(2**31), 2**31 - 1, meta="MET_INT"),
        ImageType("uint", "u4", "bigint", 0, 2**32 - 1, meta="MET_UINT"),
        ImageType("long", "i8", "bigint", -(2**63), 2**63 - 1, meta="MET_LONG"),
        ImageType("ulong", "u8", "decimal(20,0)", 0, 2**64 - 1, meta="MET_ULONG"),
        ImageType("rgb24", "u1", RGB_STRUCT, 0, 2**8 - 1, mrc=16, meta="MET_UCHAR_ARRAY"),
        ImageType("float", "f4", "float", 0, 1, integral=False, mrc=2, meta="MET_FLOAT"),
        ImageType("double", "f8", "double", 0, 1, integral=False, meta="MET_DOUBLE"),
    )
}

#: From narrow to wide: what an image of labels may shrink to.
UNSIGNED = ("bit", "byte", "ushort", "uint", "ulong")


def image_type(name: str) -> ImageType:
    if name not in TYPES:
        raise ValueError(f"unknown image type {name!r}; known: {', '.join(TYPES)}")
    return TYPES[name]


def narrowest_unsigned(highest: int) -> ImageType:
    """The narrowest unsigned type that holds 0..highest; OverflowError if none does."""
    for name in UNSIGNED:
        if highest <= TYPES[name].high:
            return TYPES[name]
    raise OverflowError(f"{highest} exceeds 64 unsigned bits")


def itemsize(t: ImageType) -> int:
    return np.dtype(t.numpy).itemsize * (3 if t.name == "rgb24" else 1)
