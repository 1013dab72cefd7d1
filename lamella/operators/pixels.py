"""Per-pixel operators on images in long form.

An image is a set of rows: key columns (``by``, one section for each value),
``y``, ``x`` and ``v``, dense from (0, 0).  Boxes include both ends.
Projections here add no shuffle and stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dtypes import UNSIGNED, image_type

BY = ("z",)


def size(n: int | Column) -> Column:
    """A number of rows or columns: one for all sections, or a key column of each."""
    return n if isinstance(n, Column) else F.lit(n)


def threshold(px: DataFrame, t: int = 1) -> DataFrame:
    """True where v >= t; a negative or zero ``t`` selects v < -t instead."""
    return px.withColumn("v", F.col("v") >= t if t > 0 else F.col("v") < -t)


def rescale(px: DataFrame, low: float, high: float, to: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Linear map of [low, high] to ``to``, as double."""
    k = (to[1] - to[0]) / (high - low)
    return px.withColumn("v", (F.col("v").cast("double") - F.lit(float(low))) * F.lit(k) + F.lit(float(to[0])))


def to_float(px: DataFrame, dtype: str, to: tuple[float, float] = (0.0, 1.0), by: Sequence[str] = BY) -> DataFrame:
    """Map an image of ``dtype`` to floats: integers from their type's range.

    Float images map from (0, 1), or from their own range if a section leaves
    it; that takes one aggregate per section, joined back as a small table.
    """
    t = image_type(dtype)
    if t.integral:
        return rescale(px, t.low, t.high, to)
    ends = px.groupBy(*by).agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    inside = (F.col("lo") >= 0) & (F.col("hi") <= 1)
    ends = ends.select(*by, F.when(inside, F.lit(0.0)).otherwise(F.col("lo")).alias("lo"), F.when(inside, F.lit(1.0)).otherwise(F.col("hi")).alias("hi"))
    span = F.col("hi") - F.col("lo")
    k = F.when(span == 0, F.lit(0.0)).otherwise(F.lit(to[1] - to[0]) / span)
    return px.join(ends, list(by)).withColumn("v", (F.col("v").cast("double") - F.col("lo")) * k + F.lit(float(to[0]))).drop("lo", "hi")


def labels_to_float(px: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Labels 0..n of each section by the range of the narrowest type that holds n."""
    top = px.groupBy(*by).agg(F.max("v").alias("top"))
    span = F.lit(None).cast("double")
    for name in reversed(UNSIGNED):
        span = F.when(F.col("top") <= F.lit(str(int(image_type(name).high))).cast("decimal(20,0)"), F.lit(float(image_type(name).high))).otherwise(span)
    return px.join(top.select(*by, span.alias("span")), list(by)).withColumn("v", F.col("v").cast("double") / F.col("span")).drop("span")


def flip_up_down(px: DataFrame, ny: int | Column) -> DataFrame:
    return px.withColumn("y", size(ny) - 1 - F.col("y"))


def _edge(rect: Sequence[int] | None) -> tuple[Column, Column, Column, Column]:
    return tuple(F.lit(v) for v in rect) if rect is not None else (F.col("t"), F.col("l"), F.col("b"), F.col("r"))


def with_rect(px: DataFrame, rects: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Attach the box (t, l, b, r) of each section: one row a section joins many pixels."""
    return px.join(rects.select(*by, "t", "l", "b", "r"), list(by))


def crop(px: DataFrame, rect: Sequence[int] | None = None) -> DataFrame:
    """Rows inside (t, l, b, r), moved to the origin; columns t, l, b, r if no rect is given."""
    t, l, b, r = _edge(rect)
    out = px.where(F.col("y").between(t, b) & F.col("x").between(l, r)).withColumns({"y": F.col("y") - t, "x": F.col("x") - l})
    return out if rect is not None else out.drop("t", "l", "b", "r")


def pad(px: DataFrame, t: int, l: int, b: int, r: int, ny: int | Column, nx: int | Column) -> DataFrame:
    """Zeros around: only the frame is generated, pixels just move."""
    moved = px.withColumns({"y": F.col("y") + t, "x": F.col("x") + l})
    keys = [c for c in px.columns if c not in ("y", "x", "v")]
    inside = F.col("y").between(t, size(ny) + (t - 1)) & F.col("x").between(l, size(nx) + (l - 1))
    frame = (
        px.where("y = 0 and x = 0").select(*keys)
        .withColumn("y", F.explode(F.sequence(F.lit(0), size(ny) + (t + b - 1))))
        .withColumn("x", F.explode(F.sequence(F.lit(0), size(nx) + (l + r - 1))))
        .where(~inside)
        .withColumn("v", F.lit(0).cast(px.schema["v"].dataType))
    )
    return moved.unionByName(frame)


def fill_background(px: DataFrame, rect: Sequence[int] | None = None, value: int = 0) -> DataFrame:
    """``value`` outside the box."""
    t, l, b, r = _edge(rect)
    inside = F.col("y").between(t, b) & F.col("x").between(l, r)
    out = px.withColumn("v", F.when(inside, F.col("v")).otherwise(F.lit(value).cast(px.schema["v"].dataType)))
    return out if rect is not None else out.drop("t", "l", "b", "r")


def mirror_background(px: DataFrame, rect: Sequence[int] | None, ny: int | Column, nx: int | Column) -> DataFrame:
    """Outside the box, the pixel that lies symmetric to the nearest edge; corners reflect twice.

    Scatter, not gather: each inner pixel emits the places it fills, so there is
    no self-join.  A place whose reflection lies outside the box keeps its value.
    The box is that of columns t, l, b, r if none is given.
    """
    t, l, b, r = _edge(rect)

    def places(c: str, lo: Column, hi: Column, n: int | Column) -> Column:
        """Where coordinate ``c`` appears: itself and its images across both edges."""
        own, before, after = F.col(c), lo * 2 - 1 - F.col(c), hi * 2 + 1 - F.col(c)
        out = F.array(own, F.when((before >= 0) & (before < lo), before), F.when((after > hi) & (after < size(n)), after))
        return F.filter(out, lambda p: p.isNotNull())

    inner = px.where(F.col("y").between(t, b) & F.col("x").between(l, r))
    spread = inner.withColumn("y", F.explode(places("y", t, b, ny))).withColumn("x", F.explode(places("x", l, r, nx)))

    def reached(c: str, lo: Column, hi: Column) -> Column:
        s = F.when(F.col(c) < lo, lo * 2 - 1 - F.col(c)).when(F.col(c) > hi, hi * 2 + 1 - F.col(c)).otherwise(F.col(c))
        return s.between(lo, hi)

    out = spread.unionByName(px.where(~(reached("y", t, b) & reached("x", l, r))))
    return out if rect is not None else out.drop("t", "l", "b", "r")


def select_sections(px: DataFrame, spec: str, nz: int) -> DataFrame:
    """Sections named by ``3,5-9``: union of ranges, each once; out of 0..nz-1 raises."""
    wanted = parse_selection(spec)
    if wanted[0] < 0 or wanted[-1] >= nz:
        raise ValueError(f"sections {spec} lie outside 0..{nz - 1}")
    return px.where(F.col("z").isin(wanted))


def slice_sections(px: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Sections ``start`` to ``stop``, the latter left out, every ``step``-th; their numbers stay."""
    if step < 1 or start is not None and start < 0 or stop is not None and stop < 0:
        raise ValueError("start, stop and step must be positive")
    first = start or 0
    wanted = (F.col("z") >= first) & ((F.col("z") - first) % step == 0)
    return px.where(wanted if stop is None else wanted & (F.col("z") < stop))


def pair_sections(left: DataFrame, right: DataFrame, on: Sequence[str] = ("z", "y", "x"), names: tuple[str, str] = ("v", "label")) -> DataFrame:
    """Images beside the labels, or other images, of the same number: the values of both."""
    return left.select(*on, F.col("v").alias(names[0])).join(right.select(*on, F.col("v").alias(names[1])), list(on))


def remove_all(px: DataFrame) -> DataFrame:
    """No section left."""
    return px.where(F.lit(False))


def empty_header(header: DataFrame) -> DataFrame:
    """The header of a stack whose sections were all removed: no sections, no statistics."""
    zero = {c: F.lit(0.0) for c in ("zlen", "amin", "amax", "amean") if c in header.columns}
    return header.withColumns({c: F.lit(0) for c in ("nz", "mz") if c in header.columns} | zero)


def parse_selection(spec: str) -> list[int]:
    out: set[int] = set()
    for part in spec.split(","):
        first, dash, last = part.strip().partition("-")
        if not first.isdigit() or dash and not last.isdigit():
            raise ValueError(f"not a section or range: {part!r}")
        if dash and int(last) < int(first):
            raise ValueError(f"range runs backwards: {part!r}")
        out.update(range(int(first), int(last or first) + 1))
    return sorted(out)


def view(px: DataFrame, x: tuple[int, int], y: tuple[int, int], z: tuple[int, int]) -> DataFrame:
    """A box over a stack, moved to the origin."""
    return px.where(F.col("x").between(*x) & F.col("y").between(*y) & F.col("z").between(*z)).withColumns({"x": F.col("x") - x[0], "y": F.col("y") - y[0], "z": F.col("z") - z[0]})


def view_header(header: DataFrame, x: tuple[int, int], y: tuple[int, int], z: tuple[int, int]) -> DataFrame:
    """The header of a view: extents follow the box, spacing stays, the origin moves.

    Minimum, maximum and mean are those of the whole stack.
    """
    cols = {}
    for a, (lo, hi) in zip("xyz", (x, y, z), strict=True):
        spacing = F.col(f"{a}len") / F.col(f"m{a}")
        cols |= {f"n{a}": F.lit(hi - lo + 1), f"m{a}": F.lit(hi - lo + 1), f"{a}len": spacing * (hi - lo + 1), f"{a}org": F.col(f"{a}org") - spacing * lo}
    return header.withColumns(cols)


def spacing(header: DataFrame) -> DataFrame:
    return header.select(*((F.col(f"{a}len") / F.col(f"m{a}")).alias(f"spacing_{a}") for a in "xyz"))


def set_spacing(header: DataFrame, x: float, y: float, z: float) -> DataFrame:
    return header.withColumns({f"{a}len": F.col(f"m{a}") * F.lit(s) for a, s in zip("xyz", (x, y, z), strict=True)})


def append_stack(px: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` after the last section of ``px``; the offset is one aggregate row."""
    offset = px.agg(F.coalesce(F.max("z") + 1, F.lit(0)).alias("dz"))
    return px.unionByName(more.crossJoin(F.broadcast(offset)).withColumn("z", (F.col("z") + F.col("dz")).cast(px.schema["z"].dataType)).drop("dz"))


def overwrite_sections(px: DataFrame, new: DataFrame) -> DataFrame:
    """Sections of ``new`` take the place of those with the same z."""
    return px.join(new.select("z").distinct(), "z", "left_anti").unionByName(new)


def drop_tail(px: DataFrame, nz: int, count: int = 1) -> DataFrame:
    return px.where(F.col("z") < nz - count)


def add_label(header: DataFrame, text: str) -> DataFrame:
    """Append to ``labels`` and keep the last ten."""
    more = F.concat("labels", F.array(F.rpad(F.lit(text), 80, " ")))
    return header.withColumn("labels", F.slice(more, F.greatest(F.lit(1), F.size(more) - 9), 10))
