"""Filter chains: an ordered list of options becomes one DataFrame transform."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dtypes import image_type
from ..operators import aggregates, neighborhood, numbering, pixels
from ..sources import text

Filter = Callable[[DataFrame], DataFrame]


def compose(filters: Sequence[Filter]) -> Filter:
    """Left to right; no filter is the identity."""
    return lambda df: reduce(lambda d, f: d.transform(f), filters, df)


def _ints(text: str, count: int) -> list[int]:
    parts = text.replace(",", " ").split()
    if len(parts) != count:
        raise ValueError(f"{count} integers expected, not {text!r}")
    return [int(p) for p in parts]


class _State:
    """An image stack inside a chain: its pixels, keys, shape and element type.

    After a crop to boxes of each section the shape is two more key columns.
    Boxes that several filters share, found ones (key None) or those of a file,
    are taken once.
    """

    def __init__(self, px: DataFrame, ny: int, nx: int, dtype: str) -> None:
        self.px, self.ny, self.nx, self.dtype, self.by = px, ny, nx, dtype, ["z"]
        self.columns = px.columns
        self.boxes: dict[str | None, DataFrame] = {}

    def rect(self, arg: str | None) -> list[int] | None:
        """The box given as ``t,l,b,r``; else each section's is joined as columns t, l, b, r:
        found in it (no argument, or ``.``) or read from a file, a line an image."""
        if arg and arg != "." and BOX.match(arg):
            return [int(k) for k in BOX.match(arg).groups()]
        key = None if not arg or arg == "." else arg
        if key not in self.boxes:
            if key is None:
                found = aggregates.foreground_area(self.px, self.ny, self.nx, by=self.by)
            else:
                images = numbering.numbered(self.px.select("z").distinct(), "z", name="ord")
                boxes = text.read_boxes(self.px.sparkSession, key)
                found = aggregates.forward_fill(images.join(boxes, "ord", "left")).join(images, "ord")
            self.boxes[key] = found.select("z", "t", "l", "b", "r")
        self.px = pixels.with_rect(self.px, self.boxes[key])
        return None

    def crop(self, arg: str | None) -> None:
        box = self.rect(arg)
        if box is not None:
            t, l, b, r = box
            self.px, self.ny, self.nx = pixels.crop(self.px, box), b - t + 1, r - l + 1
            return
        shaped = self.px.withColumns({NY: F.col("b") - F.col("t") + 1, NX: F.col("r") - F.col("l") + 1})
        self.px, self.ny, self.nx, self.by = pixels.crop(shaped), F.col(NY), F.col(NX), ["z", NY, NX]

    def pad(self, t: int, l: int, b: int, r: int) -> None:
        self.px = pixels.pad(self.px, t, l, b, r, self.ny, self.nx)
        if NY in self.by:
            self.px = self.px.withColumns({NY: F.col(NY) + (t + b), NX: F.col(NX) + (l + r)})
        else:
            self.ny, self.nx = self.ny + t + b, self.nx + l + r

    def to_float(self) -> None:
        if self.dtype == LABELS:
            self.px = pixels.labels_to_float(self.px, self.by)
        else:
            self.px = pixels.to_float(self.px, self.dtype, by=self.by)
        self.dtype = "float"

    def equalise(self, arg: str) -> None:
        target = None if arg.isdigit() else text.read_histogram(self.px.sparkSession, arg)
        self.px = neighborhood.equalise_type(self.px, self.dtype, int(arg) if target is None else None, target, by=self.by)

    def blur(self, sigma: float) -> None:
        integral = self.dtype == LABELS or image_type(self.dtype).integral
        self.px = neighborhood.gauss_blur(self.px, self.ny, self.nx, sigma, integral=integral, by=self.by)


#: Key columns of a section's shape once sections differ.
NY, NX = "lamella_ny", "lamella_nx"
#: Element type of relabelled images: the narrowest that holds a section's labels.
LABELS = "labels"
BOX = re.compile(r"\s*(\d+)[:;,\s]+(\d+)[:;,\s]+(\d+)[:;,\s]+(\d+)\s*$")


def parse(options: Sequence[tuple[str, str | None]], ny: int, nx: int, dtype: str = "byte") -> Filter:
    """The transform of ``options``, (name, argument) in the order given.

    Names, long or short: flip f, float F, label l, relabel r, sigma s, thresh
    t, histeq H (bins, or a file with the histogram to match), pad p, crop c,
    mirror m, bgzero 0.  A box is ``t,l,b,r``, ``.`` or nothing for the one found
    in each section, or a file with a line for each.  The sections' shape and
    element type follow every filter.
    """
    steps: list[Callable[[_State], None]] = []

    def pixelwise(f: Callable[[_State], DataFrame], dtype: str | None = None) -> Callable[[_State], None]:
        def run(s: _State) -> None:
            s.px = f(s)
            s.dtype = dtype or s.dtype

        return run

    def boxed(f, arg: str | None) -> Callable[[_State], None]:  # noqa: ANN001
        def run(s: _State) -> None:
            box = s.rect(arg)
            s.px = f(s, box)

        return run

    for name, arg in options:
        match name.lstrip("-"):
            case "flip" | "f":
                steps.append(pixelwise(lambda s: pixels.flip_up_down(s.px, s.ny)))
            case "float" | "F":
                steps.append(_State.to_float)
            case "label" | "l":
                steps.append(pixelwise(lambda s: neighborhood.label(s.px, s.by), "int"))
            case "relabel" | "r":
                steps.append(pixelwise(lambda s: neighborhood.relabel(s.px, s.by), LABELS))
            case "sigma" | "s":
                sigma = float(arg or "nan")
                if math.isnan(sigma) or sigma < 0:
                    raise ValueError(f"sigma must be 0 or more, not {arg!r}")
                steps.append(lambda s, g=sigma: s.blur(g))
            case "thresh" | "t":
                steps.append(pixelwise(lambda s, t=int(arg or ""): pixels.threshold(s.px, t), "bit"))
            case "histeq" | "H":
                steps.append(lambda s, a=arg or "64": s.equalise(a))
            case "pad" | "p":
                steps.append(lambda s, box=_ints(arg or "", 4): s.pad(*box))
            case "crop" | "c":
                steps.append(lambda s, a=arg: s.crop(a))
            case "mirror" | "m":
                steps.append(boxed(lambda s, box: pixels.mirror_background(s.px, box, s.ny, s.nx), arg))
            case "bgzero" | "0":
                steps.append(boxed(lambda s, box: pixels.fill_background(s.px, box), arg))
            case other:
                raise ValueError(f"unknown filter {other!r}")

    def run(px: DataFrame) -> DataFrame:
        state = _State(px, ny, nx, dtype)
        for step in steps:
            step(state)
        return state.px.select(*state.columns)

    return run
