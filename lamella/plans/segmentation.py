"""The plan of a whole segmentation as rows of a task graph.

A plan is a list of stages.  A stage runs once, or once for each section of the
training or the full stack; its arguments and files are templates over
sections.  Spark expands them, so a plan of many thousand sections is never
built in the driver.  The external programs are named, not replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the external programs.
MRC2STACK = "mrc2stack"
CONV_IMG = "conv_img"
GET_HISTOGRAM = "get_histogram"
COMBINE_POINTS = "combine_points"
IMODMOP = "imodmop"
POINT2MODEL = "point2model"
CHM_TRAIN = "CHM_train"
CHM_TEST = "CHM_test"
RF_TRAIN = "rf_train"
RF_PREDICT = "rf_predict"
GEN_TEXTON_DICT = "hnsGenTextonDict"
CALCULATE_WATERSHED_THRESHOLD = "hnsCalculateWatershedThreshold"
WATERSHED = "hnsWatershed"
MERGE = "hnsMerge"
GEN_MERGES = "hnsGenMerges"
GEN_BOUNDARY_FEATURES = "hnsGenBoundaryFeatures"
GEN_BOUNDARY_LABELS = "hnsGenBoundaryLabels"
SEGMENT = "hnsSegment"
GEN_ORDERED_CONTOURS = "hnsGenOrderedContours"

MB, GB = 1 << 20, 1 << 30
TRAIN, FULL = "train", "full"


@dataclass(frozen=True)
class Stack:
    path: str
    nx: int
    ny: int
    nz: int
    pixel_bytes: int = 1

    @property
    def pixels(self) -> int:
        return self.nx * self.ny

    @property
    def volume(self) -> int:
        return self.pixels * self.nz * self.pixel_bytes


@dataclass(frozen=True)
class Options:
    """Parameters of the plan; ``validate`` checks their ranges."""

    water_lvl: float | None = None
    contract: float = 0
    sigma: float = 1.0
    chm_nstage: int = 2
    chm_nlevel: int = 4
    chm_overlap: tuple[int, int] = (25, 25)
    histeq: bool = True
    num_trees: int = 255
    mtry: int = 0
    samp_size: float = 0.70
    pm_area_thresh0: int = 50
    pm_area_thresh1: int = 200
    pm_prop_thresh: float = 0.50
    jobs: int = 8

    def validate(self) -> None:
        def within(name: str, low: float, high: float = math.inf) -> None:
            v = getattr(self, name)
            if v is not None and not low <= v <= high:
                raise ValueError(f"{name} = {v} lies outside {low}..{high}")

        for name in ("water_lvl", "samp_size", "pm_prop_thresh"):
            within(name, 0, 1)
        for name in ("chm_nstage", "chm_nlevel", "num_trees", "pm_area_thresh0", "pm_area_thresh1", "jobs"):
            within(name, 1)
        within("sigma", 0)
        within("mtry", 0, 40)
        if len(self.chm_overlap) != 2 or min(self.chm_overlap) < 0:
            raise ValueError("chm_overlap takes two sizes")

    def settings(self) -> dict[str, str]:
        """What a task may refer to; a changed one makes its tasks stale."""
        return {f.name: str(getattr(self, f.name)) for f in fields(self) if f.name != "jobs"}


#: Files of a section: stack, folder, ending.
KINDS = {
    "train.raw": (TRAIN, "train_raw", "tif"), "full.raw": (FULL, "full_raw", "tif"),
    "train.smooth": (TRAIN, "train_smooth", "mha"), "full.smooth": (FULL, "full_smooth", "mha"),
    "train.mask": (TRAIN, "train_mask", "tif"), "train.labels": (TRAIN, "train_labels", "mha"),
    "train.chm": (TRAIN, "chm/train", "mat"), "full.chm": (FULL, "full_chm", "tif"),
    **{f"{s}.{k}": (s, f"{s}_{k}", e) for s in (TRAIN, FULL) for k, e in (("prob", "mha"), ("prob_smooth", "mha"), ("first", "mha"), ("merged", "mha"), ("tree", "ssv"), ("saliency", "ssv"), ("features", "ssv"))},
    "train.truth": (TRAIN, "train_truth", "ssv"), "full.predicted": (FULL, "full_predicted", "ssv"),
    "full.segments": (FULL, "full_segments", "mha"), "full.points": (FULL, "full_points", "pts"),
}


@dataclass(frozen=True)
class Of:
    """The file of a kind that belongs to the stage's section."""

    kind: str


@dataclass(frozen=True)
class All:
    """Those of all sections, each with the words before it: ``All(("-v", kind), ("-l", kind))`` alternates."""

    pairs: tuple

    def __init__(self, *pairs) -> None:  # noqa: ANN002
        object.__setattr__(self, "pairs", tuple(p if isinstance(p, tuple) else (p,) for p in pairs))


Z = object()


@dataclass(frozen=True)
class Stage:
    program: str
    over: str | None
    args: Sequence
    ins: Sequence
    outs: Sequence
    settings: tuple[str, ...] = ()
    cpu: int = 1
    mem: int = MB


def masks(model: str, stack: str, out: str, contract: float, *, colour: bool) -> list[str]:
    """Arguments that paint a model's contours over a stack: coloured, or inverted in black and white."""
    kind = ["-color", "-mask", "255"] if colour else ["-mask", "1", "-invert", "-mode", "0"]
    return [IMODMOP, *kind, *(["-pad", f"{-contract:g}"] if contract else []), model, stack, out]


def stages(train: Stack, model: str, full: Stack, out: str, o: Options) -> list[Stage]:
    """All stages in the order of the work: conversion, membranes, training, segmentation, contours."""
    base, ram = 20 * MB, {TRAIN: train, FULL: full}
    most = max(o.jobs * 3 // 4, min(o.jobs, 2))
    blur, level = f"-s{o.sigma:g}", "waterlevel.txt"
    hist = ["-Hhistogram.txt"] if o.histeq else []
    merge = [str(o.pm_area_thresh0), str(o.pm_area_thresh1), f"{o.pm_prop_thresh:g}"]
    limits = ("pm_area_thresh0", "pm_area_thresh1", "pm_prop_thresh")
    nets = ["chm/param.mat", f"chm/MODEL_level0_stage{o.chm_nstage}.mat", *(f"chm/MODEL_level{k}_stage{s}.mat" for k in range(1, o.chm_nstage) for s in range(o.chm_nlevel + 1))]
    from_hist = ["histogram.txt"] if o.histeq else []

    plan = [
        Stage(MRC2STACK, None, ["-etif", train.path, "train_raw"], [train.path], [All("train.raw")], (), 1, base + 2 * train.volume),
        Stage(MRC2STACK, None, ["-emha", blur, "-F", train.path, "train_smooth"], [train.path], [All("train.smooth")], ("sigma",), 1, base + train.volume + 4 * train.pixels),
        Stage(MRC2STACK, None, ["-etif", *hist, full.path, "full_raw"], [full.path, *from_hist], [All("full.raw")], ("histeq",), 1, base + 2 * full.volume),
        Stage(MRC2STACK, None, ["-emha", *hist, blur, "-F", full.path, "full_smooth"], [full.path, *from_hist], [All("full.smooth")], ("sigma", "histeq"), 1, base + full.volume + 4 * full.pixels),
        Stage(IMODMOP, None, masks(model, train.path, "mask.mrc", o.contract, colour=False)[1:], [model, train.path], ["mask.mrc"], ("contract",), 1, base + train.volume + train.pixels),
        Stage(IMODMOP, None, masks(model, train.path, "labels.mrc", o.contract, colour=True)[1:], [model, train.path], ["labels.mrc"], ("contract",), 1, base + train.volume + 3 * train.pixels),
        Stage(MRC2STACK, None, ["-etif", "mask.mrc", "train_mask"], ["mask.mrc"], [All("train.mask")], (), 1, base + 2 * train.pixels),
        Stage(MRC2STACK, None, ["-emha", "-r", "labels.mrc", "train_labels"], ["labels.mrc"], [All("train.labels")], (), 1, base + 7 * train.pixels),
        Stage(CHM_TRAIN, None, [f"train_raw/####.tif;0-{train.nz - 1}", f"train_mask/####.tif;0-{train.nz - 1}", "-m", "chm", "-S", str(o.chm_nstage), "-L", str(o.chm_nlevel)], [All("train.raw"), All("train.mask")], [All("train.chm"), *nets], ("chm_nstage", "chm_nlevel"), max(o.jobs - most, 1), 75 * GB),
        Stage(CHM_TEST, FULL, [Of("full.raw"), "full_chm", "-s", "-m", "chm", "-b", f"{train.nx}x{train.ny}", "-o", "{}x{}".format(*o.chm_overlap)], [Of("full.raw"), *nets], [Of("full.chm")], ("chm_overlap",), 1, 10 * GB),
    ]
    if o.histeq:
        plan.append(Stage(GET_HISTOGRAM, None, [All("train.raw"), "histogram.txt"], [All("train.raw")], ["histogram.txt"], ("histeq",), 1, base + 2 * train.volume))
    for s, flag in ((TRAIN, []), (FULL, ["-F"])):
        chm, prob, smooth = (Of(f"{s}.{k}") for k in ("chm", "prob", "prob_smooth"))
        plan.append(Stage(CONV_IMG, s, [*flag, chm, prob], [chm], [prob], (), 1, base + 6 * ram[s].pixels))
        copy = Stage("cp", s, [prob, smooth], [prob], [smooth], ("sigma",), 1, base)
        plan.append(Stage(CONV_IMG, s, [blur, *flag, chm, smooth], [chm], [smooth], ("sigma",), 1, base + 6 * ram[s].pixels) if o.sigma else copy)
    plan.append(Stage(GEN_TEXTON_DICT, None, [All(("-v", "train.smooth"), ("-l", "train.labels")), "textures.ssv"], [All("train.smooth"), All("train.labels")], ["textures.ssv"], (), most))
    known = o.water_lvl is not None
    if not known:
        plan.append(Stage(CALCULATE_WATERSHED_THRESHOLD, None, ["0", str(train.nz - 1), "train_prob_smooth/%04d.mha", "train_labels/%04d.mha", *merge], [All("train.prob_smooth"), All("train.labels")], [level], ("water_lvl", *limits), 4))
    for s in (TRAIN, FULL):
        smooth, first, merged, tree, saliency, raw, prob, found = (Of(f"{s}.{k}") for k in ("prob_smooth", "first", "merged", "tree", "saliency", "smooth", "prob", "features"))
        plan += [
            Stage(WATERSHED, s, [smooth, f"{o.water_lvl:g}" if known else level, first], [smooth] if known else [smooth, level], [first], ("water_lvl",)),
            Stage(MERGE, s, [first, smooth, *merge, merged], [first, smooth], [merged], limits),
            Stage(GEN_MERGES, s, [merged, smooth, tree, saliency], [merged, smooth], [tree, saliency]),
            Stage(GEN_BOUNDARY_FEATURES, s, [merged, tree, saliency, raw, prob, "textures.ssv", found], [merged, tree, saliency, raw, prob, "textures.ssv"], [found]),
        ]
    truth = [Of("train.merged"), Of("train.tree"), Of("train.labels")]
    plan.append(Stage(GEN_BOUNDARY_LABELS, TRAIN, [*truth, Of("train.truth")], truth, [Of("train.truth")]))
    plan.append(Stage(RF_TRAIN, None, [All(("-f", "train.features"), ("-l", "train.truth")), str(o.num_trees), str(o.mtry), f"{o.samp_size:g}", "1", "forest"], [All("train.features"), All("train.truth")], ["forest"], ("num_trees", "mtry", "samp_size")))
    done = [Of("full.merged"), Of("full.tree"), Of("full.predicted")]
    plan += [
        Stage(SEGMENT, FULL, [*done, Of("full.segments")], done, [Of("full.segments")]),
        Stage(GEN_ORDERED_CONTOURS, FULL, [Of("full.segments"), Z, Of("full.points")], [Of("full.segments")], [Of("full.points")]),
        Stage(COMBINE_POINTS, None, [All("full.points"), "all.pts"], [All("full.points")], ["all.pts"]),
        Stage(POINT2MODEL, None, ["-im", full.path, "all.pts", out], [full.path, "all.pts"], [out]),
    ]
    return plan


def _file(kind: str, z: Column) -> Column:
    _, folder, ending = KINDS[kind]
    return F.format_string(f"{folder}/%04d.{ending}", z)


def _words(tokens: Sequence, z: Column, sizes: dict[str, int], sections: Column | None = None) -> Column:
    """The words that tokens stand for, as one array of strings."""

    def part(token) -> Column:  # noqa: ANN001
        if token is Z:
            return F.array(z.cast("string"))
        if isinstance(token, Of):
            return F.array(_file(token.kind, z))
        if isinstance(token, All):
            stack = KINDS[token.pairs[0][-1]][0]
            every = F.sequence(F.lit(0), F.lit(sizes[stack] - 1)) if sections is None else sections
            return F.flatten(F.transform(every, lambda k: F.array(*(w for p in token.pairs for w in (*map(F.lit, p[:-1]), _file(p[-1], k))))))
        return F.array(F.lit(str(token)))

    return F.concat(*map(part, tokens)) if tokens else F.array().cast("array<string>")


def _rows(program: str, base: DataFrame, stage: Stage, sizes: dict[str, int], sections: Column | None = None) -> DataFrame:
    z = F.col("z")
    words = lambda t: _words(t, z, sizes, sections)
    return base.select(
        F.concat(F.array(F.lit(program)), words(stage.args)).alias("args"), words(stage.ins).alias("ins"), words(stage.outs).alias("outs"),
        F.array(*map(F.lit, stage.settings)).cast("array<string>").alias("settings"), F.lit(stage.cpu).alias("cpu"), F.lit(stage.mem).cast("long").alias("mem"),
    )


def plan(spark: SparkSession, train: Stack, model: str, full: Stack, out: str, options: Options | None = None) -> DataFrame:
    """(task, program, args, ins, outs, settings, cpu, mem), a row for each task.

    Predictions go in as many groups of neighbouring sections as there are jobs,
    sizes differing by one at most, the larger first.
    """
    o = options or Options()
    o.validate()
    sizes = {TRAIN: train.nz, FULL: full.nz}
    parts = []
    for stage in stages(train, model, full, out, o):
        base = spark.range(sizes[stage.over] if stage.over else 1).select(F.col("id").cast("int").alias("z"))
        parts.append(_rows(stage.program, base, stage, sizes))
    groups = min(o.jobs, full.nz)
    size, more = divmod(full.nz, groups)
    first = F.col("z") * size + F.least("z", F.lit(more))
    own = F.sequence(first, first + size - 1 + (F.col("z") < more).cast("int"))
    both = All(("-f", "full.features"), ("-p", "full.predicted"))
    predict = Stage(RF_PREDICT, None, ["forest", "1", both], ["forest", All("full.features")], [All("full.predicted")])
    parts.append(_rows(RF_PREDICT, spark.range(groups).select(F.col("id").cast("int").alias("z")), predict, sizes, own))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(F.concat_ws(" ", "args").alias("task"), F.col("args")[0].alias("program"), "*")


def tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(tasks, task_in, task_out, task_setting) of a plan, for the task graph's operators."""
    tasks = rows.select("task", F.lit("proc").alias("kind"), "cpu", "mem", F.lit(False).alias("done"))
    return tasks, *(rows.select("task", F.explode(many).alias(one)) for many, one in (("ins", "file"), ("outs", "file"), ("settings", "setting")))
