"""Task graphs: tasks joined by the files they write and read.

Tables: ``task_in(task, file)``, ``task_out(task, file)``,
``task_setting(task, setting)``, ``tasks(task, kind, cpu, mem, done)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import stored


class GraphError(ValueError):
    """A task graph that breaks a rule."""


def edges(task_in: DataFrame, task_out: DataFrame) -> DataFrame:
    """(src, dst): dst reads a file that src writes."""
    return task_out.select("file", F.col("task").alias("src")).join(task_in.select("file", F.col("task").alias("dst")), "file").select("src", "dst").distinct()


def overall_inputs(task_in: DataFrame, task_out: DataFrame) -> DataFrame:
    return task_in.select("file").subtract(task_out.select("file"))


def overall_outputs(task_in: DataFrame, task_out: DataFrame) -> DataFrame:
    return task_out.select("file").subtract(task_in.select("file"))


def generators(tasks: DataFrame, task_in: DataFrame) -> DataFrame:
    """Tasks that read nothing."""
    return tasks.join(task_in, "task", "left_anti")


def cleanups(tasks: DataFrame, task_out: DataFrame) -> DataFrame:
    """Tasks that write nothing."""
    return tasks.join(task_out, "task", "left_anti")


def first_tasks(tasks: DataFrame, task_in: DataFrame, task_out: DataFrame) -> DataFrame:
    """Tasks with no task before them."""
    return tasks.join(edges(task_in, task_out).select(F.col("dst").alias("task")), "task", "left_anti")


def last_tasks(tasks: DataFrame, task_in: DataFrame, task_out: DataFrame) -> DataFrame:
    """Tasks that no task follows."""
    return tasks.join(edges(task_in, task_out).select(F.col("src").alias("task")), "task", "left_anti")


def closure(links: DataFrame) -> DataFrame:
    """(src, dst) over one link or more, each pair once.

    Every round joins the pairs that the last one found to all pairs so far, so
    distances double and rounds grow with the logarithm of the depth.  A round's
    result is a stored table, and what it found is stored with all before as one:
    plans don't grow.  A cycle shows as a pair with src = dst.  The result holds
    a row for each pair: use :func:`reachable`, :func:`descendant_counts` or
    :func:`on_cycles` where they do.
    """
    links = stored(links.select("src", "dst").distinct(), "links")
    found = fresh = links
    while True:
        step = found.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
        more = fresh.join(step, "dst").select("src", F.col("next").alias("dst")).distinct().join(found, ["src", "dst"], "left_anti")
        fresh = stored(more, "closure")
        if fresh.isEmpty():
            return found
        found = stored(found.unionByName(fresh), "closure")


def reachable(links: DataFrame, start: DataFrame) -> DataFrame:
    """(task): ``start`` and all that follows it."""
    seen = fresh = stored(start.select("task").distinct(), "reach")
    while True:
        more = fresh.join(links, fresh["task"] == links["src"]).select(F.col("dst").alias("task")).distinct().join(seen, "task", "left_anti")
        fresh = stored(more, "reach")
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)


def tree_counts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(task, n_after) where no task has two predecessors: a row for each task, in all rounds.

    A row counts the task and what lies less than 2^k steps behind it and names
    the ancestor 2^k steps ahead; a round adds each row to its ancestor's and
    doubles the distance.  On a cycle it raises GraphError.
    """
    up = nodes.select("task").distinct().join(links.select(F.col("dst").alias("task"), F.col("src").alias("up")), "task", "left")
    state = stored(up.withColumn("n", F.lit(1).cast("long")), "counts")
    n_tasks = state.count()
    for _ in range(max(1, n_tasks).bit_length() + 1):
        if state.where("up is not null").isEmpty():
            return state.select("task", (F.col("n") - 1).alias("n_after"))
        more = state.where("up is not null").groupBy(F.col("up").alias("task")).agg(F.sum("n").alias("more"))
        ahead = state.select(F.col("task").alias("up"), F.col("up").alias("next"))
        step = state.join(more, "task", "left").join(ahead, "up", "left")
        state = stored(step.select("task", F.col("next").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "counts")
    raise GraphError("the graph has a cycle")


def descendant_counts(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """``n_after``: how many tasks follow each, directly or not.

    Where every task has at most one predecessor the counts are sums over
    subtrees; else descendants that are reached over several ways have to be told
    apart, and the closure holds a row for each pair.
    """
    links = stored(links.select("src", "dst").distinct(), "links")
    if links.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        counts = tree_counts(tasks.select("task").unionByName(links.select(F.col("src").alias("task"))), links)
    else:
        counts = closure(links).groupBy(F.col("src").alias("task")).agg(F.count("*").alias("n_after"))
    return tasks.join(counts, "task", "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))


def on_cycles(links: DataFrame) -> DataFrame:
    """The links left when tasks without a predecessor, or without a successor, are taken away
    again and again: none where there is no cycle.  Links only get fewer."""
    left = stored(links.select("src", "dst").distinct(), "links")
    n = left.count()
    while n:
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = kept.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = stored(kept.select("src", "dst"), "links")
        before, n = n, left.count()
        if n == before:
            break
    return left


def mark_done(tasks: DataFrame, links: DataFrame, done: DataFrame) -> DataFrame:
    """``done`` tasks and all before them become done."""
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    marked = reachable(back, done).withColumn("marked", F.lit(True))
    return tasks.join(marked, "task", "left").withColumn("done", F.coalesce("marked", "done")).drop("marked")


def frontier(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """Tasks that aren't done and whose predecessors all are."""
    waiting = links.join(tasks.where(~F.col("done")).select(F.col("task").alias("src")), "src", "left_semi").select(F.col("dst").alias("task"))
    return tasks.where(~F.col("done")).join(waiting, "task", "left_anti")


def ranked(ready: DataFrame, n_tasks: int) -> DataFrame:
    """``prio``: the task with the most descendants first (ready has n_after)."""
    return ready.withColumn("prio", F.lit(n_tasks) - F.col("n_after"))


def best_fit(ready: DataFrame, cpu: int, mem: int) -> DataFrame:
    """The first task by (prio, kind, task) that fits the free resources: a top-1, no full sort."""
    return ready.where((F.col("cpu") <= cpu) & (F.col("mem") <= mem)).orderBy("prio", "kind", "task").limit(1)


def status(tasks: DataFrame, running: DataFrame) -> DataFrame:
    """Counts of done, running and all tasks, and what the running ones use."""
    state = tasks.join(running.select("task", F.lit(True).alias("running")), "task", "left").withColumn("running", F.coalesce("running", F.lit(False)))
    use = lambda c: F.coalesce(F.sum(F.when(F.col("running"), F.col(c))), F.lit(0)).alias(f"{c}_used")
    return state.agg(F.count_if("done").alias("n_done"), F.count_if("running").alias("n_running"), F.count("*").alias("n_tasks"), use("cpu"), use("mem"))


def shown_name(name: str = "task") -> F.Column:
    """Long names keep their first 56 characters and the last one."""
    c = F.col(name).cast("string")
    return F.when(F.length(c) > 60, F.concat(F.left(c, F.lit(56)), F.lit("..."), F.right(c, F.lit(1)))).otherwise(c)


def elapsed(seconds: str) -> F.Column:
    """h:mm:ss"""
    s = F.col(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def changed_settings(old: DataFrame, new: DataFrame) -> DataFrame:
    """(k): settings that are new or whose text differs from before."""
    return new.join(old.withColumnRenamed("v", "old"), "k", "left").where(~F.col("v").cast("string").eqNullSafe(F.col("old").cast("string"))).select("k")


def stale(tasks: DataFrame, task_in: DataFrame, task_out: DataFrame, log: DataFrame, files: DataFrame, task_setting: DataFrame | None = None, old: DataFrame | None = None, new: DataFrame | None = None) -> DataFrame:
    """(task): what has to run again.

    Not logged, a referenced setting new or changed, an existing input as young
    as the logged time or younger, an output missing; and all that follows.
    ``log`` is (task, ts) with one row a task, ``files`` (file, present, mtime).
    """
    logged = log.select("task", "ts")
    ins = task_in.join(logged, "task").join(files.where("present"), "file").where("mtime >= ts").select("task")
    outs = task_out.join(files.where("present").select("file"), "file", "left_anti").select("task")
    parts = [tasks.select("task").join(logged, "task", "left_anti"), ins, outs]
    if task_setting is not None:
        parts.append(task_setting.join(changed_settings(old, new).withColumnRenamed("k", "setting"), "setting", "left_semi").select("task"))
    direct = reduce(DataFrame.unionByName, parts).distinct().join(tasks.select("task"), "task", "left_semi")
    return reachable(edges(task_in, task_out), direct)


def done_after(tasks: DataFrame, log: DataFrame, stale_tasks: DataFrame) -> DataFrame:
    """Logged tasks that still exist and aren't stale, by time of completion."""
    return log.select("task", "ts").join(tasks.select("task"), "task", "left_semi").join(stale_tasks, "task", "left_anti")


def check(task_in: DataFrame, task_out: DataFrame, task_setting: DataFrame | None = None, settings: DataFrame | None = None) -> None:
    """Raise GraphError for a self-loop, a file of two tasks, an unknown setting or a cycle."""
    loops = task_in.join(task_out, ["task", "file"], "left_semi")
    if not loops.isEmpty():
        raise GraphError(f"a task reads a file that it writes: {loops.first()}")
    twice = task_out.groupBy("file").agg(F.count_distinct("task").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise GraphError(f"a file has several producers: {twice.first()}")
    if task_setting is not None:
        unknown = task_setting.select("setting").subtract(settings.select(F.col("k").alias("setting")))
        if not unknown.isEmpty():
            raise GraphError(f"unknown setting: {unknown.first()}")
    cycle = on_cycles(edges(task_in, task_out))
    if not cycle.isEmpty():
        raise GraphError(f"the graph has a cycle through {cycle.first()['src']}")


def add_tasks(task_in: DataFrame, task_out: DataFrame, new_in: DataFrame, new_out: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(overall inputs, overall outputs) after tasks with these files joined the graph."""
    ins, outs = task_in.select("file").unionByName(new_in.select("file")), task_out.select("file").unionByName(new_out.select("file"))
    return ins.subtract(outs), outs.subtract(ins)


def find(tasks: DataFrame, name) -> DataFrame:  # noqa: ANN001
    """The task of this name, or no row."""
    return tasks.where(F.col("task") == F.lit(name))


def done_list(log: DataFrame) -> DataFrame:
    """Log rows by time of completion, then by name."""
    return log.orderBy("ts", "task")


def listing(tasks: DataFrame, running: DataFrame) -> DataFrame:
    """(task, state) of tasks that aren't done, running ones first, each kind by name."""
    state = tasks.where(~F.col("done")).join(running.select("task", F.lit("running").alias("state")), "task", "left")
    return state.select("task", F.coalesce("state", F.lit("waiting")).alias("state")).orderBy("state", "task")


def usage_of_tree(processes: DataFrame, root) -> DataFrame:  # noqa: ANN001
    """Memory and time of a process and all it started; ``processes`` has pid, ppid, rss and cpu."""
    links = processes.select(F.col("ppid").alias("src"), F.col("pid").alias("dst"))
    tree = reachable(links, processes.where(F.col("pid") == F.lit(root)).select(F.col("pid").alias("task")))
    own = processes.join(tree.select(F.col("task").alias("pid")), "pid", "left_semi")
    return own.agg(F.count("*").alias("processes"), F.coalesce(F.sum("rss"), F.lit(0)).alias("rss"), F.coalesce(F.sum("cpu"), F.lit(0)).alias("cpu"))
