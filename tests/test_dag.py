import datetime as dt

import pytest

from lamella.plans import dag


@pytest.fixture(scope="module")
def graph(spark):
    """A -> B -> C and A -> D."""
    ins = spark.createDataFrame([("A", "in"), ("B", "a"), ("C", "b"), ("D", "a")], "task string, file string")
    outs = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c"), ("D", "d")], "task string, file string")
    tasks = spark.createDataFrame([(t, "proc", 1, 5, False) for t in "ABCD"], "task string, kind string, cpu int, mem long, done boolean")
    return tasks, ins, outs


def names(df, col="task"):
    return sorted(r[col] for r in df.collect())


def test_shape(graph):
    tasks, ins, outs = graph
    links = dag.edges(ins, outs)
    assert names(dag.overall_inputs(ins, outs), "file") == ["in"]
    assert names(dag.overall_outputs(ins, outs), "file") == ["c", "d"]
    assert names(dag.frontier(tasks, links)) == ["A"]
    assert {r.task: r.n_after for r in dag.descendant_counts(tasks, links).collect()} == {"A": 3, "B": 1, "C": 0, "D": 0}
    assert names(dag.first_tasks(tasks, ins, outs)) == ["A"] and names(dag.last_tasks(tasks, ins, outs)) == ["C", "D"]
    assert names(dag.mark_done(tasks, links, tasks.where("task = 'B'")).where("done")) == ["A", "B"]


def test_staleness(spark, graph):
    tasks, ins, outs = graph
    t = dt.datetime(2020, 1, 1)
    log = spark.createDataFrame([(x, t) for x in "ABCD"], "task string, ts timestamp")
    files = spark.createDataFrame([(f, True, dt.datetime(2019, 1, 1)) for f in ("in", "a", "b", "c", "d")], "file string, present boolean, mtime timestamp")
    old = spark.createDataFrame([("s", "1"), ("t", "1")], "k string, v string")
    new = spark.createDataFrame([("s", "2"), ("t", "1")], "k string, v string")
    uses = spark.createDataFrame([("B", "s"), ("D", "t")], "task string, setting string")
    got = dag.stale(tasks, ins, outs, log, files, uses, old, new)
    assert names(got) == ["B", "C"] and names(dag.done_after(tasks, log, got)) == ["A", "D"]
    touched = spark.createDataFrame([("in", True, t)], "file string, present boolean, mtime timestamp").unionByName(files.where("file <> 'in'"))
    assert names(dag.stale(tasks, ins, outs, log, touched)) == ["A", "B", "C", "D"]
    assert names(dag.stale(tasks, ins, outs, log, files.where("file <> 'd'"))) == ["D"]
    assert names(dag.stale(tasks, ins, outs, log.where("task <> 'B'"), files)) == ["B", "C"]


def test_rules(spark, graph):
    _, ins, outs = graph
    dag.check(ins, outs)
    pair = "task string, file string"
    with pytest.raises(dag.GraphError, match="it writes"):
        dag.check(ins.unionByName(spark.createDataFrame([("A", "a")], pair)), outs)
    with pytest.raises(dag.GraphError, match="producers"):
        dag.check(ins, outs.unionByName(spark.createDataFrame([("D", "b")], pair)))
    with pytest.raises(dag.GraphError, match="cycle"):
        dag.check(ins.unionByName(spark.createDataFrame([("A", "c")], pair)), outs)
    with pytest.raises(dag.GraphError, match="setting"):
        dag.check(ins, outs, spark.createDataFrame([("A", "x")], "task string, setting string"), spark.createDataFrame([("y", "1")], "k string, v string"))


def brute_after(links, tasks):
    after = {}

    def go(t):
        if t not in after:
            after[t] = set()
            for s, d in links:
                if s == t:
                    after[t] |= {d} | go(d)
        return after[t]

    return {t: len(go(t)) for t in tasks}


@pytest.mark.parametrize("kind", ["chain", "forest", "diamonds"])
def test_counts_of_descendants(spark, kind):
    import random

    rng = random.Random(3)
    n = 70
    links = {"chain": [(k, k + 1) for k in range(n - 1)], "forest": [(rng.randrange(k), k) for k in range(1, n) if k % 9], "diamonds": [(rng.randrange(k), k) for k in range(1, n) for _ in range(2)]}[kind]
    tasks = spark.createDataFrame([(k,) for k in range(n)], "task long")
    df = spark.createDataFrame(sorted(set(links)), "src long, dst long")
    got = {r.task: r.n_after for r in dag.descendant_counts(tasks, df).collect()}
    assert got == brute_after(links, range(n))
    assert dag.on_cycles(df).isEmpty()
    ring = df.unionByName(spark.createDataFrame([(5, 0)], "src long, dst long"))
    if kind == "chain":
        assert sorted((r.src, r.dst) for r in dag.on_cycles(ring).collect()) == [(k, (k + 1) % 6) for k in range(6)]
        with pytest.raises(dag.GraphError):
            dag.tree_counts(tasks, ring.where("dst <> 0 or src = 5"))


def test_lists_and_usage(spark, graph):
    tasks, ins, outs = graph
    more_in, more_out = spark.createDataFrame([("E", "c"), ("E", "new")], "task string, file string"), spark.createDataFrame([("E", "e")], "task string, file string")
    a, b = dag.add_tasks(ins, outs, more_in, more_out)
    assert names(a, "file") == ["in", "new"] and names(b, "file") == ["d", "e"]
    assert names(dag.find(tasks, "B")) == ["B"] and names(dag.find(tasks, "x")) == []
    assert [(r.task, r.state) for r in dag.listing(tasks, tasks.where("task = 'C'")).collect()] == [("C", "running"), ("A", "waiting"), ("B", "waiting"), ("D", "waiting")]
    t = dt.datetime(2020, 1, 1)
    log = spark.createDataFrame([("B", t), ("A", t), ("C", t - dt.timedelta(1))], "task string, ts timestamp")
    assert [r.task for r in dag.done_list(log).collect()] == ["C", "A", "B"]
    ps = spark.createDataFrame([(1, 0, 10, 1.0), (2, 1, 20, 2.0), (3, 2, 30, 0.5), (4, 9, 99, 9.0)], "pid int, ppid int, rss long, cpu double")
    assert tuple(dag.usage_of_tree(ps, 1).first()) == (3, 60, 3.5) and tuple(dag.usage_of_tree(ps, 7).first()) == (0, 0, 0)
