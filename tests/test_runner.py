import sys

import pytest

from lamella.plans import dag, runner, segmentation


def shell(code):
    return [sys.executable, "-c", code]


def copy(src, dst):
    return shell(f"import shutil; shutil.copy({src!r}, {dst!r})")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").write_text("x")
    return tmp_path


def build(spark, folder, **kw):
    t = runner.Tasks(spark, "log", {"s": 1, "t": 2}, cpus=3, folder=str(folder), usage="usage", **kw)
    t.add(copy("in", "a"), "in", "a", "s")
    t.add(copy("a", "b"), "a", "b")
    t.add(copy("a", "c"), "a", "c", "t").pressure(cpu=2, mem=1)
    ran = []

    def join():
        ran.append(spark.range(5).count())
        (folder / "d").write_text((folder / "b").read_text() + (folder / "c").read_text())

    t.add_func(join, inputs=("b", "c"), outputs="d")
    return t, ran


def test_run_and_skip(spark, folder):
    t, ran = build(spark, folder)
    t.run()
    assert (folder / "d").read_text() == "xx" and ran == [5] and len(t.done) == 4
    assert len((folder / "usage").read_text().splitlines()) == 3
    assert t.status()["n_done"] == 4 and t.find("join()").outs == ("d",) and t.find("?") is None
    # nothing is stale: nothing runs
    t, ran = build(spark, folder)
    t.run()
    assert ran == [] and len(t.done) == 4
    # a missing output runs its task and all that follow
    (folder / "c").unlink()
    t, ran = build(spark, folder)
    t.run()
    assert ran == [5]
    # a changed setting too
    t, ran = build(spark, folder)
    t.settings["s"] = "9"
    t.run()
    assert ran == [5] and "*s=9" in (folder / "log").read_text()


def test_errors_stop_new_tasks(spark, folder):
    t = runner.Tasks(spark, folder=str(folder), cpus=2)
    t.add(shell("raise SystemExit(3)"), "in", "a")
    t.add(copy("a", "b"), "a", "b")
    with pytest.raises(runner.TaskError, match="exit code 3") as e:
        t.run()
    assert len(e.value.failed) == 1 and not t.done and not (folder / "b").exists()


def test_rules(spark, folder):
    t = runner.Tasks(spark, settings={"s": 1}, folder=str(folder))
    t.add(["x"], "in", "a", "s")
    for bad in ((["x"], "in", "z"), (["y"], "q", "a"), (["y"], "q", "q"), (["y"], "q", "r", "unknown")):
        with pytest.raises(dag.GraphError):
            t.add(*bad)
    with pytest.raises(ValueError):
        t.add(["w"], "in", "w").pressure(cpu=0)
    t.add(["back"], "a", "in")
    with pytest.raises(dag.GraphError, match="cycle"):
        t.run()


def test_streams_and_executors(spark, folder):
    t = runner.Tasks(spark, folder=str(folder))
    t.add(shell("import sys; print(sys.stdin.read() * 2); print('e', file=sys.stderr)"), "in", ("out", "err"), stdin="in", stdout="out", stderr="err")
    t.add_func(open, (str(folder / "made"), "w"), inputs="out", outputs="made", on_executor=True)
    t.run()
    assert (folder / "out").read_text() == "xx\n" and (folder / "err").read_text() == "e\n" and (folder / "made").exists()
    slow = t.add(shell("import time; time.sleep(60)"), "in", "never")
    import threading
    import time

    thread = threading.Thread(target=lambda: pytest.raises(Exception, slow.action))
    thread.start()
    while slow.process is None:
        time.sleep(0.05)
    slow.terminate(5)
    thread.join(10)
    assert slow.process.poll() is not None


def test_plan(spark):
    train, full = segmentation.Stack("t.mrc", 40, 30, 3), segmentation.Stack("f.mrc", 40, 30, 10)
    for o in (segmentation.Options(jobs=4), segmentation.Options(histeq=False, sigma=0, water_lvl=0.01, jobs=16)):
        rows = segmentation.plan(spark, train, "t.mod", full, "out.mod", o).cache()
        tasks, ins, outs, uses = segmentation.tables(rows)
        assert rows.count() == rows.select("task").distinct().count()
        dag.check(ins, outs, uses, spark.createDataFrame(sorted(o.settings().items()), "k string, v string"))
        given = {r.file for r in dag.overall_inputs(ins, outs).collect()}
        made = {r.file for r in dag.overall_outputs(ins, outs).collect()}
        assert given == {"t.mrc", "f.mrc", "t.mod"} and "out.mod" in made
        n = {r.program: r["count"] for r in rows.groupBy("program").count().collect()}
        assert n["rf_predict"] == min(o.jobs, 10) and n["hnsWatershed"] == 13 and n.get("get_histogram", 0) == o.histeq and ("cp" in n) == (o.sigma == 0)
        assert n.get("hnsCalculateWatershedThreshold", 0) == (o.water_lvl is None)
        groups = sorted((sorted(f for f in r.outs) for r in rows.where("program = 'rf_predict'").collect()), key=lambda g: g[0])
        assert [f for g in groups for f in g] == [f"full_predicted/{z:04d}.ssv" for z in range(10)] and max(map(len, groups)) - min(map(len, groups)) <= 1
        links = dag.edges(ins, outs)
        left = dag.descendant_counts(tasks, links)
        assert left.where("n_after = 0").select("task").first().task.startswith("point2model")
    for bad in ({"water_lvl": 1.5}, {"sigma": -1}, {"mtry": 41}, {"num_trees": 0}, {"chm_overlap": (1,)}):
        with pytest.raises(ValueError):
            segmentation.plan(spark, train, "m", full, "o", segmentation.Options(**bad))
    assert segmentation.masks("m", "i", "o", 2, colour=True) == ["imodmop", "-color", "-mask", "255", "-pad", "-2", "m", "i", "o"]
