"""Named queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dtypes import narrowest_unsigned
from ..functions.scratch import scratch_path
from ..operators import aggregates as A
from ..operators import neighborhood as N
from ..operators import numbering as B
from ..operators import pixels as P
from ..sources import metaimage, mrc, sections
from . import chain, dag
from . import fixtures as X
from .fixtures import NX, NY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RECT = (5, 7, 44, 56)
PX = """
e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings),
raw AS (SELECT (vec_id // 50)::INT AS z, (vec_id % 50)::INT AS y, x::INT AS x, v::DOUBLE AS v FROM e),
px AS (SELECT z, y, x, least(255, greatest(0, floor((v + 1) * 127.5)))::INT AS v FROM raw)"""
BORDERED = PX + """,
bd AS (SELECT z, y, x, CASE WHEN y < 5 OR y > 44 OR x < 7 OR x > 56 THEN 0 ELSE v END AS v FROM px)"""
LAB = PX + """,
lab AS (SELECT z, y, x, CASE WHEN v >= 145 THEN (v // 4) % 3 + 1 ELSE 0 END AS v FROM px)"""
HEADER = "SELECT (max(x) + 1)::INT AS mx, (max(y) + 1)::INT AS my, (max(z) + 1)::INT AS mz, (max(x) + 1) * 2.0::DOUBLE AS xlen, (max(y) + 1) * 1.5::DOUBLE AS ylen, (max(z) + 1) * 4.0::DOUBLE AS zlen, 1.0::DOUBLE AS xorg, 2.0::DOUBLE AS yorg, 3.0::DOUBLE AS zorg FROM px"


def query(sql: str, name: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        ORACLES[name or f.__name__] = sql
        return f

    return add


def header(spark: SparkSession, d: str) -> DataFrame:
    """The header that the table's stack would have, with spacings 2, 1.5 and 4."""
    h = X.byte(spark, d).agg(*((F.max(a) + 1).alias(f"n{a}") for a in "xyz"))
    h = h.withColumns({f"m{a}": F.col(f"n{a}") for a in "xyz"} | {f"{a}org": F.lit(o) for a, o in zip("xyz", (1.0, 2.0, 3.0), strict=True)})
    return P.set_spacing(h, 2.0, 1.5, 4.0).withColumn("labels", F.array(F.rpad(F.lit("first"), 80, " ")))


# Projections and filters.


@query(f"WITH {PX} SELECT z, y, x, v >= 128 AS v FROM px")
def bw_threshold(spark, d):
    return P.threshold(X.byte(spark, d), 128)


@query(f"WITH {PX} SELECT z, y, x, v < 120 AS v FROM px")
def bw_negative(spark, d):
    return P.threshold(X.byte(spark, d), -120)


@query(f"WITH {PX} SELECT z, y, x, round((v - 0.0::DOUBLE) * (1.0::DOUBLE / 255), 9) AS v FROM px")
def float_scale(spark, d):
    return P.to_float(X.byte(spark, d), "byte").withColumn("v", F.round("v", 9))


@query(f"WITH {PX}, m AS (SELECT z, min(v) AS lo, max(v) AS hi FROM raw GROUP BY z) SELECT z, y, x, round((v - CASE WHEN lo >= 0 AND hi <= 1 THEN 0 ELSE lo END) / (CASE WHEN lo >= 0 AND hi <= 1 THEN 1 ELSE hi - lo END), 9) AS v FROM raw JOIN m USING (z)")
def float_datascale(spark, d):
    return P.to_float(X.raw(spark, d), "float").withColumn("v", F.round("v", 9))


@query(f"WITH {PX} SELECT z, 49 - y AS y, x, v FROM px")
def flip_ud(spark, d):
    return P.flip_up_down(X.byte(spark, d), NY)


@query(f"WITH {PX} SELECT z, y - 5 AS y, x - 7 AS x, v FROM px WHERE y BETWEEN 5 AND 44 AND x BETWEEN 7 AND 56")
def crop_fixed(spark, d):
    return P.crop(X.byte(spark, d), RECT)


@query(f"WITH {BORDERED}, b AS (SELECT z, min(y) AS t, min(x) AS l, max(y) AS b, max(x) AS r FROM bd WHERE v <> 0 GROUP BY z) SELECT z, y - t AS y, x - l AS x, v FROM bd JOIN b USING (z) WHERE y BETWEEN t AND b AND x BETWEEN l AND r")
def crop_auto(spark, d):
    px = X.bordered(spark, d)
    return P.crop(P.with_rect(px, A.foreground_area(px, NY, NX)))


@query(f"WITH {PX}, g AS (SELECT z, y::INT AS y, x::INT AS x FROM (SELECT DISTINCT z FROM px), range(55) a(y), range(71) b(x)) SELECT g.z, g.y, g.x, coalesce(px.v, 0) AS v FROM g LEFT JOIN px ON px.z = g.z AND px.y = g.y - 2 AND px.x = g.x - 3")
def pad_fixed(spark, d):
    return P.pad(X.whole(X.byte(spark, d), d, 0), 2, 3, 3, 4, NY, NX)


@query(f"WITH {PX} SELECT z, y, x, CASE WHEN y BETWEEN 5 AND 44 AND x BETWEEN 7 AND 56 THEN v ELSE 0 END AS v FROM px")
def bgzero(spark, d):
    return P.fill_background(X.byte(spark, d), RECT)


@query(f"WITH {BORDERED}, s AS (SELECT z, y, x, CASE WHEN y < 5 THEN 9 - y WHEN y > 44 THEN 89 - y ELSE y END AS sy, CASE WHEN x < 7 THEN 13 - x WHEN x > 56 THEN 113 - x ELSE x END AS sx FROM bd) SELECT s.z, s.y, s.x, p.v FROM s JOIN bd p ON p.z = s.z AND p.y = s.sy AND p.x = s.sx")
def mirror(spark, d):
    return P.mirror_background(X.bordered(spark, d), RECT, NY, NX)


@query(f"WITH {PX} SELECT z, y, x, v FROM px WHERE z IN (3, 5, 6, 7)")
def z_select(spark, d):
    return P.select_sections(X.byte(spark, d), "3,5-7,6", 10)


@query(f"WITH {PX} SELECT z - 2 AS z, y - 4 AS y, x - 10 AS x, v FROM px WHERE z BETWEEN 2 AND 5 AND y BETWEEN 4 AND 20 AND x BETWEEN 10 AND 40")
def view_box(spark, d):
    return P.view(X.byte(spark, d), (10, 40), (4, 20), (2, 5))


@query(f"WITH {PX} SELECT z, y, x, v FROM px UNION ALL SELECT z + (SELECT max(z) + 1 FROM px), y, x, v FROM px WHERE z < 3")
def stack_concat(spark, d):
    px = X.byte(spark, d)
    return P.append_stack(px, px.where("z < 3"))


@query(f"WITH {PX} SELECT z, y, x, CASE WHEN z = 4 THEN 255 - v ELSE v END AS v FROM px")
def overwrite_section(spark, d):
    px = X.byte(spark, d)
    return P.overwrite_sections(px, px.where("z = 4").withColumn("v", 255 - F.col("v")))


@query(f"WITH {PX} SELECT z, y, x, v FROM px WHERE z < (SELECT max(z) - 1 FROM px)")
def drop_tail(spark, d):
    px = X.byte(spark, d)
    return P.drop_tail(px, px.agg(F.max("z").alias("m")).first()["m"] + 1, 2)


@query(f"WITH {PX}, h AS ({HEADER}) SELECT 31 AS nx, 17 AS ny, 4 AS nz, xlen / mx * 31 AS xlen, ylen / my * 17 AS ylen, zlen / mz * 4 AS zlen, xorg - xlen / mx * 10 AS xorg, yorg - ylen / my * 4 AS yorg, zorg - zlen / mz * 2 AS zorg, xlen / mx AS spacing_x, mx * 2.5::DOUBLE AS set_xlen FROM h")
def spacing_header(spark, d):
    h = header(spark, d)
    v = P.view_header(h, (10, 40), (4, 20), (2, 5)).select("nx", "ny", "nz", "xlen", "ylen", "zlen", "xorg", "yorg", "zorg")
    return v.crossJoin(P.spacing(h).select("spacing_x")).crossJoin(P.set_spacing(h, 2.5, 1.0, 1.0).select(F.col("xlen").alias("set_xlen")))


@query("WITH l AS (SELECT n_name AS label, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) SELECT (i - (SELECT max(i) FROM l) + 9)::INT AS pos, rpad(label, 80, ' ') AS label FROM l WHERE i > (SELECT max(i) FROM l) - 10")
def header_labels(spark, d):
    """A label for each nation, added in turn: the last ten stay."""
    h = header(spark, d)
    for r in X.table(spark, d, "nation").orderBy("n_nationkey").collect():  # 25 rows
        h = P.add_label(h, r["n_name"])
    return h.select(F.posexplode("labels").alias("pos", "label"))


# Histograms, statistics, numbering.


@query(f"WITH {PX} SELECT z, v AS bin, count(*) AS n FROM px GROUP BY z, v")
def hist_section(spark, d):
    return A.histogram(X.byte(spark, d), 0, 256, 256, ("z",))


@query(f"WITH {PX} SELECT v AS bin, count(*) AS n FROM px GROUP BY v")
def hist_global(spark, d):
    return A.histogram(X.byte(spark, d), 0, 256)


@query(f"WITH {PX} SELECT b::INT AS bin, count(v) AS n FROM range(256) t(b) LEFT JOIN px ON v = b GROUP BY b")
def hist_zero_filled(spark, d):
    return A.zero_filled(A.histogram(X.byte(spark, d), 0, 256), 256)


@query(f"WITH {PX} SELECT least(31, floor((v + 1) / 3 * 32))::INT AS bin, count(*) AS n FROM raw GROUP BY ALL")
def hist_float(spark, d):
    return A.histogram(X.raw(spark, d), -1, 2, 32)


@query(f"WITH {PX} SELECT z, min(v)::DOUBLE AS vmin, max(v)::DOUBLE AS vmax, round(avg(v), 9) AS vmean FROM px GROUP BY z")
def section_stats(spark, d):
    return A.section_stats(X.byte(spark, d)).withColumn("vmean", F.round("vmean", 9))


@query(f"WITH {PX}, s AS (SELECT z, min(v) AS a, max(v) AS b, avg(v) AS c FROM px GROUP BY z) SELECT min(a)::DOUBLE AS vmin, max(b)::DOUBLE AS vmax, round(avg(c), 9) AS vmean FROM s")
def stack_stats(spark, d):
    return A.stack_stats(X.byte(spark, d)).withColumn("vmean", F.round("vmean", 9))


@query(f"WITH {PX}, s AS (SELECT z, min(v) AS a, max(v) AS b, avg(v) AS c FROM px GROUP BY z) SELECT min(a)::DOUBLE AS vmin, max(b)::DOUBLE AS vmax, round(avg(c), 9) AS vmean FROM s")
def append_stats(spark, d):
    """All sections but the last, and that one appended."""
    px = X.byte(spark, d)
    last = px.agg(F.max("z").alias("m")).first()["m"]
    return A.merge_stats(A.stack_stats(px.where(F.col("z") < last)), last, A.section_stats(px.where(F.col("z") == last))).withColumn("vmean", F.round("vmean", 9))


@query(f"WITH {BORDERED} SELECT z, min(y) AS t, min(x) AS l, max(y) AS b, max(x) AS r FROM bd WHERE v <> 0 GROUP BY z")
def fg_area(spark, d):
    return A.foreground_area(X.bordered(spark, d), NY, NX)


@query(f"WITH {PX} SELECT DISTINCT z, v FROM px")
def unique_values(spark, d):
    return A.distinct_values(X.byte(spark, d), ("z",))


@query(f"WITH {PX}, q AS (SELECT z, y, x, CASE WHEN v < 120 THEN 0 ELSE v END AS v FROM px), r AS (SELECT DISTINCT z, v FROM q WHERE v <> 0), k AS (SELECT z, v, dense_rank() OVER (PARTITION BY z ORDER BY v) AS n FROM r) SELECT z, y, x, coalesce(n, 0)::INT AS v FROM q LEFT JOIN k USING (z, v)")
def renumber_gray(spark, d):
    return A.renumber(X.byte(spark, d).withColumn("v", F.when(F.col("v") < 120, 0).otherwise(F.col("v"))))


@query(f"WITH {PX}, q AS (SELECT a.z, a.y, a.x, a.v * 65536 + b.v * 256 + c.v AS v FROM px a JOIN px b ON a.z = b.z AND a.y = b.y AND b.x = (a.x + 1) % 64 JOIN px c ON a.z = c.z AND a.y = c.y AND c.x = (a.x + 2) % 64), k AS (SELECT z, v, dense_rank() OVER (PARTITION BY z ORDER BY v) AS n FROM (SELECT DISTINCT z, v FROM q WHERE v <> 0)) SELECT z, y, x, coalesce(n, 0)::INT AS v FROM q LEFT JOIN k USING (z, v)")
def renumber_rgb(spark, d):
    return A.renumber(X.rgb(spark, d))


@query(f"WITH {PX}, h AS (SELECT v AS bin, count(*) AS n FROM px GROUP BY v) SELECT bin, n, sum(n) OVER (ORDER BY bin)::BIGINT AS cum FROM h")
def cdf(spark, d):
    return A.cdf(A.histogram(X.byte(spark, d), 0, 256))


@query(f"WITH {PX}, m AS (SELECT max(v) AS m FROM px) SELECT m, CASE WHEN m <= 1 THEN 'bit' WHEN m <= 255 THEN 'byte' WHEN m <= 65535 THEN 'ushort' ELSE 'uint' END AS dtype FROM m")
def narrow_type(spark, d):
    m = X.byte(spark, d).agg(F.max("v").alias("m"))
    return m.select("m", F.when(F.col("m") <= 1, "bit").when(F.col("m") <= narrowest_unsigned(255).high, "byte").when(F.col("m") <= narrowest_unsigned(65535).high, "ushort").otherwise("uint").alias("dtype"))


HISTEQ = """,
g AS (SELECT z, b::INT AS bin, count(v) AS n FROM (SELECT DISTINCT z FROM px) CROSS JOIN range(256) t(b) LEFT JOIN px USING (z) WHERE v = b OR v IS NULL GROUP BY z, b),
g2 AS (SELECT k.z, t.b::INT AS bin, coalesce(g.n, 0) AS n FROM (SELECT DISTINCT z FROM px) k CROSS JOIN range(256) t(b) LEFT JOIN g ON g.z = k.z AND g.bin = t.b),
s AS (SELECT z, bin, n, sum(n) OVER (PARTITION BY z ORDER BY bin) AS cs, sum(n) OVER (PARTITION BY z) AS sz, CASE WHEN bin IN (0, 255) THEN 0 ELSE n / 2.0::DOUBLE END AS tol FROM g2),
lut AS (SELECT z, bin, min(j) AS j FROM s, d WHERE sz * f - cs + tol >= -sz * sqrt(pow(2.0::DOUBLE, -52)) GROUP BY z, bin)
SELECT px.z, y, x, round_even(j * 255.0::DOUBLE / ({k} - 1), 0)::INT AS v FROM px JOIN lut ON lut.z = px.z AND lut.bin = px.v"""


@query(f"WITH {PX}, d AS (SELECT i::INT AS j, (i + 1) / 64.0::DOUBLE AS f FROM range(64) t(i))" + HISTEQ.replace("{k}", "64"))
def histeq_uniform(spark, d):
    return N.equalise(X.byte(spark, d))


@query(f"WITH {PX}, d AS (SELECT i::INT AS j, sum(1 + i % 7) OVER (ORDER BY i) / (sum(1 + i % 7) OVER ())::DOUBLE AS f FROM range(100) t(i))" + HISTEQ.replace("{k}", "100"))
def histeq_match(spark, d):
    target = spark.range(100).select(F.col("id").cast("int").alias("bin"), (1 + F.col("id") % 7).alias("n"))
    return N.equalise(X.byte(spark, d), target=target)


# Windows.


@query("WITH p AS (SELECT (l_orderkey % 4)::INT AS file_ord, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber AS c FROM lineitem), q AS (SELECT *, lag(c) OVER w AS prev FROM p WINDOW w AS (ORDER BY file_ord, l_orderkey, l_linenumber, l_partkey, l_suppkey)) SELECT sum((c IS DISTINCT FROM prev)::INT) OVER (ORDER BY file_ord, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)::BIGINT AS contour, l_partkey AS x, l_suppkey AS y, file_ord AS z FROM q")
def contour_merge(spark, d):
    return A.first_seen_runs(X.points(spark, d)).select(F.col("contour").cast("long").alias("contour"), "x", "y", "z")


@query("WITH q AS (SELECT r_regionkey AS ord, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey * 10 END AS t FROM region) SELECT ord, last_value(t IGNORE NULLS) OVER (ORDER BY ord) AS t, last_value(t IGNORE NULLS) OVER (ORDER BY ord) + 1 AS l, last_value(t IGNORE NULLS) OVER (ORDER BY ord) + 2 AS b, last_value(t IGNORE NULLS) OVER (ORDER BY ord) + 3 AS r FROM q")
def rect_ffill(spark, d):
    t = F.when(F.col("r_regionkey") % 2 == 0, F.col("r_regionkey") * 10)
    return A.forward_fill(X.table(spark, d, "region").select(F.col("r_regionkey").alias("ord"), t.alias("t"), (t + 1).alias("l"), (t + 2).alias("b"), (t + 3).alias("r")))


@query("SELECT user_id AS task, max(event_id) AS line_no, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def log_last(spark, d):
    e = X.table(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("line_no"), "event_type")
    return A.last_entry(e, "task", "line_no", "event_type")


@query("SELECT s_suppkey, ntile(7) OVER (ORDER BY s_suppkey) - 1 AS grp FROM supplier")
def balanced_split(spark, d):
    s = X.table(spark, d, "supplier").select("s_suppkey")
    return A.balanced_split(s, 7, "s_suppkey").withColumn("grp", F.col("grp").cast("long"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS z FROM part")
def z_by_name(spark, d):
    return B.numbered(X.table(spark, d, "part").select("p_name", "p_partkey"), "p_name", "p_partkey", name="z").select("p_partkey", "z")


# Task graphs.

TASKS = """
t AS (SELECT p_partkey AS task, 'proc' AS kind, (1 + p_size % 4)::INT AS cpu, floor(p_retailprice)::BIGINT * 1048576 AS mem, p_partkey < 8 AS done FROM part),
i AS (SELECT p_partkey AS task, p_partkey // 2 AS file FROM part WHERE p_partkey > 1),
o AS (SELECT p_partkey AS task, p_partkey AS file FROM part),
l AS (SELECT o.task AS src, i.task AS dst FROM o JOIN i USING (file))"""
CLOSURE = TASKS + ",\nc(src, dst) AS (SELECT src, dst FROM l UNION SELECT c.src, l.dst FROM c JOIN l ON l.src = c.dst),\nk AS (SELECT t.*, coalesce(n, 0) AS n_after FROM t LEFT JOIN (SELECT src, count(*) AS n FROM c GROUP BY src) q ON q.src = t.task)"
READY = ",\nf AS (SELECT * FROM k WHERE NOT done AND task NOT IN (SELECT dst FROM l JOIN t ON t.task = l.src WHERE NOT t.done)),\np AS (SELECT *, (SELECT count(*) FROM part) - n_after AS prio FROM f)"
FILES = "\nfl AS (SELECT o_custkey AS file, max(o_orderdate) + INTERVAL 23 YEAR AS mtime FROM orders GROUP BY o_custkey),\nlg AS (SELECT user_id AS task, arg_max(ts, event_id) AS ts FROM events GROUP BY user_id)"
STALE = (
    TASKS + "," + FILES
    + ",\ndirect AS (SELECT task FROM t WHERE task NOT IN (SELECT task FROM lg) UNION SELECT i.task FROM i JOIN lg USING (task) JOIN fl USING (file) WHERE mtime >= ts UNION SELECT task FROM o WHERE file NOT IN (SELECT file FROM fl) UNION SELECT task FROM t WHERE ('s' || task % 25) IN (SELECT 's' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0 AND n_nationkey > 0)),\ns(task) AS (SELECT task FROM direct UNION SELECT l.dst FROM s JOIN l ON l.src = s.task)"
)


def _graph(spark, d):
    return X.tasks(spark, d), X.task_in(spark, d), X.task_out(spark, d)


@query(f"WITH {TASKS} SELECT src, dst FROM l")
def dag_edges(spark, d):
    return dag.edges(*_graph(spark, d)[1:])


@query(f"WITH {TASKS} SELECT DISTINCT file FROM i EXCEPT SELECT file FROM o WHERE task > 3")
def dag_inputs(spark, d):
    _, i, o = _graph(spark, d)
    return dag.overall_inputs(i, o.where("task > 3"))


@query(f"WITH {TASKS} SELECT file FROM o EXCEPT SELECT file FROM i")
def dag_outputs(spark, d):
    return dag.overall_outputs(*_graph(spark, d)[1:])


@query(f"WITH {TASKS} SELECT task FROM t WHERE task NOT IN (SELECT task FROM i)")
def dag_generators(spark, d):
    t, i, _ = _graph(spark, d)
    return dag.generators(t, i).select("task")


@query(f"WITH {TASKS} SELECT task FROM t WHERE task NOT IN (SELECT src FROM l)")
def dag_last(spark, d):
    return dag.last_tasks(*_graph(spark, d)).select("task")


@query(f"WITH {TASKS} SELECT task FROM t WHERE task % 3 = 0")
def dag_cleanups(spark, d):
    t, _, o = _graph(spark, d)
    return dag.cleanups(t, o.where("task % 3 <> 0")).select("task")


@query(f"WITH RECURSIVE {CLOSURE} SELECT task, n_after FROM k")
def dag_closure_count(spark, d):
    t, i, o = _graph(spark, d)
    return dag.descendant_counts(t, dag.edges(i, o)).select("task", "n_after")


@query(f"WITH {TASKS} SELECT task FROM t WHERE NOT done AND task NOT IN (SELECT dst FROM l JOIN t ON t.task = l.src WHERE NOT t.done)")
def dag_frontier(spark, d):
    t, i, o = _graph(spark, d)
    return dag.frontier(t, dag.edges(i, o)).select("task")


def _ready(spark, d):
    t, i, o = _graph(spark, d)
    links = dag.edges(i, o)
    return dag.ranked(dag.frontier(dag.descendant_counts(t, links), links), t.count())


@query(f"WITH RECURSIVE {CLOSURE}{READY} SELECT task, prio FROM p ORDER BY prio, kind, task LIMIT 5")
def dag_priority_topk(spark, d):
    return _ready(spark, d).orderBy("prio", "kind", "task").limit(5).select("task", "prio")


@query(f"WITH RECURSIVE {CLOSURE}{READY} SELECT task, prio, cpu, mem FROM p WHERE cpu <= 2 AND mem <= 2000000000 ORDER BY prio, kind, task LIMIT 1")
def dag_fit(spark, d):
    return dag.best_fit(_ready(spark, d), 2, 2_000_000_000).select("task", "prio", "cpu", "mem")


@query(f"WITH RECURSIVE {TASKS}, a(task) AS (SELECT 777::BIGINT UNION SELECT l.src FROM a JOIN l ON l.dst = a.task) SELECT task FROM t WHERE done OR task IN (SELECT task FROM a)")
def dag_mark_done(spark, d):
    t, i, o = _graph(spark, d)
    start = spark.range(777, 778).select(F.col("id").alias("task"))
    return dag.mark_done(t, dag.edges(i, o), start).where("done").select("task")


@query(f"WITH {TASKS} SELECT count(*) FILTER (done) AS n_done, count(*) FILTER (task BETWEEN 8 AND 11) AS n_running, count(*) AS n_tasks, sum(cpu) FILTER (task BETWEEN 8 AND 11)::BIGINT AS cpu_used, sum(mem) FILTER (task BETWEEN 8 AND 11)::BIGINT AS mem_used FROM t")
def dag_status(spark, d):
    t = X.tasks(spark, d)
    return dag.status(t, t.where("task between 8 and 11"))


def _stale(spark, d):
    t, i, o = _graph(spark, d)
    log = A.last_entry(X.task_log(spark, d), "task", "line_no", "ts")
    n = X.table(spark, d, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("k"), F.col("n_regionkey").alias("v"), "n_nationkey")
    old = n.select("k", F.when((F.col("n_nationkey") % 5 == 0) & (F.col("n_nationkey") > 0), F.col("v") + 1).otherwise(F.col("v")).alias("v"))
    uses = t.select("task", F.concat(F.lit("s"), F.col("task") % 25).alias("setting"))
    return t, log, dag.stale(t, i, o, log, X.file_stat(spark, d), uses, old, n.select("k", "v"))


@query(f"WITH RECURSIVE {STALE} SELECT DISTINCT task FROM s")
def dag_stale(spark, d):
    return _stale(spark, d)[2]


@query(f"WITH RECURSIVE {STALE} SELECT lg.task, lg.ts FROM lg JOIN t USING (task) WHERE task NOT IN (SELECT task FROM s)")
def dag_done(spark, d):
    return dag.done_after(*_stale(spark, d))


@query("SELECT p_partkey AS task, CASE WHEN length(n) > 60 THEN substr(n, 1, 56) || '...' || right(n, 1) ELSE n END AS shown, printf('%d:%02d:%02d', p_partkey * 7 // 3600, p_partkey * 7 // 60 % 60, p_partkey * 7 % 60) AS elapsed FROM (SELECT p_partkey, repeat(p_name || ' ', 1 + (p_partkey % 9)::INT) AS n FROM part)")
def status_names(spark, d):
    p = X.table(spark, d, "part").select("p_partkey", F.expr("repeat(p_name || ' ', cast(1 + p_partkey % 9 as int))").alias("n"), (F.col("p_partkey") * 7).alias("s"))
    return p.select(F.col("p_partkey").alias("task"), dag.shown_name("n").alias("shown"), dag.elapsed("s").alias("elapsed"))


# Neighbourhoods.


def _blur_sql(axis: str, n: int, src: str, dst: str) -> str:
    other = "x" if axis == "y" else "y"
    return f"{dst} AS (SELECT a.z, a.{axis}, a.{other}, sum(k.w * b.v ORDER BY k.d) AS v FROM {src} a CROSS JOIN k JOIN {src} b ON b.z = a.z AND b.{other} = a.{other} AND b.{axis} = CASE WHEN a.{axis} + k.d < 0 THEN -(a.{axis} + k.d) - 1 WHEN a.{axis} + k.d >= {n} THEN {2 * n - 1} - (a.{axis} + k.d) ELSE a.{axis} + k.d END GROUP BY ALL)"


@query(f"WITH {PX}, k0 AS (SELECT (i - 4)::INT AS d, exp(-((i - 4) * (i - 4)) / 2.0::DOUBLE) AS w FROM range(9) t(i)), k AS (SELECT d, w / (SELECT sum(w) FROM k0) AS w FROM k0), {_blur_sql('y', 50, 'raw', 'b1')}, {_blur_sql('x', 64, 'b1', 'b2')} SELECT z, y, x, round(v, 6) AS v FROM b2")
def blur_3x(spark, d):
    return N.gauss_blur(X.raw(spark, d), NY, NX, 1.0).withColumn("v", F.round("v", 6))


def _components_sql(src: str, same: str) -> str:
    return f"""
on_ AS (SELECT z, y, x, v, y * 64 + x AS p FROM {src} WHERE v <> 0),
ed AS (SELECT a.z, a.p AS a, b.p AS b FROM on_ a JOIN on_ b ON a.z = b.z AND {same} AND ((a.y = b.y AND abs(a.x - b.x) = 1) OR (a.x = b.x AND abs(a.y - b.y) = 1))),
re(z, a, b) AS (SELECT z, p, p FROM on_ UNION SELECT re.z, re.a, ed.b FROM re JOIN ed ON ed.z = re.z AND ed.a = re.b),
rt AS (SELECT z, a AS p, min(b) AS root FROM re GROUP BY z, a)"""


@query(f"WITH RECURSIVE {PX}, sp AS (SELECT z, y, x, (v >= 150)::INT AS v FROM px), {_components_sql('sp', 'true')} SELECT sp.z, sp.y, sp.x, CASE WHEN root IS NULL THEN 0 ELSE dense_rank() OVER (PARTITION BY sp.z ORDER BY root NULLS LAST) END::BIGINT AS v FROM sp LEFT JOIN rt ON rt.z = sp.z AND rt.p = sp.y * 64 + sp.x")
def label4(spark, d):
    return N.label(X.sparse(spark, d))


QUERIES["label4_iterative"] = lambda spark, d: N.label_large(X.sparse(spark, d), NX).select("z", "y", "x", "v")
ORACLES["label4_iterative"] = ORACLES["label4"]


@query(f"WITH RECURSIVE {LAB}, {_components_sql('lab', 'a.v = b.v')}, ro AS (SELECT DISTINCT rt.z, root, on_.v FROM rt JOIN on_ ON on_.z = rt.z AND on_.p = rt.root), rk AS (SELECT *, dense_rank() OVER (PARTITION BY z ORDER BY v) AS k, row_number() OVER (PARTITION BY z, v ORDER BY root) AS i FROM ro), nm AS (SELECT *, max(k) OVER (PARTITION BY z) AS n, row_number() OVER (PARTITION BY z, i = 1 ORDER BY v, root) AS m FROM rk) SELECT lab.z, lab.y, lab.x, coalesce(CASE WHEN i = 1 THEN k ELSE n + m END, 0)::BIGINT AS v FROM lab LEFT JOIN rt ON rt.z = lab.z AND rt.p = lab.y * 64 + lab.x LEFT JOIN nm ON nm.z = rt.z AND nm.root = rt.root")
def relabel4(spark, d):
    return N.relabel(X.labels(spark, d))


# Sources, sinks and chains.


@query(f"WITH {PX} SELECT z, y, x, v::DOUBLE AS v FROM px WHERE z BETWEEN 2 AND 7")
def mrc_roundtrip(spark, d):
    mrc.register(spark)
    path = scratch_path(spark, "stack.mrc").removeprefix("file://")
    sections.to_sections(X.whole(X.byte(spark, d), d), "byte", stats=True).write.format("mrc").mode("append").option("path", path).save()
    return X.held(sections.to_pixels(spark.read.format("mrc").load(path).where("z between 2 and 7")), d)


@query(f"WITH {PX} SELECT z, y, x, (v * 257 - 32768)::DOUBLE AS v FROM px")
def mha_roundtrip(spark, d):
    folder = scratch_path(spark, "mha")
    metaimage.write(sections.to_sections(X.short(spark, d), "short"), folder, compressed=True, tags={"ElementSpacing": 2})
    read = metaimage.read(spark, folder)
    return sections.to_pixels(read.withColumn("z", F.regexp_extract("path", r"(\d+)\.mha$", 1).cast("int")))


@query(f"WITH {PX}, f AS (SELECT z, 49 - y AS y, x, v FROM px), c AS (SELECT z, y - 5 AS y, x - 7 AS x, v FROM f WHERE y BETWEEN 5 AND 44 AND x BETWEEN 7 AND 56), g AS (SELECT z, y::INT AS y, x::INT AS x FROM (SELECT DISTINCT z FROM px), range(42) a(y), range(52) b(x)) SELECT g.z, g.y, g.x, coalesce(c.v, 0) >= 128 AS v FROM g LEFT JOIN c ON c.z = g.z AND c.y = g.y - 1 AND c.x = g.x - 1")
def chain_demo(spark, d):
    options = [("flip", None), ("crop", "5,7,44,56"), ("pad", "1,1,1,1"), ("thresh", "128")]
    return X.whole(X.byte(spark, d), d, 0).transform(chain.parse(options, NY, NX))


@query(f"WITH {PX} SELECT y, x, v::DOUBLE AS v FROM px WHERE z = 0")
def first_image(spark, d):
    return X.byte(spark, d).where("z = 0").select("y", "x", F.col("v").cast("double").alias("v"))
