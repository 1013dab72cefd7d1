"""Small images with results worked out by hand, and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamella.functions.dtypes import narrowest_unsigned
from lamella.operators import aggregates as A
from lamella.operators import neighborhood as N
from lamella.operators import numbering as B
from lamella.operators import pixels as P
from lamella.plans import chain as P_chain


def image(spark, rows, kind="int"):
    v = [(0, y, x, v) for y, row in enumerate(rows) for x, v in enumerate(row)]
    return spark.createDataFrame(v, f"z int, y int, x int, v {kind}")


def array(df):
    rows = df.select("y", "x", "v").collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), float)
    assert len(rows) == out.size == len({(r.y, r.x) for r in rows})
    for r in rows:
        out[r.y, r.x] = r.v
    return out.tolist()


def test_threshold(spark):
    px = image(spark, [[1, 2, 3]])
    assert array(P.threshold(px, 2)) == [[0, 1, 1]]
    assert array(P.threshold(px, -2)) == [[1, 0, 0]]


def test_scale(spark):
    assert array(P.to_float(image(spark, [[0, 255]]), "byte")) == [[0, 1]]
    assert array(P.to_float(image(spark, [[-128, 127]]), "sbyte", (0, 2))) == [[0, 2]]
    assert array(P.to_float(image(spark, [[0.25, 0.5]], "double"), "float")) == [[0.25, 0.5]]
    assert array(P.to_float(image(spark, [[-2.0, 2.0]], "double"), "float")) == [[0, 1]]
    assert array(P.to_float(image(spark, [[5.0, 5.0]], "double"), "float")) == [[0, 0]]


def test_pad_crop(spark):
    px = image(spark, [[5, 6]])
    padded = P.pad(px, 1, 0, 0, 2, 1, 2)
    assert array(padded) == [[0, 0, 0, 0], [5, 6, 0, 0]]
    assert array(P.crop(padded, (1, 0, 1, 1))) == [[5, 6]]


def test_flip_twice(spark):
    px = image(spark, [[1, 2], [3, 4], [5, 6]])
    assert array(P.flip_up_down(px, 3)) == [[5, 6], [3, 4], [1, 2]]
    assert array(P.flip_up_down(P.flip_up_down(px, 3), 3)) == array(px)


def test_mirror(spark):
    px = image(spark, [[0], [7], [8], [9], [0]])
    assert array(P.mirror_background(px, (1, 0, 3, 0), 5, 1)) == [[7], [7], [8], [9], [9]]
    corner = image(spark, [[1, 2, 0], [3, 4, 0], [0, 0, 0]])
    assert array(P.mirror_background(corner, (0, 0, 1, 1), 3, 3)) == [[1, 2, 2], [3, 4, 4], [3, 4, 4]]


@pytest.mark.parametrize(
    ("rows", "box"),
    [
        ([[0, 0, 0, 0], [0, 5, 0, 0], [0, 0, 5, 0], [0, 0, 0, 0]], (1, 1, 2, 2)),
        ([[0, 0], [0, 0], [0, 0]], (2, 1, 2, 1)),
        ([[1, 2], [3, 4]], (0, 0, 1, 1)),
        ([[1, 7], [9, 9]], (0, 0, 0, 1)),
    ],
)
def test_foreground(spark, rows, box):
    r = A.foreground_area(image(spark, rows), len(rows), len(rows[0])).first()
    assert (r.t, r.l, r.b, r.r) == box


def test_renumber(spark):
    assert array(A.renumber(image(spark, [[0, 7, 3, 7]]))) == [[0, 2, 1, 2]]
    rgb = spark.createDataFrame([(0, 0, x, v) for x, v in enumerate([(1, 0, 0), (0, 0, 5), (0, 1, 0), (0, 0, 5), (0, 0, 0)])], "z int, y int, x int, v struct<R:int,G:int,B:int>")
    assert array(A.renumber(rgb)) == [[3, 1, 2, 1, 0]]
    with pytest.raises(Exception, match="negative"):
        A.renumber(image(spark, [[-1, 2]])).collect()


def test_label(spark):
    assert array(N.label(image(spark, [[1, 0, 2], [0, 0, 2]]))) == [[1, 0, 2], [0, 0, 2]]
    assert array(N.label(image(spark, [[1, 2]]))) == [[1, 1]]
    assert array(N.relabel(image(spark, [[4, 0, 4, 0, 9]]))) == [[1, 0, 3, 0, 2]]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32))
def test_label_arrays_against_flood_fill(seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 3, (rng.integers(1, 7), rng.integers(1, 7)))

    def fill(same):
        out, n = np.zeros(v.shape, int), 0
        for y, x in np.ndindex(v.shape):
            if v[y, x] and not out[y, x]:
                n += 1
                todo = [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < v.shape[0] and 0 <= b < v.shape[1] and v[a, b] and not out[a, b] and same(v[a, b], v[y, x]):
                        out[a, b] = n
                        todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
        return out

    assert (N.label_array(v) == fill(lambda p, q: True)).all()
    got, parts = N.relabel_array(v), fill(lambda p, q: p == q)
    assert sorted(set(got.ravel())) == list(range(got.max() + 1)) or 0 not in got
    assert len({(a, b) for a, b in zip(got.ravel(), parts.ravel(), strict=True)}) == len(set(parts.ravel()))


def test_iterative_label(spark):
    rng = np.random.default_rng(5)
    v = (rng.random((12, 15)) < 0.55).astype(int)
    px = image(spark, v.tolist())
    assert array(N.label_large(px, 15)) == N.label_array(v).tolist()


def test_blur_against_numpy(spark):
    rng = np.random.default_rng(2)
    for shape, sigma, integral in (((5, 7), 1.0, False), ((2, 3), 1.5, False), ((6, 4), 0.7, True)):
        v = rng.integers(0, 255, shape).astype(float)
        want, w = v, np.array(N.kernel(sigma))
        r = len(w) // 2
        for axis in (0, 1):
            n = shape[axis]
            k = np.arange(-r, n + r) % (2 * n)
            k = np.where(k < n, k, 2 * n - 1 - k)
            lines = np.take(want, k, axis)
            want = np.apply_along_axis(lambda a, w=w: np.correlate(a, w, "valid"), axis, lines)
            want = np.floor(want) if integral else want
        px = image(spark, v.tolist(), "double")
        assert np.allclose(array(N.gauss_blur(px, *shape, sigma, integral=integral)), want, atol=1e-9 if not integral else 1)
    with pytest.raises(ValueError):
        N.gauss_blur(px, 6, 4, -1)


def test_histogram(spark):
    h = {r.bin: r.n for r in A.histogram(image(spark, [[0, 0, 255]]), 0, 256).collect()}
    assert h == {0: 2, 255: 1}
    f = A.zero_filled(A.histogram(image(spark, [[0.0, 0.25, 0.5, 1.0]], "double"), *A.unit_range(0, 1), 4), 4)
    assert [r.n for r in f.orderBy("bin").collect()] == [2, 1, 1, 0]


def test_equalise_is_monotone(spark):
    px = image(spark, [[10, 10, 20, 30], [200, 200, 200, 255]])
    t = N.equalisation_table(px).orderBy("bin").collect()
    assert [r.out for r in t] == sorted(r.out for r in t)
    with pytest.raises(ValueError):
        N.equalise(px, 64, spark.range(3))


def test_contours_merge_across_files(spark):
    rows = [(0, 0, 1), (0, 1, 1), (0, 2, 2), (1, 0, 2), (1, 1, 3), (2, 0, 1)]
    p = spark.createDataFrame(rows, "file_ord int, line_no long, contour int")
    got = A.first_seen_runs(p).orderBy("file_ord", "line_no").collect()
    assert [r.contour for r in got] == [1, 1, 2, 2, 3, 4]


def test_split_and_selection(spark):
    got = A.balanced_split(spark.range(10), 4, "id").groupBy("grp").count().orderBy("grp").collect()
    assert [r["count"] for r in got] == [3, 3, 2, 2]
    assert P.parse_selection("3,5-7,6") == [3, 5, 6, 7]
    for bad in ("", "a", "5-3", "1-x"):
        with pytest.raises(ValueError):
            P.parse_selection(bad)
    with pytest.raises(ValueError):
        P.select_sections(image(spark, [[1]]), "0-4", 3)


def test_narrowing():
    assert [narrowest_unsigned(n).name for n in (1, 2, 255, 256, 65536, 2**40)] == ["bit", "byte", "byte", "ushort", "uint", "ulong"]
    with pytest.raises(OverflowError):
        narrowest_unsigned(2**64)


def test_chain(spark):
    px = image(spark, [[0, 0, 0], [0, 200, 0], [0, 0, 90]])
    f = P_chain.parse([("-c", None), ("t", "100")], 3, 3)
    assert array(px.transform(f)) == [[1, 0], [0, 0]]
    assert array(px.transform(P_chain.compose([]))) == array(px)
    for bad in ([("sigma", "-1")], [("sigma", "nan")], [("nope", None)], [("pad", "1,2")]):
        with pytest.raises(ValueError):
            P_chain.parse(bad, 3, 3)


def test_forward_fill_keeps_leading_nulls(spark):
    r = spark.createDataFrame([(0, None), (1, 4), (2, None)], "ord int, t int").select("ord", "t", *(F.col("t").alias(c) for c in "lbr"))
    assert [x.t for x in A.forward_fill(r).orderBy("ord").collect()] == [None, 4, 4]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_running_values_over_ranges(spark, parts):
    """However rows are dealt, numbers, fills and runs are those of one sorted list."""
    rng = np.random.default_rng(parts)
    rows = [(int(k), int(rng.integers(0, 3)), None if rng.random() < 0.6 else int(rng.integers(0, 99))) for k in rng.permutation(200)]
    df = spark.createDataFrame(rows, "k long, c int, v int")
    ordered = sorted(rows)
    got = sorted((r.k, r.position) for r in B.numbered(df, "k", parts=parts).collect())
    assert got == [(r[0], i) for i, r in enumerate(ordered)]
    last, fill, runs, n = None, [], [], 0
    for i, (k, c, v) in enumerate(ordered):
        last = v if v is not None else last
        n += i == 0 or ordered[i - 1][1] != c
        fill.append((k, last))
        runs.append((k, n))
    assert sorted((r.k, r.f) for r in B.filled(df, F.col("v"), "k", name="f", parts=parts).collect()) == fill
    assert sorted((r.k, r.n) for r in B.change_count(df, "c", "k", name="n", parts=parts).collect()) == runs
    assert B.numbered(df.where("1 = 0"), "k", parts=parts).collect() == []
    for groups in (1, 7, 199, 300):
        sizes = {r.grp: r["count"] for r in A.balanced_split(df.select("k"), groups, "k").groupBy("grp").count().collect()}
        want = [200 // groups + (g < 200 % groups) for g in range(groups)]
        assert [sizes.get(g, 0) for g in range(groups)] == want
    assert tuple(A.value_bounds(df, "k").first()) == (0, 199)


def chain(spark, rows, options, dtype="byte", kind="int"):
    return P_chain.parse(options, len(rows), len(rows[0]), dtype)(image(spark, rows, kind))


def test_filters_after_a_crop_of_each_section(spark):
    rows = [[0, 0, 0, 0], [0, 1, 2, 0], [0, 3, 4, 0], [0, 0, 0, 0]]
    assert array(chain(spark, rows, [("c", None), ("f", None)])) == [[3, 4], [1, 2]]
    assert array(chain(spark, rows, [("c", "."), ("p", "1,1,1,1")])) == [[0, 0, 0, 0], [0, 1, 2, 0], [0, 3, 4, 0], [0, 0, 0, 0]]
    assert array(chain(spark, rows, [("c", None), ("p", "0,0,1,0"), ("f", None)])) == [[0, 0], [3, 4], [1, 2]]
    blurred = array(chain(spark, [[float(v) for v in r] for r in rows], [("c", None), ("s", "1.0")], "float", "double"))
    assert np.allclose(blurred, array(N.gauss_blur(image(spark, [[1.0, 2.0], [3.0, 4.0]], "double"), 2, 2, 1.0)))
    assert array(chain(spark, rows, [("c", None), ("l", None)])) == [[1, 1], [1, 1]]
    # a second found box is the first one again
    assert array(chain(spark, rows, [("c", None), ("0", None)])) == [[0, 0], [0, 4]]
    two = image(spark, rows).unionByName(image(spark, [[5, 5, 5, 5], [5, 5, 9, 5], [5, 5, 5, 5], [5, 5, 5, 5]]).withColumn("z", F.lit(1)))
    got = P_chain.parse([("c", None), ("p", "1,0,0,0"), ("f", None)], 4, 4)(two)
    assert array(got.where("z = 0")) == [[3, 4], [1, 2], [0, 0]] and array(got.where("z = 1")) == [[9], [0]]


def test_types_follow_the_chain(spark):
    assert array(chain(spark, [[0, 200]], [("t", "100"), ("F", None)])) == [[0, 1]]
    assert array(chain(spark, [[0, 255]], [("F", None), ("F", None)])) == [[0, 1]]
    assert np.allclose(array(chain(spark, [[0, 7, 0, 9, 0, 9]], [("r", None), ("F", None)])), [[0, 1 / 255, 0, 2 / 255, 0, 3 / 255]])
    assert array(chain(spark, [[0, 7]], [("r", None), ("F", None)])) == [[0, 1]]
    with pytest.raises(ValueError):
        chain(spark, [[0, 255]], [("F", None), ("H", "64")])


def test_files_of_boxes_and_histograms(spark, tmp_path):
    (tmp_path / "boxes").write_text("0,0,0,1\n1 1 1 1\nnot a box\n0,0,1,1\n")
    px = None
    for z in range(4):
        one = image(spark, [[1, 2], [3, 4]]).withColumn("z", F.lit(z * 2))
        px = one if px is None else px.unionByName(one)
    path = str(tmp_path / "boxes")
    got = P_chain.parse([("0", path)], 2, 2)(px)
    assert [array(got.where(F.col("z") == 2 * z)) for z in range(4)] == [[[1, 2], [0, 0]]] + [[[0, 0], [0, 4]]] * 3
    got = P_chain.parse([("c", path), ("p", "0,1,0,0")], 2, 2)(px)
    assert [array(got.where(F.col("z") == 2 * z)) for z in range(2)] == [[[0, 1, 2]], [[0, 4]]]
    got = P_chain.parse([("m", path)], 2, 2)(px)
    assert array(got.where("z = 0")) == [[1, 2], [1, 2]]
    (tmp_path / "hist").write_text("".join(f"{1 + k % 7}\n" for k in range(100)))
    v = image(spark, [[int(x) for x in row] for row in np.random.default_rng(1).integers(0, 256, (8, 8))])
    target = spark.range(100).selectExpr("cast(id as int) as bin", "1 + id % 7 as n")
    assert array(P_chain.parse([("H", str(tmp_path / "hist"))], 8, 8)(v)) == array(N.equalise(v, target=target))


def test_signed_images_equalise_by_their_bits(spark):
    v = np.random.default_rng(2).integers(-128, 128, (6, 7))
    got = np.array(array(N.equalise_type(image(spark, v.tolist()), "sbyte")))
    want = np.array(array(N.equalise(image(spark, (v % 256).tolist()))))
    assert (got % 256 == want).all() and got.min() < 0
    with pytest.raises(ValueError):
        N.equalise_type(image(spark, [[1]]), "double")
    with pytest.raises(ValueError):
        N.equalise(image(spark, [[1]]), target=spark.range(70_000).selectExpr("id as bin", "1 as n"))


def test_iterative_relabel(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 4, (11, 13))
    px = image(spark, v.tolist())
    got = N.relabel_large(px, 13)
    assert array(got) == N.relabel_array(v).tolist()
    assert N.label_count(got).first().n == N.relabel_array(v).max()


def test_slices_pairs_and_removal(spark):
    px = spark.range(10).selectExpr("cast(id as int) as z", "0 as y", "0 as x", "id as v")
    assert sorted(r.z for r in P.slice_sections(px, 1, 8, 3).collect()) == [1, 4, 7]
    assert sorted(r.z for r in P.slice_sections(px, step=4).collect()) == [0, 4, 8]
    with pytest.raises(ValueError):
        P.slice_sections(px, step=0)
    pairs = P.pair_sections(px, px.where("z > 7").withColumn("v", -F.col("v")))
    assert sorted((r.z, r.v, r.label) for r in pairs.collect()) == [(8, 8, -8), (9, 9, -9)]
    assert P.remove_all(px).collect() == []
    h = spark.createDataFrame([(5, 5, 5.0, 1.0, 2.0, 1.5, 4)], "nz int, mz int, zlen double, amin double, amax double, amean double, nx int")
    assert tuple(P.empty_header(h).first()) == (0, 0, 0.0, 0.0, 0.0, 0.0, 4)


def test_blur_with_missing_pixels(spark):
    """A pixel that is missing, or null, adds nothing and stays missing, wherever it lies."""
    image_ = [[1.0, 2.0, 3.0, 4.0], [5.0, None, 7.0, 8.0], [9.0, 10.0, None, 12.0], [13.0, 14.0, 15.0, 16.0], [17.0, 18.0, 19.0, 20.0]]
    gone = {(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (2, 2), (4, 3)}
    rows = [(0, y, x, v) for y, row in enumerate(image_) for x, v in enumerate(row) if (y, x) not in gone or v is None]
    got = {(r.y, r.x): r.v for r in N.gauss_blur(spark.createDataFrame(rows, "z int, y int, x int, v double"), 5, 4, 1.0).collect()}
    full = np.array([[0.0 if (y, x) in gone else v for x, v in enumerate(row)] for y, row in enumerate(image_)])
    there = np.array([[(y, x) not in gone for x in range(4)] for y in range(5)])
    w = N.kernel(1.0)
    mirrored = np.pad(full, ((4, 4), (0, 0)), "symmetric")
    once = sum(k * mirrored[d : d + 5] for d, k in enumerate(w)) * there
    mirrored = np.pad(once, ((0, 0), (4, 4)), "symmetric")
    want = sum(k * mirrored[:, d : d + 4] for d, k in enumerate(w))
    assert set(got) == {(y, x) for y in range(5) for x in range(4) if there[y, x]}
    assert all(abs(got[y, x] - want[y, x]) < 1e-9 for y, x in got)
