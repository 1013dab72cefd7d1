import struct
import zlib

import numpy as np
import pytest

from lamella.sources import codecs, metaimage, mrc, sections, text


def stack(spark, dtype, nz=5, ny=3, nx=4, seed=1):
    rng = np.random.default_rng(seed)
    kind = "<" + mrc.TYPES[dtype].numpy
    size = ny * nx * (3 if dtype == "rgb24" else 1)
    rows = [(z, ny, nx, dtype, bytearray(rng.integers(0, 100, size).astype(kind).tobytes())) for z in range(nz)]
    return rows, spark.createDataFrame(rows, sections.SECTION)


@pytest.mark.parametrize("dtype", ["byte", "sbyte", "short", "ushort", "float", "rgb24"])
def test_mrc_round_trip(spark, tmp_path, dtype):
    mrc.register(spark)
    rows, df = stack(spark, dtype)
    path = str(tmp_path / "a.mrc")
    df.repartition(3).write.format("mrc").mode("append").option("path", path).save()
    back = spark.read.format("mrc").option("sectionsPerPartition", "2").load(path)
    assert sorted((r.z, r.ny, r.nx, r.dtype, bytes(r.pixels)) for r in back.collect()) == [(*r[:4], bytes(r[4])) for r in rows]
    assert [r.z for r in back.where("z > 1 and z <= 3").orderBy("z").collect()] == [2, 3]
    assert [r.z for r in back.where("z in (0, 4)").orderBy("z").collect()] == [0, 4]
    h = mrc.headers(spark, [path]).first()
    assert (h.nx, h.ny, h.nz, h.dtype, h.endian, len(h.labels)) == (4, 3, 5, dtype, "<", 1)
    assert h.amin == min(np.frombuffer(r[4], "<" + mrc.TYPES[dtype].numpy).min() for r in rows)


def test_mrc_big_endian(spark, tmp_path):
    mrc.register(spark)
    h = mrc.new_header(2, 1, 2, "float")
    h.endian, h.fields["stamp"] = ">", mrc.BIG_STAMP
    h.fields["next"], h.extra = 3, b"abc"
    (tmp_path / "b.mrc").write_bytes(mrc.pack_header(h) + np.array([1.5, 2.5, 3.5, 4.5], ">f4").tobytes())
    got = sections.to_pixels(spark.read.format("mrc").load(str(tmp_path / "b.mrc"))).orderBy("z", "x").collect()
    assert [r.v for r in got] == [1.5, 2.5, 3.5, 4.5]


@pytest.mark.parametrize(("field", "value"), [("nx", 0), ("mode", 4), ("mode", 9), ("alpha", 45.0), ("mapc", 2), ("nxstart", 1), ("nlabl", 11), ("next", -1)])
def test_mrc_rejects(field, value):
    h = mrc.new_header(2, 2, 2, "byte")
    h.fields[field] = value
    with pytest.raises(mrc.MrcError):
        mrc.parse_header(mrc.pack_header(h))


def test_mrc_header_formats():
    assert struct.calcsize("<" + mrc.NEW_FORMAT) == struct.calcsize("<" + mrc.OLD_FORMAT) == mrc.FIXED
    with pytest.raises(mrc.MrcError):
        mrc.parse_header(b"short")


def test_mrc_writer_wants_all_sections(spark, tmp_path):
    mrc.register(spark)
    _, df = stack(spark, "byte")
    with pytest.raises(Exception, match="without gaps"):
        df.where("z <> 2").write.format("mrc").mode("append").option("path", str(tmp_path / "c.mrc")).save()


@pytest.mark.parametrize("dtype", ["byte", "sbyte", "short", "ushort", "int", "uint", "long", "ulong", "rgb24", "float", "double"])
@pytest.mark.parametrize("compressed", [False, True])
def test_metaimage_round_trip(dtype, compressed):
    v = np.arange(12 * (3 if dtype == "rgb24" else 1)).astype("<" + metaimage.TYPES[dtype].numpy).tobytes()
    head, body = metaimage.encode(v, 3, 4, dtype, compressed=compressed, tags={"ElementSpacing": [1, 2], "Comment": "x"})
    tags, layout, parts = metaimage.decode(head + body, None)
    assert parts == [v] and (layout.ny, layout.nx, layout.nz, layout.type.name) == (3, 4, 1, dtype)
    assert tags["ElementSpacing"] == "1.0 2.0"


def test_metaimage_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"s{k}.raw").write_bytes(bytes([k] * 4))
    base = "ObjectType = Image\nNDims = 3\nDimSize = 2 2 3\nElementType = MET_UCHAR\n"
    (tmp_path / "list.mhd").write_bytes((base + "ElementDataFile = LIST\ns2.raw\ns1.raw\ns0.raw\n").encode())
    (tmp_path / "pattern.mhd").write_bytes((base + "ElementDataFile = s%d.raw 0 2 1\n").encode())
    (tmp_path / "one.mhd").write_bytes((base.replace("UCHAR", "SHORT") + "HeaderSize = -1\nBinaryDataByteOrderMSB = True\nElementDataFile = one.raw\n").encode())
    (tmp_path / "one.raw").write_bytes(b"junk" + np.arange(12, dtype=">i2").tobytes())
    got = {r.path.rpartition("/")[2] + str(r.z): bytes(r.pixels) for r in metaimage.read(spark, str(tmp_path / "*.mhd")).collect()}
    assert got["list.mhd0"] == b"\2\2\2\2" and got["pattern.mhd0"] == b"\0\0\0\0"
    assert got["one.mhd2"] == np.arange(8, 12, dtype="<i2").tobytes()
    assert metaimage.read_tags(spark, str(tmp_path / "list.mhd")).first().tags["NDims"] == "3"


@pytest.mark.parametrize("change", ["ObjectType = Scene", "NDims = 0", "DimSize = 2", "ElementType = MET_NONE", "BinaryData = False", "HeaderSize = -2", "ElementNumberOfChannels = 2", "BinaryData = maybe"])
def test_metaimage_rejects(change):
    tags = {"ObjectType": "Image", "NDims": "2", "DimSize": "2 2", "ElementType": "MET_SHORT"}
    k, _, v = change.partition(" = ")
    head = "".join(f"{a} = {b}\n" for a, b in (tags | {k: v}).items()) + "ElementDataFile = LOCAL\n"
    with pytest.raises(ValueError):
        metaimage.decode(head.encode() + bytes(64), None)


def test_metaimage_tag_rules():
    for bad in ({"NDims": 3}, {"Position": 1, "Origin": 2}, {"a b": 1}, {"ElementSpacing": [1, 2, 3]}, {"compresseddata": True}):
        with pytest.raises(metaimage.MetaError):
            metaimage.validate_tags(bad, 2)
    assert metaimage.validate_tags({"rotation": 0}, 2) == {"Rotation": "0.0 0.0 0.0 0.0"}


@pytest.mark.parametrize("kind", ["gzip", "zlib", "deflate"])
def test_codecs(kind):
    data = b"pixel" * 1000
    for level in range(1, 10):
        packed = codecs.compress(data, kind, level)
        assert codecs.kind_of(packed) == kind and codecs.decompress(packed) == data
    with pytest.raises((ValueError, zlib.error)):
        codecs.decompress(codecs.compress(data, kind)[:-9], kind)


def test_codecs_members_and_padding():
    a, b = codecs.compress(b"a"), codecs.compress(b"b")
    assert codecs.decompress(a + b + b"\0\0\0") == b"ab"


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 3 4\n\n 1 5 6 -7 \n")
    (tmp_path / "b.txt").write_text("2 0 0 0\n")
    p = text.read_points(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    assert [(r.file_ord, r.contour, r.z) for r in p.orderBy("file_ord", "line_no").collect()] == [(0, 1, 4), (0, 1, -7), (1, 2, 0)]
    text.write_points(p, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1 2 3 4", "1 5 6 -7", "2 0 0 0"]
    (tmp_path / "bad.txt").write_text("1 2 3\n")
    with pytest.raises(Exception, match="not a point"):
        text.read_points(spark, [str(tmp_path / "bad.txt")]).collect()
    (tmp_path / "h.txt").write_text("5\n0\n7\n")
    h = text.read_histogram(spark, str(tmp_path / "h.txt"))
    assert [(r.bin, r.n) for r in h.orderBy("bin").collect()] == [(0, 5), (1, 0), (2, 7)]
    (tmp_path / "log").write_text("*a=1\n2020-01-02 03:04:05 do it\n2020-01-02 03:04:06 do it\n*a=2\n")
    log, settings = text.read_log(spark, str(tmp_path / "log"))
    assert log.count() == 2 and {r.v for r in settings.collect()} == {"1", "2"}
    (tmp_path / "use").write_text("my task 0.5 1.5 " + " ".join(map(str, range(14))) + "\n")
    u = text.read_usage(spark, str(tmp_path / "use")).first()
    assert (u.task, u.utime, u.maxrss, u.nivcsw) == ("my task", 0.5, 0, 13)
