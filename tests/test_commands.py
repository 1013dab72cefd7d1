import numpy as np
import pytest

from lamella.plans import commands
from lamella.sources import metaimage, mrc


def test_stack_and_images(spark, tmp_path):
    v = np.arange(3 * 4 * 5, dtype=np.uint8).reshape(3, 4, 5)
    stack = tmp_path / "in.mrc"
    stack.write_bytes(mrc.pack_header(mrc.new_header(5, 4, 3, "byte")) + v.tobytes())
    folder = str(tmp_path / "out")
    assert commands.stack_to_images(spark, str(stack), folder, select="0,2", x=(1, 3), y=(0, 1), filters=[("flip", None)]) == 2
    got = {r.path[-8:-4]: np.frombuffer(bytes(r.pixels), np.uint8).reshape(r.ny, r.nx) for r in metaimage.read(spark, folder).collect()}
    assert (got["0002"] == v[2, :2, 1:4][::-1]).all() and set(got) == {"0000", "0002"}
    back = str(tmp_path / "back.mrc")
    commands.images_to_stack(spark, folder, back)
    assert mrc.read_header(back).fields["nz"] == 2
    # inputs keep the order given, the files of a pattern that of their paths
    both = str(tmp_path / "both.mrc")
    commands.images_to_stack(spark, [folder + "/0002.mha", folder + "/*.mha"], both)
    found = {r.z: bytes(r.pixels) for r in mrc.read(spark, both).collect()}
    assert found[0] == found[2] == got["0002"].tobytes() and found[1] == got["0000"].tobytes() and len(found) == 3
    with pytest.raises(ValueError):
        commands.listed(spark, [])
    h = {r.bin: r.n for r in commands.histogram(spark, folder).collect()}
    assert len(h) == 256 and sum(h.values()) == 12
    assert commands.convert(spark, f"{folder}/0000.mha", str(tmp_path / "one"), filters=[("thresh", "3")], dtype="byte") == 1
    with pytest.raises(ValueError):
        commands.stack_to_images(spark, str(stack), folder, x=(0, 5))


def test_points_and_files(spark, tmp_path):
    (tmp_path / "a").write_text("1 0 0 0\n1 1 0 0\n2 0 0 0\n")
    (tmp_path / "b").write_text("2 0 0 1\n3 0 0 1\n")
    commands.merge_points(spark, [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["1 0 0 0", "1 1 0 0", "2 0 0 0", "2 0 0 1", "3 0 0 1"]
    files = spark.createDataFrame([("x/001.tif",), ("x/002.tif",), ("x/.a",)], "path string")
    allowed = spark.createDataFrame([(1,)], "n long")
    assert sorted(r.path for r in commands.unlisted(files, allowed).collect()) == ["x/.a", "x/002.tif"]


def test_options():
    assert commands.number("0.5", 0, 1) == 0.5 and commands.number("40", 1, 40, integer=True) == 40
    assert commands.overlap("25") == (25, 25) and commands.overlap("3x4") == (3, 4)
    for bad in (("x",), ("2", 0, 1), ("nan",), ("1.5", 0, 9)):
        with pytest.raises(ValueError):
            commands.number(*bad, integer=bad[0] == "1.5")
    with pytest.raises(ValueError):
        commands.overlap("3x")
