"""LAS and PLY files written here by hand and read back."""

import struct

import pytest

from cragspan.sources import binary

POINTS = [(1.0, 2.0, 3.0), (4.5, -5.25, 6.125), (7.0, 8.0, 9.0)]


def _las(path, kind=3, width=34):
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes([1, 2])
    struct.pack_into("<HI4xBHI", head, 94, 227, 227, kind, width, len(POINTS))
    struct.pack_into("<6d", head, 131, 0.001, 0.001, 0.001, 100.0, 200.0, 0.0)
    body = b"".join(struct.pack("<iiiHBBbBHdHHH", round((x - 100) * 1000), round((y - 200) * 1000), round(z * 1000), 60000, 2 | 3 << 3, 0x80 | 6, 0, 0, 9, 1.5, 65535, 2, 3) + bytes(width - 34) for x, y, z in POINTS)
    path.write_bytes(bytes(head) + body)
    return str(path)


@pytest.mark.parametrize("width", [34, 40])
def test_las(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(binary, "CHUNK", 2)
    got = binary.read_las(spark, _las(tmp_path / "a.las", width=width)).orderBy("pid").collect()
    assert [tuple(round(r[a], 6) for a in "xyz") for r in got] == POINTS
    assert tuple(got[2])[4:] == (60000, 2, 3, 6, 1.5, 65535, 2, 3)


def test_las_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="LAZ"):
        binary.read_las(spark, _las(tmp_path / "a.laz", kind=0x83))
    (tmp_path / "b.las").write_bytes(b"no")
    with pytest.raises(ValueError, match="not a LAS"):
        binary.read_las(spark, str(tmp_path / "b.las"))
    cut = tmp_path / "c.las"
    _las(cut)
    cut.write_bytes(cut.read_bytes()[:-5])
    with pytest.raises(Exception, match="before its last record"):
        binary.read_las(spark, str(cut)).collect()


@pytest.mark.parametrize("layout", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply(spark, tmp_path, layout):
    head = f"ply\nformat {layout} 1.0\ncomment made here\nelement vertex 3\nproperty float x\nproperty float y\nproperty double z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    if layout == "ascii":
        body = "".join(f"{x} {y} {z} 7\n" for x, y, z in POINTS).encode() + b"3 0 1 2\n"
    else:
        body = b"".join(struct.pack(("<" if "little" in layout else ">") + "ffdB", *p, 7) for p in POINTS) + b"\x03" + bytes(12)
    (tmp_path / "a.ply").write_bytes(head.encode() + body)
    got = binary.read_ply(spark, str(tmp_path / "a.ply")).orderBy("pid").collect()
    assert [(r.x, r.y, r.z) for r in got] == POINTS
    assert {r.red for r in got} == {7}


def test_ply_refused(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n1\n")
    with pytest.raises(ValueError, match="need x, y and z"):
        binary.read_ply(spark, str(tmp_path / "a.ply"))
