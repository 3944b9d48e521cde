import numpy as np
import pytest

from tessera.model import InvalidInput, NotFound, Rejected
from tessera.sources import container, datasource
from tessera.tensorset import Arrays, TensorSet, index, load_file, page_size, save_file


def test_arrays_round_trip(tmp_path):
    path = str(tmp_path / "a.zt")
    arrays = {"f": np.arange(6, dtype="f4").reshape(2, 3), "b": np.array([True, False]), "c": np.array([1 + 2j]), "s": np.float64(3.5), "e": np.zeros((0, 4), "i2"), "big": np.arange(3, dtype=">i4")}
    save_file(arrays, path, {"k": 1})
    got = load_file(path)
    assert all(np.array_equal(got[k], v) and got[k].shape == np.shape(v) for k, v in arrays.items()) and list(Arrays(path)) == sorted(arrays)
    assert container.open_file(path).attributes == {"k": 1} and container.canonical_violations(*container.file_reader(path)) == []
    with pytest.raises(InvalidInput):
        save_file({"o": np.array([object()])}, str(tmp_path / "o.zt"))


def test_tensor_set(spark, tmp_path):
    a, b = str(tmp_path / "a.zt"), str(tmp_path / "b.npz")
    save_file({"x": np.arange(4, dtype="f4"), "y": np.ones(2)}, a)
    np.savez(b, z=np.arange(3))
    s = TensorSet.read(spark, [a, b])
    assert [r["name"] for r in s.names().collect()] == ["x", "y", "z"] and len(s) == 3 and "x" in s and "q" not in s
    assert [(r["name"], r["shape"], r["nbytes"]) for r in s.describe().collect()] == [("x", "[4]", 16), ("y", "[2]", 16), ("z", "[3]", 24)]
    caps = {r["name"]: r for r in s.capabilities().collect()}
    assert caps["x"]["evict"] and caps["x"]["verify"] and caps["x"]["alignment"] == 65536 and not caps["z"]["verify"]
    assert [bytes(r["content"]) for r in s.bytes(["y"]).collect()] == [np.ones(2).tobytes()]
    assert {r["name"]: r["status"] for r in s.verify().collect()} == {"x": "ok", "y": "ok", "z": "no_digest"}
    with pytest.raises(NotFound):
        s.tensor("q")
    s.write(str(tmp_path / "out.zt"))
    assert {k: v.tolist() for k, v in load_file(str(tmp_path / "out.zt")).items()} == {"x": [0, 1, 2, 3], "y": [1, 1], "z": [0, 1, 2]}


def test_every_layout_comes_back(spark, tmp_path):
    """Sparse and encoded objects, several parts, attributes with bytes and floats, and those of the file."""
    path, out = str(tmp_path / "a.zt"), str(tmp_path / "b.zt")
    csr = {"indptr": container.part("u64", np.array([0, 1, 2], "<u8").tobytes()), "indices": container.part("u64", np.array([1, 0], "<u8").tobytes()), "values": container.part("f32", np.array([2, 3], "<f4").tobytes())}
    with container.Writer(path, canonical=False) as w:
        w.set_attributes({"made": b"by \xff", "n": [1, float("inf"), None], "$x": 1})
        w.object("m", [2, 2], "zt.sparse_csr/1", csr, {"k": {"a": 1.5}})
        w.add("plain", [3], "u8", b"abc")
        w.object("z", [4096], "dense", {"data": container.part("u8", bytes(4096), encoding="zt.zstd-seekable/1")}) if w.vocabulary.encoding("zt.zstd-seekable/1") else w.add("z", [1], "u8", b"z")
    s = TensorSet.read(spark, [path])
    assert {r["status"] for r in s.verify().collect()} == {"ok"} and {r["path"] for r in s.provenance().collect()} == {path}
    s.write(out)
    a, b = container.open_file(path), container.open_file(out)
    assert a.attributes == b.attributes and a.names() == b.names()
    for name in a.names():
        x, y = a.tensor(name), b.tensor(name)
        assert (x["shape"], x["layout"], x.get("attributes")) == (y["shape"], y["layout"], y.get("attributes"))
        for role, p in x["parts"].items():
            assert a.bytes(name, role) == b.bytes(name, role) and p.get("encoding") == y["parts"][role].get("encoding")
    assert s.digest("xxh3") == a.content_digest("xxh3") == TensorSet.read(spark, [out]).digest("xxh3") and s.digest() == a.content_digest()
    assert [(r["format"], r["objects"]) for r in index(spark, [path, out]).collect()] == [("zt", 3)] * 2 and page_size() == 4096


def test_large_files_are_read_by_several_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a.zt")
    save_file({f"t{i:03d}": np.full(1000, i) for i in range(40)}, path)
    monkeypatch.setattr(datasource, "TASK_BYTES", 1 << 20)
    got = TensorSet.read(spark, [path]).bytes()
    assert got.count() == 40 and datasource._Reader({"path": path}, "blobs").partitions()[-1].shares > 1


def test_merge_and_stray_parts(spark, tmp_path):
    a, b = str(tmp_path / "a.zt"), str(tmp_path / "b.zt")
    save_file({"x": np.ones(1)}, a)
    save_file({"y": np.ones(1)}, b)
    one, two = TensorSet.read(spark, [a]), TensorSet.read(spark, [b])
    both = one.merge(two)
    assert sorted((r["name"], r["store_id"]) for r in both.parts.collect()) == [("x", 0), ("y", 1)] and both.stores.count() == 2
    with pytest.raises(Rejected):
        one.merge(one)
    with pytest.raises(Rejected):
        TensorSet.read(spark, [a, _copy(a, str(tmp_path / "c.zt"))])
    with pytest.raises(InvalidInput):
        TensorSet.from_parts(both.objects, both.parts, one.stores)


def _copy(a, b):
    open(b, "wb").write(open(a, "rb").read())
    return b
