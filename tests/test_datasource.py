import os
import pickle

import pytest
from pyspark.sql import functions as F

from tessera.sources import container, datasource


@pytest.fixture(scope="module")
def src(spark):
    datasource.register(spark)
    return spark


def table(spark, n=20):
    return spark.range(n).select(F.format_string("t%03d", F.col("id")).alias("name"), F.lit("u8").alias("dtype"), F.array(F.lit(4).cast("long")).alias("shape"), F.format_string("%04d", F.col("id")).cast("binary").alias("content"))


def test_write_and_read(src, tmp_path):
    path = str(tmp_path / "m.zt")
    table(src).repartition(3).write.format("tensorfile").option("path", path).mode("append").save()
    source = container.open_file(path)
    assert len(source) == 20 and source.bytes("t007") == b"0007"
    source.verify_shards()
    back = src.read.format("tensorfile").option("path", path).option("relation", "blobs").load()
    assert sorted(bytes(r["content"]) for r in back.collect()) == [b"%04d" % i for i in range(20)]
    parts = src.read.format("tensorfile").option("path", path).load()
    assert parts.where("name = 't003'").select("length", "dtype", "status").collect()[0].asDict() == {"length": 4, "dtype": "u8", "status": "ok"}
    assert parts.count() == 20
    assert src.read.format("tensorfile").option("path", path).option("name", "t003").load().count() == 1


def test_names_that_collide_publish_nothing(src, tmp_path):
    path = str(tmp_path / "c.zt")
    with pytest.raises(Exception, match="NameCollision|already"):
        table(src).union(table(src)).repartition(2, "content", F.rand(1)).write.format("tensorfile").option("path", path).mode("append").save()
    assert not (tmp_path / "c.zt").exists()


def test_permissive_reading(src, tmp_path):
    (tmp_path / "bad.zt").write_bytes(container.MAGIC + bytes(60))
    got = src.read.format("tensorfile").option("path", str(tmp_path)).option("mode", "permissive").load().collect()
    assert [r["status"] for r in got] == ["FooterMagic"]
    with pytest.raises(Exception, match="FooterMagic"):
        src.read.format("tensorfile").option("path", str(tmp_path)).load().collect()


def _everything(path, **options):
    """All rows of the three relations by a reader in this process, and its numbers of tasks."""
    out, tasks = {}, {}
    for relation in ("parts", "blobs", "files"):
        reader = datasource._Reader({"path": path} | options, relation)
        found = pickle.loads(pickle.dumps(list(reader.partitions())))
        out[relation], tasks[relation] = sorted((r for p in found for r in reader.read(p)), key=repr), len(found)
    return out, tasks


def test_a_large_manifest_is_read_by_ranges(src, tmp_path, monkeypatch):
    """The same rows as from a manifest that is taken whole, by several tasks, with windows far smaller than the manifest."""
    path = str(tmp_path / "m.zt")
    rows = table(src, 300).withColumn("attributes", F.format_string('{"n": "%s"}', "name"))
    rows.repartition(3).write.format("tensorfile").option("path", path).option("attributes", '{"made": [1, 2.5]}').mode("append").save()
    assert sorted(f for f in os.listdir(tmp_path) if f.startswith(".")) == []
    container.open_file(path).verify_shards()
    whole, tasks = _everything(path)
    assert set(tasks.values()) == {1} and len(whole["parts"]) == 300
    one = _everything(path, name="t007")[0]
    monkeypatch.setattr(datasource, "WHOLE_MANIFEST", 0)
    monkeypatch.setattr(datasource, "TASK_OBJECTS", 70)
    monkeypatch.setattr(datasource, "TASK_BYTES", 100)
    monkeypatch.setattr(container.cbor.Window.__init__, "__defaults__", (64,))
    monkeypatch.setattr(container, "open_file", None)
    got, tasks = _everything(path)
    assert got == whole and tasks == {"parts": 5, "blobs": 12, "files": 1}
    assert _everything(path, name="t007")[0] == one and len(one["blobs"]) == 1
    assert _everything(path, name="none")[0]["blobs"] == []


@pytest.mark.parametrize("rule", ["BlobOverlap", "BlobBounds", "Schema", "CborDeterminism", "CborDuplicateKey", "ManifestHash", "CborSyntax"])
def test_a_large_manifest_is_checked(tmp_path, monkeypatch, rule):
    """By ranges a bad manifest is told by the rule that it breaks when it is taken whole."""
    path = str(tmp_path / "m.zt")
    w = container.Writer(path, canonical=False)
    for i in range(50):
        w.add(f"t{i:03d}", [5000], "u8", bytes([i]) * 5000)
    if rule == "BlobOverlap":
        w.objects["t031"]["parts"]["data"]["blob"][0] -= 65536 - 4096
    if rule == "BlobBounds":
        w.objects["t030"]["parts"]["data"]["blob"][0] = 1 << 40
    if rule == "Schema":
        del w.objects["t030"]["layout"]
    rows = sorted(container.cbor.encode(n) + container.cbor.encode(o) for n, o in w.objects.items())
    if rule == "CborDeterminism":
        rows[7:9] = rows[8], rows[7]
    if rule == "CborDuplicateKey":
        rows[8] = rows[7]
    w.finish_with(49 if rule == "CborSyntax" else 50, iter(rows))
    if rule == "ManifestHash":
        raw = bytearray(open(path, "rb").read())
        raw[-60] ^= 1
        open(path, "wb").write(raw)
    for most in (1 << 20, 0):
        monkeypatch.setattr(datasource, "WHOLE_MANIFEST", most)
        assert [r[-1] for rows in _everything(path, mode="permissive")[0].values() for r in rows] == [rule] * 3
        with pytest.raises(datasource.Rejected, match=rule):
            _everything(path)


def test_many_objects_through_spark(src, tmp_path):
    """A manifest beyond what is taken whole, by Spark's own tasks."""
    path = str(tmp_path / "m.zt")
    table(src, 9900).write.format("tensorfile").option("path", path).mode("append").save()
    assert container.frame_of(*container.file_reader(path)).manifest[1] > datasource.WHOLE_MANIFEST
    load = lambda relation: src.read.format("tensorfile").option("path", path).option("relation", relation).load()
    assert load("parts").count() == 9900 and load("files").collect()[0]["objects"] == 9900
    assert load("blobs").where("int(substring(name, 2)) <> int(cast(content AS string))").count() == 0
