import hashlib
import time

from pyspark.sql import functions as F

from tessera.streaming import chunks, windows

FOLDER = "/root/testdata/sf0.001"


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_sink(spark, tmp_path):
    data = [("a", "d", 1, 6, b"def"), ("a", "d", 0, 6, b"abc"), ("b", "d", 0, 2, b"xyz"), ("c", "d", 0, 9, b"x")]
    schema = "name string, part string, seq long, declared long, content binary"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    # a query with timeouts never runs out of batches, so it is stopped when its rows are there
    q = chunks.sink(stream).writeStream.format("memory").queryName("sunk").outputMode("append").start()
    try:
        end = time.time() + 120
        while spark.table("sunk").count() < 2 and q.isActive and time.time() < end:
            time.sleep(0.5)
        got = {r["name"]: r for r in spark.table("sunk").collect()}
    finally:
        q.stop()
    assert got["a"]["status"] == "complete" and got["a"]["digest"].endswith("bef57ec7f53a6d40beb640a780a639c83bc29ac8a9816f1fc6c5c6dcd93c4721")
    assert got["b"]["status"] == "overrun" and "c" not in got  # c still waits


def test_completion(spark):
    df = spark.createDataFrame([("a", "d", 3, 6), ("a", "d", 3, 6), ("b", "d", 3, 2), ("c", "d", 1, 2)], "name string, part string, length long, declared long")
    assert {r["name"]: r["status"] for r in chunks.completion(df).collect()} == {"a": "complete", "b": "overrun", "c": "short"}


def test_windows_on_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = run(windows.tumbling(stream), "tumbled", "update").agg(F.sum("n")).first()[0]
    assert got == events.count()
    assert windows.sliding(events).agg(F.sum("n")).first()[0] == 2 * events.count()
    assert windows.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_sink_reports_short_parts_and_leaves_no_files(spark, tmp_path):
    """Chunks out of turn and twice, a part that never ends; what was spooled goes."""
    rows = [("a", "d", k, 3000, bytes([k]) * 1000) for k in (2, 0, 1, 0)] + [("c", "d", 0, 9, b"x"), ("e", "d", 0, 0, b"")]
    schema = "name string, part string, seq long, declared long, content binary"
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    folder = tmp_path / "spool"
    q = chunks.sink(stream, 3000, str(folder)).writeStream.format("memory").queryName("sunk2").outputMode("append").start()
    try:
        end = time.time() + 120
        while spark.table("sunk2").count() < 3 and q.isActive and time.time() < end:
            time.sleep(0.5)
        got = {r["name"]: r for r in spark.table("sunk2").collect()}
    finally:
        q.stop()
    assert {n: r["status"] for n, r in got.items()} == {"a": "complete", "c": "short", "e": "complete"} and got["c"]["written"] == 1
    assert got["a"]["digest"] == "sha256:" + hashlib.sha256(b"".join(bytes([k]) * 1000 for k in range(3))).hexdigest()
    assert not list(folder.iterdir())
