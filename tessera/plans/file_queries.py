"""Registered queries over tensor files: the driver's tables go through the writers, and come back through the readers.

Files are written in a folder of their own under the cluster's shared folder, which has to be mounted where tasks run."""

from __future__ import annotations

import json
import os
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CANONICAL, InvalidInput
from ..operators import catalog, identity, layout
from ..sources import container, datasource, foreign
from ..tensorset import TensorSet, index
from . import tables

#: Cells, about, of a block of rows of a sparse matrix: a block has the rows that begin within as many.
BLOCK_CELLS = 1 << 16

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def folder_of(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="tessera-")
    out = os.path.join(root.removeprefix("file://"), f"tessera-files-{uuid.uuid4().hex}")
    os.makedirs(out)
    return out


def _write(rows: DataFrame, path: str, **options: str) -> str:
    datasource.register(rows.sparkSession)
    rows.write.format("tensorfile").option("path", path).options(**options).mode("append").save()
    return path


def _documents(spark: SparkSession, folder: str, path: str | None = None) -> str:
    """All documents as u8 tensors of a native root with a shard for each task that reads them; texts aren't shuffled."""
    rows = tables.document_blobs(spark, folder).select("name", "dtype", F.array("length").alias("shape"), "content")
    return _write(rows, path or os.path.join(folder_of(spark), "documents.zt"))


_DOCS = "d AS (SELECT doc_id, 'doc/' || doc_id AS name, octet_length(encode(coalesce(text, ''))) AS n, coalesce(text, '') AS t FROM documents)"


# --- the native format --------------------------------------------------------------------------------------------------------


@query(f"""WITH {_DOCS} SELECT name, 'data' AS part, 'u8' AS dtype, '[' || n || ']' AS shape, 'dense' AS layout, n::BIGINT AS length, true AS aligned, true AS in_shard, 'xxh3' AS digest FROM d""")
def file_parts(spark, folder):
    """Metadata of a file that was written by tasks, one shard each."""
    got = spark.read.format("tensorfile").option("path", _documents(spark, folder)).load()
    shape = F.concat(F.lit("["), F.array_join(F.transform("shape", lambda x: x.cast("string")), ","), F.lit("]"))
    return got.select("name", "part", "dtype", shape.alias("shape"), "layout", "length", (F.col("offset") % CANONICAL == 0).alias("aligned"), F.col("shard").isNotNull().alias("in_shard"), F.substring_index("digest", ":", 1).alias("digest"))


@query(f"WITH {_DOCS} SELECT name, n::BIGINT AS nbytes, sha256(t) AS sha256 FROM d")
def file_blobs(spark, folder):
    got = spark.read.format("tensorfile").option("path", _documents(spark, folder)).option("relation", "blobs").load()
    return got.select("name", F.col("length").alias("nbytes"), F.sha2("content", 256).alias("sha256"))


@query(f"WITH {_DOCS} SELECT name, 'u8' AS dtype, '[' || n || ']' AS shape, n::BIGINT AS nbytes FROM d")
def file_listing(spark, folder):
    return TensorSet.read(spark, [_documents(spark, folder)]).describe().select("name", "dtype", "shape", "nbytes")


@query(f"WITH {_DOCS} SELECT name, 'ok' AS status FROM d")
def file_verify(spark, folder):
    """Each part against the xxh3 digest that its writer gave it."""
    return TensorSet.read(spark, [_documents(spark, folder)]).verify().select("name", "status")


@query("SELECT r_name AS name, CASE WHEN r_regionkey = 2 THEN 'mismatch' ELSE 'ok' END AS status FROM region")
def file_verify_damaged(spark, folder):
    """A byte of one tensor was changed in the file."""
    path = os.path.join(folder_of(spark), "r.zt")
    rows = sorted(tables.read(spark, folder, "region").collect(), key=lambda r: r["r_name"].encode())
    with container.Writer(path) as w:
        for r in rows:
            w.add(r["r_name"], [4], "u8", struct.pack("<i", r["r_regionkey"]))
    bad = next(r["r_name"] for r in rows if r["r_regionkey"] == 2)
    at = container.open_file(path).tensor(bad)["parts"]["data"]["blob"][0]
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(b"\xff")
    return TensorSet.read(spark, [path]).verify().select("name", "status")


@query("SELECT 'zt' AS format, (SELECT count(*) FROM documents) AS objects, true AS sharded, 'ok' AS status, 'tables' AS made UNION ALL SELECT 'npz', 2, false, 'ok', NULL")
def file_index(spark, folder):
    """A row for each file of a folder: its format, objects, shards and attributes, without the tensors."""
    home = folder_of(spark)
    rows = tables.document_blobs(spark, folder).select("name", "dtype", F.array("length").alias("shape"), "content")
    _write(rows, os.path.join(home, "d.zt"), attributes='{"made": "tables"}')
    _npz(spark, folder, os.path.join(home, "n.npz"))
    got = index(spark, [os.path.join(home, "d.zt"), os.path.join(home, "n.npz")])
    made = F.when(F.col("attributes").isNotNull(), F.try_variant_get(F.parse_json("attributes"), "$.made", "string"))
    return got.select("format", "objects", (F.size("shards") > 0).alias("sharded"), "status", made.alias("made"))


@query("SELECT 'emb/' || vec_id AS name, label::BIGINT AS label, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) IS NOT NULL AS there FROM embeddings")
def file_attributes(spark, folder):
    """Attributes of objects, written and read back."""
    src = tables.read(spark, folder, "embeddings")
    raw = src.select("vec_id", "embedding").mapInArrow(_as_bytes, "name string, shape array<long>, content binary")
    marks = src.select(F.concat(F.lit("emb/"), F.col("vec_id").cast("string")).alias("name"), F.to_json(F.struct("label")).alias("attributes"))
    path = _write(raw.join(marks, "name").withColumn("dtype", F.lit("f32")), os.path.join(folder_of(spark), "e.zt"))
    got = TensorSet.read(spark, [path])
    return got.objects.select("name", F.variant_get(F.parse_json("attributes"), "$.label", "long").alias("label"), F.lit(True).alias("there"))


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs = [np.array(x or [], "<f4") for x in batch.column("embedding").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([f"emb/{i}" for i in batch.column("vec_id").to_pylist()]), pa.array([[len(x)] for x in xs], pa.list_(pa.int64())), pa.array([x.tobytes() for x in xs], pa.binary())], names=["name", "shape", "content"])


@query("SELECT l_linenumber::BIGINT AS matrix, l_suppkey AS row, l_partkey AS col, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3")
def file_csr(spark, folder):
    """Sparse matrices of suppliers by parts, one for each line number, in blocks of whole rows that are objects of three parts each:
    through the file and back."""
    cells = tables.read(spark, folder, "lineitem").groupBy("l_linenumber", "l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    cells = cells.repartitionByRange("l_linenumber", "l_suppkey").sortWithinPartitions("l_linenumber", "l_suppkey", "l_partkey")
    most = BLOCK_CELLS

    def block(line, row, col, value):
        first, n, cols = int(row[0]), int(row[-1] - row[0]) + 1, int(col.max()) + 1
        indptr = np.concatenate([[0], np.cumsum(np.bincount(row - first, minlength=n))])
        parts = {"indptr": ("u64", indptr.astype("<u8")), "indices": ("u64", col.astype("<u8")), "values": ("f64", value.astype("<f8"))}
        made = [{"name": f"m/{line[0]}/{first}", "part": p, "dtype": d, "shape": [n, cols], "layout": "zt.sparse_csr/1", "content": x.tobytes()} for p, (d, x) in parts.items()]
        return pa.RecordBatch.from_pylist(made, pa.schema({"name": pa.string(), "part": pa.string(), "dtype": pa.string(), "shape": pa.list_(pa.int64()), "layout": pa.string(), "content": pa.binary()}))

    def made(batches):
        """A task's cells come in order, whole rows of them: no more than a block and a batch are held."""
        held = None
        for batch in batches:
            got = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
            line, row, begin = held[0], held[1], 0
            for end in (np.flatnonzero((line[1:] != line[:-1]) | (row[1:] != row[:-1])) + 1).tolist():
                if end - begin >= most or line[end] != line[begin]:
                    yield block(*(x[begin:end] for x in held))
                    begin = end
            held = [x[begin:] for x in held]
        if held is not None and len(held[0]):
            yield block(*held)

    objects = cells.mapInArrow(made, "name string, part string, dtype string, shape array<long>, layout string, content binary")
    path = _write(objects, os.path.join(folder_of(spark), "m.zt"))  # the parts of an object are rows in a row
    parts = spark.read.format("tensorfile").option("path", path).option("relation", "blobs").load().select("name", "part", "content")

    def back(batches):
        held: dict[str, dict[str, bytes]] = {}  # a reader gives the parts of an object in a row, but not in one batch
        for batch in batches:
            for name, part, content in zip(*(batch.column(c) for c in ("name", "part", "content")), strict=True):
                own = held.setdefault(name.as_py(), {})
                own[part.as_py()] = content.as_py()
                if len(own) < 3:
                    continue
                indptr, indices, values = (np.frombuffer(own[c], k) for c, k in (("indptr", "<u8"), ("indices", "<u8"), ("values", "<f8")))
                _, matrix, first = name.as_py().split("/")
                del held[name.as_py()]
                row = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr).astype(int)) + int(first)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), int(matrix))), pa.array(row), pa.array(indices.astype(np.int64)), pa.array(values)], names=["matrix", "row", "col", "value"])
        if held:
            raise InvalidInput(f"{next(iter(held))} lacks a part")

    return parts.mapInArrow(back, "matrix long, row long, col long, value double")


@query("SELECT 'doc/' || doc_id AS name, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE doc_id = 7")
def file_point_read(spark, folder):
    """One object by name: nothing else of the file is read."""
    got = spark.read.format("tensorfile").option("path", _documents(spark, folder)).option("relation", "blobs").option("name", "doc/7").load()
    return got.select("name", F.sha2("content", 256).alias("sha256"))


@query("SELECT 'r/' || r_name AS name, r_regionkey AS value, true AS prefix FROM region UNION ALL SELECT 'n/' || n_name, n_regionkey, true FROM nation")
def file_append(spark, folder):
    """A second generation behind the first, whose bytes stay as they are."""
    path = os.path.join(folder_of(spark), "a.zt")
    with container.Writer(path, canonical=False) as w:
        for r in tables.read(spark, folder, "region").collect():
            w.add("r/" + r["r_name"], [], "i32", struct.pack("<i", r["r_regionkey"]))
    old = open(path, "rb").read()
    with container.Writer(path, canonical=False, append=True) as w:
        for r in tables.read(spark, folder, "nation").collect():
            w.add("n/" + r["n_name"], [], "i32", struct.pack("<i", r["n_regionkey"]))
    same = open(path, "rb").read(len(old)) == old
    return _numbers(spark, path, "<i4").select("name", F.col("value").cast("int").alias("value"), F.lit(same).alias("prefix"))


@query("SELECT 's/' || s_name AS name, s_acctbal AS value, 'zt.zstd-seekable/1' AS encoding, 8::BIGINT AS decoded_length, 'Encoded' AS kind FROM supplier")
def file_encoded(spark, folder):
    """Encoded parts: decoded on reading, with their decoded length in the metadata."""
    src = tables.read(spark, folder, "supplier").select(F.concat(F.lit("s/"), "s_name").alias("name"), "s_acctbal")

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array([struct.pack("<d", x) for x in batch.column("s_acctbal").to_pylist()], pa.binary())], names=["name", "content"])

    rows = src.mapInArrow(packed, "name string, content binary")
    path = _write(rows.select("name", F.lit("f64").alias("dtype"), F.array(F.lit(1).cast("long")).alias("shape"), "content", F.lit("zt.zstd-seekable/1").alias("encoding")), os.path.join(folder_of(spark), "s.zt"))
    meta = spark.read.format("tensorfile").option("path", path).load().select("name", "encoding", "decoded_length", F.col("payload_kind").alias("kind"))
    return _numbers(spark, path, "<f8").join(meta, "name")


@query("""WITH d AS (SELECT 'doc/' || doc_id AS name, 'xxh' AS k, octet_length(encode(coalesce(text, ''))) AS n, 'sha256:' || sha256(coalesce(text, '')) AS dg FROM documents),
h AS (SELECT name, octet_length(encode(name)) AS m,
  printf('%02x', 96 + octet_length(encode(name))) || hex(encode(name)) || 'A3' || '65' || hex(encode('parts')) || 'A1' || '64' || hex(encode('data')) || 'A2'
  || '65' || hex(encode('dtype')) || '62' || hex(encode('u8')) || '66' || hex(encode('digest')) || '7847' || hex(encode(dg))
  || '65' || hex(encode('shape')) || '81' || CASE WHEN n < 24 THEN printf('%02x', n) WHEN n < 256 THEN '18' || printf('%02x', n) WHEN n < 65536 THEN '19' || printf('%04x', n) ELSE '1a' || printf('%08x', n) END
  || '66' || hex(encode('layout')) || '65' || hex(encode('dense')) AS x FROM d),
a AS (SELECT count(*) AS c, string_agg(x, '' ORDER BY m, name) AS x FROM h)
SELECT 'sha256:' || sha256(unhex('826C' || hex(encode('zt.content/1')) || CASE WHEN c < 24 THEN printf('%02x', 160 + c) WHEN c < 256 THEN 'B8' || printf('%02x', c) WHEN c < 65536 THEN 'B9' || printf('%04x', c) ELSE 'BA' || printf('%08x', c) END || x)) AS digest FROM a""")
def model_digest(spark, folder):
    """The identity of a model of all documents, over the encoded objects in the format's own order."""
    src = identity.with_digests(tables.document_blobs(spark, folder))
    objects = src.select("name", F.array("length").alias("shape"), F.lit("dense").alias("layout"), F.lit(None).cast("string").alias("attributes"))
    return identity.model_digest(objects, src.select("name", "part", "dtype", F.lit(None).cast("string").alias("logical"), "digest"))


@query("SELECT true AS same, (SELECT count(*) FROM region) AS objects")
def file_model_digest(spark, folder):
    """A file's identity by its reader, by the operator, and of the same tensors in shards at another alignment: all one."""
    home = folder_of(spark)
    rows = sorted(tables.read(spark, folder, "region").collect(), key=lambda r: r["r_name"].encode())
    with container.Writer(os.path.join(home, "a.zt")) as w:
        for r in rows:
            w.object(r["r_name"], [1], "dense", {"data": container.part("i32", struct.pack("<i", r["r_regionkey"]))}, {"key": r["r_regionkey"]})
    one = TensorSet.read(spark, [os.path.join(home, "a.zt")])
    one.write(os.path.join(home, "b.zt"), align=4096)
    found = {container.open_file(os.path.join(home, "a.zt")).content_digest(), one.digest(), TensorSet.read(spark, [os.path.join(home, "b.zt")]).digest()}
    return spark.createDataFrame([(len(found) == 1 and None not in found, len(rows))], "same boolean, objects long")


@query("""WITH d AS (SELECT 'doc/' || doc_id AS name, doc_id FROM documents)
SELECT name, CASE WHEN doc_id % 13 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'content' END AS change FROM d WHERE doc_id % 13 = 0 OR doc_id % 11 = 0 OR doc_id % 7 = 0""")
def file_diff(spark, folder):
    """Two files of documents, compared by digests alone."""
    home, src = folder_of(spark), tables.document_blobs(spark, folder)
    every = lambda n: F.col("doc_id") % n == 0
    hashed = src.withColumn("content", F.sha2("content", 256).cast("binary")).select("doc_id", "name", "dtype", F.array(F.lit(64).cast("long")).alias("shape"), "content")
    changed = hashed.withColumn("content", F.when(every(7), F.reverse(F.col("content").cast("string")).cast("binary")).otherwise(F.col("content")))
    sets = [TensorSet.read(spark, [_write(rows.drop("doc_id"), os.path.join(home, f"{k}.zt"))]) for k, rows in (("a", hashed.where(~every(13))), ("b", changed.where(every(13) | ~every(11))))]
    sides = [s.parts.select("name", "part", "digest").join(s.objects.select("name", F.col("shape").cast("string").alias("shape"), "layout"), "name") for s in sets]
    return catalog.diff(*sides).select("name", "change")


@query("""SELECT * FROM (VALUES ('a_header', 'Unsupported'), ('b_footer', 'FooterMagic'), ('c_version', 'Version'), ('d_hash', 'ManifestHash'), ('e_bounds', 'ManifestBounds'), ('f_short', 'FileTooSmall'), ('g_good', 'ok')) AS t(file, status)""")
def file_rejections(spark, folder):
    """Files that break a rule are told by it, the others are read; one without any format's signature is unsupported."""
    home = folder_of(spark)
    good = os.path.join(home, "g_good.zt")
    with container.Writer(good) as w:
        w.add("x", [1], "u8", b"x")
    raw = open(good, "rb").read()
    n = len(raw)
    at, size, check, version, spare, magic = struct.unpack("<QQQII8s", raw[-40:])
    foot = lambda **new: raw[:-40] + struct.pack("<QQQII8s", *({"at": at, "size": size, "check": check, "version": version, "spare": spare, "magic": magic} | new).values())
    bad = {"a_header": raw[:1] + b"X" + raw[2:], "b_footer": foot(magic=b"X" * 8), "c_version": foot(version=9), "d_hash": foot(check=check ^ 1), "e_bounds": foot(at=n * 4096), "f_short": raw[:20]}
    for name, data in bad.items():
        open(os.path.join(home, name + ".zt"), "wb").write(data)
    datasource.register(spark)
    got = spark.read.format("tensorfile").option("path", home).option("mode", "permissive").load()
    return got.select(F.regexp_extract("path", r"([^/]+)\.zt$", 1).alias("file"), "status")


@query("""WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 53 = 0 THEN 'doc/' || doc_id || '/e' || chr(769) ELSE 'doc/' || doc_id END AS name FROM documents),
s AS (SELECT source, 65536 + 65536 * count(*) AS e FROM documents GROUP BY source)
SELECT source AS store, name, 4 AS rule, 'encoding or digest' AS detail FROM d WHERE doc_id % 41 = 0 OR doc_id % 43 = 0
UNION ALL SELECT source, name, 6, 'a shard table' FROM d WHERE doc_id % 47 = 0
UNION ALL SELECT source, name, 5, 'name' FROM d WHERE doc_id % 53 = 0
UNION ALL SELECT source, NULL, 1, 'manifest or footer' FROM s WHERE ascii(right(source, 1)) % 2 = 0""")
def canonical_rules(spark, folder):
    """Rules on digests, names, shards and the tail of each file, over placed parts of a page each. Contents are all different, so
    each has a digest of its own, of either kind; two equal ones in a store would break rule 3."""
    every = lambda n: F.col("doc_id") % n == 0
    src = tables.read(spark, folder, "documents").select("doc_id", F.col("source").alias("store_id"), F.lit("data").alias("part"), F.lit(4096).cast("long").alias("length"))
    name = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.when(every(53), "/é").otherwise(""))
    digest = F.when(every(43), F.concat(F.lit("sha256:"), F.lpad(F.hex("doc_id"), 64, "0"))).otherwise(F.concat(F.lit("xxh3:"), F.lpad(F.hex("doc_id"), 16, "0")))
    src = src.withColumn("name", name).withColumn("digest", digest).withColumn("encoding", F.when(every(41), "z")).withColumn("shard", F.when(every(47), "s"))
    placed = layout.with_normal_form(layout.canonical_placement(src, by=["store_id"]))
    ends = src.groupBy("store_id").agg(F.count(F.lit(1)).alias("n"))
    even = F.ascii(F.substring("store_id", -1, 1)) % 2 == 0
    stores = ends.select("store_id", (F.col("n") * CANONICAL + CANONICAL + F.when(even, 4096).otherwise(0)).alias("manifest_at"), F.lit(100).alias("manifest_length"))
    stores = stores.withColumn("size", F.col("manifest_at") + 140)
    return layout.canonical_violations(placed, stores=stores).select(F.col("store_id").alias("store"), "name", "rule", "detail")


# --- other formats ------------------------------------------------------------------------------------------------------------


def _numbers(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(name, value) of all tensors of one number type."""
    datasource.register(spark)

    def run(batches):
        for batch in batches:
            names, found, held = [], [], 0
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                x = np.frombuffer(raw, kind).astype(float)
                names.append(pa.array([name] * len(x), pa.string()))
                found.append(x)
                held += len(x)
                if held >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(names), pa.array(np.concatenate(found))], names=["name", "value"])
                    names, found, held = [], [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(names), pa.array(np.concatenate(found))], names=["name", "value"])

    got = spark.read.format("tensorfile").option("path", path).option("relation", "blobs").load()
    return got.select("name", "content").mapInArrow(run, "name string, value double")


def _columns(spark: SparkSession, folder: str) -> dict[str, np.ndarray]:
    """Two small columns of suppliers as arrays."""
    rows = tables.read(spark, folder, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_acctbal").collect()
    return {"key": np.array([r[0] for r in rows], "<f8"), "balance": np.array([r[1] for r in rows], "<f8")}


def _npz(spark: SparkSession, folder: str, path: str, save=np.savez) -> str:
    save(path, **_columns(spark, folder))
    return path


_SUPPLIERS = "SELECT 'key' AS name, s_suppkey::DOUBLE AS value FROM supplier UNION ALL SELECT 'balance', s_acctbal FROM supplier"


@query(_SUPPLIERS)
def import_npz(spark, folder):
    return _numbers(spark, _npz(spark, folder, os.path.join(folder_of(spark), "s.npz")), "<f8")


@query(_SUPPLIERS)
def import_npz_deflated(spark, folder):
    return _numbers(spark, _npz(spark, folder, os.path.join(folder_of(spark), "s.npz"), np.savez_compressed), "<f8")


@query(_SUPPLIERS)
def import_safetensors(spark, folder):
    path, at, head, data = os.path.join(folder_of(spark), "s.safetensors"), 0, {}, b""
    for name, x in _columns(spark, folder).items():
        head[name] = {"dtype": "F64", "shape": [len(x)], "data_offsets": [at, at + x.nbytes]}
        at, data = at + x.nbytes, data + x.tobytes()
    raw = json.dumps(head).encode()
    open(path, "wb").write(struct.pack("<Q", len(raw)) + raw + data)
    return _numbers(spark, path, "<f8")


@query(_SUPPLIERS)
def import_gguf(spark, folder):
    """A file of version 3 with type 28 (double) tensors at an alignment of 32."""
    path, arrays = os.path.join(folder_of(spark), "s.gguf"), _columns(spark, folder)
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    head, at, data = b"GGUF" + struct.pack("<IQQ", 3, len(arrays), 0), 0, b""
    for name, x in arrays.items():
        head += text(name) + struct.pack("<IQIQ", 1, len(x), 28, at)
        data += x.tobytes() + bytes(-x.nbytes % 32)
        at = len(data)
    open(path, "wb").write(head + bytes(-len(head) % 32) + data)
    return _numbers(spark, path, "<f8")


@query(_SUPPLIERS)
def import_onnx(spark, folder):
    """A model whose graph has two raw initializers of type 11 (double)."""

    def varint(n: int) -> bytes:
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    field = lambda k, raw: varint(k << 3 | 2) + varint(len(raw)) + raw
    path = os.path.join(folder_of(spark), "s.onnx")
    graph = b"".join(field(5, varint(1 << 3) + varint(len(x)) + varint(2 << 3) + varint(11) + field(8, n.encode()) + field(9, x.tobytes())) for n, x in _columns(spark, folder).items())
    open(path, "wb").write(field(7, graph))
    return _numbers(spark, path, "<f8")


@query("""WITH c AS (SELECT count(*) * 8 AS n FROM supplier), p AS (SELECT 'balance' AS name, 65536::BIGINT AS "offset" UNION ALL SELECT 'key', 65536 + (SELECT (n + 65535) // 65536 * 65536 FROM c))
SELECT name, 'f64' AS dtype, n::BIGINT AS length, "offset", true AS canonical, 'ok' AS status FROM p, c""")
def convert_to_native(spark, folder):
    """A foreign file as a canonical native one, checked as such and verified."""
    home = folder_of(spark)
    container.convert(foreign.open_any(_npz(spark, folder, os.path.join(home, "s.npz"))), os.path.join(home, "s.zt"))
    clean = not container.canonical_violations(*container.file_reader(os.path.join(home, "s.zt")))
    got = TensorSet.read(spark, [os.path.join(home, "s.zt")])
    return got.parts.join(got.verify(), ["name", "part"]).select("name", "dtype", "length", "offset", F.lit(clean).alias("canonical"), "status")


@query("""SELECT name, format, n::BIGINT AS nbytes FROM (SELECT 'doc/' || doc_id AS name, 'zt' AS format, octet_length(encode(coalesce(text, ''))) AS n FROM documents
UNION ALL SELECT x.name, 'npz', count(*) * 8 FROM supplier, (VALUES ('key'), ('balance')) AS x(name) GROUP BY x.name)""")
def files_as_one(spark, folder):
    """A native file and a foreign one as one namespace, with where each object came from."""
    home = folder_of(spark)
    s = TensorSet.read(spark, [_documents(spark, folder, os.path.join(home, "d.zt")), _npz(spark, folder, os.path.join(home, "s.npz"))])
    return s.provenance().join(s.describe().select("name", "nbytes"), "name").select("name", "format", "nbytes")
