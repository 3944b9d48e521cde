"""A set of tensors as one handle over its catalog DataFrames. Bytes are a relation of their own and are joined last."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import alignment_of
from .model import FLOOR, InvalidInput, NotFound, Rejected
from .operators import catalog, identity, layout
from .sources import container, datasource, foreign


class TensorSet:
    """objects (name, shape, layout, attributes as JSON), parts (name, part, dtype, logical, store_id, offset, length, encoding,
    decoded_length, digest, payload_kind), stores (store_id, path, size, format, attributes), and if they are at hand blobs (name, part,
    content)."""

    def __init__(self, objects: DataFrame, parts: DataFrame, stores: DataFrame, blobs: DataFrame | None = None):
        self.objects, self.parts, self.stores, self.blobs = objects, parts, stores, blobs

    @classmethod
    def from_parts(cls, objects: DataFrame, parts: DataFrame, stores: DataFrame, blobs: DataFrame | None = None) -> TensorSet:
        """A catalog made elsewhere; every part must lie in a store that is given, and belong to an object."""
        if (stray := parts.join(stores, "store_id", "left_anti").first()) is not None:
            raise InvalidInput(f"{stray['name']} lies in store {stray['store_id']}, which isn't given")
        if (stray := parts.join(objects, "name", "left_anti").first()) is not None:
            raise InvalidInput(f"{stray['name']} has a part but no object")
        return cls(objects, parts, stores, blobs)

    @classmethod
    def read(cls, spark: SparkSession, paths: list[str]) -> TensorSet:
        """Files of any readable format as one namespace; only their headers are read here. Paths lie on shared storage."""
        datasource.register(spark)
        joined = ",".join(paths)
        load = lambda relation: spark.read.format("tensorfile").option("path", joined).option("relation", relation).load()
        meta = load("parts")
        order = spark.createDataFrame(list(enumerate(f for p in paths for f in datasource._files(p))), "store_id int, path string")
        stores = order.join(load("files").drop("status"), "path").select("store_id", "path", "size", "format", "attributes")
        parts = meta.join(order, "path").drop("path", "status", "format", "attributes")
        clash = meta.select("path", "name").distinct().groupBy("name").count().where("count > 1").first()
        if clash is not None:
            raise Rejected("NameCollision", clash["name"])
        objects = meta.groupBy("name").agg(F.first("shape").alias("shape"), F.first("layout").alias("layout"), F.first("attributes").alias("attributes"))
        return cls(objects, parts.drop("shape", "layout"), stores, load("blobs").select("name", "part", "content"))

    def attributes(self) -> str | None:
        """The attributes of the first file that has some, as JSON."""
        got = self.stores.where("attributes IS NOT NULL").orderBy("store_id").select("attributes").first()
        return got[0] if got else None

    def provenance(self) -> DataFrame:
        """(name, path, format): which file each object came from."""
        return self.parts.select("name", "store_id").distinct().join(self.stores, "store_id").select("name", "path", "format")

    def digest(self, algorithm: str = "sha256") -> str | None:
        """What the tensors hold, whatever files they lie in; None if a part has no digest."""
        return identity.model_digest(self.objects, self.parts, algorithm).first()["digest"]

    def names(self) -> DataFrame:
        return self.objects.select("name").orderBy("name")

    def __len__(self) -> int:
        return self.objects.count()

    def __contains__(self, name: str) -> bool:
        return not self.objects.where(F.col("name") == name).isEmpty()

    def tensor(self, name: str) -> DataFrame:
        return catalog.lookup(self.objects, name)

    def describe(self) -> DataFrame:
        return catalog.listing(self.objects, self.parts).orderBy("name")

    def capabilities(self) -> DataFrame:
        """What can be done with each part without decoding it: whether it has an address, can be evicted alone, carries a
        digest, and how its address is aligned."""
        at = F.col("payload_kind") == "At"
        exclusive = layout.page_exclusive(self.parts.where(at & F.col("length").isNotNull()).select("store_id", "offset", "length").where("length > 0").distinct())
        out = self.parts.join(exclusive, ["store_id", "offset", "length"], "left")
        return out.select(
            "name", "part", at.alias("locate"), F.coalesce(F.col("exclusive") & at, F.lit(False)).alias("evict"), F.col("digest").isNotNull().alias("verify"),
            F.when(at, alignment_of(F.col("offset"))).otherwise(F.lit(FLOOR).cast("long")).alias("alignment"),
        )

    def locate(self) -> DataFrame:
        return self.parts.where("payload_kind = 'At'").select("name", "part", "store_id", "offset", "length")

    def bytes(self, names: list[str] | None = None) -> DataFrame:
        """(name, part, content) of some or all objects; names are filtered before bytes are joined."""
        if self.blobs is None:
            raise NotFound("this set has no bytes")
        parts = self.parts if names is None else self.parts.where(F.col("name").isin(names))
        return parts.select("name", "part").join(self.blobs, ["name", "part"])

    def verify(self) -> DataFrame:
        """(name, part, status) by each digest's own algorithm; `other` where that isn't known."""
        if self.blobs is None:
            raise NotFound("this set has no bytes")
        return identity.verify_any(self.parts.select("name", "part", "digest").join(self.blobs, ["name", "part"]))

    def merge(self, *others: TensorSet) -> TensorSet:
        """One namespace; a name in two sets is a collision, and store ids of later sets move up."""
        sets = [self, *others]
        counts = [s.stores.count() for s in sets]
        parts = catalog.merge([(s.parts, n) for s, n in zip(sets, counts, strict=True)])
        objects, stores, blobs, base = self.objects, self.stores, self.blobs, counts[0]
        for s, n in zip(others, counts[1:], strict=True):
            objects = objects.unionByName(s.objects)
            stores = stores.unionByName(s.stores.withColumn("store_id", F.col("store_id") + F.lit(base)))
            blobs = blobs.unionByName(s.blobs) if blobs is not None and s.blobs is not None else None
            base += n
        return TensorSet(objects, parts, stores, blobs)

    def write(self, path: str, align: int = container.CANONICAL) -> None:
        """All objects, of any layout, with their parts, encodings and attributes, as a native root with a data shard for each
        task. Bytes are joined last; the parts of an object meet in one task."""
        own = self.objects.select("name", F.transform("shape", lambda x: x.cast("long")).alias("shape"), "layout", "attributes")
        rows = own.join(self.parts.select("name", "part", "dtype", "logical", "encoding"), "name").join(self.bytes(), ["name", "part"])
        out = rows.withColumn("content", F.coalesce("content", F.lit(b""))).repartition("name").sortWithinPartitions("name", "part")
        datasource.register(rows.sparkSession)
        to = out.write.format("tensorfile").option("path", path).option("align", str(align))
        if "attributes" in self.stores.columns and (file_attributes := self.attributes()):
            to = to.option("attributes", file_attributes)
        to.mode("append").save()


def index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, format, size, attributes, objects, shards, status) of files, without their tensors."""
    datasource.register(spark)
    return spark.read.format("tensorfile").option("path", ",".join(paths)).option("relation", "files").option("mode", "permissive").load()


def page_size() -> int:
    """What offsets are multiples of, and pages of a file are counted in."""
    return FLOOR


class Arrays(Mapping):
    """A file's tensors as numpy arrays, read one by one."""

    def __init__(self, path: str):
        self.source = foreign.open_any(path)

    def __getitem__(self, name: str) -> np.ndarray:
        return foreign.as_array(self.source, name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.source)

    def __len__(self) -> int:
        return len(self.source)


def load_file(path: str) -> dict[str, np.ndarray]:
    return dict(Arrays(path))


#: numpy's kinds and their storage types.
_KINDS = {np.dtype(k): v for k, v in {"<f8": "f64", "<f4": "f32", "<f2": "f16", "<i8": "i64", "<i4": "i32", "<i2": "i16", "i1": "i8", "<u8": "u64", "<u4": "u32", "<u2": "u16", "u1": "u8"}.items()}


def save_file(arrays: Mapping[str, np.ndarray], path: str, attributes: dict | None = None) -> None:
    """Arrays as a canonical native file."""
    with container.Writer(path) as w:
        if attributes is not None:
            w.set_attributes(attributes)
        for name in sorted(arrays, key=str.encode):
            x = np.ascontiguousarray(arrays[name]).reshape(np.shape(arrays[name]))
            if x.dtype == np.bool_:
                w.add(name, x.shape, "u8", x.tobytes(), type="bool")
            elif x.dtype.kind == "c":
                w.add(name, x.shape, "f32" if x.itemsize == 8 else "f64", x.tobytes(), type="complex64" if x.itemsize == 8 else "complex128")
            elif x.dtype.newbyteorder("<") in _KINDS:
                w.add(name, x.shape, _KINDS[x.dtype.newbyteorder("<")], x.astype(x.dtype.newbyteorder("<")).tobytes())
            else:
                raise InvalidInput(f"{name}: arrays of {x.dtype} can't be stored")
