"""Digests, verification, sharing of equal content, and resolution of shards."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import cbor_order, sha256_digest


def with_digests(blobs: DataFrame) -> DataFrame:
    return blobs.withColumn("digest", sha256_digest(F.col("content")))


def verify(parts: DataFrame) -> DataFrame:
    """Adds status: ok, mismatch, or no_digest. parts has content and the claimed digest."""
    claimed = F.col("digest")
    status = F.when(claimed.isNull(), "no_digest").when(claimed == sha256_digest(F.col("content")), "ok").otherwise("mismatch")
    return parts.withColumn("status", status)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    import xxhash

    made = {"sha256": lambda raw: hashlib.sha256(raw).hexdigest(), "xxh3": lambda raw: xxhash.xxh3_64_hexdigest(raw)}
    for batch in batches:
        out = []
        for claimed, raw in zip(batch.column("digest").to_pylist(), batch.column("content").to_pylist(), strict=True):
            how, _, value = (claimed or "").partition(":")
            out.append("no_digest" if claimed is None else "other" if how not in made else "ok" if made[how](raw or b"") == value else "mismatch")
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("part"), pa.array(out, pa.string())], names=["name", "part", "status"])


def verify_any(parts: DataFrame) -> DataFrame:
    """(name, part, status) by the digest's own algorithm, sha256 or xxh3: ok, mismatch, no_digest; other for algorithms that
    aren't known. Spark has no XXH3, so contents go to Python in batches; each row is checked where it is."""
    return parts.select("name", "part", "digest", "content").mapInArrow(_checked, "name string, part string, status string")


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The encoded key and value of each object."""
    import json

    from ..sources import cbor
    from ..sources.container import attributes_from

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            parts = {p["part"]: {"dtype": p["dtype"], "digest": p["digest"]} | ({"type": p["logical"]} if p["logical"] is not None else {}) for p in r["parts"]}
            obj = {"shape": [int(x) for x in r["shape"]], "layout": r["layout"], "parts": parts}
            if r["attributes"] is not None:
                obj["attributes"] = attributes_from(json.loads(r["attributes"]))
            out.append(cbor.encode(r["name"]) + cbor.encode(obj))
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.binary())], names=["name", "raw"])


def model_digest(objects: DataFrame, parts: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """digest: of what a model holds, as `id` prints it, whatever its layout in files; null if a part has no digest.

    objects: name, shape, layout, attributes (JSON); parts: name, part, dtype, logical, digest. Objects are encoded in parallel;
    one digest runs over them in the order of encoded keys, as the format wants it, so the encoded objects (not the tensors;
    within the format's bound on a manifest) pass through one task as a stream."""
    from ..sources import cbor
    from ..sources.container import CONTENT_LABEL, hasher

    own = parts.groupBy("name").agg(F.collect_list(F.struct("part", "dtype", "logical", "digest")).alias("parts"), F.bool_and(F.col("digest").isNotNull()).alias("whole"))
    met = objects.select("name", "shape", "layout", "attributes").join(own, "name", "left")
    n, whole = met.agg(F.count(F.lit(1)), F.coalesce(F.bool_and(F.coalesce("whole", F.lit(False))), F.lit(True))).first()
    spark = objects.sparkSession
    if not whole:
        return spark.createDataFrame([(None,)], "digest string")
    head = cbor.encode([CONTENT_LABEL, {}])[:-1] + cbor.map_head(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hasher(algorithm)
        h.update(head)
        for batch in batches:
            for raw in batch.column("raw").to_pylist():
                h.update(raw)
        yield pa.RecordBatch.from_arrays([pa.array([f"{algorithm}:{h.hexdigest()}"])], names=["digest"])

    made = met.select("name", "shape", "layout", "attributes", "parts").mapInArrow(_fragments, "name string, raw binary")
    return made.withColumn("n", F.octet_length("name")).repartition(1).sortWithinPartitions("n", "name").select("raw").mapInArrow(run, "digest string")


def verify_objects(objects: DataFrame, verified: DataFrame) -> DataFrame:
    """(name, status) of whole objects: a mismatch if any part has one, ok if all are; no parts or a part without: no_digest."""
    got = verified.groupBy("name").agg(F.bool_or(F.col("status") == "mismatch").alias("_bad"), F.bool_and(F.col("status") == "ok").alias("_ok"))
    status = F.when(F.col("_bad"), "mismatch").when(F.col("_ok"), "ok").otherwise("no_digest")
    return objects.select("name").join(got, "name", "left").select("name", status.alias("status"))


def shared_blobs(blobs: DataFrame) -> DataFrame:
    """(name, part, holder): for each blob the first name, in blob order, that has the same content.

    Grouped by a 256-bit digest and length, without the content; unequal_shares compares the contents themselves."""
    keyed = blobs.select("name", "part", F.sha2("content", 256).alias("_d"), F.octet_length("content").alias("_n"))
    first = keyed.groupBy("_d", "_n").agg(F.min(F.struct("name", "part")).alias("holder"), F.count(F.lit(1)).alias("copies"))
    return keyed.join(first, ["_d", "_n"]).select("name", "part", F.col("holder.name").alias("holder"), "copies", F.col("_n").alias("length"))


def unequal_shares(blobs: DataFrame, shared: DataFrame) -> DataFrame:
    """Blobs whose content isn't byte for byte that of their holder: none, unless digests collide."""
    own = shared.where("name <> holder").join(blobs.select("name", "part", "content"), ["name", "part"])
    held = blobs.select(F.col("name").alias("holder"), F.col("content").alias("held"))
    return own.join(held, "holder").where("content <> held").select("name", "part", "holder")


def dedup_ratio(blobs: DataFrame) -> DataFrame:
    """Blobs and bytes, and how many are left when equal content is stored once."""
    by = blobs.groupBy(F.sha2("content", 256).alias("_d"), F.octet_length("content").cast("long").alias("_n")).agg(F.count(F.lit(1)).alias("_c"))
    return by.agg(F.sum("_c").alias("blobs"), F.count(F.lit(1)).alias("distinct_blobs"), F.sum(F.col("_c") * F.col("_n")).alias("bytes"), F.sum("_n").alias("distinct_bytes"))


def content_digest(parts: DataFrame, by: list[str]) -> DataFrame:
    """One digest for each set of parts, over lines `name|part|dtype|shape|digest` in the order of encoded keys; null if any
    part has no digest. It doesn't depend on offsets, alignment, shards, or the order of rows.

    The lines of an object are digested first, then the objects of a bucket of names, then the buckets, so no task holds more
    than one level's lines."""
    line = F.concat_ws("|", "name", "part", "dtype", "shape", "digest")
    sized, text = cbor_order(F.col("name"))
    got = parts.groupBy(*by, "name").agg(
        F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(F.octet_length("part").alias("n"), F.col("part").alias("p"), line.alias("l")))), lambda x: x["l"])), 256).alias("_h"),
        F.bool_and(F.col("digest").isNotNull()).alias("_all"),
    )
    got = got.withColumn("_size", sized).withColumn("_bucket", F.expr("substr(name, 1, greatest(length(name) - 2, 1))"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(text.alias("k"), F.col("_h").alias("h")))), lambda x: F.concat(x["k"], F.lit("="), x["h"]))
    got = got.groupBy(*by, "_size", "_bucket").agg(F.sha2(F.concat_ws("\n", ordered), 256).alias("_h"), F.bool_and("_all").alias("_all"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("_size", "_bucket", "_h"))), lambda x: x["_h"])
    out = got.groupBy(*by).agg(F.sha2(F.concat_ws("\n", whole), 256).alias("_h"), F.bool_and("_all").alias("_all"))
    return out.select(*by, F.when(F.col("_all"), F.concat(F.lit("sha256:"), F.col("_h"))).alias("content_digest"))


def resolve_shards(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(shard, path): files found by size and whole-file digest. Only files of a size that is asked for are hashed.

    wanted: shard, size, digest; files: path, size, content."""
    sizes = wanted.select("size").distinct()
    hashed = files.join(sizes, "size", "left_semi").select("path", "size", sha256_digest(F.col("content")).alias("digest"))
    found = hashed.groupBy("size", "digest").agg(F.min("path").alias("path"))
    return wanted.join(found, ["size", "digest"], "left").select("shard", "path")


def shard_conflicts(registered: DataFrame) -> DataFrame:
    """Shard names registered with more than one identity; repeating the same one is no conflict."""
    got = registered.groupBy("shard").agg(F.countDistinct("size", "digest").alias("identities"))
    return got.where("identities > 1")


def missing_shards(parts: DataFrame, shards: DataFrame) -> DataFrame:
    """Parts that refer to a shard which the table doesn't have."""
    return parts.where("shard IS NOT NULL").join(shards, "shard", "left_anti").select("name", "part", "shard")


def out_of_bounds(parts: DataFrame, files: DataFrame) -> DataFrame:
    """Parts whose range ends beyond the file that they refer to. files: shard and size."""
    met = parts.join(files, "shard")
    return met.where(F.col("offset") + F.col("length") > F.col("size")).select("name", "part", "shard")


def duplicate_references(parts: DataFrame) -> DataFrame:
    """Distinct references with how often each is used."""
    return parts.groupBy("shard", "offset", "length").agg(F.count(F.lit(1)).alias("uses"))


def first_of_each(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
