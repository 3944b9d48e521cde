"""Placement of blobs in files, and the checks on it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import align_up, alignment_of
from ..model import CANONICAL, FLOOR

# Fixed value: bytes of a footer.
FOOTER = 40


#: Buckets that an order is cut into, and rows of the sample that their boundaries come from, about.
BUCKETS = 256
BOUNDARY_SAMPLE = 8192


def boundaries(df: DataFrame, key: str, buckets: int = BUCKETS) -> list:
    """Values of a column that cut its rows into about equal buckets, from a sample of bounded size that is chosen by hash, so
    that it is the same whenever it is drawn. Rows of equal value lie in one bucket."""
    n = df.count()
    share = min(1.0, BOUNDARY_SAMPLE / max(n, 1))
    some = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share * (1 << 20)).select(key).where(F.col(key).isNotNull())
    values = sorted({r[0] for r in some.collect()}, key=lambda v: v.encode() if isinstance(v, str) else v)
    step = max(1, len(values) // buckets)
    return values[step::step]


def bucket_of(key: Column, bounds: list) -> Column:
    """How many of the sorted boundaries aren't above the key: a tree of comparisons, as deep as the logarithm of their number."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < F.lit(bounds[mid]), among(low, mid)).otherwise(among(mid + 1, high))

    return among(0, len(bounds))


def prefix(df: DataFrame, values: dict[str, tuple[str, Column]], order: list[str], by: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """Adds, for each output name, an aggregate over all rows before (sum, max) or after (min), in order, in each group of `by`;
    null where there is none. values: output -> (aggregate, column). Nulls of the first column of order come first.

    It is made at two levels: totals by bucket, aggregated before the shuffle; running totals over the few buckets; and one
    within each bucket. So no task sorts more than a bucket, and one whole set needn't fit one task. Buckets come from a
    sample of the first column of order, or from a column that doesn't decrease along the order."""
    by = by or []
    df = df.withColumn("_b", bucket_of(F.col(order[0]), boundaries(df, order[0])) if bucket is None else bucket)
    made = {"sum": F.sum, "max": F.max, "min": F.min}
    wide = Window.partitionBy(*by).orderBy("_b")
    near = Window.partitionBy(*by, "_b").orderBy(*order)
    rows = {"sum": (Window.unboundedPreceding, -1), "max": (Window.unboundedPreceding, -1), "min": (1, Window.unboundedFollowing)}
    src = df
    for k, (_, column) in enumerate(values.values()):
        src = src.withColumn(f"_v{k}", column)
    totals = src.groupBy(*by, "_b").agg(*(made[how](f"_v{k}").alias(f"_t{k}") for k, (how, _) in enumerate(values.values())))
    totals = totals.select(*by, "_b", *(made[how](f"_t{k}").over(wide.rowsBetween(*rows[how])).alias(f"_w{k}") for k, (how, _) in enumerate(values.values())))
    got = src.join(totals, [*by, "_b"])
    for k, (out, (how, _)) in enumerate(values.items()):
        own, far = made[how](f"_v{k}").over(near.rowsBetween(*rows[how])), F.col(f"_w{k}")
        both = F.coalesce(own + far, own, far) if how == "sum" else F.greatest(own, far) if how == "max" else F.least(own, far)
        got = got.withColumn(out, both)
    return got.drop("_b", *(f"_{x}{k}" for k in range(len(values)) for x in "vw"))


def prefix_sum(df: DataFrame, value: Column, order: list[str], out: str, bucket: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds the sum of value over all rows before, in order, within each group of `by`."""
    return prefix(df, {out: ("sum", value)}, order, by, bucket).withColumn(out, F.coalesce(out, F.lit(0)))


def canonical_placement(parts: DataFrame, alignment: int = CANONICAL, by: list[str] | None = None) -> DataFrame:
    """Adds the offset of each part's blob: aligned, in bytewise order of (name, part), after one alignment of header."""
    placed = prefix_sum(parts, align_up(F.col("length"), alignment), ["name", "part"], "_o", by=by)
    return placed.withColumn("offset", (F.col("_o") + alignment).cast("long")).drop("_o")


def padding_overhead(parts: DataFrame, alignment: int) -> DataFrame:
    """Payload and file bytes of all parts under an alignment."""
    size = align_up(F.col("length"), alignment)
    return parts.agg(F.sum("length").alias("payload"), F.sum(size).cast("long").alias("stored"))


def overlaps(blobs: DataFrame, by: str = "store_id") -> DataFrame:
    """Pairs of neighbouring references in a file that partly overlap: equal references and empty ones are no conflict.

    After the exact copies are gone, any overlap shows between a blob and the furthest end before it, so one sorted pass does."""
    refs = blobs.where("length > 0").select(by, "offset", "length").distinct()
    return prefix(refs, {"reach": ("max", F.col("offset") + F.col("length"))}, ["offset", "length"], [by]).where("reach > offset")


def tiling_faults(blobs: DataFrame, by: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Blobs that don't begin where the one before ends (the first: at zero). Of blobs with the same range all but the first are
    faults; which one is first, the columns `ties` say."""
    last = F.struct("offset", "length")  # the greatest of those before is the one before
    got = prefix(blobs, {"_p": ("max", last)}, ["offset", "length", *ties], [by])
    got = got.withColumn("expected", F.coalesce(F.col("_p.offset") + F.col("_p.length"), F.lit(0).cast("long"))).drop("_p")
    return got.where("offset <> expected")


def page_exclusive(blobs: DataFrame, by: str = "store_id", page: int = FLOOR) -> DataFrame:
    """Adds exclusive: no other occupied range touches the pages that a blob lies on."""
    first = F.floor(F.col("offset") / page) * page
    last = align_up(F.col("offset") + F.col("length"), page)
    got = prefix(blobs, {"_before": ("max", F.col("offset") + F.col("length")), "_after": ("min", F.col("offset"))}, ["offset", "length"], [by])
    free = (F.col("_before").isNull() | (F.col("_before") <= first)) & (F.col("_after").isNull() | (F.col("_after") >= last))
    return got.withColumn("exclusive", free).drop("_before", "_after")


def inherited_alignment(blobs: DataFrame, by: str) -> DataFrame:
    """The alignment that all local offsets of a file share, between the floor and the canonical one."""
    got = blobs.groupBy(by).agg(F.bit_or("offset").alias("_o"))
    return got.select(by, F.least(F.greatest(alignment_of(F.col("_o")), F.lit(FLOOR)), F.lit(CANONICAL)).cast("long").alias("alignment"))


def with_normal_form(parts: DataFrame) -> DataFrame:
    """Adds nfc: whether name and part are in normal form C. Only names beyond ASCII go to Python."""

    def run(batches):
        import unicodedata

        for batch in batches:
            ok = [all(unicodedata.is_normalized("NFC", x) for x in r) for r in zip(batch.column("name").to_pylist(), batch.column("part").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_())], names=["name", "part", "nfc"])

    plain = F.concat("name", "part").rlike(r"^[\x00-\x7F]*$")
    odd = parts.where(~plain).select("name", "part").distinct().mapInArrow(run, "name string, part string, nfc boolean")
    return parts.join(odd, ["name", "part"], "left").withColumn("nfc", F.coalesce("nfc", F.lit(True)))


def canonical_violations(parts: DataFrame, by: str = "store_id", alignment: int = CANONICAL, digest: str = "digest", stores: DataFrame | None = None) -> DataFrame:
    """(store, name, part, rule, detail) for each breach of canonical form by the placed parts of a file.

    1: a blob isn't at the aligned end of the blobs before it, or, with stores (by, manifest_at, manifest_length, size), the
    manifest isn't at their end or the file doesn't end with it and a footer. 2: an offset isn't aligned. 3: equal content
    isn't shared, or a reference repeats an offset with another length. 4: a part is encoded or has no xxh3 digest (where there
    is a column encoding). 5: a name isn't in normal form (by the flag column nfc, where there is one). 6: a part lies in a
    shard (where there is a column shard). References of no length place nothing."""
    local = parts.where("length > 0")
    key = [by, "offset"]
    first = Window.partitionBy(*key).orderBy("name", "part")
    local = local.withColumn("_first", F.row_number().over(first) == 1).withColumn("_len", F.first("length").over(first))
    heads = local.where("_first")
    walk = prefix(heads, {"_p": ("max", align_up(F.col("offset") + F.col("length"), alignment))}, ["name", "part"], [by])
    walk = walk.withColumn("_e", F.coalesce("_p", F.lit(alignment).cast("long")))
    one = walk.where("offset <> _e").select(by, "name", "part", F.lit(1).alias("rule"), F.concat(F.lit("expected "), F.col("_e").cast("string")).alias("detail"))
    two = parts.where(F.col("offset") % alignment != 0).select(by, "name", "part", F.lit(2).alias("rule"), F.col("offset").cast("string").alias("detail"))
    three = local.where("length <> _len").select(by, "name", "part", F.lit(3).alias("rule"), F.lit("different length").alias("detail"))
    same = Window.partitionBy(by, digest, "length").orderBy("name", "part")
    shared = local.where(F.col(digest).isNotNull()).withColumn("_at", F.first("offset").over(same))
    three = three.union(shared.where("offset <> _at").select(by, "name", "part", F.lit(3).alias("rule"), F.concat(F.lit("content at "), F.col("_at").cast("string")).alias("detail")))
    out = one.union(two).union(three)
    breach = lambda rows, rule, detail: rows.select(by, "name", "part", F.lit(rule).alias("rule"), F.lit(detail).alias("detail"))
    if "encoding" in parts.columns:
        xxh3 = F.coalesce(F.col(digest).startswith("xxh3:"), F.lit(False))
        out = out.union(breach(parts.where(F.col("encoding").isNotNull() | ~xxh3), 4, "encoding or digest"))
    if "shard" in parts.columns:
        out = out.union(breach(parts.where("shard IS NOT NULL"), 6, "a shard table"))
    if stores is not None:
        ends = local.groupBy(by).agg(F.max(align_up(F.col("offset") + F.col("length"), alignment)).alias("_end"))
        tail = stores.join(ends, by, "left").withColumn("_end", F.coalesce("_end", F.lit(alignment).cast("long")))
        bad = (F.col("manifest_at") != F.col("_end")) | (F.col("manifest_at") + F.col("manifest_length") + FOOTER != F.col("size"))
        none = F.lit(None).cast("string")
        out = out.union(tail.where(bad).select(by, none.alias("name"), none.alias("part"), F.lit(1).alias("rule"), F.lit("manifest or footer").alias("detail")))
    if "nfc" in parts.columns:
        out = out.union(parts.where("NOT nfc").select(by, "name", "part", F.lit(5).alias("rule"), F.lit("name").alias("detail")))
    return out


def unsorted_insertions(parts: DataFrame, sequence: str, by: str) -> DataFrame:
    """Rows that were added after a row whose name isn't smaller."""
    order = Window.partitionBy(by).orderBy(sequence)
    return parts.withColumn("previous", F.lag("name").over(order)).where("previous >= name")


def shard_plan(parts: DataFrame, limit: int, by: list[str] | None = None) -> DataFrame:
    """Adds the shard of each part: cut after every `limit` bytes in order of name and part."""
    got = prefix_sum(parts, F.col("length"), ["name", "part"], "_o", by=by)
    return got.withColumn("shard", F.floor(F.col("_o") / limit).cast("long")).drop("_o")


def chunk_coverage(chunks: DataFrame, shapes: DataFrame, by: str) -> DataFrame:
    """For each object, how many distinct chunks there are and how many its grid has."""
    got = chunks.groupBy(by).agg(F.countDistinct("chunk").alias("present"))
    need = F.ceil(F.col("extent") / F.col("chunk_extent")).cast("long")
    return shapes.join(got, by, "left").select(by, F.coalesce("present", F.lit(0)).cast("long").alias("present"), need.alias("needed"))
