import math
import struct
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.model import InvalidInput, NotFound, Rejected, Unsupported
from tessera.operators import catalog, identity, layout, profiles


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text("ab/é", min_size=1, max_size=9), st.integers(0, 300_000)), min_size=1, max_size=30, unique_by=lambda x: x[0]))
def test_placement_is_the_loop(spark, parts):
    df = spark.createDataFrame([(n, "data", x) for n, x in parts], "name string, part string, length long")
    got = {r["name"]: r["offset"] for r in layout.canonical_placement(df).collect()}
    at = 65536
    for name, n in sorted(parts, key=lambda p: p[0].encode()):
        assert got[name] == at
        at += -(-n // 65536) * 65536


@pytest.mark.parametrize("shape,want", [([], 1), ([2**63, 4, 0], None), ([0, 2**63, 4], 0), ([2**64 - 1, 2**64 - 1], None), ([2**32, 2**31], 2**63), ([3, 4], 12)])
def test_shape_product(spark, shape, want):
    df = spark.createDataFrame([([Decimal(x) for x in shape],)], "s array<decimal(20,0)>")
    got = df.select(X.num_elements(F.col("s")).alias("n")).first()["n"]
    assert (None if got is None else int(got)) == want


def test_small_floats(spark):
    codes = spark.range(256).select(F.col("id").cast("int").alias("c"))
    got = codes.select("c", *(f(F.col("c")).alias(k) for k, f in X.F8.items()), X.f4_value(F.col("c").bitwiseAND(15)).alias("f4")).collect()
    at = {r["c"]: r for r in got}
    assert at[0x7E]["f8_e4m3fn"] == 448 and math.isnan(at[0x7F]["f8_e4m3fn"]) and at[1]["f8_e4m3fn"] == 2.0**-9
    assert at[0x7B]["f8_e5m2"] == 57344 and at[0xFC]["f8_e5m2"] == -math.inf and math.isnan(at[0x7D]["f8_e5m2"])
    assert at[0x7F]["f8_e4m3fnuz"] == 240 and math.isnan(at[0x80]["f8_e4m3fnuz"]) and at[0x7F]["f8_e5m2fnuz"] == 57344
    assert at[127]["f8_e8m0"] == 1 and math.isnan(at[255]["f8_e8m0"])
    assert [at[k]["f4"] for k in range(8)] == [0, 0.5, 1, 1.5, 2, 3, 4, 6] and at[15]["f4"] == -6
    for c in range(256):  # e5m2 is the upper half of a half-precision number
        half = struct.unpack("<e", bytes([0, c]))[0]
        assert at[c]["f8_e5m2"] == half or math.isnan(half) and math.isnan(at[c]["f8_e5m2"])


def test_alignment(spark):
    got = [one(spark, X.alignment_of(F.lit(x).cast("long"))) for x in (0, 4096, 12288, 65536 * 3)]
    assert got == [4096, 4096, 4096, 65536]
    assert one(spark, X.align_up(F.lit(65537).cast("long"), 65536)) == 131072


def test_names_and_sizes(spark):
    ok = [one(spark, X.name_ok(F.lit(n))) for n in ("a", "", "a\0", "é" * 512, "é" * 513)]
    assert ok == [True, False, False, True, False]
    assert [one(spark, X.shard_name_ok(F.lit(n))) for n in ("a-1", ".a", "a/b", "a\n", "x" * 65)] == [True, False, False, False, False]
    assert one(spark, X.human_size(F.lit(1536))) == "1.5 KiB" and one(spark, X.human_size(F.lit(10))) == "10 B"
    assert int(one(spark, X.size_of(F.lit("f4_e2m1"), F.lit("u8"), F.lit(5).cast("decimal(38,0)")))) == 3
    assert one(spark, X.size_of(F.lit("x.new/1"), F.lit("u8"), F.lit(5).cast("decimal(38,0)"))) is None


def test_overlap_with_a_long_blob_before(spark):
    df = spark.createDataFrame([(0, 0, 100), (0, 10, 5), (0, 50, 5), (0, 200, 1), (0, 200, 1), (0, 10, 0)], "store_id int, offset long, length long")
    assert rows(layout.overlaps(df), "offset") == [(10,), (50,)]


def test_canonical_violations(spark):
    df = spark.createDataFrame([(0, "a", "data", 65536, 10, "x", True), (0, "b", "data", 131072, 10, "x", True), (0, "c", "data", 131072, 11, "z", False)], "store_id int, name string, part string, offset long, length long, digest string, nfc boolean")
    assert rows(layout.canonical_violations(df), "name", "rule") == [("b", 3), ("c", 3), ("c", 5)]


def test_lookup_and_merge(spark):
    a = spark.createDataFrame([("x", 0)], "name string, store_id int")
    b = spark.createDataFrame([("y", 0)], "name string, store_id int")
    assert catalog.lookup(a, "x").count() == 1
    with pytest.raises(NotFound):
        catalog.lookup(a, "y")
    assert rows(catalog.merge([(a, 1), (b, 1)]), "name", "store_id") == [("x", 0), ("y", 1)]
    with pytest.raises(Rejected, match="NameCollision"):
        catalog.merge([(a, 1), (a, 1)])
    with pytest.raises(InvalidInput):
        catalog.merge([])


def test_verify_objects(spark):
    parts = spark.createDataFrame([("a", "p", b"1", None), ("b", "p", b"1", "sha256:0"), ("c", "p", b"1", "sha256:6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b")], "name string, part string, content binary, digest string")
    objects = spark.createDataFrame([("a",), ("b",), ("c",), ("empty",)], "name string")
    assert rows(identity.verify_objects(objects, identity.verify(parts)), "name", "status") == [("a", "no_digest"), ("b", "mismatch"), ("c", "ok"), ("empty", "no_digest")]


def test_content_digest_is_independent_of_order(spark):
    data = [("s", f"n{i:03}", "data", "u8", "[1]", f"d{i}") for i in range(50)]
    schema = "set string, name string, part string, dtype string, shape string, digest string"
    a = identity.content_digest(spark.createDataFrame(data, schema).repartition(7), ["set"]).first()
    b = identity.content_digest(spark.createDataFrame(data[::-1], schema), ["set"]).first()
    assert a == b and a["content_digest"].startswith("sha256:")
    lost = [data[0][:5] + (None,), *data[1:]]
    assert identity.content_digest(spark.createDataFrame(lost, schema), ["set"]).first()["content_digest"] is None


def test_decode_elements(spark):
    parts = [("a", "data", "f16", np.array([1.5, -2], "<f2").tobytes()), ("b", "data", "bf16", b"\0\x3f\0\xc0"), ("c", "data", "u64", struct.pack("<Q", 7)), ("d", "data", "f32", None)]
    got = profiles.decode_elements(spark.createDataFrame(parts, "name string, part string, dtype string, content binary"), chunk=1)
    assert rows(got, "name", "idx", "value") == [("a", 0, 1.5), ("a", 1, -2.0), ("b", 0, 0.5), ("b", 1, -2.0), ("c", 0, 7.0)]
    with pytest.raises(Unsupported):
        profiles.decode_elements(spark.createDataFrame([("a", "p", "f4", b"")], "name string, part string, dtype string, content binary"))


def test_coo_coordinates_and_csr(spark):
    flat = spark.createDataFrame([(i, v) for i, v in enumerate([0, 1, 1, 2, 0, 2])], "pos long, value long")
    assert rows(profiles.coo_coordinates(flat, 3, 2), "idx", "d0", "d1") == [(0, 0, 2), (1, 1, 0), (2, 1, 2)]
    cells = spark.createDataFrame([(1, 2, 5), (0, 0, 1), (1, 0, 2), (1, 2, 1)], "row long, col long, value long")
    assert rows(profiles.coo_to_csr(cells), "row", "pos", "col", "value") == [(0, 0, 0, 1), (1, 1, 0, 2), (1, 2, 2, 6)]
    assert rows(profiles.coo_faults(cells, 2, 2), "row", "col", "rule") == [(1, 2, "duplicate"), (1, 2, "range"), (1, 2, "range")]


def test_quantise_and_words(spark):
    values = spark.createDataFrame([("a", i, i // 4, float(v)) for i, v in enumerate([-1, 0, 1, 2, 5, 5, 5, 5])], "name string, idx long, g long, value double")
    codes = profiles.quantize_groups(values, ["name"], 8)
    back = profiles.dequantize_groups(codes.select("name", "idx", "g", "q"), codes.select("name", "g", "scale", "zero").distinct(), ["name"])
    assert all(abs(v - w) < 0.02 for (_, v), (_, w) in zip(rows(back, "idx", "value"), rows(values, "idx", "value"), strict=True))
    words = spark.createDataFrame([(0, 0x87654321)], "pos long, word long")
    assert [q for _, q in rows(profiles.unpack_words(words, 4), "idx", "q")] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert [q for _, q in rows(profiles.unpack_words(words, 4, msb_first=True), "idx", "q")] == [8, 7, 6, 5, 4, 3, 2, 1]
    with pytest.raises(Unsupported):
        profiles.unpack_words(words, 7)


def test_scale_blocks(spark):
    e = spark.createDataFrame([("a", 0, 1.5), ("a", 32, 2.0)], "name string, idx long, value double")
    s = spark.createDataFrame([("a", 0, 128), ("a", 1, 255)], "name string, block long, code int")
    (_, x), (_, y) = rows(profiles.scale_blocks(e, s), "idx", "value")
    assert x == 3.0 and math.isnan(y)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.integers(1, 9)), min_size=1, max_size=40, unique=True))
def test_two_levels_are_the_loop(spark, rows):
    """Sums and maxima before, and minima after, whatever buckets the order is cut into."""
    df = spark.createDataFrame([("abc"[s], o, n) for s, o, n in rows], "store string, offset long, length long")
    got = layout.prefix(df, {"total": ("sum", F.col("length")), "reach": ("max", F.col("offset") + F.col("length")), "next": ("min", F.col("offset"))}, ["offset", "length"], ["store"])
    found = {(r["store"], r["offset"], r["length"]): (r["total"], r["reach"], r["next"]) for r in got.collect()}
    for s in "abc":
        mine = sorted((o, n) for t, o, n in rows if "abc"[t] == s)
        for i, (o, n) in enumerate(mine):
            before, after = mine[:i], mine[i + 1 :]
            assert found[s, o, n] == (sum(x for _, x in before) if before else None, max((a + b for a, b in before), default=None), min((a for a, _ in after), default=None))


def test_boundaries_cut_evenly(spark):
    df = spark.range(50_000).select(F.concat(F.lit("doc/"), F.col("id").cast("string")).alias("name"))
    bounds = layout.boundaries(df, "name")
    sizes = [r["count"] for r in df.groupBy(layout.bucket_of(F.col("name"), bounds).alias("b")).count().collect()]
    assert len(sizes) > 200 and max(sizes) < 5 * 50_000 / len(sizes)
    assert layout.boundaries(df, "name") == bounds
