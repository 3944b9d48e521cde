"""Layout and encoding semantics: dense, sparse, group-quantised, block-scaled and bit-packed elements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import e8m0_value, f4_value, nibbles
from ..model import Unsupported

# numpy's little-endian types of what Spark has no own binary decoding for; bf16 is widened by hand.
_NUMPY = {"f64": "<f8", "f32": "<f4", "f16": "<f2", "bf16": "<u2", "i64": "<i8", "i32": "<i4", "i16": "<i2", "i8": "i1", "u64": "<u8", "u32": "<u4", "u16": "<u2", "u8": "u1"}


def decode_elements(parts: DataFrame, chunk: int = 65536) -> DataFrame:
    """name, part, idx, value (double) of each element of (name, part, dtype, content). A part is decoded a chunk at a time."""
    bad = [r["dtype"] for r in parts.select("dtype").distinct().where(~F.col("dtype").isin(*_NUMPY)).limit(1).collect()]
    if bad:
        raise Unsupported(f"storage type {bad[0]}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part, dtype, raw in zip(*(batch.column(c).to_pylist() for c in ("name", "part", "dtype", "content")), strict=True):
                kind = np.dtype(_NUMPY[dtype])
                raw = raw or b""
                whole = np.frombuffer(raw[: len(raw) - len(raw) % kind.itemsize], kind)
                for s in range(0, len(whole), chunk):
                    x = whole[s : s + chunk]
                    if dtype == "bf16":
                        x = (x.astype(np.uint32) << 16).view(np.float32)
                    n = len(x)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([part] * n), pa.array(np.arange(s, s + n)), pa.array(x.astype(np.float64))], names=["name", "part", "idx", "value"])

    return parts.select("name", "part", "dtype", "content").mapInArrow(run, "name string, part string, idx long, value double")


# --- bytes ----------------------------------------------------------------------------------------------------------------


def unpack_f4(codes: DataFrame, by: list[str]) -> DataFrame:
    """by, idx, value of the 4-bit floats in rows of (by, pos, byte), low half first."""
    low, high = nibbles(F.col("byte"))
    halves = codes.select(*by, "pos", F.posexplode(F.array(low, high)).alias("half", "code"))
    return halves.select(*by, (F.col("pos") * 2 + F.col("half")).cast("long").alias("idx"), f4_value(F.col("code")).alias("value"))


def odd_tail_faults(codes: DataFrame, by: str) -> DataFrame:
    """Objects with an odd number n of 4-bit elements whose last high half isn't zero. codes: by, pos, byte, n."""
    last = codes.where("n % 2 = 1 AND pos = (n - 1) / 2")
    return last.where(F.shiftright("byte", 4).bitwiseAND(15) != 0).select(by, "pos", "byte")


def bool_faults(codes: DataFrame, by: str) -> DataFrame:
    """How many bytes of each object are neither 0 nor 1, where any are."""
    return codes.groupBy(by).agg(F.count_if(F.col("byte") > 1).alias("bad")).where("bad > 0")


# --- sparse ---------------------------------------------------------------------------------------------------------------


def coo_faults(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """(row, col, rule): cells outside the shape, and cells given more than once."""
    outside = cells.where(~F.col("row").between(0, rows - 1) | ~F.col("col").between(0, cols - 1)).select("row", "col", F.lit("range").alias("rule"))
    twice = cells.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row", "col", F.lit("duplicate").alias("rule"))
    return outside.union(twice)


def coo_coordinates(flat: DataFrame, nnz: int, rank: int) -> DataFrame:
    """idx and d0..: coordinates stored one dimension after another, as rows of (pos, value)."""
    at = flat.select((F.col("pos") % nnz).alias("idx"), F.floor(F.col("pos") / nnz).cast("int").alias("dim"), "value")
    return at.groupBy("idx").agg(*(F.max(F.when(F.col("dim") == d, F.col("value"))).alias(f"d{d}") for d in range(rank)))


def coo_to_csr(cells: DataFrame) -> DataFrame:
    """row, pos, col, value: summed cells in row and column order; pos is the place among all values.

    A row's first place is the running sum of the rows before, over one number for each row."""
    summed = cells.groupBy("row", "col").agg(F.sum("value").alias("value"))
    start = row_pointers(summed).select("row", "start")
    within = F.row_number().over(Window.partitionBy("row").orderBy("col")) - 1
    return summed.join(start, "row").select("row", (F.col("start") + within).alias("pos"), "col", "value")


def row_pointers(cells: DataFrame, span: int = 1024) -> DataFrame:
    """row, start, length of the rows that have cells, by a running sum at two levels: row blocks of a span, then rows."""
    sizes = cells.groupBy("row").agg(F.count(F.lit(1)).alias("length")).withColumn("_b", F.floor(F.col("row") / span))
    blocks = sizes.groupBy("_b").agg(F.sum("length").alias("_n"))
    blocks = blocks.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum("length").over(Window.partitionBy("_b").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.join(blocks, "_b").select("row", (F.col("_base") + own).cast("long").alias("start"), "length")


def csr_faults(cells: DataFrame, cols: int) -> DataFrame:
    """(row, pos, rule): columns outside the shape, and columns that don't increase within a row."""
    before = F.lag("col").over(Window.partitionBy("row").orderBy("pos"))
    got = cells.withColumn("_p", before)
    rule = F.when(~F.col("col").between(0, cols - 1), "range").when(F.col("_p") >= F.col("col"), "order")
    return got.select("row", "pos", rule.alias("rule")).where("rule IS NOT NULL")


def spmv(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """row and the product with a vector (col, x)."""
    return cells.join(vector, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("y"))


# --- group quantisation and block scales ------------------------------------------------------------------------------------


def quantize_groups(values: DataFrame, by: list[str], bits: int = 8) -> DataFrame:
    """by, idx, g, q, scale, zero: each group's range is mapped to the codes 0 to 2^bits - 1. values: by, idx, g, value."""
    top = (1 << bits) - 1
    ranges = values.groupBy(*by, "g").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    scale = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / top).otherwise(F.lit(1.0))
    ranges = ranges.select(*by, "g", scale.alias("scale"), F.floor(-F.col("_lo") / scale + 0.5).alias("zero"))
    got = values.join(ranges, [*by, "g"])
    q = F.least(F.greatest(F.floor(F.col("value") / F.col("scale") + 0.5) + F.col("zero"), F.lit(0)), F.lit(top))
    return got.select(*by, "idx", "g", q.cast("long").alias("q"), "scale", "zero")


def dequantize_groups(codes: DataFrame, scales: DataFrame, by: list[str]) -> DataFrame:
    """(q - zero) * scale of the code's group. scales: by, g, scale, zero."""
    return codes.join(scales, [*by, "g"]).select(*by, "idx", ((F.col("q") - F.col("zero")) * F.col("scale")).alias("value"))


def unpack_words(words: DataFrame, bits: int, word_bits: int = 32, msb_first: bool = False) -> DataFrame:
    """idx and q of the codes packed in unsigned words, from rows of (pos, word)."""
    if bits not in (2, 3, 4, 5, 6, 8) or word_bits % bits:
        raise Unsupported(f"{bits} bits in words of {word_bits}")
    per = word_bits // bits
    shifts = [(per - 1 - k if msb_first else k) * bits for k in range(per)]
    codes = F.array(*(F.shiftright("word", s).bitwiseAND((1 << bits) - 1) for s in shifts))
    out = words.select("pos", F.posexplode(codes).alias("_k", "q"))
    return out.select((F.col("pos") * per + F.col("_k")).cast("long").alias("idx"), F.col("q").cast("long").alias("q"))


def scale_blocks(elements: DataFrame, scales: DataFrame, block: int = 32) -> DataFrame:
    """Block-scaled elements: value times the power of two of its block's code; code 255 makes all of a block nan."""
    met = elements.withColumn("block", F.floor(F.col("idx") / block).cast("long")).join(scales, ["name", "block"])
    return met.select("name", "idx", (e8m0_value(F.col("code")) * F.col("value")).alias("value"))
