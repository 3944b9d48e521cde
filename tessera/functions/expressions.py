"""Sizes, alignment, names, orders and element decoding as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import FLOOR, LOGICAL, MAX_NAME, U64_MAX, WIDTHS


def align_up(value: Column, alignment: int) -> Column:
    """The least multiple of alignment, a power of two, that is no less than value."""
    return (value + F.lit(alignment - 1)).bitwiseAND(F.lit(-alignment).cast("long"))


def alignment_of(offset: Column) -> Column:
    """The largest power of two that divides an offset; the page size for offset zero."""
    return F.when(offset == 0, F.lit(FLOOR).cast("long")).otherwise(offset.bitwiseAND(-offset))


def width_of(dtype: Column) -> Column:
    """Bytes of an element, null for an unknown storage type."""
    table = F.create_map(*(F.lit(x) for kv in WIDTHS.items() for x in kv))
    return F.try_element_at(table, dtype)


def pinned_dtype(logical: Column) -> Column:
    """The storage type that a logical type requires, null if it is not registered."""
    table = F.create_map(*(F.lit(x) for k, (d, _, _) in LOGICAL.items() for x in (k, d)))
    return F.try_element_at(table, logical)


def size_of(logical: Column, dtype: Column, n: Column) -> Column:
    """Bytes of n elements; null (undecodable) for an unregistered logical type."""
    out = F.when(logical.isNull(), F.try_multiply(n, width_of(dtype).cast("decimal(20,0)")).cast("decimal(38,0)"))
    for name, (_, a, b) in LOGICAL.items():
        scaled = F.try_multiply(n, F.lit(a).cast("decimal(20,0)")).cast("decimal(38,0)")
        out = out.when(logical == name, F.ceil(scaled / b).cast("decimal(38,0)") if b > 1 else scaled)
    return out


def num_elements(shape: Column) -> Column:
    """Left-to-right product of a shape in unsigned 64 bits; null as soon as a step overflows, 1 for a scalar."""
    one, most = F.lit(1).cast("decimal(38,0)"), F.lit(Decimal(U64_MAX)).cast("decimal(38,0)")

    def step(acc: Column, x: Column) -> Column:
        # at most 2^64 times 2^64 has 39 digits; where that doesn't fit, the product is null, which is the rejection
        out = F.try_multiply(acc, x.cast("decimal(38,0)")).cast("decimal(38,0)")
        return F.when(acc.isNotNull() & (out <= most), out)

    return F.aggregate(shape, one, step)


def name_ok(name: Column) -> Column:
    """1 to 1024 bytes without NUL."""
    return name.isNotNull() & F.octet_length(name).between(1, MAX_NAME) & ~F.contains(name, F.lit("\0"))


def shard_name_ok(name: Column) -> Column:
    return name.rlike("^[A-Za-z0-9_-][A-Za-z0-9._-]{0,63}$") & ~name.endswith("\n")


def digest_ok(digest: Column) -> Column:
    return digest.rlike("^[a-z0-9]+:[0-9a-f]+$") & ~digest.endswith("\n")


def sha256_digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def cbor_order(key: Column) -> tuple[Column, Column]:
    """Sort keys by which encoded text keys are ordered: shorter first, then bytewise."""
    return F.octet_length(key), key


def decoded_length(encoding: Column, decoded: Column, length: Column) -> Column:
    """The stored length, or for encoded parts the declared one."""
    return F.when(encoding.isNull(), length).otherwise(decoded)


def human_size(n: Column) -> Column:
    """Bytes with a binary unit and one decimal."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        out = out.when(n < 1024 ** (k + 1), F.concat(F.format_string("%.1f", n / float(1024**k)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", n / float(1024**4)), F.lit(" TiB")))


def shape_text(shape: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(shape.cast("array<string>"), ", "), F.lit("]"))


# --- decoding of small codes ------------------------------------------------------------------------------------------------


def nibbles(byte: Column) -> tuple[Column, Column]:
    """The low and the high half of an unsigned byte, the order in which they are stored."""
    return byte.bitwiseAND(15), F.shiftright(byte, 4).bitwiseAND(15)


def f4_value(code: Column) -> Column:
    """A 4-bit float: sign, two exponent bits (bias 1), one mantissa bit."""
    e, m = F.shiftright(code, 1).bitwiseAND(3), code.bitwiseAND(1)
    size = F.when(e == 0, m * 0.5).otherwise(F.pow(F.lit(2.0), e - 1) * (1 + m * 0.5))
    return F.when(code.bitwiseAND(8) == 0, size).otherwise(-size)


def f8_value(code: Column, exponent_bits: int, bias: int, kind: str) -> Column:
    """An 8-bit float by its fields. kind: "fn" (no infinities, all ones is nan), "ieee" (infinities and nans at the highest
    exponent) or "fnuz" (no negative zero: that code is nan)."""
    mantissa_bits = 7 - exponent_bits
    top = (1 << exponent_bits) - 1
    e, m = F.shiftright(code, mantissa_bits).bitwiseAND(top), code.bitwiseAND((1 << mantissa_bits) - 1)
    part = m / float(1 << mantissa_bits)
    size = F.when(e == 0, F.lit(2.0 ** (1 - bias)) * part).otherwise(F.pow(F.lit(2.0), e - bias) * (1 + part))
    value = F.when(code.bitwiseAND(128) == 0, size).otherwise(-size)
    nan = F.lit(float("nan"))
    if kind == "fn":
        return F.when(code.bitwiseAND(127) == 127, nan).otherwise(value)
    if kind == "fnuz":
        return F.when(code == 128, nan).otherwise(value)
    infinite = F.when(code.bitwiseAND(128) == 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when((e == top) & (m == 0), infinite).when(e == top, nan).otherwise(value)


def e8m0_value(code: Column) -> Column:
    """A power of two: the code less 127; 255 is nan."""
    return F.when(code == 255, F.lit(float("nan"))).otherwise(F.pow(F.lit(2.0), code - 127))


F8 = {
    "f8_e4m3fn": lambda c: f8_value(c, 4, 7, "fn"),
    "f8_e5m2": lambda c: f8_value(c, 5, 15, "ieee"),
    "f8_e4m3fnuz": lambda c: f8_value(c, 4, 8, "fnuz"),
    "f8_e5m2fnuz": lambda c: f8_value(c, 5, 16, "fnuz"),
    "f8_e8m0": e8m0_value,
}
