"""The tensor data model: storage types, logical types, schemas, rejection rules."""

from __future__ import annotations

from pyspark.sql import types as T

# Storage types and their widths in bytes.
WIDTHS = {"f64": 8, "f32": 4, "f16": 2, "bf16": 2, "i64": 8, "i32": 4, "i16": 2, "i8": 1, "u64": 8, "u32": 4, "u16": 2, "u8": 1}

# Logical types, the storage type each pins, and its size in bytes for n elements as (numerator, denominator),
# rounded up.
LOGICAL = {
    "bool": ("u8", 1, 1),
    "f8_e4m3fn": ("u8", 1, 1),
    "f8_e5m2": ("u8", 1, 1),
    "f8_e4m3fnuz": ("u8", 1, 1),
    "f8_e5m2fnuz": ("u8", 1, 1),
    "f8_e8m0": ("u8", 1, 1),
    "f4_e2m1": ("u8", 1, 2),
    "complex64": ("f32", 8, 1),
    "complex128": ("f64", 16, 1),
}

# The 26 rules by which a file is rejected.
RULES = (
    "FileTooSmall", "HeaderMagic", "FooterMagic", "Version", "ManifestBounds", "ManifestTooLarge", "ManifestHash", "CborSyntax",
    "CborDeterminism", "CborDuplicateKey", "CborDepth", "Schema", "Name", "Shape", "BlobAlignment", "BlobBounds", "BlobOverlap",
    "ShardRef", "ShardName", "LayoutRule", "LayoutData", "DenseSize", "Encoding", "Digest", "ShardIdentity", "NameCollision",
)

U64_MAX = 2**64 - 1
#: Least alignment of a blob, canonical alignment, and the longest name in bytes.
FLOOR = 4096
CANONICAL = 65536
MAX_NAME = 1024
MAX_RANK = 64

U64 = T.DecimalType(20, 0)

OBJECTS = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("shape", T.ArrayType(U64), False),
    T.StructField("layout", T.StringType(), False),
    T.StructField("attributes", T.StringType()),
])

PARTS = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("part", T.StringType(), False),
    T.StructField("dtype", T.StringType(), False),
    T.StructField("logical", T.StringType()),
    T.StructField("store_id", T.IntegerType(), False),
    T.StructField("shard", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("encoding", T.StringType()),
    T.StructField("decoded_length", T.LongType()),
    T.StructField("digest", T.StringType()),
    T.StructField("payload_kind", T.StringType(), False),
])


class Rejected(ValueError):
    """A file or plan that breaks a rule."""

    def __init__(self, rule: str, detail: str = ""):
        if rule not in RULES:
            raise KeyError(rule)
        super().__init__(f"{rule}: {detail}" if detail else rule)
        self.rule, self.detail = rule, detail


class Unsupported(ValueError):
    """Input that may be right, but that this engine can't read."""


class NotFound(KeyError):
    """A name that isn't in the catalog."""


class InvalidInput(ValueError):
    """A request that can't be carried out."""
