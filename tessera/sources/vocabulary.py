"""What layouts, encodings and logical types mean. A vocabulary is open: what is registered later is found first."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..model import LOGICAL, U64_MAX, WIDTHS, Rejected, Unsupported

# Identifiers of layouts and encodings, and the bounds of seekable frames.
SPARSE_CSR = "zt.sparse_csr/1"
SEEKABLE = "zt.zstd-seekable/1"
SEEKABLE_FRAME = 1 << 20
SEEKABLE_MAX_FRAME = 16 << 20
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_TABLE_MAGIC = 0x8F92EAB1


@dataclass
class Logical:
    """A logical type: the storage type that it pins, its size for n elements, and a rule on its bytes."""

    dtype: str
    size: Callable[[int], int]
    check: Callable[[bytes, int | None], str | None] = lambda raw, n: None


@dataclass
class Encoding:
    encode: Callable[[bytes], bytes]
    decode: Callable[[bytes, int], bytes]


Layout = Callable[[str, dict, "Vocabulary"], None]


def _check_bool(raw: bytes, n: int | None) -> str | None:
    return "a byte is neither 0 nor 1" if (np.frombuffer(raw, np.uint8) > 1).any() else None


def _check_f4(raw: bytes, n: int | None) -> str | None:
    return "the unused half of the last byte isn't zero" if n is not None and n % 2 and raw and raw[-1] >> 4 else None


@dataclass
class Vocabulary:
    layouts: list[tuple[str, Layout]] = field(default_factory=list)
    encodings: list[tuple[str, Encoding]] = field(default_factory=list)
    logicals: list[tuple[str, Logical]] = field(default_factory=list)

    def _find(self, table: list, key: str):
        return next((v for k, v in reversed(table) if k == key), None)

    def layout(self, name: str) -> Layout | None:
        return self._find(self.layouts, name)

    def encoding(self, name: str) -> Encoding | None:
        return self._find(self.encodings, name)

    def logical(self, name: str) -> Logical | None:
        return self._find(self.logicals, name)

    def with_layout(self, name: str, layout: Layout) -> Vocabulary:
        return Vocabulary([*self.layouts, (name, layout)], self.encodings, self.logicals)

    def with_encoding(self, name: str, encoding: Encoding) -> Vocabulary:
        return Vocabulary(self.layouts, [*self.encodings, (name, encoding)], self.logicals)

    def with_logical(self, name: str, logical: Logical) -> Vocabulary:
        return Vocabulary(self.layouts, self.encodings, [*self.logicals, (name, logical)])

    def size_of(self, part: dict, n: int) -> int | None:
        """Decoded bytes of n elements of a part; None if its logical type is unknown."""
        name = part.get("type")
        if name is None:
            return n * WIDTHS[part["dtype"]]
        kind = self.logical(name)
        return kind.size(n) if kind else None

    def check_values(self, part: dict, raw: bytes, n: int | None) -> None:
        kind = self.logical(part["type"]) if part.get("type") else None
        if kind and (fault := kind.check(raw, n)):
            raise Rejected("LayoutData", fault)


def decoded_size(part: dict) -> int:
    return part["decoded_length"] if part.get("encoding") is not None else part["blob"][1]


def product(shape: list[int]) -> int | None:
    """Left to right in 64 bits; None as soon as it doesn't fit."""
    out = 1
    for x in shape:
        out *= x
        if out > U64_MAX:
            return None
    return out


def dense(name: str, obj: dict, vocabulary: Vocabulary) -> None:
    if set(obj["parts"]) != {"data"}:
        raise Rejected("LayoutRule", f"{name}: a dense object has the part data only")
    part = obj["parts"]["data"]
    need = vocabulary.size_of(part, product(obj["shape"]))
    if need is not None and need != decoded_size(part):
        raise Rejected("DenseSize", f"{name}: {decoded_size(part)} bytes, not {need}")


def sparse_csr(name: str, obj: dict, vocabulary: Vocabulary) -> None:
    parts, shape = obj["parts"], obj["shape"]
    if len(shape) != 2 or set(parts) != {"values", "indices", "indptr"}:
        raise Rejected("LayoutRule", f"{name}: rank or parts")
    indices, indptr = parts["indices"], parts["indptr"]
    if indices["dtype"] not in ("u32", "u64") or indptr["dtype"] != indices["dtype"] or indices.get("type") or indptr.get("type"):
        raise Rejected("LayoutRule", f"{name}: index types")
    width = WIDTHS[indices["dtype"]]
    n, rest = divmod(decoded_size(indices), width)
    if rest or decoded_size(indptr) != (shape[0] + 1) * width:
        raise Rejected("LayoutRule", f"{name}: index sizes")
    need = vocabulary.size_of(parts["values"], n)
    if need is not None and need != decoded_size(parts["values"]):
        raise Rejected("LayoutRule", f"{name}: {n} values")


def assemble_csr(shape: list[int], indices: np.ndarray, indptr: np.ndarray) -> None:
    """The rules on the data of a sparse matrix."""
    if len(indptr) == 0 or indptr[0] != 0 or (indptr[1:] < indptr[:-1]).any() or indptr[-1] != len(indices):
        raise Rejected("LayoutData", "row pointers")
    if len(indices) and (indices >= shape[1]).any():
        raise Rejected("LayoutData", "a column is outside the shape")
    inner = np.ones(max(len(indices) - 1, 0), dtype=bool)
    starts = indptr[1:-1].astype(np.int64)
    inner[starts[(starts > 0) & (starts < len(indices))] - 1] = False  # a new row may start lower
    if len(indices) > 1 and (indices[1:] <= indices[:-1])[inner].any():
        raise Rejected("LayoutData", "columns of a row don't increase")


def seekable_encode(raw: bytes) -> bytes:
    """Frames of a MiB and a seek table of their sizes in a skippable frame."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
    frames = [raw[s : s + SEEKABLE_FRAME] for s in range(0, len(raw), SEEKABLE_FRAME)] or [b""]
    packed = [packer.compress(f) for f in frames]
    entries = b"".join(struct.pack("<II", len(p), len(f)) for p, f in zip(packed, frames, strict=True))
    table = entries + struct.pack("<IBI", len(frames), 0, SEEK_TABLE_MAGIC)
    return b"".join(packed) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seekable_decode(stored: bytes, length: int) -> bytes:
    import zstandard

    if len(stored) < 17 or struct.unpack("<I", stored[-4:])[0] != SEEK_TABLE_MAGIC:
        raise Rejected("Encoding", "no seek table")
    count, flags = struct.unpack("<IB", stored[-9:-4])
    width = 12 if flags & 0x80 else 8
    start = len(stored) - 9 - count * width - 8
    if flags & 0x7F or start < 0 or struct.unpack("<II", stored[start : start + 8]) != (SKIPPABLE_MAGIC, count * width + 9):
        raise Rejected("Encoding", "the seek table doesn't fit")
    sizes = [struct.unpack("<II", stored[start + 8 + k * width :][:8]) for k in range(count)]
    plain = [d for _, d in sizes]
    if sum(c for c, _ in sizes) != start or sum(plain) != length or any(d > SEEKABLE_MAX_FRAME for d in plain) or len(set(plain[:-1])) > 1 or plain[1:] and plain[-1] > plain[0]:
        raise Rejected("Encoding", "frame sizes")
    out, at = [], 0
    for packed, size in sizes:
        try:
            piece = zstandard.ZstdDecompressor().decompress(stored[at : at + packed], max_output_size=size or 1)
        except zstandard.ZstdError as e:
            raise Rejected("Encoding", str(e)) from e
        if len(piece) != size:
            raise Rejected("Encoding", "a frame's size")
        out.append(piece)
        at += packed
    return b"".join(out)


def standard() -> Vocabulary:
    checks = {"bool": _check_bool, "f4_e2m1": _check_f4}
    logicals = [(name, Logical(dtype, lambda n, a=a, b=b: -(-n * a // b), checks.get(name, lambda raw, n: None))) for name, (dtype, a, b) in LOGICAL.items()]
    return Vocabulary([("dense", dense), (SPARSE_CSR, sparse_csr)], [(SEEKABLE, Encoding(seekable_encode, seekable_decode))], logicals)


def decode(part: dict, stored: bytes, vocabulary: Vocabulary) -> bytes:
    """The decoded bytes of a part."""
    name = part.get("encoding")
    if name is None:
        return stored
    encoding = vocabulary.encoding(name)
    if encoding is None:
        raise Unsupported(f"encoding {name}")
    out = encoding.decode(stored, part["decoded_length"])
    if len(out) != part["decoded_length"]:
        raise Rejected("Encoding", "decoded length")
    return out
