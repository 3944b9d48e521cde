"""HDF5: old-style groups, contiguous and chunked datasets, deflate and shuffle filters. Chunks that are missing are refused,
not filled."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

from ..model import InvalidInput, Unsupported
from .foreign import MAX_ALLOC, MAX_DEPTH, Foreign

#: Nodes of trees and headers that are visited in all.
MAX_NODES = 100_000
_NONE = (1 << 64) - 1


class _File:
    def __init__(self, data: bytes):
        self.data, self.nodes = data, 0

    def raw(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > len(self.data):
            raise InvalidInput("hdf5: a range lies outside the file")
        return self.data[at : at + n]

    def number(self, at: int, size: int) -> int:
        return int.from_bytes(self.raw(at, size), "little")

    def visit(self) -> None:
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise InvalidInput("hdf5: too many nodes")

    def messages(self, at: int):
        """(type, start, size) of an object header of version 1, with its continuations."""
        if self.data[at : at + 4] == b"OHDR":
            raise Unsupported("hdf5: object headers of version 2")
        if self.number(at, 1) != 1:
            raise InvalidInput("hdf5: object header")
        count, blocks = self.number(at + 2, 2), [(at + 16, self.number(at + 8, 4))]
        while blocks and count > 0:
            self.visit()
            pos, size = blocks.pop(0)
            end = pos + size
            while pos + 8 <= end and count > 0:
                kind, n = self.number(pos, 2), self.number(pos + 2, 2)
                count -= 1
                if kind == 0x10:
                    blocks.append((self.number(pos + 8, 8), self.number(pos + 16, 8)))
                yield kind, pos + 8, n
                pos += 8 + n

    def links(self, tree: int, heap: int):
        """(name, header) of a group, by its tree of symbol tables and its heap of names."""
        if self.raw(heap, 4) != b"HEAP":
            raise InvalidInput("hdf5: heap")
        names, size = self.number(heap + 24, 8), self.number(heap + 8, 8)
        todo = [tree]
        while todo:
            self.visit()
            at = todo.pop(0)
            if self.raw(at, 4) == b"TREE":
                used = self.number(at + 6, 2)
                todo = [self.number(at + 32 + 16 * k, 8) for k in range(used)] + todo
            elif self.raw(at, 4) == b"SNOD":
                for k in range(self.number(at + 6, 2)):
                    entry = at + 8 + 40 * k
                    text = self.raw(names, size)[self.number(entry, 8) :]
                    yield text.split(b"\0", 1)[0].decode("utf-8", "strict"), self.number(entry + 8, 8)
            else:
                raise InvalidInput("hdf5: group node")


def _kind(f: _File, at: int) -> dict | None:
    """The storage type of a datatype message; None for what isn't a plain number."""
    family, bits, size = f.number(at, 1) & 15, f.number(at + 1, 1), f.number(at + 4, 4)
    if family > 1:
        return None
    if bits & 1 and size > 1:
        raise Unsupported("hdf5: big-endian numbers")
    letter = "f" if family == 1 else "i" if bits & 8 else "u"
    if size not in (1, 2, 4, 8) or letter == "f" and size == 1:
        return None
    return {"dtype": f"{letter}{8 * size}"}


def _shape(f: _File, at: int) -> list[int]:
    version, rank = f.number(at, 1), f.number(at + 1, 1)
    if version not in (1, 2) or rank > 32:
        raise Unsupported("hdf5: dataspace")
    start = at + (8 if version == 1 else 4)
    return [f.number(start + 8 * k, 8) for k in range(rank)]


def _layout(f: _File, at: int, size: int):
    """("contiguous", address, length), ("chunked", tree, chunk shape) or ("compact", address, length)."""
    version = f.number(at, 1)
    if version in (1, 2):
        rank, family = f.number(at + 1, 1), f.number(at + 2, 1)
        if family == 1:
            return "contiguous", f.number(at + 8, 8), None
        if family == 2:
            return "chunked", f.number(at + 8, 8), [f.number(at + 16 + 4 * k, 4) for k in range(rank - 1)]
        raise Unsupported("hdf5: layout")
    if version == 3:
        family = f.number(at + 1, 1)
        if family == 0:
            return "compact", at + 4, f.number(at + 2, 2)
        if family == 1:
            return "contiguous", f.number(at + 2, 8), f.number(at + 10, 8)
        if family == 2:
            rank = f.number(at + 2, 1)
            return "chunked", f.number(at + 3, 8), [f.number(at + 11 + 4 * k, 4) for k in range(rank - 1)]
    raise Unsupported(f"hdf5: layout version {version}")


def _filters(f: _File, at: int) -> list[tuple[int, list[int]]]:
    version, count = f.number(at, 1), f.number(at + 1, 1)
    if version not in (1, 2):
        raise Unsupported("hdf5: filters")
    pos, out = at + (8 if version == 1 else 2), []
    for _ in range(count):
        number = f.number(pos, 2)
        named = version == 1 or number >= 256
        name = f.number(pos + 2, 2) if named else 0
        pos += 4 if named else 2
        n = f.number(pos + 2, 2)
        pos += 4
        pos += -(-name // 8) * 8 if version == 1 else name
        out.append((number, [f.number(pos + 4 * k, 4) for k in range(n)]))
        pos += 4 * n + (4 if version == 1 and n % 2 else 0)
    if any(number not in (1, 2) for number, _ in out):
        raise Unsupported(f"hdf5: filters {[number for number, _ in out]}")
    return out


def _unfiltered(raw: bytes, filters: list[tuple[int, list[int]]], skip: int, width: int, size: int) -> bytes:
    for k in reversed(range(len(filters))):
        if skip >> k & 1:
            continue
        if filters[k][0] == 1:
            try:
                raw = zlib.decompressobj().decompress(raw, size + 1)
            except zlib.error as e:
                raise InvalidInput(f"hdf5: {e}") from e
        else:  # bytes of a kind lie together
            step = filters[k][1][0] if filters[k][1] else width
            n = len(raw) // step
            raw = np.frombuffer(raw[: n * step], np.uint8).reshape(step, n).T.tobytes() + raw[n * step :]
    if len(raw) != size:
        raise InvalidInput("hdf5: a chunk's size")
    return raw


def _chunks(f: _File, tree: int, rank: int):
    """(coordinates, address, stored size, skipped filters) of the leaves of a chunk tree."""
    todo, key = [tree], 8 + 8 * (rank + 1)
    while todo:
        f.visit()
        at = todo.pop()
        if f.raw(at, 4) != b"TREE" or f.number(at + 4, 1) != 1:
            raise InvalidInput("hdf5: chunk node")
        level, used = f.number(at + 5, 1), f.number(at + 6, 2)
        for k in range(used):
            pos = at + 24 + k * (key + 8)
            child = f.number(pos + key, 8)
            if level:
                todo.append(child)
            else:
                yield tuple(f.number(pos + 8 + 8 * d, 8) for d in range(rank)), child, f.number(pos, 4), f.number(pos + 4, 4)


def _placed(f: _File, tree: int, shape: list[int], chunk: list[int], width: int) -> list[tuple]:
    """The chunks (place, address, stored size, skipped filters) of a dataset, which cover all of it; nothing is decoded."""
    if math.prod(shape) * width > MAX_ALLOC or not chunk or 0 in chunk or len(chunk) != len(shape):
        raise InvalidInput("hdf5: chunked shape")
    out, seen = [], set()
    for at, address, stored, skip in _chunks(f, tree, len(shape)) if tree != _NONE else ():
        if any(a % c or a >= s for a, c, s in zip(at, chunk, shape, strict=True)) or at in seen:
            raise InvalidInput("hdf5: a chunk's place")
        f.raw(address, stored)
        seen.add(at)
        out.append((at, address, stored, skip))
    if len(seen) != math.prod(-(-s // c) for s, c in zip(shape, chunk, strict=True)):
        raise Unsupported("hdf5: chunks are missing, and nothing is filled in")
    return out


def _assembled(read, placed: list[tuple], shape: list[int], chunk: list[int], width: int, filters) -> bytes:
    """The dataset's bytes, from its chunks' ranges of the file."""
    out = np.zeros([*shape, width], np.uint8)
    for at, address, stored, skip in placed:
        raw = _unfiltered(read(address, stored), filters, skip, width, math.prod(chunk) * width)
        block = np.frombuffer(raw, np.uint8).reshape([*chunk, width])
        keep = tuple(slice(0, min(c, s - a)) for a, c, s in zip(at, chunk, shape, strict=True))
        out[tuple(slice(a, a + k.stop) for a, k in zip(at, keep, strict=True))] = block[keep]
    return out.tobytes()


def _dataset(out: Foreign, f: _File, name: str, messages: list) -> None:
    found = {kind: (at, size) for kind, at, size in messages}
    kind = _kind(f, found[3][0])
    if kind is None:
        return
    shape, width = _shape(f, found[1][0]), int(kind["dtype"][1:]) // 8
    filters = _filters(f, found[11][0]) if 11 in found else []
    form, at, more = _layout(f, *found[8])
    length = math.prod(shape) * width
    if form == "chunked":
        placed, read = _placed(f, at, shape, more, width), out.read[None]
        out.put(name, shape, kind, None, length, lambda: _assembled(read, placed, shape, more, width, filters))
        return
    if filters or more is not None and more != length:
        raise InvalidInput(f"hdf5: {name!r} has {more} bytes, its shape needs {length}")
    if at == _NONE:
        if length:
            raise Unsupported(f"hdf5: {name!r} was never written")
        at = 0
    out.put(name, shape, kind, at, length)


def hdf5(path: str) -> Foreign:
    out = Foreign(path, "hdf5")
    f = _File(out.read[None](0, out.size))
    if f.raw(0, 8) != b"\x89HDF\r\n\x1a\n":
        raise InvalidInput("hdf5: signature")
    if (version := f.number(8, 1)) not in (0, 1):
        raise Unsupported(f"hdf5: superblock version {version}")
    if (f.number(13, 1), f.number(14, 1)) != (8, 8):
        raise Unsupported("hdf5: addresses that aren't 64 bits")
    root = 24 + (4 if version == 1 else 0) + 32  # the root's symbol table entry
    todo = [("", f.number(root + 8, 8), 0)]
    visited = set()
    while todo:
        prefix, header, depth = todo.pop()
        if header in visited:
            continue
        visited.add(header)
        if depth > MAX_DEPTH:
            raise InvalidInput("hdf5: nested too deeply")
        messages = list(f.messages(header))
        group = next((at for kind, at, _ in messages if kind == 0x11), None)
        try:
            if group is not None:
                for name, child in f.links(f.number(group, 8), f.number(group + 8, 8)):
                    todo.append((f"{prefix}/{name}" if prefix else name, child, depth + 1))
            elif {1, 3, 8} <= {kind for kind, _, _ in messages}:
                _dataset(out, f, prefix, messages)
        except (UnicodeDecodeError, struct.error) as e:
            raise InvalidInput(f"hdf5: {e}") from e
    return out
