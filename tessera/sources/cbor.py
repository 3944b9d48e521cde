"""Deterministic CBOR, as manifests are written: definite lengths, shortest heads and floats, keys in the order of their
encodings, no tags, at most 32 levels."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from ..model import InvalidInput, Rejected

MAX_DEPTH = 32


@dataclass(frozen=True)
class OddKey:
    """A map key that isn't text, by its encoding."""

    encoded: bytes


def _head(kind: int, n: int) -> bytes:
    if n < 24:
        return bytes([kind << 5 | n])
    for k, size in enumerate((1, 2, 4, 8)):
        if n < 1 << 8 * size:
            return bytes([kind << 5 | 24 + k]) + n.to_bytes(size, "big")
    raise InvalidInput("an integer doesn't fit 64 bits")


def _float(x: float) -> bytes:
    """The shortest of the three widths that holds the value exactly; one nan."""
    if math.isnan(x):
        return b"\xf9\x7e\x00"
    for head, form in ((b"\xf9", ">e"), (b"\xfa", ">f")):
        try:
            raw = struct.pack(form, x)
        except OverflowError:
            continue
        if struct.unpack(form, raw)[0] == x:
            return head + raw
    return b"\xfb" + struct.pack(">d", x)


def encode(value, depth: int = 0) -> bytes:
    if depth > MAX_DEPTH:
        raise InvalidInput("nested too deeply")
    if value is None or isinstance(value, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[value]
    if isinstance(value, OddKey):
        return value.encoded
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, float):
        return _float(value)
    if isinstance(value, (bytes, bytearray)):
        return _head(2, len(value)) + bytes(value)
    if isinstance(value, str):
        raw = value.encode()
        return _head(3, len(raw)) + raw
    if isinstance(value, (list, tuple)):
        return _head(4, len(value)) + b"".join(encode(x, depth + 1) for x in value)
    if isinstance(value, dict):
        pairs = sorted((encode(k, depth + 1), encode(v, depth + 1)) for k, v in value.items())
        return _head(5, len(pairs)) + b"".join(k + v for k, v in pairs)
    raise InvalidInput(f"no encoding for {type(value).__name__}")


def map_head(n: int) -> bytes:
    """The start of a map of n pairs, which follow in the order of their encoded keys."""
    return _head(5, n)


class _Short(Rejected):
    """The bytes end within a value."""

    def __init__(self):
        super().__init__("CborSyntax", "ends early")


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise _Short
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, low: int) -> int:
        if low < 24:
            return low
        if low > 27:
            raise Rejected("CborSyntax", "indefinite or reserved length")
        size = 1 << low - 24
        n = int.from_bytes(self.take(size), "big")
        if n < 24 or size > 1 and n < 1 << 4 * size:
            raise Rejected("CborDeterminism", "a longer head than needed")
        return n

    def value(self, depth: int):
        if depth > MAX_DEPTH:
            raise Rejected("CborDepth")
        first = self.take(1)[0]
        kind, low = first >> 5, first & 31
        if kind == 7:
            return self.simple(low)
        if kind == 6:
            raise Rejected("CborSyntax", "a tag")
        n = self.number(low)
        if kind == 0:
            return n
        if kind == 1:
            return -1 - n
        if kind == 2:
            return self.take(n)
        if kind == 3:
            try:
                return self.take(n).decode()
            except UnicodeDecodeError as e:
                raise Rejected("CborSyntax", "text isn't UTF-8") from e
        if n > len(self.data) - self.at:  # an entry has a byte at least
            raise _Short
        if kind == 4:
            return [self.value(depth + 1) for _ in range(n)]
        out, before = {}, None
        for _ in range(n):
            start = self.at
            key = self.value(depth + 1)
            raw = self.data[start : self.at]
            if before is not None and raw <= before:
                raise Rejected("CborDuplicateKey" if raw == before else "CborDeterminism", "map keys")
            before = raw
            out[key if isinstance(key, str) else OddKey(raw)] = self.value(depth + 1)
        return out

    def simple(self, low: int):
        if low in (20, 21, 22):
            return (False, True, None)[low - 20]
        if low not in (25, 26, 27):
            raise Rejected("CborSyntax", "an unsupported simple value")
        size = 1 << low - 24
        raw = self.take(size)
        x = struct.unpack({2: ">e", 4: ">f", 8: ">d"}[size], raw)[0]
        if _float(x) != bytes([0xE0 | low]) + raw:
            raise Rejected("CborDeterminism", "a wider float than needed")
        return x


def decode(data: bytes):
    reader = _Reader(bytes(data))
    out = reader.value(0)
    if reader.at != len(reader.data):
        raise Rejected("CborSyntax", "bytes after the value")
    return out


class Window:
    """Values one after another from a range of a file, of which no more than a window and the longest value are held."""

    def __init__(self, read: Callable[[int, int], bytes], at: int, end: int, step: int = 1 << 20):
        self.read, self.base, self.end, self.step = read, at, end, step
        self.reader = _Reader(b"")

    @property
    def at(self) -> int:
        return self.base + self.reader.at

    def _of(self, take: Callable[[_Reader], object]):
        while True:
            start = self.reader.at
            try:
                return take(self.reader)
            except _Short:
                held = self.reader.data[start:]
                more = min(max(self.step, len(held)), self.end - self.base - start - len(held))
                if more == 0:
                    raise
                self.base += start
                self.reader = _Reader(held + self.read(self.base + len(held), more))

    def value(self, depth: int):
        return self._of(lambda r: r.value(depth))

    def keyed(self, depth: int) -> tuple[bytes, object]:
        """The next value and its encoding."""

        def take(r: _Reader):
            start = r.at
            x = r.value(depth)
            return r.data[start : r.at], x

        return self._of(take)

    def map_size(self) -> int | None:
        """The number of pairs if a map comes next, whose pairs are then next."""

        def take(r: _Reader):
            first = r.take(1)[0]
            if first >> 5 != 5:
                r.at -= 1
                return None
            return r.number(first & 31)

        return self._of(take)


def pairs(window: Window, n: int, depth: int, value: Callable[[object], object]) -> Iterator[tuple[object, object, int]]:
    """(key, value(key), where the pair begins) of a map, whose keys have to be in order."""
    before = None
    for _ in range(n):
        at = window.at
        raw, key = window.keyed(depth)
        if before is not None and raw <= before:
            raise Rejected("CborDuplicateKey" if raw == before else "CborDeterminism", "map keys")
        before = raw
        own = key if isinstance(key, str) else OddKey(raw)
        yield own, value(own), at
