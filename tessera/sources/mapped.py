"""Tensors of mapped files, without a copy: borrowed bytes, arrays over them, and hints to the page cache.

A borrowed view keeps its file mapped. What has no address (encoded parts, parts that are decoded on reading) is refused rather
than copied; `Source.bytes` copies."""

from __future__ import annotations

import bisect
import mmap
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from ..model import FLOOR, InvalidInput, Unsupported
from .container import Source
from .foreign import as_array

#: Types that an exchanged array may have; others come as raw bytes only.
EXCHANGED = ("f64", "f32", "f16", "i64", "i32", "i16", "i8", "u64", "u32", "u16", "u8")


@dataclass(frozen=True)
class Location:
    path: str
    offset: int
    length: int


@dataclass(frozen=True)
class Caps:
    """What can be done with a part as it lies: take its address, drop its pages without another's, check it; and what its
    offset is a multiple of."""

    locate: bool
    evict: bool
    verify: bool
    alignment: int


class Mapped:
    def __init__(self, source: Source):
        self.source = source
        self.maps: dict[str | None, mmap.mmap] = {}
        self.ranges: dict[str | None, list[tuple[int, int]]] = {}
        for obj in source.objects.values():
            for p in obj["parts"].values():
                if p["blob"][1]:
                    self.ranges.setdefault(p.get("shard"), []).append(tuple(p["blob"]))
        self.ranges = {k: sorted(set(v)) for k, v in self.ranges.items()}

    def location(self, name: str, role: str | None = None) -> Location:
        """Where a part lies; Unsupported where it has no address."""
        shard, at, n = self.source.locate(name, role)
        return Location(self.source.paths[shard], at, n)

    def _map(self, shard: str | None) -> mmap.mmap:
        if shard not in self.maps:
            with open(self.source.paths[shard], "rb") as f:
                self.maps[shard] = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        return self.maps[shard]

    def borrow(self, name: str, role: str | None = None) -> memoryview:
        """A read-only view of a part's bytes, never a copy."""
        shard, at, n = self.source.locate(name, role)
        if not n:
            return memoryview(b"")
        if at < 0 or at + n > os.path.getsize(self.source.paths[shard]):
            raise InvalidInput(f"{name} ends beyond its file")
        return memoryview(self._map(shard))[at : at + n]

    def array(self, name: str) -> np.ndarray:
        """A dense tensor as a read-only array over the mapping, which other libraries can take over by DLPack (on the CPU);
        types that these don't know are refused."""
        part = self.source.part(name, "data")
        if part["dtype"] not in EXCHANGED or part.get("type") is not None:
            raise Unsupported(f"{name}: {part.get('type') or part['dtype']} can't be exchanged")
        view = self.borrow(name, "data")

        class Own:
            tensor, part = self.source.tensor, self.source.part

            @staticmethod
            def bytes(*_) -> memoryview:
                return view

        return as_array(Own, name)

    def _pages(self, name: str, role: str | None) -> tuple[str | None, int, int]:
        shard, at, n = self.source.locate(name, role)
        first = at // FLOOR * FLOOR
        return shard, first, -(-(at + n) // FLOOR) * FLOOR - first

    def caps(self, name: str, role: str | None = None) -> Caps:
        part = self.source.part(name, role)
        try:
            _, at, n = self.source.locate(name, role)
        except Unsupported:
            return Caps(False, False, "digest" in part, FLOOR)
        return Caps(True, bool(n) and self._alone(name, role), "digest" in part, at & -at if at else FLOOR)

    def _alone(self, name: str, role: str | None) -> bool:
        """No other range in use touches the part's pages."""
        shard, first, size = self._pages(name, role)
        own = tuple(self.source.locate(name, role)[1:])
        ranges = self.ranges[shard]
        near = bisect.bisect_left(ranges, (first + size, 0))
        return all(r == own or r[0] + r[1] <= first for r in ranges[:near])

    def _advise(self, name: str, role: str | None, how: int) -> None:
        shard, first, size = self._pages(name, role)
        if size:
            own = self._map(shard)
            own.madvise(how, first, min(size, len(own) - first))

    def prefetch(self, name: str, role: str | None = None) -> None:
        """Asks for a part's pages before they are read."""
        self._advise(name, role, mmap.MADV_WILLNEED)

    def evict(self, name: str, role: str | None = None) -> bool:
        """Gives a part's pages back, if nothing else lies on them."""
        if not self.caps(name, role).evict:
            return False
        self._advise(name, role, mmap.MADV_DONTNEED)
        return True

    def stream(self, names: Iterable[str], role: str | None = None) -> Iterator[tuple[str, memoryview]]:
        """Views one after the other: the next part is asked for while one is used, and given back after."""
        names = list(names)
        for k, name in enumerate(names):
            if k + 1 < len(names):
                self.prefetch(names[k + 1], role)
            yield name, self.borrow(name, role)
            self.evict(name, role)
