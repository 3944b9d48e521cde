"""`format("tensorfile")`: tensor files as DataFrames, and DataFrames as tensor files.

Three relations, because a Python source has no column pruning: `parts` (the default) is metadata only and reads footers and
manifests; `blobs` has the content too; `files` has a row for each file. The content of a large file is read by several tasks,
each with its share of the objects. A large manifest is checked once, where the scan is planned, and each task reads its own range
of it, object by object, so that no process holds it whole. The option `name` reads one object only; it is an option and no pushed filter, because Spark
keeps a Python reader's pushed filters with the DataFrame, where they would hold for its later queries too. Writing makes a data
shard for each task and, on commit, a root whose manifest refers to them by name, size and digest; it is merged from the shards'
sorted objects, which lie beside them till then. Until the root is moved into
place nothing is published, and shards of failed attempts are removed.

Tasks open paths themselves, so on a cluster they must be on storage that is mounted on all nodes."""

from __future__ import annotations

import glob
import heapq
import json
import os
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby, pairwise

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..model import InvalidInput, NotFound, Rejected, Unsupported
from . import cbor, container, foreign
from .vocabulary import standard

PARTS = "path string, format string, name string, part string, shape array<decimal(20,0)>, layout string, dtype string, logical string, shard string, offset bigint, length bigint, encoding string, decoded_length bigint, digest string, payload_kind string, attributes string, status string"
BLOBS = "path string, name string, part string, dtype string, logical string, length bigint, content binary, status string"
FILES = "path string, format string, size bigint, attributes string, objects bigint, shards array<string>, status string"
VOCABULARY = standard()
#: Bytes of content, and objects, about, that a task reads of one file.
TASK_BYTES = 128 << 20
TASK_OBJECTS = 1 << 16
#: Bytes of the largest manifest that is taken whole; a larger one is surveyed once, and each task reads its own range of it.
WHOLE_MANIFEST = 1 << 20


@dataclass
class _File(InputPartition):
    path: str
    share: int = 0
    shares: int = 1


@dataclass
class _Range(InputPartition):
    """Objects of a surveyed manifest, from one place in the file to another, and the shards of all."""

    path: str
    at: int
    end: int
    shards: dict[str, str]
    rejected: tuple[type, tuple] | None = None  # an error and its arguments: errors with two don't come through pickle


def _large(path: str) -> bool:
    """Whether a file is a native one whose manifest isn't taken whole."""
    try:
        if foreign.detect(path) != "zt":
            return False
        frame = container.frame_of(*container.file_reader(path))
    except (Rejected, Unsupported):
        return False
    return frame.manifest is not None and frame.manifest[1] > WHOLE_MANIFEST


def _content_bytes(path: str) -> int:
    """Bytes of a file and of the shards that its manifest names."""
    size = os.path.getsize(path)
    try:
        _, manifest = container.manifest_of(*container.file_reader(path))
    except (Rejected, Unsupported):
        return size
    return size + sum(e["size"] for e in (manifest or {}).get("shards", {}).values())


def _ranges(path: str, most_bytes: int | None) -> list[_Range]:
    """The objects of a surveyed file by about equal numbers, and if most_bytes is given by about as many bytes."""
    cuts, objects, held = [], 0, 0

    def visit(name: str, obj: dict, at: int) -> None:
        nonlocal objects, held
        if not cuts or objects == TASK_OBJECTS or most_bytes is not None and held >= most_bytes:
            cuts.append(at)
            objects = held = 0
        objects += 1
        held += sum(p["blob"][1] for p in obj["parts"].values())

    try:
        _, rest = container.survey(*container.file_reader(path), VOCABULARY, visit)
        shards = container.find_shards(path, rest.get("shards", {}))
    except (Rejected, Unsupported, InvalidInput, NotFound) as e:
        return [_Range(path, 0, 0, {}, (Rejected, (e.rule, e.detail)) if isinstance(e, Rejected) else (type(e), e.args))]
    return [_Range(path, a, b, shards) for a, b in pairwise([*cuts, rest["end"]])]


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(os.path.join(path, "*")) if os.path.isfile(p) and not os.path.basename(p).startswith("."))
    return sorted(glob.glob(path))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, relation: str):
        self.files, self.relation = [f for p in options["path"].split(",") for f in _files(p)], relation
        if not self.files:
            raise NotFound(options["path"])
        self.strict, self.only = options.get("mode", "strict") == "strict", options.get("name")

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for f in self.files:
            if self.relation == "files" or self.only is not None:
                out.append(_File(f))
            elif _large(f):
                out += _ranges(f, TASK_BYTES if self.relation == "blobs" else None)
            elif self.relation == "parts":
                out.append(_File(f))
            else:
                n = max(1, -(-(_content_bytes(f) if len(self.files) <= 64 else os.path.getsize(f)) // TASK_BYTES))
                out += [_File(f, k, n) for k in range(n)]
        return out

    def read(self, partition: _File | _Range) -> Iterator[tuple]:
        path = partition.path
        try:
            if isinstance(partition, _Range):
                if partition.rejected is not None:
                    kind, said = partition.rejected
                    raise kind(*said)
                yield from self._of_range(partition)
                return
            if (self.relation == "files" or self.only is not None) and _large(path):
                yield from self._surveyed(path)
                return
            source = foreign.open_any(path)
            form = getattr(source, "form", "zt")
        except (Rejected, Unsupported, InvalidInput, NotFound) as e:
            if self.strict:
                raise
            if getattr(partition, "share", 0) == 0:
                yield (path, *(None,) * ({"parts": 15, "blobs": 6, "files": 5}[self.relation]), getattr(e, "rule", type(e).__name__))
            return
        if self.relation == "files":
            manifest = source.manifest or {}
            yield (path, form, os.path.getsize(path), container.attributes_text(source.attributes), len(source.objects), sorted(manifest.get("shards", {})), "ok")
            return
        names = [self.only] if self.only is not None and self.only in source else [] if self.only is not None else source.names()
        for name in self._share(source, names, partition):
            yield from self._rows(path, form, source, name)

    def _of_range(self, partition: _Range) -> Iterator[tuple]:
        """The objects of a range, one at a time."""
        reads = {None: container.file_reader(partition.path)[0]} | {name: container.file_reader(found)[0] for name, found in partition.shards.items()}
        for name, obj in container.entries(reads[None], partition.at, partition.end):
            yield from self._rows(partition.path, "zt", container.Source({"objects": {name: obj}}, reads, VOCABULARY), name)

    def _surveyed(self, path: str) -> Iterator[tuple]:
        """What is asked for of a file whose manifest isn't taken whole: its row, or one object of it."""
        found = {}

        def visit(name: str, obj: dict, at: int) -> None:
            if name == self.only:
                found[name] = obj

        read, size = container.file_reader(path)
        _, rest = container.survey(read, size, VOCABULARY, visit)
        shards = container.find_shards(path, rest.get("shards", {}))
        if self.relation == "files":
            yield (path, "zt", size, container.attributes_text(rest.get("attributes")), rest["objects"], sorted(shards), "ok")
            return
        reads = {None: read} | {name: container.file_reader(f)[0] for name, f in shards.items()}
        for name in found:
            yield from self._rows(path, "zt", container.Source({"objects": found}, reads, VOCABULARY), name)

    def _rows(self, path: str, form: str, source, name: str) -> Iterator[tuple]:
        """The rows of an object."""
        from decimal import Decimal

        obj = source.tensor(name)
        for role in sorted(obj["parts"], key=str.encode):
            p = obj["parts"][role]
            at, n = p["blob"]
            if self.relation == "parts":
                kind = "Opaque" if name in getattr(source, "decoders", {}) else "Encoded" if "encoding" in p else "At"
                yield (path, form, name, role, [Decimal(x) for x in obj["shape"]], obj["layout"], p["dtype"], p.get("type"), p.get("shard"), at, n, p.get("encoding"), p.get("decoded_length"), p.get("digest"), kind, container.attributes_text(obj.get("attributes")), "ok")
                continue
            try:
                raw, status = source.bytes(name, role), "ok"
            except (Rejected, Unsupported, InvalidInput, NotFound) as e:
                if self.strict:
                    raise
                raw, status = None, getattr(e, "rule", type(e).__name__)
            yield (path, name, role, p["dtype"], p.get("type"), len(raw) if raw is not None else None, raw, status)

    @staticmethod
    def _share(source, names: list[str], partition: _File) -> Iterator[str]:
        """The objects whose bytes begin in a task's share of all bytes."""
        if partition.shares == 1:
            yield from names
            return
        sizes = [sum(p["blob"][1] for p in source.tensor(n)["parts"].values()) for n in names]
        total, before = max(sum(sizes), 1), 0
        for name, size in zip(names, sizes, strict=True):
            if min(before * partition.shares // total, partition.shares - 1) == partition.share:
                yield name
            before += size


@dataclass
class _Shard(WriterCommitMessage):
    path: str | None
    name: str
    size: int
    digest: str
    objects: int


def _entries_of(path: str) -> str:
    """Where the encoded objects of a shard lie until the root is made: hidden, so that no reader takes it for a file."""
    return os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.objects")


def _stored(path: str) -> Iterator[tuple[bytes, bytes]]:
    """(encoded name, encoded object) as _Writer.write left them; no file stays open in between."""
    read, size = container.file_reader(_entries_of(path))
    at, step = 0, 1 << 18
    while at < size:
        data, k = read(at, min(step, size - at)), 0
        while k + 8 <= len(data):
            n, m = struct.unpack_from("<II", data, k)
            if k + 8 + n + m > len(data):
                break
            yield data[k + 8 : k + 8 + n], data[k + 8 + n : k + 8 + n + m]
            k += 8 + n + m
        at, step = at + k, step if k else step * 2


class _Writer(DataSourceWriter):
    """Rows of name, dtype, shape and content, and if given logical, part, layout, encoding and attributes (JSON); the parts of
    an object are rows in a row."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex[:8]
        self.columns = schema.fieldNames()
        self.align = int(options.get("align", container.CANONICAL))
        self.attributes = options.get("attributes")
        if missing := {"name", "dtype", "shape", "content"} - set(self.columns):
            raise InvalidInput(f"columns {sorted(missing)} are missing")
        if not self.path.endswith(".zt"):
            raise InvalidInput("a tensor file's path ends with .zt")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{self.run}-{task.partitionId():05d}-{task.attemptNumber()}"
        path = container.beside(self.path)(name, {})
        w = container.Writer(path, canonical=False, align=self.align)
        made: list[tuple[bytes, bytes]] = []
        try:
            for own, group in groupby((row.asDict() for row in rows), lambda r: r["name"]):
                first, parts = None, {}
                for r in group:
                    first = first or r
                    role = r.get("part") or "data"
                    if role in parts:
                        raise Rejected("NameCollision", f"{own}/{role}")
                    parts[role] = container.part(r["dtype"], bytes(r["content"]), type=r.get("logical"), encoding=r.get("encoding"))
                attributes = container.attributes_from(json.loads(first["attributes"])) if first.get("attributes") else None
                w.object(own, [int(x) for x in first["shape"]], first.get("layout") or "dense", parts, attributes)
                obj = w.objects[own]
                w.objects[own] = None  # the name is kept, against a second one; the rest lies encoded
                made.append((cbor.encode(own, 2), cbor.encode(obj | {"parts": {k: p | {"shard": name} for k, p in obj["parts"].items()}}, 2)))
            if not made:
                w.abandon()
                return _Shard(None, name, 0, "", 0)
            made.sort()
            with open(_entries_of(path), "wb") as f:
                for key, obj in made:
                    f.write(struct.pack("<II", len(key), len(obj)) + key + obj)
            w.finish_shard()
        except BaseException:
            w.abandon()
            if os.path.exists(_entries_of(path)):
                os.remove(_entries_of(path))
            raise
        identity = container.shard_identity(path)
        return _Shard(path, name, identity["size"], identity["digest"], len(made))

    def commit(self, messages: list[_Shard | None]) -> None:
        if os.path.exists(self.path) and not self.overwrite:
            self.abort(messages)
            raise InvalidInput(f"{self.path} is there already")
        w = container.Writer(self.path, canonical=False, align=self.align)
        try:
            if self.attributes:
                w.set_attributes(container.attributes_from(json.loads(self.attributes)))
            kept = [m for m in messages if m is not None and m.path is not None]
            for m in kept:
                w.add_shard(m.name, m.size, m.digest)
            w.finish_with(sum(m.objects for m in kept), self._merged(kept))
        except BaseException:
            w.abandon()
            self.abort(messages)
            raise
        for m in kept:
            os.remove(_entries_of(m.path))

    @staticmethod
    def _merged(shards: list[_Shard]) -> Iterator[bytes]:
        """The encoded objects of all shards in the order of their names, of which one name is one object's."""
        before = None
        for key, obj in heapq.merge(*(_stored(m.path) for m in shards)):
            if key == before:
                raise Rejected("NameCollision", cbor.decode(key))
            before = key
            yield key + obj

    def abort(self, messages: list[_Shard | None]) -> None:
        for m in messages:
            if m is not None and m.path:
                for path in (m.path, _entries_of(m.path)):
                    if os.path.exists(path):
                        os.remove(path)


class TensorFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensorfile"

    def _relation(self) -> str:
        got = self.options.get("relation", "parts")
        if got not in ("parts", "blobs", "files"):
            raise InvalidInput(f"relation {got}")
        return got

    def schema(self) -> str:
        return {"parts": PARTS, "blobs": BLOBS, "files": FILES}[self._relation()]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), self._relation())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema, overwrite)


def register(spark) -> None:
    spark.dataSource.register(TensorFile)
