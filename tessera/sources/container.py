"""The native container: a header, aligned blobs, a manifest and a footer.

Only what is asked for is read: opening takes the footer and the manifest, a part's bytes one range."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import os
import re
import struct
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import xxhash

from ..model import CANONICAL, FLOOR, MAX_NAME, MAX_RANK, U64_MAX, WIDTHS, InvalidInput, NotFound, Rejected, Unsupported
from . import cbor
from .vocabulary import Vocabulary, decode, product, standard

# The signature, the footer's size, the version, the largest manifest, the label of a content digest.
MAGIC = b"\x89ZT2\r\n\x1a\n"
FOOTER = 40
VERSION = 2
MAX_MANIFEST = 1 << 30
CONTENT_LABEL = "zt.content/1"

_DIGEST = re.compile(r"[a-z0-9]+:[0-9a-f]+\Z")
_SHARD = re.compile(r"[A-Za-z0-9_-][A-Za-z0-9._-]{0,63}\Z")

Read = Callable[[int, int], bytes]


def file_reader(path: str) -> tuple[Read, int]:
    """Ranges of a local file, opened for each so that the reader can be sent to a task. A range that isn't whole is an error."""

    def read(at: int, n: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(at)
            got = f.read(n)
        if len(got) != n:
            raise InvalidInput(f"{path}: {n} bytes at {at} end beyond the file")
        return got

    return read, os.path.getsize(path)


def hasher(algorithm: str):
    if algorithm == "sha256":
        return hashlib.sha256()
    if algorithm == "xxh3":
        return xxhash.xxh3_64()
    raise Unsupported(f"digest {algorithm}")


def digest_of(pieces: bytes | Iterable[bytes], algorithm: str = "xxh3") -> str:
    h = hasher(algorithm)
    for p in [pieces] if isinstance(pieces, (bytes, bytearray)) else pieces:
        h.update(p)
    return f"{algorithm}:{h.hexdigest()}"


def shard_identity(path: str, algorithm: str = "sha256") -> dict:
    """Size and digest of a whole file, a MiB at a time."""
    read, size = file_reader(path)
    return {"size": size, "digest": digest_of((read(s, min(1 << 20, size - s)) for s in range(0, size, 1 << 20)), algorithm)}


# --- manifests --------------------------------------------------------------------------------------------------------------


def _must(ok: bool, rule: str, detail: str = "") -> None:
    if not ok:
        raise Rejected(rule, detail)


def _uint(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and 0 <= x <= U64_MAX


def check_name(name) -> None:
    _must(isinstance(name, str), "Schema", "a name isn't text")
    _must(1 <= len(name.encode()) <= MAX_NAME and "\0" not in name, "Name", repr(name[:40]))


def check_attributes(value) -> None:
    _must(isinstance(value, dict), "Schema", "attributes")
    for k in value:
        check_name(k)


def attributes_text(value: dict | None) -> str | None:
    """Attributes as JSON; what JSON lacks (bytes, numbers that aren't finite, keys that aren't text) is spelt as a one-key map."""
    if value is None:
        return None

    def plain(x):
        if isinstance(x, (bytes, bytearray)):
            return {"$bytes": base64.b64encode(x).decode()}
        if isinstance(x, float) and not math.isfinite(x):
            return {"$float": repr(x)}
        if isinstance(x, dict):
            if all(isinstance(k, str) for k in x) and not (len(x) == 1 and next(iter(x)).startswith("$")):
                return {k: plain(v) for k, v in x.items()}
            return {"$map": [[plain(k), plain(v)] for k, v in x.items()]}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(plain(value), ensure_ascii=False)


def attributes_from(value):
    """The value that attributes_text spelt, from parsed JSON."""
    if isinstance(value, dict):
        if len(value) == 1:
            kind, x = next(iter(value.items()))
            if kind == "$bytes":
                return base64.b64decode(x)
            if kind == "$float":
                return float(x)
            if kind == "$map":
                return {attributes_from(k): attributes_from(v) for k, v in x}
        return {k: attributes_from(v) for k, v in value.items()}
    return [attributes_from(v) for v in value] if isinstance(value, list) else value


def check_digest(text) -> None:
    _must(isinstance(text, str) and _DIGEST.match(text) is not None, "Schema", "digest")


def check_schema(m) -> dict:
    """The manifest with unknown keys left out."""
    _must(isinstance(m, dict) and isinstance(m.get("objects"), dict), "Schema", "objects")
    out: dict = {"objects": {}}
    if "attributes" in m:
        check_attributes(m["attributes"])
        out["attributes"] = m["attributes"]
    if "shards" in m:
        _must(isinstance(m["shards"], dict), "Schema", "shards")
        out["shards"] = {}
        for name, entry in m["shards"].items():
            _must(isinstance(name, str), "Schema", "a shard name isn't text")
            _must(_SHARD.match(name) is not None, "ShardName", repr(name[:40]))
            _must(isinstance(entry, dict) and _uint(entry.get("size")), "Schema", "shard")
            check_digest(entry.get("digest"))
            out["shards"][name] = {"size": entry["size"], "digest": entry["digest"]}
    for name, obj in m["objects"].items():
        out["objects"][name] = check_entry(name, obj)
    return out


def check_entry(name, obj) -> dict:
    """An object of a manifest with unknown keys left out."""
    check_name(name)
    _must(isinstance(obj, dict) and isinstance(obj.get("shape"), list) and all(map(_uint, obj["shape"])), "Schema", "shape")
    _must(isinstance(obj.get("layout"), str) and isinstance(obj.get("parts"), dict) and bool(obj["parts"]), "Schema", "layout or parts")
    kept: dict = {"shape": obj["shape"], "layout": obj["layout"], "parts": {}}
    if "attributes" in obj:
        check_attributes(obj["attributes"])
        kept["attributes"] = obj["attributes"]
    for role, part in obj["parts"].items():
        check_name(role)
        _must(isinstance(part, dict) and part.get("dtype") in WIDTHS, "Schema", "dtype")
        blob = part.get("blob")
        _must(isinstance(blob, list) and len(blob) == 2 and all(map(_uint, blob)), "Schema", "blob")
        _must(all(isinstance(part.get(k, ""), str) for k in ("type", "shard", "encoding")), "Schema", "part")
        _must(("encoding" in part) == ("decoded_length" in part), "Schema", "decoded_length")
        _must(_uint(part.get("decoded_length", 0)), "Schema", "decoded_length")
        if "digest" in part:
            check_digest(part["digest"])
        kept["parts"][role] = {k: part[k] for k in ("dtype", "type", "blob", "shard", "encoding", "decoded_length", "digest") if k in part}
    return kept


def each_part(m: dict) -> Iterator[tuple[str, str, dict]]:
    """(name, role, part) in the order of blobs: bytewise by name and role."""
    for name in sorted(m["objects"], key=str.encode):
        parts = m["objects"][name]["parts"]
        for role in sorted(parts, key=str.encode):
            yield name, role, parts[role]


def check_manifest(m: dict, size: int, own: tuple[int, int] | None, vocabulary: Vocabulary) -> None:
    """Shapes, types, references, layouts, and that references are equal or apart. own: the manifest's blob."""
    ranges = _Ranges(own)
    for name, obj in m["objects"].items():
        check_object(name, obj, m.get("shards", {}), size, vocabulary, ranges)
    ranges.check()


def check_object(name: str, obj: dict, shards: dict, size: int, vocabulary: Vocabulary, ranges: _Ranges) -> None:
    """What check_manifest asks of one object; its references go to ranges."""
    _must(len(obj["shape"]) <= MAX_RANK and product(obj["shape"]) is not None, "Shape", name)
    for part in obj["parts"].values():
        shard, (at, n) = part.get("shard"), part["blob"]
        kind = vocabulary.logical(part["type"]) if "type" in part else None
        _must(kind is None or kind.dtype == part["dtype"], "Schema", f"{name}: {part.get('type')} on {part['dtype']}")
        _must(shard is None or shard in shards, "ShardRef", f"{name}: {shard}")
        _must(at >= FLOOR and at % FLOOR == 0, "BlobAlignment", f"{name}: {at}")
        whole = size if shard is None else shards[shard]["size"]
        _must(at + n <= whole - FOOTER, "BlobBounds", name)
        if n:
            ranges.add(shard, at, n)
    layout = vocabulary.layout(obj["layout"])
    if layout is not None:
        layout(name, obj, vocabulary)


class _Ranges:
    """References by file, 16 bytes each: they have to be equal or apart."""

    def __init__(self, own: tuple[int, int] | None):
        self.found: dict[str | None, array] = {None: array("Q", own or ())}

    def add(self, shard: str | None, at: int, n: int) -> None:
        self.found.setdefault(shard, array("Q")).extend((at, n))

    def check(self) -> None:
        import numpy as np

        for found in self.found.values():
            at, n = np.frombuffer(found, "<u8").reshape(-1, 2).T
            order = np.lexsort((n, at))
            at, n = at[order], n[order]
            again = (at[1:] == at[:-1]) & (n[1:] == n[:-1])
            bad = ~again & (at[1:] < at[:-1] + n[:-1])
            _must(not bad.any(), "BlobOverlap", str(at[1:][bad][0]) if bad.any() else "")


@dataclass
class Frame:
    """What the footer says."""

    size: int
    manifest: tuple[int, int] | None
    hash: int


def frame_of(read: Read, size: int) -> Frame:
    _must(size >= len(MAGIC) + FOOTER, "FileTooSmall", str(size))
    _must(read(0, 8) == MAGIC, "HeaderMagic")
    at, n, check, version, _, magic = struct.unpack("<QQQII8s", read(size - FOOTER, FOOTER))
    _must(magic == MAGIC, "FooterMagic")
    _must(version == VERSION, "Version", str(version))
    if n == 0:
        _must(at == 0 and check == 0, "ManifestBounds", "a data shard with a manifest")
        return Frame(size, None, 0)
    _must(n <= MAX_MANIFEST, "ManifestTooLarge", str(n))
    _must(at + n <= size - FOOTER, "ManifestBounds", str(at))
    _must(at >= FLOOR and at % FLOOR == 0, "BlobAlignment", "manifest")
    return Frame(size, (at, n), check)


def manifest_of(read: Read, size: int) -> tuple[Frame, dict | None]:
    """The frame and the schema-checked manifest (None for a data shard); references aren't checked, shards not resolved."""
    frame = frame_of(read, size)
    if frame.manifest is None:
        return frame, None
    raw = read(*frame.manifest)
    _must(xxhash.xxh3_64_intdigest(raw) == frame.hash, "ManifestHash")
    return frame, check_schema(cbor.decode(raw))


def survey(read: Read, size: int, vocabulary: Vocabulary, visit: Callable[[str, dict, int], None]) -> tuple[Frame, dict | None]:
    """All that manifest_of and check_manifest check, object by object, so that memory doesn't grow with the manifest but for 16
    bytes a reference. visit gets each object's name, entry and place in the file; the rest of the manifest comes back, with the
    number of objects and their end. The table of shards precedes the objects, as keys are in the order of their lengths."""
    frame = frame_of(read, size)
    if frame.manifest is None:
        return frame, None
    at, n = frame.manifest
    check = xxhash.xxh3_64()
    for s in range(at, at + n, 1 << 20):
        check.update(read(s, min(1 << 20, at + n - s)))
    _must(check.intdigest() == frame.hash, "ManifestHash")
    window = cbor.Window(read, at, at + n)
    count, rest, end, ranges = window.map_size(), {}, None, _Ranges(frame.manifest)
    _must(count is not None, "Schema", "objects")

    def value(key):
        nonlocal end
        if key != "objects":
            return window.value(1)
        objects = window.map_size()
        _must(objects is not None, "Schema", "objects")
        shards = check_schema({"objects": {}} | {k: v for k, v in rest.items() if k == "shards"}).get("shards", {})
        for name, obj, place in cbor.pairs(window, objects, 2, lambda _: window.value(2)):
            kept = check_entry(name, obj)
            check_object(name, kept, shards, size, vocabulary, ranges)
            visit(name, kept, place)
        end = window.at
        return objects

    for key, x, _ in cbor.pairs(window, count, 1, value):
        rest[key] = x
    _must(end is not None, "Schema", "objects")
    if window.at != at + n:
        raise Rejected("CborSyntax", "bytes after the value")
    ranges.check()
    return frame, check_schema(rest | {"objects": {}}) | {"objects": rest["objects"], "end": end}


def entries(read: Read, at: int, end: int) -> Iterator[tuple[str, dict]]:
    """The objects of a range of a manifest that was surveyed."""
    window = cbor.Window(read, at, end)
    while window.at < end:
        name = window.value(2)
        yield name, check_entry(name, window.value(2))


# --- reading ----------------------------------------------------------------------------------------------------------------


class Source:
    """A manifest and the files that its parts lie in."""

    def __init__(self, manifest: dict | None, read: dict[str | None, Read], vocabulary: Vocabulary, frame: Frame | None = None, paths: dict | None = None):
        self.manifest, self.read, self.vocabulary, self.frame, self.paths = manifest, read, vocabulary, frame, paths or {}
        self.objects = manifest["objects"] if manifest else {}

    @property
    def is_shard(self) -> bool:
        return self.manifest is None

    @property
    def attributes(self) -> dict | None:
        return (self.manifest or {}).get("attributes")

    def names(self) -> list[str]:
        return sorted(self.objects, key=str.encode)

    def __len__(self) -> int:
        return len(self.objects)

    def __contains__(self, name: str) -> bool:
        return name in self.objects

    def __iter__(self) -> Iterator[str]:
        return iter(self.names())

    def tensor(self, name: str) -> dict:
        if name not in self.objects:
            raise NotFound(name)
        return self.objects[name]

    def part(self, name: str, role: str | None = None) -> dict:
        """The part of a role, or the only one."""
        parts = self.tensor(name)["parts"]
        if role is None:
            if len(parts) != 1:
                raise InvalidInput(f"{name} has the parts {', '.join(sorted(parts))}")
            role = next(iter(parts))
        if role not in parts:
            raise NotFound(f"{name}/{role}")
        return parts[role]

    def stored(self, part: dict) -> bytes:
        shard = part.get("shard")
        if shard not in self.read:
            raise NotFound(f"shard {shard}")
        return self.read[shard](*part["blob"])

    def bytes(self, name: str, role: str | None = None) -> bytes:
        part = self.part(name, role)
        return decode(part, self.stored(part), self.vocabulary)

    def locate(self, name: str, role: str | None = None) -> tuple[str | None, int, int]:
        part = self.part(name, role)
        if part.get("encoding") is not None:
            raise Unsupported("an encoded part has no address")
        return part.get("shard"), *part["blob"]

    def verify(self, name: str, role: str | None = None) -> str:
        """ok or no_digest; content rules come before the digest, and either raises."""
        obj, part = self.tensor(name), self.part(name, role)
        raw = decode(part, self.stored(part), self.vocabulary)
        self.vocabulary.check_values(part, raw, product(obj["shape"]) if obj["layout"] == "dense" else None)
        if "digest" not in part:
            return "no_digest"
        _must(digest_of(raw, part["digest"].split(":")[0]) == part["digest"], "Digest", name)
        return "ok"

    def verify_tensor(self, name: str) -> str:
        got = [self.verify(name, role) for role in self.tensor(name)["parts"]]
        return "ok" if got and all(g == "ok" for g in got) else "no_digest"

    def verify_shards(self) -> None:
        """Whole-file digests of all shards."""
        for name, entry in (self.manifest or {}).get("shards", {}).items():
            size, read = entry["size"], self.read[name]
            got = digest_of((read(s, min(1 << 20, size - s)) for s in range(0, size, 1 << 20)), entry["digest"].split(":")[0])
            _must(got == entry["digest"], "ShardIdentity", name)

    def csr(self, name: str):
        """(shape, indptr, indices, value bytes) of a sparse matrix, its data checked."""
        import numpy as np

        from .vocabulary import SPARSE_CSR, assemble_csr

        obj = self.tensor(name)
        if obj["layout"] != SPARSE_CSR:
            raise Unsupported(f"{name}: {obj['layout']}")
        kind = "<u8" if obj["parts"]["indices"]["dtype"] == "u64" else "<u4"
        indices, indptr = (np.frombuffer(self.bytes(name, r), kind).astype(np.uint64) for r in ("indices", "indptr"))
        assemble_csr(obj["shape"], indices, indptr)
        return obj["shape"], indptr, indices, self.bytes(name, "values")

    def content_digest(self, algorithm: str = "sha256") -> str | None:
        return content_digest(self.manifest, algorithm) if self.manifest else None


def content_digest(manifest: dict, algorithm: str = "sha256") -> str | None:
    """The digest of what a model holds, whatever its layout; None if a part has no digest."""
    objects = {}
    for name, obj in manifest["objects"].items():
        parts = {}
        for role, part in obj["parts"].items():
            if "digest" not in part:
                return None
            parts[role] = {k: part[k] for k in ("dtype", "type", "digest") if k in part}
        objects[name] = {k: obj[k] for k in ("shape", "layout", "attributes") if k in obj} | {"parts": parts}
    return digest_of(cbor.encode([CONTENT_LABEL, objects]), algorithm)


def open_image(data: bytes, vocabulary: Vocabulary | None = None) -> Source:
    """A file's bytes, validated; shards aren't resolved."""
    return _opened(lambda at, n: data[at : at + n], len(data), vocabulary or standard())


def _opened(read: Read, size: int, vocabulary: Vocabulary, paths: dict | None = None) -> Source:
    frame, manifest = manifest_of(read, size)
    if manifest is not None:
        check_manifest(manifest, size, frame.manifest, vocabulary)
    return Source(manifest, {None: read}, vocabulary, frame, paths)


def beside(path: str) -> Callable[[str, dict], str]:
    """Shards named after the root: `<stem>-<shard>.zt` in its folder."""
    stem = os.path.splitext(path)[0]
    return lambda name, entry: f"{stem}-{name}.zt"


def by_digest(folder: str) -> Callable[[str, dict], str]:
    """Shards in a folder by algorithm and digest."""
    return lambda name, entry: os.path.join(folder, *entry["digest"].split(":"))


def in_folder(folder: str) -> Callable[[str, dict], str]:
    """Shards in a folder by size and digest; files are hashed only if their size is asked for, and once."""
    known: dict[tuple[str, str], str] = {}

    def find(name: str, entry: dict) -> str:
        algorithm = entry["digest"].split(":")[0]
        for f in sorted(os.listdir(folder)):
            path = os.path.join(folder, f)
            if os.path.isfile(path) and os.path.getsize(path) == entry["size"]:
                if (path, algorithm) not in known:
                    known[path, algorithm] = shard_identity(path, algorithm)["digest"]
                if known[path, algorithm] == entry["digest"]:
                    return path
        raise NotFound(f"shard {name}")

    return find


def open_file(path: str, vocabulary: Vocabulary | None = None, resolver: Callable[[str, dict], str] | None = None) -> Source:
    """A file and the shards that its parts lie in, each of the size that the table gives."""
    out = _opened(*file_reader(path), vocabulary or standard(), {None: path})
    if out.manifest:
        for name, found in find_shards(path, out.manifest.get("shards", {}), resolver).items():
            out.read[name], out.paths[name] = file_reader(found)[0], found
    return out


def find_shards(path: str, shards: dict, resolver: Callable[[str, dict], str] | None = None) -> dict[str, str]:
    """The files of a table of shards, each of the size that the table gives."""
    out = {}
    for name, entry in shards.items():
        out[name] = found = (resolver or beside(path))(name, entry)
        if not os.path.isfile(found):
            raise NotFound(f"shard {name}: {found}")
        read, size = file_reader(found)
        _must(size == entry["size"], "ShardIdentity", name)
        frame_of(read, size)
    return out


def merged(sources: list[Source]) -> Source:
    """One namespace of several sources; a name in two of them is a collision, and the first file attributes win."""
    if not sources:
        raise InvalidInput("no sources")
    objects, read, paths = {}, {}, {}
    for k, s in enumerate(sources):
        for name, obj in s.objects.items():
            _must(name not in objects, "NameCollision", name)
            parts = {r: p | {"shard": f"{k}/{p.get('shard') or ''}"} for r, p in obj["parts"].items()}
            objects[name] = obj | {"parts": parts}
        read |= {f"{k}/{n or ''}": r for n, r in s.read.items()}
        paths |= {f"{k}/{n or ''}": p for n, p in s.paths.items()}
    attributes = next((s.attributes for s in sources if s.attributes is not None), None)
    out = Source({"objects": objects} | ({"attributes": attributes} if attributes is not None else {}), read, sources[0].vocabulary, None, paths)
    return out


def canonical_violations(read: Read, size: int) -> list[tuple[int, str]]:
    """(rule, detail) of what keeps a file from being canonical."""
    frame, m = manifest_of(read, size)
    if m is None:
        return [(1, "a data shard")]
    out: list[tuple[int, str]] = []
    if "shards" in m:
        out.append((6, "a shard table"))
    names = [n for n in m["objects"]] + [f"{n}/{r}" for n, o in m["objects"].items() for r in o["parts"]]
    out += [(5, n) for n in names if not unicodedata.is_normalized("NFC", n)]
    expected, seen, contents = CANONICAL, {}, {}
    for name, role, part in each_part(m):
        at, n = part["blob"]
        if "encoding" in part or not part.get("digest", "").startswith("xxh3:"):
            out.append((4, f"{name}/{role}"))
        if at % CANONICAL:
            out.append((2, f"{name}/{role} at {at}"))
        if n == 0:
            continue
        if at in seen:
            if seen[at] != n:
                out.append((3, f"{name}/{role}: different length"))
            continue
        seen[at] = n
        raw = read(at, n)
        if contents.setdefault(raw, at) != at:
            out.append((3, f"{name}/{role}: content at {contents[raw]}"))
        if at != expected:
            out.append((1, f"{name}/{role} at {at}, not {expected}"))
        expected = max(expected, -(-(at + n) // CANONICAL) * CANONICAL)
    at, n = frame.manifest
    if at != expected or at + n + FOOTER != size:
        out.append((1, "manifest or footer"))
    return out


# --- writing ----------------------------------------------------------------------------------------------------------------


@dataclass
class _Part:
    dtype: str
    data: bytes | None = None
    type: str | None = None
    encoding: str | None = None
    digest: str | None = "xxh3"
    external: tuple[str, int, int] | None = None
    made: dict = field(default_factory=dict)


def part(dtype: str, data: bytes | None = None, *, type: str | None = None, encoding: str | None = None, digest: str | None = "xxh3", external: tuple[str, int, int] | None = None) -> _Part:  # noqa: A002
    """A part from bytes, or from a range (shard, offset, length) of another file."""
    if dtype not in WIDTHS:
        raise InvalidInput(f"storage type {dtype}")
    if (data is None) == (external is None):
        raise InvalidInput("a part has one payload")
    return _Part(dtype, data, type, encoding, digest, external)


class Writer:
    """Writes a file beside its place and moves it there when it is finished.

    canonical: objects are added in name order at the canonical alignment, and equal content is stored once. append: new
    blobs, a new manifest and a new footer after those of an existing file, which stays a prefix."""

    def __init__(self, path: str, *, canonical: bool = True, align: int | None = None, vocabulary: Vocabulary | None = None, append: bool = False):
        if append and canonical:
            raise InvalidInput("an appended file isn't canonical")
        if align is not None and (align < FLOOR or align & (align - 1)):
            raise InvalidInput(f"alignment {align}")
        if canonical and align not in (None, CANONICAL):
            raise InvalidInput("canonical files have the canonical alignment")
        self.path, self.canonical, self.vocabulary = path, canonical, vocabulary or standard()
        self.partial = os.path.join(os.path.dirname(path) or ".", f".{os.path.basename(path)}.{os.getpid()}.partial")
        self.objects: dict = {}
        self.shards: dict = {}
        self.attributes: dict | None = None
        self.held: dict[tuple[int, bytes], int] = {}
        self.open: Sink | None = None
        self.last = ""
        if append:
            read, size = file_reader(path)
            frame, m = manifest_of(read, size)
            if m is None:
                raise InvalidInput("a data shard can't be appended to")
            self.objects, self.shards, self.attributes = m["objects"], m.get("shards", {}), m.get("attributes")
            self.align = align or inherited_alignment([p["blob"][0] for _, _, p in each_part(m) if "shard" not in p])
            with open(path, "rb") as old, open(self.partial, "wb") as new:
                while piece := old.read(1 << 20):
                    new.write(piece)
        else:
            self.align = align or CANONICAL
            with open(self.partial, "wb") as new:
                new.write(MAGIC)
        self.file = open(self.partial, "r+b")  # noqa: SIM115
        self.file.seek(0, os.SEEK_END)
        self.at = self.file.tell()

    # -- blobs
    def _place(self) -> int:
        at = max(-(-self.at // self.align) * self.align, self.align)
        self.file.seek(at)  # the gap is a hole: it reads as zeros, and takes no disk where the file system has holes
        self.at = at
        return at

    def _blob(self, data: bytes, share: bool) -> list[int]:
        key = (len(data), xxhash.xxh3_128_digest(data))
        if share and key in self.held and self._read(self.held[key], len(data)) == data:
            return [self.held[key], len(data)]
        at = self._place()
        self.file.write(data)
        self.at += len(data)
        if share and data:
            self.held.setdefault(key, at)
        return [at, len(data)]

    def _read(self, at: int, n: int) -> bytes:
        self.file.flush()
        return os.pread(self.file.fileno(), n, at)

    # -- objects
    def _check(self, name: str, layout: str, shape: list[int], parts: dict[str, dict], attributes: dict | None) -> dict:
        check_name(name)
        if self.open is not None:
            raise InvalidInput("a stream is open")
        if name in self.objects:
            raise InvalidInput(f"{name} is there already")
        if self.canonical and self.objects and name.encode() < self.last.encode():
            raise InvalidInput(f"{name} comes after {self.last}; canonical files are written in name order")
        if self.canonical and not all(unicodedata.is_normalized("NFC", n) for n in (name, *parts)):
            raise InvalidInput(f"{name} isn't in normal form")
        obj = {"shape": list(shape), "layout": layout, "parts": parts} | ({"attributes": attributes} if attributes is not None else {})
        check_schema({"objects": {name: obj}})
        _must(len(shape) <= MAX_RANK and product(list(shape)) is not None, "Shape", name)
        for p in parts.values():
            kind = self.vocabulary.logical(p["type"]) if "type" in p else None
            _must(kind is None or kind.dtype == p["dtype"], "Schema", f"{name}: {p.get('type')} on {p['dtype']}")
        if (rule := self.vocabulary.layout(layout)) is not None:
            rule(name, obj, self.vocabulary)
        return obj

    def add(self, name: str, shape, dtype: str, data: bytes, **more) -> None:
        """A dense tensor."""
        self.object(name, shape, "dense", {"data": part(dtype, bytes(data), **more)})

    def object(self, name: str, shape, layout: str, parts: dict[str, _Part], attributes: dict | None = None) -> None:
        """Checks everything that can be before a byte is written."""
        stored: dict[str, bytes] = {}
        made: dict[str, dict] = {}
        for role, p in parts.items():
            out: dict = {"dtype": p.dtype, "blob": [0, 0]}
            if p.type is not None:
                out["type"] = p.type
            if p.external is not None:
                shard, at, n = p.external
                _must(shard in self.shards, "ShardRef", shard)
                _must(at >= FLOOR and at % FLOOR == 0, "BlobAlignment", str(at))
                _must(at + n <= self.shards[shard]["size"] - FOOTER, "BlobBounds", shard)
                if self.canonical:
                    raise InvalidInput("canonical files are single")
                out |= {"blob": [at, n], "shard": shard}
            else:
                stored[role] = p.data
                if p.encoding is not None:
                    if self.canonical:
                        raise InvalidInput("canonical files aren't encoded")
                    if (encoding := self.vocabulary.encoding(p.encoding)) is None:
                        raise Unsupported(f"encoding {p.encoding}")
                    stored[role] = encoding.encode(p.data)
                    out |= {"encoding": p.encoding, "decoded_length": len(p.data)}
                out["blob"] = [0, len(stored[role])]
                algorithm = "xxh3" if self.canonical else p.digest
                if algorithm:
                    out["digest"] = digest_of(p.data, algorithm)
            made[role] = out
        obj = self._check(name, layout, shape, made, attributes)
        for role in sorted(stored, key=str.encode):
            made[role]["blob"] = self._blob(stored[role], "encoding" not in made[role])
        self.objects[name] = obj
        self.last = name

    def stream(self, name: str, shape, dtype: str, length: int, type: str | None = None, digest: str = "xxh3") -> Sink:  # noqa: A002
        """A dense tensor of a declared length that is written in pieces; nothing else may be written until it is closed."""
        made = {"data": {"dtype": dtype, "blob": [0, length]} | ({"type": type} if type else {})}
        obj = self._check(name, "dense", shape, made, None)
        self.open = Sink(self, name, obj, length, digest)
        return self.open

    # -- other files
    def add_shard(self, name: str, size: int, digest: str) -> None:
        if self.canonical:
            raise InvalidInput("canonical files are single")
        _must(_SHARD.match(name) is not None, "ShardName", name)
        check_digest(digest)
        entry = {"size": size, "digest": digest}
        if self.shards.setdefault(name, entry) != entry:
            raise InvalidInput(f"shard {name} has another identity")

    def link(self, source: Source, name: str, shard: str) -> None:
        """An object of another file by reference."""
        obj = source.tensor(name)
        parts = {r: p | {"shard": p.get("shard") or shard} for r, p in obj["parts"].items()}
        _must(all(p["shard"] in self.shards for p in parts.values()), "ShardRef", shard)
        self.objects[name] = self._check(name, obj["layout"], obj["shape"], parts, obj.get("attributes"))
        self.last = name

    def ingest(self, source) -> None:
        """All objects of a source, decoded, in name order."""
        if getattr(source, "attributes", None) and self.attributes is None:
            self.attributes = source.attributes
        for name in source.names():
            obj = source.tensor(name)
            parts = {r: part(p["dtype"], source.bytes(name, r), type=p.get("type")) for r, p in obj["parts"].items()}
            self.object(name, obj["shape"], obj["layout"], parts, obj.get("attributes"))

    def set_attributes(self, attributes: dict) -> None:
        check_attributes(attributes)
        self.attributes = attributes

    def finish(self) -> None:
        if self.open is not None:
            raise InvalidInput(f"the stream {self.open.name} isn't closed")
        self.finish_with(len(self.objects), iter(sorted(cbor.encode(name, 2) + cbor.encode(obj, 2) for name, obj in self.objects.items())))

    def finish_with(self, count: int, objects: Iterator[bytes]) -> None:
        """With the encoded objects that the manifest is to have, keys and values, in the order of their keys."""
        more = {"attributes": self.attributes} if self.attributes is not None else {}
        if self.shards:
            more["shards"] = self.shards
        at, check, n = self._place(), xxhash.xxh3_64(), 0

        def pieces() -> Iterator[bytes]:
            yield cbor.map_head(1 + len(more))
            for key in sorted(("objects", *more), key=cbor.encode):
                yield cbor.encode(key)
                if key == "objects":
                    yield cbor.map_head(count)
                    yield from objects
                else:
                    yield cbor.encode(more[key], 1)

        for piece in pieces():
            n += len(piece)
            _must(n <= MAX_MANIFEST, "ManifestTooLarge", str(n))
            self.file.write(piece)
            check.update(piece)
        self.file.write(struct.pack("<QQQII8s", at, n, check.intdigest(), VERSION, 0, MAGIC))
        self._publish()

    def finish_shard(self) -> None:
        """A data shard: blobs without a manifest."""
        self.file.write(struct.pack("<QQQII8s", 0, 0, 0, VERSION, 0, MAGIC))
        self._publish()

    def _publish(self) -> None:
        self.file.flush()
        os.fsync(self.file.fileno())
        self.file.close()
        os.replace(self.partial, self.path)

    def abandon(self) -> None:
        if not self.file.closed:
            self.file.close()
        if os.path.exists(self.partial):
            os.remove(self.partial)

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and not self.file.closed:
            self.finish()
        else:
            self.abandon()


class Sink:
    def __init__(self, writer: Writer, name: str, obj: dict, length: int, algorithm: str):
        self.writer, self.name, self.obj, self.length, self.written = writer, name, obj, length, 0
        self.algorithm, self.hash = algorithm, hasher(algorithm)
        self.at = writer._place()

    def write(self, piece: bytes) -> None:
        if self.writer.open is not self:
            raise InvalidInput("this stream is closed")
        if self.written + len(piece) > self.length:
            raise InvalidInput(f"{self.name}: more than the declared {self.length} bytes")
        self.writer.file.write(piece)
        self.writer.at += len(piece)
        self.written += len(piece)
        self.hash.update(piece)

    def close(self) -> None:
        if self.writer.open is not self:
            raise InvalidInput("this stream is closed")
        if self.written != self.length:
            raise InvalidInput(f"{self.name}: {self.written} of {self.length} bytes")
        self.obj["parts"]["data"] |= {"blob": [self.at, self.length], "digest": f"{self.algorithm}:{self.hash.hexdigest()}"}
        self.writer.objects[self.name], self.writer.last, self.writer.open = self.obj, self.name, None


def inherited_alignment(offsets: list[int]) -> int:
    """The power of two that all offsets share, between the floor and the canonical alignment."""
    bits = 0
    for o in offsets:
        bits |= o
    return min(max(bits & -bits, FLOOR), CANONICAL) if bits else CANONICAL


def convert(source, path: str, align: int | None = None) -> None:
    """Any source as a native file."""
    with Writer(path, canonical=align in (None, CANONICAL), align=align) as w:
        w.ingest(source)
