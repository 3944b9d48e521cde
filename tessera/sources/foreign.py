"""Importers of other tensor formats: they read, never execute, and refuse what they can't read rightly."""

from __future__ import annotations

import ast
import json
import math
import os
import pickletools
import re
import struct
import zipfile
import zlib
from collections.abc import Callable

import numpy as np

from ..model import U64_MAX, WIDTHS, InvalidInput, Unsupported
from . import container
from .container import Read, Source, file_reader
from .vocabulary import product, standard

FORMATS = ("zt", "safetensors", "gguf", "npz", "pt", "onnx", "hdf5")

#: Headers, archives' members and chunks beyond these are refused.
MAX_HEADER = 100 << 20
MAX_ALLOC = 1 << 30
MAX_PICKLE = 256 << 20
MAX_OPCODES = 50_000_000
MAX_ITEMS = 1_000_000
MAX_DEPTH = 128

# Each format's names of storage types, with the logical type where there is one.
SAFETENSORS = {"F64": "f64", "F32": "f32", "F16": "f16", "BF16": "bf16", "I64": "i64", "I32": "i32", "I16": "i16", "I8": "i8", "U64": "u64", "U32": "u32", "U16": "u16", "U8": "u8", "BOOL": ("u8", "bool"), "F8_E4M3": ("u8", "f8_e4m3fn"), "F8_E5M2": ("u8", "f8_e5m2"), "F4_E2M1": ("u8", "f4_e2m1"), "F8_E8M0": ("u8", "f8_e8m0")}
NUMPY = {"f8": "f64", "f4": "f32", "f2": "f16", "i8": "i64", "i4": "i32", "i2": "i16", "i1": "i8", "u8": "u64", "u4": "u32", "u2": "u16", "u1": "u8", "b1": ("u8", "bool")}
TORCH = {"DoubleStorage": "f64", "FloatStorage": "f32", "HalfStorage": "f16", "BFloat16Storage": "bf16", "LongStorage": "i64", "IntStorage": "i32", "ShortStorage": "i16", "CharStorage": "i8", "ByteStorage": "u8", "BoolStorage": ("u8", "bool"), "Float8_e4m3fnStorage": ("u8", "f8_e4m3fn"), "Float8_e5m2Storage": ("u8", "f8_e5m2")}
ONNX = {1: "f32", 2: "u8", 3: "i8", 4: "u16", 5: "i16", 6: "i32", 7: "i64", 9: ("u8", "bool"), 10: "f16", 11: "f64", 12: "u32", 13: "u64", 16: "bf16", 17: ("u8", "f8_e4m3fn"), 18: ("u8", "f8_e4m3fnuz"), 19: ("u8", "f8_e5m2"), 20: ("u8", "f8_e5m2fnuz")}
# Tensor types of GGUF by number: elements and bytes of a block, and the name.
GGUF = {
    0: (1, 4, "f32"), 1: (1, 2, "f16"), 2: (32, 18, "q4_0"), 3: (32, 20, "q4_1"), 6: (32, 22, "q5_0"), 7: (32, 24, "q5_1"),
    8: (32, 34, "q8_0"), 9: (32, 36, "q8_1"), 10: (256, 84, "q2_k"), 11: (256, 110, "q3_k"), 12: (256, 144, "q4_k"),
    13: (256, 176, "q5_k"), 14: (256, 210, "q6_k"), 15: (256, 292, "q8_k"), 16: (256, 66, "iq2_xxs"), 17: (256, 74, "iq2_xs"),
    18: (256, 98, "iq3_xxs"), 19: (256, 50, "iq1_s"), 20: (32, 18, "iq4_nl"), 21: (256, 110, "iq3_s"), 22: (256, 82, "iq2_s"),
    23: (256, 136, "iq4_xs"), 24: (1, 1, "i8"), 25: (1, 2, "i16"), 26: (1, 4, "i32"), 27: (1, 8, "i64"), 28: (1, 8, "f64"),
    29: (256, 56, "iq1_m"), 30: (1, 2, "bf16"), 39: (32, 17, "mxfp4"),
}


def _type(table: dict, key, what: str) -> dict:
    got = table.get(key)
    if got is None:
        raise Unsupported(f"{what} {key!r}")
    return {"dtype": got} if isinstance(got, str) else {"dtype": got[0], "type": got[1]}


def _elements(shape: list[int], what: str) -> int:
    n = product(shape)
    if n is None:
        raise InvalidInput(f"{what}: the shape overflows")
    return n


class Foreign(Source):
    """Tensors of another format. Parts lie at a place in the file, or are decoded by a function when they are read."""

    def __init__(self, path: str, form: str, attributes: dict | None = None):
        read, self.size = file_reader(path)
        super().__init__({"objects": {}} | ({"attributes": attributes} if attributes else {}), {None: read}, standard(), None, {None: path})
        self.form, self.decoders = form, {}

    def put(self, name: str, shape: list[int], kind: dict, at: int | None, length: int, decoder: Callable[[], bytes] | None = None, layout: str = "dense", attributes: dict | None = None) -> None:
        if name in self.objects:
            raise InvalidInput(f"{self.form}: {name!r} is there twice")
        if at is not None and at + length > self.size:
            raise InvalidInput(f"{self.form}: {name!r} ends beyond the file")
        part = kind | {"blob": [at if at is not None else 0, length]}
        if decoder is not None:
            self.decoders[name] = decoder
        self.objects[name] = {"shape": shape, "layout": layout, "parts": {"data": part}} | ({"attributes": attributes} if attributes else {})

    def payload(self, name: str) -> str:
        return "Opaque" if name in self.decoders else "At"

    def stored(self, part: dict) -> bytes:
        return super().stored(part)

    def bytes(self, name: str, role: str | None = None) -> bytes:
        part = self.part(name, role)
        if name not in self.decoders:
            return self.stored(part)
        out = self.decoders[name]()
        if len(out) != part["blob"][1]:
            raise InvalidInput(f"{self.form}: {name!r} has {len(out)} bytes, not {part['blob'][1]}")
        return out

    def locate(self, name: str, role: str | None = None):
        if name in self.decoders:
            raise Unsupported(f"{name!r} has no address")
        return super().locate(name, role)

    def verify(self, name: str, role: str | None = None) -> str:
        obj, part = self.tensor(name), self.part(name, role)
        self.vocabulary.check_values(part, self.bytes(name, role), product(obj["shape"]) if obj["layout"] == "dense" else None)
        return "no_digest"


def _dense(out: Foreign, name: str, shape: list[int], kind: dict, at: int | None, decoder=None, given: int | None = None) -> None:
    length = out.vocabulary.size_of(kind, _elements(shape, name))
    if given is not None and given != length:
        raise InvalidInput(f"{out.form}: {name!r} has {given} bytes, its shape needs {length}")
    out.put(name, shape, kind, at, length, decoder)


# --- safetensors ------------------------------------------------------------------------------------------------------------


def safetensors(path: str) -> Foreign:
    """A JSON header, then data that the tensors tile without gap or overlap."""
    read, size = file_reader(path)
    n = int.from_bytes(read(0, 8), "little")
    if size < 8 or n > MAX_HEADER or 8 + n > size:
        raise InvalidInput("safetensors: header length")

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise InvalidInput("safetensors: a key is there twice")
        return dict(pairs)

    try:
        header = json.loads(read(8, n), object_pairs_hook=once)
    except (ValueError, RecursionError) as e:
        raise InvalidInput(f"safetensors: {e}") from e
    if not isinstance(header, dict):
        raise InvalidInput("safetensors: the header isn't a map")
    out = Foreign(path, "safetensors", header.pop("__metadata__", None))
    rows = []
    for name, info in header.items():
        if not isinstance(info, dict) or not isinstance(info.get("shape"), list) or not isinstance(info.get("data_offsets"), list) or len(info["data_offsets"]) != 2 or not all(isinstance(x, int) and 0 <= x <= U64_MAX for x in [*info["shape"], *info["data_offsets"]]):
            raise InvalidInput(f"safetensors: {name!r}")
        rows.append((*info["data_offsets"], name, info))
    end = 0
    for a, b, name, info in sorted(rows, key=lambda r: r[:2]):
        if a != end or b < a:
            raise InvalidInput(f"safetensors: {name!r} begins at {a}, not {end}")
        _dense(out, name, info["shape"], _type(SAFETENSORS, info.get("dtype"), "safetensors type"), 8 + n + a, given=b - a)
        end = b
    if 8 + n + end != size:
        raise InvalidInput("safetensors: bytes that no tensor has")
    return out


# --- GGUF -------------------------------------------------------------------------------------------------------------------


class _More(Exception):
    """The window ends before the header does."""


class _Window:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise _More
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str):
        return struct.unpack("<" + form, self.take(struct.calcsize(form)))[0]

    def text(self) -> str:
        return self.take(self.number("Q")).decode("utf-8")

    # the 13 kinds of values: eleven of fixed size, text, and arrays
    _FORMS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 10: "Q", 11: "q", 12: "d"}

    def value(self, kind: int, depth: int = 0):
        if depth > 32:
            raise InvalidInput("gguf: nested too deeply")
        if kind in self._FORMS:
            return self.number(self._FORMS[kind])
        if kind == 7:
            return self.number("B") != 0
        if kind == 8:
            return self.text()
        if kind == 9:
            inner, n = self.number("I"), self.number("Q")
            if n > len(self.data) - self.at:  # every value has a byte at least
                raise _More
            return [self.value(inner, depth + 1) for _ in range(n)]
        raise InvalidInput(f"gguf: value type {kind}")


def gguf(path: str) -> Foreign:
    """Key-values, tensor infos, then aligned data; the header is read in windows that grow fourfold."""
    read, size = file_reader(path)
    window = min(1 << 20, size)
    while True:
        try:
            return _gguf(path, read(0, window), size)
        except _More:
            if window >= size:
                raise InvalidInput("gguf: the file ends early") from None
            window = min(4 * window, size)
        except UnicodeDecodeError as e:
            raise InvalidInput(f"gguf: {e}") from e


def _gguf(path: str, data: bytes, size: int) -> Foreign:
    w = _Window(data)
    if w.take(4) != b"GGUF":
        raise InvalidInput("gguf: signature")
    if (version := w.number("I")) not in (2, 3):
        raise Unsupported(f"gguf version {version}")
    tensors, pairs = w.number("Q"), w.number("Q")
    if max(tensors, pairs) > size:
        raise InvalidInput("gguf: more entries than bytes")
    attributes = {}
    for _ in range(pairs):
        key = w.text()
        attributes[key] = w.value(w.number("I"))
    alignment = attributes.get("general.alignment", 32)
    if not isinstance(alignment, int) or isinstance(alignment, bool) or alignment < 1 or alignment & (alignment - 1):
        raise InvalidInput("gguf: general.alignment")
    infos = []
    for _ in range(tensors):
        name, rank = w.text(), w.number("I")
        if rank > 64:
            raise InvalidInput(f"gguf: {name!r} has {rank} dimensions")
        shape = [w.number("Q") for _ in range(rank)][::-1]  # stored with the fastest dimension first
        infos.append((name, shape, w.number("I"), w.number("Q")))
    start = -(-w.at // alignment) * alignment
    if start > size:
        raise InvalidInput("gguf: the data begins beyond the file")
    out = Foreign(path, "gguf", attributes)
    ranges = []
    for name, shape, kind, at in infos:
        if kind not in GGUF:
            raise Unsupported(f"gguf tensor type {kind}")
        per, block, label = GGUF[kind]
        if (shape[-1] if shape else 1) % per:
            raise InvalidInput(f"gguf: {name!r} doesn't divide into blocks of {per}")
        length = _elements(shape, name) // per * block
        if label in WIDTHS:
            out.put(name, shape, {"dtype": label}, start + at, length)
        else:
            out.put(name, shape, {"dtype": "u8"}, start + at, length, layout=f"gguf.{label}/1", attributes={"elems_per_block": per, "block_bytes": block})
        if length:
            ranges.append((start + at, length))
    end = start
    for at, length in sorted(set(ranges)):
        if at < end:
            raise InvalidInput("gguf: tensors overlap")
        end = at + length
    return out


# --- archives ---------------------------------------------------------------------------------------------------------------


def _archive(path: str, form: str) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(path)
    except (zipfile.BadZipFile, OSError, ValueError) as e:
        raise InvalidInput(f"{form}: {e}") from e


def _member_start(read: Read, info: zipfile.ZipInfo) -> int:
    head = read(info.header_offset, 30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise InvalidInput(f"{info.filename}: local header")
    return info.header_offset + 30 + sum(struct.unpack("<HH", head[26:30]))


def _member(read: Read, info: zipfile.ZipInfo, cap: int = MAX_ALLOC) -> bytes:
    """A member's bytes, never more than it declares."""
    if info.file_size > cap:
        raise InvalidInput(f"{info.filename}: {info.file_size} bytes")
    raw = read(_member_start(read, info), info.compress_size)
    if info.compress_type == zipfile.ZIP_STORED:
        out = raw
    elif info.compress_type == zipfile.ZIP_DEFLATED:
        try:
            out = zlib.decompressobj(-15).decompress(raw, info.file_size + 1)
        except zlib.error as e:
            raise InvalidInput(f"{info.filename}: {e}") from e
    else:
        raise Unsupported(f"{info.filename}: compression {info.compress_type}")
    if len(out) != info.file_size or zlib.crc32(out) != info.CRC:
        raise InvalidInput(f"{info.filename}: size or checksum")
    return out


_DESCR = re.compile(r"[<=|>]?([fiub][1248])\Z")


def _npy_header(raw: bytes, name: str) -> tuple[int, list[int], dict]:
    """Where the data starts, the shape and the type."""
    if raw[:6] != b"\x93NUMPY" or len(raw) < 10:
        raise InvalidInput(f"npz: {name!r} isn't an array")
    wide = raw[6] >= 2
    n = int.from_bytes(raw[8 : 12 if wide else 10], "little")
    start = (12 if wide else 10) + n
    if start > len(raw):
        raise InvalidInput(f"npz: {name!r} header")
    try:
        header = ast.literal_eval(raw[12 if wide else 10 : start].decode("latin-1").strip())
        descr, fortran, shape = header["descr"], header["fortran_order"], list(header["shape"])
    except (ValueError, SyntaxError, KeyError, TypeError, RecursionError, MemoryError) as e:
        raise InvalidInput(f"npz: {name!r} header") from e
    if not isinstance(descr, str) or descr.startswith(">") or not (m := _DESCR.match(descr)):
        raise Unsupported(f"npz type {descr!r}")
    if fortran:
        raise Unsupported(f"npz: {name!r} is in column order")
    if not all(isinstance(x, int) and x >= 0 for x in shape):
        raise InvalidInput(f"npz: {name!r} shape")
    return start, shape, _type(NUMPY, m[1], "npz type")


def npz(path: str) -> Foreign:
    """Stored arrays lie in the file; deflated ones are inflated when they are read."""
    out = Foreign(path, "npz")
    read = out.read[None]
    with _archive(path, "npz") as z:
        for info in z.infolist():
            if not info.filename.endswith(".npy"):
                continue
            name = info.filename[:-4]
            if info.compress_type == zipfile.ZIP_STORED:
                at = _member_start(read, info)
                start, shape, kind = _npy_header(read(at, min(info.file_size, 1 << 16)), name)
                _dense(out, name, shape, kind, at + start, given=info.file_size - start)
            else:
                start, shape, kind = _npy_header(_member(read, info), name)
                _dense(out, name, shape, kind, None, lambda info=info, start=start: _member(read, info)[start:], info.file_size - start)
    return out


# --- PyTorch ----------------------------------------------------------------------------------------------------------------


class _Storage:
    def __init__(self, key: str, kind: dict):
        self.key, self.kind = key, kind


class _Tensor:
    def __init__(self, storage: _Storage, at: int, shape: list[int]):
        self.storage, self.at, self.shape = storage, at, shape


class _Global(str):
    pass


class _Unknown:
    """What a pickle makes that isn't looked into."""


_MARK = object()


def _unpickled(data: bytes) -> list:
    """The values that a pickle builds, by a machine that knows dictionaries, lists, tuples, and tensors' constructors only;
    nothing is imported or called, and memoised containers are opaque, so that their reuse can't multiply."""
    stack: list = []
    memo: dict[int, object] = {}
    unknown = _Unknown()

    def to_mark() -> list:
        items = []
        while stack:
            if (x := stack.pop()) is _MARK:
                break
            items.append(x)
        return items[::-1]

    def pop():
        return stack.pop() if stack and stack[-1] is not _MARK else unknown

    def add(target, items: list, pairs: bool) -> None:
        if pairs and isinstance(target, dict):
            for k, v in zip(items[::2], items[1::2], strict=False):
                if isinstance(k, (str, int)):
                    target[k] = v
        elif not pairs and isinstance(target, list):
            target.extend(items)
        if isinstance(target, (dict, list)) and len(target) > MAX_ITEMS:
            raise InvalidInput("pt: a container is too large")

    def made(what, args):
        if what == "collections OrderedDict":
            return {}
        if isinstance(what, _Global) and what.startswith("torch._utils _rebuild_tensor") and isinstance(args, tuple) and len(args) >= 4:
            storage, at, shape, stride = args[:4]
            if not isinstance(storage, _Storage) or not isinstance(at, int) or at < 0 or not all(isinstance(d, tuple) and all(isinstance(x, int) and x >= 0 for x in d) for d in (shape, stride)):
                return unknown
            step = 1
            for n, s in zip(reversed(shape), reversed(stride), strict=False):
                if n > 1 and s != step:
                    raise Unsupported(f"pt: a tensor of shape {shape} and stride {stride} isn't contiguous")
                step *= max(n, 1)
            return _Tensor(storage, at * WIDTHS[storage.kind["dtype"]], list(shape))
        return unknown

    def kept(x):
        return x if isinstance(x, (int, float, str, _Storage, type(None))) and not (isinstance(x, str) and len(x) > 4096) else unknown

    try:
        for n, (op, arg, _) in enumerate(pickletools.genops(data)):
            if n > MAX_OPCODES or len(stack) > 10_000_000:
                raise InvalidInput("pt: the pickle is too long")
            name = op.name
            if name in ("PROTO", "FRAME", "READONLY_BUFFER"):
                continue
            if name == "STOP":
                break
            if name == "MARK":
                stack.append(_MARK)
            elif name in ("NONE", "NEWTRUE", "NEWFALSE"):
                stack.append({"NONE": None, "NEWTRUE": True, "NEWFALSE": False}[name])
            elif name in ("EMPTY_DICT", "EMPTY_LIST", "EMPTY_TUPLE"):
                stack.append({"EMPTY_DICT": dict, "EMPTY_LIST": list, "EMPTY_TUPLE": tuple}[name]())
            elif name in ("EMPTY_SET", "NEXT_BUFFER"):
                stack.append(unknown)
            elif name == "GLOBAL":
                stack.append(_Global(arg))
            elif name == "STACK_GLOBAL":
                attribute, module = pop(), pop()
                stack.append(_Global(f"{module} {attribute}") if isinstance(attribute, str) and isinstance(module, str) else unknown)
            elif name in ("TUPLE1", "TUPLE2", "TUPLE3"):
                items = [pop() for _ in range(int(name[-1]))]
                stack.append(tuple(items[::-1]))
            elif name in ("TUPLE", "FROZENSET"):
                stack.append(tuple(to_mark()))
            elif name == "LIST":
                stack.append(to_mark())
            elif name == "DICT":
                target: dict = {}
                add(target, to_mark(), True)
                stack.append(target)
            elif name in ("SETITEM", "SETITEMS", "APPEND", "APPENDS", "ADDITEMS"):
                if name in ("SETITEM", "APPEND"):
                    items = [pop() for _ in range(2 if name == "SETITEM" else 1)][::-1]
                else:
                    items = to_mark()
                if stack:
                    add(stack[-1], items, name.startswith("SET"))
            elif name in ("REDUCE", "NEWOBJ", "NEWOBJ_EX"):
                if name == "NEWOBJ_EX":
                    pop()
                args = pop()
                stack.append(made(pop(), args))
            elif name == "BUILD":
                state = pop()
                if stack and isinstance(stack[-1], _Unknown) and isinstance(state, dict):
                    stack[-1] = state
            elif name == "BINPERSID":
                pid, value = pop(), unknown
                if isinstance(pid, tuple) and len(pid) >= 5 and pid[0] == "storage" and isinstance(pid[1], _Global) and isinstance(pid[2], str) and isinstance(pid[4], int) and pid[4] >= 0:
                    kind = pid[1].split(" ")[-1]
                    value = _Storage(pid[2], _type(TORCH, kind, "pt storage"))
                stack.append(value)
            elif name in ("PUT", "BINPUT", "LONG_BINPUT", "MEMOIZE"):
                if stack:
                    memo[len(memo) if name == "MEMOIZE" else int(arg)] = kept(stack[-1])
            elif name in ("GET", "BINGET", "LONG_BINGET"):
                stack.append(memo.get(int(arg)))
            elif name == "POP":
                pop()
            elif name == "POP_MARK":
                to_mark()
            elif op.arg is not None and op.stack_after and not op.stack_before:
                stack.append(arg)  # numbers, texts, bytes
            else:
                raise InvalidInput(f"pt: opcode {name}")
    except (ValueError, IndexError, struct.error, UnicodeDecodeError, OverflowError) as e:
        if isinstance(e, (InvalidInput, Unsupported)):
            raise
        raise InvalidInput(f"pt: {e}") from e
    return stack


def _tensors(prefix: str, value, found: dict[str, _Tensor], depth: int) -> None:
    if depth > MAX_DEPTH:
        raise InvalidInput("pt: nested too deeply")
    if isinstance(value, _Tensor):
        found[prefix or "tensor"] = value
    elif isinstance(value, dict):
        for k, v in value.items():
            _tensors(f"{prefix}.{k}" if prefix else str(k), v, found, depth + 1)
    elif isinstance(value, (list, tuple)):
        for k, v in enumerate(value):
            _tensors(f"{prefix}.{k}" if prefix else str(k), v, found, depth + 1)


def pt(path: str) -> Foreign:
    """Tensors found in a checkpoint's pickle; stored storages lie in the file, compressed ones are kept whole once read."""
    out = Foreign(path, "pt")
    read = out.read[None]
    with _archive(path, "pt") as z:
        members = {i.filename: i for i in z.infolist()}
        pickle = next((n for n in members if n.endswith("data.pkl")), None)
        if pickle is None:
            raise InvalidInput("pt: no data.pkl")
        found: dict[str, _Tensor] = {}
        for value in _unpickled(_member(read, members[pickle], MAX_PICKLE)):
            _tensors("", value, found, 0)
    if not found:
        raise InvalidInput("pt: no tensors")
    cache: dict[str, bytes] = {}

    def whole(info: zipfile.ZipInfo) -> bytes:
        if info.filename not in cache:
            cache.clear()
            cache[info.filename] = _member(read, info)
        return cache[info.filename]

    folder = pickle[: -len("data.pkl")] + "data/"
    for name, t in found.items():
        info = members.get(folder + t.storage.key)
        if info is None:
            raise InvalidInput(f"pt: storage {t.storage.key} is missing")
        length = out.vocabulary.size_of(t.storage.kind, _elements(t.shape, name))
        if t.at + length > info.file_size:
            raise InvalidInput(f"pt: {name!r} ends beyond its storage")
        if info.compress_type == zipfile.ZIP_STORED:
            out.put(name, t.shape, t.storage.kind, _member_start(read, info) + t.at, length)
        else:
            out.put(name, t.shape, t.storage.kind, None, length, lambda info=info, a=t.at, n=length: whole(info)[a : a + n])
    return out


# --- ONNX -------------------------------------------------------------------------------------------------------------------


def _fields(data: memoryview, at: int, end: int):
    """(field, wire type, value or (start, end)) of a message."""

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            if at >= end or shift > 63:
                raise InvalidInput("onnx: a number is cut off")
            b = data[at]
            n |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return n & U64_MAX, at

    while at < end:
        tag, at = varint(at)
        wire = tag & 7
        if wire == 0:
            n, at = varint(at)
            yield tag >> 3, wire, n
            continue
        size = {1: 8, 5: 4}.get(wire)
        if wire == 2:
            size, at = varint(at)
        if size is None or at + size > end:
            raise InvalidInput("onnx: a field is cut off")
        yield tag >> 3, wire, (at, at + size)
        at += size


def _varints(data: memoryview, span: tuple[int, int]) -> list[int]:
    out, n, shift = [], 0, 0
    for b in data[span[0] : span[1]]:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n & U64_MAX)
            n = shift = 0
    if shift:
        raise InvalidInput("onnx: a number is cut off")
    return out


def onnx(path: str) -> Foreign:
    """Initializers of the graph; raw data lies in the file, typed fields are converted."""
    out = Foreign(path, "onnx")
    data = memoryview(out.read[None](0, out.size))
    for field, wire, graph in _fields(data, 0, len(data)):
        if (field, wire) != (7, 2):
            continue
        for inner, kind, span in _fields(data, *graph):
            if (inner, kind) == (5, 2):
                _onnx_tensor(out, data, span)
    if not out.objects:
        raise InvalidInput("onnx: no initializers")
    return out


def _onnx_tensor(out: Foreign, data: memoryview, span: tuple[int, int]) -> None:
    name, shape, kind, raw, external = "", [], 0, None, False
    ints: dict[int, list[int]] = {5: [], 7: [], 11: []}
    floats: dict[int, bytes] = {4: b"", 10: b""}
    for field, wire, v in _fields(data, *span):
        if field == 1:
            shape += [v] if wire == 0 else _varints(data, v)
        elif field == 2 and wire == 0:
            kind = v
        elif field in ints:
            ints[field] += [v] if wire == 0 else _varints(data, v)
        elif field in floats and wire != 0:  # packed, or one value at a time
            floats[field] += bytes(data[v[0] : v[1]])
        elif field == 8 and wire == 2:
            try:
                name = bytes(data[v[0] : v[1]]).decode()
            except UnicodeDecodeError as e:
                raise InvalidInput("onnx: a name isn't UTF-8") from e
        elif field == 9 and wire == 2:
            raw = v
        elif field == 13 or field == 14 and v == 1:
            external = True
    if external:
        raise Unsupported(f"onnx: {name!r} has external data")
    typed = _type(ONNX, kind, "onnx data type")
    given = [x for x in (*ints.values(), *floats.values()) if x]
    if raw is not None:
        if given:
            raise InvalidInput(f"onnx: {name!r} has two kinds of data")
        _dense(out, name, shape, typed, raw[0], given=raw[1] - raw[0])
        return
    width = WIDTHS[typed["dtype"]]
    made = floats[4] or floats[10] or b"".join((n & (1 << 8 * width) - 1).to_bytes(width, "little") for n in ints[5] or ints[7] or ints[11])
    _dense(out, name, shape, typed, None, lambda: made, len(made))


# --- detection --------------------------------------------------------------------------------------------------------------


def detect(path: str) -> str:
    """The format of a file by its first bytes; ZIP archives by their members; only ONNX by its extension."""
    with open(path, "rb") as f:
        head = f.read(9)
    if head[:8] == container.MAGIC:
        return "zt"
    if head[:4] == b"GGUF":
        return "gguf"
    if head[:8] == b"\x89HDF\r\n\x1a\n":
        return "hdf5"
    if head[:4] == b"PK\x03\x04":
        try:
            with zipfile.ZipFile(path) as z:
                return "pt" if any(n.endswith("data.pkl") for n in z.namelist()) else "npz"
        except zipfile.BadZipFile:
            return "npz"
    if head[8:9] == b"{" and 0 < int.from_bytes(head[:8], "little") < MAX_HEADER:
        return "safetensors"
    if os.path.splitext(path)[1] == ".onnx":
        return "onnx"
    raise Unsupported(f"the format of {path} isn't known")


def open_any(path: str, **options) -> Source:
    """A file of any readable format."""
    form = detect(path)
    if form == "zt":
        return container.open_file(path, **options)
    if form == "hdf5":
        from .hdf5 import hdf5

        return hdf5(path)
    return {"safetensors": safetensors, "gguf": gguf, "npz": npz, "pt": pt, "onnx": onnx}[form](path)


def open_all(paths: list[str]) -> Source:
    """Several files as one namespace."""
    return container.merged([open_any(p) for p in paths])


def as_array(source: Source, name: str) -> np.ndarray:
    """A dense tensor as an array; types that numpy lacks come as raw bytes with a last dimension, or as unsigned numbers."""
    obj, part = source.tensor(name), source.part(name, "data")
    plain = {"f64": "<f8", "f32": "<f4", "f16": "<f2", "bf16": "<u2", "i64": "<i8", "i32": "<i4", "i16": "<i2", "i8": "i1", "u64": "<u8", "u32": "<u4", "u16": "<u2", "u8": "u1"}
    raw = source.bytes(name, "data")
    kind = part.get("type")
    if kind == "bool":
        return np.frombuffer(raw, np.bool_).reshape(obj["shape"])
    if kind in ("complex64", "complex128"):
        return np.frombuffer(raw, kind).reshape(obj["shape"])
    got = np.frombuffer(raw, plain[part["dtype"]])
    return got.reshape(obj["shape"]) if math.prod(obj["shape"]) == len(got) else got
