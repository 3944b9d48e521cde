"""BPE encoding and decoding with content-defined chunk reuse.

A document is cut into chunks where a rolling hash of the last eight bytes has `chunk_bits` zero bits, so that documents which
share a passage share its chunks wherever it stands. A worker encodes each distinct chunk once, by itself, and keeps the ids of
its segments (a segment starts at a space after a character that is not white space, both of the chunk). What lies before a
chunk's first segment and after its last depends on its neighbours: at each join, that is encoded again together with the
nearest whole segment on either side. If the ids come out as those segments have them, both encodings agree there and the join
is repaired; if not, the window takes in twice as many segments, and so on until both ends agree or a side has no more. A chunk
without whole segments is part of the join. Beneath, the segments' ids are kept in a pool of bounded size.

Null text is the empty text: no ids, and it decodes to the empty text. Strings of special tokens inside a text become special
tokens, as by the library's default. Repeated rows are encoded each (their chunks once); an empty table gives no rows; very long
texts are encoded chunk by chunk, whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, read

#: The pool of segments, and the kept chunks, start anew beyond so many entries, ids or bytes.
POOL_SEGMENTS = 500_000
POOL_IDS = 5_000_000
CHUNK_BYTES = 8_000_000

_AGREE = re.compile(r"(?<=\S)(?= )")
_SPACES = re.compile(r"\s ")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary: a byte that prints is itself, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Exact ids of texts under a byte-level tokenizer file."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        model, symbols = spec["model"], byte_symbols()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(symbols[c] for c in t) for t, i in model["vocab"].items() if t not in self.specials}
        ranks = {b: i for i, b in self.bytes_of.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.specials.items()}
        merged = [bytes(symbols[c] for m in (x if isinstance(x, list) else x.split(" ")) for c in m) for x in model["merges"]]
        ids = [ranks[m] for m in merged]
        pre = spec["pre_tokenizer"]
        ranked = ids == sorted(ids) and spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        self.path, self.fast = path, None
        if ranked:  # ids follow the merges' order, so merging by rank is the same thing
            import public_tokenizers

            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.specials)
        self.marks = tuple(self.specials)

    @cached_property
    def exact(self):
        """The library's own tokenizer, for files whose ids don't follow their merges."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def encode(self, text: str) -> list[int]:
        if self.fast is None:
            return self.exact.encode(text, add_special_tokens=False).ids
        if any(m in text for m in self.marks):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)

    @cached_property
    def table(self) -> list[bytes]:
        return _table(self.bytes_of)

    def decode(self, ids: list[int]) -> bytes:
        return decoded(self.table, ids)


def _table(bytes_of: dict[int, bytes]) -> list[bytes]:
    return [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]


def byte_table(path: str) -> list[bytes]:
    """The bytes of each id of a tokenizer file, without anything that encoding needs."""
    spec, symbols = json.load(open(path, encoding="utf-8")), byte_symbols()
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain = {i: bytes(symbols[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in specials}
    return _table(plain | {i: t.encode() for t, i in specials.items()})


def decoded(table: list[bytes], ids: list[int]) -> bytes:
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace").encode()


class Pool(dict):
    """Segment without its leading space -> its place among the ids gathered so far."""

    def __init__(self, encoder: Encoder, lead: str, ids: array, starts: array):
        super().__init__()
        self.encoder, self.lead, self.ids, self.starts = encoder, lead, ids, starts

    def __missing__(self, segment: str) -> int:
        got = self.encoder.encode(self.lead + segment)
        self.ids.extend(got)
        self.starts.append(len(self.ids))
        self[segment] = at = len(self.starts) - 2
        return at


def split(text: str) -> list[str]:
    """What is before the first agreement point, and the segments that start at them, with their space. A space at the very
    start is no such point: what is before it isn't known."""
    if _SPACES.search(text):
        return _AGREE.split(text)
    parts = text.split(" ")
    out = [parts[0], *(" " + p for p in parts[1:])]
    return out[1:] if len(out) > 1 and not out[0] else out


class Segments:
    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.clear()

    def clear(self) -> None:
        self.ids, self.starts = array("I"), array("q", [0])
        self.bare = Pool(self.encoder, "", self.ids, self.starts)
        self.spaced = Pool(self.encoder, " ", self.ids, self.starts)

    def full(self) -> bool:
        return len(self.starts) > POOL_SEGMENTS or len(self.ids) > POOL_IDS

    def places(self, text: str) -> list[int]:
        """The segments of a text, or of a part of one that starts at an agreement point or at the text's start."""
        if not text:
            return []
        first, *rest = split(text)
        return [self.bare[first], *(self.spaced[x[1:]] for x in rest)]

    def gather(self, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the segments in a row, and how many each has."""
        at = np.array(places, dtype=np.int64)
        starts = np.frombuffer(self.starts, dtype=np.int64)
        first, n = starts[at], starts[at + 1] - starts[at]
        del starts
        total = int(n.sum())
        where = np.arange(total) + np.repeat(first - (np.cumsum(n) - n), n)
        if not total:
            return np.zeros(0, np.uint32), n
        pool = np.frombuffer(self.ids, dtype=np.uint32)
        out = pool[where]
        del pool
        return out, n


_workers: dict[str, Segments] = {}


def segments(path: str) -> Segments:
    """One for each worker and tokenizer file."""
    if path not in _workers:
        _workers[path] = Segments(path)
    return _workers[path]


def ids_by_segments(own: Segments, texts: list[str]) -> Iterator[np.ndarray]:
    """The ids of each text, texts of about a million characters at once."""
    i = 0
    while i < len(texts):
        if own.full():
            own.clear()
        places: list[int] = []
        counts: list[int] = []
        chars = 0
        while i < len(texts) and chars < 1_000_000:
            got = own.places(texts[i])
            places += got
            counts.append(len(got))
            chars += len(texts[i])
            i += 1
        ids, n = own.gather(places)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *counts])]
        for a, b in zip(ends, ends[1:], strict=False):
            yield ids[a:b]


# --- chunks ---------------------------------------------------------------------------------------------------------------


def chunk_cuts(data: bytes, chunk_bits: int) -> list[int]:
    """Where chunks end within data: at starts of characters after eight bytes whose hash has chunk_bits zero bits."""
    n = len(data)
    if n < 16:
        return []
    raw = np.frombuffer(data, dtype=np.uint8)
    last8 = np.ndarray((n - 8,), dtype="<u8", buffer=data, strides=(1,))  # the eight bytes before place 8, 9, ...
    cut = (last8 * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - chunk_bits) == 0
    return (np.flatnonzero(cut & ((raw[8:] & 0xC0) != 0x80)) + 8).tolist()


class Chunk:
    """A chunk by itself: what precedes its first segment, the ids of whole segments and where each ends, what follows."""

    __slots__ = ("data", "head", "ids", "ends", "tail", "first", "last")

    def __init__(self, own: Segments, data: bytes):
        parts = split(data.decode())
        self.data, self.ends = data, None
        if len(parts) < 3:
            self.head, self.tail = data.decode(), ""
            return
        self.head, self.tail, self.first, self.last = parts[0], parts[-1], parts[1], parts[-2]
        self.ids, n = own.gather([own.spaced[p[1:]] for p in parts[1:-1]])
        self.ends = np.cumsum(n)

    def segments(self) -> list[str]:
        return split(self.data.decode())[1:-1]

    def left(self, k: int) -> tuple[str, np.ndarray, int]:
        """The last k segments: their text, the ids of the first of them, and how many ids come after that one."""
        n = len(self.ends)
        a, b = (int(self.ends[n - k - 1]) if k < n else 0), int(self.ends[n - k])
        return self.last if k == 1 else "".join(self.segments()[n - k :]), self.ids[a:b], len(self.ids) - b

    def right(self, k: int) -> tuple[str, np.ndarray, int]:
        """The first k segments: their text, the ids of the last of them, and how many ids come before that one."""
        a = int(self.ends[k - 2]) if k > 1 else 0
        return self.first if k == 1 else "".join(self.segments()[:k]), self.ids[a : int(self.ends[k - 1])], a


class Chunks:
    """Kept chunks by their bytes, and the encoding of documents from them."""

    def __init__(self, own: Segments, chunk_bits: int, reuse: bool = True):
        self.own, self.bits, self.reuse = own, chunk_bits, reuse
        self.kept: dict[bytes, Chunk] = {}
        self.size = self.encoded = self.reused = self.widened = 0

    def chunk(self, data: bytes) -> Chunk:
        if (got := self.kept.get(data)) is not None:
            self.reused += 1
            return got
        got = Chunk(self.own, data)
        self.encoded += 1
        if self.reuse:
            self.size += 5 * len(data) + 400
            if self.size > CHUNK_BYTES * 5:
                self.kept.clear()
                self.size = 0
            self.kept[data] = got
        return got

    def clear(self) -> None:
        """What a task leaves behind in a worker that later stages use too."""
        self.kept.clear()
        self.size = 0
        self.own.clear()

    def _join(self, before: Chunk | None, rest: str, after: Chunk | None) -> tuple[int, np.ndarray, int]:
        """How many ids of the chunk before go, the ids that come instead, and how many of the chunk after go."""
        k = 1
        while True:
            left, right = (min(k, len(c.ends)) if c is not None else 0 for c in (before, after))
            text, want, over = before.left(left) if left else ("", None, 0)
            text2, want2, over2 = after.right(right) if right else ("", None, 0)
            window = text + rest + text2
            got = self.own.gather([self.own.bare[window]])[0] if window else np.zeros(0, np.uint32)
            a, b = (0 if want is None else len(want)), len(got) - (0 if want2 is None else len(want2))
            agree = a <= b and (want is None or np.array_equal(got[:a], want)) and (want2 is None or np.array_equal(got[b:], want2))
            if agree:
                return over, got[a:b], over2
            self.widened += 1
            if (before is None or left == len(before.ends)) and (after is None or right == len(after.ends)):
                return (0 if before is None else len(before.ids)), got, (0 if after is None else len(after.ids))
            k *= 2

    def encode(self, data: bytes) -> np.ndarray:
        if self.own.full():
            self.own.clear()
        out: list[np.ndarray] = []
        rest, a, before = "", 0, None
        for b in [*chunk_cuts(data, self.bits), len(data)]:
            chunk = self.chunk(data[a:b])
            a = b
            rest += chunk.head
            if chunk.ends is None:
                continue
            if before is None and not rest:
                skip = 0
            else:
                lost, ids, skip = self._join(before, rest, chunk)
                if lost:
                    if lost > len(out[-1]):  # a window over all of a chunk whose start was repaired before
                        return np.array(self.own.encoder.encode(data.decode()), dtype=np.uint32)
                    out[-1] = out[-1][: len(out[-1]) - lost]
                out.append(ids)
            out.append(chunk.ids[skip:])
            rest, before = chunk.tail, chunk
        if rest:
            lost, ids, _ = self._join(before, rest, None)
            if lost:
                if lost > len(out[-1]):
                    return np.array(self.own.encoder.encode(data.decode()), dtype=np.uint32)
                out[-1] = out[-1][: len(out[-1]) - lost]
            out.append(ids)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


_chunkers: dict[tuple[str, int], Chunks] = {}


def chunker(path: str, chunk_bits: int) -> Chunks:
    if (path, chunk_bits) not in _chunkers:
        _chunkers[path, chunk_bits] = Chunks(segments(path), chunk_bits)
    return _chunkers[path, chunk_bits]


def _encode(file: str, chunk_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chunker(tokenizer_path(file), chunk_bits)
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                ids = [own.encode(t) for t in binaries(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], names=["doc_id", "n_tokens", "ids"])
        own.clear()

    return run


def _decode(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(tokenizer_path(file))
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                texts = [decoded(table, np.frombuffer(x or b"", "<u4").tolist()) for x in part.column("ids").to_pylist()]
                cols = [part.column(n) for n in part.schema.names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.binary()).cast(pa.string())], names=[*part.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, file: str = "byte_bpe_50k.json", chunk_bits: int = 10) -> DataFrame:
    """doc_id, n_tokens, and ids as little-endian unsigned 32-bit integers in a binary."""
    return docs.select("doc_id", "text").mapInArrow(_encode(file, chunk_bits), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, file: str = "byte_bpe_50k.json") -> DataFrame:
    """The columns of encoded, and the text as decoded."""
    encoded = encoded.drop("decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decode(file), f"{fields}, decoded string")


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    both = decode(encode(read(spark, folder, "documents")))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
