"""Packing documents into windows by non-negative least squares.

A document is the ids of its text and an end id. It is cut into full windows, a head whose length is a multiple of the
granule, and a tail shorter than the granule. Shallow combinations of piece lengths that fill a window exactly are listed
(up to four heads; or tails of one length with one tail that fills up); non-negative least squares finds how often to repeat
each so that together they use up the histogram of lengths; the counts are rounded down, and what is left over is packed
greedily, the longest first and always with the longest that still fits. The histogram has less than a hundred bins at any
size and is all that the driver sees of the documents. A piece's place follows from its number among the pieces of its length:
its task's share before it (a prefix sum over tasks) and its count within the task.

Null and empty texts are the end id alone; a very long text is as many full windows as it fills, and a rest; an empty table
gives no pieces. Repeated rows are packed each for itself, null doc_ids too.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import read, written

WINDOW = 2048
GRANULE = 32
END_ID = 1


def cut(n: int, window: int, granule: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    out = [(s, window) for s in range(0, n - n % window, window)]
    rest, at = n % window, n - n % window
    if head := rest - rest % granule:
        out.append((at, head))
    if tail := rest % granule:
        out.append((at + head, tail))
    return out


def _pieces(file: str, window: int, granule: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = bpe.segments(bpe.tokenizer_path(file)), TaskContext.get().partitionId()
        numbers: Counter = Counter()
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                rows = []
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), bpe.ids_by_segments(own, texts), strict=True):
                    raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                    for start, length in cut(len(raw) // 4, window, granule):
                        rows.append((doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(raw) // 4, task, numbers[length]))
                        numbers[length] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "number"])
        own.clear()

    return run


# --- the plan -------------------------------------------------------------------------------------------------------------


def combinations(window: int, granule: int) -> list[tuple[int, ...]]:
    """Multisets of lengths that fill a window: up to four heads, or tails of one length and one that fills up."""
    units = window // granule
    out: list[tuple[int, ...]] = []

    def grow(parts: tuple[int, ...], left: int) -> None:
        if not left:
            out.append(tuple(granule * p for p in parts))
        elif len(parts) < 4:
            for p in range(min(left, parts[-1] if parts else units - 1), 0, -1):
                grow((*parts, p), left - p)

    grow((), units)
    for length in range(1, granule):
        rest = window % length
        out.append((length,) * (window // length) + ((rest,) if rest else ()))
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 with the least |ax - b|, by active sets: bring in the column with the steepest descent, solve on the
    columns that are in, and step back to the border as long as any would be negative."""
    n = a.shape[1]
    x, inside = np.zeros(n), np.zeros(n, dtype=bool)
    scale = np.linalg.norm(a, axis=0)
    for _ in range(3 * a.shape[0]):
        slope = (a.T @ (b - a @ x)) / scale
        slope[inside] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        inside[j] = True
        while True:
            at = np.flatnonzero(inside)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - z[bad], 1e-300))
            x[at] += step * (z - x[at])
            inside[at[x[at] <= 1e-12 * max(1.0, np.abs(b).max())]] = False
            x[~inside] = 0
            if not inside.any():
                break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, granule: int = GRANULE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): windows that together hold every piece of the histogram exactly once."""
    left = {k: v for k, v in histogram.items() if v}
    out: list[tuple[tuple[int, ...], int]] = []
    if full := left.pop(window, 0):
        out.append(((window,), full))

    def use(parts: tuple[int, ...], times: int) -> None:
        if times > 0:
            out.append((tuple(sorted(parts, reverse=True)), times))
            for p, m in Counter(parts).items():
                left[p] -= m * times
                if not left[p]:
                    del left[p]

    lengths = sorted(left)
    columns = [c for c in combinations(window, granule) if all(p in left for p in c)]
    if columns:
        row = {p: i for i, p in enumerate(lengths)}
        a = np.zeros((len(lengths), len(columns)))
        for j, c in enumerate(columns):
            for p in c:
                a[row[p], j] += 1
        x = nnls(a, np.array([left[p] for p in lengths], dtype=float))
        for j in np.argsort(-x, kind="stable"):
            c = Counter(columns[j])
            if x[j] >= 1 and all(p in left for p in c):
                use(columns[j], min(int(x[j] + 1e-6), *(left[p] // m for p, m in c.items())))
    while left:
        parts: list[int] = []
        room, free = window, dict(left)
        for p in sorted(free, reverse=True):
            m = min(free[p], room // p)
            parts += [p] * m
            room -= p * m
        use(tuple(parts), min(left[p] // m for p, m in Counter(parts).items()))
    return out


def _places(windows: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the first number of each window kind that holds it, its multiplicity, first sequence and offset."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for parts, times in windows:
        offset = 0
        for p, m in sorted(Counter(parts).items(), reverse=True):
            found.setdefault(p, []).append((used[p], m, sequence, offset))
            used[p] += m * times
            offset += p * m
        sequence += times
    return {p: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for p, rows in found.items()}


def _placed(places: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for p in np.unique(length):
                rows = np.flatnonzero(length == p)
                first, times, base, start = places[int(p)]
                k = np.searchsorted(first, number[rows], side="right") - 1
                own = number[rows] - first[k]
                sequence[rows] = base[k] + own // times[k]
                offset[rows] = start[k] + own % times[k] * p
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, file: str = "byte_bpe_50k.json", window: int = WINDOW, granule: int = GRANULE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece."""
    pieces, _ = written(docs.select("doc_id", "text").mapInArrow(_pieces(file, window, granule, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, number long"))
    shares, _ = written(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(shares, ["length", "task"]).withColumn("number", F.col("number") + F.col("before")).drop("before", "task")
    places = _places(plan(histogram, window, granule))
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "number").mapInArrow(_placed(places), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read(spark, folder, "documents"))
