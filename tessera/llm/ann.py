"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns a unit vector by pseudo-rotations (three times: random signs, then a fast Hadamard transform) and gives it the
nearest signed axis of each; these axes, and the half octave of the vector's length, make up its bucket. There are about a
quarter as many buckets as rows. A query's prospect in a bucket is the sum of its own coordinates on the bucket's axes times
the length of the longest vector there, so that the order of probes is by inner product and not by angle. It probes all
buckets with a prospect of tau or more, and further ones, the best first, until these hold several times k rows; so tables of
few rows are searched whole.

How many tables there are and tau are measured: the true neighbours of a bounded sample of queries are found by comparing these
few with all rows, and of all numbers of tables the one is taken whose probes reach `recall` of those neighbours at the least
cost. All rows are indexed.

Buckets that lie side by side are dealt to blocks of bounded size, a bucket that is larger than a block to several; a query goes
once to each block that it has a bucket in, and a block with very many queries is copied for some of them at a time. Within a
block the rows of probed buckets are compared, and the best k by inner product in double precision on the original vectors leave
it. How rows are dealt to blocks changes no result.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; vectors meet those of
equal length only. Rows with the query's id aren't candidates; of rows that share an id, the nearest counts; a query id that
repeats with different vectors has the best of both. Equal scores are ordered by id. An empty table has no neighbours. Other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written
from .vectors import packed, unpacked, usable

NEAREST = 20
QUERY_EVERY = 20
#: Tables at most, the share of true neighbours that probes are to reach among the sample, and the sample's queries, about.
TABLES = 8
RECALL = 0.95
SAMPLE = 256
#: Rows to a bucket on average, the most buckets of a table (without lengths), and what it costs to move a row, in comparisons.
ROWS_PER_BUCKET = 4
MOST_BUCKETS = 1 << 18
MOVE_COST = 100
#: Queries that are compared with one copy of a block, and rows and queries that are compared at once.
BLOCK_QUERIES = 16_384
TILE_ROWS = 256
TILE_QUERIES = 512

# A bucket's key: vector length from bit 40, table from 36, half octave from 24, axes below.
_TABLE, _BAND, _CODE = 36, 24, (1 << 24) - 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def turned(x: np.ndarray, table: int, part: int) -> np.ndarray:
    """Pseudo-rotation of unit vectors, padded to a power of two."""
    n = 1 << max(0, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), n))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng([table, part, n]).choice([-1.0, 1.0], size=(3, n))
    for s in signs:
        out = hadamard(out * s)
    return out


def axes_of(rows: int, d: int) -> list[int]:
    """The axes of each hash of a table, signs not counted: as many hashes, the last on as few axes, as make enough buckets."""
    whole = 1 << max(0, (d - 1).bit_length())
    want = min(max(rows / ROWS_PER_BUCKET, 2.0), MOST_BUCKETS)
    out = []
    while want > 1 and math.prod(2 * a for a in out) < MOST_BUCKETS and len(out) < 18:
        out.append(min(whole, 1 << max(0, math.ceil(math.log2(want)) - 1)))
        want /= 2 * out[-1]
    return out


def coordinates(unit: np.ndarray, table: int, axes: list[int]) -> list[np.ndarray]:
    """For each hash, the coordinates on its axes and on their opposites."""
    out = []
    for part, a in enumerate(axes):
        r = turned(unit, table, part)[:, :a]
        out.append(np.concatenate([r, -r], axis=1))
    return out


def codes(unit: np.ndarray, table: int, axes: list[int]) -> np.ndarray:
    code = np.zeros(len(unit), dtype=np.int64)
    for c in coordinates(unit, table, axes):
        code = code * c.shape[1] + np.argmax(c, axis=1)
    return code


def prospects(coords: list[np.ndarray], keys: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Of each query in each bucket."""
    code, out = keys & _CODE, 0.0
    for c in reversed(coords):
        out = out + c[:, code % c.shape[1]]
        code = code // c.shape[1]
    return out * longest


def unit_and_size(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(axis=1, keepdims=True)
    y = x / scale
    n = np.linalg.norm(y, axis=1, keepdims=True)
    with np.errstate(over="ignore"):
        return y / n, np.minimum((n * scale)[:, 0], np.finfo(float).max)


def _based(rows: int, tables: int):
    """vec_id, d, x, size and the keys of each usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                batch = whole.slice(s, 2000)
                ids = batch.column("vec_id")
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                column = batch.column("embedding")
                for d, (at, x) in usable(column)[1].items():
                    at, x = at[known[at]], x[known[at]]
                    if not len(at):
                        continue
                    unit, size = unit_and_size(x)
                    band = np.clip(np.round(2 * np.log2(size)), -2000, 2000).astype(np.int64) + 2047
                    axes = axes_of(rows, d)
                    keys = np.stack([(d << 40) + (t << _TABLE) + (band << _BAND) + codes(unit, t, axes) for t in range(tables)], axis=1)
                    lists = pa.ListArray.from_arrays(np.arange(0, len(at) * tables + 1, tables, dtype=np.int32), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), d, np.int32)), pa.array(packed(x, column), pa.binary()), pa.array(size), lists], names=["vec_id", "d", "x", "size", "keys"])

    return run


def best_of(q: np.ndarray, v: np.ndarray, score: np.ndarray, k: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k best (query, id, score, ...) of each query, each id once."""
    order = np.lexsort([-score, v, q])
    first = np.append(True, (q[order][1:] != q[order][:-1]) | (v[order][1:] != v[order][:-1]))[: len(q)]
    order = order[first]
    order = order[np.lexsort([v[order], -score[order], q[order]])]
    mine = q[order]
    order = order[np.arange(len(mine)) - np.searchsorted(mine, mine) < k]
    return tuple(c[order] for c in (q, v, score, *more))


# --- measuring -----------------------------------------------------------------------------------------------------------


def _truth(sample: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
    """For each query of the sample, the best k rows of a task: (query, id, score, keys). sample: by vector length, numbers, ids
    and vectors of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        keys = None
        for batch in batches:
            ds, ids = batch.column("d").to_numpy(), batch.column("vec_id").to_numpy()
            raw = batch.column("x").to_pylist()
            width = len(batch.column("keys")[0]) if batch.num_rows else 0
            all_keys = batch.column("keys").flatten().to_numpy().reshape(batch.num_rows, width)
            for d, (number, own, x) in sample.items():
                rows = np.flatnonzero(ds == d)
                for s in range(0, len(rows), 4096):
                    some = rows[s : s + 4096]
                    score = x @ unpacked([raw[i] for i in some], d).T
                    score[own[:, None] == ids[some][None, :]] = -np.inf
                    m = min(4 * k, len(some))
                    top = np.argpartition(-score, m - 1, axis=1)[:, :m]
                    i = np.repeat(np.arange(len(x)), m)
                    j = top.ravel()
                    fine = np.isfinite(score[i, j])
                    i, j = i[fine], j[fine]
                    new = [number[i], ids[some][j], score[i, j], *all_keys[some][j].T]
                    held = [np.concatenate(c) for c in zip(held, new, strict=True)] if held else new
                    held = list(best_of(held[0], held[1], held[2], k, *held[3:]))
                    keys = width
        if held:
            lists = pa.ListArray.from_arrays(np.arange(0, len(held[0]) * keys + 1, keys, dtype=np.int32), pa.array(np.stack(held[3:], axis=1).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(held[2]), lists], names=["q", "vec_id", "score", "keys"])

    return run


@dataclass
class Table:
    """The buckets of one table for one vector length, by key: rows, the longest vector, first block and number of blocks."""

    keys: np.ndarray
    rows: np.ndarray
    longest: np.ndarray
    block: np.ndarray
    blocks: np.ndarray


@dataclass
class Index:
    axes: list[int]
    tau: float
    tables: list[Table]

    def coordinates(self, unit: np.ndarray) -> list[list[np.ndarray]]:
        return [coordinates(unit, t, self.axes) for t in range(len(self.tables))]

    def bounds(self, unit: np.ndarray, need: int) -> Iterator[tuple[Table, np.ndarray, np.ndarray]]:
        """For each table, the prospects of queries in its buckets and the least that each probes."""
        for t, table in enumerate(self.tables):
            p = prospects(coordinates(unit, t, self.axes), table.keys, table.longest)
            tau = np.full(len(unit), self.tau)
            if t == 0:  # enough rows for everyone, so that fewer than need rows are all found
                for i in np.flatnonzero((p >= self.tau) @ table.rows < need):
                    order = np.argsort(-p[i], kind="stable")
                    full = np.flatnonzero(np.cumsum(table.rows[order]) >= need)
                    tau[i] = min(self.tau, p[i, order[full[0]]]) if len(full) else -np.inf
            yield table, p, tau


def tuned(buckets: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]], axes: list[int], x: np.ndarray, found: list[np.ndarray], recall: float, share: float) -> tuple[int, float]:
    """How many tables, and tau. found: for each query of the sample (rows of x) the keys of its true neighbours, a row each;
    buckets: keys, rows and longest of each table; share: queries for each row."""
    if not len(x) or not any(map(len, found)):
        return 1, -np.inf
    unit, _ = unit_and_size(x)
    best, options = None, []
    coords = {t: coordinates(unit, t, axes) for t in buckets}
    for t, (keys, _, longest) in buckets.items():
        mine = []
        for i, f in enumerate(found):
            if len(f):
                at = np.searchsorted(keys, f[:, t])
                mine.append(prospects([c[i : i + 1] for c in coords[t]], keys[at], longest[at])[0])
        mine = np.concatenate(mine)
        best = mine if best is None else np.maximum(best, mine)
        options.append(np.sort(best)[int((1 - recall) * len(best))])
    taus = np.array(options)
    cost = np.zeros(len(taus))
    some = range(0, len(x), max(1, len(x) // 64))
    for t, (keys, rows, longest) in buckets.items():
        for i in some:
            p = prospects([c[i : i + 1] for c in coords[t]], keys, longest)[0]
            order = np.argsort(p)
            above = np.append(np.cumsum(rows[order][::-1])[::-1], 0)
            cost[t:] += above[np.searchsorted(p[order], taus[t:])] / len(some)
    total = share * cost + MOVE_COST * (np.arange(len(taus)) + 1)
    t = int(np.argmin(total))
    return t + 1, float(taus[t])


def index(base: DataFrame, rows: int, k: int, query_every: int, tables: int, recall: float, sample: int, block_rows: int) -> dict[int, Index]:
    """For each vector length; what the driver sees are the sizes of buckets and the sample."""
    asks = F.pmod("vec_id", F.lit(query_every)) == 0
    sizes = {r["d"]: (r["n"], r["asks"]) for r in base.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("asks")).collect()}
    share = F.coalesce(*(F.when(F.col("d") == d, F.lit(sample / max(a, 1))) for d, (_, a) in sizes.items()), F.lit(0.0))
    chosen = base.where(asks & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share * (1 << 20))).select("d", "vec_id", "x").collect()
    chosen.sort(key=lambda r: (r["d"], r["vec_id"], r["x"]))
    by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for d in {r["d"] for r in chosen}:
        number = np.array([i for i, r in enumerate(chosen) if r["d"] == d])
        by[d] = (number, np.array([chosen[i]["vec_id"] for i in number]), unpacked([bytes(chosen[i]["x"]) for i in number], d))
    near: dict[int, list] = {}
    if chosen:
        own = base.sparkSession.sparkContext.broadcast(by)
        found = base.mapInArrow(lambda batches: _truth(own.value, k)(batches), "q long, vec_id long, score double, keys array<long>")
        found = found.groupBy("q", "vec_id").agg(F.max_by(F.struct("score", "keys"), "score").alias("s"))
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s.score"), "vec_id"))
        for r in found.withColumn("r", rank).where(F.col("r") <= k).select("q", "s.keys").collect():
            near.setdefault(r["q"], []).append(r["keys"])
    got = base.select("vec_id", "size", F.explode("keys").alias("key")).groupBy("key").agg(F.count_distinct("vec_id").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("size")).orderBy("key").toArrow()
    key, n, copies, longest = (got.column(c).to_numpy() for c in ("key", "n", "rows", "size"))
    out, block = {}, 0
    for d, (count, asking) in sorted(sizes.items()):
        axes, buckets = axes_of(rows, d), {}
        for t in range(tables):
            a, b = np.searchsorted(key, [(d << 40) + (t << _TABLE), (d << 40) + ((t + 1) << _TABLE)])
            buckets[t] = (key[a:b], n[a:b], longest[a:b])
        number, _, x = by.get(d, (np.zeros(0, int), None, np.zeros((0, d))))
        many, tau = tuned(buckets, axes, x, [np.array(near.get(i, []), dtype=np.int64).reshape(-1, tables) for i in number.tolist()], recall, asking / count)
        made = []
        for t in range(many):
            a, b = np.searchsorted(key, [(d << 40) + (t << _TABLE), (d << 40) + ((t + 1) << _TABLE)])
            first, blocks = np.zeros(b - a, dtype=np.int64), np.ones(b - a, dtype=np.int64)
            fill = 0
            for i, m in enumerate(copies[a:b].tolist()):
                if fill and fill + m > block_rows:
                    block, fill = block + 1, 0
                first[i], fill = block, fill + m
                if m > block_rows:
                    blocks[i] = -(-m // block_rows)
                    block, fill = block + int(blocks[i]), 0
            block += 1
            made.append(Table(key[a:b], n[a:b], longest[a:b], first, blocks))
        out[d] = Index(axes, tau, made)
    return out


# --- searching -----------------------------------------------------------------------------------------------------------


def _rows(shared):
    """A row for each table: its block, key, id and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ds, ids = batch.column("d").to_numpy(), batch.column("vec_id").to_numpy()
            keys = batch.column("keys").flatten().to_numpy().reshape(batch.num_rows, -1)
            for d in np.unique(ds).tolist():
                at = np.flatnonzero(ds == d)
                x = batch.column("x").take(pa.array(at))
                spread = np.array([xxhash.xxh3_64_intdigest(int(i).to_bytes(8, "little", signed=True)) >> 1 for i in ids[at]])
                for t, table in enumerate(shared.value[d].tables):
                    pos = np.searchsorted(table.keys, keys[at, t])
                    block = table.block[pos] + spread % table.blocks[pos]
                    yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(keys[at, t]), pa.array(ids[at]), x], names=["block", "key", "vec_id", "x"])

    return run


def _asked(shared, need: int):
    """A row for each block in which a query probes a bucket, and the least prospect that it probes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 64):
                batch = whole.slice(s, 64)
                ds, ids, raw = batch.column("d").to_numpy(), batch.column("vec_id").to_numpy(), batch.column("x").to_pylist()
                for d in np.unique(ds).tolist():
                    at = np.flatnonzero(ds == d)
                    unit, _ = unit_and_size(unpacked([raw[i] for i in at], d))
                    for table, p, tau in shared.value[d].bounds(unit, need):
                        block, row, least = [], [], []
                        for i in range(len(at)):
                            probed = np.flatnonzero(p[i] >= tau[i])
                            first, blocks = table.block[probed], table.blocks[probed]
                            goes = np.unique(first[blocks == 1])
                            for f, b in zip(first[blocks > 1].tolist(), blocks[blocks > 1].tolist(), strict=True):
                                goes = np.append(goes, np.arange(f, f + b))
                            block.append(goes)
                            row.append(np.full(len(goes), at[i]))
                            least.append(np.full(len(goes), tau[i]))
                        row = np.concatenate(row)
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(block)), pa.array(ids[row]), batch.column("x").take(pa.array(row)), pa.array(np.concatenate(least))], names=["block", "vec_id", "x", "tau"])

    return run


class _Block:
    """The rows of a block, sorted by bucket."""

    def __init__(self, held: list[pa.RecordBatch], shared):
        table = pa.Table.from_batches(held).combine_chunks().sort_by("key")
        key = table.column("key").to_numpy()
        self.d, self.t = int(key[0] >> 40), int(key[0] >> _TABLE & 15)
        self.index = shared.value[self.d]
        own = self.index.tables[self.t]
        self.keys, self.bucket = np.unique(key, return_inverse=True)
        self.longest = own.longest[np.searchsorted(own.keys, self.keys)]
        self.ids = table.column("vec_id").to_numpy()
        self.x = unpacked(table.column("x").to_pylist(), self.d)
        self.first = np.zeros(len(self.ids), dtype=bool)  # of rows that share an id, one
        self.first[np.unique(self.ids, return_index=True)[1]] = True

    def search(self, ids: np.ndarray, x: np.ndarray, tau: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best k (query, id, score) of each query."""
        unit, _ = unit_and_size(x)
        probed = prospects(coordinates(unit, self.t, self.index.axes), self.keys, self.longest) >= tau[:, None]
        top = np.full((len(x), k), -np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        pending = 0
        for s in range(0, len(self.ids), TILE_ROWS):
            e = min(s + TILE_ROWS, len(self.ids))
            a, b = self.bucket[s], self.bucket[e - 1] + 1
            some = np.flatnonzero(probed[:, a:b].any(axis=1))
            if not len(some):
                continue
            score = x[some] @ self.x[s:e].T
            score[~probed[some][:, self.bucket[s:e]] | (ids[some][:, None] == self.ids[None, s:e])] = -np.inf
            once = np.where(self.first[None, s:e], score, -np.inf)
            both = np.concatenate([top[some], once], axis=1)
            top[some] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            kth = top[some].min(axis=1)
            with np.errstate(invalid="ignore"):
                kth = np.where(np.isfinite(kth), kth - 1e-9 * (1 + np.abs(kth)), kth)
            i, j = np.nonzero((score >= kth[:, None]) & np.isfinite(score))
            exact = np.einsum("ij,ij->i", x[some[i]], self.x[s + j])  # in the same order, whatever the block
            found.append((ids[some[i]], self.ids[s + j], exact))
            pending += len(i)
            if pending > 1_000_000:
                found = [best_of(*(np.concatenate(c) for c in zip(*found, strict=True)), k)]
                pending = 0
        return best_of(*(np.concatenate(c) for c in zip(*found, strict=True)), k)


def _searched(shared, k: int):
    """Of rows sorted by block and copy, each block's rows first and then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pending = merged = 0
        held: list[pa.RecordBatch] = []
        here, block = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in best[0]], names=["query_id", "vec_id", "score"])

        for whole in batches:
            if not whole.num_rows:
                continue
            at, copy, query = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("block", "copy", "query"))
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(copy) != 0) | (query[1:] != query[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if (at[s], copy[s]) != here:
                    here, held, block = (at[s], copy[s]), [], None
                part = whole.slice(s, e - s)
                if not query[s]:
                    held.append(part.select(["key", "vec_id", "x"]))
                    continue
                if not held and block is None:
                    continue
                if block is None:
                    block, held = _Block(held, shared), []
                ids, tau, raw = part.column("vec_id").to_numpy(), part.column("tau").to_numpy(), part.column("x").to_pylist()
                for c in range(0, len(ids), TILE_QUERIES):
                    got = block.search(ids[c : c + TILE_QUERIES], unpacked(raw[c : c + TILE_QUERIES], block.d), tau[c : c + TILE_QUERIES], k)
                    best.append(got)
                    pending += len(got[0])
                if pending > 1_000_000:  # a task's best so far: k rows at most for each query in it, and not too many of them
                    best = [best_of(*(np.concatenate(c) for c in zip(*best, strict=True)), k)]
                    pending, merged = 0, len(best[0][0])
                    if merged > 3_000_000:
                        yield out()
                        best = []
        if best:
            best = [best_of(*(np.concatenate(c) for c in zip(*best, strict=True)), k)]
            yield out()

    return run


def nearest(vectors: DataFrame, k: int = NEAREST, query_every: int = QUERY_EVERY, tables: int = TABLES, recall: float = RECALL, sample: int = SAMPLE, block_rows: int | None = None, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query; all candidates of a query with fewer than k.

    tables: how many at most; recall: of the sample's true neighbours; block_rows: rows of a block, else by the table's rows."""
    spark = vectors.sparkSession
    src = vectors.select("vec_id", "embedding")
    rows = max(src.count(), 1)
    block_rows = block_rows or min(max(rows // 64, 2048), 65_536)
    base, _ = written(src.mapInArrow(_based(rows, tables), "vec_id long, d int, x binary, size double, keys array<long>"))
    shared = spark.sparkContext.broadcast(index(base, rows, k, query_every, tables, recall, sample, block_rows))
    asks = F.pmod("vec_id", F.lit(query_every)) == 0
    asked, _ = written(base.where(asks).select("vec_id", "d", "x").mapInArrow(_asked(shared, 4 * k + 1), "block long, vec_id long, x binary, tau double"))
    hot = asked.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_queries)
    hot = F.broadcast(hot.select("block", F.ceil(F.col("n") / block_queries).cast("int").alias("copies")))  # a row for so many queries
    copies = F.coalesce("copies", F.lit(1))
    have = base.select("vec_id", "d", "x", "keys").mapInArrow(_rows(shared), "block long, key long, vec_id long, x binary")
    have = have.join(hot, "block", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    want = asked.join(hot, "block", "left").withColumn("copy", F.pmod(F.xxhash64("vec_id"), copies).cast("int"))
    none = F.lit(None)
    have = have.select("block", "copy", F.lit(False).alias("query"), "key", "vec_id", "x", none.cast("double").alias("tau"))
    want = want.select("block", "copy", F.lit(True).alias("query"), none.cast("long").alias("key"), "vec_id", "x", "tau")
    both = have.union(want).repartition("block", "copy").sortWithinPartitions("block", "copy", "query")
    found = both.mapInArrow(_searched(shared, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(read(spark, folder, "embeddings"))
