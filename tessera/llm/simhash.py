"""SimHash near-dedup with the generalised pigeonhole.

Fingerprint: of a text with A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, all shingles of `words` words joined by spaces (the
whole sequence where it has fewer; fingerprint zero where it has none), XXH64 of each (UTF-8, seed 42); a bit is 1 if it is
set in over half of the hashes.

Links: fingerprints that differ in `max_bits` bits or fewer. Over all distinct fingerprints, bit frequencies and correlations
are summed; correlated bits are grouped into parts; a dynamic programme gives part p a threshold t_p (-1: not probed) with
sum(t_p) = max_bits - parts + 1 at the least estimated number of candidates and probes; by the pigeonhole, two fingerprints
within max_bits agree on some part p up to t_p bits. Each fingerprint is keyed by each probed part (and, where t_p > 0, by its
neighbours there), groups of equal keys are compared in blocks, candidates are verified on all 64 bits, and only a spanning
star of each group's links leaves the task. Copies are one fingerprint, so they are never compared with each other.

Null, empty and white-space texts have fingerprint zero and link like any other; very long texts are hashed whole; an empty
table gives no rows. A null doc_id keeps its row; it is never
chosen as component_id (null only where a component holds no other id). Repeated rows are linked through their fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import binaries, block_counts, components, dealt, forest, met, read, runs_of, split_hot, whole_groups, written

#: Rows of a key's group that are compared in one task; a larger group is cut into blocks, every two of which meet.
BLOCK_ROWS = 2048
#: What a key costs to write and move, in comparisons; and the highest threshold of a part that is considered, for links that
#: are sure to be found and for those found with a given recall.
KEY_COST = 200.0
MOST_FLIPS = 3
PROBED_FLIPS = 2

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def shingle_hashes(text: bytes, words: int) -> list[int]:
    found = text.lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = list(accumulate(map(len, found), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    xx = xxhash.xxh64_intdigest
    return [xx(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :], strict=False)]


def _mixed(h: np.ndarray, stream: int) -> np.ndarray:
    """The hashes themselves for stream 0; else others made of them by the finaliser of SplitMix64 (Steele, Lea and Flood 2014),
    whose constants these are."""
    if not stream:
        return h
    h = h + np.uint64(stream * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints_of(texts: list[bytes], words: int) -> np.ndarray:
    """uint64 for each text."""
    return long_fingerprints(texts, words, 1)[0][:, 0]


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes, sorted."""
    return np.unique(np.array(shingle_hashes(text, words), dtype=np.uint64))


def long_fingerprints(texts: list[bytes], words: int, streams: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, a fingerprint of 64 bits for each stream of hashes, and how many shingles it has."""
    return set_fingerprints((np.array(shingle_hashes(t, words), dtype=np.uint64) for t in texts), len(texts), streams)


def set_fingerprints(hashes_of: Iterator[np.ndarray], texts: int, streams: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of the hashes of so many texts."""
    out = np.zeros((texts, streams), dtype=np.uint64)
    count = np.zeros(texts, dtype=np.int64)
    i = 0
    while i < texts:  # some texts at once, as many as have about a million hashes
        rows: list[np.ndarray] = []
        first, n = i, 0
        while i < texts and n < 1_000_000 and i - first < 2048:
            rows.append(next(hashes_of))
            n += len(rows[-1])
            i += 1
        sizes = np.array([len(r) for r in rows])
        hashes = np.concatenate(rows)
        count[first:i] = sizes
        at = np.repeat(np.arange(len(rows), dtype=np.int64) * 256, sizes)
        for s in range(streams):
            own, got = _mixed(hashes, s), np.zeros(len(rows), dtype=np.uint64)
            for k in range(8):
                byte = ((own >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)
                ones = np.bincount(at + byte, minlength=len(rows) * 256).reshape(-1, 256).astype(np.float64) @ _BITS
                on = ones * 2 > sizes[:, None]
                got |= (on.astype(np.uint64) << (np.arange(8, dtype=np.uint64) + np.uint64(8 * k))).sum(axis=1, dtype=np.uint64)
            out[first:i, s] = got
    return out, count


def _fingerprint(names: list[str], words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fp = fingerprints_of(binaries(batch.column("text")), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(fp)], names=[*names, "fp"])

    return run


def with_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprint(["doc_id"], words), "doc_id long, fp long")


# --- parts and thresholds -----------------------------------------------------------------------------------------------


def _bit_sums(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((len(names), 64, 64))
        for batch in batches:
            for s, name in enumerate(names):
                fp = batch.column(name).to_numpy().astype(np.int64).view(np.uint64)
                bits = ((fp[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
                gram[s] += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(gram.size, dtype=np.int32)), pa.array(gram.ravel().astype(np.int64))], names=["cell", "n"])

    return run


def stream_statistics(fps: DataFrame, names: list[str]) -> tuple[int, list[np.ndarray]]:
    """How many fingerprints, and for each stream in how many of them each two bits are both set: 4096 numbers at any size."""
    cells = fps.select(*names).mapInArrow(_bit_sums(names), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    gram = np.zeros(4096 * len(names))
    for r in cells:
        gram[r["cell"]] = r["n"]
    return fps.count(), list(gram.reshape(-1, 64, 64))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    n, (gram,) = stream_statistics(fps, ["fp"])
    return n, gram


def parts_of(n: int, gram: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m parts of equal size (up to one), each grown by the bit most correlated with those it has."""
    p = np.diag(gram) / max(n, 1)
    cov = gram / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        part = [max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))]
        left.discard(part[0])
        while len(part) < size:
            b = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(b)
            left.discard(b)
        out.append(sorted(part))
    return out


def _estimates(n: int, gram: np.ndarray, part: list[int], most: int, pairs: float, copies: int) -> list[float]:
    """For thresholds 0 to most: the pairs within it on the part, by the bits' frequencies, and the keys to write. pairs: how
    many there are to tell apart; copies: how often each fingerprint is keyed."""
    p = np.diag(gram)[part] / max(n, 1)
    dist = np.array([1.0])
    for q in 2 * p * (1 - p):
        dist = np.convolve(dist, [1 - q, q])
    out, keys, probes = [], 0.0, 1.0
    for t in range(most + 1):
        keys += probes
        probes *= (len(part) - t) / (t + 1)
        out.append(pairs * float(dist[: t + 1].sum()) + KEY_COST * copies * max(n, 1) * keys)
    return out


def thresholds(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """The thresholds, -1 or more each, of the given sum with the least cost; costs[p][t] for t from 0. Infinite cost where
    no thresholds have that sum."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, len(cost)):
                new = (c + (cost[t] if t >= 0 else 0.0), [*ts, t])
                if s + t not in step or new < step[s + t]:
                    step[s + t] = new
        best = step
    return best.get(total, (float("inf"), []))


def plan(n: int, gram: np.ndarray, max_bits: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe, of all numbers of parts the cheapest."""
    options = []
    for m in range(1, max_bits + 3):
        parts = parts_of(n, gram, m)
        most = min(max_bits, MOST_FLIPS)
        cost, ts = thresholds([_estimates(n, gram, p, most, n * n / 2, 1) for p in parts], max_bits - m + 1)
        if np.isfinite(cost):
            options.append((cost, [(p, t) for p, t in zip(parts, ts, strict=True) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


def caught(size: int, p: float, t: int) -> float:
    """The chance that so many bits differ in t at most, each by itself with chance p."""
    return sum(comb(size, k) * p**k * (1 - p) ** (size - k) for k in range(t + 1))


def by_recall(costs: list[list[float]], gains: list[list[float]], need: float, steps: int = 400) -> tuple[float, list[int]]:
    """The thresholds, -1 or more each, with the least cost whose gains sum up to need; by dynamic programming over the sum, in
    steps that are rounded down. Infinite cost where all thresholds together don't reach it."""
    best = {0: (0.0, ())}
    for cost, gain in zip(costs, gains, strict=True):
        step: dict[int, tuple[float, tuple]] = {}
        for got, (c, ts) in best.items():
            for t in range(-1, len(cost)):
                to = got if t < 0 else min(steps, got + int(gain[t] / need * steps))
                new = (c + (cost[t] if t >= 0 else 0.0), (ts, t))
                if to not in step or new[0] < step[to][0]:
                    step[to] = new
        best = step
    if steps not in best:
        return float("inf"), []
    cost, ts = best[steps]
    out = []
    while ts:
        ts, t = ts
        out.append(t)
    return cost, out[::-1]


def plan_streams(n: int, grams: list[np.ndarray], p: float, miss: float, pairs: float, copies: int) -> list[tuple[int, list[int], int]]:
    """(stream, bits, threshold) of the parts to probe, of all sizes of parts the cheapest: at most a share of `miss` of the
    pairs whose bits differ each with chance p agrees on no probed part up to its threshold."""
    options = []
    for m in (3, 4, 5, 6, 8, 10, 12, 16):
        parts = [(s, part) for s, gram in enumerate(grams) for part in parts_of(n, gram, m)]
        costs = [_estimates(n, grams[s], part, PROBED_FLIPS, pairs, copies) for s, part in parts]
        gains = [[-log(max(1 - caught(len(part), p, t), 1e-300)) for t in range(PROBED_FLIPS + 1)] for _, part in parts]
        cost, ts = by_recall(costs, gains, -log(miss))
        if np.isfinite(cost):
            options.append((cost, [(s, part, t) for (s, part), t in zip(parts, ts, strict=True) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


# --- probe and verify ---------------------------------------------------------------------------------------------------


def keyed(fps: DataFrame, parts: list[tuple[list[int], int]], more: list[str] = []) -> DataFrame:  # noqa: B006
    """part, key, own, fp and more columns: a row for each probed part and each neighbour within its threshold."""
    signed = lambda bits: f"cast('{np.array([sum(1 << b for b in bits)], dtype=np.uint64).view(np.int64)[0]}' AS bigint)"
    probes = [f"struct({k} AS part, {signed(bits)} AS mask, {signed(c)} AS flip)" for k, (bits, t) in enumerate(parts) for size in range(t + 1) for c in combinations(bits, size)]
    out = fps.select("fp", *more, F.explode(F.expr(f"array({', '.join(probes)})")).alias("r"))  # one constant
    key = F.col("fp").bitwiseAND(F.col("r.mask")).bitwiseXOR(F.col("r.flip"))
    return out.select("r.part", key.alias("key"), (F.col("r.flip") == 0).alias("own"), "fp", *more)


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs within max_bits, some rows at once."""
    step = max(1, 4_000_000 // max(len(b), 1))
    ii, jj = [], []
    for s in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[s : s + step, None] ^ b[None, :]) <= max_bits)
        ii.append(i + s)
        jj.append(j)
    return np.concatenate(ii), np.concatenate(jj)


def _links(max_bits: int):
    names = ["part", "key", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, names):
            cols = [table.column(c).to_numpy() for c in names]
            fp = table.column("fp").to_numpy().astype(np.int64)
            u, own, blk = fp.view(np.uint64), table.column("own").to_numpy(), table.column("blk").to_numpy()
            bounds = runs_of(cols)
            sizes = np.diff(bounds)
            at = np.repeat(np.arange(len(sizes)), sizes)
            small = sizes <= 32
            found = []
            for d in range(1, int(sizes[small].max(initial=1))):  # small groups together: rows d apart
                i = np.flatnonzero((at[:-d] == at[d:]) & small[at[:-d]])
                if not len(i):
                    break
                ok = (own[i] | own[i + d]) & (np.bitwise_count(u[i] ^ u[i + d]) <= max_bits)
                found.append((fp[i[ok]], fp[i[ok] + d]))
            for g in np.flatnonzero(~small):
                s, e = bounds[g], bounds[g + 1]
                bi, bj = cols[2][s], cols[3][s]
                rows = np.arange(s, e)
                left = rows[own[s:e] & (blk[s:e] == bi)]
                right = rows if bi == bj else rows[blk[s:e] == bj]
                i, j = _near(u[left], u[right], max_bits)
                got = [forest(fp[left[i]], fp[right[j]])]
                if bi != bj:  # the other block's own ones against this one's probes
                    left, right = rows[own[s:e] & (blk[s:e] == bj)], rows[~own[s:e] & (blk[s:e] == bi)]
                    i, j = _near(u[left], u[right], max_bits)
                    got.append(forest(fp[left[i]], fp[right[j]]))
                found += got
            a, b = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            a, b = forest(a, b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def near_links(fps: DataFrame, max_bits: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links between the distinct fingerprints fp whose components are those of all links within max_bits."""
    n, gram = bit_statistics(fps)
    keys = split_hot(keyed(fps, plan(n, gram, max_bits)), ["part", "key"], "fp", block_rows)
    order = ["part", "key", "bi", "bj"]
    rows = keys.select("part", "key", "bi", "bj", "blk", "own", "fp").repartition(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(_links(max_bits), "a long, b long")


def simhash_components(docs: DataFrame, words: int = 3, max_bits: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, fp and component_id, a row for each row of docs."""
    marked, _ = written(with_fingerprints(docs, words))
    fps, _ = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(fps.select("fp"), max_bits, block_rows))
    rooted, _ = written(fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = met(rooted, lowest, ["root"], "fp").select("fp", "component_id")
    return met(marked, ids, ["fp"], "doc_id").select("doc_id", "fp", "component_id")


# --- near-dedup by similarity ---------------------------------------------------------------------------------------------

#: Streams of 64 bits beside the first; parts of all are probed, and candidates are compared on all.
VERIFY_STREAMS = 4
#: The share of pairs at exactly the similarity that may be missed by all probes.
MISSED = 5e-4
#: What a row adds to its shingles in the size of a block of texts that are verified.
ROW_WEIGHT = 500


def differing(similarity: float) -> float:
    """The chance that a bit differs between sets of shingles of this resemblance and of equal size; of others it is less."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def bits_at(similarity: float, bits: int, errors: float) -> int:
    """How many of so many bits differ between sets of shingles of this resemblance, and so many standard errors more, so that
    pairs which have it exactly aren't lost to chance."""
    p = differing(similarity)
    return int(bits * p + errors * np.sqrt(bits * p * (1 - p)))


def short_of(similarity: float) -> int:
    """Up to so many shingles in both texts together, near copies differ in one shingle at most."""
    return int(np.ceil(2 / (1 - similarity) - 1e-9)) - 1


def _digest(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _items(words: int, short: int):
    streams = 1 + VERIFY_STREAMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node: list[int] = []
                less: list[list[int]] = []

                def sets(texts: list[bytes], node=node, less=less) -> Iterator[np.ndarray]:
                    for t in texts:
                        h = shingle_set(t, words)
                        node.append(_digest(h))
                        less.append([_digest(np.delete(h, k)) for k in range(len(h))] if 1 < len(h) <= short else [])
                        yield h

                fps, count = set_fingerprints(sets(binaries(batch.column("text"))), batch.num_rows, streams)
                cols = [pa.array(fps[:, s].view(np.int64)) for s in range(streams)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(node, pa.int64()), pa.array(less, pa.list_(pa.int64())), pa.array(count), *cols], names=["doc_id", "node", "less", "n", "fp", *(f"e{s}" for s in range(1, streams))])

    return run


def _similar(max_bits: int, max_all: int):
    names = ["grp", "part", "key", "bi", "bj"]
    extra = [f"e{s}" for s in range(1, 1 + VERIFY_STREAMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, names, 50_000):
            cols = [table.column(c).to_numpy() for c in names]
            fps = [table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("fp", *extra)]
            node, own, low, blk = (table.column(c).to_numpy() for c in ("node", "own", "low", "blk"))
            bounds = runs_of(cols)
            found = []

            def meet(left: np.ndarray, right: np.ndarray) -> None:
                if not len(left) or not len(right):
                    return
                i, j = _near(fps[0][left], fps[0][right], max_bits)
                i, j = left[i], right[j]
                ok = (low[i] | low[j]) & (node[i] != node[j])
                i, j = i[ok], j[ok]
                total = sum(np.bitwise_count(f[i] ^ f[j]).astype(np.int64) for f in fps)
                ok = total <= max_all
                found.append(forest(node[i[ok]], node[j[ok]]))

            for s, e in zip(bounds, bounds[1:], strict=False):
                rows, bi, bj = np.arange(s, e), cols[3][s], cols[4][s]
                a, b = rows[blk[s:e] == bi], rows[blk[s:e] == bj]
                meet(a[own[a]], b)
                if bi != bj:
                    meet(b[own[b]], a[~own[a]])
            if found:
                a, b = forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _noded(words: int):
    """doc_id, row and the node of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = [_digest(shingle_set(t, words)) for t in binaries(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(node, pa.int64())], names=["doc_id", "row", "node"])

    return run


def _sets(names: list[str], words: int):
    """names and the set of shingles, of the rows whose set is that of their node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in binaries(batch.column("text"))]
            mine = [_digest(h) == n for h, n in zip(sets, batch.column("node").to_pylist(), strict=True)]
            cols = [*(batch.column(n) for n in names), pa.array([h.tobytes() for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "hashes"]).filter(pa.array(mine, pa.bool_()))

    return run


def _verified(similarity: float, max_all: int, short: int):
    names = ["root", "bi", "bj"]
    extra = [f"e{s}" for s in range(1, 1 + VERIFY_STREAMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, names, 2000):
            cols = [table.column(c).to_numpy() for c in names]
            fps = np.stack([table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("fp", *extra)])
            node, n, blk = (table.column(c).to_numpy() for c in ("node", "n", "blk"))
            raw = table.column("hashes")
            sets: dict[int, np.ndarray] = {}

            def hashes(i: int, raw=raw, sets=sets) -> np.ndarray:
                if i not in sets:
                    sets[i] = np.frombuffer(raw[i].as_py(), np.uint64)
                return sets[i]

            out: list[tuple[int, int]] = []
            bounds = runs_of(cols)
            for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                bi, bj = cols[1][s], cols[2][s]
                label = np.arange(e - s)  # of what is linked so far: a pair within one needs no check
                left = np.flatnonzero(blk[s:e] == bi)
                right = np.flatnonzero(blk[s:e] == bj)
                for i in left.tolist():
                    j = right[label[right] != label[i]]
                    if bi == bj:
                        j = j[j > i]
                    m = n[s + j]
                    j = j[np.minimum(m, n[s + i]) >= similarity * np.maximum(m, n[s + i]) - 1e-9]
                    bits = np.bitwise_count(fps[:, s + j] ^ fps[:, s + i, None]).sum(axis=0, dtype=np.int64)
                    ok = (bits <= max_all) | (np.maximum(n[s + j], n[s + i]) <= short)
                    j = j[ok][np.argsort(bits[ok], kind="stable")]
                    for k in j.tolist():
                        if label[k] == label[i]:
                            continue
                        shared = len(np.intersect1d(hashes(s + i), hashes(s + k), assume_unique=True))
                        if shared / (n[s + i] + n[s + k] - shared) >= similarity:
                            label[label == label[k]] = label[i]
                            out.append((node[s + i], node[s + k]))
            if out:
                a, b = forest(*(np.array(x) for x in zip(*out, strict=True)))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, block_rows: int = 2 * BLOCK_ROWS) -> DataFrame:
    """The rows of docs, all columns, that are the first (by doc_id) of their group of near copies.

    Near copies: texts whose sets of shingles of `words` words have a resemblance (Jaccard) of `similarity` or more, and what
    these link. Candidates come from 320 fingerprint bits: the parts of correlated bits that are probed, how long they are and
    up to how many differing bits each, are what the dynamic programme finds cheapest for the number of documents, such that
    at most a share of MISSED of the pairs at the similarity is lost. Each component of candidates is then split by links
    that are checked on the sets themselves, which are made again of its texts. Resemblance also bounds how far the
    numbers of shingles lie apart, so only texts in the same or the next class of lengths meet. Texts of so few shingles that
    one is all they may differ in meet by their sets without one. Texts without words are copies of each other. Rows with a
    null doc_id stay. Of rows that repeat a doc_id and a text (its set) one stays; different texts under an id stay or go each."""
    extra = [f"e{s}" for s in range(1, 1 + VERIFY_STREAMS)]
    short = short_of(similarity)
    kind = "doc_id long, node long, less array<long>, n long, fp long, " + ", ".join(f"{e} long" for e in extra)
    marked, _ = written(docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(_items(words, short), kind))
    # the length class: texts whose numbers of shingles differ by the factor or less are at most one class apart
    size = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / float(-np.log(similarity)) + 1e-9).cast("int")
    items, _ = written(marked.withColumn("cls", size).groupBy("node", "less", "n", "cls", "fp", *extra).agg(F.min("doc_id").alias("first")))
    per = {r["cls"]: r["n"] for r in items.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length class
    pairs = sum(k * (k / 2 + per.get(c + 1, 0)) for c, k in per.items())
    max_bits, max_all = bits_at(similarity, 64, 4.0), bits_at(similarity, 64 * (1 + VERIFY_STREAMS), 4.0)
    both = items.withColumn("grp", F.explode(F.array(F.col("cls") - 1, F.col("cls")))).withColumn("low", F.col("grp") == F.col("cls"))
    order, streams, keys, known = ["grp", "part", "key", "bi", "bj"], ["fp", *extra], [], 0
    n, grams = stream_statistics(items, streams)
    probes = plan_streams(n, grams, differing(similarity), MISSED, pairs, 2)
    for s in sorted({s for s, _, _ in probes}):  # each in its turn takes the place of the first
        turn = dict(zip(streams, streams[s:] + streams[:s], strict=True))
        turned = both.select("grp", "low", "node", *(F.col(t).alias(c) for c, t in turn.items()))
        parts = [(bits, t) for own, bits, t in probes if own == s]
        keys.append(keyed(turned, parts, ["grp", "low", "node", *extra]).withColumn("part", F.col("part") + known))
        known += len(parts)
    keys = split_hot(reduce(DataFrame.union, keys), ["grp", "part", "key"], "node", block_rows)
    rows = keys.select(*order, "blk", "own", "low", "node", "fp", *extra).repartition(*order).sortWithinPartitions(*order)
    near = rows.mapInArrow(_similar(max_bits, max_all), "a long, b long")
    maybe = components(near.union(items.select("node", F.explode("less"))))
    # the texts of each component of candidates, and the links among them that hold
    maybe = maybe.union(maybe.select("root", "root").distinct())
    facts = ["node", "root", "_nb", "n", "fp", *extra]
    asked, _ = written(block_counts(items.join(maybe, "node"), ["root"], block_rows * ROW_WEIGHT, F.col("n") + ROW_WEIGHT).select("first", *facts))
    repeated, _ = written(marked.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    some = not repeated.isEmpty()
    texts = docs.select("doc_id", "text").join(asked, F.col("doc_id") == F.col("first"))
    kind = ", ".join(f"{c} {'int' if c == '_nb' else 'long'}" for c in facts) + ", hashes binary"
    sets = texts.select("text", *facts).mapInArrow(_sets(facts, words), kind)
    order = ["root", "bi", "bj"]
    rows = dealt(sets.dropDuplicates(["node"]) if some else sets, "node").repartition(*order).sortWithinPartitions(*order)
    roots = components(rows.mapInArrow(_verified(similarity, max_all, short), "a long, b long"))
    # of each group the first row stays: an id, and which of its texts
    rooted = items.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min(F.struct("first", "node")).alias("s")).select("s.first", "s.node")
    stays, _ = written(first.select(F.col("first").alias("doc_id"), "node"))
    gone, _ = written(marked.select("doc_id", "node").join(stays, ["doc_id", "node"], "left_anti").select("doc_id").distinct())
    if not some:
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    single = docs.join(gone.union(repeated).distinct(), "doc_id", "left_anti").select(*docs.columns)
    several = docs.select("doc_id", "text", F.struct("*").alias("row")).join(repeated, "doc_id", "left_semi").select("doc_id", "text", "row")
    kind = StructType([*several.select("doc_id", "row").schema, StructField("node", LongType())])
    several = several.mapInArrow(_noded(words), kind).join(stays, ["doc_id", "node"], "left_semi").dropDuplicates(["doc_id", "node"])
    return single.unionByName(several.select("row.*")).select(*docs.columns)


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_components(read(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
