"""Embedding near-dedup by iterative quantisation.

Vectors that are not null, zero, or with null or non-finite components, and whose label is not null, are compared with those
of the same label and length by cosine in double precision. Exact copies are one class with a weight. On a bounded sample the
quantiser is learned: principal directions, then a rotation that alternates with the signs it gives, so that the bits of the
binary code are balanced. Codes go to multi-index Hamming tables: each of four tables has 16 of their bits. In each, a class is
kept under its own bits and looks also where up to three of them are flipped, those on which its coordinates are so near zero
that the sum of their squares is within a small budget: two vectors whose cosine is enough can't lie far apart on a coordinate.
Layout and budget are the same at every size, so what two vectors are to each other doesn't depend on how many others there are.

First only codes meet: a row of a bucket goes on if its code lies within MAX_BITS of another's there. Only what goes on gets its
vector, and is compared by cosine. A pair that meets in several buckets counts in the first of them; what leaves a task are
counts of links and a spanning star of each connected group, never the pairs of a group. Buckets larger than a block are cut
into blocks every two of which meet, so nothing is capped.

A vector that is not compared has n_links 0 and is its own component. Rows with the same vec_id are vectors of their own that
share a component. Empty tables give no rows; other columns are not looked at. A null vec_id is its own null component unless its vector is compared; then it has the component of what
it links to, and is never chosen as the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, forest, met, read, runs_of, split_hot, whole_groups, written
from .vectors import packed, unpacked, usable

MIN_COSINE = 0.98
#: Vectors, about, that the rotation is learned from.
SAMPLE = 20_000
#: Rows of a bucket's block, at least and at most: a 64th of the classes in between. How rows are dealt to blocks changes no result.
BLOCK_ROWS = (128, 2048)
#: Tables of 16 bits each, flips of a class in one, and the budget of squared coordinates for them: a tenth of what two vectors
#: at the least cosine differ by in 16 of their coordinates on average.
TABLES, WIDTH, FLIPS, SPENT = 4, 16, 3, 0.1
#: Codes that differ in more bits aren't compared: five standard errors above what is usual at a cosine of 0.98.
MAX_BITS = 20
#: The budget in the unit in which squared coordinates are kept.
BUDGET = 4096

_FLIPS = [sum(1 << b for b in c) for k in range(1, FLIPS + 1) for c in combinations(range(WIDTH), k)]
_FLIPPED = np.array([[m >> b & 1 for m in _FLIPS] for b in range(WIDTH)], dtype=np.float32)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d1, d2: digest of label and vector, and the vector's length; all null where the vector isn't compared."""
    for batch in batches:
        n = batch.num_rows
        column = batch.column("embedding")
        label = batch.column("label").to_pylist()
        digests: list[bytes | None] = [None] * n
        xs: list[bytes | None] = [None] * n
        ds: list[int | None] = [None] * n
        for d, (rows, x) in usable(column)[1].items():
            x = x + 0.0  # no negative zeros
            for i, raw, kept in zip(rows.tolist(), packed(x), packed(x, column), strict=True):
                if label[i] is not None:
                    digests[i] = xxhash.xxh3_128_digest(f"{label[i]!r} {d} ".encode() + raw)
                    xs[i], ds[i] = kept, d
        halves = [np.frombuffer(g, "<i8").tolist() if g else (None, None) for g in digests]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([h[0] for h in halves], pa.int64()), pa.array([h[1] for h in halves], pa.int64()), pa.array(ds, pa.int32()), pa.array(xs, pa.binary())], names=["vec_id", "label", "d1", "d2", "d", "x"])


class Quantiser:
    """mean-free principal directions and rotation for one vector length: bits of x are the signs of unit(x) @ basis."""

    def __init__(self, x: np.ndarray, bits: int = 64, rounds: int = 30):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = u.shape[1]
        _, _, directions = np.linalg.svd(u.T @ u / len(u))
        c = min(bits, d)
        rng = np.random.default_rng(11)
        first = directions[:c].T
        rotation, _ = np.linalg.qr(rng.standard_normal((c, c)))
        v = u @ first
        for _ in range(rounds):  # signs for the rotation, then the rotation for the signs
            signs = np.where(v @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(v.T @ signs)
            rotation = left @ right
        more = []  # lengths under 64: further rotations of the same directions
        while sum(m.shape[1] for m in more) + c < bits:
            q, _ = np.linalg.qr(rng.standard_normal((c, c)))
            more.append(first @ q)
        self.basis = np.hstack([first @ rotation, *more])[:, :bits]

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True) @ self.basis


def learn(classes: DataFrame, sample: int = SAMPLE) -> dict[int, Quantiser]:
    """For each vector length, a quantiser from about `sample` classes, chosen by digest."""
    sizes = classes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for r in sizes:
        share, mine = min(1.0, sample / r["n"]), classes.where(F.col("d") == r["d"])
        rows = mine.where(F.pmod("d1", F.lit(1 << 20)) < share * (1 << 20)).select("d1", "d2", "x").orderBy("d1", "d2").toArrow()
        if not rows.num_rows:
            rows = mine.select("d1", "d2", "x").orderBy("d1", "d2").limit(1).toArrow()
        out[r["d"]] = Quantiser(unpacked(rows.column("x").to_pylist(), r["d"]))
    return out


def _coded(models: dict[int, Quantiser], min_cosine: float):
    """The code of each class, and its squared coordinates in units of which BUDGET may be flipped in a table."""
    names = ["node", "grp", "w", "d", "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ds = batch.column("x").to_pylist(), batch.column("d").to_numpy()
            codes, margins = np.zeros(len(xs), dtype=np.uint64), np.zeros((len(xs), 64), dtype="<u2")
            for d in np.unique(ds).tolist():
                rows = np.flatnonzero(ds == d)
                v = models[d].coordinates(unpacked([xs[i] for i in rows], d))
                codes[rows] = ((v >= 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                budget = SPENT * (2 - 2 * min_cosine) * WIDTH / min(d, 64)
                margins[rows] = np.minimum(np.ceil(v * v * (BUDGET / max(budget, 1e-12))), BUDGET + 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(codes.view(np.int64)), pa.array([m.tobytes() for m in margins], pa.binary())], names=[*names, "code", "margins"])

    return run


def _margins(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<u2").reshape(len(raw), TABLES, WIDTH)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each table's own bits, and for each further place where a class looks there."""
    names = ["tab", "grp", "key", "own", "node", "code"]
    for whole in batches:
        for s in range(0, whole.num_rows, 4096):
            batch = whole.slice(s, 4096)
            grp, node, code = (batch.column(c).to_numpy() for c in ("grp", "node", "code"))
            margins = _margins(batch.column("margins")).astype(np.float32)
            for t in range(TABLES):
                home = ((code.view(np.uint64) >> np.uint64(WIDTH * t)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
                i, k = np.nonzero(margins[:, t] @ _FLIPPED <= BUDGET)
                at = np.concatenate([np.arange(len(node)), i])
                key = np.concatenate([home, home[i] ^ np.array(_FLIPS)[k]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(grp[at]), pa.array(key), pa.array(np.arange(len(at)) < len(node)), pa.array(node[at]), pa.array(code[at])], names=names)


_PLACE = ["tab", "grp", "key", "bi", "bj"]


def _blocks_of(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(table, rows, other rows, whether these are the same) of each group, the first rows being own ones."""
    cols = [table.column(c).to_numpy() for c in _PLACE]
    own, blk = table.column("own").to_numpy(), table.column("blk").to_numpy()
    bounds = runs_of(cols)
    for s, e in zip(bounds, bounds[1:], strict=False):
        if e - s < 2:
            continue
        rows, bi, bj, t = np.arange(s, e), cols[3][s], cols[4][s], int(cols[0][s])
        if bi == bj:
            mine = rows[own[s:e]]
            yield t, mine, mine, True
            yield t, mine, rows[~own[s:e]], False
        else:
            a, b = rows[blk[s:e] == bi], rows[blk[s:e] == bj]
            yield t, a[own[a]], b, False
            yield t, b[own[b]], a[~own[a]], False


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a bucket whose code lies near another's there, one of the two being an own one."""
    kept = ["tab", "grp", "key", "own", "node"]
    for table in whole_groups(batches, _PLACE, 50_000):
        code = table.column("code").to_numpy().astype(np.int64).view(np.uint64)
        near = np.zeros(len(code), dtype=bool)
        for _, left, right, same in _blocks_of(table):
            for s in range(0, len(left), 1024):
                some = left[s : s + 1024]
                close = np.bitwise_count(code[some, None] ^ code[None, right]) <= MAX_BITS
                if same:
                    close[np.arange(len(some)), s + np.arange(len(some))] = False
                near[some] |= close.any(axis=1)
                near[right] |= close.any(axis=0)
        if near.any():
            yield from table.select(kept).filter(pa.array(near)).to_batches()


def _compared(min_cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, _PLACE, 20_000):
            node, w, own = (table.column(c).to_numpy() for c in ("node", "w", "own"))
            code = table.column("code").to_numpy().astype(np.int64).view(np.uint64)
            raw, ds = table.column("x").to_pylist(), table.column("d").to_numpy()
            margins = _margins(table.column("margins")).astype(np.int64)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            nodes: list[np.ndarray] = []
            links: list[np.ndarray] = []

            def first_here(t: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
                """Of linked rows, the first an own one, whether they meet in no earlier table, and in no other bucket of this
                one that counts before."""
                bits = np.unpackbits((code[i] ^ code[j]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, TABLES, WIDTH)
                few = bits.sum(axis=2) <= FLIPS
                looks_i = few & ((margins[i] * bits).sum(axis=2) <= BUDGET)
                looks_j = few & ((margins[j] * bits).sum(axis=2) <= BUDGET)
                before = (looks_i | looks_j)[:, :t].any(axis=1)
                both = own[j] | looks_i[:, t]  # they meet as own ones, or the other way round in the other's bucket too
                return ~before & (~both | (node[i] < node[j]))

            for t, left, right, same in _blocks_of(table):
                if not len(left) or not len(right):
                    continue
                x, y = (unpacked([raw[i] for i in side], int(ds[left[0]])) for side in (left, right))
                cos = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :]
                i, j = np.nonzero(cos >= min_cosine)
                i, j = left[i], right[j]
                ok = (node[i] != node[j]) & (np.bitwise_count(code[i] ^ code[j]) <= MAX_BITS)
                i, j = i[ok], j[ok]
                for s in range(0, len(i), 200_000):
                    a, b = i[s : s + 200_000], j[s : s + 200_000]
                    ok = first_here(t, a, b)
                    a, b = a[ok], b[ok]
                    found.append(forest(node[a], node[b]))
                    nodes.extend((node[a], node[b]))
                    links.extend((w[b], w[a]))
            if found:
                a, b = forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
                ids, inv = np.unique(np.concatenate(nodes), return_inverse=True)
                sums = np.bincount(inv, weights=np.concatenate(links).astype(float), minlength=len(ids)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(sums)], names=["a", "b", "n"])

    return run


def _met_in_blocks(rows: DataFrame, block_rows: int, *more: str) -> DataFrame:
    keys = split_hot(rows, ["tab", "grp", "key"], "node", block_rows)
    return keys.select(*_PLACE, "blk", "own", "node", "code", *more).repartition(*_PLACE).sortWithinPartitions(*_PLACE)


def embedding_dedup(vectors: DataFrame, min_cosine: float = MIN_COSINE, sample: int = SAMPLE, block_rows: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors."""
    label = vectors.schema["label"].dataType.simpleString()
    marked, _ = written(vectors.select("vec_id", "label", "embedding").mapInArrow(_classes, f"vec_id long, label {label}, d1 long, d2 long, d int, x binary"))
    classes = marked.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("w"), F.min("label").alias("label"), F.min("d").alias("d"), F.min("x").alias("x"))
    classes, _ = written(classes.select("d1", "d2", "low", "w", "d", F.xxhash64("label", "d").alias("grp"), "x"))
    # a class's node is half its digest; where that is another's too, both have one made of the two halves
    shared = F.broadcast(classes.groupBy("d1").count().where("count > 1").select("d1", F.lit(True).alias("twice")))
    node = F.when(F.col("twice"), F.xxhash64("d1", "d2")).otherwise(F.col("d1")).alias("node")
    classes = classes.join(shared, "d1", "left").select(node, "d1", "d2", "low", "w", "d", "grp", "x")
    block_rows = block_rows or min(max(classes.count() // 64, BLOCK_ROWS[0]), BLOCK_ROWS[1])
    models = learn(classes, sample)
    coded, _ = written(classes.select("node", "grp", "w", "d", "x").mapInArrow(_coded(models, min_cosine), "node long, grp long, w long, d int, x binary, code long, margins binary"))
    places, _ = written(coded.select("grp", "node", "code", "margins").mapInArrow(_looked_up, "tab int, grp long, key long, own boolean, node long, code long"))
    close = _met_in_blocks(places, block_rows).mapInArrow(_close, "tab int, grp long, key long, own boolean, node long").distinct()
    close, _ = written(close.join(coded.select("node", "w", "d", "x", "code", "margins"), "node"))
    found, _ = written(_met_in_blocks(close, block_rows, "w", "d", "x", "margins").mapInArrow(_compared(min_cosine), "a long, b long, n long"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("links"))
    rooted, _ = written(classes.select("node", "d1", "d2", "low", "w").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = met(rooted, lowest, ["root"], "node").join(links, F.col("node") == F.col("a"), "left")
    ids, _ = written(ids.select("d1", "d2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links")))
    compared = met(marked.where("d1 IS NOT NULL").select("vec_id", "d1", "d2"), ids, ["d1", "d2"], "vec_id").select("vec_id", "n_links", "component_id")
    alone = marked.where("d1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return compared.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup(read(spark, folder, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / a.n / b.n >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN k ON vec_id = k.a
"""
