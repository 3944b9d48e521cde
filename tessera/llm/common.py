"""What several operators share: scratch tables, digests, grouped Arrow streams and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch that goes to a Python worker; a worker holds a few such batches, whatever the length of texts.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to ours; a lower one stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is set and all runs on one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch_path(spark: SparkSession) -> str:
    path = f"{scratch_root(spark)}/tessera-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Scratch tables made within are removed at the end; those named in the list it gives stay. Without it, the tables that a
    result reads stay until the cluster's folder is emptied."""
    made: list[str] = []
    keep: list[str] = []
    token = _made.set(made)
    try:
        yield keep
    finally:
        _made.reset(token)
        for path in made:
            if path not in keep:
                dropped(spark, path)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, which cuts its lineage, and the table's path."""
    spark = df.sparkSession
    small_batches(spark)
    pa.default_memory_pool().release_unused()  # what Arrow holds in the driver for nothing
    path = scratch_path(spark)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a scratch table which nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def binaries(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of about so many rows that end where a group of equal keys ends; the input is sorted by keys."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cols = [table.column(k).to_numpy() for k in keys]
        same = np.ones(n, dtype=bool)
        for c in cols:
            same &= c == c[-1]
        cut = n - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
            held, n = table.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def runs_of(cols: list[np.ndarray]) -> np.ndarray:
    """Starts of the groups of equal rows, and the end."""
    n = len(cols[0])
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between numbers: a star for each connected group, as (member, smallest member)."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        while (label != (up := label[label])).any():
            label = up
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


#: Groups over the limit that are broadcast; with more of them, rows and groups meet by a shuffle.
BROADCAST_GROUPS = 100_000


def block_counts(df: DataFrame, keys: list[str], limit: int, weight: Column | None = None) -> DataFrame:
    """Adds _nb: in how many blocks of about `limit` rows (or weight) the group of keys is cut. All rows are counted; only
    counts are moved, unless there are very many large groups."""
    hot = df.groupBy(*keys).agg(F.sum(F.lit(1) if weight is None else weight).alias("_n")).where(F.col("_n") > limit)
    hot, _ = written(hot.select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_nb")))
    if hot.count() <= BROADCAST_GROUPS:
        hot = F.broadcast(hot)
    return df.join(hot, keys, "left").withColumn("_nb", F.coalesce("_nb", F.lit(1)))


def dealt(df: DataFrame, spread: str) -> DataFrame:
    """Deals the rows of block_counts to pairs of blocks (bi, bj) by the hash of `spread`; blk is the row's own block."""
    out = df.withColumn("blk", F.pmod(F.xxhash64(spread), F.col("_nb")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return out.withColumn("bi", F.least("blk", "_o")).withColumn("bj", F.greatest("blk", "_o")).drop("_nb", "_o")


def split_hot(df: DataFrame, keys: list[str], spread: str, limit: int) -> DataFrame:
    """Gives every row blocks (bi, bj) so that no group of (keys, bi, bj) has many more than two times limit rows and each
    two rows of a group meet in exactly one of them or, in one block, in (b, b). Adds blk, the row's own block.

    Groups within the limit have the one block (0, 0). A larger one is cut by the hash of `spread` into n blocks, and a row
    goes to the n pairs with its block. The larger groups are counted over all rows; none is capped."""
    return dealt(block_counts(df, keys, limit), spread)


#: Rows of one key that a task joins; more are dealt to several. Keys with more rows than that and than a MOST_HOT-th of all
#: rows are broadcast, so that there are fewer than MOST_HOT of them at any size.
HOT_ROWS = 256
MOST_HOT = 10_000


def met(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "inner", counted: DataFrame | None = None, rows: int | None = None, limit: int = HOT_ROWS) -> DataFrame:
    """left joined with right, which has one row a key at most, on keys that aren't null. A key with very many rows on the left
    is cut by the hash of `spread`, and its row on the right is copied to each piece, so that no task has a whole hot key.
    counted: the keys of left's rows, where these are at hand without the rest of left."""
    counted = left if counted is None else counted
    bound = max(limit, (counted.count() if rows is None else rows) // MOST_HOT)
    hot = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bound)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("_n") / bound).cast("int").alias("_nb")))
    a = left.join(hot, keys, "left").withColumn("_s", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_nb")), F.lit(0)).cast("int")).drop("_nb")
    b = right.join(hot, keys, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_nb", F.lit(1)) - 1))).drop("_nb")
    return a.join(b, [*keys, "_s"], how).drop("_s")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for all nodes of the links (a, b) that aren't their own root.

    Alternating large and small stars: each round links every node's larger neighbours, then its smaller ones, to the
    smallest one near it, until nothing changes. Minima are aggregated before the shuffle, and the links of a node that has
    very many are cut where they meet its minimum, so that no node lands in a single task; each round is a table in the
    shared folder."""
    spark = edges.sparkSession
    e, path = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    old = mark(e)
    while old[0]:
        both = e.union(e.select("b", "a"))
        most = both.groupBy("a").count().agg(F.max("count")).first()[0]
        hot = most > max(HOT_ROWS, 2 * old[0] // MOST_HOT)  # the joins are the same with and without
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        near = met(both, low, ["a"], "b", rows=2 * old[0]) if hot else both.join(low, "a")
        large, large_path = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), None
        if hot:
            large, large_path = written(large)
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        near = met(large, low2, ["a"], "b") if hot else large.join(low2, "a")
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(low2).distinct()
        e, new_path = written(small)
        new = mark(e)
        for gone in (path, large_path):
            if gone:
                dropped(spark, gone)
        path = new_path
        if new == old:
            break
        old = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
