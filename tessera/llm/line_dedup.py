"""Line dedup by levelled sorted runs of line hashes.

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both ends with A-Z lower-cased; a key of no code points is no key
and its lines always stay. Keys are compared as 128-bit XXH3 digests. Documents come in batches. Runs are tables sorted and
bucketed by digest, so that they merge-join without moving. The digests of a batch, each with the number of its documents, are
merge-anti-joined with the settled runs (keys already found in `min_docs` documents, which need no more counting) and
merge-joined with the levelled runs: keys that none of them has are new, the others' counts add up to how often each was found
so far. Keys that reach `min_docs` become a settled run, the rest is added as the batch's own run. When a level has `fanout`
runs they are compacted into one of the next level, without what has settled since; so are settled runs. After each batch the
settled runs are exactly the frequent keys of what has come. Their lines then go in every document.

A null text is one empty line and stays null in `line_dedup`; each row counts as a document, also where rows repeat. An empty
table has no lines. Very long texts are split whole; all their lines count once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import binaries, dropped, met, read, scratch_path, written

#: A settled run of up to so many digests (16 bytes each) goes to the executors whole; a larger one is joined by shuffle.
BROADCAST_KEYS = 1_000_000


def _key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes, both touch ASCII only: exactly the six white-space bytes, exactly A-Z


def _digests(text: bytes) -> set[bytes]:
    return {xxhash.xxh3_128_digest(k) for k in {_key(x) for x in text.split(b"\n")} if k}


def _halves(digests: list[bytes]) -> list[pa.Array]:
    pairs = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[int, Counter] = {}
        for b, text in zip(batch.column("batch").to_pylist(), binaries(batch.column("text")), strict=True):
            found.setdefault(b, Counter()).update(_digests(text))
        for b, counts in found.items():
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([b] * len(counts), pa.int32()), *_halves(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["batch", "h1", "h2", "n"])


KEY = ["h1", "h2"]


class Run:
    """A table (h1, h2, n) sorted and bucketed by its digests, in the shared folder."""

    def __init__(self, spark: SparkSession, df: DataFrame, buckets: int):
        self.spark, self.path = spark, scratch_path(spark)
        self.name = self.path.rsplit("/", 1)[1].replace("-", "_")
        dealt = df.repartition(buckets, *KEY)
        dealt.write.partitionBy("settled").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", self.path).saveAsTable(self.name)

    def rows(self, settled: bool) -> DataFrame:
        return self.spark.table(self.name).where(F.col("settled") == settled).drop("settled")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        dropped(self.spark, self.path)


class LineRuns:
    """The levels of sorted runs of digests that are not settled yet, with their counts, and the settled runs. A batch's run
    holds both, told apart by a partition of its table."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[Run]] = []
        self.settled: list[Run] = []
        self.joins = self.compactions = 0

    def _run(self, df: DataFrame) -> Run:
        return Run(self.spark, df, self.buckets)

    def _unsettled(self, df: DataFrame) -> DataFrame:
        for run in self.settled:
            df = df.join(run.rows(True).select(*KEY).hint("merge"), KEY, "left_anti")
            self.joins += 1
        return df

    def add(self, counts: DataFrame) -> None:
        """One batch's digests (h1, h2, n), any number of rows each."""
        fresh = self._unsettled(counts.groupBy(*KEY).agg(F.sum("n").alias("n")))
        total = F.col("n")
        for k, run in enumerate(run for level in self.levels for run in level):
            fresh = fresh.join(run.rows(False).select(*KEY, F.col("n").alias(f"n{k}")).hint("merge"), KEY, "left")
            total += F.coalesce(f"n{k}", F.lit(0))
            self.joins += 1
        run = self._run(fresh.select(*KEY, "n", (total >= self.min_docs).alias("settled")))
        self.settled.append(run)
        self._put(0, run)
        if len(self.settled) > self.fanout:
            self._compact_settled()

    def _put(self, level: int, run: Run) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._compact(runs))

    def _compact(self, runs: list[Run]) -> Run:
        """Runs of a level as one, without the digests that have settled."""
        total = reduce(DataFrame.union, (r.rows(False) for r in runs)).groupBy(*KEY).agg(F.sum("n").alias("n"))
        self.compactions += 1
        out = self._run(self._unsettled(total).withColumn("settled", F.lit(False)))
        self._forget(runs)
        return out

    def _compact_settled(self) -> None:
        runs, self.compactions = self.settled, self.compactions + 1
        self.settled = [self._run(reduce(DataFrame.union, (r.rows(True) for r in runs)).withColumn("settled", F.lit(True)))]
        self._forget(runs)

    def _forget(self, runs: list[Run]) -> None:
        held = [*self.settled, *(r for level in self.levels for r in level)]
        for r in runs:
            if r not in held:
                r.drop()

    def frequent(self) -> DataFrame:
        """All keys found in min_docs documents so far, once each."""
        none = self.spark.createDataFrame([], "h1 long, h2 long")
        return reduce(DataFrame.union, (r.rows(True).select(*KEY) for r in self.settled), none)


def frequent_lines(docs: DataFrame, min_docs: int = 10, n_batches: int = 9, fanout: int = 3) -> DataFrame:
    """(h1, h2) of the keys found in at least min_docs documents."""
    spark = docs.sparkSession
    src = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).cast("int").alias("batch"), "text")
    path = scratch_path(spark)
    kind = "batch int, h1 long, h2 long, n long"
    src.mapInArrow(_counted, kind).write.partitionBy("batch").parquet(path)
    incoming = spark.read.schema(kind).parquet(path)
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(n_batches):
        runs.add(incoming.where(F.col("batch") == b).select(*KEY, "n"))
    out, _ = written(runs.frequent())
    for run in {*runs.settled, *(r for level in runs.levels for r in level)}:
        run.drop()
    dropped(spark, path)
    return out


def _stripped(text: bytes, gone) -> tuple[int, int, bytes]:
    lines = text.split(b"\n")
    kept = [x for x in lines if not (k := _key(x)) or xxhash.xxh3_128_digest(k) not in gone]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _columns(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """The columns of documents, which travel as one where others are beside them, so that no name can clash."""
    if batch.schema.names != ["row", "gone"]:
        return dict(zip(batch.schema.names, batch.columns, strict=True))
    row = batch.column("row")
    return dict(zip((f.name for f in row.type), row.flatten(), strict=True))


def _apply(gone_of, replace: bool):
    """Each row with n_lines, n_dropped and kept_text, or with the kept text in the place of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = _columns(batch)
            text = columns["text"]
            found = [_stripped(t, g) for t, g in zip(binaries(text), gone_of(batch), strict=True)]
            null = text.is_null().to_pylist()
            kept = pa.array([None if z else f[2] for z, f in zip(null, found, strict=True)], pa.binary()).cast(pa.string())
            if replace:
                columns["text"] = kept
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                continue
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), kept], names=[*columns, "n_lines", "n_dropped", "kept_text"])

    return run


def _text_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2) of the text and (h1, h2) of each of its lines, once."""
    for batch in batches:
        seen: dict[bytes, set[bytes]] = {}
        for text in binaries(batch.column("text")):
            if (t := xxhash.xxh3_128_digest(text)) not in seen:
                seen[t] = _digests(text)
        pairs = [(t, h) for t, hs in seen.items() for h in hs]
        if pairs:
            yield pa.RecordBatch.from_arrays([*_halves([t for t, _ in pairs]), *_halves([h for _, h in pairs])], names=["t1", "t2", "h1", "h2"])


def _digested(whole: bool):
    """t1, t2 of the text of each row, and if whole the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                halves = _halves([xxhash.xxh3_128_digest(t) for t in binaries(batch.column("text"))])
                row = [pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)] if whole else []
                yield pa.RecordBatch.from_arrays([*row, *halves], names=["row", "t1", "t2"] if whole else ["t1", "t2"])

    return run


def _stripped_rows(docs: DataFrame, min_docs: int, n_batches: int, fanout: int, broadcast_keys: int, replace: bool) -> DataFrame:
    spark = docs.sparkSession
    own_columns = [] if replace else [StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_text", StringType())]
    out = StructType([*docs.schema, *own_columns])
    gone = frequent_lines(docs, min_docs, n_batches, fanout)
    if gone.count() <= broadcast_keys:
        table = gone.toArrow()
        pairs = np.stack([table.column(c).to_numpy() for c in KEY], axis=1).astype("<i8")
        shared = spark.sparkContext.broadcast(frozenset(p.tobytes() for p in pairs))

        def same(batch: pa.RecordBatch):
            return [shared.value] * batch.num_rows

        return docs.mapInArrow(_apply(same, replace), out)
    lines, _ = written(docs.select("text").mapInArrow(_text_digest, "t1 long, t2 long, h1 long, h2 long").distinct())
    lost, _ = written(met(lines, gone, KEY, "t1").groupBy("t1", "t2").agg(F.collect_list(F.struct(*KEY)).alias("gone")))
    texts, _ = written(docs.select("text").mapInArrow(_digested(False), "t1 long, t2 long"))
    keyed = docs.mapInArrow(_digested(True), StructType([StructField("row", docs.schema), StructField("t1", LongType()), StructField("t2", LongType())]))
    rows = met(keyed, lost, ["t1", "t2"], "row.doc_id", "left", counted=texts).select("row", "gone")

    def own(batch: pa.RecordBatch):
        return [{np.array([h["h1"], h["h2"]], dtype="<i8").tobytes() for h in x or ()} for x in batch.column("gone").to_pylist()]

    return rows.mapInArrow(_apply(own, replace), out)


def line_dedup(docs: DataFrame, min_docs: int = 10, n_batches: int = 9, fanout: int = 3, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, text, and the other columns of docs but those named as ours; n_lines, n_dropped, kept_text.

    Within broadcast_keys settled keys, the executors get them whole and no text is shuffled; beyond, the keys of each
    distinct text are joined with the settled keys and the texts meet what they lose by a shuffled join; hot lines and hot
    texts are cut there. Both ways drop the same lines."""
    return _stripped_rows(docs.drop("n_lines", "n_dropped", "kept_text"), min_docs, n_batches, fanout, broadcast_keys, False)


def without_frequent_lines(docs: DataFrame, min_docs: int = 10, n_batches: int = 9, fanout: int = 3, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of docs, all columns whatever their names, with the kept text in the place of text."""
    return _stripped_rows(docs, min_docs, n_batches, fanout, broadcast_keys, True)


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup(read(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
