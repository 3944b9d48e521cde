"""Parts written chunk by chunk: complete, too long, or closed too early."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def completion(chunks: DataFrame) -> DataFrame:
    """name, part, declared, written, status of chunks that have all arrived: complete, overrun or short."""
    got = chunks.groupBy("name", "part").agg(F.max("declared").alias("declared"), F.sum("length").alias("written"))
    status = F.when(F.col("written") > F.col("declared"), "overrun").when(F.col("written") == F.col("declared"), "complete").otherwise("short")
    return got.withColumn("status", status)


def _spool(spark: SparkSession) -> str:
    """A folder under the cluster's shared one, which tasks see as a path."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="tessera-")
    return os.path.join(root.removeprefix("file://"), f"tessera-chunks-{uuid.uuid4().hex}")


def _digest(path: str, n: int) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while n and (piece := f.read(min(n, 1 << 20))):
            h.update(piece)
            n -= len(piece)
    return "sha256:" + h.hexdigest()


def sink(chunks: DataFrame, timeout_ms: int = 60_000, folder: str | None = None) -> DataFrame:
    """The same over a stream of (name, part, seq, declared, content), with the digest of complete parts.

    For each part the state is what was declared and written, the next chunk's number, and the chunks that came before their
    turn; those whose turn it was are in a file of the part in `folder` (shared by all tasks), each at its offset, so that a batch
    which is run again writes the same bytes to the same place. A part that got more than declared is an overrun; one without
    news for timeout_ms is short. Each part reports once, and its file goes."""
    folder = folder or _spool(chunks.sparkSession)
    out = "name string, part string, declared long, written long, status string, digest string"
    state = "declared long, written long, next long, early array<struct<seq: long, content: binary>>"

    def step(key: tuple, frames: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda declared, written, status, digest=None: pd.DataFrame([{"name": key[0], "part": key[1], "declared": declared, "written": written, "status": status, "digest": digest}])
        path = os.path.join(folder, hashlib.sha256(f"{len(key[0])}/{key[0]}/{key[1]}".encode()).hexdigest())

        def done(*report) -> Iterator[pd.DataFrame]:
            if st.exists:
                st.remove()
            if os.path.exists(path):
                os.remove(path)
            yield row(*report)

        if st.hasTimedOut:
            declared, written, *_ = st.get
            yield from done(declared, written, "short")
            return
        declared, written, turn, early = st.get if st.exists else (None, 0, 0, [])
        waiting = {e["seq"] if isinstance(e, dict) else e[0]: e["content"] if isinstance(e, dict) else e[1] for e in early or []}
        for frame in frames:
            for r in frame.itertuples(index=False):
                declared = int(r.declared) if declared is None else declared
                if int(r.seq) >= turn:
                    waiting[int(r.seq)] = bytes(r.content)
        if turn in waiting:
            os.makedirs(folder, exist_ok=True)
            with open(path, "r+b" if written and os.path.exists(path) else "wb") as f:
                f.seek(written)
                while turn in waiting and written <= declared:
                    piece = waiting.pop(turn)
                    f.write(piece)
                    written += len(piece)
                    turn += 1
        if written > declared:
            yield from done(declared, written, "overrun")
        elif written == declared:
            yield from done(declared, written, "complete", _digest(path, written) if written else "sha256:" + hashlib.sha256().hexdigest())
        else:
            st.update((declared, written, turn, sorted(waiting.items())))
            st.setTimeoutDuration(timeout_ms)

    return chunks.groupBy("name", "part").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout)
