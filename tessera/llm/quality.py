"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a fixed row of statistics (lengths, shares of kinds of characters, word and line repetition), transformed by
logarithms and logits. Counts, sums and sums of products by class are added up over all labelled rows, so nothing is
sampled; the statistics are standardised, each class covariance is shrunk towards a multiple of the identity, and its Cholesky
factor is computed once and goes to the executors. A score is the class posterior from the difference of the two Mahalanobis
log densities.

Null text is empty; empty texts are scored like any other, very long ones are measured whole; repeated rows are scored each,
equal statistics alike; an empty table gives no rows. Labels that are null, or neither 0 nor 1, aren't learned from; a
doc_id with several labels counts with each. Where a class has fewer than two rows, every score is the share of label 1 (a
half, without any labels).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, read, written

#: Share of the identity in a class covariance, and the score from which label 1 is predicted.
SHRINKAGE = 0.05
THRESHOLD = 0.3

NAMES = ("length", "capitals", "punctuation", "symbols", "digits", "spaces", "other", "word", "distinct", "marked", "triples", "line", "lines", "entropy", "short", "doubled")

_KIND = np.zeros((256, 8))
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = [_c.isascii() and _c.islower(), _c.isascii() and _c.isupper(), _c in ".,;:'\"-?()", _b < 128 and _c.isprintable() and not _c.isalnum() and _c not in ".,;:'\"-?() ", _c.isascii() and _c.isdigit(), _c in " \t\n\r\x0b\x0c", _b >= 128, _b < 32 and _c not in " \t\n\r\x0b\x0c"]


def _share(part: float, whole: float, usual: float, weight: float) -> float:
    """Logit of a share, drawn to the usual one by so many further characters or words, so that a short text is unremarkable."""
    p = (part + weight * usual) / (whole + weight)
    return math.log(p / (1 - p))


def statistics(text: bytes) -> list[float]:
    hist = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    lower, upper, marks, symbols, digits, spaces, other, control = (hist @ _KIND).tolist()
    n = len(text)
    words = text.split()
    lines = text.split(b"\n")
    k, m = len(words), len(lines)
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    p = hist[hist > 0] / max(n, 1)
    entropy = -float((p * np.log(p)).sum())
    plain = sum(w[-1:].isalnum() or w[-1] in b".,;:?)'\"" or w[-1] >= 128 for w in words)
    short = sum(len(w) <= 3 for w in words)
    return [
        math.log(n + 300),
        _share(upper, upper + lower, 0.03, 100),
        _share(marks, n, 0.02, 100),
        _share(symbols + control, n, 0.005, 100),
        _share(digits, n, 0.005, 100),
        _share(spaces, n, 0.16, 100),
        _share(other, n, 0.03, 100),
        math.log((n - spaces + 5 * 20) / (k + 20)),
        _share(k - len(set(words)), k, 0.1, 20),
        _share(k - plain, k, 0.01, 20),
        _share(max(k - 2 - triples, 0), max(k - 2, 0), 0.01, 20),
        math.log(n / m + 100),
        _share(m - len(set(lines)), m, 0.02, 5),
        (entropy * n + 2.9 * 200) / (n + 200),
        _share(short, k, 0.33, 20),
        _share(sum(map(bytes.__eq__, words, words[1:])), max(k - 1, 0), 0.005, 20),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in binaries(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "stats"])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats."""
    return docs.select("doc_id", "text").mapInArrow(_measured, "doc_id long, stats array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(NAMES))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class: 1, the statistics, and their products, summed."""
    d = len(NAMES) + 1
    total = {0: np.zeros((d, d)), 1: np.zeros((d, d))}
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = _matrix(batch), batch.column("quality").to_numpy(zero_copy_only=False)
        for c, t in total.items():
            z = np.hstack([np.ones((int((y == c).sum()), 1)), x[y == c]])
            t += z.T @ z
    for c, t in total.items():
        cells = np.arange(d * d, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, c, np.int32)), pa.array(cells), pa.array(t.ravel())], names=["quality", "cell", "s"])


class Discriminant:
    """The fitted classes: standardisation, means, Cholesky factors, log priors."""

    def __init__(self, sums: dict[int, np.ndarray], shrinkage: float = SHRINKAGE):
        n = {c: s[0, 0] for c, s in sums.items()}
        whole = sums[0] + sums[1]
        self.prior = (n[1] + 1e-12) / (n[0] + n[1] + 2e-12) if n[0] + n[1] else 0.5
        self.classes = None
        if min(n.values()) < 2:
            return
        self.mean = whole[0, 1:] / whole[0, 0]
        self.scale = np.sqrt(np.maximum(np.diag(whole)[1:] / whole[0, 0] - self.mean**2, 1e-12))
        self.classes = []
        for c in (0, 1):
            mu = (sums[c][0, 1:] / n[c] - self.mean) / self.scale
            raw = sums[c][1:, 1:] / n[c] - np.outer(sums[c][0, 1:], sums[c][0, 1:]) / n[c] ** 2
            cov = raw / np.outer(self.scale, self.scale)
            size = max(np.trace(cov) / len(mu), 1e-6)
            root = np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * size * np.eye(len(mu)))
            self.classes.append((mu, np.linalg.inv(root), float(np.log(np.diag(root)).sum()), math.log(n[c] / (n[0] + n[1]))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.prior)
        z = (x - self.mean) / self.scale
        log = [prior - size - 0.5 * (((z - mu) @ inverse.T) ** 2).sum(axis=1) for mu, inverse, size, prior in self.classes]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(measured: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """From all rows of (doc_id, stats) that have a label (doc_id, quality)."""
    known = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = measured.join(known, "doc_id").select("quality", "stats").mapInArrow(_summed, "quality int, cell int, s double")
    d = len(NAMES) + 1
    sums = {0: np.zeros(d * d), 1: np.zeros(d * d)}
    for r in rows.groupBy("quality", "cell").agg(F.sum("s").alias("s")).collect():  # two matrices at any size
        sums[r["quality"]][r["cell"]] = r["s"]
    return Discriminant({c: s.reshape(d, d) for c, s in sums.items()}, shrinkage)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def score(measured: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(_matrix(batch)))], names=["doc_id", "score"])

    return measured.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from the labels of rows that aren't held out."""
    measured, _ = written(with_statistics(docs))
    model = fit(measured.where(~F.coalesce(held_out(), F.lit(False))), labels)
    out = score(measured, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score at least the threshold. The texts stay where they are: only their statistics
    are written and gathered, and each text is measured again as it is judged."""
    measured, _ = written(with_statistics(docs))
    model = fit(measured.where(~F.coalesce(held_out(), F.lit(False))), labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t) for t in binaries(batch.column("text"))])
                kept = batch.filter(pa.array(model.scores(x) >= threshold))
                yield pa.RecordBatch.from_arrays([kept.column(n) for n in names], names=names)

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return classify(read(spark, folder, "documents"), read(spark, folder, "labels"))
