"""Language identification by hierarchical discrimination.

A text is the square roots of the shares of its pairs of neighbouring symbols (letters A-Z folded, bytes of other letters,
all else one break). Language families are told apart first, by one-versus-one linear support vector machines; then further
ones, one for each pair of closely related languages, choose within the family. Families: those of FAMILIES; a language not
listed there is a family of its own. Of each level, the class with the most pairwise wins is taken, ties by the sum of
margins, then by name. The score is the product of the two levels' least confidences, each a logistic function of the margin
in units of that machine's usual margin.

Learning uses text and non-null lang only, of rows that aren't held out, up to SAMPLE documents (about) of each of the LANGUAGES
most frequent languages by a hash of doc_id and text; the whole text of each, equal texts of a language once. Null texts and texts without a letter are `und` with score 0. Empty tables, or none
with a language, make every text `und`. Repeated rows are judged each, very long texts whole. With one language learned, every text with a letter gets it with score 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Documents of a language that the machines learn from, about, and languages that are learned at most, the most frequent ones.
SAMPLE = 500
LANGUAGES = 64

#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}

#: Symbols: 0 a break, 1 to 26 the letters, 27 any leading byte, 28 to 59 the following bytes of other letters, two each.
_SYMBOLS = 60
_CLASS = np.zeros(256, dtype=np.int64)
for _b in range(256):
    if _b >= 0xC0:
        _CLASS[_b] = 27
    elif _b >= 0x80:
        _CLASS[_b] = 28 + (_b & 0x1F)
    elif chr(_b).isalpha():
        _CLASS[_b] = ord(chr(_b).lower()) - 96


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), f"({lang})")


def vector(text: bytes) -> np.ndarray:
    """Of unit length, or zero where the text has fewer than one pair with a letter."""
    c = _CLASS[np.frombuffer(b" " + text + b" ", dtype=np.uint8)]
    hist = np.bincount(c[:-1] * _SYMBOLS + c[1:], minlength=_SYMBOLS * _SYMBOLS)
    hist[0] = 0
    total = hist.sum()
    return np.sqrt(hist / total) if total else hist.astype(float)


def has_letter(text: str | None) -> bool:
    return bool(text) and (re.search("[A-Za-z]", text) is not None or any(map(str.isalpha, text)))


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12) -> tuple[np.ndarray, float, float]:
    """Weights, bias and usual margin of a linear machine, by dual coordinate descent on the hinge loss; classes weigh the same."""
    cost = np.where(y > 0, c * len(y) / (2 * (y > 0).sum()), c * len(y) / (2 * (y < 0).sum()))
    norm, alpha = np.einsum("ij,ij->i", x, x, dtype=float) + 1, np.zeros(len(y))  # one more, constant feature is the bias
    w, bias = np.zeros(x.shape[1]), 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i] + bias) - 1) / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * x[i]
                bias += step
                alpha[i] = new
    margins = np.concatenate([x[s : s + 256] @ w for s in range(0, len(x), 256)])  # x as doubles a few rows at a time
    usual = float(np.median(np.abs(margins + bias))) or 1.0
    return w, bias, usual


class Machines:
    """One-versus-one machines between named classes."""

    def __init__(self, x: np.ndarray, names: np.ndarray):
        self.names = sorted(set(names.tolist()))
        self.pairs = list(combinations(range(len(self.names)), 2))
        fitted = []
        for a, b in self.pairs:
            rows = (names == self.names[a]) | (names == self.names[b])
            fitted.append(svm(x[rows], np.where(names[rows] == self.names[a], 1.0, -1.0)))
        self.w = np.array([w for w, _, _ in fitted]).reshape(len(fitted), x.shape[1])
        self.b = np.array([b for _, b, _ in fitted])
        self.usual = np.array([u for _, _, u in fitted])

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each row, and the least confidence among the winner's machines."""
        n, k = len(x), len(self.names)
        if not self.pairs:
            return np.zeros(n, dtype=int), np.ones(n)
        margin = (x @ self.w.T + self.b) / self.usual
        wins, sums = np.zeros((n, k)), np.zeros((n, k))
        for j, (a, b) in enumerate(self.pairs):
            wins[:, a] += margin[:, j] > 0
            wins[:, b] += margin[:, j] <= 0
            sums[:, a] += margin[:, j]
            sums[:, b] -= margin[:, j]
        best = np.array([max(range(k), key=lambda c, i=i: (wins[i, c], sums[i, c], -c)) for i in range(n)]) if k > 2 else np.argmax(wins, axis=1)
        least = np.full(n, np.inf)
        for j, (a, b) in enumerate(self.pairs):
            signed = np.where(best == a, margin[:, j], np.where(best == b, -margin[:, j], np.inf))
            least = np.minimum(least, signed)
        return best, 1 / (1 + np.exp(-np.clip(4 * least, -50, 50)))


class Hierarchy:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        families = np.array([family_of(g) for g in langs.tolist()])
        self.families = Machines(x, families)
        self.within = [Machines(x[families == f], langs[families == f]) for f in self.families.names]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, sure = self.families.choose(x)
        langs = np.empty(len(x), dtype=object)
        for f, machines in enumerate(self.within):
            rows = np.flatnonzero(family == f)
            if len(rows):
                best, least = machines.choose(x[rows])
                langs[rows] = [machines.names[b] for b in best]
                sure[rows] *= least
        return langs.tolist(), sure


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _packed(x: np.ndarray) -> bytes:
    """Places and values of what isn't zero, an eighth of the whole vector for usual texts."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].tobytes()


def _unpacked(raw: list[bytes]) -> np.ndarray:
    x = np.zeros((len(raw), _SYMBOLS**2), dtype="<f4")
    for row, r in zip(x, raw, strict=True):
        n = len(r) // 6
        row[np.frombuffer(r, "<u2", count=n)] = np.frombuffer(r, "<f4", offset=2 * n)
    return x


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, rows = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if has_letter(text):
                langs.append(lang)
                rows.append(_packed(vector(text.encode()).astype("<f4")))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], names=["lang", "x"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Hierarchy | None:
    """From the rows given that have a language."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    shares = [(r["lang"], min(1.0, sample / r["n"])) for r in sizes]
    if not shares:
        return None
    share = F.coalesce(*(F.when(F.col("lang") == g, F.lit(p)) for g, p in shares), F.lit(0.0))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20))
    got = chosen.select("lang", "text").mapInArrow(_vectors, "lang string, x binary").distinct().toArrow()
    if not got.num_rows:
        return None
    langs, rows = np.array(got.column("lang").to_pylist()), got.column("x").to_pylist()
    # the order of rows mustn't matter: they are sorted by language and vector, on the driver, where the sample is bounded
    x, at = np.empty((len(rows), _SYMBOLS**2), dtype="<f4"), 0
    for g in sorted(set(langs.tolist())):
        part = _unpacked([rows[i] for i in np.flatnonzero(langs == g)])
        x[at : at + len(part)] = part[sorted(range(len(part)), key=[r.tobytes() for r in part].__getitem__)]
        at += len(part)
    langs.sort()
    return Hierarchy(x, langs)


def _predicted(names: list[str], model: Hierarchy | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            for s in range(0, len(rows), 1000):
                part = rows[s : s + 1000]
                got, sure = model.predict(np.array([vector(texts[i].encode()) for i in part]))
                scores[part] = sure
                for i, g in zip(part, got, strict=True):
                    langs[i] = g
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(langs, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """All columns of docs but those named as ours, and lang_pred and score; only text is looked at."""
    docs = docs.drop("lang_pred", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_predicted(docs.columns, model), f"{fields}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Hierarchy | None, min_score: float) -> DataFrame:
    """The rows of docs, all columns whatever their names, whose language is not `und` and scores at least so much."""
    judge = _predicted([], model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = next(judge(iter([batch])))
                sure = (found.column("score").to_numpy() >= min_score) & np.array([g != "und" for g in found.column("lang_pred").to_pylist()])
                yield batch.filter(pa.array(sure))

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows that aren't held out."""
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()), sample)
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return language_id(read(spark, folder, "documents"))
