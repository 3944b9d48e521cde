"""Extra columns, with the names that operators use themselves, change nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, embedding_dedup, language, licenses, packing, quality, simhash, token_counts

from .conftest import EDGES

NAMES = ("fp", "node", "root", "first", "n", "n_tokens", "n_bytes", "ids", "decoded", "licenses", "length", "task", "number", "sequence_id", "offset", "start", "stats", "score", "held_out", "quality", "lang_pred", "key", "grp", "code", "d", "d1", "x", "block", "copy", "query", "tau", "rank", "w", "_n", "_nb", "_s")


def plain(rows):
    return sorted((tuple(str(v) for v in r) for r in rows), key=repr)


def with_clashes(df):
    return df.select("*", *(F.lit(f"my {c}").alias(c) for c in NAMES if c not in df.columns))


@pytest.mark.parametrize("run", [token_counts.token_counts, lambda d: bpe.decode(bpe.encode(d)), lambda d: packing.pack(d).select("doc_id", "start", "length", "ids_crc32"), simhash.simhash_components, licenses.license_scan, language.language_id])
def test_documents(docs, run):
    d = docs([*EDGES, "a text of some words here", "a text of some words here"])
    assert plain(run(with_clashes(d)).collect()) == plain(run(d).collect())


def test_quality(spark, docs):
    d = docs(EDGES)
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    assert plain(quality.classify(with_clashes(d), with_clashes(labels)).collect()) == plain(quality.classify(d, labels).collect())


@pytest.mark.parametrize("run", [embedding_dedup.embedding_dedup, lambda v: ann.nearest(v, 3, 2)])
def test_vectors(spark, run):
    x = np.random.default_rng(1).standard_normal((30, 8)).tolist()
    v = spark.createDataFrame([(i, e, i % 2) for i, e in enumerate([*x, x[0], x[2]])], "vec_id long, embedding array<float>, label int")
    assert plain(run(with_clashes(v)).collect()) == plain(run(v).collect())
