import inspect
import random

from pyspark.sql import functions as F

import corpus_pipeline as P
import __spark_entry__ as entry
from tessera.llm import queries
from tessera.llm.common import written

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.queries()}
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries()) and set(queries.oracle_sql()) <= set(entry.oracle_sql())
    assert [n for n, _ in P.STAGES] == ["quality", "language", "lines", "near_copies", "packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in P.STAGES)


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    columns, ids = docs.columns, [r["doc_id"] for r in docs.collect()]
    for name, stage in P.STAGES[:-1]:
        out, _ = written(stage(spark, docs, FOLDER))
        assert out.columns == columns and out.dtypes == docs.dtypes
        before, ids = ids, [r["doc_id"] for r in out.collect()]
        assert set(ids) <= set(before) and len(ids) == len(set(ids))
        if name == "quality":
            good = [i for i in before if labels.get(i) == 1]
            assert sum(i in set(ids) for i in good) >= 0.95 * len(good)
            assert sum(i in set(ids) for i in before if labels.get(i) == 0) <= 0.2 * sum(labels.get(i) == 0 for i in before)
        if name in ("language", "lines"):
            assert len(ids) >= 0.99 * len(before)
        docs = out
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = {i: t.lower().split() for i, t in texts.items()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    near = [(a, b) for a in shingles for b in shingles if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    assert near == []
    pieces = P.packed(spark, docs, FOLDER).collect()
    assert {p["doc_id"] for p in pieces} == set(texts)


CLASHES = ("_t1", "_t2", "_gone", "_s", "_nb", "n_lines", "n_dropped", "kept_text", "score", "lang_pred", "count", "fp", "node", "root", "first", "row", "quality", "stats", "n", "sequence_id")


def test_stages_keep_every_column(spark, docs):
    """Names that the operators use themselves; nulls, empty and repeated rows, and an empty table, through each stage."""
    rng = random.Random(3)
    texts = [f"All rights reserved\nown words {i} " + " ".join(f"w{rng.randrange(900)}" for _ in range(40)) for i in range(12)]
    rows = [*enumerate(texts), (3, texts[3]), (20, None), (21, ""), (None, "a null id of its own"), (None, None), (22, texts[5]), (23, "x" * 200_000)]
    d = docs(rows)
    for c in CLASHES:
        d = d.withColumn(c, F.lit(f"my {c}"))
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, d.limit(0), FOLDER).collect() == []
        out = stage(spark, d, FOLDER)
        assert out.columns == d.columns and out.dtypes == d.dtypes
        got = out.collect()
        assert got and all(r[c] == f"my {c}" for r in got for c in CLASHES), name
        ids = [r["doc_id"] for r in got]
        assert {i for i in ids if i is not None} <= {i for i, _ in rows}
        if name == "language":
            assert None in ids and not {20, 21} & set(ids)
        if name == "lines":
            assert len(got) == len(rows) and not any("rights" in (r["text"] or "") for r in got)
        if name == "near_copies":
            assert ids.count(None) == 2 and ids.count(3) == 1 and 22 not in ids and {20, 21} & set(ids) == {20}
    pieces = P.packed(spark, d, FOLDER).collect()
    assert sum(p["doc_tokens"] for p in pieces if p["start"] == 0 and p["doc_id"] is None) > 2
    assert {p["doc_id"] for p in pieces} == {i for i, _ in rows}
    assert P.packed(spark, d.limit(0), FOLDER).collect() == []


def test_near_copies_are_those_of_brute_force(spark, docs):
    """Of texts that share more or fewer shingles, one of each component of the links at 0.8 stays."""
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        base = [f"v{rng.getrandbits(40)}" for _ in range(rng.choice([8, 30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3])):
            k = max(1, int(len(base) * rng.choice([0.02, 0.05, 0.1, 0.11, 0.13, 0.3])))
            texts.append(" ".join([*base[:-k], *(f"v{rng.getrandbits(40)}" for _ in range(k))]))
    words = [t.split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in words]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    got = P.one_of_near_copies(spark, docs(texts), FOLDER).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(root))


def test_line_stage_takes_frequent_lines_away(docs):
    rng = random.Random(1)
    d = docs([f"All rights reserved\nown {i} {rng.random()}" for i in range(12)])
    got = P.without_frequent_lines(d.sparkSession, d, FOLDER).collect()
    assert all(r["text"].startswith("own") and r["n_chars"] == len(r["text"]) for r in got)


def test_language_stage_rejects_what_has_none(docs):
    d = docs([f"the words of number {'a' * i} are here" for i in range(9)] + ["123", ""])
    assert sorted(r["doc_id"] for r in P.known_language(d.sparkSession, d, FOLDER).collect()) == list(range(9))


def test_run(spark):
    assert P.run(spark, FOLDER).count() > 0
