import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup as L

from .conftest import EDGES

SPACE = " \t\n\r\x0b\x0c"


def brute(texts, least):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    return [(len(lines := (t or "").split("\n")), len(lines) - len(kept := [x for x in lines if n[key(x)] < least]), "\n".join(kept)) for t in texts]


@pytest.mark.parametrize("limit", [1_000_000, 0])
@pytest.mark.parametrize("batches,fanout", [(4, 4), (5, 2), (1, 3)])
def test_as_brute_force(docs, limit, batches, fanout):
    texts = [f"Head {i % 7}\n  SHARED \t\nown line {i}\n\nshared\n{'x' * (i % 3)}" for i in range(60)] + [e if not isinstance(e, tuple) else e[1] for e in EDGES]
    got = {r["doc_id"]: r for r in L.line_dedup(docs(texts), 9, batches, fanout, limit).collect()}
    for i, (lines, gone, kept) in enumerate(brute(texts, 9)):
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_text"] or "") == (lines, gone, kept)
    assert got[len(texts) - 1]["kept_text"] is None


def test_edges(docs):
    got = L.line_dedup(docs(EDGES), 2).collect()
    assert len(got) == len(EDGES)
    assert sum(r["n_dropped"] for r in got) == 4  # the four lines "a"


def test_empty_and_extra_columns(spark, docs):
    assert L.line_dedup(docs([]), 2).collect() == []
    d = docs(["a\nb"] * 3).withColumn("n_lines", F.lit("mine")).withColumn("h1", F.lit(1.5)).withColumn("batch", F.array(F.lit(1)))
    got = L.line_dedup(d, 3, broadcast_keys=0)
    assert {(r["n_lines"], r["n_dropped"], r["kept_text"], r["h1"]) for r in got.collect()} == {(2, 2, "", 1.5)}


def test_query(spark):
    got = L.op1_line_dedup(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = dict(zip(texts, brute(list(texts.values()), 10), strict=True))
    assert all((r["n_lines"], r["n_dropped"], r["kept_sha256"]) == (*want[r["doc_id"]][:2], hashlib.sha256(want[r["doc_id"]][2].encode()).hexdigest()) for r in got) and len(got) == len(texts)


def test_runs_are_joined_and_compacted(spark, monkeypatch):
    """The registered query's own batches: each is anti-joined with the settled runs, levels are compacted, nothing is left over."""
    made, plans, write = [], [], L.Run.__init__
    start = L.LineRuns.__init__

    def kept(self, *args):
        start(self, *args)
        made.append(self)

    def seen(self, spark, df, buckets):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(self, spark, df, buckets)

    monkeypatch.setattr(L.LineRuns, "__init__", kept)
    monkeypatch.setattr(L.Run, "__init__", seen)
    L.op1_line_dedup(spark, "/root/testdata/sf0.001").count()
    (runs,) = made
    assert runs.joins >= 8 and runs.compactions >= 4 and len(runs.levels) >= 3
    anti = [p for p in plans if "SortMergeJoin" in p and "LeftAnti" in p]
    assert len(anti) >= 8
    assert not spark.catalog.listTables()  # runs are dropped when the keys are known


def test_settled_is_exact_after_each_batch(spark):
    """Whatever has come so far, the settled runs hold exactly the keys found in min_docs documents."""
    rng, total = random.Random(5), Counter()
    runs = L.LineRuns(spark, 6, 2)
    for _ in range(7):
        counts = [(rng.randrange(40), 0, rng.randint(1, 2)) for _ in range(25)]
        total.update({h: 0 for h, _, _ in counts})
        for h, _, n in counts:
            total[h] += n
        runs.add(spark.createDataFrame(counts, "h1 long, h2 long, n long"))
        got = [r["h1"] for r in runs.frequent().collect()]
        assert sorted(got) == sorted(h for h, n in total.items() if n >= 6)
    for run in {*runs.settled, *(r for level in runs.levels for r in level)}:
        run.drop()


def test_rows_keep_every_column(docs):
    """Whatever the names, on both ways; hot lines and hot texts are cut."""
    d = docs(["x\na"] * 400 + [f"x\nb{i}" for i in range(400)])
    for c in ("_t1", "_t2", "_gone", "row", "gone", "t1", "h1", "n_lines", "kept_text", "_s", "_nb"):
        d = d.withColumn(c, F.lit("mine"))
    for limit in (1_000_000, 0):
        got = L.without_frequent_lines(d, 401, broadcast_keys=limit)
        assert got.schema == d.schema or got.columns == d.columns
        rows = got.collect()
        assert len(rows) == 800 and {r["text"] for r in rows} == {"a", *(f"b{i}" for i in range(400))}
        assert all(r["_t1"] == r["row"] == r["n_lines"] == r["_s"] == "mine" for r in rows)
