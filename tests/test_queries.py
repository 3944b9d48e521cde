"""Every registered query against its SQL, at the smallest scale."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans import catalog_queries, file_queries, spark_native

FOLDER = "/root/testdata/sf0.001"
QUERIES = {**catalog_queries.QUERIES, **file_queries.QUERIES, **spark_native.QUERIES}
SQL = {**catalog_queries.SQL, **file_queries.SQL, **spark_native.SQL}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def test_all_have_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    found = db.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr)
    assert got == want


def test_canonical_rules_of_stores_with_more_rows(spark, tmp_path):
    """Several documents of a store have digests of the wrong kind: that breaks rule 4 alone, and equal digests would break rule 3."""
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"src{i % 2}", 6) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["canonical_rules"](spark, str(tmp_path)).select("store", "name", "rule", "detail").collect()]
    assert sorted(got, key=repr) == sorted(own.execute(SQL["canonical_rules"]).fetchall(), key=repr)
    assert sum(r[2] == 4 for r in got) == 19


def against_sql(spark, folder, name, **tables):
    """A query and its SQL over tables of a few rows, both sorted."""
    own = duckdb.connect()
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{table}.parquet")
        own.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = own.execute(SQL[name])
    columns = [c[0] for c in found.description]
    got = [tuple(r) for r in QUERIES[name](spark, str(folder)).select(*columns).collect()]
    return sorted(got, key=repr), sorted(found.fetchall(), key=repr)


def test_shape_product_of_large_keys(spark, tmp_path):
    """Parts from 100,000 on make a dimension of more digits than 64 bits have: its product is null, and no error."""
    keys = [1, 9, 18446, 18447, 99999, 100000, 115083, 10**12]
    rows = spark.createDataFrame([(k, n, p, s) for k, p in enumerate(keys) for n in (1, 2) for s in (0, 1, 7, 10**7)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    got, want = against_sql(spark, tmp_path, "shape_product", lineitem=rows)
    assert got == want and any(r[-1] is None for r in got) and any(r[-1] not in (None, "0") for r in got)


def test_exact_tiling_of_equal_ranges(spark, tmp_path):
    """An event of a byte that was moved onto the next of a byte: the later one is the fault, whatever order the rows come in."""
    ids = [i for i in range(97 * 7 * 40) if i % 7 == 1 and (i % 97 == 0 or (i - 7) % 97 == 0)]
    rows = spark.createDataFrame([(i, i // 97 % 5) for i in reversed(ids)], "event_id long, user_id long")
    got, want = against_sql(spark, tmp_path, "exact_tiling", events=rows)
    assert got == want and len(got) > 20


@pytest.mark.parametrize("step", [1, -1])
def test_tiling_faults_of_ties(spark, step):
    from tessera.operators import layout

    rows = [(0, 0, 2, 10), *((0, 2, 1, k) for k in range(11, 51)), (0, 3, 5, 51)]
    blobs = spark.createDataFrame(rows[::step], "store long, offset long, length long, id long").repartition(3, "id")
    assert sorted(r["id"] for r in layout.tiling_faults(blobs, "store", ("id",)).collect()) == list(range(12, 51))


def test_file_csr_by_blocks(spark, tmp_path, monkeypatch):
    """Matrices are cut into blocks of rows of bounded size; a row that has more cells is a block by itself."""
    cells = [(n, s * 3 + 5, p, float(s + p)) for n in (1, 2) for s in range(40) for p in range(1 + s % 5 + (300 if s == 17 else 0))]
    rows = spark.createDataFrame([*cells, *cells[::2]], "l_linenumber int, l_suppkey long, l_partkey long, l_quantity double")
    monkeypatch.setattr(file_queries, "BLOCK_CELLS", 20, raising=False)
    names = set()
    write = file_queries._write
    monkeypatch.setattr(file_queries, "_write", lambda rows, *a, **k: (names.update((r["name"], r["n"]) for r in rows.select("name", (F.length("content") / 8).alias("n"), "part").where("part = 'values'").collect()), write(rows, *a, **k))[1])
    got, want = against_sql(spark, tmp_path, "file_csr", lineitem=rows)
    assert got == want and len(names) > 10 and sorted(n for _, n in names)[-3] <= 25


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_bytes_are_read_last(spark):
    """Listing reads no text bytes beyond their length, and a lookup's filter is in the plan before anything else."""
    plan = QUERIES["point_lookup"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = QUERIES["merge_collisions"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan.split("Relation")[0]
