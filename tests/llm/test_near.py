"""SimHash, embeddings and nearest neighbours against brute force."""

import inspect
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import ann, embedding_dedup, simhash
from tessera.llm.common import components, forest

from .conftest import EDGES


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(500, 560)] + [(1000, 2000 + i) for i in range(300)]
    want = union_find({n for e in links for n in e}, links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(n, n) == r for n, r in want.items())
    a, b = forest(np.array([x for x, _ in links]), np.array([y for _, y in links]))
    mine = dict(zip(a.tolist(), b.tolist(), strict=True))
    assert all(mine.get(n, n) == r for n, r in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def slow_fingerprint(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    texts = ["", " \t", "One", "one two", "A b C d", "é É É z", "the " * 50, "x\x1cy z w q", " ".join(map(str, range(3000)))]
    got = simhash.fingerprints_of([t.encode() for t in texts], 3).tolist()
    assert got == [slow_fingerprint(t, 3) for t in texts]


def brute_components(fps, bits):
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= bits]
    return union_find(range(len(fps)), links)


@pytest.mark.parametrize("block", [2048, 7])
@pytest.mark.parametrize("bits", [2, 4])
def test_links_are_whole(spark, block, bits):
    """Groups of many near fingerprints, with blocks so small that hot groups are cut."""
    rng = random.Random(bits)
    fps = []
    for _ in range(40):
        base = rng.getrandbits(64)
        fps += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(rng.choice([1, 2, 30]))]
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"), bits, block).collect()
    place = {s: i for i, s in enumerate(signed)}
    got = union_find(range(len(fps)), [(place[r["a"]], place[r["b"]]) for r in links])
    assert got == brute_components(fps, bits)


def test_thresholds_cover_the_budget():
    """Whatever the plan, any two numbers within the budget agree on a probed part up to its threshold."""
    rng = random.Random(3)
    gram = np.full((64, 64), 250.0)
    np.fill_diagonal(gram, 500)
    for n, bits in ((1000, 2), (10**9, 2), (10**6, 5), (1000, 14)):
        parts = simhash.plan(n, gram, bits)
        for _ in range(300):
            flips = set(rng.sample(range(64), rng.randint(0, bits)))
            assert any(len(flips & set(p)) <= t for p, t in parts)


def test_simhash_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    fps = [slow_fingerprint(r["text"], 3) for r in rows]
    want = brute_components(fps, 2)
    got = {r["doc_id"]: r for r in simhash.op8_simhash(spark, "/root/testdata/sf0.001").collect()}
    lowest = {}
    for i, r in enumerate(rows):
        lowest[want[i]] = min(lowest.get(want[i], r["doc_id"]), r["doc_id"])
    for i, r in enumerate(rows):
        assert (got[r["doc_id"]]["fingerprint"], got[r["doc_id"]]["component_id"]) == (f"{fps[i]:016x}", lowest[want[i]])


def test_simhash_edges(docs):
    got = simhash.simhash_components(docs(EDGES)).collect()
    assert len(got) == len(EDGES)
    empty = [r for r in got if r["fp"] == 0]
    assert len(empty) == 5 and {r["component_id"] for r in empty} == {0}
    assert simhash.simhash_components(docs([])).collect() == []


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.mark.parametrize("block", [2048, 5])
def test_near_dedup(docs, block):
    """Copies and near copies go, others stay; one of each group, all columns."""
    rng = random.Random(7)
    texts, groups = [], []
    for g in range(40):
        base = words(rng, rng.choice([60, 300, 900]))
        for k in range(rng.choice([1, 2, 12])):
            w = list(base)
            if k % 2:
                w[len(w) // 2] = f"other{k}"  # five of the shingles change
            texts.append(" ".join(w))
            groups.append(g)
    got = simhash.near_dedup(docs(texts).withColumn("n", F.lit(1)).withColumn("fp", F.lit("mine")), block_rows=block)
    kept = sorted(r["doc_id"] for r in got.collect())
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n", "fp"]
    assert kept == [groups.index(g) for g in range(40)]


def test_near_dedup_edges(docs):
    got = simhash.near_dedup(docs(EDGES)).collect()
    ids = [r["doc_id"] for r in got]
    assert ids.count(None) == 2 and ids.count(4) == 1 and sorted(i for i in ids if i is not None) == [0, 4, 6, 7, 8]
    assert simhash.near_dedup(docs([])).collect() == []


def pair_of(rng, n, t):
    """Two texts of n distinct five-word shingles each that differ in the last t: resemblance (n - t) / (n + t)."""
    base = [f"v{rng.getrandbits(48)}" for _ in range(n + 4)]
    return [" ".join(base), " ".join(base[:-t] + [f"v{rng.getrandbits(48)}" for _ in range(t)])]


@pytest.mark.parametrize("block", [4096, 3])
def test_near_dedup_leaves_what_is_under_the_contract(docs, block):
    """0.70, 0.78 and 0.60 of few words stay; a chain goes as far as its links hold."""
    rng = random.Random(8)
    texts = [t for _ in range(40) for n, t in ((85, 15), (89, 11), (4, 1)) for t in pair_of(rng, n, t)]
    base = pair_of(rng, 90, 10)[0].split()
    texts += [" ".join(base), " ".join([*base[:-8], *"a b c d e f g h".split()]), " ".join([*"i j k l m n o p".split(), *base[8:-8], *"a b c d e f g h".split()])]
    got = sorted(r["doc_id"] for r in simhash.near_dedup(docs(texts), block_rows=block).collect())
    assert got == list(range(len(texts) - 2))


def test_near_dedup_catches_what_is_at_the_contract(docs):
    """300 pairs at exactly 0.8, of many shingles and of few."""
    rng = random.Random(9)
    pairs = [pair_of(rng, n, t) for n, t in ((90, 10), (180, 20), (9, 1)) for _ in range(100)]
    for p in pairs[200:250]:  # four shingles of five
        w = p[0].split()[:9]
        p[:] = [" ".join(w), " ".join(w[:8])]
    got = [r["doc_id"] for r in simhash.near_dedup(docs([t for p in pairs for t in p])).collect()]
    assert sorted(got) == list(range(0, 600, 2))


def test_near_dedup_counts_a_repeated_passage_once(docs):
    """A phrase 20 times in each of the texts, which have 200 other words each."""
    rng = random.Random(10)
    phrase = " ".join(f"p{k}" for k in range(10))
    texts = [" ".join([phrase] * 20 + [f"v{rng.getrandbits(48)}" for _ in range(200)]) for _ in range(30)]
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs(texts)).collect()) == list(range(30))


def test_near_dedup_drops_rows_not_ids(docs):
    """A copy goes, another text under its id stays; rows that repeat id and text are one."""
    rng = random.Random(11)
    a, b, c, d = (" ".join(words(rng, 60)) for _ in range(4))
    got = simhash.near_dedup(docs([(1, a), (2, a), (2, b), (3, c), (3, d), (3, c), (3, d)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(1, a), (2, b), (3, c), (3, d)])


# --- embeddings

BAD = [None, [], [0.0, 0.0, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [None, 1.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [1.0, 0.0]]


def table(spark, vectors, labels=None, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if x is None else float(x) for x in v], (0 if labels is None else labels[i])) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def clustered(rng, n, d, spread):
    centres = rng.standard_normal((n // 8, d))
    return np.vstack([c + spread * rng.standard_normal((rng.integers(1, 16), d)) for c in centres]).astype("f4").astype(float)


@pytest.mark.parametrize("d,block", [(64, 1024), (64, 9), (24, 1024), (100, 30)])
def test_embedding_links(spark, d, block):
    rng = np.random.default_rng(d)
    x = clustered(rng, 160, d, 0.08)
    x = np.vstack([x, x[:5], x[:3] * 2])
    label = rng.integers(0, 2, len(x))
    label[-8:] = label[[0, 1, 2, 3, 4, 0, 1, 2]]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    want = union_find(range(len(x)), np.argwhere(near).tolist())
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(table(spark, x.tolist(), label.tolist()), block_rows=block).collect()}
    links = sum(got[i]["n_links"] for i in range(len(x)))
    assert near.sum() > 500 and links <= near.sum() and links >= 0.99 * near.sum()
    assert sum(got[i]["component_id"] == want[i] for i in range(len(x))) >= 0.99 * len(x)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(x)))


def test_embedding_tables_are_the_same_at_every_size(spark, monkeypatch):
    """Codes that differ in two bits of every table meet where these are flipped, however large the table counts as."""
    signs = object.__new__(embedding_dedup.Quantiser)
    signs.basis = np.eye(64)
    monkeypatch.setattr(embedding_dedup, "learn", lambda *_: {64: signs})
    a, b = np.ones((2, 64))
    few = [k for byte in (0, 2, 4, 6) for k in (8 * byte, 8 * byte + 1)]
    a[few], b[few] = 0.05, -0.05
    large = {"small": 0} if "small" in inspect.signature(embedding_dedup.embedding_dedup).parameters else {}
    got = embedding_dedup.embedding_dedup(table(spark, [a.tolist(), b.tolist()]), **large).collect()
    assert sorted((r["n_links"], r["component_id"]) for r in got) == [(1, 0), (1, 0)]


def test_embedding_edges(spark):
    vectors = [*BAD, [1.0, 0.0, 0.0, 0.0], [2.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0], [1.0, 0.0]]
    labels = [0] * 10 + [None]
    got = embedding_dedup.embedding_dedup(table(spark, vectors, labels, [*range(9), None, 10])).collect()
    by = {r["vec_id"]: r for r in got}
    assert len(got) == 11 and all(by[i]["n_links"] == 0 and by[i]["component_id"] == i for i in [*range(7), 10])
    assert (by[7]["n_links"], by[8]["n_links"], by[None]["n_links"]) == (2, 2, 2) and by[8]["component_id"] == by[None]["component_id"] == 7
    assert embedding_dedup.embedding_dedup(table(spark, [])).collect() == []


def brute_nearest(x, ids, k, every):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        rest = [j for j in range(len(x)) if ids[j] != ids[i]]
        out[int(ids[i])] = sorted(((-s[j], int(ids[j])) for j in rest))[:k]
    return out


def check_nearest(spark, x, k, every, least=0.9, **how):
    want = brute_nearest(x, np.arange(len(x)), k, every)
    got = ann.nearest(table(spark, x.tolist()), k, every, **how).collect()
    mine = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        mine.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) <= 1e-9 * abs(r["score"])
        assert r["rank"] == len(mine[r["query_id"]])
    assert set(mine) == set(want) and all(len(v) == min(k, len(x) - 1) and v == sorted(v) for v in mine.values())
    hit = sum(len({v for _, v in mine[q]} & {v for _, v in want[q]}) for q in want)
    assert hit >= least * sum(map(len, want.values()))
    return got


@pytest.mark.parametrize("block,queries", [(None, 16384), (50, 7)])
@pytest.mark.parametrize("kind", ["flat", "lengths"])
def test_nearest(spark, kind, block, queries):
    """Vectors without structure and clusters of them, of one length and of very different ones; blocks that cut hot buckets."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.standard_normal((1500, 32)), clustered(rng, 200, 32, 0.1), np.ones((130, 32))])
    if kind == "lengths":
        x *= np.exp(rng.standard_normal(len(x)))[:, None]
    x = x.astype("f4").astype(float)
    check_nearest(spark, x, 10, 20, block_rows=block, block_queries=queries)


@pytest.mark.parametrize("n,d", [(2, 64), (15, 64), (60, 5), (21, 1)])
def test_nearest_of_few(spark, n, d):
    """Fewer candidates than are asked for: all of them."""
    x = np.random.default_rng(n).standard_normal((n, d)).astype("f4").astype(float)
    check_nearest(spark, x, 20, 1, least=1.0)


def test_blocks_change_nothing(spark):
    x = np.random.default_rng(6).standard_normal((900, 16)).astype("f4").astype(float)
    key = lambda rows: sorted(map(tuple, rows))
    assert key(check_nearest(spark, x, 5, 10)) == key(check_nearest(spark, x, 5, 10, block_rows=40, block_queries=3))


def test_probes_are_fewer_than_rows():
    """Of 20,000 rows without structure, three fifths at most are scored for a query; of as many in clusters, a tenth."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((400, 64))
    for x, most in ((rng.standard_normal((20_000, 64)), 0.6), (centres[rng.integers(0, 400, 20_000)] + 0.5 * rng.standard_normal((20_000, 64)), 0.1)):
        unit, size = ann.unit_and_size(x)
        axes = ann.axes_of(len(x), 64)
        keys = np.stack([ann.codes(unit, t, axes) for t in range(4)], axis=1)
        buckets = {}
        for t in range(4):
            own, inv, n = np.unique(keys[:, t], return_inverse=True, return_counts=True)
            longest = np.zeros(len(own))
            np.maximum.at(longest, inv, size)
            buckets[t] = (own, n, longest)
        some = x[:100]
        score = some @ x.T
        np.fill_diagonal(score, -np.inf)
        top = np.argsort(-score, axis=1)[:, :20]
        many, tau = ann.tuned(buckets, axes, some, [keys[t] for t in top], 0.95, 0.05)
        scored = sum((ann.prospects(ann.coordinates(unit[100:200], t, axes), buckets[t][0], buckets[t][2]) >= tau) @ buckets[t][1] for t in range(many))
        assert scored.mean() < most * len(x)


def test_nearest_edges(spark):
    ok = [[1.0, 0, 0, 0], [0.5, 0.5, 0, 0], [0.5, 0.5, 0, 0], [-1.0, 0, 0, 0]]
    vectors = [*ok, *BAD, [9.0, 0, 0, 0], [1.0, 0, 0, 0]]
    ids = [0, 2, 1, 3, 4, 5, 6, 7, 8, 9, 20, 3, None]
    got = ann.nearest(table(spark, vectors, None, ids), 3, 20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 3, 9.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5)]
    assert ann.nearest(table(spark, []), 3, 20).collect() == []


def test_pseudo_rotation_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 48))
    assert np.allclose(np.linalg.norm(ann.turned(x, 0, 0), axis=1), np.linalg.norm(x, axis=1))
