"""The classifiers by held-out accuracy, and the license scan by plain search."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import language, licenses, quality

from .conftest import EDGES

FOLDER = "/root/testdata/sf0.01"


def crc(doc):
    return zlib.crc32(str(doc).encode())


def test_language_accuracy(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    got = language.op4_language(spark, FOLDER).collect()
    assert len(got) == len(langs) and all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_is_not_an_input(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    hidden = docs.withColumn("lang", F.when(~language.held_out(), F.col("lang")))
    key = lambda df: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in df.collect())
    assert key(language.language_id(docs)) == key(language.language_id(hidden))


def test_language_edges(docs):
    train = [f"the cat and the dog number {'x' * (i % 5)} went there" for i in range(30)]
    d = docs([(i, t) for i, t in enumerate(train)]).union(docs([(100 + i, f"der hund und die katze {'y' * (i % 5)} gingen") for i in range(30)], "de")).union(docs([(1000 + i, e) for i, e in enumerate(["123 !", "", None, "²"])] + [(None, "the dog")], None))
    got = {r["doc_id"]: r for r in language.language_id(d.withColumn("score", F.lit("mine"))).collect()}
    assert all(got[1000 + i]["lang_pred"] == "und" and got[1000 + i]["score"] == 0 for i in range(4))
    assert got[None]["lang_pred"] == "en" and got[100]["lang_pred"] == "de"
    assert {r["lang_pred"] for r in language.language_id(docs(EDGES, None)).collect()} == {"und"}
    assert language.language_id(docs([])).collect() == []
    assert {r["lang_pred"] for r in language.language_id(docs(["word a"] * 9, "fr")).collect()} == {"fr"}


def test_families_are_told_apart_first():
    rng = np.random.default_rng(0)
    x = np.abs(np.vstack([rng.normal(c, 0.1, (30, 6)) for c in np.eye(6)[:5]]))
    h = language.Hierarchy(x, np.repeat(["en", "de", "fr", "es", "xx"], 30))
    assert h.families.names == ["(xx)", "germanic", "romance"] and len(h.families.pairs) == 3
    assert h.predict(x)[0] == np.repeat(["en", "de", "fr", "es", "xx"], 30).tolist()


def test_quality_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = quality.op9_quality(spark, FOLDER).collect()
    assert len(got) == 1000 and all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum(a > b for a in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda df: sorted((r["doc_id"], round(r["score"], 9)) for r in df.collect())
    assert key(quality.classify(docs, labels)) == key(quality.classify(docs, flipped))


def test_quality_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(docs(EDGES), none).collect()} == {0.5}
    some = spark.createDataFrame([(0, 1), (1, 1), (2, None), (3, 7), (6, 0), (7, 0), (8, 0), (8, 1), (4, 1)], "doc_id long, quality int")
    got = quality.classify(docs(EDGES).withColumn("quality", F.lit("x")), some).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(docs([]), none).collect() == []
    kept = quality.keep_good(docs(EDGES).withColumn("score", F.lit(1)), none)
    assert kept.count() == len(EDGES) and "score" in kept.columns


def test_discriminant_is_the_formula():
    rng = np.random.default_rng(1)
    d = len(quality.NAMES)
    x = {0: rng.normal(0, 1, (400, d)), 1: rng.normal(1, 2, (600, d))}
    one = {c: np.hstack([np.ones((len(v), 1)), v]) for c, v in x.items()}
    model = quality.Discriminant({c: v.T @ v for c, v in one.items()}, 0.1)
    both = np.vstack([x[0], x[1]])
    z = (both - both.mean(0)) / both.std(0)
    parts = []
    for c in (0, 1):
        zc = z[:400] if c == 0 else z[400:]
        cov = 0.9 * np.cov(zc.T, bias=True) + 0.1 * np.trace(np.cov(zc.T, bias=True)) / d * np.eye(d)
        diff = z - zc.mean(0)
        parts.append(np.log(len(zc) / 1000) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff))
    assert np.allclose(model.scores(both), 1 / (1 + np.exp(parts[0] - parts[1])))


# --- licenses


def test_alignment():
    a, b = "x the quick brown fox jumps y".split(), "the very quick brown cat jumps".split()
    assert [(a[i], b[j]) for i, j in licenses.aligned(a, b)] == [("the", "the"), ("quick", "quick"), ("brown", "brown"), ("jumps", "jumps")]
    assert licenses.increasing([(0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]) == [(1, 1), (2, 2), (4, 5)]
    assert licenses.aligned([], ["a"]) == [] and licenses.increasing([]) == []


def test_scan_finds_notices_and_near_ones(docs):
    mit = licenses.TEMPLATES[1][1]
    changed = mit.replace("free of charge", "without any fee").replace("copies of the Software", "parts of it")
    texts = ["nothing here", "x " * 5000 + "Released under the MIT License." + " y" * 5000, "LICENSED UNDER CC BY-NC 4.0", f"a b c\n{changed}\nd", "Licensed under the Apache License, Version 2.0. " * 50, "license license the the under", "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0."]
    got = {r["doc_id"]: [x["license"] for x in r["licenses"]] for r in licenses.license_scan(docs(texts)).collect()}
    assert got == {0: [], 1: ["MIT"], 2: ["CC-BY-NC-4.0"], 3: ["MIT"], 4: ["Apache-2.0"], 5: [], 6: ["GPL-3.0", "Apache-2.0"]}


def test_scan_tells_relatives_apart(docs):
    whole = dict(licenses.all_templates())
    bsd2, bsd3 = whole["BSD-2-Clause"], whole["BSD-3-Clause"]
    texts = [bsd2, bsd3, "This work is licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under CC BY-SA 4.0.", "Released under the BSD License.", "a b " + whole["GPL-3.0"], whole["MIT"], "Licensed under CC BY 4.0.", "This work is licensed under the GNU Lesser General Public License, version 3." + " x" * 30 + " This work is licensed under the GNU General Public License, version 3."]
    got = {r["doc_id"]: [x["license"] for x in r["licenses"]] for r in licenses.license_scan(docs(texts)).collect()}
    assert got == {0: ["BSD-2-Clause"], 1: ["BSD-3-Clause"], 2: ["LGPL-3.0"], 3: ["AGPL-3.0"], 4: ["CC-BY-SA-4.0"], 5: [], 6: got[6], 7: ["MIT"], 8: ["CC-BY-4.0"], 9: got[9]}
    assert got[6][0] == "GPL-3.0" and set(got[9]) == {"LGPL-3.0", "GPL-3.0"}


def brute_best(words, template, least):
    """The best window of all, by the same alignment."""
    n = len(template)
    slack = n // 4 + 1
    got = max((len(licenses.aligned(template, words[s : s + n + 2 * slack])) for s in range(max(1, len(words)))), default=0)
    return got if got >= least * n else 0


def test_windows_miss_nothing():
    """Wherever some window covers a template, the scan reports it, though it aligns only windows around rare words."""
    import random

    rng = random.Random(4)
    scanner = licenses.Scanner()
    pool = [w for _, t in scanner.templates for w in t] + ["foo", "bar", "baz"] * 30
    for _ in range(60):
        t = rng.randrange(len(scanner.templates))
        template = [w if rng.random() > 0.12 else rng.choice(pool) for w in scanner.templates[t][1]]
        words = [rng.choice(pool) for _ in range(20)] + template + [rng.choice(pool) for _ in range(20)]
        found = scanner.best(words, set(words), {}, t)
        assert (found is not None) >= (brute_best(words, scanner.templates[t][1], 0.8) >= len(template) * 0.9)


def test_license_edges(spark, docs):
    got = licenses.license_scan(docs(EDGES)).collect()
    assert len(got) == len(EDGES) and all(r["licenses"] == [] for r in got)
    assert licenses.license_scan(docs([])).collect() == []


def test_license_query(spark):
    rows = {r["doc_id"]: r["text"].lower() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in licenses.op10_licenses(spark, FOLDER).collect()}
    notices = {"MIT": "released under the mit license", "Apache-2.0": "licensed under the apache license, version 2.0", "GPL-3.0": "gnu general public license, version 3", "CC-BY-NC-4.0": "licensed under cc by-nc 4.0"}
    for doc, text in rows.items():
        assert {n for n, s in notices.items() if s in text} <= set(got[doc]["licenses"].split(","))
        assert bool(got[doc]["n_licenses"]) == any(s in text for s in notices.values())


# --- the queries against plain versions

SMALL = "/root/testdata/sf0.001"


def plain_statistics(text):
    """Each statistic by its definition, character by character and word by word."""
    raw = (text or "").encode()
    share = lambda part, whole, usual, weight: np.log(p / (1 - p)) if (p := (part + weight * usual) / (whole + weight)) else None
    white, marks = b" \t\n\r\x0b\x0c", b".,;:'\"-?()"
    count = lambda test: sum(1 for b in raw if test(b))
    lower, upper, digit = (count(lambda b, lo=lo, hi=hi: lo <= b <= hi) for lo, hi in ((97, 122), (65, 90), (48, 57)))
    space, mark, other = count(lambda b: b in white), count(lambda b: b in marks), count(lambda b: b >= 128)
    symbol = count(lambda b: b < 128 and b not in white and b not in marks and not chr(b).isalnum())
    words, lines = raw.split(), raw.split(b"\n")
    n, k, m = len(raw), len(words), len(lines)
    triples = len({(words[i], words[i + 1], words[i + 2]) for i in range(k - 2)})
    freq = [raw.count(bytes([b])) / n for b in set(raw)] if n else []
    entropy = -sum(f * np.log(f) for f in freq)
    odd = sum(1 for w in words if not (chr(w[-1]).isascii() and chr(w[-1]).isalnum() or w[-1] in b".,;:?)'\"" or w[-1] >= 128))
    return [
        np.log(n + 300), share(upper, upper + lower, 0.03, 100), share(mark, n, 0.02, 100), share(symbol, n, 0.005, 100), share(digit, n, 0.005, 100), share(space, n, 0.16, 100), share(other, n, 0.03, 100),
        np.log((n - space + 100) / (k + 20)), share(k - len(set(words)), k, 0.1, 20), share(odd, k, 0.01, 20), share(max(k - 2 - triples, 0), max(k - 2, 0), 0.01, 20), np.log(n / m + 100),
        share(m - len(set(lines)), m, 0.02, 5), (entropy * n + 2.9 * 200) / (n + 200), share(sum(len(w) <= 3 for w in words), k, 0.33, 20), share(sum(words[i] == words[i + 1] for i in range(k - 1)), max(k - 1, 0), 0.005, 20),
    ]


def test_quality_query_is_the_plain_version(spark):
    """Statistics, classes and densities made again without the operator."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()]
    x = {i: np.array(plain_statistics(t)) for i, t in texts.items()}
    known = [(x[i], y) for i, y in labels if i in x and y in (0, 1) and crc(i) % 5]
    rows, y = np.array([r for r, _ in known]), np.array([c for _, c in known])
    mean, scale = rows.mean(0), rows.std(0)
    logs = {}
    for c in (0, 1):
        z = (rows[y == c] - mean) / scale
        cov = np.cov(z.T, bias=True)
        cov = 0.95 * cov + 0.05 * np.trace(cov) / len(mean) * np.eye(len(mean))
        diff = (np.array(list(x.values())) - mean) / scale - z.mean(0)
        logs[c] = np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.sum(diff @ np.linalg.inv(cov) * diff, axis=1)
    want = dict(zip(x, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), strict=True))
    got = quality.op9_quality(spark, SMALL).collect()
    assert len(got) == len(texts)
    assert all(abs(r["score"] - want[r["doc_id"]]) < 1e-6 for r in got)


def test_language_query_is_the_plain_version(spark):
    """Pairs of symbols counted one by one, and votes of all machines taken one by one, for every document."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.fit(docs.where(~language.held_out()))

    def symbol(b):
        return 27 if b >= 0xC0 else 28 + (b & 31) if b >= 0x80 else ord(chr(b).lower()) - 96 if chr(b).isalpha() else 0

    def plain(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        s = [symbol(b) for b in b" " + text.encode() + b" "]
        pairs = {}
        for a, b in zip(s, s[1:], strict=False):
            if (a, b) != (0, 0):
                pairs[a, b] = pairs.get((a, b), 0) + 1
        total = sum(pairs.values())

        def choose(machines):
            if not machines.pairs:
                return machines.names[0], 1.0
            votes, margins = {n: [0, 0.0] for n in machines.names}, {}
            for j, (a, b) in enumerate(machines.pairs):
                m = (sum(machines.w[j][p * 60 + q] * (c / total) ** 0.5 for (p, q), c in pairs.items()) + machines.b[j]) / machines.usual[j]
                first, second = machines.names[a], machines.names[b]
                votes[first if m > 0 else second][0] += 1
                votes[first][1] += m
                votes[second][1] -= m
                margins[first, second] = m
            best = max(sorted(votes), key=lambda n: votes[n])
            least = min([m for (a, _), m in margins.items() if a == best] + [-m for (_, b), m in margins.items() if b == best])
            return best, 1 / (1 + np.exp(-np.clip(4 * least, -50, 50)))

        family, sure = choose(model.families)
        lang, more = choose(model.within[model.families.names.index(family)])
        return lang, sure * more

    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.op4_language(spark, SMALL).collect()}
    for r in docs.collect():
        lang, score = plain(r["text"])
        assert got[r["doc_id"]][0] == lang and abs(got[r["doc_id"]][1] - score) < 1e-6


def test_languages_are_bounded(spark, docs, monkeypatch):
    """The most frequent languages are learned, the others aren't; equal rows count once."""
    monkeypatch.setattr(language, "LANGUAGES", 2)
    d = docs([(i, f"the cat and the dog {'x' * (i % 4)}") for i in range(20)] + [(7, "the cat")] * 50)
    d = d.union(docs([(100 + i, f"der hund und die katze {'y' * (i % 4)}") for i in range(20)], "de")).union(docs([(200, "le chat"), (201, "le chien")], "fr"))
    assert {r["lang_pred"] for r in language.language_id(d).collect()} == {"en", "de"}


def test_language_sample_comes_small(docs, monkeypatch):
    """Of a learned text the driver gets what isn't zero of its vector, and learns the same machines as from whole vectors."""
    texts = [(f"{w} {'a' * (i % 7)} {w[::-1]} {i % 11}", g) for i, (w, g) in enumerate([("der hund", "de"), ("the dog", "en"), ("el perro", "es")] * 30)]
    d = docs([t for t, _ in texts]).withColumn("lang", F.element_at(F.array(*(F.lit(g) for _, g in texts)), (F.col("doc_id") + 1).cast("int")))
    came, whole = [], type(d).toArrow
    monkeypatch.setattr(type(d), "toArrow", lambda self: came.append(whole(self)) or came[-1])
    got = language.fit(d)
    (table,) = came
    assert 0 < table.nbytes < 3600 * table.num_rows  # a vector has 3600 numbers of four bytes
    rows = sorted({(g, language.vector(t.encode()).astype("<f4").tobytes()) for t, g in texts})
    want = language.Hierarchy(np.array([np.frombuffer(x, "<f4") for _, x in rows]), np.array([g for g, _ in rows]))
    for a, b in zip([got.families, *got.within], [want.families, *want.within], strict=True):
        assert a.names == b.names and (a.w == b.w).all() and (a.b == b.b).all() and (a.usual == b.usual).all()
