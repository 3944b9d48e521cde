"""Token counts, BPE and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, packing, token_counts

from .conftest import EDGES

FILE = "byte_bpe_50k.json"
ODD = ["a  b", " x", "\n\nhi\tyo", " ", "<s>hi</s><unk>", "a<|endoftext|>b <|endoftext|> c", "it's don't 'll  's", " x 　 y\x1c z \x85 q", "a \nb", "a\n b", "​x  y", "ﬁ①  Ａ", "１２ ٣ ²"]
ALPHABET = "abeth ionTZ▁\n\t  é😀1,.'<|>\u0000 　"


def random_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return bpe.segments(bpe.tokenizer_path(FILE)).encoder.exact


def test_counts_are_the_librarys():
    own = token_counts.transducer(token_counts.FILE)
    assert own.sound
    texts = ODD + random_texts(3000) + ["", "thereandhere " * 5000, "x" * 50_000]
    assert own.counts(texts).tolist() == [len(x) for x in own.lib.encode(texts)]
    assert own.counts([]).tolist() == [] and own.counts([""]).tolist() == [0]


def test_counts_after_the_table_is_dropped():
    own = token_counts.transducer(token_counts.FILE)
    own.clear()
    texts = random_texts(50, 9)
    first = own.counts(texts).tolist()
    own.clear()
    assert own.counts(texts).tolist() == first


def test_counts_with_very_many_characters():
    """All characters there are: the classes are those of the vocabulary's own, and no text goes to the library."""
    own = token_counts.Transducer(__import__("public_tokenizers").path(token_counts.FILE))
    wide = ["plain text first", "".join(map(chr, range(0x370, 0x500))) * 3, "and so on", "".join(chr(c) for c in range(0x3000, 0xD000)), "".join(map(chr, range(0x10000, 0x12000)))]
    want = [len(x) for x in own.lib.encode(wide)]
    asked, encode = [], own.lib.encode

    class Lib:
        def encode(self, x, **how):
            asked.append(x)
            return encode(x, **how)

    own.lib = Lib()
    assert own.counts(wide).tolist() == own.counts(wide).tolist() == want
    assert all(isinstance(x, str) and len(x) < 64 for x in asked)  # pairs of pieces only
    assert len(own.chars) <= len(own.known) + 6


def test_counts_of_texts_without_spaces_and_of_long_runs():
    """The scan is exact where chunks' guesses are wrong, and takes few readings where states come again."""
    own = token_counts.transducer(token_counts.FILE)
    rng = random.Random(4)
    texts = ["x" * 70_001, " " * 9_999, "ab" * 8_000 + "c" * 8_000, "".join(rng.choice("abcdeé1中") for _ in range(20_000)), "=" * 5000 + "-" * 5000, "aaab" * 7000, "\n" * 3000 + "\t" * 3000]
    assert own.counts(texts).tolist() == [len(x) for x in own.lib.encode(texts)]
    steps, step = [0], own._step

    def counted(rows, k):
        steps[0] += 1
        return step(rows, k)

    own._step = counted
    own.counts(["x" * 70_001])
    del own._step
    assert steps[0] < 40 * token_counts.CHUNK  # and not the 70,001 of one reading after another


def test_pieces_and_dropped_tables_carry_the_state(monkeypatch):
    """Wherever pieces of the stream end, and however often the table starts anew."""
    own = token_counts.Transducer(__import__("public_tokenizers").path(token_counts.FILE))
    texts = [*ODD, *random_texts(300, 8), "", "thereandhere " * 300, "x" * 2000]
    want = [len(x) for x in own.lib.encode(texts)]
    for piece, states in ((700, 40), (1000, 1 << 17), (257, 10)):
        monkeypatch.setattr(token_counts, "PIECE", piece)
        monkeypatch.setattr(token_counts, "MAX_STATES", states)
        assert own.counts(texts).tolist() == want
        assert len(own.states) < states + 2 * piece


def test_count_edges(docs):
    got = token_counts.token_counts(docs(EDGES), limit=1000).collect()
    assert len(got) == len(EDGES)
    by = {(r["doc_id"], r["n_bytes"]): r for r in got}
    assert by[0, 0]["n_tokens"] == 0 and by[7, 100_000]["over_limit"] and by[8, len(EDGES[8].encode())]["n_tokens"] > 0
    assert token_counts.token_counts(docs([])).count() == 0


@pytest.mark.parametrize("bits", [2, 5, 10])
def test_encoding_is_the_librarys(library, bits):
    texts = ODD + random_texts(1500) + [" ".join(random_texts(40, s)) for s in range(10)] + ["", "word " * 3000, "y" * 20_000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    own = bpe.chunker(bpe.tokenizer_path(FILE), bits)
    assert [own.encode(t.encode()).tolist() for t in texts] == want
    assert [x.tolist() for x in bpe.ids_by_segments(own.own, texts)] == want
    assert [own.own.encoder.decode(i).decode() for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(max_size=60))
def test_any_text(library, text):
    own = bpe.chunker(bpe.tokenizer_path(FILE), 2)
    assert own.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


def test_vocabulary_merges_by_rank(library):
    own = bpe.segments(bpe.tokenizer_path(FILE)).encoder
    assert own.fast is not None
    for i, raw in own.bytes_of.items():
        text = raw.decode("utf-8", "ignore")
        if text.encode() == raw:
            assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, i


def test_chunks_are_shared():
    own = bpe.Chunks(bpe.Segments(bpe.tokenizer_path(FILE)), 5)
    passage = " ".join(f"word{i}" for i in range(500))
    own.encode(("one " + passage).encode())
    made = own.encoded
    own.encode(("another start, then " + passage).encode())
    assert own.encoded - made < made / 10 and own.reused > made / 2


def test_joins_agree_by_ids(library):
    """Cuts anywhere, also amid white space and special strings: the ids are those of the whole text."""
    texts = ["a  b   c \n\n d", "x  " + " \n y", "one two  " + " three\t four", "a <|endoftext|> b<|endoftext|>", "  lead and trail  ", "word " * 60 + "  \n  " + "word " * 60]
    own = bpe.Chunks(bpe.segments(bpe.tokenizer_path(FILE)), 10)
    cuts, rng = bpe.chunk_cuts, random.Random(6)
    try:
        for text in texts:
            data, want = text.encode(), library.encode(text, add_special_tokens=False).ids
            for _ in range(150):
                places = sorted(rng.sample(range(1, len(data)), rng.randint(0, min(6, len(data) - 1))))
                bpe.chunk_cuts = lambda *_, places=places: places
                assert own.encode(data).tolist() == want, (text, places)
    finally:
        bpe.chunk_cuts = cuts


def test_joins_where_white_space_merges(tmp_path, library):
    """A file with merges of longer runs of white space: windows grow until the ids agree."""
    import json

    spec = json.load(open(bpe.tokenizer_path(FILE), encoding="utf-8"))
    space, newline = "\u0120", "\u010a"
    top = max(spec["model"]["vocab"].values())
    more = [(space, space), (space * 2, space * 2), (newline, space)]
    for a, b in more:
        if a + b not in spec["model"]["vocab"]:
            top += 1
            spec["model"]["vocab"][a + b] = top
            spec["model"]["merges"].append([a, b] if isinstance(spec["model"]["merges"][0], list) else f"{a} {b}")
    path = tmp_path / "wide.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(str(path))
    own = bpe.Chunks(bpe.Segments(str(path)), 3)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "word", " ", "  ", "   ", "\n", "\n ", "\n  ", "1", ","]) for _ in range(120)) for _ in range(300)]
    assert [own.encode(t.encode()).tolist() for t in texts] == [e.ids for e in exact.encode_batch(texts, add_special_tokens=False)]


def test_pool_and_chunks_are_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "POOL_SEGMENTS", 50)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 100)
    own = bpe.Chunks(bpe.Segments(bpe.tokenizer_path(FILE)), 4)
    texts = random_texts(200, 4)
    assert [own.encode(t.encode()).tolist() for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip_of_edges(docs, library):
    got = bpe.decode(bpe.encode(docs(EDGES))).collect()
    assert len(got) == len(EDGES)
    texts = [e[1] if isinstance(e, tuple) else e for e in EDGES]
    assert sorted(r["decoded"] for r in got) == sorted(t or "" for t in texts)
    assert bpe.encode(docs([])).count() == 0


def test_query(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: r for r in bpe.op6_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
    counts = {r["doc_id"]: r for r in token_counts.op2_token_counts(spark, "/root/testdata/sf0.001").collect()}
    own = token_counts.transducer(token_counts.FILE)
    assert all((counts[r["doc_id"]]["n_tokens"], counts[r["doc_id"]]["n_bytes"]) == (len(own.lib.encode(r["text"])), len(r["text"].encode())) for r in rows)


# --- packing


def check_packed(pieces, texts, library):
    """Each id lies in exactly one piece, pieces have their documents' ids, and sequences are gapless."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        raw = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(raw)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(raw[p["start"] : at].tobytes())
        assert at == len(raw)
    fill = []
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.WINDOW
        fill.append(at)
    return sum(fill), len(fill) * packing.WINDOW


def test_packing_query(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = packing.op5_packing(spark, "/root/testdata/sf0.01").collect()
    used, room = check_packed(got, {r["doc_id"]: r["text"] for r in rows}, library)
    assert used / room > 0.995


def test_packing_edges(docs, library):
    texts = {i: t for i, t in enumerate(EDGES) if not isinstance(t, tuple)}
    check_packed(packing.pack(docs([(i, t) for i, t in texts.items()])).collect(), texts, library)
    assert len(packing.pack(docs(["a", (0, "a"), (None, "a")])).select("sequence_id", "offset").distinct().collect()) == 3
    assert packing.pack(docs([])).collect() == []


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    for _ in range(20):
        histogram = {rng.choice([*range(32, 2048, 32), *range(1, 32), 2048]): rng.randint(1, 500) for _ in range(rng.randint(1, 90))}
        used = {}
        for parts, times in packing.plan(histogram):
            assert sum(parts) <= 2048
            for p in parts:
                used[p] = used.get(p, 0) + times
        assert used == histogram


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((8, 15)), rng.random(8) * 10 - 2
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope < 1e-6).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-6
