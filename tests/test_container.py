"""The 76 images by which a reader of the native container is told right from wrong, and what the writer promises."""

import os
import random
import struct

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.model import InvalidInput, NotFound, Rejected, Unsupported
from tessera.sources import cbor, container, foreign
from tessera.sources.container import MAGIC, Writer, open_file, open_image, part
from tessera.sources.vocabulary import SEEKABLE, SPARSE_CSR, Encoding, standard

U64 = 2**64 - 1
SHARD = {"size": 1 << 20, "digest": "xxh3:00112233445566aa"}


def raw_image(data_end, manifest):
    at = -(-max(data_end, 8) // 4096) * 4096
    body = bytearray(MAGIC + b"\xab" * (max(data_end, 8) - 8) + b"\0" * (at - max(data_end, 8)))
    return bytes(body) + manifest + struct.pack("<QQQII8s", at, len(manifest), xxhash.xxh3_64_intdigest(manifest), 2, 0, MAGIC)


def image(data_end, objects, writes=(), **more):
    out = bytearray(raw_image(data_end, cbor.encode({"objects": objects} | more)))
    for at, data in writes:
        out[at : at + len(data)] = data
    return bytes(out)


def p(dtype, blob, **more):
    return {"dtype": dtype, "blob": blob} | more


def obj(shape, layout, parts):
    return {"shape": shape, "layout": layout, "parts": parts}


def dense(dtype, shape, at, n, **more):
    return obj(shape, "dense", {"data": p(dtype, [at, n], **more)})


def minimal():
    return image(4104, {"t": dense("u8", [8], 4096, 8)})


def patched(raw, at, new):
    return raw[: at % len(raw)] + new + raw[at % len(raw) + len(new) :]


def data_shard(at=0):
    return MAGIC + struct.pack("<QQQII8s", at, 0, 0, 2, 0, MAGIC)


def u64s(*xs):
    return struct.pack(f"<{len(xs)}Q", *xs)


def csr(columns, pointers, **parts):
    three = {"indices": p("u64", [4096, 24]), "indptr": p("u64", [8192, 24]), "values": p("f32", [12288, 12])} | parts
    return image(12300, {"m": obj([2, 3], SPARSE_CSR, {k: v for k, v in three.items() if v})}, [(4096, u64s(*columns)), (8192, u64s(*pointers))])


def written(tmp):
    path = os.path.join(tmp, "basic.zt")
    with Writer(path) as w:
        w.add("a.bias", [4], "f32", b"\1" * 16)
        w.add("a.weight", [2, 4], "bf16", b"\2" * 16)
        w.add("tied", [2, 4], "bf16", b"\2" * 16)
    return open(path, "rb").read()


def filler(n):
    return container.digest_of(b"\xab" * n)


there = dense("u8", [8], 4096, 8, shard="base")
VALID = {
    "canonical-basic": None,
    "minimal": minimal(),
    "empty-objects": image(8, {}),
    "scalar": image(4100, {"s": dense("f32", [], 4096, 4)}),
    "zero-size-tensor": image(4096, {"z": dense("f32", [0, 4], 4096, 0)}),
    "aliased-identical-blobs": image(4104, {"a": dense("u8", [8], 4096, 8), "b": dense("u8", [8], 4096, 8)}),
    "unknown-layout-structural": image(8296, {"q": obj([64], "x.custom/1", {"data": p("u8", [4096, 32]), "scales": p("u8", [8192, 104])})}),
    "unknown-ltype-structural": image(4104, {"t": dense("u8", [999], 4096, 8, type="x.future/1")}),
    "f4-packed-odd-count": image(4099, {"t": dense("u8", [5], 4096, 3, type="f4_e2m1")}),
    "shards-table": image(8, {"t": there}, shards={"base": SHARD}),
    "nonzero-reserved-ignored": patched(minimal(), -12, b"\1\0\0\0"),
    "attributes-kitchen-sink": image(8, {}, attributes={"float": 1.25, "neg": -42, "nested": [None, True], "raw": b"\0\1\2"}),
    "data-shard": data_shard(),
    "shard-reference-is-a-valid-image": image(8, {"t": there}, shards={"base": SHARD}),
    "local-and-foreign-parts-together": image(8192, {"here": dense("u8", [8], 4096, 8), "there": there}, shards={"base": SHARD}),
    "csr-metadata-valid": csr([0, 2, 1], [0, 2, 3]),
}
REJECTED = {
    "file-too-small": (bytes(10), "FileTooSmall"),
    "header-magic": (patched(minimal(), 0, b"\0"), "HeaderMagic"),
    "footer-magic": (patched(minimal(), -1, b"\0"), "FooterMagic"),
    "version-unsupported": (patched(minimal(), -16, b"\3\0\0\0"), "Version"),
    "manifest-too-large": (patched(minimal(), -32, u64s(2 << 30)), "ManifestTooLarge"),
    "manifest-out-of-bounds": (patched(minimal(), -40, u64s(1 << 20)), "ManifestBounds"),
    "manifest-misaligned": (patched(minimal(), -40, u64s(4100)), "BlobAlignment"),
    "manifest-hash-mismatch": (patched(minimal(), 8192, b"\xff"), "ManifestHash"),
    "data-shard-nonzero-offset": (data_shard(4096), "ManifestBounds"),
    "cbor-trailing-bytes": (raw_image(8, b"\xa0\0"), "CborSyntax"),
    "cbor-tag": (raw_image(8, b"\xc0\0"), "CborSyntax"),
    "cbor-indefinite": (raw_image(8, b"\x9f\xff"), "CborSyntax"),
    "cbor-non-shortest": (raw_image(8, b"\x18\x05"), "CborDeterminism"),
    "cbor-unsorted-keys": (raw_image(8, b"\xa2\x61b\0\x61a\0"), "CborDeterminism"),
    "cbor-duplicate-key": (raw_image(8, b"\xa2\x61a\0\x61a\0"), "CborDuplicateKey"),
    "cbor-depth": (raw_image(8, b"\x81" * 40 + b"\0"), "CborDepth"),
    "schema-missing-objects": (raw_image(8, b"\xa0"), "Schema"),
    "schema-unknown-dtype": (image(4104, {"t": dense("f4", [8], 4096, 8)}), "Schema"),
    "schema-blob-arity": (image(4104, {"t": obj([8], "dense", {"data": p("u8", [4096])})}), "Schema"),
    "schema-encoding-without-decoded-length": (image(4104, {"t": dense("u8", [8], 4096, 8, encoding="x.z/1")}), "Schema"),
    "schema-ltype-dtype-mismatch": (image(4104, {"t": dense("f32", [2], 4096, 8, type="bool")}), "Schema"),
    "schema-digest-uppercase-hex": (image(4104, {"t": dense("u8", [8], 4096, 8, digest="xxh3:00FF00FF00FF00FF")}), "Schema"),
    "shard-table-key-not-text": (image(8, {}, shards={cbor.OddKey(b"\1"): SHARD}), "Schema"),
    "shard-name-traversal": (image(8, {}, shards={"../etc/passwd": SHARD}), "ShardName"),
    "shard-name-separator": (image(8, {}, shards={"sub/dir": SHARD}), "ShardName"),
    "shard-name-empty": (image(8, {}, shards={"": SHARD}), "ShardName"),
    "shard-name-leading-dot": (image(8, {}, shards={".hidden": SHARD}), "ShardName"),
    "shard-ref-not-in-table": (image(8, {"t": there}), "ShardRef"),
    "blob-array-with-three-elements": (image(8, {"t": obj([8], "dense", {"data": p("u8", [0, 4096, 8])})}), "Schema"),
    "attributes-not-a-map": (image(8, {}, attributes=7), "Schema"),
    "attribute-key-empty": (image(8, {}, attributes={"": None}), "Name"),
    "attribute-key-nul": (image(8, {}, attributes={"a\0b": None}), "Name"),
    "attribute-key-not-text": (image(8, {}, attributes={cbor.OddKey(b"\1"): None}), "Schema"),
    "object-attributes-not-a-map": (image(4104, {"t": dense("u8", [8], 4096, 8) | {"attributes": 1}}), "Schema"),
    "shard-blob-partial-overlap": (image(8, {"a": dense("f32", [2048], 4096, 8192, shard="base"), "b": dense("f32", [2], 8192, 8, shard="base")}, shards={"base": SHARD}), "BlobOverlap"),
    "name-empty": (image(4104, {"": dense("u8", [8], 4096, 8)}), "Name"),
    "name-nul": (image(4104, {"a\0b": dense("u8", [8], 4096, 8)}), "Name"),
    "name-too-long": (image(4104, {"n" * 1025: dense("u8", [8], 4096, 8)}), "Name"),
    "shape-rank-65": (image(4097, {"t": dense("u8", [1] * 65, 4096, 1)}), "Shape"),
    "shape-product-overflow": (image(4104, {"t": dense("u8", [U64, 2], 4096, 8)}), "Shape"),
    "blob-misaligned": (image(4108, {"t": dense("u8", [8], 4100, 8)}), "BlobAlignment"),
    "blob-offset-zero": (image(4104, {"t": dense("u8", [8], 0, 8)}), "BlobAlignment"),
    "blob-out-of-bounds": (image(4104, {"t": dense("u8", [1 << 40], 4096, 1 << 40)}), "BlobBounds"),
    "blob-partial-overlap": (image(12288, {"a": dense("f32", [2048], 4096, 8192), "b": dense("f32", [2], 8192, 8)}), "BlobOverlap"),
    "csr-missing-part": (csr([0, 2, 1], [0, 2, 3], indptr=None), "LayoutRule"),
    "csr-signed-indices": (csr([0, 2, 1], [0, 2, 3], indices=p("i64", [4096, 24]), indptr=p("i64", [8192, 24])), "LayoutRule"),
    "csr-indptr-count": (csr([0, 2, 1], [0, 2, 3], indptr=p("u64", [8192, 16])), "LayoutRule"),
    "csr-values-size": (csr([0, 2, 1], [0, 2, 3], values=p("f32", [12288, 8])), "LayoutRule"),
    "dense-extra-part": (image(8296, {"t": obj([8], "dense", {"data": p("u8", [4096, 8]), "extra": p("u8", [8192, 8])})}), "LayoutRule"),
    "dense-size-mismatch": (image(4104, {"t": dense("f32", [3], 4096, 8)}), "DenseSize"),
    "dense-f4-size-mismatch": (image(4100, {"t": dense("u8", [5], 4096, 4, type="f4_e2m1")}), "DenseSize"),
}
VERIFIED = {
    "verify-ok": (image(4104, {"t": dense("u8", [8], 4096, 8, digest=filler(8))}), None),
    "verify-digest-mismatch": (image(4104, {"t": dense("u8", [8], 4096, 8, digest="xxh3:0000000000000000")}), "Digest"),
    "bool-invalid-byte": (image(4104, {"t": dense("u8", [8], 4096, 8, type="bool")}), "LayoutData"),
    "f4-nonzero-odd-nibble": (image(4099, {"t": dense("u8", [5], 4096, 3, type="f4_e2m1")}), "LayoutData"),
}
CSR = {
    "csr-data-valid": (csr([0, 2, 1], [0, 2, 3]), None),
    "csr-indptr-not-zero-based": (csr([0, 2, 1], [1, 2, 3]), "LayoutData"),
    "csr-index-out-of-cols": (csr([0, 5, 1], [0, 2, 3]), "LayoutData"),
    "csr-row-not-increasing": (csr([2, 0, 1], [0, 2, 3]), "LayoutData"),
}


def test_number_of_cases():
    assert len(VALID) + len(REJECTED) + len(VERIFIED) + len(CSR) + 1 == 76  # and the unknown encoding below


@pytest.mark.parametrize("case", VALID)
def test_valid(case, tmp_path):
    source = open_image(VALID[case] or written(str(tmp_path)))
    assert source.is_shard == (case == "data-shard")


@pytest.mark.parametrize("case", REJECTED)
def test_rejected(case):
    raw, rule = REJECTED[case]
    with pytest.raises(Rejected) as e:
        open_image(raw)
    assert e.value.rule == rule


@pytest.mark.parametrize("case", VERIFIED)
def test_verify(case):
    raw, rule = VERIFIED[case]
    source = open_image(raw)
    if rule is None:
        assert source.verify("t", "data") == "ok"
    else:
        with pytest.raises(Rejected) as e:
            source.verify("t", "data")
        assert e.value.rule == rule


@pytest.mark.parametrize("case", CSR)
def test_csr(case):
    raw, rule = CSR[case]
    if rule is None:
        assert open_image(raw).csr("m")[0] == [2, 3]
    else:
        with pytest.raises(Rejected) as e:
            open_image(raw).csr("m")
        assert e.value.rule == rule


def test_unknown_encoding_is_refused():
    source = open_image(image(4101, {"t": dense("u8", [8], 4096, 5, encoding="x.z/1", decoded_length=8)}))
    with pytest.raises(Unsupported):
        source.bytes("t")


def test_mutations_raise_nothing_else():
    rng = random.Random(5)
    seeds = [v for v in VALID.values() if v]
    for _ in range(3000):
        raw = bytearray(rng.choice(seeds))
        for _ in range(rng.randint(1, 4)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        raw = raw[: rng.randrange(len(raw))] if rng.random() < 0.2 else raw
        try:
            open_image(bytes(raw))
        except (Rejected, Unsupported):
            pass


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**64), 2**64 - 1) | st.floats() | st.binary(max_size=30) | st.text(max_size=20), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=8), c, max_size=4), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_cbor_round_trip(value):
    raw = cbor.encode(value)
    assert cbor.encode(cbor.decode(raw)) == raw


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60))
def test_cbor_decodes_only_what_it_encodes(raw):
    try:
        assert cbor.encode(cbor.decode(raw)) == raw
    except Rejected:
        pass


def test_writer_shares_equal_content_and_is_canonical(tmp_path):
    raw = written(str(tmp_path))
    source = open_image(raw)
    assert source.tensor("a.weight")["parts"]["data"]["blob"] == source.tensor("tied")["parts"]["data"]["blob"]
    assert container.canonical_violations(lambda a, n: raw[a : a + n], len(raw)) == []
    assert raw == written(str(tmp_path))
    assert all(source.verify(n) == "ok" for n in source)


def test_canonical_violations(tmp_path):
    path = str(tmp_path / "x.zt")
    with Writer(path, canonical=False, align=4096) as w:
        w.add("b", [8], "u8", b"12345678", digest=None)
        w.add("a", [8], "u8", b"87654321", digest=None)
    rules = {r for r, _ in container.canonical_violations(*container.file_reader(path))}
    assert {1, 2, 4} <= rules


def test_zero_length_parts_overlap_nothing(tmp_path):
    path = str(tmp_path / "z.zt")
    with Writer(path) as w:
        w.add("a", [0], "u8", b"")
        w.add("b", [2], "u8", b"xy")
    assert open_file(path).bytes("b") == b"xy"


def test_append_keeps_the_file_as_a_prefix(tmp_path):
    path = str(tmp_path / "a.zt")
    with Writer(path, canonical=False, align=8192) as w:
        w.add("one", [3], "u8", b"abc")
    before = open(path, "rb").read()
    with Writer(path, canonical=False, append=True) as w:
        assert w.align == 8192
        w.add("two", [3], "u8", b"def")
    assert open(path, "rb").read().startswith(before)
    assert {n: open_file(path).bytes(n) for n in open_file(path)} == {"one": b"abc", "two": b"def"}


def test_nothing_is_published_by_a_failed_writer(tmp_path):
    path = str(tmp_path / "p.zt")
    with pytest.raises(ZeroDivisionError), Writer(path) as w:
        w.add("a", [1], "u8", b"x")
        raise ZeroDivisionError
    assert os.listdir(tmp_path) == []


def test_stream(tmp_path):
    path = str(tmp_path / "s.zt")
    with Writer(path) as w:
        s = w.stream("a", [6], "u8", 6)
        s.write(b"abc")
        with pytest.raises(InvalidInput):
            w.add("b", [1], "u8", b"x")
        with pytest.raises(InvalidInput):
            s.close()
        with pytest.raises(InvalidInput):
            s.write(b"defg")
        s.write(b"def")
        s.close()
        with pytest.raises(InvalidInput):
            s.write(b"")
    assert open_file(path).verify("a") == "ok"


def test_shards_overlay_and_resolvers(tmp_path):
    base, root = str(tmp_path / "base.zt"), str(tmp_path / "root.zt")
    with Writer(base) as w:
        w.add("w", [4], "u8", b"base")
    identity = container.shard_identity(base)
    with Writer(root, canonical=False) as w:
        w.add_shard("base", **identity)
        w.add_shard("base", **identity)
        with pytest.raises(InvalidInput):
            w.add_shard("base", 5, identity["digest"])
        w.link(open_file(base), "w", "base")
        w.add("delta", [1], "u8", b"d")
    with pytest.raises(NotFound):
        open_file(root)
    got = open_file(root, resolver=container.in_folder(str(tmp_path)))
    assert got.bytes("w") == b"base" and got.bytes("delta") == b"d"
    got.verify_shards()
    raw = bytearray(open(base, "rb").read())
    raw[65536] ^= 1
    open(str(tmp_path / "root-base.zt"), "wb").write(raw)
    bad = open_file(root)
    with pytest.raises(Rejected) as e:
        bad.verify_shards()
    assert e.value.rule == "ShardIdentity"


def test_merge(tmp_path):
    paths = []
    for n in ("a", "b"):
        paths.append(str(tmp_path / f"{n}.zt"))
        with Writer(paths[-1]) as w:
            w.add(n, [1], "u8", n.encode())
    both = foreign.open_all(paths)
    assert [both.bytes(n) for n in both] == [b"a", b"b"]
    with pytest.raises(Rejected) as e:
        foreign.open_all([paths[0], paths[0]])
    assert e.value.rule == "NameCollision"


def test_content_digest_ignores_layout(tmp_path):
    got = set()
    for k, (align, canonical) in enumerate(((65536, True), (4096, False))):
        path = str(tmp_path / f"{k}.zt")
        with Writer(path, canonical=canonical, align=align) as w:
            w.add("a", [3], "u8", b"abc")
            w.add("b", [1], "f32", b"1234", encoding=None if canonical else SEEKABLE)
        got.add(open_file(path).content_digest())
    assert len(got) == 1
    with Writer(str(tmp_path / "n.zt"), canonical=False) as w:
        w.add("a", [3], "u8", b"abc", digest=None)
    assert open_file(str(tmp_path / "n.zt")).content_digest() is None


def test_seekable_encoding_and_vocabulary(tmp_path):
    path, data = str(tmp_path / "e.zt"), os.urandom(1 << 20) + bytes(1 << 20) + b"tail"
    with Writer(path, canonical=False) as w:
        w.add("x", [len(data)], "u8", data, encoding=SEEKABLE)
    source = open_file(path)
    assert source.bytes("x") == data and source.part("x")["blob"][1] < len(data)
    with pytest.raises(Unsupported):
        source.locate("x")
    raw = bytearray(open(path, "rb").read())
    raw[source.part("x")["blob"][0] + 100] ^= 255
    with pytest.raises(Rejected) as e:
        open_image(bytes(raw)).bytes("x")
    assert e.value.rule == "Encoding"
    own = standard().with_encoding(SEEKABLE, Encoding(lambda b: b, lambda s, n: b"\0" * n))
    assert open_image(bytes(raw), own).bytes("x") == bytes(len(data))  # what is registered later is found first


def test_only_part(tmp_path):
    path = str(tmp_path / "o.zt")
    with Writer(path) as w:
        w.object("m", [2], "x.two/1", {"a": part("u8", b"a"), "b": part("u8", b"b")})
    with pytest.raises(InvalidInput, match="a, b"):
        open_file(path).bytes("m")
    assert open_file(path).bytes("m", "b") == b"b"


def test_published_digests():
    assert container.digest_of(b"", "sha256").startswith("sha256:e3b0c442") and container.digest_of(b"abc", "sha256").endswith("15ad")
    assert container.digest_of(b"") == "xxh3:2d06800538d394c2"


def test_gaps_take_no_disk(tmp_path):
    """Small tensors at the canonical alignment: the bytes between them are zeros, and none of them is written."""
    path = str(tmp_path / "m.zt")
    with container.Writer(path) as w:
        for i in range(200):
            w.add(f"t{i:03d}", [3], "u8", b"%03d" % i)
        w.add("u", [0], "u8", b"")
    raw = open(path, "rb").read()
    assert raw[65536:65539] == b"000" and not any(raw[65539:131072]) and os.stat(path).st_size > 200 * 65536
    assert os.stat(path).st_blocks * 512 < os.stat(path).st_size / 8
    assert not container.canonical_violations(*container.file_reader(path))
    source = container.open_file(path)
    assert [source.verify(f"t{i:03d}") for i in range(200)] == ["ok"] * 200
