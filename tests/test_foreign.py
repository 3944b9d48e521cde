import io
import json
import pickle
import struct
import zipfile

import numpy as np
import pytest

from tessera.cli import main
from tessera.model import InvalidInput, Unsupported
from tessera.sources import container, foreign
from tessera.sources.foreign import as_array, detect, open_any


def st_file(path, header, data):
    raw = json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(raw)) + raw + data)
    return str(path)


def test_safetensors(tmp_path):
    info = {"a": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}, "b": {"dtype": "BOOL", "shape": [1], "data_offsets": [8, 9]}, "__metadata__": {"k": "v"}}
    path = st_file(tmp_path / "x.safetensors", info, struct.pack("<2f", 1, 2) + b"\1")
    s = open_any(path)
    assert detect(path) == "safetensors" and s.attributes == {"k": "v"} and as_array(s, "a").tolist() == [1, 2] and as_array(s, "b").tolist() == [True]


@pytest.mark.parametrize("a,b,n", [([0, 4], [2, 6], 6), ([0, 4], [6, 10], 10), ([0, 4], [4, 8], 9), ([0, 4], [4, 8], 7)])
def test_safetensors_must_tile(tmp_path, a, b, n):
    info = {"a": {"dtype": "F32", "shape": [1], "data_offsets": a}, "b": {"dtype": "F32", "shape": [1], "data_offsets": b}}
    with pytest.raises(InvalidInput):
        open_any(st_file(tmp_path / "x.safetensors", info, bytes(n)))


def text(s):
    return struct.pack("<Q", len(s)) + s.encode()


def test_gguf(tmp_path):
    head = b"GGUF" + struct.pack("<IQQ", 3, 2, 3)
    head += text("general.alignment") + struct.pack("<II", 4, 64) + text("name") + struct.pack("<I", 8) + text("m") + text("list") + struct.pack("<IIQ", 9, 5, 2) + struct.pack("<ii", -1, 2)
    head += text("w") + struct.pack("<IQQIQ", 2, 3, 2, 0, 0) + text("q") + struct.pack("<IQIQ", 1, 32, 8, 64)
    raw = head + bytes(-len(head) % 64) + struct.pack("<6f", *range(6)) + bytes(40) + bytes(34)
    path = tmp_path / "m.gguf"
    path.write_bytes(raw)
    s = open_any(str(path))
    assert s.attributes == {"general.alignment": 64, "name": "m", "list": [-1, 2]}
    assert as_array(s, "w").tolist() == [[0, 1, 2], [3, 4, 5]] and s.tensor("q")["layout"] == "gguf.q8_0/1" and len(s.bytes("q")) == 34
    path.write_bytes(raw[:100])
    with pytest.raises(InvalidInput):
        open_any(str(path))


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_npz(tmp_path, save):
    path = str(tmp_path / "a.npz")
    save(path, x=np.arange(6, dtype="i4").reshape(2, 3), y=np.array([True, False]), z=np.float64(3))
    s = open_any(path)
    assert as_array(s, "x").tolist() == [[0, 1, 2], [3, 4, 5]] and as_array(s, "y").tolist() == [True, False] and as_array(s, "z").tolist() == 3
    assert s.payload("x") == ("At" if save is np.savez else "Opaque")


@pytest.mark.parametrize("array", [np.arange(3, dtype=">i4"), np.asfortranarray(np.ones((2, 3))), np.array([object()])])
def test_npz_refusals(tmp_path, array):
    path = str(tmp_path / "a.npz")
    np.savez(path, x=array)
    with pytest.raises(Unsupported):
        open_any(path)


class Global:
    """Pickles as a reference to a global that isn't imported here."""

    def __init__(self, module, name):
        self.module, self.name = module, name


class Pickler(pickle._Pickler):
    def save(self, x, save_persistent_id=True):
        if isinstance(x, Global):
            self.write(b"c" + x.module.encode() + b"\n" + x.name.encode() + b"\n")
        elif isinstance(x, tuple) and x and x[0] == "CALL":
            self.save(x[1])
            self.save(x[2])
            self.write(b"R")
        elif isinstance(x, tuple) and x and x[0] == "PERSISTENT":
            self.save(x[1])
            self.write(b"Q")
        else:
            super().save(x, save_persistent_id)


def checkpoint(path, value, storages, how=zipfile.ZIP_STORED):
    out = io.BytesIO()
    Pickler(out, 2).dump(value)
    with zipfile.ZipFile(path, "w", how) as z:
        z.writestr("m/data.pkl", out.getvalue())
        for k, v in storages.items():
            z.writestr(f"m/data/{k}", v)
    return str(path)


def tensor(key, kind, at, shape, stride, n):
    storage = ("PERSISTENT", ("storage", Global("torch", kind), key, "cpu", n))
    return ("CALL", Global("torch._utils", "_rebuild_tensor_v2"), (storage, at, shape, stride, False, None))


@pytest.mark.parametrize("how", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_pt(tmp_path, how):
    value = {"model": {"w": tensor("0", "FloatStorage", 1, (2, 2), (2, 1), 5), "b": tensor("1", "BFloat16Storage", 0, (2,), (1,), 2)}, "step": 3, "evil": ("CALL", Global("os", "system"), ("exit 1",))}
    path = checkpoint(tmp_path / "c.pt", value, {"0": struct.pack("<5f", *range(5)), "1": b"\0\x3f\0\x40"}, how)
    s = open_any(path)
    assert s.names() == ["model.b", "model.w"] and as_array(s, "model.w").tolist() == [[1, 2], [3, 4]]
    assert s.payload("model.w") == ("At" if how == zipfile.ZIP_STORED else "Opaque")


def test_pt_refusals(tmp_path):
    with pytest.raises(Unsupported):
        open_any(checkpoint(tmp_path / "a.pt", {"w": tensor("0", "FloatStorage", 0, (2, 2), (1, 2), 4)}, {"0": bytes(16)}))
    with pytest.raises(InvalidInput):
        open_any(checkpoint(tmp_path / "b.pt", {"w": tensor("0", "FloatStorage", 0, (9,), (1,), 4)}, {"0": bytes(16)}))
    with pytest.raises(InvalidInput):
        open_any(checkpoint(tmp_path / "c.pt", {"w": 1}, {}))


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, raw):
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def test_onnx(tmp_path):
    a = varint(8) + varint(2) + varint(16) + varint(1) + field(8, b"a") + field(9, struct.pack("<2f", 1, 2))
    b = field(1, varint(3)) + varint(16) + varint(3) + field(8, b"b") + field(5, varint(1) + varint(2) + varint(2**64 - 1))
    path = tmp_path / "m.onnx"
    path.write_bytes(varint(8) + varint(9) + field(7, field(5, a) + field(5, b)))
    s = open_any(str(path))
    assert as_array(s, "a").tolist() == [1, 2] and as_array(s, "b").tolist() == [1, 2, -1] and s.payload("a") == "At" and s.payload("b") == "Opaque"
    path.write_bytes(field(7, field(5, a + field(13, b"x"))))
    with pytest.raises(Unsupported):
        open_any(str(path))


def hdf5_file(path, chunked):
    """A root group with one 3x4 int32 dataset, contiguous or in 2x2 chunks that are shuffled and deflated."""
    import zlib

    data = np.arange(12, dtype="<i4").reshape(3, 4)
    out = bytearray(2048)

    def put(at, raw):
        out[at : at + len(raw)] = raw

    def message(kind, body):
        body += bytes(-len(body) % 8)
        return struct.pack("<HHB3x", kind, len(body), 0) + body

    def header(at, messages):
        body = b"".join(messages)
        put(at, struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    put(0, b"\x89HDF\r\n\x1a\n" + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 0, 2**64 - 1, 4096, 2**64 - 1) + struct.pack("<QQI4x", 0, 96, 0) + bytes(16))
    header(96, [message(0x11, struct.pack("<QQ", 160, 256))])
    put(160, b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, 2**64 - 1, 2**64 - 1) + struct.pack("<QQQ", 0, 352, 8))
    put(256, b"HEAP" + bytes(4) + struct.pack("<QQQ", 32, 2**64 - 1, 288))
    put(288, bytes(8) + b"d\0")
    put(352, b"SNOD" + struct.pack("<BxH", 1, 1) + struct.pack("<QQI4x", 8, 448, 0) + bytes(16))
    space = message(1, struct.pack("<BBB5x", 1, 2, 0) + struct.pack("<QQ", 3, 4))
    kind = message(3, bytes([0x10, 8, 0, 0]) + struct.pack("<IHH", 4, 0, 32))
    if not chunked:
        header(448, [space, kind, message(8, bytes([3, 1]) + struct.pack("<QQ", 1024, 48))])
        put(1024, data.tobytes())
    else:
        filters = message(11, bytes([1, 2]) + bytes(6) + struct.pack("<HHHHII", 2, 0, 0, 1, 4, 0) + struct.pack("<HHHHII", 1, 0, 0, 1, 6, 0))
        header(448, [space, kind, filters, message(8, bytes([3, 2, 3]) + struct.pack("<Q", 1024) + struct.pack("<III", 2, 2, 4))])
        places, at, keys = [(0, 0), (0, 2), (2, 0), (2, 2)][: 4 if chunked == "whole" else 3], 1400, b""
        for y, x in places:
            block = np.zeros((2, 2), "<i4")
            piece = data[y : y + 2, x : x + 2]
            block[: piece.shape[0], : piece.shape[1]] = piece
            raw = zlib.compress(np.frombuffer(block.tobytes(), np.uint8).reshape(4, 4).T.tobytes())
            put(at, raw)
            keys += struct.pack("<IIQQQQ", len(raw), 0, y, x, 0, at)
            at += len(raw)
        put(1024, b"TREE" + struct.pack("<BBHQQ", 1, 0, len(places), 2**64 - 1, 2**64 - 1) + keys)
    path.write_bytes(out)
    return str(path)


def test_hdf5(tmp_path):
    for form in (None, "whole"):
        s = open_any(hdf5_file(tmp_path / "a.h5", form))
        assert as_array(s, "d").tolist() == np.arange(12).reshape(3, 4).tolist()
    with pytest.raises(Unsupported):
        open_any(hdf5_file(tmp_path / "b.h5", "a chunk is missing"))


def test_convert_and_command_line(tmp_path, capsys):
    src, out = str(tmp_path / "a.npz"), str(tmp_path / "a.zt")
    np.savez(src, x=np.arange(3), y=np.ones(2))
    assert main(["convert", src, out]) == 0 and main(["verify", out, "--canonical", "--deep"]) == 0 and main(["diff", src, out]) == 0
    assert main(["ls", out]) == 0 and "x\ti64\t[3]\tdense\t24 B" in capsys.readouterr().out
    assert main(["id", out]) == 0 and container.open_file(out).content_digest() in capsys.readouterr().out
    np.savez(src, x=np.arange(3) + 1)
    assert main(["diff", src, out]) == 1
    assert main(["ls", str(tmp_path / "none")]) == 1


def test_unknown_format(tmp_path):
    (tmp_path / "x.npy").write_bytes(b"\x93NUMPY")
    with pytest.raises(Unsupported):
        foreign.detect(str(tmp_path / "x.npy"))
