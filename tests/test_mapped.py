import numpy as np
import pytest

from tessera.model import Unsupported
from tessera.sources import container, foreign
from tessera.sources.mapped import Caps, Location, Mapped


@pytest.fixture
def path(tmp_path):
    out = str(tmp_path / "a.zt")
    with container.Writer(out, canonical=False, align=4096) as w:
        w.add("a", [3], "f32", np.arange(3, dtype="<f4").tobytes())
        w.add("b", [5000], "u8", bytes(range(250)) * 20)
        w.add("bf", [2], "bf16", bytes(4))
        w.add("e", [4096], "u8", bytes(4096), encoding="zt.zstd-seekable/1")
        w.add("none", [0], "u8", b"")
    return out


def test_views_are_borrowed_and_read_only(path):
    m = Mapped(container.open_file(path))
    view = m.borrow("b")
    assert bytes(view) == bytes(range(250)) * 20 and view.readonly and bytes(m.borrow("none")) == b""
    x = m.array("a")
    assert x.tolist() == [0, 1, 2] and not x.flags.writeable and not x.flags.owndata
    assert m.location("b") == Location(path, m.source.tensor("b")["parts"]["data"]["blob"][0], 5000)
    with pytest.raises(Unsupported):
        m.borrow("e")
    with pytest.raises(Unsupported):
        m.array("bf")


def test_arrays_go_over_by_dlpack(path):
    x = Mapped(container.open_file(path)).array("a")
    assert x.__dlpack_device__()[0] == 1  # the CPU
    try:
        y = np.from_dlpack(x)
    except BufferError:  # before read-only flags
        return
    assert y.tolist() == [0, 1, 2] and not y.flags.writeable


def test_caps_and_pages(path, tmp_path):
    m = Mapped(container.open_file(path))
    assert m.caps("a") == Caps(True, True, True, 4096) and m.caps("e") == Caps(False, False, True, 4096)
    m.prefetch("b")
    assert m.evict("b") and not m.evict("e") and bytes(m.borrow("b"))[:3] == b"\0\1\2"
    assert [(n, len(v)) for n, v in m.stream(["a", "b", "a"])] == [("a", 12), ("b", 5000), ("a", 12)]
    np.savez(tmp_path / "s.npz", x=np.ones(3), y=np.ones(4))
    close = Mapped(foreign.open_any(str(tmp_path / "s.npz")))
    assert not close.caps("x").evict and not close.evict("x") and close.array("y").tolist() == [1, 1, 1, 1]
