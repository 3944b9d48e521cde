"""`python -m tessera.cli ls|id|verify|convert|diff`: catalogs of tensor files on the command line."""

from __future__ import annotations

import argparse
import sys

from .model import InvalidInput, NotFound, Rejected, Unsupported
from .sources import container, foreign
from .sources.vocabulary import decoded_size


def human(n: int) -> str:
    for k, unit in enumerate(("B", "KiB", "MiB", "GiB")):
        if n < 1024 ** (k + 1):
            return f"{n} B" if not k else f"{n / 1024**k:.1f} {unit}"
    return f"{n / 1024**4:.1f} TiB"


def ls(path: str) -> int:
    source = foreign.open_any(path)
    for name in source:
        obj = source.tensor(name)
        first = obj["parts"][min(obj["parts"], key=str.encode)]
        print(name, first.get("type") or first["dtype"], obj["shape"], obj["layout"], human(sum(map(decoded_size, obj["parts"].values()))), sep="\t")
    return 0


def identify(path: str) -> int:
    source = container.open_file(path)
    if (digest := source.content_digest()) is None:
        print("a part has no digest, so there is no content digest", file=sys.stderr)
        return 1
    print(digest)
    return 0


def verify(path: str, deep: bool, canonical: bool) -> int:
    source = foreign.open_any(path)
    counts = {"ok": 0, "no_digest": 0}
    for name in source:
        for role in source.tensor(name)["parts"]:
            counts[source.verify(name, role)] += 1
    print(f"{counts['ok']} verified, {counts['no_digest']} without a digest")
    if deep:
        source.verify_shards()
    found = container.canonical_violations(*container.file_reader(path)) if canonical else []
    for rule, detail in found:
        print(f"rule {rule}: {detail}")
    return int(bool(found))


def diff(left: str, right: str) -> int:
    a, b, out = foreign.open_any(left), foreign.open_any(right), []
    out += [f"- {n}" for n in a if n not in b] + [f"+ {n}" for n in b if n not in a]
    for n in a:
        if n in b:
            x, y = a.tensor(n), b.tensor(n)
            if (x["shape"], x["layout"]) != (y["shape"], y["layout"]):
                out.append(f"~ {n}: {x['layout']} {x['shape']} / {y['layout']} {y['shape']}")
            else:
                out += [f"~ {n}/{r}" for r in sorted(x["parts"]) if r not in y["parts"] or a.bytes(n, r) != b.bytes(n, r)]
    print("\n".join(out) if out else "the same")
    return int(bool(out))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("ls", "id"):
        sub.add_parser(name).add_argument("path")
    v = sub.add_parser("verify")
    v.add_argument("path")
    v.add_argument("--deep", action="store_true")
    v.add_argument("--canonical", action="store_true")
    c = sub.add_parser("convert")
    c.add_argument("path")
    c.add_argument("out")
    c.add_argument("--align", type=int)
    d = sub.add_parser("diff")
    d.add_argument("left")
    d.add_argument("right")
    o = parser.parse_args(args)
    try:
        if o.command == "ls":
            return ls(o.path)
        if o.command == "id":
            return identify(o.path)
        if o.command == "verify":
            return verify(o.path, o.deep, o.canonical)
        if o.command == "convert":
            container.convert(foreign.open_any(o.path), o.out, o.align)
            return 0
        return diff(o.left, o.right)
    except (Rejected, Unsupported, InvalidInput, NotFound, OSError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
