"""Property lists, as XML and binary."""

from __future__ import annotations

import base64
import re
import struct

from docloom.functions.values import Value, float64, integer, sequence, string
from docloom.sources import xml_doc
from docloom.sources.tree import Failure, Tree

DATE = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)Z")


def _seconds(text: str) -> float:
    """Seconds from the start of 2001."""
    from datetime import datetime

    m = DATE.fullmatch(text)
    try:
        return (datetime(*map(int, m.groups())) - datetime(2001, 1, 1)).total_seconds()
    except (AttributeError, ValueError) as e:
        raise Failure("plist.parse.date@1") from e


def _record(kind: str, **more) -> Value:
    return Value("Object", (("kind", string(kind)), *more.items()))


class Builder:
    """Adds values to a tree in the order of the document."""

    def __init__(self, text: str):
        self.tree = Tree(text)

    def leaf(self, kind: str, data, parent, ordinal=0, start=0, end=0) -> tuple[int, Value]:
        text = {"data": lambda: data.hex(), "boolean": lambda: str(data).lower(), "real": lambda: repr(float(data)), "date": lambda: repr(float(data))}.get(kind, lambda: str(data))()
        node = self.tree.add("PlistValue", kind, parent, start, end, ordinal, text=text)
        v = {"string": lambda: string(data), "integer": lambda: integer(data), "uid": lambda: _record("uid", uid=integer(data)), "real": lambda: float64(data), "boolean": lambda: Value("Boolean", data), "data": lambda: Value("Bytes", data), "date": lambda: _record("date", epoch=string("2001-01-01T00:00:00Z"), seconds=float64(data))}[kind]()
        return node, v

    def close(self, node: int, entries: list[tuple[int, str, Value]]) -> Value:
        self.tree.group([e for e, _, _ in entries], lambda r: (r["parent_id"], r["name"]))
        return Value("EntryMapping", tuple((string(k), v) for _, k, v in entries))

    def entry(self, node: int, name: str, k: int, start=0, end=0) -> int:
        entry = self.tree.add("PlistDictEntry", None, node, start, end, k, name=name)
        self.tree[entry]["key_id"] = self.tree.add("PlistKey", None, entry, start, end, 0, name=name, text=name)
        return entry

    def finish(self, value: Value) -> Tree:
        self.tree.value = Value("Object", (("record", string("plist.value-tree@1")), ("root", value)))
        return self.tree


def parse(text: str, profile: str = "plist.xml@1") -> Tree:
    xml = xml_doc.parse(text)
    build, own = Builder(text), {}
    build.tree.diagnostics = list(xml.diagnostics)
    for k, r in enumerate(xml.rows, 1):
        own.setdefault(r["parent_id"], []).append(k)
    build.tree.pieces = list(xml.pieces)
    _tags(build.tree, text)
    root = next((k for k, r in enumerate(xml.rows, 1) if r["role"] == "XmlElement"), None)
    if root is None or xml[root]["name"] != "plist":
        build.tree.note("plist.parse.root-element@1")
        return build.tree
    if not any(xml[k]["role"] == "XmlAttribute" and xml[k]["name"] == "version" and xml[k]["text"] == "1.0" for k in own.get(root, [])):
        build.tree.note("plist.parse.root-version@1")
    kids = lambda n: [k for k in own.get(n, []) if xml[k]["role"] == "XmlElement"]
    words = lambda n: "".join(xml[k]["text"] for k in own.get(n, []) if xml[k]["role"] in ("XmlText", "XmlCdata"))

    def one(n: int, parent, ordinal: int) -> tuple[int, Value]:
        r, kind = xml[n], xml[n]["name"]
        s, e, body = r["start_byte"], r["end_byte"], words(n)
        put = lambda k, d: build.leaf(k, d, parent, ordinal, s, e)
        if kind == "string":
            return put("string", body)
        if kind == "integer" and re.fullmatch(r"\s*[+-]?(0x[0-9a-fA-F]+|[0-9]+)\s*", body):
            return put("integer", int(body.strip(), 16 if "x" in body else 10))
        if kind == "real" and re.fullmatch(r"\s*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+|inf|infinity|nan)\s*", body, re.I):
            return put("real", float(body))
        if kind in ("true", "false"):
            return put("boolean", kind == "true")
        if kind == "date":
            return put("date", _seconds(body.strip()))
        if kind == "data":
            try:
                return put("data", base64.b64decode(re.sub(r"\s", "", body), validate=True))
            except ValueError as x:
                raise Failure("plist.parse.data@1", s) from x
        if kind == "array":
            node, items = build.tree.add("PlistValue", "array", parent, s, e, ordinal), []
            for k, c in enumerate(kids(n)):
                element = build.tree.add("PlistArrayElement", None, node, xml[c]["start_byte"], xml[c]["end_byte"], k)
                child, v = one(c, element, 0)
                build.tree[element].update(value_id=child, kind=build.tree[child]["kind"])
                items.append(v)
            return node, sequence(items)
        if kind == "dict":
            node, entries, pairs = build.tree.add("PlistValue", "dict", parent, s, e, ordinal), [], kids(n)
            if len(pairs) % 2 or any(xml[k]["name"] != "key" for k in pairs[::2]):
                build.tree.note("plist.parse.dict-pairs@1", s, e)
            for k, (a, b) in enumerate(zip(pairs[::2], pairs[1::2])):
                entry = build.entry(node, words(a), k, xml[a]["start_byte"], xml[b]["end_byte"])
                child, v = one(b, entry, 0)
                build.tree[entry]["value_id"] = child
                entries.append((entry, words(a), v))
            return node, build.close(node, entries)
        raise Failure("plist.parse.value@1", s)

    tops = kids(root)
    if len(tops) != 1:
        build.tree.note("plist.parse.root-value-count@1")
        if not tops:
            return build.tree
    return build.finish(one(tops[0], None, 0)[1])


def _tags(tree: Tree, text: str) -> None:
    """Turn generic markup pieces into those of property lists: one piece for each tag."""
    out, at = [], 0
    for m in re.finditer(r"<(/?)(plist|dict|key|array|string|integer|real|date|data|true|false)\b[^>]*>", text):
        out += [p for p in tree.pieces if at <= p[2] and p[3] <= m.start()]
        kind = m[2] if m[2] in ("true", "false") else f"{m[2]}-{'close' if m[1] else 'open'}"
        out.append(("Token", kind, m.start(), m.end()))
        at = m.end()
    tree.pieces = out + [p for p in tree.pieces if p[2] >= at]


def parse_binary(data: bytes, profile: str = "plist.binary@1") -> Tree:
    """Objects by offset table; facts of the file's structure are rows of their own."""
    if data[:8] != b"bplist00" or len(data) < 40:
        raise Failure("plist.binary.header@1")
    size, refs, count, top, table = struct.unpack(">6xBBQQQ", data[-32:])
    if not (1 <= size <= 8 and 1 <= refs <= 8 and count and top < count and table + count * size <= len(data) - 32 and table >= 8):
        raise Failure("plist.binary.trailer@1")
    number = lambda at, n: int.from_bytes(data[at : at + n], "big")
    offsets = [number(table + k * size, size) for k in range(count)]
    if any(not 8 <= o < table for o in offsets):
        raise Failure("plist.binary.offset@1")
    build = Builder("")
    build.tree.text = "\0" * len(data)
    facts: list = []

    def head(k: int):
        at = offsets[k]
        kind, n = data[at] >> 4, data[at] & 15
        at += 1
        if kind in (4, 5, 6, 10, 13) and n == 15:
            width = 1 << (data[at] & 15)
            n = number(at + 1, width)
            at += 1 + width
        return kind, n, at

    def one(k: int, parent, ordinal: int, path: tuple) -> tuple[int, Value]:
        if k in path:
            raise Failure("plist.binary.cycle@1", offsets[k])
        kind, n, at = head(k)
        put = lambda name, d, end: build.leaf(name, d, parent, ordinal, offsets[k], end)
        if kind == 0 and n in (8, 9):
            return put("boolean", n == 9, at)
        if kind == 1:
            return put("integer", int.from_bytes(data[at : at + (1 << n)], "big", signed=n >= 3), at + (1 << n))
        if kind == 2:
            return put("real", struct.unpack(">f" if n == 2 else ">d", data[at : at + (1 << n)])[0], at + (1 << n))
        if kind == 3:
            return put("date", struct.unpack(">d", data[at : at + 8])[0], at + 8)
        if kind == 4:
            return put("data", data[at : at + n], at + n)
        if kind == 5:
            return put("string", data[at : at + n].decode("ascii"), at + n)
        if kind == 6:
            return put("string", data[at : at + 2 * n].decode("utf-16-be"), at + 2 * n)
        if kind == 8:
            return put("uid", number(at, n + 1), at + n + 1)
        ids = [number(at + j * refs, refs) for j in range(n * (2 if kind == 13 else 1))]
        if kind not in (10, 13) or any(i >= count for i in ids):
            raise Failure("plist.binary.object@1", offsets[k])
        node = build.tree.add("PlistValue", "array" if kind == 10 else "dict", parent, offsets[k], at + len(ids) * refs, ordinal)
        if kind == 10:
            items = []
            for j, i in enumerate(ids):
                element = build.tree.add("PlistArrayElement", None, node, 0, 0, j)
                child, v = one(i, element, 0, (*path, k))
                build.tree[element].update(value_id=child, kind=build.tree[child]["kind"])
                items.append(v)
            return node, sequence(items)
        entries = []
        for j in range(n):
            kk, kn, ka = head(ids[j])
            if kk not in (5, 6):
                raise Failure("plist.binary.key@1", offsets[k])
            name = data[ka : ka + kn].decode("ascii") if kk == 5 else data[ka : ka + 2 * kn].decode("utf-16-be")
            entry = build.entry(node, name, j)
            child, v = one(ids[n + j], entry, 0, (*path, k))
            build.tree[entry]["value_id"] = child
            entries.append((entry, name, v))
        return node, build.close(node, entries)

    value = one(top, None, 0, ())[1]
    names = {0: "boolean", 1: "integer", 2: "real", 3: "date", 4: "data", 5: "string", 6: "string", 8: "uid", 10: "array", 13: "dict"}
    for k in range(count):
        kind, n, at = head(k)
        build.tree.add("PlistBinaryObject", names.get(kind, "unknown"), None, offsets[k], at, k, state="top" if k == top else None)
        build.tree.add("PlistBinaryOffset", None, None, table + k * size, table + (k + 1) * size, k, text=str(offsets[k]))
        if kind in (10, 13):
            for j in range(n * (2 if kind == 13 else 1)):
                facts.append((k, number(at + j * refs, refs), at + j * refs))
    for j, (k, to, at) in enumerate(facts):
        build.tree.add("PlistBinaryRef", None, None, at, at + refs, j, name=str(k), text=str(to))
    build.tree.add("PlistBinaryTrailer", None, None, len(data) - 32, len(data), 0, text=f"{size},{refs},{count},{top},{table}")
    return build.finish(value)
