"""Portable values of 15 kinds, their equality, hash, binary form and transport JSON."""

from __future__ import annotations

import json
import re
import struct
import sys
from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class Value:
    """kind and data: None, bool, int (Integer, float bits), (coefficient, exponent), str, bytes, tuples for dates and
    times, a tuple of values, or a tuple of (key, value) with str (Object) or Value (EntryMapping) keys."""

    kind: str
    data: object = None


NULL = Value("Null")


def integer(n: int) -> Value:
    return Value("Integer", int(n))


def decimal(coefficient: int, exponent: int) -> Value:
    """Trailing zeros go to the exponent; zero has exponent 0."""
    if not coefficient:
        return Value("Decimal", (0, 0))
    digits = str(abs(coefficient))
    zeros = len(digits) - len(digits.rstrip("0"))
    return Value("Decimal", (coefficient // 10**zeros, exponent + zeros))


def decimal_text(text: str) -> Value:
    sign, digits, exponent = Decimal(text).as_tuple()
    n = int("".join(map(str, digits)) or 0)
    return decimal(-n if sign else n, int(exponent))


def float64(x: float) -> Value:
    return Value("BinaryFloat64", struct.unpack(">Q", struct.pack(">d", x))[0])


def string(text: str) -> Value:
    return Value("String", text)


def sequence(items) -> Value:
    return Value("Sequence", tuple(items))


def mapping(entries) -> Value:
    """An Object if all keys are distinct strings, else an EntryMapping."""
    entries = tuple(entries)
    keys = [k.data for k, _ in entries if k.kind == "String"]
    if len(keys) == len(entries) and len(set(keys)) == len(keys):
        return Value("Object", tuple((k.data, v) for k, v in entries))
    return Value("EntryMapping", entries)


#: Digits of the longest integers that are read; Python's own limit is lower.
DIGITS = 100_000
if 0 < sys.get_int_max_str_digits() < 2 * DIGITS:
    sys.set_int_max_str_digits(2 * DIGITS)

# The tags of the binary form.
TAGS = {"Null": 0x00, False: 0x01, True: 0x02, "Integer": 0x10, "Decimal": 0x11, "BinaryFloat32": 0x12, "BinaryFloat64": 0x13, "String": 0x20, "Bytes": 0x21, "Date": 0x30, "Time": 0x31, "LocalDateTime": 0x32, "OffsetDateTime": 0x33, "Sequence": 0x40, "Object": 0x41, "EntryMapping": 0x42}
KINDS = {t: k for k, t in TAGS.items()}


def _count(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _whole(n: int) -> bytes:
    size = (abs(n).bit_length() + 7) // 8
    return bytes([0 if n == 0 else 1 if n > 0 else 2]) + _count(size) + abs(n).to_bytes(size, "big")


def _text(b: bytes) -> bytes:
    return _count(len(b)) + b


def _body(v: Value) -> bytes:
    d = v.data
    match v.kind:
        case "Null":
            return b""
        case "Boolean":
            return b""
        case "Integer":
            return _whole(d)
        case "Decimal":
            return _whole(d[0]) + _whole(d[1])
        case "BinaryFloat32":
            return struct.pack(">I", d)
        case "BinaryFloat64":
            return struct.pack(">Q", d)
        case "String":
            return _text(d.encode())
        case "Bytes":
            return _text(d)
        case "Date":
            return _whole(d[0]) + bytes(d[1:3])
        case "Time":
            return bytes(d[:3]) + _whole(d[3][0]) + _whole(d[3][1])
        case "LocalDateTime":
            return _body(Value("Date", d[:3])) + _body(Value("Time", d[3:7]))
        case "OffsetDateTime":
            return _body(Value("LocalDateTime", d[:7])) + _whole(d[7])
        case "Sequence":
            return _count(len(d)) + b"".join(map(_item, d))
        case "Object":
            return _count(len(d)) + b"".join(_item(string(k)) + _item(x) for k, x in d)
    return _count(len(d)) + b"".join(_item(k) + _item(x) for k, x in d)


def _item(v: Value) -> bytes:
    body = _body(v)
    return bytes([TAGS[v.data if v.kind == "Boolean" else v.kind]]) + _count(len(body)) + body


def encode(v: Value) -> bytes:
    """The canonical binary form; equal values have equal bytes."""
    return b"PVCE\x01" + _item(v)


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("value ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def count(self) -> int:
        n = shift = 0
        while True:
            (b,) = self.take(1)
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    def whole(self) -> int:
        (sign,) = self.take(1)
        n = int.from_bytes(self.take(self.count()), "big")
        return -n if sign == 2 else n

    def item(self) -> Value:
        kind = KINDS.get(self.take(1)[0])
        end = self.count() + self.at
        if kind in ("Null", False, True):
            v = NULL if kind == "Null" else Value("Boolean", kind)
        elif kind == "Integer":
            v = integer(self.whole())
        elif kind == "Decimal":
            v = Value(kind, (self.whole(), self.whole()))
        elif kind in ("BinaryFloat32", "BinaryFloat64"):
            v = Value(kind, int.from_bytes(self.take(4 if kind[-2:] == "32" else 8), "big"))
        elif kind in ("String", "Bytes"):
            data = self.take(self.count())
            v = Value(kind, data.decode() if kind == "String" else data)
        elif kind in ("Date", "Time", "LocalDateTime", "OffsetDateTime"):
            date = (self.whole(), *self.take(2)) if kind != "Time" else ()
            time = (*self.take(3), (self.whole(), self.whole())) if kind != "Date" else ()
            v = Value(kind, (*date, *time, *([self.whole()] if kind == "OffsetDateTime" else [])))
        elif kind == "Sequence":
            v = sequence([self.item() for _ in range(self.count())])
        elif kind == "Object":
            v = Value(kind, tuple((self.item().data, self.item()) for _ in range(self.count())))
        elif kind == "EntryMapping":
            v = Value(kind, tuple((self.item(), self.item()) for _ in range(self.count())))
        else:
            raise ValueError("unknown tag")
        if self.at != end:
            raise ValueError("wrong length")
        return v


def decode(data: bytes) -> Value:
    """The value of a binary form; only the canonical spelling of a value is taken."""
    if data[:5] != b"PVCE\x01":
        raise ValueError("not a portable value")
    v = (r := _Bytes(data[5:])).item()
    if r.at != len(data) - 5 or encode(v) != data:
        raise ValueError("not canonical")
    return v


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def hash64(v: Value) -> int:
    return fnv1a(encode(v))


def scalar_text(v: Value) -> str | None:
    """A scalar as text, the identity of numbers kept."""
    d = v.data
    match v.kind:
        case "Null" | "Sequence" | "Object" | "EntryMapping":
            return None
        case "Boolean":
            return "true" if d else "false"
        case "Decimal":
            return f"{d[0]}e{d[1]}"
        case "BinaryFloat64":
            return repr(struct.unpack(">d", struct.pack(">Q", d))[0])
        case "Bytes":
            return d.hex()
        case "Date":
            return f"{d[0]:04d}-{d[1]:02d}-{d[2]:02d}"
        case "Time" | "LocalDateTime" | "OffsetDateTime":
            day = f"{d[0]:04d}-{d[1]:02d}-{d[2]:02d}T" if v.kind != "Time" else ""
            h, m, s, f = d[-4:] if v.kind != "OffsetDateTime" else d[3:7]
            part = "" if not f[0] else "." + str(f[0]).rjust(-f[1], "0")
            zone = "" if v.kind != "OffsetDateTime" else "Z" if not d[7] else f"{'-' if d[7] < 0 else '+'}{abs(d[7]) // 3600:02d}:{abs(d[7]) % 3600 // 60:02d}"
            return f"{day}{h:02d}:{m:02d}:{s:02d}{part}{zone}"
    return str(d)


def to_json(v: Value) -> object:
    """Tagged transport form: every value is an object with its kind, numbers as strings."""
    d = v.data
    if v.kind == "Sequence":
        return {"kind": v.kind, "items": [to_json(x) for x in d]}
    if v.kind == "Object":
        return {"kind": v.kind, "entries": [[k, to_json(x)] for k, x in d]}
    if v.kind == "EntryMapping":
        return {"kind": v.kind, "entries": [[to_json(k), to_json(x)] for k, x in d]}
    return {"kind": v.kind} if v.kind == "Null" else {"kind": v.kind, "value": d if isinstance(d, (bool, str)) else scalar_text(v)}


def transport(v: Value) -> str:
    return json.dumps(to_json(v), ensure_ascii=False, separators=(",", ":"))


def from_json(x: object) -> Value:
    """The value of a tagged transport form; anything but the spelling that to_json() gives is refused."""
    if not isinstance(x, dict) or x.get("kind") not in TAGS and x.get("kind") != "Boolean":
        raise ValueError("not a tagged value")
    kind, d = x["kind"], x.get("value")
    if kind == "Null":
        v = NULL
    elif kind == "Boolean":
        v = Value(kind, d)
    elif kind == "Sequence":
        v = sequence([from_json(i) for i in x["items"]])
    elif kind == "Object":
        v = Value(kind, tuple((k, from_json(i)) for k, i in x["entries"]))
    elif kind == "EntryMapping":
        v = Value(kind, tuple((from_json(k), from_json(i)) for k, i in x["entries"]))
    elif not isinstance(d, str):
        raise ValueError("a scalar without text")
    elif kind == "Integer":
        v = integer(int(d))
    elif kind == "Decimal":
        v = Value(kind, tuple(map(int, d.split("e"))))
    elif kind == "BinaryFloat64":
        v = float64(float(d))
    elif kind == "BinaryFloat32":
        v = Value(kind, int(d))
    elif kind == "String":
        v = string(d)
    elif kind == "Bytes":
        v = Value(kind, bytes.fromhex(d))
    else:
        v = _moment(kind, d)
    if to_json(v) != x:
        raise ValueError("not canonical")
    return v


def _moment(kind: str, text: str) -> Value:
    m = re.fullmatch(r"(?:(-?\d{4,})-(\d\d)-(\d\d))?T?(?:(\d\d):(\d\d):(\d\d)(?:\.(\d+))?)?(Z|[+-]\d\d:\d\d)?", text)
    if not m:
        raise ValueError("not a date or time")
    date = tuple(map(int, m.groups()[:3])) if m[1] else ()
    time = (int(m[4]), int(m[5]), int(m[6]), (int(m[7] or 0), -len(m[7] or ""))) if m[4] else ()
    zone = () if not m[8] else (0,) if m[8] == "Z" else ((-1 if m[8][0] == "-" else 1) * (int(m[8][1:3]) * 3600 + int(m[8][4:]) * 60),)
    return Value(kind, (*date, *time, *zone))


def from_transport(text: str) -> Value:
    return from_json(json.loads(text))


def rows(v: Value, tree) -> None:
    """Add a value to a tree: Value, ObjectEntry and EntryMappingEntry rows; sequence elements are children."""

    def put(x: Value, parent: int | None, ordinal: int) -> int:
        at = tree.add("Value", x.kind, parent, ordinal=ordinal, text=scalar_text(x))
        if x.kind == "Sequence":
            for k, item in enumerate(x.data):
                put(item, at, k)
        elif x.kind in ("Object", "EntryMapping"):
            for k, (key, item) in enumerate(x.data):
                if x.kind == "Object":
                    entry = tree.add("ObjectEntry", None, at, ordinal=k, name=key)
                else:
                    entry = tree.add("EntryMappingEntry", None, at, ordinal=k)
                    tree[entry]["key_id"] = put(key, entry, 0)
                tree[entry]["value_id"] = put(item, entry, 1)
        return at

    put(v, None, 0)
