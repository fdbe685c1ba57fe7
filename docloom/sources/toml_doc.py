"""TOML 1.0: tables, dotted keys, arrays of tables, four kinds of date-times. No recovery."""

from __future__ import annotations

import re

from docloom.functions.values import Value, float64, integer, sequence, string
from docloom.sources.tree import Failure, Tree

TOKENS = re.compile(
    r"""(?P<Whitespace>[ \t]+)|(?P<Newline>\r?\n)|(?P<Comment>\#[^\r\n]*)|(?P<String>\"\"\"(?:[^\\]|\\.)*?\"{3,5}|'''.*?'{3,5}|"(?:[^"\\\r\n]|\\.)*"|'[^'\r\n]*')
    |(?P<Equals>=)|(?P<LeftBracket>\[)|(?P<RightBracket>\])|(?P<LeftBrace>\{)|(?P<RightBrace>\})|(?P<Comma>,)|(?P<Dot>\.)|(?P<Bare>[A-Za-z0-9_+:-]+)""",
    re.X | re.S,
)
DATE = r"(\d{4})-(\d\d)-(\d\d)"
TIME = r"(\d\d):(\d\d):(\d\d)(?:\.(\d+))?"
ESCAPES = {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r", '"': '"', "\\": "\\"}


def _fail(at: int):
    raise Failure("toml.parse.syntax@1", at)


def unquote(raw: str, at: int) -> str:
    if raw[:3] in ('"""', "'''"):
        body = re.sub(r"\A\r?\n", "", raw[3:-3])
        if raw[0] == "'":
            return body
        body = re.sub(r"(?<!\\)((?:\\\\)*)\\[ \t]*\r?\n\s*", r"\1", body)
    else:
        body = raw[1:-1]
        if raw[0] == "'":
            return body

    def one(m) -> str:
        if m[1]:
            n = int(m[1][1:], 16)
            return chr(n) if not 0xD800 <= n < 0xE000 and n < 0x110000 else _fail(at)
        return ESCAPES[m[2]] if m[2] in ESCAPES else _fail(at)

    return re.sub(r"\\(?:(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})|(.))", one, body, flags=re.S)


def scalar(raw: str, at: int) -> tuple[str, Value]:
    if raw in ("true", "false"):
        return "Boolean", Value("Boolean", raw == "true")
    if m := re.fullmatch(rf"{DATE}(?:[Tt ]{TIME}(Z|z|[+-]\d\d:\d\d)?)?", raw):
        day = tuple(map(int, m.groups()[:3]))
        if not m[4]:
            return "LocalDate", Value("Date", day)
        time = _time(m.groups()[3:7])
        if not m[8]:
            return "LocalDateTime", Value("LocalDateTime", day + time)
        z = 0 if m[8] in "Zz" else (-1 if m[8][0] == "-" else 1) * (int(m[8][1:3]) * 3600 + int(m[8][4:]) * 60)
        return "OffsetDateTime", Value("OffsetDateTime", day + time + (z,))
    if m := re.fullmatch(TIME, raw):
        return "LocalTime", Value("Time", _time(m.groups()))
    if re.fullmatch(r"[+-]?(inf|nan)", raw):
        return "Float", float64(float(raw))
    plain = raw.replace("_", "") if not re.search(r"__|^_|_$|_\.|\._|_[eE]|[eE]_|[+-]_", raw) else "!"
    if re.fullmatch(r"[+-]?(0|[1-9]\d*)", plain) or re.fullmatch(r"0x[0-9a-fA-F]+|0o[0-7]+|0b[01]+", plain):
        n = int(plain, 0)
        return ("Integer", integer(n)) if -(1 << 63) <= n < 1 << 63 else _fail(at)
    if re.fullmatch(r"[+-]?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?", plain):
        return "Float", float64(float(plain))
    return _fail(at)


def _time(parts) -> tuple:
    h, m, s, f = parts
    digits = (f or "").rstrip("0")
    if int(h) > 23 or int(m) > 59 or int(s) > 59:
        raise Failure("toml.parse.syntax@1")
    return int(h), int(m), int(s), (int(digits or 0), -len(digits))


class Parser:
    def __init__(self, text: str):
        self.tree, self.tokens, at = Tree(text), [], 0
        while at < len(text):
            m = TOKENS.match(text, at) or _fail(at)
            kind = m.lastgroup
            self.tree.piece(kind, at, m.end(), "Trivia" if kind in ("Whitespace", "Newline", "Comment") else "Token")
            if kind not in ("Whitespace", "Comment"):
                self.tokens.append((kind, at, m.end()))
            at = m.end()
        self.tokens.append(("End", at, at))
        self.k = 0

    def peek(self) -> str:
        return self.tokens[self.k][0]

    def take(self, *kinds: str):
        t = self.tokens[self.k]
        if t[0] not in kinds:
            _fail(t[1])
        self.k += 1
        return t

    def lines(self) -> None:
        while self.peek() == "Newline":
            self.k += 1

    def raw(self, t) -> str:
        return self.tree.text[t[1] : t[2]]

    def key(self) -> list[tuple[str, int, int]]:
        out = []
        while True:
            t = self.take("Bare", "String")
            out.append((unquote(self.raw(t), t[1]) if t[0] == "String" else self.raw(t), t[1], t[2]))
            if self.peek() != "Dot":
                return out
            self.k += 1

    def table(self, parent: int | None, kind: str, start: int, end: int) -> dict:
        return {"node": self.tree.add("TomlItem", kind, parent, start, end), "items": {}, "kind": kind}

    def entry(self, table: dict, name: str, start: int, end: int) -> int:
        return self.tree.add("TomlEntry", None, table["node"], start, end, 0, name=name)

    def put(self, table: dict, name: str, entry: int, item) -> None:
        table["items"][name] = (entry, item)
        self.tree[entry]["value_id"] = item["node"]

    def down(self, table: dict, part, kind: str) -> dict:
        name, s, e = part
        if name not in table["items"]:
            entry = self.entry(table, name, s, e)
            self.put(table, name, entry, self.table(entry, kind, s, e))
        item = table["items"][name][1]
        return item["last"] if item["kind"] == "ArrayOfTables" else item if "items" in item else _fail(s)

    def parse(self) -> Tree:
        root = current = self.table(None, "Table", 0, len(self.tree.text))
        while True:
            self.lines()
            if self.peek() == "End":
                break
            if self.peek() == "LeftBracket":
                a = self.take("LeftBracket")
                many = self.peek() == "LeftBracket" and self.tokens[self.k][1] == a[2]
                if many:
                    self.k += 1
                path = self.key()
                end = self.take("RightBracket")
                if many:
                    end = self.take("RightBracket")
                here = root
                for part in path[:-1]:
                    here = self.down(here, part, "ImplicitTable")
                name, s, e = path[-1]
                old = here["items"].get(name)
                if many:
                    if old is None:
                        entry = self.entry(here, name, s, e)
                        self.put(here, name, entry, {"node": self.tree.add("TomlItem", "ArrayOfTables", entry, s, e), "kind": "ArrayOfTables", "count": 0})
                    array = here["items"][name][1]
                    if array["kind"] != "ArrayOfTables":
                        _fail(s)
                    element = self.tree.add("TomlArrayElement", None, array["node"], a[1], end[2], array["count"])
                    array["count"] += 1
                    current = array["last"] = self.table(element, "Table", a[1], end[2])
                    array.setdefault("tables", []).append(current)
                    self.tree[element]["value_id"] = current["node"]
                elif old is None:
                    entry = self.entry(here, name, s, e)
                    current = self.table(entry, "Table", a[1], end[2])
                    self.put(here, name, entry, current)
                elif old[1]["kind"] == "ImplicitTable":
                    current = old[1]
                    current["kind"] = "Table"
                    self.tree[current["node"]]["kind"] = "Table"
                    here["items"][name] = here["items"].pop(name)  # opened later: goes to the end
                else:
                    _fail(s)
            else:
                self.pair(current)
            if self.peek() not in ("Newline", "End"):
                _fail(self.tokens[self.k][1])
        self.tree.value = self.close(root)
        return self.tree

    def pair(self, table: dict) -> None:
        path = self.key()
        self.take("Equals")
        for part in path[:-1]:
            known = part[0] in table["items"]
            table = self.down(table, part, "DottedTable")
            if known and table["kind"] != "DottedTable":
                _fail(part[1])
        name, s, e = path[-1]
        if name in table["items"]:
            _fail(s)
        entry = self.entry(table, name, s, e)
        item = self.value(entry)
        self.tree[entry]["end_byte"] = self.tree[item["node"]]["end_byte"]
        self.put(table, name, entry, item)

    def value(self, parent: int) -> dict:
        t = self.take("String", "Bare", "LeftBracket", "LeftBrace")
        if t[0] == "LeftBracket":
            node, items = self.tree.add("TomlItem", "Array", parent, t[1], t[2]), []
            while True:
                self.lines()
                if self.peek() == "RightBracket":
                    break
                element = self.tree.add("TomlArrayElement", None, node, self.tokens[self.k][1], self.tokens[self.k][2], len(items))
                items.append(self.value(element))
                self.tree[element]["value_id"] = items[-1]["node"]
                self.lines()
                if self.peek() == "Comma":
                    self.k += 1
            self.tree[node]["end_byte"] = self.take("RightBracket")[2]
            return {"node": node, "kind": "Array", "list": items}
        if t[0] == "LeftBrace":
            table = self.table(parent, "InlineTable", t[1], t[2])
            while self.peek() != "RightBrace":
                self.pair(table)
                if self.peek() == "Comma":
                    self.k += 1
                    if self.peek() == "RightBrace":
                        _fail(self.tokens[self.k][1])
                elif self.peek() != "RightBrace":
                    _fail(self.tokens[self.k][1])
            self.tree[table["node"]]["end_byte"] = self.take("RightBrace")[2]
            return table
        if t[0] == "String":
            text = unquote(self.raw(t), t[1])
            return {"node": self.tree.add("TomlItem", "String", parent, t[1], t[2], text=text), "kind": "String", "value": string(text)}
        end = t[2]
        while self.peek() in ("Dot", "Bare") and self.tokens[self.k][1] == end:
            end = self.tokens[self.k][2]
            self.k += 1
        if self.peek() == "Bare" and re.fullmatch(DATE, self.tree.text[t[1] : end]) and self.tree.text[end : self.tokens[self.k][1]] == " ":
            end = self.tokens[self.k][2]
            self.k += 1
            while self.peek() in ("Dot", "Bare") and self.tokens[self.k][1] == end:
                end = self.tokens[self.k][2]
                self.k += 1
        kind, v = scalar(self.tree.text[t[1] : end], t[1])
        from docloom.functions.values import scalar_text

        return {"node": self.tree.add("TomlItem", kind, parent, t[1], end, text=scalar_text(v)), "kind": kind, "value": v}

    def close(self, item: dict) -> Value:
        """Number the entries in their final order, and give the value."""
        if "items" in item:
            for k, (entry, _) in enumerate(item["items"].values()):
                self.tree[entry]["ordinal"] = k
            return Value("Object", tuple((name, self.close(x)) for name, (_, x) in item["items"].items()))
        if item["kind"] == "ArrayOfTables":
            return sequence([self.close(t) for t in item["tables"]])
        return sequence([self.close(x) for x in item["list"]]) if "list" in item else item["value"]


def parse(text: str, profile: str = "toml.1.0@1") -> Tree:
    return Parser(text).parse()
