"""JSON, JSON with comments, and JSON5."""

from __future__ import annotations

import re

from docloom.functions.values import NULL, Value, decimal_text, float64, integer, sequence, string
from docloom.sources.tree import Failure, Tree

TOKENS = re.compile(
    r"""(?P<Whitespace>[ \t\r\n]+)|(?P<LineComment>//[^\r\n]*)|(?P<BlockComment>/\*.*?\*/)
    |(?P<LeftBrace>\{)|(?P<RightBrace>\})|(?P<LeftBracket>\[)|(?P<RightBracket>\])|(?P<Colon>:)|(?P<Comma>,)
    |(?P<String>"(?:[^"\\\x00-\x1f]|\\.)*"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*')
    |(?P<Number>[+-]?(?:0[xX][0-9a-fA-F]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|Infinity\b|NaN\b))
    |(?P<Identifier>(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4})(?:\w|[$\u200c\u200d]|\\u[0-9a-fA-F]{4})*)""",
    re.X | re.S,
)
STRICT_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\Z")
WORDS = {"true": "True", "false": "False", "null": "Null"}
#: Tokens that need no second look.
PLAIN = {"Whitespace", "LeftBrace", "RightBrace", "LeftBracket", "RightBracket", "Colon", "Comma", "String", "Number"}
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\", "/": "/"}
MORE = {"v": "\v", "0": "\0", "'": "'"}


def _unescape(body: str, json5: bool) -> str | None:
    if "\\" not in body:
        return body
    out, k = [], 0
    while k < len(body):
        c = body[k]
        if c != "\\":
            out.append(c)
            k += 1
            continue
        e = body[k + 1 : k + 2]
        if e == "u" and re.fullmatch("[0-9a-fA-F]{4}", body[k + 2 : k + 6]):
            n = int(body[k + 2 : k + 6], 16)
            k += 6
            if 0xD800 <= n < 0xDC00 and re.match(r"\\u[dD][c-fC-F][0-9a-fA-F]{2}", body[k : k + 6]):
                n = 0x10000 + ((n - 0xD800) << 10) + int(body[k + 2 : k + 6], 16) - 0xDC00
                k += 6
            if 0xD800 <= n < 0xE000:
                return None
            out.append(chr(n))
            continue
        if e in ESCAPES:
            out.append(ESCAPES[e])
        elif json5 and e in MORE:
            out.append(MORE[e])
        elif json5 and e == "x" and re.fullmatch("[0-9a-fA-F]{2}", body[k + 2 : k + 4]):
            out.append(chr(int(body[k + 2 : k + 4], 16)))
            k += 2
        elif json5 and e in ("\n", "\r", "\u2028", "\u2029"):
            k += body[k + 1 : k + 3] == "\r\n"
        elif json5 and e and not e.isdigit():
            out.append(e)
        else:
            return None
        k += 2
    return "".join(out)


class Parser:
    def __init__(self, text: str, profile: str):
        self.json5, self.comments = profile.startswith("json5"), not profile.startswith("json.")
        self.tree = Tree(text)
        self.tokens: list[tuple[str, int, int]] = []
        at, size, match, tokens, piece = 0, len(text), TOKENS.match, self.tokens, self.tree.piece
        if text.startswith("\ufeff"):
            piece("Bom", 0, 1, "Trivia")
            at = 1
        while at < size:
            m = match(text, at)
            kind = m.lastgroup if m else "ErrorRegion"
            end = m.end() if m else at + 1
            if not Tree.keep and kind in PLAIN:
                if kind != "Whitespace":
                    tokens.append((kind, at, end))
                at = end
                continue
            if kind == "Identifier" and m[0] in WORDS:
                kind = WORDS[m[0]]
            if kind in ("LineComment", "BlockComment") and not self.comments:
                self.tree.note("json.comment.not-allowed@1", at, end)
            if kind == "Whitespace" or kind.endswith("Comment"):
                piece(kind, at, end, "Trivia")
            else:
                piece(kind, at, end, "ErrorRegion" if kind == "ErrorRegion" else "Token")
                tokens.append((kind, at, end))
            at = end
        self.tokens.append(("End", len(text), len(text)))
        self.k = 0

    def peek(self) -> str:
        return self.tokens[self.k][0]

    def next(self) -> tuple[str, int, int]:
        t = self.tokens[self.k]
        self.k += self.k < len(self.tokens) - 1
        return t

    def text(self, t) -> str:
        return self.tree.text[t[1] : t[2]]

    def string(self, t) -> str | None:
        raw = self.text(t)
        if raw[0] == "'" and not self.json5:
            self.tree.note("json.string.quote@1", t[1], t[2])
        found = _unescape(raw[1:-1], self.json5)
        if found is None:
            self.tree.note("json.string.escape@1", t[1], t[2])
        return found

    def number(self, t) -> Value | None:
        raw = self.text(t)
        if raw.isdigit() and raw.isascii() and (raw[0] != "0" or raw == "0") and len(raw) < 4000:
            return integer(int(raw))
        if not self.json5 and not STRICT_NUMBER.match(raw):
            self.tree.note("json.number.syntax@1", t[1], t[2])
            return None
        sign, body = (-1, raw[1:]) if raw[0] == "-" else (1, raw.lstrip("+"))
        if body in ("Infinity", "NaN"):
            return float64(sign * float(body.replace("Infinity", "inf")))
        if body[:2] in ("0x", "0X"):
            return integer(sign * int(body, 16))
        if len(re.sub("[^0-9]", "", body)) > 100_000:
            raise Failure("json.parse.number-digits@1", t[1])
        return decimal_text(("-" if sign < 0 else "") + body) if re.search("[.eE]", body) else integer(sign * int(body))

    def parse(self) -> Tree:
        if self.peek() == "End":
            self.tree.note("json.value.missing@1")
            self.tree.add("JsonValue", "Missing")
            return self.tree
        _, self.tree.value = self.item(None, 0, 0)
        if self.peek() != "End":
            self.tree.note("json.document.trailing@1", self.tokens[self.k][1], len(self.tree.text))
        if any(code != "json.object.duplicate-member@1" for code, _, _ in self.tree.diagnostics):
            self.tree.value = None  # a recovered document has no portable value
        return self.tree

    def item(self, parent: int | None, ordinal: int, depth: int) -> tuple[int | None, Value | None]:
        if depth > 256:
            raise Failure("json.parse.depth@1", self.tokens[self.k][1])
        t, tree = self.next(), self.tree
        kind, start, end = t
        if kind == "String":
            text = self.string(t)
            return tree.add("JsonValue", "String", parent, start, end, ordinal, text=text), None if text is None else string(text)
        if kind == "Number":
            v = self.number(t)
            return tree.add("JsonValue", v.kind if v else "Unavailable", parent, start, end, ordinal, text=None if v is None else self.text(t) if v.kind == "Integer" and self.text(t).lstrip("-").isdigit() else _shown(v)), v
        if kind in ("True", "False", "Null"):
            v = NULL if kind == "Null" else Value("Boolean", kind == "True")
            return tree.add("JsonValue", v.kind, parent, start, end, ordinal, text=self.text(t)), v
        if kind not in ("LeftBrace", "LeftBracket"):
            tree.note("json.value.expected@1", start, end)
            self.k = max(0, self.k - (kind in ("RightBrace", "RightBracket", "Comma", "Colon")))
            return None, None
        closer = "RightBrace" if kind == "LeftBrace" else "RightBracket"
        node = tree.add("JsonValue", "Object" if kind == "LeftBrace" else "Array", parent, start, end, ordinal)
        found: list = []
        names: dict[str, int] = {}
        while self.peek() not in (closer, "End"):
            before = self.k
            name = None
            first = self.tokens[self.k]
            if kind == "LeftBrace":
                t = self.next()
                if t[0] == "String":
                    name = self.string(t)
                elif self.json5 and t[0] in ("Identifier", "True", "False", "Null", "Number"):
                    name = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), self.text(t))
                else:
                    tree.note("json.object.member-name@1", t[1], t[2])
                if self.peek() == "Colon":
                    self.next()
                else:
                    tree.note("json.object.missing-colon@1", t[2], t[2])
            entry = tree.add("JsonObjectMember" if kind == "LeftBrace" else "JsonArrayElement", None, node, first[1], first[2], len(found), name=name)
            child, v = self.item(entry, 0, depth + 1)
            tree[entry]["value_id"] = child
            tree[entry]["end_byte"] = self.tokens[self.k - 1][2]
            found.append((name, v))
            if name is not None and kind == "LeftBrace":
                if name in names:
                    tree.note("json.object.duplicate-member@1", first[1], first[2])
                names[name] = entry
            if self.peek() == "Comma":
                comma = self.next()
                if self.peek() == closer and not self.json5:
                    tree.note("json.trailing-comma@1", comma[1], comma[2])
            elif self.peek() not in (closer, "End"):
                tree.note("json.missing-comma@1", self.tokens[self.k][1], self.tokens[self.k][1])
            if self.k == before:
                self.next()
        if self.peek() == closer:
            self.next()
        else:
            tree.note("json.missing-close@1", start, end)
        tree[node]["end_byte"] = self.tokens[self.k - 1][2]
        if kind == "LeftBracket":
            return node, sequence([v for _, v in found])
        if any(n is None for n, _ in found):
            return node, None
        if len(names) == len(found):
            return node, Value("Object", tuple(found))
        return node, Value("EntryMapping", tuple((string(n), v) for n, v in found))


def _shown(v: Value) -> str:
    from docloom.functions.values import scalar_text

    return scalar_text(v)


class _Number(str):
    """The spelling of an integer."""


class _Decimal(str):
    """The spelling of a number with a fraction or an exponent."""


class _Members(list):
    """The members of an object."""


def _no_constant(name: str):
    raise ValueError(name)


def quick(text: str) -> Tree | None:
    """The rows of a strict document without places in the source, by the standard library's scanner: the same rows but for
    start_byte and end_byte. None where the document needs the full parser: it is broken, or has what that treats apart."""
    import json

    if "\\u" in text:
        return None
    try:
        top = json.loads(text, object_pairs_hook=_Members, parse_int=_Number, parse_float=_Decimal, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    tree = Tree(text)
    rows, add = tree.rows, tree.rows.append

    def put(x, parent: int | None, depth: int) -> int | None:
        kind = type(x)
        if kind is str:
            add({"role": "JsonValue", "kind": "String", "parent_id": parent, "ordinal": 0, "text": x})
        elif kind is _Number:
            if len(x) > 4000:
                return None
            add({"role": "JsonValue", "kind": "Integer", "parent_id": parent, "ordinal": 0, "text": str(x)})
        elif kind is _Decimal:
            v = decimal_text(x)
            add({"role": "JsonValue", "kind": v.kind, "parent_id": parent, "ordinal": 0, "text": _shown(v)})
        elif kind is _Members or kind is list:
            if depth > 200:
                return None
            own = kind is _Members
            add({"role": "JsonValue", "kind": "Object" if own else "Array", "parent_id": parent, "ordinal": 0})
            node, names = len(rows), set()
            for k, item in enumerate(x):
                name = None
                if own:
                    name, item = item
                    if name in names:
                        tree.note("json.object.duplicate-member@1")
                    names.add(name)
                row = {"role": "JsonObjectMember" if own else "JsonArrayElement", "kind": None, "parent_id": node, "ordinal": k, "name": name}
                add(row)
                row["value_id"] = len(rows) + 1
                if put(item, len(rows), depth + 1) is None:
                    return None
            return node
        else:
            add({"role": "JsonValue", "kind": "Null" if x is None else "Boolean", "parent_id": parent, "ordinal": 0, "text": "null" if x is None else "true" if x else "false"})
        return len(rows)

    if put(top, None, 0) is None:
        return None
    tree.defer(lambda: Parser(text, "json.strict@1").parse().value)
    return tree


def parse(text: str, profile: str = "json.strict@1") -> Tree:
    return Parser(text, profile).parse()
