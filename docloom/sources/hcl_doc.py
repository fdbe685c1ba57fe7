"""HCL native syntax and tfvars: bodies, attributes, blocks, and expressions that are never evaluated."""

from __future__ import annotations

import re

from docloom.functions.values import NULL, Value, decimal_text, integer, sequence, string
from docloom.sources.tree import Failure, Tree

TOKENS = re.compile(
    r"""(?P<Whitespace>[ \t]+)|(?P<LineBreak>\r?\n)|(?P<LineComment>(?:\#|//)[^\n]*)|(?P<InlineComment>/\*.*?\*/)|(?P<Heredoc><<-?)(?=[A-Za-z_])
    |(?P<Identifier>[A-Za-z_][\w-]*)|(?P<Number>[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<StringOpen>")|(?P<BraceOpen>\{)|(?P<BraceClose>\})|(?P<BracketOpen>\[)
    |(?P<BracketClose>\])|(?P<ParenOpen>\()|(?P<ParenClose>\))|(?P<Comma>,)|(?P<Operator>==|!=|<=|>=|&&|\|\||=>|\.\.\.|[-+*/%!<>.])|(?P<Equals>=)|(?P<Colon>:)|(?P<QuestionMark>\?)""",
    re.X | re.S,
)
LEVELS = [("||",), ("&&",), ("==", "!="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%")]
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\"}


class Parser:
    def __init__(self, text: str, profile: str):
        self.tree, self.t, self.tfvars, self.k = Tree(text), text, "tfvars" in profile, 0
        self.lost: list[tuple[int, int]] = []
        self.tokens: list = []
        at = 0
        while at < len(text):
            m = TOKENS.match(text, at)
            if not m:
                self.tree.piece("ErrorRegion", at, at + 1, "ErrorRegion")
                self.tree.note("hcl.parse.token@1", at, at + 1)
                at += 1
                continue
            kind, end = m.lastgroup, m.end()
            parts = None
            if kind in ("StringOpen", "Heredoc"):
                held = len(self.tree.pieces)
                try:
                    if kind == "StringOpen":
                        self.tree.piece("StringOpen", at, at + 1)
                        parts, end = self.template(at + 1, '"')
                        self.tree.piece("StringClose", end - 1, end)
                    else:
                        parts, end = self.heredoc(at)
                    kind = "Template"
                except Failure as e:  # what is left of the line is lost
                    del self.tree.pieces[held:]
                    end = text.find("\n", at)
                    end = len(text) if end < 0 else end
                    kind = "Error"
                    self.lose(at, end, e.code)
            else:
                self.tree.piece(kind, at, end, "Trivia" if kind in ("Whitespace", "LineBreak") or kind.endswith("Comment") else "Token")
            if kind not in ("Whitespace", "InlineComment", "LineComment"):
                self.tokens.append((kind, at, end, parts))
            at = end
        self.tokens.append(("End", len(text), len(text), None))

    def template(self, at: int, close: str) -> tuple[list, int]:
        parts, start, t = [], at, self.t
        while True:
            if at >= len(t) or (close == '"' and t[at] == "\n"):
                raise Failure("hcl.parse.unterminated-string@1", at)
            if t[at] == close:
                break
            if t[at] == "\\":
                at += 2
            elif t[at : at + 3] in ("$${", "%%{"):
                at += 3
            elif t[at : at + 2] in ("${", "%{"):
                if at > start:
                    parts.append(("literal", start, at))
                    self.tree.piece("StringContent", start, at)
                end = self.balance(at + 2)
                name = "Interpolation" if t[at] == "$" else "Directive"
                self.tree.piece(f"{name}Open", at, at + 2)
                self.tree.piece(f"{name}Content", at + 2, end)
                self.tree.piece(f"{name}Close", end, end + 1)
                parts.append((name.lower(), at, end + 1))
                at = start = end + 1
            else:
                at += 1
        if at > start:
            parts.append(("literal", start, at))
            self.tree.piece("StringContent", start, at)
        return parts, at + 1

    def balance(self, at: int) -> int:
        depth = 0
        while at < len(self.t):
            c = self.t[at]
            if c == '"':
                at += 1
                while at < len(self.t) and self.t[at] != '"':
                    at = self.balance(at + 2) + 1 if self.t[at : at + 2] == "${" else at + (2 if self.t[at] == "\\" else 1)
            elif c == "{":
                depth += 1
            elif c == "}":
                if not depth:
                    return at
                depth -= 1
            at += 1
        raise Failure("hcl.parse.unterminated-template@1", at)

    def heredoc(self, at: int) -> tuple[list, int]:
        m = re.compile(r"<<(-?)([A-Za-z_][\w-]*)[ \t]*\r?\n(.*?)^([ \t]*)\2[ \t]*(?=\r?\n|\Z)", re.S | re.M).match(self.t, at)
        if not m:
            raise Failure("hcl.parse.unterminated-heredoc@1", at)
        self.tree.piece("HeredocOpen", at, m.start(3))
        self.tree.piece("HeredocContent", m.start(3), m.end(3))
        self.tree.piece("HeredocClose", m.end(3), m.end())
        dynamic = re.search(r"(?<!\$)\$\{|(?<!%)%\{", m[3])
        return [("interpolation" if dynamic else "heredoc-" if m[1] else "heredoc", m.start(3), m.end(3))], m.end()

    def peek(self, skip: bool = False):
        while skip and self.tokens[self.k][0] == "LineBreak":
            self.k += 1
        return self.tokens[self.k]

    def take(self, kind: str, skip: bool = False):
        t = self.peek(skip)
        if t[0] != kind:
            raise Failure("hcl.parse.syntax@1", t[1])
        self.k += 1
        return t

    def raw(self, t) -> str:
        return self.t[t[1] : t[2]]

    def lose(self, start: int, end: int, code: str) -> None:
        """Note an error region; an empty one has a diagnostic only."""
        self.tree.note(code, start, end)
        if end > start:
            self.lost.append((start, end))

    def skip_item(self, first: int) -> int:
        """Go on after a failed item that began at token `first`: to the end of its line, or to the close of the brackets it
        opened; a close that belongs to what is around it is left alone. Gives where the region ends."""
        closes, stack = {"BraceOpen": "BraceClose", "BracketOpen": "BracketClose", "ParenOpen": "ParenClose"}, []
        for t in self.tokens[first : self.k]:
            if t[0] in closes:
                stack.append(closes[t[0]])
            elif stack and t[0] == stack[-1]:
                stack.pop()
        while True:
            t = self.tokens[self.k]
            if t[0] == "End" or not stack and t[0] in ("LineBreak", *closes.values()):
                return t[1]
            self.k += 1
            if t[0] in closes:
                stack.append(closes[t[0]])
            elif t[0] in closes.values():
                if stack.pop() == t[0] and not stack:
                    return t[2]

    def parse(self) -> Tree:
        _, value = self.body(None, "End", 0)
        if self.lost:
            inside = lambda s, e: any(a <= s and e <= b for a, b in self.lost)
            whole = [r for r in self.lost if not any(a <= r[0] and r[1] <= b and (a, b) != r for a, b in self.lost)]
            kept = [p for p in self.tree.pieces if not inside(p[2], p[3])]
            self.tree.pieces = sorted([*kept, *[("ErrorRegion", "ErrorRegion", s, e) for s, e in dict.fromkeys(whole)]], key=lambda p: p[2])
            value = None
        self.tree.value = Value("Object", (("record", string("hcl.body@1")), ("body", value))) if value is not None else None
        return self.tree

    def body(self, parent, close: str, depth: int) -> tuple[int, Value | None]:
        if depth > 128:
            raise Failure("hcl.parse.depth@1")
        node, items, names, n = self.tree.add("HclBody", None, parent, self.peek()[1]), [], set(), 0
        while self.peek(True)[0] not in (close, "End"):
            first, rows, before = self.k, len(self.tree.rows), set(names)
            try:
                items.append(self.item(node, names, n, close, depth))
                n += 1
            except Failure as e:
                if e.code not in ("hcl.parse.syntax@1",):
                    raise
                if first == self.k and self.peek()[0] in ("BraceClose", "BracketClose", "ParenClose"):
                    self.lose(self.peek()[1], self.peek()[1], e.code)  # closes nothing
                    self.k += 1
                else:
                    del self.tree.rows[rows:]
                    self.tree.scalars = {k: v for k, v in self.tree.scalars.items() if k <= rows}
                    names.clear()
                    names.update(before)
                    start = self.tokens[first][1]
                    self.k += self.k == first
                    self.lose(start, self.skip_item(first), e.code)
                items.append(None)
        if close != "End" and self.peek()[0] == "End":
            self.lose(self.peek()[1], self.peek()[1], "hcl.parse.syntax@1")  # never closed
            items.append(None)
        self.tree[node]["end_byte"] = self.peek()[1]
        return node, None if None in items else sequence(items)

    def item(self, node: int, names: set, n: int, close: str, depth: int) -> Value | None:
        t = self.take("Identifier", True)
        name = self.raw(t)
        if self.peek()[0] == "Equals":
            self.k += 1
            attribute = self.tree.add("HclAttribute", "attribute", node, t[1], t[2], n, name=name)
            if name in names:
                self.tree.note("hcl.attribute.duplicate@1", t[1], t[2])
            names.add(name)
            child, v = self.expression(attribute, 0)
            self.tree[attribute].update(value_id=child, end_byte=self.tokens[self.k - 1][2])
            out = None if v is None else Value("Object", (("kind", string("attribute")), ("name", string(name)), ("value", v)))
        else:
            if self.tfvars:
                self.tree.note("hcl.tfvars.block@1", t[1], t[2])
            block = self.tree.add("HclBlock", "block", node, t[1], t[2], n, name=name)
            labels = []
            while self.peek()[0] in ("Template", "Identifier"):
                x = self.take(self.peek()[0])
                text = self.text(x) if x[0] == "Template" else self.raw(x)
                self.tree.add("HclBlockLabel", None, block, x[1], x[2], len(labels), name=text, text=text)
                labels.append(string(text))
            self.take("BraceOpen")
            inner, v = self.body(block, "BraceClose", depth + 1)
            if self.peek(True)[0] != "End":
                self.take("BraceClose", True)
            self.tree[block].update(value_id=inner, end_byte=self.tokens[self.k - 1][2])
            out = None if v is None else Value("Object", (("kind", string("block")), ("type", string(name)), ("labels", sequence(labels)), ("body", v)))
        if self.peek()[0] not in ("LineBreak", close, "End"):
            raise Failure("hcl.parse.syntax@1", self.peek()[1])
        return out

    def text(self, t) -> str | None:
        """The text of a template without interpolation or directive."""
        out = ""
        for kind, s, e in t[3]:
            body = self.t[s:e]
            if kind == "literal":
                out += re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else ESCAPES.get(m[2], m[2]), body).replace("$${", "${").replace("%%{", "%{")
            elif kind == "heredoc":
                out += body
            elif kind == "heredoc-":
                lines = body.splitlines(keepends=True)
                least = min((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), default=0)
                out += "".join(x[least:] for x in lines)
            else:
                return None
        return out

    def make(self, kind: str, parent, start: int, ordinal: int, value: Value | None, literal: bool = True) -> tuple[int, Value | None]:
        from docloom.functions.values import scalar_text

        node = self.tree.add("HclExpression", kind, parent, start, self.tokens[self.k - 1][2], ordinal, state="literal" if value is not None else None, tag=value.kind if value is not None else None)
        self.tree[node]["text"] = scalar_text(value) if value is not None else None
        if value is not None:
            self.tree.scalars[node] = value
        return node, value

    def adopt(self, node: int, *kids: int) -> None:
        for k, c in enumerate(kids):
            self.tree[c].update(parent_id=node, ordinal=k)

    def expression(self, parent, ordinal: int, depth: int = 0) -> tuple[int, Value | None]:
        if depth > 24:
            raise Failure("hcl.parse.expression-depth@1", self.peek()[1])
        node, value = self.binary(parent, ordinal, depth, 0)
        if self.peek()[0] == "QuestionMark":
            self.k += 1
            a, _ = self.expression(None, 1, depth + 1)
            self.take("Colon", True)
            b, _ = self.expression(None, 2, depth + 1)
            whole, _ = self.make("conditional", parent, self.tree[node]["start_byte"], ordinal, None)
            self.adopt(whole, node, a, b)
            return whole, None
        return node, value

    def binary(self, parent, ordinal: int, depth: int, level: int) -> tuple[int, Value | None]:
        if level == len(LEVELS):
            return self.unary(parent, ordinal, depth)
        node, value = self.binary(parent, ordinal, depth, level + 1)
        while self.peek()[0] == "Operator" and self.raw(self.peek()) in LEVELS[level]:
            name = self.raw(self.take("Operator"))
            other, _ = self.binary(None, 1, depth, level + 1)
            whole, value = self.make("binary", parent, self.tree[node]["start_byte"], ordinal, None)
            self.tree[whole]["name"] = name
            self.adopt(whole, node, other)
            node = whole
        return node, value

    def unary(self, parent, ordinal: int, depth: int) -> tuple[int, Value | None]:
        t = self.peek()
        if t[0] == "Operator" and self.raw(t) in ("-", "!"):
            self.k += 1
            child, v = self.unary(None, 0, depth)
            value = None
            if self.raw(t) == "-" and v is not None and v.kind in ("Integer", "Decimal"):
                value = integer(-v.data) if v.kind == "Integer" else Value("Decimal", (-v.data[0], v.data[1]))
            whole, value = self.make("unary", parent, t[1], ordinal, value)
            self.adopt(whole, child)
            return whole, value
        return self.postfix(parent, ordinal, depth)

    def postfix(self, parent, ordinal: int, depth: int) -> tuple[int, Value | None]:
        node, value = self.primary(parent, ordinal, depth)
        start, kids = self.tree[node]["start_byte"], [node]
        while True:
            t = self.peek()
            if t[0] == "Operator" and self.raw(t) == ".":
                self.k += 1
                nxt = self.peek()
                if nxt[0] not in ("Identifier", "Number") and self.raw(nxt) != "*":
                    raise Failure("hcl.parse.syntax@1", nxt[1])
                self.k += 1
            elif t[0] == "BracketOpen":
                self.k += 1
                if self.peek()[0] == "Operator" and self.raw(self.peek()) == "*":
                    self.k += 1
                else:
                    kids.append(self.expression(None, len(kids), depth + 1)[0])
                self.take("BracketClose", True)
            else:
                break
            value = None
        if self.tokens[self.k - 1][2] > self.tree[node]["end_byte"] and self.tokens[self.k - 1][1] >= self.tree[node]["end_byte"]:
            whole, _ = self.make("traversal", parent, start, ordinal, None)
            self.adopt(whole, *kids)
            return whole, None
        return node, value

    def primary(self, parent, ordinal: int, depth: int) -> tuple[int, Value | None]:
        t = self.peek()
        self.k += 1
        raw, s = self.raw(t), t[1]
        if t[0] == "Number":
            v = decimal_text(raw)
            return self.make("number", parent, s, ordinal, integer(v.data[0] * 10 ** v.data[1]) if v.data[1] >= 0 else v)
        if t[0] == "Template":
            text = self.text(t)
            node, v = self.make("template", parent, s, ordinal, None if text is None else string(text))
            for k, (kind, a, b) in enumerate(t[3]):
                self.tree.add("HclTemplatePart", "literal" if kind.startswith("heredoc") else kind, node, a, b, k, text=self.t[a:b])
            return node, v
        if t[0] == "Identifier":
            if raw in ("true", "false"):
                return self.make("boolean", parent, s, ordinal, Value("Boolean", raw == "true"))
            if raw == "null":
                return self.make("null", parent, s, ordinal, NULL)
            if self.peek()[0] == "ParenOpen":
                self.k += 1
                kids = self.listed("ParenClose", depth)[0]
                node, _ = self.make("function-call", parent, s, ordinal, None)
                self.tree[node]["name"] = raw
                self.adopt(node, *kids)
                return node, None
            node, _ = self.make("variable-ref", parent, s, ordinal, None)
            self.tree[node]["name"] = raw
            return node, None
        if t[0] == "ParenOpen":
            self.peek(True)
            child, v = self.expression(None, 0, depth + 1)
            self.take("ParenClose", True)
            node, v = self.make("parenthesized", parent, s, ordinal, v)
            self.adopt(node, child)
            return node, v
        if t[0] in ("BracketOpen", "BraceOpen"):
            tuple_ = t[0] == "BracketOpen"
            first = self.peek(True)
            if first[0] == "Identifier" and self.raw(first) == "for":
                return self.comprehension(parent, ordinal, s, "for-tuple" if tuple_ else "for-object", "BracketClose" if tuple_ else "BraceClose")
            if tuple_:
                kids, values = self.listed("BracketClose", depth)
                node, v = self.make("tuple", parent, s, ordinal, None if None in values else sequence(values))
                self.adopt(node, *kids)
                return node, v
            kids, entries = [], []
            while self.peek(True)[0] != "BraceClose":
                key = self.peek()
                k, kv = self.expression(None, len(kids), depth + 1)
                if self.tree[k]["kind"] == "variable-ref":
                    kv = string(self.tree[k]["name"])
                if self.peek()[0] not in ("Equals", "Colon"):
                    raise Failure("hcl.parse.syntax@1", self.peek()[1])
                self.k += 1
                self.peek(True)
                x, xv = self.expression(None, len(kids), depth + 1)
                self.tree[x]["name"] = self.raw(key).strip('"')
                kids.append(x)
                entries.append((kv, xv))
                if self.peek()[0] == "Comma":
                    self.k += 1
            self.k += 1
            bad = any(k is None or v is None for k, v in entries)
            node, v = self.make("object", parent, s, ordinal, None if bad else Value("EntryMapping", tuple(entries)))
            self.adopt(node, *kids)
            return node, v
        self.k -= 1
        raise Failure("hcl.parse.syntax@1", s)

    def listed(self, close: str, depth: int) -> tuple[list[int], list]:
        kids, values = [], []
        while self.peek(True)[0] != close:
            child, v = self.expression(None, len(kids), depth + 1)
            kids.append(child)
            values.append(v)
            self.peek(True)
            if self.peek()[0] == "Operator" and self.raw(self.peek()) == "...":
                self.k += 1
            if self.peek(True)[0] == "Comma":
                self.k += 1
            elif self.peek()[0] != close:
                raise Failure("hcl.parse.syntax@1", self.peek()[1])
        self.k += 1
        return kids, values

    def comprehension(self, parent, ordinal: int, start: int, kind: str, close: str) -> tuple[int, None]:
        depth = 1
        opening = {"BracketOpen", "BraceOpen"}
        while depth:
            t = self.peek()
            if t[0] == "End":
                raise Failure("hcl.parse.syntax@1", t[1])
            depth += (t[0] in opening) - (t[0] in ("BracketClose", "BraceClose"))
            self.k += 1
        return self.make(kind, parent, start, ordinal, None)


def parse(text: str, profile: str = "hcl.native@1") -> Tree:
    return Parser(text, profile).parse()
