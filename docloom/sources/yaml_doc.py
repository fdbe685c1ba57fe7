"""YAML 1.2 core and 1.1 compatible: documents, anchors and aliases, tags, block and flow styles."""

from __future__ import annotations

import base64
import re

from docloom.functions.values import NULL, Value, decimal_text, float64, integer, mapping, scalar_text, sequence, string
from docloom.sources.tree import Failure, Tree

PREFIX = "tag:yaml.org,2002:"
ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029", "\t": "\t"}
FLOW = {"[": "FlowSequenceStart", "]": "FlowSequenceEnd", "{": "FlowMappingStart", "}": "FlowMappingEnd", ",": "FlowEntry"}


ALIAS = re.compile(r"\*([^\s,\[\]{}]+)")


def resolve(text: str, old: bool) -> tuple[str, Value]:
    """Tag and value of a plain scalar: null, bool, int, float, (1.1) timestamp, else str."""
    if text in ("", "~", "null", "Null", "NULL"):
        return "null", NULL
    words = {"true": True, "false": False} | ({"y": True, "n": False, "yes": True, "no": False, "on": True, "off": False} if old else {})
    if text.lower() in words and text in (text.lower(), text.capitalize(), text.upper()):
        return "bool", Value("Boolean", words[text.lower()])
    if text.isalpha() and text.lower() not in ("true", "false", "null") and not old:
        return "str", string(text)
    plain = text.replace("_", "") if old else text
    if m := re.fullmatch(r"([-+]?)(0x[0-9a-fA-F]+|0b[01]+" + ("" if old else "|0o[0-7]+") + ")", plain):
        return "int", integer((-1 if m[1] == "-" else 1) * int(m[2], 0))
    if old and re.fullmatch(r"[-+]?0[0-7]+", plain):
        return "int", integer(int(plain, 8))
    if old and re.fullmatch(r"[-+]?[1-9][0-9]*(:[0-5]?[0-9])+", plain):
        n = 0
        for part in plain.lstrip("+-").split(":"):
            n = n * 60 + int(part)
        return "int", integer(-n if plain[0] == "-" else n)
    if re.fullmatch(r"[-+]?[0-9]+", plain):
        return "int", integer(int(plain))
    if re.search("[.eE]", plain) and re.fullmatch(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?", plain):
        return "float", decimal_text(plain)
    if m := re.fullmatch(r"([-+]?)\.(inf|Inf|INF)|\.(nan|NaN|NAN)", text):
        return "float", float64(float("nan") if m[3] else float(f"{m[1]}inf"))
    if old and (m := re.fullmatch(r"(\d{4})-(\d\d?)-(\d\d?)", text)):
        return "timestamp", Value("Date", tuple(map(int, m.groups())))
    return "str", string(text)


class Parser:
    def __init__(self, text: str, profile: str):
        self.t, self.old, self.at, self.n = text, "1.1" in profile, 0, len(text)
        self.tree = Tree(text)
        self.anchors: dict[str, int] = {}
        self.values: dict[int, object] = {}
        self.handles: dict[str, str] = {}
        self.marks: list[tuple[str, int, int]] = []

    # Places and trivia
    def fail(self, code: str = "yaml.parse.syntax@1"):
        raise Failure(code, self.at)

    def column(self, at: int | None = None) -> int:
        at = self.at if at is None else at
        return at - (self.t.rfind("\n", 0, at) + 1)

    def mark(self, kind: str, start: int, end: int) -> None:
        self.marks.append((kind, start, end))

    def skip(self) -> None:
        """White space, line breaks and comments up to the next content."""
        while self.at < self.n:
            c = self.t[self.at]
            if c == "#" and (self.at == 0 or self.t[self.at - 1] in " \t\r\n"):
                end = self.t.find("\n", self.at)
                end = self.n if end < 0 else end
                self.mark("Comment", self.at, end)
                self.at = end
            elif c in " \t\r\n\ufeff":
                self.at += 1
            else:
                return

    def edge(self) -> bool:
        """At a document marker or the end?"""
        return self.at >= self.n or (self.column() == 0 and re.match(r"(---|\.\.\.)(?=\s|\Z)", self.t[self.at : self.at + 4]) is not None)

    def parse(self) -> Tree:
        tree = self.tree
        stream = tree.add("YamlStream", None, None, 0, self.n)
        roots, count = [], 0
        while True:
            self.skip()
            self.handles = {}
            while self.t.startswith("%", self.at) and self.column() == 0:
                end = self.t.find("\n", self.at)
                end = self.n if end < 0 else end
                if m := re.match(r"%TAG\s+(\S+)\s+(\S+)", self.t[self.at : end]):
                    self.handles[m[1]] = m[2]
                self.mark("Directive", self.at, end)
                self.at = end
                self.skip()
            explicit = self.t.startswith("---", self.at) and self.edge()
            if explicit:
                self.mark("DocumentStart", self.at, self.at + 3)
                self.at += 3
            elif self.at >= self.n and count:
                break
            elif self.edge() and self.at < self.n:
                self.mark("DocumentEnd", self.at, self.at + 3)
                self.at += 3
                continue
            if self.at >= self.n and not explicit and not count and not self.t.strip():
                break
            doc = tree.add("YamlDocument", None, stream, self.at, self.at, count)
            count += 1
            self.anchors = {}
            root, value = self.node(-1, doc)
            tree[doc]["value_id"] = root
            roots.append((root, value))
            self.skip()
            if not self.edge():
                self.fail()
            tree[doc]["end_byte"] = self.at
            if self.at < self.n and self.t.startswith("...", self.at):
                self.mark("DocumentEnd", self.at, self.at + 3)
                self.at += 3
            if self.at >= self.n:
                break
        self.cover()
        tree.value = roots[0][1] if len(roots) == 1 else None
        return tree

    def cover(self) -> None:
        """Pieces for the marks, and white space and line breaks for what lies between."""
        at = 0
        if not Tree.keep:
            return
        for kind, s, e in [*sorted(self.marks, key=lambda m: m[1]), ("", self.n, self.n)]:
            for m in re.finditer(r"\r?\n|\ufeff|[^\r\n\ufeff]+|\r", self.t[at:s]):
                self.tree.piece("Newline" if m[0].endswith("\n") else "Bom" if m[0] == "\ufeff" else "Whitespace", at + m.start(), at + m.end(), "Trivia")
            self.tree.piece(kind, s, e, "Trivia" if kind == "Comment" else "Token")
            at = max(at, e)

    # Nodes
    def properties(self) -> tuple[str | None, str | None, int]:
        anchor = tag = None
        start = self.at
        while self.at < self.n and self.t[self.at] in "&!":
            m = re.compile(r"&[^\s,\[\]{}]+|!<[^>]*>|![^\s,\[\]{}]*").match(self.t, self.at)
            self.mark("Anchor" if m[0][0] == "&" else "Tag", self.at, m.end())
            if m[0][0] == "&":
                anchor = m[0][1:]
            elif m[0].startswith("!<"):
                tag = m[0][2:-1]
            else:
                handle = re.match(r"!(?:[\w-]*!)?", m[0])[0]
                handle = handle if m[0] != handle or handle == "!" else "!"
                rest = m[0][len(handle) :]
                tag = self.handles.get(handle, PREFIX if handle == "!!" else handle) + rest
            self.at = m.end()
            self.skip_line()
        return anchor, tag, start

    def skip_line(self) -> None:
        while self.at < self.n and self.t[self.at] in " \t":
            self.at += 1

    def make(self, kind: str, parent: int, start: int, anchor: str | None, tag: str | None, ordinal: int = 0, **more) -> int:
        node = self.tree.add("YamlNode", kind, parent, start, self.at, ordinal, tag=tag or PREFIX + {"Sequence": "seq", "Mapping": "map", "Scalar": "str"}[kind], **more)
        if anchor:
            self.tree.add("YamlAnchorDefinition", None, node, start, self.at, 0, name=anchor, target_id=node)
            self.anchors[anchor] = node
            self.values[node] = None
        return node

    def alias(self, parent: int, ordinal: int) -> tuple[int, Value | None]:
        m = ALIAS.match(self.t, self.at) or self.fail()
        target = self.anchors.get(m[1]) or self.fail("yaml.alias.undefined@1")
        self.tree.add("YamlAliasOccurrence", None, parent, self.at, m.end(), ordinal, name=m[1], target_id=target)
        self.mark("Alias", self.at, m.end())
        self.at = m.end()
        return target, self.values.get(target)

    def node(self, indent: int, parent: int, ordinal: int = 0, flow: bool = False, inline: bool = False) -> tuple[int, Value | None]:
        """A node indented more than `indent`. inline: on the line of a sequence dash, where a mapping may start."""
        self.skip() if not flow else self.skip()
        anchor = tag = None
        start = self.at
        if not self.edge() and (self.column() > indent or flow):
            line = self.t.rfind("\n", 0, self.at)
            if self.t[self.at] == "*" and not self.is_key(flow):
                return self.alias(parent, ordinal)
            if self.t[self.at] in "&!" and not (not flow and self.is_key(flow)):
                anchor, tag, start = self.properties()
                self.skip()
                if self.t.rfind("\n", 0, self.at) != line:
                    line = -2
        dash = self.t[self.at : self.at + 1] == "-" and self.t[self.at + 1 : self.at + 2] in ("", " ", "\n", "\r", "\t")
        low = self.column() <= indent and not (dash and self.column() == indent and self.may_dash)
        if self.edge() or (not flow and low) or (flow and self.t[self.at] in ",]}"):
            return self.finish(self.make("Scalar", parent, start, anchor, tag), "", tag, plain=True)
        c = self.t[self.at]
        if not flow and dash:
            return self.block_sequence(parent, start, anchor, tag, ordinal)
        if not flow and (self.is_key(flow) or (c == "?" and self.t[self.at + 1 : self.at + 2] in (" ", "\n", ""))):
            return self.block_mapping(parent, start, anchor, tag, ordinal)
        if c in "[{":
            return self.flow_collection(parent, start, anchor, tag, ordinal)
        if c in "\"'":
            text = self.quoted()
            return self.finish(self.make("Scalar", parent, start, anchor, tag, ordinal), text, tag)
        if c in "|>" and not flow:
            text = self.block_scalar(indent)
            return self.finish(self.make("Scalar", parent, start, anchor, tag, ordinal), text, tag)
        text = self.plain(indent, flow)
        return self.finish(self.make("Scalar", parent, start, anchor, tag, ordinal), text, tag, plain=True)

    may_dash = False

    def finish(self, node: int, text: str, tag: str | None, plain: bool = False) -> tuple[int, Value | None]:
        row = self.tree[node]
        row["end_byte"] = self.at
        if tag is None:
            name, value = resolve(text, self.old) if plain else ("str", string(text))
            row["tag"] = PREFIX + name
        elif tag == PREFIX + "str" or tag == "!":
            row["tag"], value = PREFIX + "str", string(text)
        elif tag == PREFIX + "binary":
            value = Value("Bytes", base64.b64decode(text))
        elif tag.startswith(PREFIX):
            name, value = resolve(text, self.old)
            if tag == PREFIX + "float" and name == "int":
                name, value = "float", decimal_text(text)
            if PREFIX + name != tag:
                self.fail("yaml.tag.mismatch@1")
        else:
            value = None
        row["text"] = text if value is None or value.kind == "String" else (scalar_text(value) if value.kind not in ("Null", "Decimal") else "null" if value.kind == "Null" else text)
        self.values[node] = value
        if value is not None:
            self.tree.scalars[node] = value
        return node, value

    def is_key(self, flow: bool) -> bool:
        """Is there an implicit key on this line from here?"""
        m = re.compile(r"(?:[&!][^\s]*[ \t]+)*(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\n]|'')*'|\*[^\s,\[\]{}]+|\[[^\n\]]*\]|\{[^\n}]*\}|(?![-?:,\[\]{}#&*!|>'\"%@`])[^\n]*?|[-?:](?=\S)[^\n]*?)[ \t]*:(?=[ \t\r\n]|\Z)").match(self.t, self.at)
        return bool(m) and " #" not in m[0]

    def block_sequence(self, parent, start, anchor, tag, ordinal) -> tuple[int, Value | None]:
        column, items = self.column(), []
        node = self.make("Sequence", parent, start, anchor, tag, ordinal)
        while not self.edge() and self.column() == column and re.match(r"-(\s|\Z)", self.t[self.at : self.at + 2]):
            self.mark("SequenceEntry", self.at, self.at + 1)
            element = self.tree.add("YamlSequenceElement", None, node, self.at, self.at, len(items))
            self.at += 1
            old, self.may_dash = self.may_dash, False
            child, value = self.node(column, element)
            self.may_dash = old
            self.tree[element].update(value_id=child, end_byte=self.at)
            items.append(value)
            self.skip()
        return self.done(node, sequence(items) if None not in items else None, column)

    def done(self, node: int, value: Value | None, column: int | None) -> tuple[int, Value | None]:
        tag = self.tree[node]["tag"]
        value = value if tag in (PREFIX + "seq", PREFIX + "map") else None
        self.tree[node]["end_byte"] = self.at
        self.values[node] = value
        if column is not None and not self.edge() and self.column() > column:
            self.fail("yaml.parse.indentation@1")
        return node, value

    def block_mapping(self, parent, start, anchor, tag, ordinal) -> tuple[int, Value | None]:
        column, entries = self.column(), []
        node = self.make("Mapping", parent, start, anchor, tag, ordinal)
        while not self.edge() and self.column() == column:
            entry = self.tree.add("YamlMappingEntry", None, node, self.at, self.at, len(entries))
            if self.t[self.at] == "?" and self.t[self.at + 1 : self.at + 2] in (" ", "\n", ""):
                self.mark("ExplicitKey", self.at, self.at + 1)
                self.at += 1
                key, kv = self.node(column, entry)
                self.skip()
            elif self.is_key(False):
                key, kv = self.simple_key(entry)
            else:
                self.fail()
            self.skip_line()
            if self.t[self.at : self.at + 1] == ":" and not self.edge():
                self.mark("MappingValue", self.at, self.at + 1)
                self.at += 1
                old, self.may_dash = self.may_dash, True
                child, value = self.node(column, entry, 1)
                self.may_dash = old
            else:
                child, value = self.finish(self.make("Scalar", entry, self.at, None, None, 1), "", None, plain=True)
            self.tree[entry].update(key_id=key, value_id=child, end_byte=self.at, name=self.tree[key].get("text"))
            entries.append((kv, value))
            self.skip()
        bad = any(k is None or v is None for k, v in entries)
        return self.done(node, None if bad else mapping(entries), column)

    def simple_key(self, entry: int) -> tuple[int, Value | None]:
        if self.t[self.at] == "*":
            return self.alias(entry, 0)
        anchor, tag, start = self.properties()
        c = self.t[self.at]
        if c in "[{":
            return self.flow_collection(entry, start, anchor, tag, 0)
        if c in "\"'":
            text = self.quoted()
            return self.finish(self.make("Scalar", entry, start, anchor, tag), text, tag)
        m = re.compile(r"[^\n]*?(?=[ \t]*:(?:[ \t\r\n]|\Z))").match(self.t, self.at)
        self.mark("PlainScalar", self.at, m.end())
        self.at = m.end()
        return self.finish(self.make("Scalar", entry, start, anchor, tag), m[0], tag, plain=True)

    def flow_collection(self, parent, start, anchor, tag, ordinal) -> tuple[int, Value | None]:
        opener = self.t[self.at]
        closer = "]" if opener == "[" else "}"
        self.mark(FLOW[opener], self.at, self.at + 1)
        self.at += 1
        node = self.make("Sequence" if opener == "[" else "Mapping", parent, start, anchor, tag, ordinal)
        found: list = []
        while True:
            self.skip()
            if self.at >= self.n:
                self.fail()
            if self.t[self.at] == closer:
                break
            holder = self.tree.add("YamlSequenceElement" if opener == "[" else "YamlMappingEntry", None, node, self.at, self.at, len(found))
            if opener == "{" and self.t[self.at] == "?" and self.t[self.at + 1 : self.at + 2] in (" ", "\t", "\n", "\r"):
                self.mark("ExplicitKey", self.at, self.at + 1)
                self.at += 1
                self.skip()
            first, value = self.node(-1, holder, 0, flow=True)
            self.skip()
            if opener == "{":
                second, other = None, NULL
                if self.t[self.at : self.at + 1] == ":":
                    self.mark("MappingValue", self.at, self.at + 1)
                    self.at += 1
                    second, other = self.node(-1, holder, 1, flow=True)
                else:
                    second, other = self.finish(self.make("Scalar", holder, self.at, None, None, 1), "", None, plain=True)
                self.tree[holder].update(key_id=first, value_id=second, name=self.tree[first].get("text"))
                found.append((value, other))
            else:
                if self.t[self.at : self.at + 1] == ":":
                    self.fail("yaml.flow.single-pair@1")
                self.tree[holder]["value_id"] = first
                found.append(value)
            self.tree[holder]["end_byte"] = self.at
            self.skip()
            if self.t[self.at : self.at + 1] == ",":
                self.mark("FlowEntry", self.at, self.at + 1)
                self.at += 1
            elif self.t[self.at : self.at + 1] != closer:
                self.fail()
        self.mark(FLOW[closer], self.at, self.at + 1)
        self.at += 1
        if opener == "[":
            return self.done(node, None if None in found else sequence(found), None)
        return self.done(node, None if any(k is None or v is None for k, v in found) else mapping(found), None)

    # Scalars
    def quoted(self) -> str:
        q = self.t[self.at]
        m = re.compile(r'"((?:[^"\\]|\\.)*)"' if q == '"' else r"'((?:[^']|'')*)'", re.S).match(self.t, self.at) or self.fail()
        self.mark("DoubleQuotedScalar" if q == '"' else "SingleQuotedScalar", self.at, m.end())
        self.at = m.end()
        body = m[1]
        fold = lambda x: re.sub(r"[ \t]*\r?\n[ \t]*((?:\r?\n[ \t]*)*)", lambda k: "\n" * k[1].count("\n") or " ", x)
        if q == "'":
            return fold(body).replace("''", "'")

        def one(k) -> str:
            if k[1]:
                return chr(int(k[1][1:], 16))
            return ESCAPES[k[2]] if k[2] in ESCAPES else self.fail("yaml.scalar.escape@1")

        body = re.sub(r"(?<!\\)((?:\\\\)*)\\\r?\n[ \t]*", r"\1", body)
        return re.sub(r"\\(?:(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})|(.))", one, fold(body), flags=re.S)

    def plain(self, indent: int, flow: bool) -> str:
        stop = r"(?=[ \t]*(?:[,\[\]{}]|:(?:[\s,\[\]{}]|\Z)|[ \t]\#|\r?\n|\Z))" if flow else r"(?=[ \t]*(?::(?:\s|\Z)|[ \t]\#|\r?\n|\Z))"
        m = re.compile(r"[^\n]*?" + stop).match(self.t, self.at)
        if not m[0] or m[0][0] in "@`%":
            self.fail()
        parts, start = [m[0]], self.at
        self.at = end = m.end()
        while True:
            gap = re.compile(r"[ \t]*(?:\r?\n[ \t]*)+").match(self.t, self.at)
            if not gap:
                break
            self.at = gap.end()
            if self.edge() or self.t[self.at] == "#" or (not flow and (self.column() <= indent or self.is_key(False))) or (flow and self.t[self.at] in ",[]{}:"):
                break
            m = re.compile(r"[^\n]*?" + stop).match(self.t, self.at)
            if not m[0]:
                break
            breaks = gap[0].count("\n")
            parts.append("\n" * (breaks - 1) or " ")
            parts.append(m[0])
            self.at = end = m.end()
        self.at = end
        self.mark("PlainScalar", start, end)
        return "".join(parts)

    def block_scalar(self, indent: int) -> str:
        m = re.compile(r"([|>])([-+0-9]{0,2})[ \t]*(?:#[^\n]*)?(?:\r?\n|\Z)").match(self.t, self.at) or self.fail()
        self.mark("LiteralBlockHeader" if m[1] == "|" else "FoldedBlockHeader", self.at, self.at + 1 + len(m[2]))
        self.at = start = m.end()
        given = re.search("[0-9]", m[2])
        least = max(indent, 0) + int(given[0]) if given else None
        lines: list[str] = []
        while self.at < self.n:
            end = self.t.find("\n", self.at)
            end = self.n if end < 0 else end
            line = self.t[self.at : end].rstrip("\r")
            lead = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                if least is None:
                    least = lead
                if lead < least or lead <= indent or (self.column() == 0 and self.edge()):
                    break
                lines.append(line[least:])
            else:
                lines.append(line[least:] if least is not None and len(line) > least else "")
            self.at = min(end + 1, self.n)
        self.mark("BlockScalarContent", start, self.at)
        while lines and not lines[-1] and "+" not in m[2]:
            lines.pop()
        if m[1] == ">":
            out = ""
            for k, line in enumerate(lines):
                if k == 0:
                    out = line
                elif not line:
                    out += "\n"
                elif lines[k - 1] and line[0] not in " \t" and lines[k - 1][0] not in " \t":
                    out += " " + line
                elif lines[k - 1] or line[0] in " \t":
                    out += "\n" + line
                else:
                    out += line
            text = out
        else:
            text = "\n".join(lines)
        return text + ("\n" if lines and "-" not in m[2] else "")


def parse(text: str, profile: str = "yaml.1.2-core@1") -> Tree:
    parser = Parser(text, profile)
    parser.values = {}
    return parser.parse()


def graph(tree: Tree) -> Tree:
    """The rooted graph of a parsed stream: GraphNode, GraphSequenceElement and GraphMappingEntry rows; sharing is kept."""
    out, ids = Tree(tree.text), {}
    for k, r in enumerate(tree.rows, 1):
        if r["role"] == "YamlNode":
            ids[k] = out.add("GraphNode", r["kind"], None, r["start_byte"], r["end_byte"], tag=r["tag"], text=r.get("text"))
    for k, r in enumerate(tree.rows, 1):
        if r["role"] in ("YamlSequenceElement", "YamlMappingEntry"):
            role = "GraphSequenceElement" if r["role"] == "YamlSequenceElement" else "GraphMappingEntry"
            out.add(role, None, ids[r["parent_id"]], r["start_byte"], r["end_byte"], r["ordinal"], key_id=ids.get(r.get("key_id")), value_id=ids[r["value_id"]])
        elif r["role"] == "YamlDocument":
            out[ids[r["value_id"]]].update(state="root", dup_group=r["ordinal"])
    out.value = tree.value
    return out
