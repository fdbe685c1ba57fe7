"""XML 1.0 without external entities: elements, attributes, namespaces, mixed content, internal general entities."""

from __future__ import annotations

import re

from docloom.functions.values import Value, sequence, string
from docloom.sources.tree import Failure, Tree

NAME = r"[:A-Za-z_\u00c0-\U000effff][-.:\w\u00b7\u00c0-\U000effff]*"
PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}
REFERENCE = re.compile(rf"&(?:#x([0-9a-fA-F]+)|#([0-9]+)|({NAME}));")
START = re.compile(rf"<({NAME})((?:\s+{NAME}\s*=\s*(?:\"[^<\"]*\"|'[^<']*'))*)\s*(/?)>")
ATTRIBUTE = re.compile(rf"(\s+)({NAME})(\s*)=(\s*)(\"[^<\"]*\"|'[^<']*')")
XMLNS = {"xml": "http://www.w3.org/XML/1998/namespace", "xmlns": "http://www.w3.org/2000/xmlns/"}
BUDGET = 1 << 20


END = re.compile(rf"</({NAME})(\s*)>")


class Parser:
    def __init__(self, text: str):
        self.t, self.tree, self.at = text, Tree(text), 0
        self.entities: dict[str, str] = {}
        self.spent = 0

    def expand(self, text: str, at: int, seen: tuple[str, ...] = ()) -> str:
        def one(m) -> str:
            if m[1] or m[2]:
                return chr(int(m[1], 16) if m[1] else int(m[2]))
            if m[3] in PREDEFINED:
                return PREDEFINED[m[3]]
            if m[3] in seen or m[3] not in self.entities:
                self.tree.note("xml.entity.cycle@1" if m[3] in seen else "xml.entity.unknown@1", at, at + len(m[0]))
                return m[0]
            self.spent += len(self.entities[m[3]])
            if self.spent > BUDGET:
                raise Failure("xml.entity.expansion-limit@1", at)
            return self.expand(self.entities[m[3]], at, (*seen, m[3]))

        return REFERENCE.sub(one, text)

    def pieces(self, *parts: tuple[str, int]) -> None:
        """Pieces one after another from here: kind and length."""
        if not Tree.keep:
            self.at += sum(size for _, size in parts)
            return
        for kind, size in parts:
            self.tree.piece(kind, self.at, self.at + size, "Trivia" if kind in ("whitespace", "line-break", "bom") or kind.startswith("comment") else "Token")
            self.at += size

    def blank(self, text: str) -> None:
        for m in re.finditer(r"\r\n|\n|\r|[^\r\n]+", text):
            self.pieces(("line-break" if m[0][0] in "\r\n" else "whitespace", len(m[0])))

    def special(self, parent: int, ordinal: int) -> bool:
        """A comment, CDATA section or processing instruction."""
        tree, s = self.tree, self.at
        for open_, close, role, kinds in (("<!--", "-->", "XmlComment", "comment"), ("<![CDATA[", "]]>", "XmlCdata", "cdata"), ("<?", "?>", "XmlProcessingInstruction", "processing-instruction")):
            if self.t.startswith(open_, s):
                end = self.t.find(close, s + len(open_))
                if end < 0:
                    raise Failure("xml.parse.unterminated@1", s)
                body = self.t[s + len(open_) : end]
                if kinds == "processing-instruction":
                    target = re.match(NAME, body)
                    name = target[0] if target else ""
                    rest = body[len(name) :]
                    gap = len(rest) - len(rest.lstrip())
                    tree.add(role, "processing-instruction", parent, s, end + 2, ordinal, name=name, text=rest[gap:])
                    self.pieces((f"{kinds}-open", 2), (f"{kinds}-target", len(name)), ("whitespace", gap), (f"{kinds}-content", len(rest) - gap), (f"{kinds}-close", 2))
                else:
                    tree.add(role, kinds, parent, s, end + len(close), ordinal, text=re.sub("\r\n?", "\n", body))
                    self.pieces((f"{kinds}-open", len(open_)), (f"{kinds}-text", len(body)), (f"{kinds}-close", 3))
                return True
        return False

    def doctype(self, document: int) -> None:
        m = re.compile(rf"<!DOCTYPE\s+({NAME})\s*(SYSTEM\s+(?:\"[^\"]*\"|'[^']*')|PUBLIC\s+(?:\"[^\"]*\"|'[^']*')\s+(?:\"[^\"]*\"|'[^']*'))?\s*(?:\[(.*?)\]\s*)?>", re.S).match(self.t, self.at)
        if not m:
            raise Failure("xml.parse.doctype@1", self.at)
        self.tree.add("XmlDoctype", "doctype", document, m.start(), m.end(), 0, name=m[1])
        if m[2]:
            self.tree.note("xml.dtd.external-subset@1", m.start(2), m.end(2))
        for e in re.finditer(rf"<!ENTITY\s+(%\s+)?({NAME})\s+(?:(SYSTEM|PUBLIC)|(\"[^\"]*\"|'[^']*'))", m[3] or ""):
            if e[1] or e[3]:
                self.tree.note("xml.entity.parameter@1" if e[1] else "xml.entity.external@1", m.start(), m.end())
            else:
                self.entities.setdefault(e[2], e[4][1:-1])
        name = self.t.index(m[1], self.at + 9)
        self.pieces(("doctype-open", 9), ("whitespace", name - self.at - 9), ("doctype-name", len(m[1])), ("dtd-markup", m.end() - 1 - name - len(m[1])), ("doctype-close", 1))

    def parse(self) -> Tree:
        tree, t = self.tree, self.t
        document = tree.add("XmlDocument", None, None, 0, len(t))
        if t.startswith("\ufeff"):
            self.pieces(("bom", 1))
        if m := re.compile(r"<\?xml(\s[^?]*)\?>").match(t, self.at):
            facts = dict(re.findall(r"(version|encoding|standalone)\s*=\s*[\"']([^\"']*)", m[1]))
            tree.add("XmlDeclaration", "declaration", document, m.start(), m.end(), 0, name=facts.get("version"), text=facts.get("encoding"))
            self.pieces(("declaration-open", 5), ("declaration-value", len(m[1])), ("declaration-close", 2))
        stack: list[tuple[int, str, dict[str, str], int]] = []
        roots, prolog, epilog = 0, 0, 0
        counts: dict[int, int] = {}
        while self.at < len(t):
            s = self.at
            top = stack[-1][0] if stack else None
            if t[s] != "<":
                end = t.find("<", s)
                end = len(t) if end < 0 else end
                if top is None:
                    if t[s:end].strip():
                        tree.note("xml.document.text-outside-root@1", s, end)
                        self.pieces(("error-region", end - s))
                    else:
                        self.blank(t[s:end])
                    continue
                self.content(top, counts, s, end)
                continue
            if top is None and t.startswith("<!DOCTYPE", s):
                self.doctype(document)
                continue
            where = top if top is not None else document
            if self.special(where, counts.get(where, 0)):
                if top is None:
                    tree.rows[-1].update(state="epilog" if roots else "prolog", ordinal=epilog if roots else prolog)
                    prolog, epilog = prolog + (not roots), epilog + bool(roots)
                else:
                    counts[where] = counts.get(where, 0) + 1
                continue
            if m := END.match(t, s):
                self.pieces(("end-tag-open", 2), ("local-name", len(m[1])), ("whitespace", len(m[2])), ("tag-close", 1))
                if not stack or stack[-1][1] != m[1] and m[1] not in [x[1] for x in stack]:
                    tree.note("xml.element.extra-end-tag@1", s, m.end())
                else:
                    if stack[-1][1] != m[1]:
                        tree.note("xml.element.mismatched-end-tag@1", s, m.end())
                    while True:
                        node, name, *_ = stack.pop()
                        tree[node]["end_byte"] = m.end()
                        if name == m[1]:
                            break
                continue
            m = START.match(t, s)
            if not m:
                tree.note("xml.parse.markup@1", s, s + 1)
                self.pieces(("error-region", 1))
                continue
            if top is None:
                roots += 1
                if roots > 1:
                    tree.note("xml.document.multiple-roots@1", s, m.end())
            self.element(m, document if top is None else top, counts, stack)
        for node, *_ in stack:
            tree.note("xml.element.unclosed@1", tree[node]["start_byte"], len(t))
            tree[node]["end_byte"] = len(t)
        if not roots:
            tree.note("xml.document.missing-root@1")
        kids: dict[int, list[int]] = {}
        for k, r in enumerate(tree.rows, 1):
            if r["role"] == "XmlElement":
                kids.setdefault(r["parent_id"], []).append(k)
        tree.order(kids.get(document, []), lambda n: kids.get(n, []))
        if roots == 1 and not tree.diagnostics:
            tree.defer(lambda: record(tree, kids[document][0]))
        return tree

    def content(self, parent: int, counts: dict, s: int, end: int) -> None:
        raw, tree = self.t[s:end], self.tree
        node = tree.add("XmlText", "text", parent, s, end, counts.get(parent, 0), text=self.expand(re.sub("\r\n?", "\n", raw), s) if "&" in raw or "\r" in raw else raw)
        counts[parent] = counts.get(parent, 0) + 1
        if "&" not in raw:
            return self.pieces(("text", len(raw)))
        at, n = 0, 0
        for m in REFERENCE.finditer(raw):
            self.pieces(("text", m.start() - at), ("character-reference" if not m[3] else "entity-reference", len(m[0])))
            kind = "Character" if not m[3] else "Predefined" if m[3] in PREDEFINED else "General"
            code = int(m[1], 16) if m[1] else int(m[2]) if m[2] else 0
            tree.add("XmlReference", kind, node, s + m.start(), s + m.end(), n, name=m[3] or f"&#x{code:X};", text=m[0], target_id=parent)
            at, n = m.end(), n + 1
        self.pieces(("text", len(raw) - at))

    def element(self, m, parent: int, counts: dict, stack: list) -> None:
        tree, s = self.tree, m.start()
        scope = dict(stack[-1][2]) if stack else dict(XMLNS)
        found = [(a[2], self.expand(re.sub(r"[\t\n\r]", " ", a[5][1:-1]), s), s + 1 + len(m[1]) + a.start(2), s + 1 + len(m[1]) + a.end()) for a in ATTRIBUTE.finditer(m[2])]
        for name, value, _, _ in found:
            if name == "xmlns" or name.startswith("xmlns:"):
                scope[name[6:]] = value
        prefix, local = m[1].split(":", 1) if ":" in m[1] else ("", m[1])
        uri = scope.get(prefix, "" if not prefix else None)
        if uri is None:
            tree.note("xml.namespace.undeclared-prefix@1", s, m.end())
        node = tree.add("XmlElement", "element", parent, s, m.end(), counts.get(parent, 0), name=local, tag=prefix, cmp_name=uri)
        counts[parent] = counts.get(parent, 0) + 1
        self.pieces(("tag-open", 1), *([("prefix", len(prefix)), ("colon", 1)] if prefix else []), ("local-name", len(local)))
        for a in ATTRIBUTE.finditer(m[2]):
            self.pieces(("whitespace", len(a[1])), ("namespace-declaration" if a[2].startswith("xmlns") else "attribute-name", len(a[2])), ("whitespace", len(a[3])), ("equals", 1), ("whitespace", len(a[4])), ("quote", 1), ("attribute-value", len(a[5]) - 2), ("quote", 1))
        self.pieces(("whitespace", m.end() - self.at - 1 - len(m[3])), ("empty-element-close" if m[3] else "tag-close", 1 + len(m[3])))
        seen: set = set()
        n = k = 0
        for name, value, a, b in found:
            if name == "xmlns" or name.startswith("xmlns:"):
                tree.add("XmlNamespaceBinding", "namespace-binding", node, a, b, k, name=name[6:], text=value)
                k += 1
                continue
            p, q = name.split(":", 1) if ":" in name else ("", name)
            own = scope.get(p) if p else ""
            if own is None:
                tree.note("xml.namespace.undeclared-prefix@1", a, b)
            if name in seen:
                tree.note("xml.attribute.duplicate@1", a, b)
            seen.add(name)
            tree.add("XmlAttribute", "attribute", node, a, b, n, name=q, tag=p, cmp_name=own, text=value)
            n += 1
        if not m[3]:
            stack.append((node, m[1], scope, n))


def record(tree: Tree, root: int) -> Value:
    """The element tree as a portable record."""
    own: dict[int, list[int]] = {}
    for k, r in enumerate(tree.rows, 1):
        own.setdefault(r["parent_id"], []).append(k)

    def one(node: int) -> Value:
        r, attributes, children = tree[node], [], []
        for k in own.get(node, []):
            c = tree[k]
            if c["role"] == "XmlAttribute":
                attributes.append(Value("Object", (("prefix", string(c["tag"])), ("local", string(c["name"])), ("namespace", string(c["cmp_name"] or "")), ("value", string(c["text"])))))
            elif c["role"] == "XmlElement":
                children.append(one(k))
            elif c["role"] in ("XmlText", "XmlCdata", "XmlComment"):
                children.append(Value("Object", (("kind", string(c["kind"])), ("text", string(c["text"])))))
        return Value("Object", (("kind", string("element")), ("prefix", string(r["tag"])), ("local", string(r["name"])), ("namespace", string(r["cmp_name"] or "")), ("attributes", sequence(attributes)), ("children", sequence(children))))

    return Value("Object", (("record", string("xml.element-tree@1")), ("root", one(root))))


def parse(text: str, profile: str = "xml.1.0-safe@1") -> Tree:
    return Parser(text).parse()
