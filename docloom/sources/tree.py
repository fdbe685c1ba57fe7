"""What a parser makes of one document: rows of a node table, syntax pieces, diagnostics, a portable value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import ClassVar

#: Columns of the node table after doc_id. Every entity of a document is a row; associations (members, entries, elements)
#: are rows of their own that point to what they hold.
COLUMNS = (
    ("node_id", "int"), ("role", "string"), ("kind", "string"), ("parent_id", "int"), ("ordinal", "int"), ("name", "string"), ("cmp_name", "string"),
    ("key_id", "int"), ("value_id", "int"), ("target_id", "int"), ("tag", "string"), ("text", "string"), ("state", "string"), ("dup_group", "int"),
    ("start_byte", "int"), ("end_byte", "int"), ("pre", "int"), ("last_desc", "int"), ("raw", "binary"),
)
NAMES = tuple(n for n, _ in COLUMNS)
SCHEMA = "doc_id long, " + ", ".join(f"{n} {t}" for n, t in COLUMNS)


class Failure(Exception):
    """A document that cannot be formed at all: a code and where."""

    def __init__(self, code: str, at: int = 0):
        super().__init__(f"{code} at {at}")
        self.code, self.at = code, at


@dataclass
class Tree:
    """Offsets are in characters here; rows() turns them into bytes of the source."""

    text: str
    rows: list[dict] = field(default_factory=list)
    pieces: list[tuple[str, str, int, int]] = field(default_factory=list)
    diagnostics: list[tuple[str, int, int]] = field(default_factory=list)
    encoding: str = "utf-8"
    scalars: dict[int, object] = field(default_factory=dict)  # values of nodes that hold one

    #: Whether pieces are kept; scans that do not ask for them turn it off while they parse.
    keep: ClassVar[bool] = True
    _value: object = None
    _later: Callable[[], object] | None = None

    @property
    def value(self) -> object:
        """The portable value, or None; made when first asked for where the parser deferred it."""
        if self._later is not None:
            self._value, self._later = self._later(), None
        return self._value

    @value.setter
    def value(self, value: object) -> None:
        self._value, self._later = value, None

    def defer(self, make: Callable[[], object]) -> None:
        self._later = make

    def add(self, role: str, kind: str | None = None, parent: int | None = None, start: int = 0, end: int = 0, ordinal: int = 0, **more) -> int:
        self.rows.append({"role": role, "kind": kind, "parent_id": parent, "start_byte": start, "end_byte": end, "ordinal": ordinal, **more})
        return len(self.rows)

    def __getitem__(self, node: int) -> dict:
        return self.rows[node - 1]

    def piece(self, kind: str, start: int, end: int, form: str = "Token") -> None:
        if end > start and self.keep:
            self.pieces.append((form, kind, start, end))

    def note(self, code: str, start: int = 0, end: int = 0) -> None:
        self.diagnostics.append((code, start, end))

    def group(self, nodes: list[int], key) -> None:
        """Number the groups of nodes that share a key with another."""
        found: dict = {}
        for n in nodes:
            found.setdefault(key(self[n]), []).append(n)
        for same in found.values():
            if len(same) > 1:
                for n in same:
                    self[n]["dup_group"] = same[0]

    def order(self, roots: list[int], children) -> None:
        """Pre-order numbers and the last number below each node."""
        count = 0
        stack = [(r, False) for r in reversed(roots)]
        while stack:
            node, done = stack.pop()
            if done:
                self[node]["last_desc"] = count - 1
                continue
            self[node]["pre"] = count
            count += 1
            stack.append((node, True))
            stack += [(c, False) for c in reversed(children(node))]

    def table(self, pieces: bool) -> list[tuple]:
        """Node rows: the document (0), its entities, diagnostics, and pieces if asked for."""
        at = bytes_of(self.text, self.encoding)
        status = "Recovered" if self.diagnostics and any(not c.endswith("duplicate-member@1") for c, _, _ in self.diagnostics) else "Complete"
        out = [{"role": "Document", "kind": status, "end_byte": at(len(self.text))}]
        out += [r | {"start_byte": at(r["start_byte"]), "end_byte": at(r["end_byte"])} for r in self.rows]
        out += [{"role": "Diagnostic", "name": c, "ordinal": k, "start_byte": at(s), "end_byte": at(e)} for k, (c, s, e) in enumerate(self.diagnostics)]
        if pieces:
            out += [{"role": "Piece", "tag": f, "kind": k, "ordinal": n, "text": self.text[s:e], "start_byte": at(s), "end_byte": at(e)} for n, (f, k, s, e) in enumerate(self.pieces)]
        return [(n, *[r.get(c) for c in NAMES[1:]]) for n, r in enumerate(out)]


def bytes_of(text: str, encoding: str = "utf-8"):
    """From a character offset in the text to the byte offset in the source it was decoded from."""
    if encoding in ("utf-16le", "utf-16be"):
        ends = [0]
        for c in text:
            ends.append(ends[-1] + (4 if c > "\uffff" else 2))
        return ends.__getitem__
    if encoding != "utf-8":
        sizes = [0]
        for c in text:
            sizes.append(sizes[-1] + (1 if encoding != "windows-932" else len(c.encode("cp932", "replace"))))
        return sizes.__getitem__
    if text.isascii():
        return lambda k: k
    ends, total = [0], 0
    for c in text:
        total += 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
        ends.append(total)
    return ends.__getitem__


def failed(code: str) -> list[tuple]:
    return [tuple({"node_id": 0, "role": "Document", "kind": "Failed", "text": code}.get(c) for c in NAMES)]
