"""Paths into portable values: ordered steps from the root, with a total order, and the value a path leads to."""

from __future__ import annotations

from dataclasses import dataclass

from docloom.functions.values import Value

# The kinds of steps.
STEPS = ("ObjectValue", "SequenceElement", "EntryKey", "EntryValue")


@dataclass(frozen=True)
class Path:
    """steps: (kind, key or index). Shorter paths precede their extensions; kinds, then keys or indexes decide."""

    steps: tuple[tuple[str, str | int], ...] = ()

    def child(self, kind: str, at: str | int) -> Path:
        if kind not in STEPS or isinstance(at, str) != (kind == "ObjectValue") or not isinstance(at, str) and at < 0:
            raise ValueError(f"no step: {kind} {at!r}")
        return Path((*self.steps, (kind, at)))

    def __lt__(self, other: Path) -> bool:
        for mine, its in zip(self.steps, other.steps):
            if mine != its:
                return mine < its if mine[0] != its[0] else mine[1] < its[1]
        return len(self.steps) < len(other.steps)

    def of(self, value: Value) -> Value | None:
        """The value at the end of the path, or None where it leads nowhere; of equal keys the first counts."""
        for kind, at in self.steps:
            if kind == "ObjectValue" and value.kind == "Object":
                found = [x for k, x in value.data if k == at][:1]
            elif kind == "SequenceElement" and value.kind == "Sequence":
                found = list(value.data[at : at + 1])
            elif kind in ("EntryKey", "EntryValue") and value.kind == "EntryMapping":
                found = [pair[kind == "EntryValue"] for pair in value.data[at : at + 1]]
            else:
                found = []
            if not found:
                return None
            value = found[0]
        return value


def paths(value: Value, start: Path = Path()) -> list[tuple[Path, Value]]:
    """All paths of a value with what they lead to, parents first."""
    out = [(start, value)]
    if value.kind == "Object":
        for k, x in value.data:
            out += paths(x, start.child("ObjectValue", k))
    elif value.kind == "Sequence":
        for k, x in enumerate(value.data):
            out += paths(x, start.child("SequenceElement", k))
    elif value.kind == "EntryMapping":
        for k, (key, x) in enumerate(value.data):
            out += paths(key, start.child("EntryKey", k)) + paths(x, start.child("EntryValue", k))
    return out
