"""INI in three dialects: portable, Windows, and that of Python's configparser."""

from __future__ import annotations

import re

from docloom.functions.values import Value, string
from docloom.sources.tree import Failure, Tree

BREAK = re.compile(r"\r\n|\n|\r")


def _lines(text: str) -> list[tuple[int, int, int]]:
    """start, end without the break, end with it"""
    out, at = [], 0
    for m in BREAK.finditer(text):
        out.append((at, m.start(), m.end()))
        at = m.end()
    return out + ([(at, len(text), len(text))] if at < len(text) else [])


def parse(text: str, profile: str = "ini.portable@1") -> Tree:
    tree = Tree(text)
    windows, python = "windows" in profile, "configparser" in profile
    fold = str.lower if windows or python else str
    root = tree.add("IniDocument", None, None, 0, len(text))
    at = 0
    if text.startswith("\ufeff"):
        tree.piece("Bom", 0, 1, "Trivia")
        at = 1
    if not windows and not python and not text.isascii():
        raise Failure("ini.parse.non-ascii@1")
    lines = [(max(s, at), e, b) for s, e, b in _lines(text)]
    section = last = None
    indent = 0
    sections: list[int] = []
    entries: list[int] = []
    logical, count = None, 0
    for n, (s, e, b) in enumerate(lines):
        line = text[s:e]
        physical = tree.add("IniPhysicalLine", None, root, s, b, n, text=line)
        lead = len(line) - len(line.lstrip(" \t"))
        body = line.strip(" \t")
        more = python and last is not None and body and lead > indent and not body.startswith((";", "#"))
        if not more:
            logical = tree.add("IniLogicalLine", None, root, s, b, count)
            count += 1
        else:
            tree[logical]["end_byte"] = b
        tree[physical]["target_id"] = logical
        if lead:
            tree.piece("Whitespace", s, s + lead, "Trivia")
        if not body:
            pass
        elif more:
            tree.piece("ContinuationMarker", s + lead, s + lead)
            tree.piece("EntryValue", s + lead, s + lead + len(body))
            tree[last]["text"] = (tree[last]["text"] or "") + "\n" + body
            tree[last]["state"], tree[last]["end_byte"] = "Present", e
        elif body[0] == ";" or (python and body[0] == "#"):
            tree.piece("CommentMarker", s + lead, s + lead + 1, "Trivia")
            tree.piece("CommentText", s + lead + 1, e, "Trivia")
        elif body[0] == "[":
            close = body.rfind("]") if not windows else body.find("]")
            if close < 0 or (not windows and not python and (body[close + 1 :] or lead)):
                tree.note("ini.section.syntax@1", s, e)
                tree.piece("ErrorRegion", s + lead, e, "ErrorRegion")
            else:
                name = body[1:close]
                inner = name.strip(" \t") if windows else name
                o = s + lead
                tree.piece("SectionOpen", o, o + 1)
                tree.piece("SectionName", o + 1, o + close)
                tree.piece("SectionClose", o + close, o + close + 1)
                section = tree.add("IniSection", "Default" if python and name == "DEFAULT" else None, root, o, e, len(sections), name=inner, cmp_name=inner.lower() if windows else inner, tag="lower" if windows else "exact")
                sections.append(section)
                last, indent = None, lead
        else:
            m = re.search("[=:]" if python else "=", body)
            if not m and not python:
                tree.note("ini.entry.delimiter@1", s, e)
                tree.piece("ErrorRegion", s + lead, e, "ErrorRegion")
            elif section is None:
                tree.note("ini.entry.without-section@1", s, e)
                tree.piece("ErrorRegion", s + lead, e, "ErrorRegion")
            else:
                trim = (lambda x: x.strip(" \t")) if windows or python else str
                source = body if windows or python else line
                m = re.search("[=:]" if python else "=", source)
                key = trim(source[: m.start()] if m else source)
                value = trim(source[m.end() :]) if m else None
                o = s + (lead if windows or python else 0)
                cut = o + (m.start() if m else len(source))
                tree.piece("EntryKey", o, cut)
                if m:
                    tree.piece("Delimiter", cut, cut + 1)
                    tree.piece("EntryValue", cut + 1, e)
                quoted = windows and value is not None and len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'"
                value = value[1:-1] if quoted else value
                state = "Missing" if value is None else "Present" if value or quoted else "Empty"
                last = tree.add("IniEntry", "Quoted" if quoted else None, section, s, e, len(entries), name=key, cmp_name=fold(key), text=value, state=state, target_id=section, tag="exact" if fold is str else "lower")
                entries.append(last)
                indent = lead
        if b > e:
            tree.piece("LineBreak", e, b, "Trivia")
    tree.group(sections, lambda r: r["cmp_name"])
    tree.group(entries, (lambda r: (tree[r["parent_id"]]["cmp_name"], r["cmp_name"])) if windows else (lambda r: (r["parent_id"], r["cmp_name"])))

    def value() -> Value:
        own: dict[int, list[int]] = {k: [] for k in sections}
        for x in entries:
            own[tree[x]["parent_id"]].append(x)
        part = lambda k: Value("EntryMapping", tuple((string(tree[x]["name"]), string(tree[x]["text"] or "")) for x in own[k]))
        return Value("EntryMapping", tuple((string(tree[k]["name"]), part(k)) for k in sections))

    tree.defer(value)
    return tree
