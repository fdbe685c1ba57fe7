"""Java Properties: natural and logical lines, escapes, keys as exact UTF-16 units."""

from __future__ import annotations

import re

from docloom.functions.values import Value, string
from docloom.sources.ini_doc import _lines
from docloom.sources.tree import Tree

BLANK = " \t\f"
SIMPLE = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


def parse(text: str, profile: str = "java-properties.reader@1") -> Tree:
    tree = Tree(text)
    root = tree.add("PropertiesDocument", None, None, 0, len(text))
    lines, n, found = _lines(text), 0, []
    naturals = [tree.add("PropertiesNaturalLine", None, root, s, b, k, text=text[s:e]) for k, (s, e, b) in enumerate(lines)]
    count = 0
    while n < len(lines):
        s, e, b = lines[n]
        at = s
        while at < e and text[at] in BLANK:
            at += 1
        tree.piece("Whitespace", s, at, "Trivia")
        logical = tree.add("PropertiesLogicalLine", None, root, s, b, count)
        count += 1
        tree[naturals[n]]["target_id"] = logical
        tree[naturals[n]]["cmp_name"] = "0"
        if at == e or text[at] in "#!":
            if at < e:
                tree.piece("CommentMarker", at, at + 1, "Trivia")
                tree.piece("CommentText", at + 1, e, "Trivia")
            tree.piece("LineBreak", e, b, "Trivia")
            n += 1
            continue
        chars: list[tuple[str, int]] = []  # the logical line with the places of its characters
        part = 0
        while True:
            s2, e2, b2 = lines[n]
            stop = e2
            slashes = e2 - at - len(text[at:e2].rstrip("\\"))
            go_on = slashes % 2 == 1 and (n + 1 < len(lines) or b2 == e2)
            if go_on:
                stop = e2 - 1
            chars += [(text[k], k) for k in range(at, stop)]
            tree[logical]["end_byte"] = b2
            n += 1
            if not go_on:
                break
            if n >= len(lines):
                break
            part += 1
            tree[naturals[n]]["target_id"], tree[naturals[n]]["cmp_name"] = logical, str(part)
            at, e3 = lines[n][0], lines[n][1]
            while at < e3 and text[at] in BLANK:
                at += 1
        k, size = 0, len(chars)
        while k < size and chars[k][0] not in "=:" + BLANK:
            k += 2 if chars[k][0] == "\\" else 1
        k = min(k, size)
        sep = k
        while sep < size and chars[sep][0] in BLANK:
            sep += 1
        explicit = sep < size and chars[sep][0] in "=:"
        if explicit:
            sep += 1
            while sep < size and chars[sep][0] in BLANK:
                sep += 1
        first, last = (chars[0][1], chars[-1][1] + 1) if chars else (at, at)
        node = tree.add("PropertiesProperty", None, root, first, last, len(found))
        key, bad1 = _decode(tree, node, chars[:k], 0)
        value, bad2 = _decode(tree, node, chars[sep:], sum(r["role"] == "PropertiesEscape" and r["parent_id"] == node for r in tree.rows))
        if bad1 or bad2:
            tree.note("properties.escape.malformed-unicode@1", first, last)
        state = "Present" if value else "ExplicitEmpty" if explicit else "ImplicitEmpty"
        show = lambda x: x.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")
        tree[node].update(name=show(key), cmp_name=key.encode("utf-16-be", "surrogatepass").hex(), raw=key.encode("utf-16-be", "surrogatepass"), text=show(value), state=state)
        found.append(node)
        edge = lambda i: chars[i][1] if i < size else last
        tree.piece("Key", first, edge(k))
        tree.piece("Separator", edge(k), edge(sep))
        tree.piece("Value", edge(sep), last)
        s2, e2, b2 = lines[n - 1]
        tree.piece("ContinuationMarker", last, e2)
        tree.piece("LineBreak", e2, b2, "Trivia")
    tree.group(found, lambda r: r["cmp_name"])
    tree.value = Value("EntryMapping", tuple((string(tree[x]["name"]), string(tree[x]["text"])) for x in found))
    return tree


def _decode(tree: Tree, node: int, chars: list[tuple[str, int]], ordinal: int) -> tuple[str, bool]:
    out, k, bad = [], 0, False
    while k < len(chars):
        c, at = chars[k]
        if c != "\\" or k + 1 == len(chars):
            out.append(c if c != "\\" else "")
            k += 1
            continue
        e, size = chars[k + 1][0], 2
        if e == "u":
            four = "".join(x for x, _ in chars[k + 2 : k + 6])
            if re.fullmatch("[0-9a-fA-F]{4}", four):
                out.append(chr(int(four, 16)))
                size = 6
            else:
                bad = True
        else:
            out.append(SIMPLE.get(e, e))
        tree.add("PropertiesEscape", "Unicode" if e == "u" else "Simple", node, at, chars[min(k + size, len(chars)) - 1][1] + 1, ordinal, text=out[-1] if out else None)
        ordinal += 1
        k += size
    return "".join(out), bad
