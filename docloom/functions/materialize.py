"""Portable values to canonical documents. Every writer is exact or refuses; what it writes is parsed again and compared."""

from __future__ import annotations

import math
import plistlib
import re
import struct

from docloom.functions.values import Value, scalar_text


class Unrepresentable(ValueError):
    """A value that a target cannot hold exactly."""

    def __init__(self, code: str, what: str = ""):
        super().__init__(f"{code} {what}")
        self.code = code


def _refuse(target: str, v: Value):
    raise Unrepresentable("core.materialization.unrepresentable@1", f"{v.kind} in {target}")


def _entries(v: Value, target: str) -> list[tuple[str, Value]]:
    if v.kind == "Object":
        return list(v.data)
    if v.kind == "EntryMapping" and all(k.kind == "String" for k, _ in v.data):
        return [(k.data, x) for k, x in v.data]
    return _refuse(target, v)


def quoted(text: str) -> str:
    """A JSON string: quotes, backslashes and control characters are escaped."""
    short = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return '"' + "".join(short.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in text) + '"'


def write_json(v: Value, json5: bool = False, indent: int | None = None, depth: int = 0) -> str:
    d = v.data
    if v.kind in ("Null", "Boolean", "Integer"):
        return scalar_text(v) or "null"
    if v.kind == "Decimal":
        return f"{d[0]}e{d[1]}"
    if v.kind == "String":
        return quoted(d)
    if v.kind == "BinaryFloat64" and json5:
        x = struct.unpack(">d", struct.pack(">Q", d))[0]
        if math.isfinite(x):
            return _refuse("json5", v)
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    gap = "" if indent is None else "\n" + " " * indent * (depth + 1)
    end = "" if indent is None else "\n" + " " * indent * depth
    colon = ":" if indent is None else ": "
    if v.kind == "Sequence":
        return "[" + ",".join(gap + write_json(x, json5, indent, depth + 1) for x in d) + (end if d else "") + "]"
    if v.kind in ("Object", "EntryMapping"):
        items = _entries(v, "json")
        return "{" + ",".join(gap + quoted(k) + colon + write_json(x, json5, indent, depth + 1) for k, x in items) + (end if items else "") + "}"
    return _refuse("json", v)


def _toml_key(k: str) -> str:
    return k if re.fullmatch("[A-Za-z0-9_-]+", k) else quoted(k).replace("\x7f", "\\u007f")


def _toml_value(v: Value) -> str:
    if v.kind == "String":
        return quoted(v.data).replace("\x7f", "\\u007f")
    if v.kind == "Boolean" or (v.kind == "Integer" and -(1 << 63) <= v.data < 1 << 63):
        return scalar_text(v)
    if v.kind == "BinaryFloat64":
        x = scalar_text(v)
        return x if x.lstrip("-") in ("inf", "nan") or re.search("[.]", x) or "e" in x else x + ".0"
    if v.kind in ("Date", "Time", "LocalDateTime", "OffsetDateTime"):
        if v.kind == "OffsetDateTime" and v.data[7] % 60:
            return _refuse("toml", v)
        return scalar_text(v)
    if v.kind == "Sequence":
        return "[" + ", ".join(map(_toml_value, v.data)) + "]"
    if v.kind == "Object":
        return "{" + ", ".join(f"{_toml_key(k)} = {_toml_value(x)}" for k, x in v.data) + "}"
    return _refuse("toml", v)


def write_toml(v: Value) -> str:
    """Entries in their order, containers inline, so that the order of items is that of the value."""
    items = _entries(v, "toml")
    if len({k for k, _ in items}) < len(items):
        return _refuse("toml", v)
    return "".join(f"{_toml_key(k)} = {_toml_value(x)}\n" for k, x in items)


def _yaml_scalar(v: Value) -> str:
    if v.kind == "String":
        return quoted(v.data)
    if v.kind == "Decimal":
        return f"{v.data[0]}e{v.data[1]}"
    if v.kind == "BinaryFloat64":
        x = scalar_text(v)
        return {"inf": ".inf", "-inf": "-.inf", "nan": ".nan"}.get(x) or _refuse("yaml", v)
    if v.kind == "Bytes":
        import base64

        return f'!!binary "{base64.b64encode(v.data).decode()}"'
    if v.kind in ("Null", "Boolean", "Integer"):
        return scalar_text(v) or "null"
    return _refuse("yaml", v)


def write_yaml(v: Value, flow: bool = False, depth: int = 0) -> str:
    pad = "  " * depth
    if v.kind == "Sequence":
        if flow or not v.data:
            return "[" + ", ".join(write_yaml(x, True) for x in v.data) + "]"
        return "".join(f"{pad}-" + _yaml_child(x, depth) for x in v.data)
    if v.kind in ("Object", "EntryMapping"):
        items = [(Value("String", k) if isinstance(k, str) else k, x) for k, x in v.data]
        if flow or not items:
            return "{" + ", ".join(f"{write_yaml(k, True)}: {write_yaml(x, True)}" for k, x in items) + "}"
        return "".join((f"{pad}{write_yaml(k, True)}:" if k.kind not in ("Sequence", "Object", "EntryMapping") else f"{pad}? {write_yaml(k, True)}\n{pad}:") + _yaml_child(x, depth) for k, x in items)
    return _yaml_scalar(v)


def _yaml_child(v: Value, depth: int) -> str:
    if v.kind in ("Sequence", "Object", "EntryMapping") and v.data:
        return "\n" + write_yaml(v, False, depth + 1)
    return " " + write_yaml(v, True) + "\n"


def write_ini(v: Value, profile: str = "ini.portable@1") -> str:
    end, python = "\r\n" if "windows" in profile else "\n", "configparser" in profile
    out = []
    for name, part in _entries(v, "ini"):
        if not name or re.search(r"[\[\]\r\n]", name):
            _refuse("ini", v)
        out.append(f"[{name}]{end}")
        for key, x in _entries(part, "ini"):
            text = x.data if x.kind == "String" else _refuse("ini", x)
            if not key or re.search(r"[=:\r\n]|^[;#\[\s]|\s$", key) or re.search(r"[\r\n]", text) or ((python or "windows" in profile) and text != text.strip()):
                _refuse("ini", x)
            out.append(f"{key} = {text}{end}" if python else f"{key}={text}{end}")
    return "".join(out)


def write_properties(v: Value) -> str:
    def escape(text: str, key: bool) -> str:
        out = []
        for k, c in enumerate(text):
            if c in "\t\n\r\f":
                out.append({"\t": "\\t", "\n": "\\n", "\r": "\\r", "\f": "\\f"}[c])
            elif c == "\\" or (key and c in "=:#! ") or (c == " " and k == 0):
                out.append("\\" + c)
            elif " " <= c <= "~":
                out.append(c)
            else:
                units = c.encode("utf-16-be", "surrogatepass")
                out += [f"\\u{units[i] << 8 | units[i + 1]:04X}" for i in range(0, len(units), 2)]
        return "".join(out)

    return "".join(f"{escape(k, True)}={escape(x.data, False) if x.kind == 'String' else _refuse('properties', x)}\n" for k, x in _entries(v, "properties"))


def _xml_text(text: str, attribute: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#xD;")
    return text.replace('"', "&quot;").replace("\t", "&#x9;").replace("\n", "&#xA;") if attribute else text


def _record(v: Value, name: str, key: str) -> Value:
    d = dict(v.data) if v.kind == "Object" else {}
    if d.get("record") != Value("String", name) or key not in d:
        raise Unrepresentable("core.materialization.record-required@1", name)
    return d[key]


def write_xml(v: Value) -> str:
    """Only element trees; namespaces are declared where they come into use."""

    def one(e: Value, scope: dict[str, str]) -> str:
        d = dict(e.data)
        if d["kind"].data != "element":
            text = d["text"].data
            return {"text": _xml_text(text), "cdata": f"<![CDATA[{text}]]>", "comment": f"<!--{text}-->"}[d["kind"].data]
        attributes = [dict(a.data) for a in d["attributes"].data]
        scope, declared = dict(scope), ""
        for p, uri in [(d["prefix"].data, d["namespace"].data), *[(a["prefix"].data, a["namespace"].data) for a in attributes if a["prefix"].data]]:
            if scope.get(p, "") != uri:
                scope[p] = uri
                declared += f' xmlns{":" if p else ""}{p}="{_xml_text(uri, True)}"'
        qualified = lambda x: (x["prefix"].data + ":" if x["prefix"].data else "") + x["local"].data
        head = qualified(d) + declared + "".join(f' {qualified(a)}="{_xml_text(a["value"].data, True)}"' for a in attributes)
        inner = "".join(one(c, scope) for c in d["children"].data)
        return f"<{head}>{inner}</{qualified(d)}>" if inner else f"<{head}/>"

    return '<?xml version="1.0" encoding="UTF-8"?>\n' + one(_record(v, "xml.element-tree@1", "root"), {"xml": "http://www.w3.org/XML/1998/namespace"}) + "\n"


def write_plist_xml(v: Value) -> str:
    import base64

    def one(x: Value, pad: str) -> str:
        if x.kind == "String":
            return f"{pad}<string>{_xml_text(x.data)}</string>\n"
        if x.kind == "Integer":
            return f"{pad}<integer>{x.data}</integer>\n"
        if x.kind == "BinaryFloat64":
            return f"{pad}<real>{scalar_text(x)}</real>\n"
        if x.kind == "Boolean":
            return f"{pad}<{scalar_text(x)}/>\n"
        if x.kind == "Bytes":
            return f"{pad}<data>{base64.b64encode(x.data).decode()}</data>\n"
        if x.kind == "Sequence":
            return f"{pad}<array>\n" + "".join(one(i, pad + "\t") for i in x.data) + f"{pad}</array>\n"
        if x.kind == "Object":
            return f"{pad}<date>{_date(x).strftime('%Y-%m-%dT%H:%M:%SZ')}</date>\n"
        if x.kind == "EntryMapping":
            return f"{pad}<dict>\n" + "".join(f"{pad}\t<key>{_xml_text(k.data)}</key>\n" + one(i, pad + "\t") for k, i in x.data) + f"{pad}</dict>\n"
        return _refuse("plist.xml", x)

    root = _record(v, "plist.value-tree@1", "root")
    return '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE plist PUBLIC "-//Apple//DTD PLIST 1.0//EN" "http://www.apple.com/DTDs/PropertyList-1.0.dtd">\n<plist version="1.0">\n' + one(root, "") + "</plist>\n"


def _date(x: Value):
    from datetime import datetime, timedelta

    d = dict(x.data)
    if d.get("kind") != Value("String", "date"):
        _refuse("plist.xml", x)
    seconds = struct.unpack(">d", struct.pack(">Q", d["seconds"].data))[0]
    if seconds != int(seconds):
        _refuse("plist.xml", x)
    return datetime(2001, 1, 1) + timedelta(seconds=seconds)


def write_plist_binary(v: Value) -> bytes:
    """Scalars are shared, widths minimal: the standard library's writer, which needs distinct keys."""

    def one(x: Value):
        if x.kind == "BinaryFloat64":
            return struct.unpack(">d", struct.pack(">Q", x.data))[0]
        if x.kind == "Sequence":
            return [one(i) for i in x.data]
        if x.kind == "EntryMapping":
            if len({k.data for k, _ in x.data}) < len(x.data):
                _refuse("plist.binary", x)
            return {k.data: one(i) for k, i in x.data}
        if x.kind == "Object":
            d = dict(x.data)
            return plistlib.UID(d["uid"].data) if d["kind"].data == "uid" else _date(x)
        return x.data if x.kind in ("String", "Integer", "Boolean", "Bytes") else _refuse("plist.binary", x)

    return plistlib.dumps(one(_record(v, "plist.value-tree@1", "root")), fmt=plistlib.FMT_BINARY, sort_keys=False)


def write_hcl(v: Value) -> str:
    def literal(x: Value) -> str:
        if x.kind == "String":
            return quoted(x.data).replace("${", "$${").replace("%{", "%%{")
        if x.kind in ("Null", "Boolean", "Integer"):
            return scalar_text(x) or "null"
        if x.kind == "Decimal":
            return f"{x.data[0]}e{x.data[1]}" if x.data[1] >= 0 else _point(x)
        if x.kind == "Sequence":
            return "[" + ", ".join(map(literal, x.data)) + "]"
        if x.kind == "EntryMapping":
            return "{ " + ", ".join(f"{literal(k)} = {literal(i)}" for k, i in x.data) + " }" if x.data else "{}"
        return _refuse("hcl", x)

    def body(items, pad: str) -> str:
        out = ""
        for i in items:
            d = dict(i.data)
            if d["kind"].data == "attribute":
                out += f"{pad}{d['name'].data} = {literal(d['value'])}\n"
            else:
                labels = "".join(" " + quoted(x.data) for x in d["labels"].data)
                out += f"{pad}{d['type'].data}{labels} {{\n{body(d['body'].data, pad + '  ')}{pad}}}\n"
        return out

    return body(_record(v, "hcl.body@1", "body").data, "")


def _point(x: Value) -> str:
    c, e = x.data
    digits = str(abs(c)).rjust(-e + 1, "0")
    return ("-" if c < 0 else "") + digits[:e] + "." + digits[e:]


#: Style to writer and the profile its output is parsed under.
STYLES = {
    "json.canonical-compact@1": (lambda v: write_json(v) + "\n", "json.strict@1"),
    "json.canonical-pretty@1": (lambda v: write_json(v, indent=2) + "\n", "json.strict@1"),
    "json5.canonical-compact@1": (lambda v: write_json(v, True) + "\n", "json5.standard@1"),
    "json5.canonical-pretty@1": (lambda v: write_json(v, True, 2) + "\n", "json5.standard@1"),
    "toml.canonical-document@1": (write_toml, "toml.1.0@1"),
    "yaml.canonical-block@1": (lambda v: x if (x := write_yaml(v)).endswith("\n") else x + "\n", "yaml.1.2-core@1"),
    "yaml.canonical-flow@1": (lambda v: write_yaml(v, True) + "\n", "yaml.1.2-core@1"),
    "ini.portable-canonical@1": (write_ini, "ini.portable@1"),
    "ini.windows-canonical@1": (lambda v: write_ini(v, "ini.windows@1"), "ini.windows@1"),
    "ini.python-configparser-canonical@1": (lambda v: write_ini(v, "ini.python-configparser@1"), "ini.python-configparser@1"),
    "java-properties.reader-canonical@1": (write_properties, "java-properties.reader@1"),
    "java-properties.latin1-canonical@1": (write_properties, "java-properties.latin1@1"),
    "xml.safe-canonical-document@1": (write_xml, "xml.1.0-safe@1"),
    "plist.xml-canonical@1": (write_plist_xml, "plist.xml@1"),
    "plist.binary-canonical@1": (write_plist_binary, "plist.binary@1"),
    "hcl.canonical-document@1": (write_hcl, "hcl.native@1"),
}
DEFAULT_STYLE = {"json": "json.canonical-compact@1", "json5": "json5.canonical-compact@1", "toml": "toml.canonical-document@1", "yaml": "yaml.canonical-block@1", "ini": "ini.portable-canonical@1", "properties": "java-properties.reader-canonical@1", "xml": "xml.safe-canonical-document@1", "plist": "plist.xml-canonical@1", "hcl": "hcl.canonical-document@1"}


def _same(a: Value, b: Value) -> bool:
    """Equal, an entry mapping with distinct string keys being as good as an object."""
    from docloom.functions.values import mapping

    def norm(v: Value) -> Value:
        if v.kind == "Sequence":
            return Value(v.kind, tuple(map(norm, v.data)))
        if v.kind == "Object":
            return Value(v.kind, tuple((k, norm(x)) for k, x in v.data))
        if v.kind == "EntryMapping":
            return mapping([(norm(k), norm(x)) for k, x in v.data])
        return v

    return norm(a) == norm(b)


def materialize(v: Value, style: str) -> str | bytes:
    """The document of a value in a style; refused unless parsing it gives the value again."""
    from docloom.sources.scan import parse

    writer, profile = STYLES[style]
    out = writer(v)
    tree = parse(out, profile)
    if tree.value is None or not _same(tree.value, v):
        raise Unrepresentable("core.materialization.closure@1", style)
    return out
