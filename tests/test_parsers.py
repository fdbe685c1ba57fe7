import plistlib
import tomllib

import pytest

from docloom.functions.edits import patch, splice, untouched
from docloom.functions.materialize import Unrepresentable, materialize
from docloom.functions.source import Coordinates
from docloom.functions.values import Value, decimal_text, integer, scalar_text, string
from docloom.sources import yaml_doc
from docloom.sources.scan import formed, parse
from docloom.sources.tree import Failure

GOOD = {
    "json.strict@1": ['{"size": 7, "name": "x", "size": 8}', '[1, -2.5e3, "\\u00e9", null, true]', '"x"'],
    "jsonc.bounded@1": ['{/* c */"a": 1 // d\n}'],
    "json5.standard@1": ["{a: 'x', b: +0x10, c: [Infinity, NaN,], // d\n}"],
    "toml.1.0@1": ['a.b = 1\n[[x]]\ny = 1979-05-27\n[[x]]\nz = {w = [1, 2]}\n', 's = """\nmulti\\\n   line"""\nl = \'\'\'raw\'\'\'\n'],
    "yaml.1.2-core@1": ["host: web\nport: 80\ntags: [a, b]\n", "- |\n  x\n   y\n- >-\n  f\n  g\n", "--- &a [1, *a ]\n...\n---\n? k\n: v\n", "# only\nk: 'it''s' # c\n"],
    "ini.portable@1": ["[a]\nk=v\n;c\n"],
    "ini.windows@1": ['[Disk]\r\nSize=10\r\nsize="20"\r\n[Net]\r\nproxy=\r\n'],
    "ini.python-configparser@1": ["[DEFAULT]\na: 1\n# c\n[x]\nb = 1\n  2\nc\n"],
    "java-properties.reader@1": ["two\\ words=x\\u003f\ntwo\\ words=y\nbare\n", "! c\nx : y\\\n   z\n", "k\\\\\nend=\\"],
    "xml.1.0-safe@1": ["<note>5 &gt; 4 &quot;so&quot; &#x263A; it is</note>", '<?xml version="1.0"?><a xmlns:p="u"><p:b x="1"/><!--c--><![CDATA[d]]><?e f?></a>\n'],
    "plist.xml@1": ['<plist version="1.0"><dict><key>a</key><integer>1</integer></dict></plist>'],
    "hcl.native@1": ['a = 1 + 2 * 3\nb "l" {\n  c = "x${y}z"\n}\n', "t = [for x in y : x]\nh = <<EOT\nz\nEOT\n# c\n"],
    "hcl.tfvars@1": ["a = [1, 2]\n"],
}


@pytest.mark.parametrize("profile, text", [(p, t) for p, ts in GOOD.items() for t in ts])
def test_pieces_cover_the_source(profile, text):
    tree = parse(text, profile)
    assert "".join(text[s:e] for _, _, s, e in tree.pieces) == text
    assert all(code.endswith("duplicate-member@1") for code, _, _ in tree.diagnostics)


@pytest.mark.parametrize(
    "profile, text, code",
    [
        ("xml.1.0-safe@1", "<menu><dish>&soup;</dish></menu>", "xml.entity.unknown@1"),
        ("xml.1.0-safe@1", '<!DOCTYPE menu SYSTEM "menu.dtd"><menu><dish/></menu>', "xml.dtd.external-subset@1"),
        ("plist.xml@1", "<plist><array><true/></array></plist>", "plist.parse.root-version@1"),
        ("plist.xml@1", '<plist version="1.0"><!-- none --></plist>', "plist.parse.root-value-count@1"),
        ("json.strict@1", "", "json.value.missing@1"),
        ("json.strict@1", '{"a" 1}', "json.object.missing-colon@1"),
        ("json.strict@1", "[1,]", "json.trailing-comma@1"),
        ("hcl.tfvars@1", "b {\n}\n", "hcl.tfvars.block@1"),
    ],
)
def test_recovered(profile, text, code):
    assert code in [c for c, _, _ in parse(text, profile).diagnostics]


@pytest.mark.parametrize("profile, text", [("toml.1.0@1", "a = 1\na = 2\n"), ("toml.1.0@1", "a = 99999999999999999999"), ("yaml.1.2-core@1", "a: *x\n"), ("ini.portable@1", "[é]\n")])
def test_failures(profile, text):
    with pytest.raises(Failure):
        parse(text, profile)


def test_toml_agrees_with_the_standard_library():
    text = 'a.b.c = 1\nx = [1, [2, "s"]]\n[t]\nq = "\\u00e9\\n"\n[t.u]\nf = 1.5\n[[l]]\nn = 0x1F\n[[l]]\nm = true\n'

    def plain(v: Value):
        if v.kind == "Object":
            return {k: plain(x) for k, x in v.data}
        if v.kind == "Sequence":
            return [plain(x) for x in v.data]
        return float(scalar_text(v)) if v.kind == "BinaryFloat64" else v.data

    assert plain(parse(text, "toml.1.0@1").value) == tomllib.loads(text)


def test_yaml_scalars():
    one = lambda s, p="yaml.1.2-core@1": parse(s, p).value
    assert one("0x10\n") == integer(16) and one("1e3\n") == decimal_text("1e3") and one("~\n").kind == "Null"
    assert one("yes\n") == string("yes") and one("yes\n", "yaml.1.1-compat@1") == Value("Boolean", True)
    assert one("1:30\n", "yaml.1.1-compat@1") == integer(90) and one("010\n") == integer(10) and one("010\n", "yaml.1.1-compat@1") == integer(8)
    graph = yaml_doc.graph(parse("a: &x [1]\nb: *x\n", "yaml.1.2-core@1"))
    ends = [r["value_id"] for r in graph.rows if r["role"] == "GraphMappingEntry"]
    assert ends[0] == ends[1]


def test_binary_property_list():
    data = {"a": 1, "b": [1.5, True, b"x", plistlib.UID(3)], "é": "é" * 20}
    tree = parse(plistlib.dumps(data, fmt=plistlib.FMT_BINARY), "plist.binary@1")
    again = materialize(tree.value, "plist.binary-canonical@1")
    assert plistlib.loads(again) == data
    with pytest.raises(Failure):
        parse(b"bplist00" + b"\0" * 40, "plist.binary@1")


def test_materializers_close_or_refuse():
    v = parse('{"a":[1,2.50,true,null,"x\\n\\"é"],"b":{"c":{}},"d":[]}', "json.strict@1").value
    for style in ("json.canonical-pretty@1", "json5.canonical-compact@1", "yaml.canonical-block@1", "yaml.canonical-flow@1"):
        assert materialize(v, style)
    for style in ("toml.canonical-document@1", "ini.portable-canonical@1", "xml.safe-canonical-document@1"):
        with pytest.raises(Unrepresentable):
            materialize(v, style)


def test_edits_are_all_or_nothing():
    assert splice('{"é":1}', [(6, 7, "22")]) == '{"é":22}'
    assert patch('{"a":1}', [(5, 6, "2"), (5, 6, "3")], "json.strict@1")[0] == "core.edit.overlap@1"
    assert patch('{"a":1}', [(5, 6, "")], "json.strict@1")[0] == "core.edit.reparse@1"
    assert patch('{"a":1}', [(5, 6, "[]")], "json.strict@1")[3] == '{"a":[]}'


def test_untouched_bytes_are_proved():
    base, change = '{"é":1,"b":[2]}', [(6, 7, "ünd"), (12, 13, "")]
    assert untouched(base, splice(base, change), change)
    assert not untouched(base, splice(base, change) + " ", change) and not untouched(base, splice(base, change).replace("b", "c"), change)


def test_coordinates():
    c = Coordinates("aé😀b" * 50)
    assert c.of_byte(0) == (0, 0) and c.of_byte(3) == (2, 2) and c.of_byte(7) == (3, 4) and c.of_byte(8 * 50) == (200, 250)
    with pytest.raises(ValueError):
        c.of_byte(2)


@pytest.mark.parametrize(
    "text, names, lost",
    [
        ("x =\ny = 1\n", ["y"], ["x ="]),
        ("a = 1\n}\nb = 2\n", ["a", "b"], []),
        ('r "a" {\n x = 1\n y = (1,\n', ["r", "x"], ["y = (1,\n"]),
        ('a = "open\nb = 2\n', ["b"], ['a = "open']),
        ("a = [1, 2\n b = 3\n", [], ["a = [1, 2\n b = 3\n"]),
        ("ok = 1\n? bad\nblk {\n c = \n d = 4\n}\n", ["ok", "blk", "d"], ["? bad", "c = "]),
    ],
)
def test_hcl_goes_on_after_a_failed_item(text, names, lost):
    tree = formed(text, "hcl.native@1")
    assert [r["name"] for r in tree.rows if r["role"] in ("HclAttribute", "HclBlock")] == names
    assert [text[s:e] for _, k, s, e in tree.pieces if k == "ErrorRegion"] == lost
    assert "".join(text[s:e] for _, _, s, e in tree.pieces) == text and tree.value is None and tree.diagnostics


@pytest.mark.parametrize("text", ['{"a":1,"b":[1.50,-0,true,null,"x"],"a":{"c":{}},"d":[]}', "[]", '"x"', " 12 ", "-1.5e3", '{"a":"\u00e9"}', '{"a"', "[1,]", "NaN", "", "[" * 300 + "]" * 300, '"\t"', "01", '{"n":' + "9" * 5000 + "}"])
def test_the_quick_parser_gives_the_same_rows(text):
    full, fast = formed(text, "json.strict@1", None, False), formed(text, "json.strict@1", None, False, False)
    if isinstance(full, str):
        assert fast == full
        return
    rows = lambda t: [{k: v for k, v in r.items() if k not in ("start_byte", "end_byte") and v is not None} for r in t.rows]
    assert rows(full) == rows(fast) and [c for c, _, _ in full.diagnostics] == [c for c, _, _ in fast.diagnostics] and full.value == fast.value


def test_sources_in_other_encodings():
    mark = "﻿"
    for profile, text in (("yaml.1.2-core@1", "a: é𝄞\n"), ("xml.1.0-safe@1", "<a>é𝄞</a>"), ("ini.windows@1", "[S]\r\nk=é𝄞\r\n")):
        wide = formed((mark + text).encode("utf-16-le"), profile)
        plain = formed(mark + text, profile)
        assert wide.encoding == "utf-16le" and [r["text"] for r in wide.rows if r.get("text")] == [r["text"] for r in plain.rows if r.get("text")]
        assert wide.table(False)[0][15] == len((mark + text).encode("utf-16-le"))  # the document's end in bytes
    assert formed((mark + "a = 1").encode("utf-16-le"), "toml.1.0@1") == "core.source.encoding-conflict@1"
    assert formed((mark + "a").encode("utf-32-le"), "yaml.1.2-core@1") == "core.source.unsupported-bom@1"
    assert formed(b"\xff\xff", "json.strict@1") == "core.source.invalid-encoding@1"
    assert formed("[S]\nk=€\n".encode("cp1252"), "ini.windows@1", "windows-1252").rows[-1]["text"] == "€"
    assert formed("[S]\nk=1\n".encode(), "ini.portable@1", "windows-1252") == "core.source.encoding-conflict@1"
    assert formed("[S]\nk=1\n".encode(), "ini.windows@1", "windows-949") == "core.source.unsupported-encoding@1"
