"""Facts of sources: digest, encoding, detection, coordinates, redaction, exit classes. Spark expressions where they suffice."""

from __future__ import annotations

import bisect

from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte order marks, code pages and the words of secret names.
MARKS = [("EFBBBF", "utf-8"), ("FFFE0000", "utf-32le"), ("0000FEFF", "utf-32be"), ("FFFE", "utf-16le"), ("FEFF", "utf-16be")]
CODE_PAGES = {"windows-874": "cp874", "windows-1250": "cp1250", "windows-1251": "cp1251", "windows-1252": "cp1252", "windows-1253": "cp1253", "windows-1254": "cp1254", "windows-1255": "cp1255", "windows-1256": "cp1256", "windows-1257": "cp1257", "windows-1258": "cp1258", "windows-932": "cp932"}
REFUSED = ("windows-936", "windows-949", "windows-950")
SECRETS = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "privatekey", "private_key", "private-key", "accesskey", "access_key", "access-key", "credential", "auth")


def digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def mark(content: Column) -> Column:
    """The encoding a byte order mark names; the longer marks are looked at first."""
    head = F.hex(F.substring(content.cast("binary"), 1, 4))
    out = None
    for code, name in MARKS:
        hit = F.substring(head, 1, len(code)) == code
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def encoding(content: Column, default: str, override: Column | None = None, declaration: Column | None = None) -> Column:
    """selected and conflict: mark, declaration and override must agree; then override, declaration, mark, default decide."""
    told = [override if override is not None else F.lit(None).cast("string"), declaration if declaration is not None else F.lit(None).cast("string"), mark(content)]
    names = F.array_distinct(F.filter(F.array(*told), lambda x: x.isNotNull()))
    conflict = (F.size(names) > 1) | F.coalesce(F.get(names, 0).startswith("utf-32"), F.lit(False))
    chosen = F.when(F.size(names) > 0, F.get(names, 0)).otherwise(F.lit(default))
    return F.struct(F.when(~conflict, chosen).alias("selected"), F.when(conflict, "core.source.encoding-conflict@1").alias("code"))


def decode(content: bytes, name: str) -> str:
    if name in REFUSED:
        raise ValueError("core.source.unsupported-encoding@1")
    return content.decode({"latin-1": "latin-1", **CODE_PAGES}.get(name, name.replace("utf-16le", "utf-16-le").replace("utf-16be", "utf-16-be")))


def detect(text: Column, path: Column) -> Column:
    """Candidate families of a document by how it begins, what it holds and its path, in a fixed order; more than one is ambiguous."""
    first = F.ltrim(F.regexp_replace(text, "^\ufeff", ""))
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    tests = [
        ("plist", first.contains("<plist") | first.startswith("bplist00") | (end == "plist")),
        ("xml", first.startswith("<") & ~first.contains("<plist")),
        ("json", first.rlike(r"^[\[{]") & (end != "toml") & (end != "ini")),
        ("toml", end == "toml"),
        ("yaml", end.isin("yaml", "yml") | first.startswith("---") | first.startswith("%YAML")),
        ("ini", end.isin("ini", "cfg") | (first.rlike(r"^\[[A-Za-z]") & ~end.isin("toml", "json"))),
        ("java-properties", end == "properties"),
        ("hcl", end.isin("hcl", "tf", "tfvars")),
    ]
    return F.filter(F.array(*[F.when(t, n) for n, t in tests]), lambda x: x.isNotNull())


def redacted(name: Column, value: Column) -> Column:
    """The value, or *** where its name has a secret's word in it."""
    return F.when(name.rlike("(?i)" + "|".join(SECRETS)), F.lit("***")).otherwise(value)


def exit_class(code: Column) -> Column:
    """A process exit code by the kind of an error."""
    return F.when(code.isNull(), 0).when(code.contains("resource-limit") | code.contains("depth"), 5).when(code.startswith("core.query"), 3).when(code.contains(".parse.") | code.contains("encoding"), 2).when(code.startswith("core.conversion") | code.contains("projection") | code.contains("materialization"), 4).otherwise(1)


class Coordinates:
    """Byte, scalar and UTF-16 offsets of one text, from checkpoints."""

    def __init__(self, text: str, every: int = 64):
        self.text, self.every, self.points = text, every, []
        b = u = 0
        for k, c in enumerate(text):
            if k % every == 0:
                self.points.append((b, k, u))
            b, u = b + len(c.encode("utf-8", "surrogatepass")), u + (2 if c > "￿" else 1)
        self.end = (b, len(text), u)

    def of_byte(self, at: int) -> tuple[int, int]:
        """Scalar and UTF-16 offset of a byte offset; inside a character it is refused."""
        if at == self.end[0]:
            return self.end[1:]
        b, k, u = self.points[bisect.bisect_right(self.points, (at, 1 << 60, 0)) - 1] if self.points else (0, 0, 0)
        while b < at and k < len(self.text):
            c = self.text[k]
            b, k, u = b + len(c.encode("utf-8", "surrogatepass")), k + 1, u + (2 if c > "￿" else 1)
        if b != at:
            raise ValueError("core.source.offset-inside-character@1")
        return k, u
