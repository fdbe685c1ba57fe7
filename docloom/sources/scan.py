"""Scans: documents to the node table, their portable values, or what a Python function makes of each tree."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.json_doc import quick
from docloom.sources.tree import COLUMNS, SCHEMA, Failure, Tree, bytes_of, failed

MODULES = {"json": "json_doc", "jsonc": "json_doc", "json5": "json_doc", "toml": "toml_doc", "yaml": "yaml_doc", "ini": "ini_doc", "java-properties": "properties_doc", "xml": "xml_doc", "plist": "plist_doc", "hcl": "hcl_doc"}
# The profiles that can be asked for.
PROFILES = ("json.strict@1", "jsonc.bounded@1", "json5.standard@1", "toml.1.0@1", "yaml.1.2-core@1", "yaml.1.1-compat@1", "ini.portable@1", "ini.windows@1", "ini.python-configparser@1", "java-properties.reader@1", "java-properties.latin1@1", "xml.1.0-safe@1", "plist.xml@1", "plist.binary@1", "hcl.native@1", "hcl.tfvars@1")
TYPES = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
MAX_BYTES = 64 << 20


def decoded(content: bytes, profile: str, encoding: str | None = None) -> tuple[str, str]:
    """Text and encoding of a source: what its profile allows of a byte order mark, the caller's choice, and UTF-8."""
    from docloom.functions.source import MARKS, decode

    family = profile.split(".")[0]
    mark = next((name for code, name in MARKS if content.startswith(bytes.fromhex(code))), None)
    if mark in ("utf-32le", "utf-32be"):
        raise Failure("core.source.unsupported-bom@1")
    wide = family in ("yaml", "xml", "plist") or profile in ("ini.windows@1", "ini.python-configparser@1", "java-properties.reader@1")
    if "latin1" in profile:
        chosen = "latin-1"
    elif mark in ("utf-16le", "utf-16be"):
        if not wide or (profile == "ini.windows@1" and mark == "utf-16be"):
            raise Failure("core.source.encoding-conflict@1")
        chosen = mark
    else:
        chosen = encoding or "utf-8"
    if encoding and encoding != chosen or chosen not in ("utf-8", "latin-1") and not wide:
        raise Failure("core.source.encoding-conflict@1")
    try:
        return decode(content, chosen), chosen
    except UnicodeDecodeError as e:
        raise Failure("core.source.invalid-encoding@1", e.start) from e
    except (LookupError, ValueError) as e:
        raise Failure("core.source.unsupported-encoding@1") from e


def parse(content: str | bytes, profile: str, encoding: str | None = None) -> Tree:
    """One document under an explicit profile; raises Failure if it cannot be formed. encoding: the caller's choice, for
    bytes of profiles that leave one."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}")
    module = importlib.import_module(f"docloom.sources.{MODULES[profile.split('.')[0]]}")
    if len(content) > MAX_BYTES:
        raise Failure("core.parse.source-size@1")
    if profile == "plist.binary@1":
        return module.parse_binary(bytes(content), profile)
    chosen = "utf-8"
    if isinstance(content, (bytes, bytearray)):
        content, chosen = decoded(bytes(content), profile, encoding)
    tree = module.parse(content, profile)
    tree.encoding = chosen
    return tree


def formed(content, profile: str, encoding: str | None = None, pieces: bool = True, places: bool = True) -> Tree | str:
    """A tree, or the code of the failure. Text too deep for the parser counts as a depth failure."""
    if not pieces and not places and profile == "json.strict@1" and isinstance(content, str) and (found := quick(content)) is not None:
        return found
    Tree.keep = pieces
    try:
        return parse(content if content is not None else "", profile, encoding)
    except Failure as e:
        return e.code
    except RecursionError:
        return "core.parse.depth@1"
    except (ValueError, ArithmeticError):  # a value that cannot be held fails its document, not the others
        return "core.parse.invalid-value@1"
    finally:
        Tree.keep = True


def viewed(tree: Tree | str, view: str | None) -> Tree | str:
    """A tree, its graph, or its portable value as rows; failures stay what they are."""
    if isinstance(tree, str) or view is None:
        return tree
    if view == "graph":
        from docloom.sources.yaml_doc import graph

        return graph(tree)
    if tree.value is None:
        return "core.projection.unavailable@1"
    from docloom.functions.values import rows

    out = Tree("")
    rows(tree.value, out)
    return out


def scan(docs: DataFrame, profile: str, pieces: bool = False, view: str | None = None, partitions: int | None = None, encoding: str | None = None) -> DataFrame:
    """The node table of documents (doc_id, text or content), dealt out by doc_id.

    view: None for the native tree, 'graph' for the graph of YAML streams, 'value' for portable values. A document that
    cannot be formed has one row: role Document, kind Failed, its code as text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, found = [], []
                part = batch.slice(at, 500)
                for doc, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    tree = viewed(formed(content, profile, encoding, pieces), view)
                    table = failed(tree) if isinstance(tree, str) else tree.table(pieces)
                    ids += [doc] * len(table)
                    found += table
                columns = list(zip(*found)) or [()] * len(COLUMNS)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, COLUMNS)]], names=["doc_id", *[n for n, _ in COLUMNS]])

    content = "content" if "content" in docs.columns else "text"
    nodes = docs.select(F.col("doc_id").cast("long"), F.col(content)).mapInArrow(run, SCHEMA)
    return nodes.repartition(partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def each(docs: DataFrame, profile: str, make: Callable[[Tree | str], tuple], schema: str) -> DataFrame:
    """doc_id and what make() gives for each tree (or failure code)."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [kinds[c.strip().split()[1]] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [make(formed(c, profile, None, False)) for c in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(zip(*found), types)]], names=["doc_id", *names])

    content = "content" if "content" in docs.columns else "text"
    return docs.select(F.col("doc_id").cast("long"), F.col(content)).mapInArrow(run, f"doc_id long, {schema}")
