"""Conversion, edits and batches over tables of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.materialize import STYLES, Unrepresentable, materialize
from docloom.functions.project import COLLAPSE, Rejected, as_object
from docloom.functions.values import encode, hash64, transport
from docloom.sources.scan import each
from docloom.sources.tree import Failure, Tree

RECORDS = {"xml": "xml.element-tree@1", "plist": "plist.value-tree@1", "hcl": "hcl.body@1"}


def codes(docs: DataFrame, profile: str) -> DataFrame:
    """doc_id, canonical binary form, its FNV-1a hash (as a signed long), and transport JSON of each portable value."""

    def make(tree: Tree | str) -> tuple:
        if isinstance(tree, str) or tree.value is None:
            return None, None, None
        h = hash64(tree.value)
        return encode(tree.value), h - (1 << 64) if h >> 63 else h, transport(tree.value)

    return each(docs, profile, make, "pvce binary, hash long, transport string")


def project(docs: DataFrame, profile: str, policy: str | None = None) -> DataFrame:
    """doc_id, status, fidelity and transport JSON. Without a policy duplicates stay as an entry mapping."""
    family = profile.split(".")[0].replace("jsonc", "json").replace("json5", "json")

    def make(tree: Tree | str) -> tuple:
        if isinstance(tree, str):
            return tree, None, None
        if tree.value is None:
            return "core.projection.unavailable@1", None, None
        if policy is None:
            return "Ok", "Transformed" if family == "json" and "EntryMapping" in transport(tree.value) else "Exact", transport(tree.value)
        try:
            value, fidelity = as_object(tree.value, policy, COLLAPSE.get(family, "Transformed"))
        except Rejected as e:
            return e.code, None, None
        return "Ok", fidelity, transport(value)

    return each(docs, profile, make, "status string, fidelity string, value string")


def convert(docs: DataFrame, profile: str, style: str, policy: str | None = None) -> DataFrame:
    """Documents of one profile in another family's canonical style: doc_id, status, fidelity, text (hex where binary).

    A value is projected, written and parsed again; whatever is not exact needs a policy for duplicates, or the document
    fails with a code. Records of XML, property lists and HCL go to their own family only.
    """
    source, target = profile.split(".")[0], style.split(".")[0]

    def make(tree: Tree | str) -> tuple:
        if isinstance(tree, str) or tree.value is None:
            return tree if isinstance(tree, str) else "core.projection.unavailable@1", None, None
        if source in RECORDS and source != target:
            return "core.conversion.record-family@1", None, None
        try:
            value, fidelity = (tree.value, "Exact") if policy is None else as_object(tree.value, policy, COLLAPSE.get(source, "Transformed"))
            out = materialize(value, style)
        except (Rejected, Unrepresentable) as e:
            return e.code, None, None
        except Failure as e:
            return e.code, None, None
        return "Ok", fidelity, out.hex() if isinstance(out, bytes) else out

    if style not in STYLES:
        raise ValueError(f"unknown style {style}")
    return each(docs, profile, make, "status string, fidelity string, text string")


def apply_plan(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Apply planned targets (path, base_digest, target_digest, target) to files (path, content) if nothing changed since.

    completed: the file now is, or already was, the target. skipped-stale: it is neither base nor target.
    """
    rows = plan.join(files, "path", "left")
    digest = F.sha2(F.col("content").cast("binary"), 256)
    status = F.when(F.col("content").isNull(), "failed").when(digest == F.col("target_digest"), "completed").when(digest != F.col("base_digest"), "skipped-stale").when(F.sha2(F.col("target").cast("binary"), 256) != F.col("target_digest"), "failed").otherwise("completed")
    return rows.select("path", status.alias("status"), F.when(status == "completed", F.col("target")).otherwise(F.col("content").cast("string")).alias("content"))
