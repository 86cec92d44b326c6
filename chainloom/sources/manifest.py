"""Manifests: small tab-separated files that list the samples of a build."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

# The columns of a manifest, and the endings of each kind of file.
COLUMNS = ["file", "id", "type", "group", "description", "assay", "biosample_type", "biosample", "condition", "treatment", "species", "replication_type", "platform", "pipeline", "pipeline_version", "annotation_source", "annotation_version", "source_url", "publication", "expression_attribute"]
TYPES = ("sample", "annotation", "replicate")
KINDS = {"gtf": "annotation_text", "gff": "annotation_text", "gff3": "annotation_text", "sam": "alignment_text", "bam": "alignment_binary"}
SCHEMA = ", ".join(f"`{c}` {'array<string>' if c == 'expression_attribute' else 'string'}" for c in COLUMNS)


def infer_group(sample_id: str) -> str:
    """Id without a final ``_rep`` and digits."""
    return re.sub(r"_rep[0-9]+$", "", sample_id)


def file_kind(path: str) -> str | None:
    ending = re.sub(r"\.gz$", "", path.lower()).rpartition(".")[2]
    return KINDS.get(ending)


def parse(text: str, folder: str = "") -> list[dict]:
    """Rows of a manifest. ``.`` and blank cells are null; paths are taken from ``folder``; errors carry the line number."""
    rows, infer = parse_open(text, folder)
    return [completed(r, infer) for r in rows]


def completed(row: dict, infer: bool = True) -> dict:
    """A row whose id, type and (with ``infer``) group have their default where they are open."""
    row = dict.fromkeys(COLUMNS) | row
    row["id"] = row["id"] or os.path.splitext(os.path.basename(row["file"]))[0]
    row["type"] = row["type"] or "sample"
    if row["group"] is None and infer and row["type"] == "sample":
        row["group"] = infer_group(row["id"])
    row["expression_attribute"] = row["expression_attribute"] or []
    return row


def filled(row: dict, header: dict[str, str]) -> dict:
    """A row whose open cells are taken from the header of its file; what the manifest says stays."""
    row = row | {c: v for c, v in header.items() if c in COLUMNS and c != "file" and v and not row.get(c)}
    if isinstance(row.get("expression_attribute"), str):
        row["expression_attribute"] = attribute_names(row["expression_attribute"])
    if row.get("type"):
        row["type"] = row["type"].lower()
        if row["type"] not in TYPES:
            raise ValueError(f"{row['file']}: type {row['type']}")
    return row


def attribute_names(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def parse_open(text: str, folder: str = "") -> tuple[list[dict], bool]:
    """Rows as ``parse`` gives them but without defaults, and whether groups are inferred (there is no such column)."""
    header: list[str] | None = None
    rows = []
    for number, raw in enumerate(text.splitlines(), 1):
        if not raw.strip() or raw.startswith("#"):
            continue
        cells = [x.strip() for x in raw.split("\t")]
        if header is None:
            header = [x.lower() for x in cells]
            if "file" not in header:
                raise ValueError(f"line {number}: no column named file")
            continue
        values = {k: v for k, v in zip(header, cells) if v not in ("", ".")}
        if "file" not in values:
            raise ValueError(f"line {number}: no file")
        path = values["file"]
        row = dict.fromkeys(COLUMNS) | {k: v for k, v in values.items() if k in COLUMNS}
        row["file"] = path if os.path.isabs(path) or not folder else os.path.join(folder, path)
        row["type"] = row["type"] and row["type"].lower()
        if row["type"] and row["type"] not in TYPES:
            raise ValueError(f"line {number}: type {row['type']}")
        row["expression_attribute"] = attribute_names(row["expression_attribute"])
        rows.append(row)
    if header is None:
        raise ValueError("no header")
    return rows, "group" not in header


def read(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        rows = parse(f.read(), os.path.dirname(path))
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA)


def template() -> str:
    return "\t".join(COLUMNS) + "\n"
