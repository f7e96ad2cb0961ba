"""A directory of notes in Markdown with YAML front matter, and schema files."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NOTE, SCHEMA_DOC
from . import storage

LISTING = "HIERARCHY.md"
TYPED = ("title", "desc", "status", "owner")


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return value.isoformat()[:10] if isinstance(value, (datetime.date, datetime.datetime)) else json.dumps(value, default=str, ensure_ascii=False)


def parse_front_matter(content: str) -> tuple[dict, str, list[str]]:
    """Front matter, body, and what went wrong. Without a closed block at the very start all is body."""
    if not content.startswith("---\n") and not content.startswith("---\r\n"):
        return {}, content, []
    lines = content.split("\n")
    end = next((i for i, x in enumerate(lines[1:], 1) if x.rstrip("\r") == "---"), None)
    if end is None:
        return {}, content, []
    body = "\n".join(lines[end + 1 :])
    try:
        data = yaml.safe_load("\n".join(lines[1:end])) or {}
    except yaml.YAMLError as e:
        return {}, body, [f"frontmatter cannot be parsed: {str(e).splitlines()[0]}"]
    return (data, body, []) if isinstance(data, dict) else ({}, body, ["frontmatter must be a mapping"])


def note_row(name: str, content: str) -> dict:
    fm, body, errors = parse_front_matter(content)
    row: dict = {"id": name.removesuffix(".md"), "body": body, "file": name, "fm_errors": errors}

    def problem(key: str, says: str) -> None:
        errors.append(f"frontmatter.{key} {says}")

    def words(key: str) -> list[str] | None:
        value = fm.get(key)
        if value is None:
            return None
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            problem(key, "must be a list of strings")
            return [x for x in value if isinstance(x, str)] if isinstance(value, list) else None
        return value

    for key in ("id", *TYPED):
        value = fm.get(key)
        if value is not None and not isinstance(value, str):
            problem(key, "must be a string")
        row["fm_id" if key == "id" else key] = _text(value)
    row["last_verified"] = _text(fm.get("last_verified"))
    ttl = fm.get("ttl_days")
    whole = isinstance(ttl, int) and not isinstance(ttl, bool)
    if ttl is not None and not whole:
        problem("ttl_days", "must be a whole number")
    row["ttl_days"] = ttl if whole else None
    row["audience"], row["tags"] = words("audience"), words("tags")
    refs = fm.get("code_refs")
    row["code_refs"] = None
    if refs is not None:
        if isinstance(refs, list) and all(isinstance(r, dict) for r in refs):
            row["code_refs"] = [{k: _text(r.get(k)) for k in ("file", "symbol", "kind", "namespace")} for r in refs]
        else:
            problem("code_refs", "must be a list of mappings")
    used = {"id", *TYPED, "last_verified", "ttl_days", "audience", "tags", "code_refs"}
    row["extra"] = {str(k): _text(v) for k, v in fm.items() if k not in used}
    return row


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(name, content) of the files directly in a directory."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("value").alias("content"))


def parsed(contents: DataFrame) -> DataFrame:
    """Notes of (name, content)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ("id", "title", "desc", "status", "owner", "last_verified", "ttl_days", "audience", "tags", "code_refs", "extra", "fm_id", "fm_errors", "body", "file")]
        for rows in batches:
            yield pd.DataFrame([note_row(n, c) for n, c in zip(rows["name"], rows["content"])], columns=columns, dtype=object)

    return contents.select("name", "content").mapInPandas(parse, NOTE)


def read_notes(spark: SparkSession, path: str, listing: str = LISTING) -> DataFrame:
    """The notes of a vault. A missing directory is an empty vault; the listing's own file is no note."""
    if not storage.exists(spark, path):
        return spark.createDataFrame([], NOTE)
    return parsed(files(spark, path, "*.md").where(~F.col("name").isin(LISTING, listing)))


def read_schemas(spark: SparkSession, path: str) -> DataFrame:
    """(top, schemas) of the schema files; a file that can't be parsed has none."""
    if not storage.exists(spark, path):
        return spark.createDataFrame([], SCHEMA_DOC)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for name, content in zip(rows["name"], rows["content"]):
                try:
                    data = yaml.safe_load(content)
                except yaml.YAMLError:
                    data = None
                entries = data.get("schemas") if isinstance(data, dict) else None
                entries = [e for e in entries if isinstance(e, dict)] if isinstance(entries, list) else None
                made = [{"id": _text(e.get("id")), "title": _text(e.get("title")), "children": [str(c) for c in e.get("children") or []], "namespace": e.get("namespace") is True} for e in entries] if entries else None
                out.append({"top": name.removesuffix(".yml").removesuffix(".yaml").removesuffix(".schema"), "schemas": made})
            yield pd.DataFrame(out, columns=["top", "schemas"], dtype=object)

    return files(spark, path, "*.schema.{yml,yaml}").mapInPandas(parse, SCHEMA_DOC)
