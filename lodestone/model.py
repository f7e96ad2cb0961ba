"""Schemas of a compiled vault, and the tables that hold one."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

CODE_REF = "struct<file:string,symbol:string,kind:string,namespace:string>"
NOTE = f"id string, title string, desc string, status string, owner string, last_verified string, ttl_days bigint, audience array<string>, tags array<string>, code_refs array<{CODE_REF}>, extra map<string,string>, fm_id string, fm_errors array<string>, body string, file string"
SCHEMA_DOC = "top string, schemas array<struct<id:string,title:string,children:array<string>,namespace:boolean>>"
SYMBOL = "file string, symbol string, kind string, namespaces array<string>, line int, column int"
TABLES = {
    "note": "id string, title string, desc string, status string, owner string, last_verified string, ttl_days bigint, file string",
    "chunk": "id string, note_id string, chunk_index bigint, heading_path string, text string, search_text string, modality string",
    "heading": "id string, note_id string, level bigint, slug string, text string",
    "tag": "name string",
    "audience": "name string",
    "symbol": "id string, file string, symbol string, kind string",
    "schema": "id string, title string, namespace boolean",
    "has_child": "parent string, child string",
    "links_to": "source string, target string, anchor string",
    "has_tag": "note_id string, tag string",
    "has_audience": "note_id string, audience string",
    "declares": "note_id string, symbol_id string",
    "schema_child": "schema_id string, child_id string",
}
#: What tables are sorted by where they are written.
ORDER = {"note": ("id",), "chunk": ("id",), "links_to": ("source", "target"), "has_tag": ("note_id", "tag"), "declares": ("note_id", "symbol_id"), "symbol": ("file", "symbol")}
SCHEMA_VERSION = 2


@dataclass(frozen=True)
class Vault:
    """A compiled vault: seven tables of nodes and six of edges; chunks know their note, headings theirs.

    linked_from has the rows of links_to laid out by target, where the vault has been written.
    """

    note: DataFrame
    chunk: DataFrame
    heading: DataFrame
    tag: DataFrame
    audience: DataFrame
    symbol: DataFrame
    schema: DataFrame
    has_child: DataFrame
    links_to: DataFrame
    has_tag: DataFrame
    has_audience: DataFrame
    declares: DataFrame
    schema_child: DataFrame
    linked_from: DataFrame | None = None

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self) if f.name in TABLES]

    def write(self, path: str) -> None:
        """Each table in the order in which it is looked up, so that a query for one note reads the row groups that may have it. A note of very many links is spread over files."""
        spark = self.note.sparkSession
        for name, df in self.items():
            keys = ORDER.get(name)
            df = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        links = spark.read.schema(TABLES["links_to"]).parquet(f"{path}/links_to")
        links.repartitionByRange("target", "source").sortWithinPartitions("target", "source").write.mode("overwrite").parquet(f"{path}/linked_from")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Vault":
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
        return cls(**{name: read(name, schema) for name, schema in TABLES.items()}, linked_from=read("linked_from", TABLES["links_to"]))


def positive(value: int | None, name: str) -> int | None:
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
        raise ValueError(f"{name} must be a positive integer")
    return value


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if positive(limit, "limit") is None else df.limit(limit)
