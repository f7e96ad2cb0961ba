"""The index build: notes to a compiled vault, in full or reusing what unchanged notes have."""

from __future__ import annotations

import datetime
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SCHEMA_VERSION, Vault
from ..operators import extract, lifecycle, rules, symbols
from ..operators.search import Embedder, TextIndex, embedded
from ..sources import storage


def compile_vault(notes: DataFrame, schemas: DataFrame, resolved: DataFrame | None = None, strategy: str = "heading", most: int = 2000) -> Vault:
    """A vault's tables, lazily. resolved: code references as symbols.resolve() gives them. Edges whose ends aren't notes are dropped."""
    spark = notes.sparkSession
    declared, symbol = symbols.edges(resolved) if resolved is not None else (spark.createDataFrame([], "note_id string, symbol_id string"), spark.createDataFrame([], "id string, file string, symbol string, kind string"))
    tags, audience = extract.exploded(notes, "tags", "tag"), extract.exploded(notes, "audience", "audience")
    entries = schemas.select(F.explode("schemas").alias("s")).select("s.id", "s.title", F.coalesce("s.namespace", F.lit(False)).alias("namespace"))
    return Vault(
        note=notes.select("id", "title", "desc", "status", "owner", "last_verified", "ttl_days", "file"),
        chunk=extract.chunks(notes, strategy, most),
        heading=extract.headings(notes),
        tag=tags.select(F.col("tag").alias("name")).distinct(),
        audience=audience.select(F.col("audience").alias("name")).distinct(),
        symbol=symbol,
        schema=entries.dropDuplicates(["id"]),
        has_child=extract.existing(extract.hierarchy(notes.select("id")), notes, "parent", "child"),
        links_to=extract.existing(extract.wikilinks(notes).select("source", "target", "anchor"), notes, "source", "target"),
        has_tag=tags,
        has_audience=audience,
        declares=declared,
        schema_child=extract.schema_children(schemas, notes),
    )


def changed_chunks(new: Vault, old: Vault, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of added and changed notes, which need a vector, and (id) of those whose old one still holds."""
    fresh = changes.where(F.col("change").isin("added", "changed")).select(F.col("id").alias("note_id"))
    need = new.chunk.join(fresh, "note_id", "left_semi")
    return need, new.chunk.join(fresh, "note_id", "left_anti").select("id")


@dataclass
class Meta:
    """What an index was built from; a difference here, not in notes, calls for a full build."""

    vault: str
    strategy: str
    max_chunk_chars: int
    embedder: list | None = None
    commit: str | None = None
    built_at: str = ""
    schema_version: int = SCHEMA_VERSION
    build: str = ""
    notes: int = field(default=0)

    @classmethod
    def read(cls, spark: SparkSession, path: object) -> "Meta | None":
        """None if there is none or it is damaged."""
        try:
            return cls(**json.loads(storage.read_text(spark, f"{path}/meta.json") or ""))
        except (ValueError, TypeError):
            return None

    def write(self, spark: SparkSession, path: object) -> None:
        storage.write_text(spark, f"{path}/meta.json", json.dumps(asdict(self), indent=1))

    def drift(self, other: "Meta") -> list[str]:
        return [k for k in ("schema_version", "vault", "strategy", "max_chunk_chars") if getattr(self, k) != getattr(other, k)]


def needs_full(old: Meta | None, new: Meta, force: bool = False) -> bool:
    """Whether nothing of the old index can be used again; an index without vectors is rebuilt once there is an embedder."""
    return force or old is None or bool(old.drift(new)) or (new.embedder is not None and old.embedder != new.embedder)


def stale(old: Meta | None, new: Meta, pending: list[str], mode: str = "fts") -> list[str]:
    """Reasons why an index doesn't reflect the vault; pending: those by version control. An index without vectors has no embedder to differ."""
    if old is None:
        return ["no index"]
    out = [f"{k} changed" for k in old.drift(new)]
    if mode != "fts" and old.embedder and new.embedder and old.embedder != new.embedder:
        out.append("embedder changed")
    return out + pending


@dataclass
class Built:
    vault: Vault
    text: TextIndex
    vectors: DataFrame | None
    meta: Meta
    full: bool
    changes: DataFrame


def validated(notes: DataFrame, resolved: DataFrame | None) -> None:
    """Raises what is wrong with notes' front matter and code references, the first findings of each."""
    problems = [r.message for r in rules.front_matter(notes).orderBy("note_id").limit(50).collect()]
    if resolved is not None:
        problems += [r.message for r in symbols.code_ref_errors(resolved).limit(50).collect()]
    if problems:
        raise ValueError("index failed:\n" + "\n".join(f"  - {p}" for p in problems))


def build(spark: SparkSession, notes: DataFrame, schemas: DataFrame, path: object, meta: Meta, embedder: Embedder | None = None, resolved: DataFrame | None = None, force: bool = False) -> Built:
    """Validates, writes a new build beside the old one, then makes it the current one by writing meta.json; a failure before that leaves the old index as it was.

    All tables are made anew from the notes, which is cheap; vectors of chunks of unchanged notes are taken over. path may
    lie on any file system of Spark's. The build before the last is deleted; readers of the last may go on.
    """
    validated(notes, resolved)
    old = Meta.read(spark, path)
    meta.embedder = [embedder.id, embedder.dimensions] if embedder else None
    if embedder is None and old and old.embedder and not force:
        raise ValueError("the index has vectors and there is no embedder to keep them up to date")
    full = needs_full(old, meta, force) or not storage.exists(spark, f"{path}/{old.build}")
    meta.built_at = datetime.datetime.now(datetime.UTC).isoformat()
    meta.build = "build-" + meta.built_at.translate(str.maketrans("", "", "-:.+"))
    to = f"{path}/{meta.build}"
    compile_vault(notes, schemas, resolved, meta.strategy, meta.max_chunk_chars).write(to)
    lifecycle.hashes(notes).write.parquet(f"{to}/hashes")
    vault = Vault.read(spark, to)
    now = spark.read.parquet(f"{to}/hashes")
    was = now.limit(0) if full else spark.read.parquet(f"{path}/{old.build}/hashes")
    changes = lifecycle.reconcile(now, was)
    TextIndex.of(vault.chunk).write(to)
    vectors = None
    if embedder:
        if full or not old.embedder:
            embedded(vault.chunk, embedder).select("id", "embedding").write.parquet(f"{to}/vectors")
        else:
            need, still = changed_chunks(vault, vault, changes)
            kept = spark.read.parquet(f"{path}/{old.build}/vectors").join(still, "id", "left_semi")
            kept.unionByName(embedded(need, embedder).select("id", "embedding")).write.parquet(f"{to}/vectors")
        vectors = spark.read.parquet(f"{to}/vectors")
    meta.notes = vault.note.count()
    meta.write(spark, path)
    for name in storage.names(spark, path):
        if name.startswith("build-") and name not in (meta.build, old.build if old else ""):
            storage.delete(spark, f"{path}/{name}")
    return Built(vault, TextIndex.read(spark, to), vectors, meta, full, changes)


def load(spark: SparkSession, path: object) -> tuple[Vault, TextIndex, DataFrame | None, Meta]:
    meta = Meta.read(spark, path)
    if meta is None:
        raise ValueError(f"no index in {path}")
    to = f"{path}/{meta.build}"
    return Vault.read(spark, to), TextIndex.read(spark, to), spark.read.parquet(f"{to}/vectors") if meta.embedder else None, meta


def check(notes: DataFrame, schemas: DataFrame, as_of: datetime.date, required: list[str] | None = None, invariants: DataFrame | None = None, resolved: DataFrame | None = None, refinements: DataFrame | None = None) -> DataFrame:
    """(seq, rule, note_id, message): all rules' findings, in the order in which they are reported."""
    found = [rules.missing_root(notes), rules.front_matter(notes), rules.id_matches(notes), rules.extra_fields(notes, required or []), rules.missing_ancestors(notes), rules.schema_rules(notes, schemas), rules.broken_links(notes)]
    if resolved is not None:
        found.append(symbols.code_ref_errors(resolved))
    found.append(rules.freshness(notes, as_of))
    if invariants is not None:
        found.append(rules.invariants(notes, invariants))
    if refinements is not None:
        found.append(rules.refinement_rules(refinements))
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out.orderBy("seq", "note_id", "message")
