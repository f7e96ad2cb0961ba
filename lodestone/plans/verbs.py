"""What a user does with a vault of files: check, index, search, query the graph, keep refinements, start one."""

from __future__ import annotations

import datetime
import json
import os
import re
import warnings
from collections.abc import Sequence
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..functions.text import slug_of
from ..operators import embedders, graph, search as searching, sidecars, symbols
from ..sources import changes, declarations, vault as reader
from ..sources.config import Config
from . import build as building

STATES = ("staged", "promoted", "rejected")
FIELDS = "id string, status string, source string, title string, summary string, evidence array<string>, related_notes array<string>, created_at string, updated_at string, promoted_at string, promoted_notes array<string>, rejected_at string, rejection_reason string"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def _resolved(spark: SparkSession, config: Config, notes: DataFrame) -> DataFrame:
    asked = symbols.requests(notes)
    names = [r.file for r in asked.select("file").distinct().toLocalIterator()]
    catalogue = declarations.catalogue(spark, str(config.root), names)
    base = config.root.resolve()
    there = [(n,) for n in names if (base / n).resolve().is_relative_to(base) and (base / n).is_file()]
    return symbols.resolve(asked, catalogue, spark.createDataFrame(there, "file string"))


def _read(spark: SparkSession, config: Config) -> tuple[DataFrame, DataFrame]:
    return reader.read_notes(spark, str(config.vault), config.listing), reader.read_schemas(spark, str(config.vault))


def check(spark: SparkSession, config: Config, as_of: datetime.date) -> list[str]:
    """Messages of all rules, in order; a vault that isn't there is the only finding."""
    return checked(spark, config, as_of)[0]


def checked(spark: SparkSession, config: Config, as_of: datetime.date) -> tuple[list[str], int]:
    """check(), and the number of notes."""
    if not config.vault.is_dir():
        return [f"vault directory not found: {config.vault}"], 0
    notes, schemas = _read(spark, config)
    given = spark.createDataFrame([(i.id, i.value, i.used_in) for i in config.invariants], "id string, value string, used_in array<string>")
    rows = building.check(notes, schemas, as_of, config.required_fields, given, _resolved(spark, config, notes))
    return [r.message for r in rows.collect()] + [f"refinement {e}" for e in refinement_errors(config)], notes.count()


def embedder_of(config: Config, required: bool = False) -> searching.Embedder | None:
    """What the configuration names. Where it can't be had, None with a warning, so that an index does without vectors; an error if it is required."""
    try:
        return embedders.create(config.embedding)
    except embedders.Unavailable as e:
        if required:
            raise ValueError(str(e)) from e
        warnings.warn(f"{e}; full-text search only", stacklevel=3)
        return None


def index(spark: SparkSession, config: Config, path: object, embedder: searching.Embedder | None = None, force: bool = False) -> building.Built | None:
    """Builds the index and writes the listing and the code references beside the notes, once it is in place. Without search in the configuration only these are written, and None is given."""
    notes, schemas = _read(spark, config)
    resolved = _resolved(spark, config, notes)
    built = None
    if config.search:
        meta = building.Meta(str(config.vault), config.strategy, config.max_chunk_chars, commit=changes.head(config.root))
        built = building.build(spark, notes, schemas, path, meta, embedder or embedder_of(config), resolved, force)
    else:
        building.validated(notes, resolved)
    lines = [r.line for r in sidecars.hierarchy_lines(built.vault.note if built else notes).collect()]
    (config.vault / config.listing).write_text("# Hierarchy\n\n" + "\n".join(lines) + "\n")
    refs = [{k: v for k, v in r.asDict().items() if k not in ("pos", "outcome")} for r in symbols.sidecar(resolved).collect()]
    (config.vault / config.code_refs_file).write_text(json.dumps({"schema_version": 1, "refs": refs}, indent=2) + "\n")
    return built


def staleness(spark: SparkSession, config: Config, path: object, embedder: searching.Embedder | None = None, mode: str = "fts") -> list[str]:
    """Reasons why an index doesn't reflect the vault, none if it does. An index that was built outside version control is never told to be behind."""
    old = building.Meta.read(spark, path)
    now = building.Meta(str(config.vault), config.strategy, config.max_chunk_chars, [embedder.id, embedder.dimensions] if embedder else None)
    return building.stale(old, now, changes.pending(config.root, config.vault, old.commit, config.listing) if old and old.commit else [], mode)


def _enabled(config: Config, what: str) -> None:
    if not config.search:
        raise ValueError(f"{what}: search is off in the configuration")


def search(spark: SparkSession, config: Config, path: object, query: str, mode: str | None = None, limit: int | None = None, embedder: searching.Embedder | None = None, rebuild: bool = False, status: str | None = None, tags: Sequence[str] = (), audience: Sequence[str] = ()) -> dict:
    """{mode, hits, stale, rebuilt}; rebuild: a stale index is built again first."""
    _enabled(config, "search")
    mode = mode or config.mode
    if mode != "fts" and embedder is None:
        embedder = embedder_of(config, required=True)
    reasons = staleness(spark, config, path, embedder, mode)
    if rebuild and reasons:
        index(spark, config, path, embedder)
    v, text, vectors, meta = building.load(spark, path)
    hits = searching.search(v, text, query, mode, config.limit if limit is None else limit, vectors, embedder, tuple(meta.embedder) if meta.embedder else None, status, tags, audience)
    return {"mode": mode, "hits": hits, "stale": bool(reasons) and not rebuild, "rebuilt": rebuild and bool(reasons)}


def query(spark: SparkSession, path: object, command: str, note: str | None = None, config: Config | None = None, **options: object) -> DataFrame:
    """A graph query on an index. With its configuration given, a stale index is warned of, and one without search refused."""
    if config:
        _enabled(config, "graph")
        if reasons := staleness(spark, config, path):
            warnings.warn(f"the index may be behind the vault: {reasons[0]}", stacklevel=2)
    return graph.run_graph(building.load(spark, path)[0], command, note, **options)


def _file(config: Config, status: str, id: str) -> Path:
    return config.refinements / status / f"{id}.yml"


def refinement_files(config: Config, status: str = "all") -> tuple[list[dict], list[str]]:
    """Records by time and id, and what is wrong with their files; a record in the wrong place is an error and still given."""
    records, errors = [], []
    for state in STATES if status == "all" else (status,):
        folder = config.refinements / state
        if folder.exists() and not folder.is_dir():
            errors.append(f"{folder} is not a directory")
            continue
        for file in sorted(folder.glob("*")) if folder.exists() else []:
            if file.suffix not in (".yml", ".yaml"):
                continue
            try:
                r = yaml.safe_load(file.read_text())
            except yaml.YAMLError as e:
                errors.append(f"{file} cannot be parsed: {str(e).splitlines()[0]}")
                continue
            bad = ["/ must be a mapping"] if not isinstance(r, dict) else [f"{k} must not be empty" for k in ("id", "source", "title", "summary", "created_at", "updated_at") if not r.get(k)] + ([] if r.get("status") in STATES else ["status must be staged, promoted or rejected"])
            if not bad and not re.fullmatch(r"[a-z0-9][a-z0-9-]*", str(r["id"])):
                bad.append("id must be of small letters, digits and hyphens")
            if bad:
                errors += [f"{file} {b}" for b in bad]
                continue
            r = {k: (v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v) for k, v in r.items()}
            if r["id"] != file.stem:
                errors.append(f'{file} id "{r["id"]}" does not match filename "{file.stem}"')
            if r["status"] != state:
                errors.append(f'{file} status "{r["status"]}" does not match folder "{state}"')
            records.append(r)
    return sorted(records, key=lambda r: (str(r["created_at"]), r["id"])), errors


def refinement_errors(config: Config) -> list[str]:
    records, errors = refinement_files(config)
    for r in records:
        for field in {"promoted": ("promoted_at", "promoted_notes"), "rejected": ("rejected_at", "rejection_reason")}.get(r["status"], ()):
            if not r.get(field):
                errors.append(f"[{r['id']}] {r['status']} refinement is missing {field}")
    return errors


def refinements(spark: SparkSession, config: Config, status: str = "all") -> DataFrame:
    records, _ = refinement_files(config, status)
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in records], FIELDS)


def _write(file: Path, record: dict) -> Path:
    file.parent.mkdir(parents=True, exist_ok=True)
    part = file.with_suffix(".part")
    part.write_text(yaml.safe_dump({"schema_version": 1, **{k: v for k, v in record.items() if k != "schema_version"}}, sort_keys=False, allow_unicode=True))
    os.replace(part, file)
    return file


def _clean(values: Sequence[str]) -> list[str]:
    return [v.strip() for v in values if v.strip()]


def stage(config: Config, source: str, title: str, summary: str, now: datetime.datetime, evidence: Sequence[str] = (), related: Sequence[str] = ()) -> dict:
    """A new record. Its id is the time and the title's slug, with a number where any state has that id already."""
    given = {"source": source.strip(), "title": title.strip(), "summary": summary.strip()}
    for name, value in given.items():
        if not value:
            raise ValueError(f"a record needs a non-empty {name}")
    base = f"{now:%Y%m%d%H%M%S}-{slug_of(given['title'])[:48] or 'refinement'}"
    id, n = base, 2
    while any(_file(config, s, id).exists() for s in STATES):
        id, n = f"{base}-{n}", n + 1
    record = {"id": id, "status": "staged", **given, "evidence": _clean(evidence), "related_notes": _clean(related), "created_at": now.isoformat(), "updated_at": now.isoformat()}
    _write(_file(config, "staged", id), record)
    return record


def _staged(config: Config, id: str) -> dict:
    if not id.strip():
        raise ValueError("refinement id is required")
    records, errors = refinement_files(config, "staged")
    if errors:
        raise ValueError("records are not in order:\n" + "\n".join(errors))
    found = next((r for r in records if r["id"] == id.strip()), None)
    if found is None:
        raise ValueError(f"record not found among the staged: {id.strip()}")
    return found


def _move(config: Config, record: dict) -> dict:
    _write(_file(config, record["status"], record["id"]), record)
    _file(config, "staged", record["id"]).unlink()
    if errors := refinement_errors(config):
        raise ValueError("records are not in order:\n" + "\n".join(errors))
    return record


def promote(spark: SparkSession, config: Config, id: str, notes: Sequence[str], now: datetime.datetime, path: object, embedder: searching.Embedder | None = None) -> dict:
    """A staged record becomes promoted, if the vault is in order; the index is built again."""
    if not _clean(notes):
        raise ValueError("promotion needs at least one note")
    record = _staged(config, id)
    if errors := check(spark, config, now.date()):
        raise ValueError("check failed:\n" + "\n".join(f"  - {e}" for e in errors))
    moved = _move(config, {**record, "status": "promoted", "updated_at": now.isoformat(), "promoted_at": now.isoformat(), "promoted_notes": _clean(notes)})
    index(spark, config, path, embedder)
    return moved


def reject(config: Config, id: str, reason: str, now: datetime.datetime) -> dict:
    if not reason.strip():
        raise ValueError("rejection needs a non-empty reason")
    return _move(config, {**_staged(config, id), "status": "rejected", "updated_at": now.isoformat(), "rejected_at": now.isoformat(), "rejection_reason": reason.strip()})


def init(cwd: Path, today: datetime.date, vault: str = "vault", owner: str = "team") -> list[Path]:
    """A vault to start from; nothing that exists is overwritten, and then nothing is written at all."""
    def note(id: str, title: str, desc: str, body: str) -> str:
        return f"---\nid: {id}\ntitle: {title}\ndesc: {desc}\nstatus: active\nowner: {owner}\nlast_verified: {today}\nttl_days: 180\n---\n\n# {title}\n\n{body}\n"

    content = {
        "lodestone.config.yml": f"vault: {vault}\nroot: .\n",
        f"{vault}/root.md": note("root", "Root", "Where the vault begins.", "See [[meta]]."),
        f"{vault}/root.schema.yml": "version: 1\nschemas:\n  - id: root\n    title: Root\n    children: [meta]\n",
        f"{vault}/meta.md": note("meta", "Meta", "About the vault itself.", "See [[meta.conventions]]."),
        f"{vault}/meta.schema.yml": "version: 1\nschemas:\n  - id: meta\n    title: Meta\n    children: [conventions]\n",
        f"{vault}/meta.conventions.md": note("meta.conventions", "Conventions", "How notes are written.", "One subject a note. Back to [[root]]."),
    }
    files = [cwd / name for name in content]
    if taken := [f for f in files if f.exists()]:
        raise FileExistsError(f"{taken[0]} exists")
    for f, text in zip(files, content.values()):
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return files
