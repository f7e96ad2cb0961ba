"""Configuration: defaults, a file in YAML or JSON, and what a caller says, in rising order of weight."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

import yaml

FILES = ("lodestone.config.yml", "lodestone.config.yaml", "lodestone.config.json")


@dataclass(frozen=True)
class Invariant:
    id: str
    value: str
    used_in: list[str]


@dataclass(frozen=True)
class Config:
    vault: Path
    root: Path
    refinements: Path
    listing: str = "HIERARCHY.md"
    code_refs_file: str = "code-refs.json"
    required_fields: list[str] = field(default_factory=list)
    invariants: list[Invariant] = field(default_factory=list)
    search: bool = True
    strategy: str = "heading"
    max_chunk_chars: int = 2000
    embedding: dict = field(default_factory=lambda: {"provider": "local"})
    mode: str = "hybrid"
    limit: int = 10
    file: Path | None = None


def _whole(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be a positive integer, got {value!r}")
    return value


def _one_of(value: object, name: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, got {value!r}")
    return value


def load(cwd: str | Path = ".", file: str | None = None, vault: str | None = None, root: str | None = None) -> Config:
    """Paths in a file are relative to it. Blocks are merged key by key; an embedding block replaces the default whole, and a chunking block needs its strategy."""
    cwd = Path(cwd).resolve()
    path = cwd / file if file else next((cwd / n for n in FILES if (cwd / n).exists()), None)
    raw = path.read_text() if path else "{}"
    given = (json.loads(raw) if path and path.suffix == ".json" else yaml.safe_load(raw)) or {}
    base = path.parent if path else cwd
    vault = vault or given.get("vault", "vault")
    index, search = given.get("index") or {}, given.get("search") or {}
    chunking = search.get("chunking", {"strategy": "heading"})
    embedding = search.get("embedding", {"provider": "local"})
    _one_of(embedding.get("provider"), "search.embedding.provider", ("local", "gemini"))
    staging = (given.get("evolution") or {}).get("stagingDir") or f"{vault}/.lodestone/refinements"
    return Config(
        vault=(base / vault).resolve(),
        root=(base / (root or given.get("root", "."))).resolve(),
        refinements=(base / staging).resolve(),
        listing=index.get("file", "HIERARCHY.md"),
        code_refs_file=index.get("codeRefsFile", "code-refs.json"),
        required_fields=list((given.get("frontmatter") or {}).get("requiredExtraFields", [])),
        invariants=[Invariant(i["id"], i["value"], list(i["usedIn"])) for i in given.get("externalInvariants", [])],
        search=search.get("enabled", True),
        strategy=_one_of(chunking.get("strategy"), "search.chunking.strategy", ("heading", "whole-note")),
        max_chunk_chars=_whole(chunking.get("maxChunkChars", 2000), "search.chunking.maxChunkChars"),
        embedding=embedding,
        mode=_one_of(search.get("defaultMode", "hybrid"), "search.defaultMode", ("fts", "vector", "hybrid")),
        limit=_whole(search.get("defaultLimit", 10), "search.defaultLimit"),
        file=path,
    )
