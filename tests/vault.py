"""The small vault that several tests share, and notes written as files."""

from pathlib import Path

from lodestone.model import NOTE


def text(id, body="", **fm):
    fields = {"id": id, "title": f"{id} title", "desc": f"{id} note.", "status": "active", "owner": "team", "last_verified": "2026-05-13", "ttl_days": 365} | fm
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return "---\n" + "\n".join(lines) + f"\n---\n# {id}\n\n{body}\n"


GRAPH = {
    "root": text("root", "[[guide]]"),
    "guide": text("guide", "[[api#Tokens]] and [[root.alpha]]", tags="[docs]"),
    "api": text("api", "## Tokens", tags="[docs, code]", code_refs="[{file: src/service.ts, symbol: issueToken}, {file: src/service.ts, symbol: revokeToken}]"),
    "impl": text("impl", "[[api]]", tags="[code, docs]", code_refs="[{file: src/service.ts, symbol: issueToken}]"),
    "root.alpha": text("root.alpha", "[[root.alpha.one]]"),
    "root.alpha.one": text("root.alpha.one"),
    "lonely": text("lonely"),
    "c1": text("c1", "[[c2]]"),
    "c2": text("c2", "[[c3]]"),
    "c3": text("c3", "[[c1]]"),
    "loop": text("loop", "[[loop]]"),
}
SERVICE = "export function issueToken() {}\nexport function revokeToken() {}\n"


def write(root: Path, notes=None, **files) -> Path:
    vault = root / "vault"
    vault.mkdir(parents=True, exist_ok=True)
    for name, content in (GRAPH if notes is None else notes).items():
        (vault / f"{name}.md").write_text(content)
    (root / "src").mkdir(exist_ok=True)
    (root / "src/service.ts").write_text(SERVICE)
    for name, content in files.items():
        (vault / name).write_text(content)
    return vault


def notes(spark, *rows):
    """Notes of dicts; what isn't given is as in an orderly note."""
    base = {"title": "T", "desc": "D", "status": "active", "owner": "o", "last_verified": "2026-05-13", "ttl_days": 365, "audience": None, "tags": None, "code_refs": None, "extra": None, "fm_errors": None, "body": ""}
    names = [x.split(" ")[0] for x in NOTE.replace(", ", "\n").split("\n")]
    made = [base | {"fm_id": r["id"], "file": r["id"] + ".md"} | r for r in rows]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in made], NOTE)
