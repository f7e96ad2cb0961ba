"""Which notes of a vault may have changed since a commit, by version control."""

from __future__ import annotations

import subprocess
from pathlib import Path


def _run(root: Path, *args: str) -> list[str] | None:
    done = subprocess.run(["git", "-C", str(root), *args], capture_output=True)
    return [x for x in done.stdout.decode(errors="surrogateescape").split("\0") if x] if done.returncode == 0 else None


def head(root: Path) -> str | None:
    found = _run(root, "rev-parse", "HEAD")
    return found[0].strip() if found else None


def ancestor(root: Path, commit: str) -> bool:
    """Whether a commit is the current one or one before it; False if that can't be told."""
    return _run(root, "merge-base", "--is-ancestor", commit, "HEAD") is not None


def changed_files(root: Path, vault: Path, commit: str) -> list[str] | None:
    """Files of the vault, relative to it, changed since the commit, uncommitted or untracked; both names of one that was renamed. None without a repository or such a commit."""
    top = _run(root, "rev-parse", "--show-toplevel")
    if not top:
        return None
    base = Path(top[0].strip())
    found: set[str] = set()
    for args in (("diff", "--name-only", "--no-renames", "-z", f"{commit}..HEAD"), ("diff", "--name-only", "--no-renames", "-z", "HEAD"), ("ls-files", "--others", "--exclude-standard", "--full-name", "-z")):
        names = _run(base, *args)
        if names is None:
            return None
        found.update(names)
    inside = [(base / n) for n in found if (base / n).is_relative_to(vault)]
    return sorted(str(p.relative_to(vault)) for p in inside)


def pending(root: Path, vault: Path, commit: str, listing: str = "HIERARCHY.md") -> list[str]:
    """Why an index of this commit may not reflect the vault: no repository, a commit that isn't behind, or notes that changed."""
    if head(root) is None:
        return ["the vault is not in version control any more"]
    if not ancestor(root, commit):
        return ["the index is of a commit that is not behind the current one"]
    return [f"changed: {i}" for i in note_ids(changed_files(root, vault, commit) or [], listing)]


def note_ids(files: list[str], listing: str = "HIERARCHY.md") -> list[str]:
    """Ids of the notes among the files of a vault: what the build itself writes there, schemas and other files are none."""
    return [f.removesuffix(".md") for f in files if f.endswith(".md") and "/" not in f and f != listing]
