import datetime
import subprocess

import pytest
from vault import GRAPH, text, write

from lodestone.model import TABLES
from lodestone.operators.search import HashEmbedder, search
from lodestone.plans import build, verbs
from lodestone.sources import changes, config, vault as reader

NOW = datetime.datetime(2026, 6, 1, 12, 0, tzinfo=datetime.UTC)


def tables(built):
    return {name: sorted(map(repr, df.collect())) for name, df in built.vault.items()}


def test_incremental_equals_full(spark, tmp_path):
    folder = write(tmp_path)
    c, e = config.load(tmp_path), HashEmbedder(8)
    first = verbs.index(spark, c, tmp_path / "i", e)
    assert first.full and {r.change for r in first.changes.collect()} == {"added"}
    (folder / "guide.md").write_text(text("guide", "[[api]] changed", tags="[new]"))
    (folder / "lonely.md").unlink()
    (folder / "fresh.md").write_text(text("fresh", "[[guide]]"))
    second = verbs.index(spark, c, tmp_path / "i", e)
    assert not second.full
    assert {r.id: r.change for r in second.changes.collect() if r.change != "same"} == {"guide": "changed", "lonely": "removed", "fresh": "added"}
    full = verbs.index(spark, c, tmp_path / "j", e)
    assert tables(second) == tables(full) and set(tables(full)) == set(TABLES)
    vectors = lambda b: sorted((r.id, tuple(r.embedding)) for r in b.vectors.collect())
    assert vectors(second) == vectors(full)
    third = verbs.index(spark, c, tmp_path / "i", e)
    assert {r.change for r in third.changes.collect()} == {"same"}


def test_failure_leaves_the_index(spark, tmp_path):
    folder = write(tmp_path)
    c = config.load(tmp_path)
    verbs.index(spark, c, tmp_path / "i")
    before = (folder / "HIERARCHY.md").read_text(), build.Meta.read(spark, tmp_path / "i").build
    (folder / "bad.md").write_text("no front matter")
    with pytest.raises(ValueError, match="index failed"):
        verbs.index(spark, c, tmp_path / "i")
    assert ((folder / "HIERARCHY.md").read_text(), build.Meta.read(spark, tmp_path / "i").build) == before
    assert "- **root** - root title. root note." in before[0] and "    - **root.alpha.one**" in before[0]


def test_search_of_files(spark, tmp_path):
    write(tmp_path, {"root": text("root"), "alpha": text("alpha", "about widgets", tags="[w]", status="deprecated", audience="[eng]"), "beta": text("beta", "about gadgets", tags="[g]", audience="[agents]")})
    c, e = config.load(tmp_path), HashEmbedder(8)
    verbs.index(spark, c, tmp_path / "i", e)
    find = lambda q, mode="fts", **o: [r.note_id for r in verbs.search(spark, c, tmp_path / "i", q, mode, embedder=e, **o)["hits"].collect()]
    assert find("widgets") == ["alpha"] and find("Widgets nothing") == ["alpha"]
    assert find("about", status="active") == ["beta"] and find("about", tags=["w"]) == ["alpha"] and find("about", audience=["agents", "x"]) == ["beta"]
    assert len(find("about", limit=1)) == 1 and set(find("about", "hybrid")) >= {"alpha", "beta"}
    with pytest.raises(ValueError, match="positive integer"):
        find("about", limit=0)
    v, t, vectors, meta = build.load(spark, tmp_path / "i")
    with pytest.raises(ValueError, match="was built by"):
        search(v, t, "x", "vector", 5, vectors, HashEmbedder(4), tuple(meta.embedder))
    with pytest.raises(ValueError, match="needs an index"):
        search(v, t, "x", "vector")
    with pytest.raises(ValueError, match="no embedder"):
        verbs.index(spark, c, tmp_path / "i")


def test_drift():
    old = build.Meta("v", "heading", 2000, ["e", 8])
    assert not build.needs_full(old, build.Meta("v", "heading", 2000, ["e", 8])) and build.needs_full(None, old)
    assert build.needs_full(old, build.Meta("v", "heading", 1000, ["e", 8])) and build.needs_full(old, build.Meta("v", "heading", 2000, ["f", 8]))
    assert build.stale(old, build.Meta("v", "heading", 2000), ["changed: a"]) == ["changed: a"] and build.stale(None, old, []) == ["no index"]


def repository(root):
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    return run


def test_staleness_in_a_repository(spark, tmp_path):
    """Stale, then built again, then fresh: what the build writes beside the notes is no change."""
    folder = write(tmp_path)
    git = repository(tmp_path)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "a")
    c = config.load(tmp_path)
    verbs.index(spark, c, tmp_path / "i")
    assert (folder / "HIERARCHY.md").exists() and verbs.staleness(spark, c, tmp_path / "i") == []
    (folder / "root.schema.yml").write_text("version: 1\n")
    assert verbs.staleness(spark, c, tmp_path / "i") == []
    (folder / "guide.md").write_text(text("guide", "edited words"))
    (folder / "new.md").write_text(text("new"))
    assert verbs.staleness(spark, c, tmp_path / "i") == ["changed: guide", "changed: new"]
    find = lambda **o: verbs.search(spark, c, tmp_path / "i", "edited", "fts", **o)
    first = find()
    assert first["stale"] and not first["rebuilt"] and first["hits"].count() == 0
    with pytest.warns(UserWarning, match="behind the vault: changed: guide"):
        verbs.query(spark, tmp_path / "i", "backlinks", "api", c)
    git("add", ".")
    git("commit", "-qm", "b")
    again = find(rebuild=True)
    assert again["rebuilt"] and not again["stale"] and [r.note_id for r in again["hits"].collect()] == ["guide"]
    assert not find(rebuild=True)["rebuilt"] and not find()["stale"]
    git("checkout", "-q", "--orphan", "other")
    git("commit", "-qm", "c")
    assert verbs.staleness(spark, c, tmp_path / "i") == ["the index is of a commit that is not behind the current one"]


def test_old_builds_go(spark, tmp_path):
    write(tmp_path)
    c = config.load(tmp_path)
    made = [verbs.index(spark, c, tmp_path / "i").meta.build for _ in range(3)]
    assert sorted(p.name for p in (tmp_path / "i").iterdir() if p.name.startswith("build-")) == made[1:]


def test_search_off(spark, tmp_path):
    folder = write(tmp_path)
    (tmp_path / "lodestone.config.yml").write_text("search: {enabled: false}\n")
    c = config.load(tmp_path)
    assert verbs.index(spark, c, tmp_path / "i") is None and not (tmp_path / "i").exists()
    assert "**root.alpha.one**" in (folder / "HIERARCHY.md").read_text() and "issueToken" in (folder / "code-refs.json").read_text()
    with pytest.raises(ValueError, match="search is off"):
        verbs.search(spark, c, tmp_path / "i", "x")
    with pytest.raises(ValueError, match="search is off"):
        verbs.query(spark, tmp_path / "i", "cycles", config=c)
    (folder / "bad.md").write_text("no front matter")
    with pytest.raises(ValueError, match="index failed"):
        verbs.index(spark, c, tmp_path / "i")


def test_without_the_configured_embedder(spark, tmp_path):
    """An index does without vectors, unless it has some already; vector search is refused."""
    write(tmp_path)
    (tmp_path / "lodestone.config.yml").write_text(f"search:\n  embedding: {{provider: local, folder: {tmp_path}/none}}\n")
    c = config.load(tmp_path)
    with pytest.warns(UserWarning, match="full-text search only"):
        built = verbs.index(spark, c, tmp_path / "i")
    assert built.vectors is None and verbs.staleness(spark, c, tmp_path / "i", mode="hybrid") == []
    with pytest.raises(ValueError, match="no model.onnx"):
        verbs.search(spark, c, tmp_path / "i", "x", "vector")
    with pytest.raises(ValueError, match="needs an index with vectors"):
        verbs.search(spark, c, tmp_path / "i", "x", "vector", embedder=HashEmbedder(8))
    assert verbs.index(spark, c, tmp_path / "i", HashEmbedder(8)).full


def test_changes_by_version_control(tmp_path):
    git = repository(tmp_path)
    folder = write(tmp_path, GRAPH)
    assert changes.changed_files(tmp_path, folder, "HEAD") is None
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "a")
    first = changes.head(tmp_path)
    git("mv", "vault/api.md", "vault/api2.md")
    git("commit", "-qm", "b")
    (folder / "guide.md").write_text("x")
    (folder / "new.md").write_text("x")
    (tmp_path / "other.md").write_text("x")
    assert changes.changed_files(tmp_path, folder, first) == ["api.md", "api2.md", "guide.md", "new.md"]
    assert changes.pending(tmp_path, folder, first) == ["changed: api", "changed: api2", "changed: guide", "changed: new"]
    assert changes.pending(tmp_path, folder, "0" * 40) == ["the index is of a commit that is not behind the current one"]
    assert changes.note_ids(["a.md", "HIERARCHY.md", "b.yml"]) == ["a"] and changes.changed_files(tmp_path, folder, "0" * 40) is None


def test_refinements(spark, tmp_path):
    write(tmp_path, {"root": text("root")})
    c = config.load(tmp_path)
    a = verbs.stage(c, " s ", "A title!", "sum", NOW, evidence=[" e ", ""])
    b = verbs.stage(c, "s", "A title", "sum", NOW)
    assert (a["id"], b["id"], a["evidence"]) == ("20260601120000-a-title", "20260601120000-a-title-2", ["e"])
    with pytest.raises(ValueError, match="non-empty title"):
        verbs.stage(c, "s", " ", "sum", NOW)
    verbs.reject(c, b["id"], "because", NOW)
    with pytest.raises(ValueError, match="at least one note"):
        verbs.promote(spark, c, a["id"], [" "], NOW, tmp_path / "i")
    verbs.promote(spark, c, a["id"], ["root"], NOW, tmp_path / "i")
    with pytest.raises(ValueError, match="not found"):
        verbs.reject(c, a["id"], "x", NOW)
    assert [(r.id, r.status) for r in verbs.refinements(spark, c).collect()] == [(a["id"], "promoted"), (b["id"], "rejected")]
    (c.refinements / "staged/zz.yml").write_text("id: yy\nstatus: promoted\nsource: s\ntitle: t\nsummary: u\ncreated_at: a\nupdated_at: b\n")
    errors = verbs.refinement_errors(c)
    assert any('does not match filename "zz"' in e for e in errors) and any("does not match folder" in e for e in errors) and "[yy] promoted refinement is missing promoted_at" in errors


def test_init_and_config(spark, tmp_path):
    verbs.init(tmp_path, NOW.date())
    c = config.load(tmp_path)
    assert verbs.check(spark, c, NOW.date()) == []
    with pytest.raises(FileExistsError):
        verbs.init(tmp_path, NOW.date())
    (tmp_path / "lodestone.config.yml").write_text("search:\n  chunking: {strategy: page}\n")
    with pytest.raises(ValueError, match="search.chunking.strategy"):
        config.load(tmp_path)
    (tmp_path / "x.json").write_text('{"vault": "v", "search": {"defaultLimit": 3, "chunking": {"strategy": "whole-note"}}}')
    got = config.load(tmp_path, "x.json")
    assert (got.vault, got.limit, got.max_chunk_chars, got.mode) == (tmp_path / "v", 3, 2000, "hybrid")


def test_front_matter_types():
    row = reader.note_row("a.md", "---\nid: a\ntitle: 3\nlast_verified: 2026-01-02\nttl_days: x\ntags: [a, 1]\nlayer: core\n---\nbody\n")
    assert row["last_verified"] == "2026-01-02" and row["extra"] == {"layer": "core"} and row["body"] == "body\n"
    assert row["fm_errors"] == ["frontmatter.title must be a string", "frontmatter.ttl_days must be a whole number", "frontmatter.tags must be a list of strings"]
    assert reader.note_row("b.md", "---\n: [\n---\n")["fm_errors"][0].startswith("frontmatter cannot be parsed")
