import http.server
import json
import threading

import pytest
from vault import text, write

from lodestone.cli import main
from lodestone.operators import embedders


@pytest.fixture
def run(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)

    def go(*args):
        capsys.readouterr()
        code = main(args, lambda: spark)
        said = capsys.readouterr()
        return code, said.out, said.err

    return go


def test_verbs(run, tmp_path):
    code, out, _ = run("init", "--owner", "me")
    assert code == 0 and "owner: me" in (tmp_path / "vault/root.md").read_text()
    assert run("init")[0] == 1
    assert run()[:2] == (0, "ok (3 notes)\n") and json.loads(run("check", "--json")[1]) == {"errors": [], "noteCount": 3}
    code, out, err = run("search", "words", "--mode", "fts")
    assert code == 1 and "no index" in err
    code, out, err = run("index")
    assert code == 0 and out.startswith("full (full-text only): 3 indexed, 0 removed, 3 notes") and "full-text search only" in err
    assert json.loads(run("search-index", "--json")[1])["mode"] == "incremental"
    code, out, _ = run("search", "subject", "--mode", "fts", "--limit", "5")
    lines = out.splitlines()
    assert code == 0 and lines[0].split("\t")[1:] == ["meta.conventions", "Conventions", "Conventions"] and lines[-1].startswith('1 hit(s) for "subject" (fts)')
    hits = json.loads(run("search", "subject", "--mode", "fts", "--json")[1])
    assert hits["mode"] == "fts" and [h["note_id"] for h in hits["hits"]] == ["meta.conventions"] and not hits["stale"]
    code, out, err = run("search", "x", "--mode", "vector")
    assert code == 1 and "model.onnx" in err
    assert run("graph", "links", "root")[1].splitlines() == ['{"id": "meta", "title": "Meta", "anchor": null, "status": "active"}', "1 result(s)"]
    assert json.loads(run("graph", "descendants", "meta", "--depth", "1", "--json")[1])["hits"][0]["id"] == "meta.conventions"
    assert run("graph", "backlinks")[0] == 1 and run("graph", "impact")[0] == 1 and run("graph", "cycles", "--limit", "0")[0] == 1
    (tmp_path / "vault/meta.md").unlink()
    code, out, err = run("check")
    assert code == 1 and "problem(s)" in err and "meta" in err
    assert run("nonsense")[0] == 1 and run("--version")[0] == 0 and run("help", "search")[0] == 0


def test_refine(run, tmp_path, monkeypatch):
    write(tmp_path, {"root": text("root", last_verified="2100-01-01")})
    import io

    monkeypatch.setattr("sys.stdin", io.StringIO("from a pipe"))
    code, out, _ = run("refine", "stage", "--source", "s", "--title", "One", "--stdin")
    one = out.split()[1]
    assert code == 0 and one.endswith("-one")
    two = json.loads(run("refine", "stage", "--source", "s", "--title", "Two", "--summary", "x", "--json")[1])["id"]
    assert run("refine", "stage", "--source", "s", "--title", "Two")[0] == 1
    assert run("refine", "list", "--status", "staged")[1].splitlines() == [f"- {one} [staged] One", f"- {two} [staged] Two"]
    assert run("refine", "reject", two, "--reason", "old")[1] == f"rejected {two}\n"
    assert run("refine", "promote", one, "--note", "root")[1] == f"promoted {one} and wrote HIERARCHY.md\n"
    assert run("refine", "list", "--status", "staged")[1] == "no records\n" and run("refine", "reject", one, "--reason", "x")[0] == 1


def test_hosted_embedder(spark, tmp_path, monkeypatch):
    seen = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["content-length"])))["requests"]
            seen.append((self.path, self.headers["x-goog-api-key"], [a["embedContentConfig"]["taskType"] for a in asked]))
            body = json.dumps({"embeddings": [{"values": [float(len(a["content"]["parts"][0]["text"])), 1.0]} for a in asked]}).encode()
            self.send_response(200)
            self.send_header("content-length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    block = {"provider": "gemini", "apiKeyEnv": "SOME_KEY", "endpoint": f"http://127.0.0.1:{server.server_port}/v"}
    monkeypatch.delenv("GEMINI_API_KEY", raising=False)
    with pytest.raises(embedders.Unavailable, match="SOME_KEY"):
        embedders.create(block)
    monkeypatch.setenv("SOME_KEY", "k")
    e = embedders.create(block)
    e.batch = 2
    assert e.embed_documents(["a", "bb", "ccc"]) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]] and e.embed_query("dddd") == [4.0, 1.0]
    assert [s[2] for s in seen] == [["RETRIEVAL_DOCUMENT"] * 2, ["RETRIEVAL_DOCUMENT"], ["RETRIEVAL_QUERY"]] and seen[0][1] == "k" and seen[0][0].endswith("/models/gemini-embedding-001:batchEmbedContents")
    assert (e.id, e.dimensions) == embedders.described(block) == ("gemini:gemini-embedding-001", 3072) and "k" not in repr(e).split("key")[-1][:3]
    server.shutdown()


def test_local_embedder_names(tmp_path):
    assert embedders.described({"provider": "local"})[1] == 512
    with pytest.raises(embedders.Unavailable):
        embedders.create({"provider": "local", "folder": str(tmp_path)})
    with pytest.raises(ValueError, match="dimensions"):
        embedders.create({"provider": "local", "model": "other"})
    for f in ("model.onnx", "tokenizer.json"):
        (tmp_path / f).write_text("not a model")
    e = embedders.create({"provider": "local", "folder": str(tmp_path), "model": "other", "dimensions": 4})
    with pytest.raises(embedders.Unavailable, match="can't be loaded"):
        e.embed_query("x")
    assert embedders.unit([3.0, 4.0, 9.0], 2) == [0.6, 0.8] and embedders.unit([0.0, 0.0, 1.0], 2) == [0.0, 0.0]
