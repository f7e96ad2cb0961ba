import pytest
from vault import write

from lodestone.model import TABLES, Vault
from lodestone.operators import graph
from lodestone.plans import verbs
from lodestone.sources import config


@pytest.fixture(scope="module")
def v(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("graph")
    write(root)
    return verbs.index(spark, config.load(root), root / "index").vault


def ids(df):
    return [r[0] for r in df.collect()]


def test_links(v):
    assert [(r.id, r.anchor) for r in graph.backlinks(v, "api").collect()] == [("guide", "tokens"), ("impl", None)]
    assert ids(graph.backlinks(v, "api", 1)) == ["guide"]
    assert [(r.id, r.anchor) for r in graph.forward_links(v, "guide").collect()] == [("api", "tokens"), ("root.alpha", None)]


def test_hierarchy(v):
    assert [(r.id, r.depth) for r in graph.descendants(v, "root").collect()] == [("root.alpha", 1), ("root.alpha.one", 2)]
    assert ids(graph.descendants(v, "root", 1)) == ["root.alpha"] and ids(graph.descendants(v, "nothing")) == []
    assert [(r.id, r.depth) for r in graph.ancestors(v, "root.alpha.one").collect()] == [("root.alpha", 1), ("root", 2)]
    assert ids(graph.ancestors(v, "root.alpha.one", 1)) == ["root.alpha"] and ids(graph.ancestors(v, "api")) == []


def test_orphans_related_impact(v):
    assert ids(graph.orphans(v)) == ["lonely"]
    assert [(r.id, r.shared_tags, r.common_backlinks) for r in graph.related(v, "api").collect()] == [("impl", ["code", "docs"], 0), ("guide", ["docs"], 0), ("root.alpha", [], 1)]
    assert ids(graph.related(v, "api", 2)) == ["impl", "guide"]
    assert [(r.note_id, r.symbol, r.kind) for r in graph.code_impact(v, "src/service.ts").collect()] == [("api", "issueToken", "function"), ("api", "revokeToken", "function"), ("impl", "issueToken", "function")]
    assert ids(graph.code_impact(v, symbol="revokeToken")) == ["api"]


def test_cycles(v):
    assert [r.path for r in graph.cycles(v).collect()] == [["c1", "c2", "c3", "c1"], ["loop", "loop"]]
    assert len(graph.cycles(v, 1).collect()) == 1


def brute_cycles(edges):
    colour, path, found = {}, [], {}

    def visit(x):
        colour[x] = 1
        path.append(x)
        for y in sorted(edges.get(x, [])):
            if colour.get(y) == 1:
                c = path[path.index(y) :]
                best = min((c[i:] + c[:i] for i in range(len(c))), key=" ".join)
                found.setdefault(tuple(best), [*best, best[0]])
            elif y not in colour:
                visit(y)
        path.pop()
        colour[x] = 2

    for x in sorted(edges):
        if x not in colour:
            visit(x)
    return sorted(found.values(), key="".join)


def test_cycles_of_random_graphs():
    import random

    for seed in range(50):
        r = random.Random(seed)
        edges = {}
        for _ in range(r.randrange(1, 25)):
            edges.setdefault(f"n{r.randrange(8)}", []).append(f"n{r.randrange(8)}")
        assert graph.find_cycles(edges) == brute_cycles(edges)
    deep = {f"n{i:05d}": [f"n{i + 1:05d}"] for i in range(5000)} | {"n05000": ["n00000"]}
    assert len(graph.find_cycles(deep)[0]) == 5002


def test_dispatch(v):
    for bad in ({"limit": 0}, {"limit": True}):
        with pytest.raises(ValueError, match="positive integer"):
            graph.run_graph(v, "backlinks", "api", **bad)
    with pytest.raises(ValueError, match="positive integer"):
        graph.run_graph(v, "descendants", "root", depth_limit=-1)
    for args in (("backlinks",), ("impact",), ("other",)):
        with pytest.raises(ValueError):
            graph.run_graph(v, *args)
    assert ids(graph.run_graph(v, "orphans")) == ["lonely"]


def test_trimming_keeps_the_cycles(spark):
    import random

    for seed in range(4):
        r = random.Random(seed)
        pairs = sorted({(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(45)})
        want: dict = {}
        for a, b in pairs:
            want.setdefault(a, []).append(b)
        v = Vault(**({name: None for name in TABLES} | {"links_to": spark.createDataFrame(pairs, "source string, target string")}))
        assert [row.path for row in graph.cycles(v).collect()] == graph.find_cycles(want)
        assert graph.trimmed(v.links_to).count() < len(pairs)


def test_cycles_part_by_part(spark):
    """Parts of the graph go through tasks one by one, and give what a search of the whole does."""
    import random

    import pyarrow as pa

    r = random.Random(5)
    pairs = sorted({(f"g{g}.{r.randrange(7)}", f"g{g}.{r.randrange(7)}") for g in range(40) for _ in range(9)})
    want: dict = {}
    for a, b in pairs:
        want.setdefault(a, []).append(b)
    v = Vault(**({name: None for name in TABLES} | {"links_to": spark.createDataFrame(pairs, "source string, target string").repartition(3)}))
    got = graph.cycles(v).collect()
    assert [row.path for row in got] == graph.find_cycles(want)
    assert [row.pos for row in got] == list(range(len(got)))
    rows = pa.RecordBatch.from_pylist([{"root": x, "source": x, "target": x} for x in ("a", "b", "c")])
    assert [b.num_rows for b in graph._cycles_of(iter([rows]), at_once=1)] == [1, 1, 1]
    none = Vault(**({name: None for name in TABLES} | {"links_to": spark.createDataFrame([("a", "b")], "source string, target string")}))
    assert graph.cycles(none).collect() == []
