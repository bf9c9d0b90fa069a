import random

import pytest

from kilnframe.operators import graph, selection
from kilnframe.operators.selection import TestMode

DIAMOND = [("app", "libA"), ("app", "libB"), ("libA", "base"), ("libB", "base")]


def edges_frame(spark, edges):
    return spark.createDataFrame(edges, "parent string, dep string")


def nodes_frame(spark, edges, extra=()):
    return spark.createDataFrame([(n,) for n in sorted({x for e in edges for x in e} | set(extra))], "label string")


def random_dag(seed, n=40, m=80):
    rng = random.Random(seed)
    pairs = [rng.sample(range(n), 2) for _ in range(m)]
    return sorted({(f"n{max(p):02}", f"n{min(p):02}") for p in pairs})


@pytest.mark.parametrize("seed", range(3))
def test_closures_and_levels_on_random_dags(spark, seed):
    edges = random_dag(seed)
    deps = {}
    for a, b in edges:
        deps.setdefault(a, set()).add(b)

    def depth(seeds, step):
        out, level, new = {}, 0, set(seeds)
        while new:
            out |= {x: level for x in new}
            new, level = {y for x in new for y in step(x)} - set(out), level + 1
        return out

    seeds = ["n30", "n35"]
    df, s = edges_frame(spark, edges), spark.createDataFrame([(x,) for x in seeds], "label string")
    assert {r["label"]: r["depth"] for r in graph.closure(s, df).collect()} == depth(seeds, lambda x: deps.get(x, ()))
    up = lambda x: {a for a, b in edges if b == x}
    assert {r["label"]: r["depth"] for r in graph.closure(s, df, downstream=True).collect()} == depth(seeds, up)

    def level(x):
        return 1 + max((level(y) for y in deps.get(x, ())), default=-1)

    nodes = nodes_frame(spark, edges, ["alone"])
    assert {r["label"]: r["level"] for r in graph.levels(nodes, df).collect()} == {r["label"]: level(r["label"]) for r in nodes.collect()}
    order = [r["label"] for r in graph.topological_order(nodes, df).collect()]
    assert all(order.index(b) < order.index(a) for a, b in edges)


def test_cycles_are_named(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "b")]
    with pytest.raises(graph.CycleError, match="through a|through b"):
        graph.levels(nodes_frame(spark, edges), edges_frame(spark, edges))


def test_validation(spark):
    targets = spark.createDataFrame([("a",), ("a",), ("b",)], "label string")
    outputs = spark.createDataFrame([("a", "o"), ("b", "o"), ("b", "p")], "label string, path string")
    got = {tuple(r) for r in graph.validate(targets, edges_frame(spark, [("a", "zz"), ("a", "b")]), outputs).collect()}
    assert got == {("duplicate label", "a"), ("unknown dependency", "a -> zz"), ("output collision", "o")}


def test_tree_marks_repeats(spark):
    rows = [tuple(r) for r in graph.tree(edges_frame(spark, DIAMOND), "app", 5).orderBy("pos").collect()]
    assert rows == [(0, 0, "app", False), (1, 1, "libA", False), (2, 2, "base", False), (3, 1, "libB", False), (4, 2, "base", True)]
    assert len(graph.tree(edges_frame(spark, DIAMOND), "app", 1).collect()) == 3


def test_renderings(spark):
    df, nodes = edges_frame(spark, DIAMOND), nodes_frame(spark, DIAMOND)
    dot = [r["text"] for r in graph.to_dot(df, nodes).orderBy("line").collect()]
    assert dot[0] == "digraph deps {" and dot[-1] == "}" and dot[1] == '  "app";' and '  "app" -> "libA";' in dot
    mermaid = [r["text"] for r in graph.to_mermaid(df, nodes).orderBy("line").collect()]
    assert mermaid[:2] == ["graph TD", '  n0["app"]'] and "  n0 --> n2" in mermaid
    assert graph.to_json(df, nodes).first()["json"].startswith('{"nodes":["app","base","libA","libB"],"edges":[{"from":"app"')


def catalog(spark):
    rows = [("//go/bin:server", [], False), ("//go/bin:client", ["release"], False), ("//go/lib:util", [], False), ("//go/test:auth", ["flaky"], True), ("//docker:api", ["release", "flaky"], False), ("//svc:db-migrate", ["manual"], False)]
    return spark.createDataFrame(rows, "label string, tags array<string>, test boolean")


@pytest.mark.parametrize(
    ("patterns", "options", "want"),
    [
        ([], {}, ["//docker:api", "//go/bin:client", "//go/bin:server", "//go/lib:util"]),
        (["//..."], {"mode": TestMode.ONLY}, ["//go/test:auth"]),
        (["//go/..."], {"mode": TestMode.INCLUDE}, ["//go/bin:client", "//go/bin:server", "//go/lib:util", "//go/test:auth"]),
        (["//go/bin:*"], {}, ["//go/bin:client", "//go/bin:server"]),
        (["//go/*:util"], {}, ["//go/lib:util"]),
        (["//*:api"], {}, ["//docker:api"]),
        (["//go:*"], {}, []),
        (["//svc:*"], {}, []),
        (["//svc:db-migrate"], {}, ["//svc:db-migrate"]),
        (["!//go/..."], {}, ["//docker:api"]),
        (["//go/...", "//docker:api", "!//go/bin:server"], {}, ["//docker:api", "//go/bin:client", "//go/lib:util"]),
        ([], {"tags": ["release"], "no_tags": ["flaky"]}, ["//go/bin:client"]),
    ],
)
def test_selection(spark, patterns, options, want):
    assert [r["label"] for r in selection.select(catalog(spark), patterns, **options).collect()] == want


def test_misses(spark):
    with pytest.raises(selection.NoMatchError, match="did you mean //go/bin:server"):
        selection.select(catalog(spark), ["//go/bin:srvr"])
    with pytest.raises(selection.NoMatchError, match="zzz'$"):
        selection.select(catalog(spark), ["//nowhere/to/be/found/zzz"])
    assert selection.suggest(catalog(spark), "//completely/else").collect() == []


def test_affected(spark):
    inputs = spark.createDataFrame([("a", "src/**/*.go"), ("c", "lit.txt"), ("d", "*.md"), ("e", "src/[x-z]*")], "label string, glob string")
    edges = edges_frame(spark, [("b", "a"), ("top", "b"), ("other", "d")])
    hit = lambda *p: sorted(r["label"] for r in selection.affected(spark.createDataFrame([(x,) for x in p], "path string"), inputs, edges).collect())
    assert hit("src/main.go") == ["a", "b", "top"]
    assert hit("lit.txt") == ["c"]
    assert hit("docs/x.md") == ["d", "other"]  # here a star crosses folders
    assert hit("src/yes", "lit.txt") == ["c", "e"]
    assert hit("nothing") == []


def test_relevance(spark):
    batches = spark.createDataFrame([(1, "internal/a.go"), (2, "docs/x")], "batch int, path string")
    hit = spark.createDataFrame([(1, "lib"), (1, "bin")], "batch int, label string")
    none = spark.createDataFrame([], "label string")
    bins = spark.createDataFrame([("bin",)], "label string")
    got = lambda globs, wanted: sorted(r["batch"] for r in selection.relevant_batches(batches, globs, hit, wanted).collect())
    assert (got([], none), got([], bins), got(["docs/*"], none), got(["docs/*"], bins)) == ([1, 2], [1], [2], [1, 2])


def test_tree_without_a_depth_is_whole(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(7)], "parent string, dep string")
    assert [(r["depth"], r["label"]) for r in graph.tree(chain, "n0").orderBy("pos").collect()] == [(i, f"n{i}") for i in range(8)]
