import json

import pytest
from pyspark.sql import functions as F

from kilnframe.operators import generate, schedule, tasks
from kilnframe.sources import catalog, files

ROOT = {"workspace": {"name": "ws"}, "targets": [{"name": "top", "command": "make", "inputs": ["src/**/*.c"], "outputs": ["out/top"], "deps": ["//lib:core"]}]}
LIB = {"targets": [{"name": "core", "command": "cc", "inputs": [{"kind": "file", "glob": "*.c"}], "outputs": ["core.o"], "tags": ["b", "a"], "env": {"X": 1}}, {"name": "check", "command": "t", "test": True, "deps": [":core"]}]}


def write(root, tree):
    for name, content in tree.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content if isinstance(content, str) else json.dumps(content))


def test_load_merges_and_resolves(spark, tmp_path):
    pytest.importorskip("yaml")
    primary = "workspace:\n  name: ws\ntargets:\n- name: top\n  command: make\n  inputs: ['src/**/*.c']\n  outputs: [out/top]\n  deps: ['//lib:core']\n"
    write(tmp_path, {"kiln.yaml": primary, "lib/kiln.json": LIB, "lib/kiln.gen.json": {"targets": []}, "ignored/kiln.json": "{", ".gitignore": "ignored/\n"})
    c = catalog.load(spark, tmp_path / "lib")
    rows = {r["label"]: r for r in c.targets.collect()}
    assert sorted(rows) == ["//:top", "//lib:check", "//lib:core"]
    core = rows["//lib:core"]
    assert (core["inputs"], core["outputs"], core["cwd"], core["tags"], core["env"], core["cacheable"]) == (["lib/*.c"], ["lib/core.o"], "lib", ["a", "b"], {"X": "1"}, True)
    assert rows["//lib:check"]["deps"] == ["//lib:core"] and not rows["//lib:check"]["cacheable"]
    assert [r["package"] for r in c.packages.collect()] == ["", "lib"]
    assert [(r["label"], r["dir"]) for r in c.prune_dirs.collect()] == [("//:top", "lib")]
    lines = [json.loads(r["json"]) for r in catalog.described(c).collect()]
    assert [x["t"] for x in lines] == ["package.described"] * 2 + ["target.described"] * 3
    assert catalog.load(spark, tmp_path, root_only=True).targets.count() == 1


@pytest.mark.parametrize(
    ("package", "message"),
    [
        ({"workspace": {"name": "x"}}, "belong in"),
        ({"targets": [{"name": "a/b", "command": "c", "outputs": ["o"]}]}, "separator"),
        ({"targets": [{"name": "a", "command": "", "outputs": ["o"]}]}, "empty command"),
        ({"targets": [{"name": "a", "command": "c"}]}, "nothing to cache"),
        ({"targets": [{"name": "a", "command": "c", "outputs": ["o"]}] * 2}, "duplicate"),
        ({"targets": [{"name": "a", "command": "c", "outputs": ["../o"]}]}, "outside"),
        ({"targets": [{"name": "a", "command": "c", "outputs": ["o"], "inputs": ["{a,b}"]}]}, "braces"),
        ({"targets": [{"name": "a", "command": "c", "outputs": ["o"], "inputs": [{"kind": "dir", "glob": "x"}]}]}, "not an input"),
    ],
)
def test_violations(spark, tmp_path, package, message):
    write(tmp_path, {"kiln.json": ROOT, "pkg/kiln.json": package})
    with pytest.raises(catalog.CatalogError, match=message):
        catalog.load(spark, tmp_path)


def test_no_workspace(tmp_path):
    write(tmp_path, {"kiln.json": {"targets": []}})
    with pytest.raises(catalog.CatalogError):
        catalog.find_root(tmp_path)


def test_file_sources(spark, tmp_path):
    write(tmp_path, {"ac/good.json": {"cache_key": "k", "exit_code": 0, "outputs": [{"path": "o", "content_hash": "h", "size": 1}]}, "ac/bad.json": "not json", "f/a.txt": "A", "f/d/b.txt": "B"})
    good, bad = files.read_entries(spark, str(tmp_path / "ac"))
    assert [(r["cache_key"], r["outputs"][0]["path"]) for r in good.collect()] == [("k", "o")] and bad.count() == 1
    assert sorted((r["path"], r["size"]) for r in files.scan_files(spark, str(tmp_path / "f")).collect()) == [("a.txt", 1), ("d/b.txt", 1)]
    lines = spark.createDataFrame([('{"t":"target.log","id":"a","line":"x"}',), ("",), ("{",), ('{"no":"tag"}',)], "value string")
    events = files.parse_lines(lines)
    assert [r["line"] for r in events.collect()] == ["x"]
    assert files.to_lines(events).first()["value"] == '{"t":"target.log","id":"a","line":"x"}'
    commands = files.read_commands(spark.createDataFrame([('{"c":"build","command_id":"1","targets":["//a:b"]}',), ('{"c":"shutdown"}',)], "value string"))
    assert sorted((r["c"], r["targets"], r["fresh"]) for r in commands.collect()) == [("build", ["//a:b"], False), ("shutdown", [], False)]
    replies = files.parse_lines(spark.createDataFrame([('{"t":"command.rejected","command_id":"1","reason":"busy"}',)], "value string"))
    assert [tuple(r) for r in files.correlate(commands, replies).collect()] == [("1", "build", "command.rejected", "busy")]
    where = str(tmp_path / "failed")
    assert files.read_last_failures(spark, where).collect() == []
    files.write_last_failures(spark.createDataFrame([("//a:b",)], "id string"), where)
    files.write_last_failures(spark.createDataFrame([("//c:d",)], "id string"), where)
    assert [r["id"] for r in files.read_last_failures(spark, where).collect()] == ["//c:d"]


def test_generators(spark):
    def make(ws):
        for n in ("b", "a"):
            ws.target(n, "make", package="//gen/", outputs=[f"{n}.txt"], inputs=["../x"] if n == "zz" else [])
        ws.target("use", "cat", package="app", inputs=["//gen/*.txt"], outputs=["u"])

    emitted = generate.run_generators(spark, {"one": make})
    resolved = generate.resolve_emitted(emitted)
    outputs, inputs = (resolved.select("label", F.explode(c).alias(n)) for c, n in (("outputs", "path"), ("inputs", "glob")))
    links = generate.infer_links(outputs, inputs)
    assert sorted((r["label"], r["dep"]) for r in links.collect()) == [("//app:use", "//gen:a"), ("//app:use", "//gen:b")]
    assert {r["label"]: (r["deps"], r["rewritten"]) for r in generate.linked(resolved, links).collect()}["//app:use"] == (["//gen:a", "//gen:b"], True)
    assert [[t["name"] for t in r["targets"]] for r in generate.package_files(emitted).where("package = 'gen'").collect()] == [["a", "b"]]
    assert [r["package"] for r in generate.stale_files(spark.createDataFrame([("gen",), ("old",)], "package string"), emitted).collect()] == ["old"]
    with pytest.raises(ValueError, match="duplicate"):
        generate.run_generators(spark, {"one": make, "two": make})


A = tasks.Arg


@pytest.mark.parametrize(
    ("args", "given", "want"),
    [
        ([A("x"), A("y", default="d")], {"positionals": ["1"]}, ({"x": "1", "y": "d"}, [])),
        ([A("x"), A("rest", variadic=True)], {"positionals": ["1", "2", "3"], "passthrough": ["4"]}, ({"x": "1"}, ["2", "3", "4"])),
        ([], {"positionals": ["a", "b"], "passthrough": ["c"]}, ({}, ["a", "b", "c"])),
        ([A("x", choices=("p", "q"))], {"named": ["x=q"]}, ({"x": "q"}, [])),
        ([A("x")], {}, None),
        ([A("x")], {"positionals": ["1", "2"]}, None),
        ([A("x")], {"positionals": ["1"], "named": ["x=2"]}, None),
        ([A("x", choices=("p",))], {"positionals": ["z"]}, None),
        ([A("x")], {"named": ["y=1"]}, None),
        ([A("x")], {"named": ["x"]}, None),
    ],
)
def test_argument_binding(args, given, want):
    if want is None:
        with pytest.raises(tasks.ArgumentError):
            tasks.bind(args, **given)
    else:
        assert tasks.bind(args, **given) == want


def test_task_tables(spark):
    known = spark.createDataFrame([("a", "run"), ("a/b", "run"), ("c", "only")], "package string, name string")
    asked = spark.createDataFrame([("run", "a/b/x"), ("run", "a"), ("run", "z"), ("only", "z"), ("gone", ""), ("//a:run", ""), ("//q:run", "")], "reference string, cwd string")
    got = {(r["reference"], r["cwd"]): (r["label"], r["problem"]) for r in tasks.resolve(asked, known).collect()}
    assert got == {
        ("run", "a/b/x"): ("//a/b:run", None), ("run", "a"): ("//a:run", None), ("run", "z"): (None, "ambiguous"), ("only", "z"): ("//c:only", None), ("gone", ""): (None, "unknown"),
        ("//a:run", ""): ("//a:run", None), ("//q:run", ""): (None, "unknown"),
    }
    t = spark.createDataFrame([("//:a", "a", "x"), ("//:9", "9", "x"), ("//:n", "n", None), ("//:d", "d", None)], "label string, name string, command string")
    s = spark.createDataFrame([("//:s", "s", "run"), ("//:r", "r", "")], "label string, name string, command string")
    refs = spark.createDataFrame([("//:d", "services", 0, "//:s"), ("//:a", "needs", 0, "//:zz"), ("//:a", "needs", 1, "//:a"), ("//:s", "service_needs", 0, "//:r"), ("//:a", "finally", 0, "//:d"), ("//:a", "deps", 0, "//x:y")], "label string, kind string, pos int, ref string")
    assert {tuple(r) for r in tasks.violations(t, s, refs).collect()} == {("task name", "//:9"), ("does nothing", "//:n"), ("empty command", "//:r"), ("unknown task", "//:a -> //:zz"), ("needs itself", "//:a")}
    assert {r["label"]: r["level"] for r in tasks.start_levels(s, refs.where("kind = 'service_needs'")).collect()} == {"//:r": 0, "//:s": 1}
    assert [(r["kind"], r["ref"]) for r in tasks.run_order(refs, "//:a").collect()] == [("deps", "//x:y"), ("needs", "//:zz"), ("needs", "//:a"), ("command", "//:a"), ("finally", "//:d")]
    named = spark.createDataFrame([("//:b", "second"), ("//:a", None)], "label string, description string")
    assert [r["text"].strip() for r in tasks.listing(named, "text").collect()] == ["//:a", "//:b" + " " * 36 + "second"]
    assert tasks.listing(named, "json").count() == 2 and [r["text"] for r in tasks.listing(named).collect()] == ["//:a", "//:b"]


def test_scheduler(spark, tmp_path):
    def boom(session, frames):
        raise RuntimeError("boom")

    numbers = spark.range(5)
    make = lambda sql="SELECT id FROM {src}": [
        schedule.Target("base", sql, inputs={"src": numbers}),
        schedule.Target("sum", "SELECT sum(id) AS s FROM {up}", deps={"up": "base"}),
        schedule.Target("bad", boom, deps={"up": "base"}),
        schedule.Target("late", "SELECT * FROM {b}", deps={"b": "bad"}),
        schedule.Target("ext", boom, exists=lambda: True),
    ]
    s = schedule.Scheduler(spark, str(tmp_path))
    first = s.build(make())
    assert {k: r.result for k, r in first.items()} == {"base": "built", "sum": "built", "bad": "failed", "late": "skipped", "ext": "external_cache_hit"}
    assert "bad" in first["late"].error and schedule.summary(first) == {"built": 2, "cache_hit": 1, "failed": 1, "skipped": 1, "ok": False}
    assert {k: r.result for k, r in s.build(make(), ["sum"]).items()} == {"base": "cache_hit", "sum": "cache_hit"}
    # another recipe with the same rows: base runs again, and what follows from its outputs does not
    third = s.build(make("SELECT id FROM {src} WHERE id >= 0"), ["sum"])
    assert {k: r.result for k, r in third.items()} == {"base": "built", "sum": "cache_hit"}
    assert s.build(make(), ["sum"], fresh=True)["sum"].result == "built"
    assert s.read(first["sum"].key).first()["s"] == 10
    with pytest.raises(ValueError, match="cycle"):
        s.build([schedule.Target("a", "SELECT 1", deps={"x": "b"}), schedule.Target("b", "SELECT 1", deps={"x": "a"})])


def test_rows_hash_ignores_partitions(spark):
    df = spark.range(100).withColumn("x", F.when(F.col("id") % 3 == 0, F.col("id")))
    assert schedule.rows_hash(df.repartition(7)) == schedule.rows_hash(df.coalesce(1)) != schedule.rows_hash(df.union(df.limit(1)))


def test_links_are_distinct_before_they_are_made(spark):
    """Consumers of equal inputs are matched once; no pair is shuffled or compared after the last join."""
    outputs = spark.createDataFrame([("//p:a", "g/a.c"), ("//p:a", "g/a.h"), ("//p:b", "g/b.c"), ("//c:0", "g/own.c")], "label string, path string")
    inputs = spark.createDataFrame([(f"//c:{i}", g) for i in range(3) for g in ("g/*", "g/a.c", "g/*.c")] + [("//c:0", "g/*")], "label string, glob string")
    links = generate.infer_links(outputs, inputs)
    want = [(f"//c:{i}", p) for i in range(3) for p in ("//p:a", "//p:b", "//c:0") if p != f"//c:{i}"]
    assert sorted(map(tuple, links.collect())) == sorted(want)
    plan = links._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Aggregate" in line for line in plan[: next(i for i, line in enumerate(plan) if "Join" in line)])
