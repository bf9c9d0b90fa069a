import datetime as dt
import json

from pyspark.sql import functions as F

from kilnframe.operators import events
from kilnframe.streaming import debounce as streams


def feed(spark, folder, schema, batches, make, mode, name):
    """Runs a stream over files of rows, one batch a file, and gives what it wrote."""
    folder.mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    query = make(source).writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        for i, rows in enumerate(batches):
            (folder / f"{i:03}.json").write_text("\n".join(map(json.dumps, rows)))
            query.processAllAvailable()
        return spark.table(name).collect()
    finally:
        query.stop()


def test_debounce_stream_equals_the_batch_fold(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    at = lambda ms: (t0 + dt.timedelta(milliseconds=ms)).isoformat()
    first = [{"key": "a", "ts": at(ms), "path": f"p{ms % 3}"} for ms in (0, 50, 120, 200, 290, 380, 470, 560)] + [{"key": "b", "ts": at(10), "path": "q"}]
    second = [{"key": "a", "ts": at(ms), "path": "r"} for ms in (900, 950)]
    closing = [{"key": "z", "ts": at(60_000), "path": "end"}]
    schema = "key string, ts timestamp, path string"
    rows = feed(spark, tmp_path / "in", schema, [first, second, closing, closing], lambda s: streams.debounce_stream(s, "key", "ts", "path"), "append", "debounced")
    whole = spark.createDataFrame([(r["key"], dt.datetime.fromisoformat(r["ts"]), r["path"]) for r in first + second], schema)
    want = events.debounce(whole, ["key"], "ts", "path", 100_000, 500_000).collect()
    pick = lambda r: (r["key"], r["batch"], r["first_us"], r["last_us"], r["flushed_us"], tuple(r["paths"]))
    assert sorted(map(pick, (r for r in rows if r["key"] != "z"))) == sorted(map(pick, want))


def test_latest_state_and_ring(spark, tmp_path):
    log = [[{"id": "a", "seq": i, "line": f"l{i}"} for i in range(3)], [{"id": "a", "seq": 3, "line": "l3"}, {"id": "b", "seq": 4, "line": "m"}]]
    schema = "id string, seq long, line string"
    rows = feed(spark, tmp_path / "one", schema, log, lambda s: streams.latest_state_stream(s, ["id"]), "complete", "latest")
    assert sorted((r["id"], r["line"]) for r in rows) == [("a", "l3"), ("b", "m")]
    rows = feed(spark, tmp_path / "two", schema, log, lambda s: streams.log_ring_stream(s, "id", size=2), "update", "ring")
    assert ("a", ["l2", "l3"], 2) in [(r["key"], list(r["lines"]), r["dropped"]) for r in rows]


def test_changed_only(spark, tmp_path):
    rows = [[{"k": "x", "n": 1, "v": "s1"}, {"k": "x", "n": 2, "v": "s1"}], [{"k": "x", "n": 3, "v": "s1"}, {"k": "x", "n": 4}, {"k": "x", "n": 5, "v": "s1"}, {"k": "x", "n": 6, "v": "s2"}]]
    got = feed(spark, tmp_path / "in", "k string, n long, v string", rows, lambda s: streams.changed_only_stream(s, "k", "n", "v"), "append", "changed")
    assert sorted(r["at"] for r in got) == [1, 5, 6]


def test_commands_and_reloads(spark, tmp_path):
    lines = [[{"value": '{"c":"build","targets":["//a:b"]}'}, {"value": "junk"}, {"value": ""}]]
    got = feed(spark, tmp_path / "in", "value string", lines, streams.command_stream, "append", "commands")
    assert [(r["c"], r["targets"]) for r in got] == [("build", ["//a:b"])]
    paths = spark.createDataFrame([("a/kiln.yaml",), ("a/kiln.yml",), ("kiln.gen.json",), ("kiln.json",)], "path string")
    assert sorted(r["path"] for r in streams.config_changes(paths).collect()) == ["a/kiln.yaml", "kiln.json"]


def test_subscription_speaks_on_change(spark):
    inputs = spark.createDataFrame([("a", "src/*"), ("b", "docs/*")], "label string, glob string")
    edges = spark.createDataFrame([("top", "a")], "parent string, dep string")
    said = []
    each = streams.affected_subscription(inputs, edges, None, lambda n, df: said.append((n, [r["label"] for r in df.collect()])))
    for n, paths in enumerate([["src/x"], ["src/y"], ["docs/z"], ["src/x"]]):
        each(spark.createDataFrame([(paths,)], "paths array<string>"), n)
    assert said == [(0, ["a", "top"]), (2, ["b"]), (3, ["a", "top"])]


def test_upload_writes_blobs_first(spark, tmp_path):
    stored = spark.createDataFrame([("h1",)], "hash string")
    batch = spark.createDataFrame([("k", [("h1", 1), ("h2", 2)])], "cache_key string, refs array<struct<hash: string, size: long>>")
    sink = streams.upload_sink(str(tmp_path / "b"), str(tmp_path / "e"), lambda: stored)
    for number in (0, 0):  # a replayed batch adds nothing
        sink(batch, number)
    assert [r["hash"] for r in spark.read.parquet(str(tmp_path / "b")).collect()] == ["h2"]
    assert [r["cache_key"] for r in spark.read.parquet(str(tmp_path / "e")).collect()] == ["k"]
    sink(batch, 1)
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2
