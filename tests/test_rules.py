import pytest

from kilnframe.operators import graph, selection
from kilnframe.plans import scratch


@pytest.mark.parametrize(
    ("edges", "members"),
    [
        ([("a", "b"), ("b", "c"), ("c", "b")], {"b", "c"}),
        ([("a", "a")], {"a"}),
        ([("z", "y"), ("y", "z"), ("m", "z"), ("y", "n")], {"y", "z"}),
        ([("p", "q"), ("q", "p"), ("q", "a"), ("a", "r"), ("r", "s"), ("s", "r")], {"p", "q", "r", "s"}),
    ],
)
def test_a_cycle_is_named_by_a_member(spark, edges, members):
    """a needs b, b and c need each other: a is in no cycle."""
    df = spark.createDataFrame(edges, "parent string, dep string")
    nodes = df.select(df["parent"].alias("label")).union(df.select("dep")).distinct()
    with pytest.raises(graph.CycleError) as e:
        graph.levels(nodes, df)
    assert str(e.value).removeprefix("dependency cycle through ") in members


def test_changed_files_need_a_base_or_names(spark):
    named = spark.createDataFrame([("/w/s/a.txt",), ("b.txt",), ("/w/sx/c",)], "path string")
    since = spark.createDataFrame([("d",), ("d",)], "path string")
    paths = lambda df: sorted(r["path"] for r in df.collect())
    assert paths(selection.resolve_changed_files("/w/s", named, since)) == ["/w/sx/c", "a.txt", "b.txt"]
    assert paths(selection.resolve_changed_files("/w/s/", since=since)) == ["d"]
    assert paths(selection.resolve_changed_files("/w/s", named.limit(0), since)) == []
    with pytest.raises(ValueError, match="base"):
        selection.resolve_changed_files("/w/s")


def test_no_scratch_on_one_machine_of_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Empty:
        def isEmpty(self):  # noqa: N802
            return True

    class Context:
        master = "spark://host:7077"
        _jsc = property(lambda self: self)

        def sc(self):
            return self

        def getCheckpointDir(self):  # noqa: N802
            return Empty()

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.checkpoint_dir(Session())
