"""The dependency graph as an edge table ``(parent, dep)``: parent needs dep.

Closures and levels are semi-naive loops: each round joins the last round's new rows alone with the edges, and its
result is checkpointed, so plans stay short. The driver keeps counts, never rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import cut


#: Rounds after which a loop's results so far are written as one table, so that its plan stays short.
MERGE_EVERY = 16


class CycleError(ValueError):
    """A dependency cycle; the message names a member of it."""


def edges_of(target_deps: DataFrame) -> DataFrame:
    """Distinct (parent, dep) from (label, dep)."""
    return target_deps.select(F.col("label").alias("parent"), "dep").distinct()


def unknown_deps(edges: DataFrame, targets: DataFrame) -> DataFrame:
    return edges.join(targets.select(F.col("label").alias("dep")), "dep", "left_anti").select("parent", "dep")


def duplicate_labels(targets: DataFrame) -> DataFrame:
    return targets.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def output_collisions(target_outputs: DataFrame) -> DataFrame:
    """Declared output paths of more than one target, with their targets in order."""
    owners = F.array_sort(F.collect_set("label"))
    return target_outputs.groupBy("path").agg(owners.alias("labels")).where(F.size("labels") > 1)


def direct_deps(edges: DataFrame, label: str) -> DataFrame:
    return edges.where(F.col("parent") == label).select(F.col("dep").alias("label")).distinct().orderBy("label")


def direct_dependents(edges: DataFrame, label: str) -> DataFrame:
    return edges.where(F.col("dep") == label).select(F.col("parent").alias("label")).distinct().orderBy("label")


def closure(seeds: DataFrame, edges: DataFrame, downstream: bool = False) -> DataFrame:
    """label, depth (fewest steps from a seed) of all that seeds need, or with downstream all that needs them.

    Edges are dealt by the side that rounds start from once, and stay so; a round moves its new labels alone.
    """
    source, target = ("dep", "parent") if downstream else ("parent", "dep")
    steps = cut(edges.select(F.col(source).alias("_at"), F.col(target).alias("_to")).distinct().repartition("_at"))
    new = cut(seeds.select("label").distinct().withColumn("depth", F.lit(0)))
    seen, depth = new, 0
    while not new.isEmpty():
        depth += 1
        reached = new.join(steps, new["label"] == steps["_at"]).select(F.col("_to").alias("label")).distinct()
        new = cut(reached.join(seen, "label", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(new)
        if depth % MERGE_EVERY == 0:
            seen = cut(seen)
    return seen


def levels(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """label, level: 0 without dependencies, else one more than its highest dependency.

    Kahn's peeling by rounds: each target holds how many dependencies it still waits for, and a round takes off those
    that were ready before it. Only edges between given targets count. Raises CycleError if a round makes none ready.
    """
    nodes = targets.select("label").distinct()
    inside = edges.join(nodes.select(F.col("label").alias("parent")), "parent", "left_semi").join(nodes.select(F.col("label").alias("dep")), "dep", "left_semi")
    inside = cut(inside.select("dep", "parent").distinct().repartition("dep"))
    waits = inside.groupBy(F.col("parent").alias("label")).agg(F.count(F.lit(1)).alias("left"))
    pending = cut(nodes.join(waits, "label", "left").select("label", F.coalesce("left", F.lit(0)).alias("left")))
    done, level = None, 0
    while True:
        ready = pending.where("left = 0").select("label", F.lit(level).alias("level"))
        n_ready, n_left = pending.agg(F.count_if(F.col("left") == 0), F.count_if(F.col("left") > 0)).first()
        if n_left and not n_ready:
            raise CycleError(f"dependency cycle through {_on_cycle(pending.where('left > 0'), inside, n_left)}")
        done = ready if done is None else done.unionByName(ready)
        if not n_left:
            return done
        met = inside.join(ready.select(F.col("label").alias("dep")), "dep").groupBy(F.col("parent").alias("label")).agg(F.count(F.lit(1)).alias("met"))
        pending = cut(pending.where("left > 0").join(met, "label", "left").select("label", (F.col("left") - F.coalesce("met", F.lit(0))).alias("left")))
        level += 1
        if level % MERGE_EVERY == 0:
            done = cut(done)


def _on_cycle(waiting: DataFrame, edges: DataFrame, n: int) -> str:
    """The smallest label that n steps along smallest dependencies can end in; each of these lies on a cycle.

    Whatever waits has a dependency that waits, so steps never end, and n of them are past everything outside a cycle. They
    are taken by doubling.
    """
    names = waiting.select("label")
    inside = edges.join(names.select(F.col("label").alias("dep")), "dep", "left_semi")
    step = cut(inside.groupBy(F.col("parent").alias("label")).agg(F.min("dep").alias("to")).join(names, "label", "left_semi"))
    for _ in range(n.bit_length()):
        step = cut(step.join(step.select(F.col("label").alias("to"), F.col("to").alias("then")), "to").select("label", F.col("then").alias("to")))
    return step.agg(F.min("to")).first()[0]


def topological_order(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependencies first; ties by label."""
    return levels(targets, edges).orderBy("level", "label")


def validate(targets: DataFrame, edges: DataFrame, target_outputs: DataFrame) -> DataFrame:
    """rule, subject of every violation of the graph's rules; cycles are left to levels."""
    return (
        duplicate_labels(targets).select(F.lit("duplicate label").alias("rule"), F.col("label").alias("subject"))
        .unionByName(unknown_deps(edges, targets).select(F.lit("unknown dependency").alias("rule"), F.concat_ws(" -> ", "parent", "dep").alias("subject")))
        .unionByName(output_collisions(target_outputs).select(F.lit("output collision").alias("rule"), F.col("path").alias("subject")))
    )


def subgraph_order(targets: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """What seeds need, in build order."""
    needed = closure(seeds, edges).select("label")
    return levels(needed, edges).join(targets.select("label"), "label", "left_semi").orderBy("level", "label")


def tree(edges: DataFrame, root: str, depth: int | None = None) -> DataFrame:
    """pos, depth, label, seen of a pre-order walk with children in order. A label already met is marked and not
    expanded, so the walk has a row for each edge of what is reached at most. Without depth it is the whole tree."""
    path = F.array(F.lit(root))
    walk = cut(edges.sparkSession.range(1).select(F.lit(root).alias("label"), path.alias("path"), F.lit(0).alias("depth"), F.lit(False).alias("seen")))
    steps = edges.select(F.col("parent").alias("_p"), F.col("dep").alias("_d")).distinct()
    while True:
        # Expand all that is not below a repeat; the first visit of a label is the first in path order.
        last = walk.agg(F.max("depth")).first()[0]
        new = walk.where((F.col("depth") == last) & ~F.col("seen")).join(steps, F.col("label") == F.col("_p"))
        new = new.select(F.col("_d").alias("label"), F.concat("path", F.array("_d")).alias("path"), (F.col("depth") + 1).alias("depth"), F.lit(False).alias("seen"))
        if (depth is not None and last >= depth) or new.isEmpty():
            break
        walk = cut(_mark_repeats(walk.unionByName(new)))
    return walk.withColumn("pos", F.row_number().over(W.orderBy("path")) - 1).select("pos", "depth", "label", "seen")


def _mark_repeats(walk: DataFrame) -> DataFrame:
    """Marks every visit but the first in walk order, and drops what hangs below a marked one."""
    first = W.partitionBy("label").orderBy("path")
    marked = walk.drop("seen").withColumn("seen", F.row_number().over(first) > 1)
    while True:
        repeats = marked.where("seen").select(F.col("path").alias("_above"))
        above = marked.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))).alias("_above")).where(F.size("path") > 1)
        below = above.join(repeats, "_above", "left_semi").select("path").distinct()
        kept = cut(marked.join(below, "path", "left_anti"))
        again = kept.drop("seen").withColumn("seen", F.row_number().over(first) > 1)
        if kept.count() == marked.count():
            return kept
        marked = again


def _within(edges: DataFrame, scope: DataFrame) -> DataFrame:
    names = scope.select("label").distinct()
    return edges.join(names.select(F.col("label").alias("parent")), "parent", "left_semi").join(names.select(F.col("label").alias("dep")), "dep", "left_semi").select("parent", "dep").distinct()


def to_dot(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """line, text of a DOT rendering: nodes in order, then the edges within scope in order."""
    nodes = scope.select("label").distinct().select(F.lit(1).alias("part"), F.format_string('  "%s";', "label").alias("text"))
    arrows = _within(edges, scope).select(F.lit(2).alias("part"), F.format_string('  "%s" -> "%s";', "parent", "dep").alias("text"))
    ends = edges.sparkSession.createDataFrame([(0, "digraph deps {"), (3, "}")], "part int, text string")
    return _numbered(nodes.unionByName(arrows).unionByName(ends))


def to_mermaid(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """line, text of a Mermaid rendering; a node's alias is n and its place in order."""
    named = scope.select("label").distinct().withColumn("alias", F.concat(F.lit("n"), (F.row_number().over(W.orderBy("label")) - 1).cast("string")))
    nodes = named.select(F.lit(1).alias("part"), F.col("label").alias("k1"), F.lit("").alias("k2"), F.format_string('  %s["%s"]', "alias", "label").alias("text"))
    a, b = (named.select(F.col("label").alias(side), F.col("alias").alias(f"{side}_alias")) for side in ("parent", "dep"))
    arrows = _within(edges, scope).join(a, "parent").join(b, "dep")
    arrows = arrows.select(F.lit(2).alias("part"), F.col("parent").alias("k1"), F.col("dep").alias("k2"), F.format_string("  %s --> %s", "parent_alias", "dep_alias").alias("text"))
    head = edges.sparkSession.createDataFrame([(0, "", "", "graph TD")], "part int, k1 string, k2 string, text string")
    order = F.row_number().over(W.orderBy("part", "k1", "k2")) - 1
    return nodes.unionByName(arrows).unionByName(head).select(order.alias("line"), "text")


def to_json(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """One row with nodes and edges as JSON."""
    nodes = scope.select("label").distinct().agg(F.array_sort(F.collect_list("label")).alias("nodes"))
    arrows = _within(edges, scope).agg(F.array_sort(F.collect_list(F.struct(F.col("parent").alias("from"), F.col("dep").alias("to")))).alias("edges"))
    return nodes.crossJoin(arrows).select(F.to_json(F.struct("nodes", "edges")).alias("json"))


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.select((F.row_number().over(W.orderBy("part", "text")) - 1).alias("line"), "text")


def column_width(labels: DataFrame, cap: int = 48) -> DataFrame:
    return labels.agg(F.least(F.coalesce(F.max(F.length("label")), F.lit(0)), F.lit(cap)).alias("width"))


def node_class(tags: F.Column) -> F.Column:
    """How a node is painted, from its tags."""
    has = lambda *words: F.exists(tags, lambda t: _contains(t, words))
    return F.when(has("test"), "test").when(has("image", "container"), "image").otherwise("default")


def _contains(tag: F.Column, words: tuple[str, ...]) -> F.Column:
    found = F.lit(False)
    for w in words:
        found = found | tag.contains(w)
    return found
