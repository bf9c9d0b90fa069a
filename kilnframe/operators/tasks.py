"""Tasks and services: resolving references, binding arguments, order of runs and starts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from . import graph


class ArgumentError(ValueError):
    """Arguments that don't fit a task's declaration."""


@dataclass(frozen=True)
class Arg:
    name: str
    default: str | None = None
    choices: tuple[str, ...] | None = None
    variadic: bool = False


def bind(args: list[Arg], positionals: list[str] = (), named: list[str] = (), passthrough: list[str] = ()) -> tuple[dict[str, str], list[str]]:
    """(values by name, rest): positionals in order, a last variadic takes what is left, ``name=value`` by name.

    A task that declares nothing forwards everything; one that does takes no extras but those passed through.
    """
    plain = [a for a in args if not a.variadic]
    given = dict(zip((a.name for a in plain), positionals, strict=False))
    extra = list(positionals[len(plain) :])
    if extra and args and not any(a.variadic for a in args):
        raise ArgumentError(f"{len(extra)} more than the {len(plain)} declared argument(s): {extra}")
    for item in named:
        name, eq, value = item.partition("=")
        if not eq:
            raise ArgumentError(f"{item!r} is not name=value")
        if name not in (a.name for a in plain):
            raise ArgumentError(f"no argument {name!r} is declared")
        if name in given:
            raise ArgumentError(f"{name!r} is given twice")
        given[name] = value
    for a in plain:
        value = given.setdefault(a.name, a.default)
        if value is None:
            raise ArgumentError(f"{a.name!r} is required")
        if a.choices is not None and value not in a.choices:
            raise ArgumentError(f"{a.name!r} is {value!r}, none of {list(a.choices)}")
    return {a.name: given[a.name] for a in plain}, extra + list(passthrough)


def resolve(references: DataFrame, tasks: DataFrame) -> DataFrame:
    """reference, cwd, label, problem for references (reference, cwd) to tasks (package, name).

    ``//`` names a task outright; a bare name takes the only task of that name, else the one of the deepest package
    that holds cwd, else it is ambiguous.
    """
    known = tasks.select(labels.label(F.col("package"), F.col("name")).alias("task"), "package", "name")
    absolute = F.col("reference").startswith("//")
    by_label = references.where(absolute).join(known.select(F.col("task").alias("reference"), F.col("task").alias("label")), "reference", "left")
    by_label = by_label.select("reference", "cwd", "label", F.when(F.col("label").isNull(), "unknown").alias("problem"))
    named = references.where(~absolute).join(known.withColumnRenamed("name", "reference"), "reference", "left")
    near = labels.encloses(F.col("package"), F.col("cwd"))
    counted = named.groupBy("reference", "cwd").agg(
        F.count("task").alias("n"), F.min("task").alias("only"), F.max_by(F.when(near, F.col("task")), F.when(near, F.length("package"))).alias("nearest")
    )
    by_name = counted.select(
        "reference", "cwd", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("nearest")).alias("label"),
        F.when(F.col("n") == 0, "unknown").when((F.col("n") > 1) & F.col("nearest").isNull(), "ambiguous").alias("problem"),
    )
    return by_label.unionByName(by_name)


def violations(tasks: DataFrame, services: DataFrame, refs: DataFrame) -> DataFrame:
    """rule, subject of everything wrong with tasks (label, name, command), services (label, name, command) and refs
    (label, kind: needs, finally, services or service_needs, ref: a label)."""
    good = lambda c: labels.is_valid_name(F.col(c), "task")
    supervised = refs.where("kind = 'services'").select("label").distinct()
    rule = lambda text: F.lit(text).alias("rule")
    subject = F.col("label").alias("subject")
    task_names, service_names = tasks.select(F.col("label").alias("ref")), services.select(F.col("label").alias("ref"))
    pair = F.concat_ws(" -> ", "label", "ref").alias("subject")
    return (
        tasks.where(~good("name")).select(rule("task name"), subject)
        .unionByName(tasks.where("command = ''").select(rule("empty command"), subject))
        .unionByName(tasks.where("command IS NULL").join(supervised, "label", "left_anti").select(rule("does nothing"), subject))
        .unionByName(services.where(~good("name")).select(rule("service name"), subject))
        .unionByName(services.where("coalesce(command, '') = ''").select(rule("empty command"), subject))
        .unionByName(refs.where("kind IN ('needs', 'finally')").join(task_names, "ref", "left_anti").select(rule("unknown task"), pair))
        .unionByName(refs.where("kind IN ('services', 'service_needs')").join(service_names, "ref", "left_anti").select(rule("unknown service"), pair))
        .unionByName(refs.where("kind IN ('needs', 'service_needs') AND label = ref").select(rule("needs itself"), subject))
    )


def start_levels(services: DataFrame, service_needs: DataFrame) -> DataFrame:
    """label, level: services of a level start together once those they need are ready. A cycle raises CycleError."""
    return graph.levels(services, service_needs.select(F.col("label").alias("parent"), F.col("ref").alias("dep")))


def run_order(refs: DataFrame, task: str) -> DataFrame:
    """step, kind, ref of one task's life: builds it depends on, services, needed tasks, its command, finally, and the
    stop of services in reverse. Tasks it refers to run their command alone."""
    mine = refs.where(F.col("label") == task)
    place = F.create_map(*(F.lit(x) for pair in {"deps": 0, "services": 1, "needs": 2, "finally": 4}.items() for x in pair))
    rows = mine.select(place[F.col("kind")].alias("phase"), "pos", "kind", "ref").where("phase IS NOT NULL")
    own = refs.sparkSession.createDataFrame([(3, 0, "command", task)], "phase int, pos int, kind string, ref string")
    stops = mine.where("kind = 'services'").select(F.lit(5).alias("phase"), (-F.col("pos")).alias("pos"), F.lit("stop").alias("kind"), "ref")
    return rows.unionByName(own).unionByName(stops).orderBy("phase", "pos").select("phase", "pos", "kind", "ref")


def listing(tasks: DataFrame, form: str = "labels") -> DataFrame:
    """text of a listing: labels, json (a row for each task) or text (label and description)."""
    rows = tasks.orderBy("label")
    if form == "json":
        return rows.select(F.to_json(F.struct("label", "description")).alias("text"))
    if form == "text":
        return rows.select(F.concat(F.rpad("label", 40, " "), F.coalesce("description", F.lit(""))).alias("text"))
    return rows.select(F.col("label").alias("text"))
