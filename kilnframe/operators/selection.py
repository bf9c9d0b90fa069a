"""Selecting targets by label patterns, tags and test mode, and by what a change affects."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs, labels
from . import graph


class TestMode(Enum):
    __test__ = False
    EXCLUDE = "exclude"
    ONLY = "only"
    INCLUDE = "include"


class NoMatchError(ValueError):
    """A literal pattern that selects nothing, perhaps with a suggestion."""


@dataclass(frozen=True)
class LabelPattern:
    """``//pkg/...`` (recursive), or package and name globs whose wildcards stay within a component."""

    text: str
    prefix: str | None
    package: str = ""
    name: str = ""

    @classmethod
    def parse(cls, text: str) -> LabelPattern:
        body = text.removeprefix("//")
        if body.endswith("..."):
            return cls(text, body[:-3].removesuffix("/"))
        package, colon, name = body.rpartition(":")
        if not colon:
            package, name = body, body.rpartition("/")[2]
        return cls(text, None, globs.to_regex(package, globs.LABEL), globs.to_regex(name, globs.LABEL))

    @property
    def is_wild(self) -> bool:
        return bool(re.search(r"[*?\[]|\.\.\.", self.text))

    def condition(self, label: Column) -> Column:
        package = labels.package_of(label)
        if self.prefix is not None:
            return F.lit(True) if not self.prefix else (package == self.prefix) | package.startswith(self.prefix + "/")
        return package.rlike(self.package) & labels.name_of(label).rlike(self.name)


def eligible(mode: TestMode, tags: list[str], no_tags: list[str]) -> Column:
    ok = labels.passes_tags(F.col("tags"), tags, no_tags)
    if mode is TestMode.INCLUDE:
        return ok
    return ok & (F.col("test") if mode is TestMode.ONLY else ~F.col("test"))


def select(targets: DataFrame, patterns: list[str] = (), mode: TestMode = TestMode.EXCLUDE, tags: list[str] = (), no_tags: list[str] = (), strict: bool = True) -> DataFrame:
    """Targets (label, tags, test, ...) that some pattern selects and no ``!pattern`` excludes, by label.

    Patterns are part of the query, so selection is one filter of the catalog: no join, and eligibility, which is
    cheap, stands before the expressions. With strict, a literal pattern that selects nothing raises NoMatchError.
    """
    excludes = [LabelPattern.parse(p[1:]) for p in patterns if p.startswith("!")]
    includes = [LabelPattern.parse(p) for p in patterns if not p.startswith("!")]
    either = lambda conditions: reduce(lambda a, b: a | b, conditions, F.lit(False))
    pool = targets.where(eligible(mode, list(tags), list(no_tags)))
    manual = F.coalesce(F.array_contains("tags", labels.MANUAL_TAG), F.lit(False))
    wanted = either([p.condition(F.col("label")) & (F.lit(not p.is_wild) | ~manual) for p in includes]) if includes else ~manual
    if strict and (literal := [p for p in includes if not p.is_wild]):
        found = pool.agg(*(F.max(p.condition(F.col("label"))).alias(f"p{i}") for i, p in enumerate(literal))).first()
        for hit, pattern in zip(found, literal, strict=True):
            if not hit:
                near = suggest(targets, pattern.text).first()
                raise NoMatchError(f"no target matches {pattern.text!r}" + (f" - did you mean {near['label']}?" if near else ""))
    return pool.where(wanted & ~either([p.condition(F.col("label")) for p in excludes])).orderBy("label")


def suggest(targets: DataFrame, pattern: str) -> DataFrame:
    """The closest label (ties: the smaller), if within two edits or a third of the pattern's bytes."""
    best = targets.agg(F.min(F.struct(F.levenshtein(F.lit(pattern), F.col("label")).alias("distance"), F.col("label").alias("label"))).alias("b"))
    near = (F.col("distance") <= 2) | (F.col("distance") * 3 <= len(pattern.encode()))
    return best.select("b.label", "b.distance").where(near)


def directly_affected(changed: DataFrame, target_inputs: DataFrame) -> DataFrame:
    """label of targets with an input that a changed path matches.

    Literal inputs are an equality join. Globs join on the directories above each path: a glob can only match below
    its literal prefix, so paths meet the globs of their own directories and no others.
    """
    paths = changed.select("path").distinct()
    inputs = target_inputs.select("label", "glob")
    wild = globs.has_wildcards(F.col("glob"))
    exact = inputs.where(~wild).join(paths.select(F.col("path").alias("glob")), "glob", "left_semi").select("label")
    patterns = inputs.where(wild).select("glob").distinct()
    patterns = patterns.select("glob", globs.literal_prefix(F.col("glob")).alias("dir"), globs.regex_column(F.col("glob"), globs.PATH).alias("regex"))
    below = paths.select("path", F.explode(globs.ancestors(F.col("path"))).alias("dir"))
    hit = patterns.join(below, "dir").where(F.expr("path rlike regex")).select("glob").distinct()
    return exact.unionByName(inputs.join(hit, "glob", "left_semi").select("label")).distinct()


def affected(changed: DataFrame, target_inputs: DataFrame, edges: DataFrame) -> DataFrame:
    """label, depth of targets that changed paths reach, directly or through dependencies."""
    return graph.closure(directly_affected(changed, target_inputs), edges, downstream=True)


def selected_and_affected(selection: DataFrame, affected_labels: DataFrame) -> DataFrame:
    return selection.join(affected_labels.select("label"), "label", "left_semi").orderBy("label")


def changed_since(diff: DataFrame, untracked: DataFrame) -> DataFrame:
    """Distinct paths of a diff and of files not yet tracked."""
    return diff.select("path").union(untracked.select("path")).distinct().orderBy("path")


def resolve_changed_files(root: str, explicit: DataFrame | None = None, since: DataFrame | None = None) -> DataFrame:
    """Changed paths relative to the workspace: those named outright, if any relation of them is given, else those since a
    base. Without either there is nothing to ask, a ValueError."""
    if explicit is not None:
        below = F.col("path").startswith(root.rstrip("/") + "/")
        return explicit.select(F.when(below, F.substr("path", F.lit(len(root.rstrip("/")) + 2))).otherwise(F.col("path")).alias("path")).distinct()
    if since is None:
        raise ValueError("affected targets need a base or changed files")
    return since.select("path").distinct()


def split_nul(listing: DataFrame, column: str = "listing") -> DataFrame:
    """Paths of NUL-separated listings; empty ones go."""
    return listing.select(F.explode(F.split(column, "\\x00")).alias("path")).where("path <> ''")


def watch_excluded(paths: DataFrame, excluded: DataFrame) -> DataFrame:
    """Paths that lie neither at nor below an excluded path, by components."""
    inside = paths.select("path", F.explode(F.concat(globs.ancestors(F.col("path")), F.array("path"))).alias("at"))
    hit = inside.join(excluded.select(F.col("path").alias("at")), "at", "left_semi").select("path").distinct()
    return paths.join(hit, "path", "left_anti")


def owner_package(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """path, package: the deepest package that holds each path."""
    above = paths.select("path", F.explode(globs.ancestors(F.col("path"))).alias("package"))
    held = above.join(packages.select("package").distinct(), "package", "left_semi")
    return held.groupBy("path").agg(F.max_by("package", F.length("package")).alias("package"))


def known_tags(targets: DataFrame) -> DataFrame:
    return targets.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def ids_with_tag(targets: DataFrame, tag: str) -> DataFrame:
    return targets.where(F.array_contains("tags", tag)).select("label").orderBy("label")


def relevant_batches(batch_paths: DataFrame, watched_globs: list[str], affected_labels: DataFrame, requested: DataFrame) -> DataFrame:
    """batch of changes that matter to a subscription: a path matches a watched glob, or a requested target is affected
    (batch, label), or nothing in particular is watched."""
    every = batch_paths.select("batch").distinct()
    if not watched_globs and requested.isEmpty():
        return every
    either = reduce(lambda a, b: a | b, [globs.matches(F.col("path"), g) for g in watched_globs], F.lit(False))
    by_glob = batch_paths.where(either).select("batch")
    return by_glob.union(affected_labels.join(requested.select("label"), "label", "left_semi").select("batch")).distinct()


def build_rows(rows: DataFrame, catalog: DataFrame, search: str = "", tags: list[str] = (), no_tags: list[str] = (), statuses: list[str] = ()) -> DataFrame:
    """Rows of a build (label, status) that pass a search, tags by catalog lookup, and a status bucket; failed first,
    then running, queued and the rest."""
    from ..functions.text import matches_search

    known = rows.join(catalog.select("label", "tags"), "label", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    ok = matches_search(F.col("label"), search) & labels.passes_tags(F.col("tags"), list(tags), list(no_tags))
    if statuses:
        ok = ok & F.col("status").isin(*statuses)
    rank = F.when(F.col("status") == "failed", 0).when(F.col("status") == "running", 1).when(F.col("status") == "queued", 2).otherwise(3)
    return known.where(ok).orderBy(rank, "label").select("label", "status")
