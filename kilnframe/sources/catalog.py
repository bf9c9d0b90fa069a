"""Catalogs from configuration files: discovery, parsing, merging, resolution and validation.

A catalog is some thousands of small files beside which Spark's own start is long, so finding and decoding them is
driver work; what they declare becomes tables (targets and their inputs, outputs, dependencies, tags, environment).
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs, labels

STEM = "kiln"
EXTENSIONS = ("yaml", "yml", "json")
ROOT_ONLY = ("workspace", "cache", "remote", "dispatch", "state", "schema_version")
SCHEMA_VERSION = 1


class CatalogError(ValueError):
    """A configuration that can't be used."""


def find_config(folder: Path, stem: str = STEM) -> Path | None:
    return next((p for ext in EXTENSIONS if (p := folder / f"{stem}.{ext}").is_file()), None)


def parse(path: Path) -> dict:
    text = path.read_text()
    if path.suffix == ".json":
        out = json.loads(text)
    else:
        import yaml

        out = yaml.safe_load(text)
    if out is None:
        return {}
    if not isinstance(out, dict):
        raise CatalogError(f"{path}: not a mapping")
    return out


def find_root(start: Path, explicit: Path | None = None, stem: str = STEM) -> Path:
    """The nearest folder upwards whose primary file names a workspace; an explicit file's folder."""
    if explicit is not None:
        return explicit.resolve().parent
    for folder in (start.resolve(), *start.resolve().parents):
        path = find_config(folder, stem)
        if path and (parse(path).get("workspace") or {}).get("name"):
            return folder
    raise CatalogError(f"no workspace above {start}")


def _ignore_rules(folder: Path) -> list[tuple[str, bool, bool]]:
    path = folder / ".gitignore"
    rules = []
    for line in path.read_text().splitlines() if path.is_file() else []:
        line = line.rstrip()
        if line and not line.startswith("#"):
            keep = line.startswith("!")
            line = line.removeprefix("!")
            rules.append((line.rstrip("/"), line.endswith("/"), keep))
    return rules


def _ignored(relative: str, is_dir: bool, rules: list[tuple[str, bool, bool]]) -> bool:
    out = False
    for rule, only_dirs, keep in rules:
        if only_dirs and not is_dir:
            continue
        anchored = "/" in rule
        subject = relative if anchored else relative.rpartition("/")[2]
        if fnmatch.fnmatchcase(subject, rule.lstrip("/")):
            out = not keep
    return out


def scan_configs(root: Path, stem: str = STEM) -> list[Path]:
    """Configuration files at and below root, hidden folders included, ignored ones not; sorted."""
    name = re.compile(rf"{re.escape(stem)}(\.[A-Za-z0-9_-]+)?\.(yaml|yml|json)")
    found = []
    rules = _ignore_rules(root)
    for folder, dirs, files in os.walk(root):
        here = Path(folder).relative_to(root).as_posix()
        below = lambda n: n if here == "." else f"{here}/{n}"  # noqa: E731, B023
        dirs[:] = sorted(d for d in dirs if d != ".git" and not _ignored(below(d), True, rules))
        found += [Path(folder) / f for f in sorted(files) if name.fullmatch(f) and not _ignored(below(f), False, rules)]
    return sorted(found)


@dataclass
class Catalog:
    """Tables of a merged workspace."""

    root: Path
    targets: DataFrame
    inputs: DataFrame
    outputs: DataFrame
    deps: DataFrame
    tags: DataFrame
    env: DataFrame
    packages: DataFrame
    sections: dict = field(default_factory=dict)

    @property
    def prune_dirs(self) -> DataFrame:
        """label, dir: packages nested below a target's own."""
        inner = self.packages.select(F.col("package").alias("dir"))
        own = self.targets.select("label", "package")
        return own.join(inner, labels.is_subpackage(F.col("dir"), F.col("package"))).select("label", "dir")


_TARGET = (
    "package string, name string, command string, cwd string, test boolean, cache boolean, remote_cache boolean, network boolean, sandbox boolean, `exists` string, timeout_secs bigint, "
    "inputs array<string>, outputs array<string>, deps array<string>, tags array<string>, env map<string,string>"
)


def _input_glob(item: object) -> str:
    if isinstance(item, str):
        return item
    if isinstance(item, dict) and item.get("kind") == "file" and set(item) == {"kind", "glob"}:
        return item["glob"]
    raise CatalogError(f"not an input: {item!r}")


def _row(package: str, t: dict) -> tuple:
    inputs = [_input_glob(i) for i in t.get("inputs") or ()]
    for g in inputs:
        try:
            globs.validate(g)
        except globs.GlobError as e:
            raise CatalogError(str(e)) from e
    return (
        package, t.get("name") or "", t.get("command") or "", t.get("cwd") or "", bool(t.get("test", False)), t.get("cache"), bool(t.get("remote_cache", True)), bool(t.get("network", False)),
        bool(t.get("sandbox", True)), t.get("exists"), t.get("timeout_secs"), inputs, list(t.get("outputs") or ()), list(t.get("deps") or ()), sorted(set(t.get("tags") or ())),
        {str(k): str(v) for k, v in (t.get("env") or {}).items()},
    )


def violations(raw: DataFrame) -> DataFrame:
    """rule, subject of targets that break a rule of their file."""
    subject = labels.label(F.col("package"), F.col("name")).alias("subject")
    rule = lambda text: F.lit(text).alias("rule")
    pointless = labels.is_cacheable(F.col("cache"), F.col("test")) & ~F.col("test") & (F.size("outputs") == 0) & F.col("exists").isNull()
    bad_path = F.exists(F.transform("outputs", lambda o: labels.resolve_path(F.col("package"), o)), lambda o: ~labels.is_relative_path(o))
    twice = raw.groupBy("package", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        raw.where("name = ''").select(rule("empty name"), subject)
        .unionByName(raw.where(F.col("name").rlike("[/:]")).select(rule("name with a separator"), subject))
        .unionByName(twice.select(rule("duplicate name"), subject))
        .unionByName(raw.where("command = ''").select(rule("empty command"), subject))
        .unionByName(raw.where(pointless).select(rule("nothing to cache"), subject))
        .unionByName(raw.where(bad_path).select(rule("output outside the workspace"), subject))
    )


def resolved(raw: DataFrame) -> DataFrame:
    package = F.col("package")
    return raw.select(
        labels.label(package, F.col("name")).alias("label"), "package", "name", "command", labels.resolve_cwd(package, F.col("cwd")).alias("cwd"), "test", "cache",
        labels.is_cacheable(F.col("cache"), F.col("test")).alias("cacheable"), "remote_cache", "network", "sandbox", "exists", "timeout_secs", "tags", "env",
        F.transform("inputs", lambda x: labels.resolve_path(package, x)).alias("inputs"), F.transform("outputs", lambda x: labels.resolve_path(package, x)).alias("outputs"),
        F.transform("deps", lambda x: labels.resolve_dep(package, x)).alias("deps"),
    )


def load(spark: SparkSession, start: Path, explicit: Path | None = None, stem: str = STEM, root_only: bool = False) -> Catalog:
    """The merged catalog of a workspace, its own file first. Violations raise CatalogError."""
    root = find_root(start, explicit, stem)
    primary = explicit or find_config(root, stem)
    paths = [primary] if root_only else [primary, *(p for p in scan_configs(root, stem) if p.resolve() != primary.resolve())]
    rows, packages, sections = [], {}, {}
    for path in paths:
        config, package = parse(path), path.resolve().parent.relative_to(root).as_posix()
        package = "" if package == "." else package
        if path is primary:
            sections = {k: v for k, v in config.items() if k != "targets"}
            name = (config.get("workspace") or {}).get("name") or ""
            if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
                raise CatalogError(f"workspace name {name!r}")
            if config.get("schema_version", SCHEMA_VERSION) != SCHEMA_VERSION:
                raise CatalogError(f"schema_version {config['schema_version']}")
        elif found := [k for k in ROOT_ONLY if k in config]:
            raise CatalogError(f"{path}: {', '.join(found)} belong in the workspace's own file")
        packages.setdefault(package, path.name)
        rows += [_row(package, t) for t in config.get("targets") or ()]
    raw = spark.createDataFrame(rows, _TARGET)
    if wrong := violations(raw).orderBy("rule", "subject").take(5):
        raise CatalogError("; ".join(f"{r['subject']}: {r['rule']}" for r in wrong))
    targets = resolved(raw)
    one = lambda column, name: targets.select("label", F.posexplode(column).alias("pos", name))
    return Catalog(
        root, targets, one("inputs", "glob"), one("outputs", "path"), targets.select("label", F.explode("deps").alias("dep")), targets.select("label", F.explode("tags").alias("tag")),
        targets.select("label", F.explode("env").alias("key", "value")), spark.createDataFrame(sorted(packages.items()), "package string, config string").orderBy("package"), sections,
    )


def described(catalog: Catalog) -> DataFrame:
    """json lines of a catalog stream: packages first, then targets, each by name."""
    packages = catalog.packages.select(F.lit(0).alias("o"), F.col("package").alias("k"), F.to_json(F.struct(F.lit("package.described").alias("t"), "package", "config")).alias("json"))
    body = F.struct(F.lit("target.described").alias("t"), F.col("label").alias("id"), "tags", "test", "command", "inputs", "outputs", "deps")
    return packages.unionByName(catalog.targets.select(F.lit(1).alias("o"), F.col("label").alias("k"), F.to_json(body).alias("json"))).orderBy("o", "k").select("json")
