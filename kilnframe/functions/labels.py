"""Labels ``//package:name``, package-relative paths and their validation, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MANUAL_TAG = "manual"


def label(package: Column, name: Column) -> Column:
    return F.concat(F.lit("//"), package, F.lit(":"), name)


def _body(lab: Column) -> Column:
    return F.regexp_replace(lab, r"\A//", "")


def package_of(lab: Column) -> Column:
    """What stands before the last colon, or all of it without one."""
    return F.regexp_replace(_body(lab), r"(?s):[^:]*\z", "")


def name_of(lab: Column) -> Column:
    """What stands after the last colon, or nothing."""
    return F.when(_body(lab).contains(":"), F.substring_index(_body(lab), ":", -1)).otherwise("")


def resolve_dep(package: Column, dep: Column) -> Column:
    """``//`` is absolute; ``:name`` and ``name`` are of the same package."""
    return F.when(dep.startswith("//"), dep).otherwise(label(package, F.regexp_replace(dep, r"\A:", "")))


def resolve_path(package: Column, raw: Column) -> Column:
    """``//x`` from the root, ``.`` the package, else below the package."""
    below = F.when(package == "", raw).otherwise(F.concat(package, F.lit("/"), raw))
    return F.when(raw.startswith("//"), F.substr(raw, F.lit(3))).when(raw == ".", package).otherwise(below)


def resolve_cwd(package: Column, raw: Column) -> Column:
    return resolve_path(package, F.when(F.coalesce(raw, F.lit("")) == "", F.lit(".")).otherwise(raw))


def is_subpackage(package: Column, of: Column) -> Column:
    """Strictly below; everything but the root is below the root."""
    return F.when(of == "", package != "").otherwise(package.startswith(F.concat(of, F.lit("/"))))


def encloses(package: Column, path: Column) -> Column:
    """The package holds the directory: it is it, or is above it."""
    return (package == "") | (package == path) | path.startswith(F.concat(package, F.lit("/")))


def is_cacheable(cache: Column, test: Column) -> Column:
    return F.coalesce(cache, ~test)


def output_parent(output: Column) -> Column:
    """The directory to create for an output: its parent or, for a glob, its literal prefix; null for the root."""
    from .globs import literal_prefix

    return F.nullif(literal_prefix(output), F.lit(""))


def normalize_package(explicit: Column, relative_cwd: Column) -> Column:
    raw = F.coalesce(explicit, relative_cwd, F.lit(""))
    return F.regexp_replace(F.regexp_replace(raw, r"\A(//|(\./)+|\.\z)", ""), r"/+\z", "")


def sanitize(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "_")


def resolve_sandbox_path(raw: Column, home: Column, root: Column) -> Column:
    """``~/x`` from the home folder, absolute as it is, else from the workspace."""
    return F.when(raw.startswith("~/"), F.concat(home, F.substr(raw, F.lit(2)))).when(raw.startswith("/"), raw).otherwise(F.concat(root, F.lit("/"), raw))


def is_config_filename(name: Column, stem: str) -> Column:
    """``stem.ext`` or ``stem.infix.ext`` with ext yaml, yml or json."""
    return name.rlike(rf"\A{stem}(\.[A-Za-z0-9_-]+)?\.(yaml|yml|json)\z")


def is_relative_path(path: Column) -> Column:
    """Relative and without a ``..`` component."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


#: Rules for names, by what they name.
NAME_RULES = {
    "workspace": r"\A[A-Za-z0-9_-]+\z",
    "target": r"\A[^/:]+\z",
    "task": r"\A[A-Za-z_][A-Za-z0-9_-]*\z",
    "generator": r"\A[A-Za-z0-9_-]+\z",
    "segment": r"\A[A-Za-z0-9_-][A-Za-z0-9._-]*\z",
}


def is_valid_name(name: Column, kind: str) -> Column:
    return name.rlike(NAME_RULES[kind])


def passes_tags(tags: Column, include: list[str], exclude: list[str]) -> Column:
    """Any of include, if there are some, and none of exclude."""
    ok = F.lit(True)
    if include:
        ok = ok & F.arrays_overlap(tags, F.array(*map(F.lit, include)))
    if exclude:
        ok = ok & ~F.arrays_overlap(tags, F.array(*map(F.lit, exclude)))
    return F.coalesce(ok, F.lit(not include))


def expand_env(names: Column, patterns: list[str]) -> Column:
    """Sorted names that a trailing ``*`` selects, and all literal patterns whether they occur or not."""
    literal = [p for p in patterns if not p.endswith("*")]
    prefixes = [p[:-1] for p in patterns if p.endswith("*")]
    hit = F.filter(names, lambda n: F.exists(F.array(*map(F.lit, prefixes)), n.startswith)) if prefixes else F.array().cast("array<string>")
    return F.array_sort(F.array_union(hit, F.array(*map(F.lit, literal)).cast("array<string>")))
