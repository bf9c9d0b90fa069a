"""Five glob dialects, compiled to regular expressions that Java and RE2 read alike.

LABEL and WALK keep ``*``, ``?`` and classes within a path component; PATH, DEEP and RAW let them cross ``/``. In all,
``**`` is a whole component and stands for any number of them, none included. DEEP alone knows ``{a,b}``.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

LABEL, PATH, WALK, DEEP, RAW = "label", "path", "walk", "deep", "raw"
_WITHIN = {LABEL, WALK}
_META = frozenset(r".^$+(){}|\[]*?")


class GlobError(ValueError):
    """A glob that is no valid pattern."""


def _quoted(c: str) -> str:
    return "\\" + c if c in _META else c


def _class(glob: str, at: int) -> tuple[str, int]:
    """The regular expression of the class that opens at at, and where it ends."""
    end = glob.find("]", at + (3 if glob[at + 1 : at + 2] == "!" else 2))
    if end < 0:
        raise GlobError(f"unclosed class in {glob!r}")
    body = glob[at + 1 : end]
    negated = body.startswith("!")
    body = re.sub(r"([\\\[\]^&~|])", r"\\\1", body[negated:])
    return f"[{'^' * negated}{body}]", end + 1


def validate(glob: str, braces: bool = False) -> None:
    """Raises GlobError for an unclosed class, for ``**`` beside other characters, and for braces unless allowed."""
    to_regex(glob, PATH)
    if not braces and ("{" in glob or "}" in glob):
        raise GlobError(f"braces in {glob!r}")


def to_regex(glob: str, dialect: str = PATH) -> str:
    """An expression that matches whole strings."""
    within = dialect in _WITHIN
    any_one, any_run = ("[^/]", "[^/]*") if within else (".", ".*")
    out, at, depth = [], 0, 0
    while at < len(glob):
        c = glob[at]
        if c == "*":
            end = at
            while glob[end : end + 1] == "*":
                end += 1
            if end - at == 1:
                out.append(any_run)
            elif end - at > 2 or (at and glob[at - 1] != "/") or (end < len(glob) and glob[end] != "/"):
                raise GlobError(f"** is not a component of its own in {glob!r}")
            elif end == len(glob):
                out.append(".*")
            else:
                out.append("(?:.*/)?")
                end += 1
            at = end
        elif c == "?":
            out.append(any_one)
            at += 1
        elif c == "[":
            text, at = _class(glob, at)
            out.append(text)
        elif dialect == DEEP and c == "{":
            out.append("(?:")
            depth += 1
            at += 1
        elif dialect == DEEP and c == "}" and depth:
            out.append(")")
            depth -= 1
            at += 1
        elif dialect == DEEP and c == "," and depth:
            out.append("|")
            at += 1
        else:
            out.append(_quoted(c))
            at += 1
    if depth:
        raise GlobError(f"unclosed brace in {glob!r}")
    return r"(?s)\A" + "".join(out) + r"\z"


def matches(column: Column, glob: str, dialect: str = PATH) -> Column:
    """Whether a column matches a glob that is known when the query is built."""
    return column.rlike(to_regex(glob, dialect))


def regex_column(glob: Column, dialect: str = PATH) -> Column:
    """The expressions of a column of globs; apply it to distinct globs. Null for an invalid glob."""

    def compile_all(globs: pd.Series) -> pd.Series:
        def one(g: str | None) -> str | None:
            try:
                return None if g is None else to_regex(g, dialect)
            except GlobError:
                return None

        return globs.map(one)

    ship(SparkSession.active())
    return F.pandas_udf(compile_all, "string")(glob)


def has_wildcards(glob: Column, dots: bool = False) -> Column:
    """Whether ``*``, ``?`` or ``[`` occurs; for label patterns (dots) also ``...``."""
    found = glob.rlike(r"[*?\[]")
    return found | glob.contains("...") if dots else found


def literal_prefix(glob: Column) -> Column:
    """The directories before the first component with a wildcard; for a glob without any, its parent."""
    parts = F.split(glob, "/")
    wild = F.transform(parts, lambda p, i: F.when(p.rlike(r"[*?\[]"), i))
    first = F.coalesce(F.array_min(wild), F.size(parts) - 1)
    return F.array_join(F.slice(parts, F.lit(1), first), "/")


def ancestors(path: Column) -> Column:
    """The directories that hold a path, from the root (the empty string) on."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
