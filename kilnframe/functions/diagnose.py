"""Why a confined command failed, from its exit code and what it wrote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SETUP_EXIT = 125
# What tools print for each kind of failure.
SETUP = ("sandboxing failure", "Landlock", "seccomp", "unprivileged", "namespace")
NETWORK = ("Network is unreachable", "ENETUNREACH", "Could not resolve host", "Temporary failure in name resolution", "Name or service not known", "EAI_AGAIN", "getaddrinfo")
DENIED = ("Permission denied", "Operation not permitted", "EACCES", "EPERM")
MISSING = ("No such file or directory", "ENOENT", "cannot open")


def _any(text: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | text.contains(n)
    return found


def first_denied_path(text: Column) -> Column:
    """The longest absolute path of the first denial line that names one (the last of equals), else null."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: _any(x, DENIED))

    def longest(line: Column) -> Column:
        tokens = F.transform(F.split(line, "[\\s'\"`]"), lambda t: F.regexp_replace(t, r"\A[:,().]+|[:,().]+\z", ""))
        paths = F.filter(tokens, lambda t: t.startswith("/") & (F.octet_length(t) > 1))
        ranked = F.transform(paths, lambda p, i: F.struct(F.octet_length(p).alias("n"), i.alias("i"), p.alias("p")))
        return F.array_max(ranked)["p"]

    return F.get(F.filter(F.transform(lines, longest), lambda p: p.isNotNull()), F.lit(0))


def diagnose(exit_code: Column, stderr: Column, allowed: Column, network: Column, setup: tuple[str, ...] = SETUP) -> Column:
    """setup, network, undeclared, declared, denied, missing, or null: the first that applies, in this order."""
    path = first_denied_path(stderr)
    declared = F.exists(allowed, lambda a: (path == a) | path.startswith(F.concat(F.regexp_replace(a, "/+\\z", ""), F.lit("/"))))
    return (
        F.when((exit_code == SETUP_EXIT) | _any(stderr, setup), "setup")
        .when(~network & _any(stderr, NETWORK), "network")
        .when(_any(stderr, DENIED) & path.isNull(), "denied")
        .when(_any(stderr, DENIED) & declared, "declared")
        .when(_any(stderr, DENIED), "undeclared")
        .when(_any(stderr, MISSING), "missing")
    )
