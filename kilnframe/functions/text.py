"""Durations, sizes and log texts as column expressions. Decimals round half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_CAP_BYTES = 5 * 1024 * 1024
DISPLAY_BYTES = 8192


def format_duration(ms: Column) -> Column:
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.format_string("%.2fs", ms / F.lit(1000.0)))
        .otherwise(F.format_string("%.1fm", ms / F.lit(60_000.0)))
    )


def parse_duration(text: Column) -> Column:
    """Seconds of ``90``, ``90s``, ``5m``, ``2h`` or ``7d``; null for anything else."""
    amount = F.regexp_extract(text, r"\A(\d+)([smhd]?)\z", 1).try_cast("bigint")
    unit = F.regexp_extract(text, r"\A(\d+)([smhd]?)\z", 2)
    return amount * F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86_400).otherwise(1)


def human_bytes(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / F.lit(float(1024**power)))).otherwise(out)
    return out


def short_hash(h: Column) -> Column:
    return F.substring(h, 1, 16)


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a as a decimal: the low byte alone meets the exclusive or, the product is taken modulo 2**64."""
    dec = lambda c: c.cast("decimal(38,0)")
    hexes = F.hex(F.encode(text, "UTF-8"))
    codes = F.transform(F.sequence(F.lit(0), F.greatest(F.length(hexes) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.conv(F.substr(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))

    def step(h: Column, byte: Column) -> Column:
        low = (h % dec(F.lit(256))).cast("int")
        mixed = dec(h - dec(low) + dec(low.bitwiseXOR(byte)))
        # the prime is 2**40 + 435, and both products stay within 38 digits
        low24 = dec(mixed % dec(F.lit(1 << 24)))
        return dec(dec(dec(low24 * dec(F.lit(1 << 40))) + dec(mixed * dec(F.lit(435)))) % F.lit(str(1 << 64)).cast("decimal(38,0)"))

    start = F.lit("14695981039346656037").cast("decimal(38,0)")
    return F.when(text == "", start).otherwise(F.aggregate(codes, start, step))


def palette_slot(text: Column, slots: int = 8) -> Column:
    return (fnv1a(text) % slots).cast("int")


def display_cut(line: Column) -> Column:
    """A line's first 8192 bytes, as shown; whole characters only."""
    return F.when(F.octet_length(line) <= DISPLAY_BYTES, line).otherwise(F.regexp_replace(F.decode(F.substring(F.encode(line, "UTF-8"), 1, DISPLAY_BYTES), "UTF-8"), "�+\\z", ""))


def matches_search(label: Column, search: str) -> Column:
    """An interactive search: nothing matches all, wildcards make a label pattern, else part of the label in any case."""
    from ..operators import selection
    from .globs import GlobError

    if not search:
        return F.lit(True)
    if any(c in search for c in "*?[") or "..." in search:
        try:
            return selection.LabelPattern.parse(search).condition(label)
        except GlobError:
            return F.lit(False)
    return F.lower(label).contains(search.lower())
