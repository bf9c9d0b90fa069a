"""The content-addressed cache as tables: blobs (hash, size, ...), entries (cache_key, ...) and their references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing


def put_blobs(stored: DataFrame, contents: DataFrame) -> DataFrame:
    """Rows (hash, size, content) to append for contents (content): each new content once."""
    new = contents.select(hashing.content_hash(F.col("content")).alias("hash"), F.octet_length("content").cast("long").alias("size"), "content").dropDuplicates(["hash"])
    return new.join(stored.select("hash"), "hash", "left_anti")


def missing_blobs(hashes: DataFrame, stored: DataFrame) -> DataFrame:
    return hashes.select("hash").distinct().join(stored.select("hash"), "hash", "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def put_entries(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries after new ones are written: the newer of a key stays."""
    both = entries.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, ["cache_key"], [F.desc("_new"), F.desc("mtime")]).drop("_new")


def delete_entries(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys.select("cache_key"), "cache_key", "left_anti")


def references(entries: DataFrame) -> DataFrame:
    """cache_key, hash of every reference of entries (outputs, stdout_blob, stderr_blob), repeats kept."""
    return entries.select("cache_key", F.explode(hashing.referenced_hashes(F.col("outputs"), F.col("stdout_blob"), F.col("stderr_blob"))).alias("hash"))


def ref_counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("hash").agg(F.count(F.lit(1)).alias("refs"))


def hits(keys: DataFrame, entries: DataFrame, refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows of keys (label, cache_key) whose entry succeeded and has all its blobs."""
    broken = refs.join(blobs.select("hash"), "hash", "left_anti").select("cache_key").distinct()
    good = entries.where("exit_code = 0").select("cache_key").distinct().join(broken, "cache_key", "left_anti")
    return keys.join(good, "cache_key", "left_semi")


def status(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """label, state (cached or stale), key, last_duration_ms, by label. Without a key a target is stale, its key empty."""
    good = entries.where("exit_code = 0").select("cache_key", F.col("duration_ms").alias("last_duration_ms"))
    rows = keys.join(good, "cache_key", "left")
    found = F.col("cache_key").isNotNull() & F.col("last_duration_ms").isNotNull()
    return rows.select("label", F.when(found, "cached").otherwise("stale").alias("state"), F.coalesce("cache_key", F.lit("")).alias("key"), "last_duration_ms").orderBy("label")


def lookup_chain(keys: DataFrame, local: DataFrame, remote: DataFrame, external: DataFrame, fresh: bool = False) -> DataFrame:
    """label, result: cache_hit, remote_cache_hit, external_cache_hit or build, the first that applies.

    keys: label, cache_key, cacheable, remote_cache; local and remote: cache_key of complete good entries; external:
    label of targets whose own check finds their result. fresh passes all of them over.
    """
    if fresh:
        return keys.select("label", F.lit("build").alias("result"))
    side = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    rows = keys.join(side(local, "cache_key", "_l"), "cache_key", "left").join(side(remote, "cache_key", "_r"), "cache_key", "left").join(side(external, "label", "_e"), "label", "left")
    by_local, by_remote = F.when(F.col("cacheable") & F.col("_l"), "cache_hit"), F.when(F.col("cacheable") & F.col("remote_cache") & F.col("_r"), "remote_cache_hit")
    return rows.select("label", F.coalesce(by_local, by_remote, F.when(F.col("_e"), "external_cache_hit"), F.lit("build")).alias("result"))


def restore_plan(entry_outputs: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Outputs (path, content_hash) to write: those whose bytes aren't there already."""
    return entry_outputs.join(on_disk.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def _bucketed_prefix(rows: DataFrame, bucket: Column, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """rows with running sums of values before each row (before_x), in the order of bucket and then order.

    Sums are taken within buckets and over the buckets' totals, so no task sees all rows, as one window would.
    """
    rows = rows.withColumn("_b", bucket)
    totals = rows.groupBy("_b").agg(*(F.sum(v).alias(f"_t_{k}") for k, v in values.items()))
    earlier = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_b", *(F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_s_{k}") for k in values))
    inner = W.partitionBy("_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = rows.select("*", *(F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"_w_{k}") for k, v in values.items()))
    joined = within.join(starts, "_b")
    return joined.select(*(c for c in rows.columns if c != "_b"), *((F.col(f"_s_{k}") + F.col(f"_w_{k}")).alias(f"before_{k}") for k in values))


def eviction_plan(entries: DataFrame, refs: DataFrame, blobs: DataFrame, target_bytes: int, extra_bytes: int = 0, now: Column | None = None, min_age_secs: int = 0) -> DataFrame:
    """Entries to evict, oldest first, until what remains is within target_bytes: cache_key, mtime, gain, freed_before.

    entries: cache_key, mtime, ac_bytes. An entry's gain is its own size and that of the blobs whose last reference it
    is in this order; references of entries within the recency buffer last for ever. So eviction is two aggregates
    and a running sum instead of a walk. Blobs that are gone count nothing; a future mtime is not in the buffer.
    """
    young = F.lit(False)
    if now is not None and min_age_secs:
        age = F.unix_micros(now) - F.unix_micros(F.col("mtime").cast("timestamp"))
        young = (age >= 0) & (age < min_age_secs * 1_000_000)
    aged = entries.select("cache_key", "mtime", "ac_bytes", young.alias("young"))
    # (mtime, cache_key) is the order; a buffered entry stands after all others.
    place = F.struct(F.col("young").alias("y"), F.col("mtime").alias("m"), F.col("cache_key").alias("k"))
    uses = refs.select("cache_key", "hash").distinct().join(aged, "cache_key")
    last = uses.groupBy("hash").agg(F.max(place).alias("at")).where(~F.col("at.y"))
    freed = last.join(blobs.select("hash", "size"), "hash").groupBy(F.col("at.k").alias("cache_key")).agg(F.sum("size").alias("blob_bytes"))
    gains = aged.where(~F.col("young")).join(freed, "cache_key", "left").select("cache_key", "mtime", (F.col("ac_bytes") + F.coalesce("blob_bytes", F.lit(0))).alias("gain"))
    total = entries.agg(F.coalesce(F.sum("ac_bytes"), F.lit(0)).alias("a")).crossJoin(blobs.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"))).select((F.col("a") + F.col("b") + extra_bytes).alias("initial"))
    ordered = _bucketed_prefix(gains, F.date_trunc("day", "mtime"), [F.col("mtime"), F.col("cache_key")], {"gain": F.col("gain")})
    return ordered.crossJoin(F.broadcast(total)).where(F.col("initial") - F.col("before_gain") > target_bytes).select("cache_key", "mtime", "gain", F.col("before_gain").alias("freed_before"))


def eviction_report(plan: DataFrame, initial_bytes: int) -> DataFrame:
    freed = F.coalesce(F.sum("gain"), F.lit(0))
    return plan.agg(F.count(F.lit(1)).alias("entries_evicted"), freed.alias("bytes_freed"), (F.lit(initial_bytes) - freed).alias("bytes_remaining"))


def needs_eviction(current: int, max_bytes: int, above_pct: int = 100, target_pct: int = 80, any_failed: bool = False) -> int | None:
    """The size to evict to after a build, or None."""
    if any_failed or not max_bytes or current <= max_bytes * above_pct // 100:
        return None
    return max_bytes * target_pct // 100


def clean_selection(entries: DataFrame, target_glob: str | None = None, older_than: Column | None = None) -> DataFrame:
    """Entries of a selective clean: target label by a glob that crosses ``/``, and mtime at or before a time."""
    from ..functions import globs

    rows = entries
    if target_glob is not None:
        rows = rows.where(globs.matches(F.col("target_id"), target_glob, globs.RAW))
    return rows if older_than is None else rows.where(F.col("mtime") <= older_than)


def clean_report(selected: DataFrame, preview: int = 20) -> tuple[DataFrame, DataFrame]:
    """(entries, bytes) in one row, and the first few entries."""
    totals = selected.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("ac_bytes"), F.lit(0)).alias("bytes"))
    return totals, selected.orderBy("target_id", "cache_key").limit(preview)


def stats(files: DataFrame) -> DataFrame:
    """area (ac, cas, log, ..., total), files, bytes of files (area, size)."""
    rolled = files.rollup("area").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.grouping("area").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "total").otherwise(F.col("area")).alias("area"), "files", "bytes")


def upload_batches(entries: DataFrame, refs: DataFrame, remote_blobs: DataFrame, blobs: DataFrame, max_blob_bytes: int = 500_000_000) -> tuple[DataFrame, DataFrame]:
    """Blobs to write first, then entries: an entry goes only if each of its blobs is there or is small enough to go."""
    wanted = refs.join(blobs.select("hash", "size"), "hash", "left").join(remote_blobs.select("hash", F.lit(True).alias("there")), "hash", "left")
    fits = F.coalesce(F.col("there"), F.lit(False)) | F.coalesce(F.col("size") <= max_blob_bytes, F.lit(False))
    blocked = wanted.where(~fits).select("cache_key").distinct()
    going = entries.join(blocked, "cache_key", "left_anti")
    first = wanted.where(F.col("there").isNull()).join(going.select("cache_key"), "cache_key", "left_semi").select("hash", "size").distinct()
    return first, going
