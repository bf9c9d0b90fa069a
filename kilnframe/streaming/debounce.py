"""Streams of changes: debounced batches, subscriptions that speak when something changed, and their sinks.

Time is event time. The watermark closes batches: one is emitted when the watermark passes its flush time, so allowed
lateness adds to the delay, and rows later than that are dropped. Rows of a key that arrive in order within the
watermark give exactly the batches of operators.events.debounce.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship

QUIET_MS, MAX_MS = 100, 500
SUBSCRIPTION_QUIET_MS, SUBSCRIPTION_MAX_MS = 200, 800

_BATCH = "key string, batch bigint, first_us bigint, last_us bigint, flushed_us bigint, paths array<string>"
_STATE = "number bigint, first_us bigint, last_us bigint, paths array<string>"


def debounce_stream(changes: DataFrame, key: str, ts: str, path: str, quiet_ms: int = QUIET_MS, max_ms: int = MAX_MS, lateness: str = "0 seconds") -> DataFrame:
    """Batches of a stream (key, ts timestamp, path), in append mode."""
    quiet, most = quiet_ms * 1000, max_ms * 1000

    def fold(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, first, last, paths = state.get if state.exists else (0, None, None, [])
        out, paths = [], set(paths)
        flush = lambda: min(last + quiet, first + most)

        def close() -> None:
            nonlocal first
            out.append((name[0], number, first, last, flush(), sorted(paths)))
            first = None

        if state.hasTimedOut:
            if first is not None:
                close()
        else:
            rows = pd.concat(frames).sort_values("us")
            for us, changed in zip(rows["us"], rows["path"], strict=True):
                if first is not None and us >= flush():
                    close()
                if first is None:
                    number, first, paths = number + 1, int(us), set()
                last = int(us)
                paths.add(changed)
        if first is None:
            state.update((number, None, None, []))
        else:
            state.update((number, first, last, sorted(paths)))
            state.setTimeoutTimestamp(max(flush() // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "batch", "first_us", "last_us", "flushed_us", "paths"])

    ship(changes.sparkSession)
    timed = changes.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"), F.col(path).alias("path")).withWatermark("ts", lateness)
    return timed.groupBy("key").applyInPandasWithState(fold, _BATCH, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest_state_stream(events: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last event of each key so far; for update or complete mode."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("e")).select(*keys, "e.*")


def log_ring_stream(lines: DataFrame, key: str, order: str = "seq", text: str = "line", size: int = 500) -> DataFrame:
    """The last size lines of each key so far, with how many were dropped; for update mode."""

    def fold(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, ring = state.get if state.exists else (0, [])
        rows = pd.concat(frames).sort_values("seq")
        ring = (list(ring) + rows["line"].tolist())[-size:]
        seen += len(rows)
        state.update((seen, ring))
        yield pd.DataFrame([(name[0], ring, seen - len(ring))], columns=["key", "lines", "dropped"])

    ship(lines.sparkSession)
    rows = lines.select(F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("seq"), F.col(text).alias("line"))
    return rows.groupBy("key").applyInPandasWithState(fold, "key string, lines array<string>, dropped bigint", "seen bigint, ring array<string>", "update", GroupStateTimeout.NoTimeout)


def changed_only_stream(sets: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows (key, order, value) whose value differs from the key's last; a null value lets the next through."""

    def fold(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (None,)
        out = []
        for at, now in pd.concat(frames).sort_values("at")[["at", "value"]].itertuples(index=False):
            if now is not None and now != last:
                out.append((name[0], at, now))
            last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "at", "value"])

    ship(sets.sparkSession)
    rows = sets.select(F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("at"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(fold, "key string, at bigint, value string", "last string", "append", GroupStateTimeout.NoTimeout)


def affected_subscription(catalog_inputs: DataFrame, edges: DataFrame, selection: DataFrame | None, emit: Callable[[int, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over debounced batches: hands on what each batch affects (within a selection) unless it equals
    what was handed on last."""
    from ..operators import selection as select

    last: list[str | None] = [None]

    def each(batch: DataFrame, number: int) -> None:
        changed = batch.select(F.explode("paths").alias("path")).distinct()
        found = select.affected(changed, catalog_inputs, edges).select("label")
        if selection is not None:
            found = found.join(selection.select("label"), "label", "left_semi")
        digest = found.agg(F.sha2(F.array_join(F.array_sort(F.collect_set("label")), "\n"), 256)).first()[0]
        if digest != last[0]:
            last[0] = digest
            emit(number, found.orderBy("label"))

    return each


def upload_sink(blob_path: str, entry_path: str, stored_blobs: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over new entries (cache_key, refs: array of (hash, size)): blobs are written before the entries
    that refer to them, so a reader never finds an entry without its blobs.

    Each batch has a folder of its own below either path, named by its number, and one that was written whole is not
    written again, so a batch that is replayed adds nothing. Both paths belong to one query and its checkpoint.
    """

    def whole(spark: SparkSession, folder: str) -> bool:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def each(batch: DataFrame, number: int) -> None:
        blob_folder, entry_folder = f"{blob_path}/batch={number}", f"{entry_path}/batch={number}"
        batch = batch.persist()
        if not whole(batch.sparkSession, blob_folder):
            blobs = batch.select(F.explode("refs").alias("b")).select("b.hash", "b.size").distinct().join(stored_blobs().select("hash"), "hash", "left_anti")
            blobs.write.mode("overwrite").parquet(blob_folder)
        if not whole(batch.sparkSession, entry_folder):
            batch.select("cache_key").write.mode("overwrite").parquet(entry_folder)
        batch.unpersist()

    return each


def command_stream(lines: DataFrame) -> DataFrame:
    """Commands of a text stream; unreadable lines are passed over."""
    from ..sources.files import read_commands

    return read_commands(lines)


def config_changes(paths: DataFrame, stem: str = "kiln") -> DataFrame:
    """Changes of primary files alone, which call for a reload."""
    return paths.where(F.element_at(F.split("path", "/"), -1).isin(f"{stem}.yaml", f"{stem}.json"))
