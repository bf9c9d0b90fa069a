"""Running targets: each is a query or a callable, looked up by content key before it runs.

The plan (levels, keys, lookups) is relational; the driver walks levels, submits a level's misses to a thread pool, so
their Spark jobs run at once, and keeps one status for each target.
"""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Action = str | Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


@dataclass
class Target:
    """command: SQL over its dependencies' results (views named by alias), or a callable over them."""

    label: str
    command: Action
    deps: dict[str, str] = field(default_factory=dict)
    inputs: dict[str, DataFrame] = field(default_factory=dict)
    test: bool = False
    cache: bool | None = None
    exists: Callable[[], bool] | None = None
    timeout_secs: float | None = None

    @property
    def cacheable(self) -> bool:
        return (not self.test) if self.cache is None else self.cache

    @property
    def recipe(self) -> str:
        return self.command if isinstance(self.command, str) else f"{self.command.__module__}.{self.command.__qualname__}"


@dataclass
class Result:
    label: str
    result: str
    key: str = ""
    outputs_hash: str = ""
    duration_ms: int = 0
    error: str | None = None


def rows_hash(df: DataFrame) -> str:
    """A hash of a result as a bag of rows, whatever its partitioning: the sums of halves of row hashes and the count."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    digest = F.sha2(text, 256)
    sums = (F.sum(F.conv(F.substring("_d", at, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{at}") for at in (1, 16, 31, 46))
    row = df.select(digest.alias("_d")).agg(*sums, F.count(F.lit(1)).alias("n"))
    return row.select(F.sha2(F.concat_ws("|", *row.columns, F.lit(df.schema.simpleString())), 256)).first()[0]


class Scheduler:
    """Builds targets with results stored by key under a folder; at most parallelism run at once."""

    def __init__(self, spark: SparkSession, store: str, parallelism: int = 4):
        self.spark, self.store, self.parallelism = spark, store.rstrip("/"), parallelism
        self.events: list[dict] = []

    def _path(self, key: str) -> str:
        return f"{self.store}/{key[:2]}/{key}"

    def _stored(self, key: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(key) + "/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    @staticmethod
    def key_of(target: Target, done: dict[str, Result], inputs: dict[str, str]) -> str:
        import hashlib

        parts = ["v3", target.recipe, *(f"{k}={v}" for k, v in sorted(inputs.items())), *sorted(f"{a}={done[d].outputs_hash}" for a, d in target.deps.items())]
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()

    def build(self, targets: list[Target], wanted: list[str] | None = None, fresh: bool = False) -> dict[str, Result]:
        """Results by label of wanted targets and what they need. A target fails without stopping others; what needs
        it is skipped, and the reason names its first dependency that failed or was skipped."""
        by_label = {t.label: t for t in targets}
        needed, stack = set(), list(wanted if wanted is not None else by_label)
        while stack:
            label = stack.pop()
            if label not in needed:
                needed.add(label)
                stack += by_label[label].deps.values()
        done: dict[str, Result] = {}
        with ThreadPoolExecutor(self.parallelism) as pool:
            while len(done) < len(needed):
                ready = sorted(x for x in needed if x not in done and all(d in done for d in by_label[x].deps.values()))
                if not ready:
                    raise ValueError(f"dependency cycle through {min(needed - set(done))}")
                for result in pool.map(lambda x: self._one(by_label[x], done, fresh), ready):
                    done[result.label] = result
        return done

    def _one(self, target: Target, done: dict[str, Result], fresh: bool) -> Result:
        bad = sorted(d for d in target.deps.values() if done[d].result in ("failed", "skipped"))
        if bad:
            return self._finish(Result(target.label, "skipped", error=f"dependency {bad[0]} did not succeed"))
        began = time.monotonic()
        key = ""
        try:
            key = self.key_of(target, done, {name: rows_hash(df) for name, df in target.inputs.items()})
            self.events.append({"t": "target.started", "id": target.label, "cache_key": key})
            if not fresh and target.cacheable and self._stored(key):
                return self._finish(Result(target.label, "cache_hit", key, rows_hash(self.read(key))))
            if not fresh and target.exists and target.exists():
                import hashlib

                return self._finish(Result(target.label, "external_cache_hit", key, hashlib.sha256(b"").hexdigest()))
            frames = target.inputs | {alias: self.read(done[d].key) for alias, d in target.deps.items() if done[d].key and done[d].result != "external_cache_hit"}
            if target.timeout_secs is not None:
                self.spark.sparkContext.setJobGroup(f"build {target.label}", target.label, interruptOnCancel=True)
            out = self.spark.sql(target.command, **frames) if isinstance(target.command, str) else target.command(self.spark, frames)
            out.write.mode("overwrite").parquet(self._path(key))
            took = int((time.monotonic() - began) * 1000)
            if target.timeout_secs is not None and took > target.timeout_secs * 1000:
                return self._finish(Result(target.label, "failed", key, duration_ms=took, error="timeout"))
            return self._finish(Result(target.label, "built", key, rows_hash(self.read(key)), took))
        except Exception as e:  # noqa: BLE001  a failed target is a result
            return self._finish(Result(target.label, "failed", key, duration_ms=int((time.monotonic() - began) * 1000), error=f"{e}\n{traceback.format_exc(limit=1)}"))

    def _finish(self, result: Result) -> Result:
        self.events.append({"t": "target.finished", "id": result.label, "result": result.result, "duration_ms": result.duration_ms, "error": result.error})
        return result

    def read(self, key: str) -> DataFrame:
        return self.spark.read.parquet(self._path(key))


def summary(results: dict[str, Result]) -> dict[str, int | bool]:
    kinds = [r.result for r in results.values()]
    hits = sum(k.endswith("cache_hit") for k in kinds)
    return {"built": kinds.count("built"), "cache_hit": hits, "failed": kinds.count("failed"), "skipped": kinds.count("skipped"), "ok": "failed" not in kinds}
