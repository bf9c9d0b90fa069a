"""Files, cached entries and event lines as tables, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing

ENTRY_SCHEMA = (
    "cache_key string, target_id string, command string, cwd string, outputs array<struct<path: string, content_hash: string, size: bigint, executable: boolean, mode: string>>, "
    "outputs_content_hash string, stdout_blob string, stderr_blob string, exit_code int, duration_ms bigint, built_at string, _corrupt_record string"
)
EVENT_SCHEMA = (
    "t string, build string, id string, stream string, line string, truncated boolean, result string, duration_ms bigint, exit_code int, error string, cache_key string, command string, "
    "command_id string, selection array<string>, target_ids array<string>, parallelism int, ok boolean, counts struct<built: int, cache_hit: int, failed: int, skipped: int>, "
    "outputs array<string>, paths array<string>, package string, config string, tags array<string>, test boolean, inputs array<string>, deps array<string>, base string, message string, reason string, "
    "version string, protocol int, workspace string, capabilities array<string>, target string"
)
COMMAND_SCHEMA = "c string, command_id string, targets array<string>, fresh boolean, base string, globs array<string>, key string, build string, target string, follow boolean"
PROTOCOL = 2


def scan_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path (below folder), content_hash, size, mtime of every file; contents are hashed where they are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    base = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/"
    below = F.regexp_replace(F.regexp_replace("path", r"\A[a-z]+:(//)?(?=/)", ""), r"\A/+", "/")
    return rows.select(F.substr(below, F.lit(len(base) + 1)).alias("path"), hashing.content_hash(F.col("content")).alias("content_hash"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def read_entries(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(entries with mtime and ac_bytes, paths of unreadable ones) of a folder of JSON entries."""
    meta = F.col("_metadata")
    rows = spark.read.schema(ENTRY_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", "true").option("multiLine", "true").json(folder)
    rows = rows.select("*", meta["file_path"].alias("file"), meta["file_modification_time"].alias("mtime"), meta["file_size"].alias("ac_bytes"))
    good = F.col("_corrupt_record").isNull() & F.col("cache_key").isNotNull()
    return rows.where(good).drop("_corrupt_record"), rows.where(~good).select("file")


def parse_lines(lines: DataFrame, schema: str = EVENT_SCHEMA, tag: str = "t") -> DataFrame:
    """Structured rows of JSON lines (value); blank and unreadable lines, and those without a tag, go."""
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("e"))
    return parsed.select("e.*").where(F.col(tag).isNotNull())


def read_commands(lines: DataFrame) -> DataFrame:
    """Commands with their defaults; works on a batch and on a stream."""
    rows = parse_lines(lines, COMMAND_SCHEMA, "c")
    return rows.withColumns({"targets": F.coalesce("targets", F.array().cast("array<string>")), "globs": F.coalesce("globs", F.array().cast("array<string>")), "fresh": F.coalesce("fresh", F.lit(False)), "follow": F.coalesce("follow", F.lit(False))})


def to_lines(events: DataFrame) -> DataFrame:
    """value: JSON lines without empty fields."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def correlate(commands: DataFrame, replies: DataFrame) -> DataFrame:
    """command_id, c, reply of commands that ask for one; those without an id get none."""
    asked = commands.where("command_id IS NOT NULL").select("command_id", "c")
    answers = replies.where(F.col("t").isin("command.accepted", "command.rejected", "command.error")).select("command_id", F.col("t").alias("reply"), F.coalesce("reason", "message").alias("detail"))
    return asked.join(answers, "command_id", "left")


def write_last_failures(failed: DataFrame, folder: str) -> None:
    """Overwrites the labels of the latest build's failures; none leaves an empty list."""
    failed.select("id").coalesce(1).write.mode("overwrite").json(folder)


def read_last_failures(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "id string")
    return spark.read.schema("id string").json(folder)
