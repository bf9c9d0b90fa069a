"""Build relations projected from the driver's tables, so that every operator has data of known size and shape.

Customers and suppliers are targets of packages region/nation; parts form a deep chain (k needs k div 2) and orders a
diamond over parts, suppliers, customers, nations and regions; documents are files; orders are cache entries and
lineitem what they refer to; events are changes and engine events; conversations are logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packages(spark: SparkSession, d: str) -> DataFrame:
    """nationkey, package."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    name = F.concat(F.lower("r_name"), F.lit("/"), F.lower("n_name"))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nationkey"), name.alias("package"))


def targets(spark: SparkSession, d: str) -> DataFrame:
    """label, package, name, tags, test: a target for each customer; every 50th is tagged manual."""
    rows = table(spark, d, "customer").join(packages(spark, d), F.col("c_nationkey") == F.col("nationkey"))
    manual = F.when(F.col("c_custkey") % 50 == 0, F.array(F.lower("c_mktsegment"), F.lit("manual"))).otherwise(F.array(F.lower("c_mktsegment")))
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    return rows.select(F.concat(F.lit("//"), "package", F.lit(":"), name).alias("label"), "package", name.alias("name"), manual.alias("tags"), (F.col("c_acctbal") < 0).alias("test"))


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """parent, dep: part k needs part k div 2."""
    k = F.col("p_partkey")
    at = lambda c: F.concat(F.lit("//part:p"), c.cast("string"))
    return table(spark, d, "part").where("p_partkey > 1").select(at(k).alias("parent"), at(F.floor(k / 2)).alias("dep"))


def part_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("//part:p"), F.col("p_partkey").cast("string")).alias("label"))


def diamond_edges(spark: SparkSession, d: str) -> DataFrame:
    """parent, dep over orders, parts, suppliers, customers, nations and regions."""
    label = lambda kind, c: F.concat(F.lit(f"//{kind}:"), F.col(c).cast("string"))
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    edge = lambda df, a, ca, b, cb: df.select(label(a, ca).alias("parent"), label(b, cb).alias("dep")).distinct()
    return (
        edge(items, "order", "l_orderkey", "part", "l_partkey")
        .unionByName(edge(items, "order", "l_orderkey", "supplier", "l_suppkey"))
        .unionByName(edge(orders, "order", "o_orderkey", "customer", "o_custkey"))
        .unionByName(edge(table(spark, d, "supplier"), "supplier", "s_suppkey", "nation", "s_nationkey"))
        .unionByName(edge(table(spark, d, "customer"), "customer", "c_custkey", "nation", "c_nationkey"))
        .unionByName(edge(table(spark, d, "nation"), "nation", "n_nationkey", "region", "n_regionkey"))
    )


def files(spark: SparkSession, d: str) -> DataFrame:
    """path, content."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, d, "documents").select(path.alias("path"), F.col("text").alias("content"))


def file_inputs(spark: SparkSession, d: str) -> DataFrame:
    """label, glob: parts read the files of one source and language, some a single file."""
    k = F.col("p_partkey")
    lang = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (k % 4 + 1).cast("int"))
    source = F.concat(F.lit("src"), (k % 20).cast("string"))
    literal = F.concat(source, F.lit("/"), lang, F.lit("/"), k.cast("string"), F.lit(".txt"))
    deep, flat = F.concat(source, F.lit("/**/"), (k % 10).cast("string"), F.lit("*.txt")), F.concat(source, F.lit("/"), lang, F.lit("/*.txt"))
    glob = F.when(k % 3 == 0, literal).when(k % 3 == 1, flat).otherwise(deep)
    return table(spark, d, "part").where("p_partkey >= 1").select(F.concat(F.lit("//part:p"), k.cast("string")).alias("label"), glob.alias("glob"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """cache_key, mtime, ac_bytes, exit_code, duration_ms."""
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        key.alias("cache_key"), F.col("o_orderdate").alias("mtime"), (key % 400 + 100).alias("ac_bytes"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("exit_code"),
        F.floor("o_totalprice").cast("bigint").alias("duration_ms"),
    )


def refs(spark: SparkSession, d: str) -> DataFrame:
    """cache_key, hash, repeats kept."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cache_key"), F.col("l_partkey").alias("hash"))


def blobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("hash"), (F.col("p_size") * 100).cast("bigint").alias("size"))


def results(spark: SparkSession, d: str) -> DataFrame:
    """build, id, result, seq: engine results from events."""
    kinds = F.create_map(*(F.lit(x) for x in ("view", "built", "signup", "cache_hit", "click", "remote_cache_hit", "purchase", "external_cache_hit", "error", "failed")))
    rows = table(spark, d, "events")
    return rows.select(F.date_format("ts", "yyyy-MM-dd").alias("build"), F.col("user_id").alias("id"), kinds[F.col("event_type")].alias("result"), F.col("event_id").alias("seq"))


def changes(spark: SparkSession, d: str) -> DataFrame:
    """key, ts, path. The parquet times have no zone and are read as UTC, whatever zone the session has."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.timestamp_micros(us).alias("ts"), F.get_json_object("props", "$.k").alias("path"))


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """id, stream, seq, line."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("role").alias("stream"), F.col("turn").alias("seq"), F.col("text").alias("line"))
