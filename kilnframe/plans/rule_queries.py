"""Further queries over the bridge relations: rules, listings, early cutoff, orders and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, labels, text
from ..operators import events, generate, graph, keys, selection, tasks
from ..sources import bridge as b
from ..sources import catalog
from ..streaming import debounce
from .queries import _SQL_HEAD, _SQL_MARK, SQL_FILES, SQL_INPUTS, SQL_TARGETS, _recipes, query
from .scratch import cut

_PART = "'//part:p' || p_partkey"


# selection ---------------------------------------------------------------------------------------------------------------
@query(rf"""
WITH RECURSIVE {SQL_FILES}, {SQL_INPUTS},
direct AS (SELECT DISTINCT k FROM i JOIN f ON starts_with(path, src || '/') AND regexp_full_match(path, re) AND path LIKE 'src5/%'),
r AS (SELECT k FROM direct UNION SELECT p_partkey FROM part JOIN r ON p_partkey // 2 = r.k WHERE p_partkey > 1)
SELECT {_PART} AS label FROM part JOIN r ON p_partkey = k WHERE p_size % 2 = 0""")
def selected_and_affected(spark: SparkSession, d: str) -> DataFrame:
    """Of the parts of even size, those that changes of one source reach."""
    chosen = b.table(spark, d, "part").where("p_size % 2 = 0").select(F.concat(F.lit("//part:p"), F.col("p_partkey").cast("string")).alias("label"))
    changed = b.files(spark, d).where(F.col("path").startswith("src5/")).select("path")
    return selection.selected_and_affected(chosen, selection.affected(changed, b.file_inputs(spark, d), b.part_edges(spark, d)))


@query("SELECT DISTINCT source || '/' || doc_id AS path FROM documents")
def explicit_changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files named outright win over a diff, and lose the workspace's prefix."""
    k = F.col("doc_id")
    path = F.concat("source", F.lit("/"), k.cast("string"))
    docs = b.table(spark, d, "documents")
    named = docs.select(F.when(k % 2 == 0, F.concat(F.lit("/work/space/"), path)).otherwise(path).alias("path"))
    return selection.resolve_changed_files("/work/space", explicit=named, since=docs.select(F.lit("never").alias("path")))


@query("SELECT source || '/' || name AS path FROM (SELECT source, CASE doc_id % 4 WHEN 0 THEN 'kiln.yaml' WHEN 1 THEN 'kiln.gen.json' WHEN 2 THEN 'kiln.json' ELSE 'readme.md' END AS name FROM documents) WHERE name IN ('kiln.yaml', 'kiln.json')")
def config_reloads(spark: SparkSession, d: str) -> DataFrame:
    """Changes that call for a reload."""
    k = F.col("doc_id") % 4
    name = F.when(k == 0, "kiln.yaml").when(k == 1, "kiln.gen.json").when(k == 2, "kiln.json").otherwise("readme.md")
    return debounce.config_changes(b.table(spark, d, "documents").select(F.concat("source", F.lit("/"), name).alias("path")))


# graph -------------------------------------------------------------------------------------------------------------------
@query("""
WITH RECURSIVE r AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 7 = 0 UNION SELECT k // 2 FROM r WHERE k > 1),
l AS (SELECT k, 0 AS level FROM r WHERE k <= 1 UNION ALL SELECT r.k, level + 1 FROM r JOIN l ON r.k // 2 = l.k WHERE r.k > 1)
SELECT '//part:p' || k AS label, level::INTEGER AS level FROM l""")
def subgraph_order(spark: SparkSession, d: str) -> DataFrame:
    """What every seventh part needs, in build order."""
    seeds = b.part_labels(spark, d).where(F.regexp_extract("label", r"(\d+)$", 1).cast("long") % 7 == 0)
    return graph.subgraph_order(b.part_labels(spark, d), b.part_edges(spark, d), seeds)


@query("""
WITH RECURSIVE r AS (SELECT p_partkey AS k, 0 AS level FROM part WHERE p_partkey <= 1 UNION ALL SELECT p_partkey, level + 1 FROM part JOIN r ON p_partkey // 2 = r.k WHERE p_partkey > 1)
SELECT '//part:p' || k AS label, level::INTEGER AS level FROM r""")
def service_start_levels(spark: SparkSession, d: str) -> DataFrame:
    """Services that need one another start level by level."""
    return tasks.start_levels(b.part_labels(spark, d), b.part_edges(spark, d).select(F.col("parent").alias("label"), F.col("dep").alias("ref")))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'image' WHEN 2 THEN 'image' WHEN 3 THEN 'test' ELSE 'default' END AS class FROM part")
def node_classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    tag = lambda *t: F.array(F.lower("p_brand"), *map(F.lit, t))
    tags = F.when(k == 0, tag("unittest")).when(k == 1, tag("docker-image")).when(k == 2, tag("containers")).when(k == 3, tag("image", "testing")).otherwise(tag("lib"))
    return b.table(spark, d, "part").select("p_partkey", graph.node_class(tags).alias("class"))


# keys --------------------------------------------------------------------------------------------------------------------
_KEY0 = f"sha256(unhex({_SQL_HEAD} || '{_SQL_MARK['dep_outputs']}'))"


@query(f"""
WITH RECURSIVE e AS (SELECT {_KEY0} AS key0, max(sha256('o' || p_partkey % 5)) AS outputs_hash FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
r AS (
  SELECT p_partkey AS k, {_KEY0} AS cache_key, e.outputs_hash FROM part LEFT JOIN e ON key0 = {_KEY0} WHERE p_partkey <= 1
  UNION ALL
  SELECT x.k, x.cache_key, e.outputs_hash FROM (
    SELECT p_partkey AS k, CASE WHEN r.outputs_hash IS NULL THEN {_KEY0} ELSE sha256(unhex({_SQL_HEAD} || '{_SQL_MARK['dep_outputs']}' || r.outputs_hash || '00')) END AS cache_key
    FROM part JOIN r ON p_partkey // 2 = r.k WHERE p_partkey > 1) x LEFT JOIN e ON key0 = x.cache_key)
SELECT '//part:p' || k AS label, cache_key, outputs_hash FROM r""")
def early_cutoff_keys(spark: SparkSession, d: str) -> DataFrame:
    """A dependency adds its cached outputs to a key, not its own key. Every third part has a result under the key it has
    without dependencies, so parts above one with a result have none. Parts of equal recipes share a key and its result."""
    recipes, edges = cut(_recipes(spark, d)), cut(b.part_edges(spark, d))
    no_files = spark.createDataFrame([], "label string, path string, content_hash string")
    alone = keys.keyed(recipes, no_files, spark.createDataFrame([], "label string, outputs_hash string"), "linux")
    k = F.regexp_extract("label", r"(\d+)$", 1).cast("long")
    entries = alone.where(k % 3 == 0).select("cache_key", F.sha2(F.concat(F.lit("o"), (k % 5).cast("string")), 256).alias("outputs_content_hash"), F.lit(0).alias("exit_code"))
    return keys.resolve_keys(recipes, no_files, edges, entries, "linux")


@query("SELECT c_custkey, coalesce(CASE c_custkey % 3 WHEN 1 THEN TRUE WHEN 2 THEN FALSE END, NOT c_acctbal < 0) AS cacheable FROM customer")
def cacheable_targets(spark: SparkSession, d: str) -> DataFrame:
    cache = F.when(F.col("c_custkey") % 3 == 1, True).when(F.col("c_custkey") % 3 == 2, False)
    return b.table(spark, d, "customer").select("c_custkey", labels.is_cacheable(cache, F.col("c_acctbal") < 0).alias("cacheable"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(sha256(p_name)) END AS bytes FROM part")
def decoded_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hex of the bytes of well-formed hashes."""
    whole = F.sha2("p_name", 256)
    given = F.when(F.col("p_partkey") % 3 == 0, whole).when(F.col("p_partkey") % 3 == 1, F.substring(whole, 1, 62)).otherwise(F.concat(F.substring(whole, 1, 63), F.lit("x")))
    return b.table(spark, d, "part").select("p_partkey", F.hex(hashing.decode_hash(given)).alias("bytes"))


# rules and listings ------------------------------------------------------------------------------------------------------
@query("""
SELECT 'task name' AS rule, n_name AS subject FROM nation WHERE n_nationkey % 6 = 1
UNION ALL SELECT 'empty command', n_name FROM nation WHERE n_nationkey % 6 = 2
UNION ALL SELECT 'does nothing', n_name FROM nation WHERE n_nationkey % 6 = 4
UNION ALL SELECT 'service name', r_name FROM region WHERE r_regionkey % 2 = 1
UNION ALL SELECT 'empty command', r_name FROM region WHERE r_regionkey % 3 = 2
UNION ALL SELECT 'unknown task', n_name || ' -> ' || n_name || '?' FROM nation WHERE n_nationkey % 4 = 0
UNION ALL SELECT 'unknown service', n_name || ' -> ' || n_name FROM nation WHERE n_nationkey % 4 = 1
UNION ALL SELECT 'needs itself', n_name FROM nation WHERE n_nationkey % 4 = 2""")
def task_violations(spark: SparkSession, d: str) -> DataFrame:
    """Nations as tasks, regions as services, with every kind of fault. Without a command a task may still run services."""
    k = F.col("n_nationkey")
    nation, region = b.table(spark, d, "nation"), b.table(spark, d, "region")
    named = F.when(k % 6 == 1, "1 bad").otherwise("fine")
    mine = nation.select(F.col("n_name").alias("label"), named.alias("name"), F.when(k % 6 == 2, "").when((k % 6).isin(3, 4), None).otherwise("make").alias("command"))
    r = F.col("r_regionkey")
    services = region.select(F.col("r_name").alias("label"), F.when(r % 2 == 1, "a/b").otherwise("db").alias("name"), F.when(r % 3 == 2, None).otherwise("serve").alias("command"))
    kind = F.when(k % 4 == 0, "finally").when(k % 4 == 2, "needs").otherwise("services")
    ref = F.when(k % 4 == 0, F.concat("n_name", F.lit("?"))).when(k % 4 == 3, F.col("r_name")).otherwise(F.col("n_name"))
    refs = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("label"), kind.alias("kind"), ref.alias("ref"))
    return tasks.violations(mine, services, refs)


@query("""
SELECT 3 AS phase, 0 AS pos, 'command' AS kind, '//t' AS ref
UNION ALL SELECT CASE n_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END, n_nationkey::INTEGER, CASE n_nationkey % 4 WHEN 0 THEN 'deps' WHEN 1 THEN 'services' WHEN 2 THEN 'needs' ELSE 'finally' END, n_name FROM nation
UNION ALL SELECT 5, -n_nationkey::INTEGER, 'stop', n_name FROM nation WHERE n_nationkey % 4 = 1""")
def task_run_order(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    kind = F.when(k % 4 == 0, "deps").when(k % 4 == 1, "services").when(k % 4 == 2, "needs").otherwise("finally")
    refs = b.table(spark, d, "nation").select(F.lit("//t").alias("label"), k.cast("int").alias("pos"), kind.alias("kind"), F.col("n_name").alias("ref"))
    return tasks.run_order(refs, "//t")


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return b.targets(spark, d).select("label", F.when(F.col("test"), F.concat(F.lit("tests "), "name")).alias("description"))


@query(f"WITH {SQL_TARGETS} SELECT label AS text FROM t")
def task_listing(spark: SparkSession, d: str) -> DataFrame:
    return tasks.listing(_listed(spark, d))


@query(f"WITH {SQL_TARGETS} SELECT '{{\"label\":\"' || label || '\"' || CASE WHEN test THEN ',\"description\":\"tests ' || name || '\"' ELSE '' END || '}}' AS text FROM t")
def task_listing_json(spark: SparkSession, d: str) -> DataFrame:
    return tasks.listing(_listed(spark, d), "json")


@query(f"WITH {SQL_TARGETS} SELECT rpad(label, 40, ' ') || CASE WHEN test THEN 'tests ' || name ELSE '' END AS text FROM t")
def task_listing_text(spark: SparkSession, d: str) -> DataFrame:
    return tasks.listing(_listed(spark, d), "text")


@query("""
WITH t AS (SELECT p_type AS package, CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'a/' || p_partkey ELSE p_name END AS name, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'make' END AS command, p_partkey FROM part),
s AS (SELECT *, '//' || package || ':' || name AS subject FROM t)
SELECT 'empty name' AS rule, subject FROM s WHERE name = ''
UNION ALL SELECT 'name with a separator', subject FROM s WHERE regexp_matches(name, '[/:]')
UNION ALL SELECT 'duplicate name', subject FROM s GROUP BY subject HAVING count(*) > 1
UNION ALL SELECT 'empty command', subject FROM s WHERE command = ''
UNION ALL SELECT 'nothing to cache', subject FROM s WHERE p_partkey % 5 = 0
UNION ALL SELECT 'output outside the workspace', subject FROM s WHERE p_partkey % 5 = 1""")
def target_violations(spark: SparkSession, d: str) -> DataFrame:
    """Parts as declared targets, with every kind of fault."""
    k = F.col("p_partkey")
    raw = b.table(spark, d, "part").select(
        F.col("p_type").alias("package"), F.when(k % 9 == 0, "").when(k % 9 == 1, F.concat(F.lit("a/"), k.cast("string"))).otherwise(F.col("p_name")).alias("name"),
        F.when(k % 7 == 0, "").otherwise("make").alias("command"), F.lit(None).cast("boolean").alias("cache"), F.lit(False).alias("test"), F.lit(None).cast("string").alias("exists"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(F.lit("out"), F.lit("../up"))).otherwise(F.array(F.lit("out"))).alias("outputs"),
    )
    return catalog.violations(raw)


@query("""
SELECT '//' || p_type || ':' || p_partkey AS label, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_type || '/sub' END AS cwd, 'root.txt,' || p_type || '/in/' || p_partkey AS inputs,
       '//' || p_type || ':b,//x:a' AS deps, p_partkey % 4 <> 0 AS cacheable FROM part""")
def emitted_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets as a generator emits them, resolved in their packages."""
    k = F.col("p_partkey")
    n = lambda kind: F.lit(None).cast(kind)
    emitted = b.table(spark, d, "part").select(
        F.col("p_type").alias("package"), k.cast("string").alias("name"), F.lit("make").alias("command"), F.when(k % 2 == 0, "").otherwise("sub").alias("cwd"),
        F.array(F.lit("//root.txt"), F.concat(F.lit("in/"), k.cast("string"))).alias("inputs"), F.array(F.lit("out")).alias("outputs"), F.array(F.lit("//x:a"), F.lit(":b"), F.lit("b")).alias("deps"),
        F.create_map(F.lit("A"), F.lit("1")).alias("env"), n("boolean").alias("cache"), F.lit(True).alias("remote_cache"), F.lit(False).alias("network"), F.lit(True).alias("sandbox"), n("string").alias("exists"),
        n("int").alias("timeout_secs"), (k % 4 == 0).alias("test"), F.array(F.lit("t")).alias("tags"),
    )
    rows = generate.resolve_emitted(emitted)
    return rows.select("label", "cwd", F.array_join("inputs", ",").alias("inputs"), F.array_join("deps", ",").alias("deps"), "cacheable")


# events and texts --------------------------------------------------------------------------------------------------------
@query("SELECT event_id AS seq, event_type AS t FROM events WHERE event_id <= (SELECT coalesce(min(event_id), 9223372036854775807) FROM events WHERE event_type = 'error' AND event_id > 1000)")
def until_terminal(spark: SparkSession, d: str) -> DataFrame:
    """Events up to the first that ends a command."""
    k = F.col("event_id")
    rows = b.table(spark, d, "events").select(k.alias("seq"), F.when((F.col("event_type") == "error") & (k > 1000), "end").otherwise(F.col("event_type")).alias("t"))
    return events.until_terminal(rows, ["end"]).select("seq", F.when(F.col("t") == "end", "error").otherwise(F.col("t")).alias("t"))


@query("SELECT conv_id, turn, 'out' AS sink, text AS line FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, 'err', text FROM conversations WHERE role = 'assistant'")
def log_streams(spark: SparkSession, d: str) -> DataFrame:
    """Lines of stored logs by the sink that they are written to."""
    return _logs(spark, d, events.log_lines(_log_rows(spark, d)))


@query("SELECT conv_id, turn, 'out' AS sink, text AS line FROM conversations WHERE role IN ('user', 'assistant')")
def log_streams_merged(spark: SparkSession, d: str) -> DataFrame:
    return _logs(spark, d, events.log_lines(_log_rows(spark, d), merged=True))


@query("SELECT conv_id, turn, 'err' AS sink, text AS line FROM conversations WHERE role = 'assistant' AND contains(lower(text), 'the')")
def log_search(spark: SparkSession, d: str) -> DataFrame:
    """Error lines that a search finds."""
    return _logs(spark, d, events.log_lines(_log_rows(spark, d), stdout=False, search="The"))


def _log_rows(spark: SparkSession, d: str) -> DataFrame:
    stream = F.when(F.col("role") == "user", "stdout").when(F.col("role") == "assistant", "stderr").otherwise("status")
    return b.table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), stream.alias("stream"), F.col("text").alias("line"))


def _logs(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("conv_id"), F.col("seq").alias("turn"), "sink", "line")


@query(f"""
WITH {SQL_TARGETS} SELECT label, (list_reduce(list_prepend(14695981039346656037::HUGEINT, [ord(c)::HUGEINT FOR c IN string_split(label, '')]),
  lambda h, x: (xor(h::UBIGINT, x::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616) % 8)::INTEGER AS slot FROM t""")
def palette_slots(spark: SparkSession, d: str) -> DataFrame:
    return b.targets(spark, d).select("label", text.palette_slot(F.col("label")).alias("slot"))


@query(r"""
WITH x AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '//' || c_name || '/' WHEN 1 THEN './' || c_name WHEN 2 THEN '.' END AS explicit, CASE WHEN c_custkey % 8 = 3 THEN 'below/' || c_name || '//' END AS cwd FROM customer)
SELECT c_custkey, regexp_replace(regexp_replace(coalesce(explicit, cwd, ''), '^(//|(\./)+|\.$)', ''), '/+$', '') AS package FROM x""")
def normalized_packages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    explicit = F.when(k % 4 == 0, F.concat(F.lit("//"), "c_name", F.lit("/"))).when(k % 4 == 1, F.concat(F.lit("./"), "c_name")).when(k % 4 == 2, ".")
    cwd = F.when(k % 8 == 3, F.concat(F.lit("below/"), "c_name", F.lit("//")))
    return b.table(spark, d, "customer").select("c_custkey", labels.normalize_package(explicit, cwd).alias("package"))
