"""Every relational operator over the bridge relations, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import diagnose, globs, hashing, labels, text
from ..operators import cache, diff, events, generate, graph, keys, selection, tasks
from ..operators.selection import TestMode
from ..sources import bridge as b
from .scratch import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# SQL of the bridge relations.
SQL_TARGETS = """t AS (
  SELECT '//' || lower(r_name) || '/' || lower(n_name) || ':c' || c_custkey AS label, lower(r_name) || '/' || lower(n_name) AS package, 'c' || c_custkey AS name,
         CASE WHEN c_custkey % 50 = 0 THEN [lower(c_mktsegment), 'manual'] ELSE [lower(c_mktsegment)] END AS tags, c_acctbal < 0 AS test
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SQL_FILES = "f AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content FROM documents)"
SQL_INPUTS = r"""i AS (
  SELECT '//part:p' || p_partkey AS label, p_partkey AS k, 'src' || (p_partkey % 20) AS src, ['en', 'de', 'fr', 'es'][(p_partkey % 4 + 1)::INTEGER] AS lang,
         CASE p_partkey % 3 WHEN 0 THEN 'src' || (p_partkey % 20) || '/' || ['en', 'de', 'fr', 'es'][(p_partkey % 4 + 1)::INTEGER] || '/' || p_partkey || '\.txt'
                            WHEN 1 THEN 'src' || (p_partkey % 20) || '/' || ['en', 'de', 'fr', 'es'][(p_partkey % 4 + 1)::INTEGER] || '/.*\.txt'
                            ELSE 'src' || (p_partkey % 20) || '/(.*/)?' || (p_partkey % 10) || '.*\.txt' END AS re
  FROM part WHERE p_partkey >= 1)"""
SQL_DIAMOND = """e AS (
  SELECT DISTINCT '//order:' || l_orderkey AS parent, '//part:' || l_partkey AS dep FROM lineitem UNION SELECT '//order:' || l_orderkey, '//supplier:' || l_suppkey FROM lineitem
  UNION SELECT '//order:' || o_orderkey, '//customer:' || o_custkey FROM orders UNION SELECT '//supplier:' || s_suppkey, '//nation:' || s_nationkey FROM supplier
  UNION SELECT '//customer:' || c_custkey, '//nation:' || c_nationkey FROM customer UNION SELECT '//nation:' || n_nationkey, '//region:' || n_regionkey FROM nation)"""
SQL_RESULTS = """r AS (
  SELECT strftime(ts, '%Y-%m-%d') AS build, user_id AS id, event_id AS seq,
         CASE event_type WHEN 'view' THEN 'built' WHEN 'signup' THEN 'cache_hit' WHEN 'click' THEN 'remote_cache_hit' WHEN 'purchase' THEN 'external_cache_hit' WHEN 'error' THEN 'failed' END AS result
  FROM events)"""
SQL_ENTRIES = """a AS (
  SELECT o_orderkey AS cache_key, o_orderdate AS mtime, o_orderkey % 400 + 100 AS ac_bytes, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS exit_code, floor(o_totalprice)::BIGINT AS duration_ms
  FROM orders)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _joined(column: str) -> F.Column:
    return F.array_join(F.col(column), ",").alias(column)


# selection ---------------------------------------------------------------------------------------------------------------
@query(rf"""
WITH RECURSIVE {SQL_FILES}, {SQL_INPUTS},
c AS (SELECT path FROM f WHERE path LIKE 'src3/%' OR path LIKE 'src11/%'),
direct AS (SELECT DISTINCT k FROM i JOIN c ON starts_with(path, src || '/') AND regexp_full_match(path, re)),
r AS (SELECT k, 0 AS depth FROM direct UNION ALL SELECT p_partkey, depth + 1 FROM part JOIN r ON p_partkey // 2 = r.k WHERE p_partkey > 1)
SELECT '//part:p' || k AS label, min(depth)::INTEGER AS depth FROM r GROUP BY k""")
def affected_closure(spark: SparkSession, d: str) -> DataFrame:
    """Two sources' files changed: what does that affect?"""
    changed = b.files(spark, d).where(F.col("path").startswith("src3/") | F.col("path").startswith("src11/")).select("path")
    return selection.affected(changed, b.file_inputs(spark, d), b.part_edges(spark, d))


@query(rf"""
WITH {SQL_FILES}, {SQL_INPUTS}
SELECT label, path, sha256(content) AS content_hash, octet_length(encode(content))::BIGINT AS size FROM i JOIN f ON starts_with(path, src || '/')
 AND CASE k % 3 WHEN 1 THEN regexp_full_match(path, src || '/' || lang || '/[^/]*\.txt') ELSE regexp_full_match(path, re) END""")
def file_inputs(spark: SparkSession, d: str) -> DataFrame:
    return keys.file_inputs(b.file_inputs(spark, d), keys.hashed_files(b.files(spark, d)))


def _select(*patterns: str, **options: object) -> Query:
    return lambda spark, d: selection.select(b.targets(spark, d), list(patterns), **options).select("label")


def _selects(name: str, where: str, *patterns: str, **options: object) -> None:
    QUERIES[name] = _select(*patterns, **options)
    ORACLE_SQL[name] = f"WITH {SQL_TARGETS} SELECT label FROM t WHERE {where}"


_MANUAL = "NOT list_contains(tags, 'manual')"
_selects("select_default", f"NOT test AND {_MANUAL}")
_selects("select_recursive", f"(package = 'europe' OR package LIKE 'europe/%') AND NOT test AND {_MANUAL}", "//europe/...")
_selects("select_package_star", f"package = 'asia/nation_2' AND {_MANUAL}", "//asia/nation_2:*", mode=TestMode.INCLUDE)
_selects("select_glob", rf"regexp_full_match(package, 'a[^/]*/nation_[^/]') AND regexp_full_match(name, 'c[0-4][^/]*5') AND NOT test AND {_MANUAL}", "//a*/nation_?:c[0-4]*5")
_selects("select_exclude", f"package LIKE 'africa/%' AND package <> 'africa/nation_0' AND {_MANUAL}", "//africa/...", "!//africa/nation_0:*", mode=TestMode.INCLUDE)
_selects("select_only_excludes", f"package NOT LIKE 'asia/%' AND NOT test AND {_MANUAL}", "!//asia/...")
_selects("select_union", f"(package LIKE 'asia/%' OR regexp_full_match(name, 'c1[^/]*')) AND NOT test AND {_MANUAL}", "//asia/...", "//*/*:c1*", "//asia/...")
_selects("select_tags_testmode", f"list_has_any(tags, ['machinery', 'building']) AND NOT list_has_any(tags, ['manual']) AND test AND {_MANUAL}", mode=TestMode.ONLY, tags=["machinery", "building"], no_tags=["manual"])


@query(f"WITH {SQL_TARGETS} SELECT label, levenshtein('//asia/nation_2:cc16', label)::INTEGER AS distance FROM t ORDER BY 2, 1 LIMIT 1")
def suggest_label(spark: SparkSession, d: str) -> DataFrame:
    return selection.suggest(b.targets(spark, d), "//asia/nation_2:cc16")


@query(f"WITH {SQL_TARGETS} SELECT DISTINCT unnest(tags) AS tag FROM t")
def known_tags(spark: SparkSession, d: str) -> DataFrame:
    return selection.known_tags(b.targets(spark, d))


@query(f"WITH {SQL_TARGETS} SELECT label FROM t WHERE list_contains(tags, 'manual')")
def ids_with_tag(spark: SparkSession, d: str) -> DataFrame:
    return selection.ids_with_tag(b.targets(spark, d), "manual")


@query(rf"WITH {SQL_FILES} SELECT path FROM f WHERE NOT (path LIKE 'src1/%' OR path LIKE 'src2/en/%' OR path = 'src3/de/13.txt')")
def watch_excluded(spark: SparkSession, d: str) -> DataFrame:
    excluded = spark.createDataFrame([("src1",), ("src2/en",), ("src3/de/13.txt",), ("src",)], "path string")
    return selection.watch_excluded(b.files(spark, d).select("path"), excluded).select("path")


@query(rf"""
WITH {SQL_FILES}, p AS (SELECT unnest(['', 'src1', 'src1/en', 'src2', 'src19/fr']) AS package)
SELECT path, arg_max(package, length(package)) AS package FROM f JOIN p ON package = '' OR starts_with(path, package || '/') GROUP BY path""")
def owner_package(spark: SparkSession, d: str) -> DataFrame:
    packages = spark.createDataFrame([("",), ("src1",), ("src1/en",), ("src2",), ("src19/fr",)], "package string")
    return selection.owner_package(b.files(spark, d).select("path"), packages)


@query("SELECT DISTINCT path FROM (SELECT source || '/' || doc_id AS path FROM documents UNION ALL SELECT source || '/' || doc_id FROM documents JOIN labels USING (doc_id))")
def changed_since(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path")
    docs = b.table(spark, d, "documents")
    return selection.changed_since(docs.select(path), docs.join(b.table(spark, d, "labels"), "doc_id").select(path))


@query("SELECT p_type || '/' || p_partkey AS path FROM part")
def split_nul(spark: SparkSession, d: str) -> DataFrame:
    listing = b.table(spark, d, "part").groupBy("p_type").agg(F.concat(F.array_join(F.transform(F.collect_list("p_partkey"), lambda k: F.concat("p_type", F.lit("/"), k.cast("string"))), "\0"), F.lit("\0")).alias("listing"))
    return selection.split_nul(listing)


@query(f"""
WITH {SQL_RESULTS}, {SQL_TARGETS}, s AS (SELECT id, arg_max(result, seq) AS result FROM r GROUP BY id)
SELECT label, CASE result WHEN 'failed' THEN 'failed' WHEN 'built' THEN 'running' ELSE 'done' END AS status FROM s JOIN t ON name = 'c' || id
WHERE contains(lower(label), 'nation_1') AND NOT list_contains(tags, 'manual') AND result IN ('failed', 'built')""")
def build_rows(spark: SparkSession, d: str) -> DataFrame:
    """An interactive view of a build: search, tags by catalog lookup, status buckets."""
    state = events.latest_state(b.results(spark, d).select("id", "result", "seq"), ["id"])
    status = F.when(F.col("result") == "failed", "failed").when(F.col("result") == "built", "running").otherwise("done")
    catalog = b.targets(spark, d)
    rows = state.join(catalog, F.col("name") == F.concat(F.lit("c"), F.col("id").cast("string"))).select("label", status.alias("status"))
    return selection.build_rows(rows, catalog, "NATION_1", no_tags=["manual"], statuses=["failed", "running"])


@query(rf"""
WITH {SQL_TARGETS}, b AS (SELECT strftime(ts, '%Y-%m-%d') AS batch, 'src' || (event_id % 25) || '/en/' || user_id || '.txt' AS path, user_id FROM events)
SELECT DISTINCT batch FROM b WHERE regexp_full_match(path, 'src7/.*\.txt') OR 'c' || user_id IN (SELECT name FROM t WHERE package = 'asia/nation_2')""")
def relevant_batches(spark: SparkSession, d: str) -> DataFrame:
    """Days whose changes matter to a subscription to one source and one package."""
    rows = b.table(spark, d, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("batch"), F.concat(F.lit("src"), (F.col("event_id") % 25).cast("string"), F.lit("/en/"), F.col("user_id").cast("string"), F.lit(".txt")).alias("path"), "user_id"
    )
    hit = rows.select("batch", F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("name")).distinct().join(b.targets(spark, d), "name").select("batch", "label")
    requested = b.targets(spark, d).where("package = 'asia/nation_2'").select("label")
    return selection.relevant_batches(rows.select("batch", "path"), ["src7/*.txt"], hit, requested)


# graph -------------------------------------------------------------------------------------------------------------------
@query("""
WITH RECURSIVE r AS (SELECT p_partkey AS k, 0 AS level FROM part WHERE p_partkey <= 1 UNION ALL SELECT p_partkey, level + 1 FROM part JOIN r ON p_partkey // 2 = r.k WHERE p_partkey > 1)
SELECT '//part:p' || k AS label, level::INTEGER AS level FROM r""")
def topo_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.levels(b.part_labels(spark, d), b.part_edges(spark, d))


@query(f"""
WITH RECURSIVE {SQL_DIAMOND}, n AS (SELECT parent AS label FROM e UNION SELECT dep FROM e),
l AS (SELECT label, 0 AS level FROM n WHERE label NOT IN (SELECT parent FROM e) UNION SELECT parent, level + 1 FROM e JOIN l ON e.dep = l.label)
SELECT label, max(level)::INTEGER AS level FROM l GROUP BY label""")
def topo_levels_diamond(spark: SparkSession, d: str) -> DataFrame:
    edges = cut(b.diamond_edges(spark, d))
    nodes = edges.select(F.col("parent").alias("label")).union(edges.select("dep")).distinct()
    return graph.levels(nodes, edges)


@query("""
WITH RECURSIVE r AS (SELECT p_partkey AS k, 0 AS depth FROM part WHERE p_brand = 'Brand#7' UNION ALL SELECT k // 2, depth + 1 FROM r WHERE k > 1)
SELECT '//part:p' || k AS label, min(depth)::INTEGER AS depth FROM r GROUP BY k""")
def dep_closure(spark: SparkSession, d: str) -> DataFrame:
    seeds = b.table(spark, d, "part").where("p_brand = 'Brand#7'").select(F.concat(F.lit("//part:p"), F.col("p_partkey").cast("string")).alias("label"))
    return graph.closure(seeds, b.part_edges(spark, d))


@query(f"""
WITH RECURSIVE {SQL_DIAMOND}, r AS (SELECT '//nation:3' AS label UNION SELECT parent FROM e JOIN r ON e.dep = r.label) SELECT label FROM r""")
def rdeps_closure(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.createDataFrame([("//nation:3",)], "label string")
    return graph.closure(seeds, b.diamond_edges(spark, d), downstream=True).select("label")


@query(f"WITH {SQL_DIAMOND} SELECT DISTINCT dep AS label FROM e WHERE parent = '//order:7'")
def direct_deps(spark: SparkSession, d: str) -> DataFrame:
    return graph.direct_deps(b.diamond_edges(spark, d), "//order:7")


@query(f"WITH {SQL_DIAMOND} SELECT DISTINCT parent AS label FROM e WHERE dep = '//part:7'")
def direct_dependents(spark: SparkSession, d: str) -> DataFrame:
    return graph.direct_dependents(b.diamond_edges(spark, d), "//part:7")


@query("SELECT 'out/' || p_name AS path, string_agg('//part:p' || p_partkey, ',' ORDER BY '//part:p' || p_partkey) AS labels FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1")
def output_collisions(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "part").select(F.concat(F.lit("//part:p"), F.col("p_partkey").cast("string")).alias("label"), F.concat(F.lit("out/"), "p_name").alias("path"))
    return graph.output_collisions(rows).select("path", _joined("labels"))


@query("SELECT DISTINCT 'o' || l_orderkey AS parent, 's' || l_suppkey AS dep FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def unknown_deps(spark: SparkSession, d: str) -> DataFrame:
    edges = b.table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("parent"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dep")).distinct()
    known = b.table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("label"))
    return graph.unknown_deps(edges, known)


@query("SELECT c_mktsegment || ':' || c_nationkey AS label, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def duplicate_labels(spark: SparkSession, d: str) -> DataFrame:
    return graph.duplicate_labels(b.table(spark, d, "customer").select(F.concat("c_mktsegment", F.lit(":"), F.col("c_nationkey").cast("string")).alias("label")))


def _nation_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nation = b.table(spark, d, "nation")
    edges = nation.select(F.lower("n_name").alias("parent"), F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("dep"))
    return edges, edges.select(F.col("parent").alias("label")).union(edges.select("dep")).distinct()


_SQL_NATION = "e AS (SELECT lower(n_name) AS parent, 'region_' || n_regionkey AS dep FROM nation), n AS (SELECT parent AS label FROM e UNION SELECT dep FROM e)"


@query(f"""
WITH {_SQL_NATION}, x AS (
  SELECT 0 AS part, 'digraph deps {{' AS text UNION ALL SELECT 1, '  "' || label || '";' FROM n UNION ALL SELECT 2, '  "' || parent || '" -> "' || dep || '";' FROM e UNION ALL SELECT 3, '}}')
SELECT (row_number() OVER (ORDER BY part, text) - 1)::INTEGER AS line, text FROM x""")
def graph_dot(spark: SparkSession, d: str) -> DataFrame:
    return graph.to_dot(*_nation_graph(spark, d))


@query(f"""
WITH {_SQL_NATION}, a AS (SELECT label, 'n' || (row_number() OVER (ORDER BY label) - 1) AS alias FROM n), x AS (
  SELECT 0 AS part, '' AS k1, '' AS k2, 'graph TD' AS text UNION ALL SELECT 1, label, '', '  ' || alias || '["' || label || '"]' FROM a
  UNION ALL SELECT 2, parent, dep, '  ' || p.alias || ' --> ' || q.alias FROM e JOIN a p ON p.label = parent JOIN a q ON q.label = dep)
SELECT (row_number() OVER (ORDER BY part, k1, k2) - 1)::INTEGER AS line, text FROM x""")
def graph_mermaid(spark: SparkSession, d: str) -> DataFrame:
    return graph.to_mermaid(*_nation_graph(spark, d))


@query(f"""
WITH {_SQL_NATION}
SELECT '{{"nodes":[' || (SELECT string_agg('"' || label || '"', ',' ORDER BY label) FROM n) || '],"edges":[' || (SELECT string_agg('{{"from":"' || parent || '","to":"' || dep || '"}}', ',' ORDER BY parent, dep) FROM e) || ']}}' AS json""")
def graph_json(spark: SparkSession, d: str) -> DataFrame:
    return graph.to_json(*_nation_graph(spark, d))


@query("""
WITH RECURSIVE e AS (SELECT 'p' || (p_partkey // 2) AS parent, 'p' || p_partkey AS dep FROM part WHERE p_partkey > 1),
r AS (SELECT 'p1' AS label, ['p1'] AS path, 0 AS depth UNION ALL SELECT dep, list_append(path, dep), depth + 1 FROM e JOIN r ON e.parent = r.label WHERE depth < 5)
SELECT (row_number() OVER (ORDER BY path) - 1)::INTEGER AS pos, depth::INTEGER AS depth, label, false AS seen FROM r""")
def graph_tree(spark: SparkSession, d: str) -> DataFrame:
    """The first levels below part 1, children in order."""
    at = lambda c: F.concat(F.lit("p"), c.cast("string"))
    k = F.col("p_partkey")
    edges = b.table(spark, d, "part").where("p_partkey > 1").select(at(F.floor(k / 2)).alias("parent"), at(k).alias("dep"))
    return graph.tree(edges, "p1", 5)


@query("""
WITH RECURSIVE e AS (SELECT 'p' || (p_partkey // 2) AS parent, 'p' || p_partkey AS dep FROM part WHERE p_partkey > 1),
r AS (SELECT 'p1' AS label, ['p1'] AS path, 0 AS depth UNION ALL SELECT dep, list_append(path, dep), depth + 1 FROM e JOIN r ON e.parent = r.label)
SELECT (row_number() OVER (ORDER BY path) - 1)::INTEGER AS pos, depth::INTEGER AS depth, label, false AS seen FROM r""")
def graph_tree_all(spark: SparkSession, d: str) -> DataFrame:
    """All levels below part 1, children in order."""
    at = lambda c: F.concat(F.lit("p"), c.cast("string"))
    k = F.col("p_partkey")
    edges = b.table(spark, d, "part").where("p_partkey > 1").select(at(F.floor(k / 2)).alias("parent"), at(k).alias("dep"))
    return graph.tree(edges, "p1")


@query(f"WITH {SQL_TARGETS} SELECT least(max(length(label)), 48)::INTEGER AS width FROM t")
def column_width(spark: SparkSession, d: str) -> DataFrame:
    return graph.column_width(b.targets(spark, d))


@query(f"""
WITH RECURSIVE {SQL_RESULTS}, failed AS (SELECT 2 * id AS k FROM r WHERE result = 'failed' AND build = '2024-01-05'),
x AS (SELECT k FROM failed WHERE k IN (SELECT p_partkey FROM part) UNION SELECT p_partkey FROM part JOIN x ON p_partkey // 2 = x.k WHERE p_partkey > 1)
SELECT '//part:p' || k AS label, '//part:p' || (k // 2) AS reason FROM x WHERE k NOT IN (SELECT k FROM failed)""")
def skip_propagation(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.concat(F.lit("//part:p"), c.cast("string")).alias("label")
    failed = b.results(spark, d).where("result = 'failed' AND build = '2024-01-05'").select(at(2 * F.col("id"))).distinct()
    known = b.part_labels(spark, d)
    return events.skip_propagation(failed.join(known, "label", "left_semi"), b.part_edges(spark, d), known)


# hashes and keys ---------------------------------------------------------------------------------------------------------
@query(f"WITH {SQL_FILES} SELECT path, sha256(content) AS content_hash, octet_length(encode(content))::BIGINT AS size FROM f")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return keys.hashed_files(b.files(spark, d))


@query(f"WITH {SQL_FILES} SELECT split_part(path, '/', 1) AS source, sha256(unhex(string_agg(hex(encode(path)) || '00' || sha256(content) || '00', '' ORDER BY path))) AS outputs_hash FROM f GROUP BY 1")
def outputs_content_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = keys.hashed_files(b.files(spark, d)).withColumn("source", F.substring_index("path", "/", 1))
    return rows.groupBy("source").agg(F.collect_list(F.struct("path", "content_hash")).alias("o")).select("source", hashing.outputs_hash(F.col("o")).alias("outputs_hash"))


_SQL_MARK = {m: (m.encode().hex() + "00").upper() for m in ("v3", "cmd", "cwd", "env", "file_inputs", "dep_outputs", "TARGET_TRIPLE=linux")}


def _recipes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    return b.table(spark, d, "part").select(
        F.concat(F.lit("//part:p"), k).alias("label"), F.concat(F.lit("make "), "p_name").alias("command"), F.lower("p_brand").alias("cwd"),
        F.create_map(F.lit("TYPE"), "p_type", F.lit("SIZE"), F.col("p_size").cast("string")).alias("env"),
    )


_SQL_HEAD = (
    f"'{_SQL_MARK['v3']}{_SQL_MARK['cmd']}' || hex(encode('make ' || p_name)) || '00{_SQL_MARK['cwd']}' || hex(encode(lower(p_brand))) || '00{_SQL_MARK['env']}' || "
    f"hex(encode('SIZE=' || p_size)) || '00' || hex(encode('TYPE=' || p_type)) || '00{_SQL_MARK['TARGET_TRIPLE=linux']}{_SQL_MARK['file_inputs']}'"
)


@query(rf"""
WITH {SQL_FILES}, {SQL_INPUTS},
x AS (SELECT k, string_agg(hex(encode(path)) || '00' || sha256(content) || '00', '' ORDER BY string_split(path, '/')) AS files FROM i JOIN f ON starts_with(path, src || '/')
      AND CASE k % 3 WHEN 1 THEN regexp_full_match(path, src || '/' || lang || '/[^/]*\.txt') ELSE regexp_full_match(path, re) END GROUP BY k)
SELECT '//part:p' || p_partkey AS label, sha256(unhex({_SQL_HEAD} || coalesce(files, '') || '{_SQL_MARK['dep_outputs']}')) AS cache_key FROM part LEFT JOIN x ON k = p_partkey""")
def cache_key_level0(spark: SparkSession, d: str) -> DataFrame:
    inputs = keys.input_classes(b.file_inputs(spark, d), keys.hashed_files(b.files(spark, d)))
    none = spark.createDataFrame([], "label string, outputs_hash string")
    return keys.keyed(_recipes(spark, d), inputs, none, "linux").select("label", "cache_key")


@query(f"""
WITH RECURSIVE r AS (
  SELECT p_partkey AS k, sha256(unhex({_SQL_HEAD} || '{_SQL_MARK['dep_outputs']}')) AS cache_key FROM part WHERE p_partkey <= 1
  UNION ALL
  SELECT p_partkey, sha256(unhex({_SQL_HEAD} || '{_SQL_MARK['dep_outputs']}' || sha256(unhex(hex(encode('out')) || '00' || sha256(r.cache_key) || '00')) || '00')) FROM part JOIN r ON p_partkey // 2 = r.k WHERE p_partkey > 1)
SELECT '//part:p' || k AS label, cache_key FROM r""")
def cache_key_chain(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the deep chain, level by level; a part's output is one file that holds its key."""
    recipes, edges = cut(_recipes(spark, d)), cut(b.part_edges(spark, d))
    order = cut(graph.levels(recipes, edges))
    no_files = spark.createDataFrame([], "label string, path string, content_hash string")
    known, outputs = None, spark.createDataFrame([], "label string, outputs_hash string")
    for level in range(order.agg(F.max("level")).first()[0] + 1):
        here = order.where(F.col("level") == level).select("label")
        done = cut(keys.keyed(recipes.join(here, "label", "left_semi"), no_files, outputs, "linux").select("label", "cache_key"))
        known = done if known is None else known.unionByName(done)
        made = hashing.outputs_hash(F.array(F.struct(F.lit("out").alias("path"), hashing.content_hash(F.col("cache_key")).alias("content_hash"))))
        outputs = edges.join(done.select(F.col("label").alias("dep"), made.alias("outputs_hash")), "dep").select(F.col("parent").alias("label"), "outputs_hash")
    return known


@query(r"""
WITH g AS (SELECT '//part:p' || p_partkey AS label, 'src' || (p_partkey % 20) AS src FROM part)
SELECT DISTINCT label, mode, path FROM (
  SELECT label, 'rw' AS mode, 'out/' || src AS path FROM g UNION ALL SELECT label, 'rw', '.tmp' FROM g
  UNION ALL SELECT label, 'ro', source || '/' || lang || '/' || doc_id || '.txt' FROM g JOIN documents ON source = src)""")
def sandbox_grants(spark: SparkSession, d: str) -> DataFrame:
    source = F.concat(F.lit("src"), (F.col("p_partkey") % 20).cast("string"))
    label = F.concat(F.lit("//part:p"), F.col("p_partkey").cast("string")).alias("label")
    parts = b.table(spark, d, "part").select(label, source.alias("src"))
    inputs = parts.select("label", F.concat("src", F.lit("/**")).alias("glob"))
    outputs = parts.select("label", F.concat(F.lit("out/"), "src", F.lit("/*.o")).alias("path"))
    return keys.sandbox_grants(keys.input_classes(inputs, keys.hashed_files(b.files(spark, d))), outputs, ".tmp")


# cache -------------------------------------------------------------------------------------------------------------------
@query("SELECT sha256(text) AS hash, any_value(octet_length(encode(text)))::BIGINT AS size FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'de') GROUP BY 1")
def cas_dedup(spark: SparkSession, d: str) -> DataFrame:
    """New contents beside stored ones, each once."""
    docs = b.files(spark, d).where("content IS NOT NULL")
    stored = docs.where(F.split("path", "/")[1] == "de").select(hashing.content_hash(F.col("content")).alias("hash"))
    return cache.put_blobs(stored, docs).select("hash", "size")


@query("SELECT p_partkey AS hash FROM part WHERE p_size <= 2 AND p_partkey IN (SELECT l_partkey FROM lineitem)")
def missing_blobs(spark: SparkSession, d: str) -> DataFrame:
    return cache.missing_blobs(b.refs(spark, d), b.blobs(spark, d).where("size > 200"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey AS cache_key, o_orderkey AS entry, o_orderdate AS mtime FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def ac_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "orders").select(F.col("o_custkey").alias("cache_key"), F.col("o_orderkey").alias("entry"), F.col("o_orderdate").alias("mtime"))
    return cache.latest(rows, ["cache_key"], [F.desc("mtime"), F.desc("entry")])


@query("SELECT o_orderkey AS cache_key, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS origin FROM orders")
def ac_put(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("cache_key"), F.col("o_orderdate").alias("mtime"), F.lit("old").alias("origin"), "o_orderstatus")
    new = rows.where("o_orderstatus = 'F'").withColumn("origin", F.lit("new"))
    return cache.put_entries(rows, new).select("cache_key", "origin")


@query("SELECT o_orderkey AS cache_key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def ac_delete(spark: SparkSession, d: str) -> DataFrame:
    return cache.delete_entries(b.entries(spark, d), b.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("cache_key"))).select("cache_key")


_SQL_STATUS = "SELECT '//part:p' || p_partkey AS label, CASE WHEN a.cache_key IS NULL THEN 'stale' ELSE 'cached' END AS state, p_partkey::VARCHAR AS key, duration_ms AS last_duration_ms FROM part LEFT JOIN (SELECT * FROM a WHERE exit_code = 0) a ON p_partkey = a.cache_key"


def _part_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    return b.table(spark, d, "part").select(F.concat(F.lit("//part:p"), k).alias("label"), k.alias("cache_key"), "p_size", "p_brand", "p_partkey")


@query(f"WITH {SQL_ENTRIES} {_SQL_STATUS}")
def cache_status(spark: SparkSession, d: str) -> DataFrame:
    return cache.status(_part_keys(spark, d), b.entries(spark, d).withColumn("cache_key", F.col("cache_key").cast("string")))


@query("SELECT o_orderkey AS cache_key FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 2)")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    e = b.entries(spark, d)
    return cache.hits(e.select("cache_key"), e, b.refs(spark, d), b.blobs(spark, d).where("size > 200"))


@query("""
SELECT '//part:p' || p_partkey AS label, CASE WHEN p_size % 2 = 0 AND p_partkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN 'cache_hit'
  WHEN p_size % 2 = 0 AND p_brand <> 'Brand#1' AND p_partkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') THEN 'remote_cache_hit'
  WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') THEN 'external_cache_hit' ELSE 'build' END AS result FROM part""")
def lookup_chain(spark: SparkSession, d: str) -> DataFrame:
    orders = b.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("cache_key"), "o_orderstatus")
    external = b.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("//part:p"), F.col("l_partkey").cast("string")).alias("label"))
    wanted = _part_keys(spark, d).select("label", "cache_key", (F.col("p_size") % 2 == 0).alias("cacheable"), (F.col("p_brand") != "Brand#1").alias("remote_cache"))
    return cache.lookup_chain(wanted, orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), external)


@query(f"WITH {SQL_FILES} SELECT path, sha256(content) AS content_hash FROM f WHERE path NOT LIKE '%/en/%'")
def restore_plan(spark: SparkSession, d: str) -> DataFrame:
    """Outputs to write: the English ones are on disk already."""
    outputs = keys.hashed_files(b.files(spark, d)).select("path", "content_hash")
    return cache.restore_plan(outputs, outputs.where(F.col("path").contains("/en/")))


@query("SELECT l_partkey AS hash, count(*) AS refs FROM lineitem GROUP BY 1")
def refcounts(spark: SparkSession, d: str) -> DataFrame:
    return cache.ref_counts(b.refs(spark, d))


def _evict_sql(young: str, share: float) -> str:
    return f"""
WITH {SQL_ENTRIES}, aged AS (SELECT *, {young} AS young FROM a), refs AS (SELECT DISTINCT l_orderkey AS cache_key, l_partkey AS hash FROM lineitem),
ranked AS (SELECT cache_key, mtime, ac_bytes, young, row_number() OVER (ORDER BY young, mtime, cache_key) AS rk FROM aged),
last AS (SELECT hash, max(rk) AS rk FROM refs JOIN ranked USING (cache_key) GROUP BY hash),
freed AS (SELECT rk, sum(p_size * 100) AS bytes FROM last JOIN part ON p_partkey = hash GROUP BY rk),
gains AS (SELECT cache_key, mtime, rk, ac_bytes + coalesce(bytes, 0) AS gain FROM ranked LEFT JOIN freed USING (rk) WHERE NOT young),
run AS (SELECT cache_key, mtime, gain, coalesce(sum(gain) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM gains),
total AS (SELECT (SELECT sum(ac_bytes) FROM a) + (SELECT sum(p_size * 100) FROM part) AS initial)
SELECT cache_key, mtime, gain::BIGINT AS gain, before::BIGINT AS freed_before FROM run, total WHERE initial - before > floor(initial * {share})"""


def _cache_bytes(spark: SparkSession, d: str, share: float) -> int:
    n = b.entries(spark, d).agg(F.sum("ac_bytes")).first()[0] + b.blobs(spark, d).agg(F.sum("size")).first()[0]
    return int(n * share)


@query(_evict_sql("false", 0.5))
def evict_plan(spark: SparkSession, d: str) -> DataFrame:
    return cache.eviction_plan(b.entries(spark, d), b.refs(spark, d), b.blobs(spark, d), _cache_bytes(spark, d, 0.5))


@query(_evict_sql("mtime <= TIMESTAMP '2001-01-01' AND mtime > TIMESTAMP '2000-01-03'", 0.2))
def evict_recency_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Entries younger than 364 days at 2001-01-01 stay; a date beyond it is no age, so later ones don't."""
    e = b.entries(spark, d)
    now = F.to_timestamp(F.lit("2001-01-01 00:00:00"))
    return cache.eviction_plan(e, b.refs(spark, d), b.blobs(spark, d), _cache_bytes(spark, d, 0.2), now=now, min_age_secs=364 * 86_400)


@query("""
WITH x AS (SELECT 'ac' AS area, o_orderkey % 400 + 100 AS size FROM orders UNION ALL SELECT 'cas', p_size * 100 FROM part UNION ALL SELECT 'log', length(text) FROM conversations)
SELECT coalesce(area, 'total') AS area, count(*) AS files, sum(size)::BIGINT AS bytes FROM x GROUP BY ROLLUP (area)""")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    area = lambda df, name, size: df.select(F.lit(name).alias("area"), size.cast("bigint").alias("size"))
    logs = area(b.table(spark, d, "conversations"), "log", F.length("text"))
    return cache.stats(area(b.entries(spark, d), "ac", F.col("ac_bytes")).union(area(b.blobs(spark, d), "cas", F.col("size"))).union(logs))


@query(f"WITH {SQL_ENTRIES} SELECT count(*) AS entries, sum(ac_bytes)::BIGINT AS bytes FROM a WHERE mtime <= TIMESTAMP '1996-01-01'")
def clean_older_than(spark: SparkSession, d: str) -> DataFrame:
    rows = b.entries(spark, d).withColumn("target_id", F.col("cache_key").cast("string"))
    return cache.clean_report(cache.clean_selection(rows, older_than=F.lit("1996-01-01").cast("timestamp_ntz")))[0]


@query(f"WITH {SQL_TARGETS} SELECT label AS target_id, o_orderkey AS cache_key FROM orders JOIN t ON name = 'c' || o_custkey WHERE regexp_full_match(label, '//a.*:c1.*')")
def clean_selective(spark: SparkSession, d: str) -> DataFrame:
    orders = b.table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderkey").alias("cache_key"), F.col("o_orderdate").alias("mtime"))
    rows = orders.join(b.targets(spark, d).select("name", F.col("label").alias("target_id")), "name")
    return cache.clean_selection(rows, "//a*:c1*").select("target_id", "cache_key")


@query("SELECT DISTINCT p_partkey AS hash, (p_size * 100)::BIGINT AS size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey >= 100 AND p_size <= 45 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey >= 100 AND p_size > 45)")
def upload_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Blobs to send before the entries that need them; entries with a blob beyond the limit stay."""
    sent = b.blobs(spark, d)
    return cache.upload_batches(b.entries(spark, d), b.refs(spark, d), sent.where("hash < 100"), sent, 4500)[0]


# diffs, generation -------------------------------------------------------------------------------------------------------
@query("SELECT coalesce(c_custkey, s_suppkey) AS key, c_nationkey AS \"left\", s_nationkey AS \"right\" FROM customer FULL JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey IS DISTINCT FROM s_nationkey")
def explain_diff(spark: SparkSession, d: str) -> DataFrame:
    left = b.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("v"))
    right = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("v"))
    return diff.keyed_diff(left, right, "key", "v")


@query("""
WITH a AS (SELECT doc_id::VARCHAR AS path, text AS content FROM documents WHERE lang <> 'fr'), g AS (SELECT doc_id::VARCHAR AS path, CASE WHEN source = 'src4' THEN text || '!' ELSE text END AS content FROM documents WHERE lang <> 'es')
SELECT coalesce(a.path, g.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN g.path IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN g ON a.path = g.path WHERE a.path IS NULL OR g.path IS NULL OR a.content IS DISTINCT FROM g.content""")
def gen_drift(spark: SparkSession, d: str) -> DataFrame:
    docs = b.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "lang", "source", F.col("text").alias("content"))
    made = docs.where("lang <> 'es'").withColumn("content", F.when(F.col("source") == "src4", F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return diff.drift(docs.where("lang <> 'fr'"), made)


@query(rf"""
WITH {SQL_FILES}, {SQL_INPUTS}, o AS (SELECT '//doc:' || regexp_extract(path, '(\d+)\.txt', 1) AS dep, path FROM f)
SELECT DISTINCT label, dep FROM i JOIN o ON starts_with(path, src || '/') AND regexp_full_match(path, re)""")
def link_inference(spark: SparkSession, d: str) -> DataFrame:
    outputs = b.files(spark, d).select(F.concat(F.lit("//doc:"), F.regexp_extract("path", r"(\d+)\.txt", 1)).alias("label"), "path")
    return generate.infer_links(outputs, b.file_inputs(spark, d))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS k, '//part:' || l_partkey AS dep FROM lineitem), x AS (SELECT o_orderkey AS k, ['//customer:' || o_custkey] AS deps FROM orders),
g AS (SELECT k, list(dep) AS inferred FROM l GROUP BY k)
SELECT '//order:' || k AS label, array_to_string(list_sort(list_distinct(list_concat(deps, coalesce(inferred, [])))), ',') AS deps, inferred IS NOT NULL AS rewritten FROM x LEFT JOIN g USING (k)""")
def linked_deps(spark: SparkSession, d: str) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(f"//{kind}:"), F.col(c).cast("string"))
    rows = b.table(spark, d, "orders").select(name("order", "o_orderkey").alias("label"), F.array(name("customer", "o_custkey")).alias("deps"))
    links = b.table(spark, d, "lineitem").select(name("order", "l_orderkey").alias("label"), name("part", "l_partkey").alias("dep")).distinct()
    return generate.linked(rows, links).select("label", _joined("deps"), "rewritten")


@query("SELECT lower(r_name) AS package, string_agg(lower(n_name), ',' ORDER BY lower(n_name)) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def package_files(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "nation").join(b.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("r_name").alias("package"), F.lower("n_name").alias("name"), F.lit("make").alias("command"))
    return generate.package_files(rows).select("package", F.array_join(F.col("targets.name"), ",").alias("names"))


@query("SELECT DISTINCT p_type AS package FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size > 49 AND p_brand = 'Brand#3')")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    part = b.table(spark, d, "part")
    return generate.stale_files(part.select(F.col("p_type").alias("package")), part.where("p_size > 49 AND p_brand = 'Brand#3'").select(F.col("p_type").alias("package")))


@query("SELECT path FROM (SELECT 'pkg/' || lang || '/kiln.' || source || '.' || CASE WHEN doc_id % 2 = 0 THEN 'yaml' ELSE 'txt' END AS path FROM documents) WHERE NOT regexp_full_match(split_part(path, '/', 3), 'kiln\\.src3\\.(yaml|yml|json)')")
def ownership_violations(spark: SparkSession, d: str) -> DataFrame:
    ext = F.when(F.col("doc_id") % 2 == 0, "yaml").otherwise("txt")
    return generate.ownership_violations(b.table(spark, d, "documents").select(F.concat(F.lit("pkg/"), "lang", F.lit("/kiln."), "source", F.lit("."), ext).alias("path")), "src3", "kiln")


# events ------------------------------------------------------------------------------------------------------------------
@query(f"""
WITH {SQL_RESULTS} SELECT build, count(*) FILTER (WHERE result = 'built') AS built, count(*) FILTER (WHERE result LIKE '%cache_hit') AS cache_hit, count(*) FILTER (WHERE result = 'failed') AS failed,
 count(*) FILTER (WHERE result = 'skipped') AS skipped, count(*) FILTER (WHERE result = 'failed') = 0 AS ok FROM r GROUP BY build""")
def build_counts(spark: SparkSession, d: str) -> DataFrame:
    return events.build_counts(b.results(spark, d))


@query(f"WITH {SQL_RESULTS} SELECT build, id, arg_max(result, seq) AS result, max(seq) AS seq FROM r GROUP BY build, id")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return events.latest_state(b.results(spark, d), ["build", "id"])


@query(f"WITH {SQL_RESULTS}, s AS (SELECT id, arg_max(result, seq) AS status FROM r GROUP BY id) SELECT status, count(*) AS n FROM s GROUP BY status")
def live_counts(spark: SparkSession, d: str) -> DataFrame:
    state = events.latest_state(b.results(spark, d).select("id", F.col("result").alias("status"), "seq"), ["id"])
    return events.live_counts(state)


@query(f"WITH {SQL_RESULTS} SELECT id FROM r WHERE result = 'failed' AND build = (SELECT max(build) FROM r)")
def failed_set(spark: SparkSession, d: str) -> DataFrame:
    return events.failed_set(b.results(spark, d))


@query("""
SELECT id, stream, seq, line, dropped FROM (SELECT conv_id AS id, role AS stream, turn AS seq, text AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n,
 greatest(count(*) OVER (PARTITION BY conv_id) - 3, 0) AS dropped FROM conversations) WHERE n <= 3""")
def last_n_logs(spark: SparkSession, d: str) -> DataFrame:
    return events.last_n(b.log_lines(spark, d), ["id"], "seq", 3)


@query("""
SELECT id, stream, seq, bytes_before, bytes_before + size > 1000 AS truncated FROM (SELECT conv_id AS id, role AS stream, turn AS seq, octet_length(encode(text)) + 1 AS size,
 coalesce(sum(octet_length(encode(text)) + 1) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bytes_before FROM conversations) WHERE bytes_before < 1000""")
def log_capture_cap(spark: SparkSession, d: str) -> DataFrame:
    return events.capped_log(b.log_lines(spark, d), ["id", "stream"], "seq", cap=1000).select("id", "stream", "seq", "bytes_before", "truncated")


@query("""
WITH s AS (SELECT conv_id AS id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant') AS out, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'assistant') AS err FROM conversations GROUP BY 1),
b AS (SELECT id, 'stdout' AS stream, out AS t FROM s UNION ALL SELECT id, 'stderr', err FROM s), l AS (SELECT id, stream, string_split(regexp_replace(t, '\\n$', ''), chr(10)) AS x FROM b WHERE t IS NOT NULL AND t <> '')
SELECT id, stream, (unnest(range(len(x))))::INTEGER AS pos, unnest(x) AS line FROM l""")
def log_replay(spark: SparkSession, d: str) -> DataFrame:
    """Stored logs by lines, stdout first."""
    said = lambda where, name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("seq", "line")))), lambda x: x["line"]), "\n").alias(name)
    stored = b.log_lines(spark, d).groupBy("id").agg(said(F.col("stream") == "assistant", "stdout"), said(F.col("stream") != "assistant", "stderr"))
    return events.replay(stored)


@query(f"""
WITH {SQL_RESULTS}, s AS (SELECT id, arg_max(result, seq) AS result FROM r GROUP BY id)
SELECT conv_id AS id, turn AS seq FROM conversations WHERE conv_id IN (SELECT id FROM s WHERE result = 'failed')""")
def kept_output(spark: SparkSession, d: str) -> DataFrame:
    state = events.latest_state(b.results(spark, d).select("id", "result", "seq"), ["id"])
    return events.kept_output(b.log_lines(spark, d), state).select("id", "seq")


@query(f"""
WITH {SQL_RESULTS}, {SQL_TARGETS}, s AS (SELECT id, arg_max(result, seq) AS result FROM r GROUP BY id)
SELECT id, result FROM s JOIN t ON name = 'c' || id WHERE result = 'failed' OR NOT list_has_any(tags, ['machinery'])""")
def renderer_rows(spark: SparkSession, d: str) -> DataFrame:
    state = events.latest_state(b.results(spark, d).select("id", "result", "seq"), ["id"])
    rows = state.join(b.targets(spark, d).select("name", "tags"), F.col("name") == F.concat(F.lit("c"), F.col("id").cast("string")))
    return events.renderer_rows(rows, ["machinery"]).select("id", "result")


@query("""
WITH RECURSIVE o AS (SELECT user_id AS key, epoch_us(ts) AS us, json_extract_string(props, '$.k') AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (
  SELECT key, rn, us, path, 1 AS batch, us AS first FROM o WHERE rn = 1
  UNION ALL
  SELECT o.key, o.rn, o.us, o.path, CASE WHEN o.us >= least(f.us + 21600000000, f.first + 43200000000) THEN f.batch + 1 ELSE f.batch END,
         CASE WHEN o.us >= least(f.us + 21600000000, f.first + 43200000000) THEN o.us ELSE f.first END
  FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1)
SELECT key, batch::INTEGER AS batch, min(us) AS first_us, max(us) AS last_us, least(max(us) + 21600000000, min(us) + 43200000000) AS flushed_us, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths
FROM f GROUP BY key, batch""")
def debounce_batches(spark: SparkSession, d: str) -> DataFrame:
    """Changes of a user, quiet for 6 hours or 12 hours old."""
    return events.debounce(b.changes(spark, d), ["key"], "ts", "path", 21_600_000_000, 43_200_000_000).select("key", "batch", "first_us", "last_us", "flushed_us", _joined("paths"))


@query("""
WITH o AS (SELECT user_id AS key, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT key, us, sum(opens) OVER (PARTITION BY key ORDER BY us) AS session FROM o)
SELECT key, session::BIGINT AS session, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY key, session""")
def session_quiet_only(spark: SparkSession, d: str) -> DataFrame:
    return events.quiet_sessions(b.changes(spark, d), ["key"], "ts", 21_600_000_000)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def distinct_until_changed(spark: SparkSession, d: str) -> DataFrame:
    return events.distinct_until_changed(b.table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("""
WITH g AS (SELECT user_id AS key, epoch_us(ts) AS us, ((lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) - epoch_us(ts)) // 1000000) AS gap FROM events)
SELECT key, us AS silent_since, unnest(range(3, least(gap, 20) + 1))::BIGINT AS secs FROM g WHERE gap >= 3""")
def heartbeats(spark: SparkSession, d: str) -> DataFrame:
    """The first beats of each silence: one for every second from 3 to 20."""
    rows = b.changes(spark, d)
    return events.silent_gaps(rows, ["key"], "ts").where("secs <= 20").select("key", F.unix_micros("silent_since").alias("silent_since"), "secs")


@query("""
WITH o AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS us FROM events), g AS (SELECT key, us, (lead(us) OVER (PARTITION BY key ORDER BY us) - us) // 1000000 AS gap FROM o)
SELECT key, us AS silent_since, unnest(range(3, gap + 1))::BIGINT AS secs FROM g WHERE gap >= 3""")
def heartbeats_all(spark: SparkSession, d: str) -> DataFrame:
    """Every beat of each silence, over event times in milliseconds taken for microseconds, so that gaps are seconds."""
    rows = b.changes(spark, d).withColumn("ts", F.timestamp_micros(F.floor(F.unix_micros("ts") / 1000)))
    return events.silent_gaps(rows, ["key"], "ts").select("key", F.unix_micros("silent_since").alias("silent_since"), "secs")


@query("""
WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY event_id) AS rn, 'b' || event_id AS build, event_id * 100 AS at, (value * 10)::BIGINT AS duration FROM (SELECT event_id, floor(value) AS value FROM events)),
s AS (
  SELECT 0::BIGINT AS rn, -1::BIGINT AS free, NULL::VARCHAR AS wb, NULL::BIGINT AS wd, NULL::VARCHAR AS ob, NULL::VARCHAR AS oo, NULL::BIGINT AS os, NULL::VARCHAR AS pb, NULL::BIGINT AS ps
  UNION ALL
  SELECT x.rn,
    CASE WHEN f <= x.at THEN x.at + x.duration ELSE f END,
    CASE WHEN f <= x.at THEN NULL ELSE x.build END, CASE WHEN f <= x.at THEN NULL ELSE x.duration END,
    CASE WHEN f <= x.at THEN x.build WHEN w IS NOT NULL THEN w END, CASE WHEN f <= x.at THEN 'run' WHEN w IS NOT NULL THEN 'superseded' END, CASE WHEN f <= x.at OR w IS NOT NULL THEN x.at END,
    CASE WHEN x.started THEN x.wb END, CASE WHEN x.started THEN x.free END
  FROM (SELECT *, CASE WHEN started THEN free + wd ELSE free END AS f, CASE WHEN started THEN NULL ELSE wb END AS w
        FROM (SELECT s.free, s.wb, s.wd, c.*, s.wb IS NOT NULL AND s.free <= c.at AS started FROM s JOIN c ON c.rn = s.rn + 1)) x),
o AS (SELECT ob AS build, oo AS outcome, os AS start FROM s WHERE ob IS NOT NULL UNION ALL SELECT pb, 'run', ps FROM s WHERE pb IS NOT NULL UNION ALL SELECT wb, 'run', free FROM s WHERE rn = (SELECT max(rn) FROM c) AND wb IS NOT NULL)
SELECT build, outcome, start FROM o""")
def single_slot(spark: SparkSession, d: str) -> DataFrame:
    """Build requests with one slot and one place to wait."""
    rows = b.table(spark, d, "events").select(F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("build"), (F.col("event_id") * 100).alias("at"), (F.floor("value") * 10).cast("bigint").alias("duration"))
    return events.single_slot(rows)


# functions ---------------------------------------------------------------------------------------------------------------
_GLOBS = ("https://*.example.com/*", "http*://**/en/*", "*//m.*/??/[0-9]*", "**/de/[!1-5]*.html", "http*:/**")


@query("SELECT page_id, " + ", ".join(f"regexp_matches(url, '{globs.to_regex(g, x)}') AS m{i}_{x}" for i, g in enumerate(_GLOBS[:3] + _GLOBS[4:]) for x in (globs.LABEL, globs.PATH, globs.DEEP)) + " FROM pages")
def glob_dialects(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return b.table(spark, d, "pages").select("page_id", *(globs.matches(url, g, x).alias(f"m{i}_{x}") for i, g in enumerate(_GLOBS[:3] + _GLOBS[4:]) for x in (globs.LABEL, globs.PATH, globs.DEEP)))


@query("""
WITH p AS (SELECT regexp_replace(url, '[?#].*$', '') AS path, page_id FROM pages)
SELECT page_id, array_to_string(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), '/') AS parent, regexp_matches(path, '[*?\\[]') AS wild FROM p""")
def literal_prefix(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace("url", "[?#].*$", "")
    return b.table(spark, d, "pages").select("page_id", globs.literal_prefix(path).alias("parent"), globs.has_wildcards(path).alias("wild"))


@query(rf"""
WITH {SQL_TARGETS}
SELECT label, regexp_replace(regexp_replace(label, '^//', ''), ':[^:]*$', '') AS package_of, split_part(label, ':', 2) AS name_of, '//' || package || ':x' AS own, '//y:z' AS absolute,
 package || '/src/a.c' AS path, package AS here, 'top.c' AS rooted, package LIKE 'asia/%' AS below, regexp_replace(label, '[^A-Za-z0-9]', '_', 'g') AS safe FROM t""")
def label_functions(spark: SparkSession, d: str) -> DataFrame:
    lab, package = F.col("label"), F.col("package")
    return b.targets(spark, d).select(
        "label", labels.package_of(lab).alias("package_of"), labels.name_of(lab).alias("name_of"), labels.resolve_dep(package, F.lit(":x")).alias("own"), labels.resolve_dep(package, F.lit("//y:z")).alias("absolute"),
        labels.resolve_path(package, F.lit("src/a.c")).alias("path"), labels.resolve_path(package, F.lit(".")).alias("here"), labels.resolve_path(package, F.lit("//top.c")).alias("rooted"),
        labels.is_subpackage(package, F.lit("asia")).alias("below"), labels.sanitize(lab).alias("safe"),
    )


@query("""
SELECT o_orderkey, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%d.%02ds', ((ms + 5) // 10) // 100, ((ms + 5) // 10) % 100) ELSE printf('%d.%dm', ((ms + 3000) // 6000) // 10, ((ms + 3000) // 6000) % 10) END AS took,
 CASE WHEN ms < 1024 THEN ms || ' B' WHEN ms < 1048576 THEN printf('%d.%d KiB', ((ms * 10 + 512) // 1024) // 10, ((ms * 10 + 512) // 1024) % 10) ELSE printf('%d.%d MiB', ((ms * 10 + 524288) // 1048576) // 10, ((ms * 10 + 524288) // 1048576) % 10) END AS size, (ms * 60)::BIGINT AS secs
FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS ms FROM orders)""")
def durations_and_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("ms"))
    return rows.select("o_orderkey", text.format_duration(F.col("ms")).alias("took"), text.human_bytes(F.col("ms")).alias("size"), text.parse_duration(F.concat(F.col("ms").cast("string"), F.lit("m"))).alias("secs"))


@query(r"""
WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS name FROM documents)
SELECT name, regexp_matches(name, '^[A-Za-z0-9_-]+\z') AS workspace, regexp_matches(name, '^[^/:]+\z') AS target, regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_-]*\z') AS task, regexp_matches(name, '^[A-Za-z0-9_-][A-Za-z0-9._-]*\z') AS segment FROM n""")
def name_rules(spark: SparkSession, d: str) -> DataFrame:
    words = b.table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("name")).distinct()
    return words.select("name", *(labels.is_valid_name(F.col("name"), k).alias(k) for k in ("workspace", "target", "task", "segment")))


@query("""
SELECT event_id, CASE event_type WHEN 'error' THEN 'undeclared' WHEN 'view' THEN 'network' WHEN 'click' THEN 'missing' WHEN 'signup' THEN 'declared' END AS cause,
 CASE event_type WHEN 'error' THEN '/data/' || user_id || '.bin' WHEN 'signup' THEN '/work/out' END AS path FROM events""")
def denial_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    said = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("start\ncat: '/data/"), user, F.lit(".bin': Permission denied\n")))
        .when(F.col("event_type") == "view", "curl: Could not resolve host: example.com").when(F.col("event_type") == "click", "ld: cannot open shared object")
        .when(F.col("event_type") == "signup", "open (/work/out): Operation not permitted").otherwise("assertion failed")
    )
    return b.table(spark, d, "events").select(
        "event_id", diagnose.diagnose(F.lit(1), said, F.array(F.lit("/work"), F.lit("/tmp")), F.lit(False)).alias("cause"), diagnose.first_denied_path(said).alias("path")
    )


@query("SELECT n_name || ' ' || r_name AS reference, lower(r_name) AS cwd, '//' || lower(r_name) || ':' || n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def task_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Names that one package in each region defines, looked up from within that region."""
    rows = b.table(spark, d, "nation").join(b.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    known = b.table(spark, d, "nation").crossJoin(b.table(spark, d, "region")).select(F.lower("r_name").alias("package"), F.col("n_name").alias("name"))
    asked = rows.select(F.col("n_name").alias("reference"), F.lower("r_name").alias("cwd"), "r_name")
    found = tasks.resolve(asked.select("reference", "cwd"), known)
    return found.join(asked, ["reference", "cwd"]).select(F.concat_ws(" ", "reference", "r_name").alias("reference"), "cwd", "label")


@query("SELECT doc_id, regexp_matches(name, '^kiln(\\.[A-Za-z0-9_-]+)?\\.(yaml|yml|json)$') AS is_config FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'kiln.yaml' WHEN 1 THEN 'kiln.' || source || '.json' WHEN 2 THEN 'kiln.' || source || '.x.yml' ELSE source || '.yaml' END AS name FROM documents)")
def config_filenames(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    name = F.when(k == 0, "kiln.yaml").when(k == 1, F.concat(F.lit("kiln."), "source", F.lit(".json"))).when(k == 2, F.concat(F.lit("kiln."), "source", F.lit(".x.yml"))).otherwise(F.concat("source", F.lit(".yaml")))
    return b.table(spark, d, "documents").select("doc_id", labels.is_config_filename(name, "kiln").alias("is_config"))


@query("SELECT p_type, array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT p_brand) FILTER (WHERE p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#22%'), ['HOME']))), ',') AS env FROM part GROUP BY 1")
def env_patterns(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "part").groupBy("p_type").agg(F.collect_set("p_brand").alias("names"))
    return rows.select("p_type", F.array_join(labels.expand_env(F.col("names"), ["Brand#1*", "HOME", "Brand#22*"]), ",").alias("env"))


from . import rule_queries  # noqa: E402, F401  registers its queries here
