"""Views with the shapes of the engine's tables over the star-schema test tables. The same text runs in Spark and, as CTEs, in the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_files": """
SELECT CAST(p_partkey AS BIGINT) AS file_id,
  concat(CASE p_partkey % 5 WHEN 0 THEN 'src/' WHEN 1 THEN 'app/' WHEN 2 THEN 'tests/' WHEN 3 THEN 'lib/' ELSE '' END,
         'd', CAST(p_size AS STRING), '/p', CAST(p_partkey AS STRING), '/',
         CASE WHEN p_partkey % 35 = 5 THEN 'package' WHEN p_partkey % 35 = 4 THEN 'README' WHEN p_partkey % 17 = 0 THEN 'index' ELSE concat('m', CAST(p_partkey AS STRING)) END,
         CASE p_partkey % 7 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' WHEN 2 THEN '.py' WHEN 3 THEN '.go' WHEN 4 THEN '.md' WHEN 5 THEN '.json' ELSE '.sh' END) AS path,
  FALSE AS is_directory,
  CASE WHEN p_partkey % 3 <> 0 THEN concat(p_name, ' for ', p_brand) END AS summary,
  CASE WHEN p_partkey % 29 <> 0 THEN 1704067200000 + CAST(p_partkey AS BIGINT) * 60000 END AS mtime,
  CASE WHEN p_size % 4 = 0 THEN 1704067200000 + CAST(p_partkey AS BIGINT) END AS summary_stale_since,
  CASE WHEN p_size % 5 = 0 THEN 1704067200000 + CAST(p_partkey AS BIGINT) END AS concepts_stale_since,
  CASE WHEN p_size % 6 = 0 THEN 1704067200000 + CAST(p_partkey AS BIGINT) END AS change_impact_stale_since,
  CASE WHEN p_partkey % 2 = 0 THEN concat('{"functions":["make', p_type, '"],"classes":["', replace(p_brand, '#', ''), '"],"interfaces":[],"exports":["make', p_type, '"],"purpose":"', p_name, ' helper"}') END AS concepts,
  CASE WHEN p_partkey % 10 = 0 THEN concat('{"riskLevel":"low","affectedAreas":["', lower(p_type), '"],"breakingChanges":[],"summary":"x"}') END AS change_impact
FROM part""",
    # between blocks of 128 keys edges lead from the greater key to the lesser, so cycles stay within blocks and differ in size
    "fx_deps": """
SELECT CASE WHEN a.l_partkey % 128 - a.l_partkey = b.l_partkey % 128 - b.l_partkey THEN a.l_partkey ELSE greatest(a.l_partkey, b.l_partkey) END AS source_id,
       CASE WHEN a.l_partkey % 128 - a.l_partkey = b.l_partkey % 128 - b.l_partkey THEN b.l_partkey ELSE least(a.l_partkey, b.l_partkey) END AS target_id,
       'local_import' AS dependency_type,
       CASE WHEN a.l_returnflag = 'R' THEN 'inherits' WHEN a.l_returnflag = 'A' THEN 're_exports' ELSE 'imports' END AS edge_type,
       CASE WHEN a.l_linestatus = 'F' THEN 1.0 ELSE 0.8 END AS confidence,
       CAST(1 AS BIGINT) AS weight,
       CASE WHEN a.l_linenumber % 3 <> 0 THEN concat('["n', CAST(b.l_linenumber AS STRING), '","k', CAST(a.l_suppkey % 3 AS STRING), '"]') END AS imported_names,
       CASE WHEN a.l_linenumber % 3 <> 0 THEN a.l_linenumber END AS import_line
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
UNION ALL
SELECT l_partkey, -1 - l_suppkey, 'package_import', 'imports', 1.0, CAST(1 AS BIGINT), NULL, NULL
FROM lineitem""",
    "fx_symbols": """
SELECT c_custkey AS id, c_custkey AS file_id, concat('fn', CAST(c_custkey % 50 AS STRING)) AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'function' WHEN 'AUTOMOBILE' THEN 'class' WHEN 'MACHINERY' THEN 'interface' WHEN 'HOUSEHOLD' THEN 'type' ELSE 'const' END AS kind,
  c_nationkey + 1 AS start_line, c_nationkey + 11 AS end_line, c_acctbal >= 0 AS is_export
FROM customer""",
    "fx_calls": """
SELECT o_orderkey AS id, o_custkey AS caller_symbol_id,
  (o_orderkey * 31) % (SELECT CAST(2 * count(*) AS BIGINT) FROM customer) AS callee_symbol_id,
  o_orderkey % 200 + 1 AS call_line, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.8 END AS confidence
FROM orders""",
    "fx_changes": """
SELECT event_id, ts, concat('f', CAST(user_id AS STRING)) AS path,
  CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END AS event_type,
  CAST(floor(value / 25) AS INT) AS importance
FROM events""",
    # first community row per file wins; some files have two, some none
    "fx_communities": """
SELECT CAST(p_partkey AS BIGINT) * 2 AS id, CAST(p_partkey AS BIGINT) AS file_id, p_size % 7 AS community_id FROM part WHERE p_partkey % 4 <> 1
UNION ALL
SELECT CAST(p_partkey AS BIGINT) * 2 + 1, CAST(p_partkey AS BIGINT), p_size % 5 FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 <> 1""",
    # what a scan of the disk finds: some files gone, some touched, some new
    "fx_disk": """
SELECT CAST(p_partkey AS BIGINT) + CASE WHEN p_partkey % 41 = 0 THEN 1000000 ELSE 0 END AS file_id,
  1704067200000.0 + CAST(p_partkey AS BIGINT) * 60000 + CASE p_partkey % 13 WHEN 0 THEN 5000.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS mtime
FROM part WHERE p_partkey % 23 <> 0""",
    # two versions of each file's exports
    "fx_exports": """
SELECT c_custkey % 300 AS file_id, 1 AS version, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'type' ELSE 'function' END AS kind, concat('sig', CAST(c_nationkey AS STRING)) AS signature FROM customer WHERE c_custkey % 300 % 6 <> 5
UNION ALL
SELECT c_custkey % 300, 2, c_name, CASE WHEN c_nationkey % 2 = 0 THEN 'type' ELSE 'function' END, concat('sig', CAST(CASE WHEN c_custkey % 300 % 6 = 1 AND c_nationkey % 2 = 0 OR c_custkey % 300 % 6 = 2 AND c_custkey % 3 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS STRING)) FROM customer WHERE c_custkey % 300 % 6 <> 3 OR c_custkey % 2 = 0""",
    "fx_imports": """
SELECT file_id, v.version AS version, concat('./m', CAST(file_id % 11 AS STRING), CASE WHEN v.version = 2 AND file_id % 6 = 4 THEN 'x' ELSE '' END) AS specifier
FROM (SELECT DISTINCT c_custkey % 300 AS file_id FROM customer) s CROSS JOIN (SELECT 1 AS version UNION ALL SELECT 2) v WHERE v.version = 2 OR file_id % 6 <> 5""",
}
TABLES = ("part", "lineitem", "customer", "orders", "events")


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return {name: spark.sql(text) for name, text in VIEWS.items()}


def with_views(sql: str, *ctes: tuple[str, str]) -> str:
    """sql after the views that it or the given CTEs name."""
    body = "\n".join(t for _, t in ctes) + sql
    needed = [(n, t) for n, t in VIEWS.items() if n in body]
    every = [*needed, *ctes]
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({t})" for n, t in every) + "\n" if every else "") + sql
