"""The registered queries of the engine over the fixture views, and the SQL that each must agree with.

Queries run over whole fixture views. The SQL is written on its own, from the meaning of each operator, so that it checks the plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import changes, deps, files, graph, jobs, symbols
from ..store import replace_by_key, upsert
from .fixtures import frames, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TS = 1_800_000_000_000

CNT = (
    "cnt",
    """SELECT file_id, CAST(sum(d) AS BIGINT) AS dependencies, CAST(sum(p) AS BIGINT) AS packages, CAST(sum(i) AS BIGINT) AS dependents FROM (
  SELECT source_id AS file_id, CASE WHEN dependency_type = 'local_import' THEN 1 ELSE 0 END AS d, CASE WHEN dependency_type = 'package_import' THEN 1 ELSE 0 END AS p, 0 AS i FROM fx_deps
  UNION ALL SELECT target_id, 0, 0, 1 FROM fx_deps) GROUP BY file_id""",
)
F0 = ("f0", "SELECT fx_files.*, regexp_extract(path, '[^/]+$') AS name, regexp_extract(path, '[^/](\\.[^./]*)$', 1) AS ext, split_part(path, '/', 1) AS top FROM fx_files")
F1 = (
    "f",
    """SELECT g.*, CAST(least(10, base + least(dependents, 3) + least(dependencies, 2) + least(packages, 1)) AS INT) AS importance FROM (
  SELECT f0.*, coalesce(dependencies, 0) AS dependencies, coalesce(packages, 0) AS packages, coalesce(dependents, 0) AS dependents,
    least(10, CASE WHEN ext IN ('.ts', '.tsx') THEN 3
      WHEN ext = '.json' THEN CASE WHEN name IN ('package.json', 'tsconfig.json', 'composer.json') THEN 3 ELSE 1 END
      WHEN ext = '.md' THEN CASE WHEN lower(name) = 'readme.md' THEN 2 ELSE 1 END
      WHEN ext IN ('.js', '.py', '.go') THEN 2 WHEN ext = '.sh' THEN 1 ELSE 0 END
      + CASE WHEN top IN ('src', 'app') THEN 2 WHEN top IN ('test', 'tests') THEN 1 ELSE 0 END
      + CASE WHEN name LIKE 'index.%' THEN 2 ELSE 0 END) AS base
  FROM f0 LEFT JOIN cnt USING (file_id)) g""",
)
STALE = "(summary_stale_since IS NOT NULL OR concepts_stale_since IS NOT NULL OR change_impact_stale_since IS NOT NULL)"
ANC = ("anc", "SELECT f.*, array_to_string(string_split(path, '/')[1:i], '/') AS directory FROM f, LATERAL (SELECT unnest(range(1, len(string_split(path, '/')))) AS i) u")
LOCAL = ("loc", "SELECT * FROM fx_deps WHERE dependency_type = 'local_import'")


def query(sql: str | None = None, *ctes: tuple[str, str]):
    def add(f: Callable[[dict[str, DataFrame]], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Frames(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(sql, *ctes)
        return f

    return add


class Frames(dict):
    """The fixture views, and files with importance."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(frames(spark, sf_dir))
        self.spark, self.sf_dir = spark, sf_dir
        self.files, self.deps, self.symbols, self.calls = (self[f"fx_{n}"] for n in ("files", "deps", "symbols", "calls"))
        self.rated = files.rated(self.files, self.deps)
        self.local = deps.local(self.deps)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


RATED = (CNT, F0, F1)


@query("SELECT path, importance, dependents, dependencies FROM f WHERE NOT is_directory ORDER BY importance DESC, path LIMIT 10", *RATED)
def important_files(t):
    return files.top(t.rated, 10).select("path", "importance", "dependents", "dependencies")


@query("SELECT path, importance FROM f", *RATED)
def importance(t):
    return t.rated.select("path", "importance")


@query("SELECT path, importance, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 25 AS truncated FROM f ORDER BY importance DESC, path LIMIT 25", *RATED)
def list_files(t):
    return files.listed(t.rated, 25).select("path", "importance", "total", "truncated")


LISTS = """SELECT f.file_id, path, importance,
  coalesce((SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT target_id AS x FROM fx_deps d WHERE d.source_id = f.file_id AND dependency_type = 'local_import')), '') AS deps,
  coalesce((SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT source_id AS x FROM fx_deps d WHERE d.target_id = f.file_id)), '') AS dependents,
  coalesce((SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT target_id AS x FROM fx_deps d WHERE d.source_id = f.file_id AND dependency_type = 'package_import')), '') AS packages FROM f"""


@query(LISTS, *RATED)
def files_with_deps(t):
    return deps.with_lists(t.rated.select("file_id", "path", "importance"), t.deps)


@query(LISTS + " WHERE file_id = 75", *RATED)
def file_lookup(t):
    one = t.rated.filter("file_id = 75").select("file_id", "path", "importance")
    return deps.with_lists(one, t.deps.filter("source_id = 75 or target_id = 75"))


@query("SELECT file_id, path, name, mtime, importance, summary FROM f ORDER BY path", *RATED)
def all_files(t):
    return t.rated.select("file_id", "path", "name", "mtime", "importance", "summary").orderBy("path")


@query("SELECT source_id, target_id, edge_type, CAST(confidence AS DOUBLE) AS confidence, weight FROM loc", LOCAL)
def dependencies(t):
    return t.local.select("source_id", "target_id", "edge_type", F.col("confidence").cast("double").alias("confidence"), "weight")


@query("SELECT source_id, target_id FROM fx_deps WHERE target_id = 75")
def dependents(t):
    return t.deps.filter("target_id = 75").select("source_id", "target_id")


PKG = "CASE WHEN target_id % 2 = 0 THEN '@scope' || CAST(-target_id % 5 AS VARCHAR) || '/pkg' || CAST(-target_id AS VARCHAR) ELSE 'pkg' || CAST(-target_id AS VARCHAR) END"


@query(f"SELECT source_id, {PKG} AS package, CASE WHEN {PKG} LIKE '@%' THEN split_part({PKG}, '/', 1) END AS scope FROM fx_deps WHERE dependency_type = 'package_import'")
def package_deps(t):
    return deps.packages(t.deps).select("source_id", F.expr(PKG.replace("VARCHAR", "STRING")).alias("package")).withColumn("scope", paths.scope_of(F.col("package")))


@query("SELECT source_id, target_id, weight FROM loc", LOCAL)
def local_edges(t):
    return t.local.select("source_id", "target_id", "weight")


@query("SELECT path, mtime FROM fx_files WHERE mtime > 1704067800000 ORDER BY mtime DESC, path LIMIT 200")
def changed_since(t):
    return files.changed_since(t.files, 1_704_067_800_000, 200).select("path", "mtime")


@query("SELECT file_id, path FROM fx_files WHERE path IN (SELECT path FROM fx_files WHERE file_id % 50 = 3)")
def files_by_paths(t):
    return files.by_paths(t.files, t.files.filter("file_id % 50 = 3").select("path")).select("file_id", "path")


@query("SELECT id, name, kind, start_line, end_line, is_export FROM fx_symbols WHERE file_id = 77 ORDER BY start_line")
def symbols_for_file(t):
    return t.symbols.filter("file_id = 77").orderBy("start_line").select("id", "name", "kind", "start_line", "end_line", "is_export")


@query("SELECT path, summary_stale_since, concepts_stale_since, change_impact_stale_since FROM fx_files")
def staleness(t):
    return t.files.select("path", *files.STALE)


@query(f"SELECT count(*) AS stale FROM fx_files WHERE {STALE}")
def stale_count(t):
    return t.files.agg(F.count(F.when(files.is_stale(), 1)).alias("stale"))


@query("SELECT path FROM fx_files WHERE NOT (path LIKE '%.git%' OR path LIKE '%node_modules%' OR regexp_extract(path, '[^/]+$') LIKE '.loamgraph%' OR lower(path) LIKE '%.sh' OR regexp_matches(path, '^(.*/)?tests/.*$'))")
def exclude_filter(t):
    return t.files.filter(~paths.excluded(F.col("path"), ("**/*.sh", "tests/**"))).select("path")


@query("SELECT path FROM fx_files WHERE NOT regexp_matches(path, '[^/]\\.(md|json)$')")
def job_filter(t):
    return t.files.filter(jobs.takes_concepts(F.col("path"))).select("path")


@query(
    """SELECT target_id AS file_id, string_agg(CAST(source_id AS VARCHAR), ',' ORDER BY source_id) AS dependents FROM (
  SELECT DISTINCT target_id, source_id FROM loc WHERE target_id IN (SELECT file_id FROM fx_files)) GROUP BY target_id""",
    LOCAL,
)
def reverse_edges(t):
    return deps.reverse(t.deps, t.files)


@query(
    """SELECT k.target_id, k.source_id, coalesce(n.names, '') AS names, coalesce(l.lines, '') AS lines FROM (SELECT DISTINCT target_id, source_id FROM loc) k
  LEFT JOIN (SELECT target_id, source_id, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT target_id, source_id, unnest(from_json(imported_names, '["VARCHAR"]')) AS x FROM loc) GROUP BY ALL) n USING (target_id, source_id)
  LEFT JOIN (SELECT target_id, source_id, string_agg(CAST(import_line AS VARCHAR), ',' ORDER BY import_line) AS lines FROM loc WHERE import_line IS NOT NULL GROUP BY ALL) l USING (target_id, source_id)""",
    LOCAL,
)
def dependents_with_imports(t):
    return deps.dependents_with_imports(t.deps)


def call_sql(near: str, far: str, name: str) -> str:
    return f"""SELECT total, unresolved, path, symbol, kind, start_line, call_line, confidence, call_id, CASE WHEN total = 0 THEN 'no call edges are known for this symbol' END AS warning FROM
  (SELECT count(*) AS total, count(*) FILTER ({far}_symbol_id NOT IN (SELECT id FROM fx_symbols)) AS unresolved FROM fx_calls WHERE {near}_symbol_id IN (SELECT id FROM fx_symbols WHERE name = '{name}') AND caller_symbol_id <> callee_symbol_id) c,
  (SELECT path, s.name AS symbol, kind, start_line, call_line, CAST(k.confidence AS DOUBLE) AS confidence, k.id AS call_id FROM fx_calls k JOIN fx_symbols s ON s.id = k.{far}_symbol_id JOIN fx_files f USING (file_id)
   WHERE k.{near}_symbol_id IN (SELECT id FROM fx_symbols WHERE name = '{name}') AND caller_symbol_id <> callee_symbol_id ORDER BY path, start_line, k.id LIMIT 50) r"""


@query(call_sql("callee", "caller", "fn7"))
def find_callers(t):
    return symbols.callers(t.calls, t.symbols, t.files, "fn7").withColumn("confidence", F.col("confidence").cast("double"))


@query(call_sql("caller", "callee", "fn8"))
def find_callees(t):
    return symbols.callees(t.calls, t.symbols, t.files, "fn8").withColumn("confidence", F.col("confidence").cast("double"))


@query("SELECT count(*) FILTER (caller_symbol_id NOT IN (SELECT id FROM fx_symbols)) AS unresolved_callers, count(*) FILTER (callee_symbol_id NOT IN (SELECT id FROM fx_symbols)) AS unresolved_callees FROM fx_calls")
def unresolved_calls(t):
    return symbols.unresolved(t.calls, t.symbols)


@query("SELECT name, kind, path, start_line, is_export, (SELECT count(*) FROM fx_symbols WHERE starts_with(name, 'fn1')) AS total FROM fx_symbols s JOIN fx_files USING (file_id) WHERE starts_with(name, 'fn1') ORDER BY is_export DESC, path, start_line, s.id LIMIT 50")
def find_symbol(t):
    return symbols.find(t.symbols, t.files, "fn1*").select("name", "kind", "path", "start_line", "is_export", "total")


@query("SELECT count(*) AS total, count(*) FILTER (summary <> '') AS with_summary, count(concepts) AS with_concepts, count(*) FILTER (summary IS NULL OR summary = '') AS pending_summary, count(*) FILTER (concepts IS NULL) AS pending_concepts FROM fx_files WHERE NOT is_directory")
def llm_progress(t):
    return files.progress(t.files)


@query(f"SELECT count(*) AS files, count(summary) AS with_summary, count(concepts) AS with_concepts, count(*) FILTER ({STALE}) AS stale, (SELECT count(*) FROM loc) AS local_edges FROM fx_files", LOCAL)
def repo_stats(t):
    return files.statistics(t.files, t.deps)


@query(f"SELECT directory, count(*) AS files, round(avg(importance), 1) AS avg_importance, CAST(round(CAST(count(summary) AS DOUBLE) / count(*) * 100) AS BIGINT) AS pct_summary, CAST(round(CAST(count(*) FILTER ({STALE}) AS DOUBLE) / count(*) * 100) AS BIGINT) AS pct_stale FROM anc GROUP BY directory", *RATED, ANC)
def dir_detail(t):
    return files.directory_statistics(t.rated)


@query("SELECT directory, path, importance, rank FROM (SELECT directory, path, importance, row_number() OVER (PARTITION BY directory ORDER BY importance DESC, path) AS rank FROM anc) WHERE rank <= 10", *RATED, ANC)
def dir_top_files(t):
    return files.directory_top(t.rated)


@query("SELECT CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '' END AS directory, count(*) AS files FROM fx_files GROUP BY 1 ORDER BY files DESC, directory")
def dir_counts(t):
    return files.directory_counts(t.files)


@query("SELECT source_id, target_id, edge_type, CAST(sum(weight) AS BIGINT) AS weight FROM loc GROUP BY ALL", LOCAL)
def edge_weights(t):
    return deps.weights(t.deps)


@query("SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM loc WHERE source_id <> target_id GROUP BY ALL", LOCAL)
def undirected_weights(t):
    return deps.undirected(t.deps)


@query("SELECT 'r' || CAST(user_id % 50 AS VARCHAR) AS repo, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, CAST(sum(CAST(floor(value) AS BIGINT)) - coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (event_id < 500 AND user_id % 50 <> 7), 0) AS BIGINT) AS session FROM events GROUP BY 1")
def token_totals(t):
    usage = t.table("events").select(F.concat(F.lit("r"), (F.col("user_id") % 50).cast("string")).alias("repo"), F.floor("value").cast("long").alias("tokens"), "event_id", "user_id")
    before = jobs.tokens_by_repo(usage.filter("event_id < 500 and user_id % 50 <> 7")).withColumnRenamed("total", "tokens")
    return jobs.tokens_by_repo(usage, before)


def search_sql(tokens: list[str]) -> str:
    values = ", ".join(f"('{t}')" for t in tokens)
    some = lambda col, key: f"coalesce(list_bool_or(list_transform(from_json(json_extract({col}, '$.{key}'), '[\"VARCHAR\"]'), lambda v: contains(lower(v), tok))), false)"
    return f"""SELECT path, total_rank, hits, importance, purpose FROM (SELECT path, CAST(sum(rank) AS BIGINT) AS total_rank, count(*) AS hits, any_value(importance) AS importance, any_value(purpose) AS purpose FROM (
    SELECT *, row_number() OVER (PARTITION BY tok ORDER BY rank DESC, importance DESC, path) AS rn FROM (
      SELECT path, importance, tok, json_extract_string(concepts, '$.purpose') AS purpose,
        CASE WHEN {some("concepts", "functions")} OR {some("concepts", "classes")} OR {some("concepts", "interfaces")} OR {some("concepts", "exports")} THEN 100
          WHEN coalesce(contains(lower(json_extract_string(concepts, '$.purpose')), tok), false) OR {some("change_impact", "affectedAreas")} THEN 50
          WHEN coalesce(contains(lower(summary), tok), false) THEN 20 WHEN contains(lower(path), tok) THEN 10 ELSE 0 END AS rank
      FROM f, (VALUES {values}) v(tok)) WHERE rank > 0) WHERE rn <= 500 GROUP BY path) ORDER BY total_rank DESC, hits DESC, importance DESC, path LIMIT 50"""


@query(search_sql(["brand12", "make", "src"]), *RATED)
def search(t):
    return files.search(t.rated, 'make "Brand12" src x', 50).select("path", "total_rank", "hits", "importance", "purpose")


DIRS = ("dirs", "SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, name, len(string_split(path, '/')) - 1 AS depth, false AS is_directory FROM f UNION ALL SELECT DISTINCT directory, CASE WHEN directory LIKE '%/%' THEN regexp_replace(directory, '/[^/]*$', '') ELSE '' END, regexp_extract(directory, '[^/]+$'), len(string_split(directory, '/')) - 1, true FROM anc")


@query("SELECT path, parent, name, CAST(depth AS INT) AS depth, is_directory FROM dirs", *RATED, ANC, DIRS)
def dir_tree(t):
    return files.tree(t.files)


@query("SELECT path, name, is_directory FROM dirs WHERE parent = 'src' ORDER BY is_directory DESC, name", *RATED, ANC, DIRS)
def tree_entries(t):
    return files.entries(files.tree(t.files), "src").select("path", "name", "is_directory")


@query("SELECT path, name FROM dirs WHERE path LIKE 'src/%' AND instr(substr(path, 5), '/') = 0", *RATED, ANC, DIRS)
def children(t):
    return files.children(files.tree(t.files), "src").select("path", "name")


@query("SELECT DISTINCT file_id FROM (SELECT source_id AS file_id FROM fx_deps UNION ALL SELECT target_id FROM fx_deps)")
def graph_nodes_all(t):
    return graph.nodes(t.deps)


DEG = ("deg", "SELECT file_id, count(*) AS degree FROM (SELECT source_id AS file_id FROM loc UNION ALL SELECT target_id FROM loc) GROUP BY file_id")


@query("SELECT file_id, degree FROM deg", LOCAL, DEG)
def graph_degree(t):
    return graph.degree(t.local)


NODES = f"SELECT f.file_id, path, importance, CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '' END AS directory, summary IS NOT NULL AS has_summary, {STALE} AS is_stale, community_id, degree FROM f JOIN deg USING (file_id) LEFT JOIN (SELECT file_id, arg_min(community_id, id) AS community_id FROM fx_communities GROUP BY file_id) USING (file_id)"


@query(NODES, *RATED, LOCAL, DEG)
def graph_nodes(t):
    return graph.graph_nodes(t.local, t.rated, t["fx_communities"])


SUB = ("sub", "SELECT source_id, target_id FROM fx_deps WHERE dependency_type = 'local_import' AND (source_id IN (SELECT file_id FROM fx_files WHERE path LIKE 'src/d1%/%') OR target_id IN (SELECT file_id FROM fx_files WHERE path LIKE 'src/d1%/%'))".replace("src/d1%/%", "src/d12/%"))


@query("SELECT 'edge' AS what, source_id AS a, target_id AS b, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS BIGINT) AS degree FROM sub UNION ALL SELECT 'node', file_id, NULL, path, count(*) FROM (SELECT source_id AS file_id FROM sub UNION ALL SELECT target_id FROM sub) JOIN fx_files USING (file_id) GROUP BY file_id, path", SUB)
def graph_data(t):
    e = graph.subtree_edges(t.local, t.files, "src/d12").select("source_id", "target_id")
    n = graph.graph_nodes(e, t.rated, t["fx_communities"])
    return e.select(F.lit("edge").alias("what"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("degree")).unionByName(n.select(F.lit("node").alias("what"), F.col("file_id").alias("a"), F.lit(None).cast("long").alias("b"), "path", "degree"))


@query("SELECT coalesce(n.file_id, o.file_id) AS file_id, coalesce(n.path, o.path) AS path, CASE WHEN n.file_id IS NOT NULL THEN n.summary ELSE o.summary END AS summary, CASE WHEN n.file_id IS NOT NULL THEN n.mtime ELSE o.mtime END AS mtime, o.summary_stale_since, o.concepts FROM fx_files o FULL JOIN (SELECT file_id + CASE WHEN file_id % 10 = 0 THEN 5000000 ELSE 0 END AS file_id, path || '.new' AS path, 'new' AS summary, mtime + 1 AS mtime FROM fx_files WHERE file_id % 5 = 0) n ON n.file_id = o.file_id")
def upsert_files(t):
    new = t.files.filter("file_id % 5 = 0").selectExpr("file_id + case when file_id % 10 = 0 then 5000000 else 0 end as file_id", "concat(path, '.new') as path", "'new' as summary", "mtime + 1 as mtime")
    return upsert(t.files, new, "file_id", ["path", "summary", "mtime"]).select("file_id", "path", "summary", "mtime", "summary_stale_since", "concepts")


NEW = "SELECT source_id, target_id + 1 AS target_id FROM fx_deps WHERE source_id % 4 = 0 AND dependency_type = 'local_import'"


@query(f"SELECT source_id, target_id FROM fx_deps WHERE source_id NOT IN (SELECT source_id FROM ({NEW})) UNION ALL {NEW}")
def replace_edges(t):
    new = t.local.filter("source_id % 4 = 0").selectExpr("source_id", "target_id + 1 as target_id")
    return replace_by_key(t.deps.select("source_id", "target_id"), new, "source_id")


QUERIES["replace_by_key"], ORACLE["replace_by_key"] = QUERIES.pop("replace_edges"), ORACLE.pop("replace_edges")

GONE = "SELECT file_id FROM fx_files WHERE file_id % 7 = 3"
LOST = f"SELECT id FROM fx_symbols WHERE file_id IN ({GONE})"


@query(f"SELECT 'files' AS what, file_id AS a, CAST(NULL AS BIGINT) AS b FROM fx_files WHERE file_id NOT IN ({GONE}) UNION ALL SELECT 'deps', source_id, target_id FROM fx_deps WHERE source_id NOT IN ({GONE}) AND target_id NOT IN ({GONE}) UNION ALL SELECT 'symbols', id, NULL FROM fx_symbols WHERE file_id NOT IN ({GONE}) UNION ALL SELECT 'calls', caller_symbol_id, callee_symbol_id FROM fx_calls WHERE caller_symbol_id NOT IN ({LOST}) AND callee_symbol_id NOT IN ({LOST})")
def delete_cascade(t):
    kept = files.delete_cascade(t.files, t.deps, t.symbols, t.calls, t.files.filter("file_id % 7 = 3"))
    cols = (("files", "file_id", None), ("deps", "source_id", "target_id"), ("symbols", "id", None), ("calls", "caller_symbol_id", "callee_symbol_id"))
    parts = [df.select(F.lit(w).alias("what"), F.col(a).cast("long").alias("a"), (F.col(b) if b else F.lit(None)).cast("long").alias("b")) for df, (w, a, b) in zip(kept, cols, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


PGONE = "SELECT file_id FROM fx_files WHERE path LIKE 'tests/%'"
PLOST = f"SELECT id FROM fx_symbols WHERE file_id IN ({PGONE})"


@query(f"SELECT (SELECT count(*) FROM ({PGONE})) AS files, (SELECT count(*) FROM fx_deps WHERE source_id IN ({PGONE}) OR target_id IN ({PGONE})) AS dependencies, (SELECT count(*) FROM ({PLOST})) AS symbols, (SELECT count(*) FROM fx_calls WHERE caller_symbol_id IN ({PLOST}) OR callee_symbol_id IN ({PLOST})) AS calls")
def purge_matching(t):
    return files.purge(t.files, t.deps, t.symbols, t.calls, F.startswith("path", F.lit("tests/")))[1]


@query(f"SELECT path, CASE WHEN hit THEN {TS} ELSE summary_stale_since END AS summary_stale_since, CASE WHEN hit THEN {TS} ELSE concepts_stale_since END AS concepts_stale_since, CASE WHEN hit THEN {TS} ELSE change_impact_stale_since END AS change_impact_stale_since FROM (SELECT *, importance >= 4 AND (summary_stale_since IS NULL OR concepts_stale_since IS NULL OR change_impact_stale_since IS NULL) AS hit FROM f)", *RATED)
def mark_all_stale(t):
    return files.mark_all_stale(t.rated, TS, 4).select("path", *files.STALE)


@query(f"SELECT path, CASE WHEN importance >= 2 AND summary IS NULL AND summary_stale_since IS NULL THEN {TS} ELSE summary_stale_since END AS summary_stale_since FROM f", *RATED)
def mark_remaining_stale(t):
    return files.mark_all_stale(t.rated, TS, 2, remaining_only=True).select("path", "summary_stale_since")


RES = ("res", "SELECT user_id AS file_id, CASE event_type WHEN 'click' THEN 'summary' WHEN 'view' THEN 'concepts' ELSE 'change_impact' END AS job_type, 'v' || CAST(event_id AS VARCHAR) AS value, event_id AS created_at FROM events")


@query("SELECT path, " + ", ".join(f"CASE WHEN r{i}.v IS NOT NULL THEN r{i}.v ELSE {k} END AS {k}, CASE WHEN r{i}.v IS NULL THEN {k}_stale_since END AS {k}_stale_since" for i, k in enumerate(("summary", "concepts", "change_impact"))) + " FROM fx_files " + " ".join(f"LEFT JOIN (SELECT file_id, arg_max(value, created_at) AS v FROM res WHERE job_type = '{k}' GROUP BY file_id) r{i} USING (file_id)" for i, k in enumerate(("summary", "concepts", "change_impact"))), RES)
def llm_result_apply(t):
    results = t.table("events").select(F.col("user_id").alias("file_id"), F.when(F.col("event_type") == "click", "summary").when(F.col("event_type") == "view", "concepts").otherwise("change_impact").alias("job_type"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"), F.col("event_id").alias("created_at"))
    return files.apply_results(t.files, results).select("path", *[c for k in ("summary", "concepts", "change_impact") for c in (k, f"{k}_stale_since")])


@query(
    """SELECT e.event_id AS edge, e.source_id, e.specifier, i.line FROM (SELECT *, row_number() OVER (PARTITION BY source_id, specifier ORDER BY event_id) AS nth FROM (SELECT event_id, user_id AS source_id, event_type AS specifier FROM events WHERE event_id % 3 <> 0)) e
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY source_id, specifier ORDER BY event_id) AS nth FROM (SELECT event_id, user_id AS source_id, event_type AS specifier, event_id * 2 AS line FROM events WHERE event_id % 3 <> 1)) i USING (source_id, specifier, nth)"""
)
def import_meta_zip(t):
    ev = t.table("events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("source_id"), F.col("event_type").alias("specifier"))
    return deps.zip_metadata(ev.filter("pos % 3 <> 0"), ev.filter("pos % 3 <> 1").withColumn("line", F.col("pos") * 2)).select(F.col("pos").alias("edge"), "source_id", "specifier", "line")


SITES = ("sites", "SELECT k.id, s.file_id, k.caller_symbol_id, 'fn' || CAST(k.id % 60 AS VARCHAR) AS callee_name, k.call_line FROM fx_calls k JOIN fx_symbols s ON s.id = k.caller_symbol_id")
SYM = ("sym", "SELECT id, id % 400 AS file_id, name, start_line FROM fx_symbols")
IMP = ("imp", "SELECT DISTINCT source_id % 400 AS file_id, target_id % 400 AS target_id, 'fn' || CAST((source_id + target_id) % 50 AS VARCHAR) AS imported_name FROM loc")


@query(
    """SELECT caller_symbol_id, coalesce(own.id, far.id) AS callee_symbol_id, call_line, CASE WHEN own.id IS NOT NULL THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM (SELECT *, file_id % 400 AS fid FROM sites) s
  LEFT JOIN (SELECT file_id, name, arg_min(id, start_line * 10000000 + id) AS id FROM sym GROUP BY ALL) own ON own.file_id = s.fid AND own.name = s.callee_name
  LEFT JOIN (SELECT i.file_id, i.imported_name AS name, max(d.id) AS id FROM imp i JOIN (SELECT file_id, name, arg_min(id, start_line * 10000000 + id) AS id FROM sym GROUP BY ALL) d ON d.file_id = i.target_id AND d.name = i.imported_name
    WHERE i.target_id NOT IN (SELECT file_id FROM fx_files WHERE regexp_matches(path, '(^|/)index\\.(ts|js)$')) GROUP BY ALL HAVING count(*) = 1) far ON far.file_id = s.fid AND far.name = s.callee_name
  WHERE coalesce(own.id, far.id) IS NOT NULL""",
    LOCAL, SITES, SYM, IMP,
)
def call_edge_resolve(t):
    sites = t.calls.join(t.symbols.select(F.col("id").alias("caller_symbol_id"), (F.col("file_id") % 400).alias("file_id")), "caller_symbol_id").select("file_id", "caller_symbol_id", F.concat(F.lit("fn"), (F.col("id") % 60).cast("string")).alias("callee_name"), "call_line")
    sym = t.symbols.withColumn("file_id", F.col("id") % 400)
    imp = t.local.select((F.col("source_id") % 400).alias("file_id"), (F.col("target_id") % 400).alias("target_id"), F.concat(F.lit("fn"), ((F.col("source_id") + F.col("target_id")) % 50).cast("string")).alias("imported_name"))
    return symbols.resolve_calls(sites, sym, imp, t.files)


@query("SELECT coalesce(f.file_id, d.file_id) AS file_id, CASE WHEN d.file_id IS NULL THEN 'missing' WHEN f.file_id IS NULL THEN 'new' ELSE 'stale' END AS state FROM fx_files f FULL JOIN fx_disk d ON d.file_id = f.file_id WHERE d.file_id IS NULL OR f.file_id IS NULL OR abs(CAST(f.mtime AS DOUBLE) - CAST(d.mtime AS DOUBLE)) > 1")
def integrity_check(t):
    return files.compare_with_disk(t.files, t["fx_disk"])


REACH = ("reach", "SELECT CAST(75 AS BIGINT) AS file_id, 0 AS depth UNION SELECT d.source_id, r.depth + 1 FROM reach r JOIN (SELECT DISTINCT source_id, target_id FROM fx_deps WHERE dependency_type = 'local_import') d ON d.target_id = r.file_id WHERE r.depth < 10")


@query("SELECT file_id, min(depth) AS depth FROM reach GROUP BY file_id", REACH)
def cascade(t):
    return graph.cascade(t.local, [75])


@query(
    f"SELECT path, CASE WHEN r.file_id IS NOT NULL OR f.file_id % 100 = 50 THEN {TS} ELSE summary_stale_since END AS summary_stale_since, CASE WHEN r.file_id IS NOT NULL THEN {TS} ELSE change_impact_stale_since END AS change_impact_stale_since FROM fx_files f LEFT JOIN (SELECT DISTINCT file_id FROM reach2) r USING (file_id) WHERE f.file_id <> 76",
    ("reach2", REACH[1].replace("reach", "reach2").replace("SELECT CAST(75 AS BIGINT) AS file_id, 0 AS depth", "SELECT CAST(column0 AS BIGINT) AS file_id, 0 AS depth FROM (VALUES (75), (76)) v(column0)")),
)
def apply_changes(t):
    batch = t.files.filter("file_id in (75, 76) or file_id % 100 = 50").selectExpr("file_id", "case when file_id = 76 then 'unlink' else 'change' end as event_type", "file_id in (75, 76) as affects_dependents")
    return changes.apply(t.files, t.local, batch, TS).select("path", "summary_stale_since", "change_impact_stale_since")


PAIRS = ("pr", "SELECT source_id AS a, target_id AS b FROM fx_deps WHERE dependency_type = 'local_import' UNION SELECT r.a, d.target_id FROM pr r JOIN fx_deps d ON d.source_id = r.b AND d.dependency_type = 'local_import'")
CYC = "SELECT CAST(least(x.a, min(x.b)) AS BIGINT) AS cycle_id, x.a AS file_id FROM pr x JOIN pr y ON x.a = y.b AND x.b = y.a GROUP BY x.a"


@query(CYC, PAIRS)
def cycles(t):
    return graph.cycles(t.local)


@query(f"SELECT * FROM ({CYC}) WHERE cycle_id = (SELECT max(cycle_id) FROM ({CYC}))", PAIRS)
def cycles_for_file(t):
    # the members of the cycle with the greatest name, found from one of them
    every = graph.cycles(t.local)
    one = every.agg(F.max("cycle_id")).first()[0]
    return graph.cycles_with(t.local, one if one is not None else -1).select("cycle_id", "file_id")


@query()
def communities(t):
    labels = graph.communities(deps.undirected(t.deps).withColumn("repo", F.lit("r")))
    return graph.community_report(labels, t.rated)


@query(
    """SELECT h.file_id, kind AS change_type, kind <> 'body-only' AS affects_dependents, CASE WHEN before THEN coalesce(changed, '') ELSE '' END AS changed FROM (
  SELECT h.file_id, h.before, c.changed, CASE WHEN NOT h.before THEN 'unknown' WHEN c.changed IS NULL AND i1 IS NOT DISTINCT FROM i2 THEN 'body-only' WHEN c.changed IS NULL THEN 'exports-changed' WHEN c.only_types THEN 'types-changed' ELSE 'exports-changed' END AS kind
  FROM (SELECT file_id, bool_or(version = 1) AS before, bool_or(version = 2) AS after FROM (SELECT file_id, version FROM fx_exports UNION ALL SELECT file_id, version FROM fx_imports) GROUP BY file_id) h
  LEFT JOIN (SELECT file_id, string_agg(DISTINCT name, ',' ORDER BY name) AS changed, bool_and(kind IN ('type', 'interface')) AS only_types FROM (
    SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.name, b.name) AS name, coalesce(b.kind, a.kind) AS kind FROM (SELECT * FROM fx_exports WHERE version = 1) a FULL JOIN (SELECT * FROM fx_exports WHERE version = 2) b ON a.file_id = b.file_id AND a.name = b.name
    WHERE a.name IS NULL OR b.name IS NULL OR a.kind <> b.kind OR a.signature <> b.signature) GROUP BY file_id) c USING (file_id)
  LEFT JOIN (SELECT file_id, coalesce(string_agg(specifier, ',' ORDER BY specifier) FILTER (version = 1), '') AS i1, coalesce(string_agg(specifier, ',' ORDER BY specifier) FILTER (version = 2), '') AS i2 FROM fx_imports GROUP BY file_id) i USING (file_id)
  WHERE h.after) h"""
)
def semantic_diff(t):
    return changes.semantic_diff(t["fx_exports"], t["fx_imports"])


@query(
    """SELECT source_id, coalesce(string_agg(CAST(target_id AS VARCHAR), ',' ORDER BY target_id) FILTER (was IS NULL), '') AS added, coalesce(string_agg(CAST(target_id AS VARCHAR), ',' ORDER BY target_id) FILTER (now IS NULL), '') AS removed FROM
  (SELECT DISTINCT source_id, target_id, 1 AS was FROM loc WHERE target_id % 3 <> 0) a FULL JOIN (SELECT DISTINCT source_id, target_id, 1 AS now FROM loc WHERE target_id % 3 <> 1) b USING (source_id, target_id) WHERE was IS NULL OR now IS NULL GROUP BY source_id""",
    LOCAL,
)
def dep_set_diff(t):
    return deps.set_difference(t.local.filter("target_id % 3 <> 0"), t.local.filter("target_id % 3 <> 1"))


@query(
    """SELECT path, event_type, count(*) AS events, epoch_us(max(ts)) AS last_us, arg_max(event_id, ts) AS last_event_id FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY path, event_type ORDER BY ts, event_id) AS island FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path, event_type ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM fx_changes)) GROUP BY path, event_type, island"""
)
def debounce(t):
    return changes.debounced(t["fx_changes"], "6 hours").select("path", "event_type", "events", F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"), "last_event_id")


JOBS = ("jobs", "SELECT event_id AS id, 'r' || CAST(user_id % 5 AS VARCHAR) AS repo, 'f' || CAST(user_id AS VARCHAR) AS path, event_type AS job_type, CAST(floor(value / 25) AS INT) AS importance, epoch_us(ts) AS created_at, user_id % 9 AS connection FROM events")


def job_frame(t) -> DataFrame:
    return t.table("events").select(F.col("event_id").alias("id"), F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("repo"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("job_type"), F.floor(F.col("value") / 25).cast("int").alias("importance"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"), (F.col("user_id") % 9).alias("connection"))


@query("SELECT repo, path, job_type, arg_max(id, (created_at, id)) AS id FROM jobs GROUP BY ALL", JOBS)
def job_dedup(t):
    return jobs.latest(job_frame(t)).select("repo", "path", "job_type", "id")


@query("SELECT id, importance, created_at, row_number() OVER (ORDER BY importance DESC, created_at, id) AS place FROM jobs ORDER BY importance DESC, created_at, id LIMIT 1000", JOBS)
def job_order(t):
    return jobs.ordered(job_frame(t)).select("id", "importance", "created_at", "place")


@query("SELECT id, connection FROM jobs WHERE connection NOT IN (2, 5)", JOBS)
def job_drop(t):
    return jobs.without(job_frame(t), t.spark.createDataFrame([(2,), (5,)], "connection long")).select("id", "connection")


@query("SELECT path, 'summary' AS job_type, importance FROM f WHERE summary IS NULL OR summary_stale_since IS NOT NULL UNION ALL SELECT path, 'concepts', importance FROM f WHERE (concepts IS NULL OR concepts_stale_since IS NOT NULL) AND ext NOT IN ('.md', '.json')", *RATED)
def stale_jobs(t):
    return jobs.due(t.rated)


@query("SELECT doc_id, 'File: ' || CAST(doc_id AS VARCHAR) || chr(10) || CASE WHEN length(text) > 14336 THEN substr(text, 1, 14336) || chr(10) || '... [truncated]' ELSE text END AS payload FROM documents WHERE text IS NOT NULL")
def job_payload(t):
    return t.table("documents").filter("text is not null").select("doc_id", jobs.payload(F.concat(F.lit("File: "), F.col("doc_id").cast("string")), F.col("text")).alias("payload"))


@query("SELECT event_id, epoch_us(ts) AS us FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def ring_buffer(t):
    return jobs.ring(t.table("events").select(F.col("event_id").alias("id"), "ts")).select(F.col("id").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def ndjson_parse(t):
    return t.table("events").select("event_id", F.from_json("props", "k long").getField("k").alias("k")).filter("k is not null")


@query("SELECT path, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) FILTER (true) IS NOT NULL AS seen, arg_max(event_id, (ts, event_id)) AS event_id FROM fx_changes GROUP BY path")
def changes_source(t):
    return changes.last_events(t["fx_changes"]).select("path", "event_type", F.lit(True).alias("seen"), "event_id")


@query(
    """SELECT metric, id, rate FROM (SELECT metric, id, CASE WHEN value >= was THEN value - was ELSE value END / (CAST(epoch_us(ts) - epoch_us(before) AS DOUBLE) / 1000000.0::DOUBLE) AS rate FROM (
  SELECT event_type AS metric, event_id AS id, value, ts, lag(value) OVER w AS was, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE was IS NOT NULL AND ts > before)"""
)
def metric_rate(t):
    return jobs.rates(t.table("events").select(F.col("event_type").alias("metric"), F.col("event_id").alias("id"), "ts", "value")).select("metric", "id", "rate")


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def href_extract(t):
    return t.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
