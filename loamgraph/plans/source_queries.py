"""Registered queries of the parsers, sources and small operators, over program text and inputs made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import files, graph, jobs, parse, symbols
from ..sources import scan
from ..store import replace_by_key, settled
from .queries import RATED, query

# Program text: part number P (of language P % 8) imports from number P + 8, which lies in directory d<size>, if there is one.
TS = """import {{ fn{q}, helper as h }} from '../d{z}/m{q}';
import React from 'react-dom/server';
// import nope from './nope';
const s{p} = "import './no'";
export function fn{p}(a: number) {{ return fn{q}(a); }}
export class C{p} extends fn{q} {{ run() {{ return local{p}(); }} }}
function local{p}() {{ return 1; }}
export type T{p} = {{ a: number }};
export * from '../d{z}/m{q}';
const lazy{p} = require('@s/k{p}/x');
export const ar{p} = () => local{p}();
interface I{p} {{ x: number }}
enum E{p} {{ A }}
import '~/d{z}/m{q}';
const re{p} = /["']/; import z{p} from 'after-regex';
"""
PY = """import os
from ..d{z}.m{q} import fn as g
from collections import abc
@deco
def fn{p}():
    return 1
class _H{p}:
    pass
async def co{p}(): pass
"""
GO = """package m
import (
  "fmt"
  x "example.com/app/d{z}"
)
func Fn{p}() {{
}}
func (r *t{p}) run{p}() {{ }}
type t{p} struct {{
  a int
}}
type Z{p} interface{{}}
const c{p} = 2
"""
RB = """require 'json'
require_relative '../d{z}/m{q}'
# require 'no'
class K{p}
  def a; end
end
def fn{p}
end
"""
RS = """use crate::{{m{q}, nope::{{a, b}}}};
use std::io;
extern crate serde;
mod m{q};
// use no::no;
"""
C = """#include <stdio.h>
#include "../d{z}/m{q}.c"
// #include "no.h"
"""
JAVA = """import a.b.C{p};
import a.b.C{p};
"""
LANGUAGES = ((".ts", TS), (".js", TS), (".py", PY), (".go", GO), (".rb", RB), (".rs", RS), (".c", C), (".java", JAVA))
#: Rust modules are looked for beside their file, so those files share one directory.
PARTS = (
    "parts",
    """SELECT *, CASE k WHEN 5 THEN 'rs' ELSE 'd' || CAST(z AS VARCHAR) END || '/m' || CAST(p AS VARCHAR) || ext AS path, CASE k WHEN 5 THEN 'rs' ELSE 'd' || CAST(qz AS VARCHAR) END || '/m' || CAST(q AS VARCHAR) || ext AS target FROM (
  SELECT a.p_partkey AS p, a.p_partkey % 8 AS k, a.p_size AS z, a.p_partkey + 8 AS q, b.p_size AS qz, b.p_partkey IS NOT NULL AS there, CASE a.p_partkey % 8 """
    + " ".join(f"WHEN {i} THEN '{ext}'" for i, (ext, _) in enumerate(LANGUAGES))
    + " END AS ext FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 8)",
)


def sources(t) -> DataFrame:
    """(repo, path, content) of the program text."""
    part = t.table("part").select(F.col("p_partkey").alias("p"), F.col("p_size").alias("z"))
    rows = part.join(part.select((F.col("p") - 8).alias("p"), F.col("z").alias("qz")), "p", "left")
    text = ext = None
    for i, (e, body) in enumerate(LANGUAGES):
        pieces = []
        for piece in body.replace("{{", "\0").replace("}}", "\1").split("{"):
            name, brace, rest = piece.partition("}")
            if brace and name in ("p", "q", "z"):
                pieces += [{"p": F.col("p"), "q": F.col("p") + 8, "z": F.coalesce("qz", F.lit(0))}[name].cast("string"), F.lit(rest)]
            else:
                pieces.append(F.lit(piece))
        pieces = [F.translate(x, "\0\1", "{}") for x in pieces]
        hit = F.col("p") % 8 == i
        text, ext = (F.when(hit, v) if now is None else now.when(hit, v) for now, v in ((text, F.concat(*pieces)), (ext, F.lit(e))))
    folder = F.when(F.col("p") % 8 == 5, "rs").otherwise(F.concat(F.lit("d"), F.col("z").cast("string")))
    return rows.select(F.lit("r").alias("repo"), F.concat(folder, F.lit("/m"), F.col("p").cast("string"), ext).alias("path"), text.alias("content"))


def indexed(t) -> dict[str, DataFrame]:
    return parse.index(settled(sources(t)), [("~/*", "*")], {"r": "example.com/app"})


def _edges(k: str, kind: str, package: str | None, weight: int, line: str, names: str = "", confidence: float = 1.0) -> str:
    where = f"k IN ({k})" + ("" if package is not None else " AND there")
    target = "NULL" if package is not None else "target"
    return f"SELECT path AS source, {target} AS target, {package or 'NULL'} AS package, '{kind}' AS edge_type, {weight} AS weight, {confidence}::DOUBLE AS confidence, {line} AS line, {names or 'NULL'} AS names FROM parts WHERE {where}"


@query(
    "SELECT source, target, package, edge_type, CAST(weight AS BIGINT) AS weight, confidence, CAST(line AS INT) AS line, names FROM ("
    + " UNION ALL ".join(
        [
            _edges("0, 1", "imports", None, 2, "1", "'fn' || CAST(q AS VARCHAR) || ',helper'"),
            _edges("0, 1", "imports", "'react-dom'", 1, "2", "'default'"),
            _edges("0, 1", "inherits", None, 1, "NULL"),
            _edges("0, 1", "re_exports", None, 1, "NULL"),
            _edges("0, 1", "imports", "'@s/k' || CAST(p AS VARCHAR)", 1, "NULL"),
            _edges("0, 1", "imports", "'after-regex'", 1, "15", "'default'"),
            _edges("2", "imports", "'os'", 1, "1"),
            _edges("2", "imports", "'collections'", 1, "3", "'abc'"),
            _edges("2", "imports", None, 1, "2", "'fn'"),
            _edges("3", "imports", "'fmt'", 1, "3", confidence=0.8),
            "SELECT path, 'd' || CAST(coalesce(qz, 0) AS VARCHAR), NULL, 'imports', 1, 0.8::DOUBLE, 4, NULL FROM parts WHERE k = 3",
            _edges("4", "imports", "'json'", 1, "1", confidence=0.8),
            _edges("4", "imports", None, 1, "2", confidence=0.8),
            _edges("5", "imports", "'std'", 1, "2"),
            _edges("5", "imports", "'serde'", 1, "3"),
            _edges("5", "imports", None, 2, "1"),
            _edges("6", "imports", "'stdio.h'", 1, "1"),
            _edges("6", "imports", None, 1, "2"),
            _edges("7", "imports", "'a.b.C' || CAST(p AS VARCHAR)", 2, "1", confidence=0.8),
        ]
    )
    + ")",
    PARTS,
)
def index_edges(t):
    return parse.collapsed(indexed(t)["edges"]).select("source", "target", "package", "edge_type", "weight", "confidence", "line", F.array_join("names", ",").alias("names"))


def _symbols(k: str, rows: list[tuple[str, str, int, int, bool]]) -> list[str]:
    return [f"SELECT path, '{n}' || CAST(p AS VARCHAR) AS name, '{kind}' AS kind, CAST({a} AS INT) AS start_line, CAST({b} AS INT) AS end_line, {str(e).upper()} AS is_export FROM parts WHERE k IN ({k})" for n, kind, a, b, e in rows]


SYMBOLS = " UNION ALL ".join(
    _symbols("0, 1", [("s", "const", 4, 4, False), ("fn", "function", 5, 5, True), ("C", "class", 6, 6, True), ("local", "function", 7, 7, False), ("T", "type", 8, 8, True), ("lazy", "const", 10, 10, False), ("ar", "function", 11, 11, True), ("I", "interface", 12, 12, False), ("E", "enum", 13, 13, False), ("re", "const", 15, 15, False)])
    + _symbols("2", [("fn", "function", 4, 6, True), ("_H", "class", 7, 8, False), ("co", "function", 9, 9, True)])
    + _symbols("3", [("Fn", "function", 6, 7, True), ("run", "function", 8, 8, False), ("t", "struct", 9, 11, False), ("Z", "interface", 12, 12, True), ("c", "const", 13, 13, False)])
    + _symbols("4", [("K", "class", 4, 6, True), ("fn", "function", 7, 8, True)])
)


@query(SYMBOLS, PARTS)
def index_symbols(t):
    return indexed(t)["symbols"].select("path", "name", "kind", "start_line", "end_line", "is_export")


@query(
    """SELECT path, 'fn' || CAST(p AS VARCHAR) AS caller, 'fn' || CAST(q AS VARCHAR) AS callee, target AS callee_path, CAST(5 AS INT) AS call_line, 0.8::DOUBLE AS confidence FROM parts WHERE k IN (0, 1) AND there
  UNION ALL SELECT path, 'C' || CAST(p AS VARCHAR), 'local' || CAST(p AS VARCHAR), path, 6, 1.0 FROM parts WHERE k IN (0, 1)
  UNION ALL SELECT path, 'ar' || CAST(p AS VARCHAR), 'local' || CAST(p AS VARCHAR), path, 11, 1.0 FROM parts WHERE k IN (0, 1)""",
    PARTS,
)
def index_calls(t):
    made = indexed(t)
    s = made["symbols"].select("id", "path", "name")
    end = lambda prefix, path: s.select(F.col("id").alias(f"{prefix}_symbol_id"), F.col("name").alias(prefix), F.col("path").alias(path))
    return made["calls"].join(end("caller", "path"), "caller_symbol_id").join(end("callee", "callee_path"), "callee_symbol_id").select("path", "caller", "callee", "callee_path", "call_line", "confidence")


@query(
    "SELECT path, name, kind, signature FROM (" + " UNION ALL ".join(f"SELECT path, '{n}' || CAST(p AS VARCHAR) AS name, '{kind}' AS kind, {sig} AS signature FROM parts WHERE k IN (0, 1)" for n, kind, sig in (
        ("fn", "function", "'export function fn' || CAST(p AS VARCHAR) || '(a: number)'"), ("C", "class", "'export class C' || CAST(p AS VARCHAR) || ' extends fn' || CAST(q AS VARCHAR)"),
        ("T", "type", "'export type T' || CAST(p AS VARCHAR) || ' ='"), ("ar", "function", "'export const ar' || CAST(p AS VARCHAR) || ' = () => local' || CAST(p AS VARCHAR) || '()'"))) + ")",
    PARTS,
)
def index_exports(t):
    """Through the stored form: snapshots as JSON, read again."""
    made = indexed(t)
    snaps = parse.snapshots(made["exports"], made["edges"], 0).select("path", jobs.snapshot_of(F.col("exports_snapshot")).alias("s"))
    return snaps.select("path", F.inline("s.exports"))


@query("SELECT path FROM fx_files WHERE regexp_matches(lower(path), '^(.*/)?src/.*\\.ts$') OR regexp_matches(lower(path), '^(.*/)?d1./[^/]*/index\\.[^/]*$') OR regexp_matches(lower(path), '^(.*/)?readme\\.md$')")
def glob_match(t):
    hit = F.lit(False)
    for glob in ("src/**.ts", "**/d1?/*/index.*", "ReadMe.md"):
        hit = hit | F.col("path").rlike(paths.glob_pattern(glob))
    return t.files.filter(hit).select("path")


@query("SELECT path FROM fx_files WHERE CASE WHEN path LIKE 'lib/d1%' THEN true WHEN path LIKE 'tests/%' OR path LIKE '%/tests/%' THEN true WHEN path LIKE '%/README.md' THEN false WHEN path LIKE '%.md' THEN true ELSE false END")
def ignore_rules(t):
    return t.files.filter(paths.ignored(F.col("path"), ["# comment", "", "*.md", "!README.md", "tests/", "/lib/d1*"])).select("path")


@query("SELECT unnest(['a/**', '**/x.ts', '**/node_modules/**', '**/.git/**', '**/dist/**', '**/build/**', '**/coverage/**', '**/*.log', '**/*.min.js', '**/*.map']) AS pattern")
def exclude_union(t):
    config = scan.exclude_file(scan.with_excludes(scan.Config(exclude_patterns=["a/**"]), ["**/x.ts", *scan.DEFAULT_GLOBS, "a/**"]), "d/x.ts")
    return t.spark.createDataFrame([(p,) for p in config.exclude_patterns], "pattern string")


@query("SELECT CAST(event_id AS VARCHAR) AS timestamp, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS prefix, 'user ' || CAST(user_id AS VARCHAR) || ' [x]' AS message FROM events")
def log_parse(t):
    prefix = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), "event_type", F.lit("] "))).otherwise("")
    return scan.log_lines(t.table("events").select(F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("] "), prefix, F.lit("user "), F.col("user_id").cast("string"), F.lit(" [x]")).alias("value")))


@query("SELECT event_id, props AS answer FROM events")
def model_output(t):
    made = F.concat(F.lit("<think>a ```b``` "), F.col("event_type"), F.lit("</think>\n```json\n"), F.col("props"), F.lit("\n```\n"))
    return t.table("events").select("event_id", jobs.clean_output(made).alias("answer"))


@query("SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1fM', round(n / 1e6, 1)) WHEN n >= 1000 THEN printf('%.1fK', round(n / 1e3, 1)) ELSE CAST(n AS VARCHAR) END AS short FROM (SELECT o_orderkey, o_orderkey * o_orderkey AS n FROM orders)")
def short_numbers(t):
    return t.table("orders").select("o_orderkey", jobs.short_number(F.col("o_orderkey") * F.col("o_orderkey")).alias("short"))


@query("SELECT doc_id, 'Summarise the purpose of this file in two sentences.' || chr(10) || 'File: d/' || CAST(doc_id AS VARCHAR) || chr(10) || CASE WHEN length(text) > 65536 THEN substr(text, 1, 65536) || chr(10) || '... [truncated]' ELSE text END AS prompt FROM documents WHERE text IS NOT NULL")
def job_prompt(t):
    return t.table("documents").filter("text is not null").select("doc_id", jobs.prompt(F.lit("summary"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")), F.col("text")).alias("prompt"))


@query("SELECT file_id, 'C:/' || path AS canonical, path AS relative, '/base/' || path AS absolute FROM fx_files")
def path_forms(t):
    mangled = F.concat(F.lit("/C:\\\\"), F.regexp_replace("path", "/", "\\\\\\\\"), F.lit("/"))
    return t.files.select("file_id", paths.canonical(F.concat(F.lit('"'), mangled, F.lit('"')).substr(F.lit(2), F.length(mangled))).alias("canonical"), paths.relative(F.concat(F.lit("/base/"), "path"), "/base").alias("relative"), paths.absolute(F.col("path"), "/base/").alias("absolute"))


@query("SELECT file_id, CASE WHEN file_id % 2 = 0 THEN '@s/p' ELSE 'p' END || CAST(file_id % 7 AS VARCHAR) AS package, CASE WHEN file_id % 2 = 0 THEN '@s' END AS scope FROM fx_files")
def package_names(t):
    spec = F.concat(F.when(F.col("file_id") % 3 == 0, "/x/node_modules/y/node_modules/").otherwise(""), F.when(F.col("file_id") % 2 == 0, "@s/p").otherwise("p"), (F.col("file_id") % 7).cast("string"), F.when(F.col("file_id") % 5 == 0, "/lib/a.js").otherwise(""))
    return t.files.select("file_id", paths.package_of(spec).alias("package")).withColumn("scope", paths.scope_of(F.col("package")))


@query("SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS repo, n_name AS name, CASE WHEN n_nationkey % 3 <> 1 THEN CAST(n_nationkey AS VARCHAR) ELSE 'dev' END AS version, n_nationkey % 3 = 1 AS is_dev FROM nation")
def manifest_packages(t):
    n = t.table("nation").withColumn("repo", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    entry = lambda value: F.map_from_entries(F.collect_list(value))
    made = n.groupBy("repo").agg(entry(F.when(F.col("n_nationkey") % 3 != 1, F.struct("n_name", F.col("n_nationkey").cast("string")))).alias("dependencies"), entry(F.when(F.col("n_nationkey") % 3 != 2, F.struct("n_name", F.when(F.col("n_nationkey") % 3 == 1, "dev").otherwise("9")))).alias("devDependencies"))
    return scan.manifest_packages(made.select("repo", F.to_json(F.struct("dependencies", "devDependencies")).alias("content"))).select("repo", "name", "version", "is_dev")


@query("SELECT n_name AS key, CASE WHEN n_nationkey = 3 THEN 'new' ELSE CAST(n_nationkey AS VARCHAR) END AS value FROM nation UNION ALL SELECT 'gate', '1'")
def kv_state(t):
    kv = t.table("nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    return files.put(files.put(kv, kv.filter("value = '3'").first()[0], "new"), "gate", "1")


@query("SELECT id, file_id, name FROM fx_symbols WHERE file_id % 9 <> 2 UNION ALL SELECT id + 1000000, file_id, name || 'x' FROM fx_symbols WHERE file_id % 9 = 2 AND file_id % 2 = 0")
def replace_symbols(t):
    cols = t.symbols.select("id", "file_id", "name")
    new = cols.filter("file_id % 9 = 2 and file_id % 2 = 0").selectExpr("id + 1000000 as id", "file_id", "concat(name, 'x') as name")
    return replace_by_key(cols, new, "file_id", cols.filter("file_id % 9 = 2"))


@query(
    """SELECT wanted, path FROM (SELECT w.wanted, f.path, row_number() OVER (PARTITION BY w.wanted ORDER BY CASE WHEN path = w.wanted THEN 0 WHEN lower(path) = lower(w.wanted) THEN 1 WHEN ends_with(lower(path), '/' || lower(w.wanted)) THEN 2 ELSE 3 END, path) AS rn
  FROM fx_files f, (VALUES ('src/d1/none/readme.md'), ('P39/readme.MD'), ('index.ts')) w(wanted) WHERE lower(path) = lower(w.wanted) OR ends_with(lower(path), '/' || lower(w.wanted)) OR regexp_extract(lower(path), '[^/]+$') = regexp_extract(lower(w.wanted), '[^/]+$')) WHERE rn = 1"""
)
def suffix_match(t):
    wanted = ("src/d1/none/readme.md", "P39/readme.MD", "index.ts")
    found = [files.match_suffix(t.files.select("path"), w).select(F.lit(w).alias("wanted"), "path") for w in wanted]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT n, name, path FROM (SELECT s.name, path, row_number() OVER (ORDER BY is_export DESC, path, start_line, s.id) AS rn FROM fx_symbols s JOIN fx_files USING (file_id) WHERE s.name = 'fn3') r, (VALUES (0, 1), (2, 2), (NULL, 50), (9999, 500)) v(n, most) WHERE rn <= most")
def clamped_limits(t):
    parts = [symbols.find(t.symbols, t.files, "fn3", n=n).select(F.lit(n).cast("int").alias("n"), "name", "path") for n in (0, 2, None, 9999)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT path, mtime FROM fx_files WHERE mtime > 1704070800000 ORDER BY mtime DESC, path")
def since_time(t):
    kind, value = scan.parse_since("2024-01-01T02:00:00+01:00")
    assert kind == "time"
    return files.changed_since(t.files, value).select("path", "mtime")


COMM = ("lab", "SELECT file_id, arg_min(community_id, id) AS community_id FROM fx_communities GROUP BY file_id")


@query("SELECT community_id, count(*) AS size, arg_max(path, (importance, path)) AS representative, string_agg(path, ',' ORDER BY path) AS members FROM lab JOIN f USING (file_id) GROUP BY community_id", COMM, *RATED)
def community_report(t):
    labels = t["fx_communities"].groupBy("file_id").agg(F.min(F.struct("id", "community_id")).alias("c")).select("file_id", F.col("c.community_id").alias("community_id"))
    return graph.community_report(labels, t.rated)


@query("SELECT community_id, CAST((dense_rank() OVER (ORDER BY community_id) - 1) % 8 AS INT) AS colour FROM (SELECT DISTINCT file_id * 3 AS community_id FROM lab)", COMM)
def community_colours(t):
    return graph.palette(t["fx_communities"].select((F.col("file_id") * 3).alias("community_id")))


@query(
    """SELECT sum(CASE WHEN x.community_id = y.community_id THEN weight ELSE 0 END) / CAST(sum(weight) AS DOUBLE) - (SELECT sum(m * m) FROM (SELECT sum(w) AS m FROM (SELECT community_id, CAST(weight AS DOUBLE) AS w FROM und JOIN lab8 ON a = file_id UNION ALL SELECT community_id, weight FROM und JOIN lab8 ON b = file_id) GROUP BY community_id)) / (4 * CAST(sum(weight) AS DOUBLE) * sum(weight)) AS modularity
  FROM und JOIN lab8 x ON x.file_id = a JOIN lab8 y ON y.file_id = b""",
    ("und", "SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM fx_deps WHERE dependency_type = 'local_import' AND source_id <> target_id GROUP BY ALL"),
    ("lab8", "SELECT file_id, file_id - file_id % 128 AS community_id FROM fx_files"),
)
def partition_modularity(t):
    from ..operators import deps

    labels = t.files.select("file_id", (F.col("file_id") - F.col("file_id") % 128).alias("community_id"))
    return graph.modularity(deps.undirected(t.deps), labels)


@query("SELECT 10 AS n, true AS known")
def freshness_sample(t):
    """How many files the sample has, and whether all of them are files of the table."""
    some = files.sample(t.files, 10).select("path")
    return some.join(t.files.select("path", F.lit(True).alias("there")), "path", "left").agg(F.count("*").cast("int").alias("n"), F.min(F.coalesce("there", F.lit(False))).alias("known"))


@query("SELECT DISTINCT '/s/r' || CAST(s_nationkey AS VARCHAR) AS root, 'r' || CAST(s_nationkey AS VARCHAR) AS repo FROM supplier WHERE s_nationkey NOT IN (1, 2)")
def discovered_repositories(t):
    roots = [f"/s/r{r[0]}" + "/" * (i % 2) for i, r in enumerate(t.table("supplier").select("s_nationkey").collect())]
    return scan.repositories(t.spark, roots, ["/s/r1", "/s/r2/"])


@query("SELECT '/' || r_name AS path, r_name AS name, true AS is_directory, CAST(NULL AS BIGINT) AS importance FROM region UNION ALL SELECT '/' || r_name || '/' || n_name, n_name, false, CAST(n_nationkey % 10 AS BIGINT) FROM nation JOIN region ON n_regionkey = r_regionkey")
def legacy_import(t):
    leaf = F.struct(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 10).alias("importance"))
    both = t.table("nation").join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    trees = both.groupBy("r_name").agg(F.collect_list(leaf).alias("children"))
    root = F.struct(F.struct(F.concat(F.lit("/"), "r_name").alias("path"), F.col("r_name").alias("name"), F.lit(True).alias("isDirectory"), "children").alias("fileTree"))
    return scan.legacy_rows(trees.select(F.to_json(root).alias("value"))).select("path", "name", "is_directory", "importance")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 5 <> 0 AND json_extract(props, '$.k') IS NOT NULL")
def malformed_messages(t):
    """Line-delimited JSON through the reader of messages: broken lines are dropped."""
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{oops "), "props")).otherwise(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "p": '), "props", F.lit("}")))
    return scan.messages(t.table("events").select(line.alias("value")), "event_id long, p struct<k:long>").select("event_id", "p.k").filter("k is not null")


@query("SELECT lower(regexp_extract(path, '[^/]+$')) AS name, path FROM fx_files WHERE path = 'src/d' || regexp_extract(path, 'd([0-9]+)', 1) || '/' || split_part(path, '/', 3) || '/' || split_part(path, '/', 4)")
def find_by_path(t):
    """Flattened tree, found by path ignoring case."""
    tree = files.tree(t.files).filter("not is_directory and lower(path) like 'src/%'")
    return tree.select(F.lower("name").alias("name"), "path")


@query("SELECT path, event_type, event_id FROM (SELECT path, event_type, event_id, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS rn FROM fx_changes) WHERE rn = 1 AND event_type <> 'unlink'")
def live_files(t):
    from ..operators import changes

    return changes.last_events(t["fx_changes"]).filter("event_type != 'unlink'").select("path", "event_type", "event_id")


@query(
    """SELECT id, CASE WHEN (us, id) > (SELECT max((us, id)) FROM (SELECT min((us, id)) AS f, max(us) AS m, min(us) AS us, arg_min(id, (us, id)) AS id FROM q WHERE id >= 100 AND NOT EXISTS (SELECT 1 FROM q o WHERE o.id < 100 AND o.user_id = q.user_id AND o.event_type = q.event_type) GROUP BY user_id, event_type ORDER BY f LIMIT 20)) THEN 'queue_full' END AS reject FROM q WHERE id >= 100""",
    ("q", "SELECT event_id AS id, epoch_us(ts) AS us, user_id, event_type FROM events"),
)
def job_admission(t):
    ev = t.table("events").select(F.col("event_id").alias("id"), F.lit("r").alias("repo"), F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("job_type"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"))
    pending = ev.filter("id < 100")
    room = pending.select("path", "job_type").distinct().count() + 20
    return jobs.admitted(pending, ev.filter("id >= 100"), room).select("id", "reject")
