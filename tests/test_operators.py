import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamgraph.functions import languages, paths, score
from loamgraph.operators import changes, files, graph, jobs
from loamgraph.plans import source_queries  # noqa: F401
from loamgraph.plans.queries import ORACLE, QUERIES
from loamgraph.sources import scan
from loamgraph.streaming import jobs as streams

SF = "/root/testdata/sf0.001"


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in names) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def duck():
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in got.fetchall()), key=str)
    assert rows(df) == want


def reference_components(edges):
    reach = {}
    nodes = {v for e in edges for v in e}
    for s in nodes:
        seen, todo = set(), [s]
        while todo:
            for a, b in edges:
                if a == todo[0] and b not in seen:
                    seen.add(b)
                    todo.append(b)
            todo.pop(0)
        reach[s] = seen
    return {v: min([u for u in nodes if u in reach[v] and v in reach[u]] + [v]) for v in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_tarjan(seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(14), rng.randrange(14)) for _ in range(20)]
    assert graph.tarjan(edges) == reference_components(edges)


def test_ring_of_1000():
    assert set(graph.tarjan([(i, (i + 1) % 1000) for i in range(1000)]).values()) == {0}


def test_long_ring_in_linear_time():
    import time

    n, t = 200_000, time.time()
    assert set(graph.tarjan([(i, (i + 1) % n) for i in range(n)]).values()) == {0}
    assert len(set(graph.tarjan([(i, i + 1) for i in range(n)]).values())) == n + 1
    assert time.time() - t < 10


def test_components_without_the_driver(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (7, 7), (8, 1)]
    df = spark.createDataFrame(edges, "source_id long, target_id long")
    want = [(1, 1), (1, 2), (1, 3), (4, 4), (4, 5), (7, 7)]
    assert rows(graph.cycles(df, driver_edges=0)) == want
    assert rows(graph.cycles(df)) == want


def test_cascade_stops_at_depth(spark):
    df = spark.createDataFrame([(i + 1, i) for i in range(15)], "source_id long, target_id long")
    assert dict(rows(graph.cascade(df, [0]).select(F.col("file_id").alias("b"), F.col("depth").alias("a")).select(F.col("b").alias("a"), F.col("a").alias("b")))) == {i: i for i in range(11)}


def labels_of(spark, pairs, **options):
    df = spark.createDataFrame(pairs, "repo string, a long, b long, weight double")
    return {(r["repo"], r["file_id"]): r["community_id"] for r in graph.communities(df, **options).collect()}


def test_communities_of_two_clusters(spark):
    pairs = [("r", a, b, 1.0) for g in ((1, 2, 3, 4), (5, 6, 7, 8)) for i, a in enumerate(g) for b in g[i + 1 :]] + [("r", 4, 5, 1.0)]
    want = {("r", v): 1 if v < 5 else 5 for v in range(1, 9)}
    assert labels_of(spark, pairs) == labels_of(spark, pairs[::-1]) == want


def test_communities_are_the_same_at_every_size(spark):
    """In one group or as joins over the cluster: many clusters, weights, a hub, ids that are negative, a node of its own, a repository without weights."""
    rng = random.Random(3)
    pairs = [("r", v, v - v % 12 + rng.randrange(12) if rng.random() < 0.7 else rng.randrange(120), rng.choice([0.25, 1.0, 2.5, 0.1])) for v in range(120) for _ in range(3)]
    pairs += [("r", -(2**63), v, 1.0) for v in range(0, 120, 9)] + [("r", 500, 500, 1.0)] + [("s", 1, 2, 0.0), ("s", 2, 3, None), ("t", 1, 2, 1.0)]
    got = labels_of(spark, pairs)
    assert got == labels_of(spark, pairs, largest=0)
    assert len({c for (repo, _), c in got.items() if repo == "r"}) > 5
    assert [got["s", v] for v in (1, 2, 3)] == [1, 2, 3] and got["t", 2] == 1 and got["r", 500] == 500
    assert all(min(v for (q, v), d in got.items() if (q, d) == (repo, c)) == c for (repo, _), c in got.items())


@pytest.mark.parametrize("driver_nodes", [0, 40, 10**6])
def test_communities_are_the_same_packed(spark, monkeypatch, driver_nodes):
    """Joined throughout, packed from a later level on, packed from the first: rows of few edges, pairs that repeat, pairs with themselves, equal gains."""
    monkeypatch.setattr(graph, "PACK", 16)
    rng = random.Random(5)
    pairs = [("r", v, v - v % 10 + rng.randrange(10) if rng.random() < 0.8 else rng.randrange(150), rng.choice([1.0, 1.0, 0.3])) for v in range(150) for _ in range(3)]
    pairs += [("r", -(2**63), v, 1.0) for v in range(0, 150, 11)] + [("r", 900, 900, 2.0), ("r", 2**63 - 1, 901, 0.0)] + pairs[:40]
    assert labels_of(spark, pairs) == labels_of(spark, pairs, largest=0, driver_nodes=driver_nodes)


def test_rounds_of_packed_communities_join_nothing(spark, monkeypatch):
    """A level costs one stored table however many rounds it takes; with joins it was three a round."""
    stored = []
    monkeypatch.setattr(graph, "settled", lambda df, settled=graph.settled: stored.append(1) or settled(df))
    rounds = []
    monkeypatch.setattr(graph, "_modularity", lambda *a, found=graph._modularity: rounds.append(1) or found(*a))
    rng = random.Random(2)
    labels_of(spark, [("r", v, rng.randrange(200), 1.0) for v in range(200) for _ in range(4)], largest=0)
    assert len(stored) < 12 < len(rounds)


def partitions(nodes):
    if not nodes:
        yield []
        return
    for rest in partitions(nodes[1:]):
        yield [[nodes[0]], *rest]
        for i, part in enumerate(rest):
            yield [*rest[:i], [nodes[0], *part], *rest[i + 1 :]]


@pytest.mark.parametrize("seed", range(5))
def test_communities_near_the_best_partition(seed):
    rng = random.Random(seed)
    edges = {(a, b) for a in range(8) for b in range(a + 1, 8) if rng.random() < (0.8 if a // 4 == b // 4 else 0.2)}

    def modularity(parts):
        of = {v: i for i, p in enumerate(parts) for v in p}
        degree = [sum(of[a] == i for e in edges for a in e) for i in range(len(parts))]
        return sum(of[a] == of[b] for a, b in edges) / len(edges) - sum(d * d for d in degree) / (4 * len(edges) ** 2)

    own = pd.DataFrame(sorted(edges), columns=["a", "b"]).assign(w=graph.UNIT)
    hashes = [rng.getrandbits(63) for _ in range(8)]
    got = graph.louvain(own.assign(ha=own["a"].map(hashes.__getitem__), hb=own["b"].map(hashes.__getitem__)))
    found = modularity([list(g) for _, g in got.groupby("community_id")["file_id"]])
    best = max(modularity(p) for p in partitions(sorted({v for e in edges for v in e})))
    assert best - 0.05 <= found <= best + 1e-9


def test_paths(spark):
    df = spark.createDataFrame([("/C:\\a\\\\b\\",), ('"x//y/"',), ("a/./b/../c",), ("../up/x",), (None,)], "p string")
    assert [r[0] for r in df.select(paths.canonical(F.col("p"))).collect()] == ["C:/a/b", "x/y", "a/./b/../c", "../up/x", None]
    assert [r[0] for r in df.select(paths.resolved(F.col("p"))).collect()][2:] == ["a/c", "../up/x", None]
    df = spark.createDataFrame([("node_modules/@s/p/x.js",), ("@s/p/y",), ("lodash/fp",)], "p string")
    assert [r[0] for r in df.select(paths.package_of(F.col("p"))).collect()] == ["@s/p", "@s/p", "lodash"]


def test_globs_and_ignore_rules(spark):
    df = spark.createDataFrame([("src/a.ts",), ("dist/x.js",), ("a/.git/config",), ("node_modules/y.js",), ("src/keep.log",), ("src/drop.log",), (".github/w.yml",)], "p string")
    got = [r[0] for r in df.filter(~paths.excluded(F.col("p"), ("dist/**",))).collect()]
    assert got == ["src/a.ts", "src/keep.log", "src/drop.log"]
    got = [r[0] for r in df.filter(~paths.ignored(F.col("p"), ["*.log", "!keep.log", "dist/", "/node_modules"])).collect()]
    assert got == ["src/a.ts", "a/.git/config", "src/keep.log", ".github/w.yml"]


def test_tokens():
    assert score.query_tokens('a "Foo  Bar" foo% an_d foo "x"') == ["foo  bar", "x", "foo", "and"]


def test_log_and_output(spark):
    df = spark.createDataFrame([("[2024-01-01] [Broker] up and running",), ("[t] plain",)], "l string")
    assert [tuple(r[0]) for r in df.select(jobs.parse_log(F.col("l"))).collect()] == [("2024-01-01", "Broker", "up and running"), ("t", "", "plain")]
    df = spark.createDataFrame([("<think>no\n</think>\n```json\n{}\n```",)], "t string")
    assert df.select(jobs.clean_output(F.col("t"))).first()[0] == "{}"


def test_strict_since_and_null_mtime(spark):
    df = spark.createDataFrame([("a", False, 5), ("b", False, 6), ("c", False, None), ("d", True, 9), ("e", False, 6)], "path string, is_directory boolean, mtime long")
    assert [r["path"] for r in files.changed_since(df, 5).collect()] == ["b", "e"]


def test_unknown_job_type_raises(spark):
    f = spark.createDataFrame([(1, None, None, None, 1, 2, 3)], "file_id long, summary string, concepts string, change_impact string, summary_stale_since long, concepts_stale_since long, change_impact_stale_since long")
    r = spark.createDataFrame([(1, "summary", "s", 1), (1, "summary", "t", 2)], "file_id long, job_type string, value string, created_at long")
    got = files.apply_results(f, r).first()
    assert got["summary"] == "t" and got["summary_stale_since"] is None and got["concepts_stale_since"] == 2
    with pytest.raises(Exception, match="unknown job type"):
        files.apply_results(f, r.withColumn("job_type", F.lit("nope"))).collect()


def test_debounce_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rng = random.Random(1)
    at, events = start, []
    for i in range(60):
        at += timedelta(seconds=rng.choice([0.5, 1, 3, 7]))
        events.append((i, at, f"f{rng.randrange(3)}", rng.choice(["add", "change"])))
    df = spark.createDataFrame(events, "event_id long, ts timestamp, path string, event_type string")
    batch = rows(changes.debounced(df).select("path", "event_type", "events", "last_event_id"))
    sentinel = [(999, at + timedelta(days=1), "~", "change")]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (events[:30], events[30:], sentinel):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").json(src)
    stream = streams.debounced(scan.change_stream(spark, src), late="10 seconds")
    streams.each_batch(stream, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/b={n}"), str(tmp_path / "ck")).awaitTermination()
    got = rows(spark.read.parquet(out).select("path", "event_type", "events", "last_event_id"))
    assert got == batch


def test_snapshot_stream_keeps_state(spark, tmp_path):
    src, out = str(tmp_path / "in"), []
    for i, digest in enumerate(["x", "x", "y"]):
        spark.createDataFrame([("p", i, digest)], "path string, ts long, digest string").coalesce(1).write.mode("append").parquet(src)
    raw = spark.readStream.schema("path string, ts long, digest string").option("maxFilesPerTrigger", 1).parquet(src)
    streams.each_batch(streams.snapshots(raw), lambda b, n: out.extend(r["changed"] for r in b.collect()), str(tmp_path / "ck")).awaitTermination()
    assert sorted(out) == ["body-only", "changed", "unknown"]


def test_sources(spark, tmp_path):
    (tmp_path / "tree.json").write_text('{"fileTree": {"path": "/r", "name": "r", "isDirectory": true, "children": [{"path": "/r/a", "name": "a", "importance": 3}]}}')
    assert sorted(r["path"] for r in scan.legacy_tree(spark, str(tmp_path / "tree.json")).collect()) == ["/r", "/r/a"]
    assert scan.token_file(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "t.json").write_text('{"r": 5}')
    assert rows(scan.token_file(spark, str(tmp_path / "t.json"))) == [("r", 5)]
    m = spark.createDataFrame([("r", '{"dependencies": {"a": "1", "@s/b": "2"}, "devDependencies": {"a": "9"}}')], "repo string, content string")
    assert sorted(tuple(r) for r in scan.manifest_packages(m).collect()) == [("r", "@s/b", "2", False, "@s"), ("r", "a", "1", False, None)]
    assert scan.path_aliases('{ // c\n "compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["./lib/*", "x"],}, } }') == [("@/*", "src/lib/*")]
    assert scan.parse_since("deadbee") == ("commit", "deadbee") and scan.parse_since("1970-01-01T00:00:01Z") == ("time", 1000)
    lines = spark.createDataFrame([('{"k": 1}',), ("oops",)], "value string")
    assert rows(scan.messages(lines, "k long")) == [(1,)]


@pytest.mark.parametrize(
    ("path", "text", "edges", "symbols"),
    [
        ("a.go", 'package m\nimport (\n  "fmt"\n  x "g.com/a"\n)\nfunc (r *T) Run() {\n}\ntype I interface{}\nconst (\n D = 2\n)\n', ["fmt", "g.com/a"], [("Run", "function", 6, 7), ("I", "interface", 8, 8), ("D", "const", 10, 10)]),
        ("a.rb", "require 'json'\nrequire_relative 'x/y'\n# require 'no'\nclass Foo::Bar\n  def a; end\nend\nX = 1\n", ["json", "./x/y"], [("Foo::Bar", "class", 4, 6), ("X", "const", 7, 7)]),
        ("a.rs", "use crate::a::b;\nuse std::io;\nmod m;\n// use no::no;\n", ["./a/b", "std", "./m"], []),
        ("a.rs", "pub use crate::{a, b::{self, c as d}, e::*};\nuse x::{y, z};\n", ["./a", "./b", "./b/c", "./e", "x"], []),
        ("a.ts", "const q = /[\"']/; const r = require('x');\nimport y from 'z';\nconst d = 4 / 2; const e = d / 3;\nfunction f() { return /\\/'/.test('a'); }\n", ["x", "z"], [("q", "const", 1, 1), ("r", "const", 1, 1), ("d", "const", 3, 3), ("e", "const", 3, 3), ("f", "function", 4, 4)]),
        ("a.c", '#include <s.h>\n#include "x.h"\n// #include "no.h"\n', ["s.h", "./x.h"], []),
        ("a.py", "import os\nfrom .x import y\n@d\ndef f():\n  pass\n", ["os", ".x"], [("f", "function", 3, 5)]),
        ("a.lua", "local x = require('m.n')", ["m.n"], []),
        ("a.PHP", "use A\\B;", ["A\\B"], []),
        ("a.ts", '// import "no"\nconst s = `import "no"`;\nexport class A { m() { f(); } }\n', [], [("s", "const", 2, 2), ("A", "class", 3, 3)]),
        ("a.py", "def (", [], []),
        ("a.bin", "\0\0", [], []),
        ("a.ts", "", [], []),
    ],
)
def test_parsers(path, text, edges, symbols):
    p = languages.parse(path, text)
    assert [e[0] for e in p.edges] == edges
    assert [s[:4] for s in p.symbols] == symbols


def test_registered_parser(spark):
    from loamgraph.operators import parse

    languages.register(".Mine", lambda text: languages.Parsed(symbols=[(text.strip(), "function", 1, 1, True)]))
    df = spark.createDataFrame([("r", "a.mine", "hello")], "repo string, path string, content string")
    assert [s["name"] for s in parse.parsed(df).first()["symbols"]] == ["hello"]
    del languages.PARSERS[".mine"]


def test_discovery(spark, tmp_path):
    for d in ("a/.loamgraph", "a/b/.loamgraph", "c/d/.loamgraph", "c/d/e/.loamgraph", "f"):
        (tmp_path / d).mkdir(parents=True)
    got = {r["root"] for r in scan.discover(spark, [str(tmp_path)], blacklist=[str(tmp_path / "a/b")]).collect()}
    assert got == {str(tmp_path / "a"), str(tmp_path / "c/d")}


def test_long_file():
    p = languages.parse("a.ts", "export function f() { g(); }\n" * 10_000)
    assert len(p.symbols) == 10_000 and len(p.calls) == 10_000


def test_model_answers_and_failures(spark):
    df = spark.createDataFrame([(1, "r", "a", "summary", "x", 5), (2, "r", "b", "concepts", "boom", 6)], "id long, repo string, path string, job_type string, payload string, created_at long")

    def model(kind, text):
        if text == "boom":
            raise RuntimeError("no")
        return f"{kind}:{text}"

    got = {r["id"]: (r["value"], r["error"]) for r in jobs.answer(df, model).collect()}
    assert got == {1: ("summary:x", None), 2: (None, "RuntimeError: no")}
    slow = jobs.answer(df, lambda kind, text: __import__("time").sleep(20) if text == "boom" else kind, timeout=1.0).collect()
    assert {r["id"]: r["error"] for r in slow} == {1: None, 2: "TimeoutError: no answer in 1.0 s"}
    text = df.select(jobs.prompt(F.col("job_type"), F.col("path"), F.col("payload"), 2)).collect()[1][0]
    assert text.endswith("File: b\nbo\n... [truncated]")
    bad = spark.createDataFrame([("{",), ('{"exports": [{"name": "a"}]}',)], "t string").select(jobs.snapshot_of(F.col("t")).alias("s")).collect()
    assert bad[1]["s"]["exports"][0]["name"] == "a" and (bad[0]["s"] is None or bad[0]["s"]["exports"] is None)


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("[t1] [P] one\n[t2] two\n")
    out = []
    streams.each_batch(scan.log_stream(spark, str(tmp_path / "in")), lambda b, n: out.extend(tuple(r) for r in b.collect()), str(tmp_path / "ck")).awaitTermination()
    assert sorted(out) == [("t1", "P", "one"), ("t2", "", "two")]


def test_job_stream_keeps_the_newest(spark, tmp_path):
    for batch in ([("r", "a", "summary", 9, 1, 5)], [("r", "a", "summary", 3, 2, 5), ("r", "b", "summary", 1, 3, 5)]):
        spark.createDataFrame(batch, "repo string, path string, job_type string, created_at long, id long, importance int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema("repo string, path string, job_type string, created_at long, id long, importance int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    streams.each_batch(streams.latest_jobs(raw), lambda b, n: got.update({r["path"]: r["id"] for r in b.collect()}), str(tmp_path / "ck"), "update").awaitTermination()
    assert got == {"a": 1, "b": 3}
