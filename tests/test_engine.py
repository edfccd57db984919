"""The index of a small tree through the engine's tools."""

import os

import pytest

from loamgraph.api import Engine, to_envelope

TREE = {
    "src/a.ts": "import { helper } from './b';\nexport function main() { helper(1); local(); missing(); }\nfunction local() { return local(); }\n",
    "src/b.ts": "import './c';\nexport function helper(n: number) { return n; }\n",
    "src/c.js": "import { main } from './a';\nimport x from 'react-dom/server';\nexport const run = () => main();\n",
    "src/index.ts": "export * from './a';\n",
    "tests/t.py": "import os\nfrom . import u\nfrom .u import thing\n\ndef test_a():\n    pass\n",
    "tests/u.py": "thing = 1\n\nclass Thing:\n    pass\n",
    "node_modules/x/index.js": "module.exports = 1;\n",
    "package.json": "{}",
    "README.md": "# hi",
}


def grow(root, files):
    for p, t in files.items():
        os.makedirs(root / os.path.dirname(p), exist_ok=True)
        (root / p).write_text(t)


def tables(engine):
    """What the tables say, without what depends on when it was said."""
    pick = {"files": ("path", "importance", "summary"), "deps": ("source_id", "target_id", "package", "package_version", "is_dev", "edge_type", "weight", "imported_names"), "symbols": ("file_id", "name", "kind", "start_line", "is_export"), "calls": ("caller_symbol_id", "callee_symbol_id", "call_line", "confidence")}
    return {n: sorted(map(str, engine.table(n).select(*c).collect())) for n, c in pick.items()}


def test_changes_are_indexed_as_a_scan_would(spark, tmp_path, monkeypatch):
    """Add, change and remove by events; only touched files are parsed; the tables equal those of a new store."""
    root = tmp_path / "tree"
    grow(root, TREE | {"package.json": '{"dependencies": {"react-dom": "18"}, "devDependencies": {"vite": "5"}}', "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["./src/*"]}}}', "src/al.ts": "import { helper } from '@/b';\nimport v from 'vite';\n"})
    e = Engine(spark, str(tmp_path / "one"))
    e.set_base_directory(str(root), "r")
    versions = {r["package"]: (r["package_version"], r["is_dev"]) for r in e.table("deps").filter("package is not null").collect()}
    assert versions["react-dom"] == ("18", False) and versions["vite"] == ("5", True) and versions["os"] == (None, None)
    assert "src/al.ts" in paths(e.table("deps").join(e.table("files").filter("path = 'src/b.ts'").selectExpr("file_id as target_id"), "target_id").join(e.table("files").selectExpr("file_id as source_id", "path"), "source_id"))
    e.set_file_summary("src/a.ts", "kept")
    grow(root, {"src/b.ts": "export function helper(n: number) { return n; }\nexport function more() { return helper(1); }\n", "src/new.ts": "import { more } from './b';\nexport const x = () => more();\n"})
    os.utime(root / "src/b.ts", (2_000_000_000, 2_000_000_000))
    os.remove(root / "tests/u.py")
    seen = []
    from loamgraph.operators import parse
    real = parse.parsed
    monkeypatch.setattr(parse, "parsed", lambda f: (seen.extend(r[0] for r in f.select("path").collect()), real(f))[1])
    events = spark.createDataFrame([("src/b.ts", "change"), ("src/new.ts", "add"), ("tests/u.py", "unlink"), ("node_modules/x/index.js", "change")], "path string, event_type string")
    e.apply_events(str(root), "r", events)
    assert sorted(seen) == ["src/b.ts", "src/new.ts"]
    other = Engine(spark, str(tmp_path / "two"))
    other.set_base_directory(str(root), "r")
    other.set_file_summary("src/a.ts", "kept")
    assert tables(e) == tables(other)
    stale = {r["path"]: r["summary_stale_since"] is not None for r in e.table("files").collect()}
    # what imports b, or u which went, directly or not
    assert {p for p, s in stale.items() if s} == {"src/a.ts", "src/al.ts", "src/b.ts", "src/c.js", "src/index.ts", "tests/t.py"}
    del seen[:]
    e.set_base_directory(str(root), "r")
    assert seen == []
    snap = e.table("files").filter("path = 'src/new.ts'").first()["exports_snapshot"]
    assert '"name":"x"' in snap


def test_a_change_of_the_body_concerns_its_file_only(spark, tmp_path):
    root = tmp_path / "tree"
    grow(root, TREE)
    e = Engine(spark, str(tmp_path / "s"))
    e.set_base_directory(str(root), "r")
    grow(root, {"src/b.ts": "import './c';\nexport function helper(n: number) { return n + 1; }\n"})
    os.utime(root / "src/b.ts", (2_000_000_000, 2_000_000_000))
    row = e.get_file_summary("src/b.ts").first()
    assert row["newer_on_disk"] and row["imported_by"][0]["names"] == "helper"
    e.set_base_directory(str(root), "r")
    got = e.table("files").filter("summary_stale_since is not null or change_impact_stale_since is not null").collect()
    assert [r["path"] for r in got] == ["src/b.ts"] and got[0]["change_impact_stale_since"] is None


def test_store_survives_a_second_writer(spark, tmp_path):
    from loamgraph.store import Conflict, Store

    a, b = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    a.publish(t=spark.range(1))
    late = b._numbers()
    b._numbers = lambda: late
    a.publish(t=spark.range(2))
    with pytest.raises(Conflict):
        b.publish(t=spark.range(9))
    assert a.read("t").count() == 2 and a._numbers() == [1, 2]
    a.publish(u=spark.range(3))
    assert a.vacuum(1) == 1 and a.read("t").count() == 2 and a.read("u").count() == 3


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for p, t in TREE.items():
        os.makedirs(root / os.path.dirname(p), exist_ok=True)
        (root / p).write_text(t)
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    e.set_base_directory(str(root), "r")
    return e


def paths(df):
    return [r["path"] for r in df.collect()]


def test_scan_excludes_and_rates(engine):
    got = {r["path"]: r["importance"] for r in engine.rated().collect()}
    assert set(got) == {p for p in TREE if not p.startswith("node_modules")}
    # 3 for .ts, 2 for src, 2 for the name, 1 for one dependency
    assert got["src/index.ts"] == 8
    assert got["package.json"] == 3 and got["README.md"] == 2
    # 3 + 2 + two dependents + one dependency
    assert got["src/a.ts"] == 8


def test_cycles(engine):
    rows = engine.detect_cycles().collect()
    assert [r["members"] for r in rows] == [["src/a.ts", "src/b.ts", "src/c.js"]]
    assert engine.get_cycles_for_file("tests/t.py").count() == 0


def test_callers(engine):
    rows = engine.find_callers("helper").collect()
    assert [(r["path"], r["symbol"], r["total"], r["unresolved"]) for r in rows] == [("src/a.ts", "main", 1, 0)]
    # recursion is stored but isn't a caller
    rows = engine.find_callers("local").collect()
    assert [(r["symbol"]) for r in rows] == ["main"]
    rows = engine.find_callees("run").collect()
    assert [(r["symbol"], r["confidence"]) for r in rows] == [("main", 0.8)]
    rows = engine.find_callers("Thing").collect()
    assert len(rows) == 1 and rows[0]["path"] is None and rows[0]["warning"]


def test_symbols_prefix(engine):
    assert [(r["name"], r["total"]) for r in engine.find_symbol("T*").collect()] == [("Thing", 1)]
    assert engine.find_symbol("*").count() == 6


def test_summary_survives_rescan(engine, tmp_path):
    engine.set_file_summary("src/b.ts", "helps")
    engine.set_file_importance("b.ts", 99)
    row = engine.get_file_summary("B.ts").first()
    assert row["summary"] == "helps" and row["importance"] == 10 and row["dependents"]
    assert to_envelope(lambda: engine.get_file_summary("nope.ts"))["error"] == "NOT_FOUND"
    assert to_envelope(lambda: engine.list_changed_since("yesterday-ish"))["error"] == "INVALID_ARGUMENT"
    assert paths(engine.search("helps"))[0] == "src/b.ts"


def test_python_relative_import(engine):
    row = engine.get_file_summary("tests/u.py").first()
    assert len(row["dependents"].split(",")) == 1


def test_remove(engine):
    before = engine.status().first()["total"]
    engine.exclude_and_remove("tests/u.py")
    assert engine.status().first()["total"] == before - 1
    assert engine.get_file_summary("tests/t.py").first()["deps"] == ""
    assert engine.excludes("r") == ["**/u.py"]


def test_communities_cover_each_file_once(engine):
    rows = engine.get_communities().collect()
    members = [m for r in rows for m in r["members"].split(",")]
    stored = engine.store.manifest()["communities"]
    engine.get_communities().collect()
    assert engine.store.manifest()["communities"] == stored  # nothing changed, nothing made anew
    assert engine.graph_data()[0].filter("community_id is not null").count() > 0
    assert len(members) == len(set(members)) and {"src/a.ts", "src/b.ts", "src/c.js"} <= set(members)
