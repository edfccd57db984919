"""The engine: one method per tool over a store of tables, each returning a DataFrame; to_envelope makes the JSON answer of one."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import changes, deps, files, graph, jobs, parse, symbols
from .sources import scan
from .store import Store, replace_by_key, settled, upsert

FILES = "file_id long, repo string, path string, name string, is_directory boolean, importance int, manual_importance int, summary string, mtime long, summary_stale_since long, concepts_stale_since long, change_impact_stale_since long, concepts string, change_impact string, exports_snapshot string"


class NotFound(LookupError):
    pass


def to_envelope(make: Callable[[], DataFrame], most: int = 10_000) -> dict:
    """{"ok": True, "rows": [...]} or {"ok": False, "error", "message"}. Answers are small; more than ``most`` rows are marked truncated."""
    try:
        rows = [r.asDict(recursive=True) for r in make().limit(most + 1).collect()]
    except NotFound as e:
        return {"ok": False, "error": "NOT_FOUND", "message": str(e)}
    except ValueError as e:
        return {"ok": False, "error": "INVALID_ARGUMENT", "message": str(e)}
    return {"ok": True, "rows": rows[:most], **({"truncated": True} if len(rows) > most else {})}


class Engine:
    """Tables files, deps, symbols, calls of many repositories. A file's key is a digest of (repo, path), a symbol's of (repo, path, name, line)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    # writing

    def set_base_directory(self, root: str, repo: str, config: scan.Config | None = None, aliases: list[tuple[str, str]] | None = None, modules: dict[str, str] | None = None) -> DataFrame:
        """Scans a repository and publishes its tables. Files whose time is the stored one aren't opened; of the others what is stored beyond their
        source text (summaries, concepts, manual importance) stays, and they and what depends on them become stale as their changes say.
        Aliases, Go modules and package versions come from the repository's own configuration files unless given. Also the sweep at start:
        what is missing, new or newer on disk is found by the same comparison."""
        config = scan.with_excludes(config or scan.Config(), self.excludes(repo))
        found = scan.scan(self.spark, root, repo, config, content=False, uri=True).drop("length")
        return self._index(root, repo, settled(found), aliases, modules)

    def apply_events(self, root: str, repo: str, events: DataFrame, aliases: list[tuple[str, str]] | None = None, modules: dict[str, str] | None = None) -> DataFrame:
        """The tables after events (path, event_type): files added or changed are read, files removed go; of a path the last event by (ts,
        event_id) counts, if events have those. The same tables as a scan of the whole tree would give. The paths of one batch pass the driver."""
        if "ts" in events.columns:
            events = changes.last_events(events)
        last = {r["path"]: r["event_type"] for r in events.select("path", "event_type").collect()}
        config = scan.with_excludes(scan.Config(), self.excludes(repo))
        base = root.rstrip("/")
        there = [f"{base}/{p}" for p, kind in last.items() if kind != "unlink" and self.store.exists(f"{base}/{p}")]
        touched = self.spark.createDataFrame([(p,) for p in last], "path string")
        kept = self.table("files").filter(F.col("repo") == repo).join(F.broadcast(touched), "path", "left_anti")
        kept = kept.select("repo", "path", "name", "is_directory", "importance", "mtime", F.concat(F.lit(base + "/"), "path").alias("uri"))
        if there:
            kept = kept.unionByName(scan.scan(self.spark, there, repo, config, content=False, uri=True, top=root).drop("length"))
        return self._index(root, repo, settled(kept), aliases, modules)

    def _configuration(self, repo: str, found: DataFrame, aliases, modules) -> tuple[list[tuple[str, str]], dict[str, str], DataFrame]:
        """Aliases, Go modules and packages (repo, name, version, is_dev) of the configuration files at the repository's top."""
        own = {r["path"]: r["content"] for r in scan.with_content(self.spark, found.filter(F.col("path").isin("go.mod", "tsconfig.json", "package.json"))).select("path", "content").collect()}
        if aliases is None:
            aliases = scan.path_aliases(own["tsconfig.json"] or "") if "tsconfig.json" in own else []
        if modules is None:
            name = scan.module_name(own.get("go.mod") or "")
            modules = {repo: name} if name else {}
        manifest = self.spark.createDataFrame([(repo, own.get("package.json") or "{}")], "repo string, content string")
        return list(aliases), modules, scan.manifest_packages(manifest)

    def _index(self, root: str, repo: str, found: DataFrame, aliases, modules) -> DataFrame:
        now = int(time.time() * 1000)
        aliases, modules, packages = self._configuration(repo, found, aliases, modules)
        found = found.withColumn("file_id", F.xxhash64("repo", "path"))
        has = self.store.has("files")
        empty = self.spark.createDataFrame
        old = self.table("files") if has else empty([], FILES)
        own_old = old.filter(F.col("repo") == repo)
        parsed_old = self.table("parsed").filter(F.col("repo") == repo) if has else empty([], f"{parse.PARSED}, mtime long")
        # only files that are new or have another time are opened and parsed
        todo = found.join(parsed_old.select("path", F.col("mtime").alias("known")), "path", "left").filter(F.col("known").isNull() | (F.col("known") != F.col("mtime")))
        todo = settled(todo)
        fresh = settled(parse.parsed(scan.with_content(self.spark, todo)).join(todo.select("path", "mtime"), "path"))
        kept = parsed_old.join(found.select("path"), "path", "left_semi").join(todo.select("path"), "path", "left_anti")
        parsed = settled(kept.select(fresh.columns).unionByName(fresh))
        made = parse.index_parsed(parsed.drop("mtime"), found.select("repo", "path"), aliases, modules)
        key = lambda path: F.xxhash64("repo", path)
        edges = parse.with_versions(parse.collapsed(made["edges"]), packages)
        edges = edges.select("repo", key("source").alias("source_id"), F.when(F.col("target").isNotNull(), key("target")).otherwise(F.xxhash64(F.lit("package"), "package")).alias("target_id"), "dependency_type", "package", "package_version", "is_dev", "edge_type", "confidence", "confidence_source", "weight", F.to_json("names").alias("imported_names"), F.col("line").alias("import_line"))
        edges = settled(edges)
        rated = files.rated(found.select("file_id", "path"), edges).select("file_id", "importance")
        new = found.drop("importance", "uri").join(rated, "file_id").withColumn("summary", F.lit(None).cast("string"))
        if has:
            # what changed and whom it concerns, by the edges and exports as they stood before
            batch = self._changes(own_old, parsed_old, fresh, todo, found)
            own_old = changes.apply(own_old, deps.local(self.table("deps").filter(F.col("repo") == repo)), batch, now)
        both = upsert(own_old, new, "file_id", ["repo", "path", "name", "is_directory", "importance", "mtime"]).join(found.select("file_id"), "file_id", "left_semi")
        snaps = parse.snapshots(fresh.select("repo", "path", F.inline("exports")), fresh.select("repo", F.col("path").alias("source"), F.inline("edges")), now)
        both = both.join(snaps.select(key("path").alias("file_id"), F.col("exports_snapshot").alias("__snap")), "file_id", "left").withColumn("exports_snapshot", F.coalesce("__snap", "exports_snapshot"))
        rest = lambda name, df: self.table(name).filter(F.col("repo") != repo).unionByName(df) if has else df
        syms = made["symbols"].select("repo", "id", key("path").alias("file_id"), "name", "kind", "start_line", "end_line", "is_export")
        calls = made["calls"].withColumn("id", F.xxhash64("repo", "caller_symbol_id", "callee_symbol_id", "call_line"))
        roots = empty([(repo, root.rstrip("/"))], "repo string, root string")
        self.store.publish(files=old.filter(F.col("repo") != repo).unionByName(both.select(old.columns)), deps=rest("deps", edges), symbols=rest("symbols", syms), calls=rest("calls", calls), parsed=rest("parsed", parsed), repositories=rest("repositories", roots))
        return self.table("files").filter(F.col("repo") == repo)

    @staticmethod
    def _changes(own_old: DataFrame, parsed_old: DataFrame, fresh: DataFrame, todo: DataFrame, found: DataFrame) -> DataFrame:
        """(file_id, event_type, affects_dependents) of files changed or gone."""
        ident = F.xxhash64("repo", "path").alias("file_id")
        before = parsed_old.join(todo.select("path"), "path", "left_semi")
        each = lambda what, df1, df2: df1.select(ident, F.lit(1).alias("version"), F.inline(what)).unionByName(df2.select(ident, F.lit(2).alias("version"), F.inline(what)))
        said = changes.semantic_diff(each("exports", before, fresh), each("edges", before, fresh).select("file_id", "version", "specifier")).select("file_id", "affects_dependents")
        changed = todo.filter("known is not null").select("file_id").join(said, "file_id", "left").select("file_id", F.lit("change").alias("event_type"), F.coalesce("affects_dependents", F.lit(False)).alias("affects_dependents"))
        gone = own_old.select("file_id").join(found.select("file_id"), "file_id", "left_anti").select("file_id", F.lit("unlink").alias("event_type"), F.lit(True).alias("affects_dependents"))
        return settled(changed.unionByName(gone))

    def excludes(self, repo: str) -> list[str]:
        """Patterns that exclude_and_remove stored."""
        return [r[0] for r in self.table("excludes").filter(F.col("repo") == repo).select("pattern").distinct().orderBy("pattern").collect()] if self.store.has("excludes") else []

    def set_file_summary(self, path: str, summary: str) -> DataFrame:
        return self._set(path, summary=F.lit(summary))

    def set_file_importance(self, path: str, importance: int) -> DataFrame:
        """Kept in a column of its own, so that rescoring leaves it."""
        return self._set(path, manual_importance=F.lit(max(0, min(10, importance))))

    def _set(self, path: str, **values) -> DataFrame:
        one = self._one(path)
        hit = F.col("file_id") == one["file_id"]
        self.store.publish(files=self.table("files").withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()}))
        return self.table("files").filter(hit)

    def scan_all(self, least: int = 0, remaining_only: bool = False) -> DataFrame:
        """Marks files stale and returns the jobs that are due."""
        self.store.publish(files=files.mark_all_stale(self.table("files"), int(time.time() * 1000), least, remaining_only))
        return jobs.due(self.rated())

    def exclude_and_remove(self, path: str) -> DataFrame:
        """Removes a file from all tables and stores the pattern that keeps later scans from bringing it back."""
        one = self._one(path)
        t = [self.table(n) for n in ("files", "deps", "symbols", "calls")]
        kept = files.delete_cascade(*t, self.table("files").filter(F.col("file_id") == one["file_id"]))
        pattern = self.spark.createDataFrame([(one["repo"], "**/" + one["path"].rsplit("/", 1)[-1])], "repo string, pattern string")
        every = self.table("excludes").unionByName(pattern).distinct() if self.store.has("excludes") else pattern
        parsed = self.table("parsed").filter(~((F.col("repo") == one["repo"]) & (F.col("path") == one["path"])))
        self.store.publish(**dict(zip(("files", "deps", "symbols", "calls"), kept, strict=True)), excludes=every, parsed=parsed)
        return pattern.select(F.lit(one["path"]).alias("removed"), "pattern")

    def delete_symbols(self, path: str) -> None:
        """A file's symbols go; calls to them stay and count as unresolved."""
        one = self._one(path)
        self.store.publish(symbols=self.table("symbols").filter(F.col("file_id") != one["file_id"]))

    def replace_symbols(self, path: str, new: DataFrame) -> None:
        """A file's symbols replaced by new ones; none clear them."""
        one = self.table("files").filter(F.col("file_id") == self._one(path)["file_id"]).select("file_id")
        self.store.publish(symbols=replace_by_key(self.table("symbols"), new, "file_id", one))

    def put_state(self, key: str, value: str) -> None:
        kv = self.table("kv") if self.store.has("kv") else self.spark.createDataFrame([], "key string, value string")
        self.store.publish(kv=files.put(kv, key, value))

    def get_state(self, key: str) -> str | None:
        row = self.table("kv").filter(F.col("key") == key).first() if self.store.has("kv") else None
        return row["value"] if row else None

    def add_tokens(self, usage: DataFrame) -> DataFrame:
        """Adds usage (repo, tokens) to the stored totals (repo, tokens)."""
        before = self.table("tokens") if self.store.has("tokens") else self.spark.createDataFrame([], "repo string, tokens long")
        self.store.publish(tokens=jobs.tokens_by_repo(before.unionByName(usage.select("repo", F.col("tokens").cast("long")))).withColumnRenamed("total", "tokens"))
        return self.table("tokens")

    def apply_results(self, results: DataFrame) -> None:
        """Answers of a model (file_id, job_type, value, created_at), errors left out, written and no longer stale."""
        good = results.filter("error is null") if "error" in results.columns else results
        self.store.publish(files=files.apply_results(self.table("files"), good).select(self.table("files").columns))

    def replace_edges(self, new: DataFrame) -> None:
        self.store.publish(deps=replace_by_key(self.table("deps"), new, "source_id"))

    # reading

    def rated(self) -> DataFrame:
        return self.table("files").withColumn("importance", F.coalesce("manual_importance", "importance"))

    def _one(self, path: str):
        row = files.match_suffix(self.table("files"), path).first()
        if row is None:
            raise NotFound(path)
        return row

    def list_files(self, n: int | None = None) -> DataFrame:
        return files.listed(self.rated(), n) if n else files.tree(self.table("files")).orderBy("path")

    def find_important_files(self, n: int = 10, least: int = 0) -> DataFrame:
        return deps.with_counts(files.top(self.rated(), n, least), self.table("deps")).orderBy(F.desc("importance"), "path")

    def get_file_summary(self, path: str) -> DataFrame:
        """A file with edges, symbols, imported names by dependent, and whether it was found newer on disk just now (then it is marked stale)."""
        one = self._one(path)
        newer = self._refreshed(one)
        edge = self.table("deps").filter((F.col("source_id") == one["file_id"]) | (F.col("target_id") == one["file_id"]))
        symbols_of = self.table("symbols").filter(F.col("file_id") == one["file_id"]).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "name", "kind", "end_line", "is_export"))).alias("symbols"))
        names = deps.dependents_with_imports(edge.filter(F.col("target_id") == one["file_id"]))
        names = names.groupBy(F.col("target_id").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("source_id", "names", "lines"))).alias("imported_by"))
        own = self.rated().filter(F.col("file_id") == one["file_id"]).join(symbols_of, "file_id", "left").join(names, "file_id", "left")
        return deps.with_lists(own, edge).withColumn("newer_on_disk", F.lit(newer))

    def _refreshed(self, one) -> bool:
        """Whether the file's time on disk differs by more than 1 ms from the stored one; if so the new time is stored and its own columns go stale."""
        roots = self.table("repositories").filter(F.col("repo") == one["repo"]).first() if self.store.has("repositories") else None
        at = self.store.modified(f"{roots['root']}/{one['path']}") if roots else None
        if at is None or one["mtime"] is None or abs(at - one["mtime"]) <= 1:
            return False
        hit = F.col("file_id") == one["file_id"]
        marked = files.mark_stale(self.table("files"), int(time.time() * 1000), hit, files.STALE[:2])
        self.store.publish(files=marked.withColumn("mtime", F.when(hit, F.lit(at).cast("long")).otherwise(F.col("mtime"))))
        return True

    def hook_summary(self, path: str, most: int = 2048) -> str:
        """What to know before an edit, cut to so many characters; empty if the file isn't known."""
        try:
            row = self.get_file_summary(path).first()
        except NotFound:
            return ""
        return f"{row['path']} (importance {row['importance']}): {row['summary'] or 'no summary'}\nUsed by: {row['dependents'].count(',') + 1 if row['dependents'] else 0} files"[:most]

    def find_symbol(self, name: str, kind: str | None = None, exported_only: bool = False, n: int | None = None) -> DataFrame:
        return symbols.find(self.table("symbols"), self.table("files"), name, kind, exported_only, n)

    def find_callers(self, name: str, path: str | None = None, n: int | None = None) -> DataFrame:
        return symbols.callers(self.table("calls"), self.table("symbols"), self.table("files"), name, self._one(path)["file_id"] if path else None, n)

    def find_callees(self, name: str, path: str | None = None, n: int | None = None) -> DataFrame:
        return symbols.callees(self.table("calls"), self.table("symbols"), self.table("files"), name, self._one(path)["file_id"] if path else None, n)

    def list_changed_since(self, since: str, root: str | None = None, n: int | None = None) -> DataFrame:
        kind, value = scan.parse_since(since)
        if kind == "time":
            return files.changed_since(self.table("files"), value, n)
        out = files.by_paths(self.table("files"), scan.git_changed(self.spark, root or ".", value)).orderBy(F.desc("mtime"), "path")
        return out.limit(n) if n else out

    def search(self, query: str, n: int = 10) -> DataFrame:
        return files.search(self.rated(), query, n)

    def status(self) -> DataFrame:
        """Counts of files, stale files, edges, jobs that are due and tokens used."""
        due = jobs.due(self.rated()).agg(F.count("*").alias("pending_jobs"))
        used = self.table("tokens").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")) if self.store.has("tokens") else self.spark.createDataFrame([(0,)], "tokens long")
        return files.progress(self.table("files")).crossJoin(files.statistics(self.table("files"), self.table("deps")).select("stale", "local_edges")).crossJoin(due).crossJoin(used)

    def repositories(self) -> DataFrame:
        return self.table("repositories").join(self.table("files").groupBy("repo").agg(F.count("*").alias("files")), "repo", "left")

    def detect_cycles(self) -> DataFrame:
        named = graph.cycles(deps.local(self.table("deps"))).join(self.table("files").select("file_id", "path"), "file_id")
        return named.groupBy("cycle_id").agg(F.array_sort(F.collect_list("path")).alias("members")).withColumn("size", F.size("members")).orderBy(F.element_at("members", 1))

    def get_cycles_for_file(self, path: str) -> DataFrame:
        return self.detect_cycles().filter(F.array_contains("members", self._one(path)["path"]))

    def communities(self, resolution: float = 1.0) -> DataFrame:
        """(id, repo, file_id, community_id), stored; made anew only if the edges were published since."""
        mark = f"{self.store.manifest()['deps']} {resolution}"
        if self.get_state("communities") != mark:
            edges = deps.local(self.table("deps")).filter("source_id != target_id")
            und = edges.groupBy("repo", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.sum("weight").alias("weight"))
            labels = graph.communities(settled(und), resolution).withColumn("id", F.xxhash64("repo", "file_id"))
            self.store.publish(communities=labels)
            self.put_state("communities", mark)
        return self.table("communities")

    def get_communities(self, resolution: float = 1.0) -> DataFrame:
        return graph.community_report(self.communities(resolution), self.rated())

    def dir_detail(self, directory: str) -> DataFrame:
        return files.directory_statistics(self.rated()).filter(F.col("directory") == directory)

    def graph_data(self, directory: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the graph view."""
        edges = deps.local(self.table("deps"))
        edges = graph.subtree_edges(edges, self.table("files"), directory) if directory else edges
        known = self.table("communities") if self.store.has("communities") else self.spark.createDataFrame([], "id long, file_id long, community_id long")
        return graph.graph_nodes(edges, self.rated(), known), edges.select("source_id", "target_id")

    def digest(self, ms: int, most: int = 1024) -> str:
        """The five most important files and what changed since, cut to so many characters."""
        top = [r["path"] for r in self.find_important_files(5).collect()]
        new = [r["path"] for r in files.changed_since(self.table("files"), ms, 20).select("path").collect()]
        return ("Important: " + ", ".join(top) + "\nChanged: " + ", ".join(new))[:most]
