"""Reads source trees, manifests, line-delimited JSON, logs and earlier stores as DataFrames."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, score
from ..operators.jobs import parse_log

CHANGE_SCHEMA = "event_id long, ts timestamp, path string, event_type string"
# Globs that are always excluded unless configured otherwise.
DEFAULT_GLOBS = ("**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/*.log", "**/*.min.js", "**/*.map")


@dataclass
class Config:
    base_directory: str = "."
    exclude_patterns: list[str] = field(default_factory=lambda: list(DEFAULT_GLOBS))
    ignore_rules: list[str] = field(default_factory=list)
    watch: bool = True


def load_config(path: str) -> Config:
    """A JSON file; missing default patterns are appended, a bad or absent file gives the defaults."""
    try:
        with open(path) as f:
            raw = json.load(f)
        if not isinstance(raw, dict):
            raise ValueError(raw)
    except (OSError, ValueError):
        return Config()
    own = [p for p in raw.get("excludePatterns", []) if isinstance(p, str)]
    return Config(str(raw.get("baseDirectory", ".")), [*own, *(p for p in DEFAULT_GLOBS if p not in own)], [r for r in raw.get("ignoreRules", []) if isinstance(r, str)], bool(raw.get("watch", True)))


def with_excludes(config: Config, more: list[str]) -> Config:
    """The set union of patterns, in order."""
    return Config(config.base_directory, list(dict.fromkeys([*config.exclude_patterns, *more])), config.ignore_rules, config.watch)


def exclude_file(config: Config, path: str) -> Config:
    """Excluding one file adds a pattern for its name anywhere."""
    return with_excludes(config, ["**/" + path.rsplit("/", 1)[-1]])


def walk(root: str, config: Config | None = None) -> Iterator[tuple[str, int, int]]:
    """(relative path, mtime in ms, size) below root; excluded directories aren't entered. For a driver's own disk."""
    config = config or Config()
    pattern = re.compile("|".join(f"(?:{paths.glob_pattern(g)[4:]})" for g in config.exclude_patterns) or r"(?!)", re.I)
    stack = [root]
    while stack:
        here = stack.pop()
        with os.scandir(here) as entries:
            for e in sorted(entries, key=lambda e: e.name, reverse=True):
                rel = os.path.relpath(e.path, root).replace(os.sep, "/")
                if ".git" in rel or "node_modules" in rel or pattern.search(rel) or (e.is_dir(follow_symlinks=False) and pattern.search(rel + "/")):
                    continue
                if e.is_dir(follow_symlinks=False):
                    stack.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    st = e.stat()
                    yield rel, int(st.st_mtime * 1000), st.st_size


def scan(spark: SparkSession, root: str | list[str], repo: str, config: Config | None = None, content: bool = True, uri: bool = False, top: str | None = None) -> DataFrame:
    """(repo, path, name, is_directory, importance, mtime, length[, uri][, content]) of a tree in any file system Spark reads.

    root may also be a list of files below top. The listing comes without content, so excluded files are never opened; with content, files that are left are read by their paths."""
    config = config or Config()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    top = "/" + re.sub("^[a-z0-9]+:/+", "/", top or root).strip("/")
    below = lambda p: paths.relative(F.regexp_replace(p, "^[a-z0-9]+:/+", "/"), top)
    df = raw.withColumn("uri", F.col("path")).withColumn("path", below("path"))
    df = df.filter(~paths.excluded(F.col("path"), tuple(config.exclude_patterns)))
    if config.ignore_rules:
        df = df.filter(~paths.ignored(F.col("path"), config.ignore_rules))
    out = df.select(F.lit(repo).alias("repo"), "path", paths.basename(F.col("path")).alias("name"), F.lit(False).alias("is_directory"), score.base_importance(F.col("path")).alias("importance"), F.unix_millis("modificationTime").alias("mtime"), "length", "uri")
    out = with_content(spark, out) if content else out
    return out if uri else out.drop("uri")


def with_content(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Files (uri, ...) with their text; no other file is opened. Their names pass the driver, as a listing does anyway."""
    uris = [r[0] for r in found.select("uri").toLocalIterator()]
    if not uris:
        return found.withColumn("content", F.lit(None).cast("string"))
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")  # noqa: E731  a path and its URI name one file
    read = spark.read.format("binaryFile").load(uris).select(bare("path").alias("__at"), F.decode("content", "UTF-8").alias("content"))
    return found.join(read, bare("uri") == F.col("__at")).drop("__at")


def to_parse(found: DataFrame, stored: DataFrame, edges: DataFrame) -> DataFrame:
    """Scanned files whose stored mtime differs or that have no edges yet; parsing is the cost, so the rest is skipped."""
    known = stored.select("repo", "path", F.col("mtime").alias("known")).join(edges.select("repo", F.col("source").alias("path")).distinct(), ["repo", "path"], "left_semi")
    return found.join(known, ["repo", "path"], "left").filter(F.col("known").isNull() | (F.col("known") != F.col("mtime"))).drop("known")


def legacy_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, is_directory, importance, summary) from a nested JSON tree, which has no flat schema: one file is one row of text, flattened where it is read."""
    return legacy_rows(spark.read.text(path, wholetext=True))


def legacy_rows(trees: DataFrame) -> DataFrame:
    """As legacy_tree, from trees held in rows (value)."""

    def flatten(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for t in pdf["value"]:
                todo = [json.loads(t)]
                while todo:
                    n = todo.pop()
                    n = n.get("fileTree", n)
                    rows.append((n.get("path"), n.get("name"), bool(n.get("isDirectory")), n.get("importance"), n.get("summary")))
                    todo += n.get("children") or []
            yield pd.DataFrame(rows, columns=["path", "name", "is_directory", "importance", "summary"]).astype({"importance": "Int64"})

    return trees.mapInPandas(flatten, "path string, name string, is_directory boolean, importance long, summary string")


def discover(spark: SparkSession, tops: list[str], marker: str = ".loamgraph", blacklist: list[str] = ()) -> DataFrame:
    """Repositories one or two levels below the top folders: folders that hold the marker. For a driver's own disk."""
    found = []
    for top in tops:
        level = [top]
        for _ in range(2):
            level = [e.path for d in level if os.path.isdir(d) for e in sorted(os.scandir(d), key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and not e.name.startswith(".")]
            found += [d for d in level if os.path.exists(os.path.join(d, marker))]
    return repositories(spark, found, blacklist)


def repositories(spark: SparkSession, roots: list[str], blacklist: list[str] = ()) -> DataFrame:
    """Distinct repositories without blacklisted ones."""
    found = spark.createDataFrame([(r.rstrip("/"),) for r in roots], "root string").dropDuplicates()
    bad = spark.createDataFrame([(b.rstrip("/"),) for b in blacklist], "root string")
    return found.join(bad, "root", "left_anti").withColumn("repo", paths.basename(F.col("root")))


def git_changed(spark: SparkSession, root: str, since: str, timeout: int = 5) -> DataFrame:
    """(path) that differ between a commit and HEAD."""
    out = subprocess.run(["git", "-C", root, "diff", "--name-only", since, "HEAD"], capture_output=True, text=True, timeout=timeout, check=True).stdout
    return spark.createDataFrame([(x,) for x in out.splitlines() if x], "path string")


def parse_since(since: str) -> tuple[str, str | int]:
    """("commit", hash) or ("time", ms); raises ValueError."""
    from datetime import datetime, timezone

    if re.fullmatch(r"[0-9a-fA-F]{7,40}", since):
        return "commit", since
    at = datetime.fromisoformat(since.replace("Z", "+00:00"))
    return "time", int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def manifest_packages(manifests: DataFrame) -> DataFrame:
    """(repo, name, version, is_dev, scope) of package manifests (repo, content); dependencies win over devDependencies."""
    m = manifests.select("repo", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("m"))
    part = lambda f, dev: m.select("repo", F.explode(f"m.{f}").alias("name", "version"), F.lit(dev).alias("is_dev"))
    both = part("dependencies", False).unionByName(part("devDependencies", True))
    one = both.groupBy("repo", "name").agg(F.min(F.struct("is_dev", "version")).alias("v"))
    return one.select("repo", "name", "v.version", "v.is_dev", paths.scope_of(F.col("name")).alias("scope"))


def strip_comments(text: str) -> str:
    """JSON with comments and trailing commas to JSON; strings stay as they are."""
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], out)


def path_aliases(text: str) -> list[tuple[str, str]]:
    """(alias with at most one *, first replacement) of a compiler configuration."""
    try:
        options = json.loads(strip_comments(text)).get("compilerOptions", {})
    except ValueError:
        return []
    base = options.get("baseUrl", ".").removeprefix("./").strip("/")
    join = lambda p: "/".join(x for x in (base, p.removeprefix("./")) if x not in ("", "."))
    return [(k, join(v[0])) for k, v in options.get("paths", {}).items() if v]


def module_name(text: str) -> str | None:
    m = re.search(r"^module\s+(\S+)", text, re.M)
    return m[1] if m else None


def messages(lines: DataFrame, schema: str) -> DataFrame:
    """Line-delimited JSON (value); malformed lines are dropped."""
    marked = lines.select(F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("m"))
    return marked.select("m.*").filter("_bad is null").drop("_bad")


def token_file(spark: SparkSession, path: str) -> DataFrame:
    """(repo, tokens); missing or bad files are empty."""
    try:
        raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,bigint>").alias("m"))
        return raw.select(F.explode("m").alias("repo", "tokens"))
    except Exception as e:  # Spark's analysis error for a path that isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "repo string, tokens long")


def log_lines(lines: DataFrame) -> DataFrame:
    return lines.select(parse_log(F.col("value")).alias("l")).select("l.*")


def change_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of change logs (JSON lines) in a folder. Files are taken by modification time, so write them in the order of events."""
    return spark.readStream.schema(CHANGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of parsed log lines; the checkpoint takes the place of file offsets."""
    return log_lines(spark.readStream.text(folder))
