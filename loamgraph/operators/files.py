"""Files: lookups, rankings, statistics of repositories and directories, staleness, the tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, score
from . import deps as edges

STALE = ("summary_stale_since", "concepts_stale_since", "change_impact_stale_since")
# Fixed value: files of these kinds carry no concepts.
NO_CONCEPTS = "md mdx txt rst adoc json json5 jsonc yaml yml toml ini conf cfg env css scss sass less html htm svg xml lock csv tsv".split()


def is_stale() -> Column:
    return F.coalesce(*STALE).isNotNull()


def rated(files: DataFrame, deps: DataFrame) -> DataFrame:
    """Files with name, counts of edges and importance."""
    out = edges.with_counts(files, deps)
    return out.withColumn("name", paths.basename(F.col("path"))).withColumn("importance", score.importance(F.col("path"), F.col("dependents"), F.col("dependencies"), F.col("packages")))


def top(files: DataFrame, n: int = 10, least: int = 0) -> DataFrame:
    """By importance, then path."""
    return files.filter(~F.col("is_directory") & (F.col("importance") >= least)).orderBy(F.desc("importance"), "path").limit(n or 10)


def listed(files: DataFrame, n: int) -> DataFrame:
    """The n most important files with the total and whether any were left out."""
    total = files.filter(~F.col("is_directory")).agg(F.count("*").alias("total"))
    return top(files, n).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > n)


def children(files: DataFrame, directory: str) -> DataFrame:
    rest = F.substring("path", len(directory) + 2, 1 << 30)
    return files.filter(F.startswith("path", F.lit(directory + "/")) & (F.instr(rest, "/") == 0))


def changed_since(files: DataFrame, ms: int, n: int | None = None) -> DataFrame:
    """Strictly later than ms; files without mtime are left out; newest first."""
    out = files.filter(~F.col("is_directory") & (F.col("mtime") > ms))
    return out.orderBy(F.desc("mtime"), "path").limit(n) if n else out


def by_paths(files: DataFrame, wanted: DataFrame) -> DataFrame:
    return files.join(wanted, "path", "left_semi")


def progress(files: DataFrame) -> DataFrame:
    """Counts of files with and without summary and concepts (an empty summary counts as none); null sums on no files."""
    some, con = F.col("summary").isNotNull() & (F.col("summary") != ""), F.col("concepts").isNotNull()
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return files.filter(~F.col("is_directory")).agg(F.count("*").alias("total"), n(some).alias("with_summary"), n(con).alias("with_concepts"), n(~some).alias("pending_summary"), n(~con).alias("pending_concepts"))


def statistics(files: DataFrame, deps: DataFrame) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    f = files.filter(~F.col("is_directory")).agg(F.count("*").alias("files"), n(F.col("summary").isNotNull()).alias("with_summary"), n(F.col("concepts").isNotNull()).alias("with_concepts"), n(is_stale()).alias("stale"))
    return f.crossJoin(edges.local(deps).agg(F.count("*").alias("local_edges")))


def directory_statistics(files: DataFrame) -> DataFrame:
    """Every directory over all its descendants: files, mean importance to 0.1, whole percents with summary and stale."""
    down = files.filter(~F.col("is_directory")).select(F.explode(paths.ancestors(F.col("path"))).alias("directory"), "importance", F.col("summary").isNotNull().cast("int").alias("s"), is_stale().cast("int").alias("t"))
    pct = lambda c: F.round(F.sum(c) / F.count("*") * 100).cast("long")
    return down.groupBy("directory").agg(F.count("*").alias("files"), F.round(F.avg("importance"), 1).alias("avg_importance"), pct("s").alias("pct_summary"), pct("t").alias("pct_stale"))


def directory_top(files: DataFrame, n: int = 10) -> DataFrame:
    """The n most important files below each directory. Partial top-n before the shuffle keeps a large directory from one task: each
    (directory, slice) gives n, and those meet."""
    down = files.filter(~F.col("is_directory")).select(F.explode(paths.ancestors(F.col("path"))).alias("directory"), "path", "importance")
    order = (F.desc("importance"), F.col("path"))
    first = down.withColumn("slice", F.pmod(F.xxhash64("path"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("directory", "slice").orderBy(*order))).filter(F.col("rank") <= n)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("directory").orderBy(*order))).filter(F.col("rank") <= n).drop("slice")


def directory_counts(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("is_directory")).groupBy(paths.top_directory(F.col("path")).alias("directory")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "directory")


def tree(files: DataFrame) -> DataFrame:
    """Every directory and file: (path, parent, name, depth, is_directory), directories synthesised."""
    rows = files.filter(~F.col("is_directory")).select("path", F.lit(False).alias("is_directory"))
    dirs = files.select(F.explode(paths.ancestors(F.col("path"))).alias("path"), F.lit(True).alias("is_directory")).distinct()
    both = rows.unionByName(dirs)
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    return both.select("path", parent.alias("parent"), paths.basename(F.col("path")).alias("name"), (F.size(F.split("path", "/", -1)) - 1).alias("depth"), "is_directory")


def entries(tree_rows: DataFrame, directory: str) -> DataFrame:
    """Directories first, then by name."""
    return tree_rows.filter(F.col("parent") == directory).orderBy(F.desc("is_directory"), "name")


def search(files: DataFrame, query: str, n: int = 10, per_token: int = 500) -> DataFrame:
    """Ranks of each token's best rows summed per file. All tokens take one scan of files; concepts are parsed once a row."""
    tokens = score.query_tokens(query)
    c, i = F.from_json("concepts", score.CONCEPTS), F.from_json("change_impact", score.IMPACT)
    rows = files.filter(~F.col("is_directory")).select("path", "importance", "summary", c.alias("c"), i.alias("i"))
    rank = lambda t: F.struct(F.lit(t).alias("token"), score.match_rank(F.lit(t), F.col("c"), F.col("i"), F.col("summary"), F.col("path")).alias("rank"))
    hits = rows.select("path", "importance", F.col("c.purpose").alias("purpose"), F.explode(F.array(*map(rank, tokens)) if tokens else F.array().cast("array<struct<token:string,rank:int>>")).alias("h"))
    hits = hits.select("path", "importance", "purpose", "h.token", "h.rank").filter("rank > 0")
    # Spark keeps a per-group limit of a rank filter before the shuffle
    best = hits.withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("rank"), F.desc("importance"), "path"))).filter(F.col("place") <= per_token)
    total = best.groupBy("path").agg(F.sum("rank").alias("total_rank"), F.count("*").alias("hits"), F.first("importance").alias("importance"), F.first("purpose").alias("purpose"))
    return total.orderBy(F.desc("total_rank"), F.desc("hits"), F.desc("importance"), "path").limit(n)


def compare_with_disk(files: DataFrame, disk: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(file_id, state): missing from disk, new there, or stale where mtimes differ by more than the tolerance."""
    both = files.filter(~F.col("is_directory")).select("file_id", F.col("mtime").cast("double").alias("known"), F.lit(True).alias("a")).join(disk.select("file_id", F.col("mtime").cast("double").alias("seen"), F.lit(True).alias("b")), "file_id", "full_outer")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(F.col("known").isNotNull() & (F.abs(F.col("known") - F.col("seen")) > tolerance), "stale")
    return both.withColumn("state", state).filter("state is not null").select("file_id", "state")


def mark_stale(files: DataFrame, ts: int, which: Column | None = None, columns: tuple[str, ...] = STALE) -> DataFrame:
    """The columns set to ts where which holds."""
    hit = which if which is not None else F.lit(True)
    return files.withColumns({c: F.when(hit, F.lit(ts).cast("long")).otherwise(F.col(c)) for c in columns})


def mark_all_stale(files: DataFrame, ts: int, least: int = 0, remaining_only: bool = False) -> DataFrame:
    """All files of at least that importance; remaining_only: those without summary that aren't stale yet; else those with any column fresh."""
    hit = ~F.col("is_directory") & (F.coalesce("importance", F.lit(0)) >= least)
    fresh = F.col("summary").isNull() & F.col("summary_stale_since").isNull() if remaining_only else F.col(STALE[0]).isNull() | F.col(STALE[1]).isNull() | F.col(STALE[2]).isNull()
    return mark_stale(files, ts, hit & fresh)


def apply_results(files: DataFrame, results: DataFrame) -> DataFrame:
    """results (file_id, job_type, value, created_at): the latest value of each kind is written and its staleness cleared; other kinds raise."""
    kinds = ("summary", "concepts", "change_impact")
    bad = F.when(~F.col("job_type").isin(*kinds), F.raise_error(F.concat(F.lit("unknown job type "), "job_type")).cast("string"))
    last = results.withColumn("job_type", F.coalesce(bad, "job_type")).groupBy("file_id").agg(*[F.max(F.when(F.col("job_type") == k, F.struct("created_at", "value"))).alias(f"r_{k}") for k in kinds])
    out = files.join(last, "file_id", "left")
    for k in kinds:
        got = F.col(f"r_{k}").isNotNull()
        out = out.withColumn(k, F.when(got, F.col(f"r_{k}.value")).otherwise(F.col(k))).withColumn(f"{k}_stale_since", F.when(~got, F.col(f"{k}_stale_since"))).drop(f"r_{k}")
    return out


def match_suffix(files: DataFrame, wanted: str) -> DataFrame:
    """The best match of a path: exact, then ignoring case, then as a suffix, then by name; ties by path."""
    w = wanted.lower()
    name = w.rsplit("/", 1)[-1]
    rank = F.when(F.col("path") == wanted, 0).when(F.lower("path") == w, 1).when(F.endswith(F.lower("path"), F.lit("/" + w.lstrip("/"))), 2).when(F.lower(paths.basename(F.col("path"))) == name, 3)
    return files.withColumn("rank", rank).filter("rank is not null").orderBy("rank", "path").limit(1).drop("rank")


def delete_cascade(files: DataFrame, deps: DataFrame, symbols: DataFrame, calls: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Without the files of gone (file_id), their edges and calls on both sides and their symbols."""
    ids = gone.select("file_id").distinct()
    lost = symbols.join(ids, "file_id", "left_semi").select("id").distinct()
    anti = lambda df, c, keys, k: df.join(keys.select(F.col(k).alias(c)), c, "left_anti").select(df.columns)
    return anti(files, "file_id", ids, "file_id"), anti(anti(deps, "source_id", ids, "file_id"), "target_id", ids, "file_id"), anti(symbols, "file_id", ids, "file_id"), anti(anti(calls, "caller_symbol_id", lost, "id"), "callee_symbol_id", lost, "id")


def purge(files: DataFrame, deps: DataFrame, symbols: DataFrame, calls: DataFrame, predicate: Column) -> tuple[tuple[DataFrame, ...], DataFrame]:
    """The tables without files that the predicate matches, and counts of what went."""
    gone = files.filter(predicate).select("file_id")
    kept = delete_cascade(files, deps, symbols, calls, gone)
    counted = None
    for name, before, after in zip(("files", "dependencies", "symbols", "calls"), (files, deps, symbols, calls), kept, strict=True):
        one = before.agg(F.count("*").alias("b")).crossJoin(after.agg(F.count("*").alias("a"))).select((F.col("b") - F.col("a")).alias(name))
        counted = one if counted is None else counted.crossJoin(one)
    return kept, counted


def sample(files: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """n files at random, to see whether a store is fresh. Sampling is what this does; top-n keeps it to n rows a task."""
    return files.filter(~F.col("is_directory")).orderBy(F.rand(seed)).limit(n)


def put(table: DataFrame, key: str, value: str) -> DataFrame:
    """A key-value table (key, value) with one pair set."""
    return table.filter(F.col("key") != key).unionByName(table.sparkSession.createDataFrame([(key, value)], "key string, value string"))
