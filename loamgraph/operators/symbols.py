"""Symbols and calls: name lookups, callers and callees, resolution of call sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(n: int | None, default: int = 50, most: int = 500) -> int:
    return max(1, min(most, default if n is None else n))


def name_matches(name: Column, wanted: str) -> Column:
    """A trailing * makes a prefix; other characters, an inner * too, are literal."""
    return F.startswith(name, F.lit(wanted[:-1])) if wanted.endswith("*") else name == wanted


def find(symbols: DataFrame, files: DataFrame, wanted: str, kind: str | None = None, exported_only: bool = False, n: int | None = None) -> DataFrame:
    """Matches with their path and the total before the limit; exported ones first, then by path and line."""
    hit = name_matches(F.col("name"), wanted)
    hit = hit & (F.col("kind") == kind) if kind else hit
    hit = hit & F.col("is_export") if exported_only else hit
    rows = symbols.filter(hit)
    total = rows.agg(F.count("*").alias("total"))
    rows = rows.join(files.select("file_id", "path"), "file_id")
    return rows.orderBy(F.desc("is_export"), "path", "start_line", "id").limit(clamp(n)).crossJoin(F.broadcast(total))


def _side(calls: DataFrame, symbols: DataFrame, files: DataFrame, name: str, file_id: int | None, n: int | None, near: str, far: str) -> DataFrame:
    targets = symbols.filter((F.col("name") == name) & (F.lit(True) if file_id is None else F.col("file_id") == file_id)).select(F.col("id").alias(near)).distinct()
    edges = calls.join(targets, near, "left_semi").filter(F.col(near) != F.col(far))
    known = symbols.select(F.col("id").alias(far), F.col("name").alias("symbol"), "kind", "file_id", "start_line")
    counts = edges.agg(F.count("*").alias("total")).crossJoin(edges.join(known.select(far), far, "left_anti").agg(F.count("*").alias("unresolved")))
    rows = edges.join(known, far).join(files.select("file_id", "path"), "file_id")
    rows = rows.select("path", "symbol", "kind", "start_line", "call_line", "confidence", F.col("id").alias("call_id"))
    # counts come even if no row does
    return counts.crossJoin(targets.agg((F.count("*") > 0).alias("known"))).join(rows.orderBy("path", "start_line", "call_id").limit(clamp(n)), F.lit(True), "left").withColumn("warning", F.when(F.col("known") & (F.col("total") == 0), "no call edges are known for this symbol")).drop("known")


def callers(calls: DataFrame, symbols: DataFrame, files: DataFrame, name: str, file_id: int | None = None, n: int | None = None) -> DataFrame:
    """Callers of the symbols of that name, recursion left out; total counts edges before the limit, dangling ones too."""
    return _side(calls, symbols, files, name, file_id, n, "callee_symbol_id", "caller_symbol_id")


def callees(calls: DataFrame, symbols: DataFrame, files: DataFrame, name: str, file_id: int | None = None, n: int | None = None) -> DataFrame:
    return _side(calls, symbols, files, name, file_id, n, "caller_symbol_id", "callee_symbol_id")


def unresolved(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls whose caller or callee is no symbol."""
    ids = symbols.select("id").distinct()
    side = lambda c: calls.join(ids.select(F.col("id").alias(c)), c, "left_anti").agg(F.count("*").alias(f"unresolved_{c.split('_')[0]}s"))
    return side("caller_symbol_id").crossJoin(side("callee_symbol_id"))


def resolve_calls(sites: DataFrame, symbols: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """sites (file_id, caller_symbol_id, callee_name, call_line) to call edges with confidence: a symbol of the same file (1.0; the first by line
    of equal names), else an imported name (0.8) that exactly one imported file declares; the rest is dropped.
    imports: (file_id, target_id, imported_name). Index files, * and default imports don't resolve."""
    first = Window.partitionBy("file_id", "name").orderBy("start_line", "id")
    own = symbols.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("file_id", F.col("name").alias("callee_name"), F.col("id").alias("own_id"))
    barrel = files.filter(F.col("path").rlike(r"(^|/)index\.(ts|tsx|js|mjs|cjs|jsx)$")).select(F.col("file_id").alias("target_id"))
    usable = imports.filter(~F.col("imported_name").isin("*", "default")).join(barrel, "target_id", "left_anti").select("file_id", "target_id", F.col("imported_name").alias("callee_name")).distinct()
    declared = own.select(F.col("file_id").alias("target_id"), "callee_name", F.col("own_id").alias("far_id"))
    far = usable.join(declared, ["target_id", "callee_name"]).groupBy("file_id", "callee_name").agg(F.count("*").alias("n"), F.first("far_id").alias("far_id")).filter("n = 1").drop("n")
    out = sites.join(own, ["file_id", "callee_name"], "left").join(far, ["file_id", "callee_name"], "left")
    return out.select("caller_symbol_id", F.coalesce("own_id", "far_id").alias("callee_symbol_id"), "call_line", F.when(F.col("own_id").isNotNull(), 1.0).otherwise(0.8).alias("confidence")).filter("callee_symbol_id is not null")
