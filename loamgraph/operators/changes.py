"""Changes of files: semantic differences of exports, debounced events, their effect on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files as file_ops
from . import graph


def semantic_diff(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """Per file, version 1 against version 2 of exports (file_id, version, name, kind, signature) and imports (file_id, version, specifier):
    (file_id, change_type, affects_dependents, changed). No earlier version: unknown. Nothing differs: body-only. Imports alone differ, or an
    export that is no type or interface: exports-changed. Only types and interfaces: types-changed."""
    e = exports.groupBy("file_id", "name").agg(*[F.max(F.when(F.col("version") == v, F.struct("kind", "signature"))).alias(f"e{v}") for v in (1, 2)])
    e = e.filter(~F.col("e1").eqNullSafe(F.col("e2")))
    kind = F.coalesce("e2.kind", "e1.kind")
    changed = e.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("changed"), F.min(kind.isin("type", "interface")).alias("only_types"))
    i = imports.groupBy("file_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("version") == v, F.col("specifier")))).alias(f"i{v}") for v in (1, 2)])
    had = exports.select("file_id", "version").unionByName(imports.select("file_id", "version")).groupBy("file_id").agg(F.max(F.col("version") == 1).alias("before"), F.max(F.col("version") == 2).alias("after"))
    out = had.filter("after").join(changed, "file_id", "left").join(i, "file_id", "left")
    moved = ~F.col("i1").eqNullSafe(F.col("i2"))
    kind = F.when(~F.col("before"), "unknown").when(F.col("changed").isNull() & ~moved, "body-only").when(F.col("changed").isNull(), "exports-changed").when(F.col("only_types"), "types-changed").otherwise("exports-changed")
    return out.select("file_id", kind.alias("change_type"), (kind != "body-only").alias("affects_dependents"), F.when(F.col("before"), F.coalesce("changed", F.lit(""))).otherwise("").alias("changed"))


def debounced(changes: DataFrame, quiet: str = "2 seconds") -> DataFrame:
    """One row per (path, event_type) and burst: its end, size and last event. A burst ends after the quiet period."""
    g = changes.groupBy("path", "event_type", F.session_window("ts", quiet).alias("w"))
    return g.agg(F.count("*").alias("events"), F.max(F.struct("ts", "event_id")).alias("last")).select("path", "event_type", "events", F.col("last.ts").alias("last_ts"), F.col("last.event_id").alias("last_event_id"))


def last_events(changes: DataFrame) -> DataFrame:
    """The last event of each path."""
    return changes.groupBy("path").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l")).select("path", "l.event_type", "l.ts", "l.event_id")


def apply(files: DataFrame, deps: DataFrame, batch: DataFrame, ts: int, most: int = 10) -> DataFrame:
    """files after a batch (file_id, event_type, affects_dependents): what depends on a changed or removed file, as the edges stood
    before, becomes stale in all columns; a changed file that doesn't affect dependents in its own two; removed files go."""
    start = batch.filter("event_type = 'unlink' or (event_type = 'change' and affects_dependents)").select("file_id")
    reached = graph.cascade(deps, start, most).select("file_id").withColumn("hit", F.lit(True))
    own = batch.filter("event_type = 'change' and not affects_dependents").select("file_id").distinct().withColumn("own", F.lit(True))
    out = files.join(reached, "file_id", "left").join(own, "file_id", "left")
    out = file_ops.mark_stale(out, ts, F.coalesce("hit", F.lit(False)))
    out = file_ops.mark_stale(out, ts, F.coalesce("own", F.lit(False)), file_ops.STALE[:2])
    return out.drop("hit", "own").join(batch.filter("event_type = 'unlink'").select("file_id"), "file_id", "left_anti")
