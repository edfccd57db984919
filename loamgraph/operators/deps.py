"""Dependency edges: lookups, counts, per-file lists. Edges are rows (source_id, target_id, dependency_type, ...); only source to target is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local(deps: DataFrame) -> DataFrame:
    return deps.filter(F.col("dependency_type") == "local_import")


def packages(deps: DataFrame) -> DataFrame:
    return deps.filter(F.col("dependency_type") == "package_import")


def joined(ids: Column) -> Column:
    """Distinct ids in order, as text."""
    return F.array_join(F.transform(F.array_sort(F.collect_set(ids)), lambda x: x.cast("string")), ",")


def counts(deps: DataFrame) -> DataFrame:
    """(file_id, dependencies, packages, dependents) by edge rows, for files with any edge. One pass: each edge counts at both ends before the shuffle."""
    end = F.explode(
        F.array(
            F.struct(F.col("source_id").alias("file_id"), (F.col("dependency_type") == "local_import").cast("long").alias("d"), (F.col("dependency_type") == "package_import").cast("long").alias("p"), F.lit(0).cast("long").alias("i")),
            F.struct(F.col("target_id").alias("file_id"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("p"), F.lit(1).cast("long").alias("i")),
        )
    )
    return deps.select(end.alias("e")).groupBy("e.file_id").agg(F.sum("e.d").alias("dependencies"), F.sum("e.p").alias("packages"), F.sum("e.i").alias("dependents"))


def with_counts(files: DataFrame, deps: DataFrame) -> DataFrame:
    out = files.join(counts(deps), "file_id", "left")
    return out.fillna(0, ["dependencies", "packages", "dependents"])


def with_lists(files: DataFrame, deps: DataFrame) -> DataFrame:
    """Each file with its dependency, dependent and package ids as text: one aggregation per end, no lookup per file."""
    out = deps.groupBy(F.col("source_id").alias("file_id")).agg(joined(F.when(F.col("dependency_type") == "local_import", F.col("target_id"))).alias("deps"), joined(F.when(F.col("dependency_type") == "package_import", F.col("target_id"))).alias("packages"))
    into = deps.groupBy(F.col("target_id").alias("file_id")).agg(joined(F.col("source_id")).alias("dependents"))
    return files.join(out, "file_id", "left").join(into, "file_id", "left").fillna("", ["deps", "packages", "dependents"])


def reverse(deps: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, dependents): distinct sources of local edges whose target is a file."""
    edges = local(deps).select(F.col("target_id").alias("file_id"), "source_id").distinct()
    return edges.join(files.select("file_id"), "file_id", "left_semi").groupBy("file_id").agg(joined(F.col("source_id")).alias("dependents"))


def dependents_with_imports(deps: DataFrame) -> DataFrame:
    """Per target and source of local edges: distinct names sorted, lines sorted (nulls dropped, duplicates kept)."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.from_json("imported_names", "array<string>"), F.array().cast("array<string>"))))))
    return local(deps).groupBy("target_id", "source_id").agg(F.array_join(names, ",").alias("names"), F.array_join(F.transform(F.array_sort(F.collect_list("import_line")), lambda x: x.cast("string")), ",").alias("lines"))


def weights(deps: DataFrame) -> DataFrame:
    return local(deps).groupBy("source_id", "target_id", "edge_type").agg(F.sum("weight").alias("weight"))


def undirected(deps: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b; self edges dropped."""
    return local(deps).filter(F.col("source_id") != F.col("target_id")).groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.sum("weight").alias("weight"))


def zip_metadata(edges: DataFrame, imports: DataFrame) -> DataFrame:
    """The n-th import with a specifier belongs to the n-th edge of the file with it, in order of pos; edges without one keep nulls."""
    nth = F.row_number().over(Window.partitionBy("source_id", "specifier").orderBy("pos"))
    e = edges.withColumn("nth", nth)
    i = imports.withColumn("nth", nth).drop("pos")
    return e.join(i, ["source_id", "specifier", "nth"], "left")


def set_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source_id, added, removed): target ids in order, as text, for sources whose targets differ."""
    both = old.select("source_id", "target_id").distinct().withColumn("was", F.lit(True)).join(new.select("source_id", "target_id").distinct().withColumn("now", F.lit(True)), ["source_id", "target_id"], "full_outer")
    return both.filter("was is null or now is null").groupBy("source_id").agg(joined(F.when(F.col("was").isNull(), F.col("target_id"))).alias("added"), joined(F.when(F.col("now").isNull(), F.col("target_id"))).alias("removed"))
