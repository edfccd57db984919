"""Operator 2, mixing sources to target weights, native.

Targets: each source has a weight; the budget (by default all sizes) is shared by weight, a source stops
at ``max_epochs`` times its own size and the excess is reshared among the rest. The capped sources are a
prefix of the sources in order of cap / weight, so one pass over that order gives the fixed point.

Order: Efraimidis-Spirakis keys -ln(u) / quality, u from a digest of the id, so reruns agree. Complete
epochs come first; then a prefix of the source in key order, up to the remaining budget, is taken once more.

Scale: no source is ever sorted in one task. Keys fall into ``buckets`` ranges a source, one for every 20,000 rows of all; bucket sums are
prefix-summed, whole buckets below the cut are taken, and only the one bucket of each source that holds
the cut is ordered row by row. The ranges suit sources of any quality, so a source of poor documents doesn't end in one of them. Texts are read once; all later passes see (id, size, source, key).

Null text: size 0. Null source: a source of its own, last. Empty table: no rows. Sizes of 0: targets 0,
nothing taken. A null id draws by the text's digest. Ties in key fall to id, then size; rows equal in all three are interchangeable. Extra
columns are ignored: the operator returns one row per row it was given, with the columns that ``mix`` names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, small, stored, text_of

#: Sources up to this number are broadcast as one row each.
BROADCAST_SOURCES = 20_000
#: Buckets are made for about so many rows; one bucket of each source is sorted.
ROWS_PER_BUCKET = 20_000
#: But at least so many buckets.
LEAST_BUCKETS = 1024


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


def quality(text: Column) -> Column:
    """Share of characters that are not symbols of markup or noise, at least 0.05; 1 for an empty text."""
    n = F.char_length(text)
    kept = F.char_length(F.translate(text, "#$%&*@{}[]<>|^~=_", ""))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), kept.cast("double") / n))


def uniform(ident: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of a digest of the id."""
    h = F.conv(F.substring(F.md5(F.concat(ident.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 13), 16, 10)
    return (h.cast("double") + 0.5) / F.lit(float(2**52))


def spread(key: Column) -> Column:
    """In [0, 1], rising with the key. Keys of documents of quality q are exponential of rate q, so 1 - exp(-q key) would spread them evenly; the
    mean over several rates gives those of any quality a fifth of the range or nearly so."""
    rates = (1.0, 0.5, 0.25, 0.125, 0.0625)
    return sum((1 - F.exp(-key * r) for r in rates[1:]), 1 - F.exp(-key * rates[0])) / len(rates)


def targets(sizes: DataFrame, max_epochs: int = 3, budget: float | None = None, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source of (source, source_size): adds weight and target. One row a source, so its windows are over a summary."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    every = Window.partitionBy()
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    df = sizes.withColumn("weight", w)
    df = df.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    total = F.lit(float(budget)) if budget is not None else F.sum("source_size").over(every).cast("double")
    df = df.withColumn("rest", total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    df = df.withColumn("share", F.col("rest") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # Ratios rise along the order, so capped sources come first; the first one that isn't sets everyone's share.
    level = F.min(F.when(F.col("ratio") > F.col("share"), F.struct("ratio", "share"))).over(every)["share"]
    df = df.withColumn("level", level)
    return df.select("source", "source_size", "weight", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, max_epochs: int = 3, budget: float | None = None, weights: tuple[int, ...] = (1, 2, 3), seed: int = 0, buckets: int | None = None) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) for each row of docs (doc_id, source, text)."""
    t = text_of()
    # rows without an id draw by their text
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(t.cast("binary"))))
    rows = docs.select("doc_id", "source", words(t).alias("size"), (-F.log(uniform(ident, seed)) / quality(t)).alias("key"))
    rows = stored(rows, "mix")
    buckets = buckets or max(LEAST_BUCKETS, rows.count() // ROWS_PER_BUCKET)
    rows = rows.withColumn("bucket", F.least(F.floor(spread(F.col("key")) * buckets), F.lit(buckets - 1)).cast("long"))
    sums = stored(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "mix-buckets")
    plan = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), max_epochs, budget, weights)
    size = F.col("source_size")
    plan = plan.withColumn("epochs", F.when(size > 0, F.least(F.floor(F.col("target") / size + 1e-9), F.lit(max_epochs))).otherwise(0).cast("long"))
    plan = plan.withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * size))
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("below", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    cut = cut.join(plan.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
    cut = cut.filter(F.col("below") <= F.col("left")).groupBy("source").agg(F.max(F.struct("bucket", "below")).alias("cut")).select(F.col("source").alias("c"), "cut.*")
    plan = plan.join(cut.withColumnRenamed("bucket", "cut"), F.col("source").eqNullSafe(F.col("c")), "left").drop("c").withColumnRenamed("source", "s")
    plan = small(stored(plan, "mix-plan"), BROADCAST_SOURCES)
    df = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = df.filter(F.col("bucket") != F.col("cut")).withColumn("once", F.col("bucket") < F.col("cut"))
    run = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = df.filter(F.col("bucket") == F.col("cut")).withColumn("at", F.col("below") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    # The row that crosses the budget is taken if most of it fits.
    edge = edge.withColumn("once", F.col("at") + F.col("size") / 2 <= F.col("left")).drop("at")
    out = whole.unionByName(edge)
    once = F.col("once") & (F.col("epochs") < max_epochs) & (F.col("left") > 0)
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * (F.col("epochs") + F.when(once, 1).otherwise(0))).cast("long").alias("taken"))
