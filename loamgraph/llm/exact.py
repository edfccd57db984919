"""Operator 5, exact dedup by a stateful stream.

The rows come as a stream. Its state is keyed by the SHA-256 of the normalised text (A-Z lower-cased), lives in
RocksDB on the executors' disks with its checkpoint in the shared folder, and never expires. For each digest it
holds the number of rows and, of the row to keep (the largest doc_id), the id and the content locator: the file
and the row's place in it. Rows meet the state through partial aggregation, so copies are counted where they are
read and a text that a third of all rows share reaches its state as one row per task and batch.

A digest seen more than once is a hit. Hits are checked on full bytes: their texts are joined with the text at the
locator and compared. A bit table of fixed size tells hits from most other rows in the scan, so other texts stay where they are. Rows of the same digest but other bytes (a collision) are grouped anew by their whole text.
Both joins are plain equi-joins, which adaptive execution splits where one digest is hot.

``dedup`` runs the stream to the end of what is there (availableNow) and returns every row's decision. A later run
with the same ``folder`` continues from its checkpoint: state and counts carry on over files that were added. What a run
writes besides state is in scratch tables of its own, so runs don't meet each other's.

Null text counts as empty; empty texts are equal to each other. A null doc_id is smaller than any other. Rows that
repeat with the same doc_id are all members; those with keep_id's doc_id are all kept. Extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, ascii_lower, scratch, stored, text_of

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # else every partition's store sets several MB aside, however little it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def locator() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def digest_bits(bits: int = 256):
    """The digest of a normalised text as hex, cut to so many bits (fewer only in tests of collisions)."""
    return lambda norm: F.substring(F.sha2(norm, 256), 1, bits // 4)


def _rows(raw: DataFrame, digest) -> DataFrame:
    norm = ascii_lower(text_of())
    return raw.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"), locator().alias("at")).withColumn("digest", digest(F.col("norm")))


def update_state(spark: SparkSession, path: str, folder: str, digest=None) -> None:
    """Streams the files at path through the state; appends each batch's changed keys to folder/changes."""
    old = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        raw = spark.readStream.schema(spark.read.parquet(path).select("doc_id", "text").schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, since a stream's plain path can't be one file
        seen = _rows(raw, digest or digest_bits()).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "at")).alias("keep"))

        def changes(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

        query = seen.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(changes).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dedup(spark: SparkSession, path: str, folder: str | None = None, digest=None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of the Parquet table at path (doc_id, text)."""
    digest = digest or digest_bits()
    folder = folder or scratch(spark, "exact")
    update_state(spark, path, folder, digest)
    # Counts only grow, so a key's last change is its largest.
    hits = spark.read.schema("digest string, n long, keep struct<doc_id:long,at:struct<file:string,row:long>>").parquet(f"{folder}/changes")
    hits = stored(hits.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("s")).filter("s.n > 1").select("digest", "s.n", "s.keep"), "exact-hits")
    # One scan writes ids, locators and digests of all rows, and texts of hits only; no other text is shuffled.
    rows = _rows(spark.read.parquet(path), digest).withColumn("text_sha256", F.sha2("norm", 256))
    rows = KeyFilter(hits, F.col("digest"), "exact-filter").flagged(rows, F.col("digest"), "hit")
    rows = stored(rows.withColumn("norm", F.when(F.col("hit"), F.col("norm"))), "exact-rows")
    # by shuffle at every size: whether the hits would fit a broadcast depends on the input
    tied = stored(rows.filter("hit").join(hits.hint("merge"), "digest", "left").withColumn("norm", F.when(F.col("n").isNotNull(), F.col("norm"))), "exact-tied")
    several = tied.filter("n is not null")
    keepers = several.filter(F.col("at") == F.col("keep.at")).select("digest", F.col("norm").alias("kept_norm"))
    same = F.col("norm") == F.col("kept_norm")
    checked = stored(several.join(keepers, "digest").select("doc_id", "digest", "n", F.col("keep.doc_id").alias("keep_id"), "text_sha256", same.alias("same"), F.when(~same, F.col("norm")).alias("norm")), "exact-checked")
    cols = ("doc_id", "keep_id", "group_size", "text_sha256")
    alone = rows.filter("not hit").select("doc_id", "text_sha256").unionByName(tied.filter("n is null").select("doc_id", "text_sha256"))
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    others = checked.filter("not same")
    if others.isEmpty():
        grouped = checked.select("doc_id", "keep_id", F.col("n").alias("group_size"), "text_sha256")
    else:
        fewer = others.groupBy("digest").agg(F.count("*").alias("other"))
        same = checked.filter("same").join(fewer, "digest", "left").select("doc_id", "keep_id", (F.col("n") - F.coalesce("other", F.lit(0))).alias("group_size"), "text_sha256")
        sizes = others.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
        grouped = same.unionByName(others.drop("keep_id").join(sizes, ["digest", "norm"]).select(*cols))
    return alone.unionByName(grouped).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
