"""A training corpus from the documents table: toxic documents go, repeated lines go, near copies go, documents that hold
benchmark items go, and what is left is mixed by source.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; the last one row per document with the words the mix takes.
Repeated rows stand or fall together; null texts are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm import decontam, lines, minhash, mixing, toxicity
from loamgraph.llm.common import KeyFilter, stored, table


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents whose score is 0.5 or more go."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


#: A document of which line dedup leaves less than this share of its characters goes: the rest stands in earlier documents, and what is left is a fragment.
LEAST_LEFT = 0.2
_COUNTS = ("__loam_lines", "__loam_gone", "__loam_share")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: common blocks go from later documents; a document that loses all of its text, or more than four fifths of it, goes."""
    left = lines.dedup_lines(docs, counts=_COUNTS)
    cut = F.col(_COUNTS[1]) > 0
    out = left.filter(~cut | ((F.col(_COUNTS[2]) >= LEAST_LEFT) & F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    return out.withColumn("n_chars", F.when(cut, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each class the document with the least doc_id stays (of its texts, if several share that id, one)."""
    gone = minhash.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("__loam_id"), F.col("text_key").alias("__loam_key")).distinct()
    gone = stored(gone, "gone")
    # most rows that stay are told in the scan; only the others are shuffled
    key = F.xxhash64("doc_id", minhash.text_key())
    some = KeyFilter(gone, F.xxhash64("__loam_id", "__loam_key"), "gone-filter").flagged(docs, key, "__loam_some")
    rows = some.withColumn("__loam_text", minhash.text_key())
    found = rows["doc_id"].cast("long").eqNullSafe(F.col("__loam_id")) & (rows["__loam_text"] == F.col("__loam_key"))
    left = rows.filter("__loam_some").join(gone.hint("merge"), found, "left_anti")
    return rows.filter("not __loam_some").unionByName(left).select(docs.columns)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: (doc_id, source, size, source_size, target, taken)."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", toxic_documents),
    ("line dedup", repeated_lines),
    ("near-dedup", near_copies),
    ("decontamination", benchmark_items),
    ("mixing", source_mix),
]

#: Training, alignment and similarity can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
