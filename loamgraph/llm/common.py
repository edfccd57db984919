"""What the operators of this subpackage share: table reads, scratch tables in the cluster's shared folder, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the size and span contracts name it.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a fresh local one where it names none (tests)."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jsc.isDefined():
            return jsc.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loamgraph-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/loamgraph/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts lineage, and outlives any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key that holds more than one in so many of all rows is hot; there are at most so many hot keys.
HOT = 2000


def split_join(rows: DataFrame, unique: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with unique, which has one row per key and in ``count`` how many of the ``total`` rows hold it; both are stored tables.

    Keys with more than total / HOT rows, at most HOT of them, meet their rows by broadcast, whatever their share; the others by shuffle, where
    no key is then large."""
    few = F.col(count) > max(1, total // HOT)
    hot, rest = F.broadcast(unique.filter(few)), unique.filter(~few)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest.hint("merge"), key, how))


def salted_join(rows: DataFrame, unique: DataFrame, keys: list[str], counted: DataFrame | None = None, salts: int = 64, least: int = 1000) -> DataFrame:
    """rows joined with unique, which has one row per keys, of any width. counted: a stored table with the same keys as rows, by default rows. Keys with more than total / HOT rows (and more
    than ``least``) are counted first: their row of unique is copied once per salt, and theirs of rows are dealt to the salts."""
    counted = rows if counted is None else counted
    limit = max(least, counted.count() // HOT)
    hot = F.broadcast(stored(counted.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > limit).select(*keys, F.lit(True).alias("__hot")), "hot"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*counted.columns), F.lit(salts))).otherwise(0)
    dealt = rows.join(hot, keys, "left").withColumn("__salt", salt.cast("int"))
    each = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    copied = unique.join(hot, keys, "left").withColumn("__salt", each).drop("__hot")
    return dealt.join(copied.hint("merge"), [*keys, "__salt"]).drop("__hot", "__salt")


#: Bits of a KeyFilter, whatever the input: 2 ** 19 words of 64 bits at most, 8 MB.
FILTER_BITS = 25


class KeyFilter:
    """A set of keys as a bit table of fixed size (a Bloom filter of one hash), to leave out of a scan most rows whose key isn't in it. Some others
    pass, all of them if there are far more keys than bits, so a join must follow where that matters."""

    def __init__(self, keys: DataFrame, key: Column, name: str, bits: int = FILTER_BITS):
        self.bits = bits
        words = keys.select(*self._place(key)).groupBy("__word").agg(F.expr("bit_or(shiftleft(1L, __bit))").alias("__bits"))
        self.words = stored(words, name)

    def _place(self, key: Column) -> tuple[Column, Column]:
        h = F.xxhash64(key)
        return F.shiftrightunsigned(h, 64 - self.bits + 6).alias("__word"), h.bitwiseAND(F.lit(63)).cast("int").alias("__bit")

    def flagged(self, rows: DataFrame, key: Column, flag: str) -> DataFrame:
        """rows with a column flag: false only if the key isn't in the set. Nothing is shuffled."""
        out = rows.select("*", *self._place(key)).join(F.broadcast(self.words), "__word", "left")
        return out.withColumn(flag, F.coalesce(F.expr("shiftright(__bits, __bit) & 1L = 1L"), F.lit(False))).drop("__word", "__bit", "__bits")

    def passed(self, rows: DataFrame, key: Column) -> DataFrame:
        return self.flagged(rows, key, "__in").filter("__in").drop("__in")


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint if the table has been counted to at most max_rows rows of bounded width; the plain table otherwise."""
    return F.broadcast(df) if df.count() <= max_rows else df


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def clear(spark: SparkSession) -> None:
    """Deletes all scratch tables in the shared folder. Results that still read them are lost, so write those first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/loamgraph")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
