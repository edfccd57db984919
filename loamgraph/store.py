"""Tables of the engine: scratch tables in the cluster's shared folder, and a versioned store of named Parquet tables.

A store publishes several tables at once: each new version goes to a directory of its own, then one small manifest that names
the current versions is created under the next number. Manifests are never replaced or removed while they are current, so a reader
or a crash at any moment finds the last complete one; a second writer that took the same number meets its file and fails instead of
overwriting it. Readers resolve the manifest once per query and so see one consistent set. ``vacuum`` removes what old manifests name.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it; a fresh local folder where it is unset and everything runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loamgraph-"))
    return jsc.getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again; ends the lineage of loops."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/loamgraph/t-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Named tables under root, replaced together."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.root}/manifests")
        if not self._fs.exists(at):
            return []
        return sorted(int(x.getPath().getName()[:-5]) for x in self._fs.listStatus(at) if x.getPath().getName().endswith(".json"))

    def _manifest(self, number: int) -> dict[str, str]:
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{number:010d}.json", wholetext=True).first()[0])

    def manifest(self) -> dict[str, str]:
        found = self._numbers()
        return self._manifest(found[-1]) if found else {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.manifest()[name])

    def has(self, name: str) -> bool:
        return name in self.manifest()

    def exists(self, path: str) -> bool:
        return self.modified(path) is not None

    def modified(self, path: str) -> int | None:
        """A file's time in ms, in any file system; null if it isn't there."""
        at = self._path(path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getFileStatus(at).getModificationTime() if fs.exists(at) else None

    def publish(self, **tables: DataFrame) -> None:
        """Writes all tables, then switches readers to them at once. Tables that aren't named stay. Raises Conflict if another writer published meanwhile."""
        version = uuid.uuid4().hex[:12]
        found = self._numbers()
        number = found[-1] if found else 0
        paths = self._manifest(number) if found else {}
        for name, df in tables.items():
            paths[name] = f"{self.root}/{name}/v={version}"
            df.write.parquet(paths[name])
        # written whole under another name first: a manifest that has its name is complete
        temporary, final = self._path(f"{self.root}/.manifest-{version}"), self._path(f"{self.root}/manifests/{number + 1:010d}.json")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(paths).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            raise Conflict(f"version {number + 1} of {self.root} was published by another writer")

    def vacuum(self, keep: int = 2) -> int:
        """Removes tables and manifests that none of the last ``keep`` versions names; returns how many directories went."""
        found = self._numbers()
        live = {p for n in found[-keep:] for p in self._manifest(n).values()}
        gone = {p for n in found[:-keep] for p in self._manifest(n).values()} - live
        for p in gone:
            self._fs.delete(self._path(p), True)
        for n in found[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/{n:010d}.json"), False)
        return len(gone)


class Conflict(RuntimeError):
    """Two writers published at once; read again and repeat."""


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of old with the named columns taken from new where the key is in both, plus new's other rows; columns of old that aren't named stay, and are null for new keys."""
    names = old.columns
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in names], F.lit(True).alias("o_here"))
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in [key, *columns]], F.lit(True).alias("n_here"))
    both = o.join(n, F.col(f"o_{key}") == F.col(f"n_{key}"), "full_outer")

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(f"n_{key}", f"o_{key}")
        return F.when(F.col("n_here"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")) if c in columns else F.col(f"o_{c}")

    return both.select(*[value(c).alias(c) for c in names])


def replace_by_key(old: DataFrame, new: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """old without the rows whose key is in keys (by default the keys of new), plus new. A key without new rows is cleared."""
    gone = (keys if keys is not None else new).select(key).distinct()
    return old.join(gone, key, "left_anti").select(old.columns).unionByName(new.select(old.columns))
