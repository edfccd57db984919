"""Streaming twins of the change and job operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import changes


def debounced(stream: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """One row per burst once the watermark has passed it. Later events than the watermark are dropped here; a comparison with the disk heals
    what they would have told. Bursts that are open at the end come out when a later event (a sentinel) moves the watermark."""
    ts = F.col("ts").cast("timestamp")  # a watermark needs a time zone
    return changes.debounced(stream.withColumn("ts", ts).withWatermark("ts", late), quiet)


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs apply on every batch in order; the batch number makes repeated batches recognisable. All input there is, then stops."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def latest_jobs(stream: DataFrame) -> DataFrame:
    """The newest job of each (repo, path, job_type), kept by state: a later job replaces an earlier one, also one that arrives out of order."""
    return stream.groupBy("repo", "path", "job_type").agg(F.max(F.struct("created_at", "id", "importance")).alias("j")).select("repo", "path", "job_type", "j.*")


def token_totals(stream: DataFrame) -> DataFrame:
    return stream.groupBy("repo").agg(F.sum("tokens").alias("total"))


def snapshots(stream: DataFrame) -> DataFrame:
    """(path, changed): for each version of a file's export digest in a stream (path, ts, digest), whether it differs from the one before it."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values("ts")
        out = []
        for digest in rows["digest"]:
            out.append((key[0], "unknown" if before is None else "changed" if digest != before else "body-only"))
            before = digest
        state.update((before,))
        yield pd.DataFrame(out, columns=["path", "changed"])

    return stream.groupBy("path").applyInPandasWithState(step, "path string, changed string", "digest string", "append", GroupStateTimeout.NoTimeout)
