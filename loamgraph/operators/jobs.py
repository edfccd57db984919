"""Jobs for a language model: which are due, their order, duplicates, payloads, results; token totals; log lines; metric rates."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .files import NO_CONCEPTS


def takes_concepts(path: Column) -> Column:
    return ~F.substring(F.lower(paths.extension(path)), 2, 32).isin(*NO_CONCEPTS)


def due(files: DataFrame) -> DataFrame:
    """(path, job_type, importance): stale or missing summaries and concepts, most important first."""
    kinds = F.array(F.when(F.col("summary").isNull() | F.col("summary_stale_since").isNotNull(), F.lit("summary")), F.when((F.col("concepts").isNull() | F.col("concepts_stale_since").isNotNull()) & takes_concepts(F.col("path")), F.lit("concepts")))
    return files.select("path", F.explode(F.array_compact(kinds)).alias("job_type"), "importance").orderBy(F.desc("importance"), "path", "job_type")


def latest(jobs: DataFrame) -> DataFrame:
    """The newest job of each (repo, path, job_type)."""
    return jobs.withColumn("rn", F.row_number().over(Window.partitionBy("repo", "path", "job_type").orderBy(F.desc("created_at"), F.desc("id")))).filter("rn = 1").drop("rn")


def ordered(jobs: DataFrame, n: int = 1000) -> DataFrame:
    """The next n jobs of the queue with their place: more important, then older, first. n is the queue's capacity."""
    first = jobs.orderBy(F.desc("importance"), "created_at", "id").limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "created_at", "id")))


def admitted(pending: DataFrame, new: DataFrame, capacity: int = 1000) -> DataFrame:
    """new jobs (id, repo, path, job_type, arrival) with reject: queue_full for those that come when the queue of pending jobs (repo, path, job_type)
    has ``capacity`` keys, even if they would replace one; null for the others. The key that fills the queue is found among first arrivals of
    keys that aren't pending, of which at most ``capacity`` are ordered."""
    key = ["repo", "path", "job_type"]
    room = max(0, capacity - pending.select(*key).distinct().count())
    if not room:
        return new.withColumn("reject", F.lit("queue_full"))
    fresh = new.join(pending.select(*key).distinct(), key, "left_anti").groupBy(*key).agg(F.min(F.struct("arrival", "id")).alias("first"))
    filled = fresh.orderBy("first").limit(room).agg(F.count("*").alias("n"), F.max("first").alias("last"))
    late = (F.col("n") == room) & (F.struct("arrival", "id") > F.col("last"))
    return new.crossJoin(F.broadcast(filled)).withColumn("reject", F.when(late, "queue_full")).drop("n", "last")


def without(jobs: DataFrame, closed: DataFrame) -> DataFrame:
    """Without the jobs of closed connections."""
    return jobs.join(closed, "connection", "left_anti")


def payload(header: Column, content: Column, most: int = 14 * 1024, mark: str = "\n... [truncated]") -> Column:
    """Header and content, the latter cut at so many characters with a mark."""
    return F.concat_ws("\n", header, F.when(F.char_length(content) > most, F.concat(F.substring(content, 1, most), F.lit(mark))).otherwise(content))


def tokens_by_repo(usage: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Totals per repo and what was added since a snapshot (repo, tokens), in which unknown repos count as 0."""
    total = usage.groupBy("repo").agg(F.sum("tokens").alias("total"))
    if before is None:
        return total
    return total.join(before.select("repo", F.col("tokens").alias("was")), "repo", "left").select("repo", "total", (F.col("total") - F.coalesce("was", F.lit(0))).alias("session"))


def ring(lines: DataFrame, n: int = 500) -> DataFrame:
    """The last n lines by time, oldest first."""
    return lines.orderBy(F.desc("ts"), F.desc("id")).limit(n).orderBy("ts", "id")


def parse_log(line: Column) -> Column:
    """[timestamp] [prefix] message, the prefix optional."""
    pat = r"^\[([^\]]+)\]\s*(?:\[([^\]]+)\]\s*)?(.*)$"
    return F.struct(F.regexp_extract(line, pat, 1).alias("timestamp"), F.regexp_extract(line, pat, 2).alias("prefix"), F.regexp_extract(line, pat, 3).alias("message"))


def clean_output(text: Column) -> Column:
    """A model's answer without thought blocks and code fences."""
    t = F.regexp_replace(text, r"(?is)<(think|thought)>.*?</\1>", "")
    t = F.regexp_replace(t, r"^\s*```[a-zA-Z]*\s*\n?", "")
    return F.trim(F.regexp_replace(t, r"\n?\s*```\s*$", ""))


def short_number(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def rates(samples: DataFrame) -> DataFrame:
    """(metric, ts, rate) of counters (metric, ts, value): increase per second between neighbours; a drop is a restart from 0."""
    w = Window.partitionBy("metric").orderBy("ts", "id")
    s = samples.withColumn("was", F.lag("value").over(w)).withColumn("at", F.lag("ts").over(w))
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 1e6
    up = F.when(F.col("value") >= F.col("was"), F.col("value") - F.col("was")).otherwise(F.col("value"))
    return s.filter("was is not null").withColumn("seconds", seconds).filter("seconds > 0").select("metric", "ts", "id", (up / F.col("seconds")).alias("rate"))


RESULT = "id long, repo string, path string, job_type string, value string, error string, created_at long"


def answer(jobs: DataFrame, model: Callable[[str, str], str], workers: int = 4, timeout: float | None = None) -> DataFrame:
    """jobs (id, repo, path, job_type, payload, created_at) answered by model(job_type, payload) where the rows are; an exception becomes the
    row's error and leaves its value null, so the file stays stale. workers: partitions, hence calls at once. timeout: seconds for one call,
    after which its row has an error; the call itself ends with its thread."""

    def call(kind: str, text: str) -> str:
        if timeout is None:
            return model(kind, text)
        out: queue.Queue = queue.Queue()

        def work() -> None:
            try:
                out.put((model(kind, text), None))
            except Exception as e:  # handed on below
                out.put((None, e))

        threading.Thread(target=work, daemon=True).start()
        try:
            value, error = out.get(timeout=timeout)
        except queue.Empty:
            raise TimeoutError(f"no answer in {timeout} s") from None
        if error is not None:
            raise error
        return value

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values, errors = [], []
            for kind, text in zip(pdf["job_type"], pdf["payload"], strict=True):
                try:
                    values.append(call(kind, text))
                    errors.append(None)
                except Exception as e:  # a model may fail in any way; the row tells how
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(value=values, error=errors)[["id", "repo", "path", "job_type", "value", "error", "created_at"]]

    return jobs.repartition(workers).mapInPandas(run, RESULT)


# What each kind of job asks for.
ASKS = {
    "summary": "Summarise the purpose of this file in two sentences.",
    "concepts": "List functions, classes, interfaces, exports and the purpose of this file as JSON.",
    "change_impact": "Judge riskLevel, affectedAreas, breakingChanges and a summary of this change as JSON.",
}


def prompt(job_type: Column, path: Column, content: Column, most: int = 64 * 1024) -> Column:
    ask = F.create_map(*[x for k, v in ASKS.items() for x in (F.lit(k), F.lit(v))])[job_type]
    return payload(F.concat(ask, F.lit("\nFile: "), path), content, most)


def diff_prompt(path: Column, diff: Column) -> Column:
    """The prompt about a change: its diff, cut at 16 KiB."""
    return prompt(F.lit("change_impact"), path, diff, 16 * 1024)


def snapshot_of(text: Column) -> Column:
    """A stored export snapshot; null where it can't be read."""
    return F.from_json(text, "filePath string, exports array<struct<name:string,kind:string,signature:string>>, imports array<string>, capturedAt long")
