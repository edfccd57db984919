"""Operator 4, benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised to lower-cased runs of letters and digits joined by single spaces. An item of
n characters may appear in a document with up to k = floor(error_rate * n) edits. It is split into k + 1
pieces; an occurrence with at most k edits leaves one piece untouched, so exact hits of pieces find every
candidate place. Each candidate window is verified by Myers' bit-parallel distance of the whole item against
the window (free start and end).

Scale: documents are never shuffled. Pieces of one block of items go to the executors inside the task closure;
blocks hold at most ``block_chars`` characters of items, counted before, and a larger benchmark takes more
passes over the documents, one per block. Documents stream through in bounded slices; a very long text is
searched whole.

Null or empty texts and items match nothing. Items shorter than 1 / error_rate characters must match exactly.
Repeated rows of documents or items give repeated results; rows come one per document row and matching item,
with the best place. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import in_batches, slices
from .common import stored

SCHEMA = "doc_id long, item_id long, distance int, start long, end long"
_GAPS = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _GAPS.sub(" ", (text or "").lower()).strip()


def pieces(item: str, error_rate: float) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length that cover the item."""
    k = int(len(item) * error_rate)
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """(least edit distance of item to any substring of text, end of the first such substring). Bit i stands for row i + 1 of the column."""
    m = len(item)
    masks = masks or peq(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, where = m, 0
    get = masks.get
    for j, ch in enumerate(text):
        eq = get(ch, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = down | (~(xh | up) & full)
        minus = up & xh
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        up = minus | (~(xv | plus) & full)
        down = plus & xv
        if score < best:
            best, where = score, j + 1
    return best, where


def peq(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(item):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


class Matcher:
    """Finds items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items, self.rate = items, error_rate
        self.masks: dict[int, dict[str, int]] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item) in enumerate(items):
            for at, piece in pieces(item, error_rate):
                where.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, of in where.items():
            self.automaton.add_word(piece, (len(piece), of))
        self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item's best place within its budget; start is where a window of the item's length would begin."""
        near: dict[int, list[tuple[int, int]]] = {}
        for end, (length, of) in self.automaton.iter(text):
            for n, at in of:
                item, k = self.items[n][1], int(len(self.items[n][1]) * self.rate)
                begin = end + 1 - length - at
                lo, hi = max(0, begin - k), min(len(text), begin + len(item) + k)
                spans = near.setdefault(n, [])
                if spans and lo <= spans[-1][1] and lo >= spans[-1][0]:
                    spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
                else:
                    spans.append((lo, hi))
        for n, spans in near.items():
            ident, item = self.items[n]
            masks = self.masks.setdefault(n, peq(item))
            best = None
            for lo, hi in spans:
                d, e = myers(item, text[lo:hi], masks)
                if best is None or d < best[0]:
                    best = (d, lo + e)
                if not d:
                    break
            if best and best[0] <= int(len(item) * self.rate):
                yield ident, best[0], max(0, best[1] - len(item)), best[1]


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Items by id, in blocks of bounded characters, each with whether more follow; only one block is held at a time."""
    block, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        item = normalise(r["text"])
        if not item:
            continue
        if block and held + len(item) > block_chars:
            yield block, True
            block, held = [], 0
        block.append((r["item_id"], item))
        held += len(item)
    if block:
        yield block, False


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05, block_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of every document row that holds an item; places are in the normalised text."""
    out = None
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    for block, more in blocks(benchmark, block_chars):

        def search(batches: Iterator[pa.RecordBatch], block: list[tuple[int, str]] = block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, error_rate)
            for batch in slices(batches, "text"):
                rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for hit in matcher.find(normalise(t))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        found = in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), search, SCHEMA)
        if out is not None or more:
            # more than one block: each one's result is written before the next one is read, so the driver and tasks hold one block only
            found = stored(found, "decontam")
        out = found if out is None else out.unionAll(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05, block_chars: int = 2_000_000) -> DataFrame:
    """The rows of docs, all columns, that hold no item. Nothing is shuffled."""
    for block, more in blocks(benchmark, block_chars):

        def keep(batches: Iterator[pa.RecordBatch], block: list[tuple[int, str]] = block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, error_rate)
            for b in slices(batches, "text"):
                yield b.filter(pa.array([not t or next(matcher.find(normalise(t)), None) is None for t in b.column("text").to_pylist()], pa.bool_()))

        docs = in_batches(docs, keep, docs.schema)
        if more:
            docs = stored(docs, "clean")
    return docs
