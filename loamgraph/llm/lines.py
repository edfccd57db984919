"""Operator 6, line dedup by pairwise alignment.

Documents are ordered by doc_id (then by a digest of the text). A line is shared if more than one document holds it;
runs of lines are shared and first held in the same way. Lines that aren't blank and follow each other (over blank lines
too) are cut into windows: from each line, and up to each line, the shortest run of at least ``block_words`` words. A
document is paired with the first holders of its shared windows: one pair per holder, found by aggregation, never all
pairs of the documents that share a window, so a passage in a third of all documents makes as many pairs as it has
documents. Windows cover every line of a repeated passage of ``block_words`` words, however short its lines are, and the
first holder of a window holds all of it, so these pairs reach every repeated passage.

Each pair is aligned by patience diff over the sequences of shared lines (others can't match): lines that are unique in both
are matched along their longest common subsequence of positions, and matches grow over equal
neighbours. Runs of matched lines that are contiguous in both documents are common blocks; blocks of at least
``block_words`` words are deleted from the later document. What patience leaves (passages that occur twice, or in another
order) is looked up by windows of the earlier document, so a line is deleted exactly if it stands in a run of at least
``block_words`` words that an earlier document holds as well. The earlier keeps its text.

Hot lines, hot windows and the holders of hot passages are counted; they meet their rows by broadcast of at most a fixed number of keys, or
salted. A sequence is bounded by its document. Texts that lose nothing are never shuffled: a bit table of fixed size tells them in the scan. Lines are compared trimmed of white space at the ends. Null text counts as empty and stays null. Rows that repeat a
(doc_id, text) are one document: treated alike, and never compared with each other. A null doc_id comes first in the order.
A document of one line may lose all of its text, which becomes empty. Extra columns stay as they are; empty tables
give no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import in_batches, mix64
from .common import SPACE, KeyFilter, salted_join, split_join, stored

KEY = ("__loam_id", "__loam_h")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__loam_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("__loam_h", F.xxhash64(F.coalesce("text", F.lit(""))))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions (i, j) of two sequences, both ascending. Between matches the diff goes on with what is unique there."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and in_a.get(x) == 1}
        chain = _longest([(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if x in where])
        if not chain:
            continue
        at_a, at_b = a0, b0
        for i, j in [*chain, (a1, b1)]:
            todo.append((at_a, i, at_b, j))
            if i < a1:
                out.append((i, j))
            at_a, at_b = i + 1, j + 1
    return sorted(out)


def _longest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence ascending in both, of pairs ascending in the first."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        before.append(ends[k - 1] if k else -1)
        tops[k : k + 1] = [j]
        ends[k : k + 1] = [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def windows(place: np.ndarray, words: np.ndarray, doc: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last): the shortest runs of at least block_words words from each line and up to each line. Lines are those of documents one
    after another; a run holds lines of one document with places that follow each other."""
    n = len(place)
    run = np.cumsum(np.concatenate([[0], (np.diff(doc) != 0) | (np.diff(place) != 1)])[:n])
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    every = np.arange(n)
    to = np.searchsorted(total, total[:-1] + block_words) - 1
    since = np.searchsorted(total, total[1:] - block_words, side="right") - 1
    first, last = np.concatenate([every, since]), np.concatenate([to, every])
    ok = (first >= 0) & (last < n)
    ok[ok] = run[first[ok]] == run[last[ok]]
    first, last = np.unique(np.stack([first[ok], last[ok]]), axis=1)
    return first, last


def window_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the lines of each window, wherever the window stands."""
    h = np.full(len(first), np.uint64(0x9E3779B97F4A7C15))
    for k in range(int((last - first).max()) + 1 if len(first) else 0):
        on = first + k <= last
        h[on] = mix64(h[on] * np.uint64(0x100000001B3) + hashes[first[on] + k])
    return h


def common_blocks(later: list[tuple[int, int, int, int]], earlier: list[tuple[int, int, int, int]], block_words: int) -> list[int]:
    """Line numbers of the later document in common blocks; both lists hold (place among the lines that aren't blank, hash, words, line number) of shared lines."""
    matched = patience([x[1] for x in later], [x[1] for x in earlier])
    out: set[int] = set()
    block: list[int] = []
    words = 0
    last = None
    for i, j in [*matched, (None, None)]:
        here = (later[i][0], earlier[j][0]) if i is not None else None
        if last is None or here is None or here != (last[0] + 1, last[1] + 1):
            if words >= block_words:
                out.update(block)
            block, words = [], 0
        if i is not None:
            block.append(i)
            words += later[i][2]
        last = here
    if len(out) < len(later):
        known = {tuple(x[1] for x in earlier[a : b + 1]) for a, b in _windows(earlier, block_words)}
        for a, b in _windows(later, block_words):
            if tuple(x[1] for x in later[a : b + 1]) in known:
                out.update(range(a, b + 1))
    return [later[i][3] for i in sorted(out)]


def _windows(seq: list[tuple[int, int, int, int]], block_words: int) -> Iterator[tuple[int, int]]:
    place, words = (np.array([x[k] for x in seq], np.int64) for k in (0, 2))
    first, last = windows(place, words, np.zeros(len(seq), np.int64), block_words)
    return zip(first.tolist(), last.tolist(), strict=True)


def repeated_lines(docs: DataFrame, block_words: int = 20) -> DataFrame:
    """(__loam_id, __loam_h, __loam_cut): for documents that lose lines, their numbers (from 0), ascending. docs: (__loam_id, __loam_h, text)."""
    trimmed = F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("pos"), F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "").alias("line")))
    # blank lines match nothing; n counts the others, so that blocks may span blank lines
    lines = docs.select(*KEY, F.posexplode(F.filter(trimmed, lambda x: x["line"] != "")).alias("n", "x"))
    lines = lines.select(*KEY, "n", "x.pos", F.xxhash64("x.line").alias("hash"), F.regexp_count("x.line", F.lit(f"[^{SPACE}]+")).alias("words"))
    lines = stored(lines, "lines")
    doc = F.struct(*KEY)
    shared = stored(lines.groupBy("hash").agg(F.min(doc).alias("first"), F.max(doc).alias("last"), F.count("*").alias("of")).filter("first != last").select("hash", "of"), "shared")
    held = stored(split_join(lines, shared, "hash", "of", lines.count()), "held")
    sequences = stored(held.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("n", "hash", "words", "pos"))).alias("seq")), "sequences")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                seq = part.column("seq")
                n, h, w = (x.field(k).to_numpy() for x in [seq.flatten()] for k in range(3))
                doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(seq).to_numpy())
                first, last = windows(n, w, doc, block_words)
                known = window_hashes(h.astype(np.uint64), first, last).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(doc[first])) for k in KEY), pa.array(known)], names=[*KEY, "window"])

    # a shared window has shared lines only, so the sequences of shared lines hold them all
    runs = stored(in_batches(sequences, cut, "__loam_id long, __loam_h long, window long").distinct(), "windows")
    again = stored(runs.groupBy("window").agg(F.min(doc).alias("first"), F.max(doc).alias("last"), F.count("*").alias("of")).filter("first != last").select("window", "first", "of"), "again")
    pairs = split_join(runs, again, "window", "of", runs.count()).filter(doc != F.col("first")).select(*KEY, F.col("first.__loam_id").alias("e_id"), F.col("first.__loam_h").alias("e_h")).distinct()
    pairs = stored(pairs, "pairs")
    # the first holder of a hot passage is the earlier one of many pairs
    earlier = sequences.select(F.col("__loam_id").alias("e_id"), F.col("__loam_h").alias("e_h"), F.col("seq").alias("e_seq"))
    both = salted_join(pairs.join(sequences, [*KEY]), earlier, ["e_id", "e_h"], pairs)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cuts = [common_blocks(x, y, block_words) for x, y in zip(_rows(part.column("seq")), _rows(part.column("e_seq")), strict=True)]
                out = pa.RecordBatch.from_arrays([part.column("__loam_id"), part.column("__loam_h"), pa.array(cuts, pa.list_(pa.int32()))], names=["__loam_id", "__loam_h", "cut"])
                yield out.filter(pa.array([bool(c) for c in cuts], pa.bool_()))

    cuts = in_batches(both.select(*KEY, "seq", "e_seq"), align, "__loam_id long, __loam_h long, cut array<int>")
    # a document has at most two pairs for each of its shared lines, so its cuts are bounded by its own length squared
    return cuts.select(*KEY, F.explode("cut").alias("pos")).distinct().groupBy(*KEY).agg(F.array_sort(F.collect_list("pos")).alias("__loam_cut"))


def _rows(seq: pa.ListArray) -> list[list[tuple[int, int, int, int]]]:
    ends = seq.offsets.to_pylist()
    flat = seq.values
    rows = list(zip(*(flat.field(k).to_pylist() for k in range(4)), strict=True))
    return [rows[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def dedup_lines(docs: DataFrame, block_words: int = 20, counts: tuple[str, str, str] = ("n_lines", "n_cut", "share_left")) -> DataFrame:
    """The rows of docs with text shortened, plus three columns named by counts: lines, lines cut (both long) and the share of characters left
    (1 for an empty text). Columns of docs with those names are replaced, so name others where that matters."""
    rows = keyed(docs)
    cuts = stored(repeated_lines(rows.select(*KEY, "text"), block_words), "cuts")
    some = KeyFilter(cuts, F.xxhash64(*KEY), "cuts-filter").flagged(rows, F.xxhash64(*KEY), "__loam_some")
    # by shuffle at every size: whether the cuts would fit a broadcast depends on the input
    cut = some.filter("__loam_some").join(cuts.hint("merge"), [*KEY], "left")
    out = some.filter("not __loam_some").withColumn("__loam_cut", F.lit(None).cast("array<int>")).unionByName(cut)
    gone = F.coalesce("__loam_cut", F.array().cast("array<int>"))
    # both are in order, so what is left is put together from the ranges between cuts
    whole = _lines(F.col("text"))
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(whole)))
    left = F.flatten(F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: F.slice(whole, a + 2, b - a - 1)))
    lines, n_cut, share = counts
    short = F.when(F.col("__loam_cut").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    kept = F.when(F.coalesce(F.char_length("text"), F.lit(0)) == 0, 1.0).otherwise(F.char_length("__loam_text") / F.char_length("text"))
    out = out.withColumn("__loam_text", short).withColumns({lines: F.when(F.col("text").isNull(), 0).otherwise(F.size(whole)).cast("long"), n_cut: F.size(gone).cast("long"), share: kept})
    return out.withColumn("text", F.col("__loam_text")).drop(*KEY, "__loam_cut", "__loam_some", "__loam_text")
