"""Operator 10, toxicity by a factorisation machine over hashed terms.

A text's features are its distinct lower-cased words and their first 4 and 5 letters, hashed into ``2 ** bits`` columns. The model is
w0 + sum w_i + sum_{i<j} <v_i, v_j>, whose second part learns pairs such as an insult beside the mention of a
group; it is trained by Adagrad on logistic loss on the driver, from a sample of at most ``max_rows`` labelled
rows (in order of a digest of their ids), each reduced on the executors to its hashed terms, of which the sample
keeps rows until ``max_terms`` terms are reached. Those two parameters bound the driver's memory whatever the
input's size: terms come as bytes, four a term, are held once, and are counted and mapped a thousand rows at a time. Terms enter the model for what they tell alone or, like the mention of a group, only beside another. Scoring reads every whole text, in bounded slices, with the model in the task closure
(2 ** bits x (factors + 1) floats).

Null and empty texts have no terms and score sigmoid(w0). Repeated rows repeat. Labels with a null id or label are
ignored; without any usable label (or with one class only) every score is the share of label 1 seen, else 0.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import in_batches, mix64, slices, words
from .common import stored

SCHEMA = "doc_id long, score double"


#: Lengths of the word beginnings that are terms beside the words: inflected forms share them.
STEMS = (4, 5)


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, columns): distinct hashed terms of each text, ascending."""
    offsets, ids, stems = words(texts, STEMS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    both = np.unique(np.concatenate([(row << bits) | (mix64(x + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64) for k, x in enumerate((ids, *stems))]))
    return np.searchsorted(both, np.arange(len(offsets)) << bits), both & ((1 << bits) - 1)


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray
    bits: int

    def logits(self, offsets: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.w0)
        some = np.flatnonzero(np.diff(offsets))
        if len(some):
            at = offsets[some]
            v = self.v[cols].astype(np.float64)
            total = np.add.reduceat(v, at)
            out[some] += np.add.reduceat(self.w[cols].astype(np.float64), at) + 0.5 * (total**2 - np.add.reduceat(v * v, at)).sum(1)
        return out

    def scores(self, offsets: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(offsets, cols), -40, 40)))


#: Rows that fit and paired handle at once.
ROWS = 1000


def parts(offsets: np.ndarray, cols: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, row of each term from 0, columns) of ROWS rows at a time, so that nothing as long as all terms is made from them."""
    n = len(offsets) - 1
    for at in range(0, n, ROWS):
        end = min(n, at + ROWS)
        yield at, end, np.repeat(np.arange(end - at), np.diff(offsets[at : end + 1])), cols[offsets[at] : offsets[end]]


def paired(offsets: np.ndarray, cols: np.ndarray, labels: np.ndarray, seen: np.ndarray, toxic: np.ndarray, alone: np.ndarray, least_z: float, most: int) -> np.ndarray:
    """Columns that don't tell alone but do in a pair: rows with both columns have label 1 more or less often, by least_z deviations, than the
    two shares of label 1 add up to. All pairs of ``most`` columns are tested, a third of them the most telling ones, the rest the most varied."""
    n, share = len(labels), labels.mean()
    varied = seen * (n - seen).astype(float)
    telling = np.flatnonzero(alone)
    telling = telling[np.argsort(-varied[telling], kind="stable")[: most // 3]]
    others = np.flatnonzero(~alone & (seen >= 20))
    others = others[np.argsort(-varied[others], kind="stable")[: most - len(telling)]]
    if not len(others):
        return others
    some = np.concatenate([others, telling])
    to = np.full(len(seen), -1)
    to[some] = np.arange(len(some))
    both, hit = (np.zeros((len(others), len(some)), np.float32) for _ in range(2))
    for at, end, row, col in parts(offsets, cols):
        col = to[col]
        x = np.zeros((end - at, len(some)), np.float32)
        x[row[col >= 0], col[col >= 0]] = 1
        both += x[:, : len(others)].T @ x
        hit += x[:, : len(others)].T @ (x * labels[at:end, None].astype(np.float32))
    of = toxic[some] / np.maximum(seen[some], 1)
    most_z = np.zeros(len(others))
    for at in range(0, len(others), 100):
        end = min(len(others), at + 100)
        due = np.clip(of[at:end, None] + of[None, :] - share, 0.02, 0.98)
        z = np.abs(hit[at:end] - both[at:end] * due) / np.sqrt(both[at:end] * due * (1 - due) + 1)
        z[np.arange(end - at), np.arange(at, end)] = 0
        most_z[at:end] = z.max(1)
    return others[most_z >= least_z]


def fit(offsets: np.ndarray, cols: np.ndarray, labels: np.ndarray, bits: int = 18, factors: int = 8, epochs: int = 12, rate: float = 0.1, l2: float = 2e-3, l2_pairs: float = 2e-2, least_rows: int = 5, least_z: float = 4.0, least_pair_z: float = 9.0, pair_columns: int = 1500, least_steps: int = 2000, seed: int = 0) -> Machine:
    """Adagrad over shuffled batches of rows. A column takes part if it is seen in least_rows rows and tells by itself (its count in label 1
    deviates from chance by least_z) or in a pair (see paired): in long texts thousands of other terms would drown the telling ones."""
    size = 1 << bits
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Machine(40.0 if share == 1 else -40.0, np.zeros(size, np.float32), np.zeros((size, factors), np.float32), bits)
    rng = np.random.default_rng(seed)
    share = labels.mean()
    seen, toxic = np.zeros(size, np.int64), np.zeros(size)
    for at, end, row, col in parts(offsets, cols):
        seen += np.bincount(col, minlength=size)
        toxic += np.bincount(col, labels[at:end][row], size)
    z = (toxic - seen * share) / np.sqrt(seen * share * (1 - share) + 1)
    alone = (seen >= least_rows) & (np.abs(z) >= least_z)
    used = np.union1d(np.flatnonzero(alone), paired(offsets, cols, labels, seen, toxic, alone, least_pair_z, pair_columns))
    to = np.full(size, -1)
    to[used] = np.arange(len(used))
    kept, counts = [], []
    for at, end, row, col in parts(offsets, cols):
        col = to[col]
        kept.append(col[col >= 0].astype(np.int32))
        counts.append(np.bincount(row[col >= 0], minlength=end - at))
    cols, offsets = np.concatenate(kept), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    w0, w, v = float(np.log(share / (1 - share))), np.zeros(len(used)), rng.normal(0, 0.01, (len(used), factors))
    g0, gw, gv = 1e-8, np.full(len(used), 1e-8), np.full((len(used), factors), 1e-8)
    batches = max(1, len(labels) // 64)
    for _ in range(max(epochs, -(-least_steps // batches))):
        order = rng.permutation(len(labels))
        for batch in np.array_split(order, batches):
            n = offsets[batch + 1] - offsets[batch]
            at = np.concatenate([[0], np.cumsum(n)])
            flat = cols[np.repeat(offsets[batch] - at[:-1], n) + np.arange(at[-1])]
            r = np.repeat(np.arange(len(batch)), n)
            vs = v[flat]
            total = np.zeros((len(batch), factors))
            np.add.at(total, r, vs)
            sq = np.bincount(r, (vs * vs).sum(1), len(batch))
            z = w0 + np.bincount(r, w[flat], len(batch)) + 0.5 * ((total**2).sum(1) - sq)
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[batch]) / len(batch)
            here, inv = np.unique(flat, return_inverse=True)
            dw = np.bincount(inv, err[r], len(here)) + l2 * w[here] * np.bincount(inv, minlength=len(here)) / len(batch)
            dv = np.zeros((len(here), factors))
            np.add.at(dv, inv, err[r][:, None] * (total[r] - vs))
            dv += l2_pairs * v[here] * (np.bincount(inv, minlength=len(here)) / len(batch))[:, None]
            gw[here] += dw**2
            gv[here] += dv**2
            w[here] -= rate * dw / np.sqrt(gw[here])
            v[here] -= 0.2 * rate * dv / np.sqrt(gv[here])
            d0 = err.sum()
            g0 += d0**2
            w0 -= rate * d0 / np.sqrt(g0)
    full_w, full_v = np.zeros(size, np.float32), np.zeros((size, factors), np.float32)
    full_w[used], full_v[used] = w, v
    return Machine(w0, full_w, full_v, bits)


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 20_000, max_terms: int = 20_000_000, bits: int = 18, **how: float) -> Machine:
    """Fits on labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("_y"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "_y", "text")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            offsets, cols = features(b.column("text"), bits)
            cols = cols.astype("<i4")
            packed = [cols[x:y].tobytes() for x, y in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("_y").cast(pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "y", "terms"])

    # written first, since sorting reads its input twice; bytes, since an array's numbers would be objects in the driver's JVM and its Python
    made = stored(in_batches(rows, terms, "doc_id long, y int, terms binary"), "terms").orderBy(F.xxhash64("doc_id"), "doc_id", "y")
    ys, ends, cols = [], [0], bytearray()
    for r in made.select("y", "terms").toLocalIterator():
        if ends[-1] + len(r["terms"]) // 4 > max_terms:
            break
        cols += r["terms"]
        ys.append(r["y"])
        ends.append(len(cols) // 4)
    return fit(np.array(ends), np.frombuffer(cols, "<i4"), np.array(ys, float), bits, **how)


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(shared.value.scores(*features(b.column("text"), shared.value.bits)))], names=["doc_id", "score"])

    return in_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, **how: float) -> DataFrame:
    scored = score(docs, train(docs, labels, **how))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def reject(docs: DataFrame, model: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is under the threshold. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield b.filter(pa.array(shared.value.scores(*features(b.column("text"), shared.value.bits)) < threshold))

    return in_batches(docs, run, docs.schema)
