"""Operator 9, near-duplicates by DartMinHash signatures and banded joining.

A text is the weighted set of its runs of five words, each weighing as often as it occurs; similarity is weighted
Jaccard, links are pairs of 0.8 or more, classes are connected components of links.

Signature: an element's weight axis is cut into regions, [0, 1) and then [1, 2), [2, 4), [4, 8) and so on, as far as its
weight reaches. Into each region darts are thrown, a Poisson process along the rank axis whose rate is the region's
width; a dart's hash gives its place in the region, and darts above the element's own weight miss. So an element of
weight w takes 1 + log2(w) regions, and the darts that two texts share are those under the lesser weight. Each
dart lands on one of k = bands x rows coordinates, and a coordinate keeps its earliest dart. A text of total weight W
needs darts only up to rank T / W (T = k ln k + 2k), so the cost is the number of regions plus T, not times k; if a
coordinate is still empty, the rank is doubled for that text. Two texts agree on a coordinate with probability equal to
their similarity. 20 bands of 6 rows meet a pair of similarity 0.8 with probability 0.998.

Candidates: texts with equal words are one node. In a band's bucket of up to ``whole`` nodes all pairs are
candidates. A larger bucket pairs each node with two centres, its least node in one fixed order and its hub
(the node with most neighbours over all bands), found by partial aggregation, so a bucket of n nodes makes at
most 2n pairs. If its nodes then belong to several classes, those outside its largest class (texts that share a common
passage, mostly) are compared exactly with all nodes of their large buckets, so every pair of two classes is, by prefix filtering: elements are ordered from rare to
common, and a pair of the wanted similarity must share one of the first n - ceil(0.8 n) + 1 of either. Pairs are
kept only if their exact similarity, over 64-bit hashes of elements, is 0.8 or more. Elements are made again from the texts of those
nodes that stand in a pair; nothing as wide as a text is written for the others.

Everything lives in tables: signatures, candidate pairs, links and labels are written to the shared folder, and no
group is ever collected in one task. Hot buckets, nodes and classes are counted and met by broadcast of at most a fixed number of keys, or salted.

A null or empty text, or one without letters and digits, has no elements and is a class of its own. A text of one to
four words is one element. Repeated rows are members of one class and stay or go together; rows that share a doc_id with other texts are
separate members, told apart by text_key. A null doc_id never names a class unless the class has no other. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import in_batches, mix64, shingles, slices, words
from .common import KeyFilter, salted_join, split_join, stored

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_REGION = np.uint64(0xD1B54A32D192ED03)


def elements(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, weight): the distinct shingles of each text, in order, and how often they occur."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, row))
    row, h = row[order], hashes[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def occurrences(row: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, id): the n-th occurrence of an element is an id of its own, so weighted sets become plain ones of the same similarity."""
    nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        return np.repeat(row, weight), mix64(np.repeat(element, weight) + nth.astype(np.uint64) * _GOLDEN)


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k array of dart ids for n texts, k up to 2048; texts without elements stay 0."""
    if k > 2048:
        raise ValueError("a dart's coordinate has 11 bits")
    sig, best = np.zeros(n * k, np.uint64), np.full(n * k, np.inf)
    total = np.bincount(row, weight, n)
    limit = np.zeros(n)
    limit[total > 0] = (k * math.log(k) + 2 * k) / total[total > 0]
    # regions of each element: the first is [0, 1), number j is [2 ** (j - 1), 2 ** j)
    regions = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    number = np.arange(regions.sum()) - np.repeat(np.cumsum(regions) - regions, regions)
    row, weight = np.repeat(row, regions), np.repeat(weight, regions)
    low = np.where(number > 0, 2.0 ** (number - 1), 0.0)
    width = np.maximum(low, 1.0)
    share = (weight - low) / width
    with np.errstate(over="ignore"):
        seed = mix64(np.repeat(element, regions) + number.astype(np.uint64) * _REGION)
    todo = total > 0
    while todo.any():
        live = todo[row]
        r, e, wide, part = row[live], seed[live], width[live], share[live]
        rank, i = np.zeros(len(r)), np.uint64(0)
        with np.errstate(over="ignore"):
            while len(r):
                i += np.uint64(1)
                dart = mix64(e + i * _GOLDEN)
                rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / wide
                inside = rank <= limit[r]
                r, e, wide, part, rank, dart = r[inside], e[inside], wide[inside], part[inside], rank[inside], dart[inside]
                # a dart's height in its region comes from a hash of its own; those above the element's weight miss
                hit = (part >= 1) | ((mix64(dart) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < part)
                # the low bits, which the rank doesn't use, give the coordinate
                at = (r * k + (((dart & np.uint64(0x7FF)) * np.uint64(k)) >> np.uint64(11)).astype(np.int64))[hit]
                # of darts that this step lands on one coordinate the earliest stays
                np.minimum.at(best, at, rank[hit])
                first = rank[hit] == best[at]
                sig[at[first]] = dart[hit][first]
        missing = np.isinf(best.reshape(n, k)).any(1) & todo
        best.reshape(n, k)[missing] = np.inf
        limit[missing] *= 2
        todo = missing
    return sig.reshape(n, k)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """n x bands keys; a key also tells its band."""
    rows = sig.shape[1] // bands
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = mix64(key * np.uint64(0x100000001B3) + sig[:, i::rows][:, :bands])
    return key.view(np.int64)


def _node(ids: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(ids.tobytes())


SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.binary()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))])


def signed(docs: DataFrame, bands: int, rows: int, shingle: int) -> DataFrame:
    """(doc_id, text_key, node, n, keys) of each row of docs (doc_id, text_key, text); node is null and keys are of no use for a text without elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 19):
            offsets, ids = words(b.column("text"))
            row, element, weight = elements(*shingles(offsets, ids, shingle))
            keys = band_keys(signatures(row, element, weight, b.num_rows, bands * rows), bands)
            n = np.bincount(row, weight, b.num_rows).astype(np.int32)
            node = [_node(ids[offsets[i] : offsets[i + 1]]) if x else None for i, x in enumerate(n)]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(node, pa.binary()), pa.array(n), listed], schema=SIGNED)

    return in_batches(docs, run, "doc_id long, text_key long, node binary, n int, keys array<long>")


def elements_of(docs: DataFrame, one: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, elements) of the wanted nodes: their elements' sorted 64-bit hashes, made again from the row that stands for each in one (node, doc_id)."""
    ids = stored(one.join(wanted, "node", "left_semi"), "wanted")
    rows = KeyFilter(ids, F.col("doc_id"), "wanted-filter").passed(docs, F.col("doc_id")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 19):
            offsets, ids = words(b.column("text"))
            row, element = occurrences(*elements(*shingles(offsets, ids, shingle)))
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            full = np.flatnonzero(np.diff(ends))
            node = [_node(ids[offsets[i] : offsets[i + 1]]) for i in full]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array([np.unique(element[ends[i] : ends[i + 1]]).tobytes() for i in full], pa.binary())], names=["node", "elements"])

    found = in_batches(rows, run, "node binary, elements binary").join(ids.select("node"), "node", "left_semi")
    return stored(found.groupBy("node").agg(F.first("elements").alias("elements")), "elements")


def linked(pairs: DataFrame, elements: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs whose similarity is at least least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ea", 2 << 20):
            ok = []
            for x, y in zip(b.column("ea"), b.column("eb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs
    for end in "ab":
        both = salted_join(both, elements.select(F.col("node").alias(end), F.col("elements").alias(f"e{end}")), [end], pairs)
    return in_batches(both.select("a", "b", "ea", "eb"), run, "a binary, b binary")


def pairs_of(buckets: DataFrame, least: float, whole: int) -> tuple[DataFrame, DataFrame]:
    """Of buckets (key, node, n), a stored table: candidate pairs (a, b), and for each node of a large bucket its two centres (key, node, n, size, least, hub)."""
    order = F.struct(F.xxhash64("node").alias("h"), "node", "n")
    sizes = stored(buckets.groupBy("key").agg(F.count("*").alias("size"), F.min(order).alias("least")).filter("size > 1"), "sizes")
    joined = stored(split_join(buckets, sizes, "key", "size", buckets.count()), "buckets")
    few = joined.filter(F.col("size") <= whole).select("key", "node", "n")
    near = F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9
    all_pairs = few.join(few.select("key", F.col("node").alias("other"), F.col("n").alias("m")), "key").filter((F.col("node") < F.col("other")) & near).select(F.col("node").alias("a"), F.col("other").alias("b"))
    many = joined.filter(F.col("size") > whole)
    # A hub shares most buckets with most nodes.
    weight = many.groupBy("node").agg(F.sum("size").alias("w"))
    hub = stored(many.join(weight, "node").groupBy("key").agg(F.max(F.struct("w", "node", "n")).alias("hub"), F.count("*").alias("of")), "hubs")
    many = split_join(many, hub, "key", "of", buckets.count())
    many = stored(many.select("key", "node", "n", "size", F.struct("least.node", "least.n").alias("least"), F.struct("hub.node", "hub.n").alias("hub")), "centres")
    stars = many.select("node", "n", F.explode(F.array("least", "hub")).alias("c")).select("node", "n", F.col("c.node").alias("other"), F.col("c.n").alias("m"))
    stars = stars.filter((F.col("node") != F.col("other")) & near).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    return all_pairs.unionByName(stars).distinct(), many


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, by passing least labels along links and jumping to labels' labels."""
    edges = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    n_edges = edges.count()
    labels = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"), "links")
    labels = stored(labels, "labels")
    n_nodes = labels.count()
    while True:
        heard = split_join(edges, labels.withColumnRenamed("node", "v"), "v", "links", n_edges).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        nearer = stored(labels.join(heard, "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"), "links"), "nearer")
        if nearer.filter("label < old").isEmpty():
            return labels.select("node", "label")
        # labels that have a lesser label themselves, with how many nodes have them
        moved = nearer.filter("label < node").select(F.col("node").alias("label"), F.col("label").alias("next"))
        jump = stored(nearer.groupBy("label").agg(F.count("*").alias("size")).join(moved, "label"), "jump")
        labels = split_join(nearer.drop("old"), jump, "label", "size", n_nodes, "left")
        labels = stored(labels.select("node", F.coalesce("next", "label").alias("label"), "links"), "labels")


def unlinked(many: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node) of large buckets whose node is outside the bucket's largest class. Of two nodes in different classes one is here at least."""
    own = stored(many.select("key", "node", "size").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("own")), "own")
    sizes = own.groupBy("key", "own").agg(F.count("*").alias("size"))
    largest = stored(sizes.groupBy("key").agg(F.max(F.struct("size", "own")).alias("x"), F.sum("size").alias("of")).select("key", F.col("x.own").alias("largest"), "of"), "largest")
    return split_join(own, largest, "key", "of", own.count()).filter("own != largest").select("key", "node")


#: Counters of how common elements are.
SLOTS = 1 << 20


def _slot(elements: np.ndarray) -> np.ndarray:
    return (mix64(elements) >> np.uint64(44)).astype(np.int64)


def prefix_pairs(nodes: DataFrame, asked: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of an asked node and any of nodes (node, elements) that may reach the similarity and aren't in one class yet. Exact:
    of the elements two similar texts share, the rarest stands so early in both that enough can follow."""

    spark = nodes.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for x in b.column("elements"):
                np.add.at(total, _slot(np.frombuffer(x.as_buffer(), np.uint64)), 1)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 10_000):
            part = some[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["slot", "df"])

    # How common elements are is counted by slot: a table of fixed size, whatever the input. Slots that several elements share only
    # change the order of elements, and any one order is exact.
    sketch = np.zeros(SLOTS, np.int64)
    for r in in_batches(nodes.select("elements"), count, "slot int, df long").groupBy("slot").agg(F.sum("df").alias("df")).toLocalIterator():
        sketch[r["slot"]] = r["df"]
    common = spark.sparkContext.broadcast(sketch)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "elements"):
            at, n, element, rank = [], [], [], []
            for i, x in enumerate(b.column("elements")):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                df = common.value[_slot(own)]
                order = np.lexsort((own, df))[: len(own) - math.ceil(len(own) * least - 1e-9) + 1]
                # an element of one node only is in no pair, but fills the node's prefix
                keep = df[order] > 1
                at.append(np.full(keep.sum(), i))
                n.append(np.full(keep.sum(), len(own)))
                element.append(own[order][keep].view(np.int64))
                rank.append(np.flatnonzero(keep) + 1)
            at = np.concatenate(at)
            yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(at)), pa.array(np.concatenate(n), pa.int32()), pa.array(np.concatenate(element), pa.int64()), pa.array(np.concatenate(rank), pa.int32())], names=["node", "n", "element", "rank"])

    prefix = in_batches(nodes.select("node", "elements"), first, "node binary, n int, element long, rank int").join(labels, "node", "left")
    prefix = stored(prefix.select("node", "n", "element", "rank", F.coalesce("label", "node").alias("label")), "prefix")
    left = prefix.join(asked, "node", "left_semi").select("element", F.col("node").alias("x"), F.col("n").alias("m"), F.col("rank").alias("place"), F.col("label").alias("of"))
    shared = F.ceil((F.col("n") + F.col("m")) * (least / (1 + least)) - 1e-9)
    follows = 1 + F.least(F.col("n") - F.col("rank"), F.col("m") - F.col("place")) >= shared
    both = left.join(prefix, (left["element"] == prefix["element"]) & (F.col("of") != F.col("label")) & (F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9) & follows)
    return both.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = 20, rows: int = 6, shingle: int = 5, whole: int = 8) -> DataFrame:
    """(doc_id, text_key, class_id, class_size, kept) for each row of docs (doc_id, text): class_id is the least doc_id of the class; text_key, a
    digest of the text, tells rows with one doc_id apart; of the rows of a class those are kept that have its least (doc_id, text_key)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    table = stored(signed(docs, bands, rows, shingle), "signed")
    texts = table.filter("node is not null")
    one = stored(texts.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")
    buckets = stored(one.select("node", "n", F.explode("keys").alias("key")), "keys")
    pairs, many = pairs_of(buckets, least, whole)
    pairs = stored(pairs, "pairs")
    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = stored(linked(pairs, elements_of(docs, one.select("node", "doc_id"), ends(pairs), shingle), least), "links")
    labels = components(links)
    rest = stored(unlinked(many, labels), "rest")
    if not rest.isEmpty():
        wide = many.join(rest.select("key").distinct(), "key", "left_semi").select("node").distinct()
        wide = elements_of(docs, one.select("node", "doc_id"), wide, shingle)
        more = stored(prefix_pairs(wide, rest.select("node").distinct(), labels, least).join(pairs, ["a", "b"], "left_anti"), "more")
        found = stored(linked(more, wide, least), "found")
        if not found.isEmpty():
            labels = components(links.unionByName(found))
    member = stored(table.select("doc_id", "text_key", "node").join(labels, "node", "left").select("doc_id", "text_key", F.coalesce("label", "node").alias("label")), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    classes = stored(member.filter("label is not null").groupBy("label").agg(first, F.count("*").alias("class_size")).filter("class_size > 1"), "classes")
    out = split_join(member, classes, "label", "class_size", member.count(), "left")
    alone = F.col("class_size").isNull()
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    return out.select("doc_id", "text_key", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), kept.alias("kept"))


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
