"""Operators 6, 7, 9, 10 and the pipeline against brute force."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamgraph.llm import arrow, lines, minhash, toxicity, warc
from loamgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# 6

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(400)]


def line(n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_patience_diff():
    assert lines.patience([1, 2, 3, 4, 5], [1, 3, 4, 9, 5]) == [(0, 0), (2, 1), (3, 2), (4, 4)]
    assert lines.patience([1, 1, 1], [1, 1]) == [(0, 0), (1, 1)]
    assert lines.patience([], [1]) == []
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        got = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_line_dedup(spark):
    passage = [line(), line(), line(2), line(15)]
    boiler = line(6)
    d1 = [line(), *passage, line(), boiler]
    d2 = [line(), boiler, "", *passage[:2], "", *passage[2:], line()]
    d3 = [boiler, line(), line()]
    docs = [(1, d1), (2, d2), (3, d3), (4, d1), (5, None), (6, [""]), (2, d2), (7, ["x"] * 4000 + passage), (8, [line() for _ in range(3)])]
    text = lambda x: None if x is None else "\n".join(x)
    df = table(spark, [(i, text(x), 1, "c") for i, x in docs], "doc_id long, text string, cut int, n_lines string")
    got = [(r["doc_id"], r["text"], r["n_cut"]) for r in lines.dedup_lines(df).collect()]
    assert len(got) == len(docs)
    want = {1: text(d1), 2: text([d2[0], boiler, "", "", d2[-1]]), 3: text(d3), 4: "", 5: None, 6: "", 7: text(["x"] * 4000), 8: text(docs[-1][1])}
    for i, t, _ in got:
        assert t == want[i], i
    assert {i: n for i, _, n in got}[2] == 4
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_of_a_hot_passage(spark):
    passage = line(60)
    docs = [(i, line() + "\n" + passage + "\n" + line()) for i in range(300)]
    left = {r["doc_id"]: r["text"] for r in lines.dedup_lines(table(spark, docs, "doc_id long, text string")).collect()}
    assert left[0] == docs[0][1]
    assert all(passage not in left[i] and len(left[i].split("\n")) == 2 for i in range(1, 300))


def brute_cuts(docs, block_words=20):
    """doc_id: lines in runs of block_words words or more that an earlier document holds. docs: (doc_id, lines), none blank, ascending."""
    out, seen = {}, set()
    for i, x in docs:
        runs = {(a, b): tuple(x[a:b]) for a in range(len(x)) for b in range(a + 1, len(x) + 1) if sum(len(y.split()) for y in x[a:b]) >= block_words}
        out[i] = {k for (a, b), r in runs.items() if r in seen for k in range(a, b)}
        seen |= set(runs.values())
    return out


def cut_texts(docs):
    gone = brute_cuts(docs)
    return {i: "\n".join(y for k, y in enumerate(x) if k not in gone[i]) for i, x in docs}


def left_texts(spark, docs):
    return {r["doc_id"]: r["text"] for r in lines.dedup_lines(table(spark, [(i, "\n".join(x)) for i, x in docs], "doc_id long, text string")).collect()}


def test_line_dedup_reaches_passages_of_frequent_and_short_lines(spark):
    passage = [line(12) for _ in range(3)]
    docs = [(i, [line(), passage[i], line()]) for i in range(3)]  # each line was seen before, in different documents
    docs += [(3, [line(), *passage, line()]), (4, [line(), line(), *passage])]
    short = [line(2) for _ in range(12)]
    docs += [(5, [*short, line()]), (6, [line(), *short])]
    got = left_texts(spark, docs)
    assert got == cut_texts(docs)
    assert got[4] == "\n".join(docs[4][1][:2]) and got[6] == docs[6][1][0]


def test_line_dedup_of_repeated_and_moved_passages(spark):
    p, q = ([line(12) for _ in range(2)] for _ in range(2))
    a, b = ([line(12) for _ in range(3)] for _ in range(2))
    docs = [(1, [line(), *p, *q, line()]), (2, [line(), *p, *q, line(), *p, *q, line()]), (3, [line(), *a, line(), *b]), (4, [line(), *b, line(), *a])]
    got = left_texts(spark, docs)
    assert got == cut_texts(docs)
    assert len(got[2].split("\n")) == 3 and len(got[4].split("\n")) == 2
    r = random.Random(9)
    some = [line(n) for n in (1, 2, 3, 5, 8, 25)]
    docs = [(i, [r.choice(some) for _ in range(r.randrange(1, 14))]) for i in range(80)]
    assert left_texts(spark, docs) == cut_texts(docs)


# 7


def test_warc(spark, tmp_path):
    big = "<p>" + "ä text of a page " * 200 + "</p>"
    pages = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "\r\n\r\n" + big + "\0"), (2, "again", big), (8, "v", "x" * 3_000_000)] + [(100 + i, f"http://h/{i}", big * 2) for i in range(60)]
    df = table(spark, [(*p, 0) for p in pages], "page_id long, url string, html string, payload_bytes int").repartition(3)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        same = [j for j, _, g in pages if (g or "") == (h or "")]
        again = len(b) >= 1000 and i != max(same)
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    assert sorted(map(str, map(tuple, warc.archived(df).collect()))) == sorted(map(str, want))
    folder = str(tmp_path / "w")
    paths = warc.write(df, folder)
    with open(paths[0], "rb") as f:
        assert int.from_bytes(f.read(4), "little") == warc.MAGIC
    bodies = {r["page_id"]: bytes(r["payload"]) for r in warc.read(spark, paths, folder).collect() if r["record_type"] == "response"}
    assert bodies[8] == b"x" * 3_000_000 and bodies[7].decode() == pages[6][2]
    assert warc.archived(df.limit(0)).count() == 0


def test_archive_frames_stand_alone(tmp_path):
    import struct

    import zstandard

    words = zstandard.train_dictionary(4096, [f"<html>{i} common words of pages {i * 7}</html>".encode() * 8 for i in range(200)]).as_bytes()
    w = warc.Writer(str(tmp_path), "t", words)
    for i in range(5):
        w.add(warc.record("response", i, "u", hashlib.sha1(b"x").hexdigest(), 1, None, b"x"))
    w.close()
    raw = (tmp_path / "t-00000.warc.zst").read_bytes()
    n = struct.unpack("<I", raw[4:8])[0]
    assert raw[8 : 8 + n] == words
    assert raw.count(b"\x28\xb5\x2f\xfd", 8 + n) == 5
    with open(tmp_path / "t-00000.warc.zst", "rb") as f:
        got = list(warc.records(f))
    assert [h["X-Page-Id"] for h, _ in got] == list("01234") and all(body == warc.HTTP + b"x" for _, body in got)


def test_a_revisit_names_the_record_it_repeats():
    fields = lambda r: dict(line.split(": ", 1) for line in r.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
    sha = hashlib.sha1(b"x").hexdigest()
    first, again = fields(warc.record("response", 9, "u", sha, 1, None, b"x")), fields(warc.record("revisit", 3, "v", sha, 1, 9, b"x"))
    assert again["WARC-Refers-To"] == first["WARC-Record-ID"] != again["WARC-Record-ID"] and again["Content-Length"] == "0"


# 9


def shingle_set(text, n=5):
    import re

    w = [x for x in re.sub(r"[\W_]+", " ", (text or "").lower()).split()]
    grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w else [])
    out, seen = set(), {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
        out.add((g, seen[g]))
    return out


def brute_classes(docs, least=0.8):
    sets = [shingle_set(t) for _, t in docs]
    of = list(range(len(docs)))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                of[root(i)] = root(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(docs[i][0])
    return sorted(sorted(g) for g in groups.values())


def near_docs():
    r = random.Random(3)
    text = lambda n: [r.choice(WORDS) for _ in range(n)]
    docs, passage = [], text(90)
    for _ in range(30):
        base = text(120)
        docs.append(base)
        for _ in range(r.randrange(3)):
            copy = base[:]
            for _ in range(r.randrange(1, 5)):
                copy[r.randrange(len(copy))] = r.choice(WORDS)
            docs.append(copy)
    hub = text(200)
    for _ in range(60):  # a large group around one text
        copy = hub[:]
        for _ in range(r.randrange(1, 4)):
            copy[r.randrange(len(copy))] = "z" + r.choice(WORDS)
        docs.append(copy)
    docs += [passage + text(50) for _ in range(60)]  # a common passage doesn't make copies
    docs += [text(3), ["a"], ["a"], ["repeat", "me"] * 40, ["repeat", "me"] * 40 + ["now"]]
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def test_near_duplicates(spark):
    docs = near_docs()
    docs += [(1000, None), (1001, ""), (1002, "!!!"), (1003, docs[0][1].upper() + "?"), (1003, docs[0][1].upper() + "?"), (1004, " ".join(WORDS) * 30)]
    df = table(spark, [(*d, "x") for d in docs], "doc_id long, text string, node string")
    rows = minhash.near_duplicates(df).collect()
    assert len(rows) == len(docs)
    groups = {}
    for r in rows:
        groups.setdefault(r["class_id"], []).append(r["doc_id"])
    assert sorted(sorted(g) for g in groups.values()) == brute_classes(docs)
    for r in rows:
        assert r["class_size"] == len(groups[r["class_id"]]) and r["class_id"] == min(groups[r["class_id"]])
        assert r["kept"] == (r["doc_id"] == r["class_id"])
    same_id = table(spark, [(7, docs[0][1]), (7, docs[0][1] + " x"), (7, "else"), (None, docs[0][1]), (7, docs[0][1])], "doc_id long, text string")
    got = minhash.near_duplicates(same_id).collect()
    # one text of the class stays, in both of its rows; the text of its own class stays too
    assert sorted((r["class_id"], r["class_size"]) for r in got) == [(7, 1), (7, 4), (7, 4), (7, 4), (7, 4)]
    assert len({(r["doc_id"], r["text_key"]) for r in got if r["kept"] and r["class_size"] == 4}) == 1 and not any(r["kept"] for r in got if r["doc_id"] is None)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_every_pair_of_classes_in_a_large_bucket_is_compared(spark):
    name = lambda x: x.encode()
    of = {**{c: "a" for c in "abcde"}, **{c: "p" for c in "pqrs"}, "y": "y", "z": None}
    centre = lambda c: (name(c), 10)
    rows = [(k, name(c), 10, len(members), centre("a"), centre("p")) for k, members in ((1, of), (2, "abcde"), (3, "apqyz")) for c in members]
    many = table(spark, rows, "key long, node binary, n int, size long, least struct<node: binary, n: int>, hub struct<node: binary, n: int>")
    labels = table(spark, [(name(c), name(x)) for c, x in of.items() if x], "node binary, label binary")
    asked = {(r["key"], bytes(r["node"]).decode()) for r in minhash.unlinked(many, labels).collect()}
    label = lambda c: of[c] or c
    members = {k: [bytes(c).decode() for j, c, *_ in rows if j == k] for k in (1, 2, 3)}
    assert all((k, x) in asked or (k, y) in asked for k, m in members.items() for x in m for y in m if label(x) != label(y))
    assert not any(k == 2 for k, _ in asked)


def test_signatures_estimate_weighted_similarity():
    texts = ["a b c d e f g h i j " * 3, "a b c d e f g h i j " * 2 + "k l m n"]
    sets = [shingle_set(t) for t in texts]
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    offsets, ids = arrow.words(pa.array(texts))
    sig = minhash.signatures(*minhash.elements(*arrow.shingles(offsets, ids)), 2, 2048)
    assert (sig != 0).all()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.06


@pytest.mark.parametrize(("a", "b"), [((1, 7, 100, 3), (1, 5, 40, 30)), ((1000, 1, 1, 0), (900, 1, 0, 1)), ((3, 3, 3, 3), (4, 4, 4, 4)), ((1, 0, 0, 0), (512, 0, 0, 0))])
def test_darts_under_the_lesser_weight_are_shared(a, b):
    """Agreement of signatures against weighted Jaccard, for weights whose regions are cut at different heights."""
    x, y = (np.array(w) for w in (a, b))
    row = np.concatenate([np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int)])
    element = np.concatenate([np.flatnonzero(x), np.flatnonzero(y)]).astype(np.uint64) + np.uint64(11)
    sig = minhash.signatures(row, element, np.concatenate([x[x > 0], y[y > 0]]), 2, 2048)
    assert (sig != 0).all()
    assert abs((sig[0] == sig[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.05


def test_weighted_sets_become_sets():
    row, ids = minhash.occurrences(*minhash.elements(np.array([0, 3, 5]), np.array([5, 9, 5, 9, 9], np.uint64)))
    assert row.tolist() == [0, 0, 0, 1, 1] and len(set(ids[:3].tolist()) & set(ids[3:].tolist())) == 1 and len(set(ids.tolist())) == 4


def test_recall_at_the_threshold():
    r = np.random.default_rng(0)
    met = 0
    for _ in range(60):
        common = r.integers(0, 2**62, 160).astype(np.uint64)
        a, b = (np.concatenate([common, r.integers(0, 2**62, 20).astype(np.uint64)]) for _ in range(2))
        keys = minhash.band_keys(minhash.signatures(np.repeat([0, 1], 180), np.concatenate([a, b]), np.ones(360, int), 2, 120), 20)
        met += (keys[0] == keys[1]).any()
    assert met >= 58


# 10


def pair_rows(seed, n, both):
    """Rows of 30 terms of 2000, and terms 0 and 1 at random; label 1 as both says."""
    r = np.random.default_rng(seed)
    x, y = [], []
    for _ in range(n):
        a, b = r.random(2) < 0.5
        x.append(np.array(sorted({*r.integers(10, 2000, 30).tolist(), *[k for k, on in enumerate((a, b)) if on]})))
        y.append(float(both(a, b)))
    return np.concatenate([[0], np.cumsum([len(t) for t in x])]), np.concatenate(x), np.array(y)


@pytest.mark.parametrize("both", [lambda a, b: a != b, lambda a, b: a == b, lambda a, b: a and b])
def test_machine_learns_pairs_with_its_defaults(both):
    """Judged on other rows; in the first two cases neither term alone tells anything."""
    m = toxicity.fit(*pair_rows(1, 4000, both), bits=11)
    offsets, cols, y = pair_rows(2, 1000, both)
    assert ((m.scores(offsets, cols) >= 0.5) == (y == 1)).mean() > 0.98


def test_linear_time_sum_is_the_sum_over_pairs():
    r = np.random.default_rng(3)
    m = toxicity.Machine(0.3, r.normal(size=64).astype(np.float32), r.normal(size=(64, 5)).astype(np.float32), 6)
    rows = [np.sort(r.choice(64, k, replace=False)) for k in (0, 1, 2, 7, 30)]
    got = m.logits(np.concatenate([[0], np.cumsum([len(x) for x in rows])]), np.concatenate(rows))
    want = [0.3 + m.w[x].sum() + sum(float(m.v[i] @ m.v[j]) for i in x for j in x if i < j) for x in rows]
    assert np.allclose(got, want, atol=1e-4)


def test_toxicity(spark):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(1500):
        bad = r.random() < 0.2
        w = [r.choice(WORDS) for _ in range(30)] + (["idiotic"] if bad else [])
        r.shuffle(w)
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs += [(2000, None), (2001, ""), (2002, "Idiotic! " * 20000), (3, docs[3][1])]
    labels += [(None, 1), (9999, None), (3, labels[3][1])]
    d = table(spark, [(*x, "s") for x in docs], "doc_id long, text string, score string")
    lab = table(spark, labels, "doc_id long, toxic int")
    rows = toxicity.toxicity(d, lab).collect()
    assert len(rows) == len(docs) and all(0 <= x["score"] <= 1 for x in rows)
    truth = dict((i, y) for i, y in labels if i is not None)
    held = [x for x in rows if x["held_out"] and x["doc_id"] < 1500]
    assert 200 < len(held) < 400 and np.mean([x["predicted"] == truth[x["doc_id"]] for x in held]) > 0.98
    assert {x["predicted"] for x in rows if x["doc_id"] == 2002} == {1}
    kept = toxicity.reject(d, toxicity.train(d, lab))
    assert kept.columns == d.columns and {x["doc_id"] for x in kept.collect()} == {x["doc_id"] for x in rows if not x["predicted"]}
    none = toxicity.toxicity(d, lab.limit(0)).collect()
    assert {x["predicted"] for x in none} == {0}
    assert toxicity.toxicity(d.limit(0), lab).count() == 0


def test_toxicity_holds_its_sample_once(spark, monkeypatch):
    """The driver gets four bytes a term, no objects, and fit makes nothing as long as all terms from them."""
    given = []
    monkeypatch.setattr(toxicity, "fit", lambda *a, **how: given.append(a))
    texts = ["a stupid fool", "", None, "nice day nice day", "fool of a day"]
    d = table(spark, list(enumerate(texts)), "doc_id long, text string")
    toxicity.train(d, table(spark, [(i, i % 2) for i in range(len(texts))], "doc_id long, toxic int"))
    offsets, cols, y = given[0][:3]
    assert isinstance(cols, np.ndarray) and cols.dtype == np.int32
    at, want = toxicity.features(pa.array(texts), 18)
    of = lambda offsets, cols: [tuple(cols[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)]
    learnt = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(zip(of(offsets, cols), y.tolist(), strict=True)) == sorted((of(at, want)[i], float(i % 2)) for i in learnt)
    monkeypatch.undo()
    r = np.random.default_rng(1)
    rows = [np.unique(r.zipf(1.2, 400) * 7919 % (1 << 18)) for _ in range(8000)]
    y = (r.random(len(rows)) < 0.3).astype(float)
    ends, cols = np.concatenate([[0], np.cumsum([len(x) for x in rows])]), np.concatenate(rows).astype(np.int32)
    tracemalloc.start()
    toxicity.fit(ends, cols, y, epochs=1, least_steps=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 75e6, most


# all


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    source = "pages" if name.split("_")[0] in ("op3", "op7", "op8") else "documents"
    n = df.count()
    assert n == spark.read.parquet(f"{SF}/{source}.parquet").count() if name != "op4_decontam" else n > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "src0", 0)], docs.schema))
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        assert len(rows) <= before
        before = len(rows)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert {r["doc_id"] for r in rows} >= {None, 10**6}
    assert docs.filter(F.col("taken") > 3 * F.col("size")).count() == 0


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, tmp_path, labels=(), benchmark=()):
    table(spark, list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table(spark, list(benchmark), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def stages(spark, docs, sf_dir):
    """The rows after each stage."""
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return out


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert [d.count() for d in stages(spark, table(spark, [], DOCUMENTS), folder(spark, tmp_path))] == [0] * 5


def test_pipeline_against_brute_force(spark, tmp_path):
    """Rows that repeat, equal ids, nulls, copies, a passage, a benchmark item, clashing names; no label but nulls."""
    r = random.Random(21)
    passage, item = [line() for _ in range(4)], line(14)
    base = [[line() for _ in range(12)] for _ in range(5)]
    near = " ".join(base[0]).split()
    near[70] = "other"
    rows = [(1, base[0]), (2, base[1][:6] + passage + base[1][6:]), (3, [line() for _ in range(3)] + passage), (4, [" ".join(near)]), (5, base[2] + [f"x {item} y"]), (6, base[3]), (6, base[4]), (None, [line()]), (8, None), (9, [""]), (6, base[3]), (10, base[3][:-1] + ["a last line of its own"])]
    docs = [(i, None if x is None else "\n".join(x), "en", f"s{k % 3}" if k % 5 else None, 7) for k, (i, x) in enumerate(rows)]
    r.shuffle(docs)
    df = table(spark, docs, DOCUMENTS).withColumn("n_cut", F.lit("c")).withColumn("kept", F.lit("k")).withColumn("share_left", F.lit(0)).withColumn("node", F.lit(1))
    got = stages(spark, df, folder(spark, tmp_path, [(None, 1, 1), (2, None, None)], [(1, item), (2, None)]))
    ids = lambda d: sorted(((x["doc_id"], x["text"]) for x in d.collect()), key=str)
    want = sorted(((i, t) for i, t, *_ in docs), key=str)
    assert ids(got[0]) == want and all(d.columns == df.columns for d in got[:4])
    # 3 loses the passage; of 10 only the last line would stay, so it goes
    short = "\n".join(rows[2][1][:3])
    want = sorted(((i, short if i == 3 else t) for i, t in want if i != 10), key=str)
    assert ids(got[1]) == want and {x["n_chars"] for x in got[1].filter("doc_id = 3").collect()} == {len(short)} and {x["n_cut"] for x in got[1].collect()} == {"c"}
    # 4 says what 1 does on one line; the two texts of id 6 differ, and the repeated row stays beside its twin
    want = [x for x in want if x[0] != 4]
    assert ids(got[2]) == want
    want = [x for x in want if x[0] != 5]
    assert ids(got[3]) == want
    last = got[4].collect()
    assert sorted((x["doc_id"] for x in last), key=str) == sorted((i for i, _ in want), key=str)
    total = sum(len((t or "").split()) for _, t in want)
    assert sum(x["size"] for x in last) == total and abs(sum(x["taken"] for x in last) - total) <= 3 * max(x["size"] for x in last)
