"""Operator 8, URL filters: host and path rules first, then gradient-boosted trees on lexical features.

Rules are a short list (a parameter of the driver program); each becomes a branch of one expression, so rule
matching runs inside the scan. URLs that no rule fits are judged by the trees: logistic boosting over quantile
histograms of lexical features (lengths, depth, digit ratio, entropy, parameter counts, hyphens, and smoothed
label shares of the last one and two labels of the host), trained from labelled URLs on the driver, at most
``max_rows`` of them; by default a list written by hand beside generated ones (see ``train``). Nothing is shuffled.

A null url, or one without "://", has an empty host and path, fits no rule and is judged on those. Repeated
rows repeat; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import url_labels
from .arrow import in_batches
from .common import ascii_lower

#: (rule, verdict): host, "/" and path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# Words of hosts for the labelled URLs below.
UNWANTED = "casino bets poker slots pills pharma adult xxx porn spam farm track ads click win free cheap loan viagra lottery jackpot crack warez torrent malware phish".split()
WANTED = "news garden library school museum science travel kitchen music history weather health village sports football cooking nature theatre archive journal medicine bridge harbour forest river mountain writing painting".split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict), both null where none fits; of several the longest."""
    rule = verdict = F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = name.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


#: Hosts are lower-cased in A-Z only, as in host_and_path.
_LOWER = {c: c + 32 for c in range(65, 91)}


def split(url: str | None) -> tuple[str, str, str]:
    """(host, path, what follows)."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate(_LOWER), path, rest[len(host) + len(path) :]


def entropy(s: str) -> float:
    if not s:
        return 0.0
    _, n = np.unique(np.frombuffer(s.encode("utf-32-le"), np.uint32), return_counts=True)
    p = n / len(s)
    return float(-(p * np.log2(p)).sum())


FEATURES = ("url length", "host length", "path length", "labels", "longest label", "hyphens in host", "digits in url", "digits in host", "host entropy", "path entropy", "depth", "parameters", "other characters", "suffix", "suffix of two")


def lexical(url: str | None, suffixes: dict[str, float], prior: float) -> list[float]:
    host, path, tail = split(url)
    labels = host.split(".")
    u = url or ""
    n = max(1, len(u))
    query = tail.partition("#")[0]
    return [
        len(u), len(host), len(path), len(labels), max(map(len, labels)), host.count("-"), sum(c.isdigit() for c in u) / n, sum(c.isdigit() for c in host),
        entropy(host), entropy(path), len([p for p in path.split("/") if p]), query.count("&") + query.count(";") + (len(query) > 1), sum(not c.isalnum() for c in u) / n,
        suffixes.get(labels[-1], prior), suffixes.get(".".join(labels[-2:]), prior),
    ]


@dataclass
class Trees:
    base: float
    rate: float
    suffixes: dict[str, float]
    prior: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Each tree is complete: node i has children 2i + 1 and 2i + 2."""
        out = np.full(len(x), self.base)
        for column, cut, leaf in self.trees:
            at = np.zeros(len(x), int)
            while (inner := at < len(column)).any():
                i = at[inner]
                at[inner] = 2 * i + 1 + (x[inner, column[i]] > cut[i])
            out += self.rate * leaf[at - len(column)]
        return out

    def scores(self, urls: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(np.array([lexical(u, self.suffixes, self.prior) for u in urls], float).reshape(-1, len(FEATURES)))))


def fit(urls: list[str], labels: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    """Boosting by second-order gains over histograms of each feature."""
    prior = float(labels.mean())
    seen: dict[str, list[float]] = {}
    for u, y in zip(urls, labels, strict=True):
        own = split(u)[0].split(".")
        for s in {own[-1], ".".join(own[-2:])}:
            c = seen.setdefault(s, [0, 0])
            c[0] += y
            c[1] += 1
    model = Trees(float(np.log((prior + 1e-6) / (1 - prior + 1e-6))), rate, {s: (a + 20 * prior) / (n + 20) for s, (a, n) in seen.items() if n >= 5}, prior)
    x = np.array([lexical(u, model.suffixes, prior) for u in urls], float)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    score = np.full(len(x), model.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = labels - p, p * (1 - p)
        column, cut, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(x), int)
        for i in range(inner):
            here = np.flatnonzero(at == i)
            best = (1e-6, 0, np.inf)
            for j, c in enumerate(cuts):
                if len(c) and len(here):
                    gs, hs = (np.cumsum(np.bincount(binned[here, j], v[here], len(c) + 1)) for v in (g, h))
                    gain = gs**2 / (hs + l2) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + l2) - gs[-1] ** 2 / (hs[-1] + l2)
                    k = int(np.argmax(gain[:-1]))
                    best = max(best, (float(gain[k]), j, float(c[k])), key=lambda b: b[0])
            column[i], cut[i] = best[1:]
            at[here] = 2 * i + 1 + (x[here, column[i]] > cut[i])
        leaves = at - inner
        leaf = np.bincount(leaves, g, inner + 1) / (np.bincount(leaves, h, inner + 1) + l2)
        model.trees.append((column, cut, leaf))
        score += rate * leaf[leaves]
    return model


#: Suffixes of generated hosts, unwanted and wanted: the suffix says something, but not all.
_SUFFIXES = (".com .net .org .xyz .top .info .click .biz".split(), ".com .net .org .com .net .org .edu .de".split())


def labelled_urls(n: int = 4000, seed: int = 0) -> tuple[list[str], np.ndarray]:
    """n labelled URLs made from the word lists: unwanted hosts (1) join their words by hyphens or digits, wanted ones (0) are plain words."""
    rng = np.random.default_rng(seed)
    pick = lambda words: str(rng.choice(words))
    urls, labels = [], np.arange(n) % 2
    for y in labels:
        syllables = "".join(pick(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]) for _ in range(rng.integers(2, 5)))
        if y:
            name = pick(["-", "-", "-", f"-{rng.integers(1, 99)}-"]).join([pick(UNWANTED), pick(UNWANTED + [syllables, "x", "365", "online"])])
        else:
            name = pick([syllables, syllables, pick(WANTED), pick(WANTED) + syllables])
        host = pick(["", "www.", "blog.", "m."]) + name + pick([".example", ""]) + pick(_SUFFIXES[1 - y])
        path = "/" + "/".join([pick(["en", "de", "fr", "es"]), str(rng.integers(1, 60000))][: rng.integers(0, 3)]) + pick(["", "", "/", ".html"])
        urls.append(pick(["http://", "https://"]) + host + path + pick(["", "", "", "?utm_source=feed", "?page=2&ref=x", "#top"]))
    return urls, labels.astype(float)


def train(labelled: DataFrame | None = None, max_rows: int = 20_000, **how: float) -> Trees:
    """From a DataFrame (url, label), of which at most max_rows rows in order of a digest are used; by default from the training part of the
    labelled URLs of url_labels, each ten times, beside those of labelled_urls()."""
    if labelled is None:
        (own, own_labels), _ = url_labels.split()
        urls, labels = labelled_urls()
        return fit(urls + own * 10, np.concatenate([labels, np.array(own_labels * 10)]), **how)
    rows = labelled.filter("url is not null and label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(max_rows).collect()
    return fit([r["url"] for r in rows], np.array([float(r["label"]) for r in rows]), **how)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, model: Trees | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row; score is the trees' for block."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.scores(b.column("url").to_pylist()))], names=[*b.schema.names, "score"])

    host, path = host_and_path(F.col("url"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = in_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), run, "page_id long, url string, score double")
    rows = rows.withColumn("host", host).withColumn("path", path).withColumn("rule", rule)
    return rows.select("page_id", "host", "path", "rule", F.coalesce(says, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
