"""Operator 1, secret scans, native.

Base rules find assignments, access keys and hex runs. The method adds to them: over each candidate
string a window of ``window`` characters slides along, its Shannon entropy per character class (hex
or base64) kept by incremental counts; runs of windows at or above the class's threshold become spans
unless an allow-list pattern matches the candidate. Windows that a base span meets don't count, so of a
random string that is joined to a base match the rest is still reported, if a window of it stands apart.

Everything is an expression over one row: no shuffle, no Python, so hot sources and copies cost only
their own rows. Time is linear in a candidate's length and a little more than that in the number of matches.
Positions are code points, end exclusive. A null text counts as empty, an empty one has no spans; rows
repeated in the input are repeated in the output; other columns, of whatever names, stay in the row's struct.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# The base rules.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

#: Characters of candidates; a character's place here is its code.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
#: Suppressed candidates: words of letters only, numbers, rulers of consecutive characters, placeholders, dashed identifiers.
ALLOW = (
    r"^[A-Za-z+/_=-]*$",
    r"^[0-9+/_=-]*$",
    r"0123456789|abcdefghij|ABCDEFGHIJ",
    r"(?i)example|sample|placeholder|changeme|dummy|x{6}",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
)
MATCH = "array<struct<start:int,end:int,s:string>>"
#: Windows whose results one long integer holds, a bit each.
BLOCK = 62


def _matched(text: Column, pattern: str, check: int | None = None) -> Column:
    """Array of (start, end, text) for each leftmost match, from the pieces between matches; check: a group that needs 6 characters.

    Places are sums over the pieces and matches before. The n matches are summed in blocks of about the cube root of n, first block by block,
    then within each, so no array grows by one match at a time over all of them."""
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(check)) if check else hits
    zipped = F.filter(F.arrays_zip(pieces.alias("p"), hits.alias("m"), tested.alias("g")), lambda x: x["m"].isNotNull())
    none = F.array().cast(MATCH)

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.char_length(x["p"])
        end = at + F.char_length(x["m"])
        one = F.array(F.struct(at.cast("int").alias("start"), end.cast("int").alias("end"), x["m"].alias("s")))
        good = (F.char_length(x["g"]) >= 6) if check else F.lit(True)
        return F.struct(end.cast("int").alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def block(x: Column, k: Column, b: Column) -> Column:
        return F.slice(x, (b * k + 1).cast("int"), k)

    def placed(z: Column) -> Column:
        k = F.greatest(F.lit(16), F.ceil(F.cbrt(F.size(z).cast("double"))).cast("int"))
        numbers = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / k).cast("int"))
        long = F.transform(numbers, lambda b: F.aggregate(block(z, k, b), F.lit(0), lambda n, x: n + F.char_length(x["p"]) + F.char_length(x["m"])))

        def spans(sums: Column) -> Column:
            before = lambda b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda n, x: n + x)
            return F.flatten(F.transform(numbers, lambda b: F.aggregate(block(z, k, b), F.struct(before(b).alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

        return _let(long, spans)

    return F.when(text.rlike(pattern), _let(zipped, lambda z: F.when(F.size(z) > 0, placed(z)).otherwise(none))).otherwise(none)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _kind(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _coded(window: int, hex_bits: float, base64_bits: float) -> str:
    """SQL lambda: a candidate (start, end, s) to its start, class (hex or not), limit for sums of c ln c, and codes of characters."""
    code = {ord(c): i for i, c in enumerate(ALPHABET)}
    codes = "array(" + ",".join(str(code.get(i, 0)) for i in range(128)) + ")"
    is_hex = "(x.s rlike '^[0-9a-f]*$' or x.s rlike '^[0-9A-F]*$')"
    # H >= bits  <=>  sum c ln c <= (log2 W - bits) W ln 2
    most = "if({}, {}D, {}D)".format(is_hex, *((math.log2(window) - bits) * window * math.log(2) + 1e-9 for bits in (hex_bits, base64_bits)))
    return f"x -> named_struct('start', x.start, 'hex', {is_hex}, 'most', {most}, 'c', transform(split(x.s, ''), ch -> {codes}[ascii(ch)]))"


def _hot(window: int) -> str:
    """SQL lambda: a coded candidate to bits that tell the windows of high entropy, BLOCK of them in a long.

    Along a block the counts of all characters are kept in a few longs (as many bits each as a full window needs); a step takes the new
    character in and the old one out, and changes the sum of c ln c by what those two counts add."""
    bits = window.bit_length()
    per = 63 // bits
    n = -(-len(ALPHABET) // per)
    # what the (c + 1)-th occurrence of a character adds
    more = "array(" + ",".join(f"{((c + 1) * math.log(c + 1) - (c * math.log(c) if c else 0.0))!r}D" for c in range(window)) + ")"
    count = lambda code: f"cast(shiftright(a.n[cast({code} div {per} as int)], {bits} * cast({code} % {per} as int)) & {(1 << bits) - 1} as int)"
    unit = lambda code: f"shiftleft(1L, {bits} * cast({code} % {per} as int))"
    new, old, full = "x.c[i]", f"x.c[i - {window}]", f"(i - b * {BLOCK} >= {window})"
    left = f"if({full}, -{more}[{count(old)} - 1], 0D)"
    come = f"{more}[{count(new)} - if({full}, if({old} = {new}, 1, 0), 0)]"
    counts = f"transform(a.n, (v, j) -> v + if(j = {new} div {per}, {unit(new)}, 0L) - if({full}, if(j = {old} div {per}, {unit(old)}, 0L), 0L))"
    # the window before the new character is judged, so its sum is at hand
    step = f"named_struct('n', {counts}, 's', a.s + {left} + {come}, 'm', if({full} and a.s <= x.most, a.m | shiftleft(1L, i - b * {BLOCK} - {window}), a.m), 'i', i + 1)"
    zero = f"named_struct('n', array_repeat(0L, {n}), 's', 0D, 'm', 0L, 'i', 0)"
    last = f"if(a.s <= x.most, a.m | shiftleft(1L, a.i - b * {BLOCK} - {window}), a.m)"
    blocks = f"sequence(0, cast((size(x.c) - {window}) div {BLOCK} as int))"
    return f"transform({blocks}, b -> aggregate(sequence(b * {BLOCK}, least(b * {BLOCK} + {BLOCK - 1} + {window}, size(x.c)) - 1), {zero}, (a, i) -> {step}, a -> {last}))"


def _overlaps(kind: str, a: str, b: str) -> str:
    """Whether a span of column _kind, which are in order and apart, meets [a, b): the last that starts before b is looked up by halving."""
    of = f"_{kind}"
    steps = f"aggregate(sequence(1, 31), named_struct('lo', 0, 'hi', size({of})), (s, k) -> if(s.lo >= s.hi, s, if({of}[cast((s.lo + s.hi) div 2 as int)].start < {b}, named_struct('lo', cast((s.lo + s.hi) div 2 as int) + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int)))), s -> s.lo)"
    return f"if(size({of}) <= 8, exists({of}, e -> e.start < {b} and {a} < e.end), coalesce(try_element_at({of}, nullif({steps}, 0)).end > {a}, false))"


def _spans(window: int) -> str:
    """SQL lambda: a coded candidate to its spans: runs of windows of high entropy, next to or over each other, that no base span meets."""
    free = " and ".join(f"not {_overlaps(k, 'x.start + p', f'x.start + p + {window}')}" for k in KINDS[:3])
    places = f"filter(sequence(0, size(x.c) - {window}), p -> shiftright(m[cast(p div {BLOCK} as int)], cast(p % {BLOCK} as int)) & 1 = 1 and {free})"
    first = f"filter(h, (p, j) -> j = 0 or p - h[j - 1] > {window})"
    final = f"filter(h, (p, j) -> j = size(h) - 1 or h[j + 1] - p > {window})"
    one = f"named_struct('start', x.start + p, 'rank', if(x.hex, 3, 4), 'end', x.start + q + {window}, 'kind', if(x.hex, 'entropy_hex', 'entropy_base64'))"
    return f"x -> transform(array({_hot(window)}), m -> transform(array({places}), h -> zip_with({first}, {final}, (p, q) -> {one}))[0])[0]"


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text: str = "text", window: int = 20, hex_bits: float = 3.0, base64_bits: float = 3.8, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """The rows of docs in a struct ``row``, with base and spans, arrays of (start, rank, end, kind) sorted by start and kind."""
    t = F.col("_t")
    cands = _matched(t, CANDIDATE % window)
    if allow:
        allowed = "|".join(f"(?:{p})" for p in allow)
        cands = F.filter(cands, lambda x: ~x["s"].rlike(allowed))
    df = docs.select(F.struct(*docs.columns).alias("row"), text_of(text).alias("_t"))
    base = [_kind(_matched(t, p, check), k).alias(f"_{k}") for k, p, check in zip(KINDS, (ASSIGN, ACCESS, HEX), (2, None, None), strict=False)]
    df = df.select("row", *base, cands.alias("_cand"))
    df = df.withColumn("_more", F.expr(f"flatten(transform(transform(_cand, {_coded(window, hex_bits, base64_bits)}), {_spans(window)}))"))
    base = F.concat(*[f"_{k}" for k in KINDS[:3]])
    return df.select("row", F.array_sort(base).alias("base"), F.array_sort(F.concat(base, "_more")).alias("spans"))


def secret_digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of each base kind, base_sha256, spans as text."""
    found = scan_secrets(docs.select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("row.doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
