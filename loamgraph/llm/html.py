"""Operator 3, main text of web pages by template deduction over equivalence classes.

A page is a sequence of tag tokens, each known by its path of elements (with class, id and role). Tokens whose
occurrence vectors over the pages of one host are equal form an equivalence class. A vector is never held: its two
31-bit sums of hashed (page, count) stand for it, so classes come from one partial aggregation over (host, token).
Classes on at least ``least_pages`` pages and ``support`` of the host's pages count, so each of several layouts has classes of its own.
A class is valid if it has several tokens and they keep one order over its pages (their least and their greatest first places sort
alike). Tokens that occur once on each of their class's pages are the template's slots; repeated ones (lists, records) stay inside a slot.
Hosts with fewer than ``least_pages`` pages take the template that is deduced over all pages.

Slots are elements but inline ones, nested by their paths; a text belongs to the slot next around it. Text that differs between the pages of a
slot and isn't mostly links is its variable text. Going down from the outermost slots, a slot is entered if it has most of the variable text that a page has in the slot around it
and leaves no variable main heading behind; where this ends is a main slot. Where the page says itself what its main text is, by an article or main element
inside or around such a slot, that element is the main slot instead. Inside, a slot is boilerplate if its
element or class says so (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) or, outside article and main elements,
if the text that belongs to it is the same on all its pages, of which at least two
differ in other text, or mostly links. The latter loses its own text only: other slots inside it stay. A page without any main slot of its
template keeps all of its text but boilerplate. What remains in main slots
is the page's text: character references decoded, white space inside a block (line breaks too) turned into one space, trimmed,
non-empty blocks joined by \\n in page order. Nothing else is dropped.

Scale: pages are read twice and never shuffled; a template is at most 1 / support times the paths of a page. Templates reach the pages by a
broadcast if they are counted to at most ``broadcast_hosts`` hosts, and by an equi-join on host beyond (adaptive
execution splits hot hosts); both know a host by the same rule. Null or empty html gives an empty text; a null url has an empty host. Repeated rows
repeat, and count in the vectors. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import in_batches, slices
from .common import stored
from .urls import host_and_path
from .urls import split as split_url

# Elements of HTML by what they are here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
BOILERPLATE = frozenset("nav footer aside form button select menu head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCK = frozenset("p".split())
SELF_CLOSING = frozenset("li dt dd tr td th option p".split())
BAD_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|cookies?|consent|notice|newsletter|subscribe|popup|modal|share|sharing|social|related|recommended|comments?|disqus|replies|widget)(?:$|[\s_-])", re.I)
BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

#: Layout classes tell of a sidebar or menu elsewhere; an article's own header holds its title.
_LAYOUT = re.compile(r"(?:has|with|without|no|is|js)-", re.I)
_HEADER = re.compile(r"(?:^|[_-])(?:header|masthead)(?:$|[_-])", re.I)
_REPLY = re.compile(r"(?:^|[_-])(?:comments?|reply|replies)(?:$|[_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"\b(class|id|role|hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    """An open element: its path, whether it or an ancestor is boilerplate, an article, or breaks blocks."""

    __slots__ = ("name", "path", "bad", "article")

    def __init__(self, name: str, path: str, bad: bool, article: bool):
        self.name, self.path, self.bad, self.article = name, path, bad, article


def names_boilerplate(name: str, value: str, in_article: bool) -> bool:
    """Whether a class or id says that an element of that name isn't main text."""
    tokens = [t for t in value.split() if not _LAYOUT.match(t)]
    if name in ("html", "body", "main"):
        return False
    if name == "article":
        return any(_REPLY.search(t) for t in tokens)
    return any(BAD_NAME.search(t) and not (in_article and _HEADER.search(t)) for t in tokens)


def opened(tag: str, name: str, parent: Node) -> Node:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(tag[1 + len(name) :])} if len(tag) > len(name) + 2 else {}
    label = name + "".join(f"{mark}{found[k]}" for mark, k in ((".", "class"), ("#", "id")) if k in found and not any(c.isdigit() for c in found[k]))
    article = parent.article or name in ("article", "main") or found.get("role") in ("main", "article")
    bad = parent.bad or name in BOILERPLATE or (name == "header" and not parent.article) or found.get("role", "").lower() in BAD_ROLE or "hidden" in found or any(names_boilerplate(name, found[k], parent.article) for k in ("class", "id") if k in found)
    return Node(name, f"{parent.path}/{label}", bad, article)


def walk(page: str) -> Iterator[tuple[str, Node, str]]:
    """("open" or "close", element, "") for tags and ("text", element, raw text) between them, raw elements skipped."""
    root = Node("", "", False, False)
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        begin = m.start() if m else n
        if begin > at:
            yield "text", stack[-1], page[at:begin]
        if not m:
            return
        at, tag = m.end(), m[0]
        if tag[1] in "!?":
            if tag.startswith("<![CDATA["):
                yield "text", stack[-1], entities.escape(tag[9:].removesuffix("]]>"))
            continue
        name = _NAME.match(tag)[1].lower()
        if tag[1] == "/":
            if any(x.name == name for x in stack[1:]):
                while stack[-1].name != name:
                    yield "close", stack.pop(), ""
                yield "close", stack.pop(), ""
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at) if not tag.endswith("/>") else None
            yield "open", Node(name, f"{stack[-1].path}/{name}", True, False), ""
            at = end.end() if end else (at if tag.endswith("/>") else n)
            continue
        if name not in INLINE or name in SELF_CLOSING:
            # a block ends an open paragraph, and a list item or cell its predecessor, with the inline elements inside
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in CLOSED_BY_BLOCK or (stack[k].name == name and name in SELF_CLOSING):
                    while len(stack) > k:
                        yield "close", stack.pop(), ""
                    break
                if stack[k].name not in INLINE:
                    break
        node = opened(tag, name, stack[-1])
        yield "open", node, ""
        if name not in VOID and not tag.endswith("/>"):
            stack.append(node)


def main_text(page: str | None, main: frozenset[str] = frozenset(), drop: frozenset[str] = frozenset(), keep: frozenset[str] = frozenset()) -> str:
    """main: paths of main slots, if the template has any that this page has too; drop: paths of boilerplate slots; keep: paths of other slots inside those."""
    blocks: list[tuple[bool, str]] = []
    parts: list[str] = []
    inside = False
    held = False

    def end_block() -> None:
        nonlocal held
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            blocks.append((held, text))
        parts.clear()

    depth_main = 0
    dropped = [False]
    for kind, node, text in walk(page or ""):
        if kind == "text":
            if not (node.bad or dropped[-1]):
                held = bool(depth_main)
                parts.append(text)
            continue
        if node.name == "br" or node.name in ("img", "wbr"):
            parts.append(" " if node.name == "br" else "")
            continue
        if node.name in RAW:
            continue
        if node.name not in INLINE:
            end_block()
        if node.name in VOID:
            continue
        is_main, is_drop = node.path in main, node.path in drop
        depth_main += is_main if kind == "open" else -is_main
        if is_drop or node.path in keep:
            if kind == "open":
                dropped.append(is_drop)
            else:
                dropped.pop()
        inside |= is_main
    end_block()
    return "\n".join(t for of_main, t in blocks if of_main or not inside)


TOKENS = "host string, path string, v1 long, v2 long, pages long, once long, first_min int, first_max int, chars long, links long, text_min long, text_max long, page_min long, page_max long, main boolean, bad boolean"


_LINK = re.compile(r"/a(?:[./#]|$)")


def in_link(path: str) -> bool:
    return _LINK.search(path) is not None


def tokens(pages: DataFrame) -> DataFrame:
    """Per host and tag token: sums of its vector, pages that have it, pages that have it once, first places, text right in it, all text of those pages. Also under host null, for all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str | None, str], list] = {}
        for b in slices(batches, "html"):
            for ident, url, page in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                if not page:
                    continue
                count: Counter[str] = Counter()
                seen: dict[str, list] = {}
                place = 0
                whole = xxhash.xxh64()
                for kind, node, text in walk(page):
                    if kind == "open":
                        count[node.path] += 1
                        if node.path not in seen:
                            seen[node.path] = [place, 0, 0, None, node.article, node.bad]
                        place += 1
                    elif kind == "text" and (s := text.strip()):
                        if not node.bad:
                            whole.update(s + "\0")
                        if (x := seen.get(node.path)) is not None:
                            x[1] += len(s)
                            x[2] += len(s) * in_link(node.path)
                            x[3] = x[3] or xxhash.xxh64()
                            x[3].update(s + "\0")
                p = whole.intdigest() >> 1
                for path, (first, chars, links, texts, main, bad) in seen.items():
                    h = xxhash.xxh64_intdigest(f"{ident} {count[path]}")
                    t = texts.intdigest() >> 1 if texts else 0
                    for host in (split_url(url)[0], None):
                        x = found.get((host, path))
                        if x is None:
                            x = found[host, path] = [0, 0, 0, 0, first, first, 0, 0, t, t, p, p, main, bad]
                        x[0] += h & 0x7FFFFFFF
                        x[1] += (h >> 31) & 0x7FFFFFFF
                        x[2] += 1
                        x[3] += count[path] == 1
                        x[4], x[5] = min(x[4], first), max(x[5], first)
                        x[6] += chars
                        x[7] += links
                        x[8], x[9] = min(x[8], t), max(x[9], t)
                        x[10], x[11] = min(x[10], p), max(x[11], p)
                if len(found) >= 50_000:
                    yield table(found)
                    found = {}
        if found:
            yield table(found)

    def table(found: dict) -> pa.RecordBatch:
        cols = list(zip(*((host, path, *x) for (host, path), x in found.items()), strict=True))
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in TOKENS.split(", ")])

    rows = in_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), run, TOKENS)
    total = [F.sum(c).alias(c) for c in ("v1", "v2", "pages", "once", "chars", "links")]
    ends = [F.min("first_min").alias("first_min"), F.max("first_max").alias("first_max"), F.min("text_min").alias("text_min"), F.max("text_max").alias("text_max"), F.min("page_min").alias("page_min"), F.max("page_max").alias("page_max"), F.max("main").alias("main"), F.max("bad").alias("bad")]
    return rows.groupBy("host", "path").agg(*total, *ends)


#: Elements that may hold a page's main text as a whole.
CONTAINERS = frozenset("html body main article section div center table tbody tr td form".split())
#: A slot is entered if it has this share of the variable text, and of the main headings, that a page has in the slot around it.
MOST = 0.6


def _prefixes(path: Column) -> Column:
    """(depth, slot) of the path and all paths around it, outermost first."""
    parts = F.split(path, "/")
    return F.posexplode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.xxhash64(F.array_join(F.slice(parts, F.lit(1), k), "/")))).alias("depth", "around")


def _slots(every: DataFrame, least_pages: int, support: float) -> DataFrame:
    """(host, path, slot, pages, ...) of tokens in valid classes that occur once on each page of their class."""
    host = Window.partitionBy("host")
    toks = every.withColumn("of", F.max("pages").over(host))
    toks = toks.filter((F.col("of") >= least_pages) | F.col("host").isNull())
    toks = toks.filter((F.col("pages") >= F.least(F.col("of"), F.lit(least_pages))) & (F.col("pages") >= F.col("of") * support))
    # equal vectors make a class
    cls = Window.partitionBy("host", "v1", "v2", "pages")
    toks = toks.withColumn("size", F.count("*").over(cls))
    # valid: least and greatest first places put the tokens of a class in one order
    low, high = (F.row_number().over(cls.orderBy(c, "path")) for c in ("first_min", "first_max"))
    toks = toks.withColumn("low", low).withColumn("high", high).withColumn("valid", F.min((F.col("low") == F.col("high")).cast("int")).over(cls) == 1)
    name = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^[^.#]*", 0)
    toks = toks.filter("valid and size > 1 and once = pages").withColumn("name", name).filter(~F.col("name").isin(*INLINE))
    return toks.select("host", "path", F.xxhash64("path").alias("slot"), "name", "pages", "main", "bad", "page_min", "page_max")


def templates(pages: DataFrame, least_pages: int = 3, support: float = 0.05) -> DataFrame:
    """(host, main array<string>, drop array<string>, keep array<string>): the slots of each host's template; host null: of all pages.
    keep: slots inside those of drop that aren't boilerplate."""
    every = stored(tokens(pages), "tokens")
    slots = stored(_slots(every, least_pages, support), "slots")
    of = slots.select(F.col("host").alias("h"), F.col("slot").alias("s"), F.col("pages").alias("slot_pages"), (F.col("page_min") == F.col("page_max")).alias("copies"))
    same = F.col("text_min") == F.col("text_max")
    texts = every.filter("chars > 0 and not bad").select("host", F.xxhash64("path").alias("at"), F.col("pages").alias("n"), "chars", "links", same.alias("same"), F.col("path").rlike(r"/h1(?:[.#/]|$)").alias("heading"), _prefixes(F.col("path")))
    inside = stored(texts.join(of, texts["host"].eqNullSafe(F.col("h")) & (F.col("around") == F.col("s"))), "inside")
    # the slot next around each text, and what belongs to it
    next_to = inside.groupBy("host", "at").agg(F.max_by(F.struct("s", "chars", "links", (F.col("same") & (F.col("n") == F.col("slot_pages"))).alias("same")), "depth").alias("x"))
    own = next_to.groupBy(F.col("host").alias("h"), F.col("x.s").alias("s")).agg(F.sum("x.chars").alias("chars"), F.sum("x.links").alias("links"), F.min("x.same").alias("same"))
    # all variable text inside each slot, a page; copies of one page don't tell what is constant
    varies = (~F.col("same") | F.col("copies")) & (F.col("links") * 2 <= F.col("chars"))
    mass = inside.groupBy(F.col("host").alias("h"), F.col("s")).agg((F.sum(F.when(varies, F.col("chars")).otherwise(0)) / F.first("slot_pages")).alias("mass"), (F.sum(F.when(varies & F.col("heading"), F.col("chars")).otherwise(0)) / F.first("slot_pages")).alias("headings"))
    on = slots["host"].eqNullSafe(F.col("h")) & (slots["slot"] == F.col("s"))
    slots = slots.join(own, on, "left").drop("h", "s")
    slots = slots.join(mass, slots["host"].eqNullSafe(F.col("h")) & (slots["slot"] == F.col("s")), "left").drop("h", "s")
    slots = stored(slots.fillna(0, ["mass", "headings"]), "masses")
    mains = _mains(slots)
    constant = F.col("same") & (F.col("page_min") < F.col("page_max"))
    linked = F.col("links") > F.col("chars") * 0.5
    judged = F.coalesce(~F.col("bad") & (constant | linked) & ~F.col("name").isin("html", "body"), F.lit(False))
    slots = slots.join(mains, slots["host"].eqNullSafe(F.col("h")) & (slots["slot"] == F.col("s")), "left").withColumn("is_main", F.col("s").isNotNull())
    slots = slots.withColumn("is_drop", ~F.col("main") & (F.col("bad") | judged)).withColumn("is_keep", ~F.col("is_drop") & ~F.col("bad"))
    paths = lambda flag: F.array_sort(F.collect_set(F.when(F.col(flag), F.col("path"))))
    out = slots.groupBy("host").agg(paths("is_main").alias("main"), paths("is_drop").alias("drop"), paths("is_keep").alias("keep"))
    return out.withColumn("keep", F.filter("keep", lambda k: F.exists("drop", lambda d: F.startswith(k, F.concat(d, F.lit("/"))))))


def _mains(slots: DataFrame) -> DataFrame:
    """(h, s): the main slots of (host, slot, path, name, bad, mass, headings)."""
    boxes = slots.filter(F.col("name").isin(*CONTAINERS) & ~F.col("bad"))
    of = boxes.select(F.col("host").alias("h"), F.col("slot").alias("s"), F.col("mass").alias("m"), F.col("headings").alias("g"))
    chain = boxes.select("host", "slot", "name", "mass", "headings", F.size(F.split("path", "/")).alias("own"), _prefixes(F.col("path")))
    chain = stored(chain.join(of, chain["host"].eqNullSafe(F.col("h")) & (F.col("around") == F.col("s"))).withColumn("itself", F.col("around") == F.col("slot")), "chain")
    parent = chain.groupBy("host", "slot").agg(F.max_by(F.struct("m", "g"), F.when(~F.col("itself"), F.col("depth"))).alias("p"), F.first("mass").alias("mass"), F.first("headings").alias("headings"))
    fits = (F.col("mass") > 0) & (F.col("mass") >= F.col("p.m") * MOST) & (F.col("headings") >= F.col("p.g") * MOST)
    entered = parent.select(F.col("host").alias("eh"), F.col("slot").alias("es"), F.coalesce(F.col("p").isNull() | fits, F.lit(True)).alias("fits"))
    way = chain.join(entered, F.col("host").eqNullSafe(F.col("eh")) & (F.col("around") == F.col("es"))).groupBy("host", "slot").agg(F.min("fits").alias("reached"))
    reached = way.filter("reached").select(F.col("host").alias("rh"), F.col("slot").alias("rs"))
    above = chain.filter("not itself").join(reached, F.col("host").eqNullSafe(F.col("rh")) & (F.col("slot") == F.col("rs"))).select(F.col("host").alias("ah"), F.col("around").alias("as_")).distinct()
    ends = reached.join(above, F.col("rh").eqNullSafe(F.col("ah")) & (F.col("rs") == F.col("as_")), "left_anti").select(F.col("rh").alias("h"), F.col("rs").alias("s"))
    # an element that says it is the main text takes the place of a slot around it or inside it
    said = boxes.filter(F.col("name").isin("article", "main")).select(F.col("host").alias("h"), F.col("slot").alias("s"))
    pairs = chain.filter("not itself").select("host", F.col("slot").alias("lower"), F.col("around").alias("upper"))
    near = lambda mine, other: pairs.join(said, pairs["host"].eqNullSafe(F.col("h")) & (F.col(mine) == F.col("s"))).select(F.col("host").alias("nh"), F.col(other).alias("ns"))
    replaced = near("lower", "upper").unionByName(near("upper", "lower")).distinct()
    return ends.join(replaced, F.col("h").eqNullSafe(F.col("nh")) & (F.col("s") == F.col("ns")), "left_anti").unionByName(said).distinct()


#: The columns of a template.
SLOTS = ("main", "drop", "keep")


def extract(pages: DataFrame, least_pages: int = 3, support: float = 0.05, broadcast_hosts: int = 20_000) -> DataFrame:
    """(page_id, url, text) for each row of pages (page_id, url, html)."""
    found = stored(templates(pages, least_pages, support), "templates")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    common = found.filter("host is null").first()
    default = tuple(frozenset(common[k]) for k in SLOTS) if common else ()
    own = found.filter("host is not null")
    few = own.count() <= broadcast_hosts
    known = pages.sparkSession.sparkContext.broadcast({r["host"]: tuple(frozenset(r[k]) for k in SLOTS) for r in own.toLocalIterator()} if few else {})
    if not few:
        rows = rows.withColumn("host", host_and_path(F.col("url"))[0]).join(own, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            urls = b.column("url").to_pylist()
            if few:
                slots = [known.value.get(split_url(u)[0], default) for u in urls]
            else:
                slots = [default if x[0] is None else tuple(map(frozenset, x)) for x in zip(*(b.column(k).to_pylist() for k in SLOTS), strict=True)]
            texts = [main_text(page, *s) for page, s in zip(b.column("html").to_pylist(), slots, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return in_batches(rows, run, "page_id long, url string, text string")
