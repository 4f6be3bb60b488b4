"""HTML extraction by site style trees.

The pages of a host are merged into one tree. A node is a path of block elements with their class, id
and role. Its content nodes are the texts found there, its presentation nodes the sequences of child
elements found there. Over the host's m distinct pages with such a node

- the importance of a content node is 1 - log_m(n), n being the distinct pages that hold it there (1: one
  page alone has it, 0: all have it);
- the importance of a presentation is the entropy of the node's child sequences to the base m (0: the
  same on every page);
- a block has content importance x (1 + presentation importance of the parent) / 2, times the weight of its
  markup: NOISE for elements and class words of menus, adverts, forms and so on, BESIDE for unmarked
  blocks of a page that has an article or main element, ARTICLE_WEIGHT inside one, else 1.

Blocks under IMPORTANT are removed from each page; a branch goes when all its blocks do. The weights only
tip the scale where entropy may speak: inside an article only what nearly all pages share goes, so copied
articles stay (pages are distinct by their text without NOISE, so copies count once). NOISE is under
IMPORTANT, as the contract excludes menus and adverts however varied, so it need not enter the tree. Nodes of fewer than LEAST_PAGES distinct
pages of a host take their importance from the tree that merges those of all hosts.

Null and empty html gives an empty text, a null url the host ''. Repeated pages each give a row. Only
page_id, url and html are read. Very long pages are parsed in one linear pass, broken markup included.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from wakeline.llm.common import materialise, table

IMPORTANT = 0.3
LEAST_PAGES = 8
NOISE, PLAIN, BESIDE, INSIDE = range(4)
ARTICLE_WEIGHT = 30.0
WEIGHTS = (0.25, 1.0, 0.5, ARTICLE_WEIGHT)
BROADCAST_KEYS = 1 << 20  # 8 MB

OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
QUOTED_END = re.compile(r"""(?>[^>"']+|"[^"]*"|'[^']*')*+>""")
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
UNSEEN = re.compile(r"""(?:^|["'\s])hidden(?=[\s=/]|$)|(?:^|\s)style\s*=\s*["']?[^"'>]*(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
WORD = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNBROKEN = frozenset("img wbr input link meta".split())  # void elements that do not end a block
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset("head script style noscript template iframe svg canvas object form button select textarea title nav footer aside menu dialog".split())
HINTS = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe comment comments replies share social related recommended widget toolbar masthead copyright".split())
ARTICLE = frozenset(("article", "main"))
UNHINTED = ARTICLE | {"html", "body"}  # whatever their class, as they hold the page's text
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def digest(*parts: str | int) -> int:
    """A signed 64-bit hash."""
    import xxhash

    h = xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


@lru_cache(maxsize=1 << 16)
def below(path: int, step: str) -> int:
    return digest(path, step)


@lru_cache(maxsize=64)
def closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)


def tags(page: str):
    """(text before, closing, name, attributes) of each tag in one pass; the name is '' at the end and for comments."""
    at, end, last = 0, len(page), page.rfind(">")
    quotes = cdata = True  # whether quoted attributes and CDATA sections still end somewhere
    text = 0
    while True:
        m = OPEN.search(page, at)
        if m is None or m.start() > last and not m[1]:
            yield page[text:], "", "", ""
            return
        if m[1]:
            stop = page.find("-->", m.end())
            stop = end if stop < 0 else stop + 3
        elif m[2] and cdata and (stop := page.find("]]>", m.end())) >= 0:
            stop += 3
        elif m[2] or m[3]:
            cdata = cdata and not m[2]
            stop = page.find(">", m.end()) + 1
        else:
            close = QUOTED_END.match(page, m.end()) if quotes else None
            quotes = close is not None
            stop = close.end() if close else page.find(">", m.end()) + 1
            yield page[text : m.start()], m[4], m[5].lower(), page[m.end() : stop - 1]
            text = at = stop
            name = m[5].lower()
            if name in RAW and not m[4]:
                shut = closing(name).search(page, at)
                at = page.find(">", shut.end()) + 1 if shut else 0
                text = at = at or end
            continue
        yield page[text : m.start()], "", "", ""
        text = at = stop


class Node:
    __slots__ = ("name", "path", "shown", "style", "inline")

    def __init__(self, name: str, path: int, shown: int, inline: bool = False):
        self.name, self.path, self.shown, self.style, self.inline = name, path, shown, 0, inline


def parse(page: str) -> tuple[list[tuple[int, int, int, str]], set[tuple[int, int]]]:
    """Blocks (path, parent's path, kind of markup, text) in page order, and (path, child sequence) of inner nodes."""
    out: list[tuple[int, int, int, str]] = []
    styles: set[tuple[int, int]] = set()
    parts: list[str] = []
    stack = [Node("", 0, PLAIN)]
    opened: dict[str, int] = {}

    def flush() -> None:
        text = "".join(parts)
        parts.clear()
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if text:
            block = [n for n in stack[-2:] if not n.inline] or stack[-1:]
            out.append((block[-1].path, block[0].path, stack[-1].shown, text))

    def pop() -> None:
        n = stack.pop()
        opened[n.name] -= 1
        if n.style:
            styles.add((n.path, n.style))

    def push(n: Node) -> None:
        if not n.inline:
            stack[-1].style = below(stack[-1].style, n.name)
        stack.append(n)
        opened[n.name] = opened.get(n.name, 0) + 1

    for before, shut, name, attributes in tags(page):
        top = stack[-1]
        if before and top.shown != NOISE:
            parts.append(before)
        if not name:
            continue
        if name in INLINE:
            if shut:
                if top.inline and top.name == name:
                    pop()
            elif attributes and (UNSEEN.search(attributes) or hinted(attributes)):
                push(Node(name, top.path, NOISE, True))
            elif top.inline and top.name == name:
                push(Node(name, top.path, NOISE, True))  # nested, so that the outer one stays open
            continue
        if name in UNBROKEN:
            continue
        flush()
        if name in RAW:
            continue
        if shut:
            if opened.get(name):
                while stack[-1].name != name:
                    pop()
                pop()
            continue
        if name in VOID:
            continue
        if name in P_ENDS and top.name == "p" or top.name in CLOSES.get(name, ()):
            pop()
            if name == "tr" and stack[-1].name == "tr":
                pop()
        if name == "body" and opened.get("head"):  # ends a head that is left open
            while stack[-1].name != "head":
                pop()
            pop()
        top = stack[-1]
        marks = "".join(f"[{k.lower()}={a or b or c}]" for k, a, b, c in NAMED.findall(attributes)) if attributes else ""
        shown = top.shown
        if shown != NOISE:
            if name in DROPPED or attributes and (UNSEEN.search(attributes) or name not in UNHINTED and hinted(attributes)) or name == "header" and shown != INSIDE:
                shown = NOISE
            elif name in ARTICLE:
                shown = INSIDE
        push(Node(name, below(top.path, name + marks), shown))
    flush()
    while len(stack) > 1:
        pop()
    if any(b[2] == INSIDE for b in out):
        out = [(p, q, BESIDE if s == PLAIN else s, t) for p, q, s, t in out]
    return out, styles


def hinted(attributes: str) -> bool:
    return any(not HINTS.isdisjoint(WORD.findall((a or b or c).lower())) for _, a, b, c in NAMED.findall(attributes))


def host() -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


PARSED = (
    "row long, page_id long, url string, host string, sign long, "
    "blocks array<struct<path:long,parent:long,shown:int,content:long,text:string>>, styles array<struct<path:long,style:long>>"
)


def parsed(pages: DataFrame) -> DataFrame:
    """Each page's blocks outside NOISE and child sequences; `sign` tells distinct pages, `row` numbers them once written."""
    block = pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("shown", pa.int32()), ("content", pa.int64()), ("text", pa.string())])
    style = pa.struct([("path", pa.int64()), ("style", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            blocks, styles, signs = [], [], []
            for page in b.column("html").to_pylist():
                found, seen = parse(page or "")
                kept = [(p, q, s, digest(t), t) for p, q, s, t in found if s != NOISE]
                blocks.append([dict(zip(("path", "parent", "shown", "content", "text"), x)) for x in kept])
                styles.append([{"path": p, "style": s} for p, s in seen])
                signs.append(digest(*(x[3] for x in kept)))
            rows = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            arrays = [rows, b.column("page_id"), b.column("url"), b.column("host"), pa.array(signs, pa.int64()), pa.array(blocks, pa.list_(block)), pa.array(styles, pa.list_(style))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "page_id", "url", "host", "sign", "blocks", "styles"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host().alias("host")).mapInArrow(run, PARSED)


CONTENT, PLACE, STYLE = range(3)  # kinds of counted nodes


def node_counts(seen: DataFrame) -> DataFrame:
    """host, kind, path, value, n: a host's distinct pages with a text (CONTENT) or child sequence (STYLE) at a path, or with the path (PLACE)."""
    mark = lambda b: F.element_at(F.array(*(F.lit(1 << i) for i in range(len(WEIGHTS)))), b["shown"] + 1)
    node = lambda kind, path, parent, value, shown: F.struct(F.lit(kind).alias("kind"), path.alias("path"), parent.alias("parent"), value.alias("value"), shown.alias("shown"))
    zero = F.lit(0).cast("long")
    contents = F.transform("blocks", lambda b: node(CONTENT, b["path"], b["parent"], b["content"], mark(b)))
    places = F.transform("blocks", lambda b: node(PLACE, b["path"], b["parent"], zero, mark(b)))
    styles = F.transform("styles", lambda s: node(STYLE, s["path"], s["path"], s["style"], F.lit(0)))
    pages = seen.select(F.xxhash64("host").alias("host"), "sign", F.array_distinct(F.concat(contents, places, styles)).alias("nodes")).dropDuplicates(["host", "sign"])
    nodes = pages.select("host", F.explode("nodes").alias("x")).select("host", "x.*")
    return nodes.groupBy("host", "kind", "path", "value").agg(F.count("*").alias("n"), F.min("parent").alias("parent"), F.bit_or("shown").alias("shown"))


def templates(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, m, presentation (importance of the parent's), shown: the nodes of a tree without their texts."""
    n, m = F.col("n").cast("double"), F.sum("n").cast("double")
    spread = F.when(m <= 1, 1.0).when(F.count("*") == 1, 0.0).otherwise(1 - F.sum(n * F.log(n)) / (m * F.log(m)))
    styles = counts.filter(F.col("kind") == STYLE).groupBy(*keys, F.col("path").alias("parent")).agg(spread.alias("presentation"))
    places = counts.filter(F.col("kind") == PLACE).select(*keys, "path", "parent", F.col("n").cast("double").alias("m"), "shown")
    return places.join(styles, [*keys, "parent"], "left").select(*keys, "path", "m", F.coalesce("presentation", F.lit(1.0)).alias("presentation"), "shown")


def style_tree(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places (host, path, presentation, shown) and content nodes (host, path, content, n, importance, shown), the weight of the markup not in it."""
    wide = materialise(counts.groupBy("kind", "path", "value").agg(F.sum("n").alias("n"), F.min("parent").alias("parent"), F.bit_or("shown").alias("shown")), "wide")
    own, over = templates(counts, ["host"]), templates(wide, []).select("path", F.col("m").alias("wide_m"), F.col("presentation").alias("wide_presentation"))
    few = F.col("m") < LEAST_PAGES
    places = own.join(over, "path").select("host", "path", few.alias("few"), F.when(few, F.col("wide_m")).otherwise(F.col("m")).alias("m"), F.when(few, F.col("wide_presentation")).otherwise(F.col("presentation")).alias("presentation"), "shown")
    places = materialise(places, "places")
    contents = counts.filter(F.col("kind") == CONTENT).select("host", "path", F.col("value").alias("content"), F.col("n").cast("double").alias("n"), "shown")
    contents = contents.join(places.drop("shown"), ["host", "path"])
    known = wide.filter(F.col("kind") == CONTENT).select("path", F.col("value").alias("content"), F.col("n").cast("double").alias("wide_n"))
    both = contents.filter("not few").unionByName(contents.filter("few").drop("n").join(known, ["path", "content"]).withColumnRenamed("wide_n", "n"))
    alone = F.when(F.col("m") > 1, 1 - F.log("n") / F.log("m")).otherwise(1.0)
    return places, both.select("host", "path", "content", "n", (alone * (1 + F.col("presentation")) / 2).alias("importance"), "shown")


def low_nodes(seen: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """key of what goes: places where not even a text of its own is important enough, and content nodes that pages share."""
    places, contents = style_tree(materialise(node_counts(seen), "nodes"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("kind") + 1)
    kinds = F.explode(F.array_compact(F.array(*(F.when(F.col("shown").bitwiseAND(1 << k) > 0, k) for k in range(len(weights)))))).alias("kind")
    bare = places.select("host", "path", "presentation", kinds).filter(weight * (1 + F.col("presentation")) / 2 < IMPORTANT)
    shared = contents.filter("n > 1").select("host", "path", "content", "importance", kinds).filter(weight * F.col("importance") < IMPORTANT)
    return bare.select(F.xxhash64("host", "path", "kind").alias("key")).unionAll(shared.select(F.xxhash64("host", "path", "kind", "content").alias("key"))).distinct()


def extract(pages: DataFrame, weights: tuple[float, ...] = WEIGHTS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """page_id, url, text per page."""
    seen = materialise(parsed(pages), "parsed")
    low = materialise(low_nodes(seen, weights), "low")
    own = F.xxhash64("host")
    keys = lambda b: (F.xxhash64(own, b["path"], b["shown"]), F.xxhash64(own, b["path"], b["shown"], b["content"]))
    blocks = F.transform("blocks", lambda b: F.struct(keys(b)[0].alias("place"), keys(b)[1].alias("node"), b["text"].alias("text")))
    rows = seen.select("row", "page_id", "url", blocks.alias("blocks"))
    texts = lambda kept: F.array_join(F.transform(kept, lambda b: b["text"]), " ").alias("text")
    n = low.count()
    if not n:
        return rows.select("page_id", "url", texts(F.col("blocks")))
    if n <= broadcast_keys:
        shared = pages.sparkSession.sparkContext.broadcast(np.sort(low.toArrow()["key"].to_numpy()))  # at most broadcast_keys longs

        def run(batches):
            low = shared.value
            for b in batches:
                blocks = b.column("blocks")
                place, node, text = (blocks.flatten().field(i) for i in range(3))
                keep = np.ones(len(text), bool)
                for key in (np.asarray(place), np.asarray(node)):
                    keep &= low[np.minimum(np.searchsorted(low, key), len(low) - 1)] != key
                ends = np.concatenate([[0], np.cumsum(keep)])[np.asarray(blocks.offsets) - blocks.offsets[0].as_py()]
                kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), text.filter(pa.array(keep)))
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pc.binary_join(kept, " ")], ["page_id", "url", "text"])

        return rows.mapInArrow(run, "page_id long, url string, text string")
    every = rows.select("row", F.explode(F.concat("blocks.place", "blocks.node")).alias("key"))
    hit = every.join(low, "key").groupBy("row").agg(F.collect_set("key").alias("low"))  # a page's own nodes at most
    kept = F.filter("blocks", lambda b: F.col("low").isNull() | ~(F.array_contains("low", b["place"]) | F.array_contains("low", b["node"])))
    return rows.join(hit, "row", "left").select("page_id", "url", texts(kept))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
