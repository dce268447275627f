"""Main text of web pages by a site style tree.

A page is read into a tree of elements (missing end tags are closed as browsers do for paragraphs,
list items and table cells). The style of an element is its tag with class, id and role; the style
path of a node is the styles from the root down. Pages of one host are merged: for each style path
the tree counts on how many pages it stands, and on how many pages each *presentation* (the sequence
of child styles, runs of one style as one) and each *content* (hash of the text below) occurs. A page
counts once for each of them, however often it repeats them.

Importance of a node on m pages: H is the entropy of its presentations (over their T occurrences, to
base T), C = 1 - the mean of log_m(pages that share the content) over the occurrences of its contents;
``importance = (1 - GAMMA) * H + GAMMA * C``. On fewer than ``LEAST_PAGES`` pages there is nothing to
compare and it is 1. A branch (a node that begins a block) is removed if its importance is below
``LEAST_SHARE`` of that of the whole page, so pages of a host that are copies of each other lose
nothing. Whole pages are merged, but for scripts, styles and hidden elements, which are no text.

Names are a prior: a branch whose style names it as navigation, header, footer, notice, advert, form,
comment and the like weighs ``NAMED`` times the page's importance at most, which is below the bar, so
it falls on every host, and its text does not count for the branches around it. Only whole names say
that (``site-footer``, ``adBox``), not parts of others (``has-sidebar``, ``share-price``). The prior
never takes the body, nor a branch that holds more than half of the page's text outside removed
branches. :func:`style_tree` tells the importance of every branch and what of it is removed.

The counts are aggregated by (host, path, content) before they are by (host, path), so a hot host
spreads over its contents. What returns to the pages is one row for each host and path that its own
importance removes; the prior needs none. That list is broadcast while it has ``BROADCAST_PATHS`` rows
at most (16 bytes each) and joined beyond; both ways give the same texts.

Blocks of the rest are joined in page order by two line feeds; inside a block character references
are decoded and each run of white space is one space. Reading, hashing and writing a page take time
in proportion to its length, however deep its elements are nested.

Defined cases: null and empty pages give empty text; pages without host form the host ''; repeated
pages give the same text; unclosed tags, comments, scripts and cut-off pages are read to their end;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut

GAMMA, LEAST_PAGES, LEAST_SHARE, NAMED = 0.9, 2, 0.25, 0.1
#: Removed paths up to this many are broadcast (16 bytes each); more are joined by host, each host's pages in SALT parts.
BROADCAST_PATHS, SALT = 1 << 20, 64

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp".split())
SILENT = frozenset("script style noscript template head title svg math canvas object iframe audio video textarea xmp noembed noframes select option button input".split())
ASIDE = frozenset("form nav footer aside dialog menu".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Words of class, id or role that name a branch as something else than the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promos promotion banner nav navbar navigation topnav sidenav subnav menu breadcrumb breadcrumbs sidebar aside "
    "footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments disqus respond reply replies discussion pagination pager toolbar widget complementary contentinfo search hidden copyright disclaimer toc skip".split()
)
#: Words that may stand beside them in a name; any other word makes it another name.
BESIDE = frozenset(
    "a an the of to and js c box bar block wrap wrapper container panel list item items link links thread section area zone content inner outer slot unit group row col column field top bottom left right center middle main primary "
    "secondary site page global local post posts article articles entry entries story stories reader readers user users visitor form button buttons icon icons text title heading head header body footer footnote side floating fixed "
    "sticky small large big mobile desktop new your our us up in form".split()
)
_HEADER_PARENTS = frozenset(("article", "main", "section"))

# Quotes count only after an equals sign; one that is never closed reaches to the end of the page.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s\"'/>]|$)", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Node:
    tag: str
    style: str
    noise: bool
    parent: Node | None
    silent: bool = False  # no text at all; what is noise by its name alone can be spared
    inside: bool = False  # of an article or a part of it
    children: list[Node | str] = field(default_factory=list)
    path: int = 0


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@lru_cache(maxsize=1 << 14)
def names_noise(given: str) -> bool:
    """Whether a value of class, id or role names something else than the article."""
    for name in given.split():
        parts = {w.lower() for w in _WORDS.findall(name)}
        if not parts.isdisjoint(NOISE) and all(w in NOISE or w in BESIDE or w.isdigit() for w in parts):
            return True
    return False


def _element(tag: str, rest: str, parent: Node) -> Node:
    given: dict[str, str] = {}
    if rest:
        for m in _ATTRIBUTE.finditer(rest):
            given.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    named = " ".join(given.get(k, "") for k in ("class", "id", "role"))
    silent = tag in SILENT or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", given.get("style", ""), re.I))
    noise = tag in ASIDE or tag == "header" and not parent.inside or any(names_noise(given[k]) for k in ("class", "id", "role") if k in given)
    node = Node(tag, f"{tag}.{named.lower()}" if named.strip() else tag, silent or noise and tag not in ("html", "body"), parent, silent, parent.inside or tag in _HEADER_PARENTS)
    node.path = _hash(f"{parent.path}/{node.style}")
    parent.children.append(node)
    return node


def read(html: str | None) -> Node:
    """The tree of a page."""
    root = here = Node("", "", False, None)
    html = html or ""
    opened: Counter[str] = Counter()

    def up_to(node: Node | None) -> Node:
        """Close all that is open below ``node``."""
        below = here
        while below is not node and below.parent is not None:
            opened[below.tag] -= 1
            below = below.parent
        return below

    at = 0
    while at < len(html):
        m = _TOKEN.search(html, at)
        if m is None:
            here.children.append(html[at:])
            break
        if m.start() > at:
            here.children.append(html[at : m.start()])
        at = m.end()
        if m["cdata"]:
            here.children.append(m["cdata"])
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag == "br":
                here.children.append(" ")
            up: Node | None = here if opened[tag] else None
            while up is not None and up.tag != tag:
                # An end tag does not reach out of a table cell or of the blocks around an inline element.
                up = None if tag in INLINE and up.tag in CLOSES_P and up.tag != "p" else up.parent
            if up is not None and up.parent is not None:
                here = up_to(up.parent)
            continue
        if tag in CLOSES_P or tag in _GROUPS:
            here = up_to(_closed(here, tag, opened))
        if tag == "br":
            here.children.append(" ")
            continue
        node = _element(tag, m["rest"] or "", here)
        if tag in VOID or (m["rest"] or "").endswith("/") and tag in ("path", "g", "use"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            node.children.append(html[at : stop.start() if stop else len(html)])
            at = stop.end() if stop else len(html)
            continue
        here = node
        opened[tag] += 1
    return root


#: What an element ends without an end tag, and what it does not reach out of.
_GROUPS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}


def _closed(here: Node, tag: str, opened: Counter[str]) -> Node:
    """Where an element that ends others without their end tags belongs."""
    ends, stops = _GROUPS.get(tag, (("p",), ("button", "td", "th", "caption", "object")))
    if not any(opened[x] for x in ends):
        return here
    up: Node | None = here
    found: Node | None = None
    while up is not None and up.parent is not None and up.tag not in stops:
        if up.tag in ends:
            found = up
            if tag != "tr":
                break
        if tag not in _GROUPS and up.tag not in INLINE and up.tag != "p":
            break
        up = up.parent
    return found.parent if found is not None and found.parent is not None else here


def _texts(node: Node, skip: Callable[[Node], bool], out: list[str]) -> None:
    """Text of a node in blocks: block elements begin and end one."""
    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        here, k = stack.pop()
        if k >= len(here.children):
            if here.tag not in INLINE:
                out.append("\x00")
            continue
        stack.append((here, k + 1))
        child = here.children[k]
        if isinstance(child, str):
            out.append(child.replace("\x00", "�") if "\x00" in child else child)
        elif not skip(child):
            if child.tag not in INLINE:
                out.append("\x00")
            stack.append((child, 0))
        elif child.tag not in INLINE:
            out.append("\x00")


def blocks(node: Node, skip: Callable[[Node], bool]) -> list[str]:
    out: list[str] = []
    _texts(node, skip, out)
    return [t for part in "".join(out).split("\x00") if (t := _SPACE.sub(" ", unescape(part)).strip())]


def _order(root: Node, enter: Callable[[Node], bool]) -> list[Node]:
    """The nodes below ``root`` that ``enter`` lets in, each before its children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and enter(c))
    return out


def spare(root: Node, removed: frozenset[int] = frozenset()) -> None:
    """Let the branches stand that hold more than half of the text outside removed branches, whatever their names."""
    order = _order(root, lambda c: not c.silent and c.path not in removed)
    sizes: dict[int, int] = {}
    for node in reversed(order):
        sizes[id(node)] = sum(len("".join(c.split())) if isinstance(c, str) else sizes.get(id(c), 0) for c in node.children)
    for node in order:
        if 2 * sizes[id(node)] > sizes[id(root)]:
            node.noise = False


_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6".split())


def style_rows(html: str | None) -> list[tuple[int, int, int, int, int]]:
    """(path, kind, value, is the whole page, is named) of the branches of a page, each once.

    Kind 0 is a presentation, 1 a content, 2 the page itself. Contents are hashed from the leaves up.
    """
    root = read(html)
    spare(root)
    contents: dict[int, int] = {}
    out: set[tuple[int, int, int, int, int]] = set()
    for node in reversed(_order(root, lambda c: not c.silent)):
        styles: list[str] = []
        texts: list[str] = []
        for c in node.children:
            if isinstance(c, str):
                texts.extend(c.split())
                continue
            if not (styles and styles[-1] == c.style):
                styles.append(c.style)
            if not c.noise and contents.get(id(c)):
                texts.append(f"\x00{contents[id(c)]}")
        contents[id(node)] = _hash(" ".join(texts)) or 1 if texts else 0
        if node is root or not (node.tag in INLINE or node.tag in ("html", "body") or node.tag in _PLAIN and node.style == node.tag):
            top, named = int(node is root), int(node.noise)
            out |= {(node.path, 0, _hash(" ".join(styles)), top, named), (node.path, 1, contents[id(node)], top, named), (node.path, 2, 0, top, named)}
    return sorted(out)


def extract(html: str | None, removed: frozenset[int] = frozenset()) -> str:
    """The main text of a page without the branches at the paths ``removed``."""
    root = read(html)
    spare(root, removed)
    return "\n\n".join(blocks(root, lambda n: n.noise or n.path in removed))


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def _rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(h, *r) for h, html in zip(frame["host"], frame["html"], strict=True) for r in style_rows(html)]
        yield pd.DataFrame(rows, columns=["host", "path", "kind", "value", "top", "named"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, named, importance, removed, alone) of every branch. ``pages`` has host (hash) and html.

    ``named`` says that the prior holds for the branch on some page, ``removed`` that its importance is below
    the bar there, ``alone`` that it is so without the prior, on every page.
    """
    rows = pages.mapInPandas(_rows_of, "host long, path long, kind int, value long, top int, named int")
    counts = rows.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("c"), F.max("top").alias("top"), F.max("named").alias("named"))
    c = F.col("c").cast("double")
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(0.0))
    sums = counts.groupBy("host", "path").agg(
        F.max("top").alias("top"), F.max("named").alias("named"), of(2, c).alias("m"),
        *[f(k).alias(f"{n}{k}") for k in (0, 1) for n, f in (("s", lambda k: of(k, c * F.log(c))), ("t", lambda k: of(k, c)))],
    )
    shape = F.when(F.col("t0") > 1, 1 - F.col("s0") / (F.col("t0") * F.log("t0"))).otherwise(0.0)
    content = 1 - F.col("s1") / (F.col("t1") * F.log("m"))
    value = F.when(F.col("m") < LEAST_PAGES, 1.0).otherwise((1 - GAMMA) * shape + GAMMA * content)
    nodes = cut(sums.select("host", "path", "top", F.col("m").cast("long").alias("pages"), (F.col("named") == 1).alias("named"), value.alias("own")))
    tops = nodes.filter("top = 1").select("host", F.col("own").alias("best"))
    weighed = nodes.filter("top = 0").join(tops, "host")
    importance = F.when(F.col("named"), NAMED * F.least("own", "best")).otherwise(F.col("own"))
    alone = F.col("own") < LEAST_SHARE * F.col("best")
    return weighed.select("host", "path", "pages", "named", importance.alias("importance"), (F.col("named") | alone).alias("removed"), alone.alias("alone"))


def low_importance(pages: DataFrame) -> DataFrame:
    """(host, path) of the branches that their own importance removes; what the prior removes needs no list."""
    return cut(style_tree(pages).filter("alone").select("host", "path"))


def _extractor(held: Broadcast) -> Callable[..., Column]:
    @F.pandas_udf(T.StringType())
    def main_text(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, pages in parts:
            yield pd.Series([extract(p, held.value.get(h, frozenset())) for h, p in zip(hosts, pages, strict=True)], dtype=object)

    return main_text


@F.pandas_udf(T.StringType())
def _main_text_of(pages: pd.Series, removed: pd.Series) -> pd.Series:
    return pd.Series([extract(p, frozenset(() if r is None else r)) for p, r in zip(pages, removed, strict=True)], dtype=object)


def extract_pages(pages: DataFrame, broadcast_paths: int = BROADCAST_PATHS) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select("page_id", "url", "html", F.xxhash64(host(F.col("url"))).alias("host"))
    low = low_importance(rows.select("host", "html"))
    per = low.groupBy("host").agg(F.collect_set("path").alias("removed"))  # a host's paths follow its templates, not its pages
    if low.count() <= broadcast_paths:
        held = spark.sparkContext.broadcast({r["host"]: frozenset(r["removed"]) for r in per.collect()})
        done = rows.withColumn("text", _extractor(held)(F.col("host"), F.col("html")))
    else:
        salts = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
        done = salted.join(salts, ["host", "salt"], "left").withColumn("text", _main_text_of(F.col("html"), F.col("removed")))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
