"""Main text of HTML pages by a site style tree.

1. A tokenizer reads each page into its element tree. Elements that hold others (``div``,
   ``section``, ``article``, ...) are told apart by their place among such siblings; runs of
   siblings with the same class, and flow elements (``p``, ``li``, ``h2``, ...) of one kind
   under one parent, are one node. A node's identity is a hash of this path, so the
   same-host trees merge by grouping: (host, node) is a node of the site style tree.
2. Presentation importance of a node over m pages is the entropy to base m of its child
   sequences; content importance of its own text blocks is one less their mean entropy
   log(pages with the block) / log m, so a block that every page repeats counts 0 and one
   that a single page has counts 1. The importance of a node is its presentation's and
   its children's, weighed by GAMMA to the number of sequences, computed level by level
   from the leaves by grouped sums.
3. Declared nodes have a fixed importance: 0 where tag, role, class, id or opening words say
   menu, header, footer, sidebar, notice, advert, form, script or comment, or where nearly all
   text outside the article is links; 1 for ``article`` and ``main`` and the flow elements in
   them. A node goes with its branch when no node of the branch is important.

Nodes on fewer than MIN_PAGES pages of a host, and pages without a host, have nothing to
compare and keep their undeclared nodes. Where the entropies would leave less than KEEP of
a page's undeclared text (a host of copies, say), all of it stays."""
from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

GAMMA, LEAST, MIN_PAGES, KEEP = 0.9, 0.4, 3, 0.1
MAX_DEPTH = 24                  # deeper elements belong to their ancestor at this depth
BROADCAST_BYTES = 64 << 20

#: HTML elements by kind, and the words of class names, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
NOISE_TAGS = frozenset("nav aside footer header form noscript template iframe button select dialog menu svg canvas object audio video "
                       "map datalist fieldset optgroup option head".split())
MAIN_TAGS = frozenset(("article", "main"))
CONTAINERS = NOISE_TAGS | frozenset("html body div section article main table details center frameset".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption address hgroup summary "
                 "caption thead tbody tfoot tr td th".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register sidebar aside rail menu menus nav navbar "
    "navigation breadcrumb breadcrumbs masthead topbar footer copyright comment comments commentlist reply replies respond disqus discussion share sharing "
    "social related recommended recommendations trending pager pagination widget widgets toolbar skip hidden announcement announcements search "
    "searchform searchbox adsbygoogle adbox adslot skyscraper commentsection commentbox commentform colophon bottombar".split())
#: Opening words of a box that say what it is.
OPENINGS = re.compile(r"(?:\d+ )?(?:reader |user )?(?:comments?|responses|replies|kommentare?|commentaires?|comentarios?)(?: ?\(\d+\))?:?|"
                      r"advertisement|sponsored|anzeige|werbung|publicité|publicidad", re.I)
HEADER_WORDS = frozenset(("header", "head", "banner"))
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "thead": {"tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
                    r"((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"\d+")


def _hash(*parts: str | int) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def _says_noise(names: str, in_main: bool) -> bool:
    """Whether a class attribute or id names page furniture by its first or last word."""
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_\d:]+", name) if w]
        if not words or {"has", "with", "no", "without", "is"} & set(words):
            continue
        if {words[0], words[-1]} & NOISE_WORDS or not in_main and words[-1] in HEADER_WORDS:
            return True
    return False


class Element:
    __slots__ = ("tag", "sign", "up", "kids", "noise", "main", "links", "chars", "linked", "holds_main", "named")

    def __init__(self, tag: str, sign: str, up: Element | None, noise: bool = False, main: bool = False, named: bool = False):
        self.tag, self.sign, self.up, self.noise, self.main, self.named = tag, sign, up, noise, main, named
        self.kids: list[Element | list[str]] = []        # elements, and text blocks as lists of pieces
        self.links = self.chars = self.linked = 0        # characters in links, in all, blocks with links
        self.holds_main = False


class _Builder:
    """The open elements while a page is read."""

    def __init__(self):
        self.root = self.now = Element("#page", "#page", None)
        self.open: dict[str, int] = {}
        self.link = False

    def push(self, e: Element) -> None:
        e.up.kids.append(e)
        self.now = e
        self.open[e.tag] = self.open.get(e.tag, 0) + 1
        if e.main and not e.up.main:
            while (e := e.up) is not None and not e.holds_main:
                e.holds_main = True

    def close(self, e: Element) -> None:
        """End ``e`` and all that is open in it, and any link."""
        self.link = False
        while True:
            done, self.now = self.now, self.now.up
            self.open[done.tag] -= 1
            if done is e:
                return

    def nearest(self, tags: frozenset[str] | set[str], within: frozenset[str] | set[str] = frozenset()) -> Element | None:
        """The innermost open element of ``tags``, not looking out of an element of ``within``."""
        if not any(self.open.get(t) for t in tags):
            return None
        at = self.now
        while at.up is not None:
            if at.tag in tags:
                return at
            if at.tag in within:
                return None
            at = at.up
        return None

    def say(self, text: str) -> None:
        if not text:
            return
        now = self.now
        if not (now.kids and isinstance(now.kids[-1], list)):
            if text.isspace():
                return
            now.kids.append([])
        now.kids[-1].append(text)
        n = len(text.strip())
        now.chars += n
        if self.link and n:
            now.links += n
            now.linked = 1


def parse(page: str) -> Element:
    """The element tree of a page. Tags left open are closed by what cannot stand in them;
    inline elements are passed through, so their text belongs to the block around them."""
    b = _Builder()
    place, lower = 0, None
    while (t := _TOKEN.search(page, place)) is not None:
        b.say(page[place:t.start()])
        place = t.end()
        if t[2] is None:
            continue
        tag = t[2].lower()
        if t[1]:
            if tag == "a":
                b.link = False
            elif (e := b.nearest({tag})) is not None:
                b.close(e)
            continue
        if tag in VOID:
            if tag == "br":
                b.say(" ")
            elif tag == "hr":
                b.now.kids.append(Element("hr", "hr", b.now, main=b.now.main))
            continue
        if tag in RAW:                                   # nothing in it is markup
            lower = lower if lower is not None else page.lower()
            end = lower.find("</" + tag, place)
            end = page.find(">", end) if end >= 0 else -1
            place = end + 1 if end >= 0 else len(page)
            continue
        if tag == "a":
            b.link = True
        block = tag in CONTAINERS or tag in FLOW
        attrs = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTR.finditer(t[3])} if t[3] and not t[3].isspace() else {}
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        if not block and not hidden and not (names and tag != "a" and _says_noise(names, b.now.main)):
            continue                                     # inline
        if block and tag != "html":
            if tag not in NOISE_TAGS or tag in ("nav", "header", "footer", "aside"):
                if (e := b.nearest({"head"})) is not None and tag != "head":
                    b.close(e)
            if (e := b.nearest({"p"}, CONTAINERS)) is not None:
                b.close(e)
            while tag in CLOSED_BY and (e := b.nearest(CLOSED_BY[tag], SCOPE.get(tag, CONTAINERS) | CONTAINERS)) is not None:
                b.close(e)
            if tag in MAIN_TAGS and (e := b.nearest({"nav"})) is not None:
                b.close(e)
        main = b.now.main or tag in MAIN_TAGS or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
        noise = hidden or attrs.get("role", "") in NOISE_ROLES or tag in NOISE_TAGS and not (tag == "header" and b.now.main)
        if tag not in ("html", "body") and tag not in MAIN_TAGS:
            noise = noise or bool(names) and _says_noise(names, b.now.main or tag[0] == "h" and tag[1:].isdigit())
        sign = " ".join([tag, *sorted(_DIGITS.sub("#", names.lower()).split())])
        b.push(Element(tag, sign, b.now, noise, main, bool(names)))
    b.say(page[place:])
    return b.root


def _opening(e: Element) -> str:
    """The first text block of a branch, if it comes within three steps down."""
    for _ in range(4):
        if not e.kids:
            return ""
        e = e.kids[0]
        if isinstance(e, list):
            return " ".join("".join(e).split())
    return ""


def _is_box(e: Element) -> bool:
    return e.tag not in FLOW


def _names(e: Element) -> Iterator[tuple[Element, str]]:
    """Child elements with their names within the parent: others than flow elements by the
    parent's sequence of such children and the place in it, flow elements by their kind."""
    boxes, signs = [k for k in e.kids if isinstance(k, Element) and _is_box(k)], []
    place: dict[int, int] = {}
    for k in boxes:
        if not (signs and k.named and signs[-1] == k.sign):
            signs.append(k.sign)
        place[id(k)] = len(signs) - 1
    style = _hash(*signs)
    for k in e.kids:
        if isinstance(k, Element):
            yield k, f"{style} {place[id(k)]} {k.sign}" if id(k) in place else k.sign


def page_nodes(page: str) -> tuple[list[tuple], list[tuple]]:
    """(nodes, blocks) of a page. Node: id, id of its parent, depth, hash of its child sequence,
    fixed importance (0, 1 or None). Block: text, hash, id of its node, ids of the nodes from
    the root down with whose branch it goes, whether a node of them is declared noise."""
    root = parse(page)
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo += [k for k in e.kids if isinstance(k, Element)]
    for e in reversed(order):
        if e.up is not None:
            e.up.chars += e.chars
            e.up.links += e.links
            e.up.linked += e.linked

    def declared(e: Element) -> bool:
        if e.holds_main:
            return False
        if e.tag in ("form", "fieldset") and 2 * e.chars > root.chars:       # the page is within a form
            return False
        if e.noise or not e.main and e.linked >= 3 and e.links >= 0.8 * e.chars:
            return True
        return _is_box(e) and e.tag not in MAIN_TAGS and e.tag not in ("html", "body") and bool(OPENINGS.fullmatch(_opening(e)))

    nodes, blocks = {}, []
    todo = [(root, _hash("#page"), 0, 0, False, ())]
    while todo:
        e, node, up, depth, noise, path = todo.pop()
        safe = e.main and (e.tag in MAIN_TAGS or not _is_box(e)) and not noise
        if not (noise or safe or e.holds_main or e.tag in ("#page", "html", "body")) and node not in path:
            path = (*path, node)
        seq = []
        for k in e.kids:
            sign = k.sign if isinstance(k, Element) else "#text"
            if not seq or seq[-1] != sign:
                seq.append(sign)
        nodes.setdefault(node, (node, up, depth, _hash(*seq), 0.0 if noise else 1.0 if safe else None))
        names, below = _names(e), []
        for k in e.kids:
            if isinstance(k, list):
                below.append((k, node, path, noise))
                continue
            k, name = next(names)
            gone = noise or declared(k)
            if depth + 1 > MAX_DEPTH:
                below.append((k, node, up, depth, gone, path))
            else:
                below.append((k, _hash(node, name, gone, k.main), node, depth + 1, gone, path))
        todo += reversed(below)
        while todo and isinstance(todo[-1][0], list):        # text blocks come in page order
            pieces, own, above, gone = todo.pop()
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                blocks.append((text, _hash(_DIGITS.sub("#", text.lower())), own, above, gone))
    return list(nodes.values()), blocks


_LONGS = pa.list_(pa.int64())
PARSED = ("page_id long, url string, host long, nodes array<struct<id:long,up:long,depth:int,style:long,fixed:double>>, "
          "blocks array<struct<text:string,feature:long,node:long,path:array<long>,noise:boolean>>")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node = pa.struct([("id", pa.int64()), ("up", pa.int64()), ("depth", pa.int32()), ("style", pa.int64()), ("fixed", pa.float64())])
    block = pa.struct([("text", pa.string()), ("feature", pa.int64()), ("node", pa.int64()), ("path", _LONGS), ("noise", pa.bool_())])
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            got = [page_nodes(h) if h else ([], []) for h in part.column("html").to_pylist()]

            def lists(kind: pa.StructType, rows: list[list[tuple]]) -> pa.ListArray:
                flat = [r for each in rows for r in each]
                fields = [pa.array([r[i] for r in flat], f.type) for i, f in enumerate(kind)]
                off = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
                return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))

            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), part.column("host"), lists(node, [g[0] for g in got]), lists(block, [g[1] for g in got])],
                names=["page_id", "url", "host", "nodes", "blocks"])


def importance(parsed: DataFrame) -> DataFrame:
    """``host, node, importance, highest, fixed``: the site style trees of all hosts; ``highest`` is
    the greatest importance of the node and all below it. Pages without a host are left out."""
    sites = parsed.where("host is not null")
    # pages and distinct child sequences of each node
    styles = sites.select("host", F.explode(F.array_distinct("nodes")).alias("n")).groupBy(
        "host", F.col("n.id").alias("node"), F.col("n.style").alias("style")).agg(
        F.count("*").alias("c"), F.max("n.up").alias("up"), F.min("n.depth").alias("depth"), F.max("n.fixed").alias("fixed"))
    nodes = styles.groupBy("host", "node").agg(
        F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("clogc"), F.count("*").alias("l"),
        F.max("up").alias("up"), F.min("depth").alias("depth"), F.max("fixed").alias("fixed"))
    # entropy of the own text blocks: a block on k pages has the entropy log k / log m
    features = sites.select("host", F.explode(F.array_distinct(F.transform(
        "blocks", lambda b: F.struct(b["node"].alias("node"), b["feature"].alias("feature"))))).alias("f")).select("host", "f.node", "f.feature")
    texts = features.groupBy("host", "node", "feature").agg(F.count("*").alias("k")).groupBy("host", "node").agg(
        F.avg(F.log("k")).alias("spread"))
    log_m = F.log("m")
    tree = nodes.join(texts, ["host", "node"], "left").select(
        "host", "node", "up", "depth", "m", "l", "fixed",
        F.when(F.col("m") > 1, (log_m - F.col("clogc") / F.col("m")) / log_m).otherwise(1.0).alias("presentation"),
        F.when(F.col("spread").isNull(), None).when(F.col("m") > 1, 1 - F.col("spread") / log_m).otherwise(1.0).alias("content"))
    tree = stage(tree, "tree")
    deepest = tree.agg(F.max("depth")).first()[0]
    done, below = None, None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = tree.where(F.col("depth") == depth)
        if below is None:
            level = level.select("*", *[F.lit(0.0).alias(c) for c in ("w", "s", "t")])
        else:
            level = level.join(below, ["host", "node"], "left").fillna(0.0, ["w", "s", "t"])
        own, m = F.col("content").isNotNull(), F.col("m").cast("double")
        weight = F.col("w") + F.when(own, m).otherwise(0.0)
        total = F.col("s") + F.when(own, m * F.col("content")).otherwise(0.0)
        inner = F.when(weight > 0, total / weight).otherwise(F.col("presentation"))
        share = F.pow(F.lit(GAMMA), F.when(F.col("w") > 0, F.col("l")).otherwise(0))       # a leaf has no children's sequences
        value = F.when(F.col("m") < MIN_PAGES, 1.0).otherwise((1 - share) * F.col("presentation") + share * inner)
        level = level.withColumn("importance", F.coalesce("fixed", value))
        level = level.withColumn("highest", F.greatest("importance", "t"))
        below = level.groupBy("host", F.col("up").alias("node")).agg(
            F.sum(F.col("m").cast("double")).alias("w"), F.sum(F.col("m") * F.col("importance")).alias("s"), F.max("highest").alias("t"))
        rows = level.select("host", "node", "importance", "highest", "fixed")
        done = rows if done is None else done.unionAll(rows)
    if done is None:
        done = tree.select("host", "node", F.lit(1.0).alias("importance"), F.lit(1.0).alias("highest"), "fixed")
    return done


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars``: one row a page. The text's blocks stand in page order,
    one a line; references are decoded, white space is one space. Null and empty pages
    have the empty text. Repeated rows stay repeated and count as pages of their host.
    Other columns are not read."""
    url = F.col(f"`{url_col}`").cast("string")
    host = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"),
                        F.when(host != "", F.xxhash64(host)).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    parsed = stage(rows.mapInArrow(_parsed, PARSED), "parsed")
    low = stage(importance(parsed).where(F.col("fixed").isNull() & (F.col("highest") < LEAST)).select("host", "node"), "low")
    # pages of a host with the same nodes are judged once
    shape = F.xxhash64(F.transform("nodes", lambda n: n["id"]))
    shapes = parsed.where("host is not null").select("host", shape.alias("shape"), F.transform("nodes", lambda n: n["id"]).alias("ids")).groupBy(
        "host", "shape").agg(F.first("ids").alias("ids"))
    judged = stage(shapes.select("host", "shape", F.explode("ids").alias("node")).join(low, ["host", "node"]).groupBy(
        "host", "shape").agg(F.collect_set("node").alias("gone")), "judged")
    size = judged.agg(F.coalesce(F.sum(F.size("gone") * 8 + 64), F.lit(0))).first()[0]
    marked = parsed.withColumn("shape", shape).join(F.broadcast(judged) if size <= BROADCAST_BYTES else judged, ["host", "shape"], "left")
    plain = F.filter("blocks", lambda b: ~b["noise"])
    main = F.filter(plain, lambda b: ~F.arrays_overlap(b["path"], F.coalesce("gone", F.array().cast("array<long>"))))

    def chars(blocks):
        return F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b["text"]))

    kept = F.when(chars(main) < KEEP * chars(plain), plain).otherwise(main)
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    out = marked.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
