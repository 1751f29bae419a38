"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree: a node is an element at a path of tags and class
names. Its presentation importance is the entropy of the child sequences it shows over the host's
pages, its content importance falls with the entropy of its text blocks over the pages: blocks
that return on page after page carry no content. Branches of low composite importance are removed
from every page, and the rest is printed block by block.

What the mark-up itself says sets the presentation importance: 1 inside ``article`` and ``main``,
and 0, for node and branch, where tag, role or class name tell navigation, adverts and the like.
A name that holds such a word among others leaves the branch to its content importance. A name of
such words alone, if they have no other sense, drops the branch, unless it holds the page's ``main`` or its only articles, or
branches of this word hold most of the page's distinct text (adverts and consent never do; on a
page with one article or ``main`` outside of such branches, the text inside counts).
Articles and ``main`` are in the tree too; their text stays where low nodes hold most of it, as on
copies of a page. A page whose ``article`` elements (or else those and ``main``) hold half or more
of the text that the tree keeps prints these only.

Cases: null and empty HTML gives empty text, a null or odd URL belongs to the host '', a null id is
carried along; a page that is alone on its host has full content importance; unclosed and misnested
tags are read as far as they go, pages of any length whole; a node with just the threshold's
importance (a tie) stays; repeated rows count in the tree as often as they occur and give repeated
results; an empty table gives no rows; columns that are not kept play no part, whatever their names.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, as_bytes, map_texts, slices

#: Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript noembed noframes textarea title iframe xmp head".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr "
    "math semantics annotation mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom menclose mfenced mmultiscripts mprescripts none".split()
)
CLOSED_BY = {
    "p": set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option"},
}
#: What tells a branch that is no main text. The second holds outside of articles only.
NOISE_TAGS = set("nav footer aside button dialog menu select datalist template".split())
OUTER_NOISE_TAGS = {"header"}
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup signin login register share sharing social related recommended recommendations trending comment "
    "comments commentlist reply replies respond disqus pagination pager toolbar widget widgets skip".split()
)
OUTER_NOISE_WORDS = set("header banner topbar search".split())
#: These hold no main text, however long they are.
SURE_WORDS = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr".split())
#: Alone in a name inside of an article, these may as well tell its subject.
SUBJECT_WORDS = set("skip register login related recommended recommendations share sharing social alert notice notices trending widget widgets subscription menu".split())
#: Words that say nothing about what a branch holds.
NEUTRAL_WORDS = set(
    "area areas bar bars block blocks body bottom box button buttons col column count container element embed fixed floating form global group header heading "
    "icon icons inline inner item items left link links list main media message module outer page panel policy popover post posts primary row secondary "
    "section site slot sticky title tool tools top text unit us wrap wrapper id js css mobile desktop".split()
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
#: Branches that are no text, if they end at all.
SHUT = set("select datalist template".split())
_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW | SHUT}

#: Marks of branches. FORM: inside a form, which some sites wrap around the whole page.
PLAIN, MAIN, NOISE, FORM = 0, 1, 2, 3
#: What a node's names say in the style tree, besides PLAIN and MAIN.
VAGUE = 4


def sign(*parts) -> int:
    """Signed 64-bit hash."""
    h = xxhash.xxh64_intdigest("\x1f".join(map(str, parts)))
    return h - (1 << 64) if h >> 63 else h


#: Of a low node in a broadcast table, with what holds it; and tasks that a host's pages are dealt to
#: where the table is too large for that.
_LOW_BYTES, _SALTS = 128, 32


class Node:
    __slots__ = ("tag", "key", "mark", "zone", "children", "parent", "words", "vague")

    def __init__(self, tag: str, key: int, mark: int, zone: str, parent: Node | None = None, words=frozenset(), vague: bool = False):
        #: mark: of the branch; zone: article, main or ''; words: of its own names, that tell noise;
        #: vague: names of the branch hold such words among others.
        self.tag, self.key, self.mark, self.zone, self.children = tag, key, mark, zone, []
        self.parent, self.words, self.vague = parent, words, vague


def element(tag: str, attributes: str, parent: Node) -> Node:
    names, role = [], ""
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
            if m[1].lower() == "role":
                role = value.strip().lower()
            else:
                names.append(value)
    label = _DIGITS.sub("0", " ".join(names))
    key = sign(parent.key, tag, label, role)
    zone = parent.zone
    if tag == "article":
        zone = "article"
    elif zone != "article" and (tag == "main" or role == "main"):
        zone = "main"
    mark = parent.mark
    if mark == FORM and tag in ("article", "main"):
        mark = MAIN
    words, vague = set(), parent.vague
    if mark not in (NOISE, FORM) and tag not in ("html", "body", "main"):
        known = NOISE_WORDS if zone else NOISE_WORDS | OUTER_NOISE_WORDS
        # An article's class names also tell about its page; only whole names count there.
        for name in (t for n in names for t in n.split()):
            parts = {name.lower()} if tag == "article" else {w.lower() for w in _WORD.findall(name)}
            noise = parts & known
            if noise and not (zone and parts <= SUBJECT_WORDS) and all(w in known or w in NEUTRAL_WORDS or w.isdigit() for w in parts):
                words |= noise
            elif noise:
                vague = True
        if tag in OUTER_NOISE_TAGS and not zone:
            words.add(tag)
        if tag in NOISE_TAGS or role in NOISE_ROLES:
            mark = NOISE
        elif tag == "form":
            mark = FORM
    if mark not in (NOISE, FORM) and zone:
        mark = MAIN
    return Node(tag, key, mark, zone, parent, frozenset(words), vague)


def settle(blocks: list[tuple[Node, str]], nodes: list[Node]) -> None:
    """Mark the branches that their names tell to be noise, as far as the whole page bears it out."""
    if not any(x.words for x in nodes):
        return
    above = {None: frozenset()}
    for x in nodes:  # parents come first
        above[x] = above.get(x.parent, above[None]) | x.words
    # One article or main without such names around is the place of the main text; only what
    # is inside counts then.
    clean = [x for x in nodes if x.tag in ("article", "main") and x.mark != NOISE and not above[x]]
    sure = any(x.tag == "main" for x in clean) or len(clean) == 1
    sizes, total, seen = Counter(), 0, set()
    for x, t in blocks:
        if x.mark != NOISE and t not in seen and (x.zone or not sure):
            seen.add(t)
            total += len(t)
            for w in above.get(x, ()):
                sizes[w] += len(t)
    over = {w for w, c in sizes.items() if 2 * c > total and w not in SURE_WORDS}
    zones = [x for x in nodes if x.tag in ("article", "main") and x.mark != NOISE and not x.words - over]
    held = [x for x in zones if x.tag == "main"]
    if not any(not above[x] - over for x in zones):
        held = zones
    free = set()
    for x in held:
        x = x.parent
        while x is not None and x not in free:
            free.add(x)
            x = x.parent
    noise = set()
    for x in nodes:
        if x.parent in noise or x not in free and x.words - over:
            noise.add(x)
            x.mark = NOISE


def parse(text: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """The text blocks of a page in order, each with its element, and all structural elements."""
    root = Node("", 0, PLAIN, "")
    stack, blocks, nodes = [root], [], []
    pieces: list[str] = []
    at, n, endless = 0, len(text), set()

    def block():
        if pieces:
            joined = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if joined:
                blocks.append((stack[-1], joined))

    while at < n:
        m = _TAG.search(text, at)
        if m is None:
            pieces.append(text[at:])
            break
        if m.start() > at:
            pieces.append(text[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[1] or m[4])
        if tag in RAW:
            if tag == "head":
                # Its content is no text; a body may begin without an end of the head.
                block()
                continue
            if not closing and not (m[3] or m[6] or "").endswith("/"):
                # Without an end it is no element; its text is read like any other.
                end = None if tag in endless else _END[tag].search(text, at)
                if end is None:
                    endless.add(tag)
                else:
                    at = end.start()
            continue
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            continue
        block()
        if tag in SHUT and not closing and (tag in endless or _END[tag].search(text, at) is None):
            endless.add(tag)
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1].tag, ()):
            stack.pop()
        stack[-1].children.append(tag)
        node = element(tag, m[3] or m[6] or "", stack[-1])
        nodes.append(node)
        if tag not in VOID:
            stack.append(node)
    block()
    settle(blocks, nodes)
    return blocks, nodes


def host(url: bytes | None) -> str:
    try:
        return (urlsplit(url.decode("utf-8", "replace")).hostname or "") if url else ""
    except ValueError:
        return ""


def main_text(page: str, low: set[int]) -> str:
    """low: nodes of low importance on the page's host."""
    blocks, _ = parse(page)
    shown = [(node, t, node.key not in low) for node, t in blocks if node.mark in (MAIN, PLAIN)]
    held = sum(len(t) for node, t, _ in shown if node.mark == MAIN)
    if 2 * sum(len(t) for node, t, high in shown if node.mark == MAIN and high) < held:
        shown = [(node, t, high or node.mark == MAIN) for node, t, high in shown]
    kept = [(node, t) for node, t, high in shown if high]
    total = sum(len(t) for _, t in kept)
    for zones in (("article",), ("article", "main")):
        inside = [t for node, t in kept if node.zone in zones]
        if inside and 2 * sum(map(len, inside)) >= total:
            return "\n".join(inside)
    return "\n".join(t for _, t in kept)


def style_tree(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, node, kind, feature, total, weight, pages): how often each feature of each node
    occurs on the host's pages. kind 0: the node itself, its feature what its names say, 1: child
    sequences, 2: texts.
    weight: the sum of c ln c over the counts c of single pages."""

    def run(batches):
        for batch in batches:
            sums: dict[tuple, list] = {}
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blocks, nodes = parse(page or "")
                seen = Counter()
                for key, said in {(x.key, VAGUE if x.vague else x.mark) for x in nodes if x.mark in (PLAIN, MAIN)}:
                    seen[(name, key, 0, said)] = 1
                for x in nodes:
                    if x.children and x.mark in (PLAIN, MAIN):
                        seen[(name, x.key, 1, sign(*x.children))] += 1
                for node, t in blocks:
                    if node.mark in (PLAIN, MAIN):
                        seen[(name, node.key, 2, sign(t))] += 1
                for k, c in seen.items():
                    s = sums.setdefault(k, [0, 0.0, 0])
                    s[0] += c
                    s[1] += c * math.log(c)
                    s[2] += 1
            if sums:
                keys = list(zip(*sums))
                values = list(zip(*sums.values()))
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*keys, *values], kinds)], names=names)

    names = ["host", "node", "kind", "feature", "total", "weight", "pages"]
    schema = "host string, node long, kind int, feature long, total long, weight double, pages long"
    once = pages.select("host", F.col(html_col)).mapInArrow(run, schema)
    return once.groupBy("host", "node", "kind", "feature").agg(*[F.sum(c).alias(c) for c in names[4:]])


def importance(tree: DataFrame, damping: float = 0.9) -> DataFrame:
    """(host, node, importance) of the nodes that are not noise."""
    m = F.max(F.when(F.col("kind") == 0, F.col("pages"))).alias("m")
    entropy = F.log("total") - F.col("weight") / F.col("total")  # of a feature over the pages
    share_log = F.when(F.col("kind") == 1, F.col("total") * F.log("total"))
    nodes = tree.groupBy("host", "node").agg(
        m,
        F.sum(F.when(F.col("kind") == 1, F.col("total"))).alias("shown"),
        F.sum(share_log).alias("shown_log"),
        F.avg(F.when(F.col("kind") == 2, entropy)).alias("entropy"),
        F.count(F.when(F.col("kind") == 2, 1)).alias("features"),
        F.max(F.when(F.col("kind") == 0, F.col("feature"))).alias("said"),
    )
    by_pages = lambda e: F.when(F.col("m") > 1, F.least(F.lit(1.0), e / F.log("m")))
    presentation = F.coalesce(by_pages(F.log("shown") - F.col("shown_log") / F.col("shown")), F.when(F.col("m") == 1, 1.0), F.lit(0.0))
    presentation = F.when(F.col("said") == VAGUE, 0.0).when(F.col("said") == MAIN, 1.0).otherwise(presentation)
    content = F.coalesce(1 - by_pages(F.col("entropy")), F.lit(1.0))
    # The more a node holds, the less its own presentation says about it.
    own = F.pow(F.lit(damping), F.least(F.col("features"), F.lit(50)))
    return nodes.where("features > 0").select("host", "node", (own * content + (1 - own) * F.greatest(presentation, content)).alias("importance"))


def extract(
    pages: DataFrame,
    threshold: float = 0.4,
    damping: float = 0.9,
    url_col: str = "url",
    html_col: str = "html",
    keep=("page_id", "url"),
    broadcast_mb: int = 64,
) -> DataFrame:
    """pages (columns keep) with text and n_chars. The low nodes of all hosts are sent to every
    task, if they take at most broadcast_mb; else pages and low nodes meet by host."""
    scratch = Scratch(pages.sparkSession, "mainhtml")

    def make():
        return lambda urls: [pa.array([host(u) for u in urls], pa.string())]

    named = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{html_col}`").cast("string").alias("page"), F.col(f"`{url_col}`").alias("link"))
    named = map_texts(named, "link", [T.StructField("host", T.StringType())], make)
    tree = style_tree(named, "host", "page")
    low = scratch.save(importance(tree, damping).where(F.col("importance") < threshold).select("host", "node"), "low")
    kept = [f"k{i}" for i in range(len(keep))]
    schema = T.StructType([T.StructField(c, pages.schema[c].dataType) for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def printed(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[*keep, "text", "n_chars"],
        )

    if low.count() * _LOW_BYTES <= broadcast_mb << 20:
        nodes: dict[str, set[int]] = {}
        for r in low.toLocalIterator():
            nodes.setdefault(r.host, set()).add(r.node)
        sent = pages.sparkSession.sparkContext.broadcast(nodes)
        none: set[int] = set()

        def run(batches):
            for batch in (part for whole in batches for part in slices(whole, len(keep))):
                rows = zip(as_bytes(batch.column(len(keep))), batch.column(len(keep) + 1).to_pylist())
                yield printed(batch, [main_text((p or b"").decode("utf-8", "replace"), sent.value.get(h, none)) for p, h in rows])

        return named.select(*kept, "page", "host").mapInArrow(run, schema)

    def meet(batches):
        """Of each host and salt its low nodes, then its pages."""
        now, held = None, set()
        for batch in (part for whole in batches for part in slices(whole, len(keep))):
            shown, texts = [], []
            for k, (p, *key, node) in enumerate(zip(as_bytes(batch.column(len(keep))), *(batch.column(len(keep) + i).to_pylist() for i in (1, 2, 3)))):
                if key != now:
                    now, held = key, set()
                if node is not None:
                    held.add(node)
                else:
                    shown.append(k)
                    texts.append(main_text((p or b"").decode("utf-8", "replace"), held))
            if shown:
                yield printed(batch.take(pa.array(shown)), texts)

    salted = named.select(*kept, "page", "host", F.pmod(F.xxhash64("page", "link"), F.lit(_SALTS)).cast("int").alias("salt"), F.lit(None).cast("long").alias("node"))
    each = low.select(*[F.lit(None).cast(pages.schema[c].dataType).alias(k) for k, c in zip(kept, keep)], F.lit(None).cast("string").alias("page"), "host", F.explode(F.array(*map(F.lit, range(_SALTS)))).alias("salt"), "node")
    return salted.unionByName(each).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("node").asc_nulls_last()).mapInArrow(meet, schema)


def query(pages: DataFrame) -> DataFrame:
    return extract(pages)
