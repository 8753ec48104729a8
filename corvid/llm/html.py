"""Main text of web pages by wrapper induction.

Pages of one host share a wrapper: navigation, notices, footers. The pages of a
host are dealt into groups of bounded size (so a large host is many groups).
In a group the DOM trees are merged, one page after the other, into one tree of
slots: simple tree matching (W. Yang, 1991) aligns a page's nodes with slots,
and nodes without a slot become new ones. Text that a slot holds in all pages
is template; what varies is content. The content region is found from the slots
alone: from the root down, the child that holds most of the varying text is
entered as long as what it leaves behind is as regular as a wrapper is (each
page has the same number of blocks there). Elements and classes that name what
is no article (menus, comments, adverts) are left out inside the region, and
decide alone only where alignment cannot: a page with a marked article among fewer
than ``FEWEST`` different ones, or a page that lacks the region.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

GROUP = 32  # pages aligned with one another
BROADCAST_HOSTS = 100_000  # hosts of more than one group that are sent to all executors, at most
FEWEST = 3  # different pages from which alignment decides
CONSTANT = 5  # pages that text must be the same in, at least, to be template

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
MARK = re.compile(r"[>\"']")
ATTR = re.compile(r"""(?<!\S)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed template svg math".split())
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hr header footer nav aside form fieldset".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BARRIER = frozenset("html body article main".split())
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "caption", "thead", "tbody", "tfoot"}
DROP = frozenset("head script style noscript template textarea title iframe svg math nav footer aside form button select option input dialog menu object embed noembed xmp canvas audio video map".split())
# Words of classes, ids and roles that name parts other than the article.
OTHER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side|aside|widget|footer|foot|header|masthead|topbar|"
    r"cookie|cookies|consent|notice|notices|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comment|comments|reply|replies|respond|disqus|search|pagination|pager|copyright|legal|skip|toolbar|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


class Node:
    """A block element of a page."""

    __slots__ = ("tag", "out", "main", "kids", "texts")

    def __init__(self, tag: str, out: bool, main: bool):
        self.tag, self.out, self.main = tag, out, main  # out: no article by its own element or class; main: inside a marked article
        self.kids: list[Node] = []
        self.texts: list[tuple[int, str]] = []  # (kids before it, text): one block each


def tokens(html: str):
    """(text before, name or None, closes, attributes) of each tag, in one pass; the text after the last tag has no name.

    A tag ends at the first > outside quoted values. Comments, declarations and
    a tag that the text ends in are no tags and give nothing.
    """
    at, n, never = 0, len(html), set()
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            yield html[at:lt], None, False, ""
            at = n if end < 0 else end + 3
            continue
        if html.startswith("<![CDATA[", lt):
            end = html.find("]]>", lt)
            yield html[at:lt], None, False, ""
            at = n if end < 0 else end + 3
            continue
        if html[lt + 1 : lt + 2] in ("!", "?"):
            end = html.find(">", lt)
            yield html[at:lt], None, False, ""
            at = n if end < 0 else end + 1
            continue
        m = NAME.match(html, lt + 1)
        if not m:  # a plain <
            nxt = html.find("<", lt + 1)
            nxt = n if nxt < 0 else nxt
            yield html[at:nxt], None, False, ""
            at = nxt
            continue
        p = m.end()
        while (x := MARK.search(html, p)) and x[0] != ">":
            p = x.end()
            if x[0] not in never and html[max(m.end(), x.start() - 80) : x.start()].rstrip().endswith("="):
                close = html.find(x[0], p)
                if close < 0:
                    never.add(x[0])  # looked for once only
                else:
                    p = close + 1
        if not x:
            yield html[at:lt], None, False, ""
            return
        yield html[at:lt], m[1].lower(), html[lt + 1] == "/", html[m.end() : x.start()]
        at = x.end()
        name = m[1].lower()
        if name in RAW and html[lt + 1] != "/":
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
            at = n if not end else end.start()
    if at < n:
        yield html[at:], None, False, ""


def names_of(attributes: str) -> str:
    return " ".join(a or b or c for _, a, b, c in ATTR.findall(attributes)) if attributes else ""


def parse(html: str) -> Node:
    """A tree of block elements; text of inline elements belongs to the block around them."""
    root = Node("", False, False)
    stack = [root]
    opened = [Counter()]  # how many elements of each tag are open, since each barrier
    barriers: Counter = Counter()
    run: list[str] = []
    skips: list[str] = []  # inline elements open, from one that is no part of the article on

    def flush() -> None:
        if run:
            text = SPACE.sub(" ", unescape("".join(run))).strip()
            if text:
                stack[-1].texts.append((len(stack[-1].kids), text))
            run.clear()

    def pop() -> str:
        tag = stack.pop().tag
        if tag in BARRIER:
            opened.pop()
            barriers[tag] -= 1
        opened[-1][tag] -= 1
        return tag

    for text, tag, close, attributes in tokens(html):
        if text and not skips:
            run.append(text)
        if tag is None:
            continue
        if tag in BLOCK:
            skips.clear()
            flush()
            if close:
                if opened[-1][tag] > 0 or barriers[tag] > 0:
                    while len(stack) > 1 and pop() != tag:
                        pass
                continue
            if tag == "hr":
                continue
            if (tag in ENDS_P and stack[-1].tag == "p") or stack[-1].tag in CLOSED_BY.get(tag, ()):
                pop()
            up = stack[-1]
            names = names_of(attributes)
            out = tag in DROP or (tag == "header" and not up.main) or bool(names and tag not in BARRIER and OTHER.search(names))
            node = Node(tag, out, up.main or tag in ("article", "main"))
            up.kids.append(node)
            if not attributes.endswith("/"):
                stack.append(node)
                opened[-1][tag] += 1
                if tag in BARRIER:
                    opened.append(Counter())
                    barriers[tag] += 1
        elif close:
            if skips and tag in skips:
                while skips.pop() != tag:
                    pass
        elif tag == "br":
            run.append(" ")
        elif tag not in VOID and not attributes.endswith("/"):
            if skips:
                if len(skips) < 256:
                    skips.append(tag)
            elif tag in DROP or ((names := names_of(attributes)) and OTHER.search(names)):
                skips.append(tag)
    flush()
    return root


def walk(top):
    """A node (or slot) and all under it, parents first."""
    stack = [top]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(reversed(x.kids))


# --- alignment


class Slot:
    """What is aligned over pages: an element, or a run of neighbours of one tag that have no blocks in them."""

    __slots__ = ("tag", "kids", "leaf", "pages", "counts", "texts", "varying", "constant")

    def __init__(self, tag: str, leaf: bool):
        self.tag, self.leaf = tag, leaf
        self.kids: list[Slot] = []
        self.pages = 0
        self.counts: set[int] = set()  # how many neighbours the run has, page by page
        self.texts: Counter = Counter()  # pages that hold a text in this slot
        self.varying = 0
        self.constant: set[str] = set()


class Unit:
    """The part of a page that one slot takes: one element with blocks in it, or a run of leaves."""

    __slots__ = ("tag", "leaf", "nodes")

    def __init__(self, node: Node):
        self.tag, self.leaf, self.nodes = node.tag, not node.kids, [node]


def units(node: Node) -> list[Unit]:
    """The children to align; those out of the article by themselves take no part."""
    out: list[Unit] = []
    for k in node.kids:
        if k.out:
            continue
        if out and not k.kids and out[-1].leaf and out[-1].tag == k.tag:
            out[-1].nodes.append(k)
        else:
            out.append(Unit(k))
    return out


def parts(x) -> list:
    """Children of a slot or of a unit's element."""
    return x.kids if isinstance(x, Slot) else ([] if x.leaf else units(x.nodes[0]))


class Shapes:
    """Subtrees by number, those of equal tags under one, and the size of the largest order-keeping match of each two that were asked for.

    Pages repeat few shapes, so that each two are matched once. What is matched
    does not depend on how large it is: time and memory grow with the product of
    the numbers of different shapes that stand side by side.
    """

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.tags: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def of(self, x, seen: dict[int, int]) -> int:
        """The number of a slot's or a unit's tree; ``seen`` keeps those of slots and elements, by id()."""
        key = lambda y: id(y if isinstance(y, Slot) else y.nodes[0])
        stack = [(x, iter(parts(x)), [])]
        while True:
            top, rest, got = stack[-1]
            for k in rest:
                if key(k) in seen:
                    got.append(seen[key(k)])
                    continue
                stack.append((k, iter(parts(k)), []))
                break
            else:
                stack.pop()
                made = (top.tag, tuple(got))
                n = self.ids.setdefault(made, len(self.ids))
                if n == len(self.tags):
                    self.tags.append(top.tag)
                    self.kids.append(made[1])
                    self.size.append(1 + sum(self.size[k] for k in got))
                seen[key(top)] = n
                if not stack:
                    return n
                stack[-1][2].append(n)

    def get(self, a: int, b: int) -> int | None:
        """The weight of two shapes, if it shows or is known."""
        if self.tags[a] != self.tags[b]:
            return 0
        if a == b:
            return self.size[a]
        if not self.kids[a] or not self.kids[b]:
            return 1
        return self.known.get((a, b))

    def weigh(self, x, y) -> None:
        """Weights of all pairs of shapes of two lists, those below first."""
        stack = [(a, b) for a in set(x) for b in set(y) if self.get(a, b) is None]
        while stack:
            a, b = stack[-1]
            if self.get(a, b) is None:
                below = [(p, q) for p in set(self.kids[a]) for q in set(self.kids[b]) if self.get(p, q) is None]
                if below:
                    stack.extend(below)
                    continue
                self.known[a, b] = 1 + self.best(self.kids[a], self.kids[b])
            stack.pop()

    def rows(self, x, y) -> Iterator[np.ndarray]:
        """Row after row of the best matches of the first shapes of ``x`` with the first of ``y``, whose weights are known."""
        different, where = np.unique(np.array(y, np.int64), return_inverse=True)
        m = np.zeros(len(y) + 1, np.int64)
        for a in x:
            weights = np.array([self.get(a, int(b)) for b in different], np.int64)[where]
            m = np.maximum.accumulate(np.maximum(m, np.append(0, m[:-1] + weights)))
            yield m

    def best(self, x, y) -> int:
        last = 0
        for m in self.rows(x, y):
            last = int(m[-1])
        return last


def weight(a, b) -> int:
    """Size of the largest order-keeping match of two trees."""
    shapes, seen = Shapes(), {}
    x, y = shapes.of(a, seen), shapes.of(b, seen)
    shapes.weigh([x], [y])
    return shapes.get(x, y)


def match(x: list, y: list, shapes: Shapes | None = None, seen: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Pairs of places of two lists of children, order kept, by simple tree matching."""
    if len(x) == len(y) and all(p.tag == q.tag and p.leaf == q.leaf for p, q in zip(x, y, strict=True)):  # the largest match by sight
        return [(i, i) for i in range(len(x))]
    if not x or not y:
        return []
    shapes, seen = shapes or Shapes(), {} if seen is None else seen
    a, b = [shapes.of(p, seen) for p in x], [shapes.of(q, seen) for q in y]
    shapes.weigh(a, b)
    above, up, left = np.zeros(len(y) + 1, np.int64), [], []  # of each place, whether it is as good without its row, and without its column
    for m in shapes.rows(a, b):
        up.append(np.packbits(m[1:] == above[1:]))
        left.append(np.packbits(m[1:] == m[:-1]))
        above = m
    told = lambda bits, j: bits[j >> 3] >> (7 - (j & 7)) & 1
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if told(up[i - 1], j - 1):
            i -= 1
        elif told(left[i - 1], j - 1):
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def merge(root: Slot, page: Node, shapes: Shapes | None = None) -> dict[int, Slot]:
    """Align a page with the slots; nodes that have none get new ones. The slot of each node, by its id()."""
    place: dict[int, Slot] = {}
    shapes, seen = shapes or Shapes(), {}  # slots under one that is not aligned yet are as they were
    top = Unit(page)
    top.leaf = False
    stack = [(root, top)]
    while stack:
        slot, unit = stack.pop()
        slot.pages += 1
        slot.counts.add(len(unit.nodes))
        for node in unit.nodes:
            place[id(node)] = slot
        for t in {t for node in unit.nodes for _, t in node.texts}:
            slot.texts[t] += 1
        slot.varying += sum(len(t) for node in unit.nodes for _, t in node.texts)
        slot.leaf &= unit.leaf
        mine = [] if unit.leaf else units(unit.nodes[0])
        found = dict((j, i) for i, j in match(slot.kids, mine, shapes, seen)) if slot.kids else {}
        kids: list[Slot] = []
        done = 0
        for j, u in enumerate(mine):
            if j in found:
                kids += slot.kids[done : found[j] + 1]
                done = found[j] + 1
            else:
                kids.append(Slot(u.tag, u.leaf))
            stack.append((kids[-1], u))
        slot.kids = kids + slot.kids[done:]
    return place


def induce(trees: list[Node]) -> tuple[Slot, list[dict[int, Slot]]]:
    """The slots of pages of one wrapper, with their constant texts and how much varies in each, and where each page's nodes went."""
    root, shapes = Slot("", False), Shapes()
    places = []
    for t in trees:
        places.append(merge(root, t, shapes))
    for s in reversed(list(walk(root))):
        s.constant = {t for t, c in s.texts.items() if c == s.pages == len(trees) and c >= CONSTANT}
        s.varying += sum(k.varying for k in s.kids) - sum(len(t) * s.pages for t in s.constant)
    return root, places


def region(root: Slot) -> tuple[Slot, set[int]]:
    """The slot that the article is in, and the slots of headings left behind on the way to it, by id()."""
    at, heads = root, set()
    while True:
        inner = [k for k in at.kids if not k.leaf]
        if not inner:
            return at, heads
        best = max(inner, key=lambda k: k.varying)
        rest = [k for k in at.kids if k is not best and k.leaf and k.varying]
        regular = at.texts.keys() <= at.constant and all(len(k.counts) == 1 for k in rest)
        if best.varying * 2 <= at.varying or not regular or (best.tag in ("ul", "ol", "table", "dl", "blockquote", "figure") and rest):
            return at, heads
        heads |= {id(k) for k in rest if k.tag in HEADINGS}
        at = best


# --- text


def blocks(tree: Node, main_only: bool = False, place: dict[int, Slot] | None = None, top: Slot | None = None, heads: set[int] = frozenset()) -> tuple[list[str], list[str]]:
    """Texts in page order without what is no article: (those that vary, all). With ``top``, of that slot only, and of ``heads``."""
    varying: list[str] = []
    whole: list[str] = []
    stack: list = [(tree, 0, 0, top is None)]
    while stack:
        node, k, t, inside = stack.pop()
        if k == 0 and t == 0:
            slot = place.get(id(node)) if place else None
            if node.out:
                continue
            inside = inside or (slot is not None and (slot is top or id(slot) in heads))
        texts = node.texts
        while t < len(texts) and texts[t][0] <= k:
            if inside and (node.main or not main_only):
                whole.append(texts[t][1])
                slot = place.get(id(node)) if place else None
                if slot is None or texts[t][1] not in slot.constant:
                    varying.append(texts[t][1])
            t += 1
        if k < len(node.kids):
            stack.append((node, k + 1, t, inside))
            stack.append((node.kids[k], 0, 0, inside))
    return varying, whole


def marked(tree: Node, place: dict[int, Slot] | None = None) -> str:
    """The article where the page marks one, else all that no element or class excludes."""
    for main_only in (True, False):
        varying, whole = blocks(tree, main_only, place)
        if whole:
            return "\n\n".join(whole if sum(map(len, varying)) * 2 < sum(map(len, whole)) else varying)
    return ""


def extract_group(pages: list[str]) -> list[str]:
    """The main texts of pages of one host."""
    trees = {h: parse(h) for h in dict.fromkeys(pages)}
    texts: dict[str, str] = {}
    root, places = induce(list(trees.values()))
    top, heads = region(root)
    for (h, t), place in zip(trees.items(), places, strict=True):
        if len(trees) < FEWEST and any(x.main for x in walk(t)):
            texts[h] = marked(t, place)
            continue
        varying, whole = blocks(t, False, place, top, heads)
        if sum(map(len, varying)) * 2 < sum(map(len, whole)):
            varying = whole  # the pages of the group are copies of each other: constancy tells nothing
        texts[h] = "\n\n".join(varying) if varying or any(s is top for s in place.values()) else marked(t, place)
    return [texts[h] for h in pages]


def main_text(pages: DataFrame, group: int = GROUP, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null html counts as empty: empty text, 0 characters. Null urls, and urls
    without a host, are one host. A host's pages are dealt by a hash of id and
    url into groups of about ``group``; repeated rows give repeated results.
    Elements may be nested to any depth and tags may be malformed: parsing and
    alignment use no recursion that grows with the page, and each tag is read once.
    A tag that the page ends in is no text.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    # how many groups a host is dealt into: read from a small table if a count shows it small, so that html moves once
    sizes = cut(rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > group).select("host", F.ceil(F.col("n") / group).cast("int").alias("k")), "hosts")
    few = sizes.count() <= BROADCAST_HOSTS
    dealt = rows.join(F.broadcast(sizes) if few else sizes, "host", "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("k", F.lit(1))).cast("int")).drop("k")
    if not few:  # the join has dealt the rows by host alone
        dealt = dealt.repartition("host", "part")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page_id", "url"], ignore_index=True)
        texts = [t for at in range(0, len(pdf), 4 * group) for t in extract_group(pdf["html"].iloc[at : at + 4 * group].tolist())]
        return pd.DataFrame({id_col: pdf["page_id"], url_col: pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = pages.schema[id_col].dataType.simpleString()
    return dealt.select("host", "part", "page_id", "url", "html").groupBy("host", "part").applyInPandas(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
