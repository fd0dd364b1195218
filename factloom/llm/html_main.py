"""Main text of web pages by wrapper induction.

Pages of one host share templates. Pages are reduced to skeletons (element names, text checksums and lengths); for each of
a host's frequent layouts one page's skeleton is taken, and these are merged by simple tree matching into the host's
reference tree. Every page is aligned with that tree by simple tree matching. A node whose texts are nearly always the same,
or come from a small stock that keeps returning on different pages, is template; so is a node that nearly always holds
links only; the other nodes are slots for content. A second pass aligns each page again, leaves out template nodes, and
whole subtrees if all their nodes in the reference tree are template, and returns the text of the slots.

Pages count as different if their longest texts differ, so an article that stands on many pages does not become template.
Elements that HTML itself marks (nav, footer, aside, form, hidden ...) are left out everywhere. If a page marks its article
(``article``, ``itemprop=articleBody``, or else ``main``), the text is that of all such elements, and inside them only constant
nodes, reader comments and adverts go. Class names are a tie-break for the rest of a page without such a mark, and never
apply to an element that holds the greater part of its text.

Only one reference tree a host is joined to the pages, by a broadcast if they are small and by a shuffle otherwise,
from which hot hosts are taken apart; a host with a third of all pages is spread over tasks in both cases.

Nulls and edge cases: a null or empty html gives an empty text; a page without a usable url has no wrapper, as has the only
page of a host; broken markup is repaired as browsers do in the common cases; elements below ``MAX_DEPTH`` levels become
siblings, no text is lost; repeated rows give one result each. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint, keyed_join, text_batches

#: Share of a node's texts that return on other pages from which on it is template, and share of link letters.
TEMPLATE_SHARE = 0.8
LINK_SHARE = 0.8
#: Layouts of a host that are merged into its reference tree, the most frequent ones first.
LAYOUTS = 8
#: Cells of a table of sums that is held whole.
TABLE_CELLS = 1_000_000
#: Cells up to which plain lists are faster than arrays.
SMALL_CELLS = 1_000
#: Levels of a page that tell its layout.
LAYOUT_LEVELS = 4
#: Bytes of reference trees up to which they are broadcast.
BROADCAST_BYTES = 32_000_000

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*"|'[^']*')*+[^>]*)>|<[!?][^>]*>""", re.S)
#: A tag that the end of the page cuts off.
UNFINISHED = re.compile(r"<[/a-zA-Z!?][^<]*$")
#: Levels below which elements are not nested further.
MAX_DEPTH = 120
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = frozenset("script style textarea title noscript template iframe svg select object".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": set()}

BOILERPLATE_TAGS = frozenset("nav footer aside form script style noscript template iframe button select textarea dialog menu head svg title object".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class names and ids that tell boilerplate, where nothing better does.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer comment comments disqus respond reply replies cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing social related "
    "recommended popup modal overlay pagination pager widget toolbar notice notices banner masthead topbar skip".split()
)
#: Whole class names and ids of reader comments and adverts, which go inside an article as well.
SURE_NAMES = frozenset("ad ads advert adverts advertisement adsbygoogle comment comments commentlist comment-list comments-area disqus_thread respond".split())
CONTENT_WORDS = frozenset("article post entry content main story body text".split())
HEADER_WORDS = frozenset("header head".split())


class Node:
    """A block element: its name, its role, and its text runs and block children in order.

    ``dropped`` (its own text) and ``closed`` (all of it) come from the wrapper; ``size`` is the text that is left.
    """

    __slots__ = ("tag", "symbol", "role", "parts", "kids", "linked", "dropped", "closed", "size", "own", "shape", "total")

    def __init__(self, tag: str, symbol: str, role: str):
        self.tag, self.symbol, self.role, self.parts, self.kids = tag, symbol, role, [], []
        self.linked, self.dropped, self.closed, self.size, self.own = 0, False, False, 0, None
        self.shape, self.total = None, 0

    def own_text(self) -> str:
        if self.own is None:
            self.own = " ".join(" ".join(p for p in self.parts if type(p) is str).split())
        return self.own

    def checksum(self) -> int:
        return zlib.crc32(self.own_text().encode("utf-8", "replace"))


def _role(tag: str, attributes: str) -> tuple[str, str]:
    """(role of an element: '' plain, 'bad' boilerplate by its mark, 'sure' or 'named' by its name, 'head' a header, 'article' or 'main'; its class for alignment)."""
    role, kind = "bad" if tag in BOILERPLATE_TAGS else tag if tag in ("article", "main") else "head" if tag == "header" else "", ""
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                names, words = value.split(), set(re.split(r"[^a-z0-9]+", value))
                kind = kind or (names or [""])[0]
                if role in ("bad", "article") or tag in ("body", "html", "main"):
                    continue
                if not SURE_NAMES.isdisjoint(names):
                    role = "sure"
                elif words & BOILERPLATE_WORDS and not words & CONTENT_WORDS and role != "sure":
                    role = "named"
                elif words & HEADER_WORDS and not words & CONTENT_WORDS and not role:
                    role = "head"
            elif name == "role":
                role = "bad" if value in BOILERPLATE_ROLES else value if value in ("main", "article") and role != "bad" else role
            elif name == "itemprop":
                role = "article" if value == "articlebody" and role != "bad" else role
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                role = "bad"
    return role, kind


def parse(html: str | None) -> Node:
    """Tree of block elements of a page."""
    root = Node("#root", "#root", "")
    stack = [root]
    html = html or ""
    at, size, muted, link = 0, len(html), None, False

    def text(piece: str) -> None:
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            stack[-1].parts.append(piece)
            if link:
                stack[-1].linked += len("".join(piece.split()))

    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            text(UNFINISHED.sub("", html[at:]))
            break
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                link = link and tag != "a"
                if muted and muted[0] == tag:
                    muted = None
                    stack.pop()
                continue
            if tag == "p" and not any(n.tag == "p" for n in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            muted = None if muted and muted[1] not in stack else muted
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                stack[-1].parts.append(" ")
            continue
        role, kind = _role(tag, m[3])
        if tag in INLINE:
            link = link or tag == "a"
            if role in ("bad", "sure") and not muted:
                node = Node(tag, tag, role)
                stack[-1].parts.append(node)
                stack[-1].kids.append(node)
                stack.append(node)
                muted = (tag, node)
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES[tag]:
                    break
        muted, link = None if muted and muted[1] not in stack else muted, False
        if tag in ("html", "body"):
            if any(n.tag == tag for n in stack):
                continue
            stack[:] = [n for n in stack if n.tag != "head"]
        node = Node(tag, f"{tag}.{kind}" if kind else tag, role)
        stack[-1].parts.append(node)
        stack[-1].kids.append(node)
        if len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


def skeleton(node: Node) -> list:
    """Nested [symbol, checksum, letters, letters in links, children] of a tree."""
    return [node.symbol, node.checksum(), len("".join(node.own_text().split())), node.linked, [skeleton(k) for k in node.kids]]


def layout(nested: list, levels: int = LAYOUT_LEVELS) -> str:
    """Names of a skeleton's upper levels; equal neighbours count once."""
    inner = [layout(k, levels - 1) for k in nested[4]] if levels else []
    return f"{nested[0]}({','.join(x for x, before in zip(inner, ['', *inner], strict=False) if x != before)})"


class Reference:
    """A node of a skeleton: symbol, checksum, letters, children, index in preorder; ``template`` and ``closed`` by the wrapper."""

    __slots__ = ("symbol", "checksum", "letters", "linked", "kids", "index", "template", "closed", "shape", "total")

    def __init__(self, nested: list, counter: list[int] | None = None, template: frozenset[int] = frozenset()):
        counter = [0] if counter is None else counter
        self.symbol, self.checksum, self.letters, self.linked, kids = nested
        self.index, self.shape, self.total = counter[0], None, 0
        counter[0] += 1
        self.template = self.index in template
        self.kids = [Reference(k, counter, template) for k in kids]
        # None: no text below
        decided = [k.closed for k in self.kids if k.closed is not None] + [self.template] * bool(self.letters or self.template)
        self.closed = all(decided) if decided else None

    def nested(self) -> list:
        return [self.symbol, self.checksum, self.letters, self.linked, [k.nested() for k in self.kids]]


def merge(tree: list, other: list) -> list:
    """``tree`` with the nodes of ``other`` that simple tree matching finds no partner for, after their neighbours on the left."""
    mine, theirs = Reference(tree), Reference(other)
    partner = {b.index: a for a, b in match(mine, theirs)[1]}

    def add(node: Reference) -> None:
        into, at = partner[node.index], 0
        for kid in node.kids:
            if kid.index in partner:
                at = into.kids.index(partner[kid.index], at) + 1  # partners stand in order
                add(kid)
            elif at == 0 or into.kids[at - 1].symbol != kid.symbol:  # of a run of equal elements one stands for all
                into.kids.insert(at, kid)
                at += 1

    if theirs.index in partner:
        add(theirs)
    return mine.nested()


def match(a, b) -> tuple[int, list[tuple]]:
    """Simple tree matching: (size of the largest matching that keeps order and levels, matched pairs of nodes).

    Subtrees of one shape (the same names in the same places) match each other whole, and what two subtrees can match depends on
    their shapes alone, so each pair of shapes is weighed once. Of two rows of siblings equal ends are matched at once, which
    takes care of long runs of like rows; what is left is aligned by a table of sums, a row of it at a time, and a large table is
    split in halves that are aligned for themselves, so memory follows the rows and not their product.
    """
    weights: dict[tuple[int, int], int] = {}
    pairs: list[tuple] = []
    if a.symbol == b.symbol:
        _pair(a, b, weights, pairs)
    return len(pairs), pairs


def _shaped(node) -> int:
    """The node's shape as a number, and ``total``, its nodes; both are kept."""
    if node.shape is None:
        node.shape = hash((node.symbol, *map(_shaped, node.kids)))
        node.total = 1 + sum(k.total for k in node.kids)
    return node.shape


def _weight(a, b, weights: dict) -> int:
    """Size of the largest matching of two subtrees."""
    if a.symbol != b.symbol:
        return 0
    if _shaped(a) == _shaped(b):
        return a.total
    key = a.shape, b.shape
    known = weights.get(key)
    if known is None:
        lo, left, right = _ends(a.kids, b.kids)
        trimmed = sum(k.total for k in a.kids[:lo]) + sum(k.total for k in a.kids[lo + len(left) :])
        known = weights[key] = 1 + trimmed + (int(_row(left, right, weights)[-1]) if left and right else 0)
    return known


def _ends(left: list, right: list) -> tuple[int, list, list]:
    """(equal siblings at the start, what is left of both rows without equal ones at either end). No largest matching is lost: a
    subtree can match nothing better than its like, and at an end nothing stands in the way."""
    lo, most = 0, min(len(left), len(right))
    while lo < most and _shaped(left[lo]) == _shaped(right[lo]):
        lo += 1
    hi = 0
    while hi < most - lo and _shaped(left[-1 - hi]) == _shaped(right[-1 - hi]):
        hi += 1
    return lo, left[lo : len(left) - hi], right[lo : len(right) - hi]


def _rows(left: list, right: list, weights: dict) -> Iterator[np.ndarray]:
    """For each element of ``left`` what it can match with each of ``right``."""
    shapes: dict[int, int] = {}
    places = np.array([shapes.setdefault(_shaped(y), len(shapes)) for y in right])
    firsts = {shapes[y.shape]: y for y in reversed(right)}
    known: dict[int, np.ndarray] = {}
    for x in left:
        found = known.get(_shaped(x))
        if found is None:
            found = known[x.shape] = np.array([_weight(x, firsts[i], weights) for i in range(len(shapes))], np.int32)[places]
        yield found


def _table(left: list, right: list, weights: dict) -> list[list[int]]:
    """Largest sums of matches of the first 0, 1, ... of ``left`` with the first 0, 1, ... of ``right``; for short rows, without arrays."""
    best = [[0] * (len(right) + 1)]
    for x in left:
        above, row, last = best[-1], [0], 0
        for j, y in enumerate(right):
            last = max(above[j + 1], last, above[j] + (_weight(x, y, weights) if x.symbol == y.symbol else 0))
            row.append(last)
        best.append(row)
    return best


def _row(left: list, right: list, weights: dict) -> list[int] | np.ndarray:
    """Largest sums of matches of all of ``left`` with the first 0, 1, ... of ``right``."""
    if len(left) * len(right) <= SMALL_CELLS:
        return _table(left, right, weights)[-1]
    row = np.zeros(len(right) + 1, np.int32)
    for found in _rows(left, right, weights):
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + found))
    return row


def _pair(a, b, weights: dict, pairs: list) -> None:
    """Add the matched pairs of two subtrees of one name."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        pairs.append((a, b))
        if _shaped(a) == _shaped(b):
            todo += zip(a.kids, b.kids, strict=True)
            continue
        lo, left, right = _ends(a.kids, b.kids)
        todo += zip(a.kids[:lo], b.kids[:lo], strict=True)
        todo += zip(a.kids[lo + len(left) :], b.kids[lo + len(right) :], strict=True)
        todo += _aligned_siblings(left, right, weights)


def _aligned_siblings(left: list, right: list, weights: dict) -> list[tuple]:
    """Pairs of siblings in a largest matching of two rows."""
    m, n = len(left), len(right)
    if not m or not n:
        return []
    if m > 1 and m * n > TABLE_CELLS:
        half = m // 2
        upper, lower = np.asarray(_row(left[:half], right, weights)), np.asarray(_row(left[half:][::-1], right[::-1], weights))[::-1]
        cut = int(np.argmax(upper + lower))
        return _aligned_siblings(left[:half], right[:cut], weights) + _aligned_siblings(left[half:], right[cut:], weights)
    if m * n <= SMALL_CELLS:
        best = _table(left, right, weights)
    else:
        best = np.zeros((m + 1, n + 1), np.int32)
        for i, found in enumerate(_rows(left, right, weights)):
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + found))
    pairs, i, j = [], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((left[i], right[j]))
    return pairs


def measure(node: Node) -> int:
    """Set ``size`` below a node: letters of text that neither a mark nor the wrapper takes away."""
    kids = sum(map(measure, node.kids))
    node.size = 0 if node.role in ("bad", "sure") or node.closed else kids + (0 if node.dropped else len(node.own_text()))
    return node.size


def _outermost(node: Node, role: str) -> list[Node]:
    """The outermost elements of a role, outside of boilerplate."""
    if node.role == role:
        return [node]
    return [] if node.role in ("bad", "sure") else [n for k in node.kids for n in _outermost(k, role)]


def dense_node(root: Node) -> Node:
    """The deepest element that still holds most of a page's text."""
    node = root
    while not any(k.tag == "h1" and k.role != "head" and k.size for k in node.kids):  # a title belongs to the text
        inner = [k for k in node.kids if k.role not in ("head", "named") and k.tag not in ("p", "h1", "h2", "h3", "ul", "ol", "table", "blockquote", "pre")]
        largest = max(inner, key=lambda k: k.size, default=None)
        if largest is None or largest.size * 4 < node.size * 3:
            break
        node = largest
    return node


def blocks(node: Node, half: float) -> Iterator[str]:
    """Text blocks below a node in page order; outside an article, named elements of at most ``half`` letters go."""
    if node.role in ("bad", "sure") or node.closed or half and (node.role == "head" or node.role == "named" and node.size <= half):
        return
    run: list[str] = []
    for part in node.parts:
        if type(part) is str:
            if not node.dropped:
                run.append(part)
        elif part.tag in INLINE:
            continue
        else:
            yield "".join(run)
            run = []
            yield from blocks(part, half)
    yield "".join(run)


def _below(node: Node) -> Iterator[Node]:
    yield node
    for kid in node.kids:
        yield from _below(kid)


def _template_letters(node: Node, closed: bool = False) -> int:
    closed = closed or node.closed
    return (_letters(node.own_text()) if closed or node.dropped else 0) + sum(_template_letters(k, closed) for k in node.kids)


def _letters(text: str) -> int:
    return len(text) - text.count(" ")


def extract(html: str | None, reference: Reference | None = None) -> tuple[str, int, int]:
    """(main text of a page, letters that its host's reference tree took away, letters that only marks and names did)."""
    if not html:
        return "", 0, 0
    root = parse(html)
    measure(root)
    pairs = match(reference, root)[1] if reference is not None else []
    articles, mains = _outermost(root, "article"), _outermost(root, "main")
    if 2 * sum(a.size for a in articles) < sum(m.size for m in mains):
        articles = []
    for ref, node in pairs:
        node.dropped, node.closed = ref.template, bool(ref.closed)
    if articles:
        whole, inside = sum(a.size for a in articles), {id(n) for a in articles for n in _below(a)}
        within = [(ref, node) for ref, node in pairs if id(node) in inside]
        for ref, node in within:
            node.dropped, node.closed = ref.template and ref.checksum == node.checksum(), False
        # an article most of which stands on the host's other pages too is a repeated article, not a template
        if 2 * sum(map(measure, articles)) <= whole:
            for _, node in within:
                node.dropped = False
        found = [b for a in articles for b in blocks(a, 0)]
    else:
        measure(root)
        tops = mains or [dense_node(root)]
        half = sum(t.size for t in tops) / 2
        found = [b for t in tops for b in blocks(t, half)]
    text = " ".join(filter(None, (" ".join(b.split()) for b in found)))
    template = _template_letters(root)
    return text, template, sum(_letters(n.own_text()) for n in _below(root)) - template - _letters(text)


def main_text(html: str | None, reference: Reference | None = None) -> str:
    return extract(html, reference)[0]


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"


class _References(dict):
    """Reference trees by (skeleton, template nodes); emptied when there are many."""

    def __missing__(self, key: tuple) -> Reference:
        if len(self) > 2_000:
            self.clear()
        made = self[key] = Reference(json.loads(key[0]), template=frozenset(key[1]))
        return made


_references = _References()


def _skeletons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        trees = [skeleton(parse(h)) for h in batch["html"]]
        layouts = [zlib.crc32(layout(t).encode("utf-8", "replace")) for t in trees]
        yield pd.DataFrame({"host": batch["host"], "layout": layouts, "page": [_page_key(t) for t in trees], "skeleton": [json.dumps(t, separators=(",", ":")) for t in trees]})


def _texts(nested: list) -> Iterator[tuple[int, int]]:
    yield nested[2], nested[1]
    for kid in nested[4]:
        yield from _texts(kid)


def _page_key(nested: list) -> int:
    """Checksum of the page's longest text; pages that share it are the same article."""
    return max(_texts(nested))[1]


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    trees = [json.loads(s) for s in group.sort_values(["rank"])["skeleton"]]
    tree = trees[0]
    for other in trees[1:]:
        tree = merge(tree, other)
    return pd.DataFrame({"host": group["host"].iloc[:1], "reference": [json.dumps(tree, separators=(",", ":"))]})


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for host, reference, page, nested in zip(batch["host"], batch["reference"], batch["page"], batch["skeleton"], strict=True):
            for ref, node in match(_references[reference, ()], Reference(json.loads(nested)))[1]:
                if node.letters:
                    rows.append((host, ref.index, node.checksum, page, node.letters, node.linked))
        yield pd.DataFrame(rows, columns=["host", "node", "checksum", "page", "letters", "linked"])


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for html, reference, template in zip(batch["html"], batch["reference"], batch["template"], strict=True):
            rows.append(extract(html, _references[reference, tuple(template)] if reference is not None else None))
        out = pd.DataFrame(rows, columns=["text", "n_template", "n_marked"])
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": out["text"], "n_chars": [len(t) for t in out["text"]], "n_template": out["n_template"], "n_marked": out["n_marked"]})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, reference, template) of every host with template nodes: its reference tree and their places in preorder."""
    usable = pages.where("host is not null and html is not null and html <> ''").select("host", "html")
    reduced = checkpoint(usable.mapInPandas(_skeletons, "host string, layout long, page long, skeleton string"))
    counted = reduced.groupBy("host", "layout").agg(F.count("*").alias("pages"), F.min("skeleton").alias("skeleton"))
    frequent = Window.partitionBy("host").orderBy(F.col("pages").desc(), "layout")
    chosen = counted.withColumn("rank", F.row_number().over(frequent)).where(F.col("rank") <= LAYOUTS)
    pages_of = counted.groupBy("host").agg(F.sum("pages").alias("pages"))
    references = checkpoint(chosen.groupBy("host").applyInPandas(_merged, "host string, reference string").join(pages_of, "host"))
    aligned = _with_hosts(reduced, references, "inner").mapInPandas(_aligned, "host string, node int, checksum long, page long, letters long, linked long")
    texts = aligned.groupBy("host", "node", "checksum", "page").agg(F.max("letters").alias("letters"), F.max("linked").alias("linked"))
    texts = texts.groupBy("host", "node", "checksum").agg(F.count("*").alias("n"), F.sum("letters").alias("letters"), F.sum("linked").alias("linked"))
    again = F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0))
    nodes = texts.groupBy("host", "node").agg(F.sum("n").alias("n"), again.alias("again"), F.sum("letters").alias("letters"), F.sum("linked").alias("linked"))
    template = nodes.where((F.col("n") >= 2) & ((F.col("again") >= TEMPLATE_SHARE * F.col("n")) | (F.col("linked") >= LINK_SHARE * F.col("letters"))))
    return checkpoint(references.join(template.groupBy("host").agg(F.array_sort(F.collect_list("node")).alias("template")), "host"))


def _with_hosts(rows: DataFrame, hosts: DataFrame, how: str) -> DataFrame:
    """``rows`` with the reference trees of their hosts."""
    size = hosts.agg(F.sum(F.length("reference"))).first()[0] or 0
    return keyed_join(rows, hosts, "host", "pages", size, BROADCAST_BYTES, how)


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars, and the letters that ``extract`` has left out."""
    text_batches(pages.sparkSession)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    source = source.withColumn("host", F.nullif(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")))
    known = wrappers(source)
    joined = _with_hosts(source, known, "left").select("page_id", "url", "html", "reference", "template")
    return joined.mapInPandas(_extract, "page_id long, url string, text string, n_chars long, n_template long, n_marked long")
