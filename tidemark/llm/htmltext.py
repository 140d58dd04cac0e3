"""HTML extraction with a tree-structured graphical model.

A page is parsed into a tree of elements. Each element is a node with a hidden
state, content or not; a node has a potential from its features (tag, words of
class and id, text length, share of link text, depth) and each parent-child
edge one from how states pass down. Sum-product messages upward and downward
give the exact marginal of every node; the text directly below nodes whose
marginal is at least one half is the main text.

The potentials are trained from labelled pages by counting: a page labels
itself where its author marked the main article (``article``, ``main``,
``role=main``) beside marked page parts. Node potentials are naive Bayes ratios
over feature groups with add-one smoothing, edge potentials smoothed transition
counts; a few fixed prior counts for well-known names of page parts stand for
pages that such a sample lacks. At most ``most`` pages (smallest id hash) train;
every page is extracted, whole.

Text: character references are decoded, white space inside a block becomes one
space, blocks are joined in page order by one space. Defined cases: a null or
empty page gives the empty text; unclosed, cut off or stray tags are closed or
ignored as browsers do in outline; repeated rows are extracted each. Only the
named columns are read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: pages the potentials are counted from at most
MOST = 2000
#: a quote opens a value only right after the equals sign; elsewhere it is a plain character of the tag
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s>]*))*)(?:>|$)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is no text of the page
RAW = frozenset("script style textarea title noscript template iframe svg math object audio video canvas xmp noembed noframes".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|$)", re.I) for t in RAW}
BLOCK = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul option select button").split())
INLINE_BREAK = frozenset("br hr".split())
#: a new one ends an open one of the same group, up to the nearest barrier
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
#: fixed values: usual names of page parts that are not the article, and of those that are
PART_WORDS = frozenset(("ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disclaimer footer form "
                        "gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended "
                        "related reply respond rss search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget alert legal "
                        "copyright reviews discussion disqus thread responses feedback toc print hidden aside complementary contentinfo note warning offer teaser").split())
TEXT_WORDS = frozenset("article body content entry main post story text".split())
PART_TAGS = frozenset("aside button dialog fieldset footer form header input label menu nav search select".split())
OWN_ARTICLE = frozenset("article main".split())
#: elements whose names speak of the page as a whole
WHOLE = frozenset("html body article main".split())
#: fixed log ratio of a node that is named as another part, and the most that other features may say
PART_RATIO, MOST_RATIO = -14.0, 4.0


class Node:
    __slots__ = ("names", "parent", "pieces", "tag", "children", "length", "links", "index")

    def __init__(self, tag: str, names: tuple[str, ...], parent: int, index: int):
        self.tag, self.names, self.parent, self.index = tag, names, parent, index
        self.children: list[int] = []
        self.length = self.links = 0


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, int, str]]]:
    """Nodes in page order (a parent before its children) and (node, block, text) pieces."""
    nodes = [Node("#page", (), -1, 0)]
    pieces: list[tuple[int, int, str]] = []
    stack, block, at = [0], 0, 0
    page = page or ""
    size = len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        close, tag, rest, text = m.group(1, 2, 3, 4)
        if text is not None:
            pieces.append((stack[-1], block, text))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if close:
            if tag in BLOCK or tag == "p":
                block += 1
            for d in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[d]].tag
                if open_tag == tag:
                    del stack[d:]
                    break
                # an inline end tag doesn't reach over a block, nor any over a table cell or an article
                if tag not in BLOCK and open_tag in BLOCK or open_tag in ("td", "th", "article", "main") and tag not in ("table", "tr", "body", "html", "article", "main", "section", "div"):
                    break
            continue
        if tag in BLOCK:
            block += 1
            # a paragraph, with what is open inside, ends where a block begins
            for d in range(len(stack) - 1, 0, -1):
                if nodes[stack[d]].tag == "p":
                    del stack[d:]
                    break
                if nodes[stack[d]].tag in BLOCK:
                    break
            for d in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[d]].tag
                if open_tag in CLOSES.get(tag, ()):
                    del stack[d:]
                    break
                if open_tag in BARRIER.get(tag, ()) or tag not in CLOSES:
                    break
        if tag in INLINE_BREAK:
            pieces.append((stack[-1], block, " "))
        if tag in VOID:
            continue
        if tag in RAW:
            if not rest.rstrip().endswith("/") or tag not in ("svg", "math"):
                end = RAW_END[tag].search(page, at)
                at = end.end() if end else size
            continue
        names: tuple[str, ...] = ()
        if rest and not rest.isspace():
            found = []
            for key, *values in ATTRIBUTE.findall(rest):
                key, value = key.lower(), next((v for v in values if v), "").lower()
                if key in ("class", "id", "role"):
                    found += NAME.findall(value)
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                    found.append("hidden")
            names = tuple(found)
        node = Node(tag, names, stack[-1], len(nodes))
        nodes[stack[-1]].children.append(node.index)
        nodes.append(node)
        stack.append(node.index)
    for n, _, text in pieces:
        nodes[n].length += len(text.strip())
    for node in reversed(nodes):
        if node.tag == "a":
            node.links = node.length
        if node.parent >= 0:
            nodes[node.parent].length += node.length
            nodes[node.parent].links += node.links
    return nodes, pieces


def is_part(node: Node) -> bool:
    """Whether tag or names say that this is a part of the page other than the article."""
    return node.tag in PART_TAGS or node.tag not in WHOLE and any(n in PART_WORDS for n in node.names)


def features(node: Node, depth: int) -> list[str]:
    part = is_part(node)
    words = "part" if part else "text" if any(n in TEXT_WORDS for n in node.names) else "named" if node.names else "bare"
    kind = "part" if node.tag in PART_TAGS else node.tag if node.tag in BLOCK or node.tag == "a" else "inline"
    share = node.links / node.length if node.length else 0.0
    return [f"tag:{kind}", f"name:{words}", f"links:{round(share * 4)}", f"size:{min(node.length, 4000).bit_length() // 2}", f"depth:{min(depth, 6)}"]


class TreeModel:
    """Node and edge potentials, as log ratios and log transition probabilities."""

    def __init__(self, seen: dict[tuple[str, int], float], edges: dict[tuple[int, int, int], float]):
        groups: dict[str, list[dict[str, float]]] = {}
        for (f, s), n in seen.items():
            groups.setdefault(f.split(":")[0], [{}, {}])[s][f] = n
        self.ratio: dict[str, float] = {}
        for each in groups.values():
            names = set(each[0]) | set(each[1])
            total = [sum(e.values()) + len(names) for e in each]
            for f in names:
                self.ratio[f] = math.log((each[1].get(f, 0) + 1) / total[1]) - math.log((each[0].get(f, 0) + 1) / total[0])
        # one table for edges below a part of the page, one for all others
        self.edge = [[[math.log((edges.get((k, a, b), 0) + 1) / (edges.get((k, a, 0), 0) + edges.get((k, a, 1), 0) + 2)) for b in (0, 1)] for a in (0, 1)] for k in (0, 1)]

    def potentials(self, nodes: list[Node]) -> tuple[list[float], list[list[list[float]]]]:
        """Log ratio of each node, and the edge table to its parent."""
        n = len(nodes)
        depth, own, below = [0] * n, [-8.0] * n, [False] * n
        tables = [self.edge[0]] * n
        for i in range(1, n):
            node = nodes[i]
            depth[i] = depth[node.parent] + 1
            below[i] = below[node.parent] or is_part(nodes[node.parent])
            tables[i] = self.edge[below[i]]
            # features that depend on each other must not drown the edges
            own[i] = PART_RATIO if is_part(node) else max(-MOST_RATIO, min(MOST_RATIO, sum(self.ratio.get(f, 0.0) for f in features(node, depth[i]))))
        return own, tables

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node: messages from the leaves up, then from the root down."""
        own, tables = self.potentials(nodes)
        n = len(nodes)
        # messages as log ratios of the receiver's state 1 over 0
        up_in = own[:]
        up = [0.0] * n
        for i in range(n - 1, 0, -1):
            x, e = up_in[i], tables[i]
            up[i] = _log_sum(e[1][0], e[1][1] + x) - _log_sum(e[0][0], e[0][1] + x)
            up_in[nodes[i].parent] += up[i]
        belief = up_in[:]
        for i in range(1, n):
            x, e = belief[nodes[i].parent] - up[i], tables[i]
            belief[i] += _log_sum(e[0][1], e[1][1] + x) - _log_sum(e[0][0], e[1][0] + x)
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, b)))) for b in belief]


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def labelled(nodes: list[Node]) -> list[int] | None:
    """States of a page whose author marked the article, else None."""
    if not any(n.tag in OWN_ARTICLE or "main" in n.names and n.tag == "div" for n in nodes) or not any(is_part(n) for n in nodes):
        return None
    state, below = [0] * len(nodes), [False] * len(nodes)
    for i in range(1, len(nodes)):
        node = nodes[i]
        below[i] = below[node.parent] or is_part(nodes[node.parent])
        state[i] = 0 if below[i] or is_part(node) else int(state[node.parent] == 1 or node.tag in OWN_ARTICLE)
    return state


#: fixed prior counts: what stands below a part of the page is no content, and content mostly stays below content
PRIOR = {("name:text", 1): 40.0}
PRIOR_EDGES = {(0, 0, 0): 50.0, (0, 1, 1): 200.0, (0, 0, 1): 1.0, (0, 1, 0): 4.0, (1, 0, 0): 1e6, (1, 1, 0): 1e3, (1, 1, 1): 1e3}


def page_counts(pages: list[str | None]) -> Counter:
    counts: Counter = Counter()
    for page in pages:
        nodes, _ = parse(page)
        state = labelled(nodes)
        if state is None:
            continue
        depth, below = [0] * len(nodes), [False] * len(nodes)
        for i in range(1, len(nodes)):
            node = nodes[i]
            depth[i] = depth[node.parent] + 1
            below[i] = below[node.parent] or is_part(nodes[node.parent])
            counts["edge", f"{int(below[i])}{state[node.parent]}", state[i]] += 1
            for f in features(node, depth[i]):
                counts["node", f, state[i]] += 1
    return counts


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = MOST) -> TreeModel:
    """Count features and transitions on at most ``most`` self-labelled pages."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("page"))
    ids = rows.select("id").filter("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    # at most `most` ids, which bounds this broadcast
    sample = rows.join(F.broadcast(ids), "id").select("page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts += page_counts(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict({"kind": pa.array([k[0] for k in counts], pa.string()), "name": pa.array([k[1] for k in counts], pa.string()),
                                          "state": pa.array([k[2] for k in counts], pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})

    # features are few by construction: names are reduced to four classes
    got = sample.mapInArrow(run, "kind string, name string, state int, n long").groupBy("kind", "name", "state").agg(F.sum("n").alias("n")).collect()
    seen, edges = dict(PRIOR), dict(PRIOR_EDGES)
    for kind, name, state, n in got:
        if kind == "node":
            seen[name, state] = seen.get((name, state), 0.0) + n
        else:
            place = (int(name[0]), int(name[1]), state)
            edges[place] = edges.get(place, 0.0) + n
    return TreeModel(seen, edges)


def main_text(page: str | None, model: TreeModel, at_least: float = 0.5) -> str:
    nodes, pieces = parse(page)
    if len(nodes) == 1:
        # no element at all: nothing but text
        return " ".join(html.unescape("".join(t for _, _, t in pieces)).split())
    keep = model.marginals(nodes)
    blocks: list[str] = []
    last, held = None, []
    for n, block, text in pieces:
        if keep[n] < at_least:
            continue
        if block != last and held:
            blocks.append("".join(held))
            held = []
        last = block
        held.append(text)
    blocks.append("".join(held))
    # references are decoded once a block is whole, then its white space is folded
    return " ".join(" ".join(t for b in blocks for t in html.unescape(b).split()).split())


def extracted(pages: DataFrame, model: TreeModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page id, url, ``text`` and ``n_chars`` of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                texts = [main_text(p, own) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
