"""Main text of web pages by composite text density.

Every DOM node gets a density: its characters per tag, where text inside links counts against it and is set against the
body's share of link text. A node's score is the sum of its children's densities. The threshold is the smallest density
on the path from the body to the densest-scoring node. The tree is walked from the top through branches that reach the
threshold; in each the subtree with the largest sum of densities is content (after Sun, Song and Liao, 2011). Density
grows with a part's size, so a title or a short section beside a long one stays below the threshold; a branch is also
walked if no larger a share of its text lies in links than of the best subtree's and its structure says that it goes on
with it: headings, running text, and parts that repeat the tag (of a div: the class too) of what holds the content.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from meshloom.llm.common import free_name

#: Elements by role (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text to the parser, and none of the page's.
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
#: Any other element ends the page's head.
HEAD = frozenset("head base link meta noscript script style template title".split())
#: Never part of an article.
BESIDE = frozenset("head nav aside footer header form button select option dialog menu object svg math canvas audio video label input".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Opening one of these ends an open paragraph.
ENDS_P = BLOCKS - frozenset("html body tbody td tfoot th thead tr caption".split())
#: Elements of which a new one ends an open one, by kind: what ends, and the containers beyond which nothing is ended.
KINDS = {"item": ("li", "ul ol menu"), "term": ("dt dd", "dl"), "row": ("tr", "table"), "cell": ("td th", "tr table"), "option": ("option", "select")}
ENDS = {tag: kind for kind, (ends, _) in KINDS.items() for tag in ends.split()}
KINDS_OF = {tag: tuple(k for k, sides in KINDS.items() if tag in " ".join(sides).split()) for sides in KINDS.values() for tag in " ".join(sides).split()}
#: Words in class, id or role that mark what stands beside an article: parts of a name cut at - and _ and case.
BESIDE_WORDS = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies discussion disqus footer gdpr masthead menu nav navbar navigation newsletter notice notices notification pagination popup promo promotion promoted recommended related respond replies search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toc toolbar widget".split())
#: Of these, words that an article may also be about: inside the content they count only for short or linked text.
TOPICS = frozenset("banner consent cookie cookies discussion menu navigation notice notices notification popup promotion recommended related replies respond search share sharing skip social subscription toc widget".split())
#: Words that say nothing of what a part holds, beside which a word of BESIDE_WORDS is the whole name.
PLAIN_WORDS = frozenset("area article bar block body bottom box btn button buttons col column container content global group header holder icon icons inner item items left link links list main middle module outer page panel post primary reader readers region right row secondary section site slot text thread threads top unit user users visitor visitors wrap wrapper".split())
#: Elements that hold a run of text or a heading, not a part of the page.
TEXT_TAGS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table tbody thead tr td th caption figure figcaption center".split())
#: Text of more characters than this is not short.
SHORT = 200

#: A quote opens a value right after = only, and only if it is closed; elsewhere it is a character of a name or value.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)", re.S)
#: An attribute by its whole name with its value, which is consumed, so that no name is looked for inside a value.
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: The end of what a raw element holds.
RAW_END = {tag: re.compile(f"</{tag}(?![a-z0-9])[^>]*(?:>|\\Z)", re.I | re.A) for tag in RAW}
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element: children in order (nodes or text), and what its subtree holds.

    skip is NO, MAYBE (left out unless it stands inside the content) or YES.
    """

    __slots__ = ("tag", "parent", "parts", "skip", "names", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", skip: int) -> None:
        self.tag, self.parent, self.skip, self.parts, self.names = tag, parent, skip, [], ""
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


NO, MAYBE, TOPIC, YES = range(4)


def _beside(tag: str, attributes: str, parent: Node) -> int:
    """Whether an element stands beside the article by its tag or name, or is hidden. An article's own header is part of it.

    A name that consists of words of BESIDE_WORDS and plain ones is sure, or a TOPIC if all those words are topics; a
    name that has other words as well is a MAYBE.
    """
    if tag in BESIDE:
        return YES if tag != "header" or parent.tag not in ("article", "main") else NO
    if not attributes:
        return NO
    found = NO
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" and not value.lower() == "false" or name == "aria-hidden" and value.lower() == "true":
            return YES
        if name == "style":
            if HIDDEN_STYLE.search(value):
                return YES
        elif name in ("class", "id", "role") and tag not in ("body", "html", "article", "main"):
            for token in value.split():
                words = {w.lower() for w in NAME_PART.findall(token)}
                if beside := words & BESIDE_WORDS:
                    sure = TOPIC if beside <= TOPICS else YES
                    found = max(found, sure if words <= BESIDE_WORDS | PLAIN_WORDS else MAYBE)
    return found


def parse(page: str) -> Node:
    """The tree of a page, tolerant of missing ends; never fails. Time is linear in the page, whatever its depth.

    Stacks of the open elements, by tag and by kind, tell what an end tag or a new element ends; an element is closed
    once, so all climbing together is linear.
    """
    root = at = Node("#root", None, NO)
    stacks: dict[str, list[Node]] = {"#block": []}

    def names(tag: str) -> tuple:
        return (tag, *KINDS_OF.get(tag, ()), "#block") if tag in BLOCKS else (tag, *KINDS_OF.get(tag, ()))

    def closed(node: Node, upto: Node) -> Node:
        """The parent of upto, after everything open from node up to it was closed."""
        while True:
            for name in names(node.tag):
                stacks[name].pop()
            if node is upto:
                return node.parent
            node = node.parent

    pos, end, unclosed = 0, len(page), set()
    while pos < end:
        m = TOKEN.search(page, pos)
        if m is None:
            at.parts.append(page[pos:])
            break
        if m.start() > pos:
            at.parts.append(page[pos : m.start()])
        pos = m.end()
        if m.group(2) is None:
            continue
        tag, attributes = m.group(2).lower(), m.group(3)
        if m.group(1):
            if stacks.get(tag):
                at = closed(at, stacks[tag][-1])
            continue
        if tag not in HEAD and stacks.get("head"):
            at = closed(at, stacks["head"][-1])
        if tag in RAW:
            close = None if tag in unclosed else RAW_END[tag].search(page, pos)
            if close is not None:
                pos = close.end()
            elif tag in ("script", "style"):
                pos = end
            else:  # an element that never ends holds nothing
                unclosed.add(tag)
            continue
        if tag in ENDS_P and stacks["#block"] and stacks["#block"][-1].tag == "p":
            at = closed(at, stacks["#block"][-1])
        if (kind := ENDS.get(tag)) and stacks.get(kind) and ENDS.get(stacks[kind][-1].tag) == kind:
            at = closed(at, stacks[kind][-1])
        child = Node(tag, at, _beside(tag, attributes, at))
        if attributes and tag not in TEXT_TAGS:
            child.names = " ".join(sorted(v.strip("\"'") for n, v in ATTRIBUTE.findall(attributes) if n.lower() == "class"))
        at.parts.append(child)
        # a slash ends an element unless it belongs to a bare value
        if tag not in VOID and not re.search(r"(?:^|[\s\"'])/$", attributes):
            at = child
            for name in names(tag):
                stacks.setdefault(name, []).append(child)
    return root


def settle_names(root: Node) -> tuple[dict[int, int], dict[int, int]]:
    """Turns TOPIC into YES or MAYBE, and MAYBE into NO where an element that is left out for its name holds most text.

    A topic is sure if its text is short or half of it lies in links. A page's only content can stand in an element with
    an unlucky name, such as search-results. Returns characters and those in links, by node.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(p for p in node.parts if isinstance(p, Node) and p.skip != YES)
    chars: dict[int, int] = {}
    links: dict[int, int] = {}
    for node in reversed(order):
        own = sum(len(p) - p.count(" ") - p.count("\n") for p in node.parts if isinstance(p, str))
        c = own + sum(chars.get(id(p), 0) for p in node.parts if isinstance(p, Node))
        chars[id(node)] = c
        links[id(node)] = c if node.tag == "a" else sum(links.get(id(p), 0) for p in node.parts if isinstance(p, Node))
    for node in order:
        if node.skip == TOPIC:
            node.skip = YES if chars[id(node)] <= SHORT or 2 * links[id(node)] > chars[id(node)] else MAYBE
        if node.skip == MAYBE and 2 * chars[id(node)] > chars[id(root)]:
            node.skip = NO
    return chars, links


def _in_order(root: Node) -> list[Node]:
    """Nodes outside skipped subtrees, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.skip)
    return out


def score(root: Node) -> list[Node]:
    """Fills in densities and density sums; returns the nodes that were scored, parents first."""
    nodes = _in_order(root)
    inside_link: set[int] = set()
    for node in nodes:
        if node.tag == "a" or node.parent is not None and id(node.parent) in inside_link:
            inside_link.add(id(node))
    for node in reversed(nodes):
        own = sum(len(p) - p.count(" ") - p.count("\n") for p in node.parts if not isinstance(p, Node))
        node.chars += own
        if id(node) in inside_link:
            node.link_chars += own
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        if not node.chars:
            continue
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        base = math.log(c * lc / max(c - lc, 1) + share * c + math.e)
        node.density = c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0) + 1e-9, max(base, 1.0 + 1e-9)) if lc else c / t * math.log(c * t / lt + 1.0)
    for node in nodes:
        if node.parent is not None:
            node.parent.total += node.density
    return nodes


def _goes_on(part: Node, best: Node, shapes: set[tuple[str, str]]) -> bool:
    """Whether a part below the threshold belongs to the content: no more links than the best subtree has, and text by its
    element, of the shape of an element that holds the content, or a div without a class, as the best subtree is one, that isn't
    short and whose text is several paragraphs in the main."""
    if part.link_chars * best.chars > best.link_chars * part.chars:
        return False
    if part.tag in TEXT_TAGS or (part.tag, part.names) in shapes:
        return True
    if part.tag != "div" or part.names or best.tag != "div" or best.names or part.chars <= SHORT:
        return False
    paragraphs = [n.chars for n in part.parts if isinstance(n, Node) and not n.skip and n.tag == "p" and n.chars]
    return len(paragraphs) > 1 and 2 * sum(paragraphs) > part.chars


def content(page: str) -> tuple[Node, set[int]] | None:
    """The root and the ids of the nodes under it that are no content; None if the page has no text.

    The threshold is the least density on the path from the body to the node with the largest density sum. From the root,
    a branch that neither reaches it nor goes on with the content (see _goes_on) is dropped. In each other branch the
    largest-sum subtree is marked: nothing is dropped inside it. What else the branch has is judged in the same way. Inside
    the best subtree a MAYBE stays if its text isn't mostly links and it is a run of text or a heading; another part also
    if an article or main element says that all of it is content or it isn't short.
    """
    root = parse(page)
    chars, links = settle_names(root)
    nodes = score(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    if not root.chars:
        return None
    # of equal sums the deeper node's
    best = max(reversed(nodes), key=lambda n: (n.total, n.chars))
    path, node = [best], best
    while node is not body and node.parent is not None:
        node = node.parent
        path.append(node)
    threshold = min(n.density for n in path)
    above = set()
    node = best
    while node is not None:
        above.add(id(node))
        node = node.parent
    shapes = {(n.tag, n.names) for n in path if n is not body and (n.tag != "div" or n.names)}
    # the largest-sum node of each subtree (a node without elements counts by its own density), and who holds a block
    top: dict[int, Node] = {}
    holds: set[int] = set()
    for n in reversed(nodes):
        mine = top.get(id(n))
        if mine is None or (n.total or n.density, n.chars) >= (mine.total or mine.density, mine.chars):
            top[id(n)] = mine = n
        if n.parent is not None:
            other = top.get(id(n.parent))
            if other is None or (mine.total or mine.density, mine.chars) >= (other.total or other.density, other.chars):
                top[id(n.parent)] = mine
            if n.tag in BLOCKS or id(n) in holds:
                holds.add(id(n.parent))
    # an unclosed tag can leave most of an article in one odd branch: go up while the parent only adds article text
    wide = best
    while wide.parent is not None and wide is not body and (wide.tag not in BLOCKS or wide.tag in ("p", "li", "td", "tr", "tbody", "dd") or wide.parent.tag in ("article", "main")):
        wide = wide.parent
    sure, todo = any(n.tag in ("article", "main") for n in path), [wide]
    while todo:
        for part in todo.pop().parts:
            if isinstance(part, Node):
                if part.skip == MAYBE and 2 * links[id(part)] <= chars[id(part)] and (sure or part.tag in TEXT_TAGS or chars[id(part)] > SHORT):
                    part.skip = NO
                if part.skip == NO:
                    todo.append(part)
    marked, dropped, todo = {id(wide)}, set(), [root]
    while todo:
        node = todo.pop()
        if id(node) in marked:
            continue
        # what stands above the best subtree is walked only; elsewhere a branch's largest sum is content
        if id(node) not in above:
            mark = top[id(node)]
            while mark is not node and mark.tag not in BLOCKS and id(mark) not in marked:
                mark = mark.parent
            marked.add(id(mark))
            if mark is node:
                continue
        run: list[Node] = []
        text = 0
        for part in [*node.parts, None]:
            if isinstance(part, str):
                text += len(part) - part.count(" ") - part.count("\n")
            elif part is not None and part.skip:
                continue
            elif part is not None and part.tag not in BLOCKS and id(part) not in holds:
                run.append(part)
            else:
                # inline elements stay in the line of text that they stand in, unless it's mostly links
                if 2 * sum(n.link_chars for n in run) > text + sum(n.chars for n in run):
                    dropped.update(id(n) for n in run if n.density < threshold and id(n) not in marked)
                run, text = [], 0
                if part is None or not part.chars:
                    continue
                if id(part) in above or part.density >= threshold or _goes_on(part, best, shapes):
                    todo.append(part)
                elif id(part) not in marked:
                    dropped.add(id(part))
    return root, dropped


def blocks(top: Node, dropped: set[int] = frozenset()) -> list[str]:
    """The text blocks under top in page order without the dropped nodes, references decoded and white space collapsed."""
    out, run = [], []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    todo: list = [top]
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            run.append(part)
        elif part.skip or id(part) in dropped:
            continue
        else:
            block = part.tag in BLOCKS
            if block:
                flush()
                todo.append(None)
            elif part.tag in ("br", "wbr", "img"):
                run.append(" " if part.tag == "br" else "")
            todo.extend(reversed(part.parts))
    flush()
    return out


def extract_text(page: str | None) -> str:
    """The main text of a page: its blocks joined by an empty line; empty for a null or textless page."""
    found = content(page) if page else None
    return "\n\n".join(blocks(*found)) if found else ""


def add_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` of pages with `text` and `n_chars` (code points). One row per row of pages, without a shuffle.

    A null or empty page gives an empty text. Broken markup never fails: what is open at the end is closed, and time is
    linear in a page's length, whatever its depth. Repeated rows are extracted one by one. A column of `keep` that is
    named like a result (text, n_chars) gives way to it; other columns are not read, so their names don't matter.
    """
    keep = [c for c in keep if c.lower() not in ("text", "n_chars")]
    kept = pages.select(*[f"`{c}`" for c in keep])
    source = free_name(keep, "html")
    schema = T.StructType([*kept.schema, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts = [extract_text(p) for p in table.column(source).to_pylist()]
            table = table.drop_columns([source]).append_column("text", pa.array(texts, pa.string()))
            yield from table.append_column("n_chars", pa.array(map(len, texts), pa.int64())).to_batches()

    return pages.select(*[f"`{c}`" for c in keep], pages[html_col].alias(source)).mapInArrow(run, schema)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of `pages`."""
    return add_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
