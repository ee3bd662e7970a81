"""Main text of web pages: paragraphs score their ancestors, the best container and its siblings stay."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values: element kinds of HTML and words that name what is not article
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes noscript template svg math".split())
DROPPED = RAW | set("head nav footer aside button select dialog menu object canvas audio video map datalist".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
CLOSES_SAME = {  # an open element of the values ends where the key begins, up to the boundary
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WHOLE = {"html", "body", "article", "main"}  # never dropped by a name
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert|adverts|advertisement|advertisements|adbox|adsense|sponsor|sponsored|sponsors|promo|promoted|promotion|"
    r"nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|pagination|pager|masthead|header|topbar|toolbar|footer|"
    r"sidebar|sidebars|aside|widget|widgets|related|recommended|comment|comments|commentlist|disqus|respond|responses|replies|"
    r"cookie|cookies|consent|gdpr|notice|notices|alert|banner|popup|modal|overlay|newsletter|subscribe|subscription|"
    r"share|sharing|social|login|signin|signup|search|searchbox|skip|hidden)(?:$|[\s_-]|\d)",
    re.I,
)
PARAGRAPHS = {"p", "pre", "li", "dd", "dt", "td", "th", "blockquote", "figcaption"}
NOTICE = re.compile(
    r"\b(?:we|site|website|page) uses? cookies\b|\baccept (?:all )?cookies\b|\bcookie (?:policy|settings)\b|"
    r"\ball rights reserved\b|^(?:\(c\)|©|copyright\b)|^readers? (?:say|said|write|wrote|comment)",
    re.I,
)
LINE = 80  # characters
MODIFIERS = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|with|without)[_-]+[^\s_-]+", re.I)  # has-sidebar names what stands beside
MOST = 0.8  # of a page's points: an element with so many is the article, whatever its name
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form"}

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass
class Node:
    tag: str
    parent: Node | None
    order: int
    dropped: bool = False
    article: bool = False  # inside an article or main element, itself included
    named: bool = False  # a form, or named like what is not article
    score: float = 0.0
    chars: int = 0  # of text below
    linked: int = 0  # of these, in links
    points: float = 0.0  # of the blocks below
    bare: int = 0  # of the text below, characters outside paragraphs, lists, quotes and headings
    children: list = field(default_factory=list)
    holder: Node | None = None  # the nearest block element, itself if it is one


@dataclass
class Block:
    """A stretch of text between the bounds of block elements."""

    parent: Node
    text: str
    linked: int


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def is_dropped(tag: str, source: str, article: bool) -> bool:
    """Whether an element with everything in it is no part of an article."""
    if tag in DROPPED or tag == "header" and not article:
        return True
    if not source or tag in WHOLE:
        return False
    given = attributes(source)
    if given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true":
        return True
    return "display:none" in given.get("style", "").replace(" ", "").lower()


def is_named(tag: str, source: str) -> bool:
    """Whether an element is a form or has a class or id of what is not article."""
    if tag == "form" or not source:
        return tag == "form"
    given = attributes(source)
    return any(NAMES.search(MODIFIERS.sub("", given[k])) for k in ("class", "id") if k in given)


def parse(page: str) -> tuple[Node, list[Block]]:
    """The tree of block elements and the blocks of text outside dropped elements, in page order.

    Tags may be missing, crossed or cut off: an end tag closes the nearest open element of its name, and
    nothing if there is none; a paragraph ends where another block begins.
    """
    root = Node("#root", None, 0)
    root.holder = root
    stack, blocks = [root], []
    is_open: dict[str, int] = {}  # how many open elements bear a name: a search that cannot succeed is not begun
    run: list[str] = []
    linked: list[str] = []
    links = made = at = 0

    def end_block() -> None:
        nonlocal run, linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                blocks.append(Block(stack[-1].holder, text, min(len(text), len(" ".join(html.unescape("".join(linked)).split())))))
        run, linked = [], []

    def close(depth: int) -> None:
        nonlocal links
        if any(n.tag not in INLINE for n in stack[depth:]):
            end_block()
        for n in stack[depth:]:
            is_open[n.tag] -= 1
            links -= n.tag == "a"
        del stack[depth:]

    def add(piece: str) -> None:
        if piece and not stack[-1].dropped:
            run.append(piece)
            if links:
                linked.append(piece)

    position, n = 0, len(page)
    while position < n:
        found = TOKEN.search(page, position)
        if found is None:
            add(page[position:])
            break
        add(page[position : found.start()])
        position = found.end()
        tag = (found[1] or "").lower()
        if not tag:
            continue  # a comment, a declaration or a tag that is cut off
        if page[found.start() + 1] == "/":
            if not is_open.get(tag):
                if tag == "p":
                    end_block()
                continue
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag == tag:
                    close(at)
                    break
                if tag in INLINE and stack[at].tag not in INLINE:
                    break
            continue
        if tag in CLOSES_P and is_open.get("p"):
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag == "p":
                    close(at)
                    break
                if stack[at].tag not in INLINE and stack[at].tag not in HEADINGS:
                    break
        if tag in CLOSES_SAME:
            same, bounds = CLOSES_SAME[tag]
            for at in range(len(stack) - 1, 0, -1) if any(map(is_open.get, same)) else ():
                if stack[at].tag in bounds:
                    break
                if stack[at].tag in same:
                    close(at)
                    if tag != "tr":
                        break
        if tag not in INLINE:
            end_block()
        elif tag == "br":
            add(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            ended = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, position)
            position = ended.end() if ended else n
            continue
        top = stack[-1]
        made += 1
        inside = top.article or tag in ("article", "main")
        named = is_named(tag, found[2])
        dropped = top.dropped or is_dropped(tag, found[2], inside) or named and tag in INLINE
        node = Node(tag, top, made, dropped, inside, named)
        node.holder = top.holder if tag in INLINE else node
        if tag not in INLINE and not node.dropped:
            node.parent = top.holder
            top.holder.children.append(node)
        stack.append(node)
        is_open[tag] = is_open.get(tag, 0) + 1
        links += tag == "a"
    end_block()
    return root, blocks


def points_of(block: Block) -> float:
    """Points grow with length and commas."""
    return 0.5 if block.parent.tag in HEADINGS else 1 + block.text.count(",") + min(len(block.text) / 100, 3)


def ancestry(blocks: list[Block]) -> list[Node]:
    """The elements with a block below them, parents before their children."""
    seen: dict[int, Node] = {}
    for block in blocks:
        node = block.parent
        while node is not None and node.order not in seen:
            seen[node.order] = node
            node = node.parent
    return [seen[order] for order in sorted(seen)]


def without_named(blocks: list[Block]) -> list[Block]:
    """The blocks outside named elements, but for those that turn out to be the article's own wrappers.

    Such a wrapper is a form with ``MOST`` of the page's points. Where no article or main element has a paragraph outside
    named elements, it is also any element with so many points or around an article or main that is not itself named.
    """
    nodes = ancestry(blocks)
    named = {n.order for n in nodes if n.named and n.tag not in WHOLE}
    if not named:
        return blocks
    own = {n.order for n in nodes if n.tag in ("article", "main") and not n.named}
    for block in blocks:
        block.parent.points += points_of(block)
    around = set(own)  # elements that hold such an article or main, or are one
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.points += node.points
            if node.order in around:
                around.add(node.parent.order)
    inside, below = set(), set()  # of an own article or main; of a named element
    for node in nodes:
        above = node.parent.order if node.parent is not None else -1
        if node.order in own or above in inside:
            inside.add(node.order)
        if node.order in named or above in below:
            below.add(node.order)
    outside = any(b.parent.order in inside and b.parent.order not in below and b.parent.tag not in HEADINGS for b in blocks)
    least = MOST * sum(map(points_of, blocks))
    lifted = {n.order for n in nodes if n.order in named and n.points >= least and (n.tag == "form" or not outside)}
    if not outside:
        lifted |= named & around
    lost: set[int] = set()
    for node in nodes:
        if node.order in named and node.order not in lifted or node.parent is not None and node.parent.order in lost:
            lost.add(node.order)
    return [block for block in blocks if block.parent.order not in lost]


def score(blocks: list[Block]) -> list[Node]:
    """Give every container its points and return the containers, parents before their children.

    A block's points go to the container around its paragraph in full, to the next one by half and to the one
    after by a third. Each container loses its share of linked text. Lengths are added up once, children before parents.
    """
    for block in blocks:
        block.parent.chars += len(block.text)
        block.parent.linked += block.linked
        block.parent.bare += len(block.text) if block.parent.tag not in HEADINGS and block.parent.tag not in PARAGRAPHS else 0
        points = points_of(block)
        holder = block.parent
        if holder.tag in HEADINGS or holder.tag in PARAGRAPHS:
            holder = holder.parent or holder
        for share in (1, 2, 3):
            if holder is None:
                break
            holder.score += points / share
            holder = holder.parent
    nodes = ancestry(blocks)
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.bare += node.bare
        node.score *= 1 - node.linked / node.chars
    return nodes


def kept_siblings(best: Node) -> set[int]:
    """The siblings of the best container that belong to it where no article or main element tells.

    Strong ones have a fifth of its score. Headings and others of few links stay where they stand between strong ones. Before
    the first and after the last, a section must consist of paragraphs, lists or quotes, or be longer than a line: a
    short line of bare text there, like a copyright or a count of readers, is none. Lines that ask for consent, name
    rights or bring in readers' words go wherever they stand.
    """
    least, children = best.score * 0.2, best.parent.children
    strong = [i for i, n in enumerate(children) if n is best or n.score >= max(least, 1e-9)]
    out = {children[i].order for i in strong}
    for i, other in enumerate(children):
        if other.order in out:
            continue
        density = other.linked / other.chars if other.chars else 1.0
        few = density < 0.25 if other.chars > LINE or other.tag in HEADINGS else density == 0
        section = other.tag in HEADINGS or other.tag in PARAGRAPHS or other.bare * 2 < other.chars or other.chars > LINE
        if few and (strong[0] < i < strong[-1] or section):
            out.add(other.order)
    return out


def main_text(page: str | None) -> str:
    """The article's blocks joined by two line feeds; empty for null, empty and text-free pages.

    The best container is raised to the article or main element around it, if there is one. Else those of its siblings stay
    that ``kept_siblings`` names.
    """
    if not page:
        return ""
    blocks = without_named(parse(page)[1])
    nodes = score(blocks)
    if not nodes:
        return ""
    best = max(nodes, key=lambda n: (n.score, -n.order))
    around, node = None, best
    while node is not None:
        if node.tag in ("article", "main") and (around is None or around.tag == "main"):
            around = node if around is None or node.tag == "article" else around
        node = node.parent
    if around is not None:
        best = around
    kept = {best.order}
    if best.parent is not None and around is None:
        kept |= kept_siblings(best)
    elif best.parent is not None:
        least = best.score * 0.2
        kept |= {n.order for n in best.parent.children if n.tag == best.tag and n.chars and n.linked / n.chars < 0.5 and n.score >= least}
    for node in nodes:
        if node.parent is not None and node.parent.order in kept:
            kept.add(node.order)
    beside = around is None and best.parent is not None and best.parent.tag != "#root"
    stays = [b for b in blocks if b.parent.order in kept or beside and b.parent is best.parent and not b.linked]
    if around is None:
        stays = [b for b in stays if len(b.text) > 2 * LINE or not NOTICE.search(b.text)]
    return "\n\n".join(b.text for b in stays)


def extract_text(pages: DataFrame, source: str = "html") -> DataFrame:
    """Replace the page column by ``text string, n_chars long`` (code points); all other columns stay.

    Rows are independent: repeated pages give repeated rows, an empty table an empty one. Null and empty pages,
    and pages without an article, give an empty text. Given columns ``text`` and ``n_chars`` are replaced.
    """
    kept = [c for c in pages.columns if c not in (source, "text", "n_chars")]
    given = pages.select(*kept, source)
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(len(kept))]
            arrays = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "text", "n_chars"])

    return given.mapInArrow(run, schema)
