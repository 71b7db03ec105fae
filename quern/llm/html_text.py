"""Main text of web pages by tag-path ratios.

A page is read once into text nodes, each with its root-to-leaf path of block
tags. Over all nodes of a path, mean length and mean punctuation are fused as a
product of logarithms, lowered by the share of the text that is links, and
smoothed with the ratio of all sibling paths (same parent) together.

The ratios decide in three steps. Text that is no link, summed up the paths, finds
the main part: where the page marks articles or main, those that hold a fair share
of the text (FAIR); else the walk from the root into the one container that holds most
of what is left (CORE). The heaviest path in it sets the page's ratio. Paths in the
main part are content from a small share of that ratio on (LOW); of the containers
within it, one whose running text falls far below it (MID) is none if it is a list of
boxes (several elements of one path that hold most of it: remarks) or largely links.
Short blocks in a box of their own (captions, formulas, a dialogue) stay.
Paths elsewhere need nearly the ratio and a fair share of the text (HIGH).

What a page says about itself is a prior. Elements that are by HTML no article (nav,
header, footer, aside, forms, scripts and the like) and hidden ones are left out.
Names in class, id or role (NOT_CONTENT) scale a path's ratio and text by PRIOR. An id
is often made from a heading: it names a part only if all its words do (NOT_CONTENT,
_PLACES), never for a heading, and not for an element whose heading reads as the id
does, unless it tells of remarks (_REMARKS).
Words after one of _STATE (has-sidebar, overflow-hidden) tell how an element looks,
not what it is, and names around the page's only article, or around most of its
text, are those of its layout: neither counts.

Headings and list items in a marked main part may be links altogether: their share of
links is smoothed with that of all the text there.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one space; nothing is cut.

Defined results: null and empty pages give empty text; text without any tag is
one block; repeated rows give equal results; page_id and url are carried
through, null or not; an empty table gives none.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches

#: Shares of the page's ratio, see above.
LOW, MID, HIGH = 0.02, 0.5, 0.75
#: Shares of the text: of a container to walk into, of a further part to count.
CORE, FAIR = 0.6, 0.3
#: Share of a container's text in elements of one path, or in links, that makes it a list.
LISTED, LINKED = 0.8, 0.3
#: What a name that tells no article leaves of a path's ratio and text.
PRIOR = 0.01
#: Names around a text that are told apart; an element below so many named ones is named anyhow.
MOST_BARS = 50
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Fixed values of HTML: elements without content, with raw content, and inside lines.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math select option canvas object audio video".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"},
    **{t: {"p"} for t in "p div ul ol dl table section article aside nav header footer main form h1 h2 h3 h4 h5 h6 pre blockquote figure fieldset address hr".split()},
}
#: Elements and words in class, id or role that tell a part is not the article.
_NOT_TAGS = frozenset("nav header footer aside form button menu dialog head".split()) | _RAW
NOT_CONTENT = frozenset(
    "ad ads adv adbox adslot adunit adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead footer colophon sidebar sidebars rail aside widget widgets toolbar cookie cookies consent gdpr notice notices alert popup modal overlay comment comments "
    "commentlist disqus respond reply replies responses feedback topbar discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager copyright legal "
    "contentinfo complementary hidden".split()
)
#: Words beside listed ones in the ids of parts of a layout, and words of readers' remarks.
_PLACES = frozenset("area bar block bottom box button buttons container content form global inner item items left links list main page panel primary right secondary section site story stories top post posts wrap wrapper".split())
_REMARKS = frozenset("comment comments commentlist disqus respond".split())
#: A listed word after one of these in a class, id or role is a state, not a part.
_STATE = frozenset("has with without no not overflow".split())
#: Elements whose text may well be a link inside an article.
_LINKABLE = frozenset("h1 h2 h3 h4 h5 h6 li dt dd".split())
#: Elements that hold parts of a page, and more that a layout may use so.
_CONTAINERS = frozenset("div section article main".split())
_LAYOUT = _CONTAINERS | frozenset("html body center table tbody tr td".split())
_TITLES = frozenset("h1 h2".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: With these words, a header is the article's own.
_OWN_HEADER = frozenset("entry post article story content".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？¿¡]")


class Tree:
    """The root-to-leaf paths of a page's elements as numbers: a path is its parent's number and a tag with its class."""

    def __init__(self):
        self.parents, self.tags, self.known, self.held, self.most, self.sizes = [0], [""], {}, [0], [0], [0]

    def path(self, parent: int, tag: str, name: str) -> int:
        at = self.known.setdefault((parent, tag, name), len(self.parents))
        if at == len(self.parents):
            self.parents.append(parent)
            self.tags.append(tag)
            self.held.append(0)  # elements of this path with text in them
            self.most.append(0)  # the most text, without links, of one of them
            self.sizes.append(0)  # that of all
        return at


class Node:
    """A block's text: where it stands, its pieces, how much of it is links."""

    __slots__ = ("path", "tag", "barred", "inside", "bars", "linkable", "named", "pieces", "links")

    def __init__(self, path, tag, barred, inside, bars, linkable):
        self.path, self.tag, self.barred, self.inside, self.pieces, self.links = path, tag, barred, inside, [], 0
        self.bars, self.linkable, self.named = bars, linkable, False


def _parts(value: str) -> set[str]:
    """Words of a class, id or role, without those that tell a state."""
    words = set()
    for token in value.split():
        for word in re.split(r"[^a-z]+", token):
            if word in _STATE:
                break
            words.add(word)
    return words - {""}


def _slug(text: str) -> str:
    return "-".join(re.findall(r"[a-z0-9]+", text.lower()))


def _names(tag: str, attributes: str) -> tuple[str, bool, str | None, bool]:
    """The class for the path, whether class or role bar the element, the id if that bars it, and whether it is hidden."""
    path, barred, id_, hidden = "", False, None, False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "role"):
            words = _parts(value)
            words -= {"header"} if words & _OWN_HEADER else set()
            barred = barred or not words.isdisjoint(NOT_CONTENT)
            path = path or (f".{value}" if name == "class" else "")
        elif name == "id":
            words = _parts(value)
            if not words.isdisjoint(NOT_CONTENT) and words <= NOT_CONTENT | _PLACES and tag not in _HEADINGS:
                id_ = _slug(value)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            hidden = True
    return path, barred, id_, hidden


def _unbar_headed(found: list[Node], ids: dict[int, str]) -> None:
    """Ids that a heading in the element spells name nothing, but for those of remarks."""
    headed = set()
    for node in found:
        if node.tag in _HEADINGS and any(number in ids for number, _ in node.bars):
            slug = _slug(html.unescape("".join(node.pieces)))
            headed |= {number for number, _ in node.bars if ids.get(number) == slug and _REMARKS.isdisjoint(slug.split("-"))}
    if headed:
        for node in found:
            node.bars = tuple(bar for bar in node.bars if bar[0] not in headed)


def _unbar_layout(found: list[Node]) -> None:
    """Settle which names count: not those around the only article, nor those around most of the text."""
    sizes: dict[tuple, int] = defaultdict(int)
    articles: dict[tuple, int] = defaultdict(int)
    for node in found:
        if not node.barred and (size := sum(len(s.strip()) for s in node.pieces)):
            sizes[node.bars] += size
            if node.inside:
                articles[node.bars] += size
    layout: tuple = ()
    if () not in articles and sizes:
        around = [bars for bars, size in articles.items() if not any(within for _, within in bars) and size > sizes.get((), 0)]
        around += [bars for bars, size in sizes.items() if 2 * size > sum(sizes.values())]
        layout = min(around, key=lambda bars: (len(bars), -sizes[bars]), default=())
    of_layout = set(layout)
    for node in found:
        node.named = not of_layout.issuperset(node.bars)


class Element:
    """An open element: its path, what holds for all text in it, whether it has text."""

    __slots__ = ("tag", "path", "barred", "inside", "bars", "linkable", "has_text", "size")

    def __init__(self, tag, path, barred, inside, bars, linkable):
        self.tag, self.path, self.barred, self.inside, self.bars, self.linkable, self.has_text, self.size = tag, path, barred, inside, bars, linkable, False, 0


def nodes(page: str) -> list[Node]:
    """Blocks of text in page order."""
    return _read(page)[0]


def _read(page: str) -> tuple[list[Node], Tree]:
    found: list[Node] = []
    tree, ids = Tree(), {}
    root = Element("", 0, False, False, (), False)
    stack: list[Element] = []
    open_ = defaultdict(int)  # open elements by tag
    links, at, node, elements = 0, 0, None, 0

    def pop() -> str:
        e = stack.pop()
        open_[e.tag] -= 1
        if e.has_text:
            above = stack[-1] if stack else root
            tree.held[e.path] += 1
            tree.most[e.path] = max(tree.most[e.path], e.size)
            tree.sizes[e.path] += e.size
            above.has_text, above.size = True, above.size + e.size
        return e.tag

    def text(s: str) -> None:
        nonlocal node
        e = stack[-1] if stack else root
        if node is None:
            if not s.strip():
                return
            e.has_text = True
            node = Node(e.path, e.tag, e.barred, e.inside, e.bars, e.linkable)
            found.append(node)
        node.pieces.append(s)
        node.links += len(s) if links else 0
        e.size += 0 if links or e.barred else len(s.strip())

    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        if begin > at:
            text(page[at:begin])
        m = _TOKEN.match(page, begin)
        if not m:
            text("<")
            at = begin + 1
            continue
        at = m.end()
        closing, tag = m[1], (m[2] or "").lower()
        if not tag:
            continue
        if tag in _INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else 1
            continue
        if tag == "br":
            text(" ")
            continue
        if closing:
            if open_.get(tag):
                while pop() != tag:
                    pass
                node, links = None, 0
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if tag in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes") or end:
                at = end.end() if end else len(page)
            continue
        if tag in _VOID:
            node = node if tag in ("img", "wbr", "input") else None
            continue
        closes = _CLOSES.get(tag, ())
        for i in range(len(stack) - 1, -1, -1) if any(open_.get(t) for t in closes) else ():
            if stack[i].tag in closes:
                while len(stack) > i:
                    pop()
                break
            if stack[i].tag in ("table", "ul", "ol", "div", "article", "section", "body") and tag != "body":
                break
        node, links = None, 0
        name, named, id_, hidden = _names(tag, m[3] or "")
        above = stack[-1] if stack else root
        own_header = tag == "header" and above.inside
        inside = above.inside or tag in ("article", "main")
        exempt = tag in ("html", "body", "main")
        bars = above.bars
        if (named or id_) and not exempt and len(bars) < MOST_BARS:
            bars, elements = (*bars, (elements, inside)), elements + 1
            if not named:
                ids[elements - 1] = id_
        barred = above.barred or (hidden and not exempt) or (tag in _NOT_TAGS and not own_header)
        stack.append(Element(tag, tree.path(above.path, tag, name), barred, inside, bars, above.linkable or tag in _LINKABLE))
        open_[tag] += 1
    while stack:
        pop()
    _unbar_headed(found, ids)
    _unbar_layout(found)
    return found, tree


class Ratio:
    """Sums over text nodes, and the fused ratio of them."""

    __slots__ = ("size", "n", "marks", "links")

    def __init__(self):
        self.size = self.n = self.marks = self.links = 0

    def add(self, size: int, n: int, marks: int, links: int) -> None:
        self.size, self.n, self.marks, self.links = self.size + size, self.n + n, self.marks + marks, self.links + links

    def join(self, r: Ratio) -> None:
        self.add(r.size, r.n, r.marks, r.links)

    def fused(self, linked: float | None = None) -> float:
        linked = self.links / self.size if linked is None else linked
        return math.log1p(self.size / self.n) * math.log1p(1 + self.marks / self.n) * (1 - linked)


def _upwards(tree: Tree, own: dict[int, float]) -> list[float]:
    """For each path, the sum of ``own`` over it and all below it: children come after their parents."""
    total = [0.0] * len(tree.parents)
    for path, x in own.items():
        total[path] += x
    for path in range(len(total) - 1, 0, -1):
        total[tree.parents[path]] += total[path]
    return total


def _main_parts(tree: Tree, mass: list[float], seen: list[bool], marks: dict[int, float]) -> set[int]:
    """Paths of the elements that hold the main text, by text that is no link: marked ones, else down the heaviest containers."""
    if marks:
        most = max(marks.values())
        return {path for path, m in marks.items() if m >= FAIR * most}
    children: dict[int, list[int]] = defaultdict(list)
    for path in range(1, len(seen)):
        if seen[path]:
            children[tree.parents[path]].append(path)
    at = 0
    one = lambda p: mass[p] * tree.most[p] / max(1, tree.sizes[p])  # of the largest element: several of a path are parts of one text
    while inner := [p for p in children[at] if tree.tags[p] in _LAYOUT and children.get(p) and one(p) > CORE * mass[at]]:
        at = inner[0]
    beside = tree.parents[at]  # a title beside the container is its own
    titles = {p for p in children[beside] if tree.tags[p] in _TITLES} if at and tree.tags[beside] in _CONTAINERS else set()
    return {at, *titles}


def _poor(tree: Tree, parts: list[int | None], sums: dict[int, Ratio], level: float) -> list[bool]:
    """For each path, whether it or a container between it and its main part is a list of boxes, or largely links, far below ``level``."""
    n = len(tree.parents)
    running: list[Ratio | None] = [None] * n  # of each container, in paragraphs and containers
    whole = [Ratio() for _ in range(n)]
    for path, r in sums.items():
        whole[path].join(r)
        if tree.tags[path] == "p" or tree.tags[path] in _CONTAINERS:
            running[path] = Ratio()
            running[path].join(r)
    listed, titled = [0] * n, [0] * n  # the most text of a child that is a box of several; text of headings beside
    for path in range(n - 1, 0, -1):
        parent = tree.parents[path]
        whole[parent].join(whole[path])
        if tree.tags[path] in _HEADINGS:
            titled[parent] += whole[path].size
        if running[path] is not None:
            running[parent] = running[parent] or Ratio()
            running[parent].join(running[path])
            if tree.tags[path] in _CONTAINERS and tree.held[path] >= 2 * max(1, tree.held[parent]):
                listed[parent] = max(listed[parent], whole[path].size)
    poor = [False] * n
    for path in range(1, n):
        poor[path] = poor[tree.parents[path]]
        r = running[path]
        if parts[path] is None or parts[path] == path or tree.tags[path] not in _CONTAINERS or r is None:
            continue
        size = whole[path].size
        if r.fused() < MID * level and (listed[path] >= LISTED * (size - titled[path]) or whole[path].links >= LINKED * size):
            poor[path] = True
    return poor


def _kept_paths(blocks: list[tuple[Node, str]], tree: Tree) -> set[tuple[int, bool]]:
    """(path, named) of the blocks whose smoothed, fused ratio is near enough to the page's."""
    paths: dict[tuple[int, bool], Ratio] = defaultdict(Ratio)
    groups: dict[tuple[int, bool], Ratio] = defaultdict(Ratio)
    about: dict[tuple[int, bool], Node] = {}
    n = len(tree.parents)
    seen = [False] * n
    for node, text in blocks:
        key = node.path, node.named
        about[key] = node
        sums = len(text), 1, len(_PUNCTUATION.findall(text)), min(node.links, len(text))
        paths[key].add(*sums)
        groups[tree.parents[node.path], node.named].add(*sums)
        seen[node.path] = True
    for path in range(n - 1, 0, -1):
        seen[tree.parents[path]] |= seen[path]
    prior = {key: PRIOR if key[1] else 1.0 for key in paths}
    own_mass = {key: (r.size - r.links) * prior[key] for key, r in paths.items()}
    by_path: dict[int, float] = defaultdict(float)
    marked = [0] * n  # the outermost article or main around a path
    for path in range(1, n):
        marked[path] = marked[tree.parents[path]] or (path if tree.tags[path] in ("article", "main") else 0)
    marks: dict[int, float] = defaultdict(float)
    for key, m in own_mass.items():
        by_path[key[0]] += m
        if about[key].inside and not key[1]:
            marks[marked[key[0]]] += m
    mass = _upwards(tree, by_path)
    found = _main_parts(tree, mass, seen, marks)
    parts: list[int | None] = [0 if 0 in found else None] * n  # the main part that a path is in
    leads = [False] * n  # to a main part
    for path in range(1, n):
        parts[path] = path if parts[tree.parents[path]] is None and path in found else parts[tree.parents[path]]
    for path in range(n - 1, -1, -1):
        leads[path] |= path in found
        leads[tree.parents[path]] |= leads[path]
    within, sums = Ratio(), {}
    for key, r in paths.items():
        if parts[key[0]] is not None:
            within.join(r)
            sums.setdefault(key[0], Ratio()).join(r)
    fused = {}
    for key, r in paths.items():
        linked = r.links / r.size
        if parts[key[0]] is not None and about[key].inside and about[key].linkable:
            linked = (linked + within.links / within.size) / 2
        fused[key] = (r.fused(linked) + groups[tree.parents[key[0]], key[1]].fused(linked)) / 2 * prior[key]
    heaviest = max(paths, key=lambda key: (own_mass[key] if parts[key[0]] is not None else -1, key), default=None)
    if heaviest is None:
        return set()
    level = fused[heaviest]
    poor = _poor(tree, parts, sums, level)
    fair = FAIR * sum(mass[p] for p in found)

    def is_kept(key: tuple[int, bool]) -> bool:
        path, parent = key[0], tree.parents[key[0]]
        if fused[key] <= 0:
            return False
        if parts[path] is None:
            holder = path if tree.tags[path] in _CONTAINERS or leads[parent] else parent
            return fused[key] >= HIGH * level and mass[holder] >= fair
        return fused[key] >= LOW * level and not poor[path]

    return {key for key in paths if is_kept(key)}


def content(page: str | None) -> list[str]:
    """The blocks that are the page's main text, in order."""
    found, tree = _read(page or "")
    blocks = [(n, t) for n in found if not n.barred and (t := " ".join(html.unescape("".join(n.pieces)).split()))]
    kept = _kept_paths(blocks, tree)
    return [t for n, t in blocks if (n.path, n.named) in kept]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [" ".join(content(cell.as_py())) for cell in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    short_batches(pages.sparkSession)
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_tag_paths": op5_tag_paths}
ORACLE_SQL: dict[str, str] = {}
