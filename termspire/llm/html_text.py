"""HTML extraction by tag-path ratios: text and punctuation per path select the content."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from termspire.llm.batches import map_parts, texts

PART_BYTES = 8 << 20
# A path is content if its smoothed ratio is at least this share of the best one.
THRESHOLD = 0.1
# A container is content if it holds this share of the text on content paths.
COVER = 0.8

# Elements without content, with raw text, and those that start and end blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template desc metadata".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
# Markup in which a tag that ends in a slash has no content.
FOREIGN = frozenset("svg math".split())
CLOSES = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("tr td th tbody thead tfoot", "table"),
    "thead": ("tr td th tbody thead tfoot", "table"),
    "tfoot": ("tr td th tbody thead tfoot", "table"),
    "option": ("option", "select"),
}
# Elements, roles and words of class or id that mark what is not the main text.
OUTSIDE = frozenset("head nav footer aside form button select dialog menu script style label object".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# What readers wrote, notices, adverts and the like: gone wherever they stand.
SURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsors sponsored promo promos promotion "
    "banner breadcrumb breadcrumbs sidebar sidenav masthead cookie cookies consent gdpr notice notices popup popups "
    "modal overlay comment comments disqus respond replies newsletter newsletters subscribe signup".split()
)
# Menus, tools and lists of links: inside an article their links decide.
LIKELY = frozenset(
    "nav navbar navigation menu menus aside widget widgets footer share sharing social related recommended "
    "subscription login search pagination pager toolbar skip topbar".split()
)
# Words that say nothing beside those: `comment-list` is comments, `share-price` is neither.
BESIDE = frozenset(
    "a and the site page main post posts article articles story stories entry blog user users reader readers top bottom "
    "left right middle header head foot body content text inner outer wrap wrapper container holder box block "
    "section area region panel bar list lists item items row col column group grid link links button buttons icon "
    "icons form input field title label slot unit zone space frame primary secondary global local sticky fixed "
    "mobile desktop small large big new old more all count thread reply author meta trail message alert".split()
)
MAIN = frozenset("article main".split())
# Elements of text, which no word of an id marks.
TEXTS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that hold the blocks of a text, rather than being one of them.
HOLDERS = MAIN | frozenset("html body section div center td".split())
# Elements that hold all of a page, so that a header in them may be the page's.
WHOLE = frozenset(["", "html", "body"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PUNCTUATION = re.compile("[.,;:!?…、。！？；：，،؟।]")


@dataclass
class Path:
    """A root-to-leaf path of tags: whether it passes a link, or an element whose links decide."""

    linked: bool = False
    marked: bool = False
    below: dict[tuple[str, bool], int] = field(default_factory=dict)


@dataclass
class Block:
    """A run of text between block borders: its element, and its pieces with the numbers of their paths."""

    element: int
    pieces: list[str] = field(default_factory=list)
    paths: list[int] = field(default_factory=list)
    text: str = ""


@dataclass
class Element:
    tag: str
    parent: int
    path: int
    outside: bool
    in_main: bool
    marked: int  # number of the innermost element around, or itself, whose links decide; 0 if none
    header: int  # number of the outermost header around, or itself, outside articles; 0 if none
    heading: bool


def _mark(value: str) -> str:
    """What a class or id says: "sure" or "likely" if one of its names has only such words, else ""."""
    found = ""
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).lower()) if w]
        if all(w in SURE or w in LIKELY or w in BESIDE for w in words):
            if any(w in SURE for w in words):
                return "sure"
            if any(w in LIKELY for w in words):
                found = "likely"
    return found


def _is_outside(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is not main text, and whether it is marked, so that its links decide.

    Names that only have words of marks, or words that say nothing beside them, mark an element:
    adverts, notices and comments are gone anywhere, menus and the like outside an article. Names with
    other words mark nothing, and ids mark no heading and no paragraph.
    """
    if tag in OUTSIDE:
        return True, False
    marked = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, False
        if name == "role" and value.lower() in ROLES:
            return True, False
        if name in ("class", "id") and tag not in ("html", "body") and tag not in MAIN:
            if tag in TEXTS and name == "id" or in_main and tag not in BLOCKS:
                continue
            found = _mark(value)
            if found == "sure" or (found and not in_main):
                return True, False
            marked = marked or bool(found)
    return False, marked


class Page:
    """The blocks of a page in order, its elements by number (parents first), and its paths.

    Elements that are never closed end where HTML ends them: a paragraph at the next block, an item
    at the next item, all at the end of what holds them. A closing tag without an opening one means
    nothing. A line break is white space. Work and memory grow with the source, however deep it nests.
    """

    def __init__(self, source: str) -> None:
        self.elements = [Element("", 0, 0, False, False, 0, 0, False)]
        self.paths = [Path()]
        self.blocks = [Block(0)]
        self._stack = [0]
        # Where in the stack elements of a tag are, lowest first.
        self._open: dict[str, list[int]] = {}
        self._border = False
        self._parse(source)
        for block in self.blocks:
            block.text = " ".join("".join(block.pieces).split())
        self.blocks = [b for b in self.blocks if b.text]
        self._judge_marked()

    def outside(self, block: Block) -> bool:
        return self.elements[block.element].outside

    def sum_up(self, values: dict[int, int]) -> list[int]:
        """For each element the sum of values of elements in it, itself included."""
        sums = [values.get(n, 0) for n in range(len(self.elements))]
        for n in range(len(sums) - 1, 0, -1):
            sums[self.elements[n].parent] += sums[n]
        return sums

    def within(self, top: int) -> list[bool]:
        found = [top == 0] * len(self.elements)
        for n in range(1, len(found)):
            found[n] = n == top or found[self.elements[n].parent]
        return found

    def _top(self, tags) -> int:
        """The highest place in the stack of an open element of some tags; 0 if there is none."""
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=0)

    def _cut_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            tag = self.elements[self._stack.pop()].tag
            self._open[tag].pop()
            self._border = self._border or tag in BLOCKS

    def _add(self, text: str) -> None:
        blank = text.isspace()
        if self._border and blank:
            return
        at = self._stack[-1]
        # An inline element that is not main text is a block of its own.
        if self._border or self.elements[at].outside != self.outside(self.blocks[-1]):
            self.blocks.append(Block(at))
            self._border = False
        self.blocks[-1].pieces.append(text)
        self.blocks[-1].paths.append(self.elements[at].path)
        if not blank and self._top(HEADINGS) and not self._top("a"):
            self._heading(at)

    def _heading(self, at: int) -> None:
        if header := self.elements[at].header:
            self.elements[header].heading = True

    def _push(self, tag: str, attributes: str) -> None:
        number, parent = len(self.elements), self._stack[-1]
        above = self.elements[parent]
        gone, suspect = _is_outside(tag, attributes, above.in_main)
        path = self.paths[above.path].below.get((tag, suspect))
        if path is None:
            path = self.paths[above.path].below[tag, suspect] = len(self.paths)
            before = self.paths[above.path]
            self.paths.append(Path(before.linked or tag == "a", before.marked or suspect))
        header = above.header or (number if tag == "header" and not above.in_main else 0)
        marked = number if suspect else above.marked
        self.elements.append(
            Element(tag, parent, path, above.outside or gone, above.in_main or tag in MAIN, marked, header, False)
        )
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(number)

    def _parse(self, source: str) -> None:
        position, end = 0, len(source)
        while position < end:
            found = _TOKEN.search(source, position)
            stop = found.start() if found else end
            if stop > position:
                self._add(html.unescape(source[position:stop]))
            if not found:
                break
            position = found.end()
            if found.group(2) is None:
                continue
            tag = found.group(2).lower()
            if found.group(1):
                if depth := self._top([tag]):
                    self._cut_to(depth)
                continue
            if tag == "br":
                self._add(" ")
                continue
            if tag in BLOCKS:
                self._border = True
                # Each block ends an open paragraph, so no other block lies above one.
                if depth := self._top("p"):
                    self._cut_to(depth)
            if tag in CLOSES:
                closed, within = (x.split() for x in CLOSES[tag])
                # A row that ends takes its cells with it.
                while (depth := self._top(closed)) > self._top(within):
                    self._cut_to(depth)
            elif tag == "body" and (depth := self._top(["head"])):
                self._cut_to(depth)
            if tag in VOID:
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, position)
                position = close.end() if close else end
                continue
            if found.group(0).endswith("/>") and self._top(FOREIGN):
                continue
            self._push(tag, found.group(3))

    def _judge_marked(self) -> None:
        """Marked elements of links are not main text: those of half links, or of some and no punctuation."""
        sums: dict[int, list[int]] = {}
        for block in self.blocks:
            element = self.elements[block.element]
            if element.marked and not element.outside:
                total = sums.setdefault(element.marked, [0, 0, 0])
                for piece, path in zip(block.pieces, block.paths, strict=True):
                    size = len(piece.strip())
                    total[0] += size
                    total[1] += size if self.paths[path].linked else 0
                    total[2] += len(_PUNCTUATION.findall(piece))
        gone = {e for e, (size, linked, marks) in sums.items() if linked and (2 * linked >= size or not marks)}
        if gone:
            for element in self.elements:
                element.outside = element.outside or element.marked in gone

    def links(self, block: Block) -> int:
        return sum(len(x) for x, path in zip(block.pieces, block.paths, strict=True) if self.paths[path].linked)


def path_ratios(page: Page, blocks: list[Block]) -> dict[int, float]:
    """For each root-to-leaf path its text and punctuation per node, smoothed over its neighbours.

    Neighbours are the paths that first appear just before and after it, so a path between two of
    content gains, and one among links loses.
    """
    nodes: dict[int, int] = {}
    length: dict[int, int] = {}
    marks: dict[int, int] = {}
    for block in blocks:
        for piece, path in zip(block.pieces, block.paths, strict=True):
            size = len(piece.strip())
            if size:
                nodes[path] = nodes.get(path, 0) + 1
                length[path] = length.get(path, 0) + size
                marks[path] = marks.get(path, 0) + len(_PUNCTUATION.findall(piece))
    total = sum(length.values())
    raw = []
    for path, n in nodes.items():
        linked = (0.1 if page.paths[path].linked else 1.0) * (0.1 if page.paths[path].marked else 1.0)
        # The share of the page's text weighs the ratio, so one long line does not beat an article.
        raw.append(linked * (length[path] / n) * ((marks[path] + 0.5) / n) * (length[path] / total))
    smooth = {}
    for at, path in enumerate(nodes):
        beside = [raw[k] for k in (at - 1, at + 1) if 0 <= k < len(raw)]
        smooth[path] = 0.75 * raw[at] + 0.25 * (sum(beside) / len(beside) if beside else raw[at])
    return smooth


def main_text(source: str) -> str:
    """The blocks of the main text, joined by empty lines.

    Paths whose ratio reaches the threshold are content. They are fused in the smallest element that
    holds most of their text, or the article around it, and all blocks there are taken, but for those
    in menus, notices and the like, so that a title or a short paragraph is not lost. Content outside
    it is not lost either: of the smallest element that holds all text on content paths, links aside,
    all blocks are taken that are not mostly links. A header is taken if it lies in what is taken, less
    than the page, and has a heading that is no link.
    """
    page = Page(source)
    shown = [b for b in page.blocks if not page.outside(b)]
    blocks = [b for b in shown if not page.elements[b.element].header]
    if not blocks:
        return ""
    ratios = path_ratios(page, blocks)
    least = THRESHOLD * max(ratios.values(), default=0.0)
    weight: dict[int, int] = {}
    unlinked: dict[int, int] = {}
    for block in blocks:
        at = block.element
        for piece, path in zip(block.pieces, block.paths, strict=True):
            if ratios.get(path, 0.0) >= least:
                weight[at] = weight.get(at, 0) + len(piece)
                unlinked[at] = unlinked.get(at, 0) + (0 if page.paths[path].linked else len(piece.strip()))
    depth = [0] * len(page.elements)
    for n in range(1, len(depth)):
        depth[n] = depth[page.elements[n].parent] + 1
    used = page.sum_up({b.element: 1 for b in blocks})

    def holder(sums: list[int], share: float) -> int:
        holders = [n for n, e in enumerate(page.elements) if e.tag in HOLDERS and used[n] and sums[n] >= share * sums[0]]
        at = best = max(holders, key=lambda n: (depth[n], -n), default=0)
        while at and page.elements[at].tag not in MAIN:
            at = page.elements[at].parent
        return at or best

    tops = [holder(page.sum_up(weight), COVER), holder(page.sum_up(unlinked), 1.0)]
    in_most, in_whole = (page.within(top) for top in tops)
    taken = []
    for block in shown:
        header, at = page.elements[block.element].header, block.element
        if header:
            inside = in_whole if page.elements[tops[1]].tag not in WHOLE else in_most
            top = tops[1] if inside is in_whole else tops[0]
            if page.elements[top].tag in WHOLE or not inside[header] or not page.elements[header].heading:
                continue
        if in_most[at] or (in_whole[at] and 2 * page.links(block) < len("".join(block.pieces))):
            taken.append(block.text)
    return "\n\n".join(taken)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """The main text of every whole page; one row per page.

    Returns key, url, `text` (empty if there is none) and `n_chars`. Null, empty and broken sources
    give what text they have; a text without markup is its own main text. Repeated rows and null
    keys stay; other columns are not looked at. Nothing is shuffled; a page is parsed in a task.
    """

    def run(part: pa.RecordBatch) -> dict:
        found = [main_text(t) for t in texts(part, 2)]
        return {
            "key": part.column(0),
            "url": part.column(1),
            "text": pa.array(found, pa.string()),
            "n_chars": pa.array([len(t) for t in found], pa.int64()),
        }

    schema = f"key {pages.schema[key].dataType.simpleString()}, url string, text string, n_chars bigint"
    made = map_parts(pages, {"key": key, "url": url, "html": source}, run, schema, PART_BYTES)
    return made.withColumnsRenamed({"key": key, "url": url})
