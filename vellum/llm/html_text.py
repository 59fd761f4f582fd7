"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks at block elements. A linear classifier over a block's own tag, length, links and
the boilerplate names and elements around it gives evidence for content or boilerplate, which becomes the
capacity from the source or to the sink. Neighbours in the page and blocks of one container are joined by
smoothness edges, stronger the closer they are in the document tree, and every block of the page's main part by
an edge to a node that stands for that part and has evidence of its own. The minimum cut, by max-flow, is the
labelling of least total cost; the blocks on the source's side are the text. So a block that says little of itself (a
heading, a short line, a list of links) goes with its surroundings, and boilerplate within the main part is cut off.

Parsing takes time in proportion to the page's length, however broken or deep its markup.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.common import column, spread

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset(
    "head script style noscript template textarea title select option button svg math iframe object canvas audio video datalist xmp noembed noframes".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter output progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br".split()
)
BOILER = frozenset("nav footer aside form menu dialog fieldset".split())
MAIN = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening element ends open ones: for each the names it ends, up to one of the names it stays within.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})
}
# Words in class and id attributes.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus dock foot footer form gdpr header hidden legal login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signin signup skip skyscraper social sponsor sponsored subscribe subscription tags toolbar topbar widget".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main maincontent post story text".split())
PHRASES = re.compile(r"©|\ball rights reserved\b|\bcookies?\b.{0,60}\b(?:accept|policy|agree)|\bsubscribe\b|\bsign (?:in|up)\b", re.I)

# Weights of the classifier, in hundredths. None is beyond what the edges around a block can outweigh together, but for OUTSIDE, BOILER_NAME
# and HEADER, which outweigh the edges of one block and the best it can say of itself.
OUTSIDE, BOILER_NAME, HEADER, MAIN_NAME, LONG, SHORT, LINKS, PARAGRAPH, HEAD_TAG, PHRASE, BIAS = -1800, -1800, -1800, 150, 300, -150, -400, 150, 250, -200, -50
#: Evidence of the main part itself for each block that it has, and the edge from it to each of them.
MAIN_PART, IN_MAIN = 600, 600
#: Smoothness between neighbours, and between blocks of one container; divided by 1 + their distance in the tree.
NEAR, KIN = 300, 200

#: Items of lists and tables: without links they say nothing themselves, and go with what is around them.
ITEMS = frozenset("li dt dd td th".split())
# Headings of what readers write, in four languages.
READERS = re.compile(
    r"(?:\d+ )?(?:(?:reader |user |all |latest |recent )?(?:comments?|responses?|replies|discussion)|(?:leave|post|add|write) (?:a |your )?(?:comment|reply)|join the (?:conversation|discussion)"
    r"|(?:leser)?kommentare?|lesermeinungen|diskussion|(?:schreibe|verfasse) einen kommentar|commentaires?|(?:laisser|poster) un commentaire|réactions|comentarios?|deja (?:un|tu) comentario|opiniones de (?:los )?lectores)"
    r"(?: ?\(\d+\)|: ?\d+|:)?", re.I
)

OPEN = re.compile(r"</?([A-Za-z][^\s/>]*+)")
#: Attributes up to the end of the tag: quotes count behind `=` only.
ATTRS = re.compile(r"""((?:[^>=]++|=(?:\s*+(?:"[^"]*+"|'[^']*+'))?+)*+)>""")
NAMES = re.compile(r"""(?:\b(?:class|id|role|itemprop)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+)))""", re.I)
HIDES = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*+=\s*+["']?true)|display\s*+:\s*+none""", re.I)
HAS_MAIN = re.compile(r"<main(?=[\s/>])", re.I)
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")
#: Elements that tell what a block is, by the nearest one around it.
KINDS = HEADING | frozenset("p li td th blockquote pre".split())
OUT = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64()),
        ("n_kept", pa.int64())
    ]
)


class Element:
    __slots__ = ("tag", "parent", "depth", "never", "hard", "form", "part", "main", "header", "names", "kind")

    def __init__(self, tag: str, parent: "Element | None", attrs: str, starts: frozenset[str] = MAIN) -> None:
        """starts: the elements that begin the page's main part."""
        words: set[str] = set()
        if attrs:
            for m in NAMES.finditer(attrs):
                words.update(w.lower() for w in SPLIT.split(m[1] or m[2] or m[3] or "") if w)
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.never = tag in NEVER or bool(parent and parent.never)
        outer = tag in ("html", "body")
        # What is around the main part says nothing of it: a form or a name there ends where the outermost main part begins.
        begins = tag in starts and not (parent and parent.part)
        #: The element that began the main part.
        self.part = self if begins else parent.part if parent else None
        hard = tag in BOILER and tag != "form" or bool(attrs and not outer and HIDES.search(attrs)) or bool(
            words & {"navigation", "contentinfo", "complementary", "search", "banner"} and "role" in attrs.lower()
        )
        self.hard = hard or bool(parent and parent.hard)
        self.form = tag == "form" or bool(parent and parent.form) and not begins
        self.main = bool(parent and parent.main) or tag in MAIN or "articlebody" in words
        self.header = bool(parent and parent.header) or tag == "header" and not (parent and parent.main)
        # The innermost name that says something counts; boilerplate inside the main part is boilerplate.
        own = 0 if outer else -1 if words & BOILER_WORDS else 1 if words & MAIN_WORDS else 0
        if tag == "main" and begins:
            own = max(own, 0)
        self.names = own or (parent.names if parent and not begins else 0)
        if parent and parent.names < 0 and not begins:
            self.names = -1
        self.kind = tag if tag in KINDS else parent.kind if parent else ""


class Block:
    __slots__ = ("element", "text", "chars", "link_chars")

    def __init__(self, element: Element, text: str, link_chars: int) -> None:
        self.element, self.text, self.chars, self.link_chars = element, text, len(text), link_chars


class Stack:
    """The open elements, with the places of each name among them, so that no search runs over the depth."""

    def __init__(self, root: Element) -> None:
        self.all = [root]
        self.places: dict[str, list[int]] = {}
        #: Places of the open elements that are not inline.
        self.boxes = [0]

    def push(self, e: Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.all))
        if e.tag not in INLINE:
            self.boxes.append(len(self.all))
        self.all.append(e)

    def cut(self, place: int) -> bool:
        """Close the elements from a place on; whether one of them was not inline."""
        boxes = len(self.boxes)
        while len(self.all) > place:
            self.places[self.all.pop().tag].pop()
        while self.boxes[-1] >= place:
            self.boxes.pop()
        return len(self.boxes) < boxes

    def last(self, names) -> int:
        """The place of the innermost element of these names; 0 if there is none."""
        return max((own[-1] for n in names if (own := self.places.get(n))), default=0)

    @property
    def box(self) -> Element:
        return self.all[self.boxes[-1]]


class Tags:
    """The tags of a page, read from left to right.

    An unclosed comment lasts to the end. A tag whose quotes leave no end for it ends at the next `>`, and so do all tags
    after it, so that no stretch is read for nothing twice.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quoted = page, page.rfind(">"), True

    def after(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """(start, end, name, attributes, whether it closes) of the next tag; comments and declarations have no name."""
        page, at = self.page, self.page.find("<", at)
        while at >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                return at, end + 3 if end >= 0 else len(page), "", "", False
            if at > self.last:
                return None
            if page[at + 1] in "!?":
                return at, page.find(">", at) + 1, "", "", False
            if m := OPEN.match(page, at):
                inside = ATTRS.match(page, m.end()) if self.quoted else None
                self.quoted = inside is not None
                end = inside.end() if inside else page.find(">", m.end()) + 1
                if end:
                    return at, end, m[1].lower(), page[m.end() : end - 1], page[at + 1] == "/"
            at = page.find("<", at + 1)
        return None


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order; text of scripts, styles, controls and comments is in none."""
    found: list[Block] = []
    starts = frozenset({"main"}) if HAS_MAIN.search(page) else MAIN  # articles beside a main element are teasers
    root = Element("", None, "")
    stack = Stack(root)
    parts: list[str] = []
    links, home, at = 0, root, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                found.append(Block(home, text, min(links, len(text))))
            parts.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links, home
        if not text or stack.all[-1].never or not parts and text.isspace():
            return
        if not parts:
            home = stack.box
        parts.append(text)
        if any(e.tag == "a" for e in stack.all[-4:]):
            links += len(text)

    each = Tags(page)
    while (item := each.after(at)) is not None:
        start, end, tag, attrs, closes = item
        add(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br" or tag in VOID and tag in INLINE:
            if parts and tag == "br":
                parts.append(" ")
            continue
        if closes:
            place = stack.last((tag,))
            if tag in INLINE and place < stack.boxes[-1]:
                continue  # not among the inline elements that are open here
            if not place or stack.cut(place):
                flush()
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", close.end()) + 1 if close else 0
            at = at or len(page)
            continue
        if tag not in INLINE:
            flush()
            if stack.box.tag == "p":  # a block element ends an open paragraph
                stack.cut(stack.boxes[-1])
            if tag in ENDS:
                ended, within = ENDS[tag]
                bound = stack.last(within)
                if (place := stack.last(ended)) > bound:
                    stack.cut(
                        min(own for n in ended if (own := next((x for x in stack.places.get(n, ()) if x > bound), 0))) if tag == "tr"
                        else place
                    )
            elif tag == "body":
                stack.cut(stack.last(("html",)) + 1)
            if tag in VOID:
                continue
        stack.push(Element(tag, stack.all[-1], attrs, starts))
    add(page[at:])
    flush()
    return found


def evidence(block: Block) -> int:
    """The classifier: over 0 for content, under 0 for boilerplate. That a block is in the main part is left to the cut."""
    e, words = block.element, block.text.count(" ") + 1
    v = BIAS
    if e.hard or e.form:
        v += OUTSIDE
    if e.header:
        v += HEADER
    v += MAIN_NAME if e.names > 0 else BOILER_NAME if e.names < 0 else 0
    plain = e.kind in ITEMS and not block.link_chars
    v += min(LONG, LONG * words // 20) if words > 4 else 0 if plain else SHORT
    v -= BIAS if plain else 0
    v += HEAD_TAG if e.kind in HEADING else PARAGRAPH if e.kind in ("p", "blockquote", "pre") else 0
    if block.link_chars * 2 > block.chars:
        v += LINKS
    if not e.main and words < 40 and PHRASES.search(block.text):
        v += PHRASE
    return v


def distance(a: Element, b: Element) -> int:
    """Steps between two elements through their nearest common ancestor."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def readers(found: list[Block]) -> set[int]:
    """Blocks of what readers write under a heading that says so, and the heading: up to the next heading of its rank within the element that holds it."""
    out: set[int] = set()
    rank, within = 9, None
    for i, b in enumerate(found):
        e = b.element
        level = int(e.kind[1]) if e.kind in HEADING else 9
        if within is not None:
            up = e
            while up is not None and up.depth > within.depth:
                up = up.parent
            if up is not within or level <= rank:
                within = None
        if within is None and 1 < level < 9 and b.chars < 60 and READERS.fullmatch(b.text):
            while e.tag not in HEADING:
                e = e.parent
            rank, within = level, e.parent
        if within is not None:
            out.add(i)
    return out


def graph(found: list[Block]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(evidence by node, edges (i, j, capacity)). The blocks are the first nodes, a node for each main part follows.

    Neighbours are joined, each block with the one before it in its container, and blocks of a main part with its node.
    """
    value, out, last, part = [evidence(b) for b in found], [], {}, {}
    for i in readers(found):
        value[i] += OUTSIDE
    for j, b in enumerate(found):
        if j:
            out.append((j - 1, j, NEAR // (1 + distance(found[j - 1].element, b.element))))
        up = b.element.parent if b.element.parent is not None else b.element
        i = last.get(id(up))
        if i is not None and i != j - 1:
            out.append((i, j, KIN // (1 + distance(found[i].element, b.element))))
        last[id(up)] = j
        if b.element.part is not None:
            if id(b.element.part) not in part:
                part[id(b.element.part)] = len(value)
                value.append(0)
            value[part[id(b.element.part)]] += MAIN_PART
            out.append((j, part[id(b.element.part)], IN_MAIN))
    return value, [x for x in out if x[2] > 0]


def min_cut(unary: list[int], pairs: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least cost: True has cost max(0, -unary), False max(0, unary), unequal neighbours the edge's capacity.

    A node whose evidence outweighs all its edges is sure of its label; its edges then count as evidence
    of its neighbours. What is left after that goes to max-flow. Ties are content's.
    """
    n = len(unary)
    value, label = list(unary), [None] * n
    around: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in pairs:
        around[i][j] = around[i].get(j, 0) + c
        around[j][i] = around[j].get(i, 0) + c
    slack = [sum(a.values()) for a in around]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and (value[i] >= slack[i] or value[i] < -slack[i]):
            label[i] = value[i] >= slack[i]
            for j, c in around[i].items():
                if label[j] is None:
                    value[j] += c if label[i] else -c
                    slack[j] -= c
                    del around[j][i]
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        flow = MaxFlow(len(rest) + 2)
        s, t = len(rest), len(rest) + 1
        for i in rest:
            if value[i] > 0:
                flow.add(s, number[i], value[i], 0)
            elif value[i] < 0:
                flow.add(number[i], t, -value[i], 0)
            for j, c in around[i].items():
                if i < j and label[j] is None:
                    flow.add(number[i], number[j], c, c)
        flow.run(s, t)
        sinks = flow.reaches(t)
        for i in rest:
            label[i] = not sinks[number[i]]
    return label


class MaxFlow:
    """Dinic's algorithm on integer capacities, without recursion."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def add(self, i: int, j: int, there: int, back: int) -> None:
        for a, b, c in ((i, j, there), (j, i, back)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.room.append(c)

    def _levels(self, s: int, t: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s] = 0
        line = deque([s])
        while line:
            i = line.popleft()
            for e in self.out[i]:
                j = self.to[e]
                if self.room[e] > 0 and level[j] < 0:
                    level[j] = level[i] + 1
                    line.append(j)
        return level

    def run(self, s: int, t: int) -> int:
        total = 0
        while (level := self._levels(s, t))[t] >= 0:
            nth, path, at = [0] * len(self.out), [], s
            while True:
                if at == t:
                    c = min(self.room[e] for e in path)
                    total += c
                    for e in path:
                        self.room[e] -= c
                        self.room[e ^ 1] += c
                    k = next(k for k, e in enumerate(path) if self.room[e] == 0)
                    at = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while nth[at] < len(self.out[at]):
                    e = self.out[at][nth[at]]
                    if self.room[e] > 0 and level[self.to[e]] == level[at] + 1:
                        break
                    nth[at] += 1
                if nth[at] < len(self.out[at]):
                    path.append(e)
                    at = self.to[e]
                elif path:
                    at = self.to[path.pop() ^ 1]
                    nth[at] += 1
                else:
                    break
        return total

    def reaches(self, t: int) -> list[bool]:
        """Nodes from which t can still be reached."""
        seen = [False] * len(self.out)
        seen[t] = True
        line = deque([t])
        while line:
            j = line.popleft()
            for e in self.out[j]:
                i = self.to[e]
                if self.room[e ^ 1] > 0 and not seen[i]:
                    seen[i] = True
                    line.append(i)
        return seen


def extract(page: str | None) -> tuple[str, int, int]:
    """(main text, blocks, kept blocks)."""
    found = blocks(page or "")
    if not found:
        return "", 0, 0
    value, pairs = graph(found)
    labels = min_cut(value, pairs)
    best = max(value[: len(found)])
    if not any(labels[: len(found)]) and best > LINKS:
        # A page of a few short blocks: the best of them is its text, if it is no boilerplate.
        labels = min_cut([v - best for v in value], pairs)
    kept = [b.text for b, keep in zip(found, labels) if keep]
    return "\n\n".join(kept), len(found), len(kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars, n_blocks, n_kept.

    The whole html is read; null and empty html, and pages without text, give an empty text. Broken markup
    is read as far as it goes: an unclosed comment or script lasts to the end. Repeated rows give equal
    rows; an empty table gives none.
    """

    def run(batches):
        for batch in batches:
            found = [extract(h.as_py()) for h in batch.column(2)]
            cols = [[f[0] for f in found], [len(f[0]) for f in found], [f[1] for f in found], [f[2] for f in found]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, type=OUT.types[i + 2]) for i, c in enumerate(cols))], schema=OUT
            )

    return spread(pages).select(
        column(id_col).cast("long").alias("page_id"), column(url_col).cast("string").alias("url"), column(html_col).alias("html")
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
