"""A small DOM for one page: parsing, text blocks and simple tree matching."""

from __future__ import annotations

import html
import re
from math import isqrt

import numpy as np

# Fixed values of HTML: elements without content, inline elements, and what ends an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
        "main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
SCOPE = frozenset("html body table ul ol dl div section article main nav aside td th".split())

#: Elements and words of class, id and role that mark what is not the article.
BOILERPLATE_TAGS = frozenset(
    "head nav aside footer form script style noscript template iframe svg button select textarea input dialog menu "
    "object embed canvas audio video map".split()
)
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement advertisements advertising "
    "sponsor sponsored promo banner cookie cookies consent notice notices notification popup modal overlay comment "
    "comments reply replies disqus subscribe newsletter signup login share sharing social breadcrumb breadcrumbs "
    "related recommended widget toolbar pagination pager contentinfo complementary search".split()
)
#: What may stand beside such a word in one class, id or role, or be joined to its end.
LAYOUT_WORDS = frozenset(
    "area bar block bottom box container form google holder inner item items left list main module outer page post posts "
    "reader readers right section site slot thread top unit user users v visitor visitors wrap wrapper".split()
)
MAIN_TAGS = frozenset(["article", "main"])
#: Children from which on rows of a table are arrays; the same rows, sooner.
ARRAY_WIDTH = 64
#: Marked elements that stay marked around the page's main element.
NEVER_AROUND = BOILERPLATE_TAGS - {"form"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[a-z]+")


class Node:
    """An element: its label is its tag and the words of its class, id and role.

    ``boiler`` is 2 if its tag or a hidden attribute marks it, 1 if only a word does, else 0.
    """

    __slots__ = ("tag", "label", "children", "boiler", "number", "kids", "size", "shape")

    def __init__(self, tag: str, label: str, boiler: int) -> None:
        self.tag, self.label, self.boiler = tag, label, boiler
        self.children: list[Node | str] = []
        self.kids: list[Node] = []


def _is_named(word: str) -> bool:
    """A listed word, or one with a layout word joined to it (``commentlist``)."""
    if word in BOILERPLATE_WORDS:
        return True
    return any(word[:cut] in BOILERPLATE_WORDS and word[cut:] in LAYOUT_WORDS for cut in range(2, len(word) - 2))


def _names_boilerplate(token: str) -> bool:
    words = _WORD.findall(token)
    named = [_is_named(w) for w in words]
    return any(named) and all(n or w in LAYOUT_WORDS for n, w in zip(named, words))


def _holds_the_page(form: Node, letters: int) -> bool:
    """A form around the page's paragraphs, as some servers write every page, is no form to leave out."""
    if 2 * _letters(form) <= letters:
        return False
    todo = [form]
    while todo:
        node = todo.pop()
        if node.tag == "p":
            return True
        todo.extend(node.kids)
    return False


def _marks(attributes: str) -> tuple[str, int]:
    """The words of class, id and role, and what they and a hidden attribute mark."""
    words, hidden, named = [], False, False
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden":
            hidden = True
        elif name in ("class", "id", "role"):
            value = value.strip("\"'").lower()
            words += _WORD.findall(value)
            named = named or any(map(_names_boilerplate, value.split()))
    return " ".join(words), 2 if hidden else int(named)


def _letters(node: Node) -> int:
    """Characters of text in an element."""
    n, todo = 0, [node]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, str):
                n += len(child.strip())
            else:
                todo.append(child)
    return n


def parse(page: str | None) -> Node:
    """The tree of a page; open elements end with the page, unknown end tags are passed over."""
    source = page or ""
    root = Node("#page", "#page", 0)
    stack = [root]
    inside: list[tuple[Node, list[Node]]] = []
    forms: list[Node] = []
    at, end = 0, len(source)
    while at < end:
        found = _TOKEN.search(source, at)
        if found is None:
            stack[-1].children.append(source[at:])
            break
        if found.start() > at:
            stack[-1].children.append(source[at : found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1] or found[4]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag in INLINE and stack[depth].tag not in INLINE:
                    break
            continue
        attributes = found[3] if found[2] else found[6]
        for depth in range(len(stack) - 1, 0, -1):
            open_tag = stack[depth].tag
            if tag in CLOSED_BY.get(open_tag, ()):
                del stack[depth:]
            elif open_tag in SCOPE:
                break
        marks, boiler = _marks(attributes) if attributes else ("", 0)
        if tag in BOILERPLATE_TAGS:
            boiler = 2
        elif tag in ("html", "body") or boiler == 1 and tag in INLINE:
            boiler = 0
        node = Node(tag, f"{tag} {marks}" if marks else tag, boiler)
        if tag == "form":
            forms.append(node)
        if tag in MAIN_TAGS:
            inside.append((node, [n for n in stack if n.boiler and n.tag not in NEVER_AROUND]))
        stack[-1].children.append(node)
        stack[-1].kids.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>|\Z", re.I).search(source, at)
            if tag == "title":
                node.children.append(source[at : close.start()])
            at = close.end()
            continue
        stack.append(node)
    if any(around for _, around in inside):
        for node in max(inside, key=lambda x: _letters(x[0]))[1]:
            node.boiler = 0
    if forms:
        letters = _letters(root)
        for node in forms:
            if node.boiler and _holds_the_page(node, letters):
                node.boiler = 0
    return root


class Block:
    """Text of one block: the element it stands in, whether that is in the main and in which marked part.

    ``article`` is the outermost article element around it, or ``None``; ``boiler`` is as in ``Node``, and ``linked``
    tells whether at least half of the text is links.
    """

    __slots__ = ("owner", "text", "main", "boiler", "article", "linked")

    def __init__(self, owner: Node, text: str, main: bool, boiler: int, article: Node | None, linked: bool) -> None:
        self.owner, self.text, self.main, self.boiler = owner, text, main, boiler
        self.article, self.linked = article, linked


def blocks(root: Node) -> list[Block]:
    """The blocks in page order; character references decoded, white space single, blank ones left out.

    Every element gets its ``number`` in page order.  Words mark no inline element, so a paragraph stays whole.
    """
    out: list[Block] = []
    parts: list[str] = []
    state: list = [root, False, 0, None]
    number = links = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(state[0], text, *state[1:], 2 * links >= len("".join(parts).strip())))
            parts.clear()
        links = 0

    # (node, child position, owner, main, boiler, article, link), walked without recursion: pages may nest deeply
    root.number = 0
    todo = [(root, iter(root.children), root, False, 0, None, False)]
    while todo:
        node, children, owner, main, boiler, article, link = todo[-1]
        for child in children:
            if isinstance(child, str):
                if boiler == 2 and node.tag in INLINE and node is not owner:
                    continue
                state[:] = owner, main, boiler, article
                parts.append(child)
                links += len(child.strip()) if link else 0
                continue
            number += 1
            child.number = number
            if child.tag in INLINE:
                if child.tag in ("br", "wbr", "img"):
                    if child.tag == "br":
                        parts.append(" ")
                    continue
                hidden = 2 if child.boiler else boiler
                todo.append((child, iter(child.children), owner, main, hidden, article, link or child.tag == "a"))
            else:
                flush()
                outer = 2 if child.tag == "header" and not main else 0
                todo.append(
                    (
                        child,
                        iter(child.children),
                        child,
                        main or child.tag in MAIN_TAGS,
                        max(boiler, child.boiler, outer),
                        article or (child if child.tag == "article" else None),
                        link,
                    )
                )
            break
        else:
            todo.pop()
            if node is owner:
                flush()
    flush()
    return out


def measure(root: Node, shapes: dict) -> None:
    """Give every element the number of elements in it and its shape: equal where labels are, all the way down."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(node.kids)
    for node in reversed(order):
        node.size = 1 + sum(k.size for k in node.kids)
        node.shape = shapes.setdefault((node.label, *[k.shape for k in node.kids]), len(shapes))


def _looked_up(a: Node, b: Node, known: dict, missing: list) -> int:
    """The number for two elements of one label; a pair of shapes not known yet is noted and counts 1."""
    if a.shape == b.shape:
        return a.size
    if not a.kids or not b.kids:
        return 1
    found = known.get((a.shape, b.shape))
    if found is None:
        missing.append((a, b))
        return 1
    return found


def _head(a: Node, b: Node) -> int:
    """How many children are of equal shapes from the first on; a largest match puts them on each other."""
    n = 0
    for x, y in zip(a.kids, b.kids):
        if x.shape != y.shape:
            break
        n += 1
    return n


class _Table:
    """Best numbers of matched elements among the first children of a and the first of b, row by row.

    A row is one array operation, as a row only rises: each cell is the most of what stands above and what a match adds.
    """

    def __init__(self, a: list[Node], b: list[Node], known: dict, missing: list) -> None:
        self.a, self.b, self.known, self.missing = a, b, known, missing
        self.kinds: dict[int, int] = {}
        self.column = np.array([self.kinds.setdefault(y.shape, len(self.kinds)) for y in b], np.int64)
        self.first = [b[i] for i in np.unique(self.column, return_index=True)[1]]
        self.added: dict[int, np.ndarray] = {}

    def start(self) -> np.ndarray:
        return np.zeros(len(self.b) + 1, np.int64)

    def below(self, row: np.ndarray, x: Node) -> np.ndarray:
        """The row of one child more."""
        if x.shape not in self.added:
            numbers = [_looked_up(x, y, self.known, self.missing) if x.label == y.label else 0 for y in self.first]
            self.added[x.shape] = np.array(numbers, np.int64)
        out = row.copy()
        np.maximum(out[1:], row[:-1] + self.added[x.shape][self.column], out=out[1:])
        return np.maximum.accumulate(out, out=out)

    def best(self) -> int:
        row = self.start()
        for x in self.a:
            row = self.below(row, x)
        return int(row[-1])

    def pairs(self) -> list[tuple[Node, Node]]:
        """The pairs of children behind the last cell.

        Every ``step``-th row is kept and the rows between are made again from it, last ones first, so memory
        grows with the width times the root of the height.
        """
        step = max(1, isqrt(len(self.a)))
        kept, row = [], self.start()
        for i, x in enumerate(self.a):
            if i % step == 0:
                kept.append(row)
            row = self.below(row, x)
        out = []
        j = len(self.b)
        for block in range(len(kept) - 1, -1, -1):
            if not j:
                break
            at = block * step
            rows = [kept.pop()]
            for x in self.a[at : at + step]:
                rows.append(self.below(rows[-1], x))
            i = len(rows) - 1
            while i and j:
                # The first cell of the row with this number: further ones match nothing more.
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                    continue
                j = int(np.searchsorted(rows[i][: j + 1], rows[i][j]))
                i, j = i - 1, j - 1
                out.append((self.a[at + i], self.b[j]))
        return out


def _small_table(a: list[Node], b: list[Node], known: dict, missing: list) -> list[list[int]]:
    """The rows of :class:`_Table` without arrays, whose calls take longer than few cells."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        above, row = rows[-1], [0] * (len(b) + 1)
        for j, y in enumerate(b):
            best = above[j + 1] if above[j + 1] > row[j] else row[j]
            if x.label == y.label:
                both = above[j] + _looked_up(x, y, known, missing)
                if both > best:
                    best = both
            row[j + 1] = best
        rows.append(row)
    return rows


def _small_pairs(a: list[Node], b: list[Node], rows: list[list[int]]) -> list[tuple[Node, Node]]:
    """The pairs of children behind the last cell of ``_small_table``."""
    out = []
    i, j = len(a), len(b)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
    return out


def _best(a: Node, b: Node, known: dict, missing: list) -> int:
    """The most elements that match among the children of two elements."""
    head = _head(a, b)
    one, two = a.kids[head:], b.kids[head:]
    whole = sum(k.size for k in a.kids[:head])
    if not one or not two:
        return whole
    if len(two) < ARRAY_WIDTH:
        return whole + _small_table(one, two, known, missing)[-1][-1]
    return whole + _Table(one, two, known, missing).best()


def _pairs(a: Node, b: Node, known: dict) -> list[tuple[Node, Node]]:
    """The children of two elements that a largest match puts on each other; of several, the first ones of both."""
    head = _head(a, b)
    one, two = a.kids[head:], b.kids[head:]
    same = list(zip(a.kids[:head], b.kids[:head]))
    if not one or not two:
        return same
    if len(two) < ARRAY_WIDTH:
        return same + _small_pairs(one, two, _small_table(one, two, known, []))
    return same + _Table(one, two, known, []).pairs()


def matched(a: Node, b: Node, known: dict) -> int:
    """Simple tree matching: the most elements of a and b that match in order, level by level.

    A pair waits on a stack until the pairs of children it asks for are known, so pages may nest as deeply
    as they like.  Afterwards ``known`` has, by shapes, every pair that :func:`align` asks for.
    """
    shapes: dict = {}
    measure(a, shapes)
    measure(b, shapes)
    if a.label != b.label:
        return 0
    waiting = [(a, b)]
    while waiting:
        x, y = waiting[-1]
        if not x.kids or not y.kids or x.shape == y.shape or (x.shape, y.shape) in known:
            waiting.pop()
            continue
        missing: list[tuple[Node, Node]] = []
        number = 1 + _best(x, y, known, missing)
        if missing:
            waiting.extend(missing)
        else:
            known[x.shape, y.shape] = number
            waiting.pop()
    return _looked_up(a, b, known, [])


def align(a: Node, b: Node) -> dict[int, int]:
    """Numbers of the elements of ``a`` with those of ``b`` that simple tree matching puts them on."""
    known: dict = {}
    out: dict[int, int] = {}
    matched(a, b, known)
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        out[x.number] = y.number
        if x.kids and y.kids:
            todo += _pairs(x, y, known)
    return out
