"""Small DOM trees of pages, and their alignment by simple tree matching.

A tree holds block elements and, as leaves, the runs of text between them. Inline markup is
part of a run. Trees may be of any depth: nothing here calls itself level by level.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|select|object|xmp|noembed|noframes)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-z!?][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""([a-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
MOST_CELLS = 40_000  # of a table that is held whole; longer lists are matched in linear memory

# Names of elements.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter nobr output progress q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr audio video picture canvas map area embed source track param link meta base col".split()
)
VOID = set("hr img input meta link col area base embed source track wbr br param".split())
CLOSED_BY_LIKE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
SIMILAR = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "thead": {"tbody"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
ASIDE_TAGS = set("nav footer aside form button dialog menu menuitem fieldset head".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ASIDE_WORDS = re.compile(
    r"^(ads?|adverts?|advertisements?|advertising|sponsor(ed|s)?|promos?|promotions?|banners?|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|"
    r"comments?|commentlist|respond|replies|disqus|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|subscription|share|sharing|social|related|recommended|"
    r"widgets?|login|signup|search|toolbar|copyright|[a-z]*(nav|menu|sidebar|footer))$"
)
#: Words that say nothing of what a part is: with these around it, a name is still that of the part.
NEUTRAL = set(
    "site page main top bottom left right bar box container wrapper wrap list links link section area block button buttons icon icons form slot slots unit units inner outer global primary secondary "
    "mobile desktop sticky fixed widget post posts article articles entry item items panel column col group holder content text title thread policy dialog overlay toggle row zone blog the my js".split()
)
STATES = {"has", "with", "no", "without", "is", "js", "not"}  # a name that starts so tells of a part, it isn't that part
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WHOLE = {"html", "body", "main", "article"}
BOUNDS = {"article": frozenset({"article"}), "main": frozenset({"main"})}


@dataclass(slots=True)
class Node:
    """An element, or a run of text (tag ``#``)."""

    tag: str
    label: str
    aside: bool = False
    text: str = ""
    children: list[Node] = field(default_factory=list)
    shape: int = 0
    size: int = 1
    holds: frozenset[str] = frozenset()  # which of ``BOUNDS`` are in it


@lru_cache(maxsize=100_000)
def _names_aside(name: str) -> bool:
    """Whether a whole name is that of a part outside an article: ``related-posts`` is, but not
    ``related-work``, of which the list knows one word only."""
    parts = [re.sub(r"[0-9]+$", "", x) for x in re.split("[_-]+", name)]
    if parts[0] in STATES:
        return False
    parts = [x for x in parts if x]
    known = [bool(ASIDE_WORDS.match(x)) for x in parts]
    return any(known) and all(k or x in NEUTRAL for k, x in zip(known, parts, strict=True))


def _marks(tag: str, rest: str) -> tuple[str, bool]:
    """The label of an element, and whether its attributes mark it as no part of an article."""
    if not rest.strip(" /"):
        return tag, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    aside = any(map(_names_aside, names.split())) or found.get("role", "").lower() in ASIDE_ROLES or "hidden" in found or bool(HIDDEN.search(found.get("style", "")))
    return f"{tag}.{re.sub(r'[0-9]+', '', names)}", aside and tag not in WHOLE or (tag == "article" and bool(re.search(r"\bcomments?\b", names)))


def parse(page: str) -> Node:
    """The tree of a page, however broken its markup; references are decoded and white space in
    a run of text is one space."""
    root = Node("html", "html")
    stack, parts, at = [root], [], 0
    opened: Counter[str] = Counter()  # how many elements of each name are on the stack
    marked: list[list] = []  # open inline elements that are marked: tag, how many of it are open, place in the stack

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            stack[-1].children.append(Node("#", "#", text=text))

    def close(depth: int) -> None:
        opened.subtract(x.tag for x in stack[depth:])
        del stack[depth:]

    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in INLINE:  # ends a marked element, unless it belongs to one of its name within
                if marked and marked[-1][0] == tag:
                    marked[-1][1] -= 1
                    if not marked[-1][1]:
                        flush()
                        close(marked.pop()[2])
                continue
            if opened[tag] > 0:
                depth = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag)
                flush()
                close(depth)
                while marked and marked[-1][2] >= depth:
                    marked.pop()
            continue
        if tag in INLINE:
            if tag in ("br", "img"):
                parts.append(" ")
            elif marked and marked[-1][0] == tag:
                marked[-1][1] += 1
            elif tag not in VOID and m["rest"] and _marks(tag, m["rest"])[1]:
                flush()
                marked.append([tag, 1, len(stack)])
                stack.append(Node(tag, _marks(tag, m["rest"])[0], True))
                opened[tag] += 1
                stack[-2].children.append(stack[-1])
            continue
        flush()
        if tag in ("html", "body", "head"):
            if tag == "head":
                continue
            if tag == "body":
                close(1)
            continue
        while len(stack) > 1 and (stack[-1].tag == "p" or tag in HEADINGS and stack[-1].tag in HEADINGS):
            close(len(stack) - 1)
        like = SIMILAR.get(tag, {tag} if tag in CLOSED_BY_LIKE else None)
        if like and any(opened[x] > 0 for x in like):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSED_BY_LIKE[tag]:
                    break
                if stack[k].tag in like:
                    close(k)
                    break
        if tag == "hr":
            continue
        while marked and marked[-1][2] >= len(stack):
            marked.pop()
        label, aside = _marks(tag, m["rest"])
        node = Node(tag, label, aside or tag in ASIDE_TAGS)
        stack[-1].children.append(node)
        if not m["rest"].endswith("/") or tag not in VOID:
            stack.append(node)
            opened[tag] += 1
    parts.append(page[at:])
    flush()
    finish(root)
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes in page order."""
    found, todo = [], [root]
    while todo:
        found.append(todo.pop())
        todo.extend(reversed(found[-1].children))
    return found


def finish(root: Node) -> None:
    """Set sizes, what subtrees hold, and shapes: equal for two subtrees with the same labels."""
    for x in reversed(_nodes(root)):
        x.size = 1 + sum(c.size for c in x.children)
        x.shape = hash((x.label, *(c.shape for c in x.children)))
        x.holds = BOUNDS.get(x.tag, frozenset()).union(*(c.holds for c in x.children if c.holds))


def same(a: Node, b: Node, found: dict[int, Node]) -> None:
    """Match two subtrees of one shape node by node."""
    for x, y in zip(_nodes(a), _nodes(b), strict=True):
        if x.tag == "#":
            found[id(x)] = y


def known(a: Node, b: Node, memo: dict[tuple[int, int], int]) -> int:
    """The weight of a pair whose weight is worked out or plain."""
    if a.label != b.label:
        return 0
    return a.size if a.shape == b.shape else memo.get((a.shape, b.shape), 0)


def unknown(left: list[Node], right: list[Node], memo: dict[tuple[int, int], int]) -> list[tuple[Node, Node]]:
    """Pairs of two lists whose weights are still to be worked out, one for each pair of shapes."""
    lefts, rights = {x.shape: x for x in left}, {y.shape: y for y in right}
    return [(x, y) for x in lefts.values() for y in rights.values() if x.label == y.label and x.shape != y.shape and (x.shape, y.shape) not in memo]


def weigh(pairs: list[tuple[Node, Node]], memo: dict[tuple[int, int], int]) -> None:
    """Simple tree matching: the most nodes that match in each pair, in order and level by level."""
    todo, begun = list(pairs), set()
    while todo:
        a, b = todo[-1]
        key = a.shape, b.shape
        if key in memo:
            todo.pop()
            continue
        head, left, right = trim(a.children, b.children)
        if key not in begun:
            begun.add(key)  # also ends here on clashing shapes
            todo.extend(unknown(left, right, memo))
            continue
        todo.pop()
        alike = a.children[:head] + a.children[head + len(left) :]
        memo[key] = 1 + sum(x.size for x in alike) + best(left, right, memo)


def trim(left: list[Node], right: list[Node]) -> tuple[int, list[Node], list[Node]]:
    """Leave out the common shapes at the front (their number is returned) and at the end."""
    head, n = 0, min(len(left), len(right))
    while head < n and left[head].shape == right[head].shape:
        head += 1
    tail = 0
    while tail < n - head and left[-1 - tail].shape == right[-1 - tail].shape:
        tail += 1
    return head, left[head : len(left) - tail], right[head : len(right) - tail]


def table(left: list[Node], right: list[Node], memo: dict[tuple[int, int], int]) -> list[list[int]]:
    """Weights of the best matching of all pairs of prefixes."""
    rows = [[0] * (len(right) + 1)]
    for x in left:
        above, row = rows[-1], [0]
        for k, y in enumerate(right):
            most = above[k + 1] if above[k + 1] > row[k] else row[k]
            if x.label == y.label:
                most = max(most, above[k] + known(x, y, memo))
            row.append(most)
        rows.append(row)
    return rows


def last_row(left: list[Node], right: list[Node], memo: dict[tuple[int, int], int]) -> np.ndarray:
    """The last row of :func:`table`, in linear memory and a row at a time."""
    numbers: dict[int, int] = {}
    at = np.array([numbers.setdefault(y.shape, len(numbers)) for y in right], np.int64)
    kinds = list({y.shape: y for y in reversed(right)}.values())
    kinds.sort(key=lambda y: numbers[y.shape])
    weights: dict[int, np.ndarray] = {}
    row = np.zeros(len(right) + 1, np.int64)
    for x in left:
        if x.shape not in weights:
            weights[x.shape] = np.array([known(x, y, memo) for y in kinds], np.int64)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[x.shape][at]))
    return row


def best(left: list[Node], right: list[Node], memo: dict[tuple[int, int], int]) -> int:
    """The weight of the best matching of two lists."""
    if not left or not right:
        return 0
    return int(last_row(left, right, memo)[-1]) if len(left) * len(right) > MOST_CELLS else table(left, right, memo)[-1][-1]


def pairs_of(left: list[Node], right: list[Node], memo: dict[tuple[int, int], int]) -> list[tuple[Node, Node]]:
    """The pairs of the best matching of two lists. Long lists are halved where the best
    matchings of both halves add up to the most (Hirschberg)."""
    weigh(unknown(left, right, memo), memo)
    found, todo = [], [(left, right)]
    while todo:
        left, right = todo.pop()
        if not left or not right:
            continue
        if len(left) > 1 and len(left) * len(right) > MOST_CELLS:
            half = len(left) // 2
            cut = int(np.argmax(last_row(left[:half], right, memo) + last_row(left[half:][::-1], right[::-1], memo)[::-1]))
            todo += [(left[:half], right[:cut]), (left[half:], right[cut:])]
            continue
        rows = table(left, right, memo)
        i, j = len(left), len(right)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                found.append((left[i - 1], right[j - 1]))
                i, j = i - 1, j - 1
    return found


def align(a: Node, b: Node, memo: dict[tuple[int, int], int], found: dict[int, Node]) -> None:
    """Add to ``found`` each text leaf of ``a``, by identity, with its counterpart in ``b``."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if a.label != b.label:
            continue
        if a.shape == b.shape:
            same(a, b, found)
            continue
        head, left, right = trim(a.children, b.children)
        tail = len(a.children) - head - len(left)
        for x, y in zip(a.children[:head], b.children[:head], strict=True):
            same(x, y, found)
        for k in range(1, tail + 1):
            same(a.children[-k], b.children[-k], found)
        todo += pairs_of(left, right, memo)


def leaves(root: Node) -> list[Node]:
    """Text leaves in page order."""
    return [x for x in _nodes(root) if x.tag == "#"]


def open_leaves(root: Node, inside: bool = False) -> list[Node]:
    """Text leaves that no element around them marks as outside the article. Of a page's header
    nothing stays; of an article's, its headings."""
    found, todo = [], [(root, inside, False)]
    while todo:
        node, inside, heading = todo.pop()
        if not heading:
            if node.tag == "#":
                found.append(node)
                continue
            if node.aside and not (not inside and node.holds):
                continue
            if node.tag == "header" and not inside:
                continue
        if heading or node.tag == "header":  # of an article
            for c in reversed(node.children):
                if c.tag in HEADINGS:
                    todo.extend((x, True, False) for x in reversed(leaves(c)))
                elif c.children and not c.aside:
                    todo.append((c, True, True))
            continue
        inside = inside or node.tag in ("article", "main")
        todo.extend((c, inside, False) for c in reversed(node.children))
    return found


def regions(root: Node, tag: str) -> list[Node]:
    """The outermost elements of a tag that are not marked as outside the article."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == tag:
            found += [] if node.aside else [node]
        elif not node.aside or tag in node.holds:
            todo.extend(reversed(node.children))
    return found


def body(root: Node) -> tuple[list[Node], bool]:
    """The leaves that may be content, and whether the page itself says where its article is."""
    for tag in ("article", "main"):
        if found := [x for r in regions(root, tag) for x in open_leaves(r, True)]:
            return found, True
    return open_leaves(root), False
