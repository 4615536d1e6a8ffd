"""A small HTML reader: the tree of elements of a page, its text in blocks, and the alignment of two trees.

Reading takes time in proportion to the page: what is open is counted by name,
and each open element knows the node that holds its text. Alignment takes time
in proportion to the smaller tree, as siblings of a folded tree have different
signatures.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")

# Groups of elements.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html head body title tr td th tbody thead tfoot caption option optgroup legend".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
# Marks of elements, of roles, and of words in class and id.
SURE_ELEMENTS = frozenset("nav footer aside button select dialog menu search object canvas audio video".split())
SURE_ROLES = frozenset("navigation contentinfo complementary search menu menubar toolbar dialog alert alertdialog".split())
SOFT_ELEMENTS = frozenset("form header".split())
SOFT_ROLES = frozenset("banner form".split())
SOFT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments disqus reply replies respond discussion sidebar aside menu nav navbar navigation breadcrumb breadcrumbs masthead footer header banner share sharing social "
    "related recommended newsletter subscribe signup login search widget toolbar pagination pager".split()
)
PLAIN_WORDS = frozenset("no not has have with without is open opened closed enabled disabled active allowed hide show".split())  # the token then says something of the element, not what it is
STORY_WORDS = frozenset("article post entry story".split())
BODY_WORDS = frozenset("body content text main".split())

# Of the words above those of what a host shows alike on all pages, which its pages then tell better than a word.
FIXED_WORDS = frozenset("cookie cookies consent gdpr notice notices alert popup modal overlay banner masthead header newsletter subscribe signup login".split())
# What a last word says of a name of three words or more that begins with one of the words above.
PART_WORDS = frozenset("area bar block box button buttons container content form inner item items label link links list panel row section slot text title unit wrap wrapper".split())

SURE, SOFT, ARTICLE, STORY, FIXED = 1, 2, 4, 8, 16


def _said(token: list[str]) -> frozenset[str]:
    """The words that a class or id names its element by: its last one and, if it is short or ends with a part's name, its first."""
    first = token[:1] if len(token) < 3 or token[-1] in PART_WORDS else []
    return SOFT_WORDS.intersection((*first, token[-1], "".join(token)))


def words_of(token: str) -> list[str]:
    """The lower-case words of a class or id: parts at hyphens, underscores and capitals."""
    return [w.lower() for w in _WORD.findall(token)]


def marks_of(name: str, role: str, tokens: list[list[str]], in_article: bool = False) -> int:
    """What an element says of itself: surely no content, perhaps none, an article, or a container so named. A header in an article is the article's."""
    out = SURE if name in SURE_ELEMENTS or role in SURE_ROLES else 0
    if name in ("article", "main") or role in ("article", "main"):
        out |= ARTICLE
    said = [t for t in tokens if t and not PLAIN_WORDS.intersection(t)]
    named = {w for t in said for w in t}
    soft = frozenset().union(*map(_said, said)) if said else frozenset()
    if soft and not (named & STORY_WORDS and named & {"header", "banner"}):
        out |= SOFT
    else:
        soft = frozenset()
    if name in SOFT_ELEMENTS and not (name == "header" and in_article) or role in SOFT_ROLES:
        out |= SOFT
        soft |= {"header" if name == "header" or role == "banner" else name}
    if soft and soft <= FIXED_WORDS:
        out |= FIXED
    if any(STORY_WORDS.intersection(t) and BODY_WORDS.intersection(t) for t in said):
        out |= STORY
    return out


class Page:
    """``tags``, ``parents``, ``signatures`` and ``marks`` of the elements in page order; ``blocks`` of (element, block, text, characters in links), and ``raw``, the contents of scripts and the like as (element, contents).

    A block has several entries where marked elements stand inside its line.
    Hidden elements have no text.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.signatures, self.marks = ["#page"], [-1], ["#page"], [0]
        self.own = [True]  # whether the element has a node of its own in the folded tree
        self.blocks, self.raw = [], []
        self._stack, self._text, self._n = [0], [], 0
        self._out, self._link, self._holder = [False], [False], [0]
        self._open: Counter[str] = Counter()
        at, n = 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            if not m:
                self._add(source[at:])
                break
            if m.start() > at:
                self._add(source[at : m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if m["end"]:
                self._end(name)
                continue
            attrs = m["attrs"]
            self._start(name, attrs)
            if name in RAW and not attrs.endswith("/>"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                z = close.start() if close else n
                self.raw.append((self._stack[-1], source[at:z]))
                at = (source.find(">", close.end() - 1) + 1 or n) if close else n
                self._end(name)
        self._flush()

    def _add(self, text: str) -> None:
        if not self._out[-1]:
            self._text.append((self._holder[-1], self._link[-1], html.unescape(text) if "&" in text else text))

    def _flush(self) -> None:
        parts, self._text = self._text, []
        a, found = 0, False
        while a < len(parts):
            z = a
            while z < len(parts) and parts[z][0] == parts[a][0]:
                z += 1
            text = " ".join("".join([p[2] for p in parts[a:z]]).split())
            if text:
                links = sum(len(" ".join(p[2].split())) for p in parts[a:z] if p[1])
                self.blocks.append((parts[a][0], self._n, text, min(links, len(text))))
                found = True
            a = z
        self._n += found

    def _pop_to(self, depth: int) -> None:
        gone = [self.tags[k] for k in self._stack[depth:]]
        if any(t in BLOCK for t in gone):
            self._flush()
        self._open.subtract(gone)
        del self._stack[depth:], self._out[depth:], self._link[depth:], self._holder[depth:]

    def _shut(self, names: set[str], within) -> None:
        """Close the innermost of ``names``, unless an element of ``within`` lies further in."""
        if not any(self._open[x] for x in names):
            return
        for d in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[d]]
            if tag in names:
                self._pop_to(d)
                return
            if tag in within:
                return

    def _start(self, name: str, attrs: str) -> None:
        if name == "br":
            self._add(" ")
            return
        if name in CLOSES_P:
            self._shut({"p"}, BLOCK)
        if name in CLOSES:
            self._shut(*CLOSES[name])
        if name in BLOCK:
            self._flush()
        if name in VOID or name in ("html", "body") and self._open[name]:
            return
        role, hidden, tokens, ident = "", False, [], ""
        if len(attrs) > 1:
            for key, *value in _ATTR.findall(attrs):
                key, value = key.lower(), "".join(value)
                if key == "class":
                    tokens = value.split()
                elif key == "id":
                    ident = value.strip()
                elif key == "role":
                    role = value.strip().lower()
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                    hidden = True
                elif key == "itemprop" and value == "articleBody":
                    role = role or "article"
        marks = marks_of(name, role, [words_of(t) for t in (*tokens, ident)], self._open["article"] + self._open["main"] > 0)
        # numbers in classes and ids tell pages apart, not places
        classes = " ".join(sorted({_DIGITS.sub("", t).strip("-_") for t in tokens} - {""}))
        ident = _DIGITS.sub("", ident).strip("-_")
        signature = name + (f".{classes}" if classes else "") + (f"#{ident}" if ident else "") + (f"@{role}" if role else "")
        own = name in BLOCK or name in RAW or bool(marks)
        self.tags.append(name)
        self.parents.append(self._stack[-1])
        self.signatures.append(signature)
        self.marks.append(marks)
        self.own.append(own)
        k = len(self.tags) - 1
        self._stack.append(k)
        self._open[name] += 1
        self._out.append(self._out[-1] or hidden or name in RAW)
        self._link.append(name == "a" or self._link[-1])
        self._holder.append(k if own else self._holder[-1])

    def _end(self, name: str) -> None:
        if self._open[name]:
            for d in range(len(self._stack) - 1, 0, -1):
                if self.tags[self._stack[d]] == name:
                    self._pop_to(d)
                    return
        if name == "p":
            self._flush()


def folded(page: Page) -> tuple[list, list[int]]:
    """The page's tree with equal siblings folded into one repeated node, as [(parent, signature, marks)] in preorder, and each element's node in it."""
    children: dict[tuple[int, str], int] = {}
    tree, node = [(-1, page.signatures[0], 0)], [0]
    for k in range(1, len(page.tags)):
        above = node[page.parents[k]]
        if not page.own[k]:
            node.append(above)
            continue
        key = (above, page.signatures[k])
        if key not in children:
            children[key] = len(tree)
            tree.append((above, page.signatures[k], page.marks[k]))
        node.append(children[key])
    return tree, node


def _heaviest_increasing(places: list[int], weights: list[int]) -> list[int]:
    """Indexes of a run of rising places of the greatest total weight."""
    ranks = sorted(places)
    best: list[tuple[int, int]] = [(0, -1)] * (len(ranks) + 1)  # Fenwick tree of (total, last index) over ranks
    back = []
    for k, (place, weight) in enumerate(zip(places, weights)):
        at = bisect_left(ranks, place)
        top, i = (0, -1), at
        while i > 0:
            top = max(top, best[i])
            i -= i & -i
        back.append(top[1])
        own, i = (top[0] + weight, k), at + 1
        while i <= len(ranks):
            best[i] = max(best[i], own)
            i += i & -i
    top, i = (0, -1), len(ranks)
    while i > 0:
        top = max(top, best[i])
        i -= i & -i
    out, k = [], top[1]
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def tree_matching(a: list, b: list) -> list[int]:
    """Simple tree matching of two folded trees [(parent, signature, ...)]: the node of ``b`` that each node of ``a`` is aligned with, or -1. As many nodes as can be are aligned, equal roots, parents before children, siblings in their order."""
    kids: list[list[int]] = [[] for _ in a]
    for k, node in enumerate(a):
        if node[0] >= 0:
            kids[node[0]].append(k)
    below = {(node[0], node[1]): k for k, node in enumerate(b)}
    like = [-1] * len(a)  # the one node of b that has the same path
    for k, node in enumerate(a):
        like[k] = below.get((like[node[0]] if node[0] >= 0 else -1, node[1]), -1) if node[0] < 0 or like[node[0]] >= 0 else -1
    size, chosen = [0] * len(a), [[] for _ in a]
    for k in range(len(a) - 1, -1, -1):
        if like[k] >= 0:
            met = [x for x in kids[k] if like[x] >= 0]
            chosen[k] = [met[i] for i in _heaviest_increasing([like[x] for x in met], [size[x] for x in met])]
            size[k] = 1 + sum(size[x] for x in chosen[k])
    out, todo = [-1] * len(a), [0] if a and like[0] >= 0 else []
    while todo:
        k = todo.pop()
        out[k] = like[k]
        todo += chosen[k]
    return out
