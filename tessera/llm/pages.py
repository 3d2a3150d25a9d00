"""HTML extraction by wrapper induction: trees of a host's pages are aligned; what varies is content."""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACES = re.compile(r"\s+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "canvas"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Elements that are never part of an article, whatever their class.
APART = RAW | {"nav", "menu", "aside", "footer", "form", "button", "select", "option", "input", "label", "fieldset", "dialog", "head", "audio", "video", "map"}
#: Words of class, id, role and aria-label that tell what a node holds. Matched as whole words between - _ or case changes.
_LABEL = re.compile(
    r"(?:^|[\s_-])(ads?|adsby\w*|adsense|ad(?:box|slot|unit|block|wrap|container)\w*|\w*advert\w*|\w*banner\w*|\w*sponsor\w*|promo\w*|affiliate|nav|\w*navbar\w*|navigation|\w*menu\w*|\w*breadcrumb\w*|toc|pagination|pager|"
    r"header|masthead|topbar|\w*footer\w*|foot|\w*sidebar\w*|sidenav|side|rail|widget\w*|related|recommend\w*|trending|popular|share|sharing|social|follow|\w*comments?|comment\w*|disqus|respond|replies|reply|responses?|reactions?|reviews|discussion|"
    r"coment\w*|kommentar\w*|werbung|anzeigen?|publicidad|publicite|teasers?|outbrain|taboola|\w*cookie\w*|consent|gdpr|notices?|notification\w*|alert\w*|\w*popup\w*|modal|overlay|dialog|paywall|subscri\w*|\w*newsletter\w*|signup|login|"
    r"search|searchbox|searchform|forms?|copyright|legal|disclaimer|skip|complementary|contentinfo|hidden|toolbar)(?=$|[\s_-])",
    re.I,
)
#: Of these, what an article may have itself.
_HEADS = {"header", "side", "text", "search", "review"}
_CONTENT = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|story|main|body|text|page)(?:$|[\s_-])", re.I)


class Node:
    __slots__ = ("tag", "kids", "parent", "label", "key", "size", "shape", "count", "path", "off", "text")

    def __init__(self, tag: str, parent: Node | None, label: str = ""):
        self.tag, self.parent, self.label, self.kids, self.key, self.size, self.shape, self.count, self.path, self.off, self.text = tag, parent, label, [], None, 0, None, 1, 0, False, 0


def parse(html: str | None) -> Node:
    """A tree of any markup: kids are Nodes and strings (character references decoded). Never fails."""
    root = here = Node("#root", None)
    html = html or ""
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            here.kids.append(entities.unescape(html[at:]))
            break
        if m.start() > at:
            here.kids.append(entities.unescape(html[at:m.start()]))
        at = m.end()
        if m[1]:
            here.kids.append(m[1])
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if m[2] or m[5]:
            if tag == "p" and here.tag != "p" and not _open(here, "p"):
                continue
            up = _open(here, tag, frozenset() if tag in BLOCK else BLOCK)
            if up is not None:
                here = up.parent
            continue
        attributes = m[4] or m[7] or ""
        if tag in CLOSES_P:
            p = _open(here, "p", BLOCK - {"p"})
            if p is not None:
                here = p.parent
        if tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
            same = {"dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}}.get(tag, {tag})
            old = next((o for t in same if (o := _open(here, t, {"ul", "ol", "dl", "table", "menu", "select"})) is not None), None)
            if old is not None:
                here = old.parent
        label = ""
        if attributes:
            got = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            label = " ".join(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", got.get(k) or "") for k in ("class", "id", "role", "aria-label") if k in got)
            if "hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style") or "", re.I):
                label += " hidden"
        node = Node(tag, here, label)
        here.kids.append(node)
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        here = node
    return root


def _open(here: Node, tag: str, stop: set[str] = frozenset()) -> Node | None:
    while here is not None and here.tag != tag:
        if here.tag in stop or here.parent is None:
            return None
        here = here.parent
    return here


def nodes(x: Node) -> list[Node]:
    return [k for k in x.kids if isinstance(k, Node)]


def settle(root: Node) -> Node:
    """Set each node's key (what must be equal to count as constant: its tag, text and kids), size (letters), shape (tags), count (nodes),
    path (tags from the root), off (is it set apart?) and text (letters that nothing below sets apart)."""
    todo, order = [root], []
    while todo:
        x = todo.pop()
        order.append(x)
        x.path = hash((x.parent.path if x.parent else 0, x.tag))
        x.off = apart(x)
        todo += nodes(x)
    for x in reversed(order):
        parts = [k if isinstance(k, str) else k.key for k in x.kids]
        x.key = hash((x.tag, tuple(_SPACES.sub(" ", p).strip() if isinstance(p, str) else p for p in parts)))
        x.size = sum(len(k) if isinstance(k, str) else k.size for k in x.kids)
        below = nodes(x)
        x.shape = hash((x.tag, tuple(k.shape for k in below)))
        x.count = 1 + sum(k.count for k in below)
        x.text = sum(len(k.strip()) for k in x.kids if isinstance(k, str)) + sum(k.text for k in below if not k.off)
        x.parent = None  # a tree without cycles is freed where its last use ends
    return root


#: Rows of an alignment table that are kept in between; the others are worked out again from these on the way back.
STEP = 64


def matching(a: Node, b: Node, pairs: list | None = None) -> int:
    """Simple tree matching: the most nodes of a and b that pair up in order, level by level; adds the pairs.

    How many pair up depends on shapes alone (tags and kids), so each pair of shapes is worked out once. Of the best
    ways to pair kids, one with most kids of equal content is taken. Kids that are equal at both ends pair first, so
    that only what differs between them goes through the table. Nothing recurses, and a table keeps one row in STEP.
    """
    if a.tag != b.tag:
        return 0
    known: dict[tuple[int, int], int] = {}
    got, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        got.append((x, y))
        if x.key == y.key or x.shape == y.shape:  # where all nodes can pair, all do
            todo += zip(nodes(x), nodes(y))
            continue
        kx, ky, i, j = _ends(nodes(x), nodes(y), "key")
        todo += zip(kx[:i], ky[:i])
        todo += zip(kx[len(kx) - j:], ky[len(ky) - j:])
        todo += _align(kx[i:len(kx) - j], ky[i:len(ky) - j], known)
    if pairs is not None:
        pairs += got
    return len(got)


def _ends(ka: list[Node], kb: list[Node], by: str) -> tuple[list[Node], list[Node], int, int]:
    """The kids and how many are equal at the start and at the end."""
    n, i, j = min(len(ka), len(kb)), 0, 0
    while i < n and getattr(ka[i], by) == getattr(kb[i], by):
        i += 1
    while j < n - i and getattr(ka[-1 - j], by) == getattr(kb[-1 - j], by):
        j += 1
    return ka, kb, i, j


def _count(a: Node, b: Node, known: dict[tuple[int, int], int]) -> None:
    """Fill known: most pairs of nodes, by shapes, for a and b and all below them that may meet."""
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if (x.shape, y.shape) in known:
            todo.pop()
            continue
        if x.tag != y.tag or x.shape == y.shape:
            known[x.shape, y.shape] = x.count if x.tag == y.tag else 0
            continue
        ka, kb, i, j = _ends(nodes(x), nodes(y), "shape")
        ka, kb, same = ka[i:len(ka) - j], kb[i:len(kb) - j], sum(k.count for k in ka[:i]) + sum(k.count for k in ka[len(ka) - j:])
        left, right = {k.shape: k for k in ka}, {k.shape: k for k in kb}
        open_ = [(p, q) for s, p in left.items() for t, q in right.items() if (s, t) not in known]
        if open_:
            todo += open_
            continue
        known[x.shape, y.shape] = 1 + same + (int(_rows(ka, kb, known)[1][-1][-1]) >> 31 if ka and kb else 0)


def _rows(ka: list[Node], kb: list[Node], known: dict[tuple[int, int], int]):
    """(row from the one before, kept rows) of the alignment table: pairs * 2^31 and, to decide ties, pairs of equal keys."""
    def short(row: list[int], x: Node) -> list[int]:
        new, best = [0], 0
        for c, y in enumerate(kb):
            g = known[x.shape, y.shape]
            here = row[c] + (g << 31) + (x.key == y.key) if g else 0
            best = max(best, here, row[c + 1])
            new.append(best)
        return new

    shapes = {s: c for c, s in enumerate(dict.fromkeys(k.shape for k in kb))} if len(kb) > 32 else {}
    at, keys = (np.array([shapes[k.shape] for k in kb]), np.array([k.key for k in kb], np.int64)) if shapes else (None, None)
    gains: dict[int, np.ndarray] = {}

    def long(row: np.ndarray, x: Node) -> np.ndarray:
        if x.shape not in gains:
            gains[x.shape] = np.array([known[x.shape, s] for s in shapes], np.int64) << 31
        g = gains[x.shape][at]
        new = row.copy()
        np.maximum(new[1:], row[:-1] + g + ((keys == x.key) & (g > 0)), out=new[1:])
        return np.maximum.accumulate(new)

    after, row = (short, [0] * (len(kb) + 1)) if len(kb) <= 32 else (long, np.zeros(len(kb) + 1, np.int64))
    kept = []
    for r, x in enumerate(ka):
        if r % STEP == 0:
            kept.append(row)
        row = after(row, x)
    return after, [*kept, row]


def _align(ka: list[Node], kb: list[Node], known: dict[tuple[int, int], int]) -> list[tuple[Node, Node]]:
    """Pairs of a best alignment of two lists of kids."""
    out: list[tuple[Node, Node]] = []
    if not ka or not kb:
        return out
    if len(ka) == len(kb) == 1:
        return [(ka[0], kb[0])] if ka[0].tag == kb[0].tag else out
    left, right = {k.shape: k for k in ka}, {k.shape: k for k in kb}
    for x in left.values():
        for y in right.values():
            _count(x, y, known)
    after, kept = _rows(ka, kb, known)
    c = len(kb)
    for start in reversed(range(0, len(ka), STEP)):
        part = ka[start:start + STEP]
        rows = [kept[start // STEP]]
        for x in part:
            rows.append(after(rows[-1], x))
        r = len(part)
        while r and c:
            if rows[r][c] == rows[r - 1][c]:
                r -= 1
            elif rows[r][c] == rows[r][c - 1]:
                c -= 1
            else:
                out.append((part[r - 1], kb[c - 1]))
                r, c = r - 1, c - 1
    return out


class Votes:
    """On how many distinct pages of a layout each content stands at each path."""

    def __init__(self):
        self.pages, self.count = 0, {}

    def add(self, root: Node) -> None:
        self.pages += 1
        seen, todo = set(), [root]
        while todo:
            x = todo.pop()
            seen.add((x.path, x.key))
            todo += nodes(x)
        for k in seen:
            self.count[k] = self.count.get(k, 0) + 1

    def most(self, x: Node) -> bool:
        return 2 * (self.count.get((x.path, x.key), 1) - 1) >= self.pages - 1


class Slots:
    """The wrapper of a layout: a tree of its first page, and how many letters pages have at each of its nodes."""

    def __init__(self, base: Node):
        self.base, self.sums = base, {}

    def pair(self, page: Node) -> list[tuple[Node, Node]]:
        pairs: list = []
        matching(page, self.base, pairs)
        return pairs

    def add(self, pairs: list[tuple[Node, Node]]) -> None:
        for x, y in pairs:
            n, t = self.sums.get(id(y), (0, 0))
            self.sums[id(y)] = n + 1, t + x.text

    def means(self, pairs: list[tuple[Node, Node]]) -> dict[int, float]:
        """For ids of a page's nodes the mean of the letters that pages have in their slot."""
        out = {}
        for x, y in pairs:
            n, t = self.sums[id(y)]
            out[id(x)] = t / n
        return out


def constant_nodes(page: Node, others: list[Node], votes: Votes | None = None, known: dict[int, list] | None = None) -> set[int]:
    """ids of the page's nodes that alignment pairs with a node of equal content and that most pages share: half of the
    other pages of the layout by its votes, without votes half of those that the page is aligned with. known: pairs with
    some of the others, by id."""
    paired: dict[int, int] = {}
    at: dict[int, Node] = {}
    for o in others:
        pairs = (known or {}).get(id(o))
        if pairs is None:
            pairs = []
            matching(page, o, pairs)
        for x, y in pairs:
            if x.key == y.key:
                paired[id(x)] = paired.get(id(x), 0) + 1
                at[id(x)] = x
    return {k for k, v in paired.items() if (votes.most(at[k]) if votes else 2 * v >= len(others))}


def apart(x: Node) -> bool:
    """Is the node, by its element or label, something other than an article's text?"""
    if x.tag in APART:
        return True
    if x.tag == "header":
        return not _inside(x)
    if not x.label or x.tag in ("html", "body", "main"):
        return False
    return any(m[1].lower() not in _HEADS or not _inside(x) for m in _LABEL.finditer(x.label))


def _inside(x: Node) -> bool:
    return bool(_open(x, "article") or _open(x, "main"))


#: How many letters elsewhere one letter of an article or main element outweighs.
SAID = 4


def region(root: Node, constant: set[int], means: dict[int, float] | None = None) -> list[Node]:
    """The nodes that hold the article: the way down from the body that goes where text varies.

    A node counts by the letters that the layout's pages have in its slot on average (means), without them by its own
    letters; constant nodes and what is set apart don't count, article and main elements count SAID times. The way
    goes on to the child with three quarters of it, and headings before that child come along; it ends at an article or main
    element. Where no child has as much, article elements below that have a quarter together are it, else the node. Where nothing varies (no other page, or only copies), all text counts.
    """
    body, todo = root, [root]
    while todo:
        x = todo.pop()
        if x.tag == "body":
            body = x
            break
        todo += reversed(nodes(x))
    letters = varying(body, constant)
    if not letters[id(body)]:
        constant = set()
        letters = varying(body, constant)

    def is_main(x: Node) -> bool:
        return x.tag == "main" or "main" in x.label.split()

    def amount(x: Node) -> float:
        n = letters[id(x)]
        return max(means[id(x)], 1) if n and means and id(x) in means else n

    told: dict[int, float] = {}  # what outermost article or main elements hold, for each node above them
    order = [body]
    for x in order:
        order += [k for k in nodes(x) if id(k) in letters]
    for x in reversed(order):
        told[id(x)] = amount(x) if x.tag == "article" or is_main(x) else sum(told[id(k)] for k in nodes(x) if id(k) in letters)

    inside, heads = body, []
    while inside.tag != "article":
        live = [(amount(k) + (SAID - 1) * told[id(k)], k) for k in nodes(inside) if id(k) in letters]
        total = sum(n for n, _ in live) + sum(len(k.strip()) for k in inside.kids if isinstance(k, str))
        at = max((i for i, p in enumerate(live) if p[1].tag in BLOCK), key=lambda i: live[i][0], default=None)
        goes = at is not None and total and live[at][0] >= 0.75 * total
        articles = _articles(inside, letters) if not goes or is_main(inside) else []
        if goes and (not is_main(inside) or len(articles) == 1 and _below(articles[0], live[at][1])):
            top = live[at][1]
            if (top.tag in ("p", "li", "td") or _HEADING.fullmatch(top.tag)) and not _CONTENT.search(top.label):
                break
            heads += [k for _, k in live[:at] if _rank(k)]
            inside = top
            continue
        if articles and SAID * sum(map(amount, articles)) >= 0.25 * total:
            return articles
        break
    return [inside] if inside.tag == "article" else [*heads, inside]


def _below(x: Node, top: Node) -> bool:
    todo = [top]
    while todo:
        y = todo.pop()
        if y is x:
            return True
        todo += nodes(y)
    return False


def _articles(x: Node, letters: dict[int, int]) -> list[Node]:
    """Outermost article elements with varying text below x, in page order."""
    out, todo = [], list(reversed(nodes(x)))
    while todo:
        y = todo.pop()
        if not letters.get(id(y)):
            continue
        if y.tag == "article":
            out.append(y)
        else:
            todo += reversed(nodes(y))
    return out


def varying(top: Node, constant: set[int]) -> dict[int, int]:
    """For ids of top and of all nodes below it that neither alignment nor a label takes out: letters of such text in them."""
    order = [top]
    for x in order:
        order += [k for k in nodes(x) if not k.off and id(k) not in constant]
    out: dict[int, int] = {}
    for x in reversed(order):
        out[id(x)] = sum(len(k.strip()) if isinstance(k, str) else out.get(id(k), 0) for k in x.kids)
    return out


#: Elements that hold running text; one that pages share may be a shared sentence.
_TEXT = {"p", "li", "dt", "dd", "td", "th", "tr", "blockquote", "pre", "figcaption"}
_HEADING = re.compile("h[1-6]")


def _rank(x: Node) -> int:
    """1 to 6 for a heading or what holds just one; else 0."""
    while not _HEADING.fullmatch(x.tag):
        if len(nodes(x)) != 1 or any(isinstance(k, str) and k.strip() for k in x.kids):
            return 0
        x = nodes(x)[0]
    return int(x.tag[1])


def template(tops: list[Node], constant: set[int]) -> set[int]:
    """ids of the constant nodes in tops that are template and not shared text of the article.

    A constant node stays if siblings that vary show it as one of theirs: one sibling like it (same tag and label) for
    an element of running text or with a label, two for others; so do a heading before what varies and inline nodes but
    those that stand between blocks. If more letters would go than stay, the other pages are near copies and none go.
    """
    gone: set[int] = set()
    left = total = sum(t.size for t in tops)
    vary = [t for t in tops if id(t) not in constant]
    if not vary:
        return gone
    for t in tops:
        if id(t) in constant:
            gone.add(id(t))
            left -= t.size
    todo = vary
    while todo:
        x = todo.pop()
        kids = [k for k in nodes(x) if not k.off]
        live = [k for k in kids if id(k) not in constant and k.size]
        between = any(k.tag in BLOCK for k in kids) and not any(isinstance(k, str) and k.strip() for k in x.kids)
        below = 0  # 7 where text that stays follows; less under a heading of that rank
        for k in reversed(kids):
            heading = _rank(k)
            if id(k) not in constant:
                todo.append(k)
                stays = True
            elif heading:
                stays = below > heading
            elif k.tag in BLOCK:
                like = sum(y.tag == k.tag and y.label == k.label for y in live)
                stays = like >= (1 if k.tag in _TEXT or k.label else 2)
            else:
                stays = not between
            if not stays:
                gone.add(id(k))
                left -= k.size
            elif heading:
                below = min(below or 7, heading)
            elif k.size:
                below = 7
    return gone if 2 * left >= total else set()


def blocks(top: Node, gone: set[int]) -> list[str]:
    """Text blocks under top in page order, without the nodes in gone."""
    out, here = [], []

    def flush():
        t = _SPACES.sub(" ", "".join(here)).strip()
        if t:
            out.append(t)
        here.clear()

    todo: list = [(top, False)]
    while todo:
        x, done = todo.pop()
        if isinstance(x, str):
            here.append(x)
            continue
        if done:
            flush()
            continue
        if x is not top and (x.off or id(x) in gone):
            if x.tag in BLOCK:
                flush()
            continue
        if x.tag == "br":
            here.append(" ")
            continue
        if x.tag in BLOCK:
            flush()
            todo.append((x, True))
        todo += [(k, False) for k in reversed(x.kids)]
    flush()
    return out


def main_text(page: Node, others: list[Node], votes: Votes | None = None, slots: Slots | None = None, pairs: list | None = None) -> str:
    """Text of an article page, given settled trees of other pages of its host, and its layout's votes and slots."""
    known, means = {}, None
    if slots:
        pairs = slots.pair(page) if pairs is None else pairs
        known, means = {id(slots.base): pairs}, slots.means(pairs)
    constant = constant_nodes(page, others, votes, known) if others else set()
    tops = region(page, constant, means)
    whole = tops[-1].tag in ("body", "html", "#root")
    gone = constant if whole else template(tops, constant)
    return "\n".join(b for t in tops if whole or id(t) not in gone for b in blocks(t, gone))


def content(root: Node) -> int:
    """Key of the page's body, the root's without one: pages equal in it are copies."""
    todo = [root]
    while todo:
        x = todo.pop()
        if x.tag == "body":
            return x.key
        todo += reversed(nodes(x))
    return root.key


def layout(root: Node) -> set[int]:
    """Paths of tags that the page's blocks lie under."""
    out, todo = set(), [root]
    while todo:
        x = todo.pop()
        out.add(x.path)
        todo += [k for k in nodes(x) if k.tag in BLOCK]
    return out


def texts(pages: list[str], peers: int, keep: int = 1 << 22) -> list[str]:
    """main_text of each of a group's pages, aligned with the first `peers` pages of its layout that are no copies of it;
    all distinct pages of the layout in the group vote on what is constant and tell how much text a slot has.

    Pages are of one layout if at least half of their paths are those of the layout's first page. A page that differs
    from no other of its layout takes the first of all pages. Trees of `keep` characters of html are kept, others are
    built again.
    """
    seen: dict[str, tuple[int, int]] = {}
    kept: dict[str, tuple[Node, list]] = {}
    firsts: list[set[int]] = []
    models: list[dict[int, str]] = []
    votes: list[Votes] = []
    slots: list[Slots] = []
    known: list[set[int]] = []
    every: dict[int, str] = {}
    for h in dict.fromkeys(pages):
        tree = settle(parse(h))
        key, own = content(tree), layout(tree)
        near = [len(own & f) / len(own | f) for f in firsts]
        at = max(range(len(near)), key=near.__getitem__, default=-1)
        if at < 0 or near[at] < 0.5:
            at = len(firsts)
            firsts.append(own)
            models.append({})
            votes.append(Votes())
            slots.append(Slots(tree))
            known.append(set())
        seen[h] = key, at
        pairs = slots[at].pair(tree)
        if key not in known[at]:
            known[at].add(key)
            votes[at].add(tree)
            slots[at].add(pairs)
        if keep >= len(h):
            kept[h] = tree, pairs
            keep -= len(h)
        for m in (models[at], every):
            if len(m) <= peers:
                m.setdefault(key, h)

    def built(h: str, at: int) -> tuple[Node, list | None]:
        return kept[h] if h in kept else (slots[at].base, None) if models[at] and h == next(iter(models[at].values())) else (settle(parse(h)), None)

    every_tree = {k: built(h, seen[h][1])[0] for k, h in every.items()}
    out: dict[str, str] = {}
    for at, m in enumerate(models):
        trees = {k: built(h, at)[0] for k, h in m.items()} if len(m) > 1 else every_tree
        for h, (key, own) in seen.items():
            if own == at:
                tree, pairs = built(h, at)
                out[h] = main_text(tree, [t for k, t in trees.items() if k != key][:peers], votes[at] if len(m) > 1 else None, slots[at] if len(m) > 1 else None, pairs)
    return [out[h] for h in pages]


def extract(pages: DataFrame, scratch: Scratch, peers: int = 3, group: int = 256, most_hosts: int = 200_000, rows: int = 1024) -> DataFrame:
    """pages(page_id, url, html) to page_id, url, text.

    Pages of a host are aligned with each other by simple tree matching: each with the first `peers` pages of its layout,
    and all distinct pages of its layout vote. Nodes that pair with an equal node and that most pages share are template, the
    others slots. Where text varies leads to the article (see region()): article and main elements and labels add to
    that evidence, they don't replace it. Template nodes in it go, but not shared text among varying text (see template()).
    Where the region is the whole page, all template nodes go.

    Pages move once, to groups of a host: one group up to `group` pages, else as many as the host needs, by a hash of
    page_id and url, in partitions of about `rows` pages; so neither a group nor a task grows with a host or the table.
    How many groups a large host needs is a small table, broadcast if it has at most `most_hosts` rows, else joined.

    Null html counts as empty and gives "". Null urls form one host. Repeated rows are extracted alike. An empty table
    gives an empty result. Other columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    hosts = scratch.save(pages.select(host.alias("_host")).groupBy("_host").agg(F.count("*").alias("n")))
    parts = max(1, -(-(hosts.agg(F.sum("n")).first()[0] or 0) // rows))
    large = hosts.where(F.col("n") > group).select("_host", F.ceil(F.col("n") / group).alias("groups"))
    large = F.broadcast(large) if large.count() <= most_hosts else large
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), F.xxhash64("page_id", "url").alias("k"))
    p = p.join(large, F.col("host") == F.col("_host"), "left").withColumn("salt", F.pmod(F.col("k"), F.coalesce("groups", F.lit(1))))

    def work(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["k", "html"])
        return pd.DataFrame({"page_id": own["page_id"], "url": own["url"], "text": texts(list(own["html"]), peers)})

    p = p.select("page_id", "url", "html", "host", "salt", "k").repartition(parts, "host", "salt")
    return p.groupBy("host", "salt").applyInPandas(work, "page_id long, url string, text string")
