"""Main text of web pages: boosted trees judge DOM nodes, a pass over the tree makes the judgements consistent.

A page is read into block nodes and runs of inline text (leaves). Features describe the subtree (text, links, nodes, their
densities), the tag, the tokens of class, id and role, the depth and the siblings. Gradient-boosted trees give each node the log odds of
holding main text. Decoding keeps the set of nodes with the greatest total log odds in which each kept node's parent is kept, so that nothing is
kept below a dropped ancestor. The kept leaves are joined in page order.

Training pages are a bounded sample of the table itself: nodes below `article`, `main` and the like count as main text, those
below menus, footers, adverts and the like do not; pages without such marks teach nothing. Each of them is also laid out anew, in other tags
and tokens and with notices, forms, side bars and comments, so that the trees also know layouts that the table lacks.

A null or empty page has an empty text. A column with the name of the result is replaced. Pages of any size, nesting and damage take time in proportion to their length: an open
quote, comment, template or tag is never searched for twice. A tag that no `>` ends takes the rest of the page, as in the HTML rules. Without
training pages the built-in layouts alone are learned.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entiform.llm.common import by_value, share, without

#: What follows a tag's name. A quote opens a value only behind "="; one that never closes is a character like others.
_REST = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+"
#: Every alternative matches wherever it begins, if need be to the end of the page, so that no text is read twice.
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(" + _REST + r")(?:>|\Z)", re.S)
_TEMPLATE = re.compile(r"<(/?)template(?=[\s/>])" + _REST + r"(?:>|\Z)", re.I | re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
#: Decimal character references: what stands behind eight digits cannot make them a character again.
_NUMBER = re.compile(r"&#(?=[0-9])0*+([0-9]{0,8})[0-9]*+")
_TOKENS = re.compile(r"[a-z]+")

#: Fixed sets of HTML.
RAW = frozenset("script style noscript iframe textarea title noembed noframes".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in (*RAW, "xmp")}
#: Inline elements that are nodes of their own once they hold text; without text they do not part the run around them.
EMBEDDED = frozenset("svg object canvas select foreignobject".split())
#: Elements of other name spaces, where "/>" closes, and the tags of HTML that end them.
FOREIGN = frozenset("svg math".split())
_ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small "
    "span strong strike sub sup table tt u ul var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th "
    "thead tr ul button".split())
_CLOSES_P = BLOCK - frozenset("html head body td th tr tbody thead tfoot caption option optgroup legend button".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
_FENCE = frozenset("table ul ol dl div section article body td th".split())

#: Tags with a feature of their own, and marks that teach (tags, roles, tokens).
TAGS = "html body article main section div p h1 h2 h3 ul ol li table tr td nav header footer aside form blockquote pre figure dl button #text".split()
MAIN_MARKS = frozenset("article main articlebody".split())
OTHER_MARKS = frozenset(
    "nav navigation menu footer aside form ad ads advert advertisement sidebar cookie cookies consent notice banner comments comment related share social "
    "promo newsletter breadcrumb breadcrumbs popup modal masthead complementary contentinfo search".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """Nodes in page order: tag, parent, attribute tokens; leaves hold text.

    Reading takes time in proportion to the page: the open elements are a stack, and for each name the places where it stands in the stack are
    known, so nothing looks through the stack.
    """

    def __init__(self, text: str | None):
        self.tag, self.parent, self.tokens, self.text, self.linked, self.hidden = [], [], [], [], [], []
        #: open elements: tag, node (-1: not made yet), attributes, innermost node made
        self._open: list[tuple[str, int, tuple, int]] = []
        self._places: dict[str, list[int]] = defaultdict(list)
        self._unmade: list[int] = []
        self._template_ends: dict[int, int] | None = None
        self._links = 0
        self._run: list[str] = []
        self._run_links = 0
        self._node("#root", -1, ())
        if text:
            self._read(text)

    def _node(self, tag: str, parent: int, tokens, text: str = "", linked: int = 0, hidden: bool = False) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.tokens.append(tokens)
        self.text.append(text)
        self.linked.append(linked)
        self.hidden.append(hidden)
        return len(self.tag) - 1

    def _here(self) -> int:
        return self._open[-1][3] if self._open else 0

    def _push(self, tag: str, node: int, given: tuple) -> None:
        if node < 0:
            self._unmade.append(len(self._open))
        self._places[tag].append(len(self._open))
        self._open.append((tag, node, given, self._here() if node < 0 else node))

    def _make(self) -> None:
        """Make the nodes of embedded elements that turn out to hold something."""
        if self._open and self._open[-1][1] < 0:
            self._flush()
            for k in self._unmade:
                tag, _, given, _ = self._open[k]
                node = self._node(tag, self._open[k - 1][1] if k else 0, given[0], hidden=given[1])
                self._open[k] = (tag, node, given, node)
            self._unmade.clear()

    def _innermost(self, names) -> int:
        return max((self._places[t][-1] for t in names if self._places.get(t)), default=-1)

    def _foreign(self) -> bool:
        return self._innermost(FOREIGN) > self._innermost(("foreignobject",))

    def _flush(self) -> None:
        if self._run:
            text = " ".join("".join(self._run).split())
            if text:
                self._node("#text", self._here(), (), text, min(self._run_links, len(text)))
            self._run, self._run_links = [], 0

    def _say(self, text: str) -> None:
        if text:
            if "&" in text:
                text = html.unescape(_NUMBER.sub(r"&#0\1", text))
            if not text.isspace():
                self._make()
            self._run.append(text)
            if self._links:
                self._run_links += len(text.strip())

    def _close(self, names, fence=frozenset()) -> None:
        """Close the innermost open node of these names, and all inside it, unless a fence stands between."""
        k = self._innermost(names)
        if k < 0 or k < self._innermost(fence):
            return
        if any(o[1] >= 0 and o[0] != "math" for o in self._open[k:]):
            self._flush()
        for tag, *_ in self._open[k:]:
            self._places[tag].pop()
        del self._open[k:]
        while self._unmade and self._unmade[-1] >= k:
            self._unmade.pop()

    def _read(self, text: str) -> None:
        at, n = 0, len(text)
        while at < n:
            m = _MARKUP.search(text, at)
            if m is None:
                self._say(text[at:])
                break
            self._say(text[at:m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    self._say(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    self._links = max(0, self._links - 1)
                elif tag in BLOCK or tag in EMBEDDED or tag in FOREIGN:
                    self._close({tag})
                continue
            foreign = self._foreign()
            if foreign and tag in _ENDS_FOREIGN:
                self._close(FOREIGN, frozenset(("foreignobject",)))
                foreign = False
            if (foreign or tag in FOREIGN) and m[3].endswith("/"):
                continue
            if tag == "template":  # inert up to its end; one without an end is passed over alone
                if self._template_ends is None:
                    self._template_ends = self._pair_templates(text, m.start())
                at = max(at, self._template_ends.get(m.start(), at))
            elif tag == "math":  # phrasing: its text belongs to the run around it
                self._push(tag, self._here(), ((), False))
            elif tag in EMBEDDED:
                self._push(tag, -1, self._attributes(m[3]))
            elif tag in RAW or tag == "xmp":
                end = _RAW_END[tag].search(text, at)
                if tag == "xmp":  # shown as it stands
                    self._block("pre", m[3])
                    self._say(text[at:end.start() if end else n].replace("&", "&amp;"))
                    self._close({"pre"})
                at = end.end() if end else n
            elif tag in VOID:
                if tag == "hr":
                    self._flush()
                elif tag == "br":
                    self._run.append(" ")
            elif tag == "a":
                self._links = 1
            elif tag in BLOCK:
                self._block(tag, m[3])
        self._flush()

    def _block(self, tag: str, raw: str) -> None:
        if tag in _CLOSES_P:
            self._close({"p"}, _FENCE | EMBEDDED)
        if tag in _SAME:
            self._close(_SAME[tag], frozenset(("table", "ul", "ol", "dl", "select", "menu")) - {tag})
        self._make()
        self._flush()
        if tag not in ("body", "html") or not self._places.get(tag):
            given = self._attributes(raw)
            self._push(tag, self._node(tag, self._here(), given[0], hidden=given[1]), given)

    @staticmethod
    def _pair_templates(text: str, at: int) -> dict[int, int]:
        """Where the template that starts at a place ends."""
        ends, opened = {}, []
        for m in _TEMPLATE.finditer(text, at):
            if not m[1]:
                opened.append(m.start())
            elif opened:
                ends[opened.pop()] = m.end()
        return ends

    @staticmethod
    def _attributes(raw: str):
        if not raw or raw.isspace():
            return (), False
        tokens, hidden = [], False
        for m in _ATTRIBUTE.finditer(raw):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden":
                hidden = True
            elif name in ("class", "id", "role", "itemprop", "itemtype", "aria-label"):
                spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
                tokens.extend(_TOKENS.findall(spaced.lower()))
                if name == "itemprop":
                    tokens.append(value.lower())
            elif name == "style" and HIDDEN.search(value):
                hidden = True
        return tuple(dict.fromkeys(tokens)), hidden


FEATURES = 22 + 2 * len(TAGS)
_TAG_INDEX = {t: k for k, t in enumerate(TAGS)}


def features(pages: list[Page], worth: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all nodes of the pages, their parents (-1 at a root), and the first row after each subtree."""
    tag = [t for p in pages for t in p.tag]
    sizes = np.array([len(p.tag) for p in pages])
    first = np.cumsum(sizes) - sizes
    page = np.repeat(np.arange(len(pages)), sizes)
    parent = np.array([x for p in pages for x in p.parent])
    n, root = len(tag), parent < 0
    parent = np.where(root, -1, parent + first[page])
    up = np.where(root, np.arange(n), parent)
    depth, end = np.zeros(n, int), np.arange(1, n + 1)
    for k in range(n):  # page order: parents come first
        if not root[k]:
            depth[k] = depth[parent[k]] + 1
    for k in range(n - 1, -1, -1):
        if not root[k] and end[k] > end[parent[k]]:
            end[parent[k]] = end[k]
    code = np.array([_TAG_INDEX.get(t, -1) for t in tag])
    own = np.array([len(x) for p in pages for x in p.text], float)
    link = np.array([x for p in pages for x in p.linked], float)
    stops = np.array([x.count(".") + x.count(",") + x.count("!") + x.count("?") if x else 0 for p in pages for x in p.text], float)
    leaf = own > 0

    def below(x):
        total = np.concatenate([[0.0], np.cumsum(x)])
        return total[end] - total[np.arange(n)]

    text, links, stop, leaves, blocks = below(own), below(link), below(stops), below(leaf), below(np.ones(n))
    long_leaves = below(own >= 80)
    paragraphs, items = below(code == _TAG_INDEX["p"]), below(code == _TAG_INDEX["li"])
    total = text[first][page]
    values = [[worth.get(t, 0.0) for t in ts] for p in pages for ts in p.tokens]
    best = np.array([max(v, default=0.0) for v in values])
    worst = np.array([min(v, default=0.0) for v in values])
    best_up, worst_up = best.copy(), worst.copy()
    for k in range(n):
        if not root[k]:
            best_up[k], worst_up[k] = max(best[k], best_up[parent[k]]), min(worst[k], worst_up[parent[k]])
    siblings = np.bincount(up[~root], minlength=n)[up]
    place = np.zeros(n)
    seen: dict[int, int] = {}
    for k in range(n):
        if not root[k]:
            place[k] = seen[parent[k]] = seen.get(parent[k], -1) + 1
    before = np.concatenate([[0.0], np.cumsum(own)])[:-1]
    before = (before - before[first][page]) / np.maximum(total, 1)
    columns = [
        np.log1p(text), text / np.maximum(total, 1), links / np.maximum(text, 1), np.log1p(blocks), text / blocks, stop / np.maximum(text, 1),
        np.log1p(leaves), text / np.maximum(leaves, 1), long_leaves / np.maximum(leaves, 1), paragraphs / blocks, items / blocks, depth, place / np.maximum(siblings, 1), siblings,
        best, worst, best_up, worst_up, before, text[up] / np.maximum(total, 1), links[up] / np.maximum(text[up], 1), np.array([x for p in pages for x in p.hidden], float)]
    hot = np.zeros((n, 2 * len(TAGS)))
    known = code >= 0
    hot[np.arange(n)[known], code[known]] = 1
    for k in range(n):  # tags among the ancestors
        if not root[k]:
            hot[k, len(TAGS):] = hot[parent[k], len(TAGS):]
            if code[parent[k]] >= 0:
                hot[k, len(TAGS) + code[parent[k]]] = 1
    return np.column_stack([*columns, hot]), parent, end


@dataclass
class BoostedTrees:
    """Log odds by gradient-boosted regression trees of fixed depth over binned features."""

    bias: float = 0.0
    depth: int = 4
    #: per tree: feature and threshold of each inner node, value of each leaf
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, bins: int = 20, ridge: float = 5.0) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)]).astype(np.int64)
        mean = y.mean()
        self.bias = float(np.log((mean + 1e-4) / (1 - mean + 1e-4)))
        z, m = np.full(len(y), self.bias), x.shape[1]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            where = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2 ** self.depth - 1, np.int64), np.full(2 ** self.depth - 1, np.inf)
            for level in range(self.depth):
                width, base = 2 ** level, 2 ** level - 1
                best_gain = np.full(width, 1e-3)
                best_bin = np.full(width, bins)
                best_feature = np.zeros(width, np.int64)
                for j in range(m):
                    if not len(edges[j]):
                        continue
                    cell = where * bins + binned[:, j]
                    g = np.bincount(cell, grad, width * bins).reshape(width, bins).cumsum(1)
                    h = np.bincount(cell, hess, width * bins).reshape(width, bins).cumsum(1)
                    gain = g ** 2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                    gain = gain[:, :len(edges[j])]
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best_gain
                    best_gain[better], best_bin[better], best_feature[better] = top[better], at[better], j
                for k in range(width):
                    feature[base + k] = best_feature[k]
                    cut[base + k] = edges[best_feature[k]][best_bin[k]] if best_bin[k] < bins else np.inf
                right = x[np.arange(len(y)), feature[base + where]] > cut[base + where]
                where = 2 * where + right
            g, h = np.bincount(where, grad, 2 ** self.depth), np.bincount(where, hess, 2 ** self.depth)
            value = -rate * g / (h + ridge)
            z += value[where]
            self.trees.append((feature, cut, value))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, value in self.trees:
            where = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2 ** level - 1 + where
                where = 2 * where + (x[rows, feature[at]] > cut[at])
            z += value[where]
        return z


def decode(parent: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Kept nodes: the set of the greatest total log odds in which each node's parent is kept too."""
    total = odds.copy()
    for k in range(len(total) - 1, -1, -1):
        if parent[k] >= 0 and total[k] > 0:
            total[parent[k]] += total[k]
    kept = total > 0
    for k in range(len(total)):
        if parent[k] >= 0 and not kept[parent[k]]:
            kept[k] = False
    return kept


def marked(page: Page) -> np.ndarray | None:
    """1 for leaves below a mark of main text and their ancestors, 0 for others; None if the page has no such mark."""
    n = len(page.tag)
    state, found = np.zeros(n, int), False
    for k in range(1, n):
        above = state[page.parent[k]]
        names = {page.tag[k], *page.tokens[k]}
        if names & OTHER_MARKS and page.tag[k] not in ("html", "body"):
            above = -1
        elif names & MAIN_MARKS and above >= 0:
            above, found = 1, True
        state[k] = above
    y = np.array([float(s > 0 and bool(t)) for s, t in zip(state, page.text)])
    for k in range(n - 1, 0, -1):
        y[page.parent[k]] = max(y[page.parent[k]], y[k])
    return y if found and y.any() else None


# --- layouts laid out anew ------------------------------------------------------------------------------------------------
_MAIN_NAMES = "content post entry article main story text body post-content entry-content article-body page-content".split()
_SIDE = {
    "menu": "nav menu navbar navigation top-menu main-nav".split(), "head": "header masthead site-header top logo".split(),
    "foot": "footer site-footer bottom copyright colophon".split(), "side": "sidebar aside widget related rail recommended".split(),
    "cookie": "cookie cookie-notice consent gdpr banner notice".split(), "advert": "ad ads advert sponsored promo banner".split(),
    "form": "newsletter subscribe search signup login contact-form".split(), "comments": "comments comment-list discussion responses replies".split()}
_SIDE_TAGS = {"menu": ("nav", "div", "ul"), "head": ("header", "div"), "foot": ("footer", "div"), "side": ("aside", "div", "section"), "cookie": ("div", "section", "aside"),
              "advert": ("div", "aside"), "form": ("form", "div"), "comments": ("section", "div", "ol")}


class Layouts:
    """Random pages with known main text."""

    def __init__(self, rng: random.Random, blocks: list[str]):
        self.rng, self.blocks = rng, blocks or ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Sed do."]

    def _phrase(self, low: int, high: int) -> str:
        words = self.rng.choice(self.blocks).split() or ["x"]
        k, at = self.rng.randint(low, high), self.rng.randrange(len(words))
        return html.escape(" ".join((words[at:] + words)[:k]))

    def _names(self, names) -> str:
        r = self.rng.random()
        if r < 0.3:
            return ""
        name = self.rng.choice(names) if r < 0.85 else "".join(self.rng.choice("abcdefghij") for _ in range(4))
        return f' {self.rng.choice(("class", "id", "class"))}="{name}"'

    def _links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/{k}">{self._phrase(1, 4)}</a></li>' for k in range(self.rng.randint(low, high)))

    def side(self, kind: str) -> str:
        rng, tag = self.rng, self.rng.choice(_SIDE_TAGS[kind])
        names = self._names(_SIDE[kind]) if tag not in ("div", "ul", "ol", "section") else f' class="{rng.choice(_SIDE[kind])}"'
        if kind == "menu":
            inner = self._links(3, 9) if tag == "ul" else f"<ul>{self._links(3, 9)}</ul>"
        elif kind == "head":
            inner = rng.choice(("", f"<h1>{self._phrase(1, 5)}</h1>")) + f"<p>{self._phrase(2, 10)}</p>" + rng.choice(("", f"<ul>{self._links(2, 6)}</ul>"))
        elif kind == "foot":
            inner = rng.choice((f"&copy; {self._phrase(2, 12)}", f"<p>&copy; {self._phrase(2, 15)}</p><ul>{self._links(2, 6)}</ul>"))
        elif kind == "side":
            inner = f"<h3>{self._phrase(1, 3)}</h3>" + rng.choice((f"<ul>{self._links(3, 8)}</ul>", f"<p>{self._phrase(5, 40)}</p>", f"<p>{self._phrase(3, 10)}</p><ul>{self._links(2, 5)}</ul>"))
        elif kind == "cookie":
            inner = rng.choice(("{}", "<p>{}</p>")).format(self._phrase(6, 35)) + rng.choice(("<button>OK</button>", '<a href="#">OK</a>', ""))
        elif kind == "advert":
            inner = rng.choice((self._phrase(3, 30), f"<p>{self._phrase(3, 30)}</p>", f'<a href="/x">{self._phrase(3, 15)}</a>'))
        elif kind == "form":
            inner = f"<label>{self._phrase(1, 6)}</label><input><p>{self._phrase(3, 15)}</p><button>{self._phrase(1, 2)}</button>"
        else:
            item = rng.choice(("div", "li", "article")) if tag != "ol" else "li"
            inner = f"<h3>{self._phrase(1, 3)}</h3>" * rng.randint(0, 1) + "".join(
                f'<{item} class="comment"><b>{self._phrase(1, 2)}</b><p>{self._phrase(4, 60)}</p></{item}>' for _ in range(rng.randint(1, 5)))
        return f"<{tag}{names}>{inner}</{tag}>"

    def main(self, texts: list[str]) -> str:
        rng, out = self.rng, []
        for k, t in enumerate(texts):
            t = html.escape(t)
            tag = "h1" if k == 0 and rng.random() < 0.7 else rng.choices(("p", "p", "p", "p", "div", "h2", "blockquote", "pre"), k=1)[0] if len(t) > 40 else rng.choice(("p", "p", "h2", "h3"))
            out.append(f"<header>{'<h1>' + t + '</h1>'}</header>" if k == 0 and rng.random() < 0.15 else f"<{tag}>{t}</{tag}>")
            if rng.random() < 0.06:
                out.append(f"<ul>{''.join(f'<li>{self._phrase(2, 14)}</li>' for _ in range(rng.randint(2, 4)))}</ul>")
            if rng.random() < 0.08:
                out.append("\0" + self.side(rng.choice(("advert", "form", "side", "cookie"))) + "\0")
        if rng.random() < 0.2:
            out.append("\0" + self.side(rng.choice(("comments", "comments", "menu", "foot"))) + "\0")
        return "".join(out)

    def page(self, texts: list[str]) -> str:
        """A page whose element marked `data-main` holds these blocks."""
        rng = self.rng
        body = self.main(texts)
        if rng.random() < 0.08:
            return f"<html><body data-main>{body}</body></html>"
        tag = rng.choice(("article", "main", "div", "div", "section"))
        names = self._names(_MAIN_NAMES) if tag in ("article", "main") else f' class="{rng.choice(_MAIN_NAMES)}"' if rng.random() < 0.75 else ""
        core = f"<{tag}{names} data-main>{body}</{tag}>"
        if rng.random() < 0.4:
            core = f"<{rng.choice(('div', 'main'))}{self._names(['wrapper', 'container', 'layout'])}>{core}{self.side('comments') if rng.random() < 0.4 else ''}</div>"
        before = [self.side(k) for k in ("head", "menu", "cookie", "advert", "side", "form") if rng.random() < 0.45]
        after = [self.side(k) for k in ("comments", "side", "form", "advert", "cookie", "foot") if rng.random() < 0.45]
        return "<html><body>" + "".join(before) + core + "".join(after) + "</body></html>"

    def labelled(self, texts: list[str]) -> tuple[Page, np.ndarray]:
        raw = self.page(texts)
        start, parts = raw.index("data-main"), raw.split("\0")  # what is foreign inside the main text stands between NULs
        page = Page("".join(parts))
        dropped = Counter(x for p in parts[1::2] for x in Page(p).text if x)
        cut = raw[start:]
        tag = re.search(r"<(\w+)[^<>]*\bdata-main", raw)[1]
        level, finish = 1, len(cut)
        for m in re.finditer(rf"<(/?){tag}\b", cut):
            level += -1 if m[1] else 1
            if not level:
                finish = m.start()
                break
        wanted = Counter(x for x in Page("<div " + cut[:finish].replace("\0", "") + "</div>").text if x)
        wanted.subtract(dropped)
        y = np.zeros(len(page.tag))
        for k, t in enumerate(page.text):
            if t and wanted[t] > 0:
                y[k] = 1
        for k in range(len(y) - 1, 0, -1):
            y[page.parent[k]] = max(y[page.parent[k]], y[k])
        return page, y


@dataclass
class ExtractionModel:
    worth: dict[str, float]
    trees: BoostedTrees

    def texts(self, pages: list[str | None]) -> list[str]:
        """Main texts; pages are judged in lots of bounded size."""
        out: list[str] = []
        lot: list[Page] = []
        size = 0
        for raw in pages:
            lot.append(Page(raw))
            size += len(lot[-1].tag)
            if size >= 20_000:
                out.extend(self._lot(lot))
                lot, size = [], 0
        return out + (self._lot(lot) if lot else [])

    def _lot(self, pages: list[Page]) -> list[str]:
        x, parent, _ = features(pages, self.worth)
        kept = decode(parent, self.trees.log_odds(x))
        out, at = [], 0
        for p in pages:
            out.append("\n".join(t for t, k in zip(p.text, kept[at:at + len(p.tag)]) if t and k))
            at += len(p.tag)
        return out


def train(pages: list[str], layouts_per_page: int = 4, least_layouts: int = 320, seed: int = 7) -> ExtractionModel:
    """Fit on marked pages and on their blocks laid out anew."""
    rng = random.Random(seed)
    samples: list[tuple[Page, np.ndarray]] = []
    texts: list[list[str]] = []
    for raw in pages:
        page = Page(raw)
        y = marked(page)
        if y is not None:
            samples.append((page, y))
            texts.append([t for t, v in zip(page.text, y) if t and v])
    texts = texts or [["Title of it", "A first long paragraph, with words of many kinds, and a stop. " * 3, "And a second one, which is shorter."]]
    layouts = Layouts(rng, [t for ts in texts for t in ts])
    for k in range(max(least_layouts, layouts_per_page * len(texts))):
        blocks = list(texts[k % len(texts)])
        if rng.random() < 0.5:
            blocks = blocks[:rng.randint(1, 6)]
        if rng.random() < 0.3:
            blocks = [b[:rng.randint(20, 400)] for b in blocks]
        samples.append(layouts.labelled(blocks))
    seen, main = Counter(), Counter()
    for page, y in samples:
        for tokens, v in zip(page.tokens, y):
            for t in set(tokens):
                seen[t] += 1
                main[t] += v
    worth = {t: float(np.log((main[t] + 1) / (n - main[t] + 1))) for t, n in seen.items() if n >= 5}
    x, _, _ = features([p for p, _ in samples], worth)
    return ExtractionModel(worth, BoostedTrees().fit(x, np.concatenate([y for _, y in samples])))


def fit(pages: DataFrame, fit_pages: int = 80, page: str = "html", key: str = "page_id") -> ExtractionModel:
    """Train on at most `fit_pages` pages that have marks, those with the smallest hash of their key.

    Each task hands on its first `fit_pages` of them; a page behind these is not read.
    """
    rows = pages.where(F.col(page).isNotNull()).select(F.xxhash64(F.col(key).cast("string")).alias("at"), F.col(key).cast("string").alias("key"), F.col(page).alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], str] = {}
        last = None
        for batch in batches:
            at, keys, texts = (batch.column(c) for c in ("at", "key", "page"))
            at, keys = at.to_pylist(), keys.to_pylist()
            for k in sorted(range(len(at)), key=at.__getitem__):
                if last is not None and at[k] > last:
                    break
                name, text = (at[k], keys[k]), texts[k].as_py()
                if text <= held.get(name, "") or marked(Page(text)) is None:
                    continue
                held[name] = text
                if len(held) > fit_pages:
                    del held[max(held, key=lambda x: (x[0], x[1] or ""))]
                if len(held) == fit_pages:
                    last = max(x[0] for x in held)
        names = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([n[0] for n in names], pa.int64()), pa.array([n[1] for n in names], pa.string()), pa.array(list(held.values()), pa.string())], ["at", "key", "page"])

    found = rows.mapInArrow(run, "at bigint, key string, page string").groupBy("at", "key").agg(F.max("page").alias("page")).orderBy("at", "key").limit(fit_pages).collect()
    return train([r["page"] for r in found])


def extract(df: DataFrame, model: ExtractionModel, page: str = "html", into: str = "text") -> DataFrame:
    """Add the main text of each whole page."""
    df = without(df, into)
    shared = share(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = shared().texts(batch.column(page).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.StringType())]))


by_value(__name__)
