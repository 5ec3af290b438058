"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Each page is parsed into a small tree; every block element, and every inline element with a class, id or
role, gets features (density of its subtree, words of its class, id and role, tag, depth, how it compares
with its siblings, what stands above it) and a score from boosted trees. The decoder then chooses one
state for each node so that the sum of scores is best: a main-text node may hold excluded nodes but, below
an excluded node, nothing comes back; a container of both is neither. So ancestors and descendants never
contradict one another. Parsing and features take time in proportion to the page.

The trees are fitted here, on a bounded sample of the pages (at most `sample` of them, by smallest hash
of url and html, among those of at most `max_bytes`): nodes under article or main are main text, and the
same pages' paragraphs, whole or cut to a few words, are set again into many made-up layouts whose answer
is known.

Null html: empty. Pages without main text have an empty string. Text outside any element belongs to the
body. Text of script, style, noscript, template, iframe, object and svg is no text of the page. A tag that
never ends is text. Repeated rows are handled one by one. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_batches

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg head title".split())
RAW = frozenset("script style noscript template iframe textarea title xmp svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mo mn mrow msup msub mfrac msqrt mtext semantics annotation".split())
FORMS = frozenset("form input button select textarea option optgroup fieldset datalist".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CELLS = frozenset("td th".split())
SCOPE = frozenset("ul ol dl table body html div section article main td th form select".split())
TAG_GROUPS = ["article main", "p", "h1 h2 h3 h4 h5 h6", "div", "section", "nav menu", "header", "footer", "aside", "ul ol dl", "li dt dd", "table tbody thead tr td th", " ".join(sorted(FORMS)), "blockquote pre figure figcaption", "body html", " ".join(sorted(INLINE))]
GROUP = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"']++){0,500}+)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>""", re.S)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[A-Za-z]+")
SPACE = re.compile(r"[\s]+")


class Node:
    __slots__ = ("below", "depth", "link", "marks", "own", "parent", "stops", "tag", "tags", "text")

    def __init__(self, tag: str, parent: int, depth: int, marks: tuple[str, ...]):
        self.tag, self.parent, self.depth, self.marks = tag, parent, depth, marks
        self.own = self.text = self.link = self.tags = self.stops = 0
        self.below: list[int] = []


class Open:
    """The open elements, with the places of each tag, of blocks and of the elements that end a search."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks, self.scopes, self.outer = [], [], []

    def kinds(self, tag: str) -> list[list[int]]:
        return [self.places.setdefault(tag, []), *([self.blocks] if tag not in INLINE else []), *([self.scopes] if tag in SCOPE else []), *([self.outer] if tag in SCOPE and tag not in CELLS else [])]

    def push(self, tag: str, node: int) -> None:
        for kind in self.kinds(tag):
            kind.append(len(self.stack))
        self.stack.append((tag, node))

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        for kind in self.kinds(tag):
            kind.pop()
        return tag

    def last(self, tag: str) -> int:
        """Place of the innermost open element of this tag, -1 without one."""
        at = self.places.get(tag)
        return at[-1] if at else -1


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes (parents first; 0 is the page, 1 its body) and the page's text as (node, text), with ("" at node -1) where a block or line ends."""
    nodes, flow = [Node("#", -1, 0, ()), Node("body", 0, 1, ())], []
    nodes[0].below.append(1)
    held = Open()
    held.push("#", 0)
    held.push("body", 1)
    at, links, end, last = 0, 0, len(page), page.rfind(">")

    def text(a: int, b: int) -> None:
        raw = page[a:b]
        if "&" in raw:
            raw = entities.unescape(raw)
        node = held.stack[-1][1]
        flow.append((node, raw))
        if size := len(raw.strip()):
            n = nodes[node]
            n.own += size
            n.link += size if links else 0
            n.stops += raw.count(". ") + raw.count(", ") + raw.rstrip().endswith(".")

    def close(k: int) -> None:
        nonlocal links
        while len(held.stack) > max(k, 2):
            tag = held.pop()
            if tag == "a":
                links -= 1
            elif tag not in INLINE:
                flow.append((-1, ""))

    while at < end:
        if at > last:  # no tag ends any more
            rest = page.find("<!--", at)
            text(at, end if rest < 0 else rest)
            break
        m = TOKEN.search(page, at)
        if not m:
            text(at, end)
            break
        if m.start() > at:
            text(at, m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or tag in ("html", "body"):
            continue
        if m[1] or m[4]:
            k = held.last(tag)
            if k >= 0 and (tag not in INLINE or k > held.blocks[-1]):
                close(k)
            elif k < 0 and tag in ("p", "br"):
                flow.append((-1, ""))
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flow.append((-1, ""))
            continue
        if tag in CLOSES_P and held.last("p") == held.blocks[-1]:
            close(held.blocks[-1])
        for other in CLOSED_BY.get(tag, ()):
            ends = held.outer if other in ("td", "th", "tr") else held.scopes
            if held.last(other) > (ends[-1] if ends else -1):
                close(held.last(other))
        parent = held.stack[-1][1]
        marks = tuple(dict.fromkeys(w.lower() for x in MARKS.findall(m[3] or "") for y in x for w in WORDS.findall(y)))
        links += tag == "a"
        if tag not in INLINE:
            flow.append((-1, ""))
        if tag not in INLINE or marks:
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, marks))
            nodes[parent].below.append(len(nodes) - 1)
            parent = len(nodes) - 1
        held.push(tag, parent)
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if tag not in SILENT and tag not in FORMS:
                text(at, found.start() if found else end)
            close(len(held.stack) - 1)
            at = found.end() if found else end
    for n in reversed(nodes):
        n.text += n.own
        if n.parent >= 0:
            p = nodes[n.parent]
            p.text += n.text
            p.link += n.link
            p.tags += 1 + n.tags
            p.stops += n.stops
    return nodes, flow


FIXED = 16
#: Words of class, id and role that get a feature: the commonest of the training pages, at most so many.
MARK_FEATURES = 192
#: Nodes whose features are held at a time.
ROWS = 1 << 14


def features(nodes: list[Node], words: dict[str, int]) -> Iterator[np.ndarray]:
    """One row for each node, in runs of at most ROWS nodes."""
    g, w = len(TAG_GROUPS), len(words)
    siblings, place, alike = (np.ones(len(nodes)) for _ in range(3))
    for n in nodes:
        tags = Counter(nodes[i].tag for i in n.below)
        for k, i in enumerate(n.below):
            siblings[i], place[i], alike[i] = len(n.below), k, tags[nodes[i].tag]
    # groups of tags and words of the node itself, and of all its ancestors, as bits
    own, above = [], []
    for n in nodes:
        bits = sum(1 << g + words[x] for x in n.marks if x in words)
        if (k := GROUP.get(n.tag)) is not None:
            bits |= 1 << k
        own.append(bits)
        above.append(above[n.parent] | own[n.parent] if n.parent >= 0 else 0)
    width = (g + w + 7) // 8
    flags = lambda x: np.unpackbits(np.frombuffer(b"".join(b.to_bytes(width, "little") for b in x), np.uint8).reshape(len(x), width), axis=1, bitorder="little")[:, : g + w]
    sums = np.array([(n.text, n.own, n.link, n.tags, n.stops, n.depth, max(n.parent, 0)) for n in nodes], np.float64)
    text, mine, link, tags, stops, depth, parent = sums.T
    whole = max(text[0], 1)
    for a in range(0, len(nodes), ROWS):
        r = slice(a, a + ROWS)
        up = parent[r].astype(np.int64)
        t, some = text[r], np.maximum(text[r], 1)
        mean = np.maximum(text[up] - mine[up], 1) / siblings[r]
        fixed = np.stack(
            [np.log1p(t), link[r] / some, t / (1 + tags[r]), depth[r], mine[r] / some, np.log1p(mine[r]), siblings[r], place[r] / siblings[r],
             t / np.maximum(text[up], 1), t / whole, t / mean, np.log1p(tags[r]), stops[r] / some * 100, np.log1p(text[up]), link[up] / np.maximum(text[up], 1), alike[r]], axis=1
        )
        yield np.concatenate([fixed.astype(np.float32), flags(own[r]), flags(above[r])], axis=1, dtype=np.float32)


class Trees:
    """Boosted trees of one depth on binned features, as arrays; each tree is grown from a random share of rows and of features."""

    def __init__(self, depth: int = 4, count: int = 60, rate: float = 0.25, bins: int = 24, share: float = 0.5, seed: int = 9):
        self.depth, self.count, self.rate, self.bins, self.share, self.seed = depth, count, rate, bins, share, seed

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of the measures; flags are their own bins."""
        measures = [np.searchsorted(e, x[:, j], "left").astype(np.uint8) for j, e in enumerate(self.edges)]
        return np.concatenate([np.stack(measures, axis=1), x[:, len(self.edges) :].astype(np.uint8)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(FIXED)]
        b = self.binned(x)
        margin = np.zeros(len(y))
        inner = (1 << self.depth) - 1
        self.feature, self.cut, self.leaf = np.zeros((self.count, inner), np.int64), np.full((self.count, inner), 255, np.int64), np.zeros((self.count, inner + 1))
        used = np.flatnonzero(b.max(axis=0) > b.min(axis=0)) if len(b) else np.zeros(0, np.int64)
        rng, everything = np.random.default_rng(self.seed), (b, y, weight)
        for t in range(self.count):
            some = np.flatnonzero(rng.random(len(y)) < self.share)
            tried = used[rng.random(len(used)) < self.share].tolist()
            b, y, weight = (z[some] for z in everything)
            p = 1 / (1 + np.exp(-margin[some]))
            g, h = weight * (p - y), weight * p * (1 - p)
            at = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, n = (1 << level) - 1, 1 << level
                local = at - first
                gs, hs = np.bincount(local, g, n), np.bincount(local, h, n)
                best, choice = np.full(n, 1e-3), np.zeros((n, 2), np.int64)
                choice[:, 1] = 255
                for j in tried:
                    k = local * (self.bins + 1) + b[:, j]
                    gl = np.bincount(k, g, n * (self.bins + 1)).reshape(n, -1).cumsum(axis=1)
                    hl = np.bincount(k, h, n * (self.bins + 1)).reshape(n, -1).cumsum(axis=1)
                    gr, hr = gs[:, None] - gl, hs[:, None] - hl
                    gain = np.where((hl > 0.5) & (hr > 0.5), gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gs**2 / (hs + 1))[:, None], 0)
                    c = gain.argmax(axis=1)
                    top = gain[np.arange(n), c]
                    better = top > best
                    best[better] = top[better]
                    choice[better] = np.stack([np.full(n, j), c], axis=1)[better]
                self.feature[t, first : first + n], self.cut[t, first : first + n] = choice[:, 0], choice[:, 1]
                at = 2 * at + 1 + (b[np.arange(len(y)), choice[local, 0]] > choice[local, 1])
            local = at - inner
            self.leaf[t] = -self.rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + 1)
            b, y, weight = everything
            margin += self._one(t, b)
        return self

    def _one(self, t: int, b: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(self.depth):
            at = 2 * at + 1 + (b[rows, self.feature[t][at]] > self.cut[t][at])
        return self.leaf[t][at - len(self.feature[t])]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.zeros(len(x))
        for t in range(self.count):
            out += self._one(t, b)
        return out


MAIN, OUT, BOTH = 0, 1, 2
#: What it costs to begin main text below a container, and to leave a block or something inside a line out of main text.
BEGIN, EXCEPT, EXCEPT_INLINE = 0.5, 2.5, 0.5


def decode(nodes: list[Node], score: np.ndarray) -> list[int]:
    """The best state of every node: MAIN, OUT or BOTH (a container whose own text is left out)."""
    n = len(nodes)
    gain = np.zeros((n, 3))
    for i in range(n - 1, -1, -1):
        s = float(np.clip(score[i], -6, 6)) if nodes[i].text else 0.0
        form = nodes[i].tag in FORMS
        silent = nodes[i].tag in SILENT or form and nodes[i].tag not in ("form", "fieldset")  # these may hold a whole page
        main, out, both = (-1e6 if silent or form or i == 0 else s), (0.0 if i == 0 else -s), 0.0
        for k in nodes[i].below:
            main += max(gain[k, MAIN], gain[k, OUT] - (EXCEPT_INLINE if nodes[k].tag in INLINE else EXCEPT))
            out += gain[k, OUT]
            both += max(gain[k, MAIN] - BEGIN, gain[k, OUT], gain[k, BOTH])
        gain[i] = main, out, both if nodes[i].below and not silent else -1e6
    state = [OUT] * n
    state[0] = BOTH
    for i in range(1, n):
        above = state[nodes[i].parent]
        if above == OUT:
            continue
        options = (gain[i, MAIN], gain[i, OUT] - (EXCEPT_INLINE if nodes[i].tag in INLINE else EXCEPT), -np.inf) if above == MAIN else (gain[i, MAIN] - BEGIN, gain[i, OUT], gain[i, BOTH])
        state[i] = int(np.argmax(options))
    return state


def gathered(flow: list[tuple[int, str]], keep: set[int]) -> str:
    """The text of these nodes in page order; white space becomes one space, blocks are joined by one."""
    return SPACE.sub(" ", "".join(t if node in keep else " " for node, t in flow if node < 0 or node in keep)).strip()


def extract(page: str, trees: Trees, words: dict[str, int]) -> str:
    return extract_all([page], trees, words)[0]


def extract_all(pages: list[str], trees: Trees, words: dict[str, int]) -> list[str]:
    parsed = [parse(p) for p in pages]
    score, held, size = [], [], 0
    for nodes, _ in parsed:
        for x in features(nodes, words):
            held.append(x)
            size += len(x)
            if size >= ROWS:
                score.append(trees.margin(np.concatenate(held)))
                held, size = [], 0
    score = np.concatenate([*score, *([trees.margin(np.concatenate(held))] if held else [])]) if parsed else np.zeros(0)
    out, at = [], 0
    for nodes, flow in parsed:
        state = decode(nodes, score[at : at + len(nodes)])
        out.append(gathered(flow, {i for i, s in enumerate(state) if s == MAIN}))
        at += len(nodes)
    return out


def known_states(nodes: list[Node], inside: set[int], outside: set[int], around: set[int] = frozenset()) -> np.ndarray:
    """1 main text, 0 not, -1 a container of both: from nodes known to hold main text, nodes known not to (also below those), and containers."""
    y = np.zeros(len(nodes))
    for i, n in enumerate(nodes):
        above = y[n.parent] if n.parent >= 0 else 0
        y[i] = 0 if i in outside else 1 if i in inside or above == 1 else 0
        if i in around:
            y[i] = above  # what a container of the body's own main text holds is main text too
    for i in range(len(nodes) - 1, 0, -1):
        if y[i] != 0 and y[nodes[i].parent] == 0:
            y[nodes[i].parent] = -1
    return y


#: Words that layouts use in class and id.
INLINE_MARKS = "highlight term ref link external emphasis keyword note date author citation anchor bold".split()
GOOD_MARKS = "content article post entry story body main text page blog single prose markdown detail".split()
NEUTRAL_MARKS = "wrap container row col inner left center grid site layout box module block section".split()
BAD_MARKS = {
    "nav": "nav menu navbar breadcrumb links pagination topnav tabs".split(), "header": "header masthead banner top branding logo".split(), "footer": "footer bottom copyright colophon legal".split(),
    "aside": "sidebar aside widget related recommended trending popular rail promo newsletter share social".split(), "ad": "ad ads advert advertisement sponsored sponsor banner promo".split(),
    "notice": "notice cookie consent alert gdpr banner popup modal message disclaimer warning".split(), "comments": "comments comment respond replies reply discussion disqus reader".split(), "form": "form search subscribe signup login newsletter".split(),
}


def made_up(rng: random.Random, paragraphs: list[str]) -> str:
    """A page in a random layout; elements of main text carry the attribute data-main, those left out data-out."""
    pick = rng.choice
    words = [w for p in paragraphs for w in p.split()] or ["a"]
    some = lambda a, b: entities.escape(" ".join(pick(words) for _ in range(rng.randint(a, b))))
    mark = lambda names: f' {pick(("class", "class", "id"))}="{pick(names)}{pick(("", "", "-" + pick(NEUTRAL_MARKS), " " + pick(NEUTRAL_MARKS), str(rng.randint(1, 9))))}"'

    def left_out(kind: str) -> str:
        tag = {"nav": pick(("nav", "div", "ul")), "header": pick(("header", "div")), "footer": pick(("footer", "div")), "aside": pick(("aside", "div", "section")), "form": pick(("form", "div")), "comments": pick(("section", "div", "ul", "ol"))}.get(kind, pick(("div", "p", "section", "aside")))
        name = mark(BAD_MARKS[kind]) if rng.random() < 0.9 or tag in ("div", "p", "ul", "ol", "section") else ""
        li = lambda: f"<li><a href='/x'>{some(1, 4)}</a></li>"
        items = "".join(li() for _ in range(rng.randint(2, 9)))
        body = {
            "nav": items if tag == "ul" else f"<ul>{items}</ul>" if rng.random() < 0.8 else " ".join(f"<a href='/x'>{some(1, 3)}</a>" for _ in range(5)),
            "header": f"<a href='/'>{some(1, 3)}</a><p>{some(2, 9)}</p>" if rng.random() < 0.6 else f"<h2>{some(1, 4)}</h2><nav><ul>{items}</ul></nav>",
            "footer": pick((f"&copy; {some(2, 9)}", f"<p>{some(3, 15)}</p>", f"<ul>{items}</ul><p>&copy; {some(2, 8)}</p>")),
            "aside": f"<h3>{some(1, 4)}</h3>" + pick((f"<ul>{items}</ul>", f"<p>{some(5, 40)}</p>", f"<div>{some(4, 30)}</div>")),
            "ad": pick((some(3, 15), f"<p>{some(3, 25)}</p>", f"<p>{some(20, 80)}</p>", f"<a href='/buy'>{some(2, 10)}</a>")),
            "notice": pick((some(5, 30), f"<p>{some(5, 40)}</p><button>{some(1, 2)}</button>")),
            "comments": "".join((f"<li{mark(['comment', 'reply'])}><p>{some(3, 40)}</p></li>" if tag in ("ul", "ol") else f"<div{mark(['comment', 'reply', 'author'])}><b>{some(1, 2)}</b><p>{some(3, 40)}</p></div>") for _ in range(rng.randint(1, 6))),
            "form": f"<label>{some(1, 3)}</label><input name='q'><p>{some(2, 12)}</p><button>{some(1, 2)}</button>",
        }.get(kind, some(3, 15))
        return f"<{tag}{name} data-out>{body}</{tag}>"

    tag = pick(("article", "article", "article", "main", "main", "div", "div", "div", "section", "section", "", "", ""))
    main = [f"<h{pick((1, 1, 2))}>{some(1, 12)}</h1>"] if rng.random() < 0.7 else []
    for p in paragraphs:
        t = entities.escape(p)
        if rng.random() < 0.15:
            t += f" <span{mark(BAD_MARKS['ad'])} data-out>{some(1, 12)}</span> {some(0, 6)}"
        if rng.random() < 0.1:
            t += f" <{pick(('span', 'em', 'a'))}{mark(NEUTRAL_MARKS + INLINE_MARKS)}>{some(1, 6)}</span></em></a> {some(0, 6)}"
        main.append(pick((f"<p>{t}</p>",) * 7 + (f"<p>{t}<br>{some(3, 20)}</p>", f"<ul><li>{some(3, 14)}</li><li>{t}</li></ul>", f"<h3>{some(1, 6)}</h3><p>{t}</p>", f"<blockquote><p>{t}</p></blockquote>", f"<div>{t}</div>", f"<p>{some(3, 9)} <a href='/y'>{some(1, 3)}</a> {t}</p>", f"<table><tr><td>{some(1, 4)}</td><td>{t}</td></tr></table>", f"<p>{some(1, 3)}</p><p>{t}</p>")))
    for kind in ("ad", "aside", "form", "notice", "nav"):
        if rng.random() < (0.18 if tag else 0.08):
            main.insert(rng.randint(0, len(main)), left_out(kind))
    inner = "".join(main)
    if not tag and rng.random() < 0.25:
        return f"<body data-main>{some(1, 60)}<br>{inner if rng.random() < 0.5 else ''}</body>"
    if not tag and rng.random() < 0.3:
        inner = f"{some(2, 30)}<br>{inner}"
    if rng.random() < 0.25:
        inner = f"<div{mark(GOOD_MARKS + NEUTRAL_MARKS)}>{inner}</div>"
    if tag in ("article", "main") and rng.random() < 0.3:
        inner = f"<header><h1>{some(2, 9)}</h1></header>{inner}"
    if rng.random() < 0.2:
        inner += left_out("comments")
    named = mark(GOOD_MARKS) if tag not in ("article", "main") and rng.random() < 0.9 or rng.random() < 0.3 else ""
    body = f"<{tag}{named} data-main>{inner}</{tag}>" if tag else inner
    before = [left_out(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if rng.random() < 0.45]
    after = [left_out(k) for k in ("comments", "aside", "ad", "footer", "nav", "notice") if rng.random() < 0.45]
    for _ in range(rng.randint(0, 2) if tag else 0):
        if rng.random() < 0.5 and after:
            body = f"<div{mark(NEUTRAL_MARKS)}>{body}{after.pop(0)}</div>"
        else:
            body = f"<div{mark(NEUTRAL_MARKS)}>{body}</div>"
    page = f"{''.join(before)}{body}{''.join(after)}"
    if rng.random() < 0.12:
        page = f"<form method='post' action='/page' data-whole>{page}</form>"
    # without an element of its own, main text is what the body holds besides the rest
    return f"<html><head><title>{some(2, 8)}</title></head><body{'' if tag else ' data-main'}>{page}</body></html>"


#: Weight of layouts whose main text has no element of its own: there it has to be told by what it is, not by where it stands.
BARE = 3.0


def few_words(rng: random.Random, texts: list[str]) -> list[str]:
    return [" ".join(t.split()[: rng.randint(1, 12)]) for t in texts[: rng.randint(1, 4)]]


def fit(pages: list[str], layouts: int = 600, seed: int = 3) -> tuple[Trees, dict[str, int]]:
    """Trees and the words that have features, from whole pages."""
    rng = random.Random(seed)
    known = []
    stock: list[list[str]] = []

    def learn(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
        nodes, flow = parse(page)
        if inside := {i for i, n in enumerate(nodes) if n.tag in ("article", "main")}:
            outside = {i for i, n in enumerate(nodes) if n.tag in ("nav", "aside", "footer", "form", "script", "style")}
            known.append((nodes, known_states(nodes, inside, outside), 1.0))
        return nodes, flow

    for page in pages:
        nodes, flow = learn(page)
        own: dict[int, list[str]] = {}
        for i, t in flow:
            if i >= 0 and t.strip():
                own.setdefault(i, []).append(t)
        if texts := [SPACE.sub(" ", "".join(v)).strip() for i, v in own.items() if nodes[i].tag == "p"]:
            stock.append(texts)
    # the same pages with an article of a few words
    for page in pages:
        if m := re.search(r"(<(article|main)\b[^>]*>)(.*?)(</\2>)", page, re.S | re.I):
            texts = [p for p in re.findall(r"<p\b[^>]*>([^<]+)</p>", m[3])] or ["One two three four five."]
            learn(page[: m.end(1)] + "".join(f"<p>{t}</p>" for t in few_words(rng, texts)) + page[m.start(4) :])
    stock = stock or [["one two three four five six seven eight nine ten."] * 3]
    for _ in range(layouts):
        texts = rng.choice(stock)
        k = rng.randint(0, max(0, len(texts) - 1))
        some = texts[k : k + rng.randint(1, 12)]
        page = made_up(rng, few_words(rng, some) if rng.random() < 0.5 else some)  # main text may also be a few words
        nodes, _ = parse(page)
        starts = [m for m in TOKEN.finditer(page) if m[2] and not m[1] and m[2].lower() not in VOID and m[2].lower() not in ("html", "body") and (m[2].lower() not in INLINE or MARKS.search(m[3] or ""))]
        # nodes are numbered in the order of their start tags, after the page and its body
        flags = {i + 2: m[3] for i, m in enumerate(starts)} | ({1: "data-main"} if "<body data-main>" in page else {})
        outside = {i for i, a in flags.items() if "data-out" in a} | {i for i, n in enumerate(nodes) if n.tag in SILENT}
        known.append((nodes, known_states(nodes, {i for i, a in flags.items() if "data-main" in a}, outside, {i for i, a in flags.items() if "data-whole" in a}), BARE if 1 in flags else 1.0))
    seen: dict[str, int] = {}
    for nodes, _, _ in known:
        for w in {w for n in nodes for w in n.marks}:
            seen[w] = seen.get(w, 0) + 1
    words = {w: i for i, w in enumerate(sorted(seen, key=lambda w: (-seen[w], w))[:MARK_FEATURES])}
    x, y = np.concatenate([f for n, _, _ in known for f in features(n, words)]), np.concatenate([s for _, s, _ in known])
    weight = np.repeat([w for _, _, w in known], [len(n) for n, _, _ in known])
    use = (y >= 0) & (x[:, 0] > 0)
    return Trees().fit(x[use], y[use], weight[use]), words


def main_text(pages: DataFrame, sample: int = 100, max_bytes: int = 1 << 17) -> DataFrame:
    """page_id, url, text and n_chars, a row for each row of pages."""
    small_batches(pages.sparkSession)
    # hashes first, whole pages for the chosen ones only: at most `sample` hashes are broadcast
    hashed = pages.select("html", F.xxhash64("url", "html").alias("hash__")).where(F.octet_length("html") <= max_bytes)
    chosen = pages.sparkSession.createDataFrame(hashed.select("hash__").distinct().orderBy("hash__").limit(sample).collect(), "hash__ long")
    some = hashed.join(F.broadcast(chosen), "hash__").groupBy("hash__").agg(F.min("html").alias("html")).collect()
    trees, words = fit([r["html"] for r in sorted(some, key=lambda r: r["hash__"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for at in range(0, batch.num_rows, 100):
                texts += extract_all([x.as_py() or "" for x in batch.column(2).slice(at, 100)], trees, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    of = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return of.mapInArrow(run, "page_id long, url string, text string, n_chars long")
