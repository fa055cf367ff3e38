"""Main text of web pages by a minimum cut.

A forgiving scanner cuts a page into blocks of text (runs between block-level tags), each with its element and, by way of
parents, the elements above it. A logistic regression over a block's length, punctuation, links, element, place and
container, and over the names of elements and classes above it, gives its log odds for being content: the capacities to the
sink and from the source. Blocks next to each other and blocks of one parent are joined by edges; an edge's capacity is the
learned log odds for like labels at that distance in the element tree, times one factor. The minimum cut labels all
blocks at the least total cost: blocks whose own cost outweighs all their edges are settled first, which changes no cut,
and what is left goes through augmenting paths (Dinic).

Training: pages made by a fixed rule in many shapes, labelled by the rule, and a bounded sample (`FIT_PAGES`, of least hash,
each at most FIT_CHARS long) of the given pages that have one article or main element, labelled by it. Half of
the pages are shown without any names (tags as div, no class, id or role), so that the text and its place must tell. The
factor is the one under which pages that the regression hasn't seen are labelled best. Without a fit the made pages alone
train the model.

Each page is worked by itself in one map without a shuffle; memory is in proportion to the largest page, however deep.

Defined cases: a null or empty page gives the empty text; broken, unclosed and truncated markup is read as far as it
goes; a page without blocks that look like content gives the empty text; repeated rows are worked row by row; null ids
and urls pass through; other columns are ignored; of no pages the model is the one of the made pages.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Names of elements and words of class names, ids and roles.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template title textarea iframe svg object video audio canvas noframes noembed xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
AWAY = frozenset("nav aside footer form dialog menu select button fieldset label legend option head".split())
PARAGRAPHS = frozenset("p blockquote pre figcaption".split())
ITEMS = frozenset("li td th dd dt".split())
#: Elements that hold a line or paragraph rather than a part of the page.
LEAVES = PARAGRAPHS | frozenset("li dd dt h1 h2 h3 h4 h5 h6 tr address caption summary label legend option button a span b i font".split())
ROLES_AWAY = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS_AWAY = re.compile(
    r"(?<![a-z])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|topbar|footer|foot|sidebar|side|rail|aside|widgets?|ads?|adverts?|advertisement|"
    r"banner|promo|promotion|sponsor|sponsored|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"share|sharing|social|related|recommended|recommendations|outbrain|taboola|comments?|disqus|respond|reply|replies|discussion|pagination|pager|"
    r"toolbar|copyright|legal|disclaimer|tagcloud|byline|search|form|skip)(?![a-z])"
)
#: Names of an article's own head, which holds its headline.
OWN_HEAD = re.compile(r"(?<![a-z])(?:article|post|entry|story|content)[-_]+(?:header|masthead)(?![a-z])")
WORDS_MAIN = re.compile(r"(?<![a-z])(?:article|content|main|post|entry|story|body|text)(?![a-z])")
PHRASES_AWAY = re.compile(r"©|\(c\) \d{4}|all rights reserved|we use cookies|cookie policy|privacy policy|terms of (?:use|service)|subscribe to|sign up for|log in|follow us|share this", re.I)
#: Pages of the table that the fit may read, and how long one may be; pages made by rule; bounds of log odds; factors of the edges.
FIT_PAGES, FIT_CHARS, MADE, SEED, MOST, FACTORS = 400, 100_000, 400, 11, 12.0, (0.25, 0.5, 1.0, 1.5, 2.0)
#: What share of the text the part with most of it has, and how many levels below it a block still counts as within it.
MOSTLY, UNDER = 0.6, 8

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAMED = frozenset("nav aside footer header article main section menu dialog".split())
_OVER_P = ("article", "section", "div", "td", "th", "li", "body", "main", "table", "button")
_LISTS = ("ul", "ol", "dl", "table", "select", "menu")


class Block:
    __slots__ = ("at", "linked", "text")

    def __init__(self, text: str, linked: int, at: _Element):
        self.text, self.linked, self.at = text, linked, at


class _Element:
    __slots__ = ("away", "block", "blocks", "depth", "hint", "home", "leaf", "linked", "main", "out", "parent", "size", "tag", "within")

    def __init__(self, tag: str, attributes: str, parent: _Element | None, bare: bool = False):
        self.parent, self.depth = parent, parent.depth + 1 if parent else 0
        self.size = self.linked = self.blocks = 0
        self.leaf = True
        named = not bare or tag not in _NAMED
        self.tag = tag if named else "div"
        self.away, self.hint, self.main = self.tag in AWAY, False, self.tag in ("article", "main")
        self.out = self.within = False
        self.home = self  # the part of the page that it belongs to, as features() finds it
        self.block = self if parent is None or self.tag in BLOCK else parent.block
        if parent is not None and tag in BLOCK:
            parent.leaf = False
        if attributes and not attributes.isspace():
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if bare:
                    continue
                elif name == "role":
                    self.away |= value in ROLES_AWAY
                    self.main |= value in ("main", "article")
                elif name in ("class", "id"):
                    if WORDS_AWAY.search(OWN_HEAD.sub("post", value)):
                        self.hint = True
                    elif WORDS_MAIN.search(value):
                        self.main = True


class _Stack:
    """Open elements, with the places of each tag."""

    def __init__(self, root: _Element):
        self.line, self.places = [root], {}

    def push(self, e: _Element, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.line))
        self.line.append((e, tag))

    def top(self) -> _Element:
        last = self.line[-1]
        return last[0] if isinstance(last, tuple) else last

    def place(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags: tuple[str, ...], barrier: tuple[str, ...] = ()) -> None:
        """The last open one of the tags and all in it, unless a barrier stands in between."""
        at = self.place(tags)
        if at and at > self.place(barrier):
            while len(self.line) > at:
                self.places[self.line.pop()[1]].pop()


def scan(page: str, bare: bool = False) -> tuple[list[Block], list[_Element]]:
    """The blocks of text of a page, in order, white space collapsed and references decoded, and its elements, parents
    first; bare: as if elements had neither telling tags nor names."""
    found: list[Block] = []
    root = _Element("#page", "", None)
    elements, stack = [root], _Stack(root)
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = _html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if in_link:
                linked += len(raw)

    def flush() -> None:
        nonlocal linked
        if parts:
            plain = " ".join("".join(parts).split())
            e = stack.top()
            if plain:
                found.append(Block(plain, min(linked, len(plain)), e.block))
            parts.clear()
        linked = 0

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends, attributes = m[1] or m[4], m[3] if m[2] else m[6]
        if not ends and tag in RAW:
            if attributes.rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag in BLOCK:
            flush()
        if ends:
            if tag == "a":
                in_link = 0
            else:
                stack.close((tag,))
            continue
        if tag == "a":
            in_link = 1
            continue
        if tag in BLOCK:
            stack.close(("p",), _OVER_P)
            if tag == "body":
                stack.close(("head",))
            if tag in CLOSES:
                stack.close(CLOSES[tag], _LISTS)
        if tag in VOID:
            continue
        if tag in BLOCK or attributes and not attributes.isspace():
            e = _Element(tag, attributes, stack.top(), bare)
            elements.append(e)
            stack.push(e, tag)
    flush()
    return found, elements


def _heading(b: Block) -> bool:
    tag = b.at.tag
    return tag[:1] == "h" and tag[1:].isdigit()


def features(found: list[Block], elements: list[_Element]) -> np.ndarray:
    """Blocks x WIDTH: what the classifier sees."""
    for b in found:
        b.at.size += len(b.text)
        b.at.linked += b.linked
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.size += e.size
            e.parent.linked += e.linked
    total = max(1, elements[0].size)
    has_main = False
    for e in elements:  # parents first
        over = e.parent
        if over is not None:
            e.within, e.out = over.within, over.out
            # lines, paragraphs and parts without blocks of their own belong to what is above them
            if e.tag in LEAVES or e.leaf or e.tag not in BLOCK:
                e.home = over.home
        # what holds most of the page's text is no side part, whatever its name
        if e.away or e.hint and e.size <= 0.6 * total:
            e.out |= not (e.tag == "form" and e.size > 0.6 * total)
        elif e.tag == "header" and not e.within:
            e.out = True
        e.within |= e.main
        has_main |= e.main and e.size > 0
    homes = [b.at.home for b in found]
    for b, home in zip(found, homes, strict=True):
        home.blocks += 1
    # down from the page for as long as one part holds most of the text outside links
    best: dict[int, _Element] = {}
    for e in elements:
        if e.parent is not None and e.home is e:
            over = id(e.parent.home)
            if over not in best or e.size - e.linked > best[over].size - best[over].linked:
                best[over] = e
    heart = elements[0]
    while (e := best.get(id(heart))) is not None and e.size - e.linked >= MOSTLY * (heart.size - heart.linked):
        heart = e
    whole = lambda e: e.parent is None or e.tag in ("html", "body")
    rows, before = [], 0
    for b, home in zip(found, homes, strict=True):
        size, tag, e = len(b.text), b.at.tag, b.at
        link = b.linked / size
        over = home.parent or home
        inside, above = False, home
        for _ in range(UNDER):
            inside |= above is heart
            above = above.parent or above
        main = e.within and not e.out
        rows.append((
            1.0, min(math.log1p(size), 6.5) / 6.5, b.text[-1] in ".!?…\"”»:;", link, tag in PARAGRAPHS, _heading(b), tag in ITEMS,
            0.0 if whole(home) else home.size / total, 0.0 if whole(over) else over.size / total, home.linked / max(1, home.size), min(math.log1p(home.blocks), 4) / 4,
            size < 300 and bool(PHRASES_AWAY.search(b.text)), main, e.out, has_main and not e.within and not e.out, link * main, before / total, size < 25,
            min(1.0, 20 * sum(map(b.text[:400].count, ",.;:")) / min(size, 400)), home is heart, inside and home is not heart and not whole(heart), e.leaf and tag not in LEAVES,
            _heading(b) and home is heart, tag in ITEMS and inside, (home is heart or inside) and not main and not e.out and has_main,
        ))
        before += size
    return np.array(rows, np.float64).reshape(len(rows), WIDTH)


WIDTH = 25


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """(i, j, kind): neighbours on the page by distance (0 to 3) and whether the first is a heading over the second (4 more),
    and the last earlier block of the same parent (8)."""
    out, last = [], {}
    for j, b in enumerate(found):
        if j:
            steps, x, y = 0, found[j - 1].at, b.at
            while x is not y:
                if x.depth >= y.depth:
                    x = x.parent
                else:
                    y = y.parent
                steps += 1
            # a heading goes with what it stands over
            over = _heading(found[j - 1]) and not _heading(b)
            out.append((j - 1, j, min(3, max(0, steps - 2)) + 4 * over))
        parent = id(b.at.parent)
        if parent in last and last[parent] < j - 1:
            out.append((last[parent], j, 8))
        last[parent] = j
    return out


class Model:
    """Weights of the regression, and the capacity of each kind of edge."""

    def __init__(self, weights: np.ndarray, capacity: np.ndarray):
        self.weights, self.capacity = weights, capacity

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights, -MOST, MOST)

    def labels(self, x: np.ndarray, joined: list[tuple[int, int, int]]) -> list[bool]:
        return min_cut(self.odds(x).tolist(), [(i, j, float(self.capacity[k])) for i, j, k in joined])


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Newton steps of the penalised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


Seen = tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray]


def train(pages: list[Seen]) -> Model:
    """Of pages' features, edges and labels: every third page is held out from the regression to choose the edges' factor."""
    pages = [p for p in pages if len(p[0])]
    learn, held = [p for i, p in enumerate(pages) if i % 3], pages[::3]
    weights = _regression(np.concatenate([p[0] for p in learn]), np.concatenate([p[2] for p in learn]).astype(float))
    like, all_ = np.ones(9), np.full(9, 2.0)
    for _, joined, y in learn:
        for i, j, k in joined:
            like[k] += y[i] == y[j]
            all_[k] += 1
    plain = np.maximum(0.0, np.log(like / np.maximum(all_ - like, 1.0)))
    wrong = lambda f: sum(int((np.array(Model(weights, f * plain).labels(x, joined)) != y).sum()) for x, joined, y in held)
    best = min(FACTORS, key=wrong)
    return Model(_regression(np.concatenate([p[0] for p in pages]), np.concatenate([p[2] for p in pages]).astype(float)), best * plain)


def seen(page: str, bare: bool, label) -> Seen:
    found, elements = scan(page, bare)
    x = features(found, elements) if found else np.empty((0, WIDTH))
    return x, edges(found), np.array([bool(label(b)) for b in found])


_PARTS = "al an ar be co da de el en er es fi ga ho in is ka le li lo ma mi na ne no on or pa per po ra re ri ro sa se si so sta te ti to tra un va ve vi vo".split()


def made_pages(n: int = MADE, seed: int = SEED) -> list[tuple[str, set[str], bool]]:
    """(page, texts of its content blocks, shown without names) of pages made by rule."""
    return [_made(random.Random(seed * 100_003 + k), k) for k in range(n)]


def _made(r: random.Random, k: int) -> tuple[str, set[str], bool]:
    style = ("semantic", "named", "plain", "table")[k % 4]
    content: set[str] = set()

    def words(low: int, high: int) -> str:
        return " ".join("".join(r.choice(_PARTS) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def prose(low: int, high: int) -> str:
        return " ".join(words(4, 18).capitalize() + r.choice(("", ", " + words(2, 9))) + r.choice("...!?") for _ in range(r.randint(low, high)))

    def kept(x: str) -> str:
        content.add(x)
        return x

    def part(kind: str, names: tuple[str, ...], inner: str) -> str:
        if style == "semantic" and kind != "div":
            return f"<{kind}>{inner}</{kind}>"
        name = f' {r.choice(("class", "id"))}="{r.choice(names)}"' if style in ("semantic", "named") or style == "table" and r.random() < 0.3 else ""
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            inner = f"<div>{inner}</div>"
        return f"<div{name}>{inner}</div>"

    def links(low: int, high: int, bar: str = "") -> str:
        some = [f"<a href=/{i}>{words(1, 3)}</a>" for i in range(r.randint(low, high))]
        return bar.join(some) if bar else "<ul>" + "".join(f"<li>{x}</li>" for x in some) + "</ul>"

    def box() -> str:
        return r.choice((lambda: f"<p>{prose(1, 3)}</p>", lambda: prose(1, 3), lambda: f"<h3>{words(1, 4)}</h3>{links(3, 8)}", lambda: f"<h4>{words(1, 3)}</h4><p>{prose(1, 2)}</p>"))()

    paragraph = (lambda x: f"<p>{x}</p>") if r.random() < 0.8 else (lambda x: f"<div>{x}</div>")
    open_ = r.random() < 0.1  # paragraphs that are never closed
    body, n = [f"<h1>{kept(words(2, 9).capitalize() + r.choice(('', '', '.', '?')))}</h1>"], r.randint(1, 14)
    if style != "plain" and style != "table" and r.random() < 0.4:
        body.append(f"<p class={r.choice(('byline', 'share', 'social'))}>By {words(2, 2).title()}</p>")
    for _ in range(n):
        what = r.random()
        if what < 0.62:
            text = kept(prose(1, 7))
            body.append(f"<p>{text}" if open_ else paragraph(text))
        elif what < 0.72:
            body.append(paragraph(kept(words(1, 4).capitalize() + r.choice((".", "", "!")))))
        elif what < 0.82:
            body.append(f"<h{r.choice('234')}>{kept(words(1, 6).capitalize())}</h2>".replace("</h2>", "") + f"</h2>{paragraph(kept(prose(1, 4)))}")
        elif what < 0.9:
            items = [kept(words(1, 9).capitalize() + r.choice(("", "."))) for _ in range(r.randint(2, 6))]
            body.append("<ul>" + "".join(f"<li>{f'<a href=x>{x}</a>' if r.random() < 0.15 else x}</li>" for x in items) + "</ul>")
        elif what < 0.93:
            body.append(f"<{r.choice(('blockquote', 'pre'))}>{kept(prose(1, 3))}</blockquote>")
        elif what < 0.96:
            cells = [[kept(words(1, 4).capitalize()) for _ in range(3)] for _ in range(r.randint(2, 5))]
            body.append("<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in row) + "</tr>" for row in cells) + "</table>")
        elif style in ("semantic", "named"):
            body.append(part("aside", ("related", "promo", "ad-slot", "newsletter"), box()))
    if r.random() < 0.3 and len(body) > 3:  # sections within sections
        cut = r.randint(1, len(body) - 1)
        inner = f"<h3>{kept(words(1, 5).capitalize())}</h3>" + "".join(body[cut:])
        body = [*body[:cut], f"<section>{inner}</section>" if style == "semantic" else f"<div>{inner}</div>"]
    loose = r.random() < 0.12  # no element of its own
    heart = "".join(body) if loose else part(r.choice(("article", "article", "section")), ("article", "content", "post-body", "main-content", "story", "entry"), "".join(body))
    if style == "semantic" and r.random() < 0.4:
        heart = f"<main>{heart}</main>"
    head = [part("header", ("header", "masthead", "topbar"), r.choice((f"<a href=/>{words(1, 2)}</a>", f"<h2>{words(1, 3)}</h2><p>{words(3, 8)}</p>"))), part("nav", ("nav", "menu", "breadcrumb"), links(3, 9, r.choice(("", "", " | "))))]
    notice = f"We use cookies to {words(6, 14)}." if r.random() < 0.5 else prose(1, 2)
    if r.random() < 0.4:
        head.insert(r.randint(0, 2), part("div", ("cookie-notice", "consent", "banner", "alert"), r.choice((notice, f"<p>{notice}</p><button>{words(1, 2)}</button>"))))
    if r.random() < 0.6:
        head.append(part("div", ("ad", "ad-slot", "promo", "sponsor"), r.choice((prose(1, 3), f"<a href=x>{words(2, 6)}</a>"))))
    tail = [part("footer", ("footer", "foot", "copyright"), r.choice((f"&copy; {words(1, 3)} &middot; {prose(0, 4)}", f"<p>Copyright 20{r.randint(10, 30)} {words(1, 3)}. All rights reserved.</p>", links(2, 6, " | "), f"{words(1, 2)} | {words(1, 3)}", f"<p>{words(2, 6)}</p>{links(2, 5)}")))]
    if r.random() < 0.5:
        tail.insert(0, part("aside", ("sidebar", "widget", "related", "col-side"), "".join(box() for _ in range(r.randint(1, 3)))))
    if r.random() < 0.35 and style in ("semantic", "named"):
        tail.insert(0, f'<{"section" if style == "semantic" else "div"} class="{r.choice(("comments", "replies", "discussion"))}">' + "".join(f"<p>{prose(1, 3)}</p>" for _ in range(r.randint(1, 5))) + "</section></div>")
    if r.random() < 0.3:
        tail.insert(r.randint(0, len(tail)), f"<form><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button></form>")
    if r.random() < 0.08:  # nothing but the text
        head, tail = [], tail[-1:] if r.random() < 0.3 else []
        if r.random() < 0.3:
            content.clear()
            heart = f"<p>{kept(prose(1, 3))}</p>"
    if style == "table":
        if head and r.random() < 0.5:
            head = [links(1, 5, r.choice((" ", " | ", "<br>"))) if r.random() < 0.7 else prose(1, 1)]
        page = f"<table><tr><td>{''.join(head)}</td><td>{heart}</td></tr></table>{''.join(tail)}"
    else:
        page = "".join([*head, heart, *tail])
        if r.random() < 0.3:
            page = f"<div{r.choice(('', ' id=page', ' class=wrap')) if style == 'named' else ''}>{page}</div>"
    return f"<html><head><title>{words(2, 5)}</title></head><body>{page}</body></html>", content, r.random() < 0.3


@lru_cache(1)
def _made_seen() -> list[Seen]:
    return [seen(page, bare, lambda b, texts=texts: b.text in texts) for page, texts, bare in made_pages()]


@lru_cache(1)
def made_model() -> Model:
    """The model of the made pages alone."""
    return train(_made_seen())


def _labelled(page: str) -> list[Seen]:
    """A page with one article or main element, as it is and without names, labelled by that element."""
    found, elements = scan(page)
    mains = [e for e in elements if e.main and e.tag in ("article", "main")]
    if len(mains) != 1 or not found:
        return []
    features(found, elements)  # marks what lies in it, and apart from it
    y = np.array([b.at.within and not b.at.out for b in found])
    if not y.any() or y.all():
        return []
    texts = {b.text for b, keep in zip(found, y, strict=True) if keep}
    return [seen(page, bare, lambda b: b.text in texts) for bare in (False, True)]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = FIT_PAGES) -> Model:
    """Trains on the made pages and at most `most` of the given ones, of least hash."""
    bounded_batches(pages.sparkSession)
    total = pages.count()
    # about twice as many pages pass the bar, so that tasks send few to the driver however many they are; equal pages count once
    bar = F.lit((1 << 63) - 1 if total <= 2 * most else -(1 << 63) + (1 << 64) * 2 * most // total)
    rows = pages.where(F.col(html_col).isNotNull() & (F.length(html_col) <= FIT_CHARS)).select(F.xxhash64(id_col, html_col).alias("h"), F.col(html_col).alias("html"))
    some = rows.where(F.col("h") <= bar).dropDuplicates(["h"]).orderBy("h").limit(most).collect()  # `most` pages of at most FIT_CHARS
    return train(_made_seen() + [x for r in some for x in _labelled(r["html"])])


def min_cut(z: list[float], joined: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: -z or z for the wrong side of a node, the capacity of each edge that is cut."""
    n = len(z)
    z, label = list(z), [None] * n
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in joined:
        around[i][j] = around[i].get(j, 0.0) + c
        around[j][i] = around[j].get(i, 0.0) + c
    todo = list(range(n))
    while todo:  # a node that outweighs its edges is settled; its edges then speak for its neighbours
        i = todo.pop()
        if label[i] is None and abs(z[i]) >= sum(around[i].values()):
            label[i] = z[i] > 0
            for j, c in around[i].items():
                del around[j][i]
                if label[j] is None:
                    z[j] += c if label[i] else -c
                    todo.append(j)
            around[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source, sink = n, n + 1
        left: dict[int, dict[int, float]] = {i: dict(around[i]) for i in rest}
        left |= {source: {}, sink: {}}
        for i in rest:
            if z[i] > 0:
                left[source][i] = z[i]
                left[i][source] = 0.0
            else:
                left[i][sink] = -z[i]
                left[sink][i] = 0.0
        side = _dinic(left, source, sink)
        for i in rest:
            label[i] = i in side
    return label


def _dinic(left: dict[int, dict[int, float]], source: int, sink: int) -> set[int]:
    """Saturates the network; the nodes still reached from the source."""
    tiny = 1e-9
    while True:
        level, queue = {source: 0}, [source]
        for u in queue:
            for v, c in left[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return set(level)
        todo = {u: list(left[u]) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(left[a][b] for a, b in zip(path, path[1:], strict=False))
                cut = None
                for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    left[a][b] -= flow
                    left[b][a] = left[b].get(a, 0.0) + flow
                    cut = k if cut is None and left[a][b] <= tiny else cut
                del path[cut + 1 :]
                continue
            some = todo[u]
            while some and not (left[u][some[-1]] > tiny and level.get(some[-1], -1) == level[u] + 1):
                some.pop()
            if some:  # the edge may carry more later: it stays
                path.append(some[-1])
            else:
                path.pop()
                level[u] = -1


def main_text(page: str | None, model: Model | None = None) -> str:
    found, elements = scan(page) if page else ([], [])
    if not found:
        return ""
    kept = (model or made_model()).labels(features(found, elements), edges(found))
    return "\n\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or made_model())  # WIDTH weights

    def run(batches):
        for b in batches:
            texts = [main_text(x, shared.value) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
