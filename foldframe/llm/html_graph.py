"""Main text of web pages: a tree-structured graphical model over the DOM, solved by sum-product message passing."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldframe.llm.work import slices

#: Pages whose words fill the labelled training pages, and training pages made of each: the bound of what the model is fitted on.
TRAINING_PAGES, RENDERINGS = 200, 6
#: Words of a page, from its first on, that its training pages are made of. Bounds what is fitted on, never what is extracted.
TRAINING_WORDS = 4000

BLOCKS = frozenset("html body p h1 h2 h3 h4 h5 h6 li div section article main nav header footer aside ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre form fieldset figure figcaption address details summary center dialog iframe button select option textarea legend ins menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style noscript template head title svg iframe select option button textarea".split())
#: What may stand in a head; any other start tag ends a head whose end tag is missing.
HEAD_TAGS = frozenset("title meta link base style script noscript template".split())
#: An opening tag ends these open elements, up to the nearest of the second list.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TAGS = {t: i for i, group in enumerate(("p", "h1", "h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "div center section", "article main", "nav menu", "header", "footer address", "aside", "form fieldset legend dialog button select textarea", "table thead tbody tr td th caption", "blockquote pre figure figcaption", "html body")) for t in group.split()}
#: Words in class, id and role that sites use for the parts of a page.
PARTS = {w: i for i, group in enumerate((
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination topbar toolbar tabs skip",
    "header masthead branding logo banner hero",
    "footer foot colophon copyright legal contentinfo imprint",
    "sidebar side aside complementary widget widgets rail secondary",
    "cookie cookies notice consent alert gdpr popup modal overlay dialog disclaimer warning message toast paywall privacy",
    "ad ads advert adverts advertisement adsbygoogle advertising sponsor sponsored promo promotion promoted banner-ad dfp taboola outbrain",
    "form search login signin signup subscribe newsletter register contact input",
    "comment comments reply replies respond disqus discussion commentlist reader",
    "share sharing social related recommended more trending popular tags meta byline author toc",
    "article content post entry story main body text page-content entry-content post-content article-body richtext prose",
)) for w in group.split()}
N_TAGS, N_PARTS, N_TEXT = 15, 10, 17
WIDTH = N_TAGS + N_PARTS + N_TEXT + 1
KINDS = 6
WHITE = re.compile(r"\s+")


class Tree(HTMLParser):
    """Block elements of a page in document order, and its text cut into blocks.

    Inline elements don't cut a block; a line break is white space. Elements whose end tag is missing end where the next of their
    kind begins. Text of scripts, styles, controls and the head is no part of any block.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.parts, self.depth = ["html"], [-1], [0], [0]
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.silent = 0
        self.links = 0
        self.blocks: list[tuple[int, str, int]] = []  # (element, text, characters in links)
        self.run: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.run:
            text = WHITE.sub(" ", "".join(self.run)).strip()
            if text:
                self.blocks.append((self.node(), text, min(self.linked, len(text))))
            self.run, self.linked = [], 0

    def node(self) -> int:
        return next(i for _, i in reversed(self.stack) if i >= 0)

    def close_one(self) -> None:
        tag, i = self.stack[-1]
        if i >= 0:
            self.flush()
        self.stack.pop()
        self.silent -= tag in NO_TEXT
        self.links -= tag == "a"

    def close_through(self, k: int) -> None:
        while len(self.stack) > max(k, 1):
            self.close_one()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        if tag not in HEAD_TAGS and tag != "head" and self.silent and any(t == "head" for t, _ in self.stack):
            at = next(k for k, (t, _) in enumerate(self.stack) if t == "head")
            if all(t in ("head", "noscript") for t, _ in self.stack[at:]):
                self.close_through(at)
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.run.append(" ")
            return
        if tag == "body" and any(t == "head" for t, _ in self.stack):
            self.close_through(next(k for k, (t, _) in enumerate(self.stack) if t == "head"))
        block = tag in BLOCKS
        if block:
            self.flush()
            ends, stop = ENDS.get(tag, ((), ()))
            for k in range(len(self.stack) - 1, 0, -1):
                t = self.stack[k][0]
                if t in ends or (t == "p" and tag not in ("ins", "button", "iframe")):
                    self.close_through(k)
                elif t in stop or (t in BLOCKS and not ends and t != "p"):
                    break
        index = -1
        if block and tag not in NO_TEXT:
            names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v).lower()
            parts = 0
            for w in re.split(r"[\s_]+", names):
                for piece in {w, *w.split("-")}:
                    if piece in PARTS:
                        parts |= 1 << PARTS[piece]
            if any(k == "hidden" or (k == "style" and v and "display:none" in v.replace(" ", "").lower()) for k, v in attrs):
                parts |= 1 << 4
            index, up = len(self.tag), self.node()
            self.tag.append(tag), self.parent.append(up), self.parts.append(parts), self.depth.append(self.depth[up] + 1)
        self.stack.append((tag, index))
        self.silent += tag in NO_TEXT
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self.close_through(k)
                return
            if self.stack[k][0] in ("table", "article", "main", "body") and tag not in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.run.append(data)
            if self.links:
                self.linked += len(data)


def parse(html: str | None) -> Tree:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    tree.flush()
    return tree


def features(tree: Tree) -> np.ndarray:
    """One row for each element: tag, site words, and what its own and inner text looks like."""
    n = len(tree.tag)
    x = np.zeros((n, WIDTH))
    own, links, words, stops, commas, inner, pieces = (np.zeros(n) for _ in range(7))
    first = np.full(n, len(tree.blocks))
    for k, (i, text, linked) in enumerate(tree.blocks):
        own[i] += len(text)
        links[i] += linked
        words[i] += text.count(" ") + 1
        stops[i] += text.count(". ") + text.count("! ") + text.count("? ") + (text[-1] in ".!?:;\"”»")
        commas[i] += text.count(",")
        pieces[i] += 1
        first[i] = min(first[i], k)
    total, all_links, all_pieces = own.copy(), links.copy(), pieces.copy()
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        total[p] += total[i]
        all_links[p] += all_links[i]
        all_pieces[p] += all_pieces[i]
        inner[p] += total[i]
        first[p] = min(first[p], first[i])
    t = N_TAGS + N_PARTS
    for i in range(n):
        if (g := TAGS.get(tree.tag[i])) is not None:
            x[i, g] = 1
        bits = tree.parts[i]
        k = 0
        while bits:
            x[i, N_TAGS + k] = bits & 1
            bits >>= 1
            k += 1
    x[:, t] = np.log1p(own) / 5
    x[:, t + 1] = np.log1p(total) / 8
    x[:, t + 2] = links / np.maximum(own, 1)
    x[:, t + 3] = all_links / np.maximum(total, 1)
    x[:, t + 4] = np.log1p(words) / 4
    x[:, t + 5] = np.minimum(stops, 5) / 5
    x[:, t + 6] = commas / np.maximum(words, 1)
    x[:, t + 7] = own == 0
    x[:, t + 8] = total / max(total[0], 1)
    x[:, t + 9] = first / max(len(tree.blocks), 1)
    x[:, t + 10] = np.log1p(all_pieces) / 4
    x[:, t + 11] = inner > 0
    bad = x[:, N_TAGS : N_TAGS + N_PARTS - 1].any(1) | x[:, [TAGS[k] for k in ("nav", "header", "footer", "aside", "form")]].any(1)
    x[:, t + 12] = bad
    x[:, t + 13] = ~bad & (x[:, TAGS["article"]] > 0)
    x[:, t + 14] = ~bad & (x[:, N_TAGS + N_PARTS - 1] > 0)
    x[:, t + 15] = ~bad & (words >= 12) & (links < 0.3 * own)
    content = (x[:, TAGS["article"]] > 0) | (x[:, N_TAGS + N_PARTS - 1] > 0)
    heading = (x[:, TAGS["header"]] > 0) | (x[:, N_TAGS + 1] > 0)
    x[:, t + 16] = heading & content[np.maximum(tree.parent, 0)]
    x[:, -1] = 1
    return x


def labels(tree: Tree, main: set[str]) -> np.ndarray:
    """1 where most of an element's text is main text; elements without text follow their parent."""
    n = len(tree.tag)
    good, total = np.zeros(n), np.zeros(n)
    for i, text, _ in tree.blocks:
        total[i] += len(text)
        good[i] += len(text) * (text in main)
    for i in range(n - 1, 0, -1):
        good[tree.parent[i]] += good[i]
        total[tree.parent[i]] += total[i]
    y = (2 * good > total).astype(int)
    for i in range(1, n):
        if not total[i]:
            y[i] = y[tree.parent[i]]
    return y


def edge_kinds(tree: Tree) -> list[int]:
    """Which table of potentials joins each element to its parent: by the parent (page, plain container, named or semantic part)
    and by whether the child holds elements itself."""
    n, parent = len(tree.tag), tree.parent
    holds = [0] * n
    for p in parent[1:]:
        holds[p] = 1
    part = [0 if t in ("html", "body") else 1 if t in ("div", "section", "center") and not named else 2 for t, named in zip(tree.tag, tree.parts, strict=True)]
    return [0, *[2 * part[parent[i]] + holds[i] for i in range(1, n)]]


class Model:
    """Node weights (log odds of being content, from features) and 2 x 2 tables of parent-child potentials, one for each kind of
    edge."""

    def __init__(self, weights: np.ndarray, tables: np.ndarray):
        self.weights, self.tables = weights, tables

    def marginals(self, tree: Tree) -> list[float]:
        """Probability that each element is content: messages from the leaves up, then from the root down."""
        odds = (features(tree) @ self.weights).tolist()
        n, parent = len(odds), tree.parent
        kinds, tables = edge_kinds(tree), self.tables.tolist()
        up = odds[:]  # log odds with all that lies below
        sent = [0.0] * n
        for i in range(n - 1, 0, -1):
            (t00, t01), (t10, t11) = tables[kinds[i]]
            o = up[i]
            sent[i] = _log_sum(t10, t11 + o) - _log_sum(t00, t01 + o)
            up[parent[i]] += sent[i]
        full = up[:]
        for i in range(1, n):
            (t00, t01), (t10, t11) = tables[kinds[i]]
            o = full[parent[i]] - sent[i]  # the parent without this child's own message
            full[i] = up[i] + _log_sum(t01, t11 + o) - _log_sum(t00, t10 + o)
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, o)))) for o in full]

    def main_text(self, html: str | None) -> str:
        tree = parse(html)
        if not tree.blocks:
            return ""
        p = self.marginals(tree)
        return "\n".join(text for i, text, _ in tree.blocks if p[i] >= 0.5)


def _log_sum(x: float, y: float) -> float:
    m = x if x > y else y
    return m + math.log1p(math.exp(-abs(x - y)))


def fit(pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ridge: float = 0.3, steps: int = 250, rate: float = 0.1) -> Model:
    """Model from labelled elements (features, edges as (kind, parent), labels) of whole pages.

    Node weights and potentials are fitted together: the gradient of the pages' conditional likelihood is the labels' feature and
    edge counts less those the model expects, and the expectations come from the same two message sweeps, run over all pages at
    once, level by level.
    """
    x = np.concatenate([p[0] for p in pages])
    y = np.concatenate([p[2] for p in pages]).astype(int)
    sizes = [len(p[2]) for p in pages]
    base = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    edges = np.concatenate([p[1] for p in pages])
    root = edges[:, 1] < 0
    kind, parent = edges[:, 0], np.where(root, 0, edges[:, 1] + base)
    depth = np.zeros(len(y), int)
    for i in np.flatnonzero(~root):
        depth[i] = depth[parent[i]] + 1
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    child = np.flatnonzero(~root)
    w, t = np.zeros(x.shape[1]), np.zeros((KINDS, 2, 2))
    told = np.zeros_like(t)
    np.add.at(told, (kind[child], y[parent[child]], y[child]), 1)
    moments = [np.zeros(w.size + t.size) for _ in range(2)]
    for step in range(1, steps + 1):
        up = x @ w
        sent = np.zeros(len(y))
        tk = t[kind]
        for at in reversed(levels):
            sent[at] = np.logaddexp(tk[at, 1, 0], tk[at, 1, 1] + up[at]) - np.logaddexp(tk[at, 0, 0], tk[at, 0, 1] + up[at])
            up += np.bincount(parent[at], sent[at], len(y))
        full = up.copy()
        for at in levels:
            o = full[parent[at]] - sent[at]
            full[at] = up[at] + np.logaddexp(tk[at, 0, 1], tk[at, 1, 1] + o) - np.logaddexp(tk[at, 0, 0], tk[at, 1, 0] + o)
        above = (full[parent] - sent)[child]
        belief = tk[child] + above[:, None, None] * np.array([[0.0, 0], [1, 1]]) + up[child][:, None, None] * np.array([[0.0, 1], [0, 1]])
        belief = np.exp(belief - belief.max((1, 2), keepdims=True))
        belief /= belief.sum((1, 2), keepdims=True)
        due = np.stack([np.bincount(kind[child], belief[:, a, b], KINDS) for a in (0, 1) for b in (0, 1)], 1).reshape(t.shape)
        slope = np.concatenate((x.T @ (y - 1 / (1 + np.exp(-np.clip(full, -50, 50)))) - ridge * w, (told - due - ridge * t).ravel()))
        for m, power in zip(moments, (1, 2), strict=True):
            fade = 0.9 if power == 1 else 0.999
            m *= fade
            m += (1 - fade) * slope**power
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w, t = w + move[: w.size], t + move[w.size :].reshape(t.shape)
    return Model(w, t)


# ---------------------------------------------------------------- labelled pages


def labelled_page(words: list[str], dice: random.Random) -> tuple[str, list[str]]:
    """A page made of the given words, with the blocks of its main text: the labels are known because the page is built from them."""
    at = dice.randrange(len(words))

    def say(low: int, high: int, stop: str = "") -> str:
        nonlocal at
        n = dice.randint(low, high)
        out = [words[(at + k) % len(words)] for k in range(n)]
        at += n
        return " ".join(out).replace("&", "+").replace("<", "(") + stop

    pick = dice.choice
    main: list[str] = []

    def keep(text: str) -> str:
        main.append(WHITE.sub(" ", text).strip())
        return text

    def box(tags: str, names: str, inner: str, named: float = 0.85) -> str:
        tag = pick(tags.split())
        name = pick(names.split()) if names and (tag in ("div", "section", "ul", "td", "table") or dice.random() < named * 0.5) else ""
        return f'<{tag} {pick(["class", "id"])}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def link() -> str:
        return f'<a href="/x">{say(1, 3)}</a>'

    def items(n: int, inner=link) -> str:
        return "<ul>" + "".join(f"<li>{inner()}</li>" for _ in range(n)) + "</ul>"

    def loose(low: int = 4, high: int = 30) -> str:
        text = say(low, high, pick([".", "", "!"]))
        return pick([text, f"<p>{text}</p>", f"<h3>{say(1, 4)}</h3><p>{text}</p>", f"<p>{text}</p><p>{link()}</p>", f"<span>{text}</span>"])

    nav = lambda: box("nav nav div ul div", "menu navbar nav-main navigation site-menu breadcrumbs", pick([items(dice.randint(2, 8)), " | ".join(link() for _ in range(5)), "".join(f"<p>{link()}</p>" for _ in range(4))]))
    head = lambda: box("header header div", "header site-header masthead page-header banner", pick([f"<h1>{say(1, 4)}</h1>", f"<p>{say(2, 8)}</p>", f"<div>{say(1, 5)}</div>" + nav(), f"<h2>{say(1, 3)}</h2><p>{say(2, 9)}</p>"]))
    foot = lambda: box("footer footer div", "footer site-footer colophon copyright", pick([f"&copy; {say(2, 12)}.", f"<p>&copy; {say(3, 25)}.</p>", f"<p>{say(3, 20)}</p>" + items(3), f"{say(1, 4)} &middot; {say(3, 20)}."]))
    side = lambda: box("aside aside div section", "sidebar related widget side-column sidebar-right rail", "".join(pick([f"<h3>{say(1, 4)}</h3>{items(4)}", loose(8, 50), items(5)]) for _ in range(dice.randint(1, 3))))
    note = lambda: box("div div section dialog", "cookie-notice cookie-banner notice consent alert popup gdpr privacy-notice newsletter-popup", loose(6, 45) + pick(["", "<button>OK</button>", link()]))
    advert = lambda: box("div div div section ins", "ad ads advert advertisement ad-slot sponsored promo adsbygoogle banner-ad", loose(3, 45))
    form = lambda: pick([f"<form>{say(1, 6)}<input name=q><button>{say(1, 2)}</button></form>", f'<form class="{pick(["newsletter", "search", "login", "contact-form"])}"><p>{say(3, 30)}</p><label>{say(1, 3)}</label><input><select><option>{say(1, 2)}<option>{say(1, 2)}</select></form>', f'<div class="newsletter"><p>{say(4, 25)}</p><form><input></form></div>'])
    one_comment = lambda: box("div li article section", "comment comment-body reply", f"<p><b>{say(1, 2)}</b></p><p>{say(4, 70, '.')}</p>" if dice.random() < 0.5 else f"<p>{say(3, 60, '.')}</p>")
    comments = lambda: box("section div div ol", "comments comment-list reader-comments discussion disqus responses", pick(["", f"<h2>{say(1, 3)}</h2>", f"<h3>{say(1, 3)}</h3>"]) + "".join(one_comment() for _ in range(dice.randint(1, 5))), 1)
    share = lambda: box("div ul", "share social-share related tags post-meta", "".join(f"<li>{link()}</li>" for _ in range(3)))

    title = f"<h1>{keep(say(2, 12))}</h1>"
    if dice.random() < 0.25:
        title = pick(["<header>{}</header>", '<header class="entry-header">{}</header>', '<div class="post-header">{}</div>', '<div class="article-header">{}</div>', '<div class="page-title">{}</div>']).format(title)
    body = [title]
    for _ in range(dice.choice([1, 2, 3, 5, 9])):
        kind = dice.random()
        if kind < 0.72:
            body.append(f"<p>{keep(say(1, pick([4, 12, 30, 90]), '.'))}" + pick(["</p>", "</p>", "</p>", "", "<br>"]))
        elif kind < 0.8:
            body.append(f"<{(h := pick(['h2', 'h3']))}>{keep(say(1, 8))}</{h}>")
        elif kind < 0.86:
            body.append("<ul>" + "".join(f"<li>{keep(say(3, 25))}</li>" for _ in range(dice.randint(2, 5))) + "</ul>")
        elif kind < 0.9:
            body.append(f"<blockquote><p>{keep(say(8, 40, '.'))}</p></blockquote>")
        elif kind < 0.93:
            body.append("<table>" + "".join(f"<tr><td>{keep(say(1, 4))}</td><td>{keep(say(1, 4))}</td></tr>" for _ in range(3)) + "</table>")
        elif kind < 0.97:
            body.append(pick([advert, share, note, form])())
        else:
            body.append(f"<div>{keep(say(10, 60, '.'))}</div>")
    if dice.random() < 0.15:
        body.append(pick([share, comments, side])())
    bare = dice.random() < 0.12
    article = "".join(body) if bare else box("article article main div div section", "content post entry story article-body main post-content entry-content page", "".join(body), 0.6)
    if not bare and dice.random() < 0.4:
        article = box("main div div section", "main container wrapper page content layout", article + "".join(pick([side, advert, comments, share])() for _ in range(dice.randint(0, 2))))
    before = [f() for f in (nav, head, advert, note, form, side) if dice.random() < 0.5]
    after = [f() for f in (foot, side, advert, note, comments, form, nav) if dice.random() < 0.5]
    dice.shuffle(before)
    html = f"<html><head><title>{say(2, 8)}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}<!-- {say(1, 3)} -->{article}{''.join(after)}" + pick(["</body></html>", ""])
    return html, main


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = TRAINING_PAGES, renderings: int = RENDERINGS) -> Model:
    """Fit the model on labelled pages built from the words of at most ``sample`` pages (those with the smallest hash of id)."""
    some = pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html")).where(F.length("html") > 0).orderBy(F.xxhash64("id"), "id", F.xxhash64("html")).limit(sample)
    schema = "x array<double>, edges array<int>, y array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for key, html in zip(part.column("id").to_pylist(), part.column("html").to_pylist(), strict=True):
                words = " ".join(t for _, t, _ in parse(html).blocks).split() or ["text"]
                for k in range(renderings):
                    page, main = labelled_page(words[:TRAINING_WORDS], random.Random(f"{key}/{k}"))
                    tree = parse(page)
                    rows.append({"x": features(tree).ravel().tolist(), "edges": [v for e in zip(edge_kinds(tree), tree.parent, strict=True) for v in e], "y": labels(tree, set(main)).tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("x", pa.list_(pa.float64())), ("edges", pa.list_(pa.int32())), ("y", pa.list_(pa.int32()))]))

    got = [(np.array(r.x).reshape(-1, WIDTH), np.array(r.edges).reshape(-1, 2), np.array(r.y)) for r in some.mapInArrow(run, schema).toLocalIterator()]
    return fit(got) if got else Model(np.zeros(WIDTH), np.zeros((KINDS, 2, 2)))


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (main blocks in page order, one per line; empty if none). Null html counts as empty; ids and
    urls pass through unread, repeated rows each get their text. Nothing is shuffled."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    sent = pages.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField(url_col, rows.schema["url"].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part in slices(batches):
            text = pa.array([m.main_text(h) for h in part.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), text], [id_col, url_col, "text"])

    return rows.mapInArrow(run, schema)
