"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into its leaf blocks: runs of text that no block-level tag interrupts. Each block has binary features from its ancestors
(tag names, words of class, id and role attributes) and from its text (length, link share, punctuation, typical words). A chain of the
two labels, boilerplate and content, is scored by weights for features and for label changes; the weights are learnt by maximum
likelihood on labelled pages, and Viterbi decoding gives each page its best labelling.

The labelled pages are composed by :func:`labelled_pages`: page layouts with articles, menus, headers, footers, sidebars, notices,
adverts, forms and comments in varied mark-up, whose labels are known by construction.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textops as X
from .storage import small_batches

#: Elements whose text is never rendered as text, or is a form control's. Without an end tag they hold nothing.
SILENT = {"script", "style", "noscript", "template", "head", "svg", "iframe", "textarea", "select", "canvas"}
#: Of these the content may go on to the end of the page.
ENDLESS = {"script", "style"}
#: What can stand in a head; any other start tag, and text, ends an open one.
HEADED = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: Of these the content isn't mark-up: everything up to the end tag is skipped.
RAW = {"script", "style", "textarea", "template", "noscript", "iframe", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Tags that don't end a block.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "nobr",
}
#: An open element of the first kind ends where one of the second begins.
CLOSED_BY = {
    "p": {
        "p", "div", "article", "section", "aside", "nav", "header", "footer", "main", "ul", "ol", "dl", "table", "form", "h1", "h2", "h3", "h4", "h5", "h6",
        "blockquote", "pre", "figure", "hr", "fieldset", "address", "details",
    },
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option", "optgroup"},
}
#: Elements that hold what an end tag of another may not close.
SCOPES = {"article", "main", "section", "aside", "nav", "header", "footer", "div", "table", "form", "body", "html", "td", "li"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HINTS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")

#: Words of class, id and role attributes by what they tell of a part.
ROLES = {
    "menu": {"nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "crumbs", "toc", "pagination", "pager", "tabs", "topbar", "toolbar", "skip", "links", "sitemap"},
    "head": {"header", "masthead", "banner", "branding", "logo", "site", "hero", "top", "tagline"},
    "foot": {"footer", "foot", "copyright", "colophon", "legal", "contentinfo", "bottom", "imprint", "credits"},
    "side": {"sidebar", "side", "aside", "rail", "widget", "widgets", "related", "recommended", "recommendations", "popular", "trending", "more", "teaser", "complementary", "promo", "latest"},
    "notice": {"cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "warning", "disclaimer", "announcement", "dialog", "toast", "paywall", "message"},
    "advert": {"ad", "ads", "advert", "advertisement", "adslot", "sponsor", "sponsored", "sponsors", "adsense", "dfp", "banners", "affiliate", "outbrain", "taboola"},
    "form": {"form", "search", "searchbox", "login", "signin", "signup", "subscribe", "subscription", "newsletter", "register", "contact", "input"},
    "comment": {"comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "commentlist", "reader", "readers", "feedback", "reviews"},
    "share": {"share", "sharing", "social", "follow", "buttons", "tags", "tag", "meta", "byline", "author", "bio", "print", "rating", "likes"},
    "main": {"article", "content", "post", "entry", "main", "story", "body", "text", "prose", "articlebody", "maincontent", "page"},
}
TAGS = ["article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "td", "p", "h1", "h2", "h3", "h4", "blockquote", "pre", "figcaption", "button", "div", "dl", "address", "details"]
NEAR = ["p", "h1", "h2", "h3", "li", "td", "div", "a", "blockquote", "pre", "figcaption", "button", "body", "article", "section", "span", "dd"]
SIGNS = re.compile(r"©|&copy;|all rights reserved|cookie|privacy|subscribe|sign in|log in|sign up|advert|sponsor|share (?:this|on)|read more|click here|terms of|newsletter", re.I)
FEATURES = [
    "bias", *(f"in:{t}" for t in TAGS), *(f"near:{t}" for t in NEAR), *(f"role:{r}" for r in ROLES), *(f"role-inside-main:{r}" for r in ROLES),
    "header-in-article", "footer-in-article", "linked", "half-linked", "long", "middle", "short", "tiny", "sentence", "stops", "sign", "first", "last",
]
AT = {f: i for i, f in enumerate(FEATURES)}


class Element:
    """An open element; ``known`` are the features (bits) that it and its ancestors give to a block, ``inside`` tells whether one is the main part."""

    __slots__ = ("tag", "roles", "parent", "known", "inside", "near")

    def __init__(self, tag: str, roles: tuple[str, ...], parent: Element | None):
        self.tag, self.roles, self.parent = tag, roles, parent
        inside = parent.inside if parent else False
        self.known = (parent.known if parent else 1 << AT["bias"]) | _given(tag, roles, inside)
        self.inside = inside or tag in ("article", "main") or "main" in roles
        self.near = tag if tag not in INLINE or tag == "a" else parent.near if parent else "body"

    def features(self) -> list[int]:
        return _listed(self.known, self.near)


@functools.lru_cache(1 << 14)
def _given(tag: str, roles: tuple[str, ...], inside: bool) -> int:
    """The features, as bits, that an element gives to the blocks in it."""
    names = [f"in:{tag}", *(f"role:{r}" for r in roles), *([f"role-inside-main:{r}" for r in roles] + [f"{tag}-in-article"] if inside else [])]
    return sum(1 << AT[n] for n in set(names) if n in AT)


@functools.lru_cache(1 << 14)
def _listed(known: int, near: str) -> list[int]:
    known |= 1 << AT[f"near:{near}"] if f"near:{near}" in AT else 0
    return [i for i in range(len(FEATURES)) if known >> i & 1]


def _roles(attributes: str) -> tuple[str, ...]:
    found = set()
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role", "aria-label", "itemprop"):
            words = set(HINTS.findall((m[2] or m[3] or m[4] or "").lower()))
            found.update(r for r, names in ROLES.items() if words & names)
    return tuple(sorted(found))


def leaf_blocks(page: str) -> list[tuple[str, int, Element | None]]:
    """(text, characters inside links, innermost element) of every block that has text, in page order."""
    stack: list[Element] = []
    out: list[tuple[str, int, Element | None]] = []
    ends: dict[str, int] = {}
    parts: list[str] = []
    linked = links = at = silent = 0
    known: dict[str, tuple[str, ...]] = {}

    def close() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append((text, linked, stack[-1] if stack else None))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if silent and stack[-1].tag == "head" and text.strip():
            pop(len(stack) - 1)
        if text and not silent:
            parts.append(text)
            if links:
                linked += len(text)

    def pop(n: int) -> None:
        nonlocal links, silent
        while len(stack) > n:
            tag = stack.pop().tag
            links -= tag == "a"
            silent -= tag in SILENT

    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            close()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # a stray end tag closes nothing outside its block
                if tag not in SCOPES and stack[i].tag in SCOPES:
                    break
            continue
        if silent and stack[-1].tag == "head" and tag not in HEADED:
            pop(len(stack) - 1)
        if tag in VOID:
            if tag in ("br", "hr"):
                add(" ")
            continue
        if tag in SILENT | RAW and tag not in ENDLESS and tag != "head":
            # an element that is never closed hides nothing
            if tag not in ends:
                ends[tag] = max((e.start() for e in re.finditer(rf"</{re.escape(tag)}(?=[\s/>])", page, re.I)), default=-1)
            if ends[tag] < at:
                continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        for i in range(len(stack) - 1, -1, -1):
            if tag in CLOSED_BY.get(stack[i].tag, ()):
                pop(i)
                break
            if stack[i].tag in SCOPES and stack[i].tag not in ("li", "td"):
                break
        if m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if m[3] not in known:
            known[m[3]] = _roles(m[3]) if "=" in m[3] else ()
        stack.append(Element(tag, known[m[3]], stack[-1] if stack else None))
        links += tag == "a"
        silent += tag in SILENT
    add(page[at:])
    close()
    return out


def featurise(blocks: list[tuple[str, int, Element | None]]) -> list[list[int]]:
    """The features that hold for each block."""
    rows = []
    seen: dict[int, list[int]] = {}
    outside = [AT["bias"], AT["near:body"]]
    for i, (text, linked, element) in enumerate(blocks):
        key = id(element)
        if key not in seen:
            seen[key] = element.features() if element else outside
        row, n = list(seen[key]), len(text)
        if linked > 0.8 * n:
            row.append(AT["linked"])
        elif linked > 0.3 * n:
            row.append(AT["half-linked"])
        row.append(AT["long" if n > 200 else "middle" if n > 60 else "short" if n > 20 else "tiny"])
        if text[-1] in ".!?:…。\"'”»":
            row.append(AT["sentence"])
        if text.count(". ") + text.count(", ") > 2:
            row.append(AT["stops"])
        if n < 400 and SIGNS.search(text):
            row.append(AT["sign"])
        if i == 0:
            row.append(AT["first"])
        if i == len(blocks) - 1:
            row.append(AT["last"])
        rows.append(row)
    return rows


class Chain:
    """Weights of a two-label chain: features (n, 2) and label changes (2, 2)."""

    def __init__(self, features: np.ndarray, changes: np.ndarray):
        self.features, self.changes = features, changes

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The best labelling, by Viterbi."""
        if not rows:
            return []
        gain = (self.features[:, 1] - self.features[:, 0]).tolist()
        (k00, k01), (k10, k11) = self.changes.tolist()
        back: list[tuple[int, int]] = []
        a, b = 0.0, sum(map(gain.__getitem__, rows[0]))
        for row in rows[1:]:
            g = sum(map(gain.__getitem__, row))
            from0, from1 = int(a + k00 < b + k10), int(a + k01 < b + k11)
            a, b = max(a + k00, b + k10), max(a + k01, b + k11) + g
            back.append((from0, from1))
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def learn(pages: list[tuple[list[list[int]], list[int]]], steps: int = 150, penalty: float = 0.02) -> Chain:
    """Maximum likelihood with an L2 penalty: forward and backward sums over all pages at once, Adam steps."""
    n, longest = len(pages), max(len(r) for r, _ in pages)
    x = np.zeros((n, longest, len(FEATURES)), np.float32)
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest))
    for i, (rows, labels) in enumerate(pages):
        for t, row in enumerate(rows):
            x[i, t, row] = 1
        y[i, : len(labels)] = labels
        mask[i, : len(labels)] = 1
    flat, truth = x.reshape(-1, len(FEATURES)), np.eye(2)[y] * mask[..., None]
    pairs = mask[:, 1:]
    seen = np.einsum("nta,ntb,nt->ab", truth[:, :-1], truth[:, 1:], pairs)
    w, k = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(k), np.zeros_like(k)]
    add = lambda a, axis: np.log(np.exp(a - (m := a.max(axis, keepdims=True))).sum(axis)) + m.squeeze(axis)
    for step in range(1, steps + 1):
        e = (flat @ w).reshape(n, longest, 2)
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for t in range(1, longest):
            on = mask[:, t, None]
            f[:, t] = np.where(on > 0, add(f[:, t - 1, :, None] + k, 1) + e[:, t], f[:, t - 1])
        for t in range(longest - 2, -1, -1):
            on = mask[:, t + 1, None]
            b[:, t] = np.where(on > 0, add(k + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        z = add(f[:, -1], 1)
        p = np.exp(f + b - z[:, None, None]) * mask[..., None]
        both = np.exp(f[:, :-1, :, None] + k + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        gw = (flat.T @ (p - truth).reshape(-1, 2)) / n + penalty * w
        gk = (both.sum((0, 1)) - seen) / n + penalty * k
        for j, (value, g) in enumerate(((w, gw), (k, gk))):
            m, v = moments[2 * j], moments[2 * j + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(w, k)


_PARTS = {
    "menu": [('<nav>{links}</nav>', 3), ('<div class="{c}">{links}</div>', 2), ('<ul id="{c}">{items}</ul>', 2), ('<div role="navigation">{links}</div>', 1)],
    "head": [('<header>{short}</header>', 3), ('<div class="{c}">{short}</div>', 2), ('<header id="{c}"><a href="/">{short}</a>{links}</header>', 2)],
    "foot": [('<footer>&copy; {short} &middot; {sentence}</footer>', 3), ('<div id="{c}"><p>{sentence}</p>{links}</div>', 2), ('<footer class="{c}">{links}<p>{sentence}</p></footer>', 2)],
    "side": [('<aside>{links}<p>{sentence}</p></aside>', 3), ('<div class="{c}"><h3>{short}</h3>{items}<p>{text}</p></div>', 2), ('<section class="{c}"><h2>{short}</h2><p>{sentence}</p></section>', 1), ("<aside><h3>{short}</h3><p>{text}</p></aside>", 1)],
    "notice": [('<div class="{c}"><p>{sentence}</p><button>{tiny}</button></div>', 3), ('<div id="{c}">{text}</div>', 2), ('<div role="dialog" class="{c}">{sentence}<a href="/">{tiny}</a></div>', 1)],
    "advert": [('<div class="{c}">{sentence}</div>', 4), ('<div class="{c}"><a href="/x">{sentence}</a></div>', 2), ('<section id="{c}"><p>{text}</p></section>', 1), ('<ins class="{c}"><p>{sentence}</p></ins>', 1)],
    "form": [('<form><label>{tiny}</label><input><button>{tiny}</button></form>', 3), ('<form class="{c}"><p>{sentence}</p><input><button>{tiny}</button></form>', 2), ('<div class="{c}"><h3>{short}</h3><p>{sentence}</p><form><input><label>{tiny}</label></form></div>', 1)],
    "comment": [('<section class="{c}"><h3>{short}</h3><div class="comment"><b>{tiny}</b><p>{text}</p></div><div class="comment"><p>{text}</p></div></section>', 3), ('<div id="{c}"><ol><li><p>{text}</p></li><li><p>{sentence}</p></li></ol></div>', 2), ('<ul class="{c}"><li>{text}</li><li>{sentence}</li></ul>', 1)],
    "share": [('<div class="{c}">{links}</div>', 2), ('<ul class="{c}">{items}</ul>', 1)],
}
_BODY = [
    ("<p>{text}</p>", 12), ("<p>{sentence}</p>", 5), ("<p>{tiny}</p>", 2), ("<h2>{short}</h2><p>{text}</p>", 3), ("<p><b>{sentence}<br><p>{text}</p>", 2), ("<ul><li>{sentence}</li><li>{short}</li></ul>", 2),
    ("<blockquote>{text}</blockquote>", 1), ("<p>{sentence} <a href='/a'>{short}</a> {text}</p>", 2), ("<table><tr><td>{tiny}</td><td>{short}</td></tr></table>", 1), ("<pre>{text}</pre>", 1),
    ("<h3>{short}</h3>", 1), ("<p><a href='/b'>{short}</a></p>", 1), ("<ol><li>{text}</li><li>{text}</li></ol>", 1), ("<div>{text}</div>", 1), ("<figure><img><figcaption>{sentence}</figcaption></figure>", 1),
]
_FRAMES = [
    ("<article><h1>{short}</h1>{body}</article>", 6), ("<main><h1>{short}</h1>{body}</main>", 2), ('<div class="{c}"><h1>{short}</h1>{body}</div>', 3), ('<main><article class="{c}"><header><h1>{short}</h1></header>{body}</article></main>', 2),
    ('<div id="{c}"><article><h1>{short}</h1>{body}</article></div>', 2), ("<h1>{short}</h1>{body}", 1), ('<section class="{c}"><h1>{short}</h1>{body}</section>', 1), ('<table><tr><td class="{c}"><h1>{short}</h1>{body}</td></tr></table>', 1),
]


#: Stands before every piece of main text while a page is composed.
MARK = "\ue000"


def labelled_pages(n: int, seed: int = 2) -> Iterator[tuple[str, list[int]]]:
    """Composed pages and the labels of their leaf blocks (1: main text)."""
    rng = random.Random(seed)
    syllables = "an be ca do el fi gu ho in jo ka lo mi no or pa qu re si ta un vo wi xe yo za är ñe ço ui да но ро".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: ", ".join(words(2, 9) for _ in range(rng.randint(1, 2))).capitalize() + rng.choice(["."] * 8 + ["", "!", "?"])

    def fill(template: str, role: str) -> str:
        mark = MARK if role == "main" else ""

        def one(m: re.Match) -> str:
            kind = m[1]
            if kind == "c":
                # names that tell nothing too: a part is then known by its tags, its text and its place
                name = rng.choice(sorted(ROLES[role])) if rng.random() < 0.85 else word()
                return rng.choice([name, f"{name}-{word()}", f"{word()} {name}", f"{word()}_{name}"])
            if kind in ("links", "items"):
                wrap = "<li>{}</li>" if kind == "items" or rng.random() < 0.6 else "{}"
                out = "".join(wrap.format(f'<a href="/{word()}">{words(1, 3)}</a>') for _ in range(rng.randint(1, 7)))
                return f"<ul>{out}</ul>" if wrap != "{}" and kind == "links" else out
            if kind == "text":
                return mark + " ".join(sentence() for _ in range(rng.randint(2, 9)))
            return mark + {"sentence": sentence, "short": lambda: words(2, 7).capitalize(), "tiny": lambda: words(1, 2)}[kind]()

        return re.sub(r"\{(\w+)\}", one, template)

    pick = lambda options: rng.choices([o for o, _ in options], [w for _, w in options])[0]
    part = lambda *roles: fill(pick(_PARTS[r := rng.choice(roles)]), r)
    for _ in range(n):
        body = ""
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12])):
            body += fill(pick(_BODY), "main")
            if rng.random() < 0.15:
                body += part("advert", "side", "form", "share", "notice")
        if rng.random() < 0.15:
            body += part("share", "comment", "side")
        before = "".join(part(r) for r in ("notice", "menu", "head", "menu", "advert", "form") if rng.random() < 0.45)
        after = "".join(part(r) for r in ("share", "comment", "side", "advert", "form", "menu", "foot") if rng.random() < 0.4)
        page = before + fill(pick(_FRAMES).replace("{body}", "\0"), "main").replace("\0", body) + after
        yield page.replace(MARK, ""), [int(MARK in text) for text, _, _ in leaf_blocks(page)]


@functools.lru_cache(4)
def trained(n: int = 500) -> Chain:
    """The chain learnt from ``n`` composed pages; the same on every call, and learnt once in a process."""
    return learn([(featurise(leaf_blocks(page)), labels) for page, labels in labelled_pages(n)])


def main_text(page: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(page or "")
    return " ".join(b[0] for b, keep in zip(blocks, chain.decode(featurise(blocks)), strict=True) if keep)


def extract(pages: DataFrame, chain: Chain, html: str = "html", column: str = "text") -> DataFrame:
    """Adds the main text to every row, from the whole page; null and empty pages, and pages without main text, have an empty one.

    An unclosed head ends where its content can't go on; of other unclosed elements that aren't shown the text is kept. Text of objects and of
    mathematics is text; that of form controls isn't. Rows are independent: repeats and ties need no rule. An empty table gives an empty one. An input column named like ``column`` is replaced.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(chain)  # a few hundred weights
    pages = pages.drop(column) if column != html else pages
    names = [*pages.columns, column]
    at = pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in X.blocks(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([main_text(p, shared.value) for p in part.column(at).to_pylist()], pa.string())], names=names)

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(column, T.StringType())]))
