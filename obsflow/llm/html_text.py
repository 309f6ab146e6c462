"""Main text of web pages from flat text blocks.

A page is cut into blocks at block-level tags.  A block is described by its words and link
density, those of the blocks before and after it, and what encloses it.  A small decision
tree, grown on ``BLOCKS``, decides which blocks are main text.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.llm.texts import map_rows

_BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
# Elements whose content is never text of the page.
_SILENT = frozenset("script style noscript template head title textarea select button iframe object svg math audio video canvas map".split())
_VOID = frozenset("area base basefont bgsound br col embed hr img input link meta param source track wbr".split())
# What can stand in a head; anything else ends it, as its end tag may be left out.
_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_AWAY = {"nav": "nav", "footer": "foot", "aside": "side", "form": "form", "dialog": "notice", "menu": "nav", "search": "form", "fieldset": "form"}
_ASIDE = frozenset("nav footer aside dialog".split())
# Words in class, id and role that say what an element is for.
_HINTS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toc skip toolbar tabs",
    "foot": "footer foot colophon copyright contentinfo",
    "side": "sidebar side aside widget widgets complementary rail related recommended recommendations trending popular share sharing social tags",
    "ad": "ad ads adv advert advertisement advertising banner promo promotion sponsor sponsored commercial teaser",
    "form": "form login signin signup register search searchbox subscribe subscription newsletter",
    "notice": "notice notices cookie cookies consent gdpr privacy popup modal overlay dialog alert paywall disclaimer legal warning message",
    "comment": "comment comments commentlist disqus discussion reply replies respond feedback reviews",
    "head": "header masthead topbar branding",
    "main": "article main content post entry story articlebody maincontent",
}
_KIND = {w: k for k, ws in _HINTS.items() for w in ws.split()}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea|noscript|template|iframe|svg|math)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)
 |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z][^<>]*>?""", re.X | re.S | re.I)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Small labelled table.  words, link density, words and link density before and after, inside main, enclosure, heading; 1: main text.
# Enclosure: 0 none, 1 navigation, 2 header of the page, 3 footer, 4 side, 5 advert, 6 form, 7 notice, 8 reader comment.
BLOCKS = [
    # articles with a marked main part: any length, first and last blocks, headings, linked words
    (9, 0.0, 8, 0.0, 12, 0.0, 1, 0, 1, 1), (12, 0.0, 9, 0.0, 60, 0.0, 1, 0, 0, 1), (60, 0.0, 12, 0.0, 80, 0.0, 1, 0, 0, 1), (80, 0.1, 60, 0.0, 3, 0.0, 1, 0, 0, 1),
    (3, 0.0, 80, 0.1, 45, 0.0, 1, 0, 0, 1), (45, 0.0, 3, 0.0, 6, 0.0, 1, 0, 0, 1), (1, 0.0, 7, 0.0, 1, 0.0, 1, 0, 0, 1), (2, 0.0, 1, 1.0, 400, 0.0, 1, 0, 1, 1),
    (150, 0.3, 20, 0.0, 90, 0.0, 1, 0, 0, 1), (5, 0.0, 6, 1.0, 4, 0.5, 1, 0, 0, 1), (14, 0.5, 40, 0.0, 30, 0.0, 1, 0, 0, 1), (4, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1, 1),
    (6, 0.0, 300, 0.0, 5, 0.0, 1, 0, 0, 1), (700, 0.02, 9, 0.0, 9, 0.2, 1, 0, 0, 1), (25, 0.9, 60, 0.0, 70, 0.0, 1, 0, 0, 1), (8, 1.0, 50, 0.0, 40, 0.0, 1, 0, 0, 1),
    # mostly a link, between text
    (6, 0.83, 40, 0.0, 30, 0.0, 1, 0, 0, 1), (4, 0.75, 25, 0.0, 0, 0.0, 1, 0, 0, 1), (6, 0.83, 12, 0.0, 14, 0.0, 1, 0, 0, 1), (3, 1.0, 40, 0.0, 30, 0.0, 1, 0, 0, 1), (5, 0.8, 9, 0.0, 60, 0.0, 1, 0, 0, 1),
    # the same between link lists
    (9, 0.0, 4, 1.0, 30, 0.0, 1, 0, 1, 1), (6, 0.0, 5, 1.0, 12, 0.0, 1, 0, 1, 1), (20, 0.0, 1, 1.0, 4, 1.0, 1, 0, 0, 1), (3, 0.0, 2, 1.0, 25, 0.0, 1, 0, 1, 1), (50, 0.1, 3, 1.0, 2, 1.0, 1, 0, 0, 1),
    (8, 0.0, 6, 1.0, 1, 0.0, 1, 0, 0, 1), (110, 0.0, 8, 1.0, 5, 1.0, 1, 0, 0, 1), (2, 0.0, 30, 0.0, 3, 1.0, 1, 0, 0, 1), (16, 0.2, 45, 0.0, 6, 1.0, 1, 0, 0, 1), (33, 0.0, 12, 1.0, 20, 1.0, 1, 0, 0, 1),
    # link lists inside the main part
    (2, 1.0, 3, 1.0, 2, 1.0, 1, 0, 0, 0), (4, 1.0, 2, 1.0, 3, 1.0, 1, 0, 0, 0), (3, 1.0, 5, 1.0, 4, 1.0, 1, 0, 0, 0), (6, 1.0, 4, 1.0, 7, 1.0, 1, 0, 0, 0),
    # enclosures that are not main text, inside the main part and outside
    (40, 0.0, 60, 0.0, 50, 0.0, 1, 8, 0, 0), (12, 0.1, 40, 0.0, 30, 0.0, 1, 8, 0, 0), (90, 0.0, 12, 0.1, 3, 1.0, 0, 8, 0, 0), (7, 0.0, 60, 0.0, 50, 0.0, 1, 5, 0, 0),
    (30, 0.2, 60, 0.0, 50, 0.0, 1, 5, 0, 0), (8, 0.0, 1, 1.0, 9, 0.0, 0, 5, 0, 0), (25, 0.0, 2, 1.0, 9, 0.0, 0, 5, 0, 0), (10, 0.0, 60, 0.0, 50, 0.0, 1, 6, 0, 0),
    (4, 0.0, 3, 0.0, 2, 0.0, 0, 6, 0, 0), (35, 0.1, 3, 0.0, 2, 1.0, 0, 7, 0, 0), (20, 0.0, 60, 0.0, 50, 0.0, 1, 7, 0, 0), (60, 0.0, 2, 1.0, 2, 1.0, 0, 7, 0, 0),
    (15, 0.3, 60, 0.0, 50, 0.0, 1, 4, 0, 0), (70, 0.0, 4, 0.0, 8, 1.0, 0, 4, 0, 0), (5, 0.0, 70, 0.0, 30, 0.5, 0, 4, 1, 0), (9, 0.0, 60, 0.0, 0, 0.0, 0, 3, 0, 0),
    (30, 0.2, 9, 0.0, 0, 0.0, 0, 3, 0, 0), (10, 0.0, 80, 0.0, 4, 0.0, 1, 3, 0, 0), (6, 0.0, 0, 0.0, 2, 1.0, 0, 2, 1, 0), (12, 0.0, 6, 0.0, 1, 1.0, 0, 2, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0), (2, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0), (1, 1.0, 2, 1.0, 8, 0.0, 0, 1, 0, 0), (3, 0.0, 2, 1.0, 4, 1.0, 0, 1, 0, 0), (4, 1.0, 60, 0.0, 50, 0.0, 1, 1, 0, 0),
    # pages without a marked main part
    (2, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0), (3, 0.0, 45, 0.0, 2, 0.0, 0, 0, 0, 0), (5, 0.0, 7, 0.0, 4, 0.0, 0, 0, 0, 0), (7, 0.0, 3, 0.0, 5, 0.0, 0, 0, 0, 0), (4, 0.0, 6, 0.0, 3, 0.0, 0, 0, 0, 0),
    (6, 0.2, 90, 0.0, 4, 0.0, 0, 0, 0, 0), (3, 0.0, 4, 0.0, 8, 0.0, 0, 0, 0, 0), (8, 0.9, 5, 0.0, 6, 0.0, 0, 0, 0, 0), (7, 1.0, 40, 0.0, 35, 0.0, 0, 0, 0, 0), (5, 1.0, 30, 0.0, 60, 0.1, 0, 0, 0, 0),
    (55, 0.0, 8, 0.0, 70, 0.0, 0, 0, 0, 1), (70, 0.05, 55, 0.0, 4, 0.0, 0, 0, 0, 1), (120, 0.0, 70, 0.0, 3, 1.0, 0, 0, 0, 1), (8, 0.0, 2, 1.0, 55, 0.0, 0, 0, 1, 1), (6, 0.0, 40, 0.0, 90, 0.0, 0, 0, 1, 1),
    (10, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 1), (22, 0.1, 30, 0.0, 45, 0.0, 0, 0, 0, 1), (18, 0.0, 80, 0.0, 5, 1.0, 0, 0, 0, 1), (40, 0.2, 6, 0.0, 30, 0.0, 0, 0, 0, 1), (300, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 1),
    (3, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (5, 0.6, 4, 1.0, 6, 0.0, 0, 0, 0, 0), (20, 0.9, 18, 1.0, 25, 0.8, 0, 0, 0, 0), (4, 0.0, 2, 0.0, 3, 1.0, 0, 0, 0, 0),
    (6, 0.0, 5, 1.0, 3, 0.0, 0, 0, 0, 0), (2, 0.0, 0, 0.0, 4, 1.0, 0, 0, 0, 0), (30, 0.8, 10, 1.0, 12, 1.0, 0, 0, 0, 0), (5, 0.0, 4, 1.0, 2, 1.0, 0, 0, 1, 0), (3, 1.0, 90, 0.0, 4, 1.0, 0, 0, 0, 0),
]
_ENCLOSURE = {"nav": 1, "head": 2, "foot": 3, "side": 4, "ad": 5, "form": 6, "notice": 7, "comment": 8}


def features(rows: list[tuple]) -> np.ndarray:
    """Words, link density, neighbours, inside main, enclosed by something else, heading."""
    x = np.array(rows, dtype=float).reshape(len(rows), -1)[:, :9]
    x[:, 7] = x[:, 7] > 0
    return x


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A tree by Gini impurity: a share of 1, or (feature, cut, left where x <= cut, right)."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            a, b = y[left], y[~left]
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, cut, left
    if best is None:
        return float(y.mean())
    _, f, cut, left = best
    return f, float(cut), grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def trained():
    return grow(features(BLOCKS), np.array([r[9] for r in BLOCKS], dtype=float))


def share(tree, x) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def _kind(name: str, attr: str) -> str | None:
    """What an element is for: an enclosure, "main", "hidden" or nothing.  What a whole page is called says nothing about its parts."""
    if name in ("html", "body"):
        return None
    kind = _AWAY.get(name) or ("main" if name in ("article", "main") else "head" if name == "header" else None)
    if kind in ("nav", "foot", "side", "form", "notice") or not attr:
        return kind
    said = set()
    for m in _ATTR.finditer(attr):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return "hidden"
        if key in ("class", "id", "role"):
            said.update(_KIND[w] for w in map(str.lower, _WORD.findall(value)) if w in _KIND)
    for k in ("comment", "ad", "notice", "form", "nav", "side", "foot", "head"):
        if k in said and not (k == "head" and kind == "main"):
            return k
    return kind or ("main" if "main" in said else None)


def blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """Blocks of a page: text, words, linked words, inside main, enclosure, heading."""
    out: list[tuple[str, int, int, int, int, int]] = []
    # Open elements: tag, kind, number.
    open_: list[tuple[str, str | None, int]] = []
    # Elements with a kind: kind, the numbers of those around it and itself, whether its tag sets it aside.
    known: list[tuple[str, tuple[int, ...], bool]] = []
    held: list[tuple[int, ...]] = []
    text: list[str] = []
    # Blocks that are headings of the first level.
    titles: set[int] = set()
    linked = link = silent = heading = first_level = 0

    def close():
        nonlocal linked
        if text:
            words = html.unescape("".join(text)).split()
            text.clear()
            if words:
                if first_level:
                    titles.add(len(out))
                held.append(tuple(n for _, k, n in open_ if k))
                out.append((" ".join(words), len(words), min(linked, len(words)), 0, 0, heading))
        linked = 0

    def say(piece: str):
        nonlocal linked
        if piece and not silent:
            text.append(piece)
            if link:
                linked += len(piece.split())

    def end_head():
        nonlocal silent
        if open_ and open_[-1][0] == "head":
            open_.pop()
            silent -= 1

    at = 0
    for m in _TAG.finditer(page):
        piece = page[at:m.start()]
        if silent and piece.strip():
            end_head()
        say(piece)
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "a":
                link = max(0, link - 1)
            if name in _BLOCK:
                close()
                link = heading = first_level = 0
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    silent -= sum(o[1] == "hidden" for o in open_[i:])
                    del open_[i:]
                    break
            continue
        if silent and name not in _HEAD:
            end_head()
        if name in _BLOCK:
            # Links end at the borders of blocks, so one that is never closed takes no more than its block.
            close()
            link = 0
            heading, first_level = int(name in ("h1", "h2", "h3", "h4", "h5", "h6")), int(name == "h1")
        elif name == "br":
            say(" ")
        elif name == "a":
            link = 1
        if name not in _VOID and name not in ("p", "a", "li", "b", "i", "em", "strong", "h1", "h2", "h3", "h4", "h5", "h6") or m["attr"] and name not in _VOID and name != "a":
            kind = "hidden" if name in _SILENT else _kind(name, m["attr"])
            if name in ("p", "li"):  # ends with the next one
                while open_ and open_[-1][0] == name:
                    silent -= open_.pop()[1] == "hidden"
            if m["attr"].endswith("/") and name not in _BLOCK:
                continue
            open_.append((name, kind, len(known)))
            if kind:
                known.append((kind, tuple(n for _, k, n in open_ if k), name in _ASIDE))
            silent += kind == "hidden"
        elif name in ("p", "li"):
            while open_ and open_[-1][0] == name:
                silent -= open_.pop()[1] == "hidden"
    if page[at:].strip():
        end_head()
    say(page[at:])
    close()
    return _placed(out, held, known, titles)


def _placed(found: list[tuple], held: list[tuple[int, ...]], known: list[tuple[str, tuple[int, ...], bool]], titles: set[int]) -> list[tuple]:
    """Blocks with what encloses them.

    The page's main part is the element of that kind with the most words (not in a sidebar
    and the like, if another is).  What encloses it says nothing about it, nor does what
    holds most words of the main part, or of a page without one, unless it holds
    comments and not the page's title.
    """
    words = [0] * len(known)
    for b, around in zip(found, held, strict=True):
        for n in around:
            words[n] += b[1]
    parts = [n for n, (kind, _, _) in enumerate(known) if kind == "main" and words[n]]
    part = max(parts, key=lambda n: (not any(known[o][2] for o in known[n][1]), words[n], -n), default=None)
    all_words = sum(b[1] for b in found)
    titled = {n for i in titles for n in held[i]}
    wraps = set(known[part][1]) if part is not None else set()

    def counts(n: int) -> bool:
        kind, around, _ = known[n]
        if n in wraps or kind == "main":
            return False
        if kind == "comment" and n not in titled:
            return True
        within = words[part] if part in around else all_words if part is None else None
        return within is None or 2 * words[n] <= within

    away = {n for n in range(len(known)) if counts(n)}
    out = []
    for b, around in zip(found, held, strict=True):
        first = next((i for i, n in enumerate(around) if known[n][0] == "main"), None)
        # A header inside a main part holds the article's title.
        kinds = [known[n][0] for i, n in enumerate(around) if n in away and not (known[n][0] == "head" and first is not None and i > first)]
        out.append((*b[:3], int(first is not None), _ENCLOSURE[kinds[-1]] if kinds else 0, b[5]))
    return out


def described(found: list[tuple]) -> list[tuple]:
    """Feature rows of the blocks of one page, in the columns of ``BLOCKS``."""
    sizes = [(0, 0.0), *((b[1], b[2] / b[1]) for b in found), (0, 0.0)]
    return [(*sizes[i + 1], *sizes[i], *sizes[i + 2], b[3], b[4], b[5]) for i, b in enumerate(found)]


def main_text(page: str, tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b[0] for b, x in zip(found, features(described(found)).tolist(), strict=True) if share(tree, x) > 0.5)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; null and empty pages have no text.  Other columns are ignored."""
    tree = trained()

    def make():
        def f(page, url, source):
            text = main_text(source or "", tree)
            yield page, url, text, len(text)
        return f

    return map_rows(pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")), make,
                    "page_id bigint, url string, text string, n_chars bigint")


def page_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, block, text, words, link_density, probability`` of every block of every page."""
    tree = trained()

    def make():
        def f(page, source):
            found = blocks(source or "")
            if found:
                for i, (b, x) in enumerate(zip(found, features(described(found)).tolist(), strict=True)):
                    yield page, i, b[0], b[1], b[2] / b[1], share(tree, x)
        return f

    return map_rows(pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).cast("string").alias("html")), make,
                    "page_id bigint, block int, text string, words bigint, link_density double, probability double")
