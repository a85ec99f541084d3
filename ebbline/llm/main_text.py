"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element; a line of a menu, header, footer, sidebar,
notice, advert, form or comment section becomes an empty line. Text lengths without links are summed
over a sliding window of lines. Where the sum surges above a threshold a stretch of text begins, where
it dives to it the stretch ends; every line of a stretch is kept, and so are short lines between two stretches
unless a line of nothing but links stands among them.

Every line of an explicit article is kept. Its lines weigh several times in the densest window, so that text outside
of it is kept only where it is nearly as dense. A container known as boilerplate only by a name is restored if no
other text is left on the page; one that speaks of comments never is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.shared import text_batches

#: Lines of a window; share of the densest window, and characters, above which a window is text.
WINDOW, SHARE, ENOUGH = 3, 0.1, 40
#: Times that the length of an article's line counts.
WEIGHT = 8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[a-z]+")

#: Elements whose content is raw text and never shown in the page.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "noframes", "xmp"}
#: Elements without an end tag.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that belong to no article.
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "fieldset"}
#: Parts of forms that stand within a line.
CONTROLS = {"select", "button", "label", "datalist"}
#: Words in a class, id, role or label by which a container is known as boilerplate, if its whole name consists of these and PLACES.
BOILERPLATE_WORDS = set(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead footer sidebar aside comment comments discussion disqus reply replies responses cookie cookies "
    "consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended widget toolbar pagination pager skip search searchbox form contentinfo complementary".split()
)
#: Words that say nothing of the content.
PLACES = set(
    "site page main global top bottom left right primary secondary container wrapper wrap inner outer box area bar block section list item "
    "items links link button buttons icons icon row col column columns panel".split()
)
#: Words that name a part of an article as well.
TOPICS = set(
    "promotion banner header discussion reply replies responses consent notice notices subscription share sharing social related "
    "recommended skip search form widget".split()
)
COMMENTS = {"comment", "comments", "disqus"}
#: A line outside of an article that claims rights in the page.
_RIGHTS = re.compile(r"\W*(?:copyright\W*)?(?:©|\(c\))\s*\d{4}|\W*copyright\s+\d{4}|\W*all rights reserved\W*$", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that begin a line.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split()
)

_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?=[\s/>])", re.I)
_CONTROL_TAG = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in CONTROLS}


def _after_control(page: str, name: str, at: int) -> int:
    """Where the page goes on after a control: past its end tag, or without one at the next control or block."""
    tag = _CONTROL_TAG[name].search(page, at)
    if tag and tag[1]:
        return tag.end()
    block = _BLOCK_TAG.search(page, at)
    return min(tag.start() if tag else len(page), block.start() if block else len(page))


def _names(rest: str) -> list[set[str]]:
    """Words of each whole name in class, id and role, and of each label."""
    found = []
    for kind, *values in _NAMES.findall(rest):
        value = next(filter(None, values), "").lower()
        found += [set(_WORD.findall(n)) for n in ([value] if kind.lower() == "aria-label" else value.split())]
    return found


def _words(name: str, rest: str, within: bool) -> set[str]:
    """Words of the names that say nothing but boilerplate; within an article only those that cannot name a part of it."""
    if not rest or name in HEADINGS or name in {"html", "body", "main"}:
        return set()
    known, allowed = BOILERPLATE_WORDS, BOILERPLATE_WORDS | PLACES
    if within:
        known = COMMENTS if name == "section" else BOILERPLATE_WORDS - TOPICS
        allowed = COMMENTS | PLACES if name == "section" else allowed
    return set().union(*(n & known for n in _names(rest) if n & known and n <= allowed))


def lines(page: str) -> tuple[list[str], np.ndarray, list[bool], list[bool], list[int], list[bool]]:
    """Lines of a page in order, their text lengths outside links, whether they stand in an article, are headings.

    Then for each line the number of the innermost container around it that is boilerplate by name, 0 if
    none, and for each number whether its names or those around it speak of comments.

    Links in a heading of an article, and in a line of it that is mostly other text, count as text.
    Lines of boilerplate are empty. Unclosed elements end with the page or with an element around them.
    """
    texts: list[str] = []
    lengths: list[int] = []
    inside: list[bool] = []
    headings: list[bool] = []
    named: list[int] = []
    comments, within = [False], [0]
    parts: list[str] = []
    linked = 0
    # Open containers: name, whether it is the top of a dropped part, whether it is an article, its number if known by name.
    stack: list[tuple[str, bool, bool, int]] = []
    dropped = articles = links = 0
    at, end, find = 0, len(page), _TOKEN.search

    def flush(heading: bool = False) -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        texts.append(text)
        own = max(0, len(text) - linked)
        lengths.append(len(text) if articles and (heading or 2 * own > len(text)) else own)
        inside.append(articles > 0)
        headings.append(heading)
        named.append(within[-1])
        linked = 0

    def add(raw: str, decode: bool = True) -> None:
        nonlocal linked
        if raw and not dropped:
            text = html.unescape(raw) if decode and "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    while at < end:
        found = find(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = found["name"]
        if name is None:
            if found["cdata"]:
                add(found["cdata"], decode=False)
            continue
        name, rest = name.lower(), found["rest"]
        if found["close"]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS:
                flush(name in HEADINGS)
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if depth is not None:
                    for _, drops, article, number in stack[depth:]:
                        dropped -= drops
                        articles -= article
                        if number:
                            within.pop()
                    del stack[depth:]
            continue
        if name in RAW:
            if not rest.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if name in CONTROLS:
            if not rest.endswith("/"):
                at = _after_control(page, name, at)
            continue
        if name == "br":
            add(" ")
        elif name == "a":
            links = 1
        if name not in BLOCKS and name not in BOILERPLATE or name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCKS:
            flush()
            links = 0
        # A block ends an open paragraph, an item the item before.
        if stack and (stack[-1][0] == "p" and name in BLOCKS or stack[-1][0] == name == "li"):
            _, drops, article, number = stack.pop()
            dropped -= drops
            articles -= article
            if number:
                within.pop()
        if name in {"article", "main", "body"} and any(open_[0] in {"nav", "header", "head"} for open_ in stack) and not articles:
            # The page left its menu or header open.
            stack = [(n, d and n not in {"nav", "header", "head"}, a, w) for n, d, a, w in stack]
            dropped = sum(d for _, d, _, _ in stack)
        if rest.endswith("/") and name not in BLOCKS:
            continue
        words = _words(name, rest, articles > 0)
        # The header of an article holds its headings.
        drops = name in BOILERPLATE and not (articles and name == "header" and not words)
        drops = drops or bool(rest) and name not in {"html", "body", "article", "main"} and bool(_HIDDEN.search(rest))
        number = 0
        if words and not drops and not dropped:
            number = len(comments)
            comments.append(comments[within[-1]] or not COMMENTS.isdisjoint(words))
            within.append(number)
        article = not drops and not dropped and not within[-1]
        article = article and (name in {"article", "main"} or "articlebody" in rest.lower())
        dropped += drops
        articles += article
        stack.append((name, drops, article, number))
    flush()
    return texts, np.array(lengths, np.int64), inside, headings, named, comments


def _densest(lengths: np.ndarray) -> int:
    return int(np.convolve(lengths, np.ones(WINDOW, np.int64)).max())


def _without_named(lengths: np.ndarray, running: np.ndarray, named: list[int], comments: list[bool]) -> np.ndarray:
    """Whether each line stays: those of a container known by name only if no running text is left outside of any.

    Then the densest such container stays. Comments never do.
    """
    of = np.array(named, np.int64)
    stays = of == 0
    if running[stays].any():
        return stays
    dense = {n: _densest(np.where(of == n, lengths, 0)) for n in set(named) if n and not comments[n]}
    most = max(dense.values(), default=0)
    return stays | np.isin(of, [n for n, d in dense.items() if d == most and most])


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by a line feed; empty for null, empty and textless pages."""
    if not page:
        return ""
    texts, lengths, inside, headings, named, comments = lines(page)
    if any(named):
        running = (lengths > 0) | np.array([a and t != "" for t, a in zip(texts, inside, strict=True)], bool)
        stays = _without_named(lengths, running & ~np.array(headings, bool), named, comments)
        texts, lengths = [t if s else "" for t, s in zip(texts, stays, strict=True)], np.where(stays, lengths, 0)
    full = np.array([len(t) for t in texts], np.int64)
    article = np.array(inside, bool) & (full > 0)
    rights = np.array([n > 0 and not a and _RIGHTS.match(t) is not None for t, n, a in zip(texts, full, article, strict=True)], bool)
    lengths, full = np.where(rights, 0, lengths), np.where(rights, 0, full)
    kept = article.copy()
    outside = np.where(article, 0, lengths)
    if article.any():
        least = SHARE * _densest(np.where(article, WEIGHT * lengths, lengths))
    else:
        least = min(ENOUGH, SHARE * _densest(lengths))
    ended = None
    for first, last in stretches(outside, least):
        kept[first:last] |= full[first:last] > 0
        if ended is not None and not article.any() and (lengths[ended:first] > 0)[full[ended:first] > 0].all():
            kept[ended:first] |= full[ended:first] > 0
        ended = last
        # Headings that lead to a stretch belong to it.
        while first and (headings[first - 1] or not full[first - 1]):
            first -= 1
            kept[first] |= full[first] > 0 and not article.any()
    return "\n".join(texts[i] for i in np.flatnonzero(kept))


def stretches(lengths: np.ndarray, least: float) -> list[tuple[int, int]]:
    """First line and last line + 1 of each stretch: from a surge of the window sums to their dive.

    Window i covers the lines i - WINDOW + 1 to i; a stretch loses its empty lines at both ends.
    """
    if not len(lengths):
        return []
    sums = np.convolve(lengths, np.ones(WINDOW, np.int64))
    dense = np.r_[False, sums > least, False]
    surges, dives = np.flatnonzero(dense[1:] & ~dense[:-1]), np.flatnonzero(~dense[1:] & dense[:-1])
    found = []
    for surge, dive in zip(surges, dives, strict=True):
        own = np.flatnonzero(lengths[max(0, surge - WINDOW + 1) : dive]) + max(0, surge - WINDOW + 1)
        own = own[own >= (found[-1][1] if found else 0)]
        if len(own):
            found.append((int(own[0]), int(own[-1]) + 1))
    return found


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: `id`, `url`, `text` (empty if none), `n_chars` (its code points).

    A null page counts as empty; an empty table gives no rows. Repeated rows give equal rows; other columns are
    not read, whatever their names. Pages of any length are read whole.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(page.as_py()) for page in batch["html"]], pa.string())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["url"], texts], ["id", "url", "text"])

    found = text_batches(rows).mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
