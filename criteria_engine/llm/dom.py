"""A page's block elements, the text blocks in them, and numbers that describe them."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import numpy as np

# Names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is never text of the page.
HIDDEN = frozenset(
    "script style template noscript iframe noembed noframes title textarea xmp object svg select button "
    "canvas audio video datalist annotation annotation-xml".split()
)
RAW = frozenset("script style iframe noembed noframes title textarea xmp".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary", "legend"}
P_SCOPE = frozenset("table td th caption body html object template".split())
# Start tags that end an open element of these names, up to the nearest container.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
# A quote opens a value only right after `=`.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+|(?=>)))*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"(?:class|id|role|itemprop|aria-label|name)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ENDINGS = re.compile(r"[.!?;:,…。，]")

# Words of attributes, by what they say of an element.
TOKENS = {
    "body": "article articlebody content entry post story main text body blogpost hentry mainentity prose",
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs pager pagination toc tabs skip topbar links tags",
    "frame": "header head masthead footer foot colophon copyright logo legal banner contentinfo",
    "side": "sidebar side aside widget complementary related recommended more rail popular trending archive teaser",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense outbrain",
    "notice": "cookie cookies consent notice gdpr alert modal popup overlay dialog paywall privacy announcement",
    "form": "form newsletter subscribe signup login search contact register input feedback survey poll",
    "talk": "comment comments disqus discussion reply replies respond reviews review responses thread",
    "share": "share sharing social follow facebook twitter like meta byline author bio tools print",
}
GROUPS = list(TOKENS)
MEANING = {w: i for i, ws in enumerate(TOKENS.values()) for w in ws.split()}
TAGS = [
    {"article", "main"}, {"section"}, {"div"}, {"p", "blockquote", "pre"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6", "hgroup"},
    {"nav", "menu"}, {"ul", "ol", "dl", "dir"}, {"li", "dd", "dt"}, {"header"}, {"footer", "address"}, {"aside"},
    {"form", "fieldset", "legend", "search", "dialog"}, {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"},
    {"figure", "figcaption"}, {"body", "html"},
]
TAG_GROUP = {t: i for i, ts in enumerate(TAGS) for t in ts}


@dataclass
class Page:
    tags: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    inline: list[int] = field(default_factory=list)  # inline tags directly in an element
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters in links

    def add(self, tag: str, attributes: str, parent: int) -> int:
        self.tags.append(tag)
        self.attributes.append(attributes)
        self.parents.append(parent)
        self.inline.append(0)
        return len(self.tags) - 1


def parse(html: str) -> Page:
    """Block elements in page order, parents before children, under one root.

    Character references are decoded, white space in a block (also a line break) is one
    blank, blocks without text are left out. Damaged markup is read as browsers do in the
    common cases: missing end tags, unknown end tags, an unfinished last tag.
    """
    page = Page()
    root = page.add("html", "", -1)
    open_tags: list[tuple[str, int, bool]] = [("html", root, False)]
    names = Counter()  # of open tags, so that no search for one that is not open walks up
    parts: list[str] = []
    linked, hidden, place = 0, 0, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                page.blocks.append((open_tags[-1][1], text, min(linked, len(text))))
        parts, linked = [], 0

    def take(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            parts.append(text)
            if open_tags[-1][2]:
                linked += len(text)

    def close(depth: int) -> None:
        nonlocal hidden
        if any(t in BLOCKS for t, _, _ in open_tags[depth:]):
            flush()
        hidden -= sum(t in HIDDEN or t == "head" for t, _, _ in open_tags[depth:])
        names.subtract(t for t, _, _ in open_tags[depth:])
        del open_tags[depth:]

    end = len(html)
    while place < end:
        at = html.find("<", place)
        found = TOKEN.match(html, at) if at >= 0 else None
        if found is None:
            if at < 0:
                take(html[place:])
                break
            if html[at + 1 : at + 2].isalpha() and html.find(">", at) < 0:
                take(html[place:at])  # an unfinished last tag
                break
            take(html[place : at + 1])
            place = at + 1
            continue
        take(html[place:at])
        place = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag == "br":
                take(" ")
            for depth in range(len(open_tags) - 1, 0, -1) if names[tag] else ():
                if open_tags[depth][0] == tag:
                    close(depth)
                    break
            continue
        if tag == "br":
            take(" ")
            continue
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P and names["p"]:
            for depth in range(len(open_tags) - 1, 0, -1):
                if open_tags[depth][0] == "p":
                    close(depth)
                    break
                if open_tags[depth][0] in P_SCOPE:
                    break
        if tag in ENDS:
            ended, bound = ENDS[tag]
            lowest = 0
            for depth in range(len(open_tags) - 1, 0, -1) if any(names[t] for t in ended) else ():
                if open_tags[depth][0] in ended:
                    lowest = depth
                if open_tags[depth][0] in bound:
                    break
            if lowest:
                close(lowest)
        if tag == "body" and names["head"] and (depth := next((i for i, o in enumerate(open_tags) if o[0] == "head"), 0)):
            close(depth)
        node, in_link = open_tags[-1][1], open_tags[-1][2] or tag == "a"
        if tag in BLOCKS:
            flush()
            node = page.add(tag, found[3], node)
        else:
            page.inline[node] += 1
        open_tags.append((tag, node, in_link))
        names[tag] += 1
        hidden += tag in HIDDEN or tag == "head"
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, place)
            place = stop.start() if stop else end
    flush()
    return page


NAMES = [
    "depth", "chars", "own_chars", "link_share", "density", "marks", "children", "inline", "siblings", "place_among",
    "alike", "start", "page_share", "parent_link_share", "parent_density", "before_link_share", "mean_block",
    *(f"tag_{i}" for i in range(len(TAGS))), *(f"token_{g}" for g in GROUPS),
    *(f"above_tag_{i}" for i in range(len(TAGS))), *(f"above_token_{g}" for g in GROUPS),
]
PLAIN = NAMES.index("tag_0")


def features(page: Page) -> np.ndarray:
    """One row of NAMES for each element."""
    n, parents = len(page.tags), page.parents
    chars, links, marks, blocks = [0] * n, [0] * n, [0] * n, [0] * n
    first = [-1] * n
    total = 0
    for node, text, linked in page.blocks:
        chars[node] += len(text)
        links[node] += linked
        marks[node] += len(ENDINGS.findall(text))
        blocks[node] += 1
        if first[node] < 0:
            first[node] = total
        total += len(text)
    own, elements, children = chars[:], [1 + i for i in page.inline], [0] * n
    for i in range(n - 1, 0, -1):
        p = parents[i]
        chars[p] += chars[i]
        links[p] += links[i]
        marks[p] += marks[i]
        blocks[p] += blocks[i]
        elements[p] += elements[i]
        children[p] += 1
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    out = np.zeros((n, len(NAMES)), np.float32)
    seen, last, alike = [0] * n, [-1] * n, {}
    n_tags, n_groups = len(TAGS), len(GROUPS)
    depth = [0] * n
    for i in range(n):
        p, row = parents[i], out[i]
        share = links[i] / chars[i] if chars[i] else 0.0
        if p >= 0:
            depth[i] = depth[p] + 1
            key = p, page.tags[i]
            alike[key] = alike.get(key, 0) + 1
            before = last[p]
            seen[p] += 1
            last[p] = i
            row[7 + 1] = children[p]
            row[9] = seen[p] / children[p]
            row[10] = alike[key]
            row[13], row[14] = out[p][3], out[p][4]
            row[15] = out[before][3] if before >= 0 else -1
            up = out[p]
            above = PLAIN + n_tags + n_groups
            row[above:] = np.maximum(up[PLAIN:above], up[above:])
        row[0], row[1], row[2] = depth[i], np.log1p(chars[i]), np.log1p(own[i])
        row[3], row[4] = share, np.log1p(chars[i] / elements[i])
        row[5] = marks[i] / (chars[i] + 1) * 100
        row[6], row[7] = children[i], page.inline[i]
        row[11] = first[i] / total if first[i] >= 0 and total else 1.0
        row[12] = chars[i] / total if total else 0.0
        row[16] = np.log1p(chars[i] / blocks[i]) if blocks[i] else 0.0
        if (g := TAG_GROUP.get(page.tags[i])) is not None:
            row[PLAIN + g] = 1
        if page.attributes[i]:
            for value in NAMED.findall(page.attributes[i]):
                for word in WORD.findall(CAMEL.sub(" ", "".join(value)).lower()):
                    if (m := MEANING.get(word)) is not None:
                        row[PLAIN + n_tags + m] += 1
    return out


def decode(page: Page, gain: np.ndarray) -> np.ndarray:
    """Elements to keep: those of highest summed gain in which each kept one's parent is kept.

    gain: log odds that an element holds main text. A dropped element counts its gain
    negatively, with all elements in it.
    """
    n = len(page.tags)
    keep, drop = list(map(float, gain)), [-float(g) for g in gain]
    for i in range(n - 1, 0, -1):
        keep[page.parents[i]] += max(keep[i], drop[i])
        drop[page.parents[i]] += drop[i]
    kept = np.zeros(n, bool)
    for i in range(n):
        above = page.parents[i] < 0 or kept[page.parents[i]]
        kept[i] = above and keep[i] > drop[i]
    return kept
