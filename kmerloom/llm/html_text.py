"""Main text of web pages by tag-path ratios (operator 7).

A page is read once into text nodes: the text of one block with the path of block tags
above it, each tag with its class. For each path, text outside links and punctuation are summed
over its nodes; that is its ratio. Ratios are fused by their product and smoothed along the page, by nodes near by whose paths
part at the leaf, so that a heading takes after the paragraphs around it. Paths whose smoothed ratio reaches a share of the
page's largest are content. The deepest element that holds nearly all content is the article: its other blocks,
short cells and items among them, belong to it, and so does any block between two content blocks of one element.

Names of tags, roles and classes break ties. Where several paths reach the share, those of an element with a name for menus,
footers, adverts and the like give way to those without; inside the article, a part with such a name is no part of
it; and on a page whose largest path has fewer than EVIDENCE letters, ratios tell nothing and names alone decide. A name counts only below
the element that holds all text, so a form or a class around a whole page changes nothing. Reader comments are the one kind of text
that no ratio tells from an article, as it is written like one and may be longer: text in elements that are named so is left out before
ratios are taken.

Defined cases: a null html counts as the empty page and gives an empty text; text outside any
block is a block of its own; unclosed and stray tags are closed and ignored as browsers
do for blocks; a page with a quote that is never closed is read as if quotes in tags meant nothing from there
on; elements that are not shown, scripts, styles and the like have no text; pages of any length are
read whole, in time linear in it; rows that repeat give equal rows; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
INSIDE = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+""")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
PUNCTUATION = re.compile(r"[.,;:!?…。，！？]")

# HTML's own lists of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
BLOCK = ENDS_PARAGRAPH | frozenset("html head body li dt dd tr td th thead tbody tfoot caption legend option optgroup select button canvas object audio video".split())
HOLDS_PARAGRAPH = (BLOCK - {"p"}) | {"html"}
ENDS_LIKE = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
}
ENDS_LIKE = {tag: (frozenset(same.split()), frozenset(within.split())) for tag, (same, within) in ENDS_LIKE.items()}
LEAVES = frozenset("p li dt dd td th pre blockquote figcaption caption h1 h2 h3 h4 h5 h6".split())
# Tags and roles of what is seldom main text.
TAGS = frozenset("head nav footer form button select option fieldset dialog menu object audio video canvas search aside header".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar".split())
ARTICLE = frozenset("article main".split())
# Names of what is seldom main text, and parts that may follow such a name.
CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar rail widget widgets related recommended recommendations share sharing social "
    "comment comments commentlist disqus replies reply respond newsletter subscribe subscription signup login search footer masthead copyright toolbar".split()
)
CUE_PARTS = frozenset(
    "area bar block body bottom box button buttons column container content field footer form group header icons inner item items left link links list main message "
    "panel posts right section text thread title top unit widget wrap wrapper 1 2 3".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Nodes on each side that smooth a node, what their distance and each step between the paths makes of their part.
NEAR, BY_DISTANCE, BY_STEP, MOST_STEPS = 2, 0.6, 0.2, 3
#: Letters outside links of a page's largest path below which its ratios are no evidence.
EVIDENCE = 400
#: Share of the content that the article's element holds.
MOST = 0.9


@dataclass
class Page:
    """Text nodes in page order, the elements that they stand in, and the paths of these: element and path 0 are the root."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    paths: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    #: Of each node, its element; of each element, the one above, its tag, and whether it is named as no main text, as comments, as an article.
    inside: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: [""])
    named: list[bool] = field(default_factory=lambda: [False])
    comments: list[bool] = field(default_factory=lambda: [False])
    article: list[bool] = field(default_factory=lambda: [False])


def is_cue(name: str, cues: frozenset[str] = CUES) -> bool:
    """Whether a class name or id is a cue, ends in one, or is one with a part of a page behind it."""
    parts = [p.lower() for p in PART.findall(name)]
    return bool(parts) and ("".join(parts) in cues or parts[-1] in cues or (parts[0] in cues and len(parts) == 2 and parts[1] in CUE_PARTS))


def _attributes(text: str) -> tuple[str, bool, bool, str, bool]:
    """Class as part of a path, whether it or the id is a cue, or one for comments, the role, and whether the element is hidden."""
    kind, cue, comments, role, hidden = "", False, False, "", False
    for name, value in ATTRIBUTE.findall(text) if text else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "class":
            kind = "." + ".".join(value.split())
        if name in ("class", "id"):
            cue |= any(map(is_cue, value.split()))
            comments |= any(is_cue(v, COMMENTS) for v in value.split())
        elif name == "role":
            role = value.lower()
        hidden |= name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.lower().replace(" ", ""))
    return kind, cue, comments, role, hidden


class _Reader:
    """One pass over a page."""

    def __init__(self) -> None:
        self.page = Page()
        self.ids: dict[tuple[int, str], int] = {}
        self.stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]  # tag, path, element, hidden, inside an article
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.in_link = self.link_chars = 0  # depth of the stack at which a link opened, or 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.page.paths.append(self.stack[-1][1])
                self.page.texts.append(text)
                self.page.inside.append(self.stack[-1][2])
                self.page.linked.append(min(self.link_chars, len(text)))
            self.parts.clear()
        self.link_chars = 0

    def text(self, piece: str) -> None:
        if piece and not self.stack[-1][3]:
            piece = html.unescape(piece)
            self.parts.append(piece)
            if self.in_link:
                self.link_chars += len(piece.strip())

    def link(self, opens: bool) -> None:
        self.in_link = len(self.stack) if opens else 0

    def close(self, tags: frozenset[str], barriers: frozenset[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in tags:
                self.flush()
                for tag, *_ in self.stack[k:]:
                    self.open[tag] -= 1
                del self.stack[k:]
                if self.in_link > k:
                    self.in_link = 0
                return
            if self.stack[k][0] in barriers:
                return

    def start(self, tag: str, attributes: str) -> None:
        self.flush()
        if tag in ENDS_PARAGRAPH:
            self.close(_P, HOLDS_PARAGRAPH)
        if tag in ENDS_LIKE:
            self.close(*ENDS_LIKE[tag])
        kind, cue, comments, role, hidden = _attributes(attributes)
        _, path, element, was_hidden, inside = self.stack[-1]
        page = self.page
        key = (path, tag + kind)
        if key not in self.ids:
            self.ids[key] = len(page.parent)
            page.parent.append(path)
            page.depth.append(page.depth[path] + 1)
        is_article = tag in ARTICLE or role in ARTICLE
        page.above.append(element)
        page.tags.append(tag)
        page.named.append(tag in TAGS and not (tag == "header" and inside) or role in ROLES or cue and tag not in LEAVES)
        page.comments.append(comments and tag not in LEAVES)
        page.article.append(is_article)
        self.stack.append((tag, self.ids[key], len(page.above) - 1, was_hidden or hidden, inside or is_article))
        self.open[tag] += 1


_P = frozenset(["p"])


def read_page(page: str) -> Page:
    """The blocks of a page that are shown, in page order, with their paths."""
    r = _Reader()
    at, quotes, size = 0, True, len(page)
    while True:
        lt = page.find("<", at)
        if lt < 0:
            r.text(page[at:])
            break
        if page.startswith("<!--", lt):
            r.text(page[at:lt])
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        found = NAME.match(page, lt + 1)
        if not found:
            mark = page[lt + 1 : lt + 2] in ("!", "?", "/") and lt + 1 < size
            r.text(page[at:lt] if mark else page[at : lt + 1])
            end = page.find(">", lt) if mark else lt
            at = size if end < 0 else end + 1
            continue
        r.text(page[at:lt])
        end = INSIDE.match(page, found.end()).end() if quotes else page.find(">", found.end())
        if end < 0 or end >= size or page[end] != ">":
            quotes = False
            end = page.find(">", found.end())
            if end < 0:
                break
        attributes, tag = page[found.end() : end], found[2].lower()
        at = end + 1
        if tag in RAW:
            if not found[1] and not attributes.endswith("/"):
                stop = re.compile(rf"</{tag}(?![A-Za-z])[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else size
        elif tag == "a":
            r.link(not found[1])
        elif tag == "br":
            r.text(" ")
        elif tag == "hr":
            r.flush()
        elif tag in VOID or tag not in BLOCK:
            continue
        elif found[1]:
            r.close(frozenset([tag]), frozenset() if tag in ("body", "html") else _PAGE)
        else:
            r.start(tag, attributes)
    r.flush()
    return r.page


_PAGE = frozenset(["body", "html"])


def _apart(page: Page, p: int, q: int) -> int | None:
    """Steps up from two paths to where they part, the larger number; none if more than MOST_STEPS."""
    steps = 0
    parent, depth = page.parent, page.depth
    while p != q:
        steps += 1
        if steps > MOST_STEPS:
            return None
        p, q = (parent[p] if depth[p] >= depth[q] else p), (parent[q] if depth[q] >= depth[p] else q)
    return steps


def path_ratios(page: Page, nodes: list[int] | None = None) -> dict[int, tuple[int, int]]:
    """Of each path with text: letters outside links, and punctuation outside links, over its nodes."""
    sums: dict[int, list[int]] = {}
    for i in range(len(page.paths)) if nodes is None else nodes:
        text, linked = page.texts[i], page.linked[i]
        s = sums.setdefault(page.paths[i], [0, 0])
        s[0] += len(text) - linked
        s[1] += len(PUNCTUATION.findall(text)) if 2 * linked < len(text) else 0
    return {path: (chars, marks) for path, (chars, marks) in sums.items()}


def path_weights(page: Page, nodes: list[int]) -> dict[int, float]:
    """The fused and smoothed ratio of each path of ``nodes``."""
    fused = {path: float(chars * (1 + marks)) for path, (chars, marks) in path_ratios(page, nodes).items()}
    smooth: dict[int, list[float]] = {path: [0.0, 0.0] for path in fused}
    for i, node in enumerate(nodes):
        path = page.paths[node]
        weight = total = 0.0
        for j in range(max(0, i - NEAR), min(len(nodes), i + NEAR + 1)):
            other = page.paths[nodes[j]]
            steps = _apart(page, path, other)
            if steps is not None:
                part = BY_DISTANCE ** abs(i - j) * BY_STEP**steps
                weight, total = weight + part * fused[other], total + part
        smooth[path][0] += weight / total
        smooth[path][1] += 1
    return {path: w / k if fused[path] else 0.0 for path, (w, k) in smooth.items()}


def _holding(page: Page, amount: dict[int, int], share: float) -> int:
    """The deepest element that holds ``share`` of an amount given for nodes."""
    held = [0] * len(page.above)
    for node, n in amount.items():
        held[page.inside[node]] += n
    for e in range(len(held) - 1, 0, -1):
        held[page.above[e]] += held[e]
    found = 0
    for e in range(1, len(held)):  # elements stand behind the one above them
        if page.above[e] == found and held[e] >= share * held[0] and held[e]:
            found = e
    return found


def _below(page: Page, top: int, marks: list[bool]) -> list[bool]:
    """For each element, whether it or one above it, but strictly below ``top``, is marked; none outside ``top`` unless ``top`` is the root."""
    out = [False] * len(marks)
    around, e = set(), top
    while e >= 0:
        around.add(e)
        e = page.above[e]
    for e in range(1, len(marks)):
        out[e] = e not in around and (marks[e] or out[page.above[e]])
    return out


def content_nodes(page: Page, share: float = 0.2, names: bool = True) -> list[int]:
    """The nodes of the main text. Without ``names``, ratios alone decide, and what is named comments is not left out."""
    own = [i for i in range(len(page.texts)) if 2 * page.linked[i] < len(page.texts[i])]
    whole = _holding(page, {i: len(page.texts[i]) for i in range(len(page.texts))}, 1.0)
    if names:
        comments = _below(page, whole, page.comments)
        own = [i for i in own if not comments[page.inside[i]]]
    if not own:
        return []
    # smoothing sees blocks of links as well, as paths of no weight
    left = set(own)
    seen = [i for i in range(len(page.texts)) if i in left or 2 * page.linked[i] >= len(page.texts[i])]
    weights = path_weights(page, seen)
    most = max(weights.values())
    evident = max(chars for chars, _ in path_ratios(page, own).values()) >= EVIDENCE
    kept = [i for i in own if weights[page.paths[i]] >= share * most and weights[page.paths[i]] > 0] if evident or not names else own
    named = _below(page, whole, page.named) if names else [False] * len(page.above)
    kept = [i for i in kept if not named[page.inside[i]]] or kept
    if names and not evident:
        article = _below(page, 0, page.article)
        kept = [i for i in kept if article[page.inside[i]]] or kept
    top = _holding(page, {i: len(page.texts[i]) for i in kept}, MOST)
    while page.tags[top] in LEAVES:
        top = page.above[top]
    inner = _below(page, top, page.named) if names else named
    within = _below(page, 0, [e == top for e in range(len(page.above))]) if page.tags[top] not in ("", "html", "body") else [False] * len(page.above)
    found = set(kept)
    last: tuple[int, int] | None = None  # element above the last content block, and where this stands in ``own``
    for k, i in enumerate(own):
        if within[page.inside[i]] and not inner[page.inside[i]]:
            found.add(i)
        if i in found:
            here = page.above[page.inside[i]]
            if last and last[0] == here:
                found.update(j for j in own[last[1] + 1 : k] if not named[page.inside[j]])
            last = here, k
    return sorted(found)


def main_text(page: str | None, share: float = 0.2, names: bool = True) -> str:
    """The content of a page: its blocks joined by two line ends."""
    read = read_page(page or "")
    return "\n\n".join(read.texts[i] for i in content_nodes(read, share, names))


def extract(pages: DataFrame, share: float = 0.2) -> DataFrame:
    """page_id, url, text and n_chars of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                texts = [main_text(x, share) for x in part["html"]]
                yield pd.DataFrame({"page_id": part["page_id"].to_numpy(), "url": part["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts]})

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars bigint")
