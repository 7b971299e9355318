"""Main text of web pages by tree scoring.

A page is cut into tags and text, and its text into blocks (runs between block-level tags). Each block passes points
for its length and commas to its ancestors, less with distance; an ancestor's points are discounted by its link
density. The best container is kept with those siblings that score well or read like prose; menus, headers, footers,
sidebars, notices, adverts, forms, comments and the like never take part. Names of states (has-sidebar, nav-open) cut
nothing. Where one class names content and another a side part in a longer name (content sidebar-right), the element
goes unless it holds at least half of the page's prose; a class that is just the side part's word (comment text, menu
main) always cuts. Where no text is left, paragraphs of prose in a part named as a sidebar or masthead are taken after
all; adverts, comments, menus and notices never are. Headings just before kept siblings stay. Lists of links are dropped as menus, but
not inside a part marked as content (article, main, a class such as content), where they are references. Blocks come
out in page order.

Edge cases: null or empty pages and pages without any text outside such parts give an empty text; unclosed or stray
tags, unclosed comments and scripts are read as browsers do in outline; nesting may be any depth (nothing recurses).
Extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame

from grainspark.llm.common import map_texts

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Element names, as HTML has them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg object select canvas audio video noembed noframes xmp".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | set("math mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics annotation".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
CLOSES_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
OUTSIDE = set("nav footer aside form button dialog menu head fieldset".split())
OUTSIDE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tablist".split())
#: Words of class and id that mark parts which are never main text, those of them that a second reading lifts, and words that mark such parts unless they also name content.
NEVER = set("ad ads advert adverts advertisement sponsor sponsored promo comment comments commentlist disqus respond reply replies cookie cookies consent gdpr sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer popup modal newsletter subscribe signup paywall skyscraper pagination pager masthead".split())
SIDE = set("sidebar sidebars masthead".split())
OFTEN = set("banner notice notices alert widget widgets related recommended share sharing social toolbar header topbar tags promoted teaser outbrain taboola shoutbox login disclaimer".split())
#: Names of a state of the page or its content, not of a part.
STATE = re.compile(r"(?:has|no|with|without)[-_]\S*|\S*[-_](?:open|opened|closed|layout)", re.I)
#: Characters of a block that is prose, and of such blocks that a second reading must find.
PROSE, LEAST_PROSE = 80, 200
HEADINGS = {f"h{k}" for k in range(1, 7)}
CONTENT = set("article content entry post story body main text hentry page blog".split())
#: Those of them that also name what is round the whole page.
WHOLE = set("body main page blog".split())


def _words(name: str) -> set[str]:
    return {w.lower() for w in _WORDS.findall(name)}


class Page:
    """The elements of a page (parents before children) and its text blocks."""

    def __init__(self, html: str, strict: bool = True):
        self.never = NEVER if strict else NEVER - SIDE
        self.parent, self.tag, self.out, self.link, self.weight = [-1], [""], [False], [False], [0.0]
        self.article, self.content = [False], [False]  # inside an article or main element; so, or inside one named as content
        self.doubt = [False]  # named as content and as a side part
        self.blocks: list[list] = []  # [element, text parts, characters in links]
        self._read(html)

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        up = stack[-1]
        weight = {"article": 30.0, "main": 25.0, "section": 3.0, "div": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0}.get(tag, -5.0 if tag in ("ul", "ol", "dl", "form", "address") else 0.0)
        out = self.out[up] or tag in OUTSIDE or tag == "header" and not self.article[up]
        content_name = doubt = False
        if attributes and not out:
            seen = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            words = {w.lower() for k in ("class", "id") if k in seen for w in _WORDS.findall(seen[k])}
            if tag not in ("body", "html"):
                names = [x for k in ("class", "id") if k in seen for x in seen[k].split() if not STATE.fullmatch(x)]
                content = tag == "main" or any(_words(x) <= CONTENT for x in names if _words(x))
                sides = [x for x in names if _words(x) & self.never]
                doubt = bool(sides) and content and not any(x.lower() in self.never for x in sides)
                out = bool(sides) and not doubt or bool(words & OFTEN and not words & CONTENT) or seen.get("role", "").lower() in OUTSIDE_ROLES
                out = out or "hidden" in seen or seen.get("aria-hidden") == "true" or "display:none" in seen.get("style", "").replace(" ", "").lower()
            content_name = bool(words & CONTENT - WHOLE) and not out and tag not in ("body", "html") or seen.get("role") == "main" or seen.get("itemprop") == "articleBody"
            weight += 25.0 * bool(words & CONTENT) + 25.0 * (seen.get("role") == "main" or seen.get("itemprop") == "articleBody")
        self.parent.append(up)
        self.doubt.append(doubt and not out)
        self.tag.append(tag)
        self.out.append(out)
        self.link.append(self.link[up] or tag == "a")
        self.weight.append(weight)
        self.article.append(self.article[up] or tag in ("article", "main"))
        self.content.append(self.content[up] or self.article[-1] or content_name)

    @staticmethod
    def _pop_to(stack: list[int], at: int) -> None:
        del stack[at:]

    def _read(self, html: str) -> None:
        stack, at, fresh = [0], 0, True

        def say(raw: str) -> None:
            nonlocal fresh
            if not raw or self.out[stack[-1]]:
                return
            text = unescape(raw) if "&" in raw else raw
            if fresh:
                if text.isspace():
                    return
                k = len(stack) - 1
                while k and self.tag[stack[k]] in INLINE:
                    k -= 1
                self.blocks.append([stack[k], [], 0])
                fresh = False
            self.blocks[-1][1].append(text)
            if self.link[stack[-1]]:
                self.blocks[-1][2] += len(text.strip())

        n = len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            if not m:
                say(html[at:])
                break
            if m.start() > at:
                say(html[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing = m[1] or m[4]
            if tag not in INLINE:
                fresh = True
            elif tag == "br" and not fresh:
                say(" ")
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    name = self.tag[stack[k]]
                    if name == tag:
                        self._pop_to(stack, k)
                        break
                    if tag in INLINE and name not in INLINE or tag == "p" and name in ("article", "div", "section", "body", "td", "li"):
                        break
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
                at = end.end()
                continue
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    name = self.tag[stack[k]]
                    if name == "p":
                        self._pop_to(stack, k)
                        break
                    if name not in INLINE:
                        break
            if tag in CLOSES_SAME:
                names, walls = CLOSES_SAME[tag]
                for k in range(len(stack) - 1, 0, -1):
                    name = self.tag[stack[k]]
                    if name in walls:
                        break
                    if name in names:
                        self._pop_to(stack, k)
                        if tag != "tr" or name == "tr":
                            break
            if tag == "body":
                self._pop_to(stack, 1)
            if tag not in VOID:
                self._open(stack, tag, m[3] or m[6] or "")
                stack.append(len(self.parent) - 1)


def main_blocks(html: str | None) -> list[str]:
    """The main text's blocks, white space inside each made one space."""
    if not html:
        return []
    found = _main_blocks(html, True)
    if found:
        return found
    again = _main_blocks(html, False)
    return again if sum(len(x) for x in again if len(x) >= PROSE) >= LEAST_PROSE else []


def _without_doubtful(page: Page, blocks: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The blocks but for those in doubtful elements that hold less than half of the page's prose."""
    if not any(page.doubt):
        return blocks
    prose = [0] * len(page.parent)
    for node, text, links in blocks:
        if len(text) >= PROSE and links < 0.5 * len(text):
            prose[node] += len(text)
    for i in range(len(prose) - 1, 0, -1):
        prose[page.parent[i]] += prose[i]
    gone = [False] * len(prose)
    for i in range(1, len(prose)):
        gone[i] = gone[page.parent[i]] or page.doubt[i] and 2 * prose[i] < max(prose[0], 1)
        page.out[i] = page.out[i] or gone[i]
    return [b for b in blocks if not gone[b[0]]]


def _main_blocks(html: str, strict: bool) -> list[str]:
    page = Page(html, strict)
    blocks = [(node, text, min(linked, len(text))) for node, parts, linked in page.blocks if (text := " ".join("".join(parts).split()))]
    blocks = _without_doubtful(page, blocks)
    if not blocks:
        return []
    n = len(page.parent)
    points, size, linked = [0.0] * n, [0] * n, [0] * n
    for node, text, links in blocks:
        size[node] += len(text)
        linked[node] += links
        worth = (1.0 if len(text) >= 25 else 0.0) + text.count(",") + min(len(text) / 100, 3.0)
        worth *= 1 - links / len(text)
        up, level = page.parent[node] if page.tag[node] not in ("div", "section", "article", "main", "body", "td") else node, 0
        while up > 0 and level < 6:
            points[up] += worth / (1, 2, 6, 9, 12, 15)[level]
            up, level = page.parent[up], level + 1
    for i in range(n - 1, 0, -1):
        size[page.parent[i]] += size[i]
        linked[page.parent[i]] += linked[i]
    rate = [(points[i] + page.weight[i] * (points[i] > 0)) * (1 - linked[i] / size[i]) if size[i] else 0.0 for i in range(n)]
    best = max(range(n), key=lambda i: rate[i])
    if rate[best] <= 0:
        best = 0
    i = best
    while i > 0 and page.tag[i] not in ("article", "main"):
        i = page.parent[i]
    best = i or best
    kept = [False] * n
    kept[best] = True
    if best:
        least = 0.2 * rate[best]
        for i in range(1, n):
            if page.parent[i] == page.parent[best] and size[i] and not page.out[i]:
                density = linked[i] / size[i]
                kept[i] = kept[i] or rate[i] >= least and rate[i] > 0 or page.tag[i] == "p" and size[i] > 80 and density < 0.25
        following = False
        for i in range(n - 1, 0, -1):
            if page.parent[i] == page.parent[best] and size[i]:
                kept[i] = kept[i] or following and page.tag[i] in HEADINGS
                following = kept[i]
    dropped = [False] * n
    links_in = [0] * n
    for i in range(n - 1, 0, -1):
        links_in[i] += page.tag[i] == "a"
        links_in[page.parent[i]] += links_in[i]
    for i in range(1, n):
        up = page.parent[i]
        kept[i] = kept[i] or kept[up]
        # Lists of links beside the text are menus; inside a part that is marked as content they are references.
        dense = page.tag[i] in ("ul", "ol", "div", "table", "section", "dl") and links_in[i] >= 3 and linked[i] > 0.6 * size[i] and not page.content[up]
        dropped[i] = dropped[up] or dense and i != best
    return [text for node, text, _ in blocks if kept[node] and not dropped[node]]


def extract(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The carried columns and ``text``: the main text, blocks joined by an empty line."""

    def run(texts):
        return None, [["\n\n".join(main_blocks(h)) for h in texts]]

    return map_texts(pages, html, [c for c in carry if c != "text"], "text string", lambda: run)
