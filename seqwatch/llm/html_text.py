"""Main text of web pages by the ratios of text and punctuation over tag paths."""

from __future__ import annotations

import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

from seqwatch.llm.shared import map_columns

#: Elements by the part they play in a page.
VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
RAW = {*"script style textarea title xmp iframe noembed noframes".split()}
HIDDEN = {*"script style title xmp iframe noembed noframes noscript template head svg math object audio video canvas map".split()}
FURNITURE = {*"nav footer aside button select textarea menu dialog input".split()}
#: Elements that are furniture but where a whole page may lie in one of them.
WRAPPERS = {*"form fieldset label header".split()}
BLOCKS = {
    *"address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form".split(),
    *"h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split(),
}
HOLDERS = {*"html body main article section div center form fieldset header td".split()}
HEADINGS = {*"h1 h2 h3 h4 h5 h6".split()}
#: What an opening tag ends, up to the element that bounds the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
ENDS_P = BLOCKS - {"html", "head", "body", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dt", "dd", "legend"} | {"li", "dt", "dd"}
BOUNDS_P = {"html", "body", "table", "td", "th", "caption", "object", "button", "template"}
#: Words in a class or id that mark parts beside the article; of these, the layout words also name whole pages.
MARKS = {
    *"ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promoted promotion banner".split(),
    *"comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay".split(),
    *"newsletter subscribe subscription signup login breadcrumb breadcrumbs share sharing pagination pager skip".split(),
}
LAYOUT_MARKS = {
    *"nav navbar navigation menu menus submenu sidebar sidebars aside rail footer footnav masthead topbar toolbar".split(),
    *"social related recommended widget widgets".split(),
}
#: Parts of a class that tell what a page has or lacks, not what the element is: no-sidebar, story-with-related.
MODIFIERS = {*"no not has have with without is".split()}
ROLES = {*"navigation banner contentinfo search dialog alert alertdialog menu menubar".split()}
LAYOUT_ROLES = {*"complementary form".split()}
COMMENTS = {*"comment comments commentlist reply replies".split()}
#: Words that name a mark's kind or state, not what it is: what stands before them counts, or nothing does.
NEUTRAL = {
    *"box wrap wrapper container block area list section bar inner outer top bottom left right links link buttons button text form slot unit body".split(),
    *"content item items row col column group holder panel module zone frame image title label center mobile desktop small large header".split(),
}
STATES = {*"open opened shown visible active enabled disabled accepted loaded ready state on off in out free true false closed".split()}
#: Marks that say what a part is wherever they stand in a name.
ADVERTS = {*"ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promoted promotion".split()}
#: Elements of running text within an article, on which only some marks are plain.
RUNNING = {*"p blockquote pre li dd dt td th figure figcaption q span em strong b i small".split()}
NOTICE = re.compile(r"(?:©|\(c\)\s|copyright\s+(?:©|\(c\)|by\b|(?:19|20)\d\d))", re.I).match
#: Characters of a notice of rights at most.
NOTICE_CHARS = 300
PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？¿¡…]").findall

_QUOTED_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>")
_MARKING = re.compile(r"""[\s"'/](class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+").findall

#: What is known of an element before any ratio: nothing, a part beside the article unless most of the text is in it,
#: a part beside the article by its role unless the article is in it, or a part beside the article.
FREE, LAYOUT, ROLE, BESIDE = 0, 1, 2, 3
#: What a name that marks a part beside the article leaves of its path's value: of a plain mark, and of a doubtful one.
PLAIN, DOUBTFUL = 1e-4, 0.3
#: Weight of each neighbouring path in the smoothing.
NEIGHBOUR = 0.1
#: A layout element with so many times the text that lies free is taken for the page itself.
WHOLE_PAGE = 2.0
#: Characters outside links that such an element must have, where it holds no article, main or first heading.
PAGE_CHARS = 140
#: Above this share of characters in links, a part without a selected path is a menu.
LINKED = 0.5


def mark(token: str, running: bool) -> float:
    """What one name of a class or id leaves of the value of an element's path; 1 if it marks nothing."""
    parts = _WORDS(token)
    if not MODIFIERS.isdisjoint(parts) or parts and parts[-1] in STATES or MARKS.isdisjoint(parts):
        return 1.0
    while parts[-1] in NEUTRAL:
        parts.pop()
    if not ADVERTS.isdisjoint((parts[0], parts[-1])):
        return PLAIN
    return PLAIN if parts[-1] in MARKS and not running else DOUBTFUL


def prior(tag: str, attributes: str, in_article: bool) -> tuple[int, float]:
    """What an element's tag, role, class and id say of it: a part beside the article, and the weight of its path."""
    if tag in HIDDEN or tag in FURNITURE:
        return BESIDE, 1.0
    found, weight = LAYOUT if tag in WRAPPERS and not (tag == "header" and in_article) else FREE, 1.0
    if not attributes or tag in ("html", "body"):
        return found, weight
    for name, value in _MARKING.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return BESIDE, 1.0
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return BESIDE, 1.0
        if name == "role" and value in ROLES:
            found = max(found, ROLE)
        if name == "role" and value in LAYOUT_ROLES:
            found = max(found, LAYOUT)
        if name in ("class", "id"):
            for token in value.split():
                words = set(_WORDS(token))
                if tag in ("article", "main") and COMMENTS.isdisjoint(words):
                    continue
                weight = min(weight, mark(token, in_article and tag in RUNNING))
                if MODIFIERS.isdisjoint(words) and not LAYOUT_MARKS.isdisjoint(words) and tag not in ("article", "main"):
                    found = max(found, LAYOUT)
    if weight < DOUBTFUL and tag not in BLOCKS:
        return BESIDE, 1.0
    return found, weight if tag in BLOCKS else 1.0


class Part:
    """Text of one block, or of several blocks of one element: characters, punctuation and characters in links."""

    __slots__ = ("element", "texts", "chars", "marks", "linked", "blocks")

    def __init__(self, element: int):
        self.element, self.texts, self.chars, self.marks, self.linked, self.blocks = element, [], 0, 0, 0, 0

    def text(self) -> str:
        return " ".join("".join(self.texts).split())


class Page:
    """Elements and text nodes of one page; unclosed elements end where a browser would end them.

    The places of open elements are kept by tag, so that each tag is handled in constant time however deep it lies. A
    tag whose quotes never end is cut at the next `>`, and from there on quotes protect no `>`.
    """

    def __init__(self, html: str):
        self.tags, self.parents, self.paths, self.priors, self.weights = ["html"], [-1], [0], [FREE], [1.0]
        self.path_ids: dict[tuple[int, str, float], int] = {}
        self.texts: list[tuple[int, int, int, bool, str]] = []  # element, its block element, block number, in a link, text
        self.stack, self.block = [0], 0
        self.depths: dict[str, list[int]] = {}  # places in the stack of the open elements of each tag
        self.block_depths = [0]
        at, end, quoted, last = 0, len(html), True, html.rfind(">")
        while at < end:
            start = html.find("<", at)
            if start < 0 or start > last and not html.startswith("<!--", start):
                break
            follows = html[start + 1 : start + 2]
            if follows in ("!", "?"):
                stop, text = self._skipped(html, start, last)
            elif follows.isascii() and follows.isalpha() or follows == "/" and html[start + 2 : start + 3].isalpha():
                m = _QUOTED_TAG.match(html, start) if quoted else None
                if not m:
                    quoted, m = False, _PLAIN_TAG.match(html, start)
                stop, text = (m.end(), None) if m else (start + 1, "<")
            else:
                m, stop, text = None, start + 1, "<"
            if start > at:
                self._text(html[at:start])
            at = stop
            if text is not None or follows in ("!", "?"):
                if text:
                    self._text(text)
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
                continue
            self._open(tag, m[3])
            if tag in RAW:
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                if not close:
                    at = end
                    break
                at = close.start()
        if at < end:
            self._text(html[at:])

    @staticmethod
    def _skipped(html: str, start: int, last: int) -> tuple[int, str | None]:
        """Where a comment, declaration or section that begins at `start` ends, and its text."""
        for opens, closes in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if html.startswith(opens, start):
                at = html.find(closes, start + len(opens))
                inner = html[start + len(opens) : at if at >= 0 else len(html)]
                return (at + 3 if at >= 0 else len(html)), (inner if opens == "<![CDATA[" else None)
        return html.index(">", start, last + 1) + 1, None

    def _text(self, raw: str) -> None:
        self.texts.append((self.stack[-1], self.stack[self.block_depths[-1]], self.block, bool(self.depths.get("a")), unescape(raw)))

    def _pop_to(self, depth: int) -> None:
        if self.block_depths[-1] >= depth:
            self.block += 1
        while self.block_depths[-1] >= depth:
            self.block_depths.pop()
        for e in self.stack[depth:]:
            self.depths[self.tags[e]].pop()
        del self.stack[depth:]

    def _last(self, tags) -> int:
        """Place of the innermost open element with one of these tags, or 0."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def _end(self, tags: set[str], bounds: set[str]) -> None:
        depth = self._last(tags)
        if depth > self._last(bounds):
            self._pop_to(depth)

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "html":
            return
        if tag == "br":
            self._text(" ")
            return
        if tag in VOID:
            self.block += tag == "hr"
            return
        if tag in ENDS_P:
            self._end({"p"}, BOUNDS_P)
        if tag == "body":
            self._end({"head"}, {"html"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        above, is_block = self.stack[-1], tag in BLOCKS
        self.tags.append(tag)
        self.parents.append(above)
        found, weight = prior(tag, attributes, self._last(("article", "main")) > 0)
        self.paths.append(self.path_ids.setdefault((self.paths[above], tag, weight), len(self.path_ids) + 1) if is_block else self.paths[above])
        self.priors.append(found)
        self.weights.append(weight)
        self.depths.setdefault(tag, []).append(len(self.stack))
        if is_block:
            self.block_depths.append(len(self.stack))
            self.block += 1
        self.stack.append(len(self.tags) - 1)

    def _close(self, tag: str) -> None:
        depth = self._last((tag,))
        if depth and (tag in BLOCKS or depth > self.block_depths[-1]):  # an inline end tag doesn't end blocks
            self._pop_to(depth)

    def _article(self) -> int:
        """The first with text of: main elements, articles without a mark around them, h1, other articles; or -1."""
        n = len(self.tags)
        full = [False] * n
        for element, _, _, _, text in self.texts:
            full[element] |= not text.isspace() and text != ""
        for e in range(n - 1, 0, -1):
            full[self.parents[e]] |= full[e]
        shown, marked = [True] * n, [False] * n
        for e in range(1, n):
            shown[e] = shown[self.parents[e]] and self.priors[e] != BESIDE
            marked[e] = marked[self.parents[e]] or self.weights[e] < 1
        order = {("main", False): 0, ("main", True): 0, ("article", False): 1, ("h1", False): 2, ("h1", True): 2, ("article", True): 3}
        found = [(order[self.tags[e], marked[e]], e) for e in range(n) if (self.tags[e], marked[e]) in order and full[e] and shown[e]]
        return min(found, default=(0, -1))[1]

    def free_texts(self) -> list[tuple[int, int, int, bool, str]]:
        """The text nodes outside parts beside the article.

        Names and roles of elements around the page's article say nothing of it. A layout mark on an element that holds
        most of the text (a page within a form, a wrapper named after its sidebar) says nothing of that text; so the one
        with most text of its own, if that is several times the free text, is free with all around it. Where the page
        has an article or main element, it must hold that. Weights become those of the whole path.
        """
        n = len(self.tags)
        e = self._article()
        if e >= 0 and self.tags[e] != "h1" and self.weights[e] < 1:
            e = self.parents[e]
        while e >= 0:
            self.priors[e], self.weights[e] = (FREE if self.priors[e] == ROLE else self.priors[e]), 1.0
            e = self.parents[e]
        nearest, barred = [-1] * n, [False] * n
        for e in range(n):
            above = self.parents[e]
            if e:
                self.weights[e] = min(self.weights[e], self.weights[above])
            nearest[e] = e if self.priors[e] else nearest[above] if e else -1
            barred[e] = self.priors[e] >= ROLE or self.weights[e] < DOUBTFUL or e > 0 and barred[above]
        roots, firsts = [False] * n, [False] * n
        for e in range(n - 1, -1, -1):
            roots[e] |= self.tags[e] in ("article", "main")
            firsts[e] |= self.tags[e] == "h1"
            if e:
                roots[self.parents[e]] |= roots[e]
                firsts[self.parents[e]] |= firsts[e]
        own: dict[int, int] = {}
        for element, _, _, linked, text in self.texts:
            if not barred[element] and not linked:
                own[nearest[element]] = own.get(nearest[element], 0) + len("".join(text.split()))
        free = own.pop(-1, 0)
        whole = max(own, key=lambda e: (own[e], -e), default=-1)
        if whole >= 0 and own[whole] >= WHOLE_PAGE * free and (roots[whole] if roots[0] else firsts[whole] or own[whole] >= PAGE_CHARS):
            e = whole
            while e >= 0:
                self.priors[e] = FREE
                e = self.parents[e]
            for e in range(1, n):
                nearest[e] = e if self.priors[e] else nearest[self.parents[e]]
        return [t for t in self.texts if nearest[t[0]] < 0]

    def parts(self) -> list[Part]:
        """The blocks with text, in page order."""
        found: dict[int, Part] = {}
        for _, holder, block, linked, text in self.free_texts():
            part = found.get(block)
            if part is None:
                part = found[block] = Part(holder)
            n = len("".join(text.split()))
            part.texts.append(text)
            part.chars += n
            part.marks += len(PUNCTUATION(text))
            part.linked += n * linked
        return [p for p in found.values() if p.chars]

    def path_table(self, parts: list[Part]) -> dict[int, list[int]]:
        """Blocks, characters, punctuation marks and characters in links of each root-to-leaf path, in page order."""
        table: dict[int, list[int]] = {}
        for p in parts:
            row = table.setdefault(self.paths[p.element], [0, 0, 0, 0])
            for k, v in enumerate((1, p.chars, p.marks, p.linked)):
                row[k] += v
        return table

    def path_values(self, parts: list[Part]) -> dict[int, float]:
        """Text and punctuation a block of each path, smoothed over neighbours, multiplied, less the part in links.

        A path through a marked element keeps the weight of the mark.
        """
        table = self.path_table(parts)
        if not table:
            return {}
        rows = np.array([*table.values()], float)
        ratios = rows[:, 1:3] / rows[:, :1]
        if len(ratios) > 2:
            padded = np.pad(ratios, ((1, 1), (0, 0)), "edge")
            ratios = NEIGHBOUR * padded[:-2] + (1 - 2 * NEIGHBOUR) * padded[1:-1] + NEIGHBOUR * padded[2:]
        weights = {self.paths[p.element]: self.weights[p.element] for p in parts}
        prior = np.array([weights[path] for path in table])
        return dict(zip(table, (ratios[:, 0] * (1 + ratios[:, 1]) * (1 - rows[:, 3] / rows[:, 1]) * prior).tolist()))

    def content(self) -> list[Part]:
        """The content blocks: those on paths whose value reaches the deviation of all values, and what belongs to them."""
        parts = self.parts()
        plain = [self.weights[p.element] >= DOUBTFUL for p in parts]
        values = self.path_values(parts)
        least = min(np.std([*values.values()]), max(values.values())) if any(plain) else np.inf
        chosen = [values[self.paths[p.element]] >= max(least, 1e-9) for p in parts]
        if not any(chosen):
            return [p for p, c in zip(parts, plain) if c]
        n = len(self.tags)
        held = [0] * n  # selected blocks in each element
        for p, c in zip(parts, chosen):
            held[p.element] += c
        for e in range(n - 1, 0, -1):
            held[self.parents[e]] += held[e]
        # Each other block belongs to the outermost element around it without selected blocks, or stands in one with some.
        outer = [-1] * n
        for e in range(1, n):
            if not held[e]:
                outer[e] = e if held[self.parents[e]] else outer[self.parents[e]]
        total = sum(chosen)
        root = max(e for e in range(n) if held[e] == total)
        while self.tags[root] not in HOLDERS:
            root = self.parents[root]
        others: dict[tuple[int, int], Part] = {}  # by the element that stands, or the block in an element with some
        kin: list[tuple[int, int]] = []
        for k, (p, c) in enumerate(zip(parts, chosen)):
            kin.append(key := (-1, -1) if c else (outer[p.element], -1 if outer[p.element] >= 0 else k))
            if not c:
                o = others.setdefault(key, Part(outer[p.element] if outer[p.element] >= 0 else p.element))
                o.chars, o.marks, o.linked, o.blocks = o.chars + p.chars, o.marks + p.marks, o.linked + p.linked, o.blocks + 1
        above = {key: self.parents[o.element] if key[0] >= 0 else o.element for key, o in others.items()}
        beside: dict[int, list[Part]] = {}
        for key, o in others.items():
            beside.setdefault(above[key], []).append(o)
        while (up := self.parents[root]) >= 0 and self.tags[up] not in ("html", "body") and all(self._prose(o) for o in beside.get(up, ())):
            root = up
        first = chosen.index(True)
        kept = [p for k, (p, c) in enumerate(zip(parts, chosen)) if c or plain[k] and self._kept(p, others[kin[k]], above[kin[k]], root, total, held, k < first)]
        while len(kept) > 1 and kept[-1].chars <= NOTICE_CHARS and NOTICE(kept[-1].text()):
            kept.pop()  # a notice of rights at the end
        return kept

    def _prose(self, o: Part) -> bool:
        return self.tags[o.element] in HEADINGS or o.marks > 0 and o.linked <= LINKED * o.chars

    def _kept(self, block: Part, o: Part, above: int, root: int, total: int, held: list[int], early: bool) -> bool:
        """Whether an unselected block stays, by the part `o` that it belongs to and the element `above` around that."""
        tag = self.tags[o.element]
        outside = held[above] == total and above < root or self.tags[above] in ("html", "body") and tag in HOLDERS
        if tag in HEADINGS:
            return early or not outside
        if o.linked > LINKED * o.chars:
            return False
        if outside or self.weights[block.element] < 1:
            return block.marks > 0 and (tag == "p" or not outside)
        return True

    def main_text(self) -> str:
        return "\n".join(p.text() for p in self.content())


def main_text(html: str | None) -> str:
    return Page(html).main_text() if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Blocks of text are grouped by their root-to-leaf tag path (inline elements belong to the text). Mean text length and
    mean punctuation of each path are smoothed over neighbouring paths and multiplied, less the share of the text in
    links; paths that reach the deviation of all values select the content nodes. What lies among these in the lowest
    element that holds them all belongs to them (headings, short lists), but for menus and notices; outside it, only
    headings before them and paragraphs with punctuation. Tags, roles, classes and ids serve as a prior: what they mark
    as beside the article is no candidate.

    Null and empty pages, and pages without text, give the empty string; if all text is in links, all stays. Ties at the
    threshold are selected. Time and memory are linear in a page's length, however deep it nests. A map over rows:
    repeated pages keep their rows, an empty table gives none, and other columns, whatever their names, are ignored.
    """

    def run(rows):
        texts = [main_text(h) for h in rows["html"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": list(map(len, texts))}

    return map_columns(pages, run, "page_id long, url string, text string, n_chars long", ["page_id", "url", "html"])
