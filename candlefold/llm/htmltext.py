"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its path of open block elements from the root (inline elements are part of the
text around them). Per path, text length and punctuation are aggregated over its blocks: a path's value is the logarithm
of characters a block times one plus punctuation marks a block, up to a bound at which it is clearly prose. Values are smoothed over neighbouring blocks in page
order and fused, by their mean, with the value that all paths of the same parent (or of that one's parent, if it is more)
have together, so that a short heading among long paragraphs gains and a short line at the page's edge doesn't. Text in links
doesn't count as length. A path whose elements name themselves article or main gets a bounded bonus.

Paths that name themselves what is no content (menu, header, footer, sidebar, notice, advert, form, reader comments) are left
out, whatever their value; only where no other path of a page reaches the threshold are they judged too, with a malus.
Blocks of paths at or over the threshold are the content. An element that calls itself article or main, or that holds such
blocks directly, is taken whole if most of its text is content: cells, short items and captions of an article stay.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRS = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "iframe", "title", "xmp", "noembed", "noframes"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key ends an open element of the values.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE_TAGS = frozenset("nav footer aside form head button select datalist svg object canvas menu dialog label input".split())
ASIDE_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?\w*|advertisement|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|signup|share|sharing|social|related|recommend\w*|sidebar|side|widgets?|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|footer|masthead|header|comments?|commentlist|disqus|repl(?:y|ies)|respond|discussion|login|search|toolbar|skip|copyright|contentinfo|complementary|tags|byline-share)(?:$|[-_\s])",
    re.I,
)
MAIN_NAMES = re.compile(r"(?:^|\s)(?:article|article[-_]?(?:body|content|text)|post[-_]?(?:body|content|text)|entry[-_]?content|story[-_]?(?:body|text)|main[-_]?content|main|content|articlebody)(?:$|\s)", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")
_SPACE = re.compile(r"\s+")
COMMENT_NAMES = re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|disqus|repl(?:y|ies)|respond|discussion)(?:$|[-_\s])", re.I)
#: Names of page layouts and of an article's own head, which say nothing about what they hold.
LAYOUT_NAMES = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without)[-_]\S+|\b(?:article|entry|post|story|content)[-_]header\b", re.I)
#: Bonus or malus of a name, in units of ln(ratio): a factor of 3.5. Nested names that say no add up to ``LEAST``.
PRIOR, LEAST = 1.25, -3.75
#: Threshold of a path's score; where no path of a page comes ``NEAR`` over it, ``NEAR`` below the page's best, but no less than ``FLOOR``.
THRESHOLD, NEAR, FLOOR = 5.25, 0.35, 2.0
#: A path's value counts no further than this, and a punctuation mark for each so many characters at most.
FULL, CHARS_PER_MARK = 7.0, 15


def _role(tag: str, attrs: str) -> int:
    """1 for an element that calls itself main part, -1 for one that is none, -2 for reader comments, 0 otherwise; -9 for hidden ones."""
    role = 1 if tag in ("article", "main") else -1 if tag in ASIDE_TAGS else 0
    if not attrs:
        return role
    for name, value in _ATTRS.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return -9
        if tag in ("html", "body"):
            continue  # names there tell of the layout
        if name == "id" and tag in HEADINGS:
            continue  # anchors repeat the heading's words
        if name in ("class", "id", "role"):
            value = LAYOUT_NAMES.sub("", value)
            if ASIDE_NAMES.search(value):
                role = min(role, -2 if COMMENT_NAMES.search(value) else -1)
            elif role == 0 and MAIN_NAMES.search(value):
                role = 1
        elif name == "itemprop" and value.lower() == "articlebody" and role == 0:
            role = 1
    return role


class Paths:
    """Tag paths by number, 0 is the root: the parent path, the prior of each, and whether its names leave it out. Elements by number, too."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, str, int], int] = {}
        self.parent, self.prior, self.out = [0], [0.0], [False]
        #: Per element its parent element, and the nearest element around it (itself included) that calls itself main part, else 0.
        self.element_parent, self.element_main, self.element_tag = [0], [0], [""]

    def below(self, path: int, tag: str, role: int) -> int:
        number = self.number.setdefault((path, tag, role), len(self.parent))
        if number == len(self.parent):
            above = self.prior[path]
            self.parent.append(path)
            self.prior.append(-math.inf if role == -9 else PRIOR if role > 0 and above >= 0 else max(LEAST, min(above, 0.0) + role * PRIOR) if role < 0 and above > -math.inf else above)
            self.out.append(role < 0 or self.out[path] and tag != "main")
        return number

    def element(self, parent: int, tag: str, role: int) -> int:
        number = len(self.element_parent)
        self.element_parent.append(parent)
        self.element_main.append(number if role > 0 else self.element_main[parent])
        self.element_tag.append(tag)
        return number


Node = tuple[int, int, str, int, bool]


def text_nodes(page: str, paths: Paths) -> Iterator[Node]:
    """(path, block, decoded text, element, whether in a link) of each text node outside scripts and the like, in page order."""
    stack: list[tuple[str, int, int]] = [("", 0, 0)]
    open_tags: dict[str, int] = {}
    block, at = 0, 0

    def close(tag: str) -> None:
        if open_tags.get(tag):
            while True:
                top = stack.pop()[0]
                open_tags[top] -= 1
                if top == tag:
                    return

    def node(to: int) -> Iterator[Node]:
        if to > at and (text := html.unescape(page[at:to])) and not text.isspace():
            yield stack[-1][1], block, text, stack[-1][2], open_tags.get("a", 0) > 0

    find = _TOKEN.search
    pos = 0
    while m := find(page, pos):
        yield from node(m.start())
        at = pos = m.end()
        end, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            close(tag)
            block += tag in BLOCKS
            continue
        if tag in RAW:
            done = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, pos)
            at = pos = done.end() if done else len(page)
            continue
        if tag in BLOCKS:
            block += 1
            close("p")
        for other in CLOSES.get(tag, ()):
            if stack[-1][0] == other or open_tags.get(other) and stack[-1][0] not in ("ul", "ol", "table", "dl", "select"):
                close(other)
        if tag == "br":
            yield stack[-1][1], block, " ", stack[-1][2], False
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            continue
        _, path, element = stack[-1]
        role = _role(tag, attrs)
        if tag == "header" and role == 0:
            role = 0 if paths.prior[path] > 0 else -1  # an article's own header holds its headline
        if role or tag in BLOCKS:
            path = paths.below(path, tag, role)
            element = paths.element(element, tag, role)
        stack.append((tag, path, element))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    yield from node(len(page))


def _value(chars: int, marks: int, blocks: int) -> float:
    return min(FULL, math.log(max(chars, 1) / blocks * (1 + min(marks, chars / CHARS_PER_MARK) / blocks)))


def fused_values(nodes: list[Node], paths: Paths) -> dict[int, float]:
    """Each path's smoothed ratio fused with that of its parent's paths, without priors."""
    chars: dict[int, int] = {}
    marks: dict[int, int] = {}
    blocks: dict[int, int] = {}
    order: list[int] = []
    last = None
    for path, block, text, _, linked in nodes:
        if not text.isspace():
            chars[path] = chars.get(path, 0) + (0 if linked else len(_SPACE.sub("", text)))
            marks[path] = marks.get(path, 0) + len(PUNCTUATION.findall(text))
            if last != (path, block):
                order.append(path)
                blocks[path] = blocks.get(path, 0) + 1
                last = (path, block)
    value = {p: _value(chars[p], marks[p], n) for p, n in blocks.items()}
    smooth = dict.fromkeys(blocks, 0.0)
    for i, p in enumerate(order):
        near = order[max(0, i - 1) : i + 2]
        smooth[p] += (sum(value[q] for q in near) + 2 * value[p]) / (len(near) + 2) / blocks[p]
    family: dict[int, list[int]] = {}
    for p in blocks:
        family.setdefault(paths.parent[p], []).append(p)
    shared = {u: _value(sum(chars[p] for p in ps), sum(marks[p] for p in ps), sum(blocks[p] for p in ps)) for u, ps in family.items()}
    up = paths.parent
    return {p: (smooth[p] + max(shared[up[p]], shared.get(up[up[p]], 0.0))) / 2 for p in blocks}


def whole_elements(nodes: list[Node], content: set[int], paths: Paths) -> set[int]:
    """Elements to take whole: those that hold content directly or call themselves main part, if at least half of their text, what
    names leave out not counted, is content. The page's body is none. Elements below them are returned as well."""
    up, size = paths.element_parent, len(paths.element_parent)
    total, good = [0] * size, [0] * size
    holders: set[int] = set()
    for path, _, text, element, _ in nodes:
        if not paths.out[path]:
            total[element] += len(text)
            if path in content:
                good[element] += len(text)
                holders |= {up[element], paths.element_main[element]}
    for e in range(size - 1, 0, -1):  # an element's number is over its parent's
        total[up[e]] += total[e]
        good[up[e]] += good[e]
    whole = {e for e in holders if e and paths.element_tag[e] not in ("html", "body") and 2 * good[e] >= total[e]}
    for e in range(1, size):
        if up[e] in whole:
            whole.add(e)
    return whole


def main_text(page: str | None) -> str:
    """The content's blocks, white space inside each made one space, joined by newlines; empty if there is none.

    A null or empty page has none. A page whose paths name nothing is judged by the ratios alone; in an element taken whole
    that doesn't call itself main part, lines that are nothing but links stay out.
    """
    paths = Paths()
    nodes = list(text_nodes(page or "", paths))
    score = {p: v + paths.prior[p] for p, v in fused_values(nodes, paths).items()}
    named = {p: v for p, v in score.items() if not paths.out[p]}
    if max(named.values(), default=-math.inf) >= min(THRESHOLD, max(score.values(), default=0.0)):
        score = named
    least = min(THRESHOLD, max(FLOOR, max(score.values(), default=FLOOR) - NEAR))
    content = {p for p, v in score.items() if v >= least}
    whole = whole_elements(nodes, content, paths)
    prose = {block for _, block, text, _, linked in nodes if not linked and not text.isspace()}
    blocks: dict[int, list[str]] = {}
    for path, block, text, element, _ in nodes:
        inside = element in whole and not paths.out[path] and (block in prose or paths.element_main[element] in whole)
        if path in content or inside or text == " " and block in blocks:
            blocks.setdefault(block, []).append(text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, text_col: str = "html") -> DataFrame:
    """The table with the column ``main_text`` added (replaced, if there): empty for null pages and pages without content."""
    return pages.withColumn("main_text", main_text_of(F.col(f"`{text_col}`")))


def main_text_of(page: Column) -> Column:
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return F.pandas_udf(run, T.StringType())(page.cast("string"))
