"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A linear classifier over a block's words, its links and what its
ancestors are gives the costs of calling it content or boilerplate; these are the capacities from the
source and to the sink. Edges between neighbouring blocks, stronger the closer they stand in the document
tree, are the price of labelling them differently. The minimum cut is the cheapest labelling as a whole.

Names of classes are hints. A name counts by its last telling word (``legal-analysis`` is an analysis,
``no-sidebar`` says what is not there), its weight is that of a paragraph of a few dozen words, and an
element that is mostly the page's article is not what its name or tag says (a form around the whole page).
Reader comments are never the article, however long.

A page is one row and is never split; the graph has at most two inner edges for each block and is solved
where the page is read, so there is no shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.columns import trimmed
from lexweave.session import table

#: Elements that begin and end blocks.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; all but the last two are dropped with it.
RAW = frozenset("script style title textarea iframe noembed noframes noscript template svg math object audio video canvas xmp plaintext".split())
KEPT_RAW = frozenset(("xmp", "plaintext"))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": (), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table select article section div body main".split())
#: What elements are worth to the classifier, in units of the price of one step between neighbours.
TAGS = {"nav": -8.0, "footer": -8.0, "aside": -8.0, "menu": -8.0, "dialog": -8.0, "search": -8.0, "button": -8.0, "select": -8.0, "option": -8.0, "head": -20.0, "form": -5.0, "fieldset": -3.0, "label": -3.0}
ROLES = {x: -6.0 for x in "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split()}
NAME, PAGE_HEADER, HIDDEN, GOOD = -5.0, -4.0, -20.0, 4.0
GOOD_TAGS = frozenset(("article", "main"))
GOOD_WORDS = frozenset("article main story post entry".split())
BAD_WORDS = frozenset(
    "ad ads adsense adslot advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs consent cookie cookies copyright"
    " footer gdpr legal links login masthead menu modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination paging"
    " paywall popup promo promos promotion promotions promoted rail recommended recommendations register related search share sharing sidebar signin signup skip"
    " social sponsor sponsors sponsored subscribe subscription toolbar topbar".split()
)
COMMENTS = frozenset("comment comments commentlist commenters discussion disqus feedback reactions replies reply respond response responses".split())
#: Bad also in front of other words: related-stories, cookie-policy.
LEADING = frozenset("comment comments cookie footer nav newsletter promoted recommended related sidebar sponsored".split())
#: Words that tell nothing: what is left of a name without them counts.
PLAIN = frozenset("area bar block body box col column container content group holder inner item items label layout list outer pane panel placeholder region row section slot text title unit widget widgets wrap wrapper".split())
STATES = frozenset("no non not has have with without is hide show js".split())
BIAS, W_LENGTH, W_LINKS = -0.4, 0.8, -6.0
#: An element is mostly article if good elements hold this share of its unlinked text, and of the page's; on a page without good elements, if it holds most of the text.
OF_ELEMENT, OF_PAGE, MOST_OF_PAGE = 0.5, 0.4, 0.7
#: ACROSS: share of the price that is left where an element such as a sidebar begins or ends.
NEAR, SIBLING, ACROSS = 1.0, 1.5, 0.2

TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z))", re.DOTALL)
NAMED = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)


WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


@dataclass
class Element:
    parent: int
    weight: float = 0.0
    firm: bool = False  # whatever it holds
    good: bool = False
    chars: int = 0  # unlinked, of all blocks inside
    article: int = 0  # those in good elements inside


@dataclass
class Block:
    home: int  # element
    over: int  # element around it
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    chars: int = 0
    text: str = ""
    score: float = 0.0
    bad: bool = False


def judged(name: str) -> tuple[float, bool, bool]:
    """(weight, whether it stands whatever it holds, whether it is good) of a class name or id."""
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or words[0] in STATES:
        return 0.0, False, False
    telling = [w for w in words if w not in PLAIN] or [w for w in words if w == "content"]
    if not telling:
        return 0.0, False, False
    if telling[-1] in COMMENTS or (words[0] in COMMENTS and words[0] in LEADING):
        return 2 * NAME, True, False
    if telling[-1] in BAD_WORDS or words[0] in LEADING:
        return NAME, False, False
    if telling[-1] == "header":
        return PAGE_HEADER, False, False
    return 0.0, False, telling[-1] in GOOD_WORDS or telling == ["content"]


def element(tag: str, attrs: str, parent: int, inside_good: bool) -> Element:
    out = Element(parent, TAGS.get(tag, 0.0), tag in ("nav", "head"), tag in GOOD_TAGS)
    if tag == "header":
        out.weight = PAGE_HEADER
    for name, a, b, c in NAMED.findall(attrs) if attrs else ():
        value, name = a or b or c, name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            out.weight, out.firm = HIDDEN, True
        elif name == "role":
            out.weight = min(out.weight, ROLES.get(value.lower(), 0.0))
            out.good |= value.lower() in ("main", "article")
        elif tag not in ("html", "body"):
            for x in value.split():
                weight, firm, good = judged(x)
                out.weight, out.firm, out.good = min(out.weight, weight), out.firm or firm, out.good or good
    if inside_good and out.weight == PAGE_HEADER:  # holds the headline there
        out.weight = 0.0
    out.good &= out.weight == 0.0
    return out


@dataclass
class _Open:
    tag: str
    n: int  # element
    home: int  # nearest element that is a block, and the one around it
    over: int
    good: bool
    link: bool


def parsed(page: str) -> tuple[list[Block], list[Element]]:
    """The non-empty text blocks of a page in order, and its elements."""
    blocks: list[Block] = []
    elements = [Element(-1)]
    stack = [_Open("", 0, 0, 0, False, False)]
    now: Block | None = None
    at = 0

    def say(text: str) -> None:
        nonlocal now
        if not text:
            return
        top = stack[-1]
        if now is None:
            if text.isspace():
                return
            now = Block(top.n, top.over)
            blocks.append(now)
        text = html.unescape(text)
        now.parts.append(text)
        n = len(text.strip())
        if top.link:
            now.linked += n
        if n and not now.chars:  # a block is where its first words are
            now.home = top.n
        now.chars += n

    while m := TAG.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        tag = tag.lower()
        if closing:
            if tag in BLOCK:
                now = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break  # an inline element does not end outside its block
            continue
        if tag in RAW:
            end = ENDS[tag].search(page, at)
            if tag in KEPT_RAW:
                say(page[at : end.start() if end else len(page)])
            if not attrs.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea", "iframe"):
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK:
            now = None
            for i in range(len(stack) - 1, 0, -1):  # an open paragraph ends here
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES:
                    break
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES.get(tag, ()):
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES:
                    break
        if tag in VOID:
            continue
        top, n = stack[-1], len(elements)
        new = element(tag, attrs, top.n, top.good)
        elements.append(new)
        home, over = (n, top.home) if tag in BLOCK else (top.home, top.over)
        stack.append(_Open(tag, n, home, over, top.good or new.good, top.link or tag == "a"))
    say(page[at:])
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
        b.parts.clear()
    return [b for b in blocks if b.text], elements


ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE) for tag in RAW}


def weigh(blocks: list[Block], elements: list[Element]) -> None:
    """Scores of the blocks, above 0 for content."""
    inside = [False] * len(elements)  # a good element that is not inside boilerplate
    for i, e in enumerate(elements[1:], 1):
        inside[i] = e.weight == 0.0 and (e.good or inside[e.parent])
    for b in blocks:
        elements[b.home].chars += b.chars - b.linked
        if inside[b.home]:
            elements[b.home].article += b.chars - b.linked
    for e in reversed(elements[1:]):
        up = elements[e.parent]
        up.chars += e.chars
        up.article += e.article
    least = OF_PAGE * elements[0].chars
    weight, good = [0.0] * len(elements), [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        own = e.weight
        if own and not e.firm and (e.article >= max(least, OF_ELEMENT * e.chars, 1) or (own > -8 and not elements[0].article and e.chars >= MOST_OF_PAGE * elements[0].chars)):
            own = 0.0
        weight[i] = min(weight[e.parent], own)
        good[i] = own == 0.0 and (e.good or good[e.parent])
    for b in blocks:
        b.bad = weight[b.home] < 0
        b.score = BIAS + W_LENGTH * math.log1p(len(b.text.split())) + W_LINKS * (b.linked / max(1, b.chars)) + weight[b.home] + GOOD * good[b.home]


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) of the cheapest cut.

    ``scores``: capacity from the source less capacity to the sink. What neighbours can settle among
    themselves is pushed first; then shortest augmenting paths, all of one length at a time. Nodes that the
    last search reaches from the source are its side.
    """
    n, least = len(scores), 1e-9
    spare = [max(0.0, s) for s in scores]
    need = [max(0.0, -s) for s in scores]
    links: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []
    for a, b, w in edges:
        links[a].append(len(to))
        links[b].append(len(to) + 1)
        to += [b, a]
        cap += [w, w]
        for e, i, j in ((len(to) - 2, a, b), (len(to) - 1, b, a)):
            if spare[i] > 0 and need[j] > 0:
                flow = min(spare[i], need[j], cap[e])
                spare[i] -= flow
                need[j] -= flow
                cap[e] -= flow
                cap[e ^ 1] += flow
    while True:
        level = [-1] * n
        front = [i for i in range(n) if spare[i] > least]
        for i in front:
            level[i] = 0
        depth, met = 0, False
        while front and not met:
            depth += 1
            reached = []
            for i in front:
                for e in links[i]:
                    j = to[e]
                    if level[j] < 0 and cap[e] > least:
                        level[j] = depth
                        reached.append(j)
                        met = met or need[j] > least
            front = reached
        if not met:
            return [x >= 0 for x in level]
        # all paths of ``depth`` steps, walked back from where they end
        tried = [0] * n
        for end in front:
            while need[end] > least:
                path, i = [], end
                while level[i]:
                    while tried[i] < len(links[i]):
                        e = links[i][tried[i]] ^ 1  # towards i
                        if cap[e] > least and level[to[e ^ 1]] == level[i] - 1:
                            break
                        tried[i] += 1
                    else:
                        if not path:
                            break
                        tried[i], i = len(links[i]), to[path[-1]]
                        path.pop()
                        tried[i] += 1
                        continue
                    path.append(e)
                    i = to[e ^ 1]
                else:
                    flow = min([spare[i], need[end], *(cap[e] for e in path)])
                    if flow > least:
                        spare[i] -= flow
                        need[end] -= flow
                        for e in path:
                            cap[e] -= flow
                            cap[e ^ 1] += flow
                    if spare[i] <= least:  # no path begins here any more
                        level[i] = -2
                    continue
                break


def label(blocks: list[Block]) -> list[bool]:
    """Whether each block is content."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        before = last.get(b.over)
        if i:
            edges.append((i - 1, i, (NEAR + (SIBLING if before == i - 1 else 0.0)) * (1.0 if blocks[i - 1].bad == b.bad else ACROSS)))
        if before is not None and before < i - 1:
            edges.append((before, i, SIBLING * (1.0 if blocks[before].bad == b.bad else ACROSS)))
        last[b.over] = i
    return minimum_cut([b.score for b in blocks], edges)


def main_text(page: str | None) -> str:
    blocks, elements = parsed(page or "")
    weigh(blocks, elements)
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks), strict=True) if keep)


@trimmed
def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py()) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages`` (``page_id, url, html``).

    A null or empty page, and one of boilerplate only, has an empty text. Repeated rows and null ids each
    give a row. Other columns are not read. An empty table gives an empty result.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(_text_batches, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
