"""Main text of web pages by tag-path ratios.

Every text node hangs at the end of a path of block elements. For each path of a page the
text outside links and the punctuation are summed over its nodes; their ratios (per node of
the path) are smoothed over the neighbouring nodes in page order, the more the fewer steps
lie between two paths, and fused by their product. Paths whose fused ratio passes a threshold
are content.

Tags without text of their own (scripts, forms' fields, nav, footer and the like) are no
candidates. What else a page says about itself are weights on the ratios: names that tell of
furniture and a place outside the article weigh the less the higher the page's best ratio
is, that is the more the ratios can tell;
names of reader comments always count, as comments have the ratios of an article.
What the ratios choose brings its own along: blocks that are no link lists and stand beside
content, be it in a section, a header of the article or plain containers of their own, and the
headings of what is kept. Inline elements that a name calls an advert lose their text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import quoted, schema_with

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK_LEAVES = HEADINGS | frozenset("p li blockquote pre td th dt dd figcaption caption".split())
NESTED = frozenset("ul ol dl table thead tbody tfoot tr blockquote figure li td".split())
#: Elements that part a text without being something else, as are containers without a name.
PARTS = NESTED | frozenset("section header hgroup".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
CLOSED_BY_SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body html article section main div td th nav aside form".split())
#: Elements that are never main text, and words of a class, id or role that tell of furniture or of readers' comments.
FURNITURE = frozenset("nav footer aside button select menu dialog svg object canvas head script style".split())
FURNITURE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|rail|widget\w*|footer\w*|header|masthead|topbar|toolbar|"
    r"notices?|cookie\w*|consent|gdpr|alert|popup|modal|overlay|disclaimer|"
    r"share\w*|sharing|social\w*|related\w*|recommend\w*|newsletter\w*|subscribe\w*|signup|login|search\w*|pagination|pager|skip|copyright|legal|navigation|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
#: Names of inline elements whose text is an advert.
ADVERT_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor(?:ed)?)(?:$|[\s_-])", re.I)
COMMENT_WORDS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|comment\w*|disqus\w*|replies|reply|respond|discussion)(?:$|[\s_-])", re.I)
#: Weight of a path for each element around it that a name calls furniture or comments, and of one outside the article.
LIGHT = 0.02
#: Fused ratio of the page's best path at which names of furniture have half of their say (as a power).
EVIDENCE = 600.0
#: What a step between two paths leaves of the smoothing between their nodes.
STEP = 1 / 16
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？।-]")


@dataclass(frozen=True)
class Block:
    """A text node: the path of its elements and their numbers, the text, its characters inside links, and what is said of it."""

    path: tuple[str, ...]
    numbers: tuple[int, ...]
    dropped: bool  # by a tag
    furniture: int  # names that call it so
    comment: int
    text: str
    linked: int


def _blocks(html: str) -> list[Block]:
    """Each block with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, str, bool, int, int]] = []  # tag, number of the element, label, dropped, furniture and comment names
    held: list[str] = []
    number = linked = 0
    link_from: int | None = None  # how many pieces were held when a link began
    advert: list[int | str] = []  # the tag of an inline advert, and how many of that tag are open

    def flush() -> None:
        nonlocal linked, link_from
        if held:
            if link_from is not None:
                linked += sum(map(len, held[link_from:]))
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                dropped, furniture, comment = stack[-1][3:] if stack else (False, 0, 0)
                out.append(Block(tuple(x[2] for x in stack), tuple(x[1] for x in stack), dropped, furniture, comment, text, min(linked, len(text))))
        linked, link_from = 0, None if link_from is None else 0

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            held += [] if advert else [html[at:]]
            break
        if m.start() > at and not advert:
            held.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if advert:
            if tag == advert[0]:
                advert[1] += -1 if m[1] else 1
                if advert[1] == 0:
                    advert.clear()
                continue
            if tag in INLINE or tag in VOID:
                continue
            advert.clear()  # never closed within its block
        elif tag in INLINE and not m[1] and m[3] and ADVERT_WORDS.search(" ".join(filter(None, (g for x in _NAMES.findall(m[3]) for g in x)))):
            advert += [tag, 1]
            held.append(" ")
            continue
        if tag == "a":
            if link_from is not None:
                linked += sum(map(len, held[link_from:]))
            link_from = None if m[1] else len(held)
            continue
        if m[1]:
            if tag in INLINE or tag in VOID:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    flush()
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            shut = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = shut.end() if shut else end
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in INLINE or tag in VOID and tag != "hr":
            continue
        flush()
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES:
                    break
        for same in CLOSED_BY_SAME.get(tag, ()):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == same:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES - {"td", "th"}:
                    break
        if tag in HEADINGS and stack and stack[-1][0] in HEADINGS:
            stack.pop()
        if tag == "hr" or m[3].endswith("/") and tag not in CLOSES_P:
            continue
        number += 1
        names = " ".join(filter(None, (g for x in _NAMES.findall(m[3]) for g in x))) if m[3] else ""
        inside = any(x[0] in ("article", "main") for x in stack)
        dropped, furniture, comment = stack[-1][3:] if stack else (False, 0, 0)
        if names and tag not in ("html", "body", "main"):
            comment += bool(COMMENT_WORDS.search(names))
            furniture += bool(FURNITURE_WORDS.search(names))
        furniture += tag == "form"
        dropped = dropped or tag in FURNITURE or tag == "header" and not inside
        stack.append((tag, number, f"{tag}.{'.'.join(names.lower().split())}" if names else tag, dropped, furniture, comment))
    flush()
    return out


def _steps(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """Elements of both paths beyond where they part, pairs of elements counting once."""
    shared = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return max(len(a), len(b)) - shared


def _smoothed(ratio: np.ndarray, paths: list[tuple[str, ...]], radius: int = 1) -> np.ndarray:
    """Gaussian smoothing over neighbouring nodes, each step between their paths leaving STEP of it; the ends use what there is."""
    top, base = ratio.astype(np.float64), np.ones(len(ratio))
    for d in range(1, radius + 1):
        near = np.array([math.exp(-0.5 * (d / radius) ** 2) * STEP ** _steps(x, y) for x, y in zip(paths, paths[d:])])
        top[d:] += near * ratio[:-d][: len(near)]
        base[d:] += near
        top[: len(near)] += near * ratio[d:]
        base[: len(near)] += near
    return top / base


def main_text(html: str, share: float = 0.15) -> str:
    """The page's main text, a line per block; "" if it has none."""
    nodes = [b for b in _blocks(html) if not b.dropped]
    if not nodes:
        return ""
    tags = [[x.partition(".")[0] for x in b.path] for b in nodes]
    # a heading goes by the next block that is none and stands in the same element
    of = list(range(len(nodes)))
    follows: dict[int, int] = {}
    for i in range(len(nodes) - 1, -1, -1):
        parent = nodes[i].numbers[-2] if len(nodes[i].numbers) > 1 else 0
        if tags[i] and tags[i][-1] in HEADINGS:
            of[i] = follows.get(parent, i)
        else:
            for number in nodes[i].numbers[:-1] or (0,):
                follows[number] = i
    paths: dict[tuple[str, ...], list[int]] = {}
    for i, b in enumerate(nodes):
        if of[i] == i:
            paths.setdefault(b.path, []).append(i)
    own = np.concatenate([np.array(x) for x in paths.values()])
    own.sort()
    lengths = np.array([len(b.text) - b.linked for b in nodes], np.float64)
    marks = np.array([1 + len(PUNCTUATION.findall(b.text)) * (1 - b.linked / len(b.text)) for b in nodes])
    length_ratio, mark_ratio = np.zeros(len(nodes)), np.zeros(len(nodes))
    for at in paths.values():
        length_ratio[at] = lengths[at].sum() / len(at)
        mark_ratio[at] = marks[at].sum() / len(at)
    in_order = [nodes[i].path for i in own]
    fused = np.zeros(len(nodes))
    fused[own] = _smoothed(length_ratio[own], in_order) * _smoothed(mark_ratio[own], in_order)
    score = {path: float(fused[at].mean()) for path, at in paths.items()}
    within = np.array([any(x in ("article", "main") for x in t) for t in tags])
    named = np.array([b.furniture for b in nodes], np.float64)
    voices = np.array([b.comment for b in nodes], np.float64)
    # an article tells where the text is only if it holds most of what no name calls furniture
    mine = lengths * LIGHT ** (named + voices)
    if mine[within].sum() * 2 >= mine.sum():
        named[~within] += 1
    light = LIGHT ** (1 / (1 + (max(score.values()) / EVIDENCE) ** 2))
    weight = light**named * LIGHT**voices
    ranked = {path: s * float(weight[paths[path]].max()) for path, s in score.items()}
    most = max(ranked.values())
    content = {path for path, s in ranked.items() if s >= share * most}
    plain = min(named[at].min() + voices[at].min() for path, at in paths.items() if path in content)
    # the elements that hold content blocks directly
    holders = set()
    for b, t in zip(nodes, tags):
        if b.path in content:
            holders.add(b.numbers[-2] if len(b.numbers) > 1 and t[-1] in BLOCK_LEAVES else b.numbers[-1] if b.numbers else 0)
    # and the elements whose sections do
    sectioned = {b.numbers[k - 1] for b, t in zip(nodes, tags) if b.path in content for k in range(1, len(t)) if t[k] == "section"}

    def beside(i: int) -> bool:
        """Whether a block stands among content and is no link list."""
        b, t = nodes[i], tags[i]
        if 2 * b.linked > len(b.text) or named[i] + voices[i] != plain:
            return False
        for k in range(len(t) - 2, -1, -1):
            if b.numbers[k] in holders:
                return t[k] not in ("html", "body") or t[-1] in BLOCK_LEAVES and all(x in NESTED for x in t[k + 1 : -1])
            if b.numbers[k] in sectioned and t[k + 1] == "section":
                return True
            if t[k] not in PARTS and b.path[k] != "div":
                return False
        return False

    headed = [bool(t) and t[-1] in HEADINGS for t in tags]
    kept = [not h and (b.path in content or beside(i)) for i, (b, h) in enumerate(zip(nodes, headed))]
    introduced = _introduced(nodes, tags, headed, kept)
    return "\n".join(b.text for i, b in enumerate(nodes) if kept[i] or headed[i] and (introduced[i] or of[i] == i and b.path in content))


def _introduced(nodes: list[Block], tags: list[list[str]], headed: list[bool], kept: list[bool]) -> list[bool]:
    """Whether each block is a heading with a kept block after it, in the element around it (the article's, for one in its header) and before the next heading of its rank or a higher one."""
    end: dict[int, int] = {}  # the last block within each element
    for i, b in enumerate(nodes):
        for number in b.numbers:
            end[number] = i
    out = [False] * len(nodes)
    ranks = [len(nodes)] * 7  # the next heading of each rank
    following = len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        if headed[i]:
            k = len(tags[i]) - 2
            while k > 0 and (tags[i][k] in ("header", "hgroup") or tags[i][k] == "div" and nodes[i].numbers[k] not in (nodes[i - 1].numbers if i else ()) and end[nodes[i].numbers[k]] == i):
                k -= 1
            last = end[nodes[i].numbers[k]] if k >= 0 else len(nodes) - 1
            rank = int(tags[i][-1][1])
            out[i] = following <= last and following < min(ranks[1 : rank + 1])
            ranks[rank] = i
        elif kept[i]:
            following = i
    return out


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", share: float = 0.15) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    A null, empty or textless page gives "". Repeated pages give equal rows, ties of ratios are
    all content, pages of any length are read whole. The input's other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", share) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    slim = pages.select(quoted(key).alias("page_id"), quoted(url).cast("string").alias("url"), F.coalesce(quoted(html).cast("string"), F.lit("")).alias("html"))
    out = slim.mapInArrow(run, schema_with(slim, "page_id", "url string, text string"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
