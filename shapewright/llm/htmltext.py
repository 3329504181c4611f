"""Main text of web pages by block rules in two passes.

A tokenizer walks the page once, keeps the open elements, and cuts it into blocks at block-level tags. What the contract names and no
density can tell from prose goes first: elements that the HTML standard keeps for menus, asides, footers and controls, hidden ones, and
those whose class, id or role marks adverts, notices, sidebars, comments and the like. Such a name, a form, or a header outside of a
section is void where it stands around more than half of the page's text, for then it tells of the layout (names of comments: around
all running text); html, body and main elements are never marked.

First pass, on densities alone: a block is furniture if its letters and digits are nearly all links (half of them in a long one), or if
it begins with a copyright sign; it is text if it is long, not link-dense, and dense in stop words; all others are undecided. On a page
without any such text, undecided blocks of the element that directly holds most of them are text.

Second pass: an undecided block takes the label of its nearest decided neighbour, one of the same parent element if there is any. A
heading looks at what follows it first, and what stands before a heading doesn't look beyond it. Between two of unlike labels at the
same distance a block is text only if it ends like a sentence; without any decided neighbour it is furniture.

Stop words are told by their length: words of up to three letters make up a third of running text in languages that part words by
spaces, and far less of menus, tags and lists of names; no word list is needed. Texts that don't part words have sentence marks asked for.

Defined cases: null or empty html has an empty text; broken markup never fails and costs in proportion to its length: an unclosed
element ends with its parent, an unclosed comment or script runs to the end of the page, a "<" that starts no tag is text; repeated rows
are rows; other columns stay, those with the names of added ones are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapewright.llm.common import read, text_batches

# Elements of the HTML standard.
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe object canvas audio video noembed noframes xmp".split())
#: In a formula, its source; browsers don't show it.
SOURCES = frozenset("annotation annotation-xml".split())
FURNITURE = frozenset("nav aside footer menu dialog button select fieldset label legend head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("article main section".split())
UNMARKED = frozenset("html body main".split())

#: Words in a class, id or role that mark page furniture.
MARKS = frozenset("ad ads advert advertisement advertising adsense banner billboard breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo cookie cookies copyright disqus footer gdpr login masthead menu menubar meta modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup privacy promo promoted promotion recommended related reply respond search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe tagcloud tags toolbar tooltip widget".split())
#: What such words begin or end with where they are run together.
BEGIN = ("advert", "breadcrumb", "comment", "cookie", "newsletter", "sidebar", "sponsor", "subscri")
END = ("banner", "comments", "footer", "menu", "nav", "sidebar")
#: Names that begin with such a word tell of a layout.
STATES = frozenset("has no not with without".split())
#: Words that mark lists of comments or of other articles, which may be longer than the article.
LISTS = frozenset("disqus recommended related reply respond shoutbox".split())

#: Characters of a long block, and of one of middle length.
LONG, SHORT = 120, 40
#: Shares of links beyond which a block, and a long block, is furniture; share of stop words in running text.
LINKS, LONG_LINKS, STOPS = 0.9, 0.5, 0.2
#: Letters of a stop word at most; letters of a word on average beyond which a text doesn't part words.
STOP_LETTERS, UNPARTED = 3, 12

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")
INK = re.compile(r"[^\W_]")
SENTENCE = re.compile(r"[.!?…。！？][\"'”’)»]*$")
MARK_OF_SENTENCE = re.compile(r"[.!?…。！？]")
COPYRIGHT = "©"


@dataclass
class Block:
    text: str
    heading: bool
    parent: int  # the element around the block's own
    linked: int  # letters and digits in links
    furniture: bool  # by elements
    mark: int  # the innermost marked element around it, 0: none


@dataclass
class Element:
    """An open element, with what it hands on to those inside."""

    tag: str = ""
    number: int = 0
    link: bool = False
    furniture: bool = False
    mark: int = 0
    section: bool = False
    block: int = -1  # place of the innermost block element on the stack, and its parent's number
    parent: int = 0
    heading: bool = False


def marked(attributes: str) -> tuple[bool, bool, bool]:
    """Whether names in the attributes mark furniture; or a list of other texts; whether the element is hidden."""
    if "=" not in attributes and "hidden" not in attributes:
        return False, False, False
    names = [[w.lower() for w in PIECES.findall(name)] for m in NAMES.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").split()]
    words = {w for name in names if name and name[0] not in STATES for w in name}
    marks = bool(words & MARKS) or any(w.startswith(BEGIN) or w.endswith(END) for w in words)
    return marks, marks and any(w in LISTS or w.startswith("comment") for w in words), bool(HIDDEN.search(attributes))


def blocks(page: str) -> tuple[list[Block], list[tuple[int, bool]]]:
    """The page's blocks in order, and of each marked element (from 1) the one around it and whether it lists other texts."""
    out: list[Block] = []
    marks: list[tuple[int, bool]] = [(0, False)]
    root = Element()
    stack: list[Element] = []
    places: dict[str, list[int]] = {}  # of each tag on the stack
    unclosed: set[str] = set()  # tags that are not closed in the rest of the page
    text: list[str] = []
    linked, inked, elements = 0, False, 0

    def flush() -> None:
        nonlocal linked, inked
        if inked:
            whole = SPACE.sub(" ", "".join(text)).strip()
            if whole:
                e = stack[-1] if stack else root
                out.append(Block(whole, e.heading, e.parent, linked, e.furniture, e.mark))
        text.clear()
        linked, inked = 0, False

    def put(piece: str) -> None:
        nonlocal linked, inked
        if not piece:
            return
        piece = entities.unescape(piece) if "&" in piece else piece
        text.append(piece)
        if not inked:
            inked = not piece.isspace()
        if stack and stack[-1].link:
            linked += len(INK.findall(piece))

    def close(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop().tag].pop()

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if tag in RAW:
                done = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = done.end() if done else end
                if tag not in ("noscript", "svg"):
                    flush()
                continue
            if tag in SOURCES and places.get("math") and tag not in unclosed:
                done = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)|(?=</(?:semantics|math)\b)", re.I).search(page, at)
                if done is None:
                    unclosed.add(tag)
                at = done.end() if done else at
                continue
            if tag in BLOCKS:
                flush()
                if tag != "br":
                    while stack and (stack[-1].tag == "p" or tag == "li" and stack[-1].tag == "li"):
                        close(len(stack) - 1)
            if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
                continue
            e = stack[-1] if stack else root
            elements += 1
            named, listed, hidden = marked(m[3])
            if tag in UNMARKED:
                named = listed = hidden = False
            mark = e.mark
            if named or tag == "form" or tag == "header" and not e.section:
                marks.append((mark, listed))
                mark = len(marks) - 1
            inner = Element(tag, elements, e.link or tag == "a", e.furniture or hidden or tag in FURNITURE, mark, e.section or tag in SECTIONS, e.block, e.parent, e.heading)
            if tag in BLOCKS:
                inner.block, inner.parent, inner.heading = len(stack), e.number if not stack or e.block == len(stack) - 1 else stack[e.block].number if e.block >= 0 else 0, e.heading or tag in HEADINGS
            places.setdefault(tag, []).append(len(stack))
            stack.append(inner)
        elif m[1]:
            tag = m[1].lower()
            if tag in BLOCKS:
                flush()
            depth = places.get(tag)
            if depth and (tag in BLOCKS or stack[-1].block <= depth[-1]):
                close(depth[-1])
    flush()
    return out, marks


def stopped(text: str) -> bool:
    """Whether stop words are as dense as in running text."""
    n = [len(w) for w in WORD.findall(text)]
    if not n or sum(n) > UNPARTED * len(n):
        return bool(n) and bool(MARK_OF_SENTENCE.search(text))
    return sum(k <= STOP_LETTERS for k in n) >= STOPS * len(n)


def by_density(b: Block) -> tuple[bool | None, bool]:
    """A block's label by its densities, None where undecided; and whether it is running text of middle length at least."""
    n = len(b.text)
    ink = max(len(INK.findall(b.text)), 1) if b.linked else 1
    if b.text.startswith(COPYRIGHT) or b.linked > (LONG_LINKS if n >= LONG else LINKS) * ink:
        return False, False
    running = n >= SHORT and b.linked <= LONG_LINKS / 2 * ink and stopped(b.text)
    return (True if running and n >= LONG else None), running


def furnished(found: list[Block], marks: list[tuple[int, bool]], dense: list[tuple[bool | None, bool]]) -> list[bool]:
    """Which blocks stand in furniture."""
    inside = np.zeros((len(marks), 2), np.int64)  # characters of text, and of running text
    for b, (label, running) in zip(found, dense):
        if not b.furniture and label is not False:
            inside[b.mark] += len(b.text), len(b.text) * running
    total = inside.sum(axis=0)
    for i in range(len(marks) - 1, 0, -1):  # an element is marked after the one around it
        if marks[i][0]:
            inside[marks[i][0]] += inside[i]
    holds = [False] * len(marks)
    for i in range(1, len(marks)):
        around, listed = marks[i]
        void = inside[i, 0] >= LONG and (inside[i, 1] == total[1] if listed else 2 * inside[i, 0] > total[0])
        holds[i] = holds[around] or not void
    return [b.furniture or holds[b.mark] for b in found]


def neighbours(found: list[Block], first: list[bool | None], same_parent: bool, across: bool) -> tuple[list, list]:
    """Of each block: (distance, label) of the nearest decided one before it and after it, or None; across: also beyond a heading after it."""
    before, after = [None] * len(found), [None] * len(found)
    seen: dict[int, tuple[int, bool]] = {}
    for i, b in enumerate(found):
        key = b.parent if same_parent else 0
        if key in seen:
            before[i] = (i - seen[key][0], seen[key][1])
        if first[i] is not None:
            seen[key] = (i, first[i])
    seen = {}
    for i in range(len(found) - 1, -1, -1):
        key = found[i].parent if same_parent else 0
        if key in seen:
            after[i] = (seen[key][0] - i, seen[key][1])
        if found[i].heading and not across:
            seen = {}
        elif first[i] is not None:
            seen[key] = (i, first[i])
    return before, after


def inherited(found: list[Block], first: list[bool | None]) -> list[bool]:
    """The second pass."""
    out = list(first)
    for headings in (True, False):  # labelled headings are neighbours of the rest
        beside, anywhere = neighbours(found, out, True, headings), neighbours(found, out, False, headings)
        for i, b in enumerate(found):
            if out[i] is not None or b.heading != headings:
                continue
            before, after = (beside if beside[0][i] or beside[1][i] else anywhere)
            low, high = before[i], after[i]
            if headings and high:
                low = None
            if low and high and low[0] == high[0] and low[1] != high[1]:
                out[i] = bool(SENTENCE.search(b.text))
            elif low or high:
                out[i] = min((x for x in (low, high) if x), key=lambda x: x[0])[1]
            elif not headings:
                out[i] = False
    return [bool(x) for x in out]


def labels(found: list[Block], marks: list[tuple[int, bool]]) -> list[bool]:
    """Whether each block is main text."""
    dense = [by_density(b) for b in found]
    gone = furnished(found, marks, dense)
    rest = [i for i, x in enumerate(gone) if not x]
    some, first = [found[i] for i in rest], [dense[i][0] for i in rest]
    if True not in first:  # no long running text: the element that directly holds most of what is undecided
        sums: Counter = Counter()
        for b, x in zip(some, first):
            sums[b.parent] += len(b.text) * (x is None)
        most = max(sums, key=lambda parent: sums[parent], default=None)
        first = [True if x is None and b.parent == most else x for b, x in zip(some, first)]
    out = [False] * len(found)
    for i, keep in zip(rest, inherited(some, first)):
        out[i] = keep
    return out


def main_text(page: str | None) -> str:
    found, marks = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, labels(found, marks)) if keep)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages, its html replaced by main_text."""
    own = [f for f in pages.schema.fields if f.name not in (html_col, "main_text")]
    given = [f.name for f in own]
    text_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = pa.array([main_text(v.as_py()) for v in part.column("__of")], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in given], made], [*given, "main_text"])

    return pages.select(*given, F.col(html_col).alias("__of")).mapInArrow(run, T.StructType([*own, T.StructField("main_text", T.StringType())]))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    made = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return made.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("bigint").alias("n_chars"))
