"""Main text of HTML pages by two passes of rules over blocks.

A page is cut into blocks at block-level tags. Blocks in places that never hold main text (menus, footers, forms,
adverts, notices, reader comments, by tag, role, class or id) are boilerplate. A class or id counts by its head word
(user-comments, ad-slot, sidebar-left), unless it names a layout or a state of the page (with-sidebar).
A class, an id or a form may also be put on a wrapper of the page, so it excludes nothing where it holds the main part
of the page, or at least as much text in marked articles, or more likely text (sure text, beside a marked article),
than stands around it outside elements of this kind; reader comments stay out wherever there is other likely text.
The first pass decides the others by link density, length and density of stop words; where the page marks its article,
a block without links in it counts as text of the article. On a page on which no block is text by stop words and no
article is marked (its language may be another one), link density and length decide alone. Short and preformatted
blocks stay undecided and, in the second pass, inherit the label of their nearest decided neighbours.

Nulls: a null or empty html has the empty text. Tags that are never closed, comments that do not end and markup cut
off at the end of the page are read as browsers do, to the end. Drawings (svg) go with what is in them, but one that is
empty or does not end takes nothing with it; the text of formulas (math, with annotations) stays. Nothing is capped; a very long page takes time in proportion to its length. Null and repeated ids have a row for each page;
of nearest neighbours that are equally far, the one before wins. An empty table has an empty result; other columns change nothing.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters below which a block is short and from which on it is long.
SHORT, LONG = 70, 200
#: Stop words among the words of a block that is surely text, and that is probably text.
MANY_STOPS, SOME_STOPS = 0.30, 0.15
#: Characters in links from which on a block is boilerplate: anywhere, and in a marked article.
LINKED, LINKED_IN_ARTICLE = 1 / 3, 2 / 3

# Frequent function words of eight languages.
STOP_WORDS = frozenset(
    """
    the of and to in a is it that for on with as was are at be by this from or an not which but have has
    der die das und in zu den ist von mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat
    le la les de des du et en un une que qui dans est pour par sur au aux ce il elle avec plus ne pas se son
    el la los las de del y en un una que es por para con se su al lo como más pero sus no o
    il lo la gli le di del della e in un una che per con non si da sono è al come più
    o a os as de do da dos das e em um uma que não para com se por no na mais como
    de het een en van in is dat op te zijn met voor niet aan er om ook als
    och att det som en på är av för med den till inte om ett har de
    """.split()
)

# Tags and words of HTML.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split())
SPACE_TAGS = frozenset("br td th wbr img annotation annotation-xml".split())
CONTAINERS = frozenset("article aside blockquote body button details dialog div dl fieldset figure footer form head header iframe li main menu nav object ol p pre section select span table td tr ul label".split())
NEVER_TEXT = frozenset("head title nav footer aside menu dialog button select label iframe object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
NOT_MAIN_WORDS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion promoted
    nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead topbar toolbar
    cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login
    share sharing social related recommended recommendations recirculation widget widgets comment comments commentlist
    reply replies disqus respond pagination pager search copyright skip
    """.split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies disqus respond".split())
# Words that may stand beside those in a name, as in site-footer or comment-list.
PART_WORDS = frozenset("area bar block body box div form inner item items list panel section site thread".split())

# Words that may follow the one that tells what a place is (sidebar-left, ad-slot), and those that make a
# name one of a layout or of a state of the page (with-sidebar, nav-open, content-sidebar-wrap).
PLACE_WORDS = frozenset("bottom center column container desktop fixed first inline large left mobile primary right row second secondary slot small sticky third top unit wrap wrapper zone".split())
STATE_WORDS = frozenset("free has is layout no on open closed enabled page template toggle with without".split())
AROUND_WORDS = frozenset("article content entry main post story text".split())
# Words that tell it in front of any other (comment-author, related-posts), and words that page builders
# use for all parts of a page, which tell it only beside words of the lists above.
FIRST_WORDS = COMMENT_WORDS | frozenset("ad ads advert advertisement promoted recommended related sponsored".split())
BUILDER_WORDS = frozenset("widget widgets".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<raw>script|style|noscript|template|textarea|xmp|noembed|noframes)(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+[^>]*+>|\Z)
      | <(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      | <(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs2>[^>]*+)(?:>|\Z)
      | <[!?/][^>]*+(?:>|\Z)""",
    re.S | re.I | re.X,
)
_SVG_END = re.compile(r"</svg(?=[\s/>])[^>]*+>", re.I)
_ATTR = re.compile(r"""([a-zA-Z-]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]++))?""")
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_HREF = re.compile(r"(?<![\w-])href\s*=", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile(r"[\u2e80-\ua4cf\uac00-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]")


class Block(NamedTuple):
    text: str
    linked: int
    heading: bool
    #: The number of the marked article that it is in, 0 for none.
    article: int
    never: bool
    #: In preformatted text.
    code: bool = False


def not_main(tag: str, attrs: str, in_article: bool) -> str:
    """Whether an element holds no main text: "never", "wrapper" or "comments" (never, if it does not hold most of the
    page), or "". A header in an article belongs to it."""
    if tag in NEVER_TEXT or (tag == "header" and not in_article):
        return "never"
    kind = "wrapper" if tag == "form" else ""
    if not attrs or tag in ("body", "html") or tag in ("article", "main") and "comment" not in attrs.lower():
        return kind
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return "never"
        if name == "role" and value.lower() in NOT_MAIN_ROLES:
            return "never"
        if name == "role" and value.lower() == "form":
            kind = kind or "wrapper"
        if name in ("class", "id"):
            for whole in value.split():
                if found := place_named(whole):
                    kind = found if found == "comments" else kind or found
    return kind


def place_named(name: str) -> str:
    """What a class or id says of a place: "comments", "wrapper" (another place without main text), or "".

    The last word that does not only tell a part or a side is the head: it must be one of those of such places. A name
    of a layout or of a state says nothing, nor does a wrapper around the content and something beside it.
    """
    words = [x.lower() for x in _NAME.findall(name)]
    known = set(words)
    if not known & NOT_MAIN_WORDS or known & STATE_WORDS or (known & AROUND_WORDS and known & {"wrap", "wrapper", "container", "row"}):
        return ""
    head = next((x for x in reversed(words) if x not in PART_WORDS and x not in PLACE_WORDS), "")
    if words[0] not in FIRST_WORDS and (head not in NOT_MAIN_WORDS or (head in BUILDER_WORDS and not known <= NOT_MAIN_WORDS | PART_WORDS)):
        return ""
    return "comments" if known & COMMENT_WORDS else "wrapper"


class Exclusion(NamedTuple):
    """An element that holds no main text unless it is a wrapper."""

    #: The number of the exclusion around it, 0 for none.
    outer: int
    comments: bool


def kept_out(found: list[tuple[Block, int, int]], exclusions: list[Exclusion], marks: list[tuple[int, bool]]) -> list[bool]:
    """Whether each exclusion holds (number 0 is none). found: block, its exclusion, its innermost mark; marks: the
    exclusion around a marked article or main part, and whether it is a main part."""
    n = len(exclusions)
    by_stops = told_by_stops([x[0] for x in found])
    comments = [False] * n  # in reader comments
    for i in range(1, n):
        comments[i] = exclusions[i].comments or comments[exclusions[i].outer]

    # Characters of likely text in each exclusion, of sure text, and of what is in articles that are marked there; then
    # those of its own, that no inner exclusion has.
    text, sure, marked, own_text, own_marked, main = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    other = 0  # outside reader comments
    for block, exclusion, mark in found:
        kind = first_pass(block, by_stops)
        size = len(block.text) * (kind in ("good", "near"))
        if not size:
            continue
        other += size * (not comments[exclusion])
        own_text[exclusion] += size
        own_marked[exclusion] += size * (mark > 0)
        text[exclusion] += size
        sure[exclusion] += size * (kind == "good")
        where, is_main = marks[mark]
        marked[where] += size * (mark > 0)
        main[where] = main[where] or is_main
    for i in range(n - 1, 0, -1):  # inner ones come after outer ones
        outer = exclusions[i].outer
        text[outer] += text[i]
        sure[outer] += sure[i]
        marked[outer] += marked[i]
        main[outer] = main[outer] or main[i]
    out = [False]
    for i in range(1, n):
        outer = exclusions[i].outer
        if comments[i]:
            out.append(not main[i] and (other > 0 or not text[i]))
        else:
            out.append(not (main[i] or marked[i] and marked[i] >= own_marked[outer] or (sure if own_marked[outer] else text)[i] > own_text[outer]))
        own_text[i] += own_text[outer]
        own_marked[i] += own_marked[outer]
    return out


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in its order, without empty ones."""
    parts: list[str] = []
    linked, heading, articles = 0, False, 0
    links = -1  # how many containers were open where the open link began
    opened: Counter[str] = Counter()  # open containers by tag
    # Open containers: tag, never main text, article, exclusion, innermost mark.
    stack: list[tuple[str, bool, int, int, int]] = []
    found: list[tuple[Block, int, int]] = []
    exclusions, marks = [Exclusion(0, False)], [(0, False)]
    outside = ("", False, 0, 0, 0)

    def close() -> None:
        nonlocal linked, heading
        text = " ".join("".join(parts).split())
        if text:
            _, never, article, exclusion, mark = stack[-1] if stack else outside
            found.append((Block(text, min(linked, len(text)), heading, article, never, opened["pre"] > 0), exclusion, mark))
        parts.clear()
        linked, heading = 0, False

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html_module.unescape(text)
            parts.append(text)
            if links >= 0:
                linked += len(text.strip())

    at, drawings = 0, True  # drawings: whether an svg may still end
    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        ends, attrs = bool(m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or ""
        if tag == "svg" and not ends and not attrs.endswith("/") and drawings:
            end = _SVG_END.search(page, at)
            drawings = end is not None
            at = end.end() if end else at
            continue
        if tag == "a":
            links = len(stack) if not ends and _HREF.search(attrs) else -1
        if tag in SPACE_TAGS:
            parts.append(" ")
        if tag in BLOCK_TAGS:
            close()
        if tag in VOID:
            continue
        if not ends:
            _, never, article, exclusion, mark = stack[-1] if stack else outside
            mine = not_main(tag, attrs, article > 0) if tag in CONTAINERS else ""
            if tag in ("article", "main") and not mine:
                marks.append((exclusion, tag == "main"))
                mark = len(marks) - 1
                if not article:
                    articles += 1
                    article = articles
            if tag in CONTAINERS and (tag not in ("p", "span", "li", "td", "tr") or mine):
                if mine and tag not in BLOCK_TAGS:
                    close()
                if mine and mine != "never":
                    exclusions.append(Exclusion(exclusion, mine == "comments"))
                    exclusion = len(exclusions) - 1
                stack.append((tag, never or mine == "never", article, exclusion, mark))
                opened[tag] += 1
            heading = heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        elif opened[tag]:
            if tag not in BLOCK_TAGS and (stack[-1][1] or stack[-1][3]):
                close()
            last = ""
            while last != tag:
                last = stack.pop()[0]
                opened[last] -= 1
            if links > len(stack):  # a link that is not closed ends with what it began in
                links = -1
    add(page[at:])
    close()
    if len(exclusions) == 1:
        return [block for block, _, _ in found]
    out = kept_out(found, exclusions, marks)
    for i in range(1, len(out)):
        out[i] = out[i] or out[exclusions[i].outer]
    return [block._replace(never=True) if out[exclusion] else block for block, exclusion, _ in found]


def first_pass(block: Block, by_stops: bool = True) -> str:
    """good, near (probably good), short or bad."""
    size = len(block.text)
    if block.never or block.linked > size * (LINKED_IN_ARTICLE if block.article else LINKED):
        return "bad"
    if block.article:
        return "near" if size < SHORT or block.heading else "good"
    if not by_stops:
        size += 2 * len(_WIDE.findall(block.text))  # characters that are words
    if size < SHORT or block.heading or block.code:
        return "bad" if block.linked else "short"
    words = _WORD.findall(block.text.lower())
    if not by_stops:
        return "bad" if 2 * sum(map(len, words)) < len(block.text) else "good" if size > LONG else "near"
    stops = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if stops >= MANY_STOPS:
        return "good" if size > LONG else "near"
    return "near" if stops >= SOME_STOPS else "bad"


def told_by_stops(found: list[Block]) -> bool:
    """Whether the stop words fit the page: some block is text by them, or is in a marked article."""
    return any(first_pass(b) in ("good", "near") for b in found)


def labels(found: list[Block]) -> list[bool]:
    """Whether each block is main text. Where the marked articles have most of the text, blocks outside are not."""
    by_stops = told_by_stops(found)
    first = [first_pass(b, by_stops) for b in found]
    sizes = [len(b.text) * (kind in ("good", "near")) for b, kind in zip(found, first, strict=True)]
    inside = sum(n for b, n in zip(found, sizes, strict=True) if b.article)
    if inside and 2 * inside >= sum(sizes):
        first = [kind if b.article else "bad" for b, kind in zip(found, first, strict=True)]
    known = {i: kind == "good" for i, kind in enumerate(first) if kind in ("good", "bad")}

    # For each block the nearest known neighbours in the same place: (distance, good) before and after it.
    def neighbours(menus: bool) -> list[list[tuple[int, bool] | None]]:
        out: list[list[tuple[int, bool] | None]] = [[] for _ in found]
        for order in (range(len(found)), range(len(found) - 1, -1, -1)):
            seen: dict[int, int] = {}
            for i in order:
                place = found[i].article
                out[i].append((abs(i - seen[place]), known[seen[place]]) if place in seen else None)
                if i in known and (not found[i].never or (menus and not place)):
                    seen[place] = i
        return out

    # Probably text: boilerplate only between boilerplate; menus and footers stand around everything and say nothing.
    near = neighbours(False)
    known |= {i: [x and x[1] for x in near[i]] != [False, False] for i, kind in enumerate(first) if kind == "near"}
    short = neighbours(True)
    out = []
    for i in range(len(found)):
        if i in known:
            out.append(known[i])
            continue
        after = short[i][1]
        good = [x[0] for x in short[i] if x and x[1]]
        bad = [x[0] for x in short[i] if x and not x[1]]
        if not good and not bad:  # nothing on the page is decided
            out.append(True)
        else:
            out.append(bool(good) and (not bad or min(good) <= min(bad) or (found[i].heading and after is not None and after[1])))
    if not any(out):  # a page of short blocks alone, beside menus and footers
        out = [kind == "short" for kind in first]
    return out


def main_text(page: str | None) -> str:
    """The main text of a page: its good blocks, with an empty line between two."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, good in zip(found, labels(found), strict=True) if good)


def _extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of whole pages."""
    kind = pages.schema[page_id].dataType.simpleString()
    source = pages.select(F.col(page_id).alias("page"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return source.mapInArrow(_extract, f"page {kind}, url string, text string, n_chars bigint").withColumnRenamed("page", page_id)


def op2(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
