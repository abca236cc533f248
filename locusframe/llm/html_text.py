"""HTML extraction by line-block distribution.

Markup is stripped to lines, one for each block. Text lengths are summed over sliding windows of lines; the text
stands between the point where the sums surge and the point where they dive. The edges of an article, and elements that hold
menus, notices and the like where they stand between containers, count as a window of empty lines, so that they end a surge. A surge is
dropped if most of its text is links; an article that holds one is judged and kept as a whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import documents, slices

#: Lines in a window.
WINDOW = 3
#: A surge is kept if at least this share of its text is outside links, as is the one with the most such text.
UNLINKED = 0.5
#: A surge of fewer characters is a separator, if there is any other.
LEAST = 2

# Element names of HTML and usual class names.
_RAW = "script style textarea title noscript template svg math iframe object select canvas audio video head button"
_SKIPPED = "nav footer aside form menu dialog header fieldset"
_BLOCKS = (
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
)
_VOID = "area base br col embed hr img input link meta param source track wbr"
_NAMES = (
    "ad|ads|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promoted|sidebar|menu|nav|navbar|navigation|breadcrumb|breadcrumbs"
    "|masthead|footer|cookie|cookies|consent|gdpr|notice|alert|popup|modal|newsletter|related|recommended|comment|comments|disqus|respond|replies|reply|copyright"
)
#: Names that the text itself may bear: what has them is judged by its lines.
_WEAK_NAMES = "share|sharing|social|search|header|skip|toolbar|pager|pagination|login|signup|subscribe|banner"

_CONTAINERS = "body div main section table td"
_PLAIN = "html body main article p b i em strong span a"

_RAW, _SKIPPED, _BLOCKS, _VOID, _CONTAINERS, _PLAIN = (frozenset(x.split()) for x in (_RAW, _SKIPPED, _BLOCKS, _VOID, _CONTAINERS, _PLAIN))
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_UNWANTED = re.compile(rf"(?:^|[\s_-])(?:{_NAMES}|complementary|contentinfo)(?:$|[\s_-])", re.I)
_DOUBTFUL = re.compile(rf"(?:^|[\s_-])(?:{_WEAK_NAMES})(?:$|[\s_-])", re.I)
#: Tags that quotes leave without an end are looked for so often; then quotes no longer count, so hostile pages take no more than linear time.
_UNFINISHED = 8

Token = tuple[int, int, str, str, str]


def tokens_of(page: str) -> list[Token]:
    """(start, end, slash, tag, attributes) of tags, and of comments and the like without a tag. A quote that never closes doesn't hide a tag's end."""
    out: list[Token] = []
    at, unfinished, last = 0, 0, page.rfind(">")

    def after(mark: str, at: int) -> int:
        end = page.find(mark, at)
        return len(page) if end < 0 else end + len(mark)

    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            out.append((at, after("-->", at + 4), "", "", ""))
        elif page.startswith("<![CDATA[", at):
            out.append((at, after("]]>", at + 9), "", "", ""))
        elif page.startswith(("<!", "<?"), at):
            out.append((at, after(">", at), "", "", ""))
        elif (m := _OPEN.match(page, at)) and m.end() <= last:
            i = m.end()
            end = -1
            while unfinished < _UNFINISHED and (stop := _STOP.search(page, i)):
                if stop[0] == ">":
                    end = stop.end()
                    break
                close = page.find(stop[0], stop.end())
                if close < 0:
                    break
                i = close + 1
            if end < 0:
                unfinished += 1
                end = page.find(">", m.end()) + 1
            out.append((at, end, m[1], m[2].lower(), page[m.end() : end - 1]))
        else:
            at += 1
            continue
        at = out[-1][1]
    return out


def _closes(tokens: list[Token]) -> tuple[list[int], list[int]]:
    """For each token: the one that closes the element it opens, or -1; and the next one that opens a block."""
    closing, blocks = [-1] * len(tokens), [len(tokens)] * (len(tokens) + 1)
    held: dict[str, list[int]] = {}
    for i, (_, _, close, tag, attributes) in enumerate(tokens):
        if not tag or attributes.endswith("/"):
            continue
        if not close:
            held.setdefault(tag, []).append(i)
        elif held.get(tag):
            closing[held[tag].pop()] = i
    for i in range(len(tokens) - 1, -1, -1):
        blocks[i] = i if not tokens[i][2] and tokens[i][3] in _BLOCKS else blocks[i + 1]
    return closing, blocks


def _named(attributes: str, names: re.Pattern) -> bool:
    return "=" in attributes and any(names.search(a or b or c) for a, b, c in _NAMED.findall(attributes))


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _SKIPPED and not (tag == "header" and in_article):
        return True
    if tag in _PLAIN and not (tag in ("article", "p", "span") and "comment" in attributes):
        return False
    return _named(attributes, _UNWANTED)


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, characters outside links, article) for each block in page order; article is the innermost one, counted from 1, and 0 outside of any.

    An article's edge gives WINDOW empty lines, as does an unwanted element unless the text goes on in the same container. What only
    has a doubtful name is left out unless its lines hold, on average, half as much text outside links as those outside of such.
    """
    tokens = tokens_of(page)
    closing, blocks = _closes(tokens)
    out: list[tuple[str, int, int]] = []
    doubts: list[int] = []  # of each line, the outermost element with a doubtful name, or 0
    parts: list[str] = []
    article = articles = link = linked = pos = i = doubt = doubt_ends = 0
    outer: list[int] = []  # articles around the open one
    endless: set[str] = set()  # raw elements that nothing closes any more
    removed = crossed = False  # since the last text: an unwanted element, a container's edge

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            linked += len(text) if link else 0

    def flush() -> None:
        nonlocal linked, removed, crossed
        if text := " ".join(entities.unescape("".join(parts)).split()):
            if removed and crossed:
                out.extend([("", 0, 0)] * WINDOW)
                doubts.extend([0] * WINDOW)
            removed = crossed = False
            out.append((text, max(0, len(text) - linked), article))
            doubts.append(doubt)
        parts.clear()
        linked = 0

    def gap() -> None:
        flush()
        out.extend([("", 0, 0)] * WINDOW)
        doubts.extend([0] * WINDOW)

    while i < len(tokens):
        start, end, close, tag, attributes = tokens[i]
        if start < pos:
            i += 1
            continue
        add(page[pos:start])
        pos = end
        i += 1
        if not tag:
            if page.startswith("<![CDATA[", start):
                add(entities.escape(page[start + 9 : end].removesuffix("]]>")))
            continue
        if not close and tag in _RAW and not attributes.endswith("/"):
            found = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, end)
            if found:
                pos = found.end()
            else:
                endless.add(tag)
                if tag != "head":
                    pos = len(page)
            if tag in ("head", "title"):
                gap()
            continue
        if tag == "br":
            add(" ")
        elif not close and tag not in _VOID and _unwanted(tag, attributes, bool(article)):
            flush()
            removed = True
            shut = closing[i - 1]
            i = shut + 1 if shut >= 0 else blocks[i]  # an element that nothing closes ends at the next block
            pos = tokens[shut][1] if shut >= 0 else tokens[i][0] if i < len(tokens) else len(page)
        elif tag == "article" or tag == "main":
            gap()
            if tag == "article":
                if not close:
                    outer.append(article)
                    articles += 1
                    article = articles
                elif outer:
                    article = outer.pop()
        elif tag in _BLOCKS:
            flush()
            if doubt and i > doubt_ends:
                doubt = 0
            if not doubt and not close and closing[i - 1] >= 0 and tag not in _PLAIN and _named(attributes, _DOUBTFUL):
                doubt, doubt_ends = i, closing[i - 1]
            crossed = crossed or tag in _CONTAINERS
        elif tag == "a":
            link = 0 if close else 1
    add(page[pos:])
    flush()
    return _without_doubtful(out, doubts) if any(doubts) else out


def _without_doubtful(lines: list[tuple[str, int, int]], doubts: list[int]) -> list[tuple[str, int, int]]:
    sums: dict[int, list[int]] = {}
    for (text, free, _), d in zip(lines, doubts):
        if text:
            n = sums.setdefault(d, [0, 0])
            n[0] += free
            n[1] += 1
    mean = {d: free / n for d, (free, n) in sums.items()}
    return [line for line, d in zip(lines, doubts) if not d or mean.get(d, 0) >= mean.get(0, 0) / 2]


def extract(page: str | None) -> str:
    """The main text of a page: its blocks, one a line; empty for null, for pages without text and for pages of links only.

    Of surges with equally much text outside links, and of articles, all are kept that have the most.
    """
    lines = lines_of(page) if page else []
    lengths = [n for _, n, _ in lines]
    sums = [sum(lengths[max(0, i - WINDOW + 1) : i + 1]) for i in range(len(lengths))]
    surges: list[tuple[int, int]] = []
    begin = None
    for i, total in enumerate([*sums, 0]):
        if total and begin is None:
            begin = i
        elif not total and begin is not None:
            surges.append((begin, i))
            begin = None
    if not surges:
        return ""
    # a surge lies in one article or outside of all; the surges of an article are judged together, and it is kept whole
    groups: dict[tuple[int, int], list[int]] = {}
    for a, b in surges:
        if not (article := lines[a][2]):
            groups[0, a] = list(range(a, b))
        elif (article, 0) not in groups:
            groups[article, 0] = [i for i, line in enumerate(lines) if line[2] == article]
    most = max(sum(lengths[i] for i in g) for g in groups.values())

    def kept(group: list[int]) -> bool:
        total, free = sum(len(lines[i][0]) for i in group), sum(lengths[i] for i in group)
        return free == most or (total >= LEAST and free >= UNLINKED * total)

    return "\n".join(lines[i][0] for i in sorted(i for g in groups.values() if kept(g) for i in g) if lines[i][0])


def extract_text(pages: DataFrame) -> DataFrame:
    """pages (html, others) with text and n_chars instead of html.

    Null, empty and textless html gives an empty text. Whole pages are read, however long; repeated rows give repeated
    results. Of columns of pages with the results' names the results replace them.
    """
    kept = pages.select(*(c for c in pages.columns if c not in ("html", "text", "n_chars")), "html")
    names = kept.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [extract(h.as_py()) for h in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "html"), "text string, n_chars long"]))


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(documents(spark, sf_dir, "pages").select("page_id", "url", F.col("html")))


QUERIES = {"op7_html_extraction": op7_html_extraction}
ORACLES: dict[str, str] = {}
