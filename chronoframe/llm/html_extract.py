"""Main text of web pages by maximum-scoring subsequence.

A page is read as a sequence of blocks and tags. The words of a block score positive where labelled pages have
main text in such a place and negative where they have none; each block-level tag scores negative, by how much denser
tags stand outside of their main text than inside. One linear
scan finds the contiguous region with the best sum, and the innermost main element that it reaches is taken as a
whole, whatever its lists of links and short ends score; blocks left out wherever they stand (asides, forms, adverts,
reader comments) cost a fixed little, as they are not part of its text. Where a class, id or role marks them so, the
mark is a weight, not a verdict: an element that holds the main element of a page (main, article, articleBody) is not
marked, and a region inside marks competes with the unmarked one at a tenth of its sum per mark (a fiftieth where
unmarked main text stands on the page), so that it wins where next to nothing stands outside of it. Labelled pages are those of the table that mark their main
text themselves (article, main, itemprop=articleBody); all of them are counted, in Spark, per kind of place.
The set of kinds is fixed, so the weights stay small.

Defined results: null or empty html, or no words, gives '' and 0; every row of the table gives one row, repeated
ones too; unclosed tags, comments and quotes run to the end of the page; extra columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A quote opens a value only after an equals sign; elsewhere, as in an unquoted value, it is a character like others.
_VALUE = r"""=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)?"""
_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|{_VALUE})*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=>/"'][^\s=>/]*)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
#: Names that mark a place as left out, and those that may stand beside them in one name (comment-list, sidebar__inner).
#: A name is a whole class, id or role token; has-sidebar or content-with-comments is none of these.
_NAMES = (
    r"ads?|advert[a-z]*|sponsor[a-z]*|promo[a-z]*|banner[a-z]*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|signup|comments?|commentlist|disqus|replies|respond|"
    r"sidebars?|side|aside|menus?|nav|navbar|navigation|breadcrumbs?|footer|masthead|siteheader|share|sharing|social|related|recommended|widget|pagination|pager|toolbar|login|search"
)
_BESIDE = r"site|header|list|items?|box|bar|area|section|wrap|wrapper|container|inner|outer|body|block|unit|slot|form|links?|buttons?|icons?|title|text|top|bottom|left|right|primary|secondary|main|global|mobile|desktop|sticky|google|posts?|entry|articles?|page|thread|div|id|js|td|wp|[0-9]+"
_MARKED = re.compile(rf"(?<!\S)(?:(?:{_BESIDE})[-_]+)*(?:(?:{_NAMES})[0-9]*|site-header)(?:[-_]+(?:{_NAMES}|{_BESIDE}))*(?!\S)", re.I)
#: Elements whose content is never text, those that end a block, those that hold others, and those left out wherever they stand.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select option".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("nav aside footer form button menu dialog search fieldset".split())
MAIN = frozenset("article main".split())
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOP = ("body", "body", 0, False, -1, -1, "")
_HOLDERS = frozenset("nav aside footer header form ul ol table".split())
_ENDS_P = BLOCK - {"body", "html"}
_BUTTON_END = re.compile(r"</button\b[^>]*>", re.I)
#: No kind of place scores more per word than this; the name under which the score of a block-level tag stands, its range
#: (so that one word in a good place outweighs the tags around it), and its score where no page is labelled.
CAP, TAG, TAG_LEAST, TAG_MOST, TAG_PLAIN = 3.0, "<tag>", -0.4, -0.05, -0.25
#: Weight of a word per mark around it, the same beside unmarked main text, how many marks are told apart, and the number that stands for left out.
MARK_WEIGHT, BESIDE_MAIN, MARKS, OUT = 0.1, 0.02, 3, 9


def _attributes(text: str) -> tuple[str, bool, bool]:
    words, main, hidden = [], False, False
    for m in _ATTR.finditer(text):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            words.append(value)
        elif name == "itemprop":
            main = main or value.lower() == "articlebody"
        elif name == "hidden" and not value:
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    words = " ".join(words)
    return words, main or "article-body" in words or words == "main", hidden


def blocks(page: str) -> list[tuple[str, str, int, int, int, int]]:
    """(text, kind of place, number of the innermost main element around it or 0, marks around it or OUT if left out, the outermost of them, block-level tags before it)."""
    out, parts, at, tags = [], [], 0, 0
    stack = []  # (tag, kind, innermost main element, left out, innermost mark, innermost mark that no main element stands before, innermost holder)
    open_tags, button_ends = Counter(), True
    marks = []  # the mark around each marked element
    holders, mains, numbers = set(), 0, 0  # marked elements that hold a main element; main elements so far, and with those left out
    top = _TOP
    in_link = words_linked = 0

    def flush():
        nonlocal tags, words_linked
        text = " ".join(htmllib.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            _, kind, main, left, mark, *_ = top
            out.append((text, kind + (":a" if 2 * words_linked > len(text) else ""), main, left, mark, tags))
            tags = 0
        words_linked = 0

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else n]
        if piece:
            parts.append(piece)
            if in_link:
                words_linked += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if tag == "head" and not end:
                    end = re.compile(r"<body\b", re.I).search(page, at)
                    at = end.start() if end else at
                else:
                    at = end.end() if end else n
                if tag == "head":
                    flush()
                elif parts:
                    parts.append(" ")
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "button" and not closing:
            end = _BUTTON_END.search(page, at) if button_ends else None
            at, button_ends = end.end() if end else at, bool(end)
            continue
        if tag not in BLOCK:
            continue
        flush()
        tags += 1
        if tag == "hr":
            continue
        if closing:
            while open_tags[tag]:
                gone = stack.pop()[0]
                open_tags[gone] -= 1
                if gone == tag:
                    break
        else:
            shut = CLOSES_ITSELF.get(tag, ())
            if stack and (stack[-1][0] in shut or stack[-1][0] == "p" and tag in _ENDS_P):
                open_tags[stack.pop()[0]] -= 1
            _, _, main, left, mark, early, holder = stack[-1] if stack else _TOP
            words, marks_main, hidden = _attributes(m[3]) if m[3] else ("", False, False)
            marked = bool(words and tag not in ("html", "body", "main") and not marks_main and _MARKED.search(words))
            if tag in MAIN or marks_main:
                numbers += 1
                main = numbers
            left = left or hidden or tag in LEFT_OUT or (tag == "header" and not main)
            if marked:
                marks.append(mark)
                mark = len(marks) - 1
                early = early if mains else mark
            elif not left and (tag in MAIN or marks_main):
                mains += 1
                held = early
                while held >= 0 and held not in holders:
                    holders.add(held)
                    held = marks[held]
            stack.append((tag, f"{holder}>{tag}" + ("!" if left else ""), main, left, mark, early, tag if tag in _HOLDERS else holder))
            open_tags[tag] += 1
        top = stack[-1] if stack else _TOP
    flush()
    depth, outer = [0] * (len(marks) + 1), [-1] * (len(marks) + 1)  # the last one, -1, is no mark
    for k, around in enumerate(marks):
        depth[k] = min(MARKS, depth[around] + (k not in holders))
        outer[k] = outer[around] if depth[around] else k if depth[k] else -1
    return [(text, kind, main, OUT if left else depth[mark], outer[mark], tags) for text, kind, main, left, mark, tags in out]


def place_counts(pages: DataFrame) -> DataFrame:
    """kind, n_main, n_other: words inside and outside the main text of pages that mark theirs, per kind of place."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                found = blocks(page or "")
                if any(b[2] for b in found):
                    for text, kind, main, left, _, tags in found:
                        side = inside if main and not left else outside
                        side[kind + ("!" if 0 < left < OUT else "")] += text.count(" ") + 1
                        side[TAG] += tags
        kinds = list(inside | outside)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.string()), "n_main": pa.array([inside[k] for k in kinds], pa.int64()), "n_other": pa.array([outside[k] for k in kinds], pa.int64())})

    counted = pages.select("html").mapInArrow(count, "kind string, n_main long, n_other long")
    return counted.groupBy("kind").agg(F.sum("n_main").alias("n_main"), F.sum("n_other").alias("n_other"))


def place_weights(pages: DataFrame) -> dict[str, float]:
    """Score of a word per kind of place and of a block-level tag: capped log odds. There are a few hundred kinds at most,
    whatever the input."""
    rows = {r.kind: (r.n_main, r.n_other) for r in place_counts(pages).collect()}
    tags = rows.pop(TAG, None)
    weights = {kind: max(-CAP, min(CAP, math.log((a + 1) / (b + 1)))) for kind, (a, b) in rows.items()}
    if tags:
        words = [sum(n[k] for n in rows.values()) for k in (0, 1)]
        weights[TAG] = max(TAG_LEAST, min(TAG_MOST, math.log((tags[0] + 1) * (words[1] + 1) / ((words[0] + 1) * (tags[1] + 1)))))
    return weights


def score_of(kind: str, weights: dict[str, float]) -> float:
    return weights.get(kind, -0.5 if kind.endswith(":a") else 0.5 if re.search(r">(li|td|body)", kind) else 1.0)


def _region(found: list[tuple[str, str, int, int, int, int]], weights: dict[str, float], marks: int) -> tuple[float, int, int]:
    """Best sum, and the region that has it, over the blocks with so many marks in one marked element; the others are left out."""
    best, span, now, start, inside = 0.0, (0, 0), 0.0, 0, -1
    tag_score = weights.get(TAG, TAG_PLAIN)
    for i, (text, kind, _, left, outer, tags) in enumerate(found):
        if now > 0:
            now += tag_score * (1 if left != marks else tags)
        if now <= 0 or left == marks and outer != inside:
            now, start = 0.0, i
        if left == marks:
            inside = outer
            now += (text.count(" ") + 1) * score_of(kind, weights)
        if now > best:
            best, span = now, (start, i + 1)
    return best, *span


def main_text(page: str, weights: dict[str, float]) -> str:
    """The blocks of the best region, without those left out wherever they stand, joined by line ends. A main element that
    the region reaches is part of it as a whole."""
    found = blocks(page)
    weight = BESIDE_MAIN if any(main and not left for _, _, main, left, _, _ in found) else MARK_WEIGHT
    regions = [(*_region(found, weights, k), k) for k in sorted({b[3] for b in found} - {OUT})]
    _, start, end, marks = max(regions, key=lambda r: r[0] * weight ** r[3], default=(0.0, 0, 0, 0))
    reached = {b[2] for b in found[start:end] if b[2] and b[3] == marks}
    whole = [i for i, b in enumerate(found) if b[2] in reached and b[3] == marks]
    if whole:
        start, end = min(start, whole[0]), max(end, whole[-1] + 1)
    return "\n".join(b[0] for b in found[start:end] if b[3] == marks)


def extract_main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text. weights: from place_weights(); learned from the pages themselves if not given."""
    learned = place_weights(pages) if weights is None else weights

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "", learned) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    pages = pages.select("page_id", "url", "html")
    return pages.mapInArrow(extract, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
