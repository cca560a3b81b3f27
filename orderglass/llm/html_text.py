"""Main text of web pages by tag-path ratios.

The text of a page is cut into blocks, each with its root-to-leaf path of tags. Text length, punctuation and
link text are added up per path. A path's ratio is its text and punctuation per block, less the share in
links; ratios are smoothed over neighbouring blocks, fused with those of the path's container, and paths above
a threshold are content. What a page marks as menu, header, footer, sidebar, notice, advert, form or comment by
its tag, its role or a whole class or id has ratio 0; names that also stand for wrappers of whole articles (promo,
modal, search ...) are overruled where the element holds most of the page's unlinked text. Words within longer classes and ids
only weight the ratio, as do article and main; the threshold decides inside and outside of them alike.

Defined cases: a null or empty page has empty text; tags that are never closed end with their container;
repeated rows give the same text; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderglass.llm.common import table

#: Outside quotes a tag ends at the next ``>`` or is none: a tag that never ends is not searched to the end of the page.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、¿¡]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template textarea iframe object svg math select option title canvas audio video".split())
#: ASCII case only, on the page itself: lower-casing a text can change its length.
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in SKIPPED}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOT_CONTENT = frozenset("nav footer aside form button fieldset dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOT_CONTENT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar "
    "navigation menu menus breadcrumb breadcrumbs header masthead topbar footer foot bottombar sidebar aside rail widget widgets "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup signin login "
    "register comment comments disqus respond reply replies discussion share sharing social related recommended "
    "pagination pager copyright legal search form toolbar skip hidden tags tagcloud".split()
)
#: Of these, names that also wrap whole articles: what holds most of a page's unlinked text is not excluded by them.
WRAPPER_NAMES = frozenset("legal promo promotion banner modal overlay search form widget popup notice toolbar rail social share related".split())
WRAPPER_SHARE = 0.75
CONTENT_NAMES = frozenset("article content main post entry story body text".split())
#: Classes that say how a page is laid out (has-sidebar, no-header), not what an element is.
_LAYOUT = re.compile(r"(?:has|no|not|with|without)[-_]", re.I)
#: Weights of what lies in article or main, below a content name, and below a name of something else.
MARKED, NAMED, SHUNNED = 3.0, 1.5, 0.1
#: Tags that a tag of the same kind, or a block in general, closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_OPEN = frozenset("ul ol dl table div section article main body html blockquote td th aside nav header footer form".split())
THRESHOLD = 0.12
SPREAD = (0.25, 0.5, 0.25)


class _Open:
    """An open tag: its path and what it says about its text. A path is a number, by its container's and its last step."""

    __slots__ = ("name", "path", "bad", "marked", "named", "shunned", "link", "doubts")

    def __init__(self, name: str, attributes: str, above: _Open | None, paths: dict[tuple[int, str], int]) -> None:
        found = {a.lower(): x or y or z or "" for a, x, y, z in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        tokens = f"{found.get('class', '')} {found.get('id', '')}".split()
        names = [{w.lower() for w in _NAME.findall(t)} for t in tokens if not _LAYOUT.match(t)]
        words = {w.lower() for t in tokens for w in _NAME.findall(t)}
        in_article = above is not None and (above.marked or above.named)
        bad = name in NOT_CONTENT or found.get("role", "").lower() in ROLES or "hidden" in found
        bad = bad or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        bad = bad or (name == "header" and not in_article)
        other = doubted = False
        if name not in ("html", "body", "article", "main") and name not in HEADINGS:
            excluding = {t.lower() for t in tokens} & NOT_CONTENT_NAMES
            bad = bad or bool(excluding - WRAPPER_NAMES)
            doubted = bool(excluding)
            other = any(n & NOT_CONTENT_NAMES for n in names) and not excluding
        content = any(n & CONTENT_NAMES and not n & NOT_CONTENT_NAMES for n in names)
        step = name + (f".{'.'.join(sorted(words))}" if words else "")
        self.name, self.path = name, paths.setdefault((above.path if above else 0, step), len(paths) + 1)
        self.bad = bad or (above is not None and above.bad)
        self.marked = name in ("article", "main") or (above is not None and above.marked)
        self.named = content and not other or (above is not None and above.named)
        self.shunned = other and not content or (above is not None and above.shunned)
        self.link = name == "a" or (above is not None and above.link)
        # The doubted elements around this one, itself first.
        outer = above.doubts if above else None
        self.doubts = (object(), outer) if doubted and not self.bad else outer

    def weight(self) -> float:
        return (MARKED if self.marked else NAMED if self.named else 1.0) * (SHUNNED if self.shunned else 1.0)


class _Block:
    __slots__ = ("path", "parts", "linked", "bad", "weight", "text", "doubts")

    def __init__(self, path: int, bad: bool, weight: float, doubts: tuple | None) -> None:
        self.path, self.parts, self.linked = path, [], 0
        self.bad, self.weight, self.text, self.doubts = bad, weight, "", doubts


def _blocks(html: str) -> tuple[list[_Block], dict[int, int]]:
    """Blocks of text in page order, and the container of each path."""
    paths: dict[tuple[int, str], int] = {}
    stack: list[_Open] = []
    blocks: list[_Block] = []
    now: _Block | None = None
    at, size = 0, len(html)
    opened: Counter[str] = Counter()

    def close(depth: int) -> None:
        opened.subtract(x.name for x in stack[depth:])
        del stack[depth:]

    def add(raw: str) -> None:
        nonlocal now
        top = stack[-1] if stack else None
        if now is None or bool(top and top.bad) != now.bad or (top.doubts if top else None) is not now.doubts:
            if not raw.strip():
                return
            depth = len(stack)
            while depth and stack[depth - 1].name in INLINE:
                depth -= 1
            holder = stack[depth - 1] if depth else None
            now = _Block(holder.path if holder else 0, bool(top and top.bad), holder.weight() if holder else 1.0, top.doubts if top else None)
            blocks.append(now)
        now.parts.append(raw)
        if top and top.link:
            now.linked += len(raw)

    while at < size:
        tag = _TAG.search(html, at)
        if tag is None:
            add(html[at:])
            break
        if tag.start() > at:
            add(html[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name == "br":
            if now is not None:
                now.parts.append("\n")
            continue
        if tag[1]:  # a closing tag ends everything that it holds
            depth = len(stack) - 1 if opened[name] > 0 else -1
            while depth >= 0 and stack[depth].name != name and not (name in INLINE and stack[depth].name not in INLINE):
                depth -= 1
            if depth >= 0 and stack[depth].name == name:
                close(depth)
            if name not in INLINE:
                now = None
            continue
        if name in SKIPPED:
            if not (tag[3] or "").endswith("/"):
                end = _ENDS[name].search(html, at)
                at = end.start() if end else size
            if name not in INLINE:
                now = None
            continue
        if name not in INLINE:
            now = None
            closes = CLOSES.get(name, set()) | {"p"} | (HEADINGS if name in HEADINGS else set())
            depth = len(stack) - 1
            while depth >= 0 and stack[depth].name not in KEEPS_OPEN | closes:
                depth -= 1
            if depth >= 0 and stack[depth].name in closes:
                close(depth)
            if name in ("td", "th", "tr") and stack and stack[-1].name in CLOSES[name]:
                close(len(stack) - 1)
        if name not in VOID:
            stack.append(_Open(name, tag[3], stack[-1] if stack else None, paths))
            opened[name] += 1
    for block in blocks:
        block.text = " ".join(unescape("".join(block.parts)).split())
    _settle_doubts(blocks)
    return [b for b in blocks if b.text], {path: above for (above, _), path in paths.items()}


def _settle_doubts(blocks: list[_Block]) -> None:
    """Excludes the text of doubted elements, but for those that hold most of the page's unlinked text."""
    held: dict[int, int] = defaultdict(int)
    total = 0
    for block in blocks:
        unlinked = 0 if block.bad else max(0, len(block.text) - block.linked)
        total += unlinked
        doubts = block.doubts
        while doubts:
            held[id(doubts)] += unlinked
            doubts = doubts[1]
    for block in blocks:
        doubts = block.doubts
        while doubts and not block.bad:
            block.bad = held[id(doubts)] < WRAPPER_SHARE * total or not total
            doubts = doubts[1]


def _smoothed(values: list[float]) -> list[float]:
    last = len(values) - 1
    return [sum(w * values[min(max(i + d, 0), last)] for d, w in zip((-1, 0, 1), SPREAD, strict=True)) for i in range(last + 1)]


def main_text(html: str | None) -> str:
    """Content blocks of a page, joined by blank lines."""
    blocks, above = _blocks(html or "")
    if not blocks:
        return ""
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    for b in blocks:
        s = sums[b.path]
        for i, v in enumerate((len(b.text), len(_PUNCTUATION.findall(b.text)), min(b.linked, len(b.text)), 1)):
            s[i] += v
    ratio = {}
    for path, (length, marks, linked, n) in sums.items():
        ratio[path] = math.log1p(length / n) * (1 + math.log1p(marks / n)) * (1 - linked / length) ** 2
    raw = [0.0 if b.bad else ratio[b.path] for b in blocks]
    smooth = [0.0 if b.bad else v for b, v in zip(blocks, _smoothed(raw), strict=True)]
    container: dict[int, float] = defaultdict(float)
    for b, v in zip(blocks, smooth, strict=True):
        container[above.get(b.path, 0)] = max(container[above.get(b.path, 0)], v)
    fused = [0.0 if b.bad else b.weight * math.sqrt(v * max(v, container[above.get(b.path, 0)])) for b, v in zip(blocks, smooth, strict=True)]
    weight = sum(len(b.text) for b in blocks if not b.bad)
    if not weight:
        return ""
    mean = sum(f * len(b.text) for f, b in zip(fused, blocks, strict=True)) / weight
    kept = [b.text for f, b in zip(fused, blocks, strict=True) if not b.bad and f > 0 and f >= THRESHOLD * mean]
    return "\n\n".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
