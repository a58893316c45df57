"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines: a block is one line, and a container's edge parts stretches of lines. The weight of a
line is its text outside links. If the page marks an article, all lines in it are kept. Otherwise sums of weights over
a sliding window of lines rise at a surge point; a stretch that has one is kept but for lists of links, together with
the short stretches that touch it. Regions that markup itself names as something else (menus, forms, adverts,
comments, ...) are left out, unless such a name stands on a wrapper of over two thirds of the page's text, or the
wrapper is a form with that much text besides its fields.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from seqspark.llm.shared import slices

#: Elements whose content is never running text of the page.
NEVER = frozenset((
    "head title script style noscript template svg math iframe object canvas audio video select datalist button "
    "textarea nav footer aside dialog menu").split())
#: Elements that name a form's fields; a form is measured without them.
_FIELDS = frozenset("label legend".split())
#: Elements that end a block; of these, the containers separate regions.
CONTAINERS = frozenset(
    "html body article main section div header footer nav aside form ul ol dl table fieldset details dialog".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption pre blockquote figure figcaption hr address summary legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that name a region which is not the article, and those that name reader comments.
BOILER = frozenset((
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsor promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay sidebar sidebars side widget widgets menu menus nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social related recommended "
    "newsletter subscribe subscription signup login search pagination pager toc skip complementary contentinfo "
    "teaser tags tagcloud copyright legal disclaimer").split())
COMMENTS = frozenset("comment comments commentlist discussion disqus respond replies reply".split())
_BREAK_OUT = frozenset("article main".split())
#: Elements whose text heads or explains what follows, linked or not.
_HEADS = frozenset("h1 h2 h3 h4 h5 h6 caption figcaption".split())

#: What follows a tag's name: a quote opens a value only after "=", and closes it however far away. A value that no
#: quote closes is taken as it stands; as then no such quote follows, the scan is linear.
_ATTRIBUTES = r"(?:[^=<>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>][^\s<>]*+)?)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<svg(?=[\s/>])" + _ATTRIBUTES + r"(?<=/)>"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe)(?=[\s/>])" + _ATTRIBUTES + r">?.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*)(" + _ATTRIBUTES + r")>?|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'][^\s]*)))?")
_UNQUOTED = re.compile(r"=\s*[^\s\"']\S*\Z")
_UNSEEN = re.compile(r"display\s*:\s*none")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _named(name: str, attributes: str) -> str:
    """What an opening tag's attributes say of its region: '' nothing, 'boiler' or 'comments'."""
    if attributes and name not in ("html", "body"):
        found = ""
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if key == "hidden" or (key == "aria-hidden" and value.strip().startswith("true")) or (key == "style" and _UNSEEN.search(value)):
                return "comments"
            if key in ("class", "id", "role"):
                words = frozenset(_WORD.findall(value))
                if words & COMMENTS:
                    found = found or "comments"
                elif words & BOILER and name not in _BREAK_OUT and not (key == "class" and name in ("p", "span", "h1")):
                    found = found or "boiler"
        return found
    return ""


def _opens(m: re.Match) -> bool:
    """Whether a tag opens an element that has content."""
    return not (m[3].lower() in VOID or (m[4].endswith("/") and not _UNQUOTED.search(m[4])))


def _regions(page: str, tokens: list[re.Match]) -> dict[int, str]:
    """`_named` of the opening tags, by place in `tokens`; boiler words on a wrapper of over two thirds of the text
    (outside links, hidden regions, comments and names of fields) don't count. A form is such a region by its name."""
    found: dict[int, str] = {}
    stack: list[tuple[str, int, int, bool]] = []
    opened: Counter[str] = Counter()
    size, unseen, link, at = 0, 0, 0, 0
    held: dict[int, int] = {}

    def pop() -> None:
        nonlocal unseen, link
        name, k, before, hides = stack.pop()
        opened[name] -= 1
        unseen -= hides
        link -= name == "a"
        if found.get(k) == "boiler":
            held[k] = size - before

    for k, m in enumerate(tokens):
        if not unseen and not link:
            size += len(page[at:m.start()].strip())
        at = m.end()
        if m[3] is None:
            if m[0].startswith("<![CDATA[") and not unseen and not link:
                size += len(m[0][9:].removesuffix("]]>").strip())
            continue
        name = m[3].lower()
        if m[2]:
            if opened[name] > 0:
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name != "br" and _opens(m):
            said = _named(name, m[4]) or ("boiler" if name == "form" else "")
            if said:
                found[k] = said
            hides = name in NEVER or name in _FIELDS or said == "comments"
            stack.append((name, k, size, hides))
            opened[name] += 1
            unseen += hides
            link += name == "a"
    if not unseen and not link:
        size += len(page[at:].strip())
    while stack:
        pop()
    return {k: said for k, said in found.items() if said != "boiler" or 3 * held[k] <= 2 * size}


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, weight, in the article, a head) of each line; an empty line stands for the edge of a container."""
    out: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, str]] = []
    opened: Counter[str] = Counter()  # names and regions on the stack
    texts: list[str] = []
    linked, heads = 0, False
    dropped, article, link, head = 0, 0, 0, 0
    tokens = list(_TOKEN.finditer(page))
    regions = _regions(page, tokens)

    def end(container: bool) -> None:
        nonlocal linked, heads
        if texts:
            text = _SPACE.sub(" ", html.unescape("".join(texts))).strip()
            if text:
                weight = len(text) - min(len(text), linked)
                out.append((text, weight if 2 * weight >= len(text) or article else 0, article > 0, heads))
            texts.clear()
        linked, heads = 0, False
        if container and out and out[-1][0]:
            out.append(("", 0, article > 0, False))

    def pop() -> None:
        nonlocal dropped, article, link, head
        name, region = stack.pop()
        opened.subtract((name, f"/{region}"))
        dropped -= region != ""
        article -= name in _BREAK_OUT and not dropped
        link -= name == "a"
        head -= name in _HEADS

    def write(text: str) -> None:
        nonlocal linked, heads
        if text and not dropped:
            texts.append(text)
            linked += len(text.strip()) if link else 0
            heads = heads or head > 0

    at = 0
    for k, m in enumerate(tokens):
        write(page[at:m.start()])
        at = m.end()
        if m[3] is None:
            if m[0].startswith("<![CDATA["):
                write(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = m[3].lower()
        if name == "br":
            write(" ")
        elif m[2]:
            if name in BLOCKS:
                end(name in CONTAINERS)
            if opened[name] > 0:
                while stack[-1][0] != name:
                    pop()
                pop()
        else:
            if name in BLOCKS:
                end(name in CONTAINERS)
            if not _opens(m):
                continue
            if name in _BREAK_OUT and opened["/comments"] <= 0:  # out of a region left open
                while dropped:
                    pop()
            region = "boiler" if name in NEVER or (name == "header" and not article) else regions.get(k, "")
            dropped += region != ""
            article += name in _BREAK_OUT and not dropped
            link += name == "a"
            head += name in _HEADS
            stack.append((name, region))
            opened.update((name, f"/{region}"))
    write(page[at:])
    end(True)
    return out


def main_text(page: str | None, window: int = 3, least: int = 40) -> str:
    """The lines of the article, or else of the stretches that surge and of those that touch them, joined by two newlines.

    A stretch surges where the weights of `window` lines reach `least`; on a very short page, where nothing does, any
    weight will do. Of a kept stretch only runs of `window` or more lines without weight, lists of links, go. Short
    stretches that have weight touch a kept one in a row, and a linked head touches the one that it heads.
    """
    lines = lines_of(page or "")
    if any(weight and inside for _, weight, inside, _ in lines):
        return "\n\n".join(text for text, _, inside, _ in lines if inside and text)
    stretches: list[list[tuple[str, int, bool]]] = [[]]
    for text, weight, _, head in lines:
        if text:
            stretches[-1].append((text, weight, head))
        elif stretches[-1]:
            stretches.append([])
    most = [max((sum(w for _, w, _ in s[j:j + window]) for j in range(len(s))), default=0) for s in stretches]
    enough = least if max(most) >= least else 1
    kept = [x >= enough for x in most]
    n = len(stretches)
    for i in range(1, n):
        kept[i] = kept[i] or (kept[i - 1] and most[i] > 0)
    for i in range(n - 2, -1, -1):
        kept[i] = kept[i] or (kept[i + 1] and (most[i] > 0 or all(head for *_, head in stretches[i])))
    out: list[str] = []
    for stretch in (s for s, keep in zip(stretches, kept) if keep):
        for listed, some in groupby(stretch, key=lambda x: not x[1] and not x[2]):
            texts = [text for text, *_ in some]
            if not listed or len(texts) < window:
                out += texts
    return "\n\n".join(out)


def extract_text(pages: DataFrame, window: int = 3, least: int = 40) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html); a null or empty page gives an empty text.

    Other columns are ignored, repeated rows each give a row. No shuffle.
    """
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x, window, least) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                pa.array([len(x) for x in texts], pa.int64()),
            ], names=["page_id", "url", "text", "n_chars"])

    few = pages.selectExpr("cast(page_id AS long) AS page_id", "cast(url AS string) AS url", "cast(html AS string) AS html")
    return few.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
