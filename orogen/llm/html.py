"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides a block by
where it stands (menus, footers, adverts and the like are out), then by length, link
density and stop-word density, with lower bars within an article element. Undecided
blocks of an article go with it if it has a good block, or holds at least
as much text as all good blocks of the page. The second pass gives each other
undecided block the label of its nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm.common import table

STOP_WORDS = frozenset(
    "the of and to a in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their if do will each about how up out "
    "der die das und in zu den mit von ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem so zum war haben nur oder aber vor zur "
    "le la les de des du et un une en est que qui dans pour pas sur au avec ce il par sont plus ne se ou mais comme son sa ses aux cette leur elle nous vous "
    "el los las y del que una por con para es se no al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde".split()
)
#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas select button textarea head title datalist audio video map".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Containers that are not of the article.
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|side-?bar|nav(?:bar|igation)?|menus?|breadcrumbs?|foot(?:er)?|masthead|comments?|"
    r"disqus|repl(?:y|ies)|respond|cookies?|consent|gdpr|notices?|newsletter|subscribe|signup|popup|modal|overlay|share|sharing|social|related|recommended|widgets?|pagination|pager|toolbar|skip-?link|login|search(?:-?form)?)(?=$|[\s_-])",
    re.IGNORECASE,
)
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.DOTALL)
PLAIN = re.compile(r"[^>\"']*")
MISSES = 64  # tags with an open quote that are looked at up to the page's end, before tags simply end at the next >
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
GOOD, BAD, OPEN = 1, -1, 0


@dataclass
class Block:
    text: str
    linked: int  # characters within links
    article: int  # the number of the nearest article or main element around it, or 0
    outside: bool  # in a menu, footer, advert ...


def _outside(tag: str, attributes: str, depth_in: int) -> bool:
    if tag in OUTSIDE or tag == "header" and not depth_in:
        return True
    if not attributes or tag in ("body", "html", "article", "main"):
        return False
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if got.get("role", "").lower() in ROLES or got.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.IGNORECASE) or re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"=\s*(\"[^\"]*\"|'[^']*'|\S+)", "", attributes)):
        return True
    return any(NAMED.search(got.get(k, "")) for k in ("class", "id"))


class Tags:
    """Where tags end, in time that grows with the page: what isn't there is looked for a few times at most."""

    def __init__(self, page: str):
        self.page, self.last, self.misses, self.unclosed = page, page.rfind(">"), 0, set()

    def end(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes start at ``at``, outside of quotes if those are closed; -1 if there is none."""
        if at > self.last:
            return -1
        i = at
        while self.misses < MISSES:
            i = PLAIN.match(self.page, i).end()
            if i >= len(self.page):
                self.misses += 1
                break
            if self.page[i] == ">":
                return i
            i = self.page.find(self.page[i], i + 1) + 1
            if not i:
                self.misses += 1
                break
        return self.page.find(">", at)

    def closing(self, tag: str, at: int) -> int:
        """Where what follows the next end tag of this name starts; -1 if there is none."""
        if tag not in self.unclosed:
            m = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(self.page, at)
            if m:
                return m.end()
            self.unclosed.add(tag)
        return -1


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each is outside the article
    parts: list[str] = []
    within: list[int] = []  # numbers of the open article and main elements
    linked = links = articles = outside = breaks = 0
    tags, opened = Tags(page), Counter()

    def close(where: int) -> None:
        nonlocal outside, links
        for t, o in stack[where:]:
            opened[t] -= 1
            outside -= o
            links -= t == "a"
            if t in ("article", "main"):
                within.pop()
        del stack[where:]

    def flush() -> None:
        nonlocal parts, linked, breaks
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, min(linked, len(text)), within[-1] if within else 0, outside > 0))
        parts, linked, breaks = [], 0, 0

    def put(raw: str) -> None:
        nonlocal linked, breaks
        if raw:
            raw = html.unescape(raw)
            parts.append(raw)
            if not raw.isspace():
                breaks = 0
                if links:
                    linked += len(" ".join(raw.split()))

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            put(page[at:])
            break
        name, before = m[2], at
        at = m.end()
        attributes = ""
        if name:
            end = tags.end(at)
            if end < 0:
                put(page[before:])
                break
            attributes, at = page[at:end], end + 1
        put(page[before : m.start()])
        if not name:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if opened[tag]:
                least = 0 if tag in BLOCK else max(0, len(stack) - 8)
                where = next((i for i in range(len(stack) - 1, least - 1, -1) if stack[i][0] == tag), -1)
                if where >= 0:
                    close(where)
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                parts.append("\n")
            continue
        if tag in SILENT and not attributes.rstrip().endswith("/"):
            end = tags.closing(tag, at)
            if end >= 0:
                at = end
            elif tag in ("script", "style", "textarea", "noscript", "template", "iframe"):
                at = n
            continue
        if tag in BLOCK:
            flush()
            if tag == "body":
                close(0)
            if tag in ("p", "li", "dt", "dd") or len(tag) == 2 and tag[0] == "h":
                while stack and (stack[-1][0] == "p" or stack[-1][0] not in BLOCK and any(t == "p" for t, _ in stack[-4:])):
                    close(len(stack) - 1)  # a new block ends an open paragraph and what is open in it
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        o = _outside(tag, attributes, len(within))
        stack.append((tag, o))
        opened[tag] += 1
        outside += o
        links += tag == "a"
        if tag in ("article", "main"):
            articles += 1
            within.append(articles)
    flush()
    return out


def first_pass(b: Block, short: int = 70, long: int = 200, low: float = 0.15, high: float = 0.30, most_links: float = 0.5) -> int:
    if b.outside:
        return BAD
    density = b.linked / len(b.text)
    if density > most_links:
        return OPEN if b.article else BAD
    if len(b.text) < short:
        return BAD if density > 0.3 and not b.article else OPEN
    words = b.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if stops >= high:
        return GOOD
    if stops >= low:
        return GOOD if len(b.text) >= long or b.article else OPEN
    return BAD if len(b.text) < long and density > 0 and not b.article else OPEN


def with_articles(found: list[Block], labels: list[int]) -> list[int]:
    """Open blocks of an article that has a good block, or as much text besides links as all good blocks of the page, are good."""
    decided = {b.article for b, x in zip(found, labels, strict=True) if x == GOOD}
    good = sum(len(b.text) for b, x in zip(found, labels, strict=True) if x == GOOD)
    held: dict[int, int] = {}
    for b, x in zip(found, labels, strict=True):
        if b.article and x == OPEN:
            held[b.article] = held.get(b.article, 0) + len(b.text) - b.linked
    whole = {k for k, n in held.items() if k in decided or n >= max(good, 1)}
    return [GOOD if x == OPEN and b.article in whole else x for b, x in zip(found, labels, strict=True)]


def second_pass(labels: list[int]) -> list[int]:
    """Open blocks take the label of the nearest decided neighbours; at two different ones the nearer, and a good one at a tie."""
    n, before, after = len(labels), [], [0] * len(labels)
    last = (BAD, -n - 1)
    for i, x in enumerate(labels):
        last = (x, i) if x != OPEN else last
        before.append(last)
    last = (BAD, 2 * n + 1)
    for i in range(n - 1, -1, -1):
        last = (labels[i], i) if labels[i] != OPEN else last
        after[i] = last
    out = []
    for i, x in enumerate(labels):
        if x == OPEN:
            (p, j), (q, k) = before[i], after[i]
            x = p if p == q else GOOD if i - j == k - i else p if i - j < k - i else q
        out.append(x)
    return out


def extract(page: str | None) -> str:
    """The main text of the whole page: good blocks in order, one a line."""
    found = blocks(page or "")
    labels = with_articles(found, [first_pass(b) for b in found])
    if found and all(x != GOOD for x in labels) and any(x == OPEN for x in labels):
        labels = [GOOD if x == OPEN else x for x in labels]  # nothing decided for the article: what isn't ruled out is it
    return "\n".join(b.text for b, x in zip(found, second_pass(labels), strict=True) if x == GOOD)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = [extract(h.as_py()) for h in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row; empty text for a null or empty page.

    Nulls elsewhere pass through, repeated rows come back as often, other columns are
    left out, an empty table gives an empty one."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_batches, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
