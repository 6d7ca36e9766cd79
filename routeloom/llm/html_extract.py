"""Main text of HTML pages by line-block distribution.

Markup is stripped into text lines, one per block element. A line's weight is its
text outside links; lines of menus, headers, footers, sidebars, notices, adverts,
forms and comments weigh nothing, and such elements leave an empty line. Weights are
summed over sliding windows of lines: the text surges where a window's sum rises from
nothing above the surge level and dives where a whole window falls back to nothing.
The lines between a surge and its dive are kept.

Every page is scanned so. An ``article`` or ``main`` mark only helps: inside it any
line of text weighs at least 1 and the surge level is 0. Each innermost mark is
scanned by itself, and so are the lines outside any; what an element holds inside
another leaves one empty line there. Marks are not compared by size, but for teasers: a
mark with a heading that is all link is left out if it holds less than ``share`` of
the heaviest, as are such spans outside marks. A mark's own lines count with those
of the marks inside it. Where no window of a page passes the surge level, the level is 0.

Class and id words tell chrome. Outside marks any such word does; inside one, a name does
only if all its words are such or of layout (``related-posts``, not ``related-work``).

Character references are decoded, white space inside a block becomes one space, and
blocks are joined by an empty line. Null, empty or unfinished markup gives the text
there is, or an empty string. Rows are independent; repeated rows give equal results.
Empty table: no rows. A very long page is read in one piece, in time linear in its
length: no pattern looks beyond the next tag's start, but for comments and raw text, which take all they look at. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import small_batches, with_text

# Element and attribute names.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("aside button canvas datalist dialog fieldset footer form head iframe input label map math menu nav noscript object option search select svg template textarea title video audio".split())
RAW = ("script", "style", "iframe", "textarea")  # hold no markup: without an end tag they hold the rest
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HINTED = frozenset("article aside div dl details figure header li ol p section span table ul".split())
#: An element that its next sibling ends: the names it ends, and the containers across which it ends none.
SIBLINGS = {
    **dict.fromkeys(["li"], (("li",), ("ul", "ol", "menu", "dir"))), **dict.fromkeys(["dd", "dt"], (("dd", "dt"), ("dl",))), **dict.fromkeys(["option", "optgroup"], (("option",), ("select", "datalist"))),
    **dict.fromkeys(["td", "th"], (("td", "th"), ("tr", "table"))), "tr": (("tr",), ("table",)), **dict.fromkeys(["thead", "tbody", "tfoot"], (("thead", "tbody", "tfoot"), ("table",))),
}

ATTRS = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+"
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b" + ATTRS + r">.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>" + ATTRS + r")>|<[!?/][^<>]*+>|<[!?/a-zA-Z][^<>]*+(?=<)",
    re.S | re.I,
)
HINT = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|alert|disclaimer|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|sidebar|aside|widget|widgets|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|pagination|pager|toc|masthead|footer|copyright|comment|comments|commentlist|disqus|replies|respond|discussion|share|sharing|social|related|recommended|recommendations|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
# Words of chrome that also name parts of an article, and words of layout.
ALSO_TEXT = frozenset("discussion menu skip".split())
LAYOUT = frozenset("area bar block body box btn button buttons card cards col column container content count form global group holder icon icons inline inner item items left link links list main mobile outer page panel post posts right row section site slot stories sticky strip thread top bottom unit wrap wrapper zone".split())
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)  # an article's own header has its title
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACE = re.compile(r"\s+")


def _hinted(name: str, attrs: str, in_article: bool) -> bool:
    if not attrs.strip():
        return False
    values = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attrs)}
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true":
        return True
    if values.get("role", "").lower() in ROLES:
        return True
    names = f"{values.get('class', '')} {values.get('id', '')}"
    if name not in HINTED or not in_article:
        return name in HINTED and bool(HINT.search(names) or HEADER.search(names))
    return bool(HINT.search(names)) and any(map(_all_chrome, names.lower().split()))


def _all_chrome(name: str) -> bool:
    """Whether a name has a word of chrome, and no word but such and of layout."""
    words = [w for w in re.split("[_-]+", name) if w and not w.isdigit()]
    told = [w for w in words if HINT.fullmatch(w)]
    return bool(told) and all(w in LAYOUT or HINT.fullmatch(w) for w in words) and words not in ([w] for w in ALSO_TEXT)


class Open:
    """The open elements. A block's end tag ends what is open inside it, an inline one's reaches across no block."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name in BLOCKS or name in DROPPED:
            self.blocks.append(len(self.names))
        self.names.append(name)

    def cut(self, upto: int) -> None:
        while len(self.names) > upto:
            self.places[self.names.pop()].pop()
        while self.blocks and self.blocks[-1] >= upto:
            self.blocks.pop()

    def before(self, name: str) -> None:
        """End what the start tag ends: a p at a block, an li at the next li and so on."""
        if name in BLOCKS and self.blocks and self.names[self.blocks[-1]] == "p":
            self.cut(self.blocks[-1])
        if name in SIBLINGS:
            ended, across = SIBLINGS[name]
            at = self.last(ended)
            if at > self.last(across):
                self.cut(at)

    def end(self, name: str) -> None:
        at = self.last((name,))
        if at >= 0 and (name in BLOCKS or name in DROPPED or not self.blocks or self.blocks[-1] <= at):
            self.cut(at)


def lines_of(page: str) -> tuple[list[tuple[str, int, int]], list[int], set[int]]:
    """(text, weight, innermost mark) of each line, the mark around each mark, and the teasers among the marks; 0 is
    outside any. A gap is a line of weight 0 without text."""
    lines: list[tuple[str, int, int]] = []
    around = [0]
    marks = [0]  # those open
    parts: list[str] = []
    linked = at = 0
    plain = False  # whether the line has text outside links
    teasers: set[int] = set()
    opened = Open()
    links: list[int] = []  # places of the open link, articles and dropped element
    articles: list[int] = []
    dropped: list[int] = []

    def flush() -> None:
        nonlocal linked, plain
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            lines.append((text, max(1 if articles else 0, len(text) - linked), marks[-1]))
            if not plain and any(opened.places.get(h) for h in HEADINGS):
                teasers.add(marks[-1])
        parts.clear()
        linked, plain = 0, False

    def text(upto: int) -> None:
        nonlocal linked, plain
        if upto > at and not dropped:
            piece = page[at:upto]
            parts.append(piece)
            if links:
                linked += len(piece)
            elif not plain:
                plain = not piece.isspace()

    def close() -> None:
        n = len(opened.names)
        for places in (links, dropped):
            if places and places[-1] >= n:
                places.pop()
        while articles and articles[-1] >= n:
            flush()
            articles.pop()
            marks.pop()

    for m in TAG.finditer(page):
        text(m.start())
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if not dropped:
            if name in BLOCKS or name in DROPPED:
                flush()
            elif name == "br":
                parts.append(" ")
        if m["end"]:
            if name == "a" and not dropped:
                links.clear()
            opened.end(name)
            close()
            continue
        opened.before(name)
        close()
        if name in VOID or m["attrs"].endswith("/"):
            continue
        if not dropped:
            if name in DROPPED or name == "header" and not articles or _hinted(name, m["attrs"], bool(articles)):
                dropped.append(len(opened.names))
                lines.append(("", 0, marks[-1]))
            elif name == "a":
                links[:] = [len(opened.names)]
            elif name in ("article", "main"):
                lines.append(("", 0, marks[-1]))
                around.append(marks[-1])
                marks.append(len(around) - 1)
                articles.append(len(opened.names))
        opened.push(name)
    text(len(page))
    flush()
    return lines, around, teasers


def spans_of(weights: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """The [surge, dive) line ranges. A window slides over the lines and is summed: its sum leaves
    nothing at a surge point and is back at nothing at the dive point, ``window`` lines after the
    last line with weight. A range counts if the sum passed the surge level on the way."""
    spans = []
    total = most = start = 0
    for end in range(1, len(weights) + window + 1):
        before, total = total, total + (weights[end - 1] if end <= len(weights) else 0) - (weights[end - window - 1] if end > window else 0)
        if not before and total:
            start, most = end - 1, 0
        most = max(most, total)
        if before and not total and most > surge:
            spans.append((start, end - window))
    return spans


def main_text(page: str, window: int = 3, surge: int = 80, share: float = 0.15) -> str:
    lines, around, teasers = lines_of(page)
    places: list[list[int]] = [[] for _ in around]  # the lines of each mark, a row of gaps as one
    for i, (text, _, mark) in enumerate(lines):
        if text or not places[mark] or lines[places[mark][-1]][0]:
            places[mark].append(i)
    weights = [[lines[i][1] for i in own] for own in places]
    if not any(spans_of(w, window, surge) for w in weights):
        surge = 0
    spans = [spans_of(w, window, 0 if mark else surge) for mark, w in enumerate(weights)]
    held = [sum(w) for w in weights]
    outside = [sum(weights[0][a:b]) for a, b in spans[0]]
    least = share * max([*held[1:], *outside], default=0)
    for mark in range(len(around) - 1, 0, -1):
        if around[mark]:
            held[around[mark]] += held[mark]
    kept = [places[0][i] for (a, b), w in zip(spans[0], outside, strict=True) if w >= least for i in range(a, b)]
    kept += [own[i] for mark, (own, found, w) in enumerate(zip(places[1:], spans[1:], held[1:], strict=True), 1) if mark not in teasers or w >= least for a, b in found for i in range(a, b)]
    return "\n\n".join(lines[i][0] for i in sorted(kept) if lines[i][0])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, surge: int = 80, share: float = 0.15) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    rows = with_text(pages.select(id_col, url_col, html_col), html_col)
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, window, surge, share) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(run, f"{kinds[0]}, {kinds[1]}, text string, n_chars long").withColumn("text", F.coalesce("text", F.lit("")))
