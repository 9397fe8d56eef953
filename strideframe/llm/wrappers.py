"""Main text of web pages by wrappers inferred per host.

A page is read into a stream of block tags and text blocks. Streams of one host are folded (a unit that follows itself
becomes a repeated group) and aligned one after the other: what both have stays, what only one has becomes optional,
units met once and repeated elsewhere become the repeated group, and texts become slots. The result is a regular
expression without unions: tags, slots, optional and repeated groups. A slot or group whose text recurs there on pages without
a marked article is template: menus, adverts and footers in bare divs. A text recurs if at least ``CONSTANT_PAGES`` different
pages of the host, and one in ``RECURRING_SHARE``, have it at this place, or, in a paragraph or the like, if all have; all
pages are counted, not the sampled ones. Slots are content when most of the text they held lies in the article or, on pages that mark none, in headings, paragraphs, list
items, cells, repeated groups and long blocks.

Each page is then matched to its host's wrapper and read in page order, always without its menus, headers, footers,
sidebars, notices, adverts, forms and comments. A page that marks its article gives the article's blocks, whatever other
pages of its host do. Any other page loses its recurring texts, but for a heading before a block that stays, and gives its
content blocks (by their own kind, or by the slot) and every block between the first and the last of them; a page without
content blocks gives all it has. A page that would lose half of its text keeps it: an article with many copies recurs,
too. Class and id tell only as whole names ("comment-list", not "share-price"); ids of headings and paragraphs and classes of
headings in an article tell nothing. A reader comment in bare divs beside the article's is like a paragraph to all this, and stays. Wrappers are fitted on about ``SAMPLE`` pages a host, chosen by a hash; pages are all
extracted. Wrappers are broadcast when their counted bytes are below a bound, otherwise joined to the pages by host.

Edge cases: null or empty html gives the empty text; a null url is its own host; unclosed tags, comments and scripts end
with the page; very long pages are read whole; repeated rows are extracted alike and count once; of equally good alignments
the first is taken; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.store import keep

SAMPLE, WRAPPER_BYTES = 16, 32 << 20
#: Longest unit of a repeated group, in tokens, and the pages a constant text must be met on.
MAX_UNIT, CONSTANT_PAGES = 12, 4
#: A text outside paragraphs is template if one in so many different pages of a host has it at its place.
RECURRING_SHARE = 10
LONG_SLOT = 80
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:\"[^\"<]*\"|'[^'<]*'|[^<>])*+)(?:>|(?=<)|\Z)",
    re.S,
)
CLASS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "math", "iframe", "object", "select", "canvas", "video", "audio"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav",
    "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "button", "label", "legend", "dir",
}
BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "head", "dir"}
CONTENT_TAGS = {"article", "main"}
BOILER_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead", "comment", "comments",
    "disqus", "reply", "replies", "respond", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "newsletter",
    "subscribe", "subscription", "signup", "login", "social", "share", "sharing", "related", "recommended", "recommendations", "popup", "modal",
    "overlay", "search", "widget", "pagination", "pager", "copyright", "toolbar", "skip", "complementary", "contentinfo", "form", "paywall",
}
CONTENT_WORDS = {"article", "content", "post", "entry", "story", "main", "maincontent", "articlebody", "body"}
#: Parts of compound names that say nothing by themselves.
NEUTRAL_WORDS = {
    "site", "page", "top", "bottom", "left", "right", "box", "bar", "list", "item", "items", "area", "section", "block", "container",
    "wrapper", "wrap", "inner", "outer", "global", "primary", "secondary", "row", "col", "unit", "slot", "links", "text",
}
#: Tags that end an open paragraph or list item of the same kind.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


#: Innermost elements whose texts count as content however short they are, on pages that mark no article; "" is none.
PROSE = {"", "html", "body", "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "blockquote", "pre", "figcaption", "td", "th"}


@dataclass
class Page:
    """The stream of a page: symbols, and for each text symbol its block: text, in an article, in boilerplate, in prose."""

    symbols: list[str] = field(default_factory=list)
    texts: dict[int, tuple[str, bool, bool, bool]] = field(default_factory=dict)

    @property
    def marked(self) -> bool:
        """Whether the page marks an article that holds text."""
        return any(content and not boiler for _, content, boiler, _ in self.texts.values())

    @property
    def body(self) -> tuple[str, ...]:
        """The texts of the article or, where none is marked, all but boilerplate."""
        marked = self.marked
        return tuple(text for text, content, boiler, _ in self.texts.values() if not boiler and (content or not marked))


def _names(rest: str) -> tuple[dict[str, set[str]], str]:
    """The names in class, id and role, and the label of the symbol."""
    names: dict[str, set[str]] = {"class": set(), "id": set(), "role": set()}
    label = ""
    for kind, a, b, c in CLASS.findall(rest):
        values = (a or b or c).lower().split()
        names[kind.lower()].update(values)
        if kind.lower() == "class" and values:
            label = "." + values[0]
    return names, label


def _tells(names: set[str], words: set[str], others: set[str]) -> bool:
    """Whether a whole name is one of ``words``, or is made of one of them and of parts without another meaning."""
    for name in names:
        parts = {x for x in re.split(r"[^a-z0-9]+", name) if x and not x.isdigit()}
        if parts & words and parts <= words | others | NEUTRAL_WORDS:
            return True
    return False


def read_page(source: str | None) -> Page:
    """Stream and text blocks of a page, with implied end tags made explicit."""
    page, stack, buffer, breaks = Page(), [], [], 0
    source = source or ""

    def flush() -> None:
        text = " ".join(html_lib.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            inner = stack[-1][0] if stack else ""
            page.texts[len(page.symbols)] = (text, any(s[2] for s in stack), any(s[3] for s in stack), inner in PROSE)
            page.symbols.append("#")

    def close(count: int) -> None:
        for _ in range(count):
            page.symbols.append("/" + stack.pop()[1])

    at, skip = 0, ""
    for tag in MARKUP.finditer(source):
        if skip:
            if tag["close"] and tag["name"].lower() == skip:
                skip, at = "", tag.end()
            continue
        if tag.start() < at:
            continue
        between = source[at : tag.start()]
        if between:
            buffer.append(between)
            breaks = breaks if between.isspace() else 0
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if name in RAW:
            skip = "" if tag["close"] or tag["rest"].endswith("/") else name
            continue
        if name == "br":
            breaks += 1
            buffer.append(" ")
            if breaks > 1:
                flush()
            continue
        if name not in BLOCK:
            continue
        breaks = 0
        flush()
        if tag["close"]:
            depth = next((i for i, s in enumerate(reversed(stack)) if s[0] == name), None)
            if depth is not None:
                close(depth + 1)
            continue
        ends = SIBLINGS.get(name, {"p"} if name not in ("html", "body") else set())
        if stack and stack[-1][0] in ends:
            close(1)
        names, label = _names(tag["rest"]) if "=" in tag["rest"] else ({}, "")
        if name in VOID:
            continue
        content, boiler = name in CONTENT_TAGS, name in BOILER_TAGS
        if names and name not in ("html", "body"):
            every = names["class"] | names["id"] | names["role"]
            content = content or _tells(every, CONTENT_WORDS, set())
            if name in PROSE:
                # An id names the place of a paragraph or heading, and so does a heading's class in an article.
                every = names["role"] | (set() if name[0] == "h" and any(s[2] for s in stack) else names["class"])
            boiler = boiler or (name not in CONTENT_TAGS and _tells(every, BOILER_WORDS, CONTENT_WORDS))
        stack.append((name, name + label, content, boiler))
        page.symbols.append(name + label)
    if not skip:
        buffer.append(source[at:])
    flush()
    close(len(stack))
    return page


Node = tuple[str, int, int]


def fold(symbols: list[str], known: frozenset[str] = frozenset()) -> list[Node]:
    """(symbol, first, end) nodes; an element that follows itself, or that ``known`` has as a group, is one node."""
    # Open elements: name, first symbol and finished children; a child is (unit, nodes), unit None if too large to group.
    stack: list[tuple[str, int, list[tuple[str | None, list[Node]]]]] = [("", 0, [])]

    def finish(unit: str | None, nodes: list[Node]) -> None:
        siblings = stack[-1][2]
        if unit is not None:
            group = f"({unit})+"
            if siblings and siblings[-1][0] == unit:
                first = siblings[-1][1][0][1]
                siblings[-1] = unit, [(group, first, nodes[-1][2])]
                return
            if group in known:
                nodes = [(group, nodes[0][1], nodes[-1][2])]
        siblings.append((unit, nodes))

    for i, symbol in enumerate(symbols):
        if symbol == "#":
            finish("#", [("#", i, i + 1)])
        elif symbol[0] != "/":
            stack.append((symbol, i, []))
        else:
            name, first, children = stack.pop()
            inner = [n for _, nodes in children for n in nodes]
            unit = " ".join([name, *[n[0] for n in inner], symbol]) if len(inner) <= MAX_UNIT else None
            finish(unit, [(name, first, first + 1), *inner, (symbol, i, i + 1)])
    return [n for _, nodes in stack[0][2] for n in nodes]


def _groups(symbols: list[str]) -> frozenset[str]:
    return frozenset(s for s in symbols if s.endswith(")+"))


def align(expression: list[list], nodes: list[str]) -> list[list]:
    """The wrapper that also generates ``nodes``: [symbol, optional] pairs."""
    out: list[list] = []
    for op, a, b, c, d in SequenceMatcher(None, [e[0] for e in expression], nodes, autojunk=False).get_opcodes():
        if op == "equal":
            out += [list(e) for e in expression[a:b]]
        else:
            out += [[e[0], True] for e in expression[a:b]] + [[s, True] for s in nodes[c:d]]
    return out


def places(expression: list[list], nodes: list[Node]) -> list[int]:
    """For each node its place in the wrapper, -1 if it has none."""
    found = [-1] * len(nodes)
    for a, b, n in SequenceMatcher(None, [e[0] for e in expression], [x[0] for x in nodes], autojunk=False).get_matching_blocks():
        for k in range(n):
            found[b + k] = a + k
    return found


def infer(pages: list[Page], inside: bool = True) -> dict:
    """The wrapper of pages of one host: its expression, known groups, content places and constant texts.

    Constant texts are looked for inside marked articles, too, if ``inside`` (``main_text`` doesn't), and have to be met on
    every page given, among ``CONSTANT_PAGES`` with different texts beside menus and adverts.
    """
    distinct: dict[str, Page] = {}
    for page in pages:
        distinct.setdefault(json.dumps([page.symbols, sorted(t[0] for t in page.texts.values())]), page)
    pages = list(distinct.values())
    groups: frozenset[str] = frozenset()
    for _ in range(3):
        grown = groups.union(*(_groups([n[0] for n in fold(p.symbols, groups)]) for p in pages)) if pages else groups
        if grown == groups:
            break
        groups = grown
    folded = [fold(p.symbols, groups) for p in pages]
    expression: list[list] = []
    for nodes in folded:
        names = [n[0] for n in nodes]
        expression = align(expression, names) if expression else [[s, False] for s in names]
    mass: dict[int, list[int]] = {}
    values: dict[int, list[tuple[tuple[str, ...], str]]] = {}
    bodies = {id(p): p.body for p in pages if inside or not p.marked}
    for page, nodes in zip(pages, folded, strict=True):
        for place, (symbol, a, b) in zip(places(expression, nodes), nodes, strict=True):
            for i in range(a, b):
                if i in page.texts and place >= 0:
                    text, content, boiler, prose = page.texts[i]
                    good = (content if page.marked else prose or len(text) >= LONG_SLOT or symbol != "#") and not boiler
                    mass.setdefault(place, [0, 0])[good] += len(text)
                    if symbol == "#" and not boiler and id(page) in bodies:
                        values.setdefault(place, []).append((bodies[id(page)], text))
    least = max(CONSTANT_PAGES, len(set(bodies.values())))
    constant = {k: v[0][1] for k, v in values.items() if len({body for body, _ in v}) >= least and len({text for _, text in v}) == 1}
    return {
        "expression": expression, "groups": sorted(groups),
        "content": sorted(k for k, (no, yes) in mass.items() if yes > no), "constant": {str(k): v for k, v in constant.items()},
        "inside": inside,
    }


def _mark(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


class Extractor:
    """Matches pages to one wrapper; equal streams are aligned once."""

    MEMO = 20_000

    def __init__(self, wrapper: dict | None):
        wrapper = wrapper or {"expression": [], "groups": [], "content": [], "constant": {}, "inside": False}
        self.expression, self.groups = wrapper["expression"], frozenset(wrapper["groups"])
        self.content = set(wrapper["content"])
        self.constant = {int(k): v for k, v in wrapper["constant"].items()}
        self.inside = wrapper["inside"]
        self.recurring = {(int(k), mark) for k, marks in wrapper.get("recurring", {}).items() for mark in marks}
        self.memo: dict[tuple[str, ...], list[int]] = {}

    def match(self, page: Page) -> tuple[list[int], list[Node]]:
        """Nodes of the page and the place of each."""
        nodes = fold(page.symbols, self.groups)
        shape = tuple(n[0] for n in nodes)
        found = self.memo.get(shape)
        if found is None:
            found = places(self.expression, nodes)
            if len(self.memo) < self.MEMO:
                self.memo[shape] = found
        return found, nodes

    def slots(self, source: str | None) -> tuple[str, set[tuple[int, str, bool]]]:
        """A digest of the page's texts and, if it has texts and marks no article, (place, digest, in prose) of each."""
        page = read_page(source)
        if page.marked or not page.body:
            return "", set()
        found, nodes = self.match(page)
        held = {(k, i) for k, (_, a, b) in zip(found, nodes, strict=True) if k >= 0 for i in range(a, b) if i in page.texts}
        return _mark("\n".join(page.body)), {(k, _mark(page.texts[i][0]), page.texts[i][3]) for k, i in held if not page.texts[i][2]}

    def text(self, source: str | None) -> str:
        page = read_page(source)
        found, nodes = self.match(page)
        marked = page.marked
        # (text, place, content) of what is not boilerplate; headings by their number.
        blocks, headings = [], set()
        for place, (symbol, a, b) in zip(found, nodes, strict=True):
            for i in range(a, b):
                if i not in page.texts:
                    continue
                text, content, boiler, prose = page.texts[i]
                if not boiler:
                    good = content if marked else prose or len(text) >= LONG_SLOT or symbol != "#" or place in self.content
                    if re.match("h[1-6]", page.symbols[i - 1]):
                        headings.add(len(blocks))
                    blocks.append((text, place, good))
        if not marked and self.recurring:
            blocks = self._own(blocks, headings)
        if not marked:
            good = [k for k, block in enumerate(blocks) if block[2]]
            blocks = blocks[good[0] : good[-1] + 1] if good else blocks
        kept = [(text, place) for text, place, good in blocks if good or not marked]
        if self.constant and (self.inside or not marked):
            own = [text for text, place in kept if self.constant.get(place) != text]
            # What is most of a page is no template, but an article with many copies.
            if 2 * sum(map(len, own)) > sum(len(text) for text, _ in kept):
                return "\n".join(own)
        return "\n".join(text for text, _ in kept)


    def _own(self, blocks: list[tuple[str, int, bool]], headings: set[int]) -> list[tuple[str, int, bool]]:
        """The blocks without recurring texts, unless these are half of all."""
        own: list[tuple[str, int, bool]] = []
        follows = False
        for k in reversed(range(len(blocks))):
            text, place, _ = blocks[k]
            follows = (place, _mark(text)) not in self.recurring or (follows and k in headings)
            if follows:
                own.append(blocks[k])
        return own[::-1] if 2 * sum(len(b[0]) for b in own) > sum(len(b[0]) for b in blocks) else blocks


def host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(host, wrapper): one inferred wrapper a host, as JSON, from about ``sample`` pages chosen by a hash of the id."""
    # Pages are chosen by their ids before any html is read; the kept tables are small, so Spark sends them to the pages.
    rows = pages.select(host().alias("host"), F.xxhash64("page_id").alias("key"))
    sizes = keep(rows.groupBy("host").count(), "hosts")
    few = rows.join(sizes, "host").where(F.pmod("key", F.lit(1 << 20)) * F.col("count") < F.lit(sample << 20))
    keys = keep(few.select("key").distinct(), "sampled-pages")
    chosen = pages.select(host().alias("host"), "html", F.xxhash64("page_id").alias("key")).join(keys, "key", "left_semi").select("host", "html")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        read = [read_page(x) for x in pdf["html"]]
        found = infer(read, inside=False) | {"constant": {}}
        plain = any(p.body and not p.marked for p in read)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(found)], "plain": [plain]})

    fitted = keep(chosen.groupBy("host").applyInPandas(run, "host string, wrapper string, plain boolean"), "fitted")
    doubtful = fitted.where("plain").select("host", "wrapper")
    if doubtful.isEmpty():
        return fitted.select("host", "wrapper")

    # Recurring texts are counted over every page of the hosts that have pages without a marked article.
    rows, known = _beside(pages.select("html", host().alias("host")), doubtful, "inner")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[str, Extractor] = {}
        for pdf in batches:
            out = []
            for name, source, joined in zip(pdf["host"], pdf["html"], pdf["wrapper"], strict=True):
                extractor = _extractor(ready, name, joined, known)
                if extractor.expression:
                    body, held = extractor.slots(source)
                    if body:
                        out += [(name, -1, "", False, body), *((name, *slot, body) for slot in held)]
            yield pd.DataFrame(out, columns=["host", "place", "mark", "prose", "body"])

    slots = rows.mapInPandas(look, "host string, place int, mark string, prose boolean, body string").distinct()
    seen = slots.groupBy("host", "place", "mark", "prose").count()
    seen = keep(seen.where((F.col("count") >= CONSTANT_PAGES) | (F.col("place") < 0)), "recurring")
    bodies = seen.where("place < 0").select("host", F.col("count").alias("bodies"))
    least = F.when(F.col("prose"), F.col("bodies")).otherwise(F.col("bodies") / RECURRING_SHARE)
    often = seen.where("place >= 0").join(bodies, "host").where(F.col("count") >= least)
    marks = often.groupBy("host", "place").agg(F.sort_array(F.collect_set("mark")).alias("marks")).groupBy("host")
    recurring = marks.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("place").cast("string"), "marks")))).alias("recurring"))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            settled = [json.dumps(json.loads(w) | {"recurring": json.loads(r or "{}")}) for w, r in zip(pdf["wrapper"], pdf["recurring"], strict=True)]
            yield pd.DataFrame({"host": pdf["host"], "wrapper": settled})

    return fitted.select("host", "wrapper").join(recurring, "host", "left").mapInPandas(settle, "host string, wrapper string")


def _beside(rows: DataFrame, fitted: DataFrame, how: str = "left"):
    """The rows with their host's wrapper, or with a null and a broadcast of the wrappers if those are small."""
    size = fitted.agg(F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0))).first()[0]
    if size > WRAPPER_BYTES:
        return rows.join(fitted, "host", how), None
    known = rows.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in fitted.collect()})
    return rows.withColumn("wrapper", F.lit(None).cast("string")), known


def _extractor(ready: dict, name: str, joined: str | None, known) -> Extractor:
    if name not in ready:
        data = known.value.get(name) if known is not None else joined
        if len(ready) > 1000:
            ready.clear()
        ready[name] = Extractor(json.loads(data) if data else None)
    return ready[name]


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    fitted = keep(wrappers(pages), "wrappers")
    rows = pages.select("page_id", "url", "html", host().alias("host"))
    rows, known = _beside(rows, fitted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[str, Extractor] = {}
        for pdf in batches:
            texts = []
            for name, source, joined in zip(pdf["host"], pdf["html"], pdf["wrapper"], strict=True):
                texts.append(_extractor(ready, name, joined, known).text(source))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts})

    return rows.mapInPandas(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string")
