"""Main text of HTML pages by consensus host paths.

First pass: each page's containers are scored by the text they hold outside of menus, adverts, forms and the like, and
the page votes for the generalised tag-class path of its best one. Spark sums the votes per host and path, and the
path with the most votes wins its host. Second pass: each page is extracted from its containers on the winning path if
they hold at least SHARE of the score of the page's own best container, or else from that one (a host may have several
templates).

What is not main text: elements that never hold it (scripts, styles), asides by their tag (nav, footer, form ..), hidden
elements, and elements with a word like ``sidebar`` in their class, id or role. A word alone does not decide: it is taken
back from an element with SHARE of the page's text and its article, main element or first heading, which an aside does
not hold, and ``no-sidebar`` or ``with-sidebar`` says nothing about the element. A name that ends in a word of its own
(``cookie-recipe``, ``related-work``; not ``cookie-box``) is only a hint: such an element goes where links hold more than LINKED of
its text, or where it is outside of an article and holds less than HINT_SHARE of the page's text. Where nothing else is left, a page
keeps what only words ruled out.

Only blocks end a block: a line break opportunity, an image or a script inside a word leaves it whole.

The parser reads a page once, and its work and memory grow with the page: elements keep sums and their place in the
text, not lists of what is above or below, and a path is a running hash with the names of its last PATH_NAMES elements.

Skew: votes are pre-aggregated before the shuffle; a host may hold a third of all pages, so the pages of hot hosts (at
most HOT_SHARE of them) stay where they are and learn the path from a broadcast; all others meet it in a merge join.

Cases: a null or empty html gives an empty text; a null url is the host ''; ties go to the smaller path; repeated rows
are extracted each; unclosed tags, comments, scripts end with the page; an unclosed quote ends with its tag; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.llm.common import bounded_batches, join_groups, written

#: Elements whose content is never text, elements that hold no main text, inline and void elements.
RAW = frozenset("script style template noscript iframe svg math object canvas textarea select title".split())
ASIDE = frozenset("nav footer aside form button menu dialog head".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rt ruby s samp small span strike strong sub sup time tt u var".split())
WITHIN = INLINE | frozenset("audio embed img input link map math meta noscript object param picture script source style svg template track video wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CELLS = frozenset("li td th tr dt dd".split())
CONTAINERS = frozenset("body article main section div td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id or role names that mark what is not main text.
NOISE = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header masthead "
    "menu modal nav navbar navigation navmenu newsletter notice notices notification paywall popup promo promotion related reply replies respond share sharing sidebar sidenav social "
    "sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Words after which a word of NOISE speaks of something beside or inside the element.
ABOUT = frozenset("no not without has with hide show left right ready".split())
#: Words after a word of NOISE that only say what form the noise has.
FORM = frozenset(
    "area articles author bar block body bottom box btn button buttons card cards cell col column container content desktop entries fixed form frame group heading holder home icon icons image images inline "
    "inner item items label large layer link links list main message meta mobile module news outer overlay page pages pane panel policy post posts primary region responsive row secondary section "
    "signup slot small sticky stories tags text thread title top topics unit up wide wrap wrapper zone".split()
)
SHARE, HINT_SHARE, LINKED, PATH_NAMES = 0.5, 0.25, 1 / 3, 40
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


class Element:
    """An open or closed element: flags from above, sums over the text below it, and its place in the page's pieces."""

    __slots__ = ("tag", "name", "parent", "depth", "path", "aside", "named", "hinted", "link", "article", "block", "start", "end", "score", "linked", "holds", "kept")

    def __init__(self, tag: str, name: str, parent: Element | None, depth: int, start: int):
        self.tag, self.name, self.parent, self.depth, self.start = tag, name, parent, depth, start
        self.path = xxhash.xxh64_intdigest(name, seed=parent.path) if parent else 0
        self.aside = self.named = self.hinted = self.holds = False
        self.link = tag == "a" or (parent is not None and parent.link)
        self.article = tag in ("article", "main") or (parent is not None and parent.article)
        self.block = depth if tag not in INLINE or parent is None else parent.block
        self.score, self.linked, self.end, self.kept = 0.0, 0.0, -1, True

    def path_text(self) -> str:
        """Generalised tag-class path; of a deep element the last names, after a hash of the others."""
        found, e = [], self
        while e.parent is not None and len(found) < PATH_NAMES:
            found.append(e.name)
            e = e.parent
        return ">".join(([f"#{e.path:016x}"] if e.parent is not None else []) + found[::-1])


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(text)}


def is_aside(tag: str, attrs: dict[str, str]) -> bool:
    return tag in ASIDE or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))


def noise(tag: str, attrs: dict[str, str]) -> tuple[bool, bool]:
    """Whether a class, id or role is named after NOISE, and whether one has a word of NOISE that may speak of something else."""
    named = hinted = False
    if tag not in ("body", "html", "main"):
        for name in " ".join(attrs.get(k, "") for k in ("class", "id", "role")).split():
            words = [w.lower() for w in NAME_WORD.findall(name)]
            if any(w in NOISE for w in words) and not any(w in ABOUT for w in words):
                last = next(w for w in reversed(words) if w in NOISE or w not in FORM and len(w) > 1)
                named, hinted = named or last in NOISE, hinted or last not in NOISE
    return named, hinted and not named


class Page:
    """The page's elements, and its text as pieces: (text, element), or ('', None) where a block begins or ends."""

    def __init__(self, html: str):
        self.pieces: list[tuple[str, Element | None]] = []
        self.containers: list[Element] = []
        self.elements: list[Element] = []
        self.html = html
        self.no_quote: set[str] = set()
        self.stack = [Element("", "", None, 0, 0)]
        self.open: dict[str, list[int]] = {}
        self.read()
        self.judge()

    def tag_end(self, at: int) -> tuple[int, int]:
        """(end of the attributes, first place after the tag) from a place inside it; a quote counts after an equals sign."""
        html, k = self.html, at
        while (m := STOP.search(html, k)) is not None:
            q = m[0]
            if q == ">":
                return m.start(), m.end()
            k = m.end()
            if q not in self.no_quote and html[max(at, m.start() - 40) : m.start()].rstrip()[-1:] == "=":
                close = html.find(q, k)
                if close < 0:
                    self.no_quote.add(q)
                else:
                    k = close + 1
        return len(html), len(html)

    def read(self) -> None:
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self.text(html[at:])
                break
            nxt = html[lt + 1 : lt + 2]
            if nxt == "!" or nxt == "?":
                self.text(html[at:lt])
                mark = "-->" if html.startswith("<!--", lt) else ">"
                end = html.find(mark, lt + (4 if mark == "-->" else 2))
                at = n if end < 0 else end + len(mark)
                continue
            closing = nxt == "/"
            name = NAME.match(html, lt + 1 + closing)
            if name is None:
                if closing:  # a closing tag without a name is a comment up to its end
                    self.text(html[at:lt])
                    end = html.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    self.text(html[at : lt + 1])
                    at = lt + 1
                continue
            self.text(html[at:lt])
            end, at = self.tag_end(name.end())
            tag = name[0].lower()
            if tag not in WITHIN:
                self.pieces.append(("", None))
            if closing:
                self.close(tag)
            elif tag not in VOID:
                if tag in RAW:
                    close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                    at = close.end() if close else n
                else:
                    self.begin(tag, html[name.end() : end])
        self.pop(1)

    def text(self, piece: str) -> None:
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            self.pieces.append((piece, self.stack[-1]))

    def pop(self, depth: int) -> None:
        for e in reversed(self.stack[depth:]):
            e.end = len(self.pieces)
            self.open[e.tag].pop()
        del self.stack[depth:]

    def close(self, tag: str) -> None:
        at = self.open.get(tag)
        if at and (tag not in INLINE or at[-1] > self.stack[-1].block):
            self.pop(at[-1])

    def begin(self, tag: str, rest: str) -> None:
        if tag in CLOSES_P or tag in CELLS:
            closes = ("p",) if tag in CLOSES_P else (tag, "p")
            while self.stack[k := self.stack[-1].block].tag in closes:
                self.pop(k)
        attrs = attributes(rest) if rest.strip(" /") else {}
        if rest.rstrip().endswith("/") and tag not in CONTAINERS:
            return
        kind = attrs.get("class", "").split()
        top = self.stack[-1]
        e = Element(tag, tag + ("." + re.sub(r"\d+", "#", kind[0]) if kind else ""), top, len(self.stack), len(self.pieces))
        e.aside = is_aside(tag, attrs) or (tag == "header" and not top.article)
        e.named, e.hinted = noise(tag, attrs)
        self.stack.append(e)
        self.open.setdefault(tag, []).append(e.depth)
        self.elements.append(e)
        if tag in CONTAINERS:
            self.containers.append(e)

    def judge(self) -> None:
        """Decide which elements are kept, and sum the text below each: without half of what is in links."""
        first = next((e for e in self.elements if e.tag == "h1" and not e.link), None)
        for e in reversed(self.elements):  # below before above
            e.holds = e.holds or e is first or (e.tag in ("article", "main") and not e.named)
            e.parent.holds = e.parent.holds or e.holds
        self.weigh(lambda e: False)
        most = self.stack[0].score
        main = {id(e) for e in self.elements if e.named and e.holds and e.score >= SHARE * most}
        for e in self.elements:
            if e.hinted and e.linked <= LINKED * (e.score + 0.5 * e.linked) and (e.article or e.score >= HINT_SHARE * most):
                main.add(id(e))
        # where nothing is left, first those come back that hold such an element, then all
        ruled = lambda e: (e.named or e.hinted) and id(e) not in main
        _ = self.weigh(ruled) or self.weigh(lambda e: e.named and not e.holds) or self.weigh(lambda e: False)
        self.containers = [c for c in self.containers if c.kept]

    def weigh(self, ruled) -> bool:
        """Scores without the text of asides and of what is ruled out; whether any is left."""
        root = self.stack[0]
        root.score = 0.0
        for e in self.elements:
            e.kept, e.score, e.linked = e.parent.kept and not e.aside and not ruled(e), 0.0, 0.0
        for piece, e in self.pieces:
            if e is not None and e.kept:
                e.score += len(piece.strip()) * (0.5 if e.link else 1.0)
                e.linked += len(piece.strip()) if e.link else 0.0
        for e in reversed(self.elements):
            e.parent.score += e.score
            e.parent.linked += e.linked
        return root.score > 0

    def best(self) -> Element | None:
        """The deepest container that holds most of its parents' text; an article or main element counts for more."""
        best, top = None, 0.0
        most = max((c.score for c in self.containers), default=0.0)
        for c in self.containers:
            named = 3.0 if c.tag == "article" else 2.0 if c.tag == "main" else 1.0
            value = c.score * named * (1 + 0.02 * min(c.depth, 50)) if c.score >= (0.25 if named > 1 else 0.8) * most else 0.0
            if value > top:
                best, top = c, value
        return best

    def blocks(self, parts: list[Element] | None) -> str:
        """The kept text of the parts (of the page, if None) in page order, a space between words."""
        out, block = [], []
        for start, end in [(0, len(self.pieces))] if parts is None else [(e.start, e.end) for e in parts]:
            for piece, e in self.pieces[start:end]:
                if e is None:
                    out += "".join(block).split()
                    block = []
                elif e.kept:
                    block.append(piece)
            out += "".join(block).split()
            block = []
        return " ".join(out)


def vote(html: str) -> str | None:
    best = Page(html).best()
    return best.path_text() if best else None


def main_text(html: str, winner: str | None) -> str:
    page = Page(html)
    own = page.best()
    on_path = [c for c in page.containers if c.score and c.name == (winner or "").rpartition(">")[2] and c.path_text() == winner]
    chosen = max(on_path, key=lambda c: c.score, default=None)
    # an article in parts: its siblings on the winning path belong to it
    parts = [c for c in on_path if c.parent is chosen.parent] if chosen else []
    if own is not None and sum(c.score for c in parts) < SHARE * own.score:
        parts = [own]
    return page.blocks(parts or None)


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path, n_pages): the path with the most votes of each host, null without a vote. pages: with_host()."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "path": pa.array([vote(h) for h in batch.column("html").to_pylist()], pa.string())})

    cast = pages.select("host", "html").mapInArrow(votes, "host string, path string")
    counted = cast.groupBy("host", "path").count()
    return counted.groupBy("host").agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.struct(-F.col("count"), F.col("path")))).alias("path"), F.sum("count").alias("n_pages"))


def extract(pages: DataFrame) -> DataFrame:
    bounded_batches(pages.sparkSession)
    pages = with_host(pages)
    winners = written(winning_paths(pages), "winning_paths")
    both = join_groups(pages, winners, "host", "n_pages").select("page_id", "url", "html", "path")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h, p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(found, pa.string()), "n_chars": pa.array([len(x) for x in found], pa.int64())})

    return both.mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op6_html(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return extract(pages.withColumn("page_id", F.col("page_id").cast("long")))
