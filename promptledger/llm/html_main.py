"""Main text of HTML pages by template deduction from equivalence classes.

Pages of one host are made from few templates. A token is a tag in its place (the path of tags and classes above it) or a whole
block of text in its place; its occurrence vector is how often each page of the host holds it. Tokens with equal vectors form
a class; a class is valid if its tokens come in the same order on all its pages, and classes nest as their paths do. Together they
are the template; the text between their tags is what the slots hold. The slot of the article is the outermost ``article`` or
``main`` of a valid class, on pages where it holds more than half of the text outside the template. Everywhere else the whole page
is the slot. The main text are the slot's blocks, except text that belongs to the template and places whose tag, class, id or
role marks a menu, header, footer, sidebar, notice, advert, form or comments.

A text token nests in the class of its place. It belongs to the template if it is on ``HANDFUL`` distinct pages at least and on half of
the pages that have its place, however many these are, and if its own class is valid: a passage that a few articles share stays. So a
block on part of the pages counts in a place of its own, and a block may come more than once a page. A page of whose slot more than half is such text is taken for a
near copy of others rather than a filled template, and keeps it. Without an article this is asked of the core, the deepest place with
most of the text outside the template; around the core, blocks but headings that differ only in numbers ("3 comments") are template too.

A name is no mark where it stands on a wrapper: on a place that is or holds a ``main``, on one that is or holds an outermost
article if all articles of the page are marked, and on one that holds more than half of the text of its article, or of the page
if it holds an article or none is unmarked. There the classes of the host decide. Unmarked articles come first as slots. A tag that is
left out (``form``, ``nav``, ``aside``, ...) is no mark either where it wraps the articles of a page that has none outside of it, and
where it holds nearly all text of the article or page, most of it outside of links: a form around a whole page, a ``nav`` that is
never closed.

Vectors are never collected: a token's vector is the exclusive or of a hash per page and count, so a host with a third of all
pages is summed up before the shuffle like any other. Equal pages of a host count once, so that copies do not look
like a template. Pages that do not show the host's slot (another template, a single page) are judged by themselves in the same way.

Cases: null and empty html give an empty text; a null or odd url is the host ''; unclosed tags end with their parents, text behind
a cut tag is kept; pages of any length and depth are read whole, in time linear in them (tags are scanned once, paths are hashes, marks
and sums are handed along the list of places); slots that tie are taken by path; repeated rows give repeated results; an empty table
gives no rows; other columns are kept, of whatever name, but for an older ``text``.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.llm.common import stored

#: Share of a page's text outside the template that its core holds.
MOST = 0.8
#: Template text is on this share of the pages with its place, and fills no more than this share of a slot; an article holds more than it.
HALF = 0.5
#: Template text is on so many distinct pages at least: fewer may just share a passage.
HANDFUL = 5

_NAMED = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_NUMBER = re.compile(r"\b\d+\b")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: These do not break a block.
_SILENT = frozenset("script style".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEFT_OUT = frozenset("head script style noscript template button select textarea option title iframe svg object canvas xmp noembed noframes".split())
#: Left out as well, unless they wrap the content.
_ASIDE = frozenset("nav footer aside form menu dialog".split())
_MARKED = frozenset(
    "ad ads adv advert advertisement advertisements advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login search share sharing social related "
    "recommended comment comments respond reply replies disqus widget toolbar copyright pagination pager complementary contentinfo".split())
#: Places that hold text rather than whole articles.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption details summary address".split())
_HEADERS = frozenset("header banner masthead".split())
#: An open tag of these closes an open one of the same set.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@dataclass(slots=True)
class Place:
    tag: str
    #: Hash of the names on the way here: the path above and its own tag and classes.
    path: int
    above: Place | None
    out: bool
    header: bool
    article: Place | None
    #: Names of its own mark it: as a header, or as any other thing that is left out.
    by_header: bool = False
    by_name: bool = False
    by_tag: bool = False
    main: bool = False
    slot: bool = False
    linked: bool = False
    depth: int = 0
    #: Itself or the nearest place above that breaks blocks.
    block: Place | None = None
    chars: int = 0
    link_chars: int = 0


@dataclass(slots=True)
class Block:
    place: Place
    text: str


def _enter(tag: str, attributes: str, above: Place | None) -> Place:
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    classes = " ".join(sorted(found.get("class", "").lower().split()))
    path = xxhash.xxh64_intdigest(f"{above.path if above else 0}/{tag}.{classes}".encode("utf-8", "surrogatepass"))
    names = {w.lower() for v in found.values() for w in _NAME.findall(v)}
    inside = above.article if above else None
    marks = names & _MARKED if tag not in ("html", "body") else frozenset()
    by_header = bool(names & _HEADERS or "header" in names) and tag not in ("html", "body", "article", "main")
    out, header = bool(above and above.out) or tag in _LEFT_OUT, bool(above and above.header) or tag == "header"
    place = Place(tag, path, above, out, header, inside, by_header, bool(marks - _HEADERS), tag in _ASIDE)
    place.linked, place.depth = tag == "a" or bool(above and above.linked), above.depth + 1 if above else 1
    place.block = above.block if above and tag in _INLINE else place if tag not in _INLINE else None
    if inside is None and not place.out and (tag in ("article", "main") or found.get("role") in ("main", "article")):
        place.article = place
        place.main = tag == "main" or found.get("role") == "main"
    return place


def _spread_marks(places: list[Place], pieces: list[tuple[Place | None, str]]) -> None:
    """Let the marks that stand on no wrapper hold for all places below them, and say which articles can be slots.

    Places come parents first, so one pass over them hands things down and one pass backwards sums them up.
    """
    tops = [p for p in places if p.article is p]
    marked: dict[int, bool] = {}
    for p in places:
        marked[id(p)] = p.by_name or p.by_header or p.by_tag or bool(p.above and marked[id(p.above)])
    free = [p for p in tops if not marked[id(p)]]
    holding, wrapping = set(), set()
    for p in tops:
        p.slot = p.main or not free or not marked[id(p)]
        for held, wanted in ((holding, True), (wrapping, p.main or not free)):
            q = p if wanted else None
            while q is not None and id(q) not in held:
                held.add(id(q))
                q = q.above

    def measure(skip: bool) -> int:
        for p in places:
            p.chars = p.link_chars = 0
        total = 0
        for place, text in pieces:
            if size := len(text.strip()):
                if not (skip and place and place.out):
                    total += size
                    if place:
                        place.chars += size
                        place.link_chars += size * place.linked
        for p in reversed(places):
            if p.above:
                p.above.chars += p.chars
                p.above.link_chars += p.link_chars
        return total

    # Tags first: they wrap if they hold the articles, or nearly all text outside of links.
    total = measure(False)
    for p in places:
        if p.by_tag:
            around = p.article.chars if p.article not in (None, p) else total if not free else None
            if id(p) in wrapping or around and p.chars > MOST * around and p.link_chars <= HALF * p.chars:
                p.by_tag = False
        p.out = p.out or p.by_tag or bool(p.above and p.above.out)
    total = measure(True)
    for p in places:
        if p.by_name or p.by_header:
            around = p.article.chars if p.article not in (None, p) else total if not free or id(p) in holding else None
            if id(p) in wrapping or around and p.chars > HALF * around:
                p.by_name = p.by_header = False
        p.out = p.out or p.by_name or bool(p.above and p.above.out)
        p.header = p.header or p.by_header or bool(p.above and p.above.header)


def _left_out(place: Place | None) -> bool:
    return place is not None and (place.out or place.header and not (place.article and _heading(place)))


class _Tags:
    """Tags of a page from left to right, in time linear in its length whatever its quotes look like."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.last = {q: html.rfind(q) for q in "\"'"}
        #: Stretch without special characters that was searched last, and what ended it.
        self.searched: tuple[int, int, str] = (0, -1, "")
        #: Special characters outside of quotes from which no tag ends.
        self.endless: set[int] = set()

    def _special(self, at: int) -> tuple[int, str]:
        """The next quote or ``>``, or the end of the page."""
        if not self.searched[0] <= at <= self.searched[1]:
            m = _SPECIAL.search(self.html, at)
            self.searched = (at, m.start(), m[0]) if m else (at, len(self.html), "")
        return self.searched[1:]

    def _end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, quoted ones passed over; -1 if there is none."""
        seen = []
        while True:
            special, kind = self._special(at)
            if kind == ">":
                return special
            seen.append(special)
            if special in self.endless or not kind or self.last[kind] <= special:
                self.endless.update(seen)
                return -1
            at = self.html.index(kind, special + 1) + 1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next tag; comments and declarations have no name."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, len(html) if end < 0 else end + 3, "", "", ""
            if html.startswith(("<!", "<?"), start):
                end = html.find(">", start)
                return start, len(html) if end < 0 else end + 1, "", "", ""
            if m := _NAMED.match(html, start):
                end = self._end(m.end())
                if end >= 0:
                    return start, end + 1, m[1], m[2], html[m.end() : end]
            at = start + 1
        return None


def blocks_of(html: str) -> tuple[list[Place], list[Block]]:
    """Places of a page in order, and its blocks of text that are not left out by their marks."""
    places: list[Place] = []
    blocks: list[Block] = []
    top: Place | None = None
    open_tags: dict[str, int] = {}
    text: list[tuple[Place | None, str]] = []
    found: list[list[tuple[Place | None, str]]] = []
    tags = _Tags(html)
    raw_ends = {}

    def flush() -> None:
        if text:
            found.append(text.copy())
            text.clear()

    def hold(piece: str) -> None:
        if piece and not _left_out(top):
            text.append((top, piece))

    def leave(until: Place | None) -> Place | None:
        """Close places up to ``until``, which stays open."""
        up = top
        while up is not until:
            open_tags[up.tag] -= 1
            up = up.above
        return until

    at, size = 0, len(html)
    while at < size:
        m = tags.next(at)
        if m is None:
            hold(html[at:])
            break
        start, end, slash, name, attributes = m
        hold(html[at:start])
        at = end
        if not name:
            continue
        tag = name.lower()
        if slash:
            if tag not in _INLINE:
                flush()
            if open_tags.get(tag):
                up = top
                while up.tag != tag:
                    up = up.above
                top = leave(up.above)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            else:
                text.append((None, " "))
            continue
        if tag not in _INLINE and tag not in _SILENT:
            flush()
            top = leave(_implied_end(tag, top))
        if tag in _RAW:
            if tag not in raw_ends:
                raw_ends[tag] = re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.I)
            close = raw_ends[tag].search(html, at)
            at = close.end() if close else size
            continue
        if attributes.endswith("/"):
            continue
        top = _enter(tag, attributes, top)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        places.append(top)
    flush()
    _spread_marks(places, [piece for pieces in found for piece in pieces])
    for pieces in found:
        kept = [piece for piece in pieces if not _left_out(piece[0])]
        words = entities.unescape("".join(t for _, t in kept)).split()
        if words:
            blocks.append(Block(_block_place(next(p for p, t in kept if not t.isspace())), " ".join(words)))
    return places, blocks


def _implied_end(tag: str, top: Place | None) -> Place | None:
    """What stays open when a tag opens: an open one of its kind, in whatever inline tags, ends."""
    block = top.block if top else None
    return block.above if block and block.tag in _CLOSES.get(tag, ("p",)) else top


def _heading(place: Place) -> bool:
    return place.block is not None and place.block.tag in _HEADINGS


def _block_place(place: Place | None) -> Place:
    return place and place.block or Place("", 0, None, False, False, None)


def _token(path: int, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _open_token(block: Block) -> int | None:
    """The token of a block whose numbers may be any; none for headings and for blocks without numbers."""
    text, numbers = _NUMBER.subn("0", block.text)
    return _token(block.place.path, f"\0{text}") if numbers and not _heading(block.place) else None


def _below(places: list[Place], blocks: list[Block]) -> dict[int, int]:
    """Characters of the blocks below each path."""
    held: dict[int, int] = {}
    for b in blocks:
        held[id(b.place)] = held.get(id(b.place), 0) + len(b.text)
    below: dict[int, int] = {}
    for p in reversed(places):
        if size := held.get(id(p)):
            below[p.path] = below.get(p.path, 0) + size
            if p.above:
                held[id(p.above)] = held.get(id(p.above), 0) + size
    return below


def _under(path: int, places: list[Place]) -> set[int]:
    """The places of a path and all below them."""
    inside: set[int] = set()
    for p in places:
        if p.path == path or p.above and id(p.above) in inside:
            inside.add(id(p))
    return inside


_ROWS = pa.schema([
    ("host", pa.string()), ("page", pa.int64()), ("token", pa.int64()), ("text_token", pa.bool_()), ("article", pa.bool_()),
    ("count", pa.int32()), ("pos", pa.int32()), ("chars", pa.int64()), ("within", pa.int64()),
])
_ROWS_SQL = "host string, page long, token long, text_token boolean, article boolean, count int, pos int, chars long, within long"


def page_tokens(html: str) -> list[tuple[int, bool, bool, int, int, int, int | None]]:
    """(token, is text, is an outermost article, count, first place, characters below, token of a text's place) of a page.

    The path of text without a place is 0. Text with numbers has a second token, which leaves them open.
    """
    places, blocks = blocks_of(html)
    seen: dict[int, list] = {0: [False, 1, -1, _chars(blocks)]}
    for pos, p in enumerate(places):
        if p.tag not in _INLINE:
            row = seen.get(p.path)
            if row is None:
                seen[p.path] = [p.slot and not p.out, 1, pos, 0]
            else:
                row[1] += 1
    for path, size in _below(places, blocks).items():
        if path in seen:
            seen[path][3] = size
    tokens = {path: _token(path) for path in seen}
    texts: dict[int, list[int]] = {}
    for pos, b in enumerate(blocks):
        for token in (_token(b.place.path, b.text), _open_token(b)):
            if token is not None:
                texts.setdefault(token, [0, len(places) + pos, tokens[b.place.path]])[0] += 1
    out = [(tokens[path], False, *r, None) for path, r in seen.items()]
    return out + [(t, True, False, n, pos, 0, within) for t, (n, pos, within) in texts.items()]


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.withColumns({"__host": host, "__page": F.when(F.col("html").isNotNull(), F.xxhash64("html"))})


def templates(pages: DataFrame) -> DataFrame:
    """Per distinct page (``host``, ``page``): ``slot``, the token of its host's best slot that it shows with text, and ``fixed``,
    its own text tokens that belong to the template. No row holds more than one page shows."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows: list[list] = [[] for _ in _ROWS]
                for host, page, html in zip(*(part.column(c).to_pylist() for c in ("__host", "__page", "html")), strict=True):
                    for token in page_tokens(html):
                        for column, value in zip(rows, (host, page, *token), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ROWS, strict=True)], schema=_ROWS)

    once = _with_host(pages.filter("html is not null")).select("__host", "__page", "html").mapInArrow(tokens, _ROWS_SQL).dropDuplicates(["host", "page", "token"])
    # Side by side, the rows of a token repeat all but their page and place, so the files are smaller.
    rows = stored(once.sortWithinPartitions("host", "token"), "page-tokens")
    vectors = stored(rows.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("page", "count")).alias("vector"), F.count("*").alias("pages"), F.sum("chars").alias("chars"),
        F.bool_or("article").alias("article"), F.first("text_token").alias("text_token"), F.first("within").alias("within")
    ).filter(~F.col("text_token") | (F.col("pages") >= HANDFUL)), "vectors")
    places = vectors.filter("not text_token")
    slots = places.filter("article and chars > 0").withColumn("score", F.col("chars"))
    supported = (
        vectors.filter("text_token").join(places.select("host", F.col("token").alias("within"), F.col("pages").alias("around")), ["host", "within"])
        .filter(F.col("pages") >= HALF * F.col("around")).withColumn("score", F.lit(None).cast("long"))
    )
    of_class = ["host", "vector", "text_token"]
    wanted = slots.select(*of_class, "token", "score").unionByName(supported.select(*of_class, "token", "score"))
    # A class is valid if its tokens come in one order on all its pages.
    members = vectors.join(wanted.select(of_class).distinct(), of_class, "left_semi").select(*of_class, "token")
    orders = (
        rows.select("host", "page", "token", "pos").join(members, ["host", "token"])
        .groupBy(*of_class, "page").agg(F.hash(F.sort_array(F.collect_list(F.struct("pos", "token")))["token"]).alias("order"))
        .groupBy(of_class).agg((F.min("order") == F.max("order")).alias("valid"))
    )
    verdicts = wanted.join(orders.filter("valid"), of_class).select("host", "token", "score")
    shown = rows.filter("text_token or chars > 0").select("host", "page", "token").join(verdicts, ["host", "token"])
    best = F.max_by(F.when(F.col("score").isNotNull(), F.col("token")), F.when(F.col("score").isNotNull(), F.struct("score", "token")))
    return shown.groupBy("host", "page").agg(best.alias("slot"), F.collect_list(F.when(F.col("score").isNull(), F.col("token"))).alias("fixed"))


def _chars(blocks: list[Block]) -> int:
    return sum(len(b.text) for b in blocks)


def _article(places: list[Place], below: dict[int, int], wanted: int | None) -> int | None:
    """Path of the page's article: the one that its host wants, else its largest."""
    marked = {p.path for p in places if p.slot and below.get(p.path)}
    return next((path for path in marked if wanted is not None and _token(path) == wanted), max(sorted(marked), key=lambda path: below[path], default=None))


def main_text(html: str | None, wanted: int | None = None, fixed: frozenset[int] = frozenset()) -> str:
    """Blocks of a page's slot, one a line."""
    if not html:
        return ""
    places, blocks = blocks_of(html)
    own = [b for b in blocks if _token(b.place.path, b.text) not in fixed] if fixed else blocks
    if own:
        below, total = _below(places, own), _chars(own)
        path = _article(places, below, wanted)
        if path is not None and below[path] > HALF * total:
            inside = _under(path, places)
            blocks = _filled([b for b in blocks if id(b.place) in inside], own)
        elif fixed:
            core = max((p for p in places if p.tag not in _TEXT and below.get(p.path, 0) >= MOST * total), key=lambda p: p.depth, default=None)
            inside = blocks
            if core is not None:
                under = _under(core.path, places)
                inside = [b for b in blocks if id(b.place) in under]
            kept = {id(b) for b in _filled(inside, own)}
            within = {id(b) for b in inside}
            kept |= {id(b) for b in own if id(b) not in within and _open_token(b) not in fixed}
            blocks = [b for b in blocks if id(b) in kept]
    return "\n".join(b.text for b in blocks)


def _filled(blocks: list[Block], own: list[Block]) -> list[Block]:
    """Blocks without those of the template, or all of them where these are no small part."""
    kept = {id(b) for b in own}
    out = [b for b in blocks if id(b) in kept]
    return out if _chars(out) >= HALF * _chars(blocks) else blocks


def extract(pages: DataFrame, text: str = "text") -> DataFrame:
    """``pages`` (page_id, url, html) without html, with the main text of every row."""
    found = stored(templates(pages).select(F.col("host").alias("__of"), F.col("page").alias("__as"), F.col("slot").alias("__slot"), F.col("fixed").alias("__fixed")), "templates")
    kept = [c for c in pages.columns if c not in ("html", text)]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                columns = (part.column(c).to_pylist() for c in ("html", "__slot", "__fixed"))
                out = [main_text(h, s, frozenset(f or ())) for h, s, f in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(out, pa.string())], [*kept, text])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in kept), f"`{text}` string"])
    # As many rows as distinct pages: never a broadcast, so that small inputs cost what large ones do.
    joined = _with_host(pages).join(found.hint("merge"), (F.col("__host") == F.col("__of")) & (F.col("__page") == F.col("__as")), "left")
    return joined.select(*kept, "html", "__slot", "__fixed").mapInArrow(texts, schema)
