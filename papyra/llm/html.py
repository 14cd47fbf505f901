"""Main text of web pages, with site templates removed.

A first pass hashes the block elements' subtrees of each page, and Spark counts them per
host.  A second pass extracts the text, leaving out elements whose role shows that they are
not the article (menus, headers, footers, sidebars, notices, adverts, forms, comments) and
subtrees that recur across many pages of the host.  An article's own paragraphs, headings
and list items are never deleted for recurring: two articles may share a sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.kernel import lean
from papyra.llm.scratch import Scratch, bytes_in

BROADCAST_BYTES = 32 << 20
SALTS = 64

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "math")
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption""".split())
NOT_ARTICLE = frozenset("head nav footer aside form button select option optgroup datalist input menu dialog search object applet canvas audio video map".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt tr td th figcaption caption".split())
PARAGRAPH = frozenset("p blockquote pre dd div section".split())
HEADINGS = frozenset("h1 h2 h3 hgroup".split())
WALLS = frozenset(("article", "main", "body"))
CELL = frozenset(("td", "th", "br"))
# Class, id and role words that mark what is not the article, and words that may stand beside them in one name.
CHROME = frozenset("""nav navbar navigation menu menus submenu topbar masthead footer sidebar sidenav aside rail ad ads adv advert adverts
advertisement advertising adsense adslot sponsor sponsored sponsorship promo promotion promoted banner cookie cookies consent gdpr notice notices alert
popup modal overlay toast newsletter subscribe subscription signup login share sharing social related recommended recommendations
comment comments commentlist disqus respond replies breadcrumb breadcrumbs pagination pager widget widgets skip toolbar
contentinfo complementary navigationbar taboola outbrain""".split())
BESIDE = frozenset("""area article articles author avatar bar block body bottom box button buttons container content count entry field form global group header head
heading holder icons info inner item items js law left line link links list main message meta outer page panel policy popup post posts primary reply right row
secondary section site slot small sticky stories story text the thread title to top unit user v wrap wrapper x""".split())
# Words of CHROME that a page may also set around its story.
UNSURE = frozenset("aside rail banner notice notices alert popup modal overlay toast share sharing widget widgets skip complementary".split())
CLOSED_BY_BLOCK = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3
h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul""".split())
#: Start tag -> open elements that it ends.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = frozenset("html body table td th caption button article section div main aside nav footer header form ul ol dl blockquote".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found.group(1).lower() if found else ""


#: What a name says of its element: nothing, that it is beside the article unless it holds it, that it is not the article.
ARTICLE_OR_NONE, BESIDE_ARTICLE, NO_ARTICLE = 0, 1, 2


def _marks_chrome(token: str) -> int:
    """Whether a whole class, id or role name is one of CHROME, or is made of such words and BESIDE ones; BESIDE_ARTICLE if all of those are UNSURE."""
    low = token.lower()
    pieces = [low] if low in CHROME else [w.lower() for w in PIECES.findall(token)]
    own = [w for w in pieces if w in CHROME]
    if not own or not all(w in CHROME or w in BESIDE for w in pieces):
        return ARTICLE_OR_NONE
    return BESIDE_ARTICLE if all(w in UNSURE for w in own) else NO_ARTICLE


def _is_chrome(tag: str, attributes: str) -> int:
    if tag in NOT_ARTICLE:
        return NO_ARTICLE
    out = ARTICLE_OR_NONE
    if not attributes or tag in ("html", "body", "main", "article"):
        return out
    for m in ATTRIBUTE.finditer(attributes):
        name = m.group(1).lower()
        value = m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("class", "id", "role"):
            out = max(out, *map(_marks_chrome, value.split()), ARTICLE_OR_NONE)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return NO_ARTICLE
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return NO_ARTICLE
    return out


class Page:
    """The block elements of a page, with subtree hashes, and its blocks of text.

    Reading takes time in proportion to the page: open elements are known by name and
    place, so no tag looks through the elements that are open.
    """

    def __init__(self, html: str):
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.hash: list[int] = []
        self.within: list[int] = []  # 2 in an article, 1 in a main, else 0
        self.beside: list[int] = []  # the outermost element around that a name sets beside the article, or -1
        self.blocks: list[tuple[int, str]] = []
        self._parts: list[list[str]] = []
        self._stack: list[tuple[str, int, bool]] = []  # name, block element or its parent, not the article
        self._open_at: dict[str, list[int]] = {}  # places in the stack, by name
        self._scopes: list[int] = []
        self._walls: list[int] = []  # places that an inline end tag does not reach beyond
        self._text: list[str] = []
        self._dropping = 0
        self._heads = 0  # open page headers of an article, of which only headings count
        self._headings = 0
        self._open("html-root", "", True)
        self._read(html)
        while self._stack:
            self._close()
        self._flush(0)

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            found = TOKEN.search(html, at)
            stop = found.start() if found else end
            if stop > at:
                self._chars(html[at:stop])
            if not found:
                break
            at = found.end()
            name = found.group(2) or found.group(5)
            if not name:
                continue
            name, closing = name.lower(), found.group(1) or found.group(4)
            if closing:
                self._end(name)
                continue
            self._start(name, found.group(3) or found.group(6) or "")
            if name in RAW_END and not html[at - 2 : at] == "/>":
                over = RAW_END[name].search(html, at)
                stop = over.start() if over else end
                shut = html.find(">", stop)
                at = shut + 1 if over and shut >= 0 else end

    def _chars(self, text: str) -> None:
        if self._dropping or self._heads and not self._headings:
            if not text.isspace():
                self._parts[self._stack[-1][1]].append(text)
            return
        self._text.append(text)

    def _flush(self, owner: int) -> None:
        if self._text:
            text = " ".join(unescape("".join(self._text)).split())
            self._text.clear()
            if text:
                self.blocks.append((owner, text))
                self._parts[owner].append(text)

    def _open(self, name: str, attributes: str, block: bool) -> None:
        parent = self._stack[-1][1] if self._stack else -1
        mark = _is_chrome(name, attributes)
        # what only a name sets beside the article is read, and judged by the prose that it holds
        aside = block and mark == BESIDE_ARTICLE
        chrome = mark != ARTICLE_OR_NONE and not aside
        if block:
            if parent >= 0:
                self._flush(parent)
            above = self.within[parent] if parent >= 0 else 0
            self.tag.append(name)
            self.parent.append(parent)
            self.hash.append(0)
            around = self.beside[parent] if parent >= 0 else -1
            self.beside.append(len(self.tag) - 1 if aside and around < 0 and not self._dropping else around)
            self.within.append(max(above, 2 if name == "article" else 1 if name == "main" or 'role="main"' in attributes else 0) if not self._dropping and not chrome else above)
            self._parts.append([])
            if name == "header":
                if self.within[-1]:
                    self._heads += 1
                else:
                    chrome = True
            parent = len(self.tag) - 1
        self._dropping += chrome
        self._headings += name in HEADINGS
        place = len(self._stack)
        self._open_at.setdefault(name, []).append(place)
        if name in SCOPE:
            self._scopes.append(place)
        if name in WALLS:
            self._walls.append(place)
        self._stack.append((name, parent, chrome))

    def _close(self) -> None:
        name, element, chrome = self._stack.pop()
        self._open_at[name].pop()
        if name in SCOPE:
            self._scopes.pop()
        if name in WALLS:
            self._walls.pop()
        self._headings -= name in HEADINGS
        if self.tag[element] == name and (not self._stack or self._stack[-1][1] != element):
            self._flush(element)
            self.hash[element] = xxhash.xxh64_intdigest("\x1f".join((name, *self._parts[element])).encode("utf-8", "surrogatepass"))
            if self.parent[element] >= 0:
                self._parts[self.parent[element]].append(f"\x1e{self.hash[element]:x}")
            if name == "header" and not chrome:
                self._heads -= 1
        self._dropping -= chrome

    def _start(self, name: str, attributes: str) -> None:
        if name in CELL:
            self._chars(" ")
        if name in VOID:
            if name == "hr":
                self._flush(self._stack[-1][1])
            return
        if name in ENDS:
            self._end_any(ENDS[name])
        elif name in CLOSED_BY_BLOCK:
            self._end_any(("p",))
            if len(name) == 2 and name[0] == "h" and name != "hr":
                self._end_any(("h1", "h2", "h3", "h4", "h5", "h6"))
        self._open(name, attributes, name in BLOCK)

    def _last(self, name: str) -> int:
        places = self._open_at.get(name)
        return places[-1] if places else 0

    def _shut(self, place: int) -> None:
        while len(self._stack) > place:
            self._close()

    def _end_any(self, names: tuple[str, ...]) -> None:
        place = max(self._last(n) for n in names)
        if place and place >= (self._scopes[-1] if self._scopes else 0):
            self._shut(place)

    def _end(self, name: str) -> None:
        place = self._last(name)
        if place and (name in BLOCK or place >= (self._walls[-1] if self._walls else 0)):
            self._shut(place)

    def _candidate(self, element: int) -> bool:
        """Whether an element may be deleted for recurring."""
        tag = self.tag[element]
        return tag not in ("html-root", "html", "body", "article", "main") and not (self.within[element] and tag in PROSE)

    def candidates(self) -> set[int]:
        return {h for k, h in enumerate(self.hash) if h and self._candidate(k)}

    def text(self, template: set[int]) -> str:
        """The blocks that are left, in page order.

        They come from articles, else from a main, else from the body; but a wider scope
        is taken if twice as much prose is in it, as where an article element is a teaser.
        If nothing is left without the template, paragraphs of prose stay.  No name that may mean
        anything takes the element that holds nearly all of the page's prose.
        """
        gone: list[bool] = []
        for k, parent in enumerate(self.parent):
            gone.append(self.hash[k] in template and self._candidate(k) or parent >= 0 and gone[parent])
        story = self._story()
        own = [(owner, x) for owner, x in self.blocks if self.beside[owner] in (-1, story)]
        left = [(owner, x) for owner, x in own if not gone[owner]]
        if not left:
            left = [(owner, x) for owner, x in own if self._is_prose(owner, x)]
        scope = max((self.within[owner] for owner, _ in left), default=0)
        for wider in range(scope - 1, -1, -1):
            prose = [0, 0]
            for owner, x in left:
                if self.within[owner] >= wider and self._is_prose(owner, x):
                    prose[self.within[owner] >= scope] += len(x)
            if prose[0] > 2 * prose[1]:
                scope = wider
        return "\n".join(x for owner, x in left if self.within[owner] >= scope)

    def _story(self) -> int:
        """The element that a name sets beside the article though it holds the story: more than twice as much prose as there is text outside all such elements; or -1."""
        outside, prose = 0, {}
        for owner, x in self.blocks:
            if self.beside[owner] < 0:
                outside += len(x)
            elif self._is_prose(owner, x):
                prose[self.beside[owner]] = prose.get(self.beside[owner], 0) + len(x)
        most = max(prose, key=lambda k: (prose[k], -k), default=-1)
        return most if most >= 0 and prose[most] > 2 * outside else -1

    def _is_prose(self, owner: int, text: str) -> bool:
        return self.tag[owner] in PARAGRAPH and len(text) >= 80


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@lean
def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, page, subtrees): a hash of the whole page, and its distinct subtrees."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 512):
            batch = whole.slice(lo, 512)
            html = batch.column("html").to_pylist()
            hosts = [host_of(u) for u in batch.column("url").to_pylist()]
            own = [_signed(xxhash.xxh64_intdigest(h or "")) for h in html]
            subtrees = [[_signed(x) for x in Page(h or "").candidates()] for h in html]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(own, pa.int64()), pa.array(subtrees, pa.list_(pa.int64()))], ["host", "page", "subtrees"])


def site_templates(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """host, subtrees: those on at least ``ratio`` of the host's distinct pages and on ``min_pages``.

    Copies of one page count once, so that copying does not make an article a template.
    Counts are combined in each task before they are shuffled.  A host's list is at most
    (mean elements of a page) / ratio long, however many pages it has.
    """
    parsed = pages.select("url", "html").mapInArrow(_subtrees, "host string, page long, subtrees array<long>")
    distinct = parsed.groupBy("host", "page").agg(F.first("subtrees").alias("subtrees"))
    # a null subtree counts the pages
    counts = distinct.select("host", F.explode(F.concat("subtrees", F.array(F.lit(None).cast("long")))).alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("n"))
    often = counts.where((F.col("n") >= min_pages) & F.col("subtree").isNotNull())
    totals = counts.where("subtree IS NULL").select("host", F.col("n").alias("pages"))
    return often.join(totals, "host").where(F.col("n") >= ratio * F.col("pages")).groupBy("host").agg(F.collect_list("subtree").alias("subtrees"))


def main_text(pages: DataFrame, *, ratio: float = 0.3, min_pages: int = 3) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    Text comes from the article elements, else from main, else from the body (Page.text has
    the exceptions).  Null or empty html, and pages without an article text, give an empty
    text.  Pages with a null or odd url share a host of their own.  Repeated rows are one
    page in the counts.  Other columns are ignored.  Unclosed and crossing tags are read as
    browsers roughly do.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    pages = pages.select("page_id", "url", "html")
    templates = scratch.save(site_templates(pages, ratio, min_pages), "templates")
    # the host as host_of() has it, computed where rows are joined
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    left = pages.withColumn("_host", host)
    if bytes_in(spark, templates.scratch_path) <= BROADCAST_BYTES:
        joined = left.join(F.broadcast(templates.select(F.col("host").alias("_host"), "subtrees")), "_host", "left")
    else:  # a host may hold a third of the pages
        salted = templates.select(F.col("host").alias("_host"), "subtrees", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        left = left.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, ["_host", "_salt"], "left")

    @lean
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                subtrees = batch.column("subtrees").to_pylist()
                texts = [Page(h or "").text({x & 0xFFFFFFFFFFFFFFFF for x in s or ()}) for h, s in zip(batch.column("html").to_pylist(), subtrees, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = joined.select("page_id", "url", "html", "subtrees").mapInArrow(extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
