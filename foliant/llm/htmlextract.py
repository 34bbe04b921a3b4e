"""HTML extraction: the main text of pages, after templates that a site repeats are removed.

The subtrees of all block elements of a page are hashed, bottom-up, and counted in Spark: for each host, and for containers also among
all pages of the same layout at the same place in it, since a host may have too few pages to tell by. The page's own host name
counts as a blank in its texts. A subtree that many different pages have is a template and is deleted. What remains goes
through a second rule: where a page marks up its article, the rest of it goes, and so do elements that are no article by their tag,
role or class, recurring or not. Within an article a class that merely may mean surroundings counts only if the block also recurs.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from hashlib import blake2b

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..session import spread
from .shared import column, delete, hash128, map_arrow, workspace, written

# Names of elements and attributes in HTML, and usual names of what surrounds an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td"
    " tfoot th thead tr ul".split()
)
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tr td th figure figcaption hgroup details summary".split())
LISTS = frozenset("ul ol dl table figure details".split())
GONE = frozenset("nav aside form footer menu dialog button select option input search svg object canvas audio video head".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Whole names of classes and ids, with - for _: what is never part of an article, and what may be.
SURE = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle ad-slot ad-banner ad-container ad-unit ad-box adbanner google-ad sponsored-content"
    " cookie-notice cookie-banner cookie-consent cookie-bar cookiebanner gdpr-consent consent-banner newsletter-signup newsletter-form subscribe-form"
    " share-buttons share-links share-bar social-share social-sharing social-links social-icons breadcrumb breadcrumbs pagination pager"
    " site-header site-footer site-nav site-menu main-nav main-menu nav-bar navbar related-posts related-articles related-links"
    " recommended-articles skip-link skiplink sidebar side-bar widget-area masthead comments comment-list comment-section comments-area"
    " comment-respond respond replies disqus disqus-thread reader-comments user-comments".split()
)
MAYBE = frozenset(
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe"
    " subscription signup nav navigation menu menus sidebars widget widgets toolbar footer share sharing social related recommended"
    " recommendations comment reply login alert announcement".split()
)
HEADS = frozenset(("header", "topbar", "top-bar", "page-header"))
NESTED = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",)}
SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

TEXT, OPEN, CLOSE = 0, 1, 2
#: Elements whose content isn't shown.
UNSEEN = RAW | {"head"}
PARAGRAPHS = FLOW - LISTS
#: Kinds of subtrees: containers; whole lists and tables within an article; paragraphs and the like outside and inside of articles;
#: containers within an article; blocks within an article that may be surroundings by their class; containers by layout and place.
PAGE, BOX, LIST, LOOSE, PROSE, INNER, NAMED, POOLED = range(8)
#: By kind: of how many different pages of the host a template is, of the layout for POOLED, and for paragraphs of which share of
#: those of the host or a section.
LEAST = {BOX: 3, INNER: 5, LIST: 20, LOOSE: 5, PROSE: 20, NAMED: 2, POOLED: 3}
SHARE = {LOOSE: 0.5, PROSE: 0.8}


class Page:
    """The elements of a page, and its content as a list of texts and tags in page order.

    kinds, values: TEXT with the text, or OPEN and CLOSE with an element's name. nodes: name, attributes, and from where to where in
    that list each element reaches; an element comes after the one that holds it.
    """

    def __init__(self, source: str):
        self.kinds: list[int] = []
        self.values: list[str] = []
        self.nodes: list[list] = []
        self.stack: list[int] = []
        self.open: Counter[str] = Counter()
        at, lower = 0, None
        while (m := TAG.search(source, at)) is not None:
            if m.start() > at:
                self._put(TEXT, source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                self._close(name)
                continue
            self._start(name, m[3])
            if name in RAW:
                lower = source.lower() if lower is None or len(lower) != len(source) else lower
                end = lower.find(f"</{name}", at) if len(lower) == len(source) else _find(source, name, at)
                at = len(source) if end < 0 else end
        if at < len(source):
            self._put(TEXT, source[at:])
        while self.stack:
            self._pop()

    def _put(self, kind: int, value: str) -> None:
        self.kinds.append(kind)
        self.values.append(value)

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCK and name != "head" and self.open["head"]:
            self._end_open(("head",), ())
        if name in BLOCK and self.open["p"]:
            self._end_open(("p",), BLOCK)
        if name in NESTED and any(self.open[x] for x in SAME.get(name, (name,))):
            self._end_open(SAME.get(name, (name,)), NESTED[name])
        self.nodes.append([name, attributes, len(self.kinds), 0])
        self._put(OPEN, name)
        if name in VOID or attributes.endswith("/") and name not in BLOCK and name not in RAW:
            self.nodes[-1][3] = len(self.kinds)
        else:
            self.stack.append(len(self.nodes) - 1)
            self.open[name] += 1

    def _pop(self) -> None:
        node = self.nodes[self.stack.pop()]
        self._put(CLOSE, node[0])
        node[3] = len(self.kinds)
        self.open[node[0]] -= 1

    def _end_open(self, names: tuple[str, ...], bounds) -> None:
        """Ends the innermost open element of these names, unless one of the bounds stands before it."""
        for depth in range(len(self.stack) - 1, -1, -1):
            name = self.nodes[self.stack[depth]][0]
            if name in names:
                while len(self.stack) > depth:
                    self._pop()
                return
            if name in bounds:
                return

    def _close(self, name: str) -> None:
        if not self.open[name]:
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            found = self.nodes[self.stack[depth]][0]
            if found == name:
                while len(self.stack) > depth:
                    self._pop()
                return
            if name not in BLOCK and found in BLOCK:
                return  # an inline end tag doesn't end a block

    def articles(self) -> list[int]:
        """The elements that hold the page's main text: the outermost articles, or the main elements where they hold text outside of
        articles; none if there are neither. Articles and main elements within what surrounds the main text, such as the teasers in
        an aside, don't count unless there are no others and they hold more text than the page has outside of such surroundings."""
        found: dict[tuple[bool, bool], list[int]] = {}
        ends, around, taken = {}, -1, []
        for n, (name, attributes, start, stop) in enumerate(self.nodes):
            if name == "article" and not is_comment(attributes):
                kind = True
            elif name == "main" or "main" in attributes and _attributes(attributes).get("role") == "main":
                kind = False
            else:
                if start >= around and is_around(name, attributes, False):
                    around = stop
                    taken.append((start, stop))
                continue
            key = kind, start < around
            if start >= ends.get(key, -1):
                found.setdefault(key, []).append(n)
                ends[key] = stop
        for inside in (False, True):
            articles, main = found.get((True, inside), []), found.get((False, inside), [])
            if articles and main:
                without = _outer(sorted([*(() if inside else taken), *((self.nodes[n][2], self.nodes[n][3]) for n in articles)]))
                within = {n for n in articles if any(self.nodes[m][2] > self.nodes[n][2] and self.nodes[m][3] < self.nodes[n][3] for m in main)}
                if not within and self.text([(self.nodes[m][2], self.nodes[m][3]) for m in main], without):
                    return main
            if chosen := articles or main:
                regions = [(self.nodes[n][2], self.nodes[n][3]) for n in chosen]
                if inside and len(self.text(regions, [])) < len(self.text([(0, len(self.kinds))], taken)):
                    return []
                return chosen
        return []

    def hashes(self, site: str = "") -> dict[int, tuple[int, int]]:
        """By the place where an element starts: a hash of it with all that it holds and shows, names and texts, white space and the
        name of the site aside, without attributes, and the number of letters of its text. -1 stands for the whole page. One pass,
        bottom-up: an element's hash goes into that of the one around it."""
        out: dict[int, tuple[int, int]] = {}
        blank = re.compile(re.escape(site), re.I) if site else None
        ends = {start: stop for _, _, start, stop in self.nodes}
        stack, unseen = [[-1, blake2b(digest_size=8), 0]], 0
        for i, (kind, value) in enumerate(zip(self.kinds, self.values)):
            if i < unseen:
                continue
            if kind == TEXT:
                words = (blank.sub("", value) if blank and len(value) >= len(site) else value).split()
                stack[-1][1].update(f"{TEXT}{' '.join(words)}\n".encode("utf-8", "replace"))
                stack[-1][2] += sum(map(len, words))
                continue
            if kind == OPEN:
                if value in UNSEEN:
                    unseen = ends[i]
                    continue
                stack.append([i, blake2b(f"{OPEN}{value}\n".encode("utf-8", "replace"), digest_size=8), 0])
            if kind == CLOSE or ends[i] == i + 1:
                start, digest, letters = stack.pop()
                raw = digest.digest()
                out[start] = int.from_bytes(raw, "big", signed=True), letters
                stack[-1][1].update(raw)
                stack[-1][2] += letters
        out[-1] = 0, stack[0][2]
        return out

    def places(self) -> tuple[list[int], int]:
        """For each element a hash of its place, which is the names on the way to it, each with its number among its siblings of
        that name; and a hash of the page's layout, which is the names of its outermost blocks, those in a row once."""
        out, layout, stack = [], [], [(len(self.kinds) + 1, 0, {})]
        for name, _, start, stop in self.nodes:
            while stack[-1][0] <= start:
                stack.pop()
            _, around, seen = stack[-1]
            seen[name] = nth = seen.get(name, 0) + 1
            outer = around == 0 and name in ("html", "body")
            here = 0 if outer else xxhash.xxh64_intdigest(f"{around}/{name}{nth}")
            if around == 0 and not outer and name in BLOCK and name not in UNSEEN and layout[-1:] != [name]:
                layout.append(name)
            out.append(here)
            stack.append((stop, here, {}))
        return out, signed(xxhash.xxh64_intdigest(" ".join(layout)))

    def text(self, regions: list[tuple[int, int]], without: list[tuple[int, int]]) -> str:
        """Text of the regions, outside of the ranges `without`, each sorted by start."""
        parts, skip = [], 0
        for start, stop in regions:
            i = start
            while i < stop:
                while skip < len(without) and without[skip][1] <= i:
                    skip += 1
                if skip < len(without) and without[skip][0] <= i:
                    i = without[skip][1]
                    parts.append(" ")
                    continue
                kind, value = self.kinds[i], self.values[i]
                if kind == TEXT:
                    parts.append(entities.unescape(value) if "&" in value else value)
                elif value in BLOCK or value == "br":
                    parts.append(" ")
                i += 1
            parts.append(" ")
        return " ".join("".join(parts).split())


def _find(source: str, name: str, at: int) -> int:
    m = re.compile(f"</{re.escape(name)}", re.I).search(source, at)
    return m.start() if m else -1


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(source)}


def _names(found: dict[str, str]) -> set[str]:
    """The whole class names and the id."""
    return {*f"{found.get('class', '')} {found.get('id', '')}".lower().replace("_", "-").split()}


def is_comment(attributes: str) -> bool:
    """Whether an article element is a reader's comment."""
    return "comment" in attributes and bool({"comment", "comment-body", "reply"} & {*_attributes(attributes).get("class", "").lower().split()})


def is_around(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element isn't part of an article by its tag, role or class. inside: it lies within the main text."""
    if name in GONE or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    found = _attributes(attributes)
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES:
        return True
    if name == "article":
        return is_comment(attributes)
    names = _names(found)
    return not SURE.isdisjoint(names) or not inside and not (MAYBE.isdisjoint(names) and HEADS.isdisjoint(names))


def may_be_around(attributes: str) -> bool:
    """Whether an element within the main text has a class or id that would make it surroundings elsewhere."""
    return bool(attributes) and not MAYBE.isdisjoint(_names(_attributes(attributes)))


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class Content:
    """What of a page may be main text: its regions, what is cut out of them by name, and the subtrees that could be templates.

    candidates: node and kind of each block element that is shown, wherever it stands. names: whether the second rule holds; without
    it the whole page is the region, and nothing but what isn't shown is cut. site: the page's host.
    """

    def __init__(self, source: str, names: bool = True, site: str = ""):
        self.page = page = Page(source)
        self.site = site
        self.main = page.articles() if names else []
        self.regions = [(page.nodes[n][2], page.nodes[n][3]) for n in self.main] or [(0, len(page.kinds))]
        self.cut: list[tuple[int, int]] = []
        self.candidates: list[tuple[int, int]] = []
        self.places, self.layout = page.places()
        chosen = set(self.main)
        r, end, unseen = 0, -1, -1
        for n, (name, attributes, start, stop) in enumerate(page.nodes):
            while r < len(self.regions) and self.regions[r][1] <= start:
                r += 1
            if start < unseen or n in chosen:
                continue
            inside = r < len(self.regions) and self.regions[r][0] <= start
            prose = inside and bool(self.main)
            if name in UNSEEN:
                unseen = stop
            elif prose and may_be_around(attributes):
                self.candidates.append((n, NAMED))
            elif name in BLOCK and name not in ("html", "body", "article", "main"):
                self.candidates.append((n, (PROSE if prose else LOOSE) if name in PARAGRAPHS else BOX if not prose else LIST if name in LISTS else INNER))
            if inside and start >= end and (name in UNSEEN or names and is_around(name, attributes, bool(self.main))):
                self.cut.append((start, stop))
                end = stop

    def subtrees(self) -> list[tuple[int, int, int, int, int]]:
        """Kind, hash, start, stop and number of letters of the candidates with text. What has more than two thirds of the text of
        the regions isn't among them, for it is the text itself; what lies outside of the regions is, however large. A container
        comes as POOLED too, with a hash of its place, unless it has more than a third of the page's text: that much is
        rather an article that several sites took over."""
        if not self.candidates:
            return []
        found, nodes = self.page.hashes(self.site), self.page.nodes
        most = 2 * (sum(found[nodes[n][2]][1] for n in self.main) if self.main else found[-1][1])
        most -= 2 * sum(found[start][1] for start, _ in self.cut if start in found)
        out, r = [], 0
        for n, kind in self.candidates:
            _, _, start, stop = nodes[n]
            while r < len(self.regions) and self.regions[r][1] <= start:
                r += 1
            h, letters = found[start]
            outside = r == len(self.regions) or stop <= self.regions[r][0]
            if letters and (outside or 3 * letters <= most):
                out.append((kind, h, start, stop, letters))
                if kind == BOX and 3 * letters <= found[-1][1]:
                    out.append((POOLED, signed(xxhash.xxh64_intdigest(f"{h} {self.places[n]}")), start, stop, letters))
        return out

    def text(self, templates: set[int]) -> str:
        """The text that is left after the templates, given by their hashes, are deleted and the second rule is applied. Where that is
        nothing, the page is a copy of others: the largest subtree of its text counts as its own and stays whole."""
        if templates:
            found = [x for x in self.subtrees() if x[1] in templates]
            if text := self._without(found):
                return text
            within = [x for x in found if any(start <= x[2] < stop for start, stop in self.regions)]
            if within:
                _, _, start, stop, _ = max(within, key=lambda x: x[4])
                if text := self._without([x for x in found if x[3] <= start or x[2] >= stop]):
                    return text
        return self._without([])

    def _without(self, found: list[tuple[int, int, int, int, int]]) -> str:
        return self.page.text(self.regions, _outer(sorted([*self.cut, *(x[2:4] for x in found)])))


def _outer(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of nested ranges, sorted by start, the outer ones."""
    out: list[tuple[int, int]] = []
    for start, stop in ranges:
        if not out or start >= out[-1][1]:
            out.append((start, stop))
        elif stop > out[-1][1]:
            out[-1] = (out[-1][0], stop)
    return out


def host(url: Column) -> Column:
    """Host of a URL in lower case, without port and user; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url.cast("string")), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]*)", 1), F.lit(""))


def section(url: Column) -> Column:
    """First folder of a URL's path; empty if there is none."""
    return F.coalesce(F.regexp_extract(url.cast("string"), r"//[^/?#]*/([^/?#]+)/", 1), F.lit(""))


KEY = ("host", "section", "h1", "h2")


def subtrees(names: bool):
    """KEY and layout of the page, kind and hash of each of its subtrees that could be a template, and a hash of the page's text by the
    second rule alone. A row of the kind PAGE stands for the page itself."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            at, kinds, hashes, pages, layouts = [], [], [], [], []
            for i, (value, site) in enumerate(zip(batch["html"], batch["site"])):
                content = Content(value.as_py() or "", names, site.as_py())
                page = int.from_bytes(blake2b(content.text(set()).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
                for kind, h in {(PAGE, 0), *(x[:2] for x in content.subtrees())}:
                    at.append(i)
                    kinds.append(kind)
                    hashes.append(h)
                    pages.append(page)
                    layouts.append(content.layout)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[c].take(rows) for c in KEY), pa.array(kinds, pa.int32()), pa.array(hashes, pa.int64()), pa.array(pages, pa.int64()), pa.array(layouts, pa.int64())], [*KEY, "kind", "subtree", "page", "layout"])

    return run


def templates(pages: DataFrame, least: Mapping[int, int] = LEAST, names: bool = True, at: str | None = None) -> DataFrame:
    """KEY, templates: for each page (KEY, site, html) with any, the hashes of its subtrees that are templates. at: where steps are written.

    Containers, and whole lists and tables, are templates by the number of different texts of the host that have them, however
    large the host is; containers also by that of all hosts with the same layout, at the same place of it. Paragraphs that articles
    share are told from templates by their share of the host or of a section of it.
    Copies of a page count once, else the text that they share would look like a template. A page's list is no longer than the page.
    """
    at = at or workspace(pages.sparkSession, "pages")
    found = written(map_arrow(spread(pages.select("html", "site", *KEY)), subtrees(names), "host long, section long, h1 long, h2 long, kind int, subtree long, page long, layout long"), f"{at}/subtrees")
    whole, part = F.array("host"), F.array("host", F.xxhash64("host", "section"))
    scope = F.explode(F.when(F.col("kind").isin(PAGE, *SHARE), part).when(F.col("kind") == POOLED, F.array("layout")).otherwise(whole)).alias("scope")
    scoped = found.select(scope, "kind", "subtree", "page", *KEY)
    by = ["scope", "kind", "subtree"]
    number = F.create_map(*[F.lit(x) for kind in LEAST for x in (kind, least.get(kind, LEAST[kind]))])[F.col("kind")]
    counts = scoped.select(*by, "page").distinct().groupBy(*by).agg(F.count("*").alias("n"))
    counts = written(counts.where((F.col("kind") == PAGE) | (F.col("n") >= number)), f"{at}/counts")
    sizes = counts.where(F.col("kind") == PAGE).select("scope", F.col("n").alias("pages"))
    share = F.create_map(*[F.lit(x) for kind, n in SHARE.items() for x in (kind, n)])[F.col("kind")]
    shared = counts.where(F.col("kind").isin(*SHARE)).join(sizes, "scope").where(F.col("n") >= share * F.col("pages"))
    many = counts.where(~F.col("kind").isin(PAGE, *SHARE)).select(*by).union(shared.select(*by))
    many = written(many, f"{at}/recurring")
    return scoped.join(many, by).groupBy(*KEY).agg(F.collect_set("subtree").alias("templates"))


def extract(names: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = []
            for value, found, site in zip(batch["packed"], batch["templates"], batch["site"]):
                html = zstandard.decompress(value.as_py()).decode() if value.is_valid else ""
                texts.append(Content(html, names, site.as_py()).text(set(found.values.to_pylist()) if found.is_valid else set()))
            text = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["url"], text, pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return run


def packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column compressed: html on its way through a shuffle."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in source:
        small = [squeeze.compress(value.as_py().encode()) if value.is_valid else None for value in batch["html"]]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(small, pa.binary())], [*batch.schema.names[:-1], "packed"])


def keyed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, html, site (the host's name) and KEY: hashes of host and section, and two of the html."""
    html, url = column(html_col).cast("string"), column(url_col)
    return pages.select(column(id_col).alias("id"), url.alias("url"), html.alias("html"), host(url).alias("site"), F.xxhash64(host(url)).alias("host"), F.xxhash64(section(url)).alias("section"), *hash128(html))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: Mapping[int, int] = LEAST, names: bool = True) -> DataFrame:
    """id_col, url_col, text, n_chars for each row of pages.

    least: by kind (BOX, INNER, LIST, LOOSE, PROSE, NAMED; POOLED for a layout), of how many different pages of its host a template is. names: whether the second rule
    follows; without it the counts alone decide. Null or empty html gives an empty text;
    pages with a null url count as one host. Malformed html is read as browsers do, roughly: an end tag without a start is passed
    over, what is open at the end is closed, a tag that the page's end cuts off is dropped. Ids may be null or repeated; rows with
    the same html on one host count once. An empty table gives no rows. Other columns aren't read, whatever their names.
    """
    spark, at = pages.sparkSession, workspace(pages.sparkSession, "pages")
    rows = keyed(pages, id_col, url_col, html_col)
    found = written(templates(rows, least, names, at), f"{at}/templates")
    for done in ("subtrees", "counts", "recurring"):
        delete(spark, f"{at}/{done}")
    kinds = {f.name: f.dataType for f in rows.schema}
    small = map_arrow(spread(rows.select("id", "url", "site", *KEY, "html")), packed, StructType([*(StructField(n, kinds[n]) for n in ("id", "url", "site", *KEY)), StructField("packed", BinaryType())]))
    # Lists grow with the pages, so they aren't broadcast, whatever their size; copies of a page are split as a skewed key.
    both = small.join(found.hint("merge"), list(KEY), "left").select("id", "url", "site", "packed", "templates")
    out = map_arrow(both, extract(names), StructType([StructField("id", kinds["id"]), StructField("url", kinds["url"]), StructField("text", StringType()), StructField("n_chars", LongType())]))
    return out.toDF(id_col, url_col, "text", "n_chars")
