"""Main text of web pages by removing each host's template.

Element subtrees get a hash of their tags and text, made from those of their children. Spark counts on how many pages of a
host each hash stands; subtrees that recur on many of them are template and are deleted, wherever they stand on a page. (What
lies in a recurring subtree recurs too, so a block of text is judged by the subtree right around it.) Inside an article
more recurrence is asked for, and only small parts of an article are deleted so: pages may share most of a text.

Comments, adverts and notices in an article have another text on each page. They recur by shape: a container's tag, role, class and
id without digits, and what of these stands around and in it. Shapes that stand in articles on many pages of a host, and hold a
small part of their text, are deleted, whatever their names; names that say content (a caption, an introduction) stay. Rules on
tags, roles and class words delete what is never article text (scripts, forms, menus, adverts, reader comments), also
where a host has too few pages to show its template. A form or a class or id word around an article doesn't delete it.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.shared import pieces, written

#: A subtree is template if it stands on so many pages of its host, and on this share of them.
LEAST_PAGES, LEAST_SHARE = 3, 0.2
#: The same inside an article, and the share of its text that is deleted so at most (if more recurs, nothing is).
INSIDE_PAGES, INSIDE_PAGE_SHARE, INSIDE_TEXT_SHARE = 20, 0.5, 0.2
#: Shapes in articles are template if they stand on the same numbers of pages as subtrees elsewhere and hold at most this share of
#: the articles' text; if more than that of one article would go by shapes, nothing does.
SHAPE_TEXT_SHARE = 0.3
#: More template subtrees than this are joined by sort-merge and not broadcast.
BROADCAST_SUBTREES = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Never text, or never the article.
DROPPED = frozenset("head script style noscript template iframe object embed svg math canvas audio video map select option datalist button input textarea fieldset dialog nav aside menu footer title".split())
#: Inside an article a header holds its title; elsewhere it is the site's.
OUTSIDE = frozenset(["header"])
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that mark what isn't the article.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside widget footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments commentlist respond reply replies disqus discussion pagination pager skip toolbar masthead copyright disclaimer".split()
)
#: Of these, those that mark a container in any part of a name (comment-thread, ad-slot); words that turn a name into a statement.
STRONG = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored comment comments commentlist disqus respond newsletter cookie cookies".split())
STATING = frozenset("has no not with without show hide is js page single open enabled disabled off count form".split())
CONTAINERS = frozenset("div section aside ul ol dl details center".split())
#: Words of names of containers that hold an article's own text.
CONTENT = frozenset(
    "article body content text entry post story prose main page lead lede intro introduction summary abstract title subtitle headline heading byline author date time meta para paragraph section "
    "chapter figure image img photo picture caption media gallery video code highlight listing quote pullquote blockquote table list item items note notes footnote footnotes reference references "
    "wrap wrapper container inner outer row col column columns grid block left right center layout box answer question step steps recipe faq transcript poem verse map chart math".split()
)
MAIN = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph, and items that end one of their kind.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NAME = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


def marks(tag: str, known: dict[str, str], inside: bool) -> bool:
    """Whether a class or id says that an element isn't the article: all letter runs of a token are marker words (so
    has-sidebar is none); in an article the token itself is one, and ids of headings, which repeat their text, say nothing. A part of a
    container's name may mark it, but not of the id of a section in an article, which repeats its heading."""
    if tag in MAIN or tag in ("html", "body"):
        return False
    tokens = f"{known.get('class', '')} {known.get('id', '') if not (inside and tag in HEADINGS) else ''}".lower().split()
    names = [set(_NAME.findall(x)) for x in tokens]
    own = len(known.get("class", "").split()) if inside and tag == "section" else len(names)
    if tag in CONTAINERS and any(not STRONG.isdisjoint(x) and STATING.isdisjoint(x) for x in names[:own]):
        return True
    if inside:  # a paragraph or a heading that is called an alert may be the article's: counts tell
        return tag in CONTAINERS and not WORDS.isdisjoint(tokens)
    return any(x and WORDS.issuperset(x) for x in names)


def shape_of(tag: str, known: dict[str, str]) -> str | None:
    """The shape of an element with a class, id or role: names without digits, in order. None for elements without, for headings and
    inline ones, for names that say content, and for what is no container unless a name is a marker word."""
    names = [sorted(_NAME.findall(known.get(k, "").lower())) for k in ("class", "id", "role")]
    if tag in HEADINGS or tag in INLINE or tag in MAIN or not any(names) or any(not CONTENT.isdisjoint(x) for x in names):
        return None
    if tag not in CONTAINERS and all(WORDS.isdisjoint(x) for x in names):
        return None
    return f"{tag}|{'|'.join(' '.join(x) for x in names)}"


#: Nothing is open: tag, dropped for good, in a form, marks around, marks around its article (None: none), in an article element,
#: subtree, shapes around in the article.
_TOP = ("", False, False, 0, None, False, -1, ())


class _Page(HTMLParser):
    """Blocks of text of one page with what is known of where they stand; hashes of its subtrees. Work and memory go with the
    length of the page, however deep its elements lie."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple] = []  # text, marks around its article, in an article element, a main heading, the subtree right around it
        self.hashes: list[int] = []  # of each subtree
        self.hashers: list = []  # of each subtree; None when it has ended
        self.open: list[tuple] = []
        self.count: Counter = Counter()  # open elements of a tag
        self.now: list[str] = []

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.now)).strip()
        self.now = []
        tag, dropped, form, marked, level, article, subtree, shapes = self.open[-1] if self.open else _TOP
        if text and not (dropped or form or marked > (level or 0)):
            self.blocks.append((text, level, article, tag == "h1", subtree, shapes))

    def tell(self, data: bytes) -> None:
        """Add to the hash of the subtree that is open."""
        subtree = self.open[-1][6] if self.open else -1
        if subtree >= 0:
            self.hashers[subtree].update(data)

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        if tag in CLOSES_P and self.count["p"]:
            self.close_to("p", MAIN | {"div", "section", "td", "table"})
        if tag in SIBLINGS:
            for x in SIBLINGS[tag]:
                self.close_to(x, {"ul", "ol", "dl", "table", "select", "menu"})
        self.tell(f"<{tag}>".encode())
        if tag in VOID:
            return
        known = {k: v or "" for k, v in attrs}
        _, dropped, form, marked, level, article, subtree, shapes = self.open[-1] if self.open else _TOP
        # An article in a form, or in what a class or id marks, may be the page's: done() tells by the number of marks.
        if tag in MAIN or known.get("role") == "main":
            form, article = False, article or tag == "article"
            marked += tag == "article" and not WORDS.isdisjoint(known.get("class", "").lower().split())  # a reader's comment, a teaser
            level, shapes = marked, ()
        inside = level is not None
        marked += marks(tag, known, inside)
        form = form or tag == "form" or known.get("role") == "form"
        dropped = dropped or tag in DROPPED or (tag in OUTSIDE and not inside) or known.get("role", "") in ROLES or "hidden" in known or known.get("aria-hidden") == "true"
        if tag not in INLINE and tag not in ("html", "body"):
            subtree = len(self.hashers)
            self.hashers.append(xxhash.xxh3_64(tag.encode()))
            self.hashes.append(0)
        if inside and (shape := shape_of(tag, known)):
            # by what it stands in; depth is bounded, as a name may be nested without end
            shapes = (*shapes[-7:], xxhash.xxh3_64_intdigest(f"{shapes[-1] if shapes else ''}>{shape}".encode("utf-8", "surrogatepass")) - (1 << 63))
        self.open.append((tag, dropped, form, marked, level, article, subtree, shapes))
        self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def pop(self) -> None:
        tag, subtree = self.open[-1][0], self.open[-1][6]
        if tag not in INLINE:
            self.flush()
        self.open.pop()
        self.count[tag] -= 1
        if subtree >= 0 and (not self.open or self.open[-1][6] != subtree):
            self.hashes[subtree] = self.hashers[subtree].intdigest() - (1 << 63)
            self.tell(self.hashers[subtree].digest())
            self.hashers[subtree] = None

    def close_to(self, tag: str, stops) -> None:
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self.pop()
                return
            if self.open[k][0] in stops:
                return

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        self.close_to(tag, MAIN if tag in INLINE or tag == "p" else ())

    def handle_data(self, data):
        self.now.append(data)
        self.tell(data.encode("utf-8", "surrogatepass"))

    def unknown_decl(self, data):
        pass

    def done(self) -> _Page:
        self.close()
        while self.open:
            self.pop()
        self.flush()
        # Articles in more marked elements than others of the page are readers' comments, teasers and the like.
        least = min((level for _, level, *_ in self.blocks if level is not None), default=None)
        blocks = [x for x in self.blocks if x[1] is None or x[1] == least]
        # What stands beside the article in a main element isn't article, but for its heading.
        inside = [x for x in blocks if x[1] is not None]
        if 2 * sum(len(x[0]) for x in inside if x[2]) >= sum(len(x[0]) for x in inside):
            blocks = [x for x in blocks if x[1] is None or x[2] or x[3]]
        self.blocks = [(text, level is not None, self.hashes[subtree] if subtree >= 0 else None, list(shapes)) for text, level, _, _, subtree, shapes in blocks]
        return self

    def shapes(self) -> list[tuple[int, int, int]]:
        """(shape, characters in it, characters of the article) of the shapes in the article."""
        held, whole = Counter(), 0
        for text, inside, _, shapes in self.blocks:
            whole += len(text) * inside
            held.update({x: len(text) for x in set(shapes)})
        return [(x, n, whole) for x, n in held.items()]


def parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    return page.done()


def host(url: Column) -> Column:
    """The host of an address; null where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


BLOCKS = "array<struct<text:string,inside:boolean,subtree:long,shapes:array<long>>>"
SHAPES = "array<struct<shape:long,held:long,whole:long>>"


def parsed(rows: DataFrame) -> DataFrame:
    """(row, host, blocks, shapes, content) of rows (row, host, html): each page is parsed once; content is a hash of its blocks."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("inside", pa.bool_()), ("subtree", pa.int64()), ("shapes", pa.list_(pa.int64()))]))
    shape_kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("shape", "held", "whole")]))

    def run(batches):
        for batch in pieces(batches, 2):
            blocks, shapes, content = [], [], []
            for html in batch.column(2).to_pylist():
                page = parse(html)
                blocks.append([dict(zip(("text", "inside", "subtree", "shapes"), x)) for x in page.blocks])
                shapes.append([dict(zip(("shape", "held", "whole"), x)) for x in page.shapes()])
                content.append(xxhash.xxh3_64_intdigest("\n".join(x[0] for x in page.blocks).encode("utf-8", "surrogatepass")) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blocks, kind), pa.array(shapes, shape_kind), pa.array(content, pa.int64())], ["row", "host", "blocks", "shapes", "content"])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, host string, blocks {BLOCKS}, shapes {SHAPES}, content long")
    return written(out, "parsed-pages")


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, template array<struct<hash, kind>>) of pages (host, blocks, shapes, content): the subtrees that recur on many pages of a
    host (kind `outside`; `inside`: on so many that they are template in articles too), and the shapes in articles that do
    (`shape`). Pages of equal content count once, so that copies of a page don't make its text a template."""
    hashes = F.array_distinct(F.filter(F.transform("blocks", lambda b: b["subtree"]), lambda h: h.isNotNull()))
    known = pages.where("host <> ''").select("host", "content", hashes.alias("hashes"), "shapes").groupBy("host", "content").agg(F.min(F.struct("hashes", "shapes")).alias("x"))
    known = written(known.select("host", "x.hashes", "x.shapes"), "page-hashes")
    sizes = written(known.groupBy("host").agg(F.count("*").alias("pages")), "host-sizes")
    counts = known.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    shapes = known.select("host", F.explode("shapes").alias("x")).groupBy("host", F.col("x.shape").alias("hash")).agg(F.count("*").alias("n"), F.sum("x.held").alias("held"), F.sum("x.whole").alias("whole"))
    shapes = shapes.where(F.col("held") <= SHAPE_TEXT_SHARE * F.col("whole")).select("host", "hash", "n", F.lit(True).alias("shape"))
    counts = written(counts.withColumn("shape", F.lit(False)).unionByName(shapes).where(F.col("n") >= LEAST_PAGES), "subtree-counts")
    many = counts.join(sizes.hint("merge"), "host").where(F.col("n") >= LEAST_SHARE * F.col("pages"))
    # a host has at most (mean blocks and shapes of a page) / LEAST_SHARE of these
    inside = (F.col("n") >= INSIDE_PAGES) & (F.col("n") >= INSIDE_PAGE_SHARE * F.col("pages"))
    kind = F.when(F.col("shape"), "shape").when(inside, "inside").otherwise("outside")
    return written(many.groupBy("host").agg(F.collect_list(F.struct("hash", kind.alias("kind"))).alias("template")), "templates")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", columns: list[str] | None = None) -> DataFrame:
    """(row struct of the columns named, text), a row for each row: the main text of each whole page.

    The text is the blocks of the article or main element in page order; of a page without one, all blocks that neither
    rules nor template delete. Null and empty pages have an empty text. Pages without a host (or a null address) have
    only the rules applied. Repeated rows all get their text, and count as one page of their host. An empty table gives an empty table.
    """
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in columns or pages.columns]).alias("row"), host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    found = parsed(rows)
    templates = host_templates(found).withColumnRenamed("host", "__host")
    total = templates.agg(F.sum(F.size("template"))).first()[0] or 0
    joined = found.select("row", "host", "blocks").join(F.broadcast(templates) if total <= BROADCAST_SUBTREES else templates.hint("merge"), F.col("host") == F.col("__host"), "left")
    some = F.coalesce("template", F.array().cast("array<struct<hash:long,kind:string>>"))
    of = lambda *kinds: F.transform(F.filter(some, lambda t: t["kind"].isin(*kinds)), lambda t: t["hash"])
    outside, strong, shapes = of("outside", "inside"), of("inside"), of("shape")
    not_in = lambda b, hashes: b["subtree"].isNull() | ~F.array_contains(hashes, b["subtree"])
    left = joined.select("row", F.filter("blocks", lambda b: ~b["inside"] & not_in(b, outside)).alias("left"), F.filter("blocks", lambda b: b["inside"]).alias("all"), strong.alias("strong"), shapes.alias("shapes"))
    chars = lambda c: F.aggregate(c, F.lit(0), lambda n, b: n + F.length(b["text"]))
    left = left.withColumn("shaped", F.filter("all", lambda b: ~F.arrays_overlap(b["shapes"], "shapes")))
    left = left.withColumn("article", F.when(chars("shaped") >= (1 - SHAPE_TEXT_SHARE) * chars("all"), F.col("shaped")).otherwise(F.col("all")))
    left = left.withColumn("own", F.filter("article", lambda b: not_in(b, F.col("strong"))))
    article = F.when(chars("own") >= (1 - INSIDE_TEXT_SHARE) * chars("article"), F.col("own")).otherwise(F.col("article"))
    return left.select("row", F.array_join(F.transform(F.when(F.size("article") > 0, article).otherwise(F.col("left")), lambda b: b["text"]), " ").alias("text"))
