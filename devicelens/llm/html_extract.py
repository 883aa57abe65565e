"""Operator 4: main text of web pages by wrapper induction.

One page of every layout of a host is its wrapper; a layout is the set of structural tags and classes.  The trees
of the layout's pages are aligned with it by simple tree matching, and Spark counts for every element of the
wrapper on how many other pages it is found and on how many with the same text.  Constant elements are the
template, varying ones are slots.  A page's text is then its slots' text, without the parts whose markup says that they
are no article; inside an ``article`` element with a slot a constant block stays, as the markup vouches for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelens.llm import dom
from devicelens.llm.common import cut, slices
from devicelens.llm.url_filter import host

#: An element is template if other pages show it with the same text at least so often, and in this share.
LEAST_PAGES, CONSTANT = 2, 0.8
#: A page that agrees with the wrapper in so much of its text is a near copy: no evidence of a constant.
NEAR_COPY = 0.8
#: Other pages that it takes to call most of a page's text template.
MANY_PAGES = 4
#: A page is taken as wrapper rather if it has at most so many characters: alignment takes time in
#: proportion to the wrapper.
WRAPPER_CHARS = 1 << 14
#: Opening tags that make a layout: structural ones, and block elements with a class.
_LAYOUT = (
    r"(?i)<(?:article|main|section|nav|aside|header|footer|form|table)\b"
    r"|<(?:div|ul|ol|p|h[1-6]|section|article|main|table|body)\s[^>]*?\bclass\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"
)
#: Bytes of wrappers up to which they are broadcast; beyond, pages are joined with them by host.
MAX_BROADCAST_BYTES = 32 << 20


def read_wrapper(page: str) -> tuple[dom.Node, dict[int, str]]:
    """A wrapper's tree and the text of its blocks by element."""
    root = dom.parse(page)
    texts: dict[int, str] = {}
    for block in dom.blocks(root):
        number = block.owner.number
        texts[number] = f"{texts[number]}\n{block.text}" if number in texts else block.text
    return root, texts


def elements_of(wrapper: tuple[dom.Node, dict[int, str]], template: list[int] | None, pages: int | None) -> frozenset[int]:
    """The template without an element that holds most of the wrapper's text.

    Most of the text is a template only by many pages; a few that share it may be copies of one article.
    """
    total = sum(map(len, wrapper[1].values()))
    sizes = {n: len(wrapper[1].get(n, "")) for n in template or ()}
    chosen = frozenset(n for n, size in sizes.items() if 2 * size <= total)
    if (pages or 0) < MANY_PAGES and 2 * sum(sizes.values()) > total:
        return frozenset()
    return chosen


def agreement(blocks: list[dom.Block], places: dict[int, int], same: dict[int, bool]) -> float:
    """The share of a page's text that stands in the wrapper's place with the wrapper's text."""
    total = sum(len(b.text) for b in blocks)
    equal = sum(len(b.text) for b in blocks if same.get(places.get(b.owner.number), False))
    return equal / total if total else 1.0


def compare(page: str | None, wrapper: tuple[dom.Node, dict[int, str]]) -> tuple[list[dom.Block], dict, dict]:
    """A page's blocks, wrapper element by page element, and whether their texts are the same."""
    root = dom.parse(page)
    found = dom.blocks(root)
    places = dom.align(root, wrapper[0])
    texts: dict[int, str] = {}
    for block in found:
        number = block.owner.number
        texts[number] = f"{texts[number]}\n{block.text}" if number in texts else block.text
    same = {
        places[n]: text == wrapper[1][places[n]] for n, text in texts.items() if places.get(n) in wrapper[1]
    }
    return found, places, same


def main_text(
    page: str | None,
    wrapper: tuple[dom.Node, dict[int, str]],
    template: frozenset[int],
    slots: frozenset[int] = frozenset(),
) -> str:
    """The blocks that vary and are not marked, and constant ones of an article that varies, joined by line ends.

    Inside an article a part that only a word marks stays if its element is among the ``slots``, known
    to vary, and is no list of links.
    """
    found, places, same = compare(page, wrapper)
    fixed = []
    for block in found:
        place = places.get(block.owner.number)
        fixed.append(place in template and same.get(place, False))
        if block.boiler == 1 and block.article and place in slots and not block.linked:
            block.boiler = 0
    varying = [b for b, constant in zip(found, fixed) if not b.boiler and not constant]
    articles = {id(b.article) for b in varying if b.article}
    kept = []
    for block, constant in zip(found, fixed):
        vouched = block.article and (not varying or id(block.article) in articles)
        if not block.boiler and (vouched or not constant):
            kept.append(block.text)
    return "\n".join(kept)


def layout(page: Column) -> Column:
    """A hash of the distinct structural tags and classes of a page, without digits, the same in any order."""
    found = F.regexp_extract_all(page, F.lit(_LAYOUT), F.lit(0))
    plain = F.transform(
        found, lambda x: F.concat_ws(" ", F.regexp_extract(x, "<[a-zA-Z]+", 0), F.regexp_replace(F.regexp_extract(x, r"(?i)\bclass\s*=.*", 0), "[0-9]+", "0"))
    )
    return F.coalesce(F.xxhash64(F.array_sort(F.array_distinct(F.transform(plain, F.lower)))), F.lit(0))


def _wrappers(pages: DataFrame) -> DataFrame:
    """(host, layout, wrapped, wrapper): one page of every layout of a host, the same on every run; rather one with elements.

    Layouts of too few pages to learn from share the wrapper of the host's most frequent one; ``wrapped`` is the layout
    that the wrapper is of.
    """
    bare = ~F.col("html").rlike("<[a-zA-Z]")
    order = F.struct(bare, F.length("html") > WRAPPER_CHARS, F.xxhash64("html"))
    found = cut(
        pages.where("html is not null")
        .groupBy("host", "layout")
        .agg(F.count("*").alias("n"), F.min_by("html", order).alias("wrapper"), F.min(bare).alias("bare"))
    )
    most = found.groupBy("host").agg(F.max_by("layout", F.struct(~F.col("bare"), "n", "layout")).alias("most"))
    used = F.when(F.col("n") > LEAST_PAGES, F.col("layout")).otherwise(F.col("most"))
    named = found.join(most, "host").select("host", "layout", used.alias("wrapped"))
    held = found.select("host", F.col("layout").alias("wrapped"), "wrapper")
    return named.join(held, ["host", "wrapped"]).select("host", "layout", "wrapped", "wrapper")


class _Lookup:
    """Pages with their wrappers: by a broadcast table of bounded size, or joined by (host, layout)."""

    def __init__(self, wrappers: DataFrame, size: int, columns: tuple[str, ...]) -> None:
        self.columns, self.wrappers = columns, wrappers.select("host", "layout", *columns)
        self.table = None
        if size <= MAX_BROADCAST_BYTES:
            held = {(r["host"], r["layout"]): tuple(r[c] for c in columns) for r in self.wrappers.collect()}
            self.table = wrappers.sparkSession.sparkContext.broadcast(held)

    def rows(self, pages: DataFrame, *names: str) -> DataFrame:
        if self.table is not None:
            return pages.select("host", "layout", *names)
        return pages.join(self.wrappers, ["host", "layout"], "left").select("host", "layout", *names, *self.columns)

    def reader(self):
        """A function from a batch to its rows' columns; it travels to the tasks without the frames."""
        table, columns = self.table, self.columns

        def read(batch: pa.RecordBatch) -> list[tuple]:
            if table is None:
                return list(zip(*(batch.column(c).to_pylist() for c in columns)))
            keys = zip(batch.column("host").to_pylist(), batch.column("layout").to_pylist())
            nothing = (None,) * len(columns)
            return [table.value.get(key, nothing) for key in keys]

        return read


class _Wrappers:
    """The wrappers a task has read, one at a time per host."""

    def __init__(self) -> None:
        self.read: dict[str, tuple] = {}

    def get(self, page: str | None) -> tuple:
        page = page or ""
        if page not in self.read:
            if len(self.read) >= 256:
                self.read.clear()
            self.read[page] = read_wrapper(page)
        return self.read[page]


def template_elements(pages: DataFrame, wrappers: DataFrame, size: int) -> DataFrame:
    """(host, wrapped, template, slots, pages): the numbers of every wrapper's elements that are constant and that vary, and
    how many pages tell."""

    lookup = _Lookup(wrappers, size, ("wrapped", "wrapper"))
    known = lookup.reader()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sums = _Wrappers(), {}

        def flush() -> pa.RecordBatch:
            keys = list(sums)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([k[2] for k in keys], pa.int32()),
                    pa.array([sums[k][0] for k in keys], pa.int64()),
                    pa.array([sums[k][1] for k in keys], pa.int64()),
                ],
                names=["host", "wrapped", "element", "found", "same"],
            )
            sums.clear()
            return out

        for batch in slices(batches, "html", 8 << 20):
            columns = (batch.column(n).to_pylist() for n in ("host", "html"))
            for name, page, (wrapped, wrapper) in zip(*columns, known(batch)):
                if page is None or page == wrapper:
                    continue
                blocks, places, equals = compare(page, cache.get(wrapper))
                if agreement(blocks, places, equals) >= NEAR_COPY:
                    continue
                for element, equal in equals.items():
                    pair = sums.setdefault((name, wrapped, element), [0, 0])
                    pair[0] += 1
                    pair[1] += equal
            if len(sums) > 100_000:
                yield flush()
        if sums:
            yield flush()

    return (
        lookup.rows(pages, "html")
        .mapInArrow(count, "host string, wrapped bigint, element int, found bigint, same bigint")
        .groupBy("host", "wrapped", "element")
        .agg(F.sum("found").alias("found"), F.sum("same").alias("same"))
        .where(F.col("found") >= LEAST_PAGES)
        .withColumn("constant", (F.col("same") >= LEAST_PAGES) & (F.col("same") >= CONSTANT * F.col("found")))
        .groupBy("host", "wrapped")
        .agg(
            F.collect_list(F.when(F.col("constant"), F.col("element"))).alias("template"),
            F.collect_list(F.when(~F.col("constant"), F.col("element"))).alias("slots"),
            F.max("found").alias("pages"),
        )
    )


def extract(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``.

    A null page is empty and has the empty text.  Pages whose URL is null or without a host are aligned
    as the pages of one nameless host.  Repeated rows come back repeated; a page that agrees with its
    wrapper in ``NEAR_COPY`` of its text does not count as evidence of a constant, an element that holds most of the
    wrapper's text is never template, nor are elements that do together, unless ``MANY_PAGES`` other pages show them.  A form around the page's paragraphs is not left out.  Nothing but the markup's parts and constant
    elements outside the articles is left out, and nothing is cut.
    """
    base = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        host(F.col(url)).alias("host"),
        F.col(html).alias("html"),
        layout(F.col(html)).alias("layout"),
    )
    wrappers = cut(_wrappers(base))
    # An element of a wrapper takes at least four bytes of its page, so the two arrays are no longer than that.
    size = wrappers.agg(F.sum(F.octet_length("host") + 2 * F.octet_length("wrapper"))).first()[0] or 0
    learned = cut(
        wrappers.join(template_elements(base, wrappers, size), ["host", "wrapped"], "left")
    )
    lookup = _Lookup(learned, size, ("wrapper", "template", "slots", "pages"))
    known = lookup.reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Wrappers()
        for batch in slices(batches, "html", 8 << 20):
            texts = []
            for page, (wrapper, template, slots, count) in zip(batch.column("html").to_pylist(), known(batch)):
                if not page:
                    texts.append("")
                    continue
                tree = cache.get(wrapper)
                texts.append(main_text(page, tree, elements_of(tree, template, count), frozenset(slots or ())))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = base.schema["page_id"].dataType.simpleString()
    return lookup.rows(base, "page_id", "url", "html").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars bigint"
    )
