"""HTML extraction with nearest-URL page differencing.

A page is cut into text lines, one a block, with its markup's statements about each: whether it stands in a
menu, header, footer, aside, form, script, advert, notice or comment (by element, role, class or id), and
whether in a declared ``main`` or ``article``. Every page is then paired with its nearest page by URL that has
other text: within a host, pages in order of path, the neighbour with the longer common path; copies are
passed over. All lines of the two, those in menus and footers too, are aligned by a longest common subsequence,
and the shared ones are up for deletion.

What the markup says is evidence beside that. Lines in menus and the like go, shared or not. A page that
declares an article has its text there, and lines outside go; shared lines inside may be copied or quoted, and
copies and quoted passages are text of the article. So these go only as the host's notices: where more than half
of its different pages, of at least ARTICLE_PAGES, hold the line. If more than half of the article's
characters were such lines, its pages would be near copies, and all stay.

Of a page without a declared article all shared lines go, but for those that the neighbour declares to be its
article. Where the page shares more than half of its characters, the two may be near copies or short pages in a
long template: then those shared lines go that more than half of the host's different pages hold.

Null html or no text gives an empty string. Pages without a URL share one host. Repeated rows get
equal results where their neighbours do; ties in URL are broken by page_id. Empty tables give
empty ones; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetsieve.llm.common import materialise, prepare

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STEP = re.compile(r"[>\"']")
#: One attribute after the other: a quoted value goes with its name, so that its words are never names.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template svg math iframe object canvas audio video xmp noframes".split())
_SHUT = {name: re.compile(rf"</{name}\b", re.I | re.A) for name in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("head nav header footer aside form menu dialog button select fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe signup login "
    "sidebar widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar header masthead footer comment comments respond disqus reply related recommended share sharing social".split()
)
#: Elements that inside an article are text whatever their class or id says.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr table tbody ul ol dl blockquote pre figcaption".split()) | INLINE


class Tags:
    """The tags of a page from left to right, in time linear in the page whatever it holds."""

    def __init__(self, page: str):
        self.page = page
        self.quotes = {'"': True, "'": True}  # whether there may be another one
        self.closed = True  # whether there may be another >

    def _end(self, at: int) -> int:
        """Behind the > that isn't in quotes; a quote that is never closed is a character. 0 if there is none."""
        while self.closed:
            m = _STEP.search(self.page, at)
            if m is None:
                break
            at = m.end()
            if m[0] == ">":
                return at
            if self.quotes[m[0]]:
                other = self.page.find(m[0], at)
                if other < 0:
                    self.quotes[m[0]] = False
                else:
                    at = other + 1
        self.closed = False
        return 0

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether it closes, name (empty for comments and declarations) and attributes of the next tag."""
        page = self.page
        while self.closed and (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), False, "", ""
            m = _NAME.match(page, start + 1)
            if m:
                end = self._end(m.end())
                if end:
                    return start, end, page[start + 1] == "/", m[1].lower(), page[m.end() : end - 1]
                break
            if page[start + 1 : start + 2] in ("!", "?"):
                end = page.find(">", start)
                if end < 0:
                    break
                return start, end + 1, False, "", ""
            at = start + 1
        start = page.find("<!--", at)  # without another > a comment still hides the rest
        return None if start < 0 else (start, len(page), False, "", "")


def blocks_of(page: str, marked: bool = False) -> list[tuple[str, int]]:
    """The page's text blocks, with 2 inside an article, 1 inside main, else 0; marked: those in menus and the like, with -1."""
    out: list[tuple[str, int]] = []
    pieces: list[str] = []
    lost: list[str] = []  # pieces in menus and the like
    stack: list[tuple[str, bool, int]] = []  # element, whether its text goes, where it stands
    gone, place = False, 0

    def flush() -> None:
        for found, where in ((pieces, place), (lost, -1)):
            if found:
                text = " ".join(html.unescape("".join(found)).split())
                if text:
                    out.append((text, where))
                found.clear()

    at, n, tags = 0, len(page), Tags(page)
    opened: Counter[str] = Counter()  # open elements by name
    solid: list[int] = []  # places in the stack of elements that aren't inline

    def close(k: int) -> None:
        nonlocal gone, place
        for name, _, _ in stack[k:]:
            opened[name] -= 1
        del stack[k:]
        while solid and solid[-1] >= k:
            solid.pop()
        _, gone, place = stack[-1] if stack else ("", False, 0)

    while at < n:
        tag = tags.next(at)
        if tag is None:
            if not gone or marked:
                (lost if gone else pieces).append(page[at:])
            break
        start, end, closing, name, rest = tag
        if start > at and (not gone or marked):
            (lost if gone else pieces).append(page[at:start])
        at = end
        if not name:
            continue
        if closing:  # an end tag closes the nearest element of its name and what is open inside
            if name not in INLINE:
                flush()
            if opened[name]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name not in INLINE:
            flush()
            if solid and stack[solid[-1]][0] == "p":  # a block closes an open paragraph
                close(solid[-1])
        if name in VOID or rest.endswith("/") and name not in INLINE | {"p", "div", "li", "article", "main", "section"}:
            continue
        if name in RAW:
            found = _SHUT[name].search(page, at)
            shut = page.find(">", found.end()) if found else -1
            at = shut + 1 if shut >= 0 else n
            continue
        drop = name in DROPPED and not (name == "header" and place)
        if rest and name not in ("html", "body", "article", "main"):
            for key, value in _ATTRIBUTE.findall(rest):
                key, value = key.lower(), value.strip("\"'").lower()
                if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in DROPPED_ROLES:
                    drop = True
                elif key in ("class", "id") and any(_dropped(c) if not place else c in DROPPED_NAMES and name not in TEXT for c in value.split()):
                    drop = True
        gone = gone or drop
        place = max(place, 2 if name == "article" else 1 if name == "main" else 0)
        if name not in INLINE:
            solid.append(len(stack))
        opened[name] += 1
        stack.append((name, gone, place))
    flush()
    return out


def _dropped(name: str) -> bool:
    """Whether one of a class name's words says that the element isn't text; no-sidebar or has-ads say what is elsewhere."""
    words = re.split(r"[^a-z0-9]+", name)
    return not DROPPED_NAMES.isdisjoint(words) and words[0] not in ("no", "has", "with", "without", "hide")


#: Bits of rows that an alignment keeps at a time.
ALIGNED_BITS = 1 << 29


def _rows(a: list, b: list) -> Iterator[int]:
    """After each line of a, a number whose bit j is 0 where the longest common subsequence grows with line j of b."""
    at: dict = defaultdict(int)
    for j, line in enumerate(b):
        at[line] |= 1 << j
    full = (1 << len(b)) - 1
    row = full
    for line in a:
        both = row & at.get(line, 0)
        row = ((row + both) | (row - both)) & full
        yield row


def _lengths(a: list, b: list) -> list[int]:
    """Length of the longest common subsequence of a and each beginning of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    return list(accumulate((1 - int(x) for x in reversed(bin(row)[2:].zfill(len(b)))), initial=0)) if b else [0]


def common_lines(a: list, b: list) -> set[int]:
    """Positions in a of a longest common subsequence with b: whole rows are bits of a number.

    Lines that both begin or end with are common; the rest takes as many steps as it has lines, on numbers of as
    many bits, however often lines repeat. Where all rows would be too large, a is halved and b cut where both
    halves together share most.
    """
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    found = {*range(first), *range(len(a) - last, len(a))}
    mine, other = a[first : len(a) - last], b[first : len(b) - last]
    if not mine or not other:
        return found
    if len(mine) > 1 and len(mine) * len(other) > ALIGNED_BITS:
        half = len(mine) // 2
        left, right = _lengths(mine[:half], other), _lengths(mine[half:][::-1], other[::-1])
        cut = max(range(len(other) + 1), key=lambda j: left[j] + right[len(other) - j])
        found |= {first + i for i in common_lines(mine[:half], other[:cut])}
        return found | {first + half + i for i in common_lines(mine[half:], other[cut:])}
    rows = list(_rows(mine, other))
    i, j = len(mine), len(other)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i == 0 or rows[i - 1] >> (j - 1) & 1:
            found.add(first + i)
            j -= 1
    return found


def common_prefix(a: str, b: str | None) -> int:
    if b is None:
        return -1
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


#: A host needs so many different pages before a line inside a declared article may be one of its notices.
ARTICLE_PAGES = 8
#: The last two bits of a line's key: in a menu or the like, outside and inside a declared article. Without the
#: last bit keys are compared, so that an advert is never aligned with a line of text.
MARKED, OUTSIDE, INSIDE = 0, 2, 3


def difference(path: str, keys: list[int], sizes: list[int], before: tuple | None, after: tuple | None, template: frozenset[int] = frozenset(), pages: int = 0) -> list[int]:
    """Places, among the lines that the markup lets stay (of these sizes), of those that the alignment deletes.

    The neighbours are (path, keys); template has the lines that more than half of the host's different pages hold.
    """
    near = max((x for x in (before, after) if x), key=lambda x: common_prefix(path, x[0]), default=None)
    if near is None:
        return []
    declared = any(k & 3 == INSIDE for k in keys)
    lines = [k >> 1 for k in keys]
    staying = [k for k, key in enumerate(keys) if key & 3 == (INSIDE if declared else OUTSIDE)]
    shared = common_lines(lines, [k >> 1 for k in near[1] if declared or k & 3 != INSIDE])
    found = [j for j, k in enumerate(staying) if k in shared]
    if declared and pages < ARTICLE_PAGES:
        return []
    if declared or 2 * sum(sizes[j] for j in found) > sum(sizes):
        found = [j for j in found if lines[staying[j]] in template]
    return [] if declared and 2 * sum(sizes[j] for j in found) > sum(sizes) else found


CUT = "row long, page_id long, url string, host string, path string, keys array<long>, lines array<string>, sizes array<int>"


def cut_pages(pages: DataFrame) -> DataFrame:
    """Of each page the keys of all lines, and the lines that the markup lets stay. No shuffle.

    Rows are numbered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            cut = [blocks_of(page, marked=True) for page in batch["html"]]
            hashed = pd.util.hash_array(np.array([t for found in cut for t, _ in found], object), categorize=False) if any(cut) else np.zeros(0, np.uint64)
            hashes = iter((hashed.view(np.int64) & ~3).tolist())
            keys, lines = [], []
            for found in cut:
                declared = any(p > 0 for _, p in found)
                keys.append([next(hashes) + (MARKED if p < 0 else INSIDE if p else OUTSIDE) for _, p in found])
                lines.append([t for t, p in found if p >= 0 and (p > 0) == declared])
            yield pd.DataFrame({"row": range(row, row + len(batch)), **{c: batch[c] for c in ("page_id", "url", "host", "path")}, "keys": keys, "lines": lines, "sizes": [list(map(len, x)) for x in lines]})
            row += len(batch)

    address = F.coalesce(F.col("url"), F.lit(""))
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)"
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.lower(F.regexp_extract(address, pattern, 1)).alias("host"), F.regexp_extract(address, pattern, 2).alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    return picked.mapInPandas(run, CUT)


def unmarked() -> Column:
    """The keys of lines that aren't in menus and the like, wherever they stand."""
    return F.transform(F.filter("keys", lambda k: k.bitwiseAND(F.lit(3)) != MARKED), lambda k: F.shiftright(k, 1))


def templates(rest: DataFrame) -> DataFrame:
    """Of each host its number of different pages, and the lines that more than half of them hold.

    There are fewer of these than twice the lines of a mean page.
    """
    different = rest.groupBy("host", "sum").agg(F.first(unmarked()).alias("keys")).where(F.size("keys") > 0)
    sizes = different.groupBy("host").agg(F.count("*").alias("n")).where("n >= 2")
    lines = different.select("host", F.explode(F.array_distinct("keys")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("k")).where("k >= 2")
    return lines.join(sizes, "host").where("2 * k > n").groupBy("host").agg(F.collect_list("line").alias("template"), F.first("n").alias("pages"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Keys of all pages' lines (not their texts) are range-partitioned by URL, so that one host may fill many
    tasks; the few rows at the parts' edges (two a part) find their neighbours in a small join. What the
    alignments delete comes back to the texts by the rows' numbers.
    """
    spark = pages.sparkSession
    prepare(spark)
    cut = materialise(cut_pages(pages), "cut-pages")  # pages are cut once
    order = ["host", "path", "page_id"]
    rest = cut.select("row", "page_id", "host", "path", "keys", "sizes", F.xxhash64("host", unmarked()).alias("sum"))
    rest = rest.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    rest = materialise(rest.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}), "page-lines")
    held = materialise(templates(rest), "templates")
    # rows of one sum are copies: a row's neighbours are the nearest rows of another sum
    rest = rest.withColumn("me", F.struct("host", "path", "keys", "sum"))
    on, back = Window.partitionBy("part").orderBy("pos"), Window.partitionBy("part").orderBy(F.desc("pos"))
    found_in = lambda w: F.last("turn", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    turned = lambda df, w, name: df.withColumn("turn", F.when(F.lag("me").over(w)["sum"] != F.col("me")["sum"], F.lag("me").over(w))).withColumn(name, found_in(w)).drop("turn")
    near = turned(turned(rest, on, "before"), back, "after")
    # one row a part
    edges = near.groupBy("part").agg(F.min_by("me", "pos").alias("first"), F.max_by("me", "pos").alias("last"), F.min_by("after", "pos").alias("after_first"), F.max_by("before", "pos").alias("before_last"))
    by_part, by_part_back = Window.orderBy("part"), Window.orderBy(F.desc("part"))

    def carried(df: DataFrame, w, end: str, beyond: str) -> DataFrame:
        """The last row outside the part, and the row beyond that row's copies, however many parts these fill."""
        df = df.withColumn("outer", F.lag(end).over(w))
        df = df.withColumn("turn", F.coalesce(beyond, F.when(F.col("outer")["sum"] != F.col(end)["sum"], F.col("outer")))).withColumn("turn", found_in(w))
        return df.withColumns({f"{end}_outer": F.col("outer"), f"{end}_beyond": F.lag("turn").over(w)}).drop("outer", "turn")

    edges = carried(carried(edges, by_part, "last", "before_last"), by_part_back, "first", "after_first")
    edges = edges.select("part", "last_outer", "last_beyond", "first_outer", "first_beyond")
    near = near.join(edges, "part", "left")
    outside = lambda end: F.when(F.col(f"{end}_outer")["sum"] != F.col("me")["sum"], F.col(f"{end}_outer")).otherwise(F.col(f"{end}_beyond"))
    near = near.withColumns({"before": F.coalesce("before", outside("last")), "after": F.coalesce("after", outside("first"))})
    same = lambda c: F.when(F.col(c)["host"] == F.col("host"), F.col(c))
    near = near.select("row", "host", "path", "keys", "sizes", same("before").alias("before"), same("after").alias("after"))
    near = near.join(held, "host", "left").withColumns({"template": F.coalesce("template", F.array().cast("array<long>")), "pages": F.coalesce("pages", F.lit(0))})

    @F.pandas_udf("array<int>")
    def deleted(paths: pd.Series, keys: pd.Series, sizes: pd.Series, p1: pd.Series, k1: pd.Series, p2: pd.Series, k2: pd.Series, held: pd.Series, pages: pd.Series) -> pd.Series:
        beside = lambda path, keys: (path, keys.tolist()) if path is not None else None
        return pd.Series([difference(p, k.tolist(), s.tolist(), beside(a, x), beside(b, y), frozenset(t.tolist()), n) for p, k, s, a, x, b, y, t, n in zip(paths, keys, sizes, p1, k1, p2, k2, held, pages)], dtype=object)

    # not deterministic, so that the filter below doesn't align its pages once more
    found = near.select("row", deleted.asNondeterministic()("path", "keys", "sizes", F.col("before")["path"], F.col("before")["keys"], F.col("after")["path"], F.col("after")["keys"], "template", "pages").alias("deleted"))
    found = materialise(found.where(F.size("deleted") > 0), "deleted-lines")
    kept = F.when(F.col("deleted").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, k: ~F.array_contains("deleted", k)))
    out = cut.select("row", "page_id", "url", "lines").join(found, "row", "left").select("page_id", "url", F.array_join(kept, "\n").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
