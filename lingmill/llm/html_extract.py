"""Main text of web pages: nearest-URL differencing, checked by the page's structure.

A page is read once into lines, all of them: furniture (navigation, headers and footers of the page,
asides, forms, adverts, notices, reader comments, hidden parts), lines inside an article or main
element, and open lines. Pages of a host are ordered by URL path, every page is paired with the
differing pages around it in that order, and their lines are aligned by longest common subsequence,
as the parts that pages of a site share are its frame. Shared lines are deleted. The structure is the
check after it: furniture that no neighbour shares goes too (adverts, comments), and a shared line
of a marked article stays unless all pages of other content within reach, four or more, share it, as
a paragraph that two articles quote is text in both. Pages of equal lines are copies and take one
place in the order. Neighbours that share most of the characters outside furniture are near copies
where others share less, and are skipped; where all share most, their frame is long. On a page with
an article, open lines outside it are text where a neighbour was there to compare with and lacks them.

A form or a marked element that holds a page's only article or main is none of its furniture.

Defined cases: a null html is empty; a page without text gives the empty string; null or
unreadable URLs are one host of their own order; pages of one path go by number, then content;
repeated rows each get their text; an empty table gives no rows; other columns are ignored; pages
are whole at any length, and are read in time that follows it. A quote holds a value only right
after "=" and where it is closed; any other is a letter of its tag. Unclosed furniture ends where
its parent does; an end tag without a start ends a line at most.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, map_arrow, scope, stage, table

#: Element kinds of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noframes noembed plaintext".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table"
    " tbody td tfoot th thead tr ul".split()
)
FURNITURE = set(
    "nav aside footer form script style noscript template head title iframe object embed svg math canvas audio video select button"
    " textarea dialog menu input map frameset noframes noembed applet datalist".split()
)
CLOSES_P = BLOCK - {"body", "html"}
#: Words of class, id and role that mark page furniture when they stand as a whole word.
MARKED = set(
    "ad ads adsbygoogle adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie"
    " cookies consent gdpr notice notices alert popup modal overlay lightbox sidebar side aside rail widget widgets menu menus nav"
    " navbar navigation breadcrumb breadcrumbs header footer masthead topbar toolbar pagination pager share sharing social related"
    " recommended recommendations newsletter subscribe subscription signup login search comment comments discussion disqus replies"
    " respond complementary contentinfo search skip copyright hidden".split()
)
#: Inside an article these whole class names, ids and roles mark furniture; other words of theirs style its text.
MARKED_INSIDE = set(
    "ad ads adsbygoogle advert adverts advertisement advertising sponsored promo sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination"
    " footer comments comment-list comment-form discussion disqus disqus_thread replies respond reader-comments user-comments cookie-notice cookie-banner cookies consent"
    " notice notices newsletter newsletter-signup subscribe related related-posts related-articles recommended recommendations share-buttons sharing social-share social"
    " complementary contentinfo".split()
)
#: Elements that are furniture outside an article, and may be text in one.
TEXT_INSIDE = {"math", "map", "svg", "dialog", "audio", "video"}
#: Words that make an article element furniture.
MARKED_ARTICLE = set("comment comments reply related ad advert sponsored promo".split())
MAIN_IN = {"article", "main"}

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')|=)*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|\Z)", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=/>])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")


def _furniture(name: str, attrs: str, inside: bool) -> bool:
    if name in FURNITURE and not (inside and name in TEXT_INSIDE):
        return True
    if not attrs or name in ("body", "html", "main"):
        return False
    whole = inside and name != "article"
    marked = MARKED_ARTICLE if name == "article" else MARKED_INSIDE if inside else MARKED
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style":
            if "display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", ""):
                return True
        elif key in ("class", "id", "role") and not marked.isdisjoint(value.split() if whole else _WORDS.findall(value)):
            return True
    return False


#: Elements that an end tag of another kind does not close.
BARRIERS = {"article", "main", "body", "td", "th", "table"}


class _Open:
    """The open elements of a page, with the places of each name, of block elements and of barriers."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int, int]] = []  # name, furniture and article depth before, place of its tag where marked
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.barriers: list[int] = []

    def push(self, name: str, furniture: int, article: int, tag: int) -> None:
        depth = len(self.stack)
        self.stack.append((name, furniture, article, tag))
        self.at.setdefault(name, []).append(depth)
        if name in BLOCK:
            self.blocks.append(depth)
        if name in BARRIERS:
            self.barriers.append(depth)

    def close(self, depth: int) -> tuple[int, int]:
        """Closes the elements from depth on; gives the furniture and article depths before them."""
        gone = self.stack[depth:]
        for name, *_ in gone:
            self.at[name].pop()
        for places in (self.blocks, self.barriers):
            while places and places[-1] >= depth:
                places.pop()
        del self.stack[depth:]
        return gone[0][1], gone[0][2]

    def ended_by(self, name: str) -> int | None:
        """The depth of what an end tag closes."""
        places = self.at.get(name)
        if not places or name not in BLOCK and self.barriers and self.barriers[-1] > places[-1]:
            return None
        return places[-1]

    def ended_before(self, name: str) -> int | None:
        """The depth of what a block's start tag closes: a paragraph, or an item, cell or row of its kind."""
        if name not in CLOSES_P or not self.blocks:
            return None
        last = self.stack[self.blocks[-1]][0]
        same = last == name == "li" or last == name == "tr" or name in ("td", "th") and last in ("td", "th")
        return self.blocks[-1] if last == "p" or same else None


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, kind) of a page's blocks in order; kind 0 furniture, 1 open, 2 inside an article."""
    out, holders = _blocks(page, frozenset())
    if holders and not any(k == 2 for _, k in out):
        again, _ = _blocks(page, frozenset(holders))
        return again if any(k == 2 for _, k in again) else out
    return out


def _blocks(page: str, spared: frozenset[int]) -> tuple[list[tuple[str, int]], list[int]]:
    """The blocks, where tags at spared places are no furniture; and such places around the first article that stands in nothing else."""
    out: list[tuple[str, int]] = []
    opened = _Open()
    furniture = article = 0
    text: list[str] = []
    holders: list[int] = []

    def flush() -> None:
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if line:
                out.append((line, 0 if furniture else 2 if article else 1))

    def close(depth: int) -> None:
        nonlocal furniture, article
        if any(n in BLOCK or n in FURNITURE for n, *_ in opened.stack[depth:]):
            flush()
        furniture, article = opened.close(depth)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text.append(page[at:lt])
        if lt == n:
            break
        m = _TAG.match(page, lt)
        if not m:
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name, attrs = m[2].lower(), m[3]
        if m[1]:
            depth = opened.ended_by(name)
            if depth is not None:
                close(depth)
            elif name in BLOCK:
                flush()
            continue
        if name in BLOCK:
            flush()
            depth = opened.ended_before(name)
            if depth is not None:
                close(depth)
        if name == "br":
            text.append(" ")
            continue
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            continue
        marked = lt not in spared and (_furniture(name, attrs, article > 0) or name == "header" and not article)
        if marked:
            flush()
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in MAIN_IN and furniture and not marked and not holders:
            around = [(e, t) for e, _, _, t in opened.stack if t >= 0]
            if all((e == "form" or e not in FURNITURE) and not _HIDDEN.search(page, t, page.find(">", t) + 1) for e, t in around):
                holders = [t for _, t in around]
        opened.push(name, furniture, article, lt if marked else -1)
        furniture += marked
        article += name in MAIN_IN
    flush()
    return out, holders


def common_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which entries of a lie on a longest common subsequence with b.

    Hirschberg's halving keeps the memory at the length of one row.
    """
    kept = [False] * len(a)

    def lengths(x: list[int], y: np.ndarray) -> np.ndarray:
        row = np.zeros(len(y) + 1, np.int64)
        for v in x:
            new = row.copy()
            np.maximum(new[1:], row[:-1] + (y == v), out=new[1:])
            row = np.maximum.accumulate(new)
        return row

    todo = [(0, len(a), 0, len(b))]
    b_all = np.array(b, np.int64)
    while todo:
        i, j, p, q = todo.pop()
        while i < j and p < q and a[i] == b[p]:
            kept[i] = True
            i, p = i + 1, p + 1
        while i < j and p < q and a[j - 1] == b[q - 1]:
            kept[j - 1] = True
            j, q = j - 1, q - 1
        if i == j or p == q:
            continue
        if j - i == 1:
            kept[i] = bool((b_all[p:q] == a[i]).any())
            continue
        mid = (i + j) // 2
        left = lengths(a[i:mid], b_all[p:q])
        right = lengths(a[mid:j][::-1], b_all[p:q][::-1])[::-1]
        cut = p + int(np.argmax(left + right))
        todo += [(i, mid, p, cut), (mid, j, cut, q)]
    return kept


#: A neighbour sharing more than this percentage of a page's characters is close to it.
CLOSE_PERCENT = 80
#: Differing pages of the host that are looked at on either side.
REACH = 4
#: Pages of a block.
PAGES = 128
#: Decisions up to this many go to every worker; beyond, they are joined.
BROADCAST_PAGES = 100_000
#: Least number of far pages, all sharing it, that make a line inside an article frame.
WITNESSES = 4


def shared_lines(own: list[int], other: list[int]) -> list[bool]:
    """common_lines() of the lines that both have, as no other can be common."""
    there, here = set(other), set(own)
    at = [i for i, x in enumerate(own) if x in there]
    out = [False] * len(own)
    if at:
        for i, s in zip(at, common_lines([own[i] for i in at], [y for y in other if y in here]), strict=True):
            out[i] = s
    return out


def kept_lines(kinds: list[int], sizes: list[int], names: list[int], others: list[tuple[int, list[int]]]) -> tuple[list[int], int]:
    """The places of a page's lines that are text, from its differing neighbours (distance, names), and how many furniture lines one of these shares.

    Open lines go where the nearest far page of either side shares them. With close pages alone
    around (a frame that is most of the text) lines go that the nearest of both sides share. Lines of an article go
    only where all far pages within reach share them and these are four or more, as two articles
    may quote the same paragraph. Outside a marked article an open line needs a neighbour that lacks it.
    Furniture goes in any case.
    """
    whole, marked = sum(n for n, k in zip(sizes, kinds, strict=True) if k), 2 in kinds
    far: list[tuple[int, list[bool]]] = []
    close: list[tuple[int, list[bool]]] = []
    for distance, other in sorted(others, key=lambda x: (abs(x[0]), x[0])):
        shared = shared_lines(names, other)
        is_far = 100 * sum(n for n, s, k in zip(sizes, shared, kinds, strict=True) if s and k) <= CLOSE_PERCENT * whole
        (far if is_far else close).append((distance, shared))
    nearest = [next((s for d, s in far or close if d * side > 0), None) for side in (-1, 1)]
    beside = [s for s in nearest if s is not None]
    shares = any if far else all
    around = [s for _, s in far]
    out, aligned = [], 0
    for i, kind in enumerate(kinds):
        if kind == 0:
            aligned += any(s[i] for _, s in far + close)
            continue
        if kind == 2:
            keep = len(around) < WITNESSES or not all(s[i] for s in around)
        else:
            keep = not (beside and shares(s[i] for s in beside)) and (bool(beside) or not marked)
        if keep:
            out.append(i)
    return out, aligned


def _key(line: str) -> int:
    """A stable 63-bit name of a line."""
    import xxhash

    return xxhash.xxh64_intdigest(line.encode()) >> 1


def place(url: str | None) -> tuple[str, str]:
    """Host and path (with query) of a URL."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or ""), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, the lines with kinds, sizes and names, and a name of them all."""
    schema = "page_id long, url string, host string, path string, lines array<string>, kinds array<int>, sizes array<int>, names array<long>, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for page_id, url, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    got = blocks(page or "")
                    lines, kinds, names = [t for t, _ in got], [k for _, k in got], [_key(t) for t, _ in got]
                    rows.append((page_id, url, *place(url), lines, kinds, [len(t) for t in lines], names, _content(names, kinds)))
                cols = list(zip(*rows, strict=True))
                kinds_of = [pa.int64(), *[pa.string()] * 3, pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
                names_of = ["page_id", "url", "host", "path", "lines", "kinds", "sizes", "names", "content"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_of, strict=True)], names=names_of)

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), run, schema)


def _content(names: list[int], kinds: list[int]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(np.array([names, kinds], np.int64).tobytes())


def _dealt(read: DataFrame) -> DataFrame:
    """block, rank, host, content, kinds, sizes, names of every distinct page with text, and of the pages within reach of its block.

    Pages of equal lines are one page, which stands at the first URL of them. These are
    numbered in the order of (host, path): a range sort gives the order inside partitions, the
    partitions' counts (a row each) their first numbers. A block of numbers is dealt out with the
    few pages before and behind it; a host of any size is never one task.
    """
    order = ["host", "path", "page_id", "content"]
    one = read.filter(F.exists("kinds", lambda k: k > 0)).groupBy("host", "content").agg(F.min(F.struct("path", "page_id", "kinds", "sizes", "names")).alias("p")).select("host", "content", "p.*")
    light = stage(one.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)), "order")
    first = light.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("base"))
    ranked = light.join(first, "part").select((F.col("base") + F.col("k")).alias("rank"), "host", "content", "kinds", "sizes", "names")
    near = F.array_distinct(F.array(*(F.expr(f"(rank + {d}) div {PAGES}") for d in (-REACH, 0, REACH))))
    return ranked.withColumn("block", F.explode(near)).repartition("block").sortWithinPartitions("block", "rank")


def pairings(pages: list[tuple[int, str, list[int]]]) -> Iterator[list[tuple[int, list[int]]]]:
    """For each of these pages (rank, host, names), in order of rank: the distances and names of its host's pages within reach."""
    for i, (rank, host, _) in enumerate(pages):
        yield [(r - rank, names) for r, h, names in pages[max(0, i - REACH) : i + REACH + 1] if h == host and r != rank]


def decided(read: DataFrame) -> DataFrame:
    """host, content, keep (null where it is what tags alone tell), aligned (furniture lines a neighbour shares) of the distinct pages."""

    def of_block(block: int, rows: list[dict]) -> pa.RecordBatch:
        host, content, kept, shared = [], [], [], []
        for r, others in zip(rows, pairings([(r["rank"], r["host"], r["names"]) for r in rows]), strict=True):
            if r["rank"] // PAGES != block:
                continue
            keep, aligned = kept_lines(r["kinds"], r["sizes"], r["names"], others)
            host.append(r["host"])
            content.append(r["content"])
            kept.append(None if keep == [j for j, k in enumerate(r["kinds"]) if k == max(r["kinds"])] else keep)
            shared.append(aligned)
        return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(content, pa.binary()), pa.array(kept, pa.list_(pa.int32())), pa.array(shared, pa.int64())], names=["host", "content", "keep", "aligned"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, PAGES) for r in batch.slice(at, PAGES).to_pylist()):
                if held and held[-1]["block"] != row["block"]:
                    yield of_block(held[0]["block"], held)
                    held = []
                held.append(row)
        if held:
            yield of_block(held[0]["block"], held)

    return map_arrow(_dealt(read), run, "host string, content binary, keep array<int>, aligned long")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of pages; n_aligned and n_tagged, the furniture lines that went by alignment and by tags alone."""
    read = stage(parsed(pages), "parsed")
    with scope():
        told = keep(decided(read), "decided")
    told = F.broadcast(told) if told.count() <= BROADCAST_PAGES else told
    by_tags = "filter(lines, (x, i) -> kinds[i] = CASE WHEN array_contains(kinds, 2) THEN 2 ELSE 1 END)"
    text = F.expr(f"array_join(CASE WHEN keep IS NULL THEN {by_tags} ELSE transform(keep, i -> lines[i]) END, '\n')")
    aligned = F.coalesce("aligned", F.lit(0)).cast("long")
    tagged = F.size(F.filter("kinds", lambda k: k == 0)).cast("long") - aligned
    return read.join(told, ["host", "content"], "left").select("page_id", "url", text.alias("text"), aligned.alias("n_aligned"), tagged.alias("n_tagged"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_aligned", "n_tagged")
