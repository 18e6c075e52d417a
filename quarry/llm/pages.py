"""Main text of web pages: differencing with the pages of the nearest URLs, and page structure.

A page is read once into a list of lines, one per block element, of all that
it shows.  Pages are paired within each host with the pages next to them in
the order of URL paths, two before and two after; the lines of both are
aligned by a longest common subsequence, and lines that a page shares with two
of them (with one, if there are fewer than three) are boilerplate and go:
menus, headers, footers, sidebars and notices repeat from page to page.

Structure decides what cannot repeat or has nothing to be compared with.
Elements that are by name, class or id adverts, notices, forms, reader
comments or lists of other articles, or hidden, give no text, nor do menus,
headers, footers and sidebars whose lines no other page shares.  If a page
marks an article or main part, only that counts, and its lines stay, since
different articles may share sentences: there only whole elements that are
forms, menus, footers, adverts or reader comments by name or class, or hidden,
give no text, and never a part of a sentence for its class.  A few class words
(search, tags, widget) count only for a page that has no other to be compared
with.

Copies are not compared, since the lines they share are the article: pages of
equal lines at a host are one class, a run of neighbouring classes of nearly
equal lines is passed over, and each class meets the nearest different pages.
"""

from __future__ import annotations

import bisect
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "desc", "metadata", "annotation", "object", "canvas", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_INLINE |= {"svg", "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "msup", "msub", "msubsup", "mover", "munder", "munderover", "mstyle", "semantics"}
_BARS = {"nav", "footer", "aside", "header", "menu"}
_DROPPED = {"nav", "footer", "aside", "form", "select", "button", "dialog", "menu", "head", "fieldset", "datalist"}
_COMMENT = {"comment", "reply"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Words in class, id and role that mark what is not main text.
_LAYOUT = {"nav", "navbar", "navigation", "menu", "sidebar", "header", "masthead", "banner", "topbar", "breadcrumb", "breadcrumbs", "complementary", "contentinfo", "footer", "toolbar", "skip"}
_EXTRA = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "sharing", "comments", "respond", "replies", "disqus", "disclaimer", "copyright", "pagination", "pager"}
#: The same, of whole elements outside articles.
_ASIDE = {"notice", "notification", "alert", "share", "social", "related", "recommended", "comment", "reply", "discussion"}
_OUTSIDE = _EXTRA | _ASIDE
#: The same, of whole elements inside articles.
_WITHIN = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsored", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "comment", "comments", "reply", "replies", "respond", "disqus"}
#: Words that mark what may or may not be main text.
_WEAK = {"search", "widget", "tags"}
#: What structure says of a line: in a marked article, nothing, perhaps no main text, part of the page's frame by class or by element, certainly no main text.
ARTICLE, PLAIN, WEAK, FRAME, BAR, OUT = range(6)
MATCHES = 1_000_000  # pairs of equal lines of two pages that are looked at one by one


def _marks(attributes: str) -> tuple[set[str], bool]:
    """The words in class, id and role; is the element hidden?"""
    words: set[str] = set()
    hidden = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role"):
            words.update(_WORDS.findall(value))
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value == "true"
        else:
            hidden |= re.sub(r"\s", "", value).find("display:none") >= 0
    return words, hidden


def lines(page: str) -> list[tuple[str, int]]:
    """(text, what structure says of it) of each block that a page shows."""
    out: list[tuple[str, int]] = []
    block: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = []  # name, what its lines are outside articles, inside an article, inline text to be skipped
    kind, inside, skip, marked = PLAIN, False, False, False

    def end() -> None:
        if block:
            line = " ".join(html.unescape("".join(block)).split())
            block.clear()
            if line:
                out.append((line, ARTICLE if inside and kind < FRAME else kind))

    def pop(to: int) -> None:
        nonlocal kind, inside, skip
        now = stack[to - 1][1:] if to else (PLAIN, False, False)
        if now[:2] != (kind, inside):
            end()
        del stack[to:]
        kind, inside, skip = now

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at and not skip:
            block.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name not in _INLINE:
            end()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
            continue
        if name in _VOID:
            continue
        if name in _RAW:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        if stack and name not in _INLINE:
            if stack[-1][0] == "p":
                pop(len(stack) - 1)
            while stack and stack[-1][0] in _CLOSES.get(name, ()):
                pop(len(stack) - 1)
        words, hidden = _marks(m[3]) if m[3] else ((), False)
        now, within, silent = kind, inside, skip
        if name not in ("html", "body"):
            extra, layout, weak = (words and not x.isdisjoint(words) for x in (_EXTRA, _LAYOUT, _WEAK))
            if name in _INLINE:
                silent |= bool(hidden or not inside and (extra or layout))
            elif name in ("article", "main") or "main" in words and "role" in m[3].lower():
                if now in (WEAK, FRAME):
                    now = PLAIN
                if name == "article" and (extra or not _COMMENT.isdisjoint(words)):
                    now = OUT
                if now < FRAME:
                    within = marked = True
            elif now < OUT:
                extra = words and not (_WITHIN if inside else _OUTSIDE).isdisjoint(words)
                if hidden or extra or name in _DROPPED or name == "header" and not inside:
                    now = BAR if name in _BARS and not (hidden or extra) else OUT
                elif layout and not (inside and name == "header"):
                    now = max(now, FRAME)
                elif weak and now == PLAIN:
                    now = WEAK
        if m[3].endswith("/") and name not in _INLINE and name not in ("p", "div", "article", "main"):
            continue
        stack.append((name, now, within, silent))
        kind, inside, skip = now, within, silent
    if at < len(page) and not skip:
        block.append(page[at:])
    end()
    return [(t, OUT if k in (PLAIN, WEAK) else k) for t, k in out] if marked else out


def main_text(found: list[tuple[str, int]], shared: set[int], compared: bool) -> str:
    """The text of the lines that are not boilerplate; shared are the places that comparison deletes."""
    return " ".join(t for i, (t, k) in enumerate(found) if k == ARTICLE or k < FRAME and i not in shared and (k == PLAIN or compared))


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The lengths of the longest common subsequences of a and each prefix of b, on bit vectors."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        hit = v & where.get(x, 0)
        v = (v + hit | v - hit) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[int], b: list[int]) -> list[int]:
    """The places in a of a longest common subsequence of a and b.

    The work follows the number of pairs of equal lines; beyond MATCHES of them
    (long pages that repeat a few lines) the problem is halved first, so memory
    follows the lengths.
    """
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    where: dict[int, list[int]] = {}
    for j in range(m - 1, lo - 1, -1):
        where.setdefault(b[j], []).append(j)
    if n - lo > 1 and sum(len(where.get(x, ())) for x in a[lo:n]) > MATCHES:
        half = (lo + n) // 2
        front, back = _prefix_lengths(a[lo:half], b[lo:m]), _prefix_lengths(a[half:n][::-1], b[lo:m][::-1])[::-1]
        j = lo + int(np.argmax(front + back))
        middle = [lo + i for i in common(a[lo:half], b[lo:j])] + [half + i for i in common(a[half:n], b[j:m])]
        return [*range(lo), *middle, *range(n, len(a))]
    ends: list[int] = []  # least last place in b of a common subsequence of each length
    nodes: list[tuple] = []
    for i in range(lo, n):
        for j in where.get(a[i], ()):
            k = bisect.bisect_left(ends, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(ends):
                ends.append(j), nodes.append(node)
            else:
                ends[k], nodes[k] = j, node
    middle = []
    node = nodes[-1] if nodes else None
    while node:
        middle.append(node[0])
        node = node[1]
    return [*range(lo), *reversed(middle), *range(n, len(a))]


def copies(hashes: list[int], words: list[int], other: list[int], same: list[int]) -> bool:
    """Are nearly all lines equal: all but a twentieth of the words, and of the lines of both pages?"""
    few = max(len(hashes), len(other)) - len(same)
    return 20 * sum(words[i] for i in same) >= 19 * sum(words) and 20 * few <= max(len(hashes), len(other))


def shared_lines(hashes: list[int], words: list[int], others: list[list[int]]) -> tuple[list[int], bool]:
    """Places of the lines that a page shares with two of the others, or with one of fewer than three; was there any to compare with?

    Copies of the page among the others do not count.
    """
    votes = Counter()
    n = 0
    for other in others:
        same = common(hashes, other)
        if not copies(hashes, words, other, same):
            n += 1
            votes.update(same)
    return sorted(i for i, v in votes.items() if v >= (2 if n > 2 else 1)), n > 0


_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def _read(pages: DataFrame) -> DataFrame:
    """page_id, row, url, host, path, and of the lines: kinds, hashes, numbers of words, and body (the texts of those that may be main text, compressed)."""

    def run(batches):
        for batch in scratch.cut(batches, 256):
            made: dict[str, list] = {"kinds": [], "lines": [], "words": [], "body": []}
            for x in batch.column(5):
                found = lines(x.as_py() or "")
                made["kinds"].append([k for _, k in found])
                made["lines"].append([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in found])
                made["words"].append([len(t.split()) for t, _ in found])
                made["body"].append(zlib.compress("\n".join(t for t, k in found if k < FRAME).encode()))
            types = {"kinds": pa.list_(pa.int8()), "lines": pa.list_(pa.int64()), "words": pa.list_(pa.int32()), "body": pa.binary()}
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(v, types[k]) for k, v in made.items())], [*batch.schema.names[:5], *made])

    url = F.coalesce(F.col("url"), F.lit(""))
    slim = pages.select("page_id", "row", "url", F.lower(F.regexp_extract(url, _HOST, 1)).alias("host"), F.regexp_extract(url, _PATH, 1).alias("path"), "html")
    return slim.mapInArrow(run, "page_id long, row long, url string, host string, path string, kinds array<byte>, lines array<long>, words array<int>, body binary")


def _copy(own: dict, other: dict) -> bool:
    return own["host"] == other["host"] and copies(own["lines"], own["words"], other["lines"], common(own["lines"], other["lines"]))


def _ordered(classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """same, host, lines, words and run: the number, in the order of hosts and paths, of the run of nearly equal neighbours a class is in; first: does it begin the run?

    Runs are counted in each partition of a range sort; whether one goes on in
    the next partition shows by comparing the rows at the border.  Also the
    tables that were made for it.
    """
    ordered = classes.repartitionByRange("host", "path", "same").sortWithinPartitions("host", "path", "same")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, run, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in scratch.cut(batches):
            runs, first = [], []
            for r in batch.select(["host", "lines", "words"]).to_pylist():
                first.append(last is None or not _copy(r, last))
                run += first[-1]
                runs.append(run)
                last = r
            here = np.arange(n, n + len(batch))
            n += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(here), pa.array(runs, pa.int64()), pa.array(first, pa.bool_())], [*batch.schema.names, "part", "at", "run", "first"])

    placed = scratch.table(ordered.select("same", "host", "lines", "words").mapInArrow(number, "same long, host string, lines array<long>, words array<int>, part int, at long, run long, first boolean"), "outline")
    border = F.struct("host", "lines", "words")
    order = Window.orderBy("part")  # over one row per partition
    parts = placed.groupBy("part").agg(F.max("run").alias("n"), F.min_by(border, "at").alias("head"), F.max_by(border, "at").alias("tail"))
    parts = parts.select("part", "n", "head", F.lag("tail").over(order).alias("before"))

    def join(batches):
        for batch in batches:
            joined = [int(bool(r["before"]) and _copy(r["head"], r["before"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(joined, pa.int64())], ["part", "n", "joined"])

    joined = scratch.table(parts.mapInArrow(join, "part int, n long, joined long"), "borders")
    start = F.coalesce(F.sum(F.col("n") - F.col("joined")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("joined")
    starts = joined.select("part", "joined", start.alias("start"))
    ordered = placed.join(starts, "part").select("same", "host", "lines", "words", (F.col("start") + F.col("run")).alias("run"), (F.col("first") & ((F.col("at") > 0) | (F.col("joined") == 0))).alias("first"))
    return ordered, [placed, joined]


def _shared(placed: DataFrame) -> DataFrame:
    """same, gone (places of the lines that comparison deletes) for each ordered class that is compared with another page.

    A run of copies is represented to the two runs on either side by its first class.
    """
    sides = F.explode(F.array(*(F.col("run") + k for k in (-2, -1, 1, 2)))).alias("run")
    others = placed.where("first").select(F.struct("host", "lines").alias("page"), sides).groupBy("run").agg(F.collect_list("page").alias("others"))  # four at most
    pairs = placed.join(others.hint("merge"), "run").select("same", "host", "lines", "words", "others")

    def run(batches):
        for batch in scratch.cut(batches):
            keep, gone = [], []
            for i, r in enumerate(batch.to_pylist()):
                near = [x["lines"] for x in r["others"] if x["host"] == r["host"] and r["host"]]
                found, compared = shared_lines(r["lines"], r["words"], near)
                if compared:
                    keep.append(i), gone.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(gone, pa.list_(pa.int32()))], ["same", "gone"])

    return pairs.mapInArrow(run, "same long, gone array<int>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points), n_lines, n_shared and n_ruled for every row of pages.

    n_lines counts the lines that the page shows, n_shared those that only the
    comparison or the comparison first finds to be boilerplate (lines of a
    marked article apart), n_ruled those that structure alone leaves out.  A
    null html or url counts as empty; a page without a host is compared with
    none.  White space inside a block becomes one space, blocks are joined by
    one space.  Rows with equal ids are told apart by their contents, rows
    that are wholly equal are all kept; an empty table gives no rows, and
    other columns of pages, whatever their names, take no part.  A page of any
    length is read as a whole.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.xxhash64(url_col, html_col).alias("row"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    read = scratch.table(_read(slim), "page-lines")
    keyed = read.select("page_id", "row", F.xxhash64("host", "lines", "kinds").alias("same"), "host", "path", "lines", "words")
    classes = keyed.groupBy("same").agg(F.min("path").alias("path"), *(F.any_value(c).alias(c) for c in ("host", "lines", "words")))
    ordered, made = _ordered(classes)
    shared = scratch.table(_shared(ordered), "shared-lines")
    for done in made:
        scratch.drop_table(pages.sparkSession, done)
    # Every page has a row here, so all joins are merges at any size.
    gone = scratch.table(keyed.select("page_id", "row", "same").join(shared.hint("merge"), "same").select("page_id", "row", "gone").dropDuplicates(["page_id", "row"]), "page-deletions")
    scratch.drop_table(pages.sparkSession, shared)
    r, g = read.alias("r"), gone.hint("merge").alias("g")
    joined = r.join(g, F.col("r.page_id").eqNullSafe(F.col("g.page_id")) & (F.col("r.row") == F.col("g.row")), "left").select("r.page_id", "r.url", "r.body", "r.kinds", "g.gone")

    def run(batches):
        for batch in scratch.cut(batches, 256):
            text, n, shared, ruled = [], [], [], []
            for body, kinds, gone in zip(*(batch.column(k) for k in (2, 3, 4)), strict=True):
                texts, kinds, places = iter(zlib.decompress(body.as_py()).decode().split("\n")), kinds.as_py(), set(gone.as_py() or ())
                text.append(main_text([(next(texts) if k < FRAME else "", k) for k in kinds], places, gone.is_valid))
                n.append(len(kinds))
                shared.append(sum(kinds[i] != ARTICLE for i in places))
                ruled.append(sum(i not in places and (k >= FRAME or k == WEAK and not gone.is_valid) for i, k in enumerate(kinds)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(text, pa.string()), *(pa.array(x, pa.int64()) for x in ([len(t) for t in text], n, shared, ruled))], ["page_id", "url", "text", "n_chars", "n_lines", "n_shared", "n_ruled"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_lines long, n_shared long, n_ruled long")
