"""Main text of web pages: page structure and nearest-URL page differencing.

A page is cut into lines, one a block element. Lines in menus, headers, footers, sidebars, notices, adverts, forms,
reader comments and the like are furniture by their element, role, class or id. Pages of a host are put in order of
their URL paths, and each is aligned with the page before and the page after it by a longest common subsequence of
lines; lines shared with either are the site's, not the page's, and are deleted. Where the articles of a page hold as
much text as the rest without furniture, all of them are its text, and their lines are never deleted by that: a copy of an article under another URL is not furniture. Nor are those of two pages whose lines
without furniture are nearly the same (COPY of the shorter one), as they are copies.

The order over all pages is a range partitioning of host, path and row number. Neighbours in a part are aligned as they
stand; the last page of a part meets the first one of the next in an equi-join. So a host may hold any share of the pages,
and only 64-bit hashes of lines travel.

Defined results: a null or empty html has no text (""); a null or odd url has no host and no neighbours; pages of one
host with equal paths are neighbours in row order; repeated rows are rows of their own; a null page_id stays null; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

COPY = 0.8
#: Share of a line's text in links from which a line outside an article is a menu entry.
LINKS = 0.9

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|select|object)\b(?:[^>]*/>|.*?(?:</(?P=raw)\s*>|\Z))"
    r"""|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^"'<>]++|"[^"<]*+"|'[^'<]*+')*+|[^>]*)>|<[!?][^>]*>""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Elements by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu dialog button head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMED = re.compile(
    r"(?:(?:site|page|main|top|global|primary|secondary|left|right|bottom|my|the)[-_]?)?"
    r"(?:ads?|adverts?|advertisements?|advertising|adsense|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|footnotes?-nav|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter"
    r"|notices?|notification|overlay|pager|pagination|popup|promo|related|reply|respond|search|share|sharing|sidebar|signup|skip|social|sponsor(?:ed)?|subscribe|toolbar|widget)(?:[-_].*)?",
    re.I,
)
IMPLIED = frozenset("p li dt dd tr td th option".split())


def is_furniture(tag: str, rest: str, inside: bool) -> bool:
    """Whether an element is no part of the main text; inside: within an article."""
    if tag in FURNITURE or tag == "header" and not inside:
        return True
    if not rest or tag in ("html", "body", "article", "main") and "comment" not in rest:
        return False
    for name, *values in ATTRIBUTE.findall(rest):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value.lower() in ROLES or name in ("class", "id") and any(NAMED.fullmatch(x) for x in value.split()):
            return True
    return False


def page_lines(text: str | None) -> list[tuple[str, int, int, int]]:
    """Lines of a page: text, furniture (0 or 1), number of its article (0: none), characters in links."""
    out: list[tuple[str, int, int, int]] = []
    if not text:
        return out
    stack: list[tuple[str, bool, int]] = []  # open block elements: tag, furniture, article
    parts: list[tuple[str, bool]] = []
    link, articles, bad, article = False, 0, False, 0

    def flush() -> None:
        if parts:
            line = " ".join(entities.unescape("".join(x for x, _ in parts)).split())
            if line:
                out.append((line, int(bad), article, len(" ".join(entities.unescape("".join(x for x, k in parts if k)).split()))))
            parts.clear()

    since = 0
    for m in TOKEN.finditer(text):
        if m.start() > since:
            parts.append((text[since : m.start()], link))
        since = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                parts.append((" ", link))
            elif tag == "a":
                link = not m["end"]
            elif not m["end"] and m["rest"] and is_furniture(tag, m["rest"], article > 0) and not m["rest"].endswith("/") and tag not in VOID:
                flush()  # a hidden or named inline element stands for itself
                stack.append((tag, True, article))
                bad = True
                continue
            elif m["end"] and stack and stack[-1][0] == tag:
                flush()
                stack.pop()
                bad, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            continue
        flush()
        link = False
        if m["end"]:
            if any(x[0] == tag for x in stack):
                while stack.pop()[0] != tag:
                    pass
        elif tag not in VOID and not m["rest"].endswith("/"):
            if tag in IMPLIED and stack and stack[-1][0] == tag:
                stack.pop()
            up_bad, up_article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            if tag == "article" and not up_article and not up_bad:
                articles += 1
                up_article = articles
            stack.append((tag, up_bad or is_furniture(tag, m["rest"], up_article > 0), up_article))
        bad, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
    if since < len(text):
        parts.append((text[since:], link))
    flush()
    return out


def main_flags(lines: list[tuple[str, int, int, int]]) -> tuple[list[bool], bool]:
    """Whether each line is main text by structure, and whether an article holds those: then differencing spares them."""
    inner = sum(len(line) for line, bad, article, _ in lines if article and not bad)
    outer = sum(len(line) for line, bad, article, linked in lines if not article and not bad and linked < LINKS * len(line))
    if inner and inner >= outer:
        return [article > 0 and not bad for _, bad, article, _ in lines], True
    return [not bad and (article > 0 or linked < LINKS * len(line)) for line, bad, article, linked in lines], False


def _prefix_lcs(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and every prefix of b, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for k, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(bits, bitorder="little")[: len(b)].astype(np.int64))])


def shared_lines(a: list[int], b: list[int], first: int = 0) -> list[int]:
    """Positions in a (plus first) of a longest common subsequence with b, by divide and conquer in linear memory."""
    out, head = [], 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        out.append(first + head)
        head += 1
    a, b, first, tail = a[head:], b[head:], first + head, []
    while a and b and a[-1] == b[-1]:
        tail.append(first + len(a) - 1)
        a, b = a[:-1], b[:-1]
    if len(a) == 1:
        out += [first] if a[0] in b else []
    elif a and b:
        half = len(a) // 2
        cut = int((_prefix_lcs(a[:half], b) + _prefix_lcs(a[half:][::-1], b[::-1])[::-1]).argmax())
        out += shared_lines(a[:half], b[:cut], first) + shared_lines(a[half:], b[cut:], first + half)
    return out + tail[::-1]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, row, packed, hashes, main, owned: one row a page with all its lines and main_flags of them.

    Lines are packed, as they are written and shuffled whole; their hashes are what alignment reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                cut = [page_lines(x) for x in part.column("html").to_pylist()]
                flags = [main_flags(x) for x in cut]
                texts = [[x[0].encode() for x in lines] for lines in cut]
                hashes = [[int.from_bytes(blake2b(x, digest_size=8).digest(), "little", signed=True) for x in lines] for lines in texts]
                packed = [zlib.compress(b"\n".join(lines)) for lines in texts]  # no line holds a line feed
                cells = [pa.array(packed, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array([f[0] for f in flags], pa.list_(pa.bool_())), pa.array([f[1] for f in flags], pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *cells], names=["page_id", "url", "packed", "hashes", "main", "owned"])

    kind = pages.schema["page_id"].dataType.simpleString()
    cut = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, packed binary, hashes array<long>, main array<boolean>, owned boolean")
    address = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)"
    host, path = (F.regexp_extract("url", address, k) for k in (1, 2))
    return cut.withColumns({"host": F.when(F.lower(host) != "", F.lower(host)), "path": path, "row": F.monotonically_increasing_id()})


def site_lines(own: dict, other: dict) -> list[int]:
    """Lines of a page that it shares with a neighbour and that aren't spared."""
    shared = shared_lines(own["hashes"], other["hashes"])
    inner = [k for k in shared if own["main"][k]]
    # of copies only the furniture is the site's
    copies = len(inner) >= COPY * max(1, min(sum(own["main"]), sum(other["main"])))
    return [k for k in shared if not own["main"][k] or not (copies or own["owned"])]


#: Lines to delete of a page, and the first and the last page of a part with all that its neighbour needs.
FOUND = "row long, gone array<int>, part int, first boolean, host string, own struct<hashes:array<long>,main:array<boolean>,owned:boolean>"


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of a part in order, each aligned with the one before; then the part's edges."""
    part, before, edge = TaskContext.get().partitionId(), None, None
    kinds = pa.schema([("row", pa.int64()), ("gone", pa.list_(pa.int32())), ("part", pa.int32()), ("first", pa.bool_()), ("host", pa.string()), ("own", pa.struct([("hashes", pa.list_(pa.int64())), ("main", pa.list_(pa.bool_())), ("owned", pa.bool_())]))])
    for batch in batches:
        out = []
        for page in batch.to_pylist():
            edge = edge or page
            if before and before["host"] == page["host"]:
                out += _both(before, page)
            before = page
        yield pa.RecordBatch.from_pylist(out, kinds)
    if before:
        yield pa.RecordBatch.from_pylist([{"row": x["row"], "part": part, "first": k == 0, "host": x["host"], "own": x["own"]} for k, x in enumerate((edge, before))], kinds)


def _both(a: dict, b: dict) -> list[dict]:
    made = ({"row": x["row"], "gone": site_lines(x["own"], y["own"])} for x, y in ((a, b), (b, a)))
    return [x for x in made if x["gone"]]


def neighbours(lines: DataFrame) -> DataFrame:
    """row, gone: the lines of each page that the pages before and after it on its host delete; pages without any are left out."""
    hashed = lines.where("host is not null").select("row", "host", "path", F.struct("hashes", "main", "owned").alias("own"))
    # Numbers end in the path's order too: /page/9 stands before /page/10.
    key = F.regexp_replace("path", r"(\d+)", "00000000000000000000$1")
    key = F.regexp_replace(key, r"0*(\d{20})(?!\d)", "$1")
    parts = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = hashed.withColumn("key", key).repartitionByRange(parts, "host", "key", "row").sortWithinPartitions("host", "key", "row")
    found = materialise(ranged.select("row", "host", "own").mapInArrow(_aligned, FOUND), "page-order")
    # two pages for each part: the last one meets the first one of the next part that has pages
    edges = found.where("part is not null")
    there = sorted(r["part"] for r in edges.select("part").distinct().collect())
    later = [F.lit(x) for pair in zip(there, there[1:], strict=False) for x in pair]
    inner = found.where("part is null").select("row", "gone")
    if later:
        last = edges.where("not first").select(F.create_map(*later)[F.col("part")].alias("part"), F.struct("row", "host", "own").alias("a"))
        met = last.join(edges.where("first").select("part", F.struct("row", "host", "own").alias("b")), "part").where("a.host = b.host")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [x for r in batch.to_pylist() for x in _both(r["a"], r["b"])]
                yield pa.RecordBatch.from_pylist(out, pa.schema([("row", pa.int64()), ("gone", pa.list_(pa.int32()))]))

        inner = inner.unionByName(met.select("a", "b").mapInArrow(run, "row long, gone array<int>"))
    return inner.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))  # two lists at most


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_shared of every row of pages (page_id, url, html); lines of text are joined by two line feeds.

    Every page is aligned with its neighbours. n_shared counts the lines that differencing deletes, furniture among them;
    the lines of an article that holds the text are aligned but spared.
    """
    cut = materialise(parsed(pages), "page-lines")
    joined = cut.select("row", "page_id", "url", "packed", "main").join(neighbours(cut), "row", "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for packed, main, lost in zip(*(batch.column(c).to_pylist() for c in ("packed", "main", "gone")), strict=True):
                lines, lost = zlib.decompress(packed).decode().split("\n") if main else [], set(lost or ())
                made.append("\n\n".join(x for k, (x, keep) in enumerate(zip(lines, main, strict=True)) if keep and k not in lost))
            counts = [len(x or ()) for x in batch.column("gone").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(made, pa.string()), pa.array(counts, pa.int64())], names=["page_id", "url", "text", "n_shared"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "packed", "main", "gone").mapInArrow(texts, f"page_id {kind}, url string, text string, n_shared long")
