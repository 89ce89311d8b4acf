"""Main text of web pages: repeated runs of the host's sorted suffixes, checked against declared structure.

The token streams of a host's pages, inside and outside their declared articles, are compared by suffix. Suffixes that
begin alike are sorted, the common prefixes of neighbours are the repeated runs at their maximal lengths, and a run that
stands on ``SHARE`` of the host's distinct pages is boilerplate, unless most of these pages have it in their article. Its
tokens go, other runs stay, also those that a few pages share (near copies, quoted passages). The markup of a page then
settles what no run can: an article is whole, and menus, headers, footers, adverts ... go though they stand there only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckloom.llm.common import settled, slices

#: Tokens that must repeat to be boilerplate, on so large a part of the host's pages (and on two at least).
RUN, SHARE = 8, 0.5
#: Keys by which suffixes are sorted: runs are told apart up to DEPTH + RUN - 1 tokens, longer ones are covered by overlapping ones.
DEPTH = 24
#: Bits of the map by which suffixes inside articles are looked up first; those it lets through are compared by key.
BITS = 1 << 24

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>?""", re.S)
_NAMED = re.compile(r"""(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

RAW = frozenset("script style noscript template iframe textarea title select svg math object".split())
DROPPED = frozenset("nav header footer aside form button dialog menu head".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar header masthead footer comment comments disqus reply replies share sharing social "
    "related recommended newsletter subscribe signup popup modal overlay login pagination pager toolbar widget".split()
)
COMMENTS = frozenset("comment comments disqus reply replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Words that turn a class into a statement about a page ("has-sidebar") rather than the thing itself.
ABOUT = frozenset("has with no without show hide".split())

OPEN, KEPT, LEFT = 0, 1, 2


def _mark(name: str, attributes: str, now: int) -> int:
    if now == LEFT or name in DROPPED:
        return LEFT
    inside = KEPT if name in MAIN else now
    if attributes and name not in ("html", "body"):
        for kind, value in _NAMED.findall(attributes):
            value = value.strip("\"'")
            if kind.lower() == "role":
                if value.lower() in ROLES:
                    return LEFT
                inside = KEPT if value.lower() == "main" else inside
            elif kind.lower() == "itemprop":
                inside = KEPT if value.lower() == "articlebody" else inside
            else:
                for one in value.split():
                    words = {w.lower() for w in _WORD.findall(one)}
                    if words & (COMMENTS if name in MAIN else BOILER) and not words & ABOUT:
                        return LEFT
    return inside


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, mark) of every block in page order; references decoded, white space single, empty blocks left out."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    now, at, end = OPEN, 0, len(page)

    def close() -> None:
        if held:
            if text := " ".join(unescape("".join(held)).split()):
                out.append((text, now))
            held.clear()

    for m in _MARKUP.finditer(page):
        a, b = m.span()
        if a < at:
            continue
        if a > at:
            held.append(page[at:a])
        at = b
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if slash:
            if name not in INLINE:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in INLINE and stack[k][1] != now:
                        close()
                    now = stack[k][1]
                    del stack[k:]
                    break
            continue
        if name not in INLINE:
            close()
        if name in RAW:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack:
            # their end tags may be left out: the same one open nearest, with only inline tags in between, ends here
            k = len(stack) - 1
            while k >= 0 and stack[k][0] in INLINE:
                k -= 1
            if k >= 0 and stack[k][0] == name:
                now = stack[k][1]
                del stack[k:]
        mark = _mark(name, attributes, now)
        if mark != now:
            close()
        stack.append((name, now))
        now = mark
    if at < end:
        held.append(page[at:])
    close()
    return out


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _streams(found: list[tuple[str, int]], inside: bool = False) -> list[tuple[int, list[str]]]:
    """(block number, tokens) of the blocks outside declared articles (-1 for those marked as boilerplate), or of those inside."""
    return [(-1 if mark == LEFT else i, text.lower().split()) for i, (text, mark) in enumerate(found) if (mark == KEPT) == inside]


def suffix_keys(tokens: list[str], run: int = RUN) -> np.ndarray:
    """Hash of the first ``run`` tokens of every suffix that has so many."""
    if len(tokens) < run:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(t) for t in tokens], np.uint64)
    out = np.zeros(len(h) - run + 1, np.uint64)
    for k in range(run):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : len(h) - run + 1 + k]
    return out


def _suffixes(inside: bool, wanted: np.ndarray | None = None):
    """Of each page: for every suffix outside its articles (or inside them) its host, row, page content, key and place; outside also a row of place -2 for the page.

    With ``wanted``, a bitmap of keys, only the suffixes whose bit is set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "row", "content", "key", "place"]
        for part in slices(batches, "html"):
            columns: list[list] = [[] for _ in names]
            for row, url, page in zip(*(part.column(c).to_pylist() for c in ("row", "url", "html"))):
                found = blocks(page or "")
                if not found:
                    continue
                keys = suffix_keys([t for _, ts in _streams(found, inside) for t in ts])
                place = np.arange(len(keys), dtype=np.int32)
                if wanted is not None:
                    bit = keys & np.uint64(BITS - 1)
                    hit = (wanted[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
                    keys, place = keys[hit], place[hit]
                content = xxhash.xxh64_intdigest("\n".join(t for t, _ in found)) - (1 << 63)
                keys, place = ([*keys.view(np.int64).tolist()], place.tolist()) if inside else ([0, *keys.view(np.int64).tolist()], [-2, *place.tolist()])
                for column, values in zip(columns, ([host(url)] * len(keys), [row] * len(keys), [content] * len(keys), keys, place)):
                    column += values
            if columns[0]:
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def _bitmap(keys: DataFrame) -> np.ndarray:
    """One bit per key by its lowest bits; or-ed before the shuffle, so at most BITS / 64 words arrive."""
    bit = F.col("key").bitwiseAND(BITS - 1)
    words = keys.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bits")).groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def suffix_bytes(keys: np.ndarray) -> list[bytes]:
    """The suffixes of a stretch of keys in following places, at most DEPTH keys each; their bytes sort as the suffixes do.

    The first key is whole, of the others the upper half is kept: a suffix of n keys has 8 + 4 (n - 1) bytes and n + RUN - 1 tokens.
    """
    first, rest = keys.astype(">u8").tobytes(), (keys >> np.uint64(32)).astype(">u4").tobytes()
    return [first[8 * k : 8 * k + 8] + rest[4 * k + 4 : 4 * (k + DEPTH)] for k in range(len(keys))]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffix of every place of a page, up to where the repeated keys end."""
    for batch in batches:
        for host_, row, content, inside, at in zip(*(batch.column(c).to_pylist() for c in ("host", "row", "content", "inside", "at"))):
            at = sorted({(x["place"], x["key"]) for x in at})
            place, keys = np.array([p for p, _ in at], np.int32), np.array([k for _, k in at], np.int64).view(np.uint64)
            cuts = np.flatnonzero(np.diff(place) != 1) + 1
            found = [s for some in np.split(keys, cuts) for s in suffix_bytes(some)]
            n = len(found)
            yield pa.RecordBatch.from_pydict({
                "host": pa.array([host_] * n, pa.string()), "row": pa.array([row] * n, pa.string()), "content": pa.array([content] * n, pa.int64()), "inside": pa.array([inside] * n, pa.bool_()),
                "place": pa.array(place), "key": pa.array(keys.view(np.int64)), "suffix": pa.array(found, pa.binary()),
            })


def _keys_in(n_bytes: int) -> int:
    return 0 if n_bytes < 8 else 1 + (n_bytes - 8) // 4


def _common(a: bytes, b: bytes) -> int:
    """Bytes of the longest common prefix of two suffixes, in whole keys; 0 if the first keys differ."""
    if a[:8] != b[:8]:
        return 0
    n = 8
    while n < len(a) and n < len(b) and a[n : n + 4] == b[n : n + 4]:
        n += 4
    return n


def _maximal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the sorted suffixes of each host: the longest common prefixes of neighbours nest, and every nested one that enough suffixes share is a run.

    The open prefixes are a stack, so a task holds one suffix and at most DEPTH counts.
    """
    last, last_host, least = None, None, 0.0
    stack: list[list[int]] = []  # [bytes of a prefix of ``last``, suffixes that begin with it so far]
    out: list[tuple[str, int, bytes]] = []

    def back_to(n: int) -> None:
        while stack and stack[-1][0] > n:
            size, count = stack.pop()
            if count >= least:
                out.append((last_host, int.from_bytes(last[:8], "big", signed=True), last[:size]))
            if stack and stack[-1][0] >= n:
                stack[-1][1] += count
            elif n:
                stack.append([n, count])

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.binary()))], names=["host", "key", "run"])
        out.clear()
        return made

    for part in batches:
        for host_, suffix, n, pages in zip(*(part.column(c).to_pylist() for c in ("host", "suffix", "n", "pages"))):
            back_to(_common(last, suffix) if last is not None and host_ == last_host else 0)
            last, last_host, least = suffix, host_, max(2, SHARE * pages)
            if stack and stack[-1][0] == len(suffix):
                stack[-1][1] += n
            else:
                stack.append([len(suffix), n])
        if len(out) > 10_000:
            yield batch()
    back_to(0)
    if out:
        yield batch()


def unique_runs(found: list[tuple[str, int]], covered: list[tuple[int, int]]) -> str:
    """The open blocks without the tokens of the covered runs, given as (first token, tokens) in the stream outside articles."""
    streams = _streams(found)
    gone: set[int] = set()
    for p, n in covered:
        gone.update(range(p, p + n))
    out, at = [], 0
    for i, tokens in streams:
        if i >= 0:
            words = found[i][0].split(" ")
            left = [w for k, w in enumerate(words) if at + k not in gone]
            if left:
                out.append(" ".join(left))
        at += len(tokens)
    return "\n".join(out)


def decided(found: list[tuple[str, int]], covered: list[tuple[int, int]]) -> str:
    """What the runs leave of a page, checked against its markup: declared articles are whole, and where there is one, it is the text."""
    kept = [t for t, mark in found if mark == KEPT]
    return "\n".join(kept) if kept else unique_runs(found, covered)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        texts = [decided(blocks(p or ""), [(x["place"], x["n"]) for x in c or []]) for p, c in zip(part.column("html").to_pylist(), part.column("covered").to_pylist())]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def repeated_runs(rows: DataFrame) -> DataFrame:
    """row, place, n: the stretches of n tokens outside articles that are a run of the host, for ``rows`` (row, url, html).

    A run is a sequence of RUN tokens or more that stands on at least SHARE of the host's distinct pages, on two at least,
    and inside declared articles on half of those at most. So at least half of its pages, that is SHARE / 2 of the host's,
    have it outside: suffixes whose first RUN tokens do not are ruled out before anything is sorted, and of the
    suffixes inside articles only those that begin like the others go on. Both are exact.

    The rest are merged where they are equal and sorted by host. Neighbours' common prefixes give the runs at their
    maximal lengths, with how often they occur; pages are then counted run by run.
    """
    kinds = "host string, row string, content long, key long, place int"
    outside = settled(rows.select("row", "url", "html").mapInArrow(_suffixes(False), kinds), "suffixes")
    sizes = outside.where("place = -2").select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages")).where("pages > 1")
    seen = outside.where("place >= 0").select("host", "key", "content").distinct().groupBy("host", "key").agg(F.count("*").alias("on"))
    likely = settled(seen.join(sizes, "host").where(F.col("on") >= SHARE / 2 * F.col("pages")).select("host", "key", "pages"), "keys")
    inside = rows.select("row", "url", "html").mapInArrow(_suffixes(True, _bitmap(likely)), kinds)
    both = outside.where("place >= 0").withColumn("inside", F.lit(False)).union(inside.withColumn("inside", F.lit(True))).join(likely.select("host", "key"), ["host", "key"], "left_semi")
    at = both.groupBy("host", "row", "content", "inside").agg(F.collect_set(F.struct("place", "key")).alias("at"))
    suffixes = settled(at.mapInArrow(_stretches, "host string, row string, content long, inside boolean, place int, key long, suffix binary"), "sorted")
    merged = suffixes.groupBy("host", "key", "suffix").agg(F.count("*").alias("n")).join(likely, ["host", "key"])
    runs = merged.repartition("host", "key").sortWithinPartitions("host", "suffix").select("host", "suffix", "n", "pages").mapInArrow(_maximal, "host string, key long, run binary")
    hits = suffixes.join(runs, ["host", "key"]).where(F.col("suffix").startswith(F.col("run"))).select("host", "run", "content", "inside", "row", "place")
    hits = settled(hits, "runs")
    counted = hits.groupBy("host", "run", "content").agg(F.max("inside").alias("inside")).groupBy("host", "run").agg(F.count("*").alias("on"), F.count(F.when(F.col("inside"), 1)).alias("within"))
    held = counted.join(sizes, "host").where((F.col("on") >= F.greatest(F.lit(2), SHARE * F.col("pages"))) & (2 * F.col("within") <= F.col("on"))).select("host", "run")
    tokens = ((F.length("run") - 8) / 4 + RUN).cast("int")
    return hits.where(~F.col("inside")).join(held, ["host", "run"]).groupBy("row", "place").agg(F.max(tokens).alias("n"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if there is none) and n_chars for every row of ``pages`` (page_id, url, html).

    Null html: empty text. Repeated rows each get their text; exact copies of a page on one host count as one page, so
    they do not remove each other. A null or broken url is the host of the empty name. Repeated runs inside a declared
    article stay: they are part of the article.

    A host with a third of all pages is no single group: suffixes are dealt by host and first tokens, equal ones and counts
    per key merge before the shuffle. All pages take the same way: the runs found on their host, then their markup.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("row", F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.xxhash64("url", "html")))
    # written, so that its size is known when the pages are joined: a small one is broadcast and no html is shuffled
    covered = settled(repeated_runs(rows).groupBy("row").agg(F.collect_list(F.struct("place", "n")).alias("covered")), "covered")
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType())])
    done = rows.join(covered, "row", "left").select("page_id", "url", "html", "covered").mapInArrow(_finish, schema)
    return done.withColumn("n_chars", F.length("text").cast("long"))
