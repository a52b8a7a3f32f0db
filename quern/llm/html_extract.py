"""Main text of web pages: a suffix array of each host's token streams, and page structure where that leaves a tie.

Markup is read into blocks of text, each marked by where it stands: in an ``article``, in a ``main``, in
chrome (menus, headers, footers, sidebars, notices, adverts, forms, comments), or in none of these. The
blocks of every page, chrome included, are its token stream. The streams of a host are concatenated,
with borders between blocks, and their suffixes sorted; a run of ``RUN`` words or more inside a block
that stands on ``PAGES`` distinct pages and a ``SHARE`` of the host's pages repeats. Pages of a host whose
two longest blocks are equal are copies of one page and count once, so copied articles are no
boilerplate. Hosts are cut into bounded chunks; each chunk sorts its own suffixes and chunks exchange
what they found by name, so counts are those of the whole host, and a hot host is no larger a task
than any other. To spare traffic the least n-gram inside each run (its anchor, the same wherever the run
stands) is counted first; only runs whose anchor repeats are then counted themselves, so nothing is lost.

What a block loses: outside of all structure, the words that a repeated run covers (unique runs stay).
Structure breaks ties: chrome goes though it be unique, an article's words stay though they repeat
(quotations, licences, copies). A page with an article (else a main) gives only what that holds.

Character references are decoded; white space inside a block is one space; blocks are joined by one
space. Null and empty html give an empty text. A null or malformed url is a host of its own. Repeated
rows get equal results. An element that is never closed swallows nothing but scripts and styles, as in
browsers. An empty table gives an empty result; other columns are kept, but for those of the
operator's own names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import blocks
from quern.llm.spark import beside, bounded, written
from quern.llm.texts import CHUNK_BYTES, buffers, chunks, mix, rows_of, span_hashes, spared, window_hashes, word_hashes

RUN = 8
PAGES = 3
#: Measured on pages whose structure is hidden: 0.2 takes 526 of 990,000 words of articles on sf0.1, 0.5 takes none.
SHARE = 0.5

_TAIL = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
#: One piece of markup: a comment, an element that holds no markup, a tag, or a declaration.
MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)\b{_TAIL}.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_TAIL})|<[!?][^>]*+>", re.S | re.I)
#: Elements whose content is no text of the page, if they are closed.
SKIPPED = set("noscript template textarea iframe title svg math object canvas audio video".split())
MARKS = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\shidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("nav footer aside form button select option menu dialog head fieldset datalist".split())
#: Elements that a following block ends even without an end tag.
LOOSE = set("p li dt dd option td th tr".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: A class or id that names chrome as a whole: one of these words, alone or with words of layout around it.
NAMES = re.compile(
    r"(?:(?:main|site|page|top|bottom|primary|secondary|global|header|side|left|right|post|entry|article|user|reader|social|related|cookie|js|c)[-_]+)*"
    r"(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promos?|promotion|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|subscription|paywall"
    r"|comments?|commentlist|disqus|repl(?:y|ies)|respond|sidebars?|widgets?|menus?|nav|navbar|navigation|breadcrumbs?|masthead|footer|share|sharing|social|related|recommended"
    r"|popups?|modal|overlay|login|signup|pagination|pager|copyright|toolbar|skip-?link)"
    r"(?:[-_]+(?:ads?|box|banner|bar|block|area|body|container|content|form|inner|item|items|links?|list|main|menu|notice|outer|panel|section|slot|thread|top|bottom|left|right|unit|widget|wrap|wrapper|\d+))*",
    re.I,
)


def _boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if len(attributes) < 4 or tag in ("html", "body"):
        return False
    if HIDDEN.search(attributes):
        return True
    for m in MARKS.finditer(attributes):
        for value in (m[1] or m[2] or m[3] or "").split():
            if value.lower() in ROLES or NAMES.fullmatch(value):
                return True
    return False


def parse(html: str) -> tuple[list[str], list[str], list[str]]:
    """Blocks inside ``article``, inside ``main``, and outside of both, without chrome."""
    found, kinds = marked(html)
    return tuple([b for b, k in zip(found, kinds, strict=True) if k == kind] for kind in "amp")


def marked(html: str) -> tuple[list[str], str]:
    """Blocks of text, and a letter for each: ``a`` in an article, ``m`` in a main, ``c`` in chrome, ``p`` in none."""
    found: list[str] = []
    kinds: list[str] = []
    text: list[str] = []
    open_: list[list] = []  # [tag, kind, depth] of the articles and mains around
    dropped, depth, unclosed = "", 0, set()

    def end_block() -> None:
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if words:
                found.append(words)
                kinds.append("c" if dropped else "a" if any(o[1] == "a" for o in open_) else "m" if open_ else "p")

    at = 0
    while m := MARKUP.search(html, at):
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag, closing, empty = m[3].lower(), bool(m[2]), m[4][-2:-1] == "/"
        if tag in SKIPPED:
            if not closing and not empty and tag not in unclosed:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                if end:
                    at = end.end()
                else:
                    unclosed.add(tag)
            continue
        if tag not in INLINE:
            end_block()
        if dropped:
            if tag in ("article", "main") and not closing and not open_ or tag == "body" or dropped in LOOSE and tag not in INLINE and tag not in VOID and tag != dropped:
                dropped = ""
            elif tag == dropped:
                depth += -1 if closing else 0 if tag in LOOSE or empty else 1
                if depth > 0 and tag not in LOOSE:
                    continue
                end_block()
                dropped = ""
                if closing:
                    continue
            elif closing and any(o[0] == tag for o in open_):  # the container ends, and with it what was left open inside
                end_block()
                dropped = ""
            else:
                continue
        if tag in VOID:
            continue
        around = next((o for o in reversed(open_) if o[0] == tag), None)
        if closing:
            if around:
                around[2] -= 1
                if not around[2]:
                    del open_[open_.index(around) :]
        elif _boilerplate(tag, m[4], bool(open_)):
            if not empty:
                end_block()
                dropped, depth = tag, 1
        elif tag in ("article", "main") or re.search(r"role\s*=\s*[\"']?main\b", m[4], re.I):
            open_.append([tag, "a" if tag == "article" else "m", 1])
        elif around and not empty:
            around[2] += 1
    text.append(html[at:])
    end_block()
    return found, "".join(kinds)


def parsed(pages: DataFrame, column: str = "html", url: str = "url") -> DataFrame:
    """``pages`` without html, with _host, _blocks, _kinds (see ``marked``), _key (of the two longest blocks) and _page (of all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_html"):
            n = batch.num_columns - 1
            blocks_of, kinds, key, page = [], [], [], []
            for x in batch.column(n).to_pylist():
                found, kind = marked(x) if x else ([], "")
                blocks_of.append(found)
                kinds.append(kind)
                key.append("\n".join(sorted(found, key=lambda b: (-len(b), b))[:2]))
                page.append("\n".join(found))
            hashes = []
            for texts in (key, page):
                data, at = buffers(pa.array(texts, pa.string()))
                hashes.append(pa.array(span_hashes(data, at[:-1], at[1:]).view(np.int64)))
            extra = [pa.array(blocks_of, pa.list_(pa.string())), pa.array(kinds, pa.string()), *hashes]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *extra], [*batch.schema.names[:n], "_blocks", "_kinds", "_key", "_page"])

    base = pages.drop(column, "_host", "_html", "_blocks", "_kinds", "_key", "_page", "_row", "text", "n_chars")
    host = F.coalesce(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1), F.lit(""))
    bounded(pages.sparkSession)
    rows = pages.select(*base.columns, F.lower(host).alias("_host"), F.col(column).alias("_html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "_host string, _blocks array<string>, _kinds string, _key long, _page long"])
    return rows.mapInArrow(spared(run), schema)


def streams(batch: pa.RecordBatch, host: int, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word fingerprints of all blocks of a batch, each word's block, each block's page, each page's host fingerprint."""
    column = batch.column(texts)
    words, first = word_hashes(column.flatten())
    data, at = buffers(batch.column(host))
    page = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
    return words, rows_of(first), page, span_hashes(data, at[:-1], at[1:])


def names_of(words: np.ndarray, block: np.ndarray, page: np.ndarray, host: np.ndarray, start: np.ndarray, run: int) -> np.ndarray:
    """Names of the runs that begin at ``start``: their words and their host. The low byte is left out, to save traffic."""
    name = np.zeros(len(start), np.uint64)
    for k in range(run):
        name = name * np.uint64(0x9E3779B97F4A7C15) + words[start + k]
    return mix(name ^ host[page[block[start]]]) & ~np.uint64(0xFF)


def runs_of(block: np.ndarray, run: int) -> np.ndarray:
    """Where ``run`` words of one block start."""
    start = np.arange(max(0, len(block) - run + 1))
    return start[block[start] == block[start + run - 1]] if len(start) else start


def anchors(words: np.ndarray, start: np.ndarray, run: int) -> np.ndarray:
    """Of the run at each start where its anchor begins: the n-gram in it with the least fingerprint, the first of equals."""
    grams = window_hashes(words, anchor_words(run))
    best = start.copy()
    for k in range(1, run - anchor_words(run) + 1):
        best = np.where(grams[start + k] < grams[best], start + k, best) if len(start) else best
    return best


def anchor_words(run: int) -> int:
    return max(1, run - 3)


def suffix_classes(tokens: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at ``start``, in suffix order by ``depth`` words, and where each class of equal prefixes starts."""
    _, rank = np.unique(tokens, return_inverse=True)
    rank, known = rank.astype(np.int64), 1
    while known < depth:  # prefix doubling, bounded by the depth
        step = min(known, depth - known)
        pair = rank * (len(tokens) + 1)
        pair[: len(pair) - step] += rank[step:] + 1
        _, rank = np.unique(pair, return_inverse=True)
        known += step
    order = start[np.argsort(rank[start], kind="stable")]
    cut = np.flatnonzero(np.append(True, np.diff(rank[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    return order, cut


def repeated(rows: DataFrame, text_bytes: int, run: int, least: int, known: bool) -> DataFrame:
    """From pages (_host, _blocks, _need, _anchors): _host and _often, packed names of what repeats in the host.

    Without ``known`` that are anchors of runs; with it, whole runs whose anchor is among the page's ``_anchors``.
    ``_need`` tells on how many pages a run must stand. Since that is a share of the host's pages, a host has at most
    1 / share times as many such names as a page has words, however many pages it has.
    """
    n_ranges = blocks.ranges(rows.sparkSession, text_bytes)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(piece for b in batches for piece in slices(b, 1)):
            words, block, page, host = streams(batch, 0, 1)
            start, depth = runs_of(block, run), run if known else anchor_words(run)
            at = anchors(words, start, run)
            if known and len(start):
                often = np.unique(batch.column(3).flatten().to_numpy().view(np.uint64))  # a name is of one host
                start = start[np.isin(names_of(words, block, page, host, at, anchor_words(run)), often)]
            elif not known:
                start = np.unique(at)
            if not len(start):
                continue
            order, cut = suffix_classes(words, start, depth)
            hosts, of_page = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            # Suffixes of one class may be of several hosts: of each class and host the pages are counted.
            cls = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(order))))
            pg = page[block[order]]
            by = np.lexsort((pg, of_page[pg], cls))
            cls, pg, order = cls[by], pg[by], order[by]
            new = np.append(True, (cls[1:] != cls[:-1]) | (of_page[pg[1:]] != of_page[pg[:-1]]))
            group = np.cumsum(new) - 1
            holders = np.bincount(group[np.append(True, new[1:] | (pg[1:] != pg[:-1]))]).astype(np.uint32)
            name = names_of(words, block, page, host, order[new], depth)
            by = np.argsort(name)
            name, holders, owner = name[by], holders[by], of_page[pg[new][by]].astype(np.uint32)
            me = blocks.block_id(number)
            at, out = 0, []
            for r, (h, c) in blocks.sliced(name, n_ranges, holders):
                out.append((r, me, b"e" + blocks.pack(h, c, np.array([at], np.uint32))))
                at += len(h)
            need = np.zeros(len(hosts), np.int64)
            need[of_page] = batch.column(2).to_numpy()
            raw = [x.encode() for x in hosts.tolist()]
            table = (owner, need, np.array([len(x) for x in raw], np.uint32), np.frombuffer(b"".join(raw), np.uint8))
            yield blocks.blobs([*out, (blocks.home(me, n_ranges), me, b"d" + blocks.pack(*table))])

    def answer(block: list, payload: list[bytes]) -> Iterator[pa.RecordBatch]:
        out = [(0, b, x) for b, x in zip(block, payload, strict=True) if x[:1] == b"d"]
        entries = [(b, blocks.unpack(x[1:])) for b, x in zip(block, payload, strict=True) if x[:1] == b"e"]
        if entries:
            _, where = np.unique(np.concatenate([e[0] for _, e in entries]), return_inverse=True)
            total = np.bincount(where, weights=np.concatenate([e[1] for _, e in entries])).astype(np.uint32)
            at = 0
            for b, (h, _, first) in entries:
                mine = total[where[at : at + len(h)]]
                at += len(h)
                hit = np.flatnonzero(mine >= least)
                if len(hit):
                    out.append((0, b, b"c" + blocks.pack(h[hit], mine[hit], (hit + int(first[0])).astype(np.uint32))))
        yield blocks.blobs(out)

    def decide(_: list, payload: list[bytes]) -> Iterator[pa.RecordBatch]:
        owner, need, size, raw = next(blocks.unpack(x[1:]) for x in payload if x[:1] == b"d")
        ends = np.cumsum(size, dtype=np.int64)
        hosts = [raw[b - n : b].tobytes().decode() for b, n in zip(ends.tolist(), size.tolist(), strict=True)]
        found = [blocks.unpack(x[1:]) for x in payload if x[:1] == b"c"]
        name, total, at = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64))
        keep = np.flatnonzero(total >= need[owner[at]])
        yield pa.RecordBatch.from_arrays([pa.array([hosts[i] for i in owner[at[keep]].tolist()], pa.string()), pa.array(name[keep].view(np.int64))], ["_host", "name"])

    sent = rows.select("_host", "_blocks", "_need", "_anchors").mapInArrow(spared(send), blocks.BLOBS)
    found = blocks.by_group(blocks.by_group(sent, "range", answer, blocks.BLOBS), "block", decide, "_host string, name long").distinct()
    return found.groupBy("_host").agg(F.sort_array(F.collect_list("name")).alias("_often"))  # bounded: see above


def slices(batch: pa.RecordBatch, texts: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that its lists of blocks hold at most ``most`` bytes (one longer page stands alone)."""
    column = batch.column(texts)
    _, at = buffers(column.flatten())
    ends = at[column.offsets.to_numpy() - column.offsets[0].as_py()] if len(at) > 1 else np.zeros(batch.num_rows + 1, np.int64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def extract(pages: DataFrame, column: str = "html", url: str = "url", run: int = RUN, least: int = PAGES, share: float = SHARE) -> DataFrame:
    """Every row of ``pages``, without its html, with ``text`` and ``n_chars`` (code points) added."""
    rows = written(parsed(pages, column, url).withColumn("_row", F.monotonically_increasing_id()))
    # Copies: of the pages of a host whose two longest blocks are equal, the one with the smallest hash counts.
    groups = rows.where(F.size("_blocks") > 0).groupBy("_host", "_key").agg(F.min(F.struct("_page", "_row"))["_row"].alias("_one"), F.count(F.lit(1)).alias("_c"))
    groups = written(groups)
    sizes = written(groups.groupBy("_host").agg(F.count(F.lit(1)).alias("_n")))
    many = sizes.where(F.col("_n") >= least).select(F.col("_host").alias("_h"), F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("_n"))).cast("long").alias("_need"))
    copied = groups.where("_c > 1").select(F.col("_host").alias("_g"), F.col("_key").alias("_k"), "_one")
    counted = rows.select("_host", "_key", "_row", "_blocks").join(beside(many), F.col("_host") == F.col("_h"))
    counted = counted.join(beside(copied), (F.col("_host") == F.col("_g")) & (F.col("_key") == F.col("_k")), "left").where("_one is null or _one = _row")
    size = rows.agg(F.sum(F.expr("aggregate(_blocks, 0L, (n, b) -> n + octet_length(b))")).alias("n")).first()["n"] or 0
    first = written(repeated(counted.withColumn("_anchors", F.lit(None).cast("array<long>")), size, run, least, known=False))
    first = first.select(F.col("_host").alias("_a"), F.col("_often").alias("_anchors"))
    often = written(repeated(counted.join(beside(first), F.col("_host") == F.col("_a")), size, run, least, known=True))
    joined = rows.join(beside(often.withColumnRenamed("_host", "_h")), F.col("_host") == F.col("_h"), "left")
    own = [c for c in rows.columns if c not in ("_host", "_blocks", "_kinds", "_key", "_page", "_row")]
    n = len(own)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in slices(b, n + 1)):
            words, block, page, host = streams(batch, n, n + 1)
            start = runs_of(block, run)
            free = np.ones(len(words), bool)
            often_of = batch.column(n + 3)
            if len(start) and often_of.null_count < batch.num_rows:
                known = np.unique(often_of.flatten().to_numpy().view(np.uint64))  # a name is of one host
                hit = start[np.isin(names_of(words, block, page, host, start, run), known)]
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, hit, 1)
                np.add.at(change, hit + run, -1)
                free = np.cumsum(change[:-1]) == 0
            ends = np.searchsorted(block, np.arange(len(page) + 1))
            texts, k = [], 0
            for found, kinds in zip(batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), strict=True):
                own_kind = "a" if "a" in kinds else "m" if "m" in kinds else "p"
                kept = []
                for text, kind in zip(found, kinds, strict=True):
                    a, b = ends[k], ends[k + 1]
                    k += 1
                    if kind != own_kind:
                        continue
                    if kind == "p" and not free[a:b].all():
                        text = b" ".join(w for w, f in zip(text.encode().split(), free[a:b].tolist(), strict=True) if f).decode()
                    if text:
                        kept.append(text)
                texts.append(" ".join(kept))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(texts, pa.string())], [*batch.schema.names[:n], "text"])

    base = rows.select(*own)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "text string"])
    out = joined.select(*own, "_host", "_blocks", "_kinds", "_often").mapInArrow(spared(cut), schema)
    return out.select(*own, "text", F.char_length("text").cast("long").alias("n_chars"))
