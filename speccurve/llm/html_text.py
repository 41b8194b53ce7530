"""Main text of web pages: markup says what is an article or page furniture; a
suffix array per host says what else is repeated from page to page.

The token stream of a page holds the words of its blocks outside the article,
each block after a mark of its own.  The streams of a host are one text, and a
substring of RUN tokens or more that occurs on two different pages is
boilerplate.  In the sorted array of all suffixes its occurrences are
neighbours, and each of its positions begins a repeat of RUN tokens, except the
last ones, which those before cover.  So suffixes need to be told apart by
their first RUN tokens only: the array is a table with one entry for each such
prefix of a host, with the smallest and largest page that has it.

The words of the articles are streams of their own.  There a repeat is a whole
block, or LONG tokens or more, on many distinct pages of the host.  Of their
suffixes those that begin at seeds are compared first: each LONG tokens in a row
have the same seed wherever they stand, so a repeat has a repeated seed, and
only the runs of LONG tokens around repeated seeds are compared in full.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speccurve.llm.common import dropped, map_texts, maybe_broadcast, stored
from speccurve.llm.near_dup import mix

RUN = 5
# Share of a block's words from which repeats make it boilerplate, and of an
# article's words from which they make it a copy of other pages' articles.
COVERED = 0.5
# Tokens of a repeat inside an article, unless it is a whole block, and on how many
# distinct pages of the host and on what share of them it has to be.
LONG = 30
PAGES, SHARE = 3, 0.25
LOOKS = mix(np.arange(1, 5, dtype=np.uint64))

# Elements and words of HTML.
_RAW = "script|style|textarea|title|template|noscript|iframe|svg|math|select|object|canvas"
_FURNITURE = frozenset(
    "nav header footer aside form menu dialog button head video audio label input fieldset".split()
)
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup sidebar menu nav navigation navbar breadcrumb breadcrumbs masthead footer comment "
    "comments respond reply replies disqus share sharing social related recommended widget "
    "toolbar pagination pager login search contentinfo complementary".split()
)
# Words that may follow a mark in a class, and words that turn one around.
_TRAILERS = frozenset(
    "active area bar block box boxes button buttons container content desktop fixed form group "
    "hidden icons inline inner item items large left links list mobile open outer panel posts right "
    "section small sticky stories top bottom visible wrap wrapper".split()
)
_NEGATIONS = frozenset("with has no without not non is show hide toggle".split())
_ARTICLE_WORDS = frozenset("article post entry story content main".split())
# Share of the words that makes an element their holder, whatever its class says,
# and that blocks of a level need to be the article beside lower levels.
HOLDER, ARTICLE = 0.5, 1 / 3

_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    rf"|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(
    r"(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?",
    re.IGNORECASE,
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _marked(token: str, inside: int) -> int:
    """Does a class, id or role name page furniture?  Its last word does (2), or
    that before words like box or list (1): ``with-sidebar`` and ``related-work``
    do not."""
    words = [w.lower() for w in _WORDS.findall(token)]
    sure = 2
    while len(words) > 1 and (words[-1] in _TRAILERS or words[-1].isdigit()):
        words.pop()
        sure = 1
    if not words or words[0] in _NEGATIONS:
        return 0
    return sure * (words[-1] in _MARKS or (words[-1] == "header" and not inside))


def _look(name: str, rest: str, inside: int) -> tuple[int, int]:
    """Is the element page furniture (3: surely, 2: by its class, 1: a form, or
    something around what its class names), and how surely does it hold the
    article (0 to 3)?"""
    furniture = 3 * (name in _FURNITURE and not (name == "header" and inside))
    furniture = 1 if name == "form" else furniture
    level = 3 if name == "article" else 2 if name == "main" else 0
    if rest.strip(" /"):
        for attribute, value in _ATTRIBUTE.findall(rest):
            attribute = attribute.lower()
            tokens = value.strip("\"'").split()
            if attribute == "style":
                hides = "display:none" in value.replace(" ", "").lower()
                furniture = max(furniture, 3 * hides)
            elif attribute == "hidden" or (attribute == "aria-hidden" and tokens == ["true"]):
                furniture = 3
            elif attribute == "itemprop":
                level = max(level, 3 if value.strip("\"'").lower() == "articlebody" else 0)
            else:
                furniture = max(furniture, *[_marked(t, inside) for t in tokens], 0)
                words = [w.lower() for t in tokens for w in _WORDS.findall(t)]
                if attribute == "role" and words in (["main"], ["article"]):
                    level = max(level, 2)
                elif not _ARTICLE_WORDS.isdisjoint(words):
                    level = max(level, 1)
    # What calls itself the article is none of the furniture that a class names.
    return (0 if level >= 2 and furniture < 3 else furniture), level


def blocks(page: str) -> list[tuple[int, str]]:
    """(level, text) of every block in page order; level -1: page furniture,
    0: anywhere, 1 to 3: in an element that holds the article.

    An element that is furniture by its class only is not if the article stands
    in it; a form, or one with a class like ``login-wrapper``, also if most of
    the page's words do."""
    found: list[tuple[int, str]] = []  # element, text
    held: list[str] = []
    # Elements: their parent, whether they are furniture, their level.
    parents, furnitures, levels = [0], [0], [0]
    stack: list[tuple[str, int]] = [("", 0)]  # open elements
    at = 0

    def end_block() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                found.append((stack[-1][1], text))

    def text_to(stop: int) -> None:
        if stop > at:
            part = page[at:stop]
            held.append(html.unescape(part) if "&" in part else part)

    def looks(element: int) -> tuple[int, int]:
        return furnitures[element], levels[element]

    for tag in _TAG.finditer(page):
        text_to(tag.start())
        at = tag.end()
        name = tag["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br" or name == "wbr":
            held.append(" " if name == "br" else "")
            continue
        block = name in _BLOCKS
        if block:
            end_block()
        if tag["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if not block and looks(stack[k][1]) != looks(stack[k - 1][1]):
                        end_block()
                    del stack[k:]
                    break
            continue
        if name in _VOID:
            continue
        if block:
            # A paragraph ends where another block begins, an item at the next one.
            while len(stack) > 1 and (
                stack[-1][0] == "p" or (stack[-1][0] == name and name in ("li", "dt", "dd"))
                or stack[-1][0] not in _BLOCKS and _under_paragraph(stack)
            ):
                stack.pop()
        parent = stack[-1][1]
        furniture, level = _look(name, tag["rest"], levels[parent])
        if name == "body":
            furniture, level, parent = 0, 0, 0
        level = max(level, levels[parent])
        if not block and (furniture or level != levels[parent]):
            end_block()
        if tag["rest"][-1:] != "/" or block:
            # Elements that change nothing share the entry of their parent.
            if furniture or level != levels[parent]:
                parents.append(parent)
                furnitures.append(furniture)
                levels.append(level)
                stack.append((name, len(parents) - 1))
            else:
                stack.append((name, parent))
    text_to(len(page))
    end_block()
    return _judged(found, parents, furnitures, levels)


def _judged(found, parents, furnitures, levels) -> list[tuple[int, str]]:
    """The level of every block, once it is known what stands in each element."""
    n = len(parents)
    surely = [f == 3 for f in furnitures]
    for e in range(1, n):  # parents come first
        surely[e] = surely[e] or surely[parents[e]]
    words = [0] * n
    for e, text in found:
        if not surely[e]:
            words[e] += text.count(" ") + 1
    holds = [level >= 2 and not s for level, s in zip(levels, surely)]
    for e in range(n - 1, 0, -1):
        words[parents[e]] += words[e]
        # An element within the article is not spared for standing in it.
        own = levels[e] > levels[parents[e]] if levels[parents[e]] >= 2 else holds[e]
        holds[parents[e]] = holds[parents[e]] or own
    void = list(surely)
    for e in range(1, n):
        most = furnitures[e] == 1 and words[e] >= HOLDER * max(words[0], 1)
        spared = (holds[e] or most) and levels[parents[e]] < 2
        void[e] = void[parents[e]] or void[e] or (furnitures[e] > 0 and not spared)
    return [(-1 if void[e] else levels[e], text) for e, text in found]


def article_level(found: list[tuple[int, str]]) -> int:
    """The highest level whose blocks hold ARTICLE of the words that stand at
    any level above 0; 0 if there are none."""
    words = [0, 0, 0, 0]
    for level, text in found:
        if level > 0:
            words[level] += text.count(" ") + 1
    total = sum(words)
    for level in (3, 2, 1):
        if words[level] and sum(words[level:]) >= ARTICLE * total:
            return level
    return 0


def _under_paragraph(stack: list[tuple[str, int]]) -> bool:
    """Are the innermost open elements inline ones within a paragraph?"""
    for name, _ in reversed(stack):
        if name in _BLOCKS:
            return name == "p"
    return False


def _number(words: tuple[str, ...]) -> int:
    digest = hashlib.blake2b("\x00".join(words).encode("utf-8", "replace"), digest_size=8)
    return int.from_bytes(digest.digest(), "little", signed=True)


class Stream:
    """The tokens of an article: its words, behind a mark for each block."""

    def __init__(self, main: str):
        self.tokens: list[str] = []
        starts = []
        for block in main.split("\n\n"):
            starts.append(len(self.tokens))
            self.tokens.append("\n")
            self.tokens += block.split(" ")
        self.starts = np.array(starts)
        self.ends = np.r_[self.starts[1:], len(self.tokens)]
        self.hashes = np.fromiter(
            (zlib.crc32(t.encode("utf-8", "replace")) for t in self.tokens), np.uint64
        )

    def runs(self, size: int, at: np.ndarray) -> np.ndarray:
        """Hashes of ``size`` tokens from the places ``at`` on."""
        out = np.full(len(at), size, np.uint64)
        for k in range(size):
            out = mix(out ^ self.hashes[at + k])
        return out

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of RUN words or more, and their hashes."""
        sizes = self.ends - self.starts
        place = np.arange(len(self.tokens)) - np.repeat(self.starts, sizes)
        words = mix(self.hashes + mix(place.astype(np.uint64)))
        hashes = mix(np.add.reduceat(words, self.starts) ^ sizes.astype(np.uint64))
        long = np.flatnonzero(sizes > RUN)
        return long, hashes[long]

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.uint64]:
        """Places and hashes of RUN tokens, the first with the least hash of any
        LONG tokens in a row; and the look, which near copies mostly share: the
        least of all hashes under each of LOOKS."""
        n = len(self.tokens)
        grams = self.runs(min(RUN, n), np.arange(max(n - RUN, 0) + 1))
        least = np.array([mix(grams ^ salt).min() for salt in LOOKS])
        look = mix(least ^ mix(LOOKS)).sum()
        if n < LONG:
            return np.empty(0, np.int64), np.empty(0, np.uint64), look
        rows = np.lib.stride_tricks.sliding_window_view(grams, LONG - RUN + 1)
        first = np.concatenate([  # in blocks, whatever the length
            rows[lo : lo + 65536].argmin(axis=1) for lo in range(0, len(rows), 65536)
        ])
        at = np.unique(first + np.arange(len(first)))
        return at, grams[at], look

    def around(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of the blocks among ``seeds`` and of the runs of LONG
        tokens that hold one of them."""
        blocks, hashes = self.whole()
        chosen = np.isin(hashes, seeds)
        blocks, hashes = blocks[chosen], hashes[chosen]
        at, grams, _ = self.seeds()
        at = at[np.isin(grams, seeds)]
        # A seed's RUN tokens are within the run.
        near = (at[:, None] - np.arange(LONG - RUN + 1)).ravel()
        near = np.unique(near[(near >= 0) & (near <= len(self.tokens) - LONG)])
        return (
            np.r_[self.starts[blocks], near], np.r_[self.ends[blocks], near + LONG],
            np.r_[hashes, self.runs(LONG, near)],
        )

    def without(self, starts: list[int], ends: list[int]) -> tuple[str, int]:
        """The text without the words of the spans, and how many blocks lost words.
        Nothing goes if that were most (COVERED) of the words."""
        depth = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(depth, starts, 1)
        np.add.at(depth, ends, -1)
        gone = np.cumsum(depth)[:-1] > 0
        gone[self.starts] = False
        if gone.sum() >= COVERED * (len(gone) - len(self.starts)):
            gone[:] = False
        texts, lost = [], 0
        for lo, hi in zip(self.starts.tolist(), self.ends.tolist()):
            kept = [self.tokens[i] for i in range(lo + 1, hi) if not gone[i]]
            lost += len(kept) < hi - lo - 1
            if kept:
                texts.append(" ".join(kept))
        return "\n\n".join(texts), lost


def parse(page: str | None):
    """main text or None, blocks elsewhere as (text, from, to), suffix prefixes,
    seeds and look of the main text (None if there is none).

    ``from`` and ``to`` are places in the token stream; the number at place i
    stands for the RUN tokens from i on.  Blocks of page furniture are in the
    stream but not among the blocks.  Blocks of the main text are a stream of
    their own, see ``Stream``.
    """
    found = blocks(page or "")
    best = article_level(found)
    main = "\n\n".join(text for level, text in found if level >= best) if best > 0 else None
    stream: list[str] = []
    others: list[tuple[str, int, int]] = []
    for level, text in found:
        if level >= best and best > 0:
            continue
        start = len(stream)
        stream.append("\n")
        stream += text.split(" ")
        if level == 0 and best <= 0:
            others.append((text, start, len(stream)))
    prefixes = [_number(tuple(stream[i : i + RUN])) for i in range(len(stream) - RUN + 1)]
    seeds, look = np.empty(0, np.int64), None
    if main is not None:
        article = Stream(main)
        _, grams, look = article.seeds()
        seeds = np.unique(np.r_[grams, article.whole()[1]]).view(np.int64)
        look = int(look.view(np.int64))
    return main, others, prefixes, seeds, look


def _parsed(df: DataFrame, key: str, url: str, page: str) -> DataFrame:
    def start():
        def work(columns):
            rows = [parse(x) for x in columns[2].to_pylist()]
            texts, lows, highs, counts = [], [], [], [0]
            for row in rows:
                texts += [x[0] for x in row[1]]
                lows += [x[1] for x in row[1]]
                highs += [x[2] for x in row[1]]
                counts.append(len(texts))
            other = pa.StructArray.from_arrays(
                [pa.array(texts, pa.string()), pa.array(lows, pa.int32()),
                 pa.array(highs, pa.int32())],
                names=["text", "from", "to"],
            )
            return [
                columns[0], columns[1], pa.array([r[0] for r in rows], pa.string()),
                pa.ListArray.from_arrays(pa.array(counts, pa.int32()), other),
                _lists([r[2] for r in rows]), _lists([r[3] for r in rows]),
                pa.array([r[4] for r in rows], pa.int64()),
            ]

        return work

    kind = df.schema[key].dataType.simpleString()
    schema = (
        f"page_id {kind}, url string, main string, "
        "others array<struct<text:string,from:int,to:int>>, prefixes array<bigint>, "
        "seeds array<bigint>, look bigint"
    )
    narrow = df.select(
        F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"),
        F.col(page).alias("html"),
    )
    return map_texts(narrow, ["page_id", "url", "html"], schema, start)


def _lists(rows: list) -> pa.ListArray:
    sizes = np.cumsum([0, *[len(r) for r in rows]]).astype(np.int32)
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else []
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, pa.int64()))


def _article_cuts(parsed: DataFrame) -> tuple[DataFrame, int]:
    """row, starts, ends of what is repeated inside the articles of a host, and
    the bytes of that table.

    Articles of one ``look``, equal ones and most near copies, are one page.
    Seeds are added up before they are shuffled; texts are, only if the list of
    pages with repeated seeds is too large to be broadcast.
    """
    articles = parsed.where("main IS NOT NULL")
    run = F.xxhash64("host", "run")
    seeds = articles.select(
        "row", "host", "look", F.explode("seeds").alias("seed")
    ).withColumn("run", F.xxhash64("host", "seed"))
    common = stored(
        seeds.groupBy("run").agg(F.min("look").alias("lo"), F.max("look").alias("hi"))
        .where("lo <> hi").select("run"),
        "seeds",
    )
    pages = stored(
        seeds.join(maybe_broadcast(common, common.count(), 16), "run", "left_semi")
        .groupBy("row").agg(F.collect_set("seed").alias("met")),
        "met",
    )
    width = _array_bytes(pages, "met")
    # The page's article again, beside its repeated seeds.
    again = articles.select("row", "host", "look", "main").join(
        maybe_broadcast(pages, 1, width), "row"
    )

    def start():
        def work(columns):
            found = [
                Stream(main).around(np.array(met, np.int64).view(np.uint64))
                for met, main in zip(columns[3].to_pylist(), columns[4].to_pylist())
            ]
            who = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
            starts, ends, hashes = (np.concatenate([x[i] for x in found]) for i in range(3))
            return [
                *[c.take(who) for c in columns[:3]], pa.array(starts, pa.int32()),
                pa.array(ends, pa.int32()), pa.array(hashes.view(np.int64)),
            ]

        return work

    schema = "row long, host string, look long, start int, end int, run long"
    names = ["row", "host", "look", "met", "main"]
    spans = stored(map_texts(again, names, schema, start).withColumn("run", run), "spans")
    sizes = articles.select("host", "look").distinct().groupBy("host").agg(
        F.count("*").alias("pages")
    )
    often = spans.select("host", "run", "look").distinct().groupBy("host", "run").agg(
        F.count("*").alias("n")
    ).where(F.col("n") >= PAGES)
    often = stored(
        often.join(sizes, "host").where(F.col("n") >= SHARE * F.col("pages")).select("run"),
        "often",
    )
    cuts = stored(
        spans.join(maybe_broadcast(often, often.count(), 16), "run", "left_semi")
        .groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("x"))
        .select("row", F.col("x.start").alias("starts"), F.col("x.end").alias("ends")),
        "cuts",
    )
    for table in (common, pages, spans, often):
        dropped(table)
    return cuts, 2 * _array_bytes(cuts, "starts")


def _array_bytes(df: DataFrame, column: str) -> int:
    size = df.agg(F.count("*"), F.coalesce(F.sum(F.size(column)), F.lit(0))).first()
    return 48 * size[0] + 8 * size[1]


def _without_cuts(rows: DataFrame) -> DataFrame:
    """page_id, url, text, n_boilerplate of articles with repeats (main, starts, ends)."""
    names = ["page_id", "url", "starts", "ends", "main"]
    kind = rows.schema["page_id"].dataType.simpleString()

    def start():
        def work(columns):
            found = [
                Stream(main).without(lo, hi)
                for lo, hi, main in zip(*(c.to_pylist() for c in columns[2:]))
            ]
            return [
                columns[0], columns[1], pa.array([x[0] for x in found], pa.string()),
                pa.array([x[1] for x in found], pa.int64()),
            ]

        return work

    schema = f"page_id {kind}, url string, text string, n_boilerplate long"
    return map_texts(rows, names, schema, start)


def host_of(url: str):
    """The host of an address column in lower case; empty where there is none."""
    host = F.regexp_extract(
        F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1
    )
    return F.lower(host)


def main_text(
    df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html"
) -> DataFrame:
    """page_id, url, text, n_chars, n_boilerplate for every page.

    ``text`` joins the blocks of the article by an empty line: those in the
    elements that hold it most surely (article, then main, then a class or id
    that says so) if they have ARTICLE of the words of all such elements, and
    not in menus, headers, footers, forms and the like.  Words in substrings of
    LONG tokens, or in whole blocks of RUN words, that are on PAGES pages of the
    host and on a SHARE of them go from the article, unless that is most (COVERED)
    of it: then it is a copy.  A
    page without such an element gives its blocks outside page furniture whose
    words are not mostly (COVERED) in substrings that other pages of the host
    have too.  ``n_boilerplate`` counts the blocks left out, or shortened in an
    article, for that.  Copies of a page are one page here, so they do not make
    each other boilerplate.

    A null or empty page gives an empty text, a page without markup its lines
    as one block.  Pages without a host are together a host.  Repeated rows and
    null keys have results of their own; other columns are ignored; an empty
    table gives no rows.

    Pages are parsed once.  Suffix prefixes are added up before they are
    shuffled, so a host with a third of all pages is no single task, and meet
    only the pages without an article again; of articles, only the seeds are.
    """
    parsed = stored(
        _parsed(df, key, url, page).withColumn("host", host_of("url"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("same", F.xxhash64("main", "prefixes", "others")),
        "pages",
    )
    suffixes = parsed.select("host", "same", F.explode("prefixes").alias("prefix"))
    repeated = (
        suffixes.groupBy("host", "prefix")
        .agg(F.min("same").alias("lo"), F.max("same").alias("hi"))
        .where("lo <> hi").select("host", "prefix")
    )
    open_pages = parsed.where(F.col("main").isNull() & (F.size("others") > 0))
    covered = (
        open_pages.select("row", "host", F.posexplode("prefixes").alias("at", "prefix"))
        .join(repeated, ["host", "prefix"], "left_semi")
        .groupBy("row").agg(F.array_sort(F.collect_set("at")).alias("starts"))
    )
    runs = F.lit(RUN)
    marked = F.array_distinct(
        F.flatten(F.transform(
            F.coalesce("starts", F.array().cast("array<int>")),
            lambda s: F.sequence(s, s + runs - 1),
        ))
    )

    def words_covered(block):
        own = F.sequence(block["from"] + 1, block["to"] - 1)
        return F.size(F.array_intersect(own, F.col("marked")))

    kept = F.filter(
        "others", lambda b: words_covered(b) < COVERED * (b["to"] - b["from"] - 1)
    )
    chosen = (
        open_pages.select("row", "page_id", "url", "others").join(covered, "row", "left")
        .select("page_id", "url", "others", marked.alias("marked"))
        .select("page_id", "url", F.size("others").alias("n"), kept.alias("kept"))
        .select(
            "page_id", "url",
            F.array_join(F.transform("kept", lambda b: b["text"]), "\n\n").alias("text"),
            (F.col("n") - F.size("kept")).cast("long").alias("n_boilerplate"),
        )
    )
    # Pages with an article are not shuffled, unless there are very many cuts.
    cuts, width = _article_cuts(parsed)
    cuts = maybe_broadcast(cuts, 1, width)
    settled = parsed.where(F.col("main").isNotNull() | (F.size("others") == 0))
    others = settled.join(cuts.select("row"), "row", "left_anti").select(
        "page_id", "url", F.coalesce("main", F.lit("")).alias("text"),
        F.lit(0).cast("long").alias("n_boilerplate"),
    )
    shortened = _without_cuts(settled.join(cuts, "row"))
    return others.union(shortened).union(chosen).select(
        F.col("page_id").alias(key), F.col("url").alias(url), "text",
        F.length("text").cast("long").alias("n_chars"), "n_boilerplate",
    )
