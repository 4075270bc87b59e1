"""Main text of web pages: structure first, then host suffix arrays for what it leaves open.

A page's tags cut it into blocks of text. Elements that are never part of an
article (menus, headers, footers, sidebars, forms, scripts, styles; notices,
adverts and comments by their class or id) go with all they hold. If the page
marks its article (article, main, or an element named so), the rest outside it
goes as well. Text in an article element, or one named so, is its article; main and
main-content may wrap the whole layout, so what only they hold is told by the host. Names count as whole tokens of a class (or by
their last part), never on html or body, and don't hide a page's only article.

Every page is told by its host: the token streams of the
host's pages are concatenated (each page ended by a token of its own), sorted
into a suffix array, and a run of ``MIN_RUN`` tokens that distinct pages share,
``MIN_PAGES`` at least, is repeated. Of text that no article element marks, blocks that repeated runs cover are boilerplate,
and stretches of ``LONG_RUN`` tokens inside a block; a common phrase in a sentence stays.
Of article text, what an element sets apart (a div or a list, say) is boilerplate if all its runs are repeated outside the main text of
``MIN_PAGES`` pages and it stands in ``MIN_PAGES`` articles that differ. The article's own paragraphs and
its title stay, whatever repeats them, so article text is in no run of the arrays: its parts are looked up in those runs.

Pages are counted over the whole host, whatever its size: a host with very many
pages is dealt by page into shards of about ``SHARD_PAGES`` pages; each shard's
suffix array gives its distinct pages per run (a 64-bit hash of the words), Spark
adds them up per host and sends each shard its repeated runs. No task gets a hot host.

Cases: null and empty html give an empty text; a null or odd url is a host of its
own kind; unclosed, cut-off and misnested markup ends where its parent does;
repeated rows are pages of the same id and don't count as distinct; very long pages
are read whole; empty input gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import Stages

MIN_RUN = 6
MIN_PAGES = 3
#: Words that repeated runs must cover without a gap to go from inside a block.
LONG_RUN = 20
SHARD_PAGES = 2000

#: Elements whose content is never article text.
NEVER = frozenset("head nav header footer aside form script style noscript template iframe object svg button select textarea "
                  "dialog menu canvas video audio title".split())
#: Their content is raw up to the end tag.
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
#: An open one of these ends when the next of its kind begins.
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
#: Elements that set apart what they hold from the text around them; a paragraph or a heading doesn't.
GROUPS = frozenset("center details div dl fieldset figure ol section table ul".split())
#: Words of a class, id or role that name what isn't article text, as the last part of one of its names.
NAMES = re.compile(r"ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|comments?|commentlist|disqus|respond|replies|sidebar|"
                   r"nav\w*|menu\w*|breadcrumbs?|footer|header|masthead|cookie\w*|consent|gdpr|notices?|alert|popup|modal|newsletter|"
                   r"subscri\w*|signup|login|social|share\w*|related|recommend\w*|widget\w*|pagination|pager|toolbar|"
                   r"copyright|disclaimer|navigation|contentinfo|complementary|search")
#: Of these words, those that don't rule anything out inside an article element: they don't say that it is a menu, header, footer,
#: sidebar, notice, advert, form or comments.
_SOFT = re.compile(r"share\w*|social|related|recommend\w*|copyright|disclaimer|search")
#: Parts after such a word that say no more than "box"; parts before it that make the name say something of another element.
_BOX = re.compile(r"area|bar|block|body|box|buttons?|container|content|form|inner|items?|links?|list|posts?|section|slot|text|units?|wrap|"
                  r"wrapper|\d+(?:x\d+)?")
#: These hold articles that aren't the page's.
_OTHERS = re.compile(r"comments?|commentlist|disqus|respond|replies|related|recommend\w*")
_MODIFIERS = frozenset("has no with without is not hide show".split())
ARTICLE_NAMES = re.compile(r"(?:^|\s)(?:article|article-body|articlebody|post-content|entry-content|story-body)(?=$|\s)", re.I)
#: An element named so, like main, holds the article but may hold the layout, too.
MAIN_NAMES = re.compile(r"(?:^|\s)main-content(?=$|\s)", re.I)
_MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z][A-Za-z0-9:-]*))")
_STOP = re.compile("[>\"']")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WHITE = re.compile(r"\s+")


#: What rules a block out: nothing, a name only, a name of what holds others' articles, an element that never is article text.
FREE, NAMED, OTHERS, HARD = 0, 1, 2, 3


@lru_cache(1 << 16)
def _named(name: str, mark: int) -> int:
    """How one class token, id or role rules its element out (FREE, NAMED or OTHERS); a header inside what ``mark`` marks is the article's."""
    parts = [x for x in re.split(r"[_-]+", name.lower()) if x]
    while len(parts) > 1 and not NAMES.fullmatch(parts[-1]) and _BOX.fullmatch(parts[-1]):
        if parts[-2:] == ["side", "bar"]:
            parts[-2:] = ["sidebar"]
        else:
            parts.pop()
    if (not parts or not NAMES.fullmatch(parts[-1]) or (mark and parts[-1] == "header") or (mark == ARTICLE and _SOFT.fullmatch(parts[-1]))
            or (len(parts) > 1 and parts[-2] in _MODIFIERS)):
        return FREE
    return OTHERS if _OTHERS.fullmatch(parts[-1]) else NAMED


#: What marks a block as article text: nothing, main or a name like it, article or a name like it.
NONE, MAIN, ARTICLE = 0, 1, 2


def blocks(page: str, everything: bool = False) -> tuple[list[tuple[str, int, int, int]], bool]:
    """(text, what marks it as article text, what rules it out, the number of the element that sets it apart there; 0: none) of each block,
    and whether the page marks an article.

    Names never empty a page: an article mark in a wrapper that only its name rules out is
    taken if the page has no text as well marked elsewhere (for comments and related: none marked). HARD blocks come with ``everything`` only."""
    found, marked = _walk(page, everything)
    best = max((mark for _, mark, ruled, again, _ in found if not ruled and not again), default=NONE)
    return [(t, mark, ruled or (again if best >= (mark if again == NAMED else MAIN) else FREE), apart) for t, mark, ruled, again, apart in found], marked


class _Markup:
    """A page's comments, declarations and tags from any place on, each place looked at once.

    A quote that nothing closes is a character of its tag like any other."""

    def __init__(self, page: str):
        self.page, self.last = page, {q: page.rfind(q) for q in "\"'"}

    def after(self, at: int) -> tuple[int, int, str | None, str | None, str] | None:
        """(start, end, "/" of an end tag, name or None, attributes) of the next one."""
        m = _MARKUP.search(self.page, at)
        if m is None:
            return None
        if m[2] is None:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            end = self.page.find(close, m.end())
            return m.start(), len(self.page) if end < 0 else end + len(close), None, None, ""
        to = m.end()
        while stop := _STOP.search(self.page, to):
            to = stop.end()
            if stop[0] == ">":
                return m.start(), to, m[1], m[2], self.page[m.end():to - 1]
            if stop.start() < self.last[stop[0]]:
                to = self.page.find(stop[0], to) + 1
        return m.start(), len(self.page), m[1], m[2], self.page[m.end():]


class _Open(NamedTuple):
    """An open element; from here on: what rules out, what marks, what ruled out the wrapper it is marked in, what sets apart in there."""
    name: str
    ruled: int
    mark: int
    again: int
    apart: int
    blocks: int  # elements that aren't inline, to here
    block: int  # the place of the last of them; -1: none


def _walk(page: str, everything: bool) -> tuple[list[tuple[str, int, int, int, int]], bool]:
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # of the open elements of a name
    markup = _Markup(page)
    out: list[tuple[str, int, int, int, int]] = []
    parts: list[str] = []
    marked, at, n, groups = False, 0, len(page), 0
    state = nothing = (FREE, NONE, FREE, 0)

    def flush() -> None:
        if parts:
            text = _WHITE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((text, state[1], state[0], state[2], state[3]))

    def pop(k: int) -> None:
        nonlocal state
        for x in stack[k:]:
            places[x.name].pop()
        del stack[k:]
        before = stack[-1][1:5] if stack else nothing
        if before != state:
            flush()
        state = before

    while at < n:
        found = markup.after(at)
        if found is None:
            if state[0] != HARD or everything:
                parts.append(page[at:])
            break
        start, end, ends, name, rest = found
        if start > at and (state[0] != HARD or everything):
            parts.append(page[at:start])
        at = end
        if name is None:
            continue
        name = name.lower()
        if ends:
            if name not in INLINE:
                flush()
            if places.get(name):
                k = places[name][-1]
                # An inline element doesn't end across a block.
                if name not in INLINE or stack[k].blocks == stack[-1].blocks:
                    pop(k)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES_ITSELF or name in ("div", "article", "section", "footer", "ul", "ol", "table", "h1", "h2", "h3", "h4"):
                # An open paragraph, with the inline elements in it, ends here.
                k = stack[-1].block if stack else -1
                if k >= 0 and (stack[k].name == "p" or (stack[k].name == name and name in CLOSES_ITSELF)):
                    pop(k)
        if rest.endswith("/"):
            continue
        ruled, mark, again, apart = state
        named = [a or b or c for a, b, c in _NAMED.findall(rest)] if rest else []
        own = ARTICLE if name == "article" or any(ARTICLE_NAMES.search(x) for x in named) else \
            MAIN if name == "main" or any(MAIN_NAMES.search(x) for x in named) else NONE
        if own > mark and ruled != HARD:
            ruled, mark, again, apart, marked = FREE, own, max(again, ruled), 0, True
        elif name in NEVER and not (name == "header" and mark):
            ruled = HARD
        elif not ruled and named and name not in ("html", "body"):
            ruled = max((_named(y, mark) for x in named for y in x.split()), default=FREE)
        if name in GROUPS and mark and own <= state[1]:
            groups += 1
            apart = groups
        outer = stack[-1] if stack else None
        blocks_, block = (outer.blocks, outer.block) if outer else (0, -1)
        if name not in INLINE:
            blocks_, block = blocks_ + 1, len(stack)
        places.setdefault(name, []).append(len(stack))
        stack.append(_Open(name, ruled, mark, again, apart, blocks_, block))
        if (ruled, mark, again, apart) != state:
            flush()
        state = ruled, mark, again, apart
    flush()
    return out, marked


def _sorted(page: str, everything: bool = False) -> list[tuple[str, str, int]]:
    """(text, "keep", "judge" or "outside", what sets it apart) of each block: article text, text that the host has to tell, the rest.

    The host tells of text that only main or a name like it marks, and of all there is on a page
    without an article mark; if names rule out all of that, of what they rule out."""
    found, marked = blocks(page, everything)
    if marked:
        return [(t, "outside" if ruled or not mark else "keep" if mark == ARTICLE else "judge", apart) for t, mark, ruled, apart in found]
    least = min((ruled for _, _, ruled, _ in found), default=FREE)
    return [(t, "judge" if ruled == least != HARD else "outside", 0) for t, _, ruled, _ in found]


def sorted_blocks(page: str, everything: bool = False) -> list[tuple[str, str]]:
    """(text, "keep", "judge" or "outside") of each block."""
    return [(t, kind) for t, kind, _ in _sorted(page, everything)]


def settled_text(page: str) -> str | None:
    """What structure by itself says of a page that marks all its text by article, before its host is asked; None if it marks less."""
    found = sorted_blocks(page)
    return None if any(kind == "judge" for _, kind in found) else "\n".join(t for t, kind in found if kind == "keep")


def _suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling, compared over the first MIN_RUN tokens and beyond (at least 16)."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, k = len(tokens), 1
    order = np.argsort(rank, kind="stable")
    while k < 16:
        second = np.full(n, -1, np.int64)
        second[:-k] = rank[k:] if k < n else second[:-k]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        step = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            break
        k *= 2
    return order


def _alike(tokens: np.ndarray, page: np.ndarray, min_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order, the group (equal first ``min_run`` tokens) of each suffix in it, and the distinct pages of each group."""
    n = len(tokens)
    order = _suffix_array(tokens)
    # Suffixes that agree in the first min_run tokens are neighbours.
    same = np.ones(n - 1, bool)
    for k in range(min_run):
        a, b = order[:-1] + k, order[1:] + k
        ok = (a < n) & (b < n)
        same &= ok
        same[ok] &= tokens[a[ok]] == tokens[b[ok]]
    group = np.append(0, np.cumsum(~same))
    pair = np.unique(group * (page.max() + 1) + page[order])
    return order, group, np.bincount(pair // (page.max() + 1), minlength=group[-1] + 1)


def _cover(start: np.ndarray, n: int, min_run: int) -> np.ndarray:
    """Which of ``n`` tokens lie in a run of ``min_run`` from one of ``start``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + min_run, n), -1)
    return np.cumsum(step[:-1]) > 0


def covered(tokens: np.ndarray, page: np.ndarray, min_run: int = MIN_RUN, min_pages: int = MIN_PAGES) -> np.ndarray:
    """Which tokens lie in a run of ``min_run`` or more that ``min_pages`` distinct pages share.

    Runs don't cross pages: each page's last token must be one of its own."""
    n = len(tokens)
    if n < min_run:
        return np.zeros(n, bool)
    order, group, pages = _alike(tokens, page, min_run)
    return _cover(order[pages[group] >= min_pages], n, min_run)


_PAGES = ("key binary, article array<string>, blocks array<string>, kinds array<string>, open boolean, "
          "units array<struct<unit:long,run:long,words:long,first:int,last:int>>")


def units(lines: list[str], apart: list[int]) -> list[tuple[int, int | None, int, int, int]]:
    """(hash, hash of its first run, words, first line, last line) of each part of an article with MIN_RUN words or more.

    A part that the host is asked about is all that one element sets apart there. Paragraphs that nothing sets apart are the article's own,
    and a first line is its title: they aren't asked (None) and only tell one article from another."""
    out, known, k = [], {}, 0
    pieces: dict[int, int] = {}  # stretches of lines of an element
    for a, b in zip([0, *apart], apart):
        pieces[b] = pieces.get(b, 0) + (a != b)
    while k < len(lines):
        first = k
        k += 1
        whole = apart[first] and pieces[apart[first]] == 1
        while whole and k < len(lines) and apart[k] == apart[first]:
            k += 1
        text = " ".join(lines[first:k])
        n = text.count(" ") + 1
        if n < MIN_RUN:
            continue
        run = int(_windows(_hashed(text.split(" ", MIN_RUN)[:MIN_RUN], known))[0]) if whole and k > 1 else None
        out.append((int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True), run, n, first, k - 1))
    return out


def _parsed(batches):
    """Of each page: its article's lines and units; its other blocks with their kinds, and whether some are the host's to tell
    (then an empty block stands where the article's are)."""
    names = [x.split(" ")[0] for x in _PAGES.split(", ")]
    types = [pa.binary(), *[pa.list_(pa.string())] * 3, pa.bool_(),
             pa.list_(pa.struct([("unit", pa.int64()), ("run", pa.int64()), ("words", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))]
    for batch in batches:
        rows = []
        for key, page in zip(batch.column(0), batch.column(1).to_pylist()):
            got = _sorted(page, True)
            is_open = any(kind == "judge" for _, kind, _ in got)
            lines = [t for t, kind, _ in got if kind == "keep"]
            rest = [("" if kind == "keep" else t, kind) for t, kind, _ in got if is_open or kind != "keep"]
            asked = units(lines, [apart for _, kind, apart in got if kind == "keep"])
            rows.append((key.as_py(), lines, [t for t, _ in rest], [k for _, k in rest], is_open,
                         [dict(zip(("unit", "run", "words", "first", "last"), x)) for x in asked]))
        made = zip(*rows) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(2, batch.num_columns)]
                                         + [pa.array(list(x), t) for x, t in zip(made, types)], names=[*batch.schema.names[2:], *names])


def _stream(found: list[str], kinds: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a page, the starts of its runs (none goes across its article) and of those wholly outside what the host has to tell."""
    words = [(w, kind) for b, kind in zip(found, kinds) for w in b.split(" ")]
    hashes = _hashed([w for w, _ in words], known)
    starts = np.arange(max(len(hashes) - MIN_RUN + 1, 0))

    def free(*of: str) -> np.ndarray:
        taken = np.append(0, np.cumsum(np.fromiter((k in of for _, k in words), np.int64, len(words))))
        return starts[taken[starts + MIN_RUN] == taken[starts]]

    return hashes, free("keep"), free("keep", "judge")


def _hashed(words: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every task."""
    for w in words:
        if w not in known:
            known[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return np.fromiter((known[w] for w in words), np.uint64, len(words))


def _windows(hashes: np.ndarray) -> np.ndarray:
    """The hash of each run of MIN_RUN words."""
    out = np.zeros(max(len(hashes) - MIN_RUN + 1, 0), np.uint64)
    for k in range(MIN_RUN):
        out = (out ^ hashes[k:len(out) + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


_COUNTS = "host string, shard long, run long, n long, outside long"


def _counts(table: pa.Table) -> pa.Table:
    """The distinct pages of each run in a shard, by its suffix array, and of these the ones that have it outside their
    main text by structure alone. Runs that can't get ``MIN_PAGES`` are left out."""
    known: dict[str, int] = {}
    page_of: dict[bytes, int] = {}  # a repeated row isn't another page
    number, runs, page, whole, outer = [], [], [], [], []
    for key, blocks_, kinds in zip(*(table[c].to_pylist() for c in ("key", "blocks", "kinds"))):
        if key in page_of:
            continue
        page_of[key] = len(page_of)
        hashes, starts, outside = _stream(blocks_, kinds, known)
        ends = np.zeros(len(hashes) + 1, np.int64)
        ends[starts] = _windows(hashes)[starts]
        is_run, is_outer = np.zeros((2, len(hashes) + 1), bool)
        is_run[starts] = True
        is_outer[outside] = True
        number.append(hashes)
        runs.append(ends)
        whole.append(is_run)
        outer.append(is_outer)
        page.append(np.full(len(ends), page_of[key], np.int64))
    host, shard, shards = (table[c][0].as_py() for c in ("host", "shard", "shards"))
    words_ = np.unique(np.concatenate(number))
    # Only words in runs are compared: all others, and each page's end, are tokens of their own.
    whole = np.concatenate(whole)
    tokens = np.concatenate([np.append(np.searchsorted(words_, h), -1) for h in number])
    tokens = np.where(_cover(np.flatnonzero(whole), len(whole), MIN_RUN), tokens, -1 - np.arange(len(tokens)))
    page, outer = np.concatenate(page), np.concatenate(outer)
    order, group, pages = _alike(tokens, page, MIN_RUN)
    mine = outer[order]
    outside = np.bincount(np.unique(group[mine] * (page.max() + 1) + page[order][mine]) // (page.max() + 1), minlength=len(pages))
    first = order[np.append(0, np.flatnonzero(np.diff(group)) + 1)]
    taken = whole[first] & (pages >= (MIN_PAGES if shards == 1 else 1))
    run, n, outside = np.concatenate(runs)[first[taken]], pages[taken], outside[taken]
    return pa.table([pa.array([host] * len(run), pa.string()), pa.array(np.full(len(run), shard, np.int64)), pa.array(run),
                     pa.array(n.astype(np.int64)), pa.array(outside.astype(np.int64))], names=["host", "shard", "run", "n", "outside"])


_LINES = "array<struct<line:string,place:int>>"


def _judge(table: pa.Table, repeated: pa.Table) -> pa.Table:
    """The lines of a shard's open pages, without the runs that the host repeats: blocks that these cover go,
    and inside a block what they cover without a gap for ``LONG_RUN`` words. A phrase in a sentence stays.
    Of the article's lines there is the place only."""
    runs = np.unique(repeated["run"].to_numpy())
    known: dict[str, int] = {}
    lines = {}
    for key, blocks_, kinds in zip(*(table[c].to_pylist() for c in ("key", "blocks", "kinds"))):
        if key in lines:
            continue
        hashes, starts, _ = _stream(blocks_, kinds, known)
        gone = _cover(starts[np.isin(_windows(hashes)[starts], runs)], len(hashes), MIN_RUN)
        kept, at, place = [], 0, 0
        for block, kind in zip(blocks_, kinds):
            b = block.split(" ")
            mine = gone[at:at + len(b)]
            at += len(b)
            if kind == "keep":
                kept.append({"line": None, "place": place})
                place += 1
            if kind != "judge" or mine.all():
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], mine, [0]))))
            stays = np.ones(len(b), bool)
            for x, y in zip(edge[::2], edge[1::2]):
                stays[x:y] = y - x < LONG_RUN
            kept.append({"line": " ".join(w for w, s in zip(b, stays) if s), "place": -1})
        lines[key] = kept
    return pa.table([pa.array(list(lines), pa.binary()),
                     pa.array(list(lines.values()), pa.list_(pa.struct([("line", pa.string()), ("place", pa.int32())])))], names=["key", "lines"])


def _unit_runs(batches):
    """Each different run of a unit, and how many there are."""
    for batch in batches:
        out = []
        for host, unit, text in zip(*(batch.column(c).to_pylist() for c in ("host", "unit", "text"))):
            runs = np.unique(_windows(_hashed(text.split(" "), {}))).tolist()
            out += [(host, unit, len(runs), run) for run in runs]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), *[pa.int64()] * 3))],
                                         names=["host", "unit", "n", "run"])


def _repeated_lines(stages: Stages, pages: DataFrame, often: DataFrame) -> DataFrame:
    """Per page (a hash of its key), the places of the article's lines that its host tells to be a menu, a notice or the like.

    These are units of which every run stands outside the main text of ``MIN_PAGES`` pages, in ``MIN_PAGES`` articles or more that
    differ: beside such units, more than half of their words are in units that no other page of the host has, so that copies don't
    tell. No article is emptied so."""
    found = pages.select("host", "page", F.inline("units"))
    outside = often.filter(F.col("outside") >= MIN_PAGES).select("host", "run")
    # Every unit is looked up by its first run; units found so, once a host, by all of theirs.
    asked = stages.write(found.join(outside, ["host", "run"], "left_semi").groupBy("host", "unit").agg(F.min("page").alias("page")), "asked")
    at = F.filter("units", lambda x: x["unit"] == F.col("unit"))[0]
    texts = pages.select("page", "article", "units").join(asked, "page").withColumn("at", at).dropDuplicates(["host", "unit"])
    texts = texts.select("host", "unit", F.expr("array_join(slice(article, at.first + 1, at.last - at.first + 1), ' ')").alias("text"))
    runs = texts.mapInArrow(_unit_runs, "host string, unit long, n long, run long").join(outside, ["host", "run"], "left_semi")
    passed = stages.write(runs.groupBy("host", "unit").agg(F.count("*").alias("found"), F.max("n").alias("n"))
                          .filter("found = n").select("host", "unit"), "passed")
    holding = found.join(passed, ["host", "unit"], "left_semi").select("page").distinct()
    theirs = stages.write(found.join(holding, "page", "left_semi").withColumn("asked", F.col("run").isNotNull()).drop("run").distinct(), "theirs")
    shared = (found.join(theirs.select("host", "unit").distinct(), ["host", "unit"], "left_semi").groupBy("host", "unit")
              .agg(F.min("page").alias("a"), F.max("page").alias("b")).select("host", "unit", (F.col("a") < F.col("b")).alias("shared")))
    own = (theirs.join(passed, ["host", "unit"], "left_anti").join(shared, ["host", "unit"]).groupBy("page")
           .agg(F.sum("words").alias("words"), F.sum(F.when(F.col("shared"), F.col("words")).otherwise(0)).alias("copied"))
           .filter("2 * copied < words").select("page"))
    telling = (theirs.join(passed, ["host", "unit"], "left_semi").join(own, "page", "left_semi").groupBy("host", "unit")
               .agg(F.countDistinct("page").alias("n")).filter(F.col("n") >= MIN_PAGES).select("host", "unit"))
    places = theirs.filter("asked").join(telling, ["host", "unit"], "left_semi")
    places = places.select("page", "first", "last").distinct().groupBy("page")
    gone = stages.write(places.agg(F.flatten(F.collect_list(F.sequence("first", "last"))).alias("gone")), "gone")
    stages.drop("asked", "passed", "theirs")
    return gone


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (blocks joined by line feeds) and n_chars."""
    stages = Stages(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.concat_ws("\n", F.coalesce(F.col("id").cast("string"), F.lit("")),
                                                             F.coalesce("url", F.lit("")), "html"), 256)))
    kinds = dict(rows.dtypes)
    parsed = rows.select("key", "html", "id", "url", "host").mapInArrow(_parsed, f"id {kinds['id']}, url string, host string, " + _PAGES)
    read = stages.write(parsed, "pages").withColumn("page", F.xxhash64("key"))
    # Every page's blocks outside its article are evidence in its host's suffix arrays.
    sizes = stages.write(read.groupBy("host").agg(F.count("*").alias("n")), "sizes")
    streams = read.filter("size(blocks) > 0").select("host", "key", "blocks", "kinds", "open").join(sizes, "host")
    streams = streams.withColumn("shards", F.expr(f"(n + {SHARD_PAGES - 1}) div {SHARD_PAGES}")).drop("n")
    streams = streams.withColumn("shard", F.pmod(F.xxhash64("key"), "shards"))
    # A page is in one shard, so the shards' counts of distinct pages add up to the host's.
    counts = stages.write(streams.groupBy("host", "shard").applyInArrow(_counts, _COUNTS), "counts")
    often = stages.write(counts.groupBy("host", "run").agg(F.sum("n").alias("pages"), F.sum("outside").alias("outside"))
                         .filter(F.col("pages") >= MIN_PAGES), "often")
    open_ = streams.filter("open").drop("open", "shards")
    repeated = counts.join(often, ["host", "run"], "left_semi").select("host", "shard", "run")
    repeated = repeated.join(open_.select("host", "shard").distinct(), ["host", "shard"], "left_semi")
    judged = stages.write(open_.groupBy("host", "shard").cogroup(repeated.groupBy("host", "shard"))
                          .applyInArrow(_judge, f"key binary, lines {_LINES}"), "judged")
    stages.drop("counts")
    gone = _repeated_lines(stages, read, often)
    stages.drop("sizes", "often")
    told = read.filter("open").select("id", "url", "key", "page", "article").join(judged.dropDuplicates(["key"]), "key").drop("key")
    rest = read.filter("not open").select("id", "url", "page", "article", F.lit(None).cast(_LINES).alias("lines"))
    out = told.unionByName(rest).join(gone, "page", "left")
    out = out.withColumn("gone", F.when(F.size("gone") < F.size("article"), F.col("gone")).otherwise(F.array().cast("array<int>")))
    left = F.when(F.col("lines").isNotNull(), F.expr(
        "transform(filter(lines, x -> not array_contains(gone, x.place)), x -> if(x.place < 0, x.line, article[x.place]))"))
    left = left.when(F.size("gone") == 0, F.col("article")).otherwise(F.expr("filter(article, (x, k) -> not array_contains(gone, k))"))
    return out.withColumn("text", F.array_join(left, "\n")).select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
