"""Periodic runs of words: enhanced suffix arrays and branching tandem repeats.

The words of many texts are numbered together, each text closed by an end mark, and
ranked with their text, so every text has a suffix array of its own within one
array. Doubling ranks the suffixes by 1, 2, 4, ... words; the ranks of each length
are kept, as they answer how far two places agree, to the right and to the left.

The test: w w with first place i and w of ``depth`` words is *branching* if the word
after it differs from w's first. Then i and i + depth lie in different children of
the LCP interval of that depth. So for each interval all suffixes i of all children
but the largest look up ISA[i + depth] and ISA[i - depth]: a branching tandem is found
where that rank lies in the interval, but not in the child. No tree is built; intervals
and children are slots between next smaller LCP values.

A run of period q and at least two periods holds exactly one branching tandem of q,
its last square. Its other squares are rotations of that to the left, so the run's
first word is where the agreement to the left ends. A run whose period is a multiple
of a smaller one is the same stretch as that one's and merges into it.

A text is worked on whole, in one task, in arrays of about (words x log2(words)) 32-bit
numbers; many short texts share the arrays, in pieces of about ``PIECE_BYTES``. Only
texts with an LCP of ``LEAST_LCP`` or more go past the first ranks: shorter agreements
can't make a run of ``LEAST_WORDS`` words.

Defined results: null text counts as empty and has no runs and an empty collapsed
text; repeated rows give their result once each; an empty table gives an empty one;
extra columns are ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import let, whole, words
from claimlens.session import ship_package

#: A run has at least this many periods, and this many words.
LEAST_PERIODS, LEAST_WORDS = 4, 6
#: The first and the second period of a run agree on at least this many words.
LEAST_LCP = LEAST_WORDS - 1
#: Texts are worked on in pieces of about this many bytes (a longer text is one piece).
PIECE_BYTES = 2 << 20
#: Suffixes that look up their partner at once.
LOOK_UPS = 1 << 22

RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


# ------------------------------------------------------------ suffix ranks

def ranked(codes: np.ndarray, row: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... symbols until all differ, for the rows
    with an LCP of LEAST_LCP or more; the places of these rows' symbols in ``codes``; and the
    suffix array. ``codes`` has one 0 at each row's end and none elsewhere."""
    n = len(codes)
    key = row.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
    live = np.argsort(key, kind="stable")
    rank, slot, key = np.empty(n, np.int64), np.arange(n), key[live]
    levels, places, h = [], np.arange(n), 0
    while True:
        new = np.ones(len(live), bool)
        new[1:] = key[1:] != key[:-1]
        rank[live] = np.maximum.accumulate(np.where(new, slot, 0)) if len(live) else slot
        levels.append(rank.astype(np.int32) if n < 1 << 31 else rank.copy())
        alone = new & np.append(new[1:], True)
        live, slot = live[~alone], slot[~alone]
        h = h * 2 or 1
        if h < LEAST_LCP <= 2 * h:  # rows whose first h symbols tell all suffixes apart are done
            deep = np.zeros(int(row[-1]) + 1 if n else 0, bool)
            deep[row[live]] = True
            places = np.flatnonzero(deep[row])
            moved = np.cumsum(deep[row]) - 1
            levels, rank, live = [x[places] for x in levels], rank[places], moved[live]
        if not len(live):
            return levels, places, np.argsort(rank)
        # No row ends within h symbols of a suffix that isn't alone, so live + h is in its row.
        key = rank[live] * n + rank[live + h]
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]


def agreement(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of symbols on which the suffixes at a and b (not the same) agree."""
    far = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        far += (levels[k][a + far] == levels[k][b + far]).astype(np.int64) << k
    return far


def agreement_before(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of symbols before a and b (a < b) that agree."""
    far = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at = a - far - (1 << k)
        same = (at >= 0) & (levels[k][np.maximum(at, 0)] == levels[k][np.maximum(at + (b - a), 0)])
        far += same.astype(np.int64) << k
    return far


# ------------------------------------------------- LCP intervals, children

class Spread:
    """Least and largest values of all stretches of 2**k slots."""

    def __init__(self, values: np.ndarray, widest: int):
        self.n = len(values)
        self.least, self.most = [values], [values]
        while 2 << (len(self.least) - 1) <= min(widest, self.n):
            h, low, high = 1 << (len(self.least) - 1), self.least[-1], self.most[-1]
            self.least.append(np.minimum(low[:-h], low[h:]))
            self.most.append(np.maximum(high[:-h], high[h:]))

    def after(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The first slot after ``at`` with less than ``value``, or the number of slots."""
        to = at + 1
        for k in range(len(self.least) - 1, -1, -1):
            for _ in range(2 if k == len(self.least) - 1 else 1):
                fits = to + (1 << k) <= self.n
                fits &= self.least[k][np.where(fits, to, 0)] >= value
                to = to + (fits.astype(np.int64) << k)
        return to

    def before(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The last slot before ``at`` with less than ``value`` (slot 0 has the least of all)."""
        to = at
        for k in range(len(self.least) - 1, -1, -1):
            for _ in range(2 if k == len(self.least) - 1 else 1):
                back = to - (1 << k)
                fits = (back >= 0) & (self.least[k][np.maximum(back, 0)] >= value)
                to = to - (fits.astype(np.int64) << k)
        return to - 1

    def largest(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The largest value in slots first..last (not empty)."""
        out = np.zeros(len(first), np.int64)
        size = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in np.unique(size):
            own = size == k
            out[own] = np.maximum(self.most[k][first[own]], self.most[k][last[own] - (1 << int(k)) + 1])
        return out


def small_children(lcp: np.ndarray, widest: int) -> tuple[np.ndarray, ...]:
    """(first, last, left, right, depth): the slots first..last of every child but the largest of
    every LCP interval left..right of that depth, where the interval can hold the last square of a
    run: two of its suffixes agree on the rest of the run's periods."""
    at = np.flatnonzero(lcp > 0)
    depth = lcp[at].astype(np.int64)
    spread = Spread(lcp, widest)
    left, right = spread.before(at, depth), spread.after(at, depth) - 1
    able = spread.largest(left + 1, right) >= np.maximum(LEAST_LCP, (LEAST_PERIODS - 1) * depth)
    at, depth, left, right = at[able], depth[able], left[able], right[able]
    prior = spread.before(at, depth + 1)  # the same interval's cut before this one, or its left end
    inner = np.zeros(len(lcp), bool)
    inner[prior[lcp[prior] == depth]] = True
    end = ~inner[at]  # after an interval's last cut comes its last child
    first, last = np.append(prior, at[end]), np.append(at - 1, right[end])
    left, right, depth = np.append(left, left[end]), np.append(right, right[end]), np.append(depth, depth[end])
    by = np.lexsort((last - first, right, left))
    first, last, left, right, depth = (x[by] for x in (first, last, left, right, depth))
    small = np.zeros(len(by), bool)
    small[:-1] = (left[1:] == left[:-1]) & (right[1:] == right[:-1])
    return first[small], last[small], left[small], right[small], depth[small]


def branching_tandems(sa: np.ndarray, lcp: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, depth) of each branching tandem that can be the last square of a run."""
    isa = np.empty(len(sa), np.int64)
    isa[sa] = np.arange(len(sa))
    first, last, left, right, depth = small_children(lcp, widest)
    size = last - first + 1
    upto = np.cumsum(size)
    found, i = [], 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + LOOK_UPS, "right")))
        own = np.repeat(np.arange(i, j), size[i:j])
        slot = np.arange(len(own)) - np.repeat(upto[i:j] - size[i:j] - (upto[i - 1] if i else 0), size[i:j]) + first[own]
        place, d = sa[slot], depth[own]
        for other, start in ((place + d, place), (place - d, place - d)):
            at = isa[np.maximum(other, 0)]
            hit = (other >= 0) & (at >= left[own]) & (at <= right[own]) & ((at < first[own]) | (at > last[own]))
            found.append(np.stack([start[hit], d[hit]]))
        i = j
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(found, axis=1), axis=1)
    return both[0], both[1]


def runs_of(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in rows of codes that each end with the only 0, by start, then period."""
    levels, places, sa = ranked(codes, row)
    lcp = np.zeros(len(sa), np.int32 if len(codes) < 1 << 31 else np.int64)
    if len(sa):
        lcp[1:] = agreement(levels, sa[:-1], sa[1:])
    widest = int(np.bincount(row[places]).max(initial=1)) if len(places) else 1
    place, period = branching_tandems(sa, lcp, widest)
    rotated = agreement_before(levels, place, place + period)
    start, length = place - rotated, rotated + 2 * period
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    start, length, period = start[long], length[long], period[long]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    new = np.ones(len(by), bool)  # a stretch's least period comes first
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    by = np.lexsort((period, start))
    return places[start[by]], length[by], period[by]


# ------------------------------------------------------------------ texts

def _pieces(column: pa.Array) -> Iterator[tuple[int, int]]:
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    upto = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PIECE_BYTES, "right")))
        yield i, j
        i = j


def runs_in(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each text's runs, and its words but those that repeat a run's first period, joined by one blank."""
    cut = pc.ascii_split_whitespace(column)
    flat, size = cut.flatten(), np.diff(cut.offsets.to_numpy())
    row = np.repeat(np.arange(len(column)), size)
    word = pc.not_equal(flat, "")  # before a leading and after a trailing blank
    keep = word.to_numpy(zero_copy_only=False)
    flat, row = flat.filter(word), row[keep]
    count = np.bincount(row, minlength=len(column))
    ends = np.cumsum(count + 1) - 1
    at = np.arange(len(row)) + row  # each row before has an end mark
    codes, rows = np.zeros(len(row) + len(column), np.int64), np.repeat(np.arange(len(column)), count + 1)
    codes[at] = flat.dictionary_encode().indices.to_numpy() + 1
    start, length, period = runs_of(codes, rows)
    own = rows[start]
    drops = np.zeros(len(codes) + 1, np.int64)
    np.add.at(drops, start + period, 1)
    np.add.at(drops, start + length, -1)
    kept = np.cumsum(drops[:-1])[at] == 0
    left = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(column)))]).astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), flat.filter(pa.array(kept))), pa.scalar(" ", flat.type))
    begin = ends[own] - count[own]
    items = pa.StructArray.from_arrays([pa.array(start - begin), pa.array(length), pa.array(period)], ["start", "length", "period"])
    upto = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(column)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(upto), items), collapsed.cast(pa.string())


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string())
        for i, j in _pieces(texts):
            runs, collapsed = runs_in(texts.slice(i, j - i))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), runs, collapsed], names=["id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """Per row: its id, ``runs`` (start, length and period in words, by start, then period) and
    ``collapsed``, the text's words joined by one blank, without those that any run holds after
    its first period."""
    ship_package(docs.sparkSession)
    text = whole(text_col) if isinstance(text_col, str) else F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_find, f"id {kind}, runs {RUN_TYPE}, collapsed string").withColumnRenamed("id", id_col)


# ---------------------------------------------------------- digest columns

def with_periods(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, made periodic from some word on for about a tenth of the ids: the contract's
    test texts. A row without id keeps its text."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)

    def periodic(ws: Column) -> Column:
        n = F.size(ws)
        first = F.pmod(g, n)
        period = 1 + F.floor((n - first) / (3 + g % 8))
        return let(F.struct(first.alias("a"), period.alias("p")), lambda s: F.array_join(F.transform(
            ws, lambda w, i: F.when(i < s["a"], w).otherwise(F.get(ws, (s["a"] + (i - s["a"]) % s["p"]).cast("int")))), " "))

    text = whole(text_col)
    return F.when(h % 10 == 0, let(words(text), lambda ws: F.when(F.size(ws) > 0, periodic(ws)).otherwise(text))).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document: n_runs, the run of the greatest exponent (ties: least start, then period), and
    digests of all runs and of the collapsed text."""
    runs = F.col("runs")
    # By products of whole numbers: the exponents are compared exactly.
    best = F.aggregate(runs, F.get(runs, F.lit(0)), lambda b, r: F.when(
        r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = periodic_runs(docs.select("doc_id", with_periods().alias("text")))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
