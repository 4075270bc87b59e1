"""Removal of byte strings that an earlier document has, by longest-previous-factor arrays.

A byte goes if a 50-byte string covers it that also starts in a document with a
smaller id. One suffix array of all texts would be tens of times their size, so
only suffixes that can match are sorted, in independent buckets:

1. Equal texts are one: all but the one with the smallest id go whole.
2. Every 50-byte window has an anchor, its 26-byte substring with the least hash,
   so documents that share the window share the anchor (about one in 13 bytes is
   one). Anchor hashes meet in buckets; a hash of one document only is dropped.
3. For each other anchor, the windows that it stands for go to the bucket of its
   hash, as one stretch of at most 74 bytes. Equal stretches are told by their
   bytes: all but the earliest document's are covered. Of an anchor's different
   stretches, the windows with the same hash as another give a suffix array; the
   previous and the next smaller document in suffix order are the candidates for the
   longest previous factor, and a window whose factor is 50 bytes or more is covered.
4. Covered windows, joined into runs per document, are cut out of the texts.

What a chunk of documents can settle by itself (an anchor or a stretch of several
of its documents) is settled before the shuffle, so a passage in a third of all
documents sends each bucket one entry a chunk, not one a document.

An anchor of more than ``HOT`` documents may have as many different stretches (a
phrase that a third of all documents use, each in other words): its windows go to the
buckets of their own hashes instead, each chunk's earliest of equal ones, so no task
holds them all. At most ``MAX_HOT`` such anchors (8 bytes each) are told to all tasks;
with more of them the bar rises by powers of two, so an anchor that isn't among them has
HOT documents or less, or less than two millionths of all (anchor, document) pairs.

The number of buckets follows from the texts' bytes alone. Buckets answer by blocks of
documents, not by document: a row holds the ids, counts and values of one bucket's
documents in one block, and each block's rows are then joined into one a document.

Cases: null texts are empty; texts under 50 bytes stay whole, copies too; a null
id counts as later than all others; texts with the same id don't remove from each
other; repeated rows all show the same result; empty input gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import Stages, whole

LEN = 50
KMER = 26
#: Anchors that a bucket has on average; bytes of the texts of a block of documents.
BUCKET, BLOCK = 1_000_000, 32 << 20
#: See above.
HOT, MAX_HOT = 8192, 1 << 20
LATE = (1 << 63) - 1
_BASE = 0xD1342543DE82EF95
REACH = LEN - KMER  # windows of an anchor start at most so far before it
WIDE = REACH + LEN  # bytes of a stretch


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width] for each full window."""
    have, w = x, 1
    while 2 * w <= width:
        have = best(have[:-w], have[w:])
        w *= 2
    return best(have[:len(have) - (width - w)], have[width - w:]) if w < width else have


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and owners of the anchors of concatenated texts.

    ``owner`` has, for each window start, the index of its anchor; -1 where no
    window of one text starts."""
    from claimlens.llm.hashing import U, mixed, powers
    n = len(data)
    owner = np.full(n, -1, np.int64)
    if n < LEN:
        return np.zeros(0, np.int64), np.zeros(0, U), owner
    total = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(_BASE, n), out=total[1:])
    h = (total[KMER:] - total[:-KMER]) * powers(pow(_BASE, -1, 1 << 64), n - KMER + 1)
    # The low bits give the place, so one sliding minimum finds the least hash and where it is. Only a
    # 26-byte string that recurs in a window can tie, and its hash is the same at either place.
    h = (mixed(h) & U(~31 & (1 << 64) - 1)) | (np.arange(len(h), dtype=U) & U(31))
    least = _slide(h, REACH + 1, np.minimum)  # by window start
    starts = np.arange(n - LEN + 1)
    at = starts + (((least & U(31)).astype(np.int64) - starts) & 31)
    valid = np.ones(n - LEN + 1, bool)
    for cut in off[1:-1].tolist():
        valid[max(0, cut - LEN + 1):cut] = False
    starts, at = starts[valid], at[valid]
    is_anchor = np.zeros(n, bool)
    is_anchor[at] = True
    where = np.flatnonzero(is_anchor)
    owner[starts] = (np.cumsum(is_anchor) - 1)[at]
    return where, h[where] >> U(5), owner


REF = np.uint16  # a chunk has about a megabyte and each of its texts LEN bytes at least
CODE = 40  # bits of a hash that are kept beside its bucket: two anchors of a bucket meet by chance once in half a million


def _codes(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and the bits beside it, of an anchor hash; the bucket is code >> CODE."""
    b = np.uint64(buckets)
    return (h % b) << np.uint64(CODE) | (h // b) & np.uint64((1 << CODE) - 1)


def _pack(code: np.ndarray, whole: bool) -> bytes:
    """Codes as bytes; without the bucket if it goes without saying."""
    return code.tobytes() if whole else np.ascontiguousarray(code.view(np.uint8).reshape(-1, 8)[:, :CODE // 8]).tobytes()


def _unpack_codes(raw: bytes, whole: bool, bucket: int) -> np.ndarray:
    if whole:
        return np.frombuffer(raw, np.uint64)
    out = np.zeros((len(raw) // (CODE // 8), 8), np.uint8)
    out[:, :CODE // 8] = np.frombuffer(raw, np.uint8).reshape(-1, CODE // 8)
    return out.view(np.uint64).ravel() | np.uint64(bucket << CODE)


def _doc_of(pos: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.searchsorted(off, pos, "right") - 1


def _chunks(batches, names):
    """(columns of the chunk, bytes, offsets) of runs of rows; see hashing.pieces."""
    from claimlens.llm.hashing import pieces
    for batch in batches:
        t = batch.column(batch.schema.get_field_index("text"))
        for i, j, data, off in pieces(t):
            yield {c: batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in names}, data, off


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal lengths as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _rows(schema: pa.Schema, rows: list[tuple]):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_ANCHOR = pa.schema([("bucket", pa.int64()), ("settled", pa.bool_()), ("h", pa.binary()), ("ref", pa.binary()),
                     ("docs", pa.binary()), ("n", pa.binary())])


def _emit_anchors(buckets: int):
    def run(batches):
        salt = 0
        for cols, data, off in _chunks(batches, ["rid"]):
            rid = _fixed(cols["rid"], 16)
            where, h, _ = anchors(data, off)
            if not len(where):
                continue
            h, doc = _codes(h, buckets), _doc_of(where, off)
            order = np.argsort(h, kind="stable")  # by document within a hash, as places ascend
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[new], doc[new]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            size = np.diff(np.append(np.flatnonzero(first), len(h)))
            many = np.repeat(size > 1, size)
            rows = []

            def put(bucket, settled, pick, n):
                used, ref = np.unique(doc[pick], return_inverse=True)
                rows.append((bucket, settled, _pack(h[pick], settled), ref.astype(REF).tobytes(), rid[used].tobytes(), n))

            if many.any():  # of several documents here: known to be shared; salted, not by hash
                salt += 1
                put(buckets + (int(h[0]) + salt) % buckets, True, np.flatnonzero(many), b"")
            head = np.flatnonzero(first)
            b = (h[head] >> np.uint64(CODE)).astype(np.int64)  # in order, as codes are
            ends = np.flatnonzero(np.append(np.diff(b) != 0, True)) + 1
            for s, e in zip(np.append(0, ends[:-1]), ends):
                # A hash that is settled here is sent too, so that other chunks learn that it is shared.
                put(int(b[s]), False, head[s:e], size[s:e].astype(REF).tobytes())
            yield from _rows(_ANCHOR, rows)
    return run


#: By block: the documents' ids, how many values each has, and the values one document after the other;
#: with block null a hot anchor and its documents.
_BY_BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("value", pa.binary()),
                       ("hot", pa.int64()), ("n", pa.int64())])


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, document numbers and the documents' ids of a bucket's entries."""
    h = _unpack_codes(b"".join(table["h"].to_pylist()), table["settled"][0].as_py(), table["bucket"][0].as_py())
    docs, ref, base = [], [], 0
    for r, d in zip(table["ref"].to_pylist(), table["docs"].to_pylist()):
        ref.append(np.frombuffer(r, REF).astype(np.int64) + base)
        docs.append(np.frombuffer(d, np.uint8).reshape(-1, 16))
        base += len(docs[-1])
    return h, np.concatenate(ref), np.concatenate(docs)


def _by_block(doc: np.ndarray, value: np.ndarray, docs: np.ndarray, blocks: int, hot: tuple = ((), ())) -> pa.Table:
    """The values of documents, a row for each block that has any; and the hot anchors."""
    block = np.ascontiguousarray(docs[:, :8]).view(np.uint64).ravel() % np.uint64(blocks)
    order = np.lexsort((doc, block[doc]))
    doc, value = doc[order], value[order]
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    size, own = np.diff(np.append(at, len(doc))).astype(np.int32), block[doc[at]]
    cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else []
    rows = [(int(own[s]), docs[doc[at[s:e]]].tobytes(), size[s:e].tobytes(), value[at[s]:at[e] if e < len(at) else len(doc)].tobytes(),
             None, None) for s, e in zip(cuts, [*cuts[1:], len(own)])]
    rows += [(None, None, None, None, int(h), int(n)) for h, n in zip(*hot)]
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_BY_BLOCK)], schema=_BY_BLOCK)


def _join_blocks(width: int, join):
    """Of one block's rows: one row a document, (rid, join(values))."""
    schema = pa.schema([("rid", pa.binary()), ("value", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        docs = np.frombuffer(b"".join(table["docs"].to_pylist()), "V16")
        size = np.frombuffer(b"".join(table["sizes"].to_pylist()), np.int32)
        value = np.frombuffer(b"".join(table["value"].to_pylist()), f"V{width}")
        used, doc = np.unique(docs, return_inverse=True)
        doc = np.repeat(doc, size)
        order = np.argsort(doc, kind="stable")
        value, at = value[order], np.searchsorted(doc[order], np.arange(len(used) + 1))
        return pa.table([pa.array([x.tobytes() for x in used], pa.binary()),
                         pa.array([join(value[s:e].tobytes()) for s, e in zip(at, at[1:])], pa.binary())], schema=schema)
    return run


def _shared_anchors(blocks: int, most: int):
    def run(table: pa.Table) -> pa.Table:
        h, ref, docs = _unpack(table)
        if table["settled"][0].as_py():
            return _by_block(ref, h, docs, blocks)
        n = np.frombuffer(b"".join(table["n"].to_pylist()), REF).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, ref, n = h[order], ref[order], n[order]
        same = h[1:] == h[:-1]
        live = np.append(same, False) | np.append(False, same)  # entries of two chunks: of two documents
        first = np.flatnonzero(np.append(True, ~same))
        n = np.add.reduceat(n, first)
        return _by_block(ref[live], h[live], docs, blocks, (h[first][n > most], n[n > most]))
    return run


def _hot_anchors(live: DataFrame) -> np.ndarray:
    """Codes of the hot anchors, MAX_HOT at most."""
    hot = live.filter("block IS NULL").select("hot", "n", F.floor(F.log2("n")).alias("power"))
    bar, total = 64, 0
    for r in hot.groupBy("power").count().orderBy(F.desc("power")).collect():  # a row for each power of two
        total += r["count"]
        if total > MAX_HOT:
            break
        bar = r["power"]
    return np.sort(np.array([r.hot for r in hot.filter(F.col("power") >= bar).select("hot").collect()], np.int64).astype(np.uint64))


_STRETCH = pa.schema([("bucket", pa.int64()), ("settled", pa.bool_()), ("h", pa.binary()), ("ref", pa.binary()),
                      ("docs", pa.binary()), ("at", pa.binary()), ("ord", pa.binary()), ("text", pa.binary())])
_PLACE = np.dtype([("at", "<i4"), ("lo", "i1"), ("hi", "i1")])  # Arrow's strings are shorter than 2 GB


def _same(*keys: np.ndarray) -> np.ndarray:
    """Whether each entry, but the first, equals the one before it in all keys."""
    out = keys[0][1:] == keys[0][:-1]
    for k in keys[1:]:
        out = out & (k[1:] == k[:-1])
    return out


def _cut_stretches(data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rows of WIDE bytes around the anchors; zero outside the windows lo..hi (relative starts)."""
    rel = np.arange(-REACH, LEN)[None]
    out = np.zeros((len(at), WIDE), np.uint8)
    step = 1 << 15
    for i in range(0, len(at), step):
        a, l, e = at[i:i + step, None], lo[i:i + step, None], hi[i:i + step, None] + LEN
        inside = (rel >= l) & (rel < e)
        out[i:i + step] = np.where(inside, data[np.clip(a + rel, 0, len(data) - 1)], 0)
    return out


def _digest(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of WIDE bytes; only to order them, bytes are compared after."""
    from claimlens.llm.hashing import U, mixed
    padded = np.zeros((len(rows), -(-WIDE // 8) * 8), np.uint8)
    padded[:, :WIDE] = rows
    words = padded.view(np.uint64)
    out = np.zeros(len(rows), U)
    for k in range(words.shape[1]):
        out = mixed(out ^ words[:, k] + U(k))
    return out


def _window_hashes(text: np.ndarray) -> np.ndarray:
    """Hashes of all windows of rows of WIDE bytes."""
    from claimlens.llm.hashing import U, mixed, powers
    total = np.zeros((len(text), WIDE + 1), U)
    np.cumsum((text.astype(U) + U(1)) * powers(_BASE, WIDE), axis=1, out=total[:, 1:])
    return mixed((total[:, LEN:] - total[:, :-LEN]) * powers(pow(_BASE, -1, 1 << 64), REACH + 1))


def _emit_stretches(buckets: int, hot: np.ndarray):
    def run(batches):
        salt = 0
        for cols, data, off in _chunks(batches, ["rid", "ord", "live"]):
            rid, when = _fixed(cols["rid"], 16), cols["ord"].to_numpy(zero_copy_only=False)
            where, h, owner = anchors(data, off)
            h, doc = _codes(h, buckets), _doc_of(where, off)
            live = np.zeros(len(where), bool)
            span = np.searchsorted(doc, np.arange(len(off)))
            for d, hs in enumerate(cols["live"].to_pylist()):
                s, e = span[d], span[d + 1]
                live[s:e] = np.isin(h[s:e], np.frombuffer(hs, np.uint64))
            pick = np.flatnonzero(live)
            if not len(pick):
                continue
            starts = np.flatnonzero(owner >= 0)
            first, last = np.empty(len(where), np.int64), np.empty(len(where), np.int64)
            first[owner[starts][::-1]] = starts[::-1]  # of equal indices the last one written stays
            last[owner[starts]] = starts
            # An anchor's windows need not be adjacent (its hash may recur): the stretch spans them
            # all, and those in between are windows of the same text too.
            lo, hi = first[pick] - where[pick], last[pick] - where[pick]
            rows = []

            def settle(hh, dd, at, lo, hi, text):
                """Of equal stretches all but the earliest document's are settled; the others' indices."""
                nonlocal salt
                dig = _digest(text) ^ ((lo + 64) * 128 + hi + 64).astype(np.uint64)
                order = np.lexsort((when[dd], dig, hh))
                same = _same(hh[order], dig[order]) & (text[order[1:]] == text[order[:-1]]).all(1) & _same(lo[order], hi[order])
                head = np.append(True, ~same)
                group = np.cumsum(head) - 1
                later = when[dd[order]] > when[dd[order]][head][group]
                if later.any():
                    salt += 1
                    put(buckets + (int(hh[0]) + salt) % buckets, True, order[later], hh, dd, at, lo, hi, None)
                return order[~later]  # the earliest, and those of the same id: to be compared with other chunks'

            def put(bucket, settled, i, hh, dd, at, lo, hi, text):
                used, ref = np.unique(dd[i], return_inverse=True)
                place = np.zeros(len(i), _PLACE)
                place["at"], place["lo"], place["hi"] = at[i], lo[i], hi[i]
                rows.append((bucket, settled, _pack(hh[i], settled), ref.astype(REF).tobytes(), rid[used].tobytes(),
                             place.tobytes(), when[used].tobytes(), b"" if text is None else text[i].tobytes()))

            def send(i, hh, *more):
                """To the buckets of their codes; i is in the codes' order."""
                b = (hh[i] >> np.uint64(CODE)).astype(np.int64)
                ends = np.flatnonzero(np.append(np.diff(b) != 0, True)) + 1
                for s, e in zip(np.append(0, ends[:-1]), ends):
                    put(int(b[s]), False, i[s:e], hh, *more)

            of = (h[pick], doc[pick], where[pick] - off[doc[pick]], lo, hi, _cut_stretches(data, where[pick], lo, hi))
            rest = settle(*of)
            common = np.zeros(len(rest), bool)
            if len(hot):
                common = hot[np.minimum(np.searchsorted(hot, of[0][rest]), len(hot) - 1)] == of[0][rest]
            if not common.all():
                send(rest[~common], *of)
            if common.any():  # by their windows
                i = rest[common]
                n = (hi - lo + 1)[i]
                k, w = np.repeat(i, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                w += lo[k]
                own = _window_hashes(of[5][i])[np.repeat(np.arange(len(i)), n), w + REACH]
                zero = np.zeros(len(k), np.int64)
                of = (_codes(own, buckets), of[1][k], of[2][k] + w, zero, zero, _cut_stretches(data, where[pick][k] + w, zero, zero))
                send(settle(*of), *of)
            yield from _rows(_STRETCH, rows)
    return run


def previous_smaller(value: np.ndarray) -> np.ndarray:
    """For each place, the nearest one before it with a smaller value; -1: none.

    Blocks of 1, 2, 4, ... places keep their least values; the search steps back by
    the largest blocks without a smaller value, then narrows down."""
    n = len(value)
    least = [value]
    while 2 ** len(least) <= n:
        w = 2 ** (len(least) - 1)
        least.append(np.minimum(least[-1][:-w], least[-1][w:]))  # least over [i, i + 2w)
    at = np.arange(n)  # everything in [at, i) is known not to be smaller
    for k in range(len(least) - 1, -1, -1):
        can = np.flatnonzero(at >= 2 ** k)
        skip = can[least[k][at[can] - 2 ** k] >= value[can]]
        at[skip] -= 2 ** k
    return at - 1


def longest_previous_factor(window: np.ndarray, when: np.ndarray) -> np.ndarray:
    """Longest common prefix (at most the row length) of each row of bytes with a row of an earlier document."""
    n, wide = window.shape
    order = np.lexsort([when, *(window[:, k] for k in range(wide - 1, -1, -1))]) if n < 64 else _suffix_order(window, when)
    sorted_, value = window[order], when[order]
    out = np.zeros(n, np.int64)
    for flip in (False, True):  # previous smaller, then next smaller
        v = value[::-1] if flip else value
        p = previous_smaller(v)
        i = np.flatnonzero(p >= 0)
        a, b = (n - 1 - i, n - 1 - p[i]) if flip else (i, p[i])
        differ = sorted_[a] != sorted_[b]
        lcp = np.where(differ.any(1), differ.argmax(1), wide)
        out[order[a]] = np.maximum(out[order[a]], lcp)
    return out


def _suffix_order(window: np.ndarray, when: np.ndarray) -> np.ndarray:
    """Rows in lexicographic order, ties by document: a sort by big-endian words."""
    padded = np.zeros((len(window), -(-window.shape[1] // 8) * 8), np.uint8)
    padded[:, :window.shape[1]] = window
    words = padded.view(">u8").astype(np.uint64)
    return np.lexsort([when, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1))])


def _cover(blocks: int):
    return lambda table: _by_block(*_covered(table), blocks)


def _covered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document numbers, spans and the documents' ids of what a bucket covers."""
    h, ref, docs = _unpack(table)
    place = np.frombuffer(b"".join(table["at"].to_pylist()), _PLACE)
    at, lo, hi = (place[k].astype(np.int64) for k in ("at", "lo", "hi"))
    when = np.frombuffer(b"".join(table["ord"].to_pylist()), np.int64)[ref]
    if table["settled"][0].as_py():
        return ref, np.stack([at + lo, at + hi + LEN], 1).view("V16").ravel(), docs
    text = np.frombuffer(b"".join(table["text"].to_pylist()), np.uint8).reshape(-1, WIDE)
    dig = _digest(text) ^ ((lo + 64) * 128 + hi + 64).astype(np.uint64)
    order = np.lexsort((when, dig, h))
    h, ref, at, lo, hi, when, text, dig = (x[order] for x in (h, ref, at, lo, hi, when, text, dig))
    head = np.append(True, ~(_same(h, dig, lo, hi) & (text[1:] == text[:-1]).all(1)))
    group = np.cumsum(head) - 1
    later = when > when[head][group]
    doc, spans = [ref[later]], [np.stack([at[later] + lo[later], at[later] + hi[later] + LEN], 1)]
    # Anchors with different stretches: a suffix array of their windows, one anchor after the other.
    heads = np.flatnonzero(head)
    first = np.append(True, h[heads][1:] != h[heads][:-1])
    size = np.diff(np.append(np.flatnonzero(first), len(heads)))
    several = heads[np.repeat(size > 1, size)]
    step = max(1, 1 << 13)
    s = 0
    while s < len(several):  # whole anchors, some thousand stretches at a time
        e = min(len(several), s + step)
        while e < len(several) and h[several[e]] == h[several[e - 1]]:
            e += 1
        part = several[s:e]
        s = e
        n = (hi - lo + 1)[part]
        row = np.repeat(np.arange(len(part)), n)
        o = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[part][row]
        # A window whose hash no other one has isn't anywhere else.
        own = _window_hashes(text[part])[row, o + REACH]
        by = np.argsort(own)
        twice = np.append(False, own[by[1:]] == own[by[:-1]])
        two = np.sort(by[twice | np.append(twice[1:], False)])
        hit = np.zeros(len(row), bool)
        if not len(two):
            continue
        window = text[part[row[two]][:, None], (o[two] + REACH)[:, None] + np.arange(LEN)[None]]
        hit[two] = longest_previous_factor(window, when[part[row[two]]]) >= LEN
        # An earlier text's window covers this group's earliest documents (its later ones are covered whole).
        members = np.flatnonzero(~later & np.isin(group, group[part]))
        key = np.searchsorted(group[part], group[members])
        begin, stop = np.cumsum(n) - n, np.cumsum(n)
        count = np.add.reduceat(hit, begin)
        for m, k in zip(members[count[key] > 0], key[count[key] > 0]):
            w = o[begin[k]:stop[k]][hit[begin[k]:stop[k]]] + at[m]
            new = np.append(True, np.diff(w) > 1)  # neighbouring windows make one span
            spans.append(np.stack([w[new], w[np.append(new[1:], True)] + LEN], 1))
            doc.append(np.full(len(spans[-1]), ref[m]))
    spans = np.concatenate(spans)
    return np.concatenate(doc), np.ascontiguousarray(spans).view("V16").ravel(), docs


def runs(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) rows."""
    s = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(s[:, 1])
    new = np.append(True, s[1:, 0] > end[:-1])
    return np.stack([s[new, 0], end[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]], 1)


def _remove(batches):
    import hashlib
    for batch in batches:
        rows = []
        for rid, text, blobs in zip(*(batch.column(k) for k in range(3))):
            data = (text.as_py() or "").encode()
            cut = np.frombuffer(blobs.as_py(), np.int64).reshape(-1, 2)
            kept, upto = [], 0
            for s, e in cut.tolist():
                kept.append(data[upto:s])
                upto = e
            kept.append(data[upto:])
            rows.append((rid.as_py(), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), hashlib.sha256(b"".join(kept)).hexdigest(),
                         cut.ravel().tolist()))
        yield from _rows(pa.schema([("rid", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                                    ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))]), rows)


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_docs: int = HOT) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end, start, ... in bytes).

    Anchors of more than ``hot_docs`` documents are worked on by window; the result is the same."""
    stages = Stages(docs.sparkSession)
    raw = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LATE)).alias("ord"),
                      whole(text_col).alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    ids = stages.write(raw.select("id", "ord", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "ids")
    firsts = stages.write(ids.groupBy("sha").agg(F.min("ord").alias("first"), F.max("n_bytes").alias("n_bytes")), "firsts")
    total = firsts.agg(F.sum("n_bytes")).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, blocks = max(1, math.ceil(total / 13 / BUCKET)), max(1, math.ceil(total / BLOCK))
    rid = F.substring("sha", 1, 16).alias("rid")
    # Different texts, once: bucketed by their id, so that the joins below move no text again.
    long = raw.filter(F.octet_length("text") >= LEN).groupBy(rid).agg(F.min("ord").alias("ord"), F.first("text").alias("text"))
    texts = stages.bucketed(long, "texts", "rid", parts)
    entries = texts.select("rid", "text").mapInArrow(_emit_anchors(buckets), _ddl(_ANCHOR))
    live = stages.write(entries.groupBy("bucket").applyInArrow(_shared_anchors(blocks, hot_docs), _ddl(_BY_BLOCK)), "live")
    hot = _hot_anchors(live)
    by_doc = live.filter("block IS NOT NULL").groupBy("block").applyInArrow(_join_blocks(8, bytes), "rid binary, value binary")
    joined = texts.join(by_doc.withColumnRenamed("value", "live").hint("merge"), "rid")
    stretches = joined.select("rid", "ord", "live", "text").mapInArrow(_emit_stretches(buckets, hot), _ddl(_STRETCH))
    spans = stages.write(stretches.groupBy("bucket").applyInArrow(_cover(blocks), _ddl(_BY_BLOCK)), "spans")
    stages.drop("live")
    joined_runs = lambda raw: runs(np.frombuffer(raw, np.int64).reshape(-1, 2)).tobytes()
    by_doc = spans.groupBy("block").applyInArrow(_join_blocks(16, joined_runs), "rid binary, value binary")
    cut = stages.write(texts.join(by_doc.hint("merge"), "rid").select("rid", "text", "value").mapInArrow(
        _remove, "rid binary, n_removed long, n_spans long, kept_sha256 string, spans array<long>"), "cut")
    stages.drop("spans", "texts")
    whole_copy = (F.col("ord") > F.col("first")) & (F.col("n_bytes") >= LEN)
    nothing = F.sha2(F.lit(""), 256)
    zero = F.lit(0).cast("long")
    return ids.join(firsts.select("sha", "first"), "sha").withColumn("rid", F.substring("sha", 1, 16)).join(cut, "rid", "left").select(
        F.col("id").alias(id_col), "n_bytes", F.when(whole_copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole_copy, zero + 1).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole_copy, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(whole_copy, F.array(zero, F.col("n_bytes"))).otherwise(F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"))


def _ddl(schema: pa.Schema) -> str:
    names = {"int64": "long", "bool": "boolean", "binary": "binary"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)
