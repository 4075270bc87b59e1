"""Personal data by patterns and a linear-chain conditional random field.

The base patterns (email, ip, card, phone) are matched in linear time, leftmost
and non-overlapping per kind. A conditional random field then labels words by
their shape (length, digits, capitals, signs, hex letters; the word's own and its
neighbours') as one of the base kinds or a secret. It is trained on a small
labelled table (pii_labels) by its exact gradient, in under a second on the
driver, with the same weights each time; tasks get the weights only.

Decoding is Viterbi's, over whole texts, in numpy batches: words without a digit,
an at or an equals sign that aren't next to one with are outside by constraint,
so a text falls into short segments which are decoded together, one step for all.
Spans that overlap a base span are left out; base spans stay.

Cases: null and empty texts have no spans; offsets count code points of the whole
text; repeated rows and null ids give a row each; empty input gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import whole
from claimlens.session import ship_package

KINDS = ["email", "ip", "card", "phone", "secret"]
LABELS = ["outside", *KINDS]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match from inside a run of digits would also start at the run's first digit.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at)
        at = text.find("@", max(at + 1, last))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    small = lambda p: len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in code points, by start and kind."""
    found = [(0, _emails(text))] if "@" in text else []
    found += [(1, _ips(text)), (2, _cards(text))]
    if "+" in text:
        found.append((3, _phones(text)))
    return sorted((s, k, e) for k, spans in found for s, e in spans)


# --- word shapes ---------------------------------------------------------------------------------

_CLASSES = np.zeros((256, 14), np.int32)
for _k, _set in enumerate((b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFabcdef", b"@", b".", b"-",
                           b"=", b":", b"()", b'"', b"_", b"+", b"/,%#$")):
    _CLASSES[list(_set), _k] = 1
#: Values of each attribute; 0 of each stands for the place before or after the text.
_BINS = [np.array(b) for b in ((2, 3, 5, 8, 12, 16, 17, 20, 21, 32, 40), (1, 2, 4, 7, 12, 20), (1, 2, 4, 12), (1, 2, 6))]
SIZES = [13, 8, 6, 5, 5, 3, 5, 4, 3, 4, 3, 3, 3, 3, 3, 3, 4]
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])
WIDTH = int(OFFSETS[-1])


def shapes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Attributes (words, len(SIZES)) of the words data[begin:end], each from 1 up."""
    if not len(begin):
        return np.zeros((0, len(SIZES)), np.int64)
    # Signs that close a clause aren't part of the word.
    last = np.isin(data[end - 1], np.frombuffer(b".,;:!?", np.uint8)) & (end - begin > 1)
    end = end - last
    n = end - begin
    at = np.concatenate([[0], np.cumsum(n)])
    byte = data[np.repeat(begin - at[:-1], n) + np.arange(at[-1])]
    c = np.add.reduceat(_CLASSES[byte], at[:-1], axis=0)
    digit, upper, lower, hexl, at_, dot, dash, equals, colon, paren, quote, under, plus, other = c.T
    letters = upper + lower
    first, tail = data[begin], data[end - 1]
    kind = np.select([digit == n, (digit == 0) & (letters > 0), (digit > 0) & (letters > 0), digit > 0], [0, 1, 2, 3], 3)
    hexy = np.where(digit > 0, np.where(letters == 0, 1, np.where(hexl == letters, 2, 0)), 0)
    values = [np.searchsorted(_BINS[0], n, "right"), np.searchsorted(_BINS[1], digit, "right"), np.searchsorted(_BINS[2], upper, "right"),
              np.searchsorted(_BINS[3], lower, "right"), kind, np.minimum(at_, 1), np.minimum(dot, 3), np.minimum(dash, 2),
              np.minimum(equals, 1), np.minimum(colon, 2), np.minimum(paren, 1), np.minimum(quote, 1), np.minimum(under, 1),
              np.minimum(plus, 1), np.where((first >= 48) & (first < 58), 1, 0), np.minimum(other, 1), hexy + 0 * tail]
    return np.stack(values, 1).astype(np.int64) + 1


class Field:
    """Weights: own, previous and next word's attributes by label, and label to label."""

    def __init__(self, own: np.ndarray, step: np.ndarray):
        self.own, self.step = own, step

    def scores(self, before: np.ndarray, here: np.ndarray, after: np.ndarray) -> np.ndarray:
        """(words, labels) from the attribute rows of each word and its neighbours."""
        out = np.zeros((len(here), len(LABELS)))
        for part, rows in enumerate((before, here, after)):
            codes, back = np.unique(rows, axis=0, return_inverse=True)
            out += self.own[part][codes + OFFSETS[:-1]].sum(1)[back.ravel()]
        return out


def _labelled() -> tuple[list[np.ndarray], list[np.ndarray]]:
    from claimlens.llm.pii_labels import LABELLED
    rows, gold = [], []
    for line in LABELLED:
        words, labels = [], []
        for kind, marked, plain in re.findall(r"\[(\w+)\|([^\]]*)\]|((?:(?!\[\w+\|).)+)", line):
            part = (marked or plain)
            glued = bool(words) and not part[:1].isspace() and plain and kind == "" and prior
            ws = part.split()
            if glued and ws:  # a sign right after a span belongs to its last word
                words[-1] += ws.pop(0)
            words += ws
            labels += [LABELS.index(kind) if kind else 0] * len(ws)
            prior = bool(marked)
        raw = " ".join(words).encode()
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
        begins = ends - [len(w.encode()) for w in words]
        rows.append(shapes(data, begins, ends))
        gold.append(np.array(labels))
    return rows, gold


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@lru_cache(maxsize=1)
def train(rounds: int = 300, rate: float = 0.15, decay: float = 0.004) -> Field:
    """The field fitted to the labelled table by Adam on the penalised log likelihood."""
    rows, gold = _labelled()
    n, long, lab = len(rows), max(map(len, rows)), len(LABELS)
    attr = np.zeros((n, long + 2, len(SIZES)), np.int64)
    y = np.zeros((n, long), np.int64)
    size = np.array([len(r) for r in rows])
    for i, (r, g) in enumerate(zip(rows, gold)):
        attr[i, 1:len(r) + 1], y[i, :len(r)] = r, g
    parts = [attr[:, k:k + long] + OFFSETS[:-1] for k in range(3)]
    real = np.arange(long)[None] < size[:, None]
    own, step = np.zeros((3, WIDTH, lab)), np.zeros((lab, lab))
    state = [np.zeros_like(own), np.zeros_like(own), np.zeros_like(step), np.zeros_like(step)]
    hot = np.eye(lab)
    who = np.arange(n)
    for t in range(1, rounds + 1):
        e = sum(own[k][parts[k]].sum(2) for k in range(3))
        fwd, bwd = np.zeros((n, long, lab)), np.zeros((n, long, lab))
        fwd[:, 0] = e[:, 0] + step[0]  # a text is surrounded by words outside
        for i in range(1, long):
            fwd[:, i] = e[:, i] + _log_sum(fwd[:, i - 1][:, :, None] + step, 1)
        for i in range(long - 1, -1, -1):
            after = step[:, 0][None] if i == long - 1 else _log_sum(step[None] + (e[:, i + 1] + bwd[:, i + 1])[:, None], 2)
            bwd[:, i] = np.where((size == i + 1)[:, None], step[:, 0][None], after)
        z = _log_sum(fwd[who, size - 1] + step[:, 0], 1)
        p = np.exp(fwd + bwd - z[:, None, None]) * real[..., None]
        miss = p - hot[y] * real[..., None]
        g_own = np.zeros_like(own)
        for k in range(3):
            np.add.at(g_own[k], parts[k][real], np.repeat(miss[real][:, None], len(SIZES), 1))
        g_step = np.zeros_like(step)
        for i in range(1, long):
            on = real[:, i]
            pair = np.exp(fwd[on, i - 1][:, :, None] + step + (e[on, i] + bwd[on, i])[:, None] - z[on][:, None, None])
            g_step += pair.sum(0)
            np.add.at(g_step, (y[on, i - 1], y[on, i]), -1)
        g_step[0] += miss[:, 0].sum(0)
        g_step[:, 0] += miss[who, size - 1].sum(0)
        for w, g, m, v in ((own, g_own, state[0], state[1]), (step, g_step, state[2], state[3])):
            g = g / n + decay * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return Field(own, step)


def viterbi(field: Field, scores: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best labels of segments of words (begin, size), each between words outside."""
    out = np.zeros(len(scores), np.int64)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    step = field.step
    i = 0
    while i < len(size):  # segments of like lengths together
        j = i + int(np.searchsorted(-size[i:], -(size[i] // 2), "right")) if size[i] > 1 else len(size)
        b, n = begin[i:j], size[i:j]
        long = int(n[0])
        best = scores[b] + step[0]
        back = np.zeros((long, j - i, len(LABELS)), np.int8)
        end = best + step[:, 0]
        for t in range(1, long):
            on = int(np.searchsorted(-n, -t, "left"))  # segments with more than t words come first
            way = best[:on, :, None] + step
            back[t, :on] = way.argmax(1)
            best[:on] = way.max(1) + scores[b[:on] + t]
            end[:on] = best[:on] + step[:, 0]
        label = end.argmax(1)
        for t in range(long - 1, -1, -1):
            on = int(np.searchsorted(-n, -t, "left"))
            out[b[:on] + t] = label[:on]
            if t:
                label[:on] = back[t, np.arange(on), label[:on]]
        i = j
    return out


_MARK = np.zeros(256, bool)
_MARK[list(b"0123456789@=")] = True
_OPENS, _CLOSES = frozenset(b"\"'([<{"), frozenset(b"\"')]>}.,;:!?")


def field_spans(field: Field, data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By row: (start, kind, end) in bytes of the row, of concatenated texts."""
    from claimlens.llm.hashing import _SPACE
    marks = np.flatnonzero(_MARK[data])
    if not len(marks):
        return {}
    ink = ~_SPACE[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    cuts = off[(off > 0) & (off < len(data))]
    first[cuts] = ink[cuts]
    last[cuts - 1] = ink[cuts - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(off, begin, "right") - 1
    own = np.unique(np.searchsorted(begin, marks, "right") - 1)
    near = np.unique(np.concatenate([own, own - 1, own + 1]))
    near = near[(near >= 0) & (near < len(begin))]
    # Neighbours in another text don't count.
    with_mark = np.zeros(len(begin) + 2, bool)
    with_mark[own] = True
    left, right = near - 1, np.minimum(near + 1, len(begin) - 1)
    ok = with_mark[near] | (with_mark[left] & (row[left] == row[near]) & (left >= 0)) \
        | (with_mark[right] & (row[right] == row[near]) & (right > near))
    near = near[ok]
    need = np.unique(np.concatenate([near, near - 1, near + 1]))
    need = need[(need >= 0) & (need < len(begin))]
    found = np.concatenate([np.zeros((1, len(SIZES)), np.int64), shapes(data, begin[need], end[need])])

    def at(k: np.ndarray) -> np.ndarray:
        same = (k >= 0) & (k < len(begin))
        same[same] = row[k[same]] == row[near][same]
        return found[np.where(same, np.searchsorted(need, k) + 1, 0)]

    scores = field.scores(at(near - 1), at(near), at(near + 1))
    new = np.append(True, (np.diff(near) > 1) | (row[near][1:] != row[near][:-1]))
    start = np.flatnonzero(new)
    label = viterbi(field, scores, start, np.diff(np.append(start, len(near))))
    out: dict[int, list[tuple[int, int, int]]] = {}
    prior = None
    for k in np.flatnonzero(label):
        w, kind = int(near[k]), int(label[k]) - 1
        r = int(row[w])
        s, e = int(begin[w]), int(end[w])
        while s < e and int(data[s]) in _OPENS and not (KINDS[kind] == "phone" and data[s] == 40):
            s += 1
        while e > s and int(data[e - 1]) in _CLOSES and not (KINDS[kind] == "phone" and data[e - 1] == 41):
            e -= 1
        if s == e:
            continue
        if prior == (r, kind, w - 1) and KINDS[kind] in ("phone", "card"):
            out[r][-1] = (out[r][-1][0], kind, e - int(off[r]))
        else:
            out.setdefault(r, []).append((s - int(off[r]), kind, e - int(off[r])))
        prior = (r, kind, w)
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_OUT = pa.schema([("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()),
                  ("base_sha256", pa.string()), ("spans", pa.string())])


def _tag(own: np.ndarray, step: np.ndarray):
    def run(batches):
        from claimlens.llm.hashing import pieces
        field, none = Field(own, step), hashlib.sha256(b"").hexdigest()
        for batch in batches:
            column = batch.column(1)
            for i, j, data, off in pieces(column):
                extra = field_spans(field, data, off)
                marks = np.flatnonzero(_MARK[data])
                marked = set((np.searchsorted(off, marks, "right") - 1).tolist())
                rows = []
                for r in range(j - i):
                    if r not in marked:
                        rows.append((0, 0, 0, 0, none, ""))
                        continue
                    raw = data[off[r]:off[r + 1]]
                    spans = base_spans(raw.tobytes().decode())
                    count = [0] * len(KINDS)
                    for _, k, _ in spans:
                        count[k] += 1
                    every = spans
                    if r in extra:
                        points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                        more = [(int(points[s]), k, int(points[e])) for s, k, e in extra[r]]
                        every = sorted(spans + [(s, k, e) for s, k, e in more if not any(s < y and x < e for x, _, y in spans)])
                    rows.append((*count[:4], hashlib.sha256(_joined(spans).encode()).hexdigest() if spans else none, _joined(every)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT))],
                                                 names=["id", *_OUT.names])
    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of base spans by kind, base_sha256, spans (kind:start:end, base and tagged ones)."""
    ship_package(docs.sparkSession)
    field = train()
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(_tag(field.own, field.step), f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, "
                                                       "base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
