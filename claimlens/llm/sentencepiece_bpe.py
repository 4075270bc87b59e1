"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

An agenda of adjacent symbol pairs, ordered by the score of the piece that they
would make (ties: leftmost first), is worked off until no pair makes a piece.
Texts are first cut where no piece can span: before a blank symbol that follows
another symbol, if the vocabulary has no piece across such a place. Such chunks
are merged independently and their ids kept in a bounded table per worker.

Short chunks go through the agenda together, one merge per chunk and step, in
numpy arrays (the best pair of each row is its agenda's head); long ones have a
heap of their own, O(n log n) in their length. With ``check`` (the default) every
chunk that isn't in the table is also encoded by the sentencepiece library, per
Arrow batch, and a difference raises an error. Decoding is the library's.

Cases: null and empty texts have the end id only and decode to the empty string;
repeated rows, null ids and ties need nothing special; long texts are encoded
whole, their memory grows with the longest text of a batch; empty input gives an
empty result; other columns are carried by ``encode_rows`` whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import whole

BLANK = "▁"
#: Chunks whose ids a worker keeps (twice, at most); the least recent ones go.
KEPT_CHUNKS = 600_000
#: Longer chunks (in symbols) have a heap of their own.
SHORT_CHUNK = 24
#: Texts' characters that are worked on at a time.
PIECE_CHARS = 1 << 21
NONE = (1 << 31) - 1


class MergeModel:
    """A merge-type vocabulary: pieces, their ids and ranks (0: merged first)."""

    def __init__(self, model_file: str):
        import sentencepiece
        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        # Equal scores share a rank, so that ties go to the leftmost pair.
        score = {p: sp.get_score(i) for p, i in self.ids.items()}
        place = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: place[s] for p, s in score.items()}
        self.cut = not any(a != BLANK and b == BLANK for p in self.ids for a, b in zip(p, p[1:]))
        self.chunks = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+") if self.cut else re.compile("(?s).+")
        # Symbols get numbers: pieces their id, characters that only occur inside pieces the next ones.
        number = dict(self.ids)
        for p in self.ids:
            for c in p:
                number.setdefault(c, size + len(number))
        self.number = number
        self._pairs([(number[p[:k]] << 32 | number[p[k:]], self.rank[p], i) for p, i in self.ids.items()
                     for k in range(1, len(p)) if p[:k] in number and p[k:] in number])
        self.names, self.ints = names, list(range(size))
        self.inner = {v: k for k, v in number.items() if v >= size}
        # Characters outside the vocabulary get numbers below -1 and never merge.
        self.char = -2 - np.arange(0x110000, dtype=np.int32)
        single = [(ord(p), v) for p, v in number.items() if len(p) == 1]
        self.char[[c for c, _ in single]] = [v for _, v in single]
        self.decimal = [str(i) for i in range(size)]
        self.kept: dict[str, tuple[int, ...]] = {}
        self.former: dict[str, tuple[int, ...]] = {}

    def chunk_ids(self, symbols: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def by_heap(self, chunk: str) -> tuple[int, ...]:
        """One chunk, of any length."""
        sym, n = list(chunk), len(chunk)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 <= b and (r := self.rank.get(made := sym[a] + sym[b])) is not None:
                heapq.heappush(agenda, (r, a, b, made))

        for k in range(n - 1):
            offer(k, k + 1)
        while agenda:
            _, a, b, made = heapq.heappop(agenda)
            if not sym[a] or not sym[b] or right[a] != b or sym[a] + sym[b] != made:
                continue  # one of the two has been merged meanwhile
            sym[a], sym[b] = made, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return self.chunk_ids([s for s in sym if s])

    def _pairs(self, pairs: list[tuple[int, int, int]]) -> None:
        """An open-addressing table of (left << 32 | right) with rank and made piece."""
        bits = max(4, (4 * len(pairs)).bit_length())
        self.mask = (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_rank = np.full(1 << bits, NONE, np.int32)
        self.slot_made = np.zeros(1 << bits, np.int32)
        key, rank, made = (np.array(x, np.int64) for x in zip(*pairs))
        at, left = self._home(key), np.arange(len(key))
        while len(left):
            free = self.slot_key[at[left]] == -1
            first = np.unique(at[left[free]], return_index=True)[1]
            put = left[free][first]
            self.slot_key[at[put]], self.slot_rank[at[put]], self.slot_made[at[put]] = key[put], rank[put], made[put]
            left = left[~np.isin(left, put)]
            at[left] = np.where(self.slot_key[at[left]] != -1, (at[left] + 1) & self.mask, at[left])

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key ^ (key >> 29)) * 0x9E3779B1 >> 12) & self.mask

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and number of the piece that each two symbols make (NONE: none)."""
        key = (a.astype(np.int64) << 32) | b
        key[(a < 0) | (b < 0)] = -2
        at = self._home(key)
        have = self.slot_key[at]
        todo = np.flatnonzero((have != key) & (have != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            have = self.slot_key[at[todo]]
            todo = todo[(have != key[todo]) & (have != -1)]
        return self.slot_rank[at], self.slot_made[at]

    def by_table(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """Many chunks of at most SHORT_CHUNK symbols, a merge for each in every step.

        Symbols of a chunk are a linked list in its row; the last column ends it on
        both sides. The rank at a symbol is that of the pair it begins."""
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        n, wide = len(chunks), int(lens.max()) + 1
        sym = np.full((n, wide), -1, np.int32)
        own = np.arange(wide)[None] < lens[:, None]
        sym[own] = self.char[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        rank2, made = (np.empty((n, wide), np.int32) for _ in range(2))
        rank2[:, -1], made[:, -1] = NONE, 0
        found = self._ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel())
        rank2[:, :-1], made[:, :-1] = (x.reshape(n, wide - 1) for x in found)
        after = np.arange(1, n * wide + 1, dtype=np.int64)
        before = np.arange(-1, n * wide - 1, dtype=np.int64)
        before[::wide] += wide
        done, sym, rank, made = sym, sym.ravel(), rank2.ravel(), made.ravel()
        live = np.arange(n)
        while True:
            best = rank2[live].argmin(1) + live * wide
            go = rank[best] < NONE
            live, here = live[go], best[go]
            if not len(live):
                break
            gone = after[here]
            then = after[gone]
            sym[here], sym[gone], rank[gone] = made[here], -1, NONE
            after[here], before[then] = then, here
            rank[here], made[here] = self._ranks(sym[here], sym[then])
            prior = before[here]
            rank[prior], made[prior] = self._ranks(sym[prior], sym[here])
        real = done != -1
        flat, upto = done[real], np.concatenate([[0], np.cumsum(real.sum(1))]).tolist()
        odd = ((done < -1) | (done >= len(self.names))).any(1)
        own_int = self.ints.__getitem__
        odd_at = set(np.flatnonzero(odd).tolist())
        flat[(flat < 0) | (flat >= len(self.names))] = 0
        flat = list(map(own_int, flat.tolist()))
        out = [tuple(flat[a:b]) for a, b in zip(upto, upto[1:])]
        for r in odd_at:  # symbols outside the vocabulary: by their bytes
            out[r] = self.chunk_ids([self.spelled(i) for i in done[r][real[r]].tolist()])
        return out

    def spelled(self, number: int) -> str:
        if number < 0:
            return chr(-2 - number)
        return self.names[number] if number < len(self.names) else self.inner[number]

    def learn(self, keys: set[str], check: bool) -> None:
        """Ids of chunks that aren't kept yet."""
        short = sorted((k for k in keys if len(k) < SHORT_CHUNK), key=len)  # rows of like width
        chunk = lambda k: k[1:] if k[:1] == BLANK else BLANK + k
        for i in range(0, len(short), 20_000):
            part = short[i:i + 20_000]
            self.kept.update(zip(part, self.by_table([chunk(k) for k in part])))
        self.kept.update((k, self.by_heap(chunk(k))) for k in keys if len(k) >= SHORT_CHUNK)
        if check:  # the library puts one blank before a text that isn't empty
            part = [k for k in keys if k and (k[0] != BLANK or k[1:2] == BLANK)]
            texts = [k[2:].replace(BLANK, " ") if k[0] == BLANK else k for k in part]
            for k, ids in zip(part, self.lib.encode(texts, num_threads=1)):
                if self.kept[k] != tuple(ids):
                    raise ValueError(f"chunk {chunk(k)!r}: {self.kept[k]} here, {tuple(ids)} by the library")

    def encode(self, texts: list[str], check: bool = True) -> list[list[int]]:
        """Ids of whole texts, without an end id."""
        cut = [self.cut_up(self.lib.normalize(t)) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)) - self.kept.keys()
        if len(self.kept) + len(new) > KEPT_CHUNKS:  # start anew, taking over what is met again
            self.former, self.kept = self.kept, {}
            new = set(chain.from_iterable(cut))
        again = new & self.former.keys()
        self.kept.update((k, self.former[k]) for k in again)
        if new := new - again:
            self.learn(new, check)
        ids = self.kept.__getitem__
        return [list(chain.from_iterable(map(ids, cs))) for cs in cut]

    def cut_up(self, text: str) -> list[str]:
        """The chunks of a normalised text, each as its key: without the blank before it if
        that is the only one, else with one more blank."""
        if self.cut and text[:1] == BLANK and BLANK * 2 not in text:
            return text.split(BLANK)[1:]
        return [c[1:] if c[0] == BLANK != c[1:2] else BLANK + c for c in self.chunks.findall(text)]


@lru_cache(maxsize=2)
def model(model_file: str) -> MergeModel:
    return MergeModel(model_file)


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _batches(model_file: str, check: bool, digests: bool):
    def encoded(texts: list[str]) -> list[pa.Array]:
        m = model(model_file)
        ids = [x + [m.end] for x in m.encode(texts, check)]
        back = [m.lib.decode(x) for x in ids]
        if not digests:
            return [pa.array(ids, pa.list_(pa.int32())), pa.array(back)]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(" ".join([m.decimal[i] for i in x])) for x in ids]),
                pa.array([sha(x) for x in back])]

    def run(batches):
        names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            i = 0
            while i < len(texts):
                j, chars = i + 1, len(texts[i])
                while j < len(texts) and chars + len(texts[j]) <= PIECE_CHARS:
                    chars += len(texts[j])
                    j += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *encoded(texts[i:j])], names=["row", *names])
                i = j
    return run


def encode_rows(docs: DataFrame, carry: list[str], text_col: str = "text", model_file: str | None = None,
                check: bool = True, digests: bool = False) -> DataFrame:
    """Columns ``carry``, then ids (with the end id) and decoded; with ``digests``
    n_tokens, ids_sha256 (of the decimal ids, a blank between) and decoded_sha256 instead."""
    rows = docs.select(F.struct(*(F.col(c) for c in carry)).alias("row"), whole(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    out = rows.mapInArrow(_batches(model_file or default_model(), check, digests), f"row {kind}, {made}")
    return out.select("row.*", *[f.name for f in out.schema.fields[1:]])
