"""Runs of words against a search of every period, by itself and through the registered query."""

from __future__ import annotations

import random
import re
import time
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest

from claimlens.llm import periodic_runs
from claimlens.llm.queries import QUERIES
from conftest import SF_SMALL
from test_llm_cases import SCHEMA, WORD, sha, texts



def runs_brute(ws: list) -> list[tuple[int, int, int]]:
    """Every maximal stretch of every period, without those that have a smaller one."""
    found = set()
    for q in range(1, len(ws) // 4 + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q):
                part = ws[i:i + size]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    found.add((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_brute(ws: list, runs: list) -> str:
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(ws) if k not in gone)


def row_brute(doc_id, text) -> tuple:
    ws = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and ws:
        g, n = h // 10, len(ws)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]
    runs = runs_brute(ws)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    text = " ".join(ws) if not runs else collapsed_brute(ws, runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(text))


def found_in(texts: list[str]) -> tuple[list, list]:
    runs, collapsed = periodic_runs.runs_in(pa.array(texts, pa.large_string()))
    return [[tuple(r[k] for k in ("start", "length", "period")) for r in x] for x in runs.to_pylist()], collapsed.to_pylist()


def test_small_alphabets_against_every_period():
    rng = random.Random(7)
    for _ in range(200):
        rows = []
        for _ in range(rng.randint(1, 10)):
            n, letters = rng.choice([0, 1, 5, 6, 7, 30, 120]), "abcdefgh"[:rng.choice([1, 2, 3, 8])]
            ws = [rng.choice(letters) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n > 3 else 0):
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 3))
                ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]
            rows.append(ws)
        runs, collapsed = found_in([rng.choice([" ".join(w), " \n" + "\t \r".join(w) + "\x0b "]) for w in rows])
        for ws, got, text in zip(rows, runs, collapsed):
            assert got == runs_brute(ws)
            assert text == collapsed_brute(ws, got)


@pytest.mark.parametrize("text, want", [
    ("a b a b a b a b", [(0, 8, 2)]), ("a b a b a b a", []), ("a a a a a", []), ("a a a a a a", [(0, 6, 1)]),
    ("x a a a a a a y a a a a a a z", [(1, 6, 1), (8, 6, 1)]),
    ("a a b a a b a a b a a b a", [(0, 13, 3)]),
    ("a\x1cb " * 6, [(0, 6, 1)]),  # only blank, tab, line feed, vertical tab, form feed and carriage return part words
    ("a\xa0b " * 3 + "a b " * 3, []), ("a b " * 6, [(0, 12, 2)]),
])
def test_hand_worked(text, want):
    assert found_in([text])[0] == [want]


def test_runs_do_not_cross_texts():
    assert found_in(["a a a", "a a a", "a a a a a a"])[0] == [[], [], [(0, 6, 1)]]


def test_long_texts_take_about_linear_time():
    """One period, a long period, and a sequence without any run, of 300,000 words each."""
    n = 300_000
    begin = time.perf_counter()
    runs, collapsed = found_in(["a " * n, " ".join(f"w{i % (n // 5)}" for i in range(n)), " ".join("xy"[i.bit_count() % 2] for i in range(n))])
    assert runs == [[(0, n, 1)], [(0, n, n // 5)], []]
    assert [len(c.split()) for c in collapsed] == [1, n // 5, n]
    assert time.perf_counter() - begin < 60


def test_odd_rows_against_brute_force(spark):
    extra = (1, "r", "i", "k", 0.5, 3, b"s", True, "no")
    rows = [*texts(), (30, "z " * 50, "en", "a"), (30, "z " * 50, "en", "a"), (31, "a b " * 9 + "c", "en", "a"), *(
        (i, " ".join(f"w{k}" for k in range(i % 90)), "en", "a") for i in range(100, 200))]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in periodic_runs.run_digests(docs).collect()), key=repr)
    assert got == sorted((row_brute(r[0], r[1]) for r in rows), key=repr)
    assert periodic_runs.run_digests(docs.limit(0)).collect() == []


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF_SMALL).collect())
    short = {r.doc_id: row_brute(r.doc_id, r.text) for r in docs if len(re.findall(WORD, r.text or "")) < 1500}
    assert len(got) == len(docs) and len(short) > 100
    assert [r for r in got if r[0] in short] == sorted(short.values())
    assert sum(r[1] for r in got) > 10
