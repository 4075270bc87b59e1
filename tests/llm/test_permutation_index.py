"""The permutation index against brute force: exactly where all rows are reranked, else by recall."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import permutation_index as pi
from claimlens.llm.queries import QUERIES
from conftest import SF_CHECK

SCHEMA = "vec_id long, embedding array<{}>, label string, q long, rep long, block string, v int"


def brute(rows: dict, queries: list, k: int) -> dict:
    ids = np.array(sorted(rows))
    vectors = np.array([rows[i] for i in ids], float)
    out = {}
    for q in queries:
        score = (vectors * np.array(rows[q], float)).sum(axis=1)
        by = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in by]
    return out


def lists(df) -> dict:
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_footrule_against_its_definition():
    rng = np.random.default_rng(1)
    pivots, vectors = rng.normal(size=(40, 8)), rng.normal(size=(30, 8))
    order = pi.orders(vectors, pivots, 12)
    assert (order == np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :12]).all()
    place = np.full((30, 40), 12)
    for r, o in enumerate(order):
        place[r, o] = np.arange(12)
    offsets, rows, places = pi.inverted(order, 40)
    for q in range(30):
        footrule = np.abs(place - place[q]).sum(axis=1)
        most = 2 * sum(12 - j for j in range(12))
        assert (2 * pi.closeness(order[q], offsets, rows.astype(int), places.astype(int), 30) == most - footrule).all()


def test_pivots_of_alike_vectors_are_few():
    rng = np.random.default_rng(2)
    sample = np.concatenate([np.ones((500, 16)) + 0.001 * rng.normal(size=(500, 16)), rng.normal(size=(100, 16))])
    assert (pi.spread_out(sample, 60).min(axis=1) > 0.9).sum() <= 2
    assert len(pi.spread_out(sample[:5], 60)) == 5


def test_index_of_a_block_is_made_in_pieces():
    """What is held besides the index doesn't grow with the block's rows: 20,000 rows by 512 pivots are 82 MB a matrix."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(20_000, 16)).astype(np.float32)
    pivots = pi.spread_out(vectors[:2000].astype(np.float64), 512)
    tracemalloc.start()
    try:
        order = pi.orders(vectors, pivots, 128)
        lists = pi.inverted(order, 512)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80e6, peak
    near = -(vectors.astype(np.float64) @ pivots.T)
    far = rng.integers(0, 20_000, 200)
    assert (order[far] == np.argsort(near[far], axis=1, kind="stable")[:, :128]).all()
    by = np.argsort(order.ravel(), kind="stable")
    assert (lists[0] == np.searchsorted(order.ravel()[by], np.arange(513))).all()
    assert (lists[1] == by // 128).all() and (lists[2] == by % 128).all()


@pytest.mark.parametrize("share", [0.0, 0.3, 2.0])
def test_spread_lists_count_as_the_lists_do(monkeypatch, share):
    """All lists spread out, some, or none: pivots of the first quarter are in most orders, the others in few."""
    rng = np.random.default_rng(4)
    weight = np.r_[np.full(100, 3.0), np.ones(300)]
    order = np.argsort(-(rng.random((700, 400)) * weight), axis=1)[:, :128].astype(np.uint16)
    lists = pi.inverted(order, 400)
    monkeypatch.setattr(pi, "SPREAD_FROM", share)
    long = pi.spread(*lists, 700, 128)
    assert len(long.near) == int((np.diff(lists[0]) >= max(1, share * 700)).sum())
    place = np.full((700, 400), 128)
    np.put_along_axis(place, order.astype(int), np.arange(128)[None, :], axis=1)
    for q in range(0, 700, 50):
        want = (128 - np.maximum(place, place[q])).sum(axis=1)
        assert (pi.closeness(order[q], *lists, 700, long) == want).all() and (pi.closeness(order[q], *lists, 700) == want).all()


@pytest.mark.parametrize("dtype, size", [("f4", 1.0), ("f4", 1e30), ("f4", 1e-40), ("f8", 1.0), ("f8", 1e200), ("f8", 1e-300)])
def test_reranked_in_own_precision_first(dtype, size):
    """The same rows and scores as by double precision alone, with ties, overflow and underflow."""
    rng = np.random.default_rng(6)
    vectors = (rng.normal(size=(3000, 24)) * size).astype(dtype)
    vectors[100:160] = vectors[7]
    vectors[200:260] = np.nextafter(vectors[7], np.array(9 * size, dtype))  # told apart by the last bits only
    ids, close = rng.permutation(3000), rng.integers(0, 500, 3000)
    close[90:270] = 499
    for q in (7, 100, 230, 1000):
        query = vectors[q].astype(np.float64)
        some = np.flatnonzero(close >= np.sort(close)[-300])
        with np.errstate(all="ignore"):
            score = (vectors[some].astype(np.float64) * query).sum(axis=1)
            got = pi.reranked(query, close, vectors, ids, 21, float(np.abs(vectors).max()))
        by = np.lexsort((ids[some], -score))[:21]
        assert (got[0] == ids[some][by]).all() and np.array_equal(got[1], score[by], equal_nan=True)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_rows_against_brute_force(spark, kind):
    rng = random.Random(5)
    draw = lambda: [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]
    rows = {i: draw() for i in range(-40, 120)}
    alike = draw()
    rows |= {i: alike for i in range(200, 280)}  # copies, more than k + 1 of them
    rows |= {300 + i: [0.0] * i + [1.0] + [0.0] * (7 - i) for i in range(8)}  # ties
    rows[320] = [-x for x in alike]
    inf, nan = float("inf"), float("nan")
    odd = [(400, None), (420, []), (440, [0.0] * 8), (460, [1.0, None] * 4), (480, [inf] + [1.0] * 7), (500, [nan] * 8), (520, [1.0] * 3),
           (None, draw()), (60, [9.0] * 8), (0, rows[0])]  # a second vector of an id, a repeated row
    assert rows[60] < [9.0] * 8
    extra = ("x", 1, 2, "b", 3)
    df = spark.createDataFrame([(i, v, *extra) for i, v in [*rows.items(), *odd]], SCHEMA.format(kind)).repartition(3)
    queries = [i for i in rows if i % 20 == 0]
    got, want = lists(pi.every_twentieth(df)), brute(rows, queries, 20)
    assert got.keys() == want.keys()
    for q in queries:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-14, atol=1e-14)
    assert pi.every_twentieth(df.limit(0)).collect() == []
    few = lists(pi.nearest(df.filter("vec_id in (0, 1, 2, 400)"), F.col("vec_id") == 0, 5))
    assert [i for i, _ in few[0]] == [i for i, _ in brute({i: rows[i] for i in (0, 1, 2)}, [0], 5)[0]]
    assert pi.nearest(df.filter("vec_id = 0"), F.col("vec_id") == 0).collect() == []  # no other row


def test_several_blocks_give_the_same_as_one(spark, monkeypatch):
    rows = {i: list(np.random.default_rng(i).normal(size=6)) for i in range(600)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows.items()], "vec_id long, embedding array<double>")
    monkeypatch.setattr(pi, "BLOCK_ROWS", 150)  # blocks of fewer rows than are reranked: exact
    monkeypatch.setattr(pi, "QUERY_ROWS", 7)
    got, want = lists(pi.every_twentieth(df)), brute(rows, list(range(0, 600, 20)), 20)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_several_rounds_give_the_same_as_one(spark, monkeypatch):
    rows = {i: list(np.random.default_rng(i).normal(size=6)) for i in range(600)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows.items()], "vec_id long, embedding array<double>")
    for name, value in (("BLOCK_ROWS", 150), ("QUERY_ROWS", 4), ("ROUND", 2), ("SAMPLE", 20)):
        monkeypatch.setattr(pi, name, value)
    written, write = [], pi.Stages.write
    monkeypatch.setattr(pi.Stages, "write", lambda self, df, name, *a: written.append(name) or write(self, df, name, *a))
    got, want = lists(pi.every_twentieth(df)), brute(rows, list(range(0, 600, 20)), 20)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert sum(name.startswith("found") for name in written) == 4  # 30 queries, 8 a round


@pytest.mark.parametrize("hot", [False, True])
def test_recall(spark, hot):
    """At least 0.9 of the exact neighbours among 6,000 vectors without structure, or with a third of them alike."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 64))
    if hot:
        x[:2000] = 2 * rng.normal(size=64) + 0.3 * x[:2000]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = lists(pi.every_twentieth(df))
    want = brute(dict(enumerate(x)), list(range(0, 6000, 20)), 20)
    recall = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(recall) >= 0.9 and np.mean(recall[:100]) >= 0.9


def test_query_against_brute_force(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").collect()}
    got, want = lists(QUERIES["op11_permutation_index"](spark, SF_CHECK)), brute(rows, [i for i in rows if i % 20 == 0], 20)
    found = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in want) and sum(found) >= 0.9 * 20 * len(want)
