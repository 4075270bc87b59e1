"""Time and memory: expressions linear in an array's components, kernels on pieces of batches, one sort for windows."""

from __future__ import annotations

import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimlens.functions import arrays as AR
from claimlens.functions import dense as D
from claimlens.operators.attention import attention_levels, softmax_weights
from claimlens.operators.common import pieces
from claimlens.operators.match import shingle_rows
from claimlens.operators.params import fixture_params
from claimlens.operators.predict import request_tokens, score_requests
from claimlens.operators.scoring import pair_slots, project_texts
from claimlens.plans.serving import SERVE_PARAMS


def test_array_functions_take_time_in_proportion_to_the_components(spark):
    """F11 and F9 as expressions, against the kernels; mean, deviation, maximum and sum once a row, not once a component."""
    n = 400
    x = np.random.default_rng(5).normal(size=(40, n))
    g, b = np.linspace(0.5, 2, n), np.linspace(-1, 1, n)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(40, []), (41, None)], "i int, v array<double>")
    lit = lambda a: F.array(*[F.lit(float(k)) for k in a])
    begin = time.perf_counter()
    got = df.select("i", AR.layer_norm(F.col("v"), lit(g), lit(b)).alias("z"), AR.softmax(F.col("v")).alias("s"),
                    AR.log_softmax(F.col("v")).alias("l")).orderBy("i").collect()
    assert time.perf_counter() - begin < 20
    np.testing.assert_allclose([r.z for r in got[:40]], D.layer_norm(x, g, b), rtol=1e-9, atol=1e-9)
    soft = np.array([D.softmax(v) for v in x])
    np.testing.assert_allclose([r.s for r in got[:40]], soft, rtol=1e-9)
    np.testing.assert_allclose([r.l for r in got[:40]], np.log(soft), rtol=1e-9)
    assert got[40].s == got[40].l == [] and got[41].z is got[41].s is got[41].l is None


def _kernel(monkeypatch, df, make):
    """The function that ``make`` gives to ``mapInArrow``."""
    got = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema, real=type(df).mapInArrow: got.append(f) or real(self, f, schema))
    make()
    monkeypatch.undo()
    return got[0]


def _peak_mb(run, batch) -> float:
    """MB that NumPy takes at most while ``run`` works off the batch."""
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_pieces_are_the_batch():
    size = np.array([3, 0, 9, 1, 1, 5, 0, 0, 6])
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(size))), "v": [list(range(n)) for n in size]})
    got = list(pieces(batch, size, 6))
    assert pa.Table.from_batches(got).to_pydict() == batch.to_pydict()
    assert [p.column("k").to_pylist() for p in got] == [[0, 1], [2], [3, 4], [5, 6, 7], [8]]
    assert list(pieces(batch.slice(0, 0), size[:0], 6)) == []


def test_shingle_kernel_memory_does_not_grow_with_the_batch(spark, monkeypatch):
    df = spark.createDataFrame([(1, [1])], "doc_id long, hashes array<long>")
    run = _kernel(monkeypatch, df, lambda: shingle_rows(df, "doc_id", [5]))
    n, each = 5000, 300
    values = np.random.default_rng(1).integers(-2**62, 2**62, n * each)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.ListArray.from_arrays(np.arange(0, n * each + 1, each, dtype=np.int32), values)],
                                       names=["doc_id", "hashes"])
    assert sum(len(b) for b in run(iter([batch]))) == n * (each - 4)
    assert _peak_mb(run, batch) < 20


def test_windowed_weights_and_levels(spark):
    """No join and one exchange for W3 and W5; rows with a null key are left out."""
    rows = [(c, e, t, float((c * 7 + e * 3 + t * t) % 5)) for c in range(4) for e in range(3) for t in range(6)]
    df = spark.createDataFrame([*rows, (1, 0, 0, rows[0][3]), (None, 0, 0, 9.0), (2, None, 0, 9.0)], "c long, e int, t int, a double").repartition(3)
    out = attention_levels(softmax_weights(df, ["c", "e"], "a"), ["c", "e"], "weight")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(c") == 1
    groups = {}
    for r in [*rows, (1, 0, 0, rows[0][3])]:
        groups.setdefault(r[:2], []).append(r)
    want = []
    for g in groups.values():
        w = np.exp([r[3] for r in g])
        w = w / w.sum()
        span = w.max() - w.min()
        want += [(*r, round(x, 9), int((x - w.min()) / span * 0.99 * 6)) for r, x in zip(g, w)]
    assert sorted((r.c, r.e, r.t, r.a, round(r.weight, 9), r.level) for r in out.collect()) == sorted(want)


def _lists(lens, values):
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(lens)).astype(np.int32), values)


def test_scoring_kernels_memory_does_not_grow_with_the_batch(spark, monkeypatch):
    p = fixture_params(**SERVE_PARAMS)
    n, each, rng = 8000, 60, np.random.default_rng(2)
    toks = _lists([each] * n, pa.array(np.tile(np.arange(each, dtype=np.int32), n)))
    texts = spark.createDataFrame([(1, 0, [0], [0.0] * p.emb_dim)], "claim_id long, evi_pos int, toks array<int>, vals array<double>")
    run = _kernel(monkeypatch, texts, lambda: project_texts(texts, p))
    vals = rng.normal(size=n * each * p.emb_dim)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.arange(n, dtype=np.int32) % 3 - 1), toks,
                                        _lists([each * p.emb_dim] * n, vals)], names=["claim_id", "evi_pos", "toks", "vals"])
    assert sum(len(b) for b in run(iter([batch]))) == n and _peak_mb(run, batch) < 80

    sides = spark.createDataFrame([(1, 0, [0], [0.0] * p.hidden_dim)], "claim_id long, evi_pos int, toks array<int>, h array<double>")
    run = _kernel(monkeypatch, sides, lambda: pair_slots(sides, sides, p))
    h = _lists([each * p.hidden_dim] * n, vals[:n * each * p.hidden_dim])
    batch = pa.RecordBatch.from_arrays([*batch.columns[:3], h, toks, h], names=["claim_id", "evi_pos", "toks", "h", "ctoks", "ch"])
    assert sum(len(b) for b in run(iter([batch]))) == n and _peak_mb(run, batch) < 60


def test_one_long_request_does_not_pad_the_others():
    p = fixture_params(**SERVE_PARAMS)
    rng, count = np.random.default_rng(3), np.array([1] * 1999 + [4000])
    owner, one = np.repeat(np.arange(len(count)), count), np.ones(len(count), int)
    claim, evidence = rng.normal(size=(len(count), p.emb_dim)), rng.normal(size=(count.sum(), p.emb_dim))
    cs, es = rng.normal(size=(len(count), p.claim_src_dim)), rng.normal(size=(count.sum(), p.evidence_src_dim))
    row0 = rng.normal(size=p.evidence_src_dim)
    args = lambda k: (claim[k], one[k], evidence[np.isin(owner, k)], np.ones(count[k].sum(), int),
                      np.repeat(np.arange(len(k)), count[k]), cs[k], es[np.isin(owner, k)], row0, p)
    tracemalloc.start()
    got = score_requests(*args(np.arange(len(count))))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 40
    for k in (0, 7, 1998, 1999):
        np.testing.assert_allclose(score_requests(*args(np.array([k]))), got[[k]], rtol=1e-9)


def test_tokens_of_requests():
    claim = pa.array([[0.0] * 2, None, [0.0] * 3])
    evidences = pa.array([[[0.0], [0.0] * 4], None, []], pa.list_(pa.list_(pa.float64())))
    batch = pa.RecordBatch.from_arrays([claim, evidences], names=["claim", "evidences"])
    assert request_tokens(batch).tolist() == [2 * 3 + 5, 0, 3] and request_tokens(batch.slice(1)).tolist() == [0, 3]
