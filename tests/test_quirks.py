"""Hand-written rows for the semantics the test tables cannot show (nulls,
ties, empty snippets, zero denominators, file picks)."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimlens.operators import examples as EX
from claimlens.operators import metrics as MX
from claimlens.operators import normalise as NZ
from claimlens.operators.attention import attention_levels
from claimlens.operators.match import match_ranked_evidence, match_ranked_evidence_exploded
from claimlens.sources import files as IO

ROWS = "id_left long, id_right long, cred_label string, claim_text string, claim_source string, " \
       "evidence string, evidence_source string, row_pos long"


def test_null_keys_dropped_null_label_kept(spark):
    rows = spark.createDataFrame([
        (1, 10, "True", "c1", "s", "e1", "a", 1),
        (1, 11, "True", "c1", "s", "e2", "b", 2),
        (2, 20, None, "c2", "s", "e3", "a", 3),          # null label -> 'nan', kept (Q2)
        (None, 30, "True", "c3", "s", "e4", "a", 4),     # null id -> dropped (Q1)
        (4, 40, "False", None, "s", "e5", "a", 5),       # null text -> dropped (Q1)
    ], ROWS)
    ex = EX.group_claim_examples(rows).orderBy("claim_id").collect()
    assert [r.claim_id for r in ex] == [1, 2]
    assert ex[1].cred_label == "nan"
    assert [e.evidence for e in ex[0].evidences] == ["e1", "e2"]
    assert EX.dropped_rows(rows).first()[0] == 2
    w = {r.label: (r.n, r.weight) for r in EX.class_weights(EX.group_claim_examples(rows)).collect()}
    assert w[1] == (1, 0.5) and w[0] == (1, 0.5)      # 'nan' is class 0 (Q2, Q3)


def test_label_int_exact_true_only(spark):
    df = spark.createDataFrame([("True",), ("true",), ("TRUE",), (None,), ("False",)], "l string")
    assert [r[0] for r in df.select(NZ.label_int(F.col("l"))).collect()] == [1, 0, 0, 0, 0]
    assert [r[0] for r in df.select(NZ.label_int(F.col("l"), "true")).collect()] == [0, 1, 0, 0, 0]


def test_average_rank_ties_truncated(spark):
    # pandas: texts [b, b, a, c, c, c] -> ranks [2.5, 2.5, 1, 5, 5, 5] -> int [2, 2, 1, 5, 5, 5]
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate("bbaccc")], "i int, k string, evidence string")
    got = {r.i: r.rank for r in NZ.evidence_rank(df, ["k"]).collect()}
    assert [got[i] for i in range(6)] == [2, 2, 1, 5, 5, 5]
    win = {r.i: r.rank for r in NZ.evidence_rank_window(df, ["k"]).collect()}
    assert win == got


def test_first_match_in_list_order_and_empty_snippet(spark):
    rows = spark.createDataFrame([
        (1, 10, "True", "c", "s", "alpha beta gamma", "a", 1),
        (2, 20, "True", "c", "s", "nothing here", "a", 2),
        (3, 30, "True", "c", "s", "zzz", "a", 3),
        (9, 90, "True", "c", "s", "no list", "a", 4),
    ], ROWS)
    lists = spark.createDataFrame([
        ("1", [("gamma", 0.1), ("alpha", 0.9)]),          # list order wins over best score
        ("2", [("xyz", 0.5)]),
        ("3", [("", 0.7)]),                               # empty snippet matches everything
    ], "id string, evidences array<struct<snippet:string, score:double>>")
    got = {r.id_right: r.correlation for r in match_ranked_evidence(rows, lists).collect()}
    assert got == {10: 0.1, 20: -1.0, 30: 0.7, 90: -1.0}
    ex = IO.explode_ranked(lists)
    got2 = {r.id_right: r.correlation for r in match_ranked_evidence_exploded(rows, ex).collect()}
    assert got2 == got
    with pytest.raises(KeyError):
        match_ranked_evidence(rows, lists, strict=True)


def test_pick_files_regex_prefix(spark, tmp_path):
    for name in ["train_0.tsv", "train_1.tsv", "test_0_ori.tsv", "xtrain_0.tsv"]:
        (tmp_path / name).write_text("id_left\n1\n")
    picked = [p.rsplit("/", 1)[-1] for p in IO.pick_files(spark, str(tmp_path), r"train_.\.tsv")]
    assert picked == ["train_0.tsv", "train_1.tsv"]          # prefix match, '.' is a wildcard
    with pytest.raises(FileNotFoundError):
        IO.pick_files(spark, str(tmp_path), r"dev_ori")


def test_na_tokens(spark):
    df = spark.createDataFrame([(t,) for t in IO.NA_TOKENS + ["ok", "N/A "]], "v string")
    vals = [r.v for r in IO.na_normalise(df).collect()]
    assert vals[: len(IO.NA_TOKENS)] == [None] * len(IO.NA_TOKENS)
    assert vals[-2:] == ["ok", "N/A "]


def test_ranked_json_mixed_pairs_topk_and_last_line_wins(spark, tmp_path):
    p = tmp_path / "ranked.json"
    p.write_text('{"id": "1", "evidences": [["a", 0.5], ["b", 2]]}\n'
                 '{"id": "2", "evidences": [["c", 1.5]]}\n'
                 '{"id": "1", "evidences": [["d", 0.25], ["e", 1], ["f", 3]]}\n')
    lists = IO.read_ranked_evidence(spark, str(p), topk=2)
    got = {r.id: [(e.snippet, e.score) for e in r.evidences] for r in lists.collect()}
    assert got == {"1": [("d", 0.25), ("e", 1.0)], "2": [("c", 1.5)]}


def test_zero_denominators_and_micro_equals_accuracy(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 0, 1), (1, 1, 0), (1, 0, 1), (1, 1, 1), (2, 1, 1)],
                               "g int, prediction int, label int")
    prf = {r.g: r for r in MX.prf_from_counts(MX.confusion_counts(df, ["g"])).collect()}
    assert prf[0].precision_1 == 0.0 and prf[0].f1_1 == 0.0 and prf[0].recall_1 == 0.0
    acc = {r.g: r.accuracy for r in MX.accuracy(df, ["g"]).collect()}
    for g, r in prf.items():
        assert abs(r.f1_micro - acc[g]) < 1e-12                   # Q21


def test_auc_matches_brute_force_and_evaluator(spark):
    import random
    rnd = random.Random(7)
    rows = [(0, round(rnd.uniform(-2, 2), 1), rnd.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g int, score double, label int")
    auc = MX.roc_auc(df, ["g"]).first().auc
    pos = [s for _, s, y in rows if y == 1]
    neg = [s for _, s, y in rows if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(auc - brute) < 1e-12
    one = spark.createDataFrame([(0, 0.3, 1), (0, 0.4, 1)], "g int, score double, label int")
    assert MX.roc_auc(one, ["g"]).first().auc is None


def test_constant_attention_row_gets_level_zero(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.2), (2, 0, 0.1), (2, 1, 0.9), (2, 2, 0.5)],
                               "k int, t int, w double")
    got = {(r.k, r.t): r.level for r in attention_levels(df, ["k"], "w", 6).collect()}
    assert got[(1, 0)] == 0 and got[(1, 1)] == 0
    assert got[(2, 0)] == 0 and got[(2, 1)] == 5 and got[(2, 2)] == 2


def test_confusion_matrix_all_cells(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "label int, prediction int")
    cm = {r.label: (r.pred_0, r.pred_1) for r in MX.confusion_matrix(df).collect()}
    assert cm == {0: (0, 0), 1: (0, 2)}



def test_short_passages_exact(spark):
    from claimlens.operators.match import match_passages
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "xbeta ga"), (3, "nothing")],
                                 "doc_id long, text string")
    ps = spark.createDataFrame([(10, "beta ga"), (11, "ta g"), (12, ""), (13, "a"),
                                (14, "alpha beta gamma"), (15, "ha be")], "item_id long, text string")
    a = sorted(tuple(r) for r in match_passages(docs, ps, strategy="anchor").collect())
    b = sorted(tuple(r) for r in match_passages(docs, ps, strategy="broadcast").collect())
    assert a == b and (12, 3) in a and (11, 2) in a


def test_write_examples_keeps_existing_result(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, "True", "c1", "s", "e1", "a", 1)], ROWS)
    path = str(tmp_path / "examples" / "dataset=x" / "fold=0")
    IO.write_claim_examples(EX.group_claim_examples(rows), path)
    other = spark.createDataFrame([(2, 20, "False", "c2", "t", "e2", "b", 2)], ROWS)
    IO.write_claim_examples(EX.group_claim_examples(other), path)      # Q9: ignored, not replaced
    back = IO.read_claim_examples(spark, path).collect()
    assert [(r.claim_id, r.claim) for r in back] == [(1, "c1")]


def test_trim_tail_only_when_remainder_is_one(spark):
    from claimlens.operators.order import trim_tail
    df33 = spark.range(33).withColumnRenamed("id", "k")
    df34 = spark.range(34).withColumnRenamed("id", "k")
    assert trim_tail(df33, ["k"], only_if_mod=32).count() == 32    # 33 % 32 == 1 -> last row dropped
    assert trim_tail(df34, ["k"], only_if_mod=32).count() == 34
    assert sorted(r.k for r in trim_tail(df34, ["k"]).collect()) == list(range(33))


def test_j1_forms_agree_when_ids_repeat_or_are_null(spark):
    from claimlens.operators import match as M
    rows = spark.createDataFrame([(1, 10, "True", "c", "s", "alpha beta", "a", 1), (1, 10, "True", "c", "s", "nothing", "a", 2),
                                  (1, None, "True", "c", "s", "only beta", "a", 3), (1, None, "True", "c", "s", "only beta", "b", 4),
                                  (2, 20, "True", "c", "s", "alpha", "a", 5)], ROWS)
    lists = spark.createDataFrame([("1", [(f"zz{i}", float(i)) for i in range(40)] + [("beta", 7.5), ("alpha", 9.0)]), ("2", [("q", 1.0)])],
                                  "id string, evidences array<struct<snippet:string, score:double>>")
    want = [(1, 7.5), (2, -1.0), (3, 7.5), (4, 7.5), (5, -1.0)]       # first in list order, not best score
    for got in (M.match_ranked_evidence(rows, lists), M.match_ranked_evidence_exploded(rows, IO.explode_ranked(lists))):
        assert sorted((r.row_pos, r.correlation) for r in got.collect()) == want


def test_tsv_columns_are_bound_by_name(spark, tmp_path):
    head = "line\tevidence\tid_right\tid_left\tcred_label\tclaim_text\tevidence_source\tclaim_source\n"
    (tmp_path / "a.tsv").write_text(head + "0\tsome text\tev_2\t7\tTrue\tclaim\tnan\tsite\n1\tmore\tev_3\tNA\t\tclaim\tx\tsite\n")
    (tmp_path / "b.tsv").write_text("\t".join(IO.EVIDENCE_COLUMNS) + "\n8x\tev_4\tFalse\tc\ts\te\tx\n")
    paths = [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")]
    got = {r.id_right: r for r in IO.read_evidence_tsv(spark, paths).collect()}
    assert got["ev_2"].id_left == 7 and got["ev_2"].evidence == "some text" and got["ev_2"].evidence_source is None
    assert got["ev_3"].id_left is None and got["ev_3"].cred_label is None and got["ev_4"].id_left is None
    assert [tuple(r) for r in IO.bad_cells(spark, paths).collect()] == [("id_left", "8x", 1)]
    (tmp_path / "c.tsv").write_text("id_left\tevidence\n1\tx\n")
    with pytest.raises(ValueError):
        IO.read_evidence_tsv(spark, str(tmp_path / "c.tsv"))


def test_each_file_of_a_folder_has_its_own_header(spark, tmp_path):
    names = IO.EVIDENCE_COLUMNS
    rows = {}
    for folder in ("one [x]", "two"):
        for k, lead in enumerate(([], ["line"])):
            cells = [str(k), f"{folder}{k}", "True", "a\nclaim", "s", "e", "x"]
            cols = lead + names[::-1 if k else 1]
            line = ["0"] * len(lead) + ['"a\nclaim"' if c == "a\nclaim" else c for c in (cells[::-1] if k else cells)]
            path = tmp_path / folder / ("deep" if k else "") / f"part-{k}.tsv"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text("\n" * k + "\t".join(cols) + "\n" + "\t".join(line) + "\n")
            rows[f"{folder}{k}"] = (k, f"{folder}{k}", "True", "a\nclaim", "s", "e", "x")
        (tmp_path / folder / "_SUCCESS").write_text("no data")
        (tmp_path / folder / "empty.tsv").write_text("")
    paths = [str(tmp_path / "two"), str(tmp_path / "one [x]")]
    got = IO.read_evidence_tsv(spark, paths, with_order=True).orderBy("file_order").collect()
    assert {r.id_right: tuple(r)[:7] for r in got} == rows
    assert [r.id_right for r in got] == ["two1", "two0", "one [x]1", "one [x]0"]  # deep/part-1 sorts before part-0
    assert [r.file_order.file for r in got] == [0, 0, 1, 1]


def test_ranked_evidence_is_written_as_it_is_read(spark, tmp_path):
    lists = spark.createDataFrame([("1", [('a "quoted" \\ line\nbreak', 0.5), ("b", 2.0)]), ("x2", [])],
                                  "id string, evidences array<struct<snippet:string, score:double>>")
    IO.write_ranked_evidence(lists, str(tmp_path / "r"))
    back = {r.id: [tuple(e) for e in r.evidences] for r in IO.read_ranked_evidence(spark, str(tmp_path / "r")).collect()}
    assert back == {"1": [('a "quoted" \\ line\nbreak', 0.5), ("b", 2.0)], "x2": []}
    import json
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert all(isinstance(s, float) for x in lines for _, s in x["evidences"])


def test_repeated_requests(spark):
    from claimlens.operators.predict import predict_requests
    df = spark.createDataFrame([(1, "{}"), (1, "[]")], "req_id long, value string")
    with pytest.raises(ValueError):
        predict_requests(df, None, None, None)


def test_offsets_for_many_partitions_plan_fast(spark):
    import time

    from claimlens.operators.order import _with_offsets
    t = time.time()
    rows = _with_offsets(spark.range(10), {"_off": list(range(100_000))}).collect()
    assert len(rows) == 10 and time.time() - t < 10


def test_encoder_is_kept_by_name_and_texts_by_digest(spark):
    import numpy as np

    from claimlens.operators.encode import encode_texts
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, "c")], "k int, t string")
    got = encode_texts(df, "t", ["k"], lambda: lambda ts: [np.full((len(t), 2), len(t)) for t in ts], 2, "letters-1")
    assert sorted((r.k, r.tok_pos, tuple(r.vec)) for r in got.collect()) == [
        (1, 0, (2.0, 2.0)), (1, 1, (2.0, 2.0)), (2, 0, (2.0, 2.0)), (2, 1, (2.0, 2.0)), (4, 0, (1.0, 1.0))]


def test_j1_then_a1_may_split_a_hot_claim(spark):
    """The grouping needs an exchange of its own, so AQE may split the join before it."""
    rows = spark.createDataFrame([(1, 10, "True", "c1", "s", "e1", "a", 1)], ROWS)
    lists = spark.createDataFrame([("1", [("e", 1.0)])], "id string, evidences array<struct<snippet:string, score:double>>")
    from claimlens.operators.match import match_ranked_evidence
    joined = match_ranked_evidence(rows, lists.hint("merge"))
    plan = EX.group_claim_examples(joined)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("SortMergeJoin")]
    assert "hashpartitioning(cred_label" in above


def test_broadcast_only_behind_size_check(spark):
    from claimlens.operators.common import estimated_bytes, maybe_broadcast
    small = spark.range(10)
    assert estimated_bytes(small) is not None
    plan_small = small.join(maybe_broadcast(spark.range(5)), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan_small.lower()
    big = spark.range(10)
    plan_big = big.join(maybe_broadcast(spark.range(5), limit=1), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan_big.lower()
