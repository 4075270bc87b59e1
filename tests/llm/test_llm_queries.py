"""The registered queries against their SQL, and the pipeline against a brute-force version."""

from __future__ import annotations

import sys

import pytest

import corpus_pipeline
from claimlens.llm.queries import ORACLES, QUERIES
from conftest import SF_SMALL
from oracle_harness import compare, duck


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, key):
    res = compare(spark, duck(SF_SMALL), key, QUERIES[key], ORACLES[key], SF_SMALL)
    assert res["status"] == "ok" and "types" not in res, res


def test_each_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13 and "pipeline" in QUERIES


def test_pipeline_against_brute_force(spark):
    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_llm_cases import components_brute, sha

    from claimlens.llm import quality, sentencepiece_bpe
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    last = {}
    for i, t in rows:
        last[t] = max(i, last.get(t, i))
    rows = [(i, t) for i, t in rows if last[t] == i]
    alone = {i for i, _, _, k in components_brute(rows) if k}
    m = sentencepiece_bpe.model(sentencepiece_bpe.default_model())
    want = {(i, sha(" ".join(map(str, m.lib.encode(t) + [2])))) for i, t in rows if i in alone}
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {(r.doc_id, r.ids_sha256) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("sources", [1, 7, 20, 21, 23, 60])
def test_mixing_matches_its_sql_with_any_number_of_sources(spark, tmp_path, sources):
    """One rule for the weights, whatever the number of sources; null and repeated ids and a null source."""
    rows = [(None if k % 11 == 0 else k // 2, None if k % sources == 5 else f"s{(k * k) % sources}") for k in range(900)]
    spark.createDataFrame(rows, "doc_id long, source string").coalesce(1).write.parquet(str(tmp_path / "made"))
    made = next((tmp_path / "made").glob("part-*.parquet"))
    (tmp_path / "documents.parquet").write_bytes(made.read_bytes())
    res = compare(spark, duck(str(tmp_path)), "op10", QUERIES["op10_pfair_mixing"], ORACLES["op10_pfair_mixing"], str(tmp_path))
    assert res["status"] == "ok" and res["rows"] == 900, res
