"""Vocabulary and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import fixtures as FX
from claimlens.functions import arrays as AR
from claimlens.functions.text import token_count, tokenize
from claimlens.operators import vocab as VB
from claimlens.plans.ingest import MATCHED_SQL, claim_examples
from claimlens.plans.oracle_views import with_views
from claimlens.plans.registry import register, scratch
from claimlens.sources import files as IO

EX_CTE = ("ex", """
SELECT cred_label, id_left, claim_text, claim_source,
       row_number() OVER (ORDER BY cred_label, id_left, claim_text, claim_source) AS ex_pos
FROM (SELECT DISTINCT cred_label, id_left, claim_text, claim_source FROM f_rows)""")
EV_CTE = ("ev", """
SELECT r.id_left, r.row_pos, r.evidence_source, r.correlation, e.ex_pos,
       row_number() OVER (PARTITION BY r.cred_label, r.id_left, r.claim_text, r.claim_source
                          ORDER BY r.row_pos) - 1 AS evi_pos,
       count(*) OVER (PARTITION BY r.cred_label, r.id_left, r.claim_text, r.claim_source) AS n
FROM matched r JOIN ex e USING (cred_label, id_left, claim_text, claim_source)""")
VOCAB_C = ("vocab_c", """
SELECT 'claim' AS kind, claim_source AS value,
       CAST(row_number() OVER (ORDER BY min(ex_pos)) AS INTEGER) AS idx
FROM ex {where} GROUP BY claim_source""")
VOCAB_E = ("vocab_e", """
SELECT 'evidence' AS kind, evidence_source AS value,
       CAST(row_number() OVER (ORDER BY min(ex_pos * 1000000 + evi_pos)) AS INTEGER) AS idx
FROM ev {where} GROUP BY evidence_source""")


def _ctes(train_filter: str = ""):
    w_ex = f"WHERE {train_filter}" if train_filter else ""
    return [("matched", MATCHED_SQL), EX_CTE, EV_CTE,
            (VOCAB_C[0], VOCAB_C[1].format(where=w_ex)),
            (VOCAB_E[0], VOCAB_E[1].format(where=w_ex))]


def _views(sql, train_filter=""):
    return with_views(sql, "f_rows", "f_ranked", ctes=_ctes(train_filter))


def vocab_all(spark, sf_dir):
    return VB.vocabularies(claim_examples(spark, sf_dir))


TRAIN = "id_left % 4 = 0"


def train_vocab(spark, sf_dir):
    ex = claim_examples(spark, sf_dir)
    return VB.vocabularies(ex.where(F.col("claim_id") % 4 == 0))


@register("vocab_claim_source", _views("SELECT * FROM vocab_c"))
def q_vocab_claim(spark, sf_dir):
    return VB.vocab_claim_source(claim_examples(spark, sf_dir))


@register("vocab_evidence_source", _views("SELECT * FROM vocab_e"))
def q_vocab_evidence(spark, sf_dir):
    return VB.vocab_evidence_source(claim_examples(spark, sf_dir))


@register("vocab_size", _views("""
SELECT kind, count(*) + 1 AS size FROM (SELECT * FROM vocab_c UNION ALL SELECT * FROM vocab_e)
GROUP BY kind"""))
def q_vocab_size(spark, sf_dir):
    return VB.vocab_size(vocab_all(spark, sf_dir))


@register("vocab_roundtrip", _views("SELECT * FROM vocab_c UNION ALL SELECT * FROM vocab_e"))
def q_vocab_roundtrip(spark, sf_dir):
    path = scratch(spark, "vocab")
    IO.write_vocab(vocab_all(spark, sf_dir), path)
    return IO.read_vocab(spark, path)


@register("encode_claim_source", _views("""
SELECT e.id_left AS claim_id, CAST(coalesce(v.idx, 0) AS INTEGER) AS claim_src_idx
FROM ex e LEFT JOIN vocab_c v ON v.value = e.claim_source""", TRAIN))
def q_encode_claim(spark, sf_dir):
    ex = claim_examples(spark, sf_dir)
    enc = VB.encode_claim_source(ex, train_vocab(spark, sf_dir))
    return enc.select("claim_id", "claim_src_idx")


@register("encode_evidence_source", _views("""
SELECT id_left AS claim_id,
       string_agg(CAST(coalesce(v.idx, 0) AS VARCHAR), ',' ORDER BY row_pos) AS evidence_src_idx
FROM ev LEFT JOIN vocab_e v ON v.value = ev.evidence_source GROUP BY id_left""", TRAIN))
def q_encode_evidence(spark, sf_dir):
    ex = claim_examples(spark, sf_dir)
    enc = VB.encode_evidence_source(ex, train_vocab(spark, sf_dir))
    return enc.select("claim_id", F.array_join(F.col("evidence_src_idx").cast("array<string>"), ",")
                      .alias("evidence_src_idx"))


PAD_SQL = """
SELECT id_left AS claim_id,
       string_agg(CASE WHEN p < n THEN CAST(CAST(round(c * 1e6) AS BIGINT) AS VARCHAR)
                       ELSE '-1000000' END, ',' ORDER BY p) AS correlation,
       string_agg(CASE WHEN p < n THEN CAST(i AS VARCHAR) ELSE '0' END, ',' ORDER BY p) AS source_idx
FROM (
  SELECT a.id_left, a.n, a.p, b.correlation AS c, coalesce(v.idx, 0) AS i FROM
    (SELECT id_left, n, unnest(range(greatest(5, n))) AS p
     FROM (SELECT id_left, count(*) AS n FROM ev GROUP BY id_left)) a
    LEFT JOIN ev b ON b.id_left = a.id_left AND b.evi_pos = a.p
    LEFT JOIN vocab_e v ON v.value = b.evidence_source)
GROUP BY id_left"""


@register("pad_arrays", _views(PAD_SQL))
def q_pad(spark, sf_dir):
    ex = VB.encode_evidence_source(claim_examples(spark, sf_dir), vocab_all(spark, sf_dir))
    n = F.size("evidences")
    length = F.greatest(F.lit(5), n)
    corr = AR.pad(F.transform("evidences", lambda e: e["correlation"]), length, -1.0)
    idx = AR.pad(F.col("evidence_src_idx"), length, 0)
    micro = F.transform(corr, lambda c: F.round(c * 1e6).cast("bigint").cast("string"))
    return ex.select("claim_id", F.array_join(micro, ",").alias("correlation"),
                     F.array_join(idx.cast("array<string>"), ",").alias("source_idx"))


@register("masks", _views("""
SELECT id_left AS claim_id,
       string_agg(CASE WHEN p < n THEN '1' ELSE '0' END, ',' ORDER BY p) AS count_mask
FROM (SELECT id_left, n, unnest(range(greatest(5, n))) AS p
      FROM (SELECT id_left, count(*) AS n FROM ev GROUP BY id_left))
GROUP BY id_left"""))
def q_masks(spark, sf_dir):
    ex = claim_examples(spark, sf_dir)
    n = F.size("evidences")
    m = AR.count_mask(n, F.greatest(F.lit(5), n))
    return ex.select("claim_id", F.array_join(m.cast("array<string>"), ",").alias("count_mask"))


@register("length_mask", with_views("""
SELECT claim_id, evi_pos, tok_pos,
       CAST(len(list_filter(embedding, lambda x: x <> 0)) > 0 AS INTEGER) AS nonzero
FROM f_tokens""", "f_tokens"))
def q_length_mask(spark, sf_dir):
    t = FX.tokens(spark, sf_dir)
    return t.select("claim_id", "evi_pos", "tok_pos", AR.nonzero(F.col("vec")).alias("nonzero"))


TOKENS_SQL = r"""list_filter(regexp_split_to_array({t}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"""


@register("tokenize", """
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5,
       CAST(len(raw) AS INTEGER) AS n_raw
FROM (SELECT doc_id, """ + TOKENS_SQL.format(t="lower(text)") + """ AS toks,
             """ + TOKENS_SQL.format(t="text") + """ AS raw FROM documents)""")
def q_tokenize(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents")
    toks = tokenize(F.col("text"))
    return d.select("doc_id", F.size(toks).alias("n_tokens"),
                    F.md5(F.array_join(toks, " ")).alias("tokens_md5"),
                    token_count(F.col("text")).alias("n_raw"))
