"""Corpus match, encoder, parameter store, requests and prediction queries
(J2, D1, S8, S9, M9 and the streaming re-aim)."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import fixtures as FX
from claimlens.functions.text import tokenize
from claimlens.operators import vocab as VB
from claimlens.operators.encode import encode_tokens
from claimlens.operators.match import match_passages
from claimlens.operators.params import fixture_params
from claimlens.operators.explain import explain_tokens
from claimlens.operators.predict import predict_requests, request_tables
from claimlens.operators.scoring import pair_slots, sides
from claimlens.operators.source_tables import formula_tables
from claimlens.plans.ingest import claim_examples
from claimlens.plans import scoring_sql as SS
from claimlens.plans.oracle_views import with_views
from claimlens.plans.registry import r6, register, scratch
from claimlens.plans.scoring import micros
from claimlens.sources import files as IO

PASSAGE_SQL = """
SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"""


@register("match_passages", PASSAGE_SQL)
def q_match_passages(spark, sf_dir):
    docs, bench = FX.passages(spark, sf_dir)
    return match_passages(docs, bench)


@register("match_passages_anchor", PASSAGE_SQL)
def q_match_passages_anchor(spark, sf_dir):
    docs, bench = FX.passages(spark, sf_dir)
    return match_passages(docs, bench, strategy="anchor")


ENC_DIM = 16


@register("encode_tokens", """
SELECT conv_id, turn, CAST(tok_pos AS INTEGER) AS tok_pos, token,
       array_to_string(list_transform(range(1, 17), lambda k: CAST(round(sin(k / 1000 * h) * 1e6) AS BIGINT)), ',') AS vec
FROM (SELECT conv_id, turn, tok_pos - 1 AS tok_pos, token,
             ('0x' || substr(md5(token), 1, 8))::BIGINT % 100003 AS h
      FROM (SELECT conv_id, turn, unnest(toks) AS token, generate_subscripts(toks, 1) AS tok_pos
            FROM (SELECT conv_id, turn, list_concat(['[cls]'],
                    list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))
                    AS toks FROM conversations)))""")
def q_encode(spark, sf_dir):
    conv = FX.table(spark, sf_dir, "conversations")
    t = encode_tokens(conv, "text", ["conv_id", "turn"], ENC_DIM)
    return t.select("conv_id", "turn", "tok_pos", "token", micros(F.col("vec")).alias("vec"))


def _params_sql() -> str:
    return with_views("""
SELECT name, count(*) AS n_values, CAST(max(i) + 1 AS INTEGER) AS n_rows, CAST(max(j) + 1 AS INTEGER) AS n_cols,
       round(sum(v), 6) AS total
FROM f_params GROUP BY name""", "f_rows", params=dict(FX.FIXTURE_DIMS, sources=("f_rows", "f_rows")))


@register("params_roundtrip", _params_sql())
def q_params(spark, sf_dir):
    """A parameter table sized by the data (source vocabularies from the
    whole tables), written per (dataset, fold), read back, summarised."""
    p = FX.params_for(spark, sf_dir)
    path = scratch(spark, "params/fixture/fold=0")
    IO.write_params(p, formula_tables(VB.vocabularies(claim_examples(spark, sf_dir)), p), path)
    rows = IO.read_param_rows(spark, path)
    return rows.groupBy("name").agg(
        F.sum(F.size("vec")).alias("n_values"), (F.max("i") + 1).cast("int").alias("n_rows"), F.max(F.size("vec")).alias("n_cols"),
        r6(F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x))).alias("total"))


def request_lines(spark, sf_dir):
    """Fixture JSON requests: one per claim document; every 13th is cut short."""
    ex = claim_examples(spark, sf_dir)
    body = F.to_json(F.struct(
        F.col("claim"), F.col("claim_source"),
        F.transform("evidences", lambda e: F.struct(e["evidence"].alias("evidence"),
                                                    e["evidence_source"].alias("evidence_source")))
        .alias("evidences"), F.col("cred_label")))
    bad = F.col("claim_id") % 13 == 0
    return ex.select(F.col("claim_id").alias("req_id"),
                     F.when(bad, F.substring(body, 1, 25)).otherwise(body).alias("value"))


REQUEST_SQL = """
SELECT req_id, json_valid(value) AS ok,
       CASE WHEN json_valid(value) THEN CAST(json_array_length(value, '$.evidences') AS INTEGER) END
         AS n_evidence
FROM (SELECT id_left AS req_id,
             CASE WHEN id_left % 13 = 0 THEN substr(CAST(body AS VARCHAR), 1, 25)
                  ELSE CAST(body AS VARCHAR) END AS value
      FROM (SELECT id_left,
                   json_object('claim', any_value(claim_text), 'claim_source', any_value(claim_source),
                               'evidences', list(json_object('evidence', evidence,
                                                             'evidence_source', evidence_source)
                                                 ORDER BY row_pos),
                               'cred_label', any_value(cred_label)) AS body
            FROM f_rows GROUP BY id_left))"""


@register("parse_requests", with_views(REQUEST_SQL, "f_rows"))
def q_parse(spark, sf_dir):
    good, rejects = IO.parse_requests(request_lines(spark, sf_dir))
    return good.select("req_id", F.lit(True).alias("ok"), F.size("evidences").alias("n_evidence")) \
        .unionByName(rejects.select("req_id", F.lit(False).alias("ok"), F.lit(None).cast("int").alias("n_evidence")))


# Fixture serving model: 16-dim encoder; source tables of the vocabularies' size (+1 for unseen).
SERVE_PARAMS = dict(model_type=3, emb_dim=ENC_DIM, hidden_dim=8, claim_src_dim=4, evidence_src_dim=4, mlp_hidden=3)


def serving_model(spark, sf_dir):
    """(parameters, vocabularies, source tables)"""
    p, path = fixture_params(**SERVE_PARAMS), scratch(spark, "served")
    IO.write_vocab(VB.vocabularies(claim_examples(spark, sf_dir)), path + "/vocab")
    vocab = IO.read_vocab(spark, path + "/vocab")
    IO.write_params(p, formula_tables(vocab, p), path + "/params")
    return p, vocab, IO.read_params(spark, path + "/params")[1]


TOK_SQL = r"""list_concat(['[cls]'], list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'),
                                               lambda w: w <> ''))"""
SERVE_CTES = [
    ("ex", """SELECT cred_label, id_left, claim_text, claim_source,
                     row_number() OVER (ORDER BY cred_label, id_left, claim_text, claim_source) AS ex_pos
              FROM (SELECT DISTINCT cred_label, id_left, claim_text, claim_source FROM f_rows)"""),
    ("ev", """SELECT r.id_left, r.evidence, r.evidence_source, e.ex_pos,
                     CAST(row_number() OVER (PARTITION BY r.id_left ORDER BY r.row_pos) - 1 AS INTEGER) AS evi_pos
              FROM f_rows r JOIN ex e USING (cred_label, id_left, claim_text, claim_source)"""),
    ("texts", """SELECT id_left AS claim_id, -1 AS evi_pos, claim_text AS text FROM ex WHERE id_left % 13 <> 0
                 UNION ALL
                 SELECT id_left, evi_pos, evidence FROM ev WHERE id_left % 13 <> 0"""),
    ("toks", "SELECT claim_id, evi_pos, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS tok_pos, "
             "unnest(t) AS token FROM (SELECT claim_id, evi_pos, " + TOK_SQL.format(t="text") + " AS t FROM texts)"),
    ("f_tok_dims", f"""SELECT claim_id, evi_pos, tok_pos, CAST(d.i AS INTEGER) AS dim,
                             sin(((d.i + 1) / 1000) * h) AS x
                      FROM (SELECT *, ('0x' || substr(md5(token), 1, 8))::BIGINT % 100003 AS h FROM toks),
                           range(0, {ENC_DIM}) d(i)"""),
    ("f_token_sources", """SELECT id_left AS claim_id, claim_source,
                                  CAST(CASE WHEN cred_label = 'True' THEN 1 ELSE 0 END AS INTEGER) AS label
                           FROM ex WHERE id_left % 13 <> 0"""),
    ("f_evidence_meta", """SELECT id_left AS claim_id, evi_pos, evidence_source, -1.0 AS correlation
                           FROM ev WHERE id_left % 13 <> 0"""),
]


def _predict_sql(stream: bool = False):
    chain = []
    for name, body in SS.CHAIN:
        if name == "vocab_c":
            body = ("SELECT claim_source AS value, row_number() OVER (ORDER BY min(ex_pos)) AS idx "
                    "FROM ex GROUP BY claim_source")
        elif name == "vocab_e":
            body = ("SELECT evidence_source AS value, "
                    "row_number() OVER (ORDER BY min(ex_pos * 1000000 + evi_pos)) AS idx "
                    "FROM ev GROUP BY evidence_source")
        chain.append((name, body))
    final = """
SELECT claim_id AS req_id, round(logit, 6) AS logit, CAST(logit > 0 AS INTEGER) AS prediction
FROM logits"""
    if stream:
        final = """
SELECT md5(e.claim_text) AS claim_md5, round(g.logit, 6) AS logit, CAST(g.logit > 0 AS INTEGER) AS prediction
FROM logits g JOIN ex e ON e.id_left = g.claim_id, range(CASE WHEN e.id_left % 7 = 0 THEN 2 ELSE 1 END) again"""
    return with_views(final, "f_rows", params=dict(SERVE_PARAMS, sources=("f_rows", "f_rows")), ctes=SERVE_CTES + chain)


def _explain_sql():
    side = "(SELECT claim_id, evi_pos, '{0}' AS side, tok_pos, {1} AS w FROM {2} WHERE tok_pos > 0)"
    real = "(SELECT c.* FROM cwn c JOIN n_ev USING (claim_id) WHERE c.evi_pos < n_ev.n)"
    level = "CAST(floor(CASE WHEN hi = lo THEN 0.0 ELSE (w - lo) / (hi - lo) * 0.99 END * {0}) AS INTEGER) AS level_{0}"
    return with_views(f"""
SELECT m.claim_id, m.evi_pos, side, m.tok_pos, t.token, round(w, 6) AS weight, {level.format(6)}, {level.format(8)}
FROM (SELECT *, min(w) OVER k AS lo, max(w) OVER k AS hi
      FROM ({side.format('claim', 'beta', real)} UNION ALL {side.format('evidence', 'alpha', 'ewn')})
      WINDOW k AS (PARTITION BY claim_id, evi_pos, side)) m
JOIN toks t ON t.claim_id = m.claim_id AND t.tok_pos = m.tok_pos AND t.evi_pos = CASE side WHEN 'claim' THEN -1 ELSE m.evi_pos END""",
                      "f_rows", params=dict(SERVE_PARAMS, sources=("f_rows", "f_rows")),
                      ctes=SERVE_CTES + [c for c in SS.CHAIN if c[0] not in ("vocab_c", "vocab_e")][:SS.ORDER.index("cwn") + 1])


@register("explain_attention", _explain_sql())
def q_explain(spark, sf_dir):
    """Per real evidence of the requests, both sides' words with their weights and levels."""
    good, _ = IO.parse_requests(request_lines(spark, sf_dir))
    texts, _, _ = request_tables(good, dim=ENC_DIM)
    p = fixture_params(**SERVE_PARAMS)
    maps = pair_slots(*sides(texts, p), p, keep_maps=True)
    said = good.select(F.col("req_id").alias("claim_id"), F.lit(-1).alias("evi_pos"), F.col("claim").alias("text")).unionByName(
        good.select(F.col("req_id").alias("claim_id"), F.posexplode("evidences").alias("evi_pos", "e")).select(
            "claim_id", "evi_pos", F.col("e.evidence").alias("text")))
    words = said.select("claim_id", "evi_pos", tokenize(F.coalesce("text", F.lit(""))).alias("words"))
    got = explain_tokens(maps, words)
    return got.withColumn("weight", r6("weight"))


@register("predict_requests", _predict_sql())
def q_predict(spark, sf_dir):
    out = predict_requests(request_lines(spark, sf_dir), *serving_model(spark, sf_dir), dim=ENC_DIM)
    return out["predictions"].select("req_id", r6("logit").alias("logit"), "prediction")


@register("stream_predict", _predict_sql(stream=True))
def q_stream(spark, sf_dir):
    """Streaming re-aim: request files scored micro-batch by micro-batch."""
    from claimlens.streaming.predict_stream import start_prediction_stream
    src = scratch(spark, "requests")
    lines = request_lines(spark, sf_dir)
    again = lines.where(F.col("req_id") % 7 == 0)  # the same line twice: two equal answers
    lines.unionByName(again).select("value").write.mode("overwrite").text(src)
    out, ck = scratch(spark, "predictions"), scratch(spark, "stream-ckpt")
    q = start_prediction_stream(spark, src, out, ck, *serving_model(spark, sf_dir), dim=ENC_DIM)
    q.awaitTermination()
    # a line has no id; the claim digest is the stable key
    return spark.read.parquet(out).where("ok").select("claim_md5", r6("logit").alias("logit"), "prediction")
