"""Experiment-history and batching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import fixtures as FX
from claimlens.functions.text import token_count
from claimlens.operators import batching as BT
from claimlens.operators import history as HS
from claimlens.operators.order import global_position
from claimlens.plans.ingest import claim_examples
from claimlens.plans.oracle_views import with_views
from claimlens.plans.registry import r6, register, scratch
from claimlens.sources import files as IO


def records(spark, sf_dir):
    return FX.history(spark, sf_dir).withColumn("run", F.lit("fixture"))


@register("records_long", with_views(
    "SELECT 'fixture' AS run, fold, epoch, split, metric, round(value, 6) AS value FROM f_history",
    "f_history"))
def q_records(spark, sf_dir):
    path = scratch(spark, "records")
    IO.append_records(records(spark, sf_dir), path)
    r = IO.read_records(spark, path)
    return r.select("run", "fold", "epoch", "split", "metric", r6("value").alias("value"))


@register("fold_average", with_views("""
SELECT metric, split, epoch, round(avg(value), 6) AS value, count(*) AS n_folds
FROM f_history GROUP BY metric, split, epoch""", "f_history"))
def q_fold_average(spark, sf_dir):
    a = HS.fold_average(records(spark, sf_dir))
    return a.select("metric", "split", "epoch", r6("value").alias("value"), "n_folds")


BATCH_ROWS_SQL = """
SELECT CAST(user_id % 5 AS INTEGER) AS fold, CAST(dayofmonth(ts) - 1 AS INTEGER) AS epoch,
       CAST(hour(ts) AS INTEGER) AS batch, sqrt(value) AS loss, value / (value + 7) AS classify_loss
FROM events"""


def batch_rows(spark, sf_dir):
    ev = FX.table(spark, sf_dir, "events")
    return ev.select((F.col("user_id") % 5).cast("int").alias("fold"),
                     (F.dayofmonth("ts") - 1).cast("int").alias("epoch"),
                     F.hour("ts").cast("int").alias("batch"),
                     F.sqrt("value").alias("loss"),
                     (F.col("value") / (F.col("value") + 7)).alias("classify_loss"))


@register("epoch_losses", """
SELECT fold, epoch, round(avg(bl), 6) AS loss, round(avg(bc), 6) AS classify_loss,
       count(*) AS n_batches, round(avg(bl) - avg(bc), 6) AS rank_loss
FROM (SELECT fold, epoch, batch, avg(loss) AS bl, avg(classify_loss) AS bc
      FROM (""" + BATCH_ROWS_SQL + """) GROUP BY fold, epoch, batch)
GROUP BY fold, epoch""")
def q_epoch_losses(spark, sf_dir):
    e = HS.epoch_losses(batch_rows(spark, sf_dir), ["fold", "epoch"])
    return e.select("fold", "epoch", r6("loss").alias("loss"), r6("classify_loss").alias("classify_loss"),
                    "n_batches", r6("rank_loss").alias("rank_loss"))


@register("stop_on_first_loss", with_views("""
SELECT fold, min(CASE WHEN value > v0 THEN epoch END) AS stop_epoch
FROM (SELECT fold, epoch, value, first_value(value) OVER (PARTITION BY fold ORDER BY epoch) AS v0
      FROM f_history WHERE metric = 'loss' AND split = 'valid')
GROUP BY fold""", "f_history"))
def q_stop_first(spark, sf_dir):
    return HS.stop_on_first_loss(records(spark, sf_dir), ["fold"])


def _early_stop_sql(patience=10, delta=-0.01, gap=0.02):
    def step(c, bf, ba):
        first = "(s.vl > s.v0)"
        inc = f"(s.f1 < {bf} + ({delta}))"
        c_inc = f"(CASE WHEN {inc} THEN {c} + 1 ELSE 0 END)"
        small2 = "(s.n_below <= 1)"
        early = f"({inc} AND {c_inc} >= {patience} AND NOT {small2})"
        far = f"(abs(s.vl - s.tl) > {gap})"
        saved = f"(CASE WHEN {first} THEN false ELSE ({bf} < s.f1) OR ({bf} + ({delta}) <= s.f1 AND s.auc >= {ba}) END)"
        return f"""s.fold, s.k, s.epoch,
          CAST(CASE WHEN {first} THEN {c} WHEN {small2} THEN 0 WHEN {early} AND NOT {far} THEN 0
                    ELSE {c_inc} END AS INTEGER) AS c,
          {saved} AS saved,
          CASE WHEN {first} THEN {bf} WHEN {bf} < s.f1 THEN s.f1 ELSE {bf} END AS bf,
          CASE WHEN {first} THEN {ba} WHEN {saved} AND {ba} < s.auc THEN s.auc ELSE {ba} END AS ba,
          ({first} OR ({early} AND {far})) AS stop,
          CASE WHEN {first} THEN 'loss_above_first' WHEN {early} AND {far} THEN 'patience' END AS reason"""
    wide = """
SELECT fold, epoch,
  max(CASE WHEN metric = 'loss' AND split = 'train' THEN v END) AS tl,
  max(CASE WHEN metric = 'loss' AND split = 'valid' THEN v END) AS vl,
  max(CASE WHEN metric = 'f1_macro' AND split = 'valid' THEN v END) AS f1,
  max(CASE WHEN metric = 'auc' AND split = 'valid' THEN v END) AS auc
FROM (SELECT fold, epoch, split, metric,
             CASE WHEN metric = 'loss' THEN value / (epoch + 1) ELSE value / 100 END AS v FROM f_history)
GROUP BY fold, epoch HAVING tl IS NOT NULL AND vl IS NOT NULL AND f1 IS NOT NULL AND auc IS NOT NULL"""
    seq = """
SELECT w.*, row_number() OVER (PARTITION BY fold ORDER BY epoch) AS k,
       first_value(vl) OVER (PARTITION BY fold ORDER BY epoch) AS v0,
       (SELECT count(*) FROM wide w2 WHERE w2.fold = w.fold AND w2.epoch < w.epoch AND w2.vl < w.vl)
         AS n_below
FROM wide w"""
    rec = f"""
SELECT {step("0", "0.0", "0.0")} FROM seq s WHERE s.k = 1
UNION ALL
SELECT {step("st.c", "st.bf", "st.ba")}
FROM st JOIN seq s ON s.fold = st.fold AND s.k = st.k + 1 WHERE NOT st.stop"""
    body = with_views("""
SELECT 'fixture' AS run, fold, CAST(epoch AS INTEGER) AS epoch, c AS counter, saved,
       round(bf, 6) AS best_f1, round(ba, 6) AS best_auc, stop, reason FROM st""",
                      "f_history", ctes=[("wide", wide), ("seq", seq)])
    # the recursive CTE goes last; DuckDB needs the RECURSIVE keyword on the WITH
    head, sep, tail = body.rpartition("\nSELECT 'fixture' AS run")
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + f",\nst AS ({rec}\n)" + sep + tail


@register("early_stopping", _early_stop_sql())
def q_early_stopping(spark, sf_dir):
    """Per-fold patience trace with checkpoint choice and stop epoch.

    The fixture history's loss is an event average, so the first-loss rule
    would end most folds at once; it is scaled down per epoch to give traces."""
    h = records(spark, sf_dir)
    h = h.withColumn("value", F.when(F.col("metric") == "loss",
                                     F.col("value") / (F.col("epoch") + 1)).otherwise(F.col("value") / 100))
    t = HS.early_stopping(h, patience=10)
    return t.select("run", "fold", "epoch", "counter", "saved", r6("best_f1").alias("best_f1"),
                    r6("best_auc").alias("best_auc"), "stop", "reason")


# ------------------------------------------------------------------ batching
def doc_lengths(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents")
    return d.select("doc_id", (token_count(F.col("text")) + F.length("source")).alias("len_key"))


LEN_SQL = r"""len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda w: w <> ''))
              + length(source)"""


@register("length_buckets", f"""
SELECT doc_id, len_key, row_number() OVER (ORDER BY len_key, doc_id) - 1 AS len_pos,
       (row_number() OVER (ORDER BY len_key, doc_id) - 1) // 256 AS bucket
FROM (SELECT doc_id, CAST({LEN_SQL} AS INTEGER) AS len_key FROM documents)""")
def q_length_buckets(spark, sf_dir):
    b = BT.length_buckets(doc_lengths(spark, sf_dir), "len_key", "doc_id", 256)
    return b.select("doc_id", "len_key", "len_pos", "bucket")


@register("bucket_order", f"""
SELECT doc_id, bucket, row_number() OVER (ORDER BY bk, bucket, rk, doc_id) - 1 AS serve_pos,
       (row_number() OVER (ORDER BY bk, bucket, rk, doc_id) - 1) // 32 AS batch_id
FROM (SELECT doc_id, bucket,
             ('0x' || substr(md5('42:' || CAST(bucket AS VARCHAR)), 1, 15))::BIGINT AS bk,
             ('0x' || substr(md5('42:0:' || CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS rk
      FROM (SELECT doc_id, (row_number() OVER (ORDER BY len_key, doc_id) - 1) // 256 AS bucket
            FROM (SELECT doc_id, CAST({LEN_SQL} AS INTEGER) AS len_key FROM documents)))""")
def q_bucket_order(spark, sf_dir):
    b = BT.length_buckets(doc_lengths(spark, sf_dir), "len_key", "doc_id", 256)
    return BT.bucket_order(b, "doc_id", seed=42, epoch=0, batch_size=32) \
        .select("doc_id", "bucket", "serve_pos", "batch_id")


BAL_CTES = [
    ("cls", "SELECT label, count(*) AS n_c FROM f_pred GROUP BY label"),
    ("q0", "SELECT label, n_c, CAST(floor(32 * n_c / (SELECT sum(n_c) FROM cls)) AS BIGINT) AS q "
           "FROM cls"),
    ("rc", "SELECT min(label) AS label FROM cls"),   # seed 42 -> classes[42 % 2] = smallest class
    ("q", "SELECT q0.label, n_c, CAST(q + CASE WHEN q0.label = (SELECT label FROM rc) "
          "THEN 32 - (SELECT sum(q) FROM q0) ELSE 0 END AS BIGINT) AS q FROM q0"),
    ("qb", "SELECT *, coalesce(sum(q) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING "
           "AND 1 PRECEDING), 0) AS b FROM q"),
    ("pos", "SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1 AS cpos "
            "FROM f_pred"),
    ("nb", "SELECT CAST((count(*) + 31) // 32 AS BIGINT) AS n_batches FROM f_pred"),
    ("slots", "SELECT bt.range AS batch_id, qb.label, s.range AS slot, qb.b + s.range AS batch_slot, "
              "(bt.range * qb.q + s.range) % qb.n_c AS cpos, qb.q "
              "FROM qb, nb, range(nb.n_batches) bt, range(qb.q) s"),
]


@register("balanced_batches", with_views("""
SELECT s.batch_id, s.label, CAST(s.slot AS INTEGER) AS slot, CAST(s.batch_slot AS INTEGER) AS batch_slot,
       p.doc_id
FROM slots s JOIN pos p ON p.label = s.label AND p.cpos = s.cpos""", "f_pred", ctes=BAL_CTES))
def q_balanced(spark, sf_dir):
    return BT.balanced_batches(FX.pred(spark, sf_dir), "label", "doc_id", batch_size=32)


@register("batch_shape", with_views("""
SELECT batch, max(max_len) AS max_evi_len, CAST(greatest(5, max(n)) AS INTEGER) AS max_evi_num, count(*) AS n_claims
FROM (SELECT id_left, (row_number() OVER (ORDER BY id_left) - 1) // 32 AS batch,
             max(CAST(""" + r"""len(list_filter(regexp_split_to_array(evidence, '[^\p{L}\p{N}]+'),
                 lambda w: w <> ''))""" + """ AS INTEGER)) AS max_len, count(*) AS n
      FROM f_rows GROUP BY id_left)
GROUP BY batch""", "f_rows"))
def q_batch_shape(spark, sf_dir):
    ex = claim_examples(spark, sf_dir).select(
        "claim_id", F.size("evidences").alias("n"),
        F.array_max(F.transform("evidences", lambda e: token_count(e["evidence"]))).alias("max_len"))
    pos = global_position(ex, ["claim_id"], name="p").withColumn("batch", (F.col("p") / 32).cast("long"))
    return BT.batch_shape(pos, "batch", "n", "max_len")
