"""Ingest queries: scans, normalisation, evidence match, claim documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import fixtures as FX
from claimlens.operators import examples as EX
from claimlens.operators import normalise as NZ
from claimlens.operators.match import match_ranked_evidence, unmatched_claims
from claimlens.operators.order import global_position, trim_tail
from claimlens.plans.oracle_views import with_views
from claimlens.plans.registry import r6, register, scratch
from claimlens.sources import files as IO

# ------------------------------------------------------------------ helpers
MATCHED_SQL = """
SELECT r.*, coalesce(m.score, -1.0) AS correlation
FROM f_rows r LEFT JOIN (
  SELECT r.id_right, arg_min(k.score, k.pos) AS score
  FROM f_rows r JOIN f_ranked k
    ON k.id = CAST(r.id_left AS VARCHAR) AND contains(r.evidence, k.snippet)
  GROUP BY r.id_right) m ON m.id_right = r.id_right"""

EXAMPLES_CHECK_SQL = """
SELECT id_left AS claim_id, cred_label, claim_source, md5(claim_text) AS claim_md5,
       count(*) AS n_evidence,
       string_agg(evidence_source, '|' ORDER BY row_pos) AS sources,
       string_agg(CAST(CAST(round(correlation * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY row_pos)
         AS correlations,
       md5(string_agg(evidence, chr(1) ORDER BY row_pos)) AS evidence_md5
FROM matched GROUP BY cred_label, id_left, claim_text, claim_source"""


def matched_rows(spark, sf_dir):
    return match_ranked_evidence(FX.rows(spark, sf_dir), FX.ranked_lists(spark, sf_dir))


def claim_examples(spark, sf_dir):
    return EX.group_claim_examples(matched_rows(spark, sf_dir))


# Fixture split of F_rows into the reference's file layout.
def splits() -> dict:
    return {
        "dev_ori.tsv": F.col("id_left") % 6 == 5,
        "test_0_ori.tsv": (F.col("id_left") % 6 != 5) & (F.col("id_left") % 5 == 0),
        "train_0.tsv": (F.col("id_left") % 6 != 5) & (F.col("id_left") % 5 != 0),
    }


def write_split_files(spark, sf_dir) -> str:
    """The split files as they come: an extra leading column, columns in another order,
    text ids of evidences, an NA token for the missing source of every 11th evidence."""
    base = scratch(spark, "mapped")
    rows = FX.rows(spark, sf_dir).select(
        F.col("row_pos").alias("line_no"), *[c for c in reversed(IO.EVIDENCE_COLUMNS)])
    rows = rows.withColumn("id_right", F.concat(F.lit("ev_"), "id_right")).withColumn(
        "evidence_source", F.when(F.col("line_no") % 11 == 0, "n/a").otherwise(F.col("evidence_source")))
    for name, cond in splits().items():
        IO.write_evidence_tsv(rows.where(cond), f"{base}/{name}")
    return base


# ------------------------------------------------------------------ J1
@register("match_ranked_evidence", with_views(
    "SELECT id_left, id_right, evidence_source, round(correlation, 6) AS correlation FROM matched",
    "f_rows", "f_ranked", ctes=[("matched", MATCHED_SQL)]))
def q_match(spark, sf_dir):
    return matched_rows(spark, sf_dir).select("id_left", "id_right", "evidence_source",
                                              r6("correlation").alias("correlation"))


@register("match_ranked_evidence_exploded", with_views(
    "SELECT id_left, id_right, evidence_source, round(correlation, 6) AS correlation FROM matched",
    "f_rows", "f_ranked", ctes=[("matched", MATCHED_SQL)]))
def q_match_exploded(spark, sf_dir):
    """J1 from exploded ranked rows: hash join on the id with containment as
    residual, first list position per evidence row."""
    from claimlens.operators.match import match_ranked_evidence_exploded
    m = match_ranked_evidence_exploded(FX.rows(spark, sf_dir), FX.ranked(spark, sf_dir))
    return m.select("id_left", "id_right", "evidence_source", r6("correlation").alias("correlation"))


@register("unmatched_claims", with_views(
    "SELECT DISTINCT id_left FROM f_rows WHERE CAST(id_left AS VARCHAR) NOT IN (SELECT id FROM f_ranked)",
    "f_rows", "f_ranked"))
def q_unmatched(spark, sf_dir):
    return unmatched_claims(FX.rows(spark, sf_dir), FX.ranked_lists(spark, sf_dir))


# ------------------------------------------------------------------ A1 / A5 / P14
@register("group_claim_examples", with_views(
    EXAMPLES_CHECK_SQL, "f_rows", "f_ranked", ctes=[("matched", MATCHED_SQL)]))
def q_group(spark, sf_dir):
    return EX.examples_check_view(claim_examples(spark, sf_dir))


CLASS_CTES = [
    ("ex", "SELECT DISTINCT cred_label, id_left, claim_text, claim_source FROM f_rows"),
    ("c", "SELECT CAST(CASE WHEN cred_label = 'True' THEN 1 ELSE 0 END AS INTEGER) AS label, "
          "count(*) AS n FROM ex GROUP BY 1"),
]
CLASS_SQL = """
SELECT k.label, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
       round(coalesce(c.n, 0) / (SELECT count(*) FROM ex), 6) AS weight
FROM (SELECT CAST(range AS INTEGER) AS label FROM range(2)) k LEFT JOIN c ON c.label = k.label"""


@register("class_weights", with_views(CLASS_SQL, "f_rows", ctes=CLASS_CTES))
def q_class_weights(spark, sf_dir):
    w = EX.class_weights(claim_examples(spark, sf_dir))
    return w.select("label", "n", r6("weight").alias("weight"))


@register("example_lookup", with_views("""
SELECT cred_label, id_left AS claim_id,
       CAST(CASE WHEN cred_label = 'True' THEN 1 ELSE 0 END AS INTEGER) AS label,
       CAST(count(*) AS INTEGER) AS n_evidence,
       row_number() OVER (ORDER BY cred_label, id_left, claim_text, claim_source) - 1 AS example_pos
FROM f_rows GROUP BY cred_label, id_left, claim_text, claim_source""", "f_rows"))
def q_example_lookup(spark, sf_dir):
    pos = EX.example_positions(claim_examples(spark, sf_dir))
    return pos.select("cred_label", "claim_id", "label", "n_evidence", "example_pos")


# ------------------------------------------------------------------ S1 / S2 / U1 / S3
@register("scan_evidence_tsv", with_views("""
SELECT id_left, 'ev_' || id_right AS id_right, cred_label, claim_source,
       CASE WHEN id_right % 11 <> 0 THEN evidence_source END AS evidence_source,
       md5(claim_text) AS claim_md5, md5(evidence) AS evidence_md5
FROM f_rows""", "f_rows"))
def q_scan_tsv(spark, sf_dir):
    """The three written split files read back in one multi-path scan."""
    base = write_split_files(spark, sf_dir)
    df = IO.read_evidence_tsv(spark, [f"{base}/{name}" for name in splits()])
    return df.select("id_left", "id_right", "cred_label", "claim_source", "evidence_source",
                     F.md5("claim_text").alias("claim_md5"), F.md5("evidence").alias("evidence_md5"))


@register("union_files", with_views("""
SELECT id_left, 'ev_' || id_right AS id_right, CASE WHEN id_left % 5 = 0 THEN 0 ELSE 1 END AS file_idx
FROM f_rows WHERE id_left % 6 <> 5""", "f_rows"))
def q_union_files(spark, sf_dir):
    base = write_split_files(spark, sf_dir)
    df = IO.scan_files(spark, base, r"t", with_order=True)
    return df.select("id_left", "id_right", F.col("file_order.file").alias("file_idx"))


@register("scan_pick_files", with_views("""
SELECT cred_label, count(*) AS n FROM f_rows
WHERE id_left % 6 <> 5 AND id_left % 5 = 0 GROUP BY cred_label""", "f_rows"))
def q_pick_files(spark, sf_dir):
    base = write_split_files(spark, sf_dir)
    picked = IO.pick_files(spark, base, r"te.t_\d_")
    rows = IO.read_evidence_tsv(spark, picked)
    return rows.groupBy("cred_label").agg(F.count(F.lit(1)).alias("n"))


MARKS = IO.NA_TOKENS + ["x", "N/A ", "none"]


@register("na_normalise", """
SELECT conv_id, turn,
       CASE WHEN m IN ({toks}) THEN NULL ELSE m END AS mark,
       CASE WHEN role IN ({toks}) THEN NULL ELSE role END AS role
FROM (SELECT conv_id, turn, role,
             list_extract([{marks}], CAST((conv_id + turn) % {n} AS INTEGER) + 1) AS m
      FROM conversations)""".format(
    toks=", ".join("'" + t.replace("'", "''") + "'" for t in IO.NA_TOKENS),
    marks=", ".join("'" + t.replace("'", "''") + "'" for t in MARKS), n=len(MARKS)))
def q_na(spark, sf_dir):
    conv = FX.table(spark, sf_dir, "conversations")
    marks = F.array(*[F.lit(t) for t in MARKS])
    df = conv.select("conv_id", "turn", "role",
                     F.element_at(marks, ((F.col("conv_id") + F.col("turn")) % len(MARKS) + 1)
                                  .cast("int")).alias("mark"))
    return IO.na_normalise(df, ["mark", "role"]).select("conv_id", "turn", "mark", "role")


# ------------------------------------------------------------------ S4
@register("ranked_evidence_topk", with_views("""
SELECT id, CAST(lpos AS INTEGER) AS pos, snippet, round(score, 6) AS score FROM (
  SELECT id, snippet, score, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS lpos
  FROM f_ranked) WHERE lpos < 3""", "f_ranked"))
def q_ranked_topk(spark, sf_dir):
    path = scratch(spark, "ranked")
    IO.write_ranked_evidence(FX.ranked_lists(spark, sf_dir), path)
    lists = IO.read_ranked_evidence(spark, path, topk=3)
    ex = IO.explode_ranked(lists)
    return ex.select("id", F.col("pos").cast("int").alias("pos"), "snippet", r6("score").alias("score"))


# ------------------------------------------------------------------ S5 / S6
@register("write_claim_examples", with_views("""
SELECT id_left AS claim_id, cred_label, claim_source, md5(claim_text) AS claim_md5,
       CAST(count(*) AS INTEGER) AS n_evidence
FROM f_rows GROUP BY cred_label, id_left, claim_text, claim_source""", "f_rows"))
def q_write_examples(spark, sf_dir):
    """The written JSON lines, read back as text and taken apart with JSON
    path functions (not with the reader's schema)."""
    path = scratch(spark, "examples")
    IO.write_claim_examples(claim_examples(spark, sf_dir), path)
    v = F.col("value")
    return spark.read.text(path).select(
        F.get_json_object(v, "$.claim_id").cast("bigint").alias("claim_id"),
        F.get_json_object(v, "$.cred_label").alias("cred_label"),
        F.get_json_object(v, "$.claim_source").alias("claim_source"),
        F.md5(F.get_json_object(v, "$.claim")).alias("claim_md5"),
        F.json_array_length(F.get_json_object(v, "$.evidences")).alias("n_evidence"))


@register("read_claim_examples", with_views(
    EXAMPLES_CHECK_SQL, "f_rows", "f_ranked", ctes=[("matched", MATCHED_SQL)]))
def q_read_examples(spark, sf_dir):
    path = scratch(spark, "examples")
    IO.write_claim_examples(claim_examples(spark, sf_dir), path)
    return EX.examples_check_view(IO.read_claim_examples(spark, path))


# ------------------------------------------------------------------ P2-P8, W1
# Fixed fixture values: raw labels of the two corpus layouts, picked by claim id.
RAW_A = ["true", "mostly true", "false", "mostly false", "partly true"]
RAW_B = ["True", "Half-True", "Mostly True", "False", "Pants on Fire!", "Mostly False", "Full Flop"]


def _sql_list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def raw_layout_a(spark, sf_dir):
    r = FX.rows(spark, sf_dir)
    lab = F.element_at(F.array(*map(F.lit, RAW_A)), (r.id_left % len(RAW_A) + 1).cast("int"))
    return r.select(lab.alias("c0"), F.col("claim_source").alias("c1"),
                    F.col("claim_text").alias("c2"), F.col("evidence").alias("c3"),
                    F.col("evidence_source").alias("c4"), "id_right")


def raw_layout_b(spark, sf_dir):
    r = FX.rows(spark, sf_dir)
    lab = F.element_at(F.array(*map(F.lit, RAW_B)), (r.id_left % len(RAW_B) + 1).cast("int"))
    return r.select(lab.alias("c0"), F.col("id_left").alias("c1"), F.col("claim_text").alias("c2"),
                    F.col("claim_source").alias("c3"), F.col("evidence").alias("c4"),
                    F.col("evidence_source").alias("c5"), "id_right")


LAB_A_SQL = f"list_extract({_sql_list(RAW_A)}, CAST(id_left % {len(RAW_A)} AS INTEGER) + 1)"
LAB_B_SQL = f"list_extract({_sql_list(RAW_B)}, CAST(id_left % {len(RAW_B)} AS INTEGER) + 1)"
MAP_A_SQL = "CASE raw WHEN 'true' THEN 'true' WHEN 'mostly true' THEN 'true' " \
            "WHEN 'false' THEN 'false' WHEN 'mostly false' THEN 'false' END"
MAP_B_SQL = "CASE raw WHEN 'True' THEN 'true' WHEN 'Half-True' THEN 'true' WHEN 'Mostly True' " \
            "THEN 'true' WHEN 'False' THEN 'false' WHEN 'Pants on Fire!' THEN 'false' " \
            "WHEN 'Mostly False' THEN 'false' END"


# Evidences a claim keeps in the fixture: fewer than it has, so that the cap cuts.
ALIGN_CAP = 3
CAPPED_SQL = """SELECT {cols} FROM (SELECT *, rank() OVER (PARTITION BY cred_label, claim_text, claim_source ORDER BY evidence)
       + (count(*) OVER (PARTITION BY cred_label, claim_text, claim_source, evidence) - 1) / 2.0 AS r
FROM ({rows}) WHERE cred_label IS NOT NULL) WHERE floor(r) < {limit}"""


@register("align_layout_a", with_views(f"""
SELECT cred_label, md5(claim_text) AS claim_md5, claim_source, md5(evidence) AS evidence_md5, evidence_source
FROM ({CAPPED_SQL.format(cols="*", limit=ALIGN_CAP, rows=f"SELECT *, {MAP_A_SQL} AS cred_label FROM "
                         f"(SELECT * EXCLUDE (cred_label), {LAB_A_SQL} AS raw FROM f_rows)")})""", "f_rows"))
def q_align_a(spark, sf_dir):
    raw = raw_layout_a(spark, sf_dir).drop("id_right")
    al = NZ.align(raw, "a", limit=ALIGN_CAP)
    return al.select("cred_label", F.md5("claim").alias("claim_md5"), "claim_source",
                     F.md5("evidence").alias("evidence_md5"), "evidence_source")


@register("align_layout_b", with_views(f"""
SELECT cred_label, md5(claim_text) AS claim_md5, claim_source, md5(evidence) AS evidence_md5, evidence_source
FROM ({CAPPED_SQL.format(cols="*", limit=ALIGN_CAP, rows=f"SELECT *, {MAP_B_SQL} AS cred_label FROM "
                         f"(SELECT * EXCLUDE (cred_label), {LAB_B_SQL} AS raw FROM f_rows)")})""", "f_rows"))
def q_align_b(spark, sf_dir):
    raw = raw_layout_b(spark, sf_dir).drop("id_right")
    al = NZ.align(raw, "b", limit=ALIGN_CAP)
    return al.select("cred_label", F.md5("claim").alias("claim_md5"), "claim_source",
                     F.md5("evidence").alias("evidence_md5"), "evidence_source")


@register("label_map_a", with_views(f"""
SELECT raw, {MAP_A_SQL} AS cred_label, count(*) AS n
FROM (SELECT {LAB_A_SQL} AS raw FROM f_rows) GROUP BY raw""", "f_rows"))
def q_label_a(spark, sf_dir):
    raw = raw_layout_a(spark, sf_dir)
    return raw.groupBy(F.col("c0").alias("raw")).agg(F.count(F.lit(1)).alias("n")) \
        .select("raw", NZ.label_map(F.col("raw"), "a").alias("cred_label"), "n")


@register("label_map_b", with_views(f"""
SELECT raw, {MAP_B_SQL} AS cred_label, count(*) AS n
FROM (SELECT {LAB_B_SQL} AS raw FROM f_rows) GROUP BY raw""", "f_rows"))
def q_label_b(spark, sf_dir):
    raw = raw_layout_b(spark, sf_dir)
    return raw.groupBy(F.col("c0").alias("raw")).agg(F.count(F.lit(1)).alias("n")) \
        .select("raw", NZ.label_map(F.col("raw"), "b").alias("cred_label"), "n")


RANK_SQL = """
SELECT id_right, CAST(floor(rank() OVER (PARTITION BY {keys} ORDER BY {ev})
       + (count(*) OVER (PARTITION BY {keys}, {ev}) - 1) / 2.0) AS INTEGER) AS rank
FROM (SELECT *, {ev_expr} AS {ev} FROM f_rows)"""


@register("cap_evidence", with_views(
    CAPPED_SQL.format(cols="id_right", limit=ALIGN_CAP, rows="SELECT * FROM f_rows"), "f_rows"))
def q_cap(spark, sf_dir):
    return NZ.cap_evidence(FX.rows(spark, sf_dir), ["cred_label", "claim_text", "claim_source"], ALIGN_CAP).select("id_right")


@register("evidence_rank", with_views(
    "SELECT id_right, rank FROM (" + RANK_SQL.format(
        keys="claim_source", ev="ev", ev_expr="evidence_source") + ")", "f_rows"))
def q_rank_ties(spark, sf_dir):
    """W1 over a column with many ties (roles per site), every row's rank."""
    rows = FX.rows(spark, sf_dir).withColumn("ev", F.col("evidence_source"))
    return NZ.evidence_rank(rows, ["claim_source"], evidence="ev").select("id_right", "rank")


@register("label_string", with_views("""
SELECT id_right, cred_label AS label_str,
       CASE WHEN id_left % 3 = 0 THEN 'True' ELSE 'False' END AS bool_str FROM f_rows""", "f_rows"))
def q_label_string(spark, sf_dir):
    r = FX.rows(spark, sf_dir).withColumn("b", F.col("id_left") % 3 == 0)
    from pyspark.sql import types as T
    return r.select("id_right",
                    NZ.label_string(F.col("cred_label"), T.StringType()).alias("label_str"),
                    NZ.label_string(F.col("b"), T.BooleanType()).alias("bool_str"))


@register("label_int", with_views("""
SELECT id_right, CAST(CASE WHEN cred_label = 'True' THEN 1 ELSE 0 END AS INTEGER) AS label
FROM f_rows""", "f_rows"))
def q_label_int(spark, sf_dir):
    r = FX.rows(spark, sf_dir)
    return r.select("id_right", NZ.label_int(F.col("cred_label")).alias("label"))


# ------------------------------------------------------------------ O3 / P10
@register("global_position", """
SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS pos FROM documents""")
def q_global_position(spark, sf_dir):
    docs = FX.table(spark, sf_dir, "documents").select("doc_id", "source")
    return global_position(docs, ["source", "doc_id"]).select("doc_id", "pos")


@register("trim_tail", """
SELECT doc_id FROM documents WHERE doc_id < (SELECT max(doc_id) FROM documents)""")
def q_trim_tail(spark, sf_dir):
    docs = FX.table(spark, sf_dir, "documents").select("doc_id")
    return trim_tail(docs, ["doc_id"], drop=1)
