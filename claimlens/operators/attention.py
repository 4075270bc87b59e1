"""Vector pooling and attention operators.

Token rows: (claim_id, evi_pos, tok_pos, vec); ``evi_pos = -1`` is the claim
itself. Dense per-row algebra runs in NumPy over Arrow batches with the
parameters broadcast (model-sized, checked); every reduction over tokens or
evidences is a Spark aggregate:

* means and softmax-weighted sums use ``Summarizer`` (typed aggregate with a
  partial step), so a long text or a claim with a huge evidence list is
  combined map-side, never gathered in one task;
* softmax weights use a constant shift taken from the parameters: scores are
  ``tanh(.) . v`` so ``|score| <= sum|v|`` and ``exp(score - sum|v|)`` cannot
  overflow; the shift cancels in the normalised weights, so no max pass;
* the claim-side attention needs the claim's token matrix next to each
  evidence summary: the matrix (bounded by one text's tokens) is joined to
  the evidence rows, so the fan-out is per evidence, not per token pair.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions import dense as D
from claimlens.operators.params import ModelParams

VEC = T.ArrayType(T.DoubleType())


def broadcast_params(spark, params: ModelParams):
    from claimlens.session import ship_package
    ship_package(spark)
    return spark.sparkContext.broadcast(params.check_size())


def _schema_with(df: DataFrame, drop: list[str], add: list[tuple[str, T.DataType]]) -> T.StructType:
    fields = [f for f in df.schema.fields if f.name not in drop]
    return T.StructType(fields + [T.StructField(n, t) for n, t in add])


# ---------------------------------------------------------------- A16 / A17
def mean_pool(df: DataFrame, keys: list[str], col: str, name: str) -> DataFrame:
    """Componentwise mean of ``col`` per key (real rows only)."""
    return (df.groupBy(*keys).agg(Summarizer.mean(array_to_vector(F.col(col))).alias("_m"))
            .select(*keys, vector_to_array("_m").alias(name)))


def weighted_pool(df: DataFrame, keys: list[str], col: str, weight: str, name: str) -> DataFrame:
    """sum_i w_i x_i / sum_i w_i per key (softmax-weighted sum when w = exp(score))."""
    return (df.groupBy(*keys).agg(
        Summarizer.mean(array_to_vector(F.col(col)), F.col(weight)).alias("_m"))
        .select(*keys, vector_to_array("_m").alias(name)))


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(*keys, *(c for c in df.columns if c not in keys))


def softmax_weights(df: DataFrame, keys: list[str], score: str, name: str = "weight") -> DataFrame:
    """Masked softmax of ``score`` inside each key group (real rows only), rows with a null key left out.
    Group maximum and sum of exponentials are windows over one sort; rows are scalars, a group one text's."""
    w = Window.partitionBy(*keys)
    e = _keyed(df, keys).withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return e.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


# exp(score - bound) stays a normal number for scores in [-bound, bound] up to here
SAFE_BOUND = 300.0


def exp_weights(df: DataFrame, keys: list[str], score: str, bound: float, name: str) -> DataFrame:
    """Softmax numerators of scores in [-bound, bound], up to a factor per group that cancels.

    The model's own bound serves as the shift, without a pass for the maximum; a model whose
    bound would underflow gets each group's maximum instead."""
    if bound <= SAFE_BOUND:
        return df.withColumn(name, F.exp(F.col(score) - F.lit(float(bound))))
    from claimlens.session import cut_lineage
    df = cut_lineage(df)  # read for the maximum and again
    top = df.groupBy(*keys).agg(F.max(score).alias("_mx"))
    return df.join(top, keys).withColumn(name, F.exp(F.col(score) - F.col("_mx"))).drop("_mx")


# ---------------------------------------------------------------- F11 + F12
def project_tokens(tokens: DataFrame, params: ModelParams, vec: str = "vec") -> DataFrame:
    """Layer norm, then linear_c for claim tokens / linear_e for evidence tokens."""
    bc = broadcast_params(tokens.sparkSession, params)
    schema = _schema_with(tokens, [vec], [("h", VEC)])

    def fn(it):
        p = bc.value
        for pdf in it:
            if pdf.empty:
                continue
            x = D.stack(pdf[vec])
            z = D.layer_norm(x, p["ln_gain"][0], p["ln_bias"][0], p.eps)
            is_claim = (pdf["evi_pos"].values < 0)[:, None]
            h = np.where(is_claim, z @ p["linear_c_w"] + p["linear_c_b"][0],
                         z @ p["linear_e_w"] + p["linear_e_b"][0])
            out = pdf.drop(columns=[vec])
            out["h"] = D.unstack(h)
            yield out

    return tokens.mapInPandas(fn, schema)


def layer_norm_rows(df: DataFrame, params: ModelParams, vec: str = "vec", name: str = "z") -> DataFrame:
    """F11 alone (NumPy over Arrow batches)."""
    bc = broadcast_params(df.sparkSession, params)
    schema = _schema_with(df, [vec], [(name, VEC)])

    def fn(it):
        p = bc.value
        for pdf in it:
            if pdf.empty:
                continue
            z = D.layer_norm(D.stack(pdf[vec]), p["ln_gain"][0], p["ln_bias"][0], p.eps)
            out = pdf.drop(columns=[vec])
            out[name] = D.unstack(z)
            yield out

    return df.mapInPandas(fn, schema)


# ---------------------------------------------------------------- M1
def _score_rows(df: DataFrame, params: ModelParams, x: str, ctx: str, w: str, v: str,
                out: str = "score") -> DataFrame:
    """tanh([x; ctx] W) v per row."""
    bc = broadcast_params(df.sparkSession, params)
    schema = _schema_with(df, [], [(out, T.DoubleType())])

    def fn(it):
        p = bc.value
        for pdf in it:
            if pdf.empty:
                continue
            pdf[out] = D.attention_scores(D.stack(pdf[x]), D.stack(pdf[ctx]), p[w], p[v])
            yield pdf

    return df.mapInPandas(fn, schema)


def claim_matrices(claim_tokens: DataFrame) -> DataFrame:
    """One row per claim with its token vectors in order (one text: bounded)."""
    return (claim_tokens.groupBy("claim_id")
            .agg(F.array_sort(F.collect_list(F.struct("tok_pos", "h"))).alias("_toks"))
            .select("claim_id", F.transform("_toks", lambda t: t["h"]).alias("cmat"),
                    F.transform("_toks", lambda t: t["tok_pos"]).alias("ctok")))


def claim_side(rows: DataFrame, params: ModelParams, ctx: str, keep_map: bool = False) -> DataFrame:
    """Claim-token attention against a per-row context (evidence mean or pad
    vector): c_hat = softmax_t(tanh([h_t; ctx] W2) v2) @ H."""
    bc = broadcast_params(rows.sparkSession, params)
    add = [("c_hat", VEC)] + ([("claim_map", VEC)] if keep_map else [])
    schema = _schema_with(rows, ["cmat"], add)

    def fn(it):
        p = bc.value
        w, v = p["co_w2"], p["co_v2"][:, 0]
        for pdf in it:
            if pdf.empty:
                continue
            mats = [np.vstack([np.asarray(t, dtype=np.float64) for t in H]) for H in pdf["cmat"].values]
            lens = np.array([len(m) for m in mats])
            chat, maps = D.segment_attention(np.vstack(mats), lens, D.stack(pdf[ctx]), w, v)
            out = pdf.drop(columns=["cmat"])
            out["c_hat"] = list(chat)
            if keep_map:
                out["claim_map"] = np.split(maps, np.cumsum(lens)[:-1])
            yield out

    return rows.mapInPandas(fn, schema)


def co_attention(proj: DataFrame, params: ModelParams, keep_maps: bool = False,
                 materialize: bool = True) -> dict:
    """M1 both directions over projected tokens.

    The projected tokens feed four branches; with ``materialize`` they are cut
    into the shared folder once, so the NumPy projection is not re-run per
    branch (pass False when the caller has already cut them).

    Returns frames: ``slots`` (claim_id, evi_pos, gbar, e_hat, c_hat[, claim_map]),
    ``claims`` (claim_id, cbar, cmat, ctok) and, with ``keep_maps``, ``evidence_map``
    (claim_id, evi_pos, tok_pos, weight).
    """
    from claimlens.session import cut_lineage
    if materialize:
        proj = cut_lineage(proj)
    claim_tok = proj.where(F.col("evi_pos") < 0)
    evi_tok = proj.where(F.col("evi_pos") >= 0)
    cbar = mean_pool(claim_tok, ["claim_id"], "h", "cbar")
    scored = _score_rows(evi_tok.join(cbar, "claim_id"), params, "h", "cbar", "co_w1", "co_v1", "a")
    if keep_maps and materialize:
        scored = cut_lineage(scored)  # feeds the pooled vectors and the weight map
    weighted = exp_weights(scored, ["claim_id", "evi_pos"], "a", float(np.abs(params["co_v1"]).sum()), "a_w")
    h = array_to_vector(F.col("h"))
    summ = weighted.groupBy("claim_id", "evi_pos").agg(  # mean and weighted mean from one exchange
        Summarizer.mean(h).alias("_g"), Summarizer.mean(h, F.col("a_w")).alias("_e")).select(
        "claim_id", "evi_pos", vector_to_array("_g").alias("gbar"), vector_to_array("_e").alias("e_hat"))
    cm = claim_matrices(claim_tok)
    cols = ["claim_id", "cmat"] + (["ctok"] if keep_maps else [])
    slots = claim_side(summ.join(cm.select(*cols), "claim_id"), params, "gbar", keep_maps)
    out = {"slots": slots, "claims": cm.join(cbar, "claim_id")}
    if keep_maps:
        out["evidence_map"] = softmax_weights(scored.select("claim_id", "evi_pos", "tok_pos", "a"),
                                              ["claim_id", "evi_pos"], "a", "weight")
    return out


def co_attention_heads(proj: DataFrame, w1: np.ndarray, v1: np.ndarray, w2: np.ndarray, v2: np.ndarray) -> DataFrame:
    """M1 with several heads: (claim_id, evi_pos, c_hat, e_hat), each head's pooled vector after the other's.

    ``v1`` and ``v2`` have a column per head; a head is one more group column of the softmax."""
    claim_tok = proj.where(F.col("evi_pos") < 0).select("claim_id", "tok_pos", "h")
    evi_tok = proj.where(F.col("evi_pos") >= 0)
    cbar = mean_pool(claim_tok, ["claim_id"], "h", "ctx")
    gbar = mean_pool(evi_tok, ["claim_id", "evi_pos"], "h", "ctx")
    e_hat = _pool_heads(evi_tok.join(cbar, "claim_id"), w1, v1, "e_hat")
    c_hat = _pool_heads(gbar.join(claim_tok, "claim_id"), w2, v2, "c_hat")
    return c_hat.join(e_hat, ["claim_id", "evi_pos"])


def _pool_heads(rows: DataFrame, w: np.ndarray, v: np.ndarray, name: str) -> DataFrame:
    """Per (claim, evidence) the softmax-weighted sums of ``h`` under each head, one after the other."""
    bc = rows.sparkSession.sparkContext.broadcast((w, v))
    schema = _schema_with(rows, ["ctx"], [("_s", VEC)])

    def fn(it):
        wm, vm = bc.value
        for pdf in it:
            if pdf.empty:
                continue
            s = np.tanh(np.hstack([D.stack(pdf["h"]), D.stack(pdf["ctx"])]) @ wm) @ vm
            out = pdf.drop(columns=["ctx"])
            out["_s"] = D.unstack(s)
            yield out

    keys = ["claim_id", "evi_pos", "_head"]
    each = rows.mapInPandas(fn, schema).select("claim_id", "evi_pos", "h", F.posexplode("_s").alias("_head", "_a"))
    weighted = exp_weights(each, keys, "_a", float(np.abs(v).sum(0).max()), "_w")
    pooled = weighted_pool(weighted, keys, "h", "_w", "_p")
    heads = F.array_sort(F.collect_list(F.struct("_head", "_p")))  # as many entries as heads
    return pooled.groupBy("claim_id", "evi_pos").agg(heads.alias("_l")).select(
        "claim_id", "evi_pos", F.flatten(F.transform("_l", lambda x: x["_p"])).alias(name))


# ---------------------------------------------------------------- M3
def affinity_rows(slots: DataFrame, params: ModelParams, c: str = "c_hat", e: str = "e_hat",
                  name: str = "affinity") -> DataFrame:
    """M3: tanh(w . [c; e; c*e]) per evidence slot."""
    bc = broadcast_params(slots.sparkSession, params)
    schema = _schema_with(slots, [], [(name, T.DoubleType())])

    def fn(it):
        p = bc.value
        for pdf in it:
            if pdf.empty:
                continue
            pdf[name] = D.affinity(D.stack(pdf[c]), D.stack(pdf[e]), p["affinity_w"])
            yield pdf

    return slots.mapInPandas(fn, schema)


# ---------------------------------------------------------------- W2
def topk_rows(df: DataFrame, key: str, score: str, tie: str, k: int, name: str = "rank") -> DataFrame:
    """Top-k per key by score (desc), ties by ``tie`` (asc). ``row_number``
    with a ``<= k`` filter becomes a window group limit: each map task keeps
    only its k best rows per key before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


# ---------------------------------------------------------------- W5
def attention_levels(df: DataFrame, keys: list[str], weight: str, levels: int = 6,
                     name: str = "level") -> DataFrame:
    """Min-max scale inside each text, times 0.99, into ``levels`` bins;
    a constant row gets level 0 (the source divides by zero there). Windows over the sort of ``softmax_weights``."""
    w = Window.partitionBy(*keys)
    j = _keyed(df, keys).withColumns({"_lo": F.min(weight).over(w), "_hi": F.max(weight).over(w)})
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span == 0, F.lit(0.0)).otherwise((F.col(weight) - F.col("_lo")) / span * 0.99)
    return j.withColumn(name, F.floor(scaled * levels).cast("int")).drop("_lo", "_hi")


# ---------------------------------------------------------------- M2 / M5
def mean_attention(proj: DataFrame, w_claim: np.ndarray, b_claim: np.ndarray,
                   w_evi: np.ndarray, b_evi: np.ndarray) -> DataFrame:
    """M2: per (claim, evidence) linear maps of the claim mean and the evidence
    mean -> (claim_id, evi_pos, c_hat, e_hat)."""
    from claimlens.session import cut_lineage
    spark = proj.sparkSession
    proj = cut_lineage(proj)  # two branches read it
    cbar = mean_pool(proj.where(F.col("evi_pos") < 0), ["claim_id"], "h", "cbar")
    gbar = mean_pool(proj.where(F.col("evi_pos") >= 0), ["claim_id", "evi_pos"], "h", "gbar")
    rows = gbar.join(cbar, "claim_id")
    bc = spark.sparkContext.broadcast((w_claim, b_claim, w_evi, b_evi))
    schema = _schema_with(rows, ["gbar", "cbar"], [("c_hat", VEC), ("e_hat", VEC)])

    def fn(it):
        wc, bcl, we, be = bc.value
        for pdf in it:
            if pdf.empty:
                continue
            out = pdf.drop(columns=["gbar", "cbar"])
            out["c_hat"] = D.unstack(D.stack(pdf["cbar"]) @ wc + bcl)
            out["e_hat"] = D.unstack(D.stack(pdf["gbar"]) @ we + be)
            yield out

    return rows.mapInPandas(fn, schema)


def additive_attention(rows: DataFrame, key: str, x: str, w: np.ndarray, v: np.ndarray,
                       eps: float = 1e-6) -> DataFrame:
    """M5: softmax_i(v . tanh(LN(x_i W))) weighted sum of x per key; the layer
    norm here has unit gain and zero bias. -> (key, pooled)."""
    spark = rows.sparkSession
    bc = spark.sparkContext.broadcast((w, v))
    schema = _schema_with(rows, [], [("_s", T.DoubleType())])

    def fn(it):
        wm, vv = bc.value
        for pdf in it:
            if pdf.empty:
                continue
            z = D.layer_norm(D.stack(pdf[x]) @ wm, 1.0, 0.0, eps)
            pdf["_s"] = np.tanh(z) @ vv[:, 0]
            yield pdf

    scored = exp_weights(rows.mapInPandas(fn, schema), [key], "_s", float(np.abs(v).sum()), "_sw")
    return weighted_pool(scored, [key], x, "_sw", "pooled")

