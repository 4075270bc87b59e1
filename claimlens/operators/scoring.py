"""Full claim scoring (M4, M6-M8) as a DataFrame plan, one row per text.

texts (a token matrix each) -> layer norm + linear -> evidence joined to its claim, once ->
co-attention and affinity of the pair -> top-k evidences per claim, padded -> softmax over
their affinities -> document vector -> two linear layers.

Two joins carry matrices, both hidden-sized: a claim's text to its evidences, and the k
best evidences to their claim. No token is a row after the texts are formed. The NumPy
kernels work on pieces of Arrow batches (``common.pieces``); a claim with a third of all
evidences is split by AQE's skew join, and only its k best slots are gathered.

Batch-independent definitions replace the source's padded-batch maths (Q13,
Q14, Q16): means and attention run over real tokens only; a claim is padded to
max(top_k, n) evidence slots on its own. Padded slots follow the source: their
affinity is -1, their evidence vector is the projection of an all-zero token
(LN(0) = ln_bias, then linear_e), their claim vector is the claim attention
against that vector, and their evidence source is the unseen one.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.functions import dense as D
from claimlens.operators import attention as AT
from claimlens.operators import source_tables as ST
from claimlens.operators.common import pieces
from claimlens.operators.order import group_position
from claimlens.operators.params import ModelParams
from claimlens.session import cut_lineage


def source_vocab(claims: DataFrame, evidence: DataFrame | None, by: list[str] = ()) -> DataFrame:
    """Both source vocabularies from one position pass, numbered per kind (and ``by``) by
    first appearance in (claim_id, evi_pos) order (claims first in a claim)."""
    parts = claims.select(*by, F.lit("claim").alias("kind"), F.col("claim_source").alias("value"),
                          F.struct(F.col("claim_id"), F.lit(-1).alias("evi_pos")).alias("o"))
    if evidence is not None:
        parts = parts.unionByName(evidence.select(
            *by, F.lit("evidence").alias("kind"), F.col("evidence_source").alias("value"),
            F.struct(F.col("claim_id"), F.col("evi_pos").cast("int").alias("evi_pos")).alias("o")))
    first = parts.groupBy(*by, "kind", "value").agg(F.min("o").alias("k"))
    pos = group_position(first, [*by, "kind"], [F.col("k.claim_id"), F.col("k.evi_pos")], name="_p")
    return pos.select(*by, "kind", "value", (F.col("_p") + 1).cast("int").alias("idx"))


# ------------------------------------------------------------------- texts
def token_texts(tokens: DataFrame, vec: str = "vec") -> DataFrame:
    """Token rows (claim_id, evi_pos, tok_pos, vec) -> one row per text: (claim_id, evi_pos, toks, vals),
    ``vals`` being the vectors of the tokens one after the other."""
    rows = F.array_sort(F.collect_list(F.struct("tok_pos", vec)))
    return tokens.groupBy("claim_id", "evi_pos").agg(rows.alias("_t")).select(
        "claim_id", "evi_pos", F.transform("_t", lambda t: t["tok_pos"].cast("int")).alias("toks"),
        F.flatten(F.transform("_t", lambda t: t[vec])).alias("vals"))


def flat(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The values of an array<double> column, as rows of ``width`` if given."""
    out = column.flatten().to_numpy(zero_copy_only=False)
    return out if width is None else out.reshape(-1, width)


def lists(values: np.ndarray, lens: np.ndarray, type_: pa.DataType = pa.float64()) -> pa.Array:
    """``values``, ``lens`` at a time."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)).astype(np.int32)), pa.array(values.ravel(), type_))


def sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


def project(vals: np.ndarray, is_claim: np.ndarray, p: ModelParams) -> np.ndarray:
    """Layer norm, then linear_c for claims' tokens and linear_e for evidences'."""
    z = D.layer_norm(vals, p["ln_gain"][0], p["ln_bias"][0], p.eps)
    return np.where(is_claim[:, None], z @ p["linear_c_w"] + p["linear_c_b"][0], z @ p["linear_e_w"] + p["linear_e_b"][0])


def project_texts(texts: DataFrame, params: ModelParams) -> DataFrame:
    """Texts with a token -> (claim_id, evi_pos, toks, h): the projected tokens; ``pad`` is a claim's
    attention against a padded evidence."""
    bc = AT.broadcast_params(texts.sparkSession, params)

    def run(batches):
        p = bc.value
        d, width, v0 = p.emb_dim, p.hidden_dim, p.pad_vector()
        for b in (piece for batch in batches for piece in pieces(batch, sizes(batch.column(2)))):
            claim = b.column(1).to_numpy(zero_copy_only=False) < 0
            n = sizes(b.column(2))
            h = project(flat(b.column(3), d), np.repeat(claim, n), p)
            pad = np.zeros((0, width))
            if claim.any():
                own = np.repeat(claim, n)
                pad, _ = D.segment_attention(h[own], n[claim], np.tile(v0, (claim.sum(), 1)), p["co_w2"], p["co_v2"][:, 0])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], lists(h, n * width), lists(pad, claim * width)],
                                             names=["claim_id", "evi_pos", "toks", "h", "pad"])

    return texts.select("claim_id", F.col("evi_pos").cast("int").alias("evi_pos"), "toks", "vals").filter(F.size("toks") > 0) \
        .mapInArrow(run, "claim_id long, evi_pos int, toks array<int>, h array<double>, pad array<double>")


def sides(texts: DataFrame, params: ModelParams) -> tuple[DataFrame, DataFrame]:
    """Projected texts of claims and of evidences; split before the kernel, which runs once a text."""
    return project_texts(texts.filter("evi_pos < 0"), params), project_texts(texts.filter("evi_pos >= 0"), params)


def pair_slots(claim_texts: DataFrame, evidence_texts: DataFrame, params: ModelParams, keep_maps: bool = False) -> DataFrame:
    """Real slots: (claim_id, evi_pos, c_hat, e_hat, affinity), with ``keep_maps`` also the token
    places and weights of both sides (ctok, claim_map, etok, evidence_map)."""
    bc = AT.broadcast_params(claim_texts.sparkSession, params)
    maps = ["ctok", "claim_map", "etok", "evidence_map"]

    def run(batches):
        p = bc.value
        width = p.hidden_dim
        for b in (piece for batch in batches for piece in pieces(batch, sizes(batch.column(2)) + sizes(batch.column(4)))):
            ne, nc = sizes(b.column(2)), sizes(b.column(4))
            e, c = flat(b.column(3), width), flat(b.column(5), width)
            e_hat, alpha = D.segment_attention(e, ne, D.segment_means(c, nc), p["co_w1"], p["co_v1"][:, 0])
            c_hat, beta = D.segment_attention(c, nc, D.segment_means(e, ne), p["co_w2"], p["co_v2"][:, 0])
            each = np.full(len(b), width)
            out = [*b.columns[:2], lists(c_hat, each), lists(e_hat, each), pa.array(D.affinity(c_hat, e_hat, p["affinity_w"]))]
            if keep_maps:
                out += [b.column(4), lists(beta, nc), b.column(2), lists(alpha, ne)]
            yield pa.RecordBatch.from_arrays(out, names=["claim_id", "evi_pos", "c_hat", "e_hat", "affinity", *(maps if keep_maps else [])])

    claim = claim_texts.select("claim_id", F.col("toks").alias("ctoks"), F.col("h").alias("ch"))
    pairs = evidence_texts.select("claim_id", "evi_pos", "toks", "h").join(claim, "claim_id")
    more = ", ctok array<int>, claim_map array<double>, etok array<int>, evidence_map array<double>" if keep_maps else ""
    return pairs.select("claim_id", "evi_pos", "toks", "h", "ctoks", "ch").mapInArrow(
        run, "claim_id long, evi_pos int, c_hat array<double>, e_hat array<double>, affinity double" + more)


def with_pads(real: DataFrame, claims: DataFrame, params: ModelParams) -> DataFrame:
    """``real`` and, of each claim (claim_id, pad) with fewer than top_k slots, the padded ones."""
    n = F.coalesce(F.col("n"), F.lit(0)).cast("int")
    counts = real.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"))
    short = claims.select("claim_id", "pad").join(counts, "claim_id", "left").filter(n < params.top_k)
    pads = short.select("claim_id", F.explode(F.sequence(n, F.lit(params.top_k - 1))).alias("evi_pos"), F.col("pad").alias("c_hat"),
                        F.array(*[F.lit(float(x)) for x in params.pad_vector()]).alias("e_hat"), F.lit(-1.0).alias("affinity"))
    return real.withColumn("padded", F.lit(False)).unionByName(pads.withColumn("padded", F.lit(True)), allowMissingColumns=True)


def evidence_slots(tokens: DataFrame, params: ModelParams, keep_maps: bool = False) -> DataFrame:
    """Real and padded evidence slots with c_hat, e_hat and affinity."""
    claim_texts, evidence_texts = sides(token_texts(tokens), params)
    real = cut_lineage(pair_slots(claim_texts, evidence_texts, params, keep_maps))  # counted and returned
    return with_pads(real, claim_texts, params)


# -------------------------------------------------------------------- head
HEAD = "claim_id long, logit double, doc array<double>, evi_pos array<int>, affinity array<double>, weight array<double>, padded array<boolean>"


def claim_head(batch_top: pa.Array, pad: np.ndarray, cs, es0, p: ModelParams) -> dict:
    """Claims' best slots (lists of structs: rank, evi_pos, affinity, c_hat, e_hat[, es]) to their logits."""
    k, n = p.top_k, sizes(batch_top)
    fields = dict(zip([f.name for f in batch_top.type.value_type], batch_top.flatten().flatten()))
    row, shape = np.repeat(np.arange(len(n)), n), (len(n), k)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    number = lambda c: fields[c].to_numpy(zero_copy_only=False)
    aff = D.padded(number("affinity"), row, at, shape, -1.0)
    c, e = np.repeat(pad[:, None], k, axis=1), np.tile(p.pad_vector(), (*shape, 1))
    c[row, at], e[row, at] = flat(fields["c_hat"], p.hidden_dim), flat(fields["e_hat"], p.hidden_dim)
    es = None
    if es0 is not None:
        es = np.tile(es0, (*shape, 1))
        seen = pc.is_valid(fields["es"]).to_numpy(zero_copy_only=False)
        es[row[seen], at[seen]] = flat(fields["es"], len(es0))
    # Fewer than k slots are all of a claim's slots, and the padded ones are numbered on from them.
    pos = np.tile(np.arange(k), (len(n), 1))
    pos[row, at] = number("evi_pos")
    w = D.masked_softmax(aff, np.ones(shape, bool))
    doc, _, z = D.head(w, c, e, cs, es, p)
    return {"logit": z, "doc": doc, "evi_pos": pos, "affinity": aff, "weight": w, "padded": np.arange(k) >= n[:, None]}


def source_rows(column: pa.Array, unseen: np.ndarray) -> np.ndarray:
    """A column of source vectors; null is the unseen one's."""
    out = np.tile(unseen, (len(column), 1))
    seen = pc.is_valid(column).to_numpy(zero_copy_only=False)
    out[seen] = flat(column, len(unseen))
    return out


def _heads(rows: DataFrame, params: ModelParams, row0: dict) -> DataFrame:
    bc = AT.broadcast_params(rows.sparkSession, params)

    def run(batches):
        p = bc.value
        for b in batches:
            if not len(b):
                continue
            cs = source_rows(b.column("cs"), row0["claim"]) if "claim" in row0 else None
            got = claim_head(b.column("top"), flat(b.column("pad"), p.hidden_dim), cs, row0.get("evidence"), p)
            out = [b.column("claim_id"), pa.array(got["logit"])]
            for name, kind in (("doc", pa.float64()), ("evi_pos", pa.int32()), ("affinity", pa.float64()), ("weight", pa.float64()), ("padded", pa.bool_())):
                out.append(lists(got[name], np.full(len(b), got[name].shape[1]), kind))
            yield pa.RecordBatch.from_arrays(out, names=["claim_id", "logit", "doc", "evi_pos", "affinity", "weight", "padded"])

    return rows.mapInArrow(run, HEAD)


class Scored:
    """Results of ``score_claims``: ``scores`` (claim_id, logit, prob, prediction[, label]), ``evi_scores``
    (claim_id, evi_pos, rank, affinity, weight, padded), ``head`` (per claim, with the document vector
    ``doc``), ``slots`` (every slot with its evidence's columns, for the list-wise loss), ``vocab``."""

    def __init__(self, head: DataFrame, real: DataFrame, claim_texts: DataFrame, claims: DataFrame, evidence: DataFrame | None,
                 params: ModelParams, vocab: DataFrame):
        self.head, self.vocab = head, vocab
        self._real, self._claim_texts, self._claims, self._evidence, self._params = real, claim_texts, claims, evidence, params

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def scores(self) -> DataFrame:
        prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit")))
        out = self.head.select("claim_id", "logit", prob.alias("prob"), (F.col("logit") > 0).cast("int").alias("prediction"))
        return out.join(self._claims.select("claim_id", "label"), "claim_id", "left") if "label" in self._claims.columns else out

    @cached_property
    def evi_scores(self) -> DataFrame:
        each = F.posexplode(F.arrays_zip("evi_pos", "affinity", "weight", "padded")).alias("at", "z")
        return self.head.select("claim_id", each).select("claim_id", "z.evi_pos", (F.col("at") + 1).alias("rank"), "z.affinity",
                                                         "z.weight", "z.padded")

    @cached_property
    def slots(self) -> DataFrame:
        slots = with_pads(cut_lineage(self._real), self._claim_texts, self._params)
        if self._evidence is None:
            return slots.withColumn("evidence_src_idx", F.lit(0))
        ev = ST.source_indices(self._evidence, self.vocab, "evidence", "evidence_source", "evidence_src_idx")
        more = ["correlation"] if "correlation" in ev.columns else []
        out = slots.join(ev.select("claim_id", "evi_pos", "evidence_src_idx", *more), ["claim_id", "evi_pos"], "left") \
            .withColumn("evidence_src_idx", F.coalesce("evidence_src_idx", F.lit(0)))
        return out.withColumn("correlation", F.coalesce("correlation", F.lit(-1.0))) if more else out


def score_texts(texts: DataFrame, claims: DataFrame, evidence: DataFrame | None, params: ModelParams, vocab: DataFrame,
                tables: DataFrame) -> Scored:
    """M8 over one row per text (claim_id, evi_pos, toks, vals).

    claims   : claim_id, claim_source[, label]
    evidence : claim_id, evi_pos, evidence_source[, correlation]
    vocab    : kind, value, idx (train vocabulary)
    tables   : kind, idx, vec (source embeddings)
    """
    claim_texts, evidence_texts = sides(texts, params)
    real = pair_slots(claim_texts, evidence_texts, params)
    used = ST.kinds(params)
    row0 = {k: v for k, v in ST.unseen(tables).items() if k in used}
    coded = {k: ST.by_value(vocab, tables, k) for k in used}
    # The k best slots of a claim, each map task's first, then their source vectors.
    top = AT.topk_rows(real, "claim_id", "affinity", "evi_pos", params.top_k)
    if "evidence" in used and evidence is not None:
        ev = ST.source_vectors(evidence.select("claim_id", "evi_pos", "evidence_source"), coded["evidence"], "evidence_source", "es")
        top = top.join(ev.select("claim_id", "evi_pos", "es"), ["claim_id", "evi_pos"], "left")
    else:
        top = top.withColumn("es", F.lit(None).cast("array<double>"))
    best = top.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "evi_pos", "affinity", "c_hat", "e_hat", "es"))).alias("top"))
    none = F.array().cast(best.schema["top"].dataType)
    rows = claim_texts.select("claim_id", "pad").join(best, "claim_id", "left").withColumn("top", F.coalesce("top", none))
    if "claim" in used:
        cs = ST.source_vectors(claims.select("claim_id", "claim_source"), coded["claim"], "claim_source", "cs")
        rows = rows.join(cs.select("claim_id", "cs"), "claim_id", "left")
    return Scored(_heads(rows, params, row0), real, claim_texts, claims, evidence, params, vocab)


def score_claims(tokens: DataFrame, claims: DataFrame, evidence: DataFrame | None, params: ModelParams,
                 vocab: DataFrame, tables: DataFrame) -> Scored:
    """``score_texts`` of token rows (claim_id, evi_pos, tok_pos, vec)."""
    return score_texts(token_texts(tokens), claims, evidence, params, vocab, tables)
