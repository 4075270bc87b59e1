"""M9: prediction from JSON requests (S9 -> D1 -> M8 -> P12).

A request carries its claim and all its evidence, so scoring needs nothing but the request, the
model and the sources' vectors. Two plans give the same numbers:

* ``predict_rows``: one row in, one row out. Parsing and encoding are column expressions, the model is one
  Arrow kernel, and the vocabularies with their vectors are at the task, behind a check of their
  size (``LocalSources``). It shuffles nothing, so it runs on a stream as it is.
* ``predict_requests``: the requests' texts through the bulk plan (``scoring.score_texts``), where the
  sources are a table and joined, however many there are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions import dense as D
from claimlens.operators import source_tables as ST
from claimlens.operators.attention import broadcast_params
from claimlens.operators.common import pieces
from claimlens.operators.encode import text_matrix
from claimlens.operators.normalise import label_int
from claimlens.operators.params import ModelParams
from claimlens.operators.scoring import flat, project, score_texts, sizes
from claimlens.sources.files import parse_requests

#: Vocabularies and vectors of more bytes aren't sent to the tasks; they are joined.
LOCAL_BYTES = 64 << 20


# ------------------------------------------------------------- by the bulk plan
def request_tables(good: DataFrame, id_col: str = "req_id", dim: int = 16,
                   special_first: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed requests -> (texts, claims, evidence) in the scoring layout."""
    claim = good.select(F.col(id_col).alias("claim_id"), F.lit(-1).alias("evi_pos"), F.col("claim").alias("text"))
    ev = good.select(F.col(id_col).alias("claim_id"), F.posexplode("evidences").alias("evi_pos", "e"))
    every = claim.unionByName(ev.select("claim_id", "evi_pos", F.col("e.evidence").alias("text")))
    texts = every.select("claim_id", "evi_pos", text_matrix(F.col("text"), dim, special_first).alias("m")).select(
        "claim_id", "evi_pos", "m.toks", "m.vals")
    claims = good.select(F.col(id_col).alias("claim_id"), "claim_source",
                         label_int(F.col("cred_label")).alias("label"))
    evidence = ev.select("claim_id", F.col("evi_pos").cast("int").alias("evi_pos"),
                         F.col("e.evidence_source").alias("evidence_source"))
    return texts, claims, evidence


def predict_requests(requests: DataFrame, params: ModelParams, vocab: DataFrame, tables: DataFrame,
                     id_col: str = "req_id", value_col: str = "value", dim: int = 16) -> dict:
    """-> {'predictions': (req_id, claim_md5, logit, prob, prediction), 'rejects': bad JSON}.

    ``prediction`` is ``logit > 0`` (P12). Unseen sources map to index 0. The same id and
    line again is the same request, scored once; an id with different lines is an error,
    as their evidence would mix.
    """
    requests = requests.select(id_col, value_col).dropDuplicates()
    if not (twice := requests.groupBy(id_col).count().where("count > 1")).isEmpty():
        raise ValueError(f"{id_col} with different requests: {[r[0] for r in twice.limit(5).collect()]}")
    good, rejects = parse_requests(requests, value_col)
    texts, claims, evidence = request_tables(good, id_col, dim)
    res = score_texts(texts, claims, evidence, params, vocab, tables)
    digest = good.select(F.col(id_col).alias("claim_id"), F.md5(F.coalesce("claim", F.lit(""))).alias("claim_md5"))
    preds = res["scores"].join(digest, "claim_id").select(
        F.col("claim_id").alias(id_col), "claim_md5", "logit", "prob", "prediction")
    return {"predictions": preds, "rejects": rejects, "evi_scores": res["evi_scores"]}


# --------------------------------------------------------------------- row by row
class LocalSources(NamedTuple):
    """Per kind that the model uses: the sources' names and vectors; the last vector is the unseen one's."""
    names: dict[str, pa.Array]
    vectors: dict[str, np.ndarray]

    def of(self, kind: str, column: pa.Array) -> np.ndarray:
        found = pc.index_in(column, value_set=self.names[kind])
        return self.vectors[kind][pc.fill_null(found, len(self.names[kind])).to_numpy(zero_copy_only=False)]


def local_sources(params: ModelParams, vocab: DataFrame, tables: DataFrame) -> LocalSources | None:
    """The sources for the tasks; None if they are more than LOCAL_BYTES."""
    names, vectors, row0 = {}, {}, ST.unseen(tables)
    for kind in ST.kinds(params):
        rows = ST.by_value(vocab, tables, kind).select("value", "vec")
        size = rows.agg(F.sum(F.octet_length("value") + 8 * F.size("vec") + 64)).first()[0] or 0
        if size > LOCAL_BYTES:
            return None
        got = rows.collect()  # LOCAL_BYTES at most
        names[kind] = pa.array([r.value for r in got], pa.string())
        vectors[kind] = np.array([*(r.vec for r in got), row0[kind]], np.float64)
    return LocalSources(names, vectors)


def score_requests(claim: np.ndarray, n_claim: np.ndarray, evidence: np.ndarray, n_evidence: np.ndarray, owner: np.ndarray,
                   cs, es, row0, p: ModelParams) -> np.ndarray:
    """Logits of requests: token vectors of their claims (n_claim rows each) and of all evidences
    (n_evidence rows each, of request ``owner``), source vectors (or None), the unseen evidence source's."""
    k, size = p.top_k, len(n_claim)
    h = project(claim, np.ones(len(claim), bool), p)
    g = project(evidence, np.zeros(len(evidence), bool), p)
    v0 = p.pad_vector()
    begin, n = (np.cumsum(n_claim) - n_claim)[owner], n_claim[owner]
    each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)  # an evidence's claim tokens
    e_hat, _ = D.segment_attention(g, n_evidence, D.segment_means(h, n_claim)[owner], p["co_w1"], p["co_v1"][:, 0])
    c_hat, _ = D.segment_attention(h[each], n, D.segment_means(g, n_evidence), p["co_w2"], p["co_v2"][:, 0])
    pad, _ = D.segment_attention(h, n_claim, np.tile(v0, (size, 1)), p["co_w2"], p["co_v2"][:, 0])
    a = D.affinity(c_hat, e_hat, p["affinity_w"])
    count = np.bincount(owner, minlength=size)
    order = np.lexsort((-a, owner))  # stable: ties by place
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    top, row, at, shape = order[at < k], owner[at < k], at[at < k], (size, k)  # only these are padded, whatever the longest request
    aff = D.padded(a[top], row, at, shape, -1.0)
    c, e = np.repeat(pad[:, None], k, axis=1), np.tile(v0, (*shape, 1))
    c[row, at], e[row, at] = c_hat[top], e_hat[top]
    if es is not None:
        full = np.tile(row0, (*shape, 1))
        full[row, at] = es[top]
        es = full
    return D.head(D.masked_softmax(aff, np.ones(shape, bool)), c, e, cs, es, p)[2]


def request_tokens(batch: pa.RecordBatch) -> np.ndarray:
    """Token rows that each parsed request's scoring takes: its claim's, again for every evidence, and the evidences'."""
    texts = batch.column("evidences")
    n, claim = sizes(texts), sizes(batch.column("claim"))
    values = np.append(0, np.cumsum(sizes(texts.flatten())))
    upto = np.cumsum(n)
    return claim * (n + 1) + values[upto] - values[upto - n]


def predict_rows(requests: DataFrame, params: ModelParams, sources: LocalSources, value_col: str = "value", dim: int = 16) -> DataFrame:
    """One row a request line: the other columns, then ok (false for a bad line), claim_md5, logit,
    prob, prediction (null for a bad line). Static tables and streams alike."""
    keep = [c for c in requests.columns if c != value_col]
    lines = requests.select(F.struct(*keep, F.col(value_col)).alias("row"), value_col)
    good = parse_requests(lines, value_col, keep_bad=True)
    claim: Column = text_matrix(F.col("claim"), dim)
    rows = good.select(
        "row", "ok", F.when(F.col("ok"), claim["vals"]).alias("claim"), F.when(F.col("ok"), F.md5("claim")).alias("md5"), "claim_source",
        F.when(F.col("ok"), F.transform("evidences", lambda e: text_matrix(e["evidence"], dim)["vals"])).alias("evidences"),
        F.when(F.col("ok"), F.transform("evidences", lambda e: e["evidence_source"])).alias("sources"))
    bc = broadcast_params(requests.sparkSession, params)
    local = requests.sparkSession.sparkContext.broadcast(sources)

    def run(batches):
        p, known = bc.value, local.value
        d = p.emb_dim
        for b in (piece for batch in batches for piece in pieces(batch, request_tokens(batch) // d + 1)):
            ok = b.column("ok").to_numpy(zero_copy_only=False)
            logit = np.zeros(len(b))
            if ok.any():
                g = b.filter(b.column("ok"))
                texts = g.column("evidences")
                owner = np.repeat(np.arange(len(g)), sizes(texts))
                texts = texts.flatten()
                cs = known.of("claim", g.column("claim_source")) if "claim" in known.names else None
                es = known.of("evidence", g.column("sources").flatten()) if "evidence" in known.names else None
                logit[ok] = score_requests(flat(g.column("claim"), d), sizes(g.column("claim")) // d, flat(texts, d), sizes(texts) // d, owner,
                                           cs, es, known.vectors["evidence"][-1] if es is not None else None, p)
            out = lambda x, t: pa.array(x, t, mask=~ok)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([
                b.column("row"), b.column("ok"), b.column("md5"), out(logit, pa.float64()), out(1 / (1 + np.exp(-logit)), pa.float64()),
                out((logit > 0).astype(np.int32), pa.int32())], names=["row", "ok", "claim_md5", "logit", "prob", "prediction"])

    kind = rows.schema["row"].dataType.simpleString()
    got = rows.mapInArrow(run, f"row {kind}, ok boolean, claim_md5 string, logit double, prob double, prediction int")
    return got.select(*(f"row.{c}" for c in keep), F.when(~F.col("ok"), F.col(f"row.{value_col}")).alias("raw"),
                      "ok", "claim_md5", "logit", "prob", "prediction")
