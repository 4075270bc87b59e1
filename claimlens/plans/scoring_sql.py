"""DuckDB oracle chain for the scoring operators (model type 3, fixture dims).

Vectors are rows (key..., j, v); a linear map is a join on the input index
with F_params and a grouped sum -- the same numbers the Spark plan computes
with NumPy kernels inside Arrow batches.
"""

from __future__ import annotations

from claimlens.fixtures import FIXTURE_DIMS
from claimlens.plans.oracle_views import with_views

H = FIXTURE_DIMS["hidden_dim"]
CSD = FIXTURE_DIMS["claim_src_dim"]
ESD = FIXTURE_DIMS["evidence_src_dim"]
K = FIXTURE_DIMS["top_k"]
PARAMS = dict(FIXTURE_DIMS)

CHAIN = [
    ("st", """SELECT claim_id, evi_pos, tok_pos, avg(x) AS mu, stddev_samp(x) AS sd
              FROM f_tok_dims GROUP BY claim_id, evi_pos, tok_pos"""),
    ("z", """SELECT t.claim_id, t.evi_pos, t.tok_pos, t.dim,
                    g.v * (t.x - s.mu) / (s.sd + 1e-6) + b.v AS z
             FROM f_tok_dims t JOIN st s USING (claim_id, evi_pos, tok_pos)
             JOIN f_params g ON g.name = 'ln_gain' AND g.j = t.dim
             JOIN f_params b ON b.name = 'ln_bias' AND b.j = t.dim"""),
    ("hh0", """SELECT z.claim_id, z.evi_pos, z.tok_pos, w.j, sum(z.z * w.v) AS s
               FROM z JOIN f_params w ON w.i = z.dim
                 AND w.name = CASE WHEN z.evi_pos < 0 THEN 'linear_c_w' ELSE 'linear_e_w' END
               GROUP BY z.claim_id, z.evi_pos, z.tok_pos, w.j"""),
    ("hh", """SELECT h.claim_id, h.evi_pos, h.tok_pos, h.j, h.s + b.v AS h
              FROM hh0 h JOIN f_params b ON b.j = h.j
                AND b.name = CASE WHEN h.evi_pos < 0 THEN 'linear_c_b' ELSE 'linear_e_b' END"""),
    ("cbar", "SELECT claim_id, j, avg(h) AS v FROM hh WHERE evi_pos < 0 GROUP BY claim_id, j"),
    ("gbar", "SELECT claim_id, evi_pos, j, avg(h) AS v FROM hh WHERE evi_pos >= 0 "
             "GROUP BY claim_id, evi_pos, j"),
    ("ea", """SELECT t.claim_id, t.evi_pos, t.tok_pos, w.j AS jj, sum(t.h * w.v) AS s
              FROM hh t JOIN f_params w ON w.name = 'co_w1' AND w.i = t.j
              WHERE t.evi_pos >= 0 GROUP BY t.claim_id, t.evi_pos, t.tok_pos, w.j"""),
    ("ec", f"""SELECT c.claim_id, w.j AS jj, sum(c.v * w.v) AS s
               FROM cbar c JOIN f_params w ON w.name = 'co_w1' AND w.i = c.j + {H}
               GROUP BY c.claim_id, w.j"""),
    ("escore", """SELECT ea.claim_id, ea.evi_pos, ea.tok_pos, sum(tanh(ea.s + ec.s) * v.v) AS a
                  FROM ea JOIN ec USING (claim_id, jj) JOIN f_params v ON v.name = 'co_v1' AND v.i = ea.jj
                  GROUP BY ea.claim_id, ea.evi_pos, ea.tok_pos"""),
    ("ew", "SELECT *, exp(a - max(a) OVER (PARTITION BY claim_id, evi_pos)) AS e FROM escore"),
    ("ewn", "SELECT claim_id, evi_pos, tok_pos, a, e / sum(e) OVER (PARTITION BY claim_id, evi_pos) "
            "AS alpha FROM ew"),
    ("ehat", """SELECT t.claim_id, t.evi_pos, t.j, sum(n.alpha * t.h) AS v
                FROM hh t JOIN ewn n USING (claim_id, evi_pos, tok_pos)
                GROUP BY t.claim_id, t.evi_pos, t.j"""),
    ("v0a", """SELECT w.j, sum(b.v * w.v) AS s FROM f_params b
               JOIN f_params w ON b.name = 'ln_bias' AND w.name = 'linear_e_w' AND w.i = b.j
               GROUP BY w.j"""),
    ("v0", "SELECT a.j, a.s + b.v AS v FROM v0a a JOIN f_params b ON b.name = 'linear_e_b' AND b.j = a.j"),
    ("n_ev", """SELECT c.claim_id, count(DISTINCT g.evi_pos) AS n
                FROM (SELECT DISTINCT claim_id FROM hh WHERE evi_pos < 0) c
                LEFT JOIN gbar g USING (claim_id) GROUP BY c.claim_id"""),
    ("pads", f"SELECT claim_id, CAST(unnest(range(n, {K})) AS INTEGER) AS evi_pos FROM n_ev WHERE n < {K}"),
    ("gbar_all", "SELECT claim_id, evi_pos, j, v FROM gbar UNION ALL "
                 "SELECT p.claim_id, p.evi_pos, v0.j, v0.v FROM pads p, v0"),
    ("ehat_all", "SELECT claim_id, evi_pos, j, v FROM ehat UNION ALL "
                 "SELECT p.claim_id, p.evi_pos, v0.j, v0.v FROM pads p, v0"),
    ("ca", """SELECT t.claim_id, t.tok_pos, w.j AS jj, sum(t.h * w.v) AS s
              FROM hh t JOIN f_params w ON w.name = 'co_w2' AND w.i = t.j
              WHERE t.evi_pos < 0 GROUP BY t.claim_id, t.tok_pos, w.j"""),
    ("gc", f"""SELECT g.claim_id, g.evi_pos, w.j AS jj, sum(g.v * w.v) AS s
               FROM gbar_all g JOIN f_params w ON w.name = 'co_w2' AND w.i = g.j + {H}
               GROUP BY g.claim_id, g.evi_pos, w.j"""),
    ("cscore", """SELECT gc.claim_id, gc.evi_pos, ca.tok_pos, sum(tanh(ca.s + gc.s) * v.v) AS b
                  FROM ca JOIN gc USING (claim_id, jj) JOIN f_params v ON v.name = 'co_v2' AND v.i = ca.jj
                  GROUP BY gc.claim_id, gc.evi_pos, ca.tok_pos"""),
    ("cw", "SELECT *, exp(b - max(b) OVER (PARTITION BY claim_id, evi_pos)) AS e FROM cscore"),
    ("cwn", "SELECT claim_id, evi_pos, tok_pos, e / sum(e) OVER (PARTITION BY claim_id, evi_pos) "
            "AS beta FROM cw"),
    ("chat", """SELECT n.claim_id, n.evi_pos, t.j, sum(n.beta * t.h) AS v
                FROM cwn n JOIN hh t ON t.claim_id = n.claim_id AND t.evi_pos < 0 AND t.tok_pos = n.tok_pos
                GROUP BY n.claim_id, n.evi_pos, t.j"""),
    ("aff", f"""SELECT c.claim_id, c.evi_pos,
                  CASE WHEN c.evi_pos >= any_value(n_ev.n) THEN -1.0
                       ELSE tanh(sum(c.v * w1.v + e.v * w2.v + c.v * e.v * w3.v)) END AS affinity
                FROM chat c JOIN ehat_all e USING (claim_id, evi_pos, j)
                JOIN f_params w1 ON w1.name = 'affinity_w' AND w1.i = c.j
                JOIN f_params w2 ON w2.name = 'affinity_w' AND w2.i = c.j + {H}
                JOIN f_params w3 ON w3.name = 'affinity_w' AND w3.i = c.j + {2 * H}
                JOIN n_ev USING (claim_id)
                GROUP BY c.claim_id, c.evi_pos"""),
    ("topk", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id
                   ORDER BY affinity DESC, evi_pos) AS rank FROM aff) WHERE rank <= {K}"""),
    ("dw", """SELECT claim_id, evi_pos, rank, affinity,
                     exp(affinity - 1) / sum(exp(affinity - 1)) OVER (PARTITION BY claim_id) AS weight
              FROM topk"""),
    ("vocab_c", """SELECT claim_source AS value, row_number() OVER (ORDER BY min(claim_id)) AS idx
                   FROM f_token_sources GROUP BY claim_source"""),
    ("vocab_e", """SELECT evidence_source AS value,
                          row_number() OVER (ORDER BY min(claim_id * 1000 + evi_pos)) AS idx
                   FROM f_evidence_meta GROUP BY evidence_source"""),
    ("cidx", """SELECT s.claim_id, coalesce(v.idx, 0) AS idx
                FROM f_token_sources s LEFT JOIN vocab_c v ON v.value = s.claim_source"""),
    ("eidx", """SELECT d.claim_id, d.evi_pos, coalesce(v.idx, 0) AS idx FROM dw d
                LEFT JOIN f_evidence_meta m USING (claim_id, evi_pos)
                LEFT JOIN vocab_e v ON v.value = m.evidence_source"""),
    ("docv", f"""SELECT claim_id, fi, sum(weight * v) AS v FROM (
                   SELECT d.claim_id, d.weight, c.j AS fi, c.v FROM dw d JOIN chat c USING (claim_id, evi_pos)
                   UNION ALL
                   SELECT d.claim_id, d.weight, {H + CSD} + e.j, e.v
                   FROM dw d JOIN ehat_all e USING (claim_id, evi_pos)
                   UNION ALL
                   SELECT d.claim_id, d.weight, {2 * H + CSD} + p.j, p.v
                   FROM dw d JOIN eidx x USING (claim_id, evi_pos)
                   JOIN f_params p ON p.name = 'evidence_src' AND p.i = x.idx)
                 GROUP BY claim_id, fi
                 UNION ALL
                 SELECT c.claim_id, {H} + p.j, p.v FROM cidx c
                 JOIN f_params p ON p.name = 'claim_src' AND p.i = c.idx"""),
    ("hid", """SELECT d.claim_id, w.j AS m, sum(d.v * w.v) AS s
               FROM docv d JOIN f_params w ON w.name = 'fc1_w' AND w.i = d.fi GROUP BY d.claim_id, w.j"""),
    ("hid2", "SELECT h.claim_id, h.m, h.s + b.v AS v FROM hid h "
             "JOIN f_params b ON b.name = 'fc1_b' AND b.j = h.m"),
    ("logits", """SELECT h.claim_id, sum(h.v * w.v) + any_value(b.v) AS logit FROM hid2 h
                  JOIN f_params w ON w.name = 'fc3_w' AND w.i = h.m
                  JOIN f_params b ON b.name = 'fc3_b' GROUP BY h.claim_id"""),
]

ORDER = [n for n, _ in CHAIN]


def chain_sql(final: str, upto: str) -> str:
    """Final SELECT over the chain cut after CTE ``upto`` (earlier CTEs only)."""
    idx = ORDER.index(upto)
    return with_views(final, "f_tokens", "f_tok_dims", "f_token_sources", "f_evidence_meta",
                      params=PARAMS, ctes=CHAIN[: idx + 1])
