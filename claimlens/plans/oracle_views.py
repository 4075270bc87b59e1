"""DuckDB twins of the fixture views in ``claimlens.fixtures``.

``with_views(sql, *names)`` prefixes a query with the CTEs it needs, so each
oracle is one self-contained SQL string over the pre-registered tables.
"""

from __future__ import annotations

from claimlens.fixtures import HISTORY_METRICS
from claimlens.operators.params import PARAM_ORDER, SOURCE_PARAMS, shapes

_METRIC_CASE = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in HISTORY_METRICS.items()) + " END"

VIEWS: dict[str, str] = {
    "f_rows": """
SELECT a.conv_id AS id_left, a.conv_id * 100 + b.turn AS id_right,
       CASE WHEN a.conv_id % 3 = 0 THEN 'True' ELSE 'False' END AS cred_label,
       a.text AS claim_text, concat('site', CAST(a.conv_id % 7 AS VARCHAR)) AS claim_source,
       b.text AS evidence, b.role AS evidence_source, a.conv_id * 100 + b.turn AS row_pos
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn > 0""",
    "f_ranked": """
SELECT CASE WHEN conv_id % 10 = 9 THEN 'x' ELSE '' END || CAST(conv_id AS VARCHAR) AS id, turn AS pos,
       substr(text, 1 + CAST(conv_id % 2 AS INTEGER), 12)
         || CASE WHEN conv_id % 2 = 1 AND turn % 2 = 0 THEN '~' ELSE '' END AS snippet,
       CAST(1 AS DOUBLE) / (turn + 1) AS score
FROM conversations
UNION ALL
SELECT CASE WHEN conv_id % 10 = 9 THEN 'x' ELSE '' END || CAST(conv_id AS VARCHAR), 100 + turn,
       substr(text, CASE WHEN turn % 3 = 2 THEN 5 ELSE 3 END, 6), CAST(2 AS DOUBLE) / (turn + 1)
FROM conversations""",
    "f_scores": """
SELECT vec_id, round(4 * CAST(embedding[1] AS DOUBLE), 2) AS logit,
       CAST(CASE WHEN label >= 5 THEN 1 ELSE 0 END AS INTEGER) AS label,
       CAST(vec_id % 5 AS INTEGER) AS fold
FROM embeddings""",
    "f_pred": """
SELECT doc_id, quality AS label, 1 - toxic AS prediction FROM labels""",
    "f_tokens": """
SELECT vec_id // 25 AS claim_id,
       CAST((vec_id % 25) % (3 + vec_id // 25 % 6) - 1 AS INTEGER) AS evi_pos,
       CAST((vec_id % 25) // (3 + vec_id // 25 % 6) AS INTEGER) AS tok_pos,
       embedding
FROM embeddings""",
    "f_tok_dims": """
SELECT claim_id, evi_pos, tok_pos, CAST(d.i AS INTEGER) AS dim, CAST(embedding[d.i + 1] AS DOUBLE) AS x
FROM f_tokens, range(0, 64) d(i)""",
    "f_token_sources": """
SELECT DISTINCT claim_id, concat('site', CAST(claim_id % 7 AS VARCHAR)) AS claim_source,
       CAST(CASE WHEN claim_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS label
FROM f_tokens WHERE evi_pos = -1""",
    "f_evidence_meta": """
SELECT DISTINCT claim_id, evi_pos,
       concat('src', CAST((claim_id + evi_pos) % 5 AS VARCHAR)) AS evidence_source,
       CAST((claim_id * 7 + evi_pos * 3) % 11 AS DOUBLE) / 10.0 AS correlation
FROM f_tokens WHERE evi_pos >= 0""",
    "f_history": f"""
SELECT CAST(user_id % 5 AS INTEGER) AS fold, CAST((dayofmonth(ts) - 1) % (20 + user_id % 5) AS INTEGER) AS epoch,
       CASE (user_id // 5) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split,
       {_METRIC_CASE} AS metric, avg(value) AS value
FROM events
GROUP BY ALL""",
}

# Dependencies between views (a view may read earlier ones).
DEPS = {
    "f_tok_dims": ["f_tokens"],
    "f_token_sources": ["f_tokens"],
    "f_evidence_meta": ["f_tokens"],
}


def params_view(model_type: int = 3, emb_dim: int = 64, hidden_dim: int = 8, claim_src_dim: int = 4,
                evidence_src_dim: int = 4, mlp_hidden: int = 3, top_k: int = 5,
                sources: tuple[str, str] = ("f_token_sources", "f_evidence_meta")) -> str:
    """F_params as rows (name, i, j, v), built with range() from the formula; the source tables have a
    row for each source of the views ``sources`` (claims', evidences') and row 0."""
    shp = shapes(model_type, emb_dim, hidden_dim, claim_src_dim, evidence_src_dim, mlp_hidden)
    parts = []
    for m, name in enumerate(PARAM_ORDER):
        if name in SOURCE_PARAMS:
            kind = name.removesuffix("_src")
            view, dim = (sources[0], claim_src_dim) if kind == "claim" else (sources[1], evidence_src_dim)
            rows = f"(SELECT unnest(range(n)) AS i, n FROM (SELECT count(DISTINCT {kind}_source) + 1 AS n FROM {view}))"
            parts.append(f"SELECT '{name}' AS name, CAST(r.i AS INTEGER) AS i, CAST(c.j AS INTEGER) AS j, "
                         f"sin(1 + 31 * r.i + 17 * c.j + {101 * m}) / sqrt(r.n) AS v FROM {rows} r, range(0, {dim}) c(j)")
            continue
        r, c = shp[name]
        if r * c == 0:
            continue
        base = f"sin(1 + 31 * r.i + 17 * c.j + {101 * m}) / sqrt({r})"
        val = f"1 + {base}" if name == "ln_gain" else base
        parts.append(
            f"SELECT '{name}' AS name, CAST(r.i AS INTEGER) AS i, CAST(c.j AS INTEGER) AS j, "
            f"CAST({val} AS DOUBLE) AS v FROM range(0, {r}) r(i), range(0, {c}) c(j)")
    return "\nUNION ALL\n".join(parts)


def with_views(sql: str, *names: str, params: dict | None = None,
               ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with the named fixture views, F_params and extra CTEs."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in order]
    if params is not None:
        parts.append(f"f_params AS (\n{params_view(**params)}\n)")
    for name, body in ctes or []:
        parts.append(f"{name} AS (\n{body}\n)")
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql
