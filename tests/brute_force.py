"""Plain NumPy forward of one claim, written from the formulas (test oracle)."""

from __future__ import annotations

import numpy as np


def ln(x, g, b, eps):
    mu = x.mean(-1, keepdims=True)
    sd = x.std(-1, ddof=1, keepdims=True)
    return g * (x - mu) / (sd + eps) + b


def sm(a):
    e = np.exp(a - a.max())
    return e / e.sum()


def forward_claim(claim_vecs, evidence_vecs, p, claim_idx=0, evidence_idx=None):
    """claim_vecs: (T, emb); evidence_vecs: list of (S_k, emb). Returns
    (logit, affinities of all slots, top-k slot ids, weights)."""
    g, b, eps = p["ln_gain"][0], p["ln_bias"][0], p.eps
    H = ln(claim_vecs, g, b, eps) @ p["linear_c_w"] + p["linear_c_b"][0]
    cbar = H.mean(0)
    slots = []
    for ev in evidence_vecs:
        G = ln(ev, g, b, eps) @ p["linear_e_w"] + p["linear_e_b"][0]
        a = np.tanh(np.hstack([G, np.tile(cbar, (len(G), 1))]) @ p["co_w1"]) @ p["co_v1"][:, 0]
        e_hat = sm(a) @ G
        gbar = G.mean(0)
        bb = np.tanh(np.hstack([H, np.tile(gbar, (len(H), 1))]) @ p["co_w2"]) @ p["co_v2"][:, 0]
        c_hat = sm(bb) @ H
        aff = np.tanh(np.concatenate([c_hat, e_hat, c_hat * e_hat]) @ p["affinity_w"][:, 0])
        slots.append((c_hat, e_hat, aff))
    k = p.top_k
    n = len(slots)
    v0 = b @ p["linear_e_w"] + p["linear_e_b"][0]
    bb = np.tanh(np.hstack([H, np.tile(v0, (len(H), 1))]) @ p["co_w2"]) @ p["co_v2"][:, 0]
    c_pad = sm(bb) @ H
    for _ in range(n, k):
        slots.append((c_pad, v0, -1.0))
    evidence_idx = list(evidence_idx or [0] * n) + [0] * max(0, k - n)
    affs = np.array([s[2] for s in slots])
    order = sorted(range(len(slots)), key=lambda i: (-affs[i], i))[:k]
    w = sm(affs[order])
    c = np.vstack([slots[i][0] for i in order])
    e = np.vstack([slots[i][1] for i in order])
    parts = [w @ c]
    if p.model_type in (1, 3):
        parts.append(p["claim_src"][claim_idx])
    parts.append(w @ e)
    if p.model_type in (2, 3):
        parts.append(w @ np.vstack([p["evidence_src"][evidence_idx[i]] for i in order]))
    doc = np.concatenate(parts)
    logit = float(((doc @ p["fc1_w"] + p["fc1_b"][0]) @ p["fc3_w"] + p["fc3_b"][0])[0])
    return logit, affs, order, w
