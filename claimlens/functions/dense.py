"""NumPy kernels applied to Arrow batches inside ``mapInPandas``.

Row-local dense algebra only (layer norm, linear maps, attention scores); all
grouping, pooling and ordering is done by Spark around these kernels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd


def stack(col: pd.Series, width: int | None = None) -> np.ndarray:
    """Arrow array<double> column -> 2-D float64 matrix."""
    if len(col) == 0:
        return np.zeros((0, width or 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in col.values])


def unstack(m: np.ndarray) -> list:
    return [row for row in np.asarray(m, dtype=np.float64)]


def layer_norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """gain * (x - mean) / (std_ddof1 + eps) + bias, rows independent."""
    mu = x.mean(axis=-1, keepdims=True)
    n = x.shape[-1]
    sd = np.sqrt(((x - mu) ** 2).sum(axis=-1, keepdims=True) / max(n - 1, 1))
    return gain * (x - mu) / (sd + eps) + bias


def attention_scores(x: np.ndarray, ctx: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """tanh([x; ctx] W) v for rows of x with a per-row context vector."""
    h = x.shape[-1]
    return np.tanh(x @ w[:h] + ctx @ w[h:]) @ v[:, 0]


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max())
    return e / e.sum()


def affinity(c: np.ndarray, e: np.ndarray, w: np.ndarray) -> np.ndarray:
    """tanh([c; e; c*e] . w) per row."""
    return np.tanh(np.concatenate([c, e, c * e], axis=-1) @ w[:, 0])


def segment_means(flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Means of neighbouring rows, ``lens`` at a time (none is 0)."""
    return np.add.reduceat(flat, np.cumsum(lens) - lens, axis=0) / lens[:, None]


def segment_attention(flat: np.ndarray, lens: np.ndarray, ctx: np.ndarray, w: np.ndarray, v: np.ndarray):
    """For every text r (``lens[r]`` rows H_r of ``flat``, one at least): beta_r = softmax(tanh(H_r W[:h]
    + ctx_r W[h:]) v) and beta_r @ H_r; returns the sums and the weights of all rows.

    All texts of a batch in one matmul; softmax and weighted sums per text with ``reduceat``."""
    h = flat.shape[1]
    starts = np.cumsum(lens) - lens
    sc = np.tanh(flat @ w[:h] + np.repeat(ctx @ w[h:], lens, axis=0)) @ v
    mx = np.maximum.reduceat(sc, starts)
    e = np.exp(sc - np.repeat(mx, lens))
    tot = np.add.reduceat(e, starts)
    beta = e / np.repeat(tot, lens)
    out = np.add.reduceat(beta[:, None] * flat, starts, axis=0)
    return out, beta


# ------------------------------------------------------ claims' slots, padded to the longest list
def padded(values: np.ndarray, row: np.ndarray, at: np.ndarray, shape: tuple, fill: float = 0.0) -> np.ndarray:
    """(rows, longest, ...): ``values`` at [row, at], ``fill`` elsewhere."""
    out = np.full((*shape, *values.shape[1:]), fill, values.dtype)
    out[row, at] = values
    return out


def masked_softmax(a: np.ndarray, there: np.ndarray) -> np.ndarray:
    a = np.where(there, a, -np.inf)
    e = np.exp(a - a.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def head(w: np.ndarray, c: np.ndarray, e: np.ndarray, cs, es, p) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document vectors, hidden layer and logits of claims, from their slots' weights (claims, k),
    vectors (claims, k, h), claim source vectors and slots' source vectors (or None)."""
    parts = [np.einsum("bk,bkh->bh", w, c), cs, np.einsum("bk,bkh->bh", w, e), None if es is None else np.einsum("bk,bkh->bh", w, es)]
    doc = np.concatenate([x for x in parts if x is not None], axis=1)
    hid = doc @ p["fc1_w"] + p["fc1_b"][0]
    return doc, hid, hid @ p["fc3_w"][:, 0] + p["fc3_b"][0, 0]


def head_loss(c, e, there, pad, pos, t, y, cs, es, p, alpha: float, need_grad: bool = True) -> dict:
    """Loss of claims and the gradient sums of what is trained.

    c, e (claims, slots, h); there, pad, pos, t (claims, slots): whether there is such a slot, whether
    it is a padded one, its place and its target correlation; y, cs (claims, ...); es (claims, slots,
    d). Slots that aren't there have no part. Returns logit, bce and rank (claims), and with the gradient
    the sums of the dense ones by name, ``cs`` (claims, d), ``es`` (claims, k, d) and the slots ``top`` of the latter."""
    k = p.top_k
    u = np.concatenate([c, e, c * e], axis=2)
    real = np.tanh(u @ p["affinity_w"][:, 0])
    a = np.where(pad, -1.0, real)
    top = np.lexsort((pos, np.where(there, -a, np.inf)), axis=1)[:, :k]
    pick = lambda x: None if x is None else np.take_along_axis(x, top[:, :, None], axis=1)
    w = masked_softmax(np.take_along_axis(a, top, axis=1), np.take_along_axis(there, top, axis=1))
    ct, et, est = pick(c), pick(e), pick(es)
    doc, hid, z = head(w, ct, et, cs, est, p)
    sm, st = masked_softmax(a, there), masked_softmax(t, there)
    low = np.where(there, a, -np.inf).max(axis=1, keepdims=True)
    log_sm = np.where(there, a - low - np.log(np.where(there, np.exp(np.where(there, a, 0) - low), 0).sum(axis=1, keepdims=True)), 0)
    out = {"logit": z, "bce": np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))), "rank": -(st * log_sm).sum(axis=1)}
    if not need_grad:
        return out
    dz = 1.0 / (1.0 + np.exp(-z)) - y
    dhid = dz[:, None] * p["fc3_w"][:, 0]
    dd = dhid @ p["fc1_w"].T
    widths = [0 if x is None else x.shape[-1] for x in (ct, cs, et, est)]
    dc, dcs, de, des = np.split(dd, np.cumsum(widths)[:-1], axis=1)
    dw = np.einsum("bkh,bh->bk", ct, dc) + np.einsum("bkh,bh->bk", et, de)
    if cs is not None:
        dw += (cs * dcs).sum(axis=1, keepdims=True)
    if es is not None:
        dw += np.einsum("bkh,bh->bk", est, des)
    da = np.zeros(a.shape)
    np.put_along_axis(da, top, w * (dw - (w * dw).sum(axis=1, keepdims=True)), axis=1)
    da += alpha * np.where(there, sm - st, 0)
    dpre = np.where(pad | ~there, 0.0, da * (1.0 - real ** 2))
    out["grads"] = {"affinity_w": np.einsum("bnu,bn->u", u, dpre)[:, None], "fc1_w": doc.T @ dhid, "fc1_b": dhid.sum(axis=0)[None],
                    "fc3_w": (hid * dz[:, None]).sum(axis=0)[:, None], "fc3_b": dz.sum().reshape(1, 1)}
    if cs is not None:
        out["cs"] = dcs
    if es is not None:
        out["es"], out["top"] = w[:, :, None] * des[:, None], top
    return out
