"""Scoring-model parameters: a small, size-checked set of dense matrices.

They are model-sized (dims x dims), never data-sized, so they travel to executors
as a broadcast; the source embeddings, which grow with the sources, are a table
(``source_tables``). ``fixture_params`` fills them from the closed formula
``sin(1 + 31*i + 17*j + 101*m) / sqrt(rows)`` so that Spark, NumPy and the DuckDB
oracle hold the same numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# Fixed order of the parameter matrices (numbered m = 0, 1, ... in this order); the first two
# are tables of their own.
PARAM_ORDER = [
    "claim_src", "evidence_src", "ln_gain", "ln_bias",
    "linear_c_w", "linear_c_b", "linear_e_w", "linear_e_b",
    "affinity_w", "co_w1", "co_v1", "co_w2", "co_v2",
    "fc1_w", "fc1_b", "fc3_w", "fc3_b",
]
SOURCE_PARAMS = PARAM_ORDER[:2]

# Broadcast guard: parameters above this size are refused (they are model-sized).
MAX_PARAM_BYTES = 512 * 1024 * 1024


@dataclass
class ModelParams:
    model_type: int
    emb_dim: int
    hidden_dim: int
    claim_src_dim: int
    evidence_src_dim: int
    mlp_hidden: int
    top_k: int = 5
    eps: float = 1e-6
    mats: dict = field(default_factory=dict)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.mats[name]

    @property
    def input_dim(self) -> int:
        d = 2 * self.hidden_dim
        if self.model_type in (1, 3):
            d += self.claim_src_dim
        if self.model_type in (2, 3):
            d += self.evidence_src_dim
        return d

    def nbytes(self) -> int:
        return int(sum(m.nbytes for m in self.mats.values()))

    def check_size(self) -> "ModelParams":
        if self.nbytes() > MAX_PARAM_BYTES:
            raise ValueError(f"parameters are {self.nbytes()} bytes, above the broadcast bound")
        return self

    def meta(self) -> dict:
        return dict(model_type=self.model_type, emb_dim=self.emb_dim, hidden_dim=self.hidden_dim,
                    claim_src_dim=self.claim_src_dim, evidence_src_dim=self.evidence_src_dim,
                    mlp_hidden=self.mlp_hidden, top_k=self.top_k, eps=self.eps)

    def copy_with(self, mats: dict) -> "ModelParams":
        return ModelParams(mats={k: np.array(v, dtype=np.float64) for k, v in mats.items()},
                           **self.meta())

    def pad_vector(self) -> np.ndarray:
        """Projection of an all-zero (padded) evidence token: LN(0) = ln_bias."""
        return self["ln_bias"][0] @ self["linear_e_w"] + self["linear_e_b"][0]


def shapes(model_type: int, emb_dim: int, hidden_dim: int, claim_src_dim: int, evidence_src_dim: int,
           mlp_hidden: int | None) -> dict:
    h = hidden_dim
    input_dim = 2 * h + (claim_src_dim if model_type in (1, 3) else 0) \
        + (evidence_src_dim if model_type in (2, 3) else 0)
    mh = input_dim // 48 if mlp_hidden is None else mlp_hidden
    return {
        "ln_gain": (1, emb_dim), "ln_bias": (1, emb_dim),
        "linear_c_w": (emb_dim, h), "linear_c_b": (1, h),
        "linear_e_w": (emb_dim, h), "linear_e_b": (1, h),
        "affinity_w": (3 * h, 1),
        "co_w1": (2 * h, h), "co_v1": (h, 1),
        "co_w2": (2 * h, h), "co_v2": (h, 1),
        "fc1_w": (input_dim, mh), "fc1_b": (1, mh),
        "fc3_w": (mh, 1), "fc3_b": (1, 1),
    }


def formula_matrix(m: int, rows: int, cols: int) -> np.ndarray:
    i = np.arange(rows, dtype=np.float64)[:, None]
    j = np.arange(cols, dtype=np.float64)[None, :]
    return np.sin(1.0 + 31.0 * i + 17.0 * j + 101.0 * m) / np.sqrt(rows)


def fixture_params(model_type: int = 3, emb_dim: int = 64, hidden_dim: int = 8, claim_src_dim: int = 4,
                   evidence_src_dim: int = 4, mlp_hidden: int | None = 3, top_k: int = 5) -> ModelParams:
    shp = shapes(model_type, emb_dim, hidden_dim, claim_src_dim, evidence_src_dim, mlp_hidden)
    mats = {n: formula_matrix(m, *shp[n]) for m, n in enumerate(PARAM_ORDER) if n in shp}
    mats["ln_gain"] = 1.0 + mats["ln_gain"]
    return ModelParams(model_type=model_type, emb_dim=emb_dim, hidden_dim=hidden_dim,
                       claim_src_dim=claim_src_dim, evidence_src_dim=evidence_src_dim,
                       mlp_hidden=shp["fc1_w"][1], top_k=top_k, mats=mats).check_size()


def init_params(model_type: int, emb_dim: int, hidden_dim: int, claim_src_dim: int = 128, evidence_src_dim: int = 192,
                mlp_hidden: int | None = None, top_k: int = 5, seed: int = 42) -> ModelParams:
    """Seeded random initialisation for training (uniform +-1/sqrt(fan_in)); the tables'
    is ``source_tables.random_tables``."""
    shp = shapes(model_type, emb_dim, hidden_dim, claim_src_dim, evidence_src_dim, mlp_hidden)
    rng = np.random.default_rng(seed)
    mats = {}
    for name in (n for n in PARAM_ORDER if n in shp):
        r, c = shp[name]
        if name == "ln_gain":
            mats[name] = np.ones((r, c))
        elif name == "ln_bias":
            mats[name] = np.zeros((r, c))
        else:
            bound = 1.0 / np.sqrt(max(r if r > 1 else c, 1))
            mats[name] = rng.uniform(-bound, bound, (r, c))
    return ModelParams(model_type=model_type, emb_dim=emb_dim, hidden_dim=hidden_dim,
                       claim_src_dim=claim_src_dim, evidence_src_dim=evidence_src_dim,
                       mlp_hidden=shp["fc1_w"][1], top_k=top_k, mats=mats).check_size()
