"""Text -> token vectors.

The reference runs a pretrained transformer; none ships here, so the default
encoder is deterministic and JVM-side: every token of the (whole) text gets
``v_k = sin((k + 1) / 1000 * (h mod 100003))`` with ``h`` the first 32 bits
of the token's md5, optionally preceded by a special first token (the
reference's encoder adds one; explanations cut it again).

A real encoder plugs in through ``encode_texts(..., encoder_factory=...)``:
texts are deduplicated first, encoded in Arrow batches by ``mapInPandas``
(the factory runs once per Python worker), and joined back by text digest.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions.text import tokenize

SPECIAL_FIRST = "[cls]"


def token_hash(token: Column) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % 100003


def hash_vector(h: Column, dim: int) -> Column:
    return F.array(*[F.sin(F.lit((k + 1) / 1000.0) * h) for k in range(dim)])


def encode_tokens(df: DataFrame, text: str, keys: list[str], dim: int = 16,
                  special_first: bool = True) -> DataFrame:
    """Default encoder: (keys..., tok_pos, token, vec) for every token."""
    toks = tokenize(F.col(text))
    if special_first:
        toks = F.concat(F.array(F.lit(SPECIAL_FIRST)), toks)
    ex = df.select(*keys, F.posexplode(toks).alias("tok_pos", "token"))
    return ex.select(*keys, F.col("tok_pos").cast("int").alias("tok_pos"), "token",
                     hash_vector(token_hash(F.col("token")), dim).alias("vec"))


def text_matrix(text: Column, dim: int = 16, special_first: bool = True) -> Column:
    """Default encoder, a text at a time: (toks: the tokens' places, vals: their vectors one after the other)."""
    toks = tokenize(F.coalesce(text, F.lit("")))
    if special_first:
        toks = F.concat(F.array(F.lit(SPECIAL_FIRST)), toks)
    vals = F.flatten(F.transform(F.transform(toks, token_hash), lambda h: hash_vector(h, dim)))
    return F.struct(F.transform(toks, lambda t, i: i).alias("toks"), vals.alias("vals"))


_WORKER_ENCODER: dict = {}


def encode_texts(df: DataFrame, text: str, keys: list[str],
                 encoder_factory: Callable[[], Callable[[list[str]], list[np.ndarray]]],
                 dim: int, name: str) -> DataFrame:
    """Pluggable encoder: distinct texts -> encoder in Arrow batches -> join back.

    ``encoder_factory()`` returns ``f(texts) -> [array (n_tokens, dim)]``; it is
    built once per Python worker and reused across batches and tasks, kept under
    the caller's ``name`` (which should tell the model and its version). Texts are
    known by their SHA-256; a null text is encoded as the empty one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(whole, 256))
    distinct = df.select(digest.alias("_th"), whole.alias("_t")).dropDuplicates(["_th"])
    schema = T.StructType([T.StructField("_th", T.BinaryType()), T.StructField("tok_pos", T.IntegerType()),
                           T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def fn(it):
        if name not in _WORKER_ENCODER:
            _WORKER_ENCODER[name] = encoder_factory()
        enc = _WORKER_ENCODER[name]
        for pdf in it:
            if pdf.empty:
                continue
            mats = enc(list(pdf["_t"].values))
            rows_h, rows_p, rows_v = [], [], []
            for th, m in zip(pdf["_th"].values, mats):
                for i, v in enumerate(np.asarray(m, dtype=np.float64)):
                    rows_h.append(bytes(th))
                    rows_p.append(i)
                    rows_v.append(v)
            yield pd.DataFrame({"_th": rows_h, "tok_pos": rows_p, "vec": rows_v})

    vecs = distinct.mapInPandas(fn, schema)
    base = df.select(*keys, digest.alias("_th"))
    return base.join(vecs, "_th").drop("_th")
