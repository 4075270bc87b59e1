"""Evidence matching.

J1 scores each evidence row with the score of the *first* snippet of its
claim's ranked list (list order, not best score) that occurs in the evidence
text; -1 when none does. It is one equi-join on the claim id with the list
side un-exploded (one row per id), so the join never multiplies rows, and the
containment test runs as a JVM-side higher-order ``filter`` over the list.

J2 finds the same containment without an id, passages against a corpus, by exact
candidates (documents with the passage's rarest five-token shingle, then verify
every candidate).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators.common import broadcast_counted, maybe_broadcast, pieces
from claimlens.session import cut_lineage


def match_ranked_evidence(rows: DataFrame, ranked_lists: DataFrame, id_col: str = "id_left",
                          evidence_col: str = "evidence", strict: bool = False) -> DataFrame:
    """Add ``correlation`` (first matching snippet's score, else -1)."""
    if strict:
        missing = unmatched_claims(rows, ranked_lists, id_col).limit(20).collect()
        if missing:
            raise KeyError(f"claim ids missing from the ranked list: {[r[0] for r in missing]}")
    lists = ranked_lists.select(F.col("id").alias("_rid"), F.col("evidences").alias("_ranked"))
    j = rows.join(lists, rows[id_col].cast("string") == lists["_rid"], "left")
    first = F.get(F.filter("_ranked", lambda e: F.col(evidence_col).contains(e["snippet"])), 0)
    return (j.withColumn("correlation", F.coalesce(first["score"], F.lit(-1.0)))
            .drop("_rid", "_ranked"))


def match_ranked_evidence_exploded(rows: DataFrame, ranked: DataFrame, id_col: str = "id_left",
                                   evidence_col: str = "evidence") -> DataFrame:
    """J1 from the exploded list (id, pos, snippet, score): hash join on the id with the
    containment as residual. The score depends on (claim id, evidence text) only, so hits are
    found once for each distinct such pair and joined back to every row that has it, whatever
    other ids repeat or are null."""
    r = ranked.select(F.col("id").alias("_rid"), "pos", "snippet", "score")
    pair = rows.select(F.col(id_col).cast("string").alias("_id"), F.col(evidence_col).alias("_text")).distinct()
    hits = (pair.join(r, (pair["_id"] == r["_rid"]) & pair["_text"].contains(r["snippet"]))
            .groupBy("_id", "_text").agg(F.min_by("score", "pos").alias("_score")))
    return (rows.join(hits, (rows[id_col].cast("string") == hits["_id"]) & (rows[evidence_col] == hits["_text"]), "left")
            .withColumn("correlation", F.coalesce(F.col("_score"), F.lit(-1.0))).drop("_score", "_id", "_text"))


def unmatched_claims(rows: DataFrame, ranked_lists: DataFrame, id_col: str = "id_left") -> DataFrame:
    """Claim ids of ``rows`` that have no ranked list (anti join)."""
    ids = rows.select(F.col(id_col)).distinct()
    have = ranked_lists.select(F.col("id").alias("_rid")).distinct()
    return ids.join(have, ids[id_col].cast("string") == have["_rid"], "left_anti")


# ---------------------------------------------------------------- J2
#: Tokens of a shingle; a passage with fewer inner tokens has one shingle of all of them.
SHINGLE = 5


def _tokens(col):
    return F.split(F.trim(col), r"\s+")


def _token_hashes(toks):
    return F.transform(toks, lambda t: F.xxhash64(t))


def shingles(hashes: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all ``width``-token shingles of rows of token hashes, ``size`` tokens each."""
    out = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        out = (out ^ hashes[k:k + len(out)].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    row = np.repeat(np.arange(len(size)), size)
    inside = row[:len(out)] == row[width - 1:]
    return row[:len(out)][inside], out[inside].view(np.int64)


def shingle_rows(rows: DataFrame, key: str, widths: list[int]) -> DataFrame:
    """(key, width, shingle) of rows (key, hashes), for each width. A hash that two shingles share only makes
    a candidate more, as every candidate is verified."""
    def run(batches):
        size = lambda b: pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
        for b in (piece for batch in batches for piece in pieces(batch, size(batch))):
            hashes = b.column(1).flatten().to_numpy(zero_copy_only=False)
            for w in widths:
                row, h = shingles(hashes, size(b), w)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(np.full(len(h), w, np.int32)), pa.array(h)],
                                                 names=["key", "width", "shingle"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "hashes").mapInArrow(run, f"key {kind}, width int, shingle long").withColumnRenamed("key", key)


def inner_tokens(passages: DataFrame, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, _ptext, _width, hashes): a passage's inner tokens, and the width of its shingles.
    An inner token has white space on both sides inside the passage, so a document that contains the
    passage has them as whole tokens, one after the other."""
    toks = _tokens(F.col(text_col))
    inner = F.slice(toks, 2, F.greatest(F.size(toks) - 2, F.lit(0)))
    return passages.select(item_id, F.col(text_col).alias("_ptext"), F.least(F.size(inner), F.lit(SHINGLE)).alias("_width"),
                           _token_hashes(inner).alias("hashes"))


def passage_candidates(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
                       text_col: str = "text") -> DataFrame:
    """(doc, item, _ptext) of the documents with a passage's rarest shingle, for passages of 3 tokens and more.

    Documents give the distinct shingles that some passage has, too; these are counted over all documents,
    and a passage is looked for only where its shingle of the fewest documents is (ties: the least hash)."""
    p = inner_tokens(passages, item_id, text_col).filter("_width > 0").select(
        F.struct(item_id, "_ptext", F.col("_width").cast("int").alias("own")).alias("p"), "hashes")
    each = cut_lineage(shingle_rows(p, "p", list(range(1, SHINGLE + 1))).filter("p.own = width").select("p.*", "width", "shingle").distinct())
    asked = each.select("width", "shingle").distinct()
    widths = [r[0] for r in asked.select("width").distinct().collect()]  # SHINGLE values at most
    given = shingle_rows(docs.select(doc_id, _token_hashes(_tokens(F.col(text_col))).alias("hashes")), doc_id, sorted(widths))
    had = cut_lineage(given.join(broadcast_counted(asked, 16), ["width", "shingle"]).distinct())  # counted and joined
    counts = had.groupBy("width", "shingle").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(counts, ["width", "shingle"], "left").groupBy(item_id, "_ptext", "width").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle")).alias("a")).filter("a.n > 0")
    return had.join(rarest.select(item_id, "_ptext", "width", F.col("a.shingle").alias("shingle")), ["width", "shingle"]) \
        .select(doc_id, item_id, "_ptext").distinct()


def match_passages(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id",
                   item_id: str = "item_id", text_col: str = "text",
                   strategy: str = "anchor") -> DataFrame:
    """The distinct (item, doc) ids where a passage of the item occurs verbatim in a
    document of the id, whichever the strategy and however ids repeat.

    ``anchor``: exact candidates by the passage's rarest shingle (``passage_candidates``), each
    verified with ``contains``. Passages under 3 tokens use exact character-gram candidates
    (``match_short_passages``).
    ``broadcast``: nested loop over the passages (cost docs x passages), for a
    caller who knows that there is a handful of them.
    """
    p = passages.select(item_id, F.col(text_col).alias("_ptext"))
    d = docs.select(doc_id, F.col(text_col).alias("_dtext"))
    if strategy == "broadcast":
        return d.join(maybe_broadcast(p), F.col("_dtext").contains(F.col("_ptext"))).select(item_id, doc_id).distinct()
    cand = passage_candidates(docs, passages, doc_id, item_id, text_col)
    verified = cand.join(d, doc_id).where(F.col("_dtext").contains(F.col("_ptext"))).select(item_id, doc_id)
    short = inner_tokens(passages, item_id, text_col).filter("_width = 0").select(item_id, "_ptext")
    rest = match_short_passages(docs, short, doc_id, item_id, text_col)
    return verified.unionByName(rest).distinct()


SHORT_GRAM = 4


def match_short_passages(docs: DataFrame, short: DataFrame, doc_id: str, item_id: str,
                         text_col: str = "text") -> DataFrame:
    """Passages under 3 tokens: exact character-gram candidates. The first
    q = min(len, 4) characters of a passage occur in every document that
    contains it; documents emit their distinct q-grams only for the q values
    that short passages need (at most four), then candidates are verified."""
    sp = short.withColumn("_q", F.least(F.length("_ptext"), F.lit(SHORT_GRAM)))
    qs = [r[0] for r in sp.select("_q").distinct().collect()]  # at most SHORT_GRAM values
    d = docs.select(doc_id, F.col(text_col).alias("_dtext"))
    out = None
    for q in sorted(qs):
        if q is None:
            continue
        if q == 0:  # empty passages are contained in every document: the pairs are the result
            part = d.join(sp.where(F.col("_q") == 0).select(item_id, "_ptext").distinct(),
                          F.col("_dtext").contains(F.col("_ptext"))).select(item_id, doc_id)
        else:
            grams = d.select(doc_id, F.explode(F.array_distinct(F.transform(
                F.sequence(F.lit(1), F.greatest(F.length("_dtext") - q + 1, F.lit(1))),
                lambda i: F.substring("_dtext", i, q)))).alias("_g")).where(F.length("_g") == q)
            anchors = sp.where(F.col("_q") == q).select(item_id, F.substring("_ptext", 1, q).alias("_g"))
            cand = grams.join(maybe_broadcast(anchors), "_g").select(doc_id, item_id)
            part = (cand.join(maybe_broadcast(short), item_id).join(d, doc_id)
                    .where(F.col("_dtext").contains(F.col("_ptext"))).select(item_id, doc_id))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"{item_id} long, {doc_id} long")
    return out

