"""Nearest neighbours by a permutation index.

``PIVOTS`` vectors of a bounded sample (the ``SAMPLE`` of least hash) stand for the space: each next
one is the farthest by angle from those before it, so a large group of alike vectors gets few. A
vector is represented by the order of its ``PREFIX`` nearest pivots. Rows are dealt into blocks; a
block's index is an inverted file: per pivot the rows that have it among their nearest, with its
place in their order. A query walks the lists of its own nearest pivots and adds up, per row,
PREFIX - max(place here, place there): twice that sum is what the footrule distance of two such
orders (a pivot that one lacks stands at place PREFIX in it) is below its largest value. The
``BREADTH`` of a block's rows with the least footrule distance are reranked by the inner product
of the original vectors in double precision; the best of all blocks are the answer. A long list is
also held spread out, a byte a row, so that a query adds it up without looking rows up.

Every row is indexed and every row of a block can be found; breadth is a share of the rows, so recall
doesn't depend on the table's size (at least 0.9 of the exact neighbours; tests measure it).

Skew: rows with the same vector are one entry of the index; of its ids the k + 1 smallest can be among
anyone's k nearest, and its queries are searched once.

Size: queries are searched in rounds of ``ROUND`` query blocks. A round deals every row block once, or as
often as there are cores to use, to groups of queries; a task holds one block and one group, makes the block's
inverted file, and returns k + 1 entries a query. So no task, no row and no round's shuffle files grow with the
queries; time is queries times rows.

Defined results: rows with a null id, with a null, empty or zero vector, with null or non-finite
components, or with another number of components than most rows (ties: the larger number) take no part;
of rows that share an id the one with the least vector does; of equal scores the smaller ids come first;
an empty table gives an empty one; extra columns are ignored, whatever their names."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.common import Stages

SAMPLE, PIVOTS, PREFIX = 4096, 512, 128
#: Share of a block's rows that is reranked, and how many at least.
BREADTH, LEAST_RERANKED = 0.1, 256
#: Rows of an index block (a row number is 16 bits), and bytes of its vectors at most; queries of a query block.
BLOCK_ROWS, BLOCK_BYTES, QUERY_ROWS = 1 << 16, 32 << 20, 1 << 10
#: Query blocks of a round, and the tasks a core that a round is dealt into, if it has the queries for them.
ROUND, TASKS_A_CORE = 32, 4
#: Rows whose orders are made at once, and the share of a block's rows from which on a list is spread out.
PIECE_ROWS, SPREAD_FROM = 1 << 11, 1 / 16

_BYTE = 255
_RESULT = "query_id long, rank int, vec_id long, score double"


# -------------------------------------------------- orders, inverted files

def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of the sample: the first, then always that with the least cosine to its nearest chosen one."""
    way = sample / np.linalg.norm(sample / np.abs(sample).max(axis=1, keepdims=True), axis=1, keepdims=True) \
        / np.abs(sample).max(axis=1, keepdims=True)
    chosen, near = [0], way @ way[0]
    while len(chosen) < min(n, len(sample)):
        near[chosen[-1]] = np.inf  # never again
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, way @ way[chosen[-1]])
    return sample[chosen]


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each vector's nearest pivots, nearest first (ties: the first pivot), made piece by piece."""
    out = np.empty((len(vectors), prefix), np.uint16)
    for a in range(0, len(vectors), PIECE_ROWS):
        near = vectors[a:a + PIECE_ROWS].astype(np.float64) @ pivots.T
        if prefix < len(pivots):
            some = np.sort(np.argpartition(-near, prefix - 1, axis=1)[:, :prefix], axis=1)
        else:
            some = np.broadcast_to(np.arange(len(pivots)), near.shape)
        by = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
        out[a:a + PIECE_ROWS] = np.take_along_axis(some, by, axis=1)
    return out


def inverted(order: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per pivot its rows and its places in their orders: offsets of the lists, rows, places."""
    prefix, pieces = order.shape[1], range(0, len(order), PIECE_ROWS)
    counts = [np.bincount(order[a:a + PIECE_ROWS].ravel(), minlength=n_pivots) for a in pieces]
    offsets = np.concatenate([[0], np.cumsum(np.sum(counts, axis=0, dtype=np.int64))])
    rows, places = np.empty(order.size, np.uint16), np.empty(order.size, np.uint16)
    to = offsets[:-1].copy()  # where the next rows of each list go
    for a, n in zip(pieces, counts):
        by = np.argsort(order[a:a + PIECE_ROWS].ravel(), kind="stable")
        at = np.repeat(to - np.cumsum(n) + n, n) + np.arange(len(by))
        rows[at], places[at] = a + by // prefix, by % prefix
        to += n
    return offsets, rows, places


class Spread(NamedTuple):
    """Long lists spread out: of a pivot the line of ``near`` (or -1), there for each row prefix - place, 0
    where the list lacks it; per place a line of what a query that has the pivot there can count at most."""

    line: list[int]
    near: np.ndarray
    most: np.ndarray


def spread(offsets: np.ndarray, rows: np.ndarray, places: np.ndarray, n: int, prefix: int) -> Spread:
    """The lists with at least ``SPREAD_FROM`` of the ``n`` rows; a line is of bytes, so only if prefix fits one."""
    long = np.flatnonzero(np.diff(offsets) >= max(1, SPREAD_FROM * n)) if prefix <= _BYTE else np.zeros(0, np.int64)
    line, near = np.full(len(offsets) - 1, -1), np.zeros((len(long), n), np.uint8)
    line[long] = np.arange(len(long))
    for i, pivot in enumerate(long):
        own = slice(offsets[pivot], offsets[pivot + 1])
        near[i, rows[own]] = prefix - places[own]
    most = np.repeat(np.arange(prefix, 0, -1)[:, None].astype(np.uint8), n if len(long) else 0, axis=1)
    return Spread(line.tolist(), near, most)


def closeness(order: np.ndarray, offsets: np.ndarray, rows: np.ndarray, places: np.ndarray, n: int, long: Spread | None = None) -> np.ndarray:
    """Per row (largest footrule distance - footrule distance from the query's order) / 2."""
    prefix = len(order)
    out = np.zeros(n, np.uint16 if prefix * (prefix + 1) < 1 << 17 else np.int64)
    some, one, room = np.zeros(n, np.uint8), np.empty(n, np.uint8), _BYTE  # bytes of several lists, and what still fits
    for place, pivot in enumerate(order.tolist()):
        line = long.line[pivot] if long else -1
        if line < 0:
            own = slice(offsets[pivot], offsets[pivot + 1])
            out[rows[own]] += (prefix - np.maximum(places[own], place)).astype(out.dtype)
        elif prefix - place <= room:
            np.add(some, np.minimum(long.near[line], long.most[place], out=one), out=some)
            room -= prefix - place
        else:
            out += some
            np.minimum(long.near[line], long.most[place], out=some)
            room = _BYTE - (prefix - place)
    out += some
    return out


def reranked(query: np.ndarray, close: np.ndarray, vectors: np.ndarray, ids: np.ndarray, keep: int, largest: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the ``keep`` best of the closest rows by inner product, ties to the smaller id.

    With the size of the ``largest`` component of the vectors known, rows that their own precision shows to be
    outside the best are left before the products are made in double precision."""
    n = len(close)
    breadth = min(n, max(LEAST_RERANKED, -int(-BREADTH * n // 1)))
    upto = np.cumsum(np.bincount(close)[::-1])  # rows that are as close or closer, from the closest on
    some = np.flatnonzero(close >= len(upto) - 1 - np.searchsorted(upto, breadth))  # with all that tie with the last
    own, kind = np.take(vectors, some, axis=0), np.finfo(vectors.dtype)
    with np.errstate(all="ignore"):
        # What the rounding of two rows' products and sums can make up, and what is lost near 0.
        off = 2 * (len(query) + 2) * (float(kind.eps) * largest * np.abs(query).sum() + float(kind.tiny))
        if len(some) > keep and np.isfinite(off) and np.isfinite(rough := own @ query.astype(own.dtype)).all():
            best = np.flatnonzero(rough >= float(np.partition(rough, len(some) - keep)[len(some) - keep]) - off)
            some, own = some[best], own[best]
    score = (own.astype(np.float64) * query).sum(axis=1)
    by = np.lexsort((ids[some], -score))[:keep]
    return ids[some[by]], score[by]


# ------------------------------------------------------------------ blocks

def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _search(pivots: np.ndarray, prefix: int, keep: int):
    schema = pa.schema([("q", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])

    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(block) and len(queries):
            vectors, ids = _matrix(block["v"], len(block)), block["rep"].to_numpy()
            lists = inverted(orders(vectors, pivots, prefix), len(pivots))
            long, largest = spread(*lists, len(ids), prefix), float(max(vectors.max(), -vectors.min()))
            q_vectors, q_ids = _matrix(queries["v"], len(queries)), queries["rep"].to_numpy()
            for a in range(0, len(q_ids), QUERY_ROWS):
                some, each = q_vectors[a:a + QUERY_ROWS].astype(np.float64), []
                for q, v, o in zip(q_ids[a:a + QUERY_ROWS], some, orders(some, pivots, prefix)):
                    near, score = reranked(v, closeness(o, *lists, len(ids), long), vectors, ids, keep, largest)
                    each.append((np.full(len(near), q), near, score))
                found.append(tuple(np.concatenate(x) for x in zip(*each)))
        return pa.Table.from_arrays([np.concatenate(x) for x in zip(*found)], schema=schema)
    return run


# ----------------------------------------------------------------- operator

def _usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): rows that take part, one an id."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    sound = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")) \
        .filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    return sound.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows by inner product.

    ``is_query`` tells the queries by the column vec_id."""
    spark, stages = vectors.sparkSession, Stages(vectors.sparkSession)
    usable = stages.write(_usable(vectors, id_col, vec_col), "vectors")
    most = usable.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if most is None:
        return spark.createDataFrame([], _RESULT)
    dim = most["dim"]
    usable = usable.filter(F.size("v") == dim)
    kind = "f4" if dict(usable.dtypes)["v"] == "array<float>" else "f8"
    if kind == "f8":
        usable = usable.withColumn("v", F.col("v").cast("array<double>"))
    # Copies: the smallest id stands for all; its k + 1 smallest ids can be among anyone's k nearest.
    by_id = Window.partitionBy("v").orderBy("vec_id")
    few = usable.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= k + 1)
    entries = stages.write(few.groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    asked = stages.write(usable.filter(is_query).join(entries.select("v", "rep"), "v").select("vec_id", "rep"), "asked")
    stages.drop("vectors")
    n, n_asked = entries.count(), asked.select("rep").distinct().count()
    # Only so many hashes are looked at that the least are among them: an ordered limit takes SAMPLE rows from every partition.
    least = lambda rows: rows.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").collect()
    sample = least(entries.filter(F.xxhash64("rep") <= min((1 << 63) - 1, (4 * SAMPLE << 64) // n - (1 << 63))))
    if len(sample) < min(n, SAMPLE):
        sample = least(entries)
    pivots = spread_out(np.array([r.v for r in sample], np.float64), PIVOTS)
    prefix = min(PREFIX, len(pivots))
    # Some room, as blocks are dealt by hash.
    fit = max(1, BLOCK_BYTES // (dim * int(kind[1])))
    n_blocks = -(-n // max(1, int(0.9 * min(BLOCK_ROWS, fit))))
    n_rounds = max(1, -(-n_asked // min(ROUND * QUERY_ROWS, fit)))
    n_groups = max(1, min(-(-n_asked // (n_rounds * QUERY_ROWS)), -(-TASKS_A_CORE * spark.sparkContext.defaultParallelism // n_blocks)))
    deal = lambda parts: F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int")
    queries = stages.write(entries.join(asked.select("rep").distinct(), "rep").select(deal(n_rounds * n_groups).alias("part"), "rep", "v"), "queries")
    every = lambda first, past, name: F.explode(F.sequence(F.lit(first), F.lit(past - 1))).alias(name)
    best, rounds = Window.partitionBy("q").orderBy(F.desc("score"), "rep"), []
    for first in range(0, n_rounds * n_groups, n_groups):
        found = entries.select(deal(n_blocks).alias("block"), every(first, first + n_groups, "part"), "rep", "v").groupBy("part", "block").cogroup(
            queries.filter(F.col("part").between(first, first + n_groups - 1)).select("*", every(0, n_blocks, "block")).groupBy("part", "block")).applyInArrow(
            _search(pivots, prefix, k + 1), "q long, rep long, score double")
        rounds.append(f"found {first}")
        stages.write(found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1).select("q", "rep", "score"), rounds[-1])
    stages.drop("queries")
    found = spark.read.schema("q long, rep long, score double").parquet(*(stages.paths[x] for x in rounds))
    rows = found.join(entries.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1).groupBy("q").agg(
        F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near"))
    other = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return asked.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("q")).join(lists, "q") \
        .select("query_id", F.posexplode(other).alias("at", "x")) \
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def every_twentieth(vectors: DataFrame) -> DataFrame:
    """The 20 nearest other rows of each row whose vec_id is divisible by 20."""
    return nearest(vectors, F.col("vec_id") % 20 == 0, 20)
