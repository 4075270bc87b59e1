"""Near duplicates by a signature-coordinate inverted join.

1. Each text becomes its set of 5-word shingles and a MinHash signature of 64
   coordinates. Texts with equal sets are one node from here on (linked at 1.0).
2. Nodes are posted under each (coordinate, value). A node whose values that
   others share number fewer than ``MATCH`` can't collide with any node that
   often and leaves. The others keep, in rarest-first order, only the prefix that
   two nodes with ``MATCH`` collisions must share at least one value of.
3. Posting lists are merged. Short lists give all their pairs; a long list only
   pairs its members with a hub, round after round, skipping members that are
   in the hub's component already: a group of n near copies gives about n pairs,
   not n squared. Pairs are kept if their signatures agree in ``MATCH``
   coordinates or more, then confirmed on the full shingle sets.
4. What long lists still hold in different components is settled exactly: the
   nodes concerned are posted under their shingles, rarest first, in prefixes
   that any two sets at the wanted similarity must share, with the bound on the
   overlap that their places in the two prefixes leave; these pairs are confirmed too.
5. Components of the confirmed links give each document its class.

At a similarity of 0.75, 48 of 64 coordinates agree on average; under ``MATCH`` =
32 agree with probability 5e-6. All other steps are exact, up to 64-bit shingle
hashes.

Cases: null, empty and blank texts have no shingles and are linked with nothing;
repeated ids are linked through each of their rows; null ids take part and show
the smallest id of their class, or null; empty input gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.common import Stages, whole
from claimlens.llm.components import components

WIDTH = 5
PERMUTATIONS = 64
MATCH = 32
#: Similarity as a fraction (intersection : union).
LEAST = (3, 4)
#: Lists of up to so many nodes give all pairs; longer ones go by hubs and step 4.
SHORT_LIST = 12
HUB_ROUNDS = 2

_SIGNED = "id long, text_key binary, n_shingles long, node binary, sig array<long>"
_RNG = np.random.default_rng(20240607)
_MULT = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def _per_batch(columns: list[str], row_of, width: int):
    def run(batches):
        from claimlens.llm.hashing import shingles
        for batch in batches:
            t = batch.column(batch.schema.get_field_index("text"))
            for i, j, h, off in shingles(t, width):
                yield pa.RecordBatch.from_arrays(row_of(batch.slice(i, j - i), h, off), names=columns)
    return run


def _binary16(a: np.ndarray, b: np.ndarray) -> pa.Array:
    raw = np.stack([a, b], 1).tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(a), [None, pa.py_buffer(raw)]).cast(pa.binary())


def _node(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over a set's hashes, equal for equal sets; 0, 0 for the empty set."""
    from claimlens.llm.hashing import U, mixed
    out = []
    for key in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mixed(h ^ U(key)), dtype=U)])
        out.append(total[off[1:]] - total[off[:-1]])
    return out[0], out[1]


def _sign(batch: pa.RecordBatch, h: np.ndarray, off: np.ndarray) -> list[pa.Array]:
    n = np.diff(off)
    some = n > 0
    sig = np.zeros((len(n), PERMUTATIONS), np.uint64)
    if len(h):
        for k in range(PERMUTATIONS):
            sig[some, k] = np.minimum.reduceat((h ^ _XOR[k]) * _MULT[k], off[:-1][some])
    flat = pa.array(sig.view(np.int64).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * PERMUTATIONS), flat)
    return [batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), _binary16(*_node(h, off)), lists]


def text_key(text_col: str) -> Column:
    return F.substring(F.unhex(F.sha2(whole(text_col), 256)), 1, 16).alias("text_key")


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, text_key, n_shingles, node, sig) per row; node identifies the shingle set."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col), whole(text_col).alias("text"))
    return rows.mapInArrow(_per_batch(["id", "text_key", "n_shingles", "node", "sig"], _sign, width), _SIGNED)


def _sets(batch: pa.RecordBatch, h: np.ndarray, off: np.ndarray) -> list[pa.Array]:
    return [_binary16(*_node(h, off)), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)))]


def shingle_sets(docs: DataFrame, text_col: str, width: int = WIDTH) -> DataFrame:
    return docs.select(whole(text_col).alias("text")).mapInArrow(
        _per_batch(["node", "shingles"], _sets, width), "node binary, shingles array<long>")


def _need(nx: Column, ny: Column, least) -> Column:
    """Least overlap of two sets at the wanted similarity."""
    p, q = least
    return F.ceil((nx + ny) * p / (p + q))


def post(nodes: DataFrame, stages: Stages) -> DataFrame:
    """(token, nid, shared): the prefix postings of nodes that may have a partner."""
    tokens = nodes.select("nid", F.posexplode("sig").alias("k", "v")).select("nid", F.xxhash64("k", "v").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = tokens.join(common, "token")
    by_node = Window.partitionBy("nid")
    ranked = shared.withColumn("shared", F.count("*").over(by_node)).withColumn(
        "rank", F.row_number().over(by_node.orderBy("df", "token")))
    return stages.write(ranked.filter((F.col("shared") >= MATCH) & (F.col("rank") <= F.col("shared") - MATCH + 1))
                        .select("token", "nid", "shared"), "posts")


def _confirm(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, least, by_signature: bool) -> DataFrame:
    """The pairs (a, b) whose signatures agree in MATCH coordinates and whose full sets are similar enough."""
    p, q = least
    if by_signature:
        sig = nodes.select("nid", "sig")
        pairs = pairs.join(sig.select(F.col("nid").alias("b"), F.col("sig").alias("sb")), "b") \
            .join(sig.select(F.col("nid").alias("a"), F.col("sig").alias("sa")), "a")
        agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda t: t))
        pairs = pairs.filter(agree >= MATCH).select("a", "b")
    full = sets.select("nid", "shingles")
    pairs = pairs.join(full.select(F.col("nid").alias("b"), F.col("shingles").alias("tb")), "b") \
        .join(full.select(F.col("nid").alias("a"), F.col("shingles").alias("ta")), "a")
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.filter(q * both >= p * (F.size("ta") + F.size("tb") - both)).select("a", "b")


def _labelled(posts: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return posts.withColumn("label", F.col("nid"))
    return posts.join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))


def _residual(sets: DataFrame, stages: Stages, least) -> DataFrame:
    """Pairs (a, b) of nodes in different components that may be similar, by exact prefixes of full sets."""
    p, q = least
    n = F.size("shingles")
    tokens = sets.select("nid", "label", n.alias("n"), F.explode("shingles").alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    tokens = tokens.join(df, "token")
    by_node = Window.partitionBy("nid")
    # Shingles of one node only come first in the order and need no posting.
    place = F.col("n") - F.count("*").over(by_node) + F.row_number().over(by_node.orderBy("df", "token")) - 1
    long_prefix = stages.write(tokens.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * p / q))
                               .select("token", "nid", "label", "n", "place"), "prefix")
    x = long_prefix.filter(F.col("place") <= F.col("n") - _need(F.col("n"), F.col("n"), least)).alias("x")
    y = long_prefix.alias("y")
    c = lambda s, k: F.col(f"{s}.{k}")
    left = F.least(c("x", "n") - c("x", "place"), c("y", "n") - c("y", "place"))
    on = ((c("x", "token") == c("y", "token")) & (c("x", "label") != c("y", "label"))
          & ((c("x", "n") < c("y", "n")) | ((c("x", "n") == c("y", "n")) & (c("x", "nid") < c("y", "nid"))))
          & (q * c("x", "n") >= p * c("y", "n")) & (left >= _need(c("x", "n"), c("y", "n"), least)))
    return x.join(y, on).select(F.least(c("x", "nid"), c("y", "nid")).alias("a"),
                                F.greatest(c("x", "nid"), c("y", "nid")).alias("b")).distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, least, width: int, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (node, label, component): each node's class and the class's smallest id."""
    signed = stages.write(signatures(docs, id_col, text_col, width), "signed")
    nodes = stages.write(signed.filter("n_shingles > 0").groupBy("node").agg(
        F.min("id").alias("least_id"), F.min("n_shingles").alias("n"), F.first("sig").alias("sig"))
        .withColumn("nid", F.monotonically_increasing_id()), "nodes")
    posts = post(nodes, stages)
    wanted = stages.write(posts.select("nid").distinct().join(nodes.select("nid", "node", "least_id"), "nid"), "wanted")
    # Full sets of the nodes with postings only; a null id can't be looked up, so such rows are all taken.
    some = docs.withColumn("_id", F.col(id_col).cast("long")).join(
        wanted.select(F.col("least_id").alias("_id")).distinct(), "_id", "left_semi")
    some = some.select(text_col).union(docs.filter(F.col(id_col).isNull()).select(text_col))
    sets = stages.write(shingle_sets(some, text_col, width).join(wanted.select("nid", "node"), "node")
                        .groupBy("nid").agg(F.first("shingles").alias("shingles")), "sets")

    lists = posts.groupBy("token").agg(F.count("*").alias("len"))
    short = posts.join(lists.filter(F.col("len") <= SHORT_LIST), "token")
    pairs = short.select("token", F.col("nid").alias("a")).join(short.select("token", F.col("nid").alias("b")), "token") \
        .filter("a < b").select("a", "b").distinct()
    edges, labels = stages.write(_confirm(pairs, nodes, sets, least, True), "edges-short"), None
    long = stages.write(posts.join(lists.filter(F.col("len") > SHORT_LIST).select("token"), "token"), "long")
    if long.isEmpty():
        labels = components(edges, stages, "short")
    else:
        for turn in range(HUB_ROUNDS):
            at = _labelled(long, labels)
            # First the node that shares most of its values: the likeliest centre; then others in hash order.
            order = F.col("shared") if turn == 0 else F.xxhash64(F.lit(turn), "nid")
            hubs = at.groupBy("token").agg(F.max(F.struct(order.alias("o"), F.col("nid").alias("a"), F.col("label").alias("la"))).alias("h"))
            pairs = at.join(hubs.select("token", "h.a", "h.la"), "token").filter("label <> la").select(
                F.least("a", "nid").alias("a"), F.greatest("a", "nid").alias("b")).distinct()
            edges = stages.write(edges.union(_confirm(pairs, nodes, sets, least, True)), f"edges-hub{turn}")
            labels = components(edges, stages, f"hub{turn}")
        at = _labelled(long, labels)
        open_ = at.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
        rest = at.join(open_.select("token"), "token", "left_semi").select("nid", "label").distinct()
        found = _residual(sets.join(rest, "nid"), stages, least)
        edges = stages.write(edges.union(_confirm(found, nodes, sets, least, False)), "edges-all")
        labels = components(edges, stages, "all")
    classes = nodes.join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    smallest = classes.groupBy("label").agg(F.min("least_id").alias("component"))
    by_node = stages.write(classes.join(smallest, "label").select("node", "label", "component"), "classes")
    stages.drop(*(set(stages.paths) - {"signed", "classes"}))
    return signed, by_node


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least=LEAST, width: int = WIDTH) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id of the class), kept (id = component_id)."""
    signed, by_node = _classes(docs, id_col, text_col, least, width, Stages(docs.sparkSession))
    return signed.join(by_node, "node", "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id")) \
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least=LEAST, width: int = WIDTH) -> DataFrame:
    """``docs`` with one row for each class, that of the smallest id (null ids last, then by
    the text's digest); rows without shingles all stay."""
    stages = Stages(docs.sparkSession)
    signed, by_node = _classes(docs, id_col, text_col, least, width, stages)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")
    stay = signed.filter("n_shingles > 0").join(by_node.select("node", "label"), "node").groupBy("label").agg(
        F.min(order).alias("first")).select("first.text_key")
    stay = stages.write(stay, "stay")
    rows = docs.select(F.struct("*").alias("row"), text_key(text_col), F.col(id_col).alias("id"),
                       whole(text_col).rlike(r"[^\x20\x09-\x0D]").alias("words"))
    # A row for each text first (on the map side already), so that copies of one text aren't moved.
    heads = rows.filter("words").groupBy("text_key").agg(F.min_by("row", F.struct(F.col("id").isNull(), F.col("id"))).alias("row"))
    kept = heads.join(stay.hint("merge"), "text_key", "left_semi").select("row")
    return kept.unionByName(rows.filter("not words").select("row")).select("row.*")
