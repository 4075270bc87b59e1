"""Batching as columns.

There is no batch object: a batch is a ``batch_id`` column. Orders come from
the global-position pass (range partitioned), random orders from seeded
``xxhash64`` so a retried task draws the same order as the first attempt.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators.order import global_position, group_position


def length_buckets(df: DataFrame, length: str, key: str, bucket_size: int = 256) -> DataFrame:
    """O1: position in (length, key) order, bucket = floor(pos / bucket_size)."""
    pos = global_position(df, [length, key], name="len_pos")
    return pos.withColumn("bucket", (F.col("len_pos") / bucket_size).cast("long"))


def seeded_key(*parts) -> "F.Column":
    """Deterministic pseudo-random 60-bit key from md5 of ``seed:part:...``;
    the same on every task retry, and reproducible in plain SQL."""
    text = F.concat_ws(":", *[p if not isinstance(p, (int, str)) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def bucket_order(buckets: DataFrame, key: str, seed: int = 42, epoch: int = 0,
                 batch_size: int = 32) -> DataFrame:
    """O2: buckets shuffled once (seeded), rows inside a bucket per epoch; the
    serving order is cut into batches of ``batch_size``."""
    shuffled = buckets.withColumn("_bk", seeded_key(seed, F.col("bucket"))) \
        .withColumn("_rk", seeded_key(seed, epoch, F.col(key)))
    pos = global_position(shuffled, ["_bk", "bucket", "_rk", key], name="serve_pos")
    return (pos.withColumn("batch_id", (F.col("serve_pos") / batch_size).cast("long"))
            .drop("_bk", "_rk"))


def balanced_batches(df: DataFrame, label: str, key: str, batch_size: int = 32,
                     remainder_class: int | None = None, seed: int = 42, epoch: int = 0,
                     shuffle: bool = False, start: dict | None = None) -> DataFrame:
    """Class-quota batches -> (batch_id, label, slot, batch_slot, key).

    quota_c = floor(batch * share_c); the remainder goes to one class (picked
    by the seed unless given). ceil(n / batch) batches; slot k of batch b in
    class c takes the class row at position (start_c + b*quota_c + k) mod n_c,
    i.e. the class list is reused cyclically, offsets carried from batch to
    batch as in the offset loop. Slots are generated from a distributed
    ``range`` of batch ids and a literal per-class plan (no join, no cross
    product), then one equi-join on (class, position) fetches the rows.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class
    classes = sorted(counts)
    n = sum(counts.values())
    spark = df.sparkSession
    ltype = df.schema[label].dataType.simpleString()
    if n == 0:
        return spark.createDataFrame([], f"batch_id long, {label} {ltype}, slot int, "
                                         f"batch_slot int, {key} long")
    quota = {c: math.floor(batch_size * counts[c] / n) for c in classes}
    rc = remainder_class if remainder_class is not None else classes[seed % len(classes)]
    quota[rc] += batch_size - sum(quota.values())
    before, acc = {}, 0
    for c in classes:
        before[c], acc = acc, acc + quota[c]
    n_batches = (n + batch_size - 1) // batch_size
    start = start or {}
    if shuffle:
        ordered = df.withColumn("_o", F.xxhash64(F.lit(seed), F.lit(epoch), F.col(key)))
        pos = group_position(ordered, [label], ["_o", key], name="cpos").drop("_o")
    else:
        pos = group_position(df, [label], [key], name="cpos")
    plan = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(int(quota[c])).alias("q"),
                              F.lit(int(counts[c])).alias("n"), F.lit(int(start.get(c, 0))).alias("s"),
                              F.lit(int(before[c])).alias("b"))
                     for c in classes if quota[c] > 0])
    slots = (spark.range(n_batches).withColumnRenamed("id", "batch_id")
             .select("batch_id", F.explode(plan).alias("p"))
             .select("batch_id", F.col("p.c").cast(ltype).alias(label), "p.q", "p.n", "p.s", "p.b",
                     F.posexplode(F.array_repeat(F.lit(0), F.col("p.q"))).alias("slot", "_z"))
             .withColumn("cpos", (F.col("s") + F.col("batch_id") * F.col("q") + F.col("slot"))
                         % F.col("n"))
             .withColumn("batch_slot", (F.col("b") + F.col("slot")).cast("int")))
    return (slots.join(pos.select(label, "cpos", key), [label, "cpos"])
            .select("batch_id", label, F.col("slot").cast("int").alias("slot"), "batch_slot", key))


def batch_shape(examples: DataFrame, batch: str, n_evidence: str, max_evidence_len: str,
                floor_evidence: int = 5) -> DataFrame:
    """Per batch the longest evidence, the most evidences (at least 5)."""
    return examples.groupBy(batch).agg(
        F.max(max_evidence_len).alias("max_evi_len"),
        F.greatest(F.lit(floor_evidence), F.max(n_evidence)).alias("max_evi_num"),
        F.count(F.lit(1)).alias("n_claims"))
