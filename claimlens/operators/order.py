"""O3: global positions and prefix sums without a single-partition window.

Plan: range-partition on the order key, sort inside partitions, cut lineage in
the shared checkpoint folder (range bounds are sampled, so a recompute could
move rows between partitions), count per partition (one small row per
partition reaches the driver), and add each partition's offset to the row's
index inside its partition. The index comes from ``monotonically_increasing_id``
(partition id in the high bits), so unweighted positions stay JVM-side.
Weighted prefix sums run a running sum per partition in ``mapInPandas``.
"""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.session import cut_lineage


def _parts(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    return max(1, int(conf))


def _with_offsets(ranged: DataFrame, offsets: dict[str, list[int]]) -> DataFrame:
    """Add a column per entry: the row's partition's offset, from a table of one row per
    partition that is broadcast (16 bytes a partition and entry), however many there are."""
    names = list(offsets)
    per_part = ranged.sparkSession.createDataFrame(
        pd.DataFrame({"_part": range(len(offsets[names[0]])), **offsets}).astype("int64"),
        ", ".join(f"{c} long" for c in ["_part", *names]))
    return ranged.withColumn("_part", F.spark_partition_id().cast("long")) \
        .join(F.broadcast(per_part), "_part").drop("_part")


def global_position(df: DataFrame, order_cols: list, name: str | list = "pos",
                    n_parts: int | None = None, weight: str | list | None = None) -> DataFrame:
    """Add ``name``: 0-based position in the total order of ``order_cols``.

    With ``weight`` the value is the exclusive prefix sum of that column in the
    same order (position = weight 1). ``weight`` and ``name`` may be lists:
    several prefix sums come out of the same single pass. Ties keep an
    arbitrary but fixed order; pass a unique last key for a deterministic result.
    """
    n = _parts(df, n_parts)
    ranged = cut_lineage(df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols))
    nparts = ranged.rdd.getNumPartitions()
    if weight is None:
        counts = ranged.groupBy(F.spark_partition_id().alias("p")).count().collect()
        per = {r["p"]: r["count"] for r in counts}
        offsets = list(itertools.accumulate([per.get(i, 0) for i in range(nparts)], initial=0))[:-1]
        within = F.monotonically_increasing_id() - (F.spark_partition_id().cast("long") * (1 << 33))
        return _with_offsets(ranged.withColumn(name, within), {"_off": offsets}) \
            .withColumn(name, F.col(name) + F.col("_off")).drop("_off")
    weights = [weight] if isinstance(weight, str) else list(weight)
    names = [name] if isinstance(name, str) else list(name)
    sums = ranged.groupBy(F.spark_partition_id().alias("p")) \
        .agg(*[F.sum(w).alias(f"s{i}") for i, w in enumerate(weights)]).collect()  # one row per partition
    offs = {}
    for i in range(len(weights)):
        per = {r["p"]: (r[f"s{i}"] or 0) for r in sums}
        offs[f"_off{i}"] = list(itertools.accumulate([per.get(p, 0) for p in range(nparts)], initial=0))[:-1]
    with_off = _with_offsets(ranged, offs)
    schema = T.StructType(with_off.schema.fields + [T.StructField(nm, T.LongType()) for nm in names])

    def running(it):
        acc = None
        for pdf in it:
            if pdf.empty:
                continue
            if acc is None:
                acc = [int(pdf[f"_off{i}"].iloc[0]) for i in range(len(weights))]
            for i, (wname, nm) in enumerate(zip(weights, names)):
                w = pdf[wname].fillna(0).astype("int64")
                cs = w.cumsum()
                pdf[nm] = (acc[i] + cs - w).astype("int64")
                acc[i] += int(cs.iloc[-1])
            yield pdf

    return with_off.mapInPandas(running, schema).drop(*[f"_off{i}" for i in range(len(weights))])


def group_position(df: DataFrame, group_cols: list[str], order_cols: list, name: str | list = "gpos",
                   weight: str | list | None = None, n_parts: int | None = None) -> DataFrame:
    """Position (or exclusive weighted prefix sum) inside each group.

    Global prefix over (group, order) minus the group's first prefix: skew-safe,
    because a hot group spreads over several range partitions instead of one
    window task.
    """
    names = [name] if isinstance(name, str) else list(name)
    tmp = [f"_gp{i}" for i in range(len(names))]
    g = global_position(df, [*group_cols, *order_cols], name=tmp if len(tmp) > 1 else tmp[0],
                        n_parts=n_parts, weight=weight)
    first = g.groupBy(*group_cols).agg(*[F.min(t).alias(f"_g0{i}") for i, t in enumerate(tmp)])
    out = g.join(first, group_cols)
    for i, (t, nm) in enumerate(zip(tmp, names)):
        out = out.withColumn(nm, F.col(t) - F.col(f"_g0{i}")).drop(t, f"_g0{i}")
    return out


def trim_tail(df: DataFrame, order_cols: list, drop: int = 1, only_if_mod: int | None = None) -> DataFrame:
    """P10: drop the last ``drop`` rows in order (always, or only when
    ``n % only_if_mod == 1``). The count comes from the position pass."""
    g = global_position(df, order_cols, name="_tpos")
    n = g.agg(F.max("_tpos")).first()[0]
    n = 0 if n is None else n + 1
    if only_if_mod is not None and n % only_if_mod != 1:
        return g.drop("_tpos")
    return g.where(F.col("_tpos") < n - drop).drop("_tpos")

