"""Exact dedup by an extendible-hash index on shared files (DataFrame functions only).

Index entries are distinct 64-bit text hashes, reduced on the map side first, so
copies of one text (a third of all rows, say) never overfill a bucket. The
directory starts at the depth that the number of entries calls for and doubles
(one more hash bit) as long as a bucket holds more than ``capacity`` entries;
only overfull buckets are split again. Owner tasks then take contiguous ranges
of the directory and write their buckets to the shared folder, sorted.

Entries with more than one row are chained: their texts are grouped by their
bytes, so that two texts with the same hash become two links of one chain, each
with its own survivor.

Cases: null text counts as empty; empty texts are copies of one another; rows
without id join their group but only stay if no other row has an id (keep_id is
then null); an id that repeats with the same text counts once per row; empty
input gives an empty result. Other columns are never read by ``exact_copies``;
``drop_copies`` carries them along whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import Stages, whole

#: Entries (40 bytes each) that a bucket holds before it is split.
CAPACITY = 16_384
#: Rows of the index that one owner task writes.
OWNER_ROWS = 1 << 20


def slot(h: Column | str, depth: int) -> Column:
    """Directory slot: the first ``depth`` bits of the hash."""
    h = F.col(h) if isinstance(h, str) else h
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, stages: Stages, capacity: int) -> tuple[DataFrame, int, int]:
    """Buckets (prefix, depth, n_entries), the global depth and the entry count."""
    total = entries.count()
    depth = min(64, max(0, math.ceil(math.log2(max(1, total / capacity)))))
    level = stages.write(entries.groupBy(slot("h", depth).alias("prefix")).agg(F.count("*").alias("n_entries")),
                         f"level{depth}", 1)
    done = level.filter(F.col("n_entries") <= capacity).withColumn("depth", F.lit(depth))
    while depth < 64:
        over = level.filter(F.col("n_entries") > capacity)
        if over.isEmpty():
            break
        split = entries.join(over.select(F.col("prefix").alias("_over")), slot("h", depth) == F.col("_over"),
                             "left_semi")
        depth += 1  # the directory doubles
        level = stages.write(split.groupBy(slot("h", depth).alias("prefix")).agg(F.count("*").alias("n_entries")),
                             f"level{depth}", 1)
        done = done.unionByName(level.filter(F.col("n_entries") <= capacity).withColumn("depth", F.lit(depth)))
    return done, depth, total


def build_index(entries: DataFrame, stages: Stages, capacity: int = CAPACITY) -> DataFrame:
    """Entries with their bucket, in files of contiguous directory ranges.

    ``entries`` needs column ``h`` (distinct); other columns are kept."""
    buckets, depth, total = directory(entries, stages, capacity)
    span = F.shiftleft(F.lit(1).cast("long"), 0) if depth == 0 else F.expr(f"shiftleft(1L, {depth} - depth)")
    slots = buckets.select("prefix", "depth", F.explode(F.sequence(
        F.col("prefix") * span, F.col("prefix") * span + span - 1)).alias("slot"))
    owners = max(1, math.ceil(total / OWNER_ROWS), int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
                 if total > capacity else 1)
    placed = entries.withColumn("slot", slot("h", depth)).join(slots, "slot")
    return stages.write(placed.select(F.col("prefix").alias("bucket"), "depth", *entries.columns)
                        .repartitionByRange(owners, "bucket", "h").sortWithinPartitions("bucket", "h"), "index")


def _hash(text: Column, bits: int) -> Column:
    h = F.xxhash64(text)
    return h if bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - bits), 64 - bits)


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 hash_bits: int = 64) -> DataFrame:
    """Per row: id, keep_id (largest id among equal texts), group_size, text_sha256.

    ``hash_bits`` below 64 makes collisions (for tests of the chains)."""
    stages = Stages(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    rows = rows.withColumn("h", _hash(F.col("text"), hash_bits))
    # One pass over the texts; 50 bytes a row stay.
    keyed = stages.write(rows.select("id", "h", F.unhex(F.sha2("text", 256)).alias("sha")), "keyed")
    entries = stages.write(keyed.groupBy("h").agg(F.count("*").alias("n_rows"), F.max("id").alias("keep_id")), "entries")
    index = build_index(entries, stages, capacity)
    chained = index.filter("n_rows > 1").select("h")
    # Rows of entries with several rows: grouped by their bytes, one link for each different text. The keys
    # grow with the input, so they are never broadcast; grouping by text, not hash, lets a hot key be split.
    links = stages.write(rows.join(chained.hint("merge"), "h", "left_semi").groupBy("text").agg(
        F.first("h").alias("h"), F.max("id").alias("link_keep"), F.count("*").alias("link_rows"))
        .select("h", F.unhex(F.sha2("text", 256)).alias("sha"), "link_keep", "link_rows"), "links")
    stages.drop(*(set(stages.paths) - {"keyed", "links"}))
    return keyed.join(links, ["h", "sha"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("link_rows").isNull(), F.col("id")).otherwise(F.col("link_keep")).alias("keep_id"),
        F.coalesce("link_rows", F.lit(1).cast("long")).alias("group_size"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``docs`` with one row for each different text: that with the largest id
    (among rows with the same id and text, the one whose other columns sort last)."""
    stages = Stages(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), whole(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    entries = stages.write(rows.groupBy("h").agg(F.count("*").alias("n_rows")), "entries")
    index = build_index(entries, stages, capacity)
    chained = index.filter("n_rows > 1").select("h")
    rest = [F.col(f"row.`{f.name}`") for f in docs.schema.fields
            if f.name not in (id_col, text_col) and isinstance(f.dataType, T.AtomicType)]
    chained = chained.hint("merge")
    alone = rows.join(chained, "h", "left_anti").select("row")
    heads = (rows.join(chained, "h", "left_semi").groupBy("text")
             .agg(F.max_by("row", F.struct("id", *rest)).alias("row")).select("row"))
    return alone.unionByName(heads).select("row.*")
