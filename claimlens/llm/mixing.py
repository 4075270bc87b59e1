"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Each source's rows are cut into blocks. With integer weights a_s and A = sum of
a_s, block j of source s may run in slots [floor(j A / a_s), ceil((j+1) A / a_s)):
its release time and deadline. Earliest deadline first then gives every block a
slot in its window, so that after any slot t each source has had its share
t a_s / A to within less than one block.

The windows repeat after A slots, so the schedule is worked out once for A slots
(a table of A rows whose size depends on the weights alone) and block j of
source s gets slot (j div a_s) A + table[s, j mod a_s]; no step walks over the
blocks. A grows with the number of sources, the work per slot with the number of
different weights only. All rows stay: when a source has run out, its slots stay
empty and the others keep their order and ratios.

A row's place inside its source comes from the md5 of its id, counted in small
hash ranges, so a source with a third of all rows is never sorted in one task. Rows
without id, which all have the same md5, are dealt to parts of their range by
their place in the input (any order among them gives the same result). Rows that share an
id do share a range.

Cases: a null source is a source of its own; null ids are placed like the empty
string; repeated rows get places of their own; empty input gives an empty
result; one source alone gets slots 0, 1, 2, ...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.common import Stages, let

BLOCK_ROWS = 64
#: Slots of a period, about (each source gets at least one): the larger of RESOLUTION and SOURCE_UNITS a source.
RESOLUTION, SOURCE_UNITS = 1000, 50
#: Parts that the rows without id of a hash range are dealt to.
NULL_PARTS = 4096
#: Rows in a hash range of a source.
RANGE_ROWS = 1024


def weights(counts: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """(source, n_rows, units): target weights as the square root of the rows, so that large
    sources don't drown small ones, in ``resolution`` units, or SOURCE_UNITS a source if those are
    more, dealt by largest remainder (ties: the source that sorts first). Each source gets at least one."""
    root = F.floor(F.sqrt(F.col("n_rows") * 1_000_000)).cast("long")
    # A row a source: windows over all of them are as small as their number.
    total = Window.partitionBy()
    shares = counts.withColumn("root", root).withColumn("all_roots", F.sum("root").over(total)).withColumn(
        "res", F.greatest(F.lit(resolution), F.count("*").over(total) * SOURCE_UNITS).cast("long"))
    whole = shares.withColumn("least", F.expr("res * root div all_roots")).withColumn("rest", F.expr("res * root % all_roots"))
    place = F.row_number().over(total.orderBy(F.desc("rest"), F.col("source").asc_nulls_first()))
    left = F.col("res") - F.sum("least").over(total)
    return whole.withColumn("more", F.when(place <= left, 1).otherwise(0)).select(
        "source", "n_rows", F.greatest(F.lit(1).cast("long"), F.col("least") + F.col("more")).cast("long").alias("units"))


def _div(a: Column, b: Column) -> Column:
    return ((a - a % b) / b).cast("long")


def schedule(units: DataFrame) -> DataFrame:
    """(source, turn, slot, period): the slots of one period by earliest deadline first.

    ``units`` is a table of (source, units), one row a source. Sources of equal units are
    one class: their turns have the same windows and run in the order of the sources, so a
    class's state is the number of its turns that ran. One fold over the period's slots, in
    chunks, keeps it; in each slot the released turn with the earliest deadline runs, ties
    going to the source that sorts first. The runs of a class are dealt to its sources by a join."""
    named = units.select(F.col("source").isNotNull().alias("named"), "source", F.col("units").cast("long").alias("units"))
    numbered = named.withColumn("i", (F.row_number().over(Window.orderBy("named", "source")) - 1).cast("long")).withColumn(
        "p", (F.row_number().over(Window.partitionBy("units").orderBy("named", "source")) - 1).cast("long"))
    classes = numbered.groupBy("units").agg(F.array_sort(F.collect_list("i")).alias("members"))
    one = classes.agg(F.array_sort(F.collect_list(F.struct(
        "units", F.size("members").cast("long").alias("m"), "members"))).alias("s")).filter(F.size("s") > 0).withColumn(
            "period", F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc + x["units"] * x["m"])).withColumn(
            "sources", F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc + x["m"])).withColumn(
            "chunk", F.ceil(F.sqrt("period")).cast("long"))

    def step(state: Column, t: Column) -> Column:
        # key = (deadline * number of sources + source) and the class, of what is released and not yet through
        def key(x: Column, c: Column) -> Column:
            n = F.get(state["next"], c)
            turn = _div(n, x["m"])
            return F.when((turn < x["units"]) & (_div(turn * F.col("period"), x["units"]) <= t), F.struct(
                (_div((turn + 1) * F.col("period") + x["units"] - 1, x["units"]) * F.col("sources")
                 + F.get(x["members"], (n % x["m"]).cast("int"))).alias("k"), c.alias("c")))

        return let(F.array_min(F.transform("s", key))["c"], lambda c: F.struct(
            F.transform(state["next"], lambda n, i: n + F.when(i == c, 1).otherwise(0)).alias("next"),
            F.concat(state["ran"], F.array(c)).alias("ran")))

    none = F.array().cast("array<int>")

    def chunk(state: Column, first: Column) -> Column:
        slots = F.sequence(first, F.least(first + F.col("chunk"), F.col("period")) - 1)
        return let(F.aggregate(slots, F.struct(state["next"].alias("next"), none.alias("ran")), step), lambda x: F.struct(
            x["next"].alias("next"), F.concat(state["ran"], F.array(x["ran"])).alias("ran")))

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("next"),
                     F.array().cast("array<array<int>>").alias("ran"))
    firsts = F.sequence(F.lit(0).cast("long"), F.col("period") - 1, F.col("chunk"))
    ran = one.select("s", "period", F.flatten(F.aggregate(firsts, start, chunk)["ran"]).alias("ran"))
    units_of = F.transform("s", lambda x: x["units"])
    slots = ran.select(units_of.alias("u"), "period", F.posexplode("ran").alias("slot", "c")).select(
        F.get("u", F.col("c")).alias("units"), "period", "slot")
    nth = (F.row_number().over(Window.partitionBy("units").orderBy("slot")) - 1).cast("long")
    of = numbered.select(F.col("units").alias("_u"), "source", "p")
    sizes = classes.select(F.col("units").alias("_u"), F.size("members").cast("long").alias("_m"))
    turns = slots.withColumn("nth", nth).join(sizes, F.col("units") == F.col("_u")).drop("_u").select(
        "units", "slot", "period", F.expr("nth % _m").alias("_p"), F.expr("nth div _m").alias("turn"))
    return turns.join(of, (F.col("units") == F.col("_u")) & (F.col("_p") == F.col("p"))).select(
        "source", F.col("turn").cast("long").alias("turn"), F.col("slot").cast("long").alias("slot"), "period")


def _place(rows: DataFrame, units: DataFrame, stages: Stages, block_rows: int) -> DataFrame:
    """``rows`` (source, id, ...) with block, turn and within-block place, and the slot."""
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    ranges = F.expr(f"(n_rows + {RANGE_ROWS - 1}) div {RANGE_ROWS}")
    shares = units.select(F.col("source").alias("_s"), "units", "n_rows")  # a row a source: Spark broadcasts it if it is small
    placed = rows.join(shares, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("key", key).withColumn(
        "range", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), ranges))
    # Before, among and after the rows without id, whose md5 is that of the empty string.
    none = F.md5(F.lit(""))
    part = F.when(F.col("id").isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(NULL_PARTS))).when(F.col("key") < none, 0) \
        .otherwise(NULL_PARTS + 1).cast("long")
    placed = placed.withColumn("part", part)
    sizes = placed.groupBy("source", "range", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stages.write(sizes.select("source", "range", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")),
                          "starts")
    inside = Window.partitionBy("source", "range", "part").orderBy("key", "id")
    placed = placed.withColumn("place", F.row_number().over(inside) - 1)
    starts = starts.select(F.col("source").alias("_s"), F.col("range").alias("_r"), F.col("part").alias("_p"), "start")
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r"))
                         & (F.col("part") == F.col("_p"))).drop("_s", "_r", "_p")
    placed = placed.withColumn("at", F.col("start") + F.col("place")).withColumn("block", F.expr(f"at div {block_rows}")) \
        .withColumn("within", F.expr(f"at % {block_rows}"))
    plan = stages.write(schedule(units), "plan", 1).withColumnsRenamed({"source": "_s2", "slot": "_slot"})
    return placed.join(plan, F.col("source").eqNullSafe(F.col("_s2")) & (F.pmod(F.col("block"), F.col("units")) == F.col("turn"))) \
        .withColumn("slot", F.expr("block div units") * F.col("period") + F.col("_slot"))


def _units(docs: DataFrame, source_col: str, target: DataFrame | None, resolution: int, stages: Stages) -> DataFrame:
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_rows"))
    if target is None:
        found = weights(counts, resolution)
    else:  # given units; a source without any gets one
        t = target.select(F.col("source").alias("_s"), F.col("units").cast("long").alias("_u"))
        found = counts.join(t, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "n_rows", F.greatest(F.lit(1).cast("long"), F.coalesce("_u", F.lit(1))).alias("units"))
    return stages.write(found, "units", 1)


def mixed_slots(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", target: DataFrame | None = None,
                block_rows: int = BLOCK_ROWS, resolution: int = RESOLUTION) -> DataFrame:
    """Per row: id, source, block, place in the block, slot, release and deadline (long).

    ``target`` (source, units) sets the weights; without it ``weights`` does."""
    stages = Stages(docs.sparkSession)
    units = _units(docs, source_col, target, resolution, stages)
    placed = _place(docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id")), units, stages, block_rows)
    return placed.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("block").cast("long").alias("block"),
        F.col("within").cast("long").alias("place"), F.col("slot").cast("long").alias("slot"),
        F.expr("block * period div units").cast("long").alias("release"),
        F.expr("((block + 1) * period + units - 1) div units").cast("long").alias("deadline"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", target: DataFrame | None = None,
        block_rows: int = BLOCK_ROWS, resolution: int = RESOLUTION) -> DataFrame:
    """``docs`` in mixed order: range-partitioned and sorted by slot, so files written
    from it, read in name order, follow the schedule. Every row and column stays."""
    stages = Stages(docs.sparkSession)
    units = _units(docs, source_col, target, resolution, stages)
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("id"))
    placed = _place(rows, units, stages, block_rows).select("row", "slot", "within")
    return placed.repartitionByRange("slot", "within").sortWithinPartitions("slot", "within").select("row.*")
