"""Experiment history: fold averages, epoch losses, stop rules.

History rows are long: (run, fold, epoch, split, metric, value). Fold average
is a plain grouped ``avg`` (folds of unequal length simply stop contributing).
The stop rules are windows per (run, fold) and one fold over its epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold_average(history: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per (metric, split, epoch) the mean over the folds that reached it."""
    by = by or ["metric", "split", "epoch"]
    return history.groupBy(*by).agg(F.avg("value").alias("value"),
                                    F.count(F.lit(1)).alias("n_folds"))


def epoch_losses(batches: DataFrame, group: list[str]) -> DataFrame:
    """Epoch loss = mean of batch means; rank part = total - class part.

    ``batches`` has one row per item with (group..., batch, loss, classify_loss)."""
    per_batch = batches.groupBy(*group, "batch").agg(
        F.avg("loss").alias("b_loss"), F.avg("classify_loss").alias("b_cls"))
    ep = per_batch.groupBy(*group).agg(F.avg("b_loss").alias("loss"),
                                       F.avg("b_cls").alias("classify_loss"),
                                       F.count(F.lit(1)).alias("n_batches"))
    return ep.withColumn("rank_loss", F.col("loss") - F.col("classify_loss"))


def stop_on_first_loss(history: DataFrame, group: list[str], metric: str = "loss",
                       split: str = "valid") -> DataFrame:
    """First epoch whose loss exceeds the loss of the group's first epoch
    (null when it never does)."""
    h = history.where((F.col("metric") == metric) & (F.col("split") == split))
    first = h.groupBy(*group).agg(F.min_by("value", "epoch").alias("_v0"))
    j = h.join(first, group)
    return j.groupBy(*group).agg(
        F.min(F.when(F.col("value") > F.col("_v0"), F.col("epoch"))).alias("stop_epoch"))


STOP_METRICS = {"train_loss": ("loss", "train"), "valid_loss": ("loss", "valid"),
                "f1": ("f1_macro", "valid"), "auc": ("auc", "valid")}


def _fold_facts(history: DataFrame, delta: float, gap: float) -> DataFrame:
    """Per (run, fold, epoch) what the stop rules ask of an epoch, as window columns.

    Epochs that lack one of the four metrics are left out: a value that was never
    recorded must not drive a stop."""
    wide = history.groupBy("run", "fold", "epoch").agg(
        *[F.max(F.when((F.col("metric") == m) & (F.col("split") == s), F.col("value"))).alias(c)
          for c, (m, s) in STOP_METRICS.items()]).dropna()
    by_epoch = Window.partitionBy("run", "fold").orderBy("epoch")
    earlier = by_epoch.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_epoch.rowsBetween(Window.unboundedPreceding, 0)
    floor = lambda c, w: F.greatest(F.lit(0.0), F.coalesce(F.max(c).over(w), F.lit(0.0)))
    near_best = (F.col("f1") > F.col("f1_before")) | (F.col("f1") >= F.col("f1_before") + delta)
    return (wide
            .withColumn("f1_before", floor("f1", earlier)).withColumn("best_f1", floor("f1", upto))
            # the checkpoint's auc only follows epochs whose f1 is good enough to be kept
            .withColumn("auc_kept", F.when(near_best, F.col("auc")))
            .withColumn("auc_before", floor("auc_kept", earlier)).withColumn("best_auc", floor("auc_kept", upto))
            .withColumn("saved", (F.col("f1") > F.col("f1_before")) | (near_best & (F.col("auc") >= F.col("auc_before"))))
            .withColumn("worse", F.col("f1") < F.col("f1_before") + delta)
            .withColumn("lowest_two", F.size(F.filter(F.collect_list("valid_loss").over(earlier),
                                                      lambda v: v < F.col("valid_loss"))) <= 1)
            .withColumn("above_first", F.col("valid_loss") > F.first("valid_loss").over(upto))
            .withColumn("apart", F.abs(F.col("valid_loss") - F.col("train_loss")) > gap))


def early_stopping(history: DataFrame, patience: int = 10, delta: float = -0.01,
                   gap: float = 0.02) -> DataFrame:
    """A row per epoch up to the one that ends training (run, fold, epoch, counter,
    saved, best_f1, best_auc, stop, reason).

    Training ends at the first epoch whose validation loss is above the first epoch's, or
    when ``patience`` epochs in a row had an f1 more than ``-delta`` under the best so far and
    the losses lie more than ``gap`` apart. A loss among the two lowest so far starts the count
    anew. The windows give each epoch's facts; only the count needs the order, as one fold
    over the epoch array of a fold (a few dozen entries)."""
    facts = _fold_facts(history, delta, gap)
    seen = ["epoch", "saved", "f1_before", "auc_before", "best_f1", "best_auc", "worse", "lowest_two", "above_first", "apart"]

    def one_epoch(state, x):
        run_of_worse = F.when(x["worse"] & ~x["lowest_two"], state["counter"] + 1).otherwise(0)
        tired = run_of_worse >= patience
        counter = F.when(x["above_first"], state["counter"]).when(tired & ~x["apart"], 0).otherwise(run_of_worse)
        reason = F.when(x["above_first"], "loss_above_first").when(tired & x["apart"], "patience")
        row = F.struct(
            x["epoch"].alias("epoch"), counter.alias("counter"), (x["saved"] & ~x["above_first"]).alias("saved"),
            F.when(x["above_first"], x["f1_before"]).otherwise(x["best_f1"]).alias("best_f1"),
            F.when(x["above_first"], x["auc_before"]).otherwise(x["best_auc"]).alias("best_auc"),
            reason.isNotNull().alias("stop"), reason.alias("reason"))
        ended = F.struct(counter.alias("counter"), reason.isNotNull().alias("over"),
                         F.concat(state["rows"], F.array(row)).alias("rows"))
        return F.when(state["over"], state).otherwise(ended)

    start = F.struct(F.lit(0).alias("counter"), F.lit(False).alias("over"), F.array().cast(
        "array<struct<epoch:int,counter:int,saved:boolean,best_f1:double,best_auc:double,stop:boolean,reason:string>>")
        .alias("rows"))
    folds = facts.groupBy("run", "fold").agg(F.array_sort(F.collect_list(F.struct(*seen))).alias("epochs"))
    return folds.select("run", "fold", F.inline(F.aggregate("epochs", start, one_epoch)["rows"]))
