"""T4: k-fold training with vocabularies, parameters and stop rules of each fold's own.

All folds train in the same steps: ``run`` is the fold, a column of features, vocabularies and
source tables. The co-attention features don't depend on the sources, so they are cut
once; what a fold may know of the sources comes from its train split alone (sources it
hasn't seen read row 0), and its table has as many rows as its vocabulary. Each epoch all folds
are evaluated by one pass, and the stop rules run over all of them. A fold publishes the parameters of the
last epoch that its rules saved (W9), not the last one it ran.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.operators import source_tables as ST
from claimlens.operators import training as TR
from claimlens.operators.history import early_stopping
from claimlens.operators.params import ModelParams
from claimlens.operators.scoring import source_vocab
from claimlens.session import cut_lineage
from claimlens.sources.files import read_params, write_params

METRICS = ("loss", "classify_loss", "rank_loss", "accuracy", "auc", "f1_macro", "f1_micro",
           "precision_0", "precision_1", "recall_0", "recall_1", "f1_0", "f1_1")
RECORD = "run string, fold int, epoch int, split string, metric string, value double"


def fold_claims(claims: DataFrame, folds: int) -> DataFrame:
    """Each claim once a fold (``run``) with its split there: 'valid' is common, a claim's own fold its test."""
    each = claims.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return each.withColumn("split", F.when(F.col("split") == "valid", "valid").when(F.col("fold") == F.col("run"), "test").otherwise("train"))


def fold_features(slots: DataFrame, claims: DataFrame, evidence: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per fold and claim its slots and source indices under the fold's vocabulary."""
    code = lambda rows, kind, col, name: rows.join(
        vocab.filter(F.col("kind") == kind).select(F.col("run").alias("_r"), F.col("value").alias("_v"), F.col("idx").alias("_i")),
        (F.col("run") == F.col("_r")) & (F.col(col) == F.col("_v")), "left") \
        .withColumn(name, F.coalesce("_i", F.lit(0))).drop("_r", "_v", "_i")
    sourced = slots.join(evidence.select("claim_id", "evi_pos", "evidence_source"), ["claim_id", "evi_pos"], "left")
    coded = code(sourced.join(claims.select("run", "claim_id"), "claim_id"), "evidence", "evidence_source", "evidence_src_idx")
    own = code(claims, "claim", "claim_source", "claim_src_idx")
    return TR.claim_features(coded, own.select("run", "claim_id", "label", "claim_src_idx", "split"))


def cross_validate(slots: DataFrame, claims: DataFrame, evidence: DataFrame, params: ModelParams, folds: int,
                   epochs: int, lr: float, save_dir: str, run: str = "cv", patience: int = 10,
                   init: Callable[[DataFrame, ModelParams], DataFrame] = ST.formula_tables,
                   batches: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Metric history (run, fold, epoch, split, metric, value) of all folds.

    ``claims`` has claim_id, claim_source, label, split ('valid' is common to all folds) and
    fold; ``slots`` the claims' evidence slots without source indices. The folds' vocabularies and
    published parameters go below ``save_dir`` (``read_fold``). Metrics that aren't defined (AUC of one
    class) are not recorded."""
    spark = claims.sparkSession
    own = fold_claims(claims, folds)
    train = own.filter(F.col("split") == "train")
    vocab = cut_lineage(source_vocab(train, evidence.join(train.select("run", "claim_id"), "claim_id"), by=["run"]))
    vocab.write.mode("overwrite").partitionBy("run", "kind").parquet(f"{save_dir}/vocab")
    feats = cut_lineage(fold_features(slots, own, evidence, vocab))
    records: list[tuple] = []
    best: dict[int, tuple] = {}

    def evaluate(epoch: int, ps: dict[int, ModelParams], tables: DataFrame) -> list[int]:
        over = {r for r, (_, _, _, stopped) in best.items() if stopped}
        live = feats.filter(~F.col("run").isin(list(over))) if over else feats
        scored = cut_lineage(TR.head_scores(live, ps, tables, keep=["run", "split"]))
        for r in TR.epoch_metrics(scored, ["run", "split"]).collect():  # a row per fold and split
            records.extend((run, r["run"], epoch, r["split"], m, float(r[m])) for m in METRICS if r[m] is not None)
        told = early_stopping(spark.createDataFrame(records, RECORD), patience).filter(F.col("epoch") == epoch)
        told = {r["fold"]: r for r in told.collect()}  # a row per fold
        for f in set(ps) - over:
            saved = f not in best or f not in told or told[f]["saved"]
            best[f] = ((epoch, ps[f], tables) if saved else best[f][:3]) + (f in told and told[f]["stop"],)
        return [f for f, (_, _, _, stopped) in best.items() if stopped]

    start = init(vocab, params)
    TR.train_runs(feats.filter(F.col("split") == "train"), {f: params for f in range(folds)}, start, epochs=epochs, lr=lr,
                  on_epoch=evaluate, batches=batches)
    for f, (_, p, tables, _) in best.items():
        write_params(p, tables.filter(F.col("run") == f), f"{save_dir}/params/run={f}")
    return spark.createDataFrame(records, RECORD)


def read_fold(spark: SparkSession, save_dir: str, fold: int) -> tuple[ModelParams, DataFrame, DataFrame]:
    """A fold's published parameters, source tables and vocabulary."""
    params, tables = read_params(spark, f"{save_dir}/params/run={fold}")
    vocab = spark.read.parquet(f"{save_dir}/vocab").filter(F.col("run") == fold).select("kind", "value", "idx")
    return params, tables, vocab
