"""Structured Streaming: score JSON request files as they arrive.

A request is a row and its answer is a row: ``readStream`` text files -> ``predict_rows`` (column
expressions and one Arrow kernel, with the model, the vocabularies and their vectors at the task) -> the
parquet sink, whose log makes a replayed batch (after a driver or executor loss) count once. No state, join,
shuffle or watermark.

Sources too many for the tasks (``predict.LOCAL_BYTES``) are joined instead: ``foreachBatch`` runs the bulk
plan on each micro-batch and writes it with overwrite of its own ``batch_id`` partition, so a replay rewrites the
same output. The answers are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.operators.order import global_position
from claimlens.operators.params import ModelParams
from claimlens.operators.predict import local_sources, predict_requests, predict_rows


def start_prediction_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, params: ModelParams,
                            vocab: DataFrame, tables: DataFrame, dim: int = 16, available_now: bool = True,
                            max_files_per_trigger: int | None = None):
    """Answers below ``out_dir``: claim_md5, logit, prob, prediction and, of lines that are no request
    (``ok`` false), raw; a row for each line."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.load(in_dir)
    sources = local_sources(params, vocab, tables)
    if sources is not None:
        w = predict_rows(src, params, sources, dim=dim).writeStream.format("parquet").option("path", out_dir).outputMode("append")
    else:
        w = src.writeStream.foreachBatch(_joined(out_dir, params, vocab, tables, dim))
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _joined(out_dir: str, params: ModelParams, vocab: DataFrame, tables: DataFrame, dim: int):
    def score_batch(batch: DataFrame, batch_id: int) -> None:
        # Equal lines are scored once, under a number in the order of their digests, and joined back to each.
        lines = batch.select("value", F.sha2("value", 256).alias("digest"))
        numbered = global_position(lines.dropDuplicates(["digest"]), ["digest"], name="req_id")
        out = predict_requests(numbered.select("req_id", "value"), params, vocab, tables, dim=dim)
        each = lines.select("digest").join(numbered.select("digest", "req_id"), "digest").select("req_id")
        good = each.join(out["predictions"], "req_id").select(F.lit(None).cast("string").alias("raw"), F.lit(True).alias("ok"), "claim_md5",
                                                              "logit", "prob", "prediction")
        bad = each.join(out["rejects"], "req_id").select("raw", F.lit(False).alias("ok"))
        good.unionByName(bad, allowMissingColumns=True).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
    return score_batch
