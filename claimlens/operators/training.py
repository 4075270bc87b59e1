"""Data-parallel training of the scoring head.

The co-attention features (c_hat, e_hat per slot) are computed once with the
frozen encoder side (``score_claims`` slots) and cut into the shared
checkpoint folder. Trained are the affinity weights and the two head layers (dense, on the
driver) and the source embeddings (a table); the loss is ``alpha * ListNet + BCE``.

A step reads its batch's claims, joins the source vectors that they need, and runs the
backward pass (written out by hand, checked against finite differences) on whole Arrow
batches. Each task returns sums: of the dense gradients, one row a matrix, and of the
embeddings' gradients, one row for each source that its claims name. They are
summed by ``groupBy``; the dense sums come to the driver, the others are joined to the table, whose
Adam moments are columns. The table never leaves the executors; weight decay moves every
row of it, as in the dense optimizer.

Several runs (folds) train in the same steps: ``run`` is a column of the features, the table and the
gradient rows, and each run has its own dense parameters.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions import dense as D
from claimlens.operators import source_tables as ST
from claimlens.operators.attention import broadcast_params
from claimlens.operators.batching import balanced_batches, bucket_order, length_buckets
from claimlens.operators.params import ModelParams
from claimlens.operators.scoring import flat, lists, sizes
from claimlens.session import cut_lineage, stage_path

DENSE = ["affinity_w", "fc1_w", "fc1_b", "fc3_w", "fc3_b"]


def claim_features(slots: DataFrame, claims: DataFrame) -> DataFrame:
    """Per claim its slots (bounded by the claim's evidence list) and the columns of ``claims``:
    claim_id, label, claim_src_idx[, run, split, ...]. With a column ``run``, slots have it, too."""
    if "correlation" not in slots.columns:
        slots = slots.withColumn("correlation", F.lit(-1.0))
    keys = [c for c in ("run", "claim_id") if c in slots.columns]
    gathered = slots.groupBy(*keys).agg(F.collect_list(F.struct(
        F.col("evi_pos").cast("int").alias("evi_pos"), "c_hat", "e_hat",
        F.col("evidence_src_idx").cast("int").alias("evidence_src_idx"),
        F.col("correlation").cast("double").alias("correlation"), "padded")).alias("slots"))
    return gathered.join(claims, keys)


# -------------------------------------------------- source vectors of claims
def _needed(feats: DataFrame, params: ModelParams) -> DataFrame:
    """(run, claim_id, kind, idx[, batch_id]): the table rows that a claim's pass reads."""
    keys = [c for c in ("run", "claim_id", "batch_id") if c in feats.columns]
    rows = {"claim": F.array("claim_src_idx"), "evidence": F.array_distinct(F.transform("slots", lambda s: s["evidence_src_idx"]))}
    each = F.array(*(F.struct(F.lit(k).alias("kind"), rows[k].alias("idxs")) for k in ST.kinds(params)))
    return feats.select(*keys, F.inline(each)).select(*keys, "kind", F.explode("idxs").alias("idx"))


def with_vectors(feats: DataFrame, needed: DataFrame, tables: DataFrame, params: ModelParams) -> DataFrame:
    """Features with ``vecs``: the claim's source vectors by kind and index."""
    if not ST.kinds(params):
        return feats.withColumn("vecs", F.array().cast("array<struct<kind:string,idx:int,vec:array<double>>>"))
    vecs = needed.join(tables.select("run", "kind", "idx", "vec"), ["run", "kind", "idx"]).groupBy("run", "claim_id").agg(
        F.collect_list(F.struct("kind", "idx", "vec")).alias("vecs"))
    return feats.join(vecs, ["run", "claim_id"])


class Batch(NamedTuple):
    """A run's claims of an Arrow batch as arrays; see ``dense.head_loss``."""
    args: dict
    src: np.ndarray | None  # (claims, slots) evidence source indices
    claim_src: np.ndarray


def _arrays(b: pa.RecordBatch, p: ModelParams, rows: np.ndarray) -> Batch:
    b = b.take(pa.array(rows))
    slots, n = b.column("slots"), sizes(b.column("slots"))
    f = dict(zip([x.name for x in slots.type.value_type], slots.flatten().flatten()))
    row, shape = np.repeat(np.arange(len(n)), n), (len(n), int(n.max()))
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    put = lambda c, fill=0: D.padded(f[c].to_numpy(zero_copy_only=False), row, at, shape, fill)
    there = D.padded(np.ones(len(row), bool), row, at, shape, False)
    src, claim_src = put("evidence_src_idx"), b.column("claim_src_idx").to_numpy(zero_copy_only=False)
    args = {"c": D.padded(flat(f["c_hat"], p.hidden_dim), row, at, shape), "e": D.padded(flat(f["e_hat"], p.hidden_dim), row, at, shape),
            "there": there, "pad": put("padded", False), "pos": put("evi_pos"), "t": put("correlation", 0.0),
            "y": b.column("label").to_numpy(zero_copy_only=False).astype(np.float64), "cs": None, "es": None}
    vecs, m = b.column("vecs"), sizes(b.column("vecs"))
    v = dict(zip([x.name for x in vecs.type.value_type], vecs.flatten().flatten()))
    of, kind, idx = np.repeat(np.arange(len(m)), m), v["kind"].to_numpy(zero_copy_only=False), v["idx"].to_numpy(zero_copy_only=False)
    for name in ST.kinds(p):
        own = np.flatnonzero(kind == name)
        key = of[own].astype(np.int64) << 32 | idx[own]
        by = np.argsort(key)
        have = flat(v["vec"].take(pa.array(own[by])), ST.width(p, name))
        if name == "claim":
            args["cs"] = have  # one a claim, in the claims' order
        else:
            found = np.searchsorted(key[by], row.astype(np.int64) << 32 | f["evidence_src_idx"].to_numpy(zero_copy_only=False))
            args["es"] = D.padded(have[found], row, at, shape)
    return Batch(args, src, claim_src)


def _by_run(b: pa.RecordBatch):
    """(run, rows) of an Arrow batch."""
    run = b.column("run").to_numpy(zero_copy_only=False)
    for r in np.unique(run):
        yield int(r), np.flatnonzero(run == r)


def _by_index(idx: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of ``g`` by index."""
    used, at = np.unique(idx, return_inverse=True)
    out = np.zeros((len(used), g.shape[1]))
    np.add.at(out, at, g)
    return used, out


GRADS = "run int, name string, idx int, g array<double>"


def gradient_rows(feats: DataFrame, params: dict[int, ModelParams], alpha: float) -> DataFrame:
    """(run, name, idx, g): sums over the claims of a task. Dense matrices (idx -1) and sources by
    index; the name ``loss`` has the number of claims, of BCE and of the rank loss."""
    bc = feats.sparkSession.sparkContext.broadcast({r: p.check_size() for r, p in params.items()})

    def run(batches):
        acc: dict = {}

        def add(key, value):
            acc[key] = acc[key] + value if key in acc else value

        for b in batches:
            for r, rows in _by_run(b) if len(b) else ():
                p = bc.value[r]
                x = _arrays(b, p, rows)
                got = D.head_loss(**x.args, p=p, alpha=alpha)
                add((r, "loss", -1), np.array([len(rows), got["bce"].sum(), got["rank"].sum()]))
                for name, g in got["grads"].items():
                    add((r, name, -1), g.ravel())
                if "cs" in got:
                    for i, g in zip(*_by_index(x.claim_src, got["cs"])):
                        add((r, "claim", int(i)), g)
                if "es" in got:
                    src = np.take_along_axis(x.src, got["top"], axis=1)
                    for i, g in zip(*_by_index(src.ravel(), got["es"].reshape(src.size, -1))):
                        add((r, "evidence", int(i)), g)
            if len(acc) > 1 << 14:  # a task holds so many sources' sums at most, and those of one batch
                yield _grad_batch(acc)
                acc.clear()
        if acc:
            yield _grad_batch(acc)

    return feats.select("run", "slots", "claim_src_idx", "label", "vecs").mapInArrow(run, GRADS)


def _grad_batch(acc: dict) -> pa.RecordBatch:
    runs, names, idx = zip(*acc)
    return pa.RecordBatch.from_arrays([
        pa.array(runs, pa.int32()), pa.array(names), pa.array(idx, pa.int32()),
        lists(np.concatenate(list(acc.values())), np.array([len(g) for g in acc.values()]))], names=["run", "name", "idx", "g"])


# ---------------------------------------------------------------- optimizer
class Optimizer:
    """Adam (weight decay on all but biases) or plain SGD; others rejected."""

    def __init__(self, name: str, lr: float, weight_decay: float = 0.0, betas=(0.9, 0.999), eps: float = 1e-8):
        if name not in ("Adam", "SGD"):
            raise NotImplementedError(name)
        self.name, self.lr, self.wd, self.b1, self.b2, self.eps = name, lr, weight_decay, *betas, eps

    def dense(self, state: "RunState", grads: dict) -> "RunState":
        """One step of a run's matrices."""
        mats, m, v, t = dict(state.params.mats), dict(state.m), dict(state.v), state.t + 1
        for n, g in grads.items():
            theta = mats[n]
            if self.name == "SGD":
                mats[n] = theta - self.lr * g
                continue
            if not n.endswith("_b"):
                g = g + self.wd * theta
            m[n] = self.b1 * m.get(n, 0.0) + (1 - self.b1) * g
            v[n] = self.b2 * v.get(n, 0.0) + (1 - self.b2) * g * g
            mats[n] = theta - self.lr * (m[n] / (1 - self.b1 ** t)) / (np.sqrt(v[n] / (1 - self.b2 ** t)) + self.eps)
        return RunState(state.params.copy_with(mats), m, v, t)

    def table(self, tables: DataFrame, sums: DataFrame, n: dict[int, float], t: dict[int, int]) -> DataFrame:
        """The same step of the source tables, a join: rows without a gradient decay. ``n`` and ``t``
        are the claims and the number of the step, by run; runs without claims stay as they are."""
        per = F.create_map(*(F.lit(x) for r in n for x in (int(r), float(n[r]))))
        step = F.create_map(*(F.lit(x) for r in n for x in (int(r), float(t[r]))))
        own = tables.filter(F.col("run").isin([int(r) for r in n]))
        j = own.join(sums.select("run", F.col("name").alias("kind"), "idx", "g"), ["run", "kind", "idx"], "left")
        j = j.withColumn("_n", per[F.col("run")]).withColumn("_t", step[F.col("run")])
        zeros = F.transform("vec", lambda x: F.lit(0.0))
        g = F.transform(F.coalesce("g", zeros), lambda x: x / F.col("_n"))
        if self.name == "SGD":
            new = j.withColumn("vec", F.zip_with("vec", g, lambda x, y: x - self.lr * y))
        else:
            mix = lambda b, power: lambda x, y: b * x + (1 - b) * (y * y if power == 2 else y)
            move: Callable[[Column, Column], Column] = lambda m, v: (
                m / (1 - F.pow(F.lit(self.b1), F.col("_t"))) / (F.sqrt(v / (1 - F.pow(F.lit(self.b2), F.col("_t")))) + self.eps))
            new = j.withColumn("g", F.zip_with(g, "vec", lambda x, y: x + self.wd * y)) \
                .withColumn("m", F.zip_with("m", "g", mix(self.b1, 1))).withColumn("v", F.zip_with("v", "g", mix(self.b2, 2))) \
                .withColumn("vec", F.zip_with("vec", F.zip_with("m", "v", move), lambda x, y: x - self.lr * y))
        rest = tables.filter(~F.col("run").isin([int(r) for r in n]))
        return new.select(*tables.columns).unionByName(rest)


class RunState(NamedTuple):
    """A run's matrices and Adam moments."""
    params: ModelParams
    m: dict
    v: dict
    t: int


def moments(tables: DataFrame) -> DataFrame:
    """Source tables with Adam moments of zero."""
    zeros = F.transform("vec", lambda x: F.lit(0.0))
    return tables.withColumn("m", zeros).withColumn("v", zeros)


# --------------------------------------------------------------- checkpoints
def _save_epoch(spark, save_dir: str, epoch: int, states: dict[int, RunState], tables: DataFrame, history: list[dict]) -> None:
    """A finished epoch: the tables, then a row for each dense matrix and moment; the marker of the
    latter's folder (_SUCCESS) tells a complete epoch from a torn one."""
    tables.write.mode("overwrite").parquet(f"{save_dir}/epoch={epoch}/tables")
    rows = [(r, f"{kind}{n}", list(np.shape(m)), [float(x) for x in np.ravel(m)])
            for r, s in states.items() for kind, store in (("", s.params.mats), ("adam_m:", s.m), ("adam_v:", s.v)) for n, m in store.items()]
    meta = json.dumps({"params": next(iter(states.values())).params.meta(), "t": {r: s.t for r, s in states.items()}, "history": history})
    (spark.createDataFrame(rows, "run int, name string, shape array<int>, values array<double>")
     .withColumn("meta", F.lit(meta)).coalesce(1).write.mode("overwrite").parquet(f"{save_dir}/epoch={epoch}/dense"))


def _load_latest(spark, save_dir: str):
    """(epoch, states, tables, history) of the newest complete epoch, or None."""
    from claimlens.sources.files import _fs
    fs, p = _fs(spark, save_dir)
    if not fs.exists(p):  # any other trouble with the store must not look like a fresh start
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    done = [int(n.split("=", 1)[1]) for n in names if n.startswith("epoch=") and fs.exists(path(f"{save_dir}/{n}/dense/_SUCCESS"))]
    if not done:
        return None
    at = f"{save_dir}/epoch={max(done)}"
    rows = spark.read.parquet(f"{at}/dense").collect()  # model-sized
    meta = json.loads(rows[0]["meta"])
    found: dict = {}
    for r in rows:
        found.setdefault(r["run"], {})[r["name"]] = np.array(r["values"], dtype=np.float64).reshape(r["shape"])
    states = {}
    for run, mats in found.items():
        part = lambda k: {n[len(k):]: x for n, x in mats.items() if n.startswith(k)}  # noqa: B023, E731
        own = {n: x for n, x in mats.items() if not n.startswith("adam_")}
        states[run] = RunState(ModelParams(mats=own, **meta["params"]), part("adam_m:"), part("adam_v:"), meta["t"][str(run)])
    return max(done), states, spark.read.parquet(f"{at}/tables"), meta["history"]


# ----------------------------------------------------------------- batches
def class_quota_batches(feats: DataFrame, batch_size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(run, claim_id, batch_id, times): O4's class-quota batches of each run's claims; a claim that a
    small class gives twice to a batch counts twice."""
    runs = [r[0] for r in feats.select("run").distinct().orderBy("run").collect()]  # folds
    each = [balanced_batches(feats.filter(F.col("run") == r).select("claim_id", "label"), "label", "claim_id", batch_size, seed=seed,
                             epoch=epoch, shuffle=True).withColumn("run", F.lit(r)) for r in runs]
    every = each[0]
    for more in each[1:]:
        every = every.unionByName(more)
    return every.groupBy("run", "claim_id", "batch_id").agg(F.count(F.lit(1)).cast("int").alias("times"))


def bucket_batches(feats: DataFrame, batch_size: int, length: Column, bucket_size: int = 256, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(run, claim_id, batch_id, times): O1 / O2's batches of claims of like length, over the claims of all runs."""
    one = feats.select("claim_id", length.alias("_len")).distinct()
    served = bucket_order(length_buckets(one, "_len", "claim_id", bucket_size), "claim_id", seed, epoch, batch_size)
    return feats.select("run", "claim_id").join(served.select("claim_id", "batch_id"), "claim_id") \
        .select("run", "claim_id", "batch_id", F.lit(1).alias("times"))


def _laid_out(feats: DataFrame, batches: DataFrame | None) -> tuple[DataFrame, int]:
    """Features with batch_id, written in its order, so that a step's filter reads its own row groups;
    and the number of batches. Without ``batches`` all claims are one."""
    if batches is None:
        return cut_lineage(feats.withColumn("batch_id", F.lit(0).cast("long"))), 1
    twice = feats.join(batches, ["run", "claim_id"]).withColumn("_again", F.explode(F.sequence(F.lit(1), "times"))).drop("_again", "times")
    import uuid
    path = stage_path(feats.sparkSession, f"train-batches-{uuid.uuid4().hex[:12]}")
    twice.repartitionByRange("batch_id", "claim_id").sortWithinPartitions("batch_id").write.parquet(path)
    laid = feats.sparkSession.read.parquet(path)
    last = laid.agg(F.max("batch_id")).first()[0]
    return laid, 0 if last is None else last + 1


# ---------------------------------------------------------------- training
def train_runs(features: DataFrame, params: dict[int, ModelParams], tables: DataFrame, epochs: int = 2, lr: float = 1.5e-4,
               optimizer: str = "Adam", weight_decay: float = 1e-3, alpha: float = 0.01,
               batches: Callable[[DataFrame, int], DataFrame] | None = None, on_epoch=None,
               save_dir: str | None = None) -> tuple[dict[int, ModelParams], DataFrame, list[dict]]:
    """T1 + T2 of several runs at once: (parameters by run, tables, per-epoch train records).

    ``features``: run, claim_id, slots, claim_src_idx, label. ``tables``: run, kind, idx, vec.
    ``batches(features, epoch)`` gives an epoch's batches (run, claim_id, batch_id, times); without it
    an epoch is one step over all claims. Every gradient of every batch is used (the source's
    accumulation dropped some, Q18). ``on_epoch(epoch, params, tables)`` runs after each epoch and
    returns the runs that end with it.

    With ``save_dir`` (a folder in the shared file system) every finished epoch is written there, and a
    restarted call resumes after the newest complete epoch with the same parameters and moments."""
    spark = features.sparkSession
    feats = cut_lineage(features.select("run", "claim_id", "slots", "claim_src_idx", "label"))
    opt = Optimizer(optimizer, lr, weight_decay)
    states = {r: RunState(p, {}, {}, 0) for r, p in params.items()}
    tables = cut_lineage(moments(tables))
    history: list[dict] = []
    first, over = 0, set()
    if save_dir and (state := _load_latest(spark, save_dir)) is not None:
        last, states, tables, history = state
        first = last + 1
    one = next(iter(params.values()))
    whole = None if batches else _laid_out(feats, None)
    for epoch in range(first, epochs):
        active = feats.filter(~F.col("run").isin(list(over))) if over else feats
        laid, n_batches = whole if whole and not over else _laid_out(active, batches(active, epoch) if batches else None)
        needed = cut_lineage(_needed(laid, one)) if ST.kinds(one) else None
        total: dict = {}
        for b in range(n_batches):
            part = laid.filter(F.col("batch_id") == b)
            need = None if needed is None else needed.filter(F.col("batch_id") == b).drop("batch_id").distinct()
            rows = gradient_rows(with_vectors(part, need, tables, one), {r: s.params for r, s in states.items()}, alpha)
            sums = cut_lineage(rows.groupBy("run", "name", "idx").agg(Summarizer.sum(array_to_vector("g")).alias("s"))
                               .select("run", "name", "idx", vector_to_array("s").alias("g")))
            dense: dict = {}
            for r in sums.filter("idx = -1").collect():  # a row for each matrix and run
                dense.setdefault(r["run"], {})[r["name"]] = np.array(r["g"])
            n = {}
            for run, got in dense.items():
                size, bce, rank = got.pop("loss")
                n[run] = size
                grads = {k: got[k].reshape(states[run].params[k].shape) / size for k in DENSE}
                states[run] = opt.dense(states[run], grads)
                total.setdefault(run, []).append(((alpha * rank + bce) / size, bce / size))
            if n and needed is not None:
                tables = cut_lineage(opt.table(tables, sums.filter("idx >= 0"), n, {r: states[r].t for r in n}))
        for run, means in sorted(total.items()):
            loss, cls = np.mean(means, axis=0)
            history.append({"run": run, "epoch": epoch, "loss": float(loss), "classify_loss": float(cls), "rank_loss": float(loss - cls)})
        if save_dir:
            _save_epoch(spark, save_dir, epoch, states, tables, history)
        if on_epoch is not None:
            over |= set(on_epoch(epoch, {r: s.params for r, s in states.items()}, tables.select("run", "kind", "idx", "vec")) or ())
            if over >= set(states):
                break
    return {r: s.params for r, s in states.items()}, tables.select("run", "kind", "idx", "vec"), history


def train_head(features: DataFrame, params: ModelParams, tables: DataFrame, on_epoch=None, **how) -> tuple[ModelParams, DataFrame, list[dict]]:
    """``train_runs`` of one run: (parameters, tables, records)."""
    ends = None if on_epoch is None else lambda epoch, ps, ts: {0} if on_epoch(epoch, ps[0], ts.drop("run")) else ()
    got, trained, history = train_runs(features.withColumn("run", F.lit(0)), {0: params}, tables.withColumn("run", F.lit(0)), on_epoch=ends, **how)
    return got[0], trained.drop("run"), history


def head_scores(features: DataFrame, params: dict[int, ModelParams] | ModelParams, tables: DataFrame, alpha: float = 0.01,
                keep: list[str] | None = None) -> DataFrame:
    """Forward only: (claim_id, logit, prob, label, bce, rank) per claim, and the columns ``keep``;
    with parameters by run, ``run`` is one of them."""
    runs = params if isinstance(params, dict) else {0: params}
    if not isinstance(params, dict):
        features, tables = features.withColumn("run", F.lit(0)), tables.withColumn("run", F.lit(0))
    bc = features.sparkSession.sparkContext.broadcast({r: p.check_size() for r, p in runs.items()})
    one, keep = next(iter(runs.values())), list(keep or [])
    more = "".join(f", {c} {features.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for b in batches:
            for r, rows in _by_run(b) if len(b) else ():
                p = bc.value[r]
                got = D.head_loss(**_arrays(b, p, rows).args, p=p, alpha=alpha, need_grad=False)
                own = b.take(pa.array(rows))
                z = got["logit"]
                yield pa.RecordBatch.from_arrays([
                    own.column("claim_id"), pa.array(z), pa.array(1.0 / (1.0 + np.exp(-z))), pc.cast(own.column("label"), pa.int32()),
                    pa.array(got["bce"]), pa.array(got["rank"]), *(own.column(c) for c in keep)],
                    names=["claim_id", "logit", "prob", "label", "bce", "rank", *keep])

    feats = with_vectors(features, _needed(features, one), tables, one)
    columns = ["run", "claim_id", "slots", "claim_src_idx", "label", "vecs", *(c for c in keep if c != "run")]
    return feats.select(*columns).mapInArrow(run, "claim_id long, logit double, prob double, label int, bce double, rank double" + more)


def epoch_metrics(scores: DataFrame, by: str | list[str] = "split", alpha: float = 0.01) -> DataFrame:
    """T5: per split (and run) loss parts, the confusion metrics and AUC (which needs a sort of its own)."""
    from claimlens.operators import metrics as MX
    by = [by] if isinstance(by, str) else list(by)
    s = scores.withColumn("prediction", (F.col("prob") > 0.5).cast("int"))
    base = s.groupBy(*by).agg(F.avg("bce").alias("classify_loss"), F.avg("rank").alias("listnet"))
    base = base.withColumn("loss", F.col("classify_loss") + alpha * F.col("listnet")) \
               .withColumn("rank_loss", F.col("loss") - F.col("classify_loss"))
    prf = MX.prf_from_counts(MX.confusion_counts(s, by))
    right = ((F.col("tp_0") + F.col("tp_1")) / F.col("n")).alias("accuracy")
    auc = MX.roc_auc(s, by, score="prob")
    return (base.join(prf.select(*by, "n", right, "f1_macro", "f1_micro", "precision_0", "precision_1",
                                 "recall_0", "recall_1", "f1_0", "f1_1"), by).join(auc, by))
