"""Sources and sinks: TSV evidence rows, ranked-evidence JSON, claim documents,
vocabularies, parameters, JSON requests and the metric history store.

Everything is read with an explicit schema (no inference) and written as
parquet between stages; JSON lines and TSV only at the edges.
"""

from __future__ import annotations

import csv
import json
import re
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# pandas' default NA tokens for read_csv (19 strings).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

EVIDENCE_COLUMNS = ["id_left", "id_right", "cred_label", "claim_text", "claim_source",
                    "evidence", "evidence_source"]

EVIDENCE_SCHEMA = T.StructType([
    T.StructField("id_left", T.LongType()),
    T.StructField("id_right", T.StringType()),
    T.StructField("cred_label", T.StringType()),
    T.StructField("claim_text", T.StringType()),
    T.StructField("claim_source", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("evidence_source", T.StringType()),
])

RANKED_RAW_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("evidences", T.ArrayType(T.ArrayType(T.StringType()))),
])

EVIDENCE_ITEM = T.StructType([
    T.StructField("evidence", T.StringType()),
    T.StructField("evidence_source", T.StringType()),
])

EXAMPLE_SCHEMA = T.StructType([
    T.StructField("cred_label", T.StringType()),
    T.StructField("claim_id", T.LongType()),
    T.StructField("claim", T.StringType()),
    T.StructField("claim_source", T.StringType()),
    T.StructField("evidences", T.ArrayType(EVIDENCE_ITEM)),
    T.StructField("correlation", T.ArrayType(T.DoubleType())),
])

REQUEST_SCHEMA = T.StructType([
    T.StructField("claim", T.StringType()),
    T.StructField("claim_source", T.StringType()),
    T.StructField("evidences", T.ArrayType(EVIDENCE_ITEM)),
    T.StructField("cred_label", T.StringType()),
])

TSV_OPTIONS = {"sep": "\t", "header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


# ---------------------------------------------------------------- S1 / S2 / U1
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def pick_files(spark: SparkSession, data_dir: str, pattern: str) -> list[str]:
    """Entries of ``data_dir`` whose name matches ``pattern`` as a regex prefix.

    Only the directory listing is read (Hadoop FS, no data opened); names are
    sorted so the pick is deterministic. No match is an error, as in the source.
    """
    fs, p = _fs(spark, data_dir)
    rx = re.compile(pattern)
    names = sorted(st.getPath().getName() for st in fs.listStatus(p))
    picked = [data_dir.rstrip("/") + "/" + n for n in names if rx.match(n)]
    if not picked:
        raise FileNotFoundError(f"no entry of {data_dir} matches {pattern!r}")
    return picked


def read_evidence_tsv(spark: SparkSession, paths: list[str] | str,
                      schema: T.StructType = EVIDENCE_SCHEMA,
                      columns: list[str] | None = None,
                      with_order: bool = False, multi_line: bool = True) -> DataFrame:
    """Tab-separated evidence rows, bound by the names in each file's header.

    Paths are files or folders; each file's own header counts, in a folder, too.
    Columns may come in any order and among others; one that is missing is an
    error. Cells are read as text, NA tokens become null (S3), then cells are
    cast to ``schema``; what can't be cast becomes null and is listed by
    ``bad_cells``. Files with the same header are one multi-path scan (U1).

    ``multi_line=False`` lets Spark split large files, for files without line
    breaks inside quotes.

    ``with_order`` adds ``file_order``, a sortable struct that keeps the file
    order pandas would keep: (picked-path index, file in a folder, split offset, row in split).
    Spark packs splits by size, so the plain row id alone is not file order.
    """
    raw = na_normalise(_read_by_name(spark, paths, [f.name for f in schema.fields], with_order, multi_line))
    typed = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields],
                       *(["file_order"] if with_order else []))
    cols = columns or [f.name for f in schema.fields]
    return typed.select(*cols, *(["file_order"] if with_order else []))


def bad_cells(spark: SparkSession, paths: list[str] | str, schema: T.StructType = EVIDENCE_SCHEMA,
              multi_line: bool = True) -> DataFrame:
    """(column, cell, n): cells that aren't NA and can't be cast to the column's type."""
    raw = na_normalise(_read_by_name(spark, paths, [f.name for f in schema.fields], False, multi_line))
    typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    cells = F.filter(F.array(*[F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.struct(
        F.lit(f.name).alias("column"), F.col(f.name).alias("cell"))) for f in typed]), lambda x: x.isNotNull())
    return raw.select(F.inline(cells)).groupBy("column", "cell").agg(F.count(F.lit(1)).alias("n"))


class DataFile(NamedTuple):
    """A file below the ``place``-th path, the ``part``-th there by name, and its header's cells."""
    place: int
    part: int
    path: str
    header: tuple[str, ...]


def data_files(spark: SparkSession, paths: list[str]) -> list[DataFile]:
    """The files below ``paths`` that Spark would read, with their headers.

    The listing and a file's first line are all that is read, through the Hadoop file system from the
    driver, some files at a time; no Spark job."""
    found = []
    for place, path in enumerate(paths):
        fs, p = _fs(spark, path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        each, names = fs.listFiles(p, True), []
        root = fs.makeQualified(p).toUri().getPath().rstrip("/")
        while each.hasNext():
            st = each.next()
            uri = st.getPath().toUri()
            inside = [x for x in uri.getPath()[len(root):].split("/") if x]
            if st.getLen() and not any(x[0] in "._" and "=" not in x for x in inside):
                names.append(uri.toString())
        found += [(place, part, name) for part, name in enumerate(sorted(names))]
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda f: _header(spark, f[2]), found))
    return [DataFile(*f, h) for f, h in zip(found, headers)]


def _header(spark: SparkSession, uri: str) -> tuple[str, ...]:
    """The cells of the first line that isn't empty."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    raw = path.getFileSystem(conf).open(path)
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(raw if codec is None else codec.createInputStream(raw), "UTF-8"))
    try:
        line = lines.readLine()
        while line is not None and not line.strip():
            line = lines.readLine()
    finally:
        lines.close()
    return tuple(next(csv.reader([line.lstrip("\ufeff")], delimiter="\t"))) if line is not None else ()


def _read_by_name(spark: SparkSession, paths: list[str] | str, names: list[str], with_order: bool,
                  multi_line: bool) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    options = {**TSV_OPTIONS, "multiLine": str(multi_line).lower()}
    files = [f for f in data_files(spark, paths) if f.header]
    alike: dict[tuple, list[DataFile]] = {}
    for f in files:
        alike.setdefault(f.header, []).append(f)
    meta = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row")] if with_order else []
    out = spark.createDataFrame([], ", ".join([*(f"`{c}` string" for c in names), *(["_path string, _block long, _row long"] if with_order else [])]))
    for header, same in alike.items():
        if missing := [c for c in names if header.count(c) != 1]:
            raise ValueError(f"{same[0].path}: no column, or several, of the name {', '.join(missing)} in {', '.join(header)}")
        # Cells are bound by place, so only the names that are asked for need to be the header's.
        text = T.StructType([T.StructField(c if c in names else f"_c{i}", T.StringType()) for i, c in enumerate(header)])
        part = spark.read.schema(text).options(**options).csv([_plain(spark, f.path) for f in same])
        out = out.unionByName(part.select(*[F.col(f"`{c}`").alias(c) for c in names], *meta))
    if not with_order:
        return out
    # A row a file: joined by the whole path, as files of one name may lie in several folders.
    places = spark.createDataFrame([(_slashes(f.path), f.place, f.part) for f in files], "_at string, _place int, _part int")
    order = F.struct(F.col("_place").alias("file"), F.col("_part").alias("part"), F.col("_block").alias("block"), F.col("_row").alias("row"))
    at = F.regexp_replace("_path", "^([A-Za-z0-9+.-]+):/+", "$1:/")
    return out.join(places, at == F.col("_at")).select(*names, order.alias("file_order"))


def _plain(spark: SparkSession, uri: str) -> str:
    """A file's name as Spark's reader takes it: not percent-encoded, glob characters as they are."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(uri)).toString()
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", name)


def _slashes(uri: str) -> str:
    return re.sub("^([A-Za-z0-9+.-]+):/+", r"\1:/", uri)


def scan_files(spark: SparkSession, data_dir: str, pattern: str, **kw) -> DataFrame:
    """S1 + S2 + U1: pick by regex prefix, then read all picked files at once."""
    return read_evidence_tsv(spark, pick_files(spark, data_dir, pattern), **kw)


def write_evidence_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**TSV_OPTIONS).csv(path)


# ---------------------------------------------------------------- S3
def na_normalise(df: DataFrame, columns: list[str] | None = None,
                 tokens: list[str] = NA_TOKENS) -> DataFrame:
    """pandas NA-token semantics: any of ``tokens`` in a string column -> null."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    out = df
    for c in cols:
        out = out.withColumn(c, F.when(F.col(c).isin(tokens), F.lit(None)).otherwise(F.col(c)))
    return out


# ---------------------------------------------------------------- S4
def read_ranked_evidence(spark: SparkSession, path: str, topk: int | None = None) -> DataFrame:
    """Ranked evidence JSON lines -> (id, evidences ARRAY<STRUCT<snippet, score>>).

    Pairs are mixed-type JSON arrays, read as strings and cast. Duplicate ids:
    the last line wins (``max_by`` over the file position, partial aggregate).
    """
    raw = (spark.read.schema(RANKED_RAW_SCHEMA).json(path)
           .withColumn("_line", F.struct(F.col("_metadata.file_name").alias("f"),
                                         F.col("_metadata.file_block_start").alias("b"),
                                         F.monotonically_increasing_id().alias("o"))))
    return ranked_from_raw(raw, topk)


def ranked_from_raw(raw: DataFrame, topk: int | None = None) -> DataFrame:
    arr = F.col("evidences")
    if topk is not None:
        arr = F.slice(arr, 1, topk)
    lists = F.transform(arr, lambda e: F.struct(
        F.get(e, 0).alias("snippet"), F.get(e, 1).cast("double").alias("score")))
    dedup = raw.groupBy("id").agg(F.max_by(lists, F.col("_line")).alias("evidences"))
    return dedup


def write_ranked_evidence(lists: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Inverse of S4: one JSON line ``{id, evidences: [[snippet, score], ...]}``, scores as numbers."""
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r"^\{\"v\":(.*)\}$", 1)
    pairs = F.transform("evidences", lambda e: F.concat(
        F.lit("["), text(e["snippet"]), F.lit(","), F.coalesce(e["score"].cast("string"), F.lit("null")), F.lit("]")))
    line = F.concat(F.lit('{"id":'), text(F.col("id")), F.lit(',"evidences":['), F.array_join(pairs, ","), F.lit("]}"))
    lists.select(line.alias("value")).write.mode(mode).text(path)


def explode_ranked(lists: DataFrame) -> DataFrame:
    """(id, evidences) -> (id, pos, snippet, score), pos = list position."""
    return lists.select("id", F.posexplode("evidences").alias("pos", "e")).select(
        "id", "pos", F.col("e.snippet").alias("snippet"), F.col("e.score").alias("score"))


# ---------------------------------------------------------------- S5 / S6
def write_claim_examples(examples: DataFrame, path: str, fmt: str = "json") -> None:
    """One document per claim; ``mode('ignore')`` keeps an existing result, and
    the path carries dataset and fold so two datasets never share a file."""
    ev = F.transform("evidences", lambda e: F.struct(e["evidence"].alias("evidence"),
                                                      e["evidence_source"].alias("evidence_source")))
    corr = F.transform("evidences", lambda e: e["correlation"])
    out = examples.select("cred_label", "claim_id", "claim", "claim_source",
                          ev.alias("evidences"), corr.alias("correlation"))
    out.write.mode("ignore").format(fmt).save(path)


def read_claim_examples(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Read claim documents back into the nested ``examples`` shape."""
    df = spark.read.schema(EXAMPLE_SCHEMA).format(fmt).load(path)
    ev = F.zip_with("evidences", "correlation", lambda e, c: F.struct(
        e["evidence"].alias("evidence"), e["evidence_source"].alias("evidence_source"),
        c.alias("correlation")))
    return df.select("cred_label", "claim_id", "claim", "claim_source", ev.alias("evidences"))


# ---------------------------------------------------------------- S7
def write_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").partitionBy("kind").parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("kind", "value", "idx")


# ---------------------------------------------------------------- S8
def write_params(params, tables: DataFrame, path: str) -> None:
    """Parameter table (name, i, vec): a row for each row of a matrix or of a source table, by name; the
    tables' rows come from Spark, the matrices (model-sized) from the driver. Also the model's meta data."""
    from claimlens.operators.source_tables import KINDS
    spark = tables.sparkSession
    dense = spark.createDataFrame([(n, i, [float(x) for x in row]) for n, m in params.mats.items() for i, row in enumerate(m)],
                                  "name string, i int, vec array<double>")
    names = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    rows = dense.unionByName(tables.select(names[F.col("kind")].alias("name"), F.col("idx").cast("int").alias("i"), "vec"))
    rows.write.mode("overwrite").partitionBy("name").parquet(f"{path}/rows")
    spark.createDataFrame([(json.dumps(params.meta()),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_param_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").select("name", "i", "vec")


def read_params(spark: SparkSession, path: str):
    """The matrices, and the source tables as (kind, idx, vec)."""
    import numpy as np

    from claimlens.operators.params import ModelParams
    from claimlens.operators.source_tables import KINDS
    rows, mats = read_param_rows(spark, path), {}
    for r in rows.filter(~F.col("name").isin(list(KINDS.values()))).orderBy("name", "i").collect():  # model-sized
        mats.setdefault(r["name"], []).append(r["vec"])
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    kinds = F.create_map(*(F.lit(x) for k, n in KINDS.items() for x in (n, k)))
    tables = rows.filter(F.col("name").isin(list(KINDS.values()))).select(kinds[F.col("name")].alias("kind"), F.col("i").alias("idx"), "vec")
    return ModelParams(mats={n: np.array(m, dtype=np.float64) for n, m in mats.items()}, **meta).check_size(), tables


# ---------------------------------------------------------------- S9
def parse_requests(df: DataFrame, col: str = "value", keep_bad: bool = False):
    """JSON request strings -> (good requests, rejects). Bad JSON is reported,
    never scored; a request needs a claim and an evidence list.

    With ``keep_bad`` one table, with a column ``ok``."""
    schema = T.StructType(REQUEST_SCHEMA.fields + [T.StructField("_bad", T.StringType())])
    parsed = df.withColumn("_req", F.from_json(col, schema, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = (F.col("_req").isNull() | F.col("_req._bad").isNotNull()
           | F.col("_req.claim").isNull() | F.col("_req.evidences").isNull())
    keep = [c for c in df.columns if c != col]
    if keep_bad:
        ok = F.coalesce(~bad, F.lit(False)).alias("ok")
        return parsed.select(*keep, ok, "_req.claim", "_req.claim_source", "_req.evidences", "_req.cred_label")
    good = parsed.where(~bad).select(*keep, "_req.claim", "_req.claim_source",
                                     "_req.evidences", "_req.cred_label")
    rejects = parsed.where(bad).select(*keep, F.col(col).alias("raw"))
    return good, rejects


# ---------------------------------------------------------------- S10
RECORD_SCHEMA = "run string, fold int, epoch int, split string, metric string, value double"


def append_records(records: DataFrame, path: str) -> None:
    records.select("run", "fold", "epoch", "split", "metric", "value") \
        .write.mode("append").partitionBy("run").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("run", "fold", "epoch", "split", "metric", "value")
