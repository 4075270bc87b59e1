"""Token counts by a separator scan over flat token files.

A flat token file is a run of fixed-width token ids with an end-of-document id
after each document and no index. Files are cut into blocks, read by offset in
any order; each block is searched for the end id as one numpy array. A prefix
scan over the blocks of a file (the last separator so far, the number of
separators so far) then joins documents across block borders: a document may
begin in any earlier block and span many.

``write_tokens`` makes such files with Spark's text writer, whose line separator
is the end id's bytes: each partition is one file, committed like any other
output, in any store that Spark writes. With ``key_width`` each document begins
with its key in that many ids, which the scan reads back and doesn't count.

Cases: a null or empty text has 0 tokens; null ids come back as null; repeated
rows give repeated documents; a last document without end id counts, with ended =
false; a document may be longer than a block; an odd last byte is ignored; empty
input gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlens.llm.common import shared, whole
from claimlens.session import ship_package

END = 50_256
#: Ids that hold a document's key: five digits to the base END hold 64 bits and null.
KEY_WIDTH = 5
WIDTH = 2
BLOCK_BYTES = 4 << 20


@lru_cache(maxsize=2)
def encoding(ranks_file: str):
    import public_tokenizers
    import tiktoken
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def key_ids(key: int | None) -> list[int]:
    """A 64-bit key, or null, as KEY_WIDTH ids below END."""
    n = 0 if key is None else (2 * key if key >= 0 else -2 * key - 1) + 1
    out = []
    for _ in range(KEY_WIDTH):
        n, d = divmod(n, END)
        out.append(d)
    return out


def id_key(ids: list[int]) -> int | None:
    n = sum(d * END ** k for k, d in enumerate(ids))
    if not n:
        return None
    n -= 1
    return n // 2 if n % 2 == 0 else -(n + 1) // 2


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 ranks_file: str | None = None) -> None:
    """Flat files of 16-bit little-endian ids below ``path``, each document with its key before it."""
    ranks_file = ranks_file or default_ranks()

    def run(batches):
        enc = encoding(ranks_file)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([pa.array(
                    [np.array(key_ids(k) + enc.encode_ordinary(t), "<u2").tobytes()
                     for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())], pa.binary())], names=["ids"])

    flat = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text")).mapInArrow(run, "ids binary")
    end = np.array([END], "<u2").tobytes().decode("latin-1")
    flat.select(F.col("ids").cast("string").alias("value")).write.option("encoding", "ISO-8859-1") \
        .option("lineSep", end).text(path)


def scan_block(tokens: np.ndarray, ahead: np.ndarray, start: int, last: bool, key_width: int,
               end: int = END) -> tuple[list[int], list[int | None], bool]:
    """Separators of a block (in tokens from the file's start), the keys that follow them, and
    whether the last is real. ``ahead`` are the ids after the block that a key may need.

    The place before the file is a separator too; at the file's end an unended
    document gets one."""
    at = np.flatnonzero(tokens == end)
    seps = (at + start).tolist()
    if start == 0:
        seps.insert(0, -1)
    ended = True
    size = start + len(tokens)
    if last and size and (not len(at) or at[-1] != len(tokens) - 1):
        ended = False
        seps.append(size)
    keys: list[int | None] = []
    if key_width:
        both = np.concatenate([tokens, ahead])
        for s in seps:
            k = both[s + 1 - start:s + 1 - start + key_width].tolist()
            keys.append(id_key(k) if len(k) == key_width and end not in k else None)
    else:
        keys = [None] * len(seps)
    return seps, keys, ended


_BLOCKS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seps", pa.list_(pa.int64())),
                     ("keys", pa.list_(pa.int64())), ("ended", pa.bool_())])


def _scan(key_width: int, width: int, end: int):
    def run(batches):
        from pyarrow import fs
        for batch in batches:
            for file, size, block, offset, length in zip(*(batch.column(k).to_pylist() for k in range(5))):
                store, path = fs.FileSystem.from_uri(file.replace("file:/", "file:///", 1) if file.startswith("file:/") and not
                                                     file.startswith("file://") else file)
                with store.open_input_file(path) as f:
                    raw = f.read_at(min(length + key_width * width, size - offset), offset)
                kind = {2: "<u2", 4: "<u4"}[width]
                ids = np.frombuffer(raw[:len(raw) // width * width], kind)
                n = min(length // width, len(ids))
                seps, keys, ended = scan_block(ids[:n], ids[n:], offset // width, offset + length >= size // width * width,
                                               key_width, end)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((file, block, seps, keys, ended), _BLOCKS)],
                                                 schema=_BLOCKS)
    return run


def token_counts(spark: SparkSession, path: str, key_width: int = 0, width: int = WIDTH, end: int = END,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document of the flat files below ``path``: file, document (number in the file), start
    (in ids, of the document's text), n_tokens, key (null without keys), ended."""
    ship_package(spark)
    block_bytes -= block_bytes % width
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length") \
        .filter(F.col("length") >= width)
    blocks = files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.posexplode(F.sequence(
        F.lit(0).cast("long"), F.col("length") - width, F.lit(block_bytes).cast("long"))).alias("block", "offset"))
    blocks = blocks.select("file", "size", F.col("block").cast("long").alias("block"), "offset",
                           F.least(F.lit(block_bytes).cast("long"), F.col("size") - F.col("offset")).alias("length"))
    found = blocks.repartition("file", "block").mapInArrow(
        _scan(key_width, width, end), "file string, block long, seps array<long>, keys array<long>, ended boolean")
    # The prefix scan: one row a block; what the earlier blocks of the file hand on.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tail = F.when(F.size("seps") > 0, F.struct(F.element_at("seps", -1).alias("sep"), F.element_at("keys", -1).alias("key")))
    scanned = found.withColumn("tail", tail).withColumn("before", F.last("tail", ignorenulls=True).over(earlier)) \
        .withColumn("upto", F.coalesce(F.sum(F.size("seps")).over(earlier), F.lit(0).cast("long")))
    each = scanned.select("file", "before", "upto", "ended", "seps", "keys", F.posexplode("seps").alias("k", "sep"))
    from_ = F.when(F.col("k") > 0, F.struct(F.get("seps", F.col("k") - 1).alias("sep"), F.get("keys", F.col("k") - 1).alias("key"))) \
        .otherwise(F.col("before"))
    return each.filter("sep >= 0").withColumn("from", from_).select(
        "file", (F.col("upto") + F.col("k") - 1).alias("document"), (F.col("from.sep") + 1 + key_width).alias("start"),
        F.greatest(F.lit(0).cast("long"), F.col("sep") - F.col("from.sep") - 1 - key_width).alias("n_tokens"),
        F.col("from.key").alias("key"), (F.col("ended") | (F.col("k") < F.size("seps") - 1)).alias("ended"))


def document_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_file: str | None = None) -> DataFrame:
    """Per row: id and n_tokens, by way of flat token files in the shared folder."""
    ship_package(docs.sparkSession)
    path = shared(docs.sparkSession, "tokens")
    write_tokens(docs, path, id_col, text_col, ranks_file)
    return token_counts(docs.sparkSession, path, KEY_WIDTH).select(F.col("key").alias(id_col), "n_tokens")
