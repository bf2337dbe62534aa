"""Token ids as ORC files: sorted by document id, integer run-length encoding, row indexes and Bloom filters on the ids.

Written files hold ranges of document ids in ascending order. Readers can take any stripe by itself, and a look-up of
single documents skips files, stripes and row groups by their statistics and Bloom filters.

Defined results: a null text is empty (only the end id); a null id is kept and sorts first; repeated ids and rows are
kept, rows of one id ordered by text hash; an empty table gives files with a schema and no rows; other columns of the
documents, whatever their names, are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import give_back, pick, slices
from pairloom.llm.tokens import encoder

FILE_SCHEMA = "doc_id long, ids array<int>, file int, before long, n int"
#: Characters encoded at once: large, since a larger piece has fewer distinct words beside its words. Bounds a call's arrays to about 200 MB.
ENCODE_CHARS = 12_000_000


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", stripe_bytes: int = 64 << 20, index_rows: int = 2000, bloom_fpp: float = 0.01, special_as_text: bool = True) -> None:
    """Encode every text, append end_id and write one ORC file for each range of ids.

    The texts are dealt out by range of (id, text hash, position), so that even rows of one id spread over files;
    they are encoded behind that shuffle, which moves texts, about half as large as their ids.
    before: the ids that the file holds ahead of the row; n: those of the row.
    """

    def encoded(batches):
        from pyspark import TaskContext

        file, before, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer, special_as_text).encode
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in slices(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)), ENCODE_CHARS, 1 << 16):
                flat, offsets = encode([x or "" for x in texts.slice(a, b - a).to_pylist()])
                # each text's ids, then the end id
                sizes = np.diff(offsets)
                ids = np.insert(flat, offsets[1:], end_id).astype(np.int32)
                bounds = offsets + np.arange(len(offsets))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), lists, pa.array(np.full(b - a, file, np.int32)), pa.array(before + bounds[:-1]), pa.array((sizes + 1).astype(np.int32))], ["doc_id", "ids", "file", "before", "n"])
                before += int(sizes.sum()) + b - a
        give_back()

    order = [F.col("doc_id"), F.xxhash64("text"), F.col("at")]
    rows = pick(docs, doc_id=key, text=text).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("at", F.monotonically_increasing_id())
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(encoded, FILE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", bloom_fpp)
        .option("orc.row.index.stride", index_rows)
        .option("orc.stripe.size", stripe_bytes)
        .option("compression", "lz4")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, ids, file, before, n: all rows, or those of some documents, by predicates that ORC's indexes answer."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back stripe by stripe from the files.

    start needs the sizes of the files before: one row a file is summed up, from narrow columns.
    """

    def digest(batches):
        for batch in batches:
            lists = batch.column(1)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "file", "before", "n_tokens", "ids_crc32"])

    rows = read_token_files(spark, path)
    made = rows.select("doc_id", "ids", "file", "before").mapInArrow(digest, "doc_id long, file int, before long, n_tokens long, ids_crc32 long")
    totals = read_token_files(spark, path).groupBy("file").agg(F.max(F.col("before") + F.col("n")).alias("held"))
    totals = totals.select("file", F.expr("sum(held) over (order by file rows between unbounded preceding and current row) - held").alias("base"))
    return made.join(totals, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
