"""What the corpus operators share: reading tables, splitting words, running a function over texts in Arrow batches."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of letters and digits; the callers lower-case first.
WORD = re.compile(r"[^\W_]+")
#: Characters of text that a function gets at once, so that its arrays stay small beside very long texts.
CHUNK_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def split_mod(key: Column, mod: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo `mod`. A null id falls in fold 0."""
    return F.coalesce(F.crc32(key.cast("string")) % mod, F.lit(0))


def stable_hash(strings: list[str]) -> np.ndarray:
    """64-bit hashes that are the same in every process."""
    import pandas as pd

    return pd.util.hash_array(np.asarray(strings, dtype=object), categorize=False) if strings else np.empty(0, np.uint64)


def slices(sizes: np.ndarray, most: int = CHUNK_CHARS, rows: int = 2048) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most `most` in sum and `rows` rows; a larger row stands alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > most or i - start >= rows):
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def give_back() -> None:
    """Freed memory goes back to the system: Spark keeps Python workers for later tasks of any kind."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def place_of(df: DataFrame, name: str) -> int:
    """Where a column stands: the first of exactly this name, else the first whose name differs in case only."""
    exact = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not exact:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return exact[0]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only these columns, under new names: pick(docs, key="doc_id"). Taken by place, so no name of another column matters."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{place_of(df, old)}").alias(new) for new, old in columns.items()))


def map_texts(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField], fn: Callable[[list[str]], list], where: Callable[[list], list[bool]] | None = None) -> DataFrame:
    """The columns `keep` of df, then those that `fn` makes from a list of texts (null texts arrive as "").

    fn returns one list or array for each field. With `where`, only rows stay for which it says so, and the new
    columns are left out: a filter that keeps the frame's own columns. One pass, no shuffle, Arrow batches. Columns are
    passed by place under names of their own, so that any names, dots and twins in upper case too, are kept.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    places = list(range(len(df.columns))) if keep == df.columns else [place_of(df, c) for c in keep]
    given = df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*(F.col(f"c{p}").alias(f"k{i}") for i, p in enumerate(places)), F.col(f"c{place_of(df, text)}").alias("text"))
    kept = T.StructType(given.schema.fields[:-1])
    out = kept if where else T.StructType([*kept.fields, *(T.StructField(f"m{i}", f.dataType) for i, f in enumerate(fields))])
    names = [f.name for f in out.fields]

    def run(batches):
        schema = to_arrow_schema(out)
        types = [schema.field(i).type for i in range(len(kept) * (where is None), len(schema))]
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0))
            for a, b in slices(sizes):
                part = batch.slice(a, b - a)
                made = fn([x or "" for x in part.column(part.num_columns - 1).to_pylist()])
                own = part.columns[:-1]
                if where:
                    mask = pa.array(where(made), pa.bool_())
                    yield pa.RecordBatch.from_arrays([c.filter(mask) for c in own], names)
                else:
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, t) for v, t in zip(made, types, strict=True))], names)
        give_back()

    return given.mapInArrow(run, out).toDF(*(df.columns[p] for p in places), *(f.name for f in fields if not where))


def sample_keys(rows: DataFrame, label: str, most: int, fold: int, held_out: int, key: str = "doc_id") -> DataFrame:
    """At most `most` distinct (key, label) rows of non-null key and label outside the held-out fold: those of smallest id hash.

    Two narrow passes: a count, then the rows under a hash threshold that leaves some more than `most`, so that no task
    sorts more than about that many at any input size; rows that repeat are combined before they are moved.
    """
    able = pick(rows, key=key, label=label).where(F.col("label").isNotNull() & F.col("key").isNotNull() & (split_mod(F.col("key"), fold) != held_out))
    n, buckets = able.count(), 1 << 30
    share = min(buckets, int(buckets * (most + 6 * most**0.5) / max(n, 1)) + 1)
    hashed = F.xxhash64("key")
    return able.where(F.pmod(hashed, F.lit(buckets)) < share).groupBy("key", "label").agg(F.lit(1).alias("one")).select("key", "label").orderBy(hashed, "key", "label").limit(most)


def sample_texts(docs: DataFrame, rows: DataFrame, label: str, most: int, fold: int, held_out: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, label, text of at most `most` labelled documents, written once in the shared folder.

    Null texts are empty; keys without a document are passed over; of several texts under one key the smallest is taken.
    """
    spark = docs.sparkSession
    picked = sample_keys(rows, label, most, fold, held_out, key)
    few = spark.createDataFrame(picked.collect(), picked.schema)
    found = pick(docs, key=key, text=text).join(F.broadcast(few), "key").groupBy("key", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    path = shared_folder(spark, "sample")
    found.repartition(max(2, spark.sparkContext.defaultParallelism)).write.parquet(path)
    return spark.read.parquet(path)


@functools.lru_cache(maxsize=1)
def local_folder() -> str:
    import tempfile

    return f"file://{tempfile.mkdtemp(prefix='pairloom-')}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Where that is unset, a local session (as in tests)
    takes a temporary folder; on a cluster, where executors would write to their own disks, this is an error."""
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        top = local_folder()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The frame, written in a new shared folder and read again, and that folder: cuts the lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate folders that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
