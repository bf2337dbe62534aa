"""Sinks: records, CSV, size-bounded exports, image chunks, key-value state."""

from __future__ import annotations

import functools
import json
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_records(df: DataFrame, path: str, batch: int | None = None) -> None:
    """Rows as JSON, added to what is there."""
    writer = df.write.mode("append")
    (writer.option("maxRecordsPerFile", batch) if batch else writer).json(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Quotes in a field are doubled, blanks at its ends are kept; nulls are empty."""
    df.na.fill("").write.mode("overwrite").csv(path, header=True, sep=sep, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def rows_per_file(df: DataFrame, most_bytes: int, sep: str = ";") -> int:
    """How many rows a file of at most so many bytes holds, by the mean width of all rows."""
    width = F.octet_length(F.concat_ws(sep, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns))) + 1
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    files = max(1, math.ceil(size / most_bytes))
    return max(1, math.ceil(n / files))


def export_csv(df: DataFrame, path: str, most_bytes: int = 100_000_000) -> None:
    """Semicolon-separated files of bounded size."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file(df, most_bytes)).csv(path, header=True, sep=";", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_image_chunks(images: DataFrame, path: str, key: str = "name", per_chunk: int = 1000) -> None:
    """Images of about so many products a line: a JSON object of base64 texts."""
    n = images.count()
    chunk = F.pmod(F.xxhash64(key), F.lit(max(1, math.ceil(n / per_chunk))))
    packed = images.select(chunk.alias("chunk"), key, F.base64("content").alias("data")).groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct(key, "data"))).alias("m"))
    packed.select(F.to_json("m").alias("value")).write.mode("overwrite").text(path)


def put_state(spark: SparkSession, path: str, name: str, value) -> None:
    """A small JSON document under a name."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def get_state(spark: SparkSession, path: str, name: str, default=None):
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(f"{path}/{name}").first()
    except AnalysisException:
        return default
    return json.loads(row[0]) if row else default


def put_remote(path: str, host: str) -> None:
    """Transfer to a remote host is left to the deployment."""
    raise NotImplementedError(f"no transfer of {path} to {host} is configured")


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='pairloom-')}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Where that is unset, a local session takes a temporary folder; on a cluster, whose executors would each write to their
    own disk, this is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        top = _local_folder()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again: a short plan for what uses it often, and no lineage to compute anew."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """The folder of a materialised frame goes; the frame can't be read any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
