"""Scans: JSON, CSV, TSV, text lines, spreadsheets, images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_records(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None, multiline: bool = False) -> DataFrame:
    """JSON rows; only the columns asked for are read, rows of nulls only are left out."""
    rows = spark.read.schema(schema).json(path, multiLine=multiline)
    return (rows.select(columns) if columns else rows).na.drop("all")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", multiline: bool = True) -> DataFrame:
    """multiline: quoted fields may hold line ends, for which a file is read by one task; files without any can be split."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, multiLine=multiline, escape='"')


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Missing fields are empty texts."""
    return spark.read.schema(schema).csv(path, header=True, sep="\t", quote="").na.fill("")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.rtrim("value").alias("value")).where("value <> ''")


def read_excel(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A spreadsheet of one sheet, read on the driver; needs a spreadsheet library for pandas."""
    import pandas as pd

    try:
        frame = pd.read_excel(path)
    except ImportError as missing:
        raise ImportError("reading spreadsheets needs openpyxl") from missing
    return spark.createDataFrame(frame, schema)


def read_images(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    """name, content of image files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content")


def read_image_chunks(spark: SparkSession, path: str) -> DataFrame:
    """name, content of images kept as JSON objects of base64 texts."""
    chunks = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("m"))
    return chunks.select(F.explode("m").alias("name", "data")).select("name", F.unbase64("data").alias("content"))


def read_image_hashes(spark: SparkSession, path: str) -> DataFrame:
    """name, hash of lines `name;hash`."""
    parts = F.split("value", ";")
    return spark.read.text(path).select(parts[0].alias("name"), parts[1].alias("hash"))


def unique_urls(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.trim(F.col(column)).alias("url")).where(F.col("url").contains("http")).distinct()
