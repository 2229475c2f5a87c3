"""Reading and writing matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = "gene int, sample int, value double"


def from_dense(spark: SparkSession, data, nrow: int, ncol: int) -> DataFrame:
    """(gene, sample, value) of a row-major array held by the caller."""
    m = np.asarray(data, float).reshape(nrow, ncol)
    packed = spark.createDataFrame(pa.table({"gene": pa.array(np.arange(nrow, dtype=np.int32)), "vals": pa.array(list(m), pa.list_(pa.float64()))}))
    return packed.select("gene", F.posexplode("vals").alias("sample", "value"))


def from_dense_file(spark: SparkSession, path: str, nrow: int, ncol: int, bits: int = 64) -> DataFrame:
    """(gene, sample, value) of a raw file of nrow x ncol native-endian reals without header.

    A row is a binary record of fixed length, so a large file is split among tasks; whether
    the file has that many is seen from its length, without reading it.
    """
    width = ncol * bits // 8
    kind = np.dtype({32: np.float32, 64: np.float64}[bits])
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(where).getLen()
    if size != nrow * width:
        raise ValueError(f"{path} has {size} bytes, not {nrow} rows of {width}")
    form = "org.apache.spark.input.FixedLengthBinaryInputFormat"
    records = spark.sparkContext.newAPIHadoopFile(path, form, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{form}.recordLength": str(width)})
    rows = spark.createDataFrame(records, "at long, raw binary")

    def decode(batches):
        for b in batches:
            m = np.frombuffer(b"".join(b.column(1).to_pylist()), kind).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy().astype(np.int32)), pa.array(list(m.reshape(-1, ncol)), pa.list_(pa.float64()))], ["gene", "vals"])

    return unpack(rows.mapInArrow(decode, "gene int, vals array<double>"))


def to_dense_file(spark: SparkSession, data, path: str, bits: int = 64) -> None:
    """A matrix held by the caller as such a file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(where)
    out.write(bytearray(np.asarray(data, {32: np.float32, 64: np.float64}[bits]).tobytes()))
    out.close()


def unpack(packed: DataFrame) -> DataFrame:
    """(gene, sample, value) of rows (gene, vals)."""
    return packed.select("gene", F.posexplode("vals").alias("sample", "value"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Results as Parquet, one row per pair."""
    pairs.write.mode("overwrite").parquet(path)


def write_network(edges: DataFrame, path: str) -> None:
    """Accepted edges as Parquet, few files."""
    edges.coalesce(1).write.mode("overwrite").parquet(path)
