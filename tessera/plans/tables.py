"""The driver's tables as tensor sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import U64


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def embedding_objects(spark: SparkSession, folder: str) -> DataFrame:
    """A dense object `emb/<vec_id>` for each vector."""
    src = read(spark, folder, "embeddings")
    return src.select(F.concat(F.lit("emb/"), F.col("vec_id").cast("string")).alias("name"), F.array(F.size("embedding").cast(U64)).alias("shape"), F.lit("dense").alias("layout"), F.concat(F.lit('{"label": '), F.col("label").cast("string"), F.lit("}")).alias("attributes"))


def embedding_parts(spark: SparkSession, folder: str) -> DataFrame:
    src = read(spark, folder, "embeddings")
    return src.select(
        F.concat(F.lit("emb/"), F.col("vec_id").cast("string")).alias("name"), F.lit("data").alias("part"), F.lit("f32").alias("dtype"), F.lit(None).cast("string").alias("logical"),
        F.lit(0).alias("store_id"), (F.size("embedding") * 4).cast("long").alias("length"), F.lit(None).cast("string").alias("encoding"), F.lit(None).cast("long").alias("decoded_length"),
    )


def document_blobs(spark: SparkSession, folder: str, columns: tuple[str, ...] = ("content",)) -> DataFrame:
    """A dense u8 object `doc/<doc_id>` for each document; its bytes only if they are asked for."""
    src = read(spark, folder, "documents")
    content = F.coalesce("text", F.lit("")).cast("binary")
    out = src.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("name"), F.lit("data").alias("part"), F.lit("u8").alias("dtype"), F.lit(0).alias("store_id"), F.octet_length(content).cast("long").alias("length"), content.alias("content"), "lang", "source", "doc_id")
    return out if "content" in columns else out.drop("content")


def line_columns(spark: SparkSession, folder: str) -> DataFrame:
    """(name, part, dtype, length): one tensor for each numeric column of lineitem and group of a hundred orders."""
    src = read(spark, folder, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    kinds = {"l_quantity": "f64", "l_extendedprice": "f64", "l_linenumber": "i32", "l_partkey": "i64"}
    each = F.explode(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))).alias("column", "dtype")
    out = src.select("g", "n", each)
    width = F.when(F.col("dtype") == "i32", 4).otherwise(8)
    return out.select(F.concat(F.lit("li/"), "column", F.lit("/"), F.col("g").cast("string")).alias("name"), F.lit("data").alias("part"), "dtype", F.col("n").alias("n"), (F.col("n") * width).cast("long").alias("length"))


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Lineitem as a sparse matrix of suppliers by parts; cells repeat."""
    return read(spark, folder, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").cast("long").alias("value"))


def order_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, pos, byte, tax, n): the quantities of each order as a u8 tensor `ord/<orderkey>`, with a column of small codes."""
    own = Window.partitionBy("l_orderkey")
    src = read(spark, folder, "lineitem")
    pos = (F.row_number().over(own.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1).cast("long")
    return src.select(F.concat(F.lit("ord/"), F.col("l_orderkey").cast("string")).alias("name"), pos.alias("pos"), F.col("l_quantity").cast("int").alias("byte"), F.round(F.col("l_tax") * 100).cast("int").alias("tax"), F.count(F.lit(1)).over(own).alias("n"))
