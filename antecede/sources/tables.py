"""Table contracts, readers and writers (A1-A6), and checkpoints that outlive executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels or numbers of a table that is broadcast at most; parts that the rows of a key are split into beyond.
MAX_LABELS, SALTS = 2_000_000, 64

VAF = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("gene_id", T.StringType()),
        T.StructField("ref_count", T.IntegerType()),
        T.StructField("alt_count", T.IntegerType()),
        T.StructField("copy_number", T.IntegerType()),
        T.StructField("normal_ploidy", T.IntegerType()),
        T.StructField("vaf_estimate", T.DoubleType()),
        T.StructField("ccf_estimate", T.DoubleType()),
        T.StructField("row_id", T.LongType()),
    ]
)


def read_vaf(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A1: the VAF table; row_id gives the order of rows, of which the last of a (sample, gene) wins."""
    reader = spark.read.schema(VAF)
    return reader.option("header", True).csv(path) if form == "csv" else reader.parquet(path)


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """A4: text lines `parent child [weight]`; a missing weight is 1, self-loops are dropped."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(words.alias("w"))
    rows = rows.select(F.col("w")[0].alias("parent"), F.col("w")[1].alias("child"), F.coalesce(F.try_element_at("w", F.lit(3)).cast("long"), F.lit(1).cast("long")).alias("weight"))
    return rows.where("parent <> child")


def wide_to_long(wide: DataFrame, sample_col: str, value: str = "ccf") -> DataFrame:
    """A2: a sample x gene matrix as long rows; zeros, nulls and NaN are unobserved."""
    genes = [c for c in wide.columns if c != sample_col]
    cast = wide.select(F.col(sample_col).cast("string").alias("sample_id"), *[F.col(f"`{g}`").cast("double") for g in genes])
    long = cast.unpivot("sample_id", genes, "gene_id", value)
    return long.where((F.col(value) > 0) & ~F.isnan(value))


def explode_trees(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A3: (sample_id, nodes array, edges array of (parent, child)) as node and edge tables; isolated nodes stay nodes."""
    nodes = trees.select("sample_id", F.explode("nodes").alias("gene_id")).distinct()
    edges = trees.select("sample_id", F.explode("edges").alias("e")).select("sample_id", "e.parent", "e.child")
    return nodes, edges


def write_edges(edges: DataFrame, path: str) -> None:
    """Poset or inference, one folder for each regularization."""
    edges.write.mode("overwrite").partitionBy(*[c for c in ("regularization",) if c in edges.columns]).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt out by keys over twice spark.sql.shuffle.partitions: for few small groups of much work each, which adaptive
    execution would put into one task because their rows are few."""
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def beside(rows: DataFrame, small: DataFrame, labels: Column, keys: list[str], spread_by: Column) -> DataFrame:
    """rows joined with a table of `labels` values a row: broadcast while it holds MAX_LABELS at most, else by keys and a salt
    of spread_by."""
    if (small.agg(F.sum(labels)).first()[0] or 0) <= MAX_LABELS:
        return rows.join(F.broadcast(small), keys)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share; only where that is unset and the
    master is local in a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = own.get()
    return f"{path.rstrip('/')}/step-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage by a Parquet table in the shared folder."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
