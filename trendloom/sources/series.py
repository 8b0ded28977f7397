"""Sampled series from tables: (series_id, x, n, y) with a dense index x from 0 and the length n.

Indexing doesn't funnel a series into one task: rows are numbered within blocks (a span of the ordering column), and block
offsets come from a running sum over block counts, which are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Share of a series that is kept for training by default.
TRAIN = 0.8


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_column(spark: SparkSession, path: str, column: str, fmt: str = "parquet", **options) -> DataFrame:
    """One named numeric column of a file as y (rows without a number dropped)."""
    return spark.read.options(**options).format(fmt).load(path).select(F.col(column).cast("double").alias("y")).na.drop()


def index_series(df: DataFrame, key: str, order: list[str], y: Column | str, block: Column) -> DataFrame:
    """(series_id, x, n, y), x by `order` within `key`. `block` must not fall as the first of `order` rises."""
    y = F.col(y) if isinstance(y, str) else y
    rows = df.select(F.col(key).cast("string").alias("series_id"), block.alias("block"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], y.cast("double").alias("y"))
    counts = rows.groupBy("series_id", "block").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("series_id")
    offsets = counts.select("series_id", "block", (F.sum("c").over(whole.orderBy("block")) - F.col("c")).alias("offset"), F.sum("c").over(whole).alias("n"))
    place = F.row_number().over(Window.partitionBy("series_id", "block").orderBy(*[f"o{i}" for i in range(len(order))]))
    numbered = rows.withColumn("place", place).join(offsets, ["series_id", "block"])
    return numbered.select("series_id", (F.col("offset") + F.col("place") - 1).cast("long").alias("x"), F.col("n").cast("long").alias("n"), "y")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events by type, in order of time."""
    e = read_table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    return index_series(e, "event_type", ["ts", "event_id"], "value", F.to_date("ts"))


def daily(df: DataFrame, name: str, day: str, y: Column) -> DataFrame:
    """A series of daily sums; days are summed before they are numbered."""
    d = df.groupBy(F.to_date(day).alias("day")).agg(F.sum(y).alias("y")).withColumn("series_id", F.lit(name))
    return index_series(d, "series_id", ["day"], "y", F.year("day"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(read_table(spark, sf_dir, "orders"), "orders", "o_orderdate", F.col("o_totalprice"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(read_table(spark, sf_dir, "lineitem"), "lineitem", "l_shipdate", F.col("l_extendedprice") * (1 - F.col("l_discount")))


def part_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by part: many short series of few values."""
    keys = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    return index_series(read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", *keys), "l_partkey", keys, "l_quantity", F.lit(0))


def split(series: DataFrame, ratio: float = TRAIN) -> DataFrame:
    """A `split` column: the first floor(n * ratio) samples train, the rest test."""
    return series.withColumn("split", F.when(F.col("x") < F.floor(F.col("n") * F.lit(ratio)), "train").otherwise("test"))


def head(series: DataFrame, size: int) -> DataFrame:
    return series.where(F.col("x") < size).withColumn("n", F.least("n", F.lit(size).cast("long")))


def reverse(series: DataFrame) -> DataFrame:
    return series.withColumn("x", F.col("n") - 1 - F.col("x"))


def write(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """CSV is written so that line breaks in values survive; JSON is one object for each row."""
    w = df.write.mode("overwrite").options(**({"quoteAll": True, "header": True} if fmt == "csv" else {}) | options)
    w.format(fmt).save(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True)
