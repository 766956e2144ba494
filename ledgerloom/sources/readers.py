"""Scans of raw tables, and readers of datasets of several platforms."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.filters import block_between
from ledgerloom.schemas import RAW_BLOCKS, RAW_LOGS, RAW_TRACES, RECEIPT_TRANSACTIONS


def scan_logs(spark: SparkSession, path: str, address: str | None = None, lo: int = 0, hi: int = 1 << 62, topic0_prefix: str = "") -> DataFrame:
    """Logs of a contract in a block range; all three filters reach the Parquet scan."""
    df = block_between(spark.read.schema(RAW_LOGS).parquet(path), lo, hi)
    df = df if address is None else df.where(F.col("address") == address)
    return df.where(F.col("topics").startswith(topic0_prefix)) if topic0_prefix else df


def scan_logs_any_address(spark: SparkSession, path: str, topic0s: list[str]) -> DataFrame:
    return spark.read.schema(RAW_LOGS).parquet(path).where(F.split_part("topics", F.lit(","), F.lit(1)).isin(topic0s))


def scan_blocks(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    return block_between(spark.read.schema(RAW_BLOCKS).parquet(path), lo, hi, "number")


def scan_transactions(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    return block_between(spark.read.schema(RECEIPT_TRANSACTIONS).parquet(path), lo, hi)


def scan_traces(spark: SparkSession, path: str, to: str | None, lo: int, hi: int, trace_type: str = "call", selector: str = "") -> DataFrame:
    df = block_between(spark.read.schema(RAW_TRACES).parquet(path), lo, hi).where(F.col("trace_type") == trace_type)
    df = df if to is None else df.where(F.col("to_address") == to)
    return df.where(F.col("input").startswith(selector)) if selector else df


def scan_range_parallel(spark: SparkSession, read_range, lo: int, hi: int, batch: int, parallel: int | None = None, col: str = "block_number") -> DataFrame:
    """``read_range(lo, hi)`` in ``parallel`` tasks, each with whole batches of ``batch`` blocks.

    One scan whose filter reaches the files; rows of a batch are together.
    Without ``parallel`` it is as many tasks as a shuffle has.
    """
    number = F.floor((F.col(col) - lo) / batch)
    return read_range(lo, hi).repartition(parallel or int(spark.conf.get("spark.sql.shuffle.partitions")), number)


def read_dataset(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, bool]:
    """A platform's Parquet and whether it is there; absent, empty or unreadable gives no rows."""
    try:
        df = spark.read.schema(schema).parquet(path)
        df.limit(1).count()
    except Exception as e:  # a broken file is the case this reader is for
        if not isinstance(e, AnalysisException) and "parquet" not in str(e).lower():
            raise
        return spark.createDataFrame([], schema), False
    return df, True


def read_datasets(spark: SparkSession, paths: dict[str, str], schema: str | T.StructType) -> tuple[DataFrame, dict[str, bool]]:
    """All platforms as one relation with ``platform``, and which of them were there."""
    out, loaded = None, {}
    for platform, path in paths.items():
        df, loaded[platform] = read_dataset(spark, path, schema)
        df = df.withColumn("platform", F.lit(platform))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, loaded


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of JSON files that hold one array each; anything else is an error."""
    wrong = spark.read.text(path, wholetext=True).where(~F.ltrim(F.regexp_replace("value", r"\s", "")).startswith("["))
    if not wrong.isEmpty():
        raise ValueError(f"not an array of records: {path}")
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jdbc_range(spark: SparkSession, url: str, table: str, col: str, lo: int, hi: int, partitions: int = 16, **options: str) -> DataFrame:
    """A table's rows in a range, read in parallel strides; numbers beyond long as text, bytes as hex."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=col, lowerBound=lo, upperBound=hi, numPartitions=partitions, **options).load()
    return text_columns(block_between(df, lo, hi, col))


def text_columns(df: DataFrame) -> DataFrame:
    """Decimals as text and binary as ``0x`` hex."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.BinaryType):
            c = F.concat(F.lit("0x"), F.lower(F.hex(c)))
        out.append(c.alias(f.name))
    return df.select(*out)


def infer_schema_first_row(spark: SparkSession, path: str) -> T.StructType:
    """Schema from the first JSON record: number to double, boolean, everything else text."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    found = T.DataType.fromDDL(spark.range(1).select(F.schema_of_json(F.lit(first.value))).first()[0])
    kinds = {T.LongType: T.DoubleType(), T.DoubleType: T.DoubleType(), T.BooleanType: T.BooleanType()}
    return T.StructType([T.StructField(f.name, kinds.get(type(f.dataType), T.StringType())) for f in found])


def read_stream_blocks(spark: SparkSession, path: str, schema: str | T.StructType, files_per_batch: int = 64) -> DataFrame:
    """Unbounded read of Parquet files from the earliest on."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
