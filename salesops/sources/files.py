"""Reading and writing sales tables.

The stored sales table is Parquet partitioned by ``year`` and ``month`` of
``Date``: chart filters on those columns skip whole folders, and appends only
add files (no read-modify-write, so two appends never lose rows).
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DecimalType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from salesops.constants import DATE_TEXT_FORMAT_SPARK, SALES_COLUMNS
from salesops.functions.text import slug
from salesops.session import checkpoint_dir

SALES_SCHEMA = StructType(
    [
        StructField("Date", TimestampNTZType()),
        StructField("Day", StringType()),
        StructField("OrderID", StringType()),
        StructField("Item", StringType()),
        StructField("Quantity", DoubleType()),
        StructField("Price", DecimalType(38, 10)),  # as given, not rounded
        StructField("Category", StringType()),
        StructField("PaymentType", StringType()),
    ]
)
RAW_SALES_SCHEMA = StructType([StructField(c, StringType()) for c in SALES_COLUMNS])
PARTITIONS = ["year", "month"]
ROWS_PER_FILE = 1_000_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# A stored table: the eight columns plus its partition columns. Reading with
# this schema skips inference and works for a table that has no rows yet.
STORED_SALES_SCHEMA = StructType(SALES_SCHEMA.fields + [StructField("year", IntegerType()), StructField("month", IntegerType())])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, on any file system Spark can reach."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "salesops-out", f"{name}-{uuid.uuid4().hex[:12]}")


@contextmanager
def shuffles_removed(spark: SparkSession):
    """A write within removes its shuffle files when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table below the shared checkpoint folder, read back.

    Cuts lineage and fixes row ids and places. Unlike an unpersisted
    ``checkpoint``, the rows are computed once.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_partitions(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("Date")).withColumn("month", F.month("Date"))


def scan_sales(spark: SparkSession, path: str, columns=None, year=None, month=None) -> DataFrame:
    """Read a stored sales table, only the named columns (pruned at the
    scan) and only the given year/month folders."""
    df = read_sales(spark, path)
    if year is not None:
        df = df.where(F.col("year") == int(year))
    if month is not None:
        df = df.where(F.col("month") == int(month))
    return df.select(*(columns or SALES_COLUMNS))


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """A stored sales table with its partition columns."""
    return spark.read.schema(STORED_SALES_SCHEMA).parquet(path)


def csv_reader(spark: SparkSession, multi_line: bool = True):
    """A reader of CSV as other tools write it. A quoted line break keeps a file in one
    task, so ``export_dataset`` writes files of bounded size."""
    return spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: a CSV with a header row, types inferred; quoted cells may hold commas, doubled quotes and line breaks."""
    return csv_reader(spark).option("inferSchema", True).csv(path)


def create_dataset(spark: SparkSession, path: str) -> DataFrame:
    """An empty sales table with the eight columns."""
    empty = with_partitions(spark.createDataFrame([], SALES_SCHEMA))
    empty.write.mode("errorifexists").partitionBy(*PARTITIONS).parquet(path)
    return read_sales(spark, path)


def create_datasets(datasets: DataFrame, root: str) -> None:
    """S4 for a batch of (user_id, dataset_id, name): all share one sales table, in which each
    is a name of its own; a dataset without rows is a row of the catalog table."""
    spark = datasets.sparkSession
    named = datasets.select("user_id", "dataset_id", "name", F.concat(slug("name"), F.lit("_"), F.col("dataset_id").cast("string")).alias("table_name"))
    named.write.mode("errorifexists").parquet(f"{root}/catalog")
    empty = with_partitions(spark.createDataFrame([], SALES_SCHEMA)).withColumn("table_name", F.lit(None).cast("string"))
    empty.write.mode("errorifexists").partitionBy("table_name", *PARTITIONS).parquet(f"{root}/sales")


def created_datasets(spark: SparkSession, root: str) -> DataFrame:
    """The created datasets with their number of rows and columns."""
    schema = StructType([*SALES_SCHEMA.fields, StructField("table_name", StringType()), *STORED_SALES_SCHEMA.fields[-2:]])
    rows = spark.read.schema(schema).parquet(f"{root}/sales").groupBy("table_name").agg(F.count(F.lit(1)).alias("rows"))
    listed = spark.read.parquet(f"{root}/catalog").join(rows, "table_name", "left")
    return listed.select("user_id", "dataset_id", "name", "table_name", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), F.lit(", ".join(SALES_COLUMNS)).alias("columns"))


def clustered(df: DataFrame, keys, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Rows of one output folder together, a large folder's spread by measured counts.

    So a write makes a folder's rows / ``rows_per_file`` files, not one for each
    task and folder, and no task gets more than about ``rows_per_file`` rows.
    """
    files = df.groupBy(*keys).agg(files_for(F.count(F.lit(1)), rows_per_file).alias("_files"))
    # Written, so that the join is planned by its size, with no shuffle of the rows by the folders' keys.
    files = written(files.select("_files", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), "folders")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return spread(df.join(files, on, "left"), keys, "_files").select(*df.columns)


def files_for(rows: Column, rows_per_file: int = ROWS_PER_FILE) -> Column:
    """How many files a folder of ``rows`` rows gets."""
    return F.ceil(rows / F.lit(rows_per_file)).cast("int")


def spread(df: DataFrame, keys, files_col: str, part: int = 0, parts: int = 1) -> DataFrame:
    """Rows of one output folder dealt over its number of files, which ``files_col`` holds; one shuffle.

    With ``parts``, the rows of the ``part``-th share of all files only."""
    columns = [c for c in df.columns if c != files_col]
    # A hash of the row: the same in every attempt of a task (equal rows share a file).
    salt = F.pmod(F.xxhash64(*columns), F.col(files_col)).cast("int")
    salted = df.withColumn("_salt", salt)
    if parts > 1:
        salted = salted.where(F.pmod(F.xxhash64(*keys, "_salt"), F.lit(parts)) == part)
    return salted.repartition(*keys, "_salt").select(*columns)


def append_sales(df: DataFrame, path: str) -> None:
    """Append sales rows; each (year, month) folder gets new files only."""
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in SALES_SCHEMA.fields])
    clustered(with_partitions(rows), PARTITIONS).write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def export_dataset(df: DataFrame, path: str) -> None:
    """The whole table as CSV with a header, dates as dd/MM/yyyy/HH:mm:ss.

    Quotes within a cell are doubled and outer blanks are kept. A missing cell
    is an empty field and an empty text is ``""``, which readers take as missing
    too. A file holds at most ``ROWS_PER_FILE`` rows.
    """
    out = df.select(
        F.date_format("Date", DATE_TEXT_FORMAT_SPARK).alias("Date") if dict(df.dtypes).get("Date") != "string" else F.col("Date"),
        *[c for c in SALES_COLUMNS[1:]],
    )
    plain = {"header": True, "quote": '"', "escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "maxRecordsPerFile": ROWS_PER_FILE}
    out.write.mode("errorifexists").options(**plain).csv(path)
