"""File sources and sinks built on spark.read and DataFrame.write."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _S, _B, _I = T.DoubleType(), T.StringType(), T.BooleanType(), T.IntegerType()

# Column names of the panel tables, in file order.
PANEL_MEASURES = [
    "population", "poverty_rate", "pct_renter_occupied", "median_gross_rent", "median_household_income",
    "median_property_value", "rent_burden", "pct_white", "pct_af_am", "pct_hispanic", "pct_am_ind", "pct_asian",
    "pct_nh_pi", "pct_multiple", "pct_other", "renter_occupied_households", "eviction_filings", "evictions",
    "eviction_rate", "eviction_filing_rate",
]
PANEL_SCHEMA = T.StructType(
    [T.StructField("geo_id", _S), T.StructField("year", _I), T.StructField("name", _S),
     T.StructField("parent_location", _S)]
    + [T.StructField(c, _D) for c in PANEL_MEASURES]
    + [T.StructField(c, _B) for c in ("imputed", "subbed", "low_flag")]
)
PERMIT_SCHEMA = T.StructType([
    T.StructField("year", _I), T.StructField("state", _S), T.StructField("county", _S), T.StructField("region", _S),
    T.StructField("division", _S), T.StructField("total_bldg", _I), T.StructField("total_units", _I),
    T.StructField("total_value", _D), T.StructField("geo_id", _S),
])
HOUSEHOLD_SCHEMA = T.StructType([
    T.StructField("year", _I), T.StructField("geo_id", _S), T.StructField("avg_size", _D),
])
URBAN_SCHEMA = T.StructType([T.StructField(c, _I) for c in ("UA", "STATE", "COUNTY", "GEOID")])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """CSV with a header, typed by a schema or by inference, optionally a column subset."""
    reader = spark.read.option("header", True)
    paths = [path] if isinstance(path, str) else list(path)
    df = reader.schema(schema).csv(paths) if schema else reader.option("inferSchema", True).csv(paths)
    return df.select(*columns) if columns else df


def read_csv_tree(
    spark: SparkSession, path: str, schema: T.StructType, tag: str, tag_pattern: str,
    file_pattern: str | None = None, skip_tags: Sequence[str] = (),
) -> DataFrame:
    """Many CSV files as one frame, with a leading column cut from each file's path.

    Files whose path does not match `file_pattern`, or whose tag is skipped, are left out.
    """
    df = spark.read.option("header", True).option("recursiveFileLookup", True).schema(schema).csv(path)
    df = df.select(F.regexp_extract(F.col("_metadata.file_path"), tag_pattern, 1).alias(tag), "*",
                   F.col("_metadata.file_path").alias("__path"))
    if file_pattern:
        df = df.where(F.col("__path").rlike(file_pattern))
    if skip_tags:
        df = df.where(~F.col(tag).isin(list(skip_tags)))
    return df.drop("__path")


def read_yearly(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """A list of yearly files stacked in one scan."""
    return spark.read.option("header", True).schema(schema).csv(list(paths))


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing on one side are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a stored table; partitioned by period when asked, so period filters prune files."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def snapshot(df: DataFrame, path: str, columns: Sequence[str]) -> DataFrame:
    """Store a projection as its own table and return it read back."""
    replace_table(df.select(*columns), path)
    return df.sparkSession.read.parquet(path)


def column_for_years(df: DataFrame, column: str, year: int, year2: int | None = None, period: str = "year") -> DataFrame:
    years = [year] if year2 is None else [year, year2]
    return df.where(F.col(period).isin(years)).select(column)


def read_feature_sets(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of named feature lists as rows (feature_set, position, feature)."""
    wide = spark.read.option("multiLine", True).json(path)
    long = wide.unpivot([], wide.columns, "feature_set", "features")
    return long.select("feature_set", F.posexplode("features").alias("position", "feature"))
