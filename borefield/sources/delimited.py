"""Delimited files: all text first, missing values by list, declared dates, ambiguous ones refused."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_dates, require_unambiguous_dates

# Texts that stand for a missing value in delimited files.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
DELIMITERS = {".csv": ",", ".tsv": "\t", ".psv": "|", ".txt": ","}


@dataclass(frozen=True)
class Source:
    """What is known of a file: where, what it is called, its formats, its code if it declares none."""

    path: str
    name: str
    delimiter: str = ","
    date_formats: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    declared_epsg: int | None = None
    layer: str | None = None


def missing_to_null(c: Column) -> Column:
    return F.when(~c.isin(MISSING), c)


def typed(df: DataFrame, source: Source) -> DataFrame:
    """Text columns of a table: missing values to null, declared dates parsed, declared types cast. Ambiguous dates raise."""
    text = df.withColumns({c: missing_to_null(F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "string"})
    require_unambiguous_dates(text.drop(*source.types), source.date_formats)
    return parse_dates(text, source.date_formats).withColumns({c: F.col(f"`{c}`").cast(t) for c, t in source.types.items() if c in text.columns})


def read_delimited(spark: SparkSession, source: Source, **options: str) -> DataFrame:
    """The file as declared, with source_file. Columns neither declared a date nor a type stay text."""
    raw = spark.read.options(header="true", sep=source.delimiter, inferSchema="false", nullValue="\u0000", **options).csv(source.path)
    return typed(raw, source).withColumn("source_file", F.lit(source.name))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))
