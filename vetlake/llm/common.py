"""What the operators share: reading tables, the text of a row, and rows carried whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(c: str | Column = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def pack_row(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that computed columns clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)


def unpack_row(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")
