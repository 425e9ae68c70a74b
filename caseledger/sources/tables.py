"""Typed readers of the account tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES


def conform(df: DataFrame, name: str) -> DataFrame:
    """Bring a DataFrame to the declared columns of a table, nulls where it has none."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name].fields
        ]
    )


def read_account_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every account table below a folder, with its schema given rather than inferred."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()}
