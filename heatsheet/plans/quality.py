"""Audits of the declared keys, references, required values and lengths; column defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatsheet import schemas


def audit_primary_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def _key_text(keys: list[str]):
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key")


def _each_table(audits: dict[str, DataFrame]) -> DataFrame:
    named = [df.select(F.lit(name).alias("table"), "*") for name, df in audits.items()]
    return reduce(DataFrame.unionByName, named)


def audit_primary_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Repeated values of the declared keys of the four tables."""
    return _each_table({
        name: audit_primary_key(tables[name], keys).select(_key_text(keys), "copies")
        for name, keys in schemas.PRIMARY_KEYS.items()
    })


def audit_not_nulls(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of NULLs in every required column of the four tables."""
    return _each_table({
        name: audit_not_null(tables[name], schemas.required_columns(name)) for name in schemas.TABLES
    })


def audit_lengths(tables: dict[str, DataFrame]) -> DataFrame:
    """Texts of the four tables that are longer than declared."""
    return _each_table({
        name: audit_length(tables[name], schemas.PRIMARY_KEYS[name], limits).select(
            _key_text(schemas.PRIMARY_KEYS[name]), "column", "allowed", "actual"
        )
        for name, limits in schemas.MAX_LENGTHS.items()
    })


def audit_foreign_key(
    child: DataFrame, column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    """Values of ``column`` with no parent, with their number of rows.

    The child is counted per value first, so a value held by most rows reaches the
    join as one row.
    """
    return (
        child.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("orphans"))
        .join(parent.select(F.col(parent_column).alias("value")), "value", "left_anti")
        .select(F.col("value").cast("string").alias("value"), "orphans")
    )


def audit_foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """All declared references of the four tables."""
    return reduce(
        DataFrame.unionByName,
        [
            audit_foreign_key(tables[child], column, tables[parent], parent_column).select(
                F.lit(f"{child}.{column}").alias("reference"), "value", "orphans"
            )
            for child, column, parent, parent_column in schemas.FOREIGN_KEYS
        ],
    )


def audit_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of NULLs per column, counted in one scan."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "nulls")


def audit_length(df: DataFrame, keys: list[str], limits: dict[str, int]) -> DataFrame:
    """Over-long texts: key, column, allowed and actual length. No shuffle."""
    texts = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(n).alias("allowed"),
                F.char_length(F.col(c)).alias("actual"),
            )
            for c, n in limits.items()
        ]
    )
    return (
        df.select(*keys, F.explode(texts).alias("text"))
        .select(*keys, "text.*")
        .filter(F.col("actual") > F.col("allowed"))
    )


def fill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Declared defaults in place of NULL."""
    return df.fillna(defaults)
