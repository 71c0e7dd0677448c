"""Reading and writing the competition tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructType

from heatsheet import schemas

#: Ranges of the key that are counted for each slice of a live table.
STEPS = 64


def read_parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(schemas.STORED[table]).parquet(f"{folder}/{table}")


def read_or_empty(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stored table, or no rows where nothing has been stored yet."""
    try:
        return read_parquet(spark, folder, table)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return from_rows(spark, [], table)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Delimited rows with a header; an empty field is NULL. Malformed rows raise."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")


def from_rows(spark: SparkSession, rows: list[tuple], table: str) -> DataFrame:
    """A table from literal rows, for seed data."""
    return spark.createDataFrame(rows, schemas.STORED[table])


def key_slices(table: str, partitions: int) -> list[str]:
    """Conditions that cut a table into even slices by a hash of its whole primary key.

    Ranges of a leading key column would give a driver with a third of all runs to one
    connection. Key columns are never NULL, so every row is in exactly one slice.
    """
    key = ", ".join(schemas.PRIMARY_KEYS[table])
    return [f"mod(crc32(concat_ws('|', {key})), {partitions}) = {i}" for i in range(partitions)]


def histogram_query(table: str, low: int, high: int, partitions: int) -> str:
    """A subquery for the server: rows of each of at most ``partitions * STEPS`` even ranges of the
    first key column, which it counts in its index. The width of a range follows low and high."""
    key, width = schemas.PRIMARY_KEYS[table][0], _step(low, high, partitions)
    return (
        f"(select floor(({key} - {low}) / {width}) as step, count(*) as size from {table} "
        f"group by floor(({key} - {low}) / {width})) h"
    )


def _step(low: int, high: int, partitions: int) -> int:
    return max(1, -(-(high - low + 1) // (partitions * STEPS)))


def index_slices(
    table: str, sizes: dict[int, int], low: int, high: int, partitions: int
) -> list[str]:
    """Conditions that cut a table into about even slices along the index of its key.

    ``sizes`` has the rows of the steps of ``histogram_query``. Neighbouring steps are joined up to
    an even share; a step with more than a share, such as one driver with a third of all runs, is cut by
    a hash of the whole key, inside its range. The first slice is open below and the last above, so rows
    that come after the counting are read too, and every row is in exactly one slice.
    """
    key, width = schemas.PRIMARY_KEYS[table][0], _step(low, high, partitions)
    share = max(1, -(-sum(sizes.values()) // partitions))
    ranges: list[list[int]] = []  # first step, rows
    for step in sorted(sizes):
        if ranges and ranges[-1][1] + sizes[step] <= share:
            ranges[-1][1] += sizes[step]
        else:
            ranges.append([step, sizes[step]])
    slices = []
    for n, (step, rows) in enumerate(ranges or [[0, 0]]):
        limits = [f"{key} >= {low + step * width}"] if n else []
        if n + 1 < len(ranges):
            limits.append(f"{key} < {low + ranges[n + 1][0] * width}")
        parts = -(-rows // share) if rows > share else 1
        hashed = key_slices(table, parts) if parts > 1 else []
        slices += [" and ".join([*limits, h]) for h in hashed] or [" and ".join(limits) or "1 = 1"]
    return slices


def _numeric_key(table: str) -> bool:
    """Whether the first key column is a whole number, whose ranges can be counted."""
    first = schemas.TABLES[table][schemas.PRIMARY_KEYS[table][0]]
    return isinstance(first.dataType, IntegerType)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    partitions: int = 1,
) -> DataFrame:
    """A table of a live MySQL database, about one connection and one slice per partition.

    Slices follow the server's index where the first key column is a number: its least and greatest
    value and a histogram between them are asked for first, which is ``partitions * STEPS`` rows
    at most. Other tables are cut by a hash of the key, which makes the server read the whole table
    for each slice.
    """
    asked = properties or {}
    if partitions == 1:
        return spark.read.jdbc(url, table, properties=asked)
    if not _numeric_key(table):
        slices = key_slices(table, partitions)
    else:
        key = schemas.PRIMARY_KEYS[table][0]
        ends = f"(select min({key}) as low, max({key}) as high from {table}) e"
        low, high = spark.read.jdbc(url, ends, properties=asked).first()
        if low is None:
            return spark.read.jdbc(url, table, properties=asked)
        counted = spark.read.jdbc(
            url, histogram_query(table, int(low), int(high), partitions), properties=asked
        )
        sizes = {int(r["step"]): int(r["size"]) for r in counted.collect()}
        slices = index_slices(table, sizes, int(low), int(high), partitions)
    return spark.read.jdbc(url, table, predicates=slices, properties=asked)


def append(df: DataFrame, folder: str, table: str) -> None:
    df.write.mode("append").parquet(f"{folder}/{table}")


def append_once(df: DataFrame, folder: str, table: str) -> None:
    """Append the rows whose key is not stored yet, so a repeated write adds nothing.

    The stored table is first reduced to the keys at hand; for a small batch that is
    a broadcast, and the stored rows are scanned in place instead of shuffled.
    """
    keys = schemas.PRIMARY_KEYS[table]
    stored = read_parquet(df.sparkSession, folder, table).select(*keys)
    present = stored.join(df.select(*keys), keys, "left_semi")
    append(df.join(present, keys, "left_anti"), folder, table)


def overwrite(df: DataFrame, folder: str, table: str) -> None:
    """Drop and reload. ``df`` must not be read from the same table; see ``replace``."""
    df.write.mode("overwrite").parquet(f"{folder}/{table}")


def replace(df: DataFrame, folder: str, table: str, staging: str) -> None:
    """Reload a table from a plan that may read it: write to ``staging`` first, then copy.

    If the copy fails, the whole new version is still in ``staging``.
    """
    overwrite(df, staging, table)
    overwrite(read_parquet(df.sparkSession, staging, table), folder, table)
