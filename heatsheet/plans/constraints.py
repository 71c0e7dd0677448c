"""Rows that a table can take, told from those that it cannot before anything is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatsheet import schemas
from heatsheet.operators import lookup_join, stable


def judged(rows: DataFrame, table: str, stored: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with ``reason``, empty for a row that ``table`` can take.

    Reasons, in this order and joined by commas: ``null:`` and ``length:`` with the column,
    ``repeated`` (the key occurs twice in the batch; all such rows), ``stored`` (the key is taken) and
    ``missing:`` with a column whose parent is not stored. A parent in the same batch does not
    count, since it may be refused itself; append parents first. ``stored`` has the table and
    its parents. Lookup sides have one row a key, and rows without a reference are spread.
    """
    keys = schemas.PRIMARY_KEYS[table]
    checks = {f"null:{c}": F.col(c).isNull() for c in schemas.required_columns(table)}
    checks |= {
        f"length:{c}": F.length(c) > most for c, most in schemas.MAX_LENGTHS.get(table, {}).items()
    }
    copies = rows.groupBy(*keys).agg(F.count("*").alias("_copies"))
    taken = stored[table].select(*keys).distinct().withColumn("_taken", F.lit(True))
    known = rows.join(copies, keys, "left").join(taken, keys, "left")
    checks |= {"repeated": F.col("_copies") > 1, "stored": F.col("_taken")}
    references = [r for r in schemas.FOREIGN_KEYS if r[0] == table]
    for i, (_, column, parent, parent_key) in enumerate(references):
        found = stored[parent].select(
            F.col(parent_key).alias(f"_key_{i}"), F.lit(True).alias(f"_found_{i}")
        )
        kind = stored[parent].schema[parent_key].dataType
        spread = F.pmod(F.xxhash64(*rows.columns), F.lit(2**31 - 1)).cast(kind)
        known = lookup_join(
            known.withColumn("_spread", spread), found, column, f"_key_{i}", spread_by="_spread"
        ).drop("_spread")
        checks[f"missing:{column}"] = F.col(column).isNotNull() & F.col(f"_found_{i}").isNull()
    reason = F.concat_ws(",", *[F.when(failed, F.lit(name)) for name, failed in checks.items()])
    return known.select(*rows.columns, reason.alias("reason"))


def split(
    rows: DataFrame, table: str, stored: dict[str, DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """The rows that ``table`` can take, and the others with their ``reason``. Judged once: both
    come from one checkpoint, so no row is in neither or in both if executors are lost."""
    whole = stable(judged(rows, table, stored))
    return whole.filter("reason = ''").drop("reason"), whole.filter("reason <> ''")
