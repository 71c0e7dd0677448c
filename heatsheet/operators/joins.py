"""Join helpers that stay safe when one key, or NULL, holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cells of a grid for each task, so that hashing deals them evenly, and most pairs of a cell.
CELLS_PER_TASK = 4
GRID_PAIRS = 1 << 22


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    lookup_key: str,
    spread_by: str | None = None,
    how: str = "left",
) -> DataFrame:
    """Join ``rows`` to a table that is unique on ``lookup_key``, then drop that key.

    A left join hashes every row whose key is NULL to one partition. With
    ``spread_by`` (a non-NULL, well distributed column of the same type) such rows
    hash by that column instead; the second condition keeps them unmatched. Hot
    non-NULL keys are split by adaptive execution: the lookup side has one row per
    key, so each split of the hot side rereads only that row's partition.
    """
    if spread_by is None:
        matches = F.col(key) == F.col(lookup_key)
    else:
        matches = (F.coalesce(F.col(key), F.col(spread_by)) == F.col(lookup_key)) & F.col(
            key
        ).isNotNull()
    return rows.join(lookup, matches, how).drop(lookup_key)


def grid(left: Column, right: Column, tasks: int, cell_pairs: int | Column = GRID_PAIRS) -> Column:
    """Rows and columns of a grid for the product of ``left`` and ``right`` rows.

    It has a few cells for each of ``tasks``, and more where a cell would have more than
    ``cell_pairs`` pairs. Its sides are in proportion to the tables, which makes the fewest copies, and
    none is longer than its table has rows, so the copies are never more than the result.
    """
    one, left, right = F.lit(1), left.cast("double"), right.cast("double")
    cells = F.greatest(F.lit(tasks * CELLS_PER_TASK), F.ceil(left * right / cell_pairs))
    even = F.ceil(F.sqrt(cells * left / F.greatest(one, right)))
    # The shorter side may be shorter than its share; the other makes up for it.
    columns = F.greatest(one, F.least(right, F.ceil(cells / F.greatest(one, F.least(left, even)))))
    rows = F.greatest(one, F.least(left, F.ceil(cells / columns)))
    return F.struct(rows.cast("int").alias("rows"), columns.cast("int").alias("columns"))


def pair_all(
    left: DataFrame,
    right: DataFrame,
    tasks: int | None = None,
    right_rows: Column | None = None,
    cell_pairs: int = GRID_PAIRS,
) -> DataFrame:
    """Every left row with every right row, for results that are a product by definition.

    Both sides are laid on a ``grid`` and equi-joined on its cells: a left row is copied along
    its grid row, a right row along its column. The sides are counted inside the query, not
    while it is planned, so both are read twice. The cells are dealt to ``tasks`` (the shuffle
    parallelism by default) by number, lest adaptive execution merges the small inputs
    of a large product. No task needs a whole side, and nothing is broadcast unless it was
    measured to be small.
    """
    tasks = tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left_rows = left.agg(F.count(F.lit(1))).scalar()
    if right_rows is None:
        right_rows = right.agg(F.count(F.lit(1))).scalar()
    cells = grid(left_rows, right_rows, tasks, cell_pairs)

    def placed(side, own, own_size, other, other_size):
        return (
            side.withColumn("_grid", cells)
            .select(
                *side.columns,
                F.pmod(F.xxhash64(*side.columns), F.col("_grid")[own_size]).cast("int").alias(own),
                F.explode(F.sequence(F.lit(0), F.col("_grid")[other_size] - 1)).alias(other),
            )
            .repartition(tasks, "_grid_row", "_grid_column")
        )

    return placed(left, "_grid_row", "rows", "_grid_column", "columns").join(
        placed(right, "_grid_column", "columns", "_grid_row", "rows"), ["_grid_row", "_grid_column"]
    ).drop("_grid_row", "_grid_column")
