from heatsheet.operators.joins import GRID_PAIRS, grid, lookup_join, pair_all
from heatsheet.operators.lineage import stable
from heatsheet.operators.numbering import number_rows, number_within

__all__ = [
    "GRID_PAIRS",
    "lookup_join",
    "number_rows",
    "number_within",
    "grid",
    "pair_all",
    "stable",
]
