"""Lazily evaluated tables and N-dimensional arrays on Spark, each with a size-exact sample."""

from .config import Config, current, session
from .functions.expr import by_row, fdiv, maximum, mean, minimum, normal_cdf, nrow, round_even, total
from .functions.selectors import All, Between, Cols
from .operators.array import NDArray, collect_range, falses, fill, from_numpy, ones, trues, zeros
from .operators.grouped import GroupedTable
from .operators.inference import load_inference
from .operators.offload import offloaded
from .operators.table import Table, innerjoin
from .sources.hdf5 import read_hdf5
from .sources.images import read_jpg, read_png
from .sources.tables import read_arrow, read_csv, read_parquet, read_table

__all__ = [
    "All", "Between", "Cols", "Config", "GroupedTable", "NDArray", "Table", "by_row", "collect_range", "current",
    "falses", "fdiv", "fill", "from_numpy", "innerjoin", "load_inference", "maximum", "mean", "minimum", "normal_cdf",
    "nrow", "offloaded", "ones", "read_arrow", "read_csv", "read_hdf5", "read_jpg", "read_parquet", "read_png",
    "read_table", "round_even", "session", "total", "trues", "zeros",
]
