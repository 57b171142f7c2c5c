"""A strictly validated dataframe API whose plans are Spark plans."""

from .errors import FrameError
from .functions import Agg, AggFunc, and_, col, count, max_, mean, min_, not_, or_, sum_
from .operators.construct import FrameBuilder, bool_column, column_of, float64_column, frame_of, from_map, from_records, int64_column, utf8_column
from .operators.frame import Frame, Series
from .operators.render import TableOptions, table
from .operators.serialize import projection_checksum, rows_json
from .plans.lazy import CancelToken, LazyFrame, scan_csv, scan_json
from .sources.csv import ScanOptions
from .sources.parquet import scan_parquet

__all__ = [
    "Agg", "AggFunc", "CancelToken", "Frame", "FrameBuilder", "FrameError", "LazyFrame", "ScanOptions", "Series", "TableOptions", "and_", "bool_column", "col", "column_of", "count",
    "float64_column", "frame_of", "from_map", "from_records", "int64_column", "max_", "mean", "min_", "not_", "or_", "projection_checksum", "rows_json", "scan_csv", "scan_json",
    "scan_parquet", "sum_", "table", "utf8_column",
]
