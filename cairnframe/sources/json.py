"""JSON: a document whose root is an array of rows, an object with an array `tasks`, or one row.

Columns are the sorted union of keys; types come from all rows. Empty strings, JSON nulls and missing keys are null. Nested values read as
JSON text, and integers stay exact. A root that is a scalar, a document without rows or columns, and anything after the root are errors.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FrameError
from ..operators.frame import Frame, check_names
from ..plans.ordering import Key
from .csv import FALSE, INTEGER, TRUE

#: A number as JSON text or in a string.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


class _Value:
    """What a variant column holds, as Spark columns."""

    def __init__(self, v: Column):
        kind = F.schema_of_variant(v)
        nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
        self.text = F.when(nested, F.to_json(v)).otherwise(v.try_cast("string"))
        self.null = v.isNull() | (kind == "VOID") | ((kind == "STRING") & (self.text == ""))
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        double = v.try_cast("double")
        digits = (kind == "STRING") & self.text.rlike(INTEGER)
        whole = numeric & (double == F.floor(double)) & (F.abs(double) < 9.3e18)
        low = F.lower(self.text)
        self.int = F.when(digits, self.text.try_cast("bigint")).when(whole, v.try_cast("bigint"))
        self.float = F.when(numeric | ((kind == "STRING") & self.text.rlike(NUMBER)), double)
        self.bool = F.when(kind == "BOOLEAN", v.try_cast("boolean")).when((kind == "STRING") & low.isin(*TRUE), F.lit(True)).when((kind == "STRING") & low.isin(*FALSE), F.lit(False))

    def of(self, kind: T.DataType) -> Column:
        value = {T.LongType: self.int, T.DoubleType: self.float, T.BooleanType: self.bool, T.StringType: self.text}[type(kind)]
        return F.when(~self.null, value)


def scan_json_frame(spark: SparkSession, path: str) -> Frame:
    text = spark.read.text(path, wholetext=True)
    # In brackets, anything after the root makes the text malformed or a longer array.
    roots = F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit("]"))).cast("array<variant>")
    root = text.select(F.when(F.size(roots) == 1, F.get(roots, F.lit(0))).alias("root"))
    root = root.select(F.coalesce("root", F.raise_error(F.lit("not one JSON document")).cast("variant")).alias("root"))
    entries = F.col("root").try_cast("map<string,variant>")
    listed = F.coalesce(
        F.col("root").try_cast("array<variant>"),
        F.try_variant_get("root", "$.tasks", "array<variant>"),
        F.when(entries.isNotNull(), F.array("root")),
        F.raise_error(F.lit("the root is neither an array nor an object")).cast("array<variant>"),
    )
    rows = root.select(F.posexplode(listed).alias("__row_0", "row"))
    keyed = F.coalesce(F.col("row").try_cast("map<string,variant>"), F.create_map(F.lit("value"), F.col("row")))
    rows = rows.select("__row_0", keyed.alias("row"))
    pairs = rows.select(F.explode_outer("row").alias("key", "v"))
    v = _Value(F.col("v"))
    fits = lambda c: F.coalesce(F.bool_and(F.when(~v.null, c.isNotNull())), F.lit(True))
    try:
        found = pairs.groupBy("key").agg(fits(v.int).alias("int"), fits(v.float).alias("float"), fits(v.bool).alias("bool")).collect()
    except Exception as e:
        raise FrameError(f"can't read {path}: {str(e)[:300]}") from e
    if not found:
        raise FrameError(f"{path} has no rows")
    found = sorted((r for r in found if r["key"] is not None), key=lambda r: r["key"])
    if not found:
        raise FrameError(f"the rows of {path} have no keys")
    names = [r["key"] for r in found]
    check_names(names, spark.conf.get("spark.sql.caseSensitive", "false").lower() == "true")
    place = "__row_0"
    while place in {n.lower() for n in names}:
        place += "_"
    kinds = [T.LongType() if r["int"] else T.DoubleType() if r["float"] else T.BooleanType() if r["bool"] else T.StringType() for r in found]
    df = rows.select(*(_Value(F.col("row")[n]).of(k).alias(n) for n, k in zip(names, kinds)), F.col("__row_0").alias(place))
    return Frame(df, names, (Key(place),))
