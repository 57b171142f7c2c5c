"""The registered queries over the test tables, each with its SQL.

Scans of CSV and JSON read files that the query itself writes from a table: through Spark, into the shared folder that the cluster names in
spark.checkpoint.dir (one of our own only in local mode, where none is named).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import FrameError
from .functions import and_, col, count, max_, mean, min_, not_, or_, sum_
from .operators.construct import from_map, from_records, int64_column, utf8_column
from .operators.frame import Frame
from .operators.render import table
from .operators.serialize import projection_checksum, rows_json
from .plans.lazy import CancelToken, scan_csv, scan_json
from .sources.csv import ScanOptions
from .sources.parquet import scan_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def _scan(spark, sf_dir, name, ordered=False) -> Frame:
    return scan_parquet(spark, f"{sf_dir}/{name}.parquet", ordered=ordered)


def _nullable(spark, sf_dir, name: str, columns: dict[str, str], keep: list[str]) -> Frame:
    """A table with derived columns, which may be null."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*keep, *(F.expr(e).alias(n) for n, e in columns.items()))
    return Frame(df, df.columns)


def _folder(spark: SparkSession) -> str:
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared.rstrip('/') if shared else 'file://' + tempfile.mkdtemp(prefix='cairnframe-')}/scan-{uuid.uuid4().hex}"


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _scan(spark, sf_dir, "lineitem", ordered=True).filter(and_(col("l_quantity").gt(5), col("l_orderkey").even()))
    return f.sort("l_extendedprice", descending=True).select("l_orderkey", "l_quantity", "l_extendedprice").to_spark(ordered_rows=True)


@query("SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 5 AND l_orderkey % 2 = 0")
def even_filter_sort_select(spark, sf_dir):
    return flagship(spark, sf_dir)


# --- projection -----------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders")
def select_cols(spark, sf_dir):
    return _scan(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate").to_spark()


@query("SELECT * EXCLUDE (o_orderdate, o_orderpriority) FROM orders")
def drop_cols(spark, sf_dir):
    return _scan(spark, sf_dir, "orders").drop("o_orderdate", "o_orderpriority").to_spark()


@query("SELECT r_regionkey AS key, r_name FROM region")
def rename_col(spark, sf_dir):
    return _scan(spark, sf_dir, "region").rename("r_regionkey", "key").to_spark()


@query("SELECT r_regionkey, upper(r_name) AS r_name, r_regionkey * 10 AS tens FROM region")
def with_columns_positional(spark, sf_dir):
    f = _scan(spark, sf_dir, "region", ordered=True)
    names, keys = f.column("r_name").values(), f.column("r_regionkey").values()
    return f.with_columns(utf8_column("r_name", [n.upper() for n in names]), int64_column("tens", [10 * k for k in keys])).to_spark().withColumn("tens", F.col("tens").cast("int"))


@query("""SELECT a.o_orderkey, a.o_totalprice, b.o_totalprice AS ranked FROM
    (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) a JOIN
    (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) b ON a.n = b.n""")
def with_columns_series(spark, sf_dir):
    f = _scan(spark, sf_dir, "orders", ordered=True).select("o_orderkey", "o_totalprice").sort("o_orderkey")
    ranked = f.sort("o_totalprice", descending=True).rename("o_totalprice", "ranked")
    return f.with_columns(ranked.column("ranked")).to_spark()


# --- predicates -----------------------------------------------------------------------------------------------------
def _filter(name: str, table_: str, predicate, columns: list[str], sql: str) -> None:
    def run(spark, sf_dir):
        return _scan(spark, sf_dir, table_).filter(predicate()).select(*columns).to_spark()

    QUERIES[name] = run
    SQL[name] = f"SELECT {', '.join(columns)} FROM {table_} WHERE {sql}"


LINE = ["l_orderkey", "l_linenumber", "l_quantity"]
for _name, _method, _op in (("eq", "eq", "="), ("neq", "neq", "<>"), ("lt", "lt", "<"), ("lte", "lte", "<="), ("gt", "gt", ">"), ("gte", "gte", ">=")):
    _filter(f"filter_{_name}", "lineitem", lambda m=_method: getattr(col("l_quantity"), m)(25), LINE, f"l_quantity {_op} 25")
_filter("filter_int_float_literal_eq", "lineitem", lambda: col("l_linenumber").eq(2.7), LINE, "l_linenumber = 2")
_filter("filter_int_float_literal_gte", "lineitem", lambda: col("l_linenumber").gte(2.7), LINE, "l_linenumber >= 2")
_filter("filter_int_float_literal_lt", "lineitem", lambda: col("l_linenumber").lt(2.7), LINE, "l_linenumber < 2")
_filter("filter_int_text_literal", "lineitem", lambda: col("l_linenumber").eq("3"), LINE, "l_linenumber = 3")
_filter("filter_float_text_literal", "lineitem", lambda: col("l_discount").lte("0.05"), LINE, "l_discount <= 0.05")
_filter("filter_utf8_order", "orders", lambda: col("o_orderpriority").gte("3"), ["o_orderkey", "o_orderpriority"], "o_orderpriority >= '3'")
_filter("filter_utf8_number_literal", "orders", lambda: col("o_orderpriority").gt(3), ["o_orderkey", "o_orderpriority"], "o_orderpriority > '3'")
_filter("filter_in_int", "orders", lambda: col("o_custkey").is_in(1, "3", 99.9, 10**12), ["o_orderkey", "o_custkey"], "o_custkey IN (1, 3, 99, 1000000000000)")
_filter("filter_in_utf8", "orders", lambda: col("o_orderstatus").is_in("F", "P", 1), ["o_orderkey", "o_orderstatus"], "o_orderstatus IN ('F', 'P', '1')")
_filter("filter_in_empty", "orders", lambda: col("o_totalprice").is_in(), ["o_orderkey"], "false")
_filter("filter_even_int", "lineitem", lambda: col("l_orderkey").even(), LINE, "l_orderkey % 2 = 0")
_filter("filter_even_float", "lineitem", lambda: col("l_extendedprice").even(), LINE, "trunc(l_extendedprice)::BIGINT % 2 = 0")
_filter("filter_even_utf8", "documents", lambda: col("text").even(), ["doc_id", "n_chars"], "strlen(text) % 2 = 0")
_filter("filter_and", "lineitem", lambda: and_(col("l_returnflag").eq("R"), col("l_quantity").gt(10)), LINE, "l_returnflag = 'R' AND l_quantity > 10")
_filter("filter_or", "lineitem", lambda: or_(col("l_returnflag").eq("R"), col("l_quantity").gt(40)), LINE, "l_returnflag = 'R' OR l_quantity > 40")
_filter("filter_not", "lineitem", lambda: not_(col("l_returnflag").eq("R")), LINE, "NOT l_returnflag = 'R'")

RETURNED = {"returned": "l_returnflag = 'R'", "discount": "nullif(l_discount, 0)", "price": "nullif(l_tax, 0.02)"}
DERIVED = "(SELECT l_orderkey, l_returnflag = 'R' AS returned, nullif(l_discount, 0) AS discount, nullif(l_tax, 0.02) AS price FROM lineitem)"


def _filter_derived(name: str, predicate, sql: str) -> None:
    def run(spark, sf_dir):
        return _nullable(spark, sf_dir, "lineitem", RETURNED, ["l_orderkey"]).filter(predicate()).to_spark()

    QUERIES[name] = run
    SQL[name] = f"SELECT l_orderkey, returned, discount, price FROM {DERIVED} WHERE {sql}"


_filter_derived("filter_even_bool", lambda: col("returned").even(), "NOT returned")
_filter_derived("filter_bool_eq", lambda: col("returned").eq(True), "returned")
_filter_derived("filter_bool_lt_is_empty", lambda: col("returned").lt(True), "false")
_filter_derived("filter_not_bool_lt", lambda: not_(col("returned").lt(True)), "returned IS NOT NULL")
_filter_derived("filter_is_null", lambda: col("discount").is_null(), "discount IS NULL")
_filter_derived("filter_is_not_null", lambda: col("discount").is_not_null(), "discount IS NOT NULL")
_filter_derived("filter_strict_or", lambda: or_(col("discount").gt(0.05), col("price").lt(0.04)), "(discount > 0.05 OR price < 0.04) AND discount IS NOT NULL AND price IS NOT NULL")
_filter_derived("filter_strict_not_and", lambda: not_(and_(col("discount").gt(0.05), col("price").lt(0.04))), "NOT (discount > 0.05 AND price < 0.04) AND discount IS NOT NULL AND price IS NOT NULL")
_filter_derived("filter_strict_null_test", lambda: or_(col("discount").is_null(), col("price").gte(0.04)), "(discount IS NULL OR price >= 0.04) AND price IS NOT NULL")


# --- rows and sorting -----------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def head(spark, sf_dir):
    return _scan(spark, sf_dir, "orders", ordered=True).select("o_orderkey", "o_totalprice").sort("o_orderkey").head(10).to_spark()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def tail(spark, sf_dir):
    return _scan(spark, sf_dir, "orders", ordered=True).select("o_orderkey", "o_totalprice").sort("o_orderkey").tail(10).to_spark()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def limit_rows(spark, sf_dir):
    f = _scan(spark, sf_dir, "orders", ordered=True).select("o_orderkey", "o_totalprice")
    return f.sort("o_orderkey").sort("o_totalprice", descending=True).limit(15).to_spark()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100")
def slice_rows(spark, sf_dir):
    return _scan(spark, sf_dir, "orders", ordered=True).select("o_orderkey", "o_totalprice").sort("o_orderkey").slice(100, 20).to_spark()


@query("SELECT o_orderkey, price FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS price FROM orders) ORDER BY price NULLS LAST, o_orderkey LIMIT 25")
def sort_asc_nulls_last(spark, sf_dir):
    f = _nullable(spark, sf_dir, "orders", {"price": "case when o_orderstatus = 'F' then null else o_totalprice end"}, ["o_orderkey"])
    return f.sort("o_orderkey").sort("price").head(25).to_spark()


@query("SELECT o_orderkey, price FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS price FROM orders) ORDER BY price DESC NULLS LAST, o_orderkey LIMIT 25")
def sort_desc_nulls_last(spark, sf_dir):
    f = _nullable(spark, sf_dir, "orders", {"price": "case when o_orderstatus = 'F' then null else o_totalprice end"}, ["o_orderkey"])
    return f.sort("o_orderkey").sort("price", descending=True).head(25).to_spark()


@query("SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 50")
def sort_stable_chain(spark, sf_dir):
    return _scan(spark, sf_dir, "orders", ordered=True).select("o_custkey", "o_orderkey").sort("o_orderkey").sort("o_custkey").head(50).to_spark()


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 40")
def sort_utf8_dropped_key(spark, sf_dir):
    f = _scan(spark, sf_dir, "orders", ordered=True).sort("o_orderkey").sort("o_orderpriority", descending=True)
    return f.select("o_orderkey", "o_orderpriority").head(40).to_spark()


# The same sorts without their limits: every row, nulls at the end.
@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS price FROM orders ORDER BY price NULLS LAST, o_orderkey")
def sort_asc_nulls_last_whole(spark, sf_dir):
    f = _nullable(spark, sf_dir, "orders", {"price": "case when o_orderstatus = 'F' then null else o_totalprice end"}, ["o_orderkey"])
    return f.sort("o_orderkey").sort("price").to_spark(ordered_rows=True)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS price FROM orders ORDER BY price DESC NULLS LAST, o_orderkey")
def sort_desc_nulls_last_whole(spark, sf_dir):
    f = _nullable(spark, sf_dir, "orders", {"price": "case when o_orderstatus = 'F' then null else o_totalprice end"}, ["o_orderkey"])
    return f.sort("o_orderkey").sort("price", descending=True).to_spark(ordered_rows=True)


@query("SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey")
def sort_stable_chain_whole(spark, sf_dir):
    return _scan(spark, sf_dir, "orders", ordered=True).select("o_custkey", "o_orderkey").sort("o_orderkey").sort("o_custkey").to_spark(ordered_rows=True)


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey")
def sort_utf8_dropped_key_whole(spark, sf_dir):
    f = _scan(spark, sf_dir, "orders", ordered=True).sort("o_orderkey").sort("o_orderpriority", descending=True)
    return f.select("o_orderkey", "o_orderpriority").to_spark(ordered_rows=True)


@query("SELECT event_type, user_id, event_id FROM events ORDER BY event_type, user_id DESC, event_id")
def sort_events(spark, sf_dir):
    f = _scan(spark, sf_dir, "events", ordered=True).select("event_type", "user_id", "event_id")
    return f.sort("event_id").sort("user_id", descending=True).sort("event_type").to_spark(ordered_rows=True)


# --- groups ---------------------------------------------------------------------------------------------------------
def _rounded(f: Frame, **places: int) -> DataFrame:
    df = f.to_spark()
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


@query("SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def group_count(spark, sf_dir):
    return _scan(spark, sf_dir, "events").group_by("event_type").count().to_spark()


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber_sum FROM lineitem GROUP BY 1")
def group_sum_int(spark, sf_dir):
    return _scan(spark, sf_dir, "lineitem").group_by("l_returnflag").agg(sum_("l_linenumber")).to_spark()


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity_sum FROM lineitem GROUP BY 1")
def group_sum_float(spark, sf_dir):
    return _rounded(_scan(spark, sf_dir, "lineitem").group_by("l_returnflag").agg(sum_("l_quantity")), l_quantity_sum=2)


@query("SELECT l_suppkey, avg(l_linenumber) AS l_linenumber_mean FROM lineitem GROUP BY 1")
def group_mean(spark, sf_dir):
    return _scan(spark, sf_dir, "lineitem").group_by("l_suppkey").agg(mean("l_linenumber")).to_spark()


@query("SELECT l_partkey, min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max FROM lineitem GROUP BY 1")
def group_min_max(spark, sf_dir):
    return _scan(spark, sf_dir, "lineitem").group_by("l_partkey").agg(min_("l_extendedprice"), max_("l_extendedprice")).to_spark()


@query("""SELECT l_returnflag, count(*) AS count, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_mean,
    min(l_linenumber) AS l_linenumber_min, max(l_tax) AS top FROM lineitem GROUP BY 1""")
def group_all(spark, sf_dir):
    f = _scan(spark, sf_dir, "lineitem").group_by("l_returnflag")
    return _rounded(f.agg(count(), sum_("l_quantity"), mean("l_quantity"), min_("l_linenumber"), max_("l_tax").alias("top")), l_quantity_sum=2, l_quantity_mean=6)


@query("SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY 1")
def group_high_cardinality(spark, sf_dir):
    return _rounded(_scan(spark, sf_dir, "lineitem").group_by("l_orderkey").agg(sum_("l_extendedprice").alias("total"), mean("l_quantity").alias("q")), total=2, q=6)


@query("SELECT k, count(*) AS count, round(sum(d), 2) AS d_sum FROM (SELECT nullif(l_returnflag, 'R') AS k, nullif(l_discount, 0) AS d FROM lineitem) GROUP BY 1")
def group_null_key(spark, sf_dir):
    f = _nullable(spark, sf_dir, "lineitem", {"k": "nullif(l_returnflag, 'R')", "d": "nullif(l_discount, 0)"}, [])
    return _rounded(f.group_by("k").agg(count(), sum_("d")), d_sum=2)


@query("SELECT o_orderstatus, count(*) AS count, sum(v) AS v_sum, avg(v) AS v_mean, min(v) AS v_min FROM (SELECT o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS v FROM orders WHERE o_orderstatus <> 'O') GROUP BY 1")
def group_all_null_values(spark, sf_dir):
    f = _nullable(spark, sf_dir, "orders", {"v": "case when o_orderstatus = 'O' then o_totalprice end"}, ["o_orderstatus"]).filter(col("o_orderstatus").neq("O"))
    return f.group_by("o_orderstatus").agg(count(), sum_("v"), mean("v"), min_("v")).to_spark()


@query("SELECT o_custkey, count(*) AS count, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING count(*) > 5 AND sum(o_totalprice) > 1000")
def group_then_filter_sort(spark, sf_dir):
    f = _scan(spark, sf_dir, "orders", ordered=True).group_by("o_custkey").agg(count(), sum_("o_totalprice").alias("total"))
    return _rounded(f.filter(and_(col("count").gt(5), col("total").gt(1000))).sort("total", descending=True), total=2)


@query("""SELECT o_orderstatus, count(*) AS count, CAST(row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS BIGINT) AS place FROM orders GROUP BY 1""")
def group_first_seen_order(spark, sf_dir):
    groups = _scan(spark, sf_dir, "orders", ordered=True).sort("o_orderkey").group_by("o_orderstatus").count()
    places = int64_column("place", range(groups.height))
    return groups.with_columns(places).to_spark()


# --- scans ----------------------------------------------------------------------------------------------------------
def _with_header(spark, sf_dir, name: str, columns: dict[str, str], *order: str, **options) -> str:
    """A one-part CSV with a header, in the table's order; values keep the white space at their ends."""
    path = _folder(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*(f"{e} as {c}" for c, e in columns.items()))
    whole = {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "timestampFormat": "yyyy-MM-dd"}
    df.coalesce(1).sortWithinPartitions(*map(F.expr, order)).write.csv(path, header=True, **whole, **options)
    return path


ORDERS_CSV = {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_totalprice": "o_totalprice", "o_orderpriority": "o_orderpriority", "big": "o_totalprice > 100000"}


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_totalprice > 100000 AS big FROM orders")
def csv_roundtrip(spark, sf_dir):
    return scan_csv(spark, _with_header(spark, sf_dir, "orders", ORDERS_CSV, "o_orderkey")).collect().to_spark()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey % 2 = 0")
def csv_even_sort_select(spark, sf_dir):
    scan = scan_csv(spark, _with_header(spark, sf_dir, "orders", ORDERS_CSV, "o_orderkey"), ScanOptions(multiline=False))
    return scan.filter(col("o_custkey").even()).sort("o_totalprice", descending=True).select("o_orderkey", "o_totalprice").collect().to_spark(ordered_rows=True)


@query("SELECT o_orderkey, nullif(o_custkey % 3, 0) AS part, nullif(o_orderstatus, 'F') AS status, NULL::BIGINT AS nothing FROM orders")
def csv_infer_nulls(spark, sf_dir):
    columns = {"o_orderkey": "o_orderkey", "part": "nullif(o_custkey % 3, 0)", "status": "if(o_orderstatus = 'F', 'NULL', o_orderstatus)", "nothing": "cast(null as string)"}
    return scan_csv(spark, _with_header(spark, sf_dir, "orders", columns, "o_orderkey")).collect().to_spark()


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN NULL ELSE lang END AS lang, text FROM documents")
def csv_custom_delimiter(spark, sf_dir):
    # In the file texts have a sign in front, so that none is the null token or looks like a number; rows with values come first, as types follow the first rows.
    columns = {"doc_id": "doc_id", "lang": "concat('=', nullif(lang, 'fr'))", "text": "concat('=', text)"}
    path = _with_header(spark, sf_dir, "documents", columns, "lang is null", "text is null", "doc_id", sep=";", quoteAll=True, nullValue="NA")
    found = scan_csv(spark, path, ScanOptions(delimiter=";", null_values=("NA",))).collect().to_spark()
    return found.withColumns({c: F.expr(f"substr({c}, 2)") for c in ("lang", "text")})


@query("SELECT o_orderpriority, count(*) AS count, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def csv_group(spark, sf_dir):
    scan = scan_csv(spark, _with_header(spark, sf_dir, "orders", ORDERS_CSV, "o_orderkey"))
    return _rounded(scan.group_by("o_orderpriority").agg(count(), sum_("o_totalprice").alias("total")).collect(), total=2)


def _json(spark, sf_dir, name: str, columns: dict[str, str], wrap: str = "%s") -> str:
    """A JSON document whose rows are a table's."""
    path = _folder(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*(f"{e} as `{c}`" for c, e in columns.items()))
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    start, end = wrap.split("%s")
    rows.agg(F.concat(F.lit(start + "["), F.array_join(F.collect_list("j"), ","), F.lit("]" + end)).alias("value")).coalesce(1).write.text(path)
    return path


@query("SELECT c_custkey, c_acctbal, c_name, c_nationkey::BIGINT AS c_nationkey FROM customer")
def json_rows(spark, sf_dir):
    columns = {"c_custkey": "c_custkey", "c_name": "c_name", "c_nationkey": "cast(c_nationkey as string)", "c_acctbal": "c_acctbal"}
    return scan_json(spark, _json(spark, sf_dir, "customer", columns)).collect().to_spark()


@query("SELECT n_name, nullif(n_regionkey, 0)::BIGINT AS region FROM nation WHERE n_regionkey <> 2")
def json_tasks(spark, sf_dir):
    path = _json(spark, sf_dir, "nation", {"n_name": "n_name", "key": "n_regionkey", "region": "if(n_regionkey = 0, '', cast(n_regionkey as string))"}, '{"tasks":%s,"other":1}')
    return scan_json(spark, path).filter(col("key").neq(2)).select("n_name", "region").collect().to_spark()


@query("SELECT 1::BIGINT AS value UNION ALL SELECT 2 UNION ALL SELECT NULL")
def json_scalar_rows(spark, sf_dir):
    path = _folder(spark)
    spark.createDataFrame([("[1,2,null]",)], ["value"]).coalesce(1).write.text(path)
    return scan_json(spark, path).collect().to_spark()


@query("SELECT c_mktsegment, count(*) AS count, max(c_acctbal) AS c_acctbal_max FROM customer GROUP BY 1")
def json_group(spark, sf_dir):
    path = _json(spark, sf_dir, "customer", {"c_mktsegment": "c_mktsegment", "c_acctbal": "c_acctbal"})
    return scan_json(spark, path).group_by("c_mktsegment").agg(count(), max_("c_acctbal")).collect().to_spark()


def _written(spark, text: str) -> str:
    """A file of the text."""
    path = _folder(spark)
    spark.createDataFrame([(text,)], ["value"]).coalesce(1).write.text(path)
    return path


def _outcomes(spark, cases: dict[str, Callable]) -> DataFrame:
    """For each case the class of the error that it raises, or `no error`."""
    found = []
    for name, run in cases.items():
        try:
            run()
            found.append((name, "no error"))
        except FrameError as e:
            found.append((name, type(e).__name__))
    return spark.createDataFrame(found, "name string, outcome string")


@query("""SELECT c_custkey, c_acctbal > 0 AS plain, CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_acctbal > 0 END AS written,
    c_acctbal > 0 AS mixed, CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'maybe' END AS neither FROM customer""")
def json_bools(spark, sf_dir):
    columns = {
        "c_custkey": "c_custkey",
        "plain": "c_acctbal > 0",
        "written": "if(c_acctbal > 5000, '', if(c_acctbal > 0, 'TRUE', 'f'))",
        "mixed": "if(c_acctbal > 0, 't', 'False')",
        "neither": "if(c_acctbal > 0, 'true', 'maybe')",
    }
    return scan_json(spark, _json(spark, sf_dir, "customer", columns)).collect().to_spark()


@query("""SELECT * FROM (VALUES ('scalar root', 'FrameError'), ('text root', 'FrameError'), ('no rows', 'FrameError'), ('rows without columns', 'FrameError'),
    ('two documents', 'FrameError'), ('cut short', 'FrameError'), ('one row', 'no error'), ('rows under tasks', 'no error')) t(name, outcome)""")
def json_errors(spark, sf_dir):
    texts = {
        "scalar root": "12.5",
        "text root": '"rows"',
        "no rows": "[]",
        "rows without columns": "[{}, {}]",
        "two documents": '[{"k": 4}] [{"k": 5}]',
        "cut short": '[{"k": 4}, {"k"',
        "one row": '{"k": 4}',
        "rows under tasks": '{"tasks": [{"k": 4}], "k": 5}',
    }
    return _outcomes(spark, {n: lambda t=t: scan_json(spark, _written(spark, t)).collect() for n, t in texts.items()})


@query("""SELECT * FROM (VALUES ('no header', 'FrameError'), ('repeated name', 'DuplicateColumn'), ('short row', 'ParseError'), ('long row', 'ParseError'),
    ('only a header', 'no error'), ('filter of a dropped column', 'UnknownColumn'), ('sort of a dropped column', 'UnknownColumn')) t(name, outcome)""")
def csv_errors(spark, sf_dir):
    scan = lambda text: scan_csv(spark, _written(spark, text))
    return _outcomes(
        spark,
        {
            "no header": lambda: scan("").collect(),
            "repeated name": lambda: scan("p,q,p\n4,5,6").collect(),
            "short row": lambda: scan("p,q\n4,5\n6").collect(),
            "long row": lambda: scan("p,q\n4,5\n6,7,8").collect(),
            "only a header": lambda: scan("p,q").collect(),
            "filter of a dropped column": lambda: scan("p,q\n4,5").select("p").filter(col("q").gt(1)).collect(),
            "sort of a dropped column": lambda: scan("p,q\n4,5").select("p").sort("q").collect(),
        },
    )


@query("SELECT * FROM (VALUES ('csv', 'Cancelled'), ('json', 'Cancelled'), ('csv, not cancelled', 'no error')) t(name, outcome)")
def cancelled_scans(spark, sf_dir):
    gone = CancelToken()
    gone.cancel()
    csv, json = scan_csv(spark, _written(spark, "p,q\n4,5")), scan_json(spark, _written(spark, '[{"p": 4}]'))
    return _outcomes(spark, {"csv": lambda: csv.collect(gone), "json": lambda: json.collect(gone), "csv, not cancelled": lambda: csv.collect(CancelToken())})


# --- construction and text ------------------------------------------------------------------------------------------
@query("SELECT * FROM (VALUES (true, 1::BIGINT, 1.5::DOUBLE, 'x'), (NULL, 2, NULL, ''), (false, NULL, 2.5, NULL)) t(a, b, c, d)")
def frame_from_map(spark, sf_dir):
    return from_map(spark, {"d": ["x", "", None], "c": [1.5, None, 2.5], "b": [1, 2, None], "a": [True, None, False]}).to_spark()


@dataclass
class _Record:
    key: int
    label: str | None
    weight: float


@query("SELECT * FROM (VALUES (1::BIGINT, 'x', 0.5::DOUBLE), (2, NULL, 1.0), (0, NULL, 0.0)) t(key, label, weight)")
def frame_from_records(spark, sf_dir):
    return from_records(spark, [_Record(1, "x", 0.5), _Record(2, None, 1), None], _Record).to_spark()


@dataclass
class _Named:
    first: int = field(metadata={"name": "renamed"})
    second: str = field(metadata={"json": "as_json,omitempty"})
    left_out: float = field(metadata={"name": "-"})
    unsupported: list[int]
    _private: int
    plain: bool


@query("SELECT * FROM (VALUES (7::BIGINT, 'u', true), (8, 'v', false)) t(renamed, as_json, plain)")
def frame_from_named_records(spark, sf_dir):
    records = [_Named(7, "u", 0.5, [1], 2, True), _Named(8, "v", 1.5, [], 3, False)]
    return from_records(spark, records, use_json=True).to_spark()


@query("""SELECT (SELECT count(*) FROM orders) AS size, 'float64' AS dtype, min_by(price, k) AS first_value, min_by(price, k) IS NULL AS first_is_null,
    max_by(o_orderpriority, k) AS last_text, false AS as_int64, true AS as_float64 FROM (SELECT o_orderkey AS k, o_orderpriority, o_totalprice AS price FROM orders)""")
def series_accessors(spark, sf_dir):
    f = _scan(spark, sf_dir, "orders", ordered=True).sort("o_orderkey")
    price, text = f.column("o_totalprice"), f.column("o_orderpriority")
    return _one(
        spark,
        size=len(price),
        dtype=str(price.dtype),
        first_value=price.value(0),
        first_is_null=price.is_null(0),
        last_text=text.value_string(len(text) - 1),
        as_int64=price.int64() is not None,
        as_float64=price.float64() is not None,
    )


@query("""SELECT * FROM (VALUES (0.0::DOUBLE, '0'), (1.0, '1'), (-2.5, '-2.5'), (100000.0, '100000'), (1000000.0, '1e+06'), (1234567.5, '1.2345675e+06'), (0.0001, '0.0001'),
    (0.00001, '1e-05'), (1e100, '1e+100'), (0.1, '0.1'), (NULL, '')) t(v, text)""")
def float_texts(spark, sf_dir):
    f = from_map(spark, {"v": [0.0, 1.0, -2.5, 100000.0, 1000000.0, 1234567.5, 0.0001, 0.00001, 1e100, 0.1, None]})
    v = f.column("v")
    return spark.createDataFrame([(x, v.value_string(i)) for i, x in enumerate(v.values())], "v double, text string")


@query("""SELECT sha256(string_agg(concat(o_orderkey::VARCHAR, chr(31), o_custkey::VARCHAR, chr(31), coalesce(nullif(o_orderstatus, 'F'), '')) || chr(10), '' ORDER BY o_orderkey)) AS checksum FROM orders""")
def checksum_cols(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", "o_custkey", "nullif(o_orderstatus, 'F') status", "o_totalprice")
    return _one(spark, checksum=projection_checksum(Frame(df, df.columns).sort("o_orderkey"), 3))


@query("""SELECT '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS rows FROM nation""")
def rows_as_json(spark, sf_dir):
    return _one(spark, rows=rows_json(_scan(spark, sf_dir, "nation", ordered=True).sort("n_nationkey").select("n_nationkey", "n_name")))


@query()
def table_preview(spark, sf_dir):
    return _one(spark, preview=table(_scan(spark, sf_dir, "customer", ordered=True)))


@query("SELECT concat('Source: csv', chr(10), 'Path: /orders.csv', chr(10), 'Scan: projection=[o_custkey,o_orderkey,o_totalprice] filter_even=o_orderkey', chr(10), 'Ops:', chr(10), '- sort(o_custkey,asc)', chr(10), '- select(o_totalprice)', chr(10)) AS plan")
def explain_text(spark, sf_dir):
    plan = scan_csv(spark, f"{sf_dir}/orders.csv").filter(col("o_orderkey").even()).sort("o_custkey").select("o_totalprice")
    return _one(spark, plan=plan.explain().replace(sf_dir, ""))


@query("SELECT * FROM (VALUES ('o_orderkey', 'int64'), ('o_orderstatus', 'utf8'), ('o_totalprice', 'float64')) t(name, dtype)")
def schema_view(spark, sf_dir):
    f = _scan(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return spark.createDataFrame([(x.name, str(x.dtype)) for x in f.schema.fields], ["name", "dtype"])


@query("SELECT (SELECT count(*) FROM orders) AS height, 6::BIGINT AS width")
def shape(spark, sf_dir):
    height, width = _scan(spark, sf_dir, "orders").shape
    return _one(spark, height=height, width=width)


def queries():
    return QUERIES


def oracle_sql():
    return SQL
